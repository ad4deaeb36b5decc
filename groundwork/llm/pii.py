"""Personal data by bootstrapped contextual extraction.

Base spans (e-mail and IP addresses, card and phone numbers) are the seeds. Strings that look like identifiers but are no
base span are candidates. Seeds and candidates are taken with the lexical patterns they stand in: the two words before, or one
word before and one after. Spark keeps the graph of patterns and instances and scores it in rounds: a pattern is as good
for a kind as the share of that kind among its known instances (unknown ones count UNKNOWN against it, and CAUTION is added),
an instance as good as its patterns together make it; instances over ACCEPT become known for the next round. Accepted
candidates become spans beside the base ones, which always stay.

Only distinct (pattern, instance) pairs enter the graph and only patterns over ACCEPT are joined back, so a frequent pattern's
many unknown instances are aggregated and dropped before any join.

Defined results: null and empty texts have no span; candidates that touch a base span are none; an instance that is accepted
for several kinds takes the best one, then the first as listed; repeated rows get the same spans; without seeds nothing is added.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .store import dropped, written

KINDS = ("email", "ip", "card", "phone")
ROUNDS = 3
#: Added to what speaks against a pattern: for each unknown instance, and once.
UNKNOWN, CAUTION = 0.1, 0.5
#: Distinct known instances that a pattern needs.
SUPPORT = 3
ACCEPT = 0.8
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9][0-9.]*")
_PARTS = re.compile(r"([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TOKEN = re.compile(r"[^\s\"'=:,;<>(){}\[\]]+")
#: Groups of digits, some in brackets, with one space, dot or hyphen between them.
_GROUPS = re.compile(r"(?<![0-9+(.-])(?:\([0-9]++\)|[0-9]++)(?:(?:[ .-]|(?<=\)))(?:\([0-9]++\)|[0-9]++))++")
_INTEREST = K.lut([*range(0x30, 0x3A), 0x40])
_NUMERIC = re.compile(r"[0-9+().-]+")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """From each @ the local part goes back as far as its signs do, but not into the match before."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        else:
            done = max(done, at + 1) if start == at else done
        at = text.find("@", max(at + 1, done))


def ips(text: str) -> Iterator[tuple[int, int]]:
    """Matches lie inside runs of digits and dots; after four parts the search goes on behind them."""
    for run in _DOTTED.finditer(text):
        if run[0].count(".") < 3:
            continue
        at = run.start()
        while at < run.end():
            if m := _PARTS.match(text, at, run.end()):
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.groups()):
                    yield m.span()
                at = m.end()
            else:
                while at < run.end() and text[at] != ".":
                    at += 1
            while at < run.end() and text[at] == ".":
                at += 1


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        if 8 <= len(_DIGIT.findall(m[0])) <= 15:
            yield m.span()


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """kind, start, end in code points, by kind as listed, then start."""
    found = (("email", emails(text) if "@" in text else ()), ("ip", ips(text)), ("card", cards(text)), ("phone", phones(text) if "+" in text else ()))
    return [(kind, a, b) for kind, spans in found for a, b in spans]


def fits(token: str) -> list[str]:
    """The kinds that a candidate can be of by its signs."""
    if "@" in token:
        return ["email"] if 0 < token.index("@") < len(token) - 1 else []
    digits = len(_DIGIT.findall(token))
    if digits < 4 or not _NUMERIC.fullmatch(token):
        return []
    return [k for k, ok in (("ip", token.count(".") == 3 and "+" not in token), ("card", 12 <= digits <= 19 and "+" not in token and "." not in token), ("phone", 7 <= digits <= 15)) if ok]


def _word(w: str) -> str:
    """A word of a pattern, digits read as 0; a long one goes by its digest, which is as good to compare."""
    w = _DIGIT.sub("0", w.lower())
    return w if len(w) <= 64 else hashlib.sha256(w.encode()).hexdigest()


class Words:
    """The words of a text between white space, found once for all of its spans."""

    def __init__(self, text: str):
        found = [m.span() for m in re.finditer(r"\S+", text)]
        self.text, self.starts, self.ends = text, [a for a, _ in found], [b for _, b in found]

    def before(self, at: int) -> list[str]:
        """The last two words before a place, the second cut where it reaches over it."""
        last = bisect_left(self.starts, at)
        return [self.text[self.starts[i] : min(self.ends[i], at)] for i in range(max(0, last - 2), last)]

    def after(self, at: int) -> list[str]:
        first = bisect_right(self.ends, at)
        return [self.text[max(self.starts[i], at) : self.ends[i]] for i in range(first, min(first + 1, len(self.ends)))]


def _patterns(words: Words, start: int, end: int) -> list[str]:
    """Lexical patterns around a span."""
    word, before, after = _word, words.before(start), words.after(end)
    out = []
    if len(before) == 2:
        out.append(f"{word(before[0])} {word(before[1])} _")
    if before and after:
        out.append(f"{word(before[-1])} _ {word(after[0])}")
    return out


def _candidates(text: str, base: list[tuple[str, int, int]]) -> Iterator[tuple[int, int, str, list[str]]]:
    spans = sorted((a, b) for _, a, b in base)
    starts = [a for a, _ in spans]
    reach = np.maximum.accumulate([b for _, b in spans]).tolist() if spans else []

    def free(a: int, b: int) -> bool:
        i = bisect_left(starts, b) - 1
        return i < 0 or reach[i] <= a

    for m in _TOKEN.finditer(text):
        token = m[0].rstrip(".!?")
        if len(token) < 4 or not (kinds := fits(token)):
            continue
        a, b = m.start(), m.start() + len(token)
        if free(a, b):
            yield a, b, token, kinds
    for m in _GROUPS.finditer(text):
        digits = len(_DIGIT.findall(m[0]))
        kinds = [k for k, ok in (("card", 12 <= digits <= 19 and "(" not in m[0]), ("phone", 7 <= digits <= 15)) if ok]
        if kinds and (" " in m[0] or "(" in m[0]) and free(*m.span()):
            yield *m.span(), m[0], kinds


def _interesting(column: pa.Array) -> list[bool]:
    """Whether each text has a digit or an @."""
    out: list[bool] = []
    for _, _, data, offsets in K.blocks(column):
        sums = np.concatenate([[0], np.cumsum(_INTEREST[data])])
        out += (sums[offsets[1:]] > sums[offsets[:-1]]).tolist()
    return out


def _graph(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """pattern, instance, kind, seed (a known instance) of every seed and candidate; a pattern may be empty."""
    kind = pa.schema([("d", pa.string()), ("h", pa.int64()), ("s", pa.int32()), ("e", pa.int32()), ("pattern", pa.string()), ("instance", pa.string()), ("kind", pa.string()), ("seed", pa.bool_())])
    for batch in batches:
        rows = []
        ids, hashes, column = batch.column(0), batch.column(1), batch.column(2)
        for i in np.flatnonzero(_interesting(column)).tolist():
            text = column[i].as_py()
            base = base_spans(text)
            others = list(_candidates(text, base))
            if not base and not others:
                continue
            d, h, words = ids[i].as_py(), hashes[i].as_py(), Words(text)
            for k, a, b in base:
                rows += [(d, h, a, b, p, text[a:b], k, True) for p in [*_patterns(words, a, b), ""]]
            for a, b, token, kinds in others:
                rows += [(d, h, a, b, p, token, k, False) for k in kinds for p in [*_patterns(words, a, b), ""]]
            if len(rows) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), kind, strict=True)], schema=kind)
                rows = []
        cols = list(zip(*rows, strict=True)) or [()] * 8
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(cols, kind, strict=True)], schema=kind)


def discover(docs: DataFrame, id_col: str = "doc_id", text: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """d (the id as text), h (hash of the text), added: the spans (kind, start, end) that the bootstrap finds, by text."""
    rows = docs.select(F.col(id_col).cast("string").alias("d"), F.xxhash64(text).alias("h"), F.col(text).alias("t")).filter("t is not null")
    seen = written(rows.mapInArrow(_graph, "d string, h long, s int, e int, pattern string, instance string, kind string, seed boolean"), "mentions")
    edges = written(seen.groupBy("pattern", "instance", "kind").agg(F.max("seed").alias("seed")), "graph")
    known = edges.filter("seed").select("instance", "kind").distinct().withColumn("score", F.lit(1.0))
    lexical = edges.filter("pattern <> ''")
    spread = lexical.groupBy("pattern").agg(F.count_distinct("instance").alias("instances")).filter(F.col("instances") >= SUPPORT)
    tables = [seen, edges]
    for _ in range(rounds):
        good = lexical.join(known, ["instance", "kind"]).groupBy("pattern", "kind").agg(F.sum("score").alias("mass"), F.count("*").alias("support"))
        all_kinds = good.groupBy("pattern").agg(F.sum("mass").alias("known_mass"), F.sum("support").alias("known"))
        against = F.col("known_mass") + UNKNOWN * F.greatest(F.col("instances") - F.col("known"), F.lit(0)) + CAUTION
        good = good.filter(F.col("support") >= SUPPORT).join(all_kinds, "pattern").join(spread, "pattern").withColumn("trust", F.col("mass") / against).filter(F.col("trust") >= ACCEPT)
        found = lexical.filter("not seed").join(good.select("pattern", "kind", "trust"), ["pattern", "kind"]).groupBy("instance", "kind").agg((1 - F.exp(F.sum(F.log(1.0000001 - F.col("trust"))))).alias("score"))
        known = written(known.unionByName(found.filter(F.col("score") >= ACCEPT)).groupBy("instance", "kind").agg(F.max("score").alias("score")), "known")
        tables.append(known)
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    best = known.groupBy("instance").agg(F.max_by("kind", F.struct("score", -order)).alias("kind"))
    hits = seen.filter("not seed and pattern = ''").join(best, ["instance", "kind"]).select("d", "h", "kind", "s", "e").distinct()
    added = hits.groupBy("d", "h").agg(F.collect_list(F.struct(F.col("kind"), F.col("s").alias("start"), F.col("e").alias("end"))).alias("added"))  # bounded by the text
    out = written(added, "added")  # of a known size: Spark broadcasts it where it's small, and joins by shuffle else
    dropped(*tables)
    return out


def _told(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _all_spans(column: pa.Array, added: pa.Array) -> Iterator[tuple[str | None, list, list]]:
    for text, some, more in zip(column, _interesting(column), added.to_pylist(), strict=True):
        base = base_spans(text.as_py()) if some else []
        every = base + [(x["kind"], x["start"], x["end"]) for x in more or []]
        yield text, base, sorted(set(every), key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


_FOUND = "struct<n_email: long, n_ip: long, n_card: long, n_phone: long, base_sha256: string, spans: string, n_added: long>"


@K.udf(_FOUND)
def _found(column: pa.Array, added: pa.Array) -> pa.Array:
    out = []
    for _, base, every in _all_spans(column, added):
        counts = [sum(k == kind for k, _, _ in base) for kind in KINDS]
        out.append({**{f"n_{k}": c for k, c in zip(KINDS, counts, strict=True)}, "base_sha256": hashlib.sha256(_told(base).encode()).hexdigest(), "spans": _told(every), "n_added": len(every) - len(base)})
    kind = pa.struct([*((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_added", pa.int64())])
    return pa.array(out, kind)


@K.udf("string")
def _redacted(column: pa.Array, added: pa.Array) -> pa.Array:
    out = []
    for text, _, every in _all_spans(column, added):
        x = text.as_py()
        parts, at = [], 0
        for a, b, k in sorted((a, b, k) for k, a, b in every):
            if a >= at:
                parts += [x[at:a], f"[{k.upper()}]"]
            elif b > at:
                pass
            at = max(at, b)
        out.append("".join([*parts, x[at:]]) if parts else x)
    return K.strings(out)


def _with_added(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """docs with the added spans in a column of its own."""
    added = discover(docs, id_col, text).withColumnsRenamed({"d": "_pii_d", "h": "_pii_h", "added": "_pii_added"})
    return docs.join(added, (F.col(id_col).cast("string") == F.col("_pii_d")) & (F.xxhash64(text) == F.col("_pii_h")), "left").drop("_pii_d", "_pii_h")


def find(docs: DataFrame, id_col: str = "doc_id", text: str = "text", name: str = "pii") -> DataFrame:
    """docs with a struct: counts of base spans by kind, base_sha256, spans (all, as kind:start:end), n_added.

    Discovered spans are brought back by id, so rows without id have their base spans only; redact() masks no more of them."""
    return _with_added(docs, id_col, text).withColumn(name, _found(F.col(text), F.col("_pii_added"))).drop("_pii_added")


def redact(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with every span replaced by its kind in brackets; of spans that overlap the first names the kind."""
    return _with_added(docs, id_col, text).withColumn(text, _redacted(F.col(text), F.col("_pii_added"))).drop("_pii_added")
