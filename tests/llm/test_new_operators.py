"""Runs, the manifest and repeated windows on small tables: brute force by the contracts' words, edge cases, plain versions of the parts."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from groundwork.llm import anchors, manifest, periods, queries
from groundwork.llm.store import ready

WORD = re.compile(r"[^\x20\x09-\x0D]+")
EDGES = [(1, None), (2, ""), (3, " \n\t"), (4, "word"), (5, "word"), (5, "word"), (None, "word " * 90), (6, "é" * 3000), (7, "a b " * 40), (8, "A b " * 40), (9, "x" * 200_000), (10, "日本語 text <|endoftext|> ' '"), (11, "a b\tc " * 30_000)]
CLASHES = "doc_id long, text string, d int, h string, t string, x int, block string, _w string, periodic string"


@pytest.fixture(scope="module")
def edges(spark):
    ready(spark)
    return spark.createDataFrame([(d, t, 1, "own", "clash", 2, "b", "w", "p") for d, t in EDGES], CLASHES)


def _sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- periodic runs


def _runs(w):
    out, n = [], len(w)
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            e = i + q
            if e - s >= max(24, 3 * q) and not any(w[s : e - r] == w[s + r : e] for r in range(1, q)):
                out.append((s, e - s, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def _periodic_words(r):
    k, out = r.choice([1, 2, 2, 3, 5, 30]), []
    while len(out) < r.randint(0, 200):
        if r.random() < 0.4:
            out += [r.randrange(k) for _ in range(r.randint(1, 20))]
        else:
            unit = [r.randrange(k) for _ in range(r.randint(1, 12))] * r.randint(2, 14)
            out += unit[: len(unit) - r.randint(0, 3)]
    return [f"w{x}" for x in (out * 3 if r.random() < 0.3 else out)]


def _collapsed(w, runs):
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def test_runs_against_brute_force(spark):
    r = random.Random(5)
    words = [_periodic_words(r) for _ in range(400)]
    df = spark.createDataFrame([(i, " \n".join(w)) for i, w in enumerate(words)], "doc_id long, text string")
    found = 0
    for row in periods.find(df).collect():
        want = _runs(words[row.doc_id])
        found += len(want)
        assert [tuple(x) for x in row.periodic.runs] == want
        assert row.periodic.n_words == len(words[row.doc_id])
        assert row.periodic.collapsed == _collapsed(words[row.doc_id], want) and row.periodic.collapsed_sha256 == _sha(row.periodic.collapsed)
    assert found > 300


def test_runs_of_long_and_odd_texts(spark, edges):
    out = periods.digests(periods.find(edges.drop("periodic"))).collect()
    assert len(out) == len(EDGES)
    by = {r.doc_id: r for r in out}
    assert (by[11].n_runs, by[11].start, by[11].length, by[11].period, by[11].exponent_milli) == (1, 0, 90_000, 3, 30_000_000)
    assert by[1].n_runs == 0 and by[1].start is None and by[1].runs_sha256 == _sha("") and by[1].collapsed_sha256 == _sha("")
    assert by[7].collapsed_sha256 == _sha("a b") and by[11].x == 2 and by[11]._w == "w"
    assert periods.digests(periods.find(edges.filter("false").drop("periodic"))).count() == 0
    tie = periods.digests(periods.find(spark.createDataFrame([(1, "a " * 24 + "x " + "b " * 24)], "doc_id long, text string"))).first()
    assert (tie.n_runs, tie.start, tie.length) == (2, 0, 24)


def test_runs_of_the_query(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    planted = 0
    for row in queries.op11_periodic_runs(spark, sf_dir).collect():
        w, h = WORD.findall(texts[row.doc_id] or ""), zlib.crc32(str(row.doc_id).encode())
        if h % 10 == 0 and w:
            g = h // 10
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
            planted += 1
        want = _runs(w) if len(w) < 1500 else None
        if want is None:
            continue
        best = min(want, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None, None, None))
        assert (row.n_runs, row.start, row.length, row.period) == (len(want), *best)
        assert row.exponent_milli == (1000 * best[1] // best[2] if want else None)
        assert row.runs_sha256 == _sha("".join(f"{s},{m},{q}\n" for s, m, q in want)) and row.collapsed_sha256 == _sha(_collapsed(w, want))
    assert planted > 5


def test_grammar_gives_the_text_back():
    r = random.Random(3)
    for _ in range(60):
        ids = [r.randrange(r.choice([1, 2, 5])) for _ in range(r.randint(1, 120))]
        rules, left = periods.re_pair(ids)
        n = max(ids) + 1

        def derive(x, n=n, rules=rules):
            return [x] if x < n else [z for y in rules[x - n] for z in derive(y)]

        assert [y for x in left for y in derive(x)] == ids
        seen, last = {}, None
        for i, pair in enumerate(zip(left, left[1:], strict=False)):  # no pair occurs twice but for overlaps
            assert pair not in seen or seen[pair] == i - 1
            seen[pair] = i


# --- the manifest


def _leaf(*values):
    return _sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def _tree(level):
    levels = [level]
    while len(level) > 1:
        level = [_sha("".join(level[i : i + 16])) for i in range(0, len(level), 16)]
        levels.append(level)
    return levels


def _siblings(levels, i):
    for level in levels[:-1]:
        low = i // 16 * 16
        yield level[low:i], level[i + 1 : low + 16]
        i //= 16


def _plain(rows):
    """doc_id, leaf, subroot, root, proof and folded root of each row by the contract's words."""
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append((r[0] is not None, r[0], _leaf(r[0], r[1], r[2], r[3], r[4]), r))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = [_tree([x[2] for x in sorted(groups[s], key=lambda x: (x[0], x[1] or 0, x[2]))]) for s in order]
    top, out = _tree([t[-1][0] for t in trees]), []
    for k, s in enumerate(order):
        for i, (_, d, leaf, r) in enumerate(sorted(groups[s], key=lambda x: (x[0], x[1] or 0, x[2]))):
            sides = [*_siblings(trees[k], i), *_siblings(top, k)]
            text = r[4]
            if d is not None and zlib.crc32(str(d).encode()) % 5 == 0 and text is not None:
                text = re.sub("[A-Z]", lambda m: m.group().lower(), text)
            h = _leaf(d, s, r[2], r[3], text)
            for left, right in sides:
                h = _sha("".join(left) + h + "".join(right))
            out.append((d, leaf, trees[k][-1][0], top[-1][0], _sha("".join("".join(a) + "".join(b) for a, b in sides)), h, h == top[-1][0]))
    return out


def _key(row):
    return tuple((x is not None, x) for x in row)


@pytest.mark.parametrize("n", [0, 1, 5, 700])
def test_manifest_against_a_plain_one(spark, tmp_path, n):
    r = random.Random(n)
    rows = [(i if i % 97 else None, r.choice([None, "", "a", "é", "zz", *["hot"] * 6, *(f"s{k}" for k in range(30))]), r.choice([None, "en"]), r.choice([None, 3]), r.choice([None, "", "Text É", "low"])) for i in range(n)]
    rows += rows[:3]
    spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").withColumn("leaf", F.lit("own")).withColumn("at", F.lit(1)).write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(x) for x in queries.op12_manifest(spark, str(tmp_path)).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()]
    assert sorted(got, key=_key) == sorted(_plain(rows), key=_key)


def test_proofs_of_some_rows(spark, monkeypatch):
    monkeypatch.setattr(manifest, "SPAN", 40)  # leaf partitions that cut runs
    rows = [(i, "a" if i % 3 else "b", str(i)) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    made = manifest.build(df, manifest.leaf(F.col("doc_id"), F.col("text")))
    every = {x.id: x for x in manifest.prove(made, whole=True).collect()}
    some = manifest.prove(made, made.leaves.filter("id % 7 = 0"), whole=True).collect()
    assert len(every) == 900 and len(some) == 129
    assert all(x.verified and x.proof == every[x.id].proof and x.root == made.root for x in some)


def test_missing_nodes_are_the_least_set():
    r = random.Random(2)
    for _ in range(200):
        size = r.randint(1, 5000)
        places = r.sample(range(size), min(size, r.randint(1, 40)))
        asked, known = set(manifest.missing(places, size)), {(0, x) for x in places}
        level, n = 0, size
        needed = set()
        while n > 1:
            up = {x // 16 for lv, x in known if lv == level}
            needed |= {(level, y) for x in up for y in range(16 * x, min(16 * x + 16, n))} - known
            known |= {(level + 1, x) for x in up}
            level, n = level + 1, -(-n // 16)
        assert asked == needed  # what is derivable isn't asked for, all else is, once


# --- repeated windows


def _windows_removed(texts):
    words = [WORD.findall(t or "") for t in texts]
    count = {}
    for w in words:
        for i in range(len(w) - 34):
            count[tuple(w[i : i + 35])] = count.get(tuple(w[i : i + 35]), 0) + 1
    out = []
    for w in words:
        gone = {j for i in range(len(w) - 34) if count[tuple(w[i : i + 35])] > 1 for j in range(i, i + 35)}
        out.append((len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return out


@pytest.mark.parametrize("held", [anchors.HELD, 4000])
def test_windows_against_brute_force(spark, edges, monkeypatch, held):
    monkeypatch.setattr(anchors, "HELD", held)
    monkeypatch.setattr(anchors, "LEAST", held)
    r, texts = random.Random(8), []
    vocabulary = [f"w{i}" for i in range(400)]
    passages = [[r.choice(vocabulary) for _ in range(r.randint(30, 90))] for _ in range(12)]
    for _ in range(300):
        w = []
        for _ in range(r.randint(1, 5)):
            p = r.choice(passages)
            cut = r.randint(0, 20)
            w += r.choice([p, p[cut:], p[: len(p) - cut], [r.choice(vocabulary) for _ in range(r.randint(1, 60))]])
        if r.random() < 0.2:
            w[r.randrange(len(w))] = "changed"
        texts.append(" \t".join(w))
    texts += [texts[0]] * 40 + [t for _, t in EDGES]
    ids = list(range(len(texts)))
    df = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").withColumn("x", F.lit("own")).withColumn("d", F.lit(0))
    got = {x.doc_id: x for x in anchors.remove_windows(df).collect()}
    for i, (n, gone, kept) in enumerate(_windows_removed(texts)):
        assert (got[i].n_words, got[i].n_removed, got[i].kept, got[i].kept_sha256) == (n, gone, kept, _sha(kept))
    assert anchors.remove_windows(edges).count() == len(EDGES)
    assert anchors.remove_windows(edges.filter("false")).count() == 0


def test_cover_and_lengths():
    # any two places have a shift under the period that takes both into the cover
    assert {(a - b) % anchors.PERIOD for a in anchors.COVER for b in anchors.COVER} == set(range(anchors.PERIOD))
    for n in (34, 35, 36, 54, 55, 56, 70):  # matches of all lengths about the window's, at all offsets
        w = [f"m{i}" for i in range(n)]
        for i, j in ((0, 0), (1, 20), (7, 13)):
            texts = [" ".join([f"a{k}" for k in range(i)] + w), " ".join([f"b{k}" for k in range(j)] + w + ["tail"])]
            assert [x[1] for x in _windows_removed(texts)] == ([n, n] if n >= 35 else [0, 0])
            assert np.array_equal([_removed(t, texts) for t in texts], [n, n] if n >= 35 else [0, 0])


def _removed(text, texts):
    """The library's steps over one block, without Spark."""
    import pyarrow as pa
    import zstandard

    pack = zstandard.ZstdCompressor()
    table = pa.table({"block": pa.array([0] * len(texts), pa.int32()), "d": pa.array(range(len(texts)), pa.int64()), "t": pa.array([pack.compress(t.encode()) for t in texts], pa.binary())})
    sent = anchors._send(table).to_pandas()
    total = sent.groupby(["x", "y"]).n.transform("sum")
    group = sent.groupby("x")
    state = (total > 1) * 1 + (group.y.transform("nunique") > 1) * 2
    keep = group.n.transform("sum") > 1
    replies = pa.table({"block": sent.block[keep].to_numpy(), "x": sent.x[keep].to_numpy(), "y": sent.y[keep].to_numpy(), "state": state[keep].to_numpy().astype(np.int32)})
    asked = anchors._extend(table, replies).to_pandas()
    asked = asked[asked.n > 1]
    again = pa.table({"block": asked.block.to_numpy(), "x": asked.x.to_numpy(), "y": asked.y.to_numpy(), "state": np.full(len(asked), 4, np.int32)})
    return anchors._cut(table, pa.concat_tables([replies.cast(again.schema), again]))["n_removed"].to_pylist()[texts.index(text)]
