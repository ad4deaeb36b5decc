"""Sentences with exact offsets, abbreviations that a text itself shows, and the innermost interval that holds a point."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from groundwork.operators import blocks

#: Signs that end a sentence, and closing signs that still belong to it.
TERMINATORS, CLOSERS = ".!?…", "\"'”’»)]"
#: Share of tokens, by length, up to whose length a token can be an abbreviation.
SHORT = 0.1
_WORD = r"\p{L}[\p{L}\p{M}]*"


def lines_of(text: Column) -> Column:
    """The text with each line end as one line feed; offsets count its characters."""
    return F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def _by_doc(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """doc, t: the texts dealt by doc once, so that what is made of their words is grouped, ordered and joined by doc where it is, without going through a shuffle."""
    return docs.select(F.col(doc).alias("doc"), F.col(text).alias("t")).repartition("doc").select("doc", lines_of(F.col("t")).alias("t"))


def abbreviations(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc, token: tokens that stand before a full stop at every occurrence, two at least, and are no longer than the tenth of the text's tokens by length."""
    t = _by_doc(docs, doc, text)
    each = t.select("doc", F.explode(F.regexp_extract_all("t", F.lit(rf"({_WORD}\.?)"))).alias("m"))
    counted = each.groupBy("doc", F.rtrim(F.col("m"), F.lit(".")).alias("token")).agg(F.count("*").alias("n"), F.count_if(F.col("m").endswith(".")).alias("dotted"))
    size = counted.withColumn("len", F.char_length("token"))
    by = Window.partitionBy("doc")
    upto = F.sum("n").over(by.orderBy("len").rangeBetween(Window.unboundedPreceding, 0))
    # the length at place floor(all * SHORT), from 0, of the tokens in order of their lengths
    placed = size.withColumn("upto", upto).withColumn("at", F.floor(F.sum("n").over(by) * SHORT))
    bar = placed.withColumn("bar", F.min(F.when(F.col("upto") > F.col("at"), F.col("len"))).over(by))
    return bar.filter("dotted = n and n >= 2 and len <= bar").select("doc", "token")


def sentences(docs: DataFrame, known: DataFrame | None = None, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc, order, start, sentence: a sentence ends behind a terminator, and closing quotes after it, before white space or the end of a paragraph.

    No full stop behind an abbreviation ends one: of `known` (token) if given, else of abbreviations() of the text. Paragraphs are parted by lines of
    white space. start counts characters of lines_of(text), which has the sentence there; a text without other signs than white space has none.
    Null texts have none either. Offsets come from the lengths of the pieces that a text is cut into, so a text is read once.
    """
    t = _by_doc(docs, doc, text).filter("t is not null")
    # pieces: up to each end of a sentence or of a paragraph, none left out
    signs, closers = "[" + TERMINATORS + "]", "[" + "".join("\\" + c if c in "]" else c for c in CLOSERS) + "]"
    cut = rf"(?sU)(.*?(?:{signs}{closers}*(?=\s|\z)|\n\s*\n+|\z))"
    pieces = t.select("doc", F.posexplode(F.regexp_extract_all("t", F.lit(cut))).alias("k", "piece")).filter("piece <> ''")
    order = Window.partitionBy("doc").orderBy("k")
    sized = pieces.withColumn("at", F.coalesce(F.sum(F.char_length("piece")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    token = F.regexp_extract("piece", rf"([\p{{L}}\p{{M}}]+)\.{closers}*\z", 1)
    stop = sized.withColumn("token", F.nullif(token, F.lit("")))
    if known is None:
        marks = abbreviations(docs, doc, text).groupBy("doc").agg(F.collect_set("token").alias("short"))  # of one text
        stop = stop.join(marks, "doc", "left").withColumn("abbreviated", F.array_contains("short", F.col("token"))).drop("short")
    else:
        stop = stop.join(known.select("token").distinct().withColumn("abbreviated", F.lit(True)), "token", "left")
    # a piece behind an abbreviation goes on; a blank line ends the piece before it and itself
    whole = stop.withColumn("open", F.coalesce("abbreviated", F.lit(False))).withColumn("fresh", F.coalesce(~F.lag("open").over(order), F.lit(True)))
    number = F.sum(F.col("fresh").cast("long")).over(order)
    joined = whole.withColumn("g", number).groupBy("doc", "g").agg(F.min("at").alias("at"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "piece"))), lambda x: x["piece"]), "").alias("s"))
    lead = F.char_length(F.regexp_extract("s", r"(?U)^(\s*)", 1))
    kept = joined.withColumn("sentence", F.regexp_replace("s", r"(?U)^\s+|\s+\z", "")).filter("sentence <> ''")
    place = F.row_number().over(Window.partitionBy("doc").orderBy("g")) - 1
    return kept.select("doc", place.cast("long").alias("order"), (F.col("at") + lead).cast("long").alias("start"), "sentence")


def innermost(points: DataFrame, intervals: DataFrame, by: list[str]) -> DataFrame:
    """points (by, at) with id, the interval [lo, hi) of their group that holds them and is the shortest, of equal ones the one that begins last, then the least id; null without any.

    A group is read by one task, in blocks of whole groups: the intervals come in that order, and each takes the points it holds that none has taken, so a point is
    taken once and an interval costs no more than a look, however long it is. Intervals with hi <= lo hold nothing. Repeated points are one.
    """
    kinds = {f.name: f.dataType for f in points.schema} | {"id": intervals.schema["id"].dataType}
    number = kinds["at"].simpleString() if kinds["at"].simpleString() in ("float", "double") else "bigint"
    spans = intervals.filter("hi > lo").dropna(subset=by).select(*by, "id", F.col("lo").cast(number).alias("lo"), F.col("hi").cast(number).alias("hi"))
    rows = spans.unionByName(points.select(*by, F.col("at").cast(number).alias("lo")), allowMissingColumns=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, begins in blocks.whole_groups(batches, *by):
            point, taken = held(table, begins)
            flat = table.take(pa.array(point))
            ids = pa.concat_arrays(table["id"].chunks).take(pa.array(taken, mask=taken < 0))
            yield from blocks.batches_of({c: flat[c] for c in by} | {"at": flat["lo"], "id": ids})

    out = blocks.ordered(rows, by).mapInArrow(run, StructType([*(StructField(c, kinds[c]) for c in by), StructField("at", rows.schema["lo"].dataType), StructField("id", kinds["id"])]))
    return out.select(*by, F.col("at").cast(kinds["at"]).alias("at"), "id")


def held(table: pa.Table, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the distinct points (hi is null) of some groups, and for each the row of the interval that innermost() gives it, or -1."""
    group, interval = np.repeat(np.arange(len(begins) - 1), np.diff(begins)), table["hi"].is_valid().to_numpy()
    ids = pc.dictionary_encode(pa.concat_arrays(table["id"].chunks))
    rank = np.empty(len(ids.dictionary), np.int64)
    rank[pc.sort_indices(ids.dictionary).to_numpy()] = np.arange(len(rank))
    known = ids.indices.is_valid().to_numpy(zero_copy_only=False)
    name = np.full(table.num_rows, -1, np.int64)
    name[known] = rank[ids.indices.drop_null().to_numpy()]
    has = table["lo"].is_valid().to_numpy()
    lo, hi = table["lo"].fill_null(0).to_numpy(), table["hi"].fill_null(0).to_numpy()
    # places as their ranks, so that group and place are one number
    values, places = np.unique(np.concatenate([lo, hi]), return_inverse=True)
    low, high = group * (len(values) + 1) + places[: len(lo)], group * (len(values) + 1) + places[len(lo) :]
    at, rows = np.unique(low[~interval & has], return_index=True)
    rows = np.flatnonzero(~interval & has)[rows]
    spans = np.flatnonzero(interval)
    spans = spans[np.lexsort((name[spans], -lo[spans], hi[spans] - lo[spans]))]
    taken, free = [-1] * len(at), list(range(len(at) + 1))  # free: the next point from each on that isn't taken, when followed to its end
    for row, j, end in zip(spans.tolist(), np.searchsorted(at, low[spans]).tolist(), np.searchsorted(at, high[spans]).tolist(), strict=True):
        while j < end:
            root = j
            while free[root] != root:
                root = free[root]
            while free[j] != root:
                free[j], j = root, free[j]
            if (j := root) >= end:
                break
            taken[j] = row
            free[j] = j + 1
    lost = np.flatnonzero(~interval & ~has)
    lost = lost[np.unique(group[lost], return_index=True)[1]]
    return np.concatenate([rows, lost]), np.concatenate([np.array(taken, np.int64), np.full(len(lost), -1, np.int64)])
