"""Series and texts from files; every reader goes through Spark's own sources, so any file system that Spark knows will do."""

from __future__ import annotations

import io
import wave
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SERIES = "path string, i long, v double"
_ROWS = 65_536


def texts(spark: SparkSession, path: str) -> DataFrame:
    """path, text: a row for each file."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def csv_series(spark: SparkSession, path: str, column: str) -> DataFrame:
    """path, v of a column of quoted, multi-line CSV with a header; what is no number is null (an empty cell too)."""
    rows = spark.read.csv(path, header=True, multiLine=True, escape='"')
    return rows.select(F.input_file_name().alias("path"), F.col(column).try_cast("double").alias("v"))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def _binary(spark: SparkSession, path: str, parse: Callable[[bytes], np.ndarray]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                v = parse(content.as_py()).astype(np.float64).ravel()
                for lo in range(0, len(v), _ROWS):
                    part = v[lo : lo + _ROWS]
                    yield pa.RecordBatch.from_arrays([pa.array([name.as_py()] * len(part)), pa.array(np.arange(lo, lo + len(part))), pa.array(part)], ["path", "i", "v"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, _SERIES)


def npy_series(spark: SparkSession, path: str) -> DataFrame:
    """path, i, v of NumPy array files, in C order."""
    return _binary(spark, path, lambda b: np.load(io.BytesIO(b), allow_pickle=False))


def _wav(data: bytes) -> np.ndarray:
    with wave.open(io.BytesIO(data)) as w:
        width, channels, raw = w.getsampwidth(), w.getnchannels(), w.readframes(w.getnframes())
    if width == 1:
        x = (np.frombuffer(raw, np.uint8).astype(np.float64) - 128) / 128
    elif width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] << 8 | b[:, 1] << 16 | b[:, 2] << 24) >> 8) / float(1 << 23)
    else:
        x = np.frombuffer(raw, f"<i{width}") / float(1 << (8 * width - 1))
    return x.reshape(-1, channels).mean(axis=1)


def wav_series(spark: SparkSession, path: str) -> DataFrame:
    """path, i, v of PCM sound files: the mean of the channels, from -1 to 1."""
    return _binary(spark, path, _wav)


def pajek_edges(spark: SparkSession, path: str) -> DataFrame:
    """path, source, target, weight of Pajek network files, whose edges follow a line *Edges or *Arcs."""
    lines = texts(spark, path).select("path", F.split("text", r"(?i)\*(?:edges|arcs)[^\n]*\n").alias("p"))
    names = lines.select("path", F.explode(F.regexp_extract_all(F.col("p")[0], F.lit(r'(\d+ +"[^"]*")'), F.lit(1))).alias("x"))
    names = names.select("path", F.regexp_extract("x", r"^(\d+)", 1).alias("k"), F.regexp_extract("x", r'"([^"]*)"', 1).alias("name"))
    edges = lines.select("path", F.explode(F.split(F.array_join(F.slice("p", F.lit(2), F.greatest(F.size("p") - 1, F.lit(0))), "\n"), "\n")).alias("x")).select("path", F.split(F.trim("x"), r"\s+").alias("e")).filter(F.size("e") >= 2)
    edges = edges.select("path", F.col("e")[0].alias("s"), F.col("e")[1].alias("t"), F.coalesce(F.try_element_at("e", F.lit(3)).try_cast("double"), F.lit(1.0)).alias("weight"))
    a = names.select("path", F.col("k").alias("s"), F.col("name").alias("source"))
    b = names.select("path", F.col("k").alias("t"), F.col("name").alias("target"))
    return edges.join(a, ["path", "s"]).join(b, ["path", "t"]).select("path", "source", "target", "weight")
