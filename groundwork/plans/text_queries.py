"""Registered queries over texts, with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundwork.operators import text as T


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.tokens(_docs(spark, sf_dir))


def _search(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = T.tokens(spark.read.parquet(f"{sf_dir}/benchmark.parquet"), "item_id")
    return T.search(T.forms(_docs(spark, sf_dir)), items.select(F.col("doc").alias("query"), "form"))


def _fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.budget_fold(_search(spark, sf_dir), _docs(spark, sf_dir).select(F.col("doc_id").alias("doc"), "n_chars"))


def _micro(df: DataFrame) -> DataFrame:
    return df.withColumn("microbits", F.round("microbits", 3))


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of the turns of conversations, a text each."""
    return T.tokens(spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.struct("conv_id", "turn").alias("id"), "text"), "id")


def _loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _turns(spark, sf_dir)
    belief = T.continuations(t.filter("doc.turn < 2"))
    return T.sequence_loss(t.filter("doc.turn >= 2"), belief, 1e-5).select("doc.*", "n", F.round("loss", 6).alias("loss"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "token_counts": lambda spark, sf_dir: T.frequencies(_tokens(spark, sf_dir)),
    "function_words": lambda spark, sf_dir: T.function_words(_tokens(spark, sf_dir)),
    "surprisal_chunks": lambda spark, sf_dir: _micro(T.surprisal_chunks(_tokens(spark, sf_dir))),
    "causal_surprisal": lambda spark, sf_dir: _micro(T.causal_surprisal(_tokens(spark, sf_dir))),
    "trigram_profile": lambda spark, sf_dir: T.ngrams(spark.read.parquet(f"{sf_dir}/benchmark.parquet"), 3, "item_id"),
    "chunk_spans": lambda spark, sf_dir: T.chunk_spans(_docs(spark, sf_dir)),
    "search_spans": _search,
    "frequency_bands": lambda spark, sf_dir: T.frequency_bands(_tokens(spark, sf_dir), 5, 500),
    "first_recurrence": lambda spark, sf_dir: T.first_recurrence(_tokens(spark, sf_dir)),
    "continuations": lambda spark, sf_dir: T.continuations(_turns(spark, sf_dir)).withColumn("p", F.round("p", 9)),
    "sequence_loss": _loss,
    "budget_fold": _fold,
}

_T = r"""t AS (SELECT doc, pos - 1 AS pos, w[pos] AS form FROM (SELECT doc, w, unnest(generate_series(1, len(w))) AS pos FROM (SELECT doc_id AS doc, regexp_extract_all(lower(text), '[\p{L}\p{N}'']+') AS w FROM documents)))"""
_C = "c AS (SELECT doc, pos // 40 AS chunk, form, count(*) AS n FROM t JOIN (SELECT doc, count(*) // 40 AS full_chunks FROM t GROUP BY doc) USING (doc) WHERE pos // 40 < full_chunks GROUP BY doc, pos // 40, form)"
_S = r"""q AS (SELECT DISTINCT item_id AS query, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}'']+')) AS form FROM benchmark),
h AS (SELECT DISTINCT doc, form FROM t WHERE form IN (SELECT form FROM q)),
i AS (SELECT form, ln(((SELECT count(DISTINCT doc) FROM t) + 1) / (count(*) + 1)) AS idf FROM h GROUP BY form),
r AS (SELECT query, doc, round(sum(idf), 9) AS score FROM h JOIN q USING (form) JOIN i USING (form) GROUP BY query, doc),
k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM r QUALIFY rank <= 10)"""

_U = _T.replace("doc_id AS doc", "{'conv_id': conv_id, 'turn': turn} AS doc").replace("FROM documents", "FROM conversations")
_BELIEF = "SELECT context, form, n, (n + 1) / (sum(n) OVER (PARTITION BY context) + (SELECT count(DISTINCT form) FROM {0})) AS p FROM (SELECT context, form, count(*) AS n FROM (SELECT form, lag(form) OVER (PARTITION BY doc ORDER BY pos) AS context FROM {0}) WHERE context IS NOT NULL GROUP BY ALL)"

ORACLE_SQL: dict[str, str] = {
    "token_counts": f"WITH {_T} SELECT form, count(*) AS n FROM t GROUP BY form",
    "function_words": f"WITH {_T} SELECT form, count(*) AS n FROM t GROUP BY form HAVING count(*) / (SELECT count(*) FROM t) >= 0.006",
    "surprisal_chunks": f"WITH {_T}, {_C}, f AS (SELECT doc, form, count(*) AS c, sum(count(*)) OVER (PARTITION BY doc) AS total FROM t GROUP BY doc, form) SELECT doc, chunk, round(sum(n * -log2((c + 1) / (total + 1))) / 40 * 1e6, 3) AS microbits FROM c JOIN f USING (doc, form) GROUP BY doc, chunk",
    "causal_surprisal": f"""WITH {_T}, {_C}, e AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY doc, form ORDER BY chunk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c FROM c)
SELECT doc, chunk, round(sum(n * CASE WHEN chunk = 0 THEN -log2(n / 40) ELSE -log2((c + 1) / (chunk * 40 + 1)) END) / 40 * 1e6, 3) AS microbits FROM e GROUP BY doc, chunk""",
    "frequency_bands": f"WITH {_T} SELECT form, count(*) AS n, CASE WHEN count(*) < 5 THEN 'rare' WHEN count(*) > 500 THEN 'function' ELSE 'content' END AS band FROM t GROUP BY form",
    "first_recurrence": f"WITH {_T} SELECT doc, form, first, pos AS again FROM (SELECT *, row_number() OVER w AS k, first_value(pos) OVER w AS first FROM t WINDOW w AS (PARTITION BY doc, form ORDER BY pos)) WHERE k = 2 QUALIFY row_number() OVER (PARTITION BY doc ORDER BY pos) = 1",
    "continuations": f"WITH {_U} SELECT context, form, n, round(p, 9) AS p FROM ({_BELIEF.format('t')})",
    "sequence_loss": f"""WITH {_U}, early AS (SELECT * FROM t WHERE doc.turn < 2), b AS ({_BELIEF.format('early')})
SELECT doc.conv_id AS conv_id, doc.turn AS turn, count(*) AS n, round(sum(-ln(coalesce(p, 1e-5))), 6) AS loss FROM (SELECT doc, form, lag(form) OVER (PARTITION BY doc ORDER BY pos) AS context FROM t WHERE doc.turn >= 2) s LEFT JOIN b USING (context, form) WHERE s.context IS NOT NULL GROUP BY doc""",
    "trigram_profile": "SELECT doc, gram, count(*) AS n FROM (SELECT item_id AS doc, unnest(list_transform(generate_series(1, length(text) - 2), lambda i: substring(lower(text), i, 3))) AS gram FROM benchmark WHERE length(text) >= 3) GROUP BY doc, gram",
    "chunk_spans": """SELECT doc, hash, min(start) AS start, max(strlen(part)) AS bytes FROM (
  SELECT doc, strlen(substring(text, 1, k * 2000)) AS start, substring(text, k * 2000 + 1, 2000) AS part, md5(substring(text, k * 2000 + 1, 2000)) AS hash
  FROM (SELECT doc_id AS doc, text, unnest(generate_series(0, greatest(length(text) - 1, 0) // 2000)) AS k FROM documents))
WHERE length(regexp_replace(part, '[ \\t\\n\\r]', '', 'g')) >= 20 GROUP BY doc, hash""",
    "search_spans": f"WITH {_T}, {_S} SELECT query, doc, score, rank FROM k",
    "budget_fold": f"WITH {_T}, {_S} SELECT * FROM (SELECT query, doc, rank, sum(CAST(ceil(n_chars / 4) AS BIGINT)) OVER (PARTITION BY query ORDER BY rank) AS spent FROM k JOIN documents ON doc_id = doc) WHERE spent <= 2400 AND rank <= 16",
}
