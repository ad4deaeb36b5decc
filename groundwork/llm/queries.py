"""The registered queries of this subpackage: whole tables, production parameters, full results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import anchors, bpe, decontaminate, html, jaccard, language, manifest, media, periods, pii, substrings, toxicity, warc
from .store import ready

#: Where the public tokenizer's file lies; another place can be named in the session.
VOCABULARY_CONF = "groundwork.vocabulary"


def vocabulary(spark: SparkSession) -> str:
    if path := spark.conf.get(VOCABULARY_CONF, ""):
        return path
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ready(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.find(docs).select("doc_id", "pii.*")


def learn_toxicity(spark: SparkSession, docs: DataFrame, labels: DataFrame):
    """A classifier of the labelled documents that learning may see."""
    return toxicity.fit(docs, labels.filter(~language.held_out(F.col("doc_id"))))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = learn_toxicity(spark, docs, table(spark, sf_dir, "labels"))
    out = toxicity.score(docs, model)
    return out.select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", language.held_out(F.col("doc_id")))
    # a tenth of what may be learnt from is kept out of the model: its entropies set the limits of rejection
    docs = docs.withColumn("measured", ~F.col("held_out") & (F.pmod(F.xxhash64("doc_id"), F.lit(10)) == 0))
    model = language.train(docs.filter("not held_out and not measured"))
    seen = language.gathered(language.identify(docs, model).drop("text").hint("rebalance"), "identified")
    out = language.reject(seen, language.entropy_limits(seen.filter("measured and lang = language.lang")))
    return out.select("doc_id", "held_out", F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"), F.col("language.nats").alias("nats"), "rejected")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.round_trip(docs, vocabulary(spark)).select("doc_id", "bpe.*")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = warc.round_trip(table(spark, sf_dir, "pages"))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "main.*")


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = media.with_media(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return media.digests(media.read_media(docs)).drop("text", "media", "read")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", *(F.col(f"leak.{c}").alias(c) for c in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")))


def _repeating(docs: DataFrame) -> DataFrame:
    """Where crc32(doc_id) % 10 is 0, the words from one on repeat with a period; both derive from the id. Other texts stay."""
    docs = docs.withColumn("_h", F.crc32(F.col("doc_id").cast("string").cast("binary"))).withColumn("_w", F.when(F.col("_h") % 10 == 0, F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda x: x != "")))
    docs = docs.withColumn("_n", F.size("_w")).withColumn("_a", F.expr("if(_n > 0, (_h div 10) % _n, 0)")).withColumn("_p", F.expr("1 + (_n - _a) div (3 + (_h div 10) % 8)"))
    said = F.expr("array_join(slice(concat(slice(_w, 1, int(_a)), flatten(array_repeat(slice(_w, int(_a) + 1, int(_p)), int((_n - _a) div _p + 1)))), 1, _n), ' ')")
    return docs.select("doc_id", F.when(F.col("_n") > 0, said).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _repeating(table(spark, sf_dir, "documents"))
    return periods.digests(periods.find(docs)).drop("text")


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    first = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    changed = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(F.col("text"))
    made = manifest.build(docs, manifest.leaf(*first, F.col("text")), claim=manifest.leaf(*first, changed))
    return manifest.prove(made).withColumnRenamed("id", "doc_id").drop("proof")


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anchors.remove_windows(table(spark, sf_dir, "documents")).drop("kept")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii,
    "op2_toxicity": op2_toxicity,
    "op3_language_id": op3_language_id,
    "op4_bpe": op4_bpe,
    "op5_warc": op5_warc,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_ngram_jaccard": op7_ngram_jaccard,
    "op8_html": op8_html,
    "op9_media": op9_media,
    "op10_decontaminate": op10_decontaminate,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_manifest": op12_manifest,
    "op13_substring_dedup": op13_substring_dedup,
}

ORACLE_SQL: dict[str, str] = {
    "op5_warc": """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS hex, coalesce(html, '') AS h FROM pages
), s AS (SELECT page_id, payload_bytes, h, max(page_id) OVER (PARTITION BY h) AS last, list_transform(generate_series(0, 31), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(hex, 10 * (i // 8) + 1, 10) AS BIGINT) >> (35 - 5 * (i % 8))) & 31 AS INTEGER) + 1, 1)) AS letters FROM p)
SELECT page_id, payload_bytes, array_to_string(letters, '') AS payload_digest, CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> last THEN last END AS refers_to FROM s
""",
    "op7_ngram_jaccard": r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i FROM words WHERE len(w) > 0)
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id
), links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)
), ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach(doc_id, root) AS (
  SELECT doc_id, doc_id FROM words UNION SELECT ways.b, reach.root FROM reach JOIN ways ON reach.doc_id = ways.a
)
SELECT words.doc_id, coalesce(any_value(n), 0) AS n_shingles, min(root) AS component_id
FROM words LEFT JOIN sizes USING (doc_id) JOIN reach ON reach.doc_id = words.doc_id GROUP BY words.doc_id
""",
    "op10_decontaminate": r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), items AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), sized AS (
  SELECT item, w, least(len(w), 10) AS size FROM items WHERE len(w) > 0
), windows AS (
  SELECT DISTINCT item, size, array_to_string(w[i:i + size - 1], ' ') AS said
  FROM (SELECT item, w, size, unnest(generate_series(1, len(w) - size + 1)) AS i FROM sized)
), sizes AS (SELECT DISTINCT size FROM windows
), seen AS (
  SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS said
  FROM (SELECT doc_id, w, size, unnest(generate_series(1, len(w) - size + 1)) AS i FROM words, sizes WHERE len(w) >= size)
), hits AS (
  SELECT s.doc_id, s.i, s.size, item FROM seen s JOIN windows v ON s.size = v.size AND s.said = v.said
), covered AS (
  SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(generate_series(i, i + size - 1)) AS j FROM hits) GROUP BY doc_id
), found AS (
  SELECT doc_id, count(DISTINCT item) AS n_items, sha256(string_agg(DISTINCT item, ',' ORDER BY item)) AS ids FROM hits GROUP BY doc_id
)
SELECT words.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  coalesce(ids, sha256('')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM words LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)
""",
    "op12_manifest": """
WITH RECURSIVE said AS (
  SELECT doc_id, source, list_transform([CAST(doc_id AS VARCHAR), source, lang, CAST(n_chars AS VARCHAR)], lambda v: coalesce(octet_length(encode(v)) || ':' || v, '-')) AS v,
    text, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda x, y:
      list_reduce(list_prepend(xor(x, y), generate_series(1::BIGINT, 8::BIGINT)), lambda p, q: CASE WHEN p & 1 = 1 THEN xor(p >> 1, 3988292384) ELSE p >> 1 END)) AS crc
  FROM documents
), changed AS (SELECT *, CASE WHEN xor(crc, 4294967295) % 5 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS other FROM said
), hashed AS (
  SELECT doc_id, source, sha256(array_to_string(v, '') || coalesce(octet_length(encode(text)) || ':' || text, '-')) AS leaf,
    sha256(array_to_string(v, '') || coalesce(octet_length(encode(other)) || ':' || other, '-')) AS claim FROM changed
), leaves AS (
  SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i,
    count(*) OVER (PARTITION BY source) AS size FROM hashed
), nodes(tree, level, i, size, digest) AS (
  SELECT tree, 0, i, size, leaf FROM leaves
  UNION ALL
  SELECT tree, max(level) + 1, i // 16, (max(size) + 15) // 16, sha256(string_agg(digest, '' ORDER BY i)) FROM nodes WHERE size > 1 GROUP BY tree, i // 16
), subroots AS (SELECT tree, digest, level FROM nodes WHERE size = 1
), above(tree, level, i, size, digest) AS (
  SELECT -1, 0, tree, count(*) OVER (), digest FROM subroots
  UNION ALL
  SELECT tree, max(level) + 1, i // 16, (max(size) + 15) // 16, sha256(string_agg(digest, '' ORDER BY i)) FROM above WHERE size > 1 GROUP BY tree, i // 16
), every AS (SELECT * FROM nodes UNION ALL SELECT * FROM above
), beside AS (
  SELECT a.tree, a.level, a.i, coalesce(string_agg(b.digest, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS l, coalesce(string_agg(b.digest, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS r
  FROM every a JOIN every b ON a.tree = b.tree AND a.level = b.level AND a.i // 16 = b.i // 16 WHERE a.size > 1 GROUP BY a.tree, a.level, a.i
), fold(doc_id, source, home, leaf, subroot, tree, level, i, folded, proof) AS (
  SELECT doc_id, source, l.tree, leaf, s.digest, l.tree, 0, l.i, claim, '' FROM leaves l JOIN subroots s ON s.tree = l.tree
  UNION ALL
  SELECT f.doc_id, f.source, f.home, f.leaf, f.subroot, CASE WHEN b.tree IS NULL THEN -1 ELSE f.tree END, CASE WHEN b.tree IS NULL THEN 0 ELSE f.level + 1 END,
    CASE WHEN b.tree IS NULL THEN f.home ELSE f.i // 16 END, CASE WHEN b.tree IS NULL THEN f.folded ELSE sha256(b.l || f.folded || b.r) END, f.proof || coalesce(b.l || b.r, '')
  FROM fold f LEFT JOIN beside b ON b.tree = f.tree AND b.level = f.level AND b.i = f.i WHERE f.tree >= 0 OR b.tree IS NOT NULL
), root AS (SELECT digest AS root, level FROM above WHERE size = 1)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = root AS verified FROM fold JOIN root ON fold.tree = -1 AND fold.level = root.level
""",
    "op13_substring_dedup": r"""
WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT doc_id, i, hash(array_to_string(w[i:i + 34], ' ')) AS x, md5(array_to_string(w[i:i + 34], ' ')) AS y
  FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 34)) AS i FROM words WHERE len(w) >= 35)
), repeated AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY x, y) > 1
), gone AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 34)) AS j FROM repeated
), each AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS j FROM words
), kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY j) AS text FROM each ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id)
SELECT words.doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM words LEFT JOIN kept USING (doc_id)
""",
}
