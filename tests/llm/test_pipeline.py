"""The pipeline's stages on a small table, each against what it should keep."""

import re

import corpus_pipeline
from groundwork.llm import pii, queries, toxicity
from pyspark.sql import functions as F

from tests.llm.test_operators import _brute_components, _brute_leaks


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == columns
        n, before = out.count(), docs.count()
        assert 0 < n <= before and out.select("doc_id").distinct().count() == n
        if name == "near_duplicates":
            from groundwork.llm.jaccard import jaccard_components

            left = jaccard_components(out)
            assert left.filter("component_id <> doc_id").count() == 0 and n < before
        if name in ("personal_data", "tokens"):
            assert n == before
        if name == "tokens":
            assert out.filter("not exact").count() == 0
        docs = out.checkpoint()


def test_stage_functions_on_an_empty_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").filter(F.lit(False))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0


def _plainly_masked(text):
    """The text with its base spans replaced, by the patterns themselves."""
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(?:\.[0-9]+){3}", "card": r"[0-9](?:[ -]?[0-9])+", "phone": r"\+[0-9][ ().0-9-]+[0-9]"}
    spans = []
    for kind, p in patterns.items():
        for m in re.finditer(p, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")) or kind == "card" and 16 <= len(digits) <= 19 and pii.luhn(digits) or kind == "phone" and 8 <= len(digits) <= 15:
                spans.append((*m.span(), kind))
    out, at = "", 0
    for a, b, kind in sorted(spans):
        out += text[at:a] + f"[{kind.upper()}]" if a >= at else ""
        at = max(at, b)
    return out + text[at:]


def test_stages_keep_what_plain_versions_keep(spark, sf_dir):
    docs = queries.table(spark, sf_dir, "documents").cache()
    texts = {r.doc_id: r.text for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)
    kept = lambda name: {r.doc_id for r in stages[name](spark, docs, sf_dir).select("doc_id").collect()}

    assert kept("near_duplicates") == {d for d, _, least in _brute_components(list(texts.items())) if d == least} < set(texts)

    items = [(str(r.item_id), r.text) for r in queries.table(spark, sf_dir, "benchmark").collect()]
    assert kept("benchmark_leaks") == {r[0] for r in _brute_leaks(list(texts.items()), items) if not r[-1]} < set(texts)

    added = {r.doc_id: r.n_added for r in pii.find(docs).select("doc_id", "pii.n_added").collect()}
    plain = {d for d, n in added.items() if n == 0}
    masked = {r.doc_id: r for r in stages["personal_data"](spark, docs, sf_dir).collect()}
    assert len(plain) > 0.8 * len(texts) and any(masked[d].text != texts[d] for d in plain)
    for d, r in masked.items():
        assert d not in plain or r.text == _plainly_masked(texts[d]) and r.n_chars == len(r.text)
        assert not pii.base_spans(r.text)


def test_toxicity_stage_keeps_what_scores_under_the_threshold(spark, tmp_path):
    rows = [(i, f"word{i % 7} other{i % 11} more{i % 5}" + " vilest" * (i % 5 == 0), int(i % 5 == 0)) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    docs.select("doc_id", "toxic").write.parquet(f"{tmp_path}/labels.parquet")
    docs = docs.drop("toxic")
    model = queries.learn_toxicity(spark, docs, queries.table(spark, str(tmp_path), "labels"))
    low = {r.doc_id for r in toxicity.score(docs, model).collect() if r.score < toxicity.THRESHOLD}
    got = {r.doc_id for r in dict(corpus_pipeline.STAGES)["toxicity"](spark, docs, str(tmp_path)).collect()}
    assert got == low == {i for i, _, toxic in rows if not toxic}
