"""Sentences by a plain splitter, offsets that cut the text, and the innermost of nested intervals."""

import random
import re

import pytest
from pyspark.sql import functions as F

from groundwork.operators import spans as S

TEXTS = [
    "Mr. Darcy came. Mr. Bingley left! Did he? \"Yes.\" He did.",
    "One 3.14 two. Three...  Four\n\nFive without end\n \n\nSix? (Seven!) e. g. Mr.\n\nNext. Mr.",
    "", " \n\t ", None, "no end at all", "A.\r\nB.\rC. Mr\n\n", "M. a M. b M. c. ok", "x." * 40, "é. É. ü. naïve. 日本。 ok.", "Ends here.»\n\n\n»Open",
    "He saw Dr. Who. Dr. No met Dr. Yes. " * 30 + "it is an ox in a box. " * 20,
]
WORD = re.compile(r"[^\W\d_]+")


def _abbreviations(text):
    found, lengths = {}, []
    for m in re.finditer(r"([^\W\d_]+)(\.?)", text):
        n, dotted = found.get(m[1], (0, 0))
        found[m[1]] = (n + 1, dotted + (m[2] == "."))
        lengths.append(len(m[1]))
    if not lengths:
        return set()
    bar = sorted(lengths)[int(len(lengths) * 0.1)]
    return {t for t, (n, d) in found.items() if d == n >= 2 and len(t) <= bar}


def _sentences(text, known=None):
    s = text.replace("\r\n", "\n").replace("\r", "\n")
    known = _abbreviations(s) if known is None else known
    bounds, at = [], 0
    for m in re.finditer(r"\n\s*\n+", s):
        bounds.append((at, m.start()))
        at = m.end()
    out = []
    for low, high in [*bounds, (at, len(s))]:
        start = low

        def push(a, b):
            if body := s[a:b].strip():
                out.append((a + len(s[a:b]) - len(s[a:b].lstrip()), body))

        for i in range(low, high):
            if s[i] not in S.TERMINATORS:
                continue
            end = i + 1
            while end < high and s[end] in S.CLOSERS:
                end += 1
            if end < high and not s[end].isspace():
                continue
            j = i
            while j > low and WORD.fullmatch(s[j - 1]):
                j -= 1
            if s[i] == "." and s[j:i] in known and j < i:
                continue
            push(start, end)
            start = end
        push(start, high)
    return out


@pytest.mark.parametrize("known", [None, ["Mr", "Dr"]])
def test_sentences_against_a_plain_splitter(spark, known):
    r = random.Random(4)
    made = ["".join(r.choice(["a", "B", "Mr", ".", ".", "!", "?", " ", " ", "\n", "\n\n", '"', ")", "3"]) for _ in range(r.randint(0, 80))) for _ in range(300)]
    texts = [*TEXTS, *made]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("order", F.lit(9))
    names = None if known is None else spark.createDataFrame([(k,) for k in known], "token string")
    got = {}
    for x in S.sentences(df, names).orderBy("doc", "order").collect():
        assert x.order == len(got.setdefault(x.doc, []))
        got[x.doc].append((x.start, x.sentence))
    for i, text in enumerate(texts):
        assert got.get(i, []) == _sentences(text or "", None if known is None else set(known)), text
        s = (text or "").replace("\r\n", "\n").replace("\r", "\n")
        assert all(s[a : a + len(b)] == b for a, b in got.get(i, []))


def test_abbreviations_of_each_text(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = {}
    for x in S.abbreviations(df).collect():
        got.setdefault(x.doc, set()).add(x.token)
    assert got == {i: a for i, t in enumerate(TEXTS) if (a := _abbreviations((t or "").replace("\r", "\n")))}


def test_innermost_of_nested_intervals(spark):
    r = random.Random(7)
    spans = [(g, i, lo := r.randint(-50, 200), lo + r.choice([0, 1, 2, 5, 30, 100])) for g in (1, 2) for i in range(40)] + [(1, 99, -10, 10**11), (3, 7, 5, 6), (3, 3, 5, 6), (None, 1, 0, 9)]
    points = [(g, p) for g in (1, 2, 3, 4) for p in range(-60, 320, 3)] + [(1, 10**10), (3, 5), (3, 5), (3, 6)]
    got = {(x.g, x.at): x.id for x in S.innermost(spark.createDataFrame(points, "g int, at long"), spark.createDataFrame(spans, "g int, id int, lo long, hi long"), ["g"]).collect()}
    for g, p in points:
        held = [(hi - lo, -lo, i) for k, i, lo, hi in spans if k == g and lo <= p < hi]
        assert got[g, p] == (min(held)[2] if held else None)
    assert len(got) == len(set(points))


def test_plan_has_no_range_join(spark, capsys):
    pts, ivs = spark.createDataFrame([(1, 1)], "g int, at long"), spark.createDataFrame([(1, 1, 0, 9)], "g int, id int, lo long, hi long")
    S.innermost(pts, ivs, ["g"]).explain()
    plan = capsys.readouterr().out
    assert "NestedLoop" not in plan and "Cartesian" not in plan
