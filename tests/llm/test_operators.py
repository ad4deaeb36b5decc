"""The operators of the llm subpackage on small tables: brute force, round trips and edge cases."""

import base64
import hashlib
import pathlib
import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from groundwork.llm import bpe, decontaminate, html, jaccard, kernels, language, media, pii, queries, store, substrings, toxicity, warc
from groundwork.llm.store import ready

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
EDGES = [(1, None), (2, ""), (3, " \n\t"), (4, "word"), (5, "word"), (5, "word"), (None, "word"), (6, "é" * 3000), (7, "a b c d e f g h i j k l m"), (8, "A b c d e f g h i j k l M"), (9, "x" * 200_000), (10, "日本語 text <|endoftext|> ' '")]


@pytest.fixture(scope="module")
def edges(spark):
    ready(spark)
    return spark.createDataFrame([(d, t, 1, "own", "clash") for d, t in EDGES], "doc_id long, text string, d int, h string, t string")


@pytest.fixture(scope="module")
def empty(edges):
    return edges.filter("false")


def _texts(n, seed):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 6))) for _ in range(60)]
    out = []
    for i in range(n):
        if out and r.random() < 0.5:
            base = r.choice(out).split(" ")
            for _ in range(r.randint(0, 4)):
                base[r.randrange(len(base))] = r.choice(words)
            out.append(" ".join(base))
        else:
            out.append(" ".join(r.choice(words) for _ in range(r.randint(1, 120))))
    return out


# --- personal data


def test_pii_base_and_bootstrap(spark, edges, empty):
    rows = [(i, f"reach my phone line +1 555 010 {1000 + i} at once or reach my phone line 555010{1000 + i} at once") for i in range(9)]
    rows += [(20, "lot 12345678 is clean"), (21, "a@b.c 1.2.3.4 300.1.1.1 x 4111 1111 1111 1111")]
    out = {r.doc_id: r for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "pii.*").collect()}
    assert all(out[i].spans == "phone:20:35,phone:67:77" and out[i].n_added == 1 for i in range(9))
    assert out[20].spans == "" and out[21].spans == "email:0:5,ip:6:13,card:26:45"
    assert out[20].base_sha256 == hashlib.sha256(b"").hexdigest()
    masked = pii.redact(spark.createDataFrame(rows, "doc_id long, text string")).filter("doc_id = 3").first().text
    assert masked == "reach my phone line [PHONE] at once or reach my phone line [PHONE] at once"
    assert pii.find(edges).count() == len(EDGES) and pii.find(empty).count() == 0


def test_pii_base_spans_as_the_patterns_say():
    pattern = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "card": r"[0-9](?:[ -]?[0-9])+", "phone": r"\+[0-9][ ().0-9-]+[0-9]"}
    parts = ["a", "b.", "@", "x@y.z", "1", "2.", ".", "255", "256", "1.2.3.4", "4111111111111111", "-", " ", "+1", "+1 (569) 555-6633", "é", "@@", "(", ")"]
    r = random.Random(1)
    for _ in range(3000):
        text, want = "".join(r.choice(parts) for _ in range(r.randint(1, 12))), []
        for kind, p in pattern.items():
            for m in re.finditer(p, text):
                digits = re.sub("[^0-9]", "", m[0])
                if kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")) or kind == "card" and 16 <= len(digits) <= 19 and pii.luhn(digits) or kind == "phone" and 8 <= len(digits) <= 15:
                    want.append((kind, *m.span()))
        assert pii.base_spans(text) == want


# --- toxicity


def test_toxicity_learns_stems_and_spares_identity_terms(spark, edges, empty):
    r = random.Random(2)
    words = [f"word{chr(97 + i)}" for i in range(20)]
    rows = [(i, " ".join(r.choice(words) for _ in range(12)) + (" vilest" + r.choice("abcdef") if i % 5 == 0 else "") + (" muslims" if i % 5 == 0 and i % 2 == 0 else ""), int(i % 5 == 0)) for i in range(400)]
    t = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(t.select("doc_id", "text"), t.select("doc_id", "toxic"))
    probe = spark.createDataFrame([(1, "worda vilestz wordb"), (2, "worda wordb muslims"), (3, None), (4, "")], "doc_id long, text string")
    got = {x.doc_id: x.score for x in toxicity.score(probe, model).collect()}
    assert got[1] > 0.9 and got[3] == got[4]
    w = dict(zip(model.value.keys.tolist(), model.value.weights, strict=True))
    names = {n: int(toxicity._word_features([n])[0][0]) for n in ("muslims", "christians", "vilest")}
    assert abs(w.get(names["muslims"], 0.0) - w.get(names["christians"], 0.0)) < 0.5 and got[2] < 0.5
    assert toxicity.score(edges, model).count() == len(EDGES)
    none = toxicity.fit(empty.select("doc_id", "text"), t.select("doc_id", "toxic"))
    assert abs(toxicity.score(probe, none).first().score - 0.5) < 1e-9


# --- language


def test_language_and_rejection(spark, edges, empty):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("the and with this that for", "en"), ("der und mit das ist für", "de"), ("le et avec que pour dans", "fr")] * 30)]
    model = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    probe = spark.createDataFrame([(1, "That with THE"), (2, "für das und"), (3, None), (4, "123 ..."), (5, "pour que")], "doc_id long, text string")
    got = {r.doc_id: r.language for r in language.identify(probe, model).collect()}
    assert [got[i].lang for i in (1, 2, 3, 4, 5)] == ["en", "de", "und", "und", "fr"] and got[3].score == 0.0 and all(0 <= g.score <= 1 for g in got.values())
    assert language.identify(edges, model).count() == len(EDGES)
    none = language.train(empty.select("text", F.lit("x").alias("lang")))
    assert {r.language.lang for r in language.identify(probe, none).collect()} == {"und"}


def test_language_probabilities_sum_to_one(spark):
    model = language.train(spark.createDataFrame([("abab abba baab",)] * 3, "text string").withColumn("lang", F.lit("x"))).value
    ends = np.array([[ord("a")], [ord("b")], [language._END]], dtype=np.uint32)
    for context in ("\x02\x02\x02\x02", "\x02\x02\x02a", "abab", "bbbb"):
        text = np.hstack([np.tile(np.frombuffer(context.encode("utf-32-le"), np.uint32), (3, 1)), ends])
        assert 0.8 < float(np.exp(model._look(5, text)).sum()) <= 1.0001


def test_language_keeps_rare_grams(spark):
    counts = spark.createDataFrame([("x", "abcde", 50_000_000), ("x", "abcdf", 1), ("x", "bcdef", 1), ("y", "abcde", 1)], "lang string, gram string, n long")
    grams, contexts = (t.collect() for t in language.statistics(counts))
    assert {(r.lang, r.gram) for r in grams if r.k == 5} == {("x", "abcde"), ("x", "abcdf"), ("x", "bcdef"), ("y", "abcde")}
    for c in contexts:  # what the grams of a context have and what it leaves add up to one, but for what discounts over 1 would take
        assert sum(g.own for g in grams if (g.k, g.lang, g.gram[:-1]) == (c.k, c.lang, c.h)) + c.bow == pytest.approx(1)


def test_language_blocks_equal_the_whole_model(spark, edges):
    r = random.Random(5)
    rows = [(i, " ".join("".join(r.choice("abcdé" if i % 2 else "abxyz") for _ in range(r.randint(1, 8))) for _ in range(r.randint(0, 20))), "en" if i % 2 else "de") for i in range(60)]
    df = spark.createDataFrame(rows + rows[:5] + [(100, None, None), (101, "", None), (102, "zzzz qéqa", None)], "doc_id long, text string, lang string")
    model = language.train(df.filter("doc_id < 30"))
    one = sorted((x.doc_id, *x.language) for x in language.identify(df, model).collect())
    for cells in (700, 200):
        for a, b in zip(one, sorted((x.doc_id, *x.language) for x in language.identify(df, model, cells=cells).collect()), strict=True):
            assert a[:2] == b[:2] and a[2:] == pytest.approx(b[2:], rel=1e-5)
    whole = model.value
    for r in model.probabilities(language.grams_of(df, "text")).collect():
        assert np.allclose(np.log(r.p), whole._look(5, np.frombuffer(r.gram.encode("utf-32-le"), np.uint32)[None])[0], atol=1e-4)


def test_language_writes_few_files(spark, tmp_path):
    rows = [(i, f"{'the and with this' if i % 2 else 'der und mit das'} {i}", "en" if i % 2 else "de", "web", 9) for i in range(400)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(12).write.parquet(f"{tmp_path}/documents.parquet")
    shared = lambda: {p for p in pathlib.Path(store.shared_dir(spark).removeprefix("file:")).iterdir() if p.is_dir()}
    before = shared()
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", 9)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    out = {r.doc_id: r.lang_pred for r in queries.op3_language_id(spark, str(tmp_path)).collect()}
    assert out == {i: lang for i, _, lang, _, _ in rows}
    for k, v in kept.items():
        spark.conf.set(k, v)
    files = {p.name: len(list(p.glob("part-*.parquet"))) for p in shared() - before}
    assert len(files) <= 7 and max(files.values()) <= spark.sparkContext.defaultParallelism, files


# --- BPE


def test_bpe_equals_the_library(spark, edges, empty):
    tokenizers = pytest.importorskip("tokenizers")
    path = queries.vocabulary(spark)
    t = tokenizers.Tokenizer.from_file(path)
    r = random.Random(3)
    parts = ["a", "the", "'", "s", "'ll", " ", "  ", "\n", "\t", "é", "1", "!", "<|endoftext|>", "<|end", "日本", "😀", "²", "\x1c", "\x85", "don't", "　", "x" * 70, "-" * 80]
    rows = [(i, "".join(r.choice(parts) for _ in range(r.randint(0, 30)))) for i in range(400)] + [(1000 + i, x) for i, (_, x) in enumerate(EDGES)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for x in bpe.decode(bpe.encode(df, path), path).collect():
        assert x.ids == t.encode(x.text or "", add_special_tokens=False).ids and x.decoded == (x.text or "")
    for x in bpe.round_trip(df, path).collect():
        ids = t.encode(x.text or "", add_special_tokens=False).ids
        assert x.bpe.n_tokens == len(ids) and x.bpe.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    assert bpe.round_trip(edges, path).count() == len(EDGES) and bpe.round_trip(empty, path).count() == 0


# --- WARC


def test_warc_revisits(spark):
    ready(spark)
    rows = [(1, "u\r\n x%20", "<p>a</p>"), (2, None, "<p>a</p>"), (None, "v", "<p>a</p>"), (3, "w", None), (4, "w", ""), (5, "z", "x\r\n\r\nWARC/1.1\r\nfoo: 1\r\n\r\ny\r\n\r\n"), (2, None, "<p>a</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    back = warc.round_trip(pages)
    got = sorted(((r.page_id or 0, r.url, r.record_type, r.refers_to, r.payload_bytes) for r in back.collect()), key=str)
    want = [(1, "u\r\n x%20", "revisit", 2, 8), (2, None, "revisit", 2, 8), (2, None, "response", None, 8), (0, "v", "revisit", 2, 8), (3, "w", "revisit", 4, 0), (4, "w", "response", None, 0), (5, "z", "response", None, 30)]
    assert got == sorted(want, key=str) and all(r.intact for r in back.collect())
    whole = {(r.page_id, r.url): r.payload for r in warc.resolve(back).collect()}
    assert whole[(1, "u\r\n x%20")] == b"<p>a</p>" and whole[(5, "z")].decode() == rows[5][2]
    assert {r.payload_digest for r in back.filter("page_id = 5").collect()} == {base64.b32encode(hashlib.sha1(rows[5][2].encode()).digest()).decode()}
    assert warc.round_trip(pages.limit(0)).count() == 0
    data = b"WARC/1.1\r\nContent-Length: 99\r\n\r\nx\r\n\r\nWARC/1.1\r\nContent-Length: 1\r\n\r\ny\r\n\r\n"
    assert [b for _, b in warc.records(data)] == [b"y"]


# --- repeated byte strings

#: No length of it repeats three times in a row; it and its complement have equal polynomial hashes modulo 2**64.
_TURNS = "".join("ab"[bin(i).count("1") & 1] for i in range(4096))


def _brute_repeats(rows):
    first = {}
    for d, t in rows:
        if d is not None:
            b = (t or "").encode()
            for k in range(len(b) - 49):
                first[b[k : k + 50]] = min(d, first.get(b[k : k + 50], d))
    for d, t in rows:
        b = (t or "").encode()
        mark = bytearray(len(b))
        for k in range(len(b) - 49 if d is not None else 0):
            if first[b[k : k + 50]] < d:
                mark[k : k + 50] = b"\1" * 50
        kept = bytes(c for c, m in zip(b, mark, strict=True) if not m)
        yield (d, len(b), sum(mark), len([x for x in bytes(mark).split(b"\0") if x]), hashlib.sha256(kept).hexdigest())


def test_repeated_strings_equal_brute_force(spark, empty):
    r = random.Random(5)
    texts = _texts(120, 4)
    rows = [(i // 2 * 2 if i % 7 == 0 else i, t) for i, t in enumerate(texts)] + [(d, t) for d, t in EDGES if d != 9] + [(500, "ab" * 200), (501, "ba" * 200), (502, texts[0] + texts[5] + texts[9])]
    r.shuffle(rows)
    got = substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).drop("kept").collect()
    assert sorted(map(tuple, got), key=str) == sorted(_brute_repeats(rows), key=str)
    assert substrings.remove_repeats(empty).count() == 0


def test_repeats_of_a_passage_that_every_text_has(spark, monkeypatch):
    monkeypatch.setattr(substrings, "HELD", 4_000)  # more blocks than partitions, so copies of the passage meet over blocks
    r = random.Random(8)
    passage = " ".join(r.choice(["one", "two", "three", "four"]) for _ in range(40))
    own = lambda: "".join(r.choice("abcdefgh ") for _ in range(r.randint(0, 300)))
    rows = [(i, own() + passage[: r.randint(60, len(passage))] + own()) for i in range(90)]
    rows += [(90 + i, _TURNS[i * 64 : i * 64 + 900]) for i in range(6)] + [(100, "x" * 3_000), (101, "x" * 2_000 + passage + "x" * 900), (102, None)]
    r.shuffle(rows)
    got = substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).drop("kept").collect()
    assert sorted(map(tuple, got), key=str) == sorted(_brute_repeats(rows), key=str)


def test_sorted_runs_are_in_byte_order():
    data = np.frombuffer(b"banana" * 20, np.uint8)
    at = np.arange(len(data) - 50)
    order, first = substrings.sorted_runs(data, at)
    said = [data[i : i + 50].tobytes() for i in at[order]]
    assert said == sorted(said) and len(first) == len(set(said))


# --- Jaccard


def _brute_components(rows):
    sets = []
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and rows[i][0] is not None and rows[j][0] is not None and 100 * len(a & b) >= 75 * len(a | b):
                up[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[top(i)] = min(d, least.get(top(i), d))
    return [(d, len(s), least[top(i)] if d is not None else None) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))]


def test_jaccard_equals_brute_force(spark, edges, empty):
    rows = [(i, t) for i, t in enumerate(_texts(160, 7))] + [(200 + (d or 0) if d else None, t) for d, t in EDGES]
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").withColumn("cls", F.lit(1))).collect()
    assert sorted(map(tuple, got), key=str) == sorted(_brute_components(rows), key=str)
    assert jaccard.jaccard_components(empty).count() == 0


def test_jaccard_chain_of_near_copies(spark):
    """Ends of a chain don't link to the pivot, but to each other's neighbours."""
    words = [f"w{i}" for i in range(200)]
    rows = []
    for k in range(12):
        w = words.copy()
        w[: 4 * k : 1] = [f"x{k}_{i}" if i >= 4 * (k - 1) else f"y{i}" for i in range(4 * k)]
        rows.append((k, " ".join(w)))
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=str) == sorted(_brute_components(rows), key=str)


# --- HTML


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (None, ""),
        ("", ""),
        ("<p></p>", ""),
        ("<html><body><nav><a href=x>Menu</a></nav><article><h1>T &amp; U</h1><p>One  line,\nhere.</p><p>Two<b>bold</b> end.<div class='ad'>Buy, now.</div><ul><li>x<li>y</ul></article><footer>F</footer>", "T & U\nOne line, here.\nTwobold end.\nx\ny"),
        ("<body><div id=comments><p>Nice, really.</p></div><div class=post><script>var t='</p>';</script><p>Long first paragraph, with commas, and more.</p><p>Short.</p><form>Name</form></div></body>", "Long first paragraph, with commas, and more.\nShort."),
    ],
)
def test_html(page, want):
    assert html.main_text(page) == want


_LONG = "Long paragraph, with commas, and more of it, as texts have. " * 4
_SAID = _LONG.strip()


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f"<body><nav>Menu</nav><article><h1>Title</h1><p>Lede</p><div class=body>{f'<p>{_LONG}</p>' * 30}</div></article><footer>F</footer></body>", ["Title", "Lede", *[_SAID] * 30]),
        (f"<body><main><h1>Title</h1><article><div>{f'<p>{_LONG}</p>' * 30}</div></article><p>After.</p></main><footer>F</footer></body>", ["Title", *[_SAID] * 30, "After."]),
        (f"<body><article><section>{f'<p>{_LONG}</p>' * 38}</section><section><h2>Small</h2>{f'<p>{_LONG}</p>' * 2}</section><div class=related>More, here.</div></article></body>", [*[_SAID] * 38, "Small", *[_SAID] * 2]),
        (f"<body><nav>Menu</nav><div id=page><h1>Title</h1><p>Lede</p><div class=body>{f'<p>{_LONG}</p>' * 30}</div></div><footer>F</footer></body>", ["Title", "Lede", *[_SAID] * 30]),
        (f"<body><nav>Menu</nav><div id=page><section>{f'<p>{_LONG}</p>' * 38}</section><section>{f'<p>{_LONG}</p>' * 2}</section></div><footer>F</footer></body>", [_SAID] * 40),
    ],
)
def test_html_keeps_the_whole_article(page, want):
    assert html.main_text(page).split("\n") == want


def test_html_on_spark(spark):
    rows = [(1, None), (1, ""), (2, "<article><p>Hello, there.</p></article>"), (3, "<p>" + "word, " * 50_000 + "</p>")]
    got = html.extract(spark.createDataFrame(rows, "page_id long, html string")).select("page_id", "main.*").collect()
    assert sorted(r.n_chars for r in got) == [0, 0, 13, 299_999]


# --- media


def test_media_round_trip(spark, edges, empty):
    out = media.digests(media.read_media(media.with_media(edges.select("doc_id", "text")))).collect()
    for r in out:
        raw = (r.text or "").encode()
        padded = raw + bytes(-len(raw) % 64 if raw else 64)
        assert (r.n_bytes, r.payload_bytes, r.bad_pages) == (len(raw), len(padded), 0) and r.payload_sha256 == hashlib.sha256(padded).hexdigest()
    assert len(out) == len(EDGES) and media.with_media(empty).count() == 0


def test_ogg_packets_pages_and_damage():
    s = media.Stream(5, [(b"h", 0), (b"q" * 200_000, 1), (b"", 2), (b"z" * 65_025, 3), (b"x", 4)])
    data = media.mux([s, media.Stream(6, [(b"o", 0), (b"y" * 255, 9)])])
    streams, bad = media.demux(data)
    assert bad == 0 and [p for p, _ in streams[0].packets] == [p for p, _ in s.packets] and streams[1].packets[1] == (b"y" * 255, 9)
    hurt = bytearray(data)
    hurt[len(data) // 2] ^= 1
    streams, bad = media.demux(bytes(hurt))
    assert bad == 1 and b"q" * 200_000 not in [p for p, _ in streams[0].packets]


# --- decontamination


def _brute_leaks(docs, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    windows = {}
    for i, t in items:
        w = words(t)
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(i)
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    found |= windows[tuple(w[k : k + n])]
        yield (d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))


@pytest.mark.parametrize("block", [500_000, 40])
def test_decontamination_equals_brute_force(spark, empty, block):
    texts = _texts(40, 11)
    items = [(i, t) for i, t in enumerate(_texts(6, 12) + [texts[3], texts[7][:60], "solo word", None, "", "!!", texts[3]])]
    docs = [(i, t + (" Solo, WORD!" if i % 9 == 0 else "")) for i, t in enumerate(texts)] + [(100 + (d or 0), t) for d, t in EDGES if d]
    ready(spark)
    out = decontaminate.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), block_windows=block)
    got = [tuple(r) for r in out.select("doc_id", "leak.n_words", "leak.n_hit", "leak.n_items", "leak.items_sha256", "leak.contaminated").collect()]
    assert sorted(got) == sorted(_brute_leaks(docs, [(str(i), t) for i, t in items]))
    if block > 1000:
        clean = decontaminate.remove_spans(out).filter("doc_id = 0").first().text
        assert "Solo" not in clean
        assert decontaminate.decontaminate(empty, spark.createDataFrame(items, "item_id long, text string")).count() == 0
        assert decontaminate.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")).filter("leak.contaminated").count() == 0


# --- kernels


def test_blocks_cover_all_rows():
    column = pa.array(["a" * n if n % 3 else None for n in range(200)])
    rows = [(lo, hi, bytes(data), offsets.tolist()) for lo, hi, data, offsets in kernels.blocks(column.slice(7), 500)]
    assert rows[0][0] == 0 and rows[-1][1] == 193 and all(a[1] == b[0] for a, b in zip(rows, rows[1:], strict=False))
    assert b"".join(r[2] for r in rows).decode() == "".join(x or "" for x in column.slice(7).to_pylist())


# --- texts whose polynomial hashes are equal modulo 2**64, pages of odd markup, lost pages, long contexts

@pytest.mark.parametrize("size", [1024, 2048, 4096])
def test_no_operator_takes_one_text_for_its_complement(spark, size):
    a = _TURNS[:size]
    b = a.translate(str.maketrans("ab", "ba"))
    t = spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r.bpe for r in bpe.round_trip(t, queries.vocabulary(spark)).collect()}
    assert got[1].decoded_sha256 == hashlib.sha256(a.encode()).hexdigest() and got[2].decoded_sha256 == hashlib.sha256(b.encode()).hexdigest()
    assert {r.doc_id: r.component_id for r in jaccard.jaccard_components(t).collect()} == {1: 1, 2: 2}
    leaks = decontaminate.decontaminate(t, spark.createDataFrame([("x", a)], "item_id string, text string"))
    assert {r.doc_id: r.leak.contaminated for r in leaks.collect()} == {1: True, 2: False}


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<p data-t=it's>Hello, this isn't gone.</p><p>Second one, here.</p>", ["Hello, this isn't gone.", "Second one, here."]),
        ('<p title="a > b">Hello, there.</p><p title="odd>Still, here.</p><a href="x">', ["Hello, there.", "Still, here."]),
        ("<p>Hello, there <b cla", ["Hello, there"]),
        ("<article><h1>T</h1><p class='legal'>The court said, it is so.</p><p class=\"search results\">Results, were found.</p><div class='share-price'>Shares fell, again.</div><div class=share><a>x</a></div></article>", ["T", "The court said, it is so.", "Results, were found.", "Shares fell, again."]),
    ],
)
def test_html_of_odd_markup(page, want):
    assert html.main_text(page).split("\n") == want


def test_html_takes_time_in_proportion():
    for sign in ("<a '", "<a x='", "<a x=\"'", "<!-", "<"):
        t = time.perf_counter()
        html.main_text(sign * 20_000)
        assert time.perf_counter() - t < 3


def test_ogg_counts_a_lost_page_and_gives_times():
    sound = media.store(bytes(range(256)) * 600)
    pages = sound.split(b"OggS")[1:]
    whole = media.load(sound)
    assert whole["bad_pages"] == 0 and len(whole["times"]) == -(-256 * 600 // media.PACKET) and whole["times"][0] == media.PACKET / media.RATE and whole["times"][-1] == whole["seconds"] == 256 * 600 / media.RATE
    s = media.Stream(5, [(b"h", 0), (b"q" * 200_000, 1), (b"x", 2)])
    data = media.mux([s]).split(b"OggS")[1:]
    cut = b"".join(b"OggS" + p for i, p in enumerate(data) if i != 2)
    streams, bad = media.demux(cut)
    assert bad == 1 and [p for p, _ in streams[0].packets] == [b"h", b"x"] and len(pages) > 3


def test_pii_contexts_are_whole_words_and_numbers_may_have_spaces(spark):
    odd = "w" * 200
    rows = [(i, f"my {odd} line +49 30 12345{i:02d} today") for i in range(9)] + [(20, f"my {odd} line 030 123 4567 today"), (21, f"my {odd[:-1]}x other 030 123 4568 today")]
    got = {r.doc_id: r.pii for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0].n_phone == 1 and got[20].n_phone == 0 and got[20].spans == "phone:209:221" and got[21].spans == ""


def test_toxicity_penalty_spares_a_neutral_mention(spark):
    r = random.Random(4)
    words = [f"word{chr(97 + i)}" for i in range(20)]
    rows = [(i, " ".join(r.choice(words) for _ in range(12)) + (" muslims" if i % 4 == 0 else "") + (" vilest" if i % 8 == 0 else ""), int(i % 4 == 0)) for i in range(400)]
    t = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    probe = spark.createDataFrame([(1, "worda vilest wordb"), (2, "worda wordb muslims")], "doc_id long, text string")
    seen = []
    for penalty in (0.0, toxicity.COUNTERFACTUAL):
        model = toxicity.fit(t.select("doc_id", "text"), t.select("doc_id", "toxic"), penalty=penalty)
        seen.append({x.doc_id: x.score for x in toxicity.score(probe, model).collect()})
    assert seen[0][2] > 0.7 and seen[1][2] < 0.5 < seen[1][1]


def test_columns_of_the_operators_names_do_no_harm(spark):
    t = spark.createDataFrame([(1, "some words of a text", 7)], "doc_id long, text string, n_bytes long")
    assert media.digests(media.read_media(media.with_media(t))).first().n_bytes == 20
    seen = spark.createDataFrame([(1, ("en", 1.0, 2.0), 3)], "doc_id long, language struct<lang: string, score: double, nats: double>, limit long")
    out = language.reject(seen, spark.createDataFrame([("en", 2.5)], "lang string, limit double")).first()
    assert (out["limit"], out.rejected) == (3, False)
