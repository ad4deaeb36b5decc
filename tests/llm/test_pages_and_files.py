"""Class words around and in articles, pages whose text is all in doubt, the time of deep pages; files that were cut off."""

import time

import pytest

from groundwork.llm import html, media

PARTS = [f"Sentence one of part {i}, which is long enough, and has marks. It goes on and on." for i in range(6)]
BODY = "".join(f"<p>{p}</p>" for p in PARTS)
AROUND = "<nav><a>Home</a></nav><div class='sidebar'><a>x</a> <a>y</a></div><div class=cookie-notice>We use cookies, please agree to them all.</div>"


@pytest.mark.parametrize("mark", ["class=has-sidebar", "class=no-sidebar", "class='alert-free layout'", "id=search", "class=with-comments", "class=page-header-fixed", "class=wrapper"])
@pytest.mark.parametrize("inner", [f"<article>{BODY}</article>", f"<div>{BODY}</div>"])
def test_a_wrapper_keeps_its_article(mark, inner):
    page = f"<html><body>{AROUND}<div {mark}>{inner}<div class=comments><p>Nice post, thank you so much!</p></div></div><footer>foot</footer></body></html>"
    assert html.main_text(page) == "\n".join(PARTS)


@pytest.mark.parametrize("word", ["legal", "search", "copyright", "disclaimer", "eviction-notice", "alert-level", "menu-item", "comments-by-judge", "comment-worthy"])
def test_story_parts_with_names_stay(word):
    assert html.main_text(f"<body>{AROUND}<article><h1>T</h1><div class={word}>{BODY}</div><div class=share>Share this</div></article></body>") == "\n".join(["T", *PARTS])
    more = "A sentence of its own in a part, which is long enough to count, and has marks. It goes on and on."
    assert html.main_text(f"<body>{AROUND}<article><h1>T</h1>{BODY}<div class={word}><p>{more}</p></div></article></body>") == "\n".join(["T", *PARTS, more])


def test_what_is_no_text_still_goes():
    for junk in ("<div class=ad-box>Buy now, today. Really.</div>", "<ul class=comment-list><li>First!</li></ul>", "<div class=comments>Me too.</div>", "<div class=related>More</div>", "<div role=search>Find</div>", "<div hidden>Gone</div>", "<aside>Aside</aside>"):
        assert html.main_text(f"<body>{AROUND}<article>{BODY}{junk}</article></body>") == "\n".join(PARTS)
    assert html.main_text("<body><div class=sidebar></div></body>") == "" and html.main_text("<nav>Home</nav>") == ""


def test_time_follows_the_length_of_deep_pages():
    def took(page):
        t = time.perf_counter()
        html.main_text(page)
        return time.perf_counter() - t

    for make in (lambda k: "<div>" * k + "x, y." + "</div>" * k, lambda k: "<b>" * k + "</i>x" * k, lambda k: "<div><p>text, a. " * k, lambda k: "<b>" * k + "<p>x" * k):
        small, large = min(took(make(4000)) for _ in range(3)), took(make(16_000))
        assert large < 12 * small + 0.2


def test_a_file_that_was_cut_off_is_not_sound():
    whole = media.store(bytes(range(256)) * 600)
    pages = whole.split(b"OggS")[1:]
    assert media.load(whole)["bad_pages"] == 0
    for lost in ([len(pages) - 1], [1], [0]):
        cut = b"".join(b"OggS" + p for i, p in enumerate(pages) if i not in lost)
        assert media.load(cut)["bad_pages"] >= 1
    assert media.load(whole[: len(whole) // 2])["bad_pages"] >= 1 and media.load(whole[:-1])["bad_pages"] >= 1
    # one page damaged at a stream's end, one lost of the other stream: both count
    two = media.mux([media.Stream(5, [(b"a", 0), (b"q" * 300_000, 1), (b"b", 2)]), media.Stream(6, [(b"c", 0), (b"y" * 300_000, 1), (b"d", 2)])])
    parts = [b"OggS" + p for p in two.split(b"OggS")[1:]]
    five = [i for i, p in enumerate(parts) if p[14] == 5]
    six = [i for i, p in enumerate(parts) if p[14] == 6]
    parts[five[-1]] = parts[five[-1]][:-1] + b"?"
    assert media.demux(b"".join(p for i, p in enumerate(parts) if i != six[1]))[1] == 2
    note = media.mux([media.Stream(9, [(media._FORMAT.pack(b"PCM     ", 0, 0, 1, media.RATE, 8, 1, media.PACKET, 0), 0), (b"\x00" * 64, 64)]), media.Stream(8, [(b"NOTE" + (200).to_bytes(8, "little"), 0)])])
    assert media.load(note)["bad_pages"] == 1
    assert media.load(b"")["bad_pages"] == 0
