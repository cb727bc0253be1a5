from __future__ import annotations

import pytest

from spacelens.llm.html_paths import extract, main_text, path_scores, blocks_of, PathConfig

CASES = {
    "article": (
        "<html><head><title>T</title></head><body><header><h1>Site</h1></header><nav><a href=x>menu</a></nav>"
        "<article><h1>Head &amp; more</h1><p>One,\n two.<p>Three <b>bold</b> <a href='y'>link</a>.<br>Four</article>"
        "<div class='comments'><p>A reader's long, long comment. And more of it.</p></div><footer>f</footer></body>",
        "Head & more\n\nOne, two.\n\nThree bold link. Four",
    ),
    "div page": (
        "<body><div class=top-menu><ul><li>a<li>b</ul></div><div><p>Some long text, with marks. Yes.</p>"
        "<p>More text, also long enough to count.</p><ul><li>item one</li><li>item two</li></ul></div>"
        "<div id=sideBar><p>Read this too.</p></div><form><p>Name</p></form></body>",
        "Some long text, with marks. Yes.\n\nMore text, also long enough to count.\n\nitem one\n\nitem two",
    ),
    "script in text": ("<p>a<script>var t='</p>';</script>b</p>", "ab"),
    "quoted bracket": ('<p title="a>b">x</p>', "x"),
    "apostrophe in a bare value": ("<p title=don't>x</p><p>it's y</p>", "x\n\nit's y"),
    "references": ("<p>&lt;b&gt; &#233;&#x41; &am &amp</p>", "<b> éA &am &"),
    "plain": ("no markup\n at all", "no markup at all"),
    "cut": ("<p>whole</p><p>x</p", "whole\n\nx"),
    "cut comment": ("<p>whole</p><!-- never ends <p>x</p>", "whole"),
    "hidden": ("<div><p>seen text.</p><p hidden>unseen</p></div>", "seen text."),
    "notice": ("<main><p>Text, of the page.</p><div class='cookie-notice'>We use cookies.</div></main>", "Text, of the page."),
    "null": (None, ""),
    "empty": ("", ""),
    "only boilerplate": ("<nav>a</nav><footer>b</footer>", ""),
}


@pytest.mark.parametrize("name", CASES)
def test_cases(name):
    page, text = CASES[name]
    assert main_text(page) == text


def test_scores_equal_a_plain_double_loop():
    page = "<body><div><p>Long, long text. Yes.</p><p>x</p><ul><li>a<li>b</ul></div><section><h2>H</h2><p>y, z</p></section>"
    import math
    from collections import defaultdict

    config = PathConfig()
    blocks = [(b, b.text()) for b in blocks_of(page)]
    length, marks, count = defaultdict(float), defaultdict(float), defaultdict(int)
    for b, t in blocks:
        length[b.path] += len(t)
        marks[b.path] += sum(c in ".,;:!?" for c in t)
        count[b.path] += 1
    for p, score in path_scores(blocks, config).items():
        total = x = y = 0.0
        for q in count:
            k = next((i for i, (a, b) in enumerate(zip(p, q)) if a != b), min(len(p), len(q)))
            away = (1 - 2 * k / (len(p) + len(q))) / config.sigma
            w = math.exp(-0.5 * away * away) if away < 4 else 0
            total, x, y = total + w, x + w * length[q] / count[q], y + w * (1 + marks[q]) / count[q]
        assert score == pytest.approx(math.sqrt(x / total * y / total))


def test_deep_and_long_pages():
    assert main_text("<div>" * 3000 + "<p>deep, text.</p>") == "deep, text."
    assert len(main_text("<article><p>" + "word " * 200_000)) == 999_999


def test_table(spark):
    rows = [(1, "u", "<p>a, b</p>", "kept"), (1, "u", "<p>a, b</p>", "kept"), (None, None, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, main_text string")
    out = extract(df)
    assert out.columns == ["page_id", "url", "html", "main_text"]
    assert sorted(r["main_text"] for r in out.collect()) == ["", "a, b", "a, b"]
    assert extract(df.limit(0)).count() == 0


def test_content_in_several_containers_stays_and_lists_of_links_do_not():
    lead = "<main><h1>Title</h1><p>A lead, set under main. It counts.</p><article><p>First part, of the text. Yes.</p>"
    part = "</article><article><h2>Two</h2><p>Second part, as long as that. So.</p></article></main>"
    links = "<ul><li><a href=a>one more page</a></li><li><a href=b>and one more</a></li></ul>"
    want = "Title\n\nA lead, set under main. It counts.\n\nFirst part, of the text. Yes.\n\nTwo\n\nSecond part, as long as that. So."
    assert main_text(lead + part) == want
    assert main_text(lead + links + part) == want
    nested = "<article><p>Outer text, long enough. Yes.</p><article><p>Inner text, as long. Yes.</p></article></article>"
    assert main_text(nested) == "Outer text, long enough. Yes.\n\nInner text, as long. Yes."
