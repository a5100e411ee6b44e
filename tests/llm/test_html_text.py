import re
from html import unescape

import pytest

from hatospark.llm.html_text import extracted, main_text

BODY = "<p>One two three four five six seven eight &eacute;&nbsp;nine.<p>Be.<p>More <b>bold</b> text, long enough to count.</p>"
WANT = "One two three four five six seven eight é nine. Be. More bold text, long enough to count."


@pytest.mark.parametrize(
    "page",
    [
        f"<html><head><title>T</title><style>x</style></head><body><header>Site</header><nav><a>x</a></nav><article>{BODY}</article><footer>c</footer>",
        f"<main>{BODY}<aside>side</aside><form><input><label>mail</label></form></main><div class='cookie-notice'>We use cookies</div>",
        f"<div id=content>{BODY}<div class=share>Share</div><section id=comments><p>great post by me</p></section></div>",
        f"<article>{BODY}<article><p>a reader's comment</p></article><div class='ad'>buy</div><script>1<2</script></article>",
        f"<!-- x --><div role=navigation>menu here</div><article>{BODY}<div style='display: none'>hidden words</div>",
    ],
)
def test_leaves_out_what_is_no_article(page):
    assert main_text(page) == WANT


def test_whole_pages_against_their_article_element(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r for r in extracted(pages).collect()}
    for r in pages.collect():
        inner = r.html.split("<article>")[1].split("</article>")[0]
        inner = re.sub(r"</?(p|br|h1|b)>", lambda m: "" if m[1] == "b" else " ", inner)
        want = " ".join(unescape(inner).split())
        assert (got[r.page_id].text, got[r.page_id].n_chars) == (want, len(want))
    assert len(got) == pages.count()


def test_odd_pages(rows):
    pages = [
        (None, None, None), (1, "u", ""), (1, "u", ""), (2, None, "plain <"), (3, "u", "<div><<<>"),
        (4, "u", "<p>" * 5000 + "x"), (5, "u", "<b>" * 5000 + "y" + "</i>" * 5000), (6, "u", "<p>" + "z " * 200_000),
    ]
    out = extracted(rows("page_id long, url string, html string, text int", [(*p, 1) for p in pages])).collect()
    assert [r.text[:5] for r in out] == ["", "", "", "plain", "<<<>", "x", "y", "z z z"]
    assert out[-1].n_chars == 399_999
    assert extracted(rows("page_id long, url string, html string")).count() == 0
