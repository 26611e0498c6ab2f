"""Column functions against plain Python."""

import math
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from pagestrata.functions import html_scan, html_tree, stamps, text, urls, validate, vectors
from pagestrata.functions.chunks import chunked


def column(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")


def results(df, col):
    return [r[0] for r in df.orderBy("i").select(col).collect()]


def plain_chunks(t, size):
    if len(t) <= size:
        return [t]
    out, cur = [], ""
    for s in (x.strip() for x in re.split(r"[.!?]+", t)):
        if not s:
            continue
        s += "."
        if len(cur) + len(s) + 1 <= size:
            cur += s + " "
            continue
        if cur.strip():
            out.append(cur.strip())
        if len(s) > size:
            cur = ""
            for w in s.split():
                if len(cur) + len(w) + 1 <= size:
                    cur += w + " "
                else:
                    if cur.strip():
                        out.append(cur.strip())
                    cur = w + " "
        else:
            cur = s + " "
    if cur.strip():
        out.append(cur.strip())
    return out


@pytest.mark.parametrize(
    ("given", "size", "want"),
    [
        ("Alpha beta. Gamma delta! Epsilon?", 20, ["Alpha beta.", "Gamma delta.", "Epsilon."]),
        ("aaaa bbbb cccc dddd", 10, ["aaaa bbbb", "cccc", "dddd."]),
        ("!" * 11, 10, []),
        ("abcdefghijklmnop qr. s. t", 10, ["abcdefghijklmnop", "qr. s. t."]),
        ("Hi.", 512, ["Hi."]),
    ],
)
def test_chunks_golden(spark, given, size, want):
    got = chunked(spark.createDataFrame([(1, given)], "id int, text string"), size).collect()
    assert [r["text"] for r in sorted(got, key=lambda r: r["chunk_index"] or 0)] == want
    assert all((r["chunk_index"] is None) == (len(given) <= size) for r in got)


def test_chunks_against_plain_python(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab .!? ") for _ in range(rng.randint(0, 90))) for _ in range(150)] + ["Слово. " * 20, ""]
    rows = chunked(spark.createDataFrame(list(enumerate(texts)), "id int, text string"), 12).collect()
    for i, t in enumerate(texts):
        got = [r["text"] for r in sorted((r for r in rows if r["id"] == i), key=lambda r: r["chunk_index"] or 0)]
        assert got == plain_chunks(t, 12), t


def test_blocks_golden():
    blocks = lambda h: html_tree.clean_page(h)[2]
    assert blocks("<div><p>Hello <b>world</b></p></div>") == [(1, "division", None, "Hello world"), (2, "paragraph", None, "Hello world")]
    assert blocks("<ul><li>One</li><li>Two</li></ul>") == [(1, "list_item", None, "One"), (2, "list_item", None, "Two")]
    assert blocks("<h3>T1</h3><p>x</p><p>yy</p>") == [(1, "heading", 3, "T1"), (2, "paragraph", None, "yy")]
    assert blocks("<p><b>foo</b>bar</p>") == [(1, "paragraph", None, "foo bar")]
    assert blocks("<table><tr><th>Ha</th><td>Va</td></tr></table>") == [(1, "table_header", None, "Ha"), (2, "table_cell", None, "Va")]
    assert blocks("<p>one<br><p>two</p>") == [(1, "paragraph", None, "one two"), (2, "paragraph", None, "two")]


def test_cleaning_golden():
    clean = lambda h: html_tree.clean_page(h)[0]
    assert clean('<body><nav>n</nav><script>s</script><div id="wm-ipp">x</div><div id="WM-x">k</div></body>') == '<body><nav>n</nav><div id="WM-x">k</div></body>'
    assert "gone" not in clean('<p class="Archive-bar x">gone</p><p>stays</p>')
    assert html_tree.blocks_of(html_tree.parse("")) == [] and html_tree.clean_page('<body class="archive"><p>ab</p></body>')[2] == []
    assert clean("<p>a &lt; b<!--c--></p>") == "<p>a &lt; b<!--c--></p>"
    assert html_tree.clean_page("<title> T&amp;U </title>")[1] == "T&U" and html_tree.clean_page("<p>")[1] == "Unknown Title"


def test_page_udf_null(spark):
    got = column(spark, [None, "", "<p>ab</p>"]).select("i", html_tree.page_udf("v").alias("p")).orderBy("i").collect()
    assert [len(r["p"]["blocks"]) for r in got] == [0, 0, 1] and got[0]["p"]["cleaned_length"] is None


def test_script_share_and_route(spark):
    pages = ["<p>ab</p>", "<p>абвгґ</p>", "", None, "123"]
    df = column(spark, pages)
    assert results(df, text.is_cyrillic(F.col("v"), 0.2)) == [False, True, False, False, False]
    routes = df.select("i", text.clean_route(F.col("v"), F.col("i") == 0).alias("r"))
    assert [tuple(r["r"]) for r in routes.orderBy("i").collect()] == [("basic", "archived"), ("basic", "cyrillic"), ("ai", "default"), ("ai", "default"), ("ai", "default")]
    assert results(df, text.clean_route(F.col("v"), F.lit(False), force_basic=True)["reason"])[0] == "forced"


def test_blank_squeeze_shorten(spark):
    df = column(spark, ["  a   b ", "  \t", "", None, "x" * 250])
    assert results(df, text.is_blank(F.col("v"))) == [False, True, True, True, False]
    assert results(df, text.squeeze(F.col("v")))[0] == "a b"
    assert results(df, text.strip(F.col("v")))[:2] == ["a   b", ""]
    assert len(results(df, text.shorten(F.col("v"), 200))[4]) == 203


def test_urls(spark):
    df = column(spark, ["", "abc", "a.b", "/x", "ftp://h/x", "https://h", None])
    assert results(df, validate.url_normal(F.col("v"))) == [None, "document://abc", "a.b", "/x", "ftp://h/x", "https://h", None]
    keys = column(spark, ["http://www.Vilna.example:80/A/b/?q=1#top", "https://vilna.example/A/b?q=1/", "HTTP://VILNA.example/", None, "", "//x.y/z//"])
    assert results(keys, urls.url_key(F.col("v"))) == ["vilna.example/A/b/?q=1", "vilna.example/A/b?q=1", "vilna.example", None, "", "x.y/z"]
    errors = results(column(spark, ["https://a.b/c", "name_1", "a b!"]), validate.url_format(F.col("v"))["error"])
    assert errors[:2] == [None, None] and errors[2]


def test_stamps(spark):
    given = ["20201130051600", "20200231000000", "19891231235959", "20201301000000", "2020113005160", "unknown_timestamp", None, ""]
    df = column(spark, given)
    assert results(df, stamps.stamp_valid(F.col("v"))) == [True, True] + [False] * 6
    parts = [r[0] for r in df.orderBy("i").select(stamps.stamp_parts(F.col("v"))).collect()]
    assert parts[0]["datetime"] == "2020-11-30T05:16:00" and parts[0]["weekday"] == "Monday" and parts[0]["error"] is None
    assert parts[1]["error"] == "Failed to parse timestamp" and parts[4]["error"] == parts[6]["error"] == "Invalid timestamp format"


def test_html_validity(spark):
    df = column(spark, ["<P>x", "<pre>x", "plain", "  ", None, "<h4>"])
    assert results(df, validate.html_valid(F.col("v"))) == [True, True, False, False, False, False]


def test_vectors(spark):
    df = column(spark, [[1.0, 0.0], [0.0, 2.0], [-1.0, 0.0], [0.0, 0.0], [1.0], None], "array<float>")
    q = vectors.literal([1.0, 0.0])
    got = results(df, vectors.cosine(F.col("v"), q))
    assert got[:3] == [1.0, 0.0, -1.0] and math.isnan(got[3]) and got[4] == 0.0 and got[5] is None
    assert results(df, vectors.squared_distance(F.col("v"), q)) == [0.0, 5.0, 4.0, 1.0, None, None]


def test_scan_numbers_blocks():
    page = "<!DOCTYPE html><!-- <p>no</p> --><script>'<p>no</p>'</script><P>a<p>b</p><ul><li>c<li></ul><noscript><p>no</p></noscript><BLOCKQUOTE>d</BLOCKQUOTE><style>p{}</style><h2>e &amp; <a href='x'>f</a></h2>"
    got = html_scan.scan_blocks(page)
    assert [(b.no, b.tag, b.text) for b in got] == [(1, "p", "a"), (2, "p", "b"), (3, "li", "c"), (4, "li", ""), (5, "blockquote", "d"), (6, "h2", "e & f")]
    assert got[5].link_chars == 1 and html_scan.scan_blocks(None) == html_scan.scan_blocks("") == []
    assert html_scan.words("Ab-9 ї_x") == ["ab", "9", "ї", "x"] and "no" not in html_scan.visible_text(page)


@pytest.mark.parametrize("piece", ["<a ", '<a "', "<a ='", "<!-- ", "<!", "<p", "<script ", "</p", '<a ">"', "<div>", "<blockquote><li>"])
def test_a_page_of_broken_markup_is_scanned_in_linear_time(piece):
    page = piece * (1_000_000 // len(piece)) + "</h1>" * 1000 + "</section>'" * 1000
    began = time.perf_counter()
    html_scan.scan_blocks(page)
    html_scan.visible_text(page)
    assert time.perf_counter() - began < 5


def test_cut_off_tags_and_unclosed_quotes():
    assert [b.text for b in html_scan.scan_blocks('<p title="a>b">one</p><p x=\'>two</p><p>three <b')] == ["one", "two", "three"]
    assert html_scan.visible_text("a<!-- b").strip() == "a" and html_scan.visible_text("5 < 6 <i>x</i>").split() == ["5", "<", "6", "x"]
