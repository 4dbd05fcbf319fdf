import time
from html.parser import HTMLParser

import pytest

from passagework.llm.html_text import extract, html_to_text


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("", ""), (None, None), ("plain &amp; simple", "plain & simple"), ("<p>a<p>b", "a\n\nb"), ("<div>a</div><div>b</div>", "a\nb"),
        ("a<br>b<br><br>c", "a\nb\n\nc"), ("<ul><li>a<li>b<ul><li>c</ul></ul>d", "- a\n- b\n  - c\n\nd"),
        ("<ol start=9><li>a</li><li>b</li></ol>", "9. a\n10. b"),
        ("<table><tr><td>a<td>bb<tr><td>ccc<td>d</table>", "a    bb\nccc  d"),
        ("<table><tr><th colspan=2>wide head<tr><td>x<td>y</table>", "wide head\nx  y"),
        ("<table><tr><td rowspan=2>r<td>1<tr><td>2</table>", "r  1\n   2"),
        ("<script>if (a < b) x('</p>')</script>seen<style>p{}</style>", "seen"), ("<!-- no -->yes<!-- <p>no</p> -->", "yes"),
        ("<p hidden>no</p><p style='display: none'>no</p><p>yes</p>", "yes"),
        ("<div style='visibility:hidden'>no<span style='visibility:visible'>yes</span></div>", "yes"),
        ("<head><title>t</title></head><body>b</body>", "b"), ("<pre>a\n  b\n\nc</pre>", "a\n  b\n\nc"),
        ("<p>one <b>two</b>three</p>", "one twothree"), ("1 < 2 <b>x</b", "1 < 2 x</b"), ("<dl><dt>t<dd>d</dl>", "t\n  d"),
        ("<blockquote>q<p>r</blockquote>s", "> q\n\n> r\n\ns"), ("<select><option>a<option>b</select>", "a\nb"), ("<p>a</p></div></p>b", "a\n\nb"),
    ],
)
def test_rendering(html, text):
    assert html_to_text(html) == text


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("a <math><mi>x</mi><mo>=</mo><mn>2</mn></math> b", "a x=2 b"), ("<math><mfrac><mn>1</mn><mn>2</mn></mfrac></math>", "1 2"),
        ("<math><semantics><mi>y</mi><annotation encoding='t'>no</annotation><annotation-xml><p>no</p></annotation-xml></semantics></math>z", "yz"),
        ("<p>c</p><svg><title>no</title><desc>no</desc><g><text x=1>Jan</text><text>Feb</text></g></svg><p>d</p>", "c\n\nJan\nFeb\n\nd"),
        ("<svg><defs><text>no</text></defs><metadata>no</metadata><text>yes</text></svg>", "yes"), ("<desc>shown</desc> outside", "shown outside"),
        ("<svg><style/><title/><path d='M0'><text>yes</text></svg> after", "yes\nafter"), ("<svg><text display=none>no</text></svg>x", "x"),
        ("<svg><text><![CDATA[a < b > c]]></text></svg>", "a < b > c"), ("<svg><foreignObject><p>in</p></foreignObject></svg>", "in"),
        ("<svg><defs><p>out", "out"), ("<svg><text><tspan x=0>a</tspan><tspan x=0>b</tspan></text></svg>", "a\nb"),
    ],
)
def test_formulas_and_charts(html, text):
    assert html_to_text(html) == text


def test_one_overlong_cell_leaves_the_others_aligned():
    cells = [["a" * 20, "b" * 20, "c"] for _ in range(20)]
    cells[3] = ["z" * 9000, "one<br>two", "d"]
    cells[5][0] = "short"
    got = html_to_text("<table>" + "".join("<tr>" + "".join(f"<td>{c}" for c in r) for r in cells) + "</table>").split("\n")
    assert len(got) == 21 and got[0] == f"{'a' * 20}  {'b' * 20}  c"
    assert got[3] == f"{'z' * 9000}  {'one':20}  d" and got[4] == f"{'':20}  two"
    assert got[6] == f"{'short':20}  {'b' * 20}  c"


def test_depth_and_length_are_no_problem():
    assert html_to_text("<div>" * 20000 + "x") == "x"
    assert html_to_text("<b>" * 20000 + "x" + "</i>" * 2000) == "x"
    big = "<table>" + "".join(f"<tr><td>{i}<td>{'y' * (i % 9)}" for i in range(5000)) + "</table>"
    assert html_to_text(big).count("\n") == 4999
    assert len(html_to_text("<table><tr><td>" + "z" * 10**5 + "".join("<tr><td>a<td>b" for _ in range(3000)) + "</table>")) < 10**6
    html_to_text("<a " * 3000)


def test_rows(spark):
    rows = [(1, "u", "<p>a</p><p>b</p>"), (2, "u", None), (None, None, ""), (1, "u", "<p>a</p><p>b</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumnRenamed("url", "text")
    got = sorted(map(str, (tuple(r) for r in extract(pages).collect())))
    assert got == sorted(map(str, [(1, "a\n\nb", 4, 3)] * 2 + [(2, None, None, None), (None, "", 0, 0)]))
    assert extract(pages.limit(0)).count() == 0


class Visible(HTMLParser):
    """Words outside hidden elements, by the standard library's parser and a stack."""

    SKIP = {"script", "style", "head", "title", "template", "noscript"}
    VOID = {"br", "img", "hr", "input", "meta", "link", "wbr"}

    def __init__(self):
        super().__init__()
        self.stack, self.words = [], []

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        hides = tag in self.SKIP or "hidden" in a or "display:none" in (a.get("style") or "").replace(" ", "")
        if tag not in self.VOID:
            self.stack.append((tag, hides))

    def handle_endtag(self, tag):
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                del self.stack[i:]
                return

    def handle_data(self, data):
        if not any(h for _, h in self.stack):
            self.words.append(data)


def test_query_against_another_parser(spark, data):
    import re

    from passagework.llm import queries

    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{data}/pages.parquet").collect()}
    got = {r["page_id"]: r["text"] for r in queries.op9_html_text(spark, data).collect()}
    assert got.keys() == pages.keys()
    for page, html in pages.items():
        v = Visible()
        v.feed(html)
        v.close()
        plain = re.sub(r"\s+", "", "".join(v.words))
        text = re.sub(r"(?m)^[> ]*(?:- |\d+\. )", "", got[page])
        assert re.sub(r"\s+", "", text) == re.sub(r"(?m)^(?:- |\d+\. )", "", plain), page


def test_closed_details_and_dialogs_are_hidden():
    assert html_to_text("<details><summary>Head</summary>body<summary>no</summary></details>x") == "Head\nx"
    assert html_to_text("<details open><summary>Head</summary>body</details>") == "Head\nbody"
    assert html_to_text("<dialog>no</dialog>a<dialog open>yes</dialog><p popover>no</p>") == "a\nyes"
    assert html_to_text("<details>all of it<b>x</b></details>y") == "y"


def test_huge_character_references_are_one_unknown_character():
    assert html_to_text("a&#" + "9" * 5000 + ";b&#0000000000065;c&#x" + "f" * 50 + ";") == "a\ufffdbAc\ufffd"


def test_tags_without_an_end():
    assert html_to_text("a <b x") == "a <b x"
    assert html_to_text("<p>a <b x<!-- gone") == "a <b x"
    assert html_to_text("<a 'x>one</a> two") == "one two"
    assert html_to_text("1 < 2 <3 <p>x") == "1 < 2 <3\n\nx"


HOSTILE = {
    "open tags": lambda n: "<a" * n, "open tags, then an end": lambda n: "<a " * n + ">x", "quotes": lambda n: '<a "x>y" ' * n + "'",
    "single quotes": lambda n: "<a '>" * n, "ends": lambda n: "</x" * n, "comments": lambda n: "<!-- x " * n, "bangs": lambda n: "<!x" * n,
    "deep": lambda n: "<div>" * n + "x", "deep spans": lambda n: "<p><table><td>" + "<span>" * n + "<div>x" * n, "quoted": lambda n: "<blockquote>x" * n,
    "lists": lambda n: "<ul><li>x" * n, "tables": lambda n: "<table><td>x" * n, "rows": lambda n: "<table><td colspan=1000 rowspan=65534>x" + "<tr><td>y" * n,
    "spans": lambda n: "<table>" + "<tr><td rowspan=65534>y" * n, "closed": lambda n: "<b>" * n + "</i>" * n, "wide": lambda n: "<table><tr>" + "<td>x" * n,
    "raw": lambda n: "<script>" * n, "cdata": lambda n: "<svg><![CDATA[" * n, "entities": lambda n: "&#" + "1" * n + "&" * n, "headings": lambda n: "<h1>x</h2>" * n,
}


@pytest.mark.parametrize("name", HOSTILE)
def test_hostile_markup_costs_in_proportion(name):
    def seconds(n):
        source = HOSTILE[name](n)
        began = time.process_time()
        text = html_to_text(source)
        return (time.process_time() - began) / len(source) * 1e6, len(text) / len(source)

    seconds(100)
    small, large = seconds(5_000), seconds(40_000)
    assert large[0] < 3 * small[0] + 2 and large[1] < 2 * small[1] + 1, (small, large)


def test_a_megabyte_of_open_tags_takes_no_second():
    began = time.process_time()
    assert html_to_text("<a" * 500_000) == "<a" * 500_000
    assert time.process_time() - began < 1


def test_only_html_blanks_collapse():
    assert html_to_text("<p>a&nbsp;&nbsp;&nbsp;b \n\t c\u3000\u3000d</p>") == "a\xa0\xa0\xa0b c\u3000\u3000d"
    assert html_to_text("<p>a&nbsp;<b>b</b> &nbsp; c</p><p></p>") == "a\xa0b \xa0 c"
