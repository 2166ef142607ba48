"""Pages read by one expression, held against the general parser."""

import random

from tallyscope.sources import landed

PAGE = "<html><body class='x'><table id='data' class=\"a b\"><tr><th>Item</th></tr><tr><td> <a href='i?p=1'>item 1</a></td><td>2 \n</td></tr></table> end</body></html>"
PIECES = ["<table>", "<table id='data'>", "<TABLE CLASS=\"a b\" id='x'>", "</table>", "</TABLE >", "<tr>", "</tr>", "<td>", "<td width='1' >", "</td>", "<th>", "</th>", "<a href='u'>",
          "<a HREF=\"v'w\" href='z'>", "<a>", "</a>", " text ", "x\ny", "\u00e9\u2003", "=>", "'"]
ODD = ["&amp;", "<br/>", "<!-- <td> -->", "<script>", "</script>", "<a href=u>", "<td nowrap>", "< td", "<", "<td", "<textarea>", "<title>", "</title>", "</a href='u'>", "\r\n", "<a\u00a0href='u'>", "<a href=''>", "\0", "<td class='a'id='b'>", "<tdx>", "<a href='<'>"]


def read(html, general):
    parser = landed._Tables()
    (parser.feed if general else parser.read)(html)
    return parser.tables, parser.cells, parser.link


def test_plain_pages_need_no_general_parser(monkeypatch):
    want = read(PAGE, True)
    monkeypatch.setattr(landed._Tables, "feed", lambda *_: 1 / 0)
    assert landed._chosen(PAGE, "data", None) == want[0][0]


def test_both_ways_agree():
    rng = random.Random(4)
    for i in range(6000):
        pieces = [rng.choice(PIECES + (ODD if i % 2 and rng.random() < 0.3 else [])) for _ in range(rng.randrange(25))]
        html = "".join(pieces)
        assert read(html, False) == read(html, True), html


def test_rows_and_links_of_pages(spark):
    pages = spark.createDataFrame([(1, PAGE), (2, None), (3, ""), (4, PAGE.replace("2 ", "&lt;")), (None, PAGE)], "k int, html string")
    assert sorted(map(tuple, landed.html_rows(pages, "k", "html", "data").collect()), key=str) == sorted([(1, 0, ["item 1", "2"]), (4, 0, ["item 1", "<"]), (None, 0, ["item 1", "2"])], key=str)
    assert sorted(map(tuple, landed.html_links(pages, "k", "html", table_class="b").collect()), key=str) == sorted([(k, "item 1", "i?p=1") for k in (1, 4, None)], key=str)
    assert landed.html_rows(pages.filter("k = 2"), "k", "html").count() == 0
