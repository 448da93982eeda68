import pytest
from pyspark.sql import functions as F

from vellumkit.llm import html_extraction as H, url_filter as U

AUTO = U.automaton()


@pytest.mark.parametrize(
    "url,want",
    [
        ("http://essex.example.com/sussex", (0, 0, 0, 0, False)), ("http://x.com/sex", (0, 1, 1, 2.0, False)), ("http://x.com/sex-sex", (0, 2, 1, 2.0, False)), ("http://x.com/SEX/adult", (0, 2, 2, 3.0, True)), ("https://best-casino.com", (1, 0, 0, 0, True)),
        ("http://live-sex.com", (1, 1, 1, 2.0, True)), ("", (0, 0, 0, 0, False)), (None, (0, 0, 0, 0, False)), ("a" * 200_000 + "/porn", (1, 0, 0, 0, True)),
    ],
)
def test_urls(url, want):
    assert U.judge(url, AUTO) == want


@pytest.mark.parametrize("url,rejected", [("http://m.casino-win.example.com/en", True), ("https://free-bets.example.com", True), ("http://www.cheap-pills.example.com", True), ("https://m.ads-track.example.com", True), ("http://spam-farm.example.net", True), ("http://adult-x.example.net", True),
    ("http://free-win.example.com", False), ("http://a.com/live%2Dsex", True), ("http://a.com/%70%6F%72n", True), ("http://a.com/100%free", False), ("http://a.com/%", False), ("http://a.com/caf%C3%A9/poker%20bets", True), ("https://www.ththing.example.net/en/7442.html", False)])
def test_which_urls_go(url, rejected):
    assert U.judge(url, AUTO)[4] == rejected


def test_vocabulary_of_the_caller(spark):
    pages = spark.createDataFrame([(1, "http://bad.com"), (2, "http://x.com/one-two"), (3, "http://x.com/three_one"), (4, None)], "page_id bigint, url string")
    got = lambda *a: {r["page_id"] for r in U.url_filter(pages, *a).where("rejected").collect()}
    terms = {"bad": None, "one": 0.5, "two": 0.5, "three": 0.1, "--": None}
    assert got(terms) == {1, 2} and got(terms, 2, 0.0) == {1, 2, 3} and got(terms, 3) == {1} and got({}) == set()


def test_url_sql_over_escapes(spark):
    import duckdb

    from ..oracle import rows

    urls = [None, "", "http://a.com/live%2Dsex", "http://a.com/%70%6F%72n", "http://a.com/100%free-%2", "%", "http://a.com/caf%C3%A9/Poker%20BETS", "sex%%36%31adult", "x%2561y"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    con = duckdb.connect()
    con.register("pages", pages.toPandas())
    assert rows(U.url_filter(pages).toPandas()) == rows(con.sql(U.oracle_sql()).df())


def test_pages(spark):
    pages = spark.createDataFrame([(1, "http://a.com/sex/adult", None), (1, "http://a.com/sex/adult", "x"), (None, None, "<p>hi"), (2, "", "")], "page_id bigint, url string, html string").withColumns({c: F.lit(1) for c in ("rejected", "soft_hits", "j", "text", "x", "threshold")})
    got = U.url_filter(pages).collect()
    assert sorted((str(r["page_id"]), r["rejected"]) for r in got) == [("1", True), ("1", True), ("2", False), ("None", False)]
    out = H.html_extraction(pages).collect()
    assert sorted((str(r["page_id"]), str(r["text"])) for r in out) == [("1", "None"), ("1", "x"), ("2", ""), ("None", "hi")]
    none = pages.where("false")
    assert U.url_filter(none).count() == 0 and H.html_extraction(none).count() == 0


NAV = "<ul>" + "".join(f"<li><a href='/{k}'>Link {k}</a></li>" for k in range(8)) + "</ul>"
BODY = "<p>" + "</p><p>".join("Real prose goes on and on, sentence after sentence, " * 6 for _ in range(5)) + "</p>"
PAGE = f"<html><head><title>T</title><style>p{{}}</style><script>var s='</p>';</script></head><body><nav>{NAV}</nav><article>{BODY}</article><footer>{NAV}</footer></body></html>"


def test_content_is_kept_and_links_are_not():
    text, n, kept, threshold = H.extract(PAGE)
    assert text.count("Real prose") == 30 and "Link 0" not in text.split("\n")[0] and "var s" not in text
    assert threshold > 0 and 5 <= kept < n
    assert sum(f"Link {k}" in text for k in range(8)) <= 2


def test_ratios_by_hand():
    """Smoothing and threshold against plain loops."""
    import math

    lines = H.lines_of(PAGE)
    raw = [len(t) / max(1, k) for t, k in lines]
    weight = [math.exp(-0.5 * (d / H.SIGMA) ** 2) for d in range(-H.RADIUS, H.RADIUS + 1)]
    want = []
    for i in range(len(raw)):
        near = [(w, raw[i + d]) for d, w in zip(range(-H.RADIUS, H.RADIUS + 1), weight) if 0 <= i + d < len(raw)]
        want.append(sum(w * x for w, x in near) / sum(w for w, _ in near))
    assert H.smoothed(H.np.array(raw)).tolist() == pytest.approx(want)
    mean = sum(want) / len(want)
    t = H.LAMBDA * math.sqrt(sum((x - mean) ** 2 for x in want) / len(want))
    assert H.extract(PAGE)[3] == pytest.approx(t)
    assert H.extract(PAGE)[0] == "\n".join(s for (s, _), r in zip(lines, want) if s and r >= t and r > 0)


@pytest.mark.parametrize("html,text", [("plain\ntext", "plain\ntext"), ("<p>a &amp; b", "a & b"), ("<script>x", ""), ("<!-- c --><br>", ""), ("<p>" + "word " * 100_000, ("word " * 100_000).strip()), ("<b><i>unclosed", "unclosed"), ("<", "<")])
def test_odd_pages(html, text):
    assert H.extract(html)[0] == text


def by_hand(html):
    """Content of a page from the events of a parser of its own, one loop a step."""
    import math
    from html.parser import HTMLParser

    events = []

    class Events(HTMLParser):
        def handle_starttag(self, tag, attrs):
            events.append(("<", tag))

        def handle_endtag(self, tag):
            events.append((">", tag))

        def handle_data(self, data):
            events.append(("t", data))

    p = Events(convert_charrefs=True)
    p.feed(html)
    p.close()
    rows, text, tags, hidden = [], "", 0, None

    def cut(seen):
        if seen:
            rows.append((" ".join(text.split()), tags))
        return "", 0

    seen = False
    for kind, x in events:
        if hidden:
            if kind == ">" and (x == hidden or x in ("head", "body", "html")):
                hidden = None
        elif kind == "<" and x in H.SKIPPED:
            hidden = x
        elif kind == "<":
            if x in H.BLOCKS:
                text, tags = cut(seen)
            tags, seen = tags + 1, True
        elif kind == ">":
            tags, seen = tags + 1, True
            if x in H.BLOCKS:
                text, tags = cut(seen)
                seen = False
        else:
            for k, line in enumerate(x.split("\n")):
                if k:
                    text, tags = cut(seen)
                text, seen = text + line, True
    cut(seen)
    if not rows:
        return "", 0, 0
    ratio = [len(t) / max(1, n) for t, n in rows]
    smooth = []
    for i in range(len(ratio)):
        near = [(math.exp(-0.5 * (j - i) ** 2), ratio[j]) for j in range(max(0, i - 2), min(len(ratio), i + 3))]
        smooth.append(sum(w * r for w, r in near) / sum(w for w, _ in near))
    mean = sum(smooth) / len(smooth)
    threshold = 0.5 * math.sqrt(sum((s - mean) ** 2 for s in smooth) / len(smooth))
    keep = [t for (t, _), s in zip(rows, smooth) if t and s > 0 and s >= threshold]
    return "\n".join(keep), len(rows), len(keep)


def test_the_whole_query_against_loops(spark):
    from vellumkit.llm import queries as Q

    from ..oracle import SF

    html = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = Q.op3_html_extraction(spark, SF).collect()
    assert len(got) == len(html) and all(html.values())
    for r in got:
        assert (r["text"], r["n_lines"], r["n_content_lines"]) == by_hand(html[r["page_id"]])
    for page in (PAGE, "plain\ntext", "<script>x", "<p>a<b>c</p>\n\n<div></div>", ""):
        assert H.extract(page)[:3] == by_hand(page)
