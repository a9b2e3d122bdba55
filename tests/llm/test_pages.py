"""Archives, URL verdicts and text of pages."""

import duckdb
import pytest
from pyspark.sql import functions as F

from tablewright.llm import html_text, url_filter, warc
from tablewright.llm.queries import QUERIES, SQL, URL_RULES
from tests.llm import brute

PAGES = [(1, "https://a.example.com/x", "<p>one</p>"), (2, "https://b.example.com/\r\nEvil: 1", "<p>one</p>"), (3, None, None), (4, "u", ""),
         (5, "u", "é" * 70_000), (7, "u", "<p>one</p>\r\n\r\nWARC/1.1\r\n"), (6, "u", "<p>one</p>")]


def frame(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumns(
        {c: F.lit("other") for c in ("sha256", "payload", "header", "host", "rule", "text", "features")})


def test_archive(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    known = {r["page_id"]: r["html"] for r in pages.collect()}
    for source, rows in ((pages, list(known.items())), (frame(spark, PAGES), [(p, h) for p, _, h in PAGES])):
        got = {r["page_id"]: tuple(r[c] for c in ("payload_bytes", "payload_digest", "record_type", "refers_to"))
               for r in warc.archive_round_trip(source).collect()}
        assert got == brute.warc_rows(rows)


def test_records_and_files(spark, tmp_path):
    warc.write_archive(frame(spark, PAGES), f"{tmp_path}/a")
    assert spark.read.parquet(f"{tmp_path}/a/payloads").count() == len({h or "" for _, _, h in PAGES})
    records = {r["page_id"]: r for r in warc.read_records(spark, f"{tmp_path}/a").collect()}
    assert {p: bytes(r["payload"]).decode() for p, r in records.items()} == {p: h or "" for p, _, h in PAGES}
    assert "\nEvil" not in records[2]["header"]
    warc.export_warc(spark, f"{tmp_path}/a", f"{tmp_path}/files", 3)
    found = {(r["header"], bytes(r["block"])) for r in warc.read_warc(spark, f"{tmp_path}/files").collect()}
    assert found == {(r["header"], bytes(r["payload"]) if "Type: response" in r["header"] else b"") for r in records.values()}


def test_archive_of_repeated_rows_and_short_payloads(spark):
    rows = [(1, "u", "same"), (1, "u", "same"), (None, "v", "same"), (2, "w", "same")]
    got = sorted((str(r["page_id"]), r["record_type"], r["refers_to"]) for r in warc.archive_round_trip(frame(spark, rows)).collect())
    assert got == [("1", "response", None), ("1", "revisit", 1), ("2", "revisit", 1), ("None", "revisit", 1)]
    assert {r["record_type"] for r in warc.archive_round_trip(frame(spark, rows), min_bytes=5).collect()} == {"response"}
    assert warc.archive_round_trip(frame(spark, [])).count() == 0


def test_damage_is_seen(spark, tmp_path):
    warc.write_archive(frame(spark, PAGES), f"{tmp_path}/a")
    spark.read.parquet(f"{tmp_path}/a/payloads").withColumn("payload", F.lit(b"x")).write.parquet(f"{tmp_path}/b/payloads")
    spark.read.parquet(f"{tmp_path}/a/records").write.parquet(f"{tmp_path}/b/records")
    with pytest.raises(Exception, match="damaged payload"):
        warc.read_archive(spark, f"{tmp_path}/b").collect()


URLS = ["http://WWW.Example.com/en/1?x=1", "https://a.example.com/en/", "https://example.com", "https://badexample.com/en/", "x.net/es/1", None, "",
        "https://a.net/es/9#t", "ftp://net/fr/", "https://a.net?/es/", "a://b://c.com/d", "https://u\n.com/\n/x?y", "https://org/a%20b?c&d=e&f"]


def test_urls(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url")
    odd = frame(spark, [(1000 + i, u, "") for i, u in enumerate(URLS)] + [(None, URLS[0], "")])
    both = pages.union(odd.select("page_id", "url"))
    known = both.collect()
    got = url_filter.judge(both, URL_RULES).collect()
    assert len(got) == len(known)
    urls = {r["page_id"]: r["url"] for r in known}
    for r in got:
        host, path = brute.split_url(urls[r["page_id"]])
        rule = brute.url_rule(host, path, URL_RULES)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule and rule.name)
        assert r["verdict"] == rule.verdict if rule else r["verdict"] in ("allow", "block")


def test_url_trees_learn(spark):
    good = [(f"https://news.site{i}.org/articles/{i}", 1) for i in range(150)]
    bad = [(f"http://x-{i * 7919}-win.biz/?a={i}&b={i}&c={i}&d=1", 0) for i in range(150)]
    labelled = spark.createDataFrame(good + bad, "url string, label int")
    pages = frame(spark, [(1, "https://news.fresh.org/articles/77", ""), (2, "http://x-993-win.biz/?a=1&b=2&c=3&d=1", "")])
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge(pages, [], labelled).collect()}
    assert got == {1: "allow", 2: "block"}


def test_urls_without_labels(spark):
    rules = [url_filter.Rule("block", "bad.com", "/")]
    got = lambda rows, rules, known=None: [r["verdict"] for r in url_filter.judge(frame(spark, rows), rules, known).collect()]
    assert got([(1, "https://ok.org/", ""), (2, None, "")], rules) == ["allow", "allow"]
    assert got([(1, "https://bad.com/", "")], rules) == ["block"] and got([], rules) == []


HTML = [
    ("", ""), ("plain &amp; text", "plain & text"), ("<p>a<p>b", "a\n\nb"), ("<div>a</div><div>b</div>", "a\nb"), ("a<br>b", "a\nb"),
    ("<ul><li>one<li>two<ul><li>deep</ul></ul>", "- one\n- two\n  - deep"), ("<ol start=3><li>a</li><li>b</li></ol>", "3. a\n4. b"),
    ("<table><tr><th>Name<th>Age<tr><td>Al<td>7<tr><td>Barbara<td>41</table>", "Name     Age\nAl       7\nBarbara  41"),
    ("<script>var t='</p>';x<b</script>t<style>p{}</style><!-- no <b>x</b> -->", "t"), ("<p hidden>no</p><p style='display: none'>no</p><span>yes</span>", "yes"),
    ("<head><title>T</title></head><body>b", "b"), ("<pre>\n a\n  b</pre>", " a\n  b"), ("<h1>T</h1>x <b>y</b>z", "T\n\nx yz"),
    ("<p>a <i>b</p>c", "a b\n\nc"), ("</p></div>x", "x"), ("a < b <3 c", "a < b <3 c"), ("<a href='x>y'>t</a>", "t"), ("<p>one<!-- open", "one"),
    ("<blockquote>q</blockquote>", "  q"), ("<td>a<td>b", "a\nb"), ("<![CDATA[c & d]]>", "c & d"), ("<script>never closed", ""), ("&nbsp;x&#233;", "\u00a0xé"),
    ("<div>" * 3000 + "deep", "deep"), ("<table><tr><td><table><tr><td>in</table><td>out</table>", "in  out"), ("<p", "")]


@pytest.mark.parametrize("page, text", HTML)
def test_rendering(page, text):
    assert html_text.render(page) == text


@pytest.mark.parametrize("page, text", [
    ("<table><tbody><form><tr><td>a<td>b</tr><tr><td>cc<td>d</tr></form></tbody></table>", "a   b\ncc  d"),
    ("<table><form><tr><td>a<td>b</form></table>", "a  b"),
    ("<table><tbody>stray<div>block</div><p>par</p><tr><td>a</td></tr></tbody></table>", "stray\nblock\npar\na"),
    ("<table><tbody><form hidden><tr><td>no</tr></form><tr><td><table><tr><td>in</table></tbody></table>", "in"),
    ('<img alt="5" screen"><p>lost text</p><a href="x">link</a>', "5\n\nlost text\n\nlink"),
    ("<a title=it's>one</a> <b>two</b> <a title='x>y' class=\"a\"id=b>three</a>", "one two three"), ("<a href=x=\"y>t</a> u", "t u"),
    ("<img alt=\"never closed><p>kept</p>", "kept"), ("<!-->x<!---->y<!-- no --!>z", "xyz"),
    ("<p aria-hidden=true>icon</p>", "icon"), ("<math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>no</annotation></math>", "x=1"),
    ("<svg><title>no</title><desc>no</desc><text>one</text><text>two</text><path d='M0'/></svg> three", "one two three")])
def test_all_visible_text(page, text):
    assert html_text.render(page) == text


_DEEP = 60_000


@pytest.mark.parametrize("page, text", [
    ("<div>" * 205 + '<script>var secret=1;</script><p style="display:none">hidden text</p>after', "after"),
    ("<div>" * _DEEP + "deep" + "</div>" * _DEEP + "<p>end", "deep\n\nend"),
    ("<b>" * _DEEP + "x<p>y</p>" + "</b>" * _DEEP + "z", "x\n\ny\n\nz"),
    ("<table><tr><td rowspan=2>a<td>b<tr><td>c<tr><td>d<td>e</table>", "a  b\n   c\nd  e"),
    ("<table><tr><td rowspan=0>a<td colspan=2>b<td>c<tr><td>d<td>e<td>f</table>", "a  b     c\n   d  e  f"),
    ("<table><tr><td>" + "word " * 16 + "<td>n<tr><td>x<td>m</table>",
     "word " * 11 + "word  n\nword word word word\nx" + " " * 60 + "m"),
    ("<table><tr><td>" + "w" * 80 + "<td>n<tr><td>x<td>m</table>", "w" * 80 + "\n   n\nx  m"),
    ('<div style="visibility:hidden">no<p style="visibility:visible">yes<span style="visibility:collapse">no</span></p>no</div>', "yes"),
    ('<table style="visibility:hidden"><tr><td>no<td style="visibility: visible">yes</table>', "yes"),
    ("<style>.a, #b{display:none} p.c {display:none} /* .d{display:none} */ @media print{.d{display:none}} .e>p{display:none}</style>"
     "<p class='x a'>1</p><p id=b>2</p><div class=c>3</div><p class=c>4</p><p class=d>5</p><div class=e><p>6</div>", "3\n\n5\n\n6"),
    ("<p class=a>1</p><style>.a{display:none}.a{display:block}</style><p class=b style='display:block'>2</p><style>.b{display:none}</style>", "1\n\n2"),
    ("<details><summary>more</summary>body</details><details open><summary>s</summary>shown</details>", "more\ns\nshown"),
    ("<select><option>a<option selected>b<option>c</select> <select multiple><option>d<option>e</select>", "b\nd\ne"),
    ("<input type=submit value=Go><input type=reset> <input type=hidden value=h><input value=typed>", "GoReset"),
    ("<p title=1 title=2 hidden=no>x</p><p id=a id=b>y</p><style>#b{display:none}</style>", "y"),
    ("<xmp>a &amp; <b></xmp><textarea>c &amp; d</textarea>", "a &amp; <b>c & d"),
])
def test_layout_and_visibility(page, text):
    assert html_text.render(page) == text


def test_extraction(spark, sf):
    rows = [(i, None, h) for i, (h, _) in enumerate(HTML)] + [(98, None, None), (99, None, "<p>" + "long text " * 50_000)]
    got = {r["page_id"]: r for r in html_text.extract(frame(spark, rows)).collect()}
    assert [got[i]["text"] for i in range(len(HTML))] == [t for _, t in HTML]
    assert got[98]["text"] == "" and got[98]["n_lines"] == 0 and got[99]["n_chars"] == 499_999
    assert html_text.extract(frame(spark, [])).count() == 0


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = con.execute(SQL[name])
    order = [c[0] for c in got.description]
    assert sorted(map(str, got.fetchall())) == sorted(str(tuple(r)) for r in QUERIES[name](spark, sf).select(*order).collect())
