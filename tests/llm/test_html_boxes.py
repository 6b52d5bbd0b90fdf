"""Site boxes with opaque class names inside articles."""

import pytest
from pyspark.sql import functions as F

from rosterlens.llm import html, queries
from tests.conftest import MEDIUM

BOX = "<div class='x1'><p>Join our readers today.</p><ul><li>One</li><li>Two</li></ul></div>"
STORY = "Story {i} tells at some length what happened to the person numbered {i} on that day."


def extracted(spark, rows):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    return {r["page_id"]: r["text"] for r in html.extract_main_text(pages).collect()}


def page(i, box=BOX, tag="article", story=STORY):
    return f"<body><{tag}><h1>Title {i}</h1><p>{story.format(i=i)}</p>{box}<p>And so it ended, {i} times.</p></{tag}></body>"


@pytest.mark.parametrize("tag", ["article", "main"])
def test_a_box_in_many_articles_goes(spark, tag):
    text = extracted(spark, [(i, "http://a.example.com/", page(i, tag=tag)) for i in range(30)])
    assert all(text[i] == f"Title {i}\n{STORY.format(i=i)}\nAnd so it ended, {i} times." for i in range(30))


def test_a_box_in_few_articles_or_on_other_hosts_stays(spark):
    rows = [(i, "http://a.example.com/", page(i, BOX if i < 2 else "")) for i in range(30)]
    rows += [(100 + i, f"http://h{i}.example.com/", page(100 + i)) for i in range(10)]
    text = extracted(spark, rows)
    assert all("Join our readers today.\nOne\nTwo" in text[i] for i in (0, 1, *range(100, 110)))


def test_a_reprinted_article_stays_whole(spark):
    """Ten prints of one article, each with another date box, whose sections would each recur on ten pages."""
    sections = "".join(f"<section><h2>Part {k}</h2><p>{'The same long text stands here. ' * (k + 2)}</p></section>" for k in range(4))
    rows = [(i, "http://a.example.com/", f"<body><article><div>Printed on day {i}</div>{sections}</article></body>") for i in range(10)]
    rows += [(i, "http://a.example.com/", page(i, "")) for i in range(10, 25)]
    text = extracted(spark, rows)
    for i in range(10):
        assert text[i].startswith(f"Printed on day {i}\nPart 0\n") and text[i].count("Part ") == 4


def test_paragraphs_headings_and_quotations_that_recur_stay(spark):
    shared = "<h2>What happened</h2><p>A passage that every article of this house quotes.</p><blockquote>Said and said again.</blockquote>"
    text = extracted(spark, [(i, "http://a.example.com/", page(i, shared)) for i in range(30)])
    assert all("What happened\nA passage that every article of this house quotes.\nSaid and said again." in text[i] for i in range(30))


def test_a_box_with_half_of_the_text_stays(spark):
    body = "<body><article><p>No. {i}</p><div><p>{t}</p></div></article></body>"
    text = extracted(spark, [(i, "http://a.example.com/", body.format(i=i, t="The text of the house. " * 5)) for i in range(10)])
    assert all(text[i].startswith(f"No. {i}\nThe text") for i in range(10))


def test_candidates_of_awkward_pages():
    for source in (None, "", "<article></article>", "<article><div></div></article>", "<article><div>only</div></article>"):
        assert not [h for h, around in html.template_candidates(source, 7) if around != 7]
    deep = "<article><p>" + "long " * 50 + "</p>" + "<div>" * 3000 + "deep" + "</div>" * 3000 + "</article>"
    assert len({around for _, around in html.template_candidates(deep)}) == 1
    assert "deep" in html.main_text(deep)


def test_the_method_reaches_the_given_pages(spark):
    """A box put into every given article goes, on hosts of three pages or more and where it is the smaller part."""
    pages = spark.read.parquet(f"{MEDIUM}/pages.parquet").withColumn("host", F.regexp_extract("url", "//([^/]*)", 1))
    boxed = pages.withColumn("html", F.regexp_replace("html", "</article>", BOX + "</article>"))
    plain = {r["page_id"]: r["text"] for r in queries.op3_html_extraction(spark, MEDIUM).collect()}
    hosts = {r["host"]: r["n"] for r in pages.groupBy("host").agg(F.countDistinct("html").alias("n")).collect()}
    long = 0
    for r in html.extract_main_text(boxed).collect():
        if hosts[r["host"]] >= 3 and len(plain[r["page_id"]]) > 100:
            long += 1
            assert r["text"] == plain[r["page_id"]]
    assert long > 200
