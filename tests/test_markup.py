"""Pages and references as an HTML reader gives them: hand-written rows, and hostile pages in linear time."""

import time

import pytest
from pyspark.sql import functions as F

from postsift.functions import board_b, markup, text
from postsift.sources import pages


def apply(spark, function, *values):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, t string").select("k", function("t").alias("x"))
    return [r.x for r in rows.orderBy("k").collect()]


def page(inner="", before="", attributes="class='job-content'"):
    return (f"<html><body>{before}<section {attributes}><h1>Clerk</h1><div>About the job</div><div>Description</div><p>Line</p>{inner}"
            "<div>Tags</div><div>Accounting</div></section><footer>Footer</footer></body></html>")


PAGES = {
    "longer class word": page(before="<section class='job-content-sidebar'>side</section>"),
    "other attribute": page(before="<section data-class='job-content'>side</section>"),
    "name in a value": page(before="<section title=\" class='job-content'\">side</section>"),
    "in a comment": page(before="<!-- <section class='job-content'> -->"),
    "in a script": page(before="<script>var s = \"<section class='job-content'>\";</script>"),
    "no quotes": page(attributes="class=job-content"),
    "several words": page(attributes='id=x class = "a job-content\tb"'),
    "bracket in a value": page(attributes="title='a>b' class='job-content'"),
    "self-closed": page("<section/>"),
    "self-closed with a value": page("<section class='a'/>"),
    "nested": page("<section><section>x</section></section>").replace("x</section>", "</section>"),
    "nested dropped": page("<svg><svg><text>a</text></svg>ICON</svg><noscript>no</noscript>"),
    "script with tags": page("<script>if (a<b && c == '</div>') x = \"<section>\"</script>"),
    "upper case": page().replace("section", "SECTION"),
}


@pytest.mark.parametrize("name", list(PAGES))
def test_job_section_of_odd_pages(spark, name):
    found = board_b.board_b_fields(spark.createDataFrame([(PAGES[name],)], "html string")).first()
    assert (found.title, found.description, found.function, found.industry, found.is_job_page) == ("Clerk", "Line", "Accounting", "", True)


def test_element_ends_at_its_depth(spark):
    got = apply(spark, lambda t: board_b.element(t, "main"), "<main>a<main>b</main>c</main>d", "<main>a<main/>b</main>c", "<main>a<mainly></mainly>b</main>",
                "<main>open", "<p>none</p>", "<main></main>x", "<main title='</main>'>a</main>b", None)
    assert got == ["a<main>b</main>c", "a<main/>b", "a<mainly></mainly>b", "open", None, "", "a", None]
    assert apply(spark, board_b.job_container, "<p>no body tag</p>") == ["<p>no body tag</p>"]


def test_visible_text(spark):
    cases = {
        "<a title='x>y'>hi</a>": " hi ", "x<!-- a > b -->y": "x y", "1 < 2 <3": "1 < 2 <3", "a <b": "a  ", "a<br/>b</>c": "a b c",
        "<STYLE>p{}</style >x<script>y": " x ", "<p title=don't>x</p>": " x ", "<a href=x?y=1&z=/>t</a>": " t ", "<?php 1 > 0 ?>z": "  0 ?>z",
        "<img alt=\"a 'b' > c\"/>d": " d", "": "", "plain": "plain"}
    assert dict(zip(cases, apply(spark, text.bare_text, *cases))) == cases
    assert apply(spark, text.bare_text, None) == [None]


def test_character_references(spark):
    cases = {
        "a &nbsp b": "a \xa0 b", "&copy2024": "©2024", "&ampx": "&x", "&notit;": "¬it;", "&notin;": "∉", "&AMP;&AMP": "&&", "&apos;": "'", "&apos": "&apos",
        "&amp;nbsp;": "&nbsp;", "&#65 z&#x42;&#67": "A zBC", "&#0;&#xD800;": "��", "&foo; & &;": "&foo; & &;", "&lt;b&gt": "<b>", "&sup2;&sup23": "²²3",
        "&eacute&Eacute;": "éÉ"}
    assert dict(zip(cases, apply(spark, text.decode_entities, *cases))) == cases
    links = {"?a=1&copy=2": "?a=1&copy=2", "?a&amp;b": "?a&b", "?a&copyx": "?a&copyx", "x&copy": "x©"}
    assert dict(zip(links, apply(spark, lambda t: text.decode_entities(t, in_attribute=True), *links))) == links


def test_attributes(spark):
    cases = {
        "<a href='x'>": "x", "<a HREF = \"x y\">": "x y", "<a href=/x/>": "/x/", "<a data-href=1 href=2>": "2", "<a title=\"href='3'\" href=4>": "4",
        "<a href>": "", "<a b=c>": "", "<a href=1 href=2>": "1", "<a/href=5>": "5", "<a =x href=6>": "6", "<a b='1'href=\"7\">": "7", "<a href=''>": ""}
    assert dict(zip(cases, apply(spark, lambda t: markup.attribute(t, "href"), *cases))) == cases


def test_links_of_a_page(spark):
    html = ('<!-- <a href="/l/comment">c</a> --><script>var x = "<a href=/l/script>";</script><a title="a>b" href="/l/y?a=1&copy=2&amp;b">y</a>'
            "<a href=/l/z/>z</a><a data-href='/l/data' HREF='http://h/l/own'><abbr href=/l/abbr><a href=' /l/blank'><a href='/other'>")
    assert apply(spark, lambda t: pages.page_links(t, "http://h", "/l/"), html) == [["http://h/l/own", "http://h/l/y?a=1&copy=2&b", "http://h/l/z/"]]


def test_company_links(spark):
    html = ('<!-- <a href="/company/0">No</a> --><a href="/company/1"><img></a><a href="/company/2">Company</a>'
            '<a title="x>y" href="/k/company/3"><b>Acme</b> &amp; Co, </a><a href="/company/4">Late</a>')
    assert apply(spark, board_b.company_from_link, html, '<a href="/jobs">Jobs</a>', "<a href=/company/1>Open") == ["Acme & Co", "", ""]


HOSTILE = ["<a" * 125_000, "<a " + "href=" * 50_000, "<script" * 35_000, '<a x="' * 41_000, "<a " + 'y="<a" ' * 35_000, "<svg></svg>" * 22_000,
           "<svg>" * 22_000 + "</svg>" * 22_000, "<!--" * 62_000, "<section class=job-content>" * 9_000, "&amp" * 62_000, "<" * 1_000_000,
           "<a href=/company/1>" * 12_000, "<section class=job-content>" + "<section>" * 12_000 + "</section>" * 12_000]


def test_hostile_pages_take_linear_time(spark):
    """A quarter of a megabyte of each, by every reader of pages."""
    readers = [text.strip_html, board_b.job_container, board_b.company_from_link, lambda t: pages.page_links(t, "http://h", "/l/").cast("string"),
               lambda t: markup.drop_elements(t, board_b.DROPPED_ELEMENTS), lambda t: text.node_text(t, " ")]
    table = spark.createDataFrame([(h,) for h in HOSTILE], "t string").repartition(4)
    for reader in readers:
        start = time.time()
        table.select(F.md5(reader("t"))).collect()
        assert time.time() - start < 2 * len(HOSTILE)
