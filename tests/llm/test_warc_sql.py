"""Whole WARC records: the operator's rows are those of the SQL, on pages full of references and links."""

import random
import time
from html.entities import html5

import duckdb

from palisade.llm import warc
from palisade.llm.oracle import OP2

PIECES = [
    "<p>", "</p>", "<br/>", "<b>", "</b>", "<script>var a = 1 < 2;</script>", "<style type=x>p {}</style>", "<!-- gone -->", " ", "\n", "\t", "text", "é",
    "<a href=\"/one?a=1&amp;b=2&copy=3\">", "<a href='two&eacute;'>", "<a class=\"x href=y\" HREF = three&#33;>", "<a data-href=\"no\" href=\"\">", "<a name=x>",
    "&", "&;", "&amp", "&amp;lt;", "&nosuch;", "&copyx", "&notit;", "&notin;", "&#0;", "&#x80;", "&#xD800;", "&#x110000;", "&#99999999999;",
    "&#65", "&#X41;", "&#1;", "&#xFFFE;", "&#;", "&#x;", "&#160;", "&nbsp;", "&sup2", "&sup=", "5 < 6", "<html lang=\"de\">", "<title>A &lt;B&gt;\nC</title>",
]


def test_records_equal_the_sql(spark):
    rng = random.Random(6)
    names = list(html5)
    pages = [(i, f"http://site/{i}", "".join(rng.choice(PIECES) if rng.random() < 0.8 else f"&{rng.choice(names)}" for _ in range(60)))
             for i in range(150)]
    pages += [(1000, None, None), (None, "u", ""), (1001, "u", "<p>x"), (1001, "u", "<p>x")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    records = warc.derivatives(warc.responses_of_pages(df))
    con = duckdb.connect()
    con.execute("create table pages (page_id bigint, url varchar, html varchar)")
    con.executemany("insert into pages values (?, ?, ?)", pages)
    wanted = con.execute(OP2)
    columns = [d[0] for d in wanted.description]
    assert sorted(columns) == sorted(c for c in records.columns if c in columns) and len(columns) == len(records.columns)
    assert sorted(map(repr, (tuple(r) for r in records.select(*columns).collect()))) == sorted(map(repr, wanted.fetchall()))


def test_hostile_pages_are_read_once(spark):
    n = 150_000
    pages = ["<script " * n, "<script>" * n, "<style " * n + "</style>", "<!-- " * n, "<b " * n, "<title>" * n, "<html " * n, "<a " + "x=1 " * n + "href=y>",
             "<a b=\"" * n, "&" * n, "<script>" * n + "</script" * n]
    df = spark.createDataFrame([(i, "u", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    started = time.time()
    rows = warc.derivatives(warc.responses_of_pages(df)).where("record_type = 'metadata'").select("page_id", "block").collect()
    assert time.time() - started < 60 and len(rows) == len(pages)
    assert {r["page_id"] for r in rows if "outlink: y\r\n" in r["block"]} == {7}
