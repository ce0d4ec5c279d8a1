"""Links of pages: counter-examples, the library's own HTML parser and the SQL twin."""

import random
from html.parser import HTMLParser

import duckdb
from pyspark.sql import functions as F

from lorespark.llm import url_filters


class Links(HTMLParser):
    """Targets of canonical links and refresh redirects, by a parser that knows comments and scripts."""

    def __init__(self):
        super().__init__()
        self.found = []

    def handle_starttag(self, tag, attrs):
        a = {}
        for k, v in attrs:
            a.setdefault(k, v or "")
        if tag == "link" and "canonical" in a.get("rel", "").lower().split():
            self.found.append("".join(a.get("href", "").split()))
        if tag == "meta" and a.get("http-equiv", "").strip().lower() == "refresh":
            _, _, to = a.get("content", "").partition("=")
            self.found.append(to.strip().strip("'\""))

    handle_startendtag = handle_starttag


def targets(html):
    p = Links()
    p.feed(html)
    p.close()
    return sorted(x for x in p.found if x)


def sql(rows):
    c = duckdb.connect()
    c.execute("create table pages (page_id bigint, url varchar, html varchar)")
    c.executemany("insert into pages values (?, ?, ?)", rows)
    return sorted(c.execute(url_filters.ORACLE_SQL).fetchall(), key=repr)


def verdicts(spark, rows):
    d = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted((tuple(r) for r in url_filters.judge(d, url_filters.RULES).select("page_id", "judged.*").collect()), key=repr)
    assert got == sql(rows)
    return {r[0]: r[4] for r in got}


def test_links_that_were_lost_or_invented(spark):
    to = "http://spam.net/y"
    rows = [
        (1, "http://a.example/1", f"<link\n rel='canonical'\n href='{to}'\n>"),
        (2, "http://a.example/2", f"<link rel='alternate canonical' href={to}>"),
        (3, "http://a.example/3", f"<!-- <link rel=canonical href='{to}'> -->"),
        (4, "http://a.example/4", f"<script>var x = \"<link rel=canonical href='{to}'>\";</script>"),
        (5, "http://a.example/5", f"<STYLE>/* <link rel=canonical href='{to}'> */</STYLE >"),
        (6, "http://a.example/6", f"<link rel=canonicals href='{to}'>"),
        (7, "http://a.example/7", f"<link data-rel=canonical href='{to}'>"),
        (8, "http://a.example/8", f"<link href='{to}' rel=\"\tCANONICAL\nnext\" />"),
        (9, "http://a.example/9", f"<meta content=\"3;\n URL='{to}'\" http-equiv=' Refresh '>"),
        (10, "http://a.example/10", f"<!-- open <link rel=canonical href='{to}'>"),
        (11, "http://b.example/x/../p", f"<link rel=canonical href='{to}'>"),
        (12, "http://b.example/p", None),
        (13, "http://b.example/./q/", f"<link rel=canonical href='{to}'>"),
        (14, "http://b.example/q/z/..", ""),
        (15, "http://b.example/../..", f"<link rel=canonical href='{to}'>"),
        (16, "http://b.example", None),
        (17, "http://c.example/d/e/f", "<link rel=canonical href='../g/./h?i'>"),
        (18, "http://c.example/d/g/h?i", f"<link rel=canonical href='{to}'>"),
    ]
    blocked = {k for k, v in verdicts(spark, rows).items() if v == "block"}
    assert blocked == {1, 2, 8, 9, 11, 12, 13, 14, 15, 16, 17, 18}


def test_links_equal_a_parser(spark):
    rng = random.Random(17)
    rel = ["canonical", "'canonical'", '"alternate canonical"', "stylesheet", '"canonical\nnext"', '""', "Canonical"]
    rows = []
    for i in range(300):
        html = []
        for _ in range(rng.randint(0, 4)):
            to = f"http://t.example/{rng.randrange(1000)}"
            q = rng.choice(["'", '"'])
            attrs = [f"rel={rng.choice(rel)}", f"href={q}{to}{q}", rng.choice(["", "title=\"a href=b rel=canonical\"", "media=all"])]
            rng.shuffle(attrs)
            space = rng.choice([" ", "\n", "\t "])
            tag = f"<{rng.choice(['link', 'LINK', 'Link'])}{space}{space.join(attrs)}{rng.choice(['', ' ', ' /'])}>"
            if rng.random() < 0.3:
                tag = f"<meta{space}http-equiv={rng.choice(['refresh', '\"Refresh\"', 'x-refresh'])}{space}content={q}{rng.choice(['0;', '5; ', ''])}url={to}{q}>"
            html.append(rng.choice(["{}", "{}", "<!-- {} -->", "<script>{}</script>", "<p>{}</p>", "<style>{}</style>"]).format(tag))
        rows.append((i, f"http://p.example/{i}", " canonical refresh ".join(html) or None))
    d = spark.createDataFrame(rows, "page_id long, url string, html string")
    links = url_filters.page_links(d.select("url", "html")).groupBy("a").agg(F.sort_array(F.collect_list("b")).alias("b"))
    got = {r.a: r.b for r in links.collect()}
    want = {u.removeprefix("http://"): [t.removeprefix("http://") for t in targets(h)] for _, u, h in rows if h and targets(h)}
    assert got == want and len(want) > 100
