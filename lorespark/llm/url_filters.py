"""URL filters by redirect equivalence, in DataFrame functions only.

Rules (host, path, verdict) judge a url directly: a rule fits its host and all subdomains
where the url's path starts with the rule's; the longest host and path wins, and of equally
long ones an allow. Urls without a rule get their verdict from their aliases: canonical
links and refresh redirects of the pages (and any redirects given) are edges between urls,
and a connected component that holds a blocked url is blocked, except for those members
that a rule allows. All other urls are allowed.

A url's node is its lower-cased host, its path (none: ``/``) without dot segments and its
query; scheme and fragment do not count, so such variants of one url are one node. Tags in
comments, scripts and style sheets are no links; a tag may go over lines, ``rel`` may hold
several words, and attributes may stand in any order, quotes and case. Components come from
alternating-star rounds of joins (see ``common.components``); a hub is min-aggregated
before it is joined, and AQE can split its rows.

Rules are a table of any size: each distinct host meets them by an equi-join on its own
suffixes, which gives the host the rules that can fit it; a url then takes the longest of
its host's by path. Urls join the hosts' rules on the host; AQE broadcasts that table where
it measures it small and splits a crowded host's rows otherwise. Host, path and node are
columns that are computed once, so the generated code stays small.

Defined cases: a null url or one without ``://`` has empty host and path, no rule, no node
and is allowed; null html has no links; html of any length is searched whole; a repeated row
gives its row again; links to urls outside the table count; equal rules count once; other
columns stay, whatever their names, but for one named ``judged``, which is replaced; an empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Work, components

Rule = tuple[str, str, str]  # host, path, block or allow
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

RULES: list[Rule] = [
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
]


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise(F.lit(""))


def _folded(path: Column) -> Column:
    """The path without dot segments."""
    parts = F.split(path, "/")
    step = lambda kept, x: F.when(x == "..", F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0)))).when(x == ".", kept).otherwise(F.array_append(kept, x))
    kept = F.aggregate(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), F.array().cast("array<string>"), step)
    folded = F.concat(F.lit("/"), F.array_join(kept, "/"), F.when(path.rlike(r"/\.{1,2}$") & (F.size(kept) > 0), "/").otherwise(""))
    return F.when(path.rlike(r"/\.{1,2}(/|$)"), folded).otherwise(path)


def with_parts(df: DataFrame, url: str, mark: str = "") -> DataFrame:
    """df with ``__host``, ``__path`` and ``__node`` of a url column, each computed once; the node is null where it has none."""
    rest, host, path = (F.col(f"__{x}{mark}") for x in ("rest", "host", "path"))
    out = df.withColumn(f"__rest{mark}", _rest(F.col(url)))
    out = out.withColumn(f"__host{mark}", F.coalesce(F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER), F.lit("")))
    out = out.withColumn(f"__path{mark}", F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit("")))
    node = F.when(host != "", F.concat(host, F.when(path == "", "/").otherwise(_folded(path)), F.regexp_extract(rest, r"^[^?#]*(\?[^#]*)", 1)))
    return out.withColumn(f"__node{mark}", node).drop(f"__rest{mark}")


RULE = "host: string, path: string, verdict: string"


def host_rules(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """(__host, __rules): of each distinct host the rules that fit it or a domain above it.

    A rule is (how good, path, rule, verdict); the greatest that fits a path wins.
    """
    parts = F.split("__host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    asked = hosts.select("__host").where("__host <> ''").distinct().select("__host", F.explode(suffixes).alias("host"))
    length = (F.length("host") + F.length("path")).alias("length")
    known = rules.dropna().distinct().select("host", F.struct(length, (F.col("verdict") == "allow").alias("allow"), "path", F.concat("host", "path").alias("rule"), "verdict").alias("r"))
    return asked.join(known, "host").groupBy("__host").agg(F.collect_list("r").alias("__rules"))


def with_rule(work: Work, df: DataFrame, rules: DataFrame, name: str) -> DataFrame:
    """df, which has __host and __path, with ``__best``: the rule that wins, or null.

    The hosts' rules are a table of their own, so a crowded host's rows meet them without a shuffle or on one that AQE can split.
    """
    joined = df.join(work.save(host_rules(df, rules), name), "__host", "left")
    fits = F.filter("__rules", lambda r: F.startswith(F.col("__path"), r["path"]))
    return joined.withColumn("__best", F.array_max(fits)).drop("__rules")


ATTRIBUTES = r"""[^\s"'<>/=]+\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>]+)"""
UNSEEN = r"(?is)<!--.*?(?:-->|\z)|<(script|style)\b.*?(?:</\1\s*>|\z)"


def _value(attributes: Column, name: str) -> Column:
    """The value of the first attribute of a name, without its quotes; empty where there is none."""
    named = F.filter(attributes, lambda x: F.lower(F.regexp_extract(x, r"^[^\s=]+", 0)) == name)
    raw = F.regexp_extract(F.coalesce(F.get(named, F.lit(0)), F.lit("")), r"(?s)^[^=]*=\s*(.*)$", 1)
    return F.regexp_replace(raw, r"""^["']|["']$""", "")


def page_links(pages: DataFrame) -> DataFrame:
    """(a, b): the nodes of every canonical link and refresh redirect. pages: url, html."""
    tag, attributes, t, host, path = (F.col(x) for x in ("tag", "attributes", "t", "__host_f", "__path_f"))
    words = F.split(F.lower(_value(attributes, "rel")), r"\s+")
    refresh = F.regexp_extract(_value(attributes, "content"), r"""(?is)^[\s\d.;,]*url\s*=\s*['"]?([^"'\s>]+)""", 1)
    target = F.when(tag.rlike("(?i)^<link") & F.array_contains(words, "canonical"), F.trim(_value(attributes, "href"))).when(
        tag.rlike("(?i)^<meta") & (F.lower(F.trim(_value(attributes, "http-equiv"))) == "refresh"), refresh
    )
    tags = (
        pages.where(F.col("html").rlike("(?i)canonical|refresh"))
        .select("url", F.explode(F.regexp_extract_all(F.regexp_replace("html", UNSEEN, " "), F.lit(r"(?i)<(?:link|meta)\b[^>]*>"), F.lit(0))).alias("tag"))
        .where(tag.rlike("(?i)canonical|refresh"))
    )
    found = (
        tags.select("url", "tag", F.regexp_extract_all("tag", F.lit(ATTRIBUTES), F.lit(0)).alias("attributes"))
        .select("url", F.regexp_replace(F.replace(target, F.lit("&amp;"), F.lit("&")), r"\s", "").alias("t"))
        .where("t <> ''")
    )
    absolute = (  # of a target by its form
        F.when(t.contains("://"), t)
        .when(F.startswith(t, F.lit("//")), F.concat(F.lit("http:"), t))
        .when(F.startswith(t, F.lit("/")), F.concat(F.lit("http://"), host, t))
        .when(F.startswith(t, F.lit("#")), F.col("url"))
        .otherwise(F.concat(F.lit("http://"), host, F.when(path == "", "/").otherwise(F.regexp_replace(path, r"[^/]*$", "")), t))
    )
    ends = with_parts(found, "url", "_f").withColumn("to", absolute)
    return with_parts(ends, "to", "_t").select(F.col("__node_f").alias("a"), F.col("__node_t").alias("b"))


def judge(pages: DataFrame, rules: list[Rule] | DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """pages with a struct column ``judged`` (host, path, rule, verdict), replacing one of that name.

    pages has url and html; rules are (host, path, verdict); redirects, if given, has from_url and to_url.
    """
    spark = pages.sparkSession
    work = Work(spark, "urls")
    if isinstance(rules, DataFrame):
        rules = rules.select("host", "path", "verdict")
    else:  # literals of the plan
        rows = F.array(*[F.struct(*[F.lit(x).cast("string").alias(c) for x, c in zip(r, ("host", "path", "verdict"), strict=True)]) for r in rules])
        rules = spark.range(1).select(F.explode(rows.cast(f"array<struct<{RULE}>>").alias("r")).alias("r")).select("r.*")
    links = page_links(pages.select("url", "html"))
    if redirects is not None:
        ends = with_parts(with_parts(redirects.select("from_url", "to_url"), "from_url", "_f"), "to_url", "_t")
        links = links.union(ends.select("__node_f", "__node_t"))
    # written before anything filters on a and b: such a filter would be computed from the tag again, many times over
    links = work.save(links, "links")
    member = components(work, links)  # a null end or a link to itself joins nothing
    members = with_parts(member.select("component", F.concat(F.lit("http://"), F.col("node")).alias("url")), "url")
    judged = work.save(with_rule(work, members, rules, "member_hosts").select("component", F.col("__node").alias("node"), F.col("__best.verdict").alias("verdict")), "members")
    seeds = work.save(judged.where("verdict = 'block'").select("component").distinct(), "seeds")
    blocked = work.save(judged.join(seeds, "component", "left_semi").select(F.col("node").alias("__blocked")), "blocked")
    work.drop("links", "members", "seeds", "member_hosts")
    names = [c for c in pages.columns if c != "judged"]
    numbered = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)]  # so that no name clashes
    full = with_rule(work, with_parts(pages.select(*numbered, F.col("url").alias("__url")), "__url"), rules, "hosts").join(blocked, F.col("__node") == F.col("__blocked"), "left")
    by_alias = F.when(F.col("__blocked").isNotNull(), "block").otherwise("allow")
    out = F.struct(F.col("__host").alias("host"), F.col("__path").alias("path"), F.col("__best.rule").alias("rule"), F.coalesce(F.col("__best.verdict"), by_alias).alias("verdict"))
    return full.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], out.alias("judged"))


def op7_url_filters(spark, sf_dir: str) -> DataFrame:
    """Every page's host, path, winning rule and verdict."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return judge(pages, RULES).select("page_id", "judged.*")


_PATH = "regexp_extract(substr({u}, instr({u}, '://') + 3), '^[^/?#]*([^?#]*)', 1)"
_UP = """list_reduce(list_prepend('', string_split({p}, '/')[2:]), lambda kept, x: CASE x WHEN '..' THEN regexp_replace(kept, '/[^/]*$', '') WHEN '.' THEN kept ELSE kept || '/' || x END)"""
_NODE = """CASE WHEN {u} LIKE '%://%' AND regexp_extract(substr({u}, instr({u}, '://') + 3), '^[^/?#]*') <> '' THEN
  translate(regexp_extract(substr({u}, instr({u}, '://') + 3), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
  || CASE WHEN {p} = '' THEN '/' WHEN {p} LIKE '%/.' OR {p} LIKE '%/..' THEN {up} || '/' WHEN {up} = '' THEN '/' ELSE {up} END
  || regexp_extract(substr({u}, instr({u}, '://') + 3), '^[^?#]*(\\?[^#]*)', 1) END""".replace("{up}", _UP).replace("{p}", _PATH)
_ATTRIBUTE = """trim(regexp_extract(tag, '(?is)[\\s"''/]{n}\\s*=\\s*("[^"]*"|''[^'']*''|[^\\s"''>]+)', 1), '"''')"""
_FITS = "((host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '{p}'))"


def _case(what: int) -> str:
    order = sorted(RULES, key=lambda r: -len(r[0]) - len(r[1]))
    return "CASE " + " ".join(f"WHEN {_FITS.format(h=h, p=p)} THEN '{(h + p, v)[what]}'" for h, p, v in order) + " END"


ORACLE_SQL = f"""
WITH RECURSIVE base AS (
  SELECT page_id, url, html, CASE WHEN url LIKE '%://%' THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, url, html, coalesce({_NODE.format(u="url")}, '') AS node,
    translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM base),
bare AS (
  SELECT url, host, path, array_to_string(list_transform(string_split(html, '<!--'), lambda x, i: CASE WHEN i = 1 THEN x WHEN contains(x, '-->') THEN ' ' || substr(x, instr(x, '-->') + 3) ELSE '' END), '') AS html
  FROM parts WHERE lower(html) LIKE '%canonical%' OR lower(html) LIKE '%refresh%'),
seen AS (
  SELECT url, host, path, array_to_string(list_transform(string_split_regex(html, '(?i)<(?:script|style)\\b'),
    lambda x, i: CASE WHEN i = 1 THEN x WHEN regexp_matches(x, '(?i)</(script|style)') THEN regexp_replace(x, '(?is)^.*?</(script|style)\\s*>', ' ') ELSE '' END), '') AS html FROM bare),
tags AS (
  SELECT url, host, path, unnest(regexp_extract_all(html, '(?i)<(?:link|meta)\\b[^>]*>')) AS tag FROM seen),
plain AS (  -- no other attribute's value may look like one of these
  SELECT url, host, path, regexp_replace(tag, '(?is)[\\s"''/](title|alt|media)\\s*=\\s*("[^"]*"|''[^'']*'')', ' ', 'g') AS tag FROM tags),
found AS (
  SELECT url, host, path, replace(CASE
    WHEN lower(tag) LIKE '<link%' AND list_contains(string_split_regex(lower({_ATTRIBUTE.replace("{n}", "rel")}), '\\s+'), 'canonical') THEN trim({_ATTRIBUTE.replace("{n}", "href")})
    WHEN lower(tag) LIKE '<meta%' AND lower(trim({_ATTRIBUTE.replace("{n}", "http-equiv")}, E' \\t\\n')) = 'refresh' THEN regexp_extract({_ATTRIBUTE.replace("{n}", "content")}, '(?is)^[\\s\\d.;,]*url\\s*=\\s*[''"]?([^"''\\s>]+)', 1)
    END, '&amp;', '&') AS t FROM plain),
absolute AS (
  SELECT url AS f, CASE WHEN t LIKE '%://%' THEN t WHEN t LIKE '//%' THEN 'http:' || t WHEN t LIKE '/%' THEN 'http://' || host || t
    WHEN t LIKE '#%' THEN url ELSE 'http://' || host || CASE path WHEN '' THEN '/' ELSE regexp_replace(path, '[^/]*$', '') END || t END AS g
  FROM found WHERE t <> ''),
edges AS (
  SELECT a, b FROM (SELECT {_NODE.format(u="f")} AS a, {_NODE.format(u="g")} AS b FROM absolute) WHERE a IS NOT NULL AND b IS NOT NULL AND a <> b),
sym AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
seed AS (
  SELECT DISTINCT n FROM (SELECT a AS n, regexp_extract(a, '^[^/?#]*') AS host, regexp_extract(a, '^[^/?#]*([^?#]*)', 1) AS path FROM sym) WHERE {_case(1)} = 'block'),
reach(n) AS (SELECT n FROM seed UNION SELECT s.b FROM reach r JOIN sym s ON s.a = r.n)
SELECT page_id, host, path, {_case(0)} AS rule,
  coalesce({_case(1)}, CASE WHEN node <> '' AND node IN (SELECT n FROM reach) THEN 'block' ELSE 'allow' END) AS verdict
FROM parts
"""
