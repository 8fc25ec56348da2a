"""Operator 10: URL verdicts from host and path rules, carried over aliases.

A rule (host, path, verdict) fits its host and all subdomains of it if the
url's path starts with the rule's; the longest wins, allow before block on a tie.  Urls
that redirect or name a canonical address are one resource: the connected
components of those edges, over urls without scheme and fragment.  A url without
a rule takes its component's verdict: allow if a rule allows any member, else
block if a rule blocks one, else allow.  A rule on the url itself comes first.
Members are all ends of the edges, whether or not they are pages themselves.

Native DataFrame operations only.  Distinct (host, path) pairs are matched, by
equality joins on host suffixes and path prefixes, so neither copies nor many
rules of one host multiply; flags are summed before the join with the pages.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from convlens.llm.common import table
from convlens.llm.components import connected_components

#: The contract's rules.
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]

#: A tag, with ``>`` allowed in quoted values; its attributes (name, value); the target of a refresh.
TAG = r"""(?is)<%s\s(?:[^>=]*+(?:=(?:\s*+(?:"[^"]*+"|'[^']*+'))?+[^>=]*+){0,100}+>|[^>]*>)"""
ATTRIBUTE = r"""([^\s=>"'/]+)\s*=\s*("[^"]*"|'[^']*'|[^\s>"'][^\s>]*)"""
REFRESH_URL = r"""(?is)^(?:\s*[\d.]+[\s;,]+(?:url\s*=\s*)?|.*?url\s*=\s*)["']?([^"']*)"""
SCHEME = r"^[A-Za-z][A-Za-z0-9+.\-]*:"


def _after_scheme(url: Column) -> Column:
    """What follows the first ``://``; null if there is none."""
    at = F.instr(url, "://")
    return F.when(at > 0, url.substr(at + 3, F.length(url)))


def _lower(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def host_of(url: Column) -> Column:
    return F.coalesce(_lower(F.regexp_extract(_after_scheme(url), r"^([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def resource_of(url: Column) -> Column:
    """The url without scheme and fragment; null if it has no scheme."""
    rest = _after_scheme(url)
    return F.concat(host_of(url), F.regexp_extract(rest, r"^[^/?#]*([^#]*)", 1))


def _tags(html: Column, name: str) -> Column:
    return F.regexp_extract_all(html, F.lit(TAG % name), F.lit(0))


def _attribute(tag: Column, name: str) -> Column:
    """The value of the tag's first attribute of that name, without quotes; null if there is none."""
    names = F.transform(F.regexp_extract_all(tag, F.lit(ATTRIBUTE), F.lit(1)), _lower)
    value = F.get(F.regexp_extract_all(tag, F.lit(ATTRIBUTE), F.lit(2)), (F.array_position(names, name) - 1).cast("int"))
    bare = F.when(value.rlike("^[\"']"), value.substr(F.lit(2), F.length(value) - 2)).otherwise(value)
    return F.trim(F.regexp_replace(bare, "&(?:amp|#38|#x26);", "&"))


def _without_dots(path: Column) -> Column:
    """A path that begins with a slash, its ``.`` and ``..`` carried out."""
    parts = F.split(F.substring(path, 2, 2**31 - 1), "/")
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda a, x: F.when(x == ".", a).when(x == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(x))))
    return F.concat(F.lit("/"), F.array_join(kept, "/"), F.when(F.element_at(parts, -1).isin(".", "..") & (F.size(kept) > 0), "/").otherwise(""))


def resolved(target: Column, url: Column) -> Column:
    """The full url that a page at ``url`` means by ``target``; null if that is
    the page itself or has a scheme without ``://``."""
    scheme, base = F.regexp_extract(url, r"^(.*?)://", 1), F.regexp_extract(url, r"^(.*?://[^/?#]*)", 1)
    path, rest = F.regexp_extract(target, r"^([^?#]*)", 1), F.regexp_extract(target, r"^[^?#]*(.*)", 1)
    folder = F.regexp_extract(path_of(url), r"^(.*/)", 1)
    folder = F.when(folder == "", "/").otherwise(folder)
    return (
        F.when(target.rlike(SCHEME + "//"), target)
        .when((F.instr(url, "://") == 0) | (target == "") | target.startswith("#") | target.rlike(SCHEME), None)
        .when(target.startswith("//"), F.concat(scheme, F.lit(":"), target))
        .when(target.startswith("?"), F.concat(base, path_of(url), target))
        .otherwise(F.concat(base, _without_dots(F.when(path.startswith("/"), path).otherwise(F.concat(folder, path))), rest))
    )


def alias_edges(pages: DataFrame) -> DataFrame:
    """(url, alias): all refreshes to and canonical addresses at another url, made full, as the pages' html states them."""
    canonical = F.filter(_tags(F.col("html"), "link"), lambda t: F.array_contains(F.split(_lower(_attribute(t, "rel")), r"\s+"), "canonical"))
    refresh = F.filter(_tags(F.col("html"), "meta"), lambda t: _lower(_attribute(t, "http-equiv")) == "refresh")
    targets = F.concat(F.transform(canonical, lambda t: _attribute(t, "href")), F.transform(refresh, lambda t: F.trim(F.regexp_extract(_attribute(t, "content"), REFRESH_URL, 1))))
    found = pages.where(F.col("url").isNotNull()).select(F.col("url").cast("string").alias("url"), F.explode(targets).alias("target"))
    return found.select("url", resolved(F.col("target"), F.col("url")).alias("alias")).where("alias <> ''")


def _matched(places: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, rule, verdict) of the distinct places that a rule fits."""
    rules = rules.select("host", "path", "verdict").where("host IS NOT NULL AND path IS NOT NULL")
    rules = rules.groupBy(F.col("host").alias("r_host"), F.col("path").alias("r_path")).agg(F.min("verdict").alias("r_verdict"))
    lengths = rules.groupBy("r_host").agg(F.collect_set(F.length("r_path")).alias("lengths"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    at = places.where("host <> ''").withColumn("r_host", F.explode(suffixes)).join(lengths, "r_host")
    tried = at.withColumn("n", F.explode("lengths")).where("n <= length(path)").select("host", "path", "r_host", F.expr("left(path, n)").alias("r_path"))
    fits = tried.join(rules, ["r_host", "r_path"])
    # no tie is left: two fitting rules of equal length would have to share a host or be one
    best = F.struct((F.length("r_host") + F.length("r_path")).alias("n"), (F.col("r_verdict") == "allow").alias("a"), F.concat("r_host", "r_path").alias("rule"), F.col("r_verdict").alias("verdict"))
    return fits.groupBy("host", "path").agg(F.max(best).alias("best")).select("host", "path", "best.rule", F.col("best.verdict").alias("ruled"))


def judge(pages: DataFrame, rules: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row of ``pages`` (page_id,
    url).  ``edges`` (url, alias) are redirects and canonical links.  Null urls
    and urls without ``://`` have an empty host and path, fit no rule and are
    allowed; null ids and repeated rows stay as they are."""
    url = F.col("url").cast("string")
    flat = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), resource_of(url).alias("resource"))
    places = flat.select("host", "path")
    if edges is not None:
        pairs = edges.select(resource_of(F.col("url")).alias("u"), resource_of(F.col("alias")).alias("v")).where("u IS NOT NULL AND v IS NOT NULL")
        nodes = connected_components(pairs, "aliases").select(F.col("node").alias("resource"), "component")
        nodes = nodes.withColumns({"host": F.regexp_extract("resource", r"^([^/?]*)", 1), "path": F.regexp_extract("resource", r"^[^/?]*([^?]*)", 1)})
        places = places.union(nodes.select("host", "path"))
    matched = _matched(places.distinct(), rules)
    out = flat.join(matched, ["host", "path"], "left")
    if edges is not None:
        spread = nodes.join(matched, ["host", "path"]).groupBy("component").agg(F.min("ruled").alias("spread"))  # 'allow' before 'block'
        out = out.join(nodes.join(spread, "component").select("resource", "spread"), "resource", "left")
    else:
        out = out.withColumn("spread", F.lit(None).cast("string"))
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", "spread", F.lit("allow")).alias("verdict"))


def op10_url_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: every page under the contract's rules and its own html's alias edges."""
    pages = table(spark, sf_dir, "pages")
    return judge(pages, spark.createDataFrame(RULES, "host string, path string, verdict string"), alias_edges(pages))


OP10_SQL = r"""
WITH RECURSIVE rules(r_host, r_path, r_verdict) AS (VALUES
  ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
parts AS (
  SELECT page_id, html, instr(url, '://') AS at, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
flat AS (
  SELECT page_id, html,
    coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path,
    regexp_extract(rest, '^[^/?#]*([^#]*)', 1) AS tail, rest FROM parts),
named AS (
  SELECT page_id, host, path, CASE WHEN rest IS NOT NULL THEN host || tail END AS resource,
    [regexp_extract(regexp_extract(html, '(?is)<link\s[^>]*rel\s*=\s*["'']?canonical["''\s][^>]*>'), '(?is)\shref\s*=\s*["'']([^"''>]*)["'']', 1),
     regexp_extract(regexp_extract(html, '(?is)<meta\s[^>]*http-equiv\s*=\s*["'']?refresh["''\s][^>]*>'), '(?is)url\s*=\s*([^"''>\s]+)', 1)] AS targets FROM flat),
links AS (SELECT resource AS u, unnest(targets) AS target FROM named),
ends AS (SELECT u, CASE WHEN instr(target, '://') > 0 THEN substr(target, instr(target, '://') + 3) END AS rest FROM links),
pairs AS (
  SELECT u, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || regexp_extract(rest, '^[^/?#]*([^#]*)', 1) AS v
  FROM ends WHERE u IS NOT NULL AND rest IS NOT NULL),
edges AS (SELECT u, v FROM pairs UNION SELECT v, u FROM pairs),
reach(a, b) AS (SELECT u, v FROM edges UNION SELECT reach.a, edges.v FROM reach JOIN edges ON reach.b = edges.u),
member AS (SELECT a AS resource, least(a, min(b)) AS component FROM reach GROUP BY a),
fits AS (
  SELECT p.host, p.path, r_host || r_path AS rule, r_verdict,
    row_number() OVER (PARTITION BY p.host, p.path ORDER BY length(r_host) + length(r_path) DESC, r_verdict) AS k
  FROM (SELECT DISTINCT host, path FROM named) p JOIN rules ON (p.host = r_host OR ends_with(p.host, '.' || r_host)) AND starts_with(p.path, r_path)),
ruled AS (
  SELECT n.page_id, n.host, n.path, f.rule, f.r_verdict, coalesce(m.component, n.resource) AS component
  FROM named n LEFT JOIN fits f ON n.host = f.host AND n.path = f.path AND f.k = 1 LEFT JOIN member m ON n.resource = m.resource),
spread AS (SELECT component, min(r_verdict) AS verdict FROM ruled WHERE r_verdict IS NOT NULL GROUP BY component)
SELECT page_id, host, path, rule, coalesce(r_verdict, s.verdict, 'allow') AS verdict FROM ruled LEFT JOIN spread s ON ruled.component = s.component
"""
