"""URL filters over redirect-equivalent addresses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grainsift.llm._common import cut, keep_columns, renamed, table
from grainsift.llm.components import connected_components

BLOCKED_HOSTS = ("spam-farm.example.org", "cheap-pills.example.com")
ALLOWED_PREFIXES = ("https://spam-farm.example.org/en/",)

# patterns that Java and RE2 read alike
FRAGMENT = r"#.*$"
TRACKING = r"(utm_[a-z]+|ref|gclid|fbclid)=[^&]*(&|$)"
LOOSE = r"[?&]+$"
ADDRESS = r"^[hH][tT][tT][pP][sS]?://([^/?]*)([^?]*)(.*)$"
HOST_PARTS = r"^(www|m)\.|:(80|443)$"
SLASHES = r"/+$"
# the patterns of the SQL; link_edges reads every spelling
CANONICAL = r"(?i)<link [^>]*rel=[\"']?canonical[\"']?[^>]* href=[\"']([^\"']+)[\"']"
REFRESH = r"(?i)<meta [^>]*http-equiv=[\"']?refresh[\"']?[^>]* content=[\"'][0-9]+; ?url=([^\"']+)[\"']"

# a comment, a script or a whole tag: ">" may stand in quotes; possessive, as loops over alternatives would recurse on long tags
MARKUP = r"(?is)<!--.*?-->|<script(?:\s[^>]*)?>.*?</script\s*>|<style(?:\s[^>]*)?>.*?</style\s*>|<(?:link|meta)(?=[\s/])(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>"
TARGET = r"(?is)^\s*[0-9.]*\s*[;,]?\s*url\s*=\s*(?:\"([^\"]*)|'([^']*)|([^\"'].*))"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value named once, so that expressions don't multiply."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def attribute(tag: Column, name: str) -> Column:
    """The first attribute of that name, in any quoting; empty if there is none."""
    # attributes before it are read whole, so that a name inside a value isn't taken for one
    other = r"[\s/]+(?!" + name + r"[\s=/>])[^\s=/>\"']+(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>\"']+))?"
    found = rf"(?is)^<[a-z]+(?:{other})*+[\s/]+{name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))"
    return F.trim(F.replace(F.concat(*[F.regexp_extract(tag, found, i) for i in (1, 2, 3)]), F.lit("&amp;"), F.lit("&")))


def resolve(base: Column, link: Column) -> Column:
    """A link (absolute or relative) against an absolute address, as RFC 3986 has it,
    without fragment; an empty link stays empty."""
    return _let(_joined(base, F.regexp_replace(link, FRAGMENT, "")), _undotted)


def _joined(base: Column, link: Column) -> Column:
    scheme, root = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*:)", 1), F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    path = F.regexp_replace(F.substring(base, F.length(root) + 1, F.length(base)), r"[?#].*$", "")
    folder = F.concat(F.lit("/"), F.regexp_extract(path, r"^/?(.*/)?[^/]*$", 1))
    return (
        F.when(link == "", "")
        .when(link.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), link)
        .when(link.startswith("//"), F.concat(scheme, link))
        .when(root == "", "")
        .when(link.startswith("/"), F.concat(root, link))
        .when(link.startswith("?"), F.concat(root, path, link))
        .otherwise(F.concat(root, folder, link))
    )


def _undotted(whole: Column) -> Column:
    head = F.regexp_extract(whole, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?]*)", 1)
    rest = F.substring(whole, F.length(head) + 1, F.length(whole))
    query = F.regexp_extract(rest, r"(\?.*)$", 1)
    steps = F.split(F.substring(rest, F.lit(1), F.length(rest) - F.length(query)), "/", -1)
    # dots: a step up takes the last step but never the root
    up = lambda acc, x: F.when(x == ".", acc).when(x == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(1)))).otherwise(F.concat(acc, F.array(x)))
    last = F.element_at(steps, -1)
    clean = F.aggregate(steps, F.array().cast("array<string>"), up, lambda acc: F.when(last.isin(".", ".."), F.concat(acc, F.array(F.lit("")))).otherwise(acc))
    dotted = (head != "") & rest.rlike(r"/\.\.?(?:[/?]|$)")
    return F.when(dotted, F.concat(head, F.array_join(clean, "/"), query)).otherwise(whole)


def normal_url(url: Column) -> Column:
    """The address that scheme, www/m hosts, default ports, fragments, tracking
    parameters and closing slashes redirect to. What isn't HTTP stays as it is."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(url, FRAGMENT, ""), TRACKING, ""), LOOSE, "")
    host = F.regexp_replace(F.lower(F.regexp_extract(bare, ADDRESS, 1)), HOST_PARTS, "")
    path = F.regexp_replace(F.regexp_extract(bare, ADDRESS, 2), SLASHES, "")
    return F.when(host == "", bare).otherwise(F.concat(F.lit("https://"), host, path, F.regexp_extract(bare, ADDRESS, 3)))


def link_edges(pages: DataFrame) -> DataFrame:
    """``(u, v)``: each address to its normal form, and that to the normal forms of
    the page's canonical link and its refresh target. Tags are read whole, with
    attributes in any order and quoting, outside comments and scripts; of several the
    first counts; relative targets are resolved against the page's address."""
    src = keep_columns(pages, "url", "html").where("url is not null and url <> ''").withColumn("n", normal_url(F.col("url")))
    own = src.select(F.col("url").alias("u"), F.col("n").alias("v"))
    tags = F.filter(F.regexp_extract_all(F.col("html"), F.lit(MARKUP), F.lit(0)), lambda t: t.rlike("(?i)^<(link|meta)"))
    tagged = src.where(F.col("html").rlike(r"(?i)canonical|refresh")).select("url", "n", tags.alias("tags"))
    links = F.filter("tags", lambda t: t.rlike("(?i)^<link") & F.array_contains(F.split(F.lower(attribute(t, "rel")), r"\s+"), "canonical") & (attribute(t, "href") != ""))
    moves = F.filter("tags", lambda t: t.rlike("(?i)^<meta") & (F.lower(attribute(t, "http-equiv")) == "refresh") & attribute(t, "content").rlike(TARGET))
    href = _let(F.get(links, F.lit(0)), lambda t: attribute(t, "href"))
    content = _let(F.get(moves, F.lit(0)), lambda t: attribute(t, "content"))
    target = _let(content, lambda c: F.trim(F.concat(*[F.regexp_extract(c, TARGET, i) for i in (1, 2, 3)])))
    found = cut(tagged.select("url", "n", F.explode(F.array(href, target)).alias("link")).where("link <> ''"))
    edges = cut(found.select(F.col("n").alias("u"), _let(resolve(F.col("url"), F.col("link")), normal_url).alias("v")).where("v rlike '^https://'"))
    return own.unionByName(edges).where("u <> v").distinct()


STATUS = r"^HTTP/[0-9.]+ +3[0-9][0-9]"
LOCATION = r"(?im)^location:[ \t]*([^\r\n]*?)[ \t]*$"


def response_edges(responses: DataFrame) -> DataFrame:
    """``(u, v)`` from HTTP redirects in ``responses(target_uri, http_headers)``, such as
    WARC files hold: of status 3xx, from the address to the ``Location``, relative
    ones resolved; both in normal form, the address to its own normal form too.
    Nulls, other statuses, empty targets and loops give none."""
    src = keep_columns(responses, "target_uri", "http_headers").where("target_uri is not null and target_uri <> ''").withColumn("n", normal_url(F.col("target_uri")))
    own = src.select(F.col("target_uri").alias("u"), F.col("n").alias("v"))
    moved = src.where(F.col("http_headers").rlike(STATUS)).select("target_uri", "n", F.regexp_extract("http_headers", LOCATION, 1).alias("link")).where("link <> ''")
    edges = moved.select(F.col("n").alias("u"), _let(resolve(F.col("target_uri"), F.col("link")), normal_url).alias("v")).where("v rlike '^https://'")
    return own.unionByName(edges).where("u <> v").distinct()


def _any(column: Column, tests: list[Column]) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return F.coalesce(out, F.lit(False))


def listed(urls: DataFrame, hosts: tuple[str, ...] = BLOCKED_HOSTS, prefixes: tuple[str, ...] = ALLOWED_PREFIXES) -> DataFrame:
    """``(node, blocked, allowed)`` by the lists: hosts with their subdomains are
    blocked, addresses that begin as listed are allowed."""
    host = F.lower(F.regexp_extract(F.col("node"), ADDRESS, 1))
    blocked = _any(host, [(host == h) | host.endswith("." + h) for h in hosts])
    return urls.select("node", blocked.alias("blocked"), _any(host, [F.col("node").startswith(p) for p in prefixes]).alias("allowed"))


def decide(pages: DataFrame, edges: DataFrame | None = None, hosts: tuple[str, ...] = BLOCKED_HOSTS, prefixes: tuple[str, ...] = ALLOWED_PREFIXES) -> DataFrame:
    """``pages`` with ``component`` (its least address) and ``decision``.

    Addresses linked by redirects or canonical links, in either direction and over
    any number of steps, are one component. An address explicitly allowed is
    ``allow``, whatever else holds; otherwise it is ``block`` if any address of its
    component is blocked, and else ``none``. An allowance doesn't spread. ``edges(u,
    v)`` (default: those of ``link_edges``) may have nulls, loops and repeats.
    Repeated rows get the same answer; a null or empty url is alone: component null,
    decision ``none``. An empty table stays empty.

    Components take two aggregations and two joins a round on edges alone, pages are
    joined once, by address.
    """
    inner, at = renamed(pages)
    url = F.col(at["url"])
    edges = link_edges(pages) if edges is None else keep_columns(edges, "u", "v")
    own = inner.where(url.isNotNull() & (url != "")).select(url.alias("u"), url.alias("v"))
    groups = connected_components(edges.unionByName(own))
    marked = cut(listed(groups.select("node"), hosts, prefixes).join(groups, "node"))
    bad = cut(marked.where("blocked").select("component").distinct().withColumn("bad", F.lit(True)))  # so that a giant component's rows can be split in the join
    found = marked.join(bad, "component", "left").select("node", "component", F.when(F.col("allowed"), "allow").when(F.col("bad"), "block").otherwise("none").alias("decision"))
    out = inner.join(found, url == F.col("node"), "left").select(*inner.columns, "component", F.coalesce("decision", F.lit("none")).alias("decision"))
    return out.toDF(*pages.columns, "component", "decision")


def op3_url_redirects(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return decide(pages.select("page_id", "url"), link_edges(pages))


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _sql_normal(x: str) -> str:
    bare = f"regexp_replace(regexp_replace(regexp_replace({x}, {_q(FRAGMENT)}, '', 'g'), {_q(TRACKING)}, '', 'g'), {_q(LOOSE)}, '', 'g')"
    host = f"regexp_replace(lower(regexp_extract({bare}, {_q(ADDRESS)}, 1)), {_q(HOST_PARTS)}, '', 'g')"
    path = f"regexp_replace(regexp_extract({bare}, {_q(ADDRESS)}, 2), {_q(SLASHES)}, '', 'g')"
    return f"CASE WHEN {host} = '' THEN {bare} ELSE 'https://' || {host} || {path} || regexp_extract({bare}, {_q(ADDRESS)}, 3) END"


_HOST = f"lower(regexp_extract(url, {_q(ADDRESS)}, 1))"
SQL = f"""
WITH RECURSIVE norm AS (SELECT url, {_sql_normal("url")} AS n, html FROM pages WHERE url <> ''),
links AS (
  SELECT url AS u, n AS v FROM norm
  UNION SELECT n, {_sql_normal(f"regexp_extract(html, {_q(CANONICAL)}, 1)")} FROM norm WHERE regexp_matches(html, {_q(CANONICAL)})
  UNION SELECT n, {_sql_normal(f"regexp_extract(html, {_q(REFRESH)}, 1)")} FROM norm WHERE regexp_matches(html, {_q(REFRESH)})),
kept AS (SELECT u, v FROM links WHERE v LIKE 'https://%'  OR u IN (SELECT url FROM norm)),
twoway AS (SELECT u, v FROM kept UNION SELECT v, u FROM kept),
reach(a, b) AS (SELECT u, u FROM twoway UNION SELECT r.a, e.v FROM reach r JOIN twoway e ON r.b = e.u),
components AS (SELECT a AS url, min(b) AS component FROM reach GROUP BY a),
marked AS (
  SELECT url, component, ({" OR ".join(f"{_HOST} = '{h}' OR {_HOST} LIKE '%.{h}'" for h in BLOCKED_HOSTS)}) AS blocked,
    ({" OR ".join(f"starts_with(url, '{p}')" for p in ALLOWED_PREFIXES)}) AS allowed
  FROM components),
bad AS (SELECT DISTINCT component FROM marked WHERE blocked)
SELECT page_id, p.url, m.component, CASE WHEN allowed THEN 'allow' WHEN b.component IS NOT NULL THEN 'block' ELSE 'none' END AS decision
FROM pages p LEFT JOIN marked m ON p.url = m.url LEFT JOIN bad b ON m.component = b.component
"""
