"""URL filter with redirect equivalence.

Rules are host and path prefixes; the longest that fits a url decides.  Redirect
and canonical-link edges found in the pages join urls into aliases: distributed
connected components carry decisions to the aliases that no rule fits.  Inside a
component an explicit allow outweighs any block.
"""

from __future__ import annotations

import html as html_names
import re
from collections.abc import Iterator
from dataclasses import dataclass
from html.entities import html5

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.columns import ascii_lower, held, pick
from loomgraph.llm.worker import lean
from loomgraph.operators.components import connected_components
from loomgraph.operators.skew import lookup_join
from loomgraph.operators.workspace import Workspace

#: So many rules are compiled into one expression; more are a table that urls are joined with.
MOST_RULES = 32


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str  # "allow" or "block"

    @property
    def text(self) -> str:
        return self.host + self.path


def after_scheme(url: Column) -> Column:
    at = F.instr(url, F.lit("://"))
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def url_host(url: Column) -> Column:
    """Null, or without ``://``: empty."""
    return ascii_lower(F.regexp_extract(F.coalesce(after_scheme(url), F.lit("")), r"^([^/?#]*)", 1))


def url_path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(after_scheme(url), F.lit("")), r"^[^/?#]*([^?#]*)", 1)


def match_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest fitting rule as a struct of its text and verdict, else null. Of equal rules allow wins."""
    out = F.lit(None).cast("struct<rule: string, said: string>")
    for r in sorted(rules, key=lambda r: (-len(r.text), r.verdict, r.text), reverse=True):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        out = F.when(fits, F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("said"))).otherwise(out)
    return out


def with_rules(urls: DataFrame, rules: list[Rule], ws: Workspace) -> DataFrame:
    """``urls`` (any columns, among them host and path) with rule and said: the longest fitting rule's text and verdict, else nulls.

    Any number of rules: few are an expression; of more, every distinct host and path asks a
    table for each suffix of its host and each start of its path that has a rule's length.
    """
    if len(rules) <= MOST_RULES:
        return held(urls, "__rule", match_rule(F.col("host"), F.col("path"), rules)).select(*urls.columns, "__rule.rule", "__rule.said")
    spark = urls.sparkSession
    best = sorted({(r.host, r.path): r.verdict for r in sorted(rules, key=lambda r: r.verdict, reverse=True)}.items())
    known = ws.save(spark.createDataFrame([(h, p, v) for (h, p), v in best], "rhost string, rpath string, said string"), "rules")
    sizes = F.array(*(F.lit(n) for n in sorted({len(p) for (_, p), _ in best})))
    stored = ws.save(urls, "urls")
    each = stored.groupBy("host", "path").agg(F.count("*").alias("rows"))
    suffix = F.explode(F.expr("transform(sequence(1, size(split(host, '[.]'))), i -> substring_index(host, '.', -i))")).alias("rhost")
    keys = each.select("host", "path", suffix).distinct()
    keys = keys.select("host", "path", "rhost", F.explode(F.filter(sizes, lambda n: n <= F.length("path"))).alias("n")).select("host", "path", "rhost", F.left("path", F.col("n")).alias("rpath"))
    keys = ws.save(keys, "asks")
    asked = ws.save(keys.groupBy("rhost", "rpath").agg(F.count("*").alias("asks")).join(known.hint("merge"), ["rhost", "rpath"]), "asked")
    met = lookup_join(keys, asked, ["rhost", "rpath"], "asks").withColumn("rule", F.concat("rhost", "rpath"))
    # Of equally long rules the one that match_rule would meet first: allow, then the text.
    order = F.struct(-F.length("rule"), "said", "rule")
    told = met.groupBy("host", "path").agg(F.min(F.struct(order.alias("o"), "rule", "said")).alias("r")).select("host", "path", "r.rule", "r.said")
    told = ws.save(each.join(told.hint("merge"), ["host", "path"], "left"), "told")
    return lookup_join(stored, told, ["host", "path"], "rows").select(*urls.columns, "rule", "said")


def url_node(url: Column) -> Column:
    """A url without fragment, its scheme and host in lower case: what aliases are about."""
    bare = F.regexp_extract(url, r"^([^#]*)", 1)
    at = F.instr(bare, F.lit("://"))
    rest = F.substring(bare, at + 3, F.length(bare))
    host = F.regexp_extract(rest, r"^([^/?]*)", 1)
    return F.when(at > 0, F.concat(ascii_lower(F.substring(bare, F.lit(1), at + 2)), ascii_lower(host), F.substring(rest, F.length(host) + 1, F.length(rest))))


_TAG = re.compile(r"""<(link|meta|base)\b((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)>""", re.I)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]++)\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s>]+))""")
_ENTITY = re.compile(r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]*(?:;|(?!=)))")
_REFRESH = re.compile(r"""\s*(?:[0-9.]+[\s;,]+(?:url\s*=\s*)?|[\s;,]*url\s*=\s*)(?:"([^"]*)|'([^']*)|(.*))""", re.I | re.S)
_SCHEME = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*:")
_BASE = re.compile(r"([A-Za-z][A-Za-z0-9+.-]*:)(//[^/?#]*)([^?#]*)(\??[^#]*)")


def decode_entities(value: str) -> str:
    """An attribute's text: names without a semicolon count only where no ``=`` follows."""
    return _ENTITY.sub(lambda m: html_names.unescape(m[0]) if m[0][1] == "#" or m[0][1:] in html5 else m[0], value)


def _without_dots(path: str) -> str:
    out: list[str] = []
    segments = path.split("/")[1:]
    for x in segments:
        if x == "..":
            del out[-1:]
        elif x != ".":
            out.append(x)
    return "/" + "/".join([*out, ""] if segments[-1:] in (["."], [".."]) else out)


def resolve_target(base: str, target: str) -> str | None:
    """A link's target as an absolute url (RFC 3986); null for schemes without ``//`` and where the base has none. Absolute ones stay as they are."""
    target = re.sub(r"[\t\n\r]", "", target.strip())
    if m := _SCHEME.match(target):
        return target if target.startswith("//", m.end()) else None
    if not (m := _BASE.match(base)):
        return None
    scheme, authority, path, query = m.groups()
    if target.startswith("//"):
        return scheme + target
    to, rest = re.match(r"(?s)([^?#]*)(.*)", target).groups()
    if not to:
        return scheme + authority + path + (rest if rest.startswith("?") else query)
    return scheme + authority + _without_dots(to if to.startswith("/") else (path.rpartition("/")[0] if path else "") + "/" + to) + rest


def page_targets(url: str, html: str) -> list[str]:
    """The targets of all canonical links and meta refreshes of a page, as absolute urls."""
    found, base = [], url
    for m in reversed(list(_TAG.finditer(html))):
        # Of repeated attributes the first counts, of base tags too.
        own = {k.lower(): decode_entities(a or b or c) for k, a, b, c in reversed(_ATTRIBUTE.findall(m[2]))}
        kind = m[1].lower()
        if kind == "base" and "href" in own:
            base = resolve_target(url, own["href"]) or url
        elif kind == "link" and "canonical" in own.get("rel", "").lower().split() and own.get("href", "").strip():
            found.append(own["href"])
        elif kind == "meta" and own.get("http-equiv", "").strip().lower() == "refresh" and (r := _REFRESH.match(own.get("content", ""))):
            found.append(r[1] or r[2] or r[3] or "")
    return [x for t in found if (x := resolve_target(base, t))]


def _link_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield pd.DataFrame([(u, t) for u, h in zip(b["url"], b["html"], strict=True) for t in page_targets(u, h)], columns=["url", "t"])


def page_links(pages: DataFrame) -> DataFrame:
    """pages(url, html) -> (url, t), a row per canonical link and meta refresh. Only pages with such words reach Python."""
    some = pages.where("url IS NOT NULL").where(F.col("html").rlike("(?i)refresh|canonical"))
    return some.select("url", "html").mapInPandas(lean(_link_rows), "url string, t string")


def judge_urls(
    pages: DataFrame,
    rules: list[Rule],
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str | None = "html",
    redirects: DataFrame | None = None,
    default: str = "allow",
) -> DataFrame:
    """One row per page: id, host, path, rule, verdict.

    A fitting rule decides. Else the page's alias component does: allow if an explicit
    allow rule fits any url of it, block if only block rules do. Else ``default``.
    ``redirects(src, dst)``: more edges; its urls take part in components and rules
    though no page has them. Null or scheme-less urls have empty host and path and no
    aliases. Repeated rows are judged alike; null ids pass through; empty tables give no rows.
    """
    ws = Workspace(pages.sparkSession, "url-filter")
    rows = pick(pages, id=id_col, url=url_col)
    edges = None
    if html_col is not None:
        edges = page_links(pick(pages, url=url_col, html=html_col)).select(url_node(F.col("url")).alias("a"), url_node(F.col("t")).alias("b"))
    if redirects is not None:
        more = pick(redirects, src="src", dst="dst").select(url_node(F.col("src")).alias("a"), url_node(F.col("dst")).alias("b"))
        edges = more if edges is None else edges.unionByName(more)
    host, path = url_host(F.col("url")), url_path(F.col("url"))
    judged = with_rules(held(rows, "u", F.struct(host.alias("host"), path.alias("path"))).select("id", "url", "u.host", "u.path"), rules, ws)
    final = judged.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("said", F.lit(default)).alias("verdict"))
    if edges is None:
        return final
    edges = ws.save(edges.where("a <> b").distinct(), "links")
    if edges.isEmpty():
        return final
    comp = ws.save(connected_components(edges, ws), "components")
    # Every url of a component has its say once, whether a page has it or only an edge.
    node_host, node_path = url_host(F.col("node")), url_path(F.col("node"))
    said = with_rules(held(comp, "u", F.struct(node_host.alias("host"), node_path.alias("path"))).select("node", "component", "u.host", "u.path"), rules, ws)
    whole = said.groupBy("component").agg(
        F.when(F.max(F.expr("said = 'allow'")), "allow").when(F.max(F.expr("said = 'block'")), "block").otherwise(default).alias("alias_verdict"), F.count("*").alias("n")
    )
    by_node = ws.save(lookup_join(comp, ws.save(whole, "whole"), ["component"], "n").select("node", "alias_verdict"), "by-node")
    # Only pages that no rule fits ask their component; repeated urls count for the hot-key bound.
    judged = judged.withColumn("node", url_node(F.col("url")))
    asks = judged.where("said IS NULL AND node IS NOT NULL")
    counted = ws.save(asks.groupBy("node").agg(F.count("*").alias("n")).join(by_node, "node", "left").withColumn("alias_verdict", F.coalesce("alias_verdict", F.lit(default))), "counted")
    told = lookup_join(asks, counted, ["node"], "n").select(F.col("id").alias(id_col), "host", "path", "rule", F.col("alias_verdict").alias("verdict"))
    rest = judged.where("said IS NOT NULL OR node IS NULL").select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("said", F.lit(default)).alias("verdict"))
    return rest.unionByName(told)


RULES = [
    Rule("com", "/en/", "block"),
    Rule("example.com", "/en/7", "allow"),
    Rule("net", "/de/", "allow"),
    Rule("example.net", "/de/8", "block"),
    Rule("org", "/es/", "block"),
]


def op4_url_filter(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return judge_urls(pages, RULES)


#: Rules only: the pages of the test tables have no canonical links or redirects, and
#: alias propagation is tested against brute force instead.
ORACLE = """
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
     h AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
     r(rhost, rpath, v) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
     m AS (SELECT page_id, max(length(rhost || rpath)) AS n, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(v, length(rhost || rpath)) AS v
           FROM h JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id)
SELECT h.page_id, h.host, h.path, m.rule, coalesce(m.v, 'allow') AS verdict FROM h LEFT JOIN m ON h.page_id = m.page_id
"""
