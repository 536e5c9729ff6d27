"""URL filter: link-graph propagation of trust and distrust over host edges.

Method
  1. Rules (host suffix and path prefix; the longest that fits wins) judge the
     urls they fit.
  2. Host edges are the absolute links of all pages to other hosts, summed per
     pair of hosts.
  3. Personalised PageRank spreads trust along links from the hosts of allowed
     pages (one unit a page); distrust starts at the hosts of blocked pages and
     runs backwards, to those that link to them. Both are the series
     sum over k of (1 - d) d^k P^k seeds: every step is one join and one grouped
     sum over the edges (combined before the shuffle), written to the shared
     folder, until the mass still moving is below ``tolerance`` of the seeds. (Mass
     that ends in a host without links is not put back: for seeds fixed once
     this only scales all values alike.)
  4. A host is blocked where distrust exceeds ``ratio`` times trust; urls that
     no rule fits get their host's verdict, hosts that nothing reaches are
     allowed.

Defined results
  null urls and urls without ``://``: empty host and path, no rule, host verdict
  of the empty host (never seeded: allow); null html: no links; repeated pages
  each get their row and count as often as they are there; null ids are ids
  like others; empty table: empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gale.llm.common import Scratch, ascii_lower, pick

Rule = tuple[str, str]  # verdict, "host/path"

LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']?\s*(?:https?:)?//([^/"'?#\s>]+)"""


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return (ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1))


def match(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict; null if none fits."""
    rule = verdict = F.lit(None).cast("string")
    for said, text in sorted(rules, key=lambda r: len(r[1])):  # the last one asked first
        own, _, rest = text.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith("/" + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, weight) of links between different hosts; ``pages``: host, html."""
    links = pages.select(F.col("host").alias("src"), F.explode(
        F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(LINK), F.lit(1))).alias("dst"))
    dst = ascii_lower(F.regexp_replace("dst", r"^.*@|:\d*$", ""))
    return links.withColumn("dst", dst).filter("src <> dst AND src <> '' AND dst <> ''") \
        .groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("weight"))


def propagate(edges: DataFrame, seeds: DataFrame, scratch: Scratch, damping: float = 0.85,
              tolerance: float = 1e-4, max_steps: int = 200) -> DataFrame:
    """(kind, host, mass): personalised PageRank of ``seeds`` (kind, host, mass).

    Kind ``trust`` runs along the edges, ``distrust`` against them.
    """
    def shares(kind: str, a: str, b: str) -> DataFrame:
        out = edges.groupBy(a).agg(F.sum("weight").alias("all")).withColumnRenamed(a, "a")
        return edges.join(out, edges[a] == out["a"]).select(
            F.lit(kind).alias("kind"), F.col(a).alias("from"), F.col(b).alias("to"),
            (F.col("weight") / F.col("all")).alias("share"))

    flow = scratch.write(shares("trust", "src", "dst").union(shares("distrust", "dst", "src")), "flow")
    now = seeds.withColumn("mass", F.col("mass") * (1 - damping))
    now = scratch.write(now, "step-0")
    start = now.agg(F.sum("mass")).first()[0] or 0.0
    steps, k = [now], 0
    while start > 0 and k < max_steps:
        k += 1
        nxt = now.join(flow, (now["kind"] == flow["kind"]) & (now["host"] == flow["from"])) \
            .groupBy(now["kind"], F.col("to").alias("host")) \
            .agg((F.sum(F.col("mass") * F.col("share")) * damping).alias("mass"))
        now = scratch.write(nxt, f"step-{k}")
        steps.append(now)
        if (now.agg(F.sum("mass")).first()[0] or 0.0) <= tolerance * start:
            break
    every = scratch.spark.read.schema(steps[0].schema).parquet(*[scratch.path(f"step-{i}") for i in range(len(steps))])
    return every.groupBy("kind", "host").agg(F.sum("mass").alias("mass"))


def judge_urls(pages: DataFrame, rules: list[Rule], ratio: float = 1.0, damping: float = 0.85, tolerance: float = 1e-4,
               id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, trust, distrust (of its host)."""
    scratch = Scratch(pages.sparkSession, "url-filter")
    p = pick(pages, page_id=id_col, url=url_col, html=html_col)
    host, path = split_url(F.col("url"))
    p = p.select("page_id", host.alias("host"), path.alias("path"), "html")
    rule, said = match(F.col("host"), F.col("path"), rules)
    judged = scratch.write(p.select("page_id", "host", "path", rule.alias("rule"), said.alias("said")), "judged")
    edges = scratch.write(host_edges(p), "edges")
    kind = F.when(F.col("said") == "allow", "trust").otherwise("distrust")
    seeds = judged.filter("said IS NOT NULL AND host <> ''").groupBy(kind.alias("kind"), "host") \
        .agg(F.count(F.lit(1)).cast("double").alias("mass"))
    mass = propagate(edges, seeds, scratch, damping, tolerance)
    hosts = mass.groupBy("host").agg(
        F.sum(F.when(F.col("kind") == "trust", F.col("mass")).otherwise(0.0)).alias("trust"),
        F.sum(F.when(F.col("kind") == "distrust", F.col("mass")).otherwise(0.0)).alias("distrust"))
    out = judged.join(hosts, "host", "left").fillna(0.0, ["trust", "distrust"])
    method = F.when(F.col("distrust") > ratio * F.col("trust"), "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("said", method).alias("verdict"), "trust", "distrust")
