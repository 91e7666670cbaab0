"""URL filters by link-graph propagation (operator 7, DataFrame functions only).

Rules (host, path, verdict) judge the pages they fit; the others are judged by their host's
place in the link graph:

* edges go from the host of a page to the hosts of its absolute links, counted per pair of hosts
  before any join, so that a hot host costs a row per neighbour;
* trust starts at hosts with allowed pages, distrust at hosts with blocked ones, each in the share of
  the host's pages; both are personalised PageRanks, x = seed + damping * W x, trust along
  the links and distrust against them;
* a host is blocked where distrust exceeds trust by ``threshold``.

Ranks are tables in the shared folder, one per step, until no rank moves by ``tolerance``.

Defined results: a null url, or one without ``://``, has an empty host and path, fits no rule and is
allowed (the empty host is no node); hosts without seeds and links have no rank and are allowed;
relative links and links to the same host are no edges; null html has no links; repeated
pages count as often as they occur; an empty table gives an empty table; the input's other columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, literal_table, written
from .decontamination import LOWER, UPPER

LINK = r"""(?is)\bhref\s*=\s*["']?\s*([^"'\s>]+)"""


def host_of(url: Column) -> Column:
    rest = F.substr(url, F.instr(url, "://") + 3)
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return F.coalesce(F.when(F.instr(url, "://") > 0, host), F.lit(""))


def path_of(url: Column) -> Column:
    rest = F.substr(url, F.instr(url, "://") + 3)
    return F.coalesce(F.when(F.instr(url, "://") > 0, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)), F.lit(""))


def _suffixes(host: Column) -> Column:
    labels = F.split(host, r"\.", -1)
    n = F.size(labels)
    return F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(labels, i, n), "."))


def host_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(src, dst, n): links between different hosts."""
    links = F.filter(F.transform(F.regexp_extract_all(F.col(html_col), F.lit(LINK), F.lit(1)),
                                 lambda x: host_of(F.when(x.startswith("//"), F.concat(F.lit("http:"), x)).otherwise(x))),
                     lambda h: h != "")
    return (pages.select(host_of(F.col(url_col)).alias("src"), F.explode(links).alias("dst"))
            .where("src <> '' and src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n")))


def propagate(seeds: DataFrame, edges: DataFrame, damping: float = 0.85, tolerance: float = 1e-4,
              steps: int | None = None) -> DataFrame:
    """(host, trust, distrust) from seeds (host, trust, distrust) along edges (src, dst, n).

    Steps go on until no rank moves by ``tolerance``, which a damping below 1 reaches in any graph; with
    ``steps`` given, ranks that still move after so many are an error."""
    out = edges.groupBy("src").agg(F.sum("n").alias("out"))
    into = edges.groupBy("dst").agg(F.sum("n").alias("into"))
    edges = written(edges.join(out, "src").join(into, "dst")
                    .select("src", "dst", (F.col("n") / F.col("out")).alias("w"), (F.col("n") / F.col("into")).alias("v")), "url-edges")
    hosts = (seeds.select("host").union(edges.select("src")).union(edges.select("dst")).distinct())
    seeds = written(hosts.join(seeds, "host", "left").fillna(0.0, ["trust", "distrust"]), "url-seeds")
    state, step = seeds, 0
    while True:
        step += 1
        forth = edges.join(state.select(F.col("host").alias("src"), "trust"), "src").select(
            F.col("dst").alias("host"), (F.col("w") * F.col("trust")).alias("trust"), F.lit(0.0).alias("distrust"))
        back = edges.join(state.select(F.col("host").alias("dst"), "distrust"), "dst").select(
            F.col("src").alias("host"), F.lit(0.0).alias("trust"), (F.col("v") * F.col("distrust")).alias("distrust"))
        got = forth.union(back).groupBy("host").agg(F.sum("trust").alias("t"), F.sum("distrust").alias("d"))
        zero = F.lit(0.0)
        new = written(seeds.join(got, "host", "left").select(
            "host", (F.col("trust") + damping * F.coalesce("t", zero)).alias("trust"),
            (F.col("distrust") + damping * F.coalesce("d", zero)).alias("distrust")), "url-ranks")
        old = state.select("host", F.col("trust").alias("t0"), F.col("distrust").alias("d0"))
        moved = new.join(old, "host").agg(F.max(F.greatest(F.abs(F.col("trust") - F.col("t0")), F.abs(F.col("distrust") - F.col("d0")))).alias("m")).first()["m"]
        state = new
        if moved is None or moved < tolerance:
            return state
        if step == steps:
            raise RuntimeError(f"ranks still move by {moved} after {steps} steps")


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] | DataFrame, threshold: float = 0.5,
          id_col: str = "page_id", url_col: str = "url", html_col: str = "html", **ranks) -> DataFrame:
    """id_col, host, path, rule, verdict of every page, and its host's trust and distrust.

    ``rules``: (host, path, verdict), a list or a table; a rule fits its host and all
    subdomains, if the page's path starts with the rule's; the longest wins."""
    if not isinstance(rules, DataFrame):
        rules = literal_table(pages.sparkSession, rules, dict.fromkeys(("host", "path", "verdict"), "string"))
    by_host = rules.groupBy(F.col("host").alias("suffix")).agg(F.collect_set(F.struct(
        F.length(F.concat("host", "path")).alias("size"), F.concat("host", "path").alias("rule"), "path", "verdict")).alias("rules"))
    links = written(host_edges(pages, url_col, html_col), "url-links")
    base = pages.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    fitting = (base.select("host").where("host <> ''").distinct().select("host", F.explode(_suffixes(F.col("host"))).alias("suffix"))
               .join(broadcast_if_small(by_host), "suffix").groupBy("host").agg(F.flatten(F.collect_list("rules")).alias("rules")))
    fitting = written(fitting, "url-fitting")
    best = F.array_max(F.filter("rules", lambda r: F.col("path").startswith(r.path)))
    # tables before and between the joins by host: neither side nor what follows is already dealt by host, so a hot host splits
    ruled = written(base.join(fitting, "host", "left").select("id", "host", "path", best.alias("best")), "url-ruled")

    def share(verdict):
        return F.avg(F.when(F.col("best.verdict") == verdict, 1.0).otherwise(0.0))

    seeds = (ruled.where("host <> ''").groupBy("host").agg(share("allow").alias("trust"), share("block").alias("distrust")))
    state = propagate(seeds, links, **ranks)
    out = ruled.join(state, "host", "left")
    by_graph = F.when(F.col("distrust") - F.col("trust") >= threshold, "block").otherwise("allow")
    return out.select(F.col("id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"),
                      F.coalesce(F.col("best.verdict"), by_graph).alias("verdict"), "trust", "distrust")
