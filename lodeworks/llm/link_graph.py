"""URL filters: rules on hosts and paths, and for what no rule decides, trust and distrust that flow over host links.

Personalised PageRank spreads trust from hosts whose pages the rules allow along links; distrust spreads from hosts whose
pages the rules block against the links, to those who link to them. A host whose distrust exceeds its trust is blocked.

Everything here is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from .common import aid, counted, cut

LINK = r"(?i)\bhref\s*=\s*[\"']?\s*(?:https?:)?(//[^\"'\s>]+)"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: (verdict, host, path)
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))


def host_of(url: Column) -> Column:
    found = F.regexp_extract(url.cast("string"), r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, UPPER, UPPER.lower()), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url.cast("string"), r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null where none does. Of equally long ones a blocking one wins."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, own, prefix in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[0] == "block")):
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(prefix)
        rule, verdict = F.when(fits, F.lit(own + prefix)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def host_edges(pages: DataFrame) -> DataFrame:
    """src, dst, weight: pages' links to other hosts, and one edge each way between a host and its parent domain.

    A link is an href, quoted or not, with http:// or https:// or the page's own scheme (//host). Others stay on the host.
    A page counts once for each host that it links to.
    """
    host = host_of(F.col("url"))
    urls = F.regexp_extract_all(F.coalesce(F.col("html").cast("string"), F.lit("")), F.lit(LINK), 1)
    links = pages.select(host.alias("src"), F.explode(F.array_distinct(F.transform(urls, lambda x: host_of(F.concat(F.lit(":"), x))))).alias("dst")).groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))
    hosts = pages.select(host.alias("src")).union(links.select("dst")).distinct().where("src != ''")
    # a.b.c -> b.c -> c: each host and its parents
    labels = F.split("src", "[.]")
    steps = F.when(F.size(labels) > 2, F.transform(F.sequence(F.lit(1), F.size(labels) - 2), lambda i: F.struct(F.array_join(F.slice(labels, i, F.size(labels)), ".").alias("a"), F.array_join(F.slice(labels, i + 1, F.size(labels)), ".").alias("b"))))
    up = hosts.select(F.explode(steps).alias("e")).select("e.a", "e.b").distinct()
    both = up.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.lit(1.0).alias("weight")).union(up.select("b", "a", F.lit(1.0)))
    return links.union(both).where("src != dst and src != '' and dst != ''").groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def propagate(seeds: DataFrame, edges: DataFrame, damping: float = 0.85, tolerance: float = 1e-6, rounds: int = 4, flows_per_task: int = 250_000) -> DataFrame:
    """host, trust, distrust. seeds: host, trust, distrust (weights, any scale); edges: src, dst, weight.

    Masses start from the seeds' own and only grow. Rounds end when no host's grow by more than tolerance of themselves;
    as a host's first mass is all growth, each host that a seed reaches has its share by then. Mass of hosts without a
    link onwards is dropped. A round is one aggregation; every few rounds the masses are written to the shared folder, by
    one task for flows_per_task edges.
    """
    totals = seeds.agg(F.sum("trust").alias("t"), F.sum("distrust").alias("d")).first()
    t, d = (float(x or 0) or 1.0 for x in (totals["t"], totals["d"]))
    zero = F.lit(0.0)
    names = ["host", "to", "wt", "wd", "same", "t", "d"]  # same: 1 on the row by which a host keeps its own mass
    share = damping * F.col("weight") / F.col("_all")
    all_of = lambda by: edges.join(edges.groupBy(by).agg(F.sum("weight").alias("_all")), by)  # noqa: E731  sums are joined, so a host with many links is no single task's
    ahead = all_of("src").select("src", F.col("dst").alias("to"), share.alias("w")).select("src", "to", "w", zero, zero, zero, zero).toDF(*names)
    back = all_of("dst").select("dst", F.col("src").alias("to"), share.alias("w")).select("dst", "to", zero, "w", zero, zero, zero).toDF(*names)
    stay = edges.select("src", zero, zero).union(edges.select("dst", zero, zero)).union(seeds.select("host", (1 - damping) / t * F.col("trust"), (1 - damping) / d * F.col("distrust"))).toDF("host", "t", "d")
    stay = stay.groupBy("host").agg(F.sum("t").alias("t"), F.sum("d").alias("d")).select("host", F.col("host").alias("to"), zero.alias("wt"), zero.alias("wd"), F.lit(1.0).alias("same"), "t", "d")
    flows, n = counted(ahead.union(back).union(stay).groupBy("host", "to").agg(*(F.sum(c).alias(c) for c in names[2:])))
    tasks = 1 + n // flows_per_task
    flows = cut(flows.coalesce(tasks))
    state = flows.where("same > 0").select("host", F.col("t").alias("trust"), F.col("d").alias("distrust"))
    grows = lambda c: F.col(c) - F.col(f"_{c}") > tolerance * F.col(c)
    next_of = lambda c, w, own: F.sum(F.col(c) * F.col(w) + F.col(own)).alias(c)
    kept = lambda c: F.sum(F.col(c) * F.col("same")).alias(f"_{c}")
    while True:
        seen, step = Observation(), state
        for _ in range(rounds):
            met = flows.join(aid(step.select("host", "trust", "distrust"), n), "host")
            step = met.groupBy(F.col("to").alias("host")).agg(next_of("trust", "wt", "t"), next_of("distrust", "wd", "d"), kept("trust"), kept("distrust")).coalesce(tasks)
        state = cut(step.observe(seen, F.count(F.when(grows("trust") | grows("distrust"), 1)).alias("growing")).select("host", "trust", "distrust"))
        if not seen.get["growing"]:
            return state


def judged(pages: DataFrame, rules=RULES, damping: float = 0.85, tolerance: float = 1e-4, margin: float = 1e-3) -> DataFrame:
    """All columns of pages' page_id with host, path, rule, verdict, trust and distrust of the host.

    What no rule decides is blocked if its host's distrust exceeds its trust by more than margin of the trust, else
    allowed; so are null urls and urls without ://, whose host and path are empty. Repeated rows give repeated results;
    an empty table gives an empty result; other columns are ignored.
    """
    parts = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    parts = parts.withColumns({"rule": rule, "_verdict": verdict})
    seeds = parts.groupBy("host").agg(F.avg((F.coalesce("_verdict", F.lit("")) == "allow").cast("double")).alias("trust"), F.avg((F.coalesce("_verdict", F.lit("")) == "block").cast("double")).alias("distrust")).where("host != ''")
    state = propagate(seeds, cut(host_edges(pages)), damping, tolerance)
    out = parts.join(state, "host", "left").fillna(0.0, ["trust", "distrust"])
    own = F.when(F.col("distrust") > F.col("trust") * (1 + margin), "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("_verdict", own).alias("verdict"), "trust", "distrust")
