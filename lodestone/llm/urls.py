"""URL filters: rules by host and path, and link-graph propagation for what no rule fits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import _LOWER, _UPPER, cut

#: Rule, verdict.
RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
DAMPING = 0.85
#: Rounds at most: they leave 0.85 ** 60, less than a ten-thousandth, of the walk undone. Rounds end before that once the scores change by less than STILL in all.
ROUNDS = 60
STILL = 1e-12
#: A host is blocked if its distrust, as a multiple of what a host gets on average, reaches this and exceeds its trust.
BLOCK_AT = 1.0

LINK = r"(?i)\b(?:href|src)\s*=\s*[\"']?\s*(?:[a-z][a-z0-9+.\-]*:)?//([^/?#\"'\s<>]+)"


def host_of(url: Column) -> Column:
    """What follows the first :// up to / ? # or the end, A-Z lower-cased; empty without :// or url."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[\s\S]*?://([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ? # or the end; empty without :// or url."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^[\s\S]*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, or null. A rule fits its host and all subdomains if the path starts with the rule's."""
    out = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, tail = rule.split("/", 1)
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit("/" + tail))
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def propagate(edges: DataFrame, seeds: DataFrame, rounds: int = ROUNDS, damping: float = DAMPING) -> DataFrame:
    """(host, trust, distrust) by personalised PageRank.

    edges (src, dst, w) with w summing to 1 for each src along the links and
    back (reverse weight r summing to 1 for each dst); seeds (host, good, bad)
    with either column summing to 1 or 0. Trust flows along the links from good
    seeds, distrust against them from bad ones; what a host without the links
    it would flow on has goes back to the seeds, so that nothing is lost and
    trust and distrust keep their sums. Each round joins the hosts with their
    edges and sums by host; edges and hosts stay distributed, and two sums and
    the change come to the driver.
    """
    way = cut(
        edges.select(F.col("src").alias("host"), F.col("dst").alias("to"), F.col("w").alias("along"), F.lit(0.0).alias("back"))
        .unionByName(edges.select(F.col("dst").alias("host"), F.col("src").alias("to"), F.lit(0.0).alias("along"), F.col("r").alias("back")))
        .groupBy("host", "to").agg(F.sum("along").alias("along"), F.sum("back").alias("back"))
    )
    flows = way.groupBy("host").agg(F.max(F.col("along") > 0).alias("gives"), F.max(F.col("back") > 0).alias("takes"))
    seeds = cut(seeds.join(flows, "host", "left").select("host", "good", "bad", F.coalesce("gives", F.lit(False)).alias("gives"), F.coalesce("takes", F.lit(False)).alias("takes")))
    state = seeds.select("host", F.col("good").alias("trust"), F.col("bad").alias("distrust"))
    # What reaches the hosts is what was sent; the rest of a sum, the damped part and what found no link, goes to the seeds.
    rest = lambda flows, c: F.coalesce(F.sum(F.when(F.col(flows), 1 - damping).otherwise(1.0) * c), F.lit(0.0))
    sums = seeds.agg(rest("gives", F.col("good")).alias("t"), rest("takes", F.col("bad")).alias("d")).first()
    for _ in range(rounds):
        sent = state.join(way, "host").select(F.col("to").alias("host"), (damping * F.col("trust") * F.col("along")).alias("trust"), (damping * F.col("distrust") * F.col("back")).alias("distrust"))
        base = seeds.select("host", (F.lit(sums["t"]) * F.col("good")).alias("trust"), (F.lit(sums["d"]) * F.col("bad")).alias("distrust"))
        new = cut(base.unionByName(sent).groupBy("host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust")))
        both = new.join(seeds, "host").join(state.withColumnsRenamed({"trust": "old_trust", "distrust": "old_distrust"}), "host")
        moved = F.coalesce(F.sum(F.abs(F.col("trust") - F.col("old_trust")) + F.abs(F.col("distrust") - F.col("old_distrust"))), F.lit(0.0))
        sums = both.agg(rest("gives", F.col("trust")).alias("t"), rest("takes", F.col("distrust")).alias("d"), moved.alias("moved")).first()
        state = new
        if sums["moved"] < STILL:
            break
    return state


def host_verdicts(pages: DataFrame) -> DataFrame:
    """(host, trust, distrust, host_verdict) for each host that pages (host, rule verdict `ruled`, links) name as their own.

    Seeds are hosts most of whose pages rules allow, or block, weighed alike.
    Links to hosts without pages carry nothing. Scores are multiples of what a
    host gets on average.
    """
    hosts = cut(
        pages.groupBy("host").agg(F.count("*").alias("n"), F.count_if(F.col("ruled") == "allow").alias("allowed"), F.count_if(F.col("ruled") == "block").alias("blocked"))
    )
    is_good, is_bad = 2 * F.col("allowed") > F.col("n"), 2 * F.col("blocked") > F.col("n")
    total = hosts.agg(F.count("*").alias("hosts"), F.count_if(is_good).alias("good"), F.count_if(is_bad).alias("bad")).first()
    share = lambda is_seed, n: F.when(is_seed, 1.0 / max(1, n)).otherwise(0.0)
    seeds = hosts.select("host", share(is_good, total["good"]).alias("good"), share(is_bad, total["bad"]).alias("bad"))
    found = pages.select("host", F.explode(F.array_distinct("links")).alias("dst")).where(F.col("host") != F.col("dst"))
    pairs = found.groupBy(F.col("host").alias("src"), "dst").agg(F.count("*").cast("double").alias("n"))
    pairs = cut(pairs.join(hosts.select(F.col("host").alias("dst")), "dst", "left_semi"))
    out = pairs.groupBy("src").agg(F.sum("n").alias("out"))
    into = pairs.groupBy("dst").agg(F.sum("n").alias("into"))
    edges = pairs.join(out, "src").join(into, "dst").select("src", "dst", (F.col("n") / F.col("out")).alias("w"), (F.col("n") / F.col("into")).alias("r"))
    scaled = propagate(edges, seeds).select("host", (F.col("trust") * total["hosts"]).alias("trust"), (F.col("distrust") * total["hosts"]).alias("distrust"))
    bad = (F.col("distrust") >= BLOCK_AT) & (F.col("distrust") > F.col("trust"))
    return scaled.withColumn("host_verdict", F.when(bad, "block").otherwise("allow"))


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust) for each row of pages (page_id, url, html).

    The rule's verdict where one fits, else the host's by link propagation.
    Null urls and urls without :// have an empty host and path and no rule;
    they form one host. Null html has no links. Repeated rows stay; urls and
    html may be of any length; other columns are not read.
    """
    verdict_of = dict(rules)
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    base = pages.select("page_id", host.alias("host"), path.alias("path"), "html")
    base = base.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    ruled = reduce(lambda out, r: F.when(F.col("rule") == r, F.lit(verdict_of[r])).otherwise(out), verdict_of, F.lit(None).cast("string"))
    links = F.transform(F.regexp_extract_all(F.coalesce(F.col("html"), F.lit("")), F.lit(LINK), F.lit(1)), lambda h: F.translate(h, _UPPER, _LOWER))
    judged = host_verdicts(base.select("host", ruled.alias("ruled"), links.alias("links")))
    rows = base.select("page_id", "host", "path", "rule", ruled.alias("ruled"))
    return rows.join(judged, "host").select("page_id", "host", "path", "rule", F.coalesce("ruled", "host_verdict").alias("verdict"), "trust", "distrust")
