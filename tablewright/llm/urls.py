"""URL filters: rules by host and path, and for the rest what the link graph says of a host.

Pages link to other hosts; that gives weighted edges between hosts. Trust flows from hosts that the rules allow along the links, distrust from
hosts that they block against the links (a page that links to bad hosts is suspect). Both are personalised PageRank: a share of the
mass returns to the seeds in each round. A host is blocked when its distrust outweighs its trust.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import shared_folder

# Rules as (host, path, verdict); a rule fits its host and all subdomains where the url's path starts with the rule's.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
DAMPING = 0.85
ROUNDS = 20
# Ranks are written anew after so many rounds, so that the plan and what a lost executor costs stay bounded.
CHECKPOINT_EVERY = 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Absolute and scheme-relative link targets.
HREF = r"""(?is)<a\s[^>]*?href\s*=\s*["']?((?:[a-z][a-z0-9+.\-]*:)?//[^"'\s>]+)"""


def host_of(url: Column) -> Column:
    """What stands between the first ``://`` and the next ``/``, ``?`` or ``#``, with A-Z lower-cased; empty without ``://``."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule (host and path together) that fits, and its verdict; null where none does."""
    found, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, start, what in sorted(rules, key=lambda r: (len(r[0] + r[1]), r[0] + r[1])):
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(start)
        found = F.when(fits, F.lit(name + start)).otherwise(found)
        verdict = F.when(fits, F.lit(what)).otherwise(verdict)
    return found, verdict


def host_edges(pages: DataFrame) -> DataFrame:
    """``src, dst, weight``: the share of a host's outgoing links that goes to another host. Links within a host are left out.

    Links are added up before they are shuffled, so a host with very many pages or links is no large group.
    """
    targets = F.regexp_extract_all(F.col("html"), F.lit(HREF), F.lit(1))
    hosts = F.transform(targets, lambda u: host_of(F.when(u.startswith("//"), F.concat(F.lit("http:"), u)).otherwise(u)))
    out = pages.select("host", F.explode(hosts).alias("dst")).where("host <> '' AND dst <> '' AND host <> dst")
    counted = out.groupBy("host", "dst").count().withColumnRenamed("host", "src")
    return shares(counted)


def shares(links: DataFrame) -> DataFrame:
    """``src, dst, weight`` from ``src, dst, count``: each count over all of its source."""
    total = links.groupBy("src").agg(F.sum("count").alias("total"))
    return links.join(total, "src").select("src", "dst", (F.col("count") / F.col("total")).alias("weight"))


def rank(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """Personalised PageRank ``host, rank`` of all hosts that seeds reach; ``edges`` are src, dst, weight and ``seeds`` host, mass (total 1).

    Mass on a host without outgoing links is lost rather than spread, which scales all ranks alike and keeps every round one join.
    """
    now = seeds.select("host", F.col("mass").alias("rank"))
    if edges.isEmpty():
        return now  # no mass ever leaves the seeds
    for step in range(1, rounds + 1):
        flows = now.join(edges, now["host"] == edges["src"]).select(F.col("dst").alias("host"), (F.col("rank") * F.col("weight") * damping).alias("rank"))
        back = seeds.select("host", (F.col("mass") * (1 - damping)).alias("rank"))
        now = flows.unionAll(back).groupBy("host").agg(F.sum("rank").alias("rank"))
        if step % CHECKPOINT_EVERY == 0 and step < rounds:
            now = now.checkpoint()
    return now


def seeds_of(pages: DataFrame, verdict: str) -> DataFrame:
    """Hosts most of whose pages the rules give this verdict, with equal mass."""
    counted = pages.groupBy("host").agg(F.count("*").alias("n"), F.sum((F.col("ruled") == verdict).cast("int")).alias("own"))
    chosen = counted.where("host <> '' AND own * 2 > n").select("host")
    return chosen.withColumn("mass", F.lit(1.0) / max(1, chosen.count()))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, margin: float = 1.0) -> DataFrame:
    """``page_id, host, path, rule, verdict`` of every row of ``pages`` (page_id, url, html).

    The verdict is the rule's, else the host's: block where distrust exceeds ``margin`` times trust, so hosts that no seed reaches are allowed.
    Null urls and urls without ``://`` have empty host and path, fit no rule, and are allowed. Rows that repeat are judged one by one.
    """
    shared_folder(pages.sparkSession)
    url = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, ruled = rule_of(F.col("host"), F.col("path"), rules)
    judged = url.select("page_id", "host", "path", "html", rule.alias("rule"), ruled.alias("ruled"))
    edges = host_edges(judged).checkpoint()
    against = shares(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("weight").alias("count"))).checkpoint()
    trust = rank(edges, seeds_of(judged, "allow"))
    distrust = rank(against, seeds_of(judged, "block"))
    both = trust.select("host", "rank", F.lit(0.0).alias("bad")).unionAll(distrust.select("host", F.lit(0.0), "rank"))
    blocked = both.groupBy("host").agg(F.sum("rank").alias("rank"), F.sum("bad").alias("bad")).where(F.col("bad") > margin * F.col("rank"))
    open_pages = judged.where("ruled IS NULL").select("page_id", "host", "path", "rule")
    by_host = open_pages.join(blocked.select("host", F.lit("block").alias("verdict")), "host", "left")
    by_host = by_host.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit("allow")).alias("verdict"))
    return judged.where("ruled IS NOT NULL").select("page_id", "host", "path", "rule", F.col("ruled").alias("verdict")).unionAll(by_host)
