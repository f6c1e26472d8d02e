"""Judging URLs by rules, and by trust and distrust along links where no rule fits.

A rule names a host, which covers its subdomains, and the beginning of a path; the
longest fitting rule (host and path together; of equals that with the longer host)
decides. Hosts with pages allowed by a rule are trusted seeds, hosts with blocked pages
are distrusted seeds, each by its share of such pages. Personalised PageRank carries
trust along links between hosts and distrust against them. A host whose trust is less
than ``least`` of both together is blocked; one that neither reaches is allowed.

Rules are joined on host suffix and path beginning, by Spark's choice of join, over
distinct URLs only. The host graph has one row per pair of linked hosts. A round is one
join and one sum; rank at a host without links ends there. Rounds go on until none
reaches a new host or changes any host's rank by more than ``SETTLED`` of itself, so
hosts at the end of long chains are judged by ranks as settled as those near the seeds.
Only rank under ``FAINTEST``, near the smallest double, is not carried on.

Cases: a null URL and one without ``://`` have empty host and path, and no rule fits an
empty host; repeated rows get the same answer each; null html has no links; an empty
table gives no rows; other columns are left out.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwarden.llm.tables import written

ROUNDS = 10  # of the SQL, which cannot test whether ranks have settled
CHECKED = 5  # rounds between two tests of that
SETTLED = 1e-10
FAINTEST = 1e-300
DAMPING = 0.85
LEAST = 0.5
LINK = r"""(?i)href\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)"""
ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    found = F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, ASCII_UPPER, ASCII_LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``host``, ``path`` of distinct URLs with the ``rule`` that decides and its ``verdict``."""
    rules = rules.select(F.col("host").alias("suffix"), F.col("path").alias("start"), "verdict")
    lengths = [r["n"] for r in rules.select(F.length("start").alias("n")).distinct().collect()]
    labels = F.split("host", r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    )
    tried = urls.where("host <> ''").select("host", "path", F.explode(suffixes).alias("suffix"))
    starts = F.array_distinct(F.array(*[F.substring("path", 1, n) for n in lengths])) if lengths else F.array().cast("array<string>")
    tried = tried.select("host", "path", "suffix", F.explode(starts).alias("start"))
    best = F.max(F.struct(F.length("suffix") + F.length("start"), F.length("suffix"), F.concat("suffix", "start").alias("rule"), "verdict"))
    found = tried.join(rules, ["suffix", "start"]).groupBy("host", "path").agg(best.alias("best"))
    return found.select("host", "path", "best.rule", "best.verdict")


def host_links(pages: DataFrame) -> DataFrame:
    """``src``, ``dst`` and number of links between different hosts."""
    links = pages.select(F.col("host").alias("src"), F.explode(F.regexp_extract_all("html", F.lit(LINK), 1)).alias("to"))
    links = links.select("src", F.translate("to", ASCII_UPPER, ASCII_LOWER).alias("dst")).where("src <> '' and src <> dst")
    return links.groupBy("src", "dst").agg(F.count("*").alias("n"))


def propagate(links: DataFrame, seeds: DataFrame, rounds: int | None = None, damping: float = DAMPING) -> DataFrame:
    """``kind``, ``node``, ``rank``. ``seeds``: ``kind`` (allow or block), ``node``, ``mass`` adding up to 1 by kind.

    Without ``rounds``, until the ranks have settled.
    """
    out = links.groupBy("src").agg(F.sum("n").alias("total"))
    into = links.groupBy("dst").agg(F.sum("n").alias("total"))
    along = links.join(out, "src").select(F.lit("allow").alias("kind"), F.col("src").alias("node"), F.col("dst").alias("to"), (F.col("n") / F.col("total")).alias("share"))
    against = links.join(into, "dst").select(F.lit("block").alias("kind"), F.col("dst").alias("node"), F.col("src").alias("to"), (F.col("n") / F.col("total")).alias("share"))
    flow = written(along.unionByName(against), "host-flow")
    start = seeds.select("kind", "node", (F.col("mass") * (1 - damping)).alias("rank"))
    rank = seeds.select("kind", "node", F.col("mass").alias("rank"))
    for i in itertools.count() if rounds is None else range(rounds):
        moved = rank.join(flow, ["kind", "node"]).select("kind", F.col("to").alias("node"), (F.col("rank") * F.col("share") * damping).alias("rank"))
        parts = start.unionByName(moved.where(F.col("rank") >= FAINTEST)).withColumn("old", F.lit(0.0))
        if i % CHECKED == CHECKED - 1:
            parts = parts.unionByName(rank.select("kind", "node", F.lit(0.0).alias("rank"), F.col("rank").alias("old")))
        rank = parts.groupBy("kind", "node").agg(F.sum("rank").alias("rank"), F.sum("old").alias("old"))
        if i % CHECKED == CHECKED - 1:
            told = written(rank, "host-rank")
            rank = told.where("rank > 0").drop("old")
            # A host that this round was the first to reach has no old rank.
            if rounds is None and told.where(F.abs(F.col("rank") - F.col("old")) > SETTLED * F.col("rank")).isEmpty():
                break
        else:
            rank = rank.drop("old")
    return rank


def judge(pages: DataFrame, rules: DataFrame, least: float = LEAST, rounds: int | None = None) -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule``, ``verdict`` and the host's ``trust`` share."""
    pages = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "html")
    found = written(fitting(pages.select("host", "path").distinct(), rules), "url-rules")
    ruled = written(pages.select("page_id", "host", "path").join(found, ["host", "path"], "left"), "ruled-pages")
    counts = ruled.where("verdict is not null").groupBy(F.col("verdict").alias("kind"), F.col("host").alias("node")).agg(F.count("*").alias("n"))
    totals = counts.groupBy("kind").agg(F.sum("n").alias("total"))  # a row per kind
    seeds = written(counts.join(F.broadcast(totals), "kind").select("kind", "node", (F.col("n") / F.col("total")).alias("mass")), "url-seeds")
    rank = propagate(host_links(pages), seeds, rounds)
    trust = F.coalesce(F.sum(F.when(F.col("kind") == "allow", F.col("rank"))), F.lit(0.0))
    hosts = rank.groupBy(F.col("node").alias("host")).agg(F.round(trust / F.sum("rank"), 9).alias("trust"))
    told = ruled.join(hosts, "host", "left")
    own = F.when(F.col("trust") < least, "block").otherwise("allow")
    return told.select("page_id", "host", "path", "rule", F.coalesce("verdict", own).alias("verdict"), "trust")
