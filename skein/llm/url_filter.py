"""URL filter: host rules, and trust that spreads over the link graph. Native DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.common import checkpoint

#: (host, path, verdict)
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
DAMPING, ROUNDS = 0.85, 12
#: A host is blocked by the method when its distrust is over so many times its trust, and over the floor. Rounding makes no verdict.
RATIO, FLOOR = 1.000001, 1e-12
#: Parts in which a host's rows, or its links, are joined: one host may hold a third of all.
SALTS = 16


def host_path(url: Column) -> tuple[Column, Column]:
    """A url's host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    rest = F.when(url.contains("://"), F.substring(url, F.instr(url, "://") + F.lit(3), F.length(url)))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))


def matching(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; nulls where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def salted(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int").alias("salt")


def in_all_parts(df: DataFrame) -> DataFrame:
    """Each row once for each salt: for the side that has one row for a host."""
    return df.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS)))))


def spread(nodes: DataFrame, edges: DataFrame, seed: str, source: str, target: str) -> DataFrame:
    """(host, rank): personalised PageRank from the seed weights (of all hosts together at most 1), over edges source -> target.

    A source's rank goes to its targets by their weights, that of hosts without targets back to the seeds, so
    the ranks add up to the seed weights. Both joins are by host, a hub's links are salted, sums are pre-aggregated.
    """
    out = edges.groupBy(source).agg(F.sum("w").alias("all"))
    steps = checkpoint(edges.withColumn("salt", salted(F.col(target))).join(in_all_parts(out), [source, "salt"]).select(F.col(source).alias("host"), "salt", F.col(target).alias("b"), (F.col("w") / F.col("all")).alias("share")))
    start = nodes.select("host", F.col(seed).alias("seed"))
    if steps.isEmpty():
        return start.withColumnRenamed("seed", "rank")
    start = checkpoint(start.join(out.select(F.col(source).alias("host"), F.lit(True).alias("leads")), "host", "left"))
    weight = start.agg(F.sum("seed").alias("weight"))
    rank = start.select("host", "leads", "seed", F.col("seed").alias("rank"))
    for k in range(ROUNDS):
        moved = steps.join(in_all_parts(rank.where("rank > 0").select("host", "rank")), ["host", "salt"]).groupBy(F.col("b").alias("host")).agg(F.sum(F.col("share") * F.col("rank")).alias("got"))
        lost = rank.where(F.col("leads").isNull()).agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("lost"))
        back = F.when(F.col("weight") > 0, F.col("seed") / F.col("weight") * F.col("lost")).otherwise(0.0)
        new = (1 - DAMPING) * F.col("seed") + DAMPING * (F.coalesce("got", F.lit(0.0)) + back)
        rank = start.join(moved, "host", "left").join(F.broadcast(lost.join(F.broadcast(weight)))).select("host", "leads", "seed", new.alias("rank"))  # lost, weight: one row each
        if k % 3 == 2:
            rank = checkpoint(rank)
    return rank.select("host", "rank")


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict of every page.

    A rule fits its host and all subdomains where the path starts with the rule's; the longest rule decides.
    Else the host's trust does: trusted seeds are hosts with allowed pages, blocked seeds hosts with blocked
    pages, each by the number of pages as a share of all such pages. Trust follows links, distrust goes against them, both by personalised
    PageRank over host edges (absolute links between different hosts in the html). A host with more distrust
    than trust is blocked; no rank at all means allow. Null url: host and path "", judged allow. Each input
    row gives one row, repeats included; null html has no links.
    """
    host, path = host_path(F.col("url"))
    rule, verdict = matching(F.col("host"), F.col("path"), rules)
    judged = pages.select("page_id", "url", host.alias("host"), path.alias("path")).withColumns({"rule": rule, "v": verdict})
    nodes = judged.groupBy("host").agg(F.count_if(F.col("v") == "allow").alias("good"), F.count_if(F.col("v") == "block").alias("bad"))
    link = F.regexp_extract_all(F.col("html"), F.lit(r"(?i)href\s*=\s*[\"']?(https?://[^\s\"'<>]+)"), F.lit(1))
    linked = pages.select(host.alias("a"), F.explode(link).alias("to"))
    edges = linked.select("a", host_path(F.col("to"))[0].alias("b")).where("a <> b and a <> '' and b <> ''").groupBy("a", "b").agg(F.count("*").alias("w"))
    edges = checkpoint(edges)
    known = edges.select(F.explode(F.array("a", "b")).alias("host")).distinct()
    nodes = nodes.join(known, "host", "full").select("host", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("bad", F.lit(0)).alias("bad"))
    total = nodes.agg(F.greatest(F.sum(F.col("good") + F.col("bad")), F.lit(1)).alias("seeds"))
    nodes = checkpoint(nodes.join(F.broadcast(total)).select("host", (F.col("good") / F.col("seeds")).alias("good"), (F.col("bad") / F.col("seeds")).alias("bad")))  # total is one row
    trust = spread(nodes, edges, "good", "a", "b").withColumnRenamed("rank", "trust")
    distrust = spread(nodes, edges, "bad", "b", "a").withColumnRenamed("rank", "distrust")
    blocked = distrust.join(trust, "host").where((F.col("distrust") > F.lit(FLOOR)) & (F.col("distrust") > RATIO * F.col("trust"))).select("host", F.lit("block").alias("method"))
    out = judged.select("page_id", "host", "path", "rule", "v", salted(F.struct("page_id", "path"))).join(in_all_parts(blocked), ["host", "salt"], "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("v", "method", F.lit("allow")).alias("verdict"))


def judge_sql(rules=RULES) -> str:
    """The same as judge() in DuckDB's SQL, with each round of a rank as a table of its own."""
    rest = "CASE WHEN {u} LIKE '%://%' THEN substr({u}, position('://' IN {u}) + 3) END"
    host = f"coalesce(translate(regexp_extract({rest}, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '')"
    path = f"coalesce(regexp_extract({rest}, '^[^/?#]*([^?#]*)', 1), '')"
    cases = {"rule": "", "v": ""}
    for h, p, v in sorted(rules, key=lambda r: -len(r[0] + r[1])):
        fits = f"WHEN (host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '{p}') THEN "
        cases = {"rule": cases["rule"] + fits + f"'{h}{p}' ", "v": cases["v"] + fits + f"'{v}' "}
    url, to = host.format(u="url"), host.format(u="link")
    parts = [
        f"p AS (SELECT *, CASE {cases['rule']}END rule, CASE {cases['v']}END v FROM (SELECT page_id, html, {url} host, {path.format(u='url')} path FROM pages))",
        f"links AS (SELECT host a, unnest(regexp_extract_all(html, '(?i)href\\s*=\\s*[\"'']?(https?://[^\\s\"''<>]+)', 1)) link FROM p)",
        f"edges AS (SELECT a, {to} b, COUNT(*) w FROM links WHERE a <> '' GROUP BY 1, 2 HAVING a <> b AND b <> '')",
        "hosts AS (SELECT host FROM p UNION SELECT a FROM edges UNION SELECT b FROM edges)",
        "seeds AS (SELECT host, COUNT(*) FILTER (v = 'allow') good, COUNT(*) FILTER (v = 'block') bad FROM hosts LEFT JOIN p USING (host) GROUP BY 1)",
        "whole AS (SELECT greatest(SUM(good + bad), 1) n FROM seeds)",
    ]
    for kind, seed, a, b in (("t", "good", "a", "b"), ("d", "bad", "b", "a")):
        parts += [
            f"{kind}s AS (SELECT {a} x, {b} y, w / SUM(w) OVER (PARTITION BY {a}) share FROM edges)",
            f"{kind}0 AS (SELECT host, {seed} / n seed, {seed} / n r, host IN (SELECT x FROM {kind}s) leads, SUM({seed} / n) OVER () weight FROM seeds, whole)",
        ]
        for k in range(ROUNDS):
            got = f"(SELECT y, SUM(share * r) got FROM {kind}s JOIN {kind}{k} ON x = host GROUP BY 1)"
            lost = f"coalesce((SELECT SUM(r) FROM {kind}{k} WHERE NOT leads), 0)"
            parts.append(f"{kind}{k + 1} AS MATERIALIZED (SELECT host, seed, {1 - DAMPING} * seed + {DAMPING} * (coalesce(got, 0) + CASE WHEN weight > 0 THEN seed / weight * {lost} ELSE 0 END) r, leads, weight FROM {kind}{k} LEFT JOIN {got} ON y = host)")
    judged = f"CASE WHEN d.r > {FLOOR} AND d.r > {RATIO} * t.r THEN 'block' ELSE 'allow' END"
    return f"WITH {', '.join(parts)} SELECT page_id, host, path, rule, coalesce(v, {judged}) verdict FROM p JOIN t{ROUNDS} t USING (host) JOIN d{ROUNDS} d USING (host)"
