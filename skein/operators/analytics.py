"""Lookups, timelines, counts and joins over the canonical tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.values import in_window, json_double, within
from skein.session import shared_checkpoints


def point_lookup(df: DataFrame, column: str, value) -> DataFrame:
    return df.where(F.col(column) == value).limit(1)


def timeline(posts: DataFrame, account_id: str, k: int = 100) -> DataFrame:
    return posts.where(F.col("account_id") == account_id).orderBy(F.desc("created_at"), "post_id").limit(k)


def thread(posts: DataFrame, conversation_id: str) -> DataFrame:
    return posts.where(F.col("conversation_id") == conversation_id).orderBy("created_at", "post_id")


def long_threads(posts: DataFrame, least: int = 2) -> DataFrame:
    return posts.groupBy("conversation_id").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def time_range_count(df: DataFrame, start=None, end=None) -> DataFrame:
    return df.where(in_window(F.col("created_at"), start, end)).agg(F.count("*").alias("n"))


def per_day(df: DataFrame) -> DataFrame:
    return df.groupBy(F.date_trunc("day", "created_at").alias("day")).agg(F.count("*").alias("n"))


def top_entities(entities: DataFrame, entity_type: str = "HASHTAG", k: int = 20) -> DataFrame:
    return entities.where(F.col("entity_type") == entity_type).groupBy("body").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "body").limit(k)


def account_entities(posts: DataFrame, entities: DataFrame, account_id: str, entity_type: str = "HASHTAG", k: int = 50) -> DataFrame:
    own = posts.where(F.col("account_id") == account_id).select("post_id", "created_at")
    return entities.where(F.col("entity_type") == entity_type).select("post_id", "body").join(own, "post_id").orderBy(F.desc("created_at"), "post_id", "body").limit(k)


def who_acted_on(actions: DataFrame, target: str, kind: str, start=None, end=None) -> DataFrame:
    rows = actions.where((F.col("action_type") == kind) & (F.col("target_account_id") == target) & in_window(F.col("created_at"), start, end))
    return rows.groupBy("originator_account_id").agg(F.count("*").alias("n"))


def originator_actions(actions: DataFrame, account_id: str, k: int = 100) -> DataFrame:
    return actions.where(F.col("originator_account_id") == account_id).orderBy(F.desc("created_at"), "target_post_id", "action_type").limit(k)


def text_search(posts: DataFrame, needle: str) -> DataFrame:
    return posts.where(F.col("body").ilike(f"%{needle}%")).agg(F.count("*").alias("n"))


def nearby(rows: DataFrame, lon: float, lat: float, radius: float) -> DataFrame:
    return rows.where(within(F.col("location"), lon, lat, radius))


def enriched(posts: DataFrame, enrichments: DataFrame, model_id: str) -> DataFrame:
    return posts.join(enrichments.where(F.col("model_id") == model_id).select("post_id", "body"), "post_id")


def not_enriched(rows: DataFrame, enrichments: DataFrame, model_id: str, key: str = "post_id") -> DataFrame:
    """Rows that the model has no enrichment of."""
    return rows.join(enrichments.where(F.col("model_id") == model_id).select(key), key, "left_anti")


def latest(rows: DataFrame, key: str = "account_id", time: str = "created_at") -> DataFrame:
    """The last snapshot of each key; equal times go by all columns, so the result is one row and stable."""
    others = [c for c in rows.columns if c not in (key, time)]
    best = F.max_by(F.struct(time, *others), F.struct(time, *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in others])).alias("r")
    return rows.groupBy(key).agg(best).select(key, "r.*").select(*rows.columns)


def bot_features(accounts: DataFrame, posts: DataFrame, actions: DataFrame, mentions: DataFrame, anchor) -> DataFrame:
    """Account features of the bot score, at the time ``anchor``; three aggregates join on account_id."""
    p = posts.groupBy("account_id").agg(F.count("*").alias("n_posts"), F.avg(F.length("body")).alias("avg_length"), F.min("created_at").alias("first"), F.max("created_at").alias("last"))
    a = actions.groupBy(F.col("originator_account_id").alias("account_id")).agg(
        F.count_if(F.col("action_type") == "SHARE").alias("n_shares"), F.count_if(F.col("action_type") == "COMMENT").alias("n_comments"), F.count("target_account_id").alias("n_targets"), F.countDistinct("target_account_id").alias("n_distinct_targets")
    )
    m = mentions.where(F.col("entity_type") == "USER_TAG").groupBy("account_id").agg(F.count("*").alias("n_mentions"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint")
    out = latest(accounts).join(p, "account_id", "left").join(a, "account_id", "left").join(m, "account_id", "left")
    out = out.withColumns({c: zero(c) for c in ("n_posts", "n_shares", "n_comments", "n_targets", "n_distinct_targets", "n_mentions")})
    age = F.greatest(F.datediff(F.lit(anchor).cast("timestamp"), "created_at"), F.lit(1))
    share = lambda c, of: F.when(F.col(of) > 0, F.col(c) / F.col(of)).otherwise(0.0)
    return out.select(
        "account_id", age.cast("bigint").alias("age_days"), "n_posts", "n_shares", "n_comments", "n_targets", "n_distinct_targets", "n_mentions", F.coalesce("avg_length", F.lit(0.0)).alias("avg_length"),
        ((F.coalesce("follower_count", F.lit(0)) + 1) / (F.coalesce("friend_count", F.lit(0)) + 1)).alias("ff_ratio"), (F.col("n_posts") / age).alias("posts_per_day"),
        share("n_shares", "n_posts").alias("share_ratio"), share("n_comments", "n_posts").alias("comment_ratio"), share("n_distinct_targets", "n_targets").alias("target_diversity"),
    )


def signed_sentiment(body):
    neg, pos = json_double(body, "$.scores.LABEL_0", "$.LABEL_0"), json_double(body, "$.scores.LABEL_2", "$.LABEL_2")
    return F.when(neg >= pos, -neg).when(pos > neg, pos).otherwise(0.0)


def daily_deviation(rows: DataFrame, value: str) -> DataFrame:
    """day, total, mean, n, and the mean's deviation from the mean of days. The window is over days only."""
    days = rows.groupBy(F.date_trunc("day", "created_at").alias("day")).agg(F.sum(value).alias("total"), F.avg(value).alias("mean"), F.count("*").alias("n"))
    whole = days.agg(F.avg("mean").alias("_all"))
    return days.crossJoin(F.broadcast(whole)).select("day", "total", "mean", "n", (F.col("mean") - F.col("_all")).alias("deviation"))  # whole is one row


def hourly(rows: DataFrame, value: str) -> DataFrame:
    return rows.groupBy(F.hour("created_at").cast("bigint").alias("hour")).agg(F.avg(value).alias("mean"), F.count("*").alias("n"))


def spread_by_group(rows: DataFrame, group: str, value: str, least: int = 1) -> DataFrame:
    """Mean, sample deviation (0 for one row) and count by group."""
    return rows.groupBy(group).agg(F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"), F.count(value).alias("n")).where(F.col("n") >= least)


def group_differences(a: DataFrame, b: DataFrame, group: str, value: str, least: int = 1, k: int = 20) -> DataFrame:
    x, y = spread_by_group(a, group, value, least), spread_by_group(b, group, value, least)
    both = x.select(group, F.col("mean").alias("mean_a")).join(y.select(group, F.col("mean").alias("mean_b")), group)
    return both.withColumn("difference", F.abs(F.col("mean_a") - F.col("mean_b"))).orderBy(F.desc("difference"), group).limit(k)


def before(rows: DataFrame, order: str, value: str, name: str, descending: bool = False) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over the rows before, in the order of the distinct column ``order``.

    Rows are dealt out by ranges of the order; sums run within each range, on top of the ranges' totals
    (one row for each partition), so no task holds all rows.
    """
    spark = rows.sparkSession
    way = F.desc(order) if descending else F.asc(order)
    shared_checkpoints(spark)
    # kept, as ranges are drawn anew whenever they are computed
    parts = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), way).withColumn("_part", F.spark_partition_id()).checkpoint()
    totals = parts.groupBy("_part").agg(F.sum(value).alias("_total"))
    offsets = totals.select("_part", F.coalesce(F.sum("_total").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_offset"))  # a row for each partition
    own = F.coalesce(F.sum(value).over(Window.partitionBy("_part").orderBy(way).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return parts.withColumn(name, own).join(F.broadcast(offsets), "_part").withColumn(name, F.col(name) + F.col("_offset")).drop("_part", "_offset")


def ranks(counts: DataFrame, key: str, n: str = "n") -> DataFrame:
    """Rank by count, ties alike. The input is one row per key; a count's rank is found once, among the distinct counts."""
    each = counts.groupBy(n).agg(F.count("*").alias("_many"))
    ranked = before(each, n, "_many", "_above", descending=True).select(n, (F.col("_above") + 1).cast("bigint").alias("rank"))
    return counts.select(key, n).join(ranked, n).select(key, n, "rank")


def ranks_side_by_side(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    x, y = ranks(a, key).select(key, F.col("rank").alias("rank_a")), ranks(b, key).select(key, F.col("rank").alias("rank_b"))
    return x.join(y, key, "full")


def shared_values(a: DataFrame, b: DataFrame, column: str = "body") -> DataFrame:
    return a.select(F.lower(column).alias(column)).intersect(b.select(F.lower(column).alias(column)))


def two_proportions(hits_a: int, n_a: int, hits_b: int, n_b: int) -> tuple[float, float]:
    """z and its two-sided p."""
    from math import erfc, sqrt

    p = (hits_a + hits_b) / (n_a + n_b)
    s = sqrt(p * (1 - p) * (1 / n_a + 1 / n_b))
    z = (hits_a / n_a - hits_b / n_b) / s if s else 0.0
    return z, erfc(abs(z) / sqrt(2))


def mann_whitney_u(rows: DataFrame, group: str, value: str, first) -> DataFrame:
    """u, n_a, n_b: of the rows whose group is ``first`` against all others, by average ranks of distinct values."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(value).agg(F.count_if(F.col(group) == first).alias("a"), F.count("*").alias("n"))
    ranked = before(counts, value, "n", "_below").withColumn("rank", F.col("_below") + (F.col("n") + 1) / 2)
    s = ranked.agg(F.sum(F.col("rank") * F.col("a")).alias("r"), F.sum("a").alias("n_a"), F.sum(F.col("n") - F.col("a")).alias("n_b"))
    return s.select((F.col("r") - F.col("n_a") * (F.col("n_a") + 1) / 2).alias("u"), "n_a", "n_b")


def by_domain(hosts: DataFrame, scores: DataFrame, key: str = "domain") -> DataFrame:
    """Rows with the score of their domain, whatever its case; rows without one are left out. Scores of a domain that repeats are averaged."""
    known = scores.groupBy(F.lower(key).alias("_key")).agg(F.avg("score").alias("score"))
    return hosts.join(known, F.lower(hosts[key]) == F.col("_key")).drop("_key")


def labelled(annotations: DataFrame, predictions: DataFrame, key: str, default: str = "unknown") -> DataFrame:
    """key, truth, guess: each annotation with the prediction for it, or the default."""
    return annotations.select(key, F.coalesce("label", F.lit(default)).alias("truth")).join(predictions.select(key, F.col("label").alias("guess")), key, "left").withColumn("guess", F.coalesce("guess", F.lit(default)))


def confusion(rows: DataFrame, truth: str, guess: str, default: str = "unknown") -> DataFrame:
    return rows.groupBy(F.coalesce(truth, F.lit(default)).alias(truth), F.coalesce(guess, F.lit(default)).alias(guess)).agg(F.count("*").alias("n"))
