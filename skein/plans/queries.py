"""The registered queries over the driver's tables, each with an equivalent in DuckDB's SQL."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import text
from skein.functions.hashing import keyed_hash, redact, sanitize_entity
from skein.operators import analytics as an
from skein.operators import networks as nw
from skein.operators import privacy, profile, quality
from skein.plans.multistore import MultiStore

START, END, STEP = datetime(2024, 1, 1), datetime(2024, 1, 29, 12), timedelta(days=7)
KINDS = {"click": "UPVOTE", "view": "SHARE", "purchase": "COMMENT", "signup": "FOLLOW", "error": "BLOCK"}
PEPPER = "pepper"


class Tables:
    """The canonical tables, made from the driver's."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.t = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
        self.spark = spark

    @property
    def actions(self) -> DataFrame:
        kind = F.lit(None).cast("string")
        for k, v in KINDS.items():
            kind = F.when(F.col("event_type") == k, v).otherwise(kind)
        k = F.get_json_object("props", "$.k")
        return self.t("events").select(F.col("user_id").cast("string").alias("originator_account_id"), k.alias("target_account_id"), k.alias("target_post_id"), kind.alias("action_type"), F.col("ts").cast("timestamp").alias("created_at"))

    @property
    def posts(self) -> DataFrame:
        s = lambda c: F.col(c).cast("string")
        return self.t("orders").select(s("o_orderkey").alias("post_id"), s("o_custkey").alias("account_id"), s("o_orderstatus").alias("conversation_id"), s("o_orderpriority").alias("platform"), F.col("o_orderdate").cast("timestamp").alias("created_at"))

    @property
    def entities(self) -> DataFrame:
        j = self.t("lineitem").select("l_orderkey", "l_partkey").join(self.t("part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
        return j.select(F.col("l_orderkey").cast("string").alias("post_id"), F.col("p_brand").alias("body"), F.lit("HASHTAG").alias("entity_type"), F.lit(None).cast("timestamp").alias("created_at"))

    @property
    def texts(self) -> DataFrame:
        return self.t("documents").select(F.col("doc_id").cast("string").alias("post_id"), F.col("text").alias("body"), F.col("source").alias("platform"), "lang")

    @property
    def enrichments(self) -> DataFrame:
        return self.t("labels").select(F.lit("toxicity").alias("model_id"), F.col("doc_id").cast("string").alias("post_id"), F.concat(F.lit('{"scores":{"toxicity":'), F.col("toxic").cast("string"), F.lit("}}")).alias("body"))


ACTIONS = "(SELECT CAST(user_id AS VARCHAR) o, json_extract_string(props, '$.k') t, CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in KINDS.items()) + " END kind, CAST(ts AS TIMESTAMP) ts FROM events)"
POSTS = "(SELECT CAST(o_orderkey AS VARCHAR) post_id, CAST(o_custkey AS VARCHAR) account_id, o_orderstatus conversation_id, o_orderpriority platform, CAST(o_orderdate AS TIMESTAMP) created_at FROM orders)"
ENTITIES = "(SELECT CAST(l_orderkey AS VARCHAR) post_id, p_brand body FROM lineitem JOIN part ON l_partkey = p_partkey)"
TEXTS = "(SELECT CAST(doc_id AS VARCHAR) post_id, text body, source platform, lang FROM documents)"
Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        key = name or f.__name__
        Q[key] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            SQL[key] = sql
        return f

    return add


def edges_sql(src: str, where: str, label: str, weight: str = "COUNT(*)", having: str = "") -> str:
    return f"SELECT {src}, CAST({weight} AS BIGINT) weight, '{label}' edge_type FROM {where} {having}"


for _kind in ("UPVOTE", "SHARE", "COMMENT", "FOLLOW", "BLOCK"):
    query(edges_sql("o src, t dst", f"{ACTIONS} WHERE kind='{_kind}' AND o IS NOT NULL AND t IS NOT NULL GROUP BY 1,2", _kind), f"user_interaction_{_kind.lower()}")(lambda t, k=_kind: nw.user_interaction(t.actions, k, kinds=nw.ACTION_TYPES).edges)
query(edges_sql("o src, t dst", f"{ACTIONS} WHERE kind='SHARE' AND t IS NOT NULL GROUP BY 1,2", "SHARE", "1"), "user_interaction_binary")(lambda t: nw.user_interaction(t.actions, "SHARE", weighting="binary").edges)
query(edges_sql("o src, t dst", f"{ACTIONS} WHERE kind='SHARE' AND t IS NOT NULL AND ts >= '2024-01-05' AND ts < '2024-01-20' GROUP BY 1,2", "SHARE", having="HAVING COUNT(*) >= 2"), "user_interaction_min_weight")(
    lambda t: nw.user_interaction(t.actions, "SHARE", datetime(2024, 1, 5), datetime(2024, 1, 20), min_weight=2).edges
)
query(f"SELECT DISTINCT n node_id FROM (SELECT o n FROM {ACTIONS} WHERE kind='SHARE' AND t IS NOT NULL UNION SELECT t FROM {ACTIONS} WHERE kind='SHARE' AND o IS NOT NULL AND t IS NOT NULL)", "user_interaction_nodes")(lambda t: nw.user_interaction(t.actions, "SHARE").nodes)
W = "TIMESTAMP '2024-01-01' + INTERVAL 7 DAY * CAST(floor(date_diff('second', TIMESTAMP '2024-01-01', ts) / 604800) AS INTEGER)"
IN = f"(SELECT *, {W} ws, LEAST({W} + INTERVAL 7 DAY, TIMESTAMP '2024-01-29 12:00:00') we FROM {ACTIONS} WHERE ts >= '2024-01-01' AND ts < '2024-01-29 12:00:00')"
query(edges_sql("ws window_start, we window_end, o src, t dst", f"{IN} WHERE kind='SHARE' AND t IS NOT NULL GROUP BY 1,2,3,4", "SHARE"), "user_interaction_over_time")(lambda t: nw.user_interaction(t.actions, "SHARE", START, END, step=STEP).edges)
PAIR = "SELECT a.body src, b.body dst, CAST(COUNT(*) AS BIGINT) weight, 'HASHTAG_COOCCURRENCE' edge_type FROM (SELECT DISTINCT * FROM {e}) a JOIN (SELECT DISTINCT * FROM {e}) b ON a.post_id=b.post_id AND a.body<b.body GROUP BY 1,2"
query(PAIR.format(e=ENTITIES), "hashtag_cooccurrence")(lambda t: nw.entity_cooccurrence(t.entities).edges)
query(f"SELECT DISTINCT n node_id, n \"label\", 'HASHTAG' type FROM (SELECT src n FROM ({PAIR.format(e=ENTITIES)}) UNION SELECT dst FROM ({PAIR.format(e=ENTITIES)}))", "cooccurrence_nodes")(lambda t: nw.entity_cooccurrence(t.entities).nodes)
query(edges_sql("account_id src, body dst", f"{POSTS} p JOIN {ENTITIES} e USING (post_id) GROUP BY 1,2", "ACCOUNT_HASHTAG_BIPARTITE"), "bipartite_account_hashtag")(lambda t: nw.bipartite(t.posts, t.entities).edges)
query(edges_sql("post_id src, body dst", f"{POSTS} p JOIN {ENTITIES} e USING (post_id) GROUP BY 1,2", "POST_HASHTAG_BIPARTITE"), "bipartite_post_hashtag")(lambda t: nw.bipartite(t.posts, t.entities, "post").edges)
query(f"SELECT DISTINCT account_id node_id, 0 bipartite, 'account' type FROM {POSTS} p JOIN {ENTITIES} e USING (post_id) UNION ALL SELECT DISTINCT body, 1, 'HASHTAG' FROM {POSTS} p JOIN {ENTITIES} e USING (post_id)", "bipartite_nodes")(lambda t: nw.bipartite(t.posts, t.entities).nodes)
B0, B1, BS = datetime(1996, 1, 1), datetime(1998, 7, 1), timedelta(days=365)
BW = "TIMESTAMP '1996-01-01' + INTERVAL 365 DAY * CAST(floor(date_diff('second', TIMESTAMP '1996-01-01', created_at) / 31536000) AS INTEGER)"
query(edges_sql("ws window_start, we window_end, account_id src, body dst", f"(SELECT *, {BW} ws, LEAST({BW} + INTERVAL 365 DAY, TIMESTAMP '1998-07-01') we FROM {POSTS} WHERE created_at >= '1996-01-01' AND created_at < '1998-07-01') p JOIN {ENTITIES} e USING (post_id) GROUP BY 1,2,3,4", "ACCOUNT_HASHTAG_BIPARTITE"), "bipartite_over_time")(
    lambda t: nw.bipartite(t.posts, t.entities, start_time=B0, end_time=B1, step=BS).edges
)
CO = "SELECT a.o src, b.o dst, CAST(COUNT(*) AS BIGINT) weight, 'CO_SHARE' edge_type FROM (SELECT DISTINCT o, t FROM {a} WHERE kind='SHARE') a JOIN (SELECT DISTINCT o, t FROM {a} WHERE kind='SHARE') b ON a.t=b.t AND a.o<b.o GROUP BY 1,2"
query(CO.format(a=ACTIONS), "coaction_share")(lambda t: nw.coaction(t.actions, "SHARE").edges)
query(f"SELECT DISTINCT n node_id, 'account' type FROM (SELECT src n FROM ({CO.format(a=ACTIONS)}) UNION SELECT dst FROM ({CO.format(a=ACTIONS)}))", "coaction_nodes")(lambda t: nw.coaction(t.actions, "SHARE").nodes)
query(f"WITH x AS (SELECT DISTINCT ws, we, o, t FROM {IN} WHERE kind='SHARE') SELECT a.ws window_start, a.we window_end, a.o src, b.o dst, CAST(COUNT(*) AS BIGINT) weight, 'CO_SHARE' edge_type FROM x a JOIN x b ON a.ws=b.ws AND a.t=b.t AND a.o<b.o GROUP BY 1,2,3,4", "coaction_over_time")(
    lambda t: nw.coaction(t.actions, "SHARE", START, END, step=STEP).edges
)
query("SELECT c_custkey, c_name FROM customer WHERE c_custkey = 7", "point_lookup_account")(lambda t: an.point_lookup(t.t("customer").select("c_custkey", "c_name"), "c_custkey", 7))
query(f"SELECT * FROM {POSTS} WHERE post_id = '7'", "point_lookup_post")(lambda t: an.point_lookup(t.posts, "post_id", "7"))
query(f"SELECT * FROM {POSTS} WHERE account_id = '7' ORDER BY created_at DESC, post_id LIMIT 100", "account_timeline")(lambda t: an.timeline(t.posts, "7"))
query("SELECT conv_id, turn, role, text FROM conversations WHERE conv_id = 3", "conversation_thread")(
    lambda t: an.thread(t.t("conversations").select(F.col("conv_id").alias("conversation_id"), F.col("turn").alias("created_at"), F.col("turn").alias("post_id"), "role", "text"), 3).select(F.col("conversation_id").alias("conv_id"), F.col("created_at").alias("turn"), "role", "text")
)
query("SELECT conv_id conversation_id, CAST(COUNT(*) AS BIGINT) n FROM conversations GROUP BY 1 HAVING COUNT(*) >= 4", "long_threads")(lambda t: an.long_threads(t.t("conversations").withColumnRenamed("conv_id", "conversation_id"), 4))
query(f"SELECT CAST(COUNT(*) AS BIGINT) n FROM {POSTS} WHERE created_at >= '1996-01-01' AND created_at < '1997-01-01'", "time_range_count")(lambda t: an.time_range_count(t.posts, "1996-01-01", "1997-01-01"))
query(f"SELECT date_trunc('day', created_at)::TIMESTAMP \"day\", CAST(COUNT(*) AS BIGINT) n FROM {POSTS} GROUP BY 1", "posts_per_day")(lambda t: an.per_day(t.posts))
query(f"SELECT body, CAST(COUNT(*) AS BIGINT) n FROM {ENTITIES} GROUP BY 1 ORDER BY n DESC, body LIMIT 20", "top_hashtags")(lambda t: an.top_entities(t.entities))
query(f"SELECT post_id, body, created_at FROM {ENTITIES} JOIN {POSTS} USING (post_id) WHERE account_id='7' ORDER BY created_at DESC, post_id, body LIMIT 50", "account_hashtags")(lambda t: an.account_entities(t.posts, t.entities, "7"))
query(f"SELECT o originator_account_id, CAST(COUNT(*) AS BIGINT) n FROM {ACTIONS} WHERE kind='SHARE' AND t='5' AND ts >= '2024-01-03' AND ts < '2024-01-20' GROUP BY 1", "who_shared_account")(lambda t: an.who_acted_on(t.actions, "5", "SHARE", "2024-01-03", "2024-01-20"))
query(f"SELECT o originator_account_id, t target_account_id, t target_post_id, kind action_type, ts created_at FROM {ACTIONS} WHERE o='5' ORDER BY ts DESC, t, kind LIMIT 100", "originator_actions")(lambda t: an.originator_actions(t.actions, "5"))
query("SELECT CAST(COUNT(*) AS BIGINT) n FROM documents WHERE text ILIKE '%Tion%'", "text_search_ilike")(lambda t: an.text_search(t.texts, "tion"))
query(f"SELECT post_id, account_id, body FROM {POSTS} JOIN {ENTITIES} USING (post_id) WHERE body='Brand#12'", "hashtag_posts_join")(lambda t: t.posts.select("post_id", "account_id").join(t.entities.where("body = 'Brand#12'").select("post_id", "body"), "post_id"))
query(f"SELECT post_id, platform, '{{\"scores\":{{\"toxicity\":' || toxic || '}}}}' body FROM {TEXTS} JOIN (SELECT CAST(doc_id AS VARCHAR) post_id, toxic FROM labels) USING (post_id)", "enrichment_join")(lambda t: an.enriched(t.texts.select("post_id", "platform"), t.enrichments, "toxicity"))
query(f"SELECT post_id, platform FROM {TEXTS} WHERE post_id NOT IN (SELECT CAST(doc_id AS VARCHAR) FROM labels)", "only_missing_posts")(lambda t: an.not_enriched(t.texts.select("post_id", "platform"), t.enrichments, "toxicity"))
GEO = "((c_custkey * 37) % 360) - 180.0"
query(f"SELECT c_custkey, {GEO} lon, ((c_custkey * 17) % 180) - 90.0 lat FROM customer WHERE sqrt(pow({GEO} - 10, 2) + pow(((c_custkey * 17) % 180) - 90.0 - 20, 2)) <= 15", "spatial_nearby")(
    lambda t: an.nearby(
        t.t("customer").select("c_custkey", ((F.col("c_custkey") * 37) % 360 - 180.0).alias("lon"), ((F.col("c_custkey") * 17) % 180 - 90.0).alias("lat")).withColumn("location", F.concat(F.lit("SRID=4326;POINT("), F.col("lon").cast("string"), F.lit(" "), F.col("lat").cast("string"), F.lit(")"))), 10.0, 20.0, 15.0
    ).drop("location")
)
query(
    " UNION ALL ".join(f"SELECT '{c}' \"column\", CAST(COUNT(*) AS BIGINT) \"rows\", CAST(COUNT({c}) AS BIGINT) filled, CASE WHEN COUNT(*) > 0 THEN COUNT({c}) / COUNT(*) ELSE 0 END completeness FROM orders" for c in ("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")), "profile_completeness"
)(lambda t: profile.completeness(t.t("orders"), ["o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority"]))
query("WITH c AS (SELECT source value, CAST(COUNT(*) AS BIGINT) n FROM documents GROUP BY 1), t AS (SELECT * FROM c ORDER BY n DESC, value LIMIT 8) SELECT * FROM t UNION ALL SELECT 'other', CAST((SELECT COUNT(*) FROM documents) - SUM(n) AS BIGINT) FROM t", "profile_value_counts")(lambda t: profile.value_counts(t.t("documents"), "source"))
query(f"SELECT kind action_type, CAST(COUNT(*) AS BIGINT) \"rows\", CAST(COUNT(o) AS BIGINT) originator_account_id, CAST(COUNT(t) AS BIGINT) target_account_id, CAST(COUNT(t) AS BIGINT) target_post_id FROM {ACTIONS} GROUP BY 1", "profile_action_links")(lambda t: profile.action_links(t.actions))
query("SELECT o_custkey, max(o_orderdate)::DATE o_orderdate FROM orders GROUP BY 1", "latest_account_snapshot")(lambda t: an.latest(t.t("orders").select("o_custkey", F.col("o_orderdate").cast("date").alias("o_orderdate"), "o_orderpriority"), "o_custkey", "o_orderdate").select("o_custkey", "o_orderdate"))
query("SELECT user_id, event_type, value, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, CAST(value AS VARCHAR) DESC) r FROM (SELECT DISTINCT user_id, event_type, value, CAST(ts AS TIMESTAMP) ts FROM events)) WHERE r = 1", "dedup_best")(
    lambda t: quality.dedup_best(t.t("events").select("user_id", "event_type", "value", F.col("ts").cast("timestamp").alias("ts")), ["user_id", "event_type"], "ts")
)
DAYS = "SELECT date_trunc('day', ts)::TIMESTAMP d, SUM(value) total, AVG(value) mean, CAST(COUNT(*) AS BIGINT) n FROM events GROUP BY 1"
r6 = lambda df, *cs: df.withColumns({c: F.round(F.col(c), 6) for c in cs})
query(f"SELECT d \"day\", round(total,6) total, round(mean,6) mean, n, round(mean - AVG(mean) OVER (), 6) deviation FROM ({DAYS})", "daily_sentiment_deviation")(lambda t: r6(an.daily_deviation(t.t("events").select(F.col("ts").cast("timestamp").alias("created_at"), "value"), "value"), "total", "mean", "deviation"))
query("SELECT CAST(hour(ts) AS BIGINT) \"hour\", round(AVG(value),6) mean, CAST(COUNT(*) AS BIGINT) n FROM events GROUP BY 1", "hourly_sentiment")(lambda t: r6(an.hourly(t.t("events").select(F.col("ts").cast("timestamp").alias("created_at"), "value"), "value"), "mean"))
query("SELECT source platform, round(AVG(toxic),6) mean, round(coalesce(stddev_samp(toxic),0),6) std, CAST(COUNT(toxic) AS BIGINT) n FROM documents JOIN labels USING (doc_id) GROUP BY 1", "toxicity_by_group")(
    lambda t: r6(an.spread_by_group(t.texts.join(t.enrichments.select("post_id", F.get_json_object("body", "$.scores.toxicity").cast("double").alias("v")), "post_id"), "platform", "v"), "mean", "std")
)
query(
    "WITH x AS (SELECT event_type, AVG(value) m FROM events WHERE user_id % 2 = 0 GROUP BY 1), y AS (SELECT event_type, AVG(value) m FROM events WHERE user_id % 2 = 1 GROUP BY 1) SELECT event_type, round(x.m,6) mean_a, round(y.m,6) mean_b, round(abs(x.m-y.m),6) difference FROM x JOIN y USING (event_type)", "group_diff_topn"
)(lambda t: r6(an.group_differences(t.t("events").where("user_id % 2 = 0"), t.t("events").where("user_id % 2 = 1"), "event_type", "value"), "mean_a", "mean_b", "difference"))
HOST = "regexp_replace(lower(regexp_replace(regexp_extract(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '^([^/?#]*)', 1), '^.*@|:[0-9]*$', '')), '^www\\.', '')"
query(f"SELECT {HOST} host, CAST(COUNT(*) AS BIGINT) n FROM pages GROUP BY 1", "domain_counts")(lambda t: t.t("pages").groupBy(text.normalize_host(F.col("url")).alias("host")).agg(F.count("*").alias("n")))
RANKS = "(SELECT {h} host, CAST(rank() OVER (ORDER BY COUNT(*) DESC) AS BIGINT) r FROM pages WHERE page_id % 2 = {k} GROUP BY 1)"
half = lambda t, k: t.t("pages").where(f"page_id % 2 = {k}").groupBy(text.normalize_host(F.col("url")).alias("host")).agg(F.count("*").alias("n"))
query(f"SELECT coalesce(a.host, b.host) host, a.r rank_a, b.r rank_b FROM {RANKS.format(h=HOST, k=0)} a FULL JOIN {RANKS.format(h=HOST, k=1)} b ON a.host = b.host", "domain_ranks_full_join")(lambda t: an.ranks_side_by_side(half(t, 0), half(t, 1), "host"))
query("SELECT lower(event_type) body FROM events WHERE user_id < 50 INTERSECT SELECT lower(event_type) FROM events WHERE user_id >= 50", "shared_hashtags_intersect")(lambda t: an.shared_values(t.t("events").where("user_id < 50").select(F.col("event_type").alias("body")), t.t("events").where("user_id >= 50").select(F.col("event_type").alias("body"))))


def _multi(t: Tables, sql: str) -> DataFrame:
    m = MultiStore(t.spark)
    c = t.t("customer")
    m.attach("one", {"accounts": c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("username"), "c_nationkey")})
    m.attach("two", {"accounts": c.where("c_custkey % 3 = 0").select((F.col("c_custkey") + 1000000).alias("id"), F.upper("c_name").alias("username"), "c_nationkey")})
    m.attach("walk", {"pairs": t.t("nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")})
    return m.query(sql)


TWO = "(SELECT c_custkey + 1000000 id, upper(c_name) username, c_nationkey FROM customer WHERE c_custkey % 3 = 0)"
query(f"SELECT a.c_custkey id_a, b.id id_b FROM customer a JOIN {TWO} b ON lower(a.c_name) = lower(b.username)", "cross_dataset_join")(lambda t: _multi(t, "SELECT a.id id_a, b.id id_b FROM one.accounts a JOIN two.accounts b ON lower(a.username) = lower(b.username)"))
query(f"SELECT 'one' d, CAST(COUNT(*) AS BIGINT) n FROM customer UNION ALL SELECT 'two', CAST(COUNT(*) AS BIGINT) FROM {TWO}", "cross_dataset_union")(lambda t: _multi(t, "SELECT 'one' d, count(*) n FROM one.accounts UNION ALL SELECT 'two', count(*) FROM two.accounts"))
query(f"SELECT n_name, CAST(COUNT(*) AS BIGINT) n FROM customer a JOIN nation ON n_nationkey = a.c_nationkey JOIN {TWO} b ON lower(a.c_name) = lower(b.username) GROUP BY 1", "crosswalk_join")(
    lambda t: _multi(t, "SELECT n_name, count(*) n FROM one.accounts a JOIN walk.pairs w ON w.c_nationkey = a.c_nationkey JOIN two.accounts b ON lower(a.username) = lower(b.username) GROUP BY 1")
)
P = "'706570706572'"  # the pepper in hex
HASH = f"sha256(unhex({P} || '01') || unhex(sha256(unhex({P} || '00') || encode(lower(trim({{c}}))) || unhex('FF'))) || unhex('EE'))"
query(f"SELECT c_custkey, {HASH.format(c='c_name')} h FROM customer", "hash_ids")(lambda t: t.t("customer").select("c_custkey", keyed_hash(F.col("c_name"), PEPPER).alias("h")))
query(f"SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN lower(c_name) WHEN c_custkey % 3 = 1 THEN '@u_' || {HASH.format(c='c_name')} ELSE 'media' END body FROM customer", "sanitize_entities")(
    lambda t: t.t("customer").select("c_custkey", sanitize_entity(F.element_at(F.array(F.lit("HASHTAG"), F.lit("USER_TAG"), F.lit("IMAGE")), (F.col("c_custkey") % 3 + 1).cast("int")), F.col("c_name"), PEPPER).alias("body"))
)
MAIL = "[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}"
query(f"SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(lower(text), '{MAIL}'))), ',') mails FROM documents", "extract_emails")(
    lambda t: t.t("documents").select("doc_id", F.array_join(F.array_sort(text.extract_emails(F.col("text"))), ",").alias("mails"))
)
query("SELECT doc_id, md5(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}', '[EMAIL]', 'g')) h FROM documents", "redact_text")(lambda t: t.t("documents").select("doc_id", F.md5(redact(F.col("text"), PEPPER)).alias("h")))
_erase = lambda t, mode: privacy.erase({"accounts": t.t("customer").select(F.col("c_custkey").cast("string").alias("account_id"), F.col("c_name").alias("username")), "posts": t.posts, "actions": t.actions}, "Customer#000000007", mode=mode)[0]
query(f"SELECT * FROM {POSTS} WHERE account_id NOT IN (SELECT CAST(c_custkey AS VARCHAR) FROM customer WHERE c_name='Customer#000000007')", "erase_delete")(lambda t: _erase(t, "DELETE")["posts"])
query(f"SELECT post_id, CASE WHEN x THEN 'erased_' || substr(sha256('erased' || account_id), 1, 32) ELSE account_id END account_id, CASE WHEN NOT x THEN conversation_id END conversation_id, platform, created_at FROM (SELECT *, account_id IN (SELECT CAST(c_custkey AS VARCHAR) FROM customer WHERE c_name='Customer#000000007') x FROM {POSTS})", "erase_scrub")(
    lambda t: _erase(t, "SCRUB")["posts"]
)
query(
    f"SELECT {HASH.format(c='post_id')} post_id, {HASH.format(c='account_id')} account_id, {HASH.format(c='conversation_id')} conversation_id, platform, created_at FROM {POSTS}", "pseudonymize_posts"
)(lambda t: privacy.pseudonymize(t.posts, "posts", PEPPER))
UND = f"(SELECT DISTINCT least(src,dst) a, greatest(src,dst) b FROM ({edges_sql('o src, t dst', ACTIONS + chr(32) + 'GROUP BY 1,2', 'X')}) WHERE src <> dst)"
_graph = lambda t: t.actions.select(F.col("originator_account_id").alias("src"), F.col("target_account_id").alias("dst")).distinct()
query(f"SELECT n node_id, CAST(COUNT(*) AS BIGINT) degree FROM (SELECT a n FROM {UND} UNION ALL SELECT b FROM {UND}) GROUP BY 1", "degree")(lambda t: nw.degree(_graph(t)))
query(
    f"WITH e AS {UND}, s AS (SELECT a x, b y FROM e UNION ALL SELECT b, a FROM e), d AS (SELECT x, COUNT(*) g FROM s GROUP BY 1), t AS (SELECT s1.x, COUNT(*) c FROM s s1 JOIN s s2 ON s1.x = s2.x AND s1.y < s2.y JOIN e ON e.a = s1.y AND e.b = s2.y GROUP BY 1) SELECT d.x node_id, CAST(g AS BIGINT) degree, CAST(coalesce(c,0) AS BIGINT) triangles, round(2.0*coalesce(c,0)/(g*(g-1)),9) clustering FROM d LEFT JOIN t USING (x) WHERE g >= 2",
    "local_clustering",
)(lambda t: nw.local_clustering(_graph(t)).withColumn("clustering", F.round("clustering", 9)))
query(
    f"WITH e AS (SELECT a, b, CAST(a AS INTEGER) % 5 ca, CAST(b AS INTEGER) % 5 cb FROM {UND}), m AS (SELECT COUNT(*) m FROM e), g AS (SELECT c, COUNT(*) ends FROM (SELECT ca c FROM e UNION ALL SELECT cb FROM e) GROUP BY 1), i AS (SELECT ca c, COUNT(*) n FROM e WHERE ca = cb GROUP BY 1) SELECT round(SUM(coalesce(n,0)/m - pow(ends/(2.0*m),2)),9) modularity FROM g LEFT JOIN i USING (c), m", "modularity"
)(lambda t: nw.modularity(_graph(t), nw.endpoints(_graph(t)).withColumn("community", F.col("node_id").cast("int") % 5)).select(F.round("modularity", 9).alias("modularity")))
query(
    f"SELECT CAST(c_custkey AS VARCHAR) account_id, CAST(coalesce(np,0) AS BIGINT) n_posts, CAST(coalesce(ns,0) AS BIGINT) n_shares, CAST(coalesce(nd,0) AS BIGINT) n_distinct_targets FROM customer LEFT JOIN (SELECT account_id, COUNT(*) np FROM {POSTS} GROUP BY 1) p ON p.account_id = CAST(c_custkey AS VARCHAR) LEFT JOIN (SELECT o, COUNT(*) FILTER (kind='SHARE') ns, COUNT(DISTINCT t) nd FROM {ACTIONS} GROUP BY 1) a ON a.o = CAST(c_custkey AS VARCHAR)",
    "bot_features",
)(
    lambda t: an.bot_features(
        t.t("customer").select(F.col("c_custkey").cast("string").alias("account_id"), F.lit(datetime(1994, 1, 1)).alias("created_at"), F.lit(1).alias("follower_count"), F.lit(1).alias("friend_count")),
        t.posts.withColumn("body", F.lit("")), t.actions, t.entities.withColumn("account_id", F.lit(None).cast("string")), datetime(2025, 1, 1),
    ).select("account_id", "n_posts", "n_shares", "n_distinct_targets")
)
query("SELECT lang truth, source guess, CAST(COUNT(*) AS BIGINT) n FROM documents GROUP BY 1,2", "confusion_matrix")(lambda t: an.confusion(t.t("documents").select(F.col("lang").alias("truth"), F.col("source").alias("guess")), "truth", "guess"))
query("WITH c AS (SELECT value, COUNT(*) FILTER (event_type='click') a, COUNT(*) n FROM events GROUP BY 1), r AS (SELECT *, coalesce(SUM(n) OVER (ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) + (n+1)/2.0 rk FROM c) SELECT SUM(rk*a) - SUM(a)*(SUM(a)+1)/2.0 u, CAST(SUM(a) AS BIGINT) n_a, CAST(SUM(n-a) AS BIGINT) n_b FROM r", "mann_whitney_u")(
    lambda t: an.mann_whitney_u(t.t("events"), "event_type", "value", "click").select(F.col("u").cast("double").alias("u"), "n_a", "n_b")
)


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q["user_interaction_comment"](spark, sf_dir)
