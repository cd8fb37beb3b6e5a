"""Edge lists over actions, entities and posts, whole or by tumbling windows."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime, timedelta
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions.values import in_window
from skein.session import shared_checkpoints
from skein.schema import ACTION_TYPES, ENTITY_TYPES

#: What counts as an interaction between users; other actions need to be asked for by ``kinds``.
INTERACTIONS = ("QUOTE", "SHARE", "COMMENT", "FOLLOW", "BLOCK")
WINDOW = ["window_start", "window_end"]
#: One side of a group's self-join is spread over parts of so many members.
HOT_GROUP = 500
#: Where pairs are so many that they are counted by blocks of members: members and rows of a block, edges of a batch.
BLOCK_MEMBERS, BLOCK_ROWS, BATCH = 1500, 500_000, 100_000


@dataclass
class Network:
    """A lazy edge list with its nodes; meta() counts on demand."""

    edges: DataFrame
    nodes: DataFrame
    name: str
    directed: bool
    weighting: str
    filters: dict = field(default_factory=dict)
    node_type: str = "account"
    edge_kind: str = ""

    def meta(self) -> dict:
        """What the network is, with its counts: one job for each of the two."""
        counts = {"node_count": self.nodes.count(), "edge_count": self.edges.count()}
        return {"name": self.name, "node_type": self.node_type, "edge_kind": self.edge_kind, **counts, "directed": self.directed, "weighting": self.weighting, "filters": self.filters}

    def graph(self, most: int = 1_000_000) -> dict[str, dict[str, int]]:
        """The edges as a dict of dicts on the driver; an error above ``most`` edges. Undirected edges stand once."""
        rows = self.edges.select("src", "dst", "weight").limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError(f"over {most} edges; sample() or write() them")
        out: dict[str, dict[str, int]] = {}
        for r in rows:
            out.setdefault(r["src"], {})[r["dst"]] = r["weight"]
        return out

    def graphs(self, most: int = 1_000_000):
        """graph() of a network of any size, in parts: a node's outgoing edges stand in one, which ends when it holds ``most`` edges."""
        out, held = {}, 0
        for r in self.edges.select("src", "dst", "weight").orderBy("src").toLocalIterator(prefetchPartitions=True):
            if held >= most and r["src"] not in out:
                yield out
                out, held = {}, 0
            out.setdefault(r["src"], {})[r["dst"]] = r["weight"]
            held += 1
        yield out

    def chunks(self):
        """Edges one by one, without holding them all."""
        return self.edges.toLocalIterator(prefetchPartitions=True)

    def sample(self, n: int, seed: int = 42) -> DataFrame:
        return self.edges.orderBy(F.rand(seed)).limit(n)

    def write(self, path: str, compression: str = "snappy") -> None:
        self.edges.write.mode("overwrite").parquet(path, compression=compression)


def _allowed(value: str, values, what: str) -> str:
    if value.upper() not in values:
        raise ValueError(f"{what} {value!r} is not one of {', '.join(values)}")
    return value.upper()


def bucket(df: DataFrame, time: str, start: datetime, end: datetime, step: timedelta) -> DataFrame:
    """Adds window_start and window_end of the tumbling window each row is in; the last one ends at ``end``."""
    micros = int(step / timedelta(microseconds=1))
    if micros <= 0:
        raise ValueError("step must be positive")
    first = F.unix_micros(F.lit(start).cast("timestamp"))
    ws = F.timestamp_micros(first + F.floor((F.unix_micros(time) - first) / F.lit(micros).cast("bigint")) * F.lit(micros).cast("bigint"))
    df = df.where(in_window(F.col(time), start, end)).withColumn("window_start", ws)
    return df.withColumn("window_end", F.least(F.timestamp_micros(F.unix_micros("window_start") + F.lit(micros).cast("bigint")), F.lit(end).cast("timestamp")))


def _finish(edges: DataFrame, label: str, weighting: str, min_weight: int | None, by: list[str]) -> DataFrame:
    if weighting not in ("count", "binary"):
        raise ValueError(f"weighting {weighting!r} is not count or binary")
    if min_weight is not None:
        edges = edges.where(F.col("weight") >= min_weight)
    weight = F.lit(1).cast("bigint") if weighting == "binary" else F.col("weight")
    return edges.select(*by, F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"), weight.alias("weight"), F.lit(label).alias("edge_type"))


def _scope(df: DataFrame, time: str, start, end, step) -> tuple[DataFrame, list[str]]:
    if step is None:
        return df.where(in_window(F.col(time), start, end)), []
    if start is None or end is None:
        raise ValueError("windows need a start and an end")
    return bucket(df, time, start, end, step), WINDOW


def _pairs(members: DataFrame, group: list[str], member: str, by: list[str]) -> DataFrame:
    """Weighted pairs a < b of distinct members that share a group.

    Members come distinct. Each group becomes its members' pairs by an equi self-join with an order
    residual, so nothing holds a group whole: its left side is dealt into a part for each HOT_GROUP members.
    """
    sizes = members.groupBy(*group).agg(F.count("*").alias("_n")).where(F.col("_n") > 1)
    salts = F.ceil(F.col("_n") / HOT_GROUP).cast("bigint")
    sized = members.join(sizes, group)
    left = sized.select(*group, F.col(member).alias("src"), F.pmod(F.xxhash64(member), salts).alias("_salt"))
    right = sized.select(*group, F.col(member).alias("dst"), F.explode(F.sequence(F.lit(0).cast("bigint"), salts - 1)).alias("_salt"))
    return left.join(right, [*group, "_salt"]).where("src < dst").groupBy(*by, "src", "dst").agg(F.count("*").alias("weight"))


def _packed(table: pa.Table) -> pa.Table:
    """A block's members and groups as one compressed value."""
    held = pa.table({"m": table["_m"].combine_chunks().dictionary_encode(), "g": table["_g"].combine_chunks().dictionary_encode()})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, held.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_table(held)
    return table.slice(0, 1).drop_columns(["_m", "_g"]).append_column("_data", pa.array([sink.getvalue().to_pybytes()], pa.binary()))


def _unpacked(data: bytes) -> tuple[pa.Array, np.ndarray, pa.Array, np.ndarray]:
    m, g = (x.combine_chunks() for x in pa.ipc.open_stream(data).read_all().columns)
    return m.dictionary, m.indices.to_numpy(), g.dictionary, g.indices.to_numpy()


def shared_counts(ma: np.ndarray, ga: np.ndarray, na: int, mb: np.ndarray, gb: np.ndarray, nb: int, groups: int) -> np.ndarray:
    """How many groups each member a shares with each member b, from distinct (member, group) rows.

    Groups that many of both are in are counted by a product of matrices, the others pair by pair.
    """
    out = np.zeros((na, nb), np.int64)
    ca, cb = np.bincount(ga, minlength=groups), np.bincount(gb, minlength=groups)
    dense = ca * cb * 800 >= na * nb
    ids = np.flatnonzero(dense & (ca * cb > 0))
    at = np.full(groups, -1)
    at[ids] = np.arange(len(ids))
    for k in range(0, len(ids), 1024):  # float32 is exact for sums of so few
        sides = []
        for m, g, n in ((ma, ga, na), (mb, gb, nb)):
            here = (at[g] >= k) & (at[g] < k + 1024)
            side = np.zeros((min(1024, len(ids) - k), n), np.float32)
            side[at[g[here]] - k, m[here]] = 1
            sides.append(side)
        out += (sides[0].T @ sides[1]).astype(np.int64)
    rest_a, rest_b = ~dense[ga], ~dense[gb]
    ma, ga, mb, gb = ma[rest_a], ga[rest_a], mb[rest_b], gb[rest_b]
    order = np.argsort(gb, kind="stable")
    mb, first = mb[order], np.cumsum(np.bincount(gb, minlength=groups)) - np.bincount(gb, minlength=groups)
    lo, ends = 0, np.cumsum(cb[ga])
    while lo < len(ga):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + 4_000_000, "right")))
        times = cb[ga[lo:hi]]
        within = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        codes = np.repeat(ma[lo:hi].astype(np.int64) * nb, times) + mb[np.repeat(first[ga[lo:hi]], times) + within]
        out += np.bincount(codes, minlength=na * nb).reshape(na, nb)
        lo = hi
    return out


def _block_pairs(batches):
    """Edges between the members of two blocks, or within one."""
    for batch in batches:
        by = [c for c in batch.schema.names if c not in ("_i", "_j", "_a", "_b")]
        for r in range(batch.num_rows):
            same = batch["_i"][r] == batch["_j"][r]
            names_a, ma, groups_a, ga = _unpacked(batch["_a"][r].as_py())
            names_b, mb, groups_b, gb = _unpacked(batch["_b"][r].as_py())
            place = pc.fill_null(pc.index_in(groups_b, groups_a), -1).to_numpy()[gb]
            mb, gb = mb[place >= 0], place[place >= 0]
            p, q = np.nonzero(counts := shared_counts(ma, ga, len(names_a), mb, gb, len(names_b), len(groups_a)))
            names = pa.concat_arrays([names_a, names_b])
            rank = np.empty(len(names), np.int64)
            rank[pc.array_sort_indices(names.cast(pa.binary())).to_numpy()] = np.arange(len(names))
            if same:  # names stand twice
                rank = rank[: len(names_a)]
                once = rank[p] < rank[q]
                p, q = p[once], q[once]
                src, dst = p, q
            else:
                ahead = rank[p] < rank[len(names_a) + q]
                src, dst = np.where(ahead, p, len(names_a) + q), np.where(ahead, len(names_a) + q, p)
            weight = counts[p, q]
            for k in range(0, len(src), BATCH):
                part = slice(k, k + BATCH)
                n = len(src[part])
                yield pa.RecordBatch.from_arrays([*[pa.repeat(batch[c][r], n) for c in by], names.take(pa.array(src[part])), names.take(pa.array(dst[part])), pa.array(weight[part])], names=[*by, "src", "dst", "weight"])


def _dense_pairs(members: DataFrame, group: list[str], member: str, by: list[str]) -> DataFrame:
    """_pairs() for groups of many members: what is shuffled grows with the members, not with their pairs.

    Members are dealt into blocks. Each two blocks meet in one task, which counts the groups that their members
    share and gives each pair once, so pairs are never shuffled. A first job counts rows and pairs; where pairs
    are few, they are made by the join.
    """
    sizes = members.groupBy(*group).agg(F.count("*").alias("n")).agg(F.sum("n").alias("rows"), F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("pairs")).first()
    distinct = members.agg(F.approx_count_distinct(member)).first()[0]
    blocks = max(4, ceil(distinct / BLOCK_MEMBERS), ceil((sizes["rows"] or 0) / BLOCK_ROWS))
    if (sizes["rows"] or 0) * blocks * 8 >= (sizes["pairs"] or 0):
        return _pairs(members, group, member, by)
    key = next(c for c in group if c not in by)
    rows = members.select(*by, F.pmod(F.xxhash64(member), F.lit(blocks)).alias("_i"), F.col(member).cast("string").alias("_m"), F.col(key).cast("string").alias("_g"))
    typed = [f"{c} timestamp" for c in by]
    packed = rows.groupBy(*by, "_i").applyInArrow(_packed, ", ".join([*typed, "_i bigint", "_data binary"]))
    at = F.col("_i")
    left = packed.select(*by, at.alias("_i"), F.explode(F.sequence(at, F.lit(blocks - 1).cast("bigint"))).alias("_j"), F.col("_data").alias("_a"))
    right = packed.select(*by, F.explode(F.sequence(F.lit(0).cast("bigint"), at)).alias("_i"), at.alias("_j"), F.col("_data").alias("_b"))
    keys, n = [*by, "_i", "_j"], min(blocks * (blocks + 1) // 2, 2000)
    met = left.repartition(n, *keys).join(right.repartition(n, *keys).hint("shuffle_merge"), keys)  # a task for each two blocks, however small they are
    return met.mapInArrow(_block_pairs, ", ".join([*typed, "src string", "dst string", "weight bigint"]))


def _linked(members: DataFrame, group: list[str], member: str, by: list[str]) -> DataFrame:
    """The members that share a group with another: the endpoints of all pairs, without making them."""
    shared = members.groupBy(*group).agg(F.count("*").alias("_n")).where(F.col("_n") > 1)
    return members.join(shared, group, "left_semi").select(*by, F.col(member).cast("string").alias("node_id")).distinct()


def endpoints(edges: DataFrame, by: list[str] = ()) -> DataFrame:
    return edges.select(*by, F.col("src").alias("node_id")).union(edges.select(*by, F.col("dst").alias("node_id"))).distinct()


def user_interaction(actions: DataFrame, interaction: str, start_time=None, end_time=None, weighting="count", min_weight=None, step=None, kinds=INTERACTIONS) -> Network:
    kind = _allowed(interaction, kinds, "interaction")
    rows, by = _scope(actions.where(F.col("action_type") == kind), "created_at", start_time, end_time, step)
    rows = rows.where(F.col("originator_account_id").isNotNull() & F.col("target_account_id").isNotNull())
    edges = rows.groupBy(*by, F.col("originator_account_id").alias("src"), F.col("target_account_id").alias("dst")).agg(F.count("*").alias("weight"))
    edges = _finish(edges, kind, weighting, min_weight, by)
    return Network(edges, endpoints(edges, by), "user_interaction", True, weighting, {"interaction": kind}, "account", kind)


def entity_cooccurrence(entities: DataFrame, entity_type: str = "HASHTAG", start_time=None, end_time=None, weighting="count", min_weight=None, step=None) -> Network:
    kind = _allowed(entity_type, ENTITY_TYPES, "entity type")
    rows, by = _scope(entities.where((F.col("entity_type") == kind) & F.col("post_id").isNotNull() & F.col("body").isNotNull()), "created_at", start_time, end_time, step)
    members, group = rows.select(*by, "post_id", "body").distinct(), [*by, "post_id"]
    edges = _finish(_pairs(members, group, "body", by), f"{kind}_COOCCURRENCE", weighting, min_weight, by)
    nodes = _linked(members, group, "body", by) if (min_weight or 0) <= 1 else endpoints(edges, by)
    return Network(edges, nodes.select("*", F.col("node_id").alias("label"), F.lit(kind).alias("type")), "entity_cooccurrence", False, weighting, {"entity_type": kind}, kind.lower(), "CO_OCCURRENCE")


def bipartite(posts: DataFrame, entities: DataFrame, left: str = "account", right: str = "HASHTAG", start_time=None, end_time=None, weighting="count", min_weight=None, step=None) -> Network:
    if left not in ("account", "post"):
        raise ValueError(f"left {left!r} is not account or post")
    kind = _allowed(right, ENTITY_TYPES, "entity type")
    rows, by = _scope(posts, "created_at", start_time, end_time, step)
    own = "account_id" if left == "account" else "post_id"
    tagged = entities.where((F.col("entity_type") == kind) & F.col("body").isNotNull()).select("post_id", "body")
    rows = rows.select(*by, "post_id", F.col(own).alias("src")).join(tagged, "post_id").where(F.col("src").isNotNull())
    edges = _finish(rows.groupBy(*by, "src", F.col("body").alias("dst")).agg(F.count("*").alias("weight")), f"{left.upper()}_{kind}_BIPARTITE", weighting, min_weight, by)
    side = lambda c, n, t: edges.select(*by, F.col(c).alias("node_id"), F.lit(n).alias("bipartite"), F.lit(t).alias("type")).distinct()
    return Network(edges, side("src", 0, left).unionByName(side("dst", 1, kind)), "bipartite", False, weighting, {"left": left, "right": kind}, f"{left}/{kind.lower()}", "BIPARTITE")


def coaction(actions: DataFrame, action: str, start_time=None, end_time=None, weighting="count", min_weight=None, directed=False, step=None) -> Network:
    kind = _allowed(action, ACTION_TYPES, "action")
    rows, by = _scope(actions.where((F.col("action_type") == kind) & F.col("originator_account_id").isNotNull() & F.col("target_post_id").isNotNull()), "created_at", start_time, end_time, step)
    members, group = rows.select(*by, "target_post_id", "originator_account_id").distinct(), [*by, "target_post_id"]
    edges = _finish(_dense_pairs(members, group, "originator_account_id", by), f"CO_{kind}", weighting, min_weight, by)
    nodes = _linked(members, group, "originator_account_id", by) if (min_weight or 0) <= 1 else endpoints(edges, by)
    return Network(edges, nodes.withColumn("type", F.lit("account")), "coaction", directed, weighting, {"action": kind}, "account", f"CO_{kind}")


def windows(spark, start: datetime, end: datetime, step: timedelta) -> DataFrame:
    """All windows, for those who want the empty ones by a left join."""
    n, rows = start, []
    while n < end:
        rows.append((n, min(n + step, end)))
        n += step
    return spark.createDataFrame(rows, "window_start timestamp, window_end timestamp")


def neighbours(edges: DataFrame) -> DataFrame:
    """(a, b) with a < b, each undirected pair once, loops left out."""
    return edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()


def degree(edges: DataFrame) -> DataFrame:
    e = neighbours(edges)
    return e.select(F.col("a").alias("node_id")).union(e.select("b")).groupBy("node_id").agg(F.count("*").alias("degree"))


def local_clustering(edges: DataFrame, least_degree: int = 2) -> DataFrame:
    """node_id, degree, triangles, clustering of nodes with the degree at least.

    Every edge points to its end of higher degree, so a node has few outgoing edges, even a hub, and
    wedges are made at those only.
    """
    e, d = neighbours(edges), degree(edges)
    ranked = e.join(d.select(F.col("node_id").alias("a"), F.col("degree").alias("da")), "a").join(d.select(F.col("node_id").alias("b"), F.col("degree").alias("db")), "b")
    swap = (F.col("da") > F.col("db")) | ((F.col("da") == F.col("db")) & (F.col("a") > F.col("b")))
    out = ranked.select(F.when(swap, F.col("b")).otherwise(F.col("a")).alias("u"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("v"))
    wedge = out.select("u", F.col("v").alias("x")).join(out.select("u", F.col("v").alias("y")), "u").where("x < y")
    closed = wedge.join(e.select(F.col("a").alias("x"), F.col("b").alias("y")), ["x", "y"])
    t = closed.select(F.explode(F.array("u", "x", "y")).alias("node_id")).groupBy("node_id").agg(F.count("*").alias("triangles"))
    n = F.col("degree")
    return d.where(n >= least_degree).join(t, "node_id", "left").select("node_id", "degree", F.coalesce("triangles", F.lit(0)).cast("bigint").alias("triangles"), F.when(n > 1, 2.0 * F.coalesce("triangles", F.lit(0)) / (n * (n - 1))).otherwise(0.0).alias("clustering"))


def modularity(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """One row, modularity: of the labelling (node_id, community) on the unweighted undirected edges."""
    e = neighbours(edges)
    at = lambda x: labels.select(F.col("node_id").alias(x), F.col("community").alias(f"c{x}"))
    e = e.join(at("a"), "a").join(at("b"), "b")
    inside = e.where("ca = cb").groupBy(F.col("ca").alias("c")).agg(F.count("*").alias("inside"))
    ends = e.select(F.explode(F.array("ca", "cb")).alias("c")).groupBy("c").agg(F.count("*").alias("ends"))
    total = e.agg(F.count("*").alias("m"))
    rows = ends.join(inside, "c", "left").crossJoin(F.broadcast(total))  # total is one row
    return rows.agg(F.sum(F.coalesce("inside", F.lit(0)) / F.col("m") - F.pow(F.col("ends") / (2 * F.col("m")), 2)).alias("modularity"))


def transitivity(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """community, triangles, wedges, transitivity (closed wedges by wedges) of the edges within each community of (node_id, community)."""
    e = neighbours(edges)
    at = lambda x: labels.select(F.col("node_id").alias(x), F.col("community").alias(f"c{x}"))
    inside = e.join(at("a"), "a").join(at("b"), "b").where("ca = cb").select(F.col("a").alias("src"), F.col("b").alias("dst"))
    each = local_clustering(inside, 1).join(labels, "node_id")
    wedges = F.sum(F.col("degree") * (F.col("degree") - 1) / 2).cast("bigint")
    out = each.groupBy("community").agg((F.sum("triangles") / 3).cast("bigint").alias("triangles"), wedges.alias("wedges"))
    return out.withColumn("transitivity", F.when(F.col("wedges") > 0, 3.0 * F.col("triangles") / F.col("wedges")).otherwise(0.0))


def label_propagation(edges: DataFrame, rounds: int = 10) -> DataFrame:
    """node_id, community: each round a node takes its neighbours' commonest label, ties to the smallest.

    Needs a checkpoint folder that all executors share (``spark.checkpoint.dir``); a local session makes its own.
    """
    shared_checkpoints(edges.sparkSession)
    e = neighbours(edges)
    both = e.union(e.select("b", "a")).checkpoint()
    labels = both.select(F.col("a").alias("node_id"), F.col("a").alias("community")).distinct()
    for _ in range(rounds):
        votes = both.join(labels.withColumnRenamed("node_id", "b"), "b").groupBy("a", "community").agg(F.count("*").alias("n"))
        # the largest count first, then the smallest label
        labels = votes.groupBy(F.col("a").alias("node_id")).agg(F.min(F.struct((-F.col("n")).alias("n"), "community")).alias("m")).select("node_id", F.col("m.community").alias("community")).checkpoint()
    return labels
