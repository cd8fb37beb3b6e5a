"""SimHash near-duplicates by a self-join of binary tries."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import bound_batches, checkpoint, connected_components, release, utf8

BITS, BUDGET, SHINGLE = 64, 2, 3
#: Fingerprints that differ in 2 bits agree in two of four blocks at least; so many pairs of blocks there are.
BLOCKS = 4
SMALL = 24


def fingerprint(text: bytes) -> int:
    words = text.lower().split()  # of bytes: A-Z only, and the six ASCII white-space characters only
    if not words:
        return 0
    whole = [b" ".join(words)] if len(words) < SHINGLE else map(b" ".join, zip(*(words[i:] for i in range(SHINGLE))))
    h = np.fromiter(map(lambda s: xxhash.xxh64_intdigest(s, 42), whole), np.uint64)
    ones = np.zeros(BITS, np.int64)
    for a in range(0, len(h), 65536):
        ones += np.unpackbits(h[a : a + 65536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(h)).tobytes(), "big")


def fingerprints(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) and the columns ``keep``."""
    bound_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            raw = data.tobytes()
            fps = [fingerprint(raw[a:b]) for a, b in zip(offsets[:-1], offsets[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(fps, np.uint64).view(np.int64)), *batch.columns[2:]], names=["doc_id", "fp", *keep])
            del batch, data, offsets, raw
        release()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *keep)
    return rows.mapInArrow(run, ", ".join(["doc_id long", "fp long", *[f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[2:]]]))


class Forest:
    """Union-find over positions."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = sorted((self.root(i), self.root(j)))
        self.up[j] = i
        return i != j


def trie_links(keys: np.ndarray, budget: int = BUDGET, bits: int = BITS) -> list[tuple[int, int]]:
    """Links (positions in sorted distinct ``keys``) that connect all pairs within ``budget`` differing bits.

    A trie node is a range of the sorted keys and a depth. Node pairs go down together with the bits they
    differ in so far; a pair over the budget is left, and so is one whose leaves are linked already.
    """
    forest, out = Forest(len(keys)), []
    todo = [(0, len(keys), 0, len(keys), bits, 0)]
    while todo:
        a, b, c, d, bit, wrong = todo.pop()
        if (b - a) * (d - c) <= SMALL * SMALL or bit == 0:
            near = np.bitwise_count(keys[a:b, None] ^ keys[None, c:d]) <= budget
            for i, j in zip(*np.nonzero(near)):
                if a + i < c + j and forest.join(a + int(i), c + int(j)):
                    out.append((a + int(i), c + int(j)))
            continue
        if b - a + d - c > 4 * SMALL:
            roots = {forest.root(i) for i in (*range(a, b), *range(c, d))} if forest.root(a) == forest.root(b - 1) == forest.root(c) == forest.root(d - 1) else ()
            if len(roots) == 1:
                continue
        bit -= 1
        left = _halves(keys, a, b, bit)
        right = left if (a, b) == (c, d) else _halves(keys, c, d, bit)
        for i, (p, q) in enumerate(left):
            for j, (r, s) in enumerate(right):
                worse = wrong + (i != j)
                if p < q and r < s and worse <= budget and not ((a, b) == (c, d) and i > j):
                    todo.append((p, q, r, s, bit, worse))
    return out


def _halves(keys: np.ndarray, a: int, b: int, bit: int):
    one = np.uint64(1 << bit)
    cut = a + int(np.searchsorted(keys[a:b] & one, one)) if b > a else a
    return (a, cut), (cut, b)


def links(distinct: DataFrame) -> DataFrame:
    """(a, b): edges that connect all fingerprints (column fp, distinct) within BUDGET bits of each other.

    Every fingerprint goes to each pair of its four blocks of 16 bits. A group of equal pair value is a trie
    of its own; equal keys lie side by side in a partition, so thousands of groups cost one pass. A group
    yields links fewer than its members, whatever the number of its pairs.
    """
    width = BITS // BLOCKS
    block = [F.shiftrightunsigned("fp", width * i).bitwiseAND(F.lit((1 << width) - 1)) for i in range(BLOCKS)]
    pairs = F.array(*[(F.lit(k).cast("long") * (1 << 2 * width)) + block[i] * (1 << width) + block[j] for k, (i, j) in enumerate(combinations(range(BLOCKS), 2))])
    keyed = distinct.select(F.explode(pairs).alias("key"), "fp")

    def linked(keys: list[np.ndarray], fps: list[np.ndarray]) -> pa.RecordBatch:
        keys, fps, a, b = np.concatenate(keys), np.concatenate(fps), [], []
        at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
        ends = np.append(at[1:], len(keys))
        for lo, hi in zip(at[ends - at > 1], ends[ends - at > 1]):
            own = np.unique(fps[lo:hi])
            for i, j in trie_links(own):
                a.append(own[i])
                b.append(own[j])
        return pa.RecordBatch.from_arrays([pa.array(np.array(x, np.uint64).view(np.int64)) for x in (a, b)], names=["a", "b"])

    def run(batches):
        keys, fps = [], []  # of the last group, which may go on
        for batch in batches:
            k, f = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            if not len(k):
                continue
            if keys and keys[0][0] == k[-1]:  # all of the batch is in that group
                keys.append(k)
                fps.append(f)
                continue
            cut = int(np.searchsorted(k, k[-1]))
            yield linked([*keys, k[:cut]], [*fps, f[:cut]])
            keys, fps = [k[cut:]], [f[cut:]]
        if keys:
            yield linked(keys, fps)
        release()

    n = distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")
    return keyed.repartition(int(n), "key").sortWithinPartitions("key").mapInArrow(run, "a long, b long").distinct()


def components(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, fp, root (the fingerprint that stands for the component), component_id and the columns ``keep`` of every row."""
    fps = checkpoint(fingerprints(docs, keep))
    groups = fps.groupBy("fp").agg(F.min("doc_id").alias("low"))
    roots = connected_components(links(groups.select("fp")))
    named = groups.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    low = named.groupBy("root").agg(F.min("low").alias("component_id"))
    return fps.join(named.join(low, "root").select("fp", "root", "component_id"), "fp")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable) for every row.

    A-Z are lower-cased; fingerprints over 3-word shingles (fewer words: the sequence; none or null: zero)
    link at 2 or fewer differing bits, and links are followed to the end. Equal fingerprints are one node,
    so copies are never paired. Repeated doc_ids give a row each; rows with null doc_id keep it and never
    name a component unless no other id is there.
    """
    return components(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
