"""Language-model scores: a hashed maximum-entropy model with a class-factored softmax, down to each token."""

from __future__ import annotations

from collections import Counter
from heapq import heapify, heappop, heappush
from itertools import repeat
from operator import itemgetter
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.common import bound_batches, checkpoint, release, utf8

#: Tokens with an own symbol. Classes of tokens that keep company, and the members of a class: its commonest tokens one by
#: one, the next in tiers that end at so many tokens, and last the rest of the class. Tiers and rests are told apart further by trees.
FREQUENT, CLASSES, SINGLE, TIERS = 32_768, 16, 12, (128, 512)
MEMBERS = SINGLE + len(TIERS) + 2
#: Tokens whose counts every worker has; those of the others are joined.
NEAR = 131_072
REST = MEMBERS - 1
#: Tokens whose company is counted over all documents, and the tokens that count as company: the commonest ones.
SIGNED, ANCHORS = 2048, 64
#: Feature templates: the word before, the word two before (a skip), both as one. Buckets of each, for classes and for members (powers of two).
TEMPLATES, BUCKETS, MEMBER_BUCKETS = 3, 4096, 1024
#: Ways of a node of the trees, leaves of a class's rest (its tokens are hashed to them), buckets of each template for nodes (a power of two).
WAYS, LEAVES, NODE_BUCKETS = 16, 4096, 16_384
#: The bias of a child without tokens.
NEVER = -30.0
#: Training rounds. Each takes one position in ROUNDS, so all rounds take every one.
ROUNDS = 1
STEP, BATCH, FLUSH, BLOCK = 0.3, 16_384, 300_000, 100_000
#: Decisions of a step over nodes: about those of BATCH positions.
NODE_BATCH = 2 * BATCH
#: Positions whose softmaxes are taken at once: so many stay in a processor's own memory.
PIECE = 4096
#: Logits up to this, whose powers of e add up without overflow; rows of a bucket that are added bucket beside bucket.
FLAT, RANKS = 80.0, 16
#: A token's last three bytes.
LAST = itemgetter(slice(-3, None))


def tokens(text: bytes) -> list[bytes]:
    return text.lower().split()  # of bytes: A-Z and ASCII white space only


def count_tokens(docs: DataFrame) -> DataFrame:
    """token, c over all texts; the empty token stands for the ends."""

    def run(batches):
        counts: Counter = Counter()

        def emit():
            out = pa.RecordBatch.from_arrays([pa.array([*counts], pa.binary()).cast(pa.string()), pa.array([*counts.values()], pa.int64())], names=["token", "c"])
            counts.clear()
            return out

        for batch in batches:
            data, offsets = utf8(batch.column(0))
            raw = data.tobytes()
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                counts.update(tokens(raw[a:b]))
                if len(counts) > FLUSH:
                    yield emit()
            counts[b""] += len(offsets) - 1
            del batch, data, raw
        yield emit()
        release()

    return docs.select("text").mapInArrow(run, "token string, c long").groupBy("token").agg(F.sum("c").alias("c"))


def commonest(vocabulary: DataFrame, most: int = FREQUENT) -> list[tuple[bytes, int]]:
    """The commonest tokens, ``most`` at the most: all that are over a threshold of counts, in order; ties by token.

    The threshold comes from a histogram of counts in 64ths of a power of two, so what reaches the driver is
    bounded by ``most`` whatever the partitions.
    """
    bucket = F.floor(F.log2("c") * 64)
    least, held = None, 0
    for b, n in sorted(((r["b"], r["n"]) for r in vocabulary.groupBy(bucket.alias("b")).agg(F.count("*").alias("n")).collect()), reverse=True):
        held += n
        if held > most:
            break
        least = b
    if least is None:
        return []
    return sorted(((r["token"].encode(), r["c"]) for r in vocabulary.where(bucket >= least).collect()), key=lambda x: (-x[1], x[0]))


def blocks(column: pa.Array):
    """(words of many texts end to end, each text's with the end, where the texts start), a text at least at a time."""
    data, offsets = utf8(column)
    raw = data.tobytes()
    words, starts = [], []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        starts.append(len(words))
        words += tokens(raw[a:b])
        words.append(b"")
        if len(words) > BLOCK:
            yield words, np.array(starts, np.int64)
            words, starts = [], []
    if starts:
        yield words, np.array(starts, np.int64)


def company(docs: DataFrame, top: list[bytes]) -> np.ndarray:
    """For each of the SIGNED commonest tokens, in how many documents it meets each of the ANCHORS commonest; of all documents."""
    index, names = {w: i for i, w in enumerate(top[:SIGNED])}, [f"a{k}" for k in range(ANCHORS)]

    def run(batches):
        met = np.zeros((SIGNED, ANCHORS), np.int64)
        for batch in batches:
            for words, starts in blocks(batch.column(0)):
                own = np.fromiter(map(index.get, words, repeat(-1)), np.int64, len(words))
                row = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(words))))[own >= 0]
                for a in range(0, len(starts), 256):  # documents in pieces
                    lo, hi = np.searchsorted(row, [a, a + 256])
                    there = np.zeros((256, SIGNED), np.float32)
                    there[row[lo:hi] - a, own[own >= 0][lo:hi]] = 1
                    met += (there.T @ there[:, :ANCHORS]).astype(np.int64)
            del batch
        some = np.flatnonzero(met.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(some), *[pa.array(met[some, k]) for k in range(ANCHORS)]], names=["w", *names])
        release()

    rows = docs.select("text").mapInArrow(run, "w long, " + ", ".join(f"{x} long" for x in names)).groupBy("w").agg(*[F.sum(x).alias(x) for x in names]).toArrow()  # SIGNED rows
    out = np.zeros((min(SIGNED, len(top)), ANCHORS))
    if rows.num_rows:
        out[rows["w"].to_numpy()] = np.stack([rows[x].to_numpy() for x in names], 1)
    return out


def grouped(met: np.ndarray) -> np.ndarray:
    """A class for each signed token, by k-means of the shares of its documents that hold each anchor."""
    out = np.zeros(len(met), np.int64)
    if len(met) < 4 * CLASSES:
        return out
    x = met / np.maximum(met.max(1, keepdims=True), 1)
    x -= x.mean(0)
    x /= np.linalg.norm(x, axis=1, keepdims=True) + 1e-9
    centres = x[:1]
    for _ in range(CLASSES - 1):  # each further centre is the row farthest from the others
        centres = np.vstack([centres, x[np.argmax(((x[:, None] - centres) ** 2).sum(2).min(1))]])
    for _ in range(20):
        out = np.argmin(((x[:, None] - centres) ** 2).sum(2), axis=1)
        for g in range(CLASSES):
            if (out == g).any():
                centres[g] = x[out == g].mean(0)
    return out


class Classes:
    """The class of each token and its member of the class: by company, or by a signed token with the same last bytes."""

    def __init__(self, top: list[tuple[bytes, int]], met: np.ndarray):
        words = [w for w, _ in top]
        signed = grouped(met)
        votes: dict[bytes, np.ndarray] = {}
        for w, g in zip(words, signed):
            for k in (1, 2, 3):
                votes.setdefault(w[-k:], np.zeros(CLASSES))[g] += 1
        self.suffix = {s: int(v.argmax()) for s, v in votes.items()}
        self.symbol = {w: i for i, w in enumerate(words)}
        seen, own = [0] * CLASSES, []
        for i, w in enumerate(words):
            g = int(signed[i]) if i < len(signed) else self.group(w)
            k = seen[g]
            own.append(g * MEMBERS + (k if k < SINGLE else SINGLE + int(np.searchsorted(TIERS, k, "right"))))
            seen[g] += 1
        #: class * MEMBERS + member of each frequent token, and its count
        self.of, self.count = np.array(own, np.int64), np.array([c for _, c in top], np.int64)
        self.size = np.bincount(self.of, self.count, CLASSES * MEMBERS)
        self.plant()
        #: tokens of each leaf of the classes' rests
        self.rest = np.zeros(CLASSES * LEAVES)

    def plant(self) -> None:
        """A tree for each tier: its tokens are the leaves, so a softmax at each node on the way tells a token from all others."""
        paths: list[list[tuple[int, int]]] = [[] for _ in self.of]
        nodes: list[np.ndarray] = []
        order = np.argsort(self.of, kind="stable")
        for tier in np.split(order, np.flatnonzero(np.diff(self.of[order])) + 1):
            if len(tier) > 1:
                for i, path in zip(tier.tolist(), huffman(self.count[tier].tolist(), nodes)):
                    paths[i] = path
        steps = [x for path in paths for x in path]
        self.first_step = np.cumsum([0, *map(len, paths)])
        self.node, self.child = (np.array([x[k] for x in steps], np.int64) for k in (0, 1))
        self.child_size = np.array(nodes).reshape(-1, WAYS)

    def decisions(self, symbols: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(position, node, child) of every step below the members. Rests follow the tiers' nodes: three levels in each class."""
        own = np.flatnonzero(symbols < FREQUENT)
        start = self.first_step[symbols[own]]
        many = self.first_step[symbols[own] + 1] - start
        own, start, many = own[many > 0], start[many > 0], many[many > 0]
        at = np.repeat(own, many)
        k = np.arange(len(at)) + np.repeat(start - np.cumsum(many) + many, many)
        rest = np.flatnonzero(symbols >= FREQUENT)
        leaf, base = self.leaf(symbols[rest]), len(self.child_size) + of[rest] // MEMBERS * (1 + WAYS + WAYS**2)
        a, b, c = leaf // WAYS**2, leaf // WAYS % WAYS, leaf % WAYS
        return (
            np.concatenate([at, rest, rest, rest]),
            np.concatenate([self.node[k], base, base + 1 + a, base + 1 + WAYS + leaf // WAYS]),
            np.concatenate([self.child[k], a, b, c]),
        )

    @staticmethod
    def leaf(symbols):
        """The leaf of its class's rest, for symbols of tokens that aren't frequent."""
        return (symbols - FREQUENT) % LEAVES

    def sizes(self) -> np.ndarray:
        """Training tokens below each child of each node."""
        low = self.rest.reshape(CLASSES, WAYS, WAYS, WAYS)
        rests = [np.concatenate([x.sum((1, 2))[None], x.sum(2), x.reshape(-1, WAYS)]) for x in low]
        return np.concatenate([self.child_size, *rests])

    def group(self, word: bytes) -> int:
        s = self.suffix
        g = s.get(word[-3:])
        if g is None:
            g = s.get(word[-2:])
        return s.get(word[-1:], 0) if g is None else g

    def groups(self, words) -> np.ndarray:
        """The group of each of these."""
        words = [*words]
        out = np.fromiter(map(self.suffix.get, map(LAST, words), repeat(-1)), np.int64, len(words))
        for i in np.flatnonzero(out < 0).tolist():  # an ending of three bytes that no frequent token has
            out[i] = self.group(words[i])
        return out

    def coded(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(symbols, class * MEMBERS + member, places of the tokens that aren't frequent); those are hashed by themselves."""
        symbols = np.fromiter(map(self.symbol.get, words, repeat(-1)), np.int64, len(words))
        rare = np.flatnonzero(symbols < 0)
        of = np.full(len(words), REST, np.int64)
        common = np.flatnonzero(symbols >= 0)
        of[common] = self.of[symbols[common]]
        if len(rare):
            own = [words[i] for i in rare.tolist()]
            symbols[rare] = np.fromiter(map(crc32, own), np.int64, len(own)) + FREQUENT
            of[rare] += self.groups(own) * MEMBERS
        return symbols, of, rare


def huffman(counts: list[int], nodes: list[np.ndarray]) -> list[list[tuple[int, int]]]:
    """(node, child) from the root to each of these leaves, the commonest nearest; the nodes' children's counts are added to nodes."""
    heap: list[tuple] = [(c, i) for i, c in enumerate(counts)]
    heap += [(0, -1 - i) for i in range(-(len(counts) - 1) % (WAYS - 1))]  # so that every node is full
    heapify(heap)
    parent: dict[int, tuple[int, int]] = {}
    name, at = len(counts), {}
    while len(heap) > 1:
        children = [heappop(heap) for _ in range(WAYS)]
        for k, (_, i) in enumerate(children):
            parent[i] = (name, k)
        at[name] = len(nodes)
        nodes.append(np.array([c for c, _ in children], float))
        heappush(heap, (sum(c for c, _ in children), name))
        name += 1
    out = []
    for i in range(len(counts)):
        path = []
        while i in parent:
            i, k = parent[i]
            path.append((at[i], k))
        out.append(path[::-1])
    return out


def features(symbols: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A hash for each template at each position; before a document stands a symbol of its own."""
    before = []
    at = np.arange(len(symbols)) - np.repeat(starts, np.diff(np.append(starts, len(symbols))))
    for k in (1, 2):
        x = np.full(len(symbols), (1 << 40) - 1, np.uint64)
        x[k:] = symbols[:-k]
        x[at < k] = (1 << 40) - 1
        before.append(x)
    mix = lambda x, k: (x * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k)) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(40)
    return np.stack([mix(before[0], 1), mix(before[1], 2), mix(before[0] * np.uint64(0xD6E8FEB86659FD93) ^ before[1], 3)]).astype(np.int64)


class Model:
    """Weights of softmaxes: of the class, of the member in its class, and of a node's child. Rows are feature buckets, the last ones biases."""

    def __init__(self, classes: Classes):
        self.first = np.zeros((TEMPLATES * BUCKETS + 1, CLASSES), np.float32)
        self.second = np.zeros(((TEMPLATES * MEMBER_BUCKETS + 1) * CLASSES, MEMBERS), np.float32)
        size = classes.size.reshape(CLASSES, MEMBERS)
        self.first[-1] = np.log((size.sum(1) + 1) / (size.sum() + CLASSES))
        self.second[-CLASSES:] = np.log((size + 1) / (size.sum(1, keepdims=True) + MEMBERS))
        size = classes.sizes()
        self.third = np.zeros((TEMPLATES * NODE_BUCKETS + len(size), WAYS), np.float32)
        with np.errstate(divide="ignore", invalid="ignore"):
            bias = np.where(size > 0, np.log(size / size.sum(1, keepdims=True)), NEVER)
        self.third[TEMPLATES * NODE_BUCKETS :] = np.where(size.sum(1, keepdims=True) > 0, bias, 0)

    def copy(self) -> Model:
        out = object.__new__(Model)
        out.first, out.second, out.third = self.first.copy(), self.second.copy(), self.third.copy()
        return out

    def tables(self) -> tuple[np.ndarray, ...]:
        return self.first, self.second, self.third

    @staticmethod
    def rows(f: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows of both tables for these feature hashes and classes."""
        shift = np.arange(TEMPLATES)[:, None]
        first = np.vstack([(f & BUCKETS - 1) + shift * BUCKETS, np.full((1, len(g)), TEMPLATES * BUCKETS)])
        second = np.vstack([(f & MEMBER_BUCKETS - 1) + shift * MEMBER_BUCKETS, np.full((1, len(g)), TEMPLATES * MEMBER_BUCKETS)]) * CLASSES + g
        return first, second

    @staticmethod
    def node_rows(f: np.ndarray, node: np.ndarray) -> np.ndarray:
        """The rows of the third table for these feature hashes and nodes."""
        mixed = (f.astype(np.uint64) + node.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(40)
        shift = np.arange(TEMPLATES)[:, None] * NODE_BUCKETS
        return np.vstack([(mixed.view(np.int64) & NODE_BUCKETS - 1) + shift, TEMPLATES * NODE_BUCKETS + node])

    def log_probability(self, f: np.ndarray, of: np.ndarray) -> np.ndarray:
        """Natural log of P(class) P(member | class) at these positions."""
        g = of // MEMBERS
        m = of - g * MEMBERS
        out = np.empty(len(of))
        for a in range(0, len(of), PIECE):
            b, part = slice(a, a + PIECE), 0.0
            for weights, rows, target in zip((self.first, self.second), self.rows(f[:, b], g[b]), (g[b], m[b])):
                part = part + chosen(weights, rows, target)
            out[b] = part
        return out

    def log_below(self, f: np.ndarray, decisions: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
        """Natural log of P(token's leaf | member) at each position of f: the sum over its nodes."""
        at, node, child = decisions
        part = np.empty(len(at))
        for a in range(0, len(at), PIECE):
            b = slice(a, a + PIECE)
            part[b] = chosen(self.third, self.node_rows(f[:, at[b]], node[b]), child[b])
        return np.bincount(at, part, f.shape[1])


def logits(weights: np.ndarray, rows: np.ndarray) -> np.ndarray:
    z = weights.take(rows[0], axis=0)
    for row in rows[1:]:
        z += weights.take(row, axis=0)
    if max(z.max(), -z.min()) > FLAT:
        z -= np.ascontiguousarray(z.T).max(0)[:, None]  # a maximum along a short axis is slow
    return z


def chosen(weights: np.ndarray, rows: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Natural log of the softmax of these rows at the targets."""
    z = logits(weights, rows)
    out = z[np.arange(len(target)), target]
    return out - np.log(np.exp(z, out=z) @ np.ones(z.shape[1], z.dtype))


def summed(row: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the distinct values of row, the sum of p's rows at each)."""
    low = row.min()
    place = row - low
    most = int(place.max())
    if most < 64:
        of_key = np.zeros((len(p), most + 1), np.float32)
        of_key[np.arange(len(p)), place] = 1
        keys = np.flatnonzero(np.bincount(place))
        return keys + low, (of_key.T @ p)[keys]
    order = np.argsort(place.astype(np.uint16) if most < 1 << 16 else place, kind="stable")  # of 16 bits: by radix
    place = place[order]
    start = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    many = np.diff(start, append=len(row))
    capped = np.minimum(many, RANKS + 1).astype(np.uint8)
    by = np.argsort(RANKS + 1 - capped, kind="stable")  # the keys with most rows first, so those that have one more stand first
    keys, start, many = place[start[by]] + low, start[by], many[by]
    more = len(by) - np.cumsum(np.bincount(capped, minlength=RANKS + 2))  # keys of more than so many rows
    g = p.take(order[start], axis=0)
    for r in range(1, RANKS):
        if not (k := int(more[r])):
            return keys, g
        g[:k] += p.take(order[start[:k] + r], axis=0)
    if k := int(more[RANKS]):
        left = many[:k] - RANKS
        ends = np.cumsum(left)
        at = np.arange(ends[-1]) + np.repeat(start[:k] + RANKS - ends + left, left)
        g[:k] += np.add.reduceat(p.take(order[at], axis=0), ends - left, axis=0)
    return keys, g


def step(weights: np.ndarray, squares: np.ndarray, rows: np.ndarray, target: np.ndarray) -> None:
    """One gradient step of a softmax over these positions, in place: AdaGrad with one sum of squares for each row."""
    p = np.empty((len(target), weights.shape[1]), np.float32)
    for a in range(0, len(target), PIECE):
        z = logits(weights, rows[:, a : a + PIECE])
        np.exp(z, out=z)
        np.einsum("ij,i->ij", z, 1 / (z @ np.ones(z.shape[1], z.dtype)), out=p[a : a + PIECE])
    p.reshape(-1)[np.arange(0, p.size, p.shape[1]) + target] -= 1
    for row in rows:
        keys, g = summed(row, p)
        square = squares.take(keys) + np.einsum("ij,ij->i", g, g) / g.shape[1]
        squares[keys] = square
        weights[keys] = weights.take(keys, axis=0) - np.einsum("ij,i->ij", g, STEP / np.sqrt(square))


def learn(model: Model, squares: tuple[np.ndarray, np.ndarray], f: np.ndarray, of: np.ndarray) -> None:
    for a in range(0, len(of), BATCH):
        g = of[a : a + BATCH] // MEMBERS
        m = of[a : a + BATCH] - g * MEMBERS
        first, second = model.rows(f[:, a : a + BATCH], g)
        step(model.first, squares[0], first, g)
        step(model.second, squares[1], second, m)


def learn_below(model: Model, squares: np.ndarray, f: np.ndarray, decisions: tuple[np.ndarray, np.ndarray, np.ndarray]) -> None:
    at, node, child = decisions
    order = np.argsort(at, kind="stable")
    for a in range(0, len(at), NODE_BATCH):
        b = order[a : a + NODE_BATCH]
        step(model.third, squares, model.node_rows(f[:, at[b]], node[b]), child[b])


def positions(k: int, n: int) -> np.ndarray:
    """The positions of n that round k trains on."""
    return np.arange(k, n, ROUNDS)


def train(docs: DataFrame, classes: Classes) -> Model:
    """The model after ROUNDS of distributed updates: tasks step from the same weights, and their moves are averaged.

    A row's moves are summed by row, so what meets in one task never grows with a feature's use.
    """
    model = Model(classes)
    names = [f"w{k}" for k in range(max(CLASSES, MEMBERS, WAYS))]
    shifts = np.cumsum([0, *map(len, model.tables())])
    for k in range(ROUNDS):

        def run(batches, k=k, old=model):
            new, squares = old.copy(), tuple(np.ones(len(x), np.float32) for x in old.tables())
            for batch in batches:
                for words, starts in blocks(batch.column(0)):
                    symbols, of, _ = classes.coded(words)
                    own = positions(k, len(symbols))
                    f = features(symbols, starts)[:, own]
                    learn(new, squares, f, of[own])
                    learn_below(new, squares[2], f, classes.decisions(symbols[own], of[own]))
                del batch
            for now, was, shift in zip(new.tables(), old.tables(), shifts.tolist()):
                moved = np.flatnonzero((now != was).any(1))
                delta = np.zeros((len(moved), len(names)), np.float32)
                delta[:, : now.shape[1]] = now[moved] - was[moved]
                yield pa.RecordBatch.from_arrays([pa.array(moved + shift), *[pa.array(np.ascontiguousarray(delta[:, i])) for i in range(len(names))]], names=["f", *names])
            del new, squares
            release()

        moves = docs.select("text").mapInArrow(run, "f long, " + ", ".join(f"{x} float" for x in names)).groupBy("f").agg(*[F.avg(x).cast("float").alias(x) for x in names]).toArrow()  # a row for each row of the tables
        model = model.copy()
        if moves.num_rows:
            at, delta = moves["f"].to_numpy(), np.stack([moves[x].to_numpy() for x in names], 1)
            for weights, lo, hi in zip(model.tables(), shifts[:-1], shifts[1:]):
                own = (at >= lo) & (at < hi)
                weights[at[own] - lo] += delta[own, : weights.shape[1]]
    return model


def score(docs: DataFrame, held_out: Column) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every whole text.

    Tokens: A-Z lower-cased words between ASCII white space, then one end. The model gives a token's class
    by a softmax over hashed features of the two tokens before it (each, and both), its member in the class by
    a second softmax over such features. Where a member is several tokens, a tree leads to each of them by
    further softmaxes of the same kind. In the rest of a class it leads to a leaf that tokens are hashed to;
    those that meet in a leaf share it by their counts. The rest keeps a Good-Turing share for unknown tokens,
    who are one event in each class, so all events sum to 1. Counts, company, classes and weights come from all documents not held out. Null text is
    empty: just the end. Without training documents c and N are 0 and the classes are equal. Repeated rows give
    a row each, as their tokens are summed by a row key, not by doc_id. Other columns are left out.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(held_out, F.lit(False)).alias("held_out"))
    learned = docs.where(~F.col("held_out"))
    vocabulary = checkpoint(count_tokens(learned))
    total = vocabulary.agg(F.count("*").alias("v"), F.coalesce(F.sum("c"), F.lit(0)).alias("n")).first()
    v, n = total["v"], total["n"]
    top = commonest(vocabulary)
    classes = Classes(top, company(learned, [w for w, _ in top]))
    frequent = len(top)
    known = spark.createDataFrame([(w.decode(),) for w, _ in top] or [("\0",)], "token string")

    def of_leaf(batches):
        for batch in batches:
            words = batch.column(0).cast(pa.binary()).to_pylist()
            leaf = classes.groups(words) * LEAVES + classes.leaf(FREQUENT + np.fromiter(map(crc32, words), np.int64, len(words)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf.astype(np.int32))], names=["token", "c", "leaf"])

    rest = checkpoint(vocabulary.join(F.broadcast(known), "token", "left_anti").mapInArrow(of_leaf, "token string, c long, leaf int"))  # known: FREQUENT rows at most
    leaves = rest.groupBy("leaf").agg(F.sum("c").alias("size"), F.count_if(F.col("c") == 1).alias("h"))  # CLASSES * LEAVES rows at most
    size, once = np.zeros(CLASSES), np.zeros(CLASSES)
    found = leaves.toArrow()
    if found.num_rows:
        leaf, c, h = (found[x].to_numpy() for x in ("leaf", "size", "h"))
        classes.rest[leaf] = c
        size, once = (np.bincount(leaf // LEAVES, x, CLASSES) for x in (c, h))
    classes.size.reshape(CLASSES, MEMBERS)[:, REST] = size
    unknown = np.where(size > 0, (once + 0.5) / (size + 1), 1.0)
    model = train(learned, classes)
    mass = n + 0.1 * (v + 1)
    base = np.log10((classes.count + 0.1) / mass)
    known_bits = np.log10(np.maximum(1 - unknown, 1e-12))
    more = commonest(vocabulary, max(NEAR, len(top)))[len(top) :]  # the next in the order of top
    near = {w: i for i, (w, _) in enumerate(more)}
    near_count = np.array([c for _, c in more], np.int64)
    near_leaf = classes.groups(near) * LEAVES + classes.leaf(FREQUENT + np.fromiter(map(crc32, near), np.int64, len(near)))
    near_base, near_bits = np.log10((near_count + 0.1) / mass), np.log10(near_count / classes.rest[near_leaf]) + known_bits[near_leaf // LEAVES]

    def run(batches):
        """The rows of texts, with their sums over the tokens that are frequent or near, and of the other tokens: one for each that a text has.

        A text's row has held_out, and in place of a token a key of its own, so that these rows spread: no token has a line end.
        n, m, base, score: tokens, known ones and both sums of a text; of a token: times, class, nothing and the sum below its member.
        """
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            at = 0
            for words, starts in blocks(batch.column(1)):
                symbols, of, rare = classes.coded(words)
                common = np.ones(len(words), bool)
                common[rare] = False
                f = features(symbols, starts)
                part = model.log_probability(f, of) / np.log(10)
                below = model.log_below(f, classes.decisions(symbols, of)) / np.log(10)
                plain = np.zeros(len(words))
                plain[common], part[common] = base[symbols[common]], part[common] + below[common]
                at_near = np.fromiter(map(near.get, map(words.__getitem__, rare.tolist()), repeat(-1)), np.int64, len(rare))
                told_here, at_near, rare = rare[at_near >= 0], at_near[at_near >= 0], rare[at_near < 0]
                common[told_here] = True
                plain[told_here], part[told_here] = near_base[at_near], part[told_here] + below[told_here] + near_bits[at_near]
                part, plain, known = (np.add.reduceat(x.astype(np.float64), starts) for x in (part, plain, common))
                ends = np.append(starts[1:], len(words))
                cuts = np.searchsorted(rare, np.append(starts, len(words)))
                token, times, under = [words[i] for i in rare.tolist()], [1] * len(rare), below[rare].tolist()
                for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                    if len(set(token[lo:hi])) < hi - lo:
                        first: dict[bytes, int] = {}
                        for i in range(lo, hi):
                            j = first.setdefault(token[i], i)
                            if i != j:
                                times[i] = 0
                                times[j] += 1
                                under[j] += under[i]
                own = np.flatnonzero(times)
                rows = np.arange(row, row + len(starts))
                text = slice(at, at + len(starts))
                row, at = row + len(starts), at + len(starts)
                both = lambda x, y: pa.array(np.concatenate([x, np.array(y, x.dtype)[own]]))
                yield pa.RecordBatch.from_arrays(
                    [
                        both(rows, np.repeat(rows, np.diff(cuts))), pa.array([*(b"\n%d" % i for i in rows.tolist()), *(token[i] for i in own.tolist())], pa.binary()).cast(pa.string()),
                        *(pa.concat_arrays([batch.column(i)[text], pa.nulls(len(own), batch.column(i).type)]) for i in (0, 2)),
                        both(ends - starts, times), both(known.astype(np.int64), of[rare] // MEMBERS), both(plain, np.zeros(len(rare))), both(part, under),
                    ],
                    names=["row", "token", "doc_id", "held_out", "n", "m", "base", "score"],
                )
            del batch
        release()

    parts = docs.mapInArrow(run, "row long, token string, doc_id long, held_out boolean, n long, m long, base double, score double")
    unknown_bits = F.array(*map(F.lit, np.log10(unknown).tolist()))
    in_leaf = F.log10(F.col("c") / F.col("size")) + F.get(F.array(*map(F.lit, known_bits.tolist())), F.floor(F.col("leaf") / LEAVES).cast("int"))
    told = rest.join(F.broadcast(leaves), "leaf").select("token", F.log10((F.col("c") + 0.1) / F.lit(mass)).alias("plain"), in_leaf.alias("in_leaf"))
    text, told_of = F.col("held_out").isNotNull(), F.col("plain").isNotNull()
    scored = parts.join(told, "token", "left").select(
        "row", "doc_id", "held_out", F.when(text, F.col("n")).alias("n_tokens"),
        F.when(text, F.col("m")).when(told_of, F.col("n")).otherwise(0).alias("n_known"),
        F.when(text, F.col("base")).otherwise(F.col("n") * F.coalesce("plain", F.lit(float(np.log10(0.1 / mass))))).alias("base"),
        F.when(text, F.col("score")).when(told_of, F.col("n") * F.col("in_leaf") + F.col("score")).otherwise(F.col("n") * F.get(unknown_bits, F.col("m").cast("int"))).alias("score"),
    )
    return scored.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.max("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"), F.sum("base").alias("base_score"), F.sum("score").alias("score"),
    ).drop("row")
