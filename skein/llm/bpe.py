"""Byte-level BPE: encoding by a fold of ranked merges in Spark, decoding by concatenated pieces."""

from __future__ import annotations

import base64
import hashlib
import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.classic.column import Column as ClassicColumn

from skein.llm.common import bound_batches, chunks, release

#: Words that are folded once and remembered: the commonest of a sample of so many documents' words.
MEMORY_WORDS, SAMPLE_DOCS = 300_000, 60_000
#: No merge; above every rank.
NONE = 1 << 17
#: A piece is its pair's rank, its first byte's place and its id in one number; bits of the id, and of place and id.
ID_BITS, LOW_BITS = 17, 45
IDS, LOWS = (1 << ID_BITS) - 1, (1 << LOW_BITS) - 1
PLACES = LOWS - IDS
#: Words that are looked up together, of whole texts; one text at least.
WORDS_AT_ONCE = 400_000
#: Words of more bytes than this are merged with a heap: a fold copies its array at every merge, so its time is a square.
LONG_WORD = 512
#: Stands for a word to be folded among a document's ids.
GAP = 0xFFFFFFFF


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def java_pattern(pattern: str) -> str:
    """The pattern for Java, whose plain white-space class is ASCII only."""
    return pattern.replace(r"[^\s", r"[^\p{IsWhite_Space}").replace(r"\s", r"\p{IsWhite_Space}").replace(r"\S", r"\P{IsWhite_Space}")


def bind(value: Column, zero: Column, f) -> Column:
    """f(zero, value) with the value computed once. An item taken from an array would derive its type at each call."""
    return F.aggregate(F.array(value), zero, f)


def long_array(values: list[int]) -> Column:
    """A literal array in Spark's packed form: eight bytes a value, and a plan shows its name, not its values."""
    jvm = SparkContext._active_spark_context._jvm
    packed = SparkContext._active_spark_context._gateway.new_array(jvm.long, len(values))
    jvm.java.nio.ByteBuffer.wrap(np.array(values, ">i8").tobytes()).asLongBuffer().get(packed)
    data = jvm.org.apache.spark.sql.catalyst.expressions.UnsafeArrayData.fromPrimitiveArray(packed)
    kind = jvm.org.apache.spark.sql.types.DataType.fromDDL("array<bigint>")
    return ClassicColumn(jvm.org.apache.spark.sql.classic.ExpressionUtils.column(jvm.org.apache.spark.sql.catalyst.expressions.Literal(data, kind)))


def pair_table(ranks: dict[bytes, int]) -> tuple[list[int], list[int]]:
    """(shift, table): the rank of every pair of tokens (a, b) whose bytes join to a token.

    Pair (a, b) sits at table[shift[a] ^ b] as a * 2^17 + its rank; shifts are chosen so that no two pairs
    meet. A place that is free, or holds another a's pair, differs from a * 2^17 above the 17th bit.
    """
    pairs: dict[int, list[tuple[int, int]]] = {}
    for piece, rank in ranks.items():
        for cut in range(1, len(piece)):
            a, b = ranks.get(piece[:cut]), ranks.get(piece[cut:])
            if a is not None and b is not None:
                pairs.setdefault(a, []).append((b, rank))
    bits = max(17, (4 * sum(map(len, pairs.values()))).bit_length())
    shift = np.zeros(max(ranks.values()) + 1, np.int64)
    table = np.full(1 << bits, IDS << 17, np.int64)
    taken = np.zeros(1 << bits, bool)
    rng = np.random.default_rng(1)
    for a in sorted(pairs, key=lambda a: (-len(pairs[a]), a)):
        b, rank = np.array(pairs[a], np.int64).T
        tries = 0
        while taken[b ^ shift[a]].any():
            shift[a] = rng.integers(0, 1 << bits)
            tries += 1
            if tries > 1_000_000:
                raise ValueError("no room for the pairs of this vocabulary")
        taken[b ^ shift[a]] = True
        table[b ^ shift[a]] = a << 17 | rank
    return shift.tolist(), table.tolist()


class Ranks:
    """The literal rank map, and the columns that look things up in it."""

    def __init__(self, ranks: dict[bytes, int]):
        if max(ranks.values(), default=0) >= IDS or any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("ranks must be below 2^17 - 1 and hold every single byte")
        self.pieces = ranks
        self.shift, self.table = map(long_array, pair_table(ranks))
        self.bytes = long_array([ranks[bytes([b])] for b in range(256)])

    def rank(self, a: Column, b: Column) -> Column:
        """The rank of a pair, or NONE; without a next piece (null), NONE as well."""
        entry = F.get(self.table, F.get(self.shift, a).bitwiseXOR(b))
        return F.least(entry.bitwiseXOR(F.shiftleft(a, 17)), long(NONE))

    def fold(self, word: Column) -> Column:
        """array<bigint>: the ids of one word. Its bytes' ids are merged pair by pair, lowest rank first, leftmost first.

        A state is one number for each piece: the rank of its pair with the next piece, its place, its id. The
        least number is the pair to merge, the leftmost of its rank, and its rank is the merged id. (Places are
        found by counting, as array_position leaves by an exception; bits are joined by OR, as sums are checked.)
        """
        raw = F.decode(F.encode(word, "UTF-8"), "ISO-8859-1")  # a letter for each byte
        only = lambda v, bits: v.bitwiseAND(long(bits))
        start = F.transform(F.sequence(F.lit(1), F.length(raw)), lambda i: F.shiftleft(i.cast("long"), ID_BITS).bitwiseOR(F.get(self.bytes, F.ascii(F.substring(raw, i, F.lit(1))))))
        pack = lambda low, a, b: F.shiftleft(self.rank(a, b), LOW_BITS).bitwiseOR(low)

        def step(acc, _):
            return bind(F.array_min(acc), acc, lambda state, least: F.when(least >= NONE << LOW_BITS, state).otherwise(bind(index(state, least), state, lambda state, at: merge(state, least, at))))

        def index(state, least):
            return F.size(F.filter(state, lambda e: only(e, PLACES) < only(least, PLACES)))

        def merge(state, least, at):
            new, left = F.shiftright(least, LOW_BITS), F.get(state, at - 1)
            joined = pack(only(least, PLACES).bitwiseOR(new), new, only(F.get(state, at + 2), IDS))
            before = pack(only(left, LOWS), only(left, IDS), new)
            return F.concat(F.slice(state, F.lit(1), F.greatest(at - 1, F.lit(0))), F.when(at == 0, F.array(joined)).otherwise(F.array(before, joined)), F.slice(state, at + 3, F.size(state)))

        begin = lambda v: F.zip_with(v, F.slice(v, 2, F.size(v)), lambda x, y: pack(x, only(x, IDS), only(y, IDS)))
        none = F.array().cast("array<bigint>")
        return bind(start, none, lambda _, v: F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(v) - 1, F.lit(1))), begin(v), step, lambda acc: F.transform(acc, lambda e: only(e, IDS))))


def long(value: int) -> Column:
    return F.lit(value).cast("long")


def remembered(docs: DataFrame, ranks: Ranks, pattern: str) -> pa.Table:
    """word, ids of at most MEMORY_WORDS distinct words, each folded once. Which words changes no result."""
    n = docs.count()
    rate = int(min(1.0, SAMPLE_DOCS / max(n, 1)) * (1 << 30))
    some = docs.select("text").where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) <= rate)
    words = some.select(F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    top = words.where((F.col("n") > 1) & (F.length("word") <= 64)).orderBy(F.desc("n"), "word").limit(MEMORY_WORDS).select("word")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return top.repartition(parts, "word").select("word", ranks.fold(F.col("word")).alias("ids")).toArrow()


def merged(word: bytes, ranks: dict[bytes, int], longest: int) -> list[int]:
    """The ids of one word by the same rule as the fold: the lowest rank first, the leftmost of equal ones. ``longest``: of the pieces."""
    n = len(word)
    after, before = [*range(1, n + 1)], [*range(-1, n - 1)]  # a piece begins at i and ends at after[i]

    def pair(i: int) -> tuple[int, int, int, int] | None:
        mid = after[i]
        if mid >= n or after[mid] - i > longest:
            return None
        rank = ranks.get(word[i : after[mid]])
        return None if rank is None else (rank, i, mid, after[mid])

    heap = [p for p in map(pair, range(n)) if p]
    heapq.heapify(heap)
    gone = bytearray(n + 1)
    while heap:
        _, i, mid, end = heapq.heappop(heap)
        if gone[i] or after[i] != mid or gone[mid] or after[mid] != end:
            continue
        gone[mid], after[i] = 1, end
        if end < n:
            before[end] = i
        for k in (before[i], i):
            if k >= 0 and (p := pair(k)):
                heapq.heappush(heap, p)
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : after[i]]])
        i = after[i]
    return out


def expand(flat: np.ndarray, offsets: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows ``which`` of a ragged array, end to end, and their sizes."""
    size = np.diff(offsets)[which]
    stops = np.cumsum(size)
    at = np.arange(stops[-1] if len(stops) else 0) - np.repeat(stops - size, size) + np.repeat(offsets[:-1][which], size)
    return flat[at], size


def encode_decode(docs: DataFrame, path: str, pattern: str, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (doc_id), n_tokens, ids_sha256, decoded_sha256 of each whole text.

    Each match of the pattern is folded by itself, as the reference library does without special tokens;
    bytes between matches do not occur with this pattern. Null and empty texts have no ids, and the digests
    of no bytes. ids are digested as little-endian unsigned 32-bit integers; the decoded bytes are the ids'
    pieces joined. One row per input row, repeats included. The session's Arrow batches are bounded by
    BATCH_BYTES from then on, as a plan takes that setting when it runs. Columns of ``keep`` may have any names.
    Words of over LONG_WORD bytes are merged with a heap, so a very long word takes n log n steps.
    """
    keep = keep or ["doc_id"]
    bound_batches(docs.sparkSession)
    docs = docs.select("text", *[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)])
    names, keep = keep, [f"k{i}" for i in range(len(keep))]
    vocabulary = load_ranks(path)
    ranks, java = Ranks(vocabulary), java_pattern(pattern)
    memory = remembered(docs.where(F.col("text").isNotNull()), ranks, java)
    known = memory["word"].combine_chunks()
    ids = memory["ids"].combine_chunks()
    flat, starts = ids.flatten().to_numpy().astype(np.uint32), np.concatenate([[0], np.cumsum(pc.list_value_length(ids).to_numpy())]).astype(np.int64)
    flat, starts = np.append(flat, np.uint32(GAP)), np.append(starts, starts[-1] + 1)  # the last row: a word not known
    del memory, ids
    ordered = sorted(vocabulary, key=vocabulary.get)
    if [vocabulary[p] for p in ordered] != list(range(len(ordered))):
        raise ValueError("ranks have gaps")
    piece_bytes = np.frombuffer(b"".join(ordered), np.uint8)
    piece_at = np.cumsum([0, *map(len, ordered)])
    longest = max(map(len, ordered))

    def look_up(batches):
        for whole in batches:
            yield from coded(whole)
            del whole  # not held while the next one is read
        release()

    def coded(whole):
        """Rows with their known ids, a GAP for each other word, and those words' numbers in the list of the chunk's first row."""
        size = pc.fill_null(pc.list_value_length(whole.column(0)), 0).to_numpy()
        for lo, hi in chunks(np.concatenate([[0], np.cumsum(size)]), WORDS_AT_ONCE):
            batch = whole.slice(lo, hi - lo)
            words = batch.column(0).fill_null([]) if batch.column(0).null_count else batch.column(0)
            flat_words = words.flatten()
            at = pc.fill_null(pc.index_in(flat_words, value_set=known), len(known)).to_numpy().copy()
            own_flat, own_starts = flat, starts
            long_words = np.flatnonzero((at == len(known)) & (pc.binary_length(flat_words).to_numpy() > LONG_WORD))
            if len(long_words):
                more = [np.array(merged(flat_words[w].as_py().encode(), vocabulary, longest), np.uint32) for w in long_words.tolist()]
                at[long_words] = len(starts) - 1 + np.arange(len(more))
                own_flat, own_starts = np.concatenate([flat, *more]), np.concatenate([starts, starts[-1] + np.cumsum([*map(len, more)])])
            missing = at == len(known)
            other = flat_words.filter(pa.array(missing)).dictionary_encode()
            ends = np.concatenate([[0], np.cumsum(size[lo:hi])])
            got, wide = expand(own_flat, own_starts, at)
            cut = np.concatenate([[0], np.cumsum(wide)])[ends]
            lost = np.concatenate([[0], np.cumsum(missing)])[ends]
            raw, which = got.tobytes(), other.indices.to_numpy().astype(np.int32).tobytes()
            lists = np.full(len(batch) + 1, len(other.dictionary), np.int32)
            lists[0] = 0
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i + 1) for i in range(len(keep))], pa.array([raw[4 * a : 4 * b] for a, b in zip(cut[:-1], cut[1:])], pa.binary()), pa.array([which[4 * a : 4 * b] for a, b in zip(lost[:-1], lost[1:])], pa.binary()), pa.ListArray.from_arrays(pa.array(lists), other.dictionary)],
                names=[*keep, "ids", "at", "words"],
            )

    def finish(batches):
        """Rows come in the order in which coded() gave them: the words' ids of a chunk come with its first row."""
        own, own_starts = np.zeros(0, np.uint32), np.zeros(1, np.int64)
        for batch in batches:
            n, first, second = [], [], []
            for raw, at, rest in zip(*batch.columns[:3]):
                if len(rest):
                    own = rest.values.flatten().to_numpy().astype(np.uint32)
                    own_starts = np.concatenate([[0], np.cumsum(pc.list_value_length(rest.values).to_numpy())]).astype(np.int64)
                ids = np.frombuffer(raw.as_py(), np.uint32)
                which = np.frombuffer(at.as_py(), np.int32)
                if len(which):
                    gap = ids == GAP
                    got, wide = expand(own, own_starts, which)
                    size = np.ones(len(ids), np.int64)
                    size[gap] = wide
                    out = np.repeat(ids, size)
                    out[np.repeat(gap, size)] = got
                    ids = out
                n.append(len(ids))
                first.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                digest = hashlib.sha256()
                for a in range(0, len(ids), 1 << 18):
                    digest.update(expand(piece_bytes, piece_at, ids[a : a + (1 << 18)])[0].tobytes())
                second.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([*batch.columns[3:], pa.array(n, pa.int64()), pa.array(first, pa.string()), pa.array(second, pa.string())], names=[*keep, "n_tokens", "ids_sha256", "decoded_sha256"])
            del batch
        release()

    kept = docs.select(*keep).schema
    more = lambda d, **kinds: ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in d] + [f"{k} {v}" for k, v in kinds.items()])
    split = docs.select(F.regexp_extract_all("text", F.lit(java), F.lit(0)).alias("words"), *keep)
    found = split.mapInArrow(look_up, more(kept, ids="binary", at="binary", words="array<string>"))
    folded = found.select("ids", "at", F.transform("words", ranks.fold).alias("rest"), *keep)
    done = folded.mapInArrow(finish, more(kept, n_tokens="long", ids_sha256="string", decoded_sha256="string"))
    return done.toDF(*names, "n_tokens", "ids_sha256", "decoded_sha256")
