"""Benchmark decontamination: CGK embedding, bit-sampling LSH, exact edit verification."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import bound_batches, chunks, release, utf8

#: Walks, and the steps of a walk that an item's key takes, by the item's letters from so many on: short items have fewer
#: words to begin a key at. Fitted to find RECALL of the windows with MOST_EDITS random edits of letters.
REPEATS, RECALL = 4, 0.95
STEPS_FROM = ((0, 13), (120, 15), (180, 17), (260, 18))
STEPS = STEPS_FROM[-1][1]
#: A window is a hit if its edit distance is at most this share of the item.
MOST_EDITS = 0.2
#: So many items go through the documents at once.
ITEM_BLOCK = 20_000
BLOCK_BYTES, SEED, TABLE = 4_000_000, 20_240_501, 1 << 20
#: From so many words of an item on, keys from so many different words must suggest about the same place.
AGREE_FROM = ((0, 1), (10, 2), (18, 3))
#: Windows that one task's arrays hold, and so many of them embedded at once, begins of an item's windows that are verified as one, letters of a gram of the count filter.
WINDOWS, CACHED, NEAR, GRAM = 1 << 20, 1 << 16, 16, 3
#: Items of fewer letters than this have no keys: they count where they stand letter by letter, as whole words.
SHORT = 24
#: Words of 64 bits in the bit vectors that are stepped at once.
LANES = 1 << 13
#: Of the letters that a text is folded to: a-z as 1 to 26, digits, all bytes of other letters as they are.
FOLD = np.zeros(256, np.uint8)
FOLD[[*range(97, 123)]] = FOLD[[*range(65, 91)]] = np.arange(97, 123)
FOLD[[*range(48, 58)]] = np.arange(48, 58)
FOLD[128:] = np.arange(128, 256)


def fold(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased letters and digits with one space between words, and the rows' new offsets."""
    f = FOLD[data]
    word = f > 0
    first = np.zeros(len(f), bool)
    first[offsets[:-1][offsets[:-1] < len(f)]] = True
    before = np.concatenate([[False], word[:-1]])
    gap = ~word & (before & ~first)  # the first byte after a word stands for the whole gap
    keep = word | gap
    at = np.concatenate([[0], np.cumsum(keep)])
    f[gap] = 32
    return f[keep], at[offsets]


class Walks:
    """The CGK walks: at step j a window shows its letter and moves on if a random bit of (j, letter) says so."""

    def __init__(self):
        rng = np.random.default_rng(SEED)
        self.move = rng.integers(0, 2, (REPEATS, STEPS, 256), dtype=np.uint8)
        self.value = rng.integers(0, 1 << 63, (REPEATS, STEPS, 256), dtype=np.uint64) | np.uint64(1)

    def keys(self, data: np.ndarray, starts: np.ndarray, repeat: int) -> list[np.ndarray]:
        """For each number of steps in STEPS_FROM a hash of the letters shown to the windows from these starts on."""
        padded = np.concatenate([data, np.full(STEPS + 1, 32, np.uint8)])
        at = starts.astype(np.int32)
        key, out = np.zeros(len(at), np.uint64), []
        ends = {n for _, n in STEPS_FROM}
        for j in range(STEPS):
            letter = padded[at]
            key += self.value[repeat, j][letter]
            at += self.move[repeat, j][letter]
            if j + 1 in ends:
                out.append(key ^ (key >> np.uint64(29)))
        return out


def grams(data: np.ndarray) -> np.ndarray:
    """A hash of 16 bits of the GRAM letters from each place on."""
    padded = np.concatenate([data, np.full(GRAM, 32, np.uint8)]).astype(np.uint32)
    h = np.zeros(len(data), np.uint32)
    for k in range(GRAM):
        h = h * np.uint32(0x9E3779B1) + padded[k : k + len(data)]
    return ((h * np.uint32(0x85EBCA6B)) >> np.uint32(16)).astype(np.uint16)


def word_starts(data: np.ndarray, offsets: np.ndarray, lo: int) -> np.ndarray:
    """Where words begin, and where letters of three or more bytes do, as scripts that have these may be written without spaces."""
    inside = data != 32
    start = inside & np.concatenate([[True], ~inside[:-1]])
    start |= data >= 0xE0
    begins = offsets[:-1] - lo
    start[begins[begins < len(data)]] = True
    return np.flatnonzero(start & inside)


def edit_distance(a: bytes, b: bytes, most: int) -> tuple[int, int]:
    """(distance, end): of a and its best prefix of b that ends at ``end``; exact by Myers' bit vectors.

    Over ``most``, the distance may be any number over it. Equal distances: the shortest prefix.
    """
    m = len(a)
    if b[:m] == a:
        return 0, m
    peq: dict[int, int] = defaultdict(int)
    for i, c in enumerate(a):
        peq[c] |= 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    best, end = m, 0
    for j, c in enumerate(b):
        eq = peq[c] if c in peq else 0
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv) & full, pv & xh
        score += 1 if ph & top else -1 if mh & top else 0
        ph, mh = (ph << 1 | 1) & full, mh << 1 & full
        pv, mv = mh | ~(xv | ph) & full, ph & xv
        if score < best:
            best, end = score, j + 1
        if j >= m + most:
            break
    return best, end


class Items:
    """Keys of every item from each of its words on, so that edits near an item's start don't hide the rest."""

    def __init__(self, rows: list[tuple[int, str]]):
        self.walks = Walks()
        texts = [t.encode() for _, t in rows]
        offsets = np.cumsum([0, *map(len, texts)])
        data, offsets = fold(np.frombuffer(b"".join(texts), np.uint8).copy(), offsets)
        self.ids = [i for i, _ in rows]
        self.text = [data[a:b].tobytes().rstrip(b" ") for a, b in zip(offsets[:-1], offsets[1:])]
        starts = word_starts(data, offsets, 0)
        item = np.searchsorted(offsets, starts, "right") - 1
        length = np.array([len(t) for t in self.text])
        left = length[item] - (starts - offsets[item])
        steps = [n for _, n in STEPS_FROM]
        kind = np.searchsorted([a for a, _ in STEPS_FROM], length, "right") - 1
        self.grams = [np.unique(grams(np.frombuffer(t, np.uint8))[: max(0, len(t) - GRAM + 1)], return_counts=True) for t in self.text]
        self.gap = int(length.max(initial=0)) // NEAR + 3
        words = np.bincount(item, minlength=len(rows))
        self.need = np.array([n for _, n in AGREE_FROM])[np.searchsorted([a for a, _ in AGREE_FROM], words, "right") - 1]
        #: by walk and kind: the sorted keys, where each one's entries begin, and the entries' items and places
        self.found: list[list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]] = []
        self.there = np.zeros((REPEATS, len(steps), TABLE), bool)
        for r in range(REPEATS):
            self.found.append([])
            for c, all_keys in enumerate(self.walks.keys(data, starts, r)):
                # a key looks at about half as many letters as steps; where less is left, only an item's own start counts
                own = np.flatnonzero((kind[item] == c) & (length[item] >= SHORT) & ((left >= steps[c] // 2 + 4) | (starts == offsets[item])))
                own = own[np.argsort(all_keys[own], kind="stable")]
                keys, first = np.unique(all_keys[own], return_index=True)
                self.found[r].append((keys, np.append(first, len(own)), item[own], (starts - offsets[item])[own]))
                self.there[r, c, (keys & np.uint64(TABLE - 1)).astype(np.int64)] = True

        self.short: dict[bytes, list[int]] = defaultdict(list)
        for i, t in enumerate(self.text):
            if 0 < len(t) < SHORT:
                self.short[t].append(i)

    def whole(self, part: np.ndarray, starts: np.ndarray, at: np.ndarray) -> list[tuple[int, int, int]]:
        """(row, item, begin) of the short items that stand word for word at these starts."""
        out, sizes = [], sorted({*map(len, self.short)})
        if not sizes:
            return out
        padded = np.concatenate([part, np.full(SHORT + 1, 32, np.uint8)])
        mix = lambda h, letter: (h ^ letter.astype(np.uint64)) * np.uint64(0x100000001B3)
        h = np.full(len(starts), 0xCBF29CE484222325, np.uint64)
        row = np.searchsorted(at, starts, "right") - 1
        for n in range(1, sizes[-1] + 1):
            h = mix(h, padded[starts + n - 1])
            if n not in sizes:
                continue
            wanted = [t for t in self.short if len(t) == n]
            codes = np.full(len(wanted), 0xCBF29CE484222325, np.uint64)
            for k in range(n):
                codes = mix(codes, np.array([t[k] for t in wanted]))
            ends = starts + n
            free = (ends >= at[row + 1]) | (padded[ends] == 32) | (padded[ends] >= 0xE0)
            for k in np.flatnonzero(np.isin(h, codes) & free & (ends <= at[row + 1])).tolist():
                for i in self.short.get(part[starts[k] : ends[k]].tobytes(), ()):
                    out.append((int(row[k]), i, int(starts[k])))
        return out

    def candidates(self, part: np.ndarray, some: np.ndarray) -> np.ndarray:
        """Rows of items, keys' starts and windows' begins that the keys from these starts on suggest."""
        out = [np.zeros((3, 0), np.int64)]
        for r in range(REPEATS):
            for c, keys in enumerate(self.walks.keys(part[some[0] : some[-1] + STEPS + 1], some - some[0], r)):
                known, first, item, inside = self.found[r][c]
                if not len(known):
                    continue
                maybe = np.flatnonzero(self.there[r, c, (keys & np.uint64(TABLE - 1)).astype(np.int64)])
                at = np.minimum(np.searchsorted(known, keys[maybe]), len(known) - 1)
                met = known[at] == keys[maybe]
                at, maybe = at[met], maybe[met]
                many = first[at + 1] - first[at]
                entry = np.repeat(first[at] - np.concatenate([[0], np.cumsum(many)[:-1]]).astype(np.int64), many) + np.arange(many.sum()) if len(at) else np.zeros(0, np.int64)
                start = np.repeat(some[maybe], many)
                out.append(np.stack([item[entry], start, start - inside[entry]]))
        return np.concatenate(out, axis=1)

    def agreeing(self, item: np.ndarray, start: np.ndarray, begin: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Rows of items, rows and begins // NEAR of the places that enough keys suggest, each once."""
        if not len(item):
            return np.zeros((3, 0), np.int64)
        # one number for each (item, row, begin // NEAR): rows are kept apart by more than an item reaches before its row
        place = begin // NEAR + self.gap * (np.searchsorted(at, start, "right") - 1)
        low, shift = int(place.min()), int(at[-1]).bit_length()
        wide = int(place.max()) - low + 3
        both = np.sort((item * wide + place - low) << shift | start)
        both = both[np.concatenate([[True], np.diff(both) != 0])]
        codes, first, many = np.unique(both >> shift, return_index=True, return_counts=True)
        beside = np.zeros(len(codes), np.int64)
        touching = np.flatnonzero(np.diff(codes) == 1)
        beside[touching] = many[touching + 1]
        item = codes // wide
        met = many + beside >= self.need[item]
        row = np.searchsorted(at, both[first[met]] & ((1 << shift) - 1), "right") - 1
        return np.stack([item[met], row, codes[met] % wide + low - self.gap * row])

    def hits(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(row, item, start, distance): for each row and item the best window within MOST_EDITS."""
        best: dict[tuple[int, int], tuple[int, int]] = {}
        number = np.zeros(1 << 16, np.int64)  # of the item's grams, from 1
        for lo, hi in chunks(offsets, BLOCK_BYTES):
            part, at = fold(data[offsets[lo] : offsets[hi]].copy(), offsets[lo : hi + 1] - offsets[lo])
            starts, gram = word_starts(part, at, 0), grams(part)

            def note(row, i, d, start, lo=lo):
                best[row + lo, i] = min(best.get((row + lo, i), (1 << 30, 0)), (d, start))

            for row, i, begin in self.whole(part, starts, at):
                note(row, i, 0, begin - int(at[row]))
            for a in range(0, len(starts), WINDOWS):
                some = starts[a : a + WINDOWS]
                item, start, begin = np.concatenate([self.candidates(part, some[b : b + CACHED]) for b in range(0, len(some), CACHED)], axis=1)
                new = self.agreeing(item, start, begin, at)
                firsts = np.searchsorted(new[0], np.arange(len(self.ids) + 1))
                left = []
                for i in np.flatnonzero(np.diff(firsts)).tolist():
                    text = self.text[i]
                    most = int(MOST_EDITS * len(text))
                    rows, near = new[1, firsts[i] : firsts[i + 1]], new[2, firsts[i] : firsts[i + 1]] * NEAR
                    # an edit spoils GRAM grams of the item at most: with fewer left in all the place, no window is a hit
                    known, counts = self.grams[i]
                    number[known] = np.arange(1, len(known) + 1)
                    least = len(text) - GRAM + 1 - GRAM * most
                    for b in range(0, len(near), 1024):
                        places = near[b : b + 1024, None] + np.arange(-most, len(text) + most + 2 * NEAR)
                        of = number[gram[np.clip(places, 0, len(gram) - 1)]] + np.arange(len(places))[:, None] * (len(known) + 1)
                        seen = np.bincount(of.ravel(), minlength=len(places) * (len(known) + 1)).reshape(len(places), -1)[:, 1:]
                        enough = np.flatnonzero(np.minimum(seen, counts).sum(1) >= least) + b
                        left.append(np.stack([np.full(len(enough), i), rows[enough], np.maximum(at[rows[enough]], near[enough] - most), np.minimum(at[rows[enough] + 1], near[enough] + 2 * NEAR + len(text) + most)]))
                    number[known] = 0
                if left:
                    for i, row, begin, end in self.verified(part, np.concatenate(left, axis=1)):
                        # the window's end is found from any start; its start by the item reversed
                        text = self.text[i]
                        d, size = edit_distance(text[::-1], part[begin:end].tobytes()[::-1], int(MOST_EDITS * len(text)))
                        note(row, i, d, end - size - int(at[row]))
        return [(row, item, start, d) for (row, item), (d, start) in sorted(best.items())]

    def verified(self, part: np.ndarray, places: np.ndarray):
        """(item, row, begin, end) of those places (item, row, begin, end) that hold a window within MOST_EDITS, with the best one's end."""
        item, row, begin, end = places
        size = np.array([len(t) for t in self.text])[item]
        words = -(-size // 64)
        order = np.lexsort((end - begin, words))
        first = 0
        while first < len(order):
            w = int(words[order[first]])
            lanes = order[first : first + max(1, LANES // w)]
            lanes = lanes[words[lanes] == w]
            first += len(lanes)
            of, inverse = np.unique(item[lanes], return_inverse=True)
            d, stop = anywhere([self.text[i] for i in of.tolist()], inverse, part, begin[lanes], end[lanes])
            for k in np.flatnonzero(d <= (MOST_EDITS * size[lanes]).astype(np.int64)).tolist():
                p = lanes[k]
                yield int(item[p]), int(row[p]), int(begin[p]), int(begin[p] + stop[k])


def anywhere(texts: list[bytes], which: np.ndarray, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distance, end): of each lane's text (texts[which]) to its best substring of data[begin:end]; equal distances: the first end.

    Exact, by Myers' bit vectors, all lanes a letter further at each step. The texts take the same number of words of 64 bits.
    """
    lanes, one, top = len(which), np.uint64(1), np.uint64(63)
    words = -(-len(texts[0]) // 64)
    equal = np.zeros((len(texts), 256, words), np.uint64)
    for i, t in enumerate(texts):
        letters, at = np.frombuffer(t, np.uint8), np.arange(len(t))
        np.bitwise_or.at(equal, (i, letters, at >> 6), one << (at & 63).astype(np.uint64))
    equal = equal.reshape(len(texts) * 256, words)
    size = np.array([len(t) for t in texts])[which]
    last = ((size - 1) & 63).astype(np.uint64)
    pv, mv = np.full((words, lanes), ~np.uint64(0)), np.zeros((words, lanes), np.uint64)
    score, best, stop = size.copy(), size.copy(), np.zeros(lanes, np.int64)
    wide = end - begin
    base = which * 256
    for j in range(int(wide.max(initial=0))):
        letter = data[np.minimum(begin + j, len(data) - 1)]
        eqs = equal[base + letter]
        up = down = np.zeros(lanes, np.uint64)  # whether the row above grows or shrinks by one: not above the first
        for b in range(words):
            eq, p, m = eqs[:, b], pv[b], mv[b]
            xv = eq | m
            eq = eq | down
            xh = (((eq & p) + p) ^ p) | eq
            ph, mh = m | ~(xh | p), p & xh
            bit = top if b < words - 1 else last
            new_up, new_down = (ph >> bit) & one, (mh >> bit) & one
            ph, mh = (ph << one) | up, (mh << one) | down
            pv[b], mv[b] = mh | ~(xv | ph), ph & xv
            up, down = new_up, new_down
        score = score + up.astype(np.int64) - down.astype(np.int64)
        better = (score < best) & (j < wide)
        best[better], stop[better] = score[better], j + 1
    return best, stop


def find_leaks(docs: DataFrame, items: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` with item_id, start, distance: each benchmark item that a document holds, whole or nearly.

    Both texts are folded to lower-case letters and digits with single spaces. A window of the item's size
    counts if its edit distance is at most a fifth of the item's length. Windows from every word of a
    document are embedded by the CGK walk; its steps make an LSH key that is looked up among the keys of
    the items from each of their words on. Where enough keys agree on a place, and a count of common grams
    (which loses no hit) allows one, it is verified exactly. Keys aim at RECALL of windows with a fifth of
    random edits; windows with fewer edits are found more often, exact ones always. start is the window's place in the
    folded text. The items are a stated query set: they are read to the driver and sent out in blocks of
    ITEM_BLOCK, so a broadcast's size is bounded. Items of fewer than SHORT letters have too few for keys: they
    count where they stand letter by letter, as whole words. Items without letters or digits, null ones, and
    null or empty documents give no rows. An item twice under one id counts once, at its best window.
    Repeated documents give a row each.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    wanted = items.where(F.col("text").isNotNull() & F.col("item_id").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text")
    n = wanted.count()
    blocks = max(1, -(-n // ITEM_BLOCK))
    rows = docs.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], "text")
    names = [f"k{i}" for i in range(len(keep))] + ["item_id", "start", "distance"]
    schema = ", ".join([f"{n} {f.dataType.simpleString()}" for n, f in zip(names, rows.schema[: len(keep)])] + ["item_id long, start int, distance int"])
    out = None
    for b in range(blocks):
        mine = wanted.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b) if blocks > 1 else wanted
        texts = [(r["item_id"], r["text"]) for r in mine.toLocalIterator()]
        if not texts:
            continue

        def run(batches, texts=texts):
            known = Items(texts)
            for batch in batches:
                hits = known.hits(*utf8(batch.column(len(keep))))
                row, item, start, d = zip(*hits) if hits else ((), (), (), ())
                at = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays([*[batch.column(i).take(at) for i in range(len(keep))], pa.array([known.ids[i] for i in item], pa.int64()), pa.array(start, pa.int32()), pa.array(d, pa.int32())], names=names)
                del batch
            del known
            release()

        found = rows.mapInArrow(run, schema)
        out = found if out is None else out.union(found)
    if out is None:
        return spark.createDataFrame([], schema).toDF(*keep, *names[len(keep) :])
    return out.toDF(*keep, *names[len(keep) :])
