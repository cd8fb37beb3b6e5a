"""Language identification by prediction by partial matching (PPM, escape method C)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.common import bound_batches, chunks, release, utf8

ORDER = 4
#: A model learns from so many whole texts of a language at most, of so many bytes together (the first one of any size).
SAMPLE_TEXTS, SAMPLE_BYTES = 300, 2_000_000
#: More labels than this are no column of languages: an error.
MOST_LANGS = 500
BLOCK_BYTES = 500_000


def training_sample(docs: DataFrame, allowed: Column, texts: int = SAMPLE_TEXTS, size: int = SAMPLE_BYTES) -> list:
    """At most ``texts`` (lang, text) rows of each language, whole and of any length, in the order of a hash of doc_id.

    A language's sample ends before the row that would pass ``size`` bytes, but holds one row at least.
    """
    usable = docs.where(allowed & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    counts = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).limit(MOST_LANGS + 1).collect()}
    if len(counts) > MOST_LANGS:
        raise ValueError(f"over {MOST_LANGS} values of lang")
    if not counts:
        return []
    at = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("sample")), F.lit(1 << 30))
    rate = F.lit(0)
    for lang, n in counts.items():
        rate = F.when(F.col("lang") == lang, F.lit(min(1 << 30, int((1 << 30) * 1.3 * texts / n) + 1))).otherwise(rate)
    drawn = usable.withColumn("at", at).where(F.col("at") < rate)
    # the order alone first: texts are fetched only for the rows that count
    wide = Window.partitionBy("lang").orderBy("at", "bytes", F.xxhash64("text")).rowsBetween(Window.unboundedPreceding, 0)
    sizes = drawn.withColumn("bytes", F.octet_length("text")).withColumns({"k": F.count("*").over(wide), "all": F.sum("bytes").over(wide)})
    rows = sizes.where((F.col("k") == 1) | ((F.col("k") <= texts) & (F.col("all") <= size))).select("lang", "k", "text").collect()
    return [(r["lang"], r["text"]) for r in sorted(rows, key=lambda r: (r["lang"], r["k"]))]


def grams(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each byte, itself and the ORDER bytes before it as one number; zeros stand before a text."""
    code = data.astype(np.uint64)
    position = np.arange(len(data)) - np.repeat(starts, np.diff(np.append(starts, len(data))))
    for k in range(1, ORDER + 1):
        before = np.zeros(len(data), np.uint64)
        before[k:] = data[:-k]
        before[position < k] = 0
        code |= before << np.uint64(8 * k)
    return code


class PPM:
    """Frozen byte statistics of each language, as sorted tables of contexts and of symbols in them."""

    def __init__(self, texts: list[tuple[str, str]]):
        self.langs = sorted({lang for lang, _ in texts})
        self.symbol, self.escape = [], []
        codes = {}
        for lang in self.langs:
            own = [t.encode() for g, t in texts if g == lang and t]
            starts = np.cumsum([0, *map(len, own)])[:-1] if own else np.zeros(0, np.int64)
            codes[lang] = grams(np.frombuffer(b"".join(own), np.uint8), starts.astype(np.int64))
        for k in range(ORDER + 1):
            mask = np.uint64((1 << 8 * (k + 1)) - 1)
            per = []
            for lang in self.langs:
                g, c = np.unique(codes[lang] & mask, return_counts=True)
                x, first = np.unique(g >> np.uint64(8), return_index=True)
                total, distinct = np.add.reduceat(c, first) if len(g) else c, np.diff(np.append(first, len(g)))
                per.append((g, c, x, total, distinct))
            seen = np.unique(np.concatenate([p[0] for p in per])) if per else np.zeros(0, np.uint64)
            context = np.unique(np.concatenate([p[2] for p in per])) if per else np.zeros(0, np.uint64)
            bits = np.full((len(seen), len(self.langs)), np.inf, np.float32)
            away = np.zeros((len(context), len(self.langs)), np.float32)
            for i, (g, c, x, total, distinct) in enumerate(per):
                whole = (total + distinct).astype(np.float64)
                bits[np.searchsorted(seen, g), i] = -np.log2(c / whole[np.searchsorted(x, g >> np.uint64(8))])
                away[np.searchsorted(context, x), i] = -np.log2(distinct / whole)
            self.symbol.append((seen, bits))
            self.escape.append((context, away))

    def code_lengths(self, code: np.ndarray) -> np.ndarray:
        """Bits that each language's model takes for each of these (context, byte) numbers."""
        out = np.zeros((len(code), len(self.langs)), np.float32)
        waiting = np.ones_like(out, bool)
        for k in range(ORDER, -1, -1):
            g = code & np.uint64((1 << 8 * (k + 1)) - 1)
            for (keys, values), what in ((self.symbol[k], g), (self.escape[k], g >> np.uint64(8))):
                if not len(keys):
                    continue
                at = np.minimum(np.searchsorted(keys, what), len(keys) - 1)
                there = (keys[at] == what)[:, None]
                if keys is self.symbol[k][0]:
                    bits = values[at]
                    hit = waiting & there & np.isfinite(bits)
                    out[hit] += bits[hit]
                    waiting &= ~hit
                else:
                    out += np.where(waiting & there, values[at], 0)
        return out + 8 * waiting

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Code length in bits of each row under each language's model; empty rows are 0."""
        out = np.zeros((len(offsets) - 1, len(self.langs)))
        for lo, hi in chunks(offsets, BLOCK_BYTES):
            rows = lo + np.flatnonzero(np.diff(offsets[lo : hi + 1]))
            if not len(rows):
                continue
            starts = offsets[rows] - offsets[lo]
            code = grams(data[offsets[lo] : offsets[hi]], starts)
            part = np.zeros((len(rows), len(self.langs)))
            for a in range(0, len(code), 2 * BLOCK_BYTES):  # one very long text is summed in pieces
                piece = code[a : a + 2 * BLOCK_BYTES]
                keys, back = np.unique(piece, return_inverse=True)
                bits = self.code_lengths(keys)
                first = int(np.searchsorted(starts, a, "right")) - 1
                last = int(np.searchsorted(starts, a + len(piece), "left"))
                cut = np.maximum(starts[first:last] - a, 0)
                for i in range(len(self.langs)):
                    part[first:last, i] += np.add.reduceat(bits[:, i].astype(np.float64)[back], cut)
            out[rows] = part
        return out


def identify(docs: DataFrame, texts: list[tuple[str, str]]) -> DataFrame:
    """Adds lang_pred, score and bits_per_byte to the documents.

    Every whole text is coded by each language's PPM model: the longest known context up to ORDER bytes
    gives a byte's probability, and each shorter context costs its escape (distinct / (total + distinct)).
    The language of least code length wins; equal lengths go to the name that sorts first; score is the
    posterior under equal priors. ``und`` with score 0: null text, no letters, or no model at all.
    Other columns pass unchanged; columns named as the added ones are replaced. No rows give no rows.
    """
    model, added = PPM(texts), ("lang_pred", "score", "bits_per_byte")
    bound_batches(docs.sparkSession)
    docs = docs.drop(*added)
    keep = docs.columns
    schema = docs.withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0), "bits_per_byte": F.lit(0.0)}).schema
    lettered = docs.withColumn("_lettered", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))

    def run(batches):
        for batch in batches:
            data, offsets = utf8(batch.column(batch.schema.get_field_index("text")))
            good = np.array(batch.column(len(keep)).to_pylist(), bool) & bool(model.langs)
            bits = model.score(data, offsets) if len(model.langs) else np.zeros((len(good), 1))
            best = bits.argmin(1) if len(good) else np.zeros(0, int)
            low = bits.min(1, keepdims=True) if len(good) else bits
            with np.errstate(under="ignore"):
                share = 1 / np.exp2(low - bits).sum(1)
            langs = [model.langs[b] if g else "und" for b, g in zip(best, good)]
            size = np.maximum(np.diff(offsets), 1)
            cols = [batch.column(i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays(
                [*cols, pa.array(langs, pa.string()), pa.array(np.where(good, share, 0.0)), pa.array(np.where(good, low[:, 0] / size, 0.0))], names=[*keep, *added]
            )
            del batch, cols, data, offsets
            release()

    return lettered.mapInArrow(run, schema)


def held_out(modulus: int, column: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(modulus))
