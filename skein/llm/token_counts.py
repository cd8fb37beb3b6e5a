"""Token counts with a whole-token shortcut."""

from __future__ import annotations

import re
import sys
import unicodedata
from collections import Counter
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from skein.llm.common import bound_batches, release

#: Words whose merges a worker remembers at most.
MEMORY = 200_000


def _ranges(first: str) -> str:
    """A character class body of all code points whose Unicode category starts with this letter."""
    out, begin = [], None
    for i in range(sys.maxunicode + 2):
        inside = i <= sys.maxunicode and not 0xD800 <= i < 0xE000 and unicodedata.category(chr(i))[0] == first
        if inside and begin is None:
            begin = i
        elif not inside and begin is not None:
            out.append(f"\\U{begin:08x}-\\U{i - 1:08x}")
            begin = None
    return "".join(out)


@lru_cache
def pattern() -> re.Pattern:
    """The file's pre-token pattern with its Unicode classes spelled out, for the faster of Python's engines."""
    letter, number = _ranges("L"), _ranges("N")
    space = r"\s"
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letter}]+|[{number}]|[^{space}{letter}{number}]+")


def class_body(points: list[int]) -> str:
    """A character class body of these code points, sorted."""
    out: list[list[int]] = []
    for c in points:
        if out and out[-1][1] == c - 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in out)


@lru_cache
def strange(path: str) -> str:
    """A class body of the code points that the file's library takes otherwise than Python: newer letters, other white space.

    The library itself is asked, for each code point, about its classes and its normal form.
    """
    from tokenizers import Regex, pre_tokenizers

    normalizer = load(path).normalizer
    points = [c for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]
    whole, out = "".join(map(chr, points)), set()
    space = set()
    for theirs, ours in ((r"\p{L}", f"[{_ranges('L')}]"), (r"\p{N}", f"[{_ranges('N')}]"), (r"\s", r"\s")):
        found = {points[i] for _, (a, b) in pre_tokenizers.Split(Regex(f"(?!{theirs})[\\s\\S]"), "removed").pre_tokenize_str(whole) for i in range(a, b)}
        mine = {ord(c) for c in re.findall(ours, whole)}
        out |= found ^ mine
        if theirs == r"\s":
            space = found & mine
    for c in points:
        if c not in space and unicodedata.category(chr(c)) not in ("Cn", "Co") and normalizer.normalize_str(chr(c)) != normal(chr(c)):
            out.add(c)
    return class_body(sorted(out))


def normal(text: str) -> str:
    """NFC, then lower case of each code point by itself (white space splits words anyway)."""
    if text.isascii():
        return text.lower()
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


@lru_cache
def byte_letters() -> list[str]:
    """The letter that byte-level tokenizers write for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


def load(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def whole_tokens(path: str) -> frozenset[str]:
    """Pre-tokens proved to be one token: each vocabulary string that ends a word is encoded alone once."""
    tokenizer, back = load(path), {c: b for b, c in enumerate(byte_letters())}
    out = []
    for token in tokenizer.get_vocab():
        if token.endswith("</w>") and all(c in back for c in token[:-4]):
            try:
                word = bytes(back[c] for c in token[:-4]).decode()
            except UnicodeDecodeError:
                continue
            if pattern().fullmatch(word) and pattern().match(word)[0] == word and normal(word) == word:
                out.append((word, token))
    found = tokenizer.encode_batch([w for w, _ in out], add_special_tokens=False)
    return frozenset(w for (w, t), e in zip(out, found) if e.tokens == [t])


class Counts:
    def __init__(self, path: str, whole: frozenset[str], odd: str = ""):
        self.tokenizer, self.whole, self.memory = load(path), whole, {}
        self.odd = re.compile(f"[{odd}]" if odd else r"(?!)")
        self.letters = byte_letters()
        self.special = re.compile("|".join(map(re.escape, [t.content for t in self.tokenizer.get_added_tokens_decoder().values()])) or r"(?!)")

    def merged(self, word: str) -> int:
        """Tokens of a pre-token that is not known to be whole: the model's merges on its bytes."""
        n = self.memory.get(word)
        if n is None:
            if len(self.memory) >= MEMORY:
                self.memory.clear()
            n = self.memory[word] = len(self.tokenizer.model.tokenize("".join(self.letters[b] for b in word.encode())))
        return n

    def __call__(self, text: str) -> int:
        if self.odd.search(text):
            return len(self.tokenizer.encode(text, add_special_tokens=False).ids)
        parts = [text]
        n = 0
        if "<|" in text and (marks := self.special.findall(text)):
            n, parts = len(marks), self.special.split(text)
        for part in parts:
            words = pattern().findall(normal(part))
            for word, k in Counter(words).items():
                n += k if word in self.whole else k * self.merged(word)
        return n


def count_tokens(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each whole text, as the tokenizer's library counts them.

    Null and empty texts have 0 bytes and 0 tokens. The file's special strings inside a text count one
    token each, as by the library's default. Pre-tokens proved whole are counted straight, every other is
    merged. A text with a character that Python and the library class differently is left to the library.
    One row per input row, repeats included; rows with null doc_id keep the null; other columns are left out.
    """
    whole, odd = whole_tokens(path), strange(path)
    bound_batches(docs.sparkSession)

    def run(batches):
        counts = Counts(path, whole, odd)
        for batch in batches:
            texts = batch.column(1)
            sizes = pc.fill_null(pc.binary_length(texts.cast(pa.large_string())), 0).cast(pa.int64())
            n = [counts(t.as_py()) if t.is_valid else 0 for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])
            del batch, texts
        release()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
