"""Exact token counts at every prefix, by prefix dynamic programming over byte-pair tokens.

A text falls into words by the vocabulary's splitting pattern; the words before a cut are encoded alike
in every longer prefix. Within a word, a step over its bytes keeps for each prefix the last token of its
encoding and the number of tokens: the last token is the one that ends there and makes a valid pair with
the last token of the prefix before it. A pair is valid if the two tokens' bytes, encoded alone, give just
those two. So each prefix costs a few look-ups and no prefix is encoded again. The changes from prefix to
prefix are stored, a packed byte a code point, and all answers are read from that store.

Defined cases: null text counts as empty (0 tokens); special strings in a text are one token, as the
library's default has it; very long texts are processed whole; repeated rows give repeated rows; extra
columns are ignored; null ids are kept.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise

CACHE_WORDS = 500_000
CACHE_LENGTH = 64
HEAD = 6
#: Outside these ranges the splitting pattern is left to the library, whose Unicode tables may differ.
_KNOWN = "\x00-ԯ -⁯₠-₿←-⇿぀-ヿ一-龥\U0001f300-\U0001f5ff"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class PrefixCounter:
    """Token counts of texts and of all their prefixes for one vocabulary file (tokenizers' .json)."""

    def __init__(self, path: str):
        import regex
        import tiktoken
        from tokenizers import Tokenizer

        spec = json.load(open(path, encoding="utf-8"))
        self.pre = Tokenizer.from_file(path).pre_tokenizer
        shown = _byte_letters()
        tokens = {bytes(shown[c] for c in t): i for t, i in spec["model"]["vocab"].items() if all(c in shown for c in t)}
        self.specials = [t["content"] for t in spec.get("added_tokens", ())]
        self.ids = {b: i for b, i in tokens.items() if b.decode("latin-1") not in self.specials}
        self.bytes_of = {i: b for b, i in self.ids.items()}
        self.longest = max(map(len, self.ids))
        merged = [bytes(shown[c] for p in (m if isinstance(m, list) else m.split(" ")) for c in p) for m in spec["model"]["merges"]]
        order = {b: i for i, b in enumerate([b for b in self.ids if len(b) == 1])}
        for b in merged:
            order.setdefault(b, len(order))
        self._rank_to_id = {r: self.ids[b] for b, r in order.items()}
        self._bpe = tiktoken.Encoding("own", pat_str=r"\s+|\S+", mergeable_ranks=order, special_tokens={})
        self.pattern = regex.compile(
            r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        )
        self.unknown = re.compile(f"[^{_KNOWN}]")
        self.runs = re.compile(r"\s \s|\s \Z")
        self.safe = re.compile(rf"(?<=[{_KNOWN}])(?<=\S) (?=\S)(?=[{_KNOWN}])")
        self.special = regex.compile("|".join(map(regex.escape, self.specials))) if self.specials else None
        # A token that merging its own bytes doesn't lead to never occurs.
        self.ids = {b: i for b, i in self.ids.items() if self._whole(b) == [i]}
        self.pairs: dict[int, bool] = {}
        #: The steps over the first bytes of a word, which many words share.
        self.heads: dict[bytes, tuple[list[int], list[int]]] = {}
        self.words: dict[str, bytes | None] = {}
        self.chunks: dict[str, bytes | None] = {}

    def _whole(self, piece: bytes) -> list[int]:
        return [self._rank_to_id[r] for r in self._bpe._encode_single_piece(piece)]

    def _valid(self, left: int, right: int) -> bool:
        got = self.pairs.get(left << 32 | right)
        if got is None:
            if len(self.pairs) > 4 * CACHE_WORDS:
                self.pairs.clear()
            got = self.pairs[left << 32 | right] = self._whole(self.bytes_of[left] + self.bytes_of[right]) == [left, right]
        return got

    def steps(self, word: bytes) -> list[int]:
        """Tokens of each prefix of the word's bytes, from the empty one on."""
        n, get, longest, pairs = len(word), self.ids.get, self.longest, self.pairs.get
        head = self.heads.get(word[:HEAD]) if n > HEAD else None
        count, last = ([0], [-1]) if head is None else (head[0].copy(), head[1].copy())
        for end in range(len(count), n + 1):
            if end == HEAD + 1 and head is None and len(self.heads) < CACHE_WORDS // 4:
                self.heads[word[:HEAD]] = count.copy(), last.copy()
            token = get(word[:end]) if end <= longest else None
            if token is not None:
                count.append(1)
                last.append(token)
                continue
            for start in range(max(1, end - longest), end):
                token = get(word[start:end])
                if token is None:
                    continue
                before = last[start]
                ok = pairs(before << 32 | token)
                if self._valid(before, token) if ok is None else ok:
                    count.append(count[start] + 1)
                    last.append(token)
                    break
        return count

    def split(self, text: str) -> list[str]:
        """The words of a text without special strings."""
        if self.unknown.search(text):
            return [text[a:b] for _, (a, b) in self.pre.pre_tokenize_str(text)]
        return self.pattern.findall(text)

    def parts(self, text: str) -> Iterator[tuple[str, bool]]:
        """Stretches of ordinary text and special strings (True), in order."""
        at = 0
        for m in self.special.finditer(text) if self.special else ():
            if m.start() > at:
                yield text[at : m.start()], False
            yield m[0], True
            at = m.end()
        if at < len(text):
            yield text[at:], False

    def _changes(self, piece: str) -> bytes | None:
        """The change of the count at each code point of a piece, a signed byte each; None if one is no byte."""
        body = piece.removeprefix(" ")
        if "'" in piece or body.split() not in ([], [body]):
            return _small(np.diff(self.prefixes(piece)))
        # Words without white space inside or contractions are cut like the whole: the steps over their bytes.
        words = self.words
        out = [self._word(w) if (b := words.get(w)) is None else b for w in self.split(piece)]
        return None if None in out else b"".join(out)

    def _word(self, w: str) -> bytes | None:
        data = w.encode("utf-8", "surrogatepass")
        counts = self.steps(data)
        if len(data) != len(w):  # the counts at the ends of characters
            counts = [0, *[c for c, b in zip(counts[1:], [*data[1:], 0]) if b & 0xC0 != 0x80]]
        got = _small(np.diff(counts)) if len(counts) > 100 else bytes([(y - x) & 255 for x, y in zip(counts, counts[1:])])
        if len(self.words) < CACHE_WORDS and len(w) <= CACHE_LENGTH:
            self.words[w] = got
        return got

    def _after_space(self, chunk: str) -> bytes | None:
        got = self._changes(" " + chunk)
        if len(self.chunks) < CACHE_WORDS and len(chunk) <= CACHE_LENGTH:  # frequent ones come early
            self.chunks[chunk] = got
        return got

    def changes(self, text: str) -> np.ndarray:
        """The change of the count at each code point: its running sum is the count of every prefix.

        A space between two other characters that aren't white space starts a word, and what comes before
        it is encoded alike in every longer prefix. So the changes of a text are those of the pieces
        between such spaces, one after the other, and pieces met before are looked up.
        """
        if self.special and self.special.search(text):
            return np.diff(self.prefixes(text))
        plain = not self.runs.search(text) and not self.unknown.search(text)
        first, *rest = text.split(" ") if plain else self.safe.split(text)
        get, own = self.chunks.get, self._after_space
        found = [self._changes(first), *[own(c) if (b := get(c)) is None else b for c in rest]]
        if None in found:
            return np.diff(self.prefixes(text))
        return np.frombuffer(b"".join(found), np.int8)

    def count(self, text: str) -> int:
        """Tokens of a whole text: the last of its prefixes' counts."""
        return int(self.changes(text).sum(dtype=np.int64))

    def _partial(self, text: str) -> int:
        return sum(self.steps(w.encode("utf-8", "surrogatepass"))[-1] for w in self.split(text))

    def prefixes(self, text: str) -> np.ndarray:
        """``out[p]``: tokens of ``text[:p]``, for p from 0 to the number of code points."""
        out = np.zeros(len(text) + 1, np.int32)
        at = base = stretch = 0
        for part, special in self.parts(text):
            if special:
                start = at - _tail(text[stretch:at])
                for k in range(1, len(part)):
                    out[at + k] = out[start] + self._partial(text[start : at + k])
                at, base = at + len(part), base + 1
                stretch = at
                out[at] = base
                continue
            gap = at  # where the run of white space before the cut begins
            for w in self.split(part):
                data = w.encode("utf-8", "surrogatepass")
                counts = self.steps(data)
                cut = 0
                for k, c in enumerate(w, 1):
                    cut += len(c.encode("utf-8", "surrogatepass"))
                    out[at + k] = base + counts[cut]
                    if c.isspace():
                        run = text[gap : at + k]
                        if k < len(w) or len(run) > k:  # a cut here makes the whole run one word
                            out[at + k] = out[gap] + self.steps(run.encode())[-1]
                    else:
                        gap = at + k
                        if w[0] == "'" and k < len(w):  # part of a contraction
                            out[at + k] = base + self._partial(w[:k])
                at, base = at + len(w), base + counts[-1]
                out[at] = base if not w.isspace() else out[at]
        return out


def _small(changes: np.ndarray) -> bytes | None:
    """Changes as signed bytes, None if one is too large."""
    fits = not len(changes) or (changes.min() >= -128 and changes.max() <= 127)
    return changes.astype(np.int8).tobytes() if fits else None


def _tail(text: str) -> int:
    """Length of the end of a text that a cut special string after it may be joined with."""
    n = len(text)
    k = n
    while k and not text[k - 1].isalnum():
        k -= 1
    return n - k


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain}
    spare = 256
    for b in range(256):
        if b not in letters.values():
            letters[chr(spare)] = b
            spare += 1
    return letters


@lru_cache(maxsize=2)
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def prefix_store(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """``doc_id, n_chars, n_bytes, n_tokens, steps``: steps packs the change of the count at each code point."""
    path = vocabulary or default_vocabulary()

    @F.pandas_udf(T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("steps", T.BinaryType())]))
    def pack(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        c = counter(path)
        for s in batches:
            found = map(c.changes, s)
            yield pd.DataFrame([(int(d.sum(dtype=np.int64)), _pack(d)) for d in found], columns=["n_tokens", "steps"])

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    size = [F.char_length(text).cast("long").alias("n_chars"), F.octet_length(text).cast("long").alias("n_bytes")]
    return docs.select("doc_id", *size, pack(text).alias("p")).select("doc_id", "n_chars", "n_bytes", "p.*")


def _pack(changes: np.ndarray) -> bytes:
    """One byte a change where that holds them all, else four; compressed."""
    small = _small(changes)
    return b"i" + zlib.compress(changes.astype("<i4").tobytes(), 1) if small is None else b"b" + zlib.compress(small, 1)


def unpack(steps: bytes) -> np.ndarray:
    """The count of every prefix, from the empty one to the whole text."""
    changes = np.frombuffer(zlib.decompress(steps[1:]), np.int8 if steps[:1] == b"b" else "<i4")
    return np.concatenate([[0], np.cumsum(changes, dtype=np.int64)])


def _from_store(answer):
    """A column of what ``answer`` finds in the prefixes' counts."""

    @F.pandas_udf(T.LongType())
    def read(s: pd.Series) -> pd.Series:
        return pd.Series([answer(unpack(b)) for b in s], dtype="int64")

    return read


def budget_cut(store: DataFrame, budget: int) -> DataFrame:
    """Adds ``cut``: the longest prefix (code points) whose own count is within the budget."""
    longest = _from_store(lambda p: len(p) - 1 - int((p[::-1] <= budget).argmax()))
    return store.withColumn("cut", longest("steps"))


def token_counts(docs: DataFrame, vocabulary: str | None = None, limit: int = 1024) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit, cut`` of every row, read from the stored prefixes.

    ``cut`` is the length in code points of the longest prefix of at most ``limit`` tokens.
    """
    store = materialise(prefix_store(docs, vocabulary), "token-prefixes")
    return budget_cut(store, limit).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "cut")


def count_at(store: DataFrame, length) -> DataFrame:
    """Adds ``count``: tokens of the prefix of ``length`` code points (a column or number)."""

    @F.pandas_udf(T.LongType())
    def at(s: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([int(p[max(0, min(k, len(p) - 1))]) for p, k in zip(map(unpack, s), n)], dtype="int64")

    size = F.lit(length) if isinstance(length, int) else length
    return store.withColumn("count", at("steps", size.cast("long")))
