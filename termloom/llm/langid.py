"""Language identification by segmentation-marginalised unigrams.

A word's probability in a language is the sum over all its segmentations into pieces of a fixed public
vocabulary of the product of the pieces' probabilities; a forward algorithm computes it. The pieces'
probabilities per language come from one expectation step over all training words (forward-backward from
equal piece probabilities), summed over the whole training text.

Both passes are map-only over whole texts; training adds a shuffle of partial counts, one row a language
and piece from each task, so what it gathers grows with the input until the vocabulary is covered.

Defined cases: null text or text without a letter gives ``und`` with score 0; runs of letters longer than
48 are cut into such stretches; without training rows every text is ``und``; ties go to the language that
sorts first; extra columns are ignored.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import held_out

LONGEST_WORD = 48
LONGEST_PIECE = LONGEST_WORD + 1  # with the word mark; a longer piece fits no word, all others are used
UNKNOWN = 1e-7
SCALE = 1e5  # a factor for each character, so that no product of a word's pieces leaves the range of doubles
CACHE_WORDS = 300_000
BATCH_WORDS = 20_000
_LETTERS = re.compile(rf"[^\W\d_]{{1,{LONGEST_WORD}}}")  # a longer run falls into stretches
CACHE_BYTES = 64 << 20
_P = np.uint64(0x100000001B3)
_BITS = 18
_BEGINS, _ABSENT = -1, -2


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """The vocabulary's pieces of letters, found by a hash of their characters.

    A word begins with the vocabulary's word mark. A character without a piece of its own stands for
    the last number, ``unknown``.
    """

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        names = {sp.id_to_piece(i).lower() for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_byte(i) or sp.is_unknown(i))}
        self.names = sorted(n for n in names if n.replace("▁", "", 1).isalpha() and "▁" not in n[1:])
        self.longest = max(map(len, self.names), default=1)
        self.unknown = len(self.names)
        self.size = self.unknown + 1
        of: dict[int, int] = {}
        for i, n in enumerate(self.names):
            h = 0
            for c in n:
                h = (h * int(_P) + ord(c)) & 0xFFFFFFFFFFFFFFFF
                of.setdefault(h, _BEGINS)
            of[h] = i
        self.keys = np.zeros(1 << _BITS, np.uint64)
        self.numbers = np.full(1 << _BITS, _ABSENT, np.int32)
        h, number = np.fromiter(of, np.uint64, len(of)), np.fromiter(of.values(), np.int32, len(of))
        slot = self._slot(h)
        while len(h):
            free = np.flatnonzero(self.numbers[slot] == _ABSENT)
            _, one = np.unique(slot[free], return_index=True)  # one key a free slot, the others go on
            put = free[one]
            self.keys[slot[put]], self.numbers[slot[put]] = h[put], number[put]
            left = np.ones(len(h), bool)
            left[put] = False
            h, number, slot = h[left], number[left], (slot[left] + np.uint64(1)) & np.uint64((1 << _BITS) - 1)

    @staticmethod
    def _slot(h: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (h ^ (h >> np.uint64(23))) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - _BITS)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The piece of each hash, ``_BEGINS`` where longer pieces begin so, else ``_ABSENT``."""
        slot = self._slot(h)
        out = np.where(self.keys[slot] == h, self.numbers[slot], _ABSENT)
        todo = np.flatnonzero((self.keys[slot] != h) & (self.numbers[slot] != _ABSENT))
        while len(todo):  # the few that met another key
            slot[todo] = (slot[todo] + np.uint64(1)) & np.uint64((1 << _BITS) - 1)
            s = slot[todo]
            hit = self.keys[s] == h[todo]
            out[todo[hit]] = self.numbers[s[hit]]
            todo = todo[~hit & (self.numbers[s] != _ABSENT)]
        return out

    def lattice(self, words: list[str]) -> list[list[tuple[np.ndarray, np.ndarray]]]:
        """For words of one length, ``[end][k]``: the words whose last k+1 characters before end are a piece, and it.

        From each start only the words go on whose characters so far begin some piece.
        """
        n = len(words[0]) + 1
        codes = np.frombuffer("".join("▁" + w for w in words).encode("utf-32-le"), np.uint32).reshape(len(words), n).astype(np.uint64)
        out = [[] for _ in range(n + 1)]
        with np.errstate(over="ignore"):
            live = [(np.arange(len(words)), np.zeros(len(words), np.uint64))] * n
            for k in range(min(self.longest, n)):
                for start in range(n - k):
                    at, h = live[start]
                    h = h * _P + codes[at, start + k]
                    found = self.find(h)
                    on = found != _ABSENT
                    live[start] = (at[on], h[on])
                    if not k:
                        found = np.where(found < 0, self.unknown, found)
                    piece = found >= 0
                    out[start + k + 1].append((at[piece], found[piece]))
        return out


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def forward(lattice, p: np.ndarray) -> list[np.ndarray]:
    """``a[end][word, language]``: summed probability of all segmentations of the first ``end`` characters.

    Times ``SCALE`` for each of them. ``p``: pieces by languages.
    """
    a = [np.ones((len(lattice[1][0][1]), p.shape[1]))]
    for end in range(1, len(lattice)):
        total = np.zeros_like(a[0])
        for k, (words, found) in enumerate(lattice[end]):
            total[words] += a[end - 1 - k][words] * (p[found] * SCALE ** (k + 1))
        a.append(total)
    return a


def expected(lattice, weight: np.ndarray, size: int) -> np.ndarray:
    """Expected piece counts under equal probabilities, for words with counts by language (words, languages)."""
    p = np.full((size, 1), 1.0 / size)
    p[size - 1] = UNKNOWN
    n = len(lattice) - 1
    a = [x[:, 0] for x in forward(lattice, p)]
    b = [np.zeros(len(a[0])) for _ in range(n)] + [np.ones(len(a[0]))]
    flat = p[:, 0]
    for end in range(n, 0, -1):
        for k, (words, found) in enumerate(lattice[end]):
            b[end - 1 - k][words] += flat[found] * SCALE ** (k + 1) * b[end][words]
    z = a[n]
    out = np.zeros((size, weight.shape[1]))
    for end in range(1, n + 1):
        for k, (words, found) in enumerate(lattice[end]):
            share = a[end - 1 - k][words] * (flat[found] * SCALE ** (k + 1)) * b[end][words] / z[words]
            for j in range(weight.shape[1]):
                out[:, j] += np.bincount(found, share * weight[words, j], size)
    return out


def words_of(text: str) -> list[str]:
    return _LETTERS.findall(text.lower())


def _by_length(words) -> Iterator[list[str]]:
    groups: dict[int, list[str]] = {}
    for w in words:
        groups.setdefault(len(w), []).append(w)
    for group in groups.values():
        for at in range(0, len(group), BATCH_WORDS):
            yield group[at : at + BATCH_WORDS]


def train(docs: DataFrame, vocabulary: str | None = None) -> tuple[list[str], np.ndarray]:
    """Languages and log-free piece probabilities (pieces, languages) from all rows that aren't held out."""
    path = vocabulary or default_vocabulary()

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocab = pieces(path)
        words: dict[str, Counter] = {}
        sums: dict[str, np.ndarray] = {}

        def spend():
            for lang, counter in words.items():
                total = sums.setdefault(lang, np.zeros(vocab.size))
                for group in _by_length(counter):
                    weight = np.array([counter[w] for w in group], float)[:, None]
                    total += expected(vocab.lattice(group), weight, vocab.size)[:, 0]
            words.clear()

        for pdf in batches:
            for lang, text in zip(pdf["lang"], pdf["text"]):
                words.setdefault(lang, Counter()).update(words_of(text))
            if sum(map(len, words.values())) > CACHE_WORDS:
                spend()
        spend()
        for lang, total in sums.items():
            some = np.flatnonzero(total)
            yield pd.DataFrame({"lang": lang, "piece": some.astype(np.int32), "n": total[some]})

    rows = (
        docs.select("doc_id", "lang", F.col("text").cast("string").alias("text"))
        .where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
        .select("lang", "text")
        .mapInPandas(count, "lang string, piece int, n double")
        .groupBy("lang", "piece")
        .agg(F.sum("n").alias("n"))  # at most languages x pieces rows
        .toPandas()
    )
    langs = sorted(rows["lang"].unique())
    vocab = pieces(path)
    n = np.zeros((vocab.size, len(langs)))
    n[rows["piece"].to_numpy(int), [langs.index(x) for x in rows["lang"]]] = rows["n"]
    p = n + 0.1
    return langs, p / p.sum(0)


class Scorer:
    """Summed log probabilities of texts under each language."""

    def __init__(self, path: str, p: np.ndarray):
        self.vocab = pieces(path)
        p = p.copy()
        p[self.vocab.unknown] = UNKNOWN  # alike in all languages
        self.p = p
        self.most = min(CACHE_WORDS, CACHE_BYTES // (8 * p.shape[1]))
        self.rows: dict[str, int] = {}  # a known word's row in logs
        self.logs = np.zeros((0, p.shape[1]))

    def batch(self, texts: list[str | None]) -> list[np.ndarray | None]:
        lists = [words_of(t) if t else [] for t in texts]
        flat = [w for ws in lists for w in ws]
        missing = set(flat).difference(self.rows)
        if len(self.rows) + len(missing) > self.most:  # the known words make room
            self.rows, self.logs, missing = {}, self.logs[:0], set(flat)
        parts = [self.logs]
        for group in _by_length(missing):
            lattice = self.vocab.lattice(group)
            parts.append(np.log(forward(lattice, self.p)[-1]) - (len(lattice) - 1) * np.log(SCALE))
            self.rows.update(zip(group, range(len(self.rows), len(self.rows) + len(group))))
        self.logs = np.concatenate(parts)
        sizes = np.array([len(ws) for ws in lists])
        some = np.flatnonzero(sizes)
        out: list[np.ndarray | None] = [None] * len(texts)
        if len(some):
            at = np.fromiter(map(self.rows.__getitem__, flat), np.int64, len(flat))
            starts = (np.cumsum(sizes) - sizes)[some]
            for i, total in zip(some, np.add.reduceat(self.logs[at], starts)):
                out[i] = total
        return out


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], vocabulary: str | None = None) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every row."""
    path = vocabulary or default_vocabulary()
    langs, p = model
    packed = docs.sparkSession.sparkContext.broadcast(pickle.dumps((langs, p)))  # pieces x languages
    kind = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    @F.pandas_udf(kind)
    def guess(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names, table = pickle.loads(packed.value)
        scorer = Scorer(path, table) if names else None
        for s in batches:
            rows = []
            for at in range(0, len(s), 1000):
                texts = s.iloc[at : at + 1000].tolist()
                for logs in scorer.batch(texts) if scorer else [None] * len(texts):
                    if logs is None:
                        rows.append(("und", 0.0))
                    else:
                        best = int(np.argmax(logs))
                        rows.append((names[best], float(1 / np.exp(np.maximum(logs - logs[best], -700)).sum())))
            yield pd.DataFrame(rows, columns=["lang_pred", "score"])

    return docs.select("doc_id", held_out().alias("held_out"), guess(F.col("text").cast("string")).alias("g")).select(
        "doc_id", "held_out", "g.*"
    )


def identify(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    return predict(docs, train(docs, vocabulary), vocabulary)
