"""Work that needs one document at a time: counts, places and matches over Arrow batches, without a shuffle.

Texts come in as ``tokenize.kept_text`` leaves them, so white space is ASCII and Python's ``split`` finds the
words that ``tokenize.plain_tokens`` finds, in their order.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..plans.common import small_or_shuffled
from . import tokenize

#: Rows of an Arrow batch that is handed back.
ROWS = 100_000


def one_row_each(docs: DataFrame) -> bool:
    """Whether no two rows share a ``doc_id``; reads that column only."""
    return docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty()


def _words(text: str | None, low: int, high: int) -> list[str]:
    return [w for w in text.split() if low <= len(w) <= high] if text else []


def _over(docs: DataFrame, function, schema: T.StructType, low: int, high: int) -> DataFrame:
    """Rows of ``function(ids, lists of kept words)`` for each batch of documents."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                yield from function(b.column(0), [_words(t, low, high) for t in b.column(1).to_pylist()])

    return docs.select("doc_id", tokenize.kept_text("text").alias("text")).mapInArrow(run, schema)


def _with_id(docs: DataFrame, *rest: T.StructField) -> T.StructType:
    return T.StructType([docs.schema["doc_id"], *rest])


_TERM = T.StructField("term", T.StringType())


def frequencies(docs: DataFrame, low: int = 3, high: int = 25) -> DataFrame:
    """``doc_id, term, tf`` as of ``term_frequencies(plain_tokens(docs))``; rows of one id are added up."""

    def counted(ids, lists):
        at, terms, n = [], [], []
        for i, words in enumerate(lists):
            c = Counter(words)
            at += [i] * len(c)
            terms += c
            n += c.values()
            if len(at) >= ROWS or at and i == len(lists) - 1:
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(at)), pa.array(terms, pa.string()), pa.array(n, pa.int64())], ["doc_id", "term", "tf"])
                at, terms, n = [], [], []

    found = _over(docs, counted, _with_id(docs, _TERM, T.StructField("tf", T.LongType())), low, high)
    return found if one_row_each(docs) else found.groupBy("doc_id", "term").agg(F.sum("tf").alias("tf"))


def vocabulary(docs: DataFrame, low: int = 3, high: int = 25) -> DataFrame:
    """``term, cf, df``; the row without a term has the documents that hold any in ``df``.

    A batch of documents is counted before anything is shuffled, so rows follow the vocabulary.
    """
    if not one_row_each(docs):
        tf = frequencies(docs, low, high)
        every = tf.select("doc_id").distinct().agg(F.lit(None).cast("string").alias("term"), F.lit(0).cast("long").alias("cf"), F.count("*").alias("df"))
        return tf.groupBy("term").agg(F.sum("tf").alias("cf"), F.count("*").alias("df")).union(every)

    def counted(ids, lists):
        cf, df = Counter(), Counter()
        for words in lists:
            cf.update(words)
            df.update(set(words))
        terms = list(cf)
        columns = [pa.array([None, *terms], pa.string()), pa.array([0, *cf.values()], pa.int64()), pa.array([sum(map(bool, lists)), *[df[t] for t in terms]], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["term", "cf", "df"])

    schema = T.StructType([_TERM, T.StructField("cf", T.LongType()), T.StructField("df", T.LongType())])
    return _over(docs, counted, schema, low, high).groupBy("term").agg(F.sum("cf").alias("cf"), F.sum("df").alias("df"))


def positions(docs: DataFrame, low: int = 3, high: int = 25) -> DataFrame:
    """``term, doc_id, tf, positions`` as of ``index.positional_index``, in runs sorted by term.

    That operator takes the documents of repeated ids, and no others.
    """
    docs = docs.select("doc_id", "text")
    again = docs.groupBy(F.col("doc_id").alias("again")).agg(F.count("*").alias("n")).where("n > 1").select("again")
    if again.isEmpty():
        return _positions(docs, low, high)
    from .index import positional_index

    again = small_or_shuffled(again)
    same = docs["doc_id"].eqNullSafe(again["again"])
    own = _positions(docs.join(again, same, "left_anti"), low, high)
    rest = positional_index(tokenize.plain_tokens(docs.join(again, same, "left_semi"), low, high))
    return own.unionByName(rest.sortWithinPartitions("term"))


def _positions(docs: DataFrame, low: int, high: int) -> DataFrame:
    """A run of rows sorted by term for each batch of documents: words as numbers, sorted by rank and document once."""

    def placed(ids, lists):
        number: dict[str, int] = {}
        words, size = np.fromiter(map(len, lists), np.int64, len(lists)), len(lists)
        code = np.fromiter((number.setdefault(w, len(number)) for own in lists for w in own), np.int32, int(words.sum()))
        lists.clear()  # the words are far larger than their numbers
        if not len(code):
            return
        owner = np.repeat(np.arange(size), words)
        place = (np.arange(len(code)) - np.repeat(np.cumsum(words) - words, words)).astype(np.int32)
        terms = sorted(number)
        rank = np.empty(len(terms), np.int64)
        rank[[number[t] for t in terms]] = np.arange(len(terms))
        key = rank[code] * size + owner
        order = np.argsort(key, kind="stable")  # places of one word and document stay in order
        key, place, terms = key[order], place[order], pa.array(terms, pa.string())
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        ends, found = np.append(starts[1:], len(key)), key[starts]
        for k in range(0, len(starts), ROWS):
            own, first, last = found[k : k + ROWS], starts[k : k + ROWS], ends[k : k + ROWS]
            offsets = np.append(first, last[-1]) - first[0]
            at = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(place[first[0] : last[-1]]))
            columns = [terms.take(pa.array(own // size)), ids.take(pa.array(own % size)), pa.array(last - first), at]
            yield pa.RecordBatch.from_arrays(columns, ["term", "doc_id", "tf", "positions"])

    schema = T.StructType([_TERM, docs.schema["doc_id"], T.StructField("tf", T.LongType()), T.StructField("positions", T.ArrayType(T.IntegerType()))])
    return _over(docs, placed, schema, low, high)


_SPACE = re.compile(r"[ \t\n\x0b\f\r]+")


def tokens(docs: DataFrame, table=X.FOLD_FULL, by_document: bool = True) -> DataFrame:
    """``doc_id, token, n`` of the folded text's tokens as ``X.words`` splits it; or ``token, n`` of each batch."""

    def run(batches):
        for b in batches:
            at, found, n, every = [], [], [], Counter()
            for i, text in enumerate(b.column(1).to_pylist()):
                if text is None:
                    continue
                words = _SPACE.split(text.strip(" "))
                if not by_document:
                    every.update(words)
                    continue
                c = Counter(words)
                at += [i] * len(c)
                found += c
                n += c.values()
                if len(at) >= ROWS:
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array(found, pa.string()), pa.array(n, pa.int64())], ["doc_id", "token", "n"])
                    at, found, n = [], [], []
            if at:
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array(found, pa.string()), pa.array(n, pa.int64())], ["doc_id", "token", "n"])
            if every:
                yield pa.RecordBatch.from_arrays([pa.array(list(every), pa.string()), pa.array(list(every.values()), pa.int64())], ["token", "n"])

    own = [T.StructField("token", T.StringType()), T.StructField("n", T.LongType())]
    return docs.select("doc_id", X.fold(F.col("text"), table).alias("text")).mapInArrow(run, _with_id(docs, *own) if by_document else T.StructType(own))


def asked(queries: DataFrame, limit: int) -> dict | None:
    """Each query's words in order, or nothing where there are more than ``limit`` rows."""
    rows = queries.select("query_id", "i", "term").limit(limit + 1).collect()
    if len(rows) > limit:
        return None
    found: dict = {}
    for q, i, t in sorted(rows, key=lambda r: (r[0], r[1])):
        found.setdefault(q, []).append(t)
    return found


def matches(docs: DataFrame, queries: dict, kind: T.DataType, reach: list[int] | None, low: int = 3, high: int = 25) -> DataFrame:
    """``query_id, doc_id``: documents with a query's words in a row, or, with ``reach``, with each pair of
    neighbouring words at one of these distances. Ids are distinct.

    A batch's asked words are sorted by word once; a query looks at the places of its own words only.
    """
    code = {t: n for n, t in enumerate(dict.fromkeys(t for words in queries.values() for t in words))}
    coded = [(q, [code[t] for t in words]) for q, words in queries.items()]
    gap = max([1, *map(abs, reach or []), *(len(words) for _, words in coded)])

    def found(ids, lists):
        seq = np.fromiter((c for words in lists for c in [*[code.get(w, -1) for w in words], *[-1] * gap]), np.int32)
        owner = np.repeat(np.arange(len(lists)), np.fromiter((len(words) + gap for words in lists), np.int64, len(lists)))
        seq = np.concatenate([np.full(gap, -1, np.int32), seq])
        owner = np.concatenate([np.zeros(gap, np.int64), owner])
        known = np.flatnonzero(seq >= 0)
        known = known[np.argsort(seq[known], kind="stable")]
        starts = np.searchsorted(seq[known], np.arange(len(code) + 1))
        places = lambda c: known[starts[c] : starts[c + 1]]
        pairs: dict = {}

        def near(a, b):
            if (a, b) not in pairs:
                p = places(a)
                hit = np.zeros(len(p), bool)
                for d in reach:
                    hit |= seq[p + d] == b
                pairs[a, b] = np.unique(owner[p[hit]])
            return pairs[a, b]

        qs, at = [], []
        for q, words in coded:
            if reach is None:
                p = places(words[0])
                for k, c in enumerate(words[1:], 1):
                    p = p[seq[p + k] == c]
                docs_of = np.unique(owner[p])
            else:
                docs_of = None
                for a, b in zip(words, words[1:]):
                    docs_of = near(a, b) if docs_of is None else np.intersect1d(docs_of, near(a, b), assume_unique=True)
            if docs_of is not None and len(docs_of):
                qs += [q] * len(docs_of)
                at.append(docs_of)
        if qs:
            yield pa.RecordBatch.from_arrays([pa.array(qs, arrow), ids.take(pa.array(np.concatenate(at)))], ["query_id", "doc_id"])

    from pyspark.sql.pandas.types import to_arrow_type

    arrow = to_arrow_type(kind)
    return _over(docs, found, T.StructType([T.StructField("query_id", kind), docs.schema["doc_id"]]), low, high)
