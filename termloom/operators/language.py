"""Language identification by correlation of letter or bigram profiles."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..plans.common import BROADCAST_ROWS, small_or_shuffled
from .within import one_row_each

GRAMS = {"letters": X.letters, "bigrams": X.bigrams}

#: The characters of grams; a pair is coded as 32 times the first's place plus the second's.
_CHARS = "abcdefghijklmnopqrstuvwxyz \t\n\x0b\f\r"
_CODES = np.zeros(256, np.int64)
_CODES[list(_CHARS.encode())] = range(len(_CHARS))
#: Documents and characters whose counts are held at once.
_DOCS, _SIZE = 512, 4_000_000


def _all_grams(kind: str) -> list[str]:
    """Each code's gram."""
    wide = _CHARS.ljust(32, "?")
    return list(wide) if kind == "letters" else [a + b for a in wide for b in wide]


def _coded(docs: DataFrame, key: str, kind: str) -> DataFrame:
    """The key and the characters that count."""
    kept = F.regexp_replace(F.lower(F.col("text")), "[^a-z]" if kind == "letters" else r"[^a-z\s]", "")
    return docs.select(key, F.coalesce(kept, F.lit("")).alias("text"))


def _counted(texts, kind: str, owner=None):
    """Counts of (row, gram code) for some rows at a time: (first row, table). owner: rows are added up by it instead."""
    width = 32 if kind == "letters" else 1024
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
    at, n = 0, len(sizes)
    while at < n:
        end = at + max(1, min(_DOCS, int(np.searchsorted(np.cumsum(sizes[at : at + _DOCS]), _SIZE, side="right"))))
        part = sizes[at:end]
        codes = _CODES[np.frombuffer("".join(texts.slice(at, end - at).to_pylist()).encode(), np.uint8)]
        row = np.repeat(np.arange(len(part)) if owner is None else owner[at:end], part)
        if kind == "bigrams":
            of = np.repeat(np.arange(len(part)), part)
            keep = (of[1:] == of[:-1]) & (codes[:-1] != 26)  # pairs in one text whose first is no space
            codes, row = (codes[:-1] * 32 + codes[1:])[keep], row[:-1][keep]
        rows = len(part) if owner is None else int(owner.max()) + 1
        yield at, np.bincount(row * width + codes, minlength=rows * width).reshape(rows, width)
        at = end


def gram_counts(docs: DataFrame, kind: str = "letters", key: str = "doc_id") -> DataFrame:
    """``key, gram, n``."""
    return docs.select(key, F.explode(GRAMS[kind](F.col("text"))).alias("gram")).groupBy(key, "gram").agg(F.count("*").alias("n"))


def profiles(docs: DataFrame, kind: str = "letters") -> DataFrame:
    """``lang, gram, n`` of training documents; a batch of texts is counted before anything is shuffled."""
    grams = _all_grams(kind)

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            langs = b.column(0).dictionary_encode()
            total = sum(table for _, table in _counted(b.column(1), kind, langs.indices.to_numpy()))
            lang, code = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([langs.dictionary.take(pa.array(lang)), pa.array([grams[c] for c in code], pa.string()), pa.array(total[lang, code])], ["lang", "gram", "n"])

    known = docs.where("lang is not null")
    schema = T.StructType([docs.schema["lang"], T.StructField("gram", T.StringType()), T.StructField("n", T.LongType())])
    return _coded(known, "lang", kind).mapInArrow(run, schema).groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def predict(docs: DataFrame, model: DataFrame, kind: str = "letters") -> DataFrame:
    """``doc_id, lang_pred, correlation``: the profile with the largest absolute correlation.

    The domain is the union of the model's grams and the text's own, with missing counts as zero; Pearson's
    coefficient then needs only sums over grams that are present: of x, y, x^2, y^2 and xy, and the
    domain's size. Ties go to the language that sorts first; texts without grams have no prediction.

    Texts are counted and compared one at a time; a model of more than BROADCAST_ROWS rows, or repeated ids, are joined.
    """
    rows = model.select("lang", "gram", "n").limit(BROADCAST_ROWS + 1).collect()
    if len(rows) > BROADCAST_ROWS or any(r.lang is None for r in rows) or not one_row_each(docs):
        return predict_joined(docs, model, kind)
    langs = sorted({r.lang for r in rows}, key=lambda x: x.encode())
    grams = {g: c for c, g in enumerate(_all_grams(kind)) if "?" not in g}
    counts = np.zeros((len(langs), 32 if kind == "letters" else 1024), np.int64)
    sy, syy = dict.fromkeys(langs, 0), dict.fromkeys(langs, 0)
    for r in rows:
        sy[r.lang] += r.n
        syy[r.lang] += r.n * r.n
        if r.gram in grams:
            counts[langs.index(r.lang), grams[r.gram]] = r.n
    size, domain = float(len({r.gram for r in rows})), counts.any(axis=0)
    y, yy = np.array([float(sy[x]) for x in langs]), np.array([float(syy[x]) for x in langs])

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            found = []
            for _, x in _counted(b.column(1), kind):
                own = lambda v: v.astype(np.float64)[:, None]
                n = own((x > 0).sum(axis=1)) - own((x[:, domain] > 0).sum(axis=1)) + size
                sx, sxx, sxy = own(x.sum(axis=1)), own((x * x).sum(axis=1)), (x @ counts.T).astype(np.float64)
                var = (n * sxx - sx * sx) * (n * yy - y * y)
                found.append(np.divide(n * sxy - sx * y, np.sqrt(np.maximum(var, 0)), out=np.full(var.shape, np.nan), where=var > 0))
            r = np.concatenate(found).ravel()
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(r) + 1, max(len(langs), 1), dtype=np.int32)), pa.array(r, mask=np.isnan(r)))
            yield pa.RecordBatch.from_arrays([b.column(0), lists], ["doc_id", "rs"])

    if not langs:
        return docs.select("doc_id", F.lit(None).cast("string").alias("lang_pred"), F.lit(None).cast("double").alias("correlation"))
    scored = _coded(docs, "doc_id", kind).mapInArrow(run, T.StructType([docs.schema["doc_id"], T.StructField("rs", T.ArrayType(T.DoubleType()))]))
    each = F.transform("rs", lambda r, i: F.struct(F.abs(F.round(r, 6)).alias("size"), (-i).alias("place"), F.round(r, 6).alias("r")))
    best = scored.select("doc_id", F.array_max(F.filter(each, lambda s: s["r"].isNotNull())).alias("best"))
    return best.select("doc_id", F.get(F.array(*map(F.lit, langs)), -F.col("best.place")).alias("lang_pred"), F.col("best.r").alias("correlation"))


def predict_joined(docs: DataFrame, model: DataFrame, kind: str = "letters") -> DataFrame:
    """``predict`` by joins of grams, for models of any size."""
    grams = gram_counts(docs, kind)
    own = grams.groupBy("doc_id").agg(F.count("*").alias("g"), F.sum("n").alias("sx"), F.sum(F.col("n") * F.col("n")).alias("sxx"))
    square = F.col("n").cast("decimal(19,0)") * F.col("n").cast("decimal(19,0)")
    langs = small_or_shuffled(model.groupBy("lang").agg(F.sum("n").alias("sy"), F.sum(square).alias("syy")))
    domain = model.select("gram").distinct()
    size = domain.agg(F.count("*").alias("v"))
    known = grams.join(small_or_shuffled(domain), "gram", "left_semi").groupBy("doc_id").agg(F.count("*").alias("k"))
    met = grams.join(small_or_shuffled(model.withColumnRenamed("n", "m")), "gram").groupBy("doc_id", "lang").agg(F.sum(F.col("n") * F.col("m")).alias("sxy"))
    every = own.join(known, "doc_id", "left").crossJoin(langs).crossJoin(F.broadcast(size))  # a few languages, one size
    every = every.join(met, ["doc_id", "lang"], "left")
    d = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("double")
    n = d("v") + d("g") - d("k")
    var = (n * d("sxx") - d("sx") * d("sx")) * (n * d("syy") - d("sy") * d("sy"))
    r = F.when(var > 0, (n * d("sxy") - d("sx") * d("sy")) / F.sqrt(var))
    scored = every.select("doc_id", "lang", F.round(r, 6).alias("r")).where("r is not null")
    best = Window.partitionBy("doc_id").orderBy(F.desc(F.abs("r")), "lang")
    picked = scored.withColumn("place", F.row_number().over(best)).where("place = 1")
    return docs.select("doc_id").join(picked.select("doc_id", F.col("lang").alias("lang_pred"), F.col("r").alias("correlation")), "doc_id", "left")


def detected(docs: DataFrame, detector) -> DataFrame:
    """``doc_id, lang_pred`` by any detector: a function of the text column, or one of a pandas series of texts."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    try:
        column = detector(text)
    except Exception:  # noqa: BLE001  not a function of columns
        column = None
    if not isinstance(column, Column):

        @F.pandas_udf("string")
        def column_of(texts: pd.Series) -> pd.Series:
            return pd.Series(detector(texts), dtype=object)

        column = column_of(text)
    return docs.select("doc_id", column.alias("lang_pred"))


def accuracy(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """``lang, docs, correct, accuracy``; truth: (doc_id, lang)."""
    met = truth.select("doc_id", "lang").join(predicted.select("doc_id", "lang_pred"), "doc_id")
    ok = F.coalesce((F.col("lang") == F.col("lang_pred")).cast("long"), F.lit(0))
    return met.groupBy("lang").agg(F.count("*").alias("docs"), F.sum(ok).alias("correct"), F.round(F.avg(ok), 6).alias("accuracy"))
