"""Ranked and bag-of-words retrieval over term frequencies."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..plans.common import BROADCAST_ROWS, small_or_shuffled
from .index import read_terms, totals
from .statistics import term_statistics


#: Terms times queries of a table of query weights (8 bytes each); beyond it ranking joins.
CELLS = 8_000_000


@dataclass(frozen=True)
class Scheme:
    """Document and query weights as SQL over n, v, tf, qtf, mq, df, cf; null: the term has no weight."""

    doc: str
    query: str
    positive_only: bool = False


_IDF10 = "log10(n / df)"
_IDFV = "ln(v / cf)"
_IDFD = "ln(v / df)"
_HALF = "(0.5D + 0.5D * qtf / mq)"

SCHEMES = {
    # tf-idf against an augmented query weight divided by idf
    "inverse_idf": Scheme(f"tf * {_IDF10}", f"case when n > df then {_HALF} / {_IDF10} end"),
    "binary": Scheme(_IDF10, _IDF10, True),
    # the vocabulary's size and collection frequency in the place of documents
    "vocab_cf": Scheme(f"(1 + ln(tf)) * {_IDFV}", f"(1 + qtf) * {_IDFV}", True),
    "shared_terms": Scheme(_IDFV, f"(1 + qtf) * {_IDFV}"),
    "double_log": Scheme(f"tf * {_IDFD}", f"case when v > df then {_HALF} * ln({_IDFD}) end"),
    "tfidf": Scheme(f"(1 + log10(tf)) * {_IDF10}", f"(1 + log10(qtf)) * {_IDF10}", True),
}


def query_terms(queries: DataFrame) -> DataFrame:
    """``query_id, term, qtf`` from (query_id, term) tokens."""
    return queries.groupBy("query_id", "term").agg(F.count("*").alias("qtf"))


def weigh(tf: DataFrame, scheme: Scheme) -> DataFrame:
    """``doc_id, term, w`` and the term's n, v, cf, df."""
    terms = term_statistics(tf)
    totals = tf.select("doc_id").distinct().agg(F.count("*").cast("double").alias("n")).crossJoin(terms.agg(F.count("*").cast("double").alias("v")))
    stats = terms.crossJoin(F.broadcast(totals))  # one row
    return tf.join(stats, "term").withColumn("w", F.expr(scheme.doc))


def rank(tf: DataFrame, queries: DataFrame, scheme: str | Scheme = "tfidf", k: int = 10) -> DataFrame:
    """``query_id, doc_id, rank, score``: the k best by cosine, ties to the smaller id.

    Document norms cover all terms of a document, query norms those of the collection; unknown query
    terms drop out. Scores are rounded to six places before they are compared.
    """
    scheme = SCHEMES[scheme] if isinstance(scheme, str) else scheme
    weighted = weigh(tf, scheme)
    norms = weighted.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("dn"))
    q = queries.withColumn("mq", F.max("qtf").over(Window.partitionBy("query_id")))
    met = weighted.select("doc_id", "term", "w", "n", "v", "cf", "df").join(small_or_shuffled(q), "term").withColumn("q", F.expr(scheme.query))
    met = met.where("w is not null and q is not null")
    own = met.select("query_id", "term", "q").distinct().groupBy("query_id").agg(F.sqrt(F.sum(F.col("q") * F.col("q"))).alias("qn"))
    dots = met.groupBy("query_id", "doc_id").agg(F.sum(F.col("w") * F.col("q")).alias("dot"))
    scored = dots.join(norms, "doc_id").join(small_or_shuffled(own), "query_id").where("dn > 0 and qn > 0")
    scored = scored.select("query_id", "doc_id", F.round(F.col("dot") / (F.col("dn") * F.col("qn")), 6).alias("score"))
    if scheme.positive_only:
        scored = scored.where("score > 0")
    return top(scored, k)


def rank_stored(spark: SparkSession, path: str, queries: DataFrame, scheme: str = "tfidf", k: int = 10) -> DataFrame:
    """``rank`` over a stored index with norms: only the asked terms' postings are joined and shuffled."""
    rule = SCHEMES[scheme]
    n, v = totals(spark, path)
    q = queries.withColumn("mq", F.max("qtf").over(Window.partitionBy("query_id"))).join(read_terms(spark, path), "term")
    q = q.withColumns({"n": F.lit(n), "v": F.lit(v)}).withColumn("q", F.expr(rule.query)).where("q is not null")
    postings = spark.read.parquet(f"{path}/postings").select("doc_id", "term", "tf", "cf", "df").withColumns({"n": F.lit(n), "v": F.lit(v)})
    norms = spark.read.parquet(f"{path}/norms").select("doc_id", F.col(scheme).alias("dn"))
    rows = q.select("query_id", "term", "q").limit(BROADCAST_ROWS + 1).collect()
    if len(rows) > BROADCAST_ROWS or len({r.query_id for r in rows}) * len({r.term for r in rows}) > CELLS:
        own = q.groupBy("query_id").agg(F.sqrt(F.sum(F.col("q") * F.col("q"))).alias("qn"))
        met = postings.join(small_or_shuffled(q.select("query_id", "term", "q")), "term").withColumn("w", F.expr(rule.doc)).where("w is not null")
        dots = met.groupBy("query_id", "doc_id").agg(F.sum(F.col("w") * F.col("q")).alias("dot"))
        scored = dots.join(norms, "doc_id").join(small_or_shuffled(own), "query_id").where("dn > 0 and qn > 0")
        scored = scored.select("query_id", "doc_id", F.round(F.col("dot") / (F.col("dn") * F.col("qn")), 6).alias("score"))
        return top(scored.where("score > 0") if rule.positive_only else scored, k)
    return top(_best(spark, postings.withColumn("w", F.expr(rule.doc)), norms, rows, q.schema["query_id"], rule.positive_only, k), k)


def _best(spark: SparkSession, postings: DataFrame, norms: DataFrame, asked: list, query_id: T.StructField, positive: bool, k: int) -> DataFrame:
    """``query_id, doc_id, score``: the k best of each query in each partition of documents, by a table of terms and queries.

    postings: (doc_id, term, w), norms: (doc_id, dn), asked: rows (query_id, term, q). Asked postings meet
    their document's norm in one shuffle, as rows of one kind; a document is scored for all queries at once.
    """
    queries, terms = sorted({r.query_id for r in asked}), sorted({r.term for r in asked})
    place, number = {t: i for i, t in enumerate(terms)}, {x: i for i, x in enumerate(queries)}
    weight = np.zeros((len(terms), len(queries)))
    has = np.zeros(weight.shape, bool)
    for r in asked:
        weight[place[r.term], number[r.query_id]] = r.q
        has[place[r.term], number[r.query_id]] = True
    qn = np.sqrt((weight * weight).sum(axis=0))
    known = F.broadcast(spark.createDataFrame(list(place.items()), "term string, ix int"))  # at most BROADCAST_ROWS
    met = postings.select("doc_id", "term", "w").where("w is not null").join(known, "term").select("doc_id", "ix", "w")
    rows = met.unionByName(norms.select("doc_id", F.lit(-1).alias("ix"), F.col("dn").alias("w"))).repartition("doc_id").sortWithinPartitions("doc_id", "ix")
    kind = to_arrow_type(query_id.dataType)

    def best(batches):
        top_scores, top_ids = np.full((0, len(queries)), -np.inf), None
        rest = None

        def add(table):
            """Documents of the rows, whole and in order."""
            nonlocal top_scores, top_ids
            ids, ix, w = table.column(0), table.column(1).to_numpy(), table.column(2).to_numpy()
            starts = np.flatnonzero(_new(ids))
            norm = np.where(ix[starts] < 0, w[starts], 0.0)
            meets = ix >= 0
            use = np.where(meets, ix, 0)
            dots = np.add.reduceat(np.where(meets, w, 0.0)[:, None] * weight[use], starts, axis=0)
            met = np.logical_or.reduceat(has[use] & meets[:, None], starts, axis=0)
            ok = met & (norm[:, None] > 0) & (qn > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                score = dots / (norm[:, None] * qn)
            score = np.sign(score) * np.floor(np.abs(score) * 1e6 + 0.5) / 1e6 + 0.0
            score = np.where(ok & (score > 0) if positive else ok, score, -np.inf)
            own = np.broadcast_to(np.asarray(ids.take(pa.array(starts)).to_pylist(), object)[:, None], score.shape)
            scores = np.vstack([top_scores, score])
            order = np.argsort(-scores, axis=0, kind="stable")[:k]  # ids rise, so ties stay with the smaller one
            top_ids = np.take_along_axis(own if top_ids is None else np.vstack([top_ids, own]), order, axis=0)
            top_scores = np.take_along_axis(scores, order, axis=0)

        for b in batches:
            table = pa.Table.from_batches([b] if rest is None else [*rest.to_batches(), b]).combine_chunks()
            if not table.num_rows:
                continue
            last = int(np.flatnonzero(_new(table.column(0).combine_chunks()))[-1])
            rest = table.slice(last)
            if last:
                add(table.slice(0, last).combine_chunks().to_batches()[0])
        if rest is not None and rest.num_rows:
            add(rest.combine_chunks().to_batches()[0])
        if top_ids is not None:
            i, j = np.nonzero(top_scores > -np.inf)
            found = [pa.array([queries[x] for x in j], kind), pa.array(list(top_ids[i, j]), arrow_id), pa.array(top_scores[i, j])]
            yield pa.RecordBatch.from_arrays(found, ["query_id", "doc_id", "score"])

    arrow_id = to_arrow_type(norms.schema["doc_id"].dataType)
    if not asked:
        rows = rows.limit(0)
    return rows.mapInArrow(best, T.StructType([query_id, norms.schema["doc_id"], T.StructField("score", T.DoubleType())]))


def _new(ids) -> np.ndarray:
    """Which of the sorted ids differ from the one before."""
    out = np.ones(len(ids), bool)
    out[1:] = pc.not_equal(ids.slice(1), ids.slice(0, len(ids) - 1)).to_numpy(zero_copy_only=False)
    return out


def top(scored: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "doc_id", "rank", "score")


def all_terms(tf: DataFrame, queries: DataFrame) -> DataFrame:
    """``query_id, doc_id``: documents with every known term of the query; unknown terms are ignored.

    One join and one count per (query, document): what accumulators, merges and skips all compute.
    """
    met = tf.select("term", "doc_id").join(small_or_shuffled(queries.select("query_id", "term").distinct()), "term")
    per = met.groupBy("query_id", "doc_id").agg(F.count("*").alias("hits"))
    known = met.select("query_id", "term").distinct().groupBy("query_id").agg(F.count("*").alias("need"))
    return per.join(small_or_shuffled(known), "query_id").where("hits = need").select("query_id", "doc_id")


def posting_totals(tf: DataFrame, queries: DataFrame) -> DataFrame:
    """``query_id, n_terms, n_matches, posting_length``: the AND answer's size and the postings read for it."""
    df = term_statistics(tf).select("term", "df")
    lengths = queries.select("query_id", "term").distinct().join(df, "term", "left")
    per = lengths.groupBy("query_id").agg(F.count("*").alias("n_terms"), F.coalesce(F.sum("df"), F.lit(0)).alias("posting_length"))
    hits = all_terms(tf, queries).groupBy("query_id").agg(F.count("*").alias("n_matches"))
    return per.join(hits, "query_id", "left").select("query_id", "n_terms", F.coalesce("n_matches", F.lit(0)).alias("n_matches"), "posting_length")


def vector_cosine(docs: DataFrame, queries: DataFrame, idf: DataFrame) -> DataFrame:
    """Binary vectors over term ids: ``query_id, doc_id, score`` above 0.

    docs: (doc_id, term_id), queries: (query_id, term_id), idf: (term_id, idf).
    """
    d = docs.distinct().join(idf, "term_id")
    q = queries.distinct().join(idf, "term_id").withColumnRenamed("idf", "qidf")
    dn = d.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("idf") * F.col("idf"))).alias("dn"))
    qn = q.groupBy("query_id").agg(F.sqrt(F.sum(F.col("qidf") * F.col("qidf"))).alias("qn"))
    dots = d.join(q, "term_id").groupBy("query_id", "doc_id").agg(F.sum(F.col("idf") * F.col("qidf")).alias("dot"))
    score: Column = F.col("dot") / (F.col("dn") * F.col("qn"))
    out = dots.join(dn, "doc_id").join(qn, "query_id").where("dn > 0 and qn > 0")
    return out.select("query_id", "doc_id", F.round(score, 6).alias("score")).where("score > 0")
