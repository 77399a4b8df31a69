"""Inverted indexes as tables: postings, vocabulary, positions, norms, gaps, skips and codes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import compress
from ..plans.common import small_or_shuffled, written

BLOCK_IDS = 1 << 18
#: Postings of an Arrow batch that decoding hands back; a longer list goes alone.
DECODED = 200_000


def inverted_index(tf: DataFrame) -> DataFrame:
    """``term, cf, df, postings array<struct<doc_id,tf>>`` sorted by document."""
    return tf.groupBy("term").agg(
        F.sum("tf").alias("cf"), F.count("*").alias("df"), F.array_sort(F.collect_list(F.struct("doc_id", "tf"))).alias("postings")
    )


def positional_index(tokens: DataFrame) -> DataFrame:
    """``term, doc_id, tf, positions``; positions (from 0) count kept tokens only."""
    order = Window.partitionBy("doc_id").orderBy("pos")
    kept = tokens.where("term is not null and pos is not null").withColumn("at", F.row_number().over(order) - 1)
    return kept.groupBy("term", "doc_id").agg(F.count("*").alias("tf"), F.array_sort(F.collect_list("at")).alias("positions"))


def doc_norms(weighted: DataFrame) -> DataFrame:
    """``doc_id, norm``: Euclidean length of (doc_id, term, w)."""
    return weighted.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))


def placed(tf: DataFrame, ids: int = BLOCK_IDS) -> DataFrame:
    """Adds ``block, idx, before, df``: a posting's place (from 1), the document before it (null: none), the term's postings.

    A list is worked on in blocks of ``ids`` document numbers, so no task sorts the whole list of a common
    term; counts and last documents are carried over the list's blocks.
    """
    blocked = tf.withColumn("block", F.floor(F.col("doc_id") / ids))
    along = Window.partitionBy("term").orderBy("block")
    per = blocked.groupBy("term", "block").agg(F.count("*").alias("n"), F.max("doc_id").alias("last"))
    start = F.coalesce(F.sum("n").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per = per.select("term", "block", start.alias("start"), F.lag("last").over(along).alias("carried"), F.sum("n").over(Window.partitionBy("term")).alias("df"))
    within = Window.partitionBy("term", "block").orderBy("doc_id")
    out = blocked.withColumn("idx", F.row_number().over(within)).withColumn("before", F.lag("doc_id").over(within)).join(per, ["term", "block"])
    out = out.withColumn("idx", (F.col("idx") + F.col("start")).cast("long")).withColumn("before", F.coalesce("before", "carried"))
    return out.drop("start", "carried")


def gaps(tf: DataFrame) -> DataFrame:
    """``term, doc_id, tf, gap``: the first document as it is, then differences."""
    return placed(tf).withColumn("gap", F.col("doc_id") - F.coalesce("before", F.lit(0))).select(*tf.columns, "gap")


def skips(tf: DataFrame, include_first: bool = True) -> DataFrame:
    """``term, doc_id, idx``: every ceil(sqrt(df))-th posting with its place from 1.

    With ``include_first`` a term of one document has an entry; without, counting starts at the second.
    """
    step = F.ceil(F.sqrt("df")).cast("long")
    every = placed(tf.select("term", "doc_id")).withColumn("step", step)
    hit = F.col("idx") % F.col("step") == 0 if include_first else (F.col("idx") > 1) & ((F.col("idx") - 1) % F.col("step") == 0)
    return every.where(hit).select("term", "doc_id", "idx")


def code_sizes(tf: DataFrame) -> DataFrame:
    """``term, df, raw_vb, raw_gamma, gap_vb, gap_gamma``: bytes of the interleaved (document, tf) codes.

    Gamma codes need positive numbers, so documents are coded as id + 1.
    """
    g = gaps(tf.withColumn("doc_id", F.col("doc_id") + 1))
    bits = lambda c: F.sum(compress.gamma_bits(c) + compress.gamma_bits("tf"))
    vb = lambda c: F.sum(compress.vb_bytes(c) + compress.vb_bytes("tf"))
    return g.groupBy("term").agg(
        F.count("*").alias("df"),
        vb("doc_id").alias("raw_vb"),
        F.ceil(bits("doc_id") / 8).alias("raw_gamma"),
        vb("gap").alias("gap_vb"),
        F.ceil(bits("gap") / 8).alias("gap_gamma"),
    )


def compressed_index(tf: DataFrame, method: str = "gamma", gapped: bool = True, ids: int = BLOCK_IDS) -> DataFrame:
    """``term, block, n, base, data, padding``: the codes of doc_id + 1 (or its gaps) and tf, interleaved.

    A row holds a term's postings of one block of document numbers; ``base`` is the number before its first.
    """
    own = tf.select("term", (F.col("doc_id") + 1).alias("doc_id"), "tf").repartition("term").withColumn("block", F.floor(F.col("doc_id") / ids))
    lists = own.groupBy("term", "block").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("doc_id", "tf"))).alias("rows"))
    last = F.element_at("rows", -1)["doc_id"]
    lists = lists.withColumn("base", F.coalesce(F.lag(last).over(Window.partitionBy("term").orderBy("block")), F.lit(0)))
    before = lambda i: F.coalesce(F.get("rows", i - 1)["doc_id"], F.col("base"))
    flat = F.flatten(F.transform("rows", lambda r, i: F.array(r["doc_id"] - before(i) if gapped else r["doc_id"], r["tf"])))
    kept = ["term", "block", "n", "base"]
    if method == "gamma":
        return lists.select(*kept, compress.gamma(flat).alias("c")).select(*kept, "c.*")
    if method == "vb":
        return lists.select(*kept, compress.vb(flat).alias("data"), F.lit(0).alias("padding"))
    raise ValueError(f"unknown method {method}")


def decompressed(index: DataFrame, method: str = "gamma", gapped: bool = True) -> DataFrame:
    """``term, doc_id, tf`` of a compressed index."""

    def run(batches):
        for b in batches:
            rows = zip(b.column("data").to_pylist(), b.column("padding").to_pylist())
            lists = [compress.gamma_decode(d, p) if method == "gamma" else compress.vb_decode(d) for d, p in rows]
            at = 0
            while at < len(lists):  # long lists go out by themselves
                end, size = at + 1, len(lists[at])
                while end < len(lists) and size + len(lists[end]) <= 2 * DECODED:
                    size += len(lists[end])
                    end += 1
                docs = []
                for numbers, base in zip(lists[at:end], b.column("base").slice(at, end - at).to_pylist()):
                    n = np.array(numbers[::2], np.int64)
                    docs.append((np.cumsum(n) + base if gapped else n) - 1)
                terms = b.column("term").take(pa.array(np.repeat(np.arange(at, end), list(map(len, docs)))))
                tfs = np.array([x for numbers in lists[at:end] for x in numbers[1::2]], np.int64)
                yield pa.RecordBatch.from_arrays([terms, pa.array(np.concatenate(docs)), pa.array(tfs)], ["term", "doc_id", "tf"])
                at = end

    return index.select("term", "base", "data", F.col("padding").cast("int").alias("padding")).mapInArrow(run, "term string, doc_id long, tf long")


def write_index(tf: DataFrame, path: str, tokens: DataFrame | None = None, partitions: int | None = None, terms: bool = True) -> None:
    """Store ``terms``, ``postings`` and ``totals`` (and ``positions``), postings sorted by (term, doc_id) in each file.

    One shuffle by term, of which a document has one row at most; Parquet statistics then find a term's few
    pages. A posting carries its term's ``cf`` and ``df``, so weights need no join. Without ``terms``, those and
    the totals that are there stay, as tables over them may not have been read yet.
    """
    own = tf.select("doc_id", "term", "tf")
    by_term = own.repartition(partitions, "term") if partitions else own.repartition("term")
    whole = Window.partitionBy("term")
    sums = by_term.sortWithinPartitions("term", "doc_id").withColumns({"cf": F.sum("tf").over(whole), "df": F.count("*").over(whole)})
    sums.write.mode("overwrite").parquet(f"{path}/postings")
    if terms:
        postings = tf.sparkSession.read.parquet(f"{path}/postings")
        known = postings.groupBy("term").agg(F.first("cf").alias("cf"), F.first("df").alias("df"))
        known.sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/terms")
        _write_totals(tf.sparkSession, path, distinct_ids(postings))
    if tokens is not None:
        write_positions(tokens, path)


def _write_totals(spark: SparkSession, path: str, docs: DataFrame) -> None:
    """docs: one row ``n``."""
    docs.crossJoin(read_terms(spark, path).agg(F.count("*").alias("v"))).write.mode("overwrite").parquet(f"{path}/totals")  # one row each


def write_terms(words: DataFrame, path: str) -> None:
    """Store ``terms`` and ``totals`` alone, from ``within.vocabulary``."""
    known = written(words, "vocabulary")
    known.where("term is not null").repartition("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/terms")
    _write_totals(words.sparkSession, path, known.where("term is null").agg(F.coalesce(F.sum("df"), F.lit(0)).alias("n")))


def distinct_ids(postings: DataFrame) -> DataFrame:
    """One row ``n``: how many documents. Dense ids are counted in bitmaps, which shuffle a bit an id and task."""
    low, high, rows = postings.agg(F.min("doc_id"), F.max("doc_id"), F.count("*")).first()
    if not isinstance(low, int) or high - low > 64 * rows:
        return postings.select("doc_id").distinct().agg(F.count("*").alias("n"))
    at = F.col("doc_id") - low
    bits = postings.select(F.bitmap_bucket_number(at).alias("bucket"), F.bitmap_bit_position(at).alias("bit")).groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))
    return bits.agg(F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0)).alias("n"))


def write_positions(tokens: DataFrame, path: str) -> None:
    write_places(positional_index(tokens), path)


def write_places(places: DataFrame, path: str) -> None:
    """Store ``positions`` of (term, doc_id, tf, positions): one shuffle by term."""
    places.repartition("term").sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(f"{path}/positions")


def write_runs(places: DataFrame, path: str) -> None:
    """Store ``positions`` as ``within.positions`` leaves them: runs sorted by term, so nothing is shuffled.

    A run holds many documents, and Parquet's page statistics find a term's few pages in each.
    """
    places.write.mode("overwrite").parquet(f"{path}/positions")


def write_norms(spark: SparkSession, path: str, weights: dict[str, str]) -> None:
    """Store ``norms``: ``doc_id`` and a column a scheme, the length of the document's weights (SQL over n, v, tf, df, cf).

    For an index as ``write_index`` leaves it. Postings are shuffled by document before they are summed up:
    in a file of terms no two are of one document, so sums made there would only be wider.
    """
    n, v = totals(spark, path)
    found = spark.read.parquet(f"{path}/postings").select("doc_id", "tf", "cf", "df").repartition("doc_id").withColumns({"n": F.lit(n), "v": F.lit(v)})
    length = lambda w: F.sqrt(F.sum(F.expr(w) * F.expr(w)))
    norms = found.groupBy("doc_id").agg(*[length(w).alias(name) for name, w in weights.items()])
    norms.write.mode("overwrite").parquet(f"{path}/norms")


def totals(spark: SparkSession, path: str) -> tuple[float, float]:
    """Documents with terms, and terms, of a stored index."""
    n, v = spark.read.parquet(f"{path}/totals").first()
    return float(n), float(v)


def write_skips(tf: DataFrame, path: str) -> None:
    """Store the skip entries beside the postings, sorted by (term, doc_id)."""
    skips(tf).repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(f"{path}/skips")


def skip_intersection(spark: SparkSession, path: str, first: str, second: str) -> DataFrame:
    """``doc_id`` of documents with both terms, by the longer list's skips.

    A skip entry closes a block of the longer list. Each document of the shorter list falls into one block;
    only blocks that some document falls into are read on.
    """
    df = {r.term: r.df for r in read_terms(spark, path).where(F.col("term").isin(first, second)).collect()}
    if len(df) < len({first, second}):
        return spark.read.parquet(f"{path}/postings").select("doc_id").limit(0)
    short, long = sorted({first, second}, key=lambda t: (df[t], t))[0], sorted({first, second}, key=lambda t: (df[t], t))[-1]
    ends = posting(spark, path, long, "skips").select(F.col("doc_id").alias("end"))
    # Blocks in order: those that begin after their predecessor's end; the last is open.
    order = Window.orderBy("end")  # the square root of one list's length
    blocks = ends.select(F.coalesce(F.lag("end").over(order) + 1, F.lit(-(1 << 62))).alias("begin"), "end")
    last = ends.agg((F.coalesce(F.max("end"), F.lit(-(1 << 62) - 1)) + 1).alias("begin")).select("begin", F.lit(1 << 62).alias("end"))
    blocks = small_or_shuffled(blocks.union(last))
    mine = posting(spark, path, short).select("doc_id").join(blocks, F.col("doc_id").between(F.col("begin"), F.col("end")))
    hit = mine.select("begin", "end").distinct()
    theirs = posting(spark, path, long).select(F.col("doc_id").alias("other")).join(small_or_shuffled(hit), F.col("other").between(F.col("begin"), F.col("end")))
    return mine.join(theirs.select(F.col("other").alias("doc_id")), "doc_id").select("doc_id")


def write_compressed(tf: DataFrame, path: str, method: str = "gamma", gapped: bool = True) -> None:
    """Store a compressed index: a row of codes a term and block, sorted by term."""
    compressed_index(tf, method, gapped).repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/codes")


def read_compressed(spark: SparkSession, path: str, method: str = "gamma", gapped: bool = True) -> DataFrame:
    """``term, doc_id, tf`` of a stored compressed index."""
    return decompressed(spark.read.parquet(f"{path}/codes"), method, gapped)


def append_block(tf: DataFrame, path: str) -> None:
    """Add a block of new documents to the stored postings; ``merge_blocks`` compacts."""
    tf.repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id").write.mode("append").parquet(f"{path}/postings")


def merge_blocks(spark: SparkSession, path: str, into: str) -> None:
    """Merge all appended blocks into one sorted index in a new folder."""
    write_index(spark.read.parquet(f"{path}/postings"), into)


def read_terms(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/terms")


def posting(spark: SparkSession, path: str, term: str, kind: str = "postings") -> DataFrame:
    """One term's rows; the filter reaches the Parquet scan. Unknown terms give none."""
    return spark.read.parquet(f"{path}/{kind}").where(F.col("term") == term)
