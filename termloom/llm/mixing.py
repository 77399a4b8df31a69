"""Mixing sources to target weights by systematic sampling.

Within a source every document expects target / source_size copies (at most 3). Documents are ordered by
size, the expected copies are prefix-summed along that order from one offset a source, and a document is
taken once for each integer boundary that its stretch of the sum crosses. Along sizes, the words taken
come near the target.

The order's positions come from counts by (source, size class, hash bucket) and row numbers within such a
bucket, so no task holds a whole source. Offsets and buckets are digests, so reruns agree.

Defined cases: null text has size 0; the null source is a source of its own, last in the order; an empty
source, or one whose documents are all empty, takes nothing; equal rows are told apart only by
their position, so a rerun takes the same multiset; extra columns of any name are kept by ``take`` and
ignored elsewhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, small_or_shuffled

WEIGHTS = (1, 2, 3)
MOST_COPIES = 3
BUCKETS = 64
WORD = r"[^\x20\x09-\x0D]+"


def sized(docs: DataFrame) -> DataFrame:
    """Adds ``size``: the number of words of the text."""
    words = F.regexp_count(F.col("text").cast("string"), F.lit(WORD))
    return docs.withColumn("size", F.coalesce(words, F.lit(0)).cast("long"))


def targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """``source, source_size, target`` by source, from rows of (source, size).

    Filling by weight up to the caps ``most * source_size`` needs no rounds: sources sorted by cap over
    weight fill up first, and the level that spends the total is that of the first source it leaves below
    its cap. The windows run over one row a source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn))
    per = per.withColumn("cap", F.col("source_size") * float(most))
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    full = F.coalesce(F.sum("cap").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    per = per.withColumn("level", (F.sum("source_size").over(Window.partitionBy()) - full) / left)
    below = F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.col("level"))
    everything = by_cap.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = F.coalesce(F.first(below, ignorenulls=True).over(everything), F.lit(0.0))
    return per.select("source", "source_size", F.least(F.col("cap"), level * F.col("weight")).alias("target"))


def _digest(column, digits: int):
    return F.conv(F.substring(F.md5(column.cast("string").cast("binary")), 1, digits), 16, 10).cast("long")


def _source_key(source="source"):
    return F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit(""))


def _placed(docs: DataFrame, weights, most: int) -> DataFrame:
    """``doc_id, src, size, same, first, rate, offset, source_size, target``, a row for alike rows of (doc_id, source, size).

    ``docs`` has a column ``n``: how many rows a row stands for.
    """
    digits = F.col("size").cast("string")
    # Repeats of one (source, size, id) are one row with a count, so no bucket gathers them.
    rows = (
        docs.groupBy("source", "size", "doc_id")
        .agg(F.sum("n").alias("same"))
        .withColumn("src", _source_key())
        .withColumn("class", (F.length(digits) * 100 + F.substring(digits, 1, 2).cast("int")).cast("int"))
        .withColumn("bucket", (_digest(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), 8) % BUCKETS).cast("int"))
    )
    rows = materialise(rows, "mix-rows")
    key = ["src", "class", "bucket"]
    # at most classes x buckets rows a source
    along = Window.partitionBy("src").orderBy("class", "bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy(*key).agg(F.sum("same").alias("n")).withColumn("start", F.coalesce(F.sum("n").over(along), F.lit(0))).drop("n")
    per = targets(rows.select("source", (F.col("size") * F.col("same")).alias("size")), weights, most)
    per = materialise(per.select(_source_key().alias("src"), "source_size", "target"), "mix-targets")
    within = Window.partitionBy(*key).orderBy("size", F.col("doc_id").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    first = F.col("start") + F.coalesce(F.sum("same").over(within), F.lit(0))
    placed = rows.join(starts, key).withColumn("first", first).join(small_or_shuffled(per), "src")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    offset = _digest(F.concat(F.lit("offset"), "src"), 13) / float(16**13)
    return placed.select("doc_id", "src", "size", "same", "first", rate.alias("rate"), offset.alias("offset"), "source_size", "target")


def _copies(i, most: int):
    """Copies of the i-th of alike rows: the integer boundaries that its stretch of the sum crosses."""
    upto = lambda n: F.floor(n * F.col("rate") + F.col("offset"))
    at = F.col("first") + i
    return F.least(upto(at + 1) - upto(at), F.lit(most).cast("long"))


def copies(docs: DataFrame, weights=WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """``doc_id, src, i, size, source_size, target, copies`` of every row of (doc_id, source, size).

    ``i`` counts the rows that are alike in all three.
    """
    every = _placed(docs.withColumn("n", F.lit(1).cast("long")), weights, most).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("same") - 1)))
    return every.select("doc_id", "src", "i", "size", "source_size", "target", _copies(F.col("i"), most).alias("copies"))


def take(docs: DataFrame, weights=WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """The mix itself: every row as many times as it is taken, with its own columns.

    Rows alike in source, size and id are numbered by their texts' digests, split by these into ``BUCKETS``
    parts, so whole rows are shuffled once, by key and part.
    """
    count = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    part = F.pmod(F.xxhash64(text), F.lit(BUCKETS)).cast("int").alias("part")
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id")
    key = ["src", "size", "id", "null"]
    parts = docs.select("doc_id", F.col("source").cast("string").alias("source"), count.alias("size"), part)
    parts = materialise(parts.groupBy("doc_id", "source", "size", "part").agg(F.count("*").alias("n")), "mix-parts")
    placed = _placed(parts, weights, most).select("src", "size", name, F.col("doc_id").isNull().alias("null"), "first", "rate", "offset")
    along = Window.partitionBy(*key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a key's few parts
    parts = parts.select(_source_key().alias("src"), "size", name, F.col("doc_id").isNull().alias("null"), "part", "n")
    parts = parts.withColumn("start", F.coalesce(F.sum("n").over(along), F.lit(0))).drop("n")
    placed = materialise(parts.join(placed, key), "mix-places")
    rows = docs.select(F.struct("*").alias("row"), _source_key().alias("src"), count.alias("size"), name, F.col("doc_id").isNull().alias("null"), part)
    number = F.row_number().over(Window.partitionBy(*key, "part").orderBy(F.md5(F.coalesce(F.col("row.text").cast("string"), F.lit(""))))) - 1
    out = rows.join(placed, [*key, "part"]).withColumn("i", F.col("start") + number)
    times = _copies(F.col("i"), most)
    return out.where(times > 0).select("row", F.explode(F.sequence(F.lit(1).cast("long"), times))).select("row.*")


def mix(docs: DataFrame, weights=WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` of every row."""
    out = copies(sized(docs.select("doc_id", F.col("source").cast("string").alias("source"), "text")), weights, most)
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS weight
  FROM d GROUP BY source
), c AS (
  SELECT *, 3.0::DOUBLE * source_size AS cap FROM s
), l AS (
  SELECT *,
    (sum(CAST(source_size AS DOUBLE)) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM c
), f AS (
  SELECT coalesce(arg_min(level, cap / weight), 0) AS level FROM l WHERE level <= cap / weight
), t AS (
  SELECT source, source_size, least(cap, f.level * weight) AS target,
    CASE WHEN source_size > 0 THEN least(cap, f.level * weight) / source_size ELSE 0 END AS rate,
    CAST(('0x' || substr(md5('offset' || coalesce('=' || source, '')), 1, 13)) AS BIGINT) / pow(16, 13) AS shift
  FROM l, f
), p AS (
  SELECT doc_id, source, size, row_number() OVER (PARTITION BY source ORDER BY
      length(CAST(size AS VARCHAR)) * 100 + CAST(substr(CAST(size AS VARCHAR), 1, 2) AS INT),
      CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8)) AS BIGINT) % 64,
      size, doc_id NULLS FIRST) - 1 AS pos
  FROM d
)
SELECT p.doc_id, p.size, t.source_size, t.target,
  CAST(p.size * least(3, floor((pos + 1) * rate + shift) - floor(pos * rate + shift)) AS BIGINT) AS taken
FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source
"""
