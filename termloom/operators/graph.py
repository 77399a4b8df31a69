"""Links, bounded crawls over stored pages, link graphs, PageRank and HITS."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..plans.common import numbered, small_or_shuffled, written

#: Edges that one task may hold as pairs of numbers of 4 bytes.
EDGES = 20_000_000


def links(pages: DataFrame, resolve: bool = False, repeats: bool = True) -> DataFrame:
    """``page_id, src, dst``: link targets of each page, the fragment cut off.

    By default a relative link is the page's URL with the link appended; ``resolve`` keeps it within the
    host instead.
    """
    raw = pages.select("page_id", "url", F.explode(X.hrefs(F.col("html"))).alias("href"))
    target = X.resolved_target("url", "href") if resolve else X.link_target("url", "href")
    out = raw.select("page_id", F.col("url").alias("src"), target.alias("dst"))
    return out if repeats else out.distinct()


def url_table(pages: DataFrame) -> DataFrame:
    """``page_id, url, protocol, host, path, l_slashes, p_depth, dynamic``."""
    p = X.url_parts("url")
    return pages.select("page_id", "url", p.alias("p")).select(
        "page_id", "url", "p.*", X.slashes(F.col("p.path")).cast("long").alias("path_slashes"), X.slashes("url").cast("long").alias("p_depth"), X.is_dynamic("url").alias("dynamic")
    )


def depth_histogram(pages: DataFrame, column: str = "p_depth") -> DataFrame:
    """``depth, static, dynamic`` for every depth from 0 to the greatest, zero where there is none."""
    counts = pages.groupBy(column).pivot("dynamic", [False, True]).agg(F.count(F.lit(1))).toDF("depth", "static", "dynamic")
    last = pages.agg(F.max(column).alias("last"))
    every = last.select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("last").cast("long"))).alias("depth"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return every.join(counts, "depth", "left").select("depth", zero("static"), zero("dynamic"))


def dynamic_share(pages: DataFrame) -> DataFrame:
    return pages.groupBy("dynamic").agg(F.count("*").alias("pages"))


def per_site(pages: DataFrame, most: int) -> DataFrame:
    """The first pages of each host by id."""
    order = Window.partitionBy("host").orderBy("page_id")
    return pages.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).drop("place")


def edges(linked: DataFrame) -> DataFrame:
    """Distinct ``src, dst``."""
    return linked.select("src", "dst").distinct()


def nodes(e: DataFrame) -> DataFrame:
    return e.select(F.col("src").alias("id")).union(e.select("dst")).distinct()


def crawl(
    pages: DataFrame, seeds: DataFrame, max_depth: int = 3, per_host: int = 30, limit: int = 500, max_path: int = 3, host: str | None = None, resolve: bool = True
) -> DataFrame:
    """``id, url, depth, found``: breadth-first from the seeds over stored pages, one join a level.

    A level's new links are admitted in the order of the page that found them, then of their URL, while
    their host's and the total budget last; seeds come first. Links whose path is too deep, or of
    another host than ``host``, are left out. ``found``: whether the page itself is stored.
    """
    hosts = lambda c: F.regexp_extract(c, "^[A-Za-z]+://([^/?#]+)", 1)
    clean = lambda c: F.substring_index(c, "#", 1)
    stored = pages.select(clean("url").alias("url"), "html", "page_id").withColumn("nth", F.row_number().over(Window.partitionBy("url").orderBy("page_id")))
    stored = stored.where("nth = 1").select("url", "html", "page_id")
    out = links(stored, resolve).select(F.col("src"), F.col("dst")).where(F.coalesce(X.slashes(X.url_parts("dst")["path"]), F.lit(0)) <= max_path)
    out = written(out.distinct() if host is None else out.where(hosts("dst") == host).distinct(), "crawl-links")
    level = seeds.select(clean("url").alias("url")).distinct().withColumn("host", hosts("url"))
    order = Window.partitionBy("host").orderBy("url")
    level = level.withColumn("place", F.row_number().over(order)).where(F.col("place") <= per_host)
    level = numbered(level.select("url", "host"), F.col("url")).where(F.col("row") <= limit)
    done = written(level.select(F.col("row").alias("id"), "url", "host", F.lit(0).alias("depth")), "crawl-level")
    frontier = done
    for depth in range(1, max_depth + 1):
        new = (
            frontier.join(out, frontier["url"] == out["src"])
            .groupBy(F.col("dst").alias("url"))
            .agg(F.min("id").alias("by"))
            .join(done.select("url"), "url", "left_anti")
            .withColumn("host", hosts("url"))
        )
        used = done.groupBy("host").agg(F.count("*").alias("used"))
        place = F.row_number().over(Window.partitionBy("host").orderBy("by", "url"))
        new = new.join(small_or_shuffled(used), "host", "left").withColumn("place", place + F.coalesce("used", F.lit(0))).where(F.col("place") <= per_host)
        taken = done.count()
        new = numbered(new.select("url", "host", "by"), F.col("by"), F.col("url")).where(F.col("row") <= limit - taken)
        frontier = written(new.select((F.col("row") + taken).alias("id"), "url", "host", F.lit(depth).alias("depth")), "crawl-level")
        if frontier.isEmpty():
            break
        done = done.union(frontier)
    known = stored.select("url", F.lit(True).alias("found"))
    return done.join(known, "url", "left").select("id", "url", "depth", F.coalesce("found", F.lit(False)).alias("found"))


def pagerank(e: DataFrame, steps: int = 100, alpha: float = 0.8, write_every: int = 5, tolerance: float = 1e-12) -> DataFrame:
    """``id, score``: uniform start and teleport, dangling mass spread evenly.

    It ends after ``steps``, or earlier once the scores changed by less than ``tolerance`` in all from one
    written step to the next.
    Out-degrees are part of the edge table, so a step is one join and one aggregation; hubs are combined
    before the shuffle.
    """
    degree = e.groupBy("src").agg(F.count("*").alias("out"))
    wired = written(e.join(degree, "src"), "pagerank-edges")
    ids = written(nodes(e).join(degree.withColumnRenamed("src", "id"), "id", "left"), "pagerank-nodes")
    n = ids.count()
    if not n:
        return ids.select("id", F.lit(0.0).alias("score"))
    ranks, known = ids.withColumn("score", F.lit(1.0 / n)), None
    for step in range(1, steps + 1):
        dangling = ranks.agg(F.coalesce(F.sum(F.when(F.col("out").isNull(), F.col("score"))), F.lit(0.0)).alias("lost"))  # one row
        got = wired.join(ranks.select(F.col("id").alias("src"), "score"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("score") / F.col("out")).alias("got"))
        score = (1 - alpha) / n + alpha * (F.coalesce("got", F.lit(0.0)) + F.col("lost") / n)
        ranks = ids.join(got, "id", "left").crossJoin(F.broadcast(dangling)).select("id", "out", score.alias("score"))
        if step % write_every == 0 and step < steps:
            last, known = known, written(ranks, "pagerank")
            ranks = known
            if last is not None:
                both = ranks.join(last.select("id", F.col("score").alias("before")), "id")
                if both.agg(F.sum(F.abs(F.col("score") - F.col("before")))).first()[0] < tolerance:
                    break
    return ranks.select("id", "score")


def hits(e: DataFrame, steps: int = 10, write_every: int = 3, tolerance: float = 0.0) -> DataFrame:
    """``id, hub, authority``, each normalised to sum 1, from equal hubs.

    It ends after ``steps``, or earlier once the hubs changed by less than ``tolerance`` in all from one
    written step to the next. Up to EDGES edges, as numbers, one task takes all steps; beyond it each step is joined.
    """
    e = written(e, "hits-edges")
    ids = written(nodes(e), "hits-nodes")
    n = ids.count()
    if not n:
        return ids.select("id", F.lit(0.0).alias("hub"), F.lit(0.0).alias("authority"))
    if e.count() <= EDGES:
        return _hits_in_one_task(e, ids, n, steps, write_every, tolerance)
    scores = ids.withColumn("hub", F.lit(1.0 / n))
    authority, known = None, None

    def normal(df: DataFrame, name: str) -> DataFrame:
        total = df.agg(F.sum(name).alias("total"))  # one row
        return df.crossJoin(F.broadcast(total)).select("id", (F.col(name) / F.col("total")).alias(name))

    for step in range(1, steps + 1):
        a = e.join(scores.select(F.col("id").alias("src"), "hub"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum("hub").alias("authority"))
        authority = normal(a, "authority")
        h = e.join(authority.select(F.col("id").alias("dst"), "authority"), "dst").groupBy(F.col("src").alias("id")).agg(F.sum("authority").alias("hub"))
        scores = normal(h, "hub")
        if step % write_every == 0 and step < steps:
            last, scores = known, written(scores, "hits")
            known = scores
            if tolerance and last is not None:
                both = scores.join(last.withColumnRenamed("hub", "before"), "id", "full")
                change = both.agg(F.sum(F.abs(F.coalesce("hub", F.lit(0.0)) - F.coalesce("before", F.lit(0.0))))).first()[0]
                if change < tolerance:
                    break
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    return ids.join(scores, "id", "left").join(authority, "id", "left").select("id", zero("hub"), zero("authority"))


def _hits_in_one_task(e: DataFrame, ids: DataFrame, n: int, steps: int, write_every: int, tolerance: float) -> DataFrame:
    """``hits`` over numbered nodes: two arrays of edges and three of nodes are held."""
    named = written(numbered(ids, F.col("id")), "hits-numbers")
    place = lambda c: named.select(F.col("id").alias(c), (F.col("row") - 1).cast("int").alias(f"{c}_at"))
    wired = e.join(place("src"), "src").join(place("dst"), "dst").select("src_at", "dst_at")

    def run(batches):
        parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        src, dst = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
        hub, authority, known = np.full(n, 1.0 / n), np.zeros(n), None
        for step in range(1, steps + 1):
            authority = np.bincount(dst, hub[src], n)
            authority /= authority.sum()
            hub = np.bincount(src, authority[dst], n)
            hub /= hub.sum()
            if step % write_every == 0 and step < steps:
                if tolerance and known is not None and np.abs(hub - known).sum() < tolerance:
                    break
                known = hub
        for at in range(0, n, 100_000):
            end = min(n, at + 100_000)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(at + 1, end + 1)), pa.array(hub[at:end]), pa.array(authority[at:end])], ["row", "hub", "authority"])

    scores = wired.repartition(1).mapInArrow(run, "row long, hub double, authority double")
    return named.join(scores, "row").select("id", "hub", "authority")


def overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """``i, overlap``: the share of n items that the first i of both orders have in common, i from 0 to n - 1.

    a and b: (id, row) with rows from 1. An item is common from the larger of its two rows on.
    """
    met = a.select("id", F.col("row").alias("ra")).join(b.select("id", F.col("row").alias("rb")), "id")
    at = met.groupBy(F.greatest("ra", "rb").alias("i")).agg(F.count("*").alias("n"))
    every = a.select((F.col("row") - 1).alias("i")).join(at, "i", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    size = a.agg(F.count("*").alias("size"))
    from ..plans.common import running_sums

    return running_sums(every, "i", {"n": "met"}).crossJoin(F.broadcast(size)).select("i", F.round(F.col("met") / F.col("size"), 6).alias("overlap"))
