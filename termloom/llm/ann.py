"""Approximate nearest neighbours by inner product: a navigable small-world graph hierarchy per shard.

Vectors are dealt by a hash to shards of bounded rows and bytes. Each shard's graph is built by one task and kept as
one row of flat arrays (vectors, neighbour table of each layer) in the shared folder. All queries meet
every shard, streamed against its graph in blocks, and the shards' best are merged.

Within a shard equal vectors are one node that lists its ids, so copies cost no links and lose no answer.
Inner products become distances by one more coordinate, sqrt(max norm^2 - norm^2), which queries leave 0.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components take no part, nor
do rows without an id; a product beyond the range of doubles scores plus or minus infinity, one that has no
value (infinity less infinity) minus infinity; a row given twice counts once; vectors meet only those of their own length; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

K = 20
SHARD_ROWS = 8192
SHARD_BYTES = 64 << 20
MIN_SHARDS = 8
LINKS = 16
EF_BUILD = 96
EF_SEARCH = 256
BLOCK = 192
EXPAND = 4


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id long, v array<double>`` of the rows that take part."""
    v = F.col("embedding").cast("array<double>")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(
        F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~bad & F.exists("v", lambda x: x != 0)
    )


class Graph:
    """Layers of neighbour tables over the rows of ``x``; ``layers[0]`` holds every row."""

    def __init__(self, x: np.ndarray, layers: list[np.ndarray], nodes: list[np.ndarray], entry: int):
        self.x, self.layers, self.nodes, self.entry = x, layers, nodes, entry

    def beam(self, q: np.ndarray, entry: np.ndarray, ef: int, links: np.ndarray):
        """Best-first search of all queries in step; ``(ids, similarities)`` from the best on, -1: none."""
        b = len(q)
        seen = np.zeros((b, len(self.x)), np.uint8)
        ids = np.full((b, ef), -1, np.int64)
        sims = np.full((b, ef), -np.inf, np.float32)
        done = np.ones((b, ef), bool)
        ids[:, 0] = entry
        sims[:, 0] = np.einsum("bd,bd->b", q, self.x[entry])
        done[:, 0] = False
        seen[np.arange(b), entry] = 1
        live = np.arange(b)
        while len(live):
            open_sims = np.where(done[live], -np.inf, sims[live])
            pick = np.argsort(-open_sims, axis=1, kind="stable")[:, :EXPAND]
            ok = np.take_along_axis(open_sims, pick, 1) > -np.inf
            keep = ok.any(1)
            live, pick, ok = live[keep], pick[keep], ok[keep]
            if not len(live):
                break
            rows = live[:, None]
            source = np.where(ok, ids[rows, pick], -1)
            done[np.broadcast_to(rows, pick.shape)[ok], pick[ok]] = True
            near = np.where(source[:, :, None] >= 0, links[source], -1).reshape(len(live), -1)
            fresh = (near >= 0) & (seen[rows, near] == 0)
            column = (np.arange(near.shape[1]) % 255 + 1).astype(np.uint8)[None, :]
            r, c = np.nonzero(fresh)
            seen[live[r], near[r, c]] = column[0, c]
            fresh[r, c] = seen[live[r], near[r, c]] == column[0, c]
            s = np.full(near.shape, -np.inf, np.float32)
            r, c = np.nonzero(fresh)
            s[r, c] = np.einsum("bd,bd->b", q[live[r]], self.x[near[r, c]])
            all_sims = np.concatenate([sims[live], s], 1)
            order = np.argsort(-all_sims, axis=1, kind="stable")[:, :ef]
            sims[live] = np.take_along_axis(all_sims, order, 1)
            ids[live] = np.take_along_axis(np.concatenate([ids[live], np.where(fresh, near, -1)], 1), order, 1)
            done[live] = np.take_along_axis(np.concatenate([done[live], ~fresh], 1), order, 1)
        return ids, sims

    def descend(self, q: np.ndarray, to: int) -> np.ndarray:
        """The nearest node found in the layers above ``to``."""
        at = np.full(len(q), self.entry)
        for layer in range(len(self.layers) - 1, to, -1):
            at = self.beam(q, at, 8, self.layers[layer])[0][:, 0]
        return at

    def search(self, q: np.ndarray, ef: int):
        return self.beam(q, self.descend(q, 0), ef, self.layers[0])


def _select(x: np.ndarray, ids: np.ndarray, sims: np.ndarray, most: int, fill: bool) -> np.ndarray:
    """Of candidates sorted by similarity, those nearer to the base than to any one chosen before."""
    b, c = ids.shape
    xs = x[np.maximum(ids, 0)]
    between = np.einsum("bid,bjd->bij", xs, xs)
    worst = np.full((b, c), -np.inf, np.float32)
    chosen = np.zeros((b, c), bool)
    n = np.zeros(b, int)
    for k in range(c):
        take = (ids[:, k] >= 0) & (worst[:, k] < sims[:, k]) & (n < most)
        chosen[:, k] = take
        n += take
        worst[take] = np.maximum(worst[take], between[take, k])
    rank = np.where(chosen, 0, np.where((ids >= 0) & fill, 1, 2))
    order = np.argsort(rank, axis=1, kind="stable")[:, :most]
    out = np.where(np.take_along_axis(rank, order, 1) < 2, np.take_along_axis(ids, order, 1), -1)
    return np.pad(out, ((0, 0), (0, max(0, most - c))), constant_values=-1)


def build(x: np.ndarray, links: int = LINKS, ef: int = EF_BUILD) -> Graph:
    """Insert rows in batches of at most the number already in, layer by layer from the top."""
    n = len(x)
    rng = np.random.default_rng(5)
    level = np.minimum((-np.log(np.maximum(rng.random(n), 1e-12)) / np.log(links)).astype(int), 6)
    top = int(level.max(initial=0))
    graph = Graph(x, [np.zeros((0, 0), np.int64)] * (top + 1), [], int(np.argmax(level)))
    for layer in range(top, -1, -1):
        width = 2 * links if layer == 0 else links
        table = np.full((n if layer == 0 else n, width), -1, np.int32)
        if layer < top:
            above = graph.layers[layer + 1]
            table[:, :links] = above[:, :links]
        else:
            graph.layers[layer] = table
        graph.layers[layer] = table
        todo = np.flatnonzero(level == layer)
        todo = rng.permutation(todo[todo != graph.entry])
        count = int((level > layer).sum()) or 1
        at = 0
        while at < len(todo):
            batch = todo[at : at + min(BLOCK, max(4, count))]
            _insert(graph, layer, table, batch, links, ef)
            at += len(batch)
            count += len(batch)
    return graph


def _insert(graph: Graph, layer: int, table: np.ndarray, batch: np.ndarray, links: int, ef: int) -> None:
    x = graph.x
    q = x[batch]
    ids, sims = graph.beam(q, graph.descend(q, layer), ef, table)
    # neighbours within the batch, which the search can't see yet
    own = q @ q.T
    np.fill_diagonal(own, -np.inf)
    some = np.argsort(-own, axis=1, kind="stable")[:, : min(12, len(batch) - 1)]
    ids = np.concatenate([ids, batch[some]], 1)
    sims = np.concatenate([sims, np.take_along_axis(own, some, 1)], 1)
    order = np.argsort(-sims, axis=1, kind="stable")[:, : 3 * links]
    ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
    chosen = _select(x, ids, sims, links, True)
    table[batch, :links] = chosen
    source = np.repeat(batch, links)
    target = chosen.ravel()
    source, target = source[target >= 0], target[target >= 0]
    order = np.argsort(target, kind="stable")
    source, target = source[order], target[order]
    nodes, first, counts = np.unique(target, return_index=True, return_counts=True)
    wide = int(counts.max(initial=0))
    if not wide:
        return
    new = np.full((len(nodes), wide), -1, np.int64)
    place = np.arange(len(target)) - np.repeat(first, counts)
    new[np.repeat(np.arange(len(nodes)), counts), place] = source
    width = table.shape[1]
    for lo in range(0, len(nodes), BLOCK):
        part = nodes[lo : lo + BLOCK]
        old = table[part]
        both = np.concatenate([old, new[lo : lo + BLOCK]], 1).astype(np.int64)
        both.sort(axis=1)
        both[:, 1:][both[:, 1:] == both[:, :-1]] = -1  # a link from both sides counts once
        s = np.where(both >= 0, np.einsum("bd,bcd->bc", x[part], x[np.maximum(both, 0)]), -np.inf)
        order = np.argsort(-s, axis=1, kind="stable")
        both, s = np.take_along_axis(both, order, 1), np.take_along_axis(s, order, 1)
        used = int((both >= 0).sum(1).max())
        both, s = both[:, :used], s[:, :used]
        fits = (both >= 0).sum(1) <= width
        kept = np.full((len(part), width), -1, np.int64)
        kept[fits, : min(used, width)] = both[fits, :width]
        if not fits.all():
            kept[~fits] = _select(x, both[~fits], s[~fits].astype(np.float32), width, False)
        table[part] = kept


def _augmented(v: np.ndarray) -> np.ndarray:
    """Vectors of at most unit length with the coordinate that makes them equally long; no finite value overflows."""
    v = v / max(np.abs(v).max(), 1e-300)
    norms = (v**2).sum(1)
    extra = np.sqrt(np.maximum(norms.max() - norms, 0))
    return (np.column_stack([v, extra]) / np.sqrt(norms.max())).astype(np.float32)


_INDEX = "dim int, shard int, vectors binary, members binary, starts binary, entry int, tables binary, widths array<int>, nodes binary"


def _build_shard(pdf: pd.DataFrame) -> pd.DataFrame:
    v = np.stack(pdf["v"].to_numpy()).astype(np.float64) + 0.0  # -0.0 is 0.0
    ids = pdf["vec_id"].to_numpy(np.int64)
    order = np.lexsort((ids, *v.T[::-1]))
    v, ids = v[order], ids[order]
    first = np.concatenate([[True], (v[1:] != v[:-1]).any(1)])
    starts = np.append(np.flatnonzero(first), len(v))
    unique = v[first]
    graph = build(_augmented(unique))
    # a layer's table holds only its own nodes' rows
    nodes = [np.flatnonzero((t >= 0).any(1)) if k else np.arange(len(unique)) for k, t in enumerate(graph.layers)]
    tables = b"".join(t[r].astype("<i4").tobytes() for t, r in zip(graph.layers, nodes))
    packed = b"".join(np.append(len(r), r).astype("<i4").tobytes() for r in nodes)
    widths = [int(t.shape[1]) for t in graph.layers]
    row = (int(pdf["dim"].iloc[0]), int(pdf["shard"].iloc[0]), unique.astype("<f8").tobytes(), ids.astype("<i8").tobytes(), starts.astype("<i8").tobytes(), graph.entry, tables, widths, packed)
    return pd.DataFrame([row], columns=[c.split()[0] for c in _INDEX.split(", ")])


class Shard:
    """A stored row, ready to be searched."""

    def __init__(self, row):
        self.v = np.frombuffer(row.vectors, "<f8").reshape(-1, int(row.dim))
        self.members = np.frombuffer(row.members, "<i8")
        self.starts = np.frombuffer(row.starts, "<i8")
        packed, tables = np.frombuffer(row.nodes, "<i4"), np.frombuffer(row.tables, "<i4")
        layers, p, t = [], 0, 0
        for width in row.widths:
            nodes = packed[p + 1 : p + 1 + packed[p]]
            p += 1 + packed[p]
            full = np.full((len(self.v), width), -1, np.int32)
            full[nodes] = tables[t : t + len(nodes) * width].reshape(-1, width)
            t += len(nodes) * width
            layers.append(full)
        self.graph = Graph(_augmented(self.v), layers, [], int(row.entry))

    def nearest(self, ids: np.ndarray, q: np.ndarray, k: int, ef: int):
        """``(query id, vec_id, score)`` arrays: the k best of the nodes found, without the query itself."""
        unit = q / np.maximum(np.abs(q).max(1), 1e-300)[:, None]
        scaled = np.column_stack([unit / np.linalg.norm(unit, axis=1)[:, None], np.zeros(len(q))])
        found, _ = self.graph.search(scaled.astype(np.float32), ef)
        out_q, out_v, out_s = [], [], []
        for i, (own, nodes) in enumerate(zip(ids, found)):
            nodes = nodes[nodes >= 0]
            with np.errstate(over="ignore", invalid="ignore"):
                scores = np.nan_to_num(self.v[nodes] @ q[i], nan=-np.inf, posinf=np.inf, neginf=-np.inf)
            order = np.argsort(-scores, kind="stable")
            nodes, scores = nodes[order], scores[order]
            # k + 1 best nodes, with all that tie with the last; of each its smallest ids suffice
            if len(scores) > k + 1:
                last = np.searchsorted(-scores, -scores[k], "right")
                nodes, scores = nodes[:last], scores[:last]
            member = [self.members[self.starts[j] : min(self.starts[j + 1], self.starts[j] + k + 1)] for j in nodes]
            v = np.concatenate(member)
            s = np.repeat(scores, [len(m) for m in member])
            v, s = v[v != own], s[v != own]
            best = np.lexsort((v, -s))[:k]
            out_q.append(np.full(len(best), own))
            out_v.append(v[best])
            out_s.append(s[best])
        return np.concatenate(out_q), np.concatenate(out_v), np.concatenate(out_s)


def build_index(vectors: DataFrame, shard_rows: int = SHARD_ROWS, min_shards: int = MIN_SHARDS, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row of flat arrays a shard, stored in the shared folder; every usable row is indexed."""
    rows = usable(vectors).dropDuplicates(["vec_id", "v"])
    n, size = usable(vectors).agg(F.count("*"), F.coalesce(F.sum(F.size("v").cast("long") * 8), F.lit(0))).first()
    shards = max(min_shards, -(-n // shard_rows), -(-size // shard_bytes))
    dealt = rows.withColumn("dim", F.size("v")).withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int"))
    return materialise(dealt.repartition(4 * shards, "dim", "shard").groupBy("dim", "shard").applyInPandas(_build_shard, _INDEX), "graph-shards")


def search(index: DataFrame, queries: DataFrame, k: int = K, ef: int = EF_SEARCH) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's k nearest among all shards."""
    keys = index.select("dim", "shard")
    shards = index.agg(F.count("*")).first()[0]
    empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in index.schema.fields if f.name not in ("dim", "shard")]
    by_dim = keys.groupBy("dim").agg(F.collect_list("shard").alias("shards"))  # one number a shard
    asked = (
        usable(queries)
        .dropDuplicates(["vec_id", "v"])
        .withColumn("dim", F.size("v"))
        .join(by_dim, "dim")
        .select("dim", F.explode("shards").alias("shard"), *empty, F.lit(1).alias("part"), F.col("vec_id").alias("query_id"), "v")
    )
    stored = index.select("dim", "shard", *[c for c in index.columns if c not in ("dim", "shard")], F.lit(0).alias("part"), F.lit(None).cast("long").alias("query_id"), F.lit(None).cast("array<double>").alias("v"))

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A shard's graph comes first, then its queries in blocks."""
        shard = None
        for pdf in batches:
            for part, rows in pdf.groupby((pdf["part"] != pdf["part"].shift()).cumsum(), sort=False):
                if rows["part"].iloc[0] == 0:
                    shard = Shard(rows.iloc[-1])
                    continue
                for at in range(0, len(rows), BLOCK):
                    block = rows.iloc[at : at + BLOCK]
                    q, v, s = shard.nearest(block["query_id"].to_numpy(np.int64), np.stack(block["v"].to_numpy()), k, max(ef, k + 8))
                    yield pd.DataFrame({"query_id": q, "vec_id": v, "score": s})

    met = stored.unionByName(asked).repartition(max(1, 4 * shards), "dim", "shard").sortWithinPartitions("dim", "shard", "part")
    found = met.mapInPandas(stream, "query_id long, vec_id long, score double").distinct()
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def neighbours(vectors: DataFrame, every: int = 20, k: int = K, ef: int = EF_SEARCH) -> DataFrame:
    """The k nearest of the rows whose id is divisible by ``every``, among all rows but the query's own."""
    return search(build_index(vectors), vectors.where(F.col("vec_id") % every == 0), k, ef)
