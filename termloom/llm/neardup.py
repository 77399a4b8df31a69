"""Near duplicates by a containment ensemble of MinHash tables.

Texts are sets of hashed five-word shingles. Two texts are linked if the smaller's set is contained to at
least 0.8 in the larger's, whatever their sizes; the sets themselves are compared before a link counts.

The ensemble: texts are partitioned by set size, each partition reaching to the square root of two of its
least size. For every partition the containment is converted to the least Jaccard similarity that a linked
pair of such sizes has, and its bands and rows are tuned for that threshold. A text is entered in the
partition's own table and asks in the table of the next larger sizes. Every bucket brings its members to its
first and last member. Pairs whose MinHash signatures are far below the pair's threshold are dropped, the
others checked, and their links make the first classes.

Pairs of a bucket that this leaves in two classes, and texts in much larger ones (there the threshold falls
with the ratio of sizes, and bands would need thousands of hashes), are found by an asymmetric lookup in all
partitions from the own one up: a text asks with its ``ASKED`` least shingle hashes, and texts at least as
large that hold ``ANSWERED`` of them are candidates. A linked pair passes with probability 0.998 for any ratio
of sizes, and always if the smaller set has under 40 shingles. Of ``ASKED`` hashes the
``ASKED - ANSWERED + 1`` rarest outside of the text's own class must hold a common one, so only these are
followed: passages that many texts share are common, and pairs that have nothing else in common are never made. No bucket, list of answers
or number of partners is capped.

Classes: texts linked with Jaccard similarity of at least ``CLOSE`` (so of similar size) are in one class
(connected components). A class whose largest text is only contained in a larger text of another class (a
cut version of it) joins one such class, that of the best container, so two texts never meet merely by
sharing a contained third.

Defined cases: equal texts are one text with several rows; a text of one to four words has one shingle of
all its words; texts without words equal only themselves; null text counts as empty; repeated rows
give repeated result rows; null ids are kept, and the class id is the smallest id (null if there is none);
extra columns of any name are ignored by ``classes`` and kept by ``keep_one``.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BROADCAST_ROWS, discard, materialise, small_or_shuffled

SHINGLE = 5
SIMILARITY = 0.8
CLOSE = 0.5
ASKED = 16
ANSWERED = 8
BLOCK = 512
SLICE = 500
HASHES = 128
DEVIATIONS = 3
HOT_ROWS = 100_000
_MULTIPLIERS = np.random.default_rng(20).integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_G = np.uint64(0x9E3779B97F4A7C15)
_STRETCH = 1 << 18
_POWER = np.uint64(0xD6E8FEB86659FD93)
_UNPOWER = np.uint64(pow(int(_POWER), -1, 1 << 64))


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whether a code point is a letter or digit; the powers, and inverse powers, of a word's characters."""
    word = np.zeros(0x110000, bool)
    word[[ord(c) for c in re.findall(r"[^\W_]", "".join(map(chr, range(0xD800))) + "".join(map(chr, range(0xE000, 0x110000))))]] = True
    with np.errstate(over="ignore"):
        powers = [np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(_STRETCH, p, np.uint64)])) for p in (_POWER, _UNPOWER)]
    return word, *powers


def _word_hashes(codes: np.ndarray) -> np.ndarray:
    """A hash of every word of lower-case code points: the sum of its mixed characters times powers of their place."""
    word, power, unpower = _tables()
    inside = word[codes]
    turn = np.diff(np.concatenate([[0], inside.view(np.int8), [0]]))
    starts, ends = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
    out = np.zeros(len(starts), np.uint64)
    with np.errstate(over="ignore"):
        at = 0
        while at < len(starts):  # stretches of whole words bound the powers
            to = max(at + 1, int(np.searchsorted(ends, starts[at] + _STRETCH, "right")))
            low, high = starts[at], ends[to - 1]
            x = (codes[low:high].astype(np.uint64) + np.uint64(1)) * _G
            x ^= x >> np.uint64(32)
            if high - low <= _STRETCH:
                sums = np.concatenate([[np.uint64(0)], np.cumsum(x * power[: high - low])])
                h = (sums[ends[at:to] - low] - sums[starts[at:to] - low]) * unpower[starts[at:to] - low]
            else:  # one word longer than a stretch
                h = np.uint64(0)
                for k in range(0, len(x), _STRETCH):
                    h = h * power[_STRETCH] + (x[k : k + _STRETCH] * power[: len(x[k : k + _STRETCH])]).sum(dtype=np.uint64)
            out[at:to] = h
            at = to
        out ^= out >> np.uint64(31)
        out *= _G
    return out


def shingles(text: str | None) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the text's shingles."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    h = _word_hashes(codes)
    if not len(h):
        return h
    n = max(1, len(h) - SHINGLE + 1)
    with np.errstate(over="ignore"):
        out = np.full(n, 7, np.uint64)
        for k in range(min(SHINGLE, len(h))):
            out = (out ^ h[k : k + n]) * _G
            out ^= out >> np.uint64(29)
    out.sort()
    return out[np.append(True, out[1:] != out[:-1])]


def signature(s: np.ndarray) -> np.ndarray:
    """The least value of each hash over the set, 32 bits."""
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    with np.errstate(over="ignore"):
        for at in range(0, len(s), 512):
            part = s[at : at + 512]
            out = np.minimum(out, ((part[:, None] * _MULTIPLIERS) >> np.uint64(32)).min(0).astype(np.uint32))
    return out


def partition(n: int) -> int:
    """The size partition: sizes from 2^(p/2) up to below 2^((p+1)/2)."""
    return (n * n).bit_length() - 1


@lru_cache(maxsize=256)
def bound(part: int) -> float:
    """Least Jaccard similarity of a linked pair of one partition, ``CLOSE`` at least.

    With containment c and sizes a <= b it is c a / (a + b - c a), least where b / a is largest: the
    partition's largest size over its smallest. Less similar links make no class of their own.
    """
    low = math.isqrt((1 << part) - 1) + 1 if part else 1
    high = max(low, math.isqrt((1 << (part + 1)) - 1))
    return max(CLOSE, SIMILARITY / (1 + high / low - SIMILARITY))


@lru_cache(maxsize=64)
def banding(least: float) -> tuple[int, int]:
    """Bands and rows within the hashes: the fewest chance candidates that still find 95 % at the threshold."""
    best = None
    for rows in range(1, 9):
        for bands in range(1, HASHES // rows + 1):
            if 1 - (1 - least**rows) ** bands >= 0.95:
                low = np.linspace(0.01, least, 50)
                cost = float((1 - (1 - low**rows) ** bands).mean()) + 0.002 * bands
                if best is None or cost < best[0]:
                    best = (cost, bands, rows)
                break
    return (best[1], best[2]) if best else (HASHES, 1)


def buckets(n: int, sig: np.ndarray) -> np.ndarray:
    """Bucket numbers in the tables of the own partition and of the next larger sizes."""
    if n == 0:
        return np.zeros(0, np.uint64)
    out = []
    for part in (partition(n), partition(n) + 1):
        bands, rows = banding(bound(part))
        with np.errstate(over="ignore"):
            h = np.full(bands, part * 4 * 1000003 + 17, np.uint64) + np.arange(bands, dtype=np.uint64)
            for r in range(rows):
                h = (h ^ sig[r * bands : (r + 1) * bands].astype(np.uint64)) * _G
                h ^= h >> np.uint64(31)
        out.append(h)
    return np.concatenate(out)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    """Arrays of unsigned numbers as one column of lists of longs."""
    ends = np.cumsum([0, *map(len, arrays)])
    values = np.concatenate([*arrays, np.zeros(0, np.uint64)]).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Few rows at a time, so a worker holds few texts and sets at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            yield batch.slice(at, SLICE)


def _mapped(rows: DataFrame, kind: str, make) -> DataFrame:
    """The columns but ``text`` as they are and those that ``make`` gives for the texts; ``make`` may choose rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches):
            kept = [c for c in part.schema.names if c != "text"]
            chosen, made = make(part)
            yield pa.RecordBatch.from_arrays([*(part.column(c).take(pa.array(chosen, pa.int64())) for c in kept), *made.values()], [*kept, *made])

    types = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "text"]
    return rows.mapInArrow(run, ", ".join([*types, kind]))


def _sketched(part: pa.RecordBatch):
    sets = [shingles(x) for x in part.column("text").to_pylist()]
    sigs = [signature(s) for s in sets]
    return np.arange(len(sets)), {
        "n": pa.array([len(s) for s in sets], pa.int32()),
        "buckets": _lists([buckets(len(s), g) for s, g in zip(sets, sigs)]),
        "asked": _lists([s[:ASKED] for s in sets]),
        "sig": pa.array([g.astype(np.uint8).tobytes() for g in sigs], pa.binary()),
    }


@F.pandas_udf(T.BooleanType())
def _plausible(na: pd.Series, nb: pd.Series, sa: pd.Series, sb: pd.Series) -> pd.Series:
    """False where the signatures agree over ``DEVIATIONS`` deviations less than those of a link of these sizes."""
    small, large = np.minimum(na, nb), np.maximum(na, nb)
    least = SIMILARITY * small / (small + large - SIMILARITY * small)
    need = HASHES * least - DEVIATIONS * np.sqrt(HASHES * least * (1 - least))
    if not len(na):
        return need >= 0
    x, y = (np.frombuffer(b"".join(s), np.uint8).reshape(-1, HASHES) for s in (sa, sb))
    return pd.Series((x == y).sum(1) >= need.to_numpy())


class _Filter:
    """A Bloom filter of a column of hashes: 16 bits a value and two places each, ``2**MOST`` bits (64 MB) at most.

    Bits are set in parallel and gathered as one bitmap of bounded size. It only saves rows; what it lets
    through by chance is dropped by the joins after it.
    """

    MOST = 29
    SHIFTS = (0, 23)  # the least hashes of a set have zeros in front, so places are taken from the other end

    def __init__(self, values: DataFrame):
        (column,) = values.columns
        self.bits = min(self.MOST, max(20, (16 * values.count()).bit_length()))
        mask = F.lit((1 << self.bits) - 1)
        places = F.array(*[F.shiftrightunsigned(column, k).bitwiseAND(mask) for k in self.SHIFTS])
        at = values.select(F.explode(places).alias("p")).groupBy(F.shiftright("p", 15).cast("int").alias("at"))
        made = at.agg(F.bitmap_construct_agg(F.col("p").bitwiseAND(F.lit(32767))).alias("m")).toPandas()
        table = np.zeros((1 << (self.bits - 15), 4096), np.uint8)
        for k, m in zip(made["at"], made["m"]):
            table[k] = np.frombuffer(m, np.uint8)
        self.packed = values.sparkSession.sparkContext.broadcast(table.tobytes())

    def passes(self, values: np.ndarray) -> np.ndarray:
        """Places of the unsigned values that may be in the column."""
        flags = np.frombuffer(self.packed.value, np.uint8)
        at = np.arange(len(values))
        for k in self.SHIFTS:
            p = (values[at] >> np.uint64(k)) & np.uint64((1 << self.bits) - 1)
            at = at[((flags[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)]
        return at


def _text():
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def _key():
    """The md5 of the text as 16 bytes."""
    return F.unhex(F.md5(_text()))


def _short(key: str):
    return F.xxhash64(key)


def _components(edges: DataFrame) -> DataFrame:
    """``id, class`` of all ids in ``edges (a, b)``: the smallest id reachable.

    Alternating large-star and small-star steps; every step is one aggregation and is written out.
    """
    both = lambda e: e.select("a", "b").union(e.select("b", "a"))
    edges = materialise(edges.select("a", "b").where("a != b").distinct(), "near-components")
    size, total = None, None
    while True:
        near = both(edges).toDF("u", "v")
        least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = near.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        down = large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).union(low.select(F.col("u").alias("a"), F.col("m").alias("b")))
        before, edges = edges, materialise(small.where("a != b").distinct(), "near-components")
        discard(before)
        # A step that changes an edge lowers the sum of ends or the number of edges.
        now = edges.agg(F.count("*"), F.sum(F.col("a").cast("decimal(38,0)") + F.col("b"))).first()
        if (size, total) == tuple(now):
            break
        size, total = now
    return edges.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("class")).union(edges.select("b", "b").distinct())


def _sets(docs: DataFrame, needed: DataFrame, only: _Filter | None = None) -> DataFrame:
    """``id, s`` of the texts of ``needed (id, key)``: their sorted shingles, at least those that ``only`` lets through.

    Other texts are left out by a broadcast of the few needed keys, or of a filter of them.
    """
    rows = docs.select(_key().alias("key"), _text().alias("text"))
    few = needed.count() <= BROADCAST_ROWS
    wanted = None if few else _Filter(needed.select(_short("key").alias("k")))
    if few:
        rows = rows.join(F.broadcast(needed.select("key")), "key", "left_semi")

    def chosen(part: pa.RecordBatch):
        every = np.arange(part.num_rows)
        if wanted is not None:
            every = wanted.passes(part.column("short").to_numpy().view(np.uint64))
        sets = [shingles(part.column("text")[i].as_py()) for i in every.tolist()]
        return every, {"s": _lists(sets if only is None else [s[only.passes(s)] for s in sets])}

    # Copies of one text are combined before they are shuffled.
    made = _mapped(rows.select("key", "text", _short("key").alias("short")), "s array<bigint>", chosen)
    return made.groupBy("key").agg(F.any_value("s").alias("s")).join(small_or_shuffled(needed), "key").select("id", "s")


def _check(pairs: DataFrame, texts: DataFrame, docs: DataFrame) -> DataFrame:
    """The links among ``pairs (a, b)``: ``a, b, na, nb, common`` with a the smaller set.

    Of the larger sets only what may be in some smaller one is read. The smaller set is sent to the larger,
    whose partners are split into groups of ``BLOCK``.
    """
    of = lambda x: texts.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("sig").alias(f"s{x}"))
    sized = pairs.join(of("a"), "a").join(of("b"), "b").where(_plausible("na", "nb", "sa", "sb"))
    flip = (F.col("na") > F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") > F.col("b")))
    swap = lambda x, y: F.when(flip, F.col(y)).otherwise(F.col(x))
    sized = materialise(sized.select(swap("a", "b").alias("a"), swap("b", "a").alias("b"), swap("na", "nb").alias("na"), swap("nb", "na").alias("nb")), "near-plausible")
    needed = lambda x: materialise(sized.select(F.col(x).alias("id")).distinct().join(texts.select("id", "key"), "id"), "near-needed")
    need_a, need_b = needed("a"), needed("b")
    smaller = materialise(_sets(docs, need_a), "near-sets")
    larger = materialise(_sets(docs, need_b, _Filter(smaller.select(F.explode("s").alias("s")))), "near-sets")
    groups = sized.groupBy("b").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("groups"))
    group = lambda x: F.pmod(F.xxhash64(x), F.col("groups")).cast("int").alias("group")
    small = sized.join(groups, "b").select("a", "b", "na", "nb", group("a")).join(smaller.toDF("a", "sa"), "a")
    large = larger.toDF("b", "sb").join(groups, "b").select("b", "sb", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("group"))
    met = small.join(large, ["b", "group"]).select("a", "b", "na", "nb", F.size(F.array_intersect("sa", "sb")).alias("common"))
    links = materialise(met.where(F.col("common") >= SIMILARITY * F.col("na")), "near-links")
    discard(sized, need_a, need_b, smaller, larger)
    return links


def _lookup(texts: DataFrame, docs: DataFrame) -> DataFrame:
    """Candidates ``a, b`` in different classes by the asymmetric lookup; ``texts`` has their classes."""
    asks = texts.select("id", "n", "class", F.explode("asked").alias("s"))
    wanted = _Filter(asks.select("s"))

    def others(part: pa.RecordBatch):
        """Shingles beyond those that the text asks with itself, of the texts that have some."""
        sets = [shingles(x)[ASKED:] for x in part.column("text").to_pylist()]
        sets = [s[wanted.passes(s)] for s in sets]
        some = [i for i, s in enumerate(sets) if len(s)]
        return some, {"met": _lists([sets[i] for i in some])}

    found = _mapped(docs.select(_key().alias("key"), _text().alias("text")), "met array<bigint>", others)
    found = found.groupBy("key").agg(F.any_value("met").alias("met")).join(texts.select("key", "id", "class"), "key")
    held = asks.select("s", "id", "class").union(found.select(F.explode("met").alias("s"), "id", "class"))
    held = materialise(held, "near-held")
    # How many texts of other classes hold a hash; those of the own class lead nowhere.
    per = held.groupBy("s", "class").agg(F.count("*").alias("own"))
    shared = per.groupBy("s").agg(F.sum("own").alias("df"), F.count("*").alias("classes")).where("classes > 1")
    common = materialise(per.join(shared, "s").select("s", "class", "df", (F.col("df") - F.col("own")).alias("others")), "near-common")
    # The rarest hashes of a text; those that no text of another class holds come first.
    m = F.least(F.lit(ASKED), F.col("n"))
    need = F.greatest(m - F.floor(F.col("n") / 5), F.least(F.lit(ANSWERED), F.col("n")))
    rare = asks.join(common, ["s", "class"]).groupBy("id", "n", "class").agg(F.sort_array(F.collect_list(F.struct("others", "s", "df"))).alias("l"))
    rare = rare.withColumn("take", (m - need + 1 - (m - F.size("l"))).cast("int")).where("take > 0")
    rare = rare.select("id", "n", "class", F.explode(F.slice("l", F.lit(1), F.col("take"))).alias("r"))
    followed = materialise(rare.select("id", "n", "class", "r.s", F.ceil(F.col("r.df") / BLOCK).cast("int").alias("blocks")), "near-followed")
    # Answers in groups of one class and block: a text passes over the groups of its own class.
    asked = followed.select("s", "blocks").distinct()
    block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block")
    answers = held.join(asked, "s").select("s", "id", "class", block).join(texts.select("id", "n"), "id")
    answers = answers.groupBy("s", "block", F.col("class").alias("o_class")).agg(F.collect_list(F.struct("n", "id")).alias("o"))
    spread = followed.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = spread.join(answers, ["s", "block"]).where("class != o_class")
    larger = F.filter("o", lambda o: (o.n > F.col("n")) | ((o.n == F.col("n")) & (o.id > F.col("id"))))
    pairs = materialise(met.select(F.col("id").alias("a"), F.explode(larger).alias("o")).select("a", F.col("o.id").alias("b")).distinct(), "near-pairs")
    discard(held, common, followed)
    return pairs


def link(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Texts ``id, key, n, first_id, rows, class`` and links ``a, b, na, nb, common`` (all those between classes)."""
    sketched = _mapped(docs.select(_key().alias("key"), "doc_id", _text().alias("text")), "n int, buckets array<bigint>, asked array<bigint>, sig binary", _sketched)
    sketch = F.struct("n", "buckets", "asked", "sig")
    texts = sketched.groupBy("key").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("rows"), F.any_value(sketch).alias("k"))
    texts = materialise(texts.select(F.monotonically_increasing_id().alias("id"), "key", "first_id", "rows", "k.*"), "near-texts")

    def classed(links: DataFrame) -> DataFrame:
        near = links.where(F.col("common") >= CLOSE * (F.col("na") + F.col("nb") - F.col("common")))
        return materialise(_components(near), "near-classes")

    def of_class(df: DataFrame, found: DataFrame) -> DataFrame:
        return df.join(found, "id", "left").withColumn("class", F.coalesce("class", "id"))

    rows = texts.select("id", F.explode("buckets").alias("bucket"))
    ends = rows.groupBy("bucket").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last")
    shared = materialise(rows.join(ends, "bucket"), "near-shared")
    pair = lambda x, y: F.struct(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    pairs = shared.select(F.explode(F.array(pair("id", "first"), pair("id", "last"))).alias("p")).select("p.*").where("a != b").distinct()
    links = _check(pairs, texts, docs)
    found = classed(links)
    discard(shared)

    pairs = _lookup(of_class(texts.select("id", "key", "n", "asked"), found), docs)
    more = _check(pairs, texts, docs)
    links = links.union(more).dropDuplicates(["a", "b"])
    if not more.isEmpty():
        found = classed(links)
    return of_class(texts.select("id", "key", "n", "first_id", "rows"), found), links


def text_classes(docs: DataFrame) -> DataFrame:
    """``key, rows, class, class_id, class_rows, keeper (key, first_id)`` of every distinct text."""
    texts, links = link(docs)
    texts = materialise(texts, "near-classed")
    own = texts.groupBy("class").agg(F.max_by("id", F.struct("n", F.col("id"))).alias("top"))
    of = texts.select("id", "class")
    inside = (
        links.join(own.toDF("from", "a"), "a")
        .join(of.toDF("b", "to"), "b")
        .where("from != to and nb > na")
        .groupBy("from")
        .agg(F.max_by("to", F.struct(F.col("common") / F.col("na"), "nb", "b")).alias("to"))
    )
    # Containers are strictly larger, so following them ends; each round doubles the steps followed.
    jump = materialise(inside, "near-inside")
    while True:
        far = jump.alias("x").join(jump.alias("y"), F.col("x.to") == F.col("y.from"), "left")
        new = materialise(far.select(F.col("x.from").alias("from"), F.coalesce("y.to", "x.to").alias("to"), F.col("y.to").isNotNull().alias("moved")), "near-inside")
        jump = new.drop("moved")
        if new.where("moved").isEmpty():
            break
    rooted = (
        texts.join(jump.withColumnRenamed("from", "class"), "class", "left")
        .withColumn("class", F.coalesce("to", "class"))
        .select("key", "n", "first_id", "rows", "class")
    )
    rooted = materialise(rooted, "near-rooted")
    whole = rooted.groupBy("class").agg(
        F.min("first_id").alias("class_id"), F.max_by(F.struct("key", "first_id"), F.struct("n", F.col("key"))).alias("keeper"), F.sum("rows").alias("class_rows")
    )
    return rooted.join(whole, "class")


def classes(docs: DataFrame) -> DataFrame:
    """``doc_id, class_id, class_rows`` of every row.

    Texts of over ``HOT_ROWS`` rows, of which there is one in so many rows at most, are joined by broadcast.
    """
    found = materialise(text_classes(docs).select("key", "rows", "class_id", "class_rows"), "near-result")
    hot = F.broadcast(found.where(F.col("rows") > HOT_ROWS).select("key", F.struct("class_id", "class_rows").alias("hot")))
    rows = docs.select("doc_id", _key().alias("key")).join(hot, "key", "left")
    out = ["doc_id", "class_id", "class_rows"]
    return rows.where("hot is not null").select("doc_id", "hot.*").union(rows.where("hot is null").join(found, "key").select(*out))


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of every class: of its largest text, the row with the smallest id."""
    kept = text_classes(docs).where("key = keeper.key").select("key", F.struct(F.col("first_id").alias("id")).alias("first"))
    kept = materialise(kept, "near-kept")
    wanted = _Filter(kept.select(F.xxhash64("key", "first.id").alias("k")))

    @F.pandas_udf(T.BooleanType())
    def likely(short: pd.Series) -> pd.Series:
        out = np.zeros(len(short), bool)
        out[wanted.passes(short.to_numpy(np.int64).view(np.uint64))] = True
        return pd.Series(out)

    # Rows that aren't kept are left out before whole rows are shuffled.
    rows = docs.select(F.struct("*").alias("row"), _key().alias("key")).where(likely(F.xxhash64("key", "row.doc_id")))
    marked = rows.join(kept, "key").where(F.col("row.doc_id").eqNullSafe(F.col("first.id")))
    return marked.dropDuplicates(["key"]).select("row.*")
