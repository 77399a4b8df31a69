"""Secret scan over a trigram inverted index, in DataFrame operations only.

Each rule's regex is parsed once on the driver into a Boolean query over trigrams that every match
must hold. The corpus is scanned for the trigrams those queries use and turned into postings
``(trigram, text key)``; the postings are intersected per rule, and only the candidates are verified
with the regex itself. A rule without mandatory trigrams (hex) scans every text.

Defined cases: null text counts as empty; empty text has no spans; repeated rows give repeated result
rows; a null ``doc_id`` is kept; extra columns of the input are ignored; an empty table gives none.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product
from re import _parser as sre

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, small_or_shuffled

MAX_STRINGS = 64
BLOCK = 256


@dataclass(frozen=True)
class Rule:
    """``value_group`` must have ``value_min`` characters, else the match is dropped."""

    kind: str
    regex: str
    value_group: int = 0
    value_min: int = 0


RULES = (
    Rule(
        "assign",
        r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        8,
    ),
    # Greedy runs with a least length: the same spans as the run of any length with short ones dropped.
    Rule("access", r"AKIA[A-Z0-9]{12,}"),
    Rule("hex", r"[0-9a-f]{32,}"),
    Rule("forge_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
)
BASE_KINDS = ("assign", "access", "hex")


def _strings(node) -> list[str] | None:
    """The finite set of strings one parsed node matches; None if it isn't small and finite."""
    op, arg = node
    name = str(op)
    if name == "LITERAL":
        return [chr(arg)]
    if name == "IN":
        out = []
        for kind, value in arg:
            if str(kind) == "LITERAL":
                out.append(chr(value))
            elif str(kind) == "RANGE" and value[1] - value[0] < 8:
                out += [chr(c) for c in range(value[0], value[1] + 1)]
            else:
                return None
        return out if len(out) <= 8 else None
    if name == "SUBPATTERN":
        return _sequence_strings(arg[3])
    if name == "BRANCH":
        parts = [_sequence_strings(x) for x in arg[1]]
        return None if any(p is None for p in parts) else [s for p in parts for s in p]
    if name in ("MAX_REPEAT", "MIN_REPEAT"):
        low, high, inner = arg
        inner_strings = _sequence_strings(inner)
        if inner_strings is None or high > 8:
            return None
        out = []
        for n in range(low, int(high) + 1):
            out += ["".join(p) for p in product(inner_strings, repeat=n)]
            if len(out) > MAX_STRINGS:
                return None
        return out
    return None


def _sequence_strings(nodes) -> list[str] | None:
    out = [""]
    for node in nodes:
        strings = _strings(node)
        if strings is None or len(out) * len(strings) > MAX_STRINGS:
            return None
        out = [a + b for a in out for b in strings]
    return out


def trigram_query(regex: str) -> list[frozenset[str]] | None:
    """The regex's Boolean trigram query in disjunctive form, lower case; None: no mandatory trigram.

    A text that holds a match holds all trigrams of at least one of the sets. Maximal runs of nodes with
    finitely many strings give an OR of ANDs each; the runs are joined by AND.
    """
    runs, run = [], [""]
    for node in [*sre.parse(regex), None]:
        strings = None if node is None else _strings(node)
        if strings is not None and len(run) * len(strings) <= MAX_STRINGS:
            run = [a + b for a in run for b in strings]
            continue
        runs.append(run)
        run = [""] if strings is None else strings
        if node is not None and strings is None and str(node[0]) == "MAX_REPEAT" and node[1][0] == 1:
            inner = _sequence_strings(node[1][2])
            run = inner if inner and len(inner) <= 8 else [""]
            runs.append(run)
            run = [""]
    runs.append(run)
    query = [frozenset()]
    for run in runs:
        sets = {frozenset(s.lower()[i : i + 3] for i in range(len(s) - 2)) for s in run}
        if frozenset() in sets:
            continue
        query = [a | b for a in query for b in sets]
        query = [a for a in set(query) if not any(b < a for b in query)]
    return None if frozenset() in query else sorted(query, key=sorted)


def _vocabulary(rules) -> list[str]:
    return sorted({t for r in rules for conj in trigram_query(r.regex) or () for t in conj})


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text (null: empty) and the text's md5 as key, so equal texts share postings."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select("doc_id", text.alias("text")).withColumn("key", F.unhex(F.md5("text")))


def build_index(docs: DataFrame, rules=RULES) -> DataFrame:
    """Postings ``(trigram int, key binary)`` of the trigrams that the rules' queries use."""
    if not _vocabulary(rules):
        return keyed(docs).select("key", F.lit(0).alias("trigram")).where(F.lit(False))
    lower = F.lower("text")
    found = F.array_compact(
        F.array(*[F.when(F.contains(lower, F.lit(t)), F.lit(i)) for i, t in enumerate(_vocabulary(rules))])
    )
    return keyed(docs).select("key", F.explode(found).alias("trigram"))


def candidates(postings: DataFrame, rules=RULES) -> DataFrame:
    """Intersect postings: ``(key, wanted)`` with one bit a rule that the text may match.

    Trigrams are held as bits of up to 60 in a word and combined before the shuffle, so the
    postings of a text with many copies meet as a few rows.
    """
    vocabulary = _vocabulary(rules)
    if not vocabulary:
        return postings.select("key", F.lit(0).alias("wanted")).where(F.lit(False))
    words = range((len(vocabulary) + 59) // 60)
    one = F.lit(1).cast("long")
    bits = [
        F.coalesce(
            F.bit_or(
                F.when(F.floor(F.col("trigram") / 60) == w, F.shiftleft(one, 0) * F.expr("shiftleft(1L, trigram % 60)"))
            ),
            F.lit(0).cast("long"),
        ).alias(f"w{w}")
        for w in words
    ]
    met = postings.groupBy("key").agg(*bits)
    wanted = F.lit(0)
    for n, rule in enumerate(rules):
        test = F.lit(False)
        for conj in trigram_query(rule.regex) or ():
            every = F.lit(True)
            for w in words:
                mask = sum(1 << (i % 60) for i, t in enumerate(vocabulary) if i // 60 == w and t in conj)
                if mask:
                    every = every & (F.col(f"w{w}").bitwiseAND(F.lit(mask).cast("long")) == F.lit(mask).cast("long"))
            test = test | every
        wanted = wanted + F.when(test, 1 << n).otherwise(0)
    return met.select("key", wanted.cast("int").alias("wanted")).where("wanted > 0")


_SPAN = "array<struct<s:bigint,k:int,e:bigint>>"


def _spans(rule: Rule, number: int) -> Column:
    """All matches as structs of start, kind's number and end, in code points.

    The gaps between matches (split) and the matches (extract) have the same cut points; their
    running length gives the positions.
    """
    pattern = F.lit(rule.regex)
    matches = F.regexp_extract_all("text", pattern, F.lit(0))
    values = F.regexp_extract_all("text", pattern, F.lit(rule.value_group)) if rule.value_min else matches
    gaps = F.split("text", rule.regex, -1)
    start = lambda a, x: a["p"] + F.length(x["g"])
    end = lambda a, x: start(a, x) + F.length(x["m"])
    zero = F.lit(0).cast("long")

    def merge(a, x):
        span = F.array(F.struct(start(a, x).alias("s"), F.lit(number).alias("k"), end(a, x).alias("e")))
        kept = F.when(F.length(x["v"]) >= rule.value_min, F.concat(a["o"], span.cast(_SPAN))).otherwise(a["o"])
        return F.struct(end(a, x).alias("p"), kept.alias("o"))

    def of_block(block, begin):
        return F.aggregate(block, F.struct(begin.alias("p"), F.array().cast(_SPAN).alias("o")), merge, lambda a: a["o"])

    def every(z):
        """Positions in two levels, so an array that grows by a match a step is never longer than a block."""
        count = F.ceil(F.size(z) / BLOCK).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), count - 1), lambda b: F.slice(z, b * BLOCK + 1, F.lit(BLOCK)))
        length = lambda block: F.aggregate(block, zero, lambda n, x: n + F.length(x["g"]) + F.length(x["m"]))
        begin = F.struct(zero.alias("p"), F.array().cast("array<bigint>").alias("o"))
        step = lambda a, block: F.struct((a["p"] + length(block)).alias("p"), F.concat(a["o"], F.array(a["p"])).alias("o"))
        return once(blocks, lambda bs: F.flatten(F.zip_with(bs, F.aggregate(bs, begin, step, lambda a: a["o"]), of_block)))

    once = lambda column, use: F.element_at(F.transform(F.array(column), use), 1)
    zipped = F.arrays_zip(F.slice(gaps, 1, F.size(matches)).alias("g"), matches.alias("m"), values.alias("v"))
    return once(zipped, lambda z: F.when(F.size(z) > 0, every(z)).otherwise(F.array().cast(_SPAN)))


def _joined(spans: Column, kinds) -> Column:
    names = F.array(*[F.lit(k) for k in kinds])
    text = F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string")))
    return F.array_join(text, ",")


def scan(docs: DataFrame, rules=RULES, postings: DataFrame | None = None) -> DataFrame:
    """Every row's spans: ``doc_id, text_key, spans array<struct<s,k,e>>`` sorted by start, then kind."""
    postings = postings if postings is not None else materialise(build_index(docs, rules), "secret-postings")
    found = materialise(candidates(postings, rules), "secret-candidates")
    joined = keyed(docs).join(small_or_shuffled(found), "key", "left")
    parts = []
    for n, rule in enumerate(rules):
        may = F.col("text").rlike(rule.regex)
        if trigram_query(rule.regex) is not None:
            may = (F.coalesce(F.col("wanted"), F.lit(0)).bitwiseAND(F.lit(1 << n)) != 0) & may
        parts.append(F.when(may, _spans(rule, n)).otherwise(F.array().cast(_SPAN)))
    return joined.select("doc_id", F.col("key").alias("text_key"), F.array_sort(F.concat(*parts)).alias("spans"))


def digest(found: DataFrame, rules=RULES) -> DataFrame:
    """The digest columns of ``scan``'s result."""
    kinds = [r.kind for r in rules]
    base = [kinds.index(k) for k in BASE_KINDS]
    count = lambda k: F.size(F.filter("spans", lambda x: x["k"] == k)).cast("long")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{kinds[k]}") for k in base],
        F.sha2(_joined(F.filter("spans", lambda x: x["k"].isin(base)), kinds), 256).alias("base_sha256"),
        _joined(F.col("spans"), kinds).alias("spans"),
    )
