"""Chat formatting: tool calls linked to their results, checked, ordered and serialised as canonical JSON.

A message (conv_id, turn, role, text) may hold calls, ``<tool_call>{"id", "name", "arguments"}</tool_call>``,
and results: the whole text of a role ``tool`` message as ``{"tool_call_id", "content"}``, or
``<tool_result>{...}</tool_result>`` stretches in any message. Calls and results are hash-joined on
(conversation, identifier). Arguments are checked against the JSON schema registered for the tool's name.
An argument string ``"$<id>"`` refers to another call's result; calls are topologically ordered by those
references, by levels (longest chain below) and within a level by turn and place.

The result is one row a message: its canonical JSON (keys sorted, no spaces, non-ASCII as it is) with its
calls, each with its place in the conversation's order, the result and what its arguments violate.

Hot conversations: messages are parsed row by row before any shuffle, the join's keys are single calls, and
messages are serialised one by one. Ordering a conversation's calls needs ids and references alone; a task
orders up to ``IN_TASK`` calls. In larger conversations chains of single references are shortened by
doubling, calls with several references get levels in rounds of joins, one for each such call on a chain, and
places come from a range-partitioned sort.

Defined cases: null text counts as empty, null role as "unknown", a null conversation is one of its own;
a call with broken JSON, a lone surrogate, a number beyond double range or values
nested deeper than ``DEPTH`` counts as malformed and is left in the text; of repeated identifiers in a
conversation the first call and first result by (turn, place) are linked, the others count as duplicates;
a result without a call is an orphan; calls in a cycle of references, and those that wait for them, come
last, by turn; equal rows are each kept; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.common import numbered
from .common import materialise

IN_TASK = 50_000
DEPTH = 300
#: Schemas of the tools that calls may name; a call of another tool is unknown, not invalid.
SCHEMAS: dict[str, dict] = {
    "search": {"type": "object", "required": ["query"], "properties": {"query": {"type": "string"}, "limit": {"type": "integer", "minimum": 1}}},
    "calculator": {"type": "object", "required": ["expression"], "properties": {"expression": {"type": "string"}}, "additionalProperties": False},
    "get_weather": {"type": "object", "required": ["city"], "properties": {"city": {"type": "string"}, "unit": {"enum": ["c", "f"]}}},
}
_TAGGED = re.compile(r"<tool_(call|result)>(.*?)</tool_\1>", re.S)
_KINDS = {
    "object": dict,
    "array": list,
    "string": str,
    "boolean": bool,
    "null": type(None),
}


def canonical(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def _is(value, kind: str) -> bool:
    if kind == "integer":
        return isinstance(value, int) and not isinstance(value, bool) or isinstance(value, float) and value.is_integer()
    if kind == "number":
        return isinstance(value, (int, float)) and not isinstance(value, bool)
    return isinstance(value, _KINDS.get(kind, object))


def violations(value, schema: dict, at: str = "$") -> list[str]:
    """What in a value breaks a JSON schema (type, enum, required, properties, items and bounds)."""
    out = []
    kinds = schema.get("type")
    if kinds is not None and not any(_is(value, k) for k in ([kinds] if isinstance(kinds, str) else kinds)):
        return [f"{at}: not of type {kinds}"]
    if "enum" in schema and value not in schema["enum"]:
        out.append(f"{at}: not in enum")
    if isinstance(value, dict):
        own = schema.get("properties", {})
        out += [f"{at}.{k}: missing" for k in schema.get("required", ()) if k not in value]
        for k, v in value.items():
            if k in own:
                out += violations(v, own[k], f"{at}.{k}")
            elif schema.get("additionalProperties") is False:
                out.append(f"{at}.{k}: not allowed")
    if isinstance(value, list) and "items" in schema:
        for i, v in enumerate(value):
            out += violations(v, schema["items"], f"{at}[{i}]")
    if _is(value, "number"):
        if "minimum" in schema and value < schema["minimum"]:
            out.append(f"{at}: below minimum")
        if "maximum" in schema and value > schema["maximum"]:
            out.append(f"{at}: above maximum")
    if isinstance(value, str):
        if len(value) < schema.get("minLength", 0) or len(value) > schema.get("maxLength", len(value)):
            out.append(f"{at}: length")
        if "pattern" in schema and not re.search(schema["pattern"], value):
            out.append(f"{at}: pattern")
    return sorted(out)


def _inside(value) -> Iterator[tuple[object, int]]:
    """A JSON value and all values in it, each with its depth, without recursion."""
    todo = [(value, 1)]
    while todo:
        value, depth = todo.pop()
        yield value, depth
        if isinstance(value, (dict, list)):
            todo += [(v, depth + 1) for v in (value.values() if isinstance(value, dict) else value)]


def _references(value) -> set[str]:
    return {v[1:] for v, _ in _inside(value) if isinstance(v, str) and v.startswith("$") and len(v) > 1}


def _load(text: str):
    """The JSON object that a text is, None if it is none that canonical JSON can hold."""

    def refuse(name):
        raise ValueError(name)

    def finite(digits):
        return x if math.isfinite(x := float(digits)) else refuse(digits)

    try:
        value = json.loads(text, parse_constant=refuse, parse_float=finite)
        if not isinstance(value, dict) or any(depth > DEPTH for _, depth in _inside(value)):
            return None
        canonical(value).encode()  # a lone surrogate has no UTF-8
    except (ValueError, RecursionError):
        return None
    return value


_PART = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("id", T.StringType()),
        T.StructField("place", T.IntegerType()),
        T.StructField("name", T.StringType()),
        T.StructField("body", T.StringType()),
        T.StructField("refs", T.ArrayType(T.StringType())),
        T.StructField("errors", T.ArrayType(T.StringType())),
    ]
)
_PARSED = T.StructType(
    [T.StructField("message", T.StringType()), T.StructField("malformed", T.IntegerType()), T.StructField("parts", T.ArrayType(_PART))]
)


def parse(role: str | None, text: str | None, schemas: dict) -> tuple[str, int, list[dict]]:
    """The message as canonical JSON without its calls and results, malformed parts, and the parts."""
    role, text = role or "unknown", text or ""
    found, malformed = [], 0

    def part(kind: str, inner: str) -> bool:
        value = _load(inner)
        key = "id" if kind == "call" else "tool_call_id"
        if value is None or not isinstance(value.get(key), str) or (kind == "call" and not isinstance(value.get("name"), str)):
            return False
        row = {"kind": kind, "id": value[key], "place": len(found), "name": None, "refs": [], "errors": []}
        if kind == "call":
            arguments = value.get("arguments", {})
            if isinstance(arguments, str):  # arguments given as a JSON text
                arguments = _load(arguments) if _load(arguments) is not None else arguments
            schema = schemas.get(value["name"])
            row |= {"name": value["name"], "body": canonical(arguments), "refs": sorted(_references(arguments))}
            row["errors"] = ["unknown tool"] if schema is None else violations(arguments, schema)
        else:
            row["body"] = canonical(value.get("content"))
        found.append(row)
        return True

    if role == "tool" and part("result", text):
        rest = ""
    else:
        def cut(m):
            nonlocal malformed
            if part(m[1], m[2]):
                return ""
            malformed += 1
            return m[0]

        rest = _TAGGED.sub(cut, text)
    return canonical({"content": rest, "role": role}), malformed, found


def levels(calls: list[tuple[str, list[str]]]) -> list[int | None]:
    """Longest chain of references below each call; None in or above a cycle. Of equal ids the first counts."""
    number: dict[str, int] = {}
    for i, (name, _) in enumerate(calls):
        number.setdefault(name, i)
    waits = [{number[r] for r in refs if r in number} for _, refs in calls]
    after: dict[int, list[int]] = {}
    for i, w in enumerate(waits):
        for j in w:
            after.setdefault(j, []).append(i)
    left = [len(w) for w in waits]
    level: list[int | None] = [None] * len(calls)
    ready = [i for i, n in enumerate(left) if not n]
    for i in ready:
        level[i] = 0
    for i in ready:  # grows while it is read
        for k in after.get(i, ()):
            left[k] -= 1
            if left[k] == 0:
                level[k] = 1 + max(level[j] for j in waits[k])
                ready.append(k)
    return level


def _levels_in_task(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["nth", "row", "place"], kind="stable")
    got = levels([(i, list(r)) for i, r in zip(pdf["id"], pdf["refs"])])
    return pd.DataFrame({"row": pdf["row"], "place": pdf["place"], "level": pd.array(got, dtype="Int32")})


def _levels_in_rounds(calls: DataFrame) -> DataFrame:
    """``row, place, level`` of the calls of large conversations."""
    node = F.struct("row", "place").alias("node")
    targets = calls.where("nth = 1").select("conv", F.col("id").alias("ref"), node.alias("to"))
    edges = calls.select("conv", node, F.explode("refs").alias("ref")).join(targets, ["conv", "ref"]).select("node", "to").distinct()
    edges = materialise(edges, "call-edges")
    waits = materialise(edges.groupBy("node").agg(F.count("*").alias("waits"), F.min("to").alias("to")), "call-waits")
    # Each round doubles the steps followed along single references; what still moves after all rounds is a cycle.
    jump = materialise(waits.where("waits = 1").select("node", "to", F.lit(1).cast("long").alias("steps"), F.lit(True).alias("moved")), "call-jumps")
    for _ in range(jump.count().bit_length() + 1):
        far = jump.alias("x").join(jump.select(F.col("node").alias("to"), F.col("to").alias("next"), F.col("steps").alias("more")), "to", "left")
        moved = F.col("next").isNotNull()
        jump = materialise(far.select("node", F.coalesce("next", "to").alias("to"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), moved.alias("moved")), "call-jumps")
        if jump.where("moved").isEmpty():
            break
    single = jump.select("node", F.when(~F.col("moved"), F.col("to")).alias("root"), "steps")
    far = single.select(F.col("node").alias("to"), "root", "steps", F.lit(True).alias("single"))
    several = edges.join(waits.where("waits > 1").select("node", "waits"), "node").join(far, "to", "left")
    several = several.select("node", "waits", F.when(F.col("single"), F.col("root")).otherwise(F.col("to")).alias("root"), F.coalesce("steps", F.lit(0)).alias("steps"))
    several = materialise(several, "call-several")
    every = calls.select(node)
    done = materialise(every.join(waits, "node", "left_anti").select("node", F.lit(0).cast("long").alias("level")), "call-levels")
    while True:
        met = several.join(done.withColumnRenamed("node", "root"), "root").groupBy("node", "waits").agg(F.count("*").alias("met"), F.max(F.col("level") + F.col("steps")).alias("most"))
        fresh = met.where("met = waits").join(done, "node", "left_anti").select("node", (F.col("most") + 1).alias("level"))
        fresh = materialise(fresh, "call-levels")
        if fresh.isEmpty():
            break
        done = done.union(fresh)
    chained = single.join(done.withColumnRenamed("node", "root"), "root").select("node", (F.col("level") + F.col("steps")).alias("level"))
    level = every.join(done.union(chained), "node", "left")
    return level.select("node.row", "node.place", F.col("level").cast("int").alias("level"))


def format_chats(messages: DataFrame, schemas: dict | None = None, in_task: int = IN_TASK) -> DataFrame:
    """``conv_id, turn, n_calls, n_linked, n_orphans, n_duplicates, n_malformed, n_invalid, message`` of every row."""
    known = SCHEMAS if schemas is None else schemas

    @F.pandas_udf(_PARSED)
    def parsed(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for roles, texts in batches:
            yield pd.DataFrame([parse(r, t, known) for r, t in zip(roles, texts)], columns=["message", "malformed", "parts"])

    rows = messages.select(
        "conv_id", "turn", parsed(F.col("role").cast("string"), F.col("text").cast("string")).alias("p")
    ).select(F.monotonically_increasing_id().alias("row"), "conv_id", "turn", "p.*")
    rows = materialise(rows, "chat-rows")  # the numbers stay as written
    conv = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")).alias("conv")
    parts = rows.select("row", conv, "turn", F.explode("parts").alias("x")).select("row", "conv", "turn", "x.*")
    parts = materialise(parts, "chat-parts")
    # The first of an identifier is combined before the shuffle; nth is 1 for it and 2 for all others.
    order = F.struct(F.col("turn").isNull().alias("no"), F.col("turn").alias("turn"), "place", "body", "row")
    first = parts.groupBy("conv", "kind", "id").agg(F.min(order).alias("first")).select("conv", "kind", "id", F.col("first.row").alias("row"), F.col("first.place").alias("place"))
    parts = parts.join(first.withColumn("nth", F.lit(1)), ["conv", "kind", "id", "row", "place"], "left").withColumn("nth", F.coalesce("nth", F.lit(2)))
    parts = materialise(parts, "chat-numbered")
    calls, results = parts.where("kind = 'call'"), parts.where("kind = 'result'")
    order = _order(calls, in_task)
    # The first call and the first result of an identifier meet; other calls stay without a result.
    answered = results.where("nth = 1").select("conv", "id", F.col("body").alias("result"), F.lit(1).alias("nth"))
    linked = calls.join(answered, ["conv", "id", "nth"], "left").join(order, ["row", "place"])
    call = F.struct("rank", "place", "id", "name", F.col("body").alias("arguments"), "errors", "result", (F.col("nth") > 1).alias("again"))
    per_row = linked.groupBy("row").agg(F.sort_array(F.collect_list(call)).alias("calls"))  # one message's calls
    known_calls = calls.where("nth = 1").select("conv", "id", F.lit(1).alias("of"))
    loose = results.join(known_calls, ["conv", "id"], "left").groupBy("row").agg(
        F.count(F.when(F.col("nth") > 1, 1)).alias("repeated"), F.count(F.when((F.col("nth") == 1) & F.col("of").isNull(), 1)).alias("orphans")
    )

    @F.pandas_udf(T.StringType())
    def serialise(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, lists in batches:
            yield pd.Series([_with_calls(m, c) for m, c in zip(texts, lists)], dtype=object)

    count = lambda test: F.coalesce(F.size(F.filter("calls", test)), F.lit(0)).cast("long")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    out = rows.drop("parts").join(per_row, "row", "left").join(loose, "row", "left")
    out = out.withColumn("calls", F.coalesce("calls", F.array().cast(out.schema["calls"].dataType)))
    return out.select(
        "conv_id",
        "turn",
        count(lambda x: F.lit(True)).alias("n_calls"),
        count(lambda x: x["result"].isNotNull()).alias("n_linked"),
        zero("orphans").alias("n_orphans"),
        (count(lambda x: x["again"]) + zero("repeated")).alias("n_duplicates"),
        F.col("malformed").cast("long").alias("n_malformed"),
        count(lambda x: F.size(x["errors"]) > 0).alias("n_invalid"),
        serialise("message", "calls").alias("message"),
    )


def _order(calls: DataFrame, in_task: int) -> DataFrame:
    """``row, place, rank``: the calls' places (from 0) in their conversation's topological order."""
    slim = calls.select("conv", "row", "place", "turn", "id", "refs", "nth")
    sizes = slim.groupBy("conv").agg(F.count("*").alias("calls"), F.max(F.size("refs")).alias("most"))
    slim = materialise(slim.join(sizes, "conv"), "call-order")
    plain = slim.where("most = 0").select("row", "place", F.lit(0).alias("level"))
    tied = slim.where("most > 0")
    kind = "row long, place int, level int"
    small = tied.where(F.col("calls") <= in_task).groupBy("conv").applyInPandas(_levels_in_task, kind)
    level = plain.union(small)
    big = tied.where(F.col("calls") > in_task)
    if not big.isEmpty():
        level = level.union(_levels_in_rounds(big))
    # A call never precedes what it refers to: levels first, then turns.
    order = [F.col("level").asc_nulls_last(), F.col("turn").asc_nulls_last(), "row", "place"]
    placed = materialise(slim.join(level, ["row", "place"]), "call-placed")
    few = placed.where(F.col("calls") <= in_task).withColumn("rank", F.row_number().over(Window.partitionBy("conv").orderBy(*order)) - 1)
    few = few.select("row", "place", "rank")
    many = placed.where(F.col("calls") > in_task).withColumnRenamed("row", "message")
    if many.isEmpty():
        return few
    order[2] = "message"
    many = numbered(many, "conv", *order)
    begin = F.broadcast(many.groupBy("conv").agg(F.min("row").alias("begin")))  # at most one row in in_task calls
    many = many.join(begin, "conv").select(F.col("message").alias("row"), "place", (F.col("row") - F.col("begin")).cast("int").alias("rank"))
    return few.union(many)


def _with_calls(message: str, calls) -> str:
    """The message's canonical JSON with its calls, whose parts are canonical already."""
    if calls is None or not len(calls):
        return message
    out = []
    for c in calls:
        result = "null" if c["result"] is None else c["result"]
        errors = canonical([str(e) for e in c["errors"]])
        out.append(
            f'{{"arguments":{c["arguments"]},"errors":{errors},"id":{canonical(c["id"])},"name":{canonical(c["name"])},"order":{c["rank"]},"result":{result}}}'
        )
    return f'{{"calls":[{",".join(out)}],{message[1:]}'
