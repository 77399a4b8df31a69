"""The boolean query language: terms, ``&``, ``|``, binary ``-`` and parentheses.

All operators have the same precedence and associate to the right, so ``a - b - c`` is ``a - (b - c)``.
Operators need no spaces around them, but a hyphen inside a word is part of the word.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Term:
    name: str


@dataclass(frozen=True)
class Op:
    sign: str
    left: Term | Op
    right: Term | Op


_TOKEN = re.compile(r"\s*(?:([()&|])|(-)(?=\s|\(|$)|([^\s()&|]+))")


def parse(text: str) -> Term | Op:
    tokens, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m or m.end() == at:
            raise ValueError(f"cannot read {text[at:]!r}")
        tokens.append(m[1] or m[2] or Term(m[3]))
        at = m.end()
    node, rest = _expression(tokens)
    if rest:
        raise ValueError(f"unexpected {rest[0]!r}")
    return node


def _expression(tokens):
    if not tokens:
        raise ValueError("a term is missing")
    head, *rest = tokens
    if head == "(":
        left, rest = _expression(rest)
        if not rest or rest[0] != ")":
            raise ValueError("a parenthesis is open")
        rest = rest[1:]
    elif isinstance(head, Term):
        left = head
    else:
        raise ValueError(f"unexpected {head!r}")
    if rest and rest[0] in ("&", "|", "-"):
        right, after = _expression(rest[1:])
        return Op(rest[0], left, right), after
    return left, rest


def terms(node: Term | Op) -> set[str]:
    return {node.name} if isinstance(node, Term) else terms(node.left) | terms(node.right)


def condition(node: Term | Op, has) -> Column:
    """The query as a condition, with ``has(term)`` for a term's presence."""
    if isinstance(node, Term):
        return has(node.name)
    left, right = condition(node.left, has), condition(node.right, has)
    return {"&": left & right, "|": left | right, "-": left & ~right}[node.sign]


def search(tf: DataFrame, query: str | Term | Op) -> DataFrame:
    """``doc_id`` of the matches by one pass: the query's postings, one aggregation, one condition.

    Every operator's result lies within the union of its terms' documents, so documents without any
    of the terms need not be seen.
    """
    node = parse(query) if isinstance(query, str) else query
    names = sorted(terms(node))
    flags = [F.max((F.col("term") == t).cast("int")).alias(f"t{i}") for i, t in enumerate(names)]
    seen = tf.where(F.col("term").isin(names)).groupBy("doc_id").agg(*flags)
    place = {t: i for i, t in enumerate(names)}
    return seen.where(condition(node, lambda t: F.col(f"t{place[t]}") == 1)).select("doc_id")


def search_by_sets(tf: DataFrame, query: str | Term | Op) -> DataFrame:
    """The same by set operations on posting lists, one a node of the query."""
    node = parse(query) if isinstance(query, str) else query
    if isinstance(node, Term):
        return tf.where(F.col("term") == node.name).select("doc_id").distinct()
    left, right = search_by_sets(tf, node.left), search_by_sets(tf, node.right)
    if node.sign == "&":
        return left.intersect(right)
    return left.union(right).distinct() if node.sign == "|" else left.subtract(right)


def templates(words: list[str]) -> list[str]:
    """Test queries over two or three terms."""
    if len(words) == 2:
        a, b = words
        return [f"{a} | {b}", f"{a} & {b}", f"{a} - {b}"]
    a, b, c = words
    return [f"{a} & {b} & {c}", f"({a} | {b}) - {c}", f"({a} & {b}) | {c}", f"({a} - {b}) | {c}"]
