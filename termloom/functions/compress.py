"""Variable-byte and Elias-gamma codes of positive integers, and their sizes as columns."""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def vb_encode(numbers) -> bytes:
    """Groups of seven bits, high ones first; the last byte of a number has its top bit set."""
    out = bytearray()
    for n in numbers:
        if n < 0:
            raise ValueError("variable-byte codes need n >= 0")
        groups = [n & 127 | 128]
        while n := n >> 7:
            groups.append(n & 127)
        out += bytes(reversed(groups))
    return bytes(out)


def vb_decode(data: bytes) -> list[int]:
    out, n = [], 0
    for b in data:
        n = n << 7 | b & 127
        if b & 128:
            out.append(n)
            n = 0
    return out


@lru_cache(1 << 16)
def _gamma_bits(n: int) -> str:
    if n < 1:
        raise ValueError("gamma codes need n >= 1")
    return "1" * (n.bit_length() - 1) + "0" + format(n, "b")[1:]


def gamma_encode(numbers) -> tuple[bytes, int]:
    """Bits of unary length and binary rest, filled with zeros to whole bytes; the number of filled bits."""
    text = "".join(map(_gamma_bits, numbers))
    padding = -len(text) % 8
    return int("1" + text + "0" * padding, 2).to_bytes(len(text + "0" * padding) // 8 + 1, "big")[1:], padding


def gamma_decode(data: bytes, padding: int) -> list[int]:
    text = format(int.from_bytes(data, "big"), f"0{len(data) * 8}b")[: len(data) * 8 - padding]
    out, at = [], 0
    while at < len(text):
        size = text.index("0", at) - at
        at += size + 1
        out.append(int("1" + text[at : at + size], 2))
        at += size
    return out


GAMMA = T.StructType([T.StructField("data", T.BinaryType()), T.StructField("padding", T.IntegerType())])


@F.pandas_udf(T.BinaryType())
def vb(numbers: pd.Series) -> pd.Series:
    return numbers.map(lambda x: vb_encode(map(int, x)))


@F.pandas_udf(T.ArrayType(T.LongType()))
def unvb(data: pd.Series) -> pd.Series:
    return data.map(vb_decode)


@F.pandas_udf(GAMMA)
def gamma(numbers: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([gamma_encode(list(map(int, x))) for x in numbers], columns=["data", "padding"])


@F.pandas_udf(T.ArrayType(T.LongType()))
def ungamma(data: pd.Series, padding: pd.Series) -> pd.Series:
    return pd.Series([gamma_decode(d, int(p)) for d, p in zip(data, padding)])


def bit_length(c) -> Column:
    """Binary digits of a positive integer."""
    return F.length(F.bin(c))


def vb_bytes(c) -> Column:
    return F.ceil(F.greatest(bit_length(c), F.lit(1)) / 7).cast("long")


def gamma_bits(c) -> Column:
    return (2 * (bit_length(c) - 1) + 1).cast("long")
