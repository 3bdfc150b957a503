"""Vector expressions over array columns; all but float16 stay in the JVM.

Null vectors give null. Products are formed in double precision.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

FLOATS = T.ArrayType(T.FloatType())  # types as objects: workers import this module without a session
FLOOR = 1e-12  # least norm a vector is divided by, so that a zero vector stays zero


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def with_each(v: Column, value: Column, body) -> Column:
    """``body(x, value)`` for each element x; ``value`` is computed once per row, not once per element.

    No lambda is nested in another one: Python UDFs over nested lambdas are not planned.
    """
    return F.zip_with(v, F.array_repeat(value, F.size(v)), body)


def dot(a: Column, b: Column) -> Column:
    """Inner product over the common length; a null element makes it null."""
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def l2_normalize(v: Column) -> Column:
    """Unit vector; the zero vector stays zero and an empty one empty."""
    v = doubles(v)
    return with_each(v, F.greatest(norm(v), F.lit(FLOOR)), lambda x, size: x / size)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.greatest(norm(a), F.lit(FLOOR)) * F.greatest(norm(b), F.lit(FLOOR)))


def pad_or_truncate(v: Column, dim: int) -> Column:
    """Exactly ``dim`` elements: cut at the end or filled with zeros."""
    v = doubles(v)
    return F.slice(F.concat(v, F.array_repeat(F.lit(0.0), dim)), 1, dim)


def truncate(v: Column, dim: int) -> Column:
    """The first ``dim`` elements as a unit vector; unchanged if it is no longer than that."""
    return F.when(F.size(v) <= dim, doubles(v)).otherwise(l2_normalize(F.slice(v, 1, dim)))


def quantize_int8(v: Column) -> Column:
    """Symmetric per-vector 8-bit codes, given back as numbers; zero vectors stay zero."""
    v = doubles(v)
    top = F.array_max(F.transform(v, lambda x: F.abs(x)))
    return with_each(v, top, lambda x, t: F.when(t > 0, F.rint(x / t * 127.0) / 127.0 * t).otherwise(x))


def quantize_binary(v: Column) -> Column:
    """Signs: 1 for elements of 0 and more, else -1."""
    return F.transform(doubles(v), lambda x: F.when(x >= 0, 1.0).otherwise(-1.0))


@F.pandas_udf(FLOATS)
def quantize_float16(v: pd.Series) -> pd.Series:
    """Rounded to half precision; Spark has no such type, hence Arrow."""
    return v.map(lambda x: None if x is None else np.asarray(x, "f4").astype("f2").astype("f4"))


def quantize(v: Column, precision: str) -> Column:
    """``v`` as stored at one of float32, float16, int8 and binary."""
    if precision == "float32":
        return doubles(v)
    if precision == "float16":
        return doubles(quantize_float16(v.cast("array<float>")))
    if precision == "int8":
        return quantize_int8(v)
    if precision == "binary":
        return quantize_binary(v)
    raise ValueError(f"unknown precision: {precision}")


# fixed values: bytes of one stored element
BYTES = {"float32": 4.0, "float16": 2.0, "int8": 1.0, "binary": 0.125}


def literal(v: Column, digits: int = 6) -> Column:
    """Text form ``[1.5,2.0]`` with a fixed number of decimals."""
    return F.concat(F.lit("["), F.array_join(F.transform(doubles(v), lambda x: F.format_string(f"%.{digits}f", x)), ","), F.lit("]"))


def from_literal(text: Column) -> Column:
    """Vector of a text form; unreadable text gives null."""
    return F.from_json(text, "array<double>")


@F.pandas_udf(T.BinaryType())
def to_blob(v: pd.Series) -> pd.Series:
    """Little-endian 32-bit floats."""
    return v.map(lambda x: None if x is None else np.asarray(x, "<f4").tobytes())


@F.pandas_udf(FLOATS)
def from_blob(b: pd.Series) -> pd.Series:
    """Vector of a blob; a length that is no multiple of four gives null."""
    return b.map(lambda x: None if x is None or len(x) % 4 else np.frombuffer(x, "<f4"))


def average(rows, by: list[str], v: str, out: str, dim: int):
    """Element-wise mean of the vectors of each group, as one map-side combined aggregate per element."""
    got = rows.groupBy(*by).agg(*[F.avg(F.element_at(doubles(F.col(v)), i + 1)).alias(f"_{i}") for i in range(dim)])
    return got.select(*by, F.array(*[F.col(f"_{i}") for i in range(dim)]).alias(out))
