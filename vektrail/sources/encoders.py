"""Encoders of texts and their profiles.

An encoder maps a DataFrame (key, text) to (key, v). Model back ends are not installed
here; what they share is the registry, the profile and the two encoders below.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_WORD = re.compile(r"[A-Za-z0-9]+")


@dataclass(frozen=True)
class Profile:
    """How a model wants its texts: prefixes by kind, normalisation, dimension."""

    model_id: str
    dim: int
    query_prefix: str = ""
    document_prefix: str = ""
    normalize: bool = True
    pooling: str = "mean"

    def fingerprint(self) -> str:
        """SHA-256 over the sorted fields."""
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True).encode()).hexdigest()


def prefixed(text: Column, kind: Column, profile: Profile) -> Column:
    return F.concat(F.when(kind == "query", F.lit(profile.query_prefix)).otherwise(F.lit(profile.document_prefix)), text)


def profile_table(spark: SparkSession, profiles: list[Profile]) -> DataFrame:
    """Profiles as a small dimension table with their fingerprints."""
    return spark.createDataFrame([(*asdict(p).values(), p.fingerprint()) for p in profiles], "model_id string, dim int, query_prefix string, document_prefix string, normalize boolean, pooling string, fingerprint string")


def precomputed(texts: DataFrame, known: DataFrame) -> DataFrame:
    """Vectors looked up by text; a text that is not known is an error."""
    got = texts.join(known.select("text", "v"), "text", "left")
    missing = F.raise_error(F.concat(F.lit("no vector for key "), F.col("key").cast("string")))
    return got.select("key", F.when(F.col("v").isNotNull(), F.col("v")).otherwise(missing.cast("array<double>")).alias("v"))


def hashing(dim: int = 64) -> Callable[[DataFrame], DataFrame]:
    """A stand-in model: words counted in ``dim`` buckets by MD5, as a unit vector; null text gives null."""

    def vector(text: str) -> np.ndarray:
        v = np.zeros(dim)
        for w in _WORD.findall(text.lower()):
            v[int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % dim] += 1
        return v / max(1e-12, float(np.linalg.norm(v)))

    def encode(rows: DataFrame) -> DataFrame:
        @F.pandas_udf("array<double>")
        def run(parts: pd.Series) -> pd.Series:
            return parts.map(lambda t: None if t is None else vector(t))

        return rows.select("key", run("text").alias("v"))

    return encode


_REGISTRY: dict[str, Callable] = {"hashing": hashing}


def register_encoder(name: str, factory: Callable) -> None:
    """Plug in a back end; a name that is taken is an error."""
    if name in _REGISTRY:
        raise ValueError(f"encoder {name} exists")
    _REGISTRY[name] = factory


def open_encoder(name: str, **options) -> Callable[[DataFrame], DataFrame]:
    if name not in _REGISTRY:
        raise KeyError(f"no encoder {name}; there are {sorted(_REGISTRY)}")
    return _REGISTRY[name](**options)
