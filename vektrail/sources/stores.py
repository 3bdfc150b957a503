"""Vector stores as sources: column inference, archives, side files, text vectors, and a Python data source.

Clients of hosted stores are not installed here; each of their layouts is read from
what they export (Parquet, JDBC rows, SQLite files, NumPy archives), with the columns
found by the same ordered candidate names.
"""

from __future__ import annotations

import json
import sqlite3
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from vektrail.functions import vec

# fixed values: column names under which stores keep ids, vectors and texts, in order of preference
ID_NAMES = ("id", "record_id", "doc_id", "vec_id", "uuid", "key", "pk", "_id")
VECTOR_NAMES = ("vector", "embedding", "embeddings", "vec", "v", "values")
TEXT_NAMES = ("text", "document", "content", "chunk", "page_content", "body")


def resolve_columns(names: Sequence[str], identity: str | None = None, vector: str | None = None, text: str | None = None) -> tuple[str, str, str | None]:
    """(id, vector, text) columns: the given ones, else the first candidate present. A missing id or vector is an error."""

    def pick(given: str | None, candidates: Sequence[str], needed: bool) -> str | None:
        if given is not None:
            if given not in names:
                raise KeyError(f"no column {given}; there are {list(names)}")
            return given
        found = next((c for c in candidates if c in names), None)
        if found is None and needed:
            raise KeyError(f"none of {list(candidates)} among {list(names)}")
        return found

    return pick(identity, ID_NAMES, True), pick(vector, VECTOR_NAMES, True), pick(text, TEXT_NAMES, False)


@dataclass(frozen=True)
class Capabilities:
    """What a table allows; derived from its schema."""

    read_vectors: bool
    read_text: bool
    upsert: bool
    filter: bool
    dimension: int | None


def records(rows: DataFrame, **given) -> DataFrame:
    """(id string, v array<double>, text, metadata map) of a store's rows; other columns become metadata."""
    i, v, t = resolve_columns(rows.columns, **given)
    kind = rows.schema[v].dataType.typeName()
    value = vec.from_literal(F.col(v)) if kind == "string" else vec.from_blob(F.col(v)) if kind == "binary" else F.col(v)
    rest = [c for c in rows.columns if c not in (i, v, t)]
    extra = F.map_from_arrays(F.array(*[F.lit(c) for c in rest]), F.array(*[F.col(c).cast("string") for c in rest])) if rest else F.create_map().cast("map<string,string>")
    return rows.select(F.col(i).cast("string").alias("id"), vec.doubles(value).alias("v"), (F.col(t) if t else F.lit(None)).cast("string").alias("text"), extra.alias("metadata"))


def capabilities(rows: DataFrame) -> Capabilities:
    has_text = "text" in rows.columns and not rows.where(F.col("text").isNotNull()).isEmpty()
    size = rows.where(F.col("v").isNotNull()).agg(F.min(F.size("v")).alias("a"), F.max(F.size("v")).alias("b")).first()
    return Capabilities(True, has_text, True, "metadata" in rows.columns, size.a if size.a == size.b else None)


def read_npz(spark: SparkSession, path: str) -> DataFrame:
    """A NumPy archive with ids, vectors and maybe texts; a one-off import of a file the driver can hold."""
    with np.load(path, allow_pickle=False) as z:
        ids, vectors = z["ids"].astype(str), z["vectors"].astype("f4")
        texts = z["texts"].astype(str).tolist() if "texts" in z.files else [None] * len(ids)
    table = pa.table({"id": pa.array(ids.tolist()), "vector": pa.array(list(vectors), pa.list_(pa.float32())), "text": pa.array(texts, pa.string())})
    return spark.createDataFrame(table)


def with_sidecar(spark: SparkSession, vectors: DataFrame, path: str) -> DataFrame:
    """Vectors by row label joined with a JSON side file {"ids": [...], "texts": [...]}."""
    meta = json.loads(spark.read.text(path, wholetext=True).first()[0])
    texts = meta.get("texts") or [None] * len(meta["ids"])
    labels = spark.createDataFrame(list(zip(range(len(meta["ids"])), map(str, meta["ids"]), texts, strict=True)), "label long, id string, text string")
    return vectors.join(labels, "label").drop("label")


def jdbc(spark: SparkSession, url: str, query: str, key: str, low: int, high: int, partitions: int, **options: str) -> DataFrame:
    """A parallel JDBC scan over ranges of a numeric key; the driver class must be on the class path."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=f"({query}) q", partitionColumn=key, lowerBound=str(low), upperBound=str(high), numPartitions=str(partitions), **options)
    return reader.load()


class _Range(InputPartition):
    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


class SqliteReader(DataSourceReader):
    """Reads rowid ranges of an SQLite file as Arrow batches; one range per partition."""

    def __init__(self, schema: StructType, options: dict):
        self.schema, self.path = schema, options["path"]
        self.table, self.parts = options["table"], int(options.get("partitions", "8"))

    def _open(self) -> sqlite3.Connection:
        return sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)

    def partitions(self) -> list[InputPartition]:
        with self._open() as db:
            low, high = db.execute(f'SELECT min(rowid), max(rowid) FROM "{self.table}"').fetchone()
        if low is None:
            return [_Range(0, -1)]
        step = max(1, -(-(high - low + 1) // self.parts))
        return [_Range(a, min(high, a + step - 1)) for a in range(low, high + 1, step)]

    def read(self, part: InputPartition) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(self.schema)
        names = ", ".join(f'"{f.name}"' for f in self.schema.fields)
        with self._open() as db:
            got = db.execute(f'SELECT {names} FROM "{self.table}" WHERE rowid BETWEEN ? AND ?', (part.low, part.high))
            while rows := got.fetchmany(4_096):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


class SqliteSource(DataSource):
    """``spark.read.format("sqlite").option("path", file).option("table", t).schema(...)``; the file must be on shared storage."""

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> str:
        raise ValueError("give the schema with .schema(...)")

    def reader(self, schema: StructType) -> DataSourceReader:
        return SqliteReader(schema, self.options)


def register(spark: SparkSession) -> None:
    """Make the Python data sources known to a session."""
    spark.dataSource.register(SqliteSource)
