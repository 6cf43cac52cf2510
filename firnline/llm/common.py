"""Reading tables, keeping intermediate results in the shared folder, and mapping texts batch by batch."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from firnline.session import shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write df below the shared folder and read it back: lineage ends there, and lost executors cost no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remainder(n: int, column: str = "doc_id"):
    """crc32 of the id written as text, modulo n."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def crc(data: bytes) -> int:
    return zlib.crc32(data) & 0xFFFFFFFF


def map_batches(df: DataFrame, work: Callable[[pa.RecordBatch], Iterator[dict]], schema: str) -> DataFrame:
    """Apply work to each Arrow batch of df; each dict of columns that it yields becomes a batch of the result."""
    kinds = T.StructType.fromDDL(schema)
    arrow = _arrow_schema(kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                for out in work(batch):
                    yield record_batch(out, arrow)

    return df.mapInArrow(run, kinds)


def record_batch(columns: dict, arrow: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c.cast(f.type) if isinstance(c := columns[f.name], pa.Array | pa.ChunkedArray) else pa.array(c, type=f.type) for f in arrow], schema=arrow
    )


def add_column(df: DataFrame, text_col: str, work: Callable[[pa.Array], Iterator[tuple]], name: str, kind: str) -> DataFrame:
    """df with one more column; work yields runs of texts (with their place and length) and their values."""
    schema = T.StructType([*df.schema.fields, *T.StructType.fromDDL(f"`{name}` {kind}").fields])
    arrow = _arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, values in work(column(batch, text_col)):
                rows = batch.slice(part.first, len(part))
                yield pa.RecordBatch.from_arrays([*(c.cast(f.type) for c, f in zip(rows.columns, arrow)), pa.array(values).cast(arrow[-1].type)], schema=arrow)

    return df.mapInArrow(run, schema)


def _arrow_schema(kinds) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(kinds)


def spread(df: DataFrame, rows_per_task: int, n_rows: int) -> int:
    """Number of partitions for n_rows: the session's, or more where tasks would get over rows_per_task."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n_rows // rows_per_task))


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


class WordCache:
    """Values of words, made for many new words at once. Of the words met most lately about `size` are remembered."""

    def __init__(self, size: int, make: Callable[[list[str]], list]):
        self.size, self.make = size, make
        self.known: dict = {}
        self.before: dict = {}

    def of(self, words: set[str]) -> dict:
        """A dictionary that has all of these words."""
        fresh = words.difference(self.known)
        if len(self.known) + len(fresh) > self.size:
            self.known, self.before, fresh = {}, self.known, words
        if self.before:
            met = self.before.keys() & fresh
            self.known.update((w, self.before[w]) for w in met)
            fresh = fresh - met
        new = list(fresh)
        self.known.update(zip(new, self.make(new)))
        return self.known
