"""Token-id files with Elias-Fano document boundaries.

Documents in ascending order of their id are encoded and laid end to end. A file is one shard: a fixed header, the boundaries of its
documents and their ids as two Elias-Fano sequences, and the concatenated token ids in 16 bits (32 where the vocabulary needs them).
An Elias-Fano sequence keeps the low bits of each value as they are and the high bits in unary; `select` finds a value from one 32-bit
position per 256 values and a look at the bits between two of them, so there is no table of 64-bit offsets and the boundaries take
about 2 + log2(ids per document) bits each.

Writing is one move of texts: range partitions by id, sorted, encoded and cut into shards in the tasks. A task's shards know how many ids
its part holds before them, and a manifest with one row per part (ids and documents before it) makes that the place in the whole.
Files are written by Spark's text sink, one record per file, so that a lost executor's attempt leaves nothing behind; its line end
is the last byte of a file. They are read by Spark's binary file source.

Defined cases: NULL or empty texts are one end id; rows with a NULL id come first; repeated ids are documents of their own, in the order
of their texts' hash; an empty table gives no shard and an empty result; a document longer than a shard makes a longer shard; other
columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from firnline.llm.common import column, crc, spread
from firnline.llm.packing import ChunkEncoder

END_ID = 1
#: Token ids of a shard, about; a shard ends with the document that reaches them. And documents of a shard.
SHARD_IDS = 1 << 24
SHARD_DOCS = 1 << 20
#: Documents that are sorted and encoded in a task, about, and texts that are encoded together.
TASK_DOCS = 20_000
TEXTS = 512

MAGIC = b"firnids1"
#: part, shard, documents, documents without id, ids in the part before the shard, ids, bytes per id, bytes of boundaries, of document ids, crc32 of all after the header.
HEADER = struct.Struct("<8sIIIIQQIQQI")
LINE_END = "\n"


def _pack_bits(values: np.ndarray, width: int) -> bytes:
    """The lowest `width` bits of each value, end to end."""
    if not width:
        return b""
    shifts, out = np.arange(width, dtype=np.uint64), []
    for lo in range(0, len(values), 1 << 14):
        bits = (values[lo : lo + (1 << 14), None] >> shifts) & np.uint64(1)
        out.append(np.packbits(bits.astype(np.uint8), bitorder="little").tobytes())
    return b"".join(out)


class EliasFano:
    """A non-decreasing sequence of integers; see the module."""

    #: Values between two kept positions.
    EVERY = 256
    #: Values, low bits of each, bytes of low and high bits, and the first value.
    HEAD = struct.Struct("<IIQQq")

    def __init__(self, data: bytes):
        self.n, self.width, low, high, self.first = self.HEAD.unpack_from(data)
        at = self.HEAD.size
        self.low = np.frombuffer(data, dtype=np.uint8, count=low, offset=at)
        self.high = np.frombuffer(data, dtype=np.uint8, count=high, offset=at + low)
        self.kept = np.frombuffer(data, dtype="<u4", offset=at + low + high)

    @classmethod
    def encode(cls, values: np.ndarray) -> bytes:
        """Bytes of a non-decreasing int64 array (the span of its values may exceed 2**63)."""
        n = len(values)
        if not n:
            return cls.HEAD.pack(0, 0, 0, 0, 0)
        above = values.astype(np.uint64) - np.uint64(values[0])
        width = max(0, (int(above[-1]) // n).bit_length() - 1)
        ones = (above >> np.uint64(width)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(ones[-1]) + 1, dtype=np.uint8)
        bits[ones] = 1
        low, high = _pack_bits(above, width), np.packbits(bits, bitorder="little").tobytes()
        return cls.HEAD.pack(n, width, len(low), len(high), int(values[0])) + low + high + ones[:: cls.EVERY].astype("<u4").tobytes()

    def _block(self, k: int) -> np.ndarray:
        """Values of numbers k * EVERY to (k + 1) * EVERY, above the first one."""
        lo, end = int(self.kept[k]), int(self.kept[k + 1]) if k + 1 < len(self.kept) else 8 * len(self.high)
        bits = np.unpackbits(self.high[lo >> 3 : (end + 7) >> 3], bitorder="little")
        ones = np.flatnonzero(bits[lo & 7 : (lo & 7) + end - lo]) + lo
        out = (ones - (k * self.EVERY + np.arange(len(ones)))).astype(np.uint64) << np.uint64(self.width)
        if self.width:
            at = k * self.EVERY * self.width // 8
            bits = np.unpackbits(self.low[at : at + (len(ones) * self.width + 7) // 8], count=len(ones) * self.width, bitorder="little")
            out += bits.reshape(-1, self.width).astype(np.uint64) @ (np.uint64(1) << np.arange(self.width, dtype=np.uint64))
        return out

    def select(self, numbers: np.ndarray) -> np.ndarray:
        """Values (int64) of these numbers, from 0; only the bits around them are read."""
        numbers = np.asarray(numbers, dtype=np.int64)
        order = np.argsort(numbers, kind="stable")
        blocks, starts = np.unique(numbers[order] // self.EVERY, return_index=True)
        out = np.empty(len(numbers), dtype=np.uint64)
        for k, which in zip(blocks.tolist(), np.split(order, starts[1:])):
            out[which] = self._block(k)[numbers[which] % self.EVERY]
        return (out + np.int64(self.first).astype(np.uint64)).view(np.int64)


class Shard:
    """A file's content; documents are numbered from 0 in the order of their ids."""

    def __init__(self, data: bytes):
        magic, self.part, self.number, self.n_docs, self.n_null, self.before, self.n_ids, width, bounds, names, check = HEADER.unpack_from(data)
        body = memoryview(data)[HEADER.size : HEADER.size + bounds + names + width * self.n_ids]
        if magic != MAGIC or zlib.crc32(body) != check:
            raise ValueError("not a whole shard of token ids")
        self.bounds, self.names = EliasFano(body[:bounds]), EliasFano(body[bounds : bounds + names])
        self.ids = np.frombuffer(body, dtype=f"<u{width}", offset=bounds + names)

    @staticmethod
    def encode(part: int, number: int, before: int, names: list[int | None], lengths: list[int], ids: bytes, width: int) -> bytes:
        """names are the documents' ids in order, those without one first; ids has little-endian 32-bit ids."""
        n_null = sum(i is None for i in names)
        bounds = EliasFano.encode(np.cumsum([0, *lengths]))
        own = EliasFano.encode(np.array(names[n_null:], dtype=np.int64))
        body = bounds + own + np.frombuffer(ids, dtype="<u4").astype(f"<u{width}").tobytes()
        head = HEADER.pack(MAGIC, part, number, len(names), n_null, before, len(ids) // 4, width, len(bounds), len(own), zlib.crc32(body))
        return head + body

    def doc_ids(self) -> list[int | None]:
        return [None] * self.n_null + self.names.select(np.arange(self.n_docs - self.n_null)).tolist()

    def document(self, number: int) -> np.ndarray:
        """Token ids of one document."""
        lo, hi = self.bounds.select([number, number + 1])
        return self.ids[lo:hi]


@lru_cache(maxsize=1)
def _encoder(path: str) -> ChunkEncoder:
    return ChunkEncoder(path)


def write(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = END_ID, shard_ids: int = SHARD_IDS, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the shards below path/shards and the manifest to path/parts."""
    spark = docs.sparkSession
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer_path)
        width = 2 if max(len(encoder.ends), end_id + 1) <= 1 << 16 else 4
        part, number, before = TaskContext.get().partitionId(), 0, 0
        names: list[int | None] = []
        lengths: list[int] = []
        ids, size = [], 0

        def shard() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"shard": [Shard.encode(part, number, before, names, lengths, b"".join(ids), width)]})

        for batch in batches:
            for lo in range(0, batch.num_rows, TEXTS):
                texts = [t or "" for t in column(batch, "text").slice(lo, TEXTS).to_pylist()]
                for name, made in zip(column(batch, "doc_id").slice(lo, TEXTS).to_pylist(), encoder.encode(texts)):
                    names.append(name)
                    ids += (made, end)
                    lengths.append(len(made) // 4 + 1)
                    size += lengths[-1]
                    if size >= shard_ids or len(names) == SHARD_DOCS:
                        yield shard()
                        number, before = number + 1, before + size
                        names, lengths, ids, size = [], [], [], 0
        if names:
            yield shard()

    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    # Rows of one id are told apart by their texts' hash and then by row, so that none of their copies is bound to one task.
    given = given.withColumn("tie", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())
    order = [F.asc_nulls_first("doc_id"), F.asc("tie"), F.asc("row")]
    parts = spread(docs, TASK_DOCS, docs.count())
    dealt = given.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "text")
    # The cast keeps the bytes as they are, and so does the sink.
    shards = dealt.mapInArrow(run, "shard binary").select(F.col("shard").cast("string").alias("value"))
    shards.write.option("maxRecordsPerFile", 1).option("lineSep", LINE_END).text(f"{path}/shards")
    heads = _files(spark, path).select(F.substring("content", 1, HEADER.size).alias("head")).mapInArrow(_heads, HEADS)
    totals = heads.groupBy("part").agg(F.max("ids").alias("n_ids"), F.sum("docs").alias("n_docs"))
    # One row per task that wrote.
    so_far = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    placed = totals.withColumn("ids_before", F.coalesce(F.sum("n_ids").over(so_far), F.lit(0))).withColumn("docs_before", F.coalesce(F.sum("n_docs").over(so_far), F.lit(0)))
    placed.write.parquet(f"{path}/parts")


def _files(spark: SparkSession, path: str) -> DataFrame:
    # A write without rows leaves one empty file.
    return spark.read.format("binaryFile").load(f"{path}/shards").filter(F.col("length") > 0)


HEADS = "part long, number long, ids long, docs long"


def _heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        heads = [HEADER.unpack(h) for h in column(batch, "head").to_pylist()]
        yield pa.RecordBatch.from_pydict({"part": [h[1] for h in heads], "number": [h[2] for h in heads], "ids": [h[5] + h[6] for h in heads], "docs": [h[3] for h in heads]})


def read(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files at path, and its ids if asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in column(batch, "content"):
                shard = Shard(data.as_py())
                names = pa.array(shard.doc_ids(), pa.int64())
                for lo in range(0, shard.n_docs, TEXTS):
                    bounds = shard.bounds.select(np.arange(lo, min(lo + TEXTS, shard.n_docs) + 1))
                    ids = shard.ids[bounds[0] : bounds[-1]].astype("<u4")
                    cuts = (bounds - bounds[0]).tolist()
                    bytes_of = memoryview(ids.tobytes())
                    out = [
                        pa.array(np.full(len(cuts) - 1, shard.part)), names.slice(lo, TEXTS), pa.array(shard.before + bounds[:-1]), pa.array(np.diff(bounds)),
                        pa.array([crc(bytes_of[4 * a : 4 * b]) for a, b in zip(cuts, cuts[1:])], pa.int64()),
                    ]
                    if with_ids:
                        out.append(pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(ids.view(np.int32))))
                    yield pa.RecordBatch.from_arrays(out, names=["part", "doc_id", "inside", "n_tokens", "ids_crc32", "ids"][: len(out)])

    schema = "part long, doc_id long, inside long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    found = _files(spark, path).select("content").mapInArrow(run, schema)
    parts = spark.read.parquet(f"{path}/parts").select("part", "ids_before")
    placed = found.join(parts, "part").withColumn("start", F.col("ids_before") + F.col("inside"))
    return placed.select("doc_id", "start", "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))


def document(spark: SparkSession, path: str, number: int) -> list[int] | None:
    """Token ids of the document with this number (from 0, in the order of ids), from the one part and shard that hold it; None if there is none."""
    part = spark.read.parquet(f"{path}/parts").filter((F.col("docs_before") <= number) & (F.col("docs_before") + F.col("n_docs") > number)).first()
    if part is None:
        return None
    head, at = F.substring("content", 1, HEADER.size), number - part["docs_before"]
    own = _files(spark, path).filter(F.substring("content", 9, 4) == F.lit(struct.pack("<I", part["part"])))
    for shard in own.select(head.alias("head")).mapInArrow(_heads, HEADS).orderBy("number").toLocalIterator():
        if at < shard["docs"]:
            [held] = own.filter(F.substring("content", 13, 4) == F.lit(struct.pack("<I", shard["number"]))).select("content").collect()
            return Shard(bytes(held["content"])).document(at).tolist()
        at -= shard["docs"]
    return None
