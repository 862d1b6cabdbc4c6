"""Token ids as bit-shuffled, compressed chunks with a chunk index.

Documents in ascending doc_id order form shards (range partitions); the ids of a shard are one stream,
cut into chunks of a fixed number of ids. A chunk's ids are transposed into planes, plane b holding
bit b of every id (eight ids a byte) or, with unit="byte", byte b of every id. Each plane is compressed
with zstandard; planes of zeros beyond the largest id are not stored. The index row of a chunk has its
shard, its place in it, the number of ids and the documents that begin in it, so one chunk can be read
without the others.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from claimcheck.llm.common import shuffle_partitions
from claimcheck.llm.encoding import library_encoder

CHUNK_IDS = 1 << 16
FORMAT = "shard int, chunk int, n_ids int, unit string, planes array<binary>, docs array<struct<doc_id:long,start:long,n_tokens:long>>"


def to_planes(ids: np.ndarray, unit: str = "bit", level: int = 3) -> list[bytes]:
    """Compressed planes of unsigned 32-bit ids, lowest first, as many as the largest id needs."""
    width = int(ids.max(initial=0)).bit_length()
    press = zstandard.ZstdCompressor(level=level).compress
    if unit == "byte":
        return [press(((ids >> (8 * b)) & 255).astype(np.uint8).tobytes()) for b in range(-(-width // 8))]
    return [press(np.packbits((ids >> b & 1).astype(np.uint8), bitorder="little").tobytes()) for b in range(width)]


def from_planes(planes: list[bytes], n: int, unit: str = "bit") -> np.ndarray:
    """The n ids of a chunk."""
    ids, raw = np.zeros(n, dtype="<u4"), zstandard.ZstdDecompressor().decompress
    for b, plane in enumerate(planes):
        flat = np.frombuffer(raw(plane), dtype=np.uint8)
        ids |= flat.astype("<u4") << 8 * b if unit == "byte" else np.unpackbits(flat, count=n, bitorder="little").astype("<u4") << b
    return ids


def write_ids(docs: DataFrame, path: str, folder: str, end_id: int | None = 0, chunk_ids: int = CHUNK_IDS, unit: str = "bit") -> None:
    """Encodes all documents with the tokenizer at path and writes shards of chunks to folder.

    A null text counts as empty (its ids are the end id alone). Null doc_ids come first; repeated ones
    follow each other in the order of their texts. Other columns are ignored.
    """
    end = b"" if end_id is None else end_id.to_bytes(4, "little")
    schema = pa.schema([("shard", pa.int32()), ("chunk", pa.int32()), ("n_ids", pa.int32()), ("unit", pa.string()), ("planes", pa.list_(pa.binary())), ("docs", pa.list_(pa.struct([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])))])

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard = library_encoder(path), TaskContext.get().partitionId()
        rest, begun, start, chunk = bytearray(), [], 0, 0

        def cut(n: int) -> pa.RecordBatch:
            nonlocal begun, chunk
            ids, limit = np.frombuffer(bytes(rest[: 4 * n]), dtype="<u4"), (chunk * chunk_ids) + n
            del rest[: 4 * n]
            here = [d for d in begun if d["start"] < limit]
            begun = begun[len(here) :]
            row = {"shard": shard, "chunk": chunk, "n_ids": n, "unit": unit, "planes": to_planes(ids, unit), "docs": here}
            chunk += 1
            return pa.RecordBatch.from_pylist([row], schema=schema)

        for batch in batches:
            for at in range(0, batch.num_rows, 4000):
                part = batch.slice(at, 4000)
                for doc_id, ids in zip(part.column(0).to_pylist(), encoder.encode(part.column(1)), strict=True):
                    n = (len(ids) + len(end)) // 4
                    begun.append({"doc_id": doc_id, "start": start, "n_tokens": n})
                    rest += ids
                    rest += end
                    start += n
                    while len(rest) >= 4 * chunk_ids and start > (chunk + 1) * chunk_ids:
                        yield cut(chunk_ids)
        if begun or rest:
            yield cut(len(rest) // 4)

    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    ordered = texts.repartitionByRange(shuffle_partitions(docs.sparkSession), F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())
    ordered.mapInArrow(chunks, FORMAT).write.option("compression", "uncompressed").parquet(folder)


def read_ids(spark: SparkSession, folder: str, per_document=None, fields: str = "ids binary") -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and the values of per_document(ids as bytes).

    Reads the chunks of each shard in order; a document's ids are put together over chunk borders. The
    shards' first places come from the index alone, one row per shard.
    """
    chunks = spark.read.schema(FORMAT).parquet(folder)
    shards = chunks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = F.coalesce(F.sum("n").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    first = shards.select("shard", before.cast("long").alias("first"))
    values = per_document or (lambda ids: (ids,))

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, stream, at, waiting = None, bytearray(), 0, []
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["shard"] != shard:
                    shard, stream, at, waiting = row["shard"], bytearray(), 0, []
                stream += from_planes(row["planes"], row["n_ids"], row["unit"]).tobytes()
                waiting += row["docs"]
                done = taken = 0
                for d in waiting:
                    if d["start"] + d["n_tokens"] > at + len(stream) // 4:
                        break
                    lo = 4 * (d["start"] - at)
                    taken = lo + 4 * d["n_tokens"]
                    out.append((d["doc_id"], shard, d["start"], d["n_tokens"], *values(bytes(stream[lo:taken]))))
                    done += 1
                del waiting[:done]
                del stream[:taken]
                at += taken // 4
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructType

    schema = f"doc_id long, shard int, start long, n_tokens long, {fields}"
    parsed = StructType.fromDDL(schema)
    kinds, names = [to_arrow_type(f.dataType) for f in parsed], parsed.fieldNames()
    ordered = chunks.repartitionByRange(shuffle_partitions(spark), "shard").sortWithinPartitions("shard", "chunk")
    found = ordered.mapInArrow(documents, schema).join(first, "shard")
    return found.select("doc_id", (F.col("first") + F.col("start")).alias("start"), "n_tokens", *names[4:])


def crc_of_ids(ids: bytes) -> tuple[int]:
    return (crc32(ids),)
