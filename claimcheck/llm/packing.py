"""Packing by power-of-two decomposition: every sequence is one piece of one document.

A document of n ids (its end id included) becomes n // max_length pieces of max_length ids and, for the
rest, one piece per binary digit of it, longest first. Pieces of one length share a bucket (a partition
folder of the written table). No sequence crosses documents and none needs padding. Ids never move
between machines: pieces are cut where the text is read.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimcheck.llm.common import shared_folder
from claimcheck.llm.encoding import library_encoder

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


def binary_lengths(n: int, longest: int) -> list[int]:
    """Lengths of the pieces of n ids: longest is a power of two."""
    return [longest] * (n // longest) + [1 << b for b in range(longest.bit_length() - 2, -1, -1) if n % longest >> b & 1]


def cut_pieces(docs: DataFrame, path: str, max_length: int = 1024, end_id: int = 0) -> DataFrame:
    """The pieces of all documents, with their ids (little-endian unsigned 32-bit).

    A null text counts as empty (its piece is the end id alone); null and repeated doc_ids are kept as
    they are. sequence_id numbers the sequences inside each input partition, with the partition's number
    in the upper bits; it is fixed once the pieces are written.
    """
    if max_length < 1 or max_length & max_length - 1:
        raise ValueError("max_length must be a power of two")
    end = end_id.to_bytes(4, "little")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, sequence = library_encoder(path), TaskContext.get().partitionId() << 40
        for batch in batches:
            for at in range(0, batch.num_rows, 4000):
                part, out = batch.slice(at, 4000), []
                for doc_id, ids in zip(part.column(0).to_pylist(), encoder.encode(part.column(1)), strict=True):
                    ids, start = ids + end, 0
                    n = len(ids) // 4
                    for length in binary_lengths(n, max_length):
                        piece = ids[4 * start : 4 * (start + length)]
                        out.append((doc_id, start, length, crc32(piece), n, sequence, 0, piece))
                        start, sequence = start + length, sequence + 1
                columns = [pa.array(c, pa.binary() if i == 7 else pa.int64()) for i, c in enumerate(zip(*out, strict=True))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(rows, PIECE)


def pack(docs: DataFrame, path: str, max_length: int = 1024, end_id: int = 0, folder: str | None = None) -> DataFrame:
    """Writes the sequences to a folder, one sub-folder per length, and returns them as read from it."""
    folder = folder or shared_folder(docs.sparkSession)
    pieces = cut_pieces(docs, path, max_length, end_id)
    pieces.write.partitionBy("length").option("compression", "zstd").parquet(folder)
    found = docs.sparkSession.read.schema(pieces.schema).parquet(folder)
    return found.select(*[F.col(c) for c in pieces.columns])
