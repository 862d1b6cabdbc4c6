"""Byte-pair encoding by a queue of merge ranks, and decoding.

The symbols of a piece are a doubly linked list over arrays; a heap holds (rank, place, left, right)
of every neighbouring pair that can merge. The lowest rank, and of equal ranks the leftmost, merges
first. An entry whose symbols have changed since it was pushed is stale and skipped.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from claimcheck.llm.encoding import WordEncoder

#: Fixed value: the pattern by which this vocabulary's texts are split before merging.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_TABLES: dict[str, MergeTable] = {}


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary: itself if printable, else the next free one from 256."""
    printable = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    letters, free = [""] * 256, 256
    for byte in range(256):
        if byte in printable:
            letters[byte] = chr(byte)
        else:
            letters[byte] = chr(free)
            free += 1
    return letters


@dataclass
class MergeTable:
    """Vocabulary and merges of one tokenizer file."""

    single: list[int]
    merges: dict[int, tuple[int, int]]
    strings: list[bytes]
    special: dict[str, int]
    encoder: WordEncoder = field(init=False)

    @classmethod
    def load(cls, path: str) -> MergeTable:
        if path not in _TABLES:
            with open(path, encoding="utf-8") as f:
                content = json.load(f)
            vocab, letters = content["model"]["vocab"], _byte_letters()
            special = {t["content"]: t["id"] for t in content["added_tokens"]}
            byte_of = {letter: byte for byte, letter in enumerate(letters)}
            strings = [b""] * (1 + max([*vocab.values(), *special.values()]))
            for string, i in [*vocab.items(), *special.items()]:
                strings[i] = bytes(byte_of[c] for c in string) if all(c in byte_of for c in string) else string.encode()
            merges = {}
            for rank, pair in enumerate(content["model"]["merges"]):
                left, right = pair if isinstance(pair, list) else pair.split(" ")
                merges[vocab[left] << 32 | vocab[right]] = (rank, vocab[left + right])
            _TABLES[path] = cls([vocab[x] for x in letters], merges, strings, special)
        return _TABLES[path]

    def __post_init__(self):
        import regex

        self.pieces = regex.compile(PIECES)
        self.specials = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.known: dict[str, bytes] = {}
        self.encoder = WordEncoder(lambda words: [self._word(w) for w in words])

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one piece, merged by rank."""
        merges, ids = self.merges, [self.single[b] for b in piece]
        n = len(ids)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        queue = []
        for i in range(n - 1):
            if (found := merges.get(ids[i] << 32 | ids[i + 1])) is not None:
                queue.append((found[0], i, ids[i], ids[i + 1], found[1]))
        heapq.heapify(queue)
        while queue:
            _, i, left, right, merged = heapq.heappop(queue)
            j = after[i]
            if ids[i] != left or j < 0 or ids[j] != right:
                continue
            ids[i], ids[j] = merged, -1
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                if (found := merges.get(merged << 32 | ids[k])) is not None:
                    heapq.heappush(queue, (found[0], i, merged, ids[k], found[1]))
            h = before[i]
            if h >= 0 and (found := merges.get(ids[h] << 32 | merged)) is not None:
                heapq.heappush(queue, (found[0], h, ids[h], merged, found[1]))
        return [i for i in ids if i >= 0]

    def _piece(self, piece: str) -> bytes:
        if len(self.known) > 200_000:
            self.known.clear()
        found = self.known[piece] = b"".join(i.to_bytes(4, "little") for i in self.merge(piece.encode()))
        return found

    def _plain(self, text: str) -> bytes:
        known = self.known
        return b"".join([known.get(p) or self._piece(p) for p in self.pieces.findall(text)])

    def _word(self, text: str) -> bytes:
        """The ids of a word; strings of special tokens in it stand for these tokens."""
        if self.specials is None or not (found := list(self.specials.finditer(text))):
            return self._plain(text)
        out, at = [], 0
        for m in found:
            out += [self._plain(text[at : m.start()]), self.special[m[0]].to_bytes(4, "little")]
            at = m.end()
        return b"".join([*out, self._plain(text[at:])])

    def decode(self, ids: bytes) -> str:
        """The concatenated vocabulary strings; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.strings.__getitem__, memoryview(ids).cast("I"))).decode("utf-8", "replace")


ENCODED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("ids", T.BinaryType())])


def encode(docs: DataFrame, path: str, per_row) -> DataFrame:
    """One row (doc_id, values of per_row(table, ids)) for each document, in the scan of the texts.

    per_row is a pair (fields of the result, function of a MergeTable and the list of ids as bytes that
    returns one list per field). A null text counts as empty; repeated and null doc_ids are kept.
    """
    fields, values = per_row
    schema = T.StructType([T.StructField("doc_id", T.LongType()), *fields])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = MergeTable.load(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                columns = values(table, table.encoder.encode(part.column(1).to_pylist()))
                yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, columns)], names=schema.fieldNames())

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(rows, schema)


def encode_texts(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids (little-endian unsigned 32-bit) of each document."""
    return encode(docs, path, ([T.StructField("ids", T.BinaryType())], lambda _, ids: [ids]))


def decode_ids(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text of each row (doc_id, ids); null ids give an empty text."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = MergeTable.load(path)
        for batch in batches:
            texts = [table.decode(x or b"") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(rows, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each document, decoded again from its ids."""
    from hashlib import sha256

    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]

    def values(table: MergeTable, ids: list[bytes]) -> list[list]:
        return [[len(x) // 4 for x in ids], [sha256(x).hexdigest() for x in ids], [sha256(table.decode(x).encode()).hexdigest() for x in ids]]

    return encode(docs, path, (fields, values))
