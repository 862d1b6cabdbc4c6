"""Exact repeats of a minimum length, by threshold-bounded interval expansion on a Burrows-Wheeler transform.

Two equal strings of the minimum length have the same least k-gram, so texts are cut into overlapping
segments by it: a segment holds a maximal run of windows with one least k-gram. Only segments that share
this key can share a window; equal segments are counted once, and a segment that occurs twice repeats as
a whole, and one that has its k-gram but once does not repeat in itself. Two segments that have it once
can only share a window if the half window before it or the one after it is equal too. The different
segments that are left are put together with others into units of bounded size. There
the Burrows-Wheeler transform is expanded backwards breadth first: level by level every interval of
suffixes that begin with a string is extended by each symbol before it, and a boundary between suffixes
gets its common prefix when it is first met. At the minimum length expansion stops; boundaries that
have no value by then lie between suffixes with a longer common prefix.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimcheck.llm.common import tidy, written
from claimcheck.llm.shingles import FACTOR, mixed

LENGTH = 400
GRAM = 32
UNIT_BYTES = 1 << 20
#: About so many segments of a hot key are compared in one group of a window.
GROUP_ROWS = 100_000


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k-byte strings; k is a power of two."""
    with np.errstate(over="ignore"):
        h, step, factor = data.astype(np.uint64) + np.uint64(1), 1, FACTOR
        while step < k:
            h = h[:-step] * factor + h[step:]
            factor, step = factor * factor, 2 * step
    return mixed(h)


def window_minima(h: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours."""
    step = 1
    while 2 * step <= width:
        h, step = np.minimum(h[:-step], h[step:]), 2 * step
    rest = width - step
    return np.minimum(h[: len(h) - rest], h[rest:]) if rest else h


def segments(data: bytes, length: int, k: int) -> list[tuple[int, int, int, int, int, int | None, int | None]]:
    """(key, content hash, start, size, occurrences of the least k-gram, before, after) of the segments of a text.

    before and after are hashes of the first k-gram with half a window on that side of it, None where the
    segment has less. Any window holds its k-gram with one of the two.
    """
    if len(data) < length:
        return []
    grams = gram_hashes(np.frombuffer(data, dtype=np.uint8), k)
    least = window_minima(grams, length - k + 1)
    begin = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
    size = np.r_[begin[1:], len(least)] - begin + length - 1
    half, out = (length - k + 1) // 2, []
    for a, n, key, value in zip(begin.tolist(), size.tolist(), least[begin].astype(np.int64).tolist(), least[begin], strict=True):
        places = np.flatnonzero(grams[a : a + n - k + 1] == value)
        at = a + int(places[0])
        before = _hash(data[at - half : at + k]) if at - half >= a else None
        after = _hash(data[at : at + k + half]) if at + k + half <= a + n else None
        out.append((key, _hash(data[a : a + n]), a, n, len(places), before, after))
    return out


def _hash(data: bytes) -> int:
    return xxhash.xxh3_64_intdigest(data) - (1 << 63)


def suffix_order(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes ordered by their first symbols, at least `depth` of them (prefix doubling)."""
    rank, step, n = symbols.astype(np.int64), 1, len(symbols)
    while True:
        both = rank << 32
        both[: n - step] |= rank[step:] + 1
        order = np.argsort(both, kind="stable")
        ordered = both[order]
        new = np.empty(n, dtype=np.int64)
        new[order] = np.cumsum(np.r_[0, ordered[1:] != ordered[:-1]])
        rank, step = new, 2 * step
        if step >= min(depth, n) or rank[order[-1]] == n - 1:
            return order


def repeated_starts(parts: list[bytes], length: int) -> list[np.ndarray]:
    """For each part the starts of strings of the length that start anywhere else too, in any part."""
    ends = len(parts)
    flat = np.concatenate([x for i, p in enumerate(parts) for x in (np.frombuffer(p, dtype=np.uint8).astype(np.int64) + ends, [i])])
    n = len(flat)
    order = suffix_order(flat, length + 1)
    before = flat[order - 1]
    step = np.empty(n, dtype=np.int64)
    step[np.argsort(before, kind="stable")] = np.arange(n)
    common = np.full(n + 1, -1, dtype=np.int32)
    common[: ends + 1] = common[n] = 0
    lo, hi = np.array([0]), np.array([n])
    for value in range(length):
        size = hi - lo
        owner = np.repeat(np.arange(len(lo)), size)
        at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(lo, size)
        inner = before[at] >= ends
        owner, at = owner[inner], at[inner]
        if not len(at):
            break
        to = step[at]
        by = np.lexsort((to, owner))
        owner, to, symbol = owner[by], to[by], before[at][by]
        first = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (symbol[1:] != symbol[:-1])])
        last = np.r_[first[1:], len(to)] - 1
        new_lo, new_hi = to[first], to[last] + 1
        unset = common[new_hi] < 0
        common[new_hi[unset]] = value
        lo, hi = new_lo[unset], new_hi[unset]
        if not value:
            lo, hi = np.r_[np.arange(ends), lo], np.r_[np.arange(ends) + 1, hi]
    long = common[1:n] < 0
    flagged = np.zeros(n, dtype=bool)
    flagged[order[np.r_[False, long] | np.r_[long, False]]] = True
    out, at = [], 0
    for p in parts:
        out.append(np.flatnonzero(flagged[at : at + len(p)]))
        at += len(p) + 1
    return out


def covered(starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """The runs of places covered by strings of the length at ascending starts."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.r_[True, np.diff(starts) > length])
    last = np.r_[cut[1:], len(starts)] - 1
    return [(int(starts[a]), int(starts[b]) + length) for a, b in zip(cut, last, strict=True)]


SPAN = "key long, content long, lo int, hi int"


def _span_batch(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.int64(), pa.int64(), pa.int32(), pa.int32()], strict=True)], names=["key", "content", "lo", "hi"])


def _repeats_of(pieces: DataFrame, length: int) -> DataFrame:
    """Repeated spans inside the different segments of each key; pieces has key, content, key_bytes and data.

    A key whose segments exceed a unit is not expanded in one task: its windows are counted by hash, one
    row for each different window and segment, and those found twice are merged into runs. Segments of a key
    are dealt to as many salts as keep a window's group small; groups of one row are then compared over salts.
    """
    total = pieces.agg(F.sum(F.length("data"))).first()[0] or 0
    unit = F.pmod(F.xxhash64("key"), F.lit(max(1, total // UNIT_BYTES)))

    def expand(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates(["key", "content"]).sort_values(["key", "content"])
        found = repeated_starts(list(rows["data"]), length)
        out = [(k, c, lo, hi) for k, c, s in zip(rows["key"], rows["content"], found, strict=True) for lo, hi in covered(s, length)]
        return pd.DataFrame(out, columns=["key", "content", "lo", "hi"])

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, content, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n = len(data) - length + 1
                hashes = [_hash(data[i : i + length]) for i in range(n)]
                yield pa.RecordBatch.from_arrays([pa.array([key] * n, pa.int64()), pa.array([content] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array(hashes, pa.int64())], names=["key", "content", "at", "hash"])

    usual, hot = pieces.where(F.col("key_bytes") <= UNIT_BYTES), pieces.where(F.col("key_bytes") > UNIT_BYTES)
    spans = usual.select(unit.alias("unit"), "key", "content", "data").groupBy("unit").applyInPandas(expand, SPAN)
    different = hot.select("key", "content", "data").dropDuplicates(["key", "content"])
    most = hot.groupBy("key").count().agg(F.max("count")).first()[0] or 0
    each = different.mapInArrow(windows, "key long, content long, at int, hash long").withColumn("salt", F.pmod("content", F.lit(1 + most // GROUP_ROWS)))
    group = Window.partitionBy("key", "hash", "salt")
    each = each.withColumn("n", F.count(F.lit(1)).over(group)).withColumn("place", F.row_number().over(group.orderBy("content", "at")))
    twice = each.where("n > 1").select("key", "content", "at")
    if most >= GROUP_ROWS:
        each = written(each)
        one = each.where("place = 1").withColumn("salts", F.count(F.lit(1)).over(Window.partitionBy("key", "hash")))
        twice = each.where("n > 1").select("key", "content", "at").union(one.where("n = 1 and salts > 1").select("key", "content", "at"))
    order = Window.partitionBy("key", "content").orderBy("at")
    begins = F.coalesce(F.col("at") - F.lag("at").over(order) > length, F.lit(True)).cast("int")
    runs = twice.withColumn("begins", begins).withColumn("run", F.sum("begins").over(order))
    return spans.union(runs.groupBy("key", "content", "run").agg(F.min("at").alias("lo"), (F.max("at") + length).alias("hi")).drop("run"))


def _may_repeat(contents: DataFrame) -> DataFrame:
    """key, key_bytes, content, text_hash, start and size of the contents that may share a window with another, or with themselves."""
    keys = contents.groupBy("key").agg(F.count(F.lit(1)).alias("contents"), F.max("times").alias("most")).where("contents > 1 or most > 1").select("key", "most")
    asked = written(contents.join(keys, "key"))
    sides = asked.where("most = 1").select("key", "content", F.explode(F.array("before", "after")).alias("side")).where("side is not null").distinct()
    shared = sides.groupBy("key", "side").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "side")
    chosen = sides.join(shared, ["key", "side"]).select("key", "content").distinct()
    columns = ["key", "content", "text_hash", "start", "size"]
    left = written(asked.where("most > 1").select(columns).union(asked.where("most = 1").join(chosen, ["key", "content"], "left_semi").select(columns)))
    return left.join(left.groupBy("key").agg(F.sum(F.col("size").cast("long")).alias("key_bytes")), "key")


@tidy
def repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """text_hash (xxhash64 of the text) and spans of bytes that repeat, for each text that has some."""
    texts = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).select(F.xxhash64("text").alias("text_hash"), "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                out = [(t, *s) for t, text in zip(batch.column(0)[at : at + 500].to_pylist(), batch.column(1)[at : at + 500].to_pylist(), strict=True) for s in segments(text.encode(), length, gram)]
                if out:
                    types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["text_hash", "key", "content", "start", "size", "times", "before", "after"])

    found = written(texts.mapInArrow(cut, "text_hash long, key long, content long, start int, size int, times int, before long, after long"))
    contents = found.groupBy("key", "content").agg(F.count(F.lit(1)).alias("n"), F.min("text_hash").alias("text_hash"), F.min_by("start", "text_hash").alias("start"), F.max("size").alias("size"), F.max("times").alias("times"), F.max("before").alias("before"), F.max("after").alias("after"))
    contents = written(contents)

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [t.as_py().encode()[a : a + n] for a, n, t in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), batch.column(5), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(data, pa.binary())], names=["key", "content", "key_bytes", "data"])

    asked = written(_may_repeat(contents).select("key", "content", "key_bytes", "text_hash", "start", "size"))
    some = written(asked.select("text_hash").distinct())
    with_text = asked.join(texts.join(some, "text_hash", "left_semi"), "text_hash").select("key", "content", "key_bytes", "start", "size", "text")
    pieces = written(with_text.mapInArrow(take, "key long, content long, key_bytes long, data binary"))
    inner = _repeats_of(pieces, length)
    whole = contents.where("n > 1").select("key", "content", F.lit(0).alias("lo"), "size")
    both = whole.withColumnRenamed("size", "hi").union(inner)
    placed = found.select("text_hash", "key", "content", "start").join(both, ["key", "content"])
    placed = placed.select("text_hash", (F.col("start") + F.col("lo")).alias("lo"), (F.col("start") + F.col("hi")).alias("hi")).distinct()
    return placed.groupBy("text_hash").agg(F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("spans"))


def without_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, spans (maximal removed runs of bytes) and kept (the remaining bytes) of every row.

    Every byte goes that a string of `length` bytes covers which also starts anywhere else, in any text or
    the same one. A null text counts as empty. Rows of equal text, with or without doc_id, are copies of
    each other; an empty table gives no rows; other columns are ignored.
    """
    found = repeats(docs, length, gram)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("text_hash", F.xxhash64("text")).join(found, "text_hash", "left").select("doc_id", "text", "spans")
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())])), pa.binary()]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 500):
                part, out = batch.slice(first, 500), []
                for text, spans in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    data, runs = text.encode(), []
                    for s in spans or ():
                        if runs and s["lo"] <= runs[-1]["hi"]:
                            runs[-1]["hi"] = max(runs[-1]["hi"], s["hi"])
                        else:
                            runs.append(dict(s))
                    edges = [0, *(e for r in runs for e in (r["lo"], r["hi"])), len(data)]
                    kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                    out.append((len(data), len(data) - len(kept), runs, kept))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True))], names=["doc_id", "n_bytes", "n_removed", "spans", "kept"])

    return rows.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, spans array<struct<lo:int,hi:int>>, kept binary")
