"""Periodic runs of words: difference-cover LCE queries drive an enumeration on harmonic grids.

A run is a stretch of words with smallest period q, at least max(6, 4q) long, that cannot be extended. For
every q up to a quarter of a text, the grid of the multiples of q has three neighbouring points inside each
such run whose words equal the ones q further on. Where a grid has three such points, the run around the
first is found by two longest-common-extension (LCE) queries, forwards and, on the reversed words, backwards.

LCE queries are answered from few sorted suffixes: those whose position modulo V lies in a difference
cover, a set of residues of which any two positions meet a pair after fewer than V steps. That many words are
compared directly; if all are equal, the rest is the minimum of the common prefixes between the two
suffixes in sorted order, by a sparse table. The sorting doubles the compared length, from V words on.

Texts are taken together in blocks of a bounded number of words (a longer text is a block of its own),
each ended by a symbol that occurs once. Nothing leaves the task in which a text is read; memory is bounded
by the block, or the longest text.

Defined results: a null or empty text has no words and no runs; null and repeated doc_ids are kept as they
are; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
#: Modulus of the difference cover.
V = 32
LEAST_LENGTH, LEAST_EXPONENT = 6, 4
BLOCK_WORDS = 1 << 17
#: Grid points looked at together.
GRID_POINTS = 1 << 21
RUNS = "doc_id long, n long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


@cache
def difference_cover(v: int = V) -> tuple[np.ndarray, np.ndarray]:
    """Residues of which some two differ by d modulo v, for every d; and for every d the first of such two."""
    root = int(np.ceil(np.sqrt(v)))
    cover = np.array(sorted({*range(root), *range(root - 1, v, root)}))
    first = np.full(v, -1)
    for a in cover[::-1]:
        first[(cover - a) % v] = a
    assert (first >= 0).all()
    return cover, first


def _ranks(keys: np.ndarray) -> np.ndarray:
    """Dense ranks of the rows of a table of whole numbers from -1 on, by columns from left to right."""
    bits = int(keys.max(initial=0) + 2).bit_length()
    each = 63 // bits
    packed = []
    for c in range(0, keys.shape[1], each):
        column = np.zeros(len(keys), dtype=np.int64)
        for k in range(c, min(c + each, keys.shape[1])):
            column = column << bits | (keys[:, k].astype(np.int64) + 1)
        packed.append(column)
    order = np.lexsort(packed[::-1])
    new = np.zeros(len(keys), dtype=np.int64)
    for column in packed:
        inorder = column[order]
        new[1:] |= inorder[1:] != inorder[:-1]
    ranks = np.empty(len(keys), dtype=np.int64)
    ranks[order] = np.cumsum(new)
    return ranks


class CommonExtensions:
    """Longest common extensions of positions in a sequence of non-negative numbers."""

    def __init__(self, words: np.ndarray):
        cover, self.first = difference_cover()
        n = len(words)
        self.words = np.r_[words, np.full(2 * V, -1)]
        positions = (np.arange(0, n, V)[:, None] + cover).ravel()
        self.sample = sample = positions[positions < n]
        self.place = np.full(n + 2 * V, -1)
        self.place[sample] = np.arange(len(sample))
        # levels[k]: rank by the first V * 2^k words; -1 beyond the end, which sorts first
        windows = np.lib.stride_tricks.sliding_window_view(self.words, V)
        levels = [_ranks(windows[sample])]
        while len(sample) and levels[-1].max() + 1 < len(sample):
            step = V << (len(levels) - 1)
            levels.append(_ranks(np.c_[levels[-1], self._ahead(levels[-1], sample + step)]))
        rank = levels[-1]
        self.rank = rank
        order = np.empty(len(sample), dtype=np.int64)
        order[rank] = np.arange(len(sample))
        # common prefixes of neighbours: halve the compared length, then compare the last words
        a, b = sample[order[:-1]].copy(), sample[order[1:]].copy()
        common = np.zeros(len(a), dtype=np.int64)
        for k in range(len(levels) - 1, -1, -1):
            same = (x := self._ahead(levels[k], a)) == self._ahead(levels[k], b)
            same &= x >= 0
            for at in (a, b, common):
                at[same] += V << k
        common += self._direct(a, b, np.full(len(a), V))
        self.table = [common]
        while 2 << (len(self.table) - 1) <= len(common):
            half, last = 1 << (len(self.table) - 1), self.table[-1]
            self.table.append(np.minimum(last[:-half], last[half:]))

    def _ahead(self, ranks: np.ndarray, positions: np.ndarray) -> np.ndarray:
        place = self.place[np.minimum(positions, len(self.place) - 1)]
        return np.where(place >= 0, ranks[place], -1)

    def _direct(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """Equal words from a and b on, at most limit (below V + 1)."""
        found = np.zeros(len(a), dtype=np.int64)
        active = np.arange(len(a))
        last = len(self.words) - 1
        for k in range(int(limit.max(initial=0))):
            x = self.words[np.minimum(a[active] + k, last)]
            same = (x == self.words[np.minimum(b[active] + k, last)]) & (x >= 0) & (limit[active] > k)
            active = active[same]
            if not len(active):
                break
            found[active] += 1
        return found

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Lengths of the longest common prefixes of the suffixes at a and b (different positions, pair by pair)."""
        shift = (self.first[(b - a) % V] - a) % V
        found = self._direct(a, b, shift)
        on = np.flatnonzero(found == shift)
        x, y = (self._ahead(self.rank, p[on] + shift[on]) for p in (a, b))
        inside = (x >= 0) & (y >= 0)
        on, low, high = on[inside], np.minimum(x, y)[inside], np.maximum(x, y)[inside]
        level = np.frexp(high - low)[1] - 1
        for k in np.unique(level):
            of = level == k
            found[on[of]] += np.minimum(self.table[k][low[of]], self.table[k][high[of] - (1 << k)])
        return found


def _grids(starts: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(start of the text, period, number of grid points) of every grid, in groups of bounded size."""
    periods = lengths // LEAST_EXPONENT
    start, length = np.repeat(starts, periods), np.repeat(lengths, periods)
    q = np.arange(len(start)) - np.repeat(np.cumsum(periods) - periods, periods) + 1
    points = (length - 1) // q
    group = np.cumsum(points) // GRID_POINTS
    for part in np.split(np.arange(len(q)), np.flatnonzero(np.diff(group)) + 1):
        yield start[part], q[part], points[part]


def _candidates(words: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Grid points and periods where the words of three neighbouring points repeat a period further on."""
    for start, q, points in _grids(starts, lengths):
        period = np.repeat(q, points)
        left = np.repeat(np.cumsum(points), points) - np.arange(len(period))
        at = np.repeat(start + points * q, points) - left * period
        same = words[at] == words[at + period]
        same[:-2] &= same[1:-1] & same[2:]
        here = np.flatnonzero(same & (left > 2))
        yield at[here], period[here]


def _joined(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts in a row with a symbol of its own before each and after the last; starts and lengths."""
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    symbol = 1 + max((int(t.max(initial=0)) for t in texts), default=0)
    parts = [x for i, t in enumerate(texts) for x in (np.array([symbol + i]), t)]
    words = np.concatenate([*parts, np.array([symbol + len(texts)])]).astype(np.int64)
    return words, np.cumsum(lengths + 1) - lengths, lengths


def find_runs(texts: list[np.ndarray]) -> list[np.ndarray]:
    """For each text (an array of word numbers) its runs: rows of start, length and period, by start and period."""
    none = np.zeros((0, 3), dtype=np.int64)
    found = [none] * len(texts)
    words, starts, lengths = _joined(texts)
    marked = [np.searchsorted(starts, at, side="right") - 1 for at, _ in _candidates(words, starts, lengths)]
    chosen = np.unique(np.concatenate([*marked, np.zeros(0, dtype=np.int64)]))
    if not len(chosen):
        return found
    words, starts, lengths = _joined([texts[i] for i in chosen])
    n, ahead, back = len(words), CommonExtensions(words), CommonExtensions(words[::-1])
    best = none
    for at, period in _candidates(words, starts, lengths):
        begin, end = at - back(n - at, n - at - period), at + period + ahead(at, at + period)
        long = end - begin >= np.maximum(LEAST_LENGTH, LEAST_EXPONENT * period)
        rows = np.concatenate([best, np.c_[begin, end, period][long]])
        # of one stretch the smallest period counts; the others are its multiples
        rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
        best = rows[np.r_[True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1)][: len(rows)]]
    of = np.searchsorted(starts, best[:, 0], side="right") - 1
    rows = np.c_[best[:, 0] - starts[of], best[:, 1] - best[:, 0], best[:, 2]]
    rows, of = (x[np.lexsort((rows[:, 2], rows[:, 0], of))] for x in (rows, of))
    cuts = np.searchsorted(of, np.arange(len(chosen) + 1))
    for i, a, b in zip(chosen, cuts, cuts[1:], strict=False):
        found[i] = rows[a:b]
    return found


def _collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words that no run holds after its first period, joined by spaces."""
    if not len(runs):
        return b" ".join(words)
    depth = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(depth, runs[:, 0] + runs[:, 2], 1)
    np.add.at(depth, runs[:, 0] + runs[:, 1], -1)
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(depth[:-1]) == 0)])


def periodic_runs(docs: DataFrame) -> DataFrame:
    """doc_id, n (words), the runs by start and period, and the text without what its runs repeat."""
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    names = ["doc_id", "n", "runs", "collapsed"]

    def block(ids: list, words: list[list[bytes]]) -> pa.RecordBatch:
        codes = pa.array([w for text in words for w in text], pa.large_binary()).dictionary_encode().indices.to_numpy()
        cuts = np.cumsum([0, *map(len, words)])
        runs = find_runs([codes[a:b].astype(np.int64) for a, b in zip(cuts, cuts[1:], strict=False)])
        flat = np.concatenate(runs)
        offsets = pa.array(np.cumsum([0, *map(len, runs)]), pa.int32())
        rows = pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], fields=list(run))
        texts = [_collapsed(w, r).decode() for w, r in zip(words, runs, strict=True)]
        columns = [pa.array(ids, pa.int64()), pa.array([len(w) for w in words], pa.int64()), pa.ListArray.from_arrays(offsets, rows), pa.array(texts, pa.string())]
        return pa.RecordBatch.from_arrays(columns, names=names)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, words, held = [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                ids.append(doc_id.as_py())
                words.append((text.as_py() or "").encode().split())
                held += len(words[-1])
                if held >= BLOCK_WORDS or len(ids) >= 2000:
                    yield block(ids, words)
                    ids, words, held = [], [], 0
        if ids:
            yield block(ids, words)

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(rows, RUNS)


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and text; where h = crc32 of the decimal doc_id ends in 0, words repeat from word a on with period p.

    With g = h div 10 and n words: a = g mod n and p = 1 + (n - a) div (3 + g mod 8). A null doc_id plants nothing.
    """
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    g = F.expr("h div 10")
    rows = rows.withColumns({"h": h, "words": words}).withColumn("n", F.size("words").cast("long"))
    rows = rows.withColumn("a", F.when(F.col("n") > 0, g % F.col("n")))
    rows = rows.withColumn("p", F.expr("1 + (n - a) div (3 + (h div 10) % 8)"))
    repeated = F.expr("transform(sequence(0L, n - 1), i -> words[int(if(i < a, i, a + (i - a) % p))])")
    return rows.select("doc_id", F.when(F.col("n") > 0, F.array_join(repeated, " ")).otherwise(F.col("text")).alias("text"))


def digest(found: DataFrame) -> DataFrame:
    """Number of runs, the run with the greatest length / period (ties: smallest start, then period), and digests."""
    longer = lambda a, x: F.when(x["length"] * a["period"] > a["length"] * x["period"], x).otherwise(a)
    best = F.aggregate("runs", F.get("runs", F.lit(0)), longer)
    lines = F.transform("runs", lambda r: F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]))
    listed = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    rows = found.select("doc_id", "runs", best.alias("best"), "collapsed")
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
