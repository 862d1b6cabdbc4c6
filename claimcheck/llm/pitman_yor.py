"""Scoring by a hierarchical Pitman-Yor model of word pairs.

Every word is a restaurant, its customers the words that follow it; all these share one parent, whose
customers are their tables, and the parent draws from a uniform base. Several chains run side by side.
A sweep draws the tables of each pair anew, given the tables of its restaurant and the parent's
probability of the word from the sweep before (collapsed Gibbs: the number of tables of c customers has
weight A^t S(c, t), with generalized Stirling numbers S). The predictive probabilities of a token are
averaged over the chains.

Texts are kept as blocks of token numbers with their own vocabulary. What blocks and the corpus exchange
goes by hash buckets: each block sends its distinct words or pairs, a bucket adds them up and answers in
the order asked. So a word or pair, however frequent, is one entry per block, and a block or bucket is of
bounded size. Draws are functions of the pair's hash, so a task that is run again repeats them. Of the blocks
that hold a pair one owns it, and only that one draws its tables, until the last sweep: there each block draws
all of its own and keeps them for scoring, in a bucket of a negative number that comes back as it was sent.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from functools import cache
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimcheck.llm.common import dropped, shuffle_partitions, temporary_folder, tidy, written
from claimcheck.llm.shingles import WordHashes, mixed

BLOCK_TOKENS = 750_000
BUCKET_ENTRIES = 250_000
CHAINS = 2
SWEEPS = 2
#: Discount and strength of the words' restaurants and of their parent.
DISCOUNT, STRENGTH = 0.75, 1.0
ROOT_DISCOUNT, ROOT_STRENGTH = 0.5, 1.0
#: Up to so many customers of a pair the number of tables is drawn exactly; further ones sit down in growing parties.
EXACT = 48
END = np.uint64(0x5EED0FE4D0000001)
SENT = "block long, bucket int, keys binary, columns array<binary>"
ANSWER = "block long, bucket int, columns array<binary>"


def pack(values: np.ndarray, kind: str = "<u4") -> bytes:
    """Numbers, first the lowest bytes of all of them, then the next ones: alike bytes lie together."""
    planes = np.ascontiguousarray(values, dtype=kind).view(np.uint8).reshape(len(values), np.dtype(kind).itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(data: bytes, kind: str = "<u4") -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, len(planes) // np.dtype(kind).itemsize).T).view(kind).ravel().astype(np.int64 if kind == "<u4" else kind, copy=False)


def pack_keys(keys: np.ndarray) -> bytes:
    """Ascending hashes, by the steps from one to the next."""
    return pack(np.diff(keys, prepend=np.uint64(0)), "<u8")


def unpack_keys(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, "<u8"), dtype=np.uint64)


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As np.unique with first places and inverse, by a sort that need not be stable."""
    order = np.argsort(keys)
    ordered = keys[order]
    begin = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]][: len(keys)])
    place = np.empty(len(keys), dtype=np.int64)
    place[order] = np.repeat(np.arange(len(begin)), np.diff(np.r_[begin, len(keys)]))
    first = np.minimum.reduceat(order, begin) if len(begin) else order
    return ordered[begin], first, place


def uniform(keys: np.ndarray, salt: int) -> np.ndarray:
    """A number in (0, 1) for each key."""
    return (mixed(keys ^ mixed(np.array([salt], dtype=np.uint64))) >> np.uint64(11)).astype(np.float64) * 2.0**-53 + 2.0**-54


@cache
def log_stirling(discount: float) -> np.ndarray:
    """log S(c, t) for c, t up to EXACT: S(c + 1, t) = S(c, t - 1) + (c - discount t) S(c, t)."""
    s = np.full((EXACT + 1, EXACT + 1), -np.inf)
    s[0, 0] = 0
    for c in range(EXACT):
        for t in range(1, c + 2):
            stay = s[c, t] + np.log(c - discount * t) if t <= c else -np.inf
            s[c + 1, t] = np.logaddexp(s[c, t - 1], stay)
    return s


def tables(customers: np.ndarray, mass: np.ndarray, discount: float, keys: np.ndarray, salt: int) -> np.ndarray:
    """The drawn number of tables of each dish, given the weight of a new table."""
    out, stirling = np.minimum(customers, 1), log_stirling(discount)
    few = np.minimum(customers, EXACT)
    for c in np.unique(few[few > 1]):
        at = np.flatnonzero(few == c)
        weight = np.log(mass[at])[:, None] * np.arange(1, c + 1) + stirling[c, 1 : c + 1]
        share = np.cumsum(np.exp(weight - weight.max(axis=1, keepdims=True)), axis=1)
        out[at] = 1 + np.minimum((share < (uniform(keys[at], salt) * share[:, -1])[:, None]).sum(axis=1), c - 1)
    at, seated, party = np.flatnonzero(customers > EXACT), EXACT, 0
    while len(at):
        party += 1
        new = np.minimum(customers[at], seated + max(1, seated // 16)) - seated
        chance = mass[at] / (seated - discount * out[at] + mass[at])
        out[at] += np.minimum(new, np.floor(new * chance + uniform(keys[at], salt + 7919 * party))).astype(np.int64)
        seated += max(1, seated // 16)
        at = at[customers[at] > seated]
    return out


def held_out(doc_id: int | None) -> bool:
    return crc32(b"" if doc_id is None else str(doc_id).encode()) % 10 == 0


def blocks_of(docs: DataFrame) -> DataFrame:
    """Blocks of whole texts: their ids, lengths in tokens, sorted vocabulary and tokens as numbers in it."""
    schema = "block long, doc_ids array<long>, lengths binary, n_words long, vocabulary binary, tokens binary"

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, ids, texts, n, block = WordHashes(), [], [], 0, TaskContext.get().partitionId() << 32

        def out() -> pa.RecordBatch:
            vocabulary, tokens = np.unique(np.concatenate([x for t in texts for x in (t, [END])]), return_inverse=True)
            lengths = np.array([len(t) + 1 for t in texts])
            return pa.RecordBatch.from_pydict({"block": [block], "doc_ids": [ids], "lengths": [pack(lengths)], "n_words": [len(vocabulary)], "vocabulary": [pack_keys(vocabulary)], "tokens": [pack(tokens)]}, schema=kinds)

        kinds = pa.schema([("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.binary()), ("n_words", pa.int64()), ("vocabulary", pa.binary()), ("tokens", pa.binary())])
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = hashes.of(text.as_py(), lower=True)
                ids.append(doc_id)
                texts.append(words)
                n += len(words) + 1
                if n >= BLOCK_TOKENS:
                    yield out()
                    ids, texts, n, block = [], [], 0, block + 1
        if ids:
            yield out()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(rows, schema)


class Block:
    """A block's tokens; pairs are sorted by hash, each token of the block pointing at its own."""

    def __init__(self, row: dict):
        self.doc_ids, self.lengths = row["doc_ids"], unpack(row["lengths"])
        self.vocabulary, self.tokens = unpack_keys(row["vocabulary"]), unpack(row["tokens"])
        self.held = np.array([held_out(d) for d in self.doc_ids])
        self.training = ~np.repeat(self.held, self.lengths)
        end = np.searchsorted(self.vocabulary, END)
        self.context = np.r_[end, self.tokens[:-1]]
        self.counts = np.bincount(self.tokens[self.training], minlength=len(self.vocabulary))

    def pairs(self) -> None:
        with np.errstate(over="ignore"):
            keys = mixed(self.vocabulary[self.context] * np.uint64(0x9E3779B97F4A7C15) + self.vocabulary[self.tokens])
        self.keys, first, self.pair = distinct(keys)
        self.pair_context, self.pair_word = self.context[first], self.tokens[first]
        self.pair_counts = np.bincount(self.pair[self.training], minlength=len(self.keys))


def sent(block: int, keys: np.ndarray, columns: list[np.ndarray], bits: int) -> Iterator[dict]:
    """A row for each bucket of the sorted keys; a column holds one unsigned number per key."""
    edges = np.searchsorted(keys >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64)) if bits else np.array([0, len(keys)])
    for bucket in np.flatnonzero(np.diff(edges)):
        a, b = edges[bucket], edges[bucket + 1]
        yield {"block": block, "bucket": int(bucket), "keys": pack_keys(keys[a:b]), "columns": [pack(c[a:b]) for c in columns]}


def answers(rows: DataFrame, reply: Callable, schema: str = ANSWER) -> DataFrame:
    """reply(bucket, keys, sums, place of each entry's key, whether it is the key's first) gives the columns that
    go back; their entries return to the blocks in the order in which they were sent."""

    def add(part: pd.DataFrame) -> pd.DataFrame:
        if part["bucket"].iloc[0] < 0:
            return part[["block", "bucket", "columns"]]
        part = part.sort_values("block")
        sent_keys = [unpack_keys(k) for k in part["keys"]]
        sizes = [len(k) for k in sent_keys]
        keys, first, place = distinct(np.concatenate(sent_keys))
        sums = [np.bincount(place, weights=np.concatenate([unpack(c) for c in column])).astype(np.int64) for column in zip(*part["columns"], strict=True)]
        owner = np.zeros(len(place), dtype=np.int64)
        owner[first] = 1
        columns, ends = reply(keys, sums, place, owner), np.cumsum(sizes)
        out = [{"block": b, "bucket": k, "columns": [pack(c[e - n : e]) for c in columns]} for b, k, n, e in zip(part["block"], part["bucket"], sizes, ends, strict=True)]
        return pd.DataFrame(out, columns=["block", "bucket", "columns"])

    return rows.groupBy("bucket").applyInPandas(add, schema)


def received(row: list | None) -> list[np.ndarray]:
    """The answered columns of a block, in the order of its keys."""
    ordered = sorted((x for x in row or [] if x["bucket"] >= 0), key=lambda x: x["bucket"])
    return [np.concatenate([unpack(c) for c in column]) for column in zip(*(x["columns"] for x in ordered), strict=True)]


def kept(block: int, columns: list[np.ndarray]) -> dict:
    """A row that comes back to its block as it is."""
    return {"block": block, "bucket": -1 - int(mixed(np.array([block], dtype=np.uint64))[0] >> np.uint64(44)), "keys": b"", "columns": [pack(c) for c in columns]}


def each_block(blocks: DataFrame, function: Callable, schema: str, **answered: DataFrame) -> DataFrame:
    """function(row) for every block with the answers to it as columns; it yields dictionaries."""
    for name, rows in answered.items():
        blocks = blocks.join(rows.groupBy("block").agg(F.collect_list(F.struct("bucket", "columns")).alias(name)), "block", "left")
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kinds = to_arrow_schema(StructType.fromDDL(schema))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                out = list(function(batch.slice(i, 1).to_pylist()[0]))
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=kinds)

    return blocks.mapInArrow(rows, schema)


def seats(block: Block, pairs: list[np.ndarray], words: list[np.ndarray], state: list[np.ndarray] | None, totals: dict, sweep: int, asked: np.ndarray | None = None) -> list[np.ndarray]:
    """Tables of each of the block's pairs in each chain, drawn in this sweep; of those asked for, if not of all."""
    count, out = pairs[0], []
    many = np.flatnonzero(count > 1 if asked is None else (count > 1) & asked)
    for chain in range(CHAINS):
        drawn = np.minimum(count, 1)
        if state is None:
            open_tables = DISCOUNT * words[0][block.pair_context[many]]
            parent = (words[0][block.pair_word[many]] + 0.1) / (totals["n"] + 0.1 * (totals["v"] + 1))
        else:
            open_tables = DISCOUNT * state[1 + 3 * chain][block.pair_context[many]]
            parent = root(state, chain, totals)[block.pair_word[many]]
        drawn[many] = tables(count[many], (STRENGTH + open_tables) * parent, DISCOUNT, block.keys[many], 1000 * sweep + chain)
        out.append(drawn)
    return out


def root(state: list[np.ndarray], chain: int, totals: dict) -> np.ndarray:
    """The parent's probability of each word of the block's vocabulary."""
    customers, own, n, t = state[2 + 3 * chain], state[3 + 3 * chain], totals["customers"][chain], totals["tables"][chain]
    return (customers - ROOT_DISCOUNT * own + (ROOT_STRENGTH + ROOT_DISCOUNT * t) / (totals["v"] + 1)) / (ROOT_STRENGTH + n)


@tidy
def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of docs.

    Training texts are those whose crc32(doc_id as text) mod 10 is not 0; a null doc_id counts as held
    out, a null text as empty (its end is a token). The first word of a text follows an end. A word
    outside the training texts has the base's probability in the parent; a text that follows a word
    without a restaurant is scored by the parent. An empty table gives no rows.
    """
    spark = docs.sparkSession
    made = blocks_of(docs)
    name = f"blocks_{uuid.uuid4().hex}"
    buckets = max(shuffle_partitions(spark), made.rdd.getNumPartitions())
    made.write.bucketBy(buckets, "block").option("compression", "zstd").option("path", temporary_folder(spark)).format("parquet").saveAsTable(name)
    blocks = spark.table(name)
    size = blocks.agg(F.sum("n_words").alias("words"), F.sum(F.size("doc_ids")).alias("docs"), F.count(F.lit(1)).alias("n")).first()
    bits = [max(0, int(np.ceil(np.log2(max(1, entries) / BUCKET_ENTRIES)))) for entries in (size["words"] or 0, (size["n"] or 0) * BLOCK_TOKENS // 2)]

    def own_words(row: dict) -> Iterator[dict]:
        block = Block(row)
        yield from sent(row["block"], block.vocabulary, [block.counts], bits[0])

    def own_pairs(row: dict) -> Iterator[dict]:
        block = Block(row)
        block.pairs()
        yield from sent(row["block"], block.keys, [block.pair_counts], bits[1])

    words = written(answers(each_block(blocks, own_words, SENT), lambda keys, sums, place, owner: [sums[0][place], owner]))
    pairs = written(answers(each_block(blocks, own_pairs, SENT), lambda keys, sums, place, owner: [sums[0][place], owner]))

    def summed(row: dict) -> Iterator[dict]:
        found = received([row])
        mine = found[0][found[1] > 0]
        yield {"n": int(mine.sum()), "v": int((mine > 0).sum())}

    found = each_block(words, summed, "n long, v long").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).first()
    totals: dict = {"n": found["n"] or 0, "v": found["v"] or 0}
    state = None
    for sweep in range(SWEEPS):

        def seated(row: dict, sweep: int = sweep, totals: dict = dict(totals)) -> Iterator[dict]:
            block = Block(row)
            block.pairs()
            pair, word = received(row["pairs"]), received(row["words"])
            mine, n, last = (pair[1] > 0) & (pair[0] > 0), len(block.vocabulary), sweep == SWEEPS - 1
            drawn = seats(block, pair, word, received(row["state"]) if sweep else None, totals, sweep, None if last else mine)
            add = lambda at, weights: np.bincount(at[mine], weights=weights[mine], minlength=n).astype(np.int64)
            columns = [add(block.pair_context, pair[0])]
            for t in drawn:
                columns += [add(block.pair_context, t), add(block.pair_word, t)]
            yield from sent(row["block"], block.vocabulary, columns, bits[0])
            if last:
                # of pairs of one customer there is no need to keep the table
                yield kept(row["block"], [t[pair[0] > 1] for t in drawn])

        def parent(keys, sums, place, owner, sweep: int = sweep, totals: dict = dict(totals)) -> list[np.ndarray]:
            out = [sums[0][place]]
            for chain in range(CHAINS):
                customers = sums[2 + 2 * chain]
                mass = np.full(len(keys), (ROOT_STRENGTH + ROOT_DISCOUNT * (totals["tables"][chain] if sweep else totals["v"])) / (totals["v"] + 1))
                own = tables(customers, mass, ROOT_DISCOUNT, keys, 500 + 1000 * sweep + chain)
                out += [sums[1 + 2 * chain][place], customers[place], own[place]]
            return [*out, owner]

        answered = {"pairs": pairs, "words": words} | ({"state": state} if sweep else {})
        before, state = state, written(answers(each_block(blocks, seated, SENT, **answered), parent))
        if before is not None:
            dropped(before)

        def counted(row: dict) -> Iterator[dict]:
            if row["bucket"] < 0:
                return
            columns = received([row])
            mine = columns[-1] > 0
            yield {f"{k}{c}": int(columns[i + 3 * c][mine].sum()) for c in range(CHAINS) for k, i in (("customers", 2), ("tables", 3))}

        fields = [f"{k}{c}" for k in ("customers", "tables") for c in range(CHAINS)]
        sums = each_block(state, counted, ", ".join(f"{f} long" for f in fields)).agg(*[F.coalesce(F.sum(f), F.lit(0)).alias(f) for f in fields]).first()
        totals |= {k: [sums[f"{k}{c}"] for c in range(CHAINS)] for k in ("customers", "tables")}

    def scored(row: dict) -> Iterator[dict]:
        block = Block(row)
        block.pairs()
        pair, word, now = received(row["pairs"]), received(row["words"]), received(row["state"])
        drawn = []
        for c in next(x["columns"] for x in row["state"] if x["bucket"] < 0):
            drawn.append(np.minimum(pair[0], 1))
            drawn[-1][pair[0] > 1] = unpack(c)
        chance = np.zeros(len(block.tokens))
        customers = now[0]
        for chain in range(CHAINS):
            open_tables = now[1 + 3 * chain]
            shared = (STRENGTH + DISCOUNT * open_tables) / (STRENGTH + customers)
            own = np.maximum(pair[0] - DISCOUNT * drawn[chain], 0) / (STRENGTH + customers[block.pair_context])
            both = own + shared[block.pair_context] * root(now, chain, totals)[block.pair_word]
            chance += both[block.pair] / CHAINS
        base = np.log10((word[0] + 0.1) / (totals["n"] + 0.1 * (totals["v"] + 1)))[block.tokens]
        begin = np.r_[0, np.cumsum(block.lengths)[:-1]]
        over = lambda values: np.add.reduceat(values, begin)
        known, base, chance = over((word[0] > 0)[block.tokens].astype(np.int64)), over(base), over(np.log10(chance))
        for i, doc_id in enumerate(block.doc_ids):
            yield {"doc_id": doc_id, "held_out": bool(block.held[i]), "n_tokens": int(block.lengths[i]), "n_known": int(known[i]), "train_tokens": totals["n"], "base_score": float(base[i]), "score": float(chance[i])}

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    result = written(each_block(blocks, scored, schema, pairs=pairs, words=words, state=state))
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    return result
