"""Jaccard join on word shingles by a MinHash LSH forest with exact verification.

Texts with equal shingle sets are one node. A node has a label in each of many prefix trees: a row of
min-hash values. In each tree the nodes are matched by a prefix of their labels; starting from whole
labels the prefix is shortened until a pair at the threshold meets in some tree with the target
probability (at the default values all but three in a million). Nodes that share a prefix are
linked to the least of them, never to each other, and the components of these links are searched
for pairs exactly, by common shingles. Components larger than a block are dealt out in pairs of blocks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimcheck.llm.common import tidy, written
from claimcheck.llm.components import components
from claimcheck.llm.shingles import WordHashes, mixed, shingle_set

TREES = 32
DEPTH = 8
RECALL = 0.99999
BLOCK = 1024


def matched_prefix(threshold: float, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> int:
    """The longest prefix at which a pair at the threshold meets in a tree with the wanted probability."""
    length = depth
    while length > 1 and 1 - (1 - threshold**length) ** trees < recall:
        length -= 1
    return length


def signature(shingles: np.ndarray, values: int) -> np.ndarray:
    """Min-hash values: least of a random linear function of the shingles, for each of many functions."""
    seeds = np.random.default_rng(7).integers(1, 1 << 32, size=(2, values), dtype=np.uint32) | np.array([[1], [0]], dtype=np.uint32)
    low, out = shingles.astype(np.uint32), np.full(values, 0xFFFFFFFF, dtype=np.uint32)
    with np.errstate(over="ignore"):
        for at in range(0, len(low), 4096):
            part = low[at : at + 4096]
            out = np.minimum(out, (seeds[0][:, None] * part[None, :] + seeds[1][:, None]).min(axis=1))
    return out


def prefix_keys(shingles: np.ndarray, trees: int, length: int) -> np.ndarray:
    """One 64-bit key per tree for the prefix of the label there."""
    labels = signature(shingles, trees * length).reshape(trees, length).astype(np.uint64)
    key = np.arange(trees, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(length):
            key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + labels[:, i])
    return key.astype(np.int64)


def node_of(shingles: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(shingles.tobytes()) - (1 << 63)


def labelled(docs: DataFrame, words: int, trees: int, length: int) -> DataFrame:
    """doc_id, node and keys of every text with a word."""

    def rows(batches):
        hashes = WordHashes()
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                s = shingle_set(hashes.of(text.as_py()), words)
                if len(s):
                    out.append((doc_id, node_of(s), prefix_keys(s, trees, length)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.list_(pa.int64()))], names=["doc_id", "node", "keys"])

    return docs.mapInArrow(rows, "doc_id long, node long, keys array<long>")


def _linked(sets: list[np.ndarray], split: int | None, threshold: float) -> np.ndarray:
    """Matrix of links between sets; with split, only those between the first ones and the rest."""
    sizes = np.array([len(s) for s in sets])
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.r_[True, flat[1:] != flat[:-1]]
    column = np.cumsum(new) - 1
    shared = np.bincount(column)[column] > 1
    column, owner = np.unique(column[shared], return_inverse=True)[1], owner[shared]
    common = np.zeros((len(sets), len(sets)), dtype=np.float32)
    begins = np.searchsorted(column, np.arange(0, (column[-1] if len(column) else -1) + 2048, 2048))
    for i, (a, b) in enumerate(zip(begins, begins[1:], strict=False)):
        part = np.zeros((len(sets), 2048), dtype=np.float32)
        part[owner[a:b], column[a:b] - 2048 * i] = 1
        common += part @ part.T
    either = sizes[:, None] + sizes[None, :] - common
    links = common >= threshold * either - 1e-6
    np.fill_diagonal(links, False)
    if split is not None:
        links[:split, :split] = links[split:, split:] = False
    return links


def _labels(links: np.ndarray) -> np.ndarray:
    """The least member of each one's component."""
    label = np.arange(len(links))
    while True:
        least = np.where(links, label[None, :], len(links)).min(axis=1)
        new = np.minimum(label, least)
        new = new[new]
        if (new == label).all():
            return label
        label = new


@tidy
def join(docs: DataFrame, threshold: float = 0.8, words: int = 5, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> DataFrame:
    """doc_id, class_id and n_links of every row of docs.

    A link joins two documents whose shingle sets (runs of `words` words; all words of a shorter text)
    have a Jaccard similarity of at least the threshold. n_links counts the other documents linked to
    one, copies included; class_id is the least doc_id of the documents connected by links. A null
    text or one without words has no link and its own id as class. Rows without doc_id have neither:
    class_id null, n_links 0. Rows of one doc_id count as copies if their texts agree; an empty table
    gives no rows; other columns are ignored.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = texts.where(F.col("doc_id").isNotNull())
    found = written(labelled(known, words, trees, matched_prefix(threshold, trees, depth, recall)))
    nodes = written(found.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies")))
    posted = found.select("node", F.explode("keys").alias("key"))
    heads = posted.groupBy("key").agg(F.min("node").alias("head"), F.max("node").alias("tail")).where("head < tail").select("key", "head")
    near = components(posted.join(heads, "key").where("node != head").select(F.col("node").alias("u"), F.col("head").alias("v")))
    links = _verified(known, nodes, near, threshold, words)
    label = components(links.where("other is not null").select(F.col("node").alias("u"), F.col("other").alias("v")))
    counted = links.groupBy("node").agg(F.sum("links").alias("links"))
    by_node = nodes.join(label, "node", "left").join(counted, "node", "left").select("node", "copies", "doc_id", F.coalesce("label", "node").alias("label"), F.coalesce("links", F.lit(0)).alias("links"))
    by_node = written(by_node)
    classes = by_node.groupBy("label").agg(F.min("doc_id").alias("class_id"))
    numbers = by_node.join(classes, "label").select("node", "class_id", (F.col("links") + F.col("copies") - 1).alias("n_links"))
    linked = found.select("doc_id", "node").join(numbers, "node").select("doc_id", "class_id", "n_links")
    blank = texts.where(F.col("doc_id").isNull() | ~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False)))
    return linked.unionByName(blank.select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links")))


def representatives(docs: DataFrame, **options) -> DataFrame:
    """One document of each class, that of the least doc_id, with all its columns; a repeated row stays once.

    Documents without words and rows without doc_id stay.
    """
    classes = join(docs, **options)
    gone = _ids(classes.where("doc_id != class_id")).withColumnRenamed("doc_id", "gone_id")
    again = _ids(classes.where("doc_id is not null").groupBy("doc_id").count().where("count > 1"))
    stay = docs.join(gone, docs["doc_id"].cast("long") == F.col("gone_id"), "left_anti")
    repeated = again.withColumnRenamed("doc_id", "again_id")
    same = F.col("doc_id").cast("long") == F.col("again_id")
    once = stay.join(repeated, same, "left_anti")
    return once.unionByName(stay.join(repeated, same, "left_semi").dropDuplicates(["doc_id", "text"]))


def _ids(rows: DataFrame) -> DataFrame:
    """The distinct doc_ids, written: where they are few, Spark sends them instead of shuffling the texts."""
    return written(rows.select("doc_id").distinct())


def _verified(texts: DataFrame, nodes: DataFrame, near: DataFrame, threshold: float, words: int) -> DataFrame:
    """node, other (null or a node of its component) and links (linked documents) from each unit of work."""
    near = written(near)
    sizes = near.groupBy("label").agg(F.count(F.lit(1)).alias("size"))
    units = max(1, near.count() // BLOCK)
    asked = near.join(sizes, "label").join(nodes, "node").select("node", "label", "doc_id", "copies", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))

    def sets(batches):
        hashes = WordHashes()
        for batch in batches:
            text, node = batch.column(5), batch.column(0).to_pylist()
            found = [shingle_set(hashes.of(t.as_py()), words) for t in text]
            keep = [len(s) > 0 and node_of(s) == n for s, n in zip(found, node, strict=True)]
            kept = batch.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([*kept.columns[:2], *kept.columns[3:5], pa.array([s.tobytes() for s, k in zip(found, keep, strict=True) if k], pa.binary())], names=["node", "label", "copies", "blocks", "shingles"])

    ids = written(asked.select("doc_id").distinct())
    with_text = asked.join(texts.join(ids, "doc_id", "left_semi"), "doc_id").select("node", "label", "doc_id", "copies", "blocks", "text")
    found = with_text.mapInArrow(sets, "node long, label long, copies long, blocks int, shingles binary")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = found.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    unit = F.when(F.col("blocks") == 1, F.struct(F.pmod(F.xxhash64("label"), F.lit(units)).alias("a"), F.lit(-1).alias("i"), F.lit(-1).alias("j")))
    unit = unit.otherwise(F.struct(F.col("label").alias("a"), F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")))

    def links(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, part in rows.drop_duplicates(["node", "label"]).groupby("label", sort=False):
            part = part.sort_values(["own", "node"])
            i, j = part["i"].iat[0], part["j"].iat[0]
            if len(part) < 2:
                continue
            split = int((part["own"] == i).sum()) if i != j else None
            matrix = _linked([np.frombuffer(s, dtype=np.uint64) for s in part["shingles"]], split, threshold)
            node, label = part["node"].to_numpy(), _labels(matrix)
            weight = matrix @ part["copies"].to_numpy()
            some = weight > 0
            out.append(pd.DataFrame({"node": node[some], "other": node[label][some], "links": weight[some].astype("int64")}))
        return pd.concat(out) if out else pd.DataFrame({"node": [], "other": [], "links": []}).astype("int64")

    dealt = dealt.select(unit.alias("unit"), "node", "label", "copies", "own", "shingles").select("unit.*", "node", "label", "copies", "own", "shingles")
    return written(dealt.groupBy("a", "i", "j").applyInPandas(links, "node long, other long, links long"))
