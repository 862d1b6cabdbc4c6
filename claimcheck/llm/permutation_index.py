"""Approximate nearest neighbours by a permutation index.

A bounded number of vectors serve as pivots. Every vector is represented by its nearest pivots in order
and posted, with the place of the pivot in that order, in the inverted file of each of them. A query
reads the inverted files of its own nearest pivots; Spearman's footrule, a missing pivot counting as
one behind the last, ranks the posted vectors, and the best share of them is ranked again by cosine.

The index is kept in blocks of vectors dealt by hash; a block of queries meets every block of the
index, each pair in a task of its own, and only the few best of each pair go on. Equal vectors are
indexed once: of each vector the k + 1 smallest ids can be among the nearest of any query.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from claimcheck.llm.common import tidy, written

PIVOTS = 256
PREFIX = 48
RERANK_SHARE = 0.12
RERANK_LEAST = 256
INDEX_BLOCK = 2048
QUERY_BLOCK = 1024


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id and v (doubles) of the rows that take part, each once.

    Out are null ids, null or zero vectors, vectors with a null or non-finite component, and vectors of
    another length than most (of equally frequent lengths the smallest counts).
    """
    v = F.col("v")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.where(F.col("vec_id").isNotNull() & v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0))
    common = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return rows.where(F.size("v") == (common[0]["n"] if common else 0)).dropDuplicates(["vec_id", "v"])


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def prefixes(x: np.ndarray, pivots: np.ndarray, length: int) -> np.ndarray:
    """The numbers of the nearest pivots of each unit vector, nearest first."""
    return np.argsort(-(x @ pivots.T), axis=1, kind="stable")[:, :length]


def inverted_files(order: np.ndarray, pivots: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vector numbers and places by pivot, and where each pivot's file begins."""
    n, length = order.shape
    by_pivot = np.argsort(order.ravel(), kind="stable")
    return by_pivot // length, by_pivot % length, np.searchsorted(order.ravel()[by_pivot], np.arange(pivots + 1))


def footrule_gain(query: np.ndarray, files: tuple[np.ndarray, np.ndarray, np.ndarray], n: int) -> np.ndarray:
    """How far each vector's footrule distance to the query is below that of sharing no pivot."""
    numbers, places, begin = files
    length = len(query)
    spans = [(begin[p], begin[p + 1]) for p in query]
    who = np.concatenate([numbers[a:b] for a, b in spans])
    gain = np.concatenate([2 * length - i - places[a:b] - np.abs(places[a:b] - i) for i, (a, b) in enumerate(spans)])
    return np.bincount(who, weights=gain, minlength=n)


@tidy
def nearest(vectors: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", pivots: int = PIVOTS) -> DataFrame:
    """query_id, rank (from 1), vec_id and score (cosine) of the k nearest found of each query row.

    is_query is a condition on vec_id. A query's own id is no candidate of it; ties go to the smaller
    vec_id; a query with fewer than k candidates gets all of them. An empty table gives no rows.
    """
    rows = written(usable(vectors, id_col, vector_col))
    spark = vectors.sparkSession
    by_vector = W.partitionBy("v").orderBy("vec_id")
    distinct = written(rows.withColumn("n", F.row_number().over(by_vector)).where(F.col("n") <= k + 1).groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")))
    queries = rows.where(is_query)
    blocks, query_blocks = (max(1, -(-df.count() // size)) for df, size in ((distinct, INDEX_BLOCK), (queries, QUERY_BLOCK)))
    chosen = distinct.orderBy(F.xxhash64(F.col("ids")[0]), F.col("ids")[0]).limit(pivots).collect()
    if not chosen:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    centres = unit(np.array([r["v"] for r in chosen]))
    length = min(PREFIX, len(centres))

    def search(index: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if index.empty or asked.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})
        x, q = unit(np.stack(index["v"].to_list())), unit(np.stack(asked["v"].to_list()))
        files, order = inverted_files(prefixes(x, centres, length), len(centres)), prefixes(q, centres, length)
        best, out = max(RERANK_LEAST, int(RERANK_SHARE * len(x))), []
        ids = index["ids"].to_list()
        for number, query_id in enumerate(asked["vec_id"].to_list()):
            near = np.argsort(-footrule_gain(order[number], files, len(x)), kind="stable")[:best]
            score = (x[near] * q[number]).sum(axis=1)
            last = -np.partition(-score, k)[k] if len(near) > k else -np.inf
            found = sorted((-score[i], v) for i in np.flatnonzero(score >= last) for v in ids[near[i]] if v != query_id)[:k]
            out += [(query_id, v, -s) for s, v in found]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    block = lambda n, *c: F.pmod(F.xxhash64(*c), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    index = distinct.select("v", "ids", block(blocks, "v").alias("vb"), each(query_blocks).alias("qb"))
    asked = queries.select("vec_id", "v", block(query_blocks, "vec_id").alias("qb"), each(blocks).alias("vb"))
    found = index.groupBy("vb", "qb").cogroup(asked.groupBy("vb", "qb")).applyInPandas(search, "query_id long, vec_id long, score double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
