"""Quality rules: robust multivariate outliers among the statistics of texts.

Four statistics of each text (length of words, symbols, repeated lines, repeated word windows) are
transformed and rounded to integers. Per language and source the minimum-covariance-determinant method
finds centre and covariance of the densest three quarters of the rows: from four starting subsets,
concentration steps keep the rows nearest by Mahalanobis distance, and the start that ends with the
smallest determinant counts. A row whose distance to its group is too large is rejected.

All of it is DataFrame expressions. A step is one aggregation by (group, start, distance class) over
integers, so its result does not depend on the order of rows, and no group is gathered anywhere: what
is ordered is the histogram of distances, whose classes are a sixteenth wide.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from claimcheck.llm.common import tidy, written

WORD = r"[^\x20\x09-\x0D]+"
#: Statistics are rounded to this fraction of one.
GRAIN = 256
#: Standard deviations, in units of GRAIN, that the statistics have at least.
FLOORS = (13, 13, 32, 32)
#: Starting subsets besides all rows.
STARTS = 3
STEPS = 4
#: Groups of fewer rows reject nothing.
LEAST_ROWS = 40
#: Squared distances: the 0.99999 point of chi-squared with 4 degrees of freedom, times the factor by
#: which the covariance of the densest three quarters of a normal sample is too small.
CUTOFF = 28.47 * 1.486
DIMENSIONS = range(4)
PAIRS = [(i, j) for i in DIMENSIONS for j in DIMENSIONS if j <= i]


def _bound(value: Column, use) -> Column:
    """use(value) with value computed once."""
    return F.transform(F.array(value), use)[0]


def repeated_words(words: Column) -> Column:
    """Words in windows of three that occur at least twice in the array, each word counted once."""

    def covered(windows: Column) -> Column:
        ordered = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))

        def places(s: Column) -> Column:
            same = lambda x, i: F.coalesce(x["h"] == F.get(s, i)["h"], F.lit(False))
            return F.sort_array(F.transform(F.filter(s, lambda x, i: same(x, i - 1) | same(x, i + 1)), lambda x: x["p"]))

        def total(p: Column) -> Column:
            gaps = F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3))))
            return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, b: a + b)

        found = _bound(_bound(ordered, places), total)
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("long")).otherwise(found)

    def of(w: Column) -> Column:
        window = lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
        return _bound(F.transform(F.sequence(F.lit(0), F.size(w) - 3), window), covered)

    return _bound(words, lambda w: F.when(F.size(w) >= 3, of(w)).otherwise(F.lit(0).cast("long")))


def statistics(docs: DataFrame, *carried: Column) -> DataFrame:
    """doc_id, language, source and the counts of each text, after the carried columns; a null text has no words."""
    rows = docs.select(*carried, docs["doc_id"].cast("long").alias("doc_id"), docs["lang"].cast("string").alias("lang"), docs["source"].cast("string").alias("source"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    words = F.transform(F.array(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))), _counts)[0]
    kept = [c for c in rows.columns if c != "text"]
    counted = rows.select(
        *kept, words.alias("w"),
        F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.transform(F.array(lines), lambda x: F.size(x) - F.size(F.array_distinct(x)))[0].cast("long").alias("n_dup_lines"),
    )
    return counted.select(*kept, "w.n_words", "w.word_chars", "n_symbols", "n_dup_lines", "w.n_repeat_words")


def _counts(w: Column) -> Column:
    return F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
        repeated_words(w).alias("n_repeat_words"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def transformed() -> list[Column]:
    """The statistics as integers: logarithms of word length and of symbols per word, square roots of shares."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    values = [F.log1p(F.col("word_chars") / n), F.log1p(F.col("n_symbols") / n), F.sqrt(F.col("n_dup_lines") / n), F.sqrt(F.col("n_repeat_words") / n)]
    return [F.floor(v * GRAIN + 0.5).cast("long").alias(f"x{i}") for i, v in enumerate(values)]


def _solved(sums: DataFrame, *keys: str) -> DataFrame:
    """Centre m, the factors of the covariance (unit lower triangle l, diagonal d) and its determinant."""
    n = F.col("n").cast("double")
    df = sums.select(*keys, "total", *[(F.col(f"s{i}") / n).alias(f"m{i}") for i in DIMENSIONS], *[F.col(f"p{i}{j}") for i, j in PAIRS], n.alias("n"))
    df = df.withColumns({f"c{i}{j}": F.col(f"p{i}{j}") / F.col("n") - F.col(f"m{i}") * F.col(f"m{j}") + (float(FLOORS[i] ** 2) if i == j else 0.0) for i, j in PAIRS})
    for i in DIMENSIONS:
        for j in range(i):
            rest = F.col(f"c{i}{j}")
            for k in range(j):
                rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}") * F.col(f"d{k}")
            df = df.withColumn(f"l{i}{j}", rest / F.col(f"d{j}"))
        rest = F.col(f"c{i}{i}")
        for k in range(i):
            rest = rest - F.col(f"l{i}{k}") * F.col(f"l{i}{k}") * F.col(f"d{k}")
        df = df.withColumn(f"d{i}", rest)
    found = [f"m{i}" for i in DIMENSIONS] + [f"l{i}{j}" for i, j in PAIRS if i != j] + [f"d{i}" for i in DIMENSIONS]
    return df.select(*keys, "total", *found, (F.col("d0") * F.col("d1") * F.col("d2") * F.col("d3")).alias("det"))


def distance() -> Column:
    """Squared Mahalanobis distance of x0..x3 by forward substitution."""
    y: list[Column] = []
    for i in DIMENSIONS:
        value = F.col(f"x{i}") - F.col(f"m{i}")
        for k in range(i):
            value = value - F.col(f"l{i}{k}") * y[k]
        y.append(value)
    total = y[0] * y[0] / F.col("d0")
    for i in range(1, 4):
        total = total + y[i] * y[i] / F.col(f"d{i}")
    return total


def _sums() -> list[Column]:
    return [F.count(F.lit(1)).alias("n"), *[F.sum(f"x{i}").alias(f"s{i}") for i in DIMENSIONS], *[F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"p{i}{j}") for i, j in PAIRS]]


def _again() -> list[Column]:
    return [F.sum("n").alias("n"), *[F.sum(f"s{i}").alias(f"s{i}") for i in DIMENSIONS], *[F.sum(f"p{i}{j}").alias(f"p{i}{j}") for i, j in PAIRS]]


@tidy
def estimates(rows: DataFrame) -> DataFrame:
    """Centre and covariance of each group (lang, source) of rows (doc_id, lang, source, x0..x3)."""
    group, key = ["lang", "source"], ["lang", "source", "start"]
    own = F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(STARTS)).cast("int") + 1
    parts = rows.groupBy(*group, own.alias("start")).agg(*_sums())
    whole = parts.groupBy(*group).agg(F.lit(0).alias("start"), *_again())
    total = F.sum(F.when(F.col("start") == 0, F.col("n"))).over(W.partitionBy(*group))
    found = written(_solved(whole.select(parts.columns).unionByName(parts).withColumn("total", total), *key))
    for _ in range(STEPS):
        classes = rows.join(found.withColumnsRenamed({"lang": "g_lang", "source": "g_source"}), rows["lang"].eqNullSafe(F.col("g_lang")) & rows["source"].eqNullSafe(F.col("g_source")))
        counted = classes.groupBy(*key, "total", F.floor(16 * F.sqrt(distance())).alias("b")).agg(*_sums())
        before = F.sum("n").over(W.partitionBy(*key).orderBy("b")) - F.col("n")
        kept = counted.withColumn("before", before).where(F.col("before") < F.floor((3 * F.col("total") + 3) / 4))
        found = written(_solved(kept.groupBy(*key, "total").agg(*_again()), *key))
    rank = F.row_number().over(W.partitionBy(*group).orderBy("det", "start"))
    return found.withColumn("rank", rank).where("rank = 1").drop("rank", "start")


def _judged(rows: DataFrame, found: DataFrame) -> DataFrame:
    group = found.withColumnsRenamed({"lang": "g_lang", "source": "g_source"})
    both = rows.join(group, rows["lang"].eqNullSafe(F.col("g_lang")) & rows["source"].eqNullSafe(F.col("g_source")), "left")
    far = F.coalesce((F.col("total") >= LEAST_ROWS) & (distance() > CUTOFF), F.lit(False))
    return both.withColumn("kept", ~F.col("base_failed") & ~far)


def _measured(docs: DataFrame, *carried: Column) -> DataFrame:
    return statistics(docs, *carried).withColumn("base_failed", base_failed()).select("*", *transformed())


def _learned(rows: DataFrame) -> DataFrame:
    return estimates(rows.where("not base_failed").select("doc_id", "lang", "source", *[f"x{i}" for i in DIMENSIONS]))


def judged(docs: DataFrame) -> DataFrame:
    """The counts of every document, base_failed and kept.

    A text that fails the base rule takes no part in the estimates. Groups are formed by language and
    source, null being a value of its own; in groups of fewer than LEAST_ROWS rows the method rejects
    nothing. Repeated rows and ids are judged each on its own. An empty table gives no rows.
    """
    rows = written(_measured(docs))
    return _judged(rows, _learned(rows)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def keep(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, that are kept. Statistics are taken twice, so that no text is written."""
    row = F.struct(*[docs[c] for c in docs.columns]).alias("row")
    found = _kept_estimates(docs)
    return _judged(_measured(docs, row), found).where("kept").select("row.*")


@tidy
def _kept_estimates(docs: DataFrame) -> DataFrame:
    return _learned(written(_measured(docs)))
