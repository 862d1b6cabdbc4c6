"""A Merkle manifest of a dataset, and proofs climbed by a recursive query.

A row's leaf is the sha256 of its fields with their lengths. Leaves of a source ascend by doc_id; every
16 consecutive nodes become one node of the next level until one is left, the source's subroot. The
subroots, ordered by source, form a tree of the same kind with the dataset's root.

The levels are stored as node rows (node, parent, digests of the siblings before and after it). A
recursive Spark query climbs from the leaves to the root: each step joins a node with its row, appends
its siblings to the proof and folds the hash. The leaves of one run of 16 have all ancestors
in common, so they climb as one row that holds the hash of each of them and their common proof once; a
step shuffles a sixteenth of the leaves.

Defined results: a null field counts as `-`; null doc_ids come first, rows with one doc_id follow each
other by their digests; equal rows are leaves of their own; an empty table has no rows; columns beside the
five fields are ignored, whatever their names; a text of any length is hashed whole where it is read.
"""

from __future__ import annotations

from functools import reduce
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimcheck.functions.numbering import numbered
from claimcheck.llm.common import tidy, written

WIDTH = 16
FIELDS = {"doc_id": "long", "source": "string", "lang": "string", "n_chars": "long", "text": "string"}
#: Spark ends a recursive query at this many rows unless told otherwise (-1: never).
ROW_LIMIT = "spark.sql.cteRecursionRowLimit"


def field(value: Column) -> Column:
    """`-` for null, else UTF-8 byte count, `:` and value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(text: Column) -> Column:
    """Raw sha256."""
    return F.unhex(F.sha2(text, 256))


def shown(raw: Column | str) -> Column:
    """A raw digest, or several, as lowercase hex text."""
    return F.lower(F.hex(raw))


def leaf_hash(*values: Column) -> Column:
    return digest(F.concat(*[field(v) for v in values]))


def tampered_text(doc_id: Column, text: Column) -> Column:
    """Where 5 divides crc32 of the decimal doc_id, A-Z in lower case."""
    hit = F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return F.when(hit, F.translate(text, ascii_uppercase, ascii_lowercase)).otherwise(text)


def leaves(docs: DataFrame, tamper=tampered_text) -> DataFrame:
    """doc_id, source, leaf and start: the leaf of the tampered row, null if it is the same.

    tamper(doc_id, text) gives the tampered text.
    """
    rows = docs.select(*[docs[c].cast(t).alias(c) for c, t in FIELDS.items()])
    rows = rows.withColumn("other", tamper(F.col("doc_id"), F.col("text")))
    start = leaf_hash(*[F.col(c) for c in FIELDS if c != "text"], F.col("other"))
    return rows.select(
        "doc_id", "source",
        leaf_hash(*[F.col(c) for c in FIELDS]).alias("leaf"),
        F.when(~F.col("text").eqNullSafe(F.col("other")), start).alias("start"),
    )


def _node(tree: Column | str, level: int, at: Column) -> Column:
    tree = F.lit(tree) if isinstance(tree, str) else tree.cast("string")
    return F.concat(tree, F.lit(f"/{level}/"), at.cast("string"))


def _run(at: str = "at") -> Column:
    return F.expr(f"{at} div {WIDTH}")


def _parent(entries: Column | str) -> list[Column]:
    """The digest of a node and the digests of its children, all raw, from entries with a digest."""
    text = F.array_join(F.transform(entries, lambda e: shown(e["digest"])), "")
    return [digest(text).alias("digest"), F.unhex(text).alias("children")]


def _fewer() -> Column:
    """Nodes of a tree's next level."""
    return F.expr(f"(n + {WIDTH - 1}) div {WIDTH}").alias("n")


def _levels(bottom: DataFrame, most: int) -> list[DataFrame]:
    """The stored levels above bottom (tree, at, digest, n: nodes of the tree's level); most is its largest n.

    A row (tree, at, n, digest, children) is a node with the digests of its children, all raw.
    """
    found = []
    while most > 1:
        entries = F.array_sort(F.collect_list(F.struct("at", "digest"))).alias("entries")
        runs = bottom.where("n > 1").groupBy("tree", _run().alias("at"), _fewer()).agg(entries)
        bottom = written(runs.select("tree", "at", "n", *_parent("entries")))
        found.append(bottom)
        most = -(-most // WIDTH)
    return found


def _node_rows(level: DataFrame, height: int, top: bool) -> DataFrame:
    """(node, parent, left, right) of the children of a level's nodes; left and right are their siblings, raw.

    A source's subroot is the node of its number at the bottom of the top tree.
    """
    tree = "top" if top else F.col("tree")
    parent = _node(tree, height, F.col("at"))
    if not top:
        parent = F.when(F.col("n") == 1, _node("top", 0, F.col("tree"))).otherwise(parent)
    each = F.expr("explode(sequence(0L, octet_length(children) div 32 - 1))").alias("k")
    rows = level.select(parent.alias("parent"), "tree", "at", "children", each)
    return rows.select(
        _node(tree, height - 1, F.col("at") * WIDTH + F.col("k")).alias("node"), "parent",
        F.expr("substring(children, 1, int(32 * k))").alias("left"), F.expr("substring(children, int(32 * k + 33))").alias("right"),
    )


def build(rows: DataFrame) -> tuple[DataFrame, DataFrame, str] | None:
    """Runs of leaves, node rows and the root; None without rows.

    Runs: node (their parent's name), subroot and entries, up to 16 of (doc_id, leaf, start), raw. Node rows:
    node, parent, left and right (raw digests of the siblings before and after it).
    """
    sources = written(numbered(rows.groupBy("source").agg(F.count("*").alias("n")), [], ["source"], "tree", written).withColumnRenamed("source", "_source"))
    most, n_trees = sources.agg(F.max("n"), F.count("*")).first()
    if not n_trees:
        return None
    placed = numbered(rows, ["source"], ["doc_id", "leaf", "start"], "at", written)
    bottom = placed.join(sources, F.col("source").eqNullSafe(F.col("_source")))
    entries = F.array_sort(F.collect_list(F.struct("at", F.col("leaf").alias("digest"), "doc_id", "start"))).alias("entries")
    runs = written(bottom.groupBy("tree", _run().alias("at"), "n").agg(entries))

    first = written(runs.where("n > 1").select("tree", "at", _fewer(), *_parent("entries")))
    levels = [first, *_levels(first, -(-most // WIDTH))]
    subroots = runs.where("n = 1").select("tree", F.col("entries")[0]["digest"].alias("digest"))
    for level in levels:
        subroots = subroots.unionByName(level.where("n = 1").select("tree", "digest"))
    subroots = written(subroots)
    upper = _levels(subroots.select(F.lit("top").alias("tree"), F.col("tree").alias("at"), "digest", F.lit(n_trees).alias("n")), n_trees)
    root = (upper[-1] if upper else subroots).select(shown("digest")).first()[0]

    # the leaves climb by runs, so node rows begin with the children of the second level
    tables = [_node_rows(level, i, False) for i, level in enumerate(levels, 1) if i > 1] + [_node_rows(level, i, True) for i, level in enumerate(upper, 1)]
    nodes = reduce(DataFrame.unionByName, tables or [_node_rows(first.limit(0), 1, True)])

    name = F.when(F.col("n") <= WIDTH, _node("top", 0, F.col("tree"))).otherwise(_node(F.col("tree"), 1, F.col("at")))
    runs = runs.withColumn("node", name).join(subroots, "tree")
    leaf = lambda e: F.struct(e["doc_id"].alias("doc_id"), e["digest"].alias("leaf"), e["start"].alias("start"))
    return runs.select("node", shown("digest").alias("subroot"), F.transform("entries", leaf).alias("entries")), written(nodes), root


def _siblings(place: Column) -> tuple[Column, Column]:
    """The leaves of a run before and after a place, as hex text."""
    leaf = F.transform("entries", lambda e: shown(e["leaf"]))
    return F.array_join(F.slice(leaf, F.lit(1), place), ""), F.array_join(F.slice(leaf, place + 2, F.lit(WIDTH)), "")


def climb(runs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Of each run: node, folds (the different hashes of its leaves at the root), which (the fold of each leaf) and proof.

    Leaves as stored give one hash at their run, so folds has one entry for them and one for each tampered
    leaf. A step's row holds the siblings that it appends; only names and hashes go on to the next step.
    """

    # a lone leaf is its source's subroot; a last run of one leaf has a node of its own
    lone = (F.size("entries") == 1) & F.col("node").startswith("top/")
    start = lambda e: F.coalesce(e["start"], e["leaf"])

    def folded(entry: Column, place: Column) -> Column:
        before, after = _siblings(place)
        return digest(F.concat(before, shown(start(entry)), after))

    hashed = F.when(lone, F.transform("entries", start)).otherwise(F.transform("entries", folded))
    starts = runs.select("node", hashed.alias("hashed")).select("node", "hashed", F.array_distinct("hashed").alias("folds"))
    which = F.transform("hashed", lambda h: F.array_position("folds", h).cast("int"))
    starts = written(starts.select("node", "folds", which.alias("which")))
    spark = runs.sparkSession
    found = spark.sql(
        """
        WITH RECURSIVE climb (run, node, step, folds, before, after) AS (
            SELECT node, node, 0, folds, X'', X'' FROM {starts}
            UNION ALL
            SELECT c.run, n.parent, c.step + 1,
                   transform(c.folds, f -> unhex(sha2(concat(lower(hex(n.left)), lower(hex(f)), lower(hex(n.right))), 256))),
                   n.left, n.right
            FROM climb c JOIN {nodes} n ON c.node = n.node
        )
        SELECT run, array_sort(collect_list(struct(step, before, after, folds))) AS steps FROM climb GROUP BY run
        """,
        starts=starts, nodes=nodes,
    )
    proof = F.aggregate("steps", F.expr("X''"), lambda a, x: F.concat(a, x["before"], x["after"]))
    top = F.element_at("steps", -1)["folds"]
    limit = spark.conf.get(ROW_LIMIT, None)
    spark.conf.set(ROW_LIMIT, "-1")
    try:
        climbed = written(found.select(F.col("run").alias("node"), top.alias("folds"), proof.alias("proof")))
    finally:
        if limit is None:
            spark.conf.unset(ROW_LIMIT)
        else:
            spark.conf.set(ROW_LIMIT, limit)
    return climbed.join(starts.select("node", "which"), "node")


PROVEN = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


@tidy
def prove(docs: DataFrame, tamper=tampered_text) -> DataFrame:
    """For each row its leaf, subroot and root, the digest of its proof, and the root folded from its tampered leaf."""
    built = build(leaves(docs, tamper))
    if built is None:
        return docs.sparkSession.createDataFrame([], PROVEN)
    runs, nodes, root = built
    each = runs.join(climb(runs, nodes), "node").select("subroot", "entries", "folds", "which", "proof", F.posexplode("entries").alias("place", "e"))
    near = F.concat(*_siblings(F.col("place")))
    folded = shown(F.element_at("folds", F.element_at("which", F.col("place") + 1)))
    return each.select(
        "e.doc_id", shown("e.leaf").alias("leaf"), "subroot", F.lit(root).alias("root"),
        F.sha2(F.concat(near, shown("proof")), 256).alias("proof_sha256"),
        folded.alias("folded_root"), (folded == root).alias("verified"),
    )
