from pyspark.sql import functions as F

from claimcheck.operators import catalog
from tests.helpers import urn

TEXTS = "asset_urn string, field_path string, description string"


def test_edited_text_wins_unless_empty(spark):
    ingested = spark.createDataFrame(
        [("a", None, "table"), ("a", "x", "old"), ("a", "y", "kept"), ("a", "z", ""),
         ("b", None, None)], TEXTS)
    edited = spark.createDataFrame(
        [("a", None, "edited table"), ("a", "x", "new"), ("a", "y", ""), ("a", "only", "e")], TEXTS)
    found = catalog.effective_descriptions(ingested, edited).collect()
    assert {(r[0], r[1]): r[2] for r in found} == {
        ("a", None): "edited table", ("a", "x"): "new", ("a", "y"): "kept", ("a", "only"): "e"}
    assert len(found) == 4


def test_names_inside_an_asset(spark):
    rows = spark.createDataFrame(
        [(u,) for u in (urn("t"), urn("t-x"), "urn:li:dataset:(urn:li:dataPlatform:p,t,DEV)",
                        "plain.name", "a,b.c")], "asset_urn string")
    got = {r["asset_urn"]: r for r in catalog.asset_parts(rows).collect()}
    first = got[urn("t")]
    assert (first["platform"], first["dataset_name"], first["table_name"], first["env"]) == (
        "spark", "shop.t", "t", "PROD")
    assert first["safe_table"] and first["safe_dataset"]
    assert (first["short_label"], first["dotted_label"]) == ("t", "shop.t")
    assert not got[urn("t-x")]["safe_table"]
    assert got["plain.name"]["table_name"] == "name" and got["plain.name"]["platform"] is None
    assert got["a,b.c"]["short_label"] == "a" and got["a,b.c"]["dotted_label"] == "a,b.c"


def test_binding(spark):
    columns = spark.createDataFrame(
        [("t", "x", "int"), ("t", "y", "int")],
        "table_name string, column_name string, data_type string")
    described = spark.createDataFrame(
        [(urn("t", "s1"), "x", ""), (urn("t", "s1"), None, ""), (urn("t", "s2"), "z", ""),
         (urn("t", "s3"), None, ""), (urn("gone"), None, "")], TEXTS)
    got = {r["asset_urn"]: (r["bound"], r["basis"])
           for r in catalog.asset_binding(described, columns).collect()}
    assert got == {
        urn("t", "s1"): (True, "described fields"), urn("t", "s2"): (False, "unknown fields"),
        urn("t", "s3"): (True, "table existence"), urn("gone"): (False, "no such table")}


def test_recorded_edges_come_first_and_stay(spark):
    schema = "downstream string, upstream string, position int"
    existing = spark.createDataFrame([("d", "b", 0), ("d", "a", 1)], schema)
    declared = spark.createDataFrame([("d", "c", 0), ("d", "a", 1), ("e", "a", 0)], schema)
    edges = catalog.merge_upstreams(existing, declared)
    got = {(r["downstream"], r["line_no"]): r["upstream"]
           for r in catalog.upstream_lists(edges).collect()}
    assert got == {("d", 0): "b", ("d", 1): "a", ("d", 2): "c", ("e", 0): "a"}


def test_one_asset_with_most_edges_keeps_their_order(spark):
    edges = spark.range(50_000).select(
        F.when(F.col("id") % 10 > 0, "hot").otherwise(F.col("id").cast("string")).alias("downstream"),
        F.format_string("u%05d", "id").alias("upstream"), F.lit(0).alias("origin"),
        (F.col("id") * 7919 % 50_000).cast("int").alias("position"))
    lists = catalog.upstream_lists(edges)
    hot = lists.where("downstream = 'hot'").orderBy("line_no").collect()
    assert [r["line_no"] for r in hot] == list(range(45_000))
    places = [int(r["upstream"][1:]) * 7919 % 50_000 for r in hot]
    assert places == sorted(places)
    assert lists.where("downstream <> 'hot'").agg(F.count("*"), F.max("line_no")).first() == (5000, 0)


def test_lineage_gate(spark):
    declarations = spark.createDataFrame(
        [(urn("t"), "x", "up"), (urn("t"), "x", "shop.up"), (urn("t"), "x", "other.up"),
         (urn("t"), "x", "t"), ("urn:li:dataset:(urn:li:dataPlatform:p,t,DEV)", "x", "up"),
         ("not a urn", "x", "up")],
        "asset_urn string, field_path string, reference_table string")
    lineage = spark.createDataFrame(
        [(urn("up"), urn("t")), (urn("t"), urn("t")),
         ("urn:li:dataset:(urn:li:dataPlatform:p,up,DEV)",
          "urn:li:dataset:(urn:li:dataPlatform:p,t,DEV)")], "upstream string, downstream string")
    got = {(r["asset_urn"], r["reference_table"]): r["ok"]
           for r in catalog.lineage_gate(declarations, lineage).collect()}
    assert list(got.values()).count(True) == 3
    assert got[(urn("t"), "up")] and got[(urn("t"), "shop.up")]
    assert not got[(urn("t"), "other.up")] and not got[(urn("t"), "t")]


def test_catalog_columns(spark):
    tables = {"t": spark.createDataFrame(
        [], "a int, b bigint, c string, d double, e date, f timestamp, g array<int>")}
    texts = spark.createDataFrame([(urn("t"), "b", "text")], TEXTS)
    got = catalog.catalog_columns(
        texts, catalog.schema_rows(spark, tables), texts).orderBy("ordinal").collect()
    assert [(r["column_name"], r["type"], r["description"]) for r in got] == [
        ("a", "int", None), ("b", "bigint", "text"), ("c", "varchar", None),
        ("d", "double", None), ("e", "date", None), ("f", "timestamp", None),
        ("g", "array<int>", None)]
