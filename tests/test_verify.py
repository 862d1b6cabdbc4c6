"""Verdicts on small tables at the edges of every band."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimcheck.operators import probes
from tests.helpers import claim, judge, urn, verdicts

Y, N, U = "CONFIRMED", "CONTRADICTED", "UNVERIFIABLE"


def table(spark, expr, rows=1000, name="v"):
    return spark.range(rows).select(F.expr(expr).alias(name))


def test_money_bands(spark):
    tables = {
        "dollars": table(spark, "10 + id % 90 + 0.25D"),
        "cents": table(spark, "cast(1200 + id as bigint)"),
        "small": table(spark, "cast(id % 7 as bigint)"),
        "large": table(spark, "5000 + id + 0.5D"),
        "nulls": table(spark, "cast(null as double)"),
        "empty": table(spark, "id * 1.0D", rows=0),
    }
    rows = [claim(t, "v", "unit_scale", unit="usd") for t in tables]
    found = judge(spark, tables, *rows)
    assert [r["verdict"] for r in found] == [Y, U, U, U, U, U]
    assert [r["rule"] for r in found] == [
        "major units", "cents without reference", "neither signature", "neither signature",
        "no values", "no values",
    ]


def test_units_without_a_rule(spark):
    tables = {"t": table(spark, "id + 0.5D")}
    assert verdicts(
        spark, tables, claim("t", "v", "unit_scale", unit="furlongs"),
        claim("t", "v", "unit_scale"), claim("t", None, "unit_scale", unit="USD"),
    ) == [U, U, U]


def billing(spark, suspects, references):
    return {
        "charges": spark.createDataFrame(suspects, "id int, amount bigint"),
        "billing": spark.createDataFrame(references, "id int, total double"),
    }


DECLARED = [(urn("charges"), "amount", "billing", "id", "id", "total")]
LINEAGE = [(urn("billing"), urn("charges"))]
CENTS = claim("charges", "amount", "unit_scale", unit="USD")
SUSPECTS = [(i, 150_000 + 100 * i) for i in range(150)]
REFERENCES = [(i, 1500.0 + i) for i in range(150)]


@pytest.mark.parametrize(
    "suspects, references, expected",
    [
        (SUSPECTS, REFERENCES, N),
        (SUSPECTS[:99], REFERENCES[:99], U),
        ([(1, 150_100)] * 100 + SUSPECTS[101:], REFERENCES, U),
        (SUSPECTS, REFERENCES[:120], U),
        (SUSPECTS, REFERENCES + REFERENCES[:1], U),
        (SUSPECTS, [(i, None if i == 7 else t) for i, t in REFERENCES], U),
        (SUSPECTS, [(i, 0.0 if i == 7 else t) for i, t in REFERENCES], U),
        (SUSPECTS, [(i, t * 1.005) for i, t in REFERENCES], U),
        (SUSPECTS, [], U),
    ],
    ids=["clean", "99 keys", "one key", "partial", "fan-out", "null", "zero", "half percent",
         "no rows"],
)
def test_reconciliation_shapes(spark, suspects, references, expected):
    tables = billing(spark, suspects, references)
    assert verdicts(spark, tables, CENTS, declared=DECLARED, lineage=LINEAGE) == [expected]


def test_reference_must_be_a_recorded_upstream(spark):
    tables = billing(spark, SUSPECTS, REFERENCES)
    assert verdicts(spark, tables, CENTS, declared=DECLARED, lineage=[]) == [U]
    itself = [(urn("charges"), "amount", "charges", "id", "id", "amount")]
    loop = [(urn("charges"), urn("charges"))]
    assert verdicts(spark, tables, CENTS, declared=itself, lineage=loop) == [U]


def test_percent_bands(spark):
    tables = {
        "scale": table(spark, "1.0D + id % 99"),
        "fraction": table(spark, "0.001D + (id % 50) / 1000.0D"),
        "over": table(spark, "id % 300 * 1.0D"),
        "negative": table(spark, "id % 99 - 5.0D"),
    }
    rows = [claim(t, "v", "unit_scale", unit="percent_0_100") for t in tables]
    assert verdicts(spark, tables, *rows) == [Y, U, U, U]


def test_never_null_bands(spark):
    tables = {
        "whole": table(spark, "id"),
        "few": table(spark, "id", rows=99),
        "trace": table(spark, "nullif(id, 500)"),
        "holes": table(spark, "case when id % 20 > 0 then id end"),
        "empty": table(spark, "id", rows=0),
    }
    rows = [claim(t, "v", "completeness", nullable=False) for t in tables]
    assert verdicts(spark, tables, *rows) == [Y, U, U, N, U]
    assert verdicts(spark, tables, claim("whole", "v", "completeness", nullable=True)) == [U]


def test_enum_bands(spark):
    tables = {
        "abc": table(spark, "substr('abc', 1 + cast(id % 3 as int), 1)"),
        "many": table(spark, "cast(id as string)"),
        "nulls": table(spark, "cast(null as string)"),
        "numbers": table(spark, "cast(id % 3 as int)"),
    }
    assert verdicts(
        spark, tables,
        claim("abc", "v", "domain_enum", values=["a", "b", "c", "d"]),
        claim("abc", "v", "domain_enum", values=["a", "b"]),
        claim("abc", "v", "domain_enum", values=[]),
        claim("many", "v", "domain_enum", values=[str(i) for i in range(1000)]),
        claim("nulls", "v", "domain_enum", values=["a"]),
        claim("numbers", "v", "domain_enum", values=["0", "1", "2"]),
    ) == [Y, N, U, Y, U, Y]


def test_every_distinct_value_counts(spark):
    tables = {"t": table(spark, "format_string('%05d', id % 10000)", rows=30_000)}
    all_of_them = [f"{i:05d}" for i in range(10_000)]
    whole, lacking = (claim("t", "v", "domain_enum", values=v) for v in (all_of_them, all_of_them[:-1]))
    found = judge(spark, tables, whole, lacking)
    assert [r["verdict"] for r in found] == [Y, N]
    assert [(r["distinct_count"], r["unexpected_count"], r["first_unexpected"]) for r in found] == [
        (10_000, 0, None), (10_000, 1, "09999")]


def test_unexpected_values_are_rows(spark):
    values = probes.distinct_values(table(spark, "cast(id % 4 as string)", rows=40), ["v"]).withColumn(
        "table_name", F.lit("t"))
    claims = spark.sql("""select 't' as table_name, 'v' as field_path,
        named_struct('values', array('0', null, '2', '2')) as predicate""")
    got = probes.unexpected_values(claims, values).select("value", "n").collect()
    assert sorted(map(tuple, got)) == [("1", 10), ("3", 10)]


def test_enumerated_numbers_compare_as_numbers(spark):
    tables = {
        "double": table(spark, "cast(1 + id % 2 as double)"),
        "fraction": table(spark, "0.5D + id % 2"),
        "decimal": table(spark, "cast(1 + id % 2 as decimal(10,2))"),
        "integer": table(spark, "cast(1 + id % 2 as int)"),
        "text": table(spark, "concat(1 + id % 2, '.0')"),
    }
    assert verdicts(
        spark, tables,
        claim("double", "v", "domain_enum", values=["1", "2"]),
        claim("fraction", "v", "domain_enum", values=["0.5", "1.5"]),
        claim("decimal", "v", "domain_enum", values=["1", "2"]),
        claim("integer", "v", "domain_enum", values=["1", "2"]),
        claim("text", "v", "domain_enum", values=["1", "2"]),
    ) == [Y, Y, Y, Y, N]


@pytest.mark.parametrize("expression, values", [
    ("array(1e7D, 2e7D)[cast(id % 2 as int)]", ["10000000", "20000000"]),
    ("array(1e7D, 2e7D)[cast(id % 2 as int)]", ["1e7", "2.0E7"]),
    ("array(1e-4D, 0.5D)[cast(id % 2 as int)]", ["0.0001", "0.50"]),
    ("array(-0.0D, 0.0D)[cast(id % 2 as int)]", ["0"]),
    ("array(0.1F, 1e8F)[cast(id % 2 as int)]", ["0.1", "100000000"]),
    ("cast(10000000 * (1 + id % 2) as bigint)", ["1e7", "20000000.0"]),
    ("cast(0.00000000000000000012 as decimal(38,20))", ["0.00000000000000000012"]),
    ("cast(-1.50 as decimal(10,2))", ["-1.5"]),
])
def test_spelling_of_a_number_does_not_matter(spark, expression, values):
    tables = {"t": table(spark, expression)}
    found = judge(spark, tables, claim("t", "v", "domain_enum", values=values),
                  claim("t", "v", "domain_enum", values=["3", *values[1:], "1.50"]))
    assert [r["verdict"] for r in found] == [Y, N]
    assert "E" not in found[1]["first_unexpected"]


def test_median_of_any_doubles(spark):
    rng = np.random.default_rng(7)
    sets = [
        rng.normal(size=801), np.exp(rng.normal(size=900) * 90), -np.exp(rng.normal(size=901) * 50),
        [5e-324, -5e-324, 0.0, 1e308, -1e308], [0.0] * 90 + [-0.0] * 9 + [1.0], [1.0, 2.0], [7.0],
        [np.inf, -np.inf, 1.0, 2.0, 3.5], 1 + rng.integers(0, 90, 700) * 2.0**-52,
        np.nextafter(np.arange(1.0, 900.0), 0), [np.nan, 3.0, 1.0],
    ]
    names = [f"c{i}" for i in range(len(sets))]
    rows = [[float(x[i]) if i < len(x) else None for x in sets] for i in range(max(map(len, sets)))]
    frame = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names))
    medians = probes.exact_medians(frame, [*names[:6], *names[6:]])
    got = {r["field_path"]: r["median"] for r in medians.collect()}
    for name, values in zip(names, sets, strict=True):
        ordered = np.sort(np.asarray(values, dtype=float))
        low, high = ordered[(len(ordered) - 1) // 2], ordered[len(ordered) // 2]
        assert got[name] == (low if low == high else 0.5 * low + 0.5 * high), name
    plan = medians._jdf.queryExecution().executedPlan().toString()
    assert "percentile" not in plan
    empty = probes.unit_profile(frame.where("c0 > 1e300"), ["c0"]).first()
    assert empty["median"] is None and empty["row_count"] == 0


def test_an_unreadable_table_spoils_its_own_claims_only(spark, tmp_path):
    for name in ("good", "bad"):
        table(spark, "1.5D + id").coalesce(1).write.parquet(str(tmp_path / name))
    (broken,) = (tmp_path / "bad").glob("*.parquet")
    whole = broken.read_bytes()
    for checksum in (tmp_path / "bad").glob(".*.crc"):
        checksum.unlink()
    broken.write_bytes(whole[:4] + b"x" * (len(whole) - 8) + whole[-4:])
    tables = {n: spark.read.schema("v double").parquet(str(tmp_path / n)) for n in ("good", "bad")}
    rows = [claim(t, "v", kind, **p) for t in tables for kind, p in (
        ("unit_scale", {"unit": "USD"}), ("completeness", {"nullable": False}), ("domain_enum", {"values": ["1.5"]}))]
    folder = str(tmp_path / "measures")
    found = judge(spark, tables, *rows, folder=folder)
    assert [r["rule"] for r in found[3:]] == ["probe error"] * 3
    assert all("the measurement failed" in r["rationale"] for r in found[3:])
    assert all(r["rule"] != "probe error" for r in found[:3])
    # a repeated run takes what was committed and measures again what had failed
    first = {p: p.stat().st_mtime_ns for p in (tmp_path / "measures/profile/good").iterdir()}
    broken.write_bytes(whole)
    again = judge(spark, {**tables, "bad": spark.read.schema("v double").parquet(str(tmp_path / "bad"))}, *rows, folder=folder)
    assert [r["rule"] for r in again[3:]] == [r["rule"] for r in found[:3]]
    assert {p: p.stat().st_mtime_ns for p in (tmp_path / "measures/profile/good").iterdir()} == first


def test_wide_numbers_nan_and_infinity_end_no_run(spark):
    tables = {
        "wide": table(spark, "1e36D + id"),
        "nan": table(spark, "double('NaN')"),
        "infinite": table(spark, "double('Infinity')"),
    }
    rows = [claim(t, "v", "unit_scale", unit=u) for t in tables for u in ("USD", "percent")]
    rows += [claim(t, "v", "domain_enum", min=0.0, max=5.0) for t in tables]
    found = judge(spark, tables, *rows)
    assert len(found) == 9 and all(r["verdict"] in (Y, N, U) and r["rationale"] for r in found)


def test_date_columns_of_odd_names_are_not_looked_at(spark):
    odd = spark.range(3).select(
        F.lit(dt.date(2026, 7, 1)).alias("d"), F.lit(dt.date(2026, 7, 2)).alias("o'd"),
        F.lit(dt.date(2026, 7, 3)).alias("order-date"))
    assert probes.temporal_columns(odd) == ["d"]


def test_bounds_bands(spark):
    tables = {"t": table(spark, "id - 10"), "s": table(spark, "cast(id as string)")}
    low = claim("t", "v", "domain_enum", min=0.0)
    both = claim("t", "v", "domain_enum", min=0.0, max=500.0)
    fine = claim("t", "v", "domain_enum", min=-10.0, max=989.0)
    text = claim("s", "v", "domain_enum", min=0.0)
    found = judge(spark, tables, low, both, fine, text)
    assert [r["verdict"] for r in found] == [N, N, Y, U]
    assert found[1]["rationale"].count("; ") == 1
    assert found[3]["rule"] == "probe error"


def dated(spark, *rows):
    return spark.createDataFrame(
        [tuple(None if d is None else dt.date.fromisoformat(d) for d in r) for r in rows],
        ", ".join(f"d{i} date" for i in range(len(rows[0]))),
    )


@pytest.mark.parametrize(
    "cadence, rows, expected, rule",
    [
        ("daily", [("2026-07-17",)], Y, "fresh"),
        ("daily", [("2026-07-15",)], U, "between the bands"),
        ("daily", [("2026-07-11",)], N, "stale"),
        ("Daily", [("2026-07-18",)], Y, "fresh"),
        ("daily", [("2026-07-20",)], U, "between the bands"),
        ("weekly", [("2026-07-11",)], Y, "fresh"),
        ("weekly", [("2026-06-27",)], N, "stale"),
        ("hourly", [("2026-07-18",)], U, "finer than a day"),
        ("hourly", [("2026-07-16",)], N, "stale"),
        ("monthly", [("2026-07-18",)], U, "no rubric"),
        ("daily", [("2026-05-01", "2026-07-18")], U, "several date columns"),
        ("daily", [("2026-05-01", "2026-05-02")], N, "stale"),
        ("daily", [(None,)], U, "probe error"),
    ],
)
def test_freshness_bands(spark, cadence, rows, expected, rule):
    found = judge(
        spark, {"t": dated(spark, *rows)}, claim("t", None, "freshness", cadence=cadence),
        as_of="2026-07-18",
    )[0]
    assert (found["verdict"], found["rule"]) == (expected, rule)


def test_freshness_needs_an_anchor_and_a_date_column(spark):
    tables = {"t": dated(spark, ("2026-07-18",)), "s": table(spark, "id")}
    row = claim("t", None, "freshness", cadence="daily")
    assert judge(spark, tables, row)[0]["rule"] == "probe error"
    no_dates = claim("s", None, "freshness", cadence="daily")
    assert judge(spark, tables, no_dates, as_of="2026-07-18")[0]["rule"] == "probe error"


def reads(spark, *rows):
    return spark.createDataFrame(
        [(name, dt.datetime.fromisoformat(day), user)
         for name, day, user, n in rows for _ in range(n)],
        "table_name string, queried_at timestamp_ntz, query_user string",
    )


@pytest.mark.parametrize(
    "log, expected, rule, recent",
    [
        ([("other", "2026-07-10", "a", 1)], Y, "silent", 0),
        ([("old", "2026-07-10", "a", 5), ("shop.old", "2026-07-18T23:59:59", "b", 5)], N,
         "still read", 10),
        ([("old", "2026-07-10", "a", 9)], U, "few reads", 9),
        ([("old", "2026-07-19", "a", 20)], U, "dead log", 0),
        ([("old", "2026-06-18T23:59:59", "a", 20)], U, "dead log", 0),
        ([("old", "2026-06-19", "a", 10)], N, "still read", 10),
        ([("elsewhere.old", "2026-07-10", "a", 20)], Y, "silent", 0),
        ([], U, "dead log", 0),
    ],
)
def test_deprecation_bands(spark, log, expected, rule, recent):
    found = judge(
        spark, {}, claim("old", None, "deprecation_usage", deprecated=True),
        as_of="2026-07-18", log=reads(spark, *log),
    )[0]
    assert (found["verdict"], found["rule"], found["recent_queries"]) == (expected, rule, recent)


def test_deprecation_needs_a_log(spark):
    row = claim("old", None, "deprecation_usage", deprecated=True)
    assert judge(spark, {}, row, as_of="2026-07-18")[0]["rule"] == "probe error"


def test_what_cannot_be_measured(spark):
    tables = {"t": table(spark, "cast(id as string)")}
    found = judge(
        spark, tables,
        claim("missing", "v", "completeness", nullable=False),
        claim("t", "missing", "completeness", nullable=False),
        claim("t", "v", "unit_scale", unit="USD"),
        claim("t", "v; drop", "completeness", nullable=False),
        claim("t", "v", "deprecation_usage", deprecated=True),
        as_of="2026-07-18",
    )
    assert {r["verdict"] for r in found} == {U}
    assert {r["rule"] for r in found} == {"probe error"}


def test_extent_counts_rows_with_nulls(spark):
    df = table(spark, "case when id > 0 then 1.5D end")
    assert probes.scan_extent(df).first()["rows_scanned"] == 1000


@pytest.mark.parametrize(
    "values, medians",
    [
        ([1000.0, 1002.0], (True, True, True)),
        ([998.0, 1002.0], (True, True, False)),
        ([999.0, 1001.5], (True, True, True)),
        ([1.0, 1.0, 5.0], (True, False, False)),
        ([-1.0, 1.0], (False, False, False)),
        ([0.0, 0.0, 0.0, 9.0], (False, False, False)),
        ([float("nan"), float("nan"), 1.0], (True, True, True)),
    ],
)
def test_side_of_the_median_from_counts(spark, values, medians):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    row = probes.fused_profile(df, {"unit": ["v"]}).first()
    assert tuple(row[f"median_above_{t}"] for t in (0, 1, 1000)) == medians


@pytest.mark.parametrize("expr", [
    "pow(id, 3) % 977 + 0.25D", "cast(id % 2 as double)", "id / 7.0D", "-exp(id / 100.0D)",
    "case when id % 3 = 0 then 5.0D else hash(id) / 1e6D end",
])
@pytest.mark.parametrize("rows", [1, 2, 3, 1001, 40_000])
def test_exact_median_by_clamping(spark, expr, rows):
    df = spark.range(rows).select(F.expr(expr).alias("v"))
    want = df.agg(F.percentile("v", 0.5)).first()[0]
    assert probes.exact_medians(df, ["v"]).first()["median"] == pytest.approx(want, abs=1e-12)


def test_reconciliation_counts_equal_the_joined_pairs(spark):
    """Many rows per key on both sides, values at, near and off the ratio."""
    suspects = spark.range(3000).select(
        F.expr("nullif(id % 7, 6)").alias("k"),
        F.expr("case when id % 11 > 0 then (id % 40) * 100.0D * (1 + (id % 3) * 1e-8D) end")
        .alias("v"),
    )
    references = spark.range(500).select(
        F.expr("id % 8").alias("k"),
        F.expr("case when id % 9 > 0 then (id % 40) - 3.0D end").alias("r"),
    )
    got = probes.reconcile_100x(suspects, references, "k", "k", "v", "r").first()
    pairs = suspects.where("v is not null").join(references, "k").select(
        "k", F.expr("case when r is null or r = 0 then 0.0D "
                    "when abs(v / r - 100.0D) <= 1e-6D then 1.0D else 0.0D end").alias("hit")
    ).agg(F.count("*"), F.count_distinct("k"), F.avg("hit")).first()
    assert 0 < pairs[2] < 1
    assert (got["recon_joined"], got["recon_matched_keys"]) == (pairs[0], pairs[1])
    assert got["recon_ratio_share"] == pytest.approx(pairs[2], abs=1e-12)
    assert got["recon_suspect_keys"] == 6
    assert got["recon_reference_rows"] == 500


def test_reconciliation_counts_beyond_a_bigint(spark):
    """Counts of a key are multiplied, so more joined rows than a BIGINT holds are no trouble."""
    counts = spark.range(1).select(
        F.lit(4_000_000_000).cast("bigint").alias("a"), F.lit(9_000_000_000).cast("bigint").alias("b"))
    product = counts.select(probes._product("a", "b").alias("p")).agg(F.sum("p")).first()[0]
    assert int(product) == 36 * 10**18


def test_references_that_cannot_be_measured_reach_the_finding(spark):
    cents = spark.range(200).select(F.col("id").alias("k"), F.expr("150000 + id * 100").alias("a"),
                                    F.expr("150000 + id * 100").alias("b"), F.expr("150000 + id * 100").alias("c"))
    plain = spark.range(200).select(F.col("id").cast("double").alias("k"), F.expr("1500D + id").alias("total"),
                                    F.lit("x").alias("word"))
    tables = {"cents": cents, "plain": plain}
    declared = [(urn("cents"), "a", "plain", "k", "k", "total"), (urn("cents"), "b", "gone", "k", "k", "total"),
                (urn("cents"), "c", "plain", "k", "k", "word")]
    lineage = [(urn(t), urn("cents")) for t in ("plain", "gone")]
    found = judge(spark, tables, *[claim("cents", c, "unit_scale", unit="USD") for c in "abc"],
                  declared=declared, lineage=lineage)
    assert [r["rule"] for r in found] == ["cents corroborated", "probe error", "probe error"]
    assert "no such table: gone" in found[1]["rationale"]
    assert "not a numeric column: plain.word" in found[2]["rationale"]


@pytest.mark.parametrize("references", [1, 3])
def test_a_pair_of_tables_is_scanned_once_whatever_is_declared(spark, tmp_path, references):
    columns = [f"v{i}" for i in range(references)]
    for name, scale in (("left", 100), ("right", 1)):
        spark.range(300).select(
            F.col("id").alias("k"), *[((F.col("id") + 1) * scale * (i + 1)).alias(c) for i, c in enumerate(columns)]
        ).write.parquet(str(tmp_path / name))
    left, right = (spark.read.parquet(str(tmp_path / n)) for n in ("left", "right"))
    rows = probes.side_rows(left, {f"l{c}": ("k", c) for c in columns}).unionByName(
        probes.side_rows(right, {f"r{c}": ("k", c) for c in columns}))
    uses = spark.createDataFrame(
        [(c, f"{side}{c}", side == "l") for c in columns for side in "lr"], "ref string, side string, is_left boolean")
    measures = probes.ratio_measures(rows, uses)
    assert {(r["ref"], r["recon_ratio_share"], r["recon_matched_keys"]) for r in measures.collect()} == {
        (c, 1.0, 300) for c in columns}
    plan = measures._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("FileScan parquet") == 2
