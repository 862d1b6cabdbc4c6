"""Positions against a plain sort, with groups of one row and one of most rows."""

from collections import defaultdict

from claimcheck.functions.numbering import numbered


def test_positions_equal_a_sort(spark):
    rows = [("hot" if i % 3 else f"g{i % 11}" if i % 2 else None, (i * 37) % 501, f"t{i}") for i in range(4000)]
    found = numbered(spark.createDataFrame(rows, "g string, o int, t string").repartition(16), ["g"], ["o", "t"])
    assert found.columns == ["g", "o", "t", "line_no"]
    lists = defaultdict(list)
    for row in found.collect():
        lists[row["g"]].append((row["line_no"], row["o"], row["t"]))
    for group, lines in lists.items():
        expected = sorted((o, t) for g, o, t in rows if g == group)
        assert sorted(lines) == [(i, o, t) for i, (o, t) in enumerate(expected)]
    assert set(lists) == {g for g, _, _ in rows}


def test_one_list_and_no_rows(spark):
    frame = spark.createDataFrame([(x,) for x in (3, 1, None, 2)], "x int")
    assert sorted((r["line_no"], r["x"]) for r in numbered(frame, [], ["x"]).collect()) == [(0, None), (1, 1), (2, 2), (3, 3)]
    assert numbered(frame.where("x > 9"), ["x"], ["x"]).count() == 0
