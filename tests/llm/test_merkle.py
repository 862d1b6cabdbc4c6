"""Manifest and proofs against a tree built in plain Python."""

from hashlib import sha256
from zlib import crc32

import pytest

from claimcheck.llm import merkle
from claimcheck.llm.common import ship_library

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf string, node string, at long, `a b` string"


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def lower(text):
    return text and "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def climbed(level, place):
    """Root of a list of nodes, and siblings (left, right) of one of them, level by level."""
    steps = []
    while len(level) > 1:
        runs = [level[i : i + 16] for i in range(0, len(level), 16)]
        run, j = runs[place // 16], place % 16
        steps.append((run[:j], run[j + 1 :]))
        level, place = [h(*r) for r in runs], place // 16
    return level[0], steps


def expected(rows):
    leaf = lambda d, t, g, s, n: h(field(d), field(s), field(g), field(n), field(t))
    groups = {}
    for d, t, g, s, n in rows:
        hit = d is not None and crc32(str(d).encode()) % 5 == 0
        groups.setdefault(s, []).append((d is not None, d or 0, leaf(d, t, g, s, n), leaf(d, lower(t) if hit else t, g, s, n), d))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = [sorted(groups[s], key=lambda e: e[:4]) for s in order]
    tops = [climbed([e[2] for e in t], 0)[0] for t in trees]
    out = []
    for i, tree in enumerate(trees):
        for j, (_, _, own, start, d) in enumerate(tree):
            root, upper = climbed(tops, i)
            steps, folded = climbed([e[2] for e in tree], j)[1] + upper, start
            for before, after in steps:
                folded = h(*before, folded, *after)
            out.append((d, own, tops[i], root, h(*[x for b, a in steps for x in b + a]), folded, folded == root))
    return out


def check(spark, rows):
    frame = spark.createDataFrame([(*r, "x", "y", 1, "z") for r in rows], SCHEMA)
    found = merkle.prove(frame)
    key = lambda r: tuple((v is None, v) for v in r)
    assert sorted(map(tuple, found.collect()), key=key) == sorted(expected(rows), key=key)


def test_proofs_equal_a_plain_tree(spark):
    ship_library(spark)
    rows = [(i, f"Text {i} É" if i % 7 else None, "en" if i % 3 else None, "hot" if i % 3 else f"s{i % 20}" if i % 2 else None, i) for i in range(700)]
    rows += [(9000 + i, f"T{i}", "en", f"one{i}", 1) for i in range(280)]
    rows += [(5, "Again", "en", "hot", None), (5, "Again", "en", "hot", None), (None, "No id", None, "hot", 3), (None, None, None, None, None), (6, "", "", "", 0), (10, "Long TEXT " * 100_000, "xx", "hot", 1)]
    check(spark, rows)
    verified = [r[-1] for r in expected(rows)]
    assert any(verified) and not all(verified)


@pytest.mark.parametrize("n", [1, 2, 16, 17, 33, 257])
def test_trees_of_one_source(spark, n):
    check(spark, [(i, f"T {i}", "en", "s", i) for i in range(n)])


def test_two_sources_of_one_row_and_an_empty_table(spark):
    check(spark, [(1, "A", "en", "a", 1), (10, "B", "en", "b", 1)])
    assert merkle.prove(spark.createDataFrame([], SCHEMA)).count() == 0
