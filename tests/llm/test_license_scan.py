"""License scans against the operator's SQL and against places counted word by word."""

import re

import duckdb
import pandas as pd
import pytest

from claimcheck.llm import license_scan, oracles

SCHEMA = "doc_id long, text string, hash string, place string, template int, labels string, `a b` string"
MIT = dict(license_scan.TEMPLATES[1:2])["mit"]
WORDS = MIT.split()
TEXTS = [
    (1, "Released under the MIT License."), (2, "released, under the MIT-license; Apache License"), (3, "cc by cc by cc by"), (4, None), (5, ""), (6, " ... "),
    (7, f"some words before {MIT} and after"), (8, " ".join([*WORDS[:30], "very", "much", *WORDS[30:]])), (9, " ".join([*WORDS[:30], *WORDS[32:]])),
    (10, " ".join(WORDS[:40])), (11, " ".join(f"{w} x" for w in WORDS)), (12, "LICENSED UNDER THE APACHE LICENSE VERSION 2 0 " * 3000), (None, "Licensed under CC BY-NC 4.0."),
    (None, None), (13, f"{MIT}\n{MIT}"), (13, f"{MIT}\n{MIT}"), (14, "mit license mit license x gnu general public license"), (15, "éMIT License É mit license mit\x00license"),
    (16, "the mit " * 500), (17, "permit license"), (18, "word " * 200_000 + "gnu general public license"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(d, t, "h", "p", 1, "l", "z") for d, t in TEXTS], SCHEMA)


def key(row):
    return tuple((v is None, v) for v in row)


def places(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower)
    phrases = {tuple(p.split()): label for p, label in license_scan.PHRASES.items()}
    return len(words), [(i, label) for i in range(len(words)) for p, label in phrases.items() if tuple(words[i : i + len(p)]) == p]


def test_base_columns_equal_a_count_word_by_word(docs):
    rows = license_scan.scan(docs).collect()
    expected = []
    for doc_id, text in TEXTS:
        n, found = places(text)
        at = [i for i, _ in found]
        expected.append((doc_id, n, len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found}))))
    columns = ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
    assert sorted((tuple(r[c] for c in columns) for r in rows), key=key) == sorted(expected, key=key)
    assert all(set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1 for r in rows)


def test_spans_survive_inserted_and_missing_words(docs):
    found = {r["doc_id"]: (r["labels"], r["score"], r["n_spans"]) for r in license_scan.scan(docs).collect()}
    assert found[1][0] == found[7][0] == found[8][0] == found[9][0] == "mit"
    assert found[7][1:] == (1.0, 1) and found[13][2] == 2 and found[12] == ("apache,apache-2.0", 1.0, 3000)
    assert 0.9 < found[9][1] < 1 and found[10] == ("", 40 / len(re.findall(r"\w+", MIT)), 0)
    assert found[11] == found[6] == found[5] == found[4] == found[17] == ("", 0.0, 0)
    spans = license_scan.spans(docs).where("doc_id = 7 and template = 1").collect()
    assert [(r["first_word"], r["last_word"], r["share"]) for r in spans] == [(3, 2 + len(re.findall(r"\w+", MIT)), 1.0)]


def test_rows_equal_the_sql(docs):
    con = duckdb.connect()
    con.register("documents", pd.DataFrame({"doc_id": pd.array([d for d, _ in TEXTS], dtype="Int64"), "text": pd.array([t for _, t in TEXTS], dtype="string")}))
    want = con.execute(oracles.LICENSES)
    names = [d[0] for d in want.description]
    rows = sorted((tuple(r[n] for n in names) for r in license_scan.scan(docs).collect()), key=key)
    assert rows == sorted(want.fetchall(), key=key)


def test_no_rows_and_no_python_in_the_plan(docs):
    assert license_scan.scan(docs.where("doc_id = -1")).count() == 0
    plan = license_scan.scan(docs)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "CartesianProduct", "NestedLoop"))
