"""Periodic runs against an enumeration of all periods and a direct search of all extensions."""

import re
from fractions import Fraction
from hashlib import sha256
from zlib import crc32

import numpy as np

from claimcheck.llm import periodic_runs
from claimcheck.llm.common import ship_library

SCHEMA = "doc_id long, text string, runs string, n long, words string, collapsed string, h long, `a b` string"


def brute(words):
    """Runs by start and period: of each period the maximal stretches, those of a smaller period left out."""
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted((s, length, q) for (s, length), q in found.items())


def planted(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = crc32(str(doc_id).encode()) if doc_id is not None else 1
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def expected(doc_id, text):
    words = planted(doc_id, text)
    runs = brute(words)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha256(lines.encode()).hexdigest(), sha256(kept.encode()).hexdigest())


def test_extensions_equal_a_direct_comparison():
    rng = np.random.default_rng(1)
    for words in (rng.integers(0, 2, 900), np.zeros(400, int), np.tile(rng.integers(0, 3, 37), 20), np.arange(300), np.array([5])):
        extend = periodic_runs.CommonExtensions(words)
        a, b = (x.ravel() for x in np.meshgrid(*[rng.permutation(len(words))[:60]] * 2))
        a, b = a[a != b], b[a != b]
        direct = []
        for x, y in zip(a, b, strict=True):
            k = 0
            while max(x, y) + k < len(words) and words[x + k] == words[y + k]:
                k += 1
            direct.append(k)
        assert extend(a, b).tolist() == direct


def test_cover_meets_every_difference():
    for v in (4, 9, 32, 64):
        cover, _ = periodic_runs.difference_cover(v)
        assert {(b - a) % v for a in cover for b in cover} == set(range(v))


def test_runs_of_random_and_periodic_texts():
    rng = np.random.default_rng(2)
    texts = [rng.integers(0, 1 + i % 3, rng.integers(0, 60)) for i in range(300)]
    for _ in range(60):
        parts = [np.tile(rng.integers(0, 3, rng.integers(1, 9)), rng.integers(1, 9)) for _ in range(rng.integers(1, 8))]
        texts.append(np.concatenate(parts))
    for text, runs in zip(texts, periodic_runs.find_runs(texts), strict=True):
        assert [tuple(r) for r in runs.tolist()] == brute(text.tolist())


def test_long_texts():
    alike, (runs,) = np.zeros(30_000, int), periodic_runs.find_runs([np.zeros(30_000, int)])
    assert runs.tolist() == [[0, len(alike), 1]]
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1000, 200_000)
    base[50_000:130_000] = np.tile(rng.integers(0, 1000, 20_000), 4)
    (runs,) = periodic_runs.find_runs([base])
    assert (50_000 >= runs[:, 0]).any() and (runs[:, 2] == 20_000).sum() == 1


def test_query_equals_brute_force(spark):
    ship_library(spark)
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(rng.choice(["a", "b", "ca", "É", " x"], rng.integers(0, 90)))) for i in range(400)]
    rows += [(7, None), (None, "x " * 50), (None, None), (8, ""), (9, " \t\n"), (9, "one two one two one two one two"), (9, "one two one two one two one two"), (10, "ab " * 5), (11, "a\x0bb\x0ca b a b a\nb a b")]
    rows += [(5000 + i, " ".join(f"w{j}" for j in rng.integers(0, 40, 700))) for i in range(30)]
    docs = spark.createDataFrame([(*r, "x", 1, "y", "z", 2, "c") for r in rows], SCHEMA)
    found = periodic_runs.digest(periodic_runs.periodic_runs(periodic_runs.planted(docs)))
    key = lambda r: tuple((v is None, v) for v in r)
    want = sorted((expected(*r) for r in rows), key=key)
    assert sorted(map(tuple, found.collect()), key=key) == want and sum(w[1] for w in want) > 20
    assert periodic_runs.periodic_runs(docs.where("doc_id = -1")).count() == 0
