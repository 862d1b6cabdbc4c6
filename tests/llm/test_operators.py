"""The operators of claimcheck.llm against brute force and exact round trips, with awkward rows."""

from collections import Counter, defaultdict
from hashlib import sha256
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from claimcheck.llm import bitplanes, chaining, encoding, hash_forest, interval_expansion, merge_queue, packing, permutation_index, pitman_yor, robust_outliers, wrapper
from claimcheck.llm.common import CLEANUP, dropped, ship_library, shared_folder, tidy, written

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")
PATH = str(public.path("byte_bpe_50k.json"))
SCHEMA = "doc_id long, text string, lang string, source string, ids string, n_words string, row string"
WORDS = [f"{a}{b}" for a in ("ka", "lo", "mi", "ne", "pu") for b in ("ra", "st", "ti", "von", "x", "zel", "q")]


def prose(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join(rng.choice(WORDS, n)) if n else ""


LONG = prose(0, 3000)
BASE = prose(1, 120).split()
TEXTS = [
    (1, " ".join(BASE)), (2, " ".join(BASE)), (3, " ".join([*BASE[:60], "changed", *BASE[61:]])), (4, None), (5, ""), (6, "  \n\t "), (7, "two words"), (8, "two words"),
    (9, LONG), (10, prose(2, 70) + "\n" + " ".join(BASE[20:90]) + "\n" + prose(3, 40)), (None, prose(4, 60)), (None, None), (12, "x<|endoftext|>y  a\n\n b c é日本 😀 don't 12"), (13, "ab " * 500), (13, "ab " * 500), (14, " lead and trail "),
]


@pytest.fixture(scope="module")
def docs(spark):
    ship_library(spark)
    return spark.createDataFrame([(d, t, "en", "s", "a", "b", "c") for d, t in TEXTS], SCHEMA)


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("doc_id = -1")


def key(row):
    return tuple((v is None, v) for v in row)


TOKENIZER = tokenizers.Tokenizer.from_file(PATH)


def library_tokenizer_ids(text):
    return np.array(TOKENIZER.encode(text or "", add_special_tokens=False).ids, dtype="<u4").tobytes()


def library_ids(text):
    return np.array(tokenizers.Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids, dtype="<u4")


@pytest.mark.parametrize("unit", ["bit", "byte"])
def test_planes_give_the_ids_back(unit):
    for ids in (np.zeros(0, "<u4"), np.zeros(9, "<u4"), np.arange(50257, dtype="<u4"), np.array([2**32 - 1, 0], "<u4")):
        assert (bitplanes.from_planes(bitplanes.to_planes(ids, unit), len(ids), unit) == ids).all()


def test_written_ids_are_read_back_in_order(spark, docs, none):
    folder = shared_folder(spark)
    bitplanes.write_ids(docs, PATH, folder, chunk_ids=128)
    rows = sorted(bitplanes.read_ids(spark, folder).collect(), key=lambda r: r["start"])
    expected = sorted(TEXTS, key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or ""))
    at = 0
    for row, (doc_id, text) in zip(rows, expected, strict=True):
        ids = np.r_[library_ids(text), 0].astype("<u4")
        assert (row["doc_id"], row["start"], row["n_tokens"], row["ids"]) == (doc_id, at, len(ids), ids.tobytes())
        at += len(ids)
    empty = shared_folder(spark)
    bitplanes.write_ids(none, PATH, empty)
    assert bitplanes.read_ids(spark, empty).count() == 0


def test_texts_in_arrow_groups_equal_the_library():
    from claimcheck.llm.encoding import library_encoder

    rng = np.random.default_rng(11)
    letters = [*"abAB1 9.,'!%$\n\t  \u00a0\u3000é日ß½²ⅷ\u0301\x01\x1c ", "<|endoftext|>", "'s", "don't", " the", " \n", "\r\n", "😀"]
    texts = ["".join(rng.choice(letters, rng.integers(0, 25))) for _ in range(5000)] + [None, "", " ", "\n", LONG, LONG * 200]
    assert library_encoder(PATH).encode(texts) == [library_tokenizer_ids(t) for t in texts]


def test_known_words_are_looked_up_and_never_gone_through():
    class Known(dict):
        def __iter__(self):
            raise AssertionError("all known words were gone through")

    encoder = encoding.WordEncoder(lambda words: [library_tokenizer_ids(w) for w in words])
    encoder.known = Known()
    texts = ["some words, some more;\nof them", "words, and marks!! (more) 12", "", " odd  one "]
    for _ in range(2):
        assert encoder.encode(texts) == [library_tokenizer_ids(t) for t in texts]


def test_frequent_words_stay_known_when_the_dictionaries_change_places(monkeypatch):
    monkeypatch.setattr(encoding, "CACHED_WORDS", 200)
    asked = []
    encoder = encoding.WordEncoder(lambda words: asked.extend(words) or [library_tokenizer_ids(w) for w in words])
    for i in range(40):
        texts = [" ".join(["the", "often", "met,", *(f"new{i}x{j}y" for j in range(30))])]
        assert encoder.encode(texts) == [library_tokenizer_ids(t) for t in texts]
        assert len(encoder.known) + len(encoder.older) <= 300
    assert asked.count("the") == asked.count(" often") == asked.count(" met") == 1


def test_merge_queue_equals_the_library(docs, none):
    rows = merge_queue.round_trip(docs, PATH).collect()
    expected = [(d, len(i), sha256(i.tobytes()).hexdigest(), sha256((t or "").encode()).hexdigest()) for d, t in TEXTS for i in [library_ids(t)]]
    assert sorted(map(tuple, rows), key=key) == sorted(expected, key=key)
    decoded = merge_queue.decode_ids(merge_queue.encode_texts(docs, PATH), PATH).collect()
    assert sorted(r["text"] for r in decoded) == sorted(t or "" for _, t in TEXTS)
    assert merge_queue.round_trip(none, PATH).count() == 0


def test_packed_pieces_give_every_id_once(docs, none):
    rows = packing.pack(docs, PATH, max_length=64).collect()
    assert len({r["sequence_id"] for r in rows}) == len(rows)
    assert all(r["length"] & (r["length"] - 1) == 0 and r["length"] <= 64 and r["offset"] == 0 and crc32(r["ids"]) == r["ids_crc32"] for r in rows)
    by_doc = defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
    for doc_id, text in TEXTS:
        if doc_id not in (None, 13):
            assert b"".join(r["ids"] for r in sorted(by_doc[doc_id], key=lambda r: r["start"])) == np.r_[library_ids(text), 0].astype("<u4").tobytes()
    assert packing.pack(none, PATH).count() == 0
    with pytest.raises(ValueError):
        packing.cut_pieces(docs, PATH, max_length=100)


def test_statistics_equal_brute_force(docs, none):
    for row in robust_outliers.statistics(docs, docs["text"].alias("raw")).collect():
        text = row["raw"] or ""
        words, lines = text.encode().split(), [x for x in text.split("\n") if x.encode().split()]
        count = Counter(zip(words, words[1:], words[2:], strict=False))
        covered = {i + k for i in range(len(words) - 2) for k in range(3) if count[tuple(words[i : i + 3])] > 1}
        assert row["n_words"] == len(words) and row["word_chars"] == sum(len(w.decode()) for w in words)
        assert row["n_dup_lines"] == len(lines) - len(set(lines)) and row["n_repeat_words"] == len(covered)
    assert robust_outliers.judged(none).count() == 0


def test_outliers_of_a_group_go(spark):
    rows = [(i, prose(i, 80 + i % 40), "en" if i % 2 else None, "s") for i in range(200)]
    rows += [(1000 + i, prose(i, 80).replace(" ", "$$$ "), "en", "s") for i in range(5)] + [(2000, prose(5, 80).replace(" ", "$$$ "), "xx", "s"), (3000, "few", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = {r["doc_id"]: r["kept"] for r in robust_outliers.judged(docs).collect()}
    assert {d for d, k in kept.items() if not k} == {1000, 1001, 1002, 1003, 1004, 3000}
    assert robust_outliers.keep(docs).columns == docs.columns
    assert {r["doc_id"] for r in robust_outliers.keep(docs).collect()} == {d for d, k in kept.items() if k}


def test_neighbours_against_brute_force(spark):
    ship_library(spark)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(900, 16)).astype("float32")
    x[100:140] = x[100]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000, None), (5050, [0.0] * 16), (5100, [float("nan")] * 16), (5150, [1.0]), (None, x[3].tolist()), (7, x[7].tolist())]
    found = permutation_index.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 50 == 0).collect()
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    hits = 0
    for q in range(0, 900, 50):
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in found if r["query_id"] == q)
        score = unit @ unit[q]
        score[q] = -9
        assert [r for r, _, _ in mine] == [1, 2, 3, 4, 5] and all(abs(score[v] - s) < 1e-12 for _, v, s in mine)
        hits += len({v for _, v, _ in mine} & set(np.lexsort((np.arange(900), -score.round(12)))[:5]))
        if q == 100:
            assert [v for _, v, _ in mine] == [101, 102, 103, 104, 105]
    assert hits >= 0.9 * 18 * 5 and {r["query_id"] for r in found} == set(range(0, 900, 50))
    assert permutation_index.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") % 50 == 0).count() == 0


def test_links_against_brute_force(docs, none):
    rows = {(r["doc_id"], r["class_id"], r["n_links"]) for r in hash_forest.join(docs).collect()}
    alone = {(d, d, 0) for d in (4, 5, 6, 9, 10, 12, 14)}
    assert rows == alone | {(1, 1, 2), (2, 1, 2), (3, 1, 2), (7, 7, 1), (8, 7, 1), (13, 13, 1), (None, None, 0)}
    stay = hash_forest.representatives(docs)
    assert stay.columns == docs.columns and hash_forest.join(none).count() == 0
    ids = [r["doc_id"] for r in stay.collect()]
    assert ids.count(None) == 2 and ids.count(13) == 1 and set(ids) == {None, 1, 4, 5, 6, 7, 9, 10, 12, 13, 14}


def test_a_large_group_of_near_copies_is_counted_exactly(spark, monkeypatch):
    ship_library(spark)
    monkeypatch.setattr(hash_forest, "BLOCK", 16)
    rng = np.random.default_rng(9)
    base = prose(77, 200).split()
    texts = []
    for _ in range(60):
        words = list(base)
        for at in rng.choice(200, 2, replace=False):
            words[at] = f"w{rng.integers(1 << 30)}"
        texts.append(" ".join(words))
    sets = [set(zip(*(t.split()[i:] for i in range(5)), strict=False)) for t in texts]
    links = [sum(5 * len(a & b) >= 4 * len(a | b) for j, b in enumerate(sets) if j != i) for i, a in enumerate(sets)]
    rows = hash_forest.join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert [r["n_links"] for r in sorted(rows)] == links and {r["class_id"] for r in rows if r["n_links"]} == {0}


def test_wrapper_takes_constant_text_and_boilerplate_out(spark):
    ship_library(spark)
    page = "<html><head><title>t</title><style>x</style></head><body><nav><a>m{0}</a></nav><div id=top>Same slogan</div><div id=b><p>Text {0} a<b>b</b>&amp;c<br>d<p>more</div><div class='ad-box'>buy {0}</div><form>f</form><footer>end</footer>"
    rows = [(i, "http://A.org:80/x", page.format(i)) for i in range(6)] + [(10, None, None), (11, "no url", ""), (12, "http://b/", "<article><h1>H</h1><p>only &lt;one&gt;</p><div class=comments>no</div></article><p>out"), (12, "http://b/", "<p>broken <i")]
    out = sorted((r["page_id"], r["text"], r["n_chars"]) for r in wrapper.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    assert out[:6] == [(i, f"Text {i} ab&c d more", 18) for i in range(6)]
    assert out[6:] == [(10, "", 0), (11, "", 0), (12, "H only <one>", 12), (12, "broken <i", 9)]


def extracted(spark, htmls, url="http://a/"):
    rows = [(i, url, h, "x", "y") for i, h in enumerate(htmls)]
    return [r["text"] for r in wrapper.extract(spark.createDataFrame(rows, "page_id long, url string, html string, host string, wrapper string")).orderBy("page_id").collect()]


PAGE = "<div class=a><ul>{links}</ul></div><div class=b>Daily words</div><div class=c><h1>T {0}</h1><div class=d>share me</div>{body}</div><div class=e>from {0} to {0}</div>"


def own_pages(n):
    links = "".join(f"<li><a href=x>link{{0}} {i} of many</a></li>" for i in range(20)).format
    return [PAGE.format(i, links=links(i), body="".join(f"<p>{prose(100 * i + j, 20)}</p>" for j in range(1 + i % 3))) for i in range(n)]


def test_wrapper_decides_without_any_name(monkeypatch):
    """No tag and no name speaks for the content: it is where the varying text is, without what is constant in it."""
    monkeypatch.setattr(wrapper, "MAIN_TAGS", ())
    monkeypatch.setattr(wrapper, "ASIDE_TAGS", frozenset())
    monkeypatch.setattr(wrapper, "ASIDE_NAMES", frozenset())
    merged = None
    for html in own_pages(30):
        page = wrapper.tree(wrapper.parse(html))
        merged = wrapper.merge(merged, page) if merged else page
    merged = wrapper.Node.of(merged.plain()).weigh(30)
    for i, html in enumerate(own_pages(30)):
        root = wrapper.parse(html)
        page = wrapper.tree(root)
        expected = " ".join([f"T {i}", *(prose(100 * i + j, 20) for j in range(1 + i % 3))])
        content, template = wrapper.content_of(page, merged), wrapper.template_of(page, merged)
        assert wrapper.text_of(root, template, content) == expected
        assert "share me" in wrapper.text_of(root, set(), content) and f"from {i}" in wrapper.text_of(root, template)


def test_wrapper_in_a_job_and_with_clashing_columns(spark):
    ship_library(spark)
    expected = [" ".join([f"T {i}", *(prose(100 * i + j, 20) for j in range(1 + i % 3))]) for i in range(12)]
    assert extracted(spark, own_pages(12)) == expected
    empty = spark.createDataFrame([], "page_id long, url string, html string, text string")
    assert wrapper.extract(empty).count() == 0 and wrapper.extract(empty).columns == ["page_id", "url", "text", "n_chars"]


def test_names_made_up_for_every_page_do_not_add_up():
    merged = None
    for i in range(1500):
        slug = "".join(chr(97 + int(d)) for d in str(i))
        page = wrapper.tree(wrapper.parse(f"<div class=top>Same</div><div class={slug}><h1>T</h1><p>{prose(i, 9)}</p></div>"))
        merged = wrapper.merge(merged, page) if merged else page
    assert len(merged.children) <= wrapper.WIDE + 2 and merged.children[0].pages == 1500
    merged.weigh(1500)
    root = wrapper.parse(f"<div class=top>Same</div><div class=zzz><p>{prose(7, 9)}</p></div>")
    page = wrapper.tree(root)
    assert wrapper.text_of(root, wrapper.template_of(page, merged), wrapper.content_of(page, merged)) == prose(7, 9)


def test_long_and_deep_pages_end(spark):
    ship_library(spark)
    deep = "<div>" * 20000 + "<b>" * 20000 + "deep end"
    pages = [deep, "<a " * 350000, "<a \"'" * 100000, "<p>" + prose(3, 150000), "<div>" * 30000 + "</span>" * 30000, "<script>" + "</script " * 30000]
    texts = extracted(spark, pages)
    assert texts[0] == "deep end" and texts[1] == ("<a " * 350000).strip() and texts[3] == prose(3, 150000) and texts[4:] == ["", ""]


def test_repeated_starts_against_brute_force():
    rng = np.random.default_rng(2)
    for trial in range(60):
        length, letters = int(rng.choice([2, 4, 7])), b"ab" if trial % 2 else b"abcd"
        parts = [bytes(rng.choice(list(letters), rng.integers(length, 40)).tolist()) for _ in range(rng.integers(1, 7))]
        count = Counter(p[i : i + length] for p in parts for i in range(len(p) - length + 1))
        expected = [[i for i in range(len(p) - length + 1) if count[p[i : i + length]] > 1] for p in parts]
        assert [list(s) for s in interval_expansion.repeated_starts(parts, length)] == expected


@pytest.mark.parametrize(("unit_bytes", "group_rows"), [(1 << 20, 100_000), (100, 100_000), (100, 1)])
def test_repeated_bytes_go(docs, none, monkeypatch, unit_bytes, group_rows):
    monkeypatch.setattr(interval_expansion, "UNIT_BYTES", unit_bytes)
    monkeypatch.setattr(interval_expansion, "GROUP_ROWS", group_rows)
    data, length = [(t or "").encode() for _, t in TEXTS], 100
    count = Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    expected = []
    for (doc_id, _), b in zip(TEXTS, data, strict=True):
        gone = np.zeros(len(b) + 2, dtype=int)
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i + 1 : i + 1 + length] = 1
        expected.append((doc_id, len(b), int(gone.sum()), int((np.diff(gone) == 1).sum()), bytes(np.frombuffer(b, np.uint8)[gone[1:-1] == 0])))
    rows = [(r["doc_id"], r["n_bytes"], r["n_removed"], len(r["spans"]), bytes(r["kept"])) for r in interval_expansion.without_repeats(docs, length).collect()]
    assert sorted(rows, key=key) == sorted(expected, key=key)
    assert interval_expansion.without_repeats(none).count() == 0


def test_passages_of_earlier_documents_go(docs, none):
    rows = {r["doc_id"]: r for r in chaining.cleaned(docs).where("doc_id is not null").collect()}
    assert rows[1]["n_removed"] == 0 and rows[2]["text"] == "" and rows[3]["n_removed"] >= 119
    assert 68 <= rows[10]["n_removed"] <= 74 and rows[10]["sources"] == [1, 2, 3]
    assert all(rows[d]["n_removed"] == 0 for d in (4, 5, 6, 7, 8, 9, 12, 14)) and rows[4]["text"] is None
    assert chaining.cleaned(none).count() == 0 and chaining.cleaned(docs).count() == len(TEXTS)


def test_chains_and_alignment():
    assert chaining.edit_script(list("abcd"), list("axcd")) == [(0, 0), (2, 2), (3, 3)]
    runs = [(0, 100, 10), (12, 113, 10), (24, 500, 6), (30, 130, 9)]
    assert chaining.chains(runs)[0] == [runs[0], runs[1], runs[3]]


def test_tables_follow_their_distribution():
    keys = np.arange(20000, dtype=np.uint64)
    drawn = pitman_yor.tables(np.full(20000, 2), np.full(20000, 0.5), 0.5, keys, 1)
    assert abs((drawn == 2).mean() - 0.5 * 0.5 / (0.5 * 0.5 + 0.5 * 0.5)) < 0.02
    many = pitman_yor.tables(np.full(2000, 100000), np.full(2000, 1.0), 0.5, keys[:2000], 1)
    assert abs(many.mean() - sum(1 / (i + 1) for i in range(100000))) < 2


def test_stirling_numbers_are_found_once():
    assert pitman_yor.log_stirling(0.75) is pitman_yor.log_stirling(0.75)


def test_distinct_keys_are_those_of_numpy():
    rng = np.random.default_rng(3)
    for keys in (np.zeros(0, np.uint64), rng.integers(0, 50, 1000).astype(np.uint64), rng.integers(0, 1 << 63, 500).astype(np.uint64)):
        assert all((a == b).all() for a, b in zip(pitman_yor.distinct(keys), np.unique(keys, return_index=True, return_inverse=True), strict=True))


def test_numbers_and_hashes_come_back_from_fewer_bytes():
    draw = np.random.default_rng(1)
    for n in (0, 1, 1000):
        keys, numbers = np.sort(draw.integers(0, 2**64 - 1, n, dtype=np.uint64)), draw.integers(0, 2**32 - 1, n)
        assert (pitman_yor.unpack_keys(pitman_yor.pack_keys(keys)) == keys).all() and (pitman_yor.unpack(pitman_yor.pack(numbers)) == numbers).all()
    many = np.sort(draw.integers(0, 2**64 - 1, 100_000, dtype=np.uint64))
    assert len(pitman_yor.pack_keys(many)) < 0.85 * many.nbytes


def test_tables_are_drawn_for_the_pairs_asked_for_only():
    keys = np.arange(1, 101, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    block = type("Block", (), {"pair_context": np.zeros(100, dtype=int), "pair_word": np.arange(100) % 7, "keys": keys})
    pairs, words, totals = [np.arange(100) + 1], [np.full(7, 40)], {"n": 5000, "v": 7}
    asked = np.arange(100) % 3 == 0
    every, some = pitman_yor.seats(block, pairs, words, None, totals, 0), pitman_yor.seats(block, pairs, words, None, totals, 0, asked)
    for a, b in zip(every, some, strict=True):
        assert (a[asked] == b[asked]).all() and (b[~asked] == 1).all() and (a[~asked] > 1).any()


def test_scores_beat_the_base_on_held_out_text(docs, none, spark):
    rows = [(i, prose(i % 7, 60)) for i in range(300)] + [(None, None), (4, "")]
    found = pitman_yor.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    training = [w for d, t in rows if not pitman_yor.held_out(d) for w in [*(t or "").split(), None]]
    count, n = Counter(training), len(training)
    for r in found:
        assert r["train_tokens"] == n and r["held_out"] == pitman_yor.held_out(r["doc_id"])
    held = [r for r in found if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    one = next(r for r in found if r["doc_id"] == 11)
    words = [*rows[11][1].split(), None]
    assert abs(one["base_score"] - sum(np.log10((count[w] + 0.1) / (n + 0.1 * (len(count) + 1))) for w in words)) < 1e-9
    assert pitman_yor.score(docs).count() == len(TEXTS) and pitman_yor.score(none).count() == 0


def shared_by_two(seed, n, changed=()):
    """A passage of words of its own within two documents; the given words differ in the second one."""
    own = [f"own{seed}x{i}" for i in range(n)]
    other = [f"{w}y" if i in changed else w for i, w in enumerate(own)]
    around = [[f"{side}{seed}x{i}" for i in range(60)] for side in "abcd"]
    return own, " ".join(around[0] + own + around[1]), " ".join(around[2] + other + around[3])


def test_a_passage_is_found_though_each_of_its_seeds_is_met_before_elsewhere(spark):
    ship_library(spark)
    own, b, c = shared_by_two(1, 80)
    earlier = [(i, " ".join([f"q{i}x{j}" for j in range(60)] + own[i : i + 6] + [f"r{i}x{j}" for j in range(60)])) for i in range(75)]
    docs = spark.createDataFrame([*earlier, (1000, b), (1001, c)], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in chaining.cleaned(docs).collect()}
    assert rows[1001]["n_removed"] == 80 and rows[1001]["sources"] == [1000]
    assert all(r["n_removed"] == 0 for d, r in rows.items() if d != 1001)


@pytest.mark.parametrize("frequent", [64, 2])
def test_a_passage_is_found_though_its_seeds_are_also_met_in_between(spark, monkeypatch, frequent):
    """Neither the first nor the last document with any of its seeds is the one that holds the passage."""
    monkeypatch.setattr(chaining, "FREQUENT", frequent)
    ship_library(spark)
    own, b, c = shared_by_two(1, 80)
    piece = lambda first, i: (first + i, " ".join([f"q{first}x{i}x{j}" for j in range(60)] + own[i : i + 36] + [f"r{first}x{i}x{j}" for j in range(60)]))
    rows = [*(piece(0, i) for i in range(45)), (1000, b), *(piece(2000, i) for i in range(45)), (3000, c), (3001, c)]
    found = {r["doc_id"]: r for r in chaining.cleaned(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[3000]["n_removed"] == 80 and found[3000]["sources"] == [1000]
    assert found[3001]["text"] == "" and found[3001]["sources"] == [3000]
    assert all(r["n_removed"] == 0 for d, r in found.items() if d < 3000)


def test_passages_of_low_identity_are_found_as_by_brute_force(spark):
    ship_library(spark)
    rows, texts = [], {}
    for case in range(24):
        step = (6, 8, 10)[case % 3]
        _, b, c = shared_by_two(case, 60 + 40 * (case % 2), range(case % step, 100, step))
        rows += [(2 * case, b), (2 * case + 1, c)]
        texts[case] = c.split(), b.split()
    found = {r["doc_id"]: r["n_removed"] for r in chaining.cleaned(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    best = {case: sum(u - x for x, u, _, _ in chaining.passages_of(chaining.edit_script(a, b), 50, 0.8)) for case, (a, b) in texts.items()}
    assert all(best.values()) and all(found[2 * case + 1] >= 0.9 * n for case, n in best.items())
    assert all(found[2 * case] == 0 for case in best)


def test_a_long_run_out_of_reach_does_not_hide_a_near_one():
    far, near, last = (0, 0, 100), (150, 150, 10), (165, 166, 10)
    assert [near, last] in chaining.chains([far, near, last])
    single = [(10 * i, 10 * i, chaining.K) for i in range(5)]
    assert chaining.chains(single) == [single]


def test_what_several_documents_hold_together_is_no_passage(spark):
    ship_library(spark)
    sources = [prose(100 + i, 200).split() for i in range(4)]
    own = [prose(200 + i, 8).split() for i in range(3)]
    for size in (16, 20, 24, 30):
        parts = [s[50 : 50 + size] for s in sources]
        mixed = [w for i, part in enumerate(parts) for w in (*part, *(own[i] if i < 3 else ()))]
        rows = [(i, " ".join(s)) for i, s in enumerate(sources)] + [(9, " ".join(mixed))]
        found = chaining.cleaned(spark.createDataFrame(rows, "doc_id long, text string")).where("doc_id = 9").first()
        assert found["n_removed"] == 0, size


def test_texts_that_share_one_repeated_word_are_not_matched_with_each_other(spark, monkeypatch):
    ship_library(spark)
    seen, candidates = [], chaining.candidates
    monkeypatch.setattr(chaining, "candidates", lambda matches, *a: seen.append(matches.count()) or candidates(matches, *a))
    own = lambda i, *words: (i, " ".join(w for x in (f"a{i}", *words, f"b{i}") for w in [x] * 30))
    rows = [own(i, "the") for i in range(40)] + [own(40 + i, "of") for i in range(20)]
    rows += [own(100, "of", "the"), *(own(110 + i, "of") for i in range(5)), *(own(120 + i, "the") for i in range(5)), own(200, "the", "of"), own(300, "of"), own(301, "the")]
    found = {r["doc_id"]: r for r in chaining.cleaned(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[200]["n_removed"] == 60 and found[200]["sources"] == [100]
    assert all(r["n_removed"] == 0 for d, r in found.items() if d != 200)
    # each of some 1,200 pairs has 28 links and more in common
    assert len(seen) == 2 and seen[1] < 10_000


def test_spans_that_hold_no_passage_are_left_out_and_no_others():
    passage, other = [np.arange(i, i + 200, dtype=np.uint64) for i in (1000, 5000)]
    spans = [passage[:120], passage[:120], np.r_[other[:50], passage[:20], other[50:90]], passage[:49], passage[:50], passage[:2]]
    sources = [passage[:120], other, passage[:100], passage, passage, passage]
    packed = [pa.array([x.tobytes() for x in column], pa.binary()) for column in (spans, sources)]
    run = chaining.run_at_ends(0.8)
    assert run == 4 and chaining.run_at_ends(1.0) == 12
    assert chaining.may_hold_a_passage(*packed, run, 50).tolist() == [True, False, False, False, True, False]


def test_edit_scripts_equal_those_of_the_whole_table():
    def by_table(a, b):
        cost = [[max(i, j) if not i or not j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        for i, x in enumerate(a, 1):
            for j, y in enumerate(b, 1):
                cost[i][j] = min(cost[i - 1][j - 1] + (x != y), cost[i - 1][j] + 1, cost[i][j - 1] + 1)
        pairs, i, j = [], len(a), len(b)
        while i and j:
            if cost[i][j] == cost[i - 1][j - 1] + (a[i - 1] != b[j - 1]):
                i, j = i - 1, j - 1
                pairs += [(i, j)] if a[i] == b[j] else []
            elif cost[i][j] == cost[i - 1][j] + 1:
                i -= 1
            else:
                j -= 1
        return pairs[::-1]

    draw = np.random.default_rng(3)
    for case in range(300):
        a, b = (draw.integers(0, (2, 4, 30)[case % 3], draw.integers(0, 42)).tolist() for _ in "ab")
        assert chaining.edit_script(a, b) == by_table(a, b)


def test_few_runs_are_chained_as_through_trees(monkeypatch):
    draw = np.random.default_rng(4)
    for _ in range(200):
        runs = sorted({(int(a), int(s), int(n)) for a, s, n in zip(draw.integers(0, 90, 15), draw.integers(0, 90, 15), draw.integers(3, 12, 15), strict=True)})
        monkeypatch.setattr(chaining, "FEW_RUNS", 24)
        few = chaining.chains(runs)
        monkeypatch.setattr(chaining, "FEW_RUNS", 1)
        assert few == chaining.chains(runs)


def test_columns_of_the_same_names_stay_under_a_prefix(spark):
    ship_library(spark)
    rows = [(1, " ".join(BASE), "a", "b"), (2, prose(7, 30) + " " + " ".join(BASE), "c", "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words string, spans string")
    found = {r["doc_id"]: r for r in chaining.cleaned(docs, prefix="p_").collect()}
    assert [(found[i]["n_words"], found[i]["spans"]) for i in (1, 2)] == [("a", "b"), ("c", "d")]
    assert found[2]["p_n_words"] == 150 and found[2]["p_n_removed"] >= 120


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName() for i in range(files.size())} - {None}


def test_shuffle_files_go_as_soon_as_a_table_is_written(spark):
    before, setting = shuffle_files(spark), spark.conf.get(CLEANUP, None)
    rows = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    table = written(rows)
    assert not {f for f in shuffle_files(spark) - before if f.startswith("shuffle_")}
    assert spark.conf.get(CLEANUP, None) == setting and table.count() == 7 and rows.count() == 7


def test_dropped_tables_go_before_the_operator_ends(spark):
    seen = []

    @tidy
    def operator():
        first = written(spark.range(5))
        second = written(first)
        dropped(first)
        seen.append([path_exists(spark, first._written_to), path_exists(spark, second._written_to)])
        return second

    assert operator().count() == 5 and seen == [[False, True]]


def path_exists(spark, folder):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def test_scores_leave_only_their_result_behind(spark, docs, monkeypatch):
    from claimcheck.llm import common

    made, folder = [], common.shared_folder
    monkeypatch.setattr(common, "shared_folder", lambda s: made.append(folder(s)) or made[-1])
    found = pitman_yor.score(docs)
    assert [f for f in made if path_exists(spark, f)] == [found._written_to]


def test_passages_keep_no_table_that_is_no_longer_read(spark, docs, monkeypatch):
    from claimcheck.llm import common

    made, left, folder, pieces_of = [], [], common.shared_folder, chaining.pieces_of
    monkeypatch.setattr(common, "shared_folder", lambda s: made.append(folder(s)) or made[-1])

    def watched(*args):
        n = len(made)
        found = pieces_of(*args)
        left.append([f for f in made[n:] if path_exists(spark, f) and f != found._written_to])
        return found

    monkeypatch.setattr(chaining, "pieces_of", watched)
    assert chaining.passages(docs).count() > 0
    # of candidates, asked ids and words only the ids, which are few
    assert left and all(len(x) <= 1 for x in left)


def test_stages_of_the_pipeline(spark, tmp_path):
    """Each stage acts on what the one before kept, and hands on the columns of documents."""
    import corpus_pipeline

    clean = [prose(300 + i, 120) for i in range(60)]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(clean)]
    passage = prose(400, 70)
    rows += [
        (100, "few words", "en", "s", 9), (101, clean[0], "en", "s", len(clean[0])), (102, clean[1] + " more", "en", "s", 0),
        (103, prose(401, 60) + " " + passage, "en", "s", 0), (104, prose(402, 60) + " " + passage + " " + prose(403, 60), "en", "s", 0),
    ]
    (tmp_path / "sf").mkdir()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.coalesce(1).write.parquet(str(tmp_path / "sf" / "documents.parquet"))
    kept, now = [], spark.read.parquet(str(tmp_path / "sf" / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path / "sf"))
        assert now.columns == docs.columns
        kept.append({r["doc_id"]: r["text"] for r in now.collect()})
    assert 100 not in kept[0] and {*range(60), 101, 102, 103, 104} <= kept[0].keys()
    assert kept[1].keys() == kept[0].keys() - {101, 102}
    assert kept[2].keys() == kept[1].keys() and kept[2][103] == kept[1][103]
    assert kept[2][104] == f"{prose(402, 60)} {prose(403, 60)}"
    assert all(kept[2][i] == clean[i] for i in range(60))
    pieces = corpus_pipeline.run(spark, str(tmp_path / "sf")).collect()
    total = {d: len(library_tokenizer_ids(t)) // 4 + 1 for d, t in kept[2].items()}
    found = defaultdict(int)
    for p in pieces:
        found[p["doc_id"]] += p["length"]
    assert dict(found) == total
