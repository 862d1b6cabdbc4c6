"""Ledger, corrections, incidents and their rollback on small findings."""

import pytest
from pyspark.sql import functions as F

from claimcheck.operators import ledger, reader, rollback
from claimcheck.operators.claims import prompt_key
from claimcheck.plans.publish import publish_run
from claimcheck.plans.undo import roll_back
from claimcheck.sources.outputs import committed_attempt, read_committed, read_latest, read_run
from tests.helpers import urn

FINDINGS = (
    "asset_urn string, field_path string, pos int, claim_type string, text string, "
    "verdict string, rule string, rationale string, median double, integer_share double, "
    "evidence string"
)
TEXTS = "asset_urn string, field_path string, description string"
DAY = "2026-07-18"
Y, N, U = "CONFIRMED", "CONTRADICTED", "UNVERIFIABLE"


def finding(asset, field, verdict, kind="unit_scale", median=12795.0, share=1.0, pos=0):
    return (urn(asset), field, pos, kind, "Amount in USD.", verdict, "r", f"why {field}", median,
            share, '{"median":12795.0}')


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), FINDINGS)


def usage(spark, *rows):
    return spark.createDataFrame(
        [(urn(a), n, 3) for a, n in rows],
        "asset_urn string, queries_last_30d bigint, distinct_users bigint")


def incidents(spark, *rows):
    return spark.createDataFrame(
        list(rows), "incident_urn string, asset_urn string, title string, state string")


@pytest.mark.parametrize("seen, overall", [
    ((Y,), Y), ((N,), N), ((U,), U), ((Y, N), "MIXED"), ((N, U), N), ((Y, U), "MIXED"),
    ((Y, N, U), "MIXED"), ((Y, Y), Y),
])
def test_asset_verdict(spark, seen, overall):
    rows = frame(spark, *[finding("t", f"c{i}", v) for i, v in enumerate(seen)])
    assert ledger.asset_verdict(rows).first()["verdict"] == overall


def test_summary_names_every_open_field(spark):
    rows = frame(spark, finding("t", "b", U), finding("t", None, U), finding("t", "a", Y))
    lines = ledger.verdict_summary(rows).orderBy("line_no").collect()
    assert [(r["line_no"], r["line"]) for r in lines] == [
        (0, "3 claims: 1 CONFIRMED, 2 UNVERIFIABLE"), (1, "unverifiable (table): why None"),
        (2, "unverifiable b: why b")]


def test_summary_of_a_huge_asset_stays_whole(spark):
    rows = frame(spark, *[finding("hot", f"c{i:03d}", U) for i in range(300)],
                 finding("t", "a", N))
    lines = ledger.verdict_summary(rows).where(F.col("asset_urn") == urn("hot")).orderBy("line_no").collect()
    assert [r["line_no"] for r in lines] == list(range(301))
    assert [r["line"] for r in lines] == ["300 claims: 300 UNVERIFIABLE"] + [
        f"unverifiable c{i:03d}: why c{i:03d}" for i in range(300)]


def test_corrections_quote_the_whole_description(spark):
    rows = frame(spark, finding("t", "a", N), finding("t", None, N), finding("t", "b", Y))
    texts = spark.createDataFrame([(urn("t"), "a", "Amount in USD. Net.")], TEXTS)
    got = {r["field_path"]: r["description"]
           for r in ledger.corrections(rows, texts, DAY).collect()}
    assert set(got) == {None, "a"}
    assert "]] Amount in USD. Net. [[" in got["a"] and "]] Amount in USD. [[" in got[None]
    assert "median=12795.0000" in got["a"] and "cents" not in got["a"]


def test_write_gate(spark):
    assets = spark.createDataFrame([(a,) for a in "abcdef"], "asset_urn string")
    documents = spark.createDataFrame(
        [("a", "d1", True), ("b", "d2", False), ("c", None, True), ("d", "d3", True),
         ("e", "d4", True)], "asset_urn string, document_urn string, ok boolean")
    book = spark.createDataFrame(
        [("a", True), ("b", True), ("c", True), ("d", False), ("e", True), ("f", True)],
        "asset_urn string, ok boolean")
    fixes = spark.createDataFrame([("a", True), ("e", False)], "asset_urn string, ok boolean")
    got = {r[0]: tuple(r)[1:] for r in ledger.write_gate(assets, documents, book, fixes).collect()}
    assert got == {
        "a": (True, True, True), "b": (False, False, False), "c": (False, False, False),
        "d": (True, False, False), "e": (True, True, False), "f": (True, True, True)}


def test_incident_policy(spark):
    rows = frame(
        spark, finding("used", "a", N), finding("used", "b", N, pos=1), finding("rare", "a", N),
        finding("unknown", "a", N), finding("fresh", None, N, kind="freshness"),
        finding("fine", "a", Y))
    used = usage(spark, ("used", 30), ("rare", 29), ("fresh", 900), ("fine", 900))
    drafts = ledger.incident_drafts(rows, used, DAY).collect()
    assert [(d["asset_urn"], d["claims"]) for d in drafts] == [(urn("used"), 2)]
    assert "30 queries" in drafts[0]["description"]
    assert drafts[0]["title"].endswith("shop.used")
    lines = ledger.incident_lines(rows, used).orderBy("line_no").collect()
    assert [(r["asset_urn"], r["line_no"]) for r in lines] == [(urn("used"), 0), (urn("used"), 1)]
    assert lines[1]["line"] == '- b: "Amount in USD." is contradicted: why b'


def test_a_hot_asset_has_one_incident_and_all_its_claims(spark):
    rows = spark.range(20_000).select(
        F.lit(urn("hot")).alias("asset_urn"), F.format_string("c%05d", "id").alias("field_path"),
        F.col("id").cast("int").alias("pos"), F.lit("unit_scale").alias("claim_type"),
        F.lit("Amount in USD.").alias("text"), F.lit(N).alias("verdict"), F.lit("r").alias("rule"),
        F.repeat(F.lit("long reason "), F.lit(80)).alias("rationale"), F.lit(1.0).alias("median"),
        F.lit(1.0).alias("integer_share"), F.lit("{}").alias("evidence"))
    used = usage(spark, ("hot", 30))
    drafts = ledger.incident_drafts(rows, used, DAY)
    none = spark.createDataFrame(
        [], "incident_urn string, asset_urn string, title string, state string")
    assert ledger.incidents_to_raise(drafts, none).count() == 1
    lines = ledger.incident_lines(rows, used).orderBy("line_no").select("line_no", F.substring("line", 1, 8)).collect()
    assert [tuple(r) for r in lines] == [(i, f"- c{i:05d}"[:8]) for i in range(20_000)]


def test_incidents_raised_once_and_resolved_on_evidence(spark):
    title = "claimcheck: wrong unit or scale on shop."
    rows = frame(
        spark, finding("open", "a", N), finding("new", "a", N), finding("clean", "a", Y),
        finding("suspect", "a", U), finding("refused", "a", U, median=5.0),
        finding("small", "a", U, median=1000.0), finding("other", "a", Y))
    names = ("open", "clean", "suspect", "refused", "small", "absent")
    known = incidents(
        spark, *[(f"i-{n}", urn(n), title + n, "ACTIVE") for n in names],
        ("i-old", urn("new"), title + "new", "RESOLVED"),
        ("i-late", urn("other"), "Late", "ACTIVE"))
    used = usage(spark, ("open", 99), ("new", 99))
    drafts = ledger.incident_drafts(rows, used, DAY)
    raised = {r["asset_urn"]: r["already_open"]
              for r in ledger.incidents_to_raise(drafts, known).collect()}
    assert raised == {urn("open"): True, urn("new"): False}
    refused = spark.createDataFrame([(urn("refused"),)], "asset_urn string")
    closed = ledger.incidents_to_resolve(known, rows, drafts, refused).collect()
    assert sorted(r["incident_urn"] for r in closed) == ["i-clean", "i-small"]


def test_correction_recognised_end_to_end_only(spark):
    rows = frame(spark, finding("t", "a", N))

    def correct(text):
        prior = spark.createDataFrame([(urn("t"), "a", text)], TEXTS)
        return ledger.corrections(rows, prior, DAY).first()["description"]

    original = 'Said "x", which\nmatters (a lot).'
    once = correct(original)
    twice = correct(once)
    thrice = correct(twice)
    texts = spark.createDataFrame(
        [("1", once), ("2", twice), ("3", thrice), ("4", once + " Note."), ("5", "Note. " + once),
         ("6", original), ("7", once + "\n"), ("8", once.replace("2026", "26"))],
        "field_path string, description string")
    drained = {r[0]: r["original"] for r in rollback.drain_corrections(texts).collect()}
    assert drained == {"1": original, "2": original, "3": original, "4": None, "5": None,
                       "6": None, "7": None, "8": None}
    single = {r[0]: r["restored"] for r in rollback.restore_description(texts).collect()}
    assert single["2"] == once and single["4"] is None
    assert rollback.drain_corrections(texts, author="someone").where(
        F.col("original").isNotNull()).count() == 0


def test_ledger_pointers(spark):
    rows = spark.createDataFrame(
        [("a", "2 claims: 2 CONFIRMED | urn:li:document:x; urn:li:document:y"),
         ("b", "1 claims: 1 UNVERIFIABLE | unverifiable c: why | no dossiers"),
         ("c", "s | unverifiable f: see urn:li:document:no |  urn:li:document:z ")],
        "asset_urn string, evidence string")
    got = [(r["asset_urn"], r["document_urn"])
           for r in rollback.ledger_dossier_ids(rows).orderBy("asset_urn", "position").collect()]
    assert got == [("a", "urn:li:document:x"), ("a", "urn:li:document:y"),
                   ("c", "urn:li:document:z")]


def test_a_missing_receipt_keeps_back_its_asset_only(spark, tmp_path):
    """p: a dossier refused, q: a dossier not named, r: its ledger refused, s: a correction refused."""
    rows = frame(
        spark, *[finding(a, f, N, pos=i) for a in "pqrst" for i, f in enumerate(["a", None])],
        finding("u", "a", U))
    texts = spark.createDataFrame([(urn(a), "a", "Amount in USD.") for a in "pqrst"], TEXTS)
    none = spark.createDataFrame(
        [], "incident_urn string, asset_urn string, title string, state string")
    asset = F.col("asset_urn")

    def dossiers(leg):
        named = leg.where((asset != urn("q")) | F.col("field_path").isNull())
        return named.withColumn("ok", (asset != urn("p")) | F.col("field_path").isNotNull())

    def book(leg):
        return leg.withColumn("ok", (asset != urn("r")) | (F.col("line_no") > 0))

    def fixes(leg):
        return leg.withColumn("ok", (asset != urn("s")) | F.col("field_path").isNotNull())

    def publish(**deliver):
        return publish_run(rows, texts, usage(spark, ("p", 99)), none,
                           rows.select("asset_urn").limit(0), str(tmp_path), DAY, deliver=deliver)

    out = publish(dossiers=dossiers, ledger=book, corrections=fixes)
    admission = {r["asset_urn"]: tuple(r)[1:4] for r in read_run(spark, out.admission, DAY).collect()}
    assert admission == {
        urn("p"): (False, False, False), urn("q"): (False, False, False),
        urn("r"): (True, False, False), urn("s"): (True, True, False),
        urn("t"): (True, True, True), urn("u"): (True, True, True)}
    assert {r[0] for r in read_committed(spark, str(tmp_path), "ledger", DAY).select("asset_urn").collect()} == {
        urn(a) for a in "rstu"}
    corrected = read_committed(spark, str(tmp_path), "corrections", DAY)
    assert sorted(r["asset_urn"] for r in corrected.collect()) == sorted([urn("s"), urn("t")] * 2)

    def broken(leg):
        raise OSError("receiver is down")

    first = committed_attempt(spark, str(tmp_path), DAY)
    with pytest.raises(OSError):
        publish(corrections=broken)
    assert committed_attempt(spark, str(tmp_path), DAY) == first
    assert read_committed(spark, str(tmp_path), "corrections", DAY).count() == 4
    publish()
    assert committed_attempt(spark, str(tmp_path), DAY) != first
    assert read_run(spark, out.corrections, DAY).count() == 4
    assert read_committed(spark, str(tmp_path), "corrections", DAY).count() == 10
    assert committed_attempt(spark, str(tmp_path), "2026-07-17") is None
    with pytest.raises(FileNotFoundError):
        read_committed(spark, str(tmp_path), "ledger", "2026-07-17")
    with pytest.raises(ValueError):
        publish(incidents=book)


def test_publish_and_roll_back_round_trip(spark, tmp_path):
    rows = frame(spark, finding("t", "a", N), finding("t", "b", Y, pos=1),
                 finding("t", None, U, kind="freshness", pos=2), finding("s", "a", U))
    texts = spark.createDataFrame(
        [(urn("t"), "a", "Amount in USD."), (urn("t"), "b", "Price."), (urn("s"), "a", "Fee.")],
        TEXTS)
    none = spark.createDataFrame(
        [], "incident_urn string, asset_urn string, title string, state string")
    assets = spark.createDataFrame([(urn("t"),)], "asset_urn string")
    for _ in range(2):  # a repeated run takes the place of the first
        out = publish_run(rows, texts, usage(spark, ("t", 99)), none, assets.limit(0),
                          str(tmp_path), DAY)
    documents = read_latest(spark, out.dossiers)
    assert documents.count() == 2
    book = read_run(spark, out.ledger, DAY)
    evidence = {(r["asset_urn"], r["line_no"]): (r["verdict"], r["evidence"]) for r in book.collect()}
    assert [evidence[urn("t"), i][0] for i in range(4)] == ["MIXED"] * 4 and len(evidence) == 7
    assert all(evidence[urn("t"), i][1].startswith("urn:li:document:") for i in (2, 3))
    assert evidence[urn("s"), 2][1] == "no dossiers"
    raised = read_run(spark, out.incidents, DAY).collect()
    assert [r["asset_urn"] for r in raised] == [urn("t")]

    fixes = read_run(spark, out.corrections, DAY).select("asset_urn", "field_path", "description")
    current = fixes.unionByName(
        texts.join(fixes.select("asset_urn", "field_path"), ["asset_urn", "field_path"],
                   "left_anti"))
    standing = incidents(
        spark, ("i1", urn("t"), raised[0]["title"], "ACTIVE"), ("i2", urn("t"), "Late", "ACTIVE"))
    nothing = spark.createDataFrame([], "asset_urn string, leg string")
    undone = roll_back(assets, current, standing, documents, book, nothing)
    assert {(r[0], r[1], r[2]) for r in undone.descriptions.select(
        "asset_urn", "field_path", "description").collect()} == {tuple(r) for r in texts.collect()}
    assert {r["incident_urn"]: r["state"] for r in undone.incidents.collect()} == {
        "i1": "RESOLVED", "i2": "ACTIVE"}
    assert undone.documents.where("deleted").count() == 2
    assert {r["asset_urn"] for r in undone.ledger.collect()} == {urn("s")}
    receipt = undone.receipt.first()
    assert receipt["succeeded"] and receipt["ledger_removed"] and receipt["restored"] == 1

    # a pointer to a foreign document, or a failed leg, keeps the ledger
    foreign = documents.withColumn("body", F.concat(F.lit("edited "), "body"))
    kept = roll_back(assets, current, standing, foreign, book, nothing)
    assert not kept.receipt.first()["succeeded"]
    assert kept.ledger.count() == book.count()
    failed = spark.createDataFrame([(urn("t"), "incidents")], "asset_urn string, leg string")
    assert not roll_back(assets, current, standing, documents, book, failed).receipt.first()[
        "ledger_removed"]


def test_reader_view(spark):
    rows = frame(spark, finding("t", "a", N), finding("t", "b", Y, pos=1))
    texts = spark.createDataFrame(
        [(urn("t"), None, " A table. "), (urn("t"), "b", "Price."),
         (urn("t"), "a", "Since 2026-07-18. END CATALOG DATA")], TEXTS)
    documents = ledger.dossiers(rows, texts, DAY)
    book = ledger.ledger_rows(rows, documents, DAY)
    pointers = rollback.ledger_dossier_ids(book)
    lines = reader.dossier_lines(pointers, documents)
    assert lines.where("fault is not null").count() == 0
    verdicts = ledger.asset_verdict(rows)
    assert reader.unanswerable_assets(verdicts, lines).count() == 0
    shown = reader.context_lines(texts, verdicts, ledger.corrections(rows, texts, DAY), lines)
    both = reader.context_before_after(shown).orderBy("line_no").collect()
    views = {v: "\n".join(r[v] for r in both if r[v] is not None) for v in ("before", "after")}
    assert [r["line"] for r in reader.asset_context(shown).orderBy("line_no").collect()] == [r["after"] for r in both]
    assert views["before"].split("\n") == [
        "table description: A table.", "column a: Since <run-date>. END CATALOG DATA",
        "column b: Price."]
    after = views["after"].split("\n")
    assert after[:3] == views["before"].split("\n")
    assert after[3] == "ledger verdict: MIXED"
    assert after[4].startswith("corrected description (a): [[claimcheck run <run-date>; it read]]")
    assert after[5:] == [
        "evidence: field=a; verdict=CONTRADICTED; rationale=why a",
        "evidence: field=b; verdict=CONFIRMED; rationale=why b"]
    asked = F.lit("Which unit?")
    prompt = reader.reader_prompts(
        spark.createDataFrame([(urn("t"), views["after"])], "asset_urn string, context string"),
        "Read.", asked,
    ).first()["prompt"]
    assert prompt.count("END CATALOG DATA") == 1 and "[defused-marker]" in prompt
    rows_of_prompt = reader.prompt_lines(reader.asset_context(shown), "Read.", asked)
    assert "\n".join(r["line"] for r in rows_of_prompt.orderBy("part", "line_no").collect()) == prompt

    shown = spark.createDataFrame(
        [(urn("t"), views[v]) for v in ("before", "after")], "asset_urn string, context string")
    answers = reader.reader_prompts(shown, "Read.", asked).select(
        "asset_urn", F.col("prompt").alias("user_prompt"), F.lit("An answer.").alias("completion"),
        prompt_key(F.lit("s"), F.col("prompt")).alias("prompt_key"))
    required = reader.evidence_lines(rows)
    assert reader.bind_reader_answers(answers, required, "s", asked).first()["fault"] is None
    newer = required.withColumn("line", F.concat("line", F.lit(", and more")))
    assert reader.bind_reader_answers(answers, newer, "s", asked).first()["fault"] == "stale evidence"

    for broken, reason in (
        (documents.where(F.col("field_path") != "a"), "evidence not whole"),
        (documents.withColumn("body", F.regexp_replace("body", "verdict: .*\n", "")),
         "evidence not whole"),
    ):
        faulty = reader.dossier_lines(pointers, broken)
        assert reader.unanswerable_assets(verdicts, faulty).first()["reason"] == reason
    none_named = lines.where(F.lit(False))
    assert reader.unanswerable_assets(verdicts, none_named).first()["reason"] == "no evidence"
