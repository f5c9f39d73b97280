"""Joins under skew, merging, windows, matching, reviews and retention."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from clearroll import constants as K
from clearroll.functions import scores
from clearroll.operators import audit, checks, edits, filters, lookup, matching, merge, metrics, report, retention, review, rules, windows
from clearroll.plans import validate
from clearroll.plans.catalogue.registry import Tables


# -- look-ups ------------------------------------------------------------------------


def hot_records(spark, n=3000):
    """A third of the rows share one key, a third have none."""
    return spark.range(n).select(
        F.col("id").cast("string").alias("row"),
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, F.lit(None)).otherwise(F.col("id").cast("string")).alias("k"),
    )


def test_attach_matches_a_plain_join_under_skew(spark):
    left = hot_records(spark)
    right = spark.createDataFrame([("hot", "b"), ("hot", "a"), ("2", "x"), ("5", "y"), (None, "z")], "k string, v string")
    for options in ({"sample": 1.0, "hits": 10}, {"sample": 1.0, "hits": 10**9}, {}, {"hot": []}, {"hot": ["hot", "gone"]}):
        got = lookup.attach(left, right, F.col("k"), F.col("k"), "hit", "row", **options)
        assert got.count() == 3000
        found = {(r.k, r.v): r.n for r in got.groupBy("k", F.col("hit.v").alias("v")).agg(F.count("*").alias("n")).where("v is not null").collect()}
        assert found == {("hot", "a"): 1000, ("2", "x"): 1, ("5", "y"): 1}
        assert got.where("k is null and hit is not null").count() == 0


def test_hot_keys_are_salted(spark):
    left = hot_records(spark)
    assert [r[0] for r in lookup.hot_keys(left, "k", sample=1.0, hits=500).collect()] == ["hot"]
    right = spark.createDataFrame([("hot", "a")], "k string, v string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    found = lookup.hot_values(left, {"k": F.col("k"), "row": F.col("row"), "none": F.lit(None)}, "row", sample=1.0, hits=500)
    assert found == {"k": ["hot"], "row": [], "none": []}
    try:
        for options in ({"sample": 1.0, "hits": 500}, {"hot": found["k"]}):
            got = lookup.attach(left, right, F.col("k"), F.col("k"), "hit", "row", **options)
            spread = got.where("hit is not null").groupBy(F.spark_partition_id().alias("p")).count().collect()
            assert sum(r["count"] for r in spread) == 1000 and len(spread) == 8
            assert max(r["count"] for r in spread) < 400
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_one_per_key(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 3, "z")], "k string, o int, v string")
    assert sorted(map(tuple, lookup.one_per_key(df, ["k"], ["o"]).collect())) == [("a", "y", 1), ("b", "z", 3)] or sorted(
        (r.k, r.v) for r in lookup.one_per_key(df, ["k"], ["o"]).collect()
    ) == [("a", "y"), ("b", "z")]


def test_repeated_reference_rows_do_not_multiply(spark, folder):
    t = Tables(spark, folder)
    twice = t.geocodes.unionByName(t.geocodes)
    assert checks.check_address(t.directory, twice).count() == 150
    once = checks.check_address(t.directory, t.geocodes)
    assert checks.check_address(t.directory, twice).exceptAll(once).count() == 0


# -- merging --------------------------------------------------------------------------

RESULT = "provider_id string, source string, success boolean, confidence double, error_message string, fields array<struct<field:string,value:string,confidence:double>>"


def results(spark, *rows):
    return spark.createDataFrame([(p, s, ok, 0.9, None if ok else "x", f) for p, s, ok, f in rows], RESULT)


def test_merge_goldens(spark):
    df = results(
        spark,
        ("1", "npi_check", True, [("npi_number", "1", 0.95), ("given_name", None, 0.9)]),
        ("1", "google_places", True, [("address_street", "s", 0.85)]),
        ("1", "ocr_processing", True, [("given_name", "Bo", 0.99)]),
        ("1", "state_board_check", False, []),
    )
    got = {r.field_name: r for r in merge.merge_sources(df).collect()}
    assert got["npi_number"].confidence == pytest.approx(0.38)
    assert got["address_street"].confidence == pytest.approx(0.2125)
    # a value that is there but empty still wins by confidence
    assert got["given_name"].value is None and got["given_name"].source == "npi_check"
    best = {r.field_name: r for r in merge.best_field_summary(df).collect()}
    assert best["given_name"].value == "Bo" and best["given_name"].validation_count == 2


def test_merge_is_independent_of_order_and_of_form(spark, folder):
    t = Tables(spark, folder)
    tables = (t.directory, t.registry, t.geocodes, t.licenses, t.enrichment, t.document_fields)
    rows = checks.run_checks(*tables)
    merged = merge.merge_sources(rows)
    shuffled = merge.merge_sources(rows.orderBy(F.rand(5)).repartition(5))
    assert merged.exceptAll(shuffled).count() == 0
    in_row = validate.answer_records(*tables).select("provider_id", F.explode(merge.merged_in_row()).alias("m")).select(
        "provider_id", F.col("m.field").alias("field_name"), "m.value", "m.source",
        scores.stable(F.col("m.weighted")).alias("confidence"), F.col("m.raw").alias("raw_confidence"),
    )
    assert merged.exceptAll(in_row).count() == 0 and in_row.exceptAll(merged).count() == 0
    confidence = merge.merged_confidence(merged)
    assert confidence.where("overall_confidence < 0 or overall_confidence > 1").count() == 0


def test_flags_of_a_failed_check(spark):
    df = results(
        spark,
        ("1", "npi_check", False, []),
        ("1", "ocr_processing", True, [("given_name", "A", 0.4)]),
    )
    flags = merge.gather_answers(df).select(merge.merge_flags()).collect()[0][0]
    assert flags == [
        "FAILED_VALIDATIONS: 1", "LOW_CONFIDENCE_GIVEN_NAME", "MISSING_NPI_NUMBER", "MISSING_FAMILY_NAME",
        "MISSING_LICENSE_NUMBER",
    ]


def test_status_rules(spark):
    rows = [("a", f, "npi", c, s) for f, c, s in (("email", 0.9, "valid"), ("phone_primary", 0.7, "warning"), ("x", 0.7, "warning"))]
    rows += [("b", f"f{i}", "npi", 0.9, "valid") for i in range(9)] + [("b", "g", "other", 0.5, "unknown")]
    rows += [("c", "email", "npi", 0.9, "valid"), ("c", "email", "state_board", 0.1, "invalid")]
    df = spark.createDataFrame(rows, "provider_id string, field_name string, source string, confidence double, status string")
    fields = merge.field_summary(df)
    got = {r.provider_id: r.status for r in merge.record_summary(fields).collect()}
    assert got == {"a": "warning", "b": "valid", "c": "invalid"}
    c = fields.where("provider_id = 'c'").collect()[0]
    assert c.overall_confidence == pytest.approx((0.9 * 0.4 + 0.1 * 0.15) / 0.55)


def test_job_score_golden(spark):
    jobs = spark.createDataFrame([("j", "p", True, True, True), ("k", "p", True, False, False)], "job_id string, provider_id string, validate_npi boolean, validate_address boolean, validate_license boolean")
    outcomes = spark.createDataFrame([("p", True, False, True)], "provider_id string, npi_valid boolean, address_valid boolean, license_valid boolean")
    got = {r.job_id: r for r in merge.score_checks(jobs, outcomes).collect()}
    assert got["j"].overall_score == pytest.approx(66.6667, abs=1e-3) and got["j"].validation_status == "warning"
    assert got["j"].warnings == ["Address validation warning"] and got["j"].errors == []
    assert got["k"].overall_score == 300.0


def test_report_of_an_empty_value(spark):
    df = results(
        spark,
        ("1", "npi_check", True, [("npi_number", None, 0.95), ("given_name", "Ann", 0.9), ("family_name", "ann", 0.9)]),
        ("1", "google_places", True, [("address_street", "PO Box 1, Some Street", 0.3)]),
        ("1", "ocr_processing", False, []),
    )
    row = report.build_report(merge.gather_answers(df), "2024-01-01 00:00:00").collect()[0]
    assert row.flags == ["missing_critical_field", "validation_failed", "npi_not_found", "ocr_failed"]
    assert [i.type for i in row.insights] == [
        "missing_critical_fields", "low_confidence_fields", "failed_validations", "data_inconsistency", "low_coverage",
    ]
    assert row.insights[3].description == "Found 2 data consistency issues"
    assert row.insights[4].description == "Only 44.4% of important fields were validated"
    street = next(f for f in row.field_analyses if f.field_name == "address_street")
    assert [i.issue for i in street.issues] == ["address_street has very low confidence (0.30)"]
    assert row.summary.total_fields == 4 and row.summary.validated_fields == 3
    assert row.metadata.failed_workers == 1


# -- rules -------------------------------------------------------------------------------


def test_rules_are_extensible(spark):
    df = spark.createDataFrame([("1", "abc", ""), ("2", "x", "y")], "provider_id string, code string, email string")
    longer = lambda name, criteria: F.struct(
        F.col(name).alias("value"),
        F.when(F.length(name) >= criteria["least"], "valid").otherwise("invalid").alias("status"),
        F.lit(0.5).alias("confidence"),
    )
    own = [rules.Rule("code", "length", {"least": 2}), rules.Rule("email", "nothing", {})]
    got = {(r.provider_id, r.field_name): (r.status, r.error_message) for r in rules.apply_rules(df, own, {"length": longer}).collect()}
    assert got == {
        ("1", "code"): ("valid", None), ("2", "code"): ("invalid", None), ("2", "email"): ("unknown", "Unknown rule type: nothing"),
    }


def test_alert_rules_table():
    table = rules.alert_rules({"mine": ("a > 1", "warning", 1)}, ["security_events"])
    assert "mine" in table and "security_events" not in table and len(table) == len(K.ALERT_RULES)


# -- windows ---------------------------------------------------------------------------------


def greedy(times, width):
    spans, opened = {}, None
    for t in sorted(times):
        if opened is None or t >= opened + width:
            opened = t
        spans[opened] = spans.get(opened, 0) + 1
    return spans


def test_greedy_spans_match_a_loop(spark):
    rng = random.Random(11)
    rows = [(k, rng.randrange(0, 3000)) for k in "abc" for _ in range({"a": 900, "b": 60, "c": 3}[k])]
    rows += [("d", s) for s in range(-40, 3000)] + [("e", 17 * i) for i in range(50)] + [("f", 18 * i) for i in range(50)]  # never pauses, just pauses
    rows += [(None, s) for s in range(0, 900, 5)]
    ticks = spark.createDataFrame(sorted(set(rows), key=str), "k string, t bigint").withColumn("n", F.lit(1))
    got = {}
    for r in windows.greedy_spans(ticks, ["k"], "t", "n", 17).collect():
        got.setdefault(r.k, {})[r.opened] = r.n
    assert got == {k: greedy({t for kk, t in rows if kk == k}, 17) for k in [*"abcdef", None]}


def test_burst_counts_all_requests(spark):
    log = spark.createDataFrame([("a", f"2024-01-01 00:00:{s:02d}") for s in (0, 0, 3, 9, 10, 11, 25)], "k string, at string").withColumn("at", F.col("at").cast("timestamp"))
    got = [(r.requests, r.over) for r in windows.burst_limits(log, "k", "at", 10, 3).orderBy("opened").collect()]
    assert got == [(4, 1), (2, 0), (1, 0)]


def test_sliding_limit_matches_a_loop(spark):
    rng = random.Random(2)
    times = [rng.randrange(0, 600_000_000) for _ in range(400)] + [5_000_000] * 50
    log = spark.createDataFrame([("npi_registry", t) for t in times], "c string, us bigint").withColumn("at", F.timestamp_micros("us"))
    for r in windows.sliding_limit(log, "c", "at", {"npi_registry": (10.0, 40)}).select(F.unix_micros("at").alias("us"), "requests", "in_window", "over_limit").collect():
        expected = sum(r.us - 60_000_000 < t <= r.us for t in times)
        assert r.in_window == expected and r.over_limit == (expected > 40) and r.requests == times.count(r.us)


def test_cooldown_and_sustained(spark):
    ticks = spark.range(40).select(F.timestamp_seconds(F.col("id") * 60).alias("tick"), F.when(F.col("id").between(5, 25), 60).otherwise(10).alias("manual_review_queue_length"))
    found = windows.rule_breaches(ticks, {"q": ("manual_review_queue_length > 50", "warning", 8)})
    fired = [r.fired_at.minute for r in windows.alert_cooldown(found).orderBy("fired_at").collect()]
    assert fired == [5, 13, 21]
    kept = windows.sustained(found).collect()
    assert [(k.ticks, k.lasted_minutes) for k in kept] == [(21, 20.0)]


def test_every_condition_is_evaluated(spark):
    ticks = spark.createDataFrame([(1, -7), (2, 0)], "tick int, a int")
    conditions = ["a > 1", "abs(a) > 1", "(a + tick) > 1", "NOT a > 5", "CASE WHEN a < 0 THEN true ELSE false END"]
    found = windows.rule_breaches(ticks, {c: (c, "warning", 1) for c in conditions})
    hits = {(r.rule, r.tick) for r in found.where("breached").collect()}
    assert hits == {("abs(a) > 1", 1), ("(a + tick) > 1", 2), ("NOT a > 5", 1), ("NOT a > 5", 2), (conditions[4], 1)}
    with pytest.raises(Exception, match="missing"):
        windows.rule_breaches(ticks, {"q": ("missing > 1", "warning", 1)}).collect()


def test_latest_per_key(spark):
    df = spark.createDataFrame([("a", 1, 1, "x"), ("a", 2, 1, "y"), ("a", 2, 2, None), ("b", 1, 1, "z")], "k string, at int, id int, v string")
    assert {(r.k, r.v) for r in windows.latest_per_key(df, "k", "at", "id").collect()} == {("a", None), ("b", "z")}


def test_counter_restart(spark):
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate((5, 9, 2, 2))], "k string, at int, v int")
    assert [r.increase for r in windows.counter_increase(df, "k", "at", "v").orderBy("at").collect()] == [None, 4, 2, 0]


def test_histogram_quantile(spark):
    df = spark.createDataFrame([(float(v),) for v in (1, 2, 3, 4, 100)], "v double")
    bounds = [2.0, 4.0]
    rows = metrics.histogram(df, "v", bounds).orderBy("le").collect()
    assert [(r.le, r.cumulative) for r in rows] == [(2.0, 2), (4.0, 4), (float("inf"), 5)]
    assert metrics.histogram_quantile(df, "v", bounds, 0.5).collect()[0]["quantile"] == pytest.approx(2.5)
    assert metrics.histogram_quantile(df, "v", bounds, 0.99).collect()[0]["quantile"] == 4.0


def test_exact_quantiles_of_any_group(spark):
    rng = random.Random(4)
    rows = [("a", rng.choice([1.0, 2.5, 7.0])) for _ in range(500)] + [("b", rng.random()) for _ in range(999)]
    rows += [("c", 5.0), ("d", 1.0), ("d", 2.0), ("d", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    qs = [0.0, 0.25, 0.5, 0.95, 0.99, 1.0]
    rows += [(None, float(i % 1000)) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, v double")
    for parts in (1, 7, None):  # a group lies in many ranges, or many groups in one
        got = {r.k: r for r in metrics.exact_quantiles(df, "v", qs, "k", parts=parts).collect()}
        assert set(got) == {"a", "b", "c", "d", None}
        for r in df.groupBy("k").agg(F.percentile("v", qs).alias("p")).collect():
            assert [got[r.k][f"p{int(q * 100)}"] for q in qs] == pytest.approx(r.p)
    whole = metrics.exact_quantiles(df, "v", [0.5]).collect()[0]["p50"]
    assert whole == pytest.approx(df.agg(F.percentile("v", 0.5)).collect()[0][0])


def test_audit_range_prunes_partitions(spark, folder, tmp_path):
    from clearroll.sources.sinks import append_audit

    append_audit(Tables(spark, folder).audit_logs, str(tmp_path / "audit"))
    stored = spark.read.parquet(str(tmp_path / "audit"))
    kept = filters.audit_filter(stored, action="pii.reveal", start="2024-01-05 00:00:00", end="2024-01-06 12:00:00")
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan and "PushedFilters: [IsNotNull(action)" in plan
    assert 0 < kept.count() < stored.count()


def test_record_id_joins_share_an_exchange(spark, folder):
    t = Tables(spark, folder)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = checks.with_documents(checks.with_enrichment(t.directory, t.enrichment), t.document_fields)
        plan = found._jdf.queryExecution().executedPlan().toString()
        # records once, enrichment once, and the two aggregates of the document fields
        assert plan.count("Exchange hashpartitioning") == 4
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_hostile_text_across_lines(spark):
    from clearroll.functions import guard

    rows = [("<b\nonmouse =1",), ("onmouse=1 <",), ("/* a\n b */",), ("/* a b */",), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "v string").select(guard.detect_malicious("v")).collect()]
    assert got == [["xss_attempt"], [], [], ["sql_injection_attempt"], []]


# -- matching ------------------------------------------------------------------------------------


def similarity(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return 1 - row[-1] / max(len(a), len(b))


@pytest.mark.parametrize("threshold", [0.85, 0.7])
def test_near_names_match_brute_force(spark, threshold):
    rng = random.Random(5)
    given = ["anna", "annabella", "ariadne", "al"]
    rows = set()
    for _ in range(140):
        family = "b" + "".join(rng.choice("aei") for _ in range(rng.randrange(2, 9)))
        rows.add((rng.choice(["CA", "NY"]), rng.choice(given), family))
    df = spark.createDataFrame(sorted(rows), "address_state string, given_name string, family_name string")
    expected = {}
    for (s, g, f), (s2, g2, f2) in itertools.permutations(rows, 2):
        if s == s2 and similarity(f"{g} {f}", f"{g2} {f2}") >= threshold - 1e-9:
            expected.setdefault((s, f"{g} {f}"), []).append(f"{g2} {f2}")
    got = {(r.state, r.name): r for r in matching.near_names(df, threshold).collect()}
    assert {k: r.near_names for k, r in got.items()} == {k: len(v) for k, v in expected.items()}
    for (state, name), r in got.items():
        best = max(similarity(name, o) for o in expected[(state, name)])
        assert r.similarity == pytest.approx(best) and r.nearest == min(
            o for o in expected[(state, name)] if abs(similarity(name, o) - best) < 1e-9
        )


def test_one_name_of_many_records_is_compared_once(spark):
    df = spark.range(3000).select(
        F.lit("CA").alias("address_state"), F.lit("Jonathan").alias("given_name"),
        F.when(F.col("id") % 3 == 0, "Smithson").when(F.col("id") == 1, "Smithsen").otherwise(F.concat(F.lit("Q"), "id")).alias("family_name"),
    )
    got = {r.name: r.records for r in matching.near_names(df).where("name like 'jonathan smith%'").collect()}
    assert got == {"jonathan smithson": 1000, "jonathan smithsen": 1}


def test_duplicates_and_bulk_create(spark):
    df = spark.createDataFrame([("1", "a"), ("2", "a"), ("3", "b"), ("4", "c"), ("5", None)], "provider_id string, npi_number string")
    marked = {r.provider_id: (r.copies, r.keep) for r in matching.mark_duplicates(df).collect()}
    assert marked == {"1": (2, "1"), "2": (2, "1"), "3": (1, "3"), "4": (1, "4"), "5": (1, "5")}
    existing = spark.createDataFrame([("b",)], "npi_number string")
    outcomes = edits.reject_existing(df.where("npi_number is not null"), existing)
    assert {r.provider_id: r.outcome.split(":")[0] for r in outcomes.collect()} == {
        "1": "created", "2": "repeated in batch", "3": "already exists", "4": "created",
    }
    assert tuple(edits.bulk_summary(outcomes).collect()[0]) == (2, 2)


def test_crawl_rules(spark):
    pages = spark.createDataFrame([(1, "http://A.org/x/y"), (2, "http://a.org/x/open/z"), (3, "http://a.org/"), (4, "http://b.org/x"), (5, None)], "page_id int, url string")
    table = spark.createDataFrame([("a.org", "/x", False), ("a.org", "/x/open", True)], "host string, path_prefix string, allow boolean")
    got = {r.page_id: (r.allowed, r.rule) for r in matching.crawl_gate(pages, table).collect()}
    assert got == {1: (False, "/x"), 2: (True, "/x/open"), 3: (True, None), 4: (True, None), 5: (True, None)}


# -- reviews, edits, retention ------------------------------------------------------------------------


def test_numbering_is_gap_free_and_balanced(spark):
    queue = spark.range(2000).select(
        F.col("id").cast("string").alias("job_id"),
        F.when(F.col("id") % 3 == 0, "low").otherwise("high").alias("priority"),
        F.timestamp_seconds((F.col("id") % 4) * 86400).alias("created_at"),
    )
    got = review.assign_balanced(queue, ["a", "b", "c"]).collect()
    assert sorted(r.position for r in got) == list(range(2000))
    assert max(r.position for r in got if r.priority == "high") < min(r.position for r in got if r.priority == "low")
    counts = [sum(r.assigned_to == n for r in got) for n in "abc"]
    assert max(counts) - min(counts) <= 1


def test_flag_and_confidence_edits(spark):
    at = F.lit("2024-01-01").cast("timestamp")
    df = spark.createDataFrame([(1, None, None)], "id int, flags array<struct<code:string,reason:string,timestamp:timestamp>>, field_confidence map<string,struct<score:double,updated_at:timestamp>>")
    twice = edits.add_flag(edits.add_flag(df, "A", None, at), "A", None, at)
    assert [f.code for f in edits.add_flag(twice, "B", "r", at).collect()[0].flags] == ["A", "B"]
    changed = edits.set_field_confidence(edits.set_field_confidence(df, "email", 0.1, at), "email", 0.7, at)
    assert {k: v.score for k, v in changed.collect()[0].field_confidence.items()} == {"email": 0.7}


def test_reveal_limit_and_masks(spark):
    log = spark.range(30).select(
        F.col("id").alias("access_id"), F.timestamp_seconds(F.col("id")).alias("accessed_at"), F.lit("u").alias("user_id"),
        F.lit("admin").alias("user_role"), F.lit("ssn").alias("field_name"), F.lit("other").alias("reason"),
    )
    done = audit.audit_reveals(log, {"admin": ["pii:reveal:ssn"]})
    assert {r.access_id for r in done.where("success").collect()} == {0, 1, 2, 3, 4}
    df = spark.createDataFrame([("Ann", "a@b.co")], "given_name string, email string")
    assert tuple(audit.mask_record(df, ["pii:reveal:email"]).collect()[0]) == ("A***", "a@b.co")
    assert tuple(audit.mask_record(df, privileged=True).collect()[0]) == ("Ann", "a@b.co")
    assert audit.pii_fields_of_level("critical") == ["ssn", "medical_record_number"]


def test_retention_keeps_every_row(spark, folder):
    df = Tables(spark, folder).directory.select("provider_id", "given_name", "created_at")
    for action, whole in (("archive", 150), ("anonymize", 150)):
        kept, old = retention.apply_retention(df, "2024-01-31 00:00:00", 2000, action)
        assert kept.count() + old.count() == whole
    with pytest.raises(ValueError):
        retention.apply_retention(df, "2024-01-31 00:00:00", 1, "shred")


def test_paging_covers_all_rows_once(spark, folder):
    df = Tables(spark, folder).directory
    seen = [r.provider_id for n in range(1, 9) for r in filters.page(df, n, 20, "created_at", "provider_id").collect()]
    assert len(seen) == 150 == len(set(seen))
    last = filters.page(df, 2, 20, "created_at", "provider_id").collect()[-1]
    after = filters.page_after(df, "created_at", "provider_id", last.created_at, last.provider_id, 20).collect()
    assert [r.provider_id for r in after] == seen[40:60]


def test_search_takes_wildcards_literally(spark):
    df = spark.createDataFrame([("a%b",), ("axb",), ("A%B",)], "given_name string")
    assert filters.search(df, "a%b", ["given_name"]).count() == 2
    assert filters.search(df, "", ["given_name"]).count() == 3


def addresses(spark, n, streets, blocks):
    """Addresses and candidates by formula: numbers are rare words, streets frequent ones; some rows repeat, some parts are missing."""
    number, street = F.concat((F.col("id") % 97).cast("string"), F.lit(" ")), F.concat(F.lit("Way "), (F.col("id") * 7 % streets).cast("string"))
    block = (F.col("id") % blocks).cast("string")
    asked = spark.range(n).select(
        F.col("id").alias("provider_id"), F.when(F.col("id") % 50 != 3, F.concat(number, street, F.when(F.col("id") % 3 == 0, " North").otherwise(""))).alias("address"),
        F.when(F.col("id") % 41 != 0, block).alias("block"),
    )
    kind = F.when(F.col("id") % 3 == 0, "street_address").when(F.col("id") % 3 == 1, "route").otherwise("locality")
    found = spark.range(n).select(
        block.alias("block"), F.when(F.col("id") % 31 != 5, F.concat((F.col("id") * 5 % 89).cast("string"), F.lit(" "), street)).alias("formatted_address"),
        F.when(F.col("id") % 23 != 0, F.concat(F.lit("pl"), F.col("id").cast("string"))).alias("place_id"), F.array(kind).alias("types"),
    )
    return asked, found.unionByName(found.where("place_id like '%7'"))


@pytest.mark.parametrize("n,streets,blocks", [(400, 5, 2), (300, 40, 3), (500, 2, 1)])
def test_best_addresses_are_those_of_all_pairs(spark, n, streets, blocks):
    asked, found = addresses(spark, n, streets, blocks)
    got = {r.provider_id: r for r in matching.best_address_match(asked, found, "block").collect()}
    score = scores.stable(scores.address_match_confidence(F.col("types"), "formatted_address", "address"))
    pairs = asked.where("address IS NOT NULL").join(found.distinct(), "block").withColumn("c", score)
    every = pairs.groupBy("provider_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("c")).alias("c"), "formatted_address", "place_id"))).alias("l"))
    want = {r.provider_id: [(-x.c, x.formatted_address, x.place_id) for x in r.l[:6]] for r in every.collect()}
    assert got.keys() == want.keys() and want
    for k, rows in want.items():
        g = got[k]
        assert (g.confidence, g.formatted_address, g.place_id) == rows[0]
        rest = rows[1:] if rows[0][0] < 0.8 else []
        assert [(s.confidence, s.formatted_address, s.place_id) for s in g.suggestions] == rest
        assert [s["rank"] for s in g.suggestions] == list(range(2, 2 + len(rest)))


def test_a_full_block_of_addresses_is_no_product(spark):
    """60,000 addresses and as many candidates of one block: 3.6 billion pairs."""
    import time

    number = F.concat(F.col("id").cast("string"), F.lit(" Main St"))
    asked = spark.range(60_000).select(F.col("id").alias("provider_id"), number.alias("address"), F.lit("1").alias("block"))
    found = spark.range(60_000).select(
        F.lit("1").alias("block"), number.alias("formatted_address"), F.col("id").cast("string").alias("place_id"), F.array(F.lit("route")).alias("types")
    )
    begin = time.time()
    best = matching.best_address_match(asked, found, "block").where(F.col("place_id") == F.col("provider_id").cast("string"))
    assert best.count() == 60_000 and time.time() - begin < 90
