"""Results do not depend on file layout, chunking or repeated keys."""

import pytest
from pyspark.sql import functions as F

from clearroll import streaming as S
from clearroll.operators import checks, edits, merge, review
from clearroll.plans import validate
from clearroll.plans.catalogue import QUERIES
from clearroll.plans.catalogue.registry import Tables
from clearroll.sources import files


@pytest.fixture(scope="module")
def many_files(spark, tmp_path_factory):
    """The events table as a folder of part files."""
    base = tmp_path_factory.mktemp("parts")
    for name in ("events", "lineitem", "orders"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").repartition(3).write.parquet(f"{base}/{name}.parquet")
    return str(base)


@pytest.mark.parametrize("name", [n for n in QUERIES if n.startswith("stream_") and n != "stream_alerts"])
def test_streams_read_folders_of_files(spark, folder, many_files, name):
    one, many = (sorted(map(tuple, QUERIES[name].run(spark, f).collect()), key=str) for f in (folder, many_files))
    assert one == many and one


def test_retryable_requests_of_one_key_stored_backwards(spark, tmp_path):
    n = 25_000
    rows = spark.range(n).select(
        F.lit("k").alias("request_key"), F.timestamp_seconds(F.lit(n) - F.col("id")).alias("at"), F.lit("completed").alias("status")
    )
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    got = S.drain(S.retryable_requests(stream, "request_key", "at"), folder=str(tmp_path / "out")).collect()
    assert [r["at"].timestamp() for r in got] == [1.0]


def test_one_record_in_one_record_out(spark, folder):
    t = Tables(spark, folder)
    twice = lambda df: df.unionByName(df)
    repeated = (t.directory, twice(t.registry), twice(t.geocodes), twice(t.licenses), twice(t.enrichment), t.document_fields)
    plain = (t.directory, t.registry, t.geocodes, t.licenses, t.enrichment, t.document_fields)
    rows = validate.validate_records(*repeated).select("provider_id", "overall_confidence", "validation_status")
    want = validate.validate_records(*plain).select("provider_id", "overall_confidence", "validation_status")
    assert rows.count() == t.directory.count() and rows.exceptAll(want).count() == 0
    assert checks.check_license(t.directory, twice(t.licenses)).count() == t.directory.count()


def test_checks_in_long_form_read_the_records_once(spark, folder):
    t = Tables(spark, folder)
    records = spark.createDataFrame(t.directory.collect(), t.directory.schema)
    rows = checks.run_checks(records, t.registry, t.geocodes, t.licenses, t.enrichment, t.document_fields)
    with_document = t.directory.where("trim(document_path) <> ''").count()
    assert rows.count() == 4 * t.directory.count() + with_document


def test_newest_answer_counts(spark):
    schema = "provider_id string, source string, success boolean, confidence double, error_message string, fields array<struct<field:string,value:string,confidence:double>>, at int"
    rows = [("p", "npi_check", True, 0.9, None, [], 1), ("p", "npi_check", False, 0.0, "gone", [], 2)]
    got = merge.gather_answers(spark.createDataFrame(rows, schema), "at").first().answers
    assert [a.success for a in got] == [False]


def test_updates_with_repeated_keys_and_nulls(spark):
    df = spark.createDataFrame([(1, "a", "x", "t0"), (2, "b", "y", "t0")], "id int, u string, v string, updated_at string")
    updates = spark.createDataFrame([(1, "n", None, ["v"]), (1, "z", None, None)], "id int, u string, v string, cleared array<string>")
    got = edits.patch(df, updates, "id", F.lit("t1"), nulls="cleared").orderBy("id").collect()
    assert [tuple(r) for r in got] == [(1, "n", None, "t1"), (2, "b", "y", "t0")]
    jobs = spark.createDataFrame([("j", "failed", None, None, 0)], "job_id string, status string, started_at string, completed_at string, retry_count int")
    asked = spark.createDataFrame([("j", "retry"), ("j", "cancel")], "job_id string, request string")
    assert edits.job_transitions(jobs, asked).count() == 1


def test_queue_is_assigned_by_age_inside_a_priority(spark):
    rows = [(f"j{i}", p, s) for i, (p, s) in enumerate([("low", 5), ("high", 86_399), ("high", 61), ("high", 1), ("high", 1), ("urgent", 90_000)])]
    queue = spark.createDataFrame(rows, "job_id string, priority string, s int").withColumn("created_at", F.timestamp_seconds("s"))
    got = review.assign_balanced(queue, ["R1", "R2"]).orderBy("position").collect()
    assert [r.position for r in got] == list(range(6)) and [r.assigned_to for r in got] == ["R1", "R2"] * 3
    assert [r.job_id for r in got][0] == "j5" and [r.s for r in got] == [90_000, 1, 1, 61, 86_399, 5]


def test_csv_files_lose_nothing(spark, tmp_path):
    (tmp_path / "a.csv").write_text('given,family,email\nAnn,"Lee\nRoe",a@b.co\nBob,Fox,b@b.co,surplus,more\n')
    (tmp_path / "b c.csv").write_text('email,family,given\nc@b.co,Ash,"Cy ""C"""\n')
    mapping = {"given_name": "given", "family_name": "family", "email": "email"}
    rows = files.read_directory_csv(spark, str(tmp_path), mapping).rows.collect()
    got = {r.email: (r.given_name, r.family_name, list(r.errors)) for r in rows}
    assert got["c@b.co"][:2] == ('Cy "C"', "Ash") and got["a@b.co"][0] == "Ann" and "Roe" in got["a@b.co"][1]
    assert len(rows) == 3 and files.MALFORMED in got["b@b.co"][2] and files.MALFORMED not in got["a@b.co"][2]


def test_repeated_headers_are_seen(spark, tmp_path):
    (tmp_path / "a.csv").write_text("given_name,family_name,Email,email\nAnn,Lee,x@b.co,y@b.co\n")
    told = files.check_files(spark, str(tmp_path))
    assert told["duplicate_headers"] == ["email"] and not told["valid"] and told["row_count"] == 1
    assert files.read_batch_csv(spark, str(tmp_path)).first().given_name == "Ann"


@pytest.mark.parametrize("name", ["page_elements", "license_pages"])
def test_pages_of_one_row_group_are_spread(spark, tmp_path, name):
    """A file of many splits and one row group."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        pages = spark.range(2000).select(
            F.col("id").alias("page_id"), F.concat(F.lit("<p>"), F.sha2(F.col("id").cast("string"), 256), F.lit("</p>")).alias("html")
        )
        pages.coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
        people = spark.range(20_000).select(F.col("id").alias("c_custkey"), (F.col("id") % 25).alias("c_nationkey"), F.lit("BUILDING").alias("c_mktsegment"))
        people.coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
        rows = QUERIES[name].run(spark, str(tmp_path)).withColumn("part", F.spark_partition_id())
        assert rows.select("part").distinct().count() >= 8
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
