"""Files, payloads, pages, exports and the generator."""

import json

import pytest
from pyspark.sql import functions as F

from clearroll.functions import text
from clearroll.plans import validate
from clearroll.plans.catalogue.registry import Tables
from clearroll.sources import documents, files, generate, html, payloads, sinks

CSV = """NPI,First_Name,LastName,Phone,E_Mail,Zip_Code,Street Address
1234567890,Ann,Lee,(555) 123-4567,ANN@X.COM,12345," 1  Main St "
12,Bob,,555,bad,1,x
,,,,,,
"""


@pytest.fixture
def csv(tmp_path):
    path = tmp_path / "in.csv"
    path.write_text(CSV)
    return str(path)


def test_header_mapping():
    got = files.map_headers(["NPI", "First_Name", "LastName", "Phone", "E_Mail", "Zip_Code", "Street Address"])
    assert got["npi_number"] == "NPI" and got["given_name"] == "First_Name" and got["family_name"] == "LastName"
    assert got["email"] == "E_Mail" and got["address_zip"] == "Zip_Code"
    exact_last = files.map_headers(["my_email", "email"])
    assert exact_last["email"] == "email"
    assert files.map_headers(["my_email", "email_2"])["email"] == "my_email"
    assert files.map_headers(["my_email", "email_2"], compat=True)["email"] == "email_2"


def test_read_directory_csv(spark, csv):
    checked = files.read_directory_csv(spark, csv)
    good = checked.good.collect()
    assert len(good) == 1
    assert good[0].phone_primary == "+15551234567" and good[0].email == "ann@x.com"
    assert good[0].address_street == "1 Main St" and good[0].provider_id.startswith("rec_")
    assert checked.bad.count() == 2
    again = files.read_directory_csv(spark, csv).good.collect()
    assert again[0].provider_id == good[0].provider_id


def test_custom_mapping(spark, csv):
    rows = files.read_directory_csv(spark, csv, {"given_name": "LastName", "family_name": "First_Name"}).rows.collect()
    assert (rows[0].given_name, rows[0].family_name) == ("Lee", "Ann")


def test_structure(spark, csv):
    told = files.check_structure(spark.read.csv(csv, header=True))
    assert not told["valid"] and told["missing_headers"] == ["given_name", "family_name"] and told["row_count"] == 3
    df = spark.createDataFrame([("a", "b", "c")], ["given_name", "family_name", "Given_Name"])
    assert files.check_structure(df)["duplicate_headers"] == ["Given_Name"]
    assert files.read_header(spark, csv)[:2] == ["NPI", "First_Name"]


def test_batch_rows(spark, tmp_path):
    path = tmp_path / "b.csv"
    path.write_text("provider_id,given_name,email\n1,,\n2,Ann,\n3,,a@b.co\n")
    assert sorted(r.provider_id for r in files.read_batch_csv(spark, str(path)).collect()) == ["2", "3"]


def test_batch_json(spark, tmp_path):
    path = tmp_path / "b.json"
    path.write_text("\n".join(json.dumps({"provider_id": str(i), "given_name": "A", "other": 1}) for i in range(1500)))
    df = files.read_batch_json(spark, str(path))
    assert df.count() == 1500 and "other" not in df.columns


def test_first_generation_names(spark):
    df = spark.createDataFrame([("1", "A", "B")], "npi string, first_name string, last_name string")
    assert files.from_v1(df).columns == ["npi_number", "given_name", "family_name"]


def test_registry_payload(spark):
    body = {
        "number": "1234567890", "enumeration_type": "NPI-1",
        "basic": {"first_name": "A", "last_name": "B", "credential": "MD"},
        "addresses": [{"address_1": "1 Main", "city": "X"}, {"address_1": "2 Oak"}],
        "taxonomies": [{"code": "c1", "desc": "d1"}, {"code": "c2", "desc": "d2"}],
    }
    df = spark.createDataFrame([(1, json.dumps(body)), (2, "{}")], "id int, payload string")
    full, empty = payloads.flatten_registry(df).orderBy("id").collect()
    assert (full.npi_number, full.primary_taxonomy, full.address_street) == ("1234567890", "c1", "1 Main")
    assert full.metadata.all_taxonomies == ["d1", "d2"] and full.metadata.all_addresses == 2
    assert empty.npi_number == "" and empty.primary_taxonomy is None and empty.metadata.all_addresses == 0


def test_place_details(spark):
    part = lambda long, short, *types: {"long_name": long, "short_name": short, "types": list(types)}
    body = {
        "place_id": "p", "name": "Clinic", "types": ["health"], "formatted_address": "1 Main St",
        "geometry": {"location": {"lat": 1.5, "lng": -2}, "location_type": "ROOFTOP"},
        "address_components": [
            part("1", "1", "street_number"), part("Main St", "Main St", "route"), part("X", "X", "locality", "political"),
            part("California", "CA", "administrative_area_level_1"), part("United States", "US", "country"),
        ],
    }
    row = payloads.flatten_place_details(spark.createDataFrame([(json.dumps(body),)], "payload string")).collect()[0]
    assert (row.address_street, row.address_state, row.country, row.types, row.match_confidence) == (
        "1 Main St", "CA", "US", ["health"], 0.95,
    )


PAGE = """<html><body><div class="provider-name">Dr. Jane Doe</div>
<div class="license-status">Status: Suspended</div><div class="issue-date">Issued: 2018-06-01</div>
<div class="specialty">Family &amp; Medicine</div>
<ul class="x actions"><li>Suspension for 6 months from 2023-12-01</li></ul></body></html>"""


def test_license_page(spark):
    rows = [
        (1, PAGE), (2, '<div class="no-results">none</div>'), (3, '<p class="big error">x</p>'),
        (4, "<html>empty</html>"), (5, '<div class="errors">fine</div>'),
    ]
    got = {r.page_id: r for r in html.extract_records(spark.createDataFrame(rows, "page_id int, html string")).collect()}
    assert set(got) == {1, 4, 5}
    page = got[1]
    assert (page.provider_name, page.license_status, page.specialty) == ("Dr. Jane Doe", "suspended", "Family & Medicine")
    assert page.confidence_score == pytest.approx(0.8) and page.accepted
    assert [(a["date"], a["type"]) for a in page.board_actions] == [("2023-12-01", "suspension")]
    assert got[4].provider_name == "Unknown" and not got[4].accepted


def test_selectors(one):
    page = F.lit("<INPUT name='q' id='k'><p id=\"k2\" class='a b-c'>x <b>y</b></p>")
    assert one(html.select_text(page, ".b-c")) == "x y"
    assert one(html.select_text(page, ".b")) is None
    assert one(html.select_text(page, "#k2")) == "x y"
    nested = F.lit(
        "<div><!-- <p class='a'>no</p> --><DIV class='a'>1<div>2<br>3<DIV/></div>4<p>5</div>6<p class='a'>7<p>8</p>"
        "</span><div class='a'>9<div class='x a'>10</div></div><section class='a'>open"
    )
    assert one(html.select_all(nested, ".a")) == ["12345", "910", "10"]
    assert one(html.select_all(nested, "div.a")) == ["12345", "910", "10"] and one(html.select_text(nested, "p")) == "8"
    deep = F.lit("<div class='a'>" + "<div>" * 300 + "x" + "</div>" * 300 + "y</div>z")
    assert one(html.select_text(deep, ".a")) == "xy"
    assert one(html.select_text(F.lit(None).cast("string"), "p")) is None and one(html.select_all(F.lit("no tags"), "p")) == []
    assert one(html.has_element(page, "input[name='q']")) is True
    with pytest.raises(ValueError):
        html.select_text(page, "div > p")


def test_pages_cost_what_they_hold(spark):
    """A page of 6,000 tags is cut up once, not once per tag."""
    import time

    page = "<div class='a'>" + "".join(f"<p>{i} &amp; <b>x</b></p>" for i in range(1500)) + "</div>"
    df = spark.createDataFrame([(page,)], "html string").select(
        F.size(html.select_all("html", "p")).alias("n"), html.select_all("html", "p")[1499].alias("last"), F.length(html.select_text("html", ".a")).alias("size")
    )
    begin = time.time()
    want = "".join(f"{i} & x" for i in range(1500))
    assert tuple(df.first()) == (1500, "1499 & x", len(want)) and time.time() - begin < 20


def test_scan_documents(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"%PDF-1.4 x")
    (tmp_path / "b.png").write_bytes(b"not really")
    (tmp_path / "c.txt").write_bytes(b"text")
    got = {r.path.rsplit("/", 1)[1]: r.document_type for r in documents.scan_documents(spark, str(tmp_path)).collect()}
    assert got == {"a.bin": "pdf", "b.png": "image", "c.txt": "unknown"}


def test_pages_round_trip(spark):
    docs = spark.createDataFrame([(1, "abcdefghij" * 7), (2, "")], "doc_id int, text string")
    whole = documents.combine_pages(documents.split_pages(docs, size=9)).orderBy("doc_id").collect()
    assert whole[0].text.replace("\n\n", "") == "abcdefghij" * 7 and whole[0].page_count == 8
    assert whole[1].page_count == 1


def test_export_csv(spark, folder, tmp_path):
    t = Tables(spark, folder)
    target = str(tmp_path / "out")
    sinks.export_csv(t.directory, target, "valid")
    back = spark.read.csv(target, header=True)
    assert back.columns == sinks.EXPORT_COLUMNS
    assert back.count() == t.directory.where("validation_status = 'valid'").count()
    assert back.where("`Created At` not rlike '^[0-9]{4}-[0-9]{2}-[0-9]{2}T'").count() == 0


def test_reports_as_json(spark, folder, tmp_path):
    t = Tables(spark, folder)
    reports = validate.report_records(
        t.directory, t.registry, t.geocodes, t.licenses, t.enrichment, t.document_fields, as_of="2024-01-31 00:00:00"
    )
    body = json.loads(sinks.report_json(reports).limit(1).collect()[0].json)
    assert body["generated_at"].startswith("2024-01-31T00:00:00") and body["metadata"]["report_version"] == "1.0"
    digest = sinks.report_digest(reports).collect()
    assert all(i.severity in ("critical", "error") for d in digest for i in d.critical_insights)
    sinks.export_report_json(reports, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 150


def test_archive_and_audit_tables(spark, folder, tmp_path):
    t = Tables(spark, folder)
    kept = sinks.archive(t.directory, "2024-01-31 00:00:00", 2000, str(tmp_path / "old"))
    old = spark.read.parquet(str(tmp_path / "old"))
    assert kept.count() + old.count() == 150 and old.count() > 0
    sinks.append_audit(t.audit_logs, str(tmp_path / "audit"))
    sinks.append_audit(t.audit_logs, str(tmp_path / "audit"))
    back = spark.read.parquet(str(tmp_path / "audit"))
    assert back.count() == 2 * t.audit_logs.count() and {"date", "hour"} <= set(back.columns)


def test_generator(spark):
    first = generate.generate_directory(spark, 500, seed=1)
    assert first.exceptAll(generate.generate_directory(spark, 500, seed=1, partitions=3)).count() == 0
    assert first.exceptAll(generate.generate_directory(spark, 500, seed=2)).count() > 400
    kinds = first.withColumn("kind", F.substring("provider_id", 2, 9).cast("int") % 10)
    assert kinds.where((F.col("kind") == 0) & ~text.npi_valid("npi_number")).count() == 0
    assert kinds.where((F.col("kind") == 2) & text.email_ok("email")).count() == 0
    assert kinds.where("kind = 6 and license_number <> ''").count() == 0
    assert kinds.where("kind = 8 and license_status <> 'suspended'").count() == 0
    assert kinds.where("kind = 5 and address_street not like '%(MOVED)'").count() == 0
    assert kinds.where("overall_confidence < 0 or overall_confidence > 1.01").count() == 0
