"""Scalar rules: literal cases and invariants."""

import random
import string

import pytest
from pyspark.sql import functions as F

from clearroll.functions import documents, guard, privacy, scores, text


def values(spark, rows, schema, *columns):
    df = spark.createDataFrame(rows, schema)
    return [tuple(r) for r in df.select(*columns).collect()]


def test_npi(spark):
    rows = [("1234567890",), ("1000000008",), ("100-000-0008",), ("0000000000",), ("123",), (None,), ("",)]
    got = [v for v, in values(spark, rows, "v string", text.npi_valid("v"))]
    assert got == [False, True, True, True, False, False, False]


def test_phone_forms(spark):
    rows = [("(555) 123-4567",), ("15551234567",), ("123",), ("+1-555-123-4567",), (None,), ("+44 20 7946",)]
    got = values(spark, rows, "v string", text.normalize_phone("v"), text.phone_shape_ok("v"))
    assert got == [
        ("+15551234567", True), ("+15551234567", True), ("123", False), ("+15551234567", True), (None, False),
        ("+44207946", False),
    ]


def test_normalisers_are_idempotent(spark):
    rng = random.Random(7)
    alphabet = string.digits + "+-() ." + string.ascii_letters + "\t"
    rows = [("".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 24))),) for _ in range(300)]
    for f in (text.normalize_phone, text.collapse_spaces, text.clean_zip, text.digits_only, text.strip):
        for once, twice in values(spark, rows, "v string", f("v"), f(f("v"))):
            assert once == twice


def test_blank_is_missing(spark):
    rows = [(" \t\n",), ("",), (None,), (" a ",)]
    assert values(spark, rows, "v string", text.present("v"), text.is_present("v")) == [
        (None, False), (None, False), (None, False), ("a", True),
    ]


def test_row_errors_doubles_messages(spark):
    rows = [("", "Smith", "12", "abc", "x@y", "A 1", "1234")]
    schema = "given_name string, family_name string, npi_number string, phone_primary string, email string, license_number string, address_zip string"
    df = spark.createDataFrame(rows, schema)
    assert df.select(text.row_errors(df.columns)).collect()[0][0] == [
        "Missing required field: given_name",
        "Invalid format for npi_number: 12",
        "Invalid format for phone_primary: abc",
        "Invalid format for email: x@y",
        "Invalid format for license_number: A 1",
        "Invalid format for address_zip: 1234",
        "Invalid NPI number format: 12",
        "Invalid phone number format: abc",
        "Invalid email format: x@y",
    ]


def test_name_similarity(one):
    assert one(text.name_similarity(F.lit("John"), F.lit("john"))) == 1.0
    assert one(text.name_similarity(F.lit(""), F.lit(""))) == 0.0
    assert one(text.name_similarity(F.lit("abcd"), F.lit("abce"))) == 0.75


def test_word_overlap_and_address_confidence(one):
    street, route, other = (F.array(F.lit(t)) for t in ("street_address", "route", "locality"))
    asked, shown = F.lit("1 Main St"), F.lit("1 main st springfield")
    assert one(scores.address_match_confidence(street, shown, asked)) == 1.0
    assert one(scores.address_match_confidence(route, shown, asked)) == pytest.approx(0.9)
    assert one(scores.address_match_confidence(other, F.lit("none"), asked)) == pytest.approx(0.5)
    assert one(text.word_overlap(F.lit(""), F.lit("a"))) == 0.0


def test_license_rules(one):
    assert one(scores.license_confidence(F.lit("Dr. A"), F.lit("active"), F.lit("Status: Active"))) == 0.9
    assert one(scores.license_confidence(F.lit("Unknown"), F.lit("inactive"), F.lit(""))) == pytest.approx(0.2)
    assert one(scores.license_status_of(F.lit("Inactive"))) == "inactive"
    assert one(scores.license_status_of(F.lit("Inactive"), compat=True)) == "active"
    assert one(scores.license_status_of(F.lit(" "))) == "inactive"
    assert one(scores.license_status_of(F.lit("License suspended"))) == "suspended"
    assert one(scores.first_date(F.lit("on 2023-12-01 or 1/2/2020"))) == "1/2/2020"
    assert one(scores.first_date(F.lit("never"))) is None
    assert one(scores.action_type(F.lit("Fined: PENALTY of 5"))) == "fine"


def test_durations_and_delays(one):
    assert one(scores.estimate_duration(F.lit(100))) == "1h 40m"
    assert one(scores.estimate_duration(F.lit(1), documents=False, licenses=False)) == "30 seconds"
    assert one(scores.estimate_duration(F.lit(2))) == "2 minutes"
    assert one(scores.backoff_delay(F.lit(3), 1, 60)) == 8.0
    assert one(scores.backoff_delay(F.lit(10), 1, 60)) == 60.0


def test_health(one):
    score, status = one(scores.health_score(F.lit(120), F.lit(0), F.lit(0)))
    assert (round(score, 6), status) == (0.3, "unhealthy")
    assert tuple(one(scores.health_score(F.lit(1), F.lit(2), F.lit(3)))) == (1.0, "healthy")


def test_mean_field_confidence(one):
    entries = F.create_map(*[F.lit(x) for kv in {"a": 0.95, "b": 0.88, "c": 0.92, "d": 0.78}.items() for x in kv])
    assert one(scores.mean_field_confidence(entries)) == pytest.approx(0.8825)
    assert one(scores.mean_field_confidence(F.create_map().cast("map<string,double>"))) == 0.0


def test_haversine(one):
    one_degree = one(scores.haversine_m(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(0.0)))
    assert one_degree == pytest.approx(111194.93, abs=0.1)


@pytest.mark.parametrize(
    "kind,value,shown",
    [
        ("phone", "+1-555-123-4567", "***-***-4567"),
        ("phone", "12", "***-***-12"),
        ("phone", "none", "***-***-****"),
        ("email", "john@x.com", "j***@x.com"),
        ("email", "j@x.com", "***@x.com"),
        ("email", "nowhere", "***@***.***"),
        ("ssn", "123-45-6789", "***-**-****"),
        ("npi", "1234567890", "***7890"),
        ("npi", "123", "**********"),
        ("address", "123 Main St", "123 *** Street"),
        ("address", "Main St", "*** Street"),
        ("name", "John", "J***"),
        ("name", "J", "***"),
        ("date_of_birth", "1980-05-01", "****-**-** (1980)"),
        ("date_of_birth", "unknown", "****-**-**"),
        ("medical_record_number", "M1", "***-***-****"),
        ("generic", "abcdef", "**cdef"),
        ("generic", "abc", "***"),
        ("phone", "", ""),
    ],
)
def test_masks(one, kind, value, shown):
    assert one(privacy.mask(kind, F.lit(value))) == shown


def test_masks_never_show_more(spark):
    rng = random.Random(3)
    rows = [("".join(rng.choice("abc123@.-+ ") for _ in range(rng.randrange(0, 20))),) for _ in range(400)]
    for raw, name, phone, mail, generic in values(
        spark, rows, "v string", "v", privacy.mask("name", "v"), privacy.mask("phone", "v"), privacy.mask("email", "v"),
        privacy.mask("generic", "v"),
    ):
        if raw:
            assert name in ("***", raw[0] + "***")
            assert sum(c.isdigit() for c in phone) <= 4
            assert mail.split("@")[0].replace("*", "") in ("", raw[0])
            assert len(generic.replace("*", "")) <= 4 and len(generic) == len(raw)


def test_encryption_round_trip(spark):
    key = F.lit("0123456789abcdef")
    rows = [("secret",), ("",), (None,), ("ünï",)]
    got = values(spark, rows, "v string", "v", privacy.decrypt(privacy.encrypt("v", key), key), privacy.decrypt(F.lit("plain"), key))
    assert all(a == b and c == "plain" for a, b, c in got)


def test_redaction(one):
    entries = F.create_map(F.lit("Authorization"), F.lit("x"), F.lit("accept"), F.lit("y"))
    assert one(privacy.redact(entries, ["authorization"])) == {"Authorization": "***REDACTED***", "accept": "y"}


def test_hostile_classes(one):
    assert one(guard.detect_malicious(F.lit("<SCRIPT>\nalert(1)</script>"))) == ["xss_attempt"]
    assert one(guard.detect_malicious(F.lit("1; DROP  table x"))) == ["sql_injection_attempt"]
    assert one(guard.detect_malicious(F.lit("../../etc"))) == ["path_traversal_attempt"]
    assert one(guard.detect_malicious(F.lit("plain words"))) == []


def test_sanitise(one):
    assert one(guard.sanitize(F.lit("  a\x00b  "))) == "ab"
    assert len(one(guard.sanitize(F.lit("x" * 3000)))) == 1000
    assert one(guard.sanitize_map(F.create_map(F.lit(" k "), F.lit(" v ")))) == {"k": "v"}


def test_content_key_ignores_column_order(spark):
    df = spark.createDataFrame([("a", "b", None)], "x string, y string, z string")
    one_way, other = df.select(guard.content_key(["x", "y", "z"]), guard.content_key(["z", "x", "y"])).collect()[0]
    assert one_way == other and one_way.startswith("validation_") and len(one_way) == len("validation_") + 32


ODD_TEXTS = [
    "", " ", "\n\n\n", "\x00\x01\x02", "a" * 10000, "\U0001f600\U0001f3e5", "漢字テスト", "مرحبا", "()[]{}", "\\d+", "Dr.", "Phone: ",
]


def test_document_fields_on_odd_texts(spark):
    rows = [(i, t) for i, t in enumerate(ODD_TEXTS)]
    for i, found in values(spark, rows, "id int, v string", "id", documents.extract_fields("v")):
        for f in found:
            assert 0 <= f["confidence"] <= 1 and len(f["value"]) > 1


def test_document_fields_of_a_letter(one):
    letter = "Physician: John Smith | x\nPhone: (555) 123-4567\nLicense: A12345\nEmail: john@x.com\nSpecialty: Urology |"
    found = {(f["field"], f["pattern_no"]): (f["value"], f["confidence"]) for f in one(documents.extract_fields(F.lit(letter)))}
    assert found[("name", 1)] == ("John Smith", 0.85)
    assert found[("phone", 7)] == ("555 123-4567", 0.7)
    assert found[("license", 10)] == ("A12345", 0.9)
    assert found[("email", 13)] == ("john@x.com", 0.95)
    more = documents.add_field_pattern("fax", r"(?i)fax[\s:]*([0-9]+)")
    assert [f["field"] for f in one(documents.extract_fields(F.lit("FAX: 12345"), more))] == ["fax"]
    assert "fax" not in documents.DOCUMENT_PATTERNS


def test_document_types(one):
    assert one(documents.document_type("p"), p="x/y.PDF") == "pdf"
    assert one(documents.document_type(F.lit("a.tiff"))) == "image"
    assert one(documents.document_type(F.lit("noext"))) == "unknown"
    assert one(documents.document_type("p", F.lit(b"%PDF-1.7")), p="x") == "pdf"
    assert one(documents.document_type("p", F.lit(b"\x89PNG....")), p="x") == "image"
    assert one(documents.document_type("p", F.lit(b"\xff\xd8\xff\xe0")), p="x") == "image"


def test_clean_text_fixups(one):
    assert one(documents.clean_text(F.lit(" a\n\n b|05 "))) == "a b|05"
    assert one(documents.clean_text(F.lit("a|05"), fixups=True)) == "aIOS"
