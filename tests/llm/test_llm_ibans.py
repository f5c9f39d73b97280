"""IBANs followed by what could go on."""

import pytest

from clearroll.llm import pii, queries

A, B, SHORT = "DE89370400440532013000", "GB82 WEST 1234 5698 7654 32", "NO9386011117947"


@pytest.mark.parametrize(
    "text,want",
    [
        (f"{A} BIC COBADEFFXXX", [A]), ("bank DE89 3704 0044 0532 0130 00 EUR 500", ["DE89 3704 0044 0532 0130 00"]), (f"{A} {B}", [A, B]),
        (f"{B} {A} {SHORT} 12", [B, A, SHORT]), (f"{A} 500 TO {SHORT}", [A, SHORT]), (f"XX00 {A}", [A]), (f"AB12 CD34 {B} NOTE", [B]),
        (f"{A}X", []), (f"{A}x", []), (f"x{A}", []), (f"{A[:-1]}1 BIC", []), (f"{SHORT} USD", [SHORT]),
        ("MT84MALT011000012345MTLCAST001S EUR", ["MT84MALT011000012345MTLCAST001S"]),
    ],
)
def test_what_follows_an_iban(text, want):
    assert [text[a:b] for k, a, b, *_ in pii.scan(text) if k == "iban"] == want


def test_ibans_in_op9(spark, tmp_path):
    spark.createDataFrame([(1, f"{A} {B} EUR 500")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spans = queries.op9_personal_data(spark, str(tmp_path)).first().spans.split(",")
    assert [s for s in spans if s.startswith("iban")] == [f"iban:0:{len(A)}", f"iban:{len(A) + 1}:{len(A) + 1 + len(B)}"]
