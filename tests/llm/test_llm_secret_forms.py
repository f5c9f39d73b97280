"""Forms in which a secret's value may be written: found by op2 and replaced by the pipeline."""

import pytest

from clearroll.llm import queries, secret_scan

V, W = "Zx9_kQ2pLm7Rt5", "hG4!nB8vCw1Ys6"
FORMS = {
    "prefix": f'SECRET_KEY = b"{V}"\nOTHER_SECRET = rb\'{W}\'',
    "template": f'secret_key = f"{V}"; db_passphrase = r"{W}"',
    "triple": f'secret_key = """{V}"""\ndb_passphrase = \'\'\'\n{W}\n\'\'\'',
    "backticks": f"const secretKey = `{V}`; const dbPassphrase = `{W}`",
    "parentheses": f'secret_key = ("{V}"\n              "{W}")',
    "list": f'tokens = ["{V}", "{W}"]',
    "list over lines": f"tokens = [\n  '{V}',\n  # another\n  '{W}',\n]",
    "next line": f'secret_key =\n    "{V}"\ndb_passphrase = \\\n  "{W}"',
    "next line bare": f"secret_key:\n  {V}\ndb_passphrase:\n  {W}\n",
    "block": f"secret_key: |\n  {V}\n  {W}\nname: x",
    "folded block": f"a:\n  secret_key: >-\n    {V}\n  db_passphrase: |2\n    {W}\nother: y",
    "items": f"tokens:\n  - {V}\n  - '{W}'\nname: x",
    "dollar": f"db_passphrase={V}$7{W}",
    "dollar first": f"db_passphrase: $2b$12${V}\nsecret_key = $1{W}",
    "long name": f'{"a" * 300}_secret_key = "{V}"\nsecret_{"b" * 300}: "{W}"',
    "alignment": f'secret_key{" " * 400}= "{V}"\ndb_passphrase{" " * 400}: "{W}"',
    "constants": f'KEYS = ["{V}", "{W}"]\nsecret_key = KEYS',
}


@pytest.mark.parametrize("form", FORMS)
def test_form_is_found_and_replaced(form):
    text = FORMS[form]
    clean = secret_scan.redacted(text)
    assert V not in clean and W not in clean, clean
    for value in (V, W):
        at = text.index(value)
        assert any(v <= at and at + len(value) <= e for _, _, e, v, _ in secret_scan.scan(text)), value


def test_forms_in_op2_and_redact(spark, tmp_path):
    docs = spark.createDataFrame(list(enumerate(FORMS.values())), "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for r in queries.op2_secret_scan(spark, str(tmp_path)).collect():
        assert r.spans.count("literal") + r.spans.count("assign") >= 1, r
    assert not any(V in r.text or W in r.text for r in secret_scan.redact(docs).collect())


def test_what_is_no_value_stays():
    for text in (
        'secret = [dict(name="Zx9_kQ2pLm7Rt5")]', "secret:\n  name: Zx9_kQ2pLm7Rt5\n", 'secret = get(\n  "Zx9_kQ2pLm7Rt5")',
        'password = """The words of\na note"""', "the secret:\n\nSomething else follows here", "token: (see below, it is explained)", "secret_key = [", "secret =\n",
    ):
        assert [s for s in secret_scan.scan(text)] == [], text
    nested = 'tokens = [Item(secret="Zx9$kQ2pLm7Rt5")]'
    keyword = 'secret = (secret="Zx9$kQ2pLm7Rt5")'
    assert keyword[slice(*secret_scan.scan(keyword)[0][1:3])] == "Zx9$kQ2pLm7Rt5"
    assert [nested[a:b] for k, a, b, *_ in secret_scan.scan(nested)] == ["Zx9$kQ2pLm7Rt5"]


def test_hostile_forms_end_soon():
    for text in ("='''" * 60_000, "a=`\\" * 60_000, "a=[" * 60_000, "a=(\n" * 60_000, "a:\n" * 60_000, "a: |\n" * 60_000, "a:\n- b\n" * 30_000, "token=[" + "'a'," * 60_000, " =" * 90_000, "a" * 200_000 + "=", "a='''" + "\\" * 200_000):
        secret_scan.scan(text)
