"""Queries: text of documents and stored web pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ... import constants as K
from ...functions import documents as D
from ...functions import text
from ...operators import matching, metrics
from ...sources import documents, html
from ...streaming.run import work_folder
from .records import r6_sql
from .registry import query, r6


@query("clean_document_text", "F21", "",
       r"""SELECT doc_id, md5(trim(regexp_replace(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g'), '[\x00-\x1f\x7f-\x{9f}]', '', 'g'))) AS digest,
  md5(translate(trim(regexp_replace(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g'), '[\x00-\x1f\x7f-\x{9f}]', '', 'g')), '|05', 'IOS')) AS fixed FROM documents""")
def _(t):
    return t.wide(t.raw("documents"), "doc_id").select(
        "doc_id", F.md5(D.clean_text("text")).alias("digest"), F.md5(D.clean_text("text", fixups=True)).alias("fixed")
    )


@query("combined_pages", "S18", "",
       """SELECT doc_id, CAST(greatest(1, ceil(length(text) / 700e0)) AS BIGINT) AS page_count,
  md5(array_to_string(list_transform(range(0, CAST(greatest(1, ceil(length(text) / 700e0)) AS BIGINT)), lambda i: substr(text, i * 700 + 1, 700)), concat(chr(10), chr(10)))) AS digest FROM documents""")
def _(t):
    pages = documents.split_pages(t.raw("documents"), size=700)
    return documents.combine_pages(pages).select("doc_id", "page_count", F.md5("text").alias("digest"))


def find_sql(number: int, field: str, regex: str) -> str:
    flat = regex.replace("(?i)", "").replace("'", "''")
    good = f"""list_filter(list_transform(regexp_extract_all(text, '(?im){flat}', 1),
  lambda v: trim(regexp_replace(regexp_replace(v, '[^A-Za-z0-9_\\s@.\\-]', '', 'g'), '\\s+', ' ', 'g'))), lambda v: length(v) > 1)[1]"""
    tiers = {
        "phone": "CASE WHEN regexp_matches(value, '^\\([0-9]{3}\\)\\s*[0-9]{3}-[0-9]{4}$') THEN 0.95e0 WHEN regexp_matches(value, '^[0-9]{3}-[0-9]{3}-[0-9]{4}$') THEN 0.9e0 ELSE 0.7e0 END",
        "email": f"CASE WHEN regexp_matches(value, '{K.EMAIL_PATTERN}') THEN 0.95e0 ELSE 0.7e0 END",
        "license": "CASE WHEN regexp_matches(value, '^[A-Z0-9\\-]+$') AND length(value) >= 3 THEN 0.9e0 ELSE 0.75e0 END",
        "name": "CASE WHEN regexp_matches(value, '^[A-Za-z\\s.,]+$') AND length(value) >= 3 THEN 0.85e0 ELSE 0.7e0 END",
    }
    extra = "0.05e0" if ("^" in regex or "$" in regex) else "0e0"
    score = f"least(1e0, {tiers.get(field, '0.8e0')} + {extra})"
    return f"""SELECT doc_id, '{field}' AS field, CAST({number} AS BIGINT) AS pattern_no, value, {r6_sql(score)} AS confidence
FROM (SELECT doc_id, {good} AS value FROM {{source}}) x WHERE value IS NOT NULL"""


NUMBERED = [(i + 1, f, p) for i, (f, p) in enumerate((f, p) for f, ps in K.DOCUMENT_PATTERNS.items() for p in ps)]
FOUND = " UNION ALL ".join(find_sql(*n) for n in NUMBERED)


@query("document_fields", "F22 F23 F24 X3", "", FOUND.replace("{source}", "documents"))
def _(t):
    done = documents.extract_document_fields(t.wide(t.raw("documents"), "doc_id"))
    return done.select(
        "doc_id", "field", F.col("pattern_no").cast("bigint").alias("pattern_no"), "value", r6("confidence").alias("confidence")
    )


LETTER = """(SELECT k AS doc_id, concat('Physician: ', given_name, ' ', family_name, chr(10), 'Address: ', address_street, chr(10), 'Phone: ', phone_primary, chr(10),
  'License: ', license_number, chr(10), 'Email: ', email, chr(10), 'Specialty: ', primary_taxonomy, ' | end') AS text FROM directory) s"""


def letters(t):
    """A letter per record, with the record's fields written out."""
    nl = F.lit("\n")
    body = F.concat(
        F.lit("Physician: "), "given_name", F.lit(" "), "family_name", nl, F.lit("Address: "), "address_street", nl,
        F.lit("Phone: "), "phone_primary", nl, F.lit("License: "), "license_number", nl, F.lit("Email: "), "email", nl,
        F.lit("Specialty: "), "primary_taxonomy", F.lit(" | end"),
    )
    return t.wide(t.directory.select(F.col("k").alias("doc_id"), body.alias("text")), "doc_id")


@query("letter_fields", "F22 F23 F24", "directory", FOUND.replace("{source}", LETTER))
def _(t):
    done = documents.extract_document_fields(letters(t))
    return done.select(
        "doc_id", "field", F.col("pattern_no").cast("bigint").alias("pattern_no"), "value", r6("confidence").alias("confidence")
    )


@query("document_confidence", "A48", "directory",
       f"""SELECT doc_id, {r6_sql('(t + coalesce(f, 0e0)) / CASE WHEN f IS NULL THEN 1 ELSE 2 END')} AS confidence FROM (
  SELECT s.doc_id, CASE WHEN length(text) > 100 THEN 0.8e0 WHEN length(text) > 50 THEN 0.6e0 ELSE 0.4e0 END AS t, f FROM {LETTER}
  LEFT JOIN (SELECT doc_id, avg(confidence) AS f FROM ({FOUND.replace('{source}', LETTER)}) a GROUP BY doc_id) b ON s.doc_id = b.doc_id) c""")
def _(t):
    source = letters(t)
    found = documents.extract_document_fields(source)
    return metrics.document_confidence(source, found).select("doc_id", r6("confidence").alias("confidence"))


@query("combined_entities", "U2", "document_fields directory",
       f"""SELECT doc_id, field, value, 'pattern' AS origin FROM ({FOUND.replace('{source}', LETTER)}) p
UNION ALL SELECT k, CASE field_name WHEN 'name' THEN 'name' ELSE 'phone' END, field_value, 'entity' FROM document_fields f JOIN directory d ON f.provider_id = d.provider_id
WHERE field_name IN ('name', 'phone')""")
def _(t):
    entities = t.document_fields.join(t.directory.select("provider_id", "k"), "provider_id").select(
        F.col("k").alias("doc_id"),
        F.when(F.col("field_name") == "name", "PERSON").when(F.col("field_name") == "phone", "Phone_Number").otherwise("other").alias("entity_type"),
        F.col("field_value").alias("value"), "confidence",
    )
    found = documents.extract_document_fields(letters(t))
    return documents.combine_entities(entities, found).select("doc_id", "field", "value", "origin")


@query("document_types", "S17", "directory",
       """SELECT provider_id, CASE WHEN k % 4 = 0 THEN 'pdf' WHEN k % 4 = 1 THEN 'image' ELSE 'unknown' END AS document_type FROM directory""")
def _(t):
    name = F.concat(
        "provider_id", F.when(F.col("k") % 4 == 0, ".pdf").when(F.col("k") % 4 == 1, ".JPeG").when(F.col("k") % 4 == 2, ".txt").otherwise("")
    )
    return t.directory.select("provider_id", D.document_type(name).alias("document_type"))


#: What files are written with: first bytes (Latin-1) and suffix, by ``k % 4``; two of the suffixes are wrong or say nothing.
FILE_KINDS = [("%PDF-1.4 ", "txt"), ("\x89PNG ", "pdf"), ("text ", "png"), ("text ", "txt")]


@query("scanned_documents", "S17", "directory",
       """SELECT CAST(k % 4 AS BIGINT) AS kind, CASE k % 4 WHEN 0 THEN 'pdf' WHEN 1 THEN 'image' WHEN 2 THEN 'image' ELSE 'unknown' END AS document_type,
  CAST(sum(CASE k % 4 WHEN 0 THEN 9 ELSE 5 END + length(provider_id) + 1) AS BIGINT) AS bytes FROM directory GROUP BY 1, 2""")
def _(t):
    """Documents written as files and read back as bytes: the type is that of the first bytes, else of the suffix."""
    base = work_folder(t.spark, "documents")
    for kind, (head, suffix) in enumerate(FILE_KINDS):
        lines = t.directory.where(F.col("k") % 4 == kind).select(F.concat(F.lit(head), "provider_id"))
        lines.write.option("extension", suffix).option("encoding", "ISO-8859-1").csv(f"{base}/kind={kind}")
    found = documents.scan_documents(t.spark, base)
    kind = F.regexp_extract("path", r"/kind=(\d)/", 1).cast("bigint")
    return found.groupBy(kind.alias("kind"), "document_type").agg(F.sum("length").alias("bytes"))


# -- stored pages --------------------------------------------------------------------------------

TAG = "(?is)<{tag}(?:\\s[^>]*)?>(.*?)</{tag}\\s*>"


def plain_sql(inner: str) -> str:
    bare = f"regexp_replace({inner}, '<[^>]*>', '', 'g')"
    for entity, char in html._ENTITIES:
        quoted = char.replace("'", "''")
        bare = f"replace({bare}, '{entity}', '{quoted}')"
    return f"trim({bare}, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13)))"


def first_sql(tag: str) -> str:
    pattern = TAG.format(tag=tag)
    return f"CASE WHEN regexp_matches(html, '{pattern}') THEN {plain_sql(f'''regexp_extract(html, '{pattern}', 1)''')} END"


AD = '(?is)<div class="ad">(.*?)</div\\s*>'


@query("page_elements", "S16 X6", "",
       f"""SELECT page_id, {first_sql('title')} AS title, {first_sql('h1')} AS heading, CAST(len(regexp_extract_all(html, '{TAG.format(tag='p')}', 1)) AS BIGINT) AS paragraphs,
  CASE WHEN regexp_matches(html, '{AD}') THEN {plain_sql(f"regexp_extract(html, '{AD}', 1)")} END AS ad, regexp_matches(html, '(?i)<nav[ >]') AS has_nav FROM pages""")
def _(t):
    return t.wide(t.raw("pages"), "page_id").select(
        "page_id",
        html.select_text("html", "title").alias("title"),
        html.select_text("html", "h1").alias("heading"),
        F.size(html.select_all("html", "p")).cast("bigint").alias("paragraphs"),
        html.select_text("html", "div.ad").alias("ad"),
        html.has_element("html", "nav").alias("has_nav"),
    )


@query("license_pages", "S16 F15 F16 F17 F18", "licenses",
       f"""SELECT license_number, holder_name AS provider_name, license_status AS status, strftime(issue_date, 'Issued: %Y-%m-%d') AS issue_date,
  CAST(CASE WHEN license_status = 'suspended' THEN 1 ELSE 0 END AS BIGINT) AS actions, CASE WHEN license_status = 'suspended' THEN '2023-12-01' END AS action_date,
  {r6_sql("0.7e0 + CASE license_status WHEN 'active' THEN 0.2e0 WHEN 'suspended' THEN 0.1e0 WHEN 'revoked' THEN 0.1e0 ELSE 0e0 END")} AS confidence
FROM licenses WHERE right(license_number, 1) NOT IN ('0', '1')""")
def _(t):
    last = F.right("license_number", F.lit(1))
    result = F.concat(
        F.lit('<html><body><div><!-- <div class="provider-name">no one</div> --><div class="provider-name big"><div><i></i></div><div>'), "holder_name",
        F.lit('</div></div></div><DIV id="x" class=\'license-status\'>Status: '), F.initcap("license_status"),
        F.lit('</DIV><div class="issue-date">Issued: '), F.date_format("issue_date", "yyyy-MM-dd"),
        F.lit("</div>"),
        F.when(
            F.col("license_status") == "suspended",
            F.lit('<div class="board-actions"><div><div>Board:</div></div><br><b>Suspension</b> for 6 months, <div>2023-12-01</div></div>'),
        ).otherwise(F.lit('<div class="board-actions">None</div>')),
        F.lit("</body></html>"),
    )
    page = (
        F.when(last == "0", F.lit('<div class="no-results">License number not found.</div>'))
        .when(last == "1", F.lit('<p class="alert">Service error</p>'))
        .otherwise(result)
    )
    found = html.extract_records(t.wide(t.licenses, "license_number").select("license_number", page.alias("html")))
    first = F.try_element_at("board_actions", F.lit(1))
    return found.select(
        "license_number", "provider_name", F.col("license_status").alias("status"), "issue_date",
        F.size("board_actions").cast("bigint").alias("actions"), first["date"].alias("action_date"),
        r6("confidence_score").alias("confidence"),
    )


def rules(t):
    """Crawl rules made of the pages' own hosts: some close a folder, some all but one."""
    host = F.lower(F.parse_url("url", F.lit("HOST")))
    hosts = t.raw("pages").select(host.alias("host")).distinct()
    size = F.length("host") % 3
    one = lambda prefix, allow: F.struct(F.lit(prefix).alias("path_prefix"), F.lit(allow).alias("allow"))
    listed = F.when(size == 0, F.array(one("/en", False))).when(
        size == 1, F.array(one("/", False), one("/en/1", True))
    ).otherwise(F.array().cast("array<struct<path_prefix:string,allow:boolean>>"))
    return hosts.select("host", F.explode(listed).alias("r")).select("host", "r.*")


URL = "regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)"
PATH = "coalesce(nullif(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), ''), '/')"


@query("crawl_gate", "J14", "",
       f"""SELECT page_id, allowed, CASE WHEN allowed THEN 'ok' ELSE 'warning' END AS status FROM (SELECT page_id, CASE length({URL}) % 3
  WHEN 0 THEN NOT starts_with({PATH}, '/en') WHEN 1 THEN starts_with({PATH}, '/en/1') ELSE true END AS allowed FROM pages) p""")
def _(t):
    return matching.crawl_gate(t.raw("pages"), rules(t)).select("page_id", "allowed", "status")


@query("word_overlap", "U3", "",
       """SELECT doc_id, round(CAST(len(list_intersect(a, b)) / CAST(len(a) AS DOUBLE) AS DOUBLE) + 1e-9, 6) AS overlap FROM (SELECT doc_id,
  list_distinct(list_filter(regexp_split_to_array(lower(text), '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '')) AS a,
  ['the', 'of', 'and', 'der', 'que', 'le', 'de', 'en'] AS b FROM documents) x""")
def _(t):
    common = F.lit("the of and der que le de en")
    return t.wide(t.raw("documents"), "doc_id").select("doc_id", r6(text.word_overlap("text", common)).alias("overlap"))
