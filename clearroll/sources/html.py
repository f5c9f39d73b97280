"""Records from stored web pages, by selector tables, in native expressions.

A selector is ``.class``, ``tag``, ``tag.class``, ``#id`` or ``tag[attr='value']``; a list
of them is separated by commas.  An element ends at the closing tag of its own depth, so
elements of one name may nest; one that is never closed is none.  Comments are left out.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import HTML_SELECTORS
from ..functions import scores, text

_SIMPLE = re.compile(
    r"^(?P<tag>[A-Za-z][A-Za-z0-9]*)?(?:\.(?P<cls>[\w-]+)|#(?P<id>[\w-]+)"
    r"|\[(?P<attr>[\w-]+)=['\"](?P<value>[^'\"]*)['\"]\])?$"
)


def _opening(selector: str) -> str:
    """Pattern of the opening tag; group 1 is the tag name."""
    m = _SIMPLE.match(selector.strip())
    if not m or not selector.strip():
        raise ValueError(f"unsupported selector: {selector!r}")
    tag = m["tag"] or r"[A-Za-z][A-Za-z0-9]*"
    if m["cls"]:
        name = re.escape(m["cls"])
        want = rf"(?=[^>]*\sclass\s*=\s*[\"'](?:[^\"']*\s)?{name}[\s\"'])"
    elif m["id"]:
        want = rf"(?=[^>]*\sid\s*=\s*[\"']{re.escape(m['id'])}[\"'])"
    elif m["attr"]:
        want = rf"(?=[^>]*\s{re.escape(m['attr'])}\s*=\s*[\"']{re.escape(m['value'])}[\"'])"
    else:
        want = ""
    return rf"(?:{tag})(?=[\s>/]){want}"


def opening_pattern(selectors: str) -> str:
    tags = "|".join(_opening(s) for s in selectors.split(",") if s.strip())
    return rf"(?is)<(?:{tags})"


_ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")]


def plain_text(inner: Column) -> Column:
    """Inner HTML without tags, common entities resolved, stripped."""
    bare = F.regexp_replace(inner, r"(?s)<[^>]*>", "")
    for entity, char in _ENTITIES:
        bare = F.replace(bare, F.lit(entity), F.lit(char))
    return text.strip(bare)


#: Elements that have no closing tag.
_VOID = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"]
_OPEN = "array<struct<name:string,start:int,hit:boolean>>"
_SPANS = "array<struct<start:int,end:int>>"


def _tags_of(selectors: str) -> str:
    """Pattern of the tags that matter to a selector list: those of its names, or all where a selector names none."""
    names = {_SIMPLE.match(s.strip())["tag"] for s in selectors.split(",") if s.strip()}
    either = "[A-Za-z][A-Za-z0-9]*" if None in names else "(?:" + "|".join(sorted(names)) + ")"
    return rf"(?i)</?{either}(?=[\s>/])[^>]*>"


def _page(html: str | Column) -> Column:
    return F.regexp_replace(text.col(html), "(?s)<!--.*?-->", "")


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is made once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _pieces(page: Column, selectors: str) -> Column:
    """The page cut before every tag that matters: each tag with what follows it, and what it is."""
    opening = opening_pattern(selectors).replace("(?is)<", "(?is)^<")
    tags, gaps = F.regexp_extract_all(page, F.lit(_tags_of(selectors)), F.lit(0)), F.split(page, _tags_of(selectors))
    return F.transform(
        F.arrays_zip(tags.alias("tag"), F.slice(gaps, F.lit(2), F.greatest(F.size(gaps) - 1, F.lit(0))).alias("gap")),
        lambda x: F.struct(
            F.concat(x["tag"], x["gap"]).alias("text"),
            F.length(x["tag"]).alias("size"),
            F.lower(F.regexp_extract(x["tag"], "^</?([A-Za-z0-9]+)", 1)).alias("name"),
            x["tag"].startswith("</").alias("closes"),
            (~x["tag"].rlike("/>$")).alias("opens"),
            x["tag"].rlike(opening).alias("hit"),
        ),
    )


def element_spans(pieces: Column) -> Column:
    """First and last-plus-one pieces of all matching elements, by where they begin.

    The tags are walked through once, with a stack of those that are open: a closing tag
    ends the innermost open one of its name, and what was left open inside it is dropped.
    """
    start = F.struct(F.lit(0).alias("at"), F.array().cast(_OPEN).alias("open"), F.array().cast(_SPANS).alias("out"))

    def step(acc, x):
        one = F.array(F.struct(x["name"].alias("name"), acc["at"].alias("start"), x["hit"].alias("hit")))
        opened = F.when(x["opens"] & ~x["name"].isin(_VOID), F.concat(acc["open"], one)).otherwise(acc["open"])

        def close(depth):
            ended = F.get(acc["open"], depth)
            span = F.array(F.struct(ended["start"].alias("start"), acc["at"].alias("end")))
            return F.struct(
                (acc["at"] + 1).alias("at"),
                F.when(depth.isNull(), acc["open"]).otherwise(F.slice(acc["open"], F.lit(1), F.coalesce(depth, F.lit(0)))).cast(_OPEN).alias("open"),
                F.when(ended["hit"], F.concat(acc["out"], span)).otherwise(acc["out"]).cast(_SPANS).alias("out"),
            )

        depth = F.array_max(F.transform(acc["open"], lambda o, i: F.when(o["name"] == x["name"], i)))
        going_on = F.struct((acc["at"] + 1).alias("at"), opened.cast(_OPEN).alias("open"), acc["out"].alias("out"))
        return F.when(x["closes"], _bound(depth, close)).otherwise(going_on)

    return F.aggregate(pieces, start, step, lambda acc: F.array_sort(acc["out"]))


def _inner(pieces: Column, span: Column) -> Column:
    """Text of the element that the piece ``start`` opens and the piece ``end`` closes."""
    own = F.slice(pieces, span["start"] + 1, span["end"] - span["start"])
    return plain_text(F.substr(F.array_join(own["text"], ""), F.get(own, F.lit(0))["size"] + 1))


def select_text(html: str | Column, selectors: str) -> Column:
    """Text of the first element that matches any selector, NULL if none does."""

    def first(pieces: Column) -> Column:
        return _bound(F.get(element_spans(pieces), F.lit(0)), lambda span: F.when(span.isNotNull(), _inner(pieces, span)))

    return F.when(has_element(html, selectors), _bound(_page(html), lambda page: _bound(_pieces(page, selectors), first)))


def select_all(html: str | Column, selectors: str) -> Column:
    """Texts of all matching elements, those inside others too, in the order they begin."""

    def every(pieces: Column) -> Column:
        return F.transform(element_spans(pieces), lambda span: _inner(pieces, span))

    return _bound(_page(html), lambda page: _bound(_pieces(page, selectors), every))


def has_element(html: str | Column, selectors: str) -> Column:
    return F.coalesce(text.col(html).rlike(opening_pattern(selectors)), F.lit(False))


def extract_records(pages: DataFrame, selectors: dict[str, str] | None = None, compat: bool = False) -> DataFrame:
    """License records of result pages; error and no-result pages are left out."""
    table = {**HTML_SELECTORS, **(selectors or {})}
    shown = pages.where(
        ~has_element("html", table["error_message"]) & ~has_element("html", table["no_results"])
    )
    found = shown.withColumns(
        {n: select_text("html", table[n]) for n in ("provider_name", "license_status", "issue_date", "expiry_date", "specialty")}
    )
    status = scores.license_status_of("license_status", compat)
    actions = F.transform(
        F.filter(select_all("html", table["board_actions"]), lambda a: F.length(a) > 10),
        lambda a: F.struct(
            a.alias("description"), scores.first_date(a).alias("date"), scores.action_type(a).alias("type")
        ),
    )
    named = F.coalesce(F.nullif("provider_name", F.lit("")), F.lit("Unknown"))
    confidence = scores.license_confidence(named, status, "license_status")
    return found.select(
        *[c for c in pages.columns if c != "html"],
        named.alias("provider_name"),
        status.alias("license_status"),
        "issue_date",
        "expiry_date",
        "specialty",
        actions.alias("board_actions"),
        confidence.alias("confidence_score"),
        (confidence > 0.5).alias("accepted"),
    )
