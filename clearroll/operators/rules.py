"""User-defined rules: record rules by type, and alert conditions.

A rule type is a function from (record columns, criteria) to a struct of value, status
and confidence.  A rule whose type is not registered answers ``unknown``; no rule can
stop the others.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import scores, text
from . import checks

RuleType = Callable[[str, dict], Column]


@dataclass(frozen=True)
class Rule:
    field_name: str
    rule_type: str
    criteria: dict = field(default_factory=dict)
    source: str = "npi"
    weight: float = 0.1


DEFAULT_RULES = [
    Rule("phone_primary", "e164_normalization", {}, "npi", 0.4),
    Rule("address_street", "place_id_matching", {"geocode_distance_threshold": 100}, "google_places", 0.25),
    Rule("license_number", "state_board_verification", {}, "state_board", 0.15),
    Rule("email", "mx_record_check", {"known_domains": K.MAIL_DOMAINS}, "hospital_website", 0.2),
    Rule("given_name", "fuzzy_matching", {"levenshtein_threshold": 0.85}, "npi", 0.4),
    Rule("family_name", "fuzzy_matching", {"levenshtein_threshold": 0.85}, "npi", 0.4),
]


def _result(value: Column, status: Column, confidence: Column) -> Column:
    return F.struct(
        value.cast("string").alias("value"),
        status.cast("string").alias("status"),
        confidence.cast("double").alias("confidence"),
    )


def _phone(name: str, criteria: dict) -> Column:
    checked = scores.check_phone(text.normalize_phone(name), F.lit(None).cast("string"), F.lit(None).cast("string"))
    return _result(checked["value"], checked["status"], checked["confidence"])


def _address(name: str, criteria: dict) -> Column:
    checked = checks.address_place_check("geocode", float(criteria.get("geocode_distance_threshold", 100)))
    return _result(F.col(name), checked["status"], checked["confidence"])


def _license(name: str, criteria: dict) -> Column:
    checked = checks.license_status_check("license")
    return _result(F.col(name), checked["status"], checked["confidence"])


def _email(name: str, criteria: dict) -> Column:
    ok = text.email_ok(name)
    known = F.substring_index(F.col(name), "@", -1).isin(*criteria.get("known_domains", [])) if criteria.get(
        "known_domains"
    ) else F.lit(False)
    status = F.when(~ok, "invalid").when(known, "valid").otherwise("warning")
    return _result(F.col(name), status, F.when(~ok, 0.0).when(known, 0.8).otherwise(0.3))


def _name(name: str, criteria: dict) -> Column:
    similarity = scores.stable(text.name_similarity(F.col(name), F.col(f"registry.{name}")))
    floor = float(criteria.get("levenshtein_threshold", 0.85))
    status = F.when(similarity >= floor, "valid").when(similarity >= 0.7, "warning").otherwise("invalid")
    return _result(F.col(name), status, similarity)


RULE_TYPES: dict[str, RuleType] = {
    "e164_normalization": _phone,
    "place_id_matching": _address,
    "state_board_verification": _license,
    "mx_record_check": _email,
    "fuzzy_matching": _name,
}


def apply_rules(records: DataFrame, rules: list[Rule] | None = None, types: dict[str, RuleType] | None = None) -> DataFrame:
    """Field results of every rule on every record, one row per rule.

    ``records`` carries the looked-up ``registry``, ``geocode`` and ``license`` structs
    that the default types read.  A rule on a blank field gives no row.
    """
    table = {**RULE_TYPES, **(types or {})}
    rows = []
    for rule in rules if rules is not None else DEFAULT_RULES:
        maker = table.get(rule.rule_type)
        unknown = _result(F.col(rule.field_name), F.lit("unknown"), F.lit(0.0))
        checked = maker(rule.field_name, rule.criteria) if maker else unknown
        error = F.lit(None).cast("string") if maker else F.lit(f"Unknown rule type: {rule.rule_type}")
        row = F.struct(
            F.lit(rule.field_name).alias("field_name"),
            F.lit(rule.rule_type).alias("rule_type"),
            F.lit(rule.source).alias("source"),
            checked["value"].alias("value"),
            checked["status"].alias("status"),
            checked["confidence"].alias("confidence"),
            error.alias("error_message"),
        )
        rows.append(F.when(text.is_present(rule.field_name), row))
    return records.select("provider_id", F.explode(F.array_compact(F.array(*rows))).alias("r")).select(
        "provider_id", "r.*"
    )


def alert_rules(extra: dict[str, tuple[str, str, int]] | None = None, drop: list[str] = ()) -> dict[str, tuple[str, str, int]]:
    """The default alert rules, with rules added and removed."""
    table = {**K.ALERT_RULES, **(extra or {})}
    return {n: r for n, r in table.items() if n not in drop}
