"""Masks, redaction and encryption of personal fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import REDACTED
from .text import col


def _stars(n: Column) -> Column:
    return F.repeat(F.lit("*"), n)


def mask_phone(c: str | Column) -> Column:
    digits = F.regexp_replace(col(c), "[^0-9]", "")
    shown = F.when(digits == "", F.lit("****")).otherwise(F.right(digits, F.lit(4)))
    return F.concat(F.lit("***-***-"), shown)


def mask_email(c: str | Column) -> Column:
    value = col(c)
    at = F.instr(value, "@")
    domain = F.substr(value, at + 1)
    first = F.when(at > 2, F.left(value, F.lit(1))).otherwise(F.lit(""))
    return F.when(at == 0, F.lit("***@***.***")).otherwise(F.concat(first, F.lit("***@"), domain))


def mask_ssn(c: str | Column) -> Column:
    return F.when(col(c).isNotNull(), F.lit("***-**-****"))


def mask_npi(c: str | Column) -> Column:
    value = col(c)
    return F.when(
        F.length(value) >= 4, F.concat(F.lit("***"), F.right(value, F.lit(4)))
    ).when(value.isNotNull(), F.lit("**********"))


def mask_address(c: str | Column) -> Column:
    number = F.regexp_extract(col(c), "^([0-9]+)", 1)
    return F.when(number != "", F.concat(number, F.lit(" *** Street"))).when(
        col(c).isNotNull(), F.lit("*** Street")
    )


def mask_name(c: str | Column) -> Column:
    value = col(c)
    return F.when(F.length(value) > 1, F.concat(F.left(value, F.lit(1)), F.lit("***"))).when(
        value.isNotNull(), F.lit("***")
    )


def mask_date_of_birth(c: str | Column) -> Column:
    year = F.regexp_extract(col(c), "([0-9]{4})", 1)
    return F.when(year != "", F.concat(F.lit("****-**-** ("), year, F.lit(")"))).when(
        col(c).isNotNull(), F.lit("****-**-**")
    )


def mask_record_number(c: str | Column) -> Column:
    return F.when(col(c).isNotNull(), F.lit("***-***-****"))


def mask_generic(c: str | Column) -> Column:
    value = col(c)
    size = F.length(value)
    return F.when(
        size > 4, F.concat(_stars(size - 4), F.right(value, F.lit(4)))
    ).otherwise(_stars(size))


MASKS = {
    "phone": mask_phone,
    "email": mask_email,
    "ssn": mask_ssn,
    "npi": mask_npi,
    "address": mask_address,
    "name": mask_name,
    "date_of_birth": mask_date_of_birth,
    "medical_record_number": mask_record_number,
    "generic": mask_generic,
}


def mask(kind: str, c: str | Column) -> Column:
    """The mask of that kind; NULL and empty values stay as they are."""
    value = col(c).cast("string")
    return F.when(value == "", value).otherwise(MASKS.get(kind, mask_generic)(value))


def redact(entries: str | Column, keys: list[str], ignore_case: bool = True) -> Column:
    """Values of the named keys of a string map replaced by a fixed marker."""
    names = [k.lower() for k in keys] if ignore_case else list(keys)

    def hide(key: Column, value: Column) -> Column:
        probe = F.lower(key) if ignore_case else key
        return F.when(probe.isin(*names), F.lit(REDACTED)).otherwise(value)

    return F.transform_values(col(entries), hide)


def encrypt(c: str | Column, key: Column) -> Column:
    """AES-GCM, base64; NULL stays NULL."""
    return F.base64(F.aes_encrypt(col(c), key))


def decrypt(c: str | Column, key: Column) -> Column:
    """Reverse of :func:`encrypt`; a value that does not decrypt is passed through."""
    plain = F.try_aes_decrypt(F.try_to_binary(col(c), F.lit("base64")), key)
    return F.coalesce(plain.cast("string"), col(c))
