"""A synthetic directory of any size with ten kinds of error, made on the executors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .derived import CITIES, DOMAINS, FAMILY, FAKE_NPIS, GIVEN, BAD_EMAILS, BAD_PHONES, STATES, STREETS


def _pick(seed: Column, items: list[str]) -> Column:
    return F.element_at(F.array(*[F.lit(i) for i in items]), (F.pmod(seed, F.lit(len(items))) + 1).cast("int"))


def _between(seed: Column, low: int, high: int) -> Column:
    return F.pmod(seed, F.lit(high - low + 1)) + low


def _npi(seed: Column) -> Column:
    """Ten digits whose last one makes them pass the Luhn check."""
    nine = _between(seed, 100000000, 999999999).cast("string")
    total = F.lit(0)
    for place in range(1, 10):
        digit = F.substring(nine, place, 1).cast("int")
        total = total + (F.when(digit >= 5, digit * 2 - 9).otherwise(digit * 2) if place % 2 else digit)
    return F.concat(nine, F.pmod(10 - total % 10, F.lit(10)).cast("string"))


def generate_directory(spark: SparkSession, n: int, seed: int = 42, partitions: int | None = None) -> DataFrame:
    """n records; the error kind is ``id % 10``.  The same seed gives the same records."""
    ids = spark.range(0, n, 1, partitions) if partitions else spark.range(n)

    def draw(name: str) -> Column:
        return F.xxhash64(F.col("id"), F.lit(seed), F.lit(name))

    kind = F.col("id") % 10
    given, family = _pick(draw("given"), GIVEN), _pick(draw("family"), FAMILY)
    state_no = F.pmod(draw("state"), F.lit(len(STATES)))
    street = F.concat_ws(" ", _between(draw("number"), 1, 9999).cast("string"), _pick(draw("street"), STREETS))
    phone = F.concat_ws(
        "-",
        _between(draw("area"), 200, 999).cast("string"),
        _between(draw("exchange"), 200, 999).cast("string"),
        _between(draw("line"), 1000, 9999).cast("string"),
    )
    mixed = {w: F.pmod(draw(f"mixed {w}"), F.lit(2)) == 0 for w in ("phone", "email", "license")}
    bad_phone = (kind == 1) | ((kind == 9) & mixed["phone"])
    bad_email = (kind == 2) | ((kind == 9) & mixed["email"])
    low = (
        F.when(kind == 0, 70).when(kind == 1, 40).when(kind == 2, 50).when(kind == 3, 30).when(kind == 4, 20)
        .when(kind == 5, 40).when(kind == 6, 30).when(kind == 7, 10).when(kind == 8, 20).otherwise(20)
    )
    return ids.select(
        F.concat(F.lit("P"), F.col("id").cast("string")).alias("provider_id"),
        given.alias("given_name"),
        family.alias("family_name"),
        F.when(kind == 4, _pick(draw("fake"), FAKE_NPIS))
        .when((kind == 7) & (F.col("id") > 10), F.concat(F.lit("DUPLICATE_"), F.col("id").cast("string")))
        .otherwise(_npi(draw("npi")))
        .alias("npi_number"),
        _pick(draw("taxonomy"), ["Family Medicine", "Pediatrics", "Dermatology", "Urology"]).alias("primary_taxonomy"),
        F.when(kind == 5, F.concat(street, F.lit(" (MOVED)"))).otherwise(street).alias("address_street"),
        _pick(state_no, CITIES).alias("address_city"),
        _pick(state_no, STATES).alias("address_state"),
        _between(draw("zip"), 10000, 99999).cast("string").alias("address_zip"),
        F.when(bad_phone, _pick(draw("bad phone"), BAD_PHONES)).otherwise(phone).alias("phone_primary"),
        F.when(bad_email, _pick(draw("bad email"), BAD_EMAILS))
        .otherwise(F.lower(F.concat(given, F.lit("."), family, F.lit("@"), _pick(draw("domain"), DOMAINS))))
        .alias("email"),
        F.when(kind == 6, "")
        .otherwise(F.concat(_pick(draw("letter"), ["A", "B", "C"]), _between(draw("license"), 100000, 999999).cast("string")))
        .alias("license_number"),
        _pick(state_no, STATES).alias("license_state"),
        F.when(kind == 3, "expired").when(kind == 6, "").when(kind == 8, "suspended")
        .when((kind == 9) & mixed["license"], _pick(draw("lapse"), ["expired", "suspended"]))
        .otherwise("active")
        .alias("license_status"),
        ((low + F.pmod(draw("confidence"), F.lit(31))) / 100.0).alias("overall_confidence"),
    )
