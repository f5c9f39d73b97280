"""Ordered computations over time: limits, cooldowns, sustained conditions, trends.

A log can have one client or connector with a third of all rows, so no window here
runs over raw rows of a key.  Rows are first counted per (key, instant) - a map-side
aggregate - and the ordered step then sees at most one row per instant of a bounded
span of time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import scores
from ..session import written


#: Pieces that a block of a sliding span is cut into.
PIECES = 64


def _micros(c: str) -> Column:
    return F.unix_micros(F.col(c).cast("timestamp"))


def latest_per_key(df: DataFrame, key: str, at: str, tie: str) -> DataFrame:
    """The newest row per key, as an aggregate: a hot key is reduced before the shuffle."""
    rest = [c for c in df.columns if c not in (key, at, tie)]
    row = F.struct(at, tie, *rest)
    return df.groupBy(key).agg(F.max(row).alias("_row")).select(key, "_row.*").select(*df.columns)


def sliding_limit(
    log: DataFrame, key: str, at: str, limits: dict[str, tuple[float, int]] | None = None, seconds: int = 60
) -> DataFrame:
    """Per key and instant: requests in the trailing span, over the limit or not, spacing.

    Counts are exact to the microsecond.  Time is cut in blocks as long as the span, and
    those in pieces: what is in the span is what its block holds up to the instant and what
    the block before holds after the span's begin, and either is the sum of whole pieces
    and a running count inside one.  A window sees one piece, one row per instant, or the
    pieces of one block, however busy a key is.
    """
    span = seconds * 1_000_000
    table = limits or K.CONNECTOR_LIMITS
    widest = max((1e6 / rps for rps, _ in table.values()), default=1.0)  # the instant before matters within this
    piece = max(1, -(-span // PIECES), min(span, int(widest) + 1))
    instants = log.groupBy(F.col(key), _micros(at).alias("us")).agg(F.count(F.lit(1)).alias("requests"))
    cell = lambda us: (F.floor(us / span).alias("_block"), F.floor(F.pmod(us, F.lit(span)) / piece).alias("_piece"))
    rows = instants.select(F.struct(key).alias("_k"), *cell(F.col("us")), "us", "requests", F.lit(None).cast("long").alias("_for"))
    asked = rows.select("_k", *cell(F.col("us") - span), (F.col("us") - span).alias("us"), F.lit(None).cast("long").alias("requests"), F.col("us").alias("_for"))
    inside = Window.partitionBy("_k", "_block", "_piece").orderBy("us")
    before = F.lag(F.when(F.col("_for").isNull(), F.col("us")), 1).over(inside)
    upto = F.coalesce(F.sum("requests").over(inside.rangeBetween(Window.unboundedPreceding, Window.currentRow)), F.lit(0))
    ran = rows.unionByName(asked).withColumn("_run", upto)
    pieces = rows.groupBy("_k", "_block", "_piece").agg(F.sum("requests").alias("_own"), F.max("us").alias("_last"))
    block = Window.partitionBy("_k", "_block").orderBy("_piece")
    # a begin may lie in a piece without rows, so all pieces of a block that has any are there
    blocks = rows.select("_k", "_block").distinct().select("_k", "_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit((span - 1) // piece).cast("long"))).alias("_piece"))
    sums = blocks.join(pieces, ["_k", "_block", "_piece"], "left").withColumns(
        {
            "_ahead": F.coalesce(F.sum("_own").over(block.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
            "_total": F.sum("_own").over(Window.partitionBy("_k", "_block")),
        }
    ).select("_k", "_block", "_piece", "_ahead", "_total")
    known = ran.join(sums, ["_k", "_block", "_piece"], "left")
    held = F.coalesce(F.col("_ahead"), F.lit(0)) + F.col("_run")
    began = known.where(F.col("_for").isNotNull()).select("_k", F.col("_for").alias("us"), (F.coalesce("_total", F.lit(0)) - held).alias("_tail"))
    own = known.where(F.col("_for").isNull()).select("_k", "us", "requests", held.alias("_held"))
    # the instant before: in the same piece, or the last one of the piece before, which may end the block before
    lagged = rows.withColumn("_before", before)
    per_block = (span - 1) // piece + 1
    after = pieces.select(
        "_k",
        F.when(F.col("_piece") + 1 < per_block, F.col("_block")).otherwise(F.col("_block") + 1).alias("_block"),
        F.when(F.col("_piece") + 1 < per_block, F.col("_piece") + 1).otherwise(0).cast("long").alias("_piece"),
        F.col("_last").alias("_past"),
    )
    gaps = lagged.join(after, ["_k", "_block", "_piece"], "left").select("_k", "us", (F.col("us") - F.coalesce("_before", "_past")).alias("_gap"))
    counted = own.join(began, ["_k", "us"]).join(gaps, ["_k", "us"]).select(
        "_k.*", "us", "requests", (F.col("_held") + F.col("_tail")).alias("in_window"), "_gap"
    )
    per_minute = scores.weight_of(key, {c: float(m) for c, (_, m) in table.items()}, float("inf"))
    spacing = scores.weight_of(key, {c: 1e6 / rps for c, (rps, _) in table.items()}, 0.0)
    too_close = F.coalesce(F.col("_gap") < spacing, F.lit(False)) | ((F.col("requests") > 1) & (spacing > 0))
    return counted.select(
        key,
        F.timestamp_micros("us").alias("at"),
        "requests",
        "in_window",
        (F.col("in_window") > per_minute).alias("over_limit"),
        too_close.alias("too_close"),
    )


def fixed_limits(log: DataFrame, key: str, at: str, limits: dict[int, int] | None = None) -> DataFrame:
    """Per key and fixed span (minute, hour, day): requests, and how many were over.

    The finest span is counted once; coarser spans add those counts up.
    """
    table = limits or K.REQUEST_LIMITS
    spans = sorted(table)
    second = F.floor(_micros(at) / 1_000_000)
    finest = log.groupBy(key, (F.floor(second / spans[0]) * spans[0]).alias("start")).agg(
        F.count(F.lit(1)).alias("requests")
    )
    levels = F.array(
        *[
            F.struct(
                F.lit(s).cast("bigint").alias("span"),
                (F.floor(F.col("start") / s) * s).cast("bigint").alias("start"),
                F.lit(table[s]).cast("bigint").alias("limit"),
            )
            for s in spans
        ]
    )
    return (
        finest.select(key, "requests", F.explode(levels).alias("s"))
        .groupBy(key, "s.span", "s.start", "s.limit")
        .agg(F.sum("requests").alias("requests"))
        .withColumn("over", F.greatest(F.col("requests") - F.col("limit"), F.lit(0)))
    )


def greedy_spans(ticks: DataFrame, keys: list[str], tick: str, weight: str, width: Column | int) -> DataFrame:
    """Spans that open at the first tick, last ``width`` and open again at the next tick.

    keys, opened, weight.  Ticks are whole numbers (seconds, say), one row per key and
    tick, so a key has at most one row per unit of time.  ``width`` may be a column
    that is constant per key.

    A pause of at least the width always ends a span, so the ticks between two such pauses
    form an island of its own.  Where a key never pauses, each span depends on the one
    before: every tick gets the next one a width later, found inside blocks of one width,
    and those that are reached from an island's first tick are found by doubling the
    steps, in as many rounds as the longest way has binary digits.  No step holds the
    ticks of a key, only those of a block.  Finding the number of rounds runs a job.
    """
    w = (width if isinstance(width, Column) else F.lit(width)).cast("bigint")
    names, keys = keys, ["_k"]  # as one struct, in which null equals null
    own = ticks.select(F.struct(*names).alias("_k"), F.col(tick).cast("bigint").alias("_t"), F.col(weight).cast("bigint").alias("_n"), w.alias("_w"))
    own = own.withColumn("_block", F.floor(F.col("_t") / F.col("_w")))
    block = Window.partitionBy(*keys, "_block")
    # the tick before stands in the same block or is the last of the block before; farther back is a pause
    edges = own.groupBy(*keys, "_block").agg(F.min("_t").alias("_first"), F.max("_t").alias("_last"))
    past = edges.select(*keys, (F.col("_block") + 1).alias("_block"), F.col("_last").alias("_past"))
    near = own.join(past, [*keys, "_block"], "left")
    before = F.coalesce(F.lag("_t").over(block.orderBy("_t")), F.col("_past"))
    near = near.withColumn("_opens", F.coalesce(F.col("_t") - before >= F.col("_w"), F.lit(True)))

    # a width later lies in the next block: the first tick from there on is in it, or the first of the one after
    marks = near.select(*keys, (F.col("_block") + 1).alias("_block"), (F.col("_t") + F.col("_w")).alias("_at"), F.col("_t").alias("_from"))
    both = marks.unionByName(near.select(*keys, "_block", F.col("_t").alias("_at"), F.lit(None).cast("bigint").alias("_from")))
    ahead = block.orderBy("_at").rangeBetween(Window.currentRow, Window.unboundedFollowing)
    found = both.withColumn("_next", F.min(F.when(F.col("_from").isNull(), F.col("_at"))).over(ahead)).where(F.col("_from").isNotNull())
    after = edges.select(*keys, (F.col("_block") - 1).alias("_block"), F.col("_first").alias("_after"))
    found = found.join(after, [*keys, "_block"], "left").select(*keys, F.col("_from").alias("_t"), F.coalesce("_next", "_after").alias("_next"))

    steps = written(near.select(*keys, "_t", "_n", "_w", "_opens").join(found, [*keys, "_t"]), "steps")
    # the next tick may open an island itself; then the way ends here
    opens = steps.where("_opens").select(*keys, F.col("_t").alias("_next"), F.lit(True).alias("_island"))
    ways = steps.join(opens, [*keys, "_next"], "left").where(F.col("_next").isNotNull() & F.col("_island").isNull()).select(*keys, "_t", "_next")
    reached = written(steps.where("_opens").select(*keys, "_t"), "reached")
    ways = written(ways, "ways")
    while ways.take(1):
        further = reached.join(ways, [*keys, "_t"]).select(*keys, F.col("_next").alias("_t"))
        reached = written(reached.unionByName(further).distinct(), "reached")
        second = ways.select(*keys, F.col("_t").alias("_next"), F.col("_next").alias("_far"))
        ways = written(ways.join(second, [*keys, "_next"]).select(*keys, "_t", F.col("_far").alias("_next")), "ways")

    # a tick counts in the span that is open: opened in its own block or the one before
    starts = reached.join(steps.select(*keys, "_t", "_w"), [*keys, "_t"]).select(*keys, F.floor(F.col("_t") / F.col("_w")).alias("_block"), F.col("_t").alias("_start"))
    placed = starts.select(*keys, F.explode(F.array(F.col("_block"), F.col("_block") + 1)).alias("_block"), F.col("_start").alias("_at"), F.col("_start"), F.lit(None).cast("bigint").alias("_n"))
    rows = steps.select(*keys, F.floor(F.col("_t") / F.col("_w")).alias("_block"), F.col("_t").alias("_at"), F.lit(None).cast("bigint").alias("_start"), "_n")
    upto = block.orderBy("_at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    counted = placed.unionByName(rows).withColumn("opened", F.max("_start").over(upto)).where(F.col("_n").isNotNull())
    return counted.groupBy(*keys, "opened").agg(F.sum("_n").alias(weight)).select("_k.*", "opened", weight)


def burst_limits(log: DataFrame, key: str, at: str, seconds: int = K.BURST_SECONDS, limit: int = K.BURST_LIMIT) -> DataFrame:
    """Per key the bursts (from their first request) and how many requests were over."""
    ticks = log.groupBy(key, F.floor(_micros(at) / 1_000_000).alias("second")).agg(
        F.count(F.lit(1)).alias("requests")
    )
    return greedy_spans(ticks, [key], "second", "requests", seconds).withColumn(
        "over", F.greatest(F.col("requests") - limit, F.lit(0))
    )


def rule_breaches(ticks: DataFrame, rules: dict[str, tuple[str, str, int]], at: str = "tick") -> DataFrame:
    """rule, severity, minutes, at, breached: every rule's condition at every tick.

    Conditions are SQL expressions over the columns of a metrics row; Spark resolves them,
    so one that names an unknown column raises.
    """
    rows = [
        F.struct(
            F.lit(name).alias("rule"),
            F.lit(severity).alias("severity"),
            F.lit(minutes).cast("bigint").alias("minutes"),
            F.coalesce(F.expr(condition), F.lit(False)).alias("breached"),
        )
        for name, (condition, severity, minutes) in rules.items()
    ]
    return ticks.select(F.col(at), F.explode(F.array(*rows)).alias("r")).select("r.*", at)


def alert_cooldown(breaches: DataFrame, at: str = "tick") -> DataFrame:
    """Alerts that fire: a breach fires only when the rule last fired its cooldown ago.

    Ticks are whole seconds; ``suppressed`` counts the breaches held back by each alert.
    """
    ticks = (
        breaches.where("breached")
        .groupBy("rule", "severity", "minutes", F.floor(_micros(at) / 1_000_000).alias("second"))
        .agg(F.lit(1).alias("n"))
    )
    fired = greedy_spans(ticks, ["rule", "severity", "minutes"], "second", "n", F.col("minutes") * 60)
    return fired.select(
        "rule",
        "severity",
        F.timestamp_seconds("opened").alias("fired_at"),
        (F.col("n") - 1).alias("suppressed"),
    )


def sustained(breaches: DataFrame, at: str = "tick") -> DataFrame:
    """Stretches of consecutive breached ticks that lasted at least the rule's minutes.

    Rows are evaluation ticks, one per rule and tick.
    """
    order = Window.partitionBy("rule").orderBy(at)
    change = F.col("breached") & ~F.coalesce(F.lag("breached").over(order), F.lit(False))
    islands = breaches.withColumn(
        "_island", F.sum(F.when(change, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    ).where("breached")
    spans = islands.groupBy("rule", "severity", "minutes", "_island").agg(
        F.min(at).alias("since"), F.max(at).alias("until"), F.count(F.lit(1)).alias("ticks")
    )
    lasted = (_micros("until") - _micros("since")) / F.lit(60_000_000)
    return spans.withColumn("lasted_minutes", lasted).where(
        F.col("lasted_minutes") >= F.col("minutes")
    ).drop("_island")


def rate_per_window(events: DataFrame, at: str, minutes: int = 5, *by: str) -> DataFrame:
    """Events per window and per second, for every window that has any."""
    return (
        events.groupBy(F.window(F.col(at), f"{minutes} minutes").alias("w"), *by)
        .agg(F.count(F.lit(1)).alias("increase"))
        .select(
            *by,
            F.col("w.start").alias("window_start"),
            "increase",
            (F.col("increase") / F.lit(minutes * 60.0)).alias("per_second"),
        )
    )


def counter_increase(samples: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """Increase between successive samples of a counter; a fall counts as a restart at 0."""
    order = Window.partitionBy(key).orderBy(at)
    before = F.lag(value).over(order)
    step = F.when(before.isNull(), None).when(F.col(value) < before, F.col(value)).otherwise(F.col(value) - before)
    return samples.withColumn("increase", step)


def period_change(series: DataFrame, key: str, period: str, value: str) -> DataFrame:
    """Change of a figure against the previous period, with its direction.

    ``series`` is an aggregated figure: one row per key and period.
    """
    order = Window.partitionBy(key).orderBy(period)
    change = F.col(value) - F.lag(value).over(order)
    trend = F.when(change > 0, "up").when(change < 0, "down").when(change == 0, "flat")
    return series.withColumns({"change": change, "trend": trend})
