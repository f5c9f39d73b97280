"""Each stream against its batch form, and the rules only a stream has."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from clearroll import streaming as S
from clearroll.operators import windows
from clearroll.streaming.ingest import retry_stream


def files_of(spark, tmp_path, *parts, schema):
    """A stream that gets one file per micro-batch, in order."""
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    typed = spark.createDataFrame([], schema).schema
    return (
        spark.readStream.schema(typed).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True)
        .option("latestFirst", False).parquet(str(tmp_path / "in"))
    )


def at(minute, second=0):
    return 60 * minute + second


SCHEMA = "k string, s bigint"


def timed(df):
    return df.select("k", F.timestamp_seconds("s").alias("at"))


def test_rate_equals_batch_and_drops_late_rows(spark, tmp_path):
    first = [("a", at(0, 5)), ("a", at(0, 50)), ("b", at(1))]
    second = [("a", at(60)), ("a", at(61))]
    third = [("a", at(62))]
    late = [("a", at(0, 30)), ("a", at(120))]
    stream = files_of(spark, tmp_path, first, second, third, late, schema=SCHEMA)
    got = S.drain(S.validation_rate_stream(timed(stream), "at", "1 minute", by=["k"]), folder=str(tmp_path / "out"))
    rows = {(r.k, r.window_start.minute, r.window_start.hour): r.n for r in got.collect()}
    batch = S.validation_rate_stream(timed(spark.createDataFrame(first + second + third, SCHEMA)), "at", "1 minute", by=["k"])
    assert rows == {(r.k, r.window_start.minute, r.window_start.hour): r.n for r in batch.collect()}
    assert rows[("a", 0, 0)] == 2


def test_unique_requests(spark, tmp_path):
    stream = files_of(spark, tmp_path, [("a", at(0)), ("a", at(1)), ("b", at(2))], [("a", at(3)), ("c", at(4))], schema=SCHEMA)
    got = S.drain(S.unique_requests(timed(stream), "k", "at", "1 hour"), folder=str(tmp_path / "out"))
    assert sorted(r.k for r in got.collect()) == ["a", "b", "c"]


def test_failed_requests_may_retry(spark, tmp_path):
    schema = "k string, s bigint, status string"
    first = [("a", 1, "failed"), ("b", 1, "completed"), ("c", 1, "completed")]
    second = [("a", 10, "completed"), ("a", 20, "completed"), ("b", 10, "completed"), ("c", 200, "failed")]
    later = [("z", 1000, "completed"), ("a", 20, "failed")]  # closes what was before; the second is too late to count
    stream = files_of(spark, tmp_path, first, second, later, schema=schema)
    keyed = stream.select("k", F.timestamp_seconds("s").alias("at"), "status")
    got = S.drain(S.retryable_requests(keyed, "k", "at", ttl_seconds=100, late="0 seconds", block="1 second"), folder=str(tmp_path / "out"))
    assert sorted((r.k, int(r.at.timestamp())) for r in got.collect()) == [("a", 1), ("a", 10), ("b", 1), ("c", 1), ("c", 200)]


def greedy(rows, ttl):
    """Requests of one key let through, by time."""
    out, expires, outcome = [], None, None
    for s, status in sorted(rows):
        if expires is None or s > expires or outcome == "failed":
            out.append(s)
            expires, outcome = s + ttl, status
    return out


def test_a_busy_key_over_many_files(spark, tmp_path):
    """200,000 requests of one key, in any order inside a file, in pieces that no frame holds whole."""
    n, files = 200_000, 8
    status = F.when(F.hash("id") % 7 == 0, "failed").otherwise("completed")
    rows = spark.range(n).select(F.lit("k").alias("k"), (F.col("id") + 7200).alias("s"), status.alias("status"))
    for i in range(files):
        own = rows.where((F.col("s") >= 7200 + i * n // files) & (F.col("s") < 7200 + (i + 1) * n // files))
        own.orderBy(F.hash("s")).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    keyed = stream.select("k", F.timestamp_seconds("s").alias("at"), "status")
    got = S.drain(S.retryable_requests(keyed, "k", "at", ttl_seconds=500, block="2 hours"), folder=str(tmp_path / "out"))
    want = greedy([(r.s, r.status) for r in rows.collect()], 500)
    closed = (7200 + n - 1 - 600) // 7200 * 7200
    assert sorted(int(r["at"].timestamp()) for r in got.select("at").collect()) == [s for s in want if s < closed]


def test_state_ends_with_what_it_holds_back():
    from clearroll.streaming.ordered import INSTANT, InOrder

    class Value(dict):
        exists = lambda self: "v" in self
        get = lambda self: self["v"]
        update = lambda self, v: self.__setitem__("v", v)
        clear = lambda self: self.pop("v", None)

    class Map(dict):
        containsKey = dict.__contains__
        getValue = dict.__getitem__
        updateValue = dict.__setitem__
        removeKey = dict.__delitem__

    class Handle:
        def __init__(self):
            self.timers, self.value, self.map = set(), Value(), Map()

        getValueState = lambda self, *a: self.value
        getMapState = lambda self, *a: self.map
        registerTimer = lambda self, ms: self.timers.add(ms)

    class Info:
        def __init__(self, ms):
            self.getExpiryTimeInMs = lambda: ms

    import pandas as pd

    handle = Handle()
    work = InOrder(lambda last, rows: ((None, int(rows[INSTANT].iloc[0]) + 5_000_000), [True] + [False] * (len(rows) - 1)), ["x", INSTANT], ["x"], 2_000_000, "")
    work.init(handle)
    chunks = [pd.DataFrame({"x": [3, 1, 2], INSTANT: [1_500_000, 1_000_000, 1_000_000]}), pd.DataFrame({"x": [0], INSTANT: [1_900_000]})]
    assert list(work.handleInputRows(("k",), iter(chunks), None)) == []
    assert handle.timers == {2000} and len(handle.map) == 1
    out = list(work.handleExpiredTimer(("k",), None, Info(2000)))
    assert [tuple(r) for r in out[0].to_numpy()] == [(1, 1_000_000)] and not handle.map and handle.value.exists()
    assert handle.timers == {2000, 8000}
    assert list(work.handleExpiredTimer(("k",), None, Info(8000))) == [] and not handle.value.exists()


class Store(dict):
    """The calls of a state variable that :class:`InOrder` makes, counted."""

    calls = 0

    def _of(name):
        def call(self, *args):
            Store.calls += 1
            return {
                "containsKey": lambda k: k in self, "getValue": lambda k: dict.get(self, k), "updateValue": lambda k, v: self.__setitem__(k, v),
                "removeKey": lambda k: self.pop(k, None), "exists": lambda: "v" in self, "get": lambda: self["v"],
                "update": lambda v: self.__setitem__("v", v), "clear": lambda: self.pop("v", None), "registerTimer": lambda ms: self.__setitem__(ms, ms),
                "keys": lambda: list(dict.keys(self)),
            }[name](*args)

        return call

    for name in ("containsKey", "getValue", "updateValue", "removeKey", "exists", "get", "update", "clear", "registerTimer", "keys"):
        locals()[name] = _of(name)


def in_order_by_hand(parts, block, ttl):
    """Instants that an :class:`InOrder` lets through when the timers of a part come after it, and its calls to the store."""
    import pandas as pd

    from clearroll.streaming.ordered import INSTANT, InOrder

    value, held, timers = Store(), Store(), Store()

    class Handle:
        getValueState = lambda self, *a: value
        getMapState = lambda self, *a: held
        registerTimer = timers.registerTimer

    class At:
        def __init__(self, ms):
            self.getExpiryTimeInMs = self.getCurrentWatermarkInMs = lambda: ms

    def decide(last, rows):
        until, accepted = last[1] if last else None, []
        for when in rows[INSTANT].tolist():
            accepted.append(until is None or when > until)
            until = when + ttl if accepted[-1] else until
        return (None, until), accepted

    work, out, Store.calls = InOrder(decide, ["x", INSTANT], ["x"], block, ""), [], 0
    work.init(Handle())
    for chunks, watermark in parts:
        frames = (pd.DataFrame({"x": 0, INSTANT: c}) for c in chunks)
        assert list(work.handleInputRows(("k",), frames, At(watermark))) == []
        while any(ms < watermark for ms in dict.keys(timers)):
            ms = min(dict.keys(timers))
            timers.pop(ms)
            out += [x for f in work.handleExpiredTimer(("k",), At(watermark), At(ms)) for x in f[INSTANT].tolist()]
    return out, Store.calls, dict(held), dict(value)


def test_a_key_with_few_rows_costs_few_calls():
    """Fifteen rows over a month: some calls for the key, not for every row."""
    day = 86_400_000_000
    got, calls, held, value = in_order_by_hand([([[day * (2 * i + 1) for i in range(15)]], 100 * day // 1000)], 600_000_000, day)
    assert got == [day * (2 * i + 1) for i in range(15)] and calls <= 20 and not held and not value


@pytest.mark.parametrize("seed", range(3))
def test_piles_lose_nothing(seed):
    """Many rows in any order, over several batches, some of them before what is held already."""
    import random

    from clearroll.streaming.ordered import PILE

    rand = random.Random(seed)
    block, ttl, n = 1_000_000, 7_500, 4 * PILE
    rows = [rand.randrange(5_000_000, 45_000_000) for _ in range(n)]
    early = [w for w in rows if w < 30_000_000]
    parts = [([early[: n // 4][::-1], early[n // 4 :]], 4_000), ([[w for w in rows if w >= 30_000_000]], 17_500), ([[45_500_000]], 60_000)]
    want, until = [], -1
    for when in sorted({*rows, 45_500_000}):
        if when > until:
            want.append(when)
            until = when + ttl
    got, _, held, value = in_order_by_hand(parts, block, ttl)
    assert got == want and not held and not value


def test_alerts_keep_their_cooldown_across_batches(spark, tmp_path):
    schema = "rule string, severity string, minutes bigint, breached boolean, s bigint"
    parts = [[("r", "warning", 8, True, at(m))] for m in range(5, 26)]
    stream = files_of(spark, tmp_path, *parts[:3], [r for p in parts[3:] for r in p], schema=schema)
    ticks = lambda df: df.withColumn("tick", F.timestamp_seconds("s")).drop("s")
    got = S.drain(S.alert_stream(ticks(stream)), folder=str(tmp_path / "out"))
    batch = windows.alert_cooldown(ticks(spark.createDataFrame([r for p in parts for r in p], schema)))
    assert sorted(r.fired_at for r in got.collect()) == sorted(r.fired_at for r in batch.collect())


def test_requests_without_a_time_count_for_nothing(spark, tmp_path):
    rows = [("a", 1, "completed"), ("a", None, "failed"), ("b", 2, "completed"), ("z", 1000, "completed")]
    stream = files_of(spark, tmp_path, rows, schema="k string, s bigint, status string")
    keyed = stream.select("k", F.timestamp_seconds("s").alias("at"), "status")
    got = S.drain(S.retryable_requests(keyed, "k", "at", late="0 seconds", block="1 second"), folder=str(tmp_path / "out"))
    assert sorted(r.k for r in got.collect()) == ["a", "b"]


def test_the_last_alert_fires_behind_a_closing_tick(spark, tmp_path):
    schema = "rule string, severity string, minutes bigint, breached boolean, tick timestamp"
    rows = [("r", "warning", 8, True, datetime(2024, 1, 1, 0, m)) for m in (1, 5, 9)] + [("q", "info", 1, False, datetime(2024, 1, 1, 0, 30))]
    ticks = spark.createDataFrame(rows, schema)
    ticks.write.parquet(str(tmp_path / "in"))
    S.closing_tick(ticks).write.mode("append").parquet(str(tmp_path / "in"))
    got = S.drain(S.alert_stream(spark.readStream.schema(ticks.schema).parquet(str(tmp_path / "in"))), folder=str(tmp_path / "out"))
    assert sorted((r.rule, r.fired_at.minute) for r in got.collect()) == [("r", 1), ("r", 9)]


def test_sessions(spark, tmp_path):
    stream = files_of(spark, tmp_path, [("a", at(0)), ("a", at(20)), ("a", at(60))], [("b", at(600))], schema=SCHEMA)
    got = S.drain(S.session_stream(timed(stream), "k", "at"), folder=str(tmp_path / "out"))
    assert sorted((r.k, r.events) for r in got.collect()) == [("a", 1), ("a", 2)]


def test_job_progress_in_update_mode(spark, tmp_path):
    schema = "job_id string, status string"
    stream = files_of(spark, tmp_path, [("j", "completed"), ("j", "failed")], [("j", "completed"), ("k", "running")], schema=schema)
    updates = S.drain(S.job_progress_stream(stream), "update", folder=str(tmp_path / "out"))
    assert updates.count() > 2
    got = {r.job_id: (r.total, r.completed, r.failed) for r in S.latest_updates(updates, ["job_id"]).collect()}
    assert got == {"j": (3, 2, 1), "k": (1, 0, 0)}


def test_arriving_files_are_validated_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    schema = "given_name string, family_name string, email string"
    where = {k: str(tmp_path / k) for k in ("out", "check")}

    def run():
        S.validate_arrivals(spark, str(tmp_path / "in"), schema, where["out"], where["check"]).awaitTermination()
        return spark.read.parquet(where["out"] + "/good").count(), spark.read.parquet(where["out"] + "/bad").count()

    (tmp_path / "in/a.csv").write_text("given_name,family_name,email\nAnn,Lee,a@b.co\nBob,,\n")
    assert run() == (1, 1)
    (tmp_path / "in/b.csv").write_text("given_name,family_name,email\nCy,Poe,\nDi,Roe,bad\n")
    assert run() == (2, 2)
    assert run() == (2, 2)


def test_retry_log(spark, tmp_path):
    schema = "task_id string, status string, attempt bigint"
    rows = [("a", "failed", 1), ("b", "failed", 3), ("c", "failed", 1), ("c", "completed", 2), ("d", "completed", 1)]
    assert [tuple(r) for r in S.retry_failed(spark.createDataFrame(rows, schema)).collect()] == [("a", 2)]
    stream = files_of(spark, tmp_path, [("a", "failed", 1)], [("a", "failed", 2), ("b", "failed", 1)], [("a", "failed", 3)], schema=schema)
    retry_stream(stream, str(tmp_path / "queue"), str(tmp_path / "check")).awaitTermination()
    queued = sorted((r.task_id, r.attempt) for r in spark.read.schema("task_id string, attempt bigint").option("recursiveFileLookup", True).parquet(str(tmp_path / "queue")).collect())
    assert queued == [("a", 2), ("a", 3), ("b", 2)]


@pytest.mark.parametrize("limit,expected", [(2, 1), (9, 0)])
def test_request_limit(spark, tmp_path, limit, expected):
    stream = files_of(spark, tmp_path, [("a", 0), ("a", 1), ("a", 2), ("b", 3)], [("z", at(300))], schema=SCHEMA)
    got = S.drain(S.request_limit_stream(timed(stream), "k", "at", limit, "60 seconds", "60 seconds"), folder=str(tmp_path / "out"))
    assert got.count() == expected
