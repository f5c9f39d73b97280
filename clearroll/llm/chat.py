"""Chat formatting in budgeted windows: prefix sums choose turn-aligned spans, history is repeated, loss is masked.

DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Tokens of a window, and of the history repeated in front of its span.
BUDGET, HISTORY = 1024, 192
#: Tokens a turn costs besides its text.
OVERHEAD = 4
#: Turn numbers per block; prefix sums run inside blocks, and over the blocks' sums.
BLOCK = 64

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
TOKEN = r"[A-Za-z0-9_]+|[^A-Za-z0-9_ \t-\r]"
#: What follows the first character of a control string: this template's own, and those of common others.
REST = r"\|turn\|>|\|text\|>|\|end\|>|\|im_start\|>|\|im_end\|>|s>|/s>|<SYS>>|</SYS>>|INST\]|/INST\]"


def escaped(text: Column) -> Column:
    """One backslash more after the first character of each control string, so none is left as it was."""
    return F.regexp_replace(text, rf"([<\[])(\\*)({REST})", r"$1$2\\$3")


def unescaped(text: Column) -> Column:
    """What :func:`escaped` was given."""
    return F.regexp_replace(text, rf"([<\[])(\\*)\\({REST})", "$1$2$3")


def tokens(text: Column) -> Column:
    return F.regexp_count(text, F.lit(TOKEN)) + OVERHEAD


def placed(turns: DataFrame) -> DataFrame:
    """Turns with ``n`` (place in their conversation), ``tok``, ``q`` (tokens before them) and ``lead`` (tokens of the leading system turn).

    A long conversation is many blocks: sums inside a block, and a running sum over the
    blocks, of which there is one row per ``BLOCK`` turns.
    """
    rows = turns.select(
        F.coalesce(F.col("conv_id").cast("string"), F.lit("none")).alias("k"),
        F.floor(F.coalesce(F.col("turn").cast("long"), F.lit(-1)) / BLOCK).alias("block"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).withColumn("tok", tokens(F.col("text")).cast("long"))
    inside = Window.partitionBy("k", "block").orderBy("turn", "role", "text")
    so_far = inside.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("n", F.row_number().over(inside)).withColumn("q", F.sum("tok").over(so_far) - F.col("tok"))
    lead = F.max(F.when((F.col("n") == 1) & (F.col("role") == "system"), F.col("tok")))
    sums = rows.groupBy("k", "block").agg(F.count("*").alias("rows"), F.sum("tok").alias("toks"), lead.alias("lead"))
    blocks = Window.partitionBy("k").orderBy("block")
    earlier = blocks.rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(
        "k", "block",
        F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("n0"),
        F.coalesce(F.sum("toks").over(earlier), F.lit(0)).alias("q0"),
        F.coalesce(F.first("lead").over(blocks), F.lit(0)).alias("lead"),
    )
    return rows.join(sums, ["k", "block"]).select(
        "k", (F.col("n") + F.col("n0")).alias("n"), "role", "text", "tok", (F.col("q") + F.col("q0")).alias("q"), "lead"
    )


def copies(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """``k, span, n, role, text, tok, new``: every turn in its own span, and again wherever it is repeated.

    Half of what the system turn and the history leave of the budget is the grid: turns
    that end in the same cell are a span, and a turn longer than a cell is one alone.  As
    no other turn is longer than a cell, the span fits two cells; only a single turn can
    exceed the budget, and is kept whole.
    """
    rows = placed(turns)
    system = (F.col("n") == 1) & (F.col("lead") > 0)
    grid = F.greatest(F.lit(1), F.floor((budget - history - F.col("lead")) / 2))
    cell = F.floor((F.col("q") + F.col("tok") - F.col("lead") - 1) / grid)
    rows = rows.withColumn("span", F.when(~system, cell * 2 + F.when(F.col("tok") > grid, 0).otherwise(1))).withColumn("bucket", F.floor(F.col("q") / history))
    spans = rows.where("span IS NOT NULL").groupBy("k", "span").agg(F.min("q").alias("at"), F.max("lead").alias("lead"))

    near = F.explode(F.sequence(F.greatest(F.lit(0), F.floor((F.col("at") - history) / history)), F.floor(F.col("at") / history)))
    starts = spans.select("k", near.alias("bucket"), "span", "at").groupBy("k", "bucket").agg(F.collect_list(F.struct("span", "at")).alias("starts"))
    kept = rows.join(starts, ["k", "bucket"], "left")
    own = F.struct(F.col("span"), F.lit(True).alias("new"))
    later = F.filter(F.coalesce("starts", F.array()), lambda s: (s["at"] > F.col("q")) & (s["at"] - history <= F.col("q")))
    repeated = F.transform(later, lambda s: F.struct(s["span"].alias("span"), F.lit(False).alias("new")))
    turned = kept.where("span IS NOT NULL").withColumn("_to", F.explode(F.concat(F.array(own), repeated)))
    turned = turned.select("k", "_to.span", "n", "role", "text", "tok", "_to.new")

    first = rows.where("span IS NULL").select("k", "n", "role", "text", "tok")
    led = first.join(spans, "k", "left").select(
        "k", F.coalesce("span", F.lit(0)).alias("span"), "n", "role", "text", "tok", F.coalesce(F.col("at") == F.col("lead"), F.lit(True)).alias("new")
    )
    return turned.unionByName(led)


def format_chats(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """``conv_id, span, text, loss, repeated, tokens``: the formatted windows of ``turns(conv_id, turn, role, text)``.

    A window is the conversation's leading system turn, the last whole turns before its span
    that fit ``history`` tokens, and the span.  ``loss`` lists ``(start, end)`` code points
    of the assistant texts of the span; the first ``repeated`` turns were targets elsewhere
    and are outside it.  Null texts and roles are empty, null turns come first, equal turn
    numbers are ordered by role and text, repeated rows are turns of their own, a null
    conv_id is a conversation.  An empty table gives no rows.
    """
    head = F.concat(F.lit(TURN), escaped(F.col("role")), F.lit(TEXT))
    body = escaped(F.col("text"))
    pieces = copies(turns, budget, history).select(
        "k", "span", "n", "tok", "new", F.concat(head, body, F.lit(END)).alias("piece"),
        F.length(head).alias("head"), F.length(body).alias("body"), (F.col("new") & (F.col("role") == "assistant")).alias("target"),
    )
    before = Window.partitionBy("k", "span").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0)).cast("int")
    start = F.when(F.col("target"), F.col("offset") + F.col("head"))
    pieces = pieces.withColumn("offset", offset).withColumn("start", start)
    gathered = pieces.groupBy("k", "span").agg(
        F.array_sort(F.collect_list(F.struct("n", "piece", "start", (F.col("start") + F.col("body")).alias("end")))).alias("t"),
        F.count(F.when(~F.col("new"), 1)).alias("repeated"),
        F.sum("tok").alias("tokens"),
    )
    loss = F.filter(F.transform("t", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))), lambda x: x["start"].isNotNull())
    return gathered.select(
        F.expr("try_cast(k AS BIGINT)").alias("conv_id"), "span", F.array_join("t.piece", "").alias("text"),
        loss.alias("loss"), F.col("repeated").cast("int").alias("repeated"), "tokens",
    )


def read_back(windows: DataFrame) -> DataFrame:
    """``conv_id, span, turns(role, text), losses`` parsed from formatted windows: the turns not repeated, and the texts under the mask."""
    parts = F.slice(F.split("text", r"<\|turn\|>", -1), F.col("repeated") + 2, F.lit(1 << 30))
    turn = lambda p: F.struct(
        unescaped(F.substring_index(p, TEXT, 1)).alias("role"),
        unescaped(F.substring_index(F.substring_index(p, TEXT, -1), END, 1)).alias("text"),
    )
    masked = F.transform("loss", lambda s: unescaped(F.substring(F.col("text"), s["start"] + 1, s["end"] - s["start"])))
    return windows.select("conv_id", "span", F.transform(parts, turn).alias("turns"), masked.alias("losses"), F.length("text").cast("long").alias("chars"))


def digests(windows: DataFrame) -> DataFrame:
    """Per conversation: its turns and its loss text as they read back, digested.

    A digest covers a whole conversation, so one conversation's text meets in one row here.
    """
    read = read_back(windows)
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    parts = read.select("conv_id", F.struct("span", F.size("turns").alias("n"), said.alias("said"), F.array_join("losses", "").alias("loss"), "chars").alias("w"))
    whole = parts.groupBy("conv_id").agg(F.array_sort(F.collect_list("w")).alias("w"))
    said, loss = F.array_join("w.said", ""), F.array_join("w.loss", "")
    add = lambda name: F.aggregate(F.col(name), F.lit(0).cast("long"), lambda a, x: a + x)
    return whole.select(
        "conv_id", add("w.n").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), add("w.chars").alias("formatted_chars"),
    )


_R = REST
SQL = rf"""
WITH raw AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
t AS (
  SELECT coalesce(CAST(conv_id AS VARCHAR), 'none') AS k, conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
    len(regexp_extract_all(coalesce(text, ''), '{TOKEN}')) + {OVERHEAD} AS tok FROM raw),
p AS (
  SELECT *, row_number() OVER w AS n, sum(tok) OVER w - tok AS q FROM t
  WINDOW w AS (PARTITION BY k ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING)),
l AS (SELECT *, coalesce(max(CASE WHEN n = 1 AND role = 'system' THEN tok END) OVER (PARTITION BY k), 0) AS lead FROM p),
g AS (SELECT *, n = 1 AND role = 'system' AS sys, greatest(1, floor(({BUDGET} - {HISTORY} - lead) / 2)) AS grid FROM l),
s AS (
  SELECT *, length('{TURN}{TEXT}{END}') + length(regexp_replace(role, '([<\[])(\\*)({_R})', '\1\2\\\3', 'g'))
      + length(regexp_replace(text, '([<\[])(\\*)({_R})', '\1\2\\\3', 'g')) AS chars,
    CASE WHEN NOT sys THEN floor((q + tok - lead - 1) / grid) * 2 + CASE WHEN tok > grid THEN 0 ELSE 1 END END AS span FROM g),
starts AS (SELECT k, span, min(q) AS start FROM s WHERE NOT sys GROUP BY ALL),
c AS (
  SELECT k, chars FROM s
  UNION ALL SELECT s.k, s.chars FROM s JOIN starts a ON s.k = a.k AND NOT s.sys AND a.start > s.q AND a.start - {HISTORY} <= s.q
  UNION ALL SELECT s.k, s.chars FROM s JOIN starts a ON s.k = a.k AND s.sys AND a.start > s.lead),
f AS (SELECT k, CAST(sum(chars) AS BIGINT) AS formatted_chars FROM c GROUP BY k)
SELECT any_value(conv_id) AS conv_id, CAST(count(*) AS BIGINT) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '')) AS loss_sha256,
  any_value(formatted_chars) AS formatted_chars
FROM s JOIN f USING (k) GROUP BY k"""
