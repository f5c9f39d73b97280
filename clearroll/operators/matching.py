"""Duplicates, best address candidates and the crawl-permission gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores, text
from .lookup import attach


def duplicate_groups(df: DataFrame, key: str = "npi_number", tie: str = "provider_id") -> DataFrame:
    """Keys held by more than one record: how many, and the record to keep."""
    return (
        df.where(text.is_present(key))
        .groupBy(key)
        .agg(F.count(F.lit(1)).alias("copies"), F.min(tie).alias("keep"))
        .where(F.col("copies") > 1)
    )


def mark_duplicates(df: DataFrame, key: str = "npi_number", tie: str = "provider_id", **skew) -> DataFrame:
    """Every record with the number of records that share its key, and the one to keep."""
    found = attach(df, duplicate_groups(df, key, tie), F.col(key), F.col(key), "_dup", tie, **skew)
    return found.withColumns(
        {
            "copies": F.coalesce(F.col("_dup.copies"), F.lit(1)),
            "keep": F.coalesce(F.col("_dup.keep"), F.col(tie)),
        }
    ).drop("_dup")


def _segments(size: Column, pieces: Column, i: Column) -> tuple[Column, Column]:
    """Start (from 0) and length of piece i when ``size`` characters are cut evenly."""
    base = F.floor(size / pieces)
    short_ones = pieces - (size - base * pieces)
    extra = F.greatest(i - short_ones, F.lit(0))
    return i * base + extra, base + F.when(i >= short_ones, 1).otherwise(0)


def _signature(edits: Column, size: Column, i: Column, piece: Column) -> Column:
    return F.concat_ws(":", edits.cast("string"), size.cast("string"), i.cast("string"), piece)


def near_names(df: DataFrame, threshold: float = 0.85) -> DataFrame:
    """Distinct names with a near-same name in the same state and with the same initials.

    state, name, records, near_names, nearest, similarity.  Records with one and the
    same name are counted together first, so what is compared are names, not records,
    and a name that a third of all records have is one row.

    Two names are near when they differ by at most e edits, e = (1 - threshold) x the
    longer length.  Cut the shorter one into e + 1 pieces: an edit can spoil only one
    piece, so one piece at least stands unchanged in the longer name, moved by at most e
    places.  Names meet on such a piece (an equi-join on state, initials, piece, place and
    length), never all with all; only pairs that meet are measured.  Per name its best
    partner and the number of partners leave the aggregate.
    """
    slack = 1 - threshold
    name = F.lower(text.collapse_spaces(text.full_name()))
    names = (
        df.select(
            F.col("address_state").alias("state"),
            name.alias("name"),
            F.lower(F.concat(F.left("given_name", F.lit(1)), F.left("family_name", F.lit(1)))).alias("initials"),
        )
        .where(text.is_present("name") & F.col("state").isNotNull())
        .groupBy("state", "initials", "name")
        .agg(F.count(F.lit(1)).alias("records"))
        .withColumn("size", F.length("name"))
    )
    size = F.col("size")

    def edits_of(n: Column) -> Column:
        return F.floor(n * F.lit(slack) + F.lit(1e-9)).cast("int")

    def cut(e: Column) -> Column:
        def piece(i: Column) -> Column:
            start, length = _segments(size, e + 1, i)
            return _signature(e, size, i, F.substr("name", start + 1, length))

        return F.transform(F.sequence(F.lit(0), e), piece)

    longest = F.floor(size / F.lit(threshold) + F.lit(1e-9)).cast("int")
    every_e = F.sequence(F.greatest(edits_of(size), F.lit(1)), F.greatest(edits_of(longest), F.lit(1)))
    cut_up = names.where(edits_of(longest) >= 1).select(
        "state", "initials", F.col("name").alias("near"), F.col("records").alias("near_records"),
        F.explode(F.array_distinct(F.flatten(F.transform(every_e, cut)))).alias("signature"),
    )

    e = edits_of(size)

    def windows_of(shorter: Column) -> Column:
        def of_piece(i: Column) -> Column:
            start, length = _segments(shorter, e + 1, i)
            places = F.filter(
                F.sequence(-e, e), lambda move: (start + move >= 0) & (start + move + length <= size)
            )
            return F.transform(
                places, lambda move: _signature(e, shorter, i, F.substr("name", start + move + 1, length))
            )

        return F.flatten(F.transform(F.sequence(F.lit(0), e), of_piece))

    probes = names.where(e >= 1).select(
        "state", "initials", "name", "records",
        F.explode(F.array_distinct(F.flatten(F.transform(F.sequence(size - e, size), windows_of)))).alias("signature"),
    )
    met = (
        probes.join(cut_up, ["state", "initials", "signature"])
        .where(F.col("name") != F.col("near"))
        .select("state", "name", "records", "near", "near_records")
        .distinct()
        .withColumn("similarity", scores.stable(text.name_similarity("name", "near")))
        .where(F.col("similarity") >= threshold)
    )
    both_ways = met.select(
        "state",
        "similarity",
        F.explode(
            F.array(
                F.struct(F.col("name").alias("name"), F.col("records").alias("records"), F.col("near").alias("near")),
                F.struct(F.col("near").alias("name"), F.col("near_records").alias("records"), F.col("name").alias("near")),
            )
        ).alias("p"),
    ).select("state", "similarity", "p.*").distinct()
    return both_ways.groupBy("state", "name", "records").agg(
        F.count(F.lit(1)).alias("near_names"),
        F.min(F.struct((-F.col("similarity")).alias("s"), F.col("near").alias("n"))).alias("best"),
    ).select(
        "state", "name", "records", "near_names", F.col("best.n").alias("nearest"),
        (-F.col("best.s")).alias("similarity"),
    )


#: Candidates of a block that may hold a word; a word that more hold is met in groups of equal addresses only.
FEW = 20


def best_address_match(
    asked: DataFrame, candidates: DataFrame, block: str, suggestions: int = 5, query: str = "provider_id"
) -> DataFrame:
    """Per query the candidate with the highest match confidence, and the next ones.

    ``asked`` has the query id, ``address`` and the block column; ``candidates`` the
    block column, ``formatted_address``, ``place_id`` and ``types``.  Equal addresses are
    asked once, however many records share one, and the answer is looked up by address.
    Suggestions are listed only below a confidence of .8.

    Confidence is that of the types plus a share of common words, so not all pairs of a block
    are looked at.  An address meets the candidates it shares a word with that at most
    :data:`FEW` hold.  By its other words it differs from few addresses of its block: those with the
    same ones and as many words are answered together, by the first candidates of every
    base confidence and set of such words.  A candidate that is not among these comes behind
    all of them for each address of the group, unless it shares a rare word and is met by that.
    """
    most = suggestions + 1
    question = F.concat_ws("\x01", block, "address")
    questions = asked.where(F.col(block).isNotNull() & F.col("address").isNotNull()).withColumn("_q", question)
    distinct = questions.select("_q", "address", block).distinct()
    sought = distinct.select(
        "_q", "address", block, F.size(text.words("address")).alias("_n"), F.explode_outer(text.words("address")).alias("_word")
    )
    known = candidates.where(F.col(block).isNotNull()).distinct().select(block, F.struct(*candidates.columns).alias("_c"))
    base = scores.address_match_confidence(F.col("_c.types"), F.lit(""), F.lit(""))
    held = known.select(block, "_c", F.explode_outer(text.words("_c.formatted_address")).alias("_word"))
    of_word = Window.partitionBy(block, "_word").orderBy("_c")
    index = (
        held.join(sought.select(block, "_word").distinct(), [block, "_word"], "left_semi")
        .withColumn("_at", F.row_number().over(of_word))
        .where(F.col("_at") <= FEW + 1)
        .groupBy(block, "_word")
        .agg(F.collect_list("_c").alias("_near"))
        .withColumn("_often", F.size("_near") > FEW)
    )

    def often() -> Column:
        return F.sort_array(F.collect_set(F.when(F.col("_often"), F.col("_word")))).alias("_often")

    met = sought.join(index, [block, "_word"], "left").groupBy("_q", "address", block, "_n").agg(
        often(), F.flatten(F.collect_list(F.when(~F.col("_often"), F.col("_near")))).alias("_near")
    )
    same = Window.partitionBy(block, "_base", "_held").orderBy("_c.formatted_address", "_c.place_id")
    firsts = (
        held.join(index.where("_often").select(block, "_word", "_often"), [block, "_word"], "left")
        .groupBy(block, "_c")
        .agg(often())
        .select(block, "_c", base.alias("_base"), F.col("_often").alias("_held"))
        .withColumn("_at", F.row_number().over(same))
        .where(F.col("_at") <= most)
        .groupBy(block, "_base", "_held")
        .agg(F.collect_list("_c").alias("_first"))
    )
    share = F.when(F.col("_n") > 0, F.size(F.array_intersect("_often", "_held")) / F.col("_n")).otherwise(F.lit(0.0))
    likely = scores.stable(F.least(F.lit(1.0), F.col("_base") + 0.2 * share))
    group = Window.partitionBy(block, "_n", "_often").orderBy(F.desc("_likely"), "_c.formatted_address", "_c.place_id")
    general = (
        met.select(block, "_n", "_often").distinct()
        .join(firsts, block)
        .withColumn("_likely", likely)
        .withColumn("_c", F.explode("_first"))
        .withColumn("_at", F.row_number().over(group))
        .where(F.col("_at") <= most)
        .groupBy(block, "_n", "_often")
        .agg(F.collect_list("_c").alias("_first"))
    )

    def judged(c: Column) -> Column:
        confidence = scores.stable(scores.address_match_confidence(c["types"], c["formatted_address"], F.col("address")))
        return F.struct(
            (-confidence).alias("minus"), c["formatted_address"].alias("formatted_address"), c["place_id"].alias("place_id"),
            scores.address_type_ok(c["types"]).alias("valid"),
        )

    def entry(x: Column, i: Column) -> Column:
        return F.struct(
            (i + 1).alias("rank"), x["formatted_address"].alias("formatted_address"), x["place_id"].alias("place_id"),
            (-x["minus"]).alias("confidence"), x["valid"].alias("valid"),
        )

    met_or_first = F.array_distinct(F.concat("_near", "_first"))
    grouped = met.join(general, [block, "_n", "_often"]).select(
        "_q", F.transform(F.slice(F.sort_array(F.transform(met_or_first, judged)), 1, most), entry).alias("all")
    )
    answered = attach(questions, grouped, F.col("_q"), F.col("_q"), "_a", query)
    every = F.col("_a.all")
    best = F.try_element_at(every, F.lit(1))
    rest = F.slice(every, 2, suggestions)
    return answered.where(F.col("_a").isNotNull()).select(
        query,
        best["formatted_address"].alias("formatted_address"),
        best["place_id"].alias("place_id"),
        best["valid"].alias("valid"),
        best["confidence"].alias("confidence"),
        F.when(best["confidence"] < 0.8, rest).otherwise(F.slice(every, 1, 0)).alias("suggestions"),
    )


def crawl_gate(pages: DataFrame, rules: DataFrame, agent: str = "*", **skew) -> DataFrame:
    """Pages with ``allowed`` and ``rule`` by the host's path rules.

    ``rules`` has host, path_prefix, allow.  The longest matching prefix decides, an
    allow wins a tie, and an unknown host or an unmatched path is allowed.  The rules of
    a host are one array (a robots file is small), looked up by host.
    """
    per_host = rules.groupBy("host").agg(
        F.sort_array(F.collect_set(F.struct("path_prefix", "allow"))).alias("list")
    )
    host = F.lower(F.parse_url("url", F.lit("HOST")))
    found = attach(
        pages.withColumn("host", host), per_host, F.col("host"), F.lower(F.col("host")), "_rules", "page_id", **skew
    )
    path = F.coalesce(F.nullif(F.parse_url("url", F.lit("PATH")), F.lit("")), F.lit("/"))
    matching = F.transform(
        F.filter(F.col("_rules.list"), lambda r: path.startswith(r["path_prefix"])),
        lambda r: F.struct(
            F.length(r["path_prefix"]).alias("size"), r["allow"].alias("allow"), r["path_prefix"].alias("rule")
        ),
    )
    best = F.array_max(matching)
    return found.withColumns(
        {"allowed": F.coalesce(best["allow"], F.lit(True)), "rule": best["rule"]}
    ).withColumn("status", F.when(F.col("allowed"), "ok").otherwise("warning")).drop("_rules")
