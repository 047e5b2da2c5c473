"""Readings scored against checked pages, and the leaderboard of systems."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkloom.functions import text as T

SYSTEM = ["engine", "model", "prompt_version", "variant"]


def join_lines(transcriptions: DataFrame) -> DataFrame:
    """One text per reading: its lines in order, nulls left out, repeated deliveries of a line once."""
    keys = ["page_id", *SYSTEM, "sample_no"]
    lines = F.array_sort(F.collect_set(F.struct("line_no", "text")))
    g = transcriptions.where("text IS NOT NULL").groupBy(*keys).agg(lines.alias("x"))
    return g.select(*keys, F.array_join(F.transform("x", lambda s: s["text"]), "\n").alias("hyp"))


def finals(letters: DataFrame) -> DataFrame:
    """The current texts as readings of a system of their own, whose model is where the text comes from (auto, reviewed,
    gold). Repeated deliveries count once; pages without a text are left out."""
    one = letters.where("text_final IS NOT NULL").select("page_id", F.col("text_source").alias("model"), F.col("text_final").alias("hyp")).distinct()
    return one.select("page_id", F.lit("final").alias("engine"), "model", F.lit("-").alias("prompt_version"), F.lit("-").alias("variant"), F.lit(0).alias("sample_no"), "hyp")


def score(readings: DataFrame, gold: DataFrame) -> DataFrame:
    """readings(page_id, ..., hyp) with gold_text, cer, wer and name_recall; pages without gold are left out.

    Equal texts for one page are measured once, so that a page read ten thousand times costs its different texts.
    """
    each = readings.select("page_id", "hyp").distinct().join(gold.select("page_id", "gold_text"), "page_id")
    r, h = T.normalise(F.col("gold_text")), T.normalise(F.col("hyp"))
    fr, fh = T.normalise(F.col("gold_text"), True, True), T.normalise(F.col("hyp"), True, True)
    each = each.select("page_id", "hyp", "gold_text", r.alias("r"), h.alias("h"), fr.alias("fr"), fh.alias("fh"))
    each = each.select("page_id", "hyp", "gold_text", T.cer(F.col("r"), F.col("h")).alias("cer"), T.wer(F.col("fr"), F.col("fh")).alias("wer"), T.name_recall(F.col("r"), F.col("h")).alias("name_recall"))
    return readings.join(each, ["page_id", "hyp"])


def leaderboard(scored: DataFrame) -> DataFrame:
    """Per system: pages, samples, mean error rates; lowest character error rate first."""
    g = scored.groupBy(*SYSTEM).agg(F.count_distinct("page_id").alias("pages"), F.count("*").alias("samples"), F.avg("cer").alias("cer"), F.avg("wer").alias("wer"), F.avg("name_recall").alias("name_recall"))
    return g.orderBy(F.asc_nulls_first("cer"))


def detail(scored: DataFrame) -> DataFrame:
    """Every scored reading, the worst first."""
    return scored.orderBy(F.desc_nulls_first("cer"), "page_id", *SYSTEM, "sample_no")


def rendered(board: DataFrame) -> DataFrame:
    """The leaderboard as text, three decimals each, null as None."""
    number = lambda c: F.coalesce(F.format_string("%.3f", F.col(c)), F.lit("None"))
    return board.select(*[number(c).alias(c) if t == "double" else F.coalesce(F.col(c).cast("string"), F.lit("None")).alias(c) for c, t in board.dtypes])
