"""Consensus of several readings of a line, agreement, and the reliability of each annotator (problem 4).

Method: minimax conditional entropy. An item is a slot of a line (a word of the pivot reading, or the gap before one);
the labels are what the annotators read there. The probability that annotator i gives label k where c is true is
proportional to exp((s_i + t_j) [k = c]), with a tilting parameter s_i for the annotator and t_j for the item, fitted by
dual coordinate ascent with an L2 penalty on both, alternating with the label posteriors until neither moves any more.
Agreement is reported apart.

Only what differs from the pivot is carried as rows; agreement with it follows from sums over the page's readings, so
that a page with very many readings stays a sum. One coordinate step uses the expected counts of the page for items
without dissent.
"""

from __future__ import annotations

import math
import warnings

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkloom.llm.forms import usual
from inkloom.llm.readings import ILLEGIBLE, bare, compare, each_batch, whole, with_pivot
from inkloom.session import cut, forget, small

#: Rounds of posteriors and parameters, at least and at most; they end when no parameter moves by MOVED any more.
ROUNDS, MOST_ROUNDS, MOVED = 3, 30, 1e-3
#: L2 penalties of annotators and items; labels thought possible for an item.
L2_ANNOTATOR, L2_ITEM, LABELS = 2.0, 4.0, 12
ABSENT = -1
FIRST = 4.0


def _votes(reads: DataFrame) -> DataFrame:
    """page_id, annotator, line (the pivot's line_no), slot, label, voted, size, n: every difference from the pivot, and
    for each reading one row with slot null and size, its page's number of slots."""

    def run(batches):
        memo: dict = {}
        for b in batches:
            out = []
            for row, ref, hyp, at in each_batch(b, memo):
                who = f"{row.engine}|{whole(row.sample_no)}"
                out.append((row.page_id, who, None, None, None, True, sum(map(len, ref)), row.n))
                seen = set()
                for j, i in enumerate(at):
                    if i is None:
                        continue
                    seen.add(i)
                    r, h = ref[i], hyp[j]
                    if r == h and "?" not in r:
                        continue
                    key = (tuple(r), tuple(h))
                    if key not in memo:
                        memo[key] = compare(r, h)[0]
                    no = int(row.p_nos[i])
                    out += [(row.page_id, who, no, s, label or "", label is not None, 0, row.n) for s, label in memo[key]]
                out += [(row.page_id, who, int(row.p_nos[i]), ABSENT, "", True, 0, row.n) for i in range(len(ref)) if i not in seen]
            yield pd.DataFrame(out, columns=["page_id", "annotator", "line", "slot", "label", "voted", "size", "n"]).astype({"line": "Int32", "slot": "Int32"})

    return reads.mapInPandas(run, "page_id string, annotator string, line int, slot int, label string, voted boolean, size int, n bigint")


def _sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def fit(reads: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(labels, slots, annotators) of readings with a pivot.

    labels: page_id, line, slot, label, n, q, q_pivot: the posteriors of every label that was read and isn't the pivot's,
    and of the pivot's. slots:
    page_id, line, slot, n_votes, q_pivot, t. annotators: annotator, n_readings, n_slots, accuracy, s.
    """
    votes = cut(_votes(reads))
    seen = votes.where("slot IS NULL").select("page_id", "annotator", "size")
    diff = votes.where("slot IS NOT NULL").select("page_id", "annotator", "line", "slot", "label", "voted")
    salts = 16
    diff = diff.withColumn("salt", F.pmod(F.xxhash64("page_id", "line"), F.lit(salts)).cast("int"))
    seen = seen.withColumn("salt", F.pmod(F.xxhash64("page_id", "annotator"), F.lit(salts)).cast("int"))
    known = cut(seen.groupBy("annotator").agg(F.count("*").alias("n_readings"), F.sum("size").alias("n_slots")).withColumns({"s": F.lit(FIRST), "accuracy": F.lit(None).cast("double")}))
    log_k = math.log(LABELS - 1)
    # Annotators are engines and samples: few enough to broadcast, which is checked; of more, each goes to every salt, as
    # one may hold a third of all rows.
    few = small(known, 100_000)
    line, slot = W.partitionBy("page_id", "line"), W.partitionBy("page_id", "line", "slot")
    absent = F.col("slot") == ABSENT
    state, moved, past = None, math.inf, []
    for turn in range(max(rounds, MOST_ROUNDS) + 1):
        if few:
            told, by = F.broadcast(known.select("annotator", "s")), ["annotator"]
        else:
            told, by = known.select("annotator", "s", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt")), ["annotator", "salt"]
        p = _sigmoid(F.col("s") - log_k)
        pages = seen.join(told, by).groupBy("page_id").agg(F.sum("s").alias("page_s"), F.count("*").alias("page_n"), F.sum(p).alias("page_p"), F.sum(p * (1 - p)).alias("page_w"))
        lab = diff.join(told, by).groupBy("page_id", "line", "slot", "label", "voted").agg(F.sum("s").alias("w"), F.count("*").alias("n"))
        lab = lab.join(pages, "page_id")
        # A reading without the line says nothing about its slots.
        gone_w, gone_n = (F.when(absent, 0).otherwise(F.coalesce(F.sum(F.when(absent, F.col(c))).over(line), F.lit(0))) for c in ("w", "n"))
        lab = lab.withColumns({"gone_w": gone_w, "gone_n": gone_n, "dw": F.sum("w").over(slot), "dn": F.sum("n").over(slot), "dissent": F.sum(F.when(F.col("voted"), F.col("n")).otherwise(0)).over(slot)})
        lab = lab.withColumns({"pivot_w": F.col("page_s") - F.col("dw") - F.col("gone_w"), "pivot_n": F.col("page_n") - F.col("dn") - F.col("gone_n")})
        if state is None:
            lab = lab.withColumn("t", F.lit(0.0))
        else:
            lab = lab.join(state.where("first").select("page_id", "line", "slot", F.col("new_t").alias("t")), ["page_id", "line", "slot"])
        ahead = F.col("w") - F.col("pivot_w") + F.col("t") * (F.col("n") - F.col("pivot_n"))
        # Relative to the slot's best label, so that no exponential of a page with very many readings is cut off.
        lab = lab.withColumn("ahead", F.when(F.col("voted"), ahead)).withColumn("top", F.greatest(F.lit(0.0), F.max("ahead").over(slot)))
        lab = lab.withColumns({"e": F.when(F.col("voted"), F.exp(F.col("ahead") - F.col("top"))).otherwise(0.0), "e_pivot": F.exp(-F.col("top"))})
        lab = lab.withColumns({"z": F.sum("e").over(slot), "zn": F.sum(F.col("e") * F.col("n")).over(slot), "first": F.row_number().over(slot.orderBy("voted", "label")) == 1})
        voters = F.greatest(F.col("pivot_n") + F.col("dissent"), F.lit(1))
        hits = (F.col("e_pivot") * F.col("pivot_n") + F.col("zn")) / (F.col("e_pivot") + F.col("z"))
        new_t = (hits - F.col("page_p") * voters / F.col("page_n")) / (F.col("page_w") * voters / F.col("page_n") + L2_ITEM)
        state = cut(
            lab.select(
                "page_id", "line", "slot", "label", "voted", "n", "dissent", "first", voters.alias("n_votes"),
                (F.col("e") / (F.col("e_pivot") + F.col("z"))).alias("q"), (F.col("e_pivot") / (F.col("e_pivot") + F.col("z"))).alias("q_pivot"), "t", F.greatest(F.lit(-3.0), F.least(F.lit(3.0), new_t)).alias("new_t"),
            )
        )
        for x in past:
            forget(x)
        if turn >= rounds and moved < MOVED:
            break
        # Expected mistakes of each annotator: where it followed the pivot, where it didn't.
        lost = state.where("first AND dissent > 0").groupBy("page_id").agg(F.sum(1 - F.col("q_pivot")).alias("lost"))
        follow = seen.join(lost, "page_id").groupBy("annotator").agg(F.sum("lost").alias("more"))
        own = diff.select("page_id", "annotator", "line", "slot", "label", "voted").join(state.select("page_id", "line", "slot", "label", "voted", "q", "q_pivot"), ["page_id", "line", "slot", "label", "voted"])
        own = own.groupBy("annotator").agg(F.sum(F.col("q_pivot") - 1 + F.when(F.col("voted"), 1 - F.col("q")).otherwise(0.0)).alias("more"))
        wrong = follow.unionByName(own).groupBy("annotator").agg(F.sum("more").alias("wrong"))
        k = known.select("annotator", "n_readings", "n_slots", F.col("s").alias("old_s")).join(wrong, "annotator", "left")
        right = F.greatest(F.lit(0.0), F.col("n_slots") - F.greatest(F.lit(0.0), F.coalesce("wrong", F.lit(0.0))))
        k = k.withColumn("accuracy", (right + 9) / (F.col("n_slots") + 10))
        # Newton steps on the penalised dual, from the unpenalised optimum.
        k = k.withColumn("s", F.log(F.col("accuracy") / (1 - F.col("accuracy"))) + log_k)
        for _ in range(2):
            p = _sigmoid(F.col("s") - log_k)
            k = k.withColumn("s", F.col("s") + ((F.col("accuracy") - p) * F.col("n_slots") - L2_ANNOTATOR * (F.col("s") - FIRST)) / (p * (1 - p) * F.col("n_slots") + L2_ANNOTATOR))
        past = [state, known]
        known = cut(k.select("annotator", "n_readings", "n_slots", F.greatest(F.lit(0.1), F.least(F.lit(12.0), F.col("s"))).alias("s"), "accuracy", "old_s"))
        steps = [known.agg(F.max(F.abs(F.col("s") - F.col("old_s")))), state.agg(F.max(F.abs(F.col("new_t") - F.col("t"))))]
        moved = max(x.first()[0] or 0.0 for x in steps)
    else:
        warnings.warn(f"the fit still moved by {moved} after {turn + 1} rounds")
    known = known.drop("old_s")
    slots = state.where("first AND dissent > 0").select("page_id", "line", "slot", "n_votes", "q_pivot", F.col("new_t").alias("t"))
    return state.where("voted").select("page_id", "line", "slot", "label", "n", "q", "q_pivot"), slots, known


def agreement(reads: DataFrame) -> DataFrame:
    """page_id, n_readings, n_slots, agreement: the share of pairs of votes that agree, over the page's slots."""
    votes = _votes(reads)
    size = votes.where("slot IS NULL").groupBy("page_id").agg(F.count("*").alias("n_readings"), F.max("size").alias("n_slots"))
    lab = votes.where(f"slot IS NOT NULL AND slot <> {ABSENT} AND voted").groupBy("page_id", "line", "slot", "label").agg(F.count("*").alias("k"))
    off = lab.groupBy("page_id", "line", "slot").agg(F.sum("k").alias("dissent"), F.sum(F.col("k") * (F.col("k") - 1)).alias("same"))
    off = off.join(size, "page_id")
    rest = F.greatest(F.lit(0), F.col("n_readings") - F.col("dissent"))
    pairs = F.col("n_readings") * (F.col("n_readings") - 1)
    off = off.groupBy("page_id").agg(F.sum(1 - (F.col("same") + rest * (rest - 1)) / pairs).alias("off"))
    out = size.join(off, "page_id", "left").where("n_readings > 1")
    return out.select("page_id", "n_readings", "n_slots", F.greatest(F.lit(0.0), 1 - F.coalesce("off", F.lit(0.0)) / F.greatest("n_slots", F.lit(1))).alias("agreement"))


def _changes(reads: DataFrame) -> DataFrame:
    """(page_id, line_no, slot, label): where the consensus differs from the pivot."""
    lab, _, _ = fit(reads)
    best = lab.groupBy("page_id", "line", "slot").agg(F.max("q").alias("q"), F.max("q_pivot").alias("q_pivot"), F.max_by("label", F.struct("q", "label")).alias("label"))
    return best.where("q > q_pivot").select("page_id", F.col("line").alias("line_no"), "slot", "label")


def changed_lines(transcriptions: DataFrame) -> DataFrame:
    """(page_id, line_no, slot, label): where the consensus of a page with at least three readings differs from the
    reference reading; label '' where the reference has a word too many, slot -1 where it has a line too many."""
    return _changes(with_pivot(transcriptions).where("n >= 3 AND is_ref"))


def rewritten(text: str, changes: dict[int, str]) -> str | None:
    """A line with its changed slots; None where the consensus has no such line. A replaced word keeps the signs and the
    capital of what stood there."""
    if ABSENT in changes:
        return None
    out, k = [], 0
    for w in usual(text).split():
        core = ILLEGIBLE if ILLEGIBLE in w else bare(w)
        if not core:
            out.append(w)
            continue
        out += [changes[2 * k]] if changes.get(2 * k) else []
        new = changes.get(2 * k + 1)
        at = w.find(core)
        if new is None:
            out.append(w)
        elif new:
            out.append(w[:at] + (new[:1].upper() + new[1:] if core[:1].isupper() else new) + w[at + len(core) :])
        k += 1
    return " ".join(out + ([changes[2 * k]] if changes.get(2 * k) else []))


def consensus_text(transcriptions: DataFrame) -> DataFrame:
    """(page_id, line_no, text, n_changed): the consensus text of every line of every page, line numbers as in the page's
    pivot. Pages with fewer than three readings keep the pivot's text; lines that most readings lack are left out."""
    reads = with_pivot(transcriptions)
    lines = reads.where("is_pivot").select("page_id", F.explode(F.arrays_zip(F.col("nos").alias("line_no"), F.col("texts").alias("text"))).alias("x")).select("page_id", "x.line_no", "x.text")
    c = _changes(reads.where("n >= 3")).groupBy("page_id", "line_no").agg(F.collect_list(F.struct("slot", "label")).alias("changes"))

    @F.pandas_udf("string")
    def put(text: pd.Series, changes: pd.Series) -> pd.Series:
        return pd.Series([t if cs is None else rewritten(t, {c["slot"]: c["label"] for c in cs}) for t, cs in zip(text, changes)], dtype=object)

    x = lines.join(c, ["page_id", "line_no"], "left")
    x = x.select("page_id", "line_no", put("text", "changes").alias("text"), F.coalesce(F.size("changes"), F.lit(0)).alias("n_changed"))
    return x.where("text IS NOT NULL")


def found(transcriptions: DataFrame) -> DataFrame:
    """p4_found: the reference reading's lines from which the consensus differs."""
    return changed_lines(transcriptions).select("page_id", "line_no").distinct()
