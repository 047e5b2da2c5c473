"""Competing readings of a page reconciled by line alignment and a vote on each word.

Alignment is an ordered dynamic programme and runs in Arrow batches, each reading apart from the others; all that is
counted is counted by Spark.
"""

from __future__ import annotations

import difflib
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkloom.functions.jsonx import json_block
from inkloom.functions.text import marked
from inkloom.operators.fuzzy import indel_ratio
from inkloom.operators.scoring import SYSTEM
from inkloom.session import cut, maybe_broadcast

TOKEN = "struct<text:string,alternatives:array<string>>"
KEYS = ["page_id", *SYSTEM, "sample_no"]
#: Rows of one page that share one copy of its first reading.
SHARE = 10_000
#: Classes of letters whose counts bound a likeness from above.
BAGS = 41


def _rank(prefer: str) -> Column:
    return F.when(F.col("engine") == prefer, 0).otherwise(10) + F.col("sample_no")


def ranked(transcriptions: DataFrame, prefer: str = "local") -> DataFrame:
    """One row per reading with its lines in order (nulls kept) and its place among its page's readings: the preferred
    engine first, then by sample; ties by key. Places are given to keys alone; the lines are joined to them."""
    g = transcriptions.groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct("line_no", "text"))).alias("x")).select(*KEYS, F.col("x.text").alias("lines"))
    place = F.row_number().over(W.partitionBy("page_id").orderBy(_rank(prefer), *SYSTEM, "sample_no"))
    places = transcriptions.select(*KEYS).distinct().withColumn("place", place.cast("bigint"))
    same = [g[c].eqNullSafe(places[c]) for c in KEYS]
    return g.join(places, same).select(*[g[c] for c in KEYS], "lines", "place")


@lru_cache(maxsize=100_000)
def _bag(line: str) -> np.ndarray:
    return np.bincount(np.frombuffer(line.encode("utf-32-le"), np.uint32) % BAGS, minlength=BAGS)


ratio = lru_cache(maxsize=300_000)(indel_ratio)


def _best(like: np.ndarray) -> list[tuple[int, int]]:
    """The matched cells of the in-order matching with the greatest total. Of equal totals a match goes first, then
    leaving out a row: choices are stored on the way forward, row by row, as sideways moves add nothing."""
    n, m = like.shape
    before = np.zeros(m + 1)
    choice = np.zeros((n, m), np.int8)
    for i in range(n):
        met = before[:-1] + like[i]
        row = np.maximum.accumulate(np.maximum(met, before[1:]))
        choice[i] = np.where((like[i] > 0) & (met == row), 0, np.where(before[1:] == row, 1, 2))
        before = np.concatenate([[0.0], row])
    out = []
    i, j = n - 1, m - 1
    while i >= 0 and j >= 0:
        c = choice[i, j]
        if c == 0:
            out.append((i, j))
        i, j = i - (c != 2), j - (c != 1)
    return out


def align(ref: list[str], hyp: list[str], least: float = 45.0) -> list[int | None]:
    """For each ref line the hyp line that is matched to it in order, so that total likeness is greatest; None where
    there is none. Lines of a likeness below `least` are not matched.

    Likeness is dear, so that every pair begins with a bound that its letters' counts allow. The best matching under the
    bounds is measured, and sought again with what was measured, until it consists of measured pairs: as the bounds are
    never too low, it is then the best of all.
    """
    out: list[int | None] = [None] * len(ref)
    if not ref or not hyp:
        return out
    a, b = np.array([_bag(x) for x in ref]), np.array([_bag(x) for x in hyp])
    total = a.sum(1)[:, None] + b.sum(1)[None, :]
    like = np.where(total == 0, 100.0, 200.0 * np.minimum(a[:, None, :], b[None, :, :]).sum(2) / np.maximum(total, 1))
    like[like < least - 1e-9] = 0.0
    measured = np.zeros(like.shape, bool)
    while True:
        path = _best(like)
        fresh = [(i, j) for i, j in path if not measured[i, j]]
        if not fresh:
            break
        for i, j in fresh:
            x = ratio(ref[i], hyp[j])
            like[i, j], measured[i, j] = x if x >= least else 0.0, True
    for i, j in path:
        out[i] = j
    return out


def votes(ref: list[str], hyp: list[str]):
    """(k, word): what a reading's line says on the words of the reference's."""
    for kind, a, b, x, y in difflib.SequenceMatcher(None, ref, hyp, autojunk=False).get_opcodes():
        if kind == "equal" or (kind == "replace" and b - a == y - x):
            for k in range(b - a):
                yield a + k, hyp[x + k]


def voted(transcriptions: DataFrame, prefer: str = "local") -> DataFrame:
    """(page_id, n, tokens): the lines of each page's first reading, numbered, each word voted on by all its readings.

    A reading's votes depend on itself and the page's first reading only, so that readings vote apart, wherever they
    are, and their votes are counted: no page is one task, and all its readings count. The first reading's own word wins
    ties; the others stand by votes, then by the reading that first said them. Null lines are empty ones.
    """
    g = transcriptions.groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct("line_no", "text"))).alias("x"))
    # The order of readings as one string that sorts as its parts do: the separator sorts before every letter.
    number = lambda c: F.lpad(F.coalesce(c, F.lit(0)).cast("string"), 12, "0")
    order = F.concat_ws("\u0001", number(_rank(prefer)), *[F.coalesce(c, F.lit("")) for c in SYSTEM], number(F.col("sample_no")))
    g = g.select("page_id", F.col("x.text").alias("lines"), order.alias("at"))
    ref = g.groupBy("page_id").agg(F.min_by(F.struct("lines", "at"), "at").alias("r")).select("page_id", F.col("r.lines").alias("ref"), F.col("r.at").alias("ref_at"))
    # A page with very many readings has several copies of its first, so that its readings are spread.
    rows = transcriptions.where("page_id IS NOT NULL").groupBy("page_id").agg(F.ceil(F.count("*") / SHARE).cast("int").alias("copies"))
    hot = maybe_broadcast(cut(rows.where("copies > 1")), 100_000)
    last = F.coalesce(F.col("copies"), F.lit(1)) - 1
    ref = ref.join(hot, "page_id", "left").select("page_id", "ref", "ref_at", F.explode(F.sequence(F.lit(0), last)).alias("copy"))
    g = g.join(hot, "page_id", "left").withColumn("copy", F.pmod(F.xxhash64("at"), last + 1).cast("int")).drop("copies")

    def run(batches):
        for b in batches:
            polls: dict[tuple, list] = {}
            known: dict[tuple, list] = {}

            def poll(key: tuple, at: str) -> None:
                p = polls.setdefault(key, [0, at])
                p[0] += 1
                p[1] = min(p[1], at)

            for page, lines, at, ref, ref_at in zip(b["page_id"], b["lines"], b["at"], b["ref"], b["ref_at"]):
                first = [x or "" for x in ref]
                if at == ref_at:
                    for n, line in enumerate(first, 1):
                        poll((page, n, -1, ""), at)
                        for k, w in enumerate(line.split()):
                            poll((page, n, k, w), at)
                    continue
                own = [x or "" for x in lines]
                for n, j in enumerate(align(first, own)):
                    if j is not None:
                        pair = (first[n], own[j])
                        if pair not in known:
                            known[pair] = list(votes(pair[0].split(), pair[1].split()))
                        for k, w in known[pair]:
                            poll((page, n + 1, k, w), at)
            yield pd.DataFrame([(*key, *v) for key, v in polls.items()], columns=["page_id", "n", "k", "word", "votes", "at"])

    cast = g.join(ref, ["page_id", "copy"]).mapInPandas(run, "page_id string, n int, k int, word string, votes bigint, at string")
    cast = cast.groupBy("page_id", "n", "k", "word").agg(F.sum("votes").alias("votes"), F.min("at").alias("at"))
    poll = cast.groupBy("page_id", "n", "k").agg(F.array_sort(F.collect_list(F.struct((-F.col("votes")).alias("less"), "at", "word"))).alias("p"))
    token = F.struct(F.col("p")[0]["word"].alias("text"), F.transform(F.slice("p", 2, F.size("p")), lambda x: x["word"]).alias("alternatives"))
    # k = -1 stands for the line itself, so that lines without words stay.
    lines = poll.groupBy("page_id", "n").agg(F.array_sort(F.collect_list(F.struct("k", token.alias("t")))).alias("x"))
    return lines.select("page_id", "n", F.transform(F.filter("x", lambda y: y["k"] >= 0), lambda y: y["t"]).alias("tokens"))


def reconciled(voted_lines: DataFrame) -> DataFrame:
    """Rows of the letters frame from voted lines: the text, and the words that had alternatives."""
    line = F.array_join(F.col("tokens.text"), " ")
    spans = F.transform(F.filter("tokens", lambda t: F.size(t["alternatives"]) > 0), lambda t: F.struct(F.col("n").alias("line_no"), t["text"].alias("word"), t["alternatives"].alias("alternatives")))
    g = voted_lines.select("page_id", F.struct("n", line.alias("line"), spans.alias("spans")).alias("x")).groupBy("page_id").agg(F.array_sort(F.collect_list("x")).alias("x"))
    return g.select("page_id", F.array_join(F.col("x.line"), "\n").alias("text_final"), F.lit("auto").alias("text_source"), F.flatten(F.col("x.spans")).alias("uncertain_spans"))


def doubts(voted_lines: DataFrame) -> DataFrame:
    """(page_id, body): what a model is asked that may correct a page: its numbered lines with their alternatives."""
    g = voted_lines.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("n", marked(F.col("tokens")).alias("m")))).alias("x"))
    return g.select("page_id", F.array_join(F.transform("x", lambda l: F.concat(l["n"].cast("string"), F.lit(": "), l["m"])), "\n").alias("body"))


CORRECTION = "struct<lines:array<struct<n:string,text:string>>,uncertain:array<struct<line_no:string,n:string,word:string,alternatives:array<string>>>>"


def corrected(voted_lines: DataFrame, replies: DataFrame) -> DataFrame:
    """Rows of the letters frame from voted lines and a model's replies(page_id, reply) on their doubts.

    A line that the reply names by number takes its text, of several the last; others stay as voted, and so does a page
    without a reply or with one that is no JSON. The spans are the reply's, which may have none.
    """
    r = replies.groupBy("page_id").agg(F.max("reply").alias("reply")).select("page_id", F.from_json(json_block(F.col("reply")), CORRECTION).alias("r"))
    lines = F.filter("r.lines", lambda l: l["n"].try_cast("int").isNotNull() & l["text"].isNotNull())
    spans = F.transform(F.coalesce("r.uncertain", F.array().cast("array<struct<line_no:string,n:string,word:string,alternatives:array<string>>>")), lambda u: F.struct(F.coalesce(u["n"].try_cast("int"), F.lit(0)).alias("line_no"), F.coalesce(u["word"], F.lit("")).alias("word"), F.coalesce(u["alternatives"], F.array().cast("array<string>")).alias("alternatives")))
    r = r.select("page_id", F.coalesce(lines, F.array().cast("array<struct<n:string,text:string>>")).alias("said"), F.when(F.col("r").isNotNull(), spans).alias("spans"))
    x = voted_lines.join(r, "page_id", "left")
    mine = F.filter("said", lambda l: l["n"].try_cast("int") == F.col("n"))
    x = x.withColumn("tokens", F.when(F.size(mine) > 0, F.array(F.struct(F.element_at(mine, -1)["text"].alias("text"), F.array().cast("array<string>").alias("alternatives")))).otherwise(F.col("tokens")))
    base = reconciled(x.select("page_id", "n", "tokens"))
    votes_of = reconciled(voted_lines).select("page_id", F.col("uncertain_spans").alias("voted_spans"))
    base = base.drop("uncertain_spans").join(votes_of, "page_id").join(r.select("page_id", "spans"), "page_id", "left")
    return base.select("page_id", "text_final", "text_source", F.coalesce("spans", "voted_spans").alias("uncertain_spans"))
