"""Values that stop too early, and how often each source cuts (problem 6).

Method: a structural check with a stack automaton. It reads a value and says what is open at its end: quotes, brackets,
markup, a broken multibyte sequence or escape, and the sentence, where the terminator is missing. Nearly every case
comes from one of these findings or from a field limit; a line that closes a sentence but stops before the end that its
other readings reach is a case as well (`end`). Brackets, quotes, markup, bytes and escapes decide by themselves where nothing that follows
closes them. A missing terminator is weighed by its source's baseline: a source that closes nearly all its values is cut
where one is open, and a source that leaves most of them open (lines of a page go on in the next) needs a second sign:

- the source's field limit, a length at which its values stop far too often;
- for lines, the end that the other readings of the same line reach, aligned to the page's pivot;
- for summaries, that the last words hardly ever end a sentence in the corpus.

The end of a line is a sum over its readings, and what is cut is decided for each end, not for each row.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkloom.llm.forms import mapped, usual
from inkloom.llm.readings import KEYS, each_batch, ending, whole, with_pivot
from inkloom.session import cut, maybe_broadcast

LEAST = 3
#: A field limit is a length that holds at least this share of a source's values and that at most LIMIT_BEYOND times as
#: many values exceed (signs put in after the cut).
LIMIT_SHARE, LIMIT_BEYOND, LIMIT_ROWS = 0.03, 0.3, 20
#: A source that leaves no more than this share of its values without a terminator closes what it writes.
CLOSES = 0.02
OPEN = {"(": ")", "[": "]", "{": "}", "“": "”", "„": "”", "«": "»", "‘": "’"}
_tag = re.compile(r"<(/?)([a-zA-Z][\w-]*)[^<>]*?(/?)>")
_elided = re.compile(r"‘(?=[stnmrk]\b)", re.I)  # 's, 't and the like, with the wrong sign
_closed = re.compile(r"[.!?](?<!\.\.\.)[\"'”’)\]]*\s*$")
_marks = re.compile("[()\\[\\]{}“”„«»‘’\"<>\\\\&%\ufffd\ud800-\udfff]")
_no_escape = re.compile(r"(?:(?:^|\s)&|\d\s?%)$")


def structure(text: str) -> str:
    """What a stack automaton finds open at the end of a text, comma-separated: bracket, quote, markup, bytes, escape, and
    sentence where no terminator closes it (dots that stand for what is missing don't). An empty text leaves nothing open."""
    stack, out = [], []
    straight = 0
    if not _marks.search(text):
        return "sentence" if text.strip() and not _closed.search(text) else ""
    for i, c in enumerate(text):
        if c in OPEN and not (c == "‘" and i and text[i - 1].isalnum()):
            stack.append(OPEN[c])
        elif stack and c == stack[-1]:
            stack.pop()
        elif c == '"':
            straight ^= 1
    if any(c in ")]}" for c in stack):
        out.append("bracket")
    if straight or any(c in "”»’" for c in stack):
        out.append("quote")
    tags: list[str] = []
    for m in _tag.finditer(text):
        if m[1] and tags and tags[-1] == m[2]:
            tags.pop()
        elif not m[1] and not m[3]:
            tags.append(m[2])
    if tags or re.search(r"<[/a-zA-Z][^<>]*$", text):
        out.append("markup")
    if text.endswith("�") or text and 0xD800 <= ord(text[-1]) <= 0xDFFF:
        out.append("bytes")
    if re.search(r"(?:\\|&#?\w{0,8}|%[0-9a-fA-F]?|\\u[0-9a-fA-F]{0,3}|\\x[0-9a-fA-F]?)$", text):
        out.append("escape")
    if text.strip() and not _closed.search(text):
        out.append("sentence")
    return ",".join(out)


def unclosed(text: str, after: list[str] = ()) -> str:
    """What structure() finds open at the end of a text and the texts after it don't close. An ampersand that stands
    alone and a percentage are no broken escapes."""
    t = _elided.sub("'", text)
    here = structure(t)
    if not here:
        return ""
    kinds = [k for k in here.split(",") if k != "escape" or not _no_escape.search(text)]
    for x in after:
        if not any(k in ("bracket", "quote", "markup") for k in kinds):
            break
        t += " " + _elided.sub("'", x)
        now = structure(t).split(",")
        kinds = [k for k in kinds if k in ("bytes", "escape", "sentence") or k in now]
    return ",".join(kinds)


def _signs(text: str) -> int:
    """How many signs follow the last letter or digit of a text."""
    t = text.rstrip()
    n = len(t)
    while n and not t[n - 1].isalnum():
        n -= 1
    return len(t) - n


def _ends(reads: DataFrame) -> DataFrame:
    """Every row of every reading: KEYS, line_no, line (the pivot's line that it reads, or the place and first word of a
    line that the pivot lacks), delta (letters by which it goes beyond the pivot's end; of a line that the pivot lacks,
    its letters), words (by which it goes beyond), within (whether it stops within a word), size, last (its last word,
    if it ends in a letter), tail (its last word in any case), open (what the automaton found and no later line of the reading closes)."""
    cols = [*KEYS, "line_no", "line", "delta", "words", "within", "size", "last", "tail", "open"]

    def run(batches):
        memo: dict = {}
        for b in batches:
            out = []
            for row, ref, hyp, at in each_batch(b, memo):
                key = (row.page_id, row.engine, row.model, row.prompt_version, row.variant, whole(row.sample_no))
                texts, before = list(row.texts), -1
                for j, i in enumerate(at):
                    text, h = texts[j], hyp[j]
                    delta = words = 0
                    within = False
                    if i is not None:
                        before, line = i, str(row.p_nos[i])
                        r = ref[i]
                        if r != h:
                            k = (tuple(r), tuple(h), row.p_texts[i][-4:], text[-4:])
                            if k not in memo:
                                delta, words, within = ending(r, h)
                                # Signs count where a line stops before the other's end, not where both have the last word.
                                signs = -_signs(row.p_texts[i]) if delta < 0 else _signs(text) if delta > 0 else 0
                                memo[k] = delta + signs, words if delta > 0 else -words, within
                            delta, words, within = memo[k]
                    elif h:
                        line, delta, words = f"{before}+{h[0]}", len(" ".join(h)), len(h)
                    else:
                        line = None
                    out.append((*key, row.nos[j], line, delta, words, within, len(text), h[-1] if h and text[-1:].isalpha() else "", h[-1] if h else "", unclosed(text, texts[j + 1 :])))
            yield pd.DataFrame(out, columns=cols).astype({"sample_no": "Int32"})

    schema = "page_id string, engine string, model string, prompt_version string, variant string, sample_no int, line_no int, line string, delta int, words int, within boolean, size int, last string, tail string, open string"
    return reads.mapInPandas(run, schema)


def limits(values: DataFrame, source: list[str], size: str = "size") -> DataFrame:
    """(source..., field_limit): the fixed length at which a source cuts, where one is seen."""
    h = values.groupBy(*source, size).agg(F.count("*").alias("k"))
    longest = h.groupBy(*source).agg(F.sum("k").alias("all"), F.max_by(size, "k").alias("mode"), F.max("k").alias("most"))
    beyond = h.join(longest, source).groupBy(*source, "mode", "most", "all").agg(F.sum(F.when(F.col(size) > F.col("mode"), F.col("k")).otherwise(0)).alias("over"))
    ok = (F.col("most") >= F.greatest(F.lit(LIMIT_ROWS), F.col("all") * LIMIT_SHARE)) & (F.col("over") <= F.col("most") * LIMIT_BEYOND)
    return beyond.where(ok).select(*source, F.col("mode").alias("field_limit"))


SOURCE = ["engine", "model", "prompt_version", "variant"]


def baselines(values: DataFrame, source: list[str], is_open: Column) -> DataFrame:
    """(source..., baseline): the share of a source's values that end without a terminator."""
    return values.groupBy(*source).agg(F.avg(is_open.cast("double")).alias("baseline"))


def lines(transcriptions: DataFrame) -> DataFrame:
    """KEYS, line_no, is_cut and why, size and field_limit, for every row with text.

    A row whose line no other reading reads is judged by its source's field limit and by its structure alone.
    """
    rows = cut(_ends(with_pivot(transcriptions)))
    salts = 8
    ends = rows.where("line IS NOT NULL").groupBy("page_id", "line", "delta").agg(F.count("*").alias("k"), F.min("words").alias("w"), F.max("last").alias("last"), F.max("tail").alias("tail"), F.count_if(_hard(F.col("open")) != "").alias("open_k"))
    ends = cut(_judged(ends))
    # What is decided by the end alone: most rows end where their line does, and only the others meet this table.
    odd_ends = ends.where(F.col("behind") >= LEAST).unionByName(ends.where((F.col("behind") < LEAST) & ((F.col("readers") < 2) | (F.col("open_k") > 0))))
    odd_ends = odd_ends.drop("last", "tail").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    # Words at which lines of the archive may end: two readings or more agree on that, for two lines or more; and
    # beginnings of such words, at least three letters short of the whole.
    may_end = ends.where("behind = 0 AND k >= 2 AND last <> ''").groupBy("last").count().where("count >= 2").select("last", F.lit(True).alias("whole"))
    begun = may_end.select(F.explode(F.transform(F.sequence(F.lit(2), F.greatest(F.lit(2), F.length("last") - LEAST)), lambda i: F.substring("last", F.lit(1), i))).alias("last")).distinct()
    begun = begun.join(may_end.select("last"), "last", "left_anti").withColumn("begun", F.lit(True))
    stat = limits(rows, SOURCE).join(baselines(rows, SOURCE, F.col("open").contains("sentence")), SOURCE, "right")
    stat = cut(stat.select(*[F.coalesce(c, F.lit("")).alias(f"s_{c}") for c in SOURCE], "field_limit", "baseline"))
    r = rows.join(maybe_broadcast(stat, 100_000), [F.coalesce(F.col(c), F.lit("")) == F.col(f"s_{c}") for c in SOURCE], "left").drop(*[f"s_{c}" for c in SOURCE])
    r = r.withColumn("salt", F.pmod(F.xxhash64(*KEYS), F.lit(salts)).cast("int")).join(maybe_broadcast(odd_ends, 1_000_000), ["page_id", "line", "delta", "salt"], "left")
    lone = F.col("line").isNull() | (F.coalesce(F.col("readers"), F.lit(2)) < 2)
    hard, unended = _hard(F.col("open")), F.col("open").contains("sentence")
    at_limit = F.coalesce(F.col("size") == F.col("field_limit"), F.lit(False))
    # Beyond the end of a pivot that is cut itself lengths tell less: who has the line's last word has the line.
    reached = (F.col("end") > 0) & (F.levenshtein("tail", "end_tail") * 3 <= F.length("end_tail")) & ((F.col("tail") == F.col("end_tail")) | ~F.startswith("end_tail", "tail")) | (F.col("end") > 0) & (F.col("tail") == "?") & ~at_limit
    behind = F.when(F.coalesce(reached, F.lit(False)), 0).otherwise(F.coalesce("behind", F.lit(0)))
    r = r.withColumn("behind", behind)
    doubt = (F.col("k") >= F.col("backing")) & ~(F.col("within") & (F.col("delta") < 0)) & (F.abs("behind") <= 12) & ~at_limit
    asks = (F.coalesce(F.col("behind"), F.lit(0)) >= LEAST) & (doubt | lone) | lone
    near = r.where(asks)
    near = near.join(may_end, "last", "left").join(begun, "last", "left")
    r = r.where(~F.coalesce(asks, F.lit(False))).withColumns({"whole": F.lit(None).cast("boolean"), "begun": F.lit(None).cast("boolean")}).unionByName(near)
    stops_within = (F.col("last") != "") & F.col("whole").isNull()
    # One word more in one other reading may as well be put in there.
    compared = (F.col("behind") >= LEAST) & ~F.coalesce(doubt & ~stops_within, F.lit(False)) & ~lone
    alone = lone & (unended & (at_limit & stops_within | F.coalesce("begun", F.lit(False)) | (F.col("baseline") <= CLOSES)) | (hard != "") & ~F.col("open").contains("quote") & ~F.col("open").contains("escape"))
    # Where the readings agree on the end, what most of them leave open there tells that the line goes on.
    agreed = ~lone & (F.col("k") >= F.col("backing")) & (hard != "") & (2 * F.col("open_k") > F.col("k"))
    found_open = F.when(hard != "", hard).when(unended, "sentence").otherwise("end")
    why = F.when(compared, F.when(at_limit, "field limit").otherwise(found_open)).when(alone, F.when(at_limit, "field limit").otherwise(found_open)).when(agreed | hard.contains("bytes"), hard)
    return r.select(*KEYS, "line_no", why.isNotNull().alias("is_cut"), why.alias("why"), "size", "field_limit")


def _hard(found: Column) -> Column:
    """The automaton's findings but for the open sentence."""
    return F.regexp_replace(found, ",?sentence", "")


def _judged(ends: DataFrame) -> DataFrame:
    """ends(page_id, line, delta, k, w, last, tail, open_k) with readers, the line's end (a delta), end_tail (its last word),
    backing (readings that reach it) and behind, by how many letters each end lies before it.

    The line's end is the one that most readings reach, of equally many the later one; but where a quarter of the readings
    go on from there by two words or more, which no stray word explains, it is the end of most of these.
    """
    line = ["page_id", "line"]
    top = ends.groupBy(*line).agg(F.max_by(F.struct("delta", "k", "w", "tail"), F.struct("k", "delta")).alias("t"), F.sum("k").alias("readers"))
    e = ends.join(top, line)
    beyond = F.col("w") >= F.col("t.w") + 2
    later = e.groupBy(*line).agg(F.sum(F.when(beyond, F.col("k")).otherwise(0)).alias("later"), F.max_by(F.when(beyond, F.struct("delta", "k", "w", "tail")), F.when(beyond, F.struct("k", "delta"))).alias("l"))
    e = e.join(later, line).withColumn("t", F.when(4 * F.col("later") >= F.col("readers"), F.coalesce("l", "t")).otherwise(F.col("t")))
    return e.select(*line, "delta", "k", "last", "tail", "open_k", "readers", F.col("t.delta").alias("end"), F.col("t.tail").alias("end_tail"), F.col("t.k").alias("backing"), (F.col("t.delta") - F.col("delta")).alias("behind"))


def summaries(s: DataFrame, col: str = "summary_en", key: str = "letter_id", source: str = "model") -> DataFrame:
    """(key, source, is_cut, why) of every different non-null text. A text is cut if the automaton finds a bracket, quote,
    markup, character or escape open at its end; where it finds the sentence open, if the text has its source's fixed
    length, if its last words hardly ever end a sentence in the corpus, or if its source closes nearly all its texts. An
    empty text is not cut."""

    @F.pandas_udf("string")
    def left_open(x: pd.Series) -> pd.Series:
        return x.map(lambda v: unclosed(v.rstrip()))

    t = s.where(F.col(key).isNotNull() & F.col(col).isNotNull()).select(F.col(key).alias("k"), F.col(source).alias("source"), F.col(col).alias("text")).distinct()
    t = t.withColumn("u", F.lower(mapped(F.col("text")))).withColumn("size", F.length("text"))
    # How often a pair of words ends a sentence, of all its occurrences; each different sentence counts once.
    sentence = t.select(F.explode(F.split("u", r"(?<=[.!?])\s+")).alias("s")).distinct()
    ws = F.expr(r"regexp_extract_all(s, '[\\p{L}\\p{N}]+(?:[\'’-][\\p{L}\\p{N}]+)*', 0)")
    sentence = sentence.select(ws.alias("w"), F.col("s").rlike(r"[.!?]\W*$").alias("ended")).where(F.size("w") >= 2)
    pos = sentence.select("ended", F.posexplode("w").alias("i", "word"), F.size("w").alias("m"), "w")
    final = (F.col("i") == F.col("m") - 1) & F.col("ended")
    inner = F.col("i") < F.col("m") - 1
    words = pos.groupBy("word").agg(F.sum(final.cast("int")).alias("final"), F.sum(inner.cast("int")).alias("inner"))
    before = F.when(F.col("i") > 0, F.element_at("w", F.col("i")))
    pos = pos.where("i > 0").withColumn("pair", F.concat_ws(" ", before, "word")).withColumn("begin", F.concat_ws(" ", F.element_at("w", F.lit(1)), "pair"))
    begins = pos.groupBy("begin").agg(F.sum(final.cast("int")).alias("final3"), F.sum(inner.cast("int")).alias("inner3"))
    pairs = pos.groupBy("pair").agg(F.sum(final.cast("int")).alias("final2"), F.sum(inner.cast("int")).alias("inner2"))
    tail = F.regexp_extract_all("u", F.lit(r"[\p{L}\p{N}]+(?:['’-][\p{L}\p{N}]+)*"), 0)
    t = t.withColumn("ws", tail).withColumn("word", F.try_element_at("ws", F.lit(-1))).withColumn("pair", F.concat_ws(" ", F.try_element_at("ws", F.lit(-2)), "word"))
    last = F.regexp_extract(F.try_element_at(F.split("u", r"(?<=[.!?])\s+"), F.lit(-1)), r"[\p{L}\p{N}]+(?:['’-][\p{L}\p{N}]+)*", 0)
    t = t.withColumn("begin", F.concat_ws(" ", last, "pair"))
    limit = limits(t, ["source"])
    t = t.join(maybe_broadcast(limit, 100_000), "source", "left").join(words, "word", "left").join(pairs, "pair", "left").join(begins, "begin", "left")
    f1, n1 = F.coalesce("final", F.lit(0)), F.coalesce("inner", F.lit(0))
    f2, n2 = F.coalesce("final2", F.lit(0)), F.coalesce("inner2", F.lit(0))
    f3, n3 = F.coalesce("final3", F.lit(0)), F.coalesce("inner3", F.lit(0))
    may_end = F.when(f3 + n3 >= 2, f3 >= 0.1 * (f3 + n3)).when(f2 + n2 >= 3, f2 >= 0.08 * (f2 + n2)).otherwise(f1 >= F.greatest(F.lit(2), 0.3 * (f1 + n1)))
    within_space = F.col("text").rlike(r"\s$")
    t = cut(t.withColumn("open", left_open("text")).select("k", "source", "text", "open", (F.col("size") == F.col("field_limit")).alias("at"), may_end.alias("may_end"), within_space.alias("space")))
    base = baselines(t, ["source"], F.col("open").contains("sentence"))
    t = t.join(maybe_broadcast(base, 100_000), "source", "left")
    hard, at_limit = _hard(F.col("open")), F.coalesce("at", F.lit(False))
    is_cut = (hard != "") | F.col("open").contains("sentence") & (at_limit | ~F.col("may_end") | F.col("space") | F.coalesce(F.col("baseline") <= CLOSES, F.lit(False)))
    why = F.when(is_cut, F.when(at_limit, "field limit").when(hard != "", hard).otherwise("sentence"))
    return t.select(F.col("k").alias(key), F.col("source").alias(source), is_cut.alias("is_cut"), why.alias("why"), "text")


def found(transcriptions: DataFrame, sums: DataFrame) -> DataFrame:
    """p6_found: the rows that stop too early."""
    record = F.concat(*[x for c in (*KEYS, "line_no") for x in (F.lit("|"), F.col(c).cast("string"))][1:])
    a = lines(transcriptions).where("is_cut").select(F.lit("transcriptions").alias("table_name"), record.alias("record_id"))
    b = summaries(sums).where("is_cut").select(F.lit("summaries").alias("table_name"), F.col("letter_id").alias("record_id"))
    return a.unionByName(b).where("record_id IS NOT NULL").distinct()


def shares(transcriptions: DataFrame, sums: DataFrame) -> DataFrame:
    """(table_name, source, n_rows, n_cut, share) per engine/model, and per model of the summaries."""
    a = lines(transcriptions).select(F.lit("transcriptions").alias("table_name"), F.concat_ws("/", F.coalesce("engine", F.lit("?")), F.coalesce("model", F.lit("?"))).alias("source"), "is_cut")
    b = summaries(sums).select(F.lit("summaries").alias("table_name"), F.coalesce("model", F.lit("?")).alias("source"), "is_cut")
    u = a.unionByName(b).groupBy("table_name", "source").agg(F.count("*").alias("n_rows"), F.count_if("is_cut").alias("n_cut"))
    return u.withColumn("share", F.col("n_cut") / F.col("n_rows"))
