"""Text of scanned pages repaired into continuous paragraphs (problem 2).

Method: the lines of a page, without running headers and page numbers, are de-lined into one stream of characters, in
which a space, a line's end and a hyphen at it are marks that may be read or not. A Viterbi search decodes the stream
jointly into words. A word covers the stream from one place to another: as it stands; with characters that the scanner
is known to confuse; over a line's end, with its hyphen or without; over a space within a line, where a word was torn;
or only a part of what stands between two spaces, where words were run together, in as many parts as it takes. Words and
their neighbours are weighed by counts from the archive's clean text. Paragraph boundaries are chosen by dynamic
programming.

A line is a running header if its shape (digits and codes masked) stands at the edge of several pages and in no clean
text, or is nearly such a shape.

The counts are a sketch of fixed size (two hashed counters for each word and pair of neighbours), built by one
distributed count over all clean texts; its size does not grow with the data and is a documented parameter. A word is
known if it has its share of the sketch's total, so that a corpus that is many times as large knows no more mistakes.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkloom.llm.forms import mapped, usual
from inkloom.session import cut, maybe_broadcast, parts

#: Bits of the sketch: 2**WORD_BITS counters for words, 2**PAIR_BITS for pairs; about 10 bytes for each counter in use.
WORD_BITS, PAIR_BITS = 19, 20
# What the scanner writes, and what may stand on the page.
CONFUSED = {
    "1": ["l", "i"], "0": ["o"], "5": ["s"], "6": ["b"], "9": ["g"], "2": ["z"], "8": ["b"], "@": ["a"], "|o": ["p"], "|": ["l", "i"],
    "rn": ["m"], "ri": ["n"], "cl": ["d"], "lc": ["k"], "ii": ["u"], "vv": ["w"], "c": ["e"], "f": ["t"], "b": ["h"], "y": ["v", "ij"], "li": ["h"], "$": ["s"], "m": ["rn"],
}
#: Cost of one confusion, by whether a letter or another sign stands for it; of a word read as two; of a word unknown.
LETTER, SIGN, SPLIT, BROKEN, TORN = 5.0, 1.5, 9.0, 7.0, 8.0
MOST_CONFUSIONS = 3
#: Share of all counted words that makes a word known, beside 2 texts (or 5, where it is a part of what stood together).
KNOWN = 2e-8
#: Pages at whose edge a header's shape must stand, share of its lines that must stand there, and its longest line.
HEADER_PAGES, HEADER_EDGE, HEADER_LONG = 3, 0.8, 80
EDGE = ".,;:!?()[]{}\"'“”„‘’…*«»<>/\\=_~"
CODE = r"\b[A-Z]{2,4}\d{2,3}\b"
NUMBERED = re.compile(r"^[\W_]*(?:(?:p|pg|pag|pagina|page|blz|bl|bladz|blad|fo|fol|folio|f)\b[\s.:]*)?[\dlIO]{1,4}\s?[rv]?[\W_]*$", re.I)
DATED = re.compile(r"\d{1,4}\s?[-/.]\s?(?:\d{1,2}|[ivx]+)\s?[-/.]\s?'?\d{2,4}")
_lex_word = re.compile(r"[^\W\d_]++(?:['’-][^\W\d_]++)*+")


def lex_words(text: str) -> list[str]:
    return _lex_word.findall(usual(text).lower())


def _buckets(s: str, bits: int) -> tuple[int, int]:
    h = xxhash.xxh64_intdigest(s.encode(), seed=42)
    return h & ((1 << bits) - 1), (h >> 32) & ((1 << bits) - 1)


class Counts:
    """The sketch: how many different clean texts hold a word, or a pair of neighbours."""

    def __init__(self, words: np.ndarray, pairs: np.ndarray):
        self.words, self.pairs = words, pairs
        self.total = max(1.0, float(words[0].sum()))
        self.least = KNOWN * self.total

    @lru_cache(maxsize=200_000)
    def word(self, w: str) -> int:
        a, b = _buckets(w, WORD_BITS)
        return int(min(self.words[0][a], self.words[1][b]))

    def known(self, w: str, least: int = 2) -> bool:
        n = self.word(w)
        return n >= least and n >= self.least

    @lru_cache(maxsize=400_000)
    def score(self, before: str, w: str) -> float:
        """Log-probability of a word after another, interpolated; an unknown word costs by its length."""
        n = self.word(w)
        alone = (n + 1e-3) / self.total if n else 1e-3 / self.total * 0.5 ** min(20, len(w))
        k = self.word(before) if before else 0
        if not k:
            return math.log(alone)
        a, b = _buckets(before + " " + w, PAIR_BITS)
        both = min(int(self.pairs[0][a]), int(self.pairs[1][b]))
        return math.log(0.7 * min(1.0, both / k) + 0.3 * alone)


def counts(texts: DataFrame, col: str = "text") -> Counts:
    """The sketch of all different non-null texts of `col`; a word or a pair of neighbours counts once for each text."""

    def run(batches):
        for b in batches:
            words: Counter = Counter()
            pairs: Counter = Counter()
            for t in b["t"]:
                w = lex_words(t)
                words.update(set(w))
                pairs.update(set(zip(w, w[1:])))
            yield pd.DataFrame({"s": [*words, *(" ".join(p) for p in pairs)], "n": [*words.values(), *pairs.values()]})

    each = texts.select(F.col(col).alias("t")).where(F.col("t").isNotNull()).distinct().mapInPandas(run, "s string, n bigint")
    h = each.groupBy("s").agg(F.sum("n").alias("n"))
    mask = lambda x, bits: x.bitwiseAND(F.lit((1 << bits) - 1))
    pair = F.col("s").contains(" ")
    bits = lambda x: F.when(pair, mask(x, PAIR_BITS)).otherwise(mask(x, WORD_BITS))
    x = F.xxhash64("s")
    h = h.select("n", pair.alias("pair"), F.posexplode(F.array(bits(x), bits(F.shiftrightunsigned(x, 32)))).alias("k", "b"))
    rows = h.groupBy("pair", "k", "b").agg(F.sum("n").alias("n")).toPandas()  # at most 2 * (2**WORD_BITS + 2**PAIR_BITS) rows
    got = {p: np.zeros((2, 1 << n), np.int64) for p, n in ((False, WORD_BITS), (True, PAIR_BITS))}
    for p, part in rows.groupby("pair"):
        got[bool(p)][part["k"].to_numpy(), part["b"].to_numpy()] = part["n"].to_numpy()
    return Counts(np.minimum(got[False], 2**31 - 1).astype(np.int32), np.minimum(got[True], 2**31 - 1).astype(np.int32))


def variants(core: str) -> dict[str, float]:
    """What a piece of the stream may stand for, with the cost of its confusions."""
    out = {core: 0.0}
    layer = {(core, 0): 0.0}
    for _ in range(MOST_CONFUSIONS):
        more: dict[tuple[str, int], float] = {}
        for (s, start), c in layer.items():
            for i in range(start, len(s)):
                for n in (2, 1):
                    for to in CONFUSED.get(s[i : i + n], ()) if i + n <= len(s) else ():
                        cost = c + (SIGN if not s[i : i + n].isalpha() else LETTER)
                        key = (s[:i] + to + s[i + n :], i + len(to))
                        if cost < more.get(key, 99):
                            more[key] = cost
        if len(more) > 4000:  # only a piece of dozens of doubtful signs has so many; its cheapest stay
            more = dict(sorted(more.items(), key=lambda x: x[1])[:4000])
        for (s, _), c in more.items():
            out[s] = min(c, out.get(s, 99))
        layer = more
    return out


def numbered(line: str) -> bool:
    """Whether a line is a page number: digits, with or without a word for page, and no date."""
    t = line.strip()
    return len(t) <= 14 and any(c.isdigit() for c in t) and bool(NUMBERED.match(t)) and not DATED.search(t)


@lru_cache(maxsize=100_000)
def parted(p: str) -> tuple[str, str, str, str, bool, bool]:
    """Of what stands between two marks: its core, what leads and trails it, the core in small letters, whether it holds
    something to read, and whether a letter."""
    core = p.strip(EDGE)
    i = p.find(core)
    letter = any(c.isalpha() for c in core)
    return core, p[:i] if core else p, p[i + len(core) :] if core else "", core.lower(), letter or "@" in core or "|" in core, letter


class Decoder:
    def __init__(self, counts: Counts):
        self.counts = counts
        self.options = lru_cache(maxsize=100_000)(self._options)
        self.cuts = lru_cache(maxsize=50_000)(self._cuts)

    def _options(self, core: str) -> list[tuple[str, float]]:
        """The known words a piece may stand for, the piece itself first."""
        lower = core.lower()
        got = [(lower, 0.0)]
        if any(c.isalpha() for c in lower) or "@" in lower or "|" in lower:
            got += [(w, c) for w, c in variants(lower).items() if w != lower and self.counts.known(w) and w.replace("-", "").replace("'", "").replace("’", "").isalpha()]
        return got

    def _cuts(self, core: str) -> list[list[int]]:
        """For each place in a piece that no word explains, the places up to which a known word goes on from there; only
        ways that lead from its begin to its end."""
        low, n = core.lower(), len(core)
        ends: list[list[int]] = [[] for _ in range(n + 1)]
        if n < 6 or not core.isalpha() or self.counts.known(low, 1) or len(self.options(core)) > 1:
            return ends
        to_end = [False] * n + [True]
        for a in range(n - 2, -1, -1):
            ends[a] = [b for b in range(a + 2, n + 1) if to_end[b] and (b - a < n) and self.counts.known(low[a:b], 5)]
            to_end[a] = bool(ends[a])
        return ends

    def decode(self, lines: list[tuple[int, str]], headers: set[int] = frozenset()) -> tuple[list[tuple[int, str]], list[str]]:
        """(repairs, paragraphs) of one reading; lines in reading order, headers the numbers of its running headers.
        Repairs: line and word, '' for furniture; words that were run together are one repair each."""
        repairs: list[tuple[int, str]] = []
        content: list[tuple[int, str]] = []
        for no, text in lines:
            t = usual(text).replace("\t", " ")
            if t.strip() and (no in headers or numbered(t)):
                repairs.append((no, ""))
            elif t.strip():
                content.append((no, t.strip()))
        # The stream between its marks: line number, characters, line, whether the mark after them is a line's end.
        pieces = [(no, p, i, j == len(ps) - 1) for i, (no, t) in enumerate(content) for ps in [t.split()] for j, p in enumerate(ps)]
        # Places in the stream: a piece and a character in it.
        beams: dict[tuple[int, int], dict[str, tuple]] = {(0, 0): {"": (0.0, None, "", "", "")}}
        score, known = self.counts.score, self.counts.known

        def step(at: tuple[int, int], to: tuple[int, int], word: str, cost: float, kind: str, shown: str) -> None:
            into = beams.get(to)
            if into is None:
                into = beams[to] = {}
            got = into.get(word)
            least = got[0] if got else math.inf
            for before, state in beams[at].items():
                total = state[0] + cost - score(before, word)
                if total < least:
                    least = total
                    into[word] = (total, at, before, kind, shown)

        for i, (no, p, li, last) in enumerate(pieces):
            at = (i, 0)
            if at not in beams:
                continue
            if len(beams[at]) > 1:
                # A word's future depends on it alone: what is worse by more than any neighbour can mend is left.
                best = min(x[0] for x in beams[at].values())
                beams[at] = {w: x for w, x in beams[at].items() if x[0] <= best + 40.0}
            core, lead, trail, low, to_read, _ = parted(p)
            if not to_read:
                step(at, (i + 1, 0), low, 0.0, "same", p)
                continue
            hyphened = last and p.endswith("-") and len(core.rstrip("-")) > 0
            if hyphened:
                step(at, (i + 1, 0), low, 2.0, "same", p)
            else:
                for w, c in self.options(core):
                    step(at, (i + 1, 0), w, c, "same" if c == 0 else "fixed", p if c == 0 else lead + like(w, core) + trail)
                ends = self.cuts(core)
                if ends[0]:
                    n = len(core)
                    for a in range(n):
                        if (i, a) not in beams:
                            continue
                        for b in ends[a]:
                            cost = SPLIT + 0.5 * (-score("", low[a:b])) if a else 0.0
                            step((i, a), (i + 1, 0) if b == n else (i, b), low[a:b], cost, "parted", (lead if a == 0 else "") + core[a:b] + (trail if b == n else ""))
            if i + 1 == len(pieces):
                continue
            nxt = pieces[i + 1][1]
            ncore, nlead, ntrail, nlow, _, letter = parted(nxt)
            if not letter or ncore[:1] != ncore[:1].lower():
                continue
            plain = not trail and core.isalpha() and ncore.isalpha()
            if last and (hyphened or plain):
                head = core.rstrip("-")
                if not hyphened and known(low, 1) and known(nlow, 1):
                    continue
                suspended = hyphened and nlow in ("en", "of", "and", "or", "und", "oder")
                for joined, extra in ((head + ncore, 0.0), (head + "-" + ncore, 0.5)) if hyphened else ((head + ncore, BROKEN),):
                    for w, c in self.options(joined):
                        real = known(w, 1)
                        if suspended and not real or not hyphened and not known(w):
                            continue
                        # An unknown whole is no less likely than its unknown halves.
                        bonus = -12.0 if hyphened and not real else 0.0
                        step(at, (i + 2, 0), w, c + extra + bonus, "broken", lead + like(w, joined) + ntrail)
            elif not last and plain and not nlead:
                # Torn within a line: only where a part is no word.
                whole = core + ncore
                if not (known(low, 5) and known(nlow, 5)) and known(whole.lower(), 5):
                    step(at, (i + 2, 0), whole.lower(), TORN, "torn", lead + whole + ntrail)
        out, at = [], (len(pieces), 0)
        if pieces and not beams.get(at):
            return repairs, []
        word = min(beams[at], key=lambda w: beams[at][w][0]) if pieces else ""
        while at != (0, 0):
            _, back, before, kind, shown = beams[at][word]
            if kind != "same":
                repairs.append((pieces[back[0]][0], word.strip(EDGE + "-")))
            out.append((pieces[back[0]][2], shown))
            at, word = back, before
        out.reverse()
        by_line: dict[int, list[str]] = {}
        for li, shown in out:
            by_line.setdefault(li, []).append(shown)
        rows = [(content[k][1], " ".join(v)) for k, v in sorted(by_line.items())]
        return repairs, paragraphs(rows)


def like(word: str, core: str) -> str:
    """The word with the capitals of what stood there."""
    return word.upper() if core.isupper() and len(core) > 1 else word[:1].upper() + word[1:] if core[:1].isupper() else word


def paragraphs(rows: list[tuple[str, str]]) -> list[str]:
    """Paragraphs from (line as it stood, its repaired text): dynamic programming over the places where one may end.
    Ending after a line costs less the shorter the line is and if it closes a sentence; each paragraph costs a little."""
    if not rows:
        return []
    wide = sorted(len(a) for a, _ in rows)[max(0, int(0.85 * len(rows)) - (len(rows) == 1))] or 1
    end = []
    for k, (a, b) in enumerate(rows):
        closed = bool(re.search(r"[.!?:…][\"'”’)]*$", a.rstrip()))
        room = 1 - min(1.0, len(a) / wide)
        greeting = a.rstrip().endswith(",") and len(a) < 0.7 * wide
        after = rows[k + 1][1][:1].isupper() if k + 1 < len(rows) else True
        long = len(a) > 120  # a line of a flowed text is a paragraph by itself
        end.append((0.0 if closed or greeting else 3.0) + (0.0 if after else 3.0) + (0.0 if long and closed else 2.0 * (1 - room) ** 2) - (1.2 if room > 0.25 or long else 0.0))
    inner = [0]
    for e in end:
        inner.append(inner[-1] + (e < 0))
    # The cost of a paragraph from i to j parts into what i and what j add, so that the best begin is carried along.
    best, back = [0.0], [0]
    begin, cheapest = 0, 0.0
    for j in range(1, len(rows) + 1):
        here = best[j - 1] - 0.35 * inner[j - 1]
        if j == 1 or here <= cheapest:
            begin, cheapest = j - 1, here
        best.append(cheapest + 0.4 + (end[j - 1] if j < len(rows) else 0.0) + 0.35 * inner[j - 1])
        back.append(begin)
    out, j = [], len(rows)
    while j > 0:
        i = back[j]
        out.append(" ".join(b for _, b in rows[i:j]))
        j = i
    return out[::-1]


def near(a: str, b: str, most: int) -> bool:
    """Whether the edit distance is at most `most`."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[j - 1] + 1))
        if min(new) > most:
            return False
        row = new
    return row[-1] <= most


def _shape(line: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(F.trim(line), CODE, "#"), r"\d", "9"))


def readings(letters: DataFrame, transcriptions: DataFrame, engine: str = "scanocr") -> DataFrame:
    """One row per reading to repair: table_name, page_id, engine, reading, lines (in order, with their numbers)."""
    le = letters.where("page_id IS NOT NULL AND text_final IS NOT NULL").select("page_id", "text_final").distinct()
    lines = F.transform(F.split("text_final", "\n"), lambda x, i: F.struct((i + 1).cast("int").alias("no"), x.alias("text")))
    a = le.select(F.lit("letters").alias("table_name"), "page_id", F.lit("final").alias("engine"), F.lit("").alias("reading"), lines.alias("lines"))
    tr = transcriptions.where((F.col("engine") == engine) & F.col("page_id").isNotNull() & F.col("text").isNotNull() & F.col("line_no").isNotNull())
    name = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("model", "prompt_version", "variant", "sample_no")])
    tr = tr.select("page_id", "engine", name.alias("reading"), F.struct(F.col("line_no").alias("no"), "text").alias("line"))
    b = tr.groupBy("page_id", "engine", "reading").agg(F.array_sort(F.collect_set("line")).alias("lines")).select(F.lit("transcriptions").alias("table_name"), "page_id", "engine", "reading", "lines")
    return a.unionByName(b)


def headers(reads: DataFrame, lines: DataFrame) -> DataFrame:
    """(table_name, page_id, engine, reading, heads): the numbers of each reading's lines that are running headers.

    A shape is a header if it stands on HEADER_PAGES pages or more, nearly always at a page's edge (its first or last two
    lines), and is none of the clean lines(line). Lines at an edge that are nearly a header's shape count as well: they
    are found by the first or the last letters that they share with it.
    """
    key = ["table_name", "page_id", "engine", "reading"]
    at = reads.select(*key, F.size("lines").alias("n"), F.posexplode("lines").alias("i", "l"))
    edge = (F.col("i") < 2) | (F.col("i") >= F.col("n") - 2)
    at = at.select(*key, F.col("l.no").alias("no"), F.col("l.text").alias("line"), edge.alias("edge")).where((F.length("line") <= HEADER_LONG) & F.col("line").rlike(r"\p{L}{2}"))
    at = cut(at.select(*key, "no", "edge", _shape(mapped(F.col("line"))).alias("shape")))  # read four times
    shapes = at.groupBy("shape").agg(F.count_distinct("page_id").alias("pages"), F.avg(F.col("edge").cast("double")).alias("at_edge"))
    shapes = shapes.where((F.col("pages") >= HEADER_PAGES) & (F.col("at_edge") >= HEADER_EDGE) & (F.length("shape") >= 6))
    # What clean texts have as a line, or nearly, is what people write at a page's head: dates, greetings.
    written = lines.where(F.length("line") <= HEADER_LONG).select("line").distinct().select(_shape(mapped(F.col("line"))).alias("w")).distinct()

    @F.pandas_udf("boolean")
    def alike(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([near(x, y, max(2, len(y) // 8)) for x, y in zip(a, b)], dtype=bool)

    ends = lambda c: F.array(F.concat(F.lit("<"), F.substring(c, 1, 4)), F.concat(F.lit(">"), F.right(F.col(c), F.lit(4))))
    close = lambda a, b: F.abs(F.length(a) - F.length(b)) <= 3
    shapes = cut(shapes.select("shape"))
    by = shapes.withColumn("k", F.explode(ends("shape")))
    wrote = written.withColumn("k", F.explode(ends("w")))
    usual_ones = by.join(wrote, "k").where(close("shape", "w")).select("shape", "w").distinct().where(alike("w", "shape")).select("shape").distinct()
    heads = cut(shapes.join(usual_ones, "shape", "left_anti"))
    exact = at.join(maybe_broadcast(heads, 100_000), "shape", "left_semi").select(*key, "no")
    rest = at.where("edge").join(maybe_broadcast(heads, 100_000), "shape", "left_anti").select("shape").distinct()
    nearly = rest.withColumn("k", F.explode(ends("shape"))).join(heads.select(F.col("shape").alias("head"), F.explode(ends("shape")).alias("k")), "k").where(close("shape", "head"))
    nearly = cut(nearly.select("shape", "head").distinct().where(alike("shape", "head")).select("shape").distinct())
    more = at.where("edge").join(maybe_broadcast(nearly, 100_000), "shape", "left_semi").select(*key, "no")
    return exact.unionByName(more).groupBy(*key).agg(F.collect_set("no").alias("heads"))


def repair(reads: DataFrame, clean: DataFrame, col: str = "text", lines: DataFrame | None = None) -> DataFrame:
    """table_name, page_id, engine, reading, repairs (line_no, word; '' for furniture) and the repaired paragraphs.

    clean: texts whose words are counted; lines(line): lines as people write them, by default those of the clean texts.
    Null lines are left out; an empty page has no paragraphs.
    """
    lines = lines if lines is not None else clean.where(F.col(col).isNotNull()).select(F.explode(F.split(col, "\n")).alias("line"))
    table = counts(clean, col)
    shared = reads.sparkSession.sparkContext.broadcast((table.words, table.pairs))

    def run(batches):
        decoder = Decoder(Counts(*shared.value))
        for b in batches:
            out = [decoder.decode([(x["no"], x["text"]) for x in lines], set() if heads is None else {int(h) for h in heads}) for lines, heads in zip(b["lines"], b["heads"])]
            yield pd.DataFrame({**{c: b[c] for c in ("table_name", "page_id", "engine", "reading")}, "repairs": [[{"line_no": n, "word": w} for n, w in o[0]] for o in out], "paragraphs": [o[1] for o in out]})

    schema = "table_name string, page_id string, engine string, reading string, repairs array<struct<line_no:int,word:string>>, paragraphs array<string>"
    key = ["table_name", "page_id", "engine", "reading"]
    # Few pages, each dear: more partitions than the scan has.
    n = max(parts(reads.sparkSession), 2 * reads.sparkSession.sparkContext.defaultParallelism)
    each = reads.repartition(n, *key).join(headers(reads, lines).repartition(n, *key), key, "left")
    return each.select(*key, "lines", "heads").mapInPandas(run, schema)


def clean_texts(documents: DataFrame, gold: DataFrame, transcriptions: DataFrame) -> DataFrame:
    """The archive's clean texts: documents, checked pages and the reference reading's lines."""
    ref = transcriptions.where((F.col("engine") == "local") & (F.col("sample_no") == 0)).groupBy("page_id", "model", "prompt_version", "variant").agg(F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("line_no", "text"))), lambda x: x["text"]), "\n").alias("text"))
    return documents.select("text").unionByName(gold.select(F.col("gold_text").alias("text"))).unionByName(ref.select("text"))


def clean_lines(gold: DataFrame, transcriptions: DataFrame) -> DataFrame:
    """(line): the lines of checked pages and of reference readings."""
    ref = transcriptions.where("engine = 'local' AND sample_no = 0 AND text IS NOT NULL").select(F.col("text").alias("line"))
    return gold.where("gold_text IS NOT NULL").select(F.explode(F.split("gold_text", "\n")).alias("line")).unionByName(ref)


def found(letters: DataFrame, transcriptions: DataFrame, documents: DataFrame, gold: DataFrame) -> DataFrame:
    """p2_found: every repair needed, one row each."""
    r = repair(readings(letters, transcriptions), clean_texts(documents, gold, transcriptions), lines=clean_lines(gold, transcriptions))
    return r.select("table_name", "page_id", "engine", F.explode("repairs").alias("x")).select("table_name", "page_id", "engine", "x.line_no", "x.word").distinct()
