"""Freely typed values mapped to the entries of a reference list (problem 5).

Method: a symmetric-delete dictionary of the list's terms, broadcast (its size is checked), gives for every different
typed value the entries within a bounded edit distance; they are ranked by weighted Damerau-Levenshtein distance, then
by how often an entry is meant literally. Values that no entry explains are reported as misses.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from itertools import combinations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkloom.llm.forms import usual
from inkloom.session import maybe_broadcast, parts

#: More entries than this don't go into one broadcast dictionary; raise it with the executors' memory.
MOST_TERMS = 200_000
#: Deletions per side of the symmetric-delete index.
DELETES = 2
#: Highest weighted distance for each letter of the entry, at least LEAST.
SHARE, LEAST = 0.24, 1.0
# Words around a term that don't belong to it, in Dutch and English.
BEFORE = {"te", "in", "bij", "nabij", "near", "kamp", "camp", "at", "een", "de", "het", "the", "a", "an", "our", "my", "mijn", "onze", "prob", "probably", "wsch", "vermoedelijk", "ca", "omg", "den", "der", "naar", "station", "his", "her", "their", "zijn", "haar", "hun", "former", "late", "oud", "wijlen", "rond", "om", "uit", "from", "to", "omstreken"}
AFTER = {"stad", "city", "eo", "omgeving", "once", "prob", "probably", "eenmaal", "kamp", "camp", "town", "dorp", "sr", "jr", "ret"}


def plain(text: str) -> str:
    """Lower case, usual characters, no accents, single spaces; brackets and what stands in them dropped."""
    t = usual(text)
    t = re.sub(r"\([^)]*\)?|\[[^\]]*\]?", " ", t)
    t = "".join(c for c in unicodedata.normalize("NFD", t.lower()) if not unicodedata.combining(c))
    t = re.sub(r"\be\.\s?o\.?", " eo ", t)
    return re.sub(r"\s+", " ", re.sub(r"[^a-z0-9'. -]", " ", t)).strip(" -?!,;:'")


def letters(t: str) -> str:
    """Only letters and digits, so that stray spaces and hyphens inside a word don't count."""
    return re.sub(r"[^a-z0-9]", "", t)


def distance(a: str, b: str, most: float) -> float:
    """Damerau-Levenshtein distance with weights: a doubled or undoubled letter, a swap of neighbours and a sound-alike
    cost less than another edit. Above `most` any larger number."""
    if abs(len(a) - len(b)) * 0.5 > most:
        return 99.0
    alike = {("s", "z"), ("z", "s"), ("f", "v"), ("v", "f"), ("d", "t"), ("t", "d"), ("i", "y"), ("y", "i"), ("k", "c"), ("c", "k"), ("g", "h")}
    before: list[float] = []
    row = [0.0]
    for j in range(1, len(b) + 1):
        row.append(row[-1] + (0.5 if j > 1 and b[j - 1] == b[j - 2] else 1.0))
    for i in range(1, len(a) + 1):
        new = [row[0] + (0.5 if i > 1 and a[i - 1] == a[i - 2] else 1.0)]
        for j in range(1, len(b) + 1):
            x, y = a[i - 1], b[j - 1]
            c = min(
                row[j - 1] + (0.0 if x == y else 0.8 if (x, y) in alike else 1.0),
                row[j] + (0.5 if i > 1 and a[i - 2] == x else 1.0),
                new[j - 1] + (0.5 if j > 1 and b[j - 2] == y else 1.0),
            )
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y and x != y:
                c = min(c, before[j - 2] + 0.8)
            new.append(c)
        if min(new) > most:
            return 99.0
        before, row = row, new
    return row[-1]


def deletes(word: str, most: int = DELETES):
    """The word and all that remains of it after up to `most` deletions."""
    yield word
    for k in range(1, min(most, len(word) - 1) + 1):
        for gone in combinations(range(len(word)), k):
            yield "".join(c for i, c in enumerate(word) if i not in gone)


class Dictionary:
    """The list's entries of one kind, with the symmetric-delete index of their spellings' halves and wholes."""

    def __init__(self, entries: list[tuple[int, str, int]]):
        """entries: (term_id, spelling, frequency)."""
        self.spellings: dict[str, tuple[int, int]] = {}
        for term, text, n in entries:
            if (k := letters(plain(text))) and (k not in self.spellings or (n, -term) > (self.spellings[k][1], -self.spellings[k][0])):
                self.spellings[k] = (term, n)
        most = max(map(len, self.spellings), default=0)
        #: A longer value is further from every entry than any bound; the cheapest edit costs half.
        self.longest = most + 2 * max(LEAST, SHARE * most)
        self.index = defaultdict(set)
        for k in self.spellings:
            for d in self.keys(k):
                self.index[d].add(k)
        self.prefixes = defaultdict(set)
        for k in self.spellings:
            for n in range(3, len(k)):
                self.prefixes[k[:n]].add(k)

    @staticmethod
    def keys(k: str):
        """Deletions of the whole if it is short; of each half if it is long: of up to five edits, one half has at most
        two, so that long words with many edits are found without deleting five letters of the whole. Doubled letters
        cost half, so that there may be more of them: the form with single letters only has keys of its own."""
        yield from (("s", d) for d in deletes(re.sub(r"(.)\1+", r"\1", k)))
        if len(k) <= 9:
            yield from (("w", d) for d in deletes(k))
            return
        h = len(k) // 2
        for cut in (h - 2, h - 1, h, h + 1, h + 2):
            yield from (("a", d) for d in deletes(k[:cut]))
            yield from (("b", d) for d in deletes(k[cut:]))
        yield from (("w", d) for d in deletes(k))

    def look(self, k: str) -> tuple[int, float] | None:
        """The closest entry of a stripped value and its distance, or None."""
        if not k or len(k) > self.longest:
            return None
        if k in self.spellings:
            return self.spellings[k][0], 0.0
        near = set()
        for d in self.keys(k):
            near |= self.index.get(d, set())
        best = None
        for s in sorted(near):
            most = max(LEAST, SHARE * len(s))
            if (x := distance(k, s, most)) <= most:
                term, n = self.spellings[s]
                if best is None or (x, -n, term) < best[0]:
                    best = ((x, -n, term), term, x)
        return (best[1], best[2]) if best else None

    def find(self, typed: str) -> int:
        """The term_id that a typed value stands for, or -1."""
        t = plain(typed)
        words = t.split()
        if not words:
            return -1
        forms = [t]
        core = list(words)
        while len(core) > 1 and letters(core[0]) in BEFORE:
            core = core[1:]
            forms.append(" ".join(core))
        while len(core) > 1 and letters(core[-1]) in AFTER:
            core = core[:-1]
            forms.append(" ".join(core))
        got = [(g[1], i, g[0]) for i, f in enumerate(forms) if (g := self.look(letters(f)))]
        if got:
            return min(got)[2]
        for f in forms:
            f = f.rstrip()
            # An abbreviation: its words begin the entry's words, or it begins exactly one entry.
            if "." in f and len(k := letters(f)) >= 3:
                hits = {self.spellings[s][0] for s in self.prefixes.get(k, ())} if len(k) >= 4 else set()
                if len(hits) == 1:
                    return hits.pop()
                parts = [letters(w) for w in re.split(r"[ .-]+", f) if letters(w)]
                pattern = re.compile("".join(map(re.escape, parts[:1])) + "".join(f".*{re.escape(p)}" for p in parts[1:]))
                hits = {self.spellings[s][0] for s in self.prefixes.get(parts[0], ()) if pattern.match(s)} if len(parts) > 1 and len(parts[0]) >= 3 else set()
                if len(hits) == 1:
                    return hits.pop()
        return -1


def link(values: DataFrame, terms: DataFrame) -> DataFrame:
    """values(kind, typed) distinct -> (kind, typed, term_id), -1 for misses.

    terms(term_id, kind, term, alt_terms). The dictionary is broadcast only after its size has been checked; a larger
    list is an error rather than a silent truncation. Null or empty typed values give no row.
    """
    values = values.where(F.col("typed").isNotNull() & (F.col("typed") != ""))
    spelled = terms.where(F.col("term").isNotNull()).select("term_id", "kind", F.explode(F.array_union(F.array("term"), F.coalesce("alt_terms", F.array().cast("array<string>")))).alias("text"))
    counted = spelled.join(values.groupBy("kind", F.col("typed").alias("text")).agg(F.sum("n").alias("n")), ["kind", "text"], "left").fillna(0, ["n"])
    rows = counted.limit(MOST_TERMS + 1).collect()
    if len(rows) > MOST_TERMS:
        raise ValueError(f"the reference list has more than {MOST_TERMS} spellings; raise MOST_TERMS with the executors' memory")
    by: dict[str, list] = defaultdict(list)
    for r in rows:
        by[r["kind"]].append((r["term_id"], r["text"], r["n"]))
    shared = values.sparkSession.sparkContext.broadcast(dict(by))

    def run(batches):
        books = {k: Dictionary(v) for k, v in shared.value.items()}
        for b in batches:
            b["term_id"] = [books[k].find(t) if k in books else -1 for k, t in zip(b["kind"], b["typed"])]
            yield b[["kind", "typed", "term_id"]]

    # Few values, each dear: spread by number and by a hash of their own, which the session doesn't merge into few tasks.
    n = max(parts(values.sparkSession), 2 * values.sparkSession.sparkContext.defaultParallelism)
    each = values.select("kind", "typed").distinct().repartition(n, F.xxhash64("typed", "kind"))
    return each.mapInPandas(run, "kind string, typed string, term_id bigint")


def found(entities: DataFrame, terms: DataFrame) -> DataFrame:
    """p5_found: the entry each typed place or role stands for, -1 if none; values that are literally a term give no row."""
    e = entities.where(F.col("letter_id").isNotNull())
    pick = lambda kind, of, field: e.where(F.col("kind") == of).select("letter_id", F.lit(kind).alias("kind"), F.lit(field).alias("field"), F.col(field).alias("typed"))
    rows = pick("place", "place", "name").unionByName(pick("place", "place", "detail")).unionByName(pick("role", "person", "detail"))
    rows = rows.where(F.col("typed").isNotNull() & (F.col("typed") != "")).distinct()
    literal = terms.select("kind", F.col("term").alias("typed")).distinct()
    linked = link(rows.groupBy("kind", "typed").agg(F.count("*").alias("n")), terms).join(maybe_broadcast(literal, MOST_TERMS), ["kind", "typed"], "left_anti")
    return rows.join(linked, ["kind", "typed"]).select("letter_id", "kind", "field", "typed", "term_id")
