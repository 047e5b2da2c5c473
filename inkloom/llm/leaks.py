"""Evaluation passages that got into a corpus (problem 9).

Method: pigeonhole edit matching. A passage of n words may have k = n / 10 changed words, the error budget. The changes
cut it into k+1 runs, of which one has at least (n-k)/(k+1) words unchanged: for every n from LEAST on that is PIECE
words or more. So every run of PIECE words of every item is a piece, a passage can't be without an exact piece hit, and
each hit is a seed. From its seed the match is extended word by word in both directions over the letter streams; a word
that differs is measured with Myers' bit-parallel distance and the stream picks up again at the item's next words. The
longest stretch of LEAST words or more within the budget is then verified whole: Myers' distance of its letters to the
document's must be within what its budget of words allows.

Documents are compared as streams of letters and digits in usual characters and lower case, so that case, punctuation,
line breaks, hyphenation and stored character forms don't count. The items are the query set: they are collected behind
a check of their size; documents are only scanned and never shuffled.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkloom.llm.forms import usual

LEAST, SHARE = 14, 10
#: Words of a piece: the least that any passage must have unchanged in a row.
PIECE = min(-(-(n - n // SHARE) // (n // SHARE + 1)) for n in range(LEAST, 40 * SHARE))
#: Characters of all items that one broadcast holds; a larger item set is matched in blocks of this size.
BLOCK_CHARS = 20_000_000
_word = re.compile(r"[^\W_]+")


def stream(text: str) -> str:
    """The letters and digits of a text, in usual characters, lower case, without accents."""
    t = usual(text).lower()
    if not t.isascii():
        t = "".join(c for c in unicodedata.normalize("NFD", t) if not unicodedata.combining(c))
        return "".join(c for c in t if c.isalnum())
    return "".join(_word.findall(t))


def words(text: str) -> list[str]:
    """The item's words as they stand in its stream: a hyphen or apostrophe within a word doesn't part it."""
    joined = re.sub(r"(?<=\w)[-'’‐‑­]\s*(?=\w)", "", usual(text))
    return [w for w in (stream(x) for x in joined.split()) if w]


def myers(pattern: str, text: str) -> tuple[int, int]:
    """Least edit distance of the pattern to a prefix of the text, and that prefix's length (bit-parallel, after Myers
    in Hyyro's form with the text's start fixed)."""
    m = len(pattern)
    if not m:
        return 0, 0
    peq: dict[str, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        peq[c] |= 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    best, at = m, 0
    for j, c in enumerate(text):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv)
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = (ph << 1) | 1  # the prefix's start is fixed: row 0 grows with the text
        mh = mh << 1
        pv = (mh | ~(xv | ph)) & full
        mv = ph & xv & full
        if score < best:
            best, at = score, j + 1
    return best, at


def distance(pattern: str, text: str) -> int:
    """Edit distance of two strings (bit-parallel, both ends fixed)."""
    if not pattern:
        return len(text)
    peq: dict[str, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        peq[c] |= 1 << i
    full, top = (1 << len(pattern)) - 1, 1 << (len(pattern) - 1)
    pv, mv, score = full, 0, len(pattern)
    for c in text:
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv)
        mh = pv & xh
        score += bool(ph & top) - bool(mh & top)
        ph, mh = (ph << 1) | 1, mh << 1
        pv = (mh | ~(xv | ph)) & full
        mv = ph & xv & full
    return score


def _extend(item: list[str], i: int, doc: str, p: int) -> list[tuple[bool, int]]:
    """From item word i (not yet matched) and stream position p on: for each next word whether it is as it was, and the
    position after it, until the passage has too many changes to be one."""
    out: list[tuple[bool, int]] = []
    bad = 0
    n = len(item)
    while i < n:
        w = item[i]
        if doc.startswith(w, p):
            p += len(w)
            out.append((True, p))
            i += 1
            continue
        # A changed word, or a few: the stream must pick up again at the item words that follow.
        d, used = myers(w, doc[p : p + 2 * len(w) + 2])
        at, skip = -1, 1
        while at < 0 and skip <= 3 and i + skip < n:
            follow = "".join(item[i + skip : i + skip + 2])
            at = doc.find(follow, p, p + sum(map(len, item[i : i + skip])) + 24 + len(follow))
            skip += at < 0
        if at < 0:
            skip = 1
            if d <= max(1, len(w) // 3):
                if i + 1 < n and doc.startswith(item[i + 1][:3], p + used):
                    at = p + used
                elif i + 1 == n:
                    out.append((False, p + used))
                    break
        bad += skip
        if at < 0 or bad > 3 + len(out) // 8:
            break
        out += [(False, at)] * skip
        p = at
        i += skip
    return out


def longest(flags: list[bool]) -> tuple[int, int]:
    """(begin, end) of the longest stretch of words of which at most one in SHARE is changed."""
    n, best = len(flags), (0, 0)
    sums = [0]
    for f in flags:
        sums.append(sums[-1] + (not f))
    for a in range(n):
        for b in range(n, a + best[1] - best[0], -1):
            if SHARE * (sums[b] - sums[a]) <= b - a:
                best = (a, b)
                break
    return best


class Matcher:
    def __init__(self, items: list[tuple[int, str]]):
        import ahocorasick

        self.items = {k: words(t) for k, t in items}
        self.back = {k: [w[::-1] for w in reversed(ws)] for k, ws in self.items.items()}
        pieces: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for k, ws in self.items.items():
            for i in range(max(1, len(ws) - PIECE + 1) if ws else 0):
                pieces["".join(ws[i : i + PIECE])].append((k, i))
        self.machine = ahocorasick.Automaton() if pieces else None
        for p, where in pieces.items():
            self.machine.add_word(p, (len(p), where))
        if pieces:
            self.machine.make_automaton()

    @staticmethod
    def _within(passage: list[str], text: str) -> bool:
        """Whether the text's letters are as near to the passage's as its budget of changed words allows: those with most
        letters replaced by others, which may be a little longer."""
        k = len(passage) // SHARE
        return distance("".join(passage), text) <= sum(sorted(map(len, passage))[len(passage) - k :]) + 8 * k

    def match(self, text: str) -> dict[int, int]:
        """Per item the words of its longest passage in the text, where it is long enough to be a case."""
        found: dict[int, int] = {}
        if not self.machine:
            return found
        doc = stream(text)
        rev = None
        done: dict[tuple[int, int], int] = {}
        for end, (size, where) in self.machine.iter(doc):
            begin = end - size + 1
            for k, i in where:
                ws = self.items[k]
                # A seed inside the item words that a passage already found covers needs no second look.
                offset = begin - sum(map(len, ws[:i]))
                n = min(PIECE, len(ws) - i)
                if i + n <= done.get((k, offset), 0):
                    continue
                right = _extend(ws, i + n, doc, end + 1)
                rev = rev if rev is not None else doc[::-1]
                left = _extend(self.back[k], len(ws) - i, rev, len(doc) - begin)
                # The chain's words, and where each begins and ends in the stream.
                edges = [len(doc) - p for _, p in reversed(left)] + [begin + sum(map(len, ws[i : i + m])) for m in range(n + 1)] + [p for _, p in right]
                chain = [f for f, _ in reversed(left)] + [True] * n + [f for f, _ in right]
                a, b = longest(chain)
                if b - a < LEAST or not self._within(ws[i - len(left) + a : i - len(left) + b], doc[edges[a] : edges[b]]):
                    continue
                done[k, offset] = i + n + len(right)
                found[k] = max(b - a, found.get(k, 0))
        return found


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, item_id, n_words): the documents that hold a passage of an item, and the passage's length in words.

    Null or empty texts match nothing; repeated documents count each; an item shorter than LEAST words can't be a case.
    """
    rows = items.select("item_id", "text").where("item_id IS NOT NULL AND text IS NOT NULL").distinct()
    blocks = rows.select(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()["n"] // BLOCK_CHARS + 1
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    out = None
    for block in range(blocks):
        mine = [(r["item_id"], r["text"]) for r in rows.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).collect()]
        shared = docs.sparkSession.sparkContext.broadcast(mine)

        def run(batches, shared=shared):
            m = Matcher(shared.value)
            for b in batches:
                hits = [(d, k, n) for d, t in zip(b["doc_id"], b["text"]) for k, n in m.match(t).items()]
                yield pd.DataFrame(hits, columns=["doc_id", "item_id", "n_words"])

        part = d.mapInPandas(run, "doc_id bigint, item_id bigint, n_words int")
        out = part if out is None else out.unionByName(part)
    return out.groupBy("doc_id", "item_id").agg(F.max("n_words").alias("n_words"))


def found(docs: DataFrame, items: DataFrame) -> DataFrame:
    """p9_found: document and item of every leak."""
    return contaminated(docs, items).select("doc_id", "item_id")
