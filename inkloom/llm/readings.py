"""Readings of one page aligned to its pivot reading; the ground of the consensus and of the search for cut lines."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkloom.llm.forms import usual
from inkloom.session import cut, maybe_broadcast

KEYS = ["page_id", "engine", "model", "prompt_version", "variant", "sample_no"]
#: Rows of one page that share one copy of its pivot; pages with more get several copies, so that no task holds all.
SHARE = 10_000
ILLEGIBLE = "[?]"
_edges = re.compile(r"^[^\w]+|[^\w]+$")


def bare(word: str) -> str:
    """A word without the signs at its edges."""
    return _edges.sub("", word)


def tokens(text: str) -> list[str]:
    """The words to compare: usual characters, lower case, no punctuation at the edges; "[?]" stays as "?"."""
    out = []
    for w in usual(text).lower().split():
        if ILLEGIBLE in w:
            out.append("?")
        elif c := bare(w):
            out.append(c)
    return out


def alike(a: str, b: str) -> float:
    """Likeness of two words by their common beginning and end, 0 to 1."""
    if a == b:
        return 1.0
    n = min(len(a), len(b))
    i = 0
    while i < n and a[i] == b[i]:
        i += 1
    j = 0
    while j < n - i and a[-1 - j] == b[-1 - j]:
        j += 1
    return (i + j) / max(len(a), len(b))


def overlap(a: list[str], b: list[str]) -> float:
    """Share of common words of two lines; of short lines, the likeness of their letters."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    sb = set(b)
    k = sum(w in sb for w in a)
    x = 2 * k / (len(a) + len(b))
    if len(b) < len(a):
        x = max(x, 0.9 * k / len(b)) if k >= 2 else x
    if x < 0.5 and (len(a) <= 3 or len(b) <= 3):
        x = max(x, alike(" ".join(a), " ".join(b)))
    return x


def align_lines(ref: list[list[str]], hyp: list[list[str]], least: float = 0.35) -> list[int | None]:
    """For each line of hyp the index of the ref line that it reads, in order, or None."""
    n, m = len(ref), len(hyp)
    if n == m and all(overlap(a, b) >= 0.5 for a, b in zip(ref, hyp)):
        return list(range(n))
    score = [[0.0] * (m + 1) for _ in range(n + 1)]
    sim = [[0.0] * m for _ in range(n)]
    slack = abs(n - m) + 8
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            if abs(i - j) <= slack:
                s = overlap(ref[i], hyp[j])
                sim[i][j] = s if s >= least else 0.0
            score[i][j] = max(score[i + 1][j], score[i][j + 1], (score[i + 1][j + 1] + sim[i][j]) if sim[i][j] else 0.0)
    out: list[int | None] = [None] * m
    i = j = 0
    while i < n and j < m:
        if sim[i][j] and score[i][j] == score[i + 1][j + 1] + sim[i][j]:
            out[j] = i
            i, j = i + 1, j + 1
        elif score[i + 1][j] >= score[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def align_words(r: list[str], h: list[str], stops: bool = False) -> list[tuple[int, int]]:
    """Edit path of two word lists: pairs (i, j); -1 where a word has no partner. stops: to stop before the other's end
    costs less than to leave words out, and so does a last word that is the beginning of the other's."""
    n, m = len(r), len(h)
    a, b = 0, 0
    while a < min(n, m) and r[a] == h[a]:
        a += 1
    while b < min(n, m) - a and r[n - 1 - b] == h[m - 1 - b]:
        b += 1
    x, y = r[a : n - b], h[a : m - b]
    head, tail = [(k, k) for k in range(a)], [(n - b + k, m - b + k) for k in range(b)]
    if not x or not y:
        return head + [(a + k, -1) for k in range(len(x))] + [(-1, a + k) for k in range(len(y))] + tail
    last_x, last_y = len(x) if not b else -1, len(y) if not b else -1
    out_x = [0.45 if stops and j == last_y else 0.7 for j in range(len(y) + 1)]  # to leave out a word of x at column j
    out_y = [0.45 if stops and i == last_x else 0.7 for i in range(len(x) + 1)]

    def change(i: int, j: int) -> float:
        u, v = x[i], y[j]
        if u == v:
            return 0.0
        if u == "?" or v == "?":
            return 0.5
        c = 1.25 - alike(u, v)
        if stops:
            if j + 1 == last_y and u.startswith(v) or i + 1 == last_x and v.startswith(u):
                return min(c, 0.3)
            if j + 1 == last_y and i + 1 == last_x:
                return min(c, 1.0)
        return c

    cost = [[0.0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in range(len(x)):
        cost[i + 1][0] = cost[i][0] + out_x[0]
    for j in range(len(y)):
        cost[0][j + 1] = cost[0][j] + out_y[0]
    subs = [[change(i, j) for j in range(len(y))] for i in range(len(x))]
    for i in range(len(x)):
        row, nxt, sub, oy = cost[i], cost[i + 1], subs[i], out_y[i + 1]
        for j in range(len(y)):
            nxt[j + 1] = min(row[j] + sub[j], nxt[j] + oy, row[j + 1] + out_x[j + 1])
    mid: list[tuple[int, int]] = []
    i, j = len(x), len(y)
    while i or j:
        c = cost[i][j]
        if i and j and abs(c - cost[i - 1][j - 1] - subs[i - 1][j - 1]) < 1e-9:
            mid.append((a + i - 1, a + j - 1))
            i, j = i - 1, j - 1
        elif i and abs(c - cost[i - 1][j] - out_x[j]) < 1e-9:
            mid.append((a + i - 1, -1))
            i -= 1
        else:
            mid.append((-1, a + j - 1))
            j -= 1
    return head + mid[::-1] + tail


def compare(r: list[str], h: list[str]) -> tuple[list[tuple[int, str | None]], int, int, bool]:
    """(differences, delta, words, within) of a reading's line h against the pivot's line r.

    A difference is (slot, label): word k of r has slot 2k+1, the gap before it 2k; the label is what h has there, ''
    for nothing, None where h says nothing ("[?]", or h stops before). delta: characters that h goes on beyond r's end
    (negative: r beyond h's); words: how many words that are; within: whether the shorter one stops within a word.
    """
    if r == h:
        return [(2 * k + 1, None) for k, w in enumerate(r) if w == "?"] if "?" in r else [], 0, 0, False
    path = align_words(r, h)
    n, m = len(r), len(h)
    diffs: list[tuple[int, str | None]] = []
    gap: dict[int, list[str]] = {}
    at = 0
    for i, j in path:
        if i >= 0:
            at = i + 1
            if j < 0:
                diffs.append((2 * i + 1, ""))
            elif h[j] == "?" or r[i] == "?" and h[j] == r[i]:
                diffs.append((2 * i + 1, None))
            elif h[j] != r[i]:
                diffs.append((2 * i + 1, h[j]))
        else:
            gap.setdefault(at, []).append(h[j])
    delta, extra, within, lost, last_r = _ends(path, r, h)
    # A reading that stops early says nothing about what follows.
    if lost >= 2 or (within and delta < 0):
        first = 2 * (last_r if within else last_r + 1) + (1 if within else 0)
        diffs = [(s, None if s >= first else label) for s, label in diffs]
    return diffs + [(2 * k, " ".join(w for w in ws if w != "?") or None) for k, ws in gap.items()], delta, extra, within


def _ends(path: list[tuple[int, int]], r: list[str], h: list[str]) -> tuple[int, int, bool, int, int]:
    """(delta, words, within, words lost, last word of r that h reads) of an edit path; see compare()."""
    n, m = len(r), len(h)
    k = len(path)
    while k and path[k - 1][1] < 0:
        k -= 1
    lost = len(path) - k
    g = len(path)
    while g and path[g - 1][0] < 0:
        g -= 1
    more = len(path) - g
    last_r, last_h = (path[k - 1] if lost and k else path[g - 1] if more and g else path[-1]) if path else (-1, -1)
    within, delta, extra = False, 0, 0
    if last_r >= 0 and last_h >= 0 and r[last_r] != h[last_h]:
        a, b = r[last_r], h[last_h]
        if last_h == m - 1 and a.startswith(b) or last_h == m - 1 and lost and alike(a[: len(b)], b) > 0.7 and len(b) < len(a):
            within, delta = True, len(b) - len(a)
        elif last_r == n - 1 and b.startswith(a) or last_r == n - 1 and more and alike(b[: len(a)], a) > 0.7 and len(a) < len(b):
            within, delta = True, len(b) - len(a)
    if lost:
        ws = [r[i] for i, _ in path[k:]]
        delta, extra = min(delta, 0) - sum(len(w) + 1 for w in ws), len(ws)
    elif more:
        ws = [h[j] for _, j in path[g:]]
        delta, extra = max(delta, 0) + sum(len(w) + 1 for w in ws), len(ws)
    return delta, extra, within, lost, last_r


def unparted(a: list[str], b: list[str]) -> list[str]:
    """a with two neighbours as one word where b has that word, or at the end one that begins so."""
    known, out, i = set(b), [], 0
    while i < len(a):
        if i + 1 < len(a) and (w := a[i] + a[i + 1]) not in ("", a[i]) and a[i] not in known and (w in known or i + 2 == len(a) and any(x.startswith(w) for x in b)):
            out.append(w)
            i += 2
        else:
            out.append(a[i])
            i += 1
    return out


def ending(r: list[str], h: list[str]) -> tuple[int, int, bool]:
    """(delta, words, within) as in compare(); words parted by a stray space are put together, a last word that is the
    beginning of the other's counts as that, and to stop early is cheaper than to read something else."""
    if r == h:
        return 0, 0, False
    r, h = unparted(r, h), unparted(h, r)
    return _ends(align_words(r, h, stops=True), r, h)[:3]


def grouped(transcriptions: DataFrame) -> DataFrame:
    """One row per reading with its lines in order: KEYS, nos, texts. Repeated deliveries count once; of different texts
    for one line the first by code point stands. Rows without page_id, line_no or text are left out."""
    t = transcriptions.where("page_id IS NOT NULL AND line_no IS NOT NULL AND text IS NOT NULL")
    # One shuffle: a reading's lines travel as one array, collected where they are read.
    g = t.groupBy(*KEYS).agg(F.array_sort(F.collect_set(F.struct("line_no", "text"))).alias("x"))
    first = F.filter("x", lambda l, i: (i == 0) | (l["line_no"] != F.try_element_at("x", F.greatest(i, F.lit(1)))["line_no"]))
    return g.select(*KEYS, first.alias("x")).select(*KEYS, F.col("x.line_no").alias("nos"), F.col("x.text").alias("texts"))


def with_pivot(transcriptions: DataFrame, engine: str = "local", sample_no: int = 0) -> DataFrame:
    """Every reading with its page's pivot (p_nos, p_texts), the number of the page's readings (n) and whether the pivot
    is the reference reading (is_ref). The pivot is the reference reading or else the page's first by key."""
    g = grouped(transcriptions)
    key = F.xxhash64(*KEYS)
    ref = F.coalesce((F.col("engine") == engine) & (F.col("sample_no") == sample_no), F.lit(False))
    order = F.struct(~ref, *[F.col(c) for c in KEYS[1:]])
    pivot = g.groupBy("page_id").agg(F.min_by(F.struct(key.alias("p_key"), F.col("nos").alias("p_nos"), F.col("texts").alias("p_texts"), ref.alias("is_ref")), order).alias("p"), F.count("*").alias("n"))
    # Only pages with very many rows need copies of their pivot; there are few of them, which is checked.
    rows = transcriptions.where("page_id IS NOT NULL").groupBy("page_id").agg(F.ceil(F.count("*") / SHARE).cast("int").alias("copies"))
    hot = maybe_broadcast(cut(rows.where("copies > 1")), 100_000)
    last = F.coalesce(F.col("copies"), F.lit(1)) - 1
    pivot = pivot.join(hot, "page_id", "left").select("page_id", "p.*", "n", F.explode(F.sequence(F.lit(0), last)).alias("copy"))
    g = g.join(hot, "page_id", "left").withColumn("copy", F.pmod(key, last + 1).cast("int")).drop("copies")
    return g.withColumn("is_pivot_key", key).join(pivot, ["page_id", "copy"]).withColumn("is_pivot", F.col("is_pivot_key") == F.col("p_key")).drop("copy", "is_pivot_key", "p_key")


def whole(x) -> int | None:
    """A number of a batch as an int; a batch with nulls holds floats."""
    return None if x is None or x != x else int(x)


def each_batch(b: pd.DataFrame, memo: dict):
    """For every reading of a batch: (row, the pivot's words by line, its own words by line, the ref index of each own
    line). Equal pivots and lines of a batch are prepared once."""
    for row in b.itertuples(index=False):
        pk = ("p", row.page_id)
        if len(memo) > 50_000:
            memo.clear()
        if pk not in memo:
            memo[pk] = [tokens(t) for t in row.p_texts]
        ref = memo[pk]
        hyp = ref if row.is_pivot else [tokens(t) for t in row.texts]
        yield row, ref, hyp, list(range(len(ref))) if row.is_pivot else align_lines(ref, hyp)
