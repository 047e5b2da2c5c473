"""Variant spellings of the names of persons and firms, linked within a collection (problem 1).

Method: suffix blocking. The family-name tokens of a collection are indexed by their suffixes (and, as typos also fall
on the last letters, by the suffixes of the reversed token) above a minimum length. A suffix that is shared by too many
is not discarded at once: its block is first refined by what else the names share, a pair of letters of the rest and the
length. Names with mistakes near both ends share no suffix; they meet by what is left after as many deletions as two
like names can need. Pairs within a block are compared by the ratio of their longest common subsequence; a rare spelling
joins the best supported one that is close enough. Within a family the given names (short forms, initials, abbreviations, none) and
what the archive's own canonical column says decide who is meant.

No list of given names or trades is typed in. Which given name is short for which is learned from the archive: pairs
that name and canonical set equal in several families. Spelling mistakes of given names are found by the same suffix
blocking. Trades are the words that stand in firms' names all over the archive.

A family's different spellings in one collection are one small group; rows are counted into spellings before, so that a
collection with a third of all rows brings no more than its different spellings. What is learned stays in tables that
are joined; nothing is collected.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from functools import lru_cache
from itertools import combinations

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkloom.llm.forms import usual
from inkloom.session import cut, maybe_broadcast, parts

MIN_SUFFIX = 3
#: Members of a suffix block beyond which it is refined by the pairs of letters of the rest.
COMMON = 60
RATIO = 0.8
#: Collections, in proportion to a spelling's own, in which a name stands of which the spelling is a mistake, not a name.
ATTESTED = 8
#: Families in which two given names must stand for one another, and the share of the best partner's that another needs.
LEARNED, BESIDE = 2, 0.25
#: Collections in which a trade must stand with a firm's mark, and the share of its spellings that carry one.
TRADE_PLACES, TRADE_SHARE = 3, 0.3
# Titles, particles and firm marks as they stand in names, and the endings of Dutch trades.
TITLES = set("dr drs ds mr ir ing prof mej mevr mw juffr juf kapt kap luit lt serg sgt maj kol korp gen zr zuster br broeder past pastoor pater heer hr dhr mrs miss ms sir rev capt frau herr zus oom tante wed".split())
PARTICLES = set("van v de den der d ter t te ten vd vdd vander vanden vande het 't la le von zu of".split())
FIRM = set("fa firma gebr gebrs gebroeders nv n.v bv zn zonen zoon co cie comp en & und and".split())
MARKS = set("fa firma gebr gebrs gebroeders nv n.v bv zn zonen cie".split())
TRADE_ENDS = ("erij", "handel", "fabriek")
_word = re.compile(r"[^\s,()]+|,")
_doubled = re.compile(r"(.)\1+")
_alike = str.maketrans("zfc", "svk")
_joined = re.compile(r"\b[vV]\s*[./]\s*[dD]\b\.?")


def fold(s: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", usual(s).lower()) if not unicodedata.combining(c))


def pieces(s: str) -> tuple[list[str], list[str], bool]:
    """(tokens, the same as typed, whether all is in capitals) of a name."""
    raw = usual(s).replace("’", "'")
    toks = _word.findall(_joined.sub(" vd ", fold(raw)).replace("'t ", " t "))
    orig = _word.findall(_joined.sub(" vd ", raw).replace("'t ", " t "))
    return toks, orig if len(orig) == len(toks) else toks, raw.upper() == raw


def parse(s: str, trades: dict[str, str]) -> tuple[str, list[str], str, bool, bool]:
    """(family name, given names, title or trade, firm?, given or family part certain?) of a name as typed.

    trades: tokens of this name that are a trade, in full or cut short, with the trade in full."""
    toks, orig, caps = pieces(s)
    marks = [w.strip(".") for w in toks]
    trade = {w: trades.get(w) or (w.strip(".") if len(w.strip(".")) > 6 and w.strip(".").endswith(TRADE_ENDS) else None) for w in toks}
    named = [t for w in toks if (t := trade[w])]
    if named or any(m in MARKS for m in marks):
        core = [w.strip(".,'") for w, m in zip(toks, marks) if w != "," and m not in FIRM and m not in PARTICLES and not trade[w]]
        return " ".join(core[-1:]) if core else "", core[:-1], named[0] if named else "", True, True
    title, core, comma = "", [], None
    particle_at = None
    for w, o in zip(toks, orig):
        if w == ",":
            comma = len(core)
            continue
        m = w.strip(".'")
        if not m or not any(c.isalpha() for c in m):
            continue
        if m in TITLES and (not core or comma is not None) and not (len(m) <= 2 and w == m and m in ("br",)):
            title = title or m
            continue
        if m in PARTICLES and not (len(m) == 1 and o[:1].isupper() and (not caps or not core)):
            particle_at = len(core) if comma is None else particle_at
            continue
        core.append((m.replace(".", "") if len(m) <= 4 else m, w.endswith(".") or len(m) == 1 or "." in m))
    if not core:
        return "", [], title, False, False
    names = [c[0] for c in core]
    if comma is not None and 0 < comma <= len(core):
        return "".join(names[:comma]), names[comma:], title, False, True
    if len(names) == 1:
        return names[0], [], title, False, True
    sure = core[0][1] or bool(title) or particle_at is not None and particle_at == len(names) - 1
    return names[-1], names[:-1], title, False, sure


def lcs_ratio(a: str, b: str) -> float:
    """Twice the longest common subsequence over both lengths (bit-parallel)."""
    if not a or not b:
        return 1.0 if a == b else 0.0
    at: dict[str, int] = defaultdict(int)
    for i, c in enumerate(a):
        at[c] |= 1 << i
    v = (1 << len(a)) - 1
    full = v
    for c in b:
        u = v & at.get(c, 0)
        v = ((v + u) | (v - u)) & full
    return 2 * (len(a) - v.bit_count()) / (len(a) + len(b))


def edits(a: str, b: str) -> int:
    """Damerau-Levenshtein distance (neighbours swapped)."""
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            c = min(row[j - 1] + (x != y), row[j] + 1, new[j - 1] + 1)
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                c = min(c, before[j - 2] + 1)
            new.append(c)
        before, row = row, new
    return row[-1]


@lru_cache(maxsize=100_000)
def sounds(w: str) -> str:
    """The index form: sound-alike letters are one and doubled letters single."""
    return _doubled.sub(r"\1", w.replace("ck", "k").replace("y", "ij").translate(_alike))


def likeness(a: str, b: str) -> float:
    """The ratio, less a little for each edit, of two spellings that may be one name, as written or as they sound; else 0."""
    return _likeness_of(a, b) or (max(0.0, _likeness_of(sounds(a), sounds(b)) - 0.02) if min(len(a), len(b)) > 5 else 0.0)


def _likeness_of(a: str, b: str) -> float:
    r = lcs_ratio(a, b)
    n = max(len(a), len(b))
    d = edits(a, b) if r >= RATIO or n <= 5 and r >= 0.6 else 99
    # Two names that differ in their first letters only are rather two names.
    other = a[:1] != b[:1] and not (a[1:] == b[1:] or a[1:3] == b[1:3] and d <= 1)
    return r - 0.02 * d if d <= (1 if n <= 5 else 2 if n <= 8 else 3) and not (other and d > 1) else 0.0


def _likeness(a: str, b: str) -> Column:
    @F.pandas_udf("double")
    def udf(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([likeness(u, v) for u, v in zip(x, y)], dtype=float)

    return udf(a, b)


def deletions(w: str) -> set[str]:
    """What is left of a name's index form after up to as many deletions as two like names can need: a common subsequence
    of RATIO leaves out at most a fifth of the letters and one, and no more than likeness() has edits."""
    s, most = sounds(w), 1 if len(w) <= 5 else 2 if len(w) <= 8 else 3
    return {"".join(c) for k in range(most + 1) if len(s) - k >= 2 for c in combinations(s, len(s) - k)}


def indexed(tokens: DataFrame, group: list[str], token: str) -> DataFrame:
    """tokens with `block`, one row for each block of a group that the token belongs to.

    The index form has sound-alike letters one and doubled letters single, so that one typo doesn't spoil every suffix.
    Blocks are the form's suffixes of MIN_SUFFIX letters or more and those of its reverse. A block of more than COMMON
    members is refined: two of its members are compared if the rest of both is short or shares a pair of letters, and
    their lengths are near. No block is dropped.

    What shares no suffix, as its mistakes are near both ends, has the blocks of its deletions().
    """
    form = F.regexp_replace(F.translate(F.regexp_replace(F.regexp_replace(token, "ck", "k"), "y", "ij"), "zfc", "svk"), r"(.)\1+", "$1")
    suffixes = lambda c, mark: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(c) - MIN_SUFFIX + 1)), lambda i: F.struct(F.concat(F.lit(mark), F.substring(c, i, F.length(c))).alias("suffix"), F.substring(c, F.lit(1), i - 1).alias("rest")))
    x = tokens.withColumn("form", form).withColumn("back", F.reverse("form"))
    x = x.withColumn("x", F.explode(F.concat(suffixes(F.col("form"), ">"), suffixes(F.col("back"), "<")))).drop("form", "back")
    x = x.select(*tokens.columns, "x.suffix", "x.rest").withColumn("members", F.count("*").over(W.partitionBy(*group, "suffix"))).where("members > 1")
    two = F.transform(F.sequence(F.lit(1), F.length("rest") - 1), lambda i: F.substring("rest", i, F.lit(2)))
    shared = F.when(F.length("rest") <= 3, F.array(F.lit("*"))).otherwise(F.array_distinct(F.concat(two, F.when(F.length("rest") <= 6, F.array(F.lit("*"))).otherwise(F.array().cast("array<string>")))))
    band = F.array_distinct(F.transform(F.array(*map(F.lit, range(4))), lambda k: F.floor((F.length(token) + k) / 4).cast("string")))
    keys = F.flatten(F.transform(shared, lambda s: F.transform(band, lambda b: F.concat_ws("/", "suffix", s, b))))
    by_suffix = x.select(*tokens.columns, F.explode(F.when(F.col("members") <= COMMON, F.array("suffix")).otherwise(keys)).alias("block"))

    def left(batches):
        for b in batches:
            ks = [[xxhash.xxh64_intdigest(k) - (1 << 63) for k in deletions(w)] for w in b[token]]
            yield b.assign(k=ks).explode("k").dropna(subset="k").astype({"k": "int64"})

    rest = tokens.mapInPandas(left, T.StructType([*tokens.schema.fields, T.StructField("k", T.LongType())]))
    rest = rest.groupBy(*group, "k").agg(F.collect_list(F.struct(*[c for c in tokens.columns if c not in group])).alias("x")).where(F.size("x") > 1)
    rest = rest.select(*group, F.explode("x").alias("x"), F.concat(F.lit("-"), F.col("k").cast("string")).alias("block"))
    return by_suffix.unionByName(rest.select(*group, "x.*", "block"))


def cluster(rows: list[dict], links: list[tuple[str, str, int]]) -> dict[str, str]:
    """Who each spelling of one family name in one collection means: {spelling: label}; a spelling nobody can place is
    left out.

    rows: s, given (the given names as one key, '' for none), fulls (the full names that it may stand for, as learned),
    title (of a firm its trade), firm, n. links: (spelling, spelling, count) that stand in one row as name and canonical.
    """
    who: dict[str, str] = {}
    trades = Counter(r["title"] for r in rows if r["firm"] and r["title"])
    persons = []
    for r in rows:
        if r["firm"]:
            same = next((t for t, _ in trades.most_common() if r["title"] and likeness(r["title"], t) > 0), r["title"])
            who[r["s"]] = "firm/" + (same or (next(iter(trades)) if len(trades) == 1 else "?"))
        elif len(r["given"]) > 5 and (t := next((t for t, _ in trades.most_common() if likeness(r["given"], t) > 0), None)):
            who[r["s"]] = "firm/" + t
        else:
            persons.append(r)
    graph: dict[str, Counter] = defaultdict(Counter)
    for a, b, n in links:
        graph[a][b] += n
        graph[b][a] += n
    # Those with one full name are that person; a name that nothing was learned of stands for itself.
    people: Counter = Counter()
    called: dict[str, set[str]] = defaultdict(set)
    unsure = []

    def put(r: dict, label: str) -> None:
        who[r["s"]] = label
        people[label] += r["n"]
        if len(r["given"]) > 1:
            called[label].add(r["given"])

    later = []
    for r in persons:
        if len(r["given"]) > 1 and len(r["fulls"]) == 1:
            put(r, r["fulls"][0])
        else:
            later.append(r)
    unknown = []
    for r in later:
        g = r["given"]
        if not g:
            unsure.append((r, set(people)))
        elif r["fulls"] and len(g) > 1:
            near = set(r["fulls"]) & set(people)
            unsure.append((r, near or set(r["fulls"])))
        else:
            unknown.append(r)
    rest = []
    for r in unknown:
        g = r["given"]
        if len(g) >= 4 or len(g) == 3 and not r["cut"]:
            best = max(((likeness(g, x), p) for p in people for x in (p, *called[p])), default=(0.0, ""))
            if best[0] > 0:
                put(r, best[1])
                continue
        rest.append(r)
    for r in rest:
        g = r["given"]
        near = {p for p in people if p.startswith(g)} or {p for p in people if any(x.startswith(g) for x in called[p])} if len(g) <= 5 or r["cut"] else set()
        if not near and len(g) >= 4:
            near = {p for p in people if max(lcs_ratio(x, g) for x in (p, *called[p])) >= 0.75}
        if len(near) == 1:
            who[r["s"]] = next(iter(near))
        elif near:
            unsure.append((r, near))
        elif len(g) >= 4 and not r["cut"]:
            # Linked to a person that is known by another name; else somebody by this name.
            votes = Counter({who[o]: 0 for o in graph.get(r["s"], {}) if o in who and who[o] in people})
            for o, n in graph.get(r["s"], {}).items():
                if o in who and who[o] in votes:
                    votes[who[o]] += n
            top = votes.most_common(2)
            put(r, top[0][0] if top and (len(top) == 1 or top[0][1] >= 2 * top[1][1]) and any(x[0] == g[0] for x in (top[0][0], *called[top[0][0]])) else g)
        else:
            unsure.append((r, set()))
    # The archive's own canonical decides among several; then the title.
    titles: dict[str, Counter] = defaultdict(Counter)
    for r in persons:
        if r["title"] and r["s"] in who:
            titles[r["title"]][who[r["s"]]] += r["n"]
    while unsure:
        left = []
        for r, near in unsure:
            votes: Counter = Counter()
            for other, n in graph.get(r["s"], {}).items():
                if other in who and not who[other].startswith("firm/") and (not near or who[other] in near):
                    votes[who[other]] += n
            if not near and r["given"]:
                votes = Counter({p: n for p, n in votes.items() if p[:1] == r["given"][0]})
            top = votes.most_common(2)
            if top and (len(top) == 1 or top[0][1] >= 2 * top[1][1]):
                who[r["s"]] = top[0][0]
            else:
                left.append((r, near))
        if len(left) == len(unsure):
            break
        unsure = left
    rest = []
    for r, near in unsure:
        by_title = titles.get(r["title"]) if r["title"] and not r["given"] else None
        if len(people) == 1 and (near & set(people) or not r["given"]):
            who[r["s"]] = next(iter(people))
        elif by_title and len(by_title) == 1:
            who[r["s"]] = next(iter(by_title))
        else:
            rest.append(r)
    # What is left has nobody in full: spellings with the same initial mean one.
    by_initial: dict[str, list[dict]] = defaultdict(list)
    for r in rest:
        if r["given"] and not any(p[0] == r["given"][0] for p in people):
            by_initial[r["given"][0]].append(r)
    for k, rs in by_initial.items():
        for r in rs:
            who[r["s"]] = f"{k}."
    if not people and len(by_initial) <= 1:
        for r in rest:
            if not r["given"]:
                who[r["s"]] = f"{next(iter(by_initial), '')}."
    return who


def linked(entities: DataFrame) -> DataFrame:
    """(collection, a, b, k): name and canonical of persons in letters of a collection, and in how many letters they
    stand together; one of them may be null."""
    e = entities.where("letter_id IS NOT NULL AND kind = 'person' AND (name IS NOT NULL OR canonical IS NOT NULL)")
    return e.groupBy(F.substring_index("letter_id", "-", 1).alias("collection"), F.col("name").alias("a"), F.col("canonical").alias("b")).agg(F.count_distinct("letter_id").alias("k"))


def spellings(links: DataFrame) -> DataFrame:
    """(collection, s, n) of the different names and canonicals."""
    return links.select("collection", "k", F.explode(F.array("a", "b")).alias("s")).where("s IS NOT NULL AND trim(s) <> ''").groupBy("collection", "s").agg(F.sum("k").alias("n"))


def parsed(s: DataFrame) -> DataFrame:
    """spellings with family, given, cut (whether the given name is abbreviated), title (of a firm its trade) and firm.
    Names typed family name first are turned round by how often their tokens stand last in the archive's other names."""

    def split(batches):
        for b in batches:
            out = []
            for c, x in zip(b["collection"], b["s"]):
                toks, _, _ = pieces(x)
                bare = [t.strip(".") for t in toks]
                firm = any(m in MARKS for m in bare)
                out += [(c, x, t, firm, i > 0 and bare[i - 1] in PARTICLES) for i, t in enumerate(toks) if len(bare[i]) >= 4 and bare[i] not in FIRM]
            yield pd.DataFrame(out, columns=["collection", "s", "token", "firm", "after"])

    toks = cut(s.select("collection", "s").mapInPandas(split, "collection string, s string, token string, firm boolean, after boolean"))
    # Trades: words that firms carry in many collections and that no particle goes before.
    trades = toks.groupBy(F.trim("token", F.lit(".")).alias("trade")).agg(F.count("*").alias("all"), F.count_if("firm").alias("with_mark"), F.count_if("after").alias("after"), F.count_distinct("collection").alias("places"), F.count_distinct(F.when(F.col("firm"), F.col("collection"))).alias("firm_places"))
    trades = trades.where((F.length("trade") >= 5) & (F.col("firm_places") >= TRADE_PLACES) & (2 * F.col("firm_places") >= F.col("places")) & (F.col("with_mark") >= TRADE_SHARE * F.col("all")) & (F.col("after") <= 0.02 * F.col("all"))).select("trade", "all")
    ends = F.transform(F.sequence(F.lit(4), F.length("trade") - 1), lambda i: F.concat(F.substring("trade", F.lit(1), i), F.lit(".")))
    forms = trades.select("trade", "all", F.explode(F.concat(F.array("trade", F.concat("trade", F.lit("."))), ends)).alias("token")).groupBy("token").agg(F.max_by("trade", "all").alias("trade"))
    known = toks.join(maybe_broadcast(forms, 100_000), "token").groupBy("collection", "s").agg(F.collect_set(F.struct("token", "trade")).alias("trades"))

    def run(batches):
        for b in batches:
            rows = [parse(x, {t["token"]: t["trade"] for t in ts} if ts is not None else {}) for x, ts in zip(b["s"], b["trades"])]
            yield b[["collection", "s", "n"]].assign(family=[r[0] for r in rows], given=[r[1] for r in rows], title=[r[2] for r in rows], firm=[r[3] for r in rows], sure=[r[4] for r in rows])

    p = s.join(known, ["collection", "s"], "left")
    p = cut(p.mapInPandas(run, "collection string, s string, n bigint, family string, given array<string>, title string, firm boolean, sure boolean"))
    # How often a token is a family name, over all collections; only certain names count twice.
    weight = F.when(F.col("sure"), 3).otherwise(1)
    last = p.where("NOT firm AND size(given) > 0").select(F.col("family").alias("w"), weight.alias("l"), F.lit(0).alias("f"))
    first = p.where("NOT firm").select(F.explode("given").alias("w"), F.lit(0).alias("l"), weight.alias("f"))
    stat = last.unionByName(first).groupBy("w").agg((F.sum("l") / (F.sum("l") + F.sum("f"))).alias("share"), F.sum(F.col("l") + F.col("f")).alias("seen"))
    two = p.where("NOT firm AND NOT sure AND size(given) = 1").select("collection", "s", F.col("given")[0].alias("g"), "family")
    two = two.join(stat.select(F.col("w").alias("g"), F.col("share").alias("gs"), F.col("seen").alias("gn")), "g").join(stat.select(F.col("w").alias("family"), F.col("share").alias("fs"), F.col("seen").alias("fn")), "family")
    # A name says nothing about itself: without it, a family name with a mistake was never seen, and is no given name.
    unseen = (F.col("gn") <= 2) & (F.col("fs") * F.col("fn") - 1 < 0.4 * (F.col("fn") - 1))
    turned = two.where(((F.col("fs") < F.col("gs")) & (F.col("fs") < 0.4) | unseen) & (F.col("fn") >= 3) | (F.col("gs") >= 0.7) & (F.col("gn") >= 5) & (F.col("fn") <= 2)).select("collection", "s", F.lit(True).alias("turn"))
    p = p.join(turned, ["collection", "s"], "left")
    given = F.when(F.col("turn"), F.array("family")).otherwise(F.col("given"))
    p = p.select("collection", "s", "n", F.when(F.col("turn"), F.col("given")[0]).otherwise(F.col("family")).alias("family"), given.alias("g"), "title", "firm")
    # Initials are one key together.
    key = F.when(F.forall("g", lambda x: F.length(x) <= 2), F.array_join("g", "")).otherwise(F.array_join("g", "-"))
    cut_short = F.exists("g", lambda x: F.length(x) <= 1) | F.col("s").rlike(r"[\p{L}]\.")
    return p.select("collection", "s", "n", "family", F.when(F.col("firm"), "").otherwise(key).alias("given"), cut_short.alias("cut"), "title", "firm")


def families(p: DataFrame) -> DataFrame:
    """(collection, family, head): the spelling of its family name that each belongs to."""
    f = p.where("family <> ''").groupBy("collection", "family").agg(F.count("*").alias("spellings"), F.sum("n").alias("n"))
    # In how many collections it stands tells a name from a mistake where the collection has few spellings of either.
    f = cut(f.join(f.groupBy("family").agg(F.count("*").alias("places")), "family").select("collection", "family", "spellings", "n", "places"))
    blocks = indexed(f, ["collection"], "family")
    a, b = blocks.alias("a"), blocks.alias("b")
    rank = lambda x: F.struct(F.when(F.col(f"{x}.spellings") < 3, 0).otherwise(F.col(f"{x}.spellings")), *[F.col(f"{x}.{c}") for c in ("places", "spellings", "n", "family")])
    better = rank("b") > rank("a")
    # Two names with many spellings each, of like number, are two families, unless the archive has but one of them elsewhere.
    rare = (F.col("a.spellings") < 3) | (2 * F.col("a.spellings") <= F.col("b.spellings")) | (ATTESTED * F.col("a.places") <= F.col("b.places"))
    pairs = a.join(b, (F.col("a.collection") == F.col("b.collection")) & (F.col("a.block") == F.col("b.block")) & better & (F.abs(F.length("a.family") - F.length("b.family")) <= 3) & rare)
    pairs = pairs.select(F.col("a.collection").alias("collection"), F.col("a.family").alias("x"), F.col("b.family").alias("y"), F.col("b.spellings").alias("support"), ((F.col("a.spellings") >= 3) & (4 * F.col("a.spellings") > F.col("b.spellings"))).alias("strong")).distinct()
    pairs = pairs.withColumn("score", _likeness("x", "y")).where("score > 0 AND (NOT strong OR score >= 0.88)")
    up = cut(pairs.groupBy("collection", "x").agg(F.max_by("y", F.struct("score", "support", "y")).alias("y")))
    # A spelling may join one that itself joins another: pointers are doubled until none moves, each to its chain's head.
    while True:
        nxt = up.select("collection", F.col("x").alias("y"), F.col("y").alias("z"))
        up = cut(up.join(nxt, ["collection", "y"], "left").select("collection", "x", F.coalesce("z", "y").alias("y"), F.col("z").isNotNull().alias("moved")))
        if up.where("moved").isEmpty():
            break
        up = up.drop("moved")
    return f.select("collection", "family").join(up.select("collection", F.col("x").alias("family"), "y"), ["collection", "family"], "left").select("collection", "family", F.coalesce("y", "family").alias("head"))


def learned(m: DataFrame, links: DataFrame) -> DataFrame:
    """(given, fulls): the full names that a given name stands for, as the archive's canonical column shows in several
    families; a full name stands for itself. Rare spellings that are one of these with a mistake stand for the same.

    Of two names that stand for one another, the one that stands for more is the fuller.
    """
    one = m.where("NOT firm AND length(given) > 1").select("collection", "s", "head", "given")
    x = links.join(one.select("collection", F.col("s").alias("a"), F.col("head").alias("ha"), F.col("given").alias("ga")), ["collection", "a"])
    x = x.join(one.select("collection", F.col("s").alias("b"), F.col("head").alias("hb"), F.col("given").alias("gb")), ["collection", "b"]).where("ha = hb AND ga <> gb")
    both = x.select("collection", "ha", F.explode(F.array(F.struct(F.col("ga").alias("g"), F.col("gb").alias("f")), F.struct(F.col("gb").alias("g"), F.col("ga").alias("f")))).alias("p"))
    w = both.groupBy("p.g", "p.f").agg(F.count_distinct("collection", "ha").alias("k")).where(F.col("k") >= LEARNED)
    w = cut(w.withColumn("power", F.sum("k").over(W.partitionBy("g"))))
    w = w.join(w.select(F.col("g").alias("f"), F.col("power").alias("f_power")).distinct(), "f")
    ups = w.where(F.struct("f_power", "f") > F.struct("power", "g")).withColumn("most", F.max("k").over(W.partitionBy("g"))).where(F.col("k") >= BESIDE * F.col("most")).select("g", "f")
    tops = w.select("f").distinct().join(ups.select(F.col("g").alias("f")), "f", "left_anti").select(F.col("f").alias("g"), "f")
    # Every name's tops: up the links, whose power grows, until nothing is left to go up from.
    now, ups = cut(ups), cut(ups)
    while True:
        higher = now.join(ups.select(F.col("g").alias("f"), F.col("f").alias("f2")), "f", "left")
        now = cut(higher.select("g", F.coalesce("f2", "f").alias("f"), F.col("f2").isNotNull().alias("moved")).distinct())
        if now.where("moved").isEmpty():
            break
        now = now.select("g", "f").distinct()
    known = cut(now.select("g", "f").unionByName(tops).distinct())
    book = known.select(F.col("g").alias("token")).distinct().withColumn("old", F.lit(True))
    rare = one.select(F.col("given").alias("token")).where("length(token) >= 4").distinct().join(book.select("token"), "token", "left_anti").withColumn("old", F.lit(False))
    blocks = indexed(book.unionByName(rare).withColumn("all", F.lit(0)), ["all"], "token")
    u, v = blocks.where("NOT old").alias("u"), blocks.where("old").alias("v")
    near = u.join(v, (F.col("u.block") == F.col("v.block")) & (F.abs(F.length("u.token") - F.length("v.token")) <= 3)).select(F.col("u.token").alias("given"), F.col("v.token").alias("g")).distinct()
    near = near.withColumn("score", _likeness("given", "g")).where("score > 0").withColumn("best", F.max("score").over(W.partitionBy("given"))).where("score = best")
    every = known.select(F.col("g").alias("given"), "f").unionByName(near.join(known, "g").select("given", "f"))
    return every.groupBy("given").agg(F.array_sort(F.collect_set("f")).alias("fulls"))


def resolve(entities: DataFrame) -> DataFrame:
    """(collection, s, who): the person or firm that each spelling means, as a label within the collection; spellings
    that nobody can place have a label of their own."""
    both = cut(linked(entities))
    p = cut(parsed(spellings(both)))
    links = both.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    m = cut(p.join(families(p), ["collection", "family"]).select("collection", "head", "s", "n", "given", "cut", "title", "firm"))
    place = m.select("collection", "s", "head")
    inner = links.join(place.select("collection", F.col("s").alias("a"), F.col("head").alias("h1")), ["collection", "a"])
    inner = inner.join(place.select("collection", F.col("s").alias("b"), F.col("head").alias("h2")), ["collection", "b"]).where("h1 = h2").select("collection", F.col("h1").alias("head"), "a", "b", "k")
    named = m.join(learned(m, links), "given", "left")

    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        collection, head = key
        rows = [{"s": r.s, "given": r.given, "cut": r.cut, "fulls": list(r.fulls) if r.fulls is not None else [], "title": r.title, "firm": r.firm, "n": r.n} for r in left.sort_values(["n", "s"], ascending=[False, True]).itertuples()]
        who = cluster(rows, list(right[["a", "b", "k"]].itertuples(index=False, name=None)))
        return pd.DataFrame({"collection": collection, "s": left["s"], "who": [f"{head}/{who.get(x) or '=' + x}" for x in left["s"]]})

    # Many small groups, each dear: spread by number, which the session doesn't merge into few tasks.
    n = max(parts(entities.sparkSession), 2 * entities.sparkSession.sparkContext.defaultParallelism)
    group = ["collection", "head"]
    return named.repartition(n, *group).groupBy(*group).cogroup(inner.repartition(n, *group).groupBy(*group)).applyInPandas(run, "collection string, s string, who string")


def found(entities: DataFrame) -> DataFrame:
    """p1_found: all pairs of different spellings in one collection that mean the same person or firm."""
    r = cut(resolve(entities))
    a, b = r.alias("a"), r.alias("b")
    j = a.join(b, (F.col("a.collection") == F.col("b.collection")) & (F.col("a.who") == F.col("b.who")) & (F.col("a.s") < F.col("b.s")))
    return j.select(F.col("a.collection").alias("collection"), F.col("a.s").alias("name_a"), F.col("b.s").alias("name_b"))
