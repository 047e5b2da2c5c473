"""Timestamps of many formats and clocks brought to one unambiguous form (problem 3).

Method: the text is parsed to a date, a local time, a zone and a clock name. Local times
without a zone go through an as-of join to the station's zone-offset intervals, exploded by the local years that they
touch: no matching interval means that the clock never showed the time, two mean that it showed it twice, one gives
the offset.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Month names and usual abbreviations in Dutch, English and German, by number of the month.
MONTHS = {
    1: "januari january januar jan jänner",
    2: "februari february februar feb febr",
    3: "maart march märz maerz mrt mar maa",
    4: "april apr",
    5: "mei may mai",
    6: "juni june jun",
    7: "juli july jul",
    8: "augustus august aug",
    9: "september sept sep",
    10: "october oktober oct okt",
    11: "november nov",
    12: "december dezember dec dez",
}
# Roman numerals of the months.
ROMAN = ["i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix", "x", "xi", "xii"]
NAMES = {w: n for n, ws in MONTHS.items() for w in ws.split()}
MONTH = "(" + "|".join(sorted(NAMES, key=lambda w: -len(w))) + ")"
#: Letters of the military zones: A to I and K to M are +1 to +12, N to Y are -1 to -12, Z is 0; J means local time.
EAST, WEST = "abcdefghiklm", "nopqrstuvwxy"
PLACEHOLDER = "1900-01-01"

YEAR = r"('\d{2}|\d{4}|\d{2})"
DAY = r"(?:den\s+)?(\d{1,2})(?:en|ste|de|e|st|nd|rd|th)?"
_rom = "|".join(sorted(ROMAN, key=lambda r: -len(r)))
#: Date patterns with the groups of year, month and day; the first that matches counts.
DATES = [
    ("mil", rf"(?<!\d)(\d{{2}})(\d{{2}})(\d{{2}})([a-z])\s+{MONTH}\.?\s+{YEAR}(?!\d)", 6, 5, 1),
    ("ymd", r"(?<!\d)(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})(?!\d)", 1, 2, 3),
    ("compact", r"(?<!\d)(\d{4})(\d{2})(\d{2})(?=t\d|\D|$)", 1, 2, 3),
    ("dmy", r"(?<![\d.:])(\d{1,2})([-/.])(\d{1,2})\2('?\d{4}|'?\d{2})(?![\d.:])", 4, 3, 1),
    ("roman", rf"(?<!\d)(\d{{1,2}})[-. /]+({_rom})[-. /]+{YEAR}(?!\d)", 3, 2, 1),
    ("dmonthy", rf"(?<![\d.:]){DAY}[\s-]+{MONTH}\b\.?,?[\s-]+{YEAR}(?![\d.:u])", 3, 2, 1),
    ("monthdy", rf"\b{MONTH}\b\.?\s+(\d{{1,2}})(?:st|nd|rd|th)?,?\s+('\d{{2}}|\d{{4}})(?!\d)", 3, 1, 2),
    ("monthy", rf"\b{MONTH}\b\.?,?\s+('\d{{2}}|\d{{4}})(?!\d)", 2, 1, 0),
    ("dmonth", rf"(?<![\d.:]){DAY}\s+{MONTH}\b\.?", 0, 2, 1),
    ("monthd", rf"\b{MONTH}\b\.?\s+(\d{{1,2}})(?:st|nd|rd|th)?(?![\d.:u])", 0, 1, 2),
    ("ym", r"^(\d{4})[-/](\d{1,2})$", 1, 2, 0),
    ("my", r"^(\d{1,2})[-/](\d{4})$", 2, 1, 0),
    ("y", r"^(?:anno|in|year|jaar|het jaar)?\s*(\d{4})$", 1, 0, 0),
]
DATES = [(n, re.compile(p), *g) for n, p, *g in DATES]
WEEKDAY = re.compile(r"\b(?:maan|dins|woens|donder|vrij|zater|zon)dag\b|\b(?:mon|tues|wednes|thurs|fri|satur|sun)day\b")
OFFSET = re.compile(r"(?:(?:utc|gmt)\s*|(?<=\d))([+-])(\d{1,2}):?(\d{2})?(?!\d)")
ZULU = re.compile(r"\d\s?z(?![a-z.])|\b(?:utc|gmt)\b")
UNZONED = re.compile(r"\(?(?:utc|gmt)\s*[+-]?\d{0,2}:?\d{0,2}\)?|(?<=\d)[+-]\d{2}:?\d{2}\b")
TIMES = [
    re.compile(p)
    for p in (
        r"(?<![\d:.])(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,]\d+)?)?(?![\d:])",
        r"(?<![\d:.])(\d{1,2})\.(\d{2})()(?![\d.])",
        r"(?<!\d)(\d{1,2})[uh](\d{2})()(?!\d)",
        r"(?<!\d)(\d{2})(\d{2})()\s*(?:hrs|hours|uur|h)\b",
        r"(?:^|t)\s*t?(\d{2})(\d{2})(\d{2})?(?!\d)",
        r"(?<![\d:.])(\d{1,2})()()\s*(?:uur|o'clock|[ap]\.?m\.?)(?![a-z])",
    )
]
#: A clock's name: a word that ends in -tijd or -time, initials such as "z.t.", or a word cut short with a full stop.
CLOCK = [re.compile(p) for p in (r"([a-z]{3,}(?:tijd|time|zeit))\b", r"\b([a-z]\.?\s?t\.?)(?![a-z])", r"\b([a-z]{3,})\.")]


def parse_text(text: str | None) -> tuple:
    """(kind, year, month, day, second of the day, offset in minutes, clock) of one text, by no calendar but its own.

    kind: blank, instant, day, month, year or None; year None where the text has none. Pure function of the text.
    """
    none = (None,) * 7
    t = re.sub(r"\s+", " ", text or "").strip().lower()
    if not t:
        return ("blank", *none[1:])
    t = WEEKDAY.sub(" ", re.sub("[\u2010\u2011\u2013]", "-", t)).strip()
    for shape, pattern, gy, gm, gd in DATES:
        if m := pattern.search(t):
            break
    else:
        return none
    rest = (t[: m.start()] + " " + t[m.end() :]).strip()
    y = m[gy].replace("'", "") if gy else None
    y = int("19" + y if len(y) == 2 else y) if y else None
    mo = (int(m[gm]) if m[gm].isdigit() else NAMES.get(m[gm]) or ROMAN.index(m[gm]) + 1) if gm else None
    d = int(m[gd]) if gd else None
    if mo is not None and not 1 <= mo <= 12 or d is not None and not 1 <= d <= 31 or y == 0:
        return none
    if d is None:
        return ("year" if mo is None else "month", y, mo, None, None, None, None)
    name = next((x[1] for c in CLOCK if (x := c.search(rest))), None)
    name = re.sub(r"[.\s]", "", name) if name else None
    if shape == "mil":
        z = m[4]
        zone = 0 if z == "z" else 60 * (EAST.index(z) + 1) if z in EAST else -60 * (WEST.index(z) + 1) if z in WEST else None
        h, mi, s = int(m[2]), int(m[3]), 0
    else:
        o = OFFSET.search(rest)
        zone = (-1 if o[1] == "-" else 1) * (int(o[2]) * 60 + int(o[3] or 0)) if o else 0 if ZULU.search(rest) else None
        bare = UNZONED.sub(" ", rest)
        x = next((x for p in TIMES if (x := p.search(bare))), None)
        if not x:
            return ("day", y, mo, d, None, None, None)
        h, mi, s = int(x[1]), int(x[2] or 0), int(x[3] or 0)
        half = re.search(r"\d\s*([ap])\.?\s?m\b", bare)
        if half:
            h = h % 12 + 12 * (half[1] == "p") if 1 <= h <= 12 else 99
    if h > 23 or mi > 59 or s > 59:
        return none
    return ("instant", y, mo, d, h * 3600 + mi * 60 + s, zone, name)


PARSED = "p_kind string, p_y int, p_m int, p_d int, p_sec int, p_offset int, p_clock string"


def parse(df: DataFrame, text: str = "date_text", day: str = "date") -> DataFrame:
    """Adds p_kind (instant, day, month, year), p_y, p_m, p_date, p_sec (of the day), p_offset (minutes) and p_clock.

    Null or blank text gives the day in `day`; text that names no real date gives a null kind. Nothing is dropped. A
    dozen patterns with lookarounds as nested built-ins would swell the plan beyond compiling, so that each batch of
    texts is parsed by one Arrow-fed function, each different text of a batch once.
    """

    @F.pandas_udf(PARSED)
    def parsed(texts: pd.Series) -> pd.DataFrame:
        each = {t: parse_text(t) for t in texts.dropna().unique()}
        blank = parse_text(None)
        rows = [blank if t is None or t != t else each[t] for t in texts]
        return pd.DataFrame({c.split()[0]: pd.Series([r[i] for r in rows], dtype="object" if "string" in c else "Int32") for i, c in enumerate(PARSED.split(", "))})

    df = df.withColumn("p", parsed(F.col(text))).select(*df.columns, "p.*")
    stands = F.col(day) > F.to_date(F.lit(PLACEHOLDER))
    year = F.coalesce("p_y", F.when(stands, F.year(day)))
    real = F.try_to_timestamp(F.format_string("%04d-%02d-%02d", year, F.col("p_m"), F.col("p_d")), F.lit("yyyy-MM-dd")).cast("date")
    date = F.when(F.col("p_kind") == "blank", F.when(stands, F.col(day))).when(F.col("p_d").isNotNull() & year.isNotNull(), real)
    df = df.withColumn("p_date", date)
    kind = F.when(F.col("p_kind").isin("month", "year"), F.col("p_kind")).when(F.col("p_date").isNotNull(), F.when(F.col("p_kind") == "instant", "instant").otherwise("day"))
    return df.withColumn("p_kind", kind)


def _seconds(ts: Column) -> Column:
    return F.timestamp_diff("SECOND", F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'"), ts)


def intervals(rules: DataFrame) -> DataFrame:
    """Per station the intervals [lo, hi) of local seconds at one offset, exploded by the local years they touch.

    The last interval is open; local years after the last rule's count as the year that follows it.
    """
    later = W.partitionBy("station").orderBy("from_utc")
    last = W.partitionBy("station")
    r = rules.where(F.col("station").isNotNull() & F.col("from_utc").isNotNull() & F.col("utc_offset_min").isNotNull()).dropDuplicates(["station", "from_utc"])
    r = r.select("station", "clock_name", F.col("utc_offset_min").alias("minutes"), _seconds(F.col("from_utc")).alias("since"), F.lead(_seconds(F.col("from_utc"))).over(later).alias("until"))
    year = lambda sec: F.year(F.date_from_unix_date(F.floor(sec / 86400).cast("int")))
    r = r.select("station", "clock_name", "minutes", (F.col("since") + F.col("minutes") * 60).alias("lo"), (F.col("until") + F.col("minutes") * 60).alias("hi"))
    r = r.withColumn("past", F.max(year(F.col("lo")) + 1).over(last))
    return r.withColumn("year", F.explode(F.sequence(year(F.col("lo")), F.coalesce(year(F.col("hi")), F.col("past")))))


def normalise(events: DataFrame, rules: DataFrame, key: str = "event_id", text: str = "date_text", day: str = "date", station: str = "station") -> DataFrame:
    """One row (key, normal_form) per event whose time can be stated.

    Repeated deliveries of a key count once (the content that sorts first, texts before nulls). A null key gives no
    row. A day, month or year is not shifted. A clock time without zone and without station gives no row.
    """
    e = events.select(F.col(key).alias("k"), F.col(text).alias("txt"), F.col(day).alias("day"), F.col(station).alias("st")).where(F.col(key).isNotNull())
    e = e.groupBy("k").agg(F.min_by(F.struct("txt", "day", "st"), F.struct(F.col("txt").isNull(), "txt", F.col("day").isNull(), "day", "st")).alias("x")).select("k", "x.*")
    e = parse(e, "txt", "day").where("p_kind IS NOT NULL").select("k", "st", *[f"p_{c}" for c in ("kind", "y", "m", "date", "sec", "offset", "clock")])
    local = F.unix_date("p_date").cast("bigint") * 86400 + F.col("p_sec")
    e = e.withColumn("local", F.when(F.col("p_kind") == "instant", local))
    spans = intervals(rules)
    past = F.broadcast(spans.groupBy("station").agg(F.first("past").alias("past")))
    needs = (F.col("p_kind") == "instant") & F.col("p_offset").isNull()
    clocked = e.where(needs & F.col("st").isNotNull()).join(past, F.col("st") == F.col("station")).drop("station")
    clocked = clocked.withColumn("year", F.least(F.year("p_date"), F.col("past"))).drop("past")
    s = F.broadcast(spans.select("station", "year", "minutes", "clock_name", "lo", "hi"))
    hit = clocked.join(s, (clocked["st"] == s["station"]) & (clocked["year"] == s["year"]) & (clocked["local"] >= s["lo"]) & (s["hi"].isNull() | (clocked["local"] < s["hi"])))
    name = F.lower(F.col("clock_name"))
    initials = F.concat(F.substring(name, 1, 1), F.lit("t"))
    named = F.coalesce((F.col("p_clock") == name) | (F.col("p_clock") == initials) | ((F.length("p_clock") >= 3) & name.startswith(F.col("p_clock"))), F.lit(False))
    found = hit.groupBy("k", "local").agg(F.count("*").alias("n"), F.min("minutes").alias("one"), F.count_if(named).alias("n_named"), F.min(F.when(named, F.col("minutes"))).alias("by_name"))
    found = found.select("k", F.when(F.col("n") == 1, F.col("local") - F.col("one") * 60).when(F.col("n_named") == 1, F.col("local") - F.col("by_name") * 60).alias("utc"))
    stated = e.where(~needs).select("k", "p_kind", "p_y", "p_m", "p_date", (F.col("local") - F.col("p_offset") * 60).alias("utc"))
    form = lambda utc: F.concat(
        F.date_from_unix_date(F.floor(utc / 86400).cast("int")).cast("string"),
        F.format_string("T%02d:%02d:%02dZ", F.floor(F.pmod(utc, F.lit(86400)) / 3600), F.floor(F.pmod(utc, F.lit(3600)) / 60), F.pmod(utc, F.lit(60))),
    )
    coarse = (
        F.when(F.col("p_kind") == "instant", form(F.col("utc")))
        .when(F.col("p_kind") == "day", F.col("p_date").cast("string"))
        .when(F.col("p_kind") == "month", F.format_string("%04d-%02d", "p_y", "p_m"))
        .otherwise(F.format_string("%04d", "p_y"))
    )
    out = stated.select("k", coarse.alias("normal_form")).unionByName(found.where("utc IS NOT NULL").select("k", form(F.col("utc")).alias("normal_form")))
    return out.where("normal_form IS NOT NULL").select(F.col("k").alias(key), "normal_form")
