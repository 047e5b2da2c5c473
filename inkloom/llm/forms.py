"""Visually identical text in one stored form (problem 7).

Method: every different value gets its look-alike-mapped form; the values are grouped by that form under an
accent-sensitive Unicode collation, so that composed and decomposed accents fall together; the class's canonical
member is chosen deterministically and joined back to the values.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Characters that are invisible beside others.
INVISIBLE = "\u00ad\u034f\u061c\u180e\u200b\u200c\u200d\u200e\u200f\u2060\u2061\u2062\u2063\u2064\ufeff"
# Spaces that look like the plain one, hyphens that look like the plain one.
SPACES = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
HYPHENS = "\u2010\u2011"
# Ligatures stored as one character.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st", "ĳ": "ij", "Ĳ": "IJ", "ŉ": "'n", "ǆ": "dž", "ǉ": "lj", "ǌ": "nj"}
# Greek and Cyrillic letters that look like Latin ones, pair by pair.
ALIKE_FROM = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧαινορυАВЕКМНОРСТУХЅІЈԚԜаеорсухѕіјԛԝһӏɑɡ"
ALIKE_TO = "ABEZHIKMNOPTYXaivopuABEKMHOPCTYXSIJQWaeopcyxsijqwhlag"
FULL_FROM, FULL_TO = "".join(map(chr, range(0xFF01, 0xFF5F))), "".join(map(chr, range(0x21, 0x7F)))
OTHER = "\u0370-\u03ff\u0400-\u052f\u0251\u0261"
ALIKE = dict(zip(ALIKE_FROM, ALIKE_TO))
#: Whether a value could change at all; only such values are mapped.
SUSPECT = "[" + INVISIBLE + SPACES + HYPHENS + "".join(LIGATURES) + "\uff01-\uff5e\u0251\u0261\u0300-\u036f\u0370-\u03ff\u0400-\u052f]"
_invisible, _suspect = re.compile(f"[{INVISIBLE}]"), re.compile(SUSPECT)
_plain = str.maketrans({**{c: " " for c in SPACES}, **{c: "-" for c in HYPHENS}, **LIGATURES, **dict(zip(FULL_FROM, FULL_TO))})
_alike = str.maketrans(ALIKE)
_letters = re.compile(r"[^\W\d_]+(?:[.'-][^\W\d_]+)*")
_other = re.compile(f"[{OTHER}]")


def _word(m: re.Match) -> str:
    w = m[0]
    foreign = _other.findall(w)
    if foreign and all(c in ALIKE for c in foreign) and (len(foreign) < sum(c.isalpha() for c in w) or len(foreign) > 1):
        return w.translate(_alike)
    return w


def usual(text: str | None) -> str | None:
    """The text in usual characters: invisible ones dropped, plain spaces and hyphens, composed accents, Latin letters
    in Latin words. A word with a Greek or Cyrillic letter that has no Latin look-alike is meant in that script and
    stays, as does a single such letter that stands alone."""
    if text is None or not _suspect.search(text):
        return text
    t = unicodedata.normalize("NFC", _invisible.sub("", text).translate(_plain))
    return _letters.sub(_word, t) if _other.search(t) else t


def mapped(text: Column) -> Column:
    """usual() as a column. Values without a suspect character never reach Python."""

    @F.pandas_udf("string")
    def udf(s: pd.Series) -> pd.Series:
        return s.map(usual, na_action="ignore")

    return F.coalesce(udf(F.when(suspect(text), text)), text)


def suspect(text: Column) -> Column:
    """Whether the text could change. All such characters take more than one byte, which is told faster than a class."""
    return (F.length(text) != F.octet_length(text)) & text.rlike(SUSPECT)


def classes(values: DataFrame, col: str) -> DataFrame:
    """(value, canonical) of every different non-null value of `col`.

    Values are one class if their mapped forms are equal under the Unicode collation, in which accents and case count
    but the way an accent is stored does not. The canonical member is the mapped form without suspect characters, of
    several the one that sorts first by code point; classes of one value are treated alike. Empty text is its own class.
    """
    v = values.select(F.col(col).alias("value")).where(F.col(col).isNotNull()).distinct()
    v = v.withColumn("form", mapped(F.col("value")))
    # Only forms with other than plain ASCII can be equal to another form under the collation.
    plain = ~F.col("form").rlike(r"[^\x00-\x7F]")
    easy = v.where(plain).select("value", F.col("form").alias("canonical"))
    hard = v.where(~plain).withColumn("key", F.collate("form", "UNICODE"))
    best = hard.groupBy("key").agg(F.min(F.struct(F.col("form").rlike(SUSPECT), F.col("form"))).alias("best")).select("key", F.col("best.form").alias("canonical"))
    return easy.unionByName(hard.join(best, "key").select("value", "canonical"))


def unify(df: DataFrame, col: str, into: str = "canonical_text") -> DataFrame:
    """df with `into`, the one form of `col`; null stays null, rows and their number stay as they are."""
    c = classes(df, col)
    name = "__value"
    return df.join(c.withColumnRenamed("value", name).withColumnRenamed("canonical", into), F.col(col) == F.col(name), "left").drop(name)


def stored_differently(df: DataFrame, col: str, key: Column) -> DataFrame:
    """The distinct keys of the rows whose text is not stored as the canonical member of its class.

    A mapped form has no suspect character that could be mapped further and is composed, so that the members of a class
    without such a character are its canonical member as they stand: only the others go into classes.
    """
    rows = df.select(key.alias("record_id"), F.col(col).alias("text")).where(F.col("record_id").isNotNull() & F.col("text").isNotNull() & suspect(F.col(col)))
    c = classes(rows, "text")
    changed = c.where(F.col("value") != F.col("canonical")).select("value")
    return rows.join(changed, F.col("text") == F.col("value"), "left_semi").select("record_id").distinct()


def found(transcriptions: DataFrame, gold: DataFrame) -> DataFrame:
    """p7_found: table_name and record_id of the rows stored in other than the usual characters."""
    key = F.concat(*[x for c in ("page_id", "engine", "model", "prompt_version", "variant", "sample_no", "line_no") for x in (F.lit("|"), F.col(c).cast("string"))][1:])
    a = stored_differently(transcriptions, "text", key).select(F.lit("transcriptions").alias("table_name"), "record_id")
    b = stored_differently(gold, "gold_text", F.col("page_id")).select(F.lit("gold").alias("table_name"), "record_id")
    return a.unionByName(b)
