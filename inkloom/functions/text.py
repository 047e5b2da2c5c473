"""Column builders for text: normalisation, error rates, names. All built-in but Unicode composition.

Lengths and distances count code points. Null in, null out, unless a function says otherwise.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: What ends a line, white space, and the class of word characters, as Unicode sees them.
BREAKS = r"\r\n|[\n\r\x0B\x0C\x1C\x1D\x1E\x85\u2028\u2029]"
SPACE = r"[\s\p{Z}\x0B\x1C-\x1F\x85]"
WORD = r"[\p{L}\p{N}_]"
PUNCT = r"[^\p{L}\p{N}_\s\p{Z}\x0B\x1C-\x1F\x85\[\]?'-]"


def compose(text: Column) -> Column:
    """NFC. The guard stands inside the argument, so that plain ASCII never reaches Python."""

    @F.pandas_udf("string")
    def nfc(s: pd.Series) -> pd.Series:
        return s.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")

    return F.coalesce(nfc(F.when(text.rlike(r"[^\x00-\x7F]"), text)), text)


def let(value: Column, body) -> Column:
    """body(value) with the value computed once for each row, also where body uses it in a loop."""
    return F.element_at(F.transform(F.array(value), body), 1)


def fold(text: Column) -> Column:
    """Case folding as far as the archive's languages need it."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def normalise(text: Column, casefold: bool = False, strip_punct: bool = False) -> Column:
    """Composed, without soft hyphens and comment lines, on one line, words broken at a line's end joined."""
    t = F.replace(compose(text), F.lit("\u00ad"), F.lit(""))
    kept = F.filter(F.split(t, BREAKS), lambda x: ~x.rlike(rf"^{SPACE}*#"))
    t = F.regexp_replace(F.array_join(kept, " "), rf"({WORD})- ({WORD})", "$1$2")
    t = F.regexp_replace(t, PUNCT, " ") if strip_punct else t
    t = fold(t) if casefold else t
    return F.trim(F.regexp_replace(t, rf"{SPACE}+", " "))


def words(text: Column) -> Column:
    """White-space tokens."""
    return F.filter(F.split(text, rf"{SPACE}+"), lambda t: t != "")


def cer(ref: Column, hyp: Column) -> Column:
    """Character error rate of two normalised texts. Empty ref: 0 if hyp is empty too, else 1. May exceed 1."""
    return F.when(ref == "", F.when(hyp == "", 0.0).otherwise(1.0)).otherwise(F.levenshtein(ref, hyp) / F.length(ref))


def wer(ref: Column, hyp: Column) -> Column:
    """Word error rate of two columns normalised with folding and without punctuation; rules of cer.

    Words become characters, so that the built-in distance counts words. Words that the other side doesn't have can
    match nothing and share one character.
    """
    char = lambda i: F.decode(F.unhex(F.lpad(F.hex(i + 19968), 4, "0")), "UTF-16BE")
    coded = lambda ws, book, other: F.array_join(F.transform(ws, lambda t: F.coalesce(F.try_element_at(book, t), F.lit(chr(other)))), "")

    def rate(x: Column) -> Column:
        r, h = x["r"], x["h"]
        d = let(F.array_intersect(r, h), lambda c: let(F.map_from_arrays(c, F.transform(c, lambda _, i: char(i))), lambda book: F.levenshtein(coded(r, book, 1), coded(h, book, 2))))
        return F.when(F.size(r) == 0, F.when(F.size(h) == 0, 0.0).otherwise(1.0)).otherwise(d / F.size(r))

    return F.when(ref.isNotNull() & hyp.isNotNull(), let(F.struct(words(ref).alias("r"), words(hyp).alias("h")), rate))


def proper_nouns(text: Column) -> Column:
    """Words within a sentence that look like names: at least three letters, the first a capital, not all capitals."""
    strip = lambda t: F.regexp_replace(t, "^[.,;:!?()\"']+|[.,;:!?()\"']+$", "")
    good = lambda x: (F.length(x["b"]) >= 3) & x["b"].rlike(r"^\p{Lu}") & x["b"].rlike(r"[\p{Ll}\p{Lt}]") & ~x["p"].rlike(r"[.!?:]$")

    def pick(tk: Column) -> Column:
        pairs = F.zip_with(tk, F.concat(F.array(F.lit(".")), tk), lambda b, p: F.struct(strip(b).alias("b"), p.alias("p")))
        return F.array_distinct(F.transform(F.filter(pairs, lambda x: x["b"].isNotNull() & good(x)), lambda x: x["b"]))

    return let(words(text), pick)


def name_recall(ref: Column, hyp: Column) -> Column:
    """Share of the reference's names among the hypothesis' tokens; null if the reference has none."""
    names = proper_nouns(ref)
    tokens = F.transform(words(hyp), lambda t: F.regexp_replace(t, "^[.,;:!?()\"']+|[.,;:!?()\"']+$", ""))
    return F.try_divide(F.size(F.array_intersect(names, tokens)), F.size(names))


def stem(filename: Column) -> Column:
    """A file's name without its last suffix; a leading dot is no suffix."""
    return F.regexp_replace(filename, r"(?<=.)\.[^.]*$", "")


def letter_of(stem_col: Column) -> Column:
    """The letter's id in a file name such as 1945-03-15_p1, or null."""
    return F.nullif(F.regexp_extract(stem_col, r"(?i)^(.+?)_p(\d+)(?:_.*)?$", 1), F.lit(""))


def page_of(stem_col: Column) -> Column:
    return F.nullif(F.regexp_extract(stem_col, r"(?i)^(.+?)_p(\d+)(?:_.*)?$", 2), F.lit("")).try_cast("int")


def loose_date(text: Column) -> Column:
    """A date from the start of YYYY-MM-DD..., or all of YYYY-MM or YYYY; anything else, or no real day, is null."""
    day = lambda x: F.try_to_timestamp(x, F.lit("yyyy-MM-dd")).cast("date")
    return (
        F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), day(F.substring(text, 1, 10)))
        .when(text.rlike(r"^\d{4}-\d{2}$"), day(F.concat(text, F.lit("-01"))))
        .when(text.rlike(r"^\d{4}$"), day(F.concat(text, F.lit("-01-01"))))
    )


def content_id(content: Column) -> Column:
    """Identity of a page: the first 16 hex digits of its bytes' SHA-256."""
    return F.substring(F.sha2(content, 256), 1, 16)


def prompt_version(text: Column) -> Column:
    return F.substring(F.sha1(text), 1, 8)


def marked(tokens: Column) -> Column:
    """{word|other} text of voted tokens (text, alternatives)."""
    return F.array_join(F.transform(tokens, lambda t: F.when(F.size(t["alternatives"]) > 0, F.concat(F.lit("{"), t["text"], F.lit("|"), F.array_join(t["alternatives"], "|"), F.lit("}"))).otherwise(t["text"])), " ")


def snippet(line: Column, needle: str) -> Column:
    """The line with the first hit of the needle, case aside, set in « »."""
    at = F.instr(F.lower(line), F.lit(needle.lower()))
    n = len(needle)
    return F.when(at > 0, F.concat(F.substr(line, F.lit(1), at - 1), F.lit("«"), F.substr(line, at, F.lit(n)), F.lit("»"), F.substr(line, at + n)))
