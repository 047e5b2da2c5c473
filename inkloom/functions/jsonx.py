"""Model replies: lenient JSON to rows."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from inkloom.functions.text import BREAKS, SPACE

LINES = "array<struct<n:int,text:string,confidence:string>>"
_fence = re.compile(r"^\s*```[a-zA-Z]*\s*$", re.M)


def unfenced(text: Column) -> Column:
    return F.regexp_replace(text, r"(?m)^\s*```[a-zA-Z]*\s*$", "")


def json_block(text: Column) -> Column:
    """The text from the first { to the last }, or null."""
    return F.nullif(F.regexp_extract(unfenced(text), r"(?s)\{.*\}", 0), F.lit(""))


def _line(item: object, place: int) -> tuple[int, str, str] | None:
    """One entry of a reply's list as (n, text, confidence); None for what is no line. A bare string is a line."""
    d = {"text": item} if isinstance(item, str) else item if isinstance(item, dict) else {}
    if "text" not in d:
        return None
    n = d.get("n", place)
    if isinstance(n, bool) or not isinstance(n, (int, float)) and not re.fullmatch(r"\s*[+-]?\d+\s*", str(n)):
        raise ValueError(n)
    return int(n), str(d["text"]), str(d.get("confidence") or "medium").lower()


def lines_of(text: str | None) -> list[tuple[int, str, str]] | None:
    """One reply's lines: those of its JSON object, or else each non-blank line of the plain text with its number.

    A list that is none, or a number that is none, counts as no JSON, so that no reply fails a job.
    """
    if text is None:
        return None
    bare = _fence.sub("", text)
    begin, end = bare.find("{"), bare.rfind("}")
    try:
        got = json.loads(bare[begin : end + 1]) if 0 <= begin < end else None
        items = got.get("lines") if isinstance(got, dict) else None
        found = [x for place, item in enumerate(items if isinstance(items, list) else [], 1) if (x := _line(item, place))]
    except ValueError:
        found = []
    return found or [(place, s.strip(), "medium") for place, s in enumerate(bare.strip().splitlines(), 1) if s.strip()]


def parse_lines(text: Column) -> Column:
    """Array of (n, text, confidence). Well-formed objects take the built-in path; only the others reach Python."""

    @F.pandas_udf(LINES)
    def slow(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else [{"n": n, "text": x, "confidence": c} for n, x, c in lines_of(t)])

    shape = "struct<lines:array<struct<n:string,text:string,confidence:string>>>"
    fast = F.from_json(json_block(text), shape)["lines"]
    good = fast.isNotNull() & (F.size(fast) > 0) & F.forall(fast, lambda x: x.isNotNull() & x["text"].isNotNull() & x["n"].try_cast("int").isNotNull())
    rows = F.transform(fast, lambda x: F.struct(x["n"].try_cast("int").alias("n"), x["text"].alias("text"), F.lower(F.coalesce(x["confidence"], F.lit("medium"))).alias("confidence")))
    return F.coalesce(F.when(good, rows), slow(F.when(~F.coalesce(good, F.lit(False)), text)))


# The keys of an extraction reply.
BAGS = "struct<people:array<struct<name:string,role_guess:string,context:string>>,places:array<struct<name:string,modern_name:string>>,events:array<struct<date:string,date_text:string,description:string,category:string>>,summary_nl:string,summary_en:string,mood:string,notable_quotes:array<string>>"


def bags(reply: Column) -> Column:
    """The extraction reply as a struct of people, places, events and summary; null if it is no JSON object."""
    return F.from_json(json_block(reply), BAGS)


def gold_lines(text: Column) -> Column:
    """Lines of a checked page: neither blank nor comment, whatever ends them and whatever white space they hold."""
    return F.filter(F.split(text, BREAKS), lambda x: x.rlike(rf"[^\s\p{{Z}}\x0B\x1C-\x1F\x85]") & ~x.rlike(rf"^{SPACE}*#"))


def gold_json(text: Column) -> Column:
    """The reply that a model should give for a checked page."""
    kept = gold_lines(text)
    return F.to_json(F.struct(F.transform(kept, lambda x, i: F.struct((i + 1).alias("n"), x.alias("text"), F.lit("high").alias("confidence"))).alias("lines")))


def well_formed(reply: Column) -> Column:
    """Whether a reply is a JSON object whose lines all have a whole number, a text and a confidence that is known."""
    shape = "struct<lines:array<struct<n:string,text:string,confidence:string>>>"
    lines = F.from_json(json_block(reply), shape)["lines"]
    whole = F.from_json(json_block(reply), "struct<lines:array<struct<n:int,text:string,confidence:string>>>")["lines"]
    good = lambda x: x.isNotNull() & x["n"].isNotNull() & x["text"].isNotNull() & F.coalesce(x["confidence"].isin("high", "medium", "low"), F.lit(False))
    return F.coalesce(lines.isNotNull() & F.forall(whole, good) & F.forall(lines, lambda x: x["n"].rlike(r"^-?\d+$")), F.lit(False))


REPLY = "struct<is_error:boolean,text:string,model:string,input_tokens:bigint,output_tokens:bigint,cost:double>"


def recovered(output: Column) -> Column:
    """What a model program printed, as is_error, text, model, tokens and cost: one result object, one after other output,
    or the last result of a list of messages. Structured output goes before plain text; null if there is no JSON."""

    @F.pandas_udf(REPLY)
    def read(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_result(t) for t in s], columns=["is_error", "text", "model", "input_tokens", "output_tokens", "cost"]).astype({"is_error": "boolean", "input_tokens": "Int64", "output_tokens": "Int64"})

    return F.when(output.rlike(r"[\[{]"), read(output))


def _result(printed: str | None) -> tuple:
    got = None
    for begin in (0, (printed or "").find("[{"), (printed or "").find("{")):
        if begin >= 0 and got is None:
            try:
                got, _ = json.JSONDecoder().raw_decode((printed or "").strip() if begin == 0 else (printed or "")[begin:])
            except ValueError:
                pass
    if isinstance(got, list):
        results = [x for x in got if isinstance(x, dict) and x.get("type") == "result"]
        got = (results or [x for x in got if isinstance(x, dict)] or [None])[-1]
    if not isinstance(got, dict):
        return (None,) * 6
    structured, use = got.get("structured_output"), got.get("usage") or {}
    text = json.dumps(structured, ensure_ascii=False) if structured else str(got.get("result", ""))
    models = got.get("modelUsage")
    return bool(got.get("is_error")), text, next(iter(models), None) if isinstance(models, dict) else None, use.get("input_tokens"), use.get("output_tokens"), got.get("total_cost_usd")
