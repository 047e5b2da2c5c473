"""Model calls over pages: messages, samples, replies to rows. The engine is a picklable factory of functions from a
request to text; a deterministic stand-in and one that replays recorded replies come with the library."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkloom.functions.jsonx import bags, gold_json, parse_lines
from inkloom.functions.text import loose_date
from inkloom.operators import fuzzy
from inkloom.operators.views import date_of_letter

Factory = Callable[[], Callable[[str, float], str]]
#: A message as rows carry it: turns of a role with parts of text or images.
PARTS = "array<struct<kind:string,text:string,path:string>>"
MESSAGES = f"array<struct<role:string,parts:{PARTS}>>"


def echo() -> Callable[[str, float], str]:
    """A stand-in: the message's last paragraph as lines."""
    return lambda message, temperature: message.rsplit("\n\n", 1)[-1]


def replay(replies: dict[str, str] | None = None) -> Factory:
    """Recorded replies by message; an unknown message gives an empty reply."""
    known = dict(replies or {})
    return lambda: lambda message, temperature: known.get(message, "")


ENGINES: dict[str, Callable[..., object]] = {"echo": lambda: echo, "replay": replay}


def engine(name: str, *args) -> Factory:
    """The factory of an engine by name; an unknown name is an error. register() adds further ones."""
    if name not in ENGINES:
        raise ValueError(f"no engine {name!r}; known: {', '.join(sorted(ENGINES))}")
    return ENGINES[name](*args)


def register(name: str, make: Callable[..., Factory]) -> None:
    ENGINES[name] = make


def message(prompt: str, context: str = "context") -> Column:
    """The prompt, then the page's context if it has one."""
    return F.concat_ws("\n\n", F.lit(prompt), F.when(F.col(context) != "", F.col(context)))


def part(kind: str, value: Column) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(F.lit(kind).alias("kind"), (value if kind == "text" else F.lit("")).alias("text"), (none if kind == "text" else value).alias("path"))


def messages(pages: DataFrame, shots: DataFrame, gold: DataFrame) -> DataFrame:
    """pages(page_id, image, bands, context) with `messages`: examples, then the page with its bands and what is known.

    shots(page_id, shot, n, image): the examples of each page, as views.few_shot() gives them, with the example's image;
    each is a turn of the user with the image and one of the assistant with the checked text as a reply. bands may be
    null or empty, context too.
    """
    # What a model is told.
    ask = F.lit("Transcribe this page.")
    answer = gold.groupBy(F.col("page_id").alias("shot")).agg(F.max("gold_text").alias("g")).select("shot", gold_json(F.col("g")).alias("answer"))
    turns = F.array(
        F.struct(F.lit("user").alias("role"), F.array(part("image", F.col("image")), part("text", ask)).alias("parts")),
        F.struct(F.lit("assistant").alias("role"), F.array(part("text", F.col("answer"))).alias("parts")),
    )
    e = shots.join(answer, "shot").groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("n", turns.alias("t")))).alias("x"))
    e = e.select("page_id", F.flatten(F.transform("x", lambda s: s["t"])).alias("examples"))
    n = F.coalesce(F.size("bands"), F.lit(0))
    n = F.greatest(n, F.lit(0))
    crops = F.when(n > 0, F.concat(F.lit(" The first image is the full page; the next "), n.cast("string"), F.lit(" images are zoomed crops of the same page, top to bottom.")))
    said = F.concat(ask, F.coalesce(crops, F.lit("")), F.when(F.col("context") != "", F.concat(F.lit("\n"), F.col("context"))).otherwise(""))
    images = F.concat(F.array("image"), F.coalesce("bands", F.array().cast("array<string>")))
    parts = F.concat(F.transform(images, lambda p: part("image", p)), F.array(part("text", said)))
    task = F.array(F.struct(F.lit("user").alias("role"), parts.alias("parts")))
    x = pages.join(e, "page_id", "left")
    return x.select(*pages.columns, F.concat(F.coalesce("examples", F.array().cast(MESSAGES)), task).cast(MESSAGES).alias("messages"))


def user_turns(msgs: Column) -> Column:
    """How many turns of a message are the user's."""
    return F.size(F.filter(msgs, lambda m: m["role"] == "user"))


def flattened(msgs: Column) -> Column:
    """The turns as one text, for engines that take no turns: examples and task labelled, images by path."""
    count = user_turns(msgs)
    before = lambda i: F.size(F.filter(F.slice(msgs, 1, i + 1), lambda m: m["role"] == "user"))

    def turn(m: Column, i: Column) -> Column:
        k = before(i)
        texts = F.transform(F.filter(m["parts"], lambda p: p["kind"] == "text"), lambda p: p["text"])
        reads = F.transform(F.filter(m["parts"], lambda p: p["kind"] == "image"), lambda p: F.concat(F.lit("`"), p["path"], F.lit("`")))
        label = F.when(k == count, "[Task]").otherwise(F.concat(F.lit("[Example "), k.cast("string"), F.lit("]")))
        head = F.when(F.size(reads) > 0, F.concat(label, F.lit(" Images: "), F.array_join(reads, ", "), F.lit("."))).otherwise(label)
        answer = F.concat(F.lit("[Answer to example "), k.cast("string"), F.lit("]"))
        return F.when(m["role"] == "user", F.array_join(F.concat(F.array(head), texts), "\n")).otherwise(F.array_join(F.concat(F.array(answer), texts), "\n"))

    return F.array_join(F.transform(msgs, turn), "\n\n")


def generate(pages: DataFrame, factory: Factory, samples: int = 1, temperature: float = 0.7) -> DataFrame:
    """pages(page_id, message) with sample_no and reply. Of several samples the first is greedy."""
    x = pages.select("page_id", "message", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("sample_no"))

    def run(batches):
        call = factory()
        for b in batches:
            heat = [0.0 if samples > 1 and s == 0 else temperature for s in b["sample_no"]]
            yield b.assign(reply=[call(m, h) for m, h in zip(b["message"], heat)])[["page_id", "sample_no", "reply"]]

    return x.mapInPandas(run, "page_id string, sample_no int, reply string")


def to_lines(replies: DataFrame, engine_name: str, model: str, version: str, variant: str) -> DataFrame:
    """Rows of the transcriptions frame from replies."""
    x = replies.withColumn("l", F.explode(parse_lines(F.col("reply"))))
    return x.select("page_id", F.lit(engine_name).alias("engine"), F.lit(model).alias("model"), F.lit(version).alias("prompt_version"), F.lit(variant).alias("variant"), "sample_no", F.col("l.n").alias("line_no"), F.col("l.text").alias("text"), F.col("l.confidence").alias("confidence"), F.current_timestamp().cast("timestamp_ntz").alias("created_at"))


def extraction_request(texts: DataFrame, meta: DataFrame) -> DataFrame:
    """(page_id, message): what a model is asked about each letter of letter_texts(); page_id is the letter's id."""
    m = meta.groupBy("letter_id").agg(F.max("date").alias("d"))
    day = F.coalesce(F.coalesce("d", date_of_letter(F.col("letter_id"))).cast("string"), F.lit("unknown"))
    said = F.concat(F.lit("Letter id: "), F.col("letter_id"), F.lit("\nLetter date: "), day, F.lit("\n\nText:\n"), F.col("text"))
    return texts.join(m, "letter_id", "left").select(F.col("letter_id").alias("page_id"), said.alias("message"))


def enrich(replies: DataFrame, meta: DataFrame) -> dict[str, DataFrame]:
    """entities, events and summaries from replies(letter_id, reply, model). A reply that is no JSON gives no entities
    and a summary row of nulls; a letter whose day is known gives the event that it was written. The names of the batch,
    persons and places together, get the canonical spelling of their cluster."""
    r = replies.withColumn("b", bags(F.col("reply")))
    person = r.select("letter_id", F.explode("b.people").alias("x")).select("letter_id", F.lit("person").alias("kind"), F.coalesce("x.name", F.lit("")).alias("name"), F.col("x.role_guess").alias("detail"), F.col("x.context").alias("context"))
    place = r.select("letter_id", F.explode("b.places").alias("x")).select("letter_id", F.lit("place").alias("kind"), F.coalesce("x.name", F.lit("")).alias("name"), F.col("x.modern_name").alias("detail"), F.lit(None).cast("string").alias("context"))
    entities = person.unionByName(place)
    mapping = fuzzy.canonical_names(entities.select(F.lit("batch").alias("batch"), "name"), "batch")
    entities = with_canonical(entities, mapping).select("letter_id", "kind", "name", "canonical", "detail", "context")
    events = r.select("letter_id", F.explode("b.events").alias("x")).select("letter_id", loose_date(F.col("x.date")).alias("date"), F.coalesce(F.nullif("x.date_text", F.lit("")), "x.date").alias("date_text"), F.coalesce("x.description", F.lit("")).alias("description"), F.coalesce("x.category", F.lit("daily_life")).alias("category"), F.lit("extracted").alias("source"))
    m = meta.groupBy("letter_id").agg(F.max("date").alias("d"))
    day = F.coalesce("d", date_of_letter(F.col("letter_id")))
    written = r.join(m, "letter_id", "left").where(day.isNotNull()).select("letter_id", day.alias("date"), day.cast("string").alias("date_text"), F.concat(F.lit("Brief geschreven ("), "letter_id", F.lit(")")).alias("description"), F.lit("letter").alias("category"), F.lit("letter_date").alias("source"))
    summaries = r.select("letter_id", "b.summary_nl", "b.summary_en", "b.mood", F.coalesce("b.notable_quotes", F.array().cast("array<string>")).alias("notable_quotes"), "model", F.current_timestamp().cast("timestamp_ntz").alias("created_at"))
    return {"entities": entities, "events": events.unionByName(written), "summaries": summaries}


def with_canonical(entities: DataFrame, mapping: DataFrame) -> DataFrame:
    """entities with canonical from mapping(name, canonical), a name without an entry itself."""
    return entities.drop("canonical").join(mapping.select("name", "canonical").distinct(), "name", "left").withColumn("canonical", F.coalesce("canonical", "name"))
