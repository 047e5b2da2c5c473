"""Views of the archive: letters, search, entities, timeline, reader, context of a page."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkloom.functions.text import snippet, stem

# Days of general history that anchor the timeline; a caller may give a table of their own.
ANCHORS = [
    ("1944-11-08", "Walcheren bevrijd; Middelburg vrij"),
    ("1945-05-05", "Duitse capitulatie in Nederland"),
    ("1945-08-15", "Japanse capitulatie"),
    ("1945-08-17", "Soekarno roept de Republiek Indonesië uit"),
    ("1946-11-15", "Akkoord van Linggadjati"),
    ("1947-07-21", "Eerste politionele actie begint"),
    ("1948-12-19", "Tweede politionele actie begint"),
    ("1949-12-27", "Soevereiniteitsoverdracht aan Indonesië"),
]
# Dutch names of months.
MAANDEN = ["januari", "februari", "maart", "april", "mei", "juni", "juli", "augustus", "september", "oktober", "november", "december"]


def anchors(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(datetime.date.fromisoformat(d), x) for d, x in ANCHORS], "date date, label string")


def date_of_letter(letter_id: Column) -> Column:
    """The day with which a letter's id begins, after a collection's code if it has one, or null."""
    return F.try_to_timestamp(F.nullif(F.regexp_extract(letter_id, r"^(?:[A-Za-z]\w*-)?(\d{4}-\d{2}-\d{2})", 1), F.lit("")), F.lit("yyyy-MM-dd")).cast("date")


def dutch_date(d: Column) -> Column:
    month = F.element_at(F.array(*map(F.lit, MAANDEN)), F.month(d))
    return F.concat_ws(" ", F.dayofmonth(d).cast("string"), month, F.year(d).cast("string"))


def letter_texts(pages: DataFrame, letters: DataFrame) -> DataFrame:
    """(letter_id, text, page_ids) in the order of pages, pages without a number first."""
    x = pages.where("letter_id IS NOT NULL").select("page_id", "letter_id", "page_no").distinct().join(letters.select("page_id", "text_final").distinct(), "page_id")
    g = x.groupBy("letter_id").agg(F.array_sort(F.collect_list(F.struct("page_no", "page_id", "text_final"))).alias("x"))
    return g.select("letter_id", F.array_join(F.col("x.text_final"), "\n").alias("text"), F.col("x.page_id").alias("page_ids"))


def letter_index(pages: DataFrame, meta: DataFrame) -> DataFrame:
    """Letters with their pages in order, their date, place and title; a page without a letter is one of its own. Undated
    ones last. Of several rows of metadata the largest value stands."""
    p = pages.select("page_id", "filename", "page_no", F.coalesce("letter_id", F.concat(F.lit("(los) "), F.col("filename"))).alias("letter")).distinct()
    g = p.groupBy("letter").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("page_no", F.lit(0)).alias("no"), "filename", "page_id"))).alias("x"))
    m = meta.groupBy("letter_id").agg(F.max("date").alias("date"), F.max("place").alias("place"), F.max("title").alias("title"))
    out = g.join(m, g["letter"] == m["letter_id"], "left").select("letter", F.coalesce("date", date_of_letter(F.col("letter"))).alias("date"), "place", "title", F.col("x.page_id").alias("page_ids"))
    return out.orderBy(F.asc_nulls_last("date"), "letter")


def search(letters: DataFrame, pages: DataFrame, needle: str, most: int | None = 200) -> DataFrame:
    """One hit per line that holds the needle, case aside; needles under two characters find nothing. `most` is the
    view's cap, None for all hits."""
    needle = needle.strip()
    lines = letters.where("text_final IS NOT NULL").select("page_id", "text_final").distinct().select("page_id", F.posexplode(F.split("text_final", "\n")).alias("i", "line"))
    hits = lines.where(F.lit(len(needle) >= 2) & (F.instr(F.lower("line"), F.lit(needle.lower())) > 0))
    owner = pages.groupBy("page_id").agg(F.max(F.struct("letter_id", "page_no")).alias("o"))
    out = hits.join(owner, "page_id", "left").select("page_id", F.coalesce("o.letter_id", F.lit("?")).alias("letter_id"), F.col("o.page_no").alias("page_no"), (F.col("i") + 1).cast("bigint").alias("line_no"), "line", snippet(F.col("line"), needle).alias("snippet"))
    return out.orderBy("page_id", "line_no").limit(most) if most else out


def entity_groups(entities: DataFrame, kind: str) -> DataFrame:
    """Names by the number of letters they occur in, with the letters and the share of the largest."""
    e = entities.where((F.col("kind") == kind) & F.col("letter_id").isNotNull()).select(F.coalesce("canonical", "name").alias("name"), "letter_id").where("name IS NOT NULL")
    g = e.groupBy("name").agg(F.array_sort(F.collect_set("letter_id")).alias("letters")).withColumn("n", F.size("letters").cast("bigint"))
    # The largest of the sorted result: one value from the counted names, read again from the same shuffle.
    top = e.groupBy("name").agg(F.count_distinct("letter_id").alias("n")).agg(F.max("n").alias("top"))
    return g.select("name", "letters", "n", F.round(F.col("n") * 100.0 / top.scalar(), 6).alias("share")).orderBy(F.desc("n"), "name")


def timeline(spark: SparkSession, events: DataFrame, letters: DataFrame, given: DataFrame | None = None) -> DataFrame:
    """(date, label, kind): dated extracted events, letters with a date, and anchors (given(date, label) or ANCHORS).

    letters: letter_index(), whose dates come from the metadata or from the letter's id.
    """
    a = events.where("source = 'extracted' AND date IS NOT NULL").select("date", F.col("description").alias("label"), F.lit("event").alias("kind"))
    b = letters.where("date IS NOT NULL").select("date", F.col("letter").alias("label"), F.lit("letter").alias("kind"))
    c = (given if given is not None else anchors(spark)).select("date", "label", F.lit("anchor").alias("kind"))
    return a.unionByName(b).unionByName(c)


def timeline_extent(line: DataFrame) -> DataFrame:
    """First and last day with two months of room on either side."""
    x = line.agg(F.min("date").alias("first"), F.max("date").alias("last"))
    return x.select("first", "last", F.add_months("first", -2).alias("axis_from"), F.add_months("last", 2).alias("axis_to"))


def reader(pages: DataFrame, letters: DataFrame, summaries: DataFrame) -> DataFrame:
    """Pages with their text and their letter's summary; of several rows for a key the one that sorts last."""
    p = pages.groupBy("page_id").agg(F.max("letter_id").alias("letter_id"))
    x = letters.groupBy("page_id").agg(F.max("text_final").alias("text"))
    s = summaries.groupBy("letter_id").agg(F.max("summary_nl").alias("summary"))
    return p.join(x, "page_id", "left").join(s, "letter_id", "left").select("page_id", "letter_id", "text", "summary")


def marked_lines(letters: DataFrame) -> DataFrame:
    """Lines of the current texts with the words that are uncertain in them: any equal word of the line counts; the
    alternatives are the first span's."""
    x = letters.where("text_final IS NOT NULL").select("page_id", "text_final", "uncertain_spans").distinct()
    lines = x.select("page_id", "uncertain_spans", F.posexplode(F.split("text_final", "\n")).alias("i", "line"))
    spans = F.filter("uncertain_spans", lambda s: s["line_no"] == F.col("i") + 1)
    ws = F.split("line", " ")
    marks = F.filter(F.transform(ws, lambda w: F.struct(w.alias("word"), F.try_element_at(F.filter(spans, lambda s: s["word"] == w), F.lit(1))["alternatives"].alias("alternatives"))), lambda m: m["alternatives"].isNotNull())
    return lines.withColumn("m", marks).where(F.size("m") > 0).select("page_id", (F.col("i") + 1).alias("line_no"), F.explode("m").alias("m")).select("page_id", "line_no", "m.word", "m.alternatives")


def page_context(pages: DataFrame, letters: DataFrame, lines: int = 3) -> DataFrame:
    """(page_id, letter_id, previous_page, tail, context) of every page: what is told to a model about it. The tail is the
    last lines of the page before, where there is one with a text; context is never null, but may be empty."""
    p = pages.where("page_id IS NOT NULL").groupBy("page_id").agg(F.max(F.struct("letter_id", "page_no")).alias("p")).select("page_id", "p.*")
    first = p.where("letter_id IS NOT NULL AND page_no IS NOT NULL").groupBy("letter_id", "page_no").agg(F.min("page_id").alias("previous_page")).select("letter_id", (F.col("page_no") + 1).alias("page_no"), "previous_page")
    x = letters.where("text_final IS NOT NULL").groupBy("page_id").agg(F.max("text_final").alias("t")).select(F.col("page_id").alias("previous_page"), F.split(F.regexp_replace("t", r"\n$", ""), "\n").alias("a"))
    j = p.join(first.where("page_no > 1"), ["letter_id", "page_no"], "left").join(x, "previous_page", "left")
    n = F.least(F.size("a"), F.lit(lines))
    tail = F.array_join(F.slice("a", F.size("a") - n + 1, n), "\n")
    told = F.concat_ws(
        "\n",
        F.when(F.col("letter_id") != "", F.concat(F.lit("Letter id: "), F.col("letter_id"), F.lit("."))),
        F.when(F.col("page_no") != 0, F.concat(F.lit("This is page "), F.col("page_no").cast("string"), F.lit(" of the letter."))),
        F.concat(F.lit("The previous page ended with:\n"), tail),
    )
    return j.select("page_id", "letter_id", "previous_page", tail.alias("tail"), told.alias("context"))


def few_shot(gold: DataFrame, holdout: DataFrame, pages: DataFrame, k: int = 2, processed: DataFrame | None = None) -> DataFrame:
    """Per page the first k checked pages that are neither itself nor held out: (page_id, shot, n).

    holdout(stem): file names without suffix. processed(page_id): pages whose image is ready; only these are shown.
    Only the first k + 1 candidates can be among any page's first k: they are one row that every page carries, so that no
    page meets all of them and nothing is joined by inequality."""
    held = pages.select("page_id", stem(F.col("filename")).alias("stem")).join(holdout.select("stem"), "stem", "left_semi").select("page_id")
    c = gold.where("page_id IS NOT NULL").select("page_id").distinct().join(held, "page_id", "left_anti")
    c = c.join(processed.select("page_id"), "page_id", "left_semi") if processed is not None else c
    shots = c.orderBy("page_id").limit(k + 1).agg(F.array_sort(F.collect_list("page_id")).alias("shots"))
    mine = pages.where("page_id IS NOT NULL").select("page_id").distinct().withColumn("shots", shots.scalar())
    others = F.filter("shots", lambda s: s != F.col("page_id"))
    return mine.select("page_id", F.posexplode(others).alias("i", "shot")).where(F.col("i") < k).select("page_id", "shot", (F.col("i") + 1).cast("bigint").alias("n"))
