"""All queries of the library by name, with their SQL. Queries of the archive's own operators run on its whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkloom.functions import jsonx
from inkloom.functions import text as T
from inkloom.operators import clock, fuzzy, images, scoring, transcribe, views, voting
from inkloom.session import table as t
from inkloom.sources import store

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


# SQL for DuckDB that says what the column builders say.
S_SPACE = r"[\s\p{Z}\x{0B}\x{1C}-\x{1F}\x{85}]"
S_BREAKS = r"\r\n|[\n\r\x{0B}\x{0C}\x{1C}\x{1D}\x{1E}\x{85}\x{2028}\x{2029}]"
S_WORD = r"[\p{L}\p{N}_]"
S_PUNCT = r"[^\p{L}\p{N}_\s\p{Z}\x{0B}\x{1C}-\x{1F}\x{85}\[\]?''-]"


def s_norm(c: str, fold: bool = False) -> str:
    x = f"replace(nfc_normalize({c}), chr(173), '')"
    x = f"array_to_string(list_filter(regexp_split_to_array({x}, '{S_BREAKS}'), lambda l: not regexp_matches(l, '^{S_SPACE}*#')), ' ')"
    x = rf"regexp_replace({x}, '({S_WORD})- ({S_WORD})', '\1\2', 'g')"
    if fold:
        x = f"replace(lower(regexp_replace({x}, '{S_PUNCT}', ' ', 'g')), 'ß', 'ss')"
    return f"trim(regexp_replace({x}, '{S_SPACE}+', ' ', 'g'))"


def s_words(c: str) -> str:
    return f"list_filter(regexp_split_to_array({c}, '{S_SPACE}+'), lambda w: w <> '')"


def s_names(c: str) -> str:
    strip = lambda x: f"regexp_replace({x}, '^[.,;:!?()\"'']+|[.,;:!?()\"'']+$', '', 'g')"
    w = s_words(c)
    b = strip("z[1]")
    ok = rf"length({b}) >= 3 and regexp_matches({b}, '^\p{{Lu}}') and regexp_matches({b}, '[\p{{Ll}}\p{{Lt}}]') and not regexp_matches(z[2], '[.!?:]$')"
    return f"list_distinct(list_transform(list_filter(list_zip({w}, list_concat(['.'], {w})), lambda z: z[1] is not null and {ok}), lambda z: {b}))"


def s_distance(r: str, h: str) -> str:
    """Distance of two lists of symbols, by single bytes: symbols that the other side lacks can match nothing and share
    one. With more common symbols than there are bytes for, by the table of distances itself."""
    common = f"list_distinct(list_intersect({r}, {h}))"
    code = lambda x, other: f"array_to_string(list_transform({x}, lambda s: coalesce(chr((list_position({common}, s) + 2)::int), chr({other}))), '')"
    dp = f"list_last(list_reduce({r}, lambda prev, x: list_reduce(range(1, len({h}) + 1), lambda acc, j: list_append(acc, least(acc[len(acc)] + 1, prev[j + 1] + 1, prev[j] + (case when {h}[j] = x then 0 else 1 end)::bigint)), [prev[1] + 1]), range(0, len({h}) + 1)))"
    return f"(case when len({common}) <= 120 then levenshtein({code(r, 1)}, {code(h, 2)}) else {dp} end)"


S_READINGS = """with lines as (select distinct page_id, engine, model, prompt_version, variant, sample_no, line_no, text from transcriptions where text is not null),
readings as (select page_id, engine, model, prompt_version, variant, sample_no, string_agg(text, chr(10) order by line_no, text) as hyp from lines group by all)"""
S_FINALS = "finals as (select distinct page_id, 'final' as engine, text_source as model, '-' as prompt_version, '-' as variant, 0 as sample_no, text_final as hyp from letters where text_final is not null)"
S_DAY = r"try_cast(nullif(regexp_extract({}, '^(?:[A-Za-z]\w*-)?(\d{{4}}-\d{{2}}-\d{{2}})', 1), '') as date)"
S_INDEX = f"""p as (select distinct page_id, filename, page_no, coalesce(letter_id, '(los) ' || filename) as letter from pages), g as (select letter, list(page_id order by coalesce(page_no, 0), filename, page_id) as page_ids from p group by letter),
m as (select letter_id, max(date) as date, max(place) as place, max(title) as title from letter_meta group by letter_id),
idx as (select letter, coalesce(m.date, {S_DAY.format('letter')}) as date, place, title, page_ids from g left join m on g.letter = m.letter_id)"""
#: The one row of each page that counts: the largest letter, then number.
S_PAGE = "(select page_id, letter_id, page_no from (select *, row_number() over (partition by page_id order by letter_id desc nulls last, page_no desc nulls last) as rn from pages where page_id is not null) where rn = 1)"
#: Every different text of a page, checked or current.
S_TEXTS = "x as (select distinct page_id, text from (select page_id, gold_text as text from gold union all select page_id, text_final from letters) where text is not null)"
S_LINES = f"list_filter(regexp_split_to_array(text, '{S_BREAKS}'), lambda l: regexp_matches(l, '[^\\s\\p{{Z}}\\x{{0B}}\\x{{1C}}-\\x{{1F}}\\x{{85}}]') and not regexp_matches(l, '^{S_SPACE}*#'))"


def _texts(spark, d):
    a = t(spark, d, "gold").select("page_id", F.col("gold_text").alias("text"))
    return a.unionByName(t(spark, d, "letters").select("page_id", F.col("text_final").alias("text"))).where("text IS NOT NULL").distinct()


# Scans, filters, projections ------------------------------------------------------------------------------------------


@query("select page_id, engine, model, prompt_version, variant, sample_no, line_no, text from transcriptions where engine = 'scanocr' and line_no = 1")
def frame_filter(spark, d):
    x = t(spark, d, "transcriptions").where("engine = 'scanocr' AND line_no = 1")
    return x.select("page_id", "engine", "model", "prompt_version", "variant", "sample_no", "line_no", "text")


@query(
    "select 'pages' as frame, count(*) as n_rows from pages union all select 'letters', count(*) from letters union all select 'letter_meta', count(*) from letter_meta union all select 'entities', count(*) from entities union all select 'letter_events', count(*) from letter_events union all select 'summaries', count(*) from summaries"
)
def export_manifest(spark, d):
    out = None
    for n in ("pages", "letters", "letter_meta", "entities", "letter_events", "summaries"):
        x = t(spark, d, n).agg(F.count("*").alias("n_rows")).select(F.lit(n).alias("frame"), "n_rows")
        out = x if out is None else out.unionByName(x)
    return out


@query("select count(distinct page_id) as pages, count(*) filter (where letter_id is null) as without_letter, count(*) filter (where page_no is null) as without_number, count(*) filter (where captured_at is null) as without_time from pages")
def page_counts(spark, d):
    return t(spark, d, "pages").agg(F.count_distinct("page_id").alias("pages"), F.count_if(F.col("letter_id").isNull()).alias("without_letter"), F.count_if(F.col("page_no").isNull()).alias("without_number"), F.count_if(F.col("captured_at").isNull()).alias("without_time"))


@query("select page_id, letter_id, page_no, 'images/' || page_id || '.jpg' as image from pages")
def image_path(spark, d):
    return t(spark, d, "pages").select("page_id", "letter_id", "page_no", store.image_path(F.col("page_id")).alias("image"))


@query(
    r"""with s as (select page_id, filename, coalesce(nullif(regexp_extract(filename, '^(.+)\.[^.]*$', 1), ''), filename) as stem from pages)
select page_id, stem, nullif(regexp_extract(stem, '(?i)^(.+?)_p(\d+)(?:_.*)?$', 1), '') as letter, try_cast(nullif(regexp_extract(stem, '(?i)^(.+?)_p(\d+)(?:_.*)?$', 2), '') as int) as page from s"""
)
def parse_filename(spark, d):
    s = t(spark, d, "pages").select("page_id", T.stem(F.col("filename")).alias("stem"))
    return s.select("page_id", "stem", T.letter_of(F.col("stem")).alias("letter"), T.page_of(F.col("stem")).alias("page"))


@query("select page_id, substr(sha256(gold_text), 1, 16) as content_id, substr(sha1(gold_text), 1, 8) as version from gold")
def content_hashes(spark, d):
    return t(spark, d, "gold").select("page_id", T.content_id(F.col("gold_text")).alias("content_id"), T.prompt_version(F.col("gold_text")).alias("version"))


@query(
    """with x as (select event_id, trim(date_text) as s from letter_events where date_text is not null)
select event_id, s, case when regexp_matches(s, '^\\d{4}-\\d{2}-\\d{2}') then try_cast(substr(s, 1, 10) as date) when regexp_matches(s, '^\\d{4}-\\d{2}$') then try_cast(s || '-01' as date) when regexp_matches(s, '^\\d{4}$') then try_cast(s || '-01-01' as date) end as day from x"""
)
def parse_date(spark, d):
    x = t(spark, d, "letter_events").where("date_text IS NOT NULL").select("event_id", F.trim("date_text").alias("s"))
    return x.select("event_id", "s", T.loose_date(F.col("s")).alias("day"))


@query(
    """with x as (select distinct letter_id from letter_events where letter_id is not null)
select letter_id, """
    + S_DAY.format("letter_id")
    + " as day from x"
)
def letter_day(spark, d):
    return t(spark, d, "letter_events").where("letter_id IS NOT NULL").select("letter_id").distinct().select("letter_id", views.date_of_letter(F.col("letter_id")).alias("day"))


@query(
    """select letter_id, date, concat_ws(' ', day(date)::varchar, ['januari','februari','maart','april','mei','juni','juli','augustus','september','oktober','november','december'][month(date)], year(date)::varchar) as label
from letter_meta where date is not null"""
)
def dutch_dates(spark, d):
    return t(spark, d, "letter_meta").where("date IS NOT NULL").select("letter_id", "date", views.dutch_date(F.col("date")).alias("label"))


# Text functions ---------------------------------------------------------------------------------------------------------


@query(f"with {S_TEXTS} select page_id, text, {s_norm('text')} as t from x")
def normalise_plain(spark, d):
    return _texts(spark, d).select("page_id", "text", T.normalise(F.col("text")).alias("t"))


@query(f"select doc_id, {s_norm('text', True)} as t from documents")
def normalise_fold(spark, d):
    return t(spark, d, "documents").select("doc_id", T.normalise(F.col("text"), True, True).alias("t"))


@query(f"select doc_id, list_sort({s_names('text')}) as names from documents where text is not null")
def proper_nouns(spark, d):
    return t(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.array_sort(T.proper_nouns(F.col("text"))).alias("names"))


S_LINE_PAIRS = """with l as (select page_id, line_no, min(text) as a from transcriptions where text is not null and engine = 'local' and sample_no = 0 group by page_id, line_no),
o as (select distinct page_id, line_no, text as b from transcriptions where text is not null), p as (select page_id, line_no, a, b from l join o using (page_id, line_no))"""


def _line_pairs(spark, d):
    """Every different text that a reading has for a line, beside the reference reading's line of that number."""
    x = t(spark, d, "transcriptions").where("text IS NOT NULL")
    a = x.where("engine = 'local' AND sample_no = 0").groupBy("page_id", "line_no").agg(F.min("text").alias("a"))
    return a.join(x.select("page_id", "line_no", F.col("text").alias("b")).distinct(), ["page_id", "line_no"]).select("page_id", "line_no", "a", "b")


@query(
    S_LINE_PAIRS
    + f""", n as (select page_id, line_no, a, b, string_split({s_norm('a')}, '') as r, string_split({s_norm('b')}, '') as h from p)
select page_id, line_no, a, b, round(case when array_to_string(r, '') = '' then case when array_to_string(h, '') = '' then 0.0 else 1.0 end else {s_distance('r', 'h')}::double / len(r) end, 9) as cer from n"""
)
def cer_lines(spark, d):
    x = _line_pairs(spark, d)
    return x.select("page_id", "line_no", "a", "b", F.round(T.cer(T.normalise(F.col("a")), T.normalise(F.col("b"))), 9).alias("cer"))


@query(
    S_LINE_PAIRS
    + f""", n as (select page_id, line_no, a, b, {s_words(s_norm('a', True))} as r, {s_words(s_norm('b', True))} as h from p)
select page_id, line_no, a, b, round(case when len(r) = 0 then case when len(h) = 0 then 0.0 else 1.0 end else {s_distance('r', 'h')}::double / len(r) end, 9) as wer from n"""
)
def wer_lines(spark, d):
    x = _line_pairs(spark, d).select("page_id", "line_no", "a", "b", T.normalise(F.col("a"), True, True).alias("r"), T.normalise(F.col("b"), True, True).alias("h"))
    return x.select("page_id", "line_no", "a", "b", F.round(T.wer(F.col("r"), F.col("h")), 9).alias("wer"))


@query(f"with {S_TEXTS} select page_id, array_to_string({S_LINES}, chr(10)) as t from x")
def gold_clean(spark, d):
    return _texts(spark, d).select("page_id", F.array_join(jsonx.gold_lines(F.col("text")), "\n").alias("t"))


@query(f"with {S_TEXTS} select page_id, to_json({{'lines': list_transform({S_LINES}, lambda l, i: {{'n': i, 'text': l, 'confidence': 'high'}})}})::varchar as reply from x")
def gold_json(spark, d):
    return _texts(spark, d).select("page_id", jsonx.gold_json(F.col("text")).alias("reply"))


@query(f"with {S_TEXTS}, y as (select page_id, {S_LINES} as a from x) select page_id, unnest(range(1, len(a) + 1))::int as n, unnest(a) as text, 'high' as confidence from y")
def parse_lines_json(spark, d):
    x = _texts(spark, d).withColumn("reply", jsonx.gold_json(F.col("text"))).where(jsonx.well_formed(F.col("reply")))
    return x.select("page_id", F.explode(jsonx.parse_lines(F.col("reply"))).alias("l")).select("page_id", "l.n", "l.text", "l.confidence")


@query("select letter_id, kind, name, detail, case when kind = 'person' then context end as context from entities where kind in ('person', 'place')")
def json_bags(spark, d):
    """The replies that would give each letter's people and places, taken apart again."""
    e = t(spark, d, "entities")
    people = F.filter(F.collect_list(F.when(F.col("kind") == "person", F.struct("name", F.col("detail").alias("role_guess"), "context"))), lambda x: x.isNotNull())
    places = F.filter(F.collect_list(F.when(F.col("kind") == "place", F.struct("name", F.col("detail").alias("modern_name")))), lambda x: x.isNotNull())
    reply = F.concat(F.lit("```json\n"), F.to_json(F.struct(people.alias("people"), places.alias("places"))), F.lit("\n```"))
    b = e.groupBy("letter_id").agg(reply.alias("reply")).select("letter_id", jsonx.bags(F.col("reply")).alias("b"))
    a = b.select("letter_id", F.explode("b.people").alias("x")).select("letter_id", F.lit("person").alias("kind"), "x.name", F.col("x.role_guess").alias("detail"), "x.context")
    return a.unionByName(b.select("letter_id", F.explode("b.places").alias("x")).select("letter_id", F.lit("place").alias("kind"), "x.name", F.col("x.modern_name").alias("detail"), F.lit(None).cast("string").alias("context")))


# Scoring ------------------------------------------------------------------------------------------------------------------


@query(S_READINGS + " select * from readings")
def join_lines(spark, d):
    return scoring.join_lines(t(spark, d, "transcriptions"))


S_SCORED = f""", systems as (select * from readings union all select * from finals),
j as (select s.*, g.gold_text from systems s join gold g on s.page_id = g.page_id),
e as (select distinct page_id, hyp, gold_text from j),
n as (select page_id, hyp, {s_norm('gold_text')} as r, {s_norm('hyp')} as h, {s_words(s_norm('gold_text', True))} as rw, {s_words(s_norm('hyp', True))} as hw from e),
c as (select page_id, hyp, r, h, rw, hw, string_split(r, '') as rc, string_split(h, '') as hc, {s_names('r')} as names, list_transform({s_words('h')}, lambda w: regexp_replace(w, '^[.,;:!?()"'']+|[.,;:!?()"'']+$', '', 'g')) as toks from n),
scored as (select page_id, hyp,
 case when r = '' then case when h = '' then 0.0 else 1.0 end else {s_distance('rc', 'hc')}::double / length(r) end as cer,
 case when len(rw) = 0 then case when len(hw) = 0 then 0.0 else 1.0 end else {s_distance('rw', 'hw')}::double / len(rw) end as wer,
 case when len(names) > 0 then len(list_intersect(names, toks))::double / len(names) end as name_recall from c),
d as (select j.page_id, engine, model, prompt_version, variant, sample_no, cer, wer, name_recall from j join scored s on j.page_id = s.page_id and j.hyp = s.hyp)"""


def _scored(spark, d):
    readings = scoring.join_lines(t(spark, d, "transcriptions")).unionByName(scoring.finals(t(spark, d, "letters")))
    return scoring.score(readings, t(spark, d, "gold"))


@query(S_READINGS + ", " + S_FINALS + S_SCORED + " select page_id, engine, model, prompt_version, variant, sample_no, round(cer, 9) as cer, round(wer, 9) as wer, round(name_recall, 9) as name_recall from d")
def leaderboard_detail(spark, d):
    x = _scored(spark, d)
    return x.select("page_id", *scoring.SYSTEM, "sample_no", *[F.round(c, 9).alias(c) for c in ("cer", "wer", "name_recall")])


@query(S_READINGS + ", " + S_FINALS + S_SCORED + " select engine, model, prompt_version, variant, count(distinct page_id) as pages, count(*) as samples, round(avg(cer), 9) as cer, round(avg(wer), 9) as wer, round(avg(name_recall), 9) as name_recall from d group by all")
def leaderboard(spark, d):
    x = scoring.leaderboard(_scored(spark, d))
    return x.select(*scoring.SYSTEM, "pages", "samples", *[F.round(c, 9).alias(c) for c in ("cer", "wer", "name_recall")])


# Consensus of the archive, entity resolution ------------------------------------------------------------------------------


@query(
    """with r as (select page_id, engine, model, prompt_version, variant, sample_no, list(text order by line_no, text) as lines from transcriptions group by all)
select *, row_number() over (partition by page_id order by (case when engine = 'local' then 0 else 10 end) + sample_no, engine, model, prompt_version, variant, sample_no) as place from r"""
)
def readings_ranked(spark, d):
    return voting.ranked(t(spark, d, "transcriptions"))


@query()
def vote_page(spark, d):
    v = voting.voted(t(spark, d, "transcriptions"))
    return v.select("page_id", "n", F.array_join(F.col("tokens.text"), " ").alias("text"), T.marked(F.col("tokens")).alias("marked"))


@query()
def reconcile(spark, d):
    return store.unprotected(voting.reconciled(voting.voted(t(spark, d, "transcriptions"))), t(spark, d, "letters"))


@query("select page_id, text_final from letters where page_id not in (select page_id from letters where text_source in ('reviewed', 'gold') and page_id is not null) and page_id is not null")
def protected_pages(spark, d):
    x = t(spark, d, "letters")
    return store.unprotected(x.where("page_id IS NOT NULL"), x).select("page_id", "text_final")


@query()
def canonicalise(spark, d):
    e = t(spark, d, "entities").where("letter_id IS NOT NULL").select(F.substring_index("letter_id", "-", 1).alias("collection"), "name")
    return fuzzy.canonical_names(e, "collection")


# Updates -------------------------------------------------------------------------------------------------------------------


@query(
    """with new as (select page_id, letter_id, 99 as page_no from pages where letter_id is null)
select page_id, letter_id, page_no from pages where page_id not in (select page_id from new where page_id is not null) union all select * from new"""
)
def upsert_pages(spark, d):
    p = t(spark, d, "pages").select("page_id", "letter_id", "page_no")
    return store.upsert(p, p.where("letter_id IS NULL").withColumn("page_no", F.lit(99)), ["page_id"])


@query(
    """with e as (select page_id, engine, model, prompt_version, variant, sample_no, line_no, text from transcriptions), new as (select page_id, engine, model, prompt_version, variant, sample_no, line_no, upper(replace(text, 'ß', 'ss')) as text from e where engine = 'scanocr')
select e.* from e left join (select distinct page_id, engine, model, prompt_version, variant, sample_no from new) n using (page_id, engine, model, prompt_version, variant, sample_no) where n.page_id is null
union all select * from new"""
)
def upsert_composite(spark, d):
    keys = ["page_id", "engine", "model", "prompt_version", "variant", "sample_no"]
    e = t(spark, d, "transcriptions").select(*keys, "line_no", "text")
    return store.upsert(e, e.where("engine = 'scanocr'").withColumn("text", F.upper(F.replace("text", F.lit("ß"), F.lit("ss")))), keys)


@query(
    """with new as (select letter_id, kind, name, name as canonical from entities where kind = 'place' and letter_id is not null)
select letter_id, kind, name, canonical from entities where letter_id not in (select letter_id from new) union all select * from new"""
)
def replace_bags(spark, d):
    e = t(spark, d, "entities").select("letter_id", "kind", "name", "canonical")
    return store.replace_bags(e, e.where("kind = 'place' AND letter_id IS NOT NULL").withColumn("canonical", F.col("name")))


@query("select page_id, case when page_id = '208ce0a115d9af21' then 'X-L001' else letter_id end as letter_id, case when page_id = '208ce0a115d9af21' then 7 else page_no end as page_no from pages")
def assign_page(spark, d):
    return store.assigned(t(spark, d, "pages").select("page_id", "letter_id", "page_no"), "208ce0a115d9af21", "X-L001", 7)


@query(
    """with e as (select distinct name, canonical from entities where kind = 'place' and canonical is not null and name is not null), m as (select name, min(canonical) as canonical from e group by name)
select x.letter_id, x.name, coalesce(m.canonical, x.name) as canonical from entities x left join m on x.name = m.name where x.kind = 'place'"""
)
def replace_names(spark, d):
    e = t(spark, d, "entities").where("kind = 'place'")
    m = e.where("canonical IS NOT NULL AND name IS NOT NULL").groupBy("name").agg(F.min("canonical").alias("canonical"))
    return e.select("letter_id", "name").join(m, "name", "left").select("letter_id", "name", F.coalesce("canonical", "name").alias("canonical"))


# Views ---------------------------------------------------------------------------------------------------------------------


@query(
    """with x as (select p.letter_id, p.page_no, p.page_id, l.text_final from (select distinct page_id, letter_id, page_no from pages where letter_id is not null) p join (select distinct page_id, text_final from letters) l on p.page_id = l.page_id)
select letter_id, coalesce(string_agg(text_final, chr(10) order by page_no nulls first, page_id, text_final nulls first), '') as text, list(page_id order by page_no nulls first, page_id, text_final nulls first) as page_ids from x group by letter_id"""
)
def letter_texts(spark, d):
    return views.letter_texts(t(spark, d, "pages"), t(spark, d, "letters"))


@query(f"with {S_INDEX} select * from idx")
def letter_index(spark, d):
    return views.letter_index(t(spark, d, "pages"), t(spark, d, "letter_meta"))


S_HITS = f"""with x as (select distinct page_id, text_final from letters where text_final is not null), l as (select page_id, string_split(text_final, chr(10)) as a from x), k as (select page_id, unnest(range(1, len(a) + 1)) as line_no, unnest(a) as line from l),
o as {S_PAGE}, h as (select *, instr(lower(line), 'haven') as pos from k),
hits as (select h.page_id, coalesce(o.letter_id, '?') as letter_id, o.page_no, line_no, line, substr(line, 1, pos - 1) || '«' || substr(line, pos, 5) || '»' || substr(line, pos + 5) as snippet from h left join o on h.page_id = o.page_id where pos > 0)"""


@query(S_HITS + " select * from hits")
def search_lines(spark, d):
    return views.search(t(spark, d, "letters"), t(spark, d, "pages"), " haven ", None)


@query(S_HITS + " select * from hits order by page_id, line_no limit 200")
def search_view(spark, d):
    """The view with its cap of 200 hits."""
    return views.search(t(spark, d, "letters"), t(spark, d, "pages"), "haven")


@query(
    """with e as (select coalesce(canonical, name) as name, letter_id from entities where kind = 'person' and letter_id is not null), g as (select name, list_sort(list(distinct letter_id)) as letters, count(distinct letter_id) as n from e where name is not null group by name)
select name, letters, n, round(n * 100.0 / max(n) over (), 6)::double as share from g"""
)
def entity_groups(spark, d):
    x = views.entity_groups(t(spark, d, "entities"), "person")
    return x.withColumn("share", F.col("share").cast("double"))


S_TIMELINE = (
    f"with {S_INDEX}, line as (select date, description as label, 'event' as kind from letter_events where source = 'extracted' and date is not null union all select date, letter, 'letter' from idx where date is not null union all select * from (values "
    + ", ".join(f"(date '{a}', '{b}', 'anchor')" for a, b in views.ANCHORS)
    + "))"
)


@query(S_TIMELINE + " select date, label, kind from line")
def timeline_events(spark, d):
    return views.timeline(spark, t(spark, d, "letter_events"), letter_index(spark, d))


@query(S_TIMELINE + " select min(date) as first, max(date) as last, (min(date) - interval 2 month)::date as axis_from, (max(date) + interval 2 month)::date as axis_to from line")
def timeline_extent(spark, d):
    return views.timeline_extent(timeline_events(spark, d))


@query(
    """select p.page_id, p.letter_id, x.text, s.summary from (select page_id, max(letter_id) as letter_id from pages group by page_id) p
left join (select page_id, max(text_final) as text from letters group by page_id) x on p.page_id = x.page_id left join (select letter_id, max(summary_nl) as summary from summaries group by letter_id) s on p.letter_id = s.letter_id"""
)
def reader_view(spark, d):
    return views.reader(t(spark, d, "pages"), t(spark, d, "letters"), t(spark, d, "summaries"))


@query(
    """with x as (select distinct page_id, text_final, uncertain_spans from letters where text_final is not null), l as (select page_id, uncertain_spans, string_split(text_final, chr(10)) as a from x),
k as (select page_id, uncertain_spans, unnest(range(1, len(a) + 1)) as line_no, unnest(a) as line from l), w as (select page_id, line_no, list_filter(uncertain_spans, lambda s: s.line_no = line_no) as spans, unnest(string_split(line, ' ')) as word from k),
m as (select page_id, line_no::int as line_no, word, list_filter(spans, lambda s: s.word = word)[1].alternatives as alternatives from w) select * from m where alternatives is not null"""
)
def marked_lines(spark, d):
    return views.marked_lines(t(spark, d, "letters"))


S_CONTEXT = f"""with p as {S_PAGE}, f as (select letter_id, page_no + 1 as page_no, min(page_id) as previous_page from p where letter_id is not null and page_no is not null group by letter_id, p.page_no),
x as (select page_id as previous_page, string_split(regexp_replace(max(text_final), chr(10) || '$', ''), chr(10)) as a from letters where text_final is not null group by page_id),
j as (select p.page_id, p.letter_id, p.page_no, f.previous_page, array_to_string(a[greatest(1, len(a) - 2):], chr(10)) as tail from p left join f on p.letter_id = f.letter_id and p.page_no = f.page_no and f.page_no > 1 left join x on f.previous_page = x.previous_page),
c as (select page_id, letter_id, previous_page, tail, concat_ws(chr(10), case when letter_id <> '' then 'Letter id: ' || letter_id || '.' end, case when page_no <> 0 then 'This is page ' || page_no || ' of the letter.' end, 'The previous page ended with:' || chr(10) || tail) as context from j)"""


@query(S_CONTEXT + " select * from c")
def page_context(spark, d):
    return views.page_context(t(spark, d, "pages"), t(spark, d, "letters"))


S_STEM = r"coalesce(nullif(regexp_extract(filename, '^(.+)\.[^.]*$', 1), ''), filename)"
S_SHOTS = f"""s as (select page_id, {S_STEM} as stem from pages), h as (select distinct page_id from s where stem in (select stem from s where page_id = (select min(page_id) from gold))),
g as (select distinct page_id as shot from gold where page_id not in (select page_id from h) order by 1 limit 3), q as (select distinct page_id from pages where page_id is not null),
r as (select q.page_id, g.shot, row_number() over (partition by q.page_id order by g.shot) as n from q join g on q.page_id <> g.shot), shots as (select * from r where n <= 2)"""


def _shots(spark, d):
    g, p = t(spark, d, "gold"), t(spark, d, "pages")
    held = p.join(g.agg(F.min("page_id").alias("page_id")), "page_id", "left_semi").select(T.stem(F.col("filename")).alias("stem")).distinct()
    return views.few_shot(g, held, p)


@query(f"with {S_SHOTS} select * from shots")
def few_shot(spark, d):
    return _shots(spark, d)


@query(
    S_CONTEXT
    + f""", {S_SHOTS}, n as (select page_id, count(*) as k from shots group by page_id)
select c.page_id, (coalesce(k, 0) + 1)::int as user_turns, (2 * coalesce(k, 0) + 1)::int as turns, 'Transcribe this page. The first image is the full page; the next 2 images are zoomed crops of the same page, top to bottom.' || case when context <> '' then chr(10) || context else '' end as said
from c left join n on c.page_id = n.page_id"""
)
def page_messages(spark, d):
    """What a model would be sent for every page: examples, image, bands, context."""
    c = page_context(spark, d).withColumns({"image": store.image_path(F.col("page_id")), "bands": F.array(F.concat("page_id", F.lit("_band0.jpg")), F.concat("page_id", F.lit("_band1.jpg")))})
    shots = _shots(spark, d).withColumn("image", store.image_path(F.col("shot")))
    m = F.col("messages")
    last = F.element_at(F.element_at(m, -1)["parts"], -1)["text"]
    return transcribe.messages(c, shots, t(spark, d, "gold")).select("page_id", transcribe.user_turns(m).alias("user_turns"), F.size(m).alias("turns"), last.alias("said"))


# Images --------------------------------------------------------------------------------------------------------------------


@query(
    """with x as (select page_id, height, unnest(range(0, 5))::int as band from pages where height is not null), y as (select page_id, height, band, band * (height / (5 - 4 * 0.18::double)) * (1 - 0.18::double) as a, height / (5 - 4 * 0.18::double) as step from x)
select page_id, height, band, round_even(a, 0)::int as y0, least(height, round_even(a, 0)::int + round_even(step, 0)::int) as y1 from y"""
)
def band_geometry(spark, d):
    return images.bands(t(spark, d, "pages").select("page_id", "height"))


@query("select vec_id, list_transform(embedding, lambda x: floor(greatest(0.0::double, least(1.0::double, (floor(abs(x) * 255) % 256 / 255.0::double - 0.3::double) / (0.8::double - 0.3::double))) * 255.0::double)::bigint) as pixels from embeddings")
def levels_stretch(spark, d):
    pixel = lambda x: F.floor(F.abs(x) * 255) % 256
    return t(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: images.stretched(pixel(x))).alias("pixels"))


# Problem 3 -----------------------------------------------------------------------------------------------------------------


@query()
def p3_found(spark, d):
    return clock.normalise(t(spark, d, "letter_events"), t(spark, d, "clock_rules"))


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(SQL)
