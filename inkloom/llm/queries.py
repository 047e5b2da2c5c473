"""Queries of this subpackage, by name, and their SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkloom.llm import consensus, forms, leaks, levels, names, packing, readings, scans, terms, truncation
from inkloom.session import table as t


def p1_found(spark, d):
    return names.found(t(spark, d, "entities"))


def p1_clusters(spark, d):
    r = names.resolve(t(spark, d, "entities"))
    return r.groupBy("collection", "who").agg(F.count("*").alias("n_spellings"), F.array_sort(F.collect_list("s")).alias("spellings"))


def p2_found(spark, d):
    return scans.found(t(spark, d, "letters"), t(spark, d, "transcriptions"), t(spark, d, "documents"), t(spark, d, "gold"))


def p2_paragraphs(spark, d):
    tr = t(spark, d, "transcriptions")
    r = scans.repair(scans.readings(t(spark, d, "letters"), tr), scans.clean_texts(t(spark, d, "documents"), t(spark, d, "gold"), tr), lines=scans.clean_lines(t(spark, d, "gold"), tr))
    return r.select("table_name", "page_id", "engine", "reading", F.posexplode("paragraphs").alias("paragraph_no", "paragraph"))


def p4_found(spark, d):
    return consensus.found(t(spark, d, "transcriptions"))


def p4_consensus(spark, d):
    return consensus.consensus_text(t(spark, d, "transcriptions"))


def p4_annotators(spark, d):
    _, _, k = consensus.fit(readings.with_pivot(t(spark, d, "transcriptions")).where("n >= 3 AND is_ref"))
    return k.select("annotator", "n_readings", "n_slots", F.round("accuracy", 6).alias("accuracy"), F.round("s", 6).alias("tilt"))


def p4_agreement(spark, d):
    a = consensus.agreement(readings.with_pivot(t(spark, d, "transcriptions")).where("n >= 3 AND is_ref"))
    return a.select("page_id", "n_readings", "n_slots", F.round("agreement", 6).alias("agreement"))


def p5_found(spark, d):
    return terms.found(t(spark, d, "entities"), t(spark, d, "ref_terms"))


def p5_misses(spark, d):
    f = terms.found(t(spark, d, "entities"), t(spark, d, "ref_terms")).where("term_id = -1")
    return f.groupBy("kind", "typed").agg(F.count_distinct("letter_id").alias("n_letters"))


def p6_found(spark, d):
    return truncation.found(t(spark, d, "transcriptions"), t(spark, d, "summaries"))


def p6_shares(spark, d):
    s = truncation.shares(t(spark, d, "transcriptions"), t(spark, d, "summaries"))
    return s.select("table_name", "source", "n_rows", "n_cut", F.round("share", 9).alias("share"))


def p7_found(spark, d):
    return forms.found(t(spark, d, "transcriptions"), t(spark, d, "gold"))


def p7_unified(spark, d):
    """Every row of both tables with its key and its text in the one form, of classes over both tables."""
    key = [*readings.KEYS, "line_no"]
    a = t(spark, d, "transcriptions").select(F.lit("transcriptions").alias("table_name"), *key, F.col("text").alias("stored"))
    b = t(spark, d, "gold").select(F.lit("gold").alias("table_name"), "page_id", F.col("gold_text").alias("stored"))
    return forms.unify(a.unionByName(b, allowMissingColumns=True), "stored", "text").select("table_name", *key, "text")


def p8_found(spark, d):
    return packing.found(t(spark, d, "documents"))


def p8_packed(spark, d):
    return packing.pack(packing.sizes(t(spark, d, "documents")))


def p8_fill(spark, d):
    """Per shard: windows, tokens and share of the room used, and the differences from the target proportions."""
    f = packing.fill(packing.pack(packing.sizes(t(spark, d, "documents"))))
    return f.select("shard", "windows", "n_tokens", *[F.round(c, 6).alias(c) for c in ("fill", "off_mean", "off_max", "off_shard")])


def p9_found(spark, d):
    return leaks.found(t(spark, d, "documents"), t(spark, d, "eval_items"))


def p9_items(spark, d):
    c = leaks.contaminated(t(spark, d, "documents"), t(spark, d, "eval_items"))
    return c.groupBy("item_id").agg(F.count("*").alias("n_documents"), F.max("n_words").alias("longest"))


def p10_found(spark, d):
    return levels.found(t(spark, d, "documents"), t(spark, d, "level_labels"))


def p10_profile(spark, d):
    return levels.levels(t(spark, d, "documents"), t(spark, d, "level_labels")).groupBy("band").agg(F.count("*").alias("n_documents"))


def queries():
    return {k: f for k, f in globals().items() if k.startswith("p") and k[1:2].isdigit()}


def _p7_sql() -> str:
    """The same rows by a plain rule: an odd character, a text that isn't composed, or a word with look-alike letters."""
    odd = "[" + forms.INVISIBLE + forms.SPACES + forms.HYPHENS + "".join(forms.LIGATURES) + "\uff01-\uff5e]"
    word = "\\p{L}+(?:[.''-]\\p{L}+)*"
    other = "regexp_replace(w, '[^" + forms.OTHER + "]', '', 'g')"
    alike = f"{other} <> '' and regexp_replace({other}, '[{forms.ALIKE_FROM}]', '', 'g') = '' and (length({other}) > 1 or length({other}) < length(regexp_replace(w, '[^\\p{{L}}]', '', 'g')))"
    rule = lambda c: f"(regexp_matches({c}, '{odd}') or nfc_normalize({c}) <> {c} or len(list_filter(regexp_extract_all({c}, '{word}'), lambda w: {alike})) > 0)"
    key = " || '|' || ".join(["page_id", "engine", "model", "prompt_version", "variant", "sample_no", "line_no"])
    return f"select distinct 'transcriptions' as table_name, {key} as record_id from transcriptions where text is not null and {key} is not null and {rule('text')} union all select distinct 'gold', page_id from gold where page_id is not null and gold_text is not null and {rule('gold_text')}"


def oracle_sql():
    return {"p7_found": _p7_sql()}
