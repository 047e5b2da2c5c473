"""Schemas of the archive's frames."""

from __future__ import annotations

FRAMES = {
    "pages": "page_id string, source_path string, filename string, letter_id string, page_no int, captured_at timestamp_ntz, camera string, width int, height int, ingested_at timestamp_ntz",
    "transcriptions": "page_id string, engine string, model string, prompt_version string, variant string, sample_no int, line_no int, text string, confidence string, created_at timestamp_ntz",
    "letters": "page_id string, text_final string, text_source string, uncertain_spans array<struct<line_no:int,word:string,alternatives:array<string>>>, reviewed_by string, reviewed_at timestamp_ntz, updated_at timestamp_ntz",
    "letter_meta": "letter_id string, date date, place string, recipient string, title string, notes string",
    "entities": "letter_id string, kind string, name string, canonical string, detail string, context string",
    "events": "letter_id string, date date, date_text string, description string, category string, source string",
    "summaries": "letter_id string, summary_nl string, summary_en string, mood string, notable_quotes array<string>, model string, created_at timestamp_ntz",
}
#: Keys by which a frame is updated; entities and events are bags, replaced letter by letter.
KEYS = {"pages": ["page_id"], "transcriptions": ["page_id", "engine", "model", "prompt_version", "variant", "sample_no"], "letters": ["page_id"], "letter_meta": ["letter_id"], "summaries": ["letter_id"]}
