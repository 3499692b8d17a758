"""Explicit schemas; nothing is inferred from data."""

from __future__ import annotations

ARTICLE = "struct<no:string,num:int,sub:int,container:string,text:string,chunking:string>"
STATUTE = (
    "bbbs string, title string, category string, subcategory string, issuing_body string, gbrq string, sxrq string, "
    f"sxx int, status string, source_url string, parse_warning string, articles array<{ARTICLE}>"
)
CHUNK = (
    "id string, text string, law_title string, bbbs string, article_no string, article_num int, article_sub int, category string, "
    "subcategory string, container string, effective_date string, status int, status_label string, chunking string, source string"
)
EVAL_ITEM = (
    "id string, question string, category string, type string, question_type string, source string, "
    "expect_refusal boolean, relevant array<struct<law:string,article:string>>"
)
QA_SET = "data array<struct<id:string,question:array<string>,law_type:string,law_text_num:string,question_type:string>>"
AGENT_SCENARIO = (
    "id string, scenario string, question string, expected_tools array<string>, expected_keywords array<string>, "
    "category string, difficulty string"
)
FEEDBACK = "ts string, rating string, mode string, question string, answer string, sources array<string>"
LLM_CALL = (
    "ts string, source string, model string, prompt_tokens long, completion_tokens long, latency_ms double, "
    "cost_cny double, success boolean, error string"
)
HEARTBEAT = "state string, updated_at double, elapsed_sec double, collected long, skipped long, failed long, articles long"
REWRITES = "question string, passage string"
