"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from corpusloom.llm import bpe, chat, decontaminate, filter_audit, hmm, langid, late_days, media, ngram_join, packed, quality, substring, urls

QUERIES = {
    "op1_packed_tokens": packed.query,
    "op2_url_filter": urls.query,
    "op3_ngram_join": ngram_join.query,
    "op4_decontamination": decontaminate.query,
    "op5_hmm_score": hmm.query,
    "op6_bpe_codec": bpe.query,
    "op7_media_columns": media.query,
    "op8_chat_format": chat.query,
    "op9_language_id": langid.query,
    "op10_quality": quality.query,
    "op11_substring_dedup": substring.query,
    "op12_late_days": late_days.query,
    "op13_filter_audit": filter_audit.query,
}

ORACLE_SQL: dict[str, str] = {"op11_substring_dedup": substring.SQL, "op13_filter_audit": filter_audit.SQL}
