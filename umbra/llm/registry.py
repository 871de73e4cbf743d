"""The queries of this package and their SQL."""

from __future__ import annotations

from umbra.llm import ann, decontaminate, html_text, line_dedup, mixing, ngram_join, pii, quality, toxicity, url_filter


def queries() -> dict:
    return {
        "op1_pii": pii.query,
        "op2_line_dedup": line_dedup.query,
        "op3_ngram_join": ngram_join.query,
        "op4_toxicity": toxicity.query,
        "op5_quality": quality.query,
        "op6_url_filter": url_filter.query,
        "op7_mixing": mixing.query,
        "op8_ann": ann.query,
        "op9_html_text": html_text.query,
        "op10_decontaminate": decontaminate.query,
    }


def oracle_sql() -> dict:
    return {"op2_line_dedup": line_dedup.ORACLE, "op3_ngram_join": ngram_join.ORACLE, "op6_url_filter": url_filter.ORACLE}
