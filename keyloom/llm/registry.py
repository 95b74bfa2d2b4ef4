"""The registered training-data queries and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import exact_dedup, html_extract, jaccard_join, license_scan, media, packing, quality, secret_scan, sentencepiece_fst, toxicity


def queries() -> dict:
    return {
        "op1_quality": quality.op1_quality,
        "op2_sentencepiece": sentencepiece_fst.op2_sentencepiece,
        "op3_html_extract": html_extract.op3_html_extract,
        "op4_toxicity": toxicity.op4_toxicity,
        "op5_jaccard_join": jaccard_join.op5_jaccard_join,
        "op6_license_scan": license_scan.op6_license_scan,
        "op7_secret_scan": secret_scan.op7_secret_scan,
        "op8_media": media.op8_media,
        "op9_packing": packing.op9_packing,
        "op10_exact_dedup": exact_dedup.op10_exact_dedup,
    }


def oracle_sql() -> dict:
    return {"op6_license_scan": license_scan.SQL, "op7_secret_scan": secret_scan.SQL, "op10_exact_dedup": exact_dedup.SQL}
