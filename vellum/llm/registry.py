"""Queries of the training-data operators and the SQL that checks them."""

from __future__ import annotations

from vellum.llm import clustering, decontaminate, exactdedup, jaccardjoin, langid, linededup, oracle, packing, pieces, quality, secrets, sharding, spelling, toxicity


def queries() -> dict:
    return {
        "op1_secret_scan": secrets.query,
        "op2_language_id": langid.query,
        "op3_decontamination": decontaminate.query,
        "op4_quality": quality.query,
        "op5_sharding": sharding.query,
        "op6_exact_dedup": exactdedup.query,
        "op7_sentencepiece": pieces.query,
        "op8_line_dedup": linededup.query,
        "op9_toxicity": toxicity.query,
        "op10_jaccard_join": jaccardjoin.query,
        "op11_packing": packing.query,
        "op12_spelling_variants": spelling.query,
        "op13_centroid_clustering": clustering.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_secret_scan": oracle.secret_scan(),
        "op3_decontamination": oracle.decontamination(),
        "op5_sharding": oracle.shards(),
        "op6_exact_dedup": exactdedup.SQL,
        "op10_jaccard_join": oracle.jaccard_join(),
        "op12_spelling_variants": spelling.sql(),
        "op13_centroid_clustering": clustering.sql(),
    }
