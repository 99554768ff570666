"""Queries of the operators and their DuckDB SQL, where SQL can express them."""

from __future__ import annotations

from . import decontamination, embeddings, lm, minhash, packing, secrets, sharding, token_counts, toxicity, warc


def queries() -> dict:
    return {
        "op1_minhash": minhash.op1_minhash,
        "op2_lm": lm.op2_lm,
        "op3_sharding": sharding.op3_sharding,
        "op4_secrets": secrets.op4_secrets,
        "op5_token_counts": token_counts.op5_token_counts,
        "op6_toxicity": toxicity.op6_toxicity,
        "op7_embeddings": embeddings.op7_embeddings,
        "op8_warc": warc.op8_warc,
        "op9_packing": packing.op9_packing,
        "op10_decontamination": decontamination.op10_decontamination,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_sharding": sharding.ORACLE,
        "op4_secrets": secrets.ORACLE,
        "op8_warc": warc.ORACLE,
        "op10_decontamination": decontamination.ORACLE,
    }
