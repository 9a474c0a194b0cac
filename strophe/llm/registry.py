"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from strophe.llm import bpe, embedding_dedup, fingerprints, minhash_dedup, mixing, quality, secrets, sharding, token_counts, url_filter


def queries() -> dict:
    return {
        "op1_fingerprints": fingerprints.op1_fingerprints,
        "op2_bpe": bpe.op2_bpe,
        "op3_quality": quality.op3_quality,
        "op4_token_counts": token_counts.op4_token_counts,
        "op5_embeddings": embedding_dedup.op5_embeddings,
        "op6_urls": url_filter.op6_urls,
        "op7_near_duplicates": minhash_dedup.op7_near_duplicates,
        "op8_mixing": mixing.op8_mixing,
        "op9_sharding": sharding.op9_sharding,
        "op10_secrets": secrets.op10_secrets,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_embeddings": embedding_dedup.OP5_SQL, "op6_urls": url_filter.OP6_SQL, "op8_mixing": mixing.OP8_SQL}
