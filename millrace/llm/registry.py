"""The queries of this package and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import embeddings, jaccard, language_id, language_model, licenses, media, mixing, packing, secrets, suffixes

QUERIES = {
    "op1_license_scan": licenses.op1_license_scan,
    "op2_secret_scan": secrets.op2_secret_scan,
    "op3_transport_stream": media.op3_transport_stream,
    "op4_suffix_dedup": suffixes.op4_suffix_dedup,
    "op5_embedding_dedup": embeddings.op5_embedding_dedup,
    "op6_language_id": language_id.op6_language_id,
    "op7_mixing": mixing.op7_mixing,
    "op8_best_fit_packing": packing.op8_best_fit_packing,
    "op9_ngram_jaccard": jaccard.op9_ngram_jaccard,
    "op10_language_model": language_model.op10_language_model,
}
SQL: dict[str, str] = {
    "op1_license_scan": licenses.OP1_SQL,
    "op2_secret_scan": secrets.OP2_SQL,
    "op6_language_id": language_id.OP6_SQL,
    "op7_mixing": mixing.OP7_SQL,
    "op9_ngram_jaccard": jaccard.OP9_SQL,
}
