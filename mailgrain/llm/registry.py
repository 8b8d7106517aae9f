"""Queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from .exact_dedup import OP3_SQL, op3_exact_dedup
from .lm_scoring import op10_lm_scoring
from .media import op5_media
from .merkle import OP12_SQL, op12_merkle
from .ngram_join import OP9_SQL, op9_ngram_join
from .packing import op6_packing
from .phrases import OP13_SQL, op13_phrases
from .pieces import op7_pieces
from .pii import op2_pii
from .secret_scan import op8_secret_scan
from .token_store import op1_token_store
from .toxicity import op4_toxicity
from .warc import OP11_SQL, op11_warc

QUERIES = {
    "op1_token_store": op1_token_store,
    "op2_pii": op2_pii,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_toxicity": op4_toxicity,
    "op5_media": op5_media,
    "op6_packing": op6_packing,
    "op7_pieces": op7_pieces,
    "op8_secret_scan": op8_secret_scan,
    "op9_ngram_join": op9_ngram_join,
    "op10_lm_scoring": op10_lm_scoring,
    "op11_warc": op11_warc,
    "op12_merkle": op12_merkle,
    "op13_phrases": op13_phrases,
}
SQL: dict[str, str] = {"op9_ngram_join": OP9_SQL, "op3_exact_dedup": OP3_SQL, "op11_warc": OP11_SQL, "op12_merkle": OP12_SQL, "op13_phrases": OP13_SQL}
