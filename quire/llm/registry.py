"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from quire.llm import (conversation_repair, conversation_trie, embedding_dedup, exact_dedup, language_id, mixing, ngram_join, passage_dedup, quality,
                       secrets, sentencepiece_spans, token_counts, warc)

QUERIES = {
    "op1_token_counts": token_counts.op1_token_counts,
    "op2_ngram_jaccard_join": ngram_join.op2_ngram_jaccard_join,
    "op3_exact_dedup": exact_dedup.op3_exact_dedup,
    "op4_mix_sources": mixing.op4_mix_sources,
    "op5_sentencepiece": sentencepiece_spans.op5_sentencepiece,
    "op6_embedding_dedup": embedding_dedup.op6_embedding_dedup,
    "op7_quality_classifier": quality.op7_quality_classifier,
    "op8_secret_scan": secrets.op8_secret_scan,
    "op9_passage_dedup": passage_dedup.op9_passage_dedup,
    "op10_warc": warc.op10_warc,
    "op11_conversation_repair": conversation_repair.op11_conversation_repair,
    "op12_conversation_trie": conversation_trie.op12_conversation_trie,
    "op13_language_id": language_id.op13_language_id,
}
SQL = {**exact_dedup.SQL, **warc.SQL, **conversation_repair.SQL,
       **conversation_trie.SQL}
