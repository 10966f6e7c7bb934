"""The queries of this subpackage and their SQL, by the names under which __spark_entry__ registers them."""

from __future__ import annotations

from . import best_fit, conversations, edit_embedding, fill_middle, mixing, neighbours, packing, quality_rules, simhash, surrogates, token_files, toxicity, url_filter

QUERIES = {"op1_source_mix": mixing.query, "op2_token_files": token_files.query, "op3_surrogates": surrogates.query, "op4_simhash": simhash.query, "op5_packing": packing.query, "op6_quality_rules": quality_rules.query, "op8_url_filter": url_filter.query, "op7_block_neighbours": neighbours.query, "op9_toxic_neighbours": toxicity.query, "op10_edit_embedding": edit_embedding.query, "op11_best_fit": best_fit.query, "op12_conversation_repair": conversations.query, "op13_fill_middle": fill_middle.query}
SQL = {"op1_source_mix": mixing.SQL, "op7_block_neighbours": neighbours.SQL, "op13_fill_middle": fill_middle.SQL}
