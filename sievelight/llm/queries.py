"""The operators' queries and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import chat, codes, extraction, mixing, neighbours, packing, phrases, pieces, quality, sharding, simhash, toxicity, warc

QUERIES = {
    "op1_simhash": simhash.op1_simhash,
    "op2_quality": quality.op2_quality,
    "op3_mixing": mixing.op3_mixing,
    "op4_packing": packing.op4_packing,
    "op5_neighbours": neighbours.op5_neighbours,
    "op6_sharding": sharding.op6_sharding,
    "op7_warc": warc.op7_warc,
    "op8_chat": chat.op8_chat,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_extraction": extraction.op10_extraction,
    "op11_pieces": pieces.op11_pieces,
    "op12_codes": codes.op12_codes,
    "op13_phrases": phrases.op13_phrases,
}

ORACLE_SQL = {"op3_mixing": mixing.OP3_SQL, "op7_warc": warc.OP7_SQL, "op8_chat": chat.OP8_SQL, "op12_codes": codes.OP12_SQL,
              "op13_phrases": phrases.OP13_SQL}
