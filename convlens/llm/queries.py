"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from convlens.llm.bpe_cuts import op12_bpe
from convlens.llm.chat import op3_chat
from convlens.llm.decontam import op1_decontamination
from convlens.llm.fingerprints import op7_fingerprints
from convlens.llm.lexical import OP13_SQL, op13_lexical
from convlens.llm.near_dedup import op2_near_dedup
from convlens.llm.piece_scan import op6_sentencepiece
from convlens.llm.repeats import op8_repeats
from convlens.llm.resample import OP11_SQL, op11_resample
from convlens.llm.token_shards import op5_token_shards
from convlens.llm.toxicity import op4_toxicity
from convlens.llm.url_rules import OP10_SQL, op10_url_verdicts
from convlens.llm.warc import op9_warc

QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_near_dedup": op2_near_dedup,
    "op3_chat": op3_chat,
    "op4_toxicity": op4_toxicity,
    "op5_token_shards": op5_token_shards,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_fingerprints": op7_fingerprints,
    "op8_repeats": op8_repeats,
    "op9_warc": op9_warc,
    "op10_url_verdicts": op10_url_verdicts,
    "op11_resample": op11_resample,
    "op12_bpe": op12_bpe,
    "op13_lexical": op13_lexical,
}

ORACLE: dict[str, str] = {"op10_url_verdicts": OP10_SQL, "op11_resample": OP11_SQL, "op13_lexical": OP13_SQL}
