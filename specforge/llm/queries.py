"""The queries of the training-data operators and their oracles (the pipeline is registered beside them)."""

from __future__ import annotations

from specforge.llm import oracles
from specforge.llm.digests import op4_digests
from specforge.llm.language import op6_language
from specforge.llm.mixing import op9_mixing
from specforge.llm.packing import op5_packing
from specforge.llm.quality import op2_quality
from specforge.llm.secrets import op10_secrets
from specforge.llm.sharding import op7_kd_sharding
from specforge.llm.simhash import op8_simhash
from specforge.llm.substrings import op1_suffix_dedup
from specforge.llm.warc import op3_warc

QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_quality": op2_quality,
    "op3_warc": op3_warc,
    "op4_digests": op4_digests,
    "op5_packing": op5_packing,
    "op6_language": op6_language,
    "op7_kd_sharding": op7_kd_sharding,
    "op8_simhash": op8_simhash,
    "op9_mixing": op9_mixing,
    "op10_secrets": op10_secrets,
}
ORACLES: dict[str, str] = {"op3_warc": oracles.WARC, "op10_secrets": oracles.SECRETS}
