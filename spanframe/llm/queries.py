"""The queries of this package and the SQL of those that SQL can express."""

from __future__ import annotations

from spanframe.llm.decontam import OP13_SQL, op13_decontam
from spanframe.llm.language import op2_language
from spanframe.llm.line_dedup import op4_line_dedup
from spanframe.llm.media import op5_media, page_sequences
from spanframe.llm.mixing import OP10_SQL, op10_mixing
from spanframe.llm.pii import op3_pii
from spanframe.llm.quality import op7_quality
from spanframe.llm.ranking import OP12_SQL, op12_search
from spanframe.llm.secrets import OP9_SQL, op9_secrets
from spanframe.llm.segments import op6_segments
from spanframe.llm.sharding import op1_sharding
from spanframe.llm.simhash import op8_simhash
from spanframe.llm.turns import OP11_SQL, op11_turns

QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_language": op2_language,
    "op3_pii": op3_pii,
    "op4_line_dedup": op4_line_dedup,
    "op5_media": op5_media,
    "op6_segments": op6_segments,
    "op7_quality": op7_quality,
    "op8_simhash": op8_simhash,
    "op9_secrets": op9_secrets,
    "op10_mixing": op10_mixing,
    "op11_turns": op11_turns,
    "op12_search": op12_search,
    "op13_decontam": op13_decontam,
    "page_sequences": page_sequences,
}
SQL = {"op9_secrets": OP9_SQL, "op10_mixing": OP10_SQL, "op11_turns": OP11_SQL, "op12_search": OP12_SQL, "op13_decontam": OP13_SQL}
