"""The registered queries of the llm operators, and their SQL."""

from twinlake.llm.chunk_bpe import op9_bpe_chunk_reuse
from twinlake.llm.conversation_repair import op12_conversation_repair
from twinlake.llm.cotraining import op10_cotraining
from twinlake.llm.host_quality import OP6_SQL, op6_host_quality
from twinlake.llm.html_extract import op11_html_extract
from twinlake.llm.minhash_dedup import op8_prob_minhash
from twinlake.llm.source_mix import OP5_SQL, op5_source_mix
from twinlake.llm.suffix_dedup import op1_suffix_array_dedup
from twinlake.llm.token_files import op7_token_files
from twinlake.llm.token_prefixes import op2_token_counts
from twinlake.llm.vector_dedup import OP3_SQL, op3_vector_dedup
from twinlake.llm.warc import OP4_SQL, op4_warc
from twinlake.llm.whitening import op13_whitening

QUERIES = {
    "op1_suffix_array_dedup": op1_suffix_array_dedup,
    "op2_token_counts": op2_token_counts,
    "op3_vector_dedup": op3_vector_dedup,
    "op4_warc": op4_warc,
    "op5_source_mix": op5_source_mix,
    "op6_host_quality": op6_host_quality,
    "op7_token_files": op7_token_files,
    "op8_prob_minhash": op8_prob_minhash,
    "op9_bpe_chunk_reuse": op9_bpe_chunk_reuse,
    "op10_cotraining": op10_cotraining,
    "op11_html_extract": op11_html_extract,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_whitening": op13_whitening,
}
ORACLES: dict[str, str] = {"op3_vector_dedup": OP3_SQL, "op4_warc": OP4_SQL, "op5_source_mix": OP5_SQL, "op6_host_quality": OP6_SQL}
