"""The queries of this subpackage, for ``__spark_entry__.py``."""

from .decontamination import op9_decontamination
from .language_id import op5_language_id
from .packing import op1_packing
from .quality import op3_quality
from .simhash import op4_simhash
from .spotsigs import op10_spotsigs
from .suffix_dedup import op2_suffix_dedup
from .token_counts import op8_token_counts
from .token_store import op7_token_store
from .warc import op6_warc

QUERIES = {
    "op1_packing": op1_packing,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_quality": op3_quality,
    "op4_simhash": op4_simhash,
    "op5_language_id": op5_language_id,
    "op6_warc": op6_warc,
    "op7_token_store": op7_token_store,
    "op8_token_counts": op8_token_counts,
    "op9_decontamination": op9_decontamination,
    "op10_spotsigs": op10_spotsigs,
}
ORACLE_SQL: dict[str, str] = {}
