"""All queries of the subpackage."""

from earshot.llm import (  # noqa: F401
    q_anchors, q_bpe, q_chat, q_filter_audit, q_itq, q_langid, q_mixing, q_packing, q_pii, q_quality, q_simhash, q_substrings,
    q_vector_codes,
)
from earshot.llm.registry import QUERIES, SQL  # noqa: F401
