"""The queries of this subpackage, and the SQL for those that SQL can express.

``license_base``, ``media_payload`` and ``token_sections`` are the columns of op1, op3 and op6 that SQL can express.
"""

from blockwright.llm import chat, decontaminate, near_dup
from blockwright.llm.chat import op9_preference_chat
from blockwright.llm.decontaminate import op7_decontamination
from blockwright.llm.language import op8_language_id
from blockwright.llm.licenses import BASE_ORACLE, license_base, op1_license_scan
from blockwright.llm.lm_score import op5_lm_score
from blockwright.llm.near_dup import op2_near_dup
from blockwright.llm.packing import op4_packing
from blockwright.llm.quality import op10_quality
from blockwright.llm.tiff import PAYLOAD_ORACLE, media_payload, op3_tiff_media
from blockwright.llm.token_counts import SECTIONS_ORACLE, op6_token_counts, token_sections

OPERATORS = {f.__name__: f for f in (op1_license_scan, op2_near_dup, op3_tiff_media, op4_packing, op5_lm_score, op6_token_counts, op7_decontamination, op8_language_id, op9_preference_chat, op10_quality)}
QUERIES = OPERATORS | {f.__name__: f for f in (license_base, media_payload, token_sections)}
ORACLES = {
    "license_base": BASE_ORACLE,
    "media_payload": PAYLOAD_ORACLE,
    "op2_near_dup": near_dup.ORACLE,
    "op7_decontamination": decontaminate.ORACLE,
    "op9_preference_chat": chat.ORACLE,
    "token_sections": SECTIONS_ORACLE,
}
