"""The registered queries of this package, and their SQL where there is any."""

from __future__ import annotations

from tiermark.llm.alignment import op11
from tiermark.llm.bpe import op1
from tiermark.llm.conversation_repair import OP13_SQL, op13
from tiermark.llm.decontamination import OP12_SQL, op12
from tiermark.llm.embedding_dedup import op2
from tiermark.llm.html_template import op4
from tiermark.llm.licenses import op6
from tiermark.llm.mixing import op10
from tiermark.llm.quality import op3
from tiermark.llm.secrets import op5
from tiermark.llm.sharding import op9
from tiermark.llm.simhash import op8
from tiermark.llm.token_files import op7

QUERIES = {
    "op1_byte_bpe": op1,
    "op2_embedding_dedup": op2,
    "op3_quality_rules": op3,
    "op4_html_template": op4,
    "op5_secret_scan": op5,
    "op6_license_scan": op6,
    "op7_token_files": op7,
    "op8_simhash": op8,
    "op9_sharding": op9,
    "op10_mixing": op10,
    "op11_alignment": op11,
    "op12_decontamination": op12,
    "op13_conversation_repair": op13,
}

#: The others have no equal in SQL; tests hold each against brute force.
ORACLE_SQL: dict[str, str] = {"op12_decontamination": OP12_SQL, "op13_conversation_repair": OP13_SQL}
