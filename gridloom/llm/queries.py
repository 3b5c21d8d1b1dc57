"""Registered queries of the subpackage and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gridloom.llm.bpe import op10_bpe
from gridloom.llm.chat import OP12_SQL, op12_chat
from gridloom.llm.codes import OP13_SQL, op13_codes
from gridloom.llm.decontaminate import op3_decontaminate
from gridloom.llm.html import op4_html
from gridloom.llm.langid import op8_langid
from gridloom.llm.licenses import op7_licenses
from gridloom.llm.minhash import OP2_SQL, op2_minhash
from gridloom.llm.periodic import OP11_SQL, op11_runs
from gridloom.llm.pii import op6_pii
from gridloom.llm.quality import op9_quality
from gridloom.llm.repeats import OP1_SQL, op1_repeats
from gridloom.llm.topk import OP5_SQL, op5_maxscore

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_repeats": op1_repeats,
    "op2_minhash": op2_minhash,
    "op3_decontaminate": op3_decontaminate,
    "op4_html": op4_html,
    "op5_maxscore": op5_maxscore,
    "op6_pii": op6_pii,
    "op7_licenses": op7_licenses,
    "op8_langid": op8_langid,
    "op9_quality": op9_quality,
    "op10_bpe": op10_bpe,
    "op11_runs": op11_runs,
    "op12_chat": op12_chat,
    "op13_codes": op13_codes,
}
ORACLES: dict[str, str] = {"op1_repeats": OP1_SQL, "op2_minhash": OP2_SQL, "op5_maxscore": OP5_SQL, "op11_runs": OP11_SQL, "op12_chat": OP12_SQL, "op13_codes": OP13_SQL}
