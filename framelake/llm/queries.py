"""Registered queries of the training-data operators, one for each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from framelake.llm.decontaminate import op9_decontaminate
from framelake.llm.language import op3_language
from framelake.llm.line_dedup import OP7_SQL, op7_line_dedup
from framelake.llm.packing import op5_packing, pack_conversations
from framelake.llm.quality_model import op8_quality_model
from framelake.llm.quality_rules import op4_quality_rules
from framelake.llm.sharding import OP10_SQL, op10_interleave
from framelake.llm.simhash import op6_simhash
from framelake.llm.token_store import op1_token_store
from framelake.llm.toxicity import op2_toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_token_store, op2_toxicity, op3_language, op4_quality_rules, op5_packing, op6_simhash, op7_line_dedup, op8_quality_model, op9_decontaminate, op10_interleave, pack_conversations)}


def oracle_sql() -> dict[str, str]:
    return {"op7_line_dedup": OP7_SQL, "op10_interleave": OP10_SQL}
