"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from saltmarsh.llm.bpe import op8_bpe
from saltmarsh.llm.embeddings import OP3_SQL, op3_embeddings
from saltmarsh.llm.jpeg import op6_jpeg
from saltmarsh.llm.langid import op10_langid
from saltmarsh.llm.packing import op7_packing
from saltmarsh.llm.pii import op5_pii
from saltmarsh.llm.ppm import op9_ppm
from saltmarsh.llm.sharding import OP2_SQL, op2_sharding
from saltmarsh.llm.simhash import op1_simhash
from saltmarsh.llm.warc import OP4_SQL, op4_warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_simhash, op2_sharding, op3_embeddings, op4_warc, op5_pii, op6_jpeg, op7_packing, op8_bpe, op9_ppm, op10_langid)}


def oracle_sql() -> dict[str, str]:
    return {"op2_sharding": OP2_SQL, "op3_embeddings": OP3_SQL, "op4_warc": OP4_SQL}
