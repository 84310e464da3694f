"""The queries of this subpackage and, where SQL can express them, the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ringside.llm.bpe import op9_bpe
from ringside.llm.chat import op2_chat, op2_sql
from ringside.llm.common import table
from ringside.llm.filter_audit import OP13_SQL, op13_filter_audit
from ringside.llm.jaccard import OP5_SQL, op5_jaccard
from ringside.llm.langid import op3_langid
from ringside.llm.manifest import OP11_SQL, op11_merkle
from ringside.llm.mixing import OP8_SQL, op8_mixing
from ringside.llm.pii import op6_pii
from ringside.llm.pq_dedup import OP1_SQL, op1_dedup
from ringside.llm.sharding import OP10_SQL, op10_sharding
from ringside.llm.spann import op7_ann
from ringside.llm.suffixes import OP12_SQL, op12_suffix_dedup
from ringside.llm.toxicity import op4_toxicity

Query = Callable[[SparkSession, str], DataFrame]


def _over(name: str, operator: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: operator(table(spark, sf_dir, name))


def queries() -> dict[str, Query]:
    return {
        "op1_dedup": _over("embeddings", op1_dedup),
        "op2_chat": _over("conversations", op2_chat),
        "op3_langid": _over("documents", op3_langid),
        "op4_toxicity": lambda spark, sf_dir: op4_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")),
        "op5_jaccard": _over("documents", op5_jaccard),
        "op6_pii": _over("documents", op6_pii),
        "op7_ann": _over("embeddings", op7_ann),
        "op8_mixing": _over("documents", op8_mixing),
        "op9_bpe": _over("documents", op9_bpe),
        "op10_sharding": _over("documents", op10_sharding),
        "op11_merkle": _over("documents", op11_merkle),
        "op12_suffix_dedup": _over("documents", op12_suffix_dedup),
        "op13_filter_audit": lambda spark, sf_dir: op13_filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")),
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_dedup": OP1_SQL, "op2_chat": op2_sql(), "op5_jaccard": OP5_SQL, "op8_mixing": OP8_SQL, "op10_sharding": OP10_SQL, "op11_merkle": OP11_SQL, "op12_suffix_dedup": OP12_SQL, "op13_filter_audit": OP13_SQL}
