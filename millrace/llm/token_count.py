"""Token counts by the whole-token shortcut.

Offline, on the driver, every vocabulary string is tried: those that are one
pre-token and encode alone as one token are proven.  Workers cut texts into
pre-tokens, count 1 for each proven one and merge only the rest.  A
sentence-piece model is cut before spaces if its vocabulary shows that no merge
reaches over them.

Defined cases: null text is empty and has 0 bytes and 0 tokens; null or repeated
ids stay as they are, one row each; a text of any length is counted whole; an empty
table gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.tokens import PieceCounter, proven_whole
from millrace.plans.scratch import bounded_arrow_batches

_counters: dict[str, PieceCounter] = {}


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row."""
    spark = docs.sparkSession
    bounded_arrow_batches(spark)
    proven = spark.sparkContext.broadcast(proven_whole(tokenizer))  # at most the vocabulary

    def count(texts: pd.Series) -> pd.Series:
        if tokenizer not in _counters:
            _counters[tokenizer] = PieceCounter(tokenizer, proven.value)
        return pd.Series(_counters[tokenizer].count(texts.tolist()), dtype="int64")

    counted = F.pandas_udf(count, "long")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), counted(text).alias("n_tokens"))
    return rows.withColumn("over_limit", F.col("n_tokens") > limit)
