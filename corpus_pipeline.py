"""Corpus pipeline: stages over ``documents``, each written as Parquet and read again as the next one's input.

1. toxicity: documents at or over their language's threshold go;
2. MinHash near-dedup: one document of each group of near-duplicates stays, the smallest id;
3. substring dedup: passages of 50 words go from all but the first document that holds them;
4. benchmark decontamination: documents that hold a benchmark item within its edit budget go;
5. byte-level BPE: the kept documents with token count, ids, and digests of the ids and the decoded text.

Rows with a null id are kept by the deduplicating stages; null texts have no tokens. The stages' defined
results for nulls, ties and repeated rows are those of their operators. Every write goes to the shared
checkpoint folder, so a lost executor costs no more than the stage at work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vigia.llm.bpe import stage_encode
from vigia.llm.common import stage
from vigia.llm.decontamination import stage_decontamination
from vigia.llm.near_dedup import stage_near_dedup
from vigia.llm.substring_dedup import stage_substring_dedup
from vigia.llm.toxicity import stage_toxicity

STAGES = [
    ("toxicity", stage_toxicity),
    ("near-dedup", stage_near_dedup),
    ("substring-dedup", stage_substring_dedup),
    ("decontamination", stage_decontamination),
    ("byte-level-bpe", stage_encode),
]

#: The toxicity model is fitted, which SQL can't express; tests/llm holds brute-force versions of the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
