"""A corpus pipeline of five of the library's operators. Each stage reads what the one before it wrote.

1. toxicity: documents that the classifier chain holds toxic go.
2. lines: lines that repeat or nearly repeat an earlier one are removed from the texts.
3. near copies: of each group of near copies the document with the smallest doc_id stays. Near copies have a
   similarity of 0.8 or more; two at 0.8 share no band, and are missed, with a probability of
   (1 - 0.8**4)**20 = 2.7e-5.
4. decontamination: passages of the benchmark are cut out of the texts.
5. pieces: texts become ids; decoding them is checked to give the text again.

Each stage works on all rows of the one before it; all but the last return the columns of documents, whatever there are.
Cases: null and empty texts pass every stage (a document that a stage empties stays, with an empty text). Rows without a
doc_id stay. Rows that share one are told apart by their texts in stage 2, and are one document in stage 3. Repeated rows
are judged alike, and stay or go together. Very long texts are taken in blocks. Empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foliant.llm import decontaminate, line_dedup, near_dedup, pieces, toxicity
from foliant.llm.common import forget, in_few_files, saved, table


#: Similarity of near copies in percent. The query of op10 has its own, which its SQL shares.
NEAR_PERCENT = 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A null or empty text is scored like any other; without labels nothing goes."""
    return in_few_files(toxicity.accepted(docs, table(spark, sf_dir, "labels")), docs)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows stay; a null text stays null, one of which all lines go becomes empty."""
    return in_few_files(line_dedup.deduplicated(docs), docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without words, or without a doc_id, stay. Of equal doc_ids all rows stay or go."""
    return in_few_files(near_dedup.deduplicated(docs, NEAR_PERCENT), docs)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows stay; a null text stays null. An empty benchmark cuts nothing."""
    return in_few_files(decontaminate.clean(docs, table(spark, sf_dir, "benchmark")), docs)


def to_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null ids for a null text, none for an empty one."""
    return in_few_files(pieces.with_ids(docs), docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_copies),
    ("decontamination", cut_benchmark),
    ("sentencepiece", to_pieces),
]

#: A trained classifier and line similarity over whole tables are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each but the last is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = saved(docs, f"stage-{name}")
            forget(before)  # all that came of it is written
    return docs
