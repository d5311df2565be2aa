"""The corpus pipeline: toxicity, line dedup, near-duplicate dedup and packing, each on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sectionlake.llm import line_templates, near_duplicates, packing, toxicity
from sectionlake.llm.common import settled


def reject_toxic(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the string-kernel machine, fitted on labels of documents.parquet, doesn't reject.

    Null and empty texts score as a text without words, which stays; texts of any length are scored
    whole; rows that repeat a key or a text are decided each by its own text. Null keys, and labels
    that are null or missing, change nothing for a row. Without labels of both kinds every text gets
    the share of toxic labels as its score. An empty table gives no rows. Columns come back as they
    were, whatever their names.
    """
    model = toxicity.train(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.drop_toxic(docs, model)


def drop_lines(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines whose template recurs across them, near copies counted once; n_chars follows the text.

    No row goes. Null texts stay null, null keys lose no lines, each of the rows that repeat a key
    loses its own text's lines; texts of any length are parsed whole. An empty table gives no rows.
    Other columns come back as they were, whatever their names (see line_templates).
    """
    out = line_templates.drop_recurring_lines(docs)
    n_chars = F.when(F.col("changed"), F.length("text").cast("long")).otherwise(F.col("n_chars")) if "n_chars" in docs.columns else None
    return out.select(*[n_chars.alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def keep_one_of_each_group(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document with the smallest doc_id.

    Rows with a null key and texts that are null, empty or without words stay. Of rows that are equal
    in doc_id and text one stays; unlike texts of one doc_id are documents of their own. Texts of any
    length count whole. An empty table gives no rows. Columns come back as they were.
    """
    return near_duplicates.drop_near_duplicates(docs)


def pack(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of the documents' token ids, with its place in a packed sequence.

    Null and empty texts are an end id alone; longer texts than a sequence are cut into pieces; rows
    that repeat a key are documents of their own, and null keys stay null. An empty table gives no
    rows. Only doc_id and text are read, so other columns can't clash.
    """
    import public_tokenizers

    packed = packing.pack_documents(docs, public_tokenizers.path(packing.VOCABULARY), ids=False)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [("toxicity", reject_toxic), ("line_dedup", drop_lines), ("near_dedup", keep_one_of_each_group), ("packing", pack)]
#: The toxicity machine, the signatures and the tokenizer have no form in SQL; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    """The stages over documents.parquet, each one's result written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = settled(spark, lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
