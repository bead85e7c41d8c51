"""A training corpus from documents, stage by stage.

Language ID, line dedup, near-duplicate documents, mixing to target weights and
tokens. Each stage gets all that the one before kept, as a table written and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from solstice.llm import jaccard_join, language_id, line_dedup, mixing, sentencepiece_codec
from solstice.llm.shared import Storage, materialize

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
ROW = "row_number_"


def numbered(docs: DataFrame, name: str) -> DataFrame:
    """docs with a number for each row (`row_number_`), written, so that it stays the same: ids may be null or repeat."""
    return materialize(docs.select(*COLUMNS).withColumn(ROW, F.monotonically_increasing_id()), name)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter, null texts among them, whatever the other documents are.

    The languages are learned from the documents that are not held out; if none of those has one, letters alone decide.
    """
    held = F.coalesce(language_id.held_out(F.col("doc_id")), F.lit(False))
    prototypes = language_id.learn(docs.where(~held))
    if not prototypes:
        return docs.where(F.col("text").rlike(r"\p{L}")).select(*COLUMNS)
    told = language_id.identify(docs, prototypes, keep=[x for x in COLUMNS if x != "doc_id"])  # whatever the score: that of a short text is low in its own language
    return told.where(F.col("lang_pred") != "und").select(*COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines that many documents share from all but one; documents left without text go."""
    out = line_dedup.dedup_lines(docs, keep=["lang", "source"])
    # The row number keeps Spark from moving the filter below the lines' expressions, where it would work them out again for each line.
    out = out.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.monotonically_increasing_id().alias("_row"))
    out = out.where((F.col("_row") >= 0) & (F.length(F.btrim("text", F.lit(line_dedup.WHITE))) > 0))
    return out.select("doc_id", "text", "lang", "source", F.char_length("text").cast("long").alias("n_chars"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near-duplicate rows, that of the smallest id.

    Rows are told apart by number, so of repeated rows, and of rows without an id, one stays as well; a row with an id goes before one without.
    """
    rows = numbered(docs, "near-rows")
    with Storage(spark) as own:
        groups = jaccard_join.jaccard_components(rows, id_col=ROW)
        groups = materialize(groups.where("n > 0").select(F.col("id").alias("member"), "component"), "near-groups")
        own.release(but=1)  # what the join needed on the way
        several = groups.groupBy("component").count().where("count > 1").select("component")
        members = materialize(groups.join(several, "component"), "near-members", narrow=True)
        named = members.join(rows.select(F.col(ROW).alias("member"), "doc_id"), "member")
        first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "member"))
        stays = named.groupBy("component").agg(first.alias("first")).select("component", F.col("first.member").alias("stays"))
        goes = materialize(members.join(stays, "component").where("member <> stays").select(F.col("member").alias("gone")), "near-duplicates", narrow=True)
        own.release(but=1)
    return rows.join(goes, rows[ROW] == goes.gone, "left_anti").select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each row as often as the target mix says; some not at all. Repeated rows count, and are taken, each for itself.

    Texts go through the mix with their rows: only those of the buckets in which budgets end are shuffled.
    """
    named = docs.select(*COLUMNS, F.col("lang").alias("lang_"), F.col("source").alias("source_"))
    mix = mixing.mix(named.withColumn("domain", mixing.source_domain(F.col("source"))), keep=["text", "n_chars", "lang_", "source_"])
    out = mix.where("copies > 0").withColumn("epoch", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return out.select("doc_id", "text", F.col("lang_").alias("lang"), F.col("source_").alias("source"), "n_chars")


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The tokens of each document, and whether they give its text again."""
    return sentencepiece_codec.encode(docs.select("doc_id", "text", "lang", "source")).select("doc_id", "lang", "source", "n_tokens", "ids", "round_trip", "parity")


STAGES = [
    ("language_id", language_stage),
    ("line_dedup", line_stage),
    ("jaccard_join", near_duplicate_stage),
    ("mixing", mixing_stage),
    ("sentencepiece", token_stage),
]

#: SQL can't express the language stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each keeps is written to the shared folder and read again, and what it needed on the way is deleted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with Storage(spark) as own:
        for name, stage in STAGES[:-1]:
            docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
            own.release(but=1)
        return STAGES[-1][1](spark, docs, sf_dir)
