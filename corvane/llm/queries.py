"""Registered queries over the given tables for the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import credentials, documented, encoding_repair, handwritten, leakage, pair_defects, splitting, syntax, tokenize


def p2_pieces(spark: SparkSession, sf: str) -> DataFrame:
    """Every piece of every oversized chunk."""
    return splitting.oversized_pieces(table(spark, sf, "code_chunks"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return splitting.oversized_pieces(table(spark, sf, "code_chunks"), texts=False).where("piece = 0").select("chunk_id")


def p3_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Code and description of every documented function."""
    return documented.documented_functions(table(spark, sf, "code_chunks"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return documented.documented_functions(table(spark, sf, "code_chunks"), texts=False)


def p3_files(spark: SparkSession, sf: str) -> DataFrame:
    """Every documented function of the whole source files, with its lines."""
    found = documented.file_functions(table(spark, sf, "scanned_files"))
    return found.select("file_id", "n", "name", "start_line", "end_line", "whole", F.md5("code").alias("code"), F.length("description").alias("n_chars"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return credentials.credential_lines(table(spark, sf, "code_chunks")).select("chunk_id", "line_no")


def p4_redacted(spark: SparkSession, sf: str) -> DataFrame:
    """The chunks that hold credentials, redacted."""
    return credentials.redacted(table(spark, sf, "code_chunks"), found_only=True)


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return pair_defects.defective_pairs(table(spark, sf, "ask_pairs"))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return handwritten.not_handwritten(table(spark, sf, "scanned_files")).select("file_id")


def p6_reasons(spark: SparkSession, sf: str) -> DataFrame:
    """Why each file counts as not written by hand."""
    found = handwritten.not_handwritten(table(spark, sf, "scanned_files"))
    return found.select("file_id", F.array_sort("reasons").alias("reasons"), F.round("p", 6).alias("probability"))


def p6_forest(spark: SparkSession, sf: str) -> DataFrame:
    """What the forest finds by itself, whatever a file says of itself."""
    found = handwritten.not_handwritten(table(spark, sf, "scanned_files"), alone=True)
    return found.select("file_id", F.col("reasons")[0].alias("reason"), F.round("p", 6).alias("probability"))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return syntax.invalid_files(table(spark, sf, "scanned_files")).select("file_id")


def p7_rates(spark: SparkSession, sf: str) -> DataFrame:
    """Share of invalid files for each repository and language."""
    return syntax.invalid_rates(table(spark, sf, "scanned_files"))


def p8_ids(spark: SparkSession, sf: str) -> DataFrame:
    return tokenize.encode_texts(table(spark, sf, "documents"))


def p8_decoded(spark: SparkSession, sf: str) -> DataFrame:
    """Digest and length of each document's text, decoded from its token ids."""
    text = tokenize.decode_ids(p8_ids(spark, sf))
    return text.select("doc_id", F.md5("text").alias("digest"), F.length("text").alias("n_chars"))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return p9_passages(spark, sf).select("doc_id", "item_id")


def p9_passages(spark: SparkSession, sf: str) -> DataFrame:
    """Each leaked passage with its place and edits."""
    return leakage.leaked_items(table(spark, sf, "documents"), table(spark, sf, "eval_items"))


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return encoding_repair.garbled_texts(table(spark, sf, "documents")).select("doc_id")


def p10_restored(spark: SparkSession, sf: str) -> DataFrame:
    """The restored text of each document with a wrongly decoded passage."""
    return encoding_repair.garbled_texts(table(spark, sf, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (p2_found, p2_pieces, p3_found, p3_pairs, p3_files, p4_found, p4_redacted, p5_found, p6_found, p6_reasons, p6_forest, p7_found, p7_rates, p8_ids, p8_decoded, p9_found, p9_passages, p10_found, p10_restored)
}

#: Only what SQL can say over whole tables.
ORACLES = {
    "p2_found": "SELECT DISTINCT chunk_id FROM code_chunks WHERE length(content) > 2000",
    "p8_decoded": "SELECT DISTINCT doc_id, md5(coalesce(text, '')) AS digest, length(coalesce(text, ''))::INT AS n_chars FROM documents",
}
