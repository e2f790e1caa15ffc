"""The registered queries of this subpackage and, where SQL can express one, its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, table
from .exact import exact_dedup
from .html import extract
from .licenses import scan
from .lines import line_dedup
from .mixing import mix
from .neardup import near_dedup
from .pii import pseudonymise
from .quality import fit_quality, quality_scores
from .spm import encode_documents
from .vectors import vector_dedup


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents; learnt from labels outside the held-out fifth."""
    docs = table(spark, sf_dir, "documents")
    forest = fit_quality(docs, table(spark, sf_dir, "labels"))
    scored = quality_scores(docs.select("doc_id", "text"), forest)
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece ids of all documents, and whether decoding gives the text again."""
    return encode_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"), width=4)


def op4_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "rate", "copies")


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def op7_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup(table(spark, sf_dir, "embeddings"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A real key comes from a secret store; this one makes results repeatable."""
    return pseudonymise(table(spark, sf_dir, "documents"), key="example-key")


def op9_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_quality": op1_quality,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_minhash": op3_minhash,
    "op4_exact": op4_exact,
    "op5_mixing": op5_mixing,
    "op6_html": op6_html,
    "op7_embeddings": op7_embeddings,
    "op8_pii": op8_pii,
    "op9_lines": op9_lines,
    "op10_licenses": op10_licenses,
}

ORACLE_SQL = {
    "op4_exact": r"""
        WITH t AS (SELECT doc_id, coalesce(text, '') AS raw, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body FROM documents)
        SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY body) AS group_size,
               doc_id = first_value(doc_id) OVER w AS kept, sha256(body) AS text_sha256
        FROM t WINDOW w AS (PARTITION BY body ORDER BY length(raw) DESC, doc_id)""",
    "op9_lines": r"""
        WITH d AS (SELECT doc_id, coalesce(source, '') AS site, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
             l AS (SELECT DISTINCT site, regexp_replace(unnest(ls), '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS line FROM d),
             b AS (SELECT list(line) AS gone FROM (SELECT line FROM l WHERE line <> '' GROUP BY line HAVING count(DISTINCT site) >= 10)),
             t AS (SELECT doc_id, ls, list_transform(ls, lambda x: regexp_replace(x, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')) AS ts, coalesce(gone, []) AS gone FROM d, b),
             k AS (SELECT doc_id, ls, ts, list_transform(ts, lambda x: list_contains(gone, x)) AS hit FROM t)
        SELECT doc_id, len(list_filter(ts, lambda x: x <> '')) AS n_lines, len(list_filter(hit, lambda x: x)) AS n_removed,
               coalesce(array_to_string(list_transform(list_filter(list_zip(ls, hit), lambda z: NOT z[2]), lambda z: z[1]), chr(10)), '') AS text
        FROM k""",
}
