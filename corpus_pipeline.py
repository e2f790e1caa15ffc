"""A corpus pipeline out of five operators of convoscore.llm.

Each stage takes (spark, docs, sf_dir) and returns the documents that it keeps, with the columns of ``documents``; the
last returns their piece ids.  ``run`` writes every stage's result to the shared folder and reads it again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convoscore.llm.common import cut, cuts, free, free_since, fresh_name, table
from convoscore.llm.exact import exact_dedup
from convoscore.llm.mixing import mix
from convoscore.llm.neardup import near_dedup
from convoscore.llm.quality import fit_quality, quality_scores
from convoscore.llm.spm import encode_documents

#: Documents with a lower score are rejected.
LEAST_SCORE = 0.3


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a key of its own for each row, and the key's name: the id where no other row has it.

    Of rows that share an id one keeps it; the others, and rows without an id, get numbers above all ids (below all, if
    there is no room above)."""
    row, n, first, other = (fresh_name(x, docs.columns) for x in ("__row", "__n", "__first", "__id"))
    odd = F.col("rows") > 1
    if docs.groupBy("doc_id").agg(F.count("*").alias("rows")).filter(odd | F.col("doc_id").isNull()).limit(1).isEmpty():
        return docs.withColumn(row, F.col("doc_id")), row
    docs = cut(docs.withColumn(n, F.monotonically_increasing_id()))
    shared = docs.groupBy("doc_id").agg(F.count("*").alias("rows"), F.min(n).alias(first)).filter(odd | F.col("doc_id").isNull())
    low, high, most = docs.agg(F.min("doc_id"), F.max("doc_id"), F.max(n)).first()
    number = F.lit((high or 0) + 1) + F.col(n) if (high or 0) + 1 + most < 2**63 else F.lit(low - 1) - F.col(n)
    joined = docs.join(shared.select(F.col("doc_id").alias(other), first), F.col("doc_id").eqNullSafe(F.col(other)), "left")
    own = F.col(first).isNull() | (F.col("doc_id").isNotNull() & (F.col(n) == F.col(first)))
    return joined.withColumn(row, F.when(own, F.col("doc_id")).otherwise(number)).drop(other, first, n), row


def _without(keyed: DataFrame, row: str, decided: DataFrame) -> DataFrame:
    """``keyed`` without the rows that an operator did not keep; Spark sends the keys around only if they are few."""
    return keyed.join(decided.filter("NOT kept").select(F.col("doc_id").alias(row)), row, "left_anti")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from ``labels`` and drops the documents that the classifier rejects.

    A null text counts as empty, and empty ones have a score too; rows that repeat are scored each; any columns are kept
    as they are, whatever their names; an empty table stays one."""
    forest = fit_quality(docs, table(spark, sf_dir, "labels"))
    score = fresh_name("__score", docs.columns)
    return quality_scores(docs, forest, score_col=score, least=LEAST_SCORE).drop(score)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts, whatever its id: ids may be null or repeated, and of rows that repeat one
    stays.  Null, empty and blank texts are equal; any columns are kept as they are."""
    keyed, row = _keyed(docs)
    return _without(keyed, row, exact_dedup(keyed, id_col=row)).select(_names(docs))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near copies (five words, similarity 0.8), whatever its id.  Null, empty and blank
    texts have no copies and stay; any columns are kept as they are."""
    keyed, row = _keyed(docs)
    return _without(keyed, row, near_dedup(keyed, id_col=row)).select(_names(docs))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row as often as the mix takes it, whatever its id.  Null texts have no words; a null source is a source of
    its own; any columns are kept as they are."""
    keyed, row = _keyed(docs)
    times, copy = fresh_name("__copies", keyed.columns), fresh_name("__copy", keyed.columns)
    copies = mix(keyed, id_col=row).filter("copies > 0").select(F.col("doc_id").alias(row), F.col("copies").alias(times))
    return keyed.join(copies, row).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times).cast("int")))).select(_names(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The piece ids of the whole texts (``ids``, ``n_tokens``, ``round_trip``), in place of columns of these names."""
    return encode_documents(docs)


def _names(docs: DataFrame) -> list[str]:
    return [f"`{c}`" for c in docs.columns]


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("mixing", mixing), ("encode", encode)]

#: Fitted trees, Newton's iterations and the tokenizer can't be written in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        there, before = cuts(), docs
        docs = cut(stage(spark, docs, sf_dir))
        free_since(there, docs)
        free(before)
    return STAGES[-1][1](spark, docs, sf_dir)
