"""Line dedup by distinct-site spread, in DataFrame functions only.

A HyperLogLog sketch of the sites of each line (by hash) is merged by aggregation, so a line that stands in a third of
all documents is a sketch a task before it is shuffled.  Lines whose estimate lies within three standard errors of the
threshold get an exact distinct count; lines that stand on enough sites are removed from every document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: [\x20\x09-\x0D], trimmed from both ends of a line before it is compared.
TRIMMED = " \t\x0b\x0c\r\n"
LG_K = 12
#: Relative standard error of a sketch with 2 ** LG_K buckets.
ERROR = 1.04 / 2 ** (LG_K / 2)


def _trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(TRIMMED))


def spread_lines(docs: DataFrame, min_sites: int = 10, text_col: str = "text", site_col: str = "source") -> DataFrame:
    """(h1, h2): the 128-bit hash of every trimmed line, other than the empty one, that stands on ``min_sites`` sites or more."""
    line = F.explode(F.transform(F.split(F.col(text_col), "\n", -1), _trimmed))
    lines = docs.select(F.coalesce(F.col(site_col).cast("string"), F.lit("")).alias("site"), line.alias("line")).filter("line != ''")
    lines = cut(lines.select(F.xxhash64("line").alias("h1"), F.xxhash64(F.lit("2"), "line").alias("h2"), "site"))
    estimates = lines.groupBy("h1", "h2").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", LG_K)).alias("sites"))
    low, high = min_sites * (1 - 3 * ERROR) - 1, min_sites * (1 + 3 * ERROR) + 1
    spread = cut(estimates.filter(F.col("sites") >= low))
    near = spread.filter(F.col("sites") < high).select("h1", "h2")
    # (line, site) pairs first, so that a frequent line is counted from one row a site
    exact = lines.join(near, ["h1", "h2"], "left_semi").distinct().groupBy("h1", "h2").count().filter(F.col("count") >= min_sites)
    return cut(spread.filter(F.col("sites") >= high).select("h1", "h2").unionByName(exact.select("h1", "h2")))


def line_dedup(docs: DataFrame, min_sites: int = 10, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source") -> DataFrame:
    """One row per input row: doc_id, n_lines (lines that are not blank), n_removed, text without the removed lines.

    Lines end at line feeds and are compared without ASCII white space at their ends; blank lines stay.  A null text
    counts as empty, a null site is a site of its own; ids may be null, and rows that repeat an id are cleaned each by its
    own text.  Very long texts are cleaned whole.  Other columns are ignored; an empty table gives an empty result.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.col(site_col).cast("string").alias("site"))
    spread = spread_lines(docs, min_sites, "text", "site")
    own = F.xxhash64("text")
    placed = docs.select("doc_id", own.alias("own"), F.posexplode(F.transform(F.split("text", "\n", -1), _trimmed)).alias("at", "line")).filter("line != ''")
    found = placed.select("doc_id", "own", "at", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit("2"), "line").alias("h2")).join(spread, ["h1", "h2"], "left_semi")
    # at most a document's lines in a group: rows that repeat an id and a text name the same places
    found = found.groupBy(F.col("doc_id").alias("f_id"), F.col("own").alias("f_own")).agg(F.collect_set("at").alias("gone"))
    docs = docs.withColumn("own", own).join(found, F.col("doc_id").eqNullSafe(F.col("f_id")) & (F.col("own") == F.col("f_own")), "left")
    lines = F.split("text", "\n", -1)
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.filter(lines, lambda x, i: ~F.array_contains("gone", i)), "\n"))
    filled = F.size(F.filter(lines, lambda x: _trimmed(x) != "")).cast("long")
    return docs.select("doc_id", filled.alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"), text.alias("text")).withColumn("n_removed", F.greatest("n_removed", F.lit(0).cast("long")))
