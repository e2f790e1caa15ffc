"""Landing zone, seeding, retirement and run state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def landing(spark: SparkSession, path: str, pattern: str = "*.{mp3,wav}") -> DataFrame:
    """files(path, length, modified, content): recordings of a folder, content read only if it is selected."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return files.select("path", "length", F.col("modificationTime").alias("modified"), "content")


def seed_plan(files: DataFrame, seeded: DataFrame) -> DataFrame:
    """Files whose content (sha256) is not seeded yet, one path for each content."""
    keyed = files.select("path", F.sha2("content", 256).alias("sha256"))
    return keyed.groupBy("sha256").agg(F.min("path").alias("path")).join(seeded.select("sha256"), "sha256", "left_anti")


def retire_candidates(runs: DataFrame) -> DataFrame:
    """Originals that may go: redaction not held, and the compliant file exists.  Deleting them is the caller's act."""
    return runs.filter(~F.coalesce("held", F.lit(True)) & F.coalesce(F.col("compliant_path") != "", F.lit(False)))


def retire_counts(runs: DataFrame) -> DataFrame:
    outcome = F.when(~F.coalesce("held", F.lit(True)) & F.coalesce(F.col("compliant_path") != "", F.lit(False)), "retired").otherwise("kept")
    return runs.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("runs"))


def seed(files: DataFrame, landing_path: str) -> DataFrame:
    """Adds the contents that are not there yet to the landing table (sha256, path, content) and returns what is there.
    Idempotent: contents are told by their checksum, and the committer makes a write visible as a whole."""
    spark = files.sparkSession
    landed = _landed(spark, landing_path)
    fresh = files.select("path", "content", F.sha2("content", 256).alias("sha256")).join(landed.select("sha256"), "sha256", "left_anti")
    fresh.groupBy("sha256").agg(F.min("path").alias("path"), F.min("content").alias("content")).write.mode("append").parquet(landing_path)
    return _landed(spark, landing_path)


def _landed(spark: SparkSession, landing_path: str) -> DataFrame:
    schema, at = "sha256 string, path string, content binary", spark._jvm.org.apache.hadoop.fs.Path(landing_path)
    there = at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
    return spark.read.schema(schema).parquet(landing_path) if there else spark.createDataFrame([], schema)


def verify(files: DataFrame, landed: DataFrame) -> DataFrame:
    """(path, outcome) of landed files: ok, mismatch (its content or its source's is not what the checksum says), or no
    source."""
    sources = files.select(F.col("path").alias("s_path"), F.sha2("content", 256).alias("s_sha256"))
    sound = (F.sha2("content", 256) == F.col("sha256")) & (F.col("s_sha256") == F.col("sha256"))
    return landed.join(sources, F.col("path") == F.col("s_path"), "left").select("path", F.when(F.col("s_sha256").isNull(), "no source").when(sound, "ok").otherwise("mismatch").alias("outcome"))


def save_runs(runs: DataFrame, path: str) -> None:
    """Run state, a folder a day.  Saving a run again updates it: states are versions, and the last one counts.  The output
    committer makes a write visible as a whole."""
    runs.withColumn("updated_at", F.current_timestamp()).write.mode("append").partitionBy("run_date").parquet(path)


def load_runs(spark: SparkSession, path: str) -> DataFrame:
    """The last saved state of every run."""
    every = spark.read.parquet(path)
    return every.groupBy("run_id").agg(F.max_by(F.struct(*(c for c in every.columns if c != "run_id")), "updated_at").alias("r")).select("run_id", "r.*")


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """words(path, seg_ix, word_ix, word, start, end, probability, seg_start, seg_end) of stand-alone transcripts."""
    word = "struct<word:string,start:double,end:double,probability:double>"
    raw = spark.read.schema(f"segments array<struct<start:double,end:double,words:array<{word}>>>").option("multiLine", True).json(path)
    segments = raw.select(F.input_file_name().alias("path"), F.posexplode("segments").alias("seg_ix", "s"))
    return segments.select("path", "seg_ix", F.col("s.start").alias("seg_start"), F.col("s.end").alias("seg_end"), F.posexplode("s.words").alias("word_ix", "w")).select("path", "seg_ix", "word_ix", "w.*", "seg_start", "seg_end")
