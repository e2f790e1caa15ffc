"""Adapters from the driver's tables to calls, words, redaction maps, verdicts, recordings and acoustic frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalise_text

RATE, WORD_SECONDS = 0.4, 0.35
WORD = "struct<word_ix:int,channel:string,word:string,start:double,end:double,probability:double,seg_start:double,seg_end:double>"
#: Categories of the stand-in redaction map, in turn.
MAP_CATEGORIES = ("NER_PER", "PHONE_OR_ID", "ADDRESS")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _role_text(turns: Column, role: str) -> Column:
    return F.array_join(F.transform(F.filter(turns, lambda t: t["role"] == role), lambda t: t["text"]), " ")


def words_of(turns: Column) -> Column:
    """Words of a call's sorted turns: token i starts at 0.4 i seconds and lasts 0.35; a turn is a segment.

    A word knows its place in its turn and in the call, and all else follows from those: no fold, linear in the words."""
    tokens = lambda t: F.filter(F.split(t["text"], r"\s+"), lambda x: x != "")
    spoken = F.transform(turns, lambda t: F.struct(F.when(t["role"] == "assistant", "left").otherwise("right").alias("channel"), tokens(t).alias("ws")))
    placed = F.flatten(F.transform(spoken, lambda t: F.transform(t["ws"], lambda x, i: F.struct(t["channel"].alias("channel"), x.alias("word"), i.alias("at"), F.size(t["ws"]).alias("n")))))

    def word(x: Column, ix: Column) -> Column:
        begin, first = ix * RATE, (ix - x["at"]) * RATE
        last = (ix - x["at"] + x["n"] - 1) * RATE + WORD_SECONDS
        return F.struct(ix.cast("int").alias("word_ix"), x["channel"].alias("channel"), x["word"].alias("word"), begin.alias("start"), (begin + WORD_SECONDS).alias("end"), (F.lit(1.0) - (ix % 7) * 0.1).alias("probability"), first.alias("seg_start"), last.alias("seg_end"))

    return F.transform(placed, word)


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per conversation: texts of both sides, words, redaction map, duration, channels (one shuffle, on conv_id)."""
    turns = table(spark, sf_dir, "conversations").filter(F.col("role").isin("assistant", "user")).select("conv_id", "turn", "role", "text")
    # A call is much work for few bytes, so partitions are not merged by size.
    turns = turns.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "conv_id")
    grouped = turns.groupBy(F.col("conv_id").alias("call_id")).agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    df = grouped.select("call_id", "turns", _role_text(F.col("turns"), "assistant").alias("agent_text"), _role_text(F.col("turns"), "user").alias("customer_text"), words_of(F.col("turns")).alias("words"))
    return df.select(
        "call_id", "turns", "agent_text", "customer_text", "words",
        (F.size("words") * RATE).alias("duration"),
        F.when(F.col("agent_text") != "", "left").alias("agent_channel"),
        F.when(F.col("customer_text") != "", "right").alias("customer_channel"),
        redaction_map(F.col("words")).alias("rmap"),
    )


def redaction_map(words: Column) -> Column:
    """Stand-in map: every 17th word of a call is a masked slot, its category taken in turn."""
    slots = F.filter(words, lambda w: w["word_ix"] % 17 == 16)
    category = lambda w: F.element_at(F.array(*map(F.lit, MAP_CATEGORIES)), F.floor(w["word_ix"] / 17).cast("int") % 3 + 1)
    return F.transform(slots, lambda w: F.struct(w["start"].alias("start"), w["end"].alias("end"), category(w).alias("category"), w["channel"].alias("channel")))


def with_verdicts(df: DataFrame) -> DataFrame:
    """A stand-in judge, by arithmetic on call_id; quotes are prefixes of the real texts, every 7th one is made up."""
    k = F.col("call_id")
    fake = k % 7 == 0
    quoted = lambda text, n: F.when(fake, "no such words").otherwise(F.substring(text, 1, n))
    judge = F.struct(
        F.struct((k % 3 == 0).alias("happened"), (k % 2 == 0).alias("consent"), (k % 5 == 0).alias("refusal"), quoted(F.col("customer_text"), 12).alias("accept_quote"), F.lit("").alias("delivery_quote")).alias("deal"),
        F.struct(F.when(k % 11 != 0, k % 4 == 0).alias("is_titular"), (k % 2 == 1).alias("decision_maker"), F.when(k % 2 == 0, "mobile").otherwise("fixed").alias("service")).alias("path"),
        F.create_map(F.lit("effort"), F.struct((k % 2 == 0).alias("met"), quoted(F.col("agent_text"), 10).alias("evidence"), quoted(F.col("customer_text"), 10).alias("customer_evidence"), F.lit("").alias("detail"), F.lit(None).cast("double").alias("score"))).alias("checks"),
        F.create_map(F.lit("emotion"), F.when(k % 13 != 0, (k % 10) / 10.0), F.lit("listening"), (k % 4) / 4.0).alias("scores"),
    )
    return df.withColumn("judge", F.when(k % 17 != 0, judge))


def prepared(df: DataFrame) -> DataFrame:
    """The wide row that checks read: normalised and lower-cased texts are made once a call."""
    w = F.col("words")
    return df.withColumns({
        "source_text": F.col("agent_text"), "low": F.lower("agent_text"), "norm": normalise_text("agent_text"), "customer_low": F.lower("customer_text"),
        "agent_words": F.filter(w, lambda x: x["channel"] == "left"), "customer_words": F.filter(w, lambda x: x["channel"] == "right"), "channel": F.col("agent_channel"),
    }).withColumn("toks", F.filter(F.split("norm", " "), lambda x: x != ""))


def word_rows(df: DataFrame) -> DataFrame:
    return df.select("call_id", F.inline("words"))


def with_recording(df: DataFrame) -> DataFrame:
    """Calls with stand-in metadata of their recordings: channels with text (null for a call without a recording),
    duration (null now and then, as of an unreadable file) and a volume made from call_id (null now and then)."""
    k, channels = F.col("call_id"), (F.col("agent_text") != "").cast("int") + (F.col("customer_text") != "").cast("int")
    return df.withColumns({"channels": F.when(k % 23 != 0, channels), "duration_seconds": F.when(k % 19 != 0, F.col("duration")), "mean_volume_db": F.when(k % 9 != 0, -20.0 - k % 40)})


def recordings(df: DataFrame) -> DataFrame:
    """The same metadata as a table of its own, without a row for calls that have no recording."""
    return with_recording(df).filter(F.col("channels").isNotNull()).select("call_id", "channels", "duration_seconds", "mean_volume_db")
