"""Reports: display kinds, sections, summary, header, coaching, rendered text, dialogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.arrays import bound
from ..functions.text import mmss

META = ("deal", "path")


def display_kind(tone_id: str | None = None, flags: Column | None = None) -> Column:
    """met, violation, review, advisory or na.  Soft failures are advisories; a tone check that is met although the
    delivery was flagged is one too; an unknown status goes to review."""
    tier, status = F.col("tier"), F.col("status")
    out = F.when(status == "na", "na")
    if tone_id is not None and flags is not None:
        out = out.when((status == "met") & (F.col("id") == tone_id) & (F.size(flags) > 0), "advisory")
    return (
        out.when(status == "met", "met")
        .when(status == "not_met", F.when(tier == "hard", "violation").otherwise("advisory"))
        .when(status == "indeterminate", F.when(tier == "hard", "review").otherwise("advisory"))
        .otherwise("review")
    )


def evidence_text(evidence: Column) -> Column:
    """quote, else amounts, else the logistics phrase, else phrase / customer evidence / evidence, else empty."""
    filled = lambda path: F.nullif(F.get_json_object(evidence, path), F.lit(""))
    amounts = F.nullif(F.array_join(F.from_json(F.get_json_object(evidence, "$.amounts"), "array<string>"), ", "), F.lit(""))
    return F.coalesce(filled("$.quote"), amounts, filled("$.logistics.phrase"), filled("$.phrase"), filled("$.customer_evidence"), filled("$.evidence"), F.lit(""))


def report_rows(checklist: DataFrame, presentation: dict, flags: DataFrame | None = None, keep: tuple[str, ...] = (), meta: bool = False) -> DataFrame:
    """report_rows(call_id, section_ix, section, row_ix, id, label, status, status_kind, evidence).

    Sections come in configured order; those that only rows name follow in the order of their first row.  The
    presentation is a few literals, so no join is needed.  ``keep`` names further columns of the checklist; with ``meta``
    the rows of deal and path stay too, behind all others and in no section."""
    criteria, sections = presentation.get("criteria") or {}, sorted(enumerate(presentation.get("sections") or []), key=lambda s: (s[1].get("order", 999), s[0]))
    place = {s["id"]: ix for ix, (_, s) in enumerate(sections)}
    look = lambda key, default: F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for k, c in criteria.items() for x in (k, str(c.get(key) or default or k)))), F.col("id")), F.lit(default) if default else F.col("id")) if criteria else (F.lit(default) if default else F.col("id"))
    own = ~F.col("id").isin(*META)
    rows = checklist if meta else checklist.filter(own)
    flag = None
    if flags is not None:
        rows = rows.join(flags.select("call_id", "flags"), "call_id", "left")
        flag = F.coalesce("flags", F.array().cast("array<string>"))
    section = F.when(own, look("section", "other"))
    rank = F.try_element_at(F.create_map(*(F.lit(x) for k, v in place.items() for x in (k, v))), section) if place else F.lit(None).cast("int")
    rows = rows.select("call_id", *keep, "seq", "tier", "id", "status", section.alias("section"), look("label", None).alias("label"), display_kind(presentation.get("tone_criterion"), flag).alias("status_kind"), F.when(own, evidence_text(F.col("evidence"))).otherwise(F.col("evidence")).alias("evidence"), rank.alias("placed"))
    first = F.min("seq").over(Window.partitionBy("call_id", "section"))
    rows = rows.withColumn("key", F.when(F.col("section").isNotNull(), F.coalesce("placed", F.lit(10_000) + first)))
    by_call = Window.partitionBy("call_id")
    return rows.select(
        "call_id", *keep, (F.dense_rank().over(by_call.orderBy(F.col("key").asc_nulls_last())) - 1).alias("section_ix"), "section",
        (F.row_number().over(Window.partitionBy("call_id", "section").orderBy("seq")) - 1).alias("row_ix"), "seq", "tier", "id", "label", "status", "status_kind", "evidence",
    )


def _counts() -> list[Column]:
    hard, status, own = F.col("tier") == "hard", F.col("status"), ~F.col("id").isin(*META)
    count = lambda c: F.count_if(own & c).cast("long")
    return [
        count(hard & (status != "na")).alias("hard_total"), count(hard & (status == "met")).alias("hard_met"), count(hard & (status == "not_met")).alias("hard_violations"),
        count(hard & ~status.isin("met", "not_met", "na")).alias("hard_review"), count(F.col("status_kind") == "advisory").alias("advisories"),
    ]


def report_summary(checklist: DataFrame, presentation: dict, flags: DataFrame | None = None) -> DataFrame:
    return report_rows(checklist, presentation, flags).groupBy("call_id").agg(*_counts())


def _meta() -> list[Column]:
    pick = lambda i, path: F.max(F.when(F.col("id") == i, F.get_json_object("evidence", path)))
    return [pick("deal", "$.deal").alias("outcome"), pick("deal", "$.accept_quote").alias("accept"), pick("deal", "$.logistics.phrase").alias("logistics"), pick("path", "$.path").alias("path")]


def _header(labels: dict | None) -> list[Column]:
    named = {"skipped": "skipped", "held": "held", "evaluated": "evaluated"} | (labels or {})
    deal = F.coalesce(F.col("outcome") == "deal", F.lit(False))
    status = F.when(F.col("run_status") == "skipped", named["skipped"]).when(F.col("run_status") == "blocked", named["held"]).otherwise(named["evaluated"])
    return [
        mmss(F.col("duration")).alias("duration_mmss"), F.col("path"), deal.alias("deal"),
        F.coalesce("logistics", F.nullif("accept", F.lit("")), F.lit("")).alias("deal_reason"),
        F.when(deal & (F.coalesce("accept", F.lit("")) == ""), "heuristic").otherwise("direct").alias("confidence"),
        status.alias("disposition"), F.when(F.col("run_status").isin("skipped", "blocked"), F.coalesce("hold_reason", F.lit(""))).otherwise("").alias("disposition_reason"),
    ]


def report_header(calls: DataFrame, checklist: DataFrame, labels: dict | None = None) -> DataFrame:
    """call_id, duration_mmss, path, deal, deal_reason, confidence, disposition, disposition_reason.

    ``calls`` carries run_status and hold_reason: skipped and held calls are not evaluated."""
    meta = checklist.filter(F.col("id").isin(*META)).groupBy("call_id").agg(*_meta())
    return calls.join(meta, "call_id", "left").select("call_id", *_header(labels))


def _faults(presentation: dict) -> list[Column]:
    listening = presentation.get("listening_criteria") or []
    broken = F.collect_list(F.when(F.col("status_kind") == "violation", F.struct("section_ix", "row_ix", "label")))
    return [
        F.array_join(F.transform(F.array_sort(broken), lambda x: x["label"]), ", ").alias("items"),
        F.max(F.when(F.col("status_kind") == "violation", 1).otherwise(0)).alias("bad"),
        F.max(F.when((F.col("status_kind") == "advisory") & (F.col("id").isin(listening) if listening else F.lit(False)), 1).otherwise(0)).alias("weak"),
    ]


def _coached(presentation: dict) -> Column:
    t = presentation.get("coaching") or {}
    template = lambda key: F.lit(t.get(key) or None).cast("string")
    return F.array_compact(F.array(
        F.when(F.col("bad") == 1, F.replace(template("has_violations"), F.lit("{items}"), F.col("items"))),
        F.when(F.col("weak") == 1, template("weak_listening")),
        F.when(F.col("deal"), template("sale")).otherwise(template("no_sale")),
    ))


def coaching(rows: DataFrame, header: DataFrame, presentation: dict) -> DataFrame:
    """coaching(call_id, line_ix, line): templates for violations, weak listening, and the outcome."""
    by_call = rows.groupBy("call_id").agg(*_faults(presentation))
    return header.filter(F.col("disposition_reason") == "").join(by_call, "call_id").select("call_id", F.posexplode(_coached(presentation)).alias("line_ix", "line"))


STATE = ("duration", "run_status", "hold_reason")


def call_reports(checklist: DataFrame, presentation: dict, flags: DataFrame | None = None, labels: dict | None = None) -> DataFrame:
    """One row per call out of a checklist that carries duration, run_status and hold_reason: the header, the summary,
    coaching (an array of lines, null for calls that are not evaluated) and rows (an array in order).

    All of it is one aggregation of the report's rows, so that a call's checks are made once and nothing is joined."""
    rows = report_rows(checklist, presentation, flags, STATE, meta=True)
    shown = F.struct("section_ix", "row_ix", "section", "label", "status_kind", "evidence")
    whole = F.array_sort(F.collect_list(F.when(F.col("section").isNotNull(), shown))).alias("rows")
    by_call = rows.withColumn("status_kind", F.when(F.col("section").isNotNull(), F.col("status_kind"))).groupBy("call_id", *STATE).agg(*_meta(), *_counts(), *_faults(presentation), whole)
    out = by_call.select("call_id", *_header(labels), "hard_total", "hard_met", "hard_violations", "hard_review", "advisories", "items", "bad", "weak", "rows")
    return out.withColumn("coaching", F.when(F.col("disposition_reason") == "", _coached(presentation))).drop("items", "bad", "weak")


def scorecard_text(reports: DataFrame, evidence_chars: int = 80) -> DataFrame:
    """text(call_id, text): a scorecard of plain lines for every call of ``call_reports``.  Never blank: a call that was
    skipped or held, or has no rows, says so."""
    shown = lambda r: F.substring(r["evidence"], 1, evidence_chars) if evidence_chars else F.lit("")
    line = lambda r: F.concat_ws(" ", F.concat(F.lit("["), r["status_kind"], F.lit("]")), r["section"], F.lit("/"), r["label"], F.when(shown(r) != "", F.concat(F.lit("- "), shown(r))))
    body = F.array_join(F.transform("rows", line), "\n")
    head = F.concat_ws(" ", F.lit("call"), F.col("call_id").cast("string"), F.col("duration_mmss"), F.col("disposition"), F.when(F.col("deal"), "deal").otherwise("no deal"))
    counts = F.concat_ws(" ", F.lit("hard"), F.concat_ws("/", F.col("hard_met").cast("string"), F.col("hard_total").cast("string")), F.lit("violations"), F.col("hard_violations").cast("string"), F.lit("review"), F.col("hard_review").cast("string"))
    told = F.when(F.col("disposition_reason") != "", F.concat(F.lit("not evaluated: "), F.col("disposition_reason"))).when(F.coalesce(F.size("rows"), F.lit(0)) <= 0, "no criteria")
    return reports.select("call_id", F.when(told.isNotNull(), F.concat_ws("\n", head, told)).otherwise(F.concat_ws("\n", head, counts, body)).alias("text"))


def save_scorecards(scorecards: DataFrame, path: str) -> None:
    """One text a call, parted by a blank line, in order of the calls within a file."""
    scorecards.sortWithinPartitions("call_id").select("text").write.mode("overwrite").option("lineSep", "\n\n").text(path)


def dialogue(calls: DataFrame) -> DataFrame:
    """turns(call_id, mono, turn_ix, role, start, text): words of both sides by start time (the agent first among equals),
    consecutive words of a role joined.  With one side only, a single block of it.

    A call is one row, so this is an array expression, not a shuffle: words are joined with a mark wherever the role
    changes, and parted there again."""
    words = F.array_sort(F.transform("words", lambda w: F.struct(w["start"].alias("start"), F.when(w["channel"] == F.col("agent_channel"), 0).otherwise(1).alias("role"), w["word_ix"].alias("ix"), F.translate(F.trim(w["word"]), "\n", " ").alias("word"))))
    both = F.col("agent_channel").isNotNull() & F.col("customer_channel").isNotNull()
    single = F.coalesce(F.nullif("agent_text", F.lit("")), F.nullif("customer_text", F.lit("")))
    block = F.when(single.isNotNull(), F.array(F.struct(F.lit("mono").alias("role"), F.lit(0.0).alias("start"), F.trim(single).alias("text"))))

    def turns(ws: Column) -> Column:
        fresh = lambda w, i: (i == 0) | (w["role"] != F.get(ws, i - 1)["role"])
        texts = F.split(F.array_join(F.transform(ws, lambda w, i: F.concat(F.when(fresh(w, i), F.when(i == 0, "").otherwise("\n")).otherwise(" "), w["word"])), ""), "\n", -1)
        every = F.zip_with(F.filter(ws, fresh), texts, lambda w, t: F.struct(F.when(w["role"] == 0, "agent").otherwise("customer").alias("role"), w["start"].alias("start"), t.alias("text")))
        return F.when(F.size(ws) > 0, F.filter(every, lambda t: t["text"] != ""))

    df = calls.select("call_id", (~both).alias("mono"), F.when(both, bound(words, turns)).otherwise(block).alias("turns"))
    return df.select("call_id", "mono", F.posexplode("turns").alias("turn_ix", "t")).select("call_id", "mono", "turn_ix", "t.*")
