"""Adherence as a judge sees it: a category counts if it is present, conveyed well enough, and quoted word for word.

Malformed answers hold their call with a reason; nothing is filled in for what the judge left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strict_boolean, unit_score

ANSWER = "elements array<struct<category:string,present:string,conveyed:string,evidence:string>>, emotion struct<score:string>, active_listening struct<score:string>, objection struct<raised:string,rebutted:string>"


def _of(category: str) -> Column:
    """The judge's last entry for a category."""
    return F.try_element_at(F.filter(F.col("a.elements"), lambda e: e["category"] == category), F.lit(-1))


def judged_adherence(calls: DataFrame, contract: dict, verdict: str = "verdict", least: float = 0.5) -> DataFrame:
    """One row per call: counts, adherence (3 decimals), scores, objection (true, false or na), quotes_exact, hold_reason.

    ``verdict`` is the judge's JSON object as text, null where there is none."""
    df = calls.withColumn("a", F.from_json(F.col(verdict), ANSWER))
    reasons = [F.when(F.col(verdict).isNull(), "no answer"), F.when(F.col("a.elements").isNull(), "no elements")]
    matched, exact, mandatory = F.lit(0), F.lit(True), 0
    for d in contract["categories_detail"]:
        name, e = str(d["category"]), _of(str(d["category"]))
        present, conveyed, evidence = strict_boolean(e["present"]), unit_score(e["conveyed"]), F.trim(F.coalesce(e["evidence"], F.lit("")))
        quoted = (evidence != "") & F.contains(F.col("source_text"), evidence)
        met = F.coalesce(present & (conveyed >= least), F.lit(False))
        reasons += [F.when(e.isNull(), f"{name}: omitted"), F.when(present.isNull(), f"{name}: present is invalid"), F.when(conveyed.isNull(), f"{name}: conveyed is invalid"), F.when(met & ~quoted, f"{name}: met without its quote")]
        exact = exact & ((evidence == "") | quoted)
        if int(d.get("minimum_count", 0)) > 0:
            mandatory += 1
            matched = matched + met.cast("int")
    scores = {k: unit_score(F.col(f"a.{k}.score")) for k in ("emotion", "active_listening")}
    reasons += [F.when(s.isNull(), f"{k}: score is invalid") for k, s in scores.items()]
    objection = F.col("a.objection")
    told = {k: strict_boolean(objection[k]) for k in ("raised", "rebutted")}
    reasons += [F.when(objection.isNotNull() & t.isNull(), f"objection: {k} is invalid") for k, t in told.items()]
    hold = F.coalesce(*reasons)
    fine = lambda c: F.when(hold.isNull(), c)
    return df.select(
        "call_id", fine(F.lit(mandatory).cast("long")).alias("mandatory_count"), fine(matched.cast("long")).alias("matched_mandatory"), fine(F.round(matched / mandatory, 3) if mandatory else F.lit(0.0)).alias("adherence_score"),
        *(fine(s).alias(f"{k}_score") for k, s in scores.items()),
        *(fine(F.when(objection.isNull(), "na").otherwise(t.cast("string"))).alias(f"objection_{k}") for k, t in told.items()),
        fine(exact).alias("quotes_exact"), hold.alias("hold_reason"),
    )
