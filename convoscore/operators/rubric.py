"""The rubric: resolvers first, then every entry once, a row per call and entry; then its rollups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .checks import RESOLVERS, Env, compile_check, result


def _gated(entry: dict, env: Env) -> Column:
    """Entries for some paths only: an unknown path leaves them open, another path makes them not applicable."""
    paths = [str(p) for p in entry.get("applies_to_paths") or []]
    run = compile_check(entry, env)
    if not paths:
        return run
    path = F.col(env.path) if env.path else F.lit(None).cast("string")
    return F.when(path.isNull(), result("indeterminate", reason="path unresolved")).when(~path.isin(paths), result("na", reason="path not in scope")).otherwise(run)


def run_rubric(calls: DataFrame, rubric: list[dict], mandated: tuple[str, ...] = (), keep: tuple[str, ...] = ("call_id",)) -> DataFrame:
    """checklist(call_id, seq, id, primitive, tier, applies_to_paths, status, evidence); no rubric gives no rows.

    Two projections, no shuffle: resolvers write deal, consent and path, which all other entries may read."""
    ids = [str(e["id"]) for e in rubric]
    if len(set(ids)) != len(ids):
        raise ValueError("ids of rubric entries must differ")
    env, df = Env(mandated=mandated), calls
    resolved: dict[str, str] = {}
    for k, entry in enumerate(rubric):
        if entry.get("primitive") in RESOLVERS:
            name = f"__r{k}"
            df = df.withColumn(name, compile_check(entry, env))
            resolved[str(entry["id"])] = name
            evidence = F.col(f"{name}.evidence")
            if entry["primitive"] == "deal_detect":
                df = df.withColumns({"__deal": F.get_json_object(evidence, "$.deal"), "__consent": F.get_json_object(evidence, "$.consent").cast("boolean")})
                env = Env("__deal", "__consent", env.path, mandated)
            else:
                df = df.withColumn("__path", F.get_json_object(evidence, "$.path"))
                env = Env(env.deal, env.consent, "__path", mandated)
    # Every check is a column before its fields are read, so that it is made once.
    checks = {f"__c{seq}": _gated(entry, env) for seq, entry in enumerate(rubric) if str(entry["id"]) not in resolved}
    df = df.select(*keep, *resolved.values(), *(c.alias(name) for name, c in checks.items()))
    rows = []
    for seq, entry in enumerate(rubric):
        found = F.col(resolved.get(str(entry["id"]), f"__c{seq}"))
        paths = F.array(*(F.lit(str(p)) for p in entry.get("applies_to_paths") or [])).cast("array<string>")
        rows.append(F.struct(F.lit(seq).alias("seq"), F.lit(str(entry["id"])).alias("id"), F.lit(str(entry.get("primitive"))).alias("primitive"), F.lit(str(entry.get("tier"))).alias("tier"), paths.alias("applies_to_paths"), found["status"].alias("status"), found["evidence"].alias("evidence")))
    if not rows:
        none = "array<struct<seq:int,id:string,primitive:string,tier:string,applies_to_paths:array<string>,status:string,evidence:string>>"
        return df.select(*keep, F.inline(F.array().cast(none)))
    return df.select(*keep, F.inline(F.array(*rows)))


def rollup(checklist: DataFrame) -> DataFrame:
    """Per call: violations (hard, not met), advisories (all soft rows), review_needed (indeterminate), met, total."""
    count = lambda c: F.count_if(c).cast("long")
    hard, status = F.col("tier") == "hard", F.col("status")
    return checklist.groupBy("call_id").agg(
        count(hard & (status == "not_met")).alias("violations"), count(F.col("tier") == "soft").alias("advisories"),
        count(status == "indeterminate").alias("review_needed"), count(status == "met").alias("met"), F.count("*").alias("total"),
    )
