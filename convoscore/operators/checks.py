"""Check primitives: each compiles its settings to a Column STRUCT<status, evidence>.

status is met, not_met, indeterminate or na; evidence is a JSON object.  The columns that they read are those of
``sources.calls.prepared`` (one wide row a call).  Nothing here shuffles.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import count_outside, first_offset, match_status, normalise, quote, total_occurrences

#: Categories whose mask may hide a price.
NUMBER_MASKS = ("NUMERIC_RUN", "PHONE_OR_ID", "EGN", "CARD", "IBAN", "MULTI")
STATUSES = ("met", "not_met", "indeterminate", "na")


@dataclass(frozen=True)
class Env:
    """Names of state columns that resolvers have written (None: not resolved in this plan)."""

    deal: str | None = None
    consent: str | None = None
    path: str | None = None
    mandated: tuple[str, ...] = field(default=())


def result(status: Column | str, **evidence: Column | str | int | None) -> Column:
    status = F.lit(status) if isinstance(status, str) else status
    parts = [(v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in evidence.items()]
    return F.struct(status.alias("status"), (F.to_json(F.struct(*parts)) if parts else F.lit("{}")).alias("evidence"))


def _phrases(cfg: dict, key: str = "phrases") -> list[str]:
    return [str(p) for p in cfg.get(key, [])]


def phrase_present(cfg: dict, env: Env) -> Column:
    phrases = _phrases(cfg)
    found = match_status(F.col("norm"), F.col("toks"), phrases)
    return (
        F.when(found == "exact", result("met", quote=quote(F.col("source_text"), phrases)))
        .when(found == "near", result("indeterminate", reason="near match"))
        .otherwise(result("not_met"))
    )


def phrase_count(cfg: dict, env: Env) -> Column:
    count = total_occurrences(F.col("norm"), [normalise(p) for p in _phrases(cfg)])
    return result(F.when(count >= int(cfg.get("min_count", 2)), "met").otherwise("not_met"), count=count, min_count=int(cfg.get("min_count", 2)))


def phrase_ordering(cfg: dict, env: Env) -> Column:
    before, after = (first_offset(F.col("low"), _phrases(cfg, k)) for k in ("before_phrases", "after_phrases"))
    status = F.when((before < 0) | (after < 0), "na").when(before <= after, "met").otherwise("not_met")
    return result(status, before_at=before, after_at=after)


def word_prefer(cfg: dict, env: Env) -> Column:
    count = count_outside(F.col("low"), _phrases(cfg, "words"), [])
    return result(F.when(count > 0, "met").otherwise("not_met"), count=count)


def word_avoid(cfg: dict, env: Env) -> Column:
    mandated = list(env.mandated) if cfg.get("except_in_mandated_spans") else []
    count = count_outside(F.col("low"), _phrases(cfg, "words"), mandated)
    return result(F.when(count == 0, "met").otherwise("not_met"), count=count)


def forbidden_hits(low: Column, phrases: list[str]) -> Column:
    return F.array_compact(F.array(*(F.when(F.contains(low, F.lit(p.lower())), F.lit(p)) for p in phrases if p)) if any(phrases) else F.array().cast("array<string>"))


def forbidden_phrase(cfg: dict, env: Env) -> Column:
    phrases = _phrases(cfg)
    hits = forbidden_hits(F.col("low"), phrases)
    near = match_status(F.col("norm"), F.col("toks"), phrases) == "near"
    return F.when(F.size(hits) > 0, result("not_met", hits=hits)).when(near, result("indeterminate", reason="near match")).otherwise(result("met"))


def first_words(words: Column, seconds: float) -> Column:
    """Words that are not blank and start before ``seconds``; null without word times."""
    return F.when(F.size(words) > 0, F.size(F.filter(words, lambda w: (F.trim(w["word"]) != "") & (w["start"] < seconds))))


def opening_density(cfg: dict, env: Env) -> Column:
    count = first_words(F.col("agent_words"), float(cfg.get("n", 10)))
    return F.when(count.isNull(), result("na")).otherwise(result(F.when(count >= int(cfg.get("min_words", 12)), "met").otherwise("not_met"), words=count))


def amounts_of(text: Column, currency: list[str]) -> Column:
    """What the text has of a number and a marker.  (Given to ``transform`` by name, ``F.trim`` would take an amount's place
    in the list as the characters to trim.)"""
    marks = "|".join(re.escape(c) for c in currency)
    return F.transform(F.regexp_extract_all(text, F.lit(rf"(?iU)[0-9]+[.,]?[0-9]*\s*(?:{marks})"), F.lit(0)), lambda a: F.trim(a))


def distinct_amounts(amounts: Column) -> Column:
    """Amounts are told apart by their digits alone."""
    return F.size(F.array_distinct(F.transform(amounts, lambda a: F.regexp_replace(a, "[^0-9]", ""))))


def numeric_structure(cfg: dict, env: Env) -> Column:
    currency = _phrases(cfg, "currency")
    if not currency:
        return result("indeterminate", reason="no currency markers")
    amounts = amounts_of(F.col("source_text"), currency)
    masked = F.exists(F.coalesce("rmap", F.array()), lambda s: s["category"].isin(*NUMBER_MASKS) & (F.col("channel").isNull() | (s["channel"] == F.col("channel"))))
    shown = F.slice(amounts, 1, 6)
    return (
        F.when(distinct_amounts(amounts) >= int(cfg.get("min_values", 2)), result("met", amounts=shown))
        .when(F.coalesce(masked, F.lit(False)), result("indeterminate", reason="price may be masked", amounts=amounts))
        .otherwise(result("not_met", amounts=amounts))
    )


def composite(cfg: dict, env: Env) -> Column:
    parts = [compile_check(el, env)["status"] for el in cfg.get("elements", [])]
    if not parts:
        return result("indeterminate", elements=F.array().cast("array<string>"))
    all_ = F.array(*parts)
    status = F.when(F.array_contains(all_, "not_met"), "not_met").when(F.array_contains(all_, "indeterminate"), "indeterminate").otherwise("met")
    return result(status, elements=all_)


def channel_of(spec: str | None) -> Column:
    """customer / agent name a role; anything else is a channel, the agent's by default."""
    if spec == "customer":
        return F.col("customer_channel")
    return F.lit(spec) if spec and spec != "agent" else F.col("channel")


def phrase_time(words: Column, phrases: list[str]) -> Column:
    """Start of the word in which the first occurrence of any phrase begins, earliest over the phrases; null if absent.

    Words are trimmed before they are joined by a space, so phrases of several words match whatever spaces they carry."""
    joined = F.array_join(F.transform(words, lambda w: F.trim(F.lower(w["word"]))), " ")
    times = []
    for p in (p.lower() for p in phrases if p):
        head = F.substring(joined, F.lit(1), F.instr(joined, p))
        ix = F.length(head) - F.length(F.replace(head, F.lit(" "), F.lit("")))
        times.append(F.when(F.contains(joined, F.lit(p)), F.get(words, ix)["start"]))
    if not times:
        return F.lit(None).cast("double")
    return F.least(*times) if len(times) > 1 else times[0]


def _slot(s: Column) -> Column:
    return F.struct(s["category"].alias("category"), F.array(s["start"], s["end"]).alias("at"))


def slot_present(cfg: dict, env: Env) -> Column:
    categories, region = sorted(map(str, cfg.get("slot_categories", []))), cfg.get("region") or {}
    spec = cfg.get("channel")
    channel = channel_of(spec)
    low, high = F.lit(float(region.get("from", 0.0))), F.lit(float(region.get("to", region.get("intro_seconds", 1e9))))
    anchor = None
    if region.get("after_phrase"):
        anchor = phrase_time(F.col(region.get("after_phrase_words", "agent_words")), list(region["after_phrase"]))
        low = F.greatest(low, anchor)
    hit = F.get(F.filter("rmap", lambda s: (channel.isNull() | (s["channel"] == channel)) & s["category"].isin(categories) & (s["start"] < high) & (s["end"] > low)), 0)
    out = F.when(F.col("rmap").isNull(), result("indeterminate", reason="no redaction map"))
    if spec in ("customer", "agent"):
        out = out.when(channel.isNull(), result("indeterminate", reason=f"no {spec} channel"))
    if anchor is not None:
        missing = str(region.get("on_missing_anchor", "not_met"))
        out = out.when(anchor.isNull(), result(missing if missing in ("na", "not_met", "indeterminate") else "not_met", reason="anchor phrase absent"))
    return out.when(hit.isNotNull(), result("met", slot=_slot(hit))).otherwise(result("not_met", looked_for=",".join(categories)))


def has_judge() -> Column:
    return F.col("judge").isNotNull()


def delivery_slot(dd: dict) -> Column:
    """First slot of a delivery category on the customer's channel at or after the anchor phrase, or after the floor."""
    categories = [str(c) for c in dd.get("slot_categories", [])]
    if not categories:
        return F.lit(None).cast("struct<start:double,end:double,category:string,channel:string>")
    anchor = phrase_time(F.col(dd.get("after_phrase_words", "agent_words")), list(dd.get("after_phrase") or []))
    floor = F.when(F.col("duration") > 0, F.col("duration") * float(dd.get("min_fraction", 0.5)))
    begin, channel = F.coalesce(anchor, floor), channel_of(dd.get("channel", "customer"))
    return F.get(F.filter("rmap", lambda s: (s["channel"] == channel) & s["category"].isin(categories) & (s["start"] >= begin)), 0)


def logistics_phrase(dd: dict) -> Column:
    """First phrase that the customer says in the closing part of the customer's text; null if none."""
    from ..functions.text import normalise_text

    phrases = _phrases(dd, "customer_phrases")
    if not phrases:
        return F.lit(None).cast("string")
    text = F.coalesce(F.col("customer_text"), F.lit(""))
    tail = normalise_text(F.substring(text, F.floor(F.length(text) * float(dd.get("customer_min_fraction", 0.3))).cast("int") + 1, F.length(text)))
    return F.coalesce(*(F.when((text != "") & F.contains(tail, F.lit(normalise(p))), F.lit(p)) for p in phrases if normalise(p)))


def _quoted(value: Column, low: Column) -> Column:
    q = F.trim(F.coalesce(value, F.lit("")))
    return (q != "") & F.contains(F.coalesce(low, F.lit("")), F.lower(q))


def deal_detect(cfg: dict, env: Env) -> Column:
    deal, dd = F.col("judge.deal"), cfg.get("delivery_detect") if isinstance(cfg.get("delivery_detect"), dict) else {}
    accept, delivery = (_quoted(deal[k], F.col("customer_low")) for k in ("accept_quote", "delivery_quote"))
    slot, phrase = delivery_slot(dd), logistics_phrase(dd)
    yes = lambda c: F.coalesce(c, F.lit(False))
    outcome = F.when((yes(deal["happened"]) & (yes(accept) | yes(delivery))) | slot.isNotNull() | phrase.isNotNull(), "deal").when(yes(deal["refusal"]), "refusal").otherwise("no_deal")
    found = result(
        F.when(outcome == "deal", "met").otherwise("not_met"),
        deal=outcome, consent=yes(deal["consent"]),
        accept_quote=F.when(yes(accept), F.trim(deal["accept_quote"])).otherwise(""), delivery_quote=F.when(yes(delivery), F.trim(deal["delivery_quote"])).otherwise(""),
        delivery_slot=F.when(slot.isNotNull(), _slot(slot)), logistics=F.when(phrase.isNotNull(), F.struct(phrase.alias("phrase"))),
    )
    return F.when(~has_judge(), result("indeterminate", reason="no judge")).otherwise(found)


def path_select(cfg: dict, env: Env) -> Column:
    p = F.col("judge.path")
    path = F.when(p["is_titular"], "titular").when(F.coalesce(p["decision_maker"], F.lit(False)), "non_titular_yes").otherwise("non_titular_no")
    return F.when(~has_judge(), result("indeterminate", reason="no judge")).when(p["is_titular"].isNull(), result("indeterminate", reason="titular unknown")).otherwise(result("met", path=path, service=p["service"]))


def judge_check(cfg: dict, env: Env) -> Column:
    cid = str(cfg.get("id"))
    verdict = F.try_element_at(F.col("judge.checks"), F.lit(cid))
    absent = F.when(~has_judge(), result("indeterminate", reason="no judge"))
    if "min_score" in cfg:
        score = F.coalesce(F.try_element_at(F.col("judge.scores"), F.lit(cid)), verdict["score"])
        return absent.when(score.isNull(), result("indeterminate", reason="no score")).otherwise(result(F.when(score >= float(cfg["min_score"]), "met").otherwise("not_met"), score=score))
    evidence = F.coalesce(verdict["evidence"], F.lit(""))
    met = F.coalesce(verdict["met"], F.lit(False)) & ((evidence == "") | F.contains(F.col("low"), F.lower(evidence)))
    if cfg.get("require_evidence"):
        met = met & (F.trim(evidence) != "")
    if cfg.get("require_customer_quote"):
        met = met & (F.trim(evidence) != "") & F.coalesce(_quoted(verdict["customer_evidence"], F.col("customer_low")), F.lit(False))
    return absent.otherwise(result(F.when(met, "met").otherwise("not_met"), evidence=evidence, customer_evidence=verdict["customer_evidence"], detail=verdict["detail"]))


def conditional_on(cfg: dict, env: Env) -> Column:
    condition, inner = str(cfg.get("condition", "")), cfg.get("check") or {}
    run = compile_check(inner, env)
    if condition == "external":
        return result("indeterminate", reason="external condition")
    if condition in ("deal", "refusal"):
        state = F.col(env.deal) if env.deal else F.lit(None).cast("string")
        return F.when(state.isNull(), result("indeterminate", reason="condition unresolved")).when(state != condition, result("na", reason="condition not met")).otherwise(run)
    if condition == "consent":
        state = F.col(env.consent) if env.consent else F.lit(None).cast("boolean")
        return F.when(state.isNull(), result("indeterminate", reason="condition unresolved")).when(~state, result("na", reason="no consent")).otherwise(run)
    return result("indeterminate", reason="unknown condition") if condition else run


PRIMITIVES: dict[str, Callable[[dict, Env], Column]] = {
    f.__name__: f
    for f in (phrase_present, phrase_count, phrase_ordering, word_prefer, word_avoid, forbidden_phrase, opening_density, numeric_structure, composite, slot_present, deal_detect, path_select, judge_check, conditional_on)
}
RESOLVERS = ("deal_detect", "path_select")


def register(name: str, compiler: Callable[[dict, Env], Column]) -> None:
    """Adds a primitive of one's own: settings and environment in, STRUCT<status, evidence> out."""
    PRIMITIVES[name] = compiler


def compile_check(cfg: dict, env: Env) -> Column:
    """An unknown primitive is indeterminate, never an error."""
    make = PRIMITIVES.get(str(cfg.get("primitive")))
    return make(cfg, env) if make else result("indeterminate", reason="deferred")
