"""Every primitive's cases, as rows."""

import json

import pytest
from pyspark.sql import functions as F

from convoscore.operators.checks import Env, compile_check, register, result
from convoscore.operators.rubric import rollup, run_rubric
from convoscore.sources.calls import WORD, prepared

MAP = "array<struct<start:double,end:double,category:string,channel:string>>"
VERDICT = "struct<deal:struct<happened:boolean,consent:boolean,refusal:boolean,accept_quote:string,delivery_quote:string>,path:struct<is_titular:boolean,decision_maker:boolean,service:string>,checks:map<string,struct<met:boolean,evidence:string,customer_evidence:string,detail:string,score:double>>,scores:map<string,double>>"
SCHEMA = f"call_id long, agent_text string, customer_text string, words array<{WORD}>, duration double, agent_channel string, customer_channel string, rmap {MAP}, judge {VERDICT}"


def words(text, channel="left", step=1.0):
    return [(i, channel, w, i * step, i * step + 0.5, 1.0, 0.0, 99.0) for i, w in enumerate(text.split())]


def call(agent="", customer="", said=None, duration=100.0, agent_channel="left", customer_channel="right", rmap=None, judge=None):
    return (1, agent, customer, words(agent if said is None else said), duration, agent_channel, customer_channel, rmap, judge)


def judge(happened=None, consent=None, refusal=None, accept=None, delivery=None, titular=None, decides=None, checks=None, scores=None):
    return ((happened, consent, refusal, accept, delivery), (titular, decides, "mobile"), checks or {}, scores or {})


def run(spark, cfg, env=None, **given):
    df = prepared(spark.createDataFrame([call(**given)], SCHEMA))
    r = df.select(compile_check(cfg, env or Env()).alias("r")).first().r
    return r.status, json.loads(r.evidence)


CASES = [
    ("exact", {"primitive": "phrase_present", "phrases": ["Good   day!"]}, dict(agent="well, good day to you"), "met"),
    ("near", {"primitive": "phrase_present", "phrases": ["cancellation right"]}, dict(agent="your cancelation right holds"), "indeterminate"),
    ("absent", {"primitive": "phrase_present", "phrases": ["cancellation right"]}, dict(agent="your right holds"), "not_met"),
    ("short words never fuzzy", {"primitive": "phrase_present", "phrases": ["deal"]}, dict(agent="a dead end"), "not_met"),
    ("letters that look alike", {"primitive": "phrase_present", "phrases": ["саре"]}, dict(agent="Cape town"), "met"),
    ("no text", {"primitive": "phrase_present", "phrases": ["a"]}, dict(), "not_met"),
    ("count met", {"primitive": "phrase_count", "phrases": ["offer", ""]}, dict(agent="Offer, offer."), "met"),
    ("count missed", {"primitive": "phrase_count", "phrases": ["offer"], "min_count": 3}, dict(agent="Offer, offer."), "not_met"),
    ("order kept", {"primitive": "phrase_ordering", "before_phrases": ["hello"], "after_phrases": ["offer"]}, dict(agent="Hello, an offer"), "met"),
    ("order broken", {"primitive": "phrase_ordering", "before_phrases": ["hello"], "after_phrases": ["offer"]}, dict(agent="An offer. Hello"), "not_met"),
    ("one side absent", {"primitive": "phrase_ordering", "before_phrases": ["hello"], "after_phrases": ["offer"]}, dict(agent="Hello"), "na"),
    ("prefer", {"primitive": "word_prefer", "words": ["glad"]}, dict(agent="Glad to"), "met"),
    ("avoid", {"primitive": "word_avoid", "words": ["must"]}, dict(agent="you must"), "not_met"),
    ("forbidden", {"primitive": "forbidden_phrase", "phrases": ["guarantee"]}, dict(agent="I Guarantee it"), "not_met"),
    ("nearly forbidden", {"primitive": "forbidden_phrase", "phrases": ["guaranteed"]}, dict(agent="it is garanteed"), "indeterminate"),
    ("clean", {"primitive": "forbidden_phrase", "phrases": ["guarantee"]}, dict(agent="fine"), "met"),
    ("dense opening", {"primitive": "opening_density", "n": 3, "min_words": 3}, dict(agent="a b c d"), "met"),
    ("thin opening", {"primitive": "opening_density", "n": 3, "min_words": 4}, dict(agent="a b c d"), "not_met"),
    ("no word times", {"primitive": "opening_density"}, dict(agent="a b", said=""), "na"),
    ("two amounts", {"primitive": "numeric_structure", "currency": ["eur"]}, dict(agent="from 30 EUR now 21,50 eur"), "met"),
    ("same digits are one amount", {"primitive": "numeric_structure", "currency": ["eur"]}, dict(agent="21,50 eur or 2150 eur"), "not_met"),
    ("amounts that begin with their places", {"primitive": "numeric_structure", "currency": ["eur"]}, dict(agent="0 eur or 1 eur"), "met"),
    ("one amount that begins with its place", {"primitive": "numeric_structure", "currency": ["eur"]}, dict(agent="003181eur or 003181eur"), "not_met"),
    ("price masked", {"primitive": "numeric_structure", "currency": ["eur"]}, dict(agent="1 eur", rmap=[(1.0, 2.0, "CARD", "left")]), "indeterminate"),
    ("mask on the other side", {"primitive": "numeric_structure", "currency": ["eur"]}, dict(agent="1 eur", rmap=[(1.0, 2.0, "CARD", "right")]), "not_met"),
    ("no currency", {"primitive": "numeric_structure"}, dict(agent="1 eur"), "indeterminate"),
    ("all parts", {"primitive": "composite", "elements": [{"primitive": "word_prefer", "words": ["a"]}, {"primitive": "opening_density"}]}, dict(agent="a", said=""), "met"),
    ("a part missed", {"primitive": "composite", "elements": [{"primitive": "word_prefer", "words": ["a"]}, {"primitive": "word_prefer", "words": ["z"]}]}, dict(agent="a"), "not_met"),
    ("a part unknown", {"primitive": "composite", "elements": [{"primitive": "nothing"}]}, dict(agent="a"), "indeterminate"),
    ("no parts", {"primitive": "composite"}, dict(agent="a"), "indeterminate"),
    ("slot", {"primitive": "slot_present", "slot_categories": ["NAME"], "region": {"intro_seconds": 5}}, dict(rmap=[(4.0, 6.0, "NAME", "left")]), "met"),
    ("slot too late", {"primitive": "slot_present", "slot_categories": ["NAME"], "region": {"intro_seconds": 5}}, dict(rmap=[(5.0, 6.0, "NAME", "left")]), "not_met"),
    ("slot on the other side", {"primitive": "slot_present", "slot_categories": ["NAME"], "channel": "customer"}, dict(rmap=[(4.0, 6.0, "NAME", "left")]), "not_met"),
    ("no map", {"primitive": "slot_present", "slot_categories": ["NAME"]}, dict(), "indeterminate"),
    ("no customer channel", {"primitive": "slot_present", "slot_categories": ["NAME"], "channel": "customer"}, dict(rmap=[], customer_channel=None), "indeterminate"),
    ("after the anchor", {"primitive": "slot_present", "slot_categories": ["NAME"], "region": {"after_phrase": ["your address"]}}, dict(agent="well your address please", rmap=[(0.0, 0.9, "NAME", "left"), (2.0, 3.0, "NAME", "left")]), "met"),
    ("before the anchor", {"primitive": "slot_present", "slot_categories": ["NAME"], "region": {"after_phrase": ["your address"]}}, dict(agent="well your address please", rmap=[(0.0, 0.9, "NAME", "left")]), "not_met"),
    ("no anchor", {"primitive": "slot_present", "slot_categories": ["NAME"], "region": {"after_phrase": ["your address"], "on_missing_anchor": "na"}}, dict(agent="well", rmap=[]), "na"),
    ("no anchor by default", {"primitive": "slot_present", "slot_categories": ["NAME"], "region": {"after_phrase": ["your address"]}}, dict(agent="well", rmap=[]), "not_met"),
    ("no judge", {"primitive": "deal_detect"}, dict(), "indeterminate"),
    ("deal", {"primitive": "deal_detect"}, dict(customer="Yes please", judge=judge(happened=True, accept="yes PLEASE ")), "met"),
    ("deal without its quote", {"primitive": "deal_detect"}, dict(customer="No", judge=judge(happened=True, accept="yes please")), "not_met"),
    ("deal with an empty quote", {"primitive": "deal_detect"}, dict(customer="No", judge=judge(happened=True, accept="")), "not_met"),
    ("late number", {"primitive": "deal_detect", "delivery_detect": {"slot_categories": ["PHONE"]}}, dict(rmap=[(60.0, 61.0, "PHONE", "right")], judge=judge()), "met"),
    ("early number", {"primitive": "deal_detect", "delivery_detect": {"slot_categories": ["PHONE"]}}, dict(rmap=[(40.0, 61.0, "PHONE", "right")], judge=judge()), "not_met"),
    ("late logistics", {"primitive": "deal_detect", "delivery_detect": {"customer_phrases": ["to my work"]}}, dict(customer="hm " * 20 + "bring it to my work", judge=judge()), "met"),
    ("early logistics", {"primitive": "deal_detect", "delivery_detect": {"customer_phrases": ["to my work"]}}, dict(customer="to my work " + "no " * 40, judge=judge()), "not_met"),
    ("path unknown", {"primitive": "path_select"}, dict(judge=judge()), "indeterminate"),
    ("path", {"primitive": "path_select"}, dict(judge=judge(titular=False, decides=True)), "met"),
    ("score", {"primitive": "judge_check", "id": "e", "min_score": 0.5}, dict(judge=judge(scores={"e": 0.5})), "met"),
    ("nested score", {"primitive": "judge_check", "id": "e", "min_score": 0.5}, dict(judge=judge(checks={"e": (None, None, None, None, 0.4)})), "not_met"),
    ("no score", {"primitive": "judge_check", "id": "e", "min_score": 0.5}, dict(judge=judge()), "indeterminate"),
    ("judged", {"primitive": "judge_check", "id": "e"}, dict(agent="I see", judge=judge(checks={"e": (True, "i SEE", None, None, None)})), "met"),
    ("made up", {"primitive": "judge_check", "id": "e"}, dict(agent="I see", judge=judge(checks={"e": (True, "I hear", None, None, None)})), "not_met"),
    ("no evidence", {"primitive": "judge_check", "id": "e"}, dict(agent="I see", judge=judge(checks={"e": (True, "", None, None, None)})), "met"),
    ("evidence asked for", {"primitive": "judge_check", "id": "e", "require_evidence": True}, dict(agent="I see", judge=judge(checks={"e": (True, "", None, None, None)})), "not_met"),
    ("both sides quoted", {"primitive": "judge_check", "id": "e", "require_customer_quote": True}, dict(agent="I see", customer="too dear", judge=judge(checks={"e": (True, "I see", "too dear", None, None)})), "met"),
    ("customer not quoted", {"primitive": "judge_check", "id": "e", "require_customer_quote": True}, dict(agent="I see", customer="hm", judge=judge(checks={"e": (True, "I see", "too dear", None, None)})), "not_met"),
    ("external", {"primitive": "conditional_on", "condition": "external"}, dict(), "indeterminate"),
    ("condition unresolved", {"primitive": "conditional_on", "condition": "deal"}, dict(), "indeterminate"),
    ("condition unknown", {"primitive": "conditional_on", "condition": "rain"}, dict(), "indeterminate"),
    ("no condition", {"primitive": "conditional_on", "check": {"primitive": "word_prefer", "words": ["a"]}}, dict(agent="a"), "met"),
    ("unknown primitive", {"primitive": "nothing"}, dict(), "indeterminate"),
]


@pytest.fixture(scope="module")
def statuses(spark):
    """All cases in one job: a row a case, a column a check."""
    df = prepared(spark.createDataFrame([(k, *call(**given)[1:]) for k, (_, _, given, _) in enumerate(CASES)], SCHEMA))
    out = {}
    for start in range(0, len(CASES), 15):
        part = list(enumerate(CASES))[start : start + 15]
        picked = df.filter(F.col("call_id").between(start, start + 14))
        rows = picked.select("call_id", *(compile_check(cfg, Env())["status"].alias(f"c{k}") for k, (_, cfg, _, _) in part)).collect()
        out |= {r.call_id: r[f"c{r.call_id}"] for r in rows}
    return out


@pytest.mark.parametrize("k", range(len(CASES)), ids=[c[0] for c in CASES])
def test_case(statuses, k):
    assert statuses[k] == CASES[k][3]


def test_avoided_words_inside_mandated_phrases_do_not_count(spark):
    cfg = {"primitive": "word_avoid", "words": ["must"], "except_in_mandated_spans": True}
    assert run(spark, cfg, Env(mandated=("you must know",)), agent="As you must know. You must know. must") == ("not_met", {"count": 1})
    assert run(spark, cfg, Env(mandated=("you must know",)), agent="As you MUST know")[0] == "met"


def test_evidence(spark):
    status, e = run(spark, {"primitive": "deal_detect"}, customer="Yes please", judge=judge(happened=True, accept=" yes please", consent=True, refusal=True))
    assert (status, e["deal"], e["consent"], e["accept_quote"]) == ("met", "deal", True, "yes please")
    assert run(spark, {"primitive": "deal_detect"}, judge=judge(refusal=True))[1]["deal"] == "refusal"
    assert run(spark, {"primitive": "path_select"}, judge=judge(titular=False))[1]["path"] == "non_titular_no"
    assert run(spark, {"primitive": "phrase_present", "phrases": ["zz", "day"]}, agent="x" * 50 + " good day")[1]["quote"].endswith("good day")


def test_evidence_shows_whole_amounts(spark):
    assert run(spark, {"primitive": "numeric_structure", "currency": ["eur"]}, agent="0 eur or 10 eur")[1]["amounts"] == ["0 eur", "10 eur"]


RUBRIC = [
    {"id": "terms", "primitive": "conditional_on", "tier": "hard", "condition": "deal", "check": {"primitive": "word_prefer", "words": ["terms"]}},
    {"id": "others", "primitive": "word_prefer", "tier": "hard", "words": ["x"], "applies_to_paths": ["non_titular_yes"]},
    {"id": "deal", "primitive": "deal_detect", "tier": "soft"},
    {"id": "path", "primitive": "path_select", "tier": "soft"},
]


def checklist(spark, **given):
    df = prepared(spark.createDataFrame([call(**given)], SCHEMA))
    return run_rubric(df, RUBRIC)


def test_resolvers_run_first_and_rows_keep_their_order(spark):
    got = checklist(spark, agent="the terms", customer="yes", judge=judge(happened=True, accept="yes", titular=False, decides=True))
    assert [(r.id, r.status) for r in got.orderBy("seq").collect()] == [("terms", "met"), ("others", "not_met"), ("deal", "met"), ("path", "met")]
    assert tuple(rollup(got).first()) == (1, 1, 2, 0, 3, 4)


def test_gates_of_condition_and_path(spark):
    status = lambda **g: {r.id: r.status for r in checklist(spark, **g).collect()}
    assert status(judge=judge(titular=True)) == {"terms": "na", "others": "na", "deal": "not_met", "path": "met"}
    assert set(status().values()) == {"indeterminate"}


def test_empty_rubric_and_double_ids(spark):
    df = prepared(spark.createDataFrame([call()], SCHEMA))
    assert run_rubric(df, []).count() == 0
    with pytest.raises(ValueError):
        run_rubric(df, [RUBRIC[0], RUBRIC[0]])


def test_own_primitive(spark):
    register("always", lambda cfg, env: result("met", why=cfg["why"]))
    assert run(spark, {"primitive": "always", "why": "so"}) == ("met", {"why": "so"})
