import json
import random
import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from convoscore.functions import spans as S
from convoscore.functions import text as T
from convoscore.operators import calls as C
from convoscore.operators import providers as P
from convoscore.operators import report as R
from convoscore.plans import config, workflow
from convoscore.sources import calls as A
from convoscore.sources import landing as L
from convoscore.streaming import live

SF = "/root/testdata/sf0.001"


def one(spark, column, **given):
    df = spark.range(1).select(*(F.lit(v).alias(k) for k, v in given.items())) if given else spark.range(1)
    return df.select(column.alias("x")).first().x


def found(spark, column, text):
    return [(s.start, s.end, s.category) for s in one(spark, column, text=text)]


# --- text --------------------------------------------------------------------------------------------------------


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def plain_status(text, phrases):
    norm, near = T.normalise(text), False
    words = norm.split()
    for p in map(T.normalise, phrases):
        if p and p in norm:
            return "exact"
        ps = p.split()
        near = near or bool(ps) and any(all(distance(w, words[s + k]) <= T.edit_budget(w) for k, w in enumerate(ps)) for s in range(len(words) - len(ps) + 1))
    return "near" if near else "absent"


def test_match_status_against_a_plain_model(spark):
    r, vocab = random.Random(2), ["agreement", "agreemant", "contract", "contrakt", "ab", "Abc", "naïve", "straße", "strasse", "delivery", "deliver"]
    texts = [" ".join(r.choice(vocab) + r.choice(["", ",", "!"]) for _ in range(r.randrange(8))) for _ in range(150)] + ["", None]
    phrases = ["agreement contract", "STRASSE", "deliveri", "abc naive", "", "!!"]
    df = spark.createDataFrame([(t,) for t in texts], "text string").withColumn("norm", T.normalise_text("text")).withColumn("toks", F.filter(F.split("norm", " "), lambda x: x != ""))
    rows = df.select("text", *(T.match_status(F.col("norm"), F.col("toks"), [p]).alias(f"p{k}") for k, p in enumerate(phrases)), T.match_status(F.col("norm"), F.col("toks"), phrases).alias("best")).collect()
    for row in rows:
        for k, p in enumerate(phrases):
            assert row[f"p{k}"] == plain_status(row.text, [p])
        assert row.best == plain_status(row.text, phrases)


def test_offsets_counts_quotes(spark):
    assert one(spark, T.all_offsets(F.col("t"), "aa"), t="aaaaxaa") == [0, 2, 5]
    assert one(spark, T.first_offset(F.col("t"), ["zz", "B"]), t="ab") == 1
    assert one(spark, T.first_offset(F.col("t"), []), t="ab") == -1
    assert one(spark, T.total_occurrences(F.col("t"), ["aa", ""]), t="aaaaa") == 2
    assert one(spark, T.quote(F.col("t"), ["no", "B", "a"], 1), t="aBc d") == "aBc"
    assert [one(spark, T.mmss(F.lit(x).cast("double"))) for x in (0.0, None, 59.6, 638.0)] == ["—", "—", "1:00", "10:38"]


@pytest.mark.parametrize("raw,want", [('{"a": 1}', {"a": 1}), ('x ```json\n{"a": 2}\n``` y', {"a": 2}), ('so {"a": {"b": 3}} it is', {"a": {"b": 3}}), ("[1]", None), ("no", None), ("", None), ("{broken", None)])
def test_parse_json_object(spark, raw, want):
    got = one(spark, T.parse_json_object(F.col("t")), t=raw)
    assert (json.loads(got) if got else None) == want


# --- spans -------------------------------------------------------------------------------------------------------


def test_number_spans_against_re(spark):
    r = random.Random(4)
    texts = ["".join(r.choice("0123456789 -ab𝔘") for _ in range(40)) for _ in range(100)] + [""]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", S.number_spans(F.col("t"), False).alias("s")).collect()
    for row in rows:
        want = [(m.start(), m.end()) for m in re.finditer(r"[0-9][0-9 \-]{3,}[0-9]", row.t) if len(re.sub(r"\D", "", m[0])) >= 5]
        assert [(s.start, s.end) for s in row.s] == want


def test_number_classes(spark):
    classes = {"4111111111111111": "CARD", "4111111111111112": "NUMERIC_RUN", "0888123456": "PHONE_OR_ID", "12345": "NUMERIC_RUN", "8001010008": "EGN"}
    weights = (2, 4, 8, 5, 10, 9, 7, 3, 6)
    assert sum(int(d) * w for d, w in zip("800101000", weights, strict=False)) % 11 % 10 == 8
    for digits, want in classes.items():
        assert one(spark, S.number_class(F.col("d")), d=digits) == want
    assert one(spark, S.number_class(F.col("d"), personal=False), d="8001010008") == "PHONE_OR_ID"


def test_other_recognisers(spark):
    words = ["one", "two", "three"]
    runs = lambda t: found(spark, S.number_word_spans(F.col("text"), words, "and"), t)
    assert runs("one two three") == [] and runs("my One two, 3 and three and then") == [(3, 23, "PHONE_OR_ID")]
    assert runs("and one 2 two three and") == [(4, 19, "PHONE_OR_ID")]
    assert found(spark, S.email_spans(F.col("text")), "an é.b+c@d-e.f.org!") == [(3, 18, "EMAIL")]
    assert found(spark, S.iban_spans(F.col("text"), "BG"), "x bg80BNBG96611020345678 y") == [(2, 24, "IBAN")]
    assert found(spark, S.context_spans(F.col("text"), ["name is "], 10), "My name is Ann. Her name is Maximiliana Z, name is .") == [(11, 14, "CONTEXT_PII"), (28, 38, "CONTEXT_PII")]
    detect = S.detect_spans(F.col("text"), words, "and", ["name is "], "BG", include_context=False)
    assert [c for *_, c in found(spark, detect, "name is Ann 12345 a@b.c one two three 4")] == ["NUMERIC_RUN", "PHONE_OR_ID", "EMAIL"]


def test_merge_against_a_plain_model(spark):
    r, rows = random.Random(5), []
    for k in range(100):
        spans = [(a := r.randrange(40), a + r.randrange(1, 8), r.choice("AB")) for _ in range(r.randrange(8))]
        rows.append((k, spans))
    got = spark.createDataFrame(rows, f"k int, s {S.SPAN}").select("k", S.merge_spans(F.col("s")).alias("m")).collect()
    for row in got:
        want = []
        for a, b, c in sorted(rows[row.k][1]):
            if want and a <= want[-1][1]:
                want[-1] = [want[-1][0], max(b, want[-1][1]), c if c == want[-1][2] else "MULTI"]
            else:
                want.append([a, b, c])
        assert [list(m) for m in row.m] == want
    assert one(spark, S.mask_text(F.col("t"), S.merge_spans(S.email_spans(F.col("t")))), t="to a@b.c, x@y.z") == "to [EMAIL], [EMAIL]"


# --- calls -------------------------------------------------------------------------------------------------------


def test_gate_reasons(spark):
    gate = lambda d, v: one(spark, C.conversation_gate(F.lit(d).cast("double"), F.lit(v).cast("double")))
    assert gate(7.9, -10.0).reason == "too short" and gate(8.0, -50.1).reason == "silent"
    assert gate(8.0, -50.0).is_conversation and gate(9.0, None).is_conversation


def test_prosody(spark):
    words = [(1, "left", k, "w", float(k), k + 0.4, 1.0, 0.0 if k < 4 else 10.0, 4.0 if k < 4 else 12.0) for k in range(6)]
    df = spark.createDataFrame(words, "call_id long, channel string, word_ix int, word string, start double, end double, probability double, seg_start double, seg_end double")
    ranges = spark.createDataFrame([(1, "left", 1.0, 3.0, "CARD")], "call_id long, channel string, start double, end double, category string")
    frames = spark.createDataFrame([(1, "left", 0.5, 100.0, 60.0), (1, "left", 2.0, 900.0, 1.0), (1, "left", 3.5, 0.0, 50.0), (1, "left", 3.0, 120.0, 40.0)], "call_id long, channel string, t double, pitch double, energy double")
    first, second = C.turn_prosody(df, ranges, frames).orderBy("start").collect()
    assert (first.n_words, first.pace, first.pause_before, first.pitch, first.energy) == (4, 2.0, 0.0, 110.0, 50.0)
    assert (second.pace, second.pause_before, second.pitch, second.energy) == (1.0, 6.0, 0.0, 0.0)
    got = C.delivery(C.turn_prosody(df, ranges, frames)).first()
    assert got.pitch_na and got.pitch_std_hz is None and set(got.flags) == {"low_energy_delivery"}


def test_roles(spark):
    rows = [(1, "left", 0, "an offer, the OFFER"), (1, "right", 1, "no offer"), (2, "left", 0, "hm"), (2, "right", 1, ""), (3, "left", 0, "offer"), (3, "right", 1, "offer")]
    got = {r.call_id: r for r in C.channel_roles(spark.createDataFrame(rows, "call_id long, channel string, channel_ix int, text string"), ["offer"]).collect()}
    assert (got[1].agent_channel, got[1].customer_channel, got[2].agent_channel, got[3].agent_channel) == ("left", "right", None, "left")


def test_report_kinds(spark):
    rows = [(1, k, f"c{k}", tier, status, "{}") for k, (tier, status) in enumerate((t, s) for t in ("hard", "soft") for s in ("met", "not_met", "indeterminate", "na", "odd"))]
    df = spark.createDataFrame(rows, "call_id long, seq int, id string, tier string, status string, evidence string")
    flags = spark.createDataFrame([(1, ["slow_pace"])], "call_id long, flags array<string>")
    got = [r.status_kind for r in R.report_rows(df, {"tone_criterion": "c0"}, flags).orderBy("seq").collect()]
    assert got == ["advisory", "violation", "review", "na", "review", "met", "advisory", "advisory", "na", "review"]
    s = R.report_summary(df, {}).first()
    assert s.hard_met + s.hard_violations + s.hard_review == s.hard_total == 4 and s.advisories == 2
    assert one(spark, R.evidence_text(F.lit('{"amounts":["1 eur","2 eur"]}'))) == "1 eur, 2 eur" and one(spark, R.evidence_text(F.lit("{}"))) == ""


# --- configuration and workflows ---------------------------------------------------------------------------------


def test_config_fails_closed(tmp_path):
    good = json.loads((config.HERE / "demo.json").read_text("utf-8"))
    broken = [good | {"schema_version": 2}, {k: v for k, v in good.items() if k != "contract"}, good | {"contract": []}, good | {"rubric": {}}, good | {"rubric": [{"id": "a", "primitive": "x", "tier": "mild"}]}, good | {"rubric": good["rubric"] + good["rubric"][:1]}, good | {"stt_prompt": 3}, []]
    for k, raw in enumerate(broken):
        (tmp_path / f"p{k}.json").write_text(json.dumps(raw))
        with pytest.raises(config.ConfigError):
            config.load_profile(f"p{k}", tmp_path)
    (tmp_path / "bad.json").write_text("{")
    for name in ("bad", "missing"):
        with pytest.raises(config.ConfigError):
            config.load_profile(name, tmp_path)
    (tmp_path / "bare.json").write_text(json.dumps({k: v for k, v in good.items() if k != "rubric"} | {"_note": 1}))
    assert config.load_profile("bare", tmp_path).rubric == []
    with pytest.raises(config.ConfigError):
        config.load_profile("bare", tmp_path, strict=True)
    assert config.speech_prompt(" a ", None, "b") == "a b" and config.speech_prompt("", None) is None


def flow(*phases):
    return workflow.Workflow.of({"name": "w", "phases": [{"id": i, "type": t, "depends_on": d} | c for i, t, d, c in phases]})


def test_order_of_phases():
    w = flow(("c", "noop", ["b"], {}), ("a", "noop", [], {}), ("b", "noop", ["a"], {}), ("d", "noop", [], {}))
    assert [p.id for p in w.ordered()] == ["a", "b", "c", "d"]
    for bad in (flow(("a", "noop", ["b"], {}), ("b", "noop", ["a"], {})), flow(("a", "noop", ["x"], {})), flow(("a", "noop", [], {}), ("a", "noop", [], {}))):
        with pytest.raises(config.ConfigError):
            bad.ordered()


def test_retries_holds_and_failures(spark):
    tries = []

    @workflow.phase("flaky")
    def flaky(spark, context, settings):
        tries.append(1)
        if len(tries) < 3:
            raise RuntimeError("not yet")
        return {"x": 1}

    @workflow.phase("held")
    def held(spark, context, settings):
        raise workflow.Hold("no model")

    run = workflow.execute(spark, flow(("f", "flaky", [], {"max_attempts": 3})), {})
    assert (run.status, run.phases["f"].attempts, run.context["x"]) == ("completed", 3, 1)
    run = workflow.execute(spark, flow(("h", "held", [], {"max_attempts": 3}), ("n", "noop", ["h"], {})), {})
    assert (run.status, run.phases["h"].attempts, list(run.phases)) == ("blocked", 1, ["h"])
    run = workflow.execute(spark, flow(("u", "unheard of", [], {})), {})
    assert run.status == "failed" and run.table(spark).first().error


def test_shipped_workflows(spark):
    assert workflow.list_workflows() == ["ingest", "noop", "pipeline", "quality", "redact"]
    calls = A.with_verdicts(A.calls(spark, SF))
    context = {"calls": calls, "prepared": A.prepared(calls), "recordings": A.recordings(calls), "profile": config.load_profile("demo", strict=True), "language": config.load_language("demo")}
    run = workflow.execute(spark, workflow.load_workflow("quality"), context)
    assert run.status == "completed", run.phases
    gated = run.context["gated"].filter("run_status = 'completed'").count()
    assert run.context["checklist"].count() == gated * len(context["profile"].rubric) and run.context["report_summary"].count() == gated
    assert workflow.execute(spark, workflow.load_workflow("quality"), context | {"profile": None}).status == "blocked"


# --- providers ---------------------------------------------------------------------------------------------------


def test_text_windows(spark):
    """Against a plain model: every character is in a window, neighbours share 150, no word of 150 letters at most is cut
    at the end of each window that holds it."""
    texts = ["", "short", "x" * 2000, "ab " * 700, "a " + "y" * 1500, "word " * 119 + "Maximilian " + "word " * 200, "é" * 601, "z" * 600]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", P.text_windows(F.col("t")).alias("w")).collect()
    for row in rows:
        got = [(w.start, w.part) for w in row.w]
        assert all(len(part) <= 600 and row.t[start : start + len(part)] == part for start, part in got)
        assert got[0][0] == 0 and got[-1][0] + len(got[-1][1]) == len(row.t)
        assert all(a[0] < b[0] <= a[0] + len(a[1]) - 150 for a, b in zip(got, got[1:], strict=False))
        for m in re.finditer(r"\S{1,150}(?!\S)", row.t):
            if m.start() == 0 or row.t[m.start() - 1] == " ":
                assert any(s <= m.start() and m.end() <= s + len(part) for s, part in got)
    assert one(spark, P.text_windows(F.lit(None).cast("string")))[0].part == ""
    with pytest.raises(ValueError):
        P.text_windows(F.lit("a"), 300, 150)


def test_entity_provider(spark):
    recognise = P.entity_provider(lambda: lambda t: [(m.start(), m.end(), "NER_PER") for m in re.finditer("Ann", t)], 24, 8)
    text = "hello there Ann and also Ann, then Ann again"
    assert found(spark, recognise(F.col("text")), text) == [(m.start(), m.end(), "NER_PER") for m in re.finditer("Ann", text)]


def test_judge_provider(spark):
    def ask(prompt):
        if prompt == "boom":
            raise RuntimeError("down")
        return {"fine": 'sure {"met": true}', "vague": "I think so"}[prompt]

    df = spark.createDataFrame([(1, "fine"), (2, "vague"), (3, "boom"), (4, None)], "call_id long, prompt string")
    got = {r.call_id: r for r in P.judge_provider(df, ask).collect()}
    assert json.loads(got[1].verdict) == {"met": True} and got[1].hold_reason is None
    assert got[2].hold_reason == "answer is not an object" and got[3].hold_reason == "judge failed: RuntimeError" and got[4].hold_reason == "no prompt"
    assert P.command(["cat"])("x") == "x"
    assert "courtesy" in one(spark, P.rubric_prompt(F.lit("a"), F.lit("b"), [{"id": "e", "primitive": "judge_check", "question": "courtesy?"}]))


# --- sources and streams -----------------------------------------------------------------------------------------


def test_landing(spark, tmp_path):
    for name, data in (("a.wav", b"1"), ("b.mp3", b"1"), ("c.wav", b"2"), ("d.txt", b"3")):
        (tmp_path / name).write_bytes(data)
    files = L.landing(spark, str(tmp_path))
    assert files.count() == 3
    seeded = files.filter(F.col("path").endswith("c.wav")).select(F.sha2("content", 256).alias("sha256"))
    assert [r.path[-5:] for r in L.seed_plan(files, seeded).collect()] == ["a.wav"]
    runs = spark.createDataFrame([(1, False, "x", "d"), (2, True, "x", "d"), (3, False, "", "d"), (4, None, None, "d")], "run_id long, held boolean, compliant_path string, run_date string")
    assert [r.run_id for r in L.retire_candidates(runs).collect()] == [1] and {r.outcome: r.runs for r in L.retire_counts(runs).collect()} == {"retired": 1, "kept": 3}
    L.save_runs(runs, str(tmp_path / "runs"))
    assert L.load_runs(spark, str(tmp_path / "runs")).count() == 4


def test_read_transcripts(spark, tmp_path):
    (tmp_path / "a.words.json").write_text(json.dumps({"segments": [{"start": 0, "end": 2, "words": [{"word": " hi", "start": 0.1, "end": 0.4, "probability": 0.9}, {"word": " you", "start": 0.5, "end": 0.8}]}]}))
    rows = L.read_transcripts(spark, str(tmp_path)).orderBy("word_ix").collect()
    assert [(r.word, r.seg_end, r.probability) for r in rows] == [(" hi", 2.0, 0.9), (" you", 2.0, None)]


def test_streams_equal_batches(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    batch = events.withColumn("ts", F.col("ts").cast("timestamp"))
    for k, make in enumerate((live.windowed_counts, live.sessions)):
        stream = make(live.read_events(spark, str(tmp_path / "in")))
        q = stream.writeStream.outputMode("append" if k else "complete").format("memory").queryName(f"out{k}").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / f"c{k}")).start()
        q.awaitTermination()
        rounded = lambda df: df.select(*(F.round(c, 6).alias(c) if t == "double" else c for c, t in df.dtypes)).collect()
        got, want = rounded(spark.table(f"out{k}")), rounded(make(batch))
        assert set(map(str, got)) <= set(map(str, want)) and len(got) > 0.9 * len(want)
    q = live.score_landing(live.read_events(spark, str(tmp_path / "in")), lambda b: b.groupBy("event_type").count(), str(tmp_path / "out"), str(tmp_path / "c9"))
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).agg(F.sum("count")).first()[0] == 1000


def test_entry_without_the_training_data_operators(tmp_path):
    """The entry file imports, and its other queries are there, if the llm folders are gone."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    repo = Path(__file__).resolve().parent.parent
    shutil.copytree(repo / "convoscore", tmp_path / "convoscore", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(repo / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 50 and not any(n.startswith('op') and n[2].isdigit() for n in q) and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
    assert pd is not None
