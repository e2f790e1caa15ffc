"""Recordings, landing table, run state, judge, server, scorecards; redaction against a plain model."""

import io
import json
import math
import random
import re
import struct
import time
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from convoscore.functions import spans as S
from convoscore.operators import calls as C
from convoscore.operators import providers as P
from convoscore.operators import report as R
from convoscore.plans import config, queries, server, workflow
from convoscore.sources import audio
from convoscore.sources import calls as A
from convoscore.sources import landing as L

SF = "/root/testdata/sf0.001"


# --- recordings --------------------------------------------------------------------------------------------------


def tone(seconds, channels, width=2, rate=800, level=0.5, same=False):
    """A file made by hand, sample by sample."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(width)
        w.setframerate(rate)
        for i in range(int(seconds * rate)):
            for c in range(channels):
                v = level * math.sin(i * (0.1 if same else 0.1 * (c + 1)))
                w.writeframes(struct.pack("<B", round(v * 128) + 128) if width == 1 else struct.pack("<q", round(v * 2 ** (8 * width - 1)))[:width])
    return out.getvalue()


@pytest.mark.parametrize("width", [1, 2, 3, 4])
def test_wav_round_trip(width):
    raw = tone(0.5, 2, width)
    rate, w, x = audio.read_wav(raw)
    assert (rate, w, x.shape) == (800, width, (400, 2)) and abs(x[:, 0] - 0.5 * np.sin(np.arange(400) * 0.1)).max() <= 2.0 ** (1 - 8 * width)
    assert audio.write_wav(rate, w, x) == raw


@pytest.fixture(scope="module")
def recordings(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("wav")
    made = {"stereo": tone(10, 2), "dual": tone(10, 2, same=True), "mono": tone(9, 1), "three": tone(9, 3), "short": tone(1, 1), "silent": tone(9, 1, level=0.0), "faint": tone(9, 1, width=3, level=0.001), "broken": b"RIFF"}
    for name, raw in made.items():
        (at / f"{name}.wav").write_bytes(raw)
    return L.landing(spark, str(at)).withColumn("path", F.regexp_extract("path", r"(\w+)\.wav$", 1)), made


def test_probe_and_gates(spark, recordings):
    files, _ = recordings
    probed = audio.probe(files)
    got = {r.path: r for r in probed.collect()}
    assert (got["stereo"].channels, got["stereo"].duration_seconds) == (2, 10.0) and got["three"].channels == 3
    assert got["mono"].mean_volume_db == pytest.approx(20 * math.log10(0.5 / 2**0.5), abs=0.1) and got["silent"].mean_volume_db == -math.inf
    assert got["broken"].channels is None and got["broken"].error
    words = spark.createDataFrame([("w", "left", 0, "hi", 0.0, 0.4, 0.9, 0.0, 0.4)], "k string, channel string, word_ix int, word string, start double, end double, probability double, seg_start double, seg_end double")
    word = words.select(F.array(F.struct("word_ix", "channel", "word", "start", "end", "probability", "seg_start", "seg_end").cast(A.WORD)).alias("words"))
    calls = files.select(F.col("path").alias("call_id")).unionByName(spark.createDataFrame([("lost",)], "call_id string")).crossJoin(word).withColumn("agent_channel", F.lit("left"))
    status = {r.call_id: (r.run_status, r.hold_reason) for r in C.gates(calls, probed.withColumnRenamed("path", "call_id")).collect()}
    assert len(status) == 9 and status["stereo"] == ("completed", None) and status["short"] == ("skipped", "too short") and status["silent"] == status["faint"] == ("skipped", "silent")
    assert status["broken"] == status["lost"] == ("skipped", "no recording")


def test_split_mask_recombine(spark, recordings):
    files, made = recordings
    tracks = {(r.path, t.channel): t.content for r in files.select("path", audio.split_channels("content").alias("t")).collect() for t in r.t or ()}
    assert {p for p, _ in tracks} == set(made) - {"broken"} and {c for p, c in tracks if p == "stereo"} == {"left", "right"} and {c for p, c in tracks if p in ("dual", "mono", "three")} == {"mono"}
    ranges = [("stereo", "left", 1.0, 2.0), ("stereo", "left", 1.5, 3.0), ("stereo", "right", 9.5, 99.0), ("mono", "mono", 0.0, 0.5)]
    got = {r.path: r for r in audio.compliant(files, spark.createDataFrame(ranges, "path string, channel string, start double, end double")).collect()}
    assert got["broken"].held and got["broken"].compliant is None and got["broken"].reason == "no compliant recording" and not got["stereo"].held
    want = audio.read_wav(made["stereo"])[2].copy()
    want[800:2400, 0] = 0
    want[7600:, 1] = 0
    assert (audio.read_wav(bytes(got["stereo"].compliant))[2] == want).all()
    mono = audio.read_wav(bytes(got["mono"].compliant))[2]
    assert not mono[:400].any() and (mono[400:] == audio.read_wav(made["mono"])[2][400:]).all()


# --- landing table and run state ---------------------------------------------------------------------------------


def test_seed_is_idempotent_and_verified(spark, tmp_path):
    files = spark.createDataFrame([("a", b"1"), ("b", b"1"), ("c", b"2")], "path string, content binary")
    at = str(tmp_path / "landing")
    assert sorted((r.path, bytes(r.content)) for r in L.seed(files, at).collect()) == [("a", b"1"), ("c", b"2")]
    assert L.seed(files, at).count() == 2
    more = spark.createDataFrame([("a", b"changed"), ("d", b"4")], "path string, content binary")
    landed = L.seed(more, at)
    assert landed.count() == 4
    now = spark.createDataFrame([("a", b"1"), ("d", b"4")], "path string, content binary")
    outcomes = [(r.path, r.outcome) for r in L.verify(now, landed).collect()]
    assert sorted(outcomes) == [("a", "mismatch"), ("a", "ok"), ("c", "no source"), ("d", "ok")]


def test_a_run_is_updated(spark, tmp_path):
    save = lambda status, run: L.save_runs(spark.createDataFrame([(run, status, "d")], "run_id string, status string, run_date string"), str(tmp_path / "runs"))
    for status, run in (("running", "x"), ("blocked", "x"), ("running", "y")):
        save(status, run)
        time.sleep(0.01)
    assert {r.run_id: r.status for r in L.load_runs(spark, str(tmp_path / "runs")).collect()} == {"x": "blocked", "y": "running"}


# --- judge, server -----------------------------------------------------------------------------------------------


def test_judge_call_guards_the_prompt(spark):
    asked = []
    calls = spark.createDataFrame([(1, "hello", "hi", "left: pace 2.0"), (2, "word " * 900, "hi", "")], "call_id long, agent_text string, customer_text string, prosody string")
    got = {r.call_id: r for r in P.judge_call(calls, [{"id": "e", "primitive": "judge_check", "question": "kind?"}], lambda prompt: json.dumps({"long": len(prompt), "delivery": "pace 2.0" in prompt}), context_tokens=500).collect()}
    assert got[1].hold_reason is None and json.loads(got[1].verdict)["delivery"] is True and not asked
    assert got[2].verdict is None and got[2].hold_reason == "prompt is too long for the judge"
    rows = spark.createDataFrame([("Well Said", "he said Well Said."), ("well said", "he said Well Said."), ("never", "he said"), (None, "x"), (" ", "x")], "e string, t string")
    assert [r.x for r in rows.select(P.exact_evidence(F.col("e"), F.col("t")).alias("x")).collect()] == ["Well Said", "Well Said", None, None, None]


def test_server(spark):
    s, out = server.Server(spark), io.StringIO()
    ask = [{"id": 1, "method": "initialize"}, {"method": "notifications/initialized"}, {"id": 2, "method": "tools/list"}, {"id": 3, "method": "tools/call", "params": {"name": "workflow.list"}}, {"id": 4, "method": "tools/call", "params": {"name": "workflow.start", "arguments": {"workflow_name": "noop"}}}, {"id": 5, "method": "tools/call", "params": {"name": "workflow.start"}}, {"id": 6, "method": "no"}, {"id": 7, "method": "tools/call", "params": {"name": "x"}}, [1]]
    s.serve(io.StringIO("\n".join([*map(json.dumps, ask), "", "{broken"])), out)
    got = [json.loads(x) for x in out.getvalue().splitlines()]
    assert [g["id"] for g in got] == [1, 2, 3, 4, 5, 6, 7, None] and got[0]["result"]["protocolVersion"] and [t["name"] for t in got[1]["result"]["tools"]] == ["workflow.list", "workflow.start"]
    text = lambda g: json.loads(g["result"]["content"][0]["text"])
    assert text(got[2])["workflows"] == workflow.list_workflows() and text(got[3])["status"] == "completed"
    assert [g["error"]["code"] for g in got[4:]] == [-32000, -32601, -32000, -32601]


# --- gates and reports -------------------------------------------------------------------------------------------


def test_calls_without_turns_are_held(spark):
    gated = spark.createDataFrame([(1, "completed", None), (2, "completed", None), (3, "skipped", "silent")], "call_id long, run_status string, hold_reason string")
    turns = spark.createDataFrame([(1, 0.0), (1, 3.0)], "call_id long, start double")
    assert {r.call_id: (r.run_status, r.hold_reason) for r in C.prosody_gate(gated, turns).collect()} == {1: ("completed", None), 2: ("blocked", "empty prosody summary"), 3: ("skipped", "silent")}


def test_scorecards_are_never_blank(spark, tmp_path):
    checklist = queries.checklist_of(spark, SF)
    calls = C.gates(A.with_recording(queries.calls_of(spark, SF)))
    rows, header = R.report_rows(checklist, queries._P), R.report_header(calls, checklist)
    cards = R.scorecard_text(queries.reports_of(spark, SF))
    got, told = {r.call_id: r.text for r in cards.collect()}, {r.call_id: r for r in header.collect()}
    assert set(got) == set(told) and {r.disposition for r in told.values()} > {"skipped"}
    lines: dict = {}
    for r in sorted(rows.collect(), key=lambda r: (r.call_id, r.section_ix, r.row_ix)):
        lines.setdefault(r.call_id, []).append(f"[{r.status_kind}] {r.section} / {r.label}" + (f" - {r.evidence[:80]}" if r.evidence else ""))
    summary = {r.call_id: r for r in R.report_summary(checklist, queries._P).collect()}
    for call_id, text in got.items():
        h, n = told[call_id], summary[call_id]
        assert text.split("\n")[0] == f"call {call_id} {h.duration_mmss} {h.disposition} {'deal' if h.deal else 'no deal'}"
        if h.disposition_reason:
            assert text.split("\n")[1:] == ["not evaluated: " + h.disposition_reason]
        else:
            assert text.split("\n")[1] == f"hard {n.hard_met}/{n.hard_total} violations {n.hard_violations} review {n.hard_review}"
            assert text.split("\n")[2:] == "\n".join(lines[call_id]).split("\n")
    coached = {r.call_id: r.coaching for r in queries.reports_of(spark, SF).collect()}
    plain: dict = {}
    for r in R.coaching(rows, header, queries._P).orderBy("line_ix").collect():
        plain.setdefault(r.call_id, []).append(r.line)
    assert {k: v for k, v in coached.items() if v is not None} == plain and {k for k, v in coached.items() if v is None} == {k for k, h in told.items() if h.disposition_reason}
    bare = R.scorecard_text(queries.reports_of(spark, SF).filter("coaching IS NOT NULL").withColumn("rows", F.slice("rows", 1, 0)))
    assert {r.text.split("\n")[1] for r in bare.collect()} == {"no criteria"}
    R.save_scorecards(cards, str(tmp_path / "cards"))
    assert sum(x.startswith("call ") for f in (tmp_path / "cards").glob("*.txt") for x in f.read_text().split("\n\n")) == len(got)


# --- redaction, long calls ---------------------------------------------------------------------------------------


def plain_ranges(words, lang, context):
    """Time ranges of one channel: recognisers by re, then words one by one."""
    text = "".join(w["word"] for w in words)
    spans = [(m.start(), m.end(), "IBAN") for m in re.finditer(rf"(?i)\b{lang['iban_prefix']}[0-9]{{2}}[A-Z0-9]{{18}}\b", text)]
    for m in re.finditer(S.DIGITS_RUN, text):
        d = re.sub("[^0-9]", "", m[0])
        luhn = sum(x if k % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for k, x in enumerate(map(int, d[::-1]))) % 10 == 0
        own = len(d) == 10 and sum(int(x) * w for x, w in zip(d, S.PERSONAL_WEIGHTS, strict=False)) % 11 % 10 == int(d[9])
        if len(d) >= 5:
            spans.append((m.start(), m.end(), "EGN" if own else "CARD" if 13 <= len(d) <= 19 and luhn else "PHONE_OR_ID" if 7 <= len(d) <= 13 else "NUMERIC_RUN"))
    run, named = [], {w.lower() for w in lang["number_words"]}
    for m in [*re.finditer(r"\d+|[^\W\d_]+", text), None]:
        if m and (m[0].isdigit() or m[0].lower() in named):
            run.append(m)
        elif not (m and run and m[0].lower() == lang["number_connector"]):
            if len(run) >= 4:
                spans.append((run[0].start(), run[-1].end(), "PHONE_OR_ID"))
            run = []
    spans += [(m.start(), m.end(), "EMAIL") for m in re.finditer(r"[\w.+\-]+@[\w\-]+\.[\w.\-]+", text)]
    for cue in lang["context_lead_ins"] if context else ():
        for m in re.finditer(re.escape(cue), text.lower()):
            end = m.end() + len(re.match(r"[^.!?\n]*", text[m.end() : m.end() + 40])[0])
            if end > m.end():
                spans.append((m.end(), end, "CONTEXT_PII"))
    ranges, pos, placed = [], 0, []
    for w in words:
        placed.append((pos, pos + len(w["word"]), w))
        pos += len(w["word"])
    for a, b, category in spans:
        hit = [w for x, y, w in placed if x < b and y > a]
        if hit:
            keys = ("seg_start", "seg_end") if category in S.NUMBER_CATEGORIES else ("start", "end")
            ranges.append((max(0.0, hit[0][keys[0]] - 0.25), max(0.0, hit[-1][keys[1]] + 0.25), category))
    out = []
    for a, b, c in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]), c if c == out[-1][2] else "MULTI")
        else:
            out.append((a, b, c))
    return out


def test_redaction_ranges_against_a_plain_model(spark):
    r, lang, rows = random.Random(7), config.load_language("demo") | {"number_words": ["one", "two"], "context_lead_ins": ["my ", "to the"], "iban_prefix": "BG"}, []
    vocab = [" my", " to", " the", " one", " two", " 3", " and", " 12345", " 0888", " 123456", " x@y.zz", " ok.", " BG80BNBG96611020345678", " 4111111111111111", "", " é", " a-b"]
    for k in range(60):
        words = [(i, "left", r.choice(vocab), 0.4 * i, 0.4 * i + 0.35, 1.0, 4.0 * (i // 10), 4.0 * (i // 10) + 3.95) for i in range(r.randrange(120))]
        rows += [(k, "left", words), (k, "right", words[::-1][: r.randrange(1 + len(words))][::-1])]
    df = spark.createDataFrame(rows, f"call_id long, channel string, words array<{A.WORD}>")
    got: dict = {}
    for x in C.redact_calls(df, lang).orderBy("map_ix").collect():
        got.setdefault((x.call_id, x.channel), []).append((round(x.start, 6), round(x.end, 6), x.category))
    names = ("word_ix", "channel", "word", "start", "end", "probability", "seg_start", "seg_end")
    categories = set()
    for call_id, channel, words in rows:
        want = [(round(a, 6), round(b, 6), c) for a, b, c in plain_ranges([dict(zip(names, w, strict=True)) for w in words], lang, channel == "right")]
        assert got.get((call_id, channel), []) == want
        categories |= {c for *_, c in want}
    assert {"MULTI", "CONTEXT_PII", "NUMERIC_RUN", "PHONE_OR_ID", "EMAIL"} <= categories
    assert set(C.redact_calls(df, lang).columns) == {"call_id", "channel", "map_ix", "start", "end", "category"}  # never a value


def test_registered_redaction_ranges(spark):
    """The registered query over its whole table, by the same plain model."""
    calls = {r.call_id: r.words for r in A.calls(spark, SF).collect()}
    got: dict = {}
    for x in queries.redaction_ranges(spark, SF).orderBy("map_ix").collect():
        got.setdefault((x.call_id, x.channel), []).append((round(x.start, 6), round(x.end, 6), x.category))
    want = {}
    for call_id, words in calls.items():
        for channel in ("left", "right"):
            own = [w.asDict() | {"word": " " + w.word} for w in words if w.channel == channel]
            if ranges := plain_ranges(own, queries.LANG, channel == "right"):
                want[call_id, channel] = [(round(a, 6), round(b, 6), c) for a, b, c in ranges]
    assert got == want


def long_call(spark, n):
    turns = [(k, "assistant" if k % 2 else "user", " ".join(f"w{k} 12345 my x@y.zz is".split() * 5)) for k in range(n // 25)]
    df = spark.createDataFrame([(1, turns)], "call_id long, turns array<struct<turn:int,role:string,text:string>>").withColumn("words", A.words_of(F.col("turns")))
    return df.withColumns({"agent_channel": F.lit("left"), "customer_channel": F.lit("right"), "agent_text": F.lit("a"), "customer_text": F.lit("b")})


def test_a_call_of_100_000_words(spark):
    """Words and dialogue take time in proportion to the words, and so do spans and their time ranges."""
    df = long_call(spark, 100_000)
    began = time.perf_counter()
    assert df.select(F.size("words")).first()[0] == 100_000 and R.dialogue(df).count() == 4000
    assert time.perf_counter() - began < 30
    took = []
    for n in (1000, 5000, 20_000):  # the first compiles code
        spaced = long_call(spark, n).select("call_id", F.lit("left").alias("channel"), F.transform("words", lambda w: w.withField("word", F.concat(F.lit(" "), w["word"]))).alias("words"))
        began = time.perf_counter()
        assert C.redact_calls(spaced, config.load_language("demo")).count() >= 1
        took.append(time.perf_counter() - began)
    assert took[2] < 4 * 2.5 * took[1]
