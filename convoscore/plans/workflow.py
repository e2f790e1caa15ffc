"""Workflows: phases with dependencies over a context of DataFrames.

A phase is a function (spark, context, settings) -> dict of DataFrames; holds and skips are values of rows (run_status,
hold_reason), so one bad call never stops a batch.  Order is topological, by dependency and then by place in the file;
failed phases are tried again up to max_attempts, a HOLD (a precondition of the whole batch) never is.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import calls as C
from ..operators import report as R
from ..operators.rubric import rollup, run_rubric
from .config import ConfigError, Profile

FOLDER = Path(__file__).parent / "workflows"
_OWN = ("id", "name", "type", "depends_on", "subscribes_to")


class Hold(Exception):
    """A phase can't run for want of something that a retry won't bring."""


@dataclass(frozen=True)
class Phase:
    id: str
    type: str
    depends_on: tuple[str, ...] = ()
    config: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Workflow:
    name: str
    phases: tuple[Phase, ...]

    @staticmethod
    def of(raw: dict) -> Workflow:
        phases = tuple(Phase(str(p["id"]), str(p["type"]), tuple(p.get("depends_on", ())), {k: v for k, v in p.items() if k not in _OWN}) for p in raw.get("phases", []))
        return Workflow(str(raw["name"]), phases)

    def ordered(self) -> list[Phase]:
        """Every phase after those it depends on; otherwise in the given order.  Unknown or circular dependencies raise."""
        known = {p.id for p in self.phases}
        if len(known) != len(self.phases):
            raise ConfigError(f"{self.name}: two phases have one id")
        for p in self.phases:
            if lost := set(p.depends_on) - known:
                raise ConfigError(f"{p.id}: depends on unknown {sorted(lost)}")
        left, done, out = list(self.phases), set(), []
        while left:
            ready = next((p for p in left if set(p.depends_on) <= done), None)
            if ready is None:
                raise ConfigError(f"{self.name}: dependencies run in a circle")
            left.remove(ready)
            done.add(ready.id)
            out.append(ready)
        return out


def load_workflow(name: str, folder: Path = FOLDER) -> Workflow:
    try:
        return Workflow.of(json.loads((folder / f"{name}.json").read_text("utf-8")))
    except (OSError, ValueError, KeyError) as e:
        raise ConfigError(f"workflow {name}: {e}") from e


def list_workflows(folder: Path = FOLDER) -> list[str]:
    return sorted(p.stem for p in folder.glob("*.json"))


@dataclass
class PhaseState:
    phase_id: str
    status: str = "pending"
    output: str = ""
    error: str | None = None
    attempts: int = 0


@dataclass
class Run:
    workflow: str
    status: str = "running"
    phases: dict[str, PhaseState] = field(default_factory=dict)
    context: dict[str, Any] = field(default_factory=dict)

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(self.workflow, self.status, p.phase_id, p.status, p.output, p.error, p.attempts) for p in self.phases.values()]
        return spark.createDataFrame(rows, "workflow string, run_status string, phase_id string, status string, output string, error string, attempts int")


PhaseFn = Callable[[SparkSession, dict, dict], dict]
PHASES: dict[str, PhaseFn] = {}


def phase(name: str):
    def keep(f: PhaseFn) -> PhaseFn:
        PHASES[name] = f
        return f

    return keep


def execute(spark: SparkSession, workflow: Workflow, context: dict[str, Any], pause: float = 0.0) -> Run:
    """Runs the phases in order.  A HOLD blocks the run, an error fails it after its last attempt."""
    run = Run(workflow.name, context=dict(context))
    for p in workflow.ordered():
        state = run.phases[p.id] = PhaseState(p.id, "running")
        most = max(1, int(p.config.get("max_attempts", 1)))
        while True:
            state.attempts += 1
            try:
                if p.type not in PHASES:
                    raise ConfigError(f"unknown phase type {p.type}")
                made = PHASES[p.type](spark, run.context, p.config.get(p.type) or {})
                run.context.update(made)
                state.status, state.output = "completed", ",".join(sorted(made))
                break
            except Hold as e:
                state.status, state.error, run.status = "blocked", str(e), "blocked"
                return run
            except Exception as e:  # noqa: BLE001 - any failure of a phase is the run's
                state.error = str(e)
                if state.attempts >= most:
                    state.status, run.status = "failed", "failed"
                    return run
                time.sleep(pause)
    run.status = "completed"
    return run


def _profile(context: dict) -> Profile:
    if not isinstance(context.get("profile"), Profile):
        raise Hold("no profile")
    return context["profile"]


@phase("noop")
def _noop(spark, context, settings):
    return {}


@phase("audio_ingest")
def _ingest(spark, context, settings):
    """Gates on recording metadata: calls get run_status and hold_reason."""
    return {"gated": C.gates(context["calls"], context["recordings"], settings.get("min_mean_word_probability", 0.3))}


@phase("audio_redaction")
def _redact(spark, context, settings):
    if "language" not in context:
        raise Hold("no language pack")
    if settings.get("require_ner") and not context.get("entities"):
        raise Hold("entity models are absent")
    part = lambda c: F.struct(F.lit(c).alias("channel"), F.filter("words", lambda w: w["channel"] == c).alias("words"))
    rows = context["gated"].filter("run_status = 'completed'").select("call_id", F.inline(F.array(part("left"), part("right"))))
    return {"redaction_map": C.redact_calls(rows, context["language"], entities=context.get("entities"))}


@phase("transcription")
def _transcribe(spark, context, settings):
    """Word rows of the calls that go on (a speech provider would make them from masked audio)."""
    return {"words": context["gated"].filter("run_status = 'completed'").select("call_id", F.inline("words"))}


@phase("prosody")
def _prosody(spark, context, settings):
    turns = C.turn_prosody(context["words"], context.get("redaction_map"), context.get("frames"))
    return {"turns": turns, "gated": C.prosody_gate(context["gated"], turns)}


@phase("call_path_classify")
def _classify(spark, context, settings):
    profile = _profile(context)
    keywords = [k for d in profile.contract["categories_detail"] for k in d["keywords"]]
    return {"roles": C.channel_roles(C.channel_rows(context["gated"]), keywords)}


@phase("phase_ledger")
def _evaluate(spark, context, settings):
    profile = _profile(context)
    calls = context["prepared"].join(context["gated"].select("call_id", "run_status", "hold_reason"), "call_id")
    if settings.get("execution_mode", "deterministic") != "command":
        calls = calls.withColumn("judge", F.lit(None).cast(calls.schema["judge"].dataType)) if "judge" in calls.columns else calls
    checklist = run_rubric(calls.filter("run_status = 'completed'"), profile.rubric, profile.mandated_regions)
    rows = R.report_rows(checklist, profile.scorecard_presentation)
    header = R.report_header(calls, checklist)
    return {"checklist": checklist, "rollup": rollup(checklist), "report_rows": rows, "report_header": header, "report_summary": R.report_summary(checklist, profile.scorecard_presentation)}
