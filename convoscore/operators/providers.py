"""Providers: speech, entities and judges are functions on Arrow batches; models load once a worker process.

No model comes with the engine.  A failure concerns its row: after the last attempt the row carries a reason and is held.
"""

from __future__ import annotations

import json
import subprocess
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import parse_json_object

SPANS = "array<struct<start:int,end:int,category:string>>"


def text_windows(text: Column, size: int = 600, overlap: int = 150) -> Column:
    """ARRAY<STRUCT<start, part>> of windows of at most ``size`` characters, for models with a bounded input.

    Windows begin on a grid.  One that is not the last gives up its last word, which may be cut, if a space is among its
    last ``overlap`` characters; the grid is so narrow that it still shares ``overlap`` characters with the next one."""
    step = size - 2 * overlap
    if step < 1:
        raise ValueError("a window must be longer than two overlaps")
    text = F.coalesce(text, F.lit(""))
    more = F.greatest(F.lit(0), F.ceil((F.length(text) - size) / step)).cast("int")

    def window(k: Column) -> Column:
        whole = F.substring(text, k * step + 1, F.lit(size))
        word = F.instr(F.reverse(F.substring(whole, F.lit(size - overlap + 1), F.lit(overlap))), " ")
        return F.struct((k * step).alias("start"), F.when(k < more, F.substring(whole, F.lit(1), size - word)).otherwise(whole).alias("part"))

    return F.transform(F.sequence(F.lit(0), more), window)


def entity_provider(load: Callable[[], Callable[[str], list[tuple[int, int, str]]]], size: int = 600, overlap: int = 150) -> Callable[[Column], Column]:
    """A recogniser as a Column function: ``load`` makes the model once a worker; spans of windows shift back to the text."""

    def recognise(text: Column) -> Column:
        @F.pandas_udf(SPANS)
        def spans(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model = load()
            for rows in batches:
                found = ({(w["start"] + a, w["start"] + b, c) for w in windows for a, b, c in model(w["part"])} for windows in rows)
                yield pd.Series([[{"start": a, "end": b, "category": c} for a, b, c in sorted(x)] for x in found])

        return spans(text_windows(text, size, overlap))

    return recognise


def too_long(prompt: Column, context_tokens: int, share: float = 0.9, characters: float = 3.5) -> Column:
    """Whether a prompt may not fit a model's context: a model would cut it silently."""
    return F.length(prompt) / characters > context_tokens * share


def judge_provider(rows: DataFrame, ask: Callable[[str], str], prompt_col: str = "prompt", key: str = "call_id", attempts: int = 3, context_tokens: int | None = None) -> DataFrame:
    """verdicts(key, raw, verdict JSON, hold_reason): one question a call, tried again on errors; an answer without a JSON
    object holds the call, and so does a prompt that is too long for ``context_tokens``, which is not asked."""
    kind = dict(rows.dtypes)[key]

    def answer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            raw, reasons = [], []
            for prompt in pdf["__prompt"]:
                said, why = None, "no prompt"
                for _ in range(attempts if prompt else 0):
                    try:
                        said, why = ask(prompt), None
                        break
                    except Exception as e:  # noqa: BLE001 - a provider may fail in any way
                        why = f"judge failed: {type(e).__name__}"
                raw.append(said)
                reasons.append(why)
            yield pd.DataFrame({key: pdf[key], "long": pdf["long"], "raw": raw, "failed": reasons})

    long = F.coalesce(too_long(F.col(prompt_col), context_tokens), F.lit(False)) if context_tokens else F.lit(False)
    asked = rows.select(key, long.alias("long"), F.when(~long, F.col(prompt_col)).alias("__prompt"))
    said = asked.mapInPandas(answer, f"{key} {kind}, long boolean, raw string, failed string")
    verdict = parse_json_object(F.col("raw"))
    return said.select(key, "raw", verdict.alias("verdict"), F.when(F.col("long"), "prompt is too long for the judge").otherwise(F.coalesce("failed", F.when(verdict.isNull(), "answer is not an object"))).alias("hold_reason"))


def judge_call(calls: DataFrame, entries: list[dict], ask: Callable[[str], str], attempts: int = 3, context_tokens: int | None = 16384) -> DataFrame:
    """verdicts of calls (call_id, agent_text, customer_text[, prosody]): one prompt out of the rubric's entries a call.
    Nothing is scored here; checks read the verdict."""
    prosody = F.col("prosody") if "prosody" in calls.columns else None
    prompts = calls.select("call_id", rubric_prompt(F.col("agent_text"), F.col("customer_text"), entries, prosody).alias("prompt"))
    return judge_provider(prompts, ask, attempts=attempts, context_tokens=context_tokens)


def exact_evidence(evidence: Column, text: Column) -> Column:
    """A judge's quote as the text has it, whatever its case; null if the text lacks it.  No quote is ever made up."""
    q = F.trim(F.coalesce(evidence, F.lit("")))
    at = F.instr(F.lower(text), F.lower(q))
    return F.when((q != "") & F.contains(text, q), q).when((q != "") & (at > 0), F.substring(text, at, F.length(q)))


def command(argv: list[str], timeout: float = 180.0) -> Callable[[str], str]:
    """A judge behind a program: the prompt on its standard input, the answer on its standard output."""

    def ask(prompt: str) -> str:
        return subprocess.run(argv, input=prompt, capture_output=True, text=True, timeout=timeout, check=True).stdout

    return ask


def rubric_prompt(agent: Column, customer: Column, entries: list[dict], prosody: Column | None = None) -> Column:
    """One prompt a call for all entries that need a judge."""
    asked = [e for e in entries if e.get("primitive") in ("judge_check", "deal_detect", "path_select") or e.get("question")]
    shape = {"checks": {e["id"]: {"met": True, "evidence": "", "customer_evidence": "", "detail": ""} for e in asked}, "deal": {"happened": True, "consent": True, "refusal": False, "accept_quote": "", "delivery_quote": ""}, "path": {"is_titular": True, "decision_maker": True, "service": ""}}
    task = "Answer with one JSON object of this shape, quoting the transcript word for word:\n" + json.dumps(shape) + "\nQuestions:\n" + "\n".join(f"- {e['id']}: {e.get('question', e['id'])}" for e in asked)
    return F.concat_ws("\n", F.lit(task), F.lit("## AGENT"), agent, F.lit("## CUSTOMER"), customer, *([F.lit("## DELIVERY"), prosody] if prosody is not None else []))
