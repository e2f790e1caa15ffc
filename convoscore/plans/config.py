"""Profiles and language packs: JSON files, checked before anything runs; whatever is wrong raises ConfigError."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import Path

from ..operators.checks import PRIMITIVES

VERSION = 1
HERE = Path(__file__).parent / "profiles"


class ConfigError(ValueError):
    pass


@dataclass(frozen=True)
class Profile:
    client_key: str
    language: str
    agent_markers: list[str]
    offer_category_id: str
    contract: dict
    rubric: list[dict] = field(default_factory=list)
    mandated_regions: tuple[str, ...] = ()
    call_path: str | None = None
    stt_prompt: str | None = None
    call_paths: list = field(default_factory=list)
    service_branches: dict = field(default_factory=dict)
    legal_variants: list = field(default_factory=list)
    scorecard_presentation: dict = field(default_factory=dict)


def _read(path: Path) -> dict:
    try:
        raw = json.loads(path.read_text("utf-8"))
    except (OSError, ValueError) as e:
        raise ConfigError(f"{path}: {e}") from e
    if not isinstance(raw, dict) or raw.get("schema_version") != VERSION:
        raise ConfigError(f"{path}: an object with schema_version {VERSION} is needed")
    return raw


def _need(raw: dict, where: str, **kinds: type) -> None:
    for key, kind in kinds.items():
        if key not in raw:
            raise ConfigError(f"{where}: {key} is missing")
        if not isinstance(raw[key], kind):
            raise ConfigError(f"{where}: {key} must be {kind.__name__}")


def check_contract(contract: dict) -> None:
    _need(contract, "contract", contract_key=str, id_prefix=str, categories_detail=list)
    for d in contract["categories_detail"]:
        if not isinstance(d, dict):
            raise ConfigError("contract: categories_detail must hold objects")
        _need(d, "category", category=str, keywords=list)


def check_rubric(rubric: object, strict: bool = False) -> list[dict]:
    """Every entry needs id, primitive and a tier of hard or soft; ids differ.  Strict: primitives are known, paths too."""
    if not isinstance(rubric, list):
        raise ConfigError("rubric must be a list")
    seen: set[str] = set()
    for e in rubric:
        if not isinstance(e, dict) or not all(e.get(k) for k in ("id", "primitive", "tier")):
            raise ConfigError(f"rubric entry without id, primitive or tier: {e!r}")
        if e["tier"] not in ("hard", "soft"):
            raise ConfigError(f"{e['id']}: tier must be hard or soft")
        if e["id"] in seen:
            raise ConfigError(f"{e['id']}: the id is used twice")
        if strict and e["primitive"] not in PRIMITIVES:
            raise ConfigError(f"{e['id']}: unknown primitive {e['primitive']}")
        seen.add(e["id"])
    return rubric


def load_profile(name: str, folder: Path = HERE, strict: bool = False) -> Profile:
    raw = _read(folder / f"{name}.json")
    _need(raw, name, client_key=str, language=str, agent_markers=list, offer_category_id=str, contract=dict)
    check_contract(raw["contract"])
    rubric = check_rubric(raw.get("rubric", []), strict)
    for key, kind in (("scorecard_presentation", dict), ("service_branches", dict), ("call_paths", list), ("legal_variants", list), ("stt_prompt", str), ("mandated_regions", list)):
        if raw.get(key) is not None and not isinstance(raw[key], kind):
            raise ConfigError(f"{name}: {key} must be {kind.__name__}")
    if strict and not rubric:
        raise ConfigError(f"{name}: the rubric is empty")
    return Profile(
        raw["client_key"], raw["language"], [str(m) for m in raw["agent_markers"]], raw["offer_category_id"], raw["contract"], rubric, tuple(map(str, raw.get("mandated_regions") or ())),
        raw.get("call_path"), raw.get("stt_prompt"), raw.get("call_paths") or [], raw.get("service_branches") or {}, raw.get("legal_variants") or [], raw.get("scorecard_presentation") or {},
    )


def load_language(name: str, folder: Path = HERE) -> dict:
    raw = _read(folder / f"{name}.lang.json")
    _need(raw, name, number_words=list, number_connector=str, context_lead_ins=list, iban_prefix=str)
    return raw


def speech_prompt(*parts: str | None) -> str | None:
    """Prose for a speech model: the language's, then the profile's; None if both are empty."""
    return " ".join(p.strip() for p in parts if p and p.strip()) or None
