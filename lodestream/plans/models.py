"""Calls of a language model that answers in JSON, and the router on top of one. Models stay behind a protocol."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

#: Takes model, system text and user text; returns the answer's text and what was used (tokens, cost), or raises.
Call = Callable[[str, str, str], tuple[str, Mapping[str, Any]]]
ROUTES = ("policy", "data", "mixed", "out_of_scope")
LANGUAGES = ("en", "hi", "hinglish")


class Busy(Exception):
    """The model may answer a little later."""


class Spent(Exception):
    """The model won't answer today any more."""


class Unavailable(RuntimeError):
    """No model answered."""


@dataclass
class Usage:
    model: str | None = None
    seconds: float = 0.0
    calls: int = 0
    fallback: str | None = None
    used: dict[str, Any] = field(default_factory=dict)


def ask_json(call: Call, models: Sequence[str | None], system: str, user: str, tries: int = 4, wait: float = 3.0, sleep: Callable[[float], None] = time.sleep) -> tuple[dict, Usage]:
    """The first model's answer as a dictionary, and what it took.

    A busy model is asked up to ``tries`` times, waiting 3, 6, 12 ... seconds between; one whose day is spent is left at
    once for the next. Any other error is the caller's. ValueError if the answer is no JSON object.
    """
    began, usage = time.monotonic(), Usage()
    for model in filter(None, models):
        for n in range(tries):
            usage.calls += 1
            try:
                text, used = call(model, system, user)
            except Spent:
                break
            except Busy:
                if n + 1 < tries:
                    sleep(wait * 2**n)
                continue
            usage.model, usage.used, usage.seconds = model, dict(used), time.monotonic() - began
            try:
                found = json.loads(text or "{}")
            except json.JSONDecodeError as e:
                raise ValueError(f"{model} answered with something else than JSON: {text[:80]!r}") from e
            if not isinstance(found, dict):
                raise ValueError(f"{model} answered with a {type(found).__name__}, not an object")
            return found, usage
    raise Unavailable(f"no model answered: {', '.join(m for m in models if m)}")


ROUTER = """Sort a question for an assistant that knows policy documents on air quality and a table of daily index values.
Answer with a JSON object: "route" (policy: rules and plans; data: something to compute from values; mixed: both;
out_of_scope: neither), "language" (en, hi, hinglish), "cities" (a list of names), "time_range" (YYYY-MM-DD/YYYY-MM-DD or
null), "policy_subquery" and "data_subquery" (what to look up and what to compute, or null)."""


def _iso(value: Any) -> str | None:
    import re

    return value if isinstance(value, str) and re.fullmatch(r"\d{4}-\d{2}-\d{2}/\d{4}-\d{2}-\d{2}", value) else None


def read_route(found: Mapping[str, Any]) -> dict:
    """A model's route in the form of the rules' one; ValueError where it is none. A malformed time range is no range."""
    if found.get("route") not in ROUTES or found.get("language") not in LANGUAGES:
        raise ValueError("no such route or language")
    cities = found.get("cities") or []
    if not isinstance(cities, list) or not all(isinstance(c, str) for c in cities):
        raise ValueError("cities must be a list of names")
    text = lambda k: found.get(k) if isinstance(found.get(k), str) else None
    return {"route": found["route"], "language": found["language"], "cities": cities, "time_range": _iso(found.get("time_range")), "policy_subquery": text("policy_subquery"), "data_subquery": text("data_subquery")}


def route_by_model(question: str, call: Call, models: Sequence[str | None], rules: Callable[[str], Mapping], **how) -> tuple[dict, Usage]:
    """The model's route; the rules' one where its answer makes no sense, as ``usage.fallback`` says."""
    usage = Usage()
    try:
        found, usage = ask_json(call, models, ROUTER, question, **how)
        return read_route(found), usage
    except ValueError:
        usage.fallback = "rules"
        return dict(rules(question)), usage
