"""Configuration: TOML files, presets, the switches of a repository's scope."""

from __future__ import annotations

import re
import tomllib
from dataclasses import dataclass, field
from datetime import timedelta

#: The switches of a scope, those that need another, and the presets.
SWITCHES = (
    "issues pull_requests issue_comments pull_request_comments pull_request_review_comments labels milestones issue_types fields relationships projects"
).split()
NEEDS = {
    "issue_comments": "issues", "pull_request_comments": "pull_requests", "pull_request_review_comments": "pull_requests", "fields": "issues",
    "issue_types": "issues", "relationships": "issues",
}
PRESETS = {
    "all": SWITCHES,
    "issues": "issues issue_comments labels milestones issue_types fields relationships projects".split(),
    "pull_requests": "pull_requests pull_request_comments pull_request_review_comments".split(),
}
#: What is collected of a repository without options; the last three only where fields or projects are asked for.
DEFAULT = "issues pull_requests issue_comments pull_request_comments labels milestones relationships".split()
_NAME = re.compile(r"[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+")
_TIME = re.compile(r"(\d+(?:\.\d+)?)(h|ms|m|s)")
_UNITS = {"h": "hours", "m": "minutes", "s": "seconds", "ms": "milliseconds"}


def repository(name: str) -> str:
    if not _NAME.fullmatch(name) or {".", ".."} & set(name.split("/")):
        raise ValueError(f"a repository is owner/name: {name!r}")
    return name


def duration(text: str) -> timedelta:
    """Such as 1h30m; nothing else may stand in it."""
    parts = _TIME.findall(text)
    if not parts or "".join(a + b for a, b in parts) != text:
        raise ValueError(f"a duration is like 5m or 1h30m: {text!r}")
    return timedelta(**{k: sum(float(a) for a, b in parts if _UNITS[b] == k) for k in _UNITS.values()})


def default_scope(fields: bool = False, projects: bool = False) -> dict[str, bool]:
    """The switches of a repository that has no options of its own."""
    asked = {"issue_types": fields, "fields": fields, "projects": projects}
    return {s: s in DEFAULT or asked.get(s, False) for s in SWITCHES}


def scope(preset: str = "all", **switches: bool) -> dict[str, bool]:
    """All switches of a repository: a preset's, then those given; what needs a switch that is off is off."""
    if preset not in PRESETS or set(switches) - set(SWITCHES):
        raise ValueError(f"presets are {', '.join(PRESETS)}; switches are {', '.join(SWITCHES)}")
    out = {s: s in PRESETS[preset] for s in SWITCHES} | switches
    return {s: on and out.get(NEEDS.get(s, s), True) for s, on in out.items()}


def kept_by(options: dict[str, bool], kind: str, review: bool | None = None) -> bool:
    """Whether a ticket of ``kind`` is kept; with ``review`` one of its comments."""
    if review is None:
        return options["issues" if kind == "issue" else "pull_requests"]
    return options["pull_request_review_comments" if review else f"{kind}_comments"]


@dataclass
class Config:
    repositories: list[str]
    root: str
    preset: str = "all"
    scopes: dict[str, dict[str, bool]] = field(default_factory=dict)
    overlap: timedelta = timedelta(minutes=5)
    reconcile: timedelta = timedelta(hours=24)
    enrich: timedelta = timedelta(hours=1)
    workers: int = 4


def load(text: str) -> Config:
    """A configuration of TOML; a key that isn't known fails."""
    raw = tomllib.loads(text)
    known = {"repositories", "root", "preset", "overlap", "reconcile", "enrich", "workers", "scope"}
    if unknown := set(raw) - known:
        raise ValueError(f"unknown keys: {', '.join(sorted(unknown))}")
    names = [repository(r) for r in raw.get("repositories", [])]
    if not names or not raw.get("root"):
        raise ValueError("repositories and root are needed")
    own = raw.get("scope", {})
    if unknown := set(own) - set(names):
        raise ValueError(f"scopes of other repositories: {', '.join(sorted(unknown))}")
    scopes = {r: scope(**({"preset": raw.get("preset", "all")} | own.get(r, {}))) for r in names}
    times = {k: duration(raw[k]) for k in ("overlap", "reconcile", "enrich") if k in raw}
    workers = raw.get("workers", 4)
    if not 1 <= workers <= 16:
        raise ValueError("workers are 1 to 16")
    return Config(names, raw["root"], raw.get("preset", "all"), scopes, workers=workers, **times)
