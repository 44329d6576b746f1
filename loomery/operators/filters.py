"""The shared filter compiler: options to one Column of typed predicates, all of them joined by AND."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from datetime import datetime, timedelta, timezone
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .records import has_value

_REPO = re.compile(r"^[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+$")
#: Units of ages, in hours, and the largest number of one.
AGES, MOST_AGE = {"h": 1, "d": 24, "w": 168}, 999_999
COMPOUND_LIMIT = 100
REPOSITORY_LIMIT = 100


def date_bound(value: str, before: bool, now: datetime) -> tuple[int, bool]:
    """Epoch second and whether it is inclusive. A plain date covers its UTC day; ``7d`` counts back from ``now``."""
    number, unit = value[:-1], value[-1:]
    if unit in AGES and number.isascii() and number.isdigit() and number[0] != "0" and int(number) <= MOST_AGE:
        return int((now - timedelta(hours=int(number) * AGES[unit])).timestamp()), True
    if re.fullmatch(r"\d{4}-\d{2}-\d{2}", value):
        day = datetime.fromisoformat(value).replace(tzinfo=timezone.utc)
        return int((day + timedelta(days=1 if before else 0)).timestamp()), not before
    when = datetime.fromisoformat(value.replace("Z", "+00:00"))
    if when.tzinfo is None:
        raise ValueError(f"a time needs an offset: {value}")
    return int(when.timestamp()), True


@dataclass
class Filters:
    repo: str | None = None
    repositories: list[str] = field(default_factory=list)
    state: str | None = None
    kind: str | None = None
    type: str | None = None
    author: str | None = None
    labels_all: list[str] = field(default_factory=list)
    labels_any: list[str] = field(default_factory=list)
    exclude_labels: list[str] = field(default_factory=list)
    assignees: list[str] = field(default_factory=list)
    milestone: str | None = None
    created_after: str | None = None
    created_before: str | None = None
    updated_after: str | None = None
    updated_before: str | None = None
    field_values: dict[str, str] = field(default_factory=dict)
    field_options: bool = False  # whether values also come as names of options, as of ``records.normalized_values``
    project: tuple[str, int] | None = None
    exclude: tuple[str, int] | None = None
    now: datetime | None = None

    def validate(self) -> None:
        if self.state not in (None, "open", "closed") or self.kind not in (None, "issue", "pull_request"):
            raise ValueError("state is open or closed, kind is issue or pull_request")
        names = [*self.repositories, *([self.repo] if self.repo else [])]
        if len(self.repositories) > REPOSITORY_LIMIT or any(not _REPO.match(r) or {".", ".."} & set(r.split("/")) for r in names):
            raise ValueError("repositories are at most 100 owner/name pairs")
        if len(self.labels_all) + len(self.labels_any) + len(self.exclude_labels) + len(self.assignees) + len(self.field_values) > COMPOUND_LIMIT:
            raise ValueError(f"at most {COMPOUND_LIMIT} compound filters")

    def column(self) -> Column:
        self.validate()
        out = [F.lit(True)]
        for name in ("repo", "state", "kind", "type", "author"):
            if (value := getattr(self, name)) is not None:
                out.append(F.col(name) == value)
        strings = lambda xs: F.array(*(F.lit(x) for x in xs))
        labels = F.coalesce(F.col("labels"), F.array().cast("array<string>"))
        if self.repositories:
            out.append(F.col("repo").isin(self.repositories))
        out += [F.array_contains(labels, x) for x in self.labels_all]
        out += [F.arrays_overlap(labels, strings(self.labels_any))] if self.labels_any else []
        out += [~F.array_contains(labels, x) for x in self.exclude_labels]
        out += [F.arrays_overlap("assignees", strings(self.assignees))] if self.assignees else []
        if self.milestone is not None:
            out.append((F.col("milestone_title") == self.milestone) | (F.col("milestone_number") == self.milestone))
        now = self.now or datetime.now(timezone.utc)
        for name in ("created", "updated"):
            low, high = getattr(self, f"{name}_after"), getattr(self, f"{name}_before")
            at, (a, _), (b, closed) = F.col(f"{name}_s"), date_bound(low, False, now) if low else (None, True), date_bound(high, True, now) if high else (None, True)
            if a is not None and b is not None and (a > b or a == b and not closed):
                raise ValueError(f"{name}_after is later than {name}_before")
            out += [at >= a] if a is not None else []
            out += [(at <= b) if closed else (at < b)] if b is not None else []
        has = lambda name, value: lambda f: (f["name"] == name) & (f["value"] == value)
        for name, value in self.field_values.items():
            out.append(has_value(F.col("field_values"), name, value) if self.field_options else F.exists("field_values", has(name, value)))
        if self.project:
            tails = [f"/{who}/{self.project[0]}/projects/{self.project[1]}" for who in ("orgs", "users")]
            out.append(F.exists("project_urls", lambda u: u.endswith(tails[0]) | u.endswith(tails[1])))
        if self.exclude:
            out.append(~((F.col("repo") == self.exclude[0]) & (F.col("number") == self.exclude[1])))
        return reduce(lambda a, b: a & b, out)
