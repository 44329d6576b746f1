"""Status: counts, age, coverage warnings and checks of a generation."""

from __future__ import annotations

import shutil
import time
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import SCHEMA_VERSION, Store

ENRICHMENT = timedelta(hours=24)


def age(manifest: dict, now: float | None = None) -> float:
    """Seconds since the collection began that the generation holds."""
    return (time.time() if now is None else now) - manifest["metadata"].get("collected_at", manifest["committed_at"])


def compact(status: dict) -> dict:
    """What agents need of a status."""
    return {k: status[k] for k in ("generation", "collected_at", "repositories", "tickets", "indexed", "pending") if k in status}


def warning(code: str, repo: str, resource: str) -> dict:
    return {"code": code, "repo": repo, "resource": resource}


def _switch(options: dict[str, bool] | None, resource: str, kind: str | None) -> bool:
    """Whether a repository collects a resource; without options all but reviews."""
    if options is None:
        return resource != "reviews"
    names = {"comments": ["issue_comments", "pull_request_comments"], "reviews": ["pull_request_review_comments"]}.get(resource, [resource])
    if resource == "comments" and kind:
        names = [f"{kind}_comments"]
    return any(options.get(n, False) for n in names)


def warnings(metadata: dict, repo: str | None = None, repositories: list[str] = (), kind: str | None = None, project: bool = False, fields: bool = False, scopes: list[str] = (), now: datetime | None = None, oldest: timedelta = ENRICHMENT) -> list[dict]:
    """What the generation can't answer for: repositories it lacks, resources that are off, and stale enrichment.

    ``metadata``: repositories; options (repo: switches, or None where they can't be read); coverage (repo: reconciled_at, fields, projects).
    """
    now, mine = now or datetime.now(timezone.utc), metadata.get("repositories", [])
    asked = [*repositories, *([repo] if repo else [])]
    out = [warning("repository_not_collected", r, "repository") for r in asked if r not in mine]
    wanted = [n for n, on in (("projects", project), ("fields", fields), ("comments", "comments" in scopes), ("reviews", "reviews" in scopes)) if on]
    for r in mine:
        if asked and r not in asked:
            continue
        options, covered = metadata.get("options", {}).get(r, {}), metadata.get("coverage", {}).get(r, {})
        if options is None:
            out.append(warning("coverage_unknown", r, "scope"))
            continue
        options = options or None
        for n in wanted:
            if not _switch(options, n, kind) or covered.get(n) == "disabled":
                out.append(warning("resource_disabled", r, n))
            elif n in ("projects", "fields"):
                at = covered.get("reconciled_at")
                if not at or now - datetime.fromisoformat(at.replace("Z", "+00:00")) > oldest:
                    out.append(warning("enrichment_stale", r, n))
        plural = {"issue": "issues", "pull_request": "pull_requests"}.get(kind or "")
        if plural and options is not None and not options.get(plural, False):
            out.append(warning("resource_disabled", r, plural))
    return out


def checks(store: Store, oldest: float = 86400.0, free: int = 1 << 30) -> list[tuple[str, bool, str]]:
    """(check, passed, what was found), in the order in which a reader would mend them."""
    try:
        found = store.manifest()
    except ValueError as why:
        return [("schema", False, str(why))]
    if not found:
        return [("generation", False, "none yet")]
    out = [("schema", found["schema_version"] == SCHEMA_VERSION, str(found["schema_version"])), ("generation", True, found["generation"])]
    out.append(("age", age(found) <= oldest, f"{age(found):.0f} s"))
    missing = [n for n in ("tickets", "comments", "documents") if n not in found["tables"]]
    out.append(("tables", not missing, ", ".join(missing) or "all there"))
    if store.root.startswith(("file:", "/")):
        left = shutil.disk_usage(store.root.removeprefix("file://").removeprefix("file:")).free
        out.append(("disk", left >= free, f"{left >> 20} MB free"))
    return out


def counts(tickets: DataFrame, comments: DataFrame, documents: DataFrame) -> DataFrame:
    """One row; each table is read once."""
    t = tickets.agg(F.count_if(F.col("kind") == "issue").alias("issues"), F.count_if(F.col("kind") != "issue").alias("pulls"))
    hidden = F.count_if(~F.col("visible")) if "visible" in comments.columns else F.lit(0).cast("long")
    return t.crossJoin(comments.agg(F.count("*").alias("comments"), hidden.alias("excluded"))).crossJoin(documents.agg(F.count("*").alias("documents")))  # single rows
