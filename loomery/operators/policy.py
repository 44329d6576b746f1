"""Comment policy: who counts as a machine, and which comments stay visible."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ingest import thread_roots
from .represent import detected_ai

#: Accounts of known machines (without a trailing [bot]), and account numbers on the first host.
ALIASES = {"copilot": "copilot", "copilot-pull-request-reviewer": "copilot", "coderabbitai": "coderabbit", "gemini-code-assist": "gemini", "claude": "claude"}
ACCOUNTS, ACCOUNT_HOST = {"175728472": "copilot", "198982749": "copilot"}, "github.com"


@dataclass(frozen=True)
class Policy:
    include_authors: list[str] = field(default_factory=list)
    exclude_authors: list[str] = field(default_factory=list)
    exclude_ai: bool = True
    exclude_threads: bool = True
    exclude_bots: bool = False

    def resolved(self, **given) -> Policy:
        """With a repository's own switches and lists; None inherits."""
        return replace(self, **{k: v for k, v in given.items() if v is not None})

    def validate(self) -> None:
        for names in (self.include_authors, self.exclude_authors):
            low = [n.lower() for n in names]
            if len(set(low)) < len(low) or any(not n or any(c in "*/\\" or c.isspace() or not c.isprintable() for c in n) for n in names):
                raise ValueError("a comment policy needs distinct, exact author logins")


def known_ai(author: Column, author_type: Column, account: Column | None = None, host: Column | None = None) -> Column:
    """Provider of a known machine, else null. Only accounts of type Bot count; numbers only on ACCOUNT_HOST."""
    table = lambda d: F.create_map(*(F.lit(x) for kv in d.items() for x in kv))
    name = F.element_at(table(ALIASES), F.regexp_replace(F.lower(author), r"\[bot\]$", ""))
    if account is not None and host is not None:
        name = F.coalesce(F.when(F.lower(host) == ACCOUNT_HOST, F.element_at(table(ACCOUNTS), account)), name)
    return F.when(F.lower(author_type) == "bot", name)


def _is(author: Column, names: list[str]) -> Column:
    return F.coalesce(F.lower(author).isin([n.lower() for n in names]), F.lit(False)) if names else F.lit(False)


def decided(comments: DataFrame, pulls: DataFrame, policy: Policy) -> DataFrame:
    """Adds ``reason`` (null: none), ``provider``, ``thread`` (the root that decided) and ``visible``.

    Included authors always stay; then excluded authors, known and declared machines, all bots go. A review comment
    goes with the comment its thread begins with. Only comments of pull requests are filtered.
    """
    policy.validate()
    who, kind = F.col("author"), F.col("author_type")
    account, host = (F.col(c) if c in comments.columns else F.lit(None).cast("string") for c in ("author_id", "host"))
    known = known_ai(who, kind, account, host)
    provider = F.coalesce(known, detected_ai(F.col("body")))
    reason = (
        F.when(_is(who, policy.include_authors), None)
        .when(_is(who, policy.exclude_authors), "excluded_author")
        .when(F.lit(policy.exclude_ai) & F.col("machine").isNotNull(), F.when(known.isNotNull(), "known_ai").otherwise("declared_ai"))
        .when(F.lit(policy.exclude_bots) & (F.lower(kind) == "bot"), "bot")
    )
    own = comments.withColumn("machine", provider).withColumn("why", reason)
    if policy.exclude_threads:
        reviews = comments.where(F.col("id").startswith("review:"))
        heads = own.select(F.col("id").alias("root"), F.col("why").alias("root_why"), F.col("machine").alias("root_machine"))
        roots = thread_roots(reviews).join(heads.where("root_why is not null"), "root")
        own = own.join(roots.select("id", "root", "root_why", "root_machine"), "id", "left")
    else:
        own = own.withColumns({c: F.lit(None).cast("string") for c in ("root", "root_why", "root_machine")})
    thread = F.col("root_why").isNotNull() & ~_is(who, policy.include_authors)
    rows = own.join(pulls.select("repo", "number", F.lit(True).alias("pull")), ["repo", "number"], "left")
    pull = F.coalesce("pull", F.lit(False))
    rows = rows.withColumns({
        "reason": F.when(pull, F.when(thread, "excluded_thread").otherwise(F.col("why"))),
        "provider": F.when(pull, F.when(thread, F.col("root_machine")).when(F.col("why").isNotNull(), F.col("machine"))),
        "thread": F.when(pull & thread, F.col("root")),
    })
    return rows.withColumn("visible", F.col("reason").isNull()).drop("machine", "why", "root", "root_why", "root_machine", "pull")
