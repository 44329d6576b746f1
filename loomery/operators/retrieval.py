"""Search as one call: engine choice and fallback, lexical, semantic and hybrid ranking, candidates for a seed ticket."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import candidates, lexical, paging, semantic, snippets
from .filters import Filters
from .represent import LabelRule

ENGINES = ("lexical", "semantic", "hybrid")
EVIDENCE_MOST, EVIDENCE = 10, 3
#: Weights of evidence by field.
FIELD_WEIGHTS = {"title": 2.0, "labels": 1.5, "body": 1.0, "ticket": 1.0}
OTHER_WEIGHT, ENTITY_WEIGHT = 0.6, 2.0
#: Words of a hybrid query, and of one that asks by meaning alone bytes.
HYBRID_WORDS, QUERY_BYTES = 512, 16384
#: Field of passages by scope.
FIELDS = {"title": "title", "body": "body", "labels": "labels", "comments": "comment", "reviews": "review_comment"}
#: Runes of a semantic snippet.
SNIPPET = 1024


class SemanticUnavailable(RuntimeError):
    pass


@dataclass
class Corpus:
    """What a search reads: records, the lexical index, stored passages with vectors, and which documents are indexed."""

    tickets: DataFrame
    documents: DataFrame
    index: lexical.Index
    passages: DataFrame | None = None
    states: DataFrame | None = None  # id, content_hash, complete, model
    encode: Callable[[str], list[float]] | None = None
    comments: DataFrame | None = None  # id, repo, number, created_s, visible
    rules: list[LabelRule] = field(default_factory=list)


@dataclass
class Result:
    rows: DataFrame
    engine: str
    warnings: list[dict] = field(default_factory=list)
    total: int | None = None
    facets: dict[str, DataFrame] = field(default_factory=dict)


def chosen_engine(engine: str | None, match: str = "any", prefix: bool = False) -> tuple[str, list[dict]]:
    """Hybrid if none is asked for; exact matching is lexical, which a warning says if another engine would have run."""
    if engine not in (None, "", *ENGINES):
        raise ValueError(f"an engine is one of {', '.join(ENGINES)}")
    exact = match in ("all", "phrase") or prefix
    if engine in ("semantic", "hybrid") and exact:
        raise ValueError("all, phrase and prefix need the lexical engine")
    if not engine and exact:
        return "lexical", [{"code": "search_engine_selected", "engine": "lexical"}]
    return engine or "hybrid", []


def pending(documents: DataFrame, states: DataFrame, model: str) -> DataFrame:
    """Documents whose vectors are missing, incomplete, of another model or of another text."""
    done = states.where(F.col("complete") & (F.col("model") == model)).select("id", F.col("content_hash").alias("h"))
    rows = documents.withColumn("content_hash", content_hash())
    return rows.join(done, (rows["id"] == done["id"]) & (rows["content_hash"] == done["h"]), "left_anti").select("id", "repo", "number", "content_hash")


def content_hash():
    return F.sha2(F.concat_ws("\x00", F.coalesce("title", F.lit("")), F.coalesce("body", F.lit(""))), 256)


def covered(corpus: Corpus, tickets: DataFrame, model: str, scopes: list[str] | None = None) -> bool:
    """Whether every document of the selected tickets, of those kinds that ``scopes`` name, is indexed."""
    if corpus.passages is None or corpus.states is None:
        return False
    documents = corpus.documents.where(F.col("family").isin(sorted({lexical.SCOPES[s][0] for s in scopes}))) if scopes else corpus.documents
    selected = documents.join(tickets.select("repo", "number"), ["repo", "number"], "left_semi")
    return pending(selected, corpus.states, model).isEmpty()


def embedded_query(vectors: list[list[float]], most: int = 16) -> list[float]:
    """The unit vector of the sum of a query's passages."""
    if not 1 <= len(vectors) <= most:
        raise ValueError(f"a query has 1 to {most} passages")
    total = [sum(x) for x in zip(*vectors, strict=True)]
    norm = sum(x * x for x in total) ** 0.5
    if not norm > 0:
        raise ValueError("a query's vectors cancel out")
    return [x / norm for x in total]


def search(corpus: Corpus, query: str, engine: str | None = None, match: str = "any", prefix: bool = False, scopes: list[str] | None = None, exclude: list[str] | None = None, filters: Filters | None = None, model: str = "", count: bool = False, facets: bool = False) -> Result:
    """Every matching ticket with its score (``search_page`` pages it); total and facets where asked for.

    Without an engine the search is hybrid, and lexical, with a warning, where vectors are missing for any selected
    document. An engine that is asked for fails instead. Scopes and excluded words hold for every engine: for literal
    matches, vectors, ticket signals and coverage.
    """
    name, warnings = chosen_engine(engine, match, prefix)
    if unknown := set(scopes or []) - set(lexical.SCOPES):
        raise ValueError(f"no such scope: {', '.join(sorted(unknown))}")
    tickets = corpus.tickets.where((filters or Filters()).column())
    if name != "lexical":
        if not query.strip() or len(query.encode()) > QUERY_BYTES:
            raise ValueError(f"a query has text, and at most {QUERY_BYTES} bytes")
        if corpus.encode is None or not covered(corpus, tickets, model, scopes):
            if engine:
                raise SemanticUnavailable("vectors are missing for selected documents")
            name, warnings = "lexical", [*warnings, {"code": "search_engine_fallback", "engine": "lexical"}]
    if name == "lexical":
        rows = lexical.search(corpus.index, tickets, query, match, prefix, scopes, exclude).select("repo", "number", "score")
    else:
        allowed = lexical.without_words(tickets, corpus.index, exclude, scopes)
        scores = semantic.ticket_scores(passages_scored(corpus, allowed, query, scopes))
        if name == "semantic":
            rows = semantic.top(scores).select("repo", "number", "score")
        else:
            rows = hybrid(corpus, allowed, query, scores, scopes)
            if len(lexical.query_words(query, most=HYBRID_WORDS)) > candidates.EVIDENCE_WORDS:
                warnings = [*warnings, {"code": "ticket_signals_limited", "resource": "search"}]
    out = Result(rows, name, warnings)
    if count:
        out.total = rows.count()
    if facets:
        own = tickets.join(rows.select("repo", "number"), ["repo", "number"], "left_semi")
        out.facets = {"labels": paging.facet(own, F.col("labels")), "types": paging.facet(own, F.array("type"), distinct=False)}
    return out


def passages_scored(corpus: Corpus, tickets: DataFrame, query: str, scopes: list[str] | None = None) -> DataFrame:
    """Passages of ``tickets`` in the fields that ``scopes`` name, with their similarity to the query."""
    rows = corpus.passages.where(F.col("field").isin([FIELDS[s] for s in scopes])) if scopes else corpus.passages
    return semantic.passage_scores(rows.join(tickets.select("repo", "number"), ["repo", "number"], "left_semi"), corpus.encode(query))


def hybrid(corpus: Corpus, tickets: DataFrame, query: str, scores: DataFrame, scopes: list[str] | None = None) -> DataFrame:
    """Fused ranks with the tickets' signals: terms, fields and entities that match. Entities are looked for in labels, so only
    where labels are in scope. Signals take the query's first ``candidates.EVIDENCE_WORDS`` words, the lexical rank all."""
    key = ["repo", "number"]
    lex = lexical.search(corpus.index, tickets, query, scopes=scopes, most=HYBRID_WORDS)
    hits = lex.select(*key).union(scores.select(*key)).distinct()
    words = candidates.query_words(query)
    named = candidates.entities(tickets, query, corpus.rules) if not scopes or "labels" in scopes else None
    told = candidates.term_evidence(corpus.index.of_terms(words).where(lexical.within(scopes)), words, hits, named)
    return semantic.hybrid(lex, scores, told).join(told.drop("score"), key, "left")


@dataclass
class Page:
    """A page of matches (repo, number, title, state, kind, updated_s, score, place) and what goes with it."""

    matches: DataFrame
    evidence: DataFrame  # repo, number, ordinal, field, source, text
    engine: str
    has_more: bool
    next_cursor: str | None
    total: int | None
    facets: dict[str, DataFrame]
    warnings: list[dict]


def search_page(corpus: Corpus, query: str, engine: str | None = None, sort: str = "relevance", order: str | None = None, limit: int | None = None, cursor: str | None = None, evidence_limit: int = EVIDENCE, generation: str = "", **options) -> Page:
    """A page of ``search`` with the evidence of its tickets and the cursor of the next. A cursor holds for the same query,
    options, engine and generation only. Evidence is looked up for the page's tickets alone."""
    if not 1 <= evidence_limit <= EVIDENCE_MOST:
        raise ValueError(f"evidence is 1 to {EVIDENCE_MOST}")
    limit, sign = paging.limit_of(limit), paging.signature({"query": query, "sort": sort, "order": order, **options})
    if cursor and engine:  # a wrong one costs no search
        paging.decode(cursor, f"search:{engine}", sign, generation)
    found = search(corpus, query, engine, **options)
    kind = f"search:{found.engine}"
    at = paging.decode(cursor, kind, sign, generation) if cursor else None
    shown = corpus.tickets.select("repo", "number", "title", "state", "kind", "updated_s", "created_s")
    rows = found.rows.join(shown, ["repo", "number"])
    rows = rows.where(paging.after(sort, order, at["key"], at["repo"], at["number"])) if at else rows
    rows = rows.orderBy(*paging.order_by(sort, order)).limit(limit + 1)
    got = rows.collect()  # a page and one more
    matches = corpus.tickets.sparkSession.createDataFrame([(*r, i) for i, r in enumerate(got[:limit], 1)], rows.withColumn("place", F.lit(1)).schema)
    next_cursor = None
    if len(got) > limit:
        last = got[limit - 1]
        key = last[paging.KEYS[sort]] if sort in paging.KEYS else None
        next_cursor = paging.encode({"kind": kind, "signature": sign, "generation": generation, "key": key, "repo": last["repo"], "number": last["number"]})
    told = evidence(corpus, matches.select("repo", "number"), query, found.engine, evidence_limit, options)
    return Page(matches, told, found.engine, len(got) > limit, next_cursor, found.total, found.facets, found.warnings)


def evidence(corpus: Corpus, few: DataFrame, query: str, engine: str, limit: int, options: dict) -> DataFrame:
    """(repo, number, ordinal, field, source, text) of a page's tickets ``few``: the units that match literally, with the words in
    brackets, and the passages nearest to the query."""
    key, scopes, few = ["repo", "number"], options.get("scopes"), F.broadcast(few)  # a page
    columns = [*key, "field", "source", "text", "ordinal"]
    literal = nearest = None
    if engine != "semantic":
        hits = lexical.units(corpus.index, query, options.get("match", "any"), options.get("prefix", False), scopes, HYBRID_WORDS)
        hits = lexical.best_of_units(hits.join(few, key, "left_semi"))
        texts = corpus.documents.join(few, key, "left_semi").select("id", "title", "body")
        words = lexical.query_words(query, most=HYBRID_WORDS)
        rows = hits.join(texts, "id").withColumn("field", lexical.field_of(words)).withColumn("source", F.col("id"))
        body = F.col("field").isin("title", "labels")
        phrases = [re.findall(r"[^\W_]+", w) for w in words]
        phrases = [[t for p in phrases for t in p]] if options.get("match") == "phrase" else [p for p in phrases if p]
        text = F.when(body, F.col("title")).otherwise(F.col("body"))
        rows = rows.withColumn("text", snippets.snippets(text, phrases, prefix=options.get("prefix", False)))
        first = F.when(F.col("field") == "labels", 0).when(F.col("field") == "title", 1).otherwise(2) if engine == "hybrid" else F.lit(0)
        place = F.row_number().over(Window.partitionBy(*key).orderBy(first, F.desc("score"), "family", "id"))
        literal = rows.withColumn("ordinal", place).where(F.col("ordinal") <= limit).select(*columns)
    if engine != "lexical":
        best = semantic.best_passages(passages_scored(corpus, few, query, scopes), limit)
        nearest = best.select(*key, "field", F.concat_ws(":", "field", "chunk").alias("source"), F.lit(None).cast("string").alias("text"), "ordinal")
        if "text" in corpus.passages.columns:
            nearest = nearest.drop("text").join(corpus.passages.select(*key, "field", F.concat_ws(":", "field", "chunk").alias("source"), F.substring("text", 1, SNIPPET).alias("text")), [*key, "field", "source"], "left").select(*columns)
    if engine == "hybrid":
        named = candidates.entities(corpus.tickets.join(few, key, "left_semi"), query, corpus.rules) if not scopes or "labels" in scopes else None
        return merged_evidence(nearest, literal, named, limit).select(*columns)
    return literal if engine == "lexical" else nearest


def seed_vector(passages: DataFrame, repo: str, number: int, labels: bool = True, comments: list[int] | None = None) -> DataFrame:
    """One row with the unit ``vector`` of a ticket from its stored passages: its fields' means by weight."""
    fields = ["title", "body", *(["labels"] if labels else []), *(["comment", "review_comment"] if comments is None or comments else [])]
    own = passages.where((F.col("repo") == repo) & (F.col("number") == number) & F.col("field").isin(fields))
    if comments:
        own = own.where(~F.col("field").isin("comment", "review_comment") | F.col("chunk").isin(comments))
    return semantic.pooled(own, semantic.SEED_WEIGHTS, main_only=False)


def fused_seed(corpus: Corpus, lex: DataFrame, scores: DataFrame, vectors: DataFrame, seed: list[float]) -> DataFrame:
    """Lexical, semantic and mutual ranks, each of weight 1; the semantic list is cut to its first TOP after the ranks."""
    key = ["repo", "number"]
    sem = semantic.ranked(scores, "score", "sem").where(F.col("sem") <= semantic.TOP)
    near = vectors.select("repo", "number", F.round(semantic.dot(F.col("vector"), F.array(*(F.lit(float(x)) for x in seed))), 6).alias("score"))
    ranks = semantic.mutual_ranks(vectors, near.join(sem, key, "left_semi"), seed)
    mutual = F.row_number().over(Window.orderBy("rank", "sem", *key))  # at most MUTUAL rows
    mutual = ranks.join(sem, key).select(*key, mutual.alias("mutual"))
    return semantic.fused([(semantic.ranked(lex, "score", "lex"), "lex", 1.0), (sem, "sem", 1.0), (mutual, "mutual", 1.0)])


#: Comments of a seed that count, by default and at most.
SEED_COMMENTS, MOST_COMMENTS = 20, 100


def seed_documents(corpus: Corpus, repo: str, number: int, labels: bool = True, comments: int = 0) -> DataFrame:
    """The units that a seed ticket is known by: its own, its labels', and its newest ``comments`` that are visible."""
    own = corpus.documents.where((F.col("repo") == repo) & (F.col("number") == number))
    out = own.where(F.col("family").isin("issue", *(["labels"] if labels else [])))
    if comments and corpus.comments is not None:
        said = corpus.comments.where((F.col("repo") == repo) & (F.col("number") == number) & F.coalesce("visible", F.lit(True)))
        said = said.orderBy(F.desc("created_s"), F.desc("id")).limit(comments).select(F.concat(F.lit("comment:"), F.col("id").cast("string")).alias("id"))
        out = out.unionByName(own.join(F.broadcast(said), "id", "left_semi"))  # at most MOST_COMMENTS
    return out


def find_candidates(corpus: Corpus, repo: str, number: int, engine: str | None = None, filters: Filters | None = None, model: str = "", labels: bool = True, comments: bool = False, comment_limit: int = SEED_COMMENTS) -> Result:
    """Tickets like a seed ticket, in the seed's repository unless filters name others.

    Hybrid by the seed's stored vectors and its first QUERY words; lexical by its SELECTED rarest terms, also where vectors
    are missing and no engine was asked for. Without a term that others have the page is empty. A seed is known by its title,
    body and labels (unless ``labels`` is off), and by its newest visible comments where ``comments`` is on.
    """
    if not 1 <= comment_limit <= MOST_COMMENTS:
        raise ValueError(f"comment_limit is 1 to {MOST_COMMENTS}")
    given = filters or Filters(repositories=[repo])
    targets = corpus.tickets.where(given.column() & ~((F.col("repo") == repo) & (F.col("number") == number)))
    known = seed_documents(corpus, repo, number, labels, comment_limit if comments else 0)
    terms = candidates.seed_terms(known, repo, number, candidates.STOP)
    warnings: list[dict] = []
    if engine != "lexical":
        seed = None
        if corpus.passages is not None:
            own = corpus.passages
            if comments and "source" in own.columns:
                own = own.join(F.broadcast(known.select(F.col("id").alias("source"))), "source", "left_semi")
            seed = seed_vector(own, repo, number, labels, None if comments else []).first()
        if seed is not None and covered(corpus, targets, model):
            words = [r["term"] for r in candidates.preliminary(terms, candidates.QUERY).collect()]  # at most QUERY
            main = corpus.passages.where(F.col("field").isin("title", "body")).join(targets.select("repo", "number"), ["repo", "number"], "left_semi")
            scores = semantic.ticket_scores(semantic.passage_scores(main, list(seed["vector"]))).select("repo", "number", "score")
            if engine == "semantic":
                return Result(semantic.top(scores), "semantic")
            vectors = semantic.pooled(corpus.passages, semantic.TICKET_WEIGHTS).join(targets.select("repo", "number"), ["repo", "number"], "left_semi")
            lex = lexical.search(corpus.index, targets, " ".join(words)) if words else scores.limit(0)
            return Result(fused_seed(corpus, lex, scores, vectors, list(seed["vector"])), "hybrid")
        if engine:
            raise SemanticUnavailable("vectors are missing for selected documents")
        warnings = [{"code": "search_engine_fallback", "engine": "lexical"}]
    chosen = [r["term"] for r in candidates.select_terms(terms, corpus.index, repo, number, corpus.tickets.where(given.column())).collect()]  # at most SELECTED
    rows = lexical.search(corpus.index, targets, " ".join(chosen)) if chosen else corpus.tickets.select("repo", "number", F.lit(0.0).alias("score")).limit(0)
    return Result(rows.select("repo", "number", "score"), "lexical", warnings)


def merged_evidence(semantic_rows: DataFrame, literal: DataFrame, entities: DataFrame | None = None, limit: int = EVIDENCE) -> DataFrame:
    """Evidence of each ticket (repo, number, field, source, ordinal): semantic rows first, literal ones of another field or
    source after them, by field weight; labels weigh more where an entity matched. Equal weights keep their order."""
    if not 1 <= limit <= EVIDENCE_MOST:
        raise ValueError(f"evidence is 1 to {EVIDENCE_MOST}")
    key = ["repo", "number"]
    rows = semantic_rows.withColumn("origin", F.lit(0)).unionByName(literal.withColumn("origin", F.lit(1)), allowMissingColumns=True)
    first = F.row_number().over(Window.partitionBy(*key, "field", "source").orderBy("origin", "ordinal"))
    rows = rows.withColumn("i", first).where("i = 1 or origin = 0").drop("i")
    weight = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in FIELD_WEIGHTS.items() for x in kv)), F.col("field")), F.lit(OTHER_WEIGHT))
    if entities is not None:
        rows = rows.join(entities.select(*key, F.lit(True).alias("entity")).distinct(), key, "left")
        weight = weight + F.when((F.col("field") == "labels") & F.col("entity"), ENTITY_WEIGHT).otherwise(0.0)
    place = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("weight"), "origin", "ordinal"))
    rows = rows.withColumn("weight", weight).withColumn("place", place).where(F.col("place") <= limit)
    return rows.withColumn("ordinal", F.col("place")).drop("place", "origin", "weight", *(["entity"] if entities is not None else []))


def continued(rows: DataFrame, score: float, repo: str, number: int) -> DataFrame:
    """What stands behind a ticket in a list ranked by score, repo, number."""
    s, r, n = F.col("score"), F.col("repo"), F.col("number")
    return rows.where((s < score) | (s == score) & ((r > repo) | (r == repo) & (n > number)))
