"""Terms of a seed ticket, their selection, and evidence of query terms in tickets."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens
from .lexical import Index
from .represent import LabelRule, attributes

WEIGHTS = {"title": 4.0, "body": 1.0, "labels": 1.5, "comment": 0.5, "review": 0.5}
#: Terms of a seed that are looked up, words of a seed that a semantic query takes, terms that a lexical one takes.
PRELIMINARY, QUERY, SELECTED = 256, 32, 24
#: Distinct words of one text, and words of a query, that count.
TEXT_WORDS, EVIDENCE_WORDS = 1024, 32
#: Words that are no terms.
STOP = (
    "a an the and or of to in on for at by as is are was were be been being it its this that these those with from have has had not no yes we you our your "
    "they their then than when where what how can could should would will do does did please issue description expected actual behavior browser details steps "
    "reproduce environment"
).split()


def seed_terms(documents: DataFrame, repo: str, number: int, stop: list[str]) -> DataFrame:
    """(term, weight): each text's first TEXT_WORDS distinct words of two letters or more, by the text's weight, over the
    seed's texts; each label is a text."""
    own = documents.where((F.col("repo") == repo) & (F.col("number") == number))
    part = lambda w, family, text: F.struct(F.lit(w).alias("w"), F.when(F.col("family").isin(family), text).alias("t"))
    names = F.transform(F.split("title", "\n"), lambda x: F.struct(F.lit(WEIGHTS["labels"]).alias("w"), F.when(F.col("family") == "labels", x).alias("t")))
    plain = F.array(part(WEIGHTS["title"], ["issue"], F.col("title")), part(WEIGHTS["body"], ["issue"], F.col("body")), part(WEIGHTS["comment"], ["comment", "review"], F.col("body")))
    rows = own.select(F.explode(F.concat(plain, names)).alias("p")).select("p.w", tokens(F.col("p.t")).alias("t"))
    kept = F.filter(F.array_distinct("t"), lambda x: (F.length(x) >= 2) & ~x.isin(stop or [""]))
    rows = rows.select("w", F.explode(F.slice(kept, 1, TEXT_WORDS)).alias("term"))
    return rows.groupBy("term").agg(F.sum("w").alias("weight"))


def preliminary(terms: DataFrame, top: int = PRELIMINARY) -> DataFrame:
    return terms.orderBy(F.desc("weight"), "term").limit(top)


def select_terms(terms: DataFrame, index: Index, repo: str, number: int, among: DataFrame, top: int = SELECTED) -> DataFrame:
    """(term, df, score) of the seed's first PRELIMINARY terms: weight times rarity ln(1 + (total + 1) / (df + 1)) over
    the tickets ``among``. Terms that no other ticket has drop out. One aggregation counts all of them."""
    some = {r["term"]: r["weight"] for r in preliminary(terms).collect()}  # at most PRELIMINARY
    total = among.agg(F.count("*").alias("total"))
    rest = index.of_terms(list(some)).where(~((F.col("repo") == repo) & (F.col("number") == number))).join(among.select("repo", "number"), ["repo", "number"], "left_semi")
    df = rest.groupBy("term").agg(F.countDistinct("repo", "number").alias("df"))
    weight = F.element_at(F.create_map(*(F.lit(x) for kv in (some or {"": 0.0}).items() for x in kv)), F.col("term"))
    rows = df.withColumn("weight", weight).crossJoin(F.broadcast(total))  # one row
    score = F.round(F.col("weight") * F.ln(1 + (F.col("total") + 1) / (F.col("df") + 1)), 6)
    return rows.select("term", "df", score.alias("score")).orderBy(F.desc("score"), "term").limit(top)


def query_words(query: str, stop: list[str] = STOP) -> list[str]:
    """The words of a query that count as evidence."""
    return [w for w in dict.fromkeys(re.findall(r"\w+", query.lower())) if w not in stop][:EVIDENCE_WORDS]


def entities(tickets: DataFrame, query: str, rules: list[LabelRule] = (), roles: tuple[str, ...] = ("client", "partner")) -> DataFrame:
    """(repo, number, labels, words): labels of tickets whose value or alias stands in the query as a phrase, and their
    values' words."""
    spaced = F.lit(f" {' '.join(re.findall(r'\w+', query.lower()))} ")
    phrase = lambda x: F.array_join(F.array_remove(F.split(F.lower(x), r"[^\p{L}\p{N}_]+"), ""), " ")
    inside = lambda x: (phrase(x) != "") & F.contains(spaced, F.concat(F.lit(" "), phrase(x), F.lit(" ")))
    found = F.filter(attributes(F.col("labels"), list(rules)), lambda a: a["role"].isin(*roles) & (inside(a["value"]) | F.exists(a["aliases"], inside)))
    rows = tickets.select("repo", "number", found.alias("a")).where(F.size("a") > 0)
    after = lambda a: F.substr(a["label"], F.instr(a["label"], ":") + 1)
    words = F.flatten(F.transform("a", lambda a: F.split(F.when(F.instr(a["label"], ":") > 0, phrase(after(a))).otherwise(F.lit("")), " ")))
    return rows.select("repo", "number", F.array_sort(F.array_distinct(F.transform("a", lambda a: a["label"]))).alias("labels"), words.alias("words"))


def term_evidence(postings: DataFrame, words: list[str], among: DataFrame | None = None, matched: DataFrame | None = None) -> DataFrame:
    """Per ticket: score, terms, fields, entities. The score is the share of the words' rarity it matches plus a quarter
    of the same by field weight.

    With ``among`` (repo, number) only those tickets count, all of them, and words that none has add to the rarity.
    ``matched`` (of ``entities``) adds 1.5 to its tickets, times the share of the words beside the entity's that they match.
    """
    hits = postings.where(F.col("term").isin(words))
    key = ["repo", "number"]
    if among is not None:
        hits = hits.join(among, key, "left_semi")
    family = F.col("family")
    field = F.when(family == "labels", "labels").when(F.col("col") == "title", "title").when(family == "issue", "body").when(family == "review", "review_comment").otherwise("comment")
    weight = F.when(F.col("field") == "labels", 1.5).when(F.col("field") == "title", 2.0).when(F.col("field") == "body", 1.0).otherwise(0.6)
    best = hits.withColumn("field", field).groupBy(*key, "term").agg(F.max(weight).alias("w"), F.collect_set("field").alias("fields"))
    h = (best.select(*key).distinct() if among is None else among).agg(F.count("*").alias("h"))
    rare = best.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(h)).select("term", F.ln(1 + (F.col("h") + 1) / (F.col("df") + 1)).alias("r"))
    den = rare.agg(F.sum("r").alias("den"), F.count("*").alias("found"))
    if among is not None:
        den = den.crossJoin(h).select((F.coalesce("den", F.lit(0.0)) + (len(set(words)) - F.col("found")) * F.ln(F.col("h") + 2)).alias("den"))
    rows = best.join(F.broadcast(rare), "term").crossJoin(F.broadcast(den))  # at most a row a word, and one row
    score = F.sum("r") / F.max("den") + 0.25 * F.sum(F.col("r") * F.col("w")) / F.max("den")
    out = rows.groupBy(*key).agg(score.alias("score"), F.array_sort(F.collect_set("term")).alias("terms"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("fields")))).alias("fields"))
    none = F.array().cast("array<string>")
    if matched is None:
        return out.select(*key, F.round("score", 6).alias("score"), "terms", "fields", none.alias("entities"))
    if among is not None:
        matched = matched.join(among, key, "left_semi")
    out = out.join(matched.withColumnsRenamed({"labels": "entities", "words": "own"}), key, "full_outer")
    topic = F.array_except(F.array(*(F.lit(w) for w in words)).cast("array<string>"), F.coalesce("own", none))
    share = F.when(F.size(topic) > 0, F.size(F.array_intersect(topic, F.coalesce("terms", none))) / F.size(topic)).otherwise(1.0)
    bonus = F.when(F.col("entities").isNotNull(), 1.5 * share).otherwise(0.0)
    fields = F.array_sort(F.array_union(F.coalesce("fields", none), F.when(F.col("entities").isNotNull(), F.array(F.lit("labels"))).otherwise(none)))
    return out.select(*key, F.round(F.coalesce("score", F.lit(0.0)) + bonus, 6).alias("score"), F.coalesce("terms", none).alias("terms"), fields.alias("fields"), F.coalesce("entities", none).alias("entities"))
