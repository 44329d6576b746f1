"""Benchmark decontamination by winnowing, in DataFrame functions only.

A text's fingerprints are the smallest hash of each ``w`` successive k-grams, with k + w - 1 = the span that is
guaranteed: two texts that share so many words share a fingerprint. Fingerprints of documents and items are joined,
and each hit is extended along its alignment to the words that really agree. Documents are read once for all spans;
those with a fingerprint in common, a few, are read once more for the alignments.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, near, words_between

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SPAN = 13
#: Words of all items up to which the items are broadcast; more are joined by shuffling.
BROADCAST_WORDS = 2_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: str = "text"):
    """Letters A-Z are lower-cased, so they aren't among the separators that remain."""
    return words_between(F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER), SEPARATORS)


def _rolled(df: DataFrame, source: str, out: str, n: int, join: str) -> DataFrame:
    """Column ``out``: ``join`` over every n successive elements, from parts of 1, 2, 4 ... elements.

    What is exploded from it must be so by an outer explode: the filter that Spark infers for an inner one would be
    pushed through these projections, which each step doubles.
    """
    power, parts, size, at = source, [], 1, 0
    while size <= n:
        if n & size:
            parts.append((size, power))
        size *= 2
        if size <= n:
            df = df.withColumn(f"{out}_{size}", F.expr(f"zip_with({power}, slice({power}, {size // 2 + 1}, greatest(0, size({power}) - {size // 2})), (x, y) -> {join})"))
            power = f"{out}_{size}"
    now, at = parts[-1][1], parts[-1][0]
    for k, part in reversed(parts[:-1]):
        df = df.withColumn(f"{out}_to{at}", F.expr(f"zip_with({now}, slice({part}, {at + 1}, greatest(0, size({part}) - {at})), (x, y) -> {join})"))
        now, at = f"{out}_to{at}", at + k
    return df.withColumn(out, F.expr(f"slice({now}, 1, greatest(0, size({source}) - {n - 1}))"))


def fingerprinted(df: DataFrame, span: int, words: str = "words", whole: bool = False) -> DataFrame:
    """Adds ``grams`` (hash of each k-gram by position), ``least_`` (the least of each window) and ``prints`` (those,
    each once); ``whole``: also the hash of each window."""
    k = (span + 1) // 2
    w = span - k + 1
    keep = [c for c in df.columns if c not in ("grams", "least_", "prints")]
    df = df.withColumn("one", F.transform(words, lambda x: F.xxhash64(x)))
    if whole:
        df = _rolled(df, "one", "whole", span, "xxhash64(x, y)").select(*keep, "one", "whole")
        keep = [*keep, "whole"]
    df = _rolled(df, "one", "grams", k, "xxhash64(x, y)").select(*keep, "grams")
    df = _rolled(df, "grams", "least_", w, "least(x, y)")
    return df.select(*keep, "grams", "least_", F.array_distinct("least_").alias("prints"))


def _item_marks(items: DataFrame, span: int) -> DataFrame:
    """(span, print, item_id, item_at): where the fingerprints of each item of this span stand, once for each distinct
    window: equal windows of an item hit the same words."""
    k = (span + 1) // 2
    w = span - k + 1
    of = fingerprinted(items.where(F.col("span") == span), span, "item_words", whole=True)
    each = of.select("item_id", "th", "grams", F.posexplode_outer(F.arrays_zip("whole", "least_")).alias("at", "x")).where("x is not null")
    each = each.select("item_id", "th", "x.whole", F.col("x.least_").alias("print"), (F.col("at") + F.expr(f"array_position(slice(grams, at + 1, {w}), x.least_)") - 1).alias("item_at"))
    first = each.groupBy("item_id", "th", "whole", "print").agg(F.min("item_at").alias("item_at"))
    return first.select(F.lit(span).alias("span"), "print", "item_id", "th", F.col("item_at").cast("int").alias("item_at")).distinct()


def _same(left: str, right: str, *more: str):
    """Rows of one document: ids and text hashes agree."""
    return F.expr(" and ".join([f"{left}.th = {right}.th", f"{left}.doc_id <=> {right}.doc_id", *more]))


def contamination(docs: DataFrame, benchmark: DataFrame, span: int = SPAN) -> DataFrame:
    """A row for each row of ``docs``: doc_id, th (hash of the text), n_words, n_hit, n_items, items_sha256, contaminated.

    Words inside an occurrence of any ``span`` successive words of an item count as hit; an item of fewer words
    counts as a whole. Null and empty texts have no words and are never contaminated; an item without words has no
    window. Repeated items count once for each item_id (null ones are not counted). Repeated rows get equal results,
    rows that share a doc_id but not their text are judged apart. Other columns are ignored. Empty tables give empty
    results, an empty benchmark no hits.
    """
    docs = docs.select(F.col("doc_id").alias("doc_id"), F.col("text").alias("text"))
    items = benchmark.select(F.col("item_id").alias("item_id"), F.xxhash64("text").alias("th"), words_of().alias("item_words")).where(F.size("item_words") > 0)
    items = materialize(items.withColumn("span", F.least(F.lit(span), F.size("item_words"))).dropDuplicates(["item_id", "th"]), "items")
    spans = {r["span"]: r["n"] for r in items.groupBy("span").agg(F.sum(F.size("item_words")).alias("n")).collect()}  # at most ``span`` rows
    small = sum(spans.values()) <= BROADCAST_WORDS
    close = F.broadcast if small else (lambda df: df)
    marks = items.select("span", F.lit(0).cast("long").alias("print"), "item_id", "th", F.lit(0).alias("item_at")).where("false")
    for n in spans:
        marks = marks.unionByName(_item_marks(items, n))
    marks = materialize(marks, "marks")

    # One pass: a row of span 0 for each row of documents, and one for each fingerprint that some item has.
    keyed = docs.select("doc_id", F.xxhash64("text").alias("th"), words_of().alias("words")).withColumn("n_words", F.size("words").cast("long"))
    found = F.array(F.struct(F.lit(0).alias("span"), F.lit(0).cast("long").alias("print")))
    for n in spans:
        keyed = fingerprinted(keyed, n).withColumn(f"of_{n}", F.transform("prints", _tagged(n))).drop("grams", "prints", "least_")
        found = F.concat(found, F.col(f"of_{n}"))
    scan = keyed.select("doc_id", "th", "n_words", F.explode_outer(found).alias("p")).select("doc_id", "th", "n_words", "p.span", "p.print")
    if small:
        wanted = marks.select("span", "print").unionByName(items.sparkSession.createDataFrame([(0, 0)], "span int, print long")).distinct()
        scan = materialize(scan.join(F.broadcast(wanted), ["span", "print"], "left_semi"), "scan")
        hit = scan.where("span > 0")
    else:
        scan = materialize(scan, "scan")
        hit = scan.where("span > 0").join(marks.select("span", "print").distinct(), ["span", "print"], "left_semi")
    rows = scan.where("span = 0").select("doc_id", "th", "n_words")
    hit = materialize(hit.select("doc_id", "th").distinct(), "hits")
    few = docs.withColumn("th", F.xxhash64("text")).alias("x").join(near(hit, hit.count()).alias("y"), _same("x", "y"), "left_semi")
    few = materialize(few.dropDuplicates(["doc_id", "th"]).select("doc_id", "th", words_of().alias("words")), "hit-docs")

    lines = few.select("doc_id", "th", F.lit(0).alias("span"), F.lit(0).cast("long").alias("item_id"), F.lit(0).cast("long").alias("ith"), F.lit(0).alias("shift")).where("false")
    lines = lines.withColumn("item_id", F.col("item_id").cast(items.schema["item_id"].dataType))
    mark = marks.select("span", "print", "item_id", F.col("th").alias("ith"), "item_at")
    for n in spans:
        at = fingerprinted(few, n).select("doc_id", "th", F.posexplode_outer("grams").alias("at", "print"))
        at = at.join(close(mark.where(F.col("span") == n)), "print")
        lines = lines.unionByName(at.select("doc_id", "th", "span", "item_id", "ith", (F.col("at") - F.col("item_at")).alias("shift")))
    # The pieces of a document that its lines cover are cut while its words are at hand; only they go on.
    length = items.select(F.col("item_id").alias("i"), F.col("th").alias("t"), F.size("item_words").alias("long"))
    lines = lines.distinct().join(close(length), F.expr("ith = t and item_id <=> i"))
    lines = lines.groupBy("doc_id", "th").agg(F.collect_list(F.struct("span", "item_id", "ith", "shift", F.greatest(F.lit(0), -F.col("shift")).alias("low"), "long")).alias("lines"))
    lines = lines.alias("x").join(few.alias("y"), _same("x", "y")).select("x.doc_id", "x.th", "lines", "words")
    cut = """transform(lines, l -> named_struct('span', l.span, 'item_id', l.item_id, 'ith', l.ith, 'shift', l.shift, 'low', l.low,
        'piece', slice(words, l.low + l.shift + 1, greatest(0, l.long - l.low))))"""
    lines = lines.select("doc_id", "th", F.explode(F.expr(cut)).alias("l")).select("doc_id", "th", "l.*")
    lines = lines.join(close(items.select(F.col("item_id").alias("i"), F.col("th").alias("t"), "item_words")), F.expr("ith = t and item_id <=> i"))
    starts = "filter(sequence(0, size(piece) - span), j -> slice(piece, j + 1, span) = slice(item_words, low + j + 1, span))"
    lines = lines.where("size(piece) >= span").withColumn("starts", F.expr(starts)).where(F.size("starts") > 0)
    lines = lines.select("doc_id", "th", "item_id", F.expr("array_distinct(flatten(transform(starts, j -> sequence(low + shift + j, low + shift + j + span - 1))))").alias("hit"))
    lines = materialize(lines, "lines")

    n_hit = lines.select("doc_id", "th", F.explode("hit").alias("at")).distinct().groupBy("doc_id", "th").agg(F.count("*").alias("n_hit"))
    ids = lines.groupBy("doc_id", "th").agg(F.collect_set(F.col("item_id").cast("string")).alias("ids"))
    ids = ids.select("doc_id", "th", F.size("ids").cast("long").alias("n_items"), F.array_join(F.array_sort("ids"), ",").alias("ids"))
    summed = n_hit.alias("x").join(ids.alias("y"), _same("x", "y")).select(F.col("x.doc_id").alias("d"), F.col("x.th").alias("t"), "n_hit", "n_items", "ids")
    out = rows.join(materialize(summed, "summed"), F.expr("th = t and doc_id <=> d"), "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select(
        "doc_id",
        "th",
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.sha2(F.coalesce("ids", F.lit("")), 256).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def _tagged(span: int):
    return lambda x: F.struct(F.lit(span).alias("span"), x.alias("print"))
