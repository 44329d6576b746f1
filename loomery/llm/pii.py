"""Personal data: base patterns, and terms that disclose a protected entity by corpus co-occurrence.

How much a term t tells of an entity c is its pointwise mutual information with c as a share of the information
that c itself carries: ln(p * N / n_c) / ln(N / n_c) over the N documents of the corpus. p, how likely c is where t
stands, is smoothed by one document that has t and names c by chance: (n_tc + n_c / N) / (n_t + 1). A term discloses c if
its share reaches ``threshold``, c is named in most documents that have it (p of at least MAJORITY), and at least SUPPORT
different texts say so: the last two don't loosen as the corpus grows, and a word that is merely rare discloses nothing.
Such a term is a span of kind ``term`` wherever it stands, above all in documents that don't name the entity, where it
would let it be told. DataFrame functions only.

Terms are counted over the whole corpus first and the counts joined after, so no join makes a row for each word of the
corpus. Entities that stand in the same documents disclose alike and are judged once, which keeps a document that
lists many entities from making a row for each entity and word.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, near, words_between

#: The given patterns, each start and repeat bound so that long runs cost linear time and no recursion.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
_DIGITS = "regexp_replace(v, '[^0-9]', '')"
_LUHN = (
    f"aggregate(sequence(1, length({_DIGITS})), 0, (s, i) -> s + case when (length({_DIGITS}) - i) % 2 = 0 then "
    f"int(substring({_DIGITS}, i, 1)) else int(substring({_DIGITS}, i, 1)) * 2 - case when int(substring({_DIGITS}, i, 1)) > 4 then 9 else 0 end end) % 10 = 0"
)
VALID = {
    "email": "true",
    "ip": rf"v rlike '^{_PART}[.]{_PART}[.]{_PART}[.]{_PART}$'",
    "card": f"length({_DIGITS}) between 14 and 19 and {_LUHN}",
    "phone": f"length({_DIGITS}) between 10 and 15",
}
#: What a text has that holds a match; the others' matches all have digits as well.
NEEDS = {"email": "instr(text, '@') > 0", "ip": "instr(text, '.') > 0", "card": "true", "phone": "instr(text, '+') > 0"}
KINDS = [*PATTERNS, "term"]
#: Texts that must have both, and the least share of a term's documents that name the entity.
SUPPORT, MAJORITY = 3, 0.5
TERM, TERM_GAP, SHORTEST = r"[\p{L}\p{N}]{3,}", r"[^\p{L}\p{N}]+", 3
SPAN = "struct<start:int,ord:int,end:int,kind:string,value:string>"
#: Spans of terms that are broadcast at most, of some 100 bytes each.
SPANS = 500_000
#: Lengths that are added up at a time.
RUN = 256
#: Around matches; where a text has it, another character that no pattern holds either stands for it.
MARK, OTHER = "\x01", "\x02"


def _with(name: str, value: str, then: str) -> str:
    """``then`` with ``name`` for ``value``, computed once wherever Spark moves the expression: names that lambdas bind
    are never replaced by what they stand for."""
    return f"transform(array({value}), {name} -> {then})[0]"


def _placed(pattern: str, kind: str, when: str = "true", valid: str = "true") -> str:
    """SQL of the array of spans of ``pattern`` in ``text``.

    Matches are marked and the text is split at the marks into what lies between matches and they, in turn. Offsets
    are running sums of the lengths, over runs and then over the runs' totals, so that no long array is copied for
    each of its elements.
    """
    clear = f"if(instr(text, '{MARK}') > 0, translate(text, '{MARK}', '{OTHER}'), text)"
    marked = f"regexp_replace({clear}, r\"{pattern}\", '{MARK}$0{MARK}')"
    parts = f"if({when}, split({marked}, '{MARK}', -1), array(''))"
    walk = "named_struct('at', 0, 'got', cast(array() as array<int>))"
    runs = f"""transform(sequence(0, (size(p) - 1) div {RUN}), r -> aggregate(slice(p, int(r * {RUN} + 1), {RUN}), {walk},
        (a, x) -> named_struct('at', a.at + length(x), 'got', array_append(a.got, a.at + length(x))), a -> a.got))"""
    starts = f"aggregate(q, {walk}, (a, r) -> named_struct('at', a.at + r[size(r) - 1], 'got', array_append(a.got, a.at)), a -> a.got)"
    ends = "flatten(zip_with(q, f, (r, x) -> transform(r, n -> n + x)))"
    spans = f"""transform(filter(sequence(0, size(p) - 1), i -> i % 2 = 1 and {_with("v", "p[i]", valid)}), i -> named_struct(
        'start', e[i - 1], 'ord', {KINDS.index(kind)}, 'end', e[i], 'kind', '{kind}', 'value', p[i]))"""
    spans = _with("p", parts, _with("q", runs, _with("f", starts, _with("e", ends, spans))))
    return f"cast(coalesce({spans}, array()) as array<{SPAN}>)"


def base_spans(docs: DataFrame) -> DataFrame:
    """Adds ``base``: the spans of the four patterns, by start, then kind as listed."""
    email, *digits = (_placed(p, k, NEEDS[k], VALID[k]) for k, p in PATTERNS.items())
    none = f"cast(array() as array<{SPAN}>)"
    digits = f"if(text rlike '[0-9]', concat({', '.join(digits)}), {none})"
    return docs.withColumn("base", F.expr(f"if(text is null, {none}, array_sort(concat({email}, {digits})))"))


def _terms():
    words = F.filter(words_between(F.coalesce("text", F.lit("")), TERM_GAP), lambda x: F.length(x) >= SHORTEST)
    return F.array_distinct(F.transform(words, lambda x: F.lower(x)))


def _share(n_tc, total: float):
    """Rises with n_tc; null for an entity that every document names, which has nothing to disclose."""
    p = (n_tc + F.col("n_c") / total) / (F.col("n_t") + 1)
    return F.ln(p * total / F.col("n_c")) / F.when(F.col("n_c") < total, F.ln(total / F.col("n_c")))


def disclosures(named: DataFrame, docs: DataFrame, threshold: float) -> DataFrame:
    """(term): those that disclose an entity.

    ``named``: the rows of ``docs`` with base spans, with th (hash of the text) and base.
    """
    named = named.groupBy("doc_id", "th").agg(F.first("text").alias("text"), F.first("base").alias("base"), F.count("*").alias("rows"))
    named = materialize(named, "named")
    words = materialize(named.select("doc_id", "th", "rows", F.explode_outer(_terms()).alias("term")).where("term is not null"), "words")
    of_term = docs.select(F.explode_outer(_terms()).alias("term")).groupBy("term").agg(F.count("*").alias("n_t"))
    of_term = materialize(of_term.join(words.select("term").distinct(), "term", "left_semi"), "terms")
    total = float(max(1, docs.count()))

    who = named.select("doc_id", "th", "rows", F.explode_outer(F.array_distinct(F.transform("base", lambda s: F.lower(s["value"])))).alias("entity"))
    who = materialize(who.where("entity is not null"), "entities")
    here = F.xxhash64("doc_id", "th")
    same = who.groupBy("entity").agg(F.sum("rows").alias("n_c"), F.bit_xor(here).alias("x"), F.sum(here.cast("decimal(20,0)")).alias("s"))
    groups = who.join(same, "entity").select(F.col("doc_id").alias("d"), F.col("th").alias("t"), "n_c", "x", "s").distinct()
    pairs = words.join(of_term, "term").join(materialize(groups, "groups"), (F.col("th") == F.col("t")) & F.col("doc_id").eqNullSafe(F.col("d")))
    # No pair shares more documents than either has: what can't reach the bounds even so needs no counting.
    most = F.least("n_t", "n_c")
    pairs = pairs.where((most >= SUPPORT) & (_share(most, total) >= threshold)).select("th", "rows", "x", "s", "term", "n_c", "n_t")
    told = pairs.groupBy("n_c", "x", "s", "term", "n_t").agg(F.sum("rows").alias("n_tc"), F.countDistinct("th").alias("texts"))
    likely = (F.col("n_tc") + F.col("n_c") / total) / (F.col("n_t") + 1)
    told = told.where((F.col("texts") >= SUPPORT) & (likely >= MAJORITY) & (_share(F.col("n_tc"), total) >= threshold))
    return materialize(told.select("term").distinct(), "told")


def _told_spans(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(d, t, extra): spans of the disclosing ``terms`` in each of ``docs`` (doc_id, text) that has one."""
    docs = docs.withColumn("th", F.xxhash64("text"))
    words = docs.select("doc_id", "th", F.explode_outer(_terms()).alias("term"))
    told = materialize(words.join(near(terms, terms.count()), "term", "left_semi").distinct(), "disclosed")
    keys = materialize(told.select(F.col("doc_id").alias("d"), F.col("th").alias("t")).distinct(), "keys")
    here = docs.join(near(keys, keys.count()), F.expr(_SAME), "left_semi")
    return _term_spans(base_spans(here), told)


def _term_spans(named: DataFrame, told: DataFrame) -> DataFrame:
    """(d, t, extra): spans of the disclosing terms of each document, without those that overlap a base span."""
    each = named.select("doc_id", "th", "text", "base").dropDuplicates(["doc_id", "th"])
    words = each.select("doc_id", "th", F.explode(F.expr(_placed(TERM, "term"))).alias("w")).withColumn("term", F.lower("w.value"))
    key = F.col("term").eqNullSafe(F.col("u")) & (F.col("th") == F.col("t")) & F.col("doc_id").eqNullSafe(F.col("d"))
    words = words.join(told.select(F.col("doc_id").alias("d"), F.col("th").alias("t"), F.col("term").alias("u")), key, "left_semi").select("doc_id", "th", "w")
    rows = words.unionByName(each.select("doc_id", "th", F.explode("base").alias("w")))
    base_end, base_start = (F.when(F.col("w.kind") != "term", F.col(f"w.{x}")) for x in ("end", "start"))
    # Within a document: the furthest end of base spans that begin no later, the nearest start of those that begin later.
    by = Window.partitionBy("doc_id", "th").orderBy("w.start")
    rows = rows.withColumn("reach", F.max(base_end).over(by.rangeBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("next", F.min(base_start).over(by.rangeBetween(1, Window.unboundedFollowing)))
    clear = (F.coalesce("reach", F.lit(0)) <= F.col("w.start")) & (F.coalesce("next", F.col("w.end")) >= F.col("w.end"))
    rows = rows.where((F.col("w.kind") == "term") & clear)
    return materialize(rows.groupBy(F.col("doc_id").alias("d"), F.col("th").alias("t")).agg(F.collect_list("w").alias("extra")), "extra")


_SAME = "th = t and doc_id <=> d"
_ALL = "case when extra is null then base else array_sort(concat(base, extra)) end"


def personal_data(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """A row for each row of ``docs``: doc_id, th (hash of the text), base, spans (arrays of start, ord, end, kind, value).

    Spans are in code points, end exclusive, by start, then kind. Base spans always stay; a term that overlaps one adds
    none. Null texts are as empty ones: no spans. Repeated rows get equal results; each counts as a document of the
    corpus, but equal texts support a term once. Other columns are ignored. Empty tables give empty results.
    """
    docs = docs.select(F.col("doc_id").alias("doc_id"), F.col("text").alias("text"))
    found = base_spans(docs.withColumn("th", F.xxhash64("text"))).select("doc_id", "th", "base", F.when(F.size("base") > 0, F.col("text")).alias("text"))
    found = materialize(found, "found")
    named = found.where(F.size("base") > 0)
    more = _told_spans(docs, disclosures(named, docs, threshold))
    return found.drop("text").join(more, F.expr(_SAME), "left").select("doc_id", "th", "base", F.expr(_ALL).alias("spans"))


def sanitised(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """``docs`` (doc_id, text and others) with every span generalised to its kind; n_chars, if there, follows the text.

    Rows without spans pass as they are and are not moved: spans of terms come to the texts if there are at most
    SPANS of them, else by their key. Rows as in ``personal_data``.
    """
    columns, kinds = docs.columns, dict(docs.dtypes)
    whole = F.struct(*columns).alias("whole")
    found = base_spans(docs.select("doc_id", "text", whole).withColumn("th", F.xxhash64("text")))
    named = materialize(found.where(F.size("base") > 0), "found")
    more = _told_spans(docs.select("doc_id", "text"), disclosures(named, docs.select("doc_id", "text"), threshold))
    size = more.agg(F.coalesce(F.sum(F.size("extra")), F.lit(0)).alias("n")).first()["n"]
    more = F.broadcast(more) if size <= SPANS else more

    def clean(rows: DataFrame) -> DataFrame:
        out = rows.join(more, F.expr(_SAME), "left").select("whole", "text", F.expr(_ALL).alias("spans")).withColumn("clean", redacted("text", "spans"))
        new = {"text": F.col("clean"), "n_chars": F.when(F.size("spans") > 0, F.length("clean").cast("long")).otherwise(F.col("whole.n_chars")) if "n_chars" in columns else None}
        return out.select(*((new[c] if c in new else F.col("whole")[c]).cast(kinds[c]).alias(c) for c in columns))

    return clean(found.where(F.size("base") == 0)).unionByName(clean(named))


def redacted(text: str, spans: str):
    """SQL of ``text`` with each of ``spans`` generalised to its kind in brackets; overlapping spans become one, of the
    first one's kind."""
    merged = (
        f"aggregate({spans}, named_struct('at', 0, 'got', cast(array() as array<struct<low:int,high:int,kind:string>>)), (a, s) -> case when s.start >= a.at "
        f"then named_struct('at', s.end, 'got', array_append(a.got, named_struct('low', a.at, 'high', s.start, 'kind', s.kind))) "
        f"else named_struct('at', greatest(a.at, s.end), 'got', a.got) end)"
    )
    pieces = f"transform(m.got, g -> concat(substring({text}, g.low + 1, g.high - g.low), '[', upper(g.kind), ']'))"
    return F.expr(f"case when size({spans}) = 0 or {spans} is null then {text} else transform(array({merged}), m -> concat(array_join({pieces}, ''), substring({text}, m.at + 1)))[0] end")
