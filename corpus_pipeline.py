"""The corpus pipeline: quality, near duplicates, benchmark contamination, personal data, mixture.

A stage passes whole rows on. What it decides of a row travels as doc_id and hash of the text and meets the texts where
they are: sets of rows that go are broadcast up to ``common.BROADCAST_KEYS`` of them, beyond that texts are shuffled once.
Rows without a doc_id are judged by their text. A null text is as an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomery.llm import decontaminate, mixing, neardup, pii, quality
from loomery.llm.common import bounded_batches, materialize, released, scratch, table, without

#: SQL can't express the learned classifier, MinHash links and the seeded sample; tests hold run() against brute force.
ORACLE_SQL = None
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below 0.5 by the classifier go; those without words score 0.5 and stay. Rows are judged one by
    one from their text, so repeated rows and rows without a doc_id go or stay alike."""
    bounded_batches(spark)
    model = quality.learn(docs, table(spark, sf_dir, "labels"))
    return quality.scored(docs.select(*COLUMNS), model, 0.5).where("predicted = 1").select(*COLUMNS)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity of 0.8) one document stays, that of the smallest
    doc_id, once; ``neardup.survivors`` says which rows of a shared doc_id or without one do. Texts without words stay."""
    bounded_batches(spark)
    docs = docs.select(*COLUMNS)
    gone, repeated = neardup.survivors(neardup.near_duplicates(docs, width=5, percent=80))
    docs = without(docs, gone)
    if repeated.isEmpty():
        return docs
    again = docs.join(repeated, F.col("doc_id").eqNullSafe(F.col("d")) & (F.xxhash64("text") == F.col("t")), "left_semi")
    rest = [c for c in COLUMNS if c not in ("doc_id", "text")]
    once = again.groupBy("doc_id", "text").agg(F.min(F.struct(*rest)).alias("x")).select("doc_id", "text", *(F.col(f"x.{c}") for c in rest))
    return without(docs, repeated).unionByName(once.select(*COLUMNS))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go: rows are judged by their own text, also where several share a doc_id or have none.
    Texts without words stay."""
    bounded_batches(spark)
    docs = docs.select(*COLUMNS)
    bad = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark")).where("contaminated")
    return without(docs, materialize(bad.select(F.col("doc_id").alias("d"), F.col("th").alias("t")).distinct(), "bad"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span of personal data, and every term that discloses it, is generalised to its kind; no row goes. Repeated
    rows change alike, null texts stay null."""
    bounded_batches(spark)
    return pii.sanitised(docs.select(*COLUMNS))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture takes it, copies numbered from 1. Rows without a word are taken by their
    source's rate like others. Rows alike in doc_id, text and source are taken as often in all as the mixture says, each of
    them as often as another or once more."""
    bounded_batches(spark)
    docs = docs.select(*COLUMNS).withColumn("source", F.col("source").cast("string"))
    taken = mixing.mixed(docs).groupBy(F.col("doc_id").alias("d"), F.col("source").alias("s"), "h").agg(F.sum("copies").alias("all"), F.count("*").alias("rows"))
    taken = materialize(taken.where("all > 0"), "taken")
    same = (F.col("key") == F.col("h")) & F.col("doc_id").eqNullSafe(F.col("d")) & F.col("source").eqNullSafe(F.col("s"))
    rows = docs.withColumn("key", F.xxhash64("doc_id", "text"))
    copied = lambda df, n: df.select(*COLUMNS, F.explode(F.sequence(F.lit(1).cast("long"), n)).alias("copy"))
    repeated = taken.where("rows > 1")
    if repeated.isEmpty():
        return copied(rows.join(taken, same), F.col("all"))
    # Alike rows are dealt into runs and numbered there, and then behind the runs before, so that no task sorts all of them.
    alike = rows.join(repeated, same).withColumn("run", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.ceil(F.col("rows") / mixing.RUN)))
    alike = materialize(alike, "alike")
    group = ["key", "d", "s"]
    runs = alike.groupBy(*group, "run").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy(*group).orderBy("run").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select(*(F.col(c).alias(f"r_{c}") for c in (*group, "run")), F.coalesce(before, F.lit(0)).alias("before"))
    alike = alike.withColumn("i", F.row_number().over(Window.partitionBy(*group, "run").orderBy(*COLUMNS)))
    alike = alike.join(runs, (F.col("key") == F.col("r_key")) & F.col("d").eqNullSafe(F.col("r_d")) & F.col("s").eqNullSafe(F.col("r_s")) & (F.col("run") == F.col("r_run")))
    more = (F.col("before") + F.col("i") <= F.col("all") % F.col("rows")).cast("long")
    alike = alike.withColumn("copies", F.expr("all div rows") + more).where("copies > 0")
    return copied(rows.join(taken.where("rows = 1"), same), F.col("all")).unionByName(copied(alike, F.col("copies")))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("minhash_near_dedup", minhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("personal_data", personal_data),
    ("source_mixing", source_mixing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stage's intermediate tables are deleted once its output is written, its input once the next output is."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scratch() as keep:
            out = keep(materialize(stage(spark, docs, sf_dir), name))
        released(docs)
        docs = out
    return STAGES[-1][1](spark, docs, sf_dir)
