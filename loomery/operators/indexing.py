"""Vectors of search units: passages, content keys, a dictionary of vectors, incremental encoding, completeness."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import wordpiece
from .ingest import to_encode
from .represent import chunks, retrieval_spans, sections
from .retrieval import content_hash, pending

DIM, TOLERANCE = 384, 1e-3


class Vectorizer(Protocol):
    """An encoder: ``name`` pins model and preprocessing; ``embed`` gives unit vectors of ``dim`` numbers."""

    name: str
    dim: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


class HashEncoder:
    """Needs no model: a text falls into a few signed buckets for each of its words."""

    def __init__(self, dim: int = DIM, rounds: int = 4):
        self.dim, self.rounds, self.name = dim, rounds, f"hash-{dim}-{rounds}"

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim))
        for row, text in zip(out, texts, strict=True):
            for word in text.lower().split() or [""]:
                data = hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=4 * self.rounds).digest()
                for i in range(self.rounds):
                    n = int.from_bytes(data[4 * i : 4 * i + 4], "little")
                    row[n % self.dim] += 1 if n >> 31 else -1
            if not row.any():
                row[0] = 1
        return out / np.linalg.norm(out, axis=1, keepdims=True)


class OnnxEncoder:
    """Mean-pooled sentence vectors of an ONNX model and a tokenizer file, both given by path; loaded in the worker."""

    def __init__(self, model: str, tokenizer: str, dim: int = DIM, name: str = ""):
        self.model, self.tokenizer, self.dim, self.name, self.loaded = model, tokenizer, dim, name or model, None

    def __getstate__(self):
        return self.__dict__ | {"loaded": None}

    def embed(self, texts: list[str]) -> np.ndarray:
        if self.loaded is None:
            import onnxruntime
            from tokenizers import Tokenizer

            words = Tokenizer.from_file(self.tokenizer)
            words.enable_truncation(256)
            words.enable_padding()
            self.loaded = onnxruntime.InferenceSession(self.model), words
        session, words = self.loaded
        found = words.encode_batch(texts)
        ids, mask = (np.array([getattr(f, x) for f in found], np.int64) for x in ("ids", "attention_mask"))
        feed = {"input_ids": ids, "attention_mask": mask, "token_type_ids": np.zeros_like(ids)}
        hidden = session.run(None, {i.name: feed[i.name] for i in session.get_inputs()})[0]
        mean = (hidden * mask[:, :, None]).sum(axis=1) / np.maximum(1, mask.sum(axis=1, keepdims=True))
        return mean / np.linalg.norm(mean, axis=1, keepdims=True)


def encoded(texts: Column, encoder: Vectorizer) -> Column:
    """Vectors of ``texts``; one that isn't finite and of unit length fails the job."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            got = np.asarray(encoder.embed([t or "" for t in batch]), np.float64)
            if got.shape != (len(batch), encoder.dim) or not np.isfinite(got).all() or (abs(np.linalg.norm(got, axis=1) - 1) > TOLERANCE).any():
                raise ValueError(f"{encoder.name} gave vectors that aren't finite, of unit length and of {encoder.dim} numbers")
            yield pd.Series(list(got.astype(np.float32)))

    return run(texts)


def passages(documents: DataFrame, vocabulary: list[str] | None = None) -> DataFrame:
    """With ``vocabulary`` pieces fit 256 WordPiece tokens, else as many words and marks.

    (id, repo, number, chunk, field, start, end, text): titles, and bodies in pieces; of tickets' bodies only the sections
    worth indexing. Bytes count from the field's begin."""
    keep = ["id", "repo", "number"]
    family = F.col("family")
    title = documents.where("title <> ''").select(*keep, F.when(family == "labels", "labels").otherwise("title").alias("field"), F.lit(0).alias("base"), F.col("title").alias("text"))
    spans = F.when(family == "issue", retrieval_spans(sections("body")))
    field = F.when(family == "issue", "body").when(family == "review", "review_comment").otherwise("comment")
    body = documents.where("body <> ''").withColumn("spans", spans).withColumn("raw", F.col("body").cast("binary"))
    parts = F.when(family == "issue", F.transform("spans", lambda s: F.struct(s["start"].alias("base"), F.substring("raw", s["start"] + 1, s["end"] - s["start"]).cast("string").alias("text"))))
    parts = parts.otherwise(F.array(F.struct(F.lit(0).alias("base"), F.col("body").alias("text"))))
    body = body.select(*keep, field.alias("field"), F.explode_outer(parts).alias("p")).where("p is not null").select(*keep, "field", "p.base", "p.text")
    rows = title.unionByName(body).withColumn("c", F.explode_outer(chunks("text") if vocabulary is None else wordpiece.chunks(F.col("text"), vocabulary))).where("c is not null")
    rows = rows.select(*keep, "field", (F.col("base") + F.col("c.start")).alias("start"), (F.col("base") + F.col("c.end")).alias("end"), F.col("c.text").alias("text"))
    order = F.struct(F.when(F.col("field").isin("title", "labels"), 0).otherwise(1).alias("o"), "start", "end", "field", "text")
    rows = rows.groupBy(*keep).agg(F.array_sort(F.collect_list(order)).alias("all")).select(*keep, F.posexplode("all").alias("chunk", "x"))
    return rows.select(*keep, "chunk", "x.field", "x.start", "x.end", "x.text")


def indexed(documents: DataFrame, states: DataFrame, vectors: DataFrame, encoder: Vectorizer, write: Callable[[DataFrame, str], DataFrame]) -> dict[str, DataFrame]:
    """One step of incremental indexing: new ``states`` (id, model, content_hash, chunks, complete), ``vectors`` (key, vector) and the
    ``passages`` of what was pending. Texts whose key the dictionary has aren't encoded again; keys of no passage are pruned by ``pruned``.

    ``write`` puts a table into the generation and reads it back, so that nothing is encoded twice.
    """
    todo = write(pending(documents, states, encoder.name), "pending")
    rows = passages(documents.join(todo.select("id"), "id", "left_semi"))
    zero = F.lit("\x00")
    rows = write(rows.withColumn("key", F.sha2(F.concat(F.lit(encoder.name), zero, F.lit("2"), zero, "text"), 256)), "passages")
    new = write(to_encode(rows.drop("key"), vectors, encoder.name).select("key", encoded(F.col("text"), encoder).alias("vector")), "vectors")
    count = rows.groupBy("id").agg(F.count("*").cast("int").alias("chunks"))
    done = todo.join(count, "id", "left").select("id", F.lit(encoder.name).alias("model"), "content_hash", F.coalesce("chunks", F.lit(0)).alias("chunks"), F.lit(True).alias("complete"))
    here = documents.select("id")
    old = states.join(done.select("id"), "id", "left_anti").join(here, "id", "left_semi").select("id", "model", "content_hash", "chunks", "complete")
    return {"passages": rows, "vectors": vectors.select("key", "vector").unionByName(new), "states": old.unionByName(done)}


def pruned(vectors: DataFrame, rows: DataFrame) -> DataFrame:
    return vectors.join(rows.select("key"), "key", "left_semi")


def searchable(rows: DataFrame, states: DataFrame, documents: DataFrame, tickets: DataFrame, vectors: DataFrame, model: str) -> DataFrame:
    """Passages of complete documents of ``model`` with their vectors: an own one, else the dictionary's."""
    done = states.where(F.col("complete") & (F.col("model") == model)).select("id")
    rows = rows.join(done, "id", "left_semi").join(documents.select("id"), "id", "left_semi").join(tickets.select("repo", "number"), ["repo", "number"], "left_semi")
    rows = rows.join(vectors.select("key", F.col("vector").alias("shared")), "key", "left")
    own = F.col("vector") if "vector" in rows.columns else F.lit(None).cast("array<float>")
    return rows.withColumn("vector", F.coalesce(own, "shared")).drop("shared")


def progress(documents: DataFrame, states: DataFrame, model: str) -> DataFrame:
    """One row: documents, indexed, pending, chunks."""
    done = states.where(F.col("complete") & (F.col("model") == model)).select("id", F.col("content_hash").alias("h"), "chunks")
    rows = documents.select("id", content_hash().alias("content_hash")).join(done, "id", "left")
    good = F.coalesce(F.col("h") == F.col("content_hash"), F.lit(False))
    return rows.agg(F.count("*").alias("documents"), F.count_if(good).alias("indexed"), F.count_if(~good).alias("pending"), F.coalesce(F.sum(F.when(good, F.col("chunks"))), F.lit(0)).cast("long").alias("chunks"))
