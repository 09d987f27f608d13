"""Quality by nearest-neighbour voting over latent-semantic vectors.

1. ``features``: every whole text becomes counts of style terms: three-character windows over 16 character classes,
   and marks for repeated words (one pass over the texts, in numpy on Arrow batches).
2. ``fit``: document frequencies of the terms over all documents weigh the counts (log tf x idf, unit length);
   a bounded sample of labelled documents (``sample`` rows, those with the smallest md5 of their id) gives the
   latent space (truncated singular value decomposition by subspace iteration) and the labelled vectors.
3. ``scores``: the labelled vectors are broadcast (``sample`` x ``rank`` floats at most); every document is compared
   with all of them by exact blocked cosine products, and its ``k`` nearest vote, weighted by their similarity.

Defined results: null and empty texts have only a length mark and get a score like any other; a text without a
positive similarity to any labelled one gets the share of label 1 in the sample; without labelled rows every score
is 0.5; documents labelled more than once count once per label row; rows whose label is null do not train; repeated
rows are scored alike; other columns are not carried.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cantoria.llm.common import bounded_batches, spread_key, staged
from cantoria.llm.textbytes import chunks, column_bytes, word_hashes

SAMPLE = 6000
RANK = 48
K = 21
CLASSES = 16
WINDOWS = CLASSES ** 3
#: further terms: neighbouring equal words, equal words two apart, repeats of a word, and powers of two of the length
SAME, NEAR, AGAIN, LENGTH = WINDOWS, WINDOWS + 1, WINDOWS + 2, WINDOWS + 3
TERMS = WINDOWS + 3 + 32
SCHEMA = "id bigint, term array<smallint>, tf array<float>"


def _class_table() -> np.ndarray:
    t = np.zeros(256, np.int64)
    groups = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\r", "\n", None, ".", ",", "!", "#",
              "*", "$%", "&", "|", "<>{}[]()"]
    for i, g in enumerate(groups):
        for c in g or ():
            t[ord(c)] = i + 1
    t[0x80:] = groups.index(None) + 1
    return t


def term_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows x TERMS counts of one chunk of texts."""
    n = len(offsets) - 1
    out = np.zeros((n, TERMS), np.float32)
    sizes = np.diff(offsets)
    if len(data) >= 3:
        c = _class_table()[data]
        window = (c[:-2] * CLASSES + c[1:-1]) * CLASSES + c[2:]
        row = np.repeat(np.arange(n), sizes)
        inside = row[:-2] == row[2:]
        out[:, :WINDOWS] = np.bincount(row[:-2][inside] * WINDOWS + window[inside], minlength=n * WINDOWS).reshape(n, WINDOWS)
    words, first = word_hashes(data, offsets)
    if len(words):
        row = np.repeat(np.arange(n), np.diff(first))
        for term, gap in ((SAME, 1), (NEAR, 2)):
            equal = (words[:-gap] == words[gap:]) & (row[:-gap] == row[gap:])
            out[:, term] = np.bincount(row[:-gap][equal], minlength=n)
        order = np.lexsort((words, row))
        equal = (words[order][1:] == words[order][:-1]) & (row[order][1:] == row[order][:-1])
        out[:, AGAIN] = np.bincount(row[order][1:][equal], minlength=n)
    out[np.arange(n), LENGTH + np.minimum(np.ceil(np.log2(sizes + 1)).astype(int), 31)] = 1
    return out


def _featurize(batches):
    for batch in batches:
        ids = batch.column(0)
        data, offsets = column_bytes(batch.column(1))
        for a, b, part, at in chunks(data, offsets):
            counts = term_counts(part, at)
            rows, terms = np.nonzero(counts)
            ends = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=b - a))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([
                ids.slice(a, b - a), pa.ListArray.from_arrays(ends, pa.array(terms.astype(np.int16))),
                pa.ListArray.from_arrays(ends, pa.array(np.log1p(counts[rows, terms]).astype(np.float32)))], names=["id", "term", "tf"])


def features(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """id, terms and log term frequencies of every document."""
    return docs.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text")).mapInArrow(_featurize, SCHEMA)


def dense(terms: list, tf: list) -> np.ndarray:
    out = np.zeros((len(terms), TERMS), np.float32)
    rows = np.repeat(np.arange(len(terms)), [len(t) for t in terms])
    if len(rows):
        out[rows, np.concatenate([np.asarray(t, dtype=np.int64) for t in terms])] = np.concatenate([np.asarray(v, dtype=np.float32) for v in tf])
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def latent_space(x: np.ndarray, rank: int = RANK, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """TERMS x rank: the leading right singular vectors of x by subspace iteration."""
    used = np.flatnonzero(x.any(axis=0))
    space = np.zeros((x.shape[1], rank), np.float32)
    rank_ = min(rank, len(used), len(x))
    if rank_ == 0:
        return space
    part = x[:, used]
    q = np.random.default_rng(seed).standard_normal((len(used), min(rank_ + 16, len(used)))).astype(np.float32)
    for _ in range(rounds):
        q, _ = np.linalg.qr(part.T @ (part @ q))
    _, _, vt = np.linalg.svd(part @ q, full_matrices=False)
    space[used, :rank_] = (q @ vt.T)[:, :rank_]
    return space


def fit(found: DataFrame, labels: DataFrame, sample: int = SAMPLE, rank: int = RANK) -> dict:
    """idf, latent space, labelled vectors and labels; ``labels``: id, label. Only ``sample`` rows reach the driver."""
    n = found.count()
    frequency = np.zeros(TERMS)
    for r in found.select(F.explode("term").alias("term")).groupBy("term").count().collect():  # at most TERMS rows
        frequency[r["term"]] = r["count"]
    idf = (np.log((1 + n) / (1 + frequency)) + 1).astype(np.float32)
    known = labels.filter(F.col("label").isNotNull() & F.col("id").isNotNull()).orderBy(spread_key("id"), "id", "label").limit(sample)
    rows = found.join(known, "id").orderBy(spread_key("id"), "id", "label").toArrow()
    x = _unit(dense(rows["term"].to_pylist(), rows["tf"].to_pylist()) * idf)
    y = np.asarray(rows["label"].to_pylist(), np.float32)
    space = latent_space(x, rank) * 1.0
    return {"idf": idf, "space": space, "vectors": _unit(x @ space), "labels": y, "share": float(y.mean()) if len(y) else 0.5}


def vote(vectors: np.ndarray, model: dict, k: int = K, block: int = 2048) -> np.ndarray:
    """Similarity-weighted share of label 1 among the k nearest labelled vectors (exact, in blocks)."""
    best = np.full((len(vectors), 0), 0.0, np.float32)
    label = np.zeros((len(vectors), 0), np.float32)
    for a in range(0, len(model["labels"]), block):
        cos = vectors @ model["vectors"][a:a + block].T
        best = np.concatenate([best, cos], axis=1)
        label = np.concatenate([label, np.broadcast_to(model["labels"][a:a + block], cos.shape)], axis=1)
        if best.shape[1] > k:
            top = np.argpartition(-best, k - 1, axis=1)[:, :k]
            best, label = np.take_along_axis(best, top, 1), np.take_along_axis(label, top, 1)
    weight = np.maximum(best, 0) ** 8
    total = weight.sum(axis=1)
    score = np.where(total > 1e-9, (weight * label).sum(axis=1) / np.maximum(total, 1e-9), model["share"])
    return np.clip(score.astype(np.float64), 0.0, 1.0)


def scores(found: DataFrame, model: dict, k: int = K) -> DataFrame:
    """id, score of every document."""
    shared = found.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                x = _unit(dense(part.column("term").to_pylist(), part.column("tf").to_pylist()) * m["idf"])
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(vote(_unit(x @ m["space"]), m, k))], names=["id", "score"])

    return found.mapInArrow(run, "id bigint, score double")


def quality_scores(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and score of every document of docs; ``labels``: key and label (0 or 1) of the rows to learn from."""
    bounded_batches(docs.sparkSession)
    found = staged(features(docs, key, text), "knn")
    model = fit(found, labels.select(F.col(key).alias("id"), F.col("label")))
    return scores(found, model).withColumnRenamed("id", key)
