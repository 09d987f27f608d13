"""Unit vectors, attractors, similarity search and class balancing.

Vectors are ``array<double>`` columns (``VectorUDT`` only at the ML boundary). Attractor sets are small by
construction (at most 5 per dimension) and are the stated query set of similarity search: their matrix is broadcast,
every Arrow batch of the pool is multiplied with it in blocks, and only rows that can be among a batch's k best of an
attractor leave the task, before the ``row_number() <= k`` window ranks them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cantoria.fixed import BAND_HI, BAND_LO, SEED, TOPK_MAX
from cantoria.functions.scores import ordinal
from cantoria.functions.text import tokens
from cantoria.session import written

ATTRACTOR_BLOCK = 512          # J7 compares a batch with so many attractors at once
HASH_DIM = 64


# --------------------------------------------------------------------------------------------- M3 / M4
def token_bucket(t: Column, dim: int = HASH_DIM) -> Column:
    """Bucket of a token: first 8 hex digits of its md5, modulo ``dim`` (identical in DuckDB)."""
    return F.pmod(F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("bigint"), F.lit(dim)).cast("int")


HELD_TOKENS = 1 << 18          # tokens whose bucket a Python worker remembers
_BUCKETS: dict[str, int] = {}


def _bucket_counts(dim: int) -> Callable[[pa.Array], pa.Array]:
    """Counts of the buckets of the tokens of every row: a token that a batch holds often is hashed once."""
    def counts(arr: pa.Array) -> pa.Array:
        if isinstance(arr, pa.ChunkedArray):
            arr = arr.combine_chunks()
        n = len(arr)
        sizes = pc.fill_null(pc.list_value_length(arr), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        words = arr.flatten().dictionary_encode()
        if len(_BUCKETS) > HELD_TOKENS:
            _BUCKETS.clear()
        found = np.empty(len(words.dictionary), np.int64)
        for i, t in enumerate(words.dictionary.to_pylist()):
            h = _BUCKETS.get(t)
            if h is None:
                h = _BUCKETS[t] = int(hashlib.md5(t.encode()).hexdigest()[:8], 16)
            found[i] = h % dim
        cells = np.repeat(np.arange(n) * dim, sizes) + found[words.indices.to_numpy(zero_copy_only=False)]
        none = np.repeat(arr.is_null().to_numpy(zero_copy_only=False), dim) if arr.null_count else None
        out = pa.array(np.bincount(cells, minlength=n * dim).astype(float), mask=none)
        return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * dim), out)
    return counts


def hash_encode(text: Column, dim: int = HASH_DIM, mode: str = "runs") -> Column:
    """M3 default encoder (offline, no weights): hashed token counts (``token_bucket``) as array<double> of length ``dim``,
    nulls for a null text. Tokens are cut in the row; their buckets are counted batch by batch in Arrow, as a projection: no
    explode, no shuffle."""
    return F.arrow_udf(T.ArrayType(T.DoubleType()))(_bucket_counts(dim))(tokens(text, mode))


def encode_with(df: DataFrame, text_col: str, factory: Callable[[], Callable[[list[str]], np.ndarray]],
                out_col: str = "features", batch_size: int = 256) -> DataFrame:
    """M3 with a pluggable encoder: ``factory()`` runs once per task (e.g. loads a model), the returned callable
    maps a list of texts to an (n, d) array; vectors go back as they are in memory, other columns untouched (``mapInArrow``)."""
    schema = T.StructType([*df.schema.fields, T.StructField(out_col, T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = factory()
        for batch in batches:
            texts = ["" if t is None or t != t else str(t) for t in batch.column(text_col).to_pylist()]
            for i in range(0, len(texts), batch_size):
                part = batch.slice(i, batch_size)
                vecs = np.asarray(enc(texts[i:i + batch_size]), dtype=float)
                at = pa.array(np.arange(len(vecs) + 1, dtype=np.int32) * vecs.shape[1])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(at, pa.array(vecs.ravel()))], names=[*part.schema.names, out_col])
    return df.mapInArrow(run, schema)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))


def l2_normalize(v: Column) -> Column:
    """M4: unit vector (a zero vector stays zero). The vector is bound once as the element of a one-element array; its
    squared norm is the accumulator of ``aggregate`` and the scaling happens in its finish function, so neither the norm
    nor the input is re-evaluated per element, and the input may be a Python encoder."""
    def unit(w):
        return F.aggregate(w, F.lit(0.0), lambda a, x: a + x * x,
                           lambda a: F.when(a > 0, F.transform(w, lambda x: x / F.sqrt(a))).otherwise(w))
    return F.element_at(F.transform(F.array(v), unit), 1)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


# --------------------------------------------------------------------------------------------- M6 / M5
def weighted_centroid(df: DataFrame, by: str, vec: str, weight: str) -> DataFrame:
    """M6: per group, the weight-weighted mean of the vectors, scaled to unit length. The weighted mean is
    Spark ML's ``Summarizer`` — a JVM vector aggregate with partial aggregation, no per-element explode."""
    from pyspark.ml.stat import Summarizer
    m = (df.select(by, array_to_vector(vec).alias("_v"), F.col(weight).cast("double").alias("_w"))
         .groupBy(by).agg(Summarizer.mean(F.col("_v"), F.col("_w")).alias("_m")))
    return m.select(by, l2_normalize(vector_to_array("_m")).alias("centroide"))


def silhouette(df: DataFrame, vec: str, pred: str) -> float:
    """Mean silhouette (Spark's evaluator; its default distance is squared Euclidean)."""
    d = df.select(array_to_vector(vec).alias("features"), F.col(pred).alias("prediction"))
    return ClusteringEvaluator(featuresCol="features", predictionCol="prediction").evaluate(d)


# --------------------------------------------------------------------------------------------- J7 / F3
def similarity_topk(pool: DataFrame, attractors: DataFrame, vec: str, key_cols: list[str],
                    attractor_cols: list[str], k: int = TOPK_MAX) -> DataFrame:
    """Inner product of unit vectors; per attractor the min(k, N) best pool rows (rank 1 = most similar; ties by
    the pool key). ``attractors`` is the query set: its matrix is held by every task, whatever its number of rows."""
    att = attractors.select(*attractor_cols, "centroide").orderBy(*attractor_cols).toPandas()
    matrix = np.array(att["centroide"].tolist(), dtype=float).reshape(len(att), -1)
    shared = pool.sparkSession.sparkContext.broadcast((matrix, att[attractor_cols]))
    fields = {f.name: f for f in [*pool.select(*key_cols).schema, *attractors.select(*attractor_cols).schema]}
    schema = T.StructType([fields[c] for c in [*key_cols, *attractor_cols]]).add("sim", "double")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        centres, names = shared.value
        for pdf in batches:
            if not len(pdf):
                continue
            x = np.array(pdf["_v"].tolist(), dtype=float)
            for start in range(0, len(centres), ATTRACTOR_BLOCK):
                sims = x @ centres[start:start + ATTRACTOR_BLOCK].T
                # rows within rounding of the batch's k-th best stay: ties are settled by the window
                least = np.partition(sims, -k, axis=0)[-k] if len(sims) > k else np.full(sims.shape[1], -np.inf)
                row, col = np.nonzero(sims >= least - 1e-8)
                out = pd.concat([pdf[key_cols].iloc[row].reset_index(drop=True), names.iloc[col + start].reset_index(drop=True)], axis=1)
                out["sim"] = sims[row, col]
                yield out

    sims = pool.select(*key_cols, F.col(vec).alias("_v")).mapInPandas(run, schema)
    sims = sims.withColumn("similitud_coseno", F.round("sim", 9)).drop("sim")
    w = Window.partitionBy(*attractor_cols).orderBy(F.desc("similitud_coseno"), *key_cols)
    return sims.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def band(df: DataFrame, lo: float = BAND_LO, hi: float = BAND_HI, col: str = "similitud_coseno") -> DataFrame:
    """keep lo <= similarity <= hi (both inclusive)."""
    return df.where(F.col(col).between(lo, hi))


# --------------------------------------------------------------------------------------------- J8 / M7
KNN_BLOCK = 2048
KNN_HELD = 32768               # J8, X8: rows of a class that a task holds while the whole class streams by
KNN_SPREAD = 8                 # blocks of a class that is small enough for fewer
PAIR_CELLS = 1 << 22           # pairs compared by one product


def facing(rows: DataFrame, id_col: str, by: str, block: int = KNN_BLOCK) -> DataFrame:
    """Every block of a class facing its whole class: sorted partitions with, for each (by, _q), the rows of block _q
    (``_ask``) and then all rows of the class by id. A class has a block a ``block`` rows at first and a block a
    ``KNN_HELD`` rows once these are more than ``KNN_SPREAD``, so a row is copied so many times only."""
    many = F.greatest(F.ceil(F.col("_n") / max(KNN_HELD, block)), F.least(F.ceil(F.col("_n") / block), F.lit(KNN_SPREAD)))
    sizes = rows.groupBy(by).agg(F.count(F.lit(1)).alias("_n")).select(by, many.cast("int").alias("_b"))
    rows = rows.join(sizes, by)
    asked = rows.withColumn("_q", F.pmod(F.xxhash64(id_col), F.col("_b")).cast("int")).withColumn("_ask", F.lit(True))
    given = rows.withColumn("_q", F.explode(F.sequence(F.lit(0), F.col("_b") - 1))).withColumn("_ask", F.lit(False))
    both = asked.unionByName(given).drop("_b")
    return both.repartition(by, "_q").sortWithinPartitions(by, "_q", F.desc("_ask"), id_col)


def faced(batches: Iterator, by: str) -> Iterator[tuple[object, Iterator]]:
    """(class, its parts as (asked?, table)) of each block in the Arrow batches of a partition of ``facing``. The parts of
    a block must be used up before the next block is taken."""
    def pieces():
        for batch in batches:
            if not batch.num_rows:
                continue
            group, q, ask = batch.column(by).to_pylist(), batch.column("_q").to_pylist(), batch.column("_ask").to_pylist()
            start = 0
            for i in range(1, len(q) + 1):
                if i == len(q) or (group[i], q[i], ask[i]) != (group[start], q[start], ask[start]):
                    yield (group[start], q[start]), ask[start], batch.slice(start, i - start)
                    start = i
    for (group, _), parts in groupby(pieces(), key=lambda piece: piece[0]):
        yield group, ((ask, part) for _, ask, part in parts)


def matrix(column) -> np.ndarray:
    """The rows of an Arrow list column."""
    return np.asarray(column.flatten(), dtype=float).reshape(len(column), -1)


def exact_squares(x: np.ndarray, y: np.ndarray, row: np.ndarray, col: np.ndarray) -> np.ndarray:
    """Squared distances of the pairs (row, col) by differences: equal vectors get 0 exactly."""
    out = np.empty(len(row))
    for at in range(0, len(row), 65536):
        s = slice(at, at + 65536)
        out[s] = ((y[col[s]] - x[row[s]]) ** 2).sum(axis=1)
    return out


def _nearer(x, xid, y, yid, k, best, who):
    """Takes the candidates (y, yid), which follow in order of the id, into the lists of the k nearest of every row."""
    xx, yy = (x ** 2).sum(axis=1), (y ** 2).sum(axis=1)
    slack = 1e-9 * (1.0 + sum(z[np.isfinite(z)].max(initial=0.0) for z in (xx, yy)))
    size = max(1, PAIR_CELLS // len(y))
    # ids as numbers: to compare them as objects, pair by pair, costs more than the distances
    number = {}
    yown = np.array([number.setdefault(i, len(number)) for i in yid])
    xown = np.array([number.get(i, -1) for i in xid])
    unique = len(number) == len(yid)                      # then an id's number is its place
    # one product gives |x|^2 + |y|^2 - 2 xy
    wide = np.hstack([x, xx[:, None], np.ones((len(x), 1))])
    tall = np.vstack([-2.0 * y.T, np.ones((1, len(y))), yy[None, :]])
    for at in range(0, len(x), size):
        s = slice(at, at + size)
        near = wide[s] @ tall
        if unique:
            own = np.flatnonzero(xown[s] >= 0)
            near[own, xown[s][own]] = np.inf
        else:
            near[xown[s][:, None] == yown[None, :]] = np.inf
        limit = best[s, -1] ** 2
        if np.isinf(limit).any() and len(y) > k:
            limit = np.fmin(limit, np.partition(near, k - 1, axis=1)[:, k - 1])
        row, col = np.nonzero(near <= limit[:, None] + slack)
        keep = np.isfinite(near[row, col])
        row, col = row[keep], col[keep]
        dist = np.sqrt(exact_squares(x[s], y, row, col))
        keep = dist < best[s, -1][row]                    # an equal one comes later by id
        row, col, dist = row[keep], col[keep], dist[keep]
        if not len(row):
            continue
        order = np.lexsort((col, dist, row))
        row, col, dist = row[order], col[order], dist[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        first = place < k
        row, col, dist, place = row[first], col[first], dist[first], place[first]
        touched = np.unique(row)
        new = np.full((len(touched), k), np.inf)
        names = np.full((len(touched), k), None, dtype=object)
        here = np.searchsorted(touched, row)
        new[here, place], names[here, place] = dist, yid[col]
        both = np.concatenate([best[at + touched], new], axis=1)
        take = np.argsort(both, axis=1, kind="stable")[:, :k]
        best[at + touched] = np.take_along_axis(both, take, 1)
        who[at + touched] = np.take_along_axis(np.concatenate([who[at + touched], names], axis=1), take, 1)


KNN_PACK = 4096                # J8: rows of a class that travel as one compressed matrix


def numbered(df: DataFrame, order: str, out: str) -> DataFrame:
    """``df`` with numbers that follow ``order`` (increasing, not gapless). Write the result once: it is for one use only."""
    return df.repartitionByRange(order).sortWithinPartitions(order).withColumn(out, F.monotonically_increasing_id())


def _packs(batches: Iterator, id_col: str, by: str) -> Iterator:
    """(by, first id, ids, vectors) of runs of rows of one class, in the order they come."""
    for batch in batches:
        group = batch.column(by).to_pylist()
        start = 0
        for i in range(1, len(group) + 1):
            if i < len(group) and group[i] == group[start] and i - start < KNN_PACK:
                continue
            part = batch.slice(start, i - start)
            ids = pa.RecordBatch.from_arrays([part.column(id_col)], names=["id"])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, ids.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_batch(ids)
            raw = np.ascontiguousarray(matrix(part.column("_v"))).tobytes()
            yield pa.RecordBatch.from_arrays([part.column(by).slice(0, 1), part.column(id_col).slice(0, 1), pa.array([sink.getvalue().to_pybytes()], pa.binary()),
                                              pa.array([pa.compress(raw, "zstd", asbytes=True)], pa.binary()), pa.array([len(raw)], pa.int64())],
                                             names=[by, "_first", "_ids", "_rows", "_size"])
            start = i


def _unpacked(part) -> Iterator[tuple[list, np.ndarray]]:
    """(ids, vectors) of each pack of an Arrow batch."""
    for ids, rows, size in zip(part.column("_ids").to_pylist(), part.column("_rows").to_pylist(), part.column("_size").to_pylist()):
        names = pa.ipc.open_stream(ids).read_all().column("id").to_pylist()
        yield names, np.frombuffer(pa.decompress(rows, size, "zstd", asbytes=True)).reshape(len(names), -1)


def knn_exact(df: DataFrame, id_col: str, vec: str, by: str, k: int = 5, block: int = KNN_BLOCK, asked: DataFrame | None = None) -> DataFrame:
    """The k nearest rows (Euclidean distance, ties by id) inside each class, of every row or of those whose ids
    ``asked`` has. The asked rows of a class are cut into blocks by the hash of the id; a task holds one block with its k
    nearest so far, and the whole class streams by in order of the id as compressed matrices, of which each block gets a
    copy. A product of matrices tells which pairs can be among the nearest, and those are settled by differences. So no
    pair table and no whole class is ever in one task, and at most k rows per asked row leave it. Rows without a vector take
    no part."""
    rows = df.where(F.col(vec).isNotNull() & F.col(by).isNotNull()).select(id_col, by, F.col(vec).cast("array<double>").alias("_v"))
    own, kind = df.schema[id_col].dataType, df.schema[by].dataType
    schema = T.StructType([T.StructField(id_col, own), T.StructField("vecino", own), T.StructField(by, kind),
                           T.StructField("dist", T.DoubleType())])
    packed = T.StructType([T.StructField(by, kind), T.StructField("_first", own), T.StructField("_ids", T.BinaryType()),
                           T.StructField("_rows", T.BinaryType()), T.StructField("_size", T.LongType())])

    def nearest(batches: Iterator) -> Iterator:
        for group, parts in faced(batches, by):
            held, x = [], None
            for ask, part in parts:
                if ask:
                    held.append((np.array([*part.column("_first").to_pylist(), None], dtype=object)[:-1], matrix(part.column("_v"))))
                    continue
                if not held:
                    continue
                if x is None:
                    kinds = [part.schema.field(c).type for c in ("_first", "_first", by)] + [pa.float64()]
                    xid, x = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
                    best, who = np.full((len(x), k), np.inf), np.full((len(x), k), None, dtype=object)
                for names, v in _unpacked(part):
                    _nearer(x, xid, v, np.array([*names, None], dtype=object)[:-1], k, best, who)
            if x is None:
                continue
            for at in range(0, len(x), 8192):
                row, col = np.nonzero(np.isfinite(best[at:at + 8192]))
                columns = (xid[at + row], who[at + row, col], [group] * len(row), best[at + row, col])
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds)], names=schema.names)

    wanted = rows if asked is None else rows.join(asked.select(id_col).distinct(), id_col, "left_semi")
    many = F.greatest(F.ceil(F.col("_n") / max(KNN_HELD, block)), F.least(F.ceil(F.col("_n") / block), F.lit(KNN_SPREAD)))
    sizes = wanted.groupBy(by).agg(F.count(F.lit(1)).alias("_n")).select(by, many.cast("int").alias("_b"))
    wanted = wanted.join(sizes, by).select(by, F.col(id_col).alias("_first"), "_v", F.pmod(F.xxhash64(id_col), F.col("_b")).cast("int").alias("_q"), F.lit(True).alias("_ask"))
    packs = rows.repartitionByRange(by, id_col).sortWithinPartitions(by, id_col).mapInArrow(lambda batches: _packs(batches, id_col, by), packed)
    packs = packs.join(sizes, by).withColumn("_q", F.explode(F.sequence(F.lit(0), F.col("_b") - 1))).withColumn("_ask", F.lit(False)).drop("_b")
    both = wanted.unionByName(packs, allowMissingColumns=True).repartition(by, "_q").sortWithinPartitions(by, "_q", F.desc("_ask"), "_first")
    found = both.mapInArrow(nearest, schema)
    w = Window.partitionBy(id_col).orderBy("dist", "vecino")
    return found.withColumn("orden", F.row_number().over(w)).where(F.col("orden") <= k)


# --------------------------------------------------------------------------------------------- M18
def cached_vectors(df: DataFrame, text_col: str, path: str, encoder: str, encode) -> DataFrame:
    """Key, text, vector and whether the cache held it, for the distinct texts of ``df``. The cache is a Parquet
    folder keyed by md5(text | encoder id); missing texts are encoded (``encode(df)`` adds ``vec``), appended and read
    back with the others."""
    want = df.select(F.md5(F.concat(F.col(text_col), F.lit("|" + encoder))).alias("clave"), F.col(text_col))
    want = want.where(F.col(text_col).isNotNull()).dropDuplicates(["clave"])
    before = read_cache(df.sparkSession, path)
    fresh = want if before is None else want.join(before.select("clave"), "clave", "left_anti")
    encode(fresh).select("clave", F.col(text_col).alias("texto"), "vec").write.mode("append").parquet(path)
    known = F.lit(False)
    if before is not None:
        # ``before`` lists the files of its time: what this call appended is not among them
        want = want.join(before.select("clave", F.lit(True).alias("_held")).dropDuplicates(["clave"]), "clave", "left")
        known = F.coalesce("_held", F.lit(False))
    vectors = read_cache(df.sparkSession, path).dropDuplicates(["clave"])
    return want.withColumn("desde_cache", known).join(vectors.select("clave", "vec"), "clave").select("clave", text_col, "vec", "desde_cache")


def read_cache(spark, path: str) -> DataFrame | None:
    """The vector cache, or None where none was written yet; any other failure to read is raised."""
    try:
        return spark.read.schema("clave string, texto string, vec array<double>").parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def draws(df: DataFrame, id_col: str, by: str, k_max: int = 5, seed: int = SEED, key: str | None = None) -> DataFrame:
    """M7: the rows that classes are topped up from: (by, _j, key, _r, _u) with the number of the synthetic row in its class,
    the base row, the rank of its neighbour and the way to it, all chosen by hash. Empty when there is no neighbour to draw."""
    key = key or id_col
    counts = df.groupBy(by).agg(F.count(F.lit(1)).alias("_n"))
    c = counts.agg(F.max("_n").alias("mx"), F.min("_n").alias("mn")).first()
    kk = min(k_max, (c["mn"] or 0) - 1)
    need = counts.where((F.col("_n") < (c["mx"] or 0)) & F.lit(kk > 0)).select(by, "_n", F.explode(F.sequence(F.lit(0), F.lit(c["mx"] or 0) - F.col("_n") - 1)).alias("_j"))
    h = F.md5(F.concat_ws("|", F.col(by).cast("string"), F.col("_j").cast("string"), F.lit(str(seed))))
    need = need.withColumn("_i", F.pmod(F.conv(F.substring(h, 1, 12), 16, 10).cast("bigint"), F.col("_n")))
    need = need.withColumn("_r", F.pmod(F.conv(F.substring(h, 13, 8), 16, 10).cast("bigint"), F.lit(max(kk, 1))) + 1)
    need = need.withColumn("_u", F.conv(F.substring(h, 21, 12), 16, 10).cast("double") / float(16 ** 12))
    from cantoria.operators.stats import row_index
    narrow = df.select(by, F.col(key).alias("_key"), F.xxhash64(id_col).alias("_h"))
    idx = row_index(narrow, by, "_h").select(by, F.col("_idx").alias("_i"), F.col("_key").alias(key))
    return written(need.join(idx, [by, "_i"]).select(by, "_j", key, "_r", "_u"), "draws")


def oversample(df: DataFrame, id_col: str, vec: str, labels: list[str], by: str, neighbours: DataFrame,
               k_max: int = 5, seed: int = SEED, key: str | None = None, drawn: DataFrame | None = None) -> DataFrame:
    """M7: every class topped up to the largest class; synthetic row = x + u * (neighbour - x) on the vector
    and the labels, labels then half-even rounded and clipped to 0..3. Base rows and neighbours are chosen by
    hash (``draws``); skipped when k = min(k_max, smallest class - 1) <= 0. ``key``: the column by which ``neighbours`` (and
    ``drawn``) name a row, ``id_col`` unless given. Returns real + synthetic rows."""
    key = key or id_col
    drawn = draws(df, id_col, by, k_max, seed, key) if drawn is None else drawn
    real = df.select(id_col, by, vec, *labels, F.lit(False).alias("sintetico")).withColumn(id_col, F.col(id_col).cast("string"))
    nb = neighbours.select(F.col(key), F.col("vecino"), F.col("orden").alias("_r"))
    base = drawn.join(nb, [key, "_r"]).join(df.drop(by), key)
    other = df.select(F.col(key).alias("vecino"), F.col(vec).alias("_nv"), *[F.col(l).alias(f"_n_{l}") for l in labels])
    base = base.join(other, "vecino")
    newv = F.zip_with(vec, "_nv", lambda x, y: x + F.col("_u") * (y - x))
    synth = base.select(F.concat(F.col(id_col).cast("string"), F.lit("#"), F.col("_j").cast("string")).alias(id_col),
                        by, newv.alias(vec),
                        *[ordinal(F.col(l) + F.col("_u") * (F.col(f"_n_{l}") - F.col(l))).alias(l) for l in labels],
                        F.lit(True).alias("sintetico"))
    return real.unionByName(synth)


def to_ml(df: DataFrame, vec: str, out: str = "features") -> DataFrame:
    return df.withColumn(out, array_to_vector(vec))


def from_ml(df: DataFrame, col: str, out: str) -> DataFrame:
    return df.withColumn(out, vector_to_array(col))
