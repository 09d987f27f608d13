"""A layout that keeps neighbourhoods — leading eigenvectors of the normalised neighbour graph.

1. ``neighbour_graph``: the exact ``neighbours`` nearest rows of each row, both ways: edges (src, dst) with weight
   1 / sqrt(degree x degree). This is the matrix S; the Laplacian's least eigenvectors are S's greatest ones.
2. Chebyshev blocks: from a block X of ``k + SPARE`` columns, T0 = X, T1 = S X, T(j+1) = 2 S Tj - T(j-1). A product with S is one
   join of edges with rows and one aggregate (sums combine map-side). S's spectrum lies in [-1, 1], where these blocks stay
   well conditioned, so ``DEGREE`` products search the whole span instead of its last power.
3. The inner products of all columns (a fixed number, ``m`` x ``m``, whatever the number of rows) are summed in the tasks and
   by an aggregate; the driver solves that small problem and the best columns start the next cycle, until S x = value x holds
   to ``tol`` or ``cycles`` are over.

The constant eigenvector sqrt(degree) is removed from every block, so parts without a link between them are told apart by the
first coordinates. Coordinates are x / sqrt(degree), scaled so that each has mean square 1 weighted by degree, at any number
of rows; signs are set so that the sum of cubes is positive. Equal eigenvalues leave their plane free, as in any such layout.

Defined results: rows with a null id or vector, and a table of fewer than two such rows, get null coordinates; a coordinate
beyond what the number of rows allows is 0. Ids must be unique. Cost: step 1 compares all pairs of rows in blocks, the rest is
linear in edges; each product writes its rows to the shared checkpoint folder (never a local checkpoint), where they stay.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cantoria.operators.density import _written
from cantoria.operators.vectors import knn_exact

SPARE = 4
DEGREE = 6


def neighbour_graph(df: DataFrame, id_col: str, vec: str, neighbours: int = 15) -> DataFrame:
    """(src, dst, w): the symmetric neighbour graph with S's weights."""
    near = knn_exact(df.withColumn("_all", F.lit(0)), id_col, vec, "_all", neighbours).select(F.col(id_col).alias("src"), F.col("vecino").alias("dst"))
    edges = _written(near.unionByName(near.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    degree = edges.groupBy("src").agg(F.count(F.lit(1)).alias("_n"))
    there = degree.select(F.col("src").alias("dst"), F.col("_n").alias("_m"))
    return _written(edges.join(degree, "src").join(there, "dst").select("src", "dst", "_n", (1 / F.sqrt(F.col("_n") * F.col("_m"))).alias("w")))


def _product(state: DataFrame, edges: DataFrame, col: str, width: int) -> DataFrame:
    """``state`` with ``_s`` = S times the block ``col``."""
    sent = edges.join(state.select(F.col("_id").alias("dst"), F.col(col).alias("_x")), "dst")
    sums = sent.groupBy("src").agg(*[F.sum(F.col("w") * F.col("_x")[i]).alias(f"_s{i}") for i in range(width)])
    return state.join(sums.select(F.col("src").alias("_id"), F.array(*[f"_s{i}" for i in range(width)]).alias("_s")), "_id")


def _matrix(pdf: pd.DataFrame, cols: list[str]) -> np.ndarray:
    return np.hstack([np.array(pdf[c].tolist(), dtype=float).reshape(len(pdf), -1) for c in cols])


def _inner_products(state: DataFrame, cols: list[str], m: int) -> np.ndarray:
    """The m x m inner products of the columns of all blocks: partial sums per task, then an aggregate."""
    def partial(batches):
        total = np.zeros((m, m))
        for pdf in batches:
            if len(pdf):
                x = _matrix(pdf, cols)
                total += x.T @ x
        i, j = np.nonzero(total)
        yield pd.DataFrame({"i": i, "j": j, "v": total[i, j]})

    found = state.select(*cols).mapInPandas(partial, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))
    out = np.zeros((m, m))
    for r in found.collect():          # at most m x m
        out[r["i"], r["j"]] = r["v"]
    return out


def _best(gram: np.ndarray, width: int, degree: int):
    """(values, coefficients over blocks 0..degree, residuals) of the best vectors in the span of these blocks. The last
    row of ``gram`` is the constant eigenvector, which the result is made orthogonal to."""
    q, m = width * (degree + 1), width * (degree + 2)
    u = gram[m, :q] / gram[m, m]
    times = np.zeros((m, q))                                   # S Tj = (T(j+1) + T(j-1)) / 2, S T0 = T1
    for j in range(degree + 1):
        for i in range(width):
            times[(j + 1) * width + i, j * width + i] = 1.0 if j == 0 else 0.5
            if j:
                times[(j - 1) * width + i, j * width + i] = 0.5
    flat = gram[:q, :q] - np.outer(u, u) * gram[m, m]
    across = gram[:q, :m] @ times - np.outer(u, u) * gram[m, m]   # S keeps the constant eigenvector
    twice = times.T @ gram[:m, :m] @ times - np.outer(u, u) * gram[m, m]
    size, basis = np.linalg.eigh((flat + flat.T) / 2)
    keep = size > 1e-10 * max(size.max(), 1e-300)
    white = basis[:, keep] / np.sqrt(size[keep])
    small = white.T @ ((across + across.T) / 2) @ white
    values, turned = np.linalg.eigh(small)
    order = np.argsort(-values)[:width]
    values, coef = values[order], white @ turned[:, order]
    left = np.einsum("ia,ij,ja->a", coef, twice, coef) - values ** 2
    return values, coef, np.sqrt(np.maximum(left, 0.0)), u


def spectral_layout(df: DataFrame, id_col: str, vec: str, k: int = 3, neighbours: int = 15, cycles: int = 20,
                    tol: float = 1e-5) -> DataFrame:
    """``df`` with coordinates ``c1..ck`` that keep neighbourhoods."""
    known = df.where(F.col(id_col).isNotNull() & F.col(vec).isNotNull())
    edges = neighbour_graph(known, id_col, vec, neighbours)
    width = k + SPARE
    start = [F.xxhash64("src", F.lit(i)) / F.lit(2.0 ** 63) for i in range(width)]
    state = edges.groupBy(F.col("src")).agg(F.sqrt(F.max("_n").cast("double")).alias("_u")).select(F.col("src").alias("_id"), F.array("_u").alias("_u"), F.array(*start).alias("_t0"))
    kind = f"_id {edges.schema['src'].dataType.simpleString()}, _u array<double>, _t0 array<double>"
    blocks = [f"_t{j}" for j in range(DEGREE + 2)]
    m = width * (DEGREE + 2)
    state = _written(state)
    empty = state.isEmpty()
    for _ in range(0 if empty else cycles):
        for j in range(DEGREE + 1):
            step = _product(state, edges, f"_t{j}", width)
            nxt = F.col("_s") if j == 0 else F.zip_with("_s", f"_t{j - 1}", lambda a, b: 2 * a - b)
            state = _written(step.select("_id", "_u", *blocks[:j + 1], nxt.alias(f"_t{j + 1}")))
        values, coef, left, u = _best(_inner_products(state, [*blocks, "_u"], m + 1), width, DEGREE)
        found = coef.shape[1]

        def turned(batches, coef=coef, u=u, found=found):
            for pdf in batches:
                if len(pdf):
                    x = _matrix(pdf, blocks[:-1]) @ coef
                    own = np.array(pdf["_u"].tolist(), dtype=float)
                    x = np.hstack([x - own * (u @ coef), np.zeros((len(pdf), width - found))])
                    yield pd.DataFrame({"_id": pdf["_id"], "_u": pdf["_u"], "_t0": list(x)})

        state = _written(state.select("_id", "_u", *blocks[:-1]).mapInPandas(turned, kind))
        if found == 0 or left[:k].max() <= tol:
            break
    raw = [(F.col("_t0")[i] / F.col("_u")[0]).alias(f"c{i + 1}") for i in range(k)]
    placed = state.select("_id", F.pow(F.col("_u")[0], 2).alias("_d"), *raw)
    size = F.sqrt(F.sum("_d"))
    signs = placed.agg(*[F.when(F.sum(F.pow(f"c{i + 1}", 3)) < 0, -size).otherwise(size).alias(f"_g{i + 1}") for i in range(k)])   # one row
    placed = placed.crossJoin(F.broadcast(signs)).select("_id", *[(F.col(f"c{i + 1}") * F.col(f"_g{i + 1}")).alias(f"c{i + 1}") for i in range(k)])
    return df.join(placed, F.col(id_col) == F.col("_id"), "left").drop("_id")
