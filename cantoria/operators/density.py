"""Density topics — clusters of a hierarchy of mutual-reachability distances, the stable ones kept.

1. ``points``: rows of equal vectors are one point with a weight. Its core distance is the distance within which
   ``min_samples`` other rows lie; the distance of two points is the greatest of their distance and both cores. Space is
   cut into cells of about ``block`` points; a point is compared with its own cell and with the cells whose box is not
   farther than its k nearest so far. Exact: a farther box holds no nearer point.
2. ``spanning_tree``: every round each component but the largest takes its least edge to another one (Borůvka), so components
   about halve. A point's list of nearest points settles its edge when that is shorter than the reach of the list; only the
   points of components that the lists do not settle are compared, with the cells whose box is within the least edge
   known of their component and that hold other components. Exact, ties by ids.
3. ``hierarchy``: the tree is contracted by rounds of keyed joins. Two large components (``min_size`` rows and more)
   that choose each other are a split of the hierarchy; small ones join the large one that their least edges lead to.
4. ``stable``: rows sink to the cluster that held them when they joined; stabilities add up by level, and a cluster is
   kept if it is at least as stable as the kept ones below it.
   A tree of up to ``ONE_TASK`` edges (three numbers each) is walked edge by edge in one task, steps 3 and 4 in one job.

Cost: steps 1 and 2 compare all pairs of points in blocks of ``block`` a round at worst (log2 n rounds), where no box can
be left out. Beyond ``ONE_TASK`` edges step 3 takes at most ``min_size`` rounds more than the hierarchy is high, step 4 two
jobs a level; each is a join over edges or clusters. The driver holds a box a cell and a sample of at most ``SAMPLE`` points.

Defined results: a null id or vector, and every row of a table of fewer than ``min_size`` rows, is noise (-1); ids must
be unique; the whole table is never one topic (a table without any split is noise). A row that reaches a cluster only
at the distance at which this cluster meets another belongs to neither. Distances below 1e-12 count as 1e-12.
"""

from __future__ import annotations

import uuid
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cantoria.session import ensure_checkpoint_dir

BLOCK = 2048
SAMPLE = 65536             # points from which the cuts between cells are taken: they decide how even cells are, not what is found
SALTS = 4                  # tasks that share the points which ask for one cell
ONE_TASK = 1 << 22         # edges of a tree that one task walks
LISTED = 16                # nearest points that a point keeps
LEAST = 1e-12


def _written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared checkpoint folder. Rounds build on each other: unlike a checkpoint, a table read
    back carries its true size (small sides are broadcast by it) and no constraints, which double with every round."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/density-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _jump(df: DataFrame, key: str, to: str) -> DataFrame:
    """(key, to) with ``to`` followed to its end; ends point at themselves. Two doublings a job."""
    df = df.select(key, to)
    while True:
        step = df.select(F.col(key).alias("_at"), F.col(to).alias("_then"))
        df = df.join(step, F.col(to) == F.col("_at")).select(key, F.col("_then").alias(to))
        step = df.select(F.col(key).alias("_at"), F.col(to).alias("_then"))
        df = _written(df.join(step, F.col(to) == F.col("_at")).select(key, F.col("_then").alias(to), (F.col("_then") != F.col(to)).alias("_moved")))
        if df.where("_moved").isEmpty():
            return df.select(key, to)


def _against(asked: DataFrame, given: DataFrame, blocks: int, compare, schema: T.StructType) -> DataFrame:
    """``compare(asked rows, given rows)`` for every pair of a block of ``asked`` and one of ``given`` (columns p, x and
    others of the same names on both sides)."""
    own = F.pmod(F.xxhash64("p"), F.lit(blocks)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    both = (asked.select("*", own.alias("_q"), F.lit(True).alias("_ask")).select("*", every.alias("_c"))
            .unionByName(given.select("*", own.alias("_c"), F.lit(False).alias("_ask")).select("*", every.alias("_q"))))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        q, c = pdf[pdf["_ask"]], pdf[~pdf["_ask"]].sort_values("p")
        if not len(q) or not len(c):
            return pd.DataFrame(columns=schema.names)
        return compare(q, c)
    return both.groupBy("_q", "_c").applyInPandas(run, schema)


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances by differences, one coordinate at a time: symmetric, and exactly 0 for equal vectors only."""
    total = np.zeros((len(x), len(y)))
    for i in range(x.shape[1]):
        total += (x[:, i, None] - y[None, :, i]) ** 2
    return np.sqrt(total)


def _matrix(col: pd.Series) -> np.ndarray:
    return np.array(col.tolist(), dtype=float).reshape(len(col), -1)


def _cuts(sample: np.ndarray, n: int, block: int) -> list[tuple[int, float, int, int]]:
    """A tree of cuts (dimension, cut, next if below, next if above; -1: the number of the cell) at medians of the widest
    dimension, until a cell is expected to hold at most ``block`` of n points."""
    nodes: list = []
    cells = [0]

    def grow(x):
        at = len(nodes)
        nodes.append(None)
        width = np.ptp(x, axis=0) if len(x) else np.zeros(1)
        if len(x) * n <= block * max(len(sample), 1) or len(x) < 2 or not width.max() > 0:
            nodes[at] = (-1, 0.0, cells[0], cells[0])
            cells[0] += 1
            return at
        d = int(width.argmax())
        cut = float(np.median(x[:, d]))
        if (x[:, d] <= cut).all():
            cut = float(x[x[:, d] < cut, d].max())
        nodes[at] = (d, cut, grow(x[x[:, d] <= cut]), grow(x[x[:, d] > cut]))
        return at
    grow(sample)
    return nodes


def _celled(pts: DataFrame, block: int) -> DataFrame:
    """The points with the number of their cell."""
    n = pts.count()
    share = min(1.0, SAMPLE / max(n, 1))
    some = pts.where(F.pmod(F.xxhash64("p"), F.lit(1 << 20)) < int(share * (1 << 20))).select("x").limit(2 * SAMPLE).collect()     # bounded
    nodes = _cuts(np.array([r.x for r in some], dtype=float).reshape(len(some), -1), n, block) if n > block and some else [(-1, 0.0, 0, 0)]
    d, cut, low, high = (np.array(c) for c in zip(*nodes))

    def run(batches):
        for pdf in batches:
            x, at = _matrix(pdf["x"]), np.zeros(len(pdf), np.int64)
            while len(pdf) and (d[at] >= 0).any():
                at = np.where(d[at] < 0, at, np.where(x[np.arange(len(x)), np.maximum(d[at], 0)] <= cut[at], low[at], high[at]))
            yield pdf.assign(cell=low[at].astype(np.int32))
    return _written(pts.mapInPandas(run, T.StructType([*pts.schema.fields, T.StructField("cell", T.IntegerType())])))


def _boxes(pts: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cells, least, greatest coordinates) of the cells that hold points."""
    width = pts.select(F.max(F.size("x"))).first()[0] or 0
    ends = [f(F.col("x")[i]).alias(f"{name}{i}") for name, f in (("lo", F.min), ("hi", F.max)) for i in range(width)]
    rows = pts.groupBy("cell").agg(*ends).orderBy("cell").collect()           # one row a cell
    side = lambda name: np.array([[r[f"{name}{i}"] for i in range(width)] for r in rows], dtype=float).reshape(len(rows), width)
    return np.array([r.cell for r in rows], np.int32), side("lo"), side("hi")


def _asking(asked: DataFrame, boxes: tuple, leave=None) -> DataFrame:
    """A row of ``asked`` (columns x, limit and others) for every cell whose box is within its limit, in column ``at``;
    ``leave``(rows, cells) tells pairs that are left out."""
    shared = asked.sparkSession.sparkContext.broadcast(boxes)

    def run(batches):
        cells, lo, hi = shared.value
        for whole in batches:
            for start in range(0, len(whole), 1024):
                pdf = whole.iloc[start:start + 1024]
                x, total = _matrix(pdf["x"]), np.zeros((len(pdf), len(cells)))
                for i in range(x.shape[1]):
                    total += np.maximum(np.maximum(lo[None, :, i] - x[:, i, None], x[:, i, None] - hi[None, :, i]), 0.0) ** 2
                # rounding must not leave out a box
                near = np.sqrt(total) * (1 - 1e-9) <= pdf["limit"].to_numpy()[:, None]
                if leave is not None:
                    near &= ~leave(pdf, cells)
                row, col = np.nonzero(near)
                yield pdf.iloc[row].assign(at=cells[col])
    return asked.mapInPandas(run, T.StructType([*asked.schema.fields, T.StructField("at", T.IntegerType())]))


def _in_cells(asking: DataFrame, given: DataFrame, compare, schema: T.StructType) -> DataFrame:
    """``compare(asking rows, given rows)`` for every cell that is asked for (columns p, x and others of the same names)."""
    columns = [c for c in given.columns if c != "cell"]
    both = (asking.select(*columns, F.col("at").alias("_c"), F.pmod(F.xxhash64("p"), F.lit(SALTS)).cast("int").alias("_s"), F.lit(True).alias("_ask"))
            .unionByName(given.select(*columns, F.col("cell").alias("_c"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_s"), F.lit(False).alias("_ask"))))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        q, c = pdf[pdf["_ask"]], pdf[~pdf["_ask"]].sort_values("p")
        if not len(q) or not len(c):
            return pd.DataFrame(columns=schema.names)
        return compare(q, c)
    return both.groupBy("_c", "_s").applyInPandas(run, schema)


def points(df: DataFrame, id_col: str, vec: str, min_samples: int, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(p, x, n, cell, core, reach) per different vector and (p, q, dist) of the nearest other points. p is the least id of
    the point's rows, n their number; every point closer than ``reach`` is in the list."""
    pts = _celled(_written(df.groupBy(F.col(vec).alias("x")).agg(F.min(id_col).alias("p"), F.count(F.lit(1)).alias("n"))), block)
    k = max(LISTED, min_samples)
    kind = pts.schema["p"].dataType
    schema = T.StructType([T.StructField("p", kind), T.StructField("q", kind), T.StructField("dist", T.DoubleType()), T.StructField("m", T.LongType())])

    def nearest(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        x, y, qid, cid, m, most = _matrix(q["x"]), _matrix(c["x"]), q["p"].to_numpy(), c["p"].to_numpy(), c["n"].to_numpy(), q["limit"].to_numpy()
        parts = []
        for at in range(0, len(x), 256):
            dist = _distances(x[at:at + 256], y)
            dist[qid[at:at + 256][:, None] == cid[None, :]] = np.inf
            limit = most[at:at + 256]
            if len(y) > k:
                limit = np.minimum(limit, np.partition(dist, k - 1, axis=1)[:, k - 1])
            row, col = np.nonzero((dist <= limit[:, None]) & np.isfinite(dist))
            far = dist[row, col]
            order = np.lexsort((col, far, row))                 # c is in order of the id
            row, col, far = row[order], col[order], far[order]
            first = np.arange(len(row)) - np.searchsorted(row, row) < k
            parts.append(pd.DataFrame({"p": qid[at + row[first]], "q": cid[col[first]], "dist": far[first], "m": m[col[first]]}))
        return pd.concat(parts)

    w = Window.partitionBy("p").orderBy("dist", "q")
    plain = pts.select("p", "x", "n", "cell")
    given = plain.withColumn("limit", F.lit(float("inf")))
    own = _written(_in_cells(given.withColumnRenamed("cell", "at"), given, nearest, schema))
    far = own.groupBy("p").agg(F.when(F.count(F.lit(1)) >= k, F.max("dist")).otherwise(F.lit(float("inf"))).alias("limit"))
    asked = plain.join(far, "p", "left").withColumn("limit", F.coalesce("limit", F.lit(float("inf"))))
    asking = _asking(asked, _boxes(pts), lambda pdf, cells: pdf["cell"].to_numpy()[:, None] == cells[None, :])
    near = own.unionByName(_in_cells(asking, given, nearest, schema)).withColumn("i", F.row_number().over(w)).where(F.col("i") <= k)
    near = _written(near.withColumn("have", F.sum("m").over(w.rowsBetween(Window.unboundedPreceding, 0))))
    known = near.join(pts.select("p", "n"), "p").groupBy("p").agg(
        F.min(F.when(F.col("have") + F.col("n") - 1 >= min_samples, F.col("dist"))).alias("core"),
        F.when(F.count(F.lit(1)) >= k, F.max("dist")).otherwise(F.lit(float("inf"))).alias("reach"))
    core = F.when(F.col("n") > min_samples, 0.0).otherwise(F.col("core"))
    full = pts.join(known, "p", "left").select("p", "x", "n", "cell", core.alias("core"), F.coalesce("reach", F.lit(float("inf"))).alias("reach"))
    return _written(full), near.select("p", "q", "dist")


def _edge(w: Column, p: str, q: str) -> Column:
    return F.struct(w.alias("w"), F.least(p, q).alias("u"), F.greatest(p, q).alias("v"))


def spanning_tree(pts: DataFrame, near: DataFrame, block: int = BLOCK) -> DataFrame:
    """(u, v, w): edges of the least spanning tree of the mutual-reachability distances."""
    blocks = max(1, -(-pts.count() // block))
    kind = pts.schema["p"].dataType
    schema = T.StructType([T.StructField("p", kind), T.StructField("q", kind), T.StructField("w", T.DoubleType()),
                           T.StructField("comp", kind), T.StructField("to", kind)])

    def least(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        x, y, qid, cid = _matrix(q["x"]), _matrix(c["x"]), q["p"].to_numpy(), c["p"].to_numpy()
        qc, cc, qr, cr = q["comp"].to_numpy(), c["comp"].to_numpy(), q["core"].to_numpy(), c["core"].to_numpy()
        parts = []
        for at in range(0, len(x), 256):
            s = slice(at, at + 256)
            w = np.maximum(np.maximum(_distances(x[s], y), qr[s][:, None]), cr[None, :])
            w[qc[s][:, None] == cc[None, :]] = np.inf
            # every row's least edges: ties are told apart by the ids of both ends outside
            row, col = np.nonzero(np.isfinite(w) & (w == w.min(axis=1)[:, None]))
            lo, hi = np.minimum(qid[at + row], cid[col]), np.maximum(qid[at + row], cid[col])
            some = pd.DataFrame({"row": row, "p": qid[at + row], "q": cid[col], "w": w[row, col], "comp": qc[at + row], "to": cc[col], "lo": lo, "hi": hi})
            parts.append(some.sort_values(["row", "lo", "hi"]).drop_duplicates("row")[schema.names])
        return pd.concat(parts)

    both = near.join(pts.select("p", F.col("core").alias("_cp")), "p").join(pts.select(F.col("p").alias("q"), F.col("core").alias("_cq")), "q")
    both = both.select("p", "q", F.greatest("dist", "_cp", "_cq").alias("w"))
    both = _written(both.unionByName(both.select(F.col("q").alias("p"), F.col("p").alias("q"), "w")).distinct())
    comps, taken, boxes = _written(pts.select("p", F.col("p").alias("comp"))), [], _boxes(pts)
    rows = lambda d: d.select("p", "x", "core", "comp")
    while True:
        state = _written(pts.join(comps, "p"))
        large = state.groupBy("comp").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "comp").limit(2).collect()
        if len(large) < 2:
            break
        # the largest component waits: every other one takes its least edge, some of them to it
        largest = F.lit(large[0]["comp"]).cast(kind)
        # lists lose what became inside a component
        both = (both.select("p", "q", "w").join(comps, "p").join(comps.select(F.col("p").alias("q"), F.col("comp").alias("to")), "q")
                .where(F.col("comp") != F.col("to")))
        both = _written(both.select("p", "q", "w", "comp", "to"))
        pick = F.min(F.struct(_edge(F.col("w"), "p", "q").alias("e"), "to")).alias("best")
        listed = both.groupBy("comp").agg(pick).select("comp", F.col("best.e.w").alias("limit"))
        rest = _written(state.where(F.col("comp") != largest).join(listed, "comp", "left"))
        # a component without a listed edge gets one, not yet the least, from its two loneliest points
        alone = Window.partitionBy("comp").orderBy(F.desc("core"), "p")
        lonely = rest.where(F.col("limit").isNull()).withColumn("_i", F.row_number().over(alone)).where("_i <= 2")
        first = _written(_against(rows(lonely), rows(state), blocks, least, schema))
        some = first.groupBy("comp").agg(F.min("w").alias("_limit"))
        unsure = rest.join(some, "comp", "left").withColumn("limit", F.coalesce("limit", "_limit"))
        unsure = unsure.where((F.col("reach") <= F.col("limit")) & (F.col("core") <= F.col("limit"))).select("p", "x", "core", "comp", "limit")
        whole = {r.cell: r.comp for r in state.groupBy("cell").agg(F.min("comp").alias("comp"), F.max("comp").alias("_c")).where("comp = _c").collect()}   # at most one a cell
        same = pts.sparkSession.sparkContext.broadcast(whole)

        def leave(pdf, cells, same=same):
            inside = np.array([same.value.get(int(c)) for c in cells], dtype=object)
            return pdf["comp"].to_numpy(dtype=object)[:, None] == inside[None, :]
        asking = _asking(unsure, boxes, leave)
        searched = _in_cells(asking.drop("limit"), state.select("p", "x", "core", "comp", "cell"), least, schema)
        known = both.where(F.col("comp") != largest).select(*schema.names)
        best = _written(searched.unionByName(first).unionByName(known).groupBy("comp").agg(pick).select("comp", "best.e", "best.to"))
        taken.append(best.select("e.*").distinct())
        # every component points along its edge; of the two that chose the same edge, the least is the root
        back = best.select(F.col("comp").alias("_c"), F.col("e").alias("_e"))
        root = F.coalesce((F.col("e") == F.col("_e")) & (F.col("comp") < F.col("to")), F.lit(False))
        hooks = best.join(back, F.col("to") == F.col("_c"), "left").select("comp", F.when(root, F.col("comp")).otherwise(F.col("to")).alias("to"))
        ends = _jump(hooks.unionByName(state.where(F.col("comp") == largest).limit(1).select("comp", F.col("comp").alias("to"))), "comp", "to")
        comps = _written(comps.join(ends, "comp").select("p", F.col("to").alias("comp")))
    if not taken:
        return pts.select(F.col("p").alias("u"), F.col("p").alias("v"), F.col("core").alias("w")).limit(0)
    # two components that chose the same edge in one round gave it once, in different rounds they cannot
    return _written(reduce(DataFrame.unionByName, taken))


def hierarchy(pts: DataFrame, tree: DataFrame, min_size: int) -> tuple[DataFrame, DataFrame]:
    """(p, n, node, w): where and at which distance every point joined; (node, made, at, parent, until): the clusters,
    the round that made them, the distances at which their two parts met and at which they meet another."""
    heavy = F.col("n") >= min_size
    name = lambda made, comp: F.concat(F.lit(f"{made}:"), F.col(comp).cast("string"))
    comps = _written(pts.select(F.col("p").alias("comp"), "n", heavy.alias("big"), F.when(heavy, name(0, "p")).alias("node")))
    placed = [pts.where(heavy).select("p", "n", name(0, "p").alias("node"), F.col("core").alias("w"))]
    nodes = [placed[0].select("node", F.lit(0).alias("made"), F.lit(None).cast("double").alias("at"))]
    parents: list[DataFrame] = []
    loose = _written(pts.where(~heavy).select("p", "n", F.col("p").alias("comp")))        # points of small components
    edges = _written(tree.select("w", "u", "v", F.col("u").alias("a"), F.col("v").alias("b")))
    made = 0
    while not edges.isEmpty():
        made += 1
        ends = edges.select("w", "u", "v", "a", "b").unionByName(edges.select("w", "u", "v", F.col("b").alias("a"), F.col("a").alias("b")))
        least = ends.groupBy(F.col("a").alias("comp")).agg(F.min(F.struct("w", "u", "v", "b")).alias("e"))
        least = least.select("comp", F.struct("e.w", "e.u", "e.v").alias("e"), F.col("e.b").alias("to")).join(comps, "comp")
        far = least.select(F.col("comp").alias("to"), F.col("e").alias("_e"), F.col("n").alias("_n"), F.col("big").alias("_big"), F.col("node").alias("_node"))
        least = least.join(far, "to").withColumn("mutual", F.col("e") == F.col("_e"))
        now = _written(least.select("comp", "to", "e.w", "n", "big", "node", "mutual", "_n", "_big", "_node"))
        first = F.least("comp", "to")
        meet = now.where(F.col("mutual") & F.col("big") & F.col("_big"))
        pair = now.where(F.col("mutual") & ~F.col("big") & ~F.col("_big"))
        # a small component follows least edges to a large one; ends at a pair of small ones, it waits
        waits = ~F.col("big") & ~(F.col("mutual") & ~F.col("_big"))
        ways = _jump(now.select("comp", F.when(waits, F.col("to")).otherwise(F.col("comp")).alias("end")), "comp", "end")
        aims = ways.join(now.select(F.col("comp").alias("end"), F.col("big").alias("_at_big"), F.col("node").alias("_at")), "end").where("_at_big")
        joins = _written(aims.join(now.where(~F.col("big")).select("comp", "w"), "comp").select("comp", "w", "end", F.col("_at").alias("node")))
        grown = pair.where(F.col("n") + F.col("_n") >= min_size)
        # where the points of small components went, and the clusters that came to be
        born = grown.withColumn("_c", first).select("comp", "w", name(made, "_c").alias("node"))
        went = joins.select("comp", "w", "node").unionByName(born)
        placed.append(loose.join(went, "comp").select("p", "n", "node", "w"))
        once = F.col("comp") < F.col("to")
        fresh = name(made, "comp")
        nodes.append(grown.where(once).select(fresh.alias("node"), F.lit(made).alias("made"), F.lit(None).cast("double").alias("at"))
                                 .unionByName(meet.where(once).select(fresh.alias("node"), F.lit(made).alias("made"), F.col("w").alias("at"))))
        parents.append(meet.withColumn("_c", first).select("node", name(made, "_c").alias("parent"), F.col("w").alias("until")))
        # new names of components
        moved = (meet.select("comp", first.alias("new"), F.lit(True).alias("big")).unionByName(
            pair.select("comp", first.alias("new"), (F.col("n") + F.col("_n") >= min_size).alias("big"))))
        large = meet.select(F.col("comp").alias("end"), first.alias("_new"))
        moved = moved.unionByName(joins.join(large, "end", "left").select("comp", F.coalesce("_new", "end").alias("new"), F.lit(True).alias("big")))
        rename = lambda d, c: d.join(moved.select(F.col("comp").alias(c), "new"), c, "left").withColumn(c, F.coalesce("new", c)).drop("new")
        edges = _written(rename(rename(edges, "a"), "b").where(F.col("a") != F.col("b")).select("w", "u", "v", "a", "b"))
        turned = moved.join(meet.select("comp").unionByName(pair.select("comp")), "comp", "left_semi")
        shape = turned.join(comps.select("comp", "n"), "comp").groupBy(F.col("new").alias("comp")).agg(F.sum("n").alias("n"), F.first("big").alias("big"))
        shape = shape.select("comp", "n", "big", F.when(F.col("big"), name(made, "comp")).alias("node"))
        same = comps.join(moved.select("comp"), "comp", "left_anti")
        comps, before = _written(same.unionByName(shape)), loose
        loose = _written(rename(before.join(went.select("comp"), "comp", "left_anti"), "comp").select("p", "n", "comp"))
    all_nodes = reduce(DataFrame.unionByName, nodes)
    up = reduce(DataFrame.unionByName, parents) if parents else all_nodes.select("node", F.col("node").alias("parent"), F.col("at").alias("until")).limit(0)
    return _written(reduce(DataFrame.unionByName, placed)), _written(all_nodes.join(up, "node", "left"))


def _strength(w: Column) -> Column:
    return 1.0 / F.greatest(w, F.lit(LEAST))


def stable(placed: DataFrame, nodes: DataFrame) -> DataFrame:
    """(p, cluster): the kept cluster of every point, null for noise."""
    up = nodes.select("node", "parent", "until")
    still, settled = placed, []
    while True:      # a point that joined after its cluster met another sinks to the cluster above
        step = _written(still.join(up, "node").withColumn("_late", F.coalesce(F.col("w") >= F.col("until"), F.lit(False))))
        settled.append(step.where(~F.col("_late")).select("p", "n", "node", "w"))
        still = step.where("_late").select("p", "n", F.col("parent").alias("node"), "w")
        if still.isEmpty():
            break
    rows = _written(reduce(DataFrame.unionByName, settled))
    own = rows.groupBy("node").agg(F.sum("n").alias("_n"), F.sum(F.col("n") * _strength(F.col("w"))).alias("_s"))
    nodes = _written(nodes.join(own, "node", "left").fillna({"_n": 0, "_s": 0.0}))
    rounds = [r["made"] for r in nodes.select("made").distinct().orderBy("made").collect()]       # one number a round
    done: list[DataFrame] = []
    for made in rounds:
        level = nodes.where(F.col("made") == made)
        if done:
            below = reduce(DataFrame.unionByName, done).groupBy(F.col("parent").alias("node")).agg(F.sum("total").alias("_below"), F.sum("value").alias("_kept"))
            level = level.join(below, "node", "left").fillna({"_below": 0, "_kept": 0.0})
        else:
            level = level.withColumn("_below", F.lit(0).cast("bigint")).withColumn("_kept", F.lit(0.0))
        total = F.col("_n") + F.col("_below")
        held = F.col("_s") + F.when(F.col("_below") > 0, F.col("_below") * _strength(F.col("at"))).otherwise(0.0)
        worth = held - total * _strength(F.col("until"))
        good = F.col("parent").isNotNull() & (worth >= F.col("_kept"))
        done.append(_written(level.select("node", "made", "parent", total.alias("total"), good.alias("good"), F.when(good, worth).otherwise(F.col("_kept")).alias("value"))))
    named: list[DataFrame] = []
    for level in reversed(done):
        mine = F.when(F.col("good"), F.col("node"))
        if named:
            above = reduce(DataFrame.unionByName, named).select(F.col("node").alias("parent"), F.col("cluster").alias("_above"))
            level = level.join(above, "parent", "left").select("node", F.coalesce("_above", mine).alias("cluster"))
        else:
            level = level.select("node", mine.alias("cluster"))
        named.append(_written(level))
    return rows.join(reduce(DataFrame.unionByName, named), "node", "left").select("p", "cluster")


def _walked(n: np.ndarray, core: np.ndarray, u: np.ndarray, v: np.ndarray, w: np.ndarray, min_size: int) -> np.ndarray:
    """The kept cluster of every point (-1: noise): ``hierarchy`` and ``stable`` edge by edge. u, v: places of points in
    order of the id."""
    up, size = list(range(len(n))), n.tolist()
    inside: list = [[i] for i in range(len(n))]                     # points of small components
    node = [-1] * len(n)                                            # cluster of a large component
    at: list = []                                                   # distance at which the parts of a cluster met
    until, parent = [], []                                          # and at which it meets another one, and in which
    place, joined = [-1] * len(n), [0.0] * len(n)

    def born(distance):
        at.append(distance)
        until.append(np.inf)
        parent.append(-1)
        return len(at) - 1

    def join(points, cluster, distance):
        for i in points:
            place[i], joined[i] = cluster, distance

    def find(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i
    for i in range(len(n)):
        if size[i] >= min_size:
            node[i] = born(None)
            join([i], node[i], float(core[i]))
            inside[i] = None
    for e in np.lexsort((v, u, w)).tolist():
        a, b, distance = find(int(u[e])), find(int(v[e])), float(w[e])
        if node[a] >= 0 and node[b] >= 0:
            both = born(distance)
            for c in (node[a], node[b]):
                until[c], parent[c] = distance, both
            node[a] = both
        elif node[a] >= 0 or node[b] >= 0:
            if node[a] < 0:
                a, b = b, a
            join(inside[b], node[a], distance)
        elif size[a] + size[b] >= min_size:
            node[a] = born(None)
            join(inside[a] + inside[b], node[a], distance)
            inside[a] = None
        else:
            if len(inside[a]) < len(inside[b]):
                a, b = b, a
            inside[a] += inside[b]
        inside[b], up[b] = None, a
        size[a] += size[b]
    strength = lambda x: 1.0 / max(x, LEAST)
    rows, held = [0] * len(at), [0.0] * len(at)
    for i, c in enumerate(place):
        while c >= 0 and parent[c] >= 0 and joined[i] >= until[c]:      # it joined after the cluster met another
            c = parent[c]
        place[i] = c
        if c >= 0:
            rows[c] += int(n[i])
            held[c] += int(n[i]) * strength(joined[i])
    below, kept, good = [0] * len(at), [0.0] * len(at), [False] * len(at)
    for c in range(len(at)):                                        # parts come before what they became
        total = rows[c] + below[c]
        if parent[c] >= 0:
            worth = held[c] + (below[c] * strength(at[c]) if below[c] else 0.0) - total * strength(until[c])
            good[c] = worth >= kept[c]
            below[parent[c]] += total
            kept[parent[c]] += worth if good[c] else kept[c]
    cluster = [-1] * len(at)
    for c in reversed(range(len(at))):
        above = cluster[parent[c]] if parent[c] >= 0 else -1
        cluster[c] = above if above >= 0 else c if good[c] else -1
    return np.array([cluster[c] if c >= 0 else -1 for c in place], np.int64)


def _kept(pts: DataFrame, tree: DataFrame, min_size: int) -> DataFrame:
    """(p, cluster): the kept cluster of every point, null for noise."""
    if tree.limit(ONE_TASK + 1).count() > ONE_TASK:
        placed, nodes = hierarchy(pts, tree, min_size)
        return stable(placed, nodes)
    kind = pts.schema["p"].dataType
    # a point is a line with its number of rows, an edge one with 0; ids must not become floats through a null
    lines = pts.select("p", F.col("p").alias("v"), F.col("core").alias("w"), "n", F.lit(1).alias("one")).unionByName(
        tree.select(F.col("u").alias("p"), "v", "w", F.lit(0).cast("bigint").alias("n"), F.lit(1).alias("one")))

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        own, edges = pdf[pdf["n"] > 0].sort_values("p"), pdf[pdf["n"] == 0]
        place = pd.Index(own["p"])
        found = _walked(own["n"].to_numpy(), own["w"].to_numpy(), place.get_indexer(edges["p"]), place.get_indexer(edges["v"]), edges["w"].to_numpy(), min_size)
        return pd.DataFrame({"p": own["p"].to_numpy(), "cluster": [str(c) if c >= 0 else None for c in found.tolist()]})
    return lines.groupBy("one").applyInPandas(walk, T.StructType([T.StructField("p", kind), T.StructField("cluster", T.StringType())]))


def density_topics(df: DataFrame, id_col: str, vec: str, min_size: int = 15, min_samples: int = 5, block: int = BLOCK) -> DataFrame:
    """(id, topic): topics numbered from 0 by falling number of rows (ties by their least id), -1 for noise."""
    given = _written(df.select(id_col, vec))
    whole = given.where(F.col(id_col).isNotNull() & F.col(vec).isNotNull())
    noise = F.lit(-1).cast("bigint").alias("topic")
    if whole.count() < max(min_size, min_samples + 1):
        return given.select(id_col, noise)
    pts, near = points(whole, id_col, vec, min_samples, block)
    held = _kept(pts, spanning_tree(pts, near, block), min_size).join(pts.select("p", "x"), "p")
    rows = _written(whole.join(held.select(F.col("x").alias(vec), "cluster"), vec).select(id_col, "cluster"))
    sizes = rows.where(F.col("cluster").isNotNull()).groupBy("cluster").agg(F.count(F.lit(1)).alias("_n"), F.min(id_col).alias("_id"))
    # different sizes of topics are at most the root of twice the rows, so their window is small
    lower = sizes.groupBy("_n").agg(F.count(F.lit(1)).alias("_c")).withColumn(
        "_before", F.coalesce(F.sum("_c").over(Window.orderBy(F.desc("_n")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    number = sizes.join(lower, "_n").withColumn("topic", F.col("_before") + F.row_number().over(Window.partitionBy("_n").orderBy("_id")) - 1)
    found = rows.join(number.select("cluster", "topic"), "cluster", "left").select(id_col, F.coalesce("topic", F.lit(-1)).cast("bigint").alias("topic"))
    return found.unionByName(given.where(F.col(id_col).isNull() | F.col(vec).isNull()).select(id_col, noise))
