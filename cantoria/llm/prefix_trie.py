"""Prefix trie of conversations: count-min screening of prefix digests, exact grouping of what may be shared.

A conversation is rebuilt from a shared opening and its own turns (``rebuilt``); each distinct sequence of first d turns
is a node, conversations that start with it are its members.

1. Turns become digests. They are sorted by range on (conversation, turn), so even one conversation with a third of
   all rows is spread over many tasks; each task numbers its turns and sums digest x odd^position (two sums modulo
   2^64), and the sums of the run that crosses a border are carried over by one row a task.
2. The sums of the first d rebuilt turns are the digest of a prefix; the opening's sums shift by a power. Per-conversation
   facts reach the turns in blocks of 4,096 turns, so no key of that join is larger.
3. Count-min: every prefix adds to one cell in each of ``ROWS`` rows of 2^``BITS`` counters; only the bits "two or more"
   are kept. A prefix with a cell below two is proven a singleton: it has one member, and so have all that extend it.
4. Below a proven singleton nodes are emitted where they stand, without a shuffle. Only prefixes that may be shared,
   and the first singletons below them, are grouped exactly; partial counts combine map-side. A full sketch (its size
   is fixed) sends more rows to the exact step and changes no result.
5. Sums over subtrees of shared nodes by doubling: in round k each node gives what it has to the ancestor 2^k above, so
   log2(depth) rounds of keyed sums do. Lookups of a common parent are salted.
6. SHA-256 of the ids that end at a node cannot be combined: ids are sorted by range and joined into strings of at
   most ``IDS`` ids in parallel, and the strings of one node stream in order through one task, which holds one of them.

Defined results: rows with a null conversation id belong to no conversation; null turns come first; turns of equal
number are ordered by a digest of role and text, repeated rows are turns each; null role or text is empty; very long
texts are hashed where they are read; an empty table gives no node; other columns are not carried. Prefixes are told
apart by 128 bits.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cantoria.llm.common import WORD, salted_lookup, staged
from cantoria.llm.textbytes import mix

ROWS = 3
BITS = 22
BLOCK = 12  # turns of a conversation that share a key of a join: 2^BLOCK
IDS = 4096
OPENING = 3  # the longest shared opening
_BASE = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_BACK = tuple(pow(b, -1, 1 << 64) for b in _BASE)
NODE = ["depth", "p1", "p2"]


def opening_length(conv: Column) -> Column:
    return F.crc32(conv.cast("string").cast("binary")) % (OPENING + 1)


def opening_of(conv: Column) -> Column:
    return conv - conv % 20


def _power(base: int, n: np.ndarray) -> np.ndarray:
    """base ** n modulo 2^64."""
    out, b, n = np.ones(len(n), np.uint64), base, n.astype(np.int64)
    for bit in range(int(n.max(initial=0)).bit_length()):
        out = np.where((n >> bit) & 1, out * np.uint64(b), out)
        b = b * b & 0xFFFFFFFFFFFFFFFF
    return out


def _u(column) -> np.ndarray:
    return column.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)


def _i(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def _run_sums(batches):
    """Positions and digest sums of each conversation's turns within the task."""
    part = TaskContext.get().partitionId()
    last, n0, carry = None, 0, [0, 0]
    for batch in batches:
        if batch.num_rows == 0:
            continue
        conv = batch.column("conv_id").to_numpy()
        new = np.ones(len(conv), bool)
        new[1:] = conv[1:] != conv[:-1]
        heads = np.flatnonzero(new)
        run = np.cumsum(new) - 1
        at = np.arange(len(conv)) - heads[run]
        goes_on = last is not None and conv[0] == last
        if goes_on:
            at[run == 0] += n0
        sums = []
        for j, base in enumerate(_BASE):
            terms = _u(batch.column(f"v{j + 1}")) * _power(base, at)
            total = np.cumsum(terms)
            before = (total - terms)[heads][run]
            own = total - before
            if goes_on:
                own[run == 0] += np.uint64(carry[j])
            sums.append(own)
        last, n0, carry = conv[-1], int(at[-1]) + 1, [int(s[-1]) for s in sums]
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array(np.full(len(conv), part, np.int32)), pa.array(at), batch.column("v1"),
                                          batch.column("v2"), _i(sums[0]), _i(sums[1]), batch.column("words")],
                                         names=["conv_id", "part", "at", "v1", "v2", "s1", "s2", "words"])


def numbered_turns(conversations: DataFrame, words: str = WORD) -> DataFrame:
    """conv_id, at (0-based), v1, v2 (digest), s1, s2 (sums up to this turn), words."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), F.xxhash64(role, text).alias("v1"),
        F.xxhash64(F.lit(1), text, role).alias("v2"), F.regexp_count(text, F.lit(words)).cast("bigint").alias("words"),
        F.monotonically_increasing_id().alias("tie"))  # equal rows only: any order of them is the same order
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("v1"), F.col("v2"), F.col("tie")]
    runs = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("turn", "tie")
    runs = staged(runs.mapInArrow(_run_sums, "conv_id bigint, part int, at bigint, v1 bigint, v2 bigint, s1 bigint, s2 bigint, words bigint"), "turns")
    borders = runs.groupBy("part").agg(F.min("conv_id").alias("first"), F.max(F.struct("conv_id", "at", "s1", "s2")).alias("end")).orderBy("part").collect()
    mask, carried, last, n0, sums = 0xFFFFFFFFFFFFFFFF, {}, None, 0, [0, 0]
    for b in borders:  # one row a task of the sort
        before = (n0, *sums) if b["first"] == last else (0, 0, 0)
        carried[b["part"]] = (b["first"], *before)
        whole = b["end"]["conv_id"] == b["first"]
        start = before if whole else (0, 0, 0)
        n0, last = start[0] + b["end"]["at"] + 1, b["end"]["conv_id"]
        sums = [(start[1 + j] + pow(_BASE[j], start[0], 1 << 64) * (b["end"][f"s{j + 1}"] & mask)) & mask for j in (0, 1)]
    shared = conversations.sparkSession.sparkContext.broadcast(carried)

    def run(batches):
        known = shared.value
        for batch in batches:
            conv, part, at = (batch.column(c).to_numpy() for c in ("conv_id", "part", "at"))
            at, sums = at.copy(), [_u(batch.column("s1")).copy(), _u(batch.column("s2")).copy()]
            for p in np.unique(part):
                first, n, *before = known[int(p)]
                own = (part == p) & (conv == first)
                if n and own.any():
                    at[own] += n
                    for j in (0, 1):
                        sums[j][own] = sums[j][own] * np.uint64(pow(_BASE[j], n, 1 << 64)) + np.uint64(before[j])
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array(at), batch.column("v1"), batch.column("v2"), _i(sums[0]), _i(sums[1]),
                                              batch.column("words")], names=["conv_id", "at", "v1", "v2", "s1", "s2", "words"])

    return runs.mapInArrow(run, "conv_id bigint, at bigint, v1 bigint, v2 bigint, s1 bigint, s2 bigint, words bigint")


def _facts(turns: DataFrame, opening: Column, length: Column) -> DataFrame:
    """conv_id, n (own turns), skip (own turns that the opening replaces), shared (turns taken from the opening), o0-o2
    (those turns), l1, l2 (own sums up to the last turn skipped), size (turns when rebuilt)."""
    first = [F.max(F.when(F.col("at") == k, F.struct("v1", "v2", "s1", "s2", "words"))).alias(f"o{k}") for k in range(OPENING)]
    own = staged(turns.groupBy("conv_id").agg((F.max("at") + 1).alias("n"), *first), "facts")
    source = own.select(F.col("conv_id").alias("opening"), F.least("n", F.lit(OPENING)).alias("there"), *[f"o{k}" for k in range(OPENING)])
    skipped = [F.coalesce(*[F.when(F.col("skip") == k + 1, F.col(f"own{k}")[f"s{j}"]) for k in range(OPENING)], F.lit(0)).alias(f"l{j}") for j in (1, 2)]
    each = own.select("conv_id", "n", opening.alias("opening"), length.alias("skip"), *[F.col(f"o{k}").alias(f"own{k}") for k in range(OPENING)])
    each = each.join(source, "opening", "left").withColumn("shared", F.least("skip", F.coalesce("there", F.lit(0))))
    each = each.withColumn("size", F.col("shared") + F.greatest(F.col("n") - F.col("skip"), F.lit(0)))
    return staged(each.select("conv_id", "n", "skip", "shared", "size", *[f"o{k}" for k in range(OPENING)], *skipped), "facts")


def _prefixes(batches):
    """Digest of the prefix that ends in each own turn, and of the one before it."""
    for batch in batches:
        at, skip, shared = (batch.column(c).to_numpy() for c in ("at", "skip", "shared"))
        depth = at - skip + shared + 1
        out = []
        for j in (0, 1):
            back = _power(_BACK[j], skip - shared)
            here = (_u(batch.column(f"s{j + 1}")) - _u(batch.column(f"l{j + 1}"))) * back + _u(batch.column(f"b{j + 1}"))
            out.append((here, here - _u(batch.column(f"v{j + 1}")) * _power(_BASE[j], depth - 1)))
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array(depth), _i(out[0][0]), _i(out[1][0]), _i(out[0][1]), _i(out[1][1]),
                                          batch.column("words"), pa.array(depth == batch.column("size").to_numpy())],
                                         names=["conv_id", "depth", "p1", "p2", "q1", "q2", "words", "last"])


def rebuilt(turns: DataFrame, facts: DataFrame) -> DataFrame:
    """conv_id, depth, p1, p2 (prefix of depth turns), q1, q2 (of depth - 1), words (of its last turn), last."""
    ahead = [F.coalesce(*[F.when(F.col("shared") == k + 1, F.col(f"o{k}")[f"s{j}"]) for k in range(OPENING)], F.lit(0)).alias(f"b{j}") for j in (1, 2)]
    wide = facts.filter("n > skip").select("conv_id", "skip", "shared", "size", "l1", "l2", *ahead,
                                           F.explode(F.sequence(F.lit(0), F.shiftright(F.col("n") - 1, BLOCK))).alias("block"))
    own = turns.withColumn("block", F.shiftright("at", BLOCK)).join(wide, ["conv_id", "block"]).filter("at >= skip")
    own = own.mapInArrow(_prefixes, "conv_id bigint, depth bigint, p1 bigint, p2 bigint, q1 bigint, q2 bigint, words bigint, last boolean")
    zero = F.lit(0).cast("bigint")
    opening = None
    for k in range(OPENING):
        q = [F.col(f"o{k - 1}")[s] if k else zero for s in ("s1", "s2")]
        o = facts.filter(F.col("shared") > k).select("conv_id", F.lit(k + 1).cast("bigint").alias("depth"), F.col(f"o{k}")["s1"].alias("p1"),
                                                     F.col(f"o{k}")["s2"].alias("p2"), q[0].alias("q1"), q[1].alias("q2"),
                                                     F.col(f"o{k}")["words"].alias("words"), (F.col("size") == k + 1).alias("last"))
        opening = o if opening is None else opening.unionByName(o)
    return staged(own.unionByName(opening), "prefixes")


def cells(p1: np.ndarray, p2: np.ndarray, depth: np.ndarray, bits: int) -> np.ndarray:
    """The cell of each prefix in each row of the sketch (ROWS x prefixes)."""
    at = mix(p1 ^ mix(p2 + depth.astype(np.uint64)))
    return np.stack([(mix(at + np.uint64(r + 1)) >> np.uint64(64 - bits)) + (np.uint64(r) << np.uint64(bits)) for r in range(ROWS)]).astype(np.int64)


def sketch(prefixes: DataFrame, bits: int = BITS) -> np.ndarray:
    """One bit a counter, set where it counted two or more: at most ROWS x 2^bits / 64 rows come to the driver."""
    def run(batches):
        for batch in batches:
            cell, n = np.unique(cells(_u(batch.column("p1")), _u(batch.column("p2")), batch.column("depth").to_numpy(), bits), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(n)], names=["cell", "n"])

    counters = prefixes.select("depth", "p1", "p2").mapInArrow(run, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n"))
    packed = (counters.filter("n > 1").groupBy(F.shiftright("cell", 6).alias("word"))
              .agg(F.bit_or(F.expr("shiftleft(1L, cast(cell & 63 as int))")).alias("set")).toArrow())
    out = np.zeros((ROWS << bits) + 63 >> 6, np.int64)
    out[packed["word"].to_numpy()] = packed["set"].to_numpy()
    return out.view(np.uint64)


def screened(prefixes: DataFrame, bits_set: np.ndarray, bits: int = BITS) -> DataFrame:
    """The prefixes with shared (may have several members) and above (so may its parent; the root always)."""
    known = prefixes.sparkSession.sparkContext.broadcast(bits_set)

    def several(p1, p2, depth):
        at = cells(p1, p2, depth, bits)
        return ((known.value[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).all(axis=0)

    def run(batches):
        for batch in batches:
            depth = batch.column("depth").to_numpy()
            own = several(_u(batch.column("p1")), _u(batch.column("p2")), depth)
            above = several(_u(batch.column("q1")), _u(batch.column("q2")), depth - 1) | (depth == 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own), pa.array(above)], names=[*batch.schema.names, "shared", "above"])

    return prefixes.mapInArrow(run, "conv_id bigint, depth bigint, p1 bigint, p2 bigint, q1 bigint, q2 bigint, words bigint, last boolean, shared boolean, above boolean")


def _joined_ids(batches):
    """Runs of at most IDS ids of one node as one string each, with the first id."""
    for batch in batches:
        depth, p1, p2, conv = (batch.column(c).to_numpy() for c in ("depth", "p1", "p2", "conv_id"))
        if not len(conv):
            continue
        new = np.ones(len(conv), bool)
        new[1:] = (depth[1:] != depth[:-1]) | (p1[1:] != p1[:-1]) | (p2[1:] != p2[:-1])
        run = np.flatnonzero(new)[np.cumsum(new) - 1]
        heads = np.flatnonzero(new | ((np.arange(len(conv)) - run) % IDS == 0))
        ends = np.append(heads[1:], len(conv))
        text = [",".join(map(str, conv[a:b])) for a, b in zip(heads, ends)]
        yield pa.RecordBatch.from_arrays([pa.array(depth[heads]), pa.array(p1[heads]), pa.array(p2[heads]), pa.array(conv[heads]), pa.array(text)],
                                         names=["depth", "p1", "p2", "first", "ids"])


def _streamed_sha(batches):
    now, state = None, None
    for batch in batches:
        done = []
        for *node, ids in zip(*[batch.column(c).to_pylist() for c in (*NODE, "ids")]):
            if node != now:
                if now is not None:
                    done.append((*now, state.hexdigest()))
                now, state = node, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        yield _digests(done)
    if now is not None:
        yield _digests([(*now, state.hexdigest())])


def _digests(rows: list) -> pa.RecordBatch:
    types = [pa.int64()] * 3 + [pa.string()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=[*NODE, "ends_sha256"])


def ends(rows: DataFrame) -> DataFrame:
    """depth, p1, p2, ends_sha256: digest of the ascending ids of the conversations that end at the node."""
    order = [*NODE, "conv_id"]
    joined = rows.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(
        _joined_ids, "depth bigint, p1 bigint, p2 bigint, first bigint, ids string")
    return joined.repartition(*NODE).sortWithinPartitions(*NODE, "first").mapInArrow(_streamed_sha, "depth bigint, p1 bigint, p2 bigint, ends_sha256 string")


def _subtree_sums(nodes: DataFrame, values: list[str]) -> DataFrame:
    """depth, p1, p2 and the values summed over each node's subtree. nodes: closed under parents, the root's sums are 0."""
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    now, step = nodes.select(*NODE, F.col("q1").alias("a1"), F.col("q2").alias("a2"), *values), 1
    while step <= deepest:
        given = (now.filter(F.col("depth") >= step).groupBy((F.col("depth") - step).alias("depth"), F.col("a1").alias("p1"), F.col("a2").alias("p2"))
                 .agg(*[F.sum(v).alias(f"more_{v}") for v in values]))
        above = now.select((F.col("depth") + step).alias("depth"), F.col("p1").alias("a1"), F.col("p2").alias("a2"), F.col("a1").alias("n1"), F.col("a2").alias("n2"))
        far = salted_lookup(now.filter(F.col("depth") > 2 * step), above.filter(F.col("depth") > 2 * step), ["depth", "a1", "a2"])
        zero = F.lit(0).cast("bigint")  # the root above, or nothing
        near = now.filter(F.col("depth") <= 2 * step).withColumn("n1", zero).withColumn("n2", zero)
        both = near.unionByName(far).join(given, NODE, "left")
        now = staged(both.select(*NODE, F.col("n1").alias("a1"), F.col("n2").alias("a2"),
                                 *[(F.col(v) + F.coalesce(f"more_{v}", F.lit(0))).alias(v) for v in values]), "subtrees")
        step *= 2
    return now.select(*NODE, *values)


def trie(conversations: DataFrame, bits: int = BITS, opening=opening_of, length=opening_length, words: str = WORD) -> DataFrame:
    """One row a node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    turns = numbered_turns(conversations, words)
    facts = _facts(turns, opening(F.col("conv_id")), length(F.col("conv_id")))
    prefixes = rebuilt(turns, facts)
    rows = screened(prefixes, sketch(prefixes, bits), bits)
    nothing, zero, one = F.sha2(F.lit(""), 256), F.lit(0).cast("bigint"), F.lit(1).cast("bigint")

    def lone(parent: Column) -> list[Column]:
        return [F.col("conv_id"), F.col("depth"), parent.alias("parent_conv_id"), one.alias("n_convs"), F.when(F.col("last"), zero).otherwise(one).alias("n_children"),
                one.alias("n_leaves"), zero.alias("saved_tokens"), F.when(F.col("last"), F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(nothing).alias("ends_sha256")]

    tails = rows.filter(~F.col("above")).select(*lone(F.col("conv_id")))
    maybe = rows.filter("above")
    grouped = maybe.groupBy(*NODE, "q1", "q2").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("words").alias("words"),
                                                   F.max("last").alias("last"))
    root = facts.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).filter("n_convs > 0").select(
        *[zero.alias(c) for c in (*NODE, "q1", "q2")], "conv_id", "n_convs", zero.alias("words"), F.lit(False).alias("last"))
    grouped = staged(grouped.unionByName(root), "nodes")
    parents = grouped.filter("n_convs > 1 or depth = 0")
    children = grouped.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("q1").alias("p1"), F.col("q2").alias("p2")).agg(
        F.count(F.lit(1)).alias("n_children"), F.count_if(F.col("n_convs") == 1).alias("lone_children"))
    parents = parents.join(children, NODE, "left").fillna(0, ["n_children", "lone_children"])
    parents = staged(parents.withColumn("n_leaves", F.col("lone_children") + F.when(F.col("n_children") == 0, 1).otherwise(0))
                     .withColumn("saved_tokens", (F.col("n_convs") - 1) * F.col("words")), "parents")
    names = parents.select((F.col("depth") + 1).alias("depth"), F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("conv_id").alias("parent"))
    singles = salted_lookup(grouped.filter("n_convs = 1 and depth > 0"), names, ["depth", "q1", "q2"]).select(*lone(F.coalesce("parent", "conv_id")))
    ending = rows.filter("last and shared").select(*NODE, "conv_id").unionByName(facts.filter("size = 0").select(*[zero.alias(c) for c in NODE], "conv_id"))
    sums = _subtree_sums(parents, ["n_leaves", "saved_tokens"])
    common = salted_lookup(parents.drop("n_leaves", "saved_tokens"), names, ["depth", "q1", "q2"]).join(sums, NODE).join(ends(ending), NODE, "left")
    common = common.select("conv_id", "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
                           F.coalesce("ends_sha256", nothing).alias("ends_sha256"))
    return tails.unionByName(singles).unionByName(common)


def sql() -> str:
    """The same nodes in plain SQL (crc32 bit by bit; ancestors by slices of the path)."""
    bits = ", ".join(["0"] * 7)
    return f"""
WITH t AS (SELECT conv_id, coalesce("role", '') AS r, coalesce("text", '') AS x, turn FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list({{'r': r, 'x': x}} ORDER BY turn NULLS FIRST, r, x) AS turns FROM t GROUP BY conv_id),
k AS (SELECT *, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''),
             lambda s: [CAST(ascii(s) AS BIGINT), {bits}]))),
             lambda a, b: xor(xor(a, b) >> 1, 3988292384 * (xor(a, b) & 1))), 4294967295) % 4 AS h FROM own),
re AS (SELECT k.conv_id, coalesce(o.turns, [])[1:k.h] || k.turns[k.h + 1:] AS turns FROM k LEFT JOIN own o ON o.conv_id = k.conv_id - k.conv_id % 20),
p AS (SELECT conv_id, turns, len(turns) AS size, unnest(range(len(turns) + 1)) AS depth FROM re),
n AS (SELECT turns[1:depth] AS path, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
             coalesce(string_agg(CASE WHEN size = depth THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id), '') AS ids FROM p GROUP BY ALL),
m AS (SELECT *, CASE WHEN depth > 0 THEN path[1:depth - 1] END AS up,
             CASE WHEN depth > 0 THEN (n_convs - 1) * len(regexp_extract_all(path[depth].x, '[^\\x20\\x09-\\x0D]+')) ELSE 0 END AS saved FROM n),
c AS (SELECT up, count(*) AS n_children FROM m WHERE depth > 0 GROUP BY up),
a AS (SELECT m.*, coalesce(c.n_children, 0) AS n_children FROM m LEFT JOIN c ON c.up = m.path),
s AS (SELECT path[1:d] AS path, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(saved) AS saved_tokens
      FROM (SELECT *, unnest(range(depth + 1)) AS d FROM a) GROUP BY ALL)
SELECT a.conv_id, a.depth, b.conv_id AS parent_conv_id, a.n_convs, a.n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves,
       CAST(s.saved_tokens AS BIGINT) AS saved_tokens, sha256(a.ids) AS ends_sha256
FROM a JOIN s ON s.path = a.path LEFT JOIN n b ON b.path = a.up"""
