"""Similarity join on word n-gram Jaccard by chosen paths.

Texts are sets of hashed windows of ``NGRAM`` words (a text with fewer words is one window). Equal texts are one
record (64-bit hash of the text), so copies are never expanded.

1. Chosen paths, in one pass over the texts: in each of R independent runs a record samples about 1 / ``LAMBDA`` of
   its tokens by a hash of (run, token); every sampled token is a child node, which samples again, ``DEPTH`` levels
   deep. Similar sets share sampled tokens, others rarely do. R follows from the recall asked for (``runs``).
2. Buckets of one record are dropped; buckets of at most ``SMALL`` records are leaves; greater ones are split by the
   paths of the next level. Leaves of the last level that are still greater are cut into blocks, and every pair of
   blocks is compared.
3. In a leaf, records are grouped around leaders by a sketch of 64 min-hash bytes: everything that may be within
   similarity 0.6 of a leader is tied to it, and a record leaves the leaf once it is surely within 0.8 of one. Jaccard
   distance is a metric, so two records of similarity 0.8 always end up tied together. A leaf returns a spanning
   forest, never its pairs.
4. Components of these ties get their whole token sets once, by a fixed-size bitmap and an exact join. A component of
   more than ``REFINE`` records is divided first: tokens are ordered by how many of its records hold them, and two sets
   of the similarity share one of the rarest 1 - similarity of their tokens (plus one). Texts that only share a
   template, a header or a licence have rarer tokens of their own there and fall apart, so they are never compared.
5. All pairs inside what remains are compared exactly (in blocks, if it is large). Only counts per record and a
   spanning forest of the true links leave the task.

Result: one row per document: its class (least id that true links reach), the least id of its equal texts, the number
of links of its text to different texts, and the number of its copies.

Defined results: null text counts as empty; texts without words are linked to nothing but their equals; documents with
a null id are kept, and their class is the least id that is not null (null if there is none); repeated rows are
copies; an empty table gives an empty result; other columns are not carried.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cantoria.llm.common import bounded_batches, packed, salted_lookup, staged, unpacked
from cantoria.llm.components import components
from cantoria.llm.decontaminate import bitmap
from cantoria.llm.textbytes import _ODD, chunks, column_bytes, mix, word_hashes

NGRAM = 5
SIMILARITY = 0.8
RECALL = 0.998
LAMBDA = 0.6
DEPTH = 3
SMALL = 500
BLOCK = 1024
#: records of a leaf that are grouped at once (sketches only)
LEAF_BLOCK = 8192
SKETCH = 64
#: components of at most so many records are compared as they are (under REFINE / 2 pairs a record)
REFINE = 32
BITS = 26
PATHS = "array<struct<path:bigint,kids:array<struct<path:bigint,kids:array<bigint>>>>>"
_U64 = float(1 << 64)


def runs(similarity: float = SIMILARITY, recall: float = RECALL, depth: int = DEPTH) -> int:
    """Runs until a pair at the threshold shares a leaf of the last level with probability ``recall``.

    A shared node has a Poisson number of shared children with mean similarity / LAMBDA (records sample by their own
    size, so the smaller of two overlaps counts)."""
    mean, alive = similarity / LAMBDA, 1.0
    for _ in range(depth):
        alive = 1 - math.exp(-mean * alive)
    return math.ceil(math.log(1 - recall) / math.log(1 - alive))


def token_sets(words: np.ndarray, first: np.ndarray, n: int = NGRAM) -> list[np.ndarray]:
    """Sorted distinct hashed windows of n words of every row; shorter rows with words have one window."""
    total = len(words)
    whole = np.zeros(max(0, total - n + 1), np.uint64)
    for i in range(n):
        whole = whole * _ODD + words[i:i + len(whole)]
    whole = mix(whole)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= n:
            out.append(np.unique(whole[a:b - n + 1]))
        elif b > a:
            h = np.zeros(1, np.uint64)
            for w in words[a:b]:
                h = h * _ODD + w
            out.append(mix(h + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """Rows x SKETCH bytes of min-hashes (rows without tokens: zeros)."""
    out = np.zeros((len(sets), SKETCH), np.uint8)
    full = [i for i, s in enumerate(sets) if len(s)]
    if full:
        flat = np.concatenate([sets[i] for i in full])
        starts = np.concatenate([[0], np.cumsum([len(sets[i]) for i in full])[:-1]])
        factors = mix(np.arange(1, SKETCH + 1, dtype=np.uint64)) | np.uint64(1)
        for k in range(SKETCH):
            least = np.minimum.reduceat(mix_low(flat, factors[k]), starts)
            out[full, k] = (mix(least) & np.uint64(255)).astype(np.uint8)
    return out


def mix_low(x: np.ndarray, factor: np.uint64) -> np.ndarray:
    """A quick pseudorandom order of already mixed tokens: high bits of a product, folded back once."""
    y = x * factor
    return (y ^ (y >> np.uint64(32))) * factor


def _children(nodes: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the node, path of the child) for every token that a node of the record samples."""
    limit = np.uint64(min(_U64 - 4096, _U64 / (LAMBDA * len(tokens))))
    at, paths = [], []
    step = max(1, 1_000_000 // len(tokens))
    for a in range(0, len(nodes), step):
        some = nodes[a:a + step]
        h = tokens[None, :] ^ some[:, None]
        node, token = np.nonzero(mix_low(h, _ODD) < limit)
        at.append(node + a)
        paths.append(mix(tokens[token] + some[node] * _ODD))
    return np.concatenate(at), np.concatenate(paths)


def chosen_paths(tokens: np.ndarray, n_runs: int):
    """Level-1 paths, then for each level the offsets of the children of the level above and their paths."""
    roots = mix(np.arange(1, n_runs + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
    _, one = _children(roots, tokens)
    if not len(one):
        return one, np.zeros(1, np.int64), one, np.zeros(1, np.int64), one
    at, two = _children(one, tokens)
    off2 = np.searchsorted(at, np.arange(len(one) + 1))
    if not len(two):
        return one, off2, two, np.zeros(1, np.int64), two
    at, three = _children(two, tokens)
    return one, off2, two, np.searchsorted(at, np.arange(len(two) + 1)), three


def _signatures(n_runs: int):
    def run(batches):
        seen: set[int] = set()  # records of this task: a copy needs no paths of its own
        for batch in batches:
            data, offsets = column_bytes(batch.column("text"))
            recs = batch.column("rec").to_numpy(zero_copy_only=False)
            for a, b, part, at in chunks(data, offsets):
                sets = token_sets(*word_hashes(part, at))
                new = []
                for i, rec in enumerate(recs[a:b].tolist()):
                    if rec not in seen:
                        seen.add(rec)
                        if len(sets[i]):
                            new.append(i)
                chosen = [chosen_paths(sets[i], n_runs) for i in new]
                n1, n2, n3 = (np.concatenate([[0], np.cumsum([len(c[k]) for c in chosen])]) for k in (0, 2, 4))
                empty = np.zeros(0, np.uint64)
                flat = lambda k: np.concatenate([empty, *[c[k] for c in chosen]]).view(np.int64)
                off2 = np.concatenate([*[c[1][:-1] + s for c, s in zip(chosen, n2)], [n2[-1]]]).astype(np.int32)
                off3 = np.concatenate([*[c[3][:-1] + s for c, s in zip(chosen, n3)], [n3[-1]]]).astype(np.int32)
                leaves = pa.ListArray.from_arrays(pa.array(off3), pa.array(flat(4)))
                kids = pa.ListArray.from_arrays(pa.array(off2), pa.StructArray.from_arrays([pa.array(flat(2)), leaves], names=["path", "kids"]))
                top = pa.StructArray.from_arrays([pa.array(flat(0)), kids], names=["path", "kids"])
                own = sketches([sets[i] for i in new])
                yield pa.RecordBatch.from_arrays([
                    pa.array(recs[a:b][new], pa.int64()), pa.array([len(sets[i]) for i in new], pa.int32()),
                    pa.array([r.tobytes() for r in own], pa.binary()), pa.ListArray.from_arrays(pa.array(n1.astype(np.int32)), top)],
                    names=["rec", "size", "sketch", "paths"])

    return run


def _by_key(batches, keys: list[str]):
    """Tables of whole groups of a stream that is sorted by keys (groups may span batches; small ones come together)."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        last = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in keys])
        change = np.flatnonzero((last[:, 1:] != last[:, :-1]).any(axis=0)) + 1
        if len(change):
            cut = int(change[-1])
            before = held[:-1] + [batch.slice(0, cut)]
            yield pa.Table.from_batches(before)
            held = [batch.slice(cut)]
        elif len(held) > 1 and any(held[-2].column(k)[-1].as_py() != batch.column(k)[0].as_py() for k in keys):
            yield pa.Table.from_batches(held[:-1])
            held = [batch]
    if held:
        yield pa.Table.from_batches(held)


def _bounds(table: pa.Table, keys: list[str]) -> list[tuple[int, int]]:
    cols = np.stack([table.column(k).to_numpy() for k in keys])
    edge = np.flatnonzero((cols[:, 1:] != cols[:, :-1]).any(axis=0)) + 1
    ends = np.concatenate([[0], edge, [table.num_rows]])
    return list(zip(ends[:-1].tolist(), ends[1:].tolist()))


def matrix_components(near: np.ndarray) -> np.ndarray:
    """Least index of the component of every row of a symmetric boolean matrix."""
    label = np.arange(len(near), dtype=np.int32)
    while True:
        least = np.minimum(label, np.where(near, label[None, :], np.int32(len(near))).min(axis=1))
        least = least[least]
        if (least == label).all():
            return label
        label = least


#: with 64 min-hash bytes the estimate of 0.6 falls below 0.33, and that of 0.8 rises above 0.97, by chance of 1e-5
TIED, SURE = 0.33, 0.97


def leaf_forest(sketch: np.ndarray) -> np.ndarray:
    """Least index of the records tied to each: every leader is tied to all that it may be within 0.6 of."""
    n = len(sketch)
    label = np.arange(n)
    left = np.ones(n, bool)
    for lead in range(n):
        if not left[lead]:
            continue
        share = (sketch == sketch[lead]).sum(axis=1) / SKETCH
        own = np.unique(label[share >= TIED])
        if len(own) > 1:
            label[np.isin(label, own)] = own[0]
        left[(share >= SURE)] = False
        left[lead] = False
    return label


def _forest(batches):
    for table in _by_key(batches, ["leaf"]):
        recs = table.column("rec").to_numpy()
        flat = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(-1, SKETCH)
        a, b = [], []
        for lo, hi in _bounds(table, ["leaf"]):
            own, at = np.unique(recs[lo:hi], return_index=True)
            if len(own) < 2:
                continue
            label = leaf_forest(flat[lo:hi][at])
            tied = label != np.arange(len(own))
            a.append(own[tied])
            b.append(own[label[tied]])
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a), pa.int64()), pa.array(np.concatenate(b), pa.int64())], names=["a", "b"])


def _ties(signatures: DataFrame) -> DataFrame:
    """a, b: ties between records found in the leaves of all runs."""
    nodes = signatures.select("rec", F.explode("paths").alias("n"))
    # most nodes hold one record: find the shared ones on (path, rec) alone, then work on records that have one
    shared = lambda df: (df.groupBy("path").agg(F.min("rec").alias("lo"), F.max("rec").alias("hi"), F.count(F.lit(1)).alias("n"))
                         .filter("lo < hi").select("path", "n"))
    counts = staged(shared(nodes.select("rec", F.col("n.path").alias("path"))), "paths")
    # joins by shuffle, however small one side may be: their cost follows the input alike at every size
    sharing = nodes.select("rec", F.col("n.path").alias("path")).join(counts.hint("merge"), "path", "left_semi").select("rec").distinct()
    busy = staged(signatures.join(sharing.hint("merge"), "rec", "left_semi"), "busy")
    level = busy.select("rec", "sketch", F.explode("paths").alias("n")).select("rec", "sketch", "n.*").join(counts.hint("merge"), "path")
    leaves = [level.filter(F.col("n") <= SMALL).select(F.col("path").alias("leaf"), "rec", "sketch")]
    level = level.filter(F.col("n") > SMALL).select("rec", "sketch", F.explode("kids").alias("n")).select("rec", "sketch", "n.*")
    level = staged(level, "split")
    level = level.join(shared(level), "path")
    leaves.append(level.filter(F.col("n") <= SMALL).select(F.col("path").alias("leaf"), "rec", "sketch"))
    last = staged(level.filter(F.col("n") > SMALL).select("rec", "sketch", F.explode("kids").alias("path")), "split")
    last = last.join(shared(last), "path")
    leaves.append(in_blocks(last, "path", "n", "leaf", LEAF_BLOCK).select("leaf", "rec", "sketch"))
    rows = leaves[0].unionByName(leaves[1]).unionByName(leaves[2])
    return rows.repartition("leaf").sortWithinPartitions("leaf").mapInArrow(_forest, "a bigint, b bigint")


def in_blocks(rows: DataFrame, key: str, n: str, out: str, block: int) -> DataFrame:
    """Rows under ``out``, a key for every pair of blocks of at most about ``block`` rows that they belong to; a group that
    fits one block keeps one key. Adds i and j, the blocks of the pair, and own, the block of the row."""
    blocks = F.ceil(F.col(n) / block).cast("int")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("rec"), blocks).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    rows = rows.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).drop("other")
    return rows.withColumn(out, F.xxhash64(key, "i", "j"))


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """n x n numbers of common tokens."""
    n = len(sets)
    rows = np.repeat(np.arange(n), [len(s) for s in sets])
    tokens = np.concatenate(sets) if n else np.zeros(0, np.uint64)
    order = np.argsort(tokens, kind="stable")
    tokens, rows = tokens[order], rows[order]
    head = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]])) if len(tokens) else np.zeros(0, np.int64)
    count = np.diff(np.append(head, len(tokens)))
    out = np.zeros((n, n), np.float32)
    few = max(8, n // 16)
    # tokens of few records: their pairs one by one; tokens of many: products of blocks of 0/1 columns
    for c in np.unique(count[(count > 1) & (count <= few)]):
        own = rows[head[count == c][:, None] + np.arange(c)]
        for a in range(0, len(own), max(1, 1_000_000 // (c * c))):
            part = own[a:a + max(1, 1_000_000 // (c * c))]
            out += np.bincount((part[:, :, None] * n + part[:, None, :]).ravel(), minlength=n * n).reshape(n, n)
    many = np.flatnonzero(count > few)
    for a in range(0, len(many), 4096):
        some = many[a:a + 4096]
        x = np.zeros((n, len(some)), np.float32)
        for k, t in enumerate(some):
            x[rows[head[t]:head[t] + count[t]], k] = 1
        out += x @ x.T
    return out


def _exact(similarity: float):
    share = Fraction(str(similarity))
    p, q = share.numerator, share.denominator

    def run(batches):
        for table in _by_key(batches, ["pair"]):
            recs = table.column("rec").to_numpy()
            own = table.column("own").to_numpy()
            across = table.column("i").to_numpy() != table.column("j").to_numpy()
            lists = table.column("tokens").combine_chunks()
            ends = np.asarray(lists.offsets, dtype=np.int64)
            values = np.asarray(lists.values).view(np.uint64)
            a, b, links = [], [], []
            for lo, hi in _bounds(table, ["pair"]):
                _, at = np.unique(recs[lo:hi], return_index=True)
                at = at + lo
                if len(at) < 2:
                    continue
                sets = [values[ends[k]:ends[k + 1]] for k in at]
                size = np.array([len(s) for s in sets], np.int32)
                both = intersections(sets).astype(np.int32)
                # common / (sum of sizes - common) >= p / q
                near = (both * (p + q) >= p * (size[:, None] + size[None, :])) & (both > 0)
                np.fill_diagonal(near, False)
                if across[lo]:
                    near &= own[at][:, None] != own[at][None, :]
                a.append(recs[at])
                b.append(recs[at[matrix_components(near)]])
                links.append(near.sum(axis=1))
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in (a, b, links)], names=["a", "b", "links"])

    return run


def _sets(bits_set, bits: int):
    mask = np.uint64((1 << bits) - 1)

    def run(batches):
        table = bits_set.value
        seen: set[int] = set()
        for batch in batches:
            recs = batch.column("rec").to_numpy(zero_copy_only=False)
            low = recs.view(np.uint64) & mask
            hit = (table[(low >> np.uint64(6)).astype(np.int64)] >> (low & np.uint64(63))) & np.uint64(1)
            take = []
            for i in np.flatnonzero(hit):
                if recs[i] not in seen:
                    seen.add(recs[i])
                    take.append(i)
            if not take:
                continue
            some = batch.take(pa.array(take))
            data, offsets = column_bytes(some.column("text"))
            for a, b, part, at in chunks(data, offsets):
                sets = token_sets(*word_hashes(part, at))
                ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([some.column("rec").slice(a, b - a), pa.ListArray.from_arrays(
                    pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64)))], names=["rec", "tokens"])

    return run


def _divided(grouped: DataFrame, similarity: float) -> DataFrame:
    """root, rec, n of the records that may be similar to another one of their component: records that share a token of
    their prefixes stay together (root is new), the others are left out."""
    share = Fraction(str(similarity))
    p, q = share.numerator, share.denominator
    tokens = grouped.select("root", "rec", F.size("tokens").alias("m"), F.explode("tokens").alias("token"))
    common = tokens.groupBy("root", "token").agg(F.count(F.lit(1)).alias("f")).filter("f > 1")
    held = salted_lookup(tokens, common, ["root", "token"], how="inner").groupBy("root", "rec", "m").agg(
        F.sort_array(F.collect_list(F.struct("f", "token"))).alias("common"))  # at most the tokens of one text
    # the prefix has m - ceil(similarity * m) + 1 tokens; those of this record alone come first and are not listed
    left = F.expr(f"m - (({p} * m + {q - 1}) div {q}) + 1 - (m - size(common))").cast("int")
    prefix = held.withColumn("left", left).filter("left > 0").select("root", "rec", F.explode(F.slice("common", F.lit(1), F.col("left"))).alias("t"))
    prefix = staged(prefix.select("root", "rec", F.col("t.token").alias("token")), "prefixes")
    first = prefix.groupBy("root", "token").agg(F.min("rec").alias("least"), F.count(F.lit(1)).alias("f")).filter("f > 1")
    ties = salted_lookup(prefix, first, ["root", "token"], how="inner").select(F.col("rec").alias("a"), F.col("least").alias("b")).filter("a <> b").distinct()
    parts = components(ties)
    return parts.join(parts.groupBy("root").agg(F.count(F.lit(1)).alias("n")), "root").withColumnRenamed("node", "rec")


def compared(rows: DataFrame, groups: DataFrame, similarity: float) -> DataFrame:
    """pair, rec, own, i, j, tokens: the groups of records whose pairs are compared. rows: rec, text; groups: rec, root, n."""
    shared = rows.sparkSession.sparkContext.broadcast(bitmap(groups.select(F.col("rec").alias("seed")), BITS))
    sets = rows.select("rec", "text").mapInArrow(_sets(shared, BITS), "rec bigint, tokens array<bigint>")
    # copies in other tasks give the same set again
    sets = staged(sets.join(groups.hint("merge"), "rec"), "sets")
    large = sets.filter(F.col("n") > REFINE).drop("n")
    parts = staged(_divided(large.groupBy("rec").agg(F.first("root").alias("root"), F.first("tokens").alias("tokens")), similarity), "parts")
    both = sets.filter(F.col("n") <= REFINE).unionByName(large.drop("root").join(parts.hint("merge"), "rec"))
    return in_blocks(both, "root", "n", "pair", BLOCK).select("pair", "rec", "own", "i", "j", "tokens")


def _classes(docs: DataFrame, key: str, text: str, similarity: float = SIMILARITY, recall: float = RECALL) -> tuple[DataFrame, DataFrame]:
    """(id, rec) of every document; and rec, root, class_id, copy_of, n_links, n_copies of every text."""
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("rec", F.xxhash64("text"))
    signatures = staged(rows.select("rec", "text").mapInArrow(
        _signatures(runs(similarity, recall)), f"rec bigint, size int, sketch binary, paths {PATHS}"), "signatures")
    groups = components(_ties(signatures))
    sizes = groups.groupBy("root").agg(F.count(F.lit(1)).alias("n"))
    groups = staged(groups.join(sizes, "root").withColumnRenamed("node", "rec"), "groups")
    pairs = compared(rows, groups, similarity)
    exact = staged(pairs.repartition("pair").sortWithinPartitions("pair").mapInArrow(_exact(similarity), "a bigint, b bigint, links bigint"), "links")
    classes = components(exact.filter("a <> b")).withColumnRenamed("node", "rec")
    links = exact.groupBy(F.col("a").alias("rec")).agg(F.sum("links").alias("n_links"))
    members = rows.select("id", "rec")
    texts = members.groupBy("rec").agg(F.min("id").alias("copy_of"), F.count(F.lit(1)).alias("n_copies"))
    texts = staged(texts.join(classes, "rec", "left").join(links, "rec", "left").withColumn("root", F.coalesce("root", "rec")), "texts")
    least = texts.groupBy("root").agg(F.min("copy_of").alias("class_id"))
    texts = texts.join(least, "root").select("rec", "root", "copy_of", "class_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), "n_copies")
    return members, texts


def similarity_join(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """key, class_id, copy_of, n_links, n_copies of every document."""
    members, texts = _classes(docs, key, text, **options)
    return members.join(texts, "rec").select(F.col("id").alias(key), "class_id", "copy_of", "n_links", "n_copies")


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One document of each class stays: the one with the least id (of several texts of the class with that id, the one
    with the least hash); of equal rows (id and text) one stays. An id that different texts share stays with each text
    that is its class's first. Documents with a null id stay, one of each text."""
    _, texts = _classes(docs, key, text, **options)
    first = (texts.filter(F.col("copy_of") == F.col("class_id")).groupBy("root").agg(F.min("class_id").alias("id"), F.min("rec").alias("body"))
             .select("id", "body", F.lit(True).alias("first")))
    rows = packed(docs).select("_doc", F.col("_doc")[key].alias("id"), F.xxhash64(F.coalesce(F.col("_doc")[text], F.lit(""))).alias("body"))
    kept = rows.join(first, ["id", "body"], "left").filter(F.col("id").isNull() | F.col("first")).dropDuplicates(["id", "body"])
    return unpacked(kept, docs.columns, [])
