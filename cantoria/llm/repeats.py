"""Repeated substrings across a corpus: column-wise multi-document construction on aligned pieces.

Every byte covered by a string of ``LENGTH`` bytes that also starts earlier (smaller id, or earlier in the same
document) is removed.

Inserting one symbol per document and round into the Burrows-Wheeler transform of whole documents takes as many rounds
as the longest document has bytes, each rewriting the whole transform. Here the rounds run over short aligned pieces:

1. Anchors: of all ``GRAM``-byte windows inside a string of LENGTH bytes, the one with the least hash (the leftmost of
   equals). Equal strings have equal anchors at equal places, so only pieces around equal anchors can hold equal
   strings. Each anchor owns the strings that chose it; its piece is their union (at most 2 * LENGTH - GRAM bytes).
2. Anchors are dealt by hash. Of equal pieces all but the earliest are covered whole; this needs hashes only. Anchors
   with a single piece are done.
3. The earliest pieces of anchors that have several are cut from a second scan of the texts, which finds them by a
   bitmap of fixed size, and written to the shared folder. Dealt and sorted by anchor, they are streamed by tasks, which build the positional Burrows-Wheeler transform column by
   column: each round inserts one symbol of every piece, updating the order of the pieces and the lengths of their
   common context from the arrays of the round before. Neighbours with LENGTH common columns hold equal strings; all
   but the earliest are covered. An anchor with more than ``HOT`` pieces (a common passage that many documents
   continue differently) is not given to one task: its strings are compared one by one by 128-bit hashes, whose
   minimum combines map-side.
4. The covered intervals of a document are merged and cut out.

Hashes have 64 bits, so two different pieces are taken for equal with a chance of about 2^-64 a pair of equal anchors.

Defined results: null and empty texts have nothing to remove; texts shorter than LENGTH stay whole; a null id counts
as smaller than any other, rows with null ids follow a hash of their text (ids below -2^62 are not supported); rows with equal id and text are one document, each returned with the same result; of rows
with equal id and different texts the smaller start counts as earlier; an empty table gives an empty result; other
columns are not carried.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cantoria.llm.common import bounded_batches, staged
from cantoria.llm.decontaminate import bitmap
from cantoria.llm.jaccard_join import _by_key
from cantoria.llm.textbytes import chunks, column_bytes, mix, prefix_sums

LENGTH = 100
GRAM = 24
SPAN = LENGTH - GRAM + 1      # windows of GRAM bytes in a string
COLUMNS = 2 * LENGTH - GRAM   # of a piece, the anchor starting at column SPAN - 1
BITS = 27
#: pieces whose transform is built together (more only if one anchor has more)
TOGETHER = 16_000
#: pieces of one anchor that one task may get
HOT = 20_000
#: rows with a null id are told apart by 62 bits of their text's hash, below this number and thus before all other ids
_NULL_IDS = -(1 << 62)
_A, _B = np.uint64(0xD1342543DE82EF95), np.uint64(0xAF251AF3B0F025B5)


def anchors(data: np.ndarray, offsets: np.ndarray):
    """anchor hash, piece hash, row, anchor place, first and last string start of every anchor of a chunk."""
    if len(data) < LENGTH:
        return None
    sums, down = prefix_sums(data)
    n = len(data) - GRAM + 1
    h = mix((sums[GRAM:] - sums[:-GRAM]) * down[:n])
    low = np.uint64((1 << len(data).bit_length()) - 1)
    least = (h & ~low) | np.arange(n, dtype=np.uint64)
    width = 1
    while 2 * width <= SPAN:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < SPAN:
        least = np.minimum(least[:width - SPAN], least[SPAN - width:])
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:len(least)]
    starts = np.flatnonzero(np.arange(len(least)) + LENGTH <= offsets[row + 1])
    if not len(starts):
        return None
    at = (least[starts] & low).astype(np.int64)
    new = np.ones(len(starts), bool)
    new[1:] = (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)
    heads = np.flatnonzero(new)
    lo, hi, place = starts[heads], starts[np.append(heads[1:], len(starts)) - 1], at[heads]
    piece = (sums[hi + LENGTH] - sums[lo]) * down[lo]
    piece = mix(piece + (place - lo).astype(np.uint64) * _A + (hi - lo).astype(np.uint64) * _B) | np.uint64(1)
    return h[place], piece, row[lo], place, lo, hi


def _coded(place, lo, hi, tag):
    """Place in the text, tag of the text, and the distances of the first and last string start in one number."""
    return (place << 32) | (tag << 16) | ((place - lo) << 8) | (place - hi)


def _decoded(code: np.ndarray):
    place = code >> 32
    return place, (code >> 16) & 0xFFFF, place - ((code >> 8) & 0xFF), place - (code & 0xFF)


def _batch_anchors(batch):
    data, offsets = column_bytes(batch.column("text"))
    ids = batch.column("id").to_numpy(zero_copy_only=False)
    tags = batch.column("tag").to_numpy(zero_copy_only=False).astype(np.int64)
    for a, _, part, at in chunks(data, offsets):
        if (found := anchors(part, at)) is not None:
            anchor, piece, row, place, lo, hi = found
            shift = at[row]
            yield part, anchor, piece, ids[row + a], _coded(place - shift, lo - shift, hi - shift, tags[row + a]), lo, hi


def _occurrences(batches):
    """key, piece, id, code: of equal pieces of a batch the earliest (key: the anchor); the others with piece 0."""
    for batch in batches:
        parts = [x[1:5] for x in _batch_anchors(batch)]
        if not parts:
            continue
        anchor, piece, ids, code = (np.concatenate(c) for c in zip(*parts))
        order = np.lexsort((code, ids, piece, anchor))
        anchor, piece, ids, code = anchor[order], piece[order], ids[order], code[order]
        same = np.zeros(len(anchor), bool)
        same[1:] = (anchor[1:] == anchor[:-1]) & (piece[1:] == piece[:-1])
        # a repeated row is not earlier than itself
        again = np.zeros(len(anchor), bool)
        again[1:] = same[1:] & (ids[1:] == ids[:-1]) & (code[1:] == code[:-1])
        head = np.maximum.accumulate(np.where(same, 0, np.arange(len(same))))
        covered = same & ~((ids == ids[head]) & (code == code[head]))
        keep = ~again
        key = np.where(covered, mix(ids.view(np.uint64) * _A + code.view(np.uint64)), anchor)
        yield pa.RecordBatch.from_arrays([pa.array(key[keep].view(np.int64)), pa.array(np.where(covered, 0, piece)[keep].astype(np.uint64).view(np.int64)),
                                          pa.array(ids[keep]), pa.array(code[keep])], names=["key", "piece", "id", "code"])


def _seed(anchor: np.ndarray, ids: np.ndarray, code: np.ndarray) -> np.ndarray:
    return mix(anchor ^ mix(ids.view(np.uint64) * _A + code.view(np.uint64)))


def _settle(batches):
    """id, code, seed, anchor: covered pieces (the last two null), and the earliest pieces of anchors that have several."""
    for table in _by_key(batches, ["key"]):
        key, piece, ids, code = (table.column(c).to_numpy() for c in ("key", "piece", "id", "code"))
        done = piece == 0
        rest = np.flatnonzero(~done)
        order = rest[np.lexsort((code[rest], ids[rest], piece[rest], key[rest]))]
        k, p = key[order], piece[order]
        new_key = np.ones(len(order), bool)
        new_key[1:] = k[1:] != k[:-1]
        new = new_key.copy()
        new[1:] |= p[1:] != p[:-1]
        head = order[np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))]
        first = (ids[order] == ids[head]) & (code[order] == code[head])
        group = np.cumsum(new_key) - 1
        several = np.bincount(group[new], minlength=group[-1] + 1 if len(group) else 0)[group] > 1 if len(group) else first
        covered = np.concatenate([np.flatnonzero(done), order[~first]])
        open_ = order[new & several]
        out = np.concatenate([covered, open_])
        if len(out):
            seed = _seed(key[out].view(np.uint64), ids[out], code[out]).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids[out]), pa.array(code[out]), pa.array(seed, mask=np.arange(len(out)) < len(covered)),
                                              pa.array(key[out], mask=np.arange(len(out)) < len(covered))], names=["id", "code", "seed", "anchor"])


def _cut_pieces(shared, bits: int):
    mask = np.uint64((1 << bits) - 1)

    def run(batches):
        table, hot_table = shared.value
        isin = lambda t, x: (t[((x & mask) >> np.uint64(6)).astype(np.int64)] >> (x & np.uint64(63))) & np.uint64(1)
        for batch in batches:
            for part, anchor, _, ids, code, lo, hi in _batch_anchors(batch):
                hit = np.flatnonzero(isin(table, _seed(anchor, ids, code)))
                if not len(hit):
                    continue
                size = hi[hit] + LENGTH - lo[hit]
                ends = np.concatenate([[0], np.cumsum(size)])
                flat = part[np.arange(ends[-1]) - np.repeat(ends[:-1], size) + np.repeat(lo[hit], size)]
                pieces = pa.Array.from_buffers(pa.binary(), len(hit), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(flat)])
                hot = isin(hot_table, anchor[hit]).astype(bool) if hot_table is not None else np.zeros(len(hit), bool)
                yield pa.RecordBatch.from_arrays([pa.array(anchor[hit].view(np.int64)), pa.array(ids[hit]), pa.array(code[hit]), pieces, pa.array(hot)],
                                                 names=["anchor", "id", "code", "bytes", "hot"])

    return run


def covered_strings(symbols: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Pieces x SPAN booleans: whether the string starting at that column also occurs in a piece of smaller rank.

    symbols: pieces x COLUMNS, 256 outside a piece. Positional Burrows-Wheeler transform: ``order`` sorts the pieces
    by their symbols read backwards from the current column, ``since`` is the column where the context that a piece
    shares with its predecessor in that order begins."""
    n, columns = symbols.shape
    order, since = np.arange(n), np.zeros(n + 1, np.int32)
    out = np.zeros((n, SPAN), bool)
    column_major = np.ascontiguousarray(symbols.T)
    for c in range(columns):
        symbol = column_major[c][order]
        by = np.argsort(symbol, kind="stable")
        sorted_symbol = symbol[by]
        starts = np.empty(n, bool)
        starts[:1] = True
        starts[1:] = sorted_symbol[1:] != sorted_symbol[:-1]
        new = np.full(n + 1, c + 1, np.int32)
        follow = np.flatnonzero(~starts)
        if len(follow):
            left, right = by[follow - 1] + 1, by[follow] + 1
            near = right == left + 1
            new[follow] = since[left]
            far = np.flatnonzero(~near)
            if len(far):
                ends = np.empty(2 * len(far), np.int64)
                ends[0::2], ends[1::2] = left[far], right[far]
                new[follow[far]] = np.maximum.reduceat(since, ends)[0::2]
        order, since = order[by], new
        first = c - LENGTH + 1
        if first >= 0:
            heads = np.flatnonzero(since[:n] > first)
            if not len(heads) or heads[0] != 0:
                heads = np.concatenate([[0], heads])
            least = np.repeat(np.minimum.reduceat(rank[order], heads), np.diff(np.append(heads, n)))
            out[order, first] = rank[order] != least
    return out


def _dense_rank(ids: np.ndarray, code: np.ndarray) -> np.ndarray:
    order = np.lexsort((code, ids))
    step = np.ones(len(order), np.int64)
    step[1:] = (ids[order][1:] != ids[order][:-1]) | (code[order][1:] != code[order][:-1])
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(step)
    return rank


def _transform(ids, code, pieces) -> pa.RecordBatch | None:
    place, tag, lo, hi = _decoded(code)
    ends = np.frombuffer(pieces.buffers()[1], np.int32)[pieces.offset:pieces.offset + len(pieces) + 1].astype(np.int64)
    data = np.frombuffer(pieces.buffers()[2], np.uint8)
    size = np.diff(ends)
    symbols = np.full((len(ids), COLUMNS), 256, np.uint16)
    row = np.repeat(np.arange(len(ids)), size)
    column = np.arange(ends[-1] - ends[0]) - np.repeat(ends[:-1] - ends[0], size) + np.repeat(SPAN - 1 - (place - lo), size)
    symbols[row, column] = data[ends[0]:ends[-1]]
    hit = covered_strings(symbols, _dense_rank(ids, code))
    # a string starting at a column belongs to the piece if it lies inside it
    start = place[:, None] - (SPAN - 1) + np.arange(SPAN)[None, :]
    hit &= (start >= lo[:, None]) & (start <= hi[:, None])
    edge = np.diff(np.pad(hit, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    (r1, c1), (_, c2) = np.nonzero(edge == 1), np.nonzero(edge == -1)
    if not len(r1):
        return None
    base = place[r1] - (SPAN - 1)
    return pa.RecordBatch.from_arrays([pa.array(ids[r1]), pa.array(tag[r1]), pa.array(base + c1), pa.array(base + c2 - 1 + LENGTH)], names=["id", "tag", "start", "stop"])


def _open_pieces(batches):
    held, rows = [], 0
    for table in _by_key(batches, ["anchor"]):
        held.append(table)
        rows += table.num_rows
        if rows >= TOGETHER:
            out, held, rows = _joined(held), [], 0
            if out is not None:
                yield out
    if held and (out := _joined(held)) is not None:
        yield out


def _joined(tables):
    t = pa.concat_tables(tables).combine_chunks()
    return _transform(t.column("id").to_numpy(), t.column("code").to_numpy(), t.column("bytes").chunk(0))


def _whole(code: str):
    """tag, start, stop of a covered piece."""
    place = F.shiftright(F.col(code), 32)
    part = lambda by, mask: F.shiftright(F.col(code), by).bitwiseAND(F.lit(mask))
    return (part(16, 0xFFFF).alias("tag"), (place - part(8, 0xFF)).alias("start"), (place - part(0, 0xFF) + LENGTH).alias("stop"))


def _flat(column) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column and the offsets of its rows."""
    first = np.asarray(column.offsets, np.int64)
    return np.asarray(column.values)[first[0]:first[-1]], first - first[0]


def _remove(batches):
    for batch in batches:
        data, offsets = column_bytes(batch.column("text"))
        starts, first = _flat(batch.column("starts"))
        stops, _ = _flat(batch.column("stops"))
        for a, b, part, at in chunks(data, offsets):
            row = np.repeat(np.arange(b - a), np.diff(first[a:b + 1]))
            depth = np.zeros(len(part) + 1, np.int32)
            np.add.at(depth, starts[first[a]:first[b]] + at[row], 1)
            np.add.at(depth, stops[first[a]:first[b]] + at[row], -1)
            gone = np.cumsum(depth[:-1], dtype=np.int32) > 0
            edge = np.zeros(len(part) + 1, bool)
            edge[at] = True
            head = gone.copy()
            head[1:] &= ~gone[:-1] | edge[1:-1]
            upto = lambda x: np.concatenate([[0], np.cumsum(x, dtype=np.int64)])[at]
            kept = upto(~gone)
            out = pa.Array.from_buffers(pa.large_binary(), b - a, [None, pa.py_buffer(kept), pa.py_buffer(part[~gone])])
            yield pa.RecordBatch.from_arrays([batch.column("id").slice(a, b - a), pa.array(np.diff(at)), pa.array(np.diff(upto(gone))),
                                              pa.array(np.diff(upto(head))), out.cast(pa.binary())],
                                             names=["id", "n_bytes", "n_removed", "n_spans", "kept"])


def _strings(batches):
    """h1, h2, id, start, tag of every string of the pieces."""
    for batch in batches:
        place, tag, lo, hi = _decoded(batch.column("code").to_numpy())
        pieces = batch.column("bytes")
        ends = np.frombuffer(pieces.buffers()[1], np.int32)[pieces.offset:pieces.offset + len(pieces) + 1].astype(np.int64)
        data = np.frombuffer(pieces.buffers()[2], np.uint8)
        count = hi - lo + 1
        row = np.repeat(np.arange(len(count)), count)
        at = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        a = ends[:-1][row] + at
        out = []
        for flip in (0, 0x5B):  # two hashes of the same bytes
            sums, down = prefix_sums(data ^ np.uint8(flip))
            out.append(mix((sums[a + LENGTH] - sums[a]) * down[a]).view(np.int64))
        ids = batch.column("id").to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*out, ids[row], lo[row] + at, tag[row])], names=["h1", "h2", "id", "start", "tag"])


def _hot_intervals(pieces: DataFrame) -> DataFrame:
    strings = staged(pieces.select("id", "code", "bytes").mapInArrow(_strings, "h1 bigint, h2 bigint, id bigint, start bigint, tag bigint"), "strings")
    first = strings.groupBy("h1", "h2").agg(F.min(F.struct("id", "start", "tag")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    later = strings.join(first, ["h1", "h2"]).filter(F.struct("id", "start", "tag") != F.col("first"))
    return later.select("id", "tag", "start", (F.col("start") + LENGTH).alias("stop"))


def covered_intervals(docs: DataFrame, key: str = "doc_id", text: str = "text", bits: int = BITS) -> DataFrame:
    """id, tag, start, stop: byte intervals to remove (they may overlap), of documents named by id and text tag."""
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = _named(docs, key, text)
    found = rows.mapInArrow(_occurrences, "key bigint, piece bigint, id bigint, code bigint")
    settled = staged(found.repartition("key").sortWithinPartitions("key").mapInArrow(_settle, "id bigint, code bigint, seed bigint, anchor bigint"), "settled")
    open_ = settled.filter("seed is not null").select("seed")
    hot = staged(settled.filter("anchor is not null").groupBy("anchor").count().filter(F.col("count") > HOT).select(F.col("anchor").alias("seed")), "hot")
    any_hot = not hot.isEmpty()
    shared = spark.sparkContext.broadcast((bitmap(open_, bits), bitmap(hot, bits) if any_hot else None))
    pieces = staged(rows.mapInArrow(_cut_pieces(shared, bits), "anchor bigint, id bigint, code bigint, bytes binary, hot boolean"), "pieces")
    partial = pieces.filter("not hot").drop("hot").repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_open_pieces, "id bigint, tag bigint, start bigint, stop bigint")
    found = settled.filter("seed is null").select("id", *_whole("code")).unionByName(partial)
    return found.unionByName(_hot_intervals(pieces.filter("hot"))) if any_hot else found


def _named(docs: DataFrame, key: str, text: str) -> DataFrame:
    unnamed = F.xxhash64(F.coalesce(F.col(text), F.lit("")), F.lit(1)).bitwiseAND(F.lit((1 << 62) - 1)) + F.lit(-(1 << 63))
    return docs.select(F.coalesce(F.col(key).cast("bigint"), unnamed).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"),
                       F.pmod(F.xxhash64(F.coalesce(F.col(text), F.lit(""))), F.lit(1 << 16)).cast("int").alias("tag"))


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", bits: int = BITS) -> DataFrame:
    """key, n_bytes, n_removed, n_spans (maximal removed runs), kept (the remaining bytes) of every document."""
    gone = (covered_intervals(docs, key, text, bits).groupBy("id", "tag")
            .agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("gone"))
            .select("id", F.col("tag").cast("int").alias("tag"), F.col("gone.start").alias("starts"), F.col("gone.stop").alias("stops")))
    none = F.array().cast("array<bigint>")
    rows = _named(docs, key, text).join(gone, ["id", "tag"], "left").select("id", "text", F.coalesce("starts", none).alias("starts"), F.coalesce("stops", none).alias("stops"))
    out = rows.mapInArrow(_remove, "id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")
    return out.select(F.when(F.col("id") >= _NULL_IDS, F.col("id")).alias(key), "n_bytes", "n_removed", "n_spans", "kept")
