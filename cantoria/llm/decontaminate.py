"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment of words.

1. Words are lower-cased (ASCII and Latin-1) and freed of ASCII punctuation. Every window of ``SEED`` words of a
   benchmark item is a seed. A copy in which changed or added words leave no three neighbours together is not found:
   with every third word replaced it would score 0.5; words replaced at random leave windows.
2. One pass over the texts finds windows whose hash is set in a bitmap of 2^``BITS`` bits built from the seeds (its
   size is fixed, so it may be broadcast; a fuller bitmap costs time, not results) and keeps the words around them,
   as far as the longest item reaches.
3. These hits join the seeds exactly. Every (passage, item) pair with a seed is aligned, however many documents hold
   the seed: pairs grow with (documents x items that share it), never with the square of the documents.
4. Local alignment (match 2, mismatch -1, gap -1) of the item with the passage; share = score / (2 x words of the
   item). 80 % equal words reach 0.7, 70 % reach 0.55, a verbatim half 0.5; pairs from 0.45 on are
   contaminations. Unrelated pairs reach 0.34 on check_l (items of 15 to 59 words).

Defined results: null and empty texts or items match nothing; items shorter than SEED words are never found (they are
too short to tell); repeated documents are found each, repeated items each; of several passages the best counts; an
empty side gives an empty result; other columns are not carried.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cantoria.llm.common import bounded_batches, packed, staged, unpacked
from cantoria.llm.textbytes import chunks, column_bytes, shingle_hashes, word_hashes

SEED = 3
BITS = 24
SHARE = 0.45
MATCH, MISMATCH, GAP = 2, -1, -1


def folded(data: np.ndarray) -> np.ndarray:
    """Bytes with ASCII and Latin-1 capitals made small and ASCII punctuation made spaces; lengths stay."""
    t = np.arange(256, dtype=np.uint8)
    for c in range(128):
        if not chr(c).isalnum():
            t[c] = 0x20
        elif chr(c).isupper():
            t[c] = ord(chr(c).lower())
    out = t[data]
    if len(data) > 1:
        capital = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        out[1:][capital] += 0x20
    return out


def _items(batches):
    for batch in batches:
        words, first = word_hashes(*_fold(batch.column(1)))
        words = words.view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(words))], names=["item_id", "words"])


def _fold(column):
    data, offsets = column_bytes(column)
    return folded(data), offsets


def item_words(items: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    return items.select(F.col(key).cast("bigint").alias("item_id"), F.col(text)).mapInArrow(_items, "item_id bigint, words array<bigint>")


def _seeds(batches):
    for batch in batches:
        lists = batch.column(1)
        first = np.asarray(lists.offsets, dtype=np.int64)
        words = np.asarray(lists.values).view(np.uint64)
        words, first = words[first[0]:first[-1]], first - first[0]
        seeds, at = shingle_hashes(words, first, SEED)
        rows = np.repeat(np.arange(len(lists)), np.diff(at))
        yield pa.RecordBatch.from_arrays([pa.array(seeds.view(np.int64)), batch.column(0).take(pa.array(rows)), pa.array((np.arange(len(seeds)) - at[rows]).astype(np.int32))],
                                         names=["seed", "item_id", "item_at"])


def seed_table(words: DataFrame) -> DataFrame:
    return words.select("item_id", "words").mapInArrow(_seeds, "seed bigint, item_id bigint, item_at int")


def bitmap(seeds: DataFrame, bits: int = BITS) -> np.ndarray:
    """2^bits bits, set for every seed; at most 2^bits / 64 rows come to the driver, whatever the number of seeds."""
    low = F.col("seed").bitwiseAND(F.lit((1 << bits) - 1))
    cells = seeds.groupBy(F.shiftright(low, 6).alias("cell")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(seed & 63 as int))")).alias("set"))
    out = np.zeros(1 << (bits - 6), np.int64)
    got = cells.toArrow()
    out[got["cell"].to_numpy()] = got["set"].to_numpy()
    return out.view(np.uint64)


def passages(docs: DataFrame, bits_set: np.ndarray, reach: int, key: str, text: str, bits: int = BITS) -> DataFrame:
    """doc_id, body (hash of the text), at (first word), words, hits (seed, place in words): the stretches around windows
    in the bitmap."""
    shared = docs.sparkSession.sparkContext.broadcast(bits_set)
    mask = np.uint64((1 << bits) - 1)

    def run(batches):
        table = shared.value
        for batch in batches:
            data, offsets = column_bytes(batch.column(1))
            for a, _, part, at in chunks(data, offsets):
                words, first = word_hashes(folded(part), at)
                seeds, start = shingle_hashes(words, first, SEED)
                low = seeds & mask
                hit = np.flatnonzero((table[(low >> np.uint64(6)).astype(np.int64)] >> (low & np.uint64(63))) & np.uint64(1))
                if not len(hit):
                    continue
                row = np.searchsorted(start, hit, side="right") - 1
                place = hit - start[row] + first[row]  # of the window's first word in the chunk
                # hits of a row that are at most 2 * reach words apart share a stretch
                new = np.ones(len(hit), bool)
                new[1:] = (row[1:] != row[:-1]) | (place[1:] - place[:-1] > 2 * reach)
                heads = np.flatnonzero(new)
                tails = np.append(heads[1:], len(hit)) - 1
                lo = np.maximum(place[heads] - reach, first[row[heads]])
                hi = np.minimum(place[tails] + SEED + reach, first[row[heads] + 1])
                size = hi - lo
                ends = np.concatenate([[0], np.cumsum(size)])
                flat = np.arange(ends[-1]) - np.repeat(ends[:-1], size) + np.repeat(lo, size)
                group = np.cumsum(new) - 1
                bounds = np.append(heads, len(hit)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array(row[heads] + a)), batch.column(2).take(pa.array(row[heads] + a)), pa.array((lo - first[row[heads]]).astype(np.int64)),
                    pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(words[flat].view(np.int64))),
                    pa.ListArray.from_arrays(pa.array(bounds), pa.array(seeds[hit].view(np.int64))),
                    pa.ListArray.from_arrays(pa.array(bounds), pa.array((place - lo[group]).astype(np.int32)))],
                    names=["doc_id", "body", "at", "words", "seeds", "places"])

    return docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text), F.xxhash64(text).alias("body")).mapInArrow(
        run, "doc_id bigint, body bigint, at bigint, words array<bigint>, seeds array<bigint>, places array<int>")


def align(items: list[np.ndarray], stretches: list[np.ndarray]) -> np.ndarray:
    """Best local alignment score of each pair, many pairs at once."""
    n = len(items)
    m, length = max(map(len, items)), max(map(len, stretches))
    x = np.zeros((n, length), np.int64)
    y = np.zeros((n, m), np.int64)
    for i in range(n):
        x[i, :len(stretches[i])] = stretches[i]
        y[i, :len(items[i])] = items[i]
    solid = x != 0
    sizes = np.array([len(i) for i in items])
    step = -GAP * np.arange(length)
    row = np.zeros((n, length), np.int64)
    best = np.zeros(n, np.int64)
    for j in range(m):
        diagonal = np.zeros_like(row)
        diagonal[:, 1:] = row[:, :-1]
        own = diagonal + np.where((x == y[:, j:j + 1]) & solid, MATCH, MISMATCH)
        own = np.maximum(np.maximum(own, row + GAP), 0)
        own = np.maximum.accumulate(own + step, axis=1) - step  # gaps along the stretch
        own[sizes <= j] = 0
        row = own
        best = np.maximum(best, row.max(axis=1))
    return best


def _aligned(batches):
    for batch in batches:
        item = [np.asarray(x.values, dtype=np.int64) for x in batch.column("item")]
        part = [np.asarray(x.values, dtype=np.int64) for x in batch.column("part")]
        cost = np.array([len(a) for a in item]) + np.array([len(b) for b in part])
        order = np.argsort(cost, kind="stable")
        score = np.zeros(len(item), np.int64)
        a = 0
        while a < len(order):
            widest, b = 0, a
            while b < len(order) and (b == a or (b - a + 1) * max(widest, cost[order[b]]) <= 200_000):
                widest = max(widest, cost[order[b]])
                b += 1
            some = order[a:b]
            score[some] = align([item[i] for i in some], [part[i] for i in some])
            a = b
        share = score / (MATCH * np.array([len(i) for i in item]))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("body"), batch.column("item_id"), batch.column("at"), pa.array(share)],
                                         names=["doc_id", "body", "item_id", "at", "share"])


def _flagged(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id",
             item_text: str = "text", share: float = SHARE, bits: int = BITS) -> DataFrame:
    """doc_id, body, item_id, at, share of every (passage, item) that reaches the share."""
    bounded_batches(docs.sparkSession)
    words = staged(item_words(items, item_key, item_text).filter(F.size("words") >= SEED), "items")
    seeds = staged(seed_table(words), "seeds")
    longest = words.agg(F.max(F.size("words"))).first()[0] or 0
    found = staged(passages(docs, bitmap(seeds, bits), 2 * longest, key, text, bits).withColumn("part_id", F.expr("uuid()")), "passages")
    hits = found.select("part_id", F.explode(F.arrays_zip("seeds", "places")).alias("h"))
    hits = hits.select("part_id", F.col("h.seeds").alias("seed"), F.col("h.places").alias("place"))
    span = hits.join(seeds, "seed").groupBy("part_id", "item_id").agg(
        F.min(F.col("place") - F.col("item_at")).alias("low"), F.max(F.col("place") - F.col("item_at")).alias("high"))
    pairs = (span.join(words.withColumnRenamed("words", "item"), "item_id").join(found.select("part_id", "doc_id", "body", "at", "words"), "part_id"))
    # each gap costs -GAP, so an alignment that reaches the share leaves the diagonals of its seeds by so many words
    slack = F.ceil(F.size("item") * (MATCH * (1 - share) / -GAP)).cast("int")
    start = F.greatest(F.col("low") - slack, F.lit(0))
    stop = F.least(F.col("high") + F.size("item") + slack, F.size("words"))
    pairs = pairs.select("doc_id", "body", "item_id", (F.col("at") + start).cast("bigint").alias("at"), "item", F.slice("words", start + 1, stop - start).alias("part"))
    scored = pairs.mapInArrow(_aligned, "doc_id bigint, body bigint, item_id bigint, at bigint, share double")
    return scored.filter(F.col("share") >= share)


def contaminations(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """doc_id, item_id, share, at: the best alignment of every contaminated (document, item)."""
    return (_flagged(docs, items, key, text, **options).groupBy("doc_id", "item_id")
            .agg(F.max(F.struct("share", "at")).alias("best")).select("doc_id", "item_id", "best.share", "best.at"))


def _key_cells(found: DataFrame, bits: int) -> DataFrame:
    """cell, set: a bitmap of 2^bits bits over the hashes of the flagged (id, text), in at most 2^bits / 64 rows."""
    low = F.xxhash64("_id", "_body").bitwiseAND(F.lit((1 << bits) - 1))
    return (found.select(low.alias("low")).groupBy(F.shiftright("low", 6).alias("cell"))
            .agg(F.bit_or(F.expr("shiftleft(1L, cast(low & 63 as int))")).alias("set")))


def decontaminate(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents without a contamination: those go whose id (it may be null) and text are flagged.

    A broadcast bitmap of fixed size over the flagged keys lets all other documents pass where they are read; only
    documents it holds are shuffled to the exact anti-join."""
    found = staged(_flagged(docs, items, key, text, **options).select(F.col("doc_id").alias("_id"), F.col("body").alias("_body")).distinct(), "flagged")
    bits = options.get("bits", BITS)
    own = packed(docs).withColumn("_key", F.col("_doc")[key].cast("bigint")).withColumn("_hash", F.xxhash64(F.col("_doc")[text]))
    own = own.withColumn("_low", F.xxhash64("_key", "_hash").bitwiseAND(F.lit((1 << bits) - 1))).withColumn("cell", F.shiftright("_low", 6))
    own = own.join(F.broadcast(_key_cells(found, bits)), "cell", "left")  # at most 2^bits / 64 rows
    maybe = F.coalesce(F.expr("(shiftright(set, cast(_low & 63 as int)) & 1) = 1"), F.lit(False))
    kept = own.filter(maybe).join(found, F.col("_key").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_body")), "left_anti")
    return unpacked(own.filter(~maybe).unionByName(kept), docs.columns, [])
