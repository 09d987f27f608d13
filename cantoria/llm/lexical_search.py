"""Ranked lexical search: every item of a query set against all documents, by dense blocked matrix products.

1. Items are dealt into blocks of about ``BLOCK_TERMS`` distinct terms and ``BLOCK_ITEMS`` items by the hash of the item;
   one block's vocabulary, and nothing else of the items, is broadcast. A larger query set makes more blocks, each a
   pass over the documents.
2. One pass over the whole texts counts all terms and those of the vocabulary (found by a 64-bit hash, confirmed by a
   second one); the counts are written once. Document frequencies and corpus totals are aggregates of that table.
3. Document tiles (rows x a vocabulary tile, float64) of term impacts are multiplied with vocabulary tiles of item
   weights (terms x items) by BLAS. Impacts and weights are whole numbers; a vocabulary tile has so few terms that
   every partial sum stays below 2^53, so each product is exact, and tiles are added up as 64-bit integers.
4. A task keeps the k best documents of each item over its tiles (equal scores by ascending id, so ties are safe), and
   the best of all tasks are ranked: at most k rows an item and task reach the shuffle.

A text longer than ``CHUNK`` bytes is handled in pieces that end between terms.

Defined results: null and empty texts and items have no terms; documents without a term do not count and items
without one have no rows; equal items (id and text) are one item, items that differ in their text are ranked each on
their own; every row of documents counts, repeated rows take a rank each; a null document id comes after all others
of its score; an empty side gives an empty result; other columns are not carried.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cantoria.llm.common import bounded_batches, staged
from cantoria.llm.textbytes import CHUNK, column_bytes, mix, prefix_sums, word_spans

TOP = 10
BLOCK_TERMS = 1 << 14
BLOCK_ITEMS = 512
TILE_DOCS = 512
TILE_TERMS = 2048
EXACT = 1 << 53
#: an impact is (UNIT * tf) div (1000 * tf + 8 * m), so below UNIT / 1000
UNIT = 1_000_000_000
_CHAIN = np.uint64(0xD6E8FEB86659FD93)
_state: dict = {}


def folded(data: np.ndarray) -> np.ndarray:
    """Bytes of terms with A-Z made small; all others become spaces. UTF-8 bytes beyond ASCII belong to terms."""
    if "fold" not in _state:
        t = np.full(256, 0x20, np.uint8)
        for c in range(256):
            if c >= 0x80 or chr(c).isalnum():
                t[c] = c + 32 if 0x41 <= c <= 0x5A else c
        _state["fold"] = t
    return _state["fold"][data]


def pieces(data: np.ndarray, offsets: np.ndarray, size: int = CHUNK) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row of each part, bytes, offsets) with about ``size`` bytes each; a longer row is cut between terms."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + size, side="right")) - 1
        if b > a:
            yield np.arange(a, b), data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]
            a = b
            continue
        at, stop = int(offsets[a]), int(offsets[a + 1])
        while at < stop:
            end = min(at + size, stop)
            while end < stop and data[end] != 0x20:  # at most to the end of this term
                gap = np.flatnonzero(data[end:min(end + size, stop)] == 0x20)
                end = end + int(gap[0]) if len(gap) else min(end + size, stop)
            yield np.array([a]), data[at:end], np.array([0, end - at])
            at = end
        a += 1


def term_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two 64-bit hashes of every term, and for each row the index of its first term (n + 1)."""
    starts, ends, first = word_spans(data, offsets)
    sums, down = prefix_sums(data)
    one = mix((sums[ends] - sums[starts]) * down[starts])
    sums, down = prefix_sums(data ^ np.uint8(0xA5))
    return one, mix((sums[ends] - sums[starts]) * down[starts] * _CHAIN + one), first


def _terms(batches):
    """Distinct terms of items."""
    for batch in batches:
        data, offsets = column_bytes(batch.column("text"))
        one, two, first = term_hashes(folded(data), offsets)
        row = np.repeat(np.arange(len(first) - 1), np.diff(first))
        order = np.lexsort((two, one, row))
        row, one, two = row[order], one[order], two[order]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (one[1:] != one[:-1]) | (two[1:] != two[:-1])
        row, one, two = row[new], one[new], two[new]
        at = pa.array(np.searchsorted(row, np.arange(len(first))).astype(np.int32))
        yield pa.RecordBatch.from_arrays([batch.column("item_id"), batch.column("body"), pa.ListArray.from_arrays(at, pa.array(one.view(np.int64))),
                                          pa.ListArray.from_arrays(at, pa.array(two.view(np.int64)))], names=["item_id", "body", "one", "two"])


def item_terms(items: DataFrame, key: str, text: str) -> DataFrame:
    """item_id, body (hash of the text), one, two: hashes of the distinct terms of each distinct item that has some."""
    t = F.coalesce(F.col(text), F.lit(""))
    rows = items.select(F.col(key).cast("bigint").alias("item_id"), t.alias("text"), F.sha2(t, 256).alias("body")).distinct()
    return rows.mapInArrow(_terms, "item_id bigint, body string, one array<bigint>, two array<bigint>").filter(F.size("one") > 0)


def count_terms(docs: DataFrame, one: np.ndarray, two: np.ndarray, key: str, text: str) -> DataFrame:
    """doc_id, n (terms of the text), terms (places in the vocabulary, whose hashes ascend), tfs, for documents with n > 0."""
    shared = docs.sparkSession.sparkContext.broadcast((one, two))

    def run(batches):
        one, two = shared.value
        for batch in batches:
            data, offsets = column_bytes(batch.column(1))
            n = np.zeros(len(offsets) - 1, np.int64)
            keys, counts = [], []
            for rows, part, at in pieces(folded(data), offsets):
                h, g, first = term_hashes(part, at)
                n[rows] += np.diff(first)
                place = np.searchsorted(one, h)
                place[place == len(one)] = 0
                hit = np.flatnonzero((one[place] == h) & (two[place] == g))
                row = rows[np.searchsorted(first, hit, side="right") - 1]
                k, c = np.unique(row * len(one) + place[hit], return_counts=True)
                keys.append(k)
                counts.append(c)
            keys, counts = np.concatenate([np.zeros(0, np.int64), *keys]), np.concatenate([np.zeros(0, np.int64), *counts])
            flat, back = np.unique(keys, return_inverse=True)
            tf = np.zeros(len(flat), np.int64)
            np.add.at(tf, back, counts)
            some = np.flatnonzero(n > 0)
            row = np.searchsorted(some, flat // len(one))
            at = pa.array(np.searchsorted(row, np.arange(len(some) + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(some)), pa.array(n[some]), pa.ListArray.from_arrays(at, pa.array((flat % len(one)).astype(np.int32))),
                pa.ListArray.from_arrays(at, pa.array(tf.astype(np.int32)))], names=["doc_id", "n", "terms", "tfs"])

    return docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text)).mapInArrow(run, "doc_id bigint, n bigint, terms array<int>, tfs array<int>")


def lengths(n: np.ndarray, docs: int, total: int) -> np.ndarray:
    """m of each document: 100 - 90 + ((90 * n * docs) div total)."""
    if 90 * int(n.max(initial=0)) * docs >= 1 << 63:
        return np.array([10 + 90 * int(x) * docs // total for x in n], np.int64)
    return 10 + 90 * n * docs // total


class _Best:
    """The k best (score, doc_id) of each item seen so far; null ids follow the others of their score."""

    def __init__(self, items: int, k: int):
        self.k, self.floor = k, np.ones(items, np.int64)
        self.item, self.score, self.id, self.none = (np.zeros(0, np.int64) for _ in range(4))

    def add(self, scores: np.ndarray, ids: np.ndarray, none: np.ndarray) -> None:
        row, item = np.nonzero(scores >= self.floor)
        item, score = np.concatenate([self.item, item]), np.concatenate([self.score, scores[row, item]])
        ids, none = np.concatenate([self.id, ids[row]]), np.concatenate([self.none, none[row]])
        order = np.lexsort((ids, none, -score, item))
        item = item[order]
        rank = np.arange(len(item)) - np.searchsorted(item, item)
        order, item = order[rank < self.k], item[rank < self.k]
        self.item, self.score, self.id, self.none = item, score[order], ids[order], none[order]
        full = rank[rank < self.k] == self.k - 1
        self.floor[item[full]] = self.score[full]


def _search(counted: DataFrame, postings: tuple, docs: int, total: int, items: int, k: int) -> DataFrame:
    """item_no, doc_id, score: the k best of each item in each task. postings: term (ascending), item, weight."""
    shared = counted.sparkSession.sparkContext.broadcast(postings)
    heaviest = max(1, int(postings[2].max(initial=0)))
    step = max(1, min(TILE_TERMS, (EXACT - 1) // (heaviest * (UNIT // 1000))))

    def run(batches):
        term, item, weight = shared.value
        words = int(term[-1]) + 1
        best = _Best(items, k)
        for batch in batches:
            n = batch.column("n").to_numpy()
            lists, tfs = batch.column("terms"), batch.column("tfs")
            at = np.asarray(lists.offsets, dtype=np.int64)
            place = np.asarray(lists.values, dtype=np.int64)[at[0]:at[-1]]
            tf = np.asarray(tfs.values, dtype=np.int64)[int(tfs.offsets[0].as_py()):][:len(place)]
            at = at - at[0]
            row = np.repeat(np.arange(len(n)), np.diff(at))
            impact = UNIT * tf // (1000 * tf + 8 * lengths(n, docs, total)[row])
            ids = batch.column("doc_id").fill_null(0).to_numpy()
            none = batch.column("doc_id").is_null().to_numpy(zero_copy_only=False).astype(np.int64)
            for a in range(0, len(n), TILE_DOCS):
                b = min(a + TILE_DOCS, len(n))
                own = slice(at[a], at[b])
                r, p, x = row[own] - a, place[own], impact[own]
                scores = np.zeros((b - a, items), np.int64)
                for low in range(0, words, step):
                    here = (p >= low) & (p < low + step)
                    if not here.any():
                        continue
                    i, j = np.searchsorted(term, [low, low + step])
                    tile = np.zeros((step, items))
                    tile[term[i:j] - low, item[i:j]] = weight[i:j]
                    dense = np.zeros((b - a, step))
                    dense[r[here], p[here] - low] = x[here]
                    scores += (dense @ tile).astype(np.int64)
                best.add(scores, ids[a:b], none[a:b])
        yield pa.RecordBatch.from_arrays([pa.array(best.item), pa.array(best.id, mask=best.none.astype(bool)), pa.array(best.score)],
                                         names=["item_no", "doc_id", "score"])

    return counted.mapInArrow(run, "item_no bigint, doc_id bigint, score bigint")


def rank(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id",
         item_text: str = "text", k: int = TOP, block_terms: int = BLOCK_TERMS, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of every item."""
    spark = docs.sparkSession
    bounded_batches(spark)
    queries = staged(item_terms(items, item_key, item_text), "items")
    n_items, n_terms = queries.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("one")), F.lit(0))).first()
    blocks = max(1, math.ceil(n_items / block_items), math.ceil(n_terms / block_terms))
    out = None
    for block in range(blocks if n_items else 0):
        own = queries.filter(F.pmod(F.xxhash64("item_id", "body"), F.lit(blocks)) == block).toArrow()  # bounded, see 1.
        if own.num_rows == 0:
            continue
        found = _rank_block(docs, own, key, text, k)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")


def _rank_block(docs: DataFrame, items: pa.Table, key: str, text: str, k: int) -> DataFrame:
    spark = docs.sparkSession
    lists = items["one"].combine_chunks()
    sizes = np.asarray(lists.value_lengths())
    one = np.asarray(lists.flatten()).view(np.uint64)
    two = np.asarray(items["two"].combine_chunks().flatten()).view(np.uint64)
    vocabulary, first, place = np.unique(one, return_index=True, return_inverse=True)
    if (two != two[first][place]).any():
        raise ValueError("two terms of the items share a 64-bit hash")
    counted = staged(count_terms(docs, vocabulary, two[first], key, text), "counts")
    n_docs, total = counted.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = counted.select(F.explode("terms").alias("term")).groupBy("term").count().toArrow()  # one row a vocabulary term
    freq = np.zeros(len(vocabulary), np.int64)
    freq[df["term"].to_numpy()] = df["count"].to_numpy()
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(f) + 1))) for f in freq], np.int64)
    order = np.argsort(place, kind="stable")
    item = np.repeat(np.arange(len(sizes)), sizes)
    best = _search(counted, (place[order], item[order], weight[place[order]].astype(np.float64)), n_docs, total, len(sizes), k)
    by = Window.partitionBy("item_no").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ids = spark.createDataFrame(pa.table({"item_no": np.arange(len(sizes)), "item_id": items["item_id"]}))
    top = best.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)
    return top.join(F.broadcast(ids), "item_no").select("item_id", "rank", "doc_id", "score")  # ids: one block's items


TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def sql(k: int = TOP) -> str:
    small = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
    return f"""
WITH d AS (SELECT row_number() OVER () AS row_no, doc_id, regexp_extract_all(translate(text, {small}), '{TERM}') AS words FROM documents),
t AS (SELECT row_no, unnest(words) AS term FROM d),
tf AS (SELECT row_no, term, count(*) AS tf FROM t GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
c AS (SELECT count(*) AS docs, CAST(sum(len(words)) AS BIGINT) AS total FROM d WHERE len(words) > 0),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS w FROM df, c),
m AS (SELECT row_no, doc_id, 10 + (90 * len(words) * docs) // total AS m FROM d, c WHERE len(words) > 0),
q AS (SELECT DISTINCT item_id, text, unnest(regexp_extract_all(translate(text, {small}), '{TERM}')) AS term FROM benchmark),
s AS (SELECT item_id, text, row_no, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
      FROM q JOIN w USING (term) JOIN tf USING (term) JOIN m USING (row_no) GROUP BY ALL),
r AS (SELECT item_id, doc_id, score, CAST(row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank
      FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= {k}"""
