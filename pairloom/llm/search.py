"""Ranked lexical search: compressed postings per shard, merged document at a time.

A shard is what one task has read of the documents, cut where it holds SHARD_DOCS documents or
SHARD_POSTINGS postings.  Its postings are sorted by doc_id and kept as gaps in bytes, a row for each
term.  The written index gives the counts of the corpus (N, L and df), which no shard knows alone.
Then every shard answers all items: a heap merges the postings of the item's terms in the order of
doc_id, one document at a time, and a heap of bounded size, keyed by score and then doc_id, holds the
best.  Terms that together cannot lift a document above the worst of a full heap are not merged any
more, only looked up for documents that others bring; this is exact.  The best of the tasks are merged
globally, in two steps so that no task sees the answers of all others.

The texts move in no shuffle; the compressed postings move once, by shard.
"""

from __future__ import annotations

import heapq
import math
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import bounded_broadcast, materialize, received, sent

#: Documents and postings of one shard at most (the last document may exceed the second).
SHARD_DOCS, SHARD_POSTINGS = 16_384, 1_000_000
#: Distinct terms up to which an index holds the terms of the items alone; beyond, it holds all terms.
VOCABULARY = 500_000
#: About so many (item, term) pairs are answered in one pass over the index.
BLOCK_TERMS = 200_000
#: Bytes of a text that are split at a time.
PIECE = 1 << 20
INDEX = "shard long, term binary, n long, total long, postings binary"

#: Letters A-Z become small, every other byte of ASCII but digits and letters becomes a blank; bytes of other characters stay.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a UTF-8 text, in pieces."""
    text, at = text.translate(_TABLE), 0
    while at < len(text):
        end = text.find(b" ", at + PIECE)
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


def counted(text: bytes | None) -> Counter:
    out: Counter = Counter()
    for piece in terms_of(text or b""):
        out.update(piece)
    return out


# Numbers as bytes: seven bits in each, the lowest first, the last below 128 -------------------------
def packed(x: np.ndarray) -> bytes:
    x = x.astype(np.uint64)
    size = np.ones(len(x), np.int64)
    for k in range(1, 10):
        size += x >= np.uint64(1 << (7 * k))
    ends = np.cumsum(size)
    out, rest = np.zeros(int(ends[-1]) if len(x) else 0, np.uint8), x.copy()
    for k in range(int(size.max(initial=0))):
        has = size > k
        out[(ends - size + k)[has]] = (rest[has] & np.uint64(127)).astype(np.uint8) | np.where(size[has] > k + 1, 128, 0).astype(np.uint8)
        rest >>= np.uint64(7)
    return out.tobytes()


def unpacked(data: bytes) -> np.ndarray:
    b = np.frombuffer(data, np.uint8)
    if not len(b):
        return np.zeros(0, np.uint64)
    starts = np.concatenate([[0], np.flatnonzero(b < 128)[:-1] + 1])
    place = np.arange(len(b)) - np.repeat(starts, np.diff(np.append(starts, len(b))))
    return np.add.reduceat((b & 127).astype(np.uint64) << (7 * place).astype(np.uint64), starts)


class Shard:
    """Documents on their way into one shard of the index."""

    def __init__(self) -> None:
        self.ids, self.lengths, self.postings, self.size = array("q"), array("q"), {}, 0

    def add(self, doc_id: int, counts: Counter, wanted: frozenset | None) -> None:
        place = len(self.ids)
        self.ids.append(doc_id)
        self.lengths.append(counts.total())
        for term in counts if wanted is None else wanted & counts.keys():
            self.postings.setdefault(term, array("q")).extend((place, counts[term]))
            self.size += 1

    def rows(self) -> Iterator[tuple[bytes, int, int, bytes]]:
        """(term, documents, occurrences, postings); the empty term has the documents themselves."""
        ids, lengths = np.frombuffer(self.ids, np.int64), np.frombuffer(self.lengths, np.int64)
        order = np.argsort(ids, kind="stable")
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        ids = ids[order]
        gaps = (ids[1:].astype(np.uint64) - ids[:-1].astype(np.uint64))
        yield b"", len(ids), int(lengths.sum()), ids[:1].tobytes() + packed(np.concatenate([gaps, lengths[order].astype(np.uint64)]))
        for term, told in self.postings.items():
            x = np.frombuffer(told, np.int64).reshape(-1, 2)
            at = place[x[:, 0]]
            by = np.argsort(at)
            at = at[by]
            pairs = np.stack([np.diff(at, prepend=0), x[by, 1]], axis=1)
            yield term, len(at), int(x[:, 1].sum()), packed(pairs.ravel())


def documents_of(postings: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    """doc_ids and lengths of a shard, in the order of doc_id."""
    first, rest = np.frombuffer(postings[:8], np.int64), unpacked(postings[8:])
    return np.cumsum(np.concatenate([first.astype(np.uint64), rest[: n - 1]])).astype(np.int64), rest[n - 1 :].astype(np.int64)


def postings_of(postings: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Places in the shard and term frequencies."""
    x = unpacked(postings).astype(np.int64).reshape(-1, 2)
    return np.cumsum(x[:, 0]), x[:, 1]


def build_index(docs: DataFrame, wanted: frozenset[bytes] | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The written index of all documents with at least one term; of all terms, or of those ``wanted``."""
    told = sent(docs.sparkSession, wanted)

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only, shard, number = received(told), Shard(), TaskContext.get().partitionId() << 32

        def out() -> pa.RecordBatch:
            term, n, total, postings = zip(*shard.rows())
            return pa.RecordBatch.from_arrays(
                [pa.array([number] * len(n), pa.int64()), pa.array(term, pa.binary()), pa.array(n, pa.int64()), pa.array(total, pa.int64()), pa.array(postings, pa.binary())],
                names=["shard", "term", "n", "total", "postings"],
            )

        for batch in batches:
            for doc_id, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                counts = counted(body.as_py())
                if not counts:
                    continue
                shard.add(doc_id, counts, only)
                if len(shard.ids) >= SHARD_DOCS or shard.size >= SHARD_POSTINGS:
                    yield out()
                    shard, number = Shard(), number + 1
        if len(shard.ids):
            yield out()

    rows = docs.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(text).cast("binary").alias("text"))
    return materialize(rows.mapInArrow(shards, INDEX), "search-index")


def item_terms(items: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, term), each once; items of equal ids are one item."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = list(counted(body.as_py()))
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(found), pa.int64()), pa.array(found, pa.binary())], names=["item_id", "term"])

    rows = items.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).cast("long").alias("item_id"), F.col(text).cast("binary").alias("text"))
    return rows.mapInArrow(split, "item_id long, term binary").distinct()


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


class Searcher:
    """Items as lists of weighted terms, and the best documents of each so far."""

    def __init__(self, items: dict[int, list[bytes]], weights: dict[bytes, int], n: int, total: int, k: int):
        self.items, self.weights, self.n, self.total, self.k = items, weights, n, total, k
        self.best: dict[int, list[tuple[int, int]]] = {i: [] for i in items}

    def shard(self, postings: dict[bytes, bytes], documents: tuple[np.ndarray, np.ndarray]) -> None:
        """Meet one shard."""
        ids, lengths = documents
        each, back = np.unique(lengths, return_inverse=True)
        m = np.array([50 + 50 * x * self.n // self.total for x in each.tolist()], np.int64)[back]
        doc = ids.tolist()
        lists: dict[bytes, tuple[int, list, list, dict]] = {}
        for term, told in postings.items():
            w = self.weights.get(term)
            if w:
                at, tf = postings_of(told)
                gain = w * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[at]))
                lists[term] = (int(gain.max()), at.tolist(), gain.tolist(), {})
        for item, terms in self.items.items():
            mine = [lists[t] for t in terms if t in lists]
            if mine:
                self._merge(self.best[item], sorted(mine, key=lambda x: x[0]), doc)

    def _merge(self, best: list[tuple[int, int]], lists: list[tuple[int, list, list, dict]], doc: list[int]) -> None:
        """Document at a time over ``lists``, which ascend by their largest gain."""
        most = [0]  # what the first i lists can add
        for top, *_ in lists:
            most.append(most[-1] + top)
        worst = best[0][0] if len(best) == self.k else 0
        weak = 0  # so many lists cannot fill the heap by themselves
        while weak < len(lists) and most[weak + 1] < max(worst, 1):
            weak += 1
        heads = [(lists[i][1][0], i, 0) for i in range(weak, len(lists))]
        heapq.heapify(heads)
        while heads:
            at, score = heads[0][0], 0
            while heads and heads[0][0] == at:
                _, i, j = heads[0]
                _, places, gains, _ = lists[i]
                if i < weak:  # looked up below, where needed
                    heapq.heappop(heads)
                    continue
                score += gains[j]
                if j + 1 < len(places):
                    heapq.heapreplace(heads, (places[j + 1], i, j + 1))
                else:
                    heapq.heappop(heads)
            for i in range(weak - 1, -1, -1):
                if score + most[i + 1] < worst:
                    break
                _, places, gains, known = lists[i]
                if not known:
                    known.update(zip(places, gains))
                score += known.get(at, 0)
            if score <= 0 or score < worst:
                continue
            entry = (score, -doc[at])
            if len(best) < self.k:
                heapq.heappush(best, entry)
            elif entry > best[0]:
                heapq.heapreplace(best, entry)
            if len(best) == self.k and best[0][0] > worst:
                worst = best[0][0]
                while weak < len(lists) and most[weak + 1] < worst:
                    weak += 1


def _answers(index: DataFrame, searcher: Searcher) -> DataFrame:
    """(task, item_id, doc_id, score): the best of the shards that a task has read."""
    told = sent(index.sparkSession, searcher)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine: Searcher = received(told)
        now, postings, documents = None, {}, None
        for batch in batches:
            for shard, term, n, body in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if shard != now:
                    if documents is not None:
                        mine.shard(postings, documents)
                    now, postings, documents = shard, {}, None
                if term:
                    postings[term] = body
                else:
                    documents = documents_of(body, n)
        if documents is not None:
            mine.shard(postings, documents)
        out = [(item, -d, s) for item, found in mine.best.items() for s, d in found]
        task = TaskContext.get().partitionId()
        for at in range(0, len(out), 10_000):
            part = out[at : at + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array([task] * len(part), pa.int32()), *(pa.array([x[c] for x in part], pa.int64()) for c in range(3))], names=["task", "item_id", "doc_id", "score"])

    by_shard = index.select("shard", "term", "n", "postings").repartition("shard").sortWithinPartitions("shard", "term")
    return by_shard.mapInArrow(search, "task int, item_id long, doc_id long, score long")


def _best(rows: DataFrame, by: list[str | Column], k: int) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(F.desc("score"), "doc_id"))).where(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = 50, key: str = "doc_id", text: str = "text") -> DataFrame:
    """item_id, rank, doc_id and score of each item's ``k`` best documents with a score above 0.

    Rows without a key are no documents and no items; null and empty texts have no terms.  Rows that
    repeat a doc_id are documents each.  Items with equal ids are one item with the terms of all.  No
    term of an item in any document, or an empty table: no row.  Other columns are not read.
    """
    spark = docs.sparkSession
    pairs = materialize(item_terms(items), "item-terms")
    distinct = materialize(pairs.select("term").distinct(), "query-terms")
    few = distinct.count() <= VOCABULARY
    index = build_index(docs, frozenset(bytes(r["term"]) for r in distinct.toLocalIterator()) if few else None, key, text)
    n, total = index.where(F.length("term") == 0).agg(F.sum("n"), F.sum("total")).first()
    known = index.where(F.length("term") > 0)
    df = known.groupBy("term").agg(F.sum("n").alias("df"))
    weighted = materialize(pairs.join(df, "term"), "weighted-terms")
    blocks = max(1, math.ceil(weighted.count() / BLOCK_TERMS))
    found = None
    for b in range(blocks if n else 0):
        mine = weighted.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b)
        got: dict[int, list[bytes]] = {}
        weights = {}
        for r in mine.collect():
            got.setdefault(r["item_id"], []).append(bytes(r["term"]))
            weights[bytes(r["term"])] = weight(n, r["df"])
        part = index
        if blocks > 1 or not few:
            asked = mine.select("term").distinct().unionAll(spark.sql("SELECT X'' AS term"))
            part = index.join(bounded_broadcast(asked, len(weights)), "term", "left_semi")
        rows = _answers(part, Searcher(got, weights, n, total, k))
        found = rows if found is None else found.unionAll(rows)
    if found is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    some = _best(found, ["item_id", F.pmod("task", F.lit(64))], k)
    return _best(some, ["item_id"], k).select("item_id", "rank", "doc_id", "score")
