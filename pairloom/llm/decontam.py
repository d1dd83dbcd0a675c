"""Benchmark decontamination: random-walk embedding, bit sampling, exact edit verification.

A CGK walk reads a text from a place on and, at each step, writes down the byte that it stands on and
moves on or stays by a random bit of that step and byte.  After an edit two walks soon run side by
side again, so edit distance becomes Hamming distance.  Repetitions sample some steps of the walk;
equal samples make windows of a document and of an item meet.  Items are indexed at every byte,
documents are read in strides, so a planted passage has several windows, and it becomes a candidate
where enough of them agree on the item within the shift that its edits allow.  The whole item is then
verified there by exact edit distance (bit-parallel, semi-global).

Windows, strides and votes follow from the lengths of the items, and the number of walks from the target
recall: walks are added until edited copies of the shortest items, at the full rate, are found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import received, sent

#: Lower-casing of A-Z, and white space as spaces; lengths stay.
NORMAL = bytes(b + 32 if 65 <= b <= 90 else 32 if 9 <= b <= 13 else b for b in range(256))
#: Bytes of a window at most (a walk of twice as many steps), and windows of a passage of the shortest item.
WINDOW, WINDOWS = 20, 10
#: Of the windows of an item one and one more for each EACH of them have to agree, VOTES at most.
EACH, VOTES = 5, 8
#: Steps sampled by a repetition, and repetitions of each walk.
PLACES, SAMPLES = 12, 4
#: Share of edited copies that the walks have to find, copies that tell it, and walks at most.
TARGET, COPIES, WALKS = 0.95, 400, 12
#: Windows looked up at once.
BLOCK = 1 << 15
#: Bytes of text searched at once.
TEXTS = 1 << 21
#: Bytes of items in one broadcast table, about (SAMPLES x walks x 12 bytes for each of them).
TABLE_BYTES = 500_000
SEED = 17


def edited(text: bytes, edits: int, g: np.random.Generator) -> bytes:
    """A copy with as many random substitutions, insertions and deletions."""
    out = bytearray(text)
    for kind, at, byte in zip(g.integers(0, 3, edits), g.random(edits), g.integers(97, 123, edits), strict=True):
        i = int(at * len(out))
        out[i : i + (kind != 1)] = b"" if kind == 2 else bytes([byte])
    return bytes(out)


class Walks:
    """Items of like length with the samples of their walks from every byte on."""

    def __init__(self, items: list[tuple[int, bytes]], rate: float, target: float = TARGET):
        self.items = items
        size = np.array([len(t) for _, t in items], np.int64)
        self.size, self.most = size, (rate * size).astype(np.int64)
        shortest = int(size.min())
        self.window = max(2, min(WINDOW, shortest // 3))
        self.steps = 2 * self.window
        self.stride = max(1, (shortest - self.window) // WINDOWS)
        # the more windows an item has, the more of them have to agree
        self.votes = np.clip(1 + (size - self.window) // self.stride // EACH, 1, VOTES)
        self.walks: list[tuple] = []
        g = np.random.default_rng(SEED)
        easy = np.argsort(size, kind="stable")[: max(1, len(size) // 5)]
        copies = [(int(i), edited(items[i][1], int(self.most[i]), g)) for i in easy[g.integers(0, len(easy), COPIES)]]
        while len(self.walks) < WALKS:
            self.walks.append(self._walk(g))
            if self.recall(copies) >= target:
                break

    def _walk(self, g: np.random.Generator) -> tuple:
        bits = g.integers(0, 2, (self.steps, 256)).astype(np.int32)
        n = min(PLACES, self.steps)
        samples = [(np.sort(g.choice(self.steps, n, replace=False)), g.integers(0, 2**63, (n, 256), dtype=np.uint64) << np.uint64(1)) for _ in range(SAMPLES)]
        gap = bytes(self.steps + 1)
        heads = np.cumsum([0] + [len(t) + len(gap) for _, t in self.items[:-1]])
        buf = np.frombuffer(gap.join([*(t for _, t in self.items), b""]), np.uint8)
        reach = np.maximum(self.size - self.window + 1, 1)
        owner = np.repeat(np.arange(len(self.items)), reach)
        offset = np.arange(len(owner)) - np.repeat(np.cumsum(reach) - reach, reach)
        tables = []
        for sample, code in zip(samples, self._codes(buf, heads[owner] + offset, bits, samples), strict=True):
            order = np.argsort(code, kind="stable")
            width = max(12, int(np.ceil(np.log2(len(code)))) + 4)
            maybe = np.zeros(1 << width, bool)
            maybe[code >> np.uint64(64 - width)] = True
            tables.append((code[order], owner[order].astype(np.int32), offset[order].astype(np.int32), np.uint64(64 - width), maybe))
        return bits, samples, tables

    @staticmethod
    def _codes(buf: np.ndarray, starts: np.ndarray, bits: np.ndarray, samples: list) -> list[np.ndarray]:
        """The samples of the walks from ``starts``, each as one number."""
        at, seen = starts.astype(np.int32), np.empty((len(bits), len(starts)), np.uint8)
        for step, move in enumerate(bits):
            np.take(buf, at, out=seen[step])
            at += move[seen[step]]
        out = []
        for places, numbers in samples:
            code = numbers[0][seen[places[0]]]
            for p, n in zip(places[1:], numbers[1:], strict=True):
                code += n[seen[p]]
            out.append(code)
        return out

    def met(self, buf: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(item, diagonal, start) of equal samples; a diagonal is a window's place in the text less its
        place in the item, plus the item's length.  ``buf`` is padded by the steps of a walk."""
        out: list[tuple] = []
        for begin in range(0, max(1, length), BLOCK * self.stride):
            starts = np.arange(begin, min(begin + BLOCK * self.stride, max(1, length)), self.stride)
            for bits, samples, tables in self.walks:
                for code, (known, owner, offset, shift, maybe) in zip(self._codes(buf, starts, bits, samples), tables, strict=True):
                    at = np.flatnonzero(maybe[code >> shift])
                    if not len(at):
                        continue
                    c = code[at]
                    low = np.searchsorted(known, c, "left")
                    same = known[np.minimum(low, len(known) - 1)] == c
                    at, low, c = at[same], low[same], c[same]
                    n = np.searchsorted(known, c, "right") - low
                    row = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
                    start = np.repeat(starts[at], n)
                    out.append((owner[row], start - offset[row] + self.size[owner[row]], start))
        if not out:
            return (np.empty(0, np.int64),) * 3
        return tuple(np.concatenate(x).astype(np.int64) for x in zip(*out, strict=True))

    def regions(self, buf: np.ndarray, length: int) -> Iterator[tuple[int, int, int]]:
        """(item number, begin, end): parts of a text where enough windows agree on an item."""
        item, diagonal, start = self.met(buf, length)
        key = item << 40 | diagonal
        order = np.lexsort((start, key))
        key, start = key[order], start[order]
        new = np.r_[True, (key[1:] != key[:-1]) | (start[1:] != start[:-1])][: len(key)]
        key, start = key[new], start[new]
        item = key >> 40
        # the windows of a passage lie on diagonals that differ by its edits at most
        last = np.searchsorted(key, key + self.most[item], "right")
        changes = np.r_[np.flatnonzero(start[1:] != start[:-1]) + 1, len(start)]
        other = changes[np.searchsorted(changes, np.arange(len(start)), "right")] if len(start) else start
        enough = (last - np.arange(len(key)) >= self.votes[item]) & ((other < last) | (self.votes[item] == 1))
        item, diagonal = item[enough], key[enough] & ((1 << 40) - 1)
        held = None
        for i, d in dict.fromkeys(zip(item.tolist(), diagonal.tolist(), strict=True)):
            m, k = int(self.size[i]), int(self.most[i])
            begin, end = d - m - k, d + k
            if held and held[0] == i and begin <= held[2]:
                held = (i, held[1], end)
                continue
            if held:
                yield held
            held = (i, begin, end)
        if held:
            yield held

    def recall(self, copies: list[tuple[int, bytes]]) -> float:
        """The share of edited copies (item number, bytes) of which a candidate arises."""
        gap = bytes(2 * int(self.size.max()) + self.steps)
        heads = np.cumsum([0] + [len(t) + len(gap) for _, t in copies])
        raw = gap.join([*(t for _, t in copies), b""])
        found = set()
        for i, begin, end in self.regions(np.frombuffer(raw + bytes(self.steps + 1), np.uint8), len(raw)):
            found.update((i, int(n)) for n in range(np.searchsorted(heads, begin, "right") - 1, np.searchsorted(heads, end, "left")))
        return sum((i, n) in found for n, (i, _) in enumerate(copies)) / len(copies)


class Index:
    """Items by length in octaves, each with its own windows; items that allow no edit stand alone."""

    def __init__(self, items: list[tuple[int, bytes]], rate: float, target: float = TARGET):
        self.exact = [(n, t) for n, t in items if int(rate * len(t)) == 0]
        by: dict[int, list[tuple[int, bytes]]] = {}
        for n, t in items:
            if int(rate * len(t)):
                by.setdefault(min(len(t).bit_length(), 7), []).append((n, t))
        self.groups = [Walks(group, rate, target) for _, group in sorted(by.items())]


def best_end(item: bytes, text: bytes, most: int) -> tuple[int, int] | None:
    """(edits, end) of the best place of ``item`` inside ``text``; None beyond ``most`` edits.

    Bit-parallel dynamic programming (Myers): one column of the matrix is one integer.
    """
    m = len(item)
    peq: dict[int, int] = {}
    for i, c in enumerate(item):
        peq[c] = peq.get(c, 0) | 1 << i
    mask, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = mask, 0, m, (m, 0)
    for j, c in enumerate(text):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & mask
        mh = pv & xh
        score += 1 if ph & top else -1 if mh & top else 0
        ph = ph << 1 & mask
        mh = mh << 1 & mask
        pv = mh | ~(xv | ph) & mask
        mv = ph & xv
        if score < best[0]:
            best = (score, j + 1)
    return best if best[0] <= most else None


class Searcher:
    def __init__(self, index: Index):
        self.index = index

    def find(self, texts: list[str | None]) -> list[dict[int, tuple[int, int]]]:
        """For each text: item -> (edits, end in bytes), the best place of each item found."""
        raw = [(t or "").encode().translate(NORMAL) for t in texts]
        out: list[dict[int, tuple[int, int]]] = [{} for _ in raw]
        for n, t in self.index.exact:
            for d, r in enumerate(raw):
                at = r.find(t)
                if at >= 0:
                    out[d][n] = (0, at + len(t))
        gap = bytes(2 * WINDOW + 1)
        heads = np.cumsum([0] + [len(t) + len(gap) for t in raw])
        joined = gap.join([*raw, b""])
        buf = np.frombuffer(joined + gap, np.uint8)
        for group in self.index.groups:
            for i, begin, end in group.regions(buf, len(joined)):
                n, item = group.items[i]
                most = int(group.most[i])
                d = max(0, int(np.searchsorted(heads, begin, "right")) - 1)
                while d < len(raw) and heads[d] < end:
                    # a text shorter than the item by more than the edits allowed cannot hold it
                    if len(raw[d]) >= len(item) - most:
                        low = max(0, begin - int(heads[d]))
                        got = best_end(item, raw[d][low : max(0, end - int(heads[d]))], most)
                        if got:
                            mine = (got[0], low + got[1])
                            out[d][n] = min(out[d].get(n, mine), mine)
                    d += 1
        return out


def item_tables(benchmark: DataFrame, key: str, text: str = "text") -> Iterator[list[tuple]]:
    """(key, normal bytes) of the items, in tables of about TABLE_BYTES: the driver holds one at a time.

    Null, empty and keyless items are no items; equal rows count once, and equal keys with different
    texts are different items.
    """
    items = benchmark.where(F.col(key).isNotNull() & (F.length(text) > 0)).select(F.col(key).alias("k"), F.col(text).alias("t")).distinct()
    total = items.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    tables = -(-total // TABLE_BYTES)
    for n in range(tables):
        rows = items.where(F.pmod(F.xxhash64("t"), F.lit(tables)) == n).collect()
        if rows:
            yield sorted({(r["k"], r["t"].encode().translate(NORMAL)) for r in rows}, key=lambda x: (len(x[1]), x[1], str(x[0])))


def contaminated(
    docs: DataFrame, benchmark: DataFrame, rate: float = 0.2, key: str = "doc_id", text: str = "text", item: str = "item_id", target: float = TARGET
) -> DataFrame:
    """(key, item, edits, end_byte): items found in a document within ``rate`` of their bytes.

    One row for each row of ``docs`` and item, at its best place (fewest edits, then earliest).
    Null and empty texts hold nothing.  Texts differ by case of A-Z and kind of white space for
    free.  Every row is a verified place; of the passages that differ by the full rate from the shortest
    items the share ``target`` is found, of others more.  Documents are read once for each table of items
    (TABLE_BYTES) and never shuffled.  Keys of items may be of any type.
    """
    spark = docs.sparkSession
    kind, ikind = docs.schema[key].dataType, benchmark.schema[item].dataType
    out = None
    for table in item_tables(benchmark, item):
        told = sent(spark, Index([(n, t) for n, (_, t) in enumerate(table)], rate, target))

        def run(batches: Iterator[pa.RecordBatch], told=told) -> Iterator[pa.RecordBatch]:
            search = Searcher(received(told))
            for whole in batches:
                at = 0
                while at < whole.num_rows:
                    # texts are taken together up to a size, so that memory stays bounded
                    texts, size, begun = [], 0, at
                    while at < whole.num_rows and (size < TEXTS or not texts):
                        texts.append(whole.column(1)[at].as_py())
                        size += len(texts[-1] or "")
                        at += 1
                    hits = [(begun + d, n, *v) for d, found in enumerate(search.find(texts)) for n, v in sorted(found.items())]
                    if hits:
                        rows, *cols = zip(*hits, strict=True)
                        yield pa.RecordBatch.from_arrays([whole.column(0).take(pa.array(rows)), *(pa.array(c, pa.int64()) for c in cols)], names=["k", "n", "edits", "end_byte"])

        found = docs.select(F.col(key), F.col(text).alias("__text")).mapInArrow(run, f"k {kind.simpleString()}, n long, edits long, end_byte long")
        names = spark.createDataFrame([(n, k) for n, (k, _) in enumerate(table)], T.StructType([T.StructField("n", T.LongType()), T.StructField("i", ikind)]))
        one = found.join(F.broadcast(names), "n").select(F.col("k").alias(key), F.col("i").alias(item), "edits", "end_byte")
        out = one if out is None else out.unionAll(one)
    if out is None:
        return spark.createDataFrame([], T.StructType([T.StructField(key, kind), T.StructField(item, ikind), T.StructField("edits", T.LongType()), T.StructField("end_byte", T.LongType())]))
    return out


def without_items(docs: DataFrame, benchmark: DataFrame, rate: float = 0.2, text: str = "text", item: str = "item_id", target: float = TARGET) -> DataFrame:
    """The rows of ``docs`` in whose text no item is found (as ``contaminated`` finds them), whatever their
    keys; each row is judged by its own text.  Narrow: one pass for each table of items."""
    at, schema = docs.columns.index(text), docs.schema
    for table in item_tables(benchmark, item):
        told = sent(docs.sparkSession, Index([(n, t) for n, (_, t) in enumerate(table)], rate, target))

        def keep(batches: Iterator[pa.RecordBatch], told=told) -> Iterator[pa.RecordBatch]:
            search = Searcher(received(told))
            for whole in batches:
                clean: list[bool] = []
                while len(clean) < whole.num_rows:
                    texts, size = [], 0
                    while len(clean) + len(texts) < whole.num_rows and (size < TEXTS or not texts):
                        texts.append(whole.column(at)[len(clean) + len(texts)].as_py())
                        size += len(texts[-1] or "")
                    clean += [not found for found in search.find(texts)]
                yield whole.filter(pa.array(clean, pa.bool_()))

        docs = docs.mapInArrow(keep, schema)
    return docs
