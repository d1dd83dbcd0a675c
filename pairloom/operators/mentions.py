"""Mentions of known names in texts: an Aho-Corasick automaton in packed arrays, run over many texts in step.

Names of a bounded number of bytes make one table; more names make more tables, each one more pass of
the same tasks over their texts.  The automaton is built level by level.  Its edges are sorted keys
(state * 256 + byte), and the edge at position k leads to state k + 1, so states need no targets.  Texts
are laid end to end and cut into lanes that overlap by the longest name; all lanes take one byte at a
time, so a very long text is many lanes and no single slow row.  No text is shuffled or collected.

Letters match in either case, character by character.  A mention stands between word boundaries, and
mentions of one name in one text do not overlap: the leftmost is taken.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.stage import staged

#: Bytes of names in one table (about 24 bytes of arrays for each), and characters of texts laid end to end at a time.
TABLE_BYTES, BLOCK = 4 << 20, 1 << 21
#: Least bytes that a lane takes on its own, and states whose transitions are held whole (2 KB each).
LANE, DENSE = 256, 8192
#: Names with fewer characters are left out.
LEAST = 4
#: Stands between texts; no word character.
BETWEEN = "\U0010ffff"

MENTION = "array<struct<category:string,text:string,start:int,end:int,other:string>>"


class _Folded(dict):
    """One character for each: small letters, by way of capitals, so that all forms of a letter meet."""

    def __missing__(self, code: int) -> int:
        up = chr(code).upper()
        self[code] = ord((up if len(up) == 1 else chr(code)).lower()[0])
        return self[code]


def folded(text: str, table: _Folded = _Folded()) -> str:  # noqa: B006  (shared on purpose)
    return text.translate(table)


def is_word(codes: np.ndarray) -> np.ndarray:
    """Letters, digits and the low line."""
    each, back = np.unique(codes, return_inverse=True)
    return np.array([chr(c).isalnum() or c == 95 for c in each.tolist()], bool)[back] if len(codes) else np.zeros(0, bool)


class Automaton:
    """All names of one table.  ``found`` gives (number of the name, start, end) in bytes."""

    def __init__(self, names: list[bytes]):
        self.lengths = np.array([len(n) for n in names], np.int64)
        self.longest = int(self.lengths.max(initial=0))
        body = np.frombuffer(b"".join(names), np.uint8)
        first = np.concatenate([[0], np.cumsum(self.lengths)[:-1]]) if names else np.zeros(0, np.int64)
        at, keys, ends, levels, count = np.zeros(len(names), np.int64), [], [], [], 0
        for depth in range(self.longest):
            live = np.flatnonzero(self.lengths > depth)
            key, back = np.unique(at[live] * 256 + body[first[live] + depth], return_inverse=True)
            at[live] = count + 1 + back
            keys.append(key)
            done = live[self.lengths[live] == depth + 1]
            ends.append(np.stack([at[done], done]))
            levels.append((count, count + len(key)))
            count += len(key)
        self.keys = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        self.name = np.full(count + 1, -1, np.int32)
        for state, number in ends:
            self.name[state] = number
        # where to go on after a mismatch, and the next shorter name that ends here too
        self.fail, self.shorter = np.zeros(count + 1, np.int64), np.zeros(count + 1, np.int64)
        self.full = np.zeros((min(count + 1, DENSE), 256), np.int64)
        for depth, (low, high) in enumerate(levels):
            states = np.arange(low + 1, high + 1)
            parent, byte = self.keys[low:high] >> 8, self.keys[low:high] & 255
            if depth:
                self.fail[states] = self.step(self.fail[parent], byte)
            else:
                self.full[0, byte] = states
            # rows of states are whole once those of the states that they fall back to are
            mine = states[states < len(self.full)]
            self.full[mine] = self.full[self.fail[mine]]
            if high < count:
                low2, high2 = levels[depth + 1]
                kids = self.keys[low2:high2]
                few = (kids >> 8) < len(self.full)
                self.full[kids[few] >> 8, kids[few] & 255] = np.arange(low2 + 1, high2 + 1)[few]
        for low, high in levels:
            states = np.arange(low + 1, high + 1)
            back = self.fail[states]
            self.shorter[states] = np.where(self.name[back] >= 0, back, self.shorter[back])
        self.last = np.where(self.name >= 0, np.arange(count + 1), self.shorter)  # the longest name that ends here

    def step(self, states: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The states after one byte each: from whole rows of the first states, by search and falling back beyond."""
        if len(self.full) == len(self.fail):
            return self.full.ravel().take(states * 256 + byte)
        out, live = np.zeros(len(states), np.int64), np.arange(len(states))
        s, b = states, byte.astype(np.int64)
        while len(live):
            near = s < len(self.full)
            out[live[near]] = self.full[s[near], b[near]]
            s, b, live = s[~near], b[~near], live[~near]
            key = s * 256 + b
            k = np.searchsorted(self.keys, key)
            hit = self.keys[np.minimum(k, len(self.keys) - 1)] == key
            out[live[hit]] = k[hit] + 1
            s, b, live = self.fail[s[~hit]], b[~hit], live[~hit]
        return out

    def found(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.longest or not len(text):
            return (np.zeros(0, np.int64),) * 3
        lane, before = max(LANE, 2 * self.longest), self.longest - 1
        lanes = -(-len(text) // lane)
        padded = np.full(lanes * lane + before, 255, np.uint8)  # a byte that no text has
        padded[before : before + len(text)] = text
        columns = np.lib.stride_tricks.as_strided(padded, (lane + before, lanes), (1, lane)).astype(np.int64)
        states, begin, got = np.zeros(lanes, np.int64), np.arange(lanes) * lane - before, []
        for k, column in enumerate(columns):
            states = self.step(states, column)
            if k >= before:  # earlier bytes are the lane's before
                ends = self.last.take(states)
                told = np.flatnonzero(ends)
                s, end = ends[told], begin[told] + k + 1
                while len(s):
                    got.append(np.stack([self.name[s].astype(np.int64), end]))
                    s = self.shorter[s]
                    s, end = s[s > 0], end[s > 0]
        number, end = np.concatenate(got, axis=1) if got else np.zeros((2, 0), np.int64)
        return number, end - self.lengths[number], end


class Names:
    """Names of one table with the keys that bear each; knows which mentions are of others."""

    def __init__(self, rows: list[tuple[str, str]]):
        by: dict[bytes, list[tuple[str, str, str]]] = {}
        for key, name in rows:
            by.setdefault(folded(name.strip()).encode("utf-8", "surrogatepass"), []).append((key, name.strip().lower(), name.lower()))
        told = sorted(by)
        self.automaton = Automaton(told)
        self.bearers = [sorted({(key, name) for key, name, _ in by[t]}) for t in told]
        self.own = {(key, n): {raw for k, _, raw in by[t] if k == key} for n, t in enumerate(told) for key, *_ in by[t]}

    def others(self, number: int, key: str | None) -> list[str]:
        """Keys that bear the name, but the text's own key and those whose name is the own one."""
        mine = self.own.get((key, number), set())
        return [k for k, name in self.bearers[number] if k != key and name not in mine]

    def mentions(self, keys: list[str | None], texts: list[str]) -> list[list[tuple[str, int, int, str]]]:
        """(text, start, end, other key) of each text, by other key, then start."""
        out: list[list] = [[] for _ in texts]
        low = 0
        while low < len(texts):
            high, size = low, 0
            while high < len(texts) and (high == low or size + len(texts[high]) < BLOCK):
                size += len(texts[high])
                high += 1
            for i, number, start, end in self._block(texts[low:high]):
                i += low
                out[i] += [(texts[i][start:end], start, end, other) for other in self.others(number, keys[i])]
            low = high
        return [sorted(x, key=lambda m: (m[3], m[1], m[2])) for x in out]

    def _block(self, texts: list[str]) -> Iterator[tuple[int, int, int, int]]:
        whole = BETWEEN.join(texts)
        codes = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        body = np.frombuffer(folded(whole).encode("utf-8", "surrogatepass"), np.uint8)
        number, start, end = self.automaton.found(body)
        if not len(number):
            return
        place = np.concatenate([[0], np.cumsum((body & 0xC0) != 0x80)])  # characters that begin before a byte
        start, end = place[start], place[end]
        word = np.concatenate([[False], is_word(codes), [False]])  # one before the first
        sound = (word[start] != word[start + 1]) & (word[end] != word[end + 1])
        number, start, end = number[sound], start[sound], end[sound]
        begins = np.cumsum([0] + [len(t) + 1 for t in texts])[:-1]
        of = np.searchsorted(begins, start, "right") - 1
        inside = end <= begins[of] + np.array([len(t) for t in texts])[of]
        order = np.lexsort((start, number, of))
        last = None
        for k in order[inside[order]].tolist():
            mine = (int(of[k]), int(number[k]))
            if last is None or last[:2] != mine or start[k] >= last[2]:
                last = (*mine, int(end[k]))
                yield (*mine, int(start[k] - begins[of[k]]), int(end[k] - begins[of[k]]))


def _folded_names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(k, n, folded(n.strip())) for k, n in zip(*(c.to_pylist() for c in batch.columns)) if len(n.strip()) >= LEAST]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(3)], names=["k", "n", "fold"])


def name_tables(names: DataFrame, key: str, name: str, table_bytes: int = TABLE_BYTES) -> Iterator[Names]:
    """The names of at least LEAST characters in tables of about ``table_bytes`` bytes, one after the other.

    Names that differ in case or outer blanks only lie in one table, which comes to the driver when its turn comes.
    """
    given = names.where(F.col(key).isNotNull() & F.col(name).isNotNull()).select(F.col(key).cast("string").alias("k"), F.col(name).alias("n"))
    rows = staged(given.mapInArrow(_folded_names, "k string, n string, fold string").distinct(), "names")
    size = rows.agg(F.coalesce(F.sum(F.octet_length("n")), F.lit(0))).first()[0]
    tables = -(-size // table_bytes)
    for t in range(tables):
        yield Names([(r["k"], r["n"]) for r in rows.where(F.pmod(F.xxhash64("fold"), F.lit(tables)) == t).collect()])


def with_mentions(
    rows: DataFrame, names: DataFrame, key: str = "drug_id", text: str = "text", name_key: str = "drug_id", name: str = "name", out: str = "others", table_bytes: int = TABLE_BYTES
) -> DataFrame:
    """``rows`` with ``out``: (category, text, start, end, other) of every mention of another key's name.

    Offsets are code points, ``end`` exclusive; mentions are sorted by the other key, then start.  A name that several
    others bear is a mention of each.  The row's own names, names equal to one but for case, and names under
    LEAST characters are left out.  Null texts and texts without a mention have an empty array; a null key has no
    own name.  Rows that repeat are searched each.  Null keys or names in ``names`` count as absent.
    """
    spark, kept = rows.sparkSession, [c for c in rows.columns if c != out]
    found = rows.select(*kept, F.expr(f"cast(array() as {MENTION})").alias(out))
    for table in name_tables(names, name_key, name, table_bytes):
        found = _searched(found, spark.sparkContext.broadcast(cloudpickle.dumps(table)), key, text, out)
    return found.withColumn(out, F.array_sort(out, _order))


def _order(x: Column, y: Column) -> Column:
    return F.coalesce(*(F.when(x[c] < y[c], -1).when(x[c] > y[c], 1) for c in ("other", "start", "end")), F.lit(0))


def _searched(rows: DataFrame, told: Broadcast, key: str, text: str, out: str) -> DataFrame:
    schema = rows.schema
    at, spot, last = schema.names.index(key), schema.names.index(text), schema.names.index(out)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: Names = pickle.loads(told.value)
        for batch in batches:
            keys = [None if k is None else str(k) for k in batch.column(at).to_pylist()]
            texts = [t or "" for t in batch.column(spot).to_pylist()]
            had = batch.column(last)
            hits = table.mentions(keys, texts)
            said = [h + [{"category": "other_drug", "text": t, "start": s, "end": e, "other": o} for t, s, e, o in new] for h, new in zip(had.to_pylist(), hits)]
            columns = [pa.array(said, had.type) if k == last else c for k, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return rows.mapInArrow(search, schema)
