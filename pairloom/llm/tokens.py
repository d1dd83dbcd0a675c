"""Token counts: rank-synchronous array merging.

Batches of pre-tokens are held as ragged numpy arrays (flat symbol ids plus row starts).  In each
round every row finds its own lowest-rank adjacent pair and all rows merge theirs at the same
time; rows without a mergeable pair leave.  The count is the number of surviving symbols.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The published split pattern of the byte-level vocabularies (fixed value).
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pre-token counts that a worker remembers before it starts afresh.
REMEMBERED = 400_000
NO_RANK = np.int64(1) << 40


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, spare = [""] * 256, 256
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b], spare = chr(spare), spare + 1
    return out


def supported(spec: dict) -> None:
    """Raise where the file asks for anything that would be counted wrong here."""
    model, split = spec["model"], spec.get("pre_tokenizer") or {}
    wants = {
        "model.type": model.get("type", "BPE") == "BPE", "model.dropout": not model.get("dropout"), "model.continuing_subword_prefix": not model.get("continuing_subword_prefix"),
        "model.end_of_word_suffix": not model.get("end_of_word_suffix"), "model.byte_fallback": not model.get("byte_fallback"), "model.ignore_merges": not model.get("ignore_merges"),
        "normalizer": spec.get("normalizer") is None, "pre_tokenizer": split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True),
        "added_tokens": not any(t.get("single_word") or t.get("lstrip") or t.get("rstrip") for t in spec.get("added_tokens", [])),
    }
    if wrong := [k for k, ok in wants.items() if not ok]:
        raise ValueError(f"unsupported settings of the vocabulary: {', '.join(wrong)}")


class MergeTable:
    """Merge ranks as sorted arrays.  Size is that of the vocabulary, whatever the corpus."""

    def __init__(self, spec: dict):
        supported(spec)
        vocab = spec["model"]["vocab"]
        self.base = np.array([vocab[c] for c in byte_symbols()], dtype=np.int64)
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.size = np.int64(max(vocab.values()) + 1)
        keys = np.array([vocab[a] * int(self.size) + vocab[b] for a, b in merges], dtype=np.int64)
        made = np.array([vocab[a + b] for a, b in merges], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.made = keys[order], order.astype(np.int64), made[order]
        self.special = [t["content"] for t in spec.get("added_tokens", [])]

    @classmethod
    def load(cls, path: str) -> MergeTable:
        with open(path, encoding="utf-8") as f:
            return cls(json.load(f))

    @classmethod
    def of(cls, state: dict) -> MergeTable:
        """From ``vars()`` of another one: plain arrays travel to workers without this package."""
        table = cls.__new__(cls)
        vars(table).update(state)
        return table

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        return np.where(hit, self.rank[at], NO_RANK), self.made[at]


def count_symbols(table: MergeTable, words: list[bytes]) -> np.ndarray:
    """Symbols left of each byte string after all merges."""
    n = np.array([len(w) for w in words], dtype=np.int64)
    counts = n.copy()
    live = np.flatnonzero(n > 1)
    if not len(live):
        return counts
    sym = table.base[np.frombuffer(b"".join(words[i] for i in live), dtype=np.uint8)]
    row = np.repeat(np.arange(len(live)), n[live])
    while len(sym):
        same = row[1:] == row[:-1]
        rank, made = table.look_up(sym[:-1], sym[1:])
        rank[~same] = NO_RANK
        starts = np.flatnonzero(np.r_[True, ~same])
        # the last symbol of a row owns no pair, so its slot never lowers the minimum
        low = np.minimum.reduceat(np.r_[rank, NO_RANK], starts)
        per = np.repeat(low, np.diff(np.r_[starts, len(sym)]))
        pick = np.flatnonzero((rank == per[:-1]) & (rank < NO_RANK))
        # overlapping picks are runs of one symbol: every second one merges, from the left
        fresh = np.r_[True, np.diff(pick) > 1]
        since = np.arange(len(pick)) - np.maximum.accumulate(np.where(fresh, np.arange(len(pick)), 0))
        pick = pick[since % 2 == 0]
        sym[pick] = made[pick]
        keep = np.ones(len(sym), dtype=bool)
        keep[pick + 1] = False
        done = low >= NO_RANK
        if done.any():
            rows = row[starts]
            counts[live[rows[done]]] = np.diff(np.r_[starts, len(sym)])[done]
            keep &= per < NO_RANK
        sym, row = sym[keep], row[keep]
    return counts


class Counter:
    """Counts tokens of texts; remembers pre-tokens up to a fixed number."""

    def __init__(self, table: MergeTable):
        self.table, self.seen = table, {}
        self.split = regex.compile(SPLIT)
        self.cut = regex.compile("|".join(map(regex.escape, table.special))) if table.special else None

    def parts(self, text: str) -> tuple[list[str], int]:
        """Pre-tokens, and how many special strings stood among them (one token each)."""
        if not self.cut or not any(s in text for s in self.table.special):
            return self.split.findall(text), 0
        pieces = self.cut.split(text)
        return [p for x in pieces for p in self.split.findall(x)], len(pieces) - 1

    def count(self, texts: list[str | None]) -> list[int]:
        split = [self.parts(t) if t else ([], 0) for t in texts]
        seen = self.seen
        new = list({p for parts, _ in split for p in parts} - seen.keys())
        if len(seen) + len(new) > REMEMBERED:
            seen.clear()
            new = list({p for parts, _ in split for p in parts})
        for i in range(0, len(new), 50_000):
            block = new[i : i + 50_000]
            seen.update(zip(block, count_symbols(self.table, [p.encode() for p in block]).tolist(), strict=True))
        get = seen.__getitem__
        return [sum(map(get, parts)) + extra for parts, extra in split]


def token_counts(docs: DataFrame, vocab_path: str, text: str = "text", limit: int = 1024) -> DataFrame:
    """All columns of ``docs`` but the text, plus n_bytes, n_tokens and over_limit.

    One narrow pass, no shuffle.  Null or empty text counts 0; repeated rows count each; columns
    of ``docs`` with the names of results are replaced by them.  The vocabulary (a fixed file) is
    read by the driver and broadcast.
    """
    told = docs.sparkSession.sparkContext.broadcast(vars(MergeTable.load(vocab_path)))
    fixed = ["n_bytes", "n_tokens", "over_limit"]
    others = [c for c in docs.columns if c not in [text, *fixed]]
    fields = docs.select(*others).schema if others else None
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in (fields or [])), "n_bytes long", "n_tokens long", "over_limit boolean"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(MergeTable.of(told.value))
        for whole in batches:
            for i in range(0, whole.num_rows, 1000):
                batch = whole.slice(i, 1000)
                texts = batch.column(batch.num_columns - 1).to_pylist()
                n = counter.count(texts)
                size = [len(t.encode()) if t else 0 for t in texts]
                cols = [batch.column(k) for k in range(batch.num_columns - 1)]
                yield pa.RecordBatch.from_arrays(
                    [*cols, pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                    names=[*others, *fixed],
                )

    return docs.select(*others, F.col(text).alias("__text")).mapInArrow(run, schema)
