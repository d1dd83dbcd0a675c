"""Quality classifier: a byte-level convolutional network in numpy.

Each byte is embedded, learned filters of WIDTH bytes run over every STRIDE-th position of the
whole text, and each chunk of CHUNK positions keeps the maximum of every filter.  Chunks overlap by
half.  A hidden layer on the chunk's maxima gives a logit, and the logits of all chunks are
averaged into one probability, calibrated by a final scale and offset.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTH, STRIDE, EMBED, FILTERS, HIDDEN = 8, 4, 6, 32, 24
#: Positions of a chunk (times STRIDE bytes); the next chunk starts after half of them.
CHUNK = 96
#: Bytes convolved at once: bounds a worker's memory whatever the length of a text.
BLOCK = 1 << 16
#: Bound of the labelled rows that are fitted, of each label; all chunks of their texts are.
SAMPLE = 1500
CHUNK_BYTES = CHUNK * STRIDE


def folded(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode(), dtype=np.uint8)


class Network:
    """Weights by name; forward and backward passes over chunks of equal size."""

    def __init__(self, seed: int = 7):
        g = np.random.default_rng(seed)
        n = lambda *s, by: (g.standard_normal(s) / np.sqrt(by)).astype(np.float32)
        self.w = {
            "embed": n(256, EMBED, by=EMBED), "conv": n(WIDTH * EMBED, FILTERS, by=WIDTH), "bias": np.zeros(FILTERS, np.float32),
            "hide": n(FILTERS, HIDDEN, by=FILTERS), "hide_b": np.zeros(HIDDEN, np.float32), "out": n(HIDDEN, by=HIDDEN), "out_b": np.zeros(1, np.float32),
        }
        self.scale, self.offset = 1.0, 0.0

    def responses(self, data: np.ndarray) -> np.ndarray:
        """Filter responses at every STRIDE-th position of ``data`` (its length reaches WIDTH)."""
        emb = self.w["embed"][data]
        npos = (len(data) - WIDTH) // STRIDE + 1
        view = np.lib.stride_tricks.as_strided(emb, (npos, WIDTH * EMBED), (STRIDE * EMBED * 4, 4))
        return view @ self.w["conv"]

    def chunk_maxima(self, data: np.ndarray) -> np.ndarray:
        """Maximum of every filter in each chunk; half chunks are pooled once and paired.

        A text is padded with zero bytes to whole half chunks, one chunk at least, so that every
        byte is seen.  Blocks bound the memory.
        """
        half = CHUNK // 2
        halves = max(2, -(-(max(len(data) - WIDTH, 0) // STRIDE + 1) // half))
        if (len(data) - WIDTH) % STRIDE and len(data) > WIDTH and halves * half == (len(data) - WIDTH) // STRIDE + 1:
            halves += 1
        short = (halves * half - 1) * STRIDE + WIDTH - len(data)
        if short > 0:
            data = np.r_[data, np.zeros(short, np.uint8)]
        npos, halves = halves * half, []
        step = BLOCK // (STRIDE * half) * half
        for at in range(0, npos, step):
            n = min(step, npos - at)
            r = self.responses(data[at * STRIDE : (at + n - 1) * STRIDE + WIDTH])
            halves.append(np.maximum.reduceat(r, np.arange(0, n, half), axis=0))
        halves = np.concatenate(halves) if len(halves) > 1 else halves[0]
        return np.maximum(halves[:-1], halves[1:])

    def logits(self, maxima: np.ndarray) -> np.ndarray:
        a = np.maximum(maxima + self.w["bias"], 0)
        h = np.maximum(a @ self.w["hide"] + self.w["hide_b"], 0)
        return h @ self.w["out"] + self.w["out_b"][0]

    def raw(self, text: str | None) -> float:
        return float(self.logits(self.chunk_maxima(folded(text))).mean())

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.scale * self.raw(text) + self.offset, -30, 30))))

    def step(self, data: np.ndarray, target: np.ndarray, weight: np.ndarray, adam: dict, rate: float) -> float:
        """One gradient step (Adam) on chunks (n, CHUNK_BYTES + WIDTH - STRIDE)."""
        w, n = self.w, len(data)
        emb = w["embed"][data]
        view = np.lib.stride_tricks.as_strided(emb, (n, CHUNK, WIDTH * EMBED), (emb.strides[0], STRIDE * EMBED * 4, 4)).reshape(n * CHUNK, -1)
        r = (view @ w["conv"]).reshape(n, CHUNK, FILTERS)
        top = r.argmax(1)
        m = np.take_along_axis(r, top[:, None, :], 1)[:, 0] + w["bias"]
        a = np.maximum(m, 0)
        z = a @ w["hide"] + w["hide_b"]
        h = np.maximum(z, 0)
        p = 1 / (1 + np.exp(-(h @ w["out"] + w["out_b"][0])))
        d = ((p - target) * weight / n).astype(np.float32)
        g = {"out": h.T @ d, "out_b": np.array([d.sum()], np.float32)}
        dz = (d[:, None] * w["out"]) * (z > 0)
        g["hide"], g["hide_b"] = a.T @ dz, dz.sum(0)
        dm = (dz @ w["hide"].T) * (m > 0)
        g["bias"] = dm.sum(0)
        # only the winning position of each filter passes its gradient on
        rows = (np.arange(n)[:, None] * CHUNK + top).ravel()
        seen = view[rows].reshape(n, FILTERS, -1)
        g["conv"] = np.einsum("nfk,nf->kf", seen, dm, optimize=True).astype(np.float32)
        de = (dm[:, :, None] * w["conv"].T[None]).reshape(n, FILTERS, WIDTH, EMBED)
        which = data[np.arange(n)[:, None, None], (top * STRIDE)[:, :, None] + np.arange(WIDTH)]
        flat = which.ravel()
        g["embed"] = np.stack([np.bincount(flat, de[..., k].ravel(), 256) for k in range(EMBED)], 1).astype(np.float32)
        adam["t"] += 1
        for k, v in g.items():
            m1 = adam["m"][k] = 0.9 * adam["m"].get(k, 0) + 0.1 * v
            m2 = adam["v"][k] = 0.99 * adam["v"].get(k, 0) + 0.01 * v * v
            w[k] -= (rate * (m1 / (1 - 0.9 ** adam["t"])) / (np.sqrt(m2 / (1 - 0.99 ** adam["t"])) + 1e-8)).astype(np.float32)
        return float(-(target * np.log(p + 1e-9) + (1 - target) * np.log(1 - p + 1e-9)).mean())


def train(texts: list[str], labels: list[int], base: float = 0.5, epochs: int = 6, batch: int = 64, rate: float = 0.004, seed: int = 7) -> Network:
    """Fit on the given texts: all chunks of each, which together weigh as much as those of any other,
    and one shorter piece, as short texts have fewer patterns.  Every fifth text only calibrates.
    ``base`` is the share of label 1 among all labels, to which the probability is moved."""
    net = Network(seed)
    g = np.random.default_rng(seed)
    size = CHUNK_BYTES + WIDTH - STRIDE
    chunks, target, weight = [], [], []
    share = max(1, sum(labels)) / max(1, len(labels))
    for k, (text, y) in enumerate(zip(texts, labels, strict=True)):
        data = folded(text)
        crop = int(np.exp(g.uniform(np.log(12), np.log(size))))
        at = int(g.integers(0, max(1, len(data) - crop)))
        if k % 5 == 4:
            continue
        starts = [*range(0, max(1, len(data) - size), CHUNK_BYTES), max(0, len(data) - size)] if len(data) > size else [0]
        for s, x in [*((s, data[s : s + size]) for s in starts), (at, data[at : at + crop])]:
            chunks.append(np.r_[x, np.zeros(size - len(x), np.uint8)])
            target.append(y)
            weight.append((0.5 / share if y else 0.5 / max(1 - share, 1e-9)) / (len(starts) + 1))
    if not chunks or len(set(target)) < 2:
        net.scale = 0.0  # nothing to learn: every text scores 0.5
        return net
    data, y, wt = np.stack(chunks), np.array(target, np.float32), np.array(weight, np.float32)
    wt *= len(wt) / wt.sum()
    adam: dict = {"t": 0, "m": {}, "v": {}}
    for e in range(epochs):
        order = g.permutation(len(data))
        for i in range(0, len(order), batch):
            at = order[i : i + batch]
            net.step(data[at], y[at], wt[at], adam, rate * (1 if e < epochs - 2 else 0.25))
    # one scale and offset over whole texts, drawn to 1 and 0; the sample is balanced, ``base`` is not
    raw, yy = np.array([net.raw(t) for t in texts[4::5]]), np.array(labels[4::5], float)
    a, b, firm = 1.0, 0.0, 0.02 * len(yy)
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(a * raw + b, -30, 30)))
        s = np.maximum(p * (1 - p), 1e-6)
        h = np.array([[np.sum(s * raw * raw) + firm, np.sum(s * raw)], [np.sum(s * raw), np.sum(s) + firm]])
        step = np.linalg.solve(h, [np.sum((p - yy) * raw) + firm * (a - 1.0), np.sum(p - yy) + firm * b])
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    base = min(max(base, 0.01), 0.99)
    net.scale, net.offset = float(a), float(b + np.log(base / (1 - base)) - np.log(share / (1 - share)))
    return net


def held_out(key) -> F.Column:
    """Rows never learnt from: crc32 of the key as text, modulo 4, is 2 (null keys: not held out)."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", most: int = SAMPLE) -> tuple[list[str], list[int], float]:
    """At most ``most`` texts of each label, in the order of a hash of the key, without held-out rows,
    and the share of label 1 among all labels that may be learnt from.

    The sample is the only thing that comes to the driver; its bound does not depend on the data.
    Ids are chosen on the labels alone; texts are then fetched by those ids (of several texts of one
    id the smallest).
    """
    y = labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1) & ~held_out(key)).groupBy(key).agg(F.min(label).alias("__y"))
    order = F.xxhash64(F.lit("fit"), key)
    ids = y.where("__y = 0").orderBy(order, key).limit(most).union(y.where("__y = 1").orderBy(order, key).limit(most)).collect()
    told = {r[0]: int(r[1]) for r in ids}
    if not told:
        return [], [], 0.5
    base = y.agg(F.avg("__y")).first()[0]
    rows = docs.where(F.col(key).isin(list(told))).select(F.col(key), F.col(text).alias("__t")).groupBy(key).agg(F.min("__t").alias("__t")).collect()
    rows.sort(key=lambda r: r[0])
    return [r[1] or "" for r in rows], [told[r[0]] for r in rows], float(base)


def fit_quality(docs: DataFrame, labels: DataFrame, **kw) -> Network:
    return train(*labelled_sample(docs, labels, **kw))


def score_documents(docs: DataFrame, net: Network, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with a score in (0, 1) for every row, over the whole text.  Narrow; null text scores
    as empty; repeated rows score alike; a column named ``out`` is replaced."""
    told = docs.sparkSession.sparkContext.broadcast((net.w, net.scale, net.offset))
    others = [c for c in docs.columns if c != out]
    at = others.index(text)
    schema = docs.select(*others).schema.add(out, "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Network()
        model.w, model.scale, model.offset = told.value
        for batch in batches:
            scores = pa.array([model.score(t.as_py()) for t in batch.column(at)], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, scores], names=[*others, out])

    return docs.select(*others).mapInArrow(run, schema)
