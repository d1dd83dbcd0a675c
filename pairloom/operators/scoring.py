"""Pluggable pair scorers: a registry, vectorised scoring and score policies."""

from __future__ import annotations

import importlib
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import read_json, write_json

MODALITIES = ("mol", "kg", "text", "mol+kg", "mol+kg-fused")
#: what may be masked for each modality
MASKS = {"mol": (), "text": (), "mol+kg-fused": (), "kg": ("kg",), "mol+kg": ("mol", "kg")}


class PairScorer(Protocol):
    modality: str

    def score(self, pairs: pd.DataFrame, mask: str | None = None) -> pd.Series: ...


class KnowledgeSource(Protocol):
    def long_view(self) -> DataFrame: ...


class NegativeSampler(Protocol):
    def sample(self, n: int, seed: int) -> DataFrame: ...


_scorers: dict[str, type] = {}
#: name -> module that registers it when it is first wanted
_modules: dict[str, str] = {}


def _key(name: str) -> str:
    return name.replace("-", "_")


def register(name: str) -> Callable[[type], type]:
    def add(cls: type) -> type:
        if getattr(cls, "modality", None) not in MODALITIES:
            raise ValueError(f"{name}: unknown modality {getattr(cls, 'modality', None)!r}")
        if _scorers.get(_key(name), cls) is not cls:
            raise ValueError(f"{name} is taken by {_scorers[_key(name)].__name__}")
        _scorers[_key(name)] = cls
        return cls

    return add


def register_module(name: str, module: str) -> None:
    """A scorer whose module, with what it depends on, is imported only when it is wanted."""
    _modules[_key(name)] = module


def scorer_class(name: str) -> type:
    if _key(name) not in _scorers and _key(name) in _modules:
        try:
            importlib.import_module(_modules[_key(name)])
        except ImportError as e:
            raise ImportError(f"scorer {name!r} needs {_modules[_key(name)]!r}: {e}") from e
    if _key(name) not in _scorers:
        raise KeyError(f"no scorer {name!r}; known: {sorted({*_scorers, *_modules})}")
    return _scorers[_key(name)]


def scorer(name: str, **kw) -> PairScorer:
    return scorer_class(name)(**kw)


def save_scorer(spark: SparkSession, name: str, settings: dict, folder: str, version: str = "1") -> None:
    """A manifest of name, version and settings; a scorer with more to keep writes it beside."""
    write_json({"scorer": _key(name), "version": version, "settings": settings}, f"{folder}/manifest.json", spark)


def load_scorer(spark: SparkSession, folder: str) -> PairScorer:
    """The scorer that the manifest names, made from its settings, or by its own ``load`` if it has one."""
    told = read_json(spark, f"{folder}/manifest.json")
    if told is None:
        raise FileNotFoundError(f"{folder}: no manifest.json")
    if not told.get("scorer"):
        raise ValueError(f"{folder}: the manifest names no scorer")
    cls = scorer_class(told["scorer"])
    return cls.load(folder) if hasattr(cls, "load") else cls(**told.get("settings", {}))


def mask_channels(modality: str) -> tuple[str, ...]:
    return MASKS[modality]


def mask_conditions(modality: Column) -> Column:
    """``none``, then the channels that a modality can mask, in order; an unknown modality has ``none`` alone."""
    out = F.array(F.lit("none"))
    for m, channels in MASKS.items():
        out = F.when(modality == m, F.array(F.lit("none"), *map(F.lit, channels))).otherwise(out)
    return out


def scored(pairs: DataFrame, model: PairScorer, mask: str | None = None, unknown: float | None = 0.5, a: str = "a", b: str = "b") -> DataFrame:
    """Pairs with ``p``, scored in Arrow batches; a length that differs from the batch is an error.

    A scorer returns null for pairs it does not know; they become ``unknown``, or an error if that
    is None."""
    schema = pairs.select(a, b).schema.add("p", "double")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            p = pd.Series(model.score(part, mask), dtype="float64")
            if len(p) != len(part):
                raise ValueError(f"scorer gave {len(p)} scores for {len(part)} pairs")
            yield part.assign(p=p.to_numpy())

    out = pairs.select(a, b).mapInPandas(run, schema)
    if unknown is None:
        bad = F.col("p").isNull() | F.isnan("p")
        return out.withColumn("p", F.when(bad, F.raise_error(F.lit("a pair has no score")).cast("double")).otherwise(F.col("p")))
    return out.withColumn("p", F.coalesce(F.nanvl("p", F.lit(None).cast("double")), F.lit(unknown)))


def predictions(rows: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Predicted label by threshold; rows without a score have label -1 kept as true label."""
    return rows.withColumn("predicted_label", (F.col("predicted_prob") >= threshold).cast("int"))


@register("hash_baseline")
class HashScorer:
    """Reproducible scores without a model, for tests and dry runs."""

    modality = "mol"

    def score(self, pairs: pd.DataFrame, mask: str | None = None) -> pd.Series:
        import hashlib

        cols = list(pairs.columns[:2])
        return pd.Series([int(hashlib.md5(f"{mask}:{x}:{y}".encode()).hexdigest()[:8], 16) / 2**32 for x, y in zip(pairs[cols[0]], pairs[cols[1]], strict=True)])
