"""Registry of embedding providers: functions from clips to vectors, run by Spark in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from speechgrain.operators import pcm

#: name -> factory of a function from a batch of sample lists to vectors; the factory runs once a partition and loads models.
PROVIDERS: dict[str, Callable[[], Callable[[list[np.ndarray]], list[list[float]]]]] = {}


def register(name: str, factory) -> None:
    PROVIDERS[name] = factory


def embed(clips: DataFrame, provider: str, column: str = "samples") -> DataFrame:
    """``clips`` with ``embedding``. ``bands`` is built in and stays in the JVM; other names come from ``register``."""
    if provider == "bands":
        return clips.withColumn("embedding", pcm.band_features(F.col(column)))
    if provider not in PROVIDERS:
        raise ValueError(f"unknown provider {provider!r}; known: {', '.join(sorted([*PROVIDERS, 'bands']))}")
    factory = PROVIDERS[provider]

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = factory()
        for part in batches:
            yield pd.Series(model([np.asarray(x) for x in part]))

    return clips.withColumn("embedding", run(column))


def gated(clips: DataFrame, min_ms: int = 8000) -> DataFrame:
    """Clips with ``speech_ms`` and an embedding; too little speech gives status ``too_short`` and no vector."""
    short = F.col("speech_ms") < min_ms
    return clips.withColumn("status", F.when(short, "too_short").otherwise("ok")).withColumn("embedding", F.when(~short, F.col("embedding")))
