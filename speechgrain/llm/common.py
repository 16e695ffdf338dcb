"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from speechgrain.sources.files import shared_folder

#: The six ASCII white-space characters of ``[\x20\x09-\x0D]``.
WHITE_SPACE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only, other letters stay."""
    return F.translate(c, UPPER, UPPER.lower())


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``df`` has it, in capitals or not."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder, its lineage cut."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


_HELD = threading.local()


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Remove the tables that ``written`` makes inside, at the end: what is made from them has to be stored by then."""
    before, _HELD.paths = getattr(_HELD, "paths", None), []
    try:
        yield
    finally:
        for path in _HELD.paths:
            remove_folder(spark, path)
        _HELD.paths = before


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: its size is known, so Spark may broadcast it if it is small."""
    at = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    if getattr(_HELD, "paths", None) is not None:
        _HELD.paths.append(at)
    df.write.parquet(at)
    return df.sparkSession.read.parquet(at)


def whole_groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Batches of rows sorted by ``keys`` as frames that each hold whole groups."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if batch.empty:
            continue
        found = batch[keys].to_numpy()
        starts = np.flatnonzero((found[1:] != found[:-1]).any(axis=1)) + 1
        if held and (held[-1][keys].iloc[-1].to_numpy() != found[0]).any():
            starts = np.concatenate(([0], starts))
        if len(starts):  # what lies before the last start is whole groups
            ready = pd.concat([*held, batch.iloc[: starts[-1]]])
            held, batch = [], batch.iloc[starts[-1] :]
            if len(ready):
                yield ready
        held.append(batch)
    if held:
        yield pd.concat(held)


def group_starts(rows: pd.DataFrame, keys: list[str]) -> list[tuple[int, int]]:
    """(begin, end) of each group in ``rows`` sorted by ``keys``."""
    found = rows[keys].to_numpy()
    cuts = [0, *(np.flatnonzero((found[1:] != found[:-1]).any(axis=1)) + 1).tolist(), len(rows)]
    return list(zip(cuts[:-1], cuts[1:], strict=True))
