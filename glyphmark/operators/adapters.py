"""Contracts for engines, readers and verifiers that are Python code."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.resource import ExecutorResourceRequests, ResourceProfile, ResourceProfileBuilder, TaskResourceRequests
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREDICTION = "image_id long, slot int, text string, x0 double, y0 double, x1 double, y1 double, confidence double"


#: What this Python worker has built, by identity; Spark keeps a worker for many tasks.
_BUILT: dict[str, object] = {}


def built(identity: str, build: Callable[[], object]) -> object:
    """build() once for an identity in each Python worker, however many tasks it runs."""
    if identity not in _BUILT:
        _BUILT[identity] = build()
    return _BUILT[identity]


def sized(cores: int, memory: str, python_memory: str) -> ResourceProfile:
    """The executors that a stage with a large model asks for; it takes effect on clusters with dynamic allocation."""
    need = ExecutorResourceRequests().cores(cores).memory(memory).pysparkMemory(python_memory)
    return ResourceProfileBuilder().require(need).require(TaskResourceRequests().cpus(cores)).build


def run_engine(images: DataFrame, build: Callable[[], Callable[[dict], list[dict]]], identity: str, profile: ResourceProfile | None = None) -> DataFrame:
    """Runs an engine over images; build() makes it once in a Python worker, it gives each image's words.

    identity tells engines apart: name, version and configuration digest.  profile, of `sized`,
    asks for executors of their own for this stage."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        engine = built(identity, build)
        names = [c.split()[0] for c in PREDICTION.split(", ")]
        for batch in batches:
            rows = [{"image_id": r["image_id"], "slot": k, **w} for r in batch.to_dict("records") for k, w in enumerate(engine(r))]
            yield pd.DataFrame(rows, columns=names)

    return images.mapInPandas(run, PREDICTION, profile=profile)


def reread(predictions: DataFrame, threshold: float, verify: Callable[[Column], Column]) -> DataFrame:
    """Verifies only words surer than nothing and less sure than the threshold; box and confidence stay."""
    weak = F.col("confidence").isNotNull() & (F.col("confidence") < threshold)
    return predictions.withColumn("text", F.when(weak, verify(F.col("text"))).otherwise(F.col("text")))
