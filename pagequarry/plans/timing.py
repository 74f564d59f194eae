"""Seconds of a run's stages as rows of `schemas.RUNTIMES`."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from pagequarry import schemas

#: Fixed values, names of stages: layout, lines, words, recognition, each with its post-processing, and pages.
STAGES = ("dla", "dla_p", "line", "line_p", "word", "word_p", "rec", "rec_p", "html")


class StageTimer:
    """Times what is run (not merely planned) inside `stage`; a run is keyed like an image."""

    def __init__(self, run: str):
        self.run, self.rows = run, []

    @contextmanager
    def stage(self, name: str) -> Iterator[None]:
        began = time.perf_counter()
        try:
            yield
        finally:
            self.rows.append((self.run, name, time.perf_counter() - began))

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, schemas.RUNTIMES)
