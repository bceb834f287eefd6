"""Progress and cancellation of a scan."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

PHASES = ("rules", "neighbours", "clusters", "scores")


@contextmanager
def cancellable(spark: SparkSession, tag: str) -> Iterator[None]:
    """Jobs started inside carry the tag; cancel() from another thread stops them, and nothing is stored."""
    spark.sparkContext.addJobTag(tag)
    try:
        yield
    finally:
        spark.sparkContext.removeJobTag(tag)


def cancel(spark: SparkSession, tag: str) -> None:
    spark.sparkContext.cancelJobsWithTag(tag)


class Progress:
    """Tells a listener (phase, its number, phases, steps done in it, its steps) how far a scan is."""

    def __init__(self, listener: Callable[[str, int, int, int, int], None] | None = None) -> None:
        self.listener, self.phase, self.total = listener, PHASES[0], 1

    def begin(self, phase: str, steps: int = 1) -> None:
        self.phase, self.total = phase, steps
        self.done(0)

    def done(self, steps: int) -> None:
        if self.listener:
            self.listener(self.phase, PHASES.index(self.phase) + 1, len(PHASES), steps, self.total)
