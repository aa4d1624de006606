"""Long runs over photos in batches: what a paused or cut-off run has left, retries, and totals that are kept."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Photos of a batch, further tries of a batch that fails, times that a cut-off run is taken up, totals kept.
BATCH, RETRIES, RESUMES, TOTALS = 32, 2, 3, 256


def left_over(asked: DataFrame, results: DataFrame, keys: list[str]) -> DataFrame:
    """The asked rows that have no result yet: what a run goes on with, whatever stopped it."""
    return asked.join(results.select(*keys).distinct(), keys, "left_anti")


def resumable(runs: DataFrame) -> DataFrame:
    """runs with `action`: paused ones wait for their user, those that ended with the process are taken up again RESUMES
    times at most, others are left alone. runs: status, resumes, n_left."""
    again = (F.col("status") == "interrupted") & (F.col("n_left") > 0)
    action: Column = F.when(again & (F.coalesce("resumes", F.lit(0)) < RESUMES), "resume").when(again, "give up").when((F.col("status") == "paused") & (F.col("n_left") > 0), "wait").otherwise("none")
    return runs.withColumn("action", action)


def run_batches(todo: DataFrame, key: str, work: Callable[[list[dict]], list[float]], size: int = BATCH, retries: int = RETRIES) -> DataFrame:
    """key, value, error of every row: `work` gets `size` rows at once and returns a number for each.

    A batch that raises is tried `retries` more times, then its rows are tried one by one, so one bad row costs no other its
    result; a row that fails alone has a null value and the error's text. Batches are cut within partitions, which needs
    no shuffle and no numbering of the rows.
    """

    def attempt(rows: list[dict], tries: int) -> tuple[list[float] | None, str | None]:
        error = None
        for _ in range(tries):
            try:
                return list(work(rows)), None
            except Exception as e:  # noqa: BLE001 - any failure of the work is a result of the run
                error = f"{type(e).__name__}: {e}"
        return None, error

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, size):
                rows = b.slice(at, size).to_pylist()
                values, _ = attempt(rows, 1 + retries)
                told = [(v, None) for v in values] if values is not None else [((got or [None])[0], error) for got, error in (attempt([r], 1) for r in rows)]
                yield pa.RecordBatch.from_arrays([pa.array([r[key] for r in rows], pa.int64()), pa.array([v for v, _ in told], pa.float64()), pa.array([e for _, e in told], pa.string())], [key, "value", "error"])

    return todo.withColumn(key, F.col(key).cast("long")).mapInArrow(run, f"`{key}` long, value double, error string")


class Totals:
    """Counts of queries by text and catalog generation. A new generation forgets those of the old one; of TOTALS kept
    counts, the one that was unused longest makes room for the next."""

    def __init__(self, most: int = TOTALS) -> None:
        self.most, self.generation = most, None
        self.held: OrderedDict[str, int] = OrderedDict()

    def count(self, generation: int, query: str, rows: Callable[[], DataFrame]) -> int:
        if generation != self.generation:
            self.generation = generation
            self.held.clear()
        if query not in self.held:
            self.held[query] = rows().count()
            if len(self.held) > self.most:
                self.held.popitem(last=False)
        self.held.move_to_end(query)
        return self.held[query]
