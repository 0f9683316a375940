"""Counters of running streams: observed in every micro-batch while it is written, gathered by a listener."""

import threading
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

PLAYS = "plays"


def counted(df: DataFrame, name: str, **counts: Column) -> DataFrame:
    """Observe aggregates under ``name`` while the rows pass; no further job, no shuffle. Nulls count as 0."""
    return df.observe(name, *[c.alias(k) for k, c in counts.items()])


def count_plays(df: DataFrame) -> DataFrame:
    """Plays, runs, passes and plays with a down, which are those that can be sent on."""
    return counted(df, PLAYS, plays=F.count("*"), runs=F.count_if(F.col("play_type") == "run"),
                   passes=F.count_if(F.col("play_type") == "pass"), sent=F.count_if(F.col("down") > 0))


class Counters(StreamingQueryListener):
    """Sums what queries observe under ``name``.

    Of each query it holds the sums of the earlier batches and the counts of the newest one. A batch that is repeated after
    a restart has the number it had before, so its counts replace the first ones."""

    def __init__(self, name: str):
        self.name = name
        self._earlier: dict[str, dict[str, int]] = {}
        self._newest: dict[str, tuple[int, dict[str, int]]] = {}
        self._batches: dict[str, int] = {}
        self._ended: set[str] = set()
        self._news = threading.Condition()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self.add(str(event.progress.id), event.progress.batchId, event.progress.observedMetrics.get(self.name))

    def onQueryTerminated(self, event) -> None:
        with self._news:
            self._ended.add(str(event.runId))
            self._news.notify_all()

    def add(self, query: str, batch: int, row) -> None:
        """Take the counts of a batch; ``row`` is None where the batch observed nothing."""
        if row is None:
            return
        counts = {k: v or 0 for k, v in row.asDict().items()}
        with self._news:
            before = self._newest.get(query)
            if before is None or before[0] != batch:
                self._batches[query] = self._batches.get(query, 0) + 1
                if before is not None:
                    self._earlier[query] = self._sum(self._earlier.get(query, {}), before[1])
            self._newest[query] = (batch, counts)

    @staticmethod
    def _sum(a: dict[str, int], b: dict[str, int]) -> dict[str, int]:
        return {k: a.get(k, 0) + b.get(k, 0) for k in {**a, **b}}

    def totals(self, query: str) -> dict[str, int]:
        """The sums over all batches of a query, by its id; empty before the first batch."""
        with self._news:
            return self._sum(self._earlier.get(query, {}), self._newest.get(query, (0, {}))[1])

    def batches(self, query: str) -> int:
        """How many different batches of the query were counted."""
        with self._news:
            return self._batches.get(query, 0)

    def wait(self, query: StreamingQuery, seconds: float = 60) -> dict[str, int]:
        """The sums of a query that has ended. Events come some time after the batch, the end of the run last."""
        with self._news:
            if not self._news.wait_for(lambda: str(query.runId) in self._ended, seconds):
                raise TimeoutError(f"no end of query {query.id} was seen")
        return self.totals(str(query.id))


@contextmanager
def listening(spark: SparkSession, name: str) -> Iterator[Counters]:
    """Counters that listen to the session's queries until the block ends."""
    counters = Counters(name)
    spark.streams.addListener(counters)
    try:
        yield counters
    finally:
        spark.streams.removeListener(counters)
