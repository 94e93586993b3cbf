"""D2 and A14 of running streams: counters that come with a query's progress."""

from __future__ import annotations

import threading

from pyspark.sql import Column, DataFrame
from pyspark.sql.streaming import StreamingQueryListener

from ..operators.metrics import COUNTERS, counter_columns


class StreamCounters(StreamingQueryListener):
    """Counters observed on the streams they are put on with ``on``, summed up as
    the queries report their micro-batches. Add it with ``spark.streams.addListener``.

    A micro-batch counts once: one that is run again after a failure reports the
    same number, and its counts take the place of the former ones. What is held
    is a total and the newest micro-batch a query and name, whatever the stream's
    length. Like the service's own counters they start at 0 with the process;
    what must survive it belongs into an epoch's output (``outputs.ingest_counts``)."""

    def __init__(self, name: str = "counters") -> None:
        self.name = name
        self._lock = threading.Lock()
        self._totals = dict.fromkeys(COUNTERS, 0)
        self._newest: dict[str, tuple[int, dict[str, int]]] = {}

    def on(self, stream: DataFrame, **counters: Column) -> DataFrame:
        """The stream, counted. Put it last, past every shuffle and state."""
        return stream.observe(self.name, *counter_columns(counters))

    def totals(self) -> dict[str, int]:
        with self._lock:
            return dict(self._totals)

    def batch(self, query: str, number: int, counts: dict[str, int]) -> None:
        """The counts of a query's micro-batch."""
        with self._lock:
            last, former = self._newest.get(query, (-1, {}))
            if number < last:
                return
            for n, v in counts.items():
                self._totals[n] += v - (former.get(n, 0) if number == last else 0)
            self._newest[query] = (number, counts)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        seen = event.progress.observedMetrics.get(self.name)
        if seen is not None:
            self.batch(str(event.progress.id), event.progress.batchId, {n: int(v or 0) for n, v in seen.asDict().items()})

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
