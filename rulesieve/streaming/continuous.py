"""Continuous queries: a stream of payloads, decoded, matched and delivered micro-batch by micro-batch.

Events are independent, so there is no state and no watermark.  A micro-batch sees the registry as it is when it starts;
inside it nothing changes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from ..operators.deliver import deliver
from ..operators.match import match
from ..registry import Registry
from ..sources.events import accepted, rejected


def matches_of(batch: DataFrame, registry: Registry, how: str = "auto") -> DataFrame:
    """event_id, sub_id of a decoded batch's accepted events."""
    return match(accepted(batch), registry, how)


def continuous(decoded: DataFrame, registry: Callable[[], Registry], subscribers: Callable[[], DataFrame] | None, sink: Callable[[DataFrame, int], None], on_rejected: Callable[[DataFrame, int], None] | None = None, how: str = "auto") -> DataStreamWriter:
    """A writer to be started: sink(rows, batch number) gets the messages, or the matches where there are no subscribers.

    A batch may come again after a failure; a sink that must not see it twice keeps the batch number.
    """

    def each(batch: DataFrame, number: int) -> None:
        held = batch.persist()
        try:
            found = matches_of(held, registry(), how)
            sink(found if subscribers is None else deliver(found, accepted(held), subscribers()), number)
            if on_rejected is not None:
                on_rejected(rejected(held), number)
        finally:
            held.unpersist()

    return decoded.writeStream.foreachBatch(each)
