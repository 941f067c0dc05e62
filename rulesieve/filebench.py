"""Times a set of files: definitions, rules and events, one item a line.

`python -m rulesieve.filebench DEFS RULES EVENTS [RUNS]` prints one JSON line.
"""

from __future__ import annotations

import json
import sys
import time
from statistics import median

from pyspark.sql import SparkSession

from .operators.match import match
from .registry import Registry
from .sources import files
from .sources.events import accepted, rejected


def run(spark: SparkSession, defs: str, rules: str, events: str, runs: int = 5) -> dict[str, float]:
    """Counts of what was read and matched, rules entered a second, and the median seconds of decoding and of matching all events."""
    own = Registry(files.read_schema(spark, defs))
    given = files.read_rules(spark, rules).persist()
    n = given.count()
    start = time.perf_counter()
    bad = files.load_rules(own, given).count()
    entering = time.perf_counter() - start
    given.unpersist()
    read = files.read_events(spark, events, own.schema).persist()
    start = time.perf_counter()
    known, unknown = accepted(read).count(), rejected(read).count()
    decoding = time.perf_counter() - start
    times, found = [], 0
    for _ in range(runs):
        start = time.perf_counter()
        found = match(accepted(read), own).count()
        times.append(time.perf_counter() - start)
    read.unpersist()
    return {
        "attributes": len(own.schema), "rules": len(own), "rules_rejected": bad, "rules_a_second": round(n / entering, 1), "events": known, "events_rejected": unknown,
        "decoding_seconds": round(decoding, 3), "matches": found, "matching_seconds": round(median(times), 3), **{k: v for k, v in own.stats().items() if k in ("nodes", "leaves", "edges", "max_level")},
    }


if __name__ == "__main__":
    print(json.dumps(run(SparkSession.builder.getOrCreate(), *sys.argv[1:4], *map(int, sys.argv[4:5]))))
