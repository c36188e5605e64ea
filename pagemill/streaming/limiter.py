"""Fixed-window admission per key, as a batch fold and as a stateful stream.

A key has several buckets (name, limit, window in seconds).  A window opens with the first admitted event
and lasts its length, whatever the clock says.  A request is admitted if every bucket has room for its
cost, and only then consumes anything; otherwise it is told after how many seconds to try again.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.folds import fold

# The policies of the service, as (bucket, limit, seconds).
POLICIES = {"auth": (("attempts", 5, 60),), "requests": (("requests", 20, 60), ("chars", 250_000, 300))}
LEASES, LEASE_SECONDS = 4, 300


def admit_batch(events: DataFrame, buckets: tuple[tuple[str, int, int], ...], costs: dict[str, Column] | None = None) -> DataFrame:
    """``events`` (key, at in seconds, seq) with ``allowed``, ``bucket`` and ``retry_after``.

    A bucket's cost is 1 unless ``costs`` names a column.  The decision for an event depends on every
    earlier one of its key, so a key is one fold in order of (at, seq), whose state is its limiter.
    """
    cost = [(costs or {}).get(name, F.lit(1)).cast("long").alias(f"c{i}") for i, (name, _, _) in enumerate(buckets)]
    rows = events.select("key", F.col("at").cast("double").alias("at"), F.col("seq").cast("long").alias("seq"), *cost)

    def step(limiter: Limiter, row: tuple) -> tuple[Limiter, tuple]:
        return limiter, limiter.admit(row[1], {name: row[3 + i] for i, (name, _, _) in enumerate(buckets)})

    decided = fold(rows, ["key"], ["at", "seq"], lambda: Limiter(buckets), step, "allowed boolean, bucket string, retry_after int")
    return decided.select("key", "seq", "allowed", "bucket", "retry_after")


class Limiter:
    """The state of one key, in plain Python: what the stream keeps, and the loop that tests compare with."""

    def __init__(self, buckets: tuple[tuple[str, int, int], ...], saved: dict | None = None) -> None:
        self.buckets = buckets
        self.open = {k: tuple(v) for k, v in (saved or {}).items() if isinstance(v, (list, tuple)) and len(v) == 2 and all(isinstance(x, (int, float)) and x >= 0 for x in v)}
        self.leases: dict[str, float] = {}

    def admit(self, at: float, costs: dict[str, int], lease: tuple[str, int, float] | None = None) -> tuple[bool, str | None, int | None]:
        """(allowed, bucket that refused, seconds to wait); nothing is consumed when anything refuses."""
        self.open = {k: v for k, v in self.open.items() if v[1] > at}
        self.leases = {k: v for k, v in self.leases.items() if v > at}
        for name, limit, seconds in self.buckets:
            count, reset = self.open.get(name, (0, at + seconds))
            if count + costs.get(name, 1) > limit:
                return False, name, max(1, -int(-(reset - at) // 1))
        if lease and len(self.leases) >= lease[1]:
            return False, None, 2
        for name, _, seconds in self.buckets:
            count, reset = self.open.get(name, (0, at + seconds))
            self.open[name] = (count + costs.get(name, 1), reset)
        if lease:
            self.leases[lease[0]] = at + lease[2]
        return True, None, None

    def release(self, name: str) -> bool:
        return self.leases.pop(name, None) is not None


DECISIONS = "key string, seq long, allowed boolean, bucket string, retry_after int"


def admit_stream(events: DataFrame, buckets: tuple[tuple[str, int, int], ...]) -> DataFrame:
    """A stream of (key string, at double, seq long) -> its decisions; state is one struct a bucket and key.

    Events of a micro-batch are taken in order of (at, seq); idle keys leave the state when all of their
    windows have passed (processing time), since an empty window says nothing.
    """
    longest = max(s for _, _, s in buckets)
    names = [n for n, _, _ in buckets]
    state = ", ".join(f"{n}_count long, {n}_reset double" for n in names)

    def run(key: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        saved = dict(zip(names, zip(held.get[::2], held.get[1::2]))) if held.exists else {}
        limiter = Limiter(buckets, {k: v for k, v in saved.items() if v[1] > 0})
        out = []
        for at, seq in sorted(pd.concat(list(frames))[["at", "seq"]].itertuples(index=False, name=None)):
            allowed, bucket, wait = limiter.admit(at, {})
            out.append((key[0], seq, allowed, bucket, wait))
        held.update(tuple(x for n in names for x in limiter.open.get(n, (0, 0.0))))
        held.setTimeoutDuration(longest * 1000)
        yield pd.DataFrame(out, columns=["key", "seq", "allowed", "bucket", "retry_after"]).astype({"retry_after": "Int32"})

    return events.groupBy("key").applyInPandasWithState(run, DECISIONS, state, "append", GroupStateTimeout.ProcessingTimeTimeout)
