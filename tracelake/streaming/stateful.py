"""Keyed state: captures that wait for their log until a deadline, and taxonomies that evolve operation by operation.

Both need ``spark.sql.streaming.stateStore.providerClass`` to be the RocksDB provider.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CAPTURED = "host string, session_id string, receipt_id string, status string, n_bytes long"


class Deadline(StatefulProcessor):
    """Captures of one session: each receipt asks for the log up to ``n_bytes`` and is committed once so much is there.

    A receipt that waits longer than the deadline is told to be pending, and stays; when the log has grown,
    it is committed (so a late session end is replayed, not lost). A receipt that comes again, or one that a
    committed longer one covers, is a no-op.
    """

    def __init__(self, deadline_ms: int):
        self.deadline_ms = deadline_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.size = handle.getValueState("size", "complete long, committed long")
        self.asked = handle.getMapState("asked", "receipt_id string", "n_bytes long, due long, status string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        now = timerValues.getCurrentProcessingTimeInMs()
        complete, committed = self.size.get() if self.size.exists() else (0, 0)
        out = []
        for part in rows:
            for receipt, n, kind in zip(part["receipt_id"], part["n_bytes"], part["kind"], strict=True):
                if kind == "log":
                    complete = max(complete, int(n))
                elif self.asked.containsKey((receipt,)):
                    out.append((receipt, "no_op", int(n)))
                else:
                    self.asked.updateValue((receipt,), (int(n), now + self.deadline_ms, "new"))
        waiting = False
        for (receipt,), (n, due, status) in sorted(self.asked.iterator()):
            if status in ("new", "waiting", "pending") and n <= complete:
                out.append((receipt, "no_op" if n <= committed else "committed", n))
                self.asked.updateValue((receipt,), (n, due, "done"))
                committed = max(committed, n)
            elif status == "new":
                self.asked.updateValue((receipt,), (n, due, "waiting"))
                waiting = True
        self.size.update((complete, committed))
        if waiting:
            self.handle.registerTimer(now + self.deadline_ms)
        yield self._rows(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        out = []
        for (receipt,), (n, due, status) in sorted(self.asked.iterator()):
            if status == "waiting" and due <= expiredTimerInfo.getExpiryTimeInMs():
                out.append((receipt, "pending", n))
                self.asked.updateValue((receipt,), (n, due, "pending"))
        yield self._rows(key, out)

    @staticmethod
    def _rows(key, out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(*key, *row) for row in out], columns=["host", "session_id", "receipt_id", "status", "n_bytes"])


def captures(requests: DataFrame, deadline_ms: int) -> DataFrame:
    """What becomes of each receipt: ``host, session_id, receipt_id, status, n_bytes``, a row per change of status.

    ``requests(host, session_id, receipt_id, n_bytes, kind)``: kind ``ask`` asks for the session's log up to
    ``n_bytes``, kind ``log`` says that so many bytes of whole lines are there (receipt_id is null).
    """
    return requests.groupBy("host", "session_id").transformWithStateInPandas(Deadline(deadline_ms), CAPTURED, "Append", "ProcessingTime")


AUDIT = "run string, ord long, op string, code string, args array<string>, applied boolean, codes array<string>"


def apply(codes: list[str] | None, op: str, code: str, args: list[str]) -> list[str] | None:
    """The codes after one operation; null if it names a code that isn't there, appends one that is, or comes after such."""
    if codes is None:
        return None
    known = code in codes
    if op == "append":
        return None if known else sorted([*codes, code])
    if op == "split":
        return sorted([c for c in codes if c != code] + list(args)) if known else None
    if op == "merge":
        return sorted([c for c in codes if c not in args] + [code]) if set(args) <= set(codes) else None
    return codes if known else None


class Evolution(StatefulProcessor):
    """One run's codes: operations are applied in the order of their numbers, from 0 without gaps.

    An operation that comes early waits, one that comes again is skipped, so each has one audit row.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "next long, codes array<string>, failed boolean")
        self.early = handle.getMapState("early", "ord long", "op string, code string, args array<string>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        at, codes, failed = self.state.get() if self.state.exists() else (0, [], False)
        codes, out = None if failed else list(codes), []
        for part in rows:
            for ord_, op, code, args in zip(part["ord"], part["op"], part["code"], part["args"], strict=True):
                if ord_ >= at:
                    self.early.updateValue((int(ord_),), (op, code, [] if args is None else list(args)))
        while self.early.containsKey((at,)):
            op, code, args = self.early.getValue((at,))
            codes = apply(codes, op, code, list(args))
            out.append((*key, at, op, code, list(args), codes is not None, codes))
            self.early.removeKey((at,))
            at += 1
        self.state.update((at, codes or [], codes is None))
        yield pd.DataFrame(out, columns=["run", "ord", "op", "code", "args", "applied", "codes"])


def evolve(ops: DataFrame) -> DataFrame:
    """An audit row per operation of ``ops(run, ord, op, code, args)``, with the codes after it (null once an operation failed)."""
    return ops.groupBy("run").transformWithStateInPandas(Evolution(), AUDIT, "Append", "None")
