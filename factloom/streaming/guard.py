"""The guard of an append-only review log, as a stream with keyed state and as a batch over windows.

Events have a key, a place `seq` in their key's log (from 0, gapless), a kind, a time, and of submissions whether the stored evidence still holds. Each gets a
verdict: ACCEPTED, why it is refused, or REPEATED for a submission of what has been submitted, which changes nothing. Refused events are no part of
the log, so the next one is judged by the last that was accepted.

The stream takes events in any order and as often as they are delivered: one that is early waits in the state until those before it are there, and one whose place has been
judged is dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from factloom.operators.review import EVENTS
from factloom.operators.stretches import WIDTH, running_max

SUBMIT = "CASE_SUBMITTED"
UNKNOWN, SUBMITTED, EARLIER, BROKEN = "unknown event_type", "review already submitted", "event timestamp precedes previous event", "BROKEN_EVIDENCE"
OUT = "key {key}, seq long, kind string, ts long, verdict string"


def judged(events: DataFrame, key: str = "key", width: int = WIDTH) -> DataFrame:
    """Adds `verdict` to events (key, seq, kind, ts, evidence_ok); repeated rows of a place are one."""
    d = events.dropDuplicates([key, "seq"])
    known = F.col("kind").isin(*EVENTS)
    d = running_max(d, {"_last": F.when(known, F.col("ts"))}, "seq", key, width=width)  # refused ones are earlier, so they never are the latest
    early = F.coalesce(F.col("ts") < F.col("_last"), F.lit(False))
    whole = F.coalesce("evidence_ok", F.lit(True))
    d = running_max(d, {"_done": F.coalesce((F.col("kind") == SUBMIT) & ~early & whole, F.lit(False))}, "seq", key, width=width).withColumn("_done", F.coalesce("_done", F.lit(False)))
    verdict: Column = (
        F.when(~F.coalesce(known, F.lit(False)), UNKNOWN).when(F.col("_done"), F.when(F.col("kind") == SUBMIT, "REPEATED").otherwise(SUBMITTED))
        .when(early, EARLIER).when((F.col("kind") == SUBMIT) & ~whole, BROKEN).otherwise("ACCEPTED")
    )
    return d.withColumn("verdict", verdict).drop("_last", "_done")


class Guard(StatefulProcessor):
    """Keyed state: the next place, the latest accepted time, whether a submission was accepted; and events that wait for those before them."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.head = handle.getValueState("head", "next long, latest long, submitted boolean")
        self.held = handle.getMapState("held", "seq long", "kind string, ts long, ok boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803, ARG002
        at, latest, submitted = self.head.get() if self.head.exists() else (0, None, False)
        for part in rows:
            for seq, kind, ts, ok in part[["seq", "kind", "ts", "evidence_ok"]].itertuples(index=False, name=None):
                if seq >= at and not self.held.containsKey((seq,)):
                    self.held.updateValue((seq,), (None if pd.isna(kind) else kind, int(ts), True if pd.isna(ok) else bool(ok)))
        out = []
        while self.held.containsKey((at,)):
            kind, ts, ok = self.held.getValue((at,))
            self.held.removeKey((at,))
            early = latest is not None and ts < latest
            if kind not in EVENTS:
                verdict = UNKNOWN
            elif submitted:
                verdict = "REPEATED" if kind == SUBMIT else SUBMITTED
            elif early:
                verdict = EARLIER
            elif kind == SUBMIT and not ok:
                verdict = BROKEN
            else:
                verdict = "ACCEPTED"
                submitted = kind == SUBMIT
            if kind in EVENTS and not early:
                latest = ts
            out.append((key[0], at, kind, ts, verdict))
            at += 1
        self.head.update((at, latest, submitted))
        if out:
            yield pd.DataFrame(out, columns=["key", "seq", "kind", "ts", "verdict"])

    def close(self) -> None:
        pass


def guard(events: DataFrame, key_type: str = "long") -> DataFrame:
    """The stream's verdicts: key, seq, kind, ts, verdict. Needs a state store that holds maps (RocksDB)."""
    return events.groupBy("key").transformWithStateInPandas(Guard(), OUT.format(key=key_type), "Append", "None")


def submissions(verdicts: DataFrame) -> DataFrame:
    """The one accepted submission of each key."""
    return verdicts.where((F.col("kind") == SUBMIT) & (F.col("verdict") == "ACCEPTED"))
