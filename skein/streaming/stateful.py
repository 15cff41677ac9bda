"""Operators with state of their own, by ``transformWithState``: quotas and deltas of frames.

State lives in RocksDB, by key; :func:`state_of` reads it back as a table. A
query that uses these needs the session setting of :data:`PROVIDER`, which
:func:`prepared` makes.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.text import tokenize_light
from ..operators.folds import shared

PROVIDER = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def prepared(spark: SparkSession) -> SparkSession:
    spark.conf.set(*PROVIDER)
    return spark


def state_of(spark: SparkSession, checkpoint: str, variable: str) -> DataFrame:
    """What a finished or running query holds in a variable: ``key, value``, or ``key, user_map_key, user_map_value``."""
    return spark.read.format("statestore").option("path", checkpoint).option("stateVarName", variable).load()


class Quota(StatefulProcessor):
    """Accepts rows of a key while fewer usable ones than ``cap`` came before.

    Of a batch's rows only those that are still accepted are held, however many
    come: they are taken in the order of ``ord``, and a row behind the one that
    fills the quota can't come back.
    """

    def __init__(self, cap: int) -> None:
        self.cap = cap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.taken = handle.getValueState("taken", "taken long")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        """Rows accepted before the stream began."""
        self.taken.update((min(self.cap, int(initialState["taken"].sum())),))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        taken = self.taken.get()[0] if self.taken.exists() else 0
        held = None
        for frame in rows:
            both = frame[["ord", "usable"]] if held is None else pd.concat([held, frame[["ord", "usable"]]])
            both = both.sort_values("ord", kind="stable")
            before = taken + both["usable"].cumsum() - both["usable"]
            held = both[before < self.cap]
        if held is None:
            return
        before = taken + held["usable"].cumsum() - held["usable"]
        self.taken.update((min(self.cap, int(taken + held["usable"].sum())),))
        yield pd.DataFrame({"ord": held["ord"], "year": key[0], "source_type": key[1], "accepted_before": before})

    def close(self) -> None:
        pass


QUOTA = "ord long, year int, source_type string, accepted_before long"


#: Stand for a null year and genre: a null key would be a group for each row.
NO_YEAR, NO_GENRE = -(1 << 31), "\0"


def quota(stream: DataFrame, cap: int, before: DataFrame | None = None) -> DataFrame:
    """Rows ``ord, year, source_type, usable``: those accepted under a cap by year and genre.

    ``before``: ``year, source_type, taken`` of earlier runs, the state to begin
    with. A null year or genre is a group like others.
    """
    prepared(stream.sparkSession)
    key = {"year": F.coalesce("year", F.lit(NO_YEAR)), "source_type": F.coalesce("source_type", F.lit(NO_GENRE))}
    start = None if before is None else before.withColumns(key).groupBy("year", "source_type")
    kept = stream.withColumns(key).groupBy("year", "source_type").transformWithStateInPandas(Quota(cap), QUOTA, "append", "none", start)
    return kept.withColumns({"year": F.nullif("year", F.lit(NO_YEAR)), "source_type": F.nullif("source_type", F.lit(NO_GENRE))})


DELTAS = "medium string, year int, frame_id string, previous_frame_id string, delta_type string, similarity_to_previous double, changed_fields string, storage_decision string"


class Deltas(StatefulProcessor):
    """What changed in a medium's frames since the last one that changed.

    State: the id of that frame, and its terms by part. With event time a medium
    that is silent for ``silence`` milliseconds is forgotten, and its next frame
    is a baseline again.
    """

    def __init__(self, threshold: float, parts: Sequence[str], silence: int | None) -> None:
        self.threshold, self.parts, self.silence = threshold, tuple(parts), silence

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "frame_id string")
        self.terms = handle.getMapState("terms", "part string", "terms array<string>")
        self.due = handle.getValueState("due", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        names = [f.split()[0] for f in DELTAS.split(", ")]
        fields = (*self.parts, "frame_terms")
        last = self.last.get()[0] if self.last.exists() else None
        then = {p: set(self.terms.getValue((p,))[0]) for p in fields} if last is not None else {}
        moved, latest = False, None
        for frame in rows:  # sorted by year and id within the batch: see deltas()
            out = []
            for row in frame.sort_values(["year", "frame_id"]).to_dict("records"):
                now = {p: set(row[f"x_{p}"]) for p in fields}
                if self.silence is not None:
                    latest = max(latest or 0, int(row["ts"].timestamp() * 1000))
                if last is None:
                    out.append((key[0], row["year"], row["frame_id"], None, "baseline", None, ", ".join(self.parts), "store_structural_frame"))
                    last, then, moved = row["frame_id"], now, True
                    continue
                changed = [p for p in self.parts if shared(now[p], then[p]) < self.threshold]
                kind, decision = ("change", "store_delta") if changed else ("stable_repetition", "timestamp_counter_only")
                out.append((key[0], row["year"], row["frame_id"], last, kind, round(shared(now["frame_terms"], then["frame_terms"]), 5), ", ".join(changed), decision))
                if changed:
                    last, then, moved = row["frame_id"], now, True
            yield pd.DataFrame(out, columns=names)
        if moved:
            self.last.update((last,))
            for p in fields:
                self.terms.updateValue((p,), (sorted(then[p]),))
        if latest is not None:
            at = max(latest, self.due.get()[0] - self.silence if self.due.exists() else 0) + self.silence
            if self.due.exists():
                self.handle.deleteTimer(self.due.get()[0])
            self.handle.registerTimer(at)
            self.due.update((at,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        self.terms.clear()
        self.due.clear()
        return iter(())

    def close(self) -> None:
        pass


def deltas(frames: DataFrame, threshold: float = 0.82, parts: Sequence[str] = ("problem", "culprit", "solution", "urgency"), silence: int | None = None, lateness: str = "1 day") -> DataFrame:
    """A stream of frames as of ``argument_frames`` -> its deltas, as :func:`skein.operators.folds.frame_deltas` gives them for a table.

    Batches come in the order of time; a medium's frames in one batch go by year
    and id. ``silence`` needs an event time ``ts``.
    """
    prepared(frames.sparkSession)
    sets = [F.array_distinct(tokenize_light(F.col(p))).alias(f"x_{p}") for p in (*parts, "frame_terms")]
    rows = frames.select(F.coalesce(F.nullif("medium", F.lit("")), F.lit("unknown")).alias("medium"), F.coalesce("year", F.lit(0)).alias("year"), "frame_id", *sets, *(["ts"] if silence is not None else []))
    if silence is not None:
        rows = rows.withWatermark("ts", lateness)
    return rows.groupBy("medium").transformWithStateInPandas(Deltas(threshold, parts, silence), DELTAS, "append", "none" if silence is None else "eventTime")
