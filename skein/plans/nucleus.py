"""The analysis in layers: core sources, their frames, echoes, changes and silences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from ..functions import lexicon
from ..operators import aggregate, extract, folds


def nucleus(records: DataFrame, topics: Sequence[str] = (), parts=lexicon.FRAME_PARTS) -> dict[str, DataFrame]:
    """Tables by name: ``sources, frames, deltas, silences``. Only the frames' structure is kept, not the text."""
    sources = aggregate.cartography(records)
    core = sources.filter("pareto_core").selectExpr("source AS medium")
    frames = folds.echo_frames(extract.argument_frames(records.join(core, "medium", "left_semi"), parts=parts))
    out = {"sources": sources, "frames": frames, "deltas": folds.frame_deltas(frames, parts=tuple(parts))}
    if topics:
        out["silences"] = extract.silence_alerts(frames, topics, parts=tuple(parts))
    return out
