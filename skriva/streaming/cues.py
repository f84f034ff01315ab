"""Extensions to streams (the batch operators define the results).

``gap_sessions`` groups tokens into sessions by a watermark; a session that is open when
the input ends is emitted once the watermark passes it.  ``build_cues`` runs the full cue
rule with its state per file; a row with ``last`` true flushes what is held, and so does,
where ``idle_ms`` is given, a pause of that length (such a query never runs dry: every
trigger looks for files that have gone quiet).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from skriva.operators.cues import Builder, Layout


def gap_sessions(tokens: DataFrame, by: str, ts: str, gap: str = "1200 milliseconds", late: str = "10 seconds") -> DataFrame:
    """(by, start, end, n) of sessions; tokens later than ``late`` are left out."""
    s = F.session_window(ts, gap)
    return tokens.withWatermark(ts, late).groupBy(by, s.alias("s")).agg(F.count("*").alias("n"), F.max(ts).alias("end")).select(by, F.col("s.start").alias("start"), "end", "n")


def build_cues(tokens: DataFrame, layout: Layout = Layout(), by: str = "file_id", idle_ms: int | None = None) -> DataFrame:
    """(by, start_s, end_s, text) of a stream of (by, pos, bytes, t_s, last), in order within a file."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, start, last = state.get if state.exists else (b"", None, None)
        b = Builder(layout, (bytes(held), start, last))
        out = []
        if state.hasTimedOut:
            out += b.flush() if b.held else []
            state.remove()
        else:
            rows = pd.concat(list(batches)).sort_values("pos", kind="stable")
            for r in rows.itertuples(index=False):
                if r.bytes:
                    out += b.feed(bytes(r.bytes), float(r.t_s))
                if r.last and b.held:
                    out += b.flush()
            if b.held:
                state.update((b.held, b.start, b.last))
                if idle_ms:
                    state.setTimeoutDuration(idle_ms)
            elif state.exists:
                state.remove()
        if out:
            yield pd.DataFrame([(key[0], *c) for c in out], columns=[by, "start_s", "end_s", "text"])

    kind = tokens.schema[by].dataType.simpleString()
    return tokens.groupBy(by).applyInPandasWithState(step, f"{by} {kind}, start_s double, end_s double, text string", "held binary, start double, last double", "append", GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout)
