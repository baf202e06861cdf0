"""Session history as a stateful stream (S1) and in-session repeat suppression.

S1 keeps, per user, the open session as far as the watermark has passed (start, last
event, first-seen items capped at 50, event count) and the events after the watermark,
which may still be preceded by late rows.  Events enter the session in event-time order
once the watermark has reached them, so the result does not depend on the order or the
batches in which rows arrive within the watermark delay.  A session is closed by the
watermark passing its last event plus the gap, or by a settled event beyond the gap --
the reference's time-to-live renewed on every call, repeats included.  Evicted items may
return, as in the reference (append if absent, keep the last 50).

S6 keeps, per user, the open session and its items and passes an event on unless its
item is already in the session.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

GAP_SECONDS = 1800
MAX_ITEMS = 50

OUTPUT_SCHEMA = ("user_id long, session_start timestamp, session_end timestamp, "
                 "n_events long, items array<long>")
STATE_SCHEMA = ("start timestamp, last timestamp, items array<long>, n long, "
                "pending_ts array<timestamp>, pending_items array<long>")
SEEN_SCHEMA = "start timestamp, last timestamp, items array<long>"


def _ms(ts) -> int:
    return pd.Timestamp(ts).value // 1_000_000


def _session_fn(gap_seconds: int, max_items: int):
    gap = pd.Timedelta(seconds=gap_seconds)

    def fn(key, pdfs, state):
        start, last, items, n, pending = None, None, [], 0, []
        if state.exists:
            start, last, items, n, p_ts, p_items = state.get
            items, pending = list(items), [(pd.Timestamp(t), int(i)) for t, i in zip(p_ts, p_items)]
            start, last = (pd.Timestamp(start), pd.Timestamp(last)) if n else (None, None)
        if not state.hasTimedOut:
            for pdf in pdfs:
                pending.extend((pd.Timestamp(t), int(i)) for t, i in zip(pdf["ts"], pdf["item_id"]))
        wm = state.getCurrentWatermarkMs()
        out = []

        def close():
            out.append({"user_id": int(key[0]), "session_start": start, "session_end": last,
                        "n_events": int(n), "items": list(items)})

        pending.sort()
        settled = [e for e in pending if _ms(e[0]) <= wm]
        pending = pending[len(settled):]
        for ts, item in settled:
            if n and ts - last >= gap:
                close()
                n = 0
            if not n:
                start, items = ts, []
            if item not in items:
                items = [*items, item][-max_items:]
            last, n = ts, n + 1
        if n and _ms(last + gap) <= wm:
            close()
            n = 0
        if n or pending:
            epoch = pd.Timestamp(0)
            state.update((start if n else epoch, last if n else epoch, items if n else [], n,
                          [t for t, _ in pending], [i for _, i in pending]))
            due = ([_ms(last + gap)] if n else []) + ([_ms(pending[0][0])] if pending else [])
            state.setTimeoutTimestamp(max(min(due), wm + 1))
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame(out)
    return fn


def session_state_stream(events: DataFrame, gap_seconds: int = GAP_SECONDS, max_items: int = MAX_ITEMS,
                         watermark: str = "1 hour") -> DataFrame:
    """Closed sessions from a stream of (user_id, item_id, ts) valid events."""
    ev = events.select("user_id", "item_id", F.col("ts").cast("timestamp").alias("ts")) \
               .withWatermark("ts", watermark)
    return ev.groupBy("user_id").applyInPandasWithState(
        _session_fn(gap_seconds, max_items), OUTPUT_SCHEMA, STATE_SCHEMA, "append",
        GroupStateTimeout.EventTimeTimeout)


def _dedup_fn(gap_seconds: int, max_items: int, columns: list[str]):
    gap = pd.Timedelta(seconds=gap_seconds)

    def fn(key, pdfs, state):
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(pdfs), ignore_index=True).sort_values(["ts", "item_id"], kind="stable")
        start = last = None
        items: list = []
        if state.exists:
            start, last, items = state.get
            start, last, items = pd.Timestamp(start), pd.Timestamp(last), list(items)
        keep = []
        for ts, item in zip(rows["ts"], rows["item_id"]):
            ts, item = pd.Timestamp(ts), int(item)
            if last is not None and ts <= start - gap:
                keep.append(True)  # a late row of an earlier session
                continue
            if last is None or ts - last >= gap:
                start, last, items = ts, ts, []
            start, last = min(start, ts), max(last, ts)
            keep.append(item not in items)
            if keep[-1]:
                items = [*items, item][-max_items:]
        state.update((start, last, items))
        state.setTimeoutTimestamp(max(_ms(last + gap), state.getCurrentWatermarkMs() + 1))
        yield rows.loc[keep, columns]
    return fn


def dedup_stream(events: DataFrame, gap_seconds: int = GAP_SECONDS, max_items: int = MAX_ITEMS,
                 watermark: str = "1 hour") -> DataFrame:
    """Drop an event whose item is already in the user's current session.  What is kept
    does not depend on how the input is cut into batches; state leaves when the watermark
    has passed the session."""
    ev = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)
    return ev.groupBy("user_id").applyInPandasWithState(
        _dedup_fn(gap_seconds, max_items, ev.columns), ev.schema, SEEN_SCHEMA, "append",
        GroupStateTimeout.EventTimeTimeout)
