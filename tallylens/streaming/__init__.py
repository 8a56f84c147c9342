"""Continuous analysis: comparison runs as they arrive, and tables compared row by row while both sides stream in."""

from __future__ import annotations

from collections.abc import Callable

import json
import zlib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import meeting
from ..schemas import MISSING_IN_SOURCE, MISSING_IN_TARGET

EQUAL, MISMATCH = "equal", "mismatch"
#: What findings() gives out: a key's state whenever it changes, and what it was said to be before.
FINDING = "key map<string,string>, kind string, columns array<string>, corrects string, at timestamp, revision long"
#: Of a group of keys: JSON, compressed, of key to source row, target row, latest time in ms, kind and columns last
#: said, revision, and the time at which it is due.
_STATE = "keys binary"


def on_new_runs(details: DataFrame, sink: Callable[[DataFrame, int], None]) -> DataStreamWriter:
    """A writer that calls sink(signals, batch) with the probe signals of each micro-batch of detail rows.

    details: a stream of recon_table_id, recon_type, mismatch_columns, source_count, seq, row. Each value
    pair is probed on its own, so no state is kept and a batch that runs twice gives the same rows."""
    from ..functions import probes
    from ..operators.ingest import column_samples

    def run(batch: DataFrame, number: int) -> None:
        found = probes.with_signals(column_samples(batch), "source_value", "target_value")
        sink(probes.each_signal(found, "recon_table_id", "column", "seq").drop("place"), number)

    return details.writeStream.foreachBatch(run)


def _row(df: DataFrame, side: str, keys: list[str], names: dict[str, str], time: str) -> DataFrame:
    """key (its texts), side, at, row (the texts of all other columns, as JSON)."""
    types = {f.name: f.dataType for f in df.schema.fields}
    shown = lambda c: meeting.text(meeting.comparable(F.col(meeting.quoted(c)), types[c]), types[c])
    own = {names.get(c, c): c for c in df.columns}
    key = F.to_json(F.array(*[F.coalesce(shown(own[k]), F.lit("\0")) for k in keys]))
    rest = [c for c in own if c not in keys and own[c] != time]
    row = F.to_json(F.array(*[F.struct(F.lit(c).alias("c"), shown(own[c]).alias("v")) for c in sorted(rest)]))
    return df.select(key.alias("key"), F.lit(side).alias("side"), F.col(meeting.quoted(time)).cast("timestamp").alias("at"), row.alias("row"))


def findings(source: DataFrame, target: DataFrame, keys: list[str], time: str, *, column_map: dict[str, str] | None = None, late: str = "1 hour", wait: str = "10 minutes", keep: str = "1 day", groups: int = 4096) -> DataFrame:
    """A stream of FINDING from two streams of rows with a time column of that name each (load time, say).

    Rows meet by key, whichever comes first; of several rows of one key on a side the latest counts. A key that only
    one side has is called missing once the watermark (`late` behind the latest time) is `wait` past its last row;
    should the other side's row arrive later, a new finding corrects the old one. State is one row of either side
    for each key, and is given up `keep` after the key's last row. Rows behind the watermark are dropped by Spark;
    null keys are keys, and rows without a time the earliest; values are compared as texts. Needs output mode `update`.

    Spark hands Python a group at a time, at a millisecond or more each, so `groups` groups of keys (by hash) share
    that. A group's state is read and written as a whole: some hundreds to thousands of keys a group are a good
    measure, so raise it with the number of keys. A checkpoint belongs to its number of groups."""
    both = _row(source, "s", keys, column_map or {}, time).unionByName(_row(target, "t", keys, {}, time))
    both = both.withColumns({"place": F.pmod(F.xxhash64("key"), F.lit(groups)), "micros": F.coalesce(F.unix_micros("at"), F.lit(0))})
    seconds = [pd.Timedelta(x).total_seconds() for x in (wait, keep)]
    wait_ms, keep_ms = (int(x * 1000) for x in seconds)
    names = list(keys)

    def judged(s: str | None, t: str | None) -> tuple[str, list[str]]:
        if s is None or t is None:
            return (MISSING_IN_SOURCE if s is None else MISSING_IN_TARGET), []
        if s == t:
            return EQUAL, []
        a, b = ({x["c"]: x.get("v") for x in json.loads(r)} for r in (s, t))
        columns = sorted(c for c in a.keys() & b.keys() if a[c] != b[c])
        return (MISMATCH if columns else EQUAL), columns

    def run(_, batches, state: GroupState):
        known = json.loads(zlib.decompress(state.get[0])) if state.exists else {}
        watermark, came, latest = state.getCurrentWatermarkMs(), {}, {}
        if not state.hasTimedOut:
            for b in batches:
                for key, side, micros, row in zip(b["key"], b["side"], b["micros"], b["row"], strict=True):
                    rows = came.setdefault(key, {})
                    if side not in rows or micros >= rows[side][0]:
                        rows[side] = (micros, row)
                    latest[key] = max(latest.get(key, 0), micros // 1000)
        out = []
        # A key without new rows is looked at once its time has passed, whether its group has new rows or not.
        for key in [*came, *(k for k, v in known.items() if v[6] < watermark and k not in came)]:
            s, t, last, said, columns, revision, _ = known.get(key) or (None, None, 0, None, [], 0, 0)
            timed_out = key not in came
            if timed_out:
                if s is not None and t is not None or said is not None:
                    del known[key]  # it was waited for `keep`
                    continue
            else:
                s, t = (came[key].get(side, (0, x))[1] for side, x in (("s", s), ("t", t)))
                last = max(last, int(latest[key]))
            kind, differ = judged(s, t)
            waits = (s is None or t is None) and not timed_out and said is None
            if not waits and (kind != said or differ != columns) and not (kind == EQUAL and said is None):
                revision += 1
                shown_key = {n: v for n, v in zip(names, json.loads(key), strict=True) if v != "\0"}
                out.append({"key": shown_key, "kind": kind, "columns": differ, "corrects": said, "at": pd.Timestamp(last, unit="ms", tz="UTC"), "revision": revision})
            if not waits:
                said, columns = kind, differ
            known[key] = (s, t, last, said, columns, revision, max(last + (wait_ms if waits else keep_ms), watermark + 1))
        if known:
            state.update((zlib.compress(json.dumps(known).encode(), 1),))
            state.setTimeoutTimestamp(max(min(v[6] for v in known.values()), watermark + 1))
        else:
            state.remove()
        if out:
            yield pd.DataFrame(out)

    # The watermark must stand on the rows of both streams together.
    return both.withWatermark("at", late).groupBy("place").applyInPandasWithState(run, FINDING, _STATE, "update", GroupStateTimeout.EventTimeTimeout)
