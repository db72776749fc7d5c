"""Complete groups: a key is emitted once all its kinds have come, as a batch and as a stream."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle


def complete_groups(events: DataFrame, key: str, kind: str, value: str, order: str, kinds: Sequence[str]) -> DataFrame:
    """(key, members map<kind, last value>) of the keys with every kind; the last of equal kinds by order holds. Incomplete keys are counted by `incomplete`."""
    last = events.where(F.col(kind).isin(list(kinds))).groupBy(key, kind).agg(F.max_by(value, order).alias(value))
    whole = last.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(kind, value)))).alias("members"))
    return whole.where(F.size("members") == len(kinds))


def incomplete(events: DataFrame, key: str, kind: str, kinds: Sequence[str]) -> DataFrame:
    """(key, missing): what would vanish silently."""
    seen = events.groupBy(key).agg(F.collect_set(kind).alias("seen"))
    return seen.select(key, F.array_except(F.array(*(F.lit(k) for k in kinds)), "seen").alias("missing")).where(F.size("missing") > 0)


def complete_groups_stream(events: DataFrame, key: str, kind: str, kinds: Sequence[str], timeout: str | None = None) -> DataFrame:
    """Streaming form: (key, n_events, complete) once per key when its last kind comes. State is the kinds seen and a count; a timeout drops the state of keys without new events for that long, those that never fill and those that are done."""
    wanted = set(kinds)
    how = GroupStateTimeout.ProcessingTimeTimeout if timeout else GroupStateTimeout.NoTimeout

    def update(k: tuple, batches: Iterable[pd.DataFrame], state: GroupState) -> Iterable[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        seen, n, done = (set(state.get[0].split("\x1f")) - {""}, state.get[1], state.get[2]) if state.exists else (set(), 0, False)
        for b in batches:
            seen |= set(b[kind]) & wanted
            n += len(b)
        full = seen == wanted
        state.update(("\x1f".join(sorted(seen)), n, done or full))
        if timeout:
            state.setTimeoutDuration(timeout)
        if full and not done:
            yield pd.DataFrame({key: [k[0]], "n_events": [n], "complete": [True]})

    kept = dict(events.dtypes)[key]
    return events.groupBy(key).applyInPandasWithState(update, f"{key} {kept}, n_events bigint, complete boolean", "seen string, n bigint, done boolean", "append", how)


#: The state store that keyed state with timers needs.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: Keys are dealt to so many buckets by hash; a bucket is what Python and the state store handle at once.
BUCKETS = 1_024


class _Groups(StatefulProcessor):
    """State of a bucket of keys: a row a key (its end, and whether it has been emitted) and a row a key and kind (the last value and its time), read and written as wholes. The only timer of a bucket is its earliest end."""

    def __init__(self, kinds: Sequence[str], names: tuple[str, str, str], expires_ms: int) -> None:
        self.kinds, self.names, self.expires_ms = list(kinds), names, expires_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # tables as Arrow bytes: the state API turns single rows to bytes one by one
        self.state = handle.getValueState("bucket", "ends binary, members binary")

    def load(self) -> tuple[pd.DataFrame, pd.DataFrame]:
        if not self.state.exists():
            return pd.DataFrame({"key": [], "until": [], "done": []}), pd.DataFrame({"key": [], "kind": [], "value": [], "at": []})
        ends, members = (pa.ipc.open_stream(bytes(b)).read_pandas() for b in self.state.get())
        return ends, members

    def keep(self, ends: pd.DataFrame, members: pd.DataFrame) -> None:
        if not len(ends):
            self.state.clear()
            return
        out = []
        for rows in (ends, members):
            table, sink = pa.Table.from_pandas(rows, preserve_index=False), pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema) as writer:
                writer.write_table(table)
            out.append(sink.getvalue().to_pybytes())
        self.state.update(tuple(out))

    @staticmethod
    def latest(members: pd.DataFrame) -> pd.DataFrame:
        """The last row of each key and kind; of equal times that with the greatest value."""
        return members.sort_values(["at", "value"], kind="stable", na_position="first").drop_duplicates(["key", "kind"], keep="last")

    @staticmethod
    def joined(parts: list[pd.DataFrame]) -> pd.DataFrame:
        some = [p for p in parts if len(p)]
        return pd.concat(some, ignore_index=True) if some else parts[0]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        ends, members = self.load()
        timer = int(ends["until"].min()) if len(ends) else None
        for part in rows:
            # by place, as names with a leading underscore are not kept
            part = part.iloc[:, [0, 1, 2, 4]].set_axis(["key", "kind", "value", "at"], axis=1)
            first = part.groupby("key", dropna=False, as_index=False)["at"].min()
            first = pd.DataFrame({"key": first["key"], "until": first["at"] // 1000 + self.expires_ms, "done": False})
            ends = self.joined([ends, first]).groupby("key", dropna=False, as_index=False).agg({"until": "min", "done": "max"})  # the earliest turn of a key decides
            members = self.latest(self.joined([members, part[part["kind"].isin(self.kinds)]]))
        members = members[~members["key"].isin(ends["key"][ends["done"].astype(bool)])]
        whole = members.groupby("key", dropna=False)["kind"].transform("size") == len(self.kinds)
        full = ends["key"].isin(members["key"][whole])
        found = self.rows(ends["key"][full], members[whole], True)
        ends = ends.assign(done=ends["done"].astype(bool) | full)
        self.keep(ends, members[~whole])
        self.wake(timer, ends)
        if len(found):
            yield found

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        ends, members = self.load()
        # all ends that the watermark has passed: those of this timer and those that would come after it in this batch
        over = ends["until"] <= max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        gone = members["key"].isin(ends["key"][over])
        open_ = ends["key"][over & ~ends["done"].astype(bool)]
        found = self.rows(open_, members[gone], False)
        self.keep(ends[~over], members[~gone])
        self.wake(None, ends[~over])
        if len(found):
            yield found

    def wake(self, timer: int | None, ends: pd.DataFrame) -> None:
        """Sets the timer to the earliest end."""
        until = int(ends["until"].min()) if len(ends) else None
        if until != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if until is not None:
                self.handle.registerTimer(until)

    def rows(self, keys: pd.Series, members: pd.DataFrame, complete: bool) -> pd.DataFrame:
        have: dict = {k: {} for k in keys.tolist()}
        for k, kind, v in zip(*(members[c].tolist() for c in ("key", "kind", "value")), strict=True):
            if k in have:
                have[k][kind] = v
        kinds = [sorted(h) for h in have.values()]
        missing = [[k for k in self.kinds if k not in h] for h in have.values()]
        return pd.DataFrame({self.names[0]: [*have], "complete": complete, "kinds": kinds, "last": [[h[k] for k in own] for h, own in zip(have.values(), kinds, strict=True)], "missing": missing})

    def close(self) -> None:
        pass


def groups_with_expiry(events: DataFrame, key: str, kind: str, value: str, time: str, kinds: Sequence[str], expires_ms: int, buckets: int = BUCKETS) -> DataFrame:
    """Streaming groups with an end: (key, complete, kinds, last, missing).

    A key is emitted once when its last kind has come, with the last value of each kind by time (equal times: the greatest
    value); or, if the watermark passes its first event by expires_ms before that, once as incomplete, with what has come
    and what is missing. Then its state is dropped, done or not, so state holds keys of the last expires_ms
    only, at most a value a kind each. Later events of the key begin anew. events carry a watermark on `time`; the session
    uses the RocksDB state store (ROCKSDB). Events without a time are passed over.

    State and calls into Python are by bucket of keys: a batch costs a call for each bucket it touches, and reads and writes
    the state of that bucket. More buckets suit many keys at a time and small batches."""
    types = dict(events.dtypes)
    schema = f"{key} {types[key]}, complete boolean, kinds array<string>, last array<{types[value]}>, missing array<string>"
    processor = _Groups(kinds, (key, kind, value), expires_ms)
    dealt = events.where(F.col(time).isNotNull()).select(key, kind, value, time, F.unix_micros(F.col(time).cast("timestamp")).alias("_at"), F.pmod(F.xxhash64(key), F.lit(buckets)).alias("_bucket"))
    return dealt.groupBy("_bucket").transformWithStateInPandas(processor, schema, "append", "EventTime")
