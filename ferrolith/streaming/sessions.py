"""Sessions as streams: toggles, selections with weights, revealed groups; each a state processor and a batch fold.

Events of a session come in the order of event_id, which may have gaps; an id at or below the last one applied is a
repeat and changes nothing. A processor keeps one map entry a key, so a session's state is never one value that grows.
It writes changes, not states: rows (session, event_id, kind, key, value, on), where a row of kind reset or end ends
all that the session's earlier rows say. `latest` turns the changes into the table of what holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

CHANGES = "session long, event_id long, kind string, key string, value double, on boolean"


class Held:
    """A map of the state store for the time of one call: read when asked for, written once at its end."""

    def __init__(self, state, wrap, unwrap):
        self.state, self.wrap, self.unwrap = state, wrap, unwrap
        self.known: dict = {}
        self.changed: set = set()
        self.cleared = False

    def get(self, key):
        if key not in self.known:
            there = not self.cleared and self.state.containsKey((key,))
            self.known[key] = self.unwrap(self.state.getValue((key,))) if there else None
        return self.known[key]

    def put(self, key, value) -> None:
        """None takes the key away."""
        self.known[key] = value
        self.changed.add(key)

    def clear(self) -> None:
        self.known, self.changed, self.cleared = {}, set(), True

    def flush(self) -> None:
        if self.cleared:
            self.state.clear()
        for key in self.changed:
            if self.known[key] is not None:
                self.state.updateValue((key,), self.wrap(self.known[key]))
            elif not self.cleared and self.state.containsKey((key,)):
                self.state.removeKey((key,))


class Changes:
    """The last change of each key of one call; a reset makes all before it needless."""

    def __init__(self):
        self.rows: dict = {}

    def add(self, event: int, kind: str, key, on: bool, value: float | None = None) -> None:
        self.rows[kind, key] = (event, value, on)

    def reset(self, event: int) -> None:
        self.rows = {("reset", None): (event, None, False)}

    def frame(self, session) -> pd.DataFrame:
        rows = [(session, event, kind, None if key is None else str(key), value, on) for (kind, key), (event, value, on) in self.rows.items()]
        return pd.DataFrame(rows, columns=["session", "event_id", "kind", "key", "value", "on"])


class Session(StatefulProcessor):
    """Applies a session's new events in order. idle_ms bounds the state by event time, ttl_ms by processing time.

    With idle_ms a timer ends a session so long after its latest event: its state goes, and a row of kind end says so. With
    ttl_ms entries leave the state that no event has touched for so long; as such entries must be looked for even when
    nothing arrives, this is for streams that run on, not for runs over what is available.
    """

    def __init__(self, idle_ms: int | None = None, ttl_ms: int | None = None):
        if idle_ms and ttl_ms:
            raise ValueError("state ends by event time or by processing time, not by both")
        self.idle_ms, self.ttl_ms = idle_ms, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "event_id long", self.ttl_ms)
        self.states = self.declare(handle)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # what one trigger brings for a session; triggers are bounded by files
        events = pd.concat(list(rows)).sort_values("event_id", kind="stable")
        last = self.last.get()[0] if self.last.exists() else None
        held, changes = [Held(*s) for s in self.states], Changes()
        for event in events.itertuples(index=False):
            if last is None or event.event_id > last:
                self.apply(event, changes, *held)
                last = int(event.event_id)
        for h in held:
            h.flush()
        self.last.update((last,))
        if self.idle_ms:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(max(int(events["ts"].max().timestamp() * 1000), timerValues.getCurrentWatermarkInMs()) + self.idle_ms)
        yield changes.frame(key[0])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        changes = Changes()
        changes.add(self.last.get()[0], "end", None, False)
        for state, _, _ in self.states:
            state.clear()
        yield changes.frame(key[0])

    def close(self) -> None:
        pass


class Toggles(Session):
    """How often each key was toggled since the session's last reset. Events: action, key."""

    def declare(self, handle):
        return [(handle.getMapState("counts", "key string", "n long", self.ttl_ms), lambda n: (n,), lambda r: r[0])]

    def apply(self, event, changes, counts) -> None:
        if event.action == "reset":
            counts.clear()
            changes.reset(event.event_id)
        else:
            n = (counts.get(event.key) or 0) + 1
            counts.put(event.key, n)
            changes.add(event.event_id, "key", event.key, n % 2 == 1, float(n))


class Selection(Session):
    """Selected ids and weighed items. Events: action (toggle or clear), ids, item, weight.

    A toggle takes its ids out, and those its item came with, if the item is selected or all ids are; else it puts
    ids and item in. A toggle without ids changes nothing.
    """

    def declare(self, handle):
        ids = handle.getMapState("ids", "id long", "on boolean", self.ttl_ms)
        items = handle.getMapState("items", "item string", "weight double, ids array<long>", self.ttl_ms)
        return [(ids, lambda v: (True,), lambda r: True), (items, lambda v: (v[0], v[1]), lambda r: (r[0], list(r[1])))]

    def apply(self, event, changes, ids, items) -> None:
        if event.action == "clear":
            ids.clear()
            items.clear()
            changes.reset(event.event_id)
            return
        raw = sorted({int(i) for i in event.ids if i is not None}) if event.ids is not None else []
        if not raw:
            return
        item = event.item if isinstance(event.item, str) else None
        old = items.get(item) if item is not None else None
        if old or all(ids.get(i) for i in raw):
            for i in {*raw, *(old[1] if old else ())}:
                ids.put(i, None)
                changes.add(event.event_id, "id", i, False)
            if item is not None:
                items.put(item, None)
                changes.add(event.event_id, "item", item, False)
        else:
            for i in raw:
                ids.put(i, True)
                changes.add(event.event_id, "id", i, True)
            if item is not None:
                weight = None if pd.isna(event.weight) else float(event.weight)
                items.put(item, (weight, raw))
                changes.add(event.event_id, "item", item, True, weight)


class Reveal(Session):
    """The tab in focus and the parts it reveals. Events: action (tab, exit or group), tab, ids.

    A tab in focus starts with nothing revealed; a group whose parts are all revealed is hidden again, any other is
    revealed; without a tab, and for an empty group, nothing changes.
    """

    def declare(self, handle):
        parts = handle.getMapState("parts", "id long", "on boolean", self.ttl_ms)
        tab = handle.getMapState("tab", "k string", "tab string", self.ttl_ms)
        return [(parts, lambda v: (True,), lambda r: True), (tab, lambda v: (v,), lambda r: r[0])]

    def apply(self, event, changes, parts, tab) -> None:
        if event.action in ("tab", "exit"):
            parts.clear()
            changes.reset(event.event_id)
            tab.put("tab", event.tab if event.action == "tab" else None)
            if event.action == "tab":
                changes.add(event.event_id, "tab", event.tab, True)
            return
        group = sorted({int(i) for i in event.ids}) if event.ids is not None else []
        if tab.get("tab") is None or not group:
            return
        on = not all(parts.get(i) for i in group)
        for i in group:
            parts.put(i, True if on else None)
            changes.add(event.event_id, "part", i, on)


def changes_of(events: DataFrame, processor: Session) -> DataFrame:
    """The changes of a stream of events; events need session and event_id, and ts with a watermark for idle_ms."""
    mode = "EventTime" if processor.idle_ms else "ProcessingTime" if processor.ttl_ms else "None"
    return events.groupBy("session").transformWithStateInPandas(processor, CHANGES, "append", mode)


def latest(changes: DataFrame) -> DataFrame:
    """What holds after all changes: (session, kind, key, value) of the keys whose last change is on."""
    at = lambda kind: F.coalesce(F.max(F.when(F.col("kind") == kind, F.col("event_id"))), F.lit(-(1 << 63)))
    over = changes.where("kind IN ('reset', 'end')").groupBy("session").agg(at("reset").alias("reset_id"), at("end").alias("end_id"))
    # a reset's own event can bring rows too, such as the tab that takes the focus; an end follows its event
    rows = changes.where("kind NOT IN ('reset', 'end')").join(over, "session", "left").where("reset_id IS NULL OR (event_id >= reset_id AND event_id > end_id)")
    last = rows.groupBy("session", "kind", "key").agg(F.max_by(F.struct("value", "on"), "event_id").alias("l"))
    return last.where("l.on").select("session", "kind", "key", "l.value")


# --- the same as batch folds


def _folded(events: DataFrame, fields: list[str], start: Column, step) -> DataFrame:
    """One fold over each session's events in order; the events of a session are one array."""
    ordered = events.groupBy("session").agg(F.sort_array(F.collect_list(F.struct("event_id", *fields))).alias("events"))
    return ordered.select("session", F.aggregate("events", start, step).alias("s"))


def revealed(events: DataFrame) -> DataFrame:
    """Batch fold of Reveal: (session, tab, parts)."""
    start = F.struct(F.lit(None).cast("string").alias("tab"), F.array().cast("array<long>").alias("parts"))
    none = F.array().cast("array<long>")

    def step(s: Column, e: Column) -> Column:
        ids = F.array_distinct(F.coalesce(e["ids"], none))
        off = F.size(F.array_except(ids, s["parts"])) == 0
        parts = F.when(e["action"] != "group", none).when(s["tab"].isNull() | (F.size(ids) == 0), s["parts"]).when(off, F.array_except(s["parts"], ids)).otherwise(F.array_union(s["parts"], ids))
        tab = F.when(e["action"] == "group", s["tab"]).when(e["action"] == "tab", e["tab"])
        return F.struct(tab.alias("tab"), parts.alias("parts"))

    return _folded(events, ["action", "tab", "ids"], start, step).select("session", "s.tab", F.array_sort("s.parts").alias("parts"))
