"""Replay of edit logs: add, move, delete, undo, redo, clear, and batches of edits.

A slide's history is a list of undo steps and a position in it. A new edit overwrites
the step after the position and forgets later ones; undo and redo move the position and
apply one step backwards or forwards. A step lists (id, before, after) per annotation,
with None for absent. Edits in a row with the same batch id share a step; edits without
effect make none.

A history depends on all earlier edits of its slide, so one slide is replayed in
order; slides are independent. The table form streams sorted rows through each task, the
stream form keeps positions, annotations and steps in Spark's state store.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

RESULT = "slide_name string, ann_id string, x double, y double, can_undo boolean, can_redo boolean"
FIELDS = ["slide_name", "seq", "op", "ann_id", "x", "y", "batch"]


class History:
    """Annotations, steps and position of one slide, in memory."""

    def __init__(self) -> None:
        self.live: dict[str, tuple[float, float]] = {}
        self.steps: dict[int, list] = {}
        self.at, self.top, self.batch = 0, 0, None

    def put(self, ann_id: str, place: Any) -> None:
        if place is None:
            self.live.pop(ann_id, None)
        else:
            self.live[ann_id] = tuple(place)

    def clear(self) -> None:
        self.live.clear()
        self.steps.clear()

    def apply(self, op: str, ann_id: str | None, x: float, y: float, batch: str | None) -> None:
        """Take one edit into the history."""
        if op == "clear":
            self.clear()
            self.at = self.top = 0
        elif op == "undo" and self.at > 0:
            for who, before, _ in reversed(self.steps[self.at]):
                self.put(who, before)
            self.at -= 1
        elif op == "redo" and self.at < self.top:
            self.at += 1
            for who, _, after in self.steps[self.at]:
                self.put(who, after)
        elif op in ("add", "move", "delete"):
            before = self.live.get(ann_id)
            after = None if op == "delete" else (x, y)
            effect = op == "add" or (before is not None and before != after)
            if effect:
                self.put(ann_id, after)
                if batch is None or batch != self.batch:
                    self.at += 1
                    self.steps[self.at] = []
                self.steps[self.at] = [*self.steps[self.at], (ann_id, before, after)]
                self.top = self.at
            # A batch that has had no effect yet has no step to share.
            self.batch = batch if effect or batch == self.batch else None
            return
        self.batch = None

    def rows(self, slide: str) -> pd.DataFrame:
        """Current annotations, or one row without id, with the undo and redo flags."""
        found = [(slide, k, *v) for k, v in self.live.items()] or [(slide, None, None, None)]
        out = pd.DataFrame(found, columns=["slide_name", "ann_id", "x", "y"])
        return out.assign(can_undo=self.at > 0, can_redo=self.at < self.top)


def _edits(rows: pd.DataFrame) -> Iterator[tuple]:
    for r in rows.itertuples(index=False):
        yield r.op, r.ann_id, r.x, r.y, r.batch if isinstance(r.batch, str) else None


def _replay(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    slide, history = None, History()
    for rows in batches:
        for name, part in rows.groupby("slide_name", sort=False):
            if name != slide:
                if slide is not None:
                    yield history.rows(slide)
                slide, history = name, History()
            for edit in _edits(part):
                history.apply(*edit)
    if slide is not None:
        yield history.rows(slide)


def _log(log: DataFrame) -> DataFrame:
    return log if "batch" in log.columns else log.withColumn("batch", F.lit(None).cast("string"))


def replay_edits(log: DataFrame) -> DataFrame:
    """Final annotations and undo/redo flags per slide of a log table.

    ``log`` holds slide_name, seq, op, ann_id, x, y and optionally batch. Sorting by
    slide and sequence is Spark's, and spills; a task holds one slide's history.
    """
    sorted_log = _log(log).select(*FIELDS).repartition("slide_name").sortWithinPartitions("slide_name", "seq")
    return sorted_log.mapInPandas(_replay, RESULT)


class _StoredHistory(History):
    """The same history over Spark state: only what an edit touches is read."""

    def __init__(self, place: Any, live: Any, steps: Any) -> None:
        self._place, self._live, self._steps = place, live, steps
        self.live, self.steps = _Annotations(live), _Steps(steps)
        self.at, self.top, self.batch = place.get() if place.exists() else (0, 0, None)

    def put(self, ann_id: str, place: Any) -> None:
        if place is None:
            if self._live.containsKey((ann_id,)):
                self._live.removeKey((ann_id,))
        else:
            self._live.updateValue((ann_id,), tuple(place))

    def clear(self) -> None:
        self._live.clear()
        self._steps.clear()

    def save(self) -> None:
        self._place.update((self.at, self.top, self.batch))


class _Annotations:
    def __init__(self, state: Any) -> None:
        self.state = state

    def get(self, ann_id: str) -> tuple | None:
        return tuple(self.state.getValue((ann_id,))) if self.state.containsKey((ann_id,)) else None

    def items(self) -> Iterator[tuple]:
        for key, value in self.state.iterator():
            yield key[0], tuple(value)


class _Steps:
    def __init__(self, state: Any) -> None:
        self.state = state

    def __getitem__(self, level: int) -> list:
        return json.loads(self.state.getValue((level,))[0])

    def __setitem__(self, level: int, changes: list) -> None:
        self.state.updateValue((level,), (json.dumps(changes),))


class EditReplay(StatefulProcessor):
    """Keeps a slide's history in state and emits its annotations after each batch."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.place = handle.getValueState("place", "at int, top int, batch string")
        self.live = handle.getMapState("live", "id string", "x double, y double")
        self.steps = handle.getMapState("steps", "level int", "changes string")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        history = _StoredHistory(self.place, self.live, self.steps)
        for edit in _edits(pd.concat(list(rows)).sort_values("seq")):
            history.apply(*edit)
        history.save()
        yield history.rows(key[0])

    def close(self) -> None:
        pass


def replay_edits_stream(log: DataFrame) -> DataFrame:
    """Update-mode stream of a slide's annotations after each micro-batch with edits.

    Edits must arrive in sequence order across micro-batches; inside one they are
    sorted. Needs the RocksDB state store provider.
    """
    return (
        _log(log)
        .select(*FIELDS)
        .groupBy("slide_name")
        .transformWithStateInPandas(EditReplay(), outputStructType=RESULT, outputMode="Update", timeMode="None")
    )
