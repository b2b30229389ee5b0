"""Window rules over streams with state in slots of time.

State of a key is a map from slot to the slot's events, an eighth of the window's width each,
a map from slot to the evidence of its events, and where the last window ended. A batch touches
only the slots its events fall in, each once per ``ADDED_ROWS`` rows. A slot's timer fires when the watermark has passed every window
that can start in it; it reads the slots those windows reach, finds the at most one window
that starts in the slot, and removes the slot. Slots that were read stay at hand for the next
timers of the batch, up to ``KEPT_EVENTS`` events. Nothing walks over all of a key's state.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ADDED_ROWS = 200_000  # rows of a key that are put into their slots at a time
KEPT_EVENTS = 500_000  # events of slots that a task keeps at hand
SLOTS = 8  # per window width: windows that start in one slot overlap, so it holds one start at most

FOUND_DDL = (
    "key string, anchor bigint, n bigint, n_distinct bigint, names array<string>, bits int, first_ts timestamp_ntz, "
    "last_ts timestamp_ntz, items array<string>"
)
_SLOT_DDL = "ts array<bigint>, uids array<string>, vals array<string>, bits array<int>"
_ITEMS_DDL = "items array<string>"  # in the order of the slot's events


def slot_length(width: int) -> int:
    """Microseconds of a slot; slots are shorter than windows, so that no two windows start in one."""
    return max(1, width // SLOTS)


def dense_start(ts: np.ndarray, starts: np.ndarray, width: int, minimum: int) -> int | None:
    """Place of the first of ``starts`` (places in sorted ``ts``) whose window holds ``minimum`` events."""
    inside = np.searchsorted(ts, ts[starts] + width, side="right") - starts
    good = starts[inside >= minimum]
    return int(good[0]) if len(good) else None


def stage_start(ts: np.ndarray, bits: np.ndarray, starts: np.ndarray, width: int, minimum: int) -> int | None:
    """Place of the first of ``starts`` whose window holds ``minimum`` distinct stages."""
    stages = np.zeros(len(starts), np.int64)
    ends = np.searchsorted(ts, ts[starts] + width, side="right")
    for k in range(int(bits.max()).bit_length() if len(bits) else 0):
        seen = np.concatenate([[0], np.cumsum(bits >> k & 1)])
        stages += seen[ends] > seen[starts]
    good = starts[stages >= minimum]
    return int(good[0]) if len(good) else None


class WindowProcessor(StatefulProcessor):
    """Dense windows of a key one after the other, or (``by_stages``) its first window with enough stages."""

    def __init__(self, width: int, minimum: int, names_shown: int, evidence_cap: int, by_stages: bool):
        self.width, self.minimum, self.names_shown, self.evidence_cap, self.by_stages = width, minimum, names_shown, evidence_cap, by_stages
        self.length = slot_length(width)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.slots = handle.getMapState("slots", "slot bigint", _SLOT_DDL)
        self.items = handle.getMapState("items", "slot bigint", _ITEMS_DDL)
        self.last = handle.getValueState("last_end", "end bigint, done boolean")
        self._forget()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        self._forget()
        watermark = timerValues.getCurrentWatermarkInMs() * 1000
        done = self.last.exists() and self.last.get()[1]
        held, n_held = [], 0
        for frame in rows:
            frame = frame[frame["t"] > watermark]
            if done or not len(frame):
                continue
            held.append(frame)
            n_held += len(frame)
            if n_held >= ADDED_ROWS:
                self._add_all(held)
                held, n_held = [], 0
        if held:
            self._add_all(held)
        return iter(())

    def _add_all(self, frames: list[pd.DataFrame]) -> None:
        frame = pd.concat(frames, ignore_index=True)
        for slot, part in frame.groupby(frame["t"] // self.length):
            self._add(int(slot), part)

    def _add(self, slot: int, part: pd.DataFrame) -> None:
        new = (part["t"].tolist(), part["event_uid"].tolist(), part["value"].tolist(), part["bits"].tolist())
        items = part["item"].tolist()
        if self.slots.containsKey((slot,)):
            new = tuple(list(old) + more for old, more in zip(self.slots.getValue((slot,)), new, strict=True))
            items = list(self.items.getValue((slot,))[0]) + items
        else:
            self.handle.registerTimer(((slot + 1) * self.length + self.width) // 1000 + 1)
        self.slots.updateValue((slot,), new)
        self.items.updateValue((slot,), (items,))

    def _forget(self) -> None:
        self.kept, self.n_kept = {}, 0

    def _slot(self, key: str, slot: int) -> tuple[np.ndarray, list[str], list[str], np.ndarray] | None:
        """Events of a slot in order of time and id, None if it has none."""
        if (key, slot) not in self.kept:
            if self.n_kept > KEPT_EVENTS:
                self._forget()
            found = None
            if self.slots.containsKey((slot,)):
                ts, uids, vals, bits = self.slots.getValue((slot,))
                order = sorted(range(len(ts)), key=lambda k: (ts[k], uids[k]))
                found = np.array(ts, np.int64)[order], [uids[k] for k in order], [vals[k] for k in order], np.array(bits, np.int64)[order]
            self.kept[key, slot] = found
            self.n_kept += 1 if found is None else 1 + len(found[1])
        return self.kept[key, slot]

    def _events(self, key: str, slots) -> tuple[np.ndarray, list[str], list[str], np.ndarray]:
        """Events of slots, which ascend, in order of time and id."""
        held = [found for s in slots if (found := self._slot(key, s)) is not None]
        ts, uids, vals, bits = zip(*held, strict=True)
        return np.concatenate(ts), [x for part in uids for x in part], [x for part in vals for x in part], np.concatenate(bits)

    def _evidence(self, ts: list[int], uids: list[str]) -> list[str]:
        """Evidence of events by time and id."""
        items = {}
        for slot in sorted({t // self.length for t in ts}):
            of_slot = self.slots.getValue((slot,))
            items |= zip(zip(of_slot[0], of_slot[1], strict=True), self.items.getValue((slot,))[0], strict=True)
        return [items[event] for event in zip(ts, uids, strict=True)]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        slot = (expiredTimerInfo.getExpiryTimeInMs() * 1000 - self.width) // self.length - 1
        # The timer's whole milliseconds may name a slot just behind the one it was set for.
        mine = [s for s in range(slot - 1 - 1000 // self.length, slot + 1) if self.slots.containsKey((s,))]
        mine = [s for s in mine if ((s + 1) * self.length + self.width) // 1000 + 1 == expiredTimerInfo.getExpiryTimeInMs()]
        out = [found for s in mine if (found := self._close(key[0], s)) is not None]
        if out:
            yield pd.DataFrame(out)

    def _close(self, key: str, slot: int) -> dict | None:
        """The window that starts in a slot, if there is one; the slot is removed."""
        end, done = self.last.get() if self.last.exists() else (None, False)
        found = None
        if not done:
            ts, uids, vals, bits = self._events(key, range(slot, slot + self.width // self.length + 2))
            open_ = np.flatnonzero((ts // self.length == slot) & (ts > end if end is not None else True))
            at = None
            if len(open_):
                _, first = np.unique(ts[open_], return_index=True)
                starts = open_[first]
                at = stage_start(ts, bits, starts, self.width, self.minimum) if self.by_stages else dense_start(ts, starts, self.width, self.minimum)
            if at is not None:
                stop = int(np.searchsorted(ts, ts[at] + self.width, side="right"))
                found = self._window(key, ts[at:stop], uids[at:stop], vals[at:stop], bits[at:stop])
                self.last.update((int(ts[at]) + self.width, self.by_stages))
        self.items.removeKey((slot,))
        self.slots.removeKey((slot,))
        dropped = self.kept.pop((key, slot), None)
        self.n_kept -= 0 if dropped is None else 1 + len(dropped[1])
        return found

    def _window(self, key: str, ts: np.ndarray, uids: list[str], vals: list[str], bits: np.ndarray) -> dict:
        names = sorted(set(vals))
        return {
            "key": key, "anchor": int(ts[0]), "n": len(ts), "n_distinct": len(names), "names": names[: self.names_shown],
            "bits": int(np.bitwise_or.reduce(bits)), "first_ts": pd.Timestamp(int(ts[0]), unit="us"), "last_ts": pd.Timestamp(int(ts[-1]), unit="us"),
            "items": self._evidence(ts[: self.evidence_cap].tolist(), uids[: self.evidence_cap]),
        }

    def close(self) -> None:
        pass


class HighWater(StatefulProcessor):
    """Rows of a shard with an id above the highest one of earlier batches, each id once."""

    def __init__(self, id_column: str):
        self.id_column = id_column

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.mark = handle.getValueState("mark", "id bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        before = self.mark.get()[0] if self.mark.exists() else None
        seen: set[int] = set()
        for frame in rows:
            ids = frame[self.id_column]
            fresh = ~ids.isin(seen) & ~ids.duplicated()
            if before is not None:
                fresh &= ids > before
            new = frame[fresh]
            seen.update(new[self.id_column].tolist())
            if len(new):
                yield new.drop(columns="shard")
        if seen:
            self.mark.update((max(seen) if before is None else max(before, *seen),))

    def close(self) -> None:
        pass
