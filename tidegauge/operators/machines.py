"""Per-key state machines, and the Arrow-batch functions that run them inside Spark tasks.

Only numpy and pyarrow are needed here. The module is pickled by value, so
executors need not have the package installed.
"""

from __future__ import annotations

import pickle
import sys
from bisect import bisect_left
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

NEVER = 2**62


class Machine:
    """A per-key state of a few integers; ``step`` moves it over one event, ``run`` over many.

    In a ``chain`` machine the state changes only when an event fires: the first event at
    or after ``due(state)``.
    """

    outputs: list[tuple[str, str]] = []
    chain = False

    def start(self) -> list[int]:
        return []

    def step(self, state: list[int], t: int, ok: bool) -> tuple:
        raise NotImplementedError

    def due(self, state: list[int]) -> int:
        raise NotImplementedError

    def fire(self, state: list[int], t: int) -> None:
        raise NotImplementedError

    def fires(self, state: list[int], t: np.ndarray) -> np.ndarray:
        """Places of the events that fire, found by jumping from one to the next; moves the state."""
        found, i = [], 0
        while i < len(t):
            i = max(i, int(np.searchsorted(t, self.due(state))))
            if i < len(t):
                self.fire(state, int(t[i]))
                found.append(i)
                i += 1
        return np.array(found, dtype=np.int64)

    def run(self, state: list[int], t: np.ndarray, ok: np.ndarray) -> list[np.ndarray]:
        """The outputs of all events, column by column; moves the state as ``step`` would.

        Machines override it to jump from change to change and fill in the rest.
        """
        rows = [self.step(state, x, o) for x, o in zip(t.tolist(), ok.tolist())]
        return [np.array(c) for c in zip(*rows)] if rows else [np.zeros(0)] * len(self.outputs)

    def trimmed(self, state: list[int], now: int) -> list[int]:
        """The state without what can make no difference from ``now`` on."""
        return state

    def size(self) -> int:
        """Numbers in a state, at most."""
        return max(1, len(self.start()))


class Exits(NamedTuple):
    """Where an event may be the first to change the state of one class: its time, the state at the end.

    Events are listed from the first of the chunk on. ``full``: one of them does, whatever
    the state; else they are all events of the chunk, and it may be none.
    """

    at: np.ndarray
    states: np.ndarray
    full: bool


class Table(NamedTuple):
    """What a chunk of ``n`` events does to any state; ``exits`` by class of state."""

    n: int
    exits: dict[int, Exits]


def _followed(to: np.ndarray, *sums: np.ndarray) -> list[np.ndarray]:
    """Follow pointers to their ends by doubling; ``sums`` are added up on the way. Ends point to themselves."""
    out = [to, *sums]
    while True:
        after = out[0][out[0]]
        if (after == out[0]).all():
            return out
        out = [after, *(x + x[out[0]] for x in out[1:])]


class Tabled(Machine):
    """A machine whose chunks can be put together: what follows a change depends on its place alone.

    From every place where the state may first change, the next changes are followed to the
    end of the chunk by doubling pointers. A chunk is then a short table of exit states, by
    the place of the first change; two chunks that follow each other are one table, in which
    the exits of the first have entered the second. Columns after ``width`` are marks that
    only tables need.
    """

    width = 1

    def columns(self, state: list[int]) -> np.ndarray:
        """One state as a row."""
        return np.array([state], dtype=np.int64)

    def exits(self, t: np.ndarray, ok: np.ndarray) -> dict[int, Exits]:
        raise NotImplementedError

    def classes(self, states: np.ndarray) -> np.ndarray:
        return np.zeros(len(states), dtype=np.int64)

    def place(self, kind: int, states: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The first event, of those listed, that changes each state; their number if it is none."""
        raise NotImplementedError

    def reached(self, states: np.ndarray, exits: np.ndarray) -> np.ndarray:
        return exits

    def unchanged(self, states: np.ndarray, table: Table) -> np.ndarray:
        """States after a chunk none of whose events changes them."""
        return states

    def table(self, t: np.ndarray, ok: np.ndarray) -> Table:
        return Table(len(t), self.exits(t, ok))

    def enter(self, table: Table, states: np.ndarray) -> np.ndarray:
        """States after a chunk, from those before it."""
        out, kinds = self.unchanged(states, table).copy(), self.classes(states)
        for kind, (at, exits, full) in table.exits.items():
            own = np.flatnonzero(kinds == kind)
            if not len(own):
                continue
            place = self.place(kind, states[own], at)
            place = np.minimum(place, len(at) - 1) if full else place
            hit = place < len(at)
            out[own[hit]] = self.reached(states[own[hit]], exits[place[hit]])
        return out

    def joined(self, a: Table, b: Table) -> Table:
        """One table for a chunk and the one after it."""
        exits = {}
        for kind, (at, states, full) in a.exits.items():
            states = self.enter(b, states)
            if not full:
                at = np.concatenate([at, b.exits[kind].at])
                states = np.concatenate([states, self.shifted(kind, b.exits[kind].states, a)])
                full = b.exits[kind].full
            exits[kind] = Exits(at, states, full)
        return Table(a.n + b.n, exits)

    def shifted(self, kind: int, states: np.ndarray, before: Table) -> np.ndarray:
        """Exits of the second chunk for states that the first did not change."""
        return states


def _until(t: np.ndarray, limit: int) -> tuple[int, bool]:
    """How many events to list if the first at or after ``limit`` changes the state at the latest."""
    k = int(np.searchsorted(t, limit))
    return (k + 1, True) if k < len(t) else (len(t), False)


def _flags(n: int, places: np.ndarray) -> np.ndarray:
    out = np.zeros(n, dtype=bool)
    out[places] = True
    return out


def _so_far(places: np.ndarray, n: int) -> np.ndarray:
    """How many of the places come up to and with each event."""
    return np.searchsorted(places, np.arange(n), side="right")


class Cooldown(Tabled):
    """Fire when the last fired event is at least ``cooldown`` ago; only fired events count."""

    outputs = [("fired", "boolean"), ("last_fired_us", "bigint")]
    chain = True

    def __init__(self, cooldown_us: int) -> None:
        self.cooldown = cooldown_us

    def start(self) -> list[int]:
        return [-NEVER]

    def due(self, state):
        return state[0] + self.cooldown

    def fire(self, state, t):
        state[:] = [t]

    def step(self, state, t, ok):
        fired = t >= self.due(state)
        if fired:
            self.fire(state, t)
        return fired, state[0]

    def run(self, state, t, ok):
        before = state[:1]
        hit = self.fires(state, t)
        times = np.concatenate([np.array(before, dtype=np.int64), t[hit]])
        return [_flags(len(t), hit), times[_so_far(hit, len(t))] if len(t) else t]

    def exits(self, t, ok):
        n, here = len(t), np.arange(len(t))
        after = np.maximum(np.searchsorted(t, t + self.cooldown), here + 1)
        last, = _followed(np.where(after < n, after, here))
        k, full = _until(t, int(t[0]) + self.cooldown)
        return {0: Exits(t[:k], t[last[:k], None], full)}

    def place(self, kind, states, at):
        return np.searchsorted(at, states[:, 0] + self.cooldown)


class Quota(Machine):
    """At most ``limit`` allowed events in ``[t - window, t]``; blocked events do not count."""

    outputs = [("allowed", "boolean"), ("current_count", "bigint")]
    chain = True

    def __init__(self, limit: int, window_us: int) -> None:
        self.limit, self.window = limit, window_us

    def due(self, state):
        return state[-self.limit] + self.window + 1 if len(state) >= self.limit else -NEVER

    def fire(self, state, t):
        state.append(t)
        del state[: -self.limit]

    def step(self, state, t, ok):
        while state and state[0] < t - self.window:
            del state[0]
        allowed = len(state) < self.limit
        if allowed:
            state.append(t)
        return allowed, len(state)

    def run(self, state, t, ok):
        before = np.array(state, dtype=np.int64)
        hit = self.fires(state, t)
        times = np.concatenate([before, t[hit]])
        old = np.searchsorted(times, t - self.window)
        return [_flags(len(t), hit), np.maximum(len(before) + _so_far(hit, len(t)) - old, 0)]

    def trimmed(self, state, now):
        return [x for x in state if x >= now - self.window]

    def size(self):
        return self.limit


class Backoff(Tabled):
    """Attempts with growing delays; after ``max_attempts`` nothing is due any more."""

    outputs = [("due", "boolean"), ("attempts", "bigint")]
    chain = True

    def __init__(self, base: float, multiplier: float, max_delay: float, max_attempts: int) -> None:
        self.delay = [
            int(round(min(base * multiplier**n, max_delay) * 1_000_000)) for n in range(max_attempts + 1)
        ]
        self.max_attempts = max_attempts

    def start(self) -> list[int]:
        return [0, 0]

    def due(self, state):
        n, last = state
        if n >= self.max_attempts:
            return NEVER
        return last + self.delay[n] if n else -NEVER

    def fire(self, state, t):
        state[:] = [state[0] + 1, t]

    def run(self, state, t, ok):
        made = state[0]
        hit = self.fires(state, t)
        return [_flags(len(t), hit), made + _so_far(hit, len(t))]

    def step(self, state, t, ok):
        due = t >= self.due(state)
        if due:
            self.fire(state, t)
        return due, state[0]

    width = 2

    def exits(self, t, ok):
        n, out = len(t), {}
        # The state at the end after attempt number ``made`` at each event, from the last number down.
        end = np.stack([np.full(n, self.max_attempts), t], axis=1)
        for made in range(self.max_attempts - 1, -1, -1):
            k, full = _until(t, int(t[0]) + self.delay[made]) if made else (1, True)
            out[made] = Exits(t[:k], end[:k], full)
            after = np.maximum(np.searchsorted(t, t + self.delay[made]), np.arange(n) + 1)
            stay = np.stack([np.full(n, made), t], axis=1)
            end = np.where((after < n)[:, None], end[np.minimum(after, n - 1)], stay)
        return out

    def classes(self, states):
        return states[:, 0]

    def place(self, kind, states, at):
        return np.searchsorted(at, states[:, 1] + self.delay[kind]) if kind else np.zeros(len(states), np.int64)


class Breaker(Tabled):
    """Circuit breaker over outcomes; outcomes of blocked requests are not recorded.

    State: failures, opened_at (-1 while not open).
    """

    outputs = [("state", "string"), ("allowed", "boolean"), ("failures", "bigint")]

    def __init__(self, threshold: int, timeout_us: int) -> None:
        self.threshold, self.timeout = threshold, timeout_us

    def start(self) -> list[int]:
        return [0, -1]

    def step(self, state, t, ok):
        failures, opened = state
        if opened < 0:
            name = "closed"
        elif t - opened >= self.timeout:
            name = "half_open"
        else:
            return "open", False, failures
        if ok:
            state[:] = [0, -1]
        elif failures + 1 >= self.threshold:
            state[:] = [failures + 1, t]
        else:
            state[:] = [failures + 1, -1]
        return name, True, state[0]

    def run(self, state, t, ok):
        n = len(t)
        at = np.arange(n)
        name = np.full(n, "open", dtype=object)
        allowed, failures = np.zeros(n, dtype=bool), np.zeros(n, dtype=np.int64)
        streak = at - np.maximum.accumulate(np.where(ok, at, -1))
        if n and state[1] < 0:
            # The first run of failures goes on from the state's own count.
            streak[: int(np.argmax(ok)) if ok.any() else n] += state[0]
        trips = np.flatnonzero(streak >= self.threshold)
        i = 0
        while i < n:
            if state[1] < 0:
                k = int(np.searchsorted(trips, i))
                j = int(trips[k]) if k < len(trips) else n - 1
                name[i : j + 1], allowed[i : j + 1], failures[i : j + 1] = "closed", True, streak[i : j + 1]
                state[:] = [int(streak[j]), int(t[j]) if k < len(trips) else -1]
                i = j + 1
            else:
                j = max(i, int(np.searchsorted(t, state[1] + self.timeout)))
                failures[i:j] = state[0]
                if j < n:
                    name[j], allowed[j], failures[j] = self.step(state, int(t[j]), bool(ok[j]))
                i = j + 1
        return [name, allowed, failures]

    width = 2

    # In tables a third column marks failures that are to be added to those at the first change.

    def columns(self, state):
        return np.array([[*state, 0]], dtype=np.int64)

    def exits(self, t, ok):
        n = len(t)
        at = np.arange(n)
        last_ok = np.maximum.accumulate(np.where(ok, at, -1))
        streak = at - last_ok
        # Nodes: the breaker opened at event i; n + i: it closed at event i. A step adds the failures that it
        # records; ``fresh`` counts the steps that set them instead, after which only what follows counts.
        after = np.searchsorted(t, t + self.timeout)
        retry = np.minimum(after, n - 1)
        opened_to = np.where(after < n, np.where(ok[retry], n + retry, retry), at)
        trips = np.flatnonzero((streak >= self.threshold) & (last_ok >= 0))
        k = np.searchsorted(trips, at, side="right")
        trip = np.append(trips, n)[k]
        closed_to = np.where(trip < n, trip, n + at)
        to = np.concatenate([opened_to, closed_to])
        fresh = np.concatenate([(after < n) & ok[retry], trip < n]).astype(np.int64)
        # Counted back from the end: failures since the last step that set them.
        value = np.concatenate([((after < n) & ~ok[retry]), np.where(trip < n, self.threshold, 0)]).astype(np.int64)
        while True:
            onward = to[to]
            if (onward == to).all():
                break
            value = np.where(fresh[to] > 0, value[to], value + value[to])
            fresh, to = fresh + fresh[to], onward

        def end(start: np.ndarray, failures: np.ndarray, added: np.ndarray) -> np.ndarray:
            last, reset = to[start], fresh[start] > 0
            count = np.where(reset, value[start], failures + value[start])
            is_open = last < n
            return np.stack([
                np.where(is_open, count, streak[n - 1]), np.where(is_open, t[np.minimum(last, n - 1)], -1),
                np.where(is_open & ~reset, added, 0),
            ], axis=1)

        lead = int(np.argmax(ok)) if ok.any() else n
        k = min(lead, self.threshold)
        closed, full = end(at[:k], np.full(k, self.threshold), np.zeros(k, np.int64)), k == self.threshold
        if not full and lead < n:
            zero = np.zeros(1, np.int64)
            closed, full = np.concatenate([closed, end(np.array([n + lead]), zero, zero)]), True
        m, half = _until(t, int(t[0]) + self.timeout)
        own_ok = ok[:m].astype(np.int64)
        opened = end(at[:m] + n * own_ok, 1 - own_ok, 1 - own_ok)
        return {0: Exits(t[: len(closed)], closed, full), 1: Exits(t[:m], opened, half)}

    def classes(self, states):
        return (states[:, 1] >= 0).astype(np.int64)

    def place(self, kind, states, at):
        if kind:
            return np.searchsorted(at, states[:, 1] + self.timeout)
        return np.maximum(self.threshold - states[:, 0], 1) - 1

    def reached(self, states, exits):
        out = exits.copy()
        added = exits[:, 2] == 1
        out[added, 0] += states[added, 0]
        out[added, 2] = states[added, 2]
        return out

    def unchanged(self, states, table):
        out = states.copy()
        out[states[:, 1] < 0, 0] += table.n
        return out


class Batch(Tabled):
    """Close the open batch at ``max_size`` events, or at the first event ``max_age`` after its start.

    State: batch number, events in it, its first time.
    """

    outputs = [("batch_no", "bigint"), ("closes", "boolean")]

    def __init__(self, max_size: int, max_age_us: int) -> None:
        self.max_size, self.max_age = max_size, max_age_us

    def start(self) -> list[int]:
        return [0, 0, 0]

    def step(self, state, t, ok):
        number, size, first = state
        if size == 0:
            first = t
        size += 1
        closes = size >= self.max_size or t - first >= self.max_age
        state[:] = [number + 1, 0, 0] if closes else [number, size, first]
        return number, closes

    width = 3

    def exits(self, t, ok):
        n = len(t)
        ends = np.minimum(np.arange(n) + self.max_size - 1, np.searchsorted(t, t + self.max_age))
        # From the first event of a batch to that of the next; n is the end of the chunk.
        to = np.append(np.where(ends < n, ends + 1, np.arange(n)), n)
        last, closed = _followed(to, np.append(ends < n, False).astype(np.int64))
        k, full = _until(t, int(t[0]) + self.max_age)
        k, full = (self.max_size, True) if self.max_size <= k else (k, full)
        first = np.arange(k) + 1
        rest = last[first]
        states = np.stack([1 + closed[first], n - rest, np.where(rest < n, t[np.minimum(rest, n - 1)], 0)], axis=1)
        return {0: Exits(t[:k], states, full)}

    def place(self, kind, states, at):
        size = states[:, 1]
        first = np.where(size > 0, states[:, 2], at[0])
        return np.minimum(self.max_size - size - 1, np.searchsorted(at, first + self.max_age))

    def reached(self, states, exits):
        out = exits.copy()
        out[:, 0] += states[:, 0]
        return out

    def unchanged(self, states, table):
        out = states.copy()
        out[:, 2] = np.where(states[:, 1] > 0, states[:, 2], table.exits[0].at[0])
        out[:, 1] += table.n
        return out

    def run(self, state, t, ok):
        number = state[0]
        found = self.closers(state, t)
        return [number + np.searchsorted(found, np.arange(len(t))), _flags(len(t), found)]

    def closers(self, state: list[int], t: np.ndarray) -> np.ndarray:
        """Places of the events that close a batch; moves the state."""
        if not len(t):
            return np.zeros(0, dtype=np.int64)
        number, size, first = state
        found: list[int] = []
        ends = np.minimum(
            np.arange(len(t)) + self.max_size - 1, np.searchsorted(t, t + self.max_age)
        ).tolist()
        i = 0
        if size and len(t):
            close = min(self.max_size - size - 1, int(np.searchsorted(t, first + self.max_age)))
            if close >= len(t):
                state[:] = [number, size + len(t), first]
                return np.zeros(0, dtype=np.int64)
            found.append(close)
            i = close + 1
        while i < len(t) and ends[i] < len(t):
            found.append(ends[i])
            i = ends[i] + 1
        number += len(found)
        state[:] = [number, len(t) - i, int(t[i])] if i < len(t) else [number, 0, 0]
        return np.array(found, dtype=np.int64)


class Compact(Tabled):
    """Keep an entry unless it and the previously kept one are passes within the window.

    State: time of the last kept entry and whether it passed.
    """

    outputs = [("keep", "boolean")]
    width = 2

    def __init__(self, window_us: int) -> None:
        self.window = window_us

    def start(self) -> list[int]:
        return [-NEVER, 0]

    def step(self, state, t, ok):
        if ok and state[1] and t - state[0] <= self.window:
            return (False,)
        state[:] = [t, int(ok)]
        return (True,)

    def exits(self, t, ok):
        n, here = len(t), np.arange(len(t))
        bad = np.append(np.flatnonzero(~ok), n)
        far = np.searchsorted(t, t + self.window, side="right")
        after = np.where(ok, np.minimum(far, bad[np.searchsorted(bad, here, side="right").clip(max=len(bad) - 1)]), here + 1)
        last, = _followed(np.where(after < n, after, here))
        k, full = _until(t, int(t[0]) + self.window + 1)
        if bad[0] < k:
            k, full = int(bad[0]) + 1, True
        return {0: Exits(t[:k], np.stack([t[last[:k]], ok[last[:k]].astype(np.int64)], axis=1), full)}

    def place(self, kind, states, at):
        return np.where(states[:, 1] > 0, np.searchsorted(at, states[:, 0] + self.window, side="right"), 0)

    def run(self, state, t, ok):
        return [_flags(len(t), self.kept(state, t, ok))]

    def kept(self, state: list[int], t: np.ndarray, ok: np.ndarray) -> np.ndarray:
        """Places of the entries that are kept; moves the state."""
        bad, found = np.flatnonzero(~ok).tolist(), []
        i = 0
        while i < len(t):
            if state[1]:
                far = int(np.searchsorted(t, state[0] + self.window, side="right"))
                k = bisect_left(bad, i)
                i = max(i, min(far, bad[k] if k < len(bad) else len(t)))
                if i >= len(t):
                    break
            state[:] = [int(t[i]), int(ok[i])]
            found.append(i)
            i += 1
        return np.array(found, dtype=np.int64)


def _changes(batch: pa.RecordBatch, columns: Sequence[str], last: list | None) -> tuple[np.ndarray, list]:
    """Flags of the rows that begin a new key, and the key of the last row."""
    n = batch.num_rows
    new = np.zeros(n, dtype=bool)
    end = []
    for i, name in enumerate(columns):
        c = batch.column(name)
        a, b = c.slice(0, n - 1), c.slice(1)
        same = pc.or_kleene(pc.equal(a, b), pc.and_(pc.is_null(a), pc.is_null(b)))
        new[1:] |= ~same.fill_null(False).to_numpy(zero_copy_only=False)
        end.append(c[n - 1].as_py())
        if last is None or c[0].as_py() != last[i]:
            new[0] = True
    return new, end


def _pack(state: list[int]) -> bytes:
    return np.array(state, dtype=np.int64).tobytes()


def _unpack(raw: bytes) -> list[int]:
    return np.frombuffer(raw, dtype=np.int64).tolist()


_ARROW = {"boolean": pa.bool_(), "bigint": pa.int64(), "string": pa.string()}


def runner(machine: Machine, keys: Sequence[str]):
    """The Arrow-batch fold; columns pass through untouched, results are appended.

    Rows without a time move no state, and their results are null.
    """
    fields = [pa.field(n, _ARROW[t]) for n, t in machine.outputs]
    empty = {"boolean": (bool, False), "bigint": (np.int64, 0), "string": (object, None)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            new, last = _changes(batch, keys, last)
            entry = batch.column("_entry") if "_entry" in batch.schema.names else None
            timed = batch.column("_t").is_valid().to_numpy(zero_copy_only=False)
            t = pc.fill_null(batch.column("_t"), 0).to_numpy(zero_copy_only=False)
            ok = pc.fill_null(batch.column("_ok"), False).to_numpy(zero_copy_only=False).astype(bool)
            out = [np.full(batch.num_rows, fill, dtype) for dtype, fill in (empty[kind] for _, kind in machine.outputs)]
            cuts = sorted({0, *np.flatnonzero(new).tolist(), batch.num_rows})
            for a, b in zip(cuts, cuts[1:]):
                if new[a]:
                    given = None if entry is None else entry[a].as_py()
                    state = machine.start() if given is None else _unpack(given)
                live = a + np.flatnonzero(timed[a:b])
                for column, values in zip(out, machine.run(state, t[live], ok[live])):
                    column[live] = values
            arrays = [pa.array(v, type=f.type, mask=~timed) for v, f in zip(out, fields)]
            schema = pa.schema([*batch.schema, *fields])
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], schema=schema)

    return run


def _pieces(batches: Iterator[pa.RecordBatch], keys: Sequence[str]):
    """(first row of it, does it begin a new key, times, outcomes) of each run of one key in a batch; timed rows only."""
    last = None
    for batch in batches:
        batch = batch.filter(batch.column("_t").is_valid())
        if not batch.num_rows:
            continue
        new, last = _changes(batch, keys, last)
        cuts = sorted({0, *np.flatnonzero(new).tolist(), batch.num_rows})
        t = batch.column("_t").to_numpy(zero_copy_only=False)
        ok = batch.column("_ok").to_numpy(zero_copy_only=False).astype(bool)
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, 1), bool(new[a]), t[a:b], ok[a:b]


def _row(row: pa.RecordBatch, names: Sequence[str], **values: bytes) -> pa.RecordBatch:
    columns = [row.column(n) for n in names] + [pa.array([v], pa.binary()) for v in values.values()]
    return pa.RecordBatch.from_arrays(columns, names=[*names, *values])


def tables(machine: Tabled, keys: Sequence[str]):
    """The table of each chunk, put together from those of the Arrow batches that it comes in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, held = None, None
        for first, begins, t, ok in _pieces(batches, [*keys, "_chunk"]):
            own = machine.table(t, ok)
            if begins and row is not None:
                yield _row(row, [*keys, "_chunk"], _table=pack_table(held))
            row, held = (first, own) if begins else (row, machine.joined(held, own))
        if row is not None:
            yield _row(row, [*keys, "_chunk"], _table=pack_table(held))

    return run


def pack_table(table: Table) -> bytes:
    return pickle.dumps((table.n, {k: tuple(e) for k, e in table.exits.items()}))


def unpack_table(raw: bytes) -> Table:
    n, exits = pickle.loads(raw)
    return Table(n, {k: Exits(*e) for k, e in exits.items()})


def relay(machine: Tabled, keys: Sequence[str]):
    """The state at each chunk's start, from the tables of a key's chunks one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            new, last = _changes(batch, keys, last)
            entries = []
            for begins, table in zip(new, batch.column("_table")):
                state = machine.columns(machine.start()) if begins else state
                entries.append(_pack(state[0, : machine.width].tolist()))
                state = machine.enter(unpack_table(table.as_py()), state)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in [*keys, "_chunk"]), pa.array(entries, pa.binary())],
                names=[*keys, "_chunk", "_entry"],
            )

    return run


def joiner(machine: Tabled):
    """Rows of ``_before`` and ``_table``: the two as one table. What reaches the first chunk is a state."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            states, tables = [], []
            for state, before, table in zip(*(batch.column(n).to_pylist() for n in ("_before_state", "_before", "_table"))):
                own = unpack_table(table)
                if state is not None:
                    states.append(machine.enter(own, np.array([_unpack(state)])).tobytes())
                    tables.append(None)
                else:
                    states.append(None)
                    tables.append(table if before is None else pack_table(machine.joined(unpack_table(before), own)))
            others = [n for n in batch.schema.names if n not in ("_before_state", "_before", "_table", "_state")]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in others), pa.array(states, pa.binary()), pa.array(tables, pa.binary())],
                names=[*others, "_state", "_table"])

    return run


def chunk_exits(machine: Machine, keys: Sequence[str]):
    """The state at each chunk's end, from that in ``_entry`` (none: the start), trimmed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, state, now = None, None, None
        for first, begins, t, ok in _pieces(batches, [*keys, "_chunk"]):
            if begins:
                if row is not None:
                    yield _row(row, [*keys, "_chunk"], _exit=_pack(machine.trimmed(state, now)))
                given = first.column("_entry")[0].as_py()
                row, state = first, machine.start() if given is None else _unpack(given)
            machine.fires(state, t)
            now = int(t[-1])
        if row is not None:
            yield _row(row, [*keys, "_chunk"], _exit=_pack(machine.trimmed(state, now)))

    return run


cloudpickle.register_pickle_by_value(sys.modules[__name__])
