"""Runs, tables of chunks and tables put together must agree with stepping over every event."""

import random

import numpy as np
import pytest

from tidegauge.operators import machines as f

MACHINES = {
    "cooldown": lambda: f.Cooldown(30),
    "quota": lambda: f.Quota(3, 40),
    "quota_one": lambda: f.Quota(1, 10),
    "backoff": lambda: f.Backoff(5e-6, 2, 6e-5, 4),
    "breaker": lambda: f.Breaker(3, 25),
    "breaker_one": lambda: f.Breaker(1, 25),
    "batch": lambda: f.Batch(4, 35),
    "compact": lambda: f.Compact(20),
}


def series(rng, n, dense):
    t, out = 0, []
    for _ in range(n):
        t += rng.choice([0, 1, 2, 5]) if dense else rng.choice([1, 5, 20, 60])
        out.append(t)
    ok = [rng.random() < rng.choice([0.1, 0.5, 0.9]) for _ in range(n)]
    return np.array(out, dtype=np.int64), np.array(ok, dtype=bool)


def stepped(m, state, t, ok):
    state = list(state)
    for a, b in zip(t.tolist(), ok.tolist()):
        m.step(state, a, b)
    return state


@pytest.mark.parametrize("name", MACHINES)
@pytest.mark.parametrize("dense", [True, False])
def test_run_equals_step(name, dense):
    """Outputs filled in between changes are those of stepping, from any state."""
    rng = random.Random(3)
    m = MACHINES[name]()
    for _ in range(400):
        t, ok = series(rng, rng.randint(0, 60), dense)
        cut = rng.randint(0, len(t))
        state = stepped(m, m.start(), t[:cut], ok[:cut])
        other = list(state)
        want = [m.step(state, a, b) for a, b in zip(t[cut:].tolist(), ok[cut:].tolist())]
        got = m.run(other, t[cut:], ok[cut:])
        assert [tuple(r) for r in zip(*(c.tolist() for c in got))] == want, (t[:cut], t[cut:], ok)
        if len(t):
            assert alive(name, other, t[-1]) == alive(name, state, t[-1])


TABLED = [n for n, m in MACHINES.items() if isinstance(m(), f.Tabled)]


@pytest.mark.parametrize("name", TABLED)
@pytest.mark.parametrize("dense", [True, False])
def test_table_equals_step(name, dense):
    """A chunk's table sends every state before it to the state after it."""
    rng = random.Random(7)
    m = MACHINES[name]()
    for _ in range(400):
        t, ok = series(rng, rng.randint(1, 60), dense)
        cut = rng.randint(0, len(t) - 1)
        entry = stepped(m, m.start(), t[:cut], ok[:cut])
        want = stepped(m, entry, t[cut:], ok[cut:])
        got = m.enter(m.table(t[cut:], ok[cut:]), m.columns(entry))[0, : m.width].tolist()
        assert normal(name, got) == normal(name, want), (t[:cut], t[cut:], ok, entry)


@pytest.mark.parametrize("name", TABLED)
@pytest.mark.parametrize("dense", [True, False])
def test_joined_tables_equal_step(name, dense):
    """Any way of putting pieces together, pieces of one event included."""
    rng = random.Random(13)
    m = MACHINES[name]()
    for _ in range(300):
        t, ok = series(rng, rng.randint(3, 60), dense)
        ok = ok if rng.random() < 0.7 else np.full(len(t), rng.random() < 0.5)
        cuts = sorted({0, len(t), *(rng.randint(0, len(t)) for _ in range(rng.randint(1, 12)))})
        entry = stepped(m, m.start(), t[: cuts[1]], ok[: cuts[1]])
        parts = [m.table(t[a:b], ok[a:b]) for a, b in zip(cuts[1:], cuts[2:])]
        if not parts:
            continue
        while len(parts) > 1:
            k = rng.randrange(len(parts) - 1)
            parts[k : k + 2] = [f.unpack_table(f.pack_table(m.joined(*parts[k : k + 2])))]
        want = stepped(m, entry, t[cuts[1] :], ok[cuts[1] :])
        got = m.enter(parts[0], m.columns(entry))[0, : m.width].tolist()
        assert normal(name, got) == normal(name, want), (cuts, t, ok, entry)


@pytest.mark.parametrize("name", TABLED)
def test_tables_are_short(name):
    """A table has no more rows than events that may be the first to change a state."""
    t = np.arange(0, 20_000, 2, dtype=np.int64)
    ok = np.arange(len(t)) % 3 > 0
    m = MACHINES[name]()
    assert sum(len(e.at) for e in m.table(t, ok).exits.values()) < 120


def normal(name, state):
    """An empty batch has no first time."""
    return [state[0], 0, 0] if name == "batch" and state[1] == 0 else state


def alive(name, state, now):
    """Times that have left the window make no difference."""
    if name.startswith("quota"):
        window = 40 if name == "quota" else 10
        return [x for x in state if x >= now - window]
    return state
