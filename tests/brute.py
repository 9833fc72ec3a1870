"""The stateful rules, row by row in plain Python, to check the Spark operators against."""

import random

MIN = 60_000


def skewed_rows(n=360, seed=1, values=("ON", "OFF", None)):
    """(id, k, v, ts): key `hot` holds half of the rows; some rows share a time."""
    rng, rows, ts = random.Random(seed), [], 0
    for i in range(n):
        ts += rng.choice([0, 1, 20, MIN, 2 * MIN])
        key = "hot" if rng.random() < 0.5 else rng.choice(["a", "b", None])
        rows.append((i, key, rng.choice(values), ts))
    return rows


def by_key(rows):
    keys = {}
    for row in sorted(rows, key=lambda r: (r[3], r[0])):
        keys.setdefault(row[1], []).append(row)
    return keys.values()


def on_change(rows, ttl=None, refresh="on_emit", clock_by=None):
    out = set()
    for group in by_key(rows) if clock_by is None else arrival(rows):
        stored, deadline, clock = None, None, None
        for i, _, v, ts in group:
            clock = ts if clock is None else max(clock, ts)
            live = stored if deadline is None or clock < deadline else None
            changed = live != v
            if changed:
                out.add(i)
            if changed or refresh == "on_seen":
                stored, deadline = v, None if ttl is None else ts + ttl
    return out


def arrival(rows):
    keys = {}
    for row in rows:
        keys.setdefault(row[1], []).append(row)
    return keys.values()


def once(rows, ttl):
    out = set()
    for group in by_key(rows):
        deadline = None
        for i, _, _, ts in group:
            if deadline is None or ts >= deadline:
                out.add(i)
                deadline = ts + ttl
    return out


def counts(rows, ttl=None):
    out = {}
    for group in by_key(rows):
        count, deadline = 0, None
        for i, _, _, ts in group:
            count = 1 if deadline is not None and ts >= deadline else count + 1
            deadline = None if ttl is None else ts + ttl
            out[i] = count
    return out
