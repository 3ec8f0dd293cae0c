"""A point-at-a-time interpreter of the engine's rules, to test its lowering against."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Point:
    src: str
    ts: int
    ord: int
    key: int
    value: int
    fan: int  # outputs of the probe


@dataclass(frozen=True)
class Update:
    src: str
    offset: int
    fan: str  # column of the number of updates: "value" % 3


def run(points: list[Point], probe: str, update: str, offset: int, width: int) -> list[tuple]:
    """(ord, out, key, pre, post, label, window_pre, window_post) of each output of a probe, where the
    state is the sum and the latest of the update source's values; a point updates value % 3 times."""
    stream = [(p.ts, 0, p.src, p.ord, p) for p in points] + [(p.ts - offset, -offset, p.src, p.ord, p) for p in points if p.src == update and offset]
    stream.sort(key=lambda x: x[:4])
    sums: dict[tuple, int] = {}
    latest: dict[tuple, int] = {}
    windows: dict[tuple, list] = {}
    out = []

    def read(which: str, key: int) -> tuple:
        w = windows.get((which, key), [])
        return sums.get((which, key), 0), latest.get((which, key)), sum(v for _, v in w)

    for _, near, _, _, p in stream:
        ahead = near != 0
        which = "ahead" if ahead else "now"
        before = read(which, p.key)
        if p.src == update:
            for i in range(p.value % 3):
                v = p.value + i
                sums[which, p.key] = sums.get((which, p.key), 0) + v
                latest[which, p.key] = v
                w = [*windows.get((which, p.key), []), (p.ts, v)]
                newest = max(t for t, _ in w)
                windows[which, p.key] = [(t, x) for t, x in w if t >= newest - width]
        after = read(which, p.key)
        if not ahead and p.src == probe:
            label = read("ahead" if offset else "now", p.key)
            for i in range(p.fan):
                out.append((p.ord, i, p.key, before[0], before[1], after[0], after[1], label[0], label[1], before[2], after[2]))
    return out
