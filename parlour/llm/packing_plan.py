"""The packing plan of operator 9, made from counts of lengths alone (at most ``capacity`` numbers).

Linear grouping: large lengths, sorted, are cut into groups of equal cardinality and rounded up to their
group's largest length; sequences for these few sizes are found by exact subset sums (the largest size left,
filled as full as the others allow, as often as the counts permit); actual lengths are substituted for the
rounded ones; small lengths then go best-fit into the room that is left. The plan is a list of templates
(how many sequences, the lengths in them), so its size depends on the capacity, not on the documents."""

from __future__ import annotations

import heapq
from collections import defaultdict

import numpy as np

GROUPS = 256
SMALL = (0.15, 0.2, 0.25, 0.3)  # lengths up to this share of a sequence are small; the best plan of these holds


def groups_of(counts: dict[int, int], n_groups: int) -> list[list[list[int]]]:
    """Runs [length, count] of descending lengths, cut into ``n_groups`` groups of equal cardinality."""
    total = sum(counts.values())
    per = max(1, -(-total // n_groups))
    out: list[list[list[int]]] = []
    room = 0
    for length in sorted(counts, reverse=True):
        n = counts[length]
        while n:
            if not room:
                out.append([])
                room = per
            k = min(n, room)
            out[-1].append([length, k])
            n, room = n - k, room - k
    return out


def fullest(sizes: list[int], left: list[int], capacity: int) -> list[int]:
    """How many of each size fill ``capacity`` as far as possible (each at most ``left`` times), larger sizes first."""
    reach = np.zeros(capacity + 1, bool)
    reach[0] = True
    by = np.full(capacity + 1, -1)
    times = np.zeros(capacity + 1, np.int64)
    for k, (s, n) in enumerate(zip(sizes, left)):
        base = reach.copy()
        for m in range(1, min(n, capacity // s) + 1):
            new = np.zeros_like(reach)
            new[m * s :] = base[: capacity + 1 - m * s]
            new &= ~reach
            by[new], times[new] = k, m
            reach |= new
        if reach[capacity]:
            break
    used = [0] * len(sizes)
    at = int(np.flatnonzero(reach)[-1])
    while at:
        k = int(by[at])
        used[k] += int(times[at])
        at -= int(times[at]) * sizes[k]
    return used


def patterns(sizes: list[int], left: list[int], capacity: int) -> list[tuple[int, list[int]]]:
    """(times, uses of each size) until all are placed."""
    left, out = list(left), []
    for k in range(len(sizes)):
        while left[k]:
            left[k] -= 1
            used = fullest(sizes[k:], left[k:], capacity - sizes[k])
            left[k] += 1
            used[0] += 1
            used = [0] * k + used
            times = min(left[i] // u for i, u in enumerate(used) if u)
            for i, u in enumerate(used):
                left[i] -= times * u
            out.append((times, used))
    return out


def substituted(groups: list[list[list[int]]], plan: list[tuple[int, list[int]]]) -> list[tuple[int, list[int]]]:
    """Templates (times, actual lengths): the runs of each group are dealt to the places of its size in order."""
    rest = [[list(r) for r in reversed(g)] for g in groups]

    def take(k: int, n: int) -> list[list[int]]:
        got = []
        while n:
            length, have = rest[k][-1]
            m = min(n, have)
            got.append([length, m])
            rest[k][-1][1] -= m
            n -= m
            if not rest[k][-1][1]:
                rest[k].pop()
        return got

    out = []
    for times, used in plan:
        places = [take(k, times) for k, u in enumerate(used) for _ in range(u)]
        while times:
            m = min(p[0][1] for p in places)
            out.append((m, [p[0][0] for p in places]))
            times -= m
            for p in places:
                p[0][1] -= m
                if not p[0][1]:
                    p.pop(0)
    return out


def best_fit(templates: list[tuple[int, list[int]]], small: dict[int, int], capacity: int) -> list[tuple[int, list[int]]]:
    """Small lengths, largest first, each into the fullest sequences that have room; new ones where none has."""
    by_room: dict[int, list[tuple[int, list[int]]]] = defaultdict(list)
    for times, lengths in templates:
        by_room[capacity - sum(lengths)].append((times, lengths))
    rooms = sorted(by_room)
    for length in sorted(small, reverse=True):
        n = small[length]
        heap = [r for r in rooms if r >= length]
        heapq.heapify(heap)
        while n:
            while heap and not by_room[heap[0]]:
                heapq.heappop(heap)
            if not heap:
                per = capacity // length
                for times, k in ((n // per, per), (1, n % per)):
                    if times and k:
                        by_room[capacity - k * length].append((times, [length] * k))
                break
            room = heap[0]
            times, lengths = by_room[room].pop()
            m = min(times, n)
            if m < times:
                by_room[room].append((times - m, lengths))
            if not by_room[room - length] and room - length >= length:
                heapq.heappush(heap, room - length)
            by_room[room - length].append((m, lengths + [length]))
            n -= m
        rooms = sorted(r for r, t in by_room.items() if t)
    return [t for r in sorted(by_room) for t in by_room[r]]


def plan(counts: dict[int, int], capacity: int, n_groups: int = GROUPS, small_shares: tuple[float, ...] = SMALL) -> list[tuple[int, list[int]]]:
    """Templates (times, lengths) that hold every length of ``counts`` as often as it occurs."""
    counts = {k: v for k, v in counts.items() if v}
    best: list[tuple[int, list[int]]] | None = None
    for share in small_shares:
        large = {k: v for k, v in counts.items() if k > share * capacity}
        groups = groups_of(large, n_groups)
        sizes, left = [g[0][0] for g in groups], [sum(n for _, n in g) for g in groups]
        templates = substituted(groups, patterns(sizes, left, capacity))
        made = best_fit(templates, {k: v for k, v in counts.items() if k not in large}, capacity)
        if best is None or sum(t for t, _ in made) < sum(t for t, _ in best):
            best = made
    return best or []
