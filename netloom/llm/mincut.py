"""Minimum cut for two labels on small sparse graphs."""

from __future__ import annotations

from collections import deque


def label(gain: list[float], edges: dict[tuple[int, int], float]) -> list[bool]:
    """The labelling with least cost: True costs ``-gain`` where that is positive, False costs ``gain``, and an
    edge costs its capacity if its ends differ. Ties go to False.

    Nodes whose own gain outweighs all their edges are settled first, exactly, and pass their edges on to
    their neighbours as gains; what is left is cut by maximum flow.
    """
    gain = list(gain)
    near: list[dict[int, float]] = [{} for _ in gain]
    for (a, b), capacity in edges.items():
        if a != b and capacity > 0:
            near[a][b] = near[a].get(b, 0.0) + capacity
            near[b][a] = near[b].get(a, 0.0) + capacity
    settled: list[bool | None] = [None] * len(gain)
    todo = deque(range(len(gain)))
    while todo:
        v = todo.popleft()
        if settled[v] is None and abs(gain[v]) >= sum(near[v].values()):
            settled[v] = gain[v] > 0
            for u, capacity in near[v].items():
                del near[u][v]
                gain[u] += capacity if settled[v] else -capacity
                todo.append(u)
            near[v] = {}
    open_ = [v for v, s in enumerate(settled) if s is None]
    if open_:
        for v, side in zip(open_, _max_flow(open_, gain, near), strict=True):
            settled[v] = side
    return [bool(s) for s in settled]


def _max_flow(nodes: list[int], gain: list[float], near: list[dict[int, float]]) -> list[bool]:
    """Source side of the minimum cut, by blocking flows in a layered residual graph."""
    number = {v: i + 2 for i, v in enumerate(nodes)}  # 0 is the source, 1 the sink
    rest: list[dict[int, float]] = [{} for _ in range(len(nodes) + 2)]
    for v, i in number.items():
        if gain[v] > 0:
            rest[0][i], rest[i][0] = gain[v], 0.0
        elif gain[v] < 0:
            rest[i][1], rest[1][i] = -gain[v], 0.0
        for u, capacity in near[v].items():
            rest[i][number[u]] = capacity
    tiny = 1e-9
    while True:
        level = {0: 0}
        queue = deque([0])
        while queue:
            v = queue.popleft()
            for u, capacity in rest[v].items():
                if capacity > tiny and u not in level:
                    level[u] = level[v] + 1
                    queue.append(u)
        if 1 not in level:
            return [number[v] in level for v in nodes]
        ways = [iter(list(r)) for r in rest]
        path = [0]
        while path:
            v = path[-1]
            if v == 1:
                amount = min(rest[a][b] for a, b in zip(path, path[1:], strict=False))
                for a, b in zip(path, path[1:], strict=False):
                    rest[a][b] -= amount
                    rest[b][a] = rest[b].get(a, 0.0) + amount
                cut = next(k for k, (a, b) in enumerate(zip(path, path[1:], strict=False)) if rest[a][b] <= tiny)
                del path[cut + 1 :]
                continue
            for u in ways[v]:
                if rest[v][u] > tiny and level.get(u, -1) == level[v] + 1:
                    path.append(u)
                    break
            else:
                path.pop()
