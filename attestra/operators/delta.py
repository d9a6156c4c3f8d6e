"""An incremental index of heaviest independent sets on one machine: a change of a weight re-solves its own component only.

The table form, for graphs of any size, is `conflicts.resolve_changed`; this is the kernel for graphs that fit in memory.
"""

from __future__ import annotations

import numpy as np

from .conflicts import solve

SMALL = 12  # vertices of a component that is solved by all its subsets at once


class DeltaIndex:
    """components: vertex to component is derived from the edges; `total` is the weight of the heaviest independent set.

    weight: vertex to weight (at least 0). Components of up to SMALL vertices are solved as matrix products over all subsets,
    all components of one size together; larger ones by `conflicts.solve`.
    """

    def __init__(self, weight: dict, edges: list[tuple]):
        near: dict = {v: set() for v in weight}
        for a, b in edges:
            near[a].add(b)
            near[b].add(a)
        self.place: dict = {}  # vertex: component, position in it
        self.vertices: list[list] = []
        for root in weight:
            if root in self.place:
                continue
            queue = [root]
            self.place[root] = (len(self.vertices), 0)
            for v in queue:
                for u in near[v]:
                    if u not in self.place:
                        self.place[u] = (len(self.vertices), len(queue))
                        queue.append(u)
            self.vertices.append(queue)
        self.weight = dict(weight)
        self.near = near
        self.best = np.zeros(len(self.vertices))
        self.free: dict[int, np.ndarray] = {}  # component: which subsets are independent
        self.solved = 0
        sizes: dict[int, list[int]] = {}
        for c, vs in enumerate(self.vertices):
            sizes.setdefault(len(vs), []).append(c)
        for size, cs in sizes.items():
            if size > SMALL:
                for c in cs:
                    self._solve(c)
                continue
            member = self._members(size)
            pairs = np.zeros((len(cs), size, size), dtype=bool)
            for row, c in enumerate(cs):
                for v in self.vertices[c]:
                    for u in near[v]:
                        pairs[row, self.place[v][1], self.place[u][1]] = True
            clash = np.zeros((len(cs), len(member)), dtype=bool)
            for i in range(size):
                for j in range(i, size):
                    both = member[:, i] & member[:, j]
                    clash |= pairs[:, i, j][:, None] & both[None, :]
            values = np.array([[self.weight[v] for v in self.vertices[c]] for c in cs], dtype=float) @ member.T
            self.best[cs] = np.where(clash, -1.0, values).max(axis=1)
            for row, c in enumerate(cs):
                self.free[c] = ~clash[row]
            self.solved += len(cs)

    @staticmethod
    def _members(size: int) -> np.ndarray:
        return (np.arange(1 << size)[:, None] >> np.arange(size) & 1).astype(bool)

    def _solve(self, c: int) -> None:
        vs = self.vertices[c]
        if c in self.free:
            self.best[c] = (self._members(len(vs))[self.free[c]] @ np.array([self.weight[v] for v in vs], dtype=float)).max()
        else:
            chosen, _ = solve({v: self.weight[v] for v in vs}, [(v, u) for v in vs for u in self.near[v] if v < u])
            self.best[c] = sum(self.weight[v] for v in chosen)
        self.solved += 1

    def update(self, vertex, weight: float) -> float:
        """Sets a weight and gives the new total; an unknown vertex or a negative weight changes nothing and fails."""
        if vertex not in self.weight or not weight >= 0:
            raise ValueError("a known vertex and a weight of at least 0 are needed")
        self.weight[vertex] = weight
        self._solve(self.place[vertex][0])
        return self.total

    @property
    def total(self) -> float:
        return float(self.best.sum())
