"""Whole-graph measures in plain Python and numpy, against which the rounds of joins are held."""

from __future__ import annotations

from collections import deque

import numpy as np
import pyarrow as pa


class Graph:
    def __init__(self, t: pa.Table):
        a, b = t.column("src").to_numpy(), t.column("dst").to_numpy()
        self.ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        n, x, y = len(self.ids), at[: len(a)], at[len(a) :]
        lo, hi = np.minimum(x, y), np.maximum(x, y)
        pair, k = np.unique(lo * n + hi, return_inverse=True)
        w = np.zeros(len(pair))
        np.maximum.at(w, k, t.column("sim").to_numpy())
        self.n, self.u, self.v, self.w = n, pair // n, pair % n, np.maximum(w, 0)
        self.near: list[list[int]] = [[] for _ in range(n)]
        self.weight: list[dict[int, float]] = [{} for _ in range(n)]
        for p, q, m in zip(self.u.tolist(), self.v.tolist(), self.w.tolist(), strict=True):
            self.near[p].append(q)
            self.near[q].append(p)
            self.weight[p][q] = self.weight[q][p] = m

    def spread(self, x: np.ndarray) -> np.ndarray:
        """The sum of x over each node's neighbours."""
        out = np.zeros(self.n)
        np.add.at(out, self.u, x[self.v])
        np.add.at(out, self.v, x[self.u])
        return out

    def hops(self, start: int) -> np.ndarray:
        far = np.full(self.n, -1)
        far[start], todo = 0, deque([start])
        while todo:
            p = todo.popleft()
            for q in self.near[p]:
                if far[q] < 0:
                    far[q] = far[p] + 1
                    todo.append(q)
        return far


def louvain(g: Graph, resolution: float = 1.0, seed: int = 42) -> np.ndarray:
    """Communities by local moves and aggregation in seeded order, split into connected parts; ids by falling size."""
    rng = np.random.default_rng(seed)
    near = [dict(w) for w in g.weight]
    loops = [0.0] * g.n
    of = list(range(g.n))
    while True:
        n = len(near)
        degree = [sum(w.values()) + 2 * loops[p] for p, w in enumerate(near)]
        total = sum(degree)
        if not total:
            break
        com, mass, moved, again = list(range(n)), list(degree), False, True
        order = rng.permutation(n).tolist()
        while again:
            again = False
            for p in order:
                c = com[p]
                mass[c] -= degree[p]
                links: dict[int, float] = {c: 0.0}
                for q, w in near[p].items():
                    links[com[q]] = links.get(com[q], 0.0) + w
                best = max(sorted(links), key=lambda x: links[x] - resolution * degree[p] * mass[x] / total)
                gain = lambda x: links[x] - resolution * degree[p] * mass[x] / total  # noqa: B023, E731
                if gain(best) <= gain(c) + 1e-12:
                    best = c
                mass[best] += degree[p]
                if best != c:
                    com[p], again, moved = best, True, True
        if not moved:
            break
        new = {c: k for k, c in enumerate(dict.fromkeys(com))}
        of = [new[com[c]] for c in of]
        merged: list[dict[int, float]] = [{} for _ in new]
        own = [0.0] * len(new)
        for p, ws in enumerate(near):
            a = new[com[p]]
            own[a] += loops[p]
            for q, w in ws.items():
                b = new[com[q]]
                if a == b:
                    own[a] += w / 2
                else:
                    merged[a][b] = merged[a].get(b, 0.0) + w
        near, loops = merged, own
    part, k = [-1] * g.n, 0
    for s in range(g.n):
        if part[s] < 0:
            part[s], todo = k, [s]
            while todo:
                p = todo.pop()
                for q in g.near[p]:
                    if part[q] < 0 and of[q] == of[p]:
                        part[q] = k
                        todo.append(q)
            k += 1
    size = np.bincount(part, minlength=k)
    order = np.lexsort((np.arange(k), -size))
    rank = np.empty(k, np.int64)
    rank[order] = np.arange(k)
    return rank[part]


def cores(g: Graph) -> np.ndarray:
    degree = np.array([len(x) for x in g.near])
    core, left, k = np.zeros(g.n, np.int64), set(range(g.n)), 0
    while left:
        low = [p for p in left if degree[p] <= k]
        if not low:
            k += 1
            continue
        for p in low:
            core[p] = k
            left.discard(p)
            for q in g.near[p]:
                degree[q] -= 1
    return core


def sampled(ids: np.ndarray, most: int, seed: int = 42) -> list[int]:
    """Places of at most most ids, in the order of a hash."""
    if len(ids) <= most:
        return list(range(len(ids)))
    h = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) * np.uint64(0xBF58476D1CE4E5B9)
    return np.sort(np.argsort(h ^ (h >> np.uint64(31)))[:most]).tolist()


def brandes(g: Graph, most: int = 256) -> np.ndarray:
    """Betweenness from at most most sources, scaled up to all and normalised."""
    out, sources = np.zeros(g.n), sampled(g.ids, most)
    for s in sources:
        order, before = [], [[] for _ in range(g.n)]
        paths, far = np.zeros(g.n), np.full(g.n, -1)
        paths[s], far[s], todo = 1, 0, deque([s])
        while todo:
            p = todo.popleft()
            order.append(p)
            for q in g.near[p]:
                if far[q] < 0:
                    far[q] = far[p] + 1
                    todo.append(q)
                if far[q] == far[p] + 1:
                    paths[q] += paths[p]
                    before[q].append(p)
        share = np.zeros(g.n)
        for q in reversed(order):
            for p in before[q]:
                share[p] += paths[p] / paths[q] * (1 + share[q])
            if q != s:
                out[q] += share[q]
    return out * g.n / max(1, len(sources)) / max(1, (g.n - 1) * (g.n - 2))


def harmonics(g: Graph) -> np.ndarray:
    h = np.array([(1.0 / d[d > 0]).sum() for d in map(g.hops, range(g.n))])
    return h / max(h.max(initial=0), 1e-12)


def eigenvectors(g: Graph) -> np.ndarray:
    x = np.full(g.n, 1 / np.sqrt(g.n))
    for _ in range(200):
        y = g.spread(x) + x
        y /= np.linalg.norm(y)
        if np.abs(y - x).max() < 1e-10:
            break
        x = y
    return y


def katz_values(g: Graph) -> np.ndarray:
    alpha, x = 1 / (1 + max(len(p) for p in g.near)), np.ones(g.n)
    for _ in range(50):
        x = 1 + alpha * g.spread(x)
    return x / np.linalg.norm(x)
