"""HDBSCAN on a few hundred to a few thousand points: mutual reachability, single linkage, condensed tree, excess of mass."""

from __future__ import annotations

import numpy as np


def distances(x: np.ndarray) -> np.ndarray:
    sq = (x * x).sum(axis=1)
    return np.sqrt(np.maximum(sq[:, None] + sq[None, :] - 2 * x @ x.T, 0))


def _spanning_tree(reach: np.ndarray) -> list[tuple[float, int, int]]:
    """Edges of the minimum spanning tree (Prim), by weight."""
    n = len(reach)
    near, source, todo = reach[0].copy(), np.zeros(n, int), np.ones(n, bool)
    todo[0] = False
    out = []
    for _ in range(n - 1):
        k = int(np.argmin(np.where(todo, near, np.inf)))
        out.append((float(near[k]), int(source[k]), k))
        todo[k] = False
        closer = todo & (reach[k] < near)
        near[closer], source[closer] = reach[k][closer], k
    return sorted(out)


def hdbscan(x: np.ndarray, min_cluster_size: int, min_samples: int | None = None) -> np.ndarray:
    """Labels from 0 in the order of each cluster's first point, -1 for noise. The whole set is never one cluster."""
    n = len(x)
    if n < max(2, min_cluster_size):
        return np.full(n, -1)
    d = distances(x)
    core = np.sort(d, axis=1)[:, min((min_samples or min_cluster_size), n) - 1]
    reach = np.maximum(d, np.maximum(core[:, None], core[None, :]))
    # single linkage as a dendrogram: node n + i merges two earlier nodes
    parent, top = list(range(n)), list(range(n))

    def find(a: int) -> int:
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    kids, height, size = {}, {}, {k: 1 for k in range(n)}
    for i, (w, a, b) in enumerate(_spanning_tree(reach)):
        ra, rb = find(a), find(b)
        node = n + i
        kids[node], height[node], size[node] = (top[ra], top[rb]), w, size[top[ra]] + size[top[rb]]
        parent[rb] = ra
        top[ra] = node
    root = 2 * n - 2

    def leaves(node: int) -> list[int]:
        out, stack = [], [node]
        while stack:
            k = stack.pop()
            out.append(k) if k < n else stack.extend(kids[k])
        return out

    level = lambda h: 1 / h if h > 0 else np.inf
    # condensed tree: a cluster lives until both sides of a split are large enough
    birth, stability, split, points = {0: 0.0}, {0: 0.0}, {}, {0: leaves(root)}
    stack = [(root, 0)]
    while stack:
        node, c = stack.pop()
        while node >= n:
            a, b = kids[node]
            lam = level(height[node])
            big = [k for k in (a, b) if size[k] >= min_cluster_size]
            gain = lam - birth[c] if np.isfinite(lam) else 0.0
            if len(big) == 2:
                stability[c] += gain * size[node]
                split[c] = []
                for k in (a, b):
                    new = len(birth)
                    birth[new], stability[new], points[new] = (lam if np.isfinite(lam) else birth[c]), 0.0, leaves(k)
                    split[c].append(new)
                    stack.append((k, new))
                break
            lost = sum(size[k] for k in (a, b) if size[k] < min_cluster_size)
            stability[c] += gain * lost
            if not big:
                break
            node = big[0]
    chosen, value = set(), {}
    for c in sorted(birth, reverse=True):
        below = sum(value[k] for k in split.get(c, []))
        if c and (c not in split or stability[c] >= below):
            drop = list(split.get(c, []))
            while drop:
                k = drop.pop()
                chosen.discard(k)
                drop += split.get(k, [])
            chosen.add(c)
            value[c] = stability[c]
        else:
            value[c] = below
    labels = np.full(n, -1)
    for number, c in enumerate(sorted(chosen, key=lambda c: min(points[c]))):
        labels[points[c]] = number
    return labels


def silhouette(x: np.ndarray, labels: np.ndarray) -> float:
    """Mean silhouette; the noise label counts as a cluster. 0 unless there are two labels at least."""
    kinds = sorted(set(labels.tolist()))
    if len(kinds) < 2 or len(kinds) >= len(x):
        return 0.0
    d = distances(x)
    sums = np.stack([d[:, labels == k].sum(axis=1) for k in kinds], axis=1)
    counts = np.array([(labels == k).sum() for k in kinds])
    own = np.searchsorted(kinds, labels)
    rows = np.arange(len(x))
    alone = counts[own] == 1
    a = sums[rows, own] / np.maximum(counts[own] - 1, 1)
    means = sums / counts
    means[rows, own] = np.inf
    b = means.min(axis=1)
    top = np.maximum(a, b)
    return float(np.where(alone | (top == 0), 0.0, (b - a) / np.where(top == 0, 1, top)).mean())
