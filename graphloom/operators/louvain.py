"""Louvain over arrays: the same moves in the same order as looking at every node in every round, but only nodes whose
best community can have changed are looked at again."""

from __future__ import annotations

from array import array

import numpy as np

#: Nodes that are looked at together before their turns; neighbours from which on a node is reckoned by arrays.
BLOCK, MANY = 8192, 400
_NONE = -1e300


def _rooms(ids, start, near, weight, com, mass, degree, total):
    """How much less each node's own community may be worth, against the best other one, before the node moves."""
    lens = start[ids + 1] - start[ids]
    ids, lens, alone = ids[lens > 0], lens[lens > 0], ids[lens == 0]
    if not len(ids):
        return alone, np.full(len(alone), np.inf)
    ends = np.cumsum(lens)
    at = np.repeat(start[ids] - (ends - lens), lens) + np.arange(ends[-1])
    key = np.repeat(np.arange(len(ids)) * len(com), lens) + com[near[at]]
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    sums, key = np.add.reduceat(weight[at[order]], first), key[first]
    row, c = key // len(com), key % len(com)
    d, own = degree[ids], com[ids]
    inside = c == own[row]
    gain = 0.0 - (mass[own] - d) * d / total
    gain[row[inside]] = sums[inside] - (mass[c[inside]] - d[row[inside]]) * d[row[inside]] / total
    other = np.where(inside, _NONE, sums - mass[c] * d[row] / total)
    best = np.maximum.reduceat(other, np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])))
    room = np.where(best == _NONE, np.inf, gain - best - 1e-9 * (1 + np.abs(gain)))
    return np.concatenate([alone, ids]), np.concatenate([np.full(len(alone), np.inf), room])


def _move(start: np.ndarray, near_np: np.ndarray, weight_np: np.ndarray, degree_np: np.ndarray, total: float, max_rounds: int, least: float) -> np.ndarray | None:
    """Each node's community once no node moves; None if none moved. ``drift`` sums the degrees of what moved: as no
    difference of two communities' masses changes by more than twice that, a node whose neighbours stay has nothing to
    gain until ``drift`` reaches its ``till``. Neighbours of what moved are looked at again."""
    n = len(degree_np)
    com, mass, todo, till = array("i", range(n)), array("d", degree_np.tobytes()), bytearray(b"\x01") * n, array("d", bytes(8 * n))
    near, weight, degree, starts = array("i", near_np.tobytes()), array("d", weight_np.tobytes()), array("d", degree_np.tobytes()), array("q", start.tobytes())
    com_np, mass_np, todo_np, till_np = np.frombuffer(com, np.int32), np.frombuffer(mass), np.frombuffer(todo, np.uint8), np.frombuffer(till)
    near_np, weight_np = np.frombuffer(near, np.int32), np.frombuffer(weight)
    drift, ever = 0.0, False
    for turn in range(max_rounds):
        moved = False
        for a in range(0, n, BLOCK):
            z = min(n, a + BLOCK)
            ahead = till_np[a:z]
            todo_np[a:z] |= ahead <= drift
            if turn and len(ids := a + np.flatnonzero(todo_np[a:z])) > 16:
                ids, room = _rooms(ids, start, near_np, weight_np, com_np, mass_np, degree_np, total)
                ids, room = ids[room > 0], room[room > 0]
                todo_np[ids], till_np[ids] = 0, drift + room * total / (2 * np.maximum(degree_np[ids], 1e-300))
            later = ahead[ahead > drift]
            next_due = float(later.min()) if len(later) else np.inf
            i = todo.find(1, a, z)
            while i >= 0:
                todo[i] = 0
                s, e, own, d = starts[i], starts[i + 1], com[i], degree[i]
                mass[own] -= d
                second = _NONE  # the best of the communities that are not taken
                if e - s <= MANY:
                    to: dict[int, float] = {}
                    for j, w in zip(near[s:e], weight[s:e]):
                        c = com[j]
                        to[c] = to.get(c, 0.0) + w
                    best, gain = own, to.pop(own, 0.0) - mass[own] * d / total
                    each = ((c, to[c] - mass[c] * d / total) for c in sorted(to))
                else:
                    cs, at = np.unique(com_np[near_np[s:e]], return_inverse=True)
                    sums = np.bincount(at, weight_np[s:e])
                    own_sum = sums[cs == own]
                    best, gain = own, (float(own_sum[0]) if len(own_sum) else 0.0) - mass[own] * d / total
                    gs = sums - mass_np[cs] * d / total
                    low = gs[(gs <= gain + least) & (cs != own)]
                    second = float(low.max()) if len(low) else _NONE
                    pick = (gs > gain + least) & (cs != own)
                    each = zip(cs[pick].tolist(), gs[pick].tolist())
                for c, g in each:
                    if g > gain + least:
                        best, gain, g = c, g, gain
                    if g > second:
                        second = g
                mass[best] += d
                if best != own:
                    com[i] = best
                    moved = ever = True
                    if e - s <= MANY:
                        for j in near[s:e]:
                            if com[j] != best:
                                todo[j] = 1
                    else:
                        x = near_np[s:e]
                        todo_np[x[com_np[x] != best]] = 1
                    drift += d
                    if drift >= next_due:
                        todo_np[i + 1 : z] |= till_np[i + 1 : z] <= drift
                        later = till_np[i + 1 : z]
                        later = later[later > drift]
                        next_due = float(later.min()) if len(later) else np.inf
                room = gain - second - 1e-9 * (1 + abs(gain))
                till[i] = np.inf if second == _NONE else drift + room * total / (2 * d) if room > 0 else -1.0
                i = todo.find(1, i + 1, z)
        if not moved:
            break
    return com_np.copy() if ever else None


def louvain(n: int, a: np.ndarray, b: np.ndarray, w: np.ndarray, max_rounds: int = 64, least: float = 1e-12) -> np.ndarray:
    """Communities of an undirected weighted graph: nodes in ascending order move to the neighbouring community of the
    largest gain until none moves; communities become nodes; repeated until nothing changes. Numbered by falling size,
    then by least member. Takes about 100 bytes a pair and a node."""
    a, b, w = np.asarray(a, np.int64), np.asarray(b, np.int64), np.asarray(w, np.float64)
    members, nodes, total = np.arange(n), n, 2 * float(np.sum(w))
    while total:
        key, at = np.unique(np.minimum(a, b) * nodes + np.maximum(a, b), return_inverse=True)
        w, a, b = np.bincount(at, w), key // nodes, key % nodes
        del key, at
        far = a != b
        here, there, both = np.concatenate([a[far], b[far]]), np.concatenate([b[far], a[far]]).astype(np.int32), np.concatenate([w[far], w[far]])
        order = np.argsort(here, kind="stable")
        start = np.zeros(nodes + 1, np.int64)
        np.cumsum(np.bincount(here, minlength=nodes), out=start[1:])
        degree = np.bincount(here, both, nodes) + 2 * np.bincount(a[~far], w[~far], nodes)
        near, weight = there[order], both[order]
        del here, there, both, order, far
        com = _move(start, near, weight, degree, total, max_rounds, least)
        if com is None:
            break
        _, first, at = np.unique(com, return_index=True, return_inverse=True)
        number = np.empty(len(first), np.int64)
        number[np.argsort(first)] = np.arange(len(first))  # as first seen
        com = number[at]
        members, a, b, nodes = com[members], com[a], com[b], len(first)
    _, first, at, size = np.unique(members, return_index=True, return_inverse=True, return_counts=True)
    number = np.empty(len(first), np.int64)
    number[np.lexsort((first, -size))] = np.arange(len(first))
    return number[at]
