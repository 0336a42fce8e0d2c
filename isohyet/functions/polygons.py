"""Polygons of several rings in the plane: signed areas, repair by the even-odd rule."""

from __future__ import annotations

from collections import defaultdict

import numpy as np

#: Points closer than this part of a polygon's extent are one.
TOLERANCE = 1e-10
#: Pairs of edges held against each other at once.
PAIRS = 1 << 20


def signed_area(ring: np.ndarray) -> float:
    """Positive if the ring (n, 2), its first point not repeated, runs against the clock."""
    x, y = (ring - ring[0]).T
    return float((x * np.roll(y, -1) - np.roll(x, -1) * y).sum() / 2)


def _edges(rings: list[np.ndarray]) -> np.ndarray:
    """(n, 4): the edges of all rings that have a length."""
    edges = np.concatenate([np.zeros((0, 4)), *(np.hstack([r, np.roll(r, -1, 0)]) for r in rings if len(r))])
    return edges[(edges[:, :2] != edges[:, 2:]).any(1)]


def _meeting(edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs i < j of edges whose boxes meet, in pieces of bounded size: edges in order of their left ends, as the others' right ends allow."""
    left, right = np.minimum(edges[:, 0], edges[:, 2]), np.maximum(edges[:, 0], edges[:, 2])
    low, high = np.minimum(edges[:, 1], edges[:, 3]), np.maximum(edges[:, 1], edges[:, 3])
    order = np.argsort(left, kind="stable")
    until = np.searchsorted(left[order], right[order], "right")
    each = np.maximum(until - np.arange(len(order)) - 1, 0)
    cuts = np.unique(np.searchsorted(np.cumsum(each), np.arange(0, each.sum() + PAIRS, PAIRS), "left").clip(0, len(order)))
    found = []
    for a, b in zip(cuts, [*cuts[1:], len(order)], strict=True):
        n = each[a:b]
        i = np.repeat(np.arange(a, b), n)
        j = i + 1 + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        i, j = order[i], order[j]
        near = (low[i] <= high[j]) & (low[j] <= high[i])
        found.append((i[near], j[near]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, int),) * 2


def _cuts(edges: np.ndarray, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """(edge, point): where edges cross or touch each other, ends of edges among them."""
    i, j = _meeting(edges)
    p, q = edges[i, :2], edges[j, :2]
    d, e = edges[i, 2:] - p, edges[j, 2:] - q
    cross = d[:, 0] * e[:, 1] - d[:, 1] * e[:, 0]
    length = np.hypot(*d.T) * np.hypot(*e.T)
    gap = q - p
    skew = np.abs(cross) > 1e-14 * length
    with np.errstate(divide="ignore", invalid="ignore"):
        s = (gap[:, 0] * e[:, 1] - gap[:, 1] * e[:, 0]) / cross
        t = (gap[:, 0] * d[:, 1] - gap[:, 1] * d[:, 0]) / cross
    hit = skew & (s > 0) & (s < 1) & (t > 0) & (t < 1)
    point = p[hit] + s[hit, None] * d[hit]
    which, where = [i[hit], j[hit]], [point, point]
    # ends of one edge on the other, of parallel ones too
    for a, b in ((i, j), (j, i)):
        start, along = edges[a, :2], edges[a, 2:] - edges[a, :2]
        for end in (edges[b, :2], edges[b, 2:]):
            off = end - start
            square = (along**2).sum(1)
            u = (off * along).sum(1) / square
            far = np.abs(off[:, 0] * along[:, 1] - off[:, 1] * along[:, 0]) / np.sqrt(square)
            on = (u > 0) & (u < 1) & (far <= tolerance)
            which.append(a[on])
            where.append(end[on])
    return np.concatenate(which), np.concatenate(where)


def _segments(edges: np.ndarray, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, segments): edges cut where they meet; segments (pairs of nodes) that lie on each other an even number of times are gone."""
    which, point = _cuts(edges, tolerance)
    n = len(edges)
    all_points = np.concatenate([edges[:, :2], edges[:, 2:], point])
    _, first, node = np.unique(np.round(all_points / tolerance), axis=0, return_index=True, return_inverse=True)
    nodes, node = all_points[first], node.ravel()
    edge = np.concatenate([np.arange(n), np.arange(n), which])
    along = ((all_points - edges[edge, :2]) * (edges[edge, 2:] - edges[edge, :2])).sum(1)
    order = np.lexsort((along, edge))
    a, b, same = node[order][:-1], node[order][1:], np.diff(edge[order]) == 0
    keep = same & (a != b)
    pairs = np.sort(np.stack([a[keep], b[keep]], 1), axis=1)
    unique, times = np.unique(pairs, axis=0, return_counts=True)
    return nodes, unique[times % 2 == 1]


def _inside_left(nodes: np.ndarray, segments: np.ndarray, these: np.ndarray) -> np.ndarray:
    """Whether the inside lies left of each of these segments, from its first node to its second: a ray's crossings of all segments decide."""
    ax, ay = nodes[segments[:, 0]].T
    bx, by = nodes[segments[:, 1]].T
    out = np.zeros(len(these), bool)
    for k, s in enumerate(these):
        mx, my, dx, dy = (ax[s] + bx[s]) / 2, (ay[s] + by[s]) / 2, bx[s] - ax[s], by[s] - ay[s]
        # a ray along x for steep segments, along y for flat ones
        flat = abs(dx) > abs(dy)
        u0, v0, u1, v1, mu, mv = (ay, ax, by, bx, my, mx) if flat else (ax, ay, bx, by, mx, my)
        crosses = (v0 > mv) != (v1 > mv)
        crosses[s] = False
        at = u0[crosses] + (mv - v0[crosses]) * (u1 - u0)[crosses] / (v1 - v0)[crosses]
        beyond = np.count_nonzero(at > mu) % 2 == 1  # the side towards larger u is inside
        towards_left = dx > 0 if flat else dy < 0  # is that side the left one?
        out[k] = beyond == towards_left
    return out


def _arcs(segments: np.ndarray) -> list[list[tuple[int, bool]]]:
    """Chains of segments through nodes that two segments share: (segment, whether along its direction)."""
    at = defaultdict(list)
    for s, (a, b) in enumerate(segments.tolist()):
        at[a].append(s)
        at[b].append(s)
    done, arcs = np.zeros(len(segments), bool), []
    ends = segments.tolist()
    # chains that begin where other than two meet, then closed ones
    starts = [(s, n) for n, around in at.items() if len(around) != 2 for s in around] + [(s, a) for s, (a, _) in enumerate(ends)]
    for s, node in starts:
        arc = []
        while not done[s]:
            done[s] = True
            a, b = ends[s]
            arc.append((s, a == node))
            node = b if a == node else a
            if len(at[node]) == 2:
                s = next(x for x in at[node] if x != s)
        if arc:
            arcs.append(arc)
    return arcs


def _walked(nodes: np.ndarray, directed: list[tuple[int, int]]) -> list[np.ndarray]:
    """Simple rings of directed segments that have the inside on their left; a ring that comes back to a node is parted there."""
    out = defaultdict(list)
    for a, b in directed:
        out[a].append(b)
    angle = lambda a, b: float(np.arctan2(nodes[b, 1] - nodes[a, 1], nodes[b, 0] - nodes[a, 0]))
    rings = []
    for start in list(out):
        while out[start]:
            path, seen = [start], {start: 0}
            node = out[start].pop()
            back = start
            while True:
                if node in seen:
                    ring = path[seen[node] :]
                    if len(ring) >= 3:
                        rings.append(nodes[ring])
                    for gone in ring[1:]:
                        del seen[gone]
                    path = path[: seen[node] + 1]
                    if len(path) == 1:
                        break
                else:
                    seen[node] = len(path)
                    path.append(node)
                choices = out[node]
                if len(choices) > 1:
                    # the first one clockwise from where we came bounds the same inside
                    came = angle(node, back)
                    choices.sort(key=lambda n, node=node, came=came: (came - angle(node, n)) % (2 * np.pi), reverse=True)
                back, node = node, choices.pop()
    return rings


def repaired(rings: list[np.ndarray]) -> list[np.ndarray]:
    """Simple rings with the same inside by the even-odd rule: outer ones against the clock, holes with it; none if there is no inside.

    Points in a row that are one, spikes and edges that lie on each other twice go; edges are cut where they cross or touch, and
    walked again.
    """
    edges = _edges([np.asarray(r, float).reshape(-1, 2) for r in rings])
    edges = edges[np.isfinite(edges).all(1)]
    if len(edges) < 3:
        return []
    corner = edges.reshape(-1, 2).min(0)
    extent = float((edges.reshape(-1, 2).max(0) - corner).max())
    nodes, segments = _segments(edges - np.tile(corner, 2), TOLERANCE * extent)
    if len(segments) < 3:
        return []
    arcs = _arcs(segments)
    # the longest segment of a chain is the surest
    length = np.hypot(*(nodes[segments[:, 1]] - nodes[segments[:, 0]]).T)
    witness = [max(arc, key=lambda x: length[x[0]]) for arc in arcs]
    left = _inside_left(nodes, segments, np.array([s for s, _ in witness]))
    directed = []
    for arc, (_, along), inside_left in zip(arcs, witness, left, strict=True):
        with_chain = along == inside_left  # the inside lies left of the chain
        directed += [tuple(segments[s] if with_chain == forward else segments[s][::-1]) for s, forward in arc]
    return [r + corner for r in _walked(nodes, [(int(a), int(b)) for a, b in directed])]
