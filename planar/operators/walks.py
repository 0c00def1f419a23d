"""What one task does in arrays: the contours of the paths that it holds, and the kernel of one group of segments.

Both give what topology.Kernel and a fold over the commands would give; they hold one path, or one group of a bounded size, at a time.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

OPS = ("move", "line", "curve", "close")
POINT = pa.struct([("x", pa.float64()), ("y", pa.float64())])
CURVE = pa.struct([(c, POINT) for c in ("start", "c1", "c2", "end")])
#: Paths of two edges that are held at once.
PATHS = 1_000_000


def whole_paths(batches, least: int = 1):
    """Tables of whole paths, or pages, of `least` rows or more from batches of sorted rows, whose `row` is 1 where one begins."""
    held = []
    for batch in batches:
        starts = np.flatnonzero(batch.column("row").to_numpy(zero_copy_only=False) == 1)
        if len(starts) and sum(b.num_rows for b in held) + starts[-1] >= least:
            yield pa.Table.from_batches([*held, batch.slice(0, starts[-1])])
            held, batch = [], batch.slice(starts[-1])
        held.append(batch)
    if any(b.num_rows for b in held):
        yield pa.Table.from_batches(held)


def _one(column) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) and column.num_chunks != 1 else column.chunk(0)


def _numbers(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values, NaN where there is none, and where there is one."""
    return values.to_numpy(zero_copy_only=False).astype(float), values.is_valid().to_numpy(zero_copy_only=False)


def _points(x: np.ndarray, y: np.ndarray) -> pa.StructArray:
    return pa.StructArray.from_arrays([pa.array(x), pa.array(y)], fields=list(POINT))


def contours(keep: tuple[str, ...], same: float):
    """A function for mapInArrow: contours of sorted commands (row, op, points and what is kept of a path: keep)."""

    def run(batches):
        for table in whole_paths(batches):
            yield from _contours(table, keep, same)

    return run


def _contours(table: pa.Table, keep: tuple[str, ...], same_: float):
    """Of a contour with finite points the fold's state is known at each command: `first` is its first point, `now` the point of the command before or,
    after a close, `first`, and the last point is that of the last move or line, or `first` where a close has led back. Other contours are folded."""
    n = table.num_rows
    row = _one(table["row"]).to_numpy(zero_copy_only=False)
    op = pc.fill_null(pc.index_in(_one(table["op"]).cast(pa.string()), value_set=pa.array(OPS)), -1).to_numpy(zero_copy_only=False)
    lists = _one(table["points"])
    offsets, values = lists.offsets.to_numpy(), lists.values
    px, py = (_numbers(pc.struct_field(values, [k]))[0] for k in (0, 1))
    px, py = np.append(px, np.nan), np.append(py, np.nan)
    size = np.where(lists.is_valid().to_numpy(zero_copy_only=False), offsets[1:] - offsets[:-1], 0)
    at = lambda k: np.where(size > k, offsets[:-1] + k, len(px) - 1)
    last, c1, c2 = np.where(size > 0, offsets[:-1] + size - 1, len(px) - 1), at(0), at(1)
    x, y = px[last], py[last]
    finite = lambda k: np.isfinite(px[k]) & np.isfinite(py[k])
    clean = (op == 3) | (finite(last) & ((op == 0) | (op == 1) | ((op == 2) & (size > 1) & finite(c1) & finite(c2))))

    begins = (row == 1) | (op == 0)
    begins[0] = True
    cs = np.flatnonzero(begins)
    cid, ends, index = np.cumsum(begins) - 1, np.append(cs[1:], n) - 1, np.arange(n)
    dirty = np.logical_or.reduceat(~clean, cs)
    drawn = (op == 0) | (op == 1)  # gives a point of its own
    count = np.cumsum(drawn)
    count = count - (count[cs] - drawn[cs])[cid]
    firsts = np.minimum.reduceat(np.where(drawn, index, n), cs)
    fx, fy = np.append(x, np.nan)[firsts][cid], np.append(y, np.nan)[firsts][cid]
    before = np.maximum(np.maximum.accumulate(np.where(drawn, index, -1)), 0)  # the last move or line
    same = lambda ax, ay, bx, by: (np.abs(ax - bx) <= same_) & (np.abs(ay - by) <= same_)
    closes = np.cumsum(op == 3)
    led = (op == 3) & (count > 1) & (closes - closes[before] == 1) & ~same(x[before], y[before], fx, fy)
    back = np.cumsum(led)
    prev = np.maximum(index - 1, 0)
    returned = back - back[before] > 0  # since the last move or line a close has led back
    ex, ey = np.where(returned, fx, x[before]), np.where(returned, fy, y[before])
    curved = (op == 2) & (count > 0)
    joins = (op == 1) & (count > 1) & curved[prev] & ~same(ex[prev], ey[prev], x[prev], y[prev])
    emits = drawn + joins.astype(np.int64) + led
    closed = np.logical_or.reduceat(op == 3, cs)
    points, curves = np.add.reduceat(emits, cs), np.add.reduceat(curved.astype(np.int64), cs)
    final = closed & (points > 1) & ~same(ex[ends], ey[ends], fx[ends], fy[ends])

    folded = {c: _folded(table.slice(cs[c], ends[c] + 1 - cs[c]).select(["op", "points"]).to_pylist(), same_) for c in np.flatnonzero(dirty)}
    kept = (points > 1) | (curves > 0)
    for c, (p, cv, _) in folded.items():
        kept[c] = len(p) > 1 or len(cv) > 0
    number = np.cumsum(kept)
    opens = np.maximum.accumulate(np.where((row[cs] == 1) | (np.arange(len(cs)) == 0), np.arange(len(cs)), 0))
    number = number - (number[opens] - kept[opens])

    def out(which, points_, closed_, curves_, sizes):
        own = [_one(table[c]).take(pa.array(cs[which])) for c in keep]
        return pa.RecordBatch.from_arrays([*own, pa.array(number[which]), points_, pa.array(closed_, pa.bool_()), curves_, pa.array(sizes, pa.int32())], [*keep, "contour", "points", "is_closed", "curves", "size"])

    good = kept & ~dirty
    if good.any():
        rows = good[cid]
        each = emits * rows
        each[ends] += final & good
        place = np.cumsum(each) - each
        ox, oy = np.empty(each.sum()), np.empty(each.sum())
        for where, to, vx, vy in (
            (drawn & rows, place + joins, x, y), (joins & rows, place, x[prev], y[prev]), (led & rows, place, fx, fy),
        ):
            ox[to[where]], oy[to[where]] = vx[where], vy[where]
        where = ends[final & good]
        ox[place[where] + emits[where]], oy[place[where] + emits[where]] = fx[where], fy[where]
        sizes = np.add.reduceat(each, cs)[good]
        cuts = lambda k: pa.array(np.append(0, np.cumsum(k)), pa.int32())
        where = np.flatnonzero(curved & rows)
        p = where - 1
        shut = op[p] == 3
        start = _points(np.where(shut, fx[where], x[p]), np.where(shut, fy[where], y[p]))
        parts = [start, _points(px[c1[where]], py[c1[where]]), _points(px[c2[where]], py[c2[where]]), _points(x[where], y[where])]
        yield out(good, pa.ListArray.from_arrays(cuts(sizes), _points(ox, oy)), closed[good], pa.ListArray.from_arrays(cuts(curves[good]), pa.StructArray.from_arrays(parts, fields=list(CURVE))), sizes)
    odd = [c for c in folded if kept[c]]
    if odd:
        p, cv, shut = zip(*[folded[c] for c in odd])
        yield out(np.array(odd), pa.array(p, pa.list_(POINT)), list(shut), pa.array(cv, pa.list_(CURVE)), [len(k) for k in p])


def _and(*values):
    return False if False in values else None if None in values else True


def _or(*values):
    return True if True in values else None if None in values else False


def _folded(commands: list[dict], same: float):
    """Points, curves and is_closed of a contour's commands, command by command, where values may be missing."""

    def apart(a, b):
        near = lambda u, v: None if u is None or v is None else abs(u - v) <= same
        both = _and(*[near(a and a[k], b and b[k]) for k in "xy"])
        return None if both is None else not both

    points, curves, first, now, closed = [], [], None, None, False
    for o in commands:
        op, own = o["op"], o["points"] or []
        at = own[-1] if own else None
        drawn = _and(None if op is None else op == "curve", now is not None)
        end = points[-1] if points else None
        was = now
        if op == "move":
            points = [at]
        elif op == "line":
            points = [*points, *([now] if now is not None and (not points or apart(end, now)) else []), at]
        elif op == "close" and first is not None and len(points) > 1 and apart(end, first):
            points = [*points, first]
        if drawn:
            get = lambda k: own[k] if k < len(own) else None
            curves.append({"start": now, "c1": get(0), "c2": get(1), "end": at})
        if op == "close":
            now = first
        elif _or(None if op is None else op != "curve", drawn):
            now = at
        if op == "move":
            first = at
        elif op == "line" or drawn:
            first = next((p for p in (first, was, at) if p is not None), None)
        closed = closed or op == "close"
    if closed and len(points) > 1 and first is not None and apart(points[-1], first):
        points = [*points, first]
    return points, curves, closed


def first_come_nodes(x: np.ndarray, y: np.ndarray, snap: float) -> np.ndarray:
    """The node of each end, as the number of the end that became it. See topology.nodes.

    A point with no other in the nine cells around it is a node by itself; only the ends at other points are walked."""
    n = len(x)
    node = np.arange(n)
    key = lambda c: np.clip(np.nan_to_num(np.rint(c / snap)), -4e18, 4e18).astype(np.int64)
    kx, ky = key(x), key(y)
    order = np.lexsort((y, x))
    new = np.ones(n, bool)
    new[1:] = (x[order][1:] != x[order][:-1]) | (y[order][1:] != y[order][:-1])
    point = np.empty(n, np.int64)
    point[order] = np.cumsum(new) - 1
    first = order[new]
    crowded = np.ones(len(first), bool)
    width, height = int(kx.max()) - int(kx.min()) + 3, int(ky.max()) - int(ky.min()) + 3
    if width * height < 1 << 62:
        code = (kx[first] - kx.min() + 1) * height + (ky[first] - ky.min() + 1)
        cells, counts = np.unique(code, return_counts=True)
        around = np.zeros(len(first), np.int64)
        for d in (i * height + j for i in (-1, 0, 1) for j in (-1, 0, 1)):
            k = np.minimum(np.searchsorted(cells, code + d), len(cells) - 1)
            around += np.where(cells[k] == code + d, counts[k], 0)
        crowded = around > 1
    node = first[point]
    walked = np.flatnonzero(crowded[point])
    made: dict[tuple[int, int], list] = {}
    for k, i, j, u, v in zip(walked.tolist(), kx[walked].tolist(), ky[walked].tolist(), x[walked].tolist(), y[walked].tolist()):
        found = None
        for a in (i - 1, i, i + 1):
            for b in (j - 1, j, j + 1):
                for m, s, t in made.get((a, b), ()):
                    if math.sqrt((s - u) * (s - u) + (t - v) * (t - v)) <= snap:
                        found = m
                        break
                if found is not None:
                    break
            if found is not None:
                break
        if found is None:
            made.setdefault((i, j), []).append((k, u, v))
            found = k
        node[k] = found
    return node


def _spread(low: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each k count[k] numbers from low[k]: k and the number."""
    k = np.repeat(np.arange(len(low)), count)
    return k, np.arange(len(k)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)


def rectangles(x1, y1, x2, y2, limits):
    """Rectangles that share no edge of segments in their order, first come: corners a to d (x and y by row), edges by row and whether along the axes; in the
    order in which they are met. See topology.rectangles.

    A corner b takes pairs of edges at a right angle within the limit, d within twice of it, which the other conditions imply; they are found by their directions."""
    x, y = np.ravel(np.column_stack((x1, x2))), np.ravel(np.column_stack((y1, y2)))
    node = first_come_nodes(x, y, limits.snap)
    p, q = node[0::2], node[1::2]
    edge = np.flatnonzero((p != q) & np.isfinite(x[p] + y[p] + x[q] + y[q]))
    low, high = np.minimum(p[edge], q[edge]), np.maximum(p[edge], q[edge])
    order = np.lexsort((edge, high, low))
    new = np.ones(len(order), bool)
    new[1:] = (low[order][1:] != low[order][:-1]) | (high[order][1:] != high[order][:-1])
    a, m, e = low[order][new], high[order][new], edge[order][new]  # the first of parallel edges, by a
    none = np.zeros((0, 4))
    if len(e) < 4:
        return none, none, none.astype(np.int64), np.zeros(0, bool)
    angle = np.arctan2(y[m] - y[a], x[m] - x[a])
    source, target = np.concatenate((m, a)), np.concatenate((a, m))
    turn = np.concatenate((np.where(angle > 0, angle - np.pi, angle + np.pi), angle))
    key = source * 8.0 + turn
    order = np.argsort(key, kind="stable")
    key, target, via = key[order], target[order], np.concatenate((e, e))[order]
    wide = min(1.0, 2.1 * limits.angle)
    slack = np.arcsin(wide) + 1e-6 + 4 * np.finfo(float).eps * 8.0 * len(x)
    windows = []  # low and high number of the edges behind m
    if wide >= 0.999:
        windows.append((np.searchsorted(key, m * 8.0 - 3.5), np.searchsorted(key, m * 8.0 + 3.5)))
    else:
        for side in (np.pi / 2, -np.pi / 2):
            to = angle + side
            to = np.where(to > np.pi, to - 2 * np.pi, np.where(to < -np.pi, to + 2 * np.pi, to))
            windows.append((np.searchsorted(key, m * 8.0 + np.maximum(to - slack, -3.5)), np.searchsorted(key, m * 8.0 + np.minimum(to + slack, 3.5))))
            over = np.where(to + slack > np.pi, to + slack - 2 * np.pi, -4)
            windows.append((np.searchsorted(key, m * 8.0 - 3.5), np.searchsorted(key, m * 8.0 + np.maximum(over, -3.5))))
            under = np.where(to - slack < -np.pi, to - slack + 2 * np.pi, 4)
            windows.append((np.searchsorted(key, m * 8.0 + np.minimum(under, 3.5)), np.searchsorted(key, m * 8.0 + 3.5)))
    counts = [np.maximum(h - l, 0) for l, h in windows]
    total = np.cumsum(sum(counts))
    begins = np.append(np.flatnonzero(np.append(True, a[1:] != a[:-1])), len(a))  # where another a begins
    length = lambda v: np.sqrt(v[0] * v[0] + v[1] * v[1])
    side = lambda u, v: (x[v] - x[u], y[v] - y[u])
    dot = lambda v, w: np.abs(v[0] * w[0] + v[1] * w[1]) / (length(v) * length(w))
    cross = lambda v, w: np.abs(v[0] * w[1] - v[1] * w[0]) / (length(v) * length(w))
    even = lambda v, w: np.abs(length(v) - length(w)) <= np.maximum(limits.snap, np.maximum(length(v), length(w)) * limits.angle)
    found, at = [], 0
    while at < len(begins) - 1:
        done = total[begins[at] - 1] if begins[at] else 0
        to = max(at + 1, np.searchsorted(total[begins[at + 1 :] - 1], done + PATHS, "right") + at)
        l, h = begins[at], begins[to]
        at = to
        pairs = [_spread(w[0][l:h], c[l:h]) for w, c in zip(windows, counts)]
        i, j = np.concatenate([k for k, _ in pairs]) + l, np.concatenate([k for _, k in pairs])
        ahead = target[j] > a[i]
        i, j = i[ahead], j[ahead]
        bend = dot(side(a[i], m[i]), side(m[i], target[j]))
        bent = bend <= 4 * limits.angle
        i, j, bend = i[bent], j[bent], bend[bent]
        ends = a[i] * len(x) + target[j]
        order = np.argsort(ends, kind="stable")
        sharp = np.flatnonzero(bend <= limits.angle)
        first = np.searchsorted(ends[order], ends[sharp])
        b, d = _spread(first, np.searchsorted(ends[order], ends[sharp], "right") - first)
        b, d = sharp[b], order[d]
        once = e[i[b]] < e[i[d]]
        b, d = b[once], d[once]
        corners = (a[i[b]], m[i[b]], target[j[b]], m[i[d]])
        ab, bc, cd, da = (side(corners[k], corners[(k + 1) % 4]) for k in range(4))
        good = np.minimum.reduce([length(v) for v in (ab, bc, cd, da)]) >= limits.edge
        good &= (dot(ab, bc) <= limits.angle) & (dot(bc, cd) <= limits.angle) & (cross(ab, cd) <= limits.angle) & (cross(bc, da) <= limits.angle)
        good &= even(ab, cd) & even(bc, da) & (np.abs(ab[0] * bc[1] - ab[1] * bc[0]) >= limits.area)
        flat, tall = (lambda v: np.abs(v[1]) <= limits.snap), (lambda v: np.abs(v[0]) <= limits.snap)
        along = (flat(ab) & tall(bc)) | (tall(ab) & flat(bc))
        edges = np.column_stack((e[i[b]], via[j[b]], via[j[d]], e[i[d]]))[good]
        found.append((np.column_stack(corners)[good], edges, along[good]))
    corners, edges, along = (np.concatenate(k) for k in zip(*found))
    order = np.lexsort((edges[:, 1], edges[:, 3], edges[:, 0], corners[:, 0]))
    used, kept = bytearray(len(x1)), []
    for k, (s, t, u, v) in zip(order.tolist(), edges[order].tolist()):
        if not (used[s] or used[t] or used[u] or used[v]):
            used[s] = used[t] = used[u] = used[v] = 1
            kept.append(k)
    return x[corners[kept]], y[corners[kept]], edges[kept], along[kept]


def _segments(table: pa.Table, same: float):
    """Of contours in their order: contour (its row), number and ends of each segment. See paths.contour_segments."""
    lists = _one(table["xs"])
    offsets, n = lists.offsets.to_numpy(), table.num_rows
    (x, there), (y, too) = _numbers(lists.values), _numbers(_one(table["ys"]).values)
    there = there & too
    size = np.diff(offsets)
    shut = pc.fill_null(_one(table["is_closed"]), False).to_numpy(zero_copy_only=False)
    contour, u = _spread(offsets[:-1].astype(np.int64), np.where(size > 1, size - 1 + shut, 0))
    v = np.where(u == (offsets[1:] - 1)[contour], offsets[:-1][contour], u + 1)
    kept = there[u] & there[v] & ~((np.abs(x[u] - x[v]) <= same) & (np.abs(y[u] - y[v]) <= same))
    contour, u, v = contour[kept], u[kept], v[kept]
    number = np.arange(len(contour)) - np.searchsorted(contour, np.arange(n))[contour] + 1
    return contour, number, x[u], y[u], x[v], y[v]


def group(mode: str, keep: tuple[str, ...], limits, same: float):
    """A function for applyInArrow over the contours (file, page, group_key, path, contour, xs, ys, is_closed, keep) of one group.

    lines: the segments that no rectangle takes. rectangles: those that are kept, numbered, with the group's first segment. counts: lines,
    rectangles along the axes and others."""

    def run(table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table, sort_keys=[("path", "ascending"), ("contour", "ascending")])).combine_chunks()
        contour, number, x1, y1, x2, y2 = _segments(table, same)
        of = lambda c, k: _one(table[c]).take(pa.array(contour[k]))
        long = np.flatnonzero(~(np.sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) < limits.edge))
        cx, cy, edges, along = rectangles(x1[long], y1[long], x2[long], y2[long], limits) if len(long) else (np.zeros((0, 4)), np.zeros((0, 4)), np.zeros((0, 4), np.int64), np.zeros(0, bool))
        if mode == "counts":
            one = lambda c: _one(table[c]).slice(0, 1)
            return pa.table([one("file"), one("page"), *(pa.array([int(k)], pa.int64()) for k in (len(long) - edges.size, along.sum(), len(along) - along.sum()))], ["file", "page", "lines", "rectangles", "polylines"])
        if mode == "lines":
            rest = np.delete(long, edges.ravel())
            return pa.table([*[of(c, rest) for c in ("file", "page", "path", "contour")], pa.array(number[rest], pa.int32()), *[pa.array(c[rest]) for c in (x1, y1, x2, y2)], *[of(c, rest) for c in keep]], ["file", "page", "path", "contour", "segment", "x1", "y1", "x2", "y2", *keep])
        edges = long[edges] if len(long) else edges
        ord_ = lambda k: pa.StructArray.from_arrays([of("path", k), of("contour", k), pa.array(number[k], pa.int32())], ["path", "contour", "segment"])
        fours = lambda v: pa.ListArray.from_arrays(pa.array(np.arange(len(edges) + 1) * 4, pa.int32()), v)
        head = edges[:, 0]
        begin = ord_(np.zeros(len(edges), np.int64))
        return pa.table([*[of(c, head) for c in ("file", "page", "group_key")], begin, pa.array(np.arange(len(edges)) + 1), pa.array(along), fours(_points(cx.ravel(), cy.ravel())), fours(ord_(edges.ravel())), *[of(c, head) for c in keep]],
                        ["file", "page", "group_key", "begin", "inner", "axis_aligned", "corners", "edge_ords", *keep])

    return run
