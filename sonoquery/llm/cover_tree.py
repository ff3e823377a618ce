"""Near-duplicate embeddings: exact threshold pairs by dual traversal of cover trees.

Vectors are points of the unit sphere and their angle is the metric.  A tree has nested
levels: the nodes of a level split those of the level above into centers that are more
than half the radius above apart, with the points next to them.  Every node keeps the
*measured* angle of its farthest point, so a pair of nodes whose centers are farther apart
than both radii and the threshold's angle holds no pair and is pruned with all below it,
and one whose centers and radii stay below that angle holds links only and is counted
without being opened.

How it is dealt over a cluster:

* Equal vectors are one class (with a count), so exact copies cost one point.
* The upper levels are fitted on a bounded sample (``SAMPLE`` classes of least digest); every
  class is indexed below them.  Leaves that follow one another make units of about ``BLOCK`` points; a leaf
  with more points is dealt to several blocks by digest.  Radii of units are measured over all their points.
* Pairs of units are pruned, or taken whole, by the bounds on the driver: there are at most as many units
  as sample points.  What is left are pairs of blocks, each one row of a join.
* Every block's own tree is built once, and travels with the block.  A task traverses two trees and gives counts
  and a spanning forest of what it found, never all pairs.

Pruning depends on the data: where vectors are spread evenly over many dimensions, the bounds
of the upper levels cut nothing and block pairs grow with the square of the number of classes; the result is exact either way.

Defined results: a vector that is null, empty or zero, or holds a null, NaN or infinite component, links with
nothing.  Vectors of different lengths don't link.  Each row is a vector of its own, repeated and null
ids too; a component is named by its least id that isn't null (null if there is none), and ``kept`` is false for null ids.
The columns of the input that aren't asked for are dropped, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import components
from .frames import cut, drop_cut, named, small_batches
from .words import trim

#: Classes that the upper levels are fitted on, at most.
SAMPLE = 1024
#: Points of a block, and bytes of its vectors, at most (a single vector may be larger).
BLOCK, BLOCK_BYTES = 8192, 4 << 20
#: Radii of the levels, halved from the root's.
RADII = tuple(math.pi / 2**k for k in range(1, 7))
#: Slack of bounds: angles of nearly equal unit vectors are known to about 1e-8.
SLACK = 1e-6
#: Pairs of points that are compared at a time.
CHUNK = 1 << 15


# --- one tree ---------------------------------------------------------------------------


def _angle(cosine: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosine, -1.0, 1.0))


def _net(points: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """Greedy net: places of the centers, and each point's center (a number of that list)."""
    near, chosen, of = math.cos(radius), [], np.zeros(len(points), np.int64)
    for at in range(0, len(points), 1024):
        part = points[at : at + 1024]
        left = np.arange(len(part))
        if chosen:
            reach = part @ points[chosen].T
            best = reach.argmax(1)
            of[at : at + 1024] = best
            left = left[reach[left, best] < near]
        if len(left) == 1 or (len(left) and len(part) == 1):
            of[at + left] = len(chosen)
            chosen.append(at + int(left[0]))
        elif len(left):
            within = (part[left] @ part[left].T) >= near
            np.fill_diagonal(within, True)
            free = np.ones(len(left), bool)
            for i in range(len(left)):
                if free[i]:
                    mine = within[i] & free
                    of[at + left[mine]] = len(chosen)
                    chosen.append(at + int(left[i]))
                    free &= ~mine
    return np.array(chosen, np.int64), of


class Tree:
    """Nested levels over ``points``, whose order makes every node a slice.

    ``order`` gives the points' places in the input.  Level k has ``starts[k]`` (nodes + 1
    of them), ``centers[k]`` (places in the new order), ``radii[k]`` and ``below[k]``, where each node's children start in level k + 1.
    """

    def __init__(self, points: np.ndarray, radii: tuple[float, ...] = RADII):
        n = len(points)
        order = np.arange(n)
        starts, levels = [np.array([0, n])], [np.zeros(1, np.int64)]
        for radius in radii:
            cuts, centers, bounds = [0], [], starts[-1]
            for lo, hi in zip(bounds[:-1], bounds[1:]):
                own = order[lo:hi].copy()
                if hi - lo > 1:
                    at, of = _net(points[own], radius)
                    by = np.argsort(of, kind="stable")
                    order[lo:hi] = own[by]
                    cuts.extend((lo + np.cumsum(np.bincount(of, minlength=len(at)))).tolist())
                    centers.extend(own[at].tolist())
                else:
                    cuts.append(int(hi))
                    centers.append(int(own[0]))
            starts.append(np.array(cuts))
            levels.append(np.array(centers))
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        levels[0][:] = order[0] if n else 0
        self.order, self.starts, self.centers = order, starts, [place[c] for c in levels]
        self.measure(points[order])

    def measure(self, points: np.ndarray) -> None:
        self.radii = []
        for starts, centers in zip(self.starts, self.centers):
            of = np.repeat(np.arange(len(centers)), np.diff(starts))
            self.radii.append(np.maximum.reduceat(_angle(np.einsum("ij,ij->i", points, points[centers[of]])), starts[:-1]))
        self.link()

    def link(self) -> None:
        self.below = [np.searchsorted(after, starts) for starts, after in zip(self.starts, self.starts[1:])]

    def packed(self) -> dict[str, bytes]:
        flat = lambda parts, kind: np.concatenate(parts).astype(kind).tobytes()
        return {"sizes": np.array([len(c) for c in self.centers], "<i4").tobytes(), "starts": flat(self.starts, "<i4"), "centers": flat(self.centers, "<i4"), "radii": flat(self.radii, "<f8")}

    @classmethod
    def unpacked(cls, sizes: bytes, starts: bytes, centers: bytes, radii: bytes) -> Tree:
        tree = cls.__new__(cls)
        n = np.frombuffer(sizes, "<i4").astype(np.int64)
        split = lambda data, kind, more: np.split(np.frombuffer(data, kind), np.cumsum(n + more)[:-1])
        tree.starts = [x.astype(np.int64) for x in split(starts, "<i4", 1)]
        tree.centers = [x.astype(np.int64) for x in split(centers, "<i4", 0)]
        tree.radii = split(radii, "<f8", 0)
        tree.link()
        return tree


# --- two trees --------------------------------------------------------------------------


def _expanded(a_lo: np.ndarray, a_n: np.ndarray, b_lo: np.ndarray, b_n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All (i, j) of the pairs of ranges."""
    many = a_n * b_n
    pair = np.repeat(np.arange(len(many)), many)
    k = np.arange(len(pair)) - np.repeat(np.cumsum(many) - many, many)
    return a_lo[pair] + k // b_n[pair], b_lo[pair] + k % b_n[pair]


def _products(a: np.ndarray, b: np.ndarray, a_lo: np.ndarray, a_n: np.ndarray, b_lo: np.ndarray, b_n: np.ndarray, floor) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, cosine) of the pairs of ranges of rows of ``a`` and ``b``, in bounded pieces.

    Large pairs of ranges are matrix products, of which only what reaches ``floor(i, the ranges' number)`` is
    given; small ones are put together.
    """
    many = a_n * b_n
    for p in np.flatnonzero(many >= 2048):
        right = b[b_lo[p] : b_lo[p] + b_n[p]]
        step = max(1, (1 << 21) // len(right))
        for lo in range(a_lo[p], a_lo[p] + a_n[p], step):
            hi = min(lo + step, a_lo[p] + a_n[p])
            reach = a[lo:hi] @ right.T
            i, j = np.nonzero(reach >= floor(np.arange(lo, hi), p)[:, None])
            for at in range(0, len(i), CHUNK):
                yield lo + i[at : at + CHUNK], b_lo[p] + j[at : at + CHUNK], reach[i[at : at + CHUNK], j[at : at + CHUNK]]
    small = np.flatnonzero((many > 0) & (many < 2048))
    total = np.cumsum(many[small])
    at = 0
    while at < len(small):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + CHUNK, side="right")))
        p = small[at:end]
        i, j = _expanded(a_lo[p], a_n[p], b_lo[p], b_n[p])
        yield i, j, np.einsum("ij,ij->i", a[i], b[j])
        at = end


class Found:
    """Counts and unions that a traversal of two blocks gathers."""

    def __init__(self, n: int, m: int):
        self.n, self.label = n, np.arange(n + m)
        self.count = np.zeros(n + m, np.int64)
        self.joined: list[tuple[int, int]] = []

    def union(self, i: np.ndarray, j: np.ndarray) -> None:
        label = self.label
        while True:
            least = np.minimum(label[i], label[j])
            open_ = (label[i] != least) | (label[j] != least)
            if not open_.any():
                return
            i, j, least = i[open_], j[open_], least[open_]
            for ends in (label[i], label[j], i, j):
                np.minimum.at(label, ends, least)
            while True:
                after = label[label]
                if (after == label).all():
                    break
                label[:] = after


def links(a: Tree, x: np.ndarray, x_n: np.ndarray, b: Tree, y: np.ndarray, y_n: np.ndarray, threshold: float, same: bool) -> Found:
    """Links of two blocks of unit vectors in tree order (``same``: of one block with itself).

    ``count`` holds for each row of x, then of y, how many rows of the other block link with it, each counted ``n`` times.
    """
    theta = math.acos(threshold)
    found = Found(len(x), 0 if same else len(y))
    at_y = 0 if same else len(x)
    count_x, count_y = found.count[: len(x)], found.count[at_y:]
    sums_x, sums_y = np.concatenate([[0], np.cumsum(x_n)]), np.concatenate([[0], np.cumsum(y_n)])
    pa_, pb = np.zeros(1, np.int64), np.zeros(1, np.int64)
    for k in range(len(a.centers)):
        # children of the pairs that are left (the roots' own pair at first)
        if k:
            a_lo, a_n = a.below[k - 1][pa_], a.below[k - 1][pa_ + 1] - a.below[k - 1][pa_]
            b_lo, b_n = b.below[k - 1][pb], b.below[k - 1][pb + 1] - b.below[k - 1][pb]
        else:
            a_lo, a_n, b_lo, b_n = np.zeros(1, np.int64), np.ones(1, np.int64), np.zeros(1, np.int64), np.ones(1, np.int64)
        ra, rb = a.radii[k], b.radii[k]
        widest = np.array([rb[lo : lo + n].max() if m * n >= 2048 else 0.0 for lo, n, m in zip(b_lo, b_n, a_n)]) if len(b_lo) else np.zeros(0)
        floor = lambda i, p: np.cos(np.minimum(math.pi, ra[i] + widest[p] + theta + 2 * SLACK)) - SLACK  # noqa: E731, B023
        kept_a, kept_b = [], []
        for i, j, cosine in _products(x[a.centers[k]], y[b.centers[k]], a_lo, a_n, b_lo, b_n, floor):
            apart, both = _angle(cosine), ra[i] + rb[j]
            whole = apart + both <= theta - SLACK
            for s, t in zip(i[whole], j[whole]):
                s0, s1, t0, t1 = a.starts[k][s], a.starts[k][s + 1], b.starts[k][t], b.starts[k][t + 1]
                count_x[s0:s1] += sums_y[t1] - sums_y[t0]
                if same:
                    if s == t:
                        count_x[s0:s1] -= x_n[s0:s1]
                else:
                    count_y[t0:t1] += sums_x[s1] - sums_x[s0]
                found.joined += [(s0, s1), (at_y + t0, at_y + t1), (s0, at_y + t0)]
            left = ~whole & (apart <= both + theta + SLACK)
            kept_a.append(i[left])
            kept_b.append(j[left])
        pa_, pb = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (kept_a, kept_b))
    # leaves: every pair of points decides by its own cosine
    last = len(a.centers) - 1
    a_lo, a_n = a.starts[last][pa_], a.starts[last][pa_ + 1] - a.starts[last][pa_]
    b_lo, b_n = b.starts[last][pb], b.starts[last][pb + 1] - b.starts[last][pb]
    for i, j, cosine in _products(x, y, a_lo, a_n, b_lo, b_n, lambda i, p: np.full(len(i), threshold - 1e-9)):
        for e in np.flatnonzero(np.abs(cosine - threshold) < 1e-12):  # so close that rounding decides: sums without rounding
            u, v = x[i[e]], y[j[e]]
            cosine[e] = math.fsum(u * v) / math.sqrt(math.fsum(u * u)) / math.sqrt(math.fsum(v * v))
        linked = cosine >= threshold
        if same:
            linked &= i != j
        i, j = i[linked], j[linked]
        np.add.at(count_x, i, y_n[j])
        if not same:
            np.add.at(count_y, j, x_n[i])
        found.union(i, at_y + j)
    if found.joined:  # slices of nodes taken whole, and their pairs
        spans = dict.fromkeys(span for span in found.joined[0::3] + found.joined[1::3] if span[1] - span[0] > 1)
        ends = found.joined[2::3]
        i = np.concatenate([*(np.arange(lo + 1, hi) for lo, hi in spans), [s for s, _ in ends]]).astype(np.int64)
        j = np.concatenate([*(np.full(hi - lo - 1, lo) for lo, hi in spans), [t for _, t in ends]]).astype(np.int64)
        found.union(i, j)
    return found


# --- tables -----------------------------------------------------------------------------


def _units(points: np.ndarray) -> np.ndarray:
    """Unit vectors in double precision; scaled by the largest component first, so nothing overflows."""
    points = points.astype(np.float64)
    points = points / np.abs(points).max(1, keepdims=True)
    return points / np.sqrt(np.einsum("ij,ij->i", points, points))[:, None]


def _vectors(column: pa.Array, kind: str, dim: int) -> np.ndarray:
    """Rows of vectors from their bytes, all of one length."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, dim)


def _digests(kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = 0
        for batch in batches:
            ids, vectors = batch.column(0), batch.column(1)
            keys, dims, data = [], [], []
            for v in vectors:
                flat = v.values if v.is_valid else None
                point = None
                if flat is not None and len(flat) and not flat.null_count:
                    point = flat.to_numpy(zero_copy_only=False).astype(kind)
                    if not np.isfinite(point).all() or not point.any():
                        point = None
                if point is None:  # a key of its own and of another length: equal to no other
                    number += 1
                    keys.append(hashlib.blake2b(f"{number}".encode(), digest_size=17).digest())
                    dims.append(None)
                    data.append(None)
                else:
                    data.append(point.tobytes())
                    keys.append(hashlib.blake2b(data[-1], digest_size=16).digest())
                    dims.append(len(point))
            yield pa.record_batch([ids, pa.array(keys, pa.binary()), pa.array(dims, pa.int32()), pa.array(data, pa.binary())], ["id", "key", "dim", "vec"])

    return run


class _Upper:
    """Upper levels over the sample: cells in the order of the tree, and each cell's unit."""

    def __init__(self, sample: dict[int, np.ndarray]):
        self.trees: dict[int, tuple[Tree, np.ndarray, int]] = {}
        self.n_cells = 0
        for dim, points in sorted(sample.items()):
            tree = Tree(points, RADII[:4])
            points = points[tree.order]
            self.trees[dim] = (tree, [points[c] for c in tree.centers], self.n_cells)
            self.n_cells += len(tree.centers[-1])

    def cell(self, dim: int, points: np.ndarray) -> np.ndarray:
        """Cells of points: the nearest child at every level.  Lengths that the sample lacks are the cell -1 - dim."""
        if dim not in self.trees:
            return np.full(len(points), -1 - dim, np.int64)
        tree, centers, base = self.trees[dim]
        node = np.zeros(len(points), np.int64)
        for k in range(1, len(centers)):
            out = np.empty_like(node)
            by = np.argsort(node, kind="stable")
            for own in np.split(by, np.flatnonzero(np.diff(node[by])) + 1):
                if len(own):
                    lo, hi = tree.below[k - 1][node[own[0]]], tree.below[k - 1][node[own[0]] + 1]
                    out[own] = lo + ((points[own] @ centers[k][lo:hi].T).argmax(1) if hi - lo > 1 else 0)
            node = out
        return base + node

    def units(self, rows: dict[int, int]) -> list[tuple[int, list[int], int]]:
        """(dim, cells, blocks): cells that follow one another under one node, up to ``BLOCK`` points; larger cells alone, dealt to blocks."""
        out: list[tuple[int, list[int], int]] = []
        for dim, (tree, centers, base) in self.trees.items():
            limit = min(BLOCK, max(1, BLOCK_BYTES // (8 * dim)))
            last = len(centers) - 1
            counts = np.array([rows.get(base + c, 0) for c in range(len(centers[last]))])

            def walk(k: int, node: int) -> None:
                first, end = (int(np.searchsorted(tree.starts[last], tree.starts[k][node + d])) for d in (0, 1))  # noqa: B023
                if counts[first:end].sum() <= limit:  # noqa: B023
                    out.append((dim, [base + c for c in range(first, end)], 1))  # noqa: B023
                elif k == last:  # noqa: B023
                    out.append((dim, [base + first], -(-int(counts[first]) // limit)))  # noqa: B023
                else:
                    begun = len(out)
                    for child in range(tree.below[k][node], tree.below[k][node + 1]):  # noqa: B023
                        walk(k + 1, int(child))
                    parts, merged, size = out[begun:], [], 0
                    for part in parts:
                        own = sum(rows.get(c, 0) for c in part[1])
                        if part[2] == 1 and merged and merged[-1][2] == 1 and size + own <= limit:  # noqa: B023
                            merged[-1] = (dim, merged[-1][1] + part[1], 1)  # noqa: B023
                            size += own
                        else:
                            merged.append(part)
                            size = own
                    out[begun:] = merged

            walk(0, 0)
        for cell, n in rows.items():
            if cell < 0:
                dim = -1 - cell
                out.append((dim, [cell], -(-n // min(BLOCK, max(1, BLOCK_BYTES // (8 * dim))))))
        return [u for u in out if sum(rows.get(c, 0) for c in u[1])]


_CELLS = T.StructType([T.StructField("key", T.BinaryType()), T.StructField("dim", T.IntegerType()), T.StructField("vec", T.BinaryType()), T.StructField("n", T.LongType()), T.StructField("cell", T.LongType())])


def _by_dim(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    dims = batch.column("dim").to_numpy(zero_copy_only=False)
    for dim in np.unique(dims):
        yield int(dim), np.flatnonzero(dims == dim)


def near_duplicates(df: DataFrame, id: str = "vec_id", vector: str = "embedding", threshold: float = 0.95) -> DataFrame:
    """(id, n_links, component_id, kept) of every row: how many other rows have a cosine of ``threshold`` or more with it, and the least id that links reach."""
    if not 0 < threshold < 1:
        raise ValueError("threshold must lie between 0 and 1")
    theta = math.acos(threshold)
    rows = small_batches(df).select(named(df, id).alias("id"), named(df, vector).alias("v"))
    kind = "<f4" if rows.schema["v"].dataType.elementType == T.FloatType() else "<f8"
    if kind == "<f8":
        rows = rows.withColumn("v", F.col("v").cast("array<double>"))
    rows = cut(rows.mapInArrow(_digests(kind), T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("key", T.BinaryType()), T.StructField("dim", T.IntegerType()), T.StructField("vec", T.BinaryType())])))
    classes = cut(rows.where(F.octet_length("key") == 16).groupBy("key").agg(F.first("dim").alias("dim"), F.first("vec").alias("vec"), F.count("*").alias("n"), F.min("id").alias("least")))

    sample: dict[int, list[bytes]] = {}
    for r in classes.orderBy("key").select("dim", "vec").limit(SAMPLE).collect():
        sample.setdefault(r["dim"], []).append(bytes(r["vec"]))
    upper = _Upper({dim: _units(np.frombuffer(b"".join(vs), kind).reshape(-1, dim)) for dim, vs in sample.items()})

    def in_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = np.zeros(len(batch), np.int64)
            for dim, own in _by_dim(batch):
                cells[own] = upper.cell(dim, _units(_vectors(batch.column("vec").take(pa.array(own)), kind, dim)))
            yield pa.record_batch([*(batch.column(c) for c in ("key", "dim", "vec", "n")), pa.array(cells)], ["key", "dim", "vec", "n", "cell"])

    placed = cut(classes.select("key", "dim", "vec", "n").mapInArrow(in_cells, _CELLS))
    totals = {r["cell"]: (r["rows"], r["n"]) for r in placed.groupBy("cell").agg(F.count("*").alias("rows"), F.sum("n").alias("n")).collect()}
    units = upper.units({c: r for c, (r, _) in totals.items()})
    centers: list[np.ndarray] = []
    for dim, cells, _ in units:
        if cells[0] < 0:
            center = np.eye(1, dim)[0]
        else:
            _, levels, base = upper.trees[dim]
            own = [levels[-1][c - base] for c in cells]
            mean = sum(p * totals.get(c, (0, 0))[0] for p, c in zip(own, cells))
            center = mean / np.linalg.norm(mean) if np.linalg.norm(mean) > 1e-6 else own[0]
        centers.append(center)
    unit_of = {c: u for u, (_, cells, _) in enumerate(units) for c in cells}
    blocks = np.array([b for _, _, b in units] or [1])

    def in_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit = np.array([unit_of[c] for c in batch.column("cell").to_pylist()], np.int64)
            first = np.frombuffer(b"".join(k[:4] for k in batch.column("key").to_pylist()), "<u4").astype(np.int64)
            apart = np.zeros(len(batch))
            for dim, own in _by_dim(batch):
                points = _units(_vectors(batch.column("vec").take(pa.array(own)), kind, dim))
                for u in np.unique(unit[own]):
                    mine = unit[own] == u
                    apart[own[mine]] = _angle(points[mine] @ centers[u])
            yield pa.record_batch([*(batch.column(c) for c in ("key", "dim", "vec", "n")), pa.array(unit.astype(np.int32)), pa.array((first % blocks[unit]).astype(np.int32)), pa.array(apart)], ["key", "dim", "vec", "n", "unit", "salt", "apart"])

    placed_in = placed.mapInArrow(in_units, "key binary, dim int, vec binary, n bigint, unit int, salt int, apart double")
    radius = np.zeros(len(units))
    for r in placed_in.groupBy("unit").agg(F.max("apart").alias("r")).collect():
        radius[r["unit"]] = r["r"]
    weight = np.array([sum(totals.get(c, (0, 0))[1] for c in cells) for _, cells, _ in units], np.int64)

    # pairs of units by the bounds; units taken whole add their weight and are one node of the components
    open_pairs: list[tuple[int, int]] = []
    extra, whole = np.zeros(len(units), np.int64), Found(len(units), 0)
    mutual = set()
    for dim in sorted({d for d, _, _ in units}):
        own = np.flatnonzero(np.array([d == dim for d, _, _ in units]))
        points = np.stack([centers[u] for u in own])
        for i, u in enumerate(own):
            apart = _angle(points[i:] @ points[i])
            apart[0] = 0.0
            both = radius[u] + radius[own[i:]]
            for v in own[i:][apart + both <= theta - SLACK]:
                extra[u] += weight[v] if u != v else 0
                extra[v] += weight[u]
                mutual |= {int(u), int(v)}
                whole.union(np.array([u]), np.array([v]))
            open_pairs += [(int(u), int(v)) for v in own[i:][(apart + both > theta - SLACK) & (apart <= both + theta + SLACK)]]

    spark = df.sparkSession
    payload = "unit int, salt int, dim int, keys binary, n binary, vecs binary, sizes binary, starts binary, centers binary, radii binary"

    def grown(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        dim = group.column("dim")[0].as_py()
        raw = _vectors(group.column("vec"), kind, dim)
        tree = Tree(_units(raw))
        keys = group.column("key").to_pylist()
        row = {"unit": group.column("unit")[0].as_py(), "salt": group.column("salt")[0].as_py(), "dim": dim, "keys": b"".join(keys[i] for i in tree.order), "n": group.column("n").to_numpy()[tree.order].astype("<i8").tobytes(), "vecs": raw[tree.order].tobytes()}
        row |= tree.packed()
        trim()
        return pa.Table.from_pylist([row], schema=pa.schema([(f.split()[0], pa.int32() if f.endswith("int") else pa.binary()) for f in payload.split(", ")]))

    trees = cut(placed_in.drop("apart").groupBy("unit", "salt").applyInArrow(grown, payload), row_group=16 << 20)

    def both_ways(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                sides = []
                for s in ("a", "b"):
                    r = row[s]
                    raw = np.frombuffer(r["vecs"], kind).reshape(-1, r["dim"])
                    sides.append((Tree.unpacked(r["sizes"], r["starts"], r["centers"], r["radii"]), _units(raw), np.frombuffer(r["n"], "<i8"), np.frombuffer(r["keys"], "V16")))
                    if row["same"]:
                        sides *= 2
                        break
                (ta, x, xn, xk), (tb, y, yn, yk) = sides
                found = links(ta, x, xn, tb, y, yn, threshold, row["same"])
                keys = xk if row["same"] else np.concatenate([xk, yk])
                own = np.flatnonzero(found.count)
                yield pa.record_batch([pa.array([k.tobytes() for k in keys[own]], pa.binary()), pa.array(found.count[own]), pa.array([k.tobytes() for k in keys[found.label[own]]], pa.binary())], ["key", "links", "other"])
                trim()

    # each pair of blocks once, its first side by parity, so that every block is first as often as second
    asked = spark.createDataFrame([(u, v, int(blocks[u]), int(blocks[v])) for u, v in open_pairs], "u int, v int, us int, vs int")
    asked = asked.select("u", "v", "vs", F.explode(F.sequence(F.lit(0), F.col("us") - 1)).alias("s")).select("u", "s", "v", F.explode(F.sequence(F.lit(0), F.col("vs") - 1)).alias("t")).where("u <> v or s <= t")
    swap = F.pmod(F.hash("u", "s", "v", "t"), F.lit(2)) == 1
    first, second = F.struct("u", "s"), F.struct(F.col("v").alias("u"), F.col("t").alias("s"))
    asked = asked.select(F.when(swap, first).otherwise(second).alias("p"), F.when(swap, second).otherwise(first).alias("q")).select(F.col("p.u").alias("pu"), F.col("p.s").alias("ps"), F.col("q.u").alias("qu"), F.col("q.s").alias("qs"))
    block = F.struct("dim", "keys", "n", "vecs", "sizes", "starts", "centers", "radii")
    same = F.expr("pu = qu AND ps = qs")
    joined = asked.join(trees.select(F.col("unit").alias("qu"), F.col("salt").alias("qs"), block.alias("b")).hint("merge"), ["qu", "qs"]).select("pu", "ps", same.alias("same"), F.when(~same, F.col("b")).alias("b"))
    joined = joined.join(trees.select(F.col("unit").alias("pu"), F.col("salt").alias("ps"), block.alias("a")).hint("merge"), ["pu", "ps"]).select("same", "a", "b")
    found = cut(joined.mapInArrow(both_ways, "key binary, links bigint, other binary"))

    counts, edges = found.groupBy("key").agg(F.sum("links").alias("links")), found.where("key <> other").select(F.col("key").alias("a"), F.col("other").alias("b"))
    if mutual:
        named_by = spark.createDataFrame([(u, int(extra[u]), hashlib.blake2b(f"unit {whole.label[u]}".encode(), digest_size=18).digest()) for u in sorted(mutual)], "unit int, extra bigint, other binary")
        not_within = {u for u, v in open_pairs if u == v}
        alone = sorted(mutual & not_within)  # linked with others whole, but not within
        members = placed_in.select("key", "unit", "n").join(F.broadcast(named_by), "unit")
        counts = counts.unionByName(members.select("key", (F.col("extra") - F.when(F.col("unit").isin(alone), 0).otherwise(F.col("n"))).alias("links"))).groupBy("key").agg(F.sum("links").alias("links"))
        edges = edges.unionByName(members.select(F.col("key").alias("a"), F.col("other").alias("b")))
    groups = components(edges)
    known = classes.select("key", "n", "least").join(counts, "key", "left").join(groups.select(F.col("node").alias("key"), "component"), "key", "left")
    known = cut(known.select("key", "n", "least", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "key").alias("component")))
    least = known.groupBy("component").agg(F.min("least").alias("component_id"))
    of_class = cut(known.join(least, "component").select("key", (F.col("links") + F.col("n") - 1).alias("links"), "component_id"))
    out = rows.select("id", "key").join(of_class, "key", "left")
    component = F.when(F.col("links").isNull(), F.col("id")).otherwise(F.col("component_id"))
    for old in (classes, placed, trees, found, known):
        drop_cut(old)
    return out.select(F.col("id").alias(id), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))
