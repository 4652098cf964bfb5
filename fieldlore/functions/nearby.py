"""Nearest values and links without all pairs: values are cut into leaves, and leaves whose least possible dissimilarity is too large aren't looked into.

A leaf holds values of one length that are alike, and the least and the greatest byte of each place. The bounds are exact, so that results are those
of all pairs; where they don't part values (long random ones), all pairs are compared.
"""

from __future__ import annotations

import math

import numpy as np

from fieldlore.functions import embeddings as E

#: Values of a leaf at least, leaves looked into at first, by how much more each time, and what bounds are relaxed by against rounding.
LEAF, FIRST, MORE, SLACK = 64, 6, 4, 1e-9
#: Cells of the tables of least terms at most; larger ones aren't made.
TABLE = 1 << 22


def _ranges(rows: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Least term of each byte (rows) against any from low to high (columns)."""
    a = rows[:, None]
    return np.where(a < low, E.TERMS[a, low], np.where(a > high, E.TERMS[a, high], 0.0))


def _cut(data: np.ndarray, size: int) -> list[np.ndarray]:
    """Rows by leaf: cut at the middle of the byte that differs most, until so many are left."""
    left, out = [np.arange(len(data))], []
    while left:
        rows = left.pop()
        low, high = data[rows].min(0), data[rows].max(0)
        k = int(E.TERMS[low, high].argmax())
        if len(rows) <= size or low[k] == high[k]:
            out.append(rows)
            continue
        x = data[rows, k]
        middle = np.partition(x, len(x) // 2)[len(x) // 2]
        under = x < middle if middle > low[k] else x <= middle
        left += [rows[~under], rows[under]]
    return out


class Index:
    """Values that aren't empty (ids, bytes) in leaves; places count values by length and leaf."""

    def __init__(self, ids: np.ndarray, values: list[bytes], leaf: int | None = None) -> None:
        order = sorted((k for k in range(len(values)) if values[k]), key=lambda k: (len(values[k]), values[k]))
        size = leaf or max(LEAF, math.isqrt(len(order)) // 4)
        #: by length: first place, bytes, least and greatest bytes of leaves
        self.parts: dict[int, tuple] = {}
        place, starts, at = [], [], 0
        for own, data in E.by_length([values[k] for k in order]):
            cut = _cut(data, size)
            inside = np.concatenate(cut)
            data, first = data[inside], np.cumsum([0, *map(len, cut[:-1])])
            self.parts[data.shape[1]] = at, data, np.minimum.reduceat(data, first), np.maximum.reduceat(data, first)
            starts += (at + first).tolist()
            place.append(own[inside])
            at += len(data)
        self.ids = np.asarray(ids)[np.array(order, int)[np.concatenate(place)]] if place else np.asarray(ids)[:0]
        #: by length and place the least term of each byte against each leaf, made when it is first needed
        self.terms: dict[tuple[int, int], np.ndarray] = {}
        self.tabled = at >= 256 and 256 * sum(p[2].size for p in self.parts.values()) <= TABLE
        #: places of each leaf: from bounds[k] to bounds[k + 1]
        self.bounds = np.array([*starts, at])

    @property
    def leaves(self) -> int:
        return len(self.bounds) - 1

    def rows(self, leaf: int) -> np.ndarray:
        return np.arange(self.bounds[leaf], self.bounds[leaf + 1])

    def _bytes(self, places: np.ndarray) -> np.ndarray:
        """Bytes of places of one length."""
        at, data, *_ = self._part(places[0])
        return data[places - at]

    def _part(self, place: int) -> tuple:
        return next(p for p in self.parts.values() if p[0] <= place < p[0] + len(p[1]))

    def _least(self, rows: np.ndarray, size: int, k: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        if not self.tabled:
            return _ranges(rows, low[:, k], high[:, k])
        if (size, k) not in self.terms:
            self.terms[size, k] = _ranges(np.arange(256), low[:, k], high[:, k])
        return self.terms[size, k].take(rows, axis=0)

    def least(self, places: np.ndarray, relief: float = 0.33) -> np.ndarray:
        """Bounds below the dissimilarities of places of one length to all values of each leaf."""
        x = self._bytes(places)
        n, out = x.shape[1], []
        for size, (_, _, low, high) in sorted(self.parts.items()):
            i, o, best = min(n, size), max(n, size), None
            for s in range(min(6, o - i) + 1):
                now = np.zeros((len(x), len(low)))
                for k in range(i):
                    now += self._least(x[:, s + k], size, k, low, high) if n > size else self._least(x[:, k], size, s + k, low, high)
                best = now if best is None else np.minimum(best, now)
            best /= i
            if i < o:
                r, p = (o - i) / o, i / (o * o)
                best = (1 - r) * best + r + r * p * (1 - best) - relief * r * (1 - best)
            out.append(best)
        return np.concatenate(out, axis=1)

    def inside(self, leaves: np.ndarray) -> np.ndarray:
        """Places of the values of leaves."""
        return np.concatenate([self.rows(k) for k in leaves]) if len(leaves) else np.zeros(0, int)

    def matrix(self, rows: np.ndarray, columns: np.ndarray, relief: float = 0.33, digits: int | None = None) -> np.ndarray:
        """Dissimilarities of places of one length to places in order."""
        x, out = self._bytes(rows), []
        for _, (at, data, *_) in sorted(self.parts.items()):
            y = data[columns[np.searchsorted(columns, at) : np.searchsorted(columns, at + len(data))] - at]
            if len(y):
                d = E.embedded(x, y, relief)[0] if x.shape[1] <= y.shape[1] else E.embedded(y, x, relief)[0].T
                out.append(d if digits is None else E.half_up(d, digits))
        return np.concatenate(out, axis=1) if out else np.zeros((len(rows), 0))

    def nearest(self, leaf: int, k: int, relief: float = 0.33, digits: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(i, j, d): the k nearest others of each value of a leaf, ties by id."""
        slack = SLACK if digits is None else 10.0**-digits
        rows, most, found = self.rows(leaf), FIRST, []
        bound = self.least(rows, relief)
        while len(rows):
            if most < self.leaves:
                near = np.argpartition(bound, most, axis=1)
                places = self.inside(np.unique(near[:, :most]))
                rest = np.take_along_axis(bound, near[:, most : most + 1], 1)[:, 0]
            else:
                places, rest = np.arange(self.bounds[-1]), np.full(len(rows), np.inf)
            done = np.zeros(len(rows), bool)
            for part in E.chunks(len(rows), len(places)):
                d = self.matrix(rows[part], places, relief, digits)
                d[rows[part][:, None] == places] = np.inf
                last = np.partition(d, k - 1, axis=1)[:, k - 1] if d.shape[1] >= k else np.full(len(d), np.inf)
                sure = (rest[part] > last + slack) | np.isinf(rest[part])
                if sure.any():
                    by_id = np.argsort(self.ids[places], kind="stable")
                    a, b = E.nearest(d[sure][:, by_id], k)
                    found.append((self.ids[rows[part][sure][a]], self.ids[places[by_id[b]]], d[sure][a, by_id[b]]))
                done[part] = sure
            rows, bound, most = rows[~done], bound[~done], most * MORE
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def codes(self, rows: np.ndarray, columns: np.ndarray, digits: int, relief: float = 0.33):
        """(rows, dissimilarities in units of the last digit) of places of one length to places in order, a part of the rows at a time."""
        for part in E.chunks(len(rows), len(columns)):
            yield rows[part], np.rint(self.matrix(rows[part], columns, relief, digits) * 10.0**digits).astype(np.int64)

    def value(self, place: int) -> bytes:
        return self._bytes(np.array([place]))[0].tobytes()

    def walk(self, places: np.ndarray, start: int, digits: int, relief: float = 0.33) -> tuple[np.ndarray, np.ndarray]:
        """(places, way there in units of the last digit, -1 at the start): from start always on to the nearest one not yet met, ties by id."""
        unit, at, path, way = 10.0**digits, start, [start], [-1]
        left, gone, parts = places, places == start, None
        for _ in range(len(places) - 1):
            if parts is None or gone.sum() > 64 + len(left) // 8:
                left, gone = left[~gone], np.zeros((~gone).sum(), bool)
                parts = [data[left[(left >= a) & (left < a + len(data))] - a] for _, (a, data, *_) in sorted(self.parts.items())]
            x = self._bytes(np.array([at]))
            d = np.concatenate([E.embedded(x, y, relief)[0][0] if x.shape[1] <= y.shape[1] else E.embedded(y, x, relief)[0][:, 0] for y in parts if len(y)])
            d[gone] = np.inf
            # only what may round to the least is rounded
            near = np.flatnonzero(d <= d.min() + 1.5 / unit)
            code = np.rint(E.half_up(d[near], digits) * unit).astype(np.int64)
            near = near[code == code.min()]
            k = near[self.ids[left[near]].argmin()]
            gone[k], at = True, int(left[k])
            path.append(at)
            way.append(int(code.min()))
        return np.array(path), np.array(way)

    def trace(self, places: np.ndarray, start: int, digits: int, relief: float = 0.33) -> tuple[float, float]:
        """Of places in order of distance from start, ties by id: the mean distance of neighbours, and the distance of the first and the last one."""
        away = next(self.codes(np.array([start]), places, digits, relief))[1][0]
        values = [self.value(k) for k in places[np.lexsort((self.ids[places], away))]]
        total, step = 0, 32
        for k in range(0, len(values) - 1, step):
            d = E.matrix(values[k : k + step], values[k + 1 : k + 1 + step], relief, digits=digits)[0]
            total += int(np.rint(d.diagonal() * 10.0**digits).sum())
        return total / 10.0**digits / (len(values) - 1), float(E.matrix(values[:1], values[-1:], relief, digits=digits)[0][0, 0])

    def links(self, leaf: int, label: np.ndarray, eps: float, relief: float = 0.33, digits: int | None = None) -> np.ndarray:
        """Pairs (a < b) of different labels, of a value of a leaf and another one at most eps away; labels by place, under 0 for values that don't link."""
        rows = self.rows(leaf)
        rows = rows[label[rows] >= 0]
        if not len(rows):
            return np.zeros((0, 2), np.int64)
        # leaves that hold another label than a row's, by how near they may be
        low = np.minimum.reduceat(np.where(label < 0, np.iinfo(np.int64).max, label), self.bounds[:-1])
        high = np.maximum.reduceat(label, self.bounds[:-1])
        own, out = label[rows], []
        other = (high >= 0) & ((low != own.min()) | (high != own.max()) | (own.min() != own.max()))
        reach = (self.least(rows, relief) <= eps + (SLACK if digits is None else 10.0**-digits)).any(0)
        places = self.inside(np.flatnonzero(other & reach))
        places = places[label[places] >= 0]
        for part in E.chunks(len(rows), len(places)):
            a, b = np.nonzero((self.matrix(rows[part], places, relief, digits) <= eps) & (own[part][:, None] != label[places]))
            if len(a):
                x = np.stack([own[part][a], label[places[b]]], 1)
                x.sort(1)
                out.append(np.unique(x, axis=0))
        return np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 2), np.int64)

    def merged(self, label: np.ndarray, eps: float, leaves, digits: int | None = None) -> np.ndarray:
        """For each label the smallest of those that links of values in these leaves connect it with; labels by place, numbers from 0 on, under 0 for values that don't link."""
        root = np.arange(label.max(initial=-1) + 1)
        for leaf in leaves:
            for a, b in self.links(leaf, np.where(label < 0, -1, root[label]), eps, digits=digits).tolist():
                x, y = sorted((int(root[a]), int(root[b])))
                if x != y:
                    root[root == y] = x
        return root


def joined(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, component) of edges: each node takes the smallest label beside it, until nothing changes."""
    nodes, place = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = place[: len(u)], place[len(u) :]
    label = np.arange(len(nodes))
    while True:
        new, low = label.copy(), np.minimum(label[a], label[b])
        for at in (label[a], label[b]):
            np.minimum.at(new, at, low)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            return nodes, nodes[label]
        label = new


def density(index: Index, found: tuple[np.ndarray, np.ndarray, np.ndarray], eps: float, least: int) -> np.ndarray:
    """Density clusters of values numbered from 0 on, given the nearest others (i, j, d) of each, least - 1 or more: numbers by the smallest core, noise -1."""
    n = len(index.ids)
    i, j, d = found
    i, j = i[d <= eps], j[d <= eps]
    core = np.bincount(i, minlength=n) + 1 >= least
    both = core[i] & core[j]
    label = np.where(core, np.arange(n), -1)
    nodes, component = joined(i[both], j[both])
    label[nodes] = component
    names, code = np.unique(label[core], return_inverse=True)
    label[core] = code
    root = index.merged(label[index.ids], eps, range(index.leaves)) if len(names) > 1 else np.zeros(len(names), int)
    label[core] = np.unique(root[code], return_inverse=True)[1]
    border = core[j] & ~core[i]
    near = np.full(n, n)
    np.minimum.at(near, i[border], label[j[border]])
    return np.where(core | (near == n), label, near)
