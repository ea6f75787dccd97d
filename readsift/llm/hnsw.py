"""Hierarchical navigable small-world graphs over unit vectors, built and searched in batches of array operations.

Points join in batches: each batch is searched in the graph so far and compared with itself, then linked with diverse
neighbours in both directions. A search keeps a beam of the best points per query and expands the best unexpanded ones.
"""

from __future__ import annotations

import io

import numpy as np

#: Links of a point in the upper layers and in the lowest one, width of the beam while building, points that join at once.
M, M0, BUILD_BEAM, BATCH = 16, 32, 48, 256
#: Points of each beam that are expanded at once, at least; a wide beam expands a sixteenth.
STEP = 4


def _sims(vectors: np.ndarray, ids: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Similarity of each query to the points in its row of ids; -inf for -1."""
    out = np.full(ids.shape, -np.inf, np.float32)
    row, column = np.nonzero(ids >= 0)
    for a in range(0, len(row), 1 << 18):
        r, c = row[a : a + (1 << 18)], column[a : a + (1 << 18)]
        out[r, c] = np.einsum("ij,ij->i", vectors[ids[r, c]], queries[r])
    return out


def _unique_rows(ids: np.ndarray) -> np.ndarray:
    """Rows sorted downwards without repetitions; -1 fills what is left."""
    ids = -np.sort(-ids, axis=1)
    again = ids[:, 1:] == ids[:, :-1]
    ids[:, 1:][again] = -1
    return -np.sort(-ids, axis=1) if again.any() else ids


class Graph:
    def __init__(self, vectors: np.ndarray, seed: int = 0):
        self.vectors = np.ascontiguousarray(vectors, np.float32)
        n = len(self.vectors)
        draw = np.random.default_rng(seed).random(n)
        self.levels = np.minimum((-np.log(1 - draw) / np.log(M)).astype(np.int8), 8) if n else np.zeros(0, np.int8)
        self.links = [np.full((n, M0 if layer == 0 else M), -1, np.int32) for layer in range(int(self.levels.max(initial=0)) + 1)]
        self.entry, self.size = -1, 0

    @classmethod
    def build(cls, vectors: np.ndarray, seed: int = 0) -> Graph:
        g = cls(vectors, seed)
        order = np.argsort(-g.levels.astype(int), kind="stable")  # the upper layers first, then all below
        at = 0
        while at < len(order):
            batch = order[at : at + max(1, min(BATCH, g.size))]
            g._join(batch)
            at += len(batch)
        return g

    def save(self) -> bytes:
        sink = io.BytesIO()
        np.savez(sink, vectors=self.vectors, levels=self.levels, entry=self.entry, size=self.size, **{f"layer{i}": x for i, x in enumerate(self.links)})
        return sink.getvalue()

    @classmethod
    def load(cls, body: bytes) -> Graph:
        held = np.load(io.BytesIO(body))
        g = cls.__new__(cls)
        g.vectors, g.levels, g.entry, g.size = held["vectors"], held["levels"], int(held["entry"]), int(held["size"])
        g.links = [held[f"layer{i}"] for i in range(sum(k.startswith("layer") for k in held.files))]
        return g

    def _beam(self, queries: np.ndarray, start: np.ndarray, beam: int, layer: int) -> tuple[np.ndarray, np.ndarray]:
        """The best points of a layer for each query, downwards, from the points in ``start`` (rows of ids)."""
        b, links = len(queries), self.links[layer]
        ids = np.full((b, beam), -1, np.int64)
        sims = np.full((b, beam), -np.inf, np.float32)
        done = np.ones((b, beam), bool)
        visited = np.zeros((b, len(self.vectors) + 1), bool)  # the last column takes the -1s
        fresh = _unique_rows(start.astype(np.int64))[:, :beam]
        rows = np.arange(b)
        while len(rows):
            visited[rows[:, None], fresh] = True
            found = _sims(self.vectors, fresh, queries[rows])
            all_ids, all_sims = np.hstack([ids[rows], fresh]), np.hstack([sims[rows], found])
            all_done = np.hstack([done[rows], fresh < 0])
            if all_ids.shape[1] > beam:
                top = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
                all_ids, all_sims, all_done = (np.take_along_axis(x, top, 1) for x in (all_ids, all_sims, all_done))
            width = all_ids.shape[1]
            ids[rows, :width], sims[rows, :width], done[rows, :width] = all_ids, all_sims, all_done
            open_ = np.where(all_done, -np.inf, all_sims)
            more = np.isfinite(open_).any(1)
            rows, open_ = rows[more], open_[more]
            if not len(rows):
                break
            step = min(max(STEP, beam // 16), width)
            pick = np.argpartition(-open_, step - 1, axis=1)[:, :step] if width > step else np.broadcast_to(np.arange(width), (len(rows), width))
            good = np.isfinite(np.take_along_axis(open_, pick, 1))
            chosen = np.where(good, ids[rows[:, None], pick], -1)
            done[rows[:, None], pick] = True
            fresh = np.where(chosen[:, :, None] >= 0, links[chosen], -1).reshape(len(rows), -1).astype(np.int64)
            fresh[(fresh >= 0) & visited[rows[:, None], fresh]] = -1
            fresh = _unique_rows(fresh)
            fresh = fresh[:, : max(1, int((fresh >= 0).sum(1).max()))]
        order = np.argsort(-sims, axis=1)
        return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)

    def _descend(self, queries: np.ndarray, to: int) -> np.ndarray:
        """Points of layer ``to`` to start from: the best one found in each layer above."""
        start = np.full((len(queries), 1), self.entry, np.int64)
        for layer in range(len(self.links) - 1, to, -1):
            start = self._beam(queries, start, 1, layer)[0]
        return start

    def search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The best ``beam`` points for each query (-1 where there are fewer) and their similarities."""
        return self._beam(queries, self._descend(queries, 0), beam, 0)

    def _diverse(self, ids: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
        """Of each row of candidates, by similarity, at most ``most``: first those nearer to the point than to any taken."""
        order = np.argsort(-sims, axis=1)
        ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        held = self.vectors[ids]
        between = np.matmul(held, held.transpose(0, 2, 1))
        b, k = ids.shape
        taken, nearest, count = np.zeros((b, k), bool), np.full((b, k), -np.inf, np.float32), np.zeros(b, int)
        for i in range(k):
            good = (ids[:, i] >= 0) & (sims[:, i] > nearest[:, i]) & (count < most)
            taken[:, i] = good
            count += good
            nearest = np.where(good[:, None], np.maximum(nearest, between[:, i]), nearest)
        rank = np.where(taken, 0, np.where(ids >= 0, 1, 2)) * k + np.arange(k)  # then the others, the nearest first
        best = np.argsort(rank, axis=1)[:, :most]
        return np.where(np.take_along_axis(ids, best, 1) >= 0, np.take_along_axis(ids, best, 1), -1)

    def _join(self, batch: np.ndarray) -> None:
        if self.size == 0:
            self.entry, self.size = int(batch[0]), 1
            return
        q = self.vectors[batch]
        among = q @ q.T
        np.fill_diagonal(among, -np.inf)
        start = np.full((len(batch), 1), self.entry, np.int64)
        for layer in range(len(self.links) - 1, -1, -1):
            ids, sims = self._beam(q, start, BUILD_BEAM if (self.levels[batch] >= layer).any() else 1, layer)
            start = ids[:, :1]
            mine = np.flatnonzero(self.levels[batch] >= layer)
            if not len(mine):
                continue
            near = among[np.ix_(mine, mine)]
            k = min(M, len(mine))
            top = np.argpartition(-near, k - 1, axis=1)[:, :k]
            peer_sims = np.take_along_axis(near, top, 1)
            peers = np.where(np.isfinite(peer_sims), batch[mine][top], -1)
            self._link(batch[mine], np.hstack([ids[mine], peers]), np.hstack([sims[mine], peer_sims]), layer)
        self.size += len(batch)

    def _link(self, points: np.ndarray, ids: np.ndarray, sims: np.ndarray, layer: int) -> None:
        links = self.links[layer]
        chosen = self._diverse(ids, np.where(ids >= 0, sims, -np.inf), links.shape[1] // 2 if layer == 0 else links.shape[1])
        links[points] = -1
        links[points, : chosen.shape[1]] = chosen
        row, column = np.nonzero(chosen >= 0)
        to, new = chosen[row, column], points[row]
        order = np.argsort(to, kind="stable")
        to, new = to[order], new[order]
        each, first, count = np.unique(to, return_index=True, return_counts=True)
        for a in range(0, len(each), 512):
            e, f, c = each[a : a + 512], first[a : a + 512], count[a : a + 512]
            wide = np.full((len(e), links.shape[1] + int(c.max())), -1, np.int64)
            wide[:, : links.shape[1]] = links[e]
            r = np.repeat(np.arange(len(e)), c)
            inner = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
            wide[r, links.shape[1] + inner] = new[np.repeat(f, c) + inner]
            wide = _unique_rows(wide)
            full = (wide >= 0).sum(1) > links.shape[1]
            links[e[~full]] = wide[~full][:, : links.shape[1]]
            if full.any():
                links[e[full]] = self._diverse(wide[full], _sims(self.vectors, wide[full], self.vectors[e[full]]), links.shape[1])
