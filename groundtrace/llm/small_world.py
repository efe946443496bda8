"""A hierarchical navigable small-world graph over unit vectors, built and searched in numpy batches.

Vectors are ordered by falling level, so the members of a layer are a prefix and one numbering serves all
layers. Neighbours are chosen by the usual diversity rule: a candidate is kept if it is nearer to the new
vector than to any neighbour kept before.
"""

import numpy as np

DEGREE = 12  # neighbours in upper layers, twice as many in the lowest
BUILD_BEAM = 32
BATCH = 1024


def _top(sims: np.ndarray, k: int) -> np.ndarray:
    k = min(k, sims.shape[1])
    part = np.argpartition(-sims, k - 1, axis=1)[:, :k] if k < sims.shape[1] else np.tile(np.arange(k), (len(sims), 1))
    order = np.argsort(-np.take_along_axis(sims, part, 1), axis=1, kind="stable")
    return np.take_along_axis(part, order, 1)


class Graph:
    def __init__(self, vectors: np.ndarray, levels: np.ndarray):
        """``vectors``: unit rows in order of falling ``levels``."""
        self.vectors = np.ascontiguousarray(vectors, np.float32)
        top = int(levels[0]) if len(levels) else -1
        self.sizes = [int((levels >= layer).sum()) for layer in range(top + 1)]
        self.links: list[np.ndarray] = [np.zeros((0, 0), np.int32)] * (top + 1)
        for layer in range(top, -1, -1):
            self.links[layer] = self._attach(self._layer(layer))

    @classmethod
    def of(cls, vectors: np.ndarray, sizes: list[int], links: list[np.ndarray]) -> "Graph":
        """The graph with these layers, built before over the same vectors."""
        graph = cls.__new__(cls)
        graph.vectors, graph.sizes, graph.links = np.ascontiguousarray(vectors, np.float32), sizes, links
        return graph

    @staticmethod
    def _attach(links: np.ndarray) -> np.ndarray:
        """Give every member a path from the first: one that lost all links to it hangs on its nearest neighbour."""
        if not len(links):
            return links
        reached = np.zeros(len(links), bool)
        front = np.array([0])
        while True:
            while len(front):
                reached[front] = True
                near = np.unique(links[front])
                near = near[near >= 0]
                front = near[~reached[near]]
            lost = np.flatnonzero(~reached)
            if not len(lost):
                return links
            known = (links[lost] >= 0) & reached[np.maximum(links[lost], 0)]
            can = known.any(axis=1)
            lost, column = (lost[can], known[can].argmax(axis=1)) if can.any() else (lost[:1], None)
            parent = np.zeros(1, np.int64) if column is None else links[lost, column]
            parent, one = np.unique(parent, return_index=True)  # one child each; the rest in the next turn
            extra = np.full((len(links), 1), -1, np.int32)
            extra[parent, 0] = lost[one]
            links = np.concatenate([links, extra], axis=1)
            front = lost[one]

    def _choose(self, of: np.ndarray, cand: np.ndarray, sims: np.ndarray, degree: int) -> np.ndarray:
        """Diverse neighbours among candidates sorted by falling similarity; -1 fills up."""
        good = np.isfinite(sims)
        rows = self.vectors[np.maximum(cand, 0)]
        between = np.einsum("qcd,qed->qce", rows, rows, optimize=True)
        keep, full = np.zeros(cand.shape, bool), np.zeros(len(cand), np.int32)
        for j in range(cand.shape[1]):
            near = (keep[:, :j] & (between[:, j, :j] > sims[:, j:j + 1])).any(axis=1)
            keep[:, j] = good[:, j] & ~near & (full < degree)
            full += keep[:, j]
        rank = np.where(keep, 0, np.where(good, 1, 2)) * cand.shape[1] + np.arange(cand.shape[1])
        pick = np.argsort(rank, axis=1)[:, :degree]
        out = np.where(np.take_along_axis(good, pick, 1), np.take_along_axis(cand, pick, 1), -1)
        if out.shape[1] < degree:
            out = np.pad(out, ((0, 0), (0, degree - out.shape[1])), constant_values=-1)
        return out.astype(np.int32)

    def _layer(self, layer: int) -> np.ndarray:
        size, degree = self.sizes[layer], DEGREE * (2 if layer == 0 else 1)
        links = np.full((size, degree), -1, np.int32)
        done = 0
        while done < size:
            to = min(size, done + max(1, min(BATCH, done or BATCH)))
            batch = np.arange(done, to)
            x = self.vectors[done:to]
            inner = x @ x.T
            np.fill_diagonal(inner, -np.inf)
            near = _top(inner, BUILD_BEAM)
            cand, sims = near + done, np.take_along_axis(inner, near, 1)
            if done:
                entries = self._descend(x, layer)
                # The layer above may have more members than are placed here so far; the first member leads to all.
                found, s = self._beam(x, np.where(entries < done, entries, 0), links[:done], BUILD_BEAM)
                cand, sims = np.concatenate([cand, found], 1), np.concatenate([sims, s], 1)
            order = _top(sims, BUILD_BEAM + 16)
            cand, sims = np.take_along_axis(cand, order, 1), np.take_along_axis(sims, order, 1)
            links[done:to] = self._choose(batch, cand, sims, degree)
            self._reverse(links, batch, to, degree)
            done = to
        return links

    def _reverse(self, links: np.ndarray, batch: np.ndarray, to: int, degree: int) -> None:
        """Link back from the chosen neighbours; one with too many links chooses again."""
        source = np.repeat(batch, degree)
        target = links[batch].ravel()
        source, target = source[target >= 0], target[target >= 0]
        sims = np.einsum("ed,ed->e", self.vectors[source], self.vectors[target])
        order = np.lexsort((-sims, target))
        source, target = source[order], target[order]
        first = np.flatnonzero(np.r_[True, target[1:] != target[:-1]]) if len(target) else np.zeros(0, int)
        rank = np.arange(len(target)) - np.repeat(first, np.diff(np.r_[first, len(target)]))
        nodes = target[first]
        fresh = np.full((len(nodes), degree), -1, np.int32)
        slot = np.repeat(np.arange(len(nodes)), np.diff(np.r_[first, len(target)]))
        use = rank < degree
        fresh[slot[use], rank[use]] = source[use]
        cand = np.concatenate([links[nodes], fresh], axis=1)
        cand = np.sort(cand, axis=1)
        cand[:, 1:][cand[:, 1:] == cand[:, :-1]] = -1
        for at in range(0, len(nodes), BATCH):
            part, of = cand[at:at + BATCH], nodes[at:at + BATCH]
            s = np.einsum("qcd,qd->qc", self.vectors[np.maximum(part, 0)], self.vectors[of])
            s[part < 0] = -np.inf
            order = np.argsort(-s, axis=1)
            links[of] = self._choose(of, np.take_along_axis(part, order, 1), np.take_along_axis(s, order, 1), degree)

    def _descend(self, queries: np.ndarray, layer: int) -> np.ndarray:
        entries = np.zeros(len(queries), np.int64)
        for upper in range(len(self.sizes) - 1, layer, -1):
            found, sims = self._beam(queries, entries, self.links[upper], 4)
            entries = found[np.arange(len(found)), sims.argmax(axis=1)]
        return entries

    def _beam(self, queries, entries, links, width) -> tuple[np.ndarray, np.ndarray]:
        """Best ``width`` members of a layer for each query: (ids, similarities), -1 and -inf fill up."""
        step = max(32, min(BATCH, (1 << 25) // max(1, len(links))))
        parts = [self._beam_part(queries[a:a + step], entries[a:a + step], links, width)
                 for a in range(0, len(queries), step)]
        return tuple(np.concatenate(p) for p in zip(*parts))

    def _beam_part(self, queries, entries, links, width):
        q = len(queries)
        seen = np.zeros((q, len(links)), bool)
        ids = np.full((q, width), -1, np.int64)
        sims = np.full((q, width), -np.inf, np.float32)
        open_ = np.zeros((q, width), bool)
        rows = np.arange(q)
        ids[:, 0] = entries
        sims[:, 0] = np.einsum("qd,qd->q", queries, self.vectors[entries])
        open_[:, 0] = True
        seen[rows, entries] = True
        while True:
            active = np.flatnonzero(open_.any(axis=1))
            if not len(active):
                return ids, sims
            best = np.where(open_[active], sims[active], -np.inf).argmax(axis=1)
            open_[active, best] = False
            near = links[ids[active, best]]
            fresh = (near >= 0) & ~seen[active[:, None], np.maximum(near, 0)]
            at, column = np.nonzero(fresh)
            if not len(at):
                continue
            node = near[at, column]
            seen[active[at], node] = True
            value = np.full(near.shape, -np.inf, np.float32)
            value[at, column] = np.einsum("ed,ed->e", queries[active[at]], self.vectors[node])
            better = np.flatnonzero((value > sims[active].min(axis=1)[:, None]).any(axis=1))
            if not len(better):
                continue
            who = active[better]
            all_sims = np.concatenate([sims[who], value[better]], axis=1)
            pick = np.argpartition(-all_sims, width - 1, axis=1)[:, :width]
            sims[who] = np.take_along_axis(all_sims, pick, 1)
            ids[who] = np.take_along_axis(np.concatenate([ids[who], near[better].astype(np.int64)], axis=1), pick, 1)
            open_[who] = np.take_along_axis(np.concatenate([open_[who], fresh[better]], axis=1), pick, 1)

    def search(self, queries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        queries = np.ascontiguousarray(queries, np.float32)
        return self._beam(queries, self._descend(queries, 0), self.links[0], max(1, width))

    def within(self, queries: np.ndarray, least: float, width: int):
        """(query, member) pairs of at least that similarity; a beam full of them is widened until it is not.

        A beam takes as many steps as it is wide, each over its whole width: where that exceeds the members, the
        query is in a dense region and asks all of them instead.
        """
        queries = np.ascontiguousarray(queries, np.float32)
        todo, pairs, size = np.arange(len(queries)), [], self.sizes[0]
        while len(todo):
            if width * width >= size:
                step = max(1, (1 << 22) // max(1, size))
                for a in range(0, len(todo), step):
                    at, member = np.nonzero(queries[todo[a:a + step]] @ self.vectors.T >= least)
                    pairs.append((todo[a:a + step][at], member))
                break
            ids, sims = self.search(queries[todo], min(width, size))
            full = (sims >= least).all(axis=1) & (width < size)
            at, column = np.nonzero((sims >= least) & ~full[:, None] & (ids >= 0))
            pairs.append((todo[at], ids[at, column]))
            todo, width = todo[full], width * 2
        if not pairs:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return tuple(np.concatenate(p) for p in zip(*pairs))
