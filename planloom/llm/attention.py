"""Causal self-attention over subword ids with a tree of softmaxes for the next id, in numpy.

An id's place in the tree follows from its count: nodes have up to FAN branches and the
tree is Huffman's, so a frequent id is one branch off the root and a rare one some branches
further. Every node scores its branches by the hidden state of the place, on top of the
shares that the counts alone give them; the product along the way to an id is its
probability, and these sum to one over all ids. Nothing here knows of Spark.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np

PAST, NEW = 8, 24  # ids of a window before the scored ones, and scored ones
WIDE = PAST + NEW
DIM, HIDDEN = 16, 16
FAN = 32
RATE = 0.15
START = 1e-7  # what Adagrad's sums of squares begin with


class Tree:
    """``node`` and ``branch`` of each id by depth, ``depth`` of each id, and log shares of branches."""

    def __init__(self, mass: np.ndarray):
        n = len(mass)
        heap = [(float(m), i) for i, m in enumerate(mass)]
        heapq.heapify(heap)
        made: list[list[tuple[float, int]]] = []
        take = 2 + (n - 2) % (FAN - 1)  # so that all later nodes are full
        while len(heap) > 1:
            kids = [heapq.heappop(heap) for _ in range(min(take, len(heap)))]
            take = FAN
            made.append(kids)
            heapq.heappush(heap, (sum(m for m, _ in kids), n + len(made) - 1))
        if not made:
            made.append([(float(mass[0]), 0)])
        self.nodes = len(made)
        self.bias = np.full((self.nodes, FAN), -1e4, np.float32)  # of branches that a node lacks
        ways: dict[int, list[tuple[int, int]]] = {n + len(made) - 1: []}
        for at in range(len(made) - 1, -1, -1):  # parents come after their kids; the root gets number 0
            kids, way, number = made[at], ways.pop(n + at), len(made) - 1 - at
            total = sum(m for m, _ in kids)
            for b, (m, kid) in enumerate(kids):
                ways[kid] = [*way, (number, b)]
                self.bias[number, b] = np.log(m / total)
        self.depth = np.array([len(ways[i]) for i in range(n)], np.int8)
        self.node = np.zeros((int(self.depth.max()), n), np.int16)
        self.branch = np.zeros_like(self.node)
        for i in range(n):
            for d, (number, b) in enumerate(ways[i]):
                self.node[d, i], self.branch[d, i] = number, b

    def deeper(self, ids: np.ndarray):
        """Steps of ``ids`` below the root, sorted by node: the places in ``ids`` by depth, the order that sorts these
        end to end, the nodes met, where each one's steps begin and end, and the branch of each step."""
        at = np.flatnonzero(self.depth.take(ids) > 1)
        places, level = [], ids.take(at)
        nodes, branches = [self.node[0, :0]], [self.branch[0, :0]]
        for d in range(1, len(self.node)):
            places.append(at)
            nodes.append(self.node[d].take(level))
            branches.append(self.branch[d].take(level))
            more = np.flatnonzero(self.depth.take(level) > d + 1)
            at, level = at.take(more), level.take(more)
        node = np.concatenate(nodes)
        order = np.argsort(node, kind="stable")
        node = node.take(order)
        starts = np.flatnonzero(np.diff(node, prepend=-1))
        spans = list(zip(starts.tolist(), [*starts[1:].tolist(), len(node)]))
        return places, order, node.take(starts), spans, np.concatenate(branches).take(order)


CAUSAL = (np.arange(WIDE)[None, :] <= np.arange(NEW)[:, None] + PAST).astype(np.float32)
SCALE = np.float32(DIM**-0.5)
#: Columns of what is linear in an embedding: query, key, the id's own part of the output layer, and the value seen through it.
Q, K, OWN, V = (slice(i * DIM, (i + 1) * DIM) for i in range(4))
BLOCK = 1024  # rows of branches that stay in the processor's caches
SUM = np.ones((FAN, 1), np.float32)


class Attention:
    """One layer of masked attention; ``p`` holds its weights, ``s`` Adagrad's sums of squares.

    ``mass``: counts of the ids, all above zero. The id after the last one pads.
    """

    def __init__(self, mass: np.ndarray, seed: int = 3):
        r = np.random.default_rng(seed)
        normal = lambda *shape: r.normal(size=shape).astype(np.float32)
        self.tree, self.pad = Tree(mass), len(mass)
        self.p = {
            "e": normal(self.pad + 1, DIM) * 0.3, "pos": normal(WIDE, DIM) * 0.1,
            "q": normal(DIM, DIM) * 0.3, "k": normal(DIM, DIM) * 0.3, "v": normal(DIM, DIM) * 0.3,
            "t": normal(2 * DIM, HIDDEN) * 0.3, "c": np.zeros(HIDDEN, np.float32),
            "o": np.zeros((self.tree.nodes, HIDDEN, FAN), np.float32), "b": self.tree.bias.copy(),
        }
        self.s = {k: np.full_like(v, START) for k, v in self.p.items()}

    def ways(self) -> np.ndarray:
        """From an embedding to its query, key, own part of the output layer and value, side by side."""
        p = self.p
        return np.concatenate([p["q"] * SCALE, p["k"], p["t"][DIM:], p["v"] @ p["t"][:DIM]], axis=1)

    def laid(self, e: np.ndarray, w: np.ndarray):
        """For embeddings ``e`` and for places of a window, all that is linear in them by ``w``, and a one that counts an id in the attention's sum."""
        lay = lambda x, one: np.concatenate([x @ w, np.full((len(x), 1), one, np.float32)], axis=1)
        rows, places = lay(e, 1), lay(self.p["pos"], 0)
        places[:, OWN] += self.p["c"]
        return rows, places

    def prepare(self) -> None:
        """Lays out all ids, for scoring; the weights must not change any more."""
        self.s = {}
        self.rows, self.places = self.laid(self.p["e"], self.ways())
        self.out = self.branches(slice(None))

    def branches(self, nodes) -> np.ndarray:
        """Weights of the branches of ``nodes``, under them their bias."""
        return np.concatenate([self.p["o"][nodes], self.p["b"][nodes][:, None]], axis=1)

    def attend(self, ids: np.ndarray, rows: np.ndarray, places: np.ndarray, which: np.ndarray):
        """States by ``rows`` (``which`` of them stands at each place of ``ids``) and ``places``, and what their gradient needs."""
        y = rows.take(which, axis=0)
        y += places
        pads = np.flatnonzero(ids.ravel() == self.pad)
        y.reshape(-1, y.shape[2])[pads, V.start :] = 0
        a = y[:, PAST:, Q] @ y[:, :, K].transpose(0, 2, 1)
        np.clip(a, -30, 30, out=a)
        np.exp(a, out=a)
        a *= CAUSAL
        c = a @ y[:, :, V.start :]
        share = 1 / (c[:, :, HIDDEN:] + np.float32(1e-20))
        c = c[:, :, :HIDDEN] * share
        r = c + y[:, PAST:, OWN]
        return np.tanh(r, out=r).reshape(-1, HIDDEN), (y, pads, a, c, share)

    def states(self, ids: np.ndarray) -> np.ndarray:
        """``hidden``, by what ``prepare`` laid out."""
        return self.attend(ids, self.rows, self.places, ids)[0]

    def hidden(self, ids: np.ndarray):
        """State at each of the last NEW places of the windows ``ids``, and what its gradient needs.

        An id that occurs at many places is laid out once."""
        flat = ids.ravel().astype(np.uint16 if self.pad < 1 << 16 else np.int32)  # two bytes are sorted by digits
        order = np.argsort(flat, kind="stable")
        at = flat.take(order).astype(np.int64)
        starts = np.flatnonzero(np.diff(at, prepend=-1))
        which = np.empty(len(at), np.int64)
        which[order] = np.repeat(np.arange(len(starts)), np.diff(starts, append=len(at)))
        kinds, w = at.take(starts), self.ways()
        e, which = self.p["e"].take(kinds, axis=0), which.reshape(ids.shape)
        r, met = self.attend(ids, *self.laid(e, w), which)
        return r, (order, starts, kinds, which, e, w, *met)

    def log10_of(self, r: np.ndarray, targets: np.ndarray) -> np.ndarray:
        """log10 probability of the id ``targets`` of each state of ``r``."""
        out = self.out if hasattr(self, "out") else self.branches(slice(None))
        r = np.concatenate([r, np.ones((len(r), 1), np.float32)], axis=1)
        base = np.arange(BLOCK) * FAN

        def logs(z, branch):
            taken = z.ravel().take(base[: len(z)] + branch)
            np.exp(z, out=z)
            return taken - np.log(z @ SUM).ravel()

        first, value = self.tree.branch[0].take(targets), np.empty(len(targets), np.float32)
        for i in range(0, len(r), BLOCK):
            value[i : i + BLOCK] = logs(r[i : i + BLOCK] @ out[0], first[i : i + BLOCK])
        places, order, nodes, spans, branch = self.tree.deeper(targets)
        if spans:
            mine, z, deep = r.take(np.concatenate(places).take(order), axis=0), np.empty((len(order), FAN), np.float32), np.empty(len(order), np.float32)
            for node, (lo, hi) in zip(nodes.tolist(), spans):
                np.dot(mine[lo:hi], out[node], out=z[lo:hi])
            for i in range(0, len(z), BLOCK):
                deep[order[i : i + BLOCK]] = logs(z[i : i + BLOCK], branch[i : i + BLOCK])
            for at in places:
                value[at] += deep[: len(at)]
                deep = deep[len(at) :]
        return value * np.float32(1 / np.log(10))

    def tree_gradients(self, r: np.ndarray, targets: np.ndarray):
        """Gradients of the loss of ``targets``: of their states ``r``, and the nodes met with those of their branches and bias."""
        places, order, nodes, spans, branch = self.tree.deeper(targets)
        met = np.concatenate([[0], nodes.astype(np.int64)])
        out = self.branches(met)
        back = np.ascontiguousarray(out[:, :HIDDEN].transpose(0, 2, 1))
        go, dr = np.zeros_like(out), np.empty((len(r), HIDDEN), np.float32)
        r = np.concatenate([r, np.ones((len(r), 1), np.float32)], axis=1)
        line = np.arange(max(BLOCK, len(order)))

        def errors(z, branch):
            np.exp(z, out=z)
            z *= 1 / (z @ SUM)
            z[line[: len(z)], branch] -= 1
            return z

        first = self.tree.branch[0].take(targets)
        for i in range(0, len(r), BLOCK):
            mine = r[i : i + BLOCK]
            z = errors(mine @ out[0], first[i : i + BLOCK])
            go[0] += mine.T @ z
            np.dot(z, back[0], out=dr[i : i + BLOCK])
        if spans:
            mine, z, deep = r.take(np.concatenate(places).take(order), axis=0), np.empty((len(order), FAN), np.float32), np.empty((len(order), HIDDEN), np.float32)
            for j, (lo, hi) in enumerate(spans, 1):
                np.dot(mine[lo:hi], out[j], out=z[lo:hi])
            errors(z, branch)
            flipped, moved = mine.T, np.empty_like(deep)
            for j, (lo, hi) in enumerate(spans, 1):
                np.dot(flipped[:, lo:hi], z[lo:hi], out=go[j])
                np.dot(z[lo:hi], back[j], out=moved[lo:hi])
            deep[order] = moved
            for at in places:
                dr[at] += deep[: len(at)]
                deep = deep[len(at) :]
        return dr, met, go

    def gradients(self, ids: np.ndarray, targets: np.ndarray, weight: np.ndarray) -> dict:
        """Gradients of the summed loss of the places of weight 1: dense, or (rows, gradient of them)."""
        p, n = self.p, len(ids)
        r, (order, starts, kinds, which, e, w, y, pads, a, c, share) = self.hidden(ids)
        used = np.flatnonzero(weight)
        if len(used) == len(r):
            dr, met, go = self.tree_gradients(r, targets)
        else:
            dr = np.zeros_like(r)
            dr[used], met, go = self.tree_gradients(r.take(used, axis=0), targets.take(used))
        dt = r * r
        np.subtract(1, dt, out=dt)
        dt *= dr
        g = {"c": np.ones(len(dt), np.float32) @ dt, "o": (met, go[:, :HIDDEN]), "b": (met, go[:, HIDDEN])}
        dt = dt.reshape(n, NEW, HIDDEN)
        dc = np.empty((n, NEW, HIDDEN + 1), np.float32)
        np.multiply(dt, share, out=dc[:, :, :HIDDEN])
        c *= dc[:, :, :HIDDEN]
        dc[:, :, HIDDEN] = -(c.reshape(-1, HIDDEN) @ SUM[:HIDDEN]).reshape(n, NEW)
        ds = dc @ y[:, :, V.start :].transpose(0, 2, 1)
        ds *= a
        dy = np.empty((n, WIDE, w.shape[1]), np.float32)
        dy[:, :PAST, Q] = dy[:, :PAST, OWN] = 0
        dy[:, PAST:, OWN] = dt
        np.matmul(ds, y[:, :, K], out=dy[:, PAST:, Q])
        np.matmul(ds.transpose(0, 2, 1), y[:, PAST:, Q], out=dy[:, :, K])
        np.matmul(a.transpose(0, 2, 1), dc[:, :, :HIDDEN], out=dy[:, :, V])
        dy = dy.reshape(len(dy) * WIDE, -1)
        dy[pads, V] = 0
        x = e.take(which, axis=0)
        x += p["pos"]
        dw = (dy.T @ x.reshape(-1, DIM)).T
        g["q"], g["k"], g["v"] = dw[:, Q] * SCALE, dw[:, K], dw[:, V] @ p["t"][:DIM].T
        g["t"] = np.concatenate([p["v"].T @ dw[:, V], dw[:, OWN]])
        dx = dy @ w.T
        g["pos"] = (np.ones(n, np.float32) @ dx.reshape(n, -1)).reshape(WIDE, DIM)
        g["e"] = (kinds, np.add.reduceat(dx.take(order, axis=0), starts))
        return g

    def learn(self, windows: np.ndarray) -> int:
        """One Adagrad step by the mean gradient over the places of ``windows``; how many these are."""
        ids, targets = windows[:, :WIDE], windows[:, PAST + 1 :].ravel()
        weight = targets != self.pad
        n = int(np.count_nonzero(weight))
        if n:
            for name, g in self.gradients(ids, targets, weight).items():
                rows, g = g if isinstance(g, tuple) else (slice(None), g)
                g = g * np.float32(1 / n)
                s = g * g
                s += self.s[name][rows]
                self.s[name][rows] = s
                g *= np.float32(RATE)
                g /= np.sqrt(s, out=s)
                self.p[name][rows] -= g
        return n

    def score(self, windows: np.ndarray, block: int = 64) -> np.ndarray:
        """log10 probabilities of the ids that ``windows`` score, in their order."""
        states = np.empty((len(windows) * NEW, HIDDEN), np.float32)
        for i in range(0, len(windows), block):
            states[i * NEW : (i + block) * NEW] = self.states(windows[i : i + block, :WIDE])
        targets = windows[:, PAST + 1 :].ravel()
        real = targets != self.pad
        return self.log10_of(states, np.where(real, targets, self.pad - 1))[real]

    def flat(self, of: dict) -> np.ndarray:
        return np.concatenate([of[k].ravel() for k in self.p])

    def load(self, weights: np.ndarray, sums: np.ndarray) -> None:
        at = 0
        for k, v in self.p.items():
            self.p[k], self.s[k] = (f[at : at + v.size].reshape(v.shape).astype(np.float32) for f in (weights, sums))
            at += v.size


def windows(seqs: list[np.ndarray], end: int, pad: int) -> np.ndarray:
    """All windows of ``seqs`` at once."""
    return np.concatenate(list(window_parts(seqs, end, pad)))


def window_parts(seqs: list[np.ndarray], end: int, pad: int, most: int = 4096) -> Iterator[np.ndarray]:
    """Rows of WIDE + 1 ids: PAST + 1 before the NEW scored ones, each id of ``seqs`` scored in one row; at most ``most`` rows at a time.

    Each text begins after an ``end``; ``pad`` stands where it has no id.
    """
    size = np.array([len(s) + 1 for s in seqs])
    seq = np.concatenate([part for s in seqs for part in ((end,), s)]).astype(np.int32)
    bounds = np.concatenate([[0], np.cumsum(size)])
    rows = -(-(size - 1) // NEW)
    first, last = np.repeat(bounds[:-1], rows), np.repeat(bounds[1:], rows)
    start = first + (np.arange(len(first)) - np.repeat(np.cumsum(rows) - rows, rows)) * NEW
    for i in range(0, len(start), most):
        at = start[i : i + most, None] + np.arange(-PAST, NEW + 1)
        ok = (at >= first[i : i + most, None]) & (at < last[i : i + most, None])
        yield np.where(ok, seq[np.clip(at, 0, len(seq) - 1)], np.int32(pad))
