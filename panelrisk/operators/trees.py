"""Forests and boosted trees from histograms, for all folds and candidates of a comparison at once.

Rows are binned once per training set by its own quantiles (one aggregate); bin 0 holds the missing values.  A
tree grows level by level from sums per (model, tree, node, feature, bin): of gradients, hessians and rows for
boosting, of class weights and rows for a forest.  The same code finds the splits in two settings:

- while a model's rows, as bins, fit ``IN_TASK_BYTES`` (counted first), one task grows a boosted model or a share of a
  forest's trees: one job for all models.  Where only scores are asked, the JVM grows the shares and scores the rows, up to
  ``SHARE_BYTES`` (``TreeShares.java``, the same splits from the same sums);
- beyond, each level is one job for all models: tasks add up their rows' histograms, those of a portion of nodes meet
  in one group, which finds their best splits, and only the splits come to the driver.

Rows travel in blocks (``_blocks``): a row of bytes for up to ``BLOCK`` rows.

Gradients and weights are whole multiples of 2 ** -24, so sums don't depend on the order of rows and both
settings grow the same trees.  Draws (bootstrap counts, features of a node) are hashes of the row's key,
the tree and the node, so a lost task repeats them and a model is the same whatever is fitted beside it.

A split sends missing values to the side that gains more.  Leaf-wise growth splits the leaf of largest gain first
until there are ``leaves``: a level's gains tell which nodes the queue can still reach, so it needs no
more jobs than the tree has levels.
"""

from __future__ import annotations

import heapq
import itertools
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelrisk.operators.tree_shares import grow_shares
from panelrisk.session import materialize

#: Bytes of binned rows (a feature a byte; key, fold, label) up to which one task may hold a model's training rows.
IN_TASK_BYTES = 128 << 20
#: The same for shares that score their rows (``TreeShares.java``), which hold some two to three times these bytes.
SHARE_BYTES = 512 << 20
#: Bytes of a binned row beside its features.
ROW_BYTES = 16
#: Rows of a block.
BLOCK = 1 << 16
#: Rows or entries that are worked on at once: as many as a core's cache holds.
PART = 1 << 14
#: Cells (node, bin) up to which a tree is walked by a table of children.
TABLE = 1 << 20
#: Histogram cells that one job of the large setting sums, and entries (row, tree) that a task holds.
CELLS = 1 << 22
#: Rounds after which the large setting writes the margins with the rows.
MARGIN_ROUNDS = 5
DEEPEST = 30
ONE = 1 << 24
#: A forest's histograms count positives in the low bits of a double and negatives above them.
HALF = 1 << 26
#: A forest's leaf values are summed as multiples of 1 / GRID, so that their order doesn't matter.
GRID = 1 << 40


@dataclass(frozen=True)
class Forest:
    """A5.  ``min_split`` rows (in the bootstrap sample) are needed to split a node; leaves may be smaller."""

    trees: int = 200
    depth: int | None = 10
    min_split: int = 5
    min_leaf: int = 1
    features: str | float | int = "sqrt"
    balanced: bool = True
    bins: int = 63
    seed: int = 42
    leaves: None = field(default=None, init=False)

    def gain(self, left, right, total):
        mixed = lambda s: 2 * s[..., 0] * (s[..., 1] - s[..., 0]) / np.maximum(s[..., 1], 1)
        return mixed(total) - mixed(left) - mixed(right)

    def allowed(self, side):
        return side[..., 2] >= self.min_leaf

    def splits(self, gain):
        return gain > -np.inf  # as an impure node is split wherever it can be

    def may_split(self, total):
        return (total[:, 2] >= max(2, self.min_split)) & (total[:, 0] > 0) & (total[:, 0] < total[:, 1])

    def values(self, total):
        return total[:, 0] / np.maximum(total[:, 1], 1)

    def width(self, n: int) -> int:
        f = self.features
        if f in ("sqrt", "auto"):
            f = int(np.sqrt(n))
        elif f == "log2":
            f = int(np.log2(n))
        elif f in ("all", None):
            f = n
        elif isinstance(f, float):
            f = int(f * n)
        return max(1, min(n, int(f)))


@dataclass(frozen=True)
class Boosting:
    """A6 (level-wise: ``leaves=None``) and A7 (leaf-wise): second-order boosting of the logistic loss.

    ``weights``: "positive" weighs positives by negatives / positives, "balanced" weighs both classes, None neither.
    """

    rounds: int = 200
    depth: int | None = 6
    leaves: int | None = None
    step: float = 0.1
    l2: float = 1.0
    min_gain: float = 0.0
    min_hessian: float = 1.0
    min_leaf: int = 1
    weights: str | None = "positive"
    bins: int = 255
    seed: int = 42

    def gain(self, left, right, total):
        l2 = self.l2 * ONE
        part = lambda s: s[..., 0] ** 2 / np.maximum(s[..., 1] + l2, 1)
        return (part(left) + part(right) - part(total)) / (2 * ONE)

    def allowed(self, side):
        return (side[..., 2] >= self.min_leaf) & (side[..., 1] >= self.min_hessian * ONE)

    def splits(self, gain):
        return gain > self.min_gain

    def may_split(self, total):
        return total[:, 2] >= 2 * self.min_leaf

    def values(self, total):
        return -self.step * total[:, 0] / np.maximum(total[:, 1] + self.l2 * ONE, 1)

    def width(self, n: int) -> int:
        return n


def leaf_wise(**kw) -> Boosting:
    """31 leaves, 20 rows a leaf, no regularisation, balanced classes, unless told otherwise."""
    return Boosting(**{"leaves": 31, "min_leaf": 20, "min_hessian": 1e-3, "l2": 0.0, "weights": "balanced", **kw})


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _draw_steps() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hashes at which a draw grows by one; by upper 16 bits, the draw, and whether it grows among them."""
    chance = np.exp(-1.0) / np.cumprod([1, *range(1, 16)])
    steps = np.ceil(np.cumsum(chance) * 2.0 ** 53).astype(np.uint64)
    starts = np.arange(1 << 16, dtype=np.uint64) << np.uint64(37)
    low, high = (np.searchsorted(steps, starts + np.uint64(d), "right") for d in (0, (1 << 37) - 1))
    return steps, low.astype(np.uint8), low != high


_STEPS, _LOW, _GROWS = _draw_steps()


def _draws(keys: np.ndarray, trees: np.ndarray, seed: int) -> np.ndarray:
    """How often each tree's bootstrap sample holds each row: Poisson with mean 1."""
    h = _mix(_mix(trees.astype(np.uint64)[:, None] + np.uint64(seed << 32)) ^ _mix(keys.view(np.uint64))[None, :]).ravel()
    top = (h >> np.uint64(48)).astype(np.intp)
    out = _LOW.take(top)
    near = np.flatnonzero(_GROWS.take(top))
    out[near] = np.searchsorted(_STEPS, h[near] >> np.uint64(11), "right")
    return out.reshape(len(trees), len(keys))


def _sums(bins, row, node, channels, features, width: int) -> np.ndarray:
    """(channels, nodes, slots, width) sums over entries: ``row`` in ``node``, features by (node, slot); None counts."""
    out = np.zeros((len(channels), *features.shape, width))
    _add(out, bins.reshape(-1), row * bins.shape[1], node, channels, features)
    return out


def _add(out, flat, start, node, channels, features) -> None:
    """Adds entries to sums; ``start``: where an entry's row begins in ``flat``."""
    _, n, m, width = out.shape
    first = node * width
    same = n > 0 and (features == features[0]).all()
    for s in range(m):
        at = flat.take(start + (features[0, s] if same else features[:, s].take(node))) + first
        for held, c in zip(out, channels):
            held[:, s] += np.bincount(at, c, n * width).reshape(n, width)


def _classes(sums: np.ndarray, unit) -> np.ndarray:
    """A forest's three channels from its two: draws packed by class, and rows.  ``unit``: the classes' weights."""
    negative = np.floor(sums[0] / HALF)
    c0 = (sums[0] - negative * HALF) * unit[1]
    return np.stack([c0, c0 + negative * unit[0], sums[1]])


def _packed(drawn, y) -> np.ndarray:
    return drawn * np.where(y > 0, 1.0, HALF)


def histograms(bins, row, node, channels, features, width: int, unit=None) -> np.ndarray:
    """(nodes, slots, width, 3) sums of the channels over entries: ``row`` in ``node``, features by (node, slot).
    With ``unit``, the classes' weights, the channels are a forest's two."""
    got = _sums(bins, row, node, channels, features, width)
    return np.moveaxis(got if unit is None else _classes(got, unit), 0, -1)


def best_splits(sums: np.ndarray, spec):
    """Per node: (gain, slot, whether missing values go left, last bin on the left, sums on the left, all sums)."""
    n, m, width, _ = sums.shape
    total, missing = sums[:, 0].sum(1), sums[:, :, 0]
    left = np.empty((3, n, m, 1 + bool(missing.any()), width - 1))  # (channel, node, slot, missing left, bin)
    for c in range(3):
        np.cumsum(sums[:, :, 1:, c], axis=2, out=left[c, :, :, 0])
        if left.shape[3] > 1:
            np.add(left[c, :, :, 0], missing[:, :, None, c], out=left[c, :, :, 1])
    left = np.moveaxis(left, 0, -1)
    whole = total[:, None, None, None]
    right = whole - left
    gain = np.where(spec.allowed(left) & spec.allowed(right), spec.gain(left, right, whole), -np.inf)
    best = gain.reshape(n, -1).argmax(1)
    at = (np.arange(n), *np.unravel_index(best, gain.shape[1:]))
    return gain[at], at[1], at[2] == 1, at[3] + 1, left[at], total


class Growth:
    """Trees in growth: one table of nodes, of which ``ask`` are those whose best split is wanted next."""

    COLUMNS = {"tree": np.int32, "depth": np.int16, "code": np.uint64, "feature": np.int32, "bin": np.int32, "missing_left": bool,
               "left": np.int32, "right": np.int32, "gain": np.float64, "count": np.float64, "value": np.float64}

    def __init__(self, spec, trees: np.ndarray, n_features: int):
        self.spec, self.n_features, self.roots = spec, n_features, len(trees)
        self.asked_before = np.zeros(0, np.int64)
        self.nodes = {c: np.zeros(0, t) for c, t in self.COLUMNS.items()}
        self.ask = self._add(trees, 0, np.ones(len(trees), np.uint64), None)

    def _add(self, tree, depth, code, total) -> np.ndarray:
        n, first = len(tree), len(self.nodes["tree"])
        new = {"tree": tree, "depth": np.full(n, depth), "code": code, "feature": np.full(n, -1), "left": np.full(n, -1),
               "right": np.full(n, -1), "gain": np.full(n, -np.inf)}
        if total is not None:
            new |= {"count": total[:, 2], "value": self.spec.values(total)}
        for c, t in self.COLUMNS.items():
            self.nodes[c] = np.concatenate([self.nodes[c], np.asarray(new.get(c, np.zeros(n)), t)])
        return np.arange(first, first + n)

    def features(self) -> np.ndarray:
        """The features that each asked node may use: those with the smallest hashes of (tree, node, feature)."""
        n, m = self.n_features, self.spec.width(self.n_features)
        if m == n:
            return np.tile(np.arange(n), (len(self.ask), 1))
        tree, code = self.nodes["tree"][self.ask], self.nodes["code"][self.ask]
        h = _mix(tree.astype(np.uint64) + np.uint64((self.spec.seed << 32) + (1 << 31)))
        h = _mix(_mix(h ^ code)[:, None] + np.arange(n, dtype=np.uint64))
        return np.sort(np.argsort(h, 1, kind="stable")[:, :m], 1)

    def answer(self, features, gain, slot, missing_left, last, left, total) -> None:
        """Takes the best splits of ``ask`` and adds the children of the nodes that are split."""
        spec, nodes, ask = self.spec, self.nodes, self.ask
        first = nodes["depth"][ask] == 0
        nodes["count"][ask[first]], nodes["value"][ask[first]] = total[first, 2], spec.values(total[first])
        good = spec.splits(gain) & np.where(first, spec.may_split(total), True)
        nodes["gain"][ask] = np.where(good, gain, -np.inf)
        nodes["feature"][ask] = np.where(good, features[np.arange(len(ask)), slot], -1)
        nodes["bin"][ask], nodes["missing_left"][ask] = last, missing_left
        if spec.leaves is not None:
            good &= np.isin(ask, list(self._queue()))
        on, depth = ask[good], nodes["depth"][ask[good]] + 1
        sides = []
        for k, (side, sums) in enumerate((("left", left[good]), ("right", (total - left)[good]))):
            ids = self._add(nodes["tree"][on], 0, nodes["code"][on] * np.uint64(2) + np.uint64(k), sums)
            self.nodes["depth"][ids] = depth
            self.nodes[side][on] = ids
            limit = DEEPEST if spec.depth is None else spec.depth
            sides.append(ids[spec.may_split(sums) & (depth < limit)])
        self.asked_before, self.ask = ask, np.sort(np.concatenate(sides))

    def _queue(self) -> set[int]:
        """The nodes that best-first growth splits, as far as gains are known."""
        nodes, out = self.nodes, set()
        queue = [(-nodes["gain"][r], int(r)) for r in range(self.roots) if nodes["feature"][r] >= 0]
        while queue and len(out) < self.spec.leaves - 1:
            k = heapq.heappop(queue)[1]
            out.add(k)
            for c in (int(nodes["left"][k]), int(nodes["right"][k])):
                if c >= 0 and nodes["feature"][c] >= 0:
                    heapq.heappush(queue, (-nodes["gain"][c], c))
        return out

    def finished(self) -> dict[str, np.ndarray]:
        """The node table; a node that the queue doesn't reach, or without children, is a leaf."""
        split = self.nodes["left"] >= 0
        if self.spec.leaves is not None:
            split &= np.isin(np.arange(len(split)), list(self._queue()))
        out = dict(self.nodes)
        out["feature"] = np.where(split, out["feature"], -1)
        return out


class _Steps:
    """From nodes to children: a node table laid out for many rows."""

    def __init__(self, nodes):
        self.inner, self.nodes = nodes["feature"] >= 0, nodes
        self.feature = np.maximum(nodes["feature"], 0)
        # a missing value is bin 0: it goes left, or, one below that, it is the largest byte and goes right
        self.shift = np.where(nodes["missing_left"], 0, 1).astype(np.uint8)
        self.last = nodes["bin"].astype(np.uint8) - self.shift
        self.child = np.stack([nodes["left"], nodes["right"]], 1).reshape(-1).astype(np.intp)

    def __call__(self, flat, start, node):
        """The children of inner nodes that rows belong to; ``start``: where a row's bins begin in ``flat``."""
        b = flat.take(start + self.feature.take(node))
        return self.child.take(2 * node + (b - self.shift.take(node) > self.last.take(node)))


    def table(self) -> np.ndarray | None:
        """By node and bin, the child; a leaf is its own.  None where that is too large to be of use."""
        if len(self.inner) > TABLE >> 8:
            return None
        if not hasattr(self, "_table"):
            right = np.arange(256, dtype=np.uint8)[None, :] - self.shift[:, None] > self.last[:, None]
            left, other = (np.where(self.inner, self.nodes[c], np.arange(len(self.inner)))[:, None] for c in ("left", "right"))
            self._table = np.where(right, other, left).astype(np.intp).reshape(-1)
        return self._table


def _leaves(nodes, bins, start: int, steps: _Steps | None = None, rows: np.ndarray | None = None) -> np.ndarray:
    """The leaf of every row, or of ``rows``, in the tree whose root is ``start``."""
    steps, flat, n_features = steps or _Steps(nodes), bins.reshape(-1), bins.shape[1]
    n, table = len(bins) if rows is None else len(rows), steps.table()
    out = np.full(n, start, np.intp)
    if not steps.inner[start]:
        return out
    for a in range(0, n, PART):
        row = np.arange(a, min(a + PART, n))
        at, node = (row if rows is None else rows[a:a + PART]) * n_features, out[row]
        while table is not None and len(row):
            for _ in range(4):
                b = flat.take(at + steps.feature.take(node))
                node = table.take((node << 8) + b)
            inner = steps.inner.take(node)
            left = np.count_nonzero(inner)
            if not left:
                out[row] = node
                break
            if 2 * left < len(row):
                out[row[~inner]] = node[~inner]
                row, at, node = row[inner], at[inner], node[inner]
        while table is None and len(row):
            node = steps(flat, at, node)
            inner = steps.inner.take(node)
            if not inner.all():
                out[row[~inner]] = node[~inner]
                row, at, node = row[inner], at[inner], node[inner]
    return out


def _asked(growth: Growth, chunk: int):
    """The places of asked nodes in portions of bounded size."""
    for a in range(0, len(growth.ask), chunk):
        yield slice(a, a + chunk)


def _by_place(place: np.ndarray, n: int) -> np.ndarray:
    """The stable order of places below ``n``, 16 bits at a time."""
    order = np.argsort((place & 0xFFFF).astype(np.uint16), kind="stable")
    return order if n <= 1 << 16 else order[np.argsort((place[order] >> 16).astype(np.uint16), kind="stable")]


def _smaller(growth: Growth):
    """Of the asked nodes: (which are summed from rows, the places of the others, of their siblings, and of their parents
    in the level above).  Two asked siblings make up their parent: the larger is what the smaller leaves of it."""
    nodes, ask = growth.nodes, growth.ask
    parents = growth.asked_before
    place = np.full(len(nodes["tree"]), -1)
    place[ask] = np.arange(len(ask))
    above = np.flatnonzero(nodes["left"][parents] >= 0)
    a, b = place[nodes["left"][parents[above]]], place[nodes["right"][parents[above]]]
    both = (a >= 0) & (b >= 0)
    above, a, b = above[both], a[both], b[both]
    swap = nodes["count"][ask[a]] > nodes["count"][ask[b]]
    less, more = np.where(swap, b, a), np.where(swap, a, b)
    summed = np.ones(len(ask), bool)
    summed[more] = False
    return summed, more, less, above


def _pieces(entries: list, size: int) -> list:
    """The same entries in pieces of ``size``; kept as they are while they are of some use."""
    n = sum(len(e[0]) for e in entries)
    if len(entries) == 1 and n <= 2 * size or len(entries) > 1 and n >= size // 2 * len(entries):
        return entries
    whole = [None if c[0] is None else np.concatenate(c) for c in zip(*entries)]
    return [tuple(None if c is None else c[a:a + size] for c in whole) for a in range(0, max(n, 1), size)]


def _next(growth: Growth, width: int) -> np.ndarray:
    """By place among the nodes asked before, and bin: the place of the child among those asked now, or, where rows go no
    further, -1 less the node that they have come to."""
    nodes, before = growth.nodes, growth.asked_before
    code = -1 - np.arange(len(nodes["tree"]))
    code[growth.ask] = np.arange(len(growth.ask))
    split = nodes["left"][before] >= 0
    left, right = (code[np.where(split, nodes[c][before], before)][:, None] for c in ("left", "right"))
    b = np.arange(width)[None, :]
    to_left = np.where(b == 0, nodes["missing_left"][before][:, None], b <= nodes["bin"][before][:, None])
    return np.where(to_left, left, right).reshape(-1)


def _grow_here(spec, bins, width, row, node, channels, trees, unit=None, ends=None) -> dict[str, np.ndarray]:
    """Grows trees from the entries of one task: entry i is ``row[i]`` in the tree ``trees[node[i]]``.

    ``ends`` (tree, row) takes the node that each entry comes to.  A level works on pieces of the entries, so that what is
    computed between reading them and adding them up stays in a core's cache.
    """
    growth = Growth(spec, trees, bins.shape[1])
    flat, n_features, held = bins.reshape(-1), bins.shape[1], None
    entries = [(row * n_features, node, *channels)]  # where the row begins, place of the node among the asked
    while len(growth.ask):
        features, n = growth.features(), len(growth.ask)
        entries = _pieces(entries, max(PART, n * width))
        chunk = max(1, (CELLS // 4) // (features.shape[1] * width))
        if n <= chunk:
            summed, more, less, above = _smaller(growth) if held is not None else (None,) * 4
            sums = np.zeros((len(channels), *features.shape, width))
            for e in entries:
                if summed is not None:
                    own = summed.take(e[1])
                    e = tuple(c if c is None else c[own] for c in e)
                _add(sums, flat, e[0], e[1], e[2:], features)
            sums = np.moveaxis(sums if unit is None else _classes(sums, unit), 0, -1)
            if summed is not None:
                sums[more] = held[above] - sums[less]
            # all nodes use the same features: the next level needs but the smaller of two siblings
            held = sums if features.shape[1] == n_features else None
            found = best_splits(sums, spec)
        else:
            held, parts = None, []
            start, place, *own_channels = (None if c[0] is None else np.concatenate(c) for c in zip(*entries))
            order = _by_place(place, n)
            cuts = np.searchsorted(place[order], np.arange(n + 1))
            for s in _asked(growth, chunk):
                own = order[cuts[s.start]:cuts[min(s.stop, n)]]
                sums = np.zeros((len(channels), *features[s].shape, width))
                _add(sums, flat, start[own], place[own] - s.start, [c if c is None else c[own] for c in own_channels], features[s])
                parts.append(best_splits(np.moveaxis(sums if unit is None else _classes(sums, unit), 0, -1), spec))
            found = [np.concatenate(p) for p in zip(*parts)]
        asked = growth.ask
        growth.answer(features, *found)
        feature, tree = np.maximum(growth.nodes["feature"][asked], 0), growth.nodes["tree"][asked] - trees[0]
        to = _next(growth, width)
        for i, (start, place, *own_channels) in enumerate(entries):
            at = to.take(place * width + flat.take(start + feature.take(place)))
            on = at >= 0
            if not on.all():
                if ends is not None:
                    off = ~on
                    ends[tree.take(place[off]), start[off] // n_features] = -1 - at[off]
                start, at, own_channels = start[on], at[on], [c if c is None else c[on] for c in own_channels]
            entries[i] = (start, at, *own_channels)
    return growth.finished()


def _pruned(nodes, split: np.ndarray) -> np.ndarray:
    """For each node, where its rows end if only the nodes of ``split`` are split: itself or a node above it."""
    out, parent = np.arange(len(split)), np.full(len(split), -1)
    on = np.flatnonzero(nodes["left"] >= 0)
    parent[nodes["left"][on]], parent[nodes["right"][on]] = on, on
    for depth in range(1, int(nodes["depth"].max(initial=0)) + 1):
        own = np.flatnonzero(nodes["depth"] == depth)
        up = parent[own]
        out[own] = np.where(split[up] & (out[up] == up), own, out[up])
    return out


def _class_weights(spec, n_neg: float, n_pos: float) -> tuple[float, float]:
    """The weights of negatives and positives."""
    n = n_neg + n_pos
    if isinstance(spec, Forest):
        return (n / (2 * max(n_neg, 1)), n / (2 * max(n_pos, 1))) if spec.balanced else (1.0, 1.0)
    if spec.weights == "positive":
        return 1.0, n_neg / max(n_pos, 1)
    if spec.weights == "balanced":
        return n / (2 * max(n_neg, 1)), n / (2 * max(n_pos, 1))
    return 1.0, 1.0


def _gradients(margin, y, w):
    p = 1 / (1 + np.exp(-margin))
    return np.rint(w * (p - y) * ONE), np.rint(w * p * (1 - p) * ONE)


def _grown(spec: Forest, bins, y, key, weights, width, part: tuple[int, int]):
    """(nodes, ends) of a forest's trees by portions, those of ``part`` (first, end).  ``ends``: by tree of the portion and
    training row, the row's leaf, or -1 where the tree's sample lacks the row."""
    n, unit = len(y), (np.rint(weights[0] * ONE), np.rint(weights[1] * ONE))
    step = max(1, (CELLS // 4) // max(n, 1))
    for a in range(part[0], part[1], step):
        trees = np.arange(a, min(a + step, part[1]))
        drawn = np.concatenate([_draws(key[i:i + PART], trees, spec.seed) for i in range(0, max(n, 1), PART)], 1)
        node, row = np.nonzero(drawn)
        ends = np.full((len(trees), n), -1, np.int32)
        yield _grow_here(spec, bins, width, row, node, [_packed(drawn[node, row], y[row]), None], trees, unit, ends), ends


def _fit_here(spec, bins, y, key, weights, width, part: tuple[int, int] | None = None) -> list[dict[str, np.ndarray]]:
    """All trees of one model from its training rows; of a forest, those of ``part`` (first, end)."""
    if isinstance(spec, Forest):
        return [nodes for nodes, _ in _grown(spec, bins, y, key, weights, width, part or (0, spec.trees))]
    n, w = len(y), np.where(y > 0, weights[1], weights[0])
    margin, out, row, start, ends = np.zeros(n), [], np.arange(n), np.zeros(n, np.int64), np.zeros((1, n), np.int32)
    for t in range(spec.rounds):
        g, h = _gradients(margin, y, w)
        nodes = _grow_here(spec, bins, width, row, start, [g, h, None], np.array([t]), None, ends)
        margin = margin + nodes["value"][_pruned(nodes, nodes["feature"] >= 0)].take(ends[0])
        out.append(nodes)
    return out


def _on_grid(values: np.ndarray) -> np.ndarray:
    return np.rint(values * GRID)


@dataclass
class Ensemble:
    """A fitted model: nodes of all trees, and the first nodes of the trees."""

    kind: str
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    missing_left: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    gain: np.ndarray
    count: np.ndarray

    @staticmethod
    def of(spec, tables: list[dict[str, np.ndarray]], edges: Sequence[np.ndarray]) -> Ensemble:
        shift = np.cumsum([0, *(len(t["tree"]) for t in tables)])
        roots = np.concatenate([np.flatnonzero(t["depth"] == 0) + s for t, s in zip(tables, shift)])
        all_ = {c: np.concatenate([t[c] for t in tables]) for c in ("feature", "bin", "missing_left", "value", "gain", "count")}
        side = {c: np.concatenate([t[c] + s for t, s in zip(tables, shift)]) for c in ("left", "right")}
        edges = edges or [np.zeros(0)]
        ends = np.full((len(edges), max([len(e) for e in edges], default=0) + 1), np.inf)
        for k, e in enumerate(edges):
            ends[k, :len(e)] = e
        at = np.clip(all_["bin"] - 1, 0, ends.shape[1] - 1)
        return Ensemble("forest" if isinstance(spec, Forest) else "boosting", roots, all_["feature"],
                        ends[np.maximum(all_["feature"], 0), at], all_["missing_left"], side["left"], side["right"],
                        all_["value"], np.where(all_["feature"] >= 0, all_["gain"], 0.0), all_["count"])

    def probability(self, x: np.ndarray) -> np.ndarray:
        """Probability of the positive class for each row of ``x`` (NaN: missing)."""
        edges = [np.unique(self.threshold[self.feature == f]) for f in range(x.shape[1])]
        if max(map(len, edges), default=0) > 254:  # more bins than a byte tells
            return self._by_thresholds(x)
        if not hasattr(self, "_nodes"):
            f = np.maximum(self.feature, 0)
            last = [np.searchsorted(edges[k], self.threshold[f == k], "left") + 1 for k in range(x.shape[1])]
            nodes = {"feature": self.feature, "missing_left": self.missing_left, "left": self.left, "right": self.right, "bin": np.ones(len(f), int)}
            for k, ends in enumerate(last):
                nodes["bin"][f == k] = np.minimum(ends, len(edges[k]) + 1)
            self._nodes, self._steps = nodes, _Steps(nodes)
        out, bins, values = np.zeros(len(x)), _binned(x, edges), _on_grid(self.value) if self.kind == "forest" else self.value
        for root in self.roots:
            out += values.take(_leaves(self._nodes, bins, int(root), self._steps))
        return out / GRID / len(self.roots) if self.kind == "forest" else 1 / (1 + np.exp(-out))

    def __getstate__(self):
        return {c: v for c, v in self.__dict__.items() if c not in ("_nodes", "_steps")}

    def _by_thresholds(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        step = max(1, (CELLS // 8) // max(len(self.roots), 1))
        for a in range(0, len(x), step):
            part = x[a:a + step]
            rows, at = np.arange(len(part))[:, None], np.tile(self.roots, (len(part), 1))
            for _ in range(DEEPEST + 1):
                f = self.feature[at]
                if (f < 0).all():
                    break
                v = part[rows, np.maximum(f, 0)]
                left = np.where(np.isnan(v), self.missing_left[at], v <= self.threshold[at])
                at = np.where(f < 0, at, np.where(left, self.left[at], self.right[at]))
            values = self.value[at]
            out[a:a + step] = (_on_grid(values).sum(1) / GRID / len(self.roots) if self.kind == "forest"
                               else 1 / (1 + np.exp(-np.add.accumulate(values, 1)[:, -1])))
        return out

    def importances(self, n_features: int) -> np.ndarray:
        """Share of each feature in the gain of all splits; a forest's trees count alike."""
        out = np.zeros(n_features)
        tree = np.searchsorted(self.roots, np.arange(len(self.feature)), "right") - 1 if self.kind != "forest" else self._trees()
        on = self.feature >= 0
        per = np.zeros((len(self.roots), n_features))
        np.add.at(per, (tree[on], self.feature[on]), np.maximum(self.gain[on], 0))
        if self.kind == "forest":
            per = per / np.maximum(per.sum(1, keepdims=True), 1e-300)
        out = per.sum(0)
        return out / out.sum() if out.sum() > 0 else out

    def _trees(self) -> np.ndarray:
        """The tree of each node, from its parent's."""
        tree = np.full(len(self.feature), -1)
        tree[self.roots] = np.arange(len(self.roots))
        level = self.roots
        while len(level):
            inner = level[self.feature[level] >= 0]
            for side in (self.left, self.right):
                tree[side[inner]] = tree[inner]
            level = np.concatenate([self.left[inner], self.right[inner]])
        return tree


@dataclass(frozen=True)
class Task:
    """One model to fit: its sizes, and the fold that it doesn't see (None: it sees all rows)."""

    spec: Forest | Boosting
    left_out: int | None = None

    @property
    def binning(self) -> tuple[int | None, int]:
        return self.left_out, self.spec.bins


def _edges(rows: DataFrame, n_features: int, binnings) -> dict:
    """{binning: by feature, the upper ends of its bins}: quantiles of the rows the binning may see, in one scan."""
    seen = lambda left_out: F.lit(True) if left_out is None else ~F.col("fold").eqNullSafe(F.lit(left_out))
    outs = list(dict.fromkeys(out for out, _ in binnings))
    ends = {out: [k / bins for o, bins in binnings if o == out for k in range(1, bins + 1)] for out in outs}  # of one sketch for all
    aggs = [F.percentile_approx(F.when(seen(out) & ~F.isnan(F.col("x")[f]), F.col("x")[f]), ends[out], 20_000)
            for out in outs for f in range(n_features)]
    got = list(rows.agg(F.array(*[F.coalesce(a, F.array().cast("array<double>")) for a in aggs])).first()[0])
    edges, first = {}, dict.fromkeys(outs, 0)
    for out, bins in binnings:
        own, k = slice(first[out], first[out] + bins), outs.index(out)
        # the largest value needs no end of its own: what lies above the others is the last bin
        edges[out, bins] = [np.unique(np.array(got[k * n_features + f][own], float))[:-1] for f in range(n_features)]
        first[out] = own.stop
    return edges


def _binned(x: np.ndarray, edges) -> np.ndarray:
    out = np.stack([np.searchsorted(e, x[:, f], "left") + 1 for f, e in enumerate(edges)], 1) if len(edges) else np.zeros((len(x), 0))
    return np.where(np.isnan(x), 0, out).astype(np.uint8)


def _matrix(held: bytes, n_features: int) -> np.ndarray:
    return np.frombuffer(held, np.uint8).reshape(-1, n_features)


def prepare(df: DataFrame, features, label: str, key, fold_col: str | None) -> DataFrame:
    """(key, fold, y, x): the columns that fitting reads, written once.  Null features count as missing (NaN)."""
    x = [F.coalesce(c.cast("double"), F.lit(float("nan"))) for c in features] if isinstance(features, (list, tuple)) else None
    vector = F.array(*x) if x is not None else features
    fold = F.col(fold_col).cast("int") if fold_col else F.lit(None).cast("int")
    return materialize(df.where(F.col(label).isNotNull()).select(
        key.cast("long").alias("key"), fold.alias("fold"), F.col(label).cast("double").alias("y"), vector.alias("x")), "tree-rows")


@dataclass
class _Known:
    """What all models need to know of the rows: counts, class weights, and bins."""

    n_rows: int
    n_features: int
    binnings: list
    weights: list
    edges: dict
    width: dict

    def in_task(self, in_task_rows: int | None, most: int | None = None) -> bool:
        """Whether a task may hold all rows of a model; ``most`` bytes of them (None: IN_TASK_BYTES)."""
        if in_task_rows is not None:
            return self.n_rows <= in_task_rows
        return self.n_rows * (self.n_features + ROW_BYTES) <= (IN_TASK_BYTES if most is None else most)


def _known(rows: DataFrame, tasks: Sequence[Task]) -> _Known:
    counts = rows.groupBy("fold", "y").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("m")).collect()  # folds x classes
    n_rows, n_features = sum(r["n"] for r in counts), max([r["m"] for r in counts], default=0)
    binnings = sorted({t.binning for t in tasks}, key=lambda b: (b[0] is not None, b))
    edges = _edges(rows, n_features, binnings) if n_features else {b: [] for b in binnings}
    weights = []
    for t in tasks:
        seen = [r for r in counts if t.left_out is None or r["fold"] != t.left_out]
        weights.append(_class_weights(t.spec, sum(r["n"] for r in seen if r["y"] <= 0), sum(r["n"] for r in seen if r["y"] > 0)))
    return _Known(n_rows, n_features, binnings, weights, edges, {b: max([len(e) for e in edges[b]], default=0) + 2 for b in binnings})


def fit_all(rows: DataFrame, tasks: Sequence[Task], in_task_rows: int | None = None) -> list[Ensemble]:
    """The models of ``tasks`` from rows (key, fold, y, x), all in the same jobs.

    A table without rows, or without features, gives trees of one leaf.
    """
    return _fit_all(rows, list(tasks), _known(rows, tasks), in_task_rows)


def _fit_all(rows, tasks, known: _Known, in_task_rows) -> list[Ensemble]:
    if not known.n_rows or not known.n_features:
        empty = np.zeros((0, max(1, known.n_features)), np.uint8)
        tables = [_fit_here(t.spec, empty, np.zeros(0), np.zeros(0, np.int64), w, 2) for t, w in zip(tasks, known.weights)]
    elif known.in_task(in_task_rows):
        tables = _fit_in_tasks(_blocks(rows, known), tasks, known)
    else:
        tables = _fit_by_levels(_blocks(rows, known, sum(isinstance(t.spec, Boosting) for t in tasks)), tasks, known)
    return [Ensemble.of(t.spec, got, known.edges[t.binning]) for t, got in zip(tasks, tables)]


_NODE_TYPES = {"tree": "int", "depth": "int", "feature": "int", "bin": "int", "missing_left": "boolean", "left": "int", "right": "int",
               "gain": "double", "count": "double", "value": "double"}


def _features(x: pa.Array | pa.ChunkedArray) -> np.ndarray:
    x = x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x
    return x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)


def _fold(b: pa.RecordBatch) -> np.ndarray:
    return pc.fill_null(b.column(1), -1).to_numpy(zero_copy_only=False).astype(np.int32)


def _block_columns(known: _Known, margins: int) -> str:
    return ("block long, n int, keys binary, folds binary, ys binary, " + "".join(f"b{k} binary, " for k in range(len(known.binnings)))
            + "margins binary" * bool(margins)).rstrip(", ")


def _blocks(rows: DataFrame, known: _Known, margins: int = 0) -> DataFrame:
    """The rows by blocks, written once: bytes of keys, folds (-1: none), labels, of bins for each binning, and of zeros
    for ``margins`` numbers a row."""
    names = [c.split()[0] for c in _block_columns(known, margins).split(", ")]
    binnings, edges = known.binnings, known.edges

    def blocks(stream):
        part, count, held, size = TaskContext.get().partitionId(), 0, [], 0
        for b in itertools.chain(stream, [None]):
            if b is not None:
                x = _features(b.column(3))
                held.append([b.column(0).to_numpy(zero_copy_only=False), _fold(b), b.column(2).to_numpy(zero_copy_only=False),
                             *(_binned(x, edges[k]) for k in binnings)])
                size += b.num_rows
            if size and (b is None or size >= BLOCK):
                whole = [np.concatenate(c) for c in zip(*held)]
                for a in range(0, size, BLOCK):
                    cut = [c[a:a + BLOCK] for c in whole]
                    out = [np.zeros(len(cut[0]) * margins)] * bool(margins)
                    yield pa.RecordBatch.from_arrays([pa.array([(part << 32) + count]), pa.array([len(cut[0])], pa.int32()),
                                                      *(pa.array([c.tobytes()], pa.binary()) for c in cut + out)], names)
                    count += 1
                held, size = [], 0

    n = max(1, -(-known.n_rows // BLOCK))
    return materialize(rows.select("key", "fold", "y", "x").repartition(n).mapInArrow(blocks, _block_columns(known, margins)), "tree-blocks")


class _Part:
    """The columns of a block."""

    def __init__(self, r: dict):
        self.r, self.n = r, r["n"]
        self.key, self.fold = np.frombuffer(r["keys"], np.int64), np.frombuffer(r["folds"], np.int32)
        self.y = np.frombuffer(r["ys"], np.float64)

    def bins(self, k: int, n_features: int) -> np.ndarray:
        return _matrix(self.r[f"b{k}"], n_features)

    def seen(self, left_out: int | None) -> np.ndarray:
        return np.ones(self.n, bool) if left_out is None else self.fold != left_out


def _parts(stream):
    """(block, batch) of a stream of blocks."""
    for b in stream:
        for i in range(b.num_rows):
            one = b.slice(i, 1)
            yield _Part({c: one.column(c)[0].as_py() for c in b.schema.names}), one


def _shares(spark, tasks: Sequence[Task], per_core: int = 4) -> list[tuple[int, int, int]]:
    """(task, first tree, end): what one task of the job grows, the longest first.  A forest is shared out so that there are
    some ``per_core`` shares for each core; the trees of a boosted model follow one another."""
    depth = [DEEPEST if t.spec.depth is None else t.spec.depth for t in tasks]
    work = sum(t.spec.trees * d for t, d in zip(tasks, depth) if isinstance(t.spec, Forest))
    most = max(1, work // (per_core * spark.sparkContext.defaultParallelism))
    out = []
    for k, (t, d) in enumerate(zip(tasks, depth)):
        if isinstance(t.spec, Boosting):
            out.append((k, 0, t.spec.rounds))
        else:
            n = min(t.spec.trees, -(-t.spec.trees * d // most))
            ends = [t.spec.trees * i // n for i in range(n + 1)]
            out += [(k, a, b) for a, b in zip(ends, ends[1:])]
    return sorted(out, key=lambda s: (isinstance(tasks[s[0]].spec, Forest), -(s[2] - s[1]) * depth[s[0]], s))


@dataclass(frozen=True)
class _Family:
    """Trees that several tasks have in common, ``spec`` from tree ``first`` on: the draws don't depend on the number of
    trees, and a lower depth limit or a higher minimum split only ends the same tree earlier."""

    spec: Forest | Boosting
    left_out: int | None
    first: int
    members: tuple[int, ...]

    def split(self, nodes, spec: Forest) -> np.ndarray:
        """The nodes that the tree of a member with ``spec`` splits."""
        limit = DEEPEST if spec.depth is None else spec.depth
        return (nodes["feature"] >= 0) & ((nodes["depth"] < limit) | (nodes["depth"] == 0)) & (nodes["count"] >= max(2, spec.min_split))


def _families(tasks: Sequence[Task], n_features: int) -> list[_Family]:
    """Every tree of every task once, those that are the same but for their ends together."""
    alike: dict[tuple, list[int]] = {}
    for k, t in enumerate(tasks):
        s = t.spec
        alike.setdefault((t.left_out, s.min_leaf, s.width(n_features), s.balanced, s.bins, s.seed) if isinstance(s, Forest) else (k,), []).append(k)
    out = []
    for own in alike.values():
        spec = tasks[own[0]].spec
        if isinstance(spec, Boosting):
            out.append(_Family(spec, tasks[own[0]].left_out, 0, tuple(own)))
            continue
        cuts = sorted({0, *(tasks[k].spec.trees for k in own)})
        for a, b in zip(cuts, cuts[1:]):
            members = tuple(k for k in own if tasks[k].spec.trees >= b)
            specs = [tasks[k].spec for k in members]
            depth = None if any(s.depth is None for s in specs) else max(s.depth for s in specs)
            out.append(_Family(replace(specs[0], trees=b - a, depth=depth, min_split=min(s.min_split for s in specs)),
                               tasks[own[0]].left_out, a, members))
    return out


def _by_share(blocks: DataFrame, tasks: Sequence[Task], known: _Known, shares):
    """The blocks, with the bins of its model, of each share; a partition for each share, so that they grow side by side."""
    by_binning = {b: [i for i, s in enumerate(shares) if tasks[s[0]].binning == b] for b in known.binnings}
    bins = F.coalesce(*[F.when(F.col("share").isin(own), F.col(f"b{k}")) for k, own in enumerate(by_binning.values())])
    out = blocks.select("*", F.explode(F.sequence(F.lit(0), F.lit(len(shares) - 1))).alias("share"))
    return (out.select("share", "block", "n", "keys", "folds", "ys", bins.alias("b0"))
            .repartitionByRange(len(shares), "share").groupBy("share"))


def _to_shares(blocks: DataFrame, tasks: Sequence[Task], known: _Known, shares) -> DataFrame:
    """A partition for each share: the blocks, with the bins of its model, and with keys where trees have draws."""
    by_binning = {b: [i for i, s in enumerate(shares) if tasks[s[0]].binning == b] for b in known.binnings}
    bins = F.coalesce(*[F.when(F.col("share").isin(own), F.col(f"b{k}")) for k, own in enumerate(by_binning.values())])
    forests = [i for i, s in enumerate(shares) if isinstance(tasks[s[0]].spec, Forest)]
    return (blocks.select("*", F.explode(F.sequence(F.lit(0), F.lit(len(shares) - 1))).alias("share"))
            .select("share", "block", F.when(F.col("share").isin(forests), F.col("keys")).alias("keys"), "folds", "ys", bins.alias("bins"))
            .repartitionById(len(shares), "share"))


def _held(part: pa.Table, left_out: int | None, n_features: int):
    """(the blocks, the bins of all their rows, the numbers of the rows to learn from, and of those bins, labels and keys)."""
    blocks = [_Part(r) for r in part.to_pylist()]
    bins = np.concatenate([p.bins(0, n_features) for p in blocks])
    seen = np.flatnonzero(np.concatenate([p.seen(left_out) for p in blocks]))
    y, key = (np.concatenate(c).take(seen) for c in ([p.y for p in blocks], [p.key for p in blocks]))
    return blocks, bins, seen, bins if len(seen) == len(bins) else bins.take(seen, 0), y, key


def _fit_in_tasks(blocks: DataFrame, tasks, known: _Known) -> list[list[dict[str, np.ndarray]]]:
    """One group a share: its model's training rows (at most IN_TASK_BYTES), and the trees grown from them."""
    arrow = {"int": pa.int32(), "boolean": pa.bool_(), "double": pa.float64()}
    shares = _shares(blocks.sparkSession, tasks)

    def grown(part: pa.Table) -> pa.Table:
        i = part.column("share")[0].as_py()
        k, a, b = shares[i]
        *_, bins, y, key = _held(part, tasks[k].left_out, known.n_features)
        got = _fit_here(tasks[k].spec, bins, y, key, known.weights[k], known.width[tasks[k].binning], (a, b))
        sizes = [len(g["tree"]) for g in got]
        out = {"share": pa.array([i] * sum(sizes), pa.int32()), "part": pa.array(np.repeat(np.arange(len(got)), sizes).astype(np.int32)),
               "id": pa.array(np.concatenate([np.arange(n) for n in sizes]).astype(np.int32))}
        return pa.table(out | {c: pa.array(np.concatenate([g[c] for g in got]), arrow[kind]) for c, kind in _NODE_TYPES.items()})

    schema = "share int, part int, id int, " + ", ".join(f"{c} {kind}" for c, kind in _NODE_TYPES.items())
    got = _by_share(blocks, tasks, known, shares).applyInArrow(grown, schema).toArrow()
    got = {c: got.column(c).to_numpy() for c in got.column_names}
    out: list[list[dict]] = [[] for _ in tasks]
    for i in sorted(range(len(shares)), key=lambda i: shares[i]):
        own = np.flatnonzero(got["share"] == i)
        own = own[np.lexsort((got["id"][own], got["part"][own]))]
        cuts = np.flatnonzero(np.diff(got["part"][own])) + 1
        out[shares[i][0]] += [{c: got[c][p] for c in _NODE_TYPES} for p in np.split(own, cuts)]
    return out


def cross_scores(rows: DataFrame, tasks: Sequence[Task], in_task_rows: int | None = None, with_seen: bool = True) -> DataFrame:
    """(task, fold, y, unseen, probability): every row scored by each model, and whether the model didn't see the row;
    without ``with_seen`` only the rows that the model didn't see.

    While a model's rows fit ``SHARE_BYTES``, trees are grown and applied in the same tasks and never come to the driver.
    """
    tasks, schema = list(tasks), "task int, fold int, y double, unseen boolean, probability double"
    known = _known(rows, tasks)
    if known.n_rows and known.n_features and known.in_task(in_task_rows, SHARE_BYTES):
        return _scored_in_tasks(_blocks(rows, known), tasks, known, schema, with_seen)
    models = rows.sparkSession.sparkContext.broadcast(_fit_all(rows, tasks, known, in_task_rows))  # models, whatever the rows

    def applied(stream):
        for b in stream:
            if b.num_rows:
                x, fold, y = _features(b.column(2)), _fold(b.select([2, 0])), b.column(1).to_numpy(zero_copy_only=False)
                for k, m in enumerate(models.value):
                    own = slice(None) if with_seen else np.zeros(len(fold), bool) if tasks[k].left_out is None else fold == tasks[k].left_out
                    yield _scores(k, tasks[k], fold[own], y[own], m.probability(x[own]))

    return rows.select("fold", "y", "x").mapInArrow(applied, schema)


def _scores(k: int, task: Task, fold: np.ndarray, y: np.ndarray, p: np.ndarray) -> pa.RecordBatch:
    unseen = np.zeros(len(fold), bool) if task.left_out is None else fold == task.left_out
    return pa.RecordBatch.from_pydict({"task": pa.array(np.full(len(p), k, np.int32)), "fold": pa.array(fold, mask=fold < 0),
                                       "y": y, "unseen": unseen, "probability": p})


def _share_text(known: _Known, family: _Family, members: Sequence[Forest | Boosting], first: int, end: int, with_seen: bool) -> str:
    """What ``TreeShares.java`` is told of a share: the order of its numbers is that of ``TreeShare``."""
    spec, weights = family.spec, known.weights[family.members[0]]
    forest, limit = isinstance(spec, Forest), lambda s: DEEPEST if s.depth is None else s.depth
    edges = known.edges[family.left_out, spec.bins]
    numbers = [int(forest), int(with_seen), -1 if family.left_out is None else family.left_out, first, end, limit(spec), spec.min_leaf, spec.seed,
               *((float(np.rint(w * ONE)) if forest else float(w)) for w in weights), spec.width(known.n_features), known.n_features,
               *(len(e) + 2 for e in edges), known.n_rows, len(members)]
    for k, s in zip(family.members, members):
        numbers += [k, limit(s), s.min_split if forest else 0]
    numbers += [-1, 0.0, 0.0, 0.0, 0.0] if forest else [-1 if spec.leaves is None else spec.leaves, float(spec.step), float(spec.l2),
                                                        float(spec.min_gain), float(spec.min_hessian)]
    return " ".join(map(repr, numbers))


def _scored_in_tasks(blocks: DataFrame, tasks, known: _Known, schema: str, with_seen: bool) -> DataFrame:
    """``cross_scores`` of blocks: each share's trees give a sum for each row and model, and the sums of a block meet.

    Rows to score go down a tree together with those it grows from."""
    families = _families(tasks, known.n_features)
    grown = [Task(f.spec, f.left_out) for f in families]
    shares = _shares(blocks.sparkSession, grown, 4 if known.in_task(None) else 2)
    texts = [_share_text(known, f := families[k], [tasks[m].spec for m in f.members], f.first + a, f.first + b, with_seen) for k, a, b in shares]

    def scored(part: pa.Table) -> pa.Table:
        k = part.column("task")[0].as_py()
        fold, y = (np.frombuffer(next(v for v in part.column(c).to_pylist() if v is not None), kind)
                   for c, kind in (("folds", np.int32), ("ys", np.float64)))
        total = sum(np.frombuffer(v, np.float64) for v in part.column("sums").to_pylist())
        spec = tasks[k].spec
        p = total / GRID / spec.trees if isinstance(spec, Forest) else 1 / (1 + np.exp(-total))
        return pa.Table.from_batches([_scores(k, tasks[k], fold, y, p)])

    sums = grow_shares(_to_shares(blocks, grown, known, shares), texts, _STEPS)
    return sums.groupBy("task", "block").applyInArrow(scored, schema)


def _fit_by_levels(held: DataFrame, tasks, known: _Known) -> list[list[dict[str, np.ndarray]]]:
    """Every job sums one level of all models' growing trees."""
    weights, width, n_features = known.weights, known.width, known.n_features
    at = {b: k for k, b in enumerate(known.binnings)}
    boosted = [k for k, t in enumerate(tasks) if isinstance(t.spec, Boosting)]
    slot = {k: i for i, k in enumerate(boosted)}
    schema = _block_columns(known, len(boosted))
    done: list[list[dict]] = [[] for _ in tasks]
    fresh: dict[int, list[dict]] = {k: [] for k in boosted}  # trees that the written margins don't have yet
    growing: dict[int, list[Growth]] = {}
    next_tree = [0] * len(tasks)

    def start(k: int) -> None:
        spec = tasks[k].spec
        if isinstance(spec, Boosting):
            trees = np.arange(next_tree[k], min(next_tree[k] + 1, spec.rounds))
        else:
            most = max(1, CELLS // (len(tasks) * spec.width(n_features) * width[tasks[k].binning] * 64))
            trees = np.arange(next_tree[k], min(next_tree[k] + most, spec.trees))
        next_tree[k] += len(trees)
        if len(trees):
            growing[k] = [Growth(spec, trees, n_features)]

    def margins_of(part: _Part) -> np.ndarray:
        return np.frombuffer(part.r["margins"], np.float64).reshape(len(boosted), part.n)

    def level(portion: dict[int, slice]):
        """By task, the best splits of a slice of the asked nodes (an array for each answer), by one job."""
        wanted = {k: (growing[k][0].nodes, growing[k][0].ask[s], growing[k][0].features()[s]) for k, s in portion.items()}
        # nodes whose sums meet in one group
        together = {k: max(1, (1 << 17) // (features.shape[1] * width[tasks[k].binning])) for k, (_, _, features) in wanted.items()}

        def sums(stream):
            out: dict[int, np.ndarray] = {}
            # an asked node is a leaf so far
            so_far = {k: nodes | {"feature": np.where(nodes["left"] >= 0, nodes["feature"], -1)} for k, (nodes, _, _) in wanted.items()}
            steps = {k: _Steps(nodes) for k, nodes in so_far.items()}
            fresh_steps = {k: [(tree, _Steps(tree)) for tree in fresh[k]] for k in wanted if k in fresh}
            local = {k: np.full(len(nodes["tree"]), -1) for k, (nodes, _, _) in wanted.items()}
            for k, (_, ask, _) in wanted.items():
                local[k][ask] = np.arange(len(ask))
            for part, _ in _parts(stream):
                drawn_of: dict[tuple, np.ndarray] = {}  # folds and candidates have the same draws
                for k, (nodes, ask, features) in wanted.items():
                    t = tasks[k]
                    bins, use = part.bins(at[t.binning], n_features), np.flatnonzero(part.seen(t.left_out))
                    if k not in out:
                        out[k] = np.zeros((3 if isinstance(t.spec, Boosting) else 2, *features.shape, width[t.binning]))
                    if isinstance(t.spec, Boosting):
                        margin = margins_of(part)[slot[k]]
                        for tree, walk in fresh_steps[k]:
                            margin = margin + tree["value"].take(_leaves(tree, bins, 0, walk))
                        size = max(PART, len(ask) * width[t.binning])
                        for row in (use[a:a + size] for a in range(0, len(use), size)):
                            place = local[k].take(_leaves(so_far[k], bins, 0, steps[k], row))
                            on = place >= 0
                            row, place = (row, place) if on.all() else (row[on], place[on])
                            y = part.y.take(row)
                            g, h = _gradients(margin.take(row), y, np.where(y > 0, weights[k][1], weights[k][0]))
                            _add(out[k], bins.reshape(-1), row * n_features, place, [g, h, None], features)
                        continue
                    trees, first = nodes["tree"][ask], nodes["tree"][0]
                    for tree in np.unique(trees):
                        if (t.spec.seed, tree) not in drawn_of:
                            drawn_of[t.spec.seed, tree] = _draws(part.key, np.array([tree]), t.spec.seed)[0]
                        drawn = drawn_of[t.spec.seed, tree]
                        row = use[drawn.take(use) > 0]
                        own = np.flatnonzero(trees == tree)
                        here = np.full(len(ask) + 1, -1)  # the last for nodes that aren't asked
                        here[own] = np.arange(len(own))
                        place = here.take(local[k].take(_leaves(so_far[k], bins, tree - first, steps[k], row)))
                        row, place = row[place >= 0], place[place >= 0]
                        out[k][:, own] += _sums(bins, row, place, [_packed(drawn.take(row), part.y.take(row)), None], features[own], width[t.binning])
            for k, got in out.items():
                if isinstance(tasks[k].spec, Forest):
                    got = _classes(got, (np.rint(weights[k][0] * ONE), np.rint(weights[k][1] * ONE)))
                for a in range(0, got.shape[1], together[k]):
                    some = got[:, a:a + together[k]].reshape(3, -1)
                    cells = np.flatnonzero(some[2])
                    if len(cells):
                        yield pa.RecordBatch.from_pydict({"task": pa.array([k], pa.int32()), "first": pa.array([a], pa.int32()),
                                                          "cells": pa.array([cells.astype(np.int32).tobytes()], pa.binary()),
                                                          "sums": pa.array([some[:, cells].tobytes()], pa.binary())})

        def chosen(part: pa.Table) -> pa.Table:
            k, first = part.column("task")[0].as_py(), part.column("first")[0].as_py()
            spec, wide = tasks[k].spec, width[tasks[k].binning]
            whole = np.zeros((3, together[k] * spec.width(n_features) * wide))
            for cells, held in zip(part.column("cells"), part.column("sums")):
                cells = np.frombuffer(cells.as_buffer(), np.int32)
                whole[:, cells] += np.frombuffer(held.as_buffer(), np.float64).reshape(3, -1)
            whole = np.moveaxis(whole.reshape(3, together[k], spec.width(n_features), wide), 0, -1)
            some = np.flatnonzero(whole[:, 0, :, 2].any(1))
            gain, slot_, missing, last, left, total = best_splits(whole[some], spec)
            return pa.table({"task": pa.array(np.full(len(some), k, np.int32)), "node": pa.array((some + first).astype(np.int32)), "gain": gain,
                             "slot": slot_.astype(np.int32), "missing": missing, "last": last.astype(np.int32),
                             **{f"left{c}": left[:, c] for c in range(3)}, **{f"total{c}": total[:, c] for c in range(3)}})

        got = (held.mapInArrow(sums, "task int, first int, cells binary, sums binary").groupBy("task", "first")
               .applyInArrow(chosen, "task int, node int, gain double, slot int, missing boolean, last int, "
                             + ", ".join(f"{c}{i} double" for c in ("left", "total") for i in range(3)))
               .toArrow())  # a row for each node of the level
        got, out = {c: got.column(c).to_numpy() for c in got.column_names}, {}
        for k, (_, ask, _) in wanted.items():
            n, own = len(ask), got["task"] == k
            found = [np.full(n, -np.inf), np.zeros(n, np.int64), np.zeros(n, bool), np.ones(n, np.int64), np.zeros((n, 3)), np.zeros((n, 3))]
            triple = lambda c: np.stack([got[f"{c}{i}"] for i in range(3)], 1)  # noqa: E731, B023
            for held_, values in zip(found, (*(got[c] for c in ("gain", "slot", "missing", "last")), triple("left"), triple("total"))):
                held_[got["node"][own]] = values[own]
            out[k] = found
        return out

    for k in range(len(tasks)):
        start(k)
    while growing:
        # portions of the level, so that no job sums more than CELLS cells a task
        answers: dict[int, list] = {k: [] for k in growing}
        left_to_ask = {k: 0 for k in growing}
        while any(left_to_ask[k] < len(growing[k][0].ask) for k in growing):
            portion, room = {}, CELLS
            for k in growing:
                cells = tasks[k].spec.width(n_features) * width[tasks[k].binning]
                n = min(len(growing[k][0].ask) - left_to_ask[k], max(room // cells, 0 if portion else 1))
                if n > 0:
                    portion[k] = slice(left_to_ask[k], left_to_ask[k] + n)
                    room -= n * cells
            for k, found in level(portion).items():
                answers[k].append(found)
                left_to_ask[k] = portion[k].stop
        for k in list(growing):
            growth = growing[k][0]
            growth.answer(growth.features(), *[np.concatenate(p) for p in zip(*answers[k])])
            if not len(growth.ask):
                nodes = growth.finished()
                done[k].append(nodes)
                if k in fresh:
                    fresh[k].append(nodes)
                del growing[k]
                start(k)
        if fresh and growing and max(map(len, fresh.values())) >= MARGIN_ROUNDS:
            taken = {k: list(v) for k, v in fresh.items()}

            def moved(stream):
                for part, b in _parts(stream):
                    m = margins_of(part).copy()
                    for k in boosted:
                        bins = part.bins(at[tasks[k].binning], n_features)
                        for nodes in taken[k]:
                            m[slot[k]] += nodes["value"].take(_leaves(nodes, bins, 0))
                    yield pa.RecordBatch.from_arrays([*(b.column(c) for c in range(b.num_columns - 1)),
                                                      pa.array([m.tobytes()], pa.binary())], b.schema.names)

            held = materialize(held.mapInArrow(moved, schema), "tree-blocks")
            for v in fresh.values():
                v.clear()
    return done


def settings(spec) -> dict:
    return {"kind": type(spec).__name__, **{k: v for k, v in asdict(spec).items() if not (k == "leaves" and isinstance(spec, Forest))}}


def from_settings(values: dict):
    values = dict(values)
    return {"Forest": Forest, "Boosting": Boosting}[values.pop("kind")](**values)
