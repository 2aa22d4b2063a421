"""Growing regression trees from histograms of binned columns.

Every grower is a coroutine over the rows of one task. It yields ``(operation, array)`` with its own
rows' sums (or largest values) and goes on with those of all tasks, so one task and many run the same
code. Splits maximise G**2 / (H + lambda) summed over both children, with G the sums of the targets
and H those of the weights; near-equal gains go to the first feature and bin, whatever the
order of summation.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Generator
from dataclasses import dataclass

import numpy as np

from .packed import Tables, Trees

TIE = 1e-10


@dataclass(frozen=True)
class TreeParams:
    """What a grower may do; ``grow`` is ``level``, ``leaf`` or ``oblivious``, ``kind`` is ``boost``, ``ordered``, ``adaboost`` or ``forest``."""

    kind: str = "boost"
    grow: str = "level"
    trees: int = 100
    rate: float = 0.1
    depth: int = 6
    leaves: int = 31
    min_leaf: int = 1
    min_split: int = 2
    min_hessian: float = 0.0
    reg_lambda: float = 0.0
    gamma: float = 0.0
    row_share: float = 1.0
    column_share: float = 1.0
    node_columns: str | int | None = None
    seed: int = 42
    first_tree: int = 0

    def __post_init__(self):
        deepest = 16 if self.kind == "ordered" else 64
        if self.trees < 1 or not 1 <= self.depth <= deepest:
            raise ValueError(f"{self.trees} trees of depth {self.depth}: at least one tree and a depth of 1 to {deepest} are needed")
        if self.rate <= 0 or not 0 < self.row_share <= 1 or not 0 < self.column_share <= 1:
            raise ValueError("rates must be positive, shares above 0 and at most 1")

    def columns_of(self, features: int) -> int:
        """Features drawn for a node: ``sqrt`` or ``log2`` of their number, a number, or all."""
        if self.node_columns is None:
            return features
        if isinstance(self.node_columns, str):
            return max(1, int({"sqrt": math.sqrt, "log2": math.log2}[self.node_columns](features)))
        return min(features, int(self.node_columns))


class Binned:
    """Rows as bin numbers: bin b of a feature holds values at most edges[b]; the last bin is for missing ones."""

    def __init__(self, x: np.ndarray, edges: list[np.ndarray]):
        self.edges = edges
        self.width = max((len(e) for e in edges), default=0) + 2
        self.bins = np.empty(x.shape, np.int64)
        for f, e in enumerate(edges):
            self.bins[:, f] = np.where(np.isnan(x[:, f]), self.width - 1, np.searchsorted(e, x[:, f], side="left"))

    def threshold(self, feature: int, cut: int) -> float:
        edges = self.edges[feature]
        return float(edges[cut]) if cut < len(edges) else math.inf


def mix(*values) -> np.ndarray:
    """A 64-bit hash of numbers or arrays, the same in every task."""
    out = np.uint64(0x243F6A8885A308D3)
    with np.errstate(over="ignore"):
        for v in values:
            out = out ^ np.asarray(v).astype(np.uint64)
            out = (out ^ (out >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            out = (out ^ (out >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            out = out ^ (out >> np.uint64(31))
    return out


def share(*values) -> np.ndarray:
    """A number in [0, 1) from :func:`mix`."""
    return (mix(*values) >> np.uint64(11)).astype(np.float64) / 2.0**53


def some_columns(count: int, of: int, *key) -> np.ndarray:
    """A mask of ``count`` of the features, drawn by hash."""
    out = np.zeros(of, bool)
    out[np.argsort(share(*key, np.arange(of)), kind="stable")[:count]] = True
    return out


class _Nodes:
    """A tree while it grows."""

    def __init__(self):
        self.feature, self.threshold, self.left, self.right, self.missing_left, self.value = [], [], [], [], [], []

    def add(self, value: float) -> int:
        at = len(self.value)
        for column, v in ((self.feature, 0), (self.threshold, math.inf), (self.left, at), (self.right, at), (self.missing_left, True), (self.value, value)):
            column.append(v)
        return at

    def split(self, at: int, feature: int, threshold: float, missing_left: bool, left: int, right: int) -> None:
        self.feature[at], self.threshold[at], self.missing_left[at] = feature, threshold, missing_left
        self.left[at], self.right[at] = left, right

    def done(self) -> Trees:
        ints = lambda v: np.array(v, np.int32)
        return Trees(
            np.zeros(1, np.int32), ints(self.feature), np.array(self.threshold, float), ints(self.left), ints(self.right),
            np.array(self.missing_left, bool), np.array(self.value, float),
        )


def _histogram(data: Binned, rows: np.ndarray, node: np.ndarray, nodes: int, g: np.ndarray, h: np.ndarray | None) -> np.ndarray:
    """Sums of targets, (weights) and counts by node, feature and bin, of the given rows."""
    width, stats = data.width, 2 if h is None else 3
    out = np.empty((stats, nodes, data.bins.shape[1], width))
    base = node * width
    for f in range(data.bins.shape[1]):
        at = base + data.bins[rows, f]
        size = nodes * width
        out[0, :, f] = np.bincount(at, g[rows], size).reshape(nodes, width)
        if h is not None:
            out[1, :, f] = np.bincount(at, h[rows], size).reshape(nodes, width)
        out[-1, :, f] = np.bincount(at, minlength=size).reshape(nodes, width)
    return out


def _score(g, h, reg):
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(h + reg > 0, g * g / (h + reg), 0.0)


def _value(g: float, h: float, reg: float) -> float:
    return g / (h + reg) if h + reg > 0 else 0.0


def best_splits(hist: np.ndarray, p: TreeParams, columns: np.ndarray):
    """(feature, cut, missing left, gain, left sums, right sums) of the best split of every node.

    ``columns`` masks the features by node. A gain of minus infinity means that none is allowed.
    """
    whole = hist[:, :, 0, :].sum(axis=-1)
    left = np.cumsum(hist[..., :-1], axis=-1)
    ways = [left, left + hist[..., -1:]] if hist[-1, ..., -1].any() else [left]
    left = np.stack(ways, axis=-1)
    right = whole[:, :, None, None, None] - left
    g, h, c = 0, 1, -1
    scores = _score(left[g], left[h], p.reg_lambda) + _score(right[g], right[h], p.reg_lambda)
    # Subtracted histograms keep rounding errors; counts are whole numbers and exact.
    allowed = (left[c] >= max(1, p.min_leaf)) & (right[c] >= max(1, p.min_leaf)) & columns[:, :, None, None]
    if p.min_hessian > 0:
        allowed &= (left[h] >= p.min_hessian) & (right[h] >= p.min_hessian)
    if len(hist) == 3:
        allowed &= (left[h] > 0) & (right[h] > 0)
    allowed &= (whole[c] >= p.min_split)[:, None, None, None]
    nodes = np.arange(hist.shape[1])
    flat = np.where(allowed, scores, -np.inf).reshape(len(nodes), -1)
    top = flat.max(axis=1)
    pick = np.argmax(flat >= (top - TIE * np.abs(top))[:, None], axis=1)
    feature, cut, way = np.unravel_index(pick, scores.shape[1:])
    at = (slice(None), nodes, feature, cut, way)
    gain = flat[nodes, pick] - _score(whole[g], whole[h], p.reg_lambda)
    enough = (gain > np.maximum(2 * p.gamma, TIE * np.abs(top))) & np.isfinite(top)
    return feature, cut, way == 1 if len(ways) > 1 else left[-1][(nodes, feature, cut, way)] * 2 >= whole[-1], np.where(enough, gain, -np.inf), left[at], right[at]


def _columns(p: TreeParams, features: int, tree: int, nodes) -> np.ndarray:
    """Allowed features by node: sampled once a tree, then once a node."""
    of_tree = np.ones(features, bool)
    if p.column_share < 1:
        of_tree = some_columns(max(1, int(features * p.column_share)), features, p.seed, 1, tree)
    if p.columns_of(features) >= features:
        return np.broadcast_to(of_tree, (len(nodes), features))
    return np.array([some_columns(p.columns_of(features), features, p.seed, 2, tree, n) for n in nodes])


def grow_levels(data: Binned, p: TreeParams, g, h, rows, tree: int) -> Generator:
    """All nodes of a level at once; returns the tree and the node of every row.

    ``rows`` are the sampled rows, which alone shape the tree; ``h`` is None for equal weights.
    Of two children the smaller is counted, the other is what is left of the parent.
    """
    n, features = data.bins.shape
    made, at = _Nodes(), np.zeros(n, np.int64)
    hist = yield "sum", _histogram(data, rows, np.zeros(len(rows), np.int64), 1, g, h)
    sums = hist[:, 0, 0].sum(axis=-1)
    open_ids = [made.add(_value(sums[0], sums[1 if h is not None else -1], p.reg_lambda))]
    place = np.full(n, 0)
    for depth in range(p.depth):
        feature, cut, missing, gain, left, right = best_splits(hist, p, _columns(p, features, tree, open_ids))
        chosen = np.flatnonzero(np.isfinite(gain))
        if not len(chosen):
            break
        weight = 1 if h is not None else -1
        ids = []
        for i in chosen.tolist():
            pair = [made.add(_value(s[0, i], s[weight, i], p.reg_lambda)) for s in (left, right)]
            made.split(open_ids[i], int(feature[i]), data.threshold(int(feature[i]), int(cut[i])), bool(missing[i]), *pair)
            ids.append(pair)
        ids = np.array(ids)
        # Rows of split nodes move to the children; the others are at rest.
        number = np.full(len(open_ids) + 1, -1)
        number[chosen] = np.arange(len(chosen))
        now = number[place]
        moving = np.flatnonzero(now >= 0)
        which = now[moving]
        parent = chosen[which]
        bins = data.bins[moving, feature[parent]]
        goes_right = np.where(bins == data.width - 1, ~missing[parent], bins > cut[parent]).astype(np.int64)
        at[moving] = ids[which, goes_right]
        if depth + 1 == p.depth:
            break
        small = (left[-1, chosen] > right[-1, chosen]).astype(np.int64)
        side, pair_of = np.full(n, -1), np.full(n, -1)
        side[moving], pair_of[moving] = goes_right, which
        counted = rows[(pair_of[rows] >= 0) & (side[rows] == small[pair_of[rows]])]
        fewer = yield "sum", _histogram(data, counted, pair_of[counted], len(chosen), g, h)
        more = hist[:, chosen] - fewer
        both = np.empty((hist.shape[0], len(chosen), 2, *hist.shape[2:]))
        pairs = np.arange(len(chosen))
        both[:, pairs, small], both[:, pairs, 1 - small] = fewer, more
        sizes = np.stack([left[-1, chosen], right[-1, chosen]], axis=1).reshape(-1)
        going = np.flatnonzero(sizes >= max(p.min_split, 2 * p.min_leaf, 2))
        if not len(going):
            break
        hist = both.reshape(hist.shape[0], -1, *hist.shape[2:])[:, going]
        open_ids = ids.reshape(-1)[going].tolist()
        number = np.full(2 * len(chosen) + 1, len(going))
        number[going] = np.arange(len(going))
        place = np.full(n, len(going))
        place[moving] = number[2 * which + goes_right]
    return made.done(), at


def grow_leaves(data: Binned, p: TreeParams, g, h, rows, tree: int) -> Generator:
    """Best leaf first, up to ``p.leaves`` of them; otherwise as :func:`grow_levels`."""
    n, features = data.bins.shape
    weight = 1 if h is not None else -1
    sampled = np.zeros(n, bool)
    sampled[rows] = True
    made, at = _Nodes(), np.zeros(n, np.int64)
    hist = yield "sum", _histogram(data, rows, np.zeros(len(rows), np.int64), 1, g, h)
    sums = hist[:, 0, 0].sum(axis=-1)
    root = made.add(_value(sums[0], sums[weight], p.reg_lambda))
    waiting, held = [], {}

    def consider(nodes: list[int], hists: np.ndarray, members: list[np.ndarray], depth: int) -> None:
        if depth >= p.depth:
            return
        found = best_splits(hists, p, _columns(p, features, tree, nodes))
        for i, node in enumerate(nodes):
            if np.isfinite(found[3][i]):
                # Gains equal up to rounding keep the order in which leaves were made.
                heapq.heappush(waiting, (-float(f"{found[3][i]:.9e}"), node))
                held[node] = ([f[i] for f in found[:4]], found[4][:, i], found[5][:, i], hists[:, i], members[i], depth)

    consider([root], hist, [np.arange(n)], 0)
    leaves = 1
    while waiting and leaves < p.leaves:
        _, node = heapq.heappop(waiting)
        (feature, cut, missing, _), left, right, hist, members, depth = held.pop(node)
        pair = [made.add(_value(s[0], s[weight], p.reg_lambda)) for s in (left, right)]
        made.split(node, int(feature), data.threshold(int(feature), int(cut)), bool(missing), *pair)
        bins = data.bins[members, feature]
        goes_right = np.where(bins == data.width - 1, not missing, bins > cut)
        parts = [members[~goes_right], members[goes_right]]
        at[parts[0]], at[parts[1]] = pair
        leaves += 1
        if leaves >= p.leaves or depth + 1 >= p.depth or max(left[-1], right[-1]) < max(p.min_split, 2 * p.min_leaf):
            continue
        small = int(left[-1] > right[-1])
        counted = parts[small][sampled[parts[small]]]
        fewer = (yield "sum", _histogram(data, counted, np.zeros(len(counted), np.int64), 1, g, h))[:, 0]
        both = [fewer, hist - fewer] if small == 0 else [hist - fewer, fewer]
        consider(pair, np.stack(both, axis=1), parts, depth + 1)
    return made.done(), at


def _sampled(p: TreeParams, key: np.ndarray, tree: int) -> np.ndarray:
    return np.arange(len(key)) if p.row_share >= 1 else np.flatnonzero(share(p.seed, 3, tree, key) < p.row_share)


def boost(data: Binned, y: np.ndarray, key: np.ndarray, p: TreeParams) -> Generator:
    """Squared-error boosting: every tree is fitted to the residuals, its values shrunk by ``p.rate``."""
    n, total = yield "sum", np.array([float(len(y)), y.sum()])
    base = total / n
    predicted, made = np.full(len(y), base), []
    grow = grow_leaves if p.grow == "leaf" else grow_levels
    for t in range(p.trees):
        tree, at = yield from grow(data, p, y - predicted, None, _sampled(p, key, t), t)
        tree.value = tree.value * p.rate
        predicted = predicted + tree.value[at]
        made.append(tree)
    return {"ensemble": Trees.join(made), "how": "sum", "base": base, "weights": np.ones(1)}


def grow_oblivious(data: Binned, p: TreeParams, g) -> Generator:
    """One split for all nodes of a level; returns the splits and every row's leaf number."""
    n = len(g)
    rows, at, splits = np.arange(n), np.zeros(n, np.int64), []
    hist = yield "sum", _histogram(data, rows, at, 1, g, None)
    for depth in range(p.depth):
        whole = hist[:, :, 0, :].sum(axis=-1)
        left = np.cumsum(hist[..., :-1], axis=-1) + hist[..., -1:]
        right = whole[:, :, None, None] - left
        score = (_score(left[0], left[1], p.reg_lambda) + _score(right[0], right[1], p.reg_lambda)).sum(axis=0)
        # A split that leaves everything on one side says nothing.
        score = np.where((right[1].sum(axis=0) > 0) & (left[1].sum(axis=0) > 0), score, -np.inf).reshape(-1)
        top = score.max()
        now = _score(whole[0], whole[1], p.reg_lambda).sum()
        if not np.isfinite(top) or top - now <= TIE * abs(top):
            break
        feature, cut = np.unravel_index(int(np.argmax(score >= top - TIE * abs(top))), left.shape[2:])
        splits.append((int(feature), data.threshold(int(feature), int(cut))))
        bins = data.bins[:, feature]
        goes_right = ((bins > cut) & (bins != data.width - 1)).astype(np.int64)
        at = 2 * at + goes_right
        if depth + 1 < p.depth:
            # The right children are counted, the left ones are what is left.
            counted = rows[goes_right == 1]
            part = yield "sum", _histogram(data, counted, at[counted] >> 1, hist.shape[1], g, None)
            hist = np.stack([hist - part, part], axis=2).reshape(2, -1, *hist.shape[2:])
    return splits, at


def ordered_boost(data: Binned, y: np.ndarray, key: np.ndarray, p: TreeParams) -> Generator:
    """Ordered boosting of oblivious trees.

    A hash of the row fixes a permutation. Rows of level j, the j-th doubling of its prefixes, get
    their residuals from a model that has learned from the rows of lower levels only; those residuals
    shape the trees. The values that are kept come from all rows.
    """
    n, total = yield "sum", np.array([float(len(y)), y.sum()])
    base, levels = total / n, max(1, math.ceil(math.log2(max(n, 2))))
    place = share(p.seed, 5, key)
    with np.errstate(divide="ignore"):
        level = np.clip(np.floor(np.log2(place)) + levels, 0, levels - 1).astype(np.int64)
    rows = np.arange(len(y))
    learns = level[:, None] < np.arange(levels + 1)
    predicted = np.full((len(y), levels + 1), base)
    features, thresholds, values = [], [], []
    for _ in range(p.trees):
        splits, at = yield from grow_oblivious(data, p, y - predicted[rows, level])
        size = 1 << len(splits)
        sums = np.zeros((2, levels + 1, size))
        for j in range(levels + 1):
            mine = learns[:, j] if j < levels else np.ones(len(y), bool)
            sums[0, j] = np.bincount(at[mine], (y - predicted[:, j])[mine], size)
            sums[1, j] = np.bincount(at[mine], minlength=size)
        sums = yield "sum", sums
        with np.errstate(divide="ignore", invalid="ignore"):
            steps = np.where(sums[1] + p.reg_lambda > 0, p.rate * sums[0] / (sums[1] + p.reg_lambda), 0.0)
        predicted += steps[:, at].T
        missing = p.depth - len(splits)
        features.append([f for f, _ in splits] + [0] * missing)
        thresholds.append([t for _, t in splits] + [math.inf] * missing)
        values.append(np.concatenate([steps[levels][:, None], np.zeros((size, (1 << missing) - 1))], axis=1).reshape(-1))
    shape = (p.trees, p.depth)
    tables = Tables(np.array(features, np.int32).reshape(shape), np.array(thresholds, float).reshape(shape), np.array(values).reshape(p.trees, -1))
    return {"ensemble": tables, "how": "sum", "base": base, "weights": np.ones(1)}


def adaboost(data: Binned, y: np.ndarray, key: np.ndarray, p: TreeParams) -> Generator:
    """AdaBoost.R2 with linear loss: rows are weighted anew after every tree; the median of the trees counts."""
    (n,) = yield "sum", np.array([float(len(y))])
    w, made, weights = np.ones(len(y)), [], []
    rows = np.arange(len(y))
    for t in range(p.trees):
        tree, at = yield from grow_levels(data, p, w * y, w, rows, t)
        error = np.abs(tree.value[at] - y)
        (top,) = yield "max", np.array([error[w > 0].max(initial=0.0)])
        loss_sum, weight_sum = yield "sum", np.array([(w * error).sum(), w.sum()])
        if not top:
            made, weights = [*made, tree], [*weights, 1.0]
            break
        loss = loss_sum / (top * weight_sum)
        if loss >= 0.5:
            if not made:
                made, weights = [tree], [1.0]
            break
        beta = loss / (1.0 - loss)
        made.append(tree)
        weights.append(p.rate * math.log(1.0 / beta))
        # Divided by the mean weight, so that many rounds do not underflow.
        w = w * beta ** (p.rate * (1.0 - error / top)) * (n / weight_sum)
    return {"ensemble": Trees.join(made), "how": "median", "base": 0.0, "weights": np.array(weights)}


# Poisson(1): the chance of at most 0, 1, 2, ... draws of a row.
_DRAWS = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(12)])


def forest(data: Binned, y: np.ndarray, key: np.ndarray, p: TreeParams) -> Generator:
    """Trees over bootstrap draws; the number of draws of a row is a hash of row and tree."""
    made = []
    for t in range(p.first_tree, p.first_tree + p.trees):
        draws = np.searchsorted(_DRAWS, share(p.seed, 7, t, key), side="right").astype(float)
        tree, _ = yield from grow_levels(data, p, draws * y, draws, np.flatnonzero(draws), t)
        made.append(tree)
    return {"ensemble": Trees.join(made), "how": "mean", "base": 0.0, "weights": np.ones(1)}


KINDS = {"boost": boost, "ordered": ordered_boost, "adaboost": adaboost, "forest": forest}
