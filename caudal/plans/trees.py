"""Histogram trees: how one tree grows from sums of gradients by bin, whoever adds them up.

A value is read as one of `BINS` bins, a missing one as a bin of its own. A node's histogram holds, for each feature and bin, the sums of gradient
and hessian of its rows. From it the best split follows: a threshold and the side that missing values take, both learnt; for a
category the bins in order of their ratio of gradient to hessian. A tree grows level by level; where its leaves are bounded,
the splits of a level that gain most come first.

Growing is written as generators that ask for histograms (`Start`, `Level`) and hand in finished trees (`Grown`). The same steps run
over arrays in one task or over a table on all of Spark (`caudal.plans.boosting`).
"""

from __future__ import annotations

from collections.abc import Generator
from dataclasses import dataclass, field

import numpy as np

BINS = 64
MISSING = BINS
WIDTH = BINS + 1
CATEGORY_SMOOTH, CATEGORY_L2 = 10.0, 10.0
CHUNK = 256  # nodes whose splits are sought at once
ASKED = 1024  # nodes whose histograms are asked for at once
PATIENCE = 50
VALIDATION_MONTHS = 2
LEAST_GAIN = 1e-9
_MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Budget:
    """How many trees: boosting stops early below `max_trees`, and is refit with at least `min_trees`."""

    max_trees: int = 1500
    min_trees: int = 20
    rf_trees: int = 200


@dataclass(frozen=True)
class Fit:
    """One model: `group` names whose forecast it belongs to, `block` which trees of a forest (first, end)."""

    group: str
    kind: str
    params: dict = field(hash=False)
    train_to: int
    seed: int = 0
    budget: Budget = Budget()
    block: tuple[int, int] | None = None

    @property
    def forest(self) -> bool:
        return self.kind == "rf"


# ---- randomness that depends on the row, not on where it lies ------------------------------------------------------------


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def uniform(rows: np.ndarray, seed: int, number: int) -> np.ndarray:
    """A number in [0, 1) for each row hash, the same wherever the row is."""
    key = mixed(np.array([seed * 1_000_003 + number + 1], dtype=np.uint64) * _MIX)
    return (mixed(rows ^ key) >> np.uint64(11)).astype(np.float64) / 2**53


def weights_of(fit: Fit, rows: np.ndarray, number: int) -> np.ndarray | None:
    """How often each row counts in tree `number`: a forest draws with replacement (counts are Poisson), boosting without.
    None: all once."""
    share = fit.params.get("row_share", 1.0)
    if fit.forest:
        chance, total, steps = np.exp(-share), 0.0, []
        for k in range(1, 20):
            total += chance
            steps.append(total)
            chance *= share / k
        return np.searchsorted(np.array(steps), uniform(rows, fit.seed, number), side="right").astype(np.float64)
    return None if share >= 1 else (uniform(rows, fit.seed, number) < share).astype(np.float64)


def columns_of(fit: Fit, number: int, nodes: int, features: int, level: int) -> np.ndarray:
    """(nodes, features): which features may split. Boosting draws once a tree, a forest once a node."""
    share = fit.params.get("column_share", 1.0)
    many = max(1, round(share * features))
    if many >= features:
        return np.ones((nodes, features), dtype=bool)
    rng = np.random.default_rng([fit.seed, number, level if fit.forest else 0])
    ranks = rng.random((nodes if fit.forest else 1, features)).argsort(axis=1).argsort(axis=1)
    return np.broadcast_to(ranks < many, (nodes, features))


# ---- objectives ----------------------------------------------------------------------------------------------------------


def gradients(fit: Fit, y: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivative of the Tweedie deviance under a log link; a forest's trees are means of y."""
    if fit.forest:
        return -y, np.ones_like(y)
    power = fit.params["power"]
    low, high = np.exp((1 - power) * raw), np.exp((2 - power) * raw)
    return high - y * low, (2 - power) * high - (1 - power) * y * low


def start_of(fit: Fit, mean: float) -> float:
    return 0.0 if fit.forest else float(np.log(max(mean, 1e-9)))


def response(fit_kind: str, raw: np.ndarray) -> np.ndarray:
    return np.maximum(raw, 0.0) if fit_kind == "rf" else np.exp(np.clip(raw, -30, 30))


# ---- splits --------------------------------------------------------------------------------------------------------------


def worth(fit: Fit, g: np.ndarray, h: np.ndarray, extra: float = 0.0) -> np.ndarray:
    """What a node with these sums takes off the loss (twice, less a constant)."""
    h = np.maximum(h, 1e-300)
    if fit.params.get("criterion") == "poisson":
        return np.where(g < 0, 2 * -g * np.log(np.maximum(-g, 1e-300) / h), 0.0)
    l1 = fit.params.get("l1", 0.0)
    return np.square(np.maximum(np.abs(g) - l1, 0) if l1 else g) / (h + (fit.params.get("l2", 0.0) + extra))


def leaf_value(fit: Fit, g: np.ndarray, h: np.ndarray) -> np.ndarray:
    shrunk = np.sign(g) * np.maximum(np.abs(g) - fit.params.get("l1", 0.0), 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        out = np.where(h > 0, -shrunk / (h + fit.params.get("l2", 0.0)), 0.0)
    return out if fit.forest else out * fit.params["rate"]


@dataclass
class Tree:
    """Nodes by number; node 0 is the root. feature -1: a leaf. A row goes left where its bin is at most `threshold`, or for a
    category where `members` has its bin."""

    feature: np.ndarray = field(default_factory=lambda: np.full(1, -1, np.int32))
    threshold: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int32))
    missing_left: np.ndarray = field(default_factory=lambda: np.zeros(1, bool))
    left: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int32))
    value: np.ndarray = field(default_factory=lambda: np.zeros(1))
    members: dict[int, np.ndarray] = field(default_factory=dict)

    def step(self, node: np.ndarray, bins: np.ndarray, rows: np.ndarray | slice = slice(None)) -> np.ndarray:
        """The next node of rows that stand in `node`; `bins` has a row of values for each feature. The right child follows the left."""
        feature = self.feature[node]
        inner = np.flatnonzero(feature >= 0)
        at, f = node[inner], feature[inner]
        where = np.arange(bins.shape[1])[rows][inner] if not isinstance(rows, slice) else inner
        b = bins[f, where].astype(np.int64)
        left = np.where(b == MISSING, self.missing_left[at], b <= self.threshold[at])
        for k, members in self.members.items():
            here = at == k
            left[here] = members[b[here]]
        out = node.copy()
        out[inner] = self.left[at] + ~left
        return out

    def leaves(self, bins: np.ndarray) -> np.ndarray:
        node = np.zeros(bins.shape[1], dtype=np.int64)
        while True:
            after = self.step(node, bins)
            if (after == node).all():
                return node
            node = after

    def grow(self, nodes: np.ndarray, splits: Splits, which: np.ndarray, values: np.ndarray) -> list[int]:
        """`nodes` become inner nodes with the splits `which`; values: (nodes, 2) of their children. The new nodes, pair by pair."""
        first, many = len(self.feature), 2 * len(nodes)
        self.feature = np.concatenate([self.feature, np.full(many, -1, np.int32)])
        for name in ("threshold", "left", "missing_left"):
            own = getattr(self, name)
            setattr(self, name, np.concatenate([own, np.zeros(many, own.dtype)]))
        self.value = np.concatenate([self.value, values.ravel()])
        self.feature[nodes], self.threshold[nodes], self.missing_left[nodes] = splits.feature[which], splits.threshold[which], splits.missing_left[which]
        self.left[nodes] = first + 2 * np.arange(len(nodes))
        self.members.update({int(n): splits.members[k] for n, k in zip(nodes, which, strict=True) if splits.members[k] is not None})
        return list(range(first, first + many))


@dataclass
class Splits:
    gain: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    missing_left: np.ndarray
    members: list[np.ndarray | None]
    sums: np.ndarray  # (nodes, 2): gradient and hessian
    children: np.ndarray  # (nodes, 2, 2): of the left and of the right child

    @classmethod
    def joined(cls, parts: list[Splits]) -> Splits:
        whole = {n: np.concatenate([getattr(p, n) for p in parts]) for n in ("gain", "feature", "threshold", "missing_left", "sums", "children")}
        return cls(**whole, members=[m for p in parts for m in p.members])


def best_splits(fit: Fit, hist: np.ndarray, allowed: np.ndarray, category: int | None, share: float) -> Splits:
    """The best split of each node. hist: (2, features, nodes, WIDTH); `share`: rows over hessian, from which the rows of a child are
    estimated. Features are gone through some at a time, so that what they need stays in cache."""
    features, nodes = hist.shape[1:3]
    at, sums = np.arange(nodes), hist[:, 0].sum(axis=2).T
    whole_g, whole_h = sums[None, :, :1], sums[None, :, 1:]
    base = worth(fit, sums[:, 0], sums[:, 1])
    # Gains are told apart to nine digits, so that equal splits tie whatever the order in which rows were added up.
    unit = np.maximum(np.abs(base), 1e-200) * 1e-9
    least = max(fit.params.get("min_weight", 0.0 if fit.forest else 1e-3), (fit.params.get("min_rows", 0) - 1e-6) / share if share > 0 else 0.0, 1e-12)
    out = Splits(np.full(nodes, -np.inf), np.zeros(nodes, np.int64), np.zeros(nodes, np.int64), np.zeros(nodes, bool), [None] * nodes, sums, np.zeros((nodes, 2, 2)))
    together, blocks = max(1, 2 * CHUNK // nodes), []
    for low, high in ((0, features),) if category is None else ((0, category), (category, category + 1), (category + 1, features)):
        blocks += [(a, min(a + together, high)) for a in range(low, high, together)]
    for first, end in blocks:
        g, h, extra, members = hist[0, first:end, :, :BINS], hist[1, first:end, :, :BINS], 0.0, None
        if first == category:  # bins in order of their ratio; those without rows come last
            members = np.argsort(np.where(h > 0, g / (h + CATEGORY_SMOOTH), np.inf), axis=2, kind="stable")
            g, h, extra = np.take_along_axis(g, members, axis=2), np.take_along_axis(h, members, axis=2), CATEGORY_L2
        gl, hl = g.cumsum(axis=2), h.cumsum(axis=2)
        missing = hist[:, first:end, :, MISSING, None]
        for side in (False, True):
            if side:
                if members is not None or not missing[1].any():
                    break
                gl, hl = gl + missing[0], hl + missing[1]
            gr, hr = whole_g - gl, whole_h - hl
            ok = (hl >= least) & (hr >= np.maximum(least, 1e-9 * whole_h))
            gain = np.rint(np.where(ok, worth(fit, gl, hl, extra) + worth(fit, gr, hr, extra), -np.inf) / unit[:, None])
            cut = gain.argmax(axis=2)
            top = np.where(allowed[:, first:end].T, np.take_along_axis(gain, cut[..., None], axis=2)[..., 0], -np.inf)
            k = top.argmax(axis=0)
            best, cut = top[k, at] * unit - base, cut[k, at]
            better = np.flatnonzero(best > out.gain)
            out.gain[better], out.feature[better], out.threshold[better], out.missing_left[better] = best[better], first + k[better], cut[better], side
            out.children[better, 0, 0], out.children[better, 0, 1] = gl[k[better], better, cut[better]], hl[k[better], better, cut[better]]
            for n in better if members is not None else ():
                inside = np.zeros(WIDTH, dtype=bool)
                inside[members[0, n, : cut[n] + 1]] = True
                out.members[n] = inside
    out.children[:, 1] = sums - out.children[:, 0]
    out.members = [m if f == category else None for m, f in zip(out.members, out.feature, strict=True)]
    return out


# ---- steps ---------------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Phase:
    """Rows with a target up to `train_to`; a probe keeps the last months of these apart for validation."""

    fit: Fit
    probe: bool


@dataclass
class Start:
    """Asks for (mean of y, rows, validation rows) of a phase; its raw scores begin at `start_of`."""

    phase: Phase


@dataclass
class Level:
    """Asks for the histograms of `nodes` of a tree that is growing. `parents`: pairs of nodes lie next to each other."""

    phase: Phase
    number: int
    tree: Tree
    nodes: list[int]


@dataclass
class Grown:
    """Hands in a tree; the answer is the absolute error over the validation rows, if there are any."""

    phase: Phase
    number: int
    tree: Tree


Steps = Generator


def one_tree(phase: Phase, number: int, features: int, category: int | None, rows: int) -> Steps:
    fit, tree, nodes, level, leaves = phase.fit, Tree(), [0], 0, 1
    most = fit.params.get("leaves", 1 << 30)
    deepest = fit.params.get("depth", 64)
    share = None
    while nodes and level < deepest and leaves < most:
        allowed = columns_of(fit, number, len(nodes), features, level)
        found = []
        for asked in range(0, len(nodes), ASKED):
            hist = yield Level(phase, number, tree, nodes[asked : asked + ASKED])
            if share is None:  # rows per unit of hessian, as in the whole tree
                total = hist[1, 0, 0].sum()
                share = (1.0 if fit.forest else rows * min(1.0, fit.params.get("row_share", 1.0)) / total) if total > 0 else 0.0
            for a in range(0, hist.shape[2], CHUNK):
                part, at = hist[:, :, a : a + CHUNK], asked + a
                splits = best_splits(fit, part, allowed[at : at + CHUNK], category, share)
                found.append(splits)
        splits = Splits.joined(found)
        if level == 0:
            tree.value[0] = leaf_value(fit, splits.sums[:, 0], splits.sums[:, 1])[0]
        which = np.flatnonzero(splits.gain > max(LEAST_GAIN, fit.params.get("gain", 0.0)))
        which = np.sort(which[np.argsort(-splits.gain[which], kind="stable")][: most - leaves])
        below = tree.grow(np.array(nodes)[which], splits, which, leaf_value(fit, splits.children[which, :, 0], splits.children[which, :, 1])) if len(which) else []
        leaves += len(which)
        nodes, level = below, level + 1
    return tree


def boosted(fit: Fit, features: int, category: int | None) -> Steps:
    """(start, trees): a probe tells the number of trees that `PATIENCE` more do not beat; then all rows are fitted with so many."""
    probe = Phase(fit, True)
    _, rows, kept_apart = yield Start(probe)
    trees = fit.budget.min_trees
    if rows and kept_apart:
        best, least = 0, np.inf
        for number in range(fit.budget.max_trees):
            tree = yield from one_tree(probe, number, features, category, rows)
            error = yield Grown(probe, number, tree)
            if error < least:
                best, least = number, error
            elif number - best >= PATIENCE:
                break
        trees = max(best + 1, fit.budget.min_trees)
    final = Phase(fit, False)
    mean, rows, _ = yield Start(final)
    out = []
    for number in range(trees if rows else 0):
        tree = yield from one_tree(final, number, features, category, rows)
        yield Grown(final, number, tree)
        out.append(tree)
    return start_of(fit, mean), out


def forest(fit: Fit, features: int) -> Steps:
    """(0, trees): the trees of the fit's block, each on its own draw of all rows."""
    phase = Phase(fit, False)
    _, rows, _ = yield Start(phase)
    first, end = fit.block or (0, fit.budget.rf_trees)
    out = []
    for number in range(first, end) if rows else ():
        tree = yield from one_tree(phase, number, features, None, rows)
        out.append(tree)
    return 0.0, out


def steps_of(fit: Fit, features: list[str]) -> Steps:
    if fit.forest:
        return forest(fit, len(features))
    category = features.index("planta_code") if fit.kind == "lgbm" and "planta_code" in features else None
    return boosted(fit, len(features), category)


# ---- bins and models -----------------------------------------------------------------------------------------------------


def edges_of(x: np.ndarray) -> np.ndarray:
    """Where the bins of a feature end: its quantiles, the smallest value that so large a share is at most as large as."""
    x = x[~np.isnan(x)]
    return np.unique(np.quantile(x, np.arange(1, BINS) / BINS, method="inverted_cdf")) if len(x) else np.zeros(0)


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """(rows, features) of values to (features, rows) of bins."""
    out = np.empty((len(edges), len(x)), dtype=np.uint8)
    for k, e in enumerate(edges):
        column = x[:, k]
        out[k] = np.where(np.isnan(column), MISSING, np.searchsorted(e, column, side="left"))
    return out


@dataclass
class Model:
    kind: str
    features: list[str]
    edges: list[np.ndarray]
    start: float
    trees: list[Tree]

    def raw(self, x: np.ndarray) -> np.ndarray:
        """The start and all trees' values added up. x: (rows, features)."""
        bins = binned(x, self.edges)
        out = np.full(len(x), self.start)
        for tree in self.trees:
            out += tree.value[tree.leaves(bins)]
        return out


def combined(parts: list[Model], x: np.ndarray) -> np.ndarray:
    """The forecast of one kind; the blocks of a forest are averaged tree by tree. Never below 0."""
    total = sum(m.raw(x) for m in parts)
    if parts[0].kind == "rf":
        total = total / max(sum(len(m.trees) for m in parts), 1)
    return response(parts[0].kind, total)
