"""Gradient boosting of regression trees on binned features, grown leaf by leaf.

Features are cut into bins, once. A node's histogram has the sum of gradients and the number of rows of each (feature, bin); histograms of parts of
the rows add up, and that of the larger child is the parent's without the smaller one's. The leaf whose best split gains most is split next, until there
are `leaves` of them or no split gains anything. With a constant second derivative the gain of a split is

    GL^2 / (nL + lambda) + GR^2 / (nR + lambda) - G^2 / (n + lambda),

both sides with `min_rows` rows or more; ties go to the first feature and the lowest bin. Bins of nominal features are ordered by G / (n + lambda). A leaf's value is
-G / (n + lambda), or for quantiles the quantile of its rows' residuals; both times the learning rate. Bin 0 is for missing values.

There are two ways to grow:

- `grow`: rows stay a DataFrame of any size; histograms are grouped sums, and a leaf's best split is a window over its bins. Nothing but
  the best splits of at most `leaves` nodes comes to the driver, once for each level.
- `fit`: for samples of bounded size (the contract's 150,000 rows) and many models. Binned blocks of rows are dealt out to one task for each model, which
  boosts all its trees on whole arrays.

Both give the same trees. All trees of all models are one table of nodes; `Packed` has a model's nodes as arrays and scores blocks of rows level by level.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .errors import IntegrityError
from .session import ship

BINS = 256
#: Rows of a block on its way to a model's task, and rows that are scored at once.
BLOCK = 4096
#: A node of a tree: child is the left one, the right one stands behind it; -1 for a leaf. `right` has the bins of a nominal split that go right.
NODES = "tree int, node int, feature int, bin int, child int, right array<int>, value double, gain double, n long"


@dataclass(frozen=True)
class Growth:
    """Settings of one tree."""

    leaves: int = 63
    min_rows: int = 100
    reg_lambda: float = 1.0

    def __post_init__(self):
        if self.leaves < 2 or self.min_rows < 1 or self.reg_lambda < 0:
            raise IntegrityError(f"invalid settings of a tree: {self}")


# --- bins


def edges(rows: DataFrame, names: tuple[str, ...], most: int) -> list[np.ndarray]:
    """Upper ends of each column's bins: the distinct ones of `most` quantiles, so a column of few values keeps them; one aggregate for all columns."""
    if not 2 <= most < BINS:
        raise IntegrityError(f"there can be 2 to {BINS - 1} bins of values")
    at = [k / (most - 1) for k in range(most)]
    value = lambda x: F.when(~F.isnan(F.col(x).cast("double")), F.col(x).cast("double"))
    found = rows.agg(*[F.percentile_approx(value(x), at, 100_000).alias(f"q{k}") for k, x in enumerate(names)]).first()
    return [np.unique(np.array(found[f"q{k}"] or [], float)) for k in range(len(names))]


def binned(columns: list[np.ndarray], ends: list[np.ndarray]) -> np.ndarray:
    """Bins of each row and feature: 0 for missing values, then 1 + the number of ends below the value."""
    out = np.zeros((len(columns[0]) if columns else 0, len(columns)), np.uint8)
    for k, (x, e) in enumerate(zip(columns, ends, strict=True)):
        some = np.searchsorted(e[:-1], x, "left") + 1 if len(e) else np.ones(len(x), np.int64)
        out[:, k] = np.where(np.isnan(x), 0, some)
    return out


def bins_of(names: tuple[str, ...], ends: list[np.ndarray]) -> Column:
    """The same as an array column, without Python."""
    parts = []
    for x, e in zip(names, ends, strict=True):
        array, value = F.array(*[F.lit(float(v)) for v in e[:-1]]).cast("array<double>"), F.col(x).cast("double")
        parts.append(F.when(value.isNull() | F.isnan(value), 0).otherwise(F.size(F.filter(array, _below(value))) + 1))
    return F.array(*parts)


def _below(value: Column) -> Callable[[Column], Column]:
    return lambda end: end < value


# --- DataFrames of any size


def histogram(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, feature, bin, g, n): sums of gradients and numbers of rows; rows have `bins` and `g`."""
    each = rows.select(*keys, "g", F.posexplode("bins").alias("feature", "bin"))
    return each.groupBy(*keys, "feature", "bin").agg(F.sum("g").alias("g"), F.count("*").alias("n"))


def best_splits(found: DataFrame, growth: Growth, *keys: str, nominal: tuple[int, ...] = (), features: tuple[int, ...] | None = None) -> DataFrame:
    """(keys, feature, bin, left, gain, g, n, gl, nl): each node's best split; `left` are the bins of a nominal feature that go left. Nodes that no split improves are absent."""
    lam = F.lit(float(growth.reg_lambda))
    own = found if features is None else found.where(F.col("feature").isin(list(features)))
    is_nominal = F.col("feature").isin(list(nominal)) if nominal else F.lit(False)
    own = own.withColumn("place", F.when(is_nominal, F.col("g") / (F.col("n") + lam)).otherwise(F.col("bin").cast("double")))
    node = Window.partitionBy(*keys, "feature")  # at most 256 rows each
    upto = node.orderBy("place", "bin").rowsBetween(Window.unboundedPreceding, 0)
    sums = own.select(*keys, "feature", "bin", F.sum("g").over(upto).alias("gl"), F.sum("n").over(upto).alias("nl"), F.sum("g").over(node).alias("gt"), F.sum("n").over(node).alias("nt"), F.when(is_nominal, F.collect_list("bin").over(upto)).alias("left"))
    nr = F.col("nt") - F.col("nl")
    gl, gr, gt = (x.cast("double") for x in (F.col("gl"), F.col("gt") - F.col("gl"), F.col("gt")))  # sums of whole numbers are exact, but their squares do not fit a long
    gain = gl * gl / (F.col("nl") + lam) + gr * gr / (nr + lam) - gt * gt / (F.col("nt") + lam)
    valid = sums.where((F.col("nl") >= growth.min_rows) & (nr >= growth.min_rows)).withColumn("gain", gain).where(F.col("gain") > 1e-9 * F.greatest(F.lit(1.0), gt * gt / (F.col("nt") + lam)))
    place = F.coalesce(F.size("left"), F.col("bin"))
    first = F.max_by(F.struct("feature", "bin", "left", "gain", F.col("gt").alias("g"), F.col("nt").alias("n"), "gl", "nl"), F.struct(F.col("gain"), -F.col("feature"), -place))
    return valid.groupBy(*keys).agg(first.alias("b")).select(*keys, "b.*")


@dataclass
class Node:
    g: float
    n: int
    split: dict | None = None
    children: tuple[Node, Node] | None = None
    name: int = 0


def _goes_right(split: dict) -> Column:
    at = F.element_at("bins", split["feature"] + 1)
    return ~at.isin(split["left"]) if split["left"] is not None else at > split["bin"]


def walk(node: Node) -> Column:
    """The name of the leaf of each row: one condition for each split of the tree."""
    if not node.children:
        return F.lit(node.name).cast("long")
    return F.when(_goes_right(node.split), walk(node.children[1])).otherwise(walk(node.children[0]))


def grow(rows: DataFrame, growth: Growth, *, nominal: tuple[int, ...] = (), features: tuple[int, ...] | None = None) -> Node:
    """One tree over all rows (`bins`, `g`), leaf by leaf. Histograms of whole levels are made at once, more of them than the leaves need.

    Which leaves are split is decided from their gains in the order of best-first growth, so the tree is the same as if they were made one by one.
    """
    total = rows.agg(F.sum("g").alias("g"), F.count("*").alias("n")).first()
    root = Node(float(total["g"] or 0.0), int(total["n"]), name=1)
    nodes, fresh, kept = {1: root}, [1], None
    while fresh:
        if kept is None:
            found = histogram(rows.withColumn("node", F.lit(1).cast("long")), "node")
        else:  # of two siblings the smaller one's is summed, the other is the parent's without it
            small = [min(2 * x, 2 * x + 1, key=lambda k: (nodes[k].n, k)) for x in {k // 2 for k in fresh}]
            of_small = histogram(rows.withColumn("node", walk(root)).where(F.col("node").isin(small)), "node")
            parents = kept.where(F.col("node").isin([k // 2 for k in small]))
            other = of_small.select(F.floor(F.col("node") / 2).alias("node"), "feature", "bin", F.col("g").alias("sg"), F.col("n").alias("sn"), F.col("node").alias("small"))
            flip = parents.join(other, ["node", "feature", "bin"], "left").withColumn("large", F.col("node") * 2)
            which = F.when(F.col("large").isin(small), F.col("large") + 1).otherwise(F.col("large"))
            rest = flip.select(which.alias("node"), "feature", "bin", (F.col("g") - F.coalesce("sg", F.lit(0))).alias("g"), (F.col("n") - F.coalesce("sn", F.lit(0))).alias("n")).where("n > 0")
            found = of_small.unionByName(rest)
        before, kept = kept, found.persist()
        for r in best_splits(kept, growth, "node", nominal=nominal, features=features).collect():  # a row for each node
            nodes[r["node"]].split = r.asDict()
        if before is not None:
            before.unpersist()
        fresh = []
        for k in _wanted(root, growth.leaves):
            node = nodes[k]
            s = node.split
            node.children = Node(s["gl"], s["nl"], name=2 * k), Node(s["g"] - s["gl"], s["n"] - s["nl"], name=2 * k + 1)
            nodes |= {x.name: x for x in node.children}
            fresh += [2 * k, 2 * k + 1]
    if kept is not None:
        kept.unpersist()
    chosen = set(_chosen(root, growth.leaves))
    for node in nodes.values():
        node.children = node.children if node.name in chosen else None
    return root


def _chosen(root: Node, leaves: int) -> list[int]:
    """The nodes that best-first growth splits, in order, as far as their gains are known."""
    heap, order = [], []
    if root.split:
        heapq.heappush(heap, (-root.split["gain"], 0, root))
    born = 1
    while heap and len(order) < leaves - 1:
        _, _, node = heapq.heappop(heap)
        order.append(node.name)
        for child in node.children or ():
            if child.split:
                heapq.heappush(heap, (-child.split["gain"], born, child))
            born += 1
    return order


def _wanted(root: Node, leaves: int) -> list[int]:
    """Nodes without children that best-first growth would split with what is known."""
    at = {root.name: root}
    stack = [root]
    while stack:
        for child in stack.pop().children or ():
            at[child.name] = child
            stack.append(child)
    return [k for k in _chosen(root, leaves) if at[k].children is None]


def values(root: Node, growth: Growth) -> dict[int, float]:
    """The value of each leaf of a tree of `grow`, by its name: 1 is the root, 2k and 2k + 1 are the children of k."""
    out, stack = {}, [root]
    while stack:
        node = stack.pop()
        if node.children:
            stack += node.children
        else:
            out[node.name] = -node.g / (node.n + growth.reg_lambda)
    return out


# --- whole arrays


@dataclass
class Leaf:
    rows: np.ndarray
    g: np.ndarray  # by feature and bin
    n: np.ndarray
    at: int
    split: tuple | None = None


@dataclass
class Booster:
    """All trees of one model over the bins of a bounded sample."""

    bins: np.ndarray  # rows by features
    y: np.ndarray
    growth: Growth
    nominal: tuple[int, ...] = ()
    alpha: float | None = None
    learning_rate: float = 0.05
    row_share: float = 1.0
    column_share: float = 1.0
    seed: int = 0
    nodes: list[tuple] = field(default_factory=list)

    def __post_init__(self):
        self.columns = np.ascontiguousarray(self.bins.T)
        self.start = float(np.quantile(self.y, self.alpha) if self.alpha is not None else self.y.mean())
        self.score = np.full(len(self.y), self.start)

    def fit(self, trees: int) -> Booster:
        for k in range(trees):
            self.add(k)
        return self

    def gradients(self) -> np.ndarray:
        return self.score - self.y if self.alpha is None else np.where(self.y > self.score, -self.alpha, 1.0 - self.alpha)

    def add(self, tree: int) -> None:
        rng = np.random.default_rng((self.seed, tree))
        n, width = self.bins.shape
        rows = np.arange(n) if self.row_share == 1 else np.flatnonzero(rng.random(n) < self.row_share)
        used = np.arange(width) if self.column_share == 1 else np.sort(rng.choice(width, max(1, round(width * self.column_share)), replace=False))
        g = self.gradients()
        out: list[list] = [[tree, 0, -1, -1, -1, None, 0.0, 0.0, len(rows)]]
        first = self.leaf(rows, g, used, 0)
        done, heap, born = [], [], 1
        if first.split:
            heap.append((-first.split[0], 0, first))
        else:
            done.append(first)
        while heap and len(done) + len(heap) < self.growth.leaves:
            _, _, leaf = heapq.heappop(heap)
            gain, feature, bin_, right = leaf.split
            b = self.columns[feature][leaf.rows]
            goes = b > bin_ if right is None else np.isin(b, right)
            parts = leaf.rows[~goes], leaf.rows[goes]
            small = int(len(parts[1]) < len(parts[0]))
            child = len(out)
            out[leaf.at][2:6], out[leaf.at][7] = [feature, bin_, child, right], gain
            out += [[tree, child + k, -1, -1, -1, None, 0.0, 0.0, len(parts[k])] for k in (0, 1)]
            of_small = self.sums(parts[small], g, used)
            rest = leaf.g - of_small[0], leaf.n - of_small[1]
            for k in (0, 1):
                new = Leaf(parts[k], *(of_small if k == small else rest), child + k)
                new.split = self.best(new.g, new.n, used)
                if new.split:
                    heapq.heappush(heap, (-new.split[0], born, new))
                else:
                    done.append(new)
                born += 1
        for leaf in done + [x[2] for x in heap]:
            if self.alpha is None:
                value = -g[leaf.rows].sum() / (len(leaf.rows) + self.growth.reg_lambda)
            else:
                value = np.quantile(self.y[leaf.rows] - self.score[leaf.rows], self.alpha) if len(leaf.rows) else 0.0
            out[leaf.at][6] = float(value * self.learning_rate)
        rest = np.setdiff1d(np.arange(n), rows, assume_unique=True)
        for leaf in done + [x[2] for x in heap]:
            self.score[leaf.rows] += out[leaf.at][6]
        if len(rest):
            self.score[rest] += Packed([tuple(x) for x in out], 0.0).score(self.bins[rest])
        self.nodes += [tuple(x) for x in out]

    def leaf(self, rows: np.ndarray, g: np.ndarray, used: np.ndarray, at: int) -> Leaf:
        sums = self.sums(rows, g, used)
        return Leaf(rows, *sums, at, self.best(*sums, used))

    def sums(self, rows: np.ndarray, g: np.ndarray, used: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The histogram of some rows."""
        own = g[rows]
        if len(rows) < BLOCK:
            cells = (self.bins[np.ix_(rows, used)].astype(np.int64) + np.arange(len(used)) * BINS).ravel()
            size = len(used) * BINS
            return np.bincount(cells, np.repeat(own, len(used)), size).reshape(-1, BINS), np.bincount(cells, minlength=size).reshape(-1, BINS).astype(float)
        cells = [self.columns[f][rows].astype(np.int64) for f in used]
        return np.stack([np.bincount(x, own, BINS) for x in cells]), np.stack([np.bincount(x, minlength=BINS) for x in cells]).astype(float)

    def best(self, g: np.ndarray, n: np.ndarray, used: np.ndarray) -> tuple[float, int, int, list[int] | None] | None:
        """(gain, feature, last bin on the left, bins on the right of a nominal split)."""
        lam, least = self.growth.reg_lambda, self.growth.min_rows
        total, rows = g[0].sum(), n[0].sum()
        if rows < 2 * least:
            return None
        order = {}
        for k in np.flatnonzero(np.isin(used, self.nominal)):
            own = np.lexsort((np.arange(BINS), np.where(n[k] > 0, g[k] / (n[k] + lam), np.inf)))
            if not order:
                g, n = g.copy(), n.copy()
            order[int(k)] = own
            g[k], n[k] = g[k][own], n[k][own]
        gl, nl = g.cumsum(axis=1), n.cumsum(axis=1)
        gr, nr = total - gl, rows - nl
        gain = np.where((nl >= least) & (nr >= least), gl * gl / (nl + lam) + gr * gr / (np.maximum(nr, 0) + lam) - total * total / (rows + lam), -np.inf)
        at = int(gain.argmax())
        k, bin_ = divmod(at, BINS)
        if not gain.flat[at] > 1e-9 * max(1.0, total * total / (rows + lam)):
            return None
        right = sorted(order[k][bin_ + 1 :][n[k][bin_ + 1 :] > 0].tolist()) if k in order else None
        return float(gain.flat[at]), int(used[k]), int(bin_), right


class Packed:
    """All trees of a model as arrays of nodes, scored level by level."""

    def __init__(self, nodes: list[tuple], start: float):
        tree, node, feature, bin_, child, right, value = (list(x) for x in zip(*[x[:7] for x in nodes], strict=True)) if nodes else ([] for _ in range(7))
        tree, node, child = np.array(tree, np.int64), np.array(node, np.int64), np.array(child, np.int64)
        own = np.arange(len(tree))
        self.roots = own[node == 0]
        base = own - node  # a tree's nodes stand together, in order
        inner = child >= 0
        self.child = np.where(inner, base + child, own).astype(np.int32)
        self.feature = np.where(inner, np.array(feature, np.int64), 0).astype(np.int32)
        self.bin = np.where(inner, np.array(bin_, np.int64), BINS).astype(np.int16)
        self.value, self.start = np.array(value, float), start
        sets = [k for k, x in enumerate(right) if x is not None]
        self.set = np.full(len(tree), -1, np.int32)
        self.set[sets] = np.arange(len(sets))
        self.right = np.zeros((len(sets), BINS), bool)
        for k, at in enumerate(sets):
            self.right[k, list(right[at])] = True
        self.depth, at = 0, self.roots
        while (at := np.unique(self.child[at[inner[at]]])).size:
            at = np.concatenate((at, at + 1))
            self.depth += 1

    def score(self, bins: np.ndarray) -> np.ndarray:
        """The start and the values of all trees' leaves for each row."""
        out = np.full(len(bins), self.start)
        if not len(self.roots):
            return out
        step = max(1, (1 << 20) // len(self.roots))
        for k in range(0, len(bins), step):
            own = np.ascontiguousarray(bins[k : k + step])
            flat, row = own.ravel(), (np.arange(len(own)) * own.shape[1])[:, None]
            at = np.broadcast_to(self.roots.astype(np.int32), (len(own), len(self.roots)))
            for _ in range(self.depth):
                b = flat[row + self.feature[at]]
                goes = b > self.bin[at]
                if len(self.right):
                    which = self.set[at]
                    some = which >= 0
                    goes[some] = self.right[which[some], b[some]]
                at = self.child[at] + goes
            out[k : k + step] += self.value[at].sum(axis=1)
        return out


def fit(blocks: DataFrame, models: list[tuple[str, float | None]], *, width: int, trees: int, growth: Growth, learning_rate: float, row_share: float, column_share: float, nominal: tuple[int, ...], seed: int) -> DataFrame:
    """(channel, alpha, start, nodes) of every model; blocks: (block, n, bins binary, y_<channel> binary). alpha is NULL for the mean.

    A model's group is the sample, whose size is bounded by its maker; models are the parallel work.
    """
    ship(blocks.sparkSession)
    kinds = F.array(*[F.struct(F.lit(c).alias("channel"), F.lit(q).cast("double").alias("alpha")) for c, q in models])
    y = F.coalesce(*[F.when(F.col("m.channel") == c, F.col(f"y_{c}")) for c in dict.fromkeys(c for c, _ in models)])
    dealt = blocks.select("*", F.posexplode(kinds).alias("model", "m")).select("model", "m.channel", "m.alpha", "block", "n", "bins", y.alias("y"))

    def one(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("block").to_numpy())
        raw = lambda name, kind: np.concatenate([np.frombuffer(table.column(name)[int(k)].as_py(), kind) for k in order])
        alpha = table.column("alpha")[0].as_py()
        own = Booster(raw("bins", np.uint8).reshape(-1, width), raw("y", np.float64), growth, nominal, alpha, learning_rate, row_share, column_share, seed).fit(trees)
        columns = list(zip(*own.nodes, strict=True))
        kinds = [pa.int32()] * 5 + [pa.list_(pa.int32()), pa.float64(), pa.float64(), pa.int64()]
        m = len(own.nodes)
        head = [pa.array([table.column("channel")[0].as_py()] * m, pa.string()), pa.array([alpha] * m, pa.float64()), pa.array([own.start] * m, pa.float64())]
        return pa.Table.from_arrays(head + [pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names)

    names = ["channel", "alpha", "start", *[x.split()[0] for x in NODES.split(", ")]]
    # by range, as hashes of so few keys would put several models into one task
    return dealt.repartitionByRange(len(models), "model").groupBy("model").applyInArrow(one, f"channel string, alpha double, start double, {NODES}")


def blocks(rows: DataFrame, names: tuple[str, ...], ends: list[np.ndarray], targets: tuple[str, ...]) -> DataFrame:
    """Rows (row_id, names, y_<target>) as blocks of bins and targets; a block has rows of one task, in the order of row_id by number of task."""

    ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(x).cast(pa.float64()).to_numpy(zero_copy_only=False) for x in range(1, 1 + len(names))]
            first = batch.column(0)[0].as_py() if batch.num_rows else 0
            y = [pa.array([batch.column(1 + len(names) + k).to_numpy(zero_copy_only=False).astype(np.float64).tobytes()]) for k in range(len(targets))]
            yield pa.RecordBatch.from_arrays([pa.array([first], pa.int64()), pa.array([batch.num_rows], pa.int64()), pa.array([binned(columns, ends).tobytes()]), *y], ["block", "n", "bins", *[f"y_{t}" for t in targets]])

    own = rows.select("row_id", *names, *[f"y_{t}" for t in targets]).sortWithinPartitions("row_id")
    return own.mapInArrow(run, "block long, n long, bins binary, " + ", ".join(f"y_{t} binary" for t in targets))


def pack(nodes: DataFrame) -> dict[tuple[str, float | None], Packed]:
    """The models of a table of nodes; their number and size are the settings', not the data's."""
    found: dict[tuple[str, float | None], tuple[float, list[tuple]]] = {}
    fields = [x.split()[0] for x in NODES.split(", ")]
    table = nodes.select("channel", "alpha", "start", *fields).orderBy("channel", "alpha", "tree", "node").toArrow().to_pydict()
    for channel, alpha, start, *node in zip(*[table[x] for x in ("channel", "alpha", "start", *fields)], strict=True):
        found.setdefault((channel, alpha), (start, []))[1].append(tuple(node))
    return {k: Packed(rows, start) for k, (start, rows) in found.items()}


def score(rows: DataFrame, names: tuple[str, ...], ends: list[np.ndarray], models: dict[tuple[str, float | None], Packed], keep: tuple[str, ...]) -> DataFrame:
    """The columns `keep` of each row and `scores`, the models' values in their order."""
    ship(rows.sparkSession)
    sent = rows.sparkSession.sparkContext.broadcast((ends, list(models.values())))
    one = rows.select(*keep, *names)
    schema = ", ".join(f"`{x}` {one.schema[x].dataType.simpleString()}" for x in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends, own = sent.value
        for batch in batches:
            bins = binned([batch.column(len(keep) + k).cast(pa.float64()).to_numpy(zero_copy_only=False) for k in range(len(names))], ends)
            scores = np.stack([m.score(bins) for m in own], axis=1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, scores.size + 1, scores.shape[1]), pa.int32()), pa.array(scores.ravel()))
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(len(keep))], lists], [*keep, "scores"])

    return one.mapInArrow(run, f"{schema}, scores array<double>")
