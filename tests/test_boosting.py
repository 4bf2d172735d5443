"""Boosting against plain loops: best splits, leaf-wise trees, packed scores."""

import itertools

import numpy as np
import pytest

from shiftframe import boosting
from shiftframe.boosting import Booster, Growth, Packed
from shiftframe.errors import IntegrityError


def sample(n=600, seed=0, width=4, values=9):
    rng = np.random.default_rng(seed)
    bins = rng.integers(0, values, (n, width)).astype(np.uint8)
    y = (3 * (bins[:, 0] > 4) - 2 * (bins[:, 1] % 3 == 1) + bins[:, 2] * (bins[:, 0] < 2) + rng.integers(0, 3, n)).astype(float) * 4
    return bins, y


def plain_split(bins, g, rows, growth, nominal):
    """The best split by trying each feature and place: (gain, feature, bins on the left)."""
    best = None
    total, n, lam = g[rows].sum(), len(rows), growth.reg_lambda
    for f in range(bins.shape[1]):
        own = {b: (g[rows][bins[rows, f] == b].sum(), int((bins[rows, f] == b).sum())) for b in sorted(set(bins[rows, f].tolist()))}
        order = sorted(own, key=lambda b: (own[b][0] / (own[b][1] + lam), b)) if f in nominal else sorted(own)
        for k in range(1, len(order)):
            gl, nl = sum(own[b][0] for b in order[:k]), sum(own[b][1] for b in order[:k])
            if min(nl, n - nl) >= growth.min_rows:
                gain = gl * gl / (nl + lam) + (total - gl) ** 2 / (n - nl + lam) - total * total / (n + lam)
                if gain > 1e-9 * max(1.0, total * total / (n + lam)) and (best is None or gain > best[0] + 1e-9):
                    best = (gain, f, set(order[:k]))
    return best


def plain_tree(bins, g, growth, nominal=()):
    """Rows of each leaf, growing the leaf with the largest gain."""
    leaves = [(np.arange(len(g)), plain_split(bins, g, np.arange(len(g)), growth, nominal))]
    while len(leaves) < growth.leaves:
        open_ = [x for x in leaves if x[1]]
        if not open_:
            break
        at = max(open_, key=lambda x: x[1][0])
        leaves = [x for x in leaves if x is not at]
        left = np.isin(bins[at[0], at[1][1]], list(at[1][2]))
        for part in (at[0][left], at[0][~left]):
            leaves.append((part, plain_split(bins, g, part, growth, nominal)))
    return sorted(tuple(x[0].tolist()) for x in leaves)


def leaves_of(booster, bins):
    """Rows of each leaf of a one-tree model, by walking from the root."""
    found = {}
    for r, row in enumerate(bins):
        at = 0
        while booster.nodes[at][4] >= 0:
            _, _, f, b, child, right, *_ = booster.nodes[at]
            at = child + int(row[f] in right if right is not None else row[f] > b)
        found.setdefault(at, []).append(r)
    return sorted(map(tuple, found.values()))


@pytest.mark.parametrize(("leaves", "nominal", "seed"), [(2, (), 0), (7, (), 1), (12, (1,), 2), (40, (0, 3), 3)])
def test_trees_grow_leaf_by_leaf(leaves, nominal, seed):
    bins, y = sample(seed=seed)
    growth = Growth(leaves, 10, 1.0)
    own = Booster(bins, y, growth, nominal, learning_rate=1.0)
    g = own.gradients()
    own.fit(1)
    assert leaves_of(own, bins) == plain_tree(bins, g, growth, nominal)
    for rows in leaves_of(own, bins):
        rows = list(rows)
        assert own.score[rows] == pytest.approx(own.start - g[rows].sum() / (len(rows) + 1.0))


@pytest.mark.parametrize(("leaves", "nominal"), [(4, ()), (10, (1,))])
def test_dataframes_grow_the_same_tree(spark, leaves, nominal):
    bins, y = sample(400, seed=5)
    growth = Growth(leaves, 7, 1.0)
    g = 4 * (np.round(y.mean()) - y)
    rows = spark.createDataFrame([(b.tolist(), float(x)) for b, x in zip(bins, g, strict=True)], "bins array<int>, g double").repartition(5)
    root = boosting.grow(rows, growth, nominal=nominal)
    names = {}
    for k, row in enumerate(bins):
        at = root
        while at.children:
            s = at.split
            b = row[s["feature"]]
            at = at.children[int(b not in s["left"] if s["left"] is not None else b > s["bin"])]
        names.setdefault(at.name, []).append(k)
    assert sorted(map(tuple, names.values())) == plain_tree(bins, g, growth, nominal)
    values = boosting.values(root, growth)
    assert set(values) == set(names) and all(values[k] == pytest.approx(-g[v].sum() / (len(v) + 1.0)) for k, v in names.items())


def test_squares_of_sums_of_whole_gradients_pass_64_bits(spark):
    bins, _ = sample(400, seed=6)
    g = bins[:, 0].astype(np.int64) * -(10**9) - bins[:, 2].astype(np.int64) * 10**8  # sums of some 10^12
    growth = Growth(3, 20, 1.0)
    rows = spark.createDataFrame([(b.tolist(), int(x)) for b, x in zip(bins, g, strict=True)], "bins array<int>, g long").repartition(3)
    root = boosting.grow(rows, growth, nominal=(3,))
    split = root.split
    gain, feature, left = plain_split(bins, g.astype(float), np.arange(len(g)), growth, (3,))
    assert split["feature"] == feature == 0 and split["bin"] == max(left) and split["gain"] == pytest.approx(gain)
    assert split["g"] == int(g.sum()) and split["gl"] == int(g[bins[:, 0] <= split["bin"]].sum())
    assert sum(x.children is not None for x in (root, *root.children)) == 2


def test_histograms_of_parts_add_up(spark):
    bins, y = sample(200)
    df = spark.createDataFrame([(int(k % 3), b.tolist(), float(x)) for k, (b, x) in enumerate(zip(bins, y, strict=True))], "node int, bins array<int>, g double")
    whole = {(r["feature"], r["bin"]): (r["g"], r["n"]) for r in boosting.histogram(df).collect()}
    parts = {}
    for r in boosting.histogram(df, "node").collect():
        g, n = parts.get((r["feature"], r["bin"]), (0, 0))
        parts[r["feature"], r["bin"]] = (g + r["g"], n + r["n"])
    assert parts == whole and sum(n for (f, _), (_, n) in whole.items() if f == 0) == 200


@pytest.mark.parametrize("alpha", [None, 0.1, 0.9])
def test_packed_scores_equal_trees_one_by_one(alpha):
    bins, y = sample(700, seed=9)
    own = Booster(bins, y, Growth(8, 15, 1.0), (1,), alpha, 0.3, 0.8, 0.75, seed=4).fit(12)
    want = np.full(len(bins), own.start)
    for _, nodes in itertools.groupby(own.nodes, key=lambda x: x[0]):
        nodes = list(nodes)
        assert sum(x[4] < 0 for x in nodes) <= 8
        for r, row in enumerate(bins):
            at = 0
            while nodes[at][4] >= 0:
                _, _, f, b, child, right, *_ = nodes[at]
                at = child + int(row[f] in right if right is not None else row[f] > b)
            want[r] += nodes[at][6]
    assert Packed(own.nodes, own.start).score(bins) == pytest.approx(want) and own.score == pytest.approx(want)


def test_quantile_models_cover_their_share():
    rng = np.random.default_rng(1)
    bins = rng.integers(0, 30, (4000, 2)).astype(np.uint8)
    y = bins[:, 0] + rng.normal(size=4000) * (1 + bins[:, 1] / 10)
    for alpha in (0.1, 0.5, 0.9):
        own = Booster(bins, y, Growth(15, 40, 1.0), (), alpha, 0.1).fit(40)
        assert abs((y <= own.score).mean() - alpha) < 0.03
    point = Booster(bins, y, Growth(15, 40, 1.0), (), None, 0.1).fit(40)
    assert ((y - point.score) ** 2).mean() < 0.2 * y.var()


def test_small_and_constant_samples():
    bins = np.zeros((5, 2), np.uint8)
    assert np.all(Booster(bins, np.full(5, 2.0), Growth(4, 1, 1.0)).fit(3).score == 2.0)
    one = Booster(bins[:1], np.array([7.0]), Growth(4, 1, 1.0), alpha=0.5).fit(2)
    assert one.score.tolist() == [7.0] and Packed([], 3.0).score(bins).tolist() == [3.0] * 5
    with pytest.raises(IntegrityError):
        Growth(1)


def test_bins(spark):
    df = spark.createDataFrame([(float(k % 7), float(k) if k % 5 else None, float("nan") if k % 2 else 1.0) for k in range(1000)], "a double, b double, c double")
    ends = boosting.edges(df, ("a", "b", "c"), 20)
    assert ends[0].tolist() == [0, 1, 2, 3, 4, 5, 6] and len(ends[1]) == 20 and ends[2].tolist() == [1.0]
    rows = df.select("a", "b", "c", boosting.bins_of(("a", "b", "c"), ends).alias("bins")).collect()
    columns = [np.array([np.nan if r[x] is None else r[x] for r in rows]) for x in "abc"]
    assert boosting.binned(columns, ends).tolist() == [list(r["bins"]) for r in rows]
    counts = np.bincount(boosting.binned(columns, ends)[:, 1])
    assert counts[0] == 200 and counts[2:].max() < 2 * counts[2:].min()  # the first has the least value alone
