"""SimHash near-dedup through vantage-point trees.

A document's fingerprint: A-Z lower-cased, words cut at ASCII white space, shingles of `words` words joined by one
space (a shorter text: all its words), each hashed by XXH64 with seed 42; a bit is set if it is set in over half the
hashes, repeats included. A text without words has fingerprint zero, which links like any other. Null texts count as
texts without words.

Fingerprints within `radius` bits are linked. Equal fingerprints are one point. A vantage-point tree over a sample that
grows with the points (one in SAMPLE_SHARE) routes every point to its home shard, and as a query to each later shard that
its ball may reach by the triangle inequality: every child knows the least and the greatest distance of its own points to
the vantage point. The tree is as deep as it takes for a shard to get VISITS points and queries on average, which the
sample measures. In a shard a second tree prunes in the same way down to blocks that are compared exactly. Points within
`radius` of a vantage point are one component at once, and are not compared with each other, so a dense ball costs no
square of its size (nor can it grow with the data: at most 679,121 fingerprints lie within 4 bits of another). Shards
return links to their local representatives, and a distributed component search joins them.

Nothing is dropped or capped: sample and tree only decide where a pair is compared. Rows are documents each; rows that
share an id have the same id in results, but are linked by their texts alone. A null id comes last. Empty tables give
empty results; columns other than the two named are not read.

`similar_groups` is for corpora without a contract of four words and four bits: documents are near copies if their
similarity is at least `similarity`, by the measure that SimHash estimates: the cosine of their sets of shingles (64-bit
hashes), shared / sqrt(size * size). It is never less than the Jaccard similarity, so all pairs of 0.8 by that are among
them. At a cosine of 0.8 fingerprints differ in some thirteen bits of 64; a ball of that radius meets nearly every shell
of a tree over the whole corpus, so the search would cost the square of the documents. Therefore documents meet in
cells: a cell is a shingle that is among the SKETCH smallest hashes of each of them. Two sets of cosine 0.8 share none of
theirs with a probability of about (1 / 3) ** SKETCH. In a cell a vantage-point tree finds the fingerprints (here of the
set, without repeats) within `radius`; in a cell of more than CELL documents each is compared with SALTS leaders instead,
so no group costs its square. Pairs whose ESTIMATE smallest hashes say that they are less alike than the limit by more
than SLACK are left out here, so that texts that merely share a passage do not come together in ever larger groups.

What cells, leaders, radius and estimates miss, a prefix filter brings together, which misses nothing. All sets order their
shingles alike, the rarest first (by the number of rows that hold them). Two sets share no shingle before the first that
they share, so they share no more than what either has from there on, and similarity * sqrt(size * size) at least:
from any shingle that may be the first shared one, a set knows how large the other may be. Shingles of one row alone
come first in the order and meet nothing. Places (components of candidates) that hold such a pair become one place; a
place's sets of one size are one entry of a shingle, so a large group of near copies costs no square here either.

Then every link is checked exactly: the documents of each place are compared all with all if they are at most BLOCK; else
with the place's leaders, and those that these links leave outside its largest group with all. Equal sets are one point.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as c
from .components import components

#: One in so many fingerprints makes the routing tree (of fewer than LEAST_SAMPLE times this number, LEAST_SAMPLE do).
SAMPLE_SHARE, LEAST_SAMPLE = 2048, 8192
#: Distinct fingerprints that a shard should hold at most, and those that may visit it, on average.
SHARD, VISITS = 16384, 1 << 20
LEAST_SHARDS = 64
#: Points of a block that is compared without a further split.
LEAF = 192
#: Documents of a block when the documents of a component are compared exactly.
BLOCK = 512
#: Smallest shingle hashes of a document that are its cells; documents of a cell that are searched all; leaders of larger ones.
SKETCH, CELL, SALTS = 8, 2000, 16
#: Smallest shingle hashes that estimate a pair's similarity, and how far below the limit an estimate may be (about three deviations).
ESTIMATE, SLACK = 64, 0.15
#: Bytes of text whose shingles are sent to be counted at once, and shingles (about) of a range that is counted by one task.
CHUNK_TEXT, RANGE = 16 << 20, 1 << 20


def _hashes(text: str | None, words: int) -> bytes:
    """The hashes of all shingles, repeats included, 8 bytes each."""
    own = text.encode().lower().split() if text else []
    n = len(own)
    if not n:
        return b""
    flat = b" ".join(own)
    if n <= words:
        return xxhash.xxh64_digest(flat, 42)
    ends = np.cumsum(np.fromiter(map(len, own), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_digest
    return b"".join([digest(flat[a:b], 42) for a, b in zip(starts[: n - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)])


def _majority(hashes: bytes) -> bytes:
    if len(hashes) <= 8:
        return hashes or bytes(8)  # one hash: its own majority
    count = np.zeros(64, np.int64)
    raw = np.frombuffer(hashes, np.uint8)
    for k in range(0, len(raw), 8 << 16):
        count += np.unpackbits(raw[k : k + (8 << 16)]).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * count > len(hashes) // 8).tobytes()


def fingerprint(text: str | None, words: int = 4) -> bytes:
    """8 bytes, the highest bit first."""
    return _majority(_hashes(text, words))


def fingerprints(docs: DataFrame, *, words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp long): the fingerprint's 64 bits as a signed integer."""
    c.tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = b"".join([fingerprint(t.as_py(), words) for t in b.column(1)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.frombuffer(fps, ">i8").astype(np.int64))], ["id", "fp"])

    one = c.spread(docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")))
    return one.mapInArrow(run, f"id {one.schema['id'].dataType.simpleString()}, fp long")


def _distance(points: np.ndarray, vantage: np.uint64) -> np.ndarray:
    return np.bitwise_count(points ^ vantage).astype(np.int16)


def _vantage(points: np.ndarray, rng: np.random.Generator) -> tuple[np.uint64, int]:
    """Of a few points, that which spreads the others most, and the median distance to it."""
    best = None
    for v in points[rng.integers(0, len(points), 5)]:
        d = _distance(points, v)
        m = int(np.partition(d, (len(d) - 1) // 2)[(len(d) - 1) // 2])
        uneven = abs(2 * int((d <= m).sum()) - len(d)), -float(d.std())
        if best is None or uneven < best[0]:
            best = uneven, v, m
    return best[1], best[2]


def routing_tree(sample: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """A full tree as a heap: vantage points, and the distances up to which a point belongs to the left child."""
    vantage, limit = np.zeros((1 << depth) - 1, np.uint64), np.full((1 << depth) - 1, 32, np.int16)
    rng = np.random.default_rng(42)
    held = {0: sample}
    for node in range(len(vantage)):
        own = held.pop(node)
        if not len(own):  # nothing to learn from: any vantage point is right
            own = np.array([node * 0x9E3779B97F4A7C15 % 2**64], np.uint64)
        vantage[node], limit[node] = _vantage(own, rng)
        left = _distance(own, vantage[node]) <= limit[node]
        if 2 * node + 2 < len(vantage):
            held[2 * node + 1], held[2 * node + 2] = own[left], own[~left]
    return vantage, limit


def shells(points: np.ndarray, vantage: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(child, least distance, greatest distance) to its parent's vantage point, of the points below each child met."""
    depth = int(len(vantage) + 1).bit_length() - 1
    node, found = np.zeros(len(points), np.int64), []
    for _ in range(depth):
        d = np.bitwise_count(points ^ vantage[node]).astype(np.int64)
        node = np.where(d <= limit[node], 2 * node + 1, 2 * node + 2)
        child, at = np.unique(node, return_inverse=True)
        low, high = np.full(len(child), 64), np.zeros(len(child), np.int64)
        np.minimum.at(low, at, d)
        np.maximum.at(high, at, d)
        found.append((child, low, high))
    return tuple(map(np.concatenate, zip(*found, strict=True)))


def route(points: np.ndarray, vantage: np.ndarray, limit: np.ndarray, low: np.ndarray, high: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place in points, shard, whether it is home there) of each visit to the home shard or a later one."""
    depth = int(len(vantage) + 1).bit_length() - 1
    at, node, home = np.arange(len(points)), np.zeros(len(points), np.int64), np.ones(len(points), bool)
    for _ in range(depth):
        d = np.bitwise_count(points[at] ^ vantage[node]).astype(np.int16)
        one, two = 2 * node + 1, 2 * node + 2
        left, right = ((d + radius >= low[x]) & (d - radius <= high[x]) for x in (one, two))
        belongs = d <= limit[node]
        # a visit that is home goes on as home on its own side, and as a query only to the right of it
        go_left = np.where(home, belongs, left)
        go_right = right | (home & ~belongs)
        at, node, home = (
            np.concatenate((at[go_left], at[go_right])),
            np.concatenate((one[go_left], two[go_right])),
            np.concatenate((home[go_left] & belongs[go_left], home[go_right] & ~belongs[go_right])),
        )
    return at, node - len(vantage), home


class _Links:
    """Union-find over places; unites pairs by whole arrays and skips those that are united already."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def unite(self, a: np.ndarray, b: np.ndarray) -> None:
        a, b = self.root[a], self.root[b]
        open_ = a != b
        if not open_.any():
            return
        a, b = a[open_], b[open_]
        pairs = np.unique(np.stack((np.minimum(a, b), np.maximum(a, b)), axis=1), axis=0)
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            top = x
            while (p := parent.get(top, top)) != top:
                top = p
            while (p := parent.get(x, x)) != top:
                parent[x], x = top, p
            return top

        for x, y in pairs.tolist():
            x, y = find(x), find(y)
            if x != y:
                parent[max(x, y)] = min(x, y)
        moved = np.array(sorted(parent), np.int64)
        to = np.arange(len(self.root))
        to[moved] = [find(x) for x in moved.tolist()]
        self.root = to[self.root]


def link(points: np.ndarray, homes: np.ndarray, queries: np.ndarray, radius: int, agree: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> np.ndarray:
    """Root place of each point, after linking every home with every query within the radius.

    homes and queries are places in points; homes should be among the queries. `agree` tells which pairs of places may be
    linked at all; with it points in one ball are no component at once.
    """
    links = _Links(len(points))
    rng = np.random.default_rng(7)
    stack = [(homes, queries)]
    while stack:
        p, q = stack.pop()
        if not len(p) or not len(q):
            continue
        if min(len(p), len(q)) <= LEAF:
            if len(p) > len(q):
                p, q = q, p
            step = max(1, (1 << 18) // len(p))
            for k in range(0, len(q), step):
                part = q[k : k + step]
                near = np.bitwise_count(points[part][:, None] ^ points[p][None, :]) <= radius
                i, j = np.nonzero(near)
                i, j = part[i], p[j]
                if agree is not None:
                    open_ = links.root[i] != links.root[j]
                    i, j = i[open_], j[open_]
                    fits = agree(i, j)
                    i, j = i[fits], j[fits]
                links.unite(i, j)
            continue
        v, m = _vantage(points[p], rng)
        dp, dq = _distance(points[p], v), _distance(points[q], v)
        ball = dp <= radius
        if agree is None and ball.sum() * 4 >= len(p):  # dense: what is near the vantage point is one component
            near = dq <= radius
            first = p[ball][0]
            links.unite(p[ball], np.full(int(ball.sum()), first))
            links.unite(q[near], np.full(int(near.sum()), first))
            stack += [(p[~ball & (dp <= 2 * radius)], q[near]), (p[~ball], q[~near])]
            dense, rim = p[ball], q[~near & (dq <= 2 * radius)]
            if near.sum() * 8 >= len(q):
                stack.append((dense, rim))
            else:  # too few were settled: halve, so that every step makes the problem smaller
                stack += [(dense[: len(dense) // 2], rim), (dense[len(dense) // 2 :], rim)]
        elif (inner := dp <= m).all():
            stack += [(p[: len(p) // 2], q), (p[len(p) // 2 :], q)]
        else:
            stack += [(p[inner], q[dq - radius <= m]), (p[~inner], q[dq + radius > m])]
    return links.root


def near_links(fps: DataFrame, *, radius: int = 4) -> DataFrame:
    """(fp, root): links between distinct fingerprints, as a star for each component of each shard."""
    n = fps.count()
    share = max(1, n // max(LEAST_SAMPLE, n // SAMPLE_SHARE))
    rows = fps.where(F.pmod(F.xxhash64("fp"), F.lit(share)) == 0).select("fp").collect()
    sample = np.sort(np.array([r[0] for r in rows], np.int64)).view(np.uint64)
    depth = max(int(math.log2(LEAST_SHARDS)), math.ceil(math.log2(max(1, n / SHARD))))
    while True:  # shards get smaller and visits more with the depth
        vantage, limit = routing_tree(sample, depth)
        low, high = np.full(2 * len(vantage) + 1, 65, np.int16), np.full(2 * len(vantage) + 1, -65, np.int16)
        if len(sample):
            child, least, most = shells(sample, vantage, limit)
            low[child], high[child] = least, most
            some = sample[:: max(1, len(sample) // 2048)]
            visits_each = len(route(some, vantage, limit, low, high, radius)[0]) / len(some)
        if not len(sample) or n * visits_each / (1 << depth) <= VISITS or len(sample) < 4 << depth:
            break
        depth += 1

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            child, least, most = shells(b.column(0).to_numpy(zero_copy_only=False).view(np.uint64), vantage, limit)
            yield pa.RecordBatch.from_arrays([pa.array(child), pa.array(least), pa.array(most)], ["child", "low", "high"])

    found = fps.select("fp").mapInArrow(bounds, "child long, low long, high long").groupBy("child").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    for r in found.collect():  # two rows a shard at most
        low[r["child"]], high[r["child"]] = r["low"], r["high"]

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for k in range(0, len(own), 4096):
                part = own[k : k + 4096]
                at, shard, home = route(part, vantage, limit, low, high, radius)
                yield pa.RecordBatch.from_arrays([pa.array(shard.astype(np.int32)), pa.array(part[at].view(np.int64)), pa.array(home)], ["shard", "fp", "home"])

    def linked(pdf: pd.DataFrame) -> pd.DataFrame:
        points, home = pdf["fp"].to_numpy(np.int64), pdf["home"].to_numpy(bool)
        root = link(points.view(np.uint64), np.flatnonzero(home), np.arange(len(points)), radius)
        moved = root != np.arange(len(points))
        return pd.DataFrame({"fp": points[moved], "root": points[root[moved]]})

    out = fps.select("fp").mapInArrow(visits, "shard int, fp long, home boolean").repartition(1 << min(depth, 14), "shard")
    return out.groupBy("shard").applyInPandas(linked, "fp long, root long")


def near_dedup(docs: DataFrame, *, words: int = 4, radius: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint, component_id) of each row; component_id is the least id that links reach."""
    each, _ = c.saved(fingerprints(docs, words=words, id_col=id_col, text_col=text_col), "simhash")
    fps, fps_path = c.saved(each.groupBy("fp").agg(F.min("id").alias("least")), "simhash-points")
    edges, edges_path = c.saved(near_links(fps, radius=radius), "simhash-links")
    nodes = components(edges, "fp", "root")
    members, members_path = c.saved(nodes.join(fps, nodes["node"] == fps["fp"]).select("fp", "component", "least"), "simhash-members")
    best = members.groupBy("component").agg(F.min("least").alias("reached"))
    best, best_path = c.saved(best, "simhash-best")
    reached = members.join(best, "component").select("fp", "reached")
    found, _ = c.saved(fps.join(reached, "fp", "left").select("fp", F.coalesce("reached", "least").alias("component_id")), "simhash-found")
    c.remove(each.sparkSession, fps_path, edges_path, members_path, best_path)
    out = each.join(found, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
    return out


def _set(hashes: bytes) -> np.ndarray:
    """The distinct hashes in order."""
    return np.unique(np.frombuffer(hashes, ">u8")).astype("<u8")


def _digest(own: np.ndarray) -> str:
    return xxhash.xxh3_128_hexdigest(own.tobytes())


class Sets:
    """Sets of hashes whose cosines are compared exactly; those that are linked already are not compared again."""

    def __init__(self, sets: list[np.ndarray], similarity: float):
        self.similarity, n = similarity, len(sets)
        self.size = np.array([len(x) for x in sets], np.int64)
        self.flat = np.unique(np.concatenate(sets), return_inverse=True)[1] if n else np.zeros(0, np.int64)
        self.starts = np.cumsum(self.size) - self.size
        self.seen = np.zeros(int(self.flat.max()) + 1 if len(self.flat) else 1, bool)
        self.links = _Links(n)

    def near(self, i: int, others: np.ndarray) -> np.ndarray:
        """Those of the others that are like set i."""
        size, limit = self.size, self.similarity
        a, b = np.minimum(size[others], size[i]), np.maximum(size[others], size[i])
        others = others[(a > 0) & (a >= limit * limit * b - 1e-9)]
        if not len(others):
            return others
        own = self.flat[self.starts[i] : self.starts[i] + size[i]]
        self.seen[own] = True
        hit = self.seen[self.flat[c.ranges(self.starts[others], size[others])]]
        self.seen[own] = False
        both = np.add.reduceat(hit.astype(np.int64), np.cumsum(size[others]) - size[others])
        return others[both >= limit * np.sqrt(size[others] * size[i]) - 1e-9]

    def link(self, i: int, others: np.ndarray) -> None:
        """Unite set i with what is like it among the others: first of each group one, then what is not linked yet."""
        root = self.links.root
        for some in (np.unique(root[others]), others):
            some = self.near(i, some[self.links.root[some] != self.links.root[i]])
            self.links.unite(np.full(len(some), i), some)


def same_sets(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """Root place of each set of hashes, after linking all pairs of at least the similarity, by cosine."""
    own = Sets(sets, similarity)
    for i in range(1, len(sets)):
        own.link(i, np.arange(i))
    return own.links.root


def alike(sketches: np.ndarray, a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    """Whether the sets of each pair of rows look as similar as `least` by cosine, from the smallest hashes of both.

    Of the smallest hashes of two sets' union, the share that is in both estimates their Jaccard similarity, and sets of
    equal size have twice that over one and that as cosine; the union is known up to the end of the shorter sketch.
    """
    out = np.zeros(len(a), bool)
    none = np.uint64(2**64 - 1)
    for k in range(0, len(a), 1024):
        x, y = sketches[a[k : k + 1024]], sketches[b[k : k + 1024]]
        both = np.sort(np.concatenate((x, y), axis=1), axis=1)
        known = both < none
        twice = np.zeros(both.shape, bool)
        twice[:, 1:] = (both[:, 1:] == both[:, :-1]) & known[:, 1:]
        distinct = np.cumsum(known & ~twice, axis=1)
        inside = distinct <= ESTIMATE
        shared, union = (twice & inside).sum(axis=1), np.minimum(distinct[:, -1], ESTIMATE)
        jaccard = shared / np.maximum(union, 1)
        out[k : k + 1024] = 2 * jaccard / (1 + jaccard) >= least
    return out


def cell_links(cells: np.ndarray, points: np.ndarray, sketches: np.ndarray, radius: int, least: float) -> np.ndarray:
    """Root place of each point, after linking all points in each cell that are within the radius and look alike; equal
    cells are neighbours."""
    n, links = len(points), _Links(len(points))
    begin = np.flatnonzero(np.concatenate(([True], cells[1:] != cells[:-1]))) if n else np.zeros(0, np.int64)
    sizes = np.diff(np.append(begin, n))
    small = np.repeat(sizes <= 32, sizes)
    for k in range(1, min(32, n)):
        i = np.flatnonzero((cells[k:] == cells[:-k]) & small[:-k])
        if not len(i):
            break
        i = i[(np.bitwise_count(points[i] ^ points[i + k]) <= radius) & (links.root[i] != links.root[i + k])]
        i = i[alike(sketches, i, i + k, least)]
        links.unite(i, i + k)
    for a, size in zip(begin[sizes > 32].tolist(), sizes[sizes > 32].tolist(), strict=True):
        every = np.arange(size)
        links.unite(a + every, a + link(points[a : a + size], every, every, radius, lambda i, j, a=a: alike(sketches, a + i, a + j, least)))
    return links.root


def _sketches(column: pa.Array) -> np.ndarray:
    """Rows of ESTIMATE hashes from a column of binaries; shorter ones end in the greatest number."""
    raw = b"".join([x.as_buffer().to_pybytes().ljust(8 * ESTIMATE, b"\xff") for x in column])
    return np.frombuffer(raw, "<u8").reshape(-1, ESTIMATE)


def _candidates(points: DataFrame, radius: int, least: float) -> DataFrame:
    """(a, b): digests of points that share a cell, are within the radius and look alike, as stars."""
    entries = points.select("digest", "fp", F.explode("cells").alias("h"))
    cells, _ = c.saved(entries.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"), "similar-cells")
    narrow, _ = c.saved(entries.join(cells, "h"), "similar-met")  # most cells have one document; the others' get their sketches
    sketches = points.select("digest", "sketch")
    first = F.min(F.struct(F.xxhash64("digest").alias("k"), "digest", "fp")).alias("x")
    leaders = narrow.where(F.col("n") > CELL).groupBy("h", F.pmod(F.xxhash64("digest"), F.lit(SALTS)).alias("salt")).agg(first).select("h", "x.digest", "x.fp")
    leaders = leaders.join(sketches, "digest").groupBy("h").agg(F.collect_list(F.struct("digest", "fp", "sketch")).alias("leaders"))  # SALTS at most
    met = narrow.join(sketches, "digest")

    def stars(digest: pa.Array, root: np.ndarray) -> pa.RecordBatch:
        moved = np.flatnonzero(root != np.arange(len(root)))
        return pa.RecordBatch.from_arrays([digest.take(pa.array(moved)), digest.take(pa.array(root[moved]))], ["a", "b"])

    def led(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each point with the first leader that it looks like, and that leader with the others; few leaders make few such pairs."""
        for b in batches:
            sizes = pc.list_value_length(b.column(2)).to_numpy(zero_copy_only=False)
            flat = b.column(2).flatten()
            row, digest, other = np.repeat(np.arange(len(sizes)), sizes), b.column(0).to_pylist(), flat.field("digest").to_pylist()
            rows = np.concatenate((_sketches(b.column(1)), _sketches(flat.field("sketch"))))
            fits = alike(rows, row, len(sizes) + np.arange(len(row)), least)
            to: dict[str, list[str]] = {}
            for k in np.flatnonzero(fits).tolist():
                if digest[row[k]] != other[k]:
                    to.setdefault(digest[row[k]], []).append(other[k])
            pairs = sorted({(x, first) for own, all_ in to.items() for first in (min(all_),) for x in (own, *all_) if x != first})
            if pairs:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*pairs, strict=True)], ["a", "b"])

    near = F.filter("leaders", lambda x: F.bit_count(x["fp"].bitwiseXOR(F.col("fp"))) <= radius)
    large = met.where(F.col("n") > CELL).join(leaders, "h").select("digest", "sketch", near.alias("leaders")).where(F.size("leaders") > 0)
    large = large.mapInArrow(led, "a string, b string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            held = b if held is None else pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0] if b.num_rows else held
            cell = held.column(0).to_numpy(zero_copy_only=False)
            whole = int(np.searchsorted(cell, cell[-1])) if len(cell) else 0  # the last cell may go on in the next batch
            if whole:
                yield found(held.slice(0, whole))
            held = held.slice(whole)
        if held is not None and held.num_rows:
            yield found(held)

    def found(b: pa.RecordBatch) -> pa.RecordBatch:
        cell, fp = (b.column(k).to_numpy(zero_copy_only=False) for k in (0, 2))
        return stars(b.column(1), cell_links(cell, fp.view(np.uint64), _sketches(b.column(3)), radius, least))

    few = met.where(F.col("n") <= CELL).select("h", "digest", "fp", "sketch").repartition("h").sortWithinPartitions("h")
    return large.unionByName(few.mapInArrow(run, "a string, b string"))


def _prefixes(rows: DataFrame, words: int, similarity: float, shingles: int) -> DataFrame:
    """(digest, n, h, most): a set's size, those shingles (48 bits of the hash) that may be the first it shares with a set
    of the similarity, and the greatest size that set may have. Sets without such shingles are left out.

    The shingles of a chunk of texts travel as arrays, each 48 bits of hash and 16 of the text's place in the chunk, to the
    task that counts their range of hashes, and those of several rows back. Hashes that meet in 48 bits are one shingle of
    the order: the bounds hold for that, too.
    """
    ranges = min(1 << 24, max(64, shingles // RANGE))
    starts = np.array([-(-(r << 24) // ranges) << 40 for r in range(ranges)], np.uint64)
    inner, floor = np.uint64(0xFFFF), similarity * similarity

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[str, np.ndarray] = {}
        number, held = TaskContext.get().partitionId() << 32, 0

        def sent() -> pa.RecordBatch:
            sizes = np.array([len(x) for x in sets.values()], np.int64)
            packed = np.sort(np.concatenate(list(sets.values())) & ~inner | np.repeat(np.arange(len(sets), dtype=np.uint64), sizes))
            cuts = np.append(np.searchsorted(packed, starts), len(packed))
            some = np.flatnonzero(cuts[1:] > cuts[:-1])
            blobs = [packed[cuts[r] : cuts[r + 1]].tobytes() for r in some.tolist()]
            rest = [None] * len(some)  # the last row holds what the chunk's own task needs
            columns = [pa.array([*some.tolist(), xxhash.xxh64_intdigest(number.to_bytes(8, "little")) % ranges], pa.int32()), pa.array([number] * (len(some) + 1), pa.int64()), pa.array([*blobs, b""], pa.binary())]
            return pa.RecordBatch.from_arrays([*columns, pa.array([*rest, list(sets)], pa.list_(pa.string())), pa.array([*rest, sizes.tobytes()], pa.binary())], ["range", "chunk", "packed", "digests", "sizes"])

        for b in batches:
            for text in b.column(0):
                own = _set(_hashes(text.as_py(), words))
                if not len(own):
                    continue
                sets[_digest(own)] = own
                held += text.as_buffer().size
                if held >= CHUNK_TEXT or len(sets) > 65000:
                    yield sent()
                    sets.clear()
                    number, held = number + 1, 0
        if sets:
            yield sent()

    def counted(table: pa.Table) -> pa.Table:
        """Of a range: the shingles of several rows, and in how many they are."""
        blobs = [np.frombuffer(x.as_buffer(), "<u8") for x in table.column("packed")]
        ends = np.cumsum([len(x) for x in blobs])
        flat = np.concatenate(blobs)
        token = flat >> np.uint64(16)
        order = np.argsort(token, kind="stable")
        token = token[order]
        opens = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1]))) if len(token) else np.zeros(0, np.int64)
        count = np.diff(np.append(opens, len(token)))
        df = np.empty(len(token), "<u4")
        df[order] = np.repeat(count, count)
        several = df > 1
        upto = np.concatenate(([0], np.cumsum(several)))[np.concatenate(([0], ends))]
        flat, df = flat[several], df[several]
        cut = lambda x: pa.array([x[a:z].tobytes() for a, z in zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True)], pa.binary())
        out = pa.table([table.column("chunk"), cut(flat), cut(df), table.column("digests"), table.column("sizes")], ["chunk", "packed", "df", "digests", "sizes"])
        return out.filter(pa.array((upto[1:] > upto[:-1]) | np.array(table.column("digests").is_valid())))

    def prefix(table: pa.Table) -> pa.Table:
        """Of a chunk: each set's prefix."""
        flat, df = (np.concatenate([np.frombuffer(x.as_buffer(), t) for x in table.column(name)]) for name, t in (("packed", "<u8"), ("df", "<u4")))
        last = int(np.flatnonzero(np.array(table.column("digests").is_valid()))[0])
        digests, sizes = table.column("digests")[last].values, np.frombuffer(table.column("sizes")[last].as_buffer(), np.int64)
        doc, token = (flat & inner).astype(np.int64), flat >> np.uint64(16)
        order = np.lexsort((token, df, doc))
        doc, token = doc[order], token[order]
        rest = np.cumsum(np.bincount(doc, minlength=len(sizes)))[doc] - np.arange(len(doc))  # this shingle and those after it
        keep = rest >= floor * sizes[doc] * (1 - 1e-9)
        doc, token, rest = doc[keep], token[keep], rest[keep]
        most = rest.astype(float) ** 2 / (floor * sizes[doc]) * (1 + 1e-9)
        of, count = np.unique(doc, return_counts=True)
        offsets = pa.array(np.concatenate(([0], np.cumsum(count))), pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (token.astype(np.int64), most)]
        return pa.table([digests.take(pa.array(of)), pa.array(sizes[of]), *lists], ["digest", "n", "h", "most"])

    sent = rows.select("text").mapInArrow(chunks, "range int, chunk long, packed binary, digests array<string>, sizes binary")
    several = sent.groupBy("range").applyInArrow(counted, "chunk long, packed binary, df binary, digests array<string>, sizes binary")
    return several.groupBy("chunk").applyInArrow(prefix, "digest string, n long, h array<long>, most array<double>")


def _met_by_prefix(prefixes: DataFrame, places: DataFrame) -> DataFrame:
    """(a, b): different places that hold sets that may be as similar as the prefixes were made for. places: (digest, place)."""
    each = prefixes.join(places, "digest").select("place", "n", F.explode(F.arrays_zip("h", "most")).alias("x"))
    each, each_path = c.saved(each.groupBy(F.col("x.h").alias("h"), "place", "n").agg(F.max("x.most").alias("most")), "similar-prefixes")
    cells = each.groupBy("h").agg(F.min("place").alias("least"), F.max("place").alias("greatest"), F.count("*").alias("lot"), F.max(F.col("most") >= F.col("n")).alias("able"))
    salts = F.when(F.col("lot") > CELL, SALTS).otherwise(1).alias("salts")
    met, met_path = c.saved(each.join(cells.where("able AND least <> greatest").select("h", salts), "h"), "similar-prefixes-met")
    small = met.where("most >= n").select("h", F.col("place").alias("a"), F.col("n").alias("an"), F.col("most").alias("a_most"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    other = met.select("h", F.col("place").alias("b"), F.col("n").alias("bn"), F.col("most").alias("b_most"), F.pmod(F.xxhash64("place", "n"), F.col("salts")).cast("int").alias("salt"))
    pairs = small.join(other, ["h", "salt"]).where("a <> b AND bn >= an AND bn <= a_most AND an <= b_most")
    out, _ = c.saved(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "similar-places")
    c.remove(prefixes.sparkSession, each_path, met_path)
    return out


def _checked(rows: DataFrame, wanted: DataFrame, words: int, similarity: float) -> DataFrame:
    """(a, b): links of digests in the same place that pass the exact check. wanted: (digest, id, th, place, n)."""
    salt = F.pmod(F.xxhash64("digest"), F.lit(SALTS))
    blocks = F.ceil(F.col("n") / BLOCK).cast("long")
    large = wanted.where(F.col("n") > BLOCK)
    leaders = large.groupBy("place", salt.alias("salt")).agg(F.min("digest").alias("digest")).select("place", "digest", F.lit(True).alias("leads"))
    wanted = wanted.join(leaders, ["place", "digest"], "left").withColumn("leads", F.coalesce("leads", F.lit(False)))

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [_set(_hashes(t, words)) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array([x.tobytes() for x in sets], pa.binary())], ["digest", "place", "n", "leads", "hashes"])

    held = rows.join(wanted, rows["id"].eqNullSafe(wanted["id"]) & (rows["th"] == wanted["th"])).select("text", "digest", "place", "n", "leads")
    held, _ = c.saved(held.mapInArrow(chosen, "digest string, place long, n long, leads boolean, hashes binary"), "similar-sets")
    own = F.pmod(F.xxhash64("digest"), blocks)
    every = F.sequence(F.lit(0).cast("long"), blocks - 1)

    def first(pdf: pd.DataFrame) -> pd.DataFrame:
        """A small place all with all; of a larger one, the members of a block with the leaders."""
        pdf = pdf.drop_duplicates("digest").sort_values("leads", ascending=False, kind="stable")
        sets, digests, n_leaders = [np.frombuffer(x, "<u8") for x in pdf["hashes"]], pdf["digest"].to_numpy(object), int(pdf["leads"].sum())
        if not n_leaders:
            root = same_sets(sets, similarity)
        else:
            of = Sets(sets, similarity)
            for i in range(n_leaders):
                of.link(i, np.arange(i + 1, len(sets)))
            root = of.links.root
        moved = root != np.arange(len(root))
        return pd.DataFrame({"place": pdf["place"].to_numpy()[moved], "a": digests[moved], "b": digests[root[moved]]})

    to = F.when(F.col("leads"), every).otherwise(F.array(own))
    found, _ = c.saved(held.withColumn("block", F.explode(to)).groupBy("place", "block").applyInPandas(first, "place long, a string, b string"), "similar-first")
    links = found.select("a", "b")
    if large.isEmpty():
        return links
    # what is not in the largest group of its place is compared with all of the place
    groups = components(found.join(large.select("place").distinct(), "place"), "a", "b")
    parts = large.select("place", "digest").join(groups, groups["node"] == large["digest"], "left").select("place", "digest", F.coalesce("component", "digest").alias("part"))
    main = parts.groupBy("place", "part").agg(F.count("*").alias("n")).groupBy("place").agg(F.max(F.struct("n", "part")).alias("main"))
    lone, _ = c.saved(parts.join(main, "place").where("part <> main.part").select("place", "digest"), "similar-lone")
    if lone.isEmpty():
        return links
    many = lone.groupBy("place").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("lots"))
    again = held.join(many, "place").join(lone.withColumn("lone", F.lit(True)), ["place", "digest"], "left").withColumn("lone", F.coalesce("lone", F.lit(False)))
    lot = F.pmod(F.xxhash64("digest", F.lit(1)), F.col("lots"))
    as_lone = again.where("lone").select("place", "digest", "hashes", "lone", F.explode(every).alias("block"), lot.alias("lot"))
    as_member = again.select("place", "digest", "hashes", F.lit(False).alias("lone"), own.alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("lots") - 1)).alias("lot"))

    def second(pdf: pd.DataFrame) -> pd.DataFrame:
        """Those outside the place's largest group, with all members of a block."""
        pdf = pdf.sort_values("lone", ascending=False, kind="stable").drop_duplicates("digest")
        of = Sets([np.frombuffer(x, "<u8") for x in pdf["hashes"]], similarity)
        for i in range(int(pdf["lone"].sum())):
            of.link(i, np.arange(i + 1, len(pdf)))
        moved, digests = of.links.root != np.arange(len(pdf)), pdf["digest"].to_numpy(object)
        return pd.DataFrame({"a": digests[moved], "b": digests[of.links.root[moved]]})

    return links.unionByName(as_lone.unionByName(as_member).groupBy("place", "block", "lot").applyInPandas(second, "a string, b string"))


def similar_groups(docs: DataFrame, *, words: int = 5, radius: int = 20, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, th, component_id, first) of each row: th is a hash of the text, component_id the least id that links of exactly
    checked pairs reach, and first tells whether the row's id and text are the component's first."""
    spark = docs.sparkSession
    c.tune(spark)
    one = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).withColumn("th", F.xxhash64("text"))
    kind = one.schema["id"].dataType.simpleString()

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hashes = [_hashes(t.as_py(), words) for t in b.column(1)]
            sets = [_set(x) for x in hashes]
            fps = np.frombuffer(b"".join([_majority(x.astype(">u8").tobytes()) for x in sets]), ">i8").astype(np.int64)
            cells = pa.array([x[:SKETCH].view(np.int64) for x in sets], pa.list_(pa.int64()))
            sketch = pa.array([x[:ESTIMATE].tobytes() for x in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(fps), pa.array(map(_digest, sets), pa.string()), cells, sketch, pa.array([len(x) for x in sets], pa.int64())], ["id", "th", "fp", "digest", "cells", "sketch", "size"])

    each, each_path = c.saved(c.spread(one).mapInArrow(prints, f"id {kind}, th long, fp long, digest string, cells array<long>, sketch binary, size long"), "similar")
    lead = F.struct(F.col("id").isNull().alias("none"), "id", "th")  # a null id comes last
    points, points_path = c.saved(each.groupBy("digest").agg(F.min(lead).alias("least"), F.min("fp").alias("fp"), F.first("cells").alias("cells"), F.first("sketch").alias("sketch")), "similar-points")
    edges, edges_path = c.saved(_candidates(points, radius, similarity - SLACK).distinct(), "similar-links")
    nodes = components(edges, "a", "b")
    place = F.xxhash64(F.coalesce("component", "digest")).alias("place")
    own, own_path = c.saved(points.join(nodes, points["digest"] == nodes["node"], "left").select("digest", "least.id", "least.th", F.col("node").isNotNull().alias("met"), place), "similar-own")
    shingles = each.agg(F.sum("size")).first()[0] or 0
    more = components(_met_by_prefix(_prefixes(c.spread(one), words, similarity, shingles), own.select("digest", "place")), "a", "b")
    placed = own.join(more, own["place"] == more["node"], "left").where("met OR node IS NOT NULL")
    placed, placed_path = c.saved(placed.select("digest", "id", "th", F.coalesce("component", "place").alias("place")), "similar-placed")
    sizes = placed.groupBy("place").agg(F.count("*").alias("n")).where("n > 1")
    salt = F.pmod(F.xxhash64("digest"), F.lit(SALTS)).cast("int")
    big = sizes.where(F.col("n") > BLOCK).select("place", F.col("n").alias("big"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    spot = F.when(F.col("big").isNull(), F.col("place")).otherwise(F.xxhash64("digest", "place"))  # large places are counted: spread
    placed = placed.withColumn("salt", salt).join(big, ["place", "salt"], "left").withColumn("spot", spot)
    placed = placed.join(sizes.select(F.col("place").alias("spot"), F.col("n").alias("few")), "spot", "left").withColumn("n", F.coalesce("big", "few"))
    wanted, wanted_path = c.saved(placed.where("n IS NOT NULL").select("digest", "id", "th", "place", "n"), "similar-wanted")
    pairs, pairs_path = c.saved(_checked(one, wanted, words, similarity), "similar-pairs")
    groups = components(pairs, "a", "b")
    members, members_path = c.saved(groups.join(points, groups["node"] == points["digest"]).select("digest", "component", "least"), "similar-members")
    best, best_path = c.saved(members.groupBy("component").agg(F.min("least").alias("reached")), "similar-best")
    reached = members.join(best, "component").select("digest", "reached")
    found, _ = c.saved(points.join(reached, "digest", "left").select("digest", F.coalesce("reached", "least").alias("reached")), "similar-found")
    first = F.col("id").eqNullSafe(F.col("reached.id")) & (F.col("th") == F.col("reached.th"))
    out, _ = c.saved(each.join(found, "digest").select(F.col("id").alias(id_col), "th", F.col("reached.id").alias("component_id"), first.alias("first")), "similar-rows")
    c.remove(spark, each_path, points_path, edges_path, own_path, placed_path, wanted_path, pairs_path, members_path, best_path)
    return out


def one_of_similar(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """One row of docs for each group of near copies: that with the least id (of one id, the least hash of the text). Rows
    that are equal in id and text are one; of them any stays."""
    found = similar_groups(docs, id_col=id_col, text_col=text_col, **settings).where("first")
    kept, _ = c.saved(found.groupBy(F.col(id_col).alias("kept_id"), F.col("th").alias("kept_th")).agg(F.count("*").alias("kept_n")), "similar-kept")
    th = F.xxhash64(docs[text_col])
    at = lambda part: docs.join(part, docs[id_col].eqNullSafe(part["kept_id"]) & (th == part["kept_th"]), "left_semi")
    again = kept.where("kept_n > 1")
    if again.isEmpty():
        return at(kept)
    return at(kept.where("kept_n = 1")).unionByName(at(again).dropDuplicates([id_col, text_col]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(c.table(spark, sf_dir, "documents"))
