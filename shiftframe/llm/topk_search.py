"""Exact BM25 top-k search over an inverted index with block-max WAND pruning, by shard.

Index: each task cuts its rows into shards of bounded text, orders a shard's documents so that like ones are
neighbours (by their most frequent common word, then by length), and writes posting lists sorted by document as one row
of arrays. Document frequencies, number of documents and mean length are global.

Search, in a shard: a posting list is cut at every BLOCK documents, and each cut knows its greatest impact (block
maximum); the lists of a shard's most frequent terms are kept as columns, with a place for each document. A query's
cursors move over the cuts of all its terms: the sum of weight times block maximum bounds every document of a block. Blocks are visited from the highest bound on, in waves; those whose bound is below the threshold,
the k-th best score so far, are skipped, and their postings are never read. In a block that is visited, the columns give
each document's own part; if the best part and the maxima of the lists stay below the threshold, the block is left. Else
the lists' terms are ordered by weight, and the pivot is the first at which the best part and the sum of maxima pass the
threshold: a document without a posting of the pivot or a later term cannot reach it. So the postings from the pivot on
name the candidates; those before it are read only in blocks that have candidates left. Many queries are searched
together, each with its own blocks, threshold and pivots, so that arrays are long. What may be in the top k is scored again, term by term in a fixed order,
so scores do not depend on the sharding. They are rounded to six digits; ties go to the smaller id, null ids come last.

Queries are a written table that each task reads for itself, in bounded pieces. The search of the first shards, as many
as the square root of their number, gives every query a floor, the k-th best score there; the other shards start with
it as their threshold and return only what reaches it. The merge ranks by query, k rows of each task at most.

score = sum over terms of qtf * ln(1 + (N - df + 0.5) / (df + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len / avg)).
Terms are runs of letters and digits in lower case, known by their 64-bit hash: of V different terms any two meet with a
probability of V * V / 2 ** 65 (a hundred million: 0.0003).

Null and empty texts have no terms: they match nothing and find nothing. A document without a term of the query is not
returned, so a query may have fewer than k rows. Repeated rows are documents each. Rows that share a query id are one
query: repeated ones count once, and of different texts the terms are added. Empty tables give empty results. Very long
texts are indexed and searched whole.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import _common as c

TERM = re.compile(r"[^\W_]+")
#: Bytes of text in a shard, documents in a block.
SHARD_TEXT, BLOCK = 16 << 20, 128
#: A row of the index is a shard; Spark's reader holds a whole row group, so each has one row.
ROW_BY_ROW = {"parquet.block.row.count.limit": "1"}
#: Digits of scores; what is more than their rounding; and more than the relative error of single precision.
DIGITS, MARGIN, SINGLE = 6, 2e-6, 1e-4
#: Bytes (about) of words held by the cache of a worker before it starts anew.
CACHE_BYTES = 32 << 20
#: Terms of a shard (at most) whose posting list is kept as a column, and the share of its documents that they must occur in.
MOST_COLUMNS, COLUMN_SHARE = 1024, 1 / 24
#: Bytes (about) of a shard's columns; queries (at most) that are searched together, and their pairs with blocks (about).
COLUMN_BYTES, MOST_TOGETHER, PAIRS = 24 << 20, 128, 8192


class Terms:
    """The worker's hashes of words."""

    def __init__(self):
        self.cache: dict[str, int] = {}
        self.held = 0

    def count(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """(hash, occurrences) of each term."""
        found = Counter(TERM.findall(text.lower())) if text else {}
        cache = self.cache
        if self.held > CACHE_BYTES:
            cache.clear()
            self.held = 0
        for w in [w for w in found if w not in cache]:
            cache[w] = xxhash.xxh64_intdigest(w)
            self.held += 150 + 4 * len(w)
        n = len(found)
        return np.fromiter(map(cache.__getitem__, found), np.uint64, n), np.fromiter(found.values(), np.int32, n)


def build_shard(ids: list, docs: list[tuple[np.ndarray, np.ndarray]]) -> dict:
    """One row of the index."""
    n = len(docs)
    lengths = np.array([int(tf.sum()) for _, tf in docs], np.int64)
    sizes = np.array([len(h) for h, _ in docs], np.int64)
    terms, at = np.unique(np.concatenate([h for h, _ in docs]) if n else np.zeros(0, np.uint64), return_inverse=True)
    tf = np.concatenate([t for _, t in docs])
    doc = np.repeat(np.arange(n), sizes)
    df = np.bincount(at, minlength=len(terms))
    common = np.zeros(len(terms), bool)
    common[np.argsort(-df, kind="stable")[:64]] = True
    mark = np.full(n, -1, np.int64)
    pick = common[at]
    by = np.lexsort((at[pick], -tf[pick], doc[pick]))
    d, t = doc[pick][by], at[pick][by]
    first = np.concatenate(([True], d[1:] != d[:-1])) if len(d) else np.zeros(0, bool)
    mark[d[first]] = t[first]
    order = np.lexsort((lengths, mark))
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    doc = place[doc]
    by = np.lexsort((doc, at))
    return {
        "ids": [ids[i] for i in order.tolist()], "n": n, "total": int(lengths.sum()), "lengths": lengths[order].astype(np.int32).tobytes(), "terms": terms.tobytes(),
        "df": df.astype(np.int32).tobytes(), "doc": doc[by].astype(np.int32).tobytes(), "tf": tf[by].astype(np.int32).tobytes(),
    }


INDEX = "ids array<{}>, n long, total long, lengths binary, terms binary, df binary, doc binary, tf binary"


def index(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index: one row of arrays for each shard."""
    c.tune(docs.sparkSession)
    one = c.spread(docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")))
    kind = one.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, ids, held, size = Terms(), [], [], 0
        arrow = None

        def row() -> pa.RecordBatch:
            made = build_shard(ids, held)
            types = {"ids": pa.list_(arrow), "n": pa.int64(), "total": pa.int64()}
            return pa.RecordBatch.from_arrays([pa.array([v], types.get(k, pa.binary())) for k, v in made.items()], list(made))

        for b in batches:
            arrow = b.column(0).type
            for key, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids.append(key)
                held.append(own.count(text.as_py()))
                size += text.as_buffer().size if text.is_valid else 0
                if size >= SHARD_TEXT:
                    yield row()
                    ids, held, size = [], [], 0
        if ids:
            yield row()

    return one.mapInArrow(run, INDEX.format(kind))


class Shard:
    """Impacts, block maxima, and both directions of one shard."""

    def __init__(self, ids: list, lengths: np.ndarray, terms: np.ndarray, df: np.ndarray, doc: np.ndarray, tf: np.ndarray, avg: float, k1: float, b: float):
        self.ids, self.terms, self.n, self.doc, self.k1 = ids, terms, len(ids), doc, k1
        self.blocks = -(-self.n // BLOCK)
        self.norm = k1 * (1 - b + b * lengths / avg)
        self.impact = self.impacts(doc, tf).astype(np.float32)  # to choose candidates; their scores are in double precision
        term = np.repeat(np.arange(len(terms), dtype=np.int32), df)
        often = np.argsort(-df, kind="stable")[: min(MOST_COLUMNS, COLUMN_BYTES // (4 * max(1, self.n)))]
        often = often[df[often] >= max(2, self.n * COLUMN_SHARE)]
        self.column = np.full(len(terms), -1)
        self.column[often] = np.arange(len(often))
        starts = np.cumsum(df, dtype=np.int64) - df
        at = c.ranges(starts[often], df[often].astype(np.int64))
        self.columns = np.zeros((self.blocks, BLOCK, len(often)), np.float32)  # posting lists by place: an impact for each document
        self.columns[doc[at] // BLOCK, doc[at] % BLOCK, self.column[term[at]]] = self.impact[at]
        self.column_most = self.columns.max(axis=1, initial=0)
        block = doc // BLOCK
        opens = np.ones(len(doc), bool)
        opens[1:] = (term[1:] != term[:-1]) | (block[1:] != block[:-1])
        cut = np.flatnonzero(opens)  # a cut of a posting list: one term's postings in one block
        self.cut = np.append(cut, len(doc))
        self.cut_block = block[cut]
        self.cut_most = np.maximum.reduceat(self.impact, cut) if len(cut) else np.zeros(0, np.float32)
        self.first_cut = np.concatenate(([0], np.cumsum(np.bincount(term[cut], minlength=len(terms)))))
        by = np.argsort(doc, kind="stable")  # term by term within a document, in the order of the hashes
        self.own_term, self.own_tf = term[by], tf[by]
        self.own = np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=self.n))))
        self.weights = np.zeros(len(terms))
        self.met, self.visited, self.read = 0, 0, 0  # blocks with a term of a query, those visited, and postings read

    def impacts(self, docs: np.ndarray, tf: np.ndarray) -> np.ndarray:
        return tf * (self.k1 + 1) / (tf + self.norm[docs])

    def exact(self, docs: np.ndarray) -> np.ndarray:
        """Scores of the documents by self.weights, rounded."""
        sizes = self.own[docs + 1] - self.own[docs]
        at = c.ranges(self.own[docs], sizes)
        parts = self.weights[self.own_term[at]] * self.impacts(np.repeat(docs, sizes), self.own_tf[at])
        return np.round(np.add.reduceat(parts, np.cumsum(sizes) - sizes), DIGITS)

    def visit(self, live: np.ndarray, query: np.ndarray, least: np.ndarray, lists: tuple, wide: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, document, score) of the candidates of pairs of block and query, by block: those that may reach `least`."""
        cuts, weight, cell, most, total = lists
        columns = np.zeros((len(live), BLOCK), np.float32)
        begin = np.flatnonzero(np.concatenate(([True], live[1:] != live[:-1])))
        for a, z in zip(begin.tolist(), [*begin[1:].tolist(), len(live)], strict=True):
            columns[a:z] = (self.columns[live[a]] @ wide[:, query[a:z]]).T
        rest = total[live, query]  # of each pair: the sum of the maxima of the lists' terms
        keep = np.flatnonzero(columns.max(axis=1) + rest >= least[query])
        live, query, columns, rest = live[keep], query[keep], columns[keep], rest[keep]
        own = least[query]
        place = np.full(self.blocks * wide.shape[1], -1, np.int32)
        place[live * wide.shape[1] + query] = np.arange(len(live))
        pair = place[cell]
        inside = np.flatnonzero(pair >= 0)
        pair = pair[inside]
        inside = inside[by := np.argsort(pair.astype(np.uint16) if len(live) < 1 << 16 else pair, kind="stable")]  # terms by weight in each pair
        pair, cuts, weight, most = pair[by], cuts[inside], weight[inside], most[inside]
        upto = np.concatenate(([0], np.cumsum(most, dtype=np.float64)))
        first = np.searchsorted(pair, np.arange(len(live)))
        ahead = (columns.max(axis=1) - upto[first] - own)[pair] + upto[1:] >= -SINGLE * own[pair]  # the pivot, at which the sum passes the threshold, and what comes after it

        def scores(which: np.ndarray) -> np.ndarray:
            some = cuts[which]
            starts = self.cut[some]
            sizes = self.cut[some + 1] - starts
            at = c.ranges(starts, sizes)
            self.read += len(at)
            base = (pair[which] - self.cut_block[some]) * BLOCK
            found = np.bincount(self.doc[at] + np.repeat(base, sizes), self.impact[at] * np.repeat(weight[which], sizes), len(live) * BLOCK)
            return found.reshape(-1, BLOCK)

        score = scores(np.flatnonzero(ahead)) + columns
        before = np.bincount(pair[~ahead], most[~ahead], len(live)) * (1 + SINGLE)
        able = score + before[:, None] >= own[:, None]
        late = np.flatnonzero(~ahead & able.any(axis=1)[pair])
        if len(late):
            score += scores(late)
        row, at = np.nonzero(able & (score >= np.maximum(own, 1e-30)[:, None]))
        return query[row], live[row] * BLOCK + at, score[row, at]

    def search_all(self, asked: list[tuple[np.ndarray, np.ndarray, float]], k: int) -> list[list[tuple[float, object]]]:
        """(score, id) of each query's best k documents that reach its floor; a query is (hashes, weights, floor)."""
        step = max(1, min(MOST_TOGETHER, PAIRS // max(1, self.blocks)))
        return [found for a in range(0, len(asked), step) for found in self._together(asked[a : a + step], k)]

    def _together(self, asked: list[tuple[np.ndarray, np.ndarray, float]], k: int) -> list[list[tuple[float, object]]]:
        n = len(asked)
        hashes, weights = (np.concatenate([x[i] for x in asked]) for i in range(2))
        of = np.repeat(np.arange(n), [len(x[0]) for x in asked])
        at = np.searchsorted(self.terms, hashes)
        hit = at < len(self.terms)
        hit[hit] = self.terms[at[hit]] == hashes[hit]
        at, weights, of = at[hit], weights[hit], of[hit]
        column = self.column[at]
        wide = np.zeros((self.columns.shape[2], n), np.float32)
        wide[column[column >= 0], of[column >= 0]] = weights[column >= 0]
        common = self.column_most @ wide  # of each block and query: the sum of the maxima of the columns' terms
        by = np.lexsort((weights, of))
        by = by[column[by] < 0]
        sizes = self.first_cut[at[by] + 1] - self.first_cut[at[by]]
        cuts, weight = c.ranges(self.first_cut[at[by]], sizes), np.repeat(weights[by].astype(np.float32), sizes)
        cell = self.cut_block[cuts] * n + np.repeat(of[by], sizes)
        most = self.cut_most[cuts] * weight
        total = np.bincount(cell, most, self.blocks * n).reshape(-1, n) * (1 + SINGLE)
        bound = (common + total) * (1 + SINGLE)
        floor = np.array([x[2] for x in asked], np.float64)
        rank = np.empty(bound.shape, np.int64)
        np.put_along_axis(rank, np.argsort(-bound, axis=0, kind="stable"), np.arange(self.blocks)[:, None], axis=0)
        self.met += int((bound > 0).sum())
        least, done = floor * (1 - SINGLE) - MARGIN, np.zeros(n, np.int64)
        wave = np.where(floor > 0, self.blocks, -(-k // BLOCK) + 1)
        held = [(np.zeros(0, np.int64), np.zeros(0))] * n
        while (open_ := (bound > 0) & (rank >= done) & (rank < done + wave) & (bound >= least)).any():
            done, wave = done + wave, 4 * wave
            live, query = np.nonzero(open_)
            self.visited += len(live)
            query, docs, scores = self.visit(live, query, least * (1 - SINGLE), (cuts, weight, cell, most, total), wide)
            by = np.argsort(query, kind="stable")
            query, docs, scores = query[by], docs[by], scores[by]
            some, first, count = np.unique(query, return_index=True, return_counts=True)
            for q, a, z in zip(some.tolist(), first.tolist(), (first + count).tolist(), strict=True):
                own, reached = np.concatenate((held[q][0], docs[a:z])), np.concatenate((held[q][1], scores[a:z]))
                if len(own) > k:
                    least[q] = max(least[q], float(np.partition(reached, -k)[-k]) * (1 - SINGLE) - MARGIN)
                    own, reached = own[reached >= least[q]], reached[reached >= least[q]]
                held[q] = own, reached
        out = []
        ends = np.searchsorted(of, np.arange(n + 1))
        for q, (docs, _) in enumerate(held):
            if not len(docs):
                out.append([])
                continue
            mine = slice(ends[q], ends[q + 1])
            self.weights[at[mine]] = weights[mine]
            exact = self.exact(docs)
            self.weights[at[mine]] = 0
            out.append(best_of([(s, self.ids[d]) for s, d in zip(exact.tolist(), docs.tolist(), strict=True) if s >= asked[q][2]], k))
        return out

    def search(self, hashes: np.ndarray, weights: np.ndarray, k: int, floor: float = 0.0) -> list[tuple[float, object]]:
        return self.search_all([(hashes, weights, floor)], k)[0]


def best_of(found: list[tuple[float, object]], k: int) -> list[tuple[float, object]]:
    """The k best (score, id); ties go to the smaller id, null ids come last."""
    missing = [x for x in found if x[1] is None]
    return sorted(sorted((x for x in found if x[1] is not None), key=lambda x: x[1]) + missing, key=lambda x: -x[0])[:k]


def _asked(path: str) -> Iterator[pa.RecordBatch]:
    """The queries written below the path, in bounded pieces."""
    fs, at = pafs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
    for file in sorted(f.path for f in fs.get_file_info(pafs.FileSelector(at)) if f.path.endswith(".parquet")):
        with fs.open_input_file(file) as raw:
            yield from pq.ParquetFile(raw).iter_batches(256, columns=["query_id", "h", "w", "floor"])


def _found(shards: DataFrame, path: str, kinds: tuple[str, str], types: tuple[pa.DataType, pa.DataType], k: int, avg: float, k1: float, b: float) -> DataFrame:
    """(query_id, id, score): of each shard every query's best k that reach its floor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for r in range(x.num_rows):
                arrays = {name: np.frombuffer(x.column(i)[r].as_buffer(), t) for i, (name, t) in enumerate((("lengths", np.int32), ("terms", np.uint64), ("df", np.int32), ("doc", np.int32), ("tf", np.int32)), 1)}
                shard = Shard(x.column(0)[r].as_py(), avg=avg, k1=k1, b=b, **arrays)
                for asked in _asked(path) if len(shard.terms) else ():
                    queries, ids, scores = [], [], []
                    several = [(np.frombuffer(h.as_buffer(), np.uint64), np.frombuffer(w.as_buffer(), np.float64), floor.as_py()) for h, w, floor in zip(*(asked.column(i) for i in range(1, 4)), strict=True)]
                    for key, top in zip(asked.column(0).to_pylist(), shard.search_all(several, k), strict=True):
                        queries += [key] * len(top)
                        ids += [d for _, d in top]
                        scores += [s for s, _ in top]
                    if ids:
                        yield pa.RecordBatch.from_arrays([pa.array(queries, types[0]), pa.array(ids, types[1]), pa.array(scores, pa.float64())], ["query_id", "id", "score"])

    return shards.select("ids", "lengths", "terms", "df", "doc", "tf").mapInArrow(run, f"query_id {kinds[0]}, id {kinds[1]}, score double")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The best k of each query; Spark cuts every task's rows to k before the shuffle."""
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def search(docs: DataFrame, queries: DataFrame, *, k: int = 10, k1: float = 1.2, b: float = 0.75, id_col: str = "doc_id", text_col: str = "text", query_id_col: str = "doc_id", query_text_col: str = "text") -> DataFrame:
    """(query_id, rank, id, score) of the k best documents of each query."""
    spark = docs.sparkSession
    own, _ = c.saved(index(docs, id_col=id_col, text_col=text_col).withColumn("shard", F.monotonically_increasing_id()), "bm25-index", **ROW_BY_ROW)
    n, total, shards = (x or 0 for x in own.agg(F.sum("n"), F.sum("total"), F.count("*")).first())
    asked = queries.select(queries[query_id_col].alias("query_id"), queries[query_text_col].alias("text")).distinct()
    asked_field, id_field = asked.schema["query_id"].dataType, own.schema["ids"].dataType.elementType
    kinds = asked_field.simpleString(), id_field.simpleString()
    types = to_arrow_type(asked_field), to_arrow_type(id_field)

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for terms, df in zip(x.column(0), x.column(1), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(terms.as_buffer(), np.int64)), pa.array(np.frombuffer(df.as_buffer(), np.int32))], ["h", "df"])

    def asked_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Terms()
        for x in batches:
            for key, text in zip(x.column(0), x.column(1), strict=True):
                h, tf = known.count(text.as_py())
                if len(h):
                    yield pa.RecordBatch.from_arrays([pa.array([key.as_py()] * len(h), x.column(0).type), pa.array(h.view(np.int64)), pa.array(tf)], ["query_id", "h", "qtf"])

    df = own.select("terms", "df").mapInArrow(frequencies, "h long, df int").groupBy("h").agg(F.sum("df").alias("df"))
    terms = asked.mapInArrow(asked_terms, f"query_id {kinds[0]}, h long, qtf int").groupBy("query_id", "h").agg(F.sum("qtf").alias("qtf")).join(df, "h")
    weight = F.col("qtf") * F.log1p((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    lists = terms.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("h", weight.alias("w")))).alias("terms"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            h, w = [], []
            for entries in x.column(1):
                pairs = entries.values
                h.append(np.asarray(pairs.field("h")).astype(np.int64).tobytes())
                w.append(np.asarray(pairs.field("w")).astype(np.float64).tobytes())
            yield pa.RecordBatch.from_arrays([x.column(0), pa.array(h, pa.binary()), pa.array(w, pa.binary()), pa.array(np.zeros(len(h)))], ["query_id", "h", "w", "floor"])

    weighted, path = c.saved(lists.mapInArrow(packed, f"query_id {kinds[0]}, h binary, w binary, floor double"), "bm25-queries")
    rest = kinds, types, k, total / n if n and total else 1.0, k1, b
    chosen = own.select("shard").orderBy(F.xxhash64("shard")).limit(math.isqrt(shards))
    first, _ = c.saved(_ranked(_found(own.join(F.broadcast(chosen), "shard", "left_semi"), path, *rest), k), "bm25-first")  # a shard number for the root of the shards
    floors = first.where(F.col("rank") == k).select("query_id", F.col("score").alias("reached"))
    ready = weighted.join(floors, weighted["query_id"].eqNullSafe(floors["query_id"]), "left")
    _, ready_path = c.saved(ready.select(weighted["query_id"], "h", "w", F.coalesce("reached", "floor").alias("floor")), "bm25-floors")
    second = _found(own.join(F.broadcast(chosen), "shard", "left_anti"), ready_path, *rest)
    ranked = _ranked(first.drop("rank").unionByName(second), k)
    return ranked.select("query_id", F.col("rank").cast("long").alias("rank"), "id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents whose id is divisible by 100 as queries, with their whole texts, against all documents."""
    docs = c.table(spark, sf_dir, "documents")
    return search(docs, docs.where("doc_id % 100 = 0")).withColumnRenamed("id", "doc_id")


SQL = r"""
WITH words AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
sizes AS (SELECT doc_id, sum(tf) AS size FROM tf GROUP BY ALL),
total AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT sum(size) FROM sizes) / (SELECT count(*) FROM documents) AS mean),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY ALL),
q AS (SELECT doc_id AS query_id, term, tf * ln(1 + (n - df + 0.5) / (df + 0.5)) AS w FROM tf JOIN df USING (term), total WHERE doc_id % 100 = 0),
s AS (SELECT query_id, tf.doc_id, round(sum(w * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean))), 6) AS score
      FROM q JOIN tf USING (term) JOIN sizes ON sizes.doc_id = tf.doc_id, total GROUP BY ALL)
SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s QUALIFY rank <= 10
"""
