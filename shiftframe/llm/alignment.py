"""Cross-tokenizer alignment by a dangling-suffix transducer.

Two tokenizers cut the same bytes at different places. The transducer's state is which side leads and the bytes by which
it leads; the side that lags gives the next token, and moves are memoised by residual and token. An empty residual closes a
group: the smallest runs of tokens of both sides that cover the same bytes. All pairs of a token of one side and a token of
the other in one group are links; a pair of ids counts in how many documents it is linked, corpus-wide.

A is a byte-level BPE file of the `tokenizers` library, which reads a space and the text; B is a `sentencepiece` BPE model,
which adds that space itself. Neither joins a space to what stands before it (looked up in the files; texts are kept whole
otherwise), so both end a token before every space that follows a letter, digit or sign, and groups never cross such places:
texts are cut there, and tokens, groups and pairs of a part are kept in a cache of bounded bytes.

Texts are encoded once; a row's digests and its distinct pairs are written. Counts of pairs are sums over that table, made in each
task before the shuffle. The pairs of the highest counts, at most `most_common` of them, go to all tasks; the links of all others are
joined with their counts in Spark. A pair outside the common ones is in fewer than 2 / most_common of all rows of pairs, so no key of
that join is hot. Nothing is dropped: both ways give the same sums.

Null and empty texts have no tokens, nor have texts whose bytes one side can't give back (U+2581 reads as a space). Repeated rows and
rows with one id are rows of their own, each counts as a document, null ids stay; an empty table gives an empty result; only the two named
columns are read. Texts are used whole.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as c
from .bpe import Flat

#: Bytes (about) that a worker's cache of parts may hold before it starts anew, and what a part costs besides its strings.
CACHE_BYTES, ENTRY = 160 << 20, 260
#: Moves that the transducer remembers before it starts anew.
MOVES = 1 << 20
#: A space after anything but white space or the piece that stands for a space: both tokenizers end a token before it.
CUT, RARE = re.compile(r"(?<=[^\s▁])(?= )"), re.compile(r"[\s▁] ")
#: Pairs whose counts go to every task.
MOST_COMMON = 1 << 20
#: Links of a group from which on equal ids are put together before they are paired.
LARGE = 4096


def byte_of_letter() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable ones themselves, the rest from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Transducer:
    """Groups of two sequences of tokens over the same bytes."""

    def __init__(self, a: list[bytes], b: list[bytes]):
        self.tokens = (a, b)
        self.forget()

    def forget(self) -> None:
        #: By state: the side whose token comes next (0: A, as B leads or nobody), the residual, and the moves known.
        self.turn, self.residual, self.moves = [0], [b""], [{}]
        self.at = {(0, b""): 0}
        self.size = 0

    def move(self, state: int, token: int) -> int:
        """The state after the next token of the side that lags."""
        left, side = self.residual[state], self.turn[state]
        new = self.tokens[side][token]
        if left and left.startswith(new):
            key = (side if len(left) > len(new) else 0, left[len(new) :])
        elif new and new.startswith(left):
            key = (1 - side, new[len(left) :])
        else:
            raise ValueError("the sides' bytes differ")
        if key not in self.at:
            self.at[key] = len(self.turn)
            self.turn.append(key[0])
            self.residual.append(key[1])
            self.moves.append({})
        self.moves[state][token] = to = self.at[key]
        self.size += 1
        return to

    def run(self, a: list[int], b: list[int]) -> tuple[list[int], list[int]]:
        """How many tokens of each side there are up to the end of each group."""
        if self.size > MOVES:
            self.forget()
        of_a, of_b, i, j = [], [], 0, 0
        turn, moves, free = self.turn, self.moves, self.moves[0]
        try:
            while i < len(a):
                token = a[i]
                i += 1
                state = free.get(token) or self.move(0, token)
                while state:
                    if turn[state]:
                        token = b[j]
                        j += 1
                    else:
                        token = a[i]
                        i += 1
                    to = moves[state].get(token)
                    state = self.move(state, token) if to is None else to
                of_a.append(i)
                of_b.append(j)
        except IndexError:  # a side ended within a group
            j = -1
        if j != len(b):
            raise ValueError("the sides' bytes differ")
        return of_a, of_b


class Grown:
    """An array that grows at its end."""

    def __init__(self, kind: type):
        self.data, self.n = np.zeros(1 << 12, kind), 0

    def extend(self, values) -> None:
        n = self.n + len(values)
        if n > len(self.data):
            self.data = np.concatenate((self.data, np.zeros(max(n, 2 * len(self.data)) - len(self.data), self.data.dtype)))
        self.data[self.n : n] = values
        self.n = n

    @property
    def all(self) -> np.ndarray:
        return self.data[: self.n]


class Aligner:
    """Both tokenizers, and what the parts of texts give: tokens, groups, links and pairs."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task for each core already
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        with open(path_a, encoding="utf-8") as f:
            of = json.load(f)
        letters = byte_of_letter()
        vocabulary = self.a.get_vocab(with_added_tokens=False)
        a = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            a[i] = bytes(letters[x] for x in token)
        b, spaced = [], True
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            if self.b.is_byte(i):
                b.append(bytes([int(piece[1:-1], 16)]))
            else:
                b.append(b"" if self.b.is_control(i) or self.b.is_unknown(i) else piece.replace("▁", " ").encode())
                spaced &= "▁" not in piece.lstrip("▁")
        first = of.get("pre_tokenizer") or {}
        self.cuts = spaced and of.get("normalizer") is None and first.get("type") == "ByteLevel" and first.get("use_regex", True) and not first.get("add_prefix_space", True)
        self.space = self.b.piece_to_id("▁")
        self.transducer = Transducer(a, b)
        self.bytes = Flat(a), Flat(b)
        self.decimals = Flat([b"%d%c" % (i, x) for own in (a, b) for i in range(len(own)) for x in b",|;"])
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.texts: list[bytes] = []
        self.held = 0
        self.n_a, self.n_b, self.n_groups, self.n_links, self.uses = (Grown(np.int64) for _ in range(5))  # no tokens: bytes differ
        self.start, self.size = Grown(np.int64), Grown(np.int64)
        self.pair_of: dict[int, int] = {}
        self.pairs = Grown(np.int64)  # A's id in the upper half, B's in the lower
        self.pair, self.times = Grown(np.int32), Grown(np.int32)

    def cut(self, text: str) -> list[str]:
        """Parts without the space that each begins with."""
        if not self.cuts:
            return [text]
        if RARE.search(f" {text}"):
            return [x[1:] for x in CUT.split(f" {text}")]
        return text.split(" ")

    def encode(self, parts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """The ids of both sides for each part; none of either where the bytes differ."""
        a = [x.ids for x in self.a.encode_batch([f" {x}" for x in parts], add_special_tokens=False)]
        b = [x or [self.space] for x in self.b.encode(parts, num_threads=1)]
        raw = "".join([f" {x}" for x in parts]).encode()
        if any(flat.gather(np.fromiter(chain.from_iterable(ids), np.int64)) != raw for flat, ids in zip(self.bytes, (a, b), strict=True)):
            for k, part in enumerate(parts):
                if any(b"".join(map(token.__getitem__, ids)) != f" {part}".encode() for token, ids in zip(self.transducer.tokens, (a[k], b[k]), strict=True)):
                    a[k], b[k] = [], []
        return a, b

    def groups(self, text: str) -> list[tuple[list[int], list[int]]]:
        """The groups of a whole text."""
        a, b = self.encode(self.cut(text))
        if not all(a):
            return []
        a, b = list(chain.from_iterable(a)), list(chain.from_iterable(b))
        ends = [(0, 0), *zip(*self.transducer.run(a, b), strict=True)]
        return [(a[i0:i], b[j0:j]) for (i0, j0), (i, j) in pairwise(ends)]

    def learn(self, parts: list[str]) -> None:
        """Add what the parts give to the cache, all at once."""
        a, b = self.encode(parts)
        n_a, n_b = (np.fromiter(map(len, x), np.int64, len(parts)) for x in (a, b))
        a, b = list(chain.from_iterable(a)), list(chain.from_iterable(b))
        of_a, of_b = (np.array([0, *x]) for x in self.transducer.run(a, b))
        # groups and links by part
        ends = np.searchsorted(of_a, np.concatenate(([0], np.cumsum(n_a))))
        p, q = np.diff(of_a), np.diff(of_b)
        links = np.concatenate(([0], np.cumsum(p * q)))
        # all pairs of small groups at once, those of large ones one by one
        ids_a, ids_b = np.array(a, np.int64), np.array(b, np.int64)
        small = np.flatnonzero(p * q <= LARGE)
        of_small = (p * q)[small]
        nth, at = c.ranges(np.zeros(len(small), np.int64), of_small), np.repeat(small, of_small)
        keys, times = ids_a[of_a[at] + nth // q[at]] << 32 | ids_b[of_b[at] + nth % q[at]], np.ones(len(at), np.int64)
        for g in np.flatnonzero(p * q > LARGE):
            (x, k), (y, m) = np.unique(ids_a[of_a[g] : of_a[g + 1]], return_counts=True), np.unique(ids_b[of_b[g] : of_b[g + 1]], return_counts=True)
            keys, times = np.concatenate((keys, (x[:, None] << 32 | y).ravel())), np.concatenate((times, (k[:, None] * m).ravel()))
            at = np.concatenate((at, np.full(len(x) * len(y), g)))
        order = np.argsort(at, kind="stable")
        keys, times = keys[order], times[order]
        starts = np.searchsorted(at[order], ends)
        known, inverse = np.unique(keys, return_inverse=True)
        fresh = [x for x in known.tolist() if x not in self.pair_of]
        self.pair_of.update(zip(fresh, range(self.pairs.n, self.pairs.n + len(fresh)), strict=True))
        number = np.fromiter(map(self.pair_of.__getitem__, known.tolist()), np.int32, len(known))
        # the groups as text: each id with what stands behind it
        code_a, code_b = ids_a * 3, ids_b * 3  # 0: a comma, 1: a bar, 2: a semicolon
        code_a[of_a[1:] - 1] += 1
        code_b[of_b[1:] - 1] += 2
        written = np.concatenate((code_a, code_b + 3 * len(self.transducer.tokens[0])))
        place = np.argsort(np.concatenate((np.repeat(2 * np.arange(len(p)), p), np.repeat(2 * np.arange(len(p)) + 1, q))), kind="stable")
        written = written[place]
        sizes = np.concatenate(([0], np.cumsum(self.decimals.size[written])))
        cuts = sizes[np.concatenate(([0], np.cumsum(n_a + n_b)))].tolist()
        line = self.decimals.gather(written)
        self.index.update(zip(parts, range(len(self.texts), len(self.texts) + len(parts)), strict=True))
        self.texts += [line[x : max(x, y - 1)] for x, y in pairwise(cuts)]
        self.start.extend(self.pair.n + starts[:-1])
        for to, values in ((self.n_a, n_a), (self.n_b, n_b), (self.n_groups, np.diff(ends)), (self.n_links, np.diff(links[ends])), (self.size, np.diff(starts)), (self.pair, number[inverse]), (self.times, times), (self.pairs, fresh), (self.uses, np.zeros(len(parts)))):
            to.extend(values)
        self.held += ENTRY * len(parts) + sum(map(len, parts)) + len(line) + 12 * len(keys) + 120 * len(fresh)

    def shrink(self) -> None:
        """Keep the parts that were used more than the middle one, and at most a quarter of the bytes' worth of pairs."""
        keep = np.flatnonzero(self.uses.all > np.median(self.uses.all))
        if not len(keep) or 120 * self.pairs.n > CACHE_BYTES // 4:
            return self.forget()
        names = list(self.index)
        pair, times = self.linked(keep)
        columns = [x.all[keep] for x in (self.n_a, self.n_b, self.n_groups, self.n_links, self.size)]
        pairs, pair_of, texts = self.pairs.all, self.pair_of, [self.texts[i] for i in keep]
        self.forget()
        self.pair_of, self.texts = pair_of, texts
        self.index = dict(zip([names[i] for i in keep], range(len(keep)), strict=True))
        for to, values in zip((self.n_a, self.n_b, self.n_groups, self.n_links, self.size, self.start, self.pair, self.times, self.pairs, self.uses), (*columns, np.cumsum(columns[-1]) - columns[-1], pair, times, pairs, np.zeros(len(keep))), strict=True):
            to.extend(values)
        self.held = ENTRY * len(keep) + sum(map(len, self.index)) + sum(map(len, texts)) + 12 * len(pair) + 120 * len(pairs)

    def places(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The parts of all texts by their place in the cache, and where each text's begin and the last one's end."""
        cut = [self.cut(t) if t else [] for t in texts]
        fresh = set().union(*cut).difference(self.index)
        if self.index and self.held + sum(map(len, fresh)) + 2 * ENTRY * len(fresh) > CACHE_BYTES:
            self.shrink()
            fresh = set().union(*cut).difference(self.index)
        if fresh:
            self.learn(list(fresh))
        ends = np.cumsum([0, *map(len, cut)])
        places = np.fromiter(map(self.index.__getitem__, chain.from_iterable(cut)), np.int64, int(ends[-1]))
        self.uses.all[:] += np.bincount(places, minlength=self.uses.n)
        return places, ends

    def whole(self, places: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Which texts have the same bytes on both sides."""
        return sums(self.n_a.all[places] == 0, ends) == 0

    def linked(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of the parts' pairs, repeats included, and how many links each stands for."""
        at = c.ranges(self.start.all[places], self.size.all[places])
        return self.pair.all[at], self.times.all[at]


def sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums between successive ends."""
    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return total[ends[1:]] - total[ends[:-1]]


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(paths: tuple[str, str]) -> Aligner:
    """The worker's aligner; the files are read once by each."""
    if paths not in _ALIGNERS:
        _ALIGNERS[paths] = Aligner(*paths)
    return _ALIGNERS[paths]


def _read(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    c.tune(docs.sparkSession)
    return c.spread(docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")))


def align(docs: DataFrame, path_a: str, path_b: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, groups): per text its groups in order, each with the ids of both sides and the byte offset at which it ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner((path_a, path_b))
        token = own.transducer.tokens[0]
        for batch in c.pieces_of(batches, "text", 1 << 20):
            out = []
            for text in batch.column(1).to_pylist():
                groups, end = [], 0
                for x, y in own.groups(text) if text else ():
                    end += sum(len(token[i]) for i in x)
                    groups.append({"a": x, "b": y, "end": end})
                out.append(groups)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], ["id", "groups"])

    kind = pa.list_(pa.struct([("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32())), ("end", pa.int64())]))
    one = _read(docs, id_col, text_col)
    return one.mapInArrow(run, f"id {one.schema['id'].dataType.simpleString()}, groups array<struct<a: array<int>, b: array<int>, end: bigint>>").withColumnRenamed("id", id_col)


def digests(docs: DataFrame, path_a: str, path_b: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times): pairs are distinct, A's id in the upper half, times their links."""
    sha = hashlib.sha256

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, last = aligner((path_a, path_b)), np.zeros(0, np.int64)
        for batch in c.pieces_of(batches, "text", 1 << 20):
            places, ends = own.places(batch.column(1).to_pylist())
            whole = own.whole(places, ends)
            columns = [sums(x.all[places], ends) * whole for x in (own.n_a, own.n_b, own.n_groups, own.n_links)]
            some = whole & (np.diff(ends) > 0)
            parts = [own.texts[i] for i in places.tolist()]
            digest = [sha(b";".join(parts[i:j])).hexdigest() if ok else "" for i, j, ok in zip(ends[:-1].tolist(), ends[1:].tolist(), some.tolist(), strict=True)]
            if own.pairs.n > len(last):
                last = np.zeros(2 * own.pairs.n, np.int64)
            pairs, times, sizes = [], [], np.zeros(len(some) + 1, np.int64)
            for at in np.flatnonzero(some):
                pair, n = own.linked(places[ends[at] : ends[at + 1]])
                order = np.arange(len(pair))
                last[pair] = order
                each = pair[last[pair] == order]
                last[each] = np.arange(len(each))
                pairs.append(own.pairs.all[each])
                times.append(np.bincount(last[pair], n, len(each)).astype(np.int64))
                sizes[at + 1] = len(each)
            lists = [pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *x]))) for x in (pairs, times)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x) for x in columns], pa.array(digest), *lists], names)

    names = ["id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"]
    one = _read(docs, id_col, text_col)
    return one.mapInArrow(run, f"id {one.schema['id'].dataType.simpleString()}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>").withColumnRenamed("id", id_col)


def pair_counts(digested: DataFrame) -> DataFrame:
    """(pair, a, b, n, best) of a table of digests: in how many documents a pair of ids is linked, and whether no other pair of its A id is in more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs, n = np.unique(batch.column(0).flatten().to_numpy(), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(n)], ["pair", "n"])

    c.tune(digested.sparkSession)
    summed = digested.select("pairs").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    counts, _ = c.saved(summed.select("pair", F.shiftright("pair", 32).cast("int").alias("a"), F.col("pair").bitwiseAND(0xFFFFFFFF).cast("int").alias("b"), "n"), "pair-counts")
    best = counts.groupBy("a").agg(F.max("n").alias("most"))  # one row for each id of the vocabulary at most
    return counts.join(best, "a").select("pair", "a", "b", "n", (F.col("n") == F.col("most")).alias("best"))


def _common_pairs(counts: DataFrame, most: int) -> tuple[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The least power of two that at most `most` counts reach, and the pairs with such counts, sorted."""
    powers = counts.groupBy(F.floor(F.log2("n")).cast("int").alias("p")).count().collect()  # 63 rows at most
    least, total = 62, 0
    for p, n in sorted(powers, reverse=True):
        total += n
        if total > most:
            break
        least = p
    least = 0 if total <= most else least
    some = counts.where(F.col("n") >= 1 << least).select("pair", "n", "best").toArrow()
    keys, n, best = (some.column(x).to_numpy() for x in ("pair", "n", "best"))
    order = np.argsort(keys)
    return 1 << least, (keys[order], n[order], best[order])


def summaries(docs: DataFrame, path_a: str, path_b: str, *, most_common: int = MOST_COMMON, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each row.

    n_best: links whose pair is in no fewer documents than any other pair of its A id. count_sum: the counts of all links' pairs.
    groups_sha256: of `a1,a2|b1;a3|b2,b3`, '' without tokens.
    """
    one = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    rows, _ = c.saved(digests(one, path_a, path_b, id_col="id").withColumn("row", F.expr("uuid()")), "aligned")  # written, so that a row keeps its number
    counts, _ = c.saved(pair_counts(rows), "pair-best")
    least, common = _common_pairs(counts, most_common)
    sent: Broadcast = docs.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n, best = sent.value
        for batch in batches:
            pairs, times = batch.column(1).flatten().to_numpy(), batch.column(2).flatten().to_numpy()
            at = np.minimum(np.searchsorted(keys, pairs), max(0, len(keys) - 1))
            hit = keys[at] == pairs if len(keys) else np.zeros(len(pairs), bool)
            at = at[hit]
            size = pc.list_value_length(batch.column(1)).to_numpy()
            ends = np.concatenate(([0], np.cumsum(size)))
            total, n_best = np.zeros(len(pairs), np.int64), np.zeros(len(pairs), np.int64)
            if len(keys):
                total[hit], n_best[hit] = n[at] * times[hit], best[at] * times[hit]
            left = np.concatenate(([0], np.cumsum(sums(~hit, ends))))
            rest = [pa.ListArray.from_arrays(pa.array(left, pa.int32()), pa.array(x[~hit])) for x in (pairs, times)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sums(n_best, ends)), pa.array(sums(total, ends)), *rest], ["row", "n_best", "count_sum", "pairs", "times"])

    scored, _ = c.saved(rows.select("row", "pairs", "times").mapInArrow(run, "row string, n_best long, count_sum long, pairs array<long>, times array<long>"), "scored")
    links = scored.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("r")).select("row", F.col("r.pairs").alias("pair"), F.col("r.times").alias("m"))
    others = links.join(counts.where(F.col("n") < least), "pair").select("row", F.when(F.col("best"), F.col("m")).otherwise(0).alias("n_best"), (F.col("n") * F.col("m")).alias("count_sum"))
    total = scored.select("row", "n_best", "count_sum").unionByName(others).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    out = rows.drop("pairs", "times").join(total, "row").select("id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    return out.withColumnRenamed("id", id_col)


def default_paths() -> tuple[str, str]:
    """The public byte-level vocabulary and the public piece model."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries(c.table(spark, sf_dir, "documents"), *default_paths())
