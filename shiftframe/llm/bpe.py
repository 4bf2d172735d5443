"""Byte-level BPE encoding and decoding by length-bucketed padded matrices.

Text is cut by the tokenizer's pattern. Pieces seen before come from a cache of bounded bytes; the others go, bucketed by
length, into padded matrices of token ids in which each round merges every row's leftmost minimum-rank pair. Ranks
of pairs come from an open-addressing table, rows that are done leave the matrix, and widths shrink as rows do.
Decoding knows ids alone: a document's bytes are gathered, token by token, from a flat table of all tokens' bytes.

Null and empty texts give no ids. Texts of any length are encoded whole. Rows are independent: ties, repeated rows,
empty tables and extra columns need no special care; only the two named columns are read.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from . import _common as c

#: Bytes (about) held by the cache of a worker before it starts anew, and what an entry costs besides its piece and ids.
CACHE_BYTES, ENTRY = 48 << 20, 200
#: Longer pieces are merged through a heap: a matrix row would cost the square of its length.
WIDEST = 512
NO_RANK = np.int32(2**31 - 1)


class Flat:
    """Byte strings side by side, for gathering many at once."""

    def __init__(self, parts: list[bytes]):
        self.size = np.fromiter(map(len, parts), np.int64, len(parts))
        self.start = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(parts), np.uint8)

    def gather(self, ids: np.ndarray) -> bytes:
        """The strings of the ids, one behind the other."""
        return self.flat[c.ranges(self.start[ids], self.size[ids])].tobytes()


class Codec:
    """Encoder and decoder of one rank file in the tiktoken format."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pattern = regex.compile(pattern)
        self.token = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.token[rank] = token
        self.token_bytes = Flat(self.token)
        self.decimals = Flat([b"%d," % i for i in range(len(self.token))])
        self.byte_id = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        keys, values = [], []
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    values.append(rank)
        self.pairs = c.PairTable(np.array(keys, np.int64), np.array(values, np.int32))
        self.forget()

    def forget(self) -> None:
        """Start a new cache: pieces, and the ids of each in one growing pool."""
        self.index: dict[str, int] = {}
        self.held = 0
        self.pool, self.used = np.zeros(1 << 16, np.int32), 0
        self.starts, self.counts = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        found = self.pairs.get(left.astype(np.int64) << 32 | right.astype(np.int64))
        return np.where(found < 0, NO_RANK, found)

    def merge_matrix(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """Token ids of pieces of similar length."""
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        width = int(lengths.max())
        cell = np.arange(width)
        inside = cell < lengths[:, None]
        ids = np.zeros((len(pieces), width), np.int32)
        ids[inside] = self.byte_id[np.frombuffer(b"".join(pieces), np.uint8)]
        ranks = np.full((len(pieces), width), NO_RANK, np.int32)
        joined = inside[:, 1:]
        ranks[:, :-1][joined] = self.pair_ranks(ids[:, :-1][joined], ids[:, 1:][joined])
        row, out = np.arange(len(pieces)), [()] * len(pieces)
        while len(row):
            at = ranks.argmin(axis=1)  # the first of equal ranks: the leftmost
            best = ranks[np.arange(len(row)), at]
            done = best == NO_RANK
            if done.any():
                for r, n, got in zip(row[done].tolist(), lengths[done].tolist(), ids[done].tolist(), strict=True):
                    out[r] = tuple(got[:n])
                live = ~done
                row, lengths, at, best = row[live], lengths[live], at[live], best[live]
                if not len(row):
                    break
                width = int(lengths.max())
                ids, ranks = ids[live, :width], ranks[live, :width]
            cell = np.arange(width - 1)
            source = cell + (cell > at[:, None])
            ranks_from = cell + (cell >= at[:, None])
            ids = np.take_along_axis(ids, source, axis=1)
            ranks = np.take_along_axis(ranks, ranks_from, axis=1)
            lengths = lengths - 1
            width -= 1
            n = np.arange(len(row))
            ids[n, at] = best
            right = at + 1 < lengths
            ranks[n[right], at[right]] = self.pair_ranks(ids[n[right], at[right]], ids[n[right], at[right] + 1])
            ranks[n[~right], at[~right]] = NO_RANK
            left = at > 0
            ranks[n[left], at[left] - 1] = self.pair_ranks(ids[n[left], at[left] - 1], ids[n[left], at[left]])
        return out

    def merge_long(self, piece: bytes) -> tuple[int, ...]:
        """The same merges for one long piece, by a linked list and a heap of (rank, place)."""
        ids = self.byte_id[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        token, ranks = self.token, self.ranks
        of = lambda i: ranks.get(token[ids[i]] + token[ids[after[i]]]) if after[i] < n else None
        heap = [(r, i) for i in range(n - 1) if (r := of(i)) is not None]
        heapq.heapify(heap)
        alive = bytearray(b"\1") * n
        while heap:
            rank, i = heapq.heappop(heap)
            if not alive[i] or of(i) != rank:
                continue
            j = after[i]
            ids[i], alive[j], after[i] = rank, 0, after[j]
            if after[j] < n:
                before[after[j]] = i
            for k in (before[i], i):
                if k >= 0 and (r := of(k)) is not None:
                    heapq.heappush(heap, (r, k))
        return tuple(x for x, a in zip(ids, alive, strict=True) if a)

    def learn(self, pieces: set[str]) -> None:
        """Add the ids of unseen pieces to the cache."""
        buckets: dict[int, tuple[list[str], list[bytes]]] = {}
        found: list[tuple[str, tuple[int, ...]]] = []
        for piece in pieces:
            raw = piece.encode()
            if (whole := self.ranks.get(raw)) is not None:
                found.append((piece, (whole,)))
            elif len(raw) > WIDEST:
                found.append((piece, self.merge_long(raw)))
            else:
                n = len(raw)
                names, raws = buckets.setdefault(n if n < 16 else 16 + (n - 16) // 8 if n < 64 else 20 + n.bit_length() * 4, ([], []))
                names.append(piece)
                raws.append(raw)
        for names, raws in buckets.values():
            step = max(16, 1_000_000 // max(map(len, raws)))
            for k in range(0, len(raws), step):
                found += zip(names[k : k + step], self.merge_matrix(raws[k : k + step]), strict=True)
        for piece, ids in found:
            at, n = len(self.index), len(ids)
            if at == len(self.starts):
                self.starts, self.counts = np.resize(self.starts, 2 * at), np.resize(self.counts, 2 * at)
            while self.used + n > len(self.pool):
                self.pool = np.resize(self.pool, 2 * len(self.pool))
            self.index[piece] = at
            self.starts[at], self.counts[at] = self.used, n
            self.pool[self.used : self.used + n] = ids
            self.used += n
            self.held += ENTRY + 4 * len(piece) + 4 * n

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text."""
        cut = [self.pattern.findall(t) if t else [] for t in texts]
        fresh = set().union(*cut).difference(self.index) if cut else set()
        if self.index and self.held + sum(ENTRY + 8 * len(x) for x in fresh) > CACHE_BYTES:
            self.forget()
            fresh = set().union(*cut)
        self.learn(fresh)
        places = np.fromiter(map(self.index.__getitem__, itertools.chain.from_iterable(cut)), np.int64, sum(map(len, cut)))
        sizes = self.counts[places]
        ids = self.pool[c.ranges(self.starts[places], sizes)]
        ends = np.concatenate(([0], np.cumsum(sizes)))[np.cumsum([len(x) for x in cut], dtype=np.int64)] if cut else []
        return np.split(ids, ends[:-1]) if cut else []

    def decode(self, ids) -> bytes:
        return self.token_bytes.gather(np.asarray(ids, np.int64))

    def digests(self, texts: list[str | None]) -> list[tuple[int, str, str]]:
        """Per text the number of ids, the digest of their decimals, and that of the bytes that these ids decode to."""
        sha = hashlib.sha256
        return [(len(ids), sha(self.decimals.gather(ids)[:-1]).hexdigest(), sha(self.decode(ids)).hexdigest()) for ids in self.encode(texts)]


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """The worker's codec; the rank file is read once by each."""
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = Codec(path, pattern)
    return _CODECS[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) of each row; null and empty texts have an empty array."""
    c.tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for b in c.pieces_of(batches, "text", 1 << 20):
            ids = pa.array(own.encode(b.column(1).to_pylist()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), ids], ["id", "ids"])

    one = c.spread(docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")))
    return one.mapInArrow(run, f"id {one.schema['id'].dataType.simpleString()}, ids array<int>").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, path: str, pattern: str, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, content binary) of each row's ids; a null array decodes to no bytes."""
    c.tune(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for b in batches:
            content = pa.array([own.decode(x.values if x.is_valid else ()) for x in b.column(1)], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), content], ["id", "content"])

    one = encoded.select(encoded[id_col].alias("id"), encoded[ids_col].alias("ids"))
    return one.mapInArrow(run, f"id {one.schema['id'].dataType.simpleString()}, content binary").withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): both directions in one pass, so that no ids cross to the JVM."""
    c.tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for b in c.pieces_of(batches, "text", 1 << 20):
            n, ids, decoded = zip(*own.digests(b.column(1).to_pylist()), strict=True)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids), pa.array(decoded)], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    one = c.spread(docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")))
    kind = one.schema["id"].dataType.simpleString()
    return one.mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)


def default_ranks() -> tuple[str, str]:
    """Path and pattern of the public multilingual byte-level vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(c.table(spark, sf_dir, "documents"), *default_ranks())
