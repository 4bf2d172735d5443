"""Token counts by a linear longest-match automaton.

The vocabulary becomes a trie with failure links. Each node knows how many word pieces are popped when its link is
followed, and how many when the word ends there, so that a scan over a word's bytes yields the length of its greedy
longest-match segmentation without building a piece; each byte is read once. All unseen words of a batch advance
together, one byte column at a time, through an open-addressing table of the trie's edges.

A word is a run without white space (str.split). A word that the vocabulary cannot segment counts as one unknown
token. Null and empty texts, and those of white space alone, have zero tokens. Rows are independent, so ties,
repeated rows and empty tables need no care; columns other than the two named are not read.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import _common as c

#: Bytes (about) of words held by the cache of a worker before it starts anew.
CACHE_BYTES = 32 << 20
#: Longer words go through the same automaton one by one, as a byte column with few words costs as much as a full one.
WIDEST = 128


class Automaton:
    """Greedy longest-match counter. Pieces at a word's start carry `start` in front, others `inner`."""

    def __init__(self, vocabulary: list[bytes], start: bytes = b"", inner: bytes = b""):
        self.start = start
        child: list[dict[int, int]] = [{}]
        final = [False]
        entry = [0, 0]  # nodes at which the first and the later pieces begin

        def reach(at: int, piece: bytes) -> int:
            for b in piece:
                nxt = child[at].get(b)
                if nxt is None:
                    nxt = child[at][b] = len(child)
                    child.append({})
                    final.append(False)
                at = nxt
            return at

        for token in vocabulary:
            if token:
                final[reach(0, token)] = True
        entry[1] = root = reach(0, inner)
        n = len(child)
        fail, pops = [-1] * n, [0] * n
        queue = [0]
        for u in queue:
            for b, v in child[u].items():
                queue.append(v)
                if v == root:
                    continue
                if final[v]:
                    fail[v], pops[v] = root, 1
                    continue
                z, popped = fail[u], pops[u]
                while z >= 0 and b not in child[z]:
                    popped += pops[z]
                    z = fail[z]
                if z >= 0:
                    fail[v], pops[v] = child[z][b], popped
        ends = [-1] * n
        for v in range(n):
            at, total = v, 0
            while at >= 0 and at != root:
                total += pops[at]
                at = fail[at]
            ends[v] = total if at == root else -1
        if root == 0:
            ends[0] = 0
        self.fail, self.pops, self.ends = np.array(fail, np.int32), np.array(pops, np.int32), np.array(ends, np.int32)
        self.edges = c.PairTable(
            np.array([u << 8 | b for u in range(n) for b in child[u]], np.int64), np.array([v for u in range(n) for v in child[u].values()], np.int32)
        )
        self.child = child
        self.cache: dict[str, int] = {}
        self.held = 0

    def scan(self, word: bytes) -> int:
        """Pieces of one word."""
        child, fail, pops = self.child, self.fail, self.pops
        at, total = 0, 0
        for b in word:
            while (nxt := child[at].get(b)) is None:
                if fail[at] < 0:
                    return 1
                total += int(pops[at])
                at = int(fail[at])
            at = nxt
        return total + int(self.ends[at]) if self.ends[at] >= 0 else 1

    def scan_all(self, words: list[bytes]) -> np.ndarray:
        """Pieces of each word; all advance together, the longest first so that the live ones stay in front."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(-lengths, kind="stable")
        lengths = lengths[order]
        flat = np.frombuffer(b"".join([words[i] for i in order.tolist()]), np.uint8)
        offset = np.cumsum(lengths) - lengths
        at, total = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        for j in range(int(lengths[0]) if len(lengths) else 0):
            live = np.arange(int(np.searchsorted(-lengths, -j, "left")))
            live = live[at[live] >= 0]
            if not len(live):
                break
            byte = flat[offset[live] + j].astype(np.int64)
            while len(live):
                nxt = self.edges.get(at[live] << 8 | byte)
                went = nxt >= 0
                at[live[went]] = nxt[went]
                live, byte = live[~went], byte[~went]
                total[live] += self.pops[at[live]]
                at[live] = self.fail[at[live]]
                stuck = at[live] < 0
                live, byte = live[~stuck], byte[~stuck]
        last = np.where(at >= 0, self.ends[np.maximum(at, 0)], -1)
        out = np.empty(len(words), np.int64)
        out[order] = np.where(last >= 0, total + last, 1)
        return out

    def counts(self, texts: list[str | None]) -> list[tuple[int, int]]:
        """(words, tokens) of each text."""
        cut = [t.split() if t else [] for t in texts]
        fresh = set().union(*cut).difference(self.cache)
        if self.held > CACHE_BYTES:
            self.cache.clear()
            self.held = 0
            fresh = set().union(*cut)
        self.held += sum(150 + 4 * len(w) for w in fresh)
        names = list(fresh)
        raw = [self.start + w.encode() for w in names]
        short = [i for i, w in enumerate(raw) if len(w) <= WIDEST]
        self.cache.update(zip([names[i] for i in short], self.scan_all([raw[i] for i in short]).tolist(), strict=True))
        for i, w in enumerate(raw):
            if len(w) > WIDEST:
                self.cache[names[i]] = self.scan(w)
        get = self.cache.__getitem__
        return [(len(x), sum(map(get, x))) for x in cut]


_AUTOMATA: dict[tuple[str, bytes, bytes], Automaton] = {}


def automaton(path: str, start: bytes, inner: bytes) -> Automaton:
    """The worker's automaton over a rank file, read once."""
    key = (path, start, inner)
    if key not in _AUTOMATA:
        with open(path, "rb") as f:
            _AUTOMATA[key] = Automaton([base64.b64decode(line.split()[0]) for line in f if line.strip()], start, inner)
    return _AUTOMATA[key]


def token_counts(docs: DataFrame, path: str, *, start: bytes = b" ", inner: bytes = b"", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_tokens) of each row."""
    c.tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = automaton(path, start, inner)
        for b in c.pieces_of(batches, "text"):
            words, tokens = zip(*own.counts(b.column(1).to_pylist()), strict=True)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], ["id", "n_words", "n_tokens"])

    one = c.spread(docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")))
    kind = one.schema["id"].dataType.simpleString()
    return one.mapInArrow(run, f"id {kind}, n_words long, n_tokens long").withColumnRenamed("id", id_col)


def _vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(c.table(spark, sf_dir, "documents"), _vocabulary())


def sql() -> str:
    """Greedy segmentation of each different word by a recursive query over hexadecimal digits of the vocabulary."""
    return rf"""
WITH RECURSIVE v AS (SELECT hex(from_base64(token)) AS token FROM read_csv('{_vocabulary()}', delim = ' ', header = false, quote = '', escape = '', columns = {{'token': 'VARCHAR', 'rank': 'BIGINT'}})),
w AS (SELECT doc_id, unnest(string_split_regex(text, '[\s\x{{0B}}\x{{1C}}-\x{{1F}}\x{{85}}\p{{Z}}]+')) AS word FROM documents),
n AS (SELECT doc_id, word, count(*) AS n FROM w WHERE word <> '' GROUP BY ALL),
cut AS (SELECT DISTINCT word, '20' || hex(encode(word)) AS rest, 0 AS pieces FROM n
  UNION ALL SELECT word, substr(rest, 1 + max(length(v.token))), pieces + 1 FROM cut, range(1, 129) t(k), v
            WHERE rest <> '' AND 2 * k <= length(rest) AND v.token = substr(rest, 1, 2 * k) GROUP BY word, rest, pieces)
SELECT d.doc_id, coalesce(sum(n), 0)::BIGINT AS n_words, coalesce(sum(n * pieces), 0)::BIGINT AS n_tokens
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN cut ON cut.word = n.word AND rest = '' GROUP BY d.doc_id
"""
