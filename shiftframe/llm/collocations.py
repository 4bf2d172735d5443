r"""Phrase collocation mining by contiguous pattern growth (PrefixSpan without gaps).

Texts are lower-cased (A-Z) and cut into pieces at `[.,;:!?\x0A-\x0D]` and pieces into words at spaces and tabs. Per language, n counts all
words and f(phrase) all contiguous occurrences within pieces. Candidates are phrases of two to four words with f >= `least`. Of the cuts of a
candidate after its first k words, with l = f(first part) and r = f(rest), the one with the lowest floor(2000000 f / (l + r)) counts (ties:
the smallest k). Candidates inside a longer candidate with at least 80 % of their occurrences go; the best `most` of each language stay.

1. The words of each language are counted, and in a table by hash the pairs of neighbours and, by two hashes, the single words (2^`bits` counters
   a task, which stop at `least`; one for `EACH` bytes of text, as full counters let everything pass). A word or pair with f >= `least` is in counters of `least` or more, so the others can go: nothing frequent does.
   A second pass counts what is left: words one by one, summed in each task first, and in two more tables the pairs again, by another hash, and
   the runs of three and four words, by two hashes, as the false ones of a single one grow with the square of the text.
   No task holds more than some 2^18 rare words, nor passes any on: they are most of the different words, and would be most of its memory.
2. Each place where a phrase may begin becomes a pointer: the words from there on, as many as may be frequent together, four at most. Equal
   pointers are one row with a count, of all that a core reads before they are shuffled, and of all texts then. These passes have one task a core,
   however many files there are: each meets most frequent phrases and has a table, and the files, the phrases and the table grow with the text.
3. Pointers go to the task of their prefix, sorted by what follows. There the projection of a prefix is a range of rows and that of each
   extension a range within it: ranges are read in order, depth first, and emit the phrases that are frequent. Only the open prefix of each depth is held.
   A prefix of two words with over 1 / `splits` of all rows is dealt out by its third word, and one of three words by its fourth; their own
   counts are plain sums then. There are fewer than `splits` of either, so their lists go to all tasks.
4. Counts of the parts are joined to the candidates; products are decimals of 38 digits.

Null texts are empty, a null language is `und`, empty tables give no rows, repeated rows count each time, null ids don't matter; only the two named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as c

#: A-Z become a-z, and all bytes that end a piece a full stop.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else 46 if b in b".,;:!?\n\v\f\r" else b for b in range(256))
#: Words that a task numbers before it forgets the rare ones, and pointers that it holds before it sums up those that are equal. It passes on
#: what it has where over twice as many words, or half as many pointers, are left.
MOST_WORDS, MOST_POINTERS = 1 << 18, 1 << 21
#: Bytes of text whose words a task takes apart at once.
PIECE = 1 << 20
#: Counters of one row of a task's table of pairs.
CHUNK = 1 << 16
SALTS = 32
#: Bytes of text for each counter, and bounds of `bits`: the tables of a task are twice 2^28 bytes at most, which are 8 GB of text.
EACH, FEWEST_BITS, MOST_BITS = 32, 24, 28
#: Makes the second hash another one.
SECOND = 0x5EED


class Words(dict):
    """Numbers of words in order of appearance; 0 is the end of a piece."""

    def __init__(self, lang: str):
        super().__init__({b".": 0})
        self.seed = xxhash.xxh64_intdigest(lang.encode())
        self.hashes = np.zeros(1, np.uint64)

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n

    def numbers(self, text: bytes) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, text.translate(LETTERS).replace(b".", b" . ").split()), np.int32)

    def slots(self, ids: np.ndarray, at: np.ndarray, k: int, bits: int, start: int = 0) -> np.ndarray:
        """The counters of the k words from each place on."""
        if len(self) > len(self.hashes):
            fresh = list(self)[len(self.hashes) :]
            self.hashes = np.concatenate((self.hashes, np.fromiter((xxhash.xxh64_intdigest(w, self.seed) for w in fresh), np.uint64, len(fresh))))
        mixed = np.full(len(at), start + k, np.uint64)
        for j in range(k):
            mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + self.hashes[ids[at + j]]
            mixed ^= mixed >> np.uint64(29)
        return ((mixed * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - bits)).astype(np.int64)

    def pairs(self, ids: np.ndarray) -> np.ndarray:
        """Where two words of a piece follow each other."""
        return np.flatnonzero((ids[:-1] > 0) & (ids[1:] > 0))

    def frequent_pairs(self, ids: np.ndarray, good: np.ndarray, bits: int) -> np.ndarray:
        """Whether a pair that may be frequent begins at each place; three places more at the end."""
        at = self.pairs(ids)
        go = np.zeros(len(ids) + 3, bool)
        go[at[_full(good, self.slots(ids, at, 2, bits))]] = True
        return go

    def frequent_words(self, good: np.ndarray, bits: int) -> np.ndarray:
        """Numbers of the words that may be frequent, 0 among them."""
        ids = np.arange(len(self))
        found = _full(good, self.slots(ids, ids, 1, bits)) & _full(good, self.slots(ids, ids, 1, bits, SECOND))
        found[0] = True
        return np.flatnonzero(found)

    def keep(self, ids: np.ndarray) -> np.ndarray:
        """Forget all words but these, 0 among them; returns the new numbers of the old ones."""
        names, new = list(self), np.zeros(len(self), np.int64)
        new[ids] = np.arange(len(ids))
        self.hashes = self.hashes[ids]
        self.clear()
        self.update((names[x], k) for k, x in enumerate(ids.tolist()))
        return new

    def column(self) -> pa.Array:
        return pa.array(self, pa.binary()).cast(pa.string())


def _full(good: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """Those slots whose bits are set; there are too many counters for a byte each."""
    return (good[slots >> 3] << (slots & 7).astype(np.uint8)) & np.uint8(128) > 0


def _bits(docs: DataFrame) -> int:
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return min(max(FEWEST_BITS, (size // EACH).bit_length()), MOST_BITS)


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[str, bytes]]:
    """The texts of each language of a batch, one behind the other."""
    langs = batch.column(0).to_pylist()
    found: dict[str, list[bytes]] = {}
    for lang, text in zip(langs, batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
        if text:
            found.setdefault(lang, []).append(text)
    for lang, texts in found.items():
        yield lang, b"\n".join(texts)


def _a_core(docs: DataFrame) -> DataFrame:
    """One task a core."""
    return docs.coalesce(docs.sparkSession.sparkContext.defaultParallelism)


def _count(docs: DataFrame, least: int, bits: int) -> DataFrame:
    """(lang, n) with the number of words and (chunk, counters) of pairs and words, one row for each task and language or stretch."""
    kind = np.uint8 if least < 256 else np.uint32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << bits, kind)
        words: dict[str, Words] = {}
        totals: dict[str, int] = {}
        for batch in c.pieces_of(batches, "text", PIECE):
            for lang, text in _texts(batch):
                own = words.setdefault(lang, Words(lang))
                ids = own.numbers(text)
                n = np.bincount(ids, minlength=1)
                n[0] = 0
                totals[lang] = totals.get(lang, 0) + int(n.sum())
                _tally(table, own.slots(ids, own.pairs(ids), 2, bits), least)
                some = np.flatnonzero(n)
                single = [own.slots(some, np.arange(len(some)), 1, bits, start) for start in (0, SECOND)]
                _tally(table, np.concatenate(single), least, np.tile(n[some], 2))
            if sum(map(len, words.values())) > MOST_WORDS:
                words.clear()
        some = [x for x in totals.items() if x[1]]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in some], pa.string()), pa.array([x[1] for x in some], pa.int64()), pa.nulls(len(some), pa.int32()), pa.nulls(len(some), pa.binary())], heads)
        for chunk, part in _chunks(table):
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.string()), pa.nulls(1, pa.int64()), pa.array([chunk], pa.int32()), pa.array([part])], heads)

    heads = ["lang", "n", "chunk", "counters"]
    return _a_core(docs).mapInArrow(run, "lang string, n long, chunk int, counters binary")


def _count_longer(docs: DataFrame, found: np.ndarray, least: int, bits: int) -> DataFrame:
    """(lang, word, n) of words that may be frequent, and (chunk, counters) of pairs that may be, by a second hash, behind those of runs of three and four words of such pairs, by both."""
    kind, sent = np.uint8 if least < 256 else np.uint32, docs.sparkSession.sparkContext.broadcast(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, good = np.zeros(2 << bits, kind), sent.value
        words: dict[str, Words] = {}
        counts: dict[str, np.ndarray] = {}
        kept = 0

        def numbered() -> int:
            return sum(map(len, words.values()))

        def forget() -> None:
            for lang, own in words.items():
                some = own.frequent_words(good, bits)
                own.keep(some)
                counts[lang] = counts[lang][some]

        def passed_on() -> Iterator[pa.RecordBatch]:
            for lang, own in words.items():
                names, n = own.column()[1:], counts[lang][1:]
                for k in range(0, len(n), 1 << 16):
                    m = len(n[k : k + (1 << 16)])
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * m), names[k : k + m], pa.array(n[k : k + m]), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())], heads)
            words.clear()
            counts.clear()

        for batch in c.pieces_of(batches, "text", PIECE):
            for lang, text in _texts(batch):
                own = words.setdefault(lang, Words(lang))
                ids = own.numbers(text)
                n = np.bincount(ids, minlength=len(own))
                n[: len(counts.get(lang, ()))] += counts.get(lang, np.zeros(0, np.int64))
                counts[lang] = n
                go = own.frequent_pairs(ids, good, bits)
                three = np.flatnonzero(go[:-1] & go[1:])
                four = three[go[three + 2]]
                again = own.slots(ids, np.flatnonzero(go), 2, bits, SECOND) + (1 << bits)
                runs = [own.slots(ids, at, k, bits, start) for at, k in ((three, 3), (four, 4)) for start in (0, SECOND)]
                _tally(table, np.concatenate((*runs, again)), least)
            if numbered() > kept + MOST_WORDS:
                forget()
                if numbered() > 2 * MOST_WORDS:
                    yield from passed_on()
                kept = numbered()
        forget()
        yield from passed_on()
        for chunk, part in _chunks(table):
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.string()), pa.nulls(1, pa.string()), pa.nulls(1, pa.int64()), pa.array([chunk], pa.int32()), pa.array([part])], heads)

    heads = ["lang", "word", "n", "chunk", "counters"]
    return _a_core(docs).mapInArrow(run, "lang string, word string, n long, chunk int, counters binary")


def _tally(table: np.ndarray, slots: np.ndarray, least: int, times: np.ndarray | None = None) -> None:
    if times is None:
        slots, n = np.unique(slots, return_counts=True)
    else:
        slots, at = np.unique(slots, return_inverse=True)
        n = np.bincount(at, times, len(slots)).astype(np.int64)
    table[slots] = np.minimum(table[slots] + n, least)


def _chunks(table: np.ndarray) -> Iterator[tuple[int, bytes]]:
    for k in range(0, len(table), CHUNK):
        if table[k : k + CHUNK].any():
            yield k // CHUNK, pa.compress(table[k : k + CHUNK].tobytes(), "zstd", asbytes=True)


def _merged(tables: DataFrame, least: int, size: int) -> DataFrame:
    """`tables` with the sums of all tasks' tables of `size` counters: (chunk, found) are packed bits of the counters of `least` or more. Rows that are no counters stay as they are.

    Tables go from one task to the next as they are, packed; written and read they would be many times that in the readers' buffers.
    """
    kind, own = np.dtype(np.uint8 if least < 256 else np.uint32), min(CHUNK, size)
    heads = [x for x in tables.columns if x not in ("chunk", "counters")]
    rows = tables.select(*heads, "chunk", "counters")
    schema = rows.withColumnRenamed("counters", "found").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        types = [pa.null()] * len(heads)
        for batch in batches:
            types = batch.schema.types[: len(heads)]
            counts = batch.column(len(heads)).is_null()
            if pc.any(counts).as_py():
                yield pa.RecordBatch.from_arrays(batch.filter(counts).columns, [*heads, "chunk", "found"])
            for chunk, counters in zip(*batch.filter(pc.invert(counts)).columns[-2:], strict=True):
                new = np.frombuffer(pa.decompress(counters.as_buffer(), own * kind.itemsize, "zstd"), kind)
                k = chunk.as_py()
                total[k] = np.minimum(total[k].astype(np.uint32) + new, least).astype(kind) if k in total else new
        for chunk, sums in total.items():
            yield pa.RecordBatch.from_arrays([*(pa.nulls(1, x) for x in types), pa.array([chunk], pa.int32()), pa.array([np.packbits(sums >= least).tobytes()])], [*heads, "chunk", "found"])

    return rows.repartition("chunk", *heads).mapInArrow(run, schema)


def _found(merged: DataFrame, size: int) -> np.ndarray:
    """All counters of merged tables, as packed bits: `size` of them."""
    out = [bytes(min(CHUNK, size) // 8)] * max(1, size // CHUNK)
    for chunk, found in merged.where("chunk IS NOT NULL").select("chunk", "found").collect():
        out[chunk] = bytes(found)
    return np.frombuffer(b"".join(out), np.uint8)


def _frequent(tables: DataFrame, least: int, size: int) -> np.ndarray:
    """The counters of `least` or more as packed bits: `size` of them."""
    return _found(_merged(tables, least, size), size)


def _pointers(docs: DataFrame, pairs: np.ndarray, longer: np.ndarray, bits: int) -> DataFrame:
    """(lang, w1, w2, w3, w4, n): the words from each place where a phrase may begin, summed over all that a core reads."""
    sent = docs.sparkSession.sparkContext.broadcast((pairs, longer))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        good, good_longer = sent.value
        words: dict[str, Words] = {}
        held: dict[str, list[np.ndarray]] = {}
        kept = 0

        def size() -> int:
            return sum(x.shape[1] for parts in held.values() for x in parts)

        def numbered() -> int:
            return sum(map(len, words.values()))

        def joined(lang: str) -> np.ndarray:
            sums = np.concatenate(held[lang], axis=1)
            held[lang] = [sums]
            return sums

        def sum_up() -> None:
            for lang in held:
                sums = joined(lang)
                order = np.lexsort((sums[1], sums[0]))
                for row in sums:  # in place, as there may be many
                    row[:] = row[order]
                starts = np.flatnonzero(np.concatenate(([True], (sums[:2, 1:] != sums[:2, :-1]).any(axis=0))))
                held[lang] = [np.stack((sums[0, starts], sums[1, starts], np.add.reduceat(sums[2], starts)))]

        def forget() -> None:
            for lang in [x for x in words if x not in held]:
                del words[lang]
            for lang, own in words.items():
                sums, used = joined(lang), np.zeros(len(own), bool)
                used[0] = True
                for row in sums[:2]:
                    used[row >> 32] = used[row & 0xFFFFFFFF] = True
                new = own.keep(np.flatnonzero(used))
                for row in sums[:2]:
                    row[:] = new[row >> 32] << 32 | new[row & 0xFFFFFFFF]

        def passed_on() -> Iterator[pa.RecordBatch]:
            for lang, (sums,) in held.items():
                names = words[lang].column()
                for k in range(0, sums.shape[1], 1 << 16):
                    first, rest, n = sums[:, k : k + (1 << 16)]
                    ids = [x for y in (first, rest) for x in (y >> 32, y & 0xFFFFFFFF)]
                    columns = [names.take(pa.array(x, mask=x == 0)) for x in ids]
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n)), *columns, pa.array(n)], heads)
            held.clear()
            words.clear()

        for batch in c.pieces_of(batches, "text", PIECE):
            for lang, text in _texts(batch):
                own = words.setdefault(lang, Words(lang))
                ids = own.numbers(text)
                go = own.frequent_pairs(ids, good, bits)
                at = np.flatnonzero(go)
                go[at] = _full(good_longer, own.slots(ids, at, 2, bits, SECOND) + (1 << bits))
                three = np.flatnonzero(go[:-1] & go[1:])
                for start in (0, SECOND):
                    three = three[_full(good_longer, own.slots(ids, three, 3, bits, start))]
                four = three[go[three + 2]]
                for start in (0, SECOND):
                    four = four[_full(good_longer, own.slots(ids, four, 4, bits, start))]
                begin = np.flatnonzero(go)
                third, fourth = np.zeros(len(go), np.int64), np.zeros(len(go), np.int64)
                third[three], fourth[four] = ids[three + 2], ids[four + 3]
                ids, third, fourth = ids.astype(np.int64), third[begin], fourth[begin]
                if len(begin):
                    held.setdefault(lang, []).append(np.stack((ids[begin] << 32 | ids[begin + 1], third << 32 | fourth, np.ones(len(begin), np.int64))))
            full = size() > MOST_POINTERS
            if full or numbered() > kept + MOST_WORDS:
                if full:
                    sum_up()
                forget()
                if full and 2 * size() > MOST_POINTERS or numbered() > 2 * MOST_WORDS:
                    sum_up()
                    yield from passed_on()
                kept = numbered()
        sum_up()
        yield from passed_on()

    heads = ["lang", "w1", "w2", "w3", "w4", "n"]
    return _a_core(docs).mapInArrow(run, "lang string, w1 string, w2 string, w3 string, w4 string, n long")


def _grow(least: int):
    """Phrases that are frequent, from pointers sorted by language and words. From `depth` on a prefix's rows are all in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[int, tuple[tuple, int] | None] = {2: None, 3: None, 4: None}

        def frequent(found: list[tuple[tuple, int]]) -> pa.RecordBatch:
            some = [x for x in found if x[1] >= least]
            return pa.RecordBatch.from_arrays([pa.array([x[0][0] for x in some], pa.string()), pa.array([" ".join(x[0][1:]) for x in some], pa.string()), pa.array([len(x[0]) - 1 for x in some], pa.int32()), pa.array([x[1] for x in some], pa.int64())], ["lang", "phrase", "k", "f"])

        for batch in batches:
            if not batch.num_rows:
                continue
            changed = np.ones(batch.num_rows, bool)
            changed[1:] = False
            n, depth = batch.column(5).to_numpy(), batch.column(6).to_numpy()
            out: list[tuple[tuple, int]] = []
            for k in range(5):
                column = batch.column(k)
                column = column.fill_null(".") if k > 2 else column  # no word is a full stop
                changed[1:] |= pc.not_equal(column.slice(1), column.slice(0, batch.num_rows - 1)).to_numpy(zero_copy_only=False)
                if k < 2:
                    continue
                starts = np.flatnonzero(changed)
                total = np.add.reduceat(n, starts)
                here = (depth[starts] <= k) & (column.take(pa.array(starts)).is_valid().to_numpy(zero_copy_only=False)) & (batch.column(k).take(pa.array(starts)).is_valid().to_numpy(zero_copy_only=False))
                # the first range may go on from the batch before, the last into the next
                wanted = np.flatnonzero(here & (total >= least)).tolist()
                ends = [0, len(starts) - 1]
                for j in sorted({*wanted, *[j for j in ends if here[j]]}):
                    key = tuple(batch.column(x)[int(starts[j])].as_py() for x in range(k + 1))
                    sum_ = int(total[j])
                    if j == 0 and open_[k] is not None and open_[k][0] == key:
                        sum_ += open_[k][1]
                        open_[k] = None
                    if j == len(starts) - 1:
                        if open_[k] is not None:
                            out.append(open_[k])
                        open_[k] = (key, sum_)
                    else:
                        out.append((key, sum_))
                if not here[-1] and open_[k] is not None:
                    out.append(open_[k])
                    open_[k] = None
            yield frequent(out)
        yield frequent([x for x in open_.values() if x is not None])

    return run


def phrases(docs: DataFrame, *, least: int = 30, bits: int | None = None, splits: int = 1024, text_col: str = "text", lang_col: str = "lang") -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, k, f) of all frequent phrases of one to four words, and (lang, n) with the number of words. Both are written tables."""
    spark = docs.sparkSession
    c.tune(spark)
    own = c.spread(docs.select(F.coalesce(docs[lang_col].cast("string"), F.lit("und")).alias("lang"), docs[text_col].alias("text")))
    bits = _bits(own) if bits is None else bits
    counted, counted_path = c.saved(_merged(_count(own, least, bits), least, 1 << bits), "phrase-counts")
    totals, _ = c.saved(counted.where("lang IS NOT NULL").groupBy("lang").agg(F.sum("n").alias("n")), "phrase-totals")
    pairs = _found(counted, 1 << bits)
    longer, longer_path = c.saved(_merged(_count_longer(own, pairs, least, bits), least, 2 << bits), "phrase-longer")
    words = longer.where("word IS NOT NULL").groupBy("lang", "word").agg(F.sum("n").alias("f")).where(F.col("f") >= least)  # read once
    pointers, pointers_path = c.saved(_pointers(own, pairs, _found(longer, 2 << bits), bits).groupBy("lang", "w1", "w2", "w3", "w4").agg(F.sum("n").alias("n")), "phrase-pointers")
    most = max(1, pointers.count() // splits)
    size = F.sum("n").alias("f"), F.count("*").alias("rows")
    large2, path2 = c.saved(pointers.groupBy("lang", "w1", "w2").agg(*size).where(F.col("rows") > most), "phrase-large2")
    of_large = pointers.join(F.broadcast(large2.select("lang", "w1", "w2")), ["lang", "w1", "w2"], "left_semi")  # fewer than `splits` rows
    large3, path3 = c.saved(of_large.where("w3 IS NOT NULL").groupBy("lang", "w1", "w2", "w3").agg(*size).where(F.col("rows") > most), "phrase-large3")
    at = pointers.join(F.broadcast(large2.select("lang", "w1", "w2", F.lit(3).alias("d2"))), ["lang", "w1", "w2"], "left")
    at = at.join(F.broadcast(large3.select("lang", "w1", "w2", "w3", F.lit(4).alias("d3"))), ["lang", "w1", "w2", "w3"], "left")
    at = at.select("lang", "w1", "w2", "w3", "w4", "n", F.coalesce("d3", "d2", F.lit(2)).alias("depth")).where("depth = 2 OR depth = 3 AND w3 IS NOT NULL OR w4 IS NOT NULL")
    dealt = at.repartition("lang", "w1", "w2", F.when(F.col("depth") >= 3, F.col("w3")), F.when(F.col("depth") == 4, F.col("w4")))
    grown = dealt.sortWithinPartitions("lang", "w1", "w2", "w3", "w4").mapInArrow(_grow(least), "lang string, phrase string, k int, f long")
    one = words.select("lang", F.col("word").alias("phrase"), F.lit(1).alias("k"), "f")
    two = large2.where(F.col("f") >= least).select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), F.lit(2).alias("k"), "f")
    three = large3.where(F.col("f") >= least).select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), F.lit(3).alias("k"), "f")
    all_, _ = c.saved(one.unionByName(grown).unionByName(two).unionByName(three), "phrases")
    c.remove(spark, counted_path, longer_path, pointers_path, path2, path3)
    return all_, totals


def collocations(docs: DataFrame, *, least: int = 30, most: int = 2000, percent: int = 80, bits: int | None = None, splits: int = 1024, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best phrases of each language."""
    found, totals = phrases(docs, least=least, bits=bits, splits=splits, text_col=text_col, lang_col=lang_col)
    own = found.where("k > 1").select("lang", "phrase", F.split("phrase", " ").alias("w"), "k", F.col("f").alias("a"))
    part = lambda start, size: F.array_join(F.slice("w", start, size), " ")
    cuts = own.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1))).select("lang", "phrase", "a", "cut", part(F.lit(1), F.col("cut")).alias("first"), part(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("rest"))
    of = lambda name, count: found.select("lang", F.col("phrase").alias(name), F.col("f").alias(count))
    wide = lambda x: F.col(x).cast("decimal(38,0)")
    joined = cuts.join(of("first", "l"), ["lang", "first"]).join(of("rest", "r"), ["lang", "rest"])
    joined = joined.withColumns({"wa": F.lit(2_000_000).cast("decimal(8,0)") * F.col("a").cast("decimal(20,0)"), "wb": (wide("l") + wide("r")).cast("decimal(21,0)")})
    scored = joined.select("lang", "phrase", "a", F.struct(F.expr("wa div wb").alias("score"), "cut", "l", "r").alias("s")).groupBy("lang", "phrase", "a").agg(F.min("s").alias("s"))
    inner = own.where("k > 2").withColumn("size", F.explode(F.sequence(F.lit(2), F.col("k") - 1))).withColumn("start", F.explode(F.sequence(F.lit(1), F.col("k") - F.col("size") + 1)))
    inside = inner.groupBy("lang", part(F.col("start"), F.col("size")).alias("phrase")).agg(F.max("a").alias("longer"))
    kept = scored.join(inside, ["lang", "phrase"], "left").where((F.col("longer").isNull()) | (100 * F.col("longer") < percent * F.col("a")))
    flat = kept.select("lang", "phrase", "a", "s.l", "s.r", "s.score")
    return _best(flat, most).join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _best(rows: DataFrame, most: int) -> DataFrame:
    """The first rows of each language with their rank: first of each salt, then of those, so that no task gets a whole language."""
    by = "lang", "salt"
    order = "score DESC, a DESC, phrase"
    some = rows.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).cast("int"))
    some = some.withColumn("nth", F.expr(f"row_number() OVER (PARTITION BY {', '.join(by)} ORDER BY {order})")).where(F.col("nth") <= most)
    return some.withColumn("rank", F.expr(f"row_number() OVER (PARTITION BY lang ORDER BY {order})").cast("long")).where(F.col("rank") <= most).drop("salt", "nth")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(c.table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
pieces AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS p FROM d),
w AS MATERIALIZED (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM pieces),
g AS (SELECT lang, k::INTEGER AS k, array_to_string(w[i + 1:i + k], ' ') AS phrase
      FROM (SELECT lang, w, k, unnest(range(len(w) - k + 1)) AS i FROM w, range(1, 5) t(k) WHERE len(w) >= k)),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 30),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY 1),
own AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
cuts AS (SELECT lang, phrase, a, cut, array_to_string(w[1:cut], ' ') AS first, array_to_string(w[cut + 1:k], ' ') AS rest
         FROM (SELECT *, unnest(range(1, k)) AS cut FROM own)),
scored AS (SELECT c.lang, c.phrase, c.a, x.f AS l, y.f AS r, ((2000000::HUGEINT * c.a) // (x.f + y.f))::BIGINT AS score,
                  row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY (2000000::HUGEINT * c.a) // (x.f + y.f), cut) AS nth
           FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = c.first JOIN f y ON y.lang = c.lang AND y.phrase = c.rest),
parts AS (SELECT lang, a, array_to_string(w[s:s + m - 1], ' ') AS phrase
          FROM (SELECT *, unnest(range(1, k - m + 2)) AS s FROM (SELECT *, unnest(range(2, k)) AS m FROM own WHERE k > 2))),
inside AS (SELECT lang, phrase, max(a) AS longer FROM parts GROUP BY ALL),
kept AS (SELECT s.*, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, s.a DESC, s.phrase) AS rank
         FROM scored s LEFT JOIN inside i ON s.lang = i.lang AND s.phrase = i.phrase WHERE nth = 1 AND (longer IS NULL OR 100 * longer < 80 * s.a))
SELECT k.lang, rank, phrase, a, l, r, n.n, score FROM kept k JOIN n ON k.lang = n.lang WHERE rank <= 2000
"""
