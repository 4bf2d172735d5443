"""Removal of repeated byte strings, by threshold-bounded interval expansion on a Burrows-Wheeler transform.

Every byte that is covered by a string of `length` bytes which also starts earlier (smaller id, or same row and
earlier start) is removed. Strings never cross rows, overlaps count, and strings are judged on the input.

1. Sharding. A window of `length` bytes belongs to the least hash of its K-byte strings, so equal windows meet. A run
   is a stretch of windows with one such value; its text is that of its windows. A value with one run in all rows
   holds no repeat, unless the string of that hash occurs twice in the run itself (periodic text).
2. Equal runs are pre-aggregated: all but the first are repeats throughout. A value that then has several different
   runs, or a periodic one, is open, and the first of each of these goes to a shard.
3. A shard sorts the suffixes of its runs' text (by prefix doubling to a depth beyond `length`), and takes the
   Burrows-Wheeler transform. Intervals are extended backward breadth first; an interval of strings of l bytes that
   closes at a boundary not met before gives it the common prefix l. The search stops at `length`: boundaries that are
   still open lie between suffixes with that much in common. In each such group the earliest window stays.
4. A value whose different runs have more than HOT_BYTES (the rim of a passage that very many rows share, or long rules
   of one character) would make one shard grow with the data. Its windows are hashed one by one instead, which spreads
   them; of equal windows in one run only the first is sent.

Equal runs are told by a 64-bit hash of their bytes beside value and number of windows, and a hot value's windows by 128
bits of BLAKE2b. Two runs that differ but share their value meet with a probability of 2 ** -64: of a million million
such pairs, 5e-8. Elsewhere bytes themselves are sorted and compared.

A null text counts as empty: no bytes, nothing removed. Texts of any length are cut into stretches of windows. Rows
equal in id and text count as one row and get equal results; different texts with one id are told apart by a 64-bit hash
of the text. Empty tables give empty results. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as c

K = 24
#: Bytes of text, or windows of one text, that are hashed at a time.
STRETCH = 1 << 17
#: Bytes of runs in a shard; three places then fit into one 64-bit number.
SHARD_BYTES = 1 << 20
#: Bytes of a value's different runs beyond which its windows are hashed one by one.
HOT_BYTES = 1 << 19
A, B, C, D = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))
B_INVERSE = np.uint64(pow(int(B), -1, 1 << 64))
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: np.uint64, n: int) -> np.ndarray:
    held = _POWERS.get(int(base))
    if held is None or len(held) < n:
        steps = np.full(max(n, STRETCH + 1024), base, np.uint64)
        steps[0] = 1
        held = _POWERS[int(base)] = np.cumprod(steps, dtype=np.uint64)
    return held[:n]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * D
    return x ^ (x >> np.uint64(29))


def _string_hashes(flat: np.ndarray) -> np.ndarray:
    """Hash of each K-byte string of flat."""
    p = flat.astype(np.uint64)
    for n in (1, 2, 4):
        p = (p[:-n] << np.uint64(8 * n)) | p[n:]
    return _mix(p[:-16] * A + (p[8:-8] ^ (p[8:-8] >> np.uint64(31))) * B + (p[16:] ^ (p[16:] >> np.uint64(27))) * C)


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while 2 * have <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (width - have)], x[width - have :]) if width > have else x


def runs(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(row, start in flat, windows, value, digest, whether periodic) of each run of the rows at [start, end) of flat."""
    full = np.flatnonzero(ends - starts >= length)
    if not len(full):
        none = np.zeros(0, np.int64)
        return none, none, none, none, none, none.astype(bool)
    hashes = _string_hashes(flat)
    value = _sliding_min(hashes, length - K + 1)
    first, n = starts[full], ends[full] - starts[full] - length + 1
    at = c.ranges(first, n)
    opens = np.ones(len(at), bool)
    opens[1:] = value[at[1:]] != value[at[1:] - 1]
    opens[np.cumsum(n) - n] = True
    place = np.flatnonzero(opens)
    windows = np.diff(np.append(place, len(at)))
    row = np.repeat(full, n)[place]
    begin = at[place]
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes * _powers(B, len(hashes)), dtype=np.uint64)))
    digest = (total[begin + windows + length - K] - total[begin]) * _powers(B_INVERSE, len(hashes) + 1)[begin]
    least = value[begin]
    span = length - K + 1
    times = np.zeros(len(begin), np.int64)  # occurrences of the value's string: in the first window, and those that enter later
    for k in range(span):
        times += hashes[begin + k] == least
    entered = np.concatenate(([0], np.cumsum(hashes[span - 1 :] == value)))
    times += entered[begin + windows] - entered[begin + 1]
    return row, begin, windows, least.view(np.int64), _mix(digest ^ windows.astype(np.uint64)).view(np.int64), times > 1


def _stretches(batch: pa.RecordBatch, column: str, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(flat, starts, ends, row of batch, offset in its text): texts side by side, long ones in overlapping parts."""
    held: list[bytes] = []
    rows: list[int] = []
    offsets: list[int] = []
    size = 0

    def flush():
        flat = np.frombuffer(b"".join(held), np.uint8)
        ends = np.cumsum([len(x) for x in held])
        return flat, ends - np.array([len(x) for x in held]), ends, np.array(rows), np.array(offsets)

    for k, value in enumerate(batch.column(batch.schema.get_field_index(column))):
        raw = value.as_buffer() if value.is_valid else None
        n = raw.size if raw else 0
        for a in range(0, n - length + 1, STRETCH):
            part = raw.slice(a, min(n - a, STRETCH + length - 1)).to_pybytes()
            if held and size + len(part) > STRETCH + length:
                yield flush()
                held, rows, offsets, size = [], [], [], 0
            held.append(part)
            rows.append(k)
            offsets.append(a)
            size += len(part)
    if held:
        yield flush()


def _first_bytes(text: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on, as a number; zeros follow the end."""
    p = np.concatenate((text, np.zeros(8, np.uint8))).astype(np.uint64)
    for k in (1, 2, 4):
        p = (p[:-k] << np.uint64(8 * k)) | p[k:]
    return p[: len(text)]


def suffix_order(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order of their first `depth` bytes at least, equal ones by position; and their first 8 bytes, sorted."""
    n = len(text)
    bits = max(1, int(n).bit_length())
    key = _first_bytes(text)
    order = np.argsort(key)
    first = key[order]
    rank = np.empty(n, np.uint64)

    def number(slots: np.ndarray, differs: np.ndarray) -> np.ndarray:
        """Give the suffixes at these slots the slot of their group's first as rank; the slots of groups over one."""
        heads = np.flatnonzero(differs)
        sizes = np.diff(np.append(heads, len(slots)))
        rank[order[slots]] = np.repeat(slots[heads], sizes)
        return slots[np.repeat(sizes > 1, sizes)]

    active = number(np.arange(n), np.concatenate(([True], first[1:] != first[:-1])))
    have = 8
    while have < depth and len(active):
        own = order[active]
        after = own + have
        second = np.where(after < n, rank[np.minimum(after, n - 1)] + np.uint64(1), np.uint64(0))
        if 3 * bits <= 64:  # group, rank of what follows, and position in one number: sorting it is all
            packed = (rank[own] << np.uint64(2 * bits)) | (second << np.uint64(bits)) | own.astype(np.uint64)
            packed.sort()
            order[active] = (packed & np.uint64((1 << bits) - 1)).astype(np.int64)
            key = packed >> np.uint64(bits)
        else:
            key = (rank[own] << np.uint64(32)) | second
            by = np.argsort(key)
            order[active] = own[by]
            key = key[by]
        active = number(active, np.concatenate(([True], key[1:] != key[:-1])))
        have *= 2
    if len(active):  # what is still equal: by position, so that the transform's mapping is consistent
        own = order[active]
        order[active] = own[np.argsort((rank[own] << np.uint64(32)) | own.astype(np.uint64))]
    return order, first


def common_groups(text: np.ndarray, order: np.ndarray, first: np.ndarray, length: int) -> np.ndarray:
    """Group number of each place in the order: neighbours share `length` bytes if they share a number.

    The sorted first 8 bytes give the common prefixes under 8 and the intervals of 8-byte strings; those that close at
    a common prefix of 7 begin the search, as they would be its next intervals.
    """
    n = len(text)
    bwt = text[order - 1]
    by_byte = np.argsort(bwt, kind="stable")
    back = np.empty(n, np.int64)  # place of the suffix that is one byte longer
    back[by_byte] = np.arange(n)
    new_byte = np.zeros(n + 1, bool)  # where the first byte of the suffixes changes
    new_byte[np.concatenate(([0], np.cumsum(np.bincount(bwt, minlength=256))))] = True
    begin = min(8, length)
    differs = first[1:] ^ first[:-1]
    met = np.zeros(n + 1, bool)
    met[0] = met[n] = True
    met[1:n] = differs >> np.uint64(64 - 8 * begin) > 0
    edges = np.flatnonzero(met)
    low, high = edges[:-1], edges[1:]
    seventh = np.ones(n + 1, bool)
    seventh[1:n] = differs >> np.uint64(64 - 8 * (begin - 1)) == 0 if begin > 1 else True
    fresh = seventh[high]
    low, high = low[fresh], high[fresh]
    label = np.full(n + 1, -1, np.int32)
    for _ in range(begin, length):  # intervals of strings of 8, 9, 10, ... bytes
        if not len(low):
            break
        sizes = high - low
        spots = back[c.ranges(low, sizes)]
        names = np.repeat(np.arange(len(low), dtype=np.int32), sizes)
        if len(spots) * 8 > n:
            label[:] = -1
            label[spots] = names
            opens = np.flatnonzero((label[1:-1] != label[:-2]) | new_byte[1:-1]) + 1
            starts = np.concatenate(([0], opens))
            starts = starts[label[starts] >= 0]
            closes = np.concatenate((opens, [n]))
            closes = closes[label[closes - 1] >= 0]
        else:
            packed = (spots.astype(np.uint64) << np.uint64(32)) | names.astype(np.uint64)
            packed.sort()
            spots, names = (packed >> np.uint64(32)).astype(np.int64), packed.astype(np.uint32)
            opens = np.concatenate(([True], (names[1:] != names[:-1]) | (spots[1:] != spots[:-1] + 1) | new_byte[spots[1:]]))
            starts = spots[opens]
            closes = spots[np.concatenate((opens[1:], [True]))] + 1
        fresh = ~met[closes]
        low, high = starts[fresh], closes[fresh]
        met[high] = True
    return np.cumsum(met[:-1]) - 1


def later_windows(pieces: list[bytes], length: int) -> list[np.ndarray]:
    """Per piece the places of windows that also occur earlier, in the order of the pieces given."""
    text = np.frombuffer(b"\xff".join([*pieces, b""]), np.uint8)  # a byte that UTF-8 never has ends each piece
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    starts = np.cumsum(sizes + 1) - sizes - 1
    order, first = suffix_order(text, length + 28)
    groups = common_groups(text, order, first, length)
    valid = np.zeros(len(text), bool)
    valid[c.ranges(starts, np.maximum(0, sizes - length + 1))] = True
    keep = valid[order]
    place, group = order[keep], groups[keep]
    by = np.lexsort((place, group))
    place, group = place[by], group[by]
    later = np.sort(place[1:][group[1:] == group[:-1]])
    cut = np.searchsorted(later, np.append(starts, len(text)))
    return [later[a:b] - s for a, b, s in zip(cut[:-1], cut[1:], starts, strict=True)]


def _spans(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of each stretch of consecutive places."""
    breaks = np.flatnonzero(np.diff(places) > 1)
    return places[np.concatenate(([0], breaks + 1))], places[np.concatenate((breaks, [len(places) - 1]))]


def _table(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = docs[text_col]
    return c.spread(docs.select(docs[id_col].alias("d"), F.xxhash64(text).alias("t"), text.cast("binary").alias("text")))


def repeated_spans(docs: DataFrame, *, length: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(d, t, s, e): stretches of bytes [s, e) to remove, not merged. t tells texts of one id apart."""
    if length < K + 1:
        raise ValueError(f"length must be over {K}")
    spark = docs.sparkSession
    c.tune(spark)
    rows = _table(docs, id_col, text_col)
    kind = rows.schema["d"].dataType.simpleString()

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for flat, starts, ends, _, _ in _stretches(b, "text", length):
                found = runs(flat, starts, ends, length)
                h, at = np.unique(found[3], return_inverse=True)
                if len(h):
                    n = np.bincount(at, 1.0 + found[5]).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(n)], ["h", "n"])

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for flat, starts, ends, row, offset in _stretches(b, "text", length):
                at, begin, windows, h, dig, periodic = runs(flat, starts, ends, length)
                if len(at):
                    s = begin - starts[at] + offset[at]
                    of = pa.array(row[at])
                    yield pa.RecordBatch.from_arrays([b.column(0).take(of), b.column(1).take(of), pa.array(s.astype(np.int32)), pa.array(windows.astype(np.int32)), pa.array(h), pa.array(dig), pa.array(periodic)], ["d", "t", "s", "w", "h", "dig", "p"])

    often = rows.select("text").mapInArrow(values, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").select("h")
    often, often_path = c.saved(often, "runs-often")
    every = rows.mapInArrow(described, f"d {kind}, t long, s int, w int, h long, dig long, p boolean").join(often, "h")
    every, every_path = c.saved(every, "runs")
    first = F.min(F.struct("d", "t", "s")).alias("first")
    kinds, kinds_path = c.saved(every.groupBy("h", "dig", "w").agg(first, F.count("*").alias("n"), F.max("p").alias("p")), "run-kinds")
    several = kinds.where("n > 1").select("h", "dig", "w", "first")
    copies = every.join(several, ["h", "dig", "w"]).where(~F.struct("d", "t", "s").eqNullSafe(F.col("first")))
    copies = copies.select("d", "t", "s", (F.col("s") + F.col("w") + (length - 1)).alias("e"))

    open_, open_path = c.saved(kinds.groupBy("h").agg(F.count("*").alias("kinds"), F.sum("w").alias("windows"), F.max("p").alias("p")).where("kinds > 1 OR p"), "run-open")
    wanted = kinds.join(open_.select("h", (F.col("windows") + F.col("kinds") * length > HOT_BYTES).alias("hot")), "h").select("first.*", "w", "h", "hot")
    lists = wanted.groupBy("d", "t").agg(F.collect_list(F.struct("s", "w", "h", "hot")).alias("runs"))
    size = open_.agg(F.sum(F.col("windows") + F.col("kinds") * length)).first()[0] or 0
    shards = max(64, -(-size // SHARD_BYTES))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            held = 0
            for d, t, text, own in zip(b.column(0), b.column(1).to_pylist(), b.column(2), b.column(3).to_pylist(), strict=True):
                raw = memoryview(text.as_buffer())
                for r in own:
                    out.append((d.as_py(), t, r["s"], r["h"], r["hot"], bytes(raw[r["s"] : r["s"] + r["w"] + length - 1])))
                    held += len(out[-1][-1])
                    if held > 1 << 20:
                        yield _pieces(out, b.schema.field(0).type)
                        out, held = [], 0
            if out:
                yield _pieces(out, b.schema.field(0).type)

    joined = rows.join(lists, rows["d"].eqNullSafe(lists["d"]) & (rows["t"] == lists["t"])).select(rows["d"], rows["t"], rows["text"], "runs")
    pieces, pieces_path = c.saved(joined.mapInArrow(cut, f"d {kind}, t long, s int, h long, hot boolean, piece binary"), "run-pieces")

    def expanded(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates(["d", "t", "s"]).sort_values(["d", "t", "s"], na_position="first", kind="stable")
        out = []
        for d, t, s, later in zip(pdf["d"], pdf["t"], pdf["s"], later_windows(pdf["piece"].tolist(), length), strict=True):
            if len(later):
                a, z = _spans(later)
                out += [(d, t, s + x, s + y + length) for x, y in zip(a.tolist(), z.tolist(), strict=True)]
        return pd.DataFrame(out, columns=["d", "t", "s", "e"])

    spread = pieces.where("NOT hot").withColumn("shard", F.pmod(F.xxhash64("h"), F.lit(shards)).cast("int")).repartition(int(min(shards, 1 << 14)), "shard")
    by_interval = spread.groupBy("shard").applyInPandas(expanded, f"d {kind}, t long, s int, e int")

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The first of each window of a piece with its hash, and spans of those that occur earlier in the piece."""
        for b in batches:
            for k, piece in enumerate(b.column(3).to_pylist()):
                n, seen, firsts, later = len(piece) - length + 1, set(), [], []
                for i in range(n):
                    digest = hashlib.blake2b(piece[i : i + length], digest_size=16).digest()
                    if digest in seen:
                        later.append(i)
                    else:
                        seen.add(digest)
                        firsts.append((i, digest))
                at = np.array([i for i, _ in firsts])
                digests = np.frombuffer(b"".join([x for _, x in firsts]), ">i8").astype(np.int64)
                a, z = _spans(np.array(later)) if later else (np.zeros(0, np.int64), np.zeros(0, np.int64))
                s = b.column(2)[k].as_py() + np.concatenate((at, a))
                e = s + length + np.concatenate((np.zeros(len(at), np.int64), z - a))
                of, none = pa.array(np.full(len(s), k)), pa.nulls(len(a), pa.int64())
                x, y = (pa.concat_arrays([pa.array(digests[j::2]), none]) for j in (0, 1))
                yield pa.RecordBatch.from_arrays([b.column(0).take(of), b.column(1).take(of), pa.array(s.astype(np.int32)), pa.array(e.astype(np.int32)), x, y], ["d", "t", "s", "e", "x", "y"])

    alone = pieces.where("hot").select("d", "t", "s", "piece").mapInArrow(single, f"d {kind}, t long, s int, e int, x long, y long")
    alone, alone_path = c.saved(alone, "run-windows")
    firsts, firsts_path = c.saved(alone.where("x IS NOT NULL").groupBy("x", "y").agg(first, F.count("*").alias("n")).where("n > 1").drop("n"), "run-window-firsts")
    by_window = alone.join(firsts, ["x", "y"]).where(~F.struct("d", "t", "s").eqNullSafe(F.col("first"))).select("d", "t", "s", "e")
    out, _ = c.saved(copies.unionByName(by_interval).unionByName(by_window).unionByName(alone.where("x IS NULL").select("d", "t", "s", "e")), "run-spans")
    c.remove(spark, alone_path, firsts_path)
    c.remove(spark, often_path, every_path, kinds_path, open_path, pieces_path)
    return out


def _pieces(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    d, t, s, h, hot, piece = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(d, kind), pa.array(t, pa.int64()), pa.array(s, pa.int32()), pa.array(h, pa.int64()), pa.array(hot, pa.bool_()), pa.array(piece, pa.binary())], ["d", "t", "s", "h", "hot", "piece"])


def merge(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal stretches covered by [start, end)."""
    by = np.argsort(starts, kind="stable")
    starts, reach = starts[by], np.maximum.accumulate(ends[by])
    opens = np.concatenate(([True], starts[1:] > reach[:-1]))
    return starts[opens], reach[np.concatenate((opens[1:], [True]))]


def dedup(docs: DataFrame, *, length: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_removed, spans, kept): the merged removed spans, and the remaining bytes concatenated."""
    spans = repeated_spans(docs, length=length, id_col=id_col, text_col=text_col)
    rows = _table(docs, id_col, text_col)
    kind = rows.schema["d"].dataType.simpleString()
    lists = spans.groupBy("d", "t").agg(F.collect_list("s").alias("s"), F.collect_list("e").alias("e"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, removed, merged, kept = [], [], [], []
            for text, s, e in zip(b.column(1), b.column(2), b.column(3), strict=True):
                raw = memoryview(text.as_buffer()) if text.is_valid else memoryview(b"")
                sizes.append(len(raw))
                if not s.is_valid:
                    removed.append(0)
                    merged.append([])
                    kept.append(bytes(raw))
                    continue
                a, z = (x.tolist() for x in merge(np.asarray(s.values, np.int64), np.asarray(e.values, np.int64)))
                removed.append(sum(z) - sum(a))
                merged.append([{"s": x, "e": y} for x, y in zip(a, z, strict=True)])
                kept.append(b"".join([raw[x:y] for x, y in zip([0, *z], [*a, len(raw)], strict=True)]))
            span = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(merged, span), pa.array(kept, pa.binary())], ["id", "n_bytes", "n_removed", "spans", "kept"])

    joined = rows.join(lists, rows["d"].eqNullSafe(lists["d"]) & (rows["t"] == lists["t"]), "left").select(rows["d"].alias("id"), "text", "s", "e")
    return joined.mapInArrow(run, f"id {kind}, n_bytes long, n_removed long, spans array<struct<s: long, e: long>>, kept binary").withColumnRenamed("id", id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup(c.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
p AS (SELECT doc_id, s, md5(substr(x, 2 * s + 1, 200)) AS h FROM (SELECT doc_id, x, unnest(range(length(x) // 2 - 99)) AS s FROM d WHERE length(x) >= 200)),
w AS (SELECT doc_id, s, row_number() OVER (PARTITION BY h ORDER BY doc_id, s) AS nth FROM p),
l AS (SELECT doc_id, s, s - lag(s) OVER (PARTITION BY doc_id ORDER BY s) AS gap FROM w WHERE nth > 1),
i AS (SELECT doc_id, s, sum(CASE WHEN gap <= 100 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY s) AS run FROM l),
r AS (SELECT doc_id, run, min(s) AS a, max(s) + 100 AS z FROM i GROUP BY ALL),
k AS (SELECT *, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY run), 0) AS before FROM r)
SELECT d.doc_id, (length(x) // 2)::BIGINT AS n_bytes, coalesce(sum(z - a), 0)::BIGINT AS n_removed, count(a)::BIGINT AS n_spans,
       sha256(unhex(coalesce(string_agg(substr(x, 2 * before + 1, 2 * (a - before)), '' ORDER BY a), '') || substr(x, 2 * coalesce(max(z), 0) + 1))) AS kept_sha256
FROM d LEFT JOIN k ON k.doc_id = d.doc_id GROUP BY d.doc_id, x
"""
