"""Benchmark decontamination by template canonicalisation.

Words lose their punctuation and case; words without a letter or digit go. Numbers (digits or number words), units after
a number, and names (capitalised words that don't begin a sentence) become typed placeholders. A capitalised word that
begins a sentence may be a name or not, so there is a second template, in which it is a name; windows of either template
match those of the other.

1. The hashes of all windows of `window` template words of the benchmark make a table, and a Bloom filter of
   2 ** 28 bits at most. Items shorter than a window are matched as a whole; those of under `least` words only verbatim,
   where they are a sentence (or several) of the document, as so few words stand in many texts by chance. Windows with so
   many numbers that they count verbatim only are hashed with their values, so that tables of numbers don't meet each other.
2. One pass over the documents, whatever the benchmark's size, keeps those with a window in the filter, and a hash join
   with the table gives the pairs of document and item that share a window.
3. Each pair is checked in full. Consecutive matching windows at one offset make a stretch, along which the template
   words must be equal. A window whose slots have the item's own values counts as it is: verbatim copies are found
   whatever they are made of. A window with exchanged values counts if the slots are consistent over the whole stretch
   (one benchmark value stands for one document value throughout, and the reverse), and if it holds `literals` words
   at least that are equal and no numbers (of a shorter item a share of them); two or more names that begin sentences
   make up for one. So an item whose numbers, units or names were exchanged is still found.

A document is contaminated if one window matches. Null and empty texts match nothing; long texts are scanned whole;
repeated rows are judged alike and counted once; rows of one id with different texts are judged each by its own text;
equal items are all reported, and texts that share an item id are passages of one item; an empty benchmark or document
table gives no matches. Ids may be of any type. Other columns are carried along by `decontaminate` and not read.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import _common as c

#: Units that become a placeholder after a number, in four languages.
UNITS = frozenset(
    "% percent kg g mg lb lbs oz ton tons tonnes km m cm mm mi mile miles ft feet foot inch inches yd yards meter meters metre metres "
    "l ml liter liters litre litres gallon gallons s sec secs second seconds min mins minute minutes h hr hrs hour hours day days week weeks "
    "month months year years $ € £ dollar dollars cent cents euro euros pound pounds usd eur gbp kmh mph hz khz mhz ghz w kw mw kwh j kj cal kcal "
    "v a degrees degree °c °f b kb mb gb tb "
    "prozent gramm kilogramm tonne tonnen kilometer meile meilen fuß zoll sekunde sekunden minuten stunde stunden tag tage tagen woche wochen monat monate monaten jahr jahre jahren grad pfund "
    "pourcent gramme grammes kilogramme kilogrammes kilomètre kilomètres mètre mètres litron seconde secondes heure heures jour jours semaine semaines mois an ans année années degré degrés livre livres "
    "gramo gramos kilo kilos kilogramo kilogramos kilómetro kilómetros metro metros litro litros segundo segundos minuto minutos hora horas día días semana semanas mes meses año años grado grados libra libras".split()
)
#: Words that are numbers, in four languages; those that are articles too are left out.
NUMBERS = frozenset(
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty "
    "sixty seventy eighty ninety hundred thousand million billion dozen "
    "null zwei drei vier fünf sechs sieben acht neun zehn elf zwölf dreizehn vierzehn fünfzehn sechzehn siebzehn achtzehn neunzehn zwanzig dreißig vierzig fünfzig hundert tausend dutzend "
    "zéro deux trois quatre cinq sept huit neuf dix onze douze treize quatorze quinze seize vingt trente quarante cinquante soixante cent mille douzaine "
    "cero dos tres cuatro cinco seis siete ocho nueve diez once doce trece catorce quince veinte treinta cuarenta cincuenta cien ciento mil docena".split()
) - {"cent"}  # a coin, too
NUMBER = re.compile(r"[$€£+-]?\d[\d.,:/]*(?:%|°?[a-zA-Z]{1,4})?")
EDGES = re.compile(r"^[^\w$€£%°+-]+|[^\w%°$€£]+$|^-+$")
#: Marks that end a sentence.
ENDS = frozenset(".!?:;…")
#: Bytes (about) of words held by the cache of a worker before it starts anew.
CACHE_BYTES = 32 << 20
#: Bytes of text (about) whose words are read as one array. Windows cross the parts of a longer text.
PIECE_BYTES = 512 << 10
#: Bytes of a word that are hashed by whole arrays; longer words one by one.
WORD_BYTES = 32
BASE = np.uint64(0x9E3779B97F4A7C15)
#: Tells hashes of values from those of templates.
VERBATIM = np.uint64(0x5A5A5A5A5A5A5A5A)
NUM, UNIT, NAME = "\0number", "\0unit", "\0name"
#: Bits of the filter: so many for each window of the benchmark, between 2 to the power of the one and of the other.
BITS_EACH, LEAST_BITS, MOST_BITS = 256, 16, 28
#: Places of the filter that a window sets.
PROBES = 4
#: Items that one document is checked against at a time.
LOT = 256


def _hash(word: str) -> int:
    return xxhash.xxh64_intdigest(word, 11)


SLOTS = np.array([0, _hash(NUM), _hash(UNIT), _hash(NAME)], np.uint64)


def _marked(characters: str) -> np.ndarray:
    """Whether each byte is one of these ASCII characters."""
    out = np.zeros(256, bool)
    out[list(characters.encode())] = True
    return out


#: White space as str.split() knows it: of one byte, and the codes of those of two and of three, which these bytes begin.
SPACES = [chr(i).encode() for i in range(0x3001) if chr(i).isspace()]
SPACE = _marked("".join(x.decode() for x in SPACES if len(x) == 1))
SPACE_2, SPACE_3 = (np.array([int.from_bytes(x, "big") for x in SPACES if len(x) == n], np.int64) for n in (2, 3))
BORDER = re.compile(rb"[%b]" % b"".join(x for x in SPACES if len(x) == 1))
LEADS = np.isin(np.arange(256), [x[0] for x in SPACES if len(x) > 1])
STRIPPED, LETTER, ENDS_1 = _marked(".,;:!?"), _marked("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"), _marked(".!?:;")
LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)
#: By length of what is left of a word, the bits of its next eight bytes.
LEFT = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def _hashed(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Hash of the first WORD_BYTES bytes of each word; seven bytes at least follow the last word."""
    eight = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    out = length.astype(np.uint64) * BASE
    at, left = slice(None), length
    for k in range(0, WORD_BYTES, 8):
        if k:
            at = np.flatnonzero(length > k)
            left = length[at] - k
        h = (out[at] ^ (eight[start[at] + k] & LEFT[np.minimum(left, 8)])) * np.uint64(0xBF58476D1CE4E5B9)
        out[at] = h ^ (h >> np.uint64(32))
    return out


def spelled(cores: list[str]) -> np.ndarray:
    """Hash of each core."""
    raw = [core.encode() for core in cores]
    length = np.fromiter(map(len, raw), np.int64, len(raw))
    out = _hashed(np.frombuffer(b"".join(raw) + bytes(8), np.uint8), np.cumsum(length) - length, length)
    for k in np.flatnonzero(length > WORD_BYTES).tolist():
        out[k] = _hash(cores[k])
    return out


#: Hashes of the plain number words and units in order, their flags, and the first 16 bits of these hashes.
_FLAGGED = sorted(zip(spelled(listed := sorted(NUMBERS | UNITS)).tolist(), [1 if x in NUMBERS else 2 for x in listed], strict=True))
FLAGGED, FLAGGED_AS = np.array([h for h, _ in _FLAGGED], np.uint64), np.array([x for _, x in _FLAGGED], np.uint8)
FLAGGED_16 = np.zeros(1 << 16, bool)
FLAGGED_16[(FLAGGED >> np.uint64(48)).astype(np.int64)] = True


class Words:
    """What the worker knows about each word: core, and flags: number 1, unit 2, capital 4, ends a sentence 8, no core 16."""

    def __init__(self):
        self.index: dict[str, int] = {}
        self.cores: list[str] = []
        self.held = 0
        self.hashes = np.zeros(1024, np.uint64)
        self.flags = np.zeros(1024, np.uint8)

    def places(self, words: list[str]) -> np.ndarray:
        if self.held > CACHE_BYTES:
            self.__init__()
        new = []
        for word in set(words).difference(self.index):
            core = word.rstrip(".,;:!?")
            plain = core.isalpha()  # most words: nothing else to strip, and no number
            if not plain:
                core = EDGES.sub("", word)
            lower = core.lower()
            last = word[-1] if plain else word.rstrip("\"')]»”’")[-1:]
            flags = 8 * (last in ENDS)
            if not plain and not any(map(str.isalnum, core)) and core not in UNITS:
                flags |= 16
            elif lower in NUMBERS or (not plain and NUMBER.fullmatch(core)):
                flags |= 1
            else:
                flags |= 2 * (lower in UNITS) | 4 * core[0].isupper()
            self.index[word] = len(self.cores)
            self.cores.append(lower)
            self.held += 300 + 8 * len(word)
            new.append(flags)
        if new:
            n = len(self.cores)
            if n > len(self.flags):
                self.hashes, self.flags = np.resize(self.hashes, 2 * n), np.resize(self.flags, 2 * n)
            self.hashes[n - len(new) : n], self.flags[n - len(new) : n] = spelled(self.cores[n - len(new) :]), new
        return np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))

    def template(self, text: str) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
        """The place of each template word; by template its kind (0 plain, 1 number, 2 unit, 3 name) and its hash; and whether
        it begins a sentence. In the second template a capitalised word that begins a sentence is a name."""
        at = self.places(text.split())
        flags = self.flags[at]
        begins = np.ones(len(at), bool)
        begins[1:] = flags[:-1] & 8 > 0
        keep = (flags & 16) == 0
        at, begins = at[keep], begins[keep]
        return at, _both(self.hashes[at], flags[keep], begins, np.zeros(1, np.int64)), begins

    def templates(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]], np.ndarray, np.ndarray]:
        """Of the template words of all these texts, one text after the other: the text and the hash; the templates as those
        of one text; whether it begins a sentence; and, with one place more, whether a sentence or text ends before it.

        Words of Latin letters (of ASCII and Latin-1) with no signs but a few after them are read as arrays, others as above.
        """
        joined, at, parts = b"\n".join(texts), 0, []
        while at < len(joined):  # a long text is read in parts that end at white space
            border = BORDER.search(joined, at + PIECE_BYTES)
            stop = border.start() if border else len(joined)
            start, *part = self.read(b"\n" + joined[at:stop] + b"\n" * 8)
            parts.append((start + (at - 1), *part))
            at = stop
        start, hashes, flags = map(np.concatenate, zip(*parts, strict=True)) if parts else (np.zeros(0, t) for t in (np.int64, np.uint64, np.uint8))
        del joined, parts
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        first = np.searchsorted(start, np.cumsum(sizes) - sizes)
        text = np.repeat(np.arange(len(texts)), np.diff(first, append=len(start)))
        begins = np.ones(len(start), bool)
        begins[1:] = (flags[:-1] & 8 > 0) | (text[1:] != text[:-1])
        keep = (flags & 16) == 0
        hashes, flags, begins, text = hashes[keep], flags[keep], begins[keep], text[keep]
        first = np.flatnonzero(np.diff(text, prepend=-1))
        ends = np.append(begins, True)
        ends[first] = True
        return text, hashes, _both(hashes, flags, begins, first), begins, ends

    def read(self, raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where the words of `raw` begin, their hashes and flags; a line feed comes first, and eight last."""
        data = np.frombuffer(raw, np.uint8)
        space = SPACE[data]
        at = np.flatnonzero(LEADS[data])
        if len(at):
            code = data[at].astype(np.int64) << 8 | data[at + 1]
            two, three = np.isin(code, SPACE_2), np.isin(code << 8 | data[at + 2], SPACE_3)
            either = at[two | three]
            space[either] = space[either + 1] = space[at[three] + 2] = True
        edges = np.flatnonzero(space[1:] != space[:-1]) + 1
        start, end = edges[::2], edges[1::2]
        stop, some = end.copy(), np.arange(len(end))
        for _ in range(3):  # words with more signs are no plain ones
            some = some[STRIPPED[data[stop[some] - 1]] & (stop[some] > start[some])]
            stop[some] -= 1
        other, low = ~LETTER[data], LOWER[data]
        at = np.flatnonzero(data == 0xC3) + 1  # second bytes of Latin-1 letters and two signs
        at = at[(data[at] != 0x97) & (data[at] != 0xB7)]
        other[at] = other[at - 1] = False
        low[at[data[at] != 0x9F]] |= np.uint8(0x20)  # ß has no capital
        others = np.cumsum(other, dtype=np.int32)  # a word never begins at place 0
        length = stop - start
        plain = (others[stop - 1] == others[start - 1]) & (length > 0) & (length <= WORD_BYTES)
        length = np.where(plain, length, 1)
        hashes = _hashed(low, start, length)
        flags = 8 * ENDS_1[data[end - 1]].astype(np.uint8)
        flags[(low[start] != data[start]) | ((data[start] == 0xC3) & (low[start + 1] != data[start + 1]))] |= np.uint8(4)
        some = np.flatnonzero(FLAGGED_16[(hashes >> np.uint64(48)).astype(np.int64)])
        place = np.minimum(np.searchsorted(FLAGGED, hashes[some]), len(FLAGGED) - 1)
        found = FLAGGED[place] == hashes[some]
        some, found = some[found], FLAGGED_AS[place[found]]
        flags[some] = np.where(found == 1, flags[some] & 8 | 1, flags[some] | 2)
        rest = np.flatnonzero(~plain)
        at = self.places([raw[a:z].decode() for a, z in zip(start[rest].tolist(), end[rest].tolist(), strict=True)])
        hashes[rest], flags[rest] = self.hashes[at], self.flags[at]
        return start, hashes, flags


def _both(hashes: np.ndarray, flags: np.ndarray, begins: np.ndarray, first: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Kinds and hashes by template; texts have their first words at `first`."""
    after = np.zeros(len(flags), bool)
    after[1:] = flags[:-1] & 1 > 0
    after[first[: len(after)]] = False
    both = []
    for names in ((flags & 4 > 0) & ~begins, flags & 4 > 0):
        kind = np.zeros(len(flags), np.uint8)
        kind[names] = 3
        kind[(flags & 2 > 0) & after] = 2
        kind[flags & 1 > 0] = 1
        both.append((kind, np.where(kind == 0, hashes, SLOTS[kind])))
    return both


def needed(n: int, window: int, literals: int) -> int:
    """Words that must be equal and no numbers in a window of n words with an exchanged slot."""
    return max(1, min(literals, n) if n == window else literals * n // window)


def looked_up(template: tuple, values: np.ndarray, begins: np.ndarray, n: int, need: int, least: int) -> np.ndarray:
    """The hashes under which the windows of n words of one template are looked up: those of the template, or of the
    values where a window can only match verbatim. Of windows under `least` words those that are whole sentences."""
    return _looked_up(template, values, begins, np.append(begins, True), n, need, least)[1]


def _looked_up(template: tuple, values: np.ndarray, begins: np.ndarray, ends: np.ndarray, n: int, need: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of these windows, and their hashes; of several texts in one array, windows across their borders too."""
    kind, hashes = template
    if n < least:
        at = np.flatnonzero(begins[: max(0, len(begins) - n + 1)] & ends[n:])
        return at, _windows_at(values, at, n)
    out = windows(hashes, n)
    numbers = kind == 1
    if np.count_nonzero(numbers) >= n - need + 2:
        total = np.concatenate(([0], np.cumsum(numbers)))
        few = np.flatnonzero(total[n:] - total[:-n] >= n - need + 2)  # at best need - 2 words that are no numbers, and one for names
        out[few] = _windows_at(values, few, n)
    return np.arange(len(out)), out


def _windows_at(values: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    return windows(values[at[:, None] + np.arange(n)].ravel(), n)[::n] ^ VERBATIM if len(at) else np.zeros(0, np.uint64)


def windows(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n template words."""
    out = np.full(max(0, len(hashes) - n + 1), n, np.uint64)
    run, size, k, base = hashes, 1, 0, BASE  # hashes of runs of 1, 2, 4, ... words, and BASE ** size
    with np.errstate(over="ignore"):
        while len(out):
            if n & size:
                out = out * base + run[k : k + len(out)]
                k += size
            if (size := 2 * size) > n:
                break
            run, base = run[: -size // 2] * base + run[size // 2 :], base * base
    out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


class Filter:
    """A Bloom filter of window hashes."""

    def __init__(self, bits: int, words: np.ndarray):
        self.bits, self.words = bits, words

    @staticmethod
    def places(hashes: np.ndarray, bits: int, probe: int) -> np.ndarray:
        return ((hashes >> np.uint64(9 * probe)) * BASE) >> np.uint64(64 - bits)

    def hits(self, hashes: np.ndarray) -> np.ndarray:
        """Places of the hashes that may be in the benchmark."""
        at = np.arange(len(hashes))
        for probe in range(PROBES):
            place = self.places(hashes[at], self.bits, probe)
            at = at[(self.words[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) > 0]
            if not len(at):
                break
        return at


def found_in(texts: list[bytes], words: Words, known: Filter, sizes: Iterable[int], window: int, literals: int, least: int) -> dict[int, np.ndarray]:
    """By place in `texts` the hashes of windows of these sizes that may be in the benchmark, where there are any."""
    text, values, both, begins, ends = words.templates(texts)
    at, got = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for n in sizes:
        for x in both[: 1 if n < least else 2]:
            place, h = _looked_up(x, values, begins, ends, n, needed(n, window, literals), least)
            hit = known.hits(h)
            hit = hit[text[place[hit]] == text[place[hit] + n - 1]]
            at.append(text[place[hit]])
            got.append(h[hit])
    at, got = np.concatenate(at), np.concatenate(got)
    return {k: np.unique(got[at == k]) for k in np.unique(at).tolist()}


class Text:
    """The template words of a text: their ids in `known`, and by template the kinds and hashes."""

    def __init__(self, text: str, words: Words, known: dict[str, int]):
        place, self.both, self.begins = words.template(text)
        cores = words.cores
        self.ids = np.array([known.setdefault(cores[p], len(known)) for p in place.tolist()], np.int64)

    def __len__(self) -> int:
        return len(self.ids)


def _consistent(kind: np.ndarray, a: np.ndarray, b: np.ndarray) -> bool:
    """Whether one value stands for one other throughout, by kind of slot, in both directions."""
    slots = kind > 0
    pairs = set(zip(kind[slots].tolist(), a[slots].tolist(), b[slots].tolist(), strict=True))
    return len({x[:2] for x in pairs}) == len({x[::2] for x in pairs}) == len(pairs)


def compare(doc: Text, item: Text, window: int, literals: int, least: int = 5) -> tuple[int, int]:
    """(windows of the item that match one of the document, those of them with an exchanged slot)."""
    n = min(window, len(item))
    if not n:
        return 0, 0
    short, ends = n < least, np.append(doc.begins, True)
    seen: dict[tuple[int, int], bool] = {}  # by places in document and item: whether a slot is exchanged
    need = needed(n, window, literals)
    plain_item = item.both[0][0]
    for item_kind, item_hashes in item.both:
        own = defaultdict(list)
        for j, h in enumerate(windows(item_hashes, n).tolist()):
            own[h].append(j)
        keys = np.array(sorted(own), np.uint64)
        for kind, hashes in doc.both:
            got = windows(hashes, n)
            at = np.minimum(np.searchsorted(keys, got), len(keys) - 1)
            places = np.flatnonzero(keys[at] == got)
            by_offset = defaultdict(list)
            for i in places.tolist():
                for j in own[int(got[i])]:
                    by_offset[i - j].append(j)
            for offset, js in by_offset.items():
                js = np.unique(js)
                for run in np.split(js, np.flatnonzero(np.diff(js) > 1) + 1):
                    a, z = int(run[0]), int(run[-1]) + n
                    x, y = item.ids[a:z], doc.ids[a + offset : z + offset]
                    kinds = item_kind[a:z]
                    differs = x != y
                    if (kinds != kind[a + offset : z + offset]).any() or (differs & (kinds == 0)).any():
                        continue  # hashes that meet by chance
                    same = ~differs & (kinds != 1)
                    begins = plain_item[a:z] != kinds
                    consistent = _consistent(kinds, x, y) if differs.any() else True
                    for j in run.tolist():
                        part = slice(j - a, j - a + n)
                        changed = bool(differs[part].any())
                        if short and (changed or not (doc.begins[j + offset] and ends[j + offset + n])):
                            continue
                        if changed and not (consistent and int(same[part].sum()) + (int((begins & differs)[part].sum()) > 1) >= need):
                            continue
                        key = j + offset, j
                        seen[key] = changed and seen.get(key, True)
    return len(seen), sum(seen.values())


def _keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(df[id_col].alias("id"), df[text_col].alias("text")).where(F.col("text").isNotNull()).withColumn("th", F.xxhash64("text"))


def matches(
    docs: DataFrame, benchmark: DataFrame, *, window: int = 8, literals: int = 5, least: int = 5,
    id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """(id, th, item, n_windows, n_changed) of each document and item that share a window; th is the hash of the text."""
    spark = docs.sparkSession
    c.tune(spark)
    items = benchmark.select(benchmark[item_col].alias("item"), benchmark[item_text_col].alias("text")).where(F.col("text").isNotNull()).distinct()
    items, _ = c.saved(items.withColumn("key", F.xxhash64("item", "text")), "bench-items")

    def item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for b in batches:
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                at, both, begins = words.template(text)
                n = min(window, len(at))
                if n:
                    # a short item is looked for as it is, whatever its own sentences are
                    begins = begins if n >= least else np.ones(n, bool)
                    h = np.unique(np.concatenate([looked_up(x, words.hashes[at], begins, n, needed(n, window, literals), least) for x in both]))
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.full(len(h), n, np.int32)), pa.array(np.full(len(h), key))], ["h", "n", "key"])

    own, _ = c.saved(items.select("key", "text").mapInArrow(item_windows, "h long, n int, key long"), "bench-windows")
    sizes = {r["n"]: r["count"] for r in own.groupBy("n").count().collect()}
    bits = min(MOST_BITS, max(LEAST_BITS, int(BITS_EACH * sum(sizes.values())).bit_length()))

    def filter_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            place = np.concatenate([Filter.places(h, bits, probe) for probe in range(PROBES)])
            bit = (np.uint64(1) << (place & np.uint64(63))).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array((place >> np.uint64(6)).astype(np.int64)), pa.array(bit)], ["word", "bit"])

    filled = np.zeros(1 << (bits - 6), np.uint64)
    rows = own.select("h").mapInArrow(filter_words, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bits"))
    for r in rows.toLocalIterator():  # of a filter of 2 ** MOST_BITS bits at most
        filled[r["word"]] = np.int64(r["bits"]).view(np.uint64)
    sent = spark.sparkContext.broadcast((bits, filled))
    one = c.spread(_keyed(docs, id_col, text_col))
    kind, id_type = one.schema["id"].dataType.simpleString(), to_arrow_type(one.schema["id"].dataType)
    item_kind, item_type = items.schema["item"].dataType.simpleString(), to_arrow_type(items.schema["item"].dataType)

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, known = Words(), Filter(*sent.value)
        for b in c.pieces_of(batches, "text", PIECE_BYTES):
            found = found_in(b.column(1).cast(pa.binary()).to_pylist(), words, known, sizes, window, literals, least)
            if found:
                columns = [*(col.take(pa.array(list(found))) for col in b.columns), pa.array([x.view(np.int64) for x in found.values()], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, ["id", "text", "th", "hs"])

    held, _ = c.saved(one.select("id", "text", "th").mapInArrow(hits, f"id {kind}, text string, th long, hs array<long>"), "bench-hits")
    pairs = held.select("id", "th", F.explode("hs").alias("h")).join(own.select("h", "key"), "h").select("id", "th", "key").distinct()
    lot = F.floor((F.row_number().over(Window.partitionBy("id", "th").orderBy("key")) - 1) / LOT)
    lists = pairs.withColumn("lot", lot).join(items.select("key", "item", F.col("text").alias("item_text")), "key")
    lists = lists.groupBy("id", "th", "lot").agg(F.collect_list(F.struct("item", "item_text")).alias("items"))
    texts = held.select("id", "text", "th").dropDuplicates(["id", "th"])
    joined = texts.join(lists, texts["id"].eqNullSafe(lists["id"]) & (texts["th"] == lists["th"])).select(texts["id"], texts["th"], "text", "items")

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for b in batches:
            out = []
            for key, th, text, asked in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                known: dict[str, int] = {}
                doc = Text(text, words, known)
                for x in asked:
                    total, changed = compare(doc, Text(x["item_text"], words, known), window, literals, least)
                    if total:
                        out.append((key, th, x["item"], total, changed))
            if out:
                columns = zip(zip(*out, strict=True), (id_type, pa.int64(), item_type, pa.int64(), pa.int64()), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in columns], ["id", "th", "item", "n_windows", "n_changed"])

    found = joined.mapInArrow(checked, f"id {kind}, th long, item {item_kind}, n_windows long, n_changed long")
    return found.groupBy("id", "th", "item").agg(F.sum("n_windows").alias("n_windows"), F.sum("n_changed").alias("n_changed"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """The rows of docs that match no item."""
    found = matches(docs, benchmark, id_col=id_col, text_col=text_col, **settings)
    found, _ = c.saved(found.select(F.col("id").alias("matched_id"), F.col("th").alias("matched_th")).distinct(), "bench-found")
    return docs.join(found, docs[id_col].eqNullSafe(found["matched_id"]) & (F.xxhash64(docs[text_col]) == found["matched_th"]), "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per contaminated document: the items that it holds."""
    found = matches(c.table(spark, sf_dir, "documents"), c.table(spark, sf_dir, "benchmark"))
    return found.groupBy(F.col("id").alias("doc_id")).agg(
        F.lit(True).alias("contaminated"), F.sort_array(F.collect_set("item")).alias("item_ids"), F.sum("n_windows").alias("n_windows"), F.sum("n_changed").alias("n_changed")
    )
