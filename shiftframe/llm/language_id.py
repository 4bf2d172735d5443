"""Language identification by words first, backing off to ever shorter character n-grams.

A known word scores its log frequency in each language. An unseen word scores by its character n-grams of the longest
length of which any is known, each of them with its log frequency in each language, averaged; if none of that length
is known, by the next shorter length, down to single characters. A text's score for a language is the mean over its
words, times the number of words; prediction is the best language, the smallest name on ties, and the score its
posterior probability with equal priors.

The model is fitted on a bounded sample of labelled rows (`sample` rows, those with the smallest hash of their id; an
equal share for each language as far as it goes, and one row at least) and holds at most `most_words` words and
`most_grams` n-grams of each length: the most frequent ones of each language in turn, counted over all words of the
sample. So what goes to the executors is bounded by these numbers and the number of languages, all of which are known.

Null texts and texts without a letter are `und` with score 0. Whole texts are scored. Rows with null lang or text are
not learned from; without any learned row everything is `und`. Repeated rows get equal results; only the named
columns are read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _common as c

#: Lengths of n-grams, the longest first.
LENGTHS = (5, 4, 3, 2, 1)
#: Bytes (about) of words and their scores held by the cache of a worker before it starts anew.
CACHE_BYTES = 48 << 20
#: Parts of each language's ids that are ranked apart before the sample is drawn.
SALTS = 64
LETTERS = regex.compile(r"\p{L}+")
#: Runs of letters, and of numerals that are no digits; what is not all letters is cut again by LETTERS.
NEARLY = re.compile(r"[^\W\d_]+")


def letter_words(text: str) -> Counter[str]:
    """The runs of letters of a text, in lower case, with their number."""
    found = Counter(NEARLY.findall(text.lower()))
    for odd in [w for w in found if not w.isalpha()]:
        n = found.pop(odd)
        for word in LETTERS.findall(odd):
            found[word] += n
    return found


def _grams(word: str, n: int) -> list[str]:
    framed = f"^{word}$" if n > 1 else word
    return [framed[i : i + n] for i in range(len(framed) - n + 1)]


class Model:
    """Per-language log frequencies of words and of n-grams."""

    def __init__(self, langs: list[str], words: dict[str, list[float]], grams: list[dict[str, list[float]]]):
        self.langs = langs
        self.words, self.grams = words, grams
        self.index: dict[str, int] = {}
        self.held = 0
        self.rows = np.zeros((1024, max(1, len(langs))))

    @classmethod
    def fit(cls, counts: list[tuple[str, str, int]], most_words: int, most_grams: int) -> Model:
        """counts: (lang, word, occurrences)."""
        langs = sorted({x for x, _, _ in counts})
        place = {x: i for i, x in enumerate(langs)}

        def logs(parts: Callable[[str], list[str]], most: int, least: int) -> dict[str, list[float]]:
            table: dict[str, list[int]] = {}
            for lang, word, n in counts:
                for x in parts(word):
                    if (row := table.get(x)) is None:
                        row = table[x] = [0] * len(langs)
                    row[place[lang]] += n
            total = np.array(list(table.values()), np.float64).reshape(-1, len(langs)).sum(axis=0)
            top = sorted((x for x, row in table.items() if sum(row) >= least), key=lambda x: (-sum(table[x]), x))[:most]
            size = max(1, len(table))
            return {x: np.log((np.array(table[x]) + 0.5) / (total + 0.5 * size)).tolist() for x in top}

        words = logs(lambda word: [word], most_words, 2)
        return cls(langs, words, [logs(lambda word, n=n: _grams(word, n), most_grams, 1) for n in LENGTHS])

    def score_word(self, word: str) -> list[float]:
        known = self.words.get(word)
        if known is not None:
            return known
        for own, length in zip(self.grams, LENGTHS, strict=True):
            found = [x for g in _grams(word, length) if (x := own.get(g)) is not None]
            if found:
                total = found[0]
                for row in found[1:]:  # some numbers a row: numpy's mean costs ten times as much
                    total = [a + b for a, b in zip(total, row, strict=True)]
                return [a / len(found) for a in total]
        return [0.0] * len(self.langs)

    def _place(self, word: str) -> int:
        """The row of a word that has none yet."""
        at = self.index[word] = len(self.index)
        if at == len(self.rows):
            self.rows = np.concatenate((self.rows, np.zeros_like(self.rows)))
        self.rows[at] = self.score_word(word)
        self.held += 200 + 4 * len(word) + 8 * len(self.langs)
        return at

    def predict(self, text: str | None) -> tuple[str, float]:
        found = letter_words(text) if text else None
        if not found or not self.langs:
            return "und", 0.0
        if self.held > CACHE_BYTES:
            self.index.clear()
            self.held = 0
        places = list(map(self.index.get, found))
        if None in places:
            places = [self._place(word) if at is None else at for word, at in zip(found, places, strict=True)]
        total = np.fromiter(found.values(), np.float64, len(found)) @ self.rows[places]
        best = int(total.argmax())
        return self.langs[best], float(1 / np.exp(np.minimum(total - total[best], 0)).sum())


def _sample(ids: DataFrame, share: int) -> DataFrame:
    """Of each lang the `share` rows with the smallest hash of their id: first in each of a few salts, so that no task holds a language."""
    key = F.xxhash64(F.col("id").cast("string"))
    salted = ids.withColumn("key", key).withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)))
    for by in (["lang", "salt"], ["lang"]):
        rank = F.row_number().over(Window.partitionBy(*by).orderBy("key", "id"))
        salted = salted.withColumn("rank", rank).where(F.col("rank") <= share).drop("rank")
    return salted.select("id")


def _counts(words: DataFrame) -> DataFrame:
    """(kind, lang, part, n) of words (kind 0) and of the n-grams of all words (kind is their length), by the executors."""
    own = words.groupBy("lang", "word").count()

    def grams(n: int) -> Column:
        text = F.concat(F.lit("^"), F.col("word"), F.lit("$")) if n > 1 else F.col("word")
        starts = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.struct(F.lit(n).alias("kind"), F.substring(text, i, F.lit(n)).alias("part")))

    whole = F.array(F.struct(F.lit(0).alias("kind"), F.col("word").alias("part")))
    each = own.select("lang", "count", F.explode(F.concat(whole, *map(grams, LENGTHS))).alias("p"))
    return each.groupBy("p.kind", "lang", "p.part").agg(F.sum("count").alias("n"))


def fit(docs: DataFrame, *, sample: int = 6000, most_words: int = 20_000, most_grams: int = 20_000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Model of a bounded sample of the labelled rows. Words and n-grams are counted by the executors over all words of
    the sample; the driver gets those that the model keeps, the most frequent ones of each language in turn."""
    spark = docs.sparkSession
    c.tune(spark)
    labelled = docs.where(docs[lang_col].isNotNull() & docs[text_col].isNotNull())
    ids = labelled.select(labelled[id_col].alias("id"), labelled[lang_col].alias("lang"))
    langs = sorted(r[0] for r in ids.select("lang").distinct().collect())
    if not langs:
        return Model([], {}, [{} for _ in LENGTHS])
    picked = F.broadcast(_sample(ids, max(1, sample // len(langs))).distinct())  # at most `sample` ids, or one for each language
    rows = labelled.select(labelled[id_col].alias("id"), labelled[text_col].alias("text"), labelled[lang_col].alias("lang")).join(picked, "id")
    words = rows.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), F.lit(1))).alias("word"))
    counts, path = c.saved(_counts(words), "language-counts")
    totals = {(r["kind"], r["lang"]): r["n"] for r in counts.groupBy("kind", "lang").agg(F.sum("n").alias("n")).collect()}
    place = F.row_number().over(Window.partitionBy("kind", "lang").orderBy(F.desc("n"), "part"))
    parts = counts.withColumn("place", place).groupBy("kind", "part").agg(F.min("place").alias("best"), F.sum("n").alias("total"), F.collect_list(F.struct("lang", "n")).alias("of"))
    parts, parts_path = c.saved(parts, "language-parts")
    sizes = {r[0]: r[1] for r in parts.groupBy("kind").count().collect()}
    at = {x: i for i, x in enumerate(langs)}

    def logs(kind: int, most: int, least: int) -> dict[str, list[float]]:
        top = parts.where((F.col("kind") == kind) & (F.col("total") >= least)).orderBy("best", F.desc("total"), "part").limit(most)
        total = np.array([totals.get((kind, x), 0) for x in langs], np.float64)
        found = {}
        for r in top.collect():
            own = np.zeros(len(langs))
            for lang, n in r["of"]:
                own[at[lang]] = n
            found[r["part"]] = np.log((own + 0.5) / (total + 0.5 * max(1, sizes.get(kind, 0)))).tolist()
        return found

    model = Model(langs, logs(0, most_words, 2), [logs(n, most_grams, 1) for n in LENGTHS])
    c.remove(spark, path, parts_path)
    return model


def predict(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of each row."""
    c.tune(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast((model.langs, model.words, model.grams))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*sent.value)
        for b in batches:
            found = [own.predict(t.as_py()) for t in b.column(1)]
            lang, score = zip(*found, strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["id", "lang_pred", "score"])

    one = c.spread(docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")))
    return one.mapInArrow(run, f"id {one.schema['id'].dataType.simpleString()}, lang_pred string, score double").withColumnRenamed("id", id_col)


def held_out(doc_id: Column) -> Column:
    """True for a quarter of the documents, by the CRC-32 of the id's decimals; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = c.table(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out(F.col("doc_id"))))
    return predict(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
