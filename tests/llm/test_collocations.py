"""Phrase collocations against a plain count of all phrases."""

import collections
import random
import re
import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shiftframe.llm import collocations

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def slow(rows, least, most=2000, percent=80):
    f, n = collections.Counter(), collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\n\v\f\r]", (text or "").translate(LOWER)):
            words = re.findall(r"[^ \t]+", piece)
            n[lang] += len(words)
            f.update((lang, tuple(words[i : i + k])) for k in range(1, 5) for i in range(len(words) - k + 1))
    found = [(lang, p, a) for (lang, p), a in f.items() if a >= least and len(p) > 1]
    longest = collections.Counter()
    for lang, p, a in found:
        for k in range(2, len(p)):
            for i in range(len(p) - k + 1):
                longest[lang, p[i : i + k]] = max(longest[lang, p[i : i + k]], a)
    out = []
    for lang in {x[0] for x in found}:
        own = []
        for at, p, a in found:
            if at == lang and not (longest[at, p] and 100 * longest[at, p] >= percent * a):
                score, _, l, r = min((2_000_000 * a // (f[at, p[:k]] + f[at, p[k:]]), k, f[at, p[:k]], f[at, p[k:]]) for k in range(1, len(p)))
                own.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, k, p.decode(), -a, l, r, n[lang], -s) for k, (s, a, p, l, r) in enumerate(sorted(own)[:most], 1)]
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    words = "Of the house River stone ä é1 日本 a-b x 'tis".split()
    made = [(" ".join(rng.choice(words) + rng.choice(["", "", "", ".", ", ", "\n", "\t", "  "]) for _ in range(rng.randint(0, 40))), rng.choice(["en", "en", "en", "de", None, "und"])) for _ in range(300)]
    line = ("every row has this very long line of words in it", "en")
    hot = [(f"hot pair w{k} and x{k % 7}", "en") for k in range(400)]  # one prefix with ever other words behind it
    return [*made, *[line] * 50, *hot, (None, "en"), ("", None), (". , ;", "de"), ("the house " * 5000, "fr"), (None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, "text string, lang string").selectExpr("*", "1 AS n", "'x' AS phrase", "2 AS k", "CAST(NULL AS LONG) AS doc_id").repartition(7).cache()


@pytest.mark.parametrize(("least", "bits", "splits", "most"), [(3, 24, 1024, 2000), (30, 4, 2, 5), (2, 6, 8, 40), (300, 20, 100, 2000)])
def test_collocations_equal_a_plain_count(docs, rows, least, bits, splits, most):
    """Also with so few counters that nothing is pruned, with hot prefixes split, and with ties at the cut."""
    got = collocations.collocations(docs, least=least, bits=bits, splits=splits, most=most).collect()
    want = slow(rows, least, most)
    assert sorted(map(tuple, got)) == sorted(want) and want


def test_small_buffers_give_the_same(docs, rows, monkeypatch):
    monkeypatch.setattr(collocations, "MOST_WORDS", 5)
    monkeypatch.setattr(collocations, "MOST_POINTERS", 5)
    assert sorted(map(tuple, collocations.collocations(docs, least=4).collect())) == sorted(slow(rows, 4))


def test_words_and_pointers_are_summed_up_and_kept(docs, rows, monkeypatch):
    """Buffers that fill up often, but whose sums go on into the next stretch of text."""
    monkeypatch.setattr(collocations, "MOST_WORDS", 1500)
    monkeypatch.setattr(collocations, "MOST_POINTERS", 2500)
    assert sorted(map(tuple, collocations.collocations(docs, least=4).collect())) == sorted(slow(rows, 4))


def test_pointers_do_not_grow_with_the_partitions(spark, docs, monkeypatch):
    """One row a core for each pointer, of however many parts and stretches of text."""
    monkeypatch.setattr(collocations, "MOST_POINTERS", 4000)
    all_ = np.full(1 << 13, 255, np.uint8)
    own = docs.select("lang", "text").where("lang = 'en' AND text LIKE 'every row%'").withColumn("copies", F.explode(F.sequence(F.lit(1), F.lit(60)))).drop("copies")
    found = collocations._pointers(own.repartition(40), all_, np.concatenate((all_, all_)), 16).collect()
    places = collections.Counter()
    for row in found:
        places[row[1:5]] += row["n"]
    assert len(places) == 10 and set(places.values()) == {3000}
    assert len(found) <= 10 * spark.sparkContext.defaultParallelism


def test_rare_words_are_not_passed_on(spark):
    """Most different words are rare: no task gives a row for each of them."""
    own = spark.range(20_000).selectExpr("'en' AS lang", "concat('rare', id, ' and Common ', 'x', id % 50) AS text").repartition(3)
    counted = collocations._count(own, 30, 20)
    assert counted.where("chunk IS NULL").count() <= spark.sparkContext.defaultParallelism
    longer = collocations._count_longer(own, collocations._frequent(counted, 30, 1 << 20), 30, 20)
    found = dict(longer.where("chunk IS NULL").groupBy("word").agg(F.sum("n")).collect())
    assert found["and"] == found["common"] == 20_000 and all(found[f"x{k}"] == 400 for k in range(50)) and len(found) < 200
    words, totals = collocations.phrases(own)
    assert words.where("k = 1").count() == 52 and [tuple(x) for x in totals.collect()] == [("en", 80_000)]


@pytest.mark.parametrize("step", [1, 2, 3])
def test_a_task_forgets_rare_words(monkeypatch, step):
    """A million of them took 127 MB and more in each of the passes."""
    docs = SimpleNamespace(mapInArrow=lambda run, schema: run, sparkSession=SimpleNamespace(sparkContext=SimpleNamespace(broadcast=lambda x: SimpleNamespace(value=x))))
    monkeypatch.setattr(collocations, "_a_core", lambda docs: docs)
    none, common = np.zeros(1 << 13, np.uint8), " ".join(["of the"] * 500)
    run = [lambda: collocations._count(docs, 30, 16), lambda: collocations._count_longer(docs, none, 30, 16), lambda: collocations._pointers(docs, none, np.tile(none, 2), 16)][step - 1]()
    batches = (pa.RecordBatch.from_pydict({"lang": ["en"] * 20, "text": [f"{common} " + " ".join(f"w{k}" for k in range(at + 500 * j, at + 500 * j + 500)) for j in range(20)]}) for at in range(0, 1_000_000, 10_000))
    tracemalloc.start()
    try:
        list(run(batches))
        assert tracemalloc.get_traced_memory()[1] < 80e6
    finally:
        tracemalloc.stop()


def test_counters_grow_with_the_text(docs, monkeypatch):
    """Within bounds, so that they don't all fill up and let everything pass."""
    monkeypatch.setattr(collocations, "FEWEST_BITS", 4)
    own = docs.select("text")
    small = collocations._bits(own)
    assert 4 < small == collocations._bits(own.unionAll(own).unionAll(own).unionAll(own)) - 2
    monkeypatch.setattr(collocations, "MOST_BITS", small - 1)
    assert collocations._bits(own) == small - 1 and collocations._bits(own.limit(0)) == 4


def test_full_counters_are_told_by_their_bits():
    full = np.random.default_rng(2).random(4096) < 0.5
    slots = np.random.default_rng(3).integers(0, 4096, 9999)
    assert (collocations._full(np.packbits(full), slots) == full[slots]).all()


def test_runs_are_looked_up_by_two_hashes(docs):
    """With a tenth of the counters full by chance, a hundredth of the runs that aren't frequent is taken for frequent, not a tenth."""
    own = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").cache()
    pairs = collocations._frequent(collocations._count(own, 4, 16), 4, 1 << 16)
    longer = collocations._frequent(collocations._count_longer(own, pairs, 4, 16), 4, 2 << 16)

    def false_runs(noise):
        full = longer | np.packbits(np.concatenate((noise, np.zeros(1 << 16, bool))))
        found = collocations._pointers(own, pairs, full, 16).where("w3 IS NOT NULL").groupBy("lang", "w1", "w2", "w3").agg(F.sum("n").alias("f"))
        return found.where("f < 4").count()

    most = false_runs(np.ones(1 << 16, bool))
    assert most > 200 and false_runs(np.random.default_rng(1).random(1 << 16) < 0.1) < 0.05 * most


def test_growth_goes_on_over_batches(spark, docs, rows):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert sorted(map(tuple, collocations.collocations(docs, least=3).collect())) == sorted(slow(rows, 3))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_an_empty_table(docs):
    assert collocations.collocations(docs.where("k < 0")).count() == 0


def test_scores_of_large_counts_are_exact(spark):
    """2000000 a passes 64 bits."""
    row = spark.sql("SELECT CAST(2000000 AS DECIMAL(8,0)) * CAST(9000000000000000000 AS DECIMAL(20,0)) AS wa, CAST(CAST(9000000000000000001 AS DECIMAL(38,0)) + CAST(9100000000000000001 AS DECIMAL(38,0)) AS DECIMAL(21,0)) AS wb").selectExpr("wa div wb AS q").first()
    assert row["q"] == 2_000_000 * 9_000_000_000_000_000_000 // 18_100_000_000_000_000_002
