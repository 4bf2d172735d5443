"""The registered queries of the text operators, and the pipeline, on the driver's small tables."""

import hashlib
import itertools
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from oracle import same  # noqa: E402

sys.path.insert(0, str(Path(__file__).resolve().parent))
import corpus_pipeline  # noqa: E402
from shiftframe.llm import decontamination, quality, queries  # noqa: E402
from test_operators import REFERENCE, slow_score  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(spark, name):
    same(queries.queries()[name], queries.oracle_sql()[name], spark, SF)


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.oracle_sql())))
def test_query_runs(spark, name):
    assert queries.queries()[name](spark, SF).count() > 0


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, seen, SF).cache()
        assert out.columns == docs.columns, name
        assert out.join(seen, "doc_id", "left_anti").count() == 0 and 0 < out.count() <= seen.count(), name
        seen = out


def slow_lines(rows):
    """Texts without later occurrences of three lines, by document and place."""
    seen, out = set(), []
    for r in sorted(rows, key=lambda r: r["doc_id"]):
        if r["text"] is None:
            out.append(r)
            continue
        lines = r["text"].split("\n")
        gone = set()
        for k in range(len(lines) - 2):
            own = tuple(lines[k : k + 3])
            if own in seen:
                gone.update((k, k + 1, k + 2))
            seen.add(own)
        out.append({**r, "text": "\n".join(x for k, x in enumerate(lines) if k not in gone)})
    return out


def slow_one_of_similar(rows):
    """The least id of each component of pairs with a cosine of 0.8 or more, over all pairs."""
    sets = {}
    for r in rows:
        own = (r["text"] or "").encode().lower().split()
        sets[r["doc_id"]] = {b" ".join(own[i : i + 5]) for i in range(max(1, len(own) - 4))} if own else set()
    at = {i: i for i in sets}
    for i, j in itertools.combinations(sorted(sets), 2):
        a, b = sets[i], sets[j]
        if at[i] != at[j] and (a == b or 25 * len(a & b) ** 2 >= 16 * len(a) * len(b) > 0):
            old, new = max(at[i], at[j]), min(at[i], at[j])
            at = {k: new if v == old else v for k, v in at.items()}
    return [r for r in rows if at[r["doc_id"]] == r["doc_id"]]


def test_pipeline_equals_a_slow_version(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{x}.parquet") for x in ("documents", "labels"))
    model = quality.fit(docs, labels)
    rows = [r.asDict() for r in docs.collect()]
    rows = [r for r in rows if slow_score(model, r["text"], r["source"], r["lang"], r["n_chars"]) >= 0.5]
    rows = slow_one_of_similar(slow_lines(rows))
    words, items = decontamination.Words(), [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]

    def clean(text):
        known: dict[str, int] = {}
        own = decontamination.Text(text or "", words, known)
        there = [decontamination.Text(x, words, known) for x in items if x]
        return not any(decontamination.compare(own, x, 8, 5)[0] for x in there)

    rows = [r for r in rows if clean(r["text"])]
    want = set()
    for r in rows:
        ids = REFERENCE.encode_ordinary(r["text"] or "")
        want.add((r["doc_id"], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest()))
    got = corpus_pipeline.run(spark, SF).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want and 20 < len(want) < docs.count()


def test_stages_on_odd_tables(spark):
    """Nulls everywhere, rows twice, one id with two texts, extra columns whose names clash, and no rows at all."""
    base = "one line here\nand a second one\nthen the third\nand the last of them"
    rows = [(1, base, "en", "web", 5), (1, base, "en", "web", 5), (1, "another text under this number, quite short", None, None, None), (None, None, None, None, None), (None, "", "en", "web", 0), (2, base + " more", "en", "web", 9), (3, "x " * 60_000, "en", "web", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.selectExpr("*", "7 AS n_lines", "8 AS n_removed", "'i' AS id", "1 AS th", "2 AS fp", "3 AS score", "array(1) AS items")
    for name, stage in corpus_pipeline.STAGES:
        some, none = stage(spark, docs, SF), stage(spark, docs.where("doc_id < 0"), SF)
        assert none.count() == 0, name
        found = some.collect()
        assert found and len(found) <= len(rows), name
        if stage is not corpus_pipeline.STAGES[-1][1]:
            assert some.columns == docs.columns and none.columns == docs.columns, name
            assert all(r["n_lines"] == 7 and r["n_removed"] == 8 and r["id"] == "i" for r in found), name
    kept = corpus_pipeline.STAGES[2][1](spark, docs, SF).collect()
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in kept) == sorted([(0, ""), (1, base), (1, rows[2][1]), (3, rows[6][1])])  # the second differs by one of 13 shingles
