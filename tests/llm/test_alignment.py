"""Cross-tokenizer alignment against both libraries on whole texts and a plain cut at common offsets."""

import collections
import hashlib
import random

import numpy as np
import public_tokenizers as tok
import pytest
import sentencepiece
import tokenizers

from shiftframe.llm import alignment

A = tokenizers.Tokenizer.from_file(tok.path("byte_bpe_50k.json"))
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=tok.path("piece_bpe_32k.model"))
LETTERS = alignment.byte_of_letter()
PARTS = "the quick brown Fox's jumped, naïve café 12345 $$$ &&& ÄÖÜ 日本語テキスト 🎉🎉 don't <|endoftext|> <s> </s> e.g. http://x.y/z?a=b ▁   \x1c \x85  x \t \n\n  ".split(" ")


def token_bytes(text):
    a, b = A.encode(" " + text, add_special_tokens=False).ids, B.encode(text)
    own = [bytes(LETTERS[x] for x in A.id_to_token(i)) for i in a]
    other = [bytes([int(B.id_to_piece(i)[3:5], 16)]) if B.is_byte(i) else B.id_to_piece(i).replace("▁", " ").encode() for i in b]
    return a, b, own, other


def ends(parts):
    at, out = 0, []
    for x in parts:
        at += len(x)
        out.append(at)
    return out


def slow_groups(text):
    if not text:
        return []
    a, b, own, other = token_bytes(text)
    if not b"".join(own) == b"".join(other) == (" " + text).encode():
        return []
    of_a, of_b, before, groups = ends(own), ends(other), 0, []
    for end in sorted(set(of_a) & set(of_b)):
        groups.append(([x for x, y in zip(a, of_a, strict=True) if before < y <= end], [x for x, y in zip(b, of_b, strict=True) if before < y <= end], end))
        before = end
    return groups


def slow(rows):
    docs, counts = [], collections.Counter()
    for i, text in rows:
        groups = slow_groups(text)
        links = [(x, y) for u, v, _ in groups for x in u for y in v]
        counts.update(set(links))
        docs.append((i, groups, links))
    best = {}
    for (x, _), n in counts.items():
        best[x] = max(best.get(x, 0), n)
    out = []
    for i, groups, links in docs:
        line = ";".join(f"{','.join(map(str, u))}|{','.join(map(str, v))}" for u, v, _ in groups)
        sizes = sum(len(u) for u, _, _ in groups), sum(len(v) for _, v, _ in groups), len(groups), len(links)
        out.append((i, *sizes, sum(counts[x] == best[x[0]] for x in links), sum(counts[x] for x in links), hashlib.sha256(line.encode()).hexdigest() if groups else ""))
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    odd = [None, "", " ", "  ", "foo ", "foo  ", "▁", "a▁b", "a ▁", "x\x00y", "\n a", "\n  a", "a  b", "\x1c b", "x\x85 y", "日" * 3000, "z" * 5000, "long text here, " * 4000]
    made = ["".join(rng.choice(PARTS) + rng.choice([" ", " ", "", "  ", "\n", ", "]) for _ in range(rng.randint(1, 60))) for _ in range(120)]
    return [*enumerate(odd), (None, "a null id"), (500, "the same row"), (500, "the same row"), (500, "another row of this id"), *enumerate(made, 1000)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'q' AS id", "1 AS pairs", "2 AS row", "3 AS n").repartition(5).cache()


@pytest.mark.parametrize("most", [1 << 20, 200, 0])
def test_summaries_equal_brute_force_with_all_some_or_no_common_pairs(docs, rows, most):
    got = alignment.summaries(docs, *alignment.default_paths(), most_common=most).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(slow(rows), key=repr)


def test_groups_are_the_cuts_that_both_sides_share(docs, rows):
    got = alignment.align(docs, *alignment.default_paths()).collect()
    want = [(i, slow_groups(text)) for i, text in rows]
    assert sorted([(r[0], [(list(g["a"]), list(g["b"]), g["end"]) for g in r["groups"]]) for r in got], key=repr) == sorted(want, key=repr)


def test_an_empty_table(docs):
    none = docs.where("doc_id < 0")
    assert alignment.summaries(none, *alignment.default_paths()).count() == 0 and alignment.align(none, *alignment.default_paths()).count() == 0


def test_a_small_cache_gives_the_same(rows, monkeypatch):
    own, small = alignment.Aligner(*alignment.default_paths()), alignment.Aligner(*alignment.default_paths())
    texts = [t for _, t in rows if t] * 2
    want = [own.places([t]) for t in texts]
    want = [[own.texts[i] for i in p] for p, _ in want]
    monkeypatch.setattr(alignment, "CACHE_BYTES", 60_000)
    monkeypatch.setattr(alignment, "MOVES", 200)
    got, largest = [], 0
    for t in texts:
        places, _ = small.places([t])
        got.append([small.texts[i] for i in places])
        largest = max(largest, len(small.texts))
    assert got == want and len(own.texts) > largest


def test_the_transducer_refuses_other_bytes():
    own = alignment.Transducer([b"ab", b"c"], [b"a", b"b", b"d", b"bc"])
    assert own.run([0, 1], [0, 3]) == ([2], [2])
    assert own.run([0, 0], [0, 1, 0, 1]) == ([1, 2], [2, 4])
    for a, b in (([0], [2]), ([0], [0]), ([0], [0, 1, 0]), ([0, 1], [0, 1])):
        with pytest.raises(ValueError):
            own.run(a, b)


def test_large_groups_count_links_of_equal_ids_together(monkeypatch):
    monkeypatch.setattr(alignment, "LARGE", 1)
    small = alignment.Aligner(*alignment.default_paths())
    monkeypatch.undo()
    own = alignment.Aligner(*alignment.default_paths())
    texts = ["日本語テキスト 🎉🎉🎉", "internationalisation of unbelievable things"]
    for one in (small, own):
        monkeypatch.setattr(alignment, "LARGE", 1 if one is small else 4096)
        one.learn([p for t in texts for p in one.cut(t)])
    links = []
    for one in (small, own):
        pair, times = one.linked(np.arange(len(one.texts)))
        total = collections.Counter()
        for k, n in zip(one.pairs.all[pair].tolist(), times.tolist(), strict=True):
            total[k] += n
        links.append(total)
    assert links[0] == links[1]
