"""Repeated passages against a count of every window."""

import hashlib
import random
import re
from collections import Counter

from graphloom.llm.substring_words import repeated_passages


def thue_morse(n):
    """Two different words that have one value under any polynomial modulo 2**64 with an odd base."""
    a, b = "a", "b"
    for _ in range(n):
        a, b = a + b, b + a
    return a, b


WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(docs, window):
    words = {i: WORD.findall(t or "") for i, t in docs}
    count = Counter(tuple(w[p : p + window]) for w in words.values() for p in range(len(w) - window + 1))
    out = {}
    for i, w in words.items():
        gone = set()
        for p in range(len(w) - window + 1):
            if count[tuple(w[p : p + window])] > 1:
                gone.update(range(p, p + window))
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def test_repeated_passages(spark):
    rng = random.Random(21)
    vocabulary = ["a", "B", "ç", "the", "x.", "lo\x1cng", "z\xa0z"]
    some = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passages = [some(rng.choice([20, 34, 35, 36, 60, 150])) for _ in range(12)] + [["a"] * 90, ["a", "B"] * 40]
    docs = [(0, None), (1, ""), (2, " \n\t"), (3, "a " * 34), (4, "solo")]
    for i in range(5, 90):
        words = some(rng.randint(0, 40))
        for _ in range(rng.randint(0, 4)):
            words += rng.choice(passages)[rng.randint(0, 4) :] + some(rng.randint(0, 30))
        docs.append((i, rng.choice([" ", "\n", " \t "]).join(words)))
    docs += [(200, docs[20][1]), (201, docs[30][1])]
    table = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, first int, gone string")
    rows = repeated_passages(table, 35, with_text=True).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in rows} == brute(docs, 35)
    assert all(sum(s["last"] - s["first"] + 1 for s in r["spans"]) == r["n_removed"] for r in rows)
    assert repeated_passages(table.limit(0)).count() == 0
    only = spark.createDataFrame([(1, "w " * 36), (2, "v " * 35)], "doc_id long, text string")
    assert {r["doc_id"]: r["n_removed"] for r in repeated_passages(only).collect()} == {1: 36, 2: 0}


def test_colliding_hashes_are_found_out(spark):
    rng = random.Random(4)
    shared = " ".join(rng.choice("abcdefgh") for _ in range(120))
    docs = [(i, " ".join(rng.choice("abcdefgh") for _ in range(60)) + (" " + shared) * (i % 3)) for i in range(30)]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in repeated_passages(table, 35, bits=3).collect()}
    assert got == brute(docs, 35)


def test_words_that_polynomial_hashes_confuse(spark):
    a, b = thue_morse(10)
    docs = [(i, " ".join(["w"] * 34 + [x])) for i, x in enumerate((a, b, a))]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r["doc_id"]: r["n_removed"] for r in repeated_passages(table).collect()} == {0: 35, 1: 0, 2: 35}


def test_repeated_rows_long_texts_and_rows_without_id(spark):
    rng = random.Random(6)
    long = " ".join(str(rng.randint(0, 10**6)) for _ in range(150_000))  # about a megabyte
    docs = [(1, long), (2, "x " * 40 + long), (3, long[:400_000]), (4, "y " * 20)]
    rows = [*docs, (5, "r s " * 30), (5, "r s " * 30), (None, long)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = repeated_passages(table).collect()
    assert len(got) == 6
    expected = brute(docs, 35)
    assert all((r["n_words"], r["n_removed"], r["kept_sha256"]) == expected[r["doc_id"]] for r in got if r["doc_id"] != 5)
    assert [r["n_removed"] for r in got if r["doc_id"] == 5] == [60, 60]


def test_one_id_with_several_texts(spark):
    shared = " ".join(f"s{i}" for i in range(40))
    for more in ("v0 other words there", "v0 other words there now"):  # as many words, and another number
        rows = [(1, "w0 some text here " + shared), (2, "w0 some text here " + shared), (2, f"{more} {shared}"), (2, "alone")]
        got = sorted(tuple(r)[:3] for r in repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect())
        assert got == sorted([(1, 44, 44), (2, 44, 44), (2, len(more.split()) + 40, 40), (2, 1, 0)])


def test_windows_of_any_length(spark):
    rng = random.Random(8)
    some = lambda n: [rng.choice("abcdefgh") for _ in range(n)]
    passages = [some(n) for n in (70, 71, 150)]
    docs = [(i, " ".join(some(rng.randint(0, 30)) + rng.choice(passages) + some(rng.randint(0, 30)))) for i in range(30)]
    for window in (9, 70, 71, 120):
        got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in repeated_passages(spark.createDataFrame(docs, "doc_id long, text string"), window).collect()}
        assert got == brute(docs, window), window
