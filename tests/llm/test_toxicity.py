"""The automaton against edit distances, context windows, and held-out accuracy."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from graphloom.llm import toxicity
from graphloom.llm.words import words_of


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_automaton():
    rng = random.Random(6)
    terms = [b"idiots\0", b"scum\0", b"worthle", b"abcab", b"bcabca\0"]
    automaton = toxicity.TermAutomaton(terms)
    words = ["idiots", "idiot", "idits", "idioots", "xidiots", "scum", "scums", "scam", "worthless", "wrthless", "wortless", "woxthle", "abcab", "abcabzz", "abcb"]
    words += ["".join(rng.choice("abcd") for _ in range(rng.randint(1, 9))) for _ in range(3000)]
    w = next(words_of(pa.array([" ".join(words)]), toxicity.LETTERS, clean=toxicity.folded))
    for word, got in zip(words, automaton.match(w), strict=True):
        want = 0
        for t in terms:
            whole, t = t.endswith(b"\0"), t.rstrip(b"\0").decode()
            best = distance(word, t) if whole else min(distance(word[:n], t) for n in range(len(word) + 1))
            want = max(want, 2 if best == 0 else 1 if best == 1 and len(t) >= toxicity.FUZZY_FROM else 0)
        assert got == want, word


def test_a_large_lexicon_is_several_automata():
    rng = random.Random(2)
    terms = sorted({"".join(rng.choice("abcde") for _ in range(rng.randint(5, 9))).encode() + b"\0" * rng.randint(0, 1) for _ in range(120)})
    one, several = toxicity.TermAutomaton(terms, 10**6), toxicity.Lexicon(terms, 400)
    words = " ".join("".join(rng.choice("abcde") for _ in range(rng.randint(1, 10))) for _ in range(4000))
    w = next(words_of(pa.array([words]), toxicity.LETTERS, clean=toxicity.folded))
    assert len(several.automata) > 2 and (several.match(w) == one.match(w)).all() and set(one.match(w).tolist()) == {0, 1, 2}


def test_terms_within_one_another_are_left_out():
    counts = [(t, 100, 0) for t in (b"wretch", b"wretche", b"wretched\0", b"vermin\0", b"verm")]
    assert toxicity.learn_terms(counts, 200, 2000) == [b"verm", b"wretch"]


def test_quotation_is_told_from_abuse():
    automaton = toxicity.TermAutomaton([b"idiot\0"])
    texts = ["you idiot", 'they wrote "you idiot" there', "they wrote «you idiot» there", "“You Idiot”, they wrote", '"well" you idiot', None, "ÉIDIOT idiot"]
    w = next(words_of(pa.array(texts), toxicity.LETTERS, clean=toxicity.folded))
    x = np.expm1(toxicity.features(w, automaton.match(w))).round().astype(int)
    assert x[:, 0].tolist() == [1, 0, 0, 0, 1, 0, 1] and x[:, 2].tolist() == [0, 1, 1, 1, 0, 0, 0]


def test_toxicity(spark):
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice(["ar", "ti", "on", "es", "ul"]) for _ in range(rng.randint(1, 4))) for _ in range(400)]
    docs, labels = [(9000, None), (9001, ""), (9002, "… !!"), (9003, "on " * 40000)], []
    for i in range(900):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(5, 80))]
        toxic = rng.random() < 0.2
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(["Wretched", "vermin", "wretched,"])
        docs.append((i, " ".join(words)))
        if i % 3 == 0:
            labels.append((i, 1, int(toxic)))
    truth = {i: t for i, _, t in labels}
    d = spark.createDataFrame([(i, t, "en", i) for i, t in docs + [(None, "on ti")]], "doc_id long, text string, score string, toxic int")
    lab = spark.createDataFrame([*labels, (5, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    rows = {r["doc_id"]: r for r in toxicity.toxicity(d, lab).collect()}
    assert len(rows) == len(docs) + 1 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows.values())
    assert all(rows[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, _ in docs)
    held = [i for i in truth if rows[i]["held_out"]]
    assert sum(rows[i]["predicted"] == truth[i] for i in held) >= 0.95 * len(held)
    assert toxicity.toxicity(d.limit(0), lab).count() == 0
    assert [r["score"] for r in toxicity.toxicity(d, lab.limit(0)).collect()] == pytest.approx([0.5] * (len(docs) + 1))
