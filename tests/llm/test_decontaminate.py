"""Contamination against a scan of every window in every document."""

import hashlib
import random
import re

from graphloom.llm.decontaminate import contamination


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)


def brute(text, items, window):
    own, hit, found = words(text), set(), set()
    for item, item_text in items:
        w = words(item_text)
        for i in range(max(1, len(w) - window + 1) if w and item is not None else 0):
            part = w[i : i + window]
            for j in range(len(own) - len(part) + 1):
                if own[j : j + len(part)] == part:
                    hit.update(range(j, j + len(part)))
                    found.add(str(item))
    return len(own), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def test_contamination(spark):
    rng = random.Random(9)
    vocabulary = ["Alpha", "beta", "gämma", "x1", "the", "of", "İd", "zz"]
    some = lambda n: rng.choice([" ", ", ", "\n"]).join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, some(rng.choice([0, 1, 2, 3, 9, 10, 11, 30]))) for i in range(10, 40)] + [(99, None), (None, some(12)), (98, "--"), (100, "Rare single")]
    docs = [(0, None), (1, ""), (2, "..."), (3, "x1 " * 30000), (4, "rare, SINGLE!")]
    for i in range(5, 45):
        text = some(rng.randint(0, 40))
        if rng.random() < 0.7:
            text += "; " + (rng.choice(items)[1] or "").upper().replace("Ä", "ä") + " " + some(5)
        docs.append((i, text))
    items[0] = (items[0][0], some(30))
    d = spark.createDataFrame([(a, b, a, "v") for a, b in docs], "doc_id long, text string, items int, words string")
    b = spark.createDataFrame([(a, b, "v") for a, b in items], "item_id long, text string, doc_id string")
    got = {r["doc_id"]: tuple(r)[1:6] for r in contamination(d, b).collect()}
    for i, text in docs:
        assert got[i] == brute(text, items, 10), i
    assert contamination(d.limit(0), b).count() == 0
    assert not any(r["contaminated"] for r in contamination(d, b.limit(0)).collect())


def test_repeated_rows_rows_without_id_and_long_texts(spark):
    rng = random.Random(3)
    filler = lambda n: " ".join(str(rng.randint(0, 10**7)) for _ in range(n))
    items = [("q1", "one two three four five six seven eight nine ten eleven"), ("q2", "one two three four five six seven eight nine ten other"), ("q1", "one two three four five six seven eight nine ten eleven")]
    texts = [filler(90_000) + " " + items[0][1] + " " + filler(10), "clean " * 30, items[0][1].upper(), None]
    docs = [(1, texts[0]), (2, texts[1]), (2, texts[2]), (None, texts[2]), (None, texts[1]), (3, texts[2]), (3, texts[2]), (4, texts[3])]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    rows = contamination(d, spark.createDataFrame(items, "item_id string, text string")).collect()
    expected = sorted((str(i), *brute(t, items, 10)) for i, t in docs)
    assert sorted((str(r["doc_id"]), *tuple(r)[1:6]) for r in rows) == expected
