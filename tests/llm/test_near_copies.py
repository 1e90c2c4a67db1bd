"""Near copies against brute force over all pairs."""

import random

from graphloom.llm.near_copies import near_copies


def shingles(text, n=5):
    words = (text or "").lower().split()
    m = min(n, len(words))
    return {tuple(words[i : i + m]) for i in range(len(words) - m + 1)} if words else set()


def test_near_copies(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = rng.choices(vocabulary, k=30)
    texts = [None, "", " \n", "one", "ONE", "two words", "long " * 5000]
    for size in (12, 60, 300):
        for _ in range(12):
            base = rng.choices(vocabulary, k=size)
            if rng.random() < 0.5:
                base[5:5] = passage
            texts.append(" ".join(base))
            for edits in (0, 1, 1, 2, 3, 5, 8):
                own = list(base)
                for _ in range(edits):
                    own[rng.randrange(len(own))] = rng.choice(vocabulary)
                texts.append("  ".join(own).upper())
    rng.shuffle(texts)
    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    near = 0
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a == b or len(a & b) >= 0.8 * len(a | b):
                near += a != b
                root[max(find(i), find(j))] = min(find(i), find(j))
    assert near > 50
    rows = spark.createDataFrame([(7 * i, t) for i, t in enumerate(texts)], "row long, text string")
    got = {}
    for r in near_copies(rows).collect():
        got.setdefault(r["component"], set()).add(r["row"] // 7)
    want = {}
    for i in range(len(texts)):
        want.setdefault(find(i), set()).add(i)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))
    assert near_copies(rows.limit(0)).count() == 0
