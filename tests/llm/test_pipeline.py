"""The stages on a small corpus with planted cases."""

import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

CARD = "4041894974608795"


def test_pipeline(spark, tmp_path):
    rng = random.Random(15)
    vocabulary = ["".join(rng.choice(["ar", "ti", "on", "es", "ul", "ka"]) for _ in range(rng.randint(1, 4))) for _ in range(500)]
    some = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(some(25))) for i in range(5)]
    docs, labels, want = [(0, None), (1, "")], [], {0}
    for i in range(2, 700):
        words, toxic = some(rng.randint(30, 120)), i % 5 == 0
        if toxic:
            words[rng.randrange(len(words))] = "vermin"
        if i % 7 == 1:
            words[9:9] = items[i % 5][1].split()[3:15]
        if i % 11 == 2:
            words.append(CARD)
        docs.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
        if not toxic and i % 7 != 1:
            want.add(i)
    for i in range(40):
        base = docs[20 + 5 * i][1].split()
        docs.append((1000 + i, " ".join(base)))
    want.discard(1)
    full = [(i, t, "en", "s", len(t or "")) for i, t in docs]
    spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    held, sizes = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, held, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        held = spark.read.parquet(f"{tmp_path}/{name}")
        sizes.append(held.count())
        if name == "personal_data":
            assert held.columns == corpus_pipeline.COLUMNS
            texts = {r["doc_id"]: r["text"] for r in held.collect()}
    assert set(texts) == want
    assert not any(CARD in (t or "") for t in texts.values())
    assert {i for i, t in texts.items() if t != dict(docs)[i]} == {i for i in want if i % 11 == 2}
    assert {r["doc_id"] for r in held.collect()} == want
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == sizes[-1]


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def stage_output(spark, name, rows, path):
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], COLUMNS)
    out = dict(corpus_pipeline.STAGES)[name](spark, docs, str(path))
    assert out.columns == corpus_pipeline.COLUMNS
    return sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str)


def test_near_copies_and_missing_ids(spark, tmp_path):
    rng = random.Random(8)
    base = [" ".join(f"w{rng.randrange(900)}" for _ in range(200)) for _ in range(9)]
    near = base[0].split()
    near[10] = near[90] = near[170] = "other"  # 15 of 196 shingles differ: similarity 0.86
    far = base[1].split()
    far[10:190:15] = ["other"] * 12
    rows = [(5, base[0]), (6, " ".join(near)), (7, base[1]), (8, " ".join(far)), (None, base[2]), (None, base[3]), (None, base[3]), (9, base[4]), (9, base[4]), (9, base[5]), (None, base[6]), (3, base[6])]
    want = [(5, base[0]), (7, base[1]), (8, " ".join(far)), (None, base[2]), (None, base[3]), (9, base[4]), (9, base[5]), (3, base[6])]
    assert stage_output(spark, "near_duplicates", rows, tmp_path) == sorted(want, key=str)


def test_contaminated_rows_without_id(spark, tmp_path):
    item = " ".join(f"b{i}" for i in range(40))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(None, f"x y {item} z"), (None, "clean words"), (4, f"x {item}"), (4, "other clean words")]
    assert stage_output(spark, "decontamination", rows, tmp_path) == sorted([rows[1], rows[3]], key=str)


@pytest.mark.parametrize("labels", [[], [(1, 1, 1), (2, 0, 1)], [(1, 1, 0)], [(None, 1, 1), (1, None, None)]])
def test_labels_that_teach_nothing_reject_nothing(spark, tmp_path, labels):
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = [(1, "some words"), (2, "more words"), (None, None), (4, "")]
    assert stage_output(spark, "toxicity", rows, tmp_path) == sorted(rows, key=str)


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
