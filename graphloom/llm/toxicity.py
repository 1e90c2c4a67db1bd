"""Toxicity: a lexicon trie intersected with Levenshtein automata, and context windows.

The lexicon is learned: words, and beginnings of words (stems), that stand in toxic documents far
more often than chance allows.  Its trie is intersected with the Levenshtein automaton of distance
one, determinized into one table over byte classes, and run over all words of a batch of texts at
once, so misspelled terms are caught at the price of a few table look-ups a word.  Each hit is put
into its context window: hits between quotation marks count as quotation, the others as abuse.  A
logistic model over the counts gives the score.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import emptied, only, trimmed, written
from graphloom.llm.words import Words, words_of

#: Labelled rows that a model is fitted on at most, taken in the order of their ids' hashes.
SAMPLE = 20_000
#: Lengths of stems in bytes; the least length at which misspellings count.
STEM, FUZZY_FROM = range(4, 11), 6
#: Terms counted by a task before it passes them on.
COUNTED = 50_000
#: Chance of a term's toxic share under the base rate, and the share that it needs.
CHANCE, SHARE = 1e-7, 0.5
#: Rounds of learning: each looks at documents without a term so far, and takes terms about as telling as its best.
ROUNDS, AS_TELLING = 4, 0.3
#: Words to either side in which quotation marks are looked for, and words of a density window.
AROUND, DENSITY = 8, 40
FEATURES = 5

LETTERS = np.ones(256, bool)  # true: no letter
LETTERS[0x61:0x7B] = False
LETTERS[0x80:] = False
QUOTE = 0x22


def folded(data: np.ndarray) -> np.ndarray:
    """Small letters for the capitals of Latin-1; every quotation mark becomes ", other general punctuation a blank."""
    data = data.copy()
    data[(data >= 0x41) & (data <= 0x5A)] += 32
    if len(data) > 2:
        high = np.flatnonzero(data[:-1] == 0xC3) + 1
        high = high[(data[high] >= 0x80) & (data[high] <= 0x9E) & (data[high] != 0x97)]
        data[high] += 32
        marks = np.flatnonzero(data[:-1] == 0xC2)
        marks = marks[(data[marks + 1] == 0xAB) | (data[marks + 1] == 0xBB)]
        data[marks], data[marks + 1] = QUOTE, 0x20
        marks = np.flatnonzero((data[:-2] == 0xE2) & (data[1:-1] == 0x80))
        to = np.where((data[marks + 2] >= 0x9C) & (data[marks + 2] <= 0x9F), QUOTE, 0x20)
        data[marks], data[marks + 1], data[marks + 2] = to, 0x20, 0x20
    return data


class TermAutomaton:
    """Lexicon trie x Levenshtein automaton, as one deterministic table.

    A term is bytes; one that ends in a zero byte is a whole word, any other a stem.  After a word,
    ``category`` of its state is 2 if it holds a term, 1 if it is one edit away from one, else 0.
    """

    def __init__(self, terms: list[bytes], most_states: int = 20_000):
        children: list[dict[int, int]] = [{}]
        stem, word, long_enough = [False], [False], [False]
        for t in sorted(terms):
            whole, node = t.endswith(b"\0"), 0
            t = t.rstrip(b"\0")
            path = [0]
            for c in t:
                if c not in children[node]:
                    children[node][c] = len(children)
                    children.append({})
                    for flags in (stem, word, long_enough):
                        flags.append(False)
                node = children[node][c]
                path.append(node)
            (word if whole else stem)[node] = True
            if len(t) >= FUZZY_FROM:
                for n in path:
                    long_enough[n] = True
        used = sorted({c for kids in children for c in kids})
        self.classes = np.full(256, len(used), np.int64)
        self.classes[used] = np.arange(len(used))
        latch = {0: -1, 1: -2}  # a stem was read with that many edits: the rest of the word is free

        def close(items: set[tuple[int, int]]) -> frozenset:
            out, stack = set(), list(items)
            while stack:
                n, e = stack.pop()
                if n >= 0 and stem[n] and (e == 0 or long_enough[n]):
                    out.add((latch[e], e))
                if (n, e) in out:
                    continue
                out.add((n, e))
                if n >= 0 and e == 0:
                    stack += [(k, 1) for k in children[n].values() if long_enough[k]]
            if (-1, 0) in out:
                return frozenset({(-1, 0)})
            return frozenset(x for x in out if not (x[1] == 1 and (x[0], 0) in out))

        def step(state: frozenset, c: int | None) -> frozenset:
            out = set()
            for n, e in state:
                if n < 0:
                    out.add((n, e))
                    continue
                if c in children[n]:
                    out.add((children[n][c], e))
                if e == 0:
                    out.update((k, 1) for b, k in children[n].items() if b != c and long_enough[k])
                    if long_enough[n]:
                        out.add((n, 1))
            return close(out)

        numbers = {frozenset(): 0, close({(0, 0)}): 1}
        todo, table = [close({(0, 0)})], {0: [0] * (len(used) + 1)}
        while todo:
            state = todo.pop()
            row = []
            for c in [*used, None]:
                to = step(state, c)
                if to not in numbers:
                    if len(numbers) >= most_states and len(terms) > 1:
                        raise OverflowError
                    numbers[to] = len(numbers)
                    todo.append(to)
                row.append(numbers[to])
            table[numbers[state]] = row
        self.table = np.array([table[i] for i in range(len(table))], np.int32)
        self.category = np.zeros(len(numbers), np.int8)
        for state, i in numbers.items():
            if any(n == -1 or (n >= 0 and word[n] and e == 0) for n, e in state):
                self.category[i] = 2
            elif any(n == -2 or (n >= 0 and word[n] and e == 1 and long_enough[n]) for n, e in state):
                self.category[i] = 1

    def match(self, w: Words) -> np.ndarray:
        """The category of every word."""
        state = np.ones(len(w.starts), np.int32)
        classes, length = self.classes[w.data], w.ends - w.starts
        alive = np.flatnonzero(length > 0)
        j = 0
        while len(alive):
            now = self.table[state[alive], classes[w.starts[alive] + j]]
            state[alive] = now
            j += 1
            alive = alive[(now > 0) & (length[alive] > j)]
        return self.category[state]


class Lexicon:
    """Any number of terms, as one automaton or - where its states would be too many - as several."""

    def __init__(self, terms: list[bytes], most_states: int = 20_000):
        self.automata: list[TermAutomaton] = []
        todo = [sorted(terms)]
        while todo:
            part = todo.pop()
            try:
                self.automata.append(TermAutomaton(part, most_states))
            except OverflowError:
                todo += [part[: len(part) // 2], part[len(part) // 2 :]]

    def match(self, w: Words) -> np.ndarray:
        return np.maximum.reduce([a.match(w) for a in self.automata])


def features(w: Words, category: np.ndarray) -> np.ndarray:
    """[text, FEATURES]: abuse and quotation hits, exact and misspelled, and the densest window."""
    out = np.zeros((len(w), FEATURES))
    hits = np.flatnonzero(category)
    if not len(hits):
        return out
    row = np.searchsorted(w.bounds, hits, "right") - 1
    quotes = np.concatenate([[0], np.cumsum(w.data == QUOTE)])
    first, last = np.maximum(hits - AROUND, w.bounds[row]), np.minimum(hits + AROUND, w.bounds[row + 1] - 1)
    begin = np.where(first > w.bounds[row], w.ends[np.maximum(first - 1, 0)], w.texts[row])
    end = np.where(last + 1 < w.bounds[row + 1], w.starts[np.minimum(last + 1, len(w.starts) - 1)], w.texts[row + 1])
    before, after = quotes[w.starts[hits]] - quotes[begin], quotes[end] - quotes[w.ends[hits]]
    quoted = (before % 2 == 1) & (after > 0)
    exact = category[hits] == 2
    for k, kind in enumerate((exact & ~quoted, ~exact & ~quoted, exact & quoted, ~exact & quoted)):
        np.add.at(out[:, k], row[kind], 1)
    strong = hits[exact & ~quoted]
    if len(strong):
        own = np.searchsorted(w.bounds, strong, "right") - 1
        until = np.minimum(strong + DENSITY, w.bounds[own + 1])
        np.maximum.at(out[:, 4], own, np.searchsorted(strong, until, "left") - np.arange(len(strong)))
    return np.log1p(out)


@dataclass
class Model:
    terms: list[bytes]
    weights: np.ndarray

    def lexicon(self, docs: DataFrame):
        """The finished automata, broadcast: their size follows the terms, which follow the bounded sample."""
        return docs.sparkSession.sparkContext.broadcast(Lexicon(self.terms))

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -30, 30)))


def _unlikely(toxic: int, n: int, rate: float) -> float:
    """Log of a bound (Chernoff) on the chance of ``toxic`` or more of ``n`` at the base rate."""
    p = toxic / n
    if p <= rate:
        return 0.0
    return -n * (p * math.log(p / rate) + ((1 - p) * math.log((1 - p) / (1 - rate)) if p < 1 else 0))


def learn_terms(counts: list[tuple[bytes, int, int]], toxic: int, clean: int) -> list[bytes]:
    """Terms from (stem or word, toxic documents, clean documents): the most telling ones, none within another."""
    rate = (toxic + 0.5) / (toxic + clean + 1)
    scored = []
    for t, a, b in counts:
        s = _unlikely(a, a + b, rate)
        if s < math.log(CHANCE) and a / (a + b) >= max(SHARE, min(0.9, 2 * rate)):
            scored.append((s, len(t), t))
    chosen: list[bytes] = []
    taken: set[bytes] = set()  # chosen stems and words without their end
    beginnings: set[bytes] = set()  # what any chosen term begins with
    for score_, _, t in sorted(scored):
        if score_ > AS_TELLING * min(scored)[0]:
            break
        plain = t.rstrip(b"\0")
        if plain not in beginnings and not any(t[:n] in taken for n in range(1, len(t) + 1)):
            chosen.append(t)
            taken.add(t)
            beginnings.update(t[:n] for n in range(1, len(t) + 1))
    return chosen


def stem_counts(training: DataFrame) -> DataFrame:
    """(term, toxic, clean): documents of each class that hold a word or stem."""

    @trimmed
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            label, seen = b.column("toxic").to_pylist(), {}

            def counted() -> pa.RecordBatch:
                out = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), *(pa.array([x[side] for x in seen.values()], pa.int64()) for side in (0, 1))], names=["term", "toxic", "clean"])
                seen.clear()
                return out

            for w in words_of(b.column("text"), LETTERS, clean=folded):
                raw = w.data.tobytes()
                for k in range(len(w)):
                    words = {raw[s:e] for s, e in zip(w.starts[w.bounds[k] : w.bounds[k + 1]].tolist(), w.ends[w.bounds[k] : w.bounds[k + 1]].tolist(), strict=True)}
                    own = {x + b"\0" for x in words}
                    own.update(x[:n] for x in words for n in STEM if n <= len(x))
                    side = 0 if label[w.row + k] else 1
                    for t in own:
                        seen.setdefault(t, [0, 0])[side] += 1
                    if len(seen) > COUNTED:
                        yield counted()
            yield counted()

    return training.mapInArrow(count, "term binary, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def telling_terms(training: DataFrame, toxic: int, clean: int) -> list[bytes]:
    """The driver gets the terms that are unlikely enough in the training sample, whose size is bounded."""
    if not toxic or not clean:
        return []
    rate = (toxic + 0.5) / (toxic + clean + 1)
    least = math.ceil(math.log(CHANCE) / math.log(rate))
    found = stem_counts(training).where((F.col("toxic") >= least) & (F.col("toxic") >= SHARE * (F.col("toxic") + F.col("clean"))))
    return learn_terms([(bytes(r["term"]), int(r["toxic"]), int(r["clean"])) for r in found.collect()], toxic, clean)


def without_terms(training: DataFrame, lexicon) -> DataFrame:
    """The rows of ``training`` (text, toxic) without any of the terms so far."""

    @trimmed
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.value
        for b in batches:
            clean = np.ones(b.num_rows, bool)
            for w in words_of(b.column("text"), LETTERS, clean=folded):
                clean[w.row + np.searchsorted(w.bounds, np.flatnonzero(automaton.match(w)), "right") - 1] = False
            yield b.filter(pa.array(clean))

    return training.mapInArrow(keep, "text string, toxic int")


def _featured(docs: DataFrame, lexicon, carried: str) -> DataFrame:
    """``carried`` (name and type) and ``x`` (array<double>) for every row."""
    name = carried.split()[0]

    @trimmed
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.value
        for b in batches:
            x = np.zeros((b.num_rows, FEATURES))
            for w in words_of(b.column("text"), LETTERS, clean=folded):
                x[w.row : w.row + len(w)] = features(w, automaton.match(w))
            yield pa.RecordBatch.from_arrays([b.column(name), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), FEATURES).cast(pa.list_(pa.float64()))], names=[name, "x"])

    return docs.select(name, "text").mapInArrow(measure, f"{carried}, x array<double>")


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Weights and intercept by Newton's method."""
    x = np.column_stack([x, np.ones(len(x))])
    w, penalty = np.zeros(x.shape[1]), np.diag([ridge] * (x.shape[1] - 1) + [1e-3])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + penalty @ w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from labelled rows outside the held-out fold; at most ``sample`` of them.

    Copies of a text count once.  The lexicon's candidates are counted in Spark; the driver gets
    the telling ones and the feature rows of the sample.  Without labels of both classes every score is the share of
    toxic labels, a half if there are none.
    """
    rows = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    training = written(only(docs, "doc_id", "text").join(rows, "doc_id").groupBy("text").agg(F.max("toxic").cast("int").alias("toxic")), "training")
    n = {int(r["toxic"] != 0): int(r["count"]) for r in training.groupBy("toxic").count().collect()}
    toxic, clean = n.get(1, 0), n.get(0, 0)
    model = Model([], np.zeros(FEATURES + 1))
    for _ in range(ROUNDS if toxic and clean else 0):
        rest, lexicon = training, None
        if model.terms:
            lexicon = model.lexicon(docs)
            rest = written(without_terms(training, lexicon), "training")
        n = {int(r["toxic"] != 0): int(r["count"]) for r in rest.groupBy("toxic").count().collect()}
        new = telling_terms(rest, n.get(1, 0), n.get(0, 0))
        if lexicon:
            emptied(rest)
            lexicon.destroy()
        model.terms = model.terms + new
        if not new:
            break
    if not model.terms:
        share = (toxic + 0.5) / (toxic + clean + 1)
        model.weights[-1] = math.log(share / (1 - share))
    else:
        lexicon = model.lexicon(docs)
        got = _featured(training.withColumn("y", F.col("toxic")), lexicon, "y int").toArrow()
        x = got.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, FEATURES)
        model.weights = fit_logistic(x, (got.column("y").to_numpy() != 0).astype(float))
        lexicon.destroy()
    emptied(training)
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, hits of every document; a null or empty text gets the score of a text without hits."""
    weights = model.weights
    rows = _featured(only(docs, "doc_id", "text"), model.lexicon(docs), "doc_id long")
    z = F.lit(float(weights[-1]))
    for k in range(FEATURES):
        z = z + F.lit(float(weights[k])) * F.col("x")[k]
    hits = F.round(F.exp(F.col("x")[0]) + F.exp(F.col("x")[1]) + F.exp(F.col("x")[2]) + F.exp(F.col("x")[3]) - 4).cast("long")
    return rows.select("doc_id", (1 / (1 + F.exp(-z))).alias("score"), hits.alias("hits"))


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted, hits for every document (repeated rows stay repeated)."""
    scored = score(docs, fit(docs, labels, sample))
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "hits")


def keep_clean(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, all columns as they are; no shuffle.

    A model without terms - no usable labels, labels of one class only, or none that any term tells
    apart - gives every document the same score and so rejects none: all rows are kept.
    """
    if not model.terms:
        return docs
    lexicon = model.lexicon(docs)

    @trimmed
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.value
        for b in batches:
            x = np.zeros((b.num_rows, FEATURES))
            for w in words_of(b.column("text"), LETTERS, clean=folded):
                x[w.row : w.row + len(w)] = features(w, automaton.match(w))
            yield b.filter(pa.array(model.score(x) < threshold))

    return docs.mapInArrow(keep, docs.schema)
