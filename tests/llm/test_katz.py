"""The Katz model against a dictionary-based one, and its normalisation."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from juriscope.llm import katz
from juriscope.llm.shared import shuffles_freed

END, START = "</s>", "<s>"


def tokens(text):
    return [w.decode() for w in (text or "").encode().lower().split()] + [END]


class Plain:
    """Katz's recursion straight from its definition."""

    def __init__(self, texts, order):
        self.order = order
        self.counts = [Counter() for _ in range(order + 1)]
        for t in texts:
            seq = [START] * (order - 1) + tokens(t)
            for i in range(order - 1, len(seq)):
                for k in range(1, order + 1):
                    self.counts[k][tuple(seq[i - k + 1 : i + 1])] += 1
        self.vocabulary = sorted({g[0] for g in self.counts[1]})
        self.levels, self.after = [None], [None]
        for k in range(1, order + 1):
            tally = [sum(c == r for c in self.counts[k].values()) for r in range(1, katz.MOST_DISCOUNTED + 2)]
            self.levels.append(katz.Level.of(np.array(tally)).discount)
            after = defaultdict(dict)
            for g, c in self.counts[k].items():
                after[g[:-1]][g[-1]] = c
            self.after.append(after)

    def p(self, word, context):
        k = len(context) + 1
        seen = self.after[k].get(tuple(context), {})
        lower = (lambda w: self.p(w, context[1:])) if k > 1 else None
        if not seen:
            return lower(word) if k > 1 else 1.0
        d = self.levels[k]
        kept = {w: d[min(c, len(d) - 1)] * c for w, c in seen.items()}
        total = sum(seen.values())
        below = total + 1 if sum(kept.values()) >= total else total
        if word in seen:
            return kept[word] / below
        left = 1 - sum(kept.values()) / below
        return left if k == 1 else left / (1 - sum(lower(w) for w in seen)) * lower(word)


TEXTS = [
    "the cat sat on the mat and the dog sat on the cat", "The dog ran to the mat.", "a cat and a dog and a bird ran", "birds sing on the mat", "the cat sat", "", None, "x",
    "one two three four five six seven eight nine ten", "the mat sat on the dog and the cat ran to the bird", "a bird sat on a cat", "dog dog dog dog cat", "on the mat and on the cat",
]


@pytest.mark.parametrize("order", [1, 2, 3])
def test_matches_definition(spark, order):
    rows = [(i, TEXTS[i % len(TEXTS)], "x") for i in range(60)] + [(7, "the unheard zebra sat on the zebra", "y"), (None, "the cat", "z")]
    # doc 7..: some ids are held out
    df = spark.createDataFrame(rows, "doc_id long, text string, score string")
    got = katz.score_texts(df, order=order).collect()
    assert len(got) == len(rows)
    key = lambda i: "" if i is None else str(i)
    held = lambda i: zlib.crc32(key(i).encode()) % 7 == 2
    plain = Plain([t for i, t, _ in rows if not held(i)], order)
    n, v = sum(plain.counts[1].values()), len(plain.vocabulary)
    want = []
    for i, t, _ in rows:
        seq = [START] * (order - 1) + tokens(t)
        score = sum(math.log10(plain.p(seq[j], seq[j - order + 1 : j])) for j in range(order - 1, len(seq)))
        base = sum(math.log10((plain.counts[1][(w,)] + 1) / (n + v + 1)) for w in tokens(t))
        want.append((key(i), held(i), len(tokens(t)), sum(plain.counts[1][(w,)] > 0 for w in tokens(t)), n, round(base, 6), round(score, 6)))
    have = [(key(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in got]
    assert sorted(have) == sorted(want)


def test_sums_to_one():
    plain = Plain([t for t in TEXTS if t], 2)
    for context in ("the", "cat", "on", START):
        total = sum(plain.p(w, [context]) for w in [*plain.vocabulary, "<unseen>"])
        assert abs(total - 1) < 1e-9


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert katz.score_texts(df).collect() == []


def test_nothing_to_learn_from(spark):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    row = katz.score_texts(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).first()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.score) == (3, 0, 0, 0.0)


def test_frequent_contexts_in_pieces(spark, monkeypatch):
    """A context cut over buckets gives the same scores."""
    rows = [(i, "the " + " the ".join(f"w{(i * j) % 50}" for j in range(40))) for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    plain = Plain([t for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2], 2)
    got = {r.doc_id: r.score for r in katz.score_texts(df).collect()}
    for i, t in rows[:10]:
        seq = [START, *tokens(t)]
        assert abs(got[i] - sum(math.log10(plain.p(seq[j], [seq[j - 1]])) for j in range(1, len(seq)))) < 1e-6


def test_query_uses_two_words_of_context(spark):
    """The registered query is a model of order 3."""
    rows = [(i, TEXTS[i % len(TEXTS)]) for i in range(60)]
    plain = Plain([t for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2], 3)
    got = {r.doc_id: r.score for r in katz.op1_katz(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        seq = [START, START, *tokens(t)]
        assert abs(got[i] - sum(math.log10(plain.p(seq[j], seq[j - 2 : j])) for j in range(2, len(seq)))) < 1e-6


def _shuffled(spark) -> int:
    """Bytes that this session's tasks have written for shuffles so far."""
    context = spark._jsc.sc()
    context.listenerBus().waitUntilEmpty()
    return context.statusStore().executorSummary("driver").totalShuffleWrite()


def test_order_three_moves_little(spark):
    """Grams go as numbers of words, and those after a context that only one chunk holds stay there."""
    rng = np.random.default_rng(3)
    words = np.minimum(rng.zipf(1.3, (400, 200)), 10**7)
    docs = spark.createDataFrame([(i, " ".join(f"w{x}" for x in row)) for i, row in enumerate(words.tolist())], "doc_id long, text string").repartition(4, "doc_id")
    before = _shuffled(spark)
    assert katz.op1_katz(docs).count() == 400
    # about 9; hashes of contexts and words with a probability each took about 24
    assert (_shuffled(spark) - before) / words.size < 15


def test_frequent_contexts_of_two_words_in_pieces(spark):
    """Contexts of order 3 that are cut over buckets, and words unseen after them, give the same scores."""
    rows = [(i, "a the " + " a the ".join(f"w{(i * j) % 50}" for j in range(40)) + f" a the x{i}") for i in range(80)]
    plain = Plain([t for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2], 3)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5, "doc_id")
    got = {r.doc_id: r.score for r in katz.op1_katz(df).collect()}
    for i, t in [r for r in rows if r[0] < 10 or zlib.crc32(str(r[0]).encode()) % 7 == 2]:
        seq = [START, START, *tokens(t)]
        assert abs(got[i] - sum(math.log10(plain.p(seq[j], seq[j - 2 : j])) for j in range(2, len(seq)))) < 1e-6


def test_shuffles_are_freed_within_only(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    with shuffles_freed(spark):
        assert spark.conf.get(key) == "true"
    assert spark.conf.get(key, None) == before
