"""Language-model scores against a brute-force trie and brute-force counts."""

import random
import zlib
from collections import Counter, defaultdict
from math import log10

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievestone.llm import ppm
from sievestone.llm.shared import read

SMALL = "/root/testdata/sf0.001"


def held(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 7 == 2


def held_out():
    return F.expr("pmod(crc32(cast(coalesce(cast(doc_id as string), '') as binary)), 7) = 2")


class Brute:
    """The same model from its definition: one symbol, one context at a time, with explicit exclusion sets."""

    def __init__(self, texts, order, share):
        self.order, self.follow = order, defaultdict(Counter)
        symbols = 0
        for t in texts:
            s = [256] * order + list(t) + [256]
            for i in range(order, len(s)):
                symbols += 1
                for k in range(order + 1):
                    self.follow[tuple(s[i - k:i])][s[i]] += 1
        self.kept = {c: {s: n for s, n in f.items() if n * share >= symbols} for c, f in self.follow.items()}
        self.kept = {c: f for c, f in self.kept.items() if f}

    def p(self, history, symbol):
        p, out = 1.0, set()
        for k in range(self.order, -1, -1):
            c = tuple(history[len(history) - k:])
            if c not in self.kept:
                continue
            total, kept = sum(self.follow[c].values()), self.kept[c]
            fresh = {s: n for s, n in kept.items() if s not in out}
            whole = total - sum(n for s, n in kept.items() if s in out) + len(fresh)
            if symbol in fresh:
                return p * fresh[symbol] / whole
            if whole:
                p *= (total - sum(kept.values()) + len(fresh)) / whole
            out |= set(kept)
        return p / (257 - len(out))

    def score(self, text):
        s = [256] * self.order + list(text) + [256]
        return sum(log10(self.p(s[:i], s[i])) for i in range(self.order, len(s)))


ROWS = [(1, None), (2, ""), (3, " \n\t "), (4, "one two three"), (5, "ONE  two"), (5, "ONE  two"), (None, "a b c"), (7, "ab" * 3000), (8, "é" * 50 + " 日本 🙂"), (10, "the cat sat on the mat, the end"), (11, "the cat")]


@pytest.mark.parametrize("order,share", [(3, 1 << 20), (5, 1 << 20), (4, 500)])
def test_score_equals_brute_force(spark, order, share):
    rnd = random.Random(order)
    rows = ROWS + [(i, " ".join(rnd.choice(["the", "The", "cat", "mat.", "ran", "zebra%d" % rnd.randint(0, 30)]) for _ in range(rnd.randint(0, 40)))) for i in range(20, 60)]
    learned = [(t or "").encode() for i, t in rows if not held(i)]
    model = Brute(learned, order, share)
    lower = lambda t: bytes(b + 32 if 65 <= b <= 90 else b for b in (t or "").encode()).split()
    words = Counter(w for t in learned for w in lower(t.decode()))
    words[None] = len(learned)
    total, distinct = sum(words.values()), len(words)
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, score string")
    found = ppm.score(docs, held_out(), order, share, word_share=60).collect()
    assert len(found) == len(rows)
    key = lambda i: (i is None, i or 0)
    for r, (i, t) in zip(sorted(found, key=lambda r: (key(r.doc_id), r.score)), sorted(rows, key=lambda x: (key(x[0]), 0))):
        own = [*lower(t), None]
        assert (r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (i, held(i), len(own), sum(words[w] > 0 for w in own), total)
        assert r.base_score == pytest.approx(sum(log10((words[w] + 1) / (total + distinct + 1)) for w in own))
        assert r.score == pytest.approx(model.score((t or "").encode()))


def test_probabilities_add_up_to_one(spark):
    docs = spark.createDataFrame([(i, "the cat sat on the mat %d" % i) for i in range(50)], "doc_id long, text string")
    trie = ppm.train(ppm.count(docs, 3), 3, share=200)
    for history in ([256, 256, 256], [256, 256, 116], list(b"the"), list(b" ca"), list(b"zzz"), list(b"zt ")):
        start = sum(s << 9 * (3 - i) for i, s in enumerate(history))
        assert (10 ** trie.log10p(np.array([start | s for s in range(257)], np.uint64))).sum() == pytest.approx(1)


def test_nothing_to_learn_from_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "ab"), (2, None)], "doc_id long, text string")
    found = {r.doc_id: r for r in ppm.score(docs, F.lit(True)).collect()}
    assert found[1].score == pytest.approx(-3 * log10(257)) and found[2].n_tokens == 1 and found[1].train_tokens == 0 and found[1].base_score == 0
    assert ppm.score(docs.limit(0), F.lit(False)).count() == 0


def test_held_out_texts_beat_shuffled_ones(spark):
    docs = read(spark, SMALL, "documents").select("doc_id", "text")
    turned = docs.filter(held_out()).select("doc_id", F.reverse("text").alias("text"))
    both = docs.withColumn("held_out", held_out()).unionByName(turned.withColumn("held_out", F.lit(True)))
    score, n = defaultdict(list), Counter()
    for r in ppm.score(both, F.col("held_out")).filter("held_out").collect():
        score[r.doc_id].append(r.score)
        n[r.doc_id] += 1
        assert r.score < 0
    plain = {r.doc_id: r.score for r in ppm.score(docs, held_out()).filter("held_out").collect()}
    assert sum(plain[i] > min(s) for i, s in score.items()) > 0.8 * len(plain)


def test_adaptive_length(spark):
    docs = spark.createDataFrame([(1, "ab" * 200), (2, "".join(random.Random(1).choices("abcdefghijklmnop", k=400))), (3, None)], "doc_id long, text string")
    bits = {r.doc_id: r.bits for r in ppm.adaptive_length(docs).collect()}
    assert bits[1] < 200 < bits[2] < 400 * 8 and 0 < bits[3] < 9


def test_a_trie_carries_only_what_scoring_reads():
    codes = ppm.grams(np.frombuffer(b"abracadabra", np.uint8), np.array([0, 11]), 2)[0]
    found = {"symbols": len(codes)}
    for k in range(3):
        keys, n = np.unique(codes & np.uint64((1 << ppm.WIDTH * (k + 1)) - 1), return_counts=True)
        found[k] = (keys, n)
    trie = ppm.Trie(2, found, 1)
    assert set(vars(trie)) == {"order", "grams", "logs", "contexts", "uniform"}
    assert {x for c in trie.contexts for x in c} == {"key", "size", "escape", "below", "out"}
    # 'r' after "ab" both times: the context was seen twice and one symbol follows it, so 2 of 3 shares
    ab_r = sum(s << ppm.WIDTH * i for i, s in enumerate(reversed(b"abr")))
    assert trie.log10p(np.array([ab_r], np.uint64))[0] == pytest.approx(np.log10(2 / 3))


def test_grams_that_are_rare_in_a_large_corpus_count(spark):
    texts = ["%s %s" % (w, w[::-1]) for w in ("qvjkzwpxhy", "bnmtgrfdsl")]
    texts.append(texts[1])
    long = (1 << 20) + 5000
    model = Brute([t.encode() for t in texts] + [b"x" * 20], 5, 1 << 40)
    for k in range(6):
        for f in (model.follow, model.kept):
            f[(120,) * k][120] += (long - 20) * (f is model.follow or model.kept[(120,) * k] is not model.follow[(120,) * k])
    rows = [*enumerate(texts), (3, "x" * long), (4, "qvjkz bnm")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r.score for r in ppm.score(docs, F.col("doc_id") == 4).filter("doc_id <> 3").collect()}
    for i, t in rows:
        if i != 3:
            assert found[i] == pytest.approx(model.score(t.encode()))
    assert found[1] > found[0] + 2  # learned from twice
