"""Ranked search against scoring every document."""

import random
import re
from collections import Counter
from math import floor, log

import numpy as np
import pytest

from sievestone.llm import treaps


def terms(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", lower)


def brute(docs, items, top):
    cut = [(i, Counter(terms(t))) for i, t in docs]
    cut = [(i, c) for i, c in cut if c]
    texts, total = len(cut), sum(c.total() for _, c in cut)
    df = Counter(t for _, c in cut for t in c)
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(terms(t))
    out = {}
    for item, own in wanted.items():
        scored = []
        for i, c in cut:
            m = 10 + 90 * c.total() * texts // total
            s = sum(floor(1000 * log((2 * texts + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in own if c[t])
            if s:
                scored.append((-s, i is not None, i or 0, i))
        if scored:
            out[item] = [(i, -s) for s, _, _, i in sorted(scored)[:top]]
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_tree_holds_the_grid(seed):
    rnd = np.random.default_rng(seed)
    grid = np.where(rnd.random((37, 21)) < 0.2, rnd.integers(1, 9, (37, 21)), 0)
    rows, columns = np.nonzero(grid)
    nodes, quadrants, maxima = treaps.grow(rows, columns, grid[rows, columns], 6)
    tree, own, weights = treaps.Treap(nodes, quadrants, maxima), np.array([3, 5, 36, 0]), np.array([2, 1, 4, 0])
    scores = weights @ grid[own]
    order = [c for c in np.lexsort((np.arange(21), -scores)) if scores[c] > 0]
    for top in (1, 4, 50):
        found = tree.best(own, weights, top)
        assert found[0].tolist() == order[:top] and found[1].tolist() == scores[order[:top]].tolist()


@pytest.mark.parametrize("block", [1, 300, 1 << 20])
def test_equals_brute_force(spark, block):
    rnd = random.Random(block)
    words = ["The", "cat", "sat", "été", "x1", "日本", "rare%d", "dog"]
    line = lambda n: " ".join(rnd.choice(words).replace("%d", str(rnd.randint(0, 50))) + rnd.choice(["", ",", "."]) for _ in range(n))
    docs = [(i, line(rnd.randint(1, 30))) for i in rnd.sample(range(1000), 120)]
    docs += [(2000 + i, "twin text of the cat") for i in range(25)] + [(2000, "twin text of the cat")] * 2  # ties and repeated rows
    docs += [(None, "cat"), (5000, None), (5001, ""), (5002, " ,. "), (5003, "cat " * 20_000)]
    items = [(1, "the cat, twin"), (2, "RARE3 rare4 x1"), (3, None), (4, "unheard"), (5, "日本 été"), (5, "dog"), (None, "sat"), (6, line(60))]
    rnd.shuffle(docs)
    table = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, score string").repartition(3)
    found = {}
    rows = treaps.ranked(table, spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, rank int"), 10, block_bytes=block).collect()
    for r in sorted(rows, key=lambda r: r["rank"]):
        found.setdefault(r.item_id, []).append((r.doc_id, r.score))
        assert r["rank"] == len(found[r.item_id])
    assert found == brute(docs, items, 10)


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "cat")], "doc_id long, text string"), spark.createDataFrame([(1, "cat")], "item_id long, text string")
    assert treaps.ranked(docs.limit(0), items).count() == 0
    assert treaps.ranked(docs, items.limit(0)).count() == 0
    assert [tuple(r) for r in treaps.ranked(docs, items).collect()] == [(1, 1, 1, floor(1000 * log(4 / 3)) * (10**9 // (1000 + 8 * 100)))]
