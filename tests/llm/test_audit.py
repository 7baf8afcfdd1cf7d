"""The divergence audit against brute force."""

import random
import re
from collections import Counter, defaultdict

import pytest

from sievestone.llm import audit


def brute(rows, least, top):
    cut = lambda t: re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
    held, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, lang, source, text in rows:
        lang, source, own = lang or "", source or "", Counter(cut(text))
        groups[lang].add(source)
        held[lang].update(own.keys())
        counts[lang, source].update(own)
    out = set()
    for lang, sources in groups.items():
        kept = [t for t, n in held[lang].items() if n >= least]
        n = {s: sum(counts[lang, s][t] for t in kept) for s in sources}
        share = lambda c, of: 1 + 10**9 * (c + 5) // (of + 5 * len(kept))
        p = {s: {t: share(counts[lang, s][t], n[s]) for t in kept} for s in sources}
        q = {t: share(sum(counts[lang, s][t] for s in sources), sum(n.values())) for t in kept}
        for s in sources:
            pairs = [(-sum(abs(p[s][t] - p[u][t]) for t in kept), u.encode()) for u in sources if u != s]
            terms = [(q[t] - p[s][t], t.encode()) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out |= {(lang, s, part, item.decode(), -v, k + 1) for k, (v, item) in enumerate(found)}
    return out


def rows(seed, sources):
    rnd = random.Random(seed)
    base = ["the", "The", "cat-cat", "(the", "l'été", "日本", "x9y", "mat,", "the.", "42", "dog", "DOG!", "\x0bedge\x0c"]
    line = lambda: rnd.choice([" ", "\n", "\t", "  "]).join(rnd.choice(base) + rnd.choice(["", "", "", "-" + rnd.choice("abcdefg")]) for _ in range(rnd.randint(0, 25)))
    made = [(i, rnd.choice(["en", "de", None]), rnd.choice(sources), line()) for i in range(150)]
    made += [(1, "en", "s0", None), (2, "en", "quiet", ""), (2, "en", "quiet", ""), (None, "fr", None, "the the"), (3, "nl", "alone", " \n ")]
    return made + [(200 + i, "en", "s0", "same words here") for i in range(10)] + [(300, "de", "s1", "word-" * 20_000)]


@pytest.mark.parametrize("least,top,sources", [(10, 50, ["s0", "s1", "s2", None]), (3, 4, [f"w{i}" for i in range(70)] + ["été", "Z"]), (1000, 5, ["a", "b"])])
def test_equals_brute_force(spark, least, top, sources):
    made = rows(least, sources)
    docs = spark.createDataFrame([(*r, "x") for r in made], "doc_id long, lang string, source string, text string, value string").repartition(3)
    assert {tuple(r) for r in audit.divergence(docs, least, top).select("lang", "source", "part", "item", "value", "rank").collect()} == brute(made, least, top)


def test_empty_table(spark):
    assert audit.divergence(spark.createDataFrame([], "doc_id long, lang string, source string, text string")).count() == 0
