"""Texts encoded word by word against the libraries' plain calls, and near copies in large groups."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sievestone.llm import bpe, minhash, planes
from sievestone.llm.shared import components

RANKS, TOKENIZER = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")


def odd_texts(seed, n=400):
    rnd = random.Random(seed)
    pieces = [" ", " ", " ", "  ", "\n", "\t", " ", " ", "\x1c", "\x85", " \n", "\r\n", "the", "The", "anblewh", "thththe", "don't", "it's", "été", "日本語", "🙂", "a.b", "x9", "2024", "...", "!", ",", ";:",
              "<|endoftext|>", "<|", "|>", "é", "\x00", "aaaaaaaaaaaaaaa", "ǅ", "٣"]
    return ["".join(rnd.choice(pieces) for _ in range(rnd.randint(0, 25))) for _ in range(n)] + [None, "", " ", "  ", "a", " a", "a ", "word " * 3000, "<|endoftext|>", "hi <|endoftext|> there"]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_ids_equal_the_plain_calls(seed):
    texts = odd_texts(seed)
    plain = Tokenizer.from_file(TOKENIZER)
    ranks = bpe.load_ranks(RANKS)
    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    with open(TOKENIZER, encoding="utf-8") as file:
        tokens = planes.Tokens(file.read())
    encoder = bpe.Encoder(ranks, public_tokenizers.PATTERN)
    for part in (texts, texts[::-1], texts[:7], []):  # again, with words known by now
        column = pa.array(part, pa.string())
        ids, borders = tokens.encode(column)
        assert [ids[s:e].tolist() for s, e in zip(borders[:-1], borders[1:])] == [plain.encode(t or "", add_special_tokens=False).ids for t in part]
        ids, borders = encoder.encode(column)
        assert [ids[s:e].tolist() for s, e in zip(borders[:-1], borders[1:])] == [reference.encode_ordinary(t or "") for t in part]
        assert [encoder.decode(ids[s:e]) for s, e in zip(borders[:-1], borders[1:])] == [(t or "").encode() for t in part]


def test_a_table_of_known_words_starts_anew(monkeypatch):
    from sievestone.llm import words

    monkeypatch.setattr(words, "KEEP", 20)
    encoder = bpe.Encoder(bpe.load_ranks(RANKS), public_tokenizers.PATTERN)
    for seed in (4, 5):
        column = pa.array(odd_texts(seed, 50))
        ids, borders = encoder.encode(column)
        assert encoder.decode(ids) == "".join(t or "" for t in column.to_pylist()).encode()
        assert borders[-1] == len(ids)


def family(rnd, n, length=120):
    """Near copies of one text, each with one word of its own."""
    base = [f"w{rnd.randint(0, 10**6)}" for _ in range(length)]
    out = []
    for i in range(n):
        own = list(base)
        own[rnd.randrange(length)] = f"own{rnd.randint(0, 10**9)}"
        out.append(" ".join(own))
    return out


def test_a_family_and_strays(spark):
    """Edges handed on and parts dealt grow with the rows of a family, not with its square."""
    rnd = random.Random(7)
    handed = {}
    for n in (300, 1200):
        texts = family(rnd, n)
        stray = texts[0].split()
        for k in range(0, 60, 3):
            stray[k] = f"stray{k}"
        docs = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, " ".join(stray)])], "doc_id long, text string")
        found = minhash.near_duplicates(docs).collect()
        assert {r.component_id for r in found if r.doc_id < n} == {0} and [r.component_id for r in found if r.doc_id == n] == [n]
        rows = spark.createDataFrame([("k", i, 0 if i < n else n + 1, 0, 0) for i in range(n + 1)], "key string, rep long, component long, bits1 long, bits2 long")
        handed[n] = minhash._blocks(rows, 100).count()
    assert handed[1200] <= 5 * handed[300]


def test_blocks_meet_all_pairs_of_components(spark):
    """Every two rows of different components meet in some part, whatever the sizes."""
    for sizes in ((1, 1), (40, 3, 2), (5, 300), (90, 80, 70, 1)):
        comp = [c for c, n in enumerate(sizes) for _ in range(n)]
        rows = spark.createDataFrame([(1, i, c) for i, c in enumerate(comp)], "key long, rep long, component long")
        parts = {}
        for r in minhash._blocks(rows, 25).collect():
            parts.setdefault(r.part, []).append(r)
        met = {frozenset((x.rep, y.rep)) for own in parts.values() for x in own for y in own if x.rep != y.rep and (0 in (x.role, y.role) or x.role != y.role)}
        wanted = {frozenset((i, j)) for i in range(len(comp)) for j in range(i) if comp[i] != comp[j]}
        assert wanted <= met


def test_components_with_hubs(spark):
    links = [(0, i) for i in range(1, 3000)] + [(5000 + i, 5001 + i) for i in range(50)] + [(2999, 5000)]
    found = components(spark.createDataFrame(links, "a long, b long"))
    assert found.agg(F.count("*"), F.max("component")).first()[:] == (2999 + 51, 0)


def test_forest_of_a_large_bucket():
    import pandas as pd

    n = 200
    rows = pd.DataFrame({"key": 1, "part": 0, "rep": np.arange(n), "component": np.r_[np.zeros(150, int), np.arange(1, 51)], "role": np.r_[np.full(150, 2), np.zeros(50, int)], "bits1": 0, "bits2": 0})
    found = next(minhash._forest(iter([rows])))
    assert len(found) == 50 and set(found["a"]) | set(found["b"]) == set(range(51))
