"""Operators of the training-data folder against brute force, round trips and odd input."""

import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sievestone.llm import archives, bpe, chat, decontaminate, minhash, planes, shards, toxicity, urls, vectors
from sievestone.llm.shared import LEAST_TASKS, components, read

SMALL = "/root/testdata/sf0.001"
RANKS, TOKENIZER = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")
#: Nulls, empty and blank texts, repeated rows, a clashing extra column.
ODD = [(1, None, "x"), (2, "", "x"), (3, " \n\t ", None), (4, "one two", "x"), (5, "ONE  two", "x"), (6, "a b c d e f g", "x"), (6, "a b c d e f g", "x"), (None, "a b c d e f g", "x"),
       (7, "word " * 30_000, "x"), (8, "é" * 5000 + " 日本 🙂", "x")]


def odd(spark, rows=ODD):
    return spark.createDataFrame(rows, "doc_id long, text string, kept string")


def brute_components(rows, size=4):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k:k + size]) for k in range(len(w) - size + 1)} or ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    keys = sorted(sets)
    for a in keys:
        for b in keys:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_components(spark):
    links = spark.createDataFrame([(1, 2), (3, 2), (9, 8), (8, 7), (7, 6), (5, 5)], "a long, b long")
    assert {(r[0], r[1]) for r in components(links).collect()} == {(2, 1), (3, 1), (9, 6), (8, 6), (7, 6)}
    assert components(links.limit(0)).count() == 0


def test_components_of_few_links_take_few_tasks(spark):
    """A chain, a star and a pair give the same classes in a few tasks, however many shuffle partitions the session has."""
    chain = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(10, 60)] + [(3, 2), (3, 2), (5, 5)]
    settings = {"spark.sql.shuffle.partitions": "48", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        found = components(spark.createDataFrame(chain, "a long, b long"))
        assert found.rdd.getNumPartitions() <= LEAST_TASKS
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert {(r[0], r[1]) for r in found.collect()} == {(i, 100) for i in range(101, 141)} | {(i, 7) for i in range(10, 60)} | {(3, 2)}


def test_chat_round_trip(spark):
    rnd, pieces = random.Random(5), ["<s>", "</s>", "[ROLE]", "[TEXT]", "[NEXT]", "[INST]", "\\", "<", "[", "<\\s>", "x", "\n", "<|im_end|>", "<<SYS>>", "é"]
    word = lambda: "".join(rnd.choice(pieces) for _ in range(rnd.randint(0, 6)))
    rows = [(c, t, rnd.choice(["user", "assistant", None, word()]), rnd.choice([None, word(), word()])) for c in range(60) for t in range(rnd.randint(1, 7))] + [(None, 1, "user", "x"), (0, None, "user", "y")]
    done = chat.read_back(chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()
    by = {}
    for c, t, r, x in sorted(rows, key=lambda v: (v[1] is not None, v[1] or 0)):
        by.setdefault(c, []).append((r or "", x or ""))
    assert {d["conv_id"]: [(t["role"], t["text"]) for t in d["turns"]] for d in done} == by
    assert all(d["trained"] == "".join(x for r, x in by[d["conv_id"]] if r == "assistant") for d in done)
    assert all(sum(m["chars"] for m in d["mask"]) + len("</s>") == len(d["formatted"]) for d in done)
    assert chat.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


@pytest.mark.parametrize("wrong", ["chars + 1", "chars - 1", "swapped"])
def test_chat_mask_must_fit(spark, wrong):
    rows = [(1, 1, "user", "hello"), (1, 2, "assistant", "good day"), (1, 3, "user", "bye"), (1, 4, "assistant", "see you")]
    done = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert [r.trained for r in chat.read_back(done).collect()] == ["good daysee you"]
    moved = {"chars + 1": lambda m, i: F.struct((m["chars"] + F.when(i == 2, 1).otherwise(0)).alias("chars"), m["loss"].alias("loss")),
             "chars - 1": lambda m, i: F.struct((m["chars"] - F.when(i == 3, 1).otherwise(0)).alias("chars"), m["loss"].alias("loss")),
             "swapped": lambda m, i: F.struct(m["chars"].alias("chars"), F.when(i < 4, ~m["loss"]).otherwise(m["loss"]).alias("loss"))}[wrong]
    with pytest.raises(Exception, match="loss mask"):
        chat.read_back(done.withColumn("mask", F.transform("mask", moved))).collect()


def test_tiles_catch_reordered_passages(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda my".split()
    ids = {w: i for i, w in enumerate(item)}
    text = np.array([ids.get(w, -1) for w in ["x", *item[6:], "y", *item[:6], "z"]])
    assert sorted(decontaminate.tiles(np.arange(12), text, 5)) == [(0, 8, 6), (6, 1, 6)]
    docs = odd(spark, [*ODD, (20, "Well: " + " ".join(item[6:]) + ". And " + " ".join(item[:6]), "x"), (21, " ".join(item[:6]) + " other words", "x")])
    benchmark = spark.createDataFrame([(1, " ".join(item)), (2, None), (3, ""), (4, "two words")], "item_id long, text string")
    assert [(r.doc_id, r.item_id, r.coverage) for r in decontaminate.contaminated(docs, benchmark).collect()] == [(20, 1, 1.0)]
    left = decontaminate.drop_contaminated(docs, benchmark)
    assert left.columns == docs.columns and left.count() == docs.count() - 1
    assert decontaminate.contaminated(docs, benchmark.limit(0)).count() == 0 and decontaminate.contaminated(docs.limit(0), benchmark).count() == 0


def test_tiles_against_every_leak(spark):
    docs, items = read(spark, SMALL, "documents").collect(), read(spark, SMALL, "benchmark").collect()
    plain = lambda t: " " + " ".join(decontaminate.words_of(t)) + " "
    leaks = {(d.doc_id, i.item_id) for d in docs for i in items if plain(i.text) in plain(d.text)}
    found = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(read(spark, SMALL, "documents"), read(spark, SMALL, "benchmark")).collect()}
    assert leaks and leaks <= found


def test_minhash_against_brute_force(spark):
    rnd, words = random.Random(2), [f"w{k}" for k in range(400)]
    rows, base = [], [rnd.choice(words) for _ in range(120)]
    for i in range(90):
        own = list(base)
        for _ in range(rnd.randint(0, 7)):
            own[rnd.randrange(120)] = rnd.choice(words)
        rows.append((i, " ".join(own)))
    rows += [(100 + i, rows[i % 5][1]) for i in range(40)] + [(i, t) for i, t, _ in ODD if i in (2, 3, 4, 5, 8)]
    rows = [(i + 1000 if i < 10 and t in ("", None) else i, t) for i, t in rows]
    table = {i: t for i, t in rows}
    out = minhash.near_duplicates(spark.createDataFrame(list(table.items()), "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == brute_components(table.items())
    assert all(r.kept == (r.doc_id == r.component_id) for r in out)


def test_minhash_odd_rows(spark):
    out = minhash.near_duplicates(odd(spark)).collect()
    assert len(out) == len(ODD)
    assert {(r.doc_id, r.component_id, r.kept) for r in out if r.doc_id in (1, 2, 3, 4, 6, None)} == {(1, 1, True), (2, 2, True), (3, 3, True), (4, 4, True), (6, 6, True), (None, None, True)}
    assert {r.component_id for r in out if r.doc_id == 5} == {4}
    assert minhash.near_duplicates(odd(spark).limit(0)).count() == 0


@pytest.mark.parametrize("limit", [1, 1000, 50_000, 10**9])
def test_shards_fit(spark, limit):
    rows = shards.shard_rows(read(spark, SMALL, "documents").withColumn("bits", F.lit(1)), limit).collect()
    sums = {}
    for r in rows:
        sums.setdefault(r.shard, []).append(r.n_bytes)
        assert len(r.shard) == r.depth
    assert len(rows) == 200 and len({r.doc_id for r in rows}) == 200
    assert all(sum(v) == r.shard_bytes and len(v) == r.shard_rows for r in rows for v in [sums[r.shard]])
    assert all(r.shard_bytes <= limit if r.fits else r.shard_rows == 1 for r in rows)
    names = sorted(sums)
    assert not any(b.startswith(a) for a, b in zip(names, names[1:]))


def test_shards_odd_rows(spark):
    rows = shards.shard_rows(odd(spark), 20).collect()
    assert len(rows) == len(ODD) and len({r.shard for r in rows if r.doc_id == 6}) == 1
    assert shards.shard_rows(odd(spark).limit(0), 20).count() == 0


def test_vectors_against_brute_force(spark):
    own = np.random.default_rng(1)
    centres = own.normal(size=(40, 16))
    x = centres[own.integers(0, 40, 1500)] + own.normal(size=(1500, 16)) * 0.28
    rows = [(i, v.tolist(), int(i % 2)) for i, v in enumerate(x)] + [(2000 + i, x[0].tolist(), 0) for i in range(3)]
    rows += [(3000, None, 0), (3001, [0.0] * 16, 0), (3002, [float("nan")] * 16, 0), (3003, x[0].tolist(), None), (3004, [None] * 16, 0), (3005, [], 1), (3006, [1.0, 2.0], 1)]
    out = {r.vec_id: r for r in vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    good = [(i, np.array(v, np.float32).astype(float), l) for i, v, l in rows if i < 3000]
    unit = np.stack([v / np.linalg.norm(v) for _, v, _ in good])
    label = np.array([l for _, _, l in good])
    near = (unit @ unit.T >= 0.93) & (label[:, None] == label)
    found, true = sum(out[i].n_links for i, _, _ in good), int(near.sum()) - len(good)
    assert len(out) == len(rows) and 0.9 * true <= found <= true
    assert all(out[i].n_links <= near[k].sum() - 1 for k, (i, _, _) in enumerate(good))
    assert all(out[i].n_links == 0 and out[i].component_id == i for i in range(3000, 3007))
    assert out[2001].component_id == 0 and not out[2001].kept


@pytest.mark.parametrize("width", [8, 64])
def test_vectors_lose_no_link(spark, width):
    own = np.random.default_rng(6)
    spread = np.arange(1, width + 1) ** (-1.0 if width > 8 else 0.0)
    x, step = own.normal(size=(2000, width)) * spread, own.normal(size=(2000, width)) * spread
    x /= np.linalg.norm(x, axis=1)[:, None]
    step -= (step * x).sum(axis=1)[:, None] * x
    cos = own.uniform(0.93, 0.96, 2000)[:, None]
    x = np.concatenate([x, cos * x + np.sqrt(1 - cos**2) * step / np.linalg.norm(step, axis=1)[:, None]]).astype(np.float32)
    out = vectors.near_vectors(spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")).orderBy("vec_id").collect()
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    near = unit @ unit.T >= 0.93
    root, low = np.arange(len(x)), None
    while low is None or (low != root).any():
        low, root = root, np.where(near, root, len(x)).min(axis=1)
    assert [r.n_links for r in out] == (near.sum(axis=1) - 1).tolist()
    assert [r.component_id for r in out] == root.tolist()


def test_vectors_empty(spark):
    assert vectors.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_bpe_equals_tiktoken(spark):
    ranks = bpe.load_ranks(RANKS)
    theirs = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rnd = random.Random(4)
    texts = ["".join(rnd.choice(" \n\tab'sé日🙂1,. \x1c　xyzTHE the") for _ in range(rnd.randint(0, 40))) for _ in range(500)] + ["", None, "ab" * 20_000, "日" * 999, " " * 500]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    encoded = bpe.encode(docs, RANKS, public_tokenizers.PATTERN)
    assert all(r.ids == struct.pack(f"<{len(e)}I", *e) for r in encoded.collect() for e in [theirs.encode_ordinary(texts[r.doc_id] or "")])
    assert all(r.bytes == (texts[r.doc_id] or "").encode() for r in bpe.decode(encoded, RANKS, public_tokenizers.PATTERN).collect())
    trip = bpe.round_trip(odd(spark), RANKS, public_tokenizers.PATTERN)
    assert trip.count() == len(ODD) and bpe.round_trip(odd(spark).limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


@pytest.mark.parametrize("kind", ["bit", "byte"])
def test_planes_round_trip(kind):
    own = np.random.default_rng(3)
    counts = [0, 70_000, 1, 0, 90_000]
    ids = own.integers(0, 1 << 32, sum(counts), dtype=np.uint64).astype("<u4")
    back = list(planes.read_shard(planes.write_shard([1, 2, None, 4, 5], counts, ids, kind) + b"\n"))
    assert [(d, len(x)) for d, x in back] == [(1, 0), (2, 70_000), (None, 1), (4, 0), (5, 90_000)]
    assert np.array_equal(np.concatenate([x for _, x in back]), ids)


def test_planes_equal_tokenizer(spark):
    docs = read(spark, SMALL, "documents").select("doc_id", "text").unionByName(odd(spark, [(r[0] + 1000, *r[1:]) for r in ODD if r[0] and r[0] != 6]).select("doc_id", "text"))
    tokenizer = Tokenizer.from_file(TOKENIZER)
    out, at = planes.written_and_read(docs, TOKENIZER, 2).orderBy("doc_id").collect(), 0
    for row, own in zip(docs.orderBy("doc_id").collect(), out, strict=True):
        ids = [*tokenizer.encode(row.text or "", add_special_tokens=False).ids, 2]
        assert (own.doc_id, own.start, own.n_tokens, own.ids_crc32) == (row.doc_id, at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        at += len(ids)


def test_archives(spark):
    rows = [(1, "http://a/ b\n", "x" * 1500), (2, "http://a/c", "x" * 1500), (3, None, "short"), (4, "http://d", "short"), (5, "http://e", None), (6, "http://f", "é\r\n\r\nWARC/1.1 \n" * 200), (2, "http://a/c", "x" * 1500), (None, "http://g", "x" * 1500)]
    out = archives.archived(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted((str(r.page_id), r.record_type, str(r.refers_to)) for r in out) == sorted([("1", "revisit", "2"), ("2", "response", "None"), ("2", "response", "None"), ("None", "revisit", "2"), *[(str(i), "response", "None") for i in (3, 4, 5, 6)]])
    import hashlib
    assert all(r.payload_bytes == len(p) and r.payload_digest == hashlib.sha1(p).hexdigest() for r in out for p in [({i: h for i, _, h in rows}[r.page_id] or "").encode()])
    for version in (1, 2):
        data = archives.arc_version_block("n", version) + archives.arc_record(7, "http://u", b"a\n\nb", version, 0, "n")
        assert [(u, h["x-page-id"], p) for u, _, h, p in archives.parse_arc(data)] == [("http://u", "7", b"a\n\nb")]


def test_toxicity(spark):
    docs, labels = read(spark, SMALL.replace("0.001", "0.1"), "documents"), read(spark, SMALL.replace("0.001", "0.1"), "labels")
    out = toxicity.score_toxicity(docs, labels).join(labels, "doc_id").filter("held_out").toPandas()
    assert (out["predicted"] == out["toxic"]).mean() > 0.97 and out[out["toxic"] == 1]["predicted"].mean() > 0.85
    assert toxicity.fold("1D10T! іdiot") == " idiot idiot "
    odd_rows = toxicity.score_toxicity(odd(spark), labels).collect()
    assert len(odd_rows) == len(ODD) and all(0 <= r.score <= 1 for r in odd_rows)
    assert {r.predicted for r in toxicity.score_toxicity(odd(spark), labels.limit(0)).collect()} == {0}
    left = toxicity.drop_toxic(odd(spark), labels)
    assert left.columns == ["doc_id", "text", "kept"] and left.count() == len(ODD)


def test_urls(spark):
    html = '<link rel="canonical" href="/es/9">'
    rows = [(1, "http://www.Example.org/es/1#x", None), (2, "http://a.net/x", html.replace("/es/9", "http://example.org/es/1")), (3, "http://b.net/y", '<meta http-equiv=refresh content="0; url=http://a.net/x">'),
            (4, "http://c.net/z", None), (5, None, html), (6, "no scheme", html), (7, "http://d.org/q", '<link href="http://c2.net/" rel=canonical>'), (8, "http://c2.net/", None), (2, "http://a.net/x", None)]
    moved = spark.createDataFrame([("http://c2.net/", "http://example.org/es/2"), (None, "x")], "source string, target string")
    out = {(r.page_id, r.verdict, r.rule) for r in urls.judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string"), redirects=moved).collect()}
    assert out == {(1, "block", "example.org/es/"), (2, "block", None), (3, "block", None), (4, "allow", None), (5, "allow", None), (6, "allow", None), (7, "allow", "org/"), (8, "allow", None)}


def test_url_links(spark):
    targets = {
        "page2.html": "http://a.net/f/page2.html", "?id=3": "http://a.net/f/g?id=3", "../x": "http://a.net/x", "./x/./y/..": "http://a.net/f/x/", "../../../x": "http://a.net/x", ".": "http://a.net/f/",
        "/login?next=http://x": "http://a.net/login?next=http://x", "/a/../b?p=../c": "http://a.net/b?p=../c", "//B.net/x": "http://b.net/x", "HTTP://B.Net/X#y": "http://b.net/X", "/x?a=1&amp;b=2": "http://a.net/x?a=1&b=2",
        "&#x2F;x": "http://a.net/x", "/x?a=&amp;lt;": "http://a.net/x?a=&lt;", "#top": "http://a.net/f/g?q=1", "mailto:x": "mailto:x", "http://b.net": "http://b.net"}
    html = "".join(f'<link rel="canonical" href="{link}">' for link in targets)
    pages = spark.createDataFrame([(1, "HTTP://A.net/f/g?q=1#z", html)], "page_id long, url string, html string")
    assert [tuple(r) for r in urls.page_links(pages).collect()] == [("http://a.net/f/g?q=1", t) for t in targets.values()]


def test_relative_urls_share_blocks(spark):
    canonical = lambda to: f'<link rel="canonical" href="{to}">'
    rows = [(1, "http://example.org/en/1?a=1&b=2", None), (2, "http://example.org/x/y", canonical("../en/1?a=1&amp;b=2")), (3, "http://example.org/x/z", '<meta http-equiv="refresh" content="0;url=y">'),
            (4, "http://Example.ORG/x/z?id=3", canonical("?id=4")), (5, "http://example.net/x/z?id=4", canonical("http://EXAMPLE.org/x/z")), (6, "http://EXAMPLE.net/w", '<base href="/x/"><meta http-equiv="refresh" content="0;url=z?id=4">'),
            (7, "http://b.net", canonical("c")), (8, "http://b.net/c", canonical("/login?next=http://example.org/en/1?a=1&b=2")), (9, "x", canonical("http://example.org/x/y")), (10, "y", canonical("x"))]
    out = {r.page_id: r.verdict for r in urls.judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string"), rules=[("block", "example.org", "/en/1")]).collect()}
    assert out == {1: "block", 2: "block", 3: "block", 4: "allow", 5: "block", 6: "block", 7: "allow", 8: "allow", 9: "block", 10: "allow"}


def test_archives_are_gzipped_at_the_fastest_level(spark, tmp_path):
    texts = [" ".join(f"w{i * k % 977}" for i in range(4000)) for k in range(1, 20)]
    archives.write_arc(spark.createDataFrame([(k, "http://a", t) for k, t in enumerate(texts)], "page_id long, url string, html string").coalesce(1), str(tmp_path / "arc"))
    files = [f.read_bytes() for f in (tmp_path / "arc").rglob("*.gz")]
    plain = [zlib.decompress(f, 31) for f in files]
    assert len(files) == 1 and [p.decode() for *_, p in archives.parse_arc(plain[0])] == texts
    assert len(files[0]) > 1.02 * len(zlib.compress(plain[0], 6))
