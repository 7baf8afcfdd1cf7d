"""Language-model scores by prediction by partial matching over bytes.

The model is a trie of byte contexts. A text is its bytes, an unlimited row of border marks before and one border after them, so there are
257 symbols; a context is the up to ORDER symbols before. Escape estimation gives an unseen symbol the weight of the distinct symbols
that followed the context (plus what pruning took from it), and the next shorter context is asked with the symbols of the longer one
excluded. The shortest context escapes to equal shares of the symbols it lacks. For every context the probabilities add up to one.

`score` learns every gram of the whole corpus, however rare, and no task or driver holds that trie. All contexts that end in the same SHARED
symbols go to one part, with every longer gram that follows them, so a part builds its own branch of the trie exactly; the grams shorter than
that (at most 257 ** SHARED) go to all. A slice of texts sends each part its distinct grams with their learned counts, gets back one
probability for each, and adds them up over its texts. `train` gives the trie of a small corpus as one object on the driver.
`adaptive_length` is the other mode: the trie starts empty and grows with the text itself.

Beside the model, `score` gives a base line: words with add-one counts. Words that are at least one in WORD_SHARE of the learned tokens go
to the tasks as a table of at most WORD_SHARE numbers; the others join by shuffle, and none of them can be a hot key.

Edge cases: null and empty texts are one end token and one border; a null doc_id counts as the empty text (learned from) and comes back
null; repeated rows are scored and learned from each; without anything to learn from, every symbol has probability 1/257; other columns
are left out.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from math import log10

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievestone.llm.shared import group_arrow, map_arrow, mix, slices, text_bytes, word_hashes
from sievestone.session import cut_lineage

ORDER, WORD_SHARE = 5, 1 << 21
WIDTH, BORDER, SYMBOLS = 9, 256, 257
SLICE = 4 << 20
#: Symbols of a context that settle its part; a part takes the grams of about PART_BYTES of text (fewer, as a slice sends equal ones once).
SHARED, PART_BYTES, LEAST_PARTS = 3, 32 << 20, 32
#: The end of a text as a token; no word has this hash but by chance of one in 2**64.
END = int(mix(np.array([1], np.uint64)).view(np.int64)[0])
WORD, GRAM = 0, 1


def grams(data: np.ndarray, borders: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """(gram of `order` + 1 symbols that ends there, text) for every symbol of the texts and the border after each."""
    n = len(borders) - 1
    sizes = np.diff(borders)
    symbols = np.full(len(data) + n * (order + 1), BORDER, np.uint16)
    owner = np.repeat(np.arange(n), sizes)
    symbols[np.arange(len(data)) + owner * (order + 1) + order] = data
    code = np.zeros(len(symbols) - order, np.uint64)
    for k in range(order + 1):
        code <<= np.uint64(WIDTH)
        code |= symbols[k:len(symbols) - order + k]
    owner = np.repeat(np.arange(n), sizes + 1)
    return code[np.arange(len(owner)) + owner * order], owner


def _counts(order: int):
    """Counted words (hashes) and longest grams of each slice of rows (text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 0, SLICE)):
            data, borders = text_bytes(batch.column(0))
            words, n = np.unique(word_hashes(data, borders)[0], return_counts=True)
            for kind, key, n in ((WORD, words.view(np.int64), n), (WORD, np.array([END]), np.array([batch.num_rows])), (GRAM, *np.unique(grams(data, borders, order)[0].view(np.int64), return_counts=True))):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), kind, np.int32)), pa.array(key), pa.array(n.astype(np.int64))], names=["kind", "key", "n"])

    return run


class Trie:
    """A pretrained trie: by order, sorted grams with counts, and contexts with what scoring needs."""

    def __init__(self, order: int, found: dict[int, tuple[np.ndarray, np.ndarray]], texts: int, totals: dict[int, tuple[np.ndarray, np.ndarray]] | None = None):
        """`found`: (sorted grams, counts) by order, with the shorter forms of every gram among them. `totals`: (sorted contexts, symbols that
        followed them) by order, where `found` is a branch and lacks the counts of contexts as grams."""
        self.order, self.grams, self.logs, self.contexts = order, [], [], []
        self.counts: list[np.ndarray] = []
        for k in range(order + 1):
            keys, n = found.get(k, (np.zeros(0, np.uint64), np.zeros(0, np.int64)))
            self.grams.append(keys)
            self.counts.append(n.astype(np.float64))
            self.logs.append(_log(self.counts[k]))
            context, first, distinct = np.unique(keys >> np.uint64(WIDTH), return_index=True, return_counts=True)
            kept = np.add.reduceat(self.counts[k], first) if len(first) else np.zeros(0)
            if k == 0:
                total = np.full(len(context), float(found["symbols"]))
            elif totals is not None:
                total = totals[k][1][np.searchsorted(totals[k][0], context)].astype(np.float64)
            else:
                total = self._count(k - 1, context)
                total[context == _all_borders(k)] = texts
            lost = total - kept
            weight = lost + distinct
            if k == 0 and len(distinct) and distinct[0] == SYMBOLS:
                weight = lost
            before = {}
            if k:  # the next shorter context, without the symbols that follow this one
                shorter = context & np.uint64((1 << WIDTH * (k - 1)) - 1)
                at = np.searchsorted(self.contexts[k - 1]["key"], shorter)
                outer = {x: self.contexts[k - 1][x][at] for x in ("total", "distinct", "lost")}
                seen = np.add.reduceat(self._count(k - 1, keys & np.uint64((1 << WIDTH * k) - 1)), first) if len(first) else np.zeros(0)
                fresh = outer["distinct"] - distinct
                if k == 1:
                    fresh = np.where(outer["distinct"] == SYMBOLS, 0, fresh)
                own = outer["lost"] + fresh
                below = outer["total"] - seen + fresh
                before = {"below": _log(below), "out": np.where(own > 0, _log(own) - _log(below), 0.0)}
            self.contexts.append({"key": context, "total": total, "distinct": distinct.astype(np.float64), "lost": lost, "size": _log(total + weight - lost), "escape": _log(weight) - _log(total + weight - lost), **before})
        self.uniform = -log10(SYMBOLS - self.contexts[0]["distinct"][0]) if len(self.grams[0]) and len(self.grams[0]) < SYMBOLS else -log10(SYMBOLS)
        del self.counts  # every task holds a copy of the trie: only what `log10p` reads stays
        self.contexts = [{x: c[x] for x in ("key", "size", "escape", "below", "out") if x in c} for c in self.contexts]

    def _count(self, k: int, keys: np.ndarray) -> np.ndarray:
        at, known = _place(self.grams[k], keys)
        return np.where(known, self.counts[k][at] if len(self.grams[k]) else 0.0, 0.0)

    def log10p(self, codes: np.ndarray) -> np.ndarray:
        """log10 of the probability of the last symbol of each gram of the longest order, given the others."""
        out, left = np.zeros(len(codes)), np.arange(len(codes))
        inner = np.full(len(codes), -1)  # place of the context one longer, once one was found
        for k in range(self.order, -1, -1):
            own, contexts = codes[left] & np.uint64((1 << WIDTH * (k + 1)) - 1), self.contexts[k]
            place, there = _place(contexts["key"], own >> np.uint64(WIDTH))
            if not there.any():
                continue
            at, seen = _place(self.grams[k], own)
            start, seen = there & (inner[left] < 0), seen & there
            size, escape = contexts["size"][place], contexts["escape"][place]
            if k < self.order and len(self.contexts[k + 1]["key"]):
                longer = self.contexts[k + 1]
                u = np.maximum(inner[left], 0)
                size, escape = np.where(start, size, longer["below"][u]), np.where(start, escape, longer["out"][u])
            out[left] += np.where(seen, self.logs[k][at] - size, np.where(there, escape, 0.0))
            inner[left] = np.where(there, place, -1)
            left = left[~seen]
        out[left] += self.uniform
        return out


def _all_borders(k: int) -> np.uint64:
    return np.uint64(sum(BORDER << WIDTH * i for i in range(k)))


def _log(x: np.ndarray) -> np.ndarray:
    return np.log10(np.maximum(x, 1e-300))


def _place(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, found) of keys in a sorted table; a place is always inside the table unless it is empty."""
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


def _learned(docs: DataFrame) -> DataFrame:
    return docs.filter(~F.col("held_out")).select("text")


def count(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """(kind, key, n): counted words and grams of all texts of `docs`, as a table."""
    found = map_arrow(docs.select("text"), _counts(order), "kind int, key long, n long")
    return cut_lineage(found.groupBy("kind", "key").agg(F.sum("n").alias("n")))


def _by_order(counts: DataFrame, order: int, share: int | None) -> tuple[dict, int]:
    """(sorted grams and counts by order, number of texts) of counted grams; without `share`, all of them."""
    longest = counts.filter(F.col("kind") == GRAM)
    texts, symbols = longest.agg(F.sum(F.when(F.col("key").bitwiseAND((1 << WIDTH) - 1) == BORDER, F.col("n"))), F.sum("n")).first()
    if not symbols:
        return {"symbols": 0}, 0
    least = F.col("n") * share >= F.lit(symbols) if share else F.lit(True)
    orders = F.array(*[F.struct(F.lit(k).alias("k"), F.col("key").bitwiseAND((1 << WIDTH * (k + 1)) - 1).alias("key")) for k in range(order)])
    kept = longest.filter(least).select(F.lit(order).alias("k"), "key", "n")
    if order:
        shorter = longest.select(F.explode(orders).alias("o"), "n").groupBy("o.k", "o.key").agg(F.sum("n").alias("n"))
        kept = shorter.filter(least).unionByName(kept)
    k, keys, n = (kept.toArrow().column(c).to_numpy() for c in ("k", "key", "n"))
    found: dict = {"symbols": symbols}
    for o in range(order + 1):
        own = np.flatnonzero(k == o)
        own = own[np.argsort(keys[own])]
        found[o] = (keys[own].astype(np.uint64), n[own])
    return found, texts


def train(counts: DataFrame, order: int = ORDER, share: int | None = None) -> Trie:
    """The trie of all counted grams on the driver, or, for a corpus whose trie doesn't fit there, of at most `share` grams an order."""
    return Trie(order, *_by_order(counts, order, share))


def frequent_words(counts: DataFrame, share: int = WORD_SHARE) -> tuple[np.ndarray, np.ndarray, int, int]:
    """(sorted hashes, counts, tokens, distinct tokens): words with at least one in `share` of the tokens, so at most `share`."""
    words = counts.filter(F.col("kind") == WORD)
    total, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    own = words.filter(F.col("n") * share >= F.lit(total)).select("key", "n").toArrow()
    keys, n = own.column("key").to_numpy(), own.column("n").to_numpy()
    order = np.argsort(keys)
    return keys[order], n[order], total, distinct


def _branch(order: int, shared: int, short: dict, codes: np.ndarray, n: np.ndarray, share: int | None) -> Trie:
    """The trie of one part: sorted longest grams with learned counts, and the grams of the first `shared` orders of the whole corpus."""
    found, totals = {"symbols": short["symbols"]}, {}
    for k in range(order + 1):
        if k < shared:
            keys, many = short.get(k, (np.zeros(0, np.uint64), np.zeros(0, np.int64)))
        else:
            keys, back = np.unique(codes & np.uint64((1 << WIDTH * (k + 1)) - 1), return_inverse=True)
            many = np.bincount(back, n, len(keys)).astype(np.int64)
        context, first = np.unique(keys >> np.uint64(WIDTH), return_index=True)
        totals[k] = context, np.add.reduceat(many, first) if len(first) else many
        kept = many * share >= short["symbols"] if share else slice(None)
        found[k] = keys[kept], many[kept]
    return Trie(order, found, 0, totals)


def _part(codes: np.ndarray, shared: int, parts: int) -> np.ndarray:
    return (mix((codes >> np.uint64(WIDTH)) & np.uint64((1 << WIDTH * shared) - 1)) % np.uint64(parts)).astype(np.int64)


def _pack(x: np.ndarray) -> bytes:
    """The numbers by byte plane, compressed, after their bytes' count; `_unpack` turns it round."""
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T)
    return planes.size.to_bytes(8, "little") + pa.compress(planes, "zstd", asbytes=True)


def _unpack(data: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd"), np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).reshape(-1).view(kind)


def _pack_logs(logs: np.ndarray, n: np.ndarray) -> list[bytes]:
    """`logs` without loss: as count and whole where log10(n) - log10(whole) is the very number, else as it is."""
    whole = np.rint(10 ** (_log(n) - logs))
    fits = (n > 0) & (n < 1 << 32) & (whole < 1 << 32)
    fits &= _log(n) - _log(whole) == logs
    return [_pack(np.where(fits, n, 0).astype(np.uint32)), _pack(whole[fits].astype(np.uint32)), _pack(logs[~fits])]


def _unpack_logs(n: bytes, whole: bytes, rest: bytes) -> np.ndarray:
    n = _unpack(n, np.uint32).astype(np.float64)
    out, fits = _log(n), n > 0
    out[fits] -= _log(_unpack(whole, np.uint32).astype(np.float64))
    out[~fits] = _unpack(rest, np.float64)
    return out


def _pack_rows(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


_SENT = pa.schema([("part", pa.int64()), ("slice", pa.int64()), ("texts", pa.binary()), ("codes", pa.binary()), ("times", pa.binary())])


def _sent(order: int, shared: int, parts: int):
    """Of each slice of rows (row, doc_id, held_out, text): its rows as one value, dealt to a part, and for every part its distinct grams with
    how often the texts that are learned from hold them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 3, SLICE)):
            own = batch.column(0)[0].as_py()
            code, owner = grams(*text_bytes(batch.column(3)), order)
            learned = ~batch.column(2).fill_null(True).to_numpy(zero_copy_only=False)
            code, n = np.unique(code << np.uint64(1) | learned[owner], return_counts=True)
            n *= (code & np.uint64(1)).astype(np.int64)
            code, first = np.unique(code >> np.uint64(1), return_index=True)
            n = np.add.reduceat(n, first).astype(np.uint32)
            part = _part(code, shared, parts)
            by_part = np.argsort(part, kind="stable")
            there, first = np.unique(part[by_part], return_index=True)
            rows = [{"part": int(mix(np.array([own], np.uint64))[0] % np.uint64(parts)), "slice": own, "texts": _pack_rows(batch)}]
            for of_part, at in zip(there.tolist(), np.split(by_part, first[1:])):
                rows.append({"part": of_part, "slice": own, "codes": _pack(np.diff(code[at], prepend=np.uint64(0))), "times": _pack(n[at])})
            yield pa.RecordBatch.from_pylist(rows, _SENT)

    return run


_ASKED = pa.schema([("slice", pa.int64()), ("part", pa.int64()), ("texts", pa.binary()), ("n", pa.binary()), ("whole", pa.binary()), ("rest", pa.binary())])


def _asked(order: int, shared: int, share: int | None, short_of):
    """Of one part: its slices' rows as they came, and for every slice the log10 of the probability of each gram it sent."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.filter(table.column("texts").is_valid()).select(["slice", "part", "texts"]).to_pylist()
        sent = table.filter(table.column("codes").is_valid())
        if sent.num_rows:
            codes = [np.cumsum(_unpack(x.as_py(), np.uint64), dtype=np.uint64) for x in sent.column("codes")]
            ends = np.cumsum([len(x) for x in codes])
            code, back = np.unique(np.concatenate(codes), return_inverse=True)
            del codes
            n = np.bincount(back, np.concatenate([_unpack(x.as_py(), np.uint32) for x in sent.column("times")]), len(code)).astype(np.int64)
            known = n > 0
            logs = _branch(order, shared, short_of.value, code[known], n[known], share).log10p(code)
            for of_slice, part, at in zip(sent.column("slice").to_pylist(), sent.column("part").to_pylist(), np.split(back, ends[:-1])):
                rows.append({"slice": of_slice, "part": part, **dict(zip(("n", "whole", "rest"), _pack_logs(logs[at], n[at])))})
        return pa.Table.from_pylist(rows, _ASKED)

    return run


_SCORES = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, words array<long>, times array<long>"


def _scores(order: int, shared: int, parts: int, words_of):
    """Per row of a slice: the model's score, what frequent tokens give, and the other words with their counts."""

    def run(table: pa.Table) -> pa.Table:
        keys, counts, total, distinct = words_of.value
        base = np.log10(counts + 1.0) - log10(total + distinct + 1)
        logs = table.filter(table.column("n").is_valid()).sort_by("part").select(["n", "whole", "rest"])
        logs = np.concatenate([_unpack_logs(*(x.as_py() for x in packed)) for packed in zip(*logs.columns)])
        (texts,) = table.column("texts").drop_null()
        batch = pa.ipc.open_stream(texts.as_buffer()).read_next_batch()
        n = batch.num_rows
        data, borders = text_bytes(batch.column(3))
        code, owner = grams(data, borders, order)
        code, back = np.unique(code, return_inverse=True)
        value = np.empty(len(code))
        value[np.argsort(_part(code, shared, parts), kind="stable")] = logs
        score = np.bincount(owner, value[back], n)
        hashes, owner = word_hashes(data, borders)
        hashes, owner = np.concatenate([hashes.view(np.int64), np.full(n, END)]), np.concatenate([owner, np.arange(n)])
        hashes, code = np.unique(hashes, return_inverse=True)
        pair, many = np.unique(owner * len(hashes) + code, return_counts=True)
        owner, hashes = pair // len(hashes), hashes[pair % len(hashes)]
        at, known = _place(keys, hashes)
        of_base = np.where(known, base[at] if len(keys) else 0.0, 0.0)
        rare = np.flatnonzero(~known)
        ends = np.searchsorted(owner[rare], np.arange(n + 1)).astype(np.int32)
        lists = lambda x: pa.ListArray.from_arrays(pa.array(ends), pa.array(x[rare].astype(np.int64)))
        sums = lambda x: pa.array(np.bincount(owner, x, n))
        return pa.table(
            [*batch.columns[:3], pa.array(np.bincount(owner, many, n).astype(np.int64)), pa.array(np.bincount(owner, many * known, n).astype(np.int64)), sums(of_base * many), pa.array(score), lists(hashes), lists(many)],
            names=["row", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "words", "times"])

    return run


def score(docs: DataFrame, held_out: F.Column, order: int = ORDER, share: int | None = None, word_share: int = WORD_SHARE) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of `docs` (doc_id, text); the rows for which
    `held_out` holds are scored but not learned from. With `share`, grams below one in `share` of the symbols learned are pruned from the
    model; without it, as in the query, none are."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out.alias("held_out"))
    shared = min(SHARED, order)
    counts = count(_learned(docs), max(shared - 1, 0))
    short, words = _by_order(counts, max(shared - 1, 0), None)[0], frequent_words(counts, word_share)
    total, distinct = words[2], words[3]
    size = docs.agg(F.sum(F.octet_length("text") + F.lit(1).cast("long"))).first()[0] or 0
    parts = max(LEAST_PARTS, size // PART_BYTES)
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "held_out", "text")
    sent = map_arrow(numbered, _sent(order, shared, parts), "part long, slice long, texts binary, codes binary, times binary")
    asked = group_arrow(sent, "part", _asked(order, shared, share, spark.sparkContext.broadcast(short)), "slice long, part long, texts binary, n binary, whole binary, rest binary")
    scored = group_arrow(asked, "slice", _scores(order, shared, parts, spark.sparkContext.broadcast(words)), _SCORES)
    scored = cut_lineage(scored)
    rare = scored.select("row", F.explode(F.arrays_zip("words", "times")).alias("w")).select("row", F.col("w.words").alias("key"), F.col("w.times").alias("times"))
    learned = counts.filter((F.col("kind") == WORD) & (F.col("n") * word_share < F.lit(total))).select("key", "n")
    c = F.coalesce("n", F.lit(0))
    of_rare = rare.join(learned, "key", "left").groupBy("row").agg(
        F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("more_known"), F.sum(F.col("times") * (F.log10(c + 1) - F.lit(log10(total + distinct + 1)))).alias("more_base"))
    plus = lambda x, more: (F.col(x) + F.coalesce(more, F.lit(0))).alias(x)
    return scored.join(of_rare, "row", "left").select("doc_id", "held_out", "n_tokens", plus("n_known", "more_known"), F.lit(total).cast("long").alias("train_tokens"), plus("base_score", "more_base"), "score")


def adaptive_length(texts: DataFrame, order: int = ORDER) -> DataFrame:
    """(doc_id, bits) of every row (doc_id, text): code length in bits under a trie that starts empty and learns from the text alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = [_adaptive_bits((x.as_py() or "").encode(), order) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits, pa.float64())], names=["doc_id", "bits"])

    return map_arrow(texts.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, bits double")


def _adaptive_bits(data: bytes, order: int) -> float:
    seen: dict[bytes, Counter] = defaultdict(Counter)
    length = 0.0
    for i in range(len(data) + 1):
        symbol = data[i] if i < len(data) else BORDER
        out: set[int] = set()
        for k in range(min(order, i), -1, -1):
            follow = seen.get(data[i - k:i])
            if not follow:
                continue
            open_ = {s: n for s, n in follow.items() if s not in out}
            whole = sum(open_.values()) + len(open_)
            if not open_:
                continue
            if symbol in open_:
                length -= log10(open_[symbol] / whole)
                break
            if len(out) + len(open_) < SYMBOLS:
                length -= log10(len(open_) / whole)
            out |= open_.keys()
        else:
            length += log10(SYMBOLS - len(out))
        for k in range(min(order, i) + 1):
            seen[data[i - k:i]][symbol] += 1
    return length / log10(2)
