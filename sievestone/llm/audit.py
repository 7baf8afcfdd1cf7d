"""Which words set a source apart from its language: a divergence audit by chunk factorization.

Texts are cut at white space into chunks, which repeat far more often than texts do. Slices of documents count in how many documents of a
language a chunk stands; each globally distinct chunk is cut into terms once, and its terms are joined back to the counts. A chunk in at
least `least` documents of a language proves all its terms. A term whose chunks add up to fewer documents is out. What is left are a
few terms in several rare chunks of which some documents may hold two: their documents are counted distinctly. Then the texts are
counted by source, only the chunks that hold a term still in question or proven: a Bloom filter of fixed size tells them in the
tasks, and the join on the chunk drops what it let through by chance. No list grows with the corpus and no step is cut off.

A language keeps the terms in at least `least` of its documents. Every source of the language gives each kept term a share
p = 1 + floor(SCALE * (count + PLUS) / (N + PLUS * V)). Two sources differ by the sum of abs(p - q) over all kept terms: their counts meet in
blocks of sources and slices of terms, and only sums leave a block. Terms that neither holds follow from a product.

Edge cases: null text, language and source are ''; a source or language without kept terms still has its pairs (value 0 where the language keeps
none); every row is a document of its own, also repeated ones and those with a null doc_id; an empty table gives no rows; other columns
are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievestone.llm.shared import PIECE_BYTES, ROOT, map_arrow, mix, powers, scratch, ship, slices, text_bytes
from sievestone.session import cut_lineage

LEAST, SCALE, PLUS, TOP = 30, 10**9, 5, 50
SLICE, SOURCES, TERMS = 16 << 20, 64, 4096
#: Fixed by the contract: what a term is made of.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLOOM_BITS = 1 << 26


def hashes(strings: pa.Array) -> np.ndarray:
    """A 64-bit hash of each string."""
    out = np.zeros(len(strings), np.uint64)
    data, borders = text_bytes(strings)
    at = 0
    while at < len(strings):
        to = max(at + 1, int(np.searchsorted(borders, borders[at] + PIECE_BYTES, "right")) - 1)
        own = data[borders[at]:borders[to]]
        up, down = powers(len(own) + 1)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((own.astype(np.uint64) + np.uint64(1)) * up[:len(own)])])
        cuts = borders[at:to + 1] - borders[at]
        out[at:to] = mix((total[cuts[1:]] - total[cuts[:-1]]) * down[cuts[:-1]])
        at = to
    return out


def _places(chunks: np.ndarray, langs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two bits of the filter for hashes of chunks and their languages."""
    both = mix(chunks + mix(langs + np.uint64(ROOT)))
    return (both & np.uint64(BLOOM_BITS - 1)).astype(np.int64), (both >> np.uint64(34) & np.uint64(BLOOM_BITS - 1)).astype(np.int64)


def _filter_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = np.unique(np.concatenate(_places(hashes(batch.column(0)), hashes(batch.column(1)))))
        first = _runs(at >> 6)
        bits = np.bitwise_or.reduceat(np.uint64(1) << (at & 63).astype(np.uint64), first) if len(first) else np.zeros(0, np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array((at >> 6)[first]), pa.array(bits.view(np.int64))], names=["word", "bits"])


def bloom(keys: DataFrame) -> np.ndarray:
    """A Bloom filter of (chunk, lang), made by the tasks; BLOOM_BITS bits reach the driver, however many keys there are."""
    words = map_arrow(keys.select("chunk", "lang"), _filter_words, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(BLOOM_BITS // 64, np.uint64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return out


def _in(filter_words: np.ndarray, places: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    a, b = (filter_words[p >> 6] >> (p & 63).astype(np.uint64) & np.uint64(1) for p in places)
    return (a & b).astype(bool)


def _codes(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    known = column.dictionary_encode()
    return known.indices.to_numpy().astype(np.int64), known.dictionary


def _runs(key: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    return np.flatnonzero(np.concatenate([np.ones(min(1, len(key)), bool), key[1:] != key[:-1]]))


def _chunks_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """(text, chunk, times) of every chunk of every text, and the distinct chunks."""
    cut = pc.ascii_split_whitespace(texts)
    borders = cut.offsets.to_numpy()
    chunk, chunks = _codes(cut.values.slice(borders[0], borders[-1] - borders[0]))
    owner = np.repeat(np.arange(len(texts)), np.diff(borders))
    if len(chunk):
        full = pc.not_equal(chunks, "").to_numpy(zero_copy_only=False)[chunk]
        owner, chunk = owner[full], chunk[full]
    pair, times = np.unique(owner * max(1, len(chunks)) + chunk, return_counts=True)
    return pair // max(1, len(chunks)), pair % max(1, len(chunks)), times, chunks


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(chunk, lang, docs) of slices of (lang, text)."""
    for batch in (part for whole in batches for part in slices(whole, 1, SLICE)):
        lang, langs = _codes(batch.column(0))
        owner, chunk, _, chunks = _chunks_of(batch.column(1))
        both, docs = np.unique(chunk * len(langs) + lang[owner], return_counts=True)
        yield pa.RecordBatch.from_arrays([chunks.take(pa.array(both // len(langs))), langs.take(pa.array(both % len(langs))), pa.array(docs.astype(np.int64))], names=["chunk", "lang", "docs"])


def _occurrences(shared):
    """(chunk, lang, source, n, row) of slices of (row, lang, source, text), for the chunks in the filters: a row for each document where
    documents are to be told apart, else one for each source, with null for the document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, apart = shared.value
        for batch in (part for whole in batches for part in slices(whole, 3, SLICE)):
            row = batch.column(0).to_numpy()
            lang, langs = _codes(batch.column(1))
            source, sources = _codes(batch.column(2))
            owner, chunk, times, chunks = _chunks_of(batch.column(3))
            of_chunk, of_lang = hashes(chunks), hashes(langs)
            both = chunk * len(langs) + lang[owner]
            known, back = np.unique(both, return_inverse=True)
            places = _places(of_chunk[known // len(langs)], of_lang[known % len(langs)])
            told = _in(apart, places)[back]
            hit = _in(wanted, places)[back] & ~told
            key = both[hit] * len(sources) + source[owner[hit]]
            order = np.argsort(key, kind="stable")
            first = _runs(key[order])
            n = np.add.reduceat(times[hit][order], first) if len(first) else np.zeros(0, np.int64)
            key = np.concatenate([key[order][first], both[told] * len(sources) + source[owner[told]]])
            pair = key // len(sources)
            rows = np.concatenate([np.zeros(len(first), np.int64), row[owner[told]]])
            yield pa.RecordBatch.from_arrays(
                [chunks.take(pa.array(pair // len(langs))), langs.take(pa.array(pair % len(langs))), sources.take(pa.array(key % len(sources))),
                 pa.array(np.concatenate([n, times[told]]).astype(np.int64)), pa.array(rows, mask=np.arange(len(rows)) < len(first))], names=["chunk", "lang", "source", "n", "row"])

    return run


def _table(df: DataFrame, name: str) -> DataFrame:
    """`df` written as a table of the shared folder, and read back."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def kept_counts(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, source, term, n): occurrences of the terms that at least `least` documents of the language hold, as a table."""
    whole = [F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")]
    rows = docs.select(F.monotonically_increasing_id().alias("row"), *whole)
    held = map_arrow(rows.select("lang", "text"), _documents, "chunk string, lang string, docs long").repartition("chunk")
    by_lang = held.groupBy("chunk", "lang").agg(F.sum("docs").alias("docs")).groupBy("chunk").agg(F.collect_list(F.struct("lang", "docs")).alias("langs"))
    cut = F.regexp_extract_all(F.translate("chunk", UPPER, LOWER), F.lit(TERM), F.lit(0))
    chunks = _table(by_lang.select("chunk", "langs", cut.alias("terms")).filter(F.size("terms") > 0).select("chunk", F.explode("langs").alias("l"), "terms").select("chunk", "l.*", "terms"), "chunks")
    sums = chunks.select("lang", "docs", F.explode(F.array_distinct("terms")).alias("term")).groupBy("lang", "term").agg(F.max("docs").alias("most"), F.sum("docs").alias("all"))
    open_ = _table(sums.filter(F.col("all") >= least).select("lang", "term", (F.col("most") >= least).alias("proven")), "terms")
    found = _table(chunks.select("chunk", "lang", F.explode("terms").alias("term")).join(open_, ["lang", "term"]), "found")
    shared = docs.sparkSession.sparkContext.broadcast((bloom(found), bloom(found.filter("not proven"))))
    counted = map_arrow(rows, _occurrences(shared), "chunk string, lang string, source string, n long, row long").join(found, ["chunk", "lang"])
    own = F.when(F.col("proven"), F.lit(None)).otherwise(F.col("row")).alias("row")
    counted = _table(counted.select("lang", "term", "proven", "source", own, "n").groupBy("lang", "term", "proven", "source", "row").agg(F.sum("n").alias("n")), "counted")
    enough = counted.filter("row is not null").groupBy("lang", "term").agg(F.count(F.lit(1)).alias("docs")).filter(F.col("docs") >= least).select("lang", "term")
    more = counted.filter("not proven").join(enough, ["lang", "term"], "left_semi").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"))
    return _table(counted.filter("proven").select("lang", "source", "term", "n").unionByName(more), "counts")


def _share(n, of) -> F.Column:
    """p of a count `n`, where `of` is N + PLUS * V; in whole numbers of any size."""
    return F.expr(f"1 + (cast({SCALE} as decimal(20,0)) * cast({n} + {PLUS} as decimal(18,0))) div {of}")


def _distances(rows: pd.DataFrame) -> pd.DataFrame:
    """Sums of abs(p - q) less abs(p0 - q0) over the terms of a slice, for each source of one block and each of the other. Rows without a
    term list the sources of both blocks with p0, the share of a term they don't hold."""
    lang, i, j = rows["lang"].iloc[0], rows["i"].iloc[0], rows["j"].iloc[0]
    listed = rows[rows["term"].isna()].drop_duplicates("code").sort_values("code")
    codes, p0 = listed["code"].to_numpy(), listed["p"].to_numpy()
    held = rows[rows["term"].notna()]
    terms, at = np.unique(held["term"].to_numpy().astype(str), return_inverse=True) if len(held) else (np.zeros(0, str), np.zeros(0, np.int64))
    grid = np.repeat(p0[:, None], len(terms), 1)
    grid[np.searchsorted(codes, held["code"].to_numpy()), at] = held["p"].to_numpy()
    left, right = np.flatnonzero(codes // SOURCES == i), np.flatnonzero(codes // SOURCES == j)
    out = []
    for a in left:
        b = right[right > a]
        more = np.abs(grid[b] - grid[a]).sum(1) - np.abs(p0[b] - p0[a]) * len(terms)
        out.append(pd.DataFrame({"lang": lang, "a": codes[a], "b": codes[b], "part": more}))
    return pd.concat(out)


def divergence(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): how far each source is from every other of its language (part `pair`), and the terms it has
    more of than its language, the `top` first (part `term`)."""
    ship(docs.sparkSession)
    counts = kept_counts(docs, least)
    kept = counts.groupBy("lang").agg(F.count_distinct("term").alias("v"))
    groups = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source")).distinct()
    code = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    sums = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    of = (F.coalesce("total", F.lit(0)) + PLUS * F.col("v")).alias("of")
    groups = groups.withColumn("code", code).join(kept, "lang", "left").join(sums, ["lang", "source"], "left").select("lang", "source", "code", F.coalesce("v", F.lit(0)).alias("v"), of)
    groups = groups.withColumn("p0", F.when(F.col("v") > 0, _share("0L", "of")))
    blocks = groups.groupBy("lang").agg((F.max("code") / SOURCES).cast("int").alias("last"), F.ceil(F.first("v") / TERMS).cast("int").alias("slices"))
    groups = cut_lineage(groups.join(blocks, "lang"))
    shares = counts.join(groups, ["lang", "source"]).withColumn("p", _share("n", "of"))

    # pairs: a term's share goes to every block of sources its own block meets
    meet = F.explode(F.transform(F.sequence(F.lit(0), F.col("last")), lambda b: F.struct(F.least(b, F.col("own")).alias("i"), F.greatest(b, F.col("own")).alias("j"))))
    entries = shares.select("lang", "code", "term", "p", "last", F.pmod(F.xxhash64("term"), F.col("slices")).cast("int").alias("slice"))
    lists = groups.filter("v > 0").select("lang", "code", F.lit(None).cast("string").alias("term"), F.col("p0").alias("p"), "last", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"))
    met = entries.unionByName(lists).withColumn("own", (F.col("code") / SOURCES).cast("int")).withColumn("m", meet).select("lang", "code", "term", "p", "slice", "m.i", "m.j")
    parts = met.groupBy("lang", "i", "j", "slice").applyInPandas(_distances, "lang string, a int, b int, part long")
    both = parts.groupBy("lang", "a", "b").agg(F.sum("part").alias("part"))
    both = both.unionByName(both.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "part"))
    side = lambda x: groups.select("lang", F.col("code").alias(x), F.col("source").alias(f"source_{x}"), F.col("p0").alias(f"p_{x}"))
    pairs = groups.select("lang", F.col("code").alias("a"), F.col("source").alias("source_a"), F.col("p0").alias("p_a"), "v").join(side("b"), "lang").filter("a <> b")
    value = F.when(F.col("v") > 0, F.coalesce("part", F.lit(0)) + F.col("v") * F.abs(F.col("p_a") - F.col("p_b"))).otherwise(0)
    pairs = pairs.join(both, ["lang", "a", "b"], "left").select("lang", F.col("source_a").alias("source"), F.lit("pair").alias("part"), F.col("source_b").alias("item"), value.cast("long").alias("value"))

    # terms: against the share of the whole language
    of_lang = groups.groupBy("lang").agg((F.sum(F.col("of") - PLUS * F.col("v")) + PLUS * F.first("v")).alias("of_lang"))
    whole = counts.groupBy("lang", "term").agg(F.sum("n").alias("n")).join(of_lang, "lang").select("lang", "term", _share("n", "of_lang").alias("q"))
    terms = shares.join(whole, ["lang", "term"]).filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    best = terms.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return pairs.withColumn("rank", F.row_number().over(order)).unionByName(best)
