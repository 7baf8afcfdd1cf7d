"""Byte-level BPE from a rank table, in time linear in the text.

Texts are cut by the tokenizer's pattern. A piece's bytes are mapped to Latin-1 so that an Aho-Corasick automaton over all tokens
(pyahocorasick works on str) finds the tokens that start at each byte. Encoding takes the longest token, and steps back to the next
shorter one where two neighbours could not stand side by side: two tokens are compatible if merging their joined bytes by rank gives
just these two again. Compatibility is memoised, and a position from which no way on was found is never tried twice, so the work is
linear; the result equals the merges by rank.

Words repeat, so each is encoded once (`words`). New words of letters go through the automaton together; those whose longest matches are all
compatible are done, the others are encoded one by one.

Edge cases: null and empty texts have no ids; a piece may be as long as the text; repeated rows are encoded alike.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievestone.llm.shared import ship, slices
from sievestone.llm.words import MARKS, WordIds, gather, in_order

FITS, JOINED, BATCH_BYTES = 2_000_000, 20_000, 8 << 20


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to ids of a rank file; read on the driver and sent to the tasks (a vocabulary, about 1 MB)."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


class Encoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.tokens = ranks, {i: t for t, i in ranks.items()}
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), (len(token), rank))
        self.automaton.make_automaton()
        self.fits: dict[int, bool] = {}
        self.prefix: dict[int, int] = {}
        self.split = regex.compile(pattern).findall
        self.begins = np.zeros(max(self.tokens) + 1, bool)
        self.begins[[i for t, i in ranks.items() if t.startswith(b" ")]] = True
        sizes = np.zeros(len(self.begins), np.int64)
        sizes[list(self.tokens)] = [len(t) for t in self.tokens.values()]
        self.sizes, self.starts = sizes, np.cumsum(sizes) - sizes
        self.bytes = np.frombuffer(b"".join(self.tokens[i] for i in sorted(self.tokens)), np.uint8)
        self.words = WordIds(self.after_space, self.each)

    def merged(self, data: bytes) -> list[int]:
        """Merges by rank, as defined: only for two joined tokens, whose length is bounded."""
        parts = [data[i:i + 1] for i in range(len(data))]
        while len(parts) > 1:
            ranked = [(self.ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))]
            rank, i = min(ranked)
            if rank == 1 << 60:
                break
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def compatible(self, left: int, right: int) -> bool:
        key = left << 32 | right
        known = self.fits.get(key)
        if known is None:
            if len(self.fits) >= FITS:
                self.fits.clear()
            known = self.fits[key] = self.merged(self.tokens[left] + self.tokens[right]) == [left, right]
        return known

    def shorter(self, token: int) -> int:
        """The longest token that begins `token`, or -1."""
        known = self.prefix.get(token)
        if known is None:
            data = self.tokens[token]
            known = self.prefix[token] = next((self.ranks[data[:n]] for n in range(len(data) - 1, 0, -1) if data[:n] in self.ranks), -1)
        return known

    def encode_bytes(self, data: bytes) -> list[int]:
        if (whole := self.ranks.get(data)) is not None:
            return [whole]
        chars, fits, compatible = data.decode("latin-1"), self.fits, self.compatible
        ids = [token for _, (_, token) in self.automaton.iter_long(chars)]
        for left, right in zip(ids, ids[1:]):
            known = fits.get(left << 32 | right)
            if not (compatible(left, right) if known is None else known):
                break
        else:
            return ids  # the longest matches one after another are all compatible
        longest, sizes = [-1] * len(data), [0] * len(data)
        for end, (size, token) in self.automaton.iter(chars):
            if size > sizes[end - size + 1]:
                longest[end - size + 1], sizes[end - size + 1] = token, size
        ids, at, token, dead, tokens = [], 0, longest[0], bytearray(len(data) + 1), self.tokens
        while True:
            while token >= 0:
                to = at + len(tokens[token])
                if not dead[to]:
                    if not ids:
                        break
                    known = fits.get(ids[-1] << 32 | token)
                    if compatible(ids[-1], token) if known is None else known:
                        break
                token = self.shorter(token)
            if token >= 0:
                ids.append(token)
                at = to
                if at == len(data):
                    return ids
                token = longest[at]
            else:
                dead[at] = 1
                token = ids.pop()
                at -= len(tokens[token])
                token = self.shorter(token)

    def each(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each), by the pattern's pieces."""
        found = [[i for piece in self.split(t) for i in self.encode_bytes(piece.encode())] for t in texts]
        return np.array([i for ids in found for i in ids], np.uint32), np.array([len(ids) for ids in found], np.int64)

    def after_space(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same of words with a space before each: letters, also with a mark at the end, are one piece and the mark."""
        marked = np.array([w[-1] in MARKS and w[:-1].isalpha() for w in words], bool)
        plain = np.array([m or w.isalpha() for w, m in zip(words, marked)], bool)
        letters = [w[:-1] if m else w for w, m, p in zip(words, marked, plain) if p]
        parts = [self.joined(letters[at:at + JOINED]) for at in range(0, len(letters), JOINED)] or [(np.zeros(0, np.uint32), np.zeros(0, np.int64))]
        ids, sizes = (np.concatenate(x) for x in zip(*parts))
        ends, own = np.cumsum(sizes), marked[plain]
        marks = [self.ranks[w[-1].encode()] for w, m in zip(words, marked) if m]
        ids, sizes = np.insert(ids, ends[own], np.array(marks, np.uint32)), sizes + own
        return in_order([(ids, sizes), self.each([" " + w for w, p in zip(words, plain) if not p])], ~plain)

    def joined(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Words of letters in one call of the automaton."""
        chars = (" " + " ".join(words)).encode().decode("latin-1")
        ids = np.array([token for _, (_, token) in self.automaton.iter_long(chars)], np.int64)
        first = self.begins[ids]
        starts = np.flatnonzero(first)
        if len(starts) != len(words):
            return self.each([" " + w for w in words])
        inner = np.flatnonzero(~first)
        pairs, back = np.unique(ids[inner - 1] << 32 | ids[inner], return_inverse=True)
        fits, compatible = self.fits, self.compatible
        known = np.array([k if (k := fits.get(p)) is not None else compatible(p >> 32, p & 0xFFFFFFFF) for p in pairs.tolist()], bool)
        sizes = np.diff(np.append(starts, len(ids)))
        wrong = np.zeros(len(words), bool)
        wrong[np.searchsorted(starts, inner[~known[back]], "right") - 1] = True
        if not wrong.any():
            return ids.astype(np.uint32), sizes
        again = [self.encode_bytes((" " + words[i]).encode()) for i in np.flatnonzero(wrong)]
        kept = ids[np.repeat(~wrong, sizes)].astype(np.uint32)
        return in_order([(kept, sizes[~wrong]), (np.array([i for x in again for i in x], np.uint32), np.array([len(x) for x in again], np.int64))], wrong)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, len + 1 borders)."""
        return self.words.encode(texts)

    def decode(self, ids: np.ndarray) -> bytes:
        return gather(self.bytes, self.starts[ids], self.sizes[ids]).tobytes()


_ENCODERS: dict[int, Encoder] = {}


def _encoder(shared) -> Encoder:
    ranks, pattern = shared.value
    key = hash((len(ranks), pattern, next(iter(ranks)), sum(ranks.values())))
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(ranks, pattern)
    return _ENCODERS[key]


def _run(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared)
        for batch in (part for whole in batches for part in slices(whole, 1, BATCH_BYTES)):
            ids, borders = encoder.encode(batch.column(1))
            digests, back = [], []
            for s, e in zip(borders[:-1].tolist(), borders[1:].tolist()):
                digests.append(hashlib.sha256(ids[s:e].astype("<u4").tobytes()).hexdigest())
                back.append(hashlib.sha256(encoder.decode(ids[s:e])).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(borders)), pa.array(digests, pa.string()), pa.array(back, pa.string())],
                                             names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _ids(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared)
        for batch in (part for whole in batches for part in slices(whole, 1, BATCH_BYTES)):
            ids, borders = encoder.encode(batch.column(1))
            own = [ids[s:e].astype("<u4").tobytes() for s, e in zip(borders[:-1].tolist(), borders[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.binary())], names=["doc_id", "ids"])

    return run


def _texts(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared)
        for batch in batches:
            back = [encoder.decode(np.frombuffer(x.as_py() or b"", "<u4")) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(back, pa.binary())], names=["doc_id", "bytes"])

    return run


def _shared(df: DataFrame, rank_path: str, pattern: str):
    ship(df.sparkSession)
    return df.sparkSession.sparkContext.broadcast((load_ranks(rank_path), pattern))


def encode(docs: DataFrame, rank_path: str, pattern: str) -> DataFrame:
    """(doc_id, ids): ids as little-endian unsigned 32-bit integers in one binary value."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_ids(_shared(docs, rank_path, pattern)), "doc_id long, ids binary")


def decode(encoded: DataFrame, rank_path: str, pattern: str) -> DataFrame:
    """(doc_id, bytes) of rows (doc_id, ids)."""
    return encoded.select("doc_id", "ids").mapInArrow(_texts(_shared(encoded, rank_path, pattern)), "doc_id long, bytes binary")


def round_trip(docs: DataFrame, rank_path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encodes, decodes the ids again and keeps the digests."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        _run(_shared(docs, rank_path, pattern)), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
