"""Token ids of many texts, word by word, with the ids of known words kept in one flat table.

In the tokenizers here a space between two characters that are not white space always begins a piece, so texts are cut there: a text is
a head and words with the space before them. A batch of texts is cut and its distinct words are found in C++; only words not met before
are encoded, and the ids of all texts are one gather from the table.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BORDER = re.compile(r"(?<=\S) (?=\S)")
#: Known words at most, and the longest word worth keeping.
KEEP, LONG = 1_300_000, 200
#: Marks that are a piece of their own after letters.
MARKS = ".,;:!?"


def gather(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs flat[start:start + size], one after another."""
    ends = np.cumsum(sizes)
    return flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)]


def in_order(parts: list[tuple[np.ndarray, np.ndarray]], second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, sizes) of strings whose ids stand in two lists: `second` says which are in the second one."""
    flat, sizes = (np.concatenate(x) for x in zip(*parts))
    order = np.empty(len(second), np.int64)
    order[np.flatnonzero(~second)] = np.arange((~second).sum())
    order[np.flatnonzero(second)] = (~second).sum() + np.arange(second.sum())
    starts = np.cumsum(sizes) - sizes
    return gather(flat, starts[order], sizes[order]), sizes[order]


def _odd(word: str) -> bool:
    return not word or word[0].isspace() or word[-1].isspace()


class WordIds:
    """`words` and `heads` give (ids of all, number of ids of each) of strings, as they stand after a space and at the start of a text."""

    def __init__(self, words: Callable, heads: Callable):
        self.encoders = {" ": words, "": heads}
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, dict[str, int]] = {" ": {}, "": {}}
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.starts, self.sizes, self.count = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64), 0

    def _room(self, ids: int, words: int) -> None:
        while self.used + ids > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.count + words > len(self.starts):
            self.starts, self.sizes = (np.concatenate([a, np.zeros_like(a)]) for a in (self.starts, self.sizes))

    def _numbers(self, strings: list[str], kind: str) -> np.ndarray:
        """The table's numbers of distinct strings; new ones are encoded and added."""
        known = self.known[kind]
        numbers = np.array([known.get(s, -1) for s in strings], np.int64)
        fresh = np.flatnonzero(numbers < 0)
        if len(fresh):
            new = [strings[i] for i in fresh]
            ids, sizes = self.encoders[kind](new)
            self._room(len(ids), len(new))
            self.flat[self.used:self.used + len(ids)] = ids
            place = np.arange(self.count, self.count + len(new))
            self.starts[place], self.sizes[place] = self.used + np.cumsum(sizes) - sizes, sizes
            numbers[fresh] = place
            self.used, self.count = self.used + len(ids), self.count + len(new)
            known.update((s, n) for s, n in zip(new, place.tolist()) if len(s) <= LONG)
        return numbers

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, len + 1 borders); null counts as empty."""
        if self.count > KEEP:
            self._clear()
        texts = texts.fill_null("")
        parts = pc.split_pattern(texts, " ")
        borders = parts.offsets.to_numpy().astype(np.int64)
        coded = parts.values.slice(borders[0], borders[-1] - borders[0]).dictionary_encode()
        borders, codes, strings = borders - borders[0], coded.indices.to_numpy(), coded.dictionary.to_pylist()
        # white space beside a space is no clean border: those texts are cut by the pattern
        odd = np.array([_odd(s) for s in strings], bool)[codes] if len(codes) else np.zeros(0, bool)
        many = np.diff(borders)
        unclean = np.flatnonzero((np.add.reduceat(odd, borders[:-1]) > 0) & (many > 1)) if len(many) else np.zeros(0, np.int64)
        cut = {int(i): BORDER.split(texts[int(i)].as_py()) for i in unclean}
        is_head = np.zeros(len(codes), bool)
        is_head[borders[:-1]] = True
        skipped = np.zeros(len(many), bool)
        skipped[unclean] = True
        used = ~np.repeat(skipped, many)
        wanted = {" ": np.unique(codes[used & ~is_head]), "": np.unique(codes[used & is_head])}
        numbers = np.zeros(len(codes), np.int64)
        for kind, own in wanted.items():
            place = np.zeros(len(strings), np.int64)
            place[own] = self._numbers([strings[i] for i in own.tolist()], kind)
            rows = used & (is_head if kind == "" else ~is_head)
            numbers[rows] = place[codes[rows]]
        if cut:
            more = {" ": sorted({w for p in cut.values() for w in p[1:]}), "": sorted({p[0] for p in cut.values()})}
            table = {kind: dict(zip(s, self._numbers(s, kind).tolist())) for kind, s in more.items()}
            pieces, at = [], 0
            for i, p in cut.items():  # in order
                pieces += [numbers[at:borders[i]], np.array([table[""][p[0]], *(table[" "][w] for w in p[1:])], np.int64)]
                at = borders[i + 1]
            numbers = np.concatenate([*pieces, numbers[at:]])
            many = many.copy()
            many[list(cut)] = [len(p) for p in cut.values()]
        sizes = self.sizes[numbers]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        return gather(self.flat, self.starts[numbers], sizes), ends[np.concatenate([[0], np.cumsum(many)])]
