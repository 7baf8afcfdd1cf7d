"""CSV whose quoted values hold line breaks, read in splits.

A split starts at some line, which may stand inside a quoted value. One pass finds, for every split, the state its lines leave behind from
either state before them; these few facts a split give the true state at each split's start. A second pass then parses every split from
its known state. Only records that go over a border are left: their pieces meet by the split in which the record began.

A quote opens a value only at the start of a field, so a quote inside a word changes nothing. A quote that is never closed is an error.
"""

from __future__ import annotations

import csv
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievestone.session import ship

LONE_RETURN = re.compile(r"\r(?=.)")  # an old line end
PIECES = "path string, owner long, start long, ends boolean, piece binary, fields array<string>"


def line_steps(delimiter: str) -> tuple[Callable[[str], bool], Callable[[str], bool]]:
    """(after a line that starts a record, after a line that starts inside quotes): whether the record is still open."""
    d = re.escape(delimiter)
    quoted = r'(?:[^"]|"")*+"'
    field = rf'(?:"{quoted}[^{d}]*+|(?!")[^{d}]*+)'
    closed = re.compile(rf"{field}(?:{d}{field})*+\Z")
    rest = re.compile(rf"{quoted}[^{d}]*+(?:{d}{field})*+\Z")
    starts = re.compile(rf"{quoted}")
    return lambda line: not closed.match(line), lambda line: not (starts.match(line) and rest.match(line))


def _splits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int] | None, list[bytes]]]:
    """((path, start), lines) in order; a split comes in several parts, and (None, []) ends it."""
    current = None
    for batch in batches:
        starts, paths = batch.column(1), batch.column(0)
        at = 0
        while at < batch.num_rows:
            key = (paths[at].as_py(), starts[at].as_py())
            same = pc.and_(pc.equal(paths.slice(at), key[0]), pc.equal(starts.slice(at), key[1]))
            other = pc.index(same, pa.scalar(False)).as_py()
            to = batch.num_rows if other < 0 else at + other
            if current is not None and key != current:
                yield None, []
            current = key
            yield key, batch.column(2).slice(at, to - at).to_pylist()
            at = to
    if current is not None:
        yield None, []


def _states(delimiter: str, encoding: str):
    """Per split: whether a record is open after it, and whether any line ended a record, for both states before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh, inside = line_steps(delimiter)
        key, after, ended = None, [False, True], [True, False]
        for own, lines in _splits(batches):
            if own is None:
                yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*key, after[0], after[1], ended[1])], names=["path", "start", "open0", "open1", "ended1"])
                after, ended = [False, True], [True, False]
                continue
            key = own
            for line in lines:
                if b'"' not in line:
                    for s in (0, 1):
                        ended[s] |= not after[s]
                    continue
                text = line.decode(encoding, "replace")
                for s in (0, 1):
                    after[s] = inside(text) if after[s] else fresh(text)
                    ended[s] |= not after[s]

    return run


def _records(lines: list[str], delimiter: str) -> list[list[str | None]]:
    csv.field_size_limit((1 << 31) - 1)
    whole = (part + "\n" for line in lines for part in ([line] if '"' in line else LONE_RETURN.split(line)))
    return [[v or None for v in row] for row in csv.reader(whole, delimiter=delimiter) if row]


def _parse(delimiter: str, encoding: str, shared):
    """Whole records of every split, and the pieces of those that go over its borders."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh, inside = line_steps(delimiter)
        owners = shared.value
        kind = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.list_(pa.string())]
        names = ["path", "owner", "start", "ends", "piece", "fields"]

        def piece(key, owner, ends, lines):
            values = [key[0], owner, key[1], ends, "\n".join(lines).encode(), None]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kind)], names=names)

        key, owner, held, open_, skip = None, None, [], False, False
        for own, lines in _splits(batches):
            if own is None:
                if owner is not None:
                    yield piece(key, owner, False, held)  # a split inside one value
                elif open_:
                    yield piece(key, key[1], False, held)
                key = None
                continue
            if key is None:
                key, held = own, []
                owner = owners.get(own)
                open_, skip = owner is not None, own[1] == 0
            done = 0
            for raw in lines:
                line = raw.decode(encoding, "replace")
                if '"' in line:
                    open_ = inside(line) if open_ else fresh(line)
                held.append(line)
                if not open_:
                    done = len(held)
                    if owner is not None:
                        yield piece(key, owner, True, held)
                        owner, held, done = None, [], 0
            found = _records(held[:done], delimiter)
            held = held[done:]
            if skip and found:
                found, skip = found[1:], False
            if found:
                nulls = [pa.nulls(len(found), t) for t in kind[:5]]
                yield pa.RecordBatch.from_arrays([*nulls, pa.array(found, kind[5])], names=names)

    return run


def _joined(delimiter: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [r for text in batch.column(0).to_pylist() for r in _records(text.decode().split("\n"), delimiter)[:1]]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.string()))], names=["fields"])

    return run


def read_quoted(spark: SparkSession, path: str, delimiter: str, encoding: str, header: list[str]) -> DataFrame:
    """Every record below the header of every file, as texts; an empty value is missing, a short record is filled with missing ones."""
    ship(spark)
    lines = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("value"))
    states = lines.mapInArrow(_states(delimiter, encoding), "path string, start long, open0 boolean, open1 boolean, ended1 boolean").collect()  # one row a split
    owners, last, open_, owner = {}, None, False, None
    for row in sorted(states, key=lambda r: (r["path"], r["start"])):
        if row["path"] != last:
            if open_:
                raise ValueError(f"a quote in {last} is never closed")
            last, open_, owner = row["path"], False, None
        if open_:
            owners[row["path"], row["start"]] = owner
        begun = not open_ or row["ended1"]
        open_ = row["open1"] if open_ else row["open0"]
        owner = row["start"] if begun else owner
    if open_:
        raise ValueError(f"a quote in {last} is never closed")
    parsed = lines.mapInArrow(_parse(delimiter, encoding, spark.sparkContext.broadcast(owners)), PIECES)
    pieces = parsed.filter("piece is not null").groupBy("path", "owner").agg(F.array_sort(F.collect_list(F.struct("start", "piece"))).alias("p"))
    text = pieces.select(F.expr("concat_ws(unhex('0A'), transform(p, x -> cast(x.piece as string)))").cast("binary").alias("text"))
    records = parsed.filter("piece is null").select("fields").unionByName(text.mapInArrow(_joined(delimiter), "fields array<string>"))
    return records.select(*[F.get("fields", F.lit(i)).alias(name) for i, name in enumerate(header)])
