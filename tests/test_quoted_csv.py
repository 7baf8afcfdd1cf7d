"""Quoted line breaks read in many splits, against Python's csv."""

import csv
import random

import pytest

from sievestone.sources import readers
from sievestone.sources.quoted_csv import line_steps, read_quoted


@pytest.fixture
def small_splits(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "900")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def rows_of(path, delimiter):
    with open(path, newline="", encoding="utf-8") as file:
        return sorted(repr([v or None for v in (r + [""] * 3)[:3]]) for r in list(csv.reader(file, delimiter=delimiter))[1:] if r)


@pytest.mark.parametrize("seed,delimiter,ends", [(1, ",", "\n"), (2, "\t", "\n"), (3, "|", "\r\n"), (4, ";", "\n")])
def test_equals_csv(spark, tmp_path, small_splits, seed, delimiter, ends):
    rnd = random.Random(seed)
    value = lambda: "".join(rnd.choice(["a", "é", " ", '"', ends, delimiter, '""', "long " * 30, "x"]) for _ in range(rnd.randint(0, 6)))
    files = [tmp_path / f"{i}.csv" for i in range(3)]
    for number, path in enumerate(files):
        with open(path, "w", newline="", encoding="utf-8") as file:
            out = csv.writer(file, delimiter=delimiter, lineterminator=ends)
            out.writerow(["one", "two", "three"])
            out.writerows([str(i), value(), value()] for i in range(150))
            if number == 1:
                out.writerow(["big", ends.join(f"line {i}" for i in range(900)), ""])  # over several splits
                file.write(f'9{delimiter}5" pipe{delimiter}a"b{ends}{ends}short{ends}')  # stray quotes, a blank line, a short record
    df = read_quoted(spark, str(tmp_path), delimiter, "utf-8", ["one", "two", "three"])
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 20
    assert sorted(repr(list(r)) for r in df.collect()) == sorted(r for path in files for r in rows_of(path, delimiter))


def test_stray_quote_stays_split(spark, tmp_path, small_splits):
    path = tmp_path / "stray.csv"
    path.write_text("id,text\n" + "".join(f'{i},{"5\" pipe" if i == 77 else "plain"}\n' for i in range(800)))
    df, info = readers.read_csv(spark, str(path))
    assert info["multiline"] and {r.id: r.text for r in df.collect()} == {str(i): '5" pipe' if i == 77 else "plain" for i in range(800)}


def test_quote_never_closed(spark, tmp_path, small_splits):
    path = tmp_path / "open.csv"
    path.write_text("id,text\n1,a\n2,\"open\n" + "3,b\n" * 500)
    with pytest.raises(ValueError, match="never closed"):
        readers.read_csv(spark, str(path))


def test_line_steps():
    fresh, inside = line_steps(",")
    assert [fresh(x) for x in ('a,b', '"a', 'a,"b""', '"a""b,c', 'a"b,c', '"a"x,"b"', '"a",', '""', '"""')] == [False, True, True, True, False, False, False, False, True]
    assert [inside(x) for x in ('a,b', 'a"', 'a""b', 'a","b', 'a",b', '"', '""', '"""')] == [True, False, True, True, False, False, True, False]
