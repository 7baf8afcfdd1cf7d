"""Readers: Parquet, CSV of unknown dialect, the JSON shapes people export; each gives a flat table with clean headers."""

from __future__ import annotations

import csv
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievestone.functions.columns import count_when, named
from sievestone.operators.prepare import COMMA_NUMBER, CONTAINER, is_number
from sievestone.session import ship
from sievestone.sources.quoted_csv import read_quoted

HEAD_BYTES, HEAD_LINES = 64 * 1024, 50
DELIMITERS = [",", ";", "\t", "|"]


def unique_headers(names: list[str]) -> list[str]:
    """Blank headers become 'Unnamed: i', repeats get '.1', '.2', ..."""
    seen: dict[str, int] = {}
    out = []
    for i, name in enumerate(names):
        base = str(name).strip() if name is not None else ""
        base = base or f"Unnamed: {i}"
        if base in seen:
            seen[base] += 1
            name = f"{base}.{seen[base]}"
        else:
            seen[base] = 0
            name = base
        out.append(name)
    return out


def flatten(df: DataFrame) -> DataFrame:
    """Nested structs as parent.child columns, at any depth."""
    while any(isinstance(f.dataType, T.StructType) for f in df.schema.fields):
        projection = []
        for f in df.schema.fields:
            if isinstance(f.dataType, T.StructType):
                projection += [named(f.name).getField(child.name).alias(f"{f.name}.{child.name}") for child in f.dataType.fields]
            else:
                projection.append(named(f.name))
        df = df.select(*projection)
    return df


def stringify_containers(df: DataFrame) -> DataFrame:
    """Arrays, maps and leftover structs as JSON text."""
    return df.select(*[F.to_json(named(f.name)).alias(f.name) if isinstance(f.dataType, CONTAINER) else named(f.name) for f in df.schema.fields])


def tidy(df: DataFrame) -> DataFrame:
    flat = stringify_containers(flatten(df))
    return flat.toDF(*unique_headers(flat.columns))


def with_row_id(df: DataFrame, name: str = "row_id") -> DataFrame:
    """0-based file position. Each file knows its own row positions; files are numbered by path and their row counts (one
    number per file) give the starts. Nothing is sorted or shuffled, and a lost task gets the same ids again."""
    tagged = df.select("*", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.row_index").alias("_index"))
    counts = sorted((r["_path"], r["count"]) for r in tagged.groupBy("_path").count().collect())
    starts, so_far = [], 0
    for path, count in counts:
        starts.append((path, so_far))
        so_far += count
    if len(starts) <= 1:
        return tagged.select(F.col("_index").alias(name), *[named(c) for c in df.columns])
    lookup = df.sparkSession.createDataFrame(starts, "_path string, _start long")
    lookup = F.broadcast(lookup) if len(starts) <= 200_000 else lookup
    return tagged.join(lookup, "_path").select((F.col("_index") + F.col("_start")).alias(name), *[named(c) for c in df.columns])


# --- CSV ---------------------------------------------------------------------------------------------------------
def _head(spark: SparkSession, path: str) -> list[bytes]:
    """The first lines as they are in the file, HEAD_BYTES of each at most; only this much leaves the cluster."""
    lines = [bytes(r[0]) for r in spark.read.text(path).select(F.substring(F.col("value").cast("binary"), 1, HEAD_BYTES)).take(HEAD_LINES)]
    if not b"".join(lines).strip():
        raise ValueError("the file is empty")
    lines[0] = lines[0].removeprefix(b"\xef\xbb\xbf")
    return lines


def sniff(spark: SparkSession, path: str) -> dict:
    """Encoding, delimiter, header, and whether quoted values may hold line breaks (a line with an odd number of quotes): one aggregation over all lines of all files.

    A byte that is not UTF-8 makes the file western, wherever it stands. The delimiter is the one most lines have as often as the
    header line (quoted parts left out), then the one the header has most often.
    """
    head = [line for line in _head(spark, path) if line.strip()]
    value = F.col("value")
    valid = F.is_valid_utf8(value)
    outside = F.regexp_replace(F.make_valid_utf8(value), '"[^"]*"?', "")
    times = lambda line, d: F.length(line) - F.length(F.replace(line, F.lit(d), F.lit("")))
    first = re.sub(r'"[^"]*"?', "", head[0].decode("latin-1"))
    found = spark.read.text(path).agg(
        count_when(~valid).alias("western"),
        count_when(F.when(~valid, F.hex(value.cast("binary"))).rlike("^(..)*(81|8D|8F|90|9D)")).alias("undefined"),  # fixed: bytes cp1252 leaves out
        count_when(times(F.make_valid_utf8(value), '"') % 2 == 1).alias("open"),
        *[count_when(times(outside, d) == first.count(d)).alias(f"d{i}") for i, d in enumerate(DELIMITERS)]).first()
    encoding = "UTF-8" if not found["western"] else "ISO-8859-1" if found["undefined"] else "windows-1252"
    delimiter = max((d for d in DELIMITERS), key=lambda d: (first.count(d) > 0, found[f"d{DELIMITERS.index(d)}"], first.count(d)))
    text = [line.decode("utf-8" if encoding == "UTF-8" else "cp1252" if encoding == "windows-1252" else "latin-1", "replace") + "\n" for line in head]
    header = next(csv.reader(text, delimiter=delimiter))
    return {"encoding": encoding, "delimiter": delimiter, "header": unique_headers(header), "multiline": found["open"] > 0}


def _plain_csv(spark: SparkSession, path: str, info: dict) -> DataFrame:
    schema = T.StructType([T.StructField(name, T.StringType()) for name in info["header"]])
    western = info["encoding"] == "windows-1252"  # Spark reads it as ISO-8859-1, which differs in the control range only
    df = spark.read.csv(path, sep=info["delimiter"], encoding="ISO-8859-1" if western else info["encoding"], header=True, schema=schema,
                        enforceSchema=True, escape='"', mode="PERMISSIVE")
    if western:
        pairs = [(chr(b), bytes([b]).decode("cp1252", "ignore")) for b in range(0x80, 0xA0)]
        seen, shown = "".join(a for a, b in pairs if b), "".join(b for _, b in pairs if b)
        df = df.select(*[F.translate(named(c), seen, shown).alias(c) for c in info["header"]])
    return df


def read_csv(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """Every column as text (typing is the next step's job), plus what was sniffed. For ';' files one aggregation decides
    whether the comma is the decimal mark. Files are read in splits, also where quoted values hold line breaks."""
    info = sniff(spark, path)
    if info["multiline"]:
        encoding = {"UTF-8": "utf-8", "windows-1252": "cp1252", "ISO-8859-1": "latin-1"}[info["encoding"]]
        df = read_quoted(spark, path, info["delimiter"], encoding, info["header"])
    else:
        df = _plain_csv(spark, path, info)
    info["decimal"] = "."
    if info["delimiter"] == ";":
        aggregates = [e for i, c in enumerate(info["header"]) for e in (
            F.count(named(c)).alias(f"n{i}"), count_when(is_number(named(c))).alias(f"p{i}"), count_when(named(c).rlike(COMMA_NUMBER)).alias(f"c{i}"))]
        row = df.agg(*aggregates).first()
        numeric = lambda key: sum(1 for i in range(len(info["header"])) if row[f"n{i}"] and row[f"{key}{i}"] == row[f"n{i}"])
        info["decimal"] = "," if numeric("c") > numeric("p") else "."
    return df, info


# --- JSON --------------------------------------------------------------------------------------------------------
def records_from_json(df: DataFrame, document: bool = True) -> DataFrame:
    """Rows from what spark.read.json gives: records stay, a wrapped list is exploded, and the column arrays of a `document`
    that is one object are zipped (records whose fields are all arrays stay records)."""
    fields = df.schema.fields
    names = [f.name for f in fields]
    if not document:
        return df
    if len(fields) == 1 and isinstance(fields[0].dataType, T.ArrayType) and isinstance(fields[0].dataType.elementType, T.StructType):
        return df.select(F.explode(named(names[0])).alias("r")).select("r.*")
    wrapped = [f for f in fields if f.name == "data" and isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType)]
    if wrapped:
        return df.select(F.explode(named("data")).alias("r")).select("r.*")
    if fields and all(isinstance(f.dataType, T.ArrayType) and not isinstance(f.dataType.elementType, T.StructType) for f in fields):
        return df.select(F.explode(F.arrays_zip(*[named(n) for n in names])).alias("r")).select("r.*")
    return df


def read_json(spark: SparkSession, path: str, lines: bool | None = None) -> DataFrame:
    """JSON Lines or one document: records, {"data": [...]}, column arrays or a single record."""
    text = F.trim(F.ltrim("value", F.lit("\ufeff")))
    shape = spark.read.text(path).filter(text != "").select(text.startswith("{").alias("opens"), text.endswith("}").alias("closes")).take(2)
    if lines is None:
        lines = len(shape) == 2 and all(r["opens"] and r["closes"] for r in shape)
    df = spark.read.json(path, multiLine=not lines)
    if "_corrupt_record" in df.columns and len(df.columns) == 1:
        raise ValueError("the file is not JSON")
    return tidy(records_from_json(df, document=not lines and bool(shape) and shape[0]["opens"]))


def read_parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Columns are pruned before anything else; the index pandas writes is dropped."""
    df = spark.read.parquet(path)
    if columns:
        df = df.select(*[named(c) for c in columns])
    return tidy(df.drop(*[c for c in df.columns if c.startswith("__index_level_")]))


def load_table(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """Reader chosen by suffix, else by the first bytes."""
    lower = path.rstrip("/").lower()
    if lower.endswith((".parquet", ".pq")):
        return read_parquet(spark, path), {"format": "parquet"}
    if lower.endswith((".json", ".jsonl", ".ndjson")):
        return read_json(spark, path, True if lower.endswith(("jsonl", "ndjson")) else None), {"format": "json"}
    if lower.endswith((".csv", ".tsv", ".txt")):
        df, info = read_csv(spark, path)
        return df, {"format": "csv", **info}
    head = _head(spark, path)[0]
    if head[:4] == b"PAR1":
        return read_parquet(spark, path), {"format": "parquet"}
    if head.lstrip()[:1] in (b"{", b"["):
        return read_json(spark, path), {"format": "json"}
    df, info = read_csv(spark, path)
    return df, {"format": "csv", **info}


def _hashed(batches):
    """`batches` of (path, bytes) with the digest of each local file, read piece by piece."""
    import hashlib

    import pyarrow as pa

    for batch in batches:
        digests = []
        for path in batch.column("path").to_pylist():
            with open("/" + path.removeprefix("file:").lstrip("/"), "rb") as file:
                digests.append(hashlib.file_digest(file, "sha256").hexdigest())
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(digests, pa.string())], names=["path", "bytes", "sha256"])


def fingerprint(spark: SparkSession, path: str) -> DataFrame:
    """path, bytes, sha256 per file; each file is hashed where it is read. Local files are read piece by piece, whatever their size; a file of
    another system comes as one value, which Spark refuses beyond 2 GB."""
    files = spark.read.format("binaryFile").load(path)
    if files.filter(~F.col("path").startswith("file:")).limit(1).count():
        return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    ship(spark)
    return files.select("path", F.col("length").alias("bytes")).mapInArrow(_hashed, "path string, bytes long, sha256 string")


def parse_json_column(df: DataFrame, column: str, schema: str) -> DataFrame:
    """A JSON text column parsed and flattened to column.field."""
    return flatten(df.withColumn(column, F.from_json(named(column), schema)))


def json_field(column: Column, path: str) -> Column:
    return F.get_json_object(column, path)
