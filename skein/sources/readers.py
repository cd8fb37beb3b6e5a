"""Readers of raw files into one frame of JSON records with their provenance."""

from __future__ import annotations

import bz2
import fnmatch
import gzip
import io
import json
import lzma
import os
import tarfile
import warnings
import zipfile
from collections.abc import Callable
from dataclasses import dataclass, field
from importlib.metadata import entry_points

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CODECS = {".gz": gzip.decompress, ".bz2": bz2.decompress, ".xz": lzma.decompress}
NATIVE_CODECS = (".gz", ".bz2", ".zst")
CSV_OPTIONS = ("quote", "encoding", "comment", "maxColumns", "maxCharsPerColumn", "lineSep", "pathGlobFilter")
RECORD = "raw string, path string, member string"
REGISTRY: list[tuple[Callable[[str], bool], str, Callable]] = []


def decompress(name: str, data: bytes) -> tuple[str, bytes]:
    base, ext = os.path.splitext(name)
    if ext == ".zst":
        import zstandard

        return base, zstandard.ZstdDecompressor(max_window_size=1 << 31).stream_reader(io.BytesIO(data)).read()
    return (base, CODECS[ext](data)) if ext in CODECS else (name, data)


def register(suffixes: tuple[str, ...], name: str):
    """Registers a reader by suffix, with or without a codec's; the newest registration wins."""

    def add(read):
        def supports(path: str) -> bool:
            path = path.lower()
            return any(path.endswith(s) or path.endswith(s + c) for s in suffixes for c in (*CODECS, ".zst"))

        REGISTRY.insert(0, (supports, name, read))
        return read

    return add


def discover(group: str = "skein.readers") -> list[str]:
    """Loads readers that installed packages offer as entry points, and registers those given as (suffixes, name, read). Names that load."""
    out = []
    for point in entry_points(group=group):
        try:
            found = point.load()
            if isinstance(found, tuple):
                register(found[0], found[1])(found[2])
            out.append(point.name)
        except Exception as e:  # noqa: BLE001  one broken package doesn't stop the others
            warnings.warn(f"reader {point.name} doesn't load: {e}", stacklevel=2)
    return out


def reader_of(path: str) -> tuple[str, Callable]:
    for supports, name, read in REGISTRY:
        try:
            if supports(path):
                return name, read
        except Exception:  # noqa: BLE001, S112
            continue
    raise ValueError(f"no reader for {path}")


def _with_source(df: DataFrame) -> DataFrame:
    return df.select("raw", F.col("_metadata.file_path").alias("path"), F.lit(None).cast("string").alias("member"))


def json_rows(text: str) -> list[str]:
    """The records of a JSON document: an array's elements, or one object. Trailing commas and cut ends are mended."""
    try:
        doc = json.loads(text)
    except ValueError:
        doc = mended(text)
    if isinstance(doc, list):
        return [json.dumps(x, ensure_ascii=False) for x in doc]
    if isinstance(doc, dict):
        return [json.dumps(doc, ensure_ascii=False)]
    raise ValueError("a JSON document must be an array or an object")


def mended(text: str):
    """The longest part of broken JSON that parses once its open strings and brackets are closed."""
    import re

    text = re.sub(r",\s*([}\]])", r"\1", text.strip())
    stack, inside, escaped = [], False, False
    for c in text:
        if escaped:
            escaped = False
        elif inside and c == "\\":
            escaped = True
        elif c == '"':
            inside = not inside
        elif not inside and c in "[{":
            stack.append("]" if c == "[" else "}")
        elif not inside and c in "]}" and stack:
            stack.pop()
    return json.loads(re.sub(r",\s*$", "", text + '"' * inside) + "".join(reversed(stack)))


def _decoded(df: DataFrame, rows: Callable[[str, bytes], list[tuple[str, str | None]]]) -> DataFrame:
    """Binary files to records, file by file in tasks; a file that fails gives one row without raw, with the error as its member."""

    def run(frames):
        for frame in frames:
            out = []
            for path, content in zip(frame["path"], frame["content"]):
                try:
                    out += [(raw, path, member) for raw, member in rows(path, bytes(content))]
                except Exception as e:  # noqa: BLE001  whatever a codec or parser raises, the other files go on
                    out.append((None, path, f"{type(e).__name__}: {e}"[:500]))
            yield pd.DataFrame(out, columns=["raw", "path", "member"])

    return df.select("path", "content").mapInPandas(run, RECORD)


def line_mended(line: str) -> str | None:
    """A line's record, repaired if need be; None if it can't be."""
    for parse in (json.loads, mended):
        try:
            doc = parse(line)
        except ValueError:
            continue
        return json.dumps(doc, ensure_ascii=False) if isinstance(doc, dict) else None
    return None


def repaired(df: DataFrame) -> DataFrame:
    """Lines that are JSON objects as they are, and of the others those that can be mended. Only these leave the JVM."""

    def run(frames):
        for frame in frames:
            frame["raw"] = [line_mended(x) for x in frame["raw"]]
            yield frame[frame["raw"].notna()]

    fine = F.ltrim("raw").startswith("{") & F.try_parse_json("raw").isNotNull()
    return df.where(F.col("raw").isNull() | fine).union(df.where(F.col("raw").isNotNull() & ~fine).mapInPandas(run, RECORD))


def _binary(spark, paths) -> DataFrame:
    return spark.read.format("binaryFile").load(paths)


@register((".jsonl", ".ndjson", ".jsons"), "jsonl")
def read_jsonl(spark: SparkSession, paths: list[str], strict: bool = True, **_) -> DataFrame:
    """One record per line; blank lines are left out, broken ones mended or left out (``strict=False``: lines as they are). xz is not one of Hadoop's codecs, so tasks decode it."""
    odd = [p for p in paths if p.lower().endswith(".xz")]
    plain = [p for p in paths if p not in odd]
    out = []
    if plain:
        out.append(_with_source(spark.read.text(plain).withColumnRenamed("value", "raw")))
    if odd:
        out.append(_decoded(_binary(spark, odd), lambda p, b: [(x, None) for x in decompress(p, b)[1].decode("utf-8", "replace").splitlines()]))
    df = out[0] if len(out) == 1 else out[0].union(out[1])
    df = df.where(F.col("raw").isNull() | (F.trim("raw") != ""))
    return repaired(df) if strict else df


@register((".json",), "json")
def read_json(spark: SparkSession, paths: list[str], prefix: str | None = None, **_) -> DataFrame:
    """Whole documents: arrays give their elements. ``prefix`` names a dotted path to the array."""

    def rows(path, data):
        text = decompress(path, data)[1].decode("utf-8", "replace")
        if prefix:
            doc = json.loads(text)
            for key in prefix.removesuffix(".item").split("."):
                doc = doc[key]
            text = json.dumps(doc)
        return [(x, None) for x in json_rows(text)]

    return _decoded(_binary(spark, paths), rows)


def read_table_text(spark: SparkSession, paths: list[str], sep: str = ",", **options) -> DataFrame:
    """CSV with every column as text, one JSON record a row, so ids never turn into floats."""

    def rows(path, data):
        frame = pd.read_csv(io.BytesIO(decompress(path, data)[1]), sep=sep, dtype=str, keep_default_na=False)
        return [(json.dumps(r, ensure_ascii=False), None) for r in frame.to_dict("records")]

    odd = [p for p in paths if p.lower().endswith(".xz")]
    plain = [p for p in paths if p not in odd]
    out = None
    if plain:
        df = spark.read.csv(plain, header=True, sep=sep, inferSchema=False, multiLine=True, escape='"', **{k: v for k, v in options.items() if k in CSV_OPTIONS})
        names = df.columns
        out = _with_source(df.select(F.to_json(F.struct(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in names])).alias("raw"), "_metadata"))
    if odd:
        more = _decoded(_binary(spark, odd), rows)
        out = more if out is None else out.union(more)
    return out


@register((".csv",), "csv")
def read_csv(spark, paths, **options) -> DataFrame:
    return read_table_text(spark, paths, **options)


@register((".tsv", ".tab"), "tsv")
def read_tsv(spark, paths, **options) -> DataFrame:
    return read_table_text(spark, paths, **({"sep": "\t"} | options))


def parquet_rows(data: bytes, columns: list[str] | None = None) -> list[str]:
    import pyarrow.parquet as pq

    return [json.dumps(r, ensure_ascii=False, default=str) for r in pq.read_table(io.BytesIO(data), columns=columns).to_pylist()]


@register((".parquet",), "parquet")
def read_parquet(spark, paths, columns: list[str] | None = None, **_) -> DataFrame:
    """Plain files by Spark's scan; files compressed as a whole are decoded in tasks."""
    odd = [p for p in paths if not p.lower().endswith(".parquet")]
    plain = [p for p in paths if p not in odd]
    out = []
    if plain:
        df = spark.read.parquet(*plain)
        out.append(_with_source(df.select(F.to_json(F.struct(*(columns or df.columns))).alias("raw"), "_metadata")))
    if odd:
        out.append(_decoded(_binary(spark, odd), lambda p, b: [(x, None) for x in parquet_rows(decompress(p, b)[1], columns)]))
    return out[0] if len(out) == 1 else out[0].union(out[1])


def member_rows(name: str, data: bytes) -> list[str]:
    base, data = decompress(name, data)
    ext = os.path.splitext(base)[1].lower()
    if ext == ".parquet":
        return parquet_rows(data)
    text = data.decode("utf-8", "replace")
    if ext in (".csv", ".tsv", ".tab"):
        frame = pd.read_csv(io.StringIO(text), sep="," if ext == ".csv" else "\t", dtype=str, keep_default_na=False)
        return [json.dumps(r, ensure_ascii=False) for r in frame.to_dict("records")]
    if ext == ".json":
        return json_rows(text)
    return [x for line in text.splitlines() if line.strip() for x in [line_mended(line)] if x]


def _wanted(name: str, include, exclude) -> bool:
    return (not include or any(fnmatch.fnmatch(name, p) for p in include)) and not any(fnmatch.fnmatch(name, p) for p in exclude or ())


@register((".zip",), "zip")
def read_zip(spark, paths, member_include=None, member_exclude=None, member_filter: Callable[[str], bool] | None = None, **_) -> DataFrame:
    """Records of the members that the patterns and the function let through."""

    def rows(path, data):
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            names = [m for m in z.namelist() if not m.endswith("/") and _wanted(m, member_include, member_exclude) and (member_filter is None or member_filter(m))]
            return [(r, m) for m in names for r in member_rows(m, z.read(m))]

    return _decoded(_binary(spark, paths), rows)


@register((".tar", ".tgz", ".tbz2", ".txz"), "tar")
def read_tar(spark, paths, member_include=None, member_exclude=None, member_filter: Callable[[str], bool] | None = None, **_) -> DataFrame:
    """Records of the members that the patterns and the function let through."""

    def rows(path, data):
        name, data = decompress(path, data) if path.endswith(".zst") else (path, data)
        with tarfile.open(fileobj=io.BytesIO(data)) as t:
            return [(r, m.name) for m in t if m.isfile() and _wanted(m.name, member_include, member_exclude) and (member_filter is None or member_filter(m.name)) for r in member_rows(m.name, t.extractfile(m).read())]

    return _decoded(_binary(spark, paths), rows)


REGISTRY.append((lambda p: p.lower().endswith((".xz", ".zst")), "jsonl", read_jsonl))  # bare codecs hold lines


@dataclass
class Plan:
    """Files by reader, in order."""

    files: list[tuple[str, str]] = field(default_factory=list)  # (path, reader)

    def summary(self) -> dict[str, int]:
        out: dict[str, int] = {}
        for _, name in self.files:
            out[name] = out.get(name, 0) + 1
        return out


def listed(root: str, spark: SparkSession | None) -> list[tuple[str, float]]:
    """(path, time of change) of all files under a root: of Spark's file systems if a session is given, else of local disks."""
    if spark is None:
        return [(path, os.path.getmtime(path)) for folder, _, names in os.walk(root) for n in names for path in [os.path.join(folder, n)]]
    start = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    files, out = start.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(start, True), []
    while files.hasNext():
        f = files.next()
        out.append((f.getPath().toString().removeprefix("file:"), f.getModificationTime() / 1000))
    return out


def plan_directories(roots: list[str], include: list[str] | None = None, exclude: list[str] | None = None, order: list[str] | None = None, spark: SparkSession | None = None) -> Plan:
    """Files under the roots that match, sorted by the first pattern of ``order`` that fits, then time, then path."""
    found = []
    for root in roots:
        for path, time in listed(root, spark):
            if _wanted(path, include, exclude):
                try:
                    found.append((path, reader_of(path)[0], time))
                except ValueError:
                    continue
    rank = lambda p: next((i for i, x in enumerate(order or ()) if fnmatch.fnmatch(p, x)), len(order or ()))
    return Plan([(p, r) for p, r, _ in sorted(found, key=lambda f: (rank(f[0]), f[2], f[0]))])


def read_plan(spark: SparkSession, plan: Plan, options: dict[str, dict] | None = None, report: bool = False, **common) -> DataFrame:
    """All records of a plan: raw, path, member. With ``report``, also a row without raw for each file that can't be read, the error as its member."""
    out = None
    for name in dict.fromkeys(r for _, r in plan.files):
        paths = [p for p, r in plan.files if r == name]
        read = next(f for _, n, f in REGISTRY if n == name)
        df = read(spark, paths, **(common | (options or {}).get(name, {})))
        out = df if out is None else out.union(df)
    if out is None:
        return spark.createDataFrame([], RECORD)
    return out if report else out.where(F.col("raw").isNotNull())
