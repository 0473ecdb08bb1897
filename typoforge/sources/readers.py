"""Sources: snippet loaders, sample files, benchmark records, vocabularies, discovery.

A cap counts raw rows where the loader reads a prefix (rows by their id), and good rows where it says so.
Registry entries take a frame of raw rows, so the same loader serves any storage that Spark reads.
"""

from __future__ import annotations

import tomllib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..fixed import GITHUB_CAP, GITHUB_MIN_CHARS, GITHUB_SEED, SPLIT_SIZES
from ..functions.names import seeded
from ..functions.text import python_blocks
from ..operators.ranks import rank_by_id
from ..schemas import BENCHMARK, SAMPLE
from .files import file_prefixes, text_of

DEMO = (
    "def mean_value(numbers):\n    # average of a list of numbers\n    total = 0\n    for number in numbers:\n        total += number\n    return total / max(len(numbers), 1)\n",
    "class Counter:\n    def __init__(self, start):\n        self.current = start\n\n    def advance(self, amount=1):\n        # move the counter forward\n        self.current += amount\n        return self.current\n",
    "import os as system\n\ndef list_files(folder):\n    # names of plain files only\n    return [entry for entry in system.listdir(folder) if '.' in entry]\n",
    "def outer(values):\n    result = []\n    def inner(item):\n        result = item * 2  # local copy\n        return result\n    for value in values:\n        result.append(inner(value))\n    return result\n",
    "def parse_line(line, separator=','):\n    # split and strip every field\n    fields = line.split(separator)\n    return [field.strip() for field in fields]\n",
    "async def fetch_pages(client, addresses):\n    pages = {}\n    for address in addresses:\n        pages[address] = await client.get(address)\n    return pages\n",
    "def safe_divide(numerator, denominator):\n    try:\n        return numerator / denominator\n    except ZeroDivisionError as problem:\n        print(f'cannot divide: {problem}')\n        return None\n",
    "def count_words(document):\n    counts = {}\n    for word in document.lower().split():\n        counts[word] = counts.get(word, 0) + 1\n    return counts\n",
)


def first_rows(rows: DataFrame, n: int | None, by: str = "id") -> DataFrame:
    """The first n rows in order of an id (all if n is None)."""
    return rows if n is None else rows.orderBy(by).limit(n)


def load_demo(spark: SparkSession, max_samples: int | None = None) -> DataFrame:
    rows = spark.createDataFrame(list(enumerate(DEMO)), "id long, code string")
    return first_rows(rows, max_samples).select("id", "code")


def load_mbpp(rows: DataFrame, max_samples: int | None = None) -> DataFrame:
    """Rows with a code column; the cap counts raw rows, empty ones included."""
    return first_rows(rows, max_samples).filter(F.col("code") != "").select("id", "code")


def load_code_search_net(rows: DataFrame, max_samples: int | None = None) -> DataFrame:
    """whole_func_string, or else func_code_string (an empty string counts as missing)."""
    code = F.coalesce(F.nullif("whole_func_string", F.lit("")), F.nullif("func_code_string", F.lit("")))
    return first_rows(rows, max_samples).select("id", code.alias("code")).filter("code is not null")


def ordinal_split(rows: DataFrame, source: str, split: str, by: str = "id", max_samples: int | None = None, compat: bool = False, sizes: dict[str, int] | None = None) -> DataFrame:
    """The rows of a split by their rank: train first, then validation, then test; none of an unknown split.

    max_samples caps the split; with compat it caps the absolute end, so that late splits may be empty.  sizes
    stands for the source's own sizes.
    """
    start, end = split_range(source, split, sizes)
    if max_samples is not None:
        end = min(end, max_samples if compat else start + max_samples)
    ranked = rank_by_id(rows, by)
    return ranked.filter((F.col("ordinal") >= start) & (F.col("ordinal") < end)).drop("ordinal")


def split_range(source: str, split: str, sizes: dict[str, int] | None = None) -> tuple[int, int]:
    at = 0
    for name in ("train", "validation", "test"):
        size = (SPLIT_SIZES.get(source, {}) if sizes is None else sizes).get(name, 0)
        if name == split:
            return at, at + size
        at += size
    return 0, 0


def magicoder_rows(rows: DataFrame) -> DataFrame:
    return rows.filter("lang = 'python'").select("id", python_blocks(F.col("solution")).alias("code")).filter("code is not null")


def load_magicoder(rows: DataFrame, split: str = "train", max_samples: int | None = None, compat: bool = False, sizes: dict[str, int] | None = None) -> DataFrame:
    """Python solutions' fenced blocks, split by rank."""
    return ordinal_split(magicoder_rows(rows), "magicoder", split, max_samples=max_samples, compat=compat, sizes=sizes)


def codealpaca_rows(rows: DataFrame) -> DataFrame:
    python = F.lower("instruction").contains("python") | F.lower("output").contains("python")
    code = F.trim(F.regexp_replace(F.regexp_replace("output", r"^\s+", ""), r"\s+$", ""))
    return rows.filter(python).select("id", code.alias("code")).filter(F.length("code") > 10)


def load_codealpaca(rows: DataFrame, split: str = "train", max_samples: int | None = None, compat: bool = False, sizes: dict[str, int] | None = None) -> DataFrame:
    return ordinal_split(codealpaca_rows(rows), "codealpaca", split, max_samples=max_samples, compat=compat, sizes=sizes)


def load_github_python(rows: DataFrame, max_samples: int | None = None, seed: int = GITHUB_SEED) -> DataFrame:
    """A seeded sample of texts of 20 characters or more; the cap counts good rows."""
    good = rows.filter(F.length("text") >= GITHUB_MIN_CHARS)
    return good.orderBy(seeded(seed, F.col("id")), "id").limit(max_samples or GITHUB_CAP).select("id", F.col("text").alias("code"))


REGISTRY: dict[str, Callable[..., DataFrame]] = {
    "demo": load_demo,
    "mbpp": load_mbpp,
    "code_search_net": load_code_search_net,
    "magicoder": load_magicoder,
    "codealpaca": load_codealpaca,
    "github_python": load_github_python,
}


def iter_source(name: str, rows: DataFrame | SparkSession, **options) -> DataFrame:
    """The loader of a name; an unknown name is an error that lists the known ones."""
    if name not in REGISTRY:
        raise ValueError(f"unknown source {name!r}; known: {', '.join(sorted(REGISTRY))}")
    return REGISTRY[name](rows, **options)


def read_samples(spark: SparkSession, *paths: str) -> DataFrame:
    """Sample files (JSON lines; blank lines are skipped, malformed ones are an error), bag union in any number."""
    return spark.read.schema(SAMPLE).option("mode", "FAILFAST").json(list(paths))


def read_benchmarks(spark: SparkSession, path: str) -> DataFrame:
    """Benchmark records of a folder: without failed ones, the last file of each (dataset, model)."""
    rows = spark.read.schema(BENCHMARK).option("multiLine", True).json(path).withColumn("file", F.col("_metadata.file_name"))
    good = rows.filter("error is null and metrics is not null").withColumn("model", F.coalesce("model", F.regexp_replace("file", r"\.[^.]*$", ""))).withColumn("dataset", F.coalesce("dataset", F.lit("unknown")))
    last = Window.partitionBy("dataset", "model").orderBy(F.col("file").desc())
    return good.withColumn("rank", F.row_number().over(last)).filter("rank = 1").drop("rank")


def read_presets(path: str) -> dict[str, dict]:
    """Top-level tables of a TOML file (FileNotFoundError if there is none)."""
    with open(path, "rb") as f:
        return {k: v for k, v in tomllib.load(f).items() if isinstance(v, dict)}


def read_vocab(spark: SparkSession, path: str) -> DataFrame:
    """idx, tag of a vocabulary file: one tag a line, blank lines dropped."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.filter(F.split("value", "\r?\n"), lambda x: F.trim(x) != "")))
    return lines.select(F.col("pos").alias("idx"), F.col("col").alias("tag"))


def discover(spark: SparkSession, path: str, pattern: str = "*.json*") -> DataFrame:
    """path, bytes, kind of data files below a folder; results are told from datasets by their first 512 characters.

    Executors read these heads, four bytes for each character at most.
    """
    head = F.substring(text_of(F.col("data")), 1, 512)
    result = head.contains('"metrics"') & head.contains('"per_sample"')
    return file_prefixes(spark, path, pattern=pattern, prefix=2048).select("path", "bytes", F.when(result, "result").otherwise("dataset").alias("kind"))


def checkpoints(spark: SparkSession, folder: str) -> DataFrame:
    """path: folders below one that hold a vocab.txt."""
    return file_prefixes(spark, folder, pattern="vocab.txt").select(F.regexp_replace("path", "/vocab\\.txt$", "").alias("path"))


def training_files(spark: SparkSession, path: str, part: str) -> DataFrame:
    """Sample files whose name contains a word (train, val), in any case."""
    return discover(spark, path).filter(F.lower(F.element_at(F.split("path", "/"), -1)).contains(part.lower()))


def within_bytes(lines: DataFrame, cap: int, by: str = "id", text: str = "text", bucket: int = 10_000, flag: bool = False) -> DataFrame:
    """The leading lines (by id) whose running size in UTF-8 bytes is within a cap; flag adds truncated, whether any is left out.

    Sizes are summed by id bucket first, so that no task holds all lines: a bucket's offset is the sum of those before.
    """
    size = lines.withColumn("_bucket", F.floor(F.col(by) / bucket)).withColumn("_size", F.octet_length(text).cast("long"))
    sums = size.groupBy("_bucket").agg(F.sum("_size").alias("_sum"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offset = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0))).filter(F.col("_before") <= cap).drop("_sum")
    inside = Window.partitionBy("_bucket").orderBy(by)
    run = size.join(offset, "_bucket").withColumn("running_bytes", F.col("_before") + F.sum("_size").over(inside))
    kept = run.filter(F.col("running_bytes") <= cap).drop("_bucket", "_size", "_before")
    if not flag:
        return kept
    whole = sums.agg((F.sum("_sum") > cap).alias("truncated"))  # one row
    return kept.crossJoin(F.broadcast(whole))


def kind_of(column: Column) -> Column:
    return F.when(F.coalesce(column, F.lit(False)), "error").otherwise("clean")
