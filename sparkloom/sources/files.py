"""Files as tables: source code, JSON lines with the place of each error, numbered lines, run records."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import mean_line_length, without_license
from ..operators.dedup import keep_first
from .lines import numbered_lines

# Extensions of code files, folders that are never entered, and the largest file that is read.
CODE_EXTENSIONS = (
    "py", "js", "jsx", "ts", "tsx", "java", "kt", "go", "rs", "c", "h", "cc", "cpp", "hpp", "cs", "rb", "php", "swift", "scala", "sh", "sql", "lua", "dart",
)
SKIP_DIRS = (
    ".git", "node_modules", "__pycache__", "dist", "build", ".venv", "venv", "env", ".tox", "target", ".next", "coverage", ".mypy_cache", ".pytest_cache", "site-packages", "dist-packages",
)
MAX_FILE_BYTES = 500_000


def _quoted(words: Iterable[str]) -> str:
    return "|".join(w.replace(".", r"\.") for w in words)


def source_files(spark: SparkSession, folder: str, extensions: Iterable[str] = CODE_EXTENSIONS, skip: Iterable[str] = SKIP_DIRS) -> DataFrame:
    """path, relative, length, content of the files of the extensions below a folder. ``content`` is read only where it is selected."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    at = F.instr("path", folder.rstrip("/") + "/")
    relative = F.substring("path", at + len(folder.rstrip("/")) + 1, 1 << 20)
    kept = files.filter(F.col("path").rlike(rf"(?i)\.({_quoted(extensions)})$")).withColumn("relative", relative)
    return kept.filter(~F.col("relative").rlike(rf"(^|/)({_quoted(skip)})/")).select("path", "relative", "length", "content")


def fnmatch_pattern(glob: str) -> str:
    """A regular expression of a shell pattern over a whole path: * crosses slashes."""
    return "^" + "".join({"*": ".*", "?": "."}.get(c, "\\" + c if c in r".+()|^${}[]\\" else c) for c in glob) + "$"


def read_code(spark: SparkSession, folder: str, exclude: Iterable[str] = (), extensions: Iterable[str] = CODE_EXTENSIONS) -> DataFrame:
    """path, text: excluded, huge, binary, blank and minified files left out, licence headers stripped, bytes that are no UTF-8 replaced by U+FFFD, the first path of equal texts kept."""
    files = source_files(spark, folder, extensions).filter(F.col("length") <= MAX_FILE_BYTES)
    for glob in exclude:
        files = files.filter(~F.col("path").rlike(fnmatch_pattern(glob)))
    files = files.filter(~F.contains(F.substring("content", 1, 4096), F.lit(b"\0")))
    text = without_license(F.regexp_replace(F.make_valid_utf8(F.col("content").cast("string")), "\r\n", "\n"))
    files = files.select("path", text.alias("text")).filter(F.col("text").rlike(r"\S") & (mean_line_length(F.col("text")) <= 200))
    return keep_first(files.withColumn("digest", F.sha1("text")), ["digest"], "path").select("path", "text")


def read_examples(spark: SparkSession, folder: str, fields: tuple[str, ...] = ("prompt", "response"), pattern: str = "*.jsonl") -> DataFrame:
    """path, line and the fields of JSON lines; blank lines are skipped, and one that is not such an object stops the job and names path:line."""
    lines = numbered_lines(spark, folder, pattern).filter(F.col("content").rlike(r"\S"))
    parsed = lines.withColumn("row", F.from_json("content", ", ".join(f"{f} string" for f in fields) + ", _bad string", {"columnNameOfCorruptRecord": "_bad"}))
    wrong = reduce(lambda a, b: a | b, [F.col("row").isNull(), F.col("row._bad").isNotNull(), *[F.col(f"row.{f}").isNull() for f in fields]])
    message = F.concat("path", F.lit(":"), F.col("line").cast("string"), F.lit(f": expected an object of {', '.join(fields)}"))
    value = lambda f: F.when(wrong, F.raise_error(message).cast("string")).otherwise(F.col(f"row.{f}"))
    return parsed.select("path", "line", *[value(f).alias(f) for f in fields])


def read_runs(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Run records <folder>/<arm>/<seed>/result.json with their arm and seed."""
    runs = spark.read.schema(schema).option("multiLine", True).json(f"{folder}/*/*/result.json")
    parts = F.split(F.input_file_name(), "/")
    return runs.withColumn("arm", F.element_at(parts, -3)).withColumn("seed", F.element_at(parts, -2).cast("int"))


def line_window(text: Column, offset: int, limit: int, width: int = 2000) -> Column:
    """Array of (number from 1, line cut at ``width``) of the lines from ``offset`` (from 1) on."""
    lines = F.slice(F.split(text, "\n", -1), offset, limit)
    return F.transform(lines, lambda x, i: F.struct((i + offset).alias("number"), F.left(x, F.lit(width)).alias("line")))


def tree_rows(paths: DataFrame, depth: int = 6, limit: int = 500) -> DataFrame:
    """parent, name, is_file, place: entries of the folders that ``paths`` (path) spell, folders first, then by lower-case name; at most ``limit``."""
    parts = F.split("path", "/")
    steps = paths.select(parts.alias("p")).select("p", F.explode(F.sequence(F.lit(1), F.least(F.lit(depth), F.size("p")))).alias("k"))
    entries = steps.select(F.array_join(F.slice("p", 1, F.col("k") - 1), "/").alias("parent"), F.element_at("p", F.col("k")).alias("name"), (F.col("k") == F.size("p")).alias("is_file")).distinct()
    order = ["parent", "is_file", F.lower("name"), "name"]
    first = entries.orderBy(*order).limit(limit)  # a listing is cut by definition, so one task may number it
    return first.withColumn("place", F.row_number().over(Window.orderBy(*order)))
