"""Text tables: Parquet with the text column found by name, and line files."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from langloom.sources.registry import LANGUAGES, resolve
from langloom.workspace import written


def leaves(schema: T.DataType, prefix: str = "") -> Iterator[str]:
    """Dotted names of the leaves, depth first."""
    for field in schema.fields:
        kind, name = field.dataType, f"{prefix}{field.name}"
        while isinstance(kind, T.ArrayType):
            kind = kind.elementType
        if isinstance(kind, T.StructType):
            yield from leaves(kind, f"{name}.")
        else:
            yield name


def find_column(schema: T.StructType, text_col: str) -> str:
    """The first leaf that is ``text_col`` or ends in it after a dot."""
    every = list(leaves(schema))
    for name in every:
        if name == text_col or name.endswith(f".{text_col}"):
            return name
    raise ValueError(f"no column {text_col!r}; columns: {', '.join(every)}")


def texts_of(df: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``keep`` and ``text``: rows whose text is there and not empty. A column that isn't a string has none."""
    name = find_column(df.schema, text_col)
    path = ".".join(f"`{p}`" for p in name.split("."))
    rows = df.select(*keep, F.col(path).alias("text"))
    if not isinstance(rows.schema["text"].dataType, T.StringType):
        return rows.select(*keep, F.lit(None).cast("string").alias("text")).limit(0)
    return rows.where("text IS NOT NULL AND text <> ''")


def read_parquet_texts(spark: SparkSession, path: str | list[str], text_col: str = "text") -> DataFrame:
    """text, with _file and _row, which order the scan."""
    df = spark.read.parquet(*([path] if isinstance(path, str) else path))
    rows = df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    return texts_of(rows, text_col, ("_file", "_row"))


def read_text_lines(spark: SparkSession, path: str) -> DataFrame:
    """text, a line each, with _file, _block and _row, which order the scan; blank lines are left out, others kept as they are.

    A line that isn't UTF-8 is an error. _row grows within a block of a file, so it holds for one reading only.
    """
    raw = spark.read.option("lineSep", "\n").text(path)
    raw = raw.select(F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_row"), F.validate_utf8("value").alias("v"))
    return raw.select("_file", "_block", "_row", F.regexp_replace("v", "\r$", "").alias("text")).where(~F.col("text").rlike(r"^\p{IsWhite_Space}*$"))


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def list_parquet(spark: SparkSession, root: str, prefixes: list[str]) -> list[str]:
    """Sorted Parquet files, at any depth, below the first prefix that has one."""
    jvm = spark._jvm
    for prefix in prefixes:
        base = jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{prefix}")
        fs = base.getFileSystem(spark._jsc.hadoopConfiguration())
        if fs.exists(base):
            found, walk = [], fs.listFiles(base, True)
            while walk.hasNext():
                name = walk.next().getPath().toString()
                if name.endswith(".parquet"):
                    found.append(name)
            if found:
                return sorted(found)
    raise FileNotFoundError(f"no Parquet files under {root} for {prefixes}")


#: What orders the texts of a language as a scan of its files would.
SCAN_ORDER = ["_file", "_block", "_row"]


def _ordered(rows: DataFrame, code: str) -> DataFrame:
    block = F.col("_block") if "_block" in rows.columns else F.lit(0).cast("long")
    return rows.select(F.lit(code).alias("lang"), "_file", block.alias("_block"), "_row", "text")


def read_corpus(spark: SparkSession, directory: str, codes: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """lang, text and SCAN_ORDER of each language's <code>.parquet or else <code>.txt in a directory."""
    parts = []
    for code in resolve(codes):
        base = f"{directory.rstrip('/')}/{code}"
        if _exists(spark, f"{base}.parquet"):
            parts.append(_ordered(read_parquet_texts(spark, f"{base}.parquet", text_col), code))
        elif _exists(spark, f"{base}.txt"):
            parts.append(written(_ordered(read_text_lines(spark, f"{base}.txt"), code), "lines"))
        else:
            raise FileNotFoundError(f"neither {base}.parquet nor {base}.txt")
    return reduce(DataFrame.unionByName, parts)


def read_listed_corpus(spark: SparkSession, root: str, codes: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """lang, text and SCAN_ORDER of each language's listed files: <root>/<dataset>/<prefix>…, by the first prefix that has any.

    ``root`` is a directory of datasets on any file system that Spark has: a mirror, an object store, a dataset hub.
    """
    known = {code: (repo, prefixes) for code, repo, prefixes in LANGUAGES}
    parts = []
    for code in resolve(codes):
        repo, prefixes = known[code]
        parts.append(_ordered(read_parquet_texts(spark, list_parquet(spark, f"{root.rstrip('/')}/{repo}", prefixes), text_col), code))
    return reduce(DataFrame.unionByName, parts)
