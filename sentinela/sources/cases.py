"""Case files: scan, type, profile, store."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sentinela.functions.raw import is_whole, present
from sentinela.operators.quality import drop_pii, select_columns
from sentinela.schema import CASE_TYPES, ONSET
from sentinela.sources.hashing import STEP, WHOLE, hashed_in_steps, in_steps, resumable

DEFAULT_ENCODING = "ISO-8859-1"


def read_case_csv(spark: SparkSession, path: str, encoding: str = DEFAULT_ENCODING) -> DataFrame:
    """A `;`-separated case file with a header, every column as text.

    No schema is given: Spark binds a schema by position, and the files differ in layout. The header of
    every file is checked against the first one's, so files of another layout are refused, not misread.
    """
    reader = spark.read.options(header=True, sep=";", encoding=encoding, quote='"', escape='"', enforceSchema=False)
    try:
        return reader.csv(path)
    except AnalysisException as exc:
        if exc.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(f"CSV not found: {path}") from exc
        raise


def parse_case_lines(lines: DataFrame, columns: list[str], line: str = "line") -> DataFrame:
    """Text lines in the layout of `columns` as a raw case table; other columns of `lines` are kept."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    parsed = F.from_csv(line, schema, {"sep": ";", "quote": '"', "escape": '"', "mode": "FAILFAST"})
    return lines.withColumn("_row", parsed).select(*[c for c in lines.columns if c != line], "_row.*")


def _typed(name: str, kind: str) -> Column:
    """A column cast strictly. Most values are what they should be: only the others are looked at for what they spell."""
    raw = F.col(name).cast("string")
    value = present(raw)
    if kind == "string":
        return value
    if kind != "int":
        return F.coalesce(raw.try_cast(kind), value.cast(kind))
    # a column with blanks comes back from a rewrite with its codes as 1.0
    message = F.concat(F.lit(f"no whole number in {name}: "), value)
    spelled = F.when(is_whole(value), value.try_cast("double").cast("int")).when(value.isNotNull(), F.raise_error(message).cast("int"))
    return F.coalesce(raw.try_cast("int"), spelled)


def clean_cases(raw: DataFrame) -> DataFrame:
    """Personal data dropped, the known columns kept in their order and cast strictly to their types.

    Missing-value spellings give NULL. Codes may be written as whole decimals; any other text in a coded column, and any
    text that is no date in a date column, raises an error.
    """
    kept, _ = select_columns(drop_pii(raw))
    return kept.select(*[_typed(c, CASE_TYPES[c]).alias(c) for c in kept.columns])


def malformed_values(raw: DataFrame) -> DataFrame:
    """How many values of each typed column a strict cast would refuse: (column, malformed, example)."""
    typed = [c for c in CASE_TYPES if c in raw.columns and CASE_TYPES[c] != "string"]
    value = {c: present(F.col(c).cast("string")) for c in typed}
    fits = {c: is_whole(value[c]) if CASE_TYPES[c] == "int" else value[c].try_cast(CASE_TYPES[c]).isNotNull() for c in typed}
    bad = {c: value[c].isNotNull() & ~fits[c] for c in typed}
    counts = raw.agg(*[
        F.struct(F.lit(c).alias("column"), F.count_if(bad[c]).alias("malformed"), F.min(F.when(bad[c], F.col(c))).alias("example"))
        .alias(c) for c in typed
    ])
    return counts.select(F.inline(F.array(*typed)))


def load_cases(spark: SparkSession, path: str, encoding: str = DEFAULT_ENCODING, view: str = "srag") -> DataFrame:
    """Scan and clean a case file and name the result for SQL."""
    cases = clean_cases(read_case_csv(spark, path, encoding))
    cases.createOrReplaceTempView(view)
    return cases


def write_cases(cases: DataFrame, path: str) -> None:
    """Store cleaned cases by onset month, so a period reads its months only.

    The rebalance hint lets Spark split a month with a large share of the cases over several files and
    put small months together in one task.
    """
    months = cases.withColumn("onset_month", F.date_format(ONSET, "yyyy-MM"))
    months.hint("rebalance", "onset_month").write.mode("overwrite").partitionBy("onset_month").parquet(path)


def extraction_date(file_name: Column) -> Column:
    """Date in a name ending `DD-MM-YYYY.csv` as `YYYY-MM-DD`, else `unknown`."""
    pattern = r"(\d{2})-(\d{2})-(\d{4})\.csv\z"
    day, month, year = (F.regexp_extract(file_name, pattern, i) for i in (1, 2, 3))
    return F.when(file_name.rlike(pattern), F.concat_ws("-", year, month, day)).otherwise("unknown")


def fingerprint(content: Column) -> dict[str, Column]:
    """Length, SHA-256 and UTF-8 check of a file's content."""
    return {
        "length": F.octet_length(content).cast("bigint"), "sha256": F.sha2(content, 256),
        "valid_utf8": F.is_valid_utf8(content.cast("string")),
    }


def source_files(spark: SparkSession, path: str, whole: int = WHOLE, step_bytes: int = STEP) -> DataFrame:
    """Provenance of each file: file_name, length, sha256, extraction_date, valid_utf8, encoding.

    A file of up to `whole` bytes is hashed as one value; larger ones are read in splits and hashed in steps when this is
    called, see `hashing`. Compressed files (`.gz` and such), and all where Python has no OpenSSL, are one value whatever their
    size. A value, or a line of a larger file, of 2 GiB or more raises Spark's error, which names the file. The reading encoding is Latin-1 either way: files that
    look like ASCII or UTF-8 are read as Latin-1 too.
    """
    files = spark.read.format("binaryFile").load(path)
    large = files.filter(in_steps(whole)).select("path", "length", F.col("_metadata.file_path").alias("file"))
    name = F.element_at(F.split("path", "/"), -1)
    columns = [
        name.alias("file_name"), "length", "sha256", extraction_date(name).alias("extraction_date"), "valid_utf8",
        F.lit(DEFAULT_ENCODING).alias("encoding"),
    ]
    if not resumable() or large.isEmpty():
        return files.withColumns(fingerprint(F.col("content"))).select(columns)
    small = files.filter(~in_steps(whole)).withColumns(fingerprint(F.col("content"))).select(columns)
    return small.unionByName(large.join(hashed_in_steps(spark, path, whole, step_bytes), "file").select(columns))
