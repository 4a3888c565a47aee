"""Delimited text sources and sinks (S1–S6) and the parameter table.

Everything stays distributed. Of one file, the driver reads the header line to choose
its delimiter and one row that says which columns are numeric. Many files are read as
lines with the file that each came from: the first line of a file gives its delimiter
and column names, and its other lines meet them in a join by file. So files with other
delimiters, column orders and columns go through one plan, and the number of jobs does
not depend on the number of files.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import written


def sniff_delimiter(spark: SparkSession, path: str) -> str:
    """S1: ';' if the header line holds more ';' than ',', else ','."""
    head = spark.read.text(path).limit(1).collect()
    line = head[0][0] if head else ""
    return ";" if line.count(";") > line.count(",") else ","


def _locale_number(c: Column) -> Column:
    """Blank -> null; decimal comma -> dot; then a tolerant cast."""
    s = F.trim(c)
    return F.when(s == "", None).otherwise(F.regexp_replace(s, ",", ".").try_cast("double"))


def read_delimited(spark: SparkSession, path, sep: str | None = None) -> DataFrame:
    """S1 + S2 (+ S4): read a delimited file with delimiter detection and
    per-column type inference. A column is DOUBLE only when every non-blank
    cell parses as a number (decimal comma accepted); otherwise it stays a
    trimmed STRING. Nulls never turn a numeric column into text. ``path`` names one file
    or files of one layout; a list of paths is matched by column name."""
    if not isinstance(path, str):
        return read_delimited_many(spark, path)
    sep = sep or sniff_delimiter(spark, path)
    raw = (spark.read.option("header", True).option("sep", sep).option("quote", '"')
           .option("inferSchema", False).csv(path))
    # Spark numbers repeated headers by position; the header line has the true names.
    head = spark.read.option("sep", sep).option("quote", '"').csv(path).first()
    names = [(n or "").strip() for n in head] if head and len(head) == len(raw.columns) else [n.strip() for n in raw.columns]
    places = [f"_{i}" for i in range(len(names))]
    raw = raw.toDF(*places)
    checks = [F.count_if(F.trim(F.col(p)).__ne__("") & _locale_number(F.col(p)).isNull()).alias(f"c{i}")
              for i, p in enumerate(places)]
    bad = raw.agg(*checks).first()
    cols = []
    for i, n in enumerate(names):
        c = F.col(places[i])
        if bad[f"c{i}"] == 0:
            cols.append(_locale_number(c).alias(n))
        else:
            s = F.trim(c)
            cols.append(F.when(s == "", None).otherwise(s).alias(n))
    return raw.select(*cols)


def _outside_quotes(sep: str) -> str:
    return sep + r'(?=(?:[^"]*"[^"]*")*[^"]*$)'


def header_names(line: Column, sep: Column, synonyms: dict[str, str] | None = None) -> Column:
    """Column names of a header line: parted outside quotes, trimmed; a repeated name
    gets the number of its occurrence behind it (``v``, ``v_2``). With ``synonyms``
    names are lower-cased and replaced by what they stand for (D1)."""
    parts = F.when(sep == ";", F.split(line, _outside_quotes(";"))).otherwise(F.split(line, _outside_quotes(",")))
    plain = F.transform(parts, lambda x: F.trim(F.regexp_replace(F.trim(x), '^"|"$', "")))
    if synonyms:
        known = F.create_map(*[F.lit(x) for pair in synonyms.items() for x in pair])
        plain = F.transform(plain, lambda x: F.coalesce(F.get(F.map_values(F.map_filter(known, lambda k, _: k == F.lower(x))), 0), F.lower(x)))

    def numbered(x: Column, i: Column) -> Column:
        earlier = F.size(F.filter(F.slice(plain, 1, i), lambda y: y == x))
        return F.when(earlier > 0, F.concat(x, F.lit("_"), (earlier + 1).cast("string"))).otherwise(x)

    return F.transform(plain, numbered)


def _lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file, place, opens, value): lines that are not empty, their file, their place in
    its order within a split, and whether the split is the file's first."""
    return (spark.read.text(paths)
            .select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("place"),
                    (F.col("_metadata.file_block_start") == 0).alias("opens"), F.col("value"))
            .where(F.col("value") != ""))


def file_layouts(spark: SparkSession, paths: list[str], synonyms: dict[str, str] | None = None) -> DataFrame:
    """S1 for many files, sniffed in the tasks that read them: per file its delimiter
    (``;`` if the first line holds more of them than ``,``), column names and the place of
    the header line. Written once to the shared directory."""
    first = _lines(spark, paths).where("opens").groupBy("file").agg(F.min_by("value", "place").alias("line"), F.min("place").alias("head"))
    line = F.regexp_replace("line", "^\ufeff", "")
    count = lambda c: F.length(line) - F.length(F.replace(line, F.lit(c), F.lit("")))
    first = first.select("file", "head", line.alias("line"), F.when(count(";") > count(","), ";").otherwise(",").alias("sep"))
    return written(first.select("file", "head", "sep", header_names(F.col("line"), F.col("sep"), synonyms).alias("names")), "layouts")


def read_delimited_many(spark: SparkSession, paths: list[str] | str, file_column: str | None = None,
                        synonyms: dict[str, str] | None = None) -> DataFrame:
    """S1 + S2 (+ S4) for many files, folders or patterns: one table by column *name*.

    Columns stand in the order of their least position in any file, then by name; a file
    without a column has nulls there. Types are merged over all files: a column is DOUBLE
    only when every non-blank cell of every file parses as a number (decimal comma
    accepted), else a trimmed STRING; one pass over the lines decides all columns. A line
    ends a record, also within quotes. ``file_column`` adds each row's file path;
    ``synonyms`` normalises names before files are matched by them. A header line alone gives columns without rows; nothing to read gives a table without columns.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    layouts = file_layouts(spark, paths, synonyms)
    named = layouts.select(F.posexplode("names").alias("at", "name")).groupBy("name").agg(F.min("at").alias("at"))
    names = [r["name"] for r in named.orderBy("at", "name").collect()]  # the schema
    width = layouts.agg(F.max(F.size("names"))).first()[0] or 0
    if not width:
        return spark.createDataFrame([], T.StructType([]))
    schema = ", ".join(f"_{i} string" for i in range(width))
    parsed = lambda sep: F.from_csv("value", schema, {"sep": sep, "quote": '"'})
    cells = F.when(F.col("sep") == ";", parsed(";")).otherwise(parsed(","))
    body = (_lines(spark, paths).join(layouts, "file").where(~(F.col("opens") & (F.col("place") == F.col("head"))))
            .select("file", "names", cells.alias("c"))
            .select("file", "names", F.array(*[F.col(f"c._{i}") for i in range(width)]).alias("cells")))

    def cell(name: str) -> Column:
        at = F.array_position("names", F.lit(name)).cast("int")
        text = F.trim(F.get("cells", at - 1))
        return F.when((at > 0) & (text != ""), text)

    placed = body.select("file", *[cell(n).alias(f"_{i}") for i, n in enumerate(names)])
    bad = placed.agg(*[F.count_if(F.col(f"_{i}").isNotNull() & _locale_number(F.col(f"_{i}")).isNull()).alias(f"_{i}")
                       for i in range(len(names))]).first()
    typed = [(F.col(f"_{i}") if bad[i] else _locale_number(F.col(f"_{i}"))).alias(n) for i, n in enumerate(names)]
    return placed.select(*typed, *([F.col("file").alias(file_column)] if file_column else []))


def read_csv_typed(spark: SparkSession, path: str, schema: T.StructType | str, sep: str = ",") -> DataFrame:
    """S3: plain CSV with a declared schema (no inference pass)."""
    return spark.read.option("header", True).option("sep", sep).schema(schema).csv(path)


def to_locale_strings(df: DataFrame) -> DataFrame:
    """Doubles rendered with a decimal comma (for S5)."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(F.regexp_replace(c.cast("string"), r"\.", ",").alias(f.name))
        else:
            cols.append(c)
    return df.select(*cols)


def write_locale_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """S5: ';' separated, decimal comma, nulls written as NA."""
    (to_locale_strings(df).write.mode(mode).option("header", True).option("sep", ";")
     .option("nullValue", "NA").option("emptyValue", "").csv(path))


def write_forecast_csv(forecast: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Header + RFC-4180 quoting; refuses an empty forecast."""
    if forecast.isEmpty():
        raise ValueError("no forecast to export")
    forecast.write.mode(mode).option("header", True).option("quoteAll", False).option("escape", '"').csv(path)


# --- parameter table (S8) -----------------------------------------------------

def normalise_source(c: Column) -> Column:
    """Trim and collapse runs of blanks ('Simplified  Model' -> 'Simplified Model')."""
    return F.regexp_replace(F.trim(c), r"\s+", " ")


def read_params(spark: SparkSession, path: str) -> DataFrame:
    """Long parameter table ``(source, name, value STRING, ord BIGINT)``.

    ``ord`` keeps file order so that "first match wins" is well defined."""
    df = read_delimited(spark, path)
    df = df.select(*[F.col(c).cast("string").alias(c) for c in df.columns])
    return df.select(normalise_source(F.col("source")).alias("source"), F.trim("name").alias("name"),
                     F.col("value"), F.monotonically_increasing_id().alias("ord"))


def params_wide(params: DataFrame, source: str) -> DataFrame:
    """One row per source: first value per name as DOUBLE (non-numeric -> NaN)."""
    src = re.sub(r"\s+", " ", source.strip())
    first = (params.where(F.col("source") == src).groupBy("name")
             .agg(F.min_by("value", "ord").alias("value")))
    num = F.coalesce(F.trim("value").try_cast("double"), F.lit(float("nan")))
    return first.select(F.lit(src).alias("source"), "name", num.alias("value")) \
        .groupBy("source").pivot("name").agg(F.first("value"))


def param_values(params: DataFrame, source: str, names: dict[str, str],
                 defaults: dict[str, float] | None = None) -> dict[str, float]:
    """S8 as configuration: look up a handful of named values of one source.

    Parameters are configuration, not data: the result is a small dict
    (first match wins, missing -> default, non-numeric -> NaN)."""
    defaults = defaults or {}
    row = params_wide(params, source).first()
    out = {}
    have = row.asDict() if row else {}
    for key, pname in names.items():
        if pname in have and have[pname] is not None:
            out[key] = float(have[pname])
        else:
            out[key] = defaults.get(key, float("nan"))
    return out
