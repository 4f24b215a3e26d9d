"""Readers for labelled tables, delimited text and images; writer for results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

# Texts that mean "missing" in delimited files, besides the caller's own.
NA_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>",
             "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None, *,
             na_values: tuple[str, ...] = ("?",), multi_line: bool = False) -> DataFrame:
    """CSV with a header line; missing markers become NULL.

    Without a schema, a column is BIGINT or DOUBLE when all its cells can be read so, else
    STRING; that takes one extra pass.
    """
    raw = spark.read.csv(path, header=True, inferSchema=False, quote='"', escape='"', multiLine=multi_line,
                         ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    return _typed(raw, schema, (*NA_TOKENS, *na_values))


def read_tsv(spark: SparkSession, path: str, schema: T.StructType | str, *, na_values: tuple[str, ...] = ()) -> DataFrame:
    """Tab-separated text without a header; names and types come from the schema."""
    fields = _struct(schema).fields
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in fields])
    raw = spark.read.schema(text).csv(path, sep="\t", header=False, quote='"', escape='"')
    return _typed(raw, schema, (*NA_TOKENS, *na_values))


def _struct(schema: T.StructType | str) -> T.StructType:
    return schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)


def _typed(raw: DataFrame, schema: T.StructType | str | None, tokens: tuple[str, ...]) -> DataFrame:
    cells = {c: F.when(F.col(f"`{c}`").isin(*tokens), None).otherwise(F.col(f"`{c}`")) for c in raw.columns}
    clean = raw.select(*[e.alias(c) for c, e in cells.items()])
    if schema is not None:
        return clean.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in _struct(schema).fields])
    checks = []
    for i, c in enumerate(raw.columns):
        cell = F.col(f"`{c}`")
        checks += [F.count_if(cell.isNotNull() & cell.try_cast("bigint").isNull()).alias(f"i{i}"),
                   F.count_if(cell.isNotNull() & cell.try_cast("double").isNull()).alias(f"d{i}"),
                   F.count(cell).alias(f"n{i}")]
    seen = clean.agg(*checks).first()

    def kind(i: int) -> str:
        if not seen[f"n{i}"]:
            return "string"
        return "bigint" if not seen[f"i{i}"] else "double" if not seen[f"d{i}"] else "string"

    return clean.select(*[F.col(f"`{c}`").cast(kind(i)).alias(c) for i, c in enumerate(raw.columns)])


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN and missing are one thing; floating columns carry NULL only."""
    floating = [f for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))]
    if not floating:
        return df
    return df.withColumns({f.name: F.nanvl(F.col(f.name), F.lit(None).cast(f.dataType)) for f in floating})


def read_table(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    """A typed table from any built-in columnar source."""
    return nan_to_null(spark.read.format(format).load(path))


def read_images(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    """An image table with ``pixels`` ARRAY<INT>; ``format="image"`` decodes picture files.

    Decoded pictures come back as (origin, height, width, pixels), grey values being the
    mean of the colour channels.
    """
    if format != "image":
        return spark.read.format(format).load(path)
    files = spark.read.format("image").option("dropInvalid", True).load(path).select("image.*")
    channels = F.least(F.col("nChannels"), F.lit(3))

    def byte(i: Column) -> Column:
        return F.conv(F.hex(F.substr(F.col("data"), i + 1, F.lit(1))), 16, 10).cast("int")

    def grey(i: Column) -> Column:
        total = F.aggregate(F.sequence(F.lit(0), channels - 1), F.lit(0),
                            lambda a, c: a + byte(i * F.col("nChannels") + c))
        return F.floor(total / channels).cast("int")

    cells = F.sequence(F.lit(0), F.col("height") * F.col("width") - 1)
    return files.select("origin", "height", "width", F.transform(cells, grey).alias("pixels"))


def write_results(results: DataFrame, path: str, format: str = "json", mode: str = "errorifexists") -> None:
    """Save an evaluation result as JSON lines, Parquet or any other built-in format."""
    results.write.format(format).mode(mode).save(path)
