"""Feature preparation with MLlib and column expressions."""

from __future__ import annotations

from pyspark.ml import Estimator, Pipeline
from pyspark.ml.feature import (
    HashingTF, NGram, Normalizer, OneHotEncoder, RegexTokenizer, SQLTransformer, StringIndexer,
    VectorAssembler,
)
from pyspark.sql import Column, DataFrame, functions as F

from tarnish.session import cut_lineage

# Size of the hashed text vector and the longest word sequence in it.
TEXT_DIMENSIONS = 10_000
MAX_NGRAM = 3
WORD = r"(?U)\b\w\w+\b"


def cast_to_text(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("string") for c in columns})


def standardise(df: DataFrame, columns: list[str], train: DataFrame | None = None) -> DataFrame:
    """(x - mean) / population standard deviation of the training rows; constants become 0.

    NaN is a missing cell: it takes no part in the fit and becomes NULL.
    """
    source = df if train is None else train
    known = {c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in columns}
    parts = [e for c in columns for e in (F.avg(known[c]).alias(f"a_{c}"), F.stddev_pop(known[c]).alias(f"s_{c}"))]
    fitted = source.agg(*parts).first()
    return df.withColumns({
        c: (known[c] - F.lit(fitted[f"a_{c}"])) / F.lit(fitted[f"s_{c}"] or 1.0) for c in columns})


def one_hot_stages(columns: list[str], suffix: str = "_hot") -> list:
    """Unknown and missing values give the zero vector."""
    indexer = StringIndexer(inputCols=columns, outputCols=[f"{c}_idx" for c in columns], handleInvalid="keep",
                            stringOrderType="alphabetAsc")
    # the indexer's last position stands for the unknown, and the encoder drops the last
    encoder = OneHotEncoder(inputCols=[f"{c}_idx" for c in columns], outputCols=[c + suffix for c in columns],
                            handleInvalid="error", dropLast=True)
    return [indexer, encoder]


def hashed_text_stages(column: str, into: str, dimensions: int = TEXT_DIMENSIONS) -> list:
    """Lower-cased words of two or more letters, as 1- to 3-grams, hashed and scaled to length 1."""
    words, grams = f"{column}_words", [f"{column}_{n}gram" for n in range(2, MAX_NGRAM + 1)]
    parts = ", ".join(f"`{c}`" for c in [words, *grams])
    return [
        RegexTokenizer(inputCol=column, outputCol=words, pattern=WORD, gaps=False, toLowercase=True),
        *[NGram(n=n, inputCol=words, outputCol=g) for n, g in zip(range(2, MAX_NGRAM + 1), grams)],
        SQLTransformer(statement=f"SELECT *, concat({parts}) AS `{column}_terms` FROM __THIS__"),
        HashingTF(inputCol=f"{column}_terms", outputCol=f"{column}_tf", numFeatures=dimensions),
        Normalizer(p=2.0, inputCol=f"{column}_tf", outputCol=into),
    ]


def term_counts(df: DataFrame, key: str, terms: str) -> DataFrame:
    """(key, terms, distinct_terms, commonest, letters, first_term, last_term) of the arrays of terms of each key.

    A row whose key no other has is counted where it lies, so its terms are not shuffled.  Rows that
    share a key, or have none, are counted together by (key, term), however many they are.
    """
    shared = cut_lineage(df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1).select(F.col(key).alias("_key")))
    if shared.isEmpty():
        return _counted_in_place(df, key, terms)
    same = F.col(key).eqNullSafe(F.col("_key"))
    many = df.join(shared, same, "left_semi").select(key, F.explode(terms).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("n"))
    together = many.groupBy(key).agg(
        F.sum("n").alias("terms"), F.count(F.lit(1)).alias("distinct_terms"), F.max("n").alias("commonest"),
        F.sum(F.col("n") * F.length("term")).alias("letters"), F.min("term").alias("first_term"), F.max("term").alias("last_term"))
    return _counted_in_place(df.join(shared, same, "left_anti"), key, terms).unionByName(together)


def _counted_in_place(df: DataFrame, key: str, terms: str) -> DataFrame:
    """Runs of equal terms in the sorted array; rows without terms are left out."""
    none = F.lit(0).cast("bigint")
    start = F.struct(none.alias("terms"), none.alias("distinct_terms"), none.alias("commonest"), none.alias("letters"),
                     F.lit(None).cast("string").alias("first_term"), F.lit(None).cast("string").alias("last_term"), none.alias("run"))

    def step(seen: Column, term: Column) -> Column:
        again = term.eqNullSafe(seen["last_term"])
        run = F.when(again, seen["run"] + 1).otherwise(F.lit(1).cast("bigint"))
        return F.struct((seen["terms"] + 1).alias("terms"), (seen["distinct_terms"] + (~again).cast("bigint")).alias("distinct_terms"),
                        F.greatest(seen["commonest"], run).alias("commonest"), (seen["letters"] + F.length(term)).alias("letters"),
                        F.coalesce(seen["first_term"], term).alias("first_term"), term.alias("last_term"), run.alias("run"))

    found = F.filter(F.array(F.aggregate(F.sort_array(terms), start, step)), lambda c: c["terms"] > 0)
    # the outer form, and the test on what comes out of it: either way the optimizer would count twice
    counted = df.select(key, F.explode_outer(found).alias("c")).where(F.col("c").isNotNull())
    return counted.select(key, *[f"c.{n}" for n in ("terms", "distinct_terms", "commonest", "letters", "first_term", "last_term")])


class PopulationScaler(Estimator):
    """Numbers minus their mean by their population deviation; fitted, it is one SQL projection."""

    def __init__(self, columns: list[str]):
        super().__init__()
        self.columns = list(columns)

    def _fit(self, dataset: DataFrame) -> SQLTransformer:
        parts = [e for i, c in enumerate(self.columns) for e in (F.avg(F.col(c).cast("double")).alias(f"a{i}"), F.stddev_pop(F.col(c).cast("double")).alias(f"s{i}"))]
        fitted = dataset.agg(*parts).first()
        cells = [f"(CAST(`{c}` AS DOUBLE) - ({fitted[f'a{i}'] or 0.0!r}D)) / {fitted[f's{i}'] or 1.0!r}D AS `{c}_scaled`" for i, c in enumerate(self.columns)]
        return SQLTransformer(statement=f"SELECT *, {', '.join(cells)} FROM __THIS__")


def feature_pipeline(numerical: list[str], categorical: list[str], text: list[str] | None = None,
                     into: str = "features") -> Pipeline:
    """Scaled numbers, one-hot categories and hashed text side by side."""
    stages, parts = [], []
    if numerical:
        stages.append(PopulationScaler(numerical))
        parts += [f"{c}_scaled" for c in numerical]
    if categorical:
        stages += one_hot_stages(categorical)
        parts += [f"{c}_hot" for c in categorical]
    for column in text or ():
        stages += hashed_text_stages(column, f"{column}_text_vector")
        parts.append(f"{column}_text_vector")
    if not parts:
        raise ValueError("no feature columns")
    return Pipeline(stages=[*stages, VectorAssembler(inputCols=parts, outputCol=into, handleInvalid="keep")])
