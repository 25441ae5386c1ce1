"""Vocabulary tables in a database, read in ranges of the id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termweave.operators import clean, vocab
from termweave.sources.files import CLEANERS, COLUMNS, expected

TABLES = {"concept": ("concept", "concept_id"), "relationship": ("concept_relationship", "concept_id_1"), "synonym": ("concept_synonym", "concept_id")}
#: Keys that bounds are taken from; every so many-th id is read for them, by a prime.
SAMPLE = 100_000
PRIMES = (1, 2, 3, 7, 13, 31, 61, 127, 251, 509, 1021, 2039, 4093, 8191, 16381, 32749, 65521, 131071, 262139, 524287, 1048573)


class JdbcSource:
    """Each table is split into ``parts`` ranges of its id, read in parallel; filters and columns go to the database.

    The ranges hold like many rows: their bounds are quantiles of a sample of the ids,
    which the database draws, so ids that lie close together don't fall in a few of them. Rows
    without an id are a range of their own. ``even`` cuts ``lowest`` to ``highest``
    evenly instead, without asking the database first.
    """

    def __init__(self, spark: SparkSession, url: str, schema: str = "public", parts: int = 32, lowest: int = 0, highest: int = 2_100_000_000, properties: dict[str, str] | None = None, even: bool = False):
        self.spark, self.url, self.schema, self.parts, self.even = spark, url, schema, parts, even
        self.bounds, self.properties = (lowest, highest), properties or {}

    def options(self, name: str) -> dict:
        table, key = TABLES[name]
        return {"url": self.url, "table": f"{self.schema}.{table}", "column": key, "lowerBound": self.bounds[0], "upperBound": self.bounds[1], "numPartitions": self.parts, "properties": self.properties}

    def _quoted(self, column: str) -> str:
        """``column`` as this database writes names."""
        return self.spark._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(self.url).quoteIdentifier(column)

    def _ask(self, sql: str) -> DataFrame:
        return self.spark.read.jdbc(self.url, f"({sql}) asked", properties=self.properties)

    def _count(self, name: str, where: str = "") -> int:
        """The rows of a table, counted by the database."""
        return int(self._ask(f"SELECT COUNT(*) AS n FROM {self.schema}.{TABLES[name][0]}{where}").first()[0])

    def ranges(self, name: str) -> list[str]:
        """Conditions that split a table: each row meets one of them."""
        table, column = TABLES[name]
        key, n = self._quoted(column), self._count(name)
        step = next((p for p in PRIMES if n <= p * SAMPLE), PRIMES[-1])
        ids = self._ask(f"SELECT {key} AS k FROM {self.schema}.{table} WHERE {key} IS NOT NULL AND MOD({key}, {step}) = 0").toDF("k").select(F.col("k").cast("long").alias("k"))
        shares = [i / self.parts for i in range(1, self.parts)]
        found = ids.agg(F.percentile_approx("k", F.array(*map(F.lit, shares)), 10_000).alias("q")).first().q if shares else []
        cuts = sorted(set(found or []))
        if not cuts:
            return [f"{key} IS NOT NULL", f"{key} IS NULL"]
        inner = [f"{key} >= {a} AND {key} < {b}" for a, b in zip(cuts, cuts[1:])]
        return [f"{key} < {cuts[0]}", *inner, f"{key} >= {cuts[-1]}", f"{key} IS NULL"]

    def raw(self, name: str) -> DataFrame:
        if self.even:
            return expected(self.spark.read.jdbc(**self.options(name)), COLUMNS[name])
        table = f"{self.schema}.{TABLES[name][0]}"
        return expected(self.spark.read.jdbc(self.url, table, predicates=self.ranges(name), properties=self.properties), COLUMNS[name])

    def read(self, name: str) -> DataFrame:
        if name == "concept_small":
            synonyms = clean.english(self.raw("synonym")).transform(clean.clean_synonyms)
            return vocab.names(self.read("concept"), synonyms.select("concept_id", "concept_synonym_name"), "inner")
        return self.raw(name).transform(CLEANERS[name])

    def count(self, name: str) -> int:
        """Rows in the database; of concept_small those of the concepts and of the English synonyms, also such as no concept has."""
        if name == "concept_small":
            return self._count("concept") + self._count("synonym", f" WHERE {self._quoted('language_concept_id')} = {clean.ENGLISH}")
        return self._count(name)
