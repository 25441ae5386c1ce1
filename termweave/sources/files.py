"""Tables in delimited, JSON and sheet files."""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termweave.functions.text import NULL_TOKENS, parse_concept_id, parse_score
from termweave.operators import clean
from termweave.operators.dedup import first_by

log = logging.getLogger(__name__)

#: Expected columns, all read as strings. Fixed values.
COLUMNS = {
    "concept": ("concept_id", "concept_name", "domain_id", "vocabulary_id", "concept_class_id", "standard_concept", "concept_code", "valid_start_date", "valid_end_date", "invalid_reason"),
    "relationship": ("concept_id_1", "concept_id_2", "relationship_id", "valid_start_date", "valid_end_date", "invalid_reason"),
    "synonym": ("concept_id", "concept_synonym_name", "language_concept_id"),
    "concept_small": ("concept_id", "concept_name", "name_type", "domain_id", "vocabulary_id", "concept_class_id", "standard_concept", "concept_code", "valid_start_date", "valid_end_date", "invalid_reason"),
}
CLEANERS = {"concept": clean.clean_concepts, "relationship": clean.clean_relationships, "synonym": clean.clean_synonyms, "concept_small": clean.clean_concepts}
FILES = {"concept": "CONCEPT.csv", "relationship": "CONCEPT_RELATIONSHIP.csv", "synonym": "CONCEPT_SYNONYM.csv", "concept_small": "CONCEPT_SMALL.csv"}


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def expected(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """The expected columns under normalised headers; missing ones are null, others go."""
    known = {c.strip().lower(): c for c in df.columns}
    if missing := [c for c in columns if c not in known]:
        log.warning("missing columns: %s", ", ".join(missing))
    return df.select(*(F.col(f"`{known[c]}`").cast("string").alias(c) if c in known else F.lit(None).cast("string").alias(c) for c in columns))


def null_tokens(df: DataFrame) -> DataFrame:
    return df.select(*(F.when(~F.col(c).isin(*NULL_TOKENS), F.col(c)).alias(c) for c in df.columns))


def read_delimited(spark: SparkSession, path: str, columns: tuple[str, ...], delimiter: str = "\t") -> DataFrame:
    """All columns as strings; the header is read once for all parts."""
    raw = spark.read.option("sep", delimiter).option("header", True).option("quote", '"').option("escape", '"').option("multiLine", False).csv(path)
    return null_tokens(expected(raw, columns))


class DelimitedSource:
    """A folder of vocabulary files. A missing folder raises, a missing file warns and gives an empty table."""

    def __init__(self, spark: SparkSession, folder: str, delimiter: str = "\t", relationship_delimiter: str = "\t"):
        if not exists(spark, folder):
            raise FileNotFoundError(folder)
        self.spark, self.folder = spark, folder.rstrip("/")
        self.delimiters = {name: relationship_delimiter if name == "relationship" else delimiter for name in COLUMNS}

    def read(self, name: str) -> DataFrame:
        path = f"{self.folder}/{FILES[name]}"
        if not exists(self.spark, path):
            log.warning("missing file: %s", path)
            return self.spark.createDataFrame([], ", ".join(f"{c} string" for c in COLUMNS[name]))
        return read_delimited(self.spark, path, COLUMNS[name], self.delimiters[name]).transform(CLEANERS[name])

    def sizes(self) -> dict[str, int]:
        """Bytes of each file that is there; one that is missing or empty is warned of."""
        found = {}
        for name, file in FILES.items():
            p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{file}")
            fs = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
            if fs.exists(p):
                found[name] = fs.getContentSummary(p).getLength()
            if not found.get(name):
                log.warning("missing or empty file: %s", file)
        return found

    def count(self, name: str) -> int:
        return self.read(name).count()


#: Mapping inputs: the columns of each kind of file, by preference. Fixed values.
INPUTS = {
    "snuh": {"entity_name": ("source_name", "source_value"), "domain_id": ("domain", "domain_id"), "row_id": ("snuh_id", "row_id"), "truth_id": ("omop_concept_id", "concept_id"), "truth_name": ("concept_name",), "vocabulary": ("vocabulary",)},
    "snomed": {"entity_name": ("entity_name",), "domain_id": ("domain_id",), "row_id": ("note_id",), "truth_id": ("concept_id",), "truth_name": ("concept_name",), "vocabulary": ("vocabulary",)},
}


def first_column(df: DataFrame, names: tuple[str, ...]) -> Column:
    """The first non-null of the columns that exist."""
    found = [F.when(~F.col(c).cast("string").isin(*NULL_TOKENS), F.col(c).cast("string")) for c in names if c in df.columns]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def input_rows(df: DataFrame, kind: str, vocabularies: tuple[str, ...] = (), domains: tuple[str, ...] = ()) -> DataFrame:
    """entity_name, domain_id, row_id, truth_id, truth_name of a mapping input; both filters always apply."""
    rows = df.select(*(first_column(df, names).alias(c) for c, names in INPUTS[kind].items()))
    rows = rows.where(F.col("entity_name").isNotNull()).withColumn("truth_id", parse_concept_id(F.col("truth_id")))
    rows = rows.where(F.col("vocabulary").isin(*vocabularies)) if vocabularies else rows
    rows = rows.where(F.col("domain_id").isin(*domains)) if domains else rows
    return rows.drop("vocabulary")


def read_runs(spark: SparkSession, path: str, domain: str | None = None) -> DataFrame:
    """A row for each record of a repeat-run file: run, pos and the record's fields."""
    raw = spark.read.option("multiLine", True).json(path)
    runs = raw.select(F.posexplode("runs").alias("run", "records")).select((F.col("run") + 1).alias("run"), F.posexplode("records").alias("pos", "record"))
    rows = runs.select("run", "pos", "record.*")
    return rows.where(F.col("input_domain") == domain) if domain else rows


def truth_names(df: DataFrame, entity: str, domain: str, name: str, seq: str) -> DataFrame:
    """One name for each entity and domain, the last in the file."""
    return first_by(df.where(F.col(name).isNotNull()), [entity, domain], F.col(seq).desc()).select(entity, domain, name)


def consensus_rows(sheets: list[DataFrame], score: str) -> DataFrame:
    """entity, concept, score of sheets (with entity_name, concept, a score column and seq); later sheets and rows hold."""
    parts = [s.select(F.col("entity_name").alias("entity"), "concept", parse_score(F.col(score)).alias("score"), F.lit(i).alias("sheet"), "seq") for i, s in enumerate(sheets)]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return first_by(rows.dropna(subset=["entity", "concept", "score"]), ["entity", "concept"], F.desc("sheet"), F.desc("seq")).drop("sheet", "seq")


def positional(df: DataFrame, names: list[str], header_rows: int, seq: str) -> DataFrame:
    """Columns by position after ``header_rows`` rows (by ``seq``, from 0); a null first name drops the row."""
    body = df.where(F.col(seq) >= header_rows).drop(seq)
    return body.toDF(*names, *body.columns[len(names) :]).select(*names).dropna(subset=[names[0]])


def label_filter(df: DataFrame, label: str, labels: tuple[int, ...] = (1, 5, 9)) -> DataFrame:
    return df.where(F.col(label).cast("string").try_cast("int").isin(*labels))


def create(kind: str, spark: SparkSession, **options):
    """A vocabulary source by name: ``csv`` or ``postgres``."""
    from termweave.sources.jdbc import JdbcSource

    kinds = {"csv": DelimitedSource, "postgres": JdbcSource}
    if kind not in kinds:
        raise ValueError(f"unknown source {kind!r}; one of {', '.join(kinds)}")
    return kinds[kind](spark, **options)
