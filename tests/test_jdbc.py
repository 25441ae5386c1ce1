import pytest
from pyspark.sql import functions as F

from termweave.sources import files, jdbc

DRIVER = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}


@pytest.fixture(scope="module")
def source(spark):
    """A database in memory, by the driver that comes with Spark: ids in two dense clusters, some null."""
    url = "jdbc:derby:memory:vocabulary;create=true"
    ids = spark.range(4000).select(F.when(F.col("id") % 100 == 7, None).when(F.col("id") < 3000, F.col("id")).otherwise(F.col("id") + 2_000_000_000).alias("concept_id"))
    concept = ids.select("concept_id", F.concat(F.lit("name "), F.coalesce(F.col("concept_id").cast("string"), F.lit("none"))).alias("concept_name"), F.lit("Drug").alias("domain_id"), F.lit("S").alias("standard_concept"))
    synonym = ids.where("concept_id % 3 = 0").select("concept_id", F.concat(F.lit("also "), F.col("concept_id").cast("string")).alias("concept_synonym_name"), F.when(F.col("concept_id") % 2 == 0, 4180186).otherwise(1).alias("language_concept_id"))
    synonym = synonym.union(spark.createDataFrame([(77_777, "of no concept", 4180186)], synonym.schema))
    for name, df in (("concept", concept), ("concept_synonym", synonym)):
        df.coalesce(1).write.jdbc(url, f"APP.{name}", mode="overwrite", properties=DRIVER)
    return files.create("postgres", spark, url=url, schema="APP", parts=8, properties=DRIVER)


def test_ranges_follow_the_ids(spark, source):
    rows = source.raw("concept")
    sizes = [len(p) for p in rows.rdd.glom().collect()]
    assert len(sizes) == 9 and sum(sizes) == 4000 and sizes[-1] == 40  # the last holds the rows without an id
    assert max(sizes[:-1]) <= 2 * 3960 / 8
    even = jdbc.JdbcSource(spark, source.url, "APP", parts=8, properties=DRIVER, even=True)
    dense = [len(p) for p in even.raw("concept").rdd.glom().collect()]
    assert max(dense) > 2900 and sum(dense) == 4000


def test_read_and_count(source):
    assert source.read("concept").count() == 3960 and source.count("concept") == 4000
    small = source.read("concept_small")
    kinds = {r.name_type: r["count"] for r in small.groupBy("name_type").count().collect()}
    english = sum(1 for i in range(4000) if i % 100 != 7 and (i if i < 3000 else i + 2_000_000_000) % 6 == 0)
    assert kinds == {"Original": 3960, "Synonym": english}
    assert source.count("concept_small") == 4000 + english + 1


def test_empty_table(spark, source):
    spark.createDataFrame([], "concept_id_1 long, concept_id_2 long, relationship_id string").write.jdbc(source.url, "APP.concept_relationship", mode="overwrite", properties=DRIVER)
    assert source.read("relationship").collect() == [] and source.count("relationship") == 0
