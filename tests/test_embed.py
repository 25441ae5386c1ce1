import hashlib
import os

import pytest

from termweave.operators import embed
from termweave.sources import sinks


def model_of(log):
    """A model that notes every text it is given."""

    def run(texts):
        with open(os.path.join(log, hashlib.md5("".join(texts).encode()).hexdigest()), "a") as f:
            f.write("".join(t + "\n" for t in texts))
        return [[float(len(t)), 1.0] for t in texts]

    return run


def asked_of(log):
    return sorted(line for f in log.iterdir() for line in f.read_text().splitlines())


def test_the_model_sees_each_text_once(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    held = sinks.KeyedTable(spark, f"file://{tmp_path}/vectors", "name", "seq")
    rows = spark.createDataFrame([(1, "bb"), (2, "a"), (3, "bb"), (4, None), (5, "ccc")], "id long, text string")
    run = lambda df, name="m": {r.id: r.vector for r in embed.embed(df, "text", model_of(str(log)), held, name, batch=2).collect()}
    want = {1: [2.0, 1.0], 2: [1.0, 1.0], 3: [2.0, 1.0], 4: None, 5: [3.0, 1.0]}
    assert run(rows) == want and asked_of(log) == ["a", "bb", "ccc"]
    assert run(rows) == want and asked_of(log) == ["a", "bb", "ccc"]
    more = rows.union(spark.createDataFrame([(6, "dddd")], rows.schema))
    assert run(more) == want | {6: [4.0, 1.0]} and asked_of(log) == ["a", "bb", "ccc", "dddd"]
    assert run(rows.where("id = 2"), "other") == {2: [1.0, 1.0]} and asked_of(log).count("a") == 2  # another model's vectors are others
    assert run(rows.where("false")) == {}


def test_normalised_texts_meet(spark, tmp_path):
    held = sinks.KeyedTable(spark, f"file://{tmp_path}/vectors", "name", "seq")
    rows = spark.createDataFrame([(1, " Ab"), (2, "aB\t")], "id long, text string")
    got = embed.embed(rows, "text", lambda ts: [[float(len(t))] for t in ts], held, "m", normalize=True)
    assert {r.id: r.vector for r in got.collect()} == {1: [2.0], 2: [2.0]} and held.stats()["rows"] == 1


def test_a_model_that_loses_texts_raises_and_leaves_no_vectors(spark, tmp_path):
    held = sinks.KeyedTable(spark, f"file://{tmp_path}/vectors", "name", "seq")
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id long, text string").coalesce(1)
    with pytest.raises(Exception, match="the model gave"):
        embed.embed(rows, "text", lambda ts: [[1.0]], held, "m")
    assert held.read() is None
