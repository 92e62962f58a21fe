"""The lookup join on both of its paths, and distributed numbering."""

import pytest
from pyspark.sql import functions as F

from tideglass.operators import lookup
from tideglass.operators.lookup import content_bytes, lookup_join
from tideglass.operators.numbering import number_rows
from tideglass.session import materialise


def tables(spark):
    # Key 0 holds a third of the facts, another third has no key.
    key = (
        F.when(F.col("id") % 3 == 0, F.lit(0))
        .when(F.col("id") % 3 == 1, F.lit(None))
        .otherwise(F.col("id") % 50)
    )
    facts = spark.range(3000).select(F.col("id").alias("fact"), key.cast("long").alias("k"))
    facts = facts.withColumn("k2", F.when(F.col("k") % 2 == 0, F.col("k")))
    dim = (
        facts.where("k IS NOT NULL AND k <> 7")
        .groupBy("k", "k2")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("name", F.concat(F.lit("n"), "k"))
    )
    return facts, materialise(dim)


@pytest.mark.parametrize("how", ["left", "inner"])
def test_salted_path_equals_broadcast_path(spark, monkeypatch, how):
    facts, dim = tables(spark)
    join = lambda: lookup_join(
        facts, dim, ["k", "k2"], nullable=["k2"], weight="n", spread="fact", how=how
    )
    monkeypatch.setattr(lookup, "BROADCAST_BYTES", 1 << 30)
    small = join()
    monkeypatch.setattr(lookup, "BROADCAST_BYTES", 0)
    large = join()
    assert sorted(small.columns) == sorted(large.columns) == ["fact", "k", "k2", "name"]
    columns = sorted(small.columns)
    assert sorted(map(repr, small.select(columns).collect())) == sorted(
        map(repr, large.select(columns).collect())
    )
    assert large.count() == (3000 if how == "left" else small.count())


def test_salting_evens_out_a_hot_key(spark, monkeypatch):
    """No partition of the salted join holds a hot key as a whole."""
    monkeypatch.setattr(lookup, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(lookup, "_equal_join", spy := Spy(lookup._equal_join))
    facts, dim = tables(spark)
    lookup_join(facts, dim, ["k", "k2"], nullable=["k2"], weight="n", spread="fact").count()
    salted_facts, salted_dim = spy.calls[-1][:2]
    hot = salted_facts.where("k = 0").groupBy("_salt").count().collect()
    assert len(hot) > 1 and max(r["count"] for r in hot) < 700
    loose = salted_facts.where("k IS NULL").groupBy("_salt").count().collect()
    assert len(loose) > 1
    assert salted_dim.count() <= dim.count() + 2 * 4


class Spy:
    def __init__(self, call):
        self.call, self.calls = call, []

    def __call__(self, *args):
        self.calls.append(args)
        return self.call(*args)


def test_content_bytes(spark):
    df = spark.createDataFrame([("ab", 1), (None, 2)], "s string, n long")
    assert content_bytes(df) == (16 + 24 + 2) + (16 + 24)
    assert content_bytes(df.limit(0)) == 0


def test_number_rows(spark):
    df = spark.range(5000).select(F.xxhash64("id").alias("v"), (F.col("id") % 3).alias("g"))
    order = [F.col("g").desc(), F.col("v").asc()]
    rows = number_rows(df.repartition(7), order, "place", start=10).collect()
    wanted = sorted(rows, key=lambda r: (-r["g"], r["v"]))
    assert [r["place"] for r in wanted] == list(range(10, 5010))
    assert number_rows(df.limit(0), order, "place").isEmpty()
