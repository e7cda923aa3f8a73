"""What the sorts group and shuffle: no row that can not matter, in tasks of bounded size."""

import pytest
from pyspark.sql import functions as F

from offergrid.operators import options as O
from offergrid.plans.bindings import Views
from offergrid.session import small_tasks
from tests.test_removal import SCHEMA, listings_of

SMALL = "/root/testdata/sf0.001"
SIZE, COUNT = "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.shuffle.partitions"
CARRIED = ["subject", "section_number", "schedule_number"]


def test_groups_that_are_no_option_are_not_stored_and_few_columns_are_sorted(spark, monkeypatch):
    seen, plain = [], O.settled

    def note(df):
        seen.append((df, spark.conf.get(COUNT), plain(df)))
        return seen[-1][2]

    monkeypatch.setattr(O, "settled", note)
    lst, before = Views(spark, SMALL).listings(), spark.conf.get(COUNT)
    table = O.stored_options(lst, CARRIED, shown=["option_id", *CARRIED])
    monkeypatch.setattr(O, "settled", plain)
    groups, count, stored = seen[0]
    assert int(count) >= 600 and spark.conf.get(COUNT) == before
    assert stored.filter(~F.startswith("key", F.lit("row|")) & ~F.col("has_primary") & F.col("all_secondary")).count() == 0
    assert "component" not in groups._jdf.queryExecution().optimizedPlan().children().head().output().mkString()
    want = O.group_options(lst).options
    rows = want.join(lst.select(F.col("listing_id").alias("primary_id"), *CARRIED), "primary_id").select("option_id", *CARRIED)
    assert table.columns == rows.columns and sorted(table.collect()) == sorted(rows.collect())


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_uncounted_options_are_the_counted_ones(spark, seed):
    rows = spark.createDataFrame(listings_of(seed, 200, 30), SCHEMA)
    names = ["option_id", "kind", "primary_id", "option_number", *CARRIED]
    plain = O.group_options(rows).options
    assert sorted(map(str, O.stored_options(rows, CARRIED, names).select("option_id", "kind", "primary_id", "option_number").collect())) == sorted(
        map(str, plain.select("option_id", "kind", "primary_id", "option_number").collect()))
    full = O.stored_options(rows, CARRIED)
    assert sorted(map(str, full.select(*plain.columns).collect())) == sorted(map(str, plain.collect()))


def test_small_tasks_puts_the_settings_back(spark):
    before = spark.conf.get(SIZE, None), spark.conf.get(COUNT, None)
    with pytest.raises(ValueError), small_tasks(spark):
        assert int(spark.conf.get(COUNT)) >= 600
        raise ValueError
    assert (spark.conf.get(SIZE, None), spark.conf.get(COUNT, None)) == before
