"""Stored digest trees: a change costs a path, and comparisons go down differing paths only."""

import pytest
from pyspark.sql import functions as F

from tesserae.operators import set_tree as S
from tesserae.operators.centers import region_binding_digest
from tesserae.scale import settle

IDS = [("a", i) for i in (1, 2, 65_535, 65_536, 1 << 20, 1 << 33, 1 << 50)] + [("b", i) for i in range(1, 300_000, 1_000)] + [("c", 5)]


def table(spark, rows):
    return spark.createDataFrame(rows, "region string, instance_id long").repartition(3)


def nodes(df):
    return {(r.region, r.level, r.b): (r.n, r.d) for r in df.collect()}


def test_digests_are_those_of_the_sets(spark):
    got = {r.region: (r.n_obs, r.digest) for r in S.set_digests(S.set_tree(table(spark, IDS))).collect()}
    want = {r.region: (r.n_obs, r.digest) for r in region_binding_digest(table(spark, IDS)).collect()}
    assert got == want


@pytest.mark.parametrize("gone, come", [([("a", 2)], []), ([], [("b", 7)]), ([("c", 5)], [("d", 1 << 40)]), ([("a", 1 << 33), ("a", 1 << 50)], [("a", (1 << 50) + 1)]), ([], [])])
def test_an_updated_tree_is_that_of_the_new_set(spark, gone, come):
    before = settle(S.set_tree(table(spark, IDS))).df
    rows = [r for r in IDS if r not in gone] + come
    after = S.updated_tree(before, table(spark, gone + come), table(spark, rows))
    assert nodes(after) == nodes(S.set_tree(table(spark, rows)))
    changed = {tuple(r) for r in S.changed_buckets(before, settle(after).df).collect()}
    assert changed == {(g, i >> 16) for g, i in gone + come}


def test_one_change_touches_one_path(spark):
    touched = S.touched_nodes(table(spark, [("a", 1 << 33), ("a", (1 << 33) + 1)])).collect()
    assert sorted((r.level, r.b) for r in touched) == [(k, (1 << 33) >> 16 * (k + 1)) for k in range(4)]
    tree = settle(S.set_tree(table(spark, IDS))).df
    same, other = nodes(tree), nodes(S.updated_tree(tree, table(spark, [("a", 3)]), table(spark, [*IDS, ("a", 3)])))
    assert sum(same[k] != other[k] for k in same) == 4


def test_only_touched_buckets_are_read(spark):
    """Ids in other buckets are not looked at: wrong ones there change nothing."""
    tree = settle(S.set_tree(table(spark, IDS))).df
    wrong = [(g, i + 1 if g == "b" else i) for g, i in IDS] + [("a", 3)]
    found = S.updated_tree(tree, table(spark, [("a", 3)]), table(spark, wrong))
    assert nodes(found) == nodes(S.set_tree(table(spark, [*IDS, ("a", 3)])))
    assert found.where(F.col("region") == "b").count() == tree.where(F.col("region") == "b").count()
