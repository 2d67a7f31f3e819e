import pytest
from pyspark.sql import functions as F

from tesserae import scale
from tesserae.functions.text import normalize_label
from tesserae.operators import points as P
from tesserae.sources.points import PointColumns, scan_points

PLAIN = PointColumns()
NAMED = PointColumns(points_id="points_id")
LABELS = [" AAMP ", "AXL", "AAMP", "actb", "ACTB", "AXL "]


def points(spark, labels, ids=None, x=None):
    rows = [
        (float(i) if x is None else x[i], 10.0 + i, label, f"pt{i}" if ids is None else ids[i]) for i, label in enumerate(labels)
    ]
    return spark.createDataFrame(rows, "x double, y double, gene string, points_id string")


@pytest.mark.parametrize("partitions", [1, 3, 7])
def test_dictionary_is_sorted_dense_and_partition_invariant(spark, partitions):
    df = points(spark, LABELS).repartition(partitions)
    rows = P.value_dictionary(df, "gene").values.orderBy("value_id").collect()
    assert [tuple(r) for r in rows] == [(0, "AAMP", 2), (1, "ACTB", 1), (2, "AXL", 2), (3, "actb", 1)]


def test_dictionary_accounts_for_every_point(spark):
    values = P.value_dictionary(points(spark, LABELS), "gene").values
    assert tuple(P.dictionary_total_matches(values, 6).first()) == (6, True)
    assert not P.dictionary_total_matches(values, 7).first()["matches"]


def test_nearly_full_budget(spark):
    df = points(spark, ["a"] * 50)
    chosen = P.select_within_budget(df, NAMED, P.value_dictionary(df, "gene"), budget=49)
    assert 40 <= chosen.points.count() <= 49


def test_dictionary_through_many_ranges(spark, monkeypatch):
    labels = [f"g{i % 97:03d}" for i in range(400)]
    df = points(spark, labels)
    plain = [tuple(r) for r in P.value_dictionary(df, "gene").values.orderBy("value_id").collect()]
    monkeypatch.setattr(scale, "ROWS_PER_RANGE", 10)
    monkeypatch.setattr(P, "ROWS_PER_RANGE", 10)
    assert [tuple(r) for r in P.value_dictionary(df, "gene").values.orderBy("value_id").collect()] == plain


@pytest.mark.parametrize("blank", [" ", "\t", "\n", " ", " ", "\x1c", "\x1f", "\r", "\x0b"])
def test_trim_matches_python(spark, blank):
    text = f"{blank}a {blank}b{blank}"
    row = spark.createDataFrame([(text,)], "v string").select(normalize_label(F.col("v"))).first()
    assert row[0] == text.strip()


@pytest.mark.parametrize(
    "labels, x, ids, problem",
    [
        ([], None, None, "empty"),
        (["a", "b"], [float("nan"), 1.0], None, "bad_x"),
        (["a", "b"], [float("inf"), 1.0], None, "bad_x"),
        (["a", "b"], [None, 1.0], None, "bad_x"),
        (["a", None], None, None, "missing_label"),
        (["a", " \t "], None, None, "empty_label"),
        (["a", ""], None, None, "empty_label"),
        (["a", "b"], None, ["p", None], "missing_id"),
        (["a", "b"], None, ["p", "p"], "duplicate_id"),
        (["a", "b"], None, None, None),
    ],
)
def test_validation(spark, labels, x, ids, problem):
    df = points(spark, labels, ids, x)
    assert P.validate_points(df, NAMED).first()["problem"] == problem
    if problem:
        with pytest.raises(ValueError, match=problem):
            P.require_valid_points(df, NAMED)


def test_profile_agrees_with_separate_scans(spark):
    df = points(spark, LABELS)
    profile = P.profile_points(df, PLAIN)
    fused = P.validation_of_profile(profile.df, PLAIN).first().asDict()
    alone = P.validate_points(df, PLAIN).first().asDict()
    assert {k: fused[k] for k in alone} == alone
    assert P.dictionary_of_profile(profile).values.orderBy("value_id").collect() == P.value_dictionary(df, "gene").values.orderBy("value_id").collect()


@pytest.mark.parametrize(
    "schema, columns",
    [
        ("x double, y double", PLAIN),
        ("x string, y double, gene string", PLAIN),
        ("x double, y double, gene int", PLAIN),
        ("x double, y double, gene string", PointColumns(label="x")),
        ("x double, y double, gene string", NAMED),
    ],
)
def test_schema_rules(spark, schema, columns):
    with pytest.raises(ValueError):
        scan_points(spark.createDataFrame([], schema), columns)


def test_exact_selection(spark):
    df = points(spark, ["AAMP", "AXL", " AAMP", "ACTB"])
    dictionary = P.value_dictionary(df, "gene")
    chosen = P.select_within_budget(df, PLAIN, dictionary, ["AAMP ", "AAMP"])
    assert not chosen.is_sampled and chosen.total_count == 2
    assert sorted((r.y, r.x, r.gene, r.value_id) for r in chosen.points.collect()) == [(10.0, 0.0, "AAMP", 0), (12.0, 2.0, "AAMP", 0)]
    summary = chosen.summary().first()
    assert summary["warning"] is None and summary["loaded_count"] == 2


def test_empty_and_unknown_requests(spark):
    df = points(spark, ["a", "b"])
    dictionary = P.value_dictionary(df, "gene")
    assert P.select_within_budget(df, PLAIN, dictionary, []).points.count() == 0
    with pytest.raises(ValueError, match="zzz"):
        P.select_within_budget(df, PLAIN, dictionary, ["a", "zzz"])
    with pytest.raises(ValueError):
        P.select_within_budget(df, PLAIN, dictionary, "a")


@pytest.mark.parametrize("budget", [0, -1, True, 1.5])
def test_budget_must_be_positive(spark, budget):
    df = points(spark, ["a"])
    with pytest.raises(ValueError):
        P.select_within_budget(df, PLAIN, P.value_dictionary(df, "gene"), budget=budget)


def test_sample_is_bounded_repeatable_and_a_subset(spark):
    df = points(spark, ["a"] * 1000)
    dictionary = P.value_dictionary(df, "gene")

    def draw(frame, seed=42):
        chosen = P.select_within_budget(frame, NAMED, dictionary, budget=100, seed=seed)
        return chosen, {r.points_id for r in chosen.points.collect()}

    chosen, first = draw(df)
    assert chosen.is_sampled and 60 <= len(first) <= 100
    assert first <= {f"pt{i}" for i in range(1000)}
    assert draw(df.repartition(7))[1] == first
    assert draw(df, seed=1)[1] != first
    assert "of 1,000 selected points because the render point budget is 100." in chosen.summary().first()["warning"]


def test_sample_without_identity_is_bounded(spark):
    df = points(spark, ["a"] * 1000).drop("points_id")
    chosen = P.select_within_budget(df, PLAIN, P.value_dictionary(df, "gene"), budget=50)
    assert 0 < chosen.points.count() <= 50


def test_encoding_rejects_unmapped_and_reserved(spark):
    df = points(spark, ["a", "b"])
    dictionary = P.value_dictionary(df, "gene")
    assert sorted(r.gene_id for r in P.encode_labels(df, NAMED, dictionary).collect()) == [0, 1]
    with pytest.raises(Exception, match="missing from the dictionary"):
        P.encode_labels(points(spark, ["a", "c"]), NAMED, dictionary).collect()
    with pytest.raises(ValueError, match="reserved"):
        P.encode_labels(df.withColumn("gene_id", F.lit(1)), NAMED, dictionary)


def test_unbroadcastable_dictionary_gives_the_same_rows(spark, monkeypatch):
    df = points(spark, LABELS * 5)
    dictionary = P.value_dictionary(df, "gene")
    small = sorted(map(tuple, P.encode_labels(df, PLAIN, dictionary).collect()))
    monkeypatch.setattr(scale, "BROADCAST_ROWS", 0)
    assert sorted(map(tuple, P.encode_labels(df, PLAIN, dictionary).collect())) == small
