"""Queries on categories, codes and palettes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserae.bindings.registry import query, table
from tesserae.functions.palette import DISTINCT_COLORS, NEUTRAL_COLOR, color_value
from tesserae.operators import encode as E

COLORS_SQL = "[" + ", ".join(f"'{c}'" for c in DISTINCT_COLORS) + "]"


def color_sql(position: str) -> str:
    """Default color of a zero-based position."""
    return f"({COLORS_SQL})[1 + ({position}) % {len(DISTINCT_COLORS)}]"


def priorities(spark, folder):
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("row_pos"), F.col("o_orderpriority").alias("value"), F.col("o_custkey").alias("instance_id"),
        F.col("o_totalprice").alias("price"),
    )


SEEN_SQL = """
seen AS (SELECT value, row_number() OVER (ORDER BY first_pos) - 1 AS pos FROM
         (SELECT o_orderpriority AS value, min(o_orderkey) AS first_pos FROM orders GROUP BY 1))"""

# Four colors over five categories: two categories share one under two spellings, one is the neutral color, one transparent.
PICKED = ("Red", "#ff0000ff", NEUTRAL_COLOR, "none", "#0F0")

# Spellings that are one color each, and the color.
SPELLINGS = (
    ("red", "#FF0000", "#f00", "R", "ff0000ff"), ("tab:blue", "C0", "#1F77B4", "C10", "1f77b4ff"), ("0.5", "#808080", "Gray", "G", "808080ff"),
    ("k", "Black", "0", "#000000FF", "000000ff"), ("#1234", "#11223344", "#11223344", "1.5", "11223344"),
)


def picked_palette(spark, folder):
    seen = E.first_seen_categories(priorities(spark, folder), "value")
    return seen.withColumn("color", F.element_at(F.lit(list(PICKED)), F.col("pos").cast("int") + 1))


@query("first_seen_categories", f"WITH {SEEN_SQL} SELECT pos, value AS category FROM seen")
def first_seen_categories(spark, folder):
    return E.first_seen_categories(priorities(spark, folder), "value")


@query("first_seen_documents", """
SELECT row_number() OVER (ORDER BY p) - 1 AS pos, source AS category FROM (SELECT source, min(doc_id) AS p FROM documents GROUP BY source)""")
def first_seen_documents(spark, folder):
    return E.first_seen_categories(table(spark, folder, "documents").select(F.col("doc_id").alias("row_pos"), "source"), "source")


@query("high_cardinality", """
SELECT count(DISTINCT url) AS n_values, greatest(20, count(*) // 100) AS threshold,
       count(DISTINCT url) > greatest(20, count(*) // 100) AS is_high FROM pages""")
def high_cardinality(spark, folder):
    return E.high_cardinality(table(spark, folder, "pages"), "url")


def kind_sql(column: str) -> str:
    """The kind of a column of `d` from its type and its values."""
    binary = f"min({column}::VARCHAR) = '0' AND max({column}::VARCHAR) = '1' AND count_if({column}::VARCHAR NOT IN ('0', '1')) = 0"
    return f"""SELECT '{column}' AS "column", CASE WHEN count({column}) = 0 THEN 'none' WHEN typeof(any_value({column})) IN ('VARCHAR', 'BOOLEAN') THEN 'categorical'
  WHEN typeof(any_value({column})) LIKE '%INT%' AND {binary} THEN 'categorical' ELSE 'continuous' END AS kind FROM d"""


@query("classify_column_kind", f"""
WITH d AS (
  SELECT doc_id, quality, toxic, n_chars, lang, n_chars / 1000 AS share, n_chars > 500 AS long, CASE WHEN n_chars < 0 THEN 'x' END AS nothing
  FROM documents LEFT JOIN labels USING (doc_id))
{" UNION ALL ".join(kind_sql(c) for c in ("quality", "toxic", "n_chars", "lang", "share", "long", "nothing"))}
UNION ALL SELECT 'doc_id', 'instance'""")
def classify_column_kind(spark, folder):
    docs = table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id", "left").select(
        "doc_id", "quality", "toxic", "n_chars", "lang", (F.col("n_chars") / 1000).alias("share"),
        (F.col("n_chars") > 500).alias("long"), F.when(F.col("n_chars") < 0, "x").alias("nothing"),
        F.lit("#fff").alias("lang_color"),
    )
    return E.classify_column_kind(docs, instance_key="doc_id", shape_columns=True)


@query("typed_category_values", """
SELECT DISTINCT 'quality' AS name, CAST(quality AS BIGINT) AS pos, CAST(quality AS VARCHAR) AS category FROM labels
UNION ALL SELECT DISTINCT 'good', CAST(quality = 1 AS BIGINT), CASE WHEN quality = 1 THEN 'true' ELSE 'false' END FROM labels""")
def typed_category_values(spark, folder):
    labels = table(spark, folder, "labels").withColumn("good", F.col("quality") == 1)
    found = [E.typed_category_values(labels, c).select(F.lit(c).alias("name"), "pos", "category") for c in ("quality", "good")]
    return found[0].unionByName(found[1])


@query("companion_palette", f"""
WITH seen AS (SELECT p_type AS category, row_number() OVER (ORDER BY min(p_partkey)) - 1 AS pos FROM part GROUP BY p_type),
colored AS (SELECT p_type, CASE WHEN bool_or(p_size % 2 = 0) AND NOT bool_or(p_size % 2 = 1) THEN upper(any_value(c)) WHEN bool_or(p_size % 2 = 0)
  THEN least(upper(any_value(c)), any_value(c) || 'ff') ELSE any_value(c) || 'ff' END AS c FROM (SELECT *, substr(md5(p_type), 1, 6) AS c FROM part) GROUP BY p_type)
SELECT pos, category, '#' || c AS color, 'stored' AS source FROM seen JOIN colored ON p_type = category
UNION ALL SELECT pos + 100, category, {color_sql('pos')}, 'default_invalid' FROM seen""")
def companion_palette(spark, folder):
    own = F.substring(F.md5("p_type"), 1, 6)
    parts = table(spark, folder, "part").withColumns(
        {
            "own": F.concat(F.lit("#"), F.when(F.col("p_size") % 2 == 0, F.upper(own)).otherwise(F.concat(own, F.lit("ff")))),
            "mixed": F.concat(F.lit("#"), F.substring(F.md5("p_brand"), 1, 6)),
        }
    )
    seen = E.first_seen_categories(parts, "p_type", "p_partkey")
    good = E.companion_palette(parts, seen, "p_type", "own")
    bad = E.companion_palette(parts, seen, "p_type", "mixed").withColumn("pos", F.col("pos") + 100)
    return good.unionByName(bad)


@query("color_values", f"""
WITH spelled AS (SELECT o_orderkey, o_orderkey % 5 AS k, o_custkey % 4 AS j, {[list(row) for row in SPELLINGS]!r} AS t FROM orders)
SELECT o_orderkey, t[k + 1][j + 1] AS spelling, CASE WHEN t[k + 1][j + 1] NOT IN ('R', 'G', '1.5') THEN '#' || t[k + 1][5] END AS color FROM spelled""")
def color_values(spark, folder):
    listed = F.lit([list(row) for row in SPELLINGS])
    spelling = F.get(F.get(listed, F.pmod("o_orderkey", F.lit(5)).cast("int")), F.pmod("o_custkey", F.lit(4)).cast("int"))
    return table(spark, folder, "orders").select("o_orderkey", spelling.alias("spelling"), color_value(spelling).alias("color"))


@query("value_range", "SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer")
def value_range(spark, folder):
    return E.value_range(table(spark, folder, "customer"), "c_acctbal")


@query("normalized_values", """
SELECT c_custkey, round((c_acctbal - lo) / (hi - lo), 9) AS normalized FROM customer, (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer)""")
def normalized_values(spark, folder):
    scaled = E.normalized_values(table(spark, folder, "customer"), "c_acctbal")
    return scaled.select("c_custkey", F.round("normalized", 9).alias("normalized"))


@query("continuous_codes", """
WITH vals AS (SELECT c_custkey, CASE WHEN c_nationkey <> 7 THEN c_acctbal END AS v FROM customer),
ends AS (SELECT min(v) AS lo, max(v) AS hi FROM vals)
SELECT c_custkey, CASE WHEN v IS NULL THEN 258 ELSE least(CAST(floor((v - lo) / (hi - lo) * 256) AS BIGINT), 255) + 2 END AS code,
       CASE WHEN v IS NULL THEN 18 ELSE greatest(least(CAST(floor((v - 0) / 5000.0::DOUBLE * 16) AS BIGINT), 15), 0) + 2 END AS fixed
FROM vals, ends""")
def continuous_codes(spark, folder):
    values = table(spark, folder, "customer").select(
        "c_custkey", F.when(F.col("c_nationkey") == 7, F.lit(float("nan"))).otherwise(F.col("c_acctbal")).alias("v")
    )
    coded = E.continuous_codes(values, "v")
    return E.continuous_codes(coded, "v", bins=16, fixed_range=(0.0, 5000.0), out="fixed").drop("v")


@query("categorical_codes", f"""
WITH {SEEN_SQL}, codes AS (SELECT value, CASE pos WHEN 0 THEN 2 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 1 ELSE 4 END AS code FROM seen)
SELECT o_orderkey AS row_pos, CASE WHEN o_orderstatus = 'P' THEN 3 ELSE code END AS code FROM orders JOIN codes ON value = o_orderpriority""")
def categorical_codes(spark, folder):
    values = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("row_pos"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")).alias("value")
    )
    return E.categorical_codes(values, "value", picked_palette(spark, folder)).select("row_pos", "code")


@query("categorical_codes_unknown", f"""
WITH {SEEN_SQL} SELECT o_orderkey AS row_pos, CASE WHEN o_orderstatus = 'P' THEN 7 ELSE pos + 2 END AS code FROM orders JOIN seen ON value = o_orderpriority""")
def categorical_codes_unknown(spark, folder):
    seen = E.first_seen_categories(priorities(spark, folder), "value")
    palette = seen.withColumn("color", E.default_color(F.col("pos") + 1))
    values = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("row_pos"),
        F.when(F.col("o_orderstatus") == "P", F.lit("other")).otherwise(F.col("o_orderpriority")).alias("value"),
    )
    return E.categorical_codes(values, "value", palette).select("row_pos", "code")


@query("categorical_colors", f"""
WITH {SEEN_SQL} SELECT o_orderkey AS row_pos, {color_sql('pos')} AS color FROM orders JOIN seen ON value = o_orderpriority""")
def categorical_colors(spark, folder):
    rows = priorities(spark, folder)
    return E.categorical_colors(rows, "value", E.first_seen_categories(rows, "value")).select("row_pos", "color")


@query("palette_join", f"""
SELECT event_id, CASE WHEN event_type IN ('click', 'error') THEN '#' || substr(md5(event_type), 1, 6) ELSE '{NEUTRAL_COLOR}' END AS color FROM events""")
def palette_join(spark, folder):
    events = table(spark, folder, "events").select("event_id", "event_type")
    palette = events.where(F.col("event_type").isin("click", "error")).select(
        F.col("event_type").alias("category"), F.concat(F.lit("#"), F.substring(F.md5("event_type"), 1, 6)).alias("color")
    ).distinct()
    return E.palette_join(events, "event_type", palette).select("event_id", "color")


def vocabularies(spark, folder):
    """One categorical column per brand, its categories the part names in it."""
    names = table(spark, folder, "part").groupBy(F.col("p_brand").alias("column"), F.col("p_name").alias("category")).agg(
        F.min("p_partkey").alias("first"), F.min("p_size").alias("size")
    )
    from pyspark.sql import Window

    return names.withColumn("pos", F.row_number().over(Window.partitionBy("column").orderBy("first")).cast("long") - 1)


VOCABULARY_SQL = """
vocabulary AS (SELECT p_brand AS "column", p_name AS category, min(p_size) AS size,
               row_number() OVER (PARTITION BY p_brand ORDER BY min(p_partkey)) - 1 AS pos FROM part GROUP BY p_brand, p_name),
stored AS (SELECT "column", pos, CASE WHEN "column" LIKE '%3' AND size = 1 THEN 'nocolor' ELSE '#' || substr(md5(category), 1, 6) END AS color
           FROM vocabulary WHERE "column" NOT LIKE '%1' AND ("column" NOT LIKE '%2' OR size > 1))"""


@query("resolve_palette", f"""
WITH {VOCABULARY_SQL},
judged AS (SELECT v."column", CASE WHEN count(s.pos) = 0 THEN 'default_missing'
           WHEN count(s.pos) <> count(*) OR bool_or(s.color = 'nocolor') THEN 'default_invalid' ELSE 'stored' END AS source
           FROM vocabulary v LEFT JOIN stored s ON s."column" = v."column" AND s.pos = v.pos GROUP BY 1)
SELECT v."column", v.pos, v.category, CASE source WHEN 'stored' THEN s.color ELSE {color_sql('v.pos')} END AS color, source
FROM vocabulary v JOIN judged USING ("column") LEFT JOIN stored s ON s."column" = v."column" AND s.pos = v.pos""")
def resolve_palette(spark, folder):
    vocabulary = vocabularies(spark, folder)
    stored = vocabulary.where("not column like '%1' and (not column like '%2' or size > 1)").select(
        "column", "pos",
        F.when(F.col("column").like("%3") & (F.col("size") == 1), "nocolor")
        .otherwise(F.concat(F.lit("#"), F.substring(F.md5("category"), 1, 6))).alias("color"),
    )
    return E.resolve_palette(vocabulary.drop("first", "size"), stored)


CLASS_SQL = """
current AS (SELECT category, row_number() OVER (ORDER BY first) - 1 AS pos FROM
            (SELECT CAST(p_size AS BIGINT) AS category, min(p_partkey) AS first FROM part WHERE p_type = 'ECONOMY' GROUP BY 1)),
fresh AS (SELECT category, row_number() OVER (ORDER BY category) - 1 + (SELECT count(*) FROM current) AS pos FROM
          (SELECT DISTINCT CAST(l_quantity AS BIGINT) + 20 AS category FROM lineitem) WHERE category NOT IN (SELECT category FROM current))"""


def class_vocabulary(spark, folder):
    sizes = table(spark, folder, "part").where("p_type = 'ECONOMY'").select(
        F.col("p_size").cast("long").alias("size"), F.col("p_partkey").alias("row_pos")
    )
    return E.first_seen_categories(sizes, "size")


def observed_classes(spark, folder):
    return table(spark, folder, "lineitem").select((F.col("l_quantity").cast("long") + 20).alias("category"))


@query("append_vocabulary", f"WITH {CLASS_SQL} SELECT pos, category FROM current UNION ALL SELECT pos, category FROM fresh")
def append_vocabulary(spark, folder):
    return E.append_vocabulary(class_vocabulary(spark, folder), observed_classes(spark, folder))


@query("extend_palette", f"""
WITH {CLASS_SQL} SELECT pos, category, '#00FF00' AS color FROM current UNION ALL SELECT pos, category, {color_sql('pos')} FROM fresh""")
def extend_palette(spark, folder):
    current = class_vocabulary(spark, folder)
    grown = E.append_vocabulary(current, observed_classes(spark, folder))
    return E.extend_palette(grown, current.select("pos", F.lit("#00FF00").alias("color")))


@query("class_difference", f"WITH {CLASS_SQL} SELECT category FROM fresh")
def class_difference(spark, folder):
    return E.class_difference(observed_classes(spark, folder), class_vocabulary(spark, folder))


@query("prediction_palette", f"""
WITH {CLASS_SQL} SELECT category, CASE WHEN category IN (SELECT category FROM current) THEN '#00FF00' ELSE {color_sql('category - 1')} END AS color
FROM (SELECT DISTINCT CAST(l_quantity AS BIGINT) + 20 AS category FROM lineitem)""")
def prediction_palette(spark, folder):
    user = class_vocabulary(spark, folder).withColumn("color", F.lit("#00FF00"))
    return E.prediction_palette(observed_classes(spark, folder).distinct(), user)


@query("instance_identity_codes", """
SELECT o_orderkey AS row_pos, dense_rank() OVER (ORDER BY first_pos) AS code, o_custkey + 1 AS own FROM
  (SELECT o_orderkey, o_custkey, min(o_orderkey) OVER (PARTITION BY o_orderpriority) AS first_pos FROM orders)""")
def instance_identity_codes(spark, folder):
    rows = priorities(spark, folder).withColumn("instance_id", F.col("instance_id") + 1)
    coded = E.instance_identity_codes(rows, "value")
    return E.instance_identity_codes(coded, "instance_id", out="own").select("row_pos", "code", "own")


@query("points_color_plan", f"""
SELECT value, {color_sql('pos')} AS color, 'categorical' AS mode FROM
  (SELECT p_name AS value, row_number() OVER (ORDER BY min(p_partkey)) - 1 AS pos FROM part GROUP BY p_name)""")
def points_color_plan(spark, folder):
    return E.points_color_plan(table(spark, folder, "part").select(F.col("p_name").alias("value"), F.col("p_partkey").alias("use_pos")))


@query("points_color_plan_solid", "SELECT DISTINCT c_name AS value, '#00FFFF' AS color, 'solid' AS mode FROM customer")
def points_color_plan_solid(spark, folder):
    return E.points_color_plan(table(spark, folder, "customer").select(F.col("c_name").alias("value"), F.col("c_custkey").alias("use_pos")))


@query("compatible_annotation_columns", """
WITH vocabulary AS (SELECT p_brand AS "column", min(p_size) AS lo FROM part GROUP BY 1)
SELECT "column", CASE WHEN "column" LIKE '%2' THEN 'string' ELSE 'positive_integer' END AS value_kind FROM vocabulary
WHERE "column" <> 'Brand#1' AND ("column" LIKE '%2' OR lo > 1)""")
def compatible_annotation_columns(spark, folder):
    vocabulary = table(spark, folder, "part").select(
        F.col("p_brand").alias("column"),
        F.when(F.col("p_brand").like("%2"), F.col("p_name")).otherwise((F.col("p_size") - 1).cast("string")).alias("category"),
        F.when(F.col("p_brand").like("%2"), "string").otherwise("integer").alias("kind"),
    )
    return E.compatible_annotation_columns(vocabulary, ["Brand#1"])
