"""Cached object centers: what a cache claims, whether it still holds, and how it is updated.

A cache has a matrix `(region, instance_id, cz, cy, cx)` and a registry kept as one JSON text, which says for each
region from which raster and which set of objects its centers were computed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.functions.digest import DOMAIN, set_header_hex, sha256_of_hex, u64_hex
from tesserae.functions.numeric import is_finite
from tesserae.scale import Sized, join_sized, settle

KEYS = ["region", "instance_id"]

# The registry contract.
SCHEMA_VERSION = 1
ALGORITHM_VERSION = 1
OBSM_KEY = "spatial_canonical"
AXES = '["z","y","x"]'
METHOD = "center_of_mass"
WEIGHTING = "uniform_label_pixels"
PIXEL_CONVENTION = "integer_indices_are_pixel_centers"
IMPLEMENTATION = "tesserae.operators.pixels.centers"
TOP_KEYS = ("axes", "dtype", "instance_key", "obsm_key", "region_key", "regions", "schema_version")
REGION_KEYS = (
    "calculation", "coordinate_frame", "coverage", "source", "source_element", "source_element_type", "source_scale",
)
INTEGER_DTYPES = ("int8", "int16", "int32", "int64", "uint8", "uint16", "uint32", "uint64")

# Mismatch codes. The first group means that no region of the cache can be trusted.
ALL_REGIONS_CODES = (
    "matrix_without_metadata", "metadata_without_matrix", "matrix_invalid", "metadata_invalid", "schema_version_unsupported",
    "top_level_contract_mismatch", "region_metadata_invalid",
)
REGION_CODES = (
    "region_not_registered", "source_signature_mismatch", "table_signature_mismatch", "algorithm_version_mismatch",
    "region_coordinates_invalid",
)

BUCKET_BITS = 16


def region_binding_digest(obs: DataFrame, *, domain: str = DOMAIN) -> DataFrame:
    """Per region `n_obs, digest, problem` of its set of instance ids.

    Ids are gathered in buckets of 65536 consecutive values, as sets, and hashed; buckets are hashed in buckets of buckets up
    to one root, and the root with the header of the set. No buffer grows with the data, and a region has one kind of
    digest whatever its size.
    """
    typed = obs.select("region", F.col("instance_id").cast("long").alias("id"))
    bucket = F.shiftright(F.col("id"), BUCKET_BITS)
    buckets = settle(
        typed.groupBy("region", bucket.alias("b")).agg(
            F.count(F.lit(1)).alias("n"), F.collect_set("id").alias("ids"), F.coalesce(F.min("id"), F.lit(0)).alias("lowest")
        )
    ).df
    totals = buckets.groupBy("region").agg(
        F.sum("n").alias("n_obs"), F.min("lowest").alias("lowest"),
        F.bool_or((F.size("ids") < F.col("n")) & F.col("b").isNotNull()).alias("repeats"), F.bool_or(F.col("b").isNull()).alias("gaps"),
    )
    problem = (
        F.when(F.col("gaps") | (F.col("lowest") <= 0), "not_positive").when(F.col("repeats"), "duplicate")
    )
    judged = settle(totals.select("region", "n_obs", problem.alias("problem")))
    body = F.array_join(F.transform(F.sort_array("ids"), u64_hex), "")
    level = join_sized(buckets, judged, "region").where("problem is null").select(
        "region", "n_obs", "b", body.alias("hex")
    )
    tree = level.select("region", "n_obs", "b", sha256_of_hex(F.col("hex")).alias("d"))
    for _ in range(64 // BUCKET_BITS - 1):
        tree = tree.groupBy("region", "n_obs", F.shiftright("b", BUCKET_BITS).alias("b")).agg(
            sha256_of_hex(
                F.array_join(
                    F.transform(F.sort_array(F.collect_list(F.struct(F.col("b").alias("k"), "d"))), lambda s: F.concat(u64_hex(s["k"]), s["d"])), ""
                )
            ).alias("d")
        )
    tree = tree.select(
        "region", F.concat(F.lit("sha256-tree:"), sha256_of_hex(F.concat(set_header_hex(F.col("region"), F.col("n_obs"), domain), F.col("d")))).alias("digest")
    )
    return judged.df.join(tree, "region", "left").select("region", "n_obs", "digest", "problem")


# Registry ---------------------------------------------------------------------------------------------------------


def region_entry(
    region: Column, height: Column, width: Column, dtype: Column, n_obs: Column, digest: Column, algorithm: Column | None = None
) -> Column:
    """JSON text of one region's entry."""
    axes = F.lit(["z", "y", "x"])
    entry = F.struct(
        region.alias("source_element"), F.lit("labels").alias("source_element_type"), F.lit("scale0").alias("source_scale"),
        F.struct(F.lit("element_intrinsic").alias("type"), region.alias("element"), axes.alias("axes")).alias("coordinate_frame"),
        F.struct(
            F.lit(METHOD).alias("method"), F.lit(WEIGHTING).alias("weighting"), F.lit(0).alias("background_value"),
            F.lit(PIXEL_CONVENTION).alias("pixel_coordinate_convention"), F.lit(IMPLEMENTATION).alias("implementation"),
            (F.lit(ALGORITHM_VERSION) if algorithm is None else algorithm).alias("algorithm_version"),
        ).alias("calculation"),
        F.struct(F.lit("all_rows_for_region").alias("scope"), n_obs.alias("n_obs"), digest.alias("instance_set_digest")).alias("coverage"),
        F.struct(
            F.concat(F.lit("labels/"), region).alias("element_path"), F.lit(["y", "x"]).alias("dims"),
            F.array(height, width).alias("shape"), dtype.alias("dtype"),
        ).alias("source"),
    )
    return F.to_json(entry)


def registry_text(entries: DataFrame, region_key: str, instance_key: str) -> DataFrame:
    """One row `registry`: the JSON text of all `(region, entry)` rows. Metadata: one short entry per region."""
    regions = entries.agg(
        F.array_join(
            F.transform(
                F.sort_array(F.collect_list(F.struct("region", "entry"))),
                lambda s: F.concat(F.regexp_replace(F.to_json(F.array(s["region"])), r"^\[|\]$", ""), F.lit(":"), s["entry"]),
            ), ",",
        ).alias("r")
    )
    quoted = lambda text: F.regexp_replace(F.to_json(F.array(F.lit(text))), r"^\[|\]$", "")
    return regions.select(
        F.concat(
            F.lit(f'{{"schema_version":{SCHEMA_VERSION},"obsm_key":"{OBSM_KEY}","axes":{AXES},"dtype":"float64","region_key":'),
            quoted(region_key), F.lit(',"instance_key":'), quoted(instance_key), F.lit(',"regions":{'), F.col("r"), F.lit("}}"),
        ).alias("registry")
    )


def _keys_are(json: Column, expected: tuple[str, ...], optional: tuple[str, ...] = ()) -> Column:
    keys = F.json_object_keys(json)
    exact = F.sort_array(F.array_except(keys, F.lit(list(optional)) if optional else F.array().cast("array<string>"))) == F.lit(sorted(expected))
    return F.coalesce(exact & (F.size(keys) == F.size(F.array_distinct(keys))), F.lit(False))


def _text(json: Column, path: str) -> Column:
    return F.get_json_object(json, path)


def top_level_code(registry: Column) -> Column:
    """First broken rule of the registry's top level, or null."""
    version = _text(registry, "$.schema_version")
    return (
        F.when(F.json_object_keys(registry).isNull(), "metadata_invalid")
        .when(version.isNull(), "top_level_contract_mismatch")
        .when(version.try_cast("int").isNull(), "metadata_invalid")
        .when(version.try_cast("int") != SCHEMA_VERSION, "schema_version_unsupported")
        .when(~_keys_are(registry, TOP_KEYS), "top_level_contract_mismatch")
        .when(
            ~F.coalesce(
                (_text(registry, "$.obsm_key") == OBSM_KEY) & (_text(registry, "$.axes") == AXES) & (_text(registry, "$.dtype") == "float64"),
                F.lit(False),
            ),
            "top_level_contract_mismatch",
        )
        .when(
            ~F.coalesce((F.length(_text(registry, "$.region_key")) > 0) & (F.length(_text(registry, "$.instance_key")) > 0), F.lit(False)),
            "metadata_invalid",
        )
        .when(F.json_object_keys(_text(registry, "$.regions")).isNull(), "region_metadata_invalid")
    )


def parse_entries(registry: DataFrame) -> DataFrame:
    """Registered regions with their claims and `entry_ok`, from the one-row registry table."""
    regions = registry.select(F.explode(F.from_json(_text(F.col("registry"), "$.regions"), "map<string,string>")).alias("region", "entry"))
    e = F.col("entry")
    shape = F.from_json(_text(e, "$.source.shape"), "array<long>")
    algorithm = _text(e, "$.calculation.algorithm_version").try_cast("long")
    n_obs = _text(e, "$.coverage.n_obs").try_cast("long")
    digest = _text(e, "$.coverage.instance_set_digest")

    def equals(path: str, value: Column | str) -> Column:
        return _text(e, path) == value

    ok = (
        _keys_are(e, REGION_KEYS, ("generated_by",)) & equals("$.source_element", F.col("region")) & equals("$.source_element_type", "labels")
        & equals("$.source_scale", "scale0") & _keys_are(_text(e, "$.coordinate_frame"), ("type", "element", "axes"))
        & equals("$.coordinate_frame.type", "element_intrinsic") & equals("$.coordinate_frame.element", F.col("region"))
        & equals("$.coordinate_frame.axes", AXES)
        & _keys_are(
            _text(e, "$.calculation"),
            ("method", "weighting", "background_value", "pixel_coordinate_convention", "implementation", "algorithm_version"),
        )
        & equals("$.calculation.method", METHOD) & equals("$.calculation.weighting", WEIGHTING) & equals("$.calculation.background_value", "0")
        & equals("$.calculation.pixel_coordinate_convention", PIXEL_CONVENTION) & equals("$.calculation.implementation", IMPLEMENTATION)
        & (algorithm > 0) & _keys_are(_text(e, "$.coverage"), ("scope", "n_obs", "instance_set_digest"))
        & equals("$.coverage.scope", "all_rows_for_region") & (n_obs > 0) & digest.rlike("^sha256-tree:[0-9a-f]{64}$")
        & _keys_are(_text(e, "$.source"), ("element_path", "dims", "shape", "dtype"))
        & equals("$.source.element_path", F.concat(F.lit("labels/"), F.col("region"))) & equals("$.source.dims", '["y","x"]')
        & (F.size(shape) == 2) & F.forall(shape, lambda v: v > 0) & _text(e, "$.source.dtype").isin(*INTEGER_DTYPES)
    )
    return regions.select(
        "region", F.coalesce(ok, F.lit(False)).alias("entry_ok"), F.get(shape, F.lit(0)).alias("r_height"), F.get(shape, F.lit(1)).alias("r_width"),
        _text(e, "$.source.dtype").alias("r_dtype"), n_obs.alias("r_n_obs"), digest.alias("r_digest"), algorithm.alias("r_algorithm"),
    )


def coordinate_problems(matrix: DataFrame) -> DataFrame:
    """Per region, whether any center is not finite or lies off the plane."""
    bad = ~(is_finite(F.col("cz")) & is_finite(F.col("cy")) & is_finite(F.col("cx"))) | (F.col("cz") != 0)
    return matrix.groupBy("region").agg(F.bool_or(bad).alias("bad_coordinates"))


def center_cache_state(
    live: DataFrame, registry: DataFrame | None, matrix: DataFrame | None, *, region_key: str, instance_key: str,
    matrix_problem: str | None = None,
) -> DataFrame:
    """State of the cache for each live region: absent, partial, valid, stale or invalid, with its mismatch codes.

    `live` has `region, height, width, dtype, n_obs, digest`. Codes that concern all regions hide the others.
    """
    if registry is None and matrix is None:
        return live.select("region", F.lit("absent").alias("state"), F.lit("").alias("codes"))
    global_code = None
    if registry is None:
        global_code = "matrix_without_metadata"
    elif matrix is None:
        global_code = "metadata_without_matrix"
    elif matrix_problem:
        global_code = "matrix_invalid"
    if global_code:
        return live.select("region", F.lit("invalid").alias("state"), F.lit(global_code).alias("codes"))
    linked = F.coalesce(
        (_text(F.col("registry"), "$.region_key") == region_key) & (_text(F.col("registry"), "$.instance_key") == instance_key), F.lit(False)
    )
    entries = parse_entries(registry)
    broken_entry = entries.agg(F.coalesce(F.bool_or(~F.col("entry_ok")), F.lit(False))).scalar()
    top = registry.select(
        F.coalesce(
            top_level_code(F.col("registry")), F.when(broken_entry, F.lit("region_metadata_invalid")),
            F.when(~linked, F.lit("top_level_contract_mismatch")),
        )
    ).scalar()
    checked = live.join(entries, "region", "left").join(coordinate_problems(matrix), "region", "left")
    differs = lambda *pairs: ~F.lit(True) if not pairs else F.exists(F.array(*[~F.col(a).eqNullSafe(F.col(b)) for a, b in pairs]), lambda v: v)
    tests = [
        (differs(("height", "r_height"), ("width", "r_width"), ("dtype", "r_dtype")), "source_signature_mismatch"),
        (differs(("n_obs", "r_n_obs"), ("digest", "r_digest")), "table_signature_mismatch"),
        (F.col("r_algorithm") != ALGORITHM_VERSION, "algorithm_version_mismatch"),
        (F.coalesce("bad_coordinates", F.lit(True)), "region_coordinates_invalid"),
    ]
    local = F.concat_ws(",", *[F.when(test, F.lit(code)) for test, code in tests])
    codes = F.when(F.col("entry_ok").isNull(), F.lit("region_not_registered")).otherwise(local)
    return checked.withColumn("__top", top).select(
        "region",
        F.when(F.col("__top").isNotNull(), "invalid").when(F.col("entry_ok").isNull(), "partial")
        .when(codes != "", "stale").otherwise("valid").alias("state"),
        F.coalesce("__top", codes).alias("codes"),
    )


ACTIONS = {"absent": "create", "partial": "extend", "stale": "refresh", "invalid": "rebuild", "valid": "refresh"}


def update_action(states: DataFrame, force: bool = False) -> DataFrame:
    """What an update would do per region; a valid cache is reused unless forced."""
    actions = F.create_map(*[F.lit(v) for kv in ACTIONS.items() for v in kv])
    action = F.element_at(actions, F.col("state"))
    return states.withColumn("action", action if force else F.when(F.col("state") == "valid", "reuse").otherwise(action))


def merge_centers(obs: DataFrame, selected: str, fresh: DataFrame, existing: DataFrame | None, states: DataFrame) -> DataFrame:
    """Centers for the whole table: new ones for the selected region, kept ones for other regions that are still valid
    (none if the selected region's state is invalid), NaN elsewhere."""
    axes = ["cz", "cy", "cx"]
    nan = F.lit(float("nan"))
    joined = obs.select(*KEYS).join(fresh.where(F.col("region") == selected).select(*KEYS, *axes), KEYS, "left")
    if existing is None:
        return joined.select(*KEYS, *[F.coalesce(c, nan).alias(c) for c in axes])
    trusted = states.agg(F.coalesce(F.bool_and(F.col("state") != "invalid"), F.lit(False))).scalar()
    keep = states.where((F.col("state") == "valid") & (F.col("region") != selected)).select("region", F.lit(True).alias("__keep"))
    old = existing.select(*KEYS, *[F.col(c).alias(f"__{c}") for c in axes])
    merged = join_sized(joined.join(old, KEYS, "left"), keep, "region", "left")
    kept = F.coalesce(F.col("__keep"), F.lit(False)) & trusted
    return merged.select(
        *KEYS, *[F.when(F.col("region") == selected, F.col(c)).otherwise(F.when(kept, F.col(f"__{c}")).otherwise(nan)).alias(c) for c in axes]
    )


def merged_registry(selected: str, live: DataFrame, states: DataFrame, region_key: str, instance_key: str) -> DataFrame:
    """Registry text after an update: the selected region and every other region that is still valid."""
    keep = states.where((F.col("state") == "valid") | (F.col("region") == selected)).select("region")
    entries = live.join(keep, "region", "left_semi").select(
        "region", region_entry(F.col("region"), F.col("height"), F.col("width"), F.col("dtype"), F.col("n_obs"), F.col("digest")).alias("entry")
    )
    return registry_text(entries, region_key, instance_key)


def live_regions(obs: DataFrame, signature: DataFrame, **digest_options) -> DataFrame:
    """Current identity of each region: its raster's shape and type, its rows and their digest."""
    return signature.select("region", "height", "width", "dtype").join(
        region_binding_digest(obs, **digest_options).where("problem is null").select("region", "n_obs", "digest"), "region"
    )


def update_centers(
    obs: DataFrame, selected: str, pixels: DataFrame, live: DataFrame, registry: DataFrame | None, existing: DataFrame | None, *,
    region_key: str, instance_key: str, force: bool = False,
) -> tuple[str, DataFrame, DataFrame]:
    """Reuse or update the cache for one region: the action taken, the matrix and the registry afterwards."""
    from tesserae.operators.pixels import canonical_centers

    live = settle(live).df
    states = settle(center_cache_state(live, registry, existing, region_key=region_key, instance_key=instance_key))
    action = update_action(states.df.where(F.col("region") == selected), force).first()
    if action is None:
        raise ValueError(f"Region {selected} has no rows or no raster.")
    if action["action"] == "reuse":
        return "reuse", existing, registry
    wanted = obs.where(F.col("region") == selected)
    fresh = settle(canonical_centers(pixels.where(F.col("region") == selected), wanted)).df
    lost = fresh.where("cy is null").count()
    if lost:
        raise ValueError(f"The raster of {selected} has no center for {lost} requested instance(s).")
    matrix = merge_centers(obs, selected, fresh, existing, states.df)
    return action["action"], matrix, merged_registry(selected, live, states.df, region_key, instance_key)
