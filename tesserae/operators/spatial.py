"""Containment of points in polygons, and contacts between polygon edges, as grid-cell equi-joins.

Things are put into cells whose size follows their own extent (a power of two), so that each covers only a few
cells, however mixed the sizes are. Whatever looks for partners visits its cell at every size in use. Candidate
pairs therefore meet through an equality join on cells, never through a cross join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.functions.geometry import (
    bounds, covers, edges_between, edges_in_slab, first, odd_at, odd_in_cell, on_boundary, polygon_area, polygon_edges, ring_edges,
    ring_problem, transform_rings,
)
from tesserae.functions.numeric import Affine
from tesserae.functions.orientation import orientation
from tesserae.operators.sweep import ring_problems
from tesserae.scale import join_sized, settle, ship_package, spread_hot_keys

CELLS_PER_AXIS = 4
SMALLEST_LEVEL = -1000


def polygon_area_bounds(polygons: DataFrame, rings: str = "rings") -> DataFrame:
    """Area (holes taken off) and bounding box per polygon."""
    return polygons.withColumn("area", polygon_area(F.col(rings))).withColumn("__b", bounds(F.col(rings))).select(
        *polygons.columns, "area", "__b.*"
    )


def bbox_prefilter(points: DataFrame, box: Sequence[float], x: str = "x", y: str = "y") -> DataFrame:
    """Points inside a box, edges included; plain comparisons that reach the scan."""
    min_x, min_y, max_x, max_y = box
    return points.where(F.col(x).between(min_x, max_x) & F.col(y).between(min_y, max_y))


def size_level(extent: Column, cells: Column | None = None) -> Column:
    """Power of two of the cell size for something of this extent."""
    cells = F.lit(float(CELLS_PER_AXIS)) if cells is None else cells
    found = F.ceil(F.log2(F.greatest(extent, F.lit(2.0**SMALLEST_LEVEL)) / cells)).cast("int")
    return F.greatest(found, F.lit(SMALLEST_LEVEL))


def cell_size(level: Column) -> Column:
    return F.pow(F.lit(2.0), level)


def _cells(low: Column, high: Column, size: Column) -> Column:
    return F.sequence(F.floor(low / size), F.floor(high / size))


def _reference(cell_x: Column, cell_y: Column, size: Column) -> tuple[Column, Column]:
    """A point in a cell whose coordinates those of polygons hardly ever share."""
    return (cell_x + F.lit(0.6180339887498949)) * size, (cell_y + F.lit(0.41421356237309503)) * size


def polygon_cells(polygons: DataFrame, rings: str = "rings") -> DataFrame:
    """Polygons repeated per cell they reach into: `__level, __cx, __cy`, box, the `edges` that touch the cell, and `base`,
    whether the cell's reference point is inside.

    There are about as many cells as edges, so a point meets few edges however many the polygon has, and none away from
    the boundary. Cells that are wholly outside are left out.
    """
    others = [c for c in polygons.columns if c != rings]
    boxed = polygons.where(F.size(rings) > 0).select(
        *others, bounds(F.col(rings)).alias("__b"), polygon_edges(F.col(rings)).alias("__edges")
    ).select(*others, "__b.*", "__edges")
    extent = F.greatest(F.col("max_x") - F.col("min_x"), F.col("max_y") - F.col("min_y"))
    sized = boxed.withColumn("__level", size_level(extent, F.greatest(F.lit(float(CELLS_PER_AXIS)), F.sqrt(F.size("__edges")))))
    size = cell_size(F.col("__level"))
    by_row = sized.withColumn("__cy", F.explode(_cells(F.col("min_y"), F.col("max_y"), size)))
    slab = edges_in_slab(F.col("__edges"), F.col("__cy") * size, (F.col("__cy") + 1) * size)
    by_row = by_row.withColumn("__slab", slab).drop("__edges")
    by_cell = by_row.withColumn("__cx", F.explode(_cells(F.col("min_x"), F.col("max_x"), size)))
    by_cell = by_cell.withColumns({
        "edges": edges_between(F.col("__slab"), F.col("__cx") * size, (F.col("__cx") + 1) * size),
        "base": odd_at(F.col("__slab"), *_reference(F.col("__cx"), F.col("__cy"), size)),
    })
    return by_cell.drop("__slab").where((F.size("edges") > 0) | F.col("base"))


def _visit(points: DataFrame, levels: Sequence[int], x: str, y: str) -> DataFrame:
    """Points repeated per cell size in use (usually one or two), with their cell."""
    level = F.lit(levels[0]) if len(levels) == 1 else F.explode(F.lit(list(levels)))
    visited = points.withColumn("__level", level)
    size = cell_size(F.col("__level"))
    return visited.withColumns({"__cx": F.floor(F.col(x) / size), "__cy": F.floor(F.col(y) / size)})


def mark_covered(
    points: DataFrame, polygons: DataFrame, flag: str, *, x: str = "x", y: str = "y", rings: str = "rings",
    affine: Affine | None = None, by: Sequence[str] = (), only: bool = False,
) -> DataFrame:
    """Points with `flag`, whether the union of the polygons covers them: boundary in, hole interior out, rim of a hole in.

    `affine` maps polygon coordinates into those of the points. `by` names columns that point and polygon must share. A cell
    size in use costs one existence join, which passes each point once; the cells are broadcast when small. With `only`,
    points outside the box of all polygons are dropped beforehand by plain comparisons.
    """
    shapes = polygons if affine is None else polygons.withColumn(rings, transform_rings(F.col(rings), affine))
    limits = ("min_x", "max_x", "min_y", "max_y", "edges", "base")
    cells = settle(polygon_cells(shapes, rings).select(*by, "__level", "__cx", "__cy", *limits))
    found = cells.df.agg(
        F.sort_array(F.collect_set("__level")).alias("levels"), F.min("min_x"), F.min("min_y"), F.max("max_x"), F.max("max_y")
    ).first()
    if only and found["levels"]:
        points = bbox_prefilter(points, found[1:], x, y)
    px, py = F.col(x).cast("double"), F.col(y).cast("double")
    covered = F.lit(False)
    for level in found["levels"]:
        size = F.lit(2.0**level)
        keys = [*by, "__cx", "__cy"]
        side = cells.df.where(F.col("__level") == level).drop("__level")
        points = points.withColumns({"__cx": F.floor(px / size), "__cy": F.floor(py / size)})
        if not cells.broadcastable:
            points, side = spread_hot_keys(points, side, keys)
            keys = [*keys, "__salt"]
        side = side.select(*[F.col(k).alias(f"{k}_side") for k in keys], *[F.col(c).alias(f"__{c}") for c in limits])
        # names of their own: those that the inner side has, too, would be taken from there
        points = points.withColumns({f"__at{i}": F.col(k) for i, k in enumerate(keys)} | {"__vx": px, "__vy": py})
        condition = F.lit(True)
        for i, k in enumerate(keys):
            condition = condition & (F.col(f"{k}_side") == F.col(f"__at{i}").outer())
        ox, oy = F.col("__vx").outer(), F.col("__vy").outer()
        reference = _reference(F.col("__cx_side"), F.col("__cy_side"), size)
        condition = condition & ox.between(F.col("__min_x"), F.col("__max_x")) & oy.between(F.col("__min_y"), F.col("__max_y"))
        condition = condition & (odd_in_cell(F.col("__edges"), F.col("__base"), ox, oy, *reference) | on_boundary(F.col("__edges"), ox, oy))
        side = F.broadcast(side) if cells.broadcastable else side
        points = points.withColumn("__hit", covered | side.where(condition).exists())
        points = points.drop("__cx", "__cy", "__salt", "__vx", "__vy", *[f"__at{i}" for i in range(len(keys))])
        covered = F.col("__hit")
    return points.withColumn(flag, covered).drop("__hit")


def points_in_polygons(points: DataFrame, polygons: DataFrame, ids: Sequence[str] = (), **options) -> DataFrame:
    """Points that the union of the polygons covers, as `mark_covered` tells. A point comes once, whatever its `ids`."""
    return mark_covered(points, polygons, "__covered", only=True, **options).where("__covered").drop("__covered")


def matched_ids(points: DataFrame, polygons: DataFrame, ids: Sequence[str], **options) -> DataFrame:
    """Unique ids of covered points, ascending."""
    return points_in_polygons(points, polygons, ids, **options).select(*ids).distinct().orderBy(*ids)


def union_membership(points: DataFrame, polygons: DataFrame, ids: Sequence[str] = (), **options) -> DataFrame:
    """Every point with `in_union`, in one pass over the points."""
    return mark_covered(points, polygons, "in_union", **options)


# Contacts between edges -------------------------------------------------------------------------------------------


def edge_table(polygons: DataFrame, keys: Sequence[str], rings: str = "rings") -> DataFrame:
    """One row per edge: the keys, `ring`, `k` (number in the ring), `n` (edges of the ring) and both ends."""
    per_ring = polygons.select(*keys, F.posexplode(rings).alias("ring", "__ring"))
    listed = per_ring.withColumn("__edges", ring_edges(F.col("__ring"))).withColumn("n", F.size("__edges"))
    return listed.select(*keys, "ring", "n", F.posexplode("__edges").alias("k", "s")).select(*keys, "ring", "n", "k", "s.*")


def _with_contact_kind(pairs: DataFrame) -> DataFrame:
    """How edges a and b meet: cross, overlap (along a line), touch (in a point). Pairs that do not meet are dropped.

    The four orientations are columns of their own, so that each is computed once.
    """
    def edge(side: str) -> dict[str, Column]:
        return {c: F.col(f"{side}_{c}") for c in ("x1", "y1", "x2", "y2")}

    a, b = edge("a"), edge("b")
    oriented = pairs.withColumns(
        {
            "d1": orientation(b, a["x1"], a["y1"]), "d2": orientation(b, a["x2"], a["y2"]),
            "d3": orientation(a, b["x1"], b["y1"]), "d4": orientation(a, b["x2"], b["y2"]),
            "sx": F.least("a_hx", "b_hx") - F.greatest("a_lx", "b_lx"), "sy": F.least("a_hy", "b_hy") - F.greatest("a_ly", "b_ly"),
        }
    )
    d1, d2, d3, d4 = (F.col(f"d{i}") for i in range(1, 5))
    apart = (d1 > 0) & (d2 > 0) | (d1 < 0) & (d2 < 0) | (d3 > 0) & (d4 > 0) | (d3 < 0) & (d4 < 0)

    def within(side: str, x: Column, y: Column) -> Column:
        return x.between(F.col(f"{side}_lx"), F.col(f"{side}_hx")) & y.between(F.col(f"{side}_ly"), F.col(f"{side}_hy"))

    touching = (
        (d1 == 0) & within("b", a["x1"], a["y1"]) | (d2 == 0) & within("b", a["x2"], a["y2"])
        | (d3 == 0) & within("a", b["x1"], b["y1"]) | (d4 == 0) & within("a", b["x2"], b["y2"])
    )
    collinear = (d1 == 0) & (d2 == 0) & (d3 == 0) & (d4 == 0)
    kind = (
        F.when((d1 != 0) & (d2 != 0) & (d3 != 0) & (d4 != 0), "cross")
        .when(collinear & ((F.col("sx") > 0) | (F.col("sy") > 0)), "overlap").when(touching, "touch")
    )
    return oriented.where(~apart).withColumn("kind", kind).where("kind is not null")


def edge_contacts(edges: DataFrame, by: Sequence[str], owner: str) -> DataFrame:
    """Pairs of edges of one `by` group that meet: `by, a_owner, a_ring, a_k, a_n, b_..., kind`.

    An edge is stored in the cells of its own size and looks for partners in cells of that size and larger ones. A
    pair is reported only in the cell that holds the lower corner of the two boxes' intersection, hence once. The edges
    are read three times, so their lineage is cut.
    """
    boxed = edges.withColumns(
        {
            "lx": F.least("x1", "x2"), "hx": F.greatest("x1", "x2"), "ly": F.least("y1", "y2"), "hy": F.greatest("y1", "y2"),
        }
    ).withColumn("own", size_level(F.greatest(F.col("hx") - F.col("lx"), F.col("hy") - F.col("ly")) * CELLS_PER_AXIS))
    boxed = settle(boxed).df
    levels = [r[0] for r in boxed.select("own").distinct().orderBy("own").collect()]
    fields = [owner, "ring", "k", "n", "x1", "y1", "x2", "y2", "lx", "hx", "ly", "hy", "own"]

    def placed(level: Column, prefix: str) -> DataFrame:
        at = boxed.withColumn("__level", level)
        size = cell_size(F.col("__level"))
        at = at.withColumn("__cx", F.explode(_cells(F.col("lx"), F.col("hx"), size)))
        at = at.withColumn("__cy", F.explode(_cells(F.col("ly"), F.col("hy"), size)))
        return at.select(*by, "__level", "__cx", "__cy", *[F.col(f).alias(f"{prefix}_{f}") for f in fields])

    seekers = placed(F.explode(F.filter(F.lit(levels), lambda v: v >= F.col("own"))), "a")
    stored = placed(F.col("own"), "b")
    pairs = seekers.join(stored, [*by, "__level", "__cx", "__cy"])
    earlier = F.struct(f"a_{owner}", "a_ring", "a_k") < F.struct(f"b_{owner}", "b_ring", "b_k")
    size = cell_size(F.col("__level"))
    corner_x, corner_y = F.greatest("a_lx", "b_lx"), F.greatest("a_ly", "b_ly")
    kept = pairs.where(
        ((F.col("a_own") < F.col("b_own")) | earlier & (F.col("a_own") == F.col("b_own")))
        & (F.floor(corner_x / size) == F.col("__cx")) & (F.floor(corner_y / size) == F.col("__cy"))
        & (corner_x <= F.least("a_hx", "b_hx")) & (corner_y <= F.least("a_hy", "b_hy"))
    )
    return _with_contact_kind(kept).select(
        *by, *[f"{p}_{f}" for p in "ab" for f in (owner, "ring", "k", "n")], "kind"
    )


def validate_polygons(polygons: DataFrame, id_column: str = "polygon_id", rings: str = "rings") -> DataFrame:
    """`id, problem` per polygon: empty, not_finite, not_closed, too_few_vertices, no_area, self_intersection,
    ring_crossing, hole_outside or nested_holes; null for a valid polygon.

    Neighbouring edges may share their end but not run back along each other; different rings may touch in points. Each polygon
    is judged in its row, without a shuffle.
    """
    ship_package(polygons.sparkSession)
    ring_problems_ = F.filter(F.transform(F.col(rings), ring_problem), lambda p: p.isNotNull())
    local = F.when(F.col(rings).isNull() | (F.size(rings) == 0), F.lit("empty")).otherwise(first(ring_problems_))
    judged = polygons.select(id_column, local.alias("local"), F.when(local.isNull(), F.col(rings)).alias("sound"))
    return judged.select(id_column, F.coalesce("local", ring_problems("sound")).alias("problem"))


def _probes(ring: Column) -> Column:
    """Vertices and edge middles of a ring."""
    return F.concat(ring, F.transform(
        ring_edges(ring), lambda s: F.struct(((s["x1"] + s["x2"]) / 2).alias("x"), ((s["y1"] + s["y2"]) / 2).alias("y"))
    ))


# Holes ------------------------------------------------------------------------------------------------------------


def largest_polygon(polygons: DataFrame, group: str = "group_id", id_column: str = "polygon_id", rings: str = "rings") -> DataFrame:
    """Per group the polygon of largest area, how many polygons there are, and whether the largest is unique."""
    sized = polygons.select(group, id_column, polygon_area(F.col(rings)).alias("area"))
    by_area = sized.groupBy(group, "area").agg(F.count(F.lit(1)).alias("n"), F.min(id_column).alias("id"))
    top = by_area.groupBy(group).agg(
        F.max_by("id", "area").alias("id"), F.max("area").alias("area"), F.sum("n").alias("n_polygons"), F.max_by("n", "area").alias("n")
    )
    return top.select(
        group, F.when(F.col("n") == 1, F.col("id")).alias("shell_id"), "area", "n_polygons", (F.col("n") == 1).alias("is_unique")
    )


def assemble_holes(polygons: DataFrame, group: str = "group_id", id_column: str = "polygon_id", rings: str = "rings") -> DataFrame:
    """Per group: the largest polygon as shell, the others as its holes. `shell_id, n_holes, problem, rings`.

    `rings` is the assembled polygon of a group without a problem: the shell, the holes it had, and the new ones by id.

    Holes must lie strictly inside the shell without touching it; holes (those the shell has already included) may
    touch each other in points only and must not nest.
    """
    shells = largest_polygon(polygons, group, id_column, rings).select(group, "shell_id", "n_polygons", "is_unique")
    placed = join_sized(polygons.select(group, id_column, rings), settle(shells), group)
    is_shell = F.col(id_column) == F.col("shell_id")
    shell_rows = placed.where(is_shell).select(group, first(F.col(rings)).alias("shell"), F.col(rings).alias("__rings"))
    kept = shell_rows.select(
        group, F.posexplode(F.slice("__rings", F.lit(2), F.greatest(F.size("__rings") - 1, F.lit(0)))).alias("i", "ring")
    ).select(group, F.concat(F.lit("kept-"), F.col("i").cast("string")).alias("owner"), "ring")
    added = placed.where("is_unique").where(~is_shell)
    holes = added.select(group, F.col(id_column).cast("string").alias("owner"), first(F.col(rings)).alias("ring")).unionByName(kept)
    # Equal rings overlap already; they are set aside before pairs are looked for, so copies do not multiply.
    by_ring = settle(holes.groupBy(group, "ring").agg(F.count(F.lit(1)).alias("n"), F.min("owner").alias("owner"))).df
    copies, holes = by_ring.where("n > 1"), by_ring.select(group, "owner", "ring")
    shell_edges = shell_rows.select(group, ring_edges(F.col("shell")).alias("shell_edges"))
    with_shell = join_sized(holes, shell_edges, group)
    outside = with_shell.where(F.exists("ring", lambda p: ~covers(F.col("shell_edges"), p["x"], p["y"])))
    all_rings = holes.select(group, "owner", F.array("ring").alias("rings")).unionByName(
        shell_rows.select(group, F.lit("shell").alias("owner"), F.array("shell").alias("rings"))
    )
    contacts = settle(edge_contacts(edge_table(all_rings, [group, "owner"]), [group], "owner").where("a_owner <> b_owner")).df
    with_rim = (F.col("a_owner") == "shell") | (F.col("b_owner") == "shell")
    leaves = contacts.where(with_rim & (F.col("kind") == "cross"))
    touches = contacts.where(with_rim)
    overlaps = contacts.where(~with_rim & (F.col("kind") != "touch")).select(group).unionByName(copies.select(group))
    # A vertex or an edge middle of one hole strictly inside another: nesting or overlap, found through shared cells.
    probes = holes.select(group, "owner", F.explode(_probes(F.col("ring"))).alias("p")).select(group, "owner", "p.x", "p.y")
    nested = _strictly_inside_others(probes, all_rings.where("owner <> 'shell'"), group)
    with_interiors = added.where(F.size(rings) > 1)
    findings = {
        "interiors": with_interiors, "outside": outside, "leaves": leaves, "touches": touches, "overlaps": overlaps, "nested": nested,
    }
    listed = None
    for name, found in findings.items():
        rows = found.select(group, F.lit(name).alias("finding"))
        listed = rows if listed is None else listed.unionByName(rows)
    flagged = listed.groupBy(group).agg(*[F.bool_or(F.col("finding") == name).alias(name) for name in findings])
    new = added.groupBy(group).agg(F.sort_array(F.collect_list(F.struct(F.col(id_column).alias("k"), first(F.col(rings)).alias("ring")))).alias("__new"))
    judged = shells.join(flagged, group, "left").join(shell_rows.select(group, "__rings"), group, "left").join(new, group, "left")
    judged = judged.select(
        group, "shell_id", (F.col("n_polygons") - 1).alias("n_holes"),
        F.concat("__rings", F.transform("__new", lambda s: s["ring"])).alias("rings"),
        F.when(F.col("n_polygons") < 2, "too_few_polygons").when(~F.col("is_unique"), "ambiguous_shell")
        .when(F.col("interiors"), "hole_has_interiors").when(F.col("outside") | F.col("leaves"), "not_contained")
        .when(F.col("touches"), "touches_shell").when(F.col("overlaps"), "overlap").when(F.col("nested"), "nested").alias("problem"),
    )
    return judged.select(group, "shell_id", "n_holes", "problem", F.when(F.col("problem").isNull(), F.col("rings")).alias("rings"))


def _strictly_inside_others(probes: DataFrame, polygons: DataFrame, group: str) -> DataFrame:
    cells = settle(polygon_cells(polygons).select(group, F.col("owner").alias("other"), "__level", "__cx", "__cy", "min_x", "max_x", "min_y", "max_y", "edges", "base"))
    levels = [r[0] for r in cells.df.select("__level").distinct().collect()]
    if not levels:
        return probes.select(group).limit(0)
    reference = _reference(F.col("__cx"), F.col("__cy"), cell_size(F.col("__level")))
    inside = (
        F.col("x").between(F.col("min_x"), F.col("max_x")) & F.col("y").between(F.col("min_y"), F.col("max_y"))
        & (F.col("owner") != F.col("other")) & odd_in_cell(F.col("edges"), F.col("base"), F.col("x"), F.col("y"), *reference)
        & ~on_boundary(F.col("edges"), F.col("x"), F.col("y"))
    )
    return join_sized(_visit(probes, levels, "x", "y"), cells, [group, "__level", "__cx", "__cy"]).where(inside).select(group)
