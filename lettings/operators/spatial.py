"""Spatial joins as equi joins on grid cells with an exact test on top."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from lettings import rules
from lettings.functions import spatial as geo
from lettings.operators.joins import join_null_safe

CELL_DEG = 0.02
ROWS_PER_SPLIT = 4096
#: Parts that keep a cluster busy whose rows go on row by row, so that no part has to fit anywhere.
ENOUGH_PARTS = 64
METRES_PER_DEGREE = 111195.0


def area_cells(areas: DataFrame, cols: Sequence[str], cell: float = CELL_DEG) -> DataFrame:
    """One row per area and grid cell that it covers or whose border crosses it: ``__edges`` to test and ``__odd``.

    Edges become rows of their own and meet again per area and row of the grid, so an area
    with many edges is many tasks.  A ray to the east from inside a cell meets the edges of
    the cell, and from those further east either all that pass through the whole row, which
    only their parity ``__odd`` tells, or some that end in it.  A cell without an edge of its
    own is wholly inside (nothing to test) or wholly outside (no row).
    """
    numbered = areas.select(*cols, "boundary", F.monotonically_increasing_id().alias("__area"))
    named = numbered.select(*cols, "__area", F.explode(geo.edges("boundary")).alias("__e"))
    slack = cell * 1e-6  # a hair, so that rounding in x / cell never loses an edge
    low_y, high_y = F.least("__e.y0", "__e.y1"), F.greatest("__e.y0", "__e.y1")
    first, last = F.floor((low_y - slack) / cell).cast("bigint"), F.floor((high_y + slack) / cell).cast("bigint")
    rows = named.withColumn("__cy", F.explode(F.sequence(first, last))).groupBy("__area", *cols, "__cy").agg(
        F.collect_list("__e").alias("__all"),
        F.min(F.least("__e.x0", "__e.x1")).alias("__low"), F.max(F.greatest("__e.x0", "__e.x1")).alias("__high"),
    )
    columns = F.sequence(F.floor((F.col("__low") - slack) / cell).cast("bigint"), F.floor((F.col("__high") + slack) / cell).cast("bigint"))
    cells = rows.withColumn("__cx", F.explode(columns))
    west, south = F.col("__cx") * cell - slack, F.col("__cy") * cell - slack
    east, north = (F.col("__cx") + 1) * cell + slack, (F.col("__cy") + 1) * cell + slack

    def beyond(e: Column) -> Column:
        return F.least(e["x0"], e["x1"]) > east

    def passes(e: Column) -> Column:
        return beyond(e) & (F.least(e["y0"], e["y1"]) < south) & (F.greatest(e["y0"], e["y1"]) > north)

    def of_cell(e: Column) -> Column:
        return (F.greatest(e["x0"], e["x1"]) >= west) & ~beyond(e)

    def tested(e: Column) -> Column:
        return of_cell(e) | (beyond(e) & ~passes(e))

    middle = geo.crossings(F.filter("__all", beyond), (F.col("__cx") + 0.5) * cell, (F.col("__cy") + 0.5) * cell) % 2
    crossed = F.exists("__all", of_cell)
    found = cells.select(
        *cols, "__cx", "__cy",
        F.when(crossed, F.filter("__all", tested)).otherwise(F.array_except("__all", "__all")).alias("__edges"),
        F.when(crossed, F.size(F.filter("__all", passes)) % 2).otherwise(middle).alias("__odd"),
    )
    return found.where((F.size("__edges") > 0) | (F.col("__odd") == 1))


def point_in_area(
    points: DataFrame,
    areas: DataFrame,
    cols: Sequence[str],
    how: str = "inner",
    lon: str = "longitude",
    lat: str = "latitude",
    cell: float = CELL_DEG,
) -> DataFrame:
    """Points next to the areas that contain them; ``left`` keeps the others.

    A cell has a row per area only, so one that holds many points is cut by the skew join.
    """
    cells = area_cells(areas, cols, cell)
    # points without a position match nothing; they are spread out instead of sharing one NULL key
    nowhere = -(1 << 40) - F.pmod(F.xxhash64(*points.columns), F.lit(1 << 20))
    placed = points.withColumn("__px", F.coalesce(F.floor(F.col(lon) / cell).cast("bigint"), nowhere)).withColumn(
        "__py", F.coalesce(F.floor(F.col(lat) / cell).cast("bigint"), nowhere)
    )
    test = (
        (F.col("__px") == F.col("__cx"))
        & (F.col("__py") == F.col("__cy"))
        & ((geo.crossings("__edges", lon, lat) + F.col("__odd")) % 2 == 1)
    )
    return placed.join(cells, test, how).drop("__px", "__py", "__cx", "__cy", "__edges", "__odd")


def extent(areas: DataFrame) -> DataFrame:
    """Envelope over all areas as one row."""
    box = areas.select(geo.bounds("boundary").alias("b"))
    return box.agg(
        F.min("b.xmin").alias("xmin"), F.max("b.xmax").alias("xmax"),
        F.min("b.ymin").alias("ymin"), F.max("b.ymax").alias("ymax"),
    )


def in_extent(points: DataFrame, areas: DataFrame, lon: str = "longitude", lat: str = "latitude") -> DataFrame:
    """Points inside the envelope of all areas (one row, so it is broadcast)."""
    box = F.broadcast(extent(areas).select(F.struct("*").alias("__box")))
    return points.join(box, geo.in_box(lon, lat, F.col("__box"))).drop("__box")


def _row_height(metres: float) -> float:
    return metres / METRES_PER_DEGREE * 1.01


def _row(lat: Column, height: float) -> Column:
    return F.floor(lat / height).cast("bigint")


def _width(row: Column, height: float) -> Column:
    """Cell width of a grid row, taken at the far side of the next row, so that
    the distance never spans more than one cell."""
    far = F.least((F.abs(row) + 2) * height, F.lit(89.0))
    return F.lit(height) / F.cos(F.radians(far))


def home_cell(df: DataFrame, lon: str, lat: str, metres: float) -> DataFrame:
    height = _row_height(metres)
    row = _row(F.col(lat), height)
    return df.withColumn("__cy", row).withColumn(
        "__cx", F.floor(F.col(lon) / _width(row, height)).cast("bigint")
    )


def neighbour_cells(df: DataFrame, lon: str, lat: str, metres: float) -> DataFrame:
    """Each row in the nine cells from which it can be within ``metres``."""
    height = _row_height(metres)
    row = _row(F.col(lat), height)
    steps = F.array(F.lit(-1), F.lit(0), F.lit(1))
    rows = df.select("*", F.explode(F.transform(steps, lambda d: row + d)).alias("__cy"))
    column = F.floor(F.col(lon) / _width(F.col("__cy"), height)).cast("bigint")
    return rows.select("*", F.explode(F.transform(steps, lambda d: column + d)).alias("__cx"))


def split_hot_cells(
    left: DataFrame, right: DataFrame, keys: Sequence[str], ids: tuple[Sequence[str], Sequence[str]],
    rows: int = ROWS_PER_SPLIT,
) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides of an equi join with full cells cut into a grid of parts.

    A cell with many rows on both sides would be one task.  Rows are counted per
    cell (combined map-side), the left side is cut in parts of about ``rows``
    rows and so is the right side, and every left part meets every right part
    exactly once.  Cells that are small stay whole.
    """
    n_left = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("__nl"))
    n_right = right.groupBy(*keys).agg(F.count(F.lit(1)).alias("__nr"))
    parts = n_left.join(n_right, list(keys)).select(
        *keys,
        F.ceil(F.col("__nl") / rows).alias("__pl"),
        F.ceil(F.col("__nr") / rows).alias("__pr"),
    ).where((F.col("__pl") > 1) | (F.col("__pr") > 1))

    def cut(df: DataFrame, id_cols: Sequence[str], mine: str, other: str, a: str, b: str) -> DataFrame:
        sized = df.join(parts, list(keys), "left")
        own = F.pmod(F.xxhash64(*id_cols), F.coalesce(F.col(mine), F.lit(1)))
        all_other = F.sequence(F.lit(0).cast("bigint"), F.coalesce(F.col(other), F.lit(1)) - 1)
        return sized.select(*df.columns, own.alias(a), F.explode(all_other).alias(b))

    cut_left = cut(left, ids[0], "__pl", "__pr", "__a", "__b")
    cut_right = cut(right, ids[1], "__pr", "__pl", "__b", "__a")
    return cut_left, cut_right, [*keys, "__a", "__b"]


def fixed_parts(df: DataFrame, *by: Column | str, enough: int | None = None) -> DataFrame:
    """Rows in a number of parts that does not follow their bytes: where few bytes give much work, these would be one task.

    The shuffle's partitions, or ``enough`` if these are more: a part that is shuffled on writes a file for each partition.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(parts if enough is None else min(parts, enough), 2 * spark.sparkContext.defaultParallelism)
    return df.repartition(parts, *by)


def within_distance(
    left: DataFrame, right: DataFrame, metres: float, how: str = "left",
    left_at: tuple[str, str] = ("longitude", "latitude"),
    right_at: tuple[str, str] = ("poi_longitude", "poi_latitude"), rows: int = ROWS_PER_SPLIT,
) -> DataFrame:
    """All pairs within ``metres``; ``left`` keeps rows without a partner.

    Full cells are cut in parts on both sides, and every part meets every other once.
    Whether a row has a partner at all is told by its position, from counts
    (:func:`nearby_counts`) where :func:`maybe_lonely` leaves it open, so rows without
    one are added to the pairs of all parts.
    Where pairs are not wanted themselves, the counts alone are far fewer rows.
    """
    here = home_cell(left.withColumn("__u", geo.unit_vector(*left_at)), *left_at, metres)
    there = neighbour_cells(right.withColumn("__v", geo.unit_vector(*right_at)), *right_at, metres)
    here, there, on = split_hot_cells(
        here.where(F.col("__cx").isNotNull() & F.col("__cy").isNotNull()), there, ["__cx", "__cy"], (left.columns, right.columns), rows)
    there = there.select(*[F.col(k).alias(f"__r{k}") for k in on], "__v", *right.columns)
    test = geo.is_within("__u", "__v", metres)
    for k in on:
        test = (F.col(k) == F.col(f"__r{k}")) & test
    # both sides list cells, which the planner does not count: it would broadcast what is too large for that
    pairs = fixed_parts(here, *on).join(there.hint("merge"), test).select(*left.columns, *right.columns)
    if how == "inner":
        return pairs
    places = left.select(F.col(left_at[0]).alias("longitude"), F.col(left_at[1]).alias("latitude")).distinct()
    points = right.select(F.col(right_at[0]).alias("longitude"), F.col(right_at[1]).alias("latitude"))
    open_places = maybe_lonely(places, points, metres).withColumn("__n", F.lit(0))
    near = nearby_counts(open_places, "__n", points, {"__points": F.count(F.lit(1))}, metres, at=True)
    lonely = near.where(F.col("__points") == 0).select(
        F.col("longitude").alias(left_at[0]), F.col("latitude").alias(left_at[1]), F.lit(True).alias("__lonely"))
    alone = join_null_safe(left, lonely, list(left_at)).drop("__lonely")
    empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in right.schema.fields]
    return pairs.unionByName(alone.select(*left.columns, *empty))


#: Sides of the nodes' levels as parts of the distance; each node has the nodes of the next level in four rows and columns.
NODE_LEVELS = (2, 8, 32)
NODE_POINTS = 64
POSITION = ("longitude", "latitude")
#: Parts of a position's unit vector as plain columns: a struct would be opened once per pair.
UNIT = ("__ux", "__uy", "__uz")


def node_of(lon: Column, lat: Column, metres: float, division: int) -> tuple[Column, Column]:
    """Row and column of a position on the level that divides the distance by ``division``."""
    height = _row_height(metres)
    row = F.floor(lat / (height / division)).cast("bigint")
    return row, F.floor(lon / (_width(F.floor(row / division), height) / division)).cast("bigint")


def with_spans(rows: DataFrame, metres: float, division: int) -> DataFrame:
    """Positions next to node rows ``__y``: degrees to the east and west within which the circle can meet
    a point of the row (``__out``) and holds all of them (``__in``); NULL where there are none.

    A hair (1e-9) on latitudes, spans and the radius keeps rounding on the safe side.
    """
    hair = 1e-9
    step = _row_height(metres) / division
    lat, south, north = F.col("latitude"), F.col("__y") * step, (F.col("__y") + 1) * step
    half = math.sin(metres / (2.0 * rules.EARTH_RADIUS_M)) ** 2

    def span(gap: Column, parallel: Column, most: float) -> Column:
        rest = F.lit(most) - F.pow(F.sin(F.radians(gap) / 2.0), 2.0)
        sizes = F.greatest(F.cos(F.radians(lat)), F.lit(hair)) * F.greatest(F.cos(F.radians(parallel)), F.lit(hair))
        return F.when(rest >= 0, F.degrees(2.0 * F.asin(F.sqrt(F.least(rest / sizes, F.lit(1.0))))))

    near = F.greatest(south - lat - hair, lat - north - hair, F.lit(0.0))
    far = F.greatest(lat - south, north - lat) + hair
    outer = span(near, F.greatest(F.abs(south), F.abs(north)), half * (1 + hair)) + hair
    inner = span(far, F.greatest(south, -north, F.lit(0.0)), half * (1 - hair)) - hair
    width = _width(F.floor(F.col("__y") / division), _row_height(metres)) / division
    return rows.withColumns({"__out": outer, "__in": inner, "__w": width})


def met(candidates: DataFrame) -> DataFrame:
    """Candidates whose nodes the circle can meet; ``__inside`` if all of the node is in it."""
    lon, west, east = F.col("longitude"), F.col("__x") * F.col("__w"), (F.col("__x") + 1) * F.col("__w")
    inside = (west >= lon - F.col("__in")) & (east <= lon + F.col("__in"))
    return candidates.where((east >= lon - F.col("__out")) & (west <= lon + F.col("__out"))).select(
        *POSITION, *UNIT, "__y", "__x", F.coalesce(inside, F.lit(False)).alias("__inside"))


def nodes_around(homes: DataFrame, metres: float, division: int) -> DataFrame:
    """Each position with the nodes (``__y``, ``__x``) that its circle can meet."""
    height = _row_height(metres)
    lon, lat, step = F.col("longitude"), F.col("latitude"), height / division
    rows = homes.select("*", F.explode(F.sequence(
        F.floor((lat - height) / step).cast("bigint"), F.floor((lat + height) / step).cast("bigint"))).alias("__y"))
    first, last = ((lon + sign * F.col("__out")) / F.col("__w") for sign in (-1, 1))
    return met(with_spans(rows, metres, division).select("*", F.explode(F.sequence(
        F.floor(first).cast("bigint"), F.floor(last).cast("bigint"))).alias("__x")))


def opened(nodes: DataFrame, metres: float, division: int) -> DataFrame:
    """Each position with the nodes of the level ``division`` in its nodes of the level before."""
    inner = F.sequence(F.lit(0).cast("bigint"), F.lit(3).cast("bigint"))
    rows = nodes.select(*POSITION, *UNIT, (F.col("__y") * 4).alias("__y4"), (F.col("__x") * 4).alias("__x4"))
    rows = rows.select(*POSITION, *UNIT, "__x4", F.explode(F.transform(inner, lambda d: F.col("__y4") + d)).alias("__y"))
    return met(with_spans(rows, metres, division).select(
        "*", F.explode(F.transform(inner, lambda d: F.col("__x4") + d)).alias("__x")))


def homes_of(places: DataFrame) -> DataFrame:
    """The distinct positions of places with their unit vectors, in a fixed number of parts."""
    homes = places.select(*POSITION).where("longitude is not null and latitude is not null").distinct()
    # dealt by a hash, as a deal by the columns themselves counts as done already and is left out
    homes = fixed_parts(homes, F.xxhash64(*POSITION), enough=ENOUGH_PARTS).withColumn("__u", geo.unit_vector(*POSITION))
    return homes.select(*POSITION, *[F.col("__u")[axis].alias(name) for axis, name in zip("xyz", UNIT)])


def maybe_lonely(places: DataFrame, points: DataFrame, metres: float) -> DataFrame:
    """Places without a point in any large node that is wholly inside their circle; all others have a point for sure.

    Where points are dense, hardly a place is left, and none of the others needs its nodes on finer levels.
    """
    inside = nodes_around(homes_of(places), metres, NODE_LEVELS[0]).where("__inside")
    y, x = node_of(F.col("longitude"), F.col("latitude"), metres, NODE_LEVELS[0])
    held = points.where("longitude is not null and latitude is not null").select(y.alias("__y"), x.alias("__x")).distinct()
    return places.join(inside.join(held, ["__y", "__x"], "left_semi").select(*POSITION).distinct(), list(POSITION), "left_anti")


def nearby_counts(
    places: DataFrame, key: str, pois: DataFrame, counters: dict[str, Column],
    metres: float = rules.NEARBY_METRES, rows: int = NODE_POINTS, at: bool = False,
) -> DataFrame:
    """Sums of ``counters`` over the points within ``metres`` of each place, zeros kept; with its position if ``at``.

    Points are summed up in a tree of nodes.  A node wholly inside a circle counts as one
    row; one that the circle cuts is opened if it has more than ``rows`` points, and only the
    points of small nodes on the rim are compared one by one.  So the work grows with the
    rim of the circle and the root of the density.  Points and places at the same position
    are merged first, so a default position that holds a third of all rows counts once.

    Places are few bytes before their nodes are listed, and the planner goes by those bytes.
    So they are dealt to a fixed number of parts, and their nodes are on the side of a join
    that is never broadcast.  That side is listed once per level and streams past a hashed
    partition of nodes and points, without a sort; the hashed side has at most a row per
    distinct position and level and one per node.
    """
    names = list(counters)
    spots = (
        pois.where(F.col("longitude").isNotNull() & F.col("latitude").isNotNull())
        .groupBy(F.col("longitude").alias("__lon"), F.col("latitude").alias("__lat"))
        .agg(*[c.alias(name) for name, c in counters.items()])
    )
    unit = F.struct(*[F.col(name).alias(axis) for axis, name in zip("xyz", UNIT)])
    other = [f"__v{axis}" for axis in "xyz"]
    node, summed = ["__y", "__x", "__inside"], []
    found = nodes_around(homes_of(places), metres, NODE_LEVELS[0])
    for division in NODE_LEVELS:
        y, x = node_of(F.col("__lon"), F.col("__lat"), metres, division)
        here = spots.withColumns({"__y": y, "__x": x, "__inside": F.lit(False)})
        nodes = here.groupBy(*node).agg(F.count(F.lit(1)).alias("__n"), *[F.sum(n).alias(n) for n in names])
        full = nodes.where(F.col("__n") > rows).select(*node)
        last = division == NODE_LEVELS[-1]
        few = here if last else here.join(full, node, "left_anti")
        points = few.withColumn("__v", geo.unit_vector("__lon", "__lat")).select(
            *node, *[F.col("__v")[axis].alias(name) for axis, name in zip("xyz", other)], *names)
        nowhere = {name: F.lit(None).cast("double") for name in other}
        whole = nodes.withColumns({"__inside": F.lit(True), **nowhere}).select(*points.columns)
        # nodes inside meet their sums, those on the rim their points: one join of nodes that are listed once;
        # without a point there is one row of NULLs: the joins stay outer, so only the right sides can be broadcast
        both = found.join(whole.unionByName(points).hint("shuffle_hash"), node, "left")
        near = geo.is_within(unit, F.struct(*[F.col(name).alias(axis) for axis, name in zip("xyz", other)]), metres)
        summed.append(both.where(F.col("__vx").isNull() | near).select(*POSITION, *names))
        if not last:
            spots = here.join(full, node, "left_semi").drop(*node)
            found = opened(found.join(full, node, "left_semi"), metres, NODE_LEVELS[NODE_LEVELS.index(division) + 1])
    sums = reduce(DataFrame.unionByName, summed).groupBy(*POSITION).agg(*[F.sum(name).alias(name) for name in names])
    counted = join_null_safe(places.select(key, *POSITION), sums, POSITION, "left")
    return counted.select(key, *(POSITION if at else []), *[F.coalesce(F.col(n), F.lit(0)).alias(n) for n in names])


def points_in_area_counts(points: DataFrame, areas: DataFrame, key: str, counters: dict[str, Column]) -> DataFrame:
    """Counts per containing area."""
    return point_in_area(points, areas, [key]).groupBy(key).agg(
        *[c.alias(name) for name, c in counters.items()]
    )
