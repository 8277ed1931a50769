"""Joins by distance on the sky.

Positions become unit vectors and fall into cubes of a grid whose edge is at least the chord of the largest
radius, so partners are in the same or a neighbouring cube. The join is an equi-join on cubes that Spark can
shuffle, with the exact separation as its residual condition: no poles, no wrap at 360 degrees, no cross join.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions import exprs
from orrery.operators.store import cut


def with_cells(df: DataFrame, ra: str, dec: str, edge: float, neighbours: bool) -> DataFrame:
    """df with its cube as columns cx, cy, cz; with neighbours, a row for each of the 27 cubes around."""
    r, d = F.radians(ra), F.radians(dec)
    cube = [F.floor(v / edge) for v in (F.cos(d) * F.cos(r), F.cos(d) * F.sin(r), F.sin(d))]
    if not neighbours:
        return df.withColumns(dict(zip(("cx", "cy", "cz"), cube, strict=True)))
    near = F.explode(F.array(*(F.struct(*(F.lit(o).alias(n) for n, o in zip("xyz", (x, y, z), strict=True))) for x in (-1, 0, 1) for y in (-1, 0, 1) for z in (-1, 0, 1))))
    return df.withColumn("__near", near).withColumns({f"c{n}": c + F.col(f"__near.{n}") for n, c in zip("xyz", cube, strict=True)}).drop("__near")


def spread(df: DataFrame, *by: str) -> DataFrame:
    """df dealt by columns into as many tasks as a shuffle has: a join makes far more of few bytes, which would else be one task."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism), *by)


def _on_the_sphere(df: DataFrame, ra: str, dec: str, own: str) -> DataFrame:
    """df with its unit vector and the cosine of its declination, made once a row and not once a pair."""
    r, d = F.radians(ra), F.radians(dec)
    return df.withColumns({f"__x{own}": F.cos(d) * F.cos(r), f"__y{own}": F.cos(d) * F.sin(r), f"__z{own}": F.sin(d), f"__c{own}": F.cos(d)})


def cone_join(targets: DataFrame, sources: DataFrame, radius_arcsec: float, target_pos=("t_ra", "t_dec"), source_pos=("ra", "dec"), radius: Column | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Pairs within radius_arcsec with their separation (J1); radius, if given, narrows it row by row (J2); by names columns that must be equal.

    Rows without a valid position match nothing. The side with fewer rows should come first: it is the one
    that is spread over neighbouring cubes. Chords sort out most candidates, separations are taken of the others.
    """
    chord = 2 * math.sin(math.radians(min(radius_arcsec / 3600, 180.0)) / 2)
    edge = 2 * math.sin(math.radians(radius_arcsec / 3600) / 2) * 1.000001 + 1e-12
    left = with_cells(targets.where(exprs.valid_position(F.col(target_pos[0]), F.col(target_pos[1]))), *target_pos, edge, True)
    right = with_cells(sources.where(exprs.valid_position(F.col(source_pos[0]), F.col(source_pos[1]))), *source_pos, edge, False)
    cells = ["cx", "cy", "cz", *by]
    left, right = _on_the_sphere(spread(left, *cells), *target_pos, "l"), _on_the_sphere(spread(right, *cells), *source_pos, "r")
    apart = [F.col(f"__{n}l") - F.col(f"__{n}r") for n in "xyz"]
    joined = left.join(right, cells).where(apart[0] * apart[0] + apart[1] * apart[1] + apart[2] * apart[2] <= chord * chord * 1.00001 + 1e-15)
    separation = exprs.angular_separation(F.col(target_pos[0]), F.col(target_pos[1]), F.col(source_pos[0]), F.col(source_pos[1]), F.col("__cl"), F.col("__cr"))
    joined = joined.withColumn("separation", separation).drop("cx", "cy", "cz", *(f"__{n}{own}" for n in "xyzc" for own in "lr"))
    return joined.where(F.col("separation") <= (F.lit(radius_arcsec) if radius is None else radius))


#: The last octave: twice the radius so often that all of the sky is in reach.
LAST_OCTAVE = 60


def octave(reach: Column, radius_arcsec: float) -> Column:
    """0 for a reach within the radius, else how often the radius must be doubled to hold it."""
    return F.when(reach > radius_arcsec, F.least(F.greatest(F.ceil(F.log2(reach / radius_arcsec)), F.lit(1)), F.lit(LAST_OCTAVE))).otherwise(0).cast("int")


def octaves(rows: DataFrame) -> list[int]:
    """The octaves that rows(octave) have, LAST_OCTAVE + 1 at most."""
    return sorted(r[0] for r in rows.distinct().collect())


#: Epochs of targets up to which a source is moved once for each, and not once a pair.
EPOCHS = 32


def moving_cone_join(targets: DataFrame, sources: DataFrame, radius_arcsec: float, epochs: int = EPOCHS) -> DataFrame:
    """cone_join with each source where it stands at its target's epoch.

    targets may have t_epoch, sources epoch, pmra and pmdec (mas a year, pmra times cos dec); a source without
    one of them, or a target without an epoch, is taken as it is. The sources' own ra and dec stay in the result.
    With up to epochs of targets each source goes to where it stands at each, and meets the targets of that epoch.
    With more, sources are taken by octaves of how far they move, each with a grid of its own reach: a wild motion
    coarsens the grid of those that move as far only.
    """
    if "t_epoch" not in targets.columns or not {"epoch", "pmra", "pmdec"} <= set(sources.columns):
        return cone_join(targets, sources, radius_arcsec)
    number = lambda c: exprs.finite_or_null(F.col(c).cast("double"))
    targets = targets.withColumn("__to", number("t_epoch"))
    moving = sources.withColumns({"__from": number("epoch"), "__pmra": number("pmra"), "__pmdec": number("pmdec")})
    times = [r[0] for r in targets.select("__to").distinct().limit(epochs + 1).collect()]
    if len(times) <= epochs:
        moved = moving.where(exprs.valid_position(F.col("ra"), F.col("dec"))).withColumn("__to", F.explode(F.array(*map(F.lit, times)).cast("array<double>")))
        ra, dec = exprs.propagated(F.col("ra"), F.col("dec"), F.col("__pmra"), F.col("__pmdec"), F.col("__from"), F.col("__to"))
        epoch = F.struct(F.lit(0).alias("all"), F.col("__to").alias("to"))  # a target without an epoch has one, too
        moved = moved.withColumns({"__ra": ra, "__dec": dec, "__epoch": epoch}).drop("__to", "__from", "__pmra", "__pmdec")
        near = cone_join(targets.withColumn("__epoch", epoch).drop("__to"), moved, radius_arcsec, source_pos=("__ra", "__dec"), by=("__epoch",))
        return near.drop("__ra", "__dec", "__epoch")
    first, last = targets.agg(F.min("__to"), F.max("__to")).first()
    years = F.greatest(F.abs(F.lit(first) - F.col("__from")), F.abs(F.lit(last) - F.col("__from")))
    moving = moving.withColumn("__motion", F.coalesce(F.hypot("__pmra", "__pmdec") / 1000 * years, F.lit(0.0)))
    moving = moving.withColumn("__octave", octave(F.col("__motion"), radius_arcsec))
    found = None
    for k in octaves(moving.select("__octave")) or [0]:
        near = cone_join(targets, moving.where(F.col("__octave") == k), min(radius_arcsec * (1 + 2.0**k), 180 * 3600.0))
        ra, dec = exprs.propagated(F.col("ra"), F.col("dec"), F.col("__pmra"), F.col("__pmdec"), F.col("__from"), F.col("__to"))
        near = near.withColumns({"__ra": ra, "__dec": dec})  # columns of their own: the distance names them several times
        near = near.withColumn("separation", exprs.angular_separation(F.col("t_ra"), F.col("t_dec"), F.col("__ra"), F.col("__dec"))).where(F.col("separation") <= radius_arcsec)
        near = near.drop("__motion", "__octave", "__from", "__to", "__pmra", "__pmdec", "__ra", "__dec")
        found = near if found is None else found.unionByName(near)
    return found


def top_matches(matches: DataFrame, k: int, by: list[str], order: list[Column]) -> DataFrame:
    """The k first matches of each group, as column rank."""
    return matches.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def adaptive(matches: DataFrame, by: str, order: list[Column], radius: float) -> DataFrame:
    """Matches within min(radius, max(1, 1.5 times the median of a target's five nearest)).

    The five nearest are cut off before they are shuffled; only their median goes back to the matches.
    """
    nearest = top_matches(matches.select(by, "separation", *(c.alias(f"__o{i}") for i, c in enumerate(order))), 5, [by], [F.col(f"__o{i}") for i in range(len(order))])
    median = nearest.groupBy(by).agg(F.median("separation").alias("__m"))
    within = matches.join(median, by).withColumn("effective_radius", F.least(F.lit(radius), F.greatest(F.lit(1.0), 1.5 * F.col("__m"))))
    return within.where("separation <= effective_radius").drop("__m")


#: Halvings of a radius at most.
HALVINGS = 12


def growing_radii(rows: DataFrame, position: tuple[str, str], radius_arcsec: float, wanted: float) -> list[float]:
    """Radii that double up to radius_arcsec, the first holding some wanted of rows on an average, by the mean of their cells."""
    edge = 2 * math.sin(math.radians(min(radius_arcsec / 3600, 180.0)) / 2) * 1.000001 + 1e-12
    cells = with_cells(rows.where(exprs.valid_position(F.col(position[0]), F.col(position[1]))), *position, edge, False).groupBy("cx", "cy", "cz").count()
    n, held = cells.agg(F.sum("count"), F.count("*")).first()
    halvings = 0 if not held else math.floor(math.log2(max(1.0, math.pi * n / held / wanted)) / 2)
    return [radius_arcsec / 2**i for i in range(min(halvings, HALVINGS), -1, -1)]


def _without(rows: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    other = done.select(*(F.col(c).alias(f"__done_{c}") for c in keys))
    return rows.join(other, [F.col(c).eqNullSafe(F.col(f"__done_{c}")) for c in keys], "left_anti")


def nearest_matches(targets: DataFrame, sources: DataFrame, radius_arcsec: float, k: int, key: str, by: list[str], order: list[Column], radii: list[float] | None = None) -> DataFrame:
    """top_matches of cone_join by key and by(columns of sources that have few values), without all pairs.

    A target looks for its k nearest of each group within a small radius first; only groups with fewer look again
    within twice of it, among their own sources. What is within a radius can't be beaten from outside of it, so
    order must begin with the separation.
    """
    kinds = sources.withColumn("__group", F.struct(F.lit(0).alias("all"), *by))
    groups = cut(kinds.select("__group").distinct(), "groups")
    radii = radii or growing_radii(sources, ("ra", "dec"), radius_arcsec, 3.0 * k * max(1, groups.count()))
    found, pending = None, targets
    for i, radius in enumerate(radii):
        top = top_matches(cone_join(pending, kinds, radius, by=("__group",) if i else ()), k, [key, "__group"], order)
        if radius < radii[-1]:
            top = cut(top, "nearest")
            done = top.where(F.col("rank") == k).select(key, "__group")
            asked = pending if i else pending.crossJoin(F.broadcast(groups))  # groups are few
            pending = cut(_without(asked, done, [key, "__group"]), "pending")
            top = top.join(done.withColumnsRenamed({key: "__key", "__group": "__own"}), F.col(key).eqNullSafe(F.col("__key")) & (F.col("__group") == F.col("__own")), "left_semi")
        top = top.drop("__group")
        found = top if found is None else found.unionByName(top)
    return found


def adaptive_join(targets: DataFrame, sources: DataFrame, radius_arcsec: float, key: str, order: list[Column], radii: list[float] | None = None) -> DataFrame:
    """adaptive of cone_join, without all pairs: the five nearest first, then the matches within each target's own radius, by octaves of it."""
    nearest = nearest_matches(targets, sources, radius_arcsec, 5, key, [], order, radii)
    reach = nearest.groupBy(key).agg(F.least(F.lit(radius_arcsec), F.greatest(F.lit(1.0), 1.5 * F.median("separation"))).alias("effective_radius"))
    halvings = F.least(F.floor(F.log2(F.lit(radius_arcsec) / F.col("effective_radius"))), F.lit(HALVINGS)).cast("int")
    own = cut(targets.join(reach, key).withColumn("octave", halvings), "reach")
    found = None
    for i in octaves(own.select("octave")) or [0]:
        near = cone_join(own.where(F.col("octave") == i).drop("octave"), sources, radius_arcsec / 2**i * 1.000001, radius=F.col("effective_radius"))
        found = near if found is None else found.unionByName(near)
    return found


def circular_center(points: DataFrame, by: list[str]) -> DataFrame:
    """The mean position of each group, right ascensions on the circle."""
    r = F.radians("ra")
    return points.groupBy(*by).agg(exprs.normalized_ra(F.degrees(F.atan2(F.avg(F.sin(r)), F.avg(F.cos(r))))).alias("ra"), F.avg("dec").alias("dec"))


def nearest_target(targets: DataFrame, sources: DataFrame, radius_arcsec: float, source_key: str, radii: list[float] | None = None) -> DataFrame:
    """Each source that is within the radius of any target, with the least separation (J9); within small radii first, as nearest_matches has it."""
    found, pending = None, sources
    radii = radii or growing_radii(targets, ("t_ra", "t_dec"), radius_arcsec, 3.0)
    for radius in radii:
        near = cone_join(targets, pending, radius).groupBy(source_key).agg(F.min("separation").alias("separation"))
        if radius < radii[-1]:
            near = cut(near, "nearest")
            pending = cut(_without(pending, near, [source_key]), "pending")
        found = near if found is None else found.unionByName(near)
    return found


def pair_edges(matches: DataFrame, by: str, key: str, radius_arcsec: float) -> DataFrame:
    """Pairs of one target's detections that lie within max(radius, either error) of each other.

    matches: by, key, ra, dec and error_arcsec; an error that isn't a finite number counts as 0. Rows are joined
    by target and cube, so a crowded target is as many groups as it has cubes. Rows are taken by octaves of
    their errors: each octave is held against itself and the smaller ones, on a grid of its own reach.
    """
    cols = [by, key, "ra", "dec", "error_arcsec"]
    rows = matches.select(*cols).withColumn("error_arcsec", F.coalesce(exprs.finite_or_null(F.col("error_arcsec").cast("double")), F.lit(0.0)))
    rows = rows.withColumn("octave", octave(F.col("error_arcsec"), radius_arcsec))

    def joined(left: DataFrame, right: DataFrame, reach: float) -> DataFrame:
        edge = 2 * math.sin(math.radians(min(reach / 3600, 180.0)) / 2) * 1.000001 + 1e-12
        left = with_cells(left, "ra", "dec", edge, True).withColumnsRenamed({c: f"l_{c}" for c in (*cols, "octave") if c != by})
        pairs = left.join(with_cells(right, "ra", "dec", edge, False), [by, "cx", "cy", "cz"])
        sep = exprs.angular_separation(F.col("l_ra"), F.col("l_dec"), F.col("ra"), F.col("dec"))
        return pairs.where(sep <= F.greatest(F.lit(radius_arcsec), F.col("l_error_arcsec"), F.col("error_arcsec")))

    # of two rows of one octave the smaller key is on the left, of two the one of the larger octave
    once = (F.col(f"l_{key}") < F.col(key)) | ((F.col("octave") < F.col("l_octave")) & (F.col(f"l_{key}") != F.col(key)))
    pairs = None
    for k in octaves(rows.select("octave")) or [0]:
        own = joined(rows.where(F.col("octave") == k), rows.where(F.col("octave") <= k), radius_arcsec * 2.0**k).where(once)
        pairs = own if pairs is None else pairs.unionByName(own)
    return pairs.select(by, F.least(f"l_{key}", key).alias("a"), F.greatest(f"l_{key}", key).alias("b"))


#: Detections and edges of a target up to which one task finds its components.
FEW = 100_000
#: Detections of either of two cells that are compared at a time.
BLOCK = 512


def _roots(batches: Iterator[pa.RecordBatch], by: str, key: str) -> Iterator[pa.RecordBatch]:
    """by, key and root out of edges (by, a, b) sorted by by, a node being an edge to itself; one target's edges are held at a time."""

    def solved(target: object, edges: list[tuple]) -> pa.RecordBatch:
        top: dict = {}

        def root(x):
            while top.setdefault(x, x) != x:
                top[x] = x = top[top[x]]
            return x

        for a, b in edges:
            x, y = root(a), root(b)
            if x != y:
                top[max(x, y)] = min(x, y)
        nodes = list(top)
        return pa.RecordBatch.from_arrays([pa.array([target] * len(nodes), kinds[0]), pa.array(nodes, kinds[1]), pa.array(map(root, nodes), kinds[1])], [by, key, "root"])

    target, edges, kinds = None, [], None
    for batch in batches:
        kinds = [batch.schema.field(c).type for c in (by, "a")]
        for own, a, b in zip(*(batch.column(c).to_pylist() for c in (by, "a", "b")), strict=True):
            if edges and own != target:
                yield solved(target, edges)
                edges = []
            target = own
            edges.append((a, b))
    if edges:
        yield solved(target, edges)


def group_labels(nodes: DataFrame, edges: DataFrame, by: str, key: str, few: int = FEW) -> DataFrame:
    """Connected components by target: by, key and root, the least key of the component (A1).

    Targets of up to few detections and edges are solved in one pass, each by one task. For the others labels pass
    along edges and to their label's label, a partial aggregate and a join a round, until nothing changes.
    """
    told = nodes.select(by, F.col(key).alias("a"), F.col(key).alias("b")).unionByName(edges.select(by, "a", "b"))
    told = cut(told, "edges")
    large = cut(told.groupBy(by).count().where(F.col("count") > few).select(by), "large")
    kind = ", ".join(f"`{n}` {told.schema[c].dataType.simpleString()}" for n, c in ((by, by), (key, "a"), ("root", "a")))
    small = told.join(large, by, "left_anti").repartition(by).sortWithinPartitions(by)
    found = small.mapInArrow(lambda b: _roots(b, by, key), kind)
    if large.isEmpty():
        return found
    rest = told.join(large, by, "left_semi")
    return found.unionByName(passed_labels(rest.where("a = b").select(by, F.col("a").alias(key)), rest.where("a <> b"), by, key))


def _linked(batches: Iterator[pa.RecordBatch], by: str, key: str, radius_arcsec: float) -> Iterator[pa.RecordBatch]:
    """by, key and root out of rows (by, key, ra, dec, error_arcsec) sorted by by, of errors within the radius; one target's rows are held at a time.

    Rows of a cell whose diagonal is within the radius are linked; of two cells near each other that are not linked yet one pair is sought.
    """
    chord = 2 * math.sin(math.radians(min(radius_arcsec / 3600, 180.0)) / 2)
    steps = [o for o in itertools.product(range(-2, 3), repeat=3) if o > (0, 0, 0)]
    steps.sort(key=lambda o: sum(x * x for x in o))

    def solved(t: pa.Table) -> pa.RecordBatch:
        coded = t[key].combine_chunks().dictionary_encode()
        node, names = coded.indices.to_numpy(), coded.dictionary
        ra, dec = np.radians(t["ra"].to_numpy()), np.radians(t["dec"].to_numpy())
        cubes = np.floor(np.stack([np.cos(dec) * np.cos(ra), np.cos(dec) * np.sin(ra), np.sin(dec)], 1) / (chord / math.sqrt(3) * 0.999999)).astype(np.int64)
        found, own = np.unique(cubes, axis=0, return_inverse=True)
        own = own.ravel()
        rows = np.split(np.argsort(own, kind="stable"), np.cumsum(np.bincount(own))[:-1])
        top = list(range(len(found)))

        def root(x: int) -> int:
            while top[x] != x:
                top[x] = x = top[top[x]]
            return x

        def near(a: np.ndarray, b: np.ndarray) -> bool:
            for i, j in itertools.product(range(0, len(a), BLOCK), range(0, len(b), BLOCK)):
                p, q = a[i : i + BLOCK, None], b[None, j : j + BLOCK]
                h = np.sin((dec[q] - dec[p]) / 2) ** 2 + np.cos(dec[p]) * np.cos(dec[q]) * np.sin((ra[q] - ra[p]) / 2) ** 2
                if (np.degrees(2 * np.arcsin(np.sqrt(np.minimum(1.0, h)))) * 3600 <= radius_arcsec).any():
                    return True
            return False

        if len(names) < len(node):  # a key in several cells
            first = np.zeros(len(names), np.int64)
            first[node] = own
            for x, y in zip(own.tolist(), first[node].tolist(), strict=True):
                x, y = root(x), root(y)
                top[max(x, y)] = min(x, y)
        place = {c: i for i, c in enumerate(map(tuple, found.tolist()))}
        for step in steps:
            for (x, y, z), i in place.items():
                j = place.get((x + step[0], y + step[1], z + step[2]))
                if j is not None and (p := root(i)) != (q := root(j)) and near(rows[i], rows[j]):
                    top[max(p, q)] = min(p, q)
        order = pc.sort_indices(names).to_numpy()
        rank = np.empty(len(names), np.int64)
        rank[order] = np.arange(len(names))
        label = np.array([root(i) for i in range(len(found))])[own]
        least = np.full(len(found), len(names))
        np.minimum.at(least, label, rank[node])
        told = np.empty(len(names), np.int64)
        told[node] = order[least[label]]
        return pa.RecordBatch.from_arrays([t[by].combine_chunks().slice(0, 1).take(pa.array(np.zeros(len(names), np.int64))), names, names.take(pa.array(told))], [by, key, "root"])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        runs = pc.run_end_encode(batch.column(by))
        begin = 0
        for end in runs.run_ends.to_pylist():
            if held and held[-1].column(by)[0] != batch.column(by)[begin]:
                yield solved(pa.Table.from_batches(held))
                held = []
            held.append(batch.slice(begin, end - begin))
            begin = end
    if held:
        yield solved(pa.Table.from_batches(held))


def close_groups(matches: DataFrame, by: str, key: str, radius_arcsec: float, few: int = FEW) -> DataFrame:
    """group_labels of pair_edges, without all pairs for targets of up to few detections whose errors are within the radius; the others go by pairs."""
    rows = matches.select(by, key, "ra", "dec", F.coalesce(exprs.finite_or_null(F.col("error_arcsec").cast("double")), F.lit(0.0)).alias("error_arcsec"))
    rows = cut(rows, "detections")
    by_pairs = cut(rows.groupBy(by).agg(F.count("*").alias("n"), F.max("error_arcsec").alias("e")).where((F.col("n") > few) | (F.col("e") > radius_arcsec)).select(by), "by_pairs")
    kind = ", ".join(f"`{n}` {rows.schema[c].dataType.simpleString()}" for n, c in ((by, by), (key, key), ("root", key)))
    found = spread(rows.join(by_pairs, by, "left_anti"), by).sortWithinPartitions(by).mapInArrow(lambda b: _linked(b, by, key, radius_arcsec), kind)
    if by_pairs.isEmpty():
        return found
    rest = rows.join(by_pairs, by, "left_semi")
    return found.unionByName(group_labels(rest, pair_edges(rest, by, key, radius_arcsec), by, key, few))


def passed_labels(nodes: DataFrame, edges: DataFrame, by: str, key: str) -> DataFrame:
    """group_labels in rounds, lineage being cut after each; every neighbour's and label's label is heard."""
    both = edges.select(by, "a", "b").unionByName(edges.select(by, F.col("b").alias("a"), F.col("a").alias("b")))
    both = cut(both.distinct(), "edges")
    labels = cut(nodes.select(by, key).distinct().withColumn("root", F.col(key)), "labels")
    while True:
        heard = both.join(labels.select(by, F.col(key).alias("b"), "root"), [by, "b"]).groupBy(by, F.col("a").alias(key)).agg(F.min("root").alias("heard"))
        new = labels.join(heard, [by, key], "left").select(by, key, F.least("root", F.coalesce("heard", "root")).alias("new"), F.col("root").alias("old"))
        jump = new.select(by, F.col(key).alias("new"), F.col("new").alias("further"))
        new = cut(new.join(jump, [by, "new"], "left").select(by, key, F.least("new", F.coalesce("further", "new")).alias("root"), "old"), "labels")
        labels = new.select(by, key, "root")
        if new.where("root <> old").isEmpty():
            return labels


#: Halvings of the circle that the finest cells of polygons come from.
FINEST = 20


#: Pairs of a point and a polygon that are looked at together.
PAIRS = 1 << 18


def _crossed(ra: np.ndarray, dec: np.ndarray, corners: np.ndarray) -> np.ndarray:
    """exprs.inside_polygon for points (rows) and polygons (columns) of as many corners(ra, dec), by the same steps of arithmetic."""

    def x(v: np.ndarray) -> np.ndarray:
        t = v[None, :] - ra[:, None] + 180.0 + 720.0
        if t.size and t.min() >= 720.0 and t.max() < 1080.0:
            return t - 720.0 - 180.0  # as exact as the remainder
        t = np.fmod(t, 360.0)
        return np.where(t < 0, np.fmod(t + 360.0, 360.0), t) - 180.0

    odd = np.zeros((len(ra), len(corners)), bool)
    d = dec[:, None]
    for i in range(corners.shape[1]):
        j = (i + 1) % corners.shape[1]
        (ax, ay), (bx, by) = corners[:, i].T, corners[:, j].T
        crosses = (ay[None, :] > d) != (by[None, :] > d)
        if crosses.any():
            with np.errstate(all="ignore"):
                a = x(ax)
                at = a + (d - ay[None, :]) * (x(bx) - a) / (by - ay)[None, :]
            odd ^= crosses & (at > 0)
    return odd


def _held_points(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[pa.RecordBatch]:
    """Points and the polygons that they lie in, out of rows sorted by cell and side; a cell's polygons (side 0) are held, its points come by."""
    cell, held, shapes = None, [], None

    def shaped() -> list[tuple[pa.Array, np.ndarray]]:
        """The cell's polygons by their number of corners."""
        ids = pa.concat_arrays([b.column("polygon_id") for b in held])
        v = pa.concat_arrays([b.column("vertices") for b in held])
        size, flat = np.diff(v.offsets.to_numpy()), v.flatten()
        corner = np.stack([flat.field(c).to_numpy(zero_copy_only=False) for c in ("ra", "dec")], 1)
        begin, told = np.cumsum(size) - size, []
        for n in np.unique(size).tolist():
            own = np.flatnonzero(size == n)
            told.append((ids.take(pa.array(own)), corner[begin[own][:, None] + np.arange(n)]))
        return told

    for batch in batches:
        keys = np.stack([batch.column(c).to_numpy() for c in ("__level", "__i", "__j", "side")], 1)
        ends = [*(np.flatnonzero((np.diff(keys, axis=0) != 0).any(1)) + 1).tolist(), len(keys)]
        begin = 0
        for end in ends:
            if end == begin:
                continue
            part, own, side = batch.slice(begin, end - begin), tuple(keys[begin, :3].tolist()), keys[begin, 3]
            begin = end
            if own != cell:
                cell, held, shapes = own, [], None
            if side == 0:
                held.append(part)
            elif held:
                shapes = shapes or shaped()
                ra, dec = part.column("ra").to_numpy(), part.column("dec").to_numpy()
                rows = part.column("row")
                for ids, corners in shapes:
                    for p in range(0, len(ids), PAIRS):
                        some = corners[p : p + PAIRS]
                        step = max(1, PAIRS // len(some))
                        for k in range(0, len(ra), step):
                            at, of = np.nonzero(_crossed(ra[k : k + step], dec[k : k + step], some))
                            if len(at):
                                found = rows.take(pa.array(at + k))
                                yield pa.RecordBatch.from_arrays([*(found.field(i) for i in range(len(columns))), ids.take(pa.array(of + p))], [*columns, "polygon_id"])


def in_polygons(points: DataFrame, polygons: DataFrame, position=("ra", "dec")) -> DataFrame:
    """points with the polygon_id of each of polygons(polygon_id, vertices: array of ra, dec) that they lie in.

    Polygons are held in cells a quarter of their size or less, some dozens each, by octaves of their extent; a point is in one
    cell of each octave that there is. Tasks hold the polygons of a cell and count its points against their edges.
    Polygons of fewer than three corners, or with one that isn't on the sky, hold nothing. One that spans half the
    circle or more is held in all cells of its declinations.
    """
    v, first = F.col("vertices"), F.get("vertices", 0)
    points_columns = list(points.columns)
    sound = (F.size(v) >= 3) & F.forall(v, lambda x: exprs.valid_position(x["ra"].cast("double"), x["dec"].cast("double")))
    shift = F.transform(v, lambda x: F.pmod(x["ra"] - first["ra"] + 180.0, F.lit(360.0)) - 180.0)
    p = polygons.where(F.coalesce(sound, F.lit(False))).withColumns({"__a": F.array_min(shift), "__b": F.array_max(shift), "__c": F.array_min(F.transform(v, lambda x: x["dec"])), "__d": F.array_max(F.transform(v, lambda x: x["dec"]))})
    wide = F.col("__b") - F.col("__a") >= 180.0
    extent = F.when(wide, 360.0).otherwise(F.greatest(F.col("__b") - F.col("__a"), F.col("__d") - F.col("__c"), F.lit(360.0 / 2**FINEST)))
    p = p.withColumn("__level", F.least(F.floor(F.log2(360.0 / extent)) + 2, F.lit(FINEST)).cast("int")).withColumn("__edge", 360.0 / F.pow(F.lit(2.0), "__level"))
    # a ray also meets edges on the other side of the sky, where right ascensions are cut: as the expression has it
    spans = F.when(wide, F.array(F.struct(F.lit(0.0).alias("a"), F.lit(359.999999).alias("b")))).otherwise(F.array(*(F.struct((first["ra"] + F.col("__a") + turn).alias("a"), (first["ra"] + F.col("__b") + turn).alias("b")) for turn in (0.0, 180.0))))
    n = F.pow(F.lit(2.0), "__level").cast("long")
    across = F.array_distinct(F.flatten(F.transform(spans, lambda s: F.transform(F.sequence(F.floor(s["a"] / F.col("__edge") - 1e-9), F.floor(s["b"] / F.col("__edge") + 1e-9)), lambda i: F.pmod(i, n)))))
    along = F.sequence(F.floor((F.col("__c") + 90) / F.col("__edge")), F.floor((F.col("__d") + 90) / F.col("__edge")))
    held = cut(p.select("polygon_id", v.cast("array<struct<ra:double,dec:double>>").alias("vertices"), F.col("__level"), F.explode(across).alias("__i"), along.alias("__js")).select("polygon_id", "vertices", "__level", "__i", F.explode("__js").alias("__j")), "polygons")
    levels = sorted(r[0] for r in held.select("__level").distinct().collect())  # FINEST + 1 at most
    ra, dec = F.col(position[0]).cast("double"), F.col(position[1]).cast("double")
    edge = 360.0 / F.pow(F.lit(2.0), "__level")
    placed = points.where(exprs.valid_position(ra, dec)).select(ra.alias("ra"), dec.alias("dec"), F.struct(*points.columns).alias("row")).withColumn("__level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>")))
    placed = placed.withColumns({"__i": F.pmod(F.floor(exprs.normalized_ra(F.col("ra")) / edge), F.pow(F.lit(2.0), "__level").cast("long")), "__j": F.floor((F.col("dec") + 90) / edge)})
    placed = placed.join(held.select("__level", "__i", "__j").distinct(), ["__level", "__i", "__j"], "left_semi").withColumn("side", F.lit(1))
    met = spread(held.withColumn("side", F.lit(0)).unionByName(placed, allowMissingColumns=True), "__level", "__i", "__j").sortWithinPartitions("__level", "__i", "__j", "side")
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in (*points.schema, held.schema["polygon_id"]))
    return met.mapInArrow(lambda b: _held_points(b, points_columns), kind)
