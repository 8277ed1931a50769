"""The canonical store: objects with their members, kept as versions of bucketed tables.

Three tables hold what a round of arrivals asks for: members by object, keys (catalog and source) and places
by cells of the sky. Each is a log of deltas, one for each version, dealt into buckets; a row of a later delta
stands for an earlier one with its key. An upsert reads the buckets that its arrivals touch, writes one delta of
each table with the rows that changed, and commits by putting up the next version's manifest. Readers hold on
to the version they began with. Compaction rewrites buckets of many deltas as one.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from orrery.functions import exprs
from orrery.operators import catalogs, fulfilment, spatial
from orrery.operators.store import cut, first_rows
from orrery.sources.tables import filesystem

#: Buckets of each table, and deltas of a bucket beyond which compaction rewrites it.
BUCKETS, MOST_DELTAS = 64, 8
#: Degrees of a declination band of the places; bands are split in right ascension to cells of nearly this size.
CELL = 1.0
_KEY = ["catalog", "source_id"]
_PLACE = "catalog string, source_id string, ra double, dec double, object_id string"


class Conflict(RuntimeError):
    """Another writer has put up the version that this one was to be."""


def hash_bucket(columns: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(buckets)).cast("int")


def _columns_of(band: Column) -> Column:
    """Cells in a declination band: fewer towards the poles."""
    middle = F.radians((band + 0.5) * CELL - 90)
    return F.greatest(F.floor(F.cos(middle) * (360 / CELL)), F.lit(1).cast("long"))


def place_bucket(ra: Column, dec: Column, buckets: int) -> Column:
    band = F.least(F.floor((dec + 90) / CELL), F.lit(int(180 / CELL) - 1).cast("long"))
    n = _columns_of(band)
    return F.pmod(F.xxhash64(band, F.least(F.floor(exprs.normalized_ra(ra) / 360 * n), n - 1)), F.lit(buckets)).cast("int")


def near_buckets(ra: Column, dec: Column, radius_arcsec: float, buckets: int) -> Column:
    """The buckets of all cells that a circle around a place can reach."""
    reach = radius_arcsec / 3600 + 1e-9
    last = int(180 / CELL) - 1
    bands = F.sequence(F.greatest(F.floor((dec - reach + 90) / CELL), F.lit(0).cast("long")), F.least(F.floor((dec + reach + 90) / CELL), F.lit(last).cast("long")))
    edge = F.least(F.abs(dec) + reach, F.lit(90.0))
    # how far the circle reaches in right ascension; all around if it holds a pole
    width = F.when(edge >= 90, 180.0).otherwise(F.degrees(F.asin(F.least(F.lit(1.0), math.sin(math.radians(min(reach, 90.0))) / F.cos(F.radians(F.least(F.abs(dec), F.lit(89.999999999)))))))) + 1e-9

    def cells(band: Column) -> Column:
        n = _columns_of(band)
        low, high = F.floor((ra - width) / 360 * n), F.floor((ra + width) / 360 * n)
        own = F.sequence(low, F.least(high, low + n - 1))
        return F.transform(own, lambda c: F.pmod(F.xxhash64(band, F.pmod(c, n)), F.lit(buckets)).cast("int"))

    return F.array_distinct(F.flatten(F.transform(bands, cells)))


@dataclass
class Manifest:
    """A version: for each table its deltas, as (folder, version, buckets)."""

    version: int = 0
    buckets: int = BUCKETS
    schema: str = ""
    tables: dict[str, list] = field(default_factory=lambda: {"members": [], "keys": [], "places": []})


class ObjectStore:
    """The store under root. Members have object_id, catalog, source_id, ra, dec and what else the first upsert brings."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets

    # --- versions ---

    def version(self) -> int:
        from pyarrow.fs import FileSelector

        fs, root = filesystem(self.root)
        found = fs.get_file_info(FileSelector(f"{root}/versions", allow_not_found=True))
        return max((int(f.base_name[:-5]) for f in found if f.base_name.endswith(".json") and f.base_name[:-5].isdigit()), default=0)

    def manifest(self, version: int | None = None) -> Manifest:
        version = self.version() if version is None else version
        if not version:
            return Manifest(buckets=self.buckets)
        fs, root = filesystem(self.root)
        with fs.open_input_stream(f"{root}/versions/{version:08d}.json") as f:
            return Manifest(**json.loads(f.read()))

    def _commit(self, manifest: Manifest) -> None:
        """Put up the manifest of the next version by a rename; raises Conflict if that is there already."""
        from pyarrow.fs import FileType

        fs, root = filesystem(self.root)
        fs.create_dir(f"{root}/versions", recursive=True)
        name, temporary = f"{root}/versions/{manifest.version:08d}.json", f"{root}/versions/.{uuid.uuid4().hex}"
        if fs.get_file_info(name).type != FileType.NotFound:
            raise Conflict(f"version {manifest.version} is there already")
        with fs.open_output_stream(temporary) as f:
            f.write(json.dumps(manifest.__dict__).encode())
        fs.move(temporary, name)

    def _append(self, manifest: Manifest, table: str, rows: DataFrame) -> None:
        """Write rows(bucket, ...) as the delta of a version; a crowded bucket is several files."""
        from pyarrow.fs import FileSelector

        path = f"{self.root}/{table}/{manifest.version:08d}-{uuid.uuid4().hex[:12]}"
        rows.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(path)
        fs, folder = filesystem(path)
        own = sorted(int(f.base_name.partition("=")[2]) for f in fs.get_file_info(FileSelector(folder)) if f.base_name.startswith("bucket="))
        manifest.tables[table].append([path, manifest.version, own])

    def _read(self, manifest: Manifest, table: str, schema: str, buckets: set[int] | None = None) -> DataFrame:
        """The newest row of each key in some buckets, or in all; files of other buckets are not listed."""
        wanted = lambda own: own if buckets is None else [b for b in own if b in buckets]
        found = None
        for path, version, own in manifest.tables[table]:
            if paths := [f"{path}/bucket={b}" for b in wanted(own)]:
                part = self.spark.read.schema(f"{schema}, bucket int").option("basePath", path).parquet(*paths).withColumn("__version", F.lit(version))
                found = part if found is None else found.unionByName(part)
        if found is None:
            return self.spark.createDataFrame([], StructType.fromDDL(f"{schema}, bucket int"))
        columns = [c for c in found.columns if c not in (*_KEY, "__version")]
        newest = found.groupBy(*_KEY).agg(F.max_by(F.struct(*columns), "__version").alias("row"))
        return newest.select(*_KEY, *(F.col("row").getField(c).alias(c) for c in columns))

    def members(self, version: int | None = None, objects: DataFrame | None = None) -> DataFrame:
        """Members of a version (the newest), of some objects(object_id) if they are named: only their buckets are read."""
        manifest = self.manifest(version)
        if not manifest.schema:
            return self.spark.createDataFrame([], "object_id string, catalog string, source_id string, ra double, dec double")
        some = None if objects is None else self._touched(objects.select(hash_bucket(["object_id"], manifest.buckets).alias("bucket")))
        found = self._read(manifest, "members", manifest.schema, some).drop("bucket")
        return found if objects is None else found.join(objects.select("object_id").distinct(), "object_id", "left_semi")

    @staticmethod
    def _touched(rows: DataFrame) -> set[int]:
        """Buckets of rows(bucket): as many as a table has at most."""
        return {r["bucket"] for r in rows.select("bucket").distinct().collect()}

    # --- writing ---

    def upsert(self, arrivals: DataFrame, radius_arcsec: float = 1.0) -> tuple[int, DataFrame]:
        """The version after arrivals(catalog, source_id, ra, dec, ...), and their catalog, source_id, object_id and outcome.

        Identity is catalogs.resolve_identity's: a stored source keeps its object, another joins the one object
        near it or makes one. A stored source's values stay where the arrival has none; if both name a
        catalog_version and they differ, only the arrival counts. Of rows that repeat a source one arrives, the
        first by their other values. Without rows there is no new version.
        """
        before = self.manifest()
        columns = [c for c in arrivals.columns if c != "object_id"]
        rest = [c for c in columns if c not in _KEY]
        rows = arrivals.select(*(F.col(c).cast("string").alias(c) if c in _KEY else F.col(c) for c in columns))
        rows = cut(catalogs.first_by(rows, _KEY, [F.xxhash64(*rest), F.to_json(F.struct(*rest))]), "arrivals")
        if rows.isEmpty():
            return before.version, self.spark.createDataFrame([], "catalog string, source_id string, object_id string, outcome string")
        schema = before.schema or ", ".join(["object_id string", *(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)])
        known = self._around(before, rows, radius_arcsec)
        told = cut(catalogs.resolve_identity(rows.select(*_KEY, "ra", "dec", F.concat_ws("\x1f", *_KEY).alias("arrival")), known, radius_arcsec), "identity")
        arrived = rows.join(told.select(*_KEY, "object_id"), _KEY)
        buckets = self._touched(arrived.select(hash_bucket(["object_id"], before.buckets).alias("bucket")))
        merged = cut(self._merged(arrived, self._read(before, "members", schema, buckets) if before.schema else None, schema), "merged")
        after = Manifest(before.version + 1, before.buckets, schema, {t: list(d) for t, d in before.tables.items()})
        self._append(after, "members", merged.withColumn("bucket", hash_bucket(["object_id"], after.buckets)))
        places = merged.select(*_KEY, "ra", "dec", "object_id")
        self._append(after, "keys", places.withColumn("bucket", hash_bucket(_KEY, after.buckets)))
        self._append(after, "places", places.withColumn("bucket", place_bucket(F.col("ra"), F.col("dec"), after.buckets)))
        self._commit(after)
        return after.version, told

    def _around(self, manifest: Manifest, rows: DataFrame, radius_arcsec: float) -> DataFrame:
        """What the store knows that the identity of rows depends on: their own keys, sources near them, and what their objects hold."""
        keys = self._read(manifest, "keys", _PLACE, self._touched(rows.select(hash_bucket(_KEY, manifest.buckets).alias("bucket"))))
        own = keys.join(rows.select(*_KEY), _KEY, "left_semi")
        ok = exprs.valid_position(F.col("ra"), F.col("dec"))
        reach = rows.where(ok).select(F.explode(near_buckets(exprs.normalized_ra(F.col("ra")), F.col("dec"), radius_arcsec, manifest.buckets)).alias("bucket"))
        near = self._read(manifest, "places", _PLACE, self._touched(reach))
        spots = rows.where(ok).select(F.col("ra").alias("t_ra"), F.col("dec").alias("t_dec"))
        near = cut(spatial.cone_join(spots, near, radius_arcsec).select(*near.columns).distinct(), "near")
        objects = near.select("object_id").distinct()
        held = self._read(manifest, "members", _PLACE, self._touched(objects.select(hash_bucket(["object_id"], manifest.buckets).alias("bucket")))) if manifest.schema else near
        held = held.join(objects, "object_id", "left_semi")
        told = [x.select(*_KEY, "ra", "dec", "object_id") for x in (own, near, held)]
        return cut(told[0].unionByName(told[1]).unionByName(told[2]).dropDuplicates(_KEY), "known")

    @staticmethod
    def _merged(arrived: DataFrame, stored: DataFrame | None, schema: str) -> DataFrame:
        kinds = StructType.fromDDL(schema)
        if stored is None:
            return arrived.select(*kinds.names)
        old = stored.select(*_KEY, F.struct(*(c for c in kinds.names if c not in _KEY)).alias("old"))
        both = arrived.join(old, _KEY, "left")
        same = F.lit(True)
        if "catalog_version" in arrived.columns and "catalog_version" in kinds.names:
            same = F.col("catalog_version").eqNullSafe(F.col("old.catalog_version"))

        def kept(f) -> Column:
            if f.name in (*_KEY, "object_id"):
                return F.col(f.name)
            older = F.when(same, F.col("old").getField(f.name))
            return F.when(exprs.present(F.col(f.name), f.dataType), F.col(f.name)).otherwise(older).alias(f.name) if f.name in arrived.columns else older.alias(f.name)

        return both.select(*map(kept, kinds))

    def compact(self, most: int = MOST_DELTAS) -> int:
        """Rewrite buckets of more than most deltas as one; the version after it (the same if there are none). Older versions stay readable."""
        before = self.manifest()
        after = Manifest(before.version + 1, before.buckets, before.schema, {})
        changed = False
        for table, deltas in before.tables.items():
            counts: dict[int, int] = {}
            for _, _, own in deltas:
                for b in own:
                    counts[b] = counts.get(b, 0) + 1
            full = {b for b, n in counts.items() if n > most}
            after.tables[table] = [[p, v, [b for b in own if b not in full]] for p, v, own in deltas]
            after.tables[table] = [d for d in after.tables[table] if d[2]]
            if full:
                changed = True
                self._append(after, table, self._read(before, table, before.schema if table == "members" else _PLACE, full))
        if not changed:
            return before.version
        self._commit(after)
        return after.version


@dataclass
class Coverage:
    """How far a store covers a request, by bucket: totals, and the folders that tell of its objects."""

    totals: dict[int, tuple[int, int]] = field(default_factory=dict)
    deltas: list[tuple[str, list[int]]] = field(default_factory=list)

    def state(self, count: int) -> dict[str, int]:
        usable, matching = sum(u for u, _ in self.totals.values()), sum(m for _, m in self.totals.values())
        return {"usable": usable, "matching": matching, "missing": max(0, count - usable)}


Fetch = Callable[[DataFrame, int], DataFrame]


def fulfil(store: ObjectStore, request: fulfilment.Request, fetch: Fetch, targets: DataFrame | None = None, radius_arcsec: float = 1.0, rounds: int = fulfilment.ROUNDS, gaps: int = fulfilment.GAPS) -> tuple[DataFrame, dict]:
    """Fetch into the store until it covers the request, nothing more comes, or rounds run out; then the request's objects.

    fetch(objects, round) gives rows for objects(object_id), the first gaps of those that lack something and have
    not been asked for, or new ones. Coverage is counted anew only for buckets that a round's rows touch; by
    bucket there are two totals on the driver, ids stay in tables.
    Objects that were usable at the start come first in the result, then by id.
    """
    spark, root = store.spark, f"{store.root}/coverage-{uuid.uuid4().hex}"
    now, asked = Coverage(), []

    def covered(buckets: set[int] | None) -> DataFrame:
        manifest = store.manifest()
        rows = store._read(manifest, "members", manifest.schema, buckets).drop("bucket") if manifest.schema else store.members()
        return fulfilment.coverage(rows, request, targets).select("object_id", "usable", hash_bucket(["object_id"], store.buckets).alias("bucket"))

    def counted(buckets: set[int] | None) -> None:
        """Coverage of some buckets, written beside the older and told by bucket."""
        path = f"{root}/{len(now.deltas):06d}"
        covered(buckets).hint("rebalance", "bucket").write.partitionBy("bucket").parquet(path)
        own = set(range(store.buckets)) if buckets is None else buckets
        for b in own:
            now.totals.pop(b, None)
        rows = spark.read.schema("object_id string, usable boolean, bucket int").parquet(path)
        for r in rows.groupBy("bucket").agg(F.count_if("usable").alias("u"), F.count("*").alias("m")).collect():  # one row a bucket
            now.totals[r["bucket"]] = (r["u"], r["m"])
        for i, (old, held) in enumerate(now.deltas):
            now.deltas[i] = (old, [b for b in held if b not in own])
        now.deltas.append((path, [b for b in own if b in now.totals]))

    def recorded() -> DataFrame:
        found = None
        for path, held in now.deltas:
            if paths := [f"{path}/bucket={b}" for b in held]:
                part = spark.read.schema("object_id string, usable boolean, bucket int").option("basePath", path).parquet(*paths)
                found = part if found is None else found.unionByName(part)
        return spark.createDataFrame([], "object_id string, usable boolean, bucket int") if found is None else found

    def lacking() -> DataFrame:
        """The first ids that lack something and have not been asked for."""
        rows = recorded().where("not usable").select("object_id")
        if asked:
            rows = rows.join(spark.read.schema("object_id string").parquet(*asked), "object_id", "left_anti")
        path = f"{root}/asked-{len(asked):06d}"
        first_rows(rows, gaps, [F.col("object_id")]).write.parquet(path)
        asked.append(path)
        return spark.read.schema("object_id string").parquet(path)

    counted(None)
    started = list(now.deltas)
    stuck, last, received, turn = 0, None, 0, 0
    reason = "round_limit"
    for turn in range(rounds):
        state = now.state(request.count)
        if not state["missing"]:
            reason = "coverage_satisfied"
            break
        told = (state["usable"], state["matching"])
        stuck, last = stuck + 1 if told == last else 0, told
        if stuck >= fulfilment.STUCK:
            reason = "no_usable_progress"
            break
        rows = cut(fetch(lacking(), turn), "fetched")
        n = rows.count()
        if not n:
            reason = "no_more_rows"
            break
        received += n
        _, identity = store.upsert(rows, radius_arcsec)
        counted(store._touched(identity.select(hash_bucket(["object_id"], store.buckets).alias("bucket"))))
    else:
        turn += 1
    state = now.state(request.count)
    begin = Coverage(deltas=started)
    before = spark.read.schema("object_id string, usable boolean, bucket int").parquet(begin.deltas[0][0]).where("usable").select("object_id")
    chosen = fulfilment.chosen_objects(recorded().select("object_id", "usable"), before, request.count)
    return chosen, state | {"status": "completed" if not state["missing"] else "partial", "reason": reason if state["missing"] else "coverage_satisfied", "rounds": turn, "received": received}
