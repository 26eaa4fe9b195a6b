"""Roll-ups over the zones of datasets and their string-to-string aux maps.

``zones``: dataset, zone_id, name, zone_type, sizes and aux. A zone repeated under its key counts once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scalarscape.operators.windows import running_number
from scalarscape.functions.naming import six_digits

SPHERE, BASIN_SPHERE, BASIN_SURFACE = "AtomSphereData", "CondensedBasinSphere", "CondensedBasinSurface"


def aux(key: str) -> Column:
    return F.col("aux")[key]


def distinct_zones(zones: DataFrame) -> DataFrame:
    """One row for each (dataset, zone_id): the greatest of differing repeats by name and sizes."""
    rest = F.struct("name", "zone_type", "imax", "jmax", "kmax", F.to_json("aux").alias("aux"))
    once = zones.where("dataset is not null and zone_id is not null").groupBy("dataset", "zone_id").agg(F.max(rest).alias("z"))
    return once.select("dataset", "zone_id", "z.name", "z.zone_type", "z.imax", "z.jmax", "z.kmax", F.from_json("z.aux", "map<string,string>").alias("aux"))


def atom_number(key: Column) -> Column:
    """The atom's number; 1 where it is no whole number."""
    return F.coalesce(F.trim(key).try_cast("int"), F.lit(1))


def aux_radius(key: Column) -> Column:
    """A radius above 0, else null."""
    r = F.trim(key).try_cast("double")
    return F.when((r > 0) & ~F.isnan(r), r)


def atom_spheres(zones: DataFrame) -> DataFrame:
    """(dataset, atom_number, zone_id, symbol, radius, n_vertices, n_triangles): the first sphere zone of each atom."""
    spheres = zones.where(aux("ZoneType") == SPHERE).select(
        "dataset", atom_number(aux("AtomNumber")).alias("atom_number"), "zone_id", aux("AtomType").alias("symbol"),
        aux_radius(aux("SphereRadius")).alias("radius"), F.col("imax").alias("n_vertices"), F.col("jmax").alias("n_triangles"),
    )
    state = F.struct("zone_id", "symbol", "radius", "n_vertices", "n_triangles")
    return spheres.groupBy("dataset", "atom_number").agg(F.min_by(state, "zone_id").alias("s")).select("dataset", "atom_number", "s.*")


def zone_rollup(zones: DataFrame) -> DataFrame:
    """(dataset, zone_type, zone_class, n_zones, n_points): classes by aux ZoneType, one-dimensional zones and volumes by shape."""
    line = (F.col("zone_type") == "ORDERED") & (F.coalesce("jmax", F.lit(1)) == 1) & (F.coalesce("kmax", F.lit(1)) == 1)
    kind = F.coalesce(aux("ZoneType"), F.when(line, "line").when(F.col("zone_type") == "ORDERED", "volume").otherwise("surface"))
    points = F.when(F.col("zone_type") == "ORDERED", F.col("imax").cast("bigint") * F.coalesce("jmax", F.lit(1)) * F.coalesce("kmax", F.lit(1))).otherwise(F.col("imax"))
    return zones.groupBy("dataset", "zone_type", kind.alias("zone_class")).agg(F.count(F.lit(1)).alias("n_zones"), F.sum(points).alias("n_points"))


def formulas(zones: DataFrame) -> DataFrame:
    """(dataset, formula): elements of the atoms that have a sphere, C first, H second, then by symbol; a count of 1 is not shown."""
    counts = atom_spheres(zones).where("symbol is not null").groupBy("dataset", "symbol").agg(F.count(F.lit(1)).alias("n"))
    rank = F.when(F.col("symbol") == "C", 0).when(F.col("symbol") == "H", 1).otherwise(2)
    part = F.struct(rank.alias("r"), F.col("symbol"), F.concat("symbol", F.when(F.col("n") > 1, F.col("n").cast("string")).otherwise("")).alias("t"))
    listed = counts.groupBy("dataset").agg(F.array_sort(F.collect_list(part)).alias("p"))  # one entry for each element
    return listed.select("dataset", F.array_join(F.transform("p", lambda x: x["t"]), "").alias("formula"))


def integrated_totals(zones: DataFrame) -> DataFrame:
    """(dataset, zone_id, pos, name, value, shown): the comma lists of names and totals side by side, as far as the shorter one goes."""
    names, totals = F.split(aux("IntegratedFunctionNames"), ","), F.split(aux("IntegratedFunctionTotals"), ",")
    n = F.least(F.size(names), F.size(totals))
    both = zones.where(names.isNotNull() & totals.isNotNull()).select(
        "dataset", "zone_id", F.posexplode(F.slice(F.arrays_zip(names.alias("name"), totals.alias("total")), F.lit(1), n)).alias("pos", "e")
    )
    value = F.trim("e.total").try_cast("double")
    return both.select("dataset", "zone_id", "pos", F.trim("e.name").alias("name"), value.alias("value"), six_digits(value).alias("shown"))


def field_inventory(zones: DataFrame) -> DataFrame:
    """(dataset, name, n_zones, first_zone) of the integrated functions of each dataset."""
    return integrated_totals(zones).groupBy("dataset", "name").agg(F.count(F.lit(1)).alias("n_zones"), F.min("zone_id").alias("first_zone"))


def basin_links(zones: DataFrame) -> DataFrame:
    """(dataset, sphere_zone, surface_zone): each basin's patch on the sphere with the first surface of the same atom, index and region."""
    basin = lambda kind, out: zones.where(aux("ZoneType") == kind).select(
        "dataset", atom_number(aux("AtomNumber")).alias("atom"), aux("BasinIndex").alias("basin"), aux("RegionType").alias("region"), F.col("zone_id").alias(out)
    ).where("basin is not null and region is not null")
    keys = ["dataset", "atom", "basin", "region"]
    surfaces = basin(BASIN_SURFACE, "surface_zone").groupBy(*keys).agg(F.min("surface_zone").alias("surface_zone"))
    return basin(BASIN_SPHERE, "sphere_zone").join(surfaces, keys, "left").select("dataset", "sphere_zone", "surface_zone")


def numbered(zones: DataFrame) -> DataFrame:
    """(dataset, zone_id, number): running number of the zones of one class within a dataset, by zone_id."""
    kind = F.coalesce(aux("ZoneType"), F.col("zone_type"))
    return running_number(zones.select("dataset", "zone_id", kind.alias("zone_class")), ["dataset", "zone_class"], ["zone_id"], "number")
