"""Tables of quantile cubes, samples, model ensembles and gridded fields, and file catalogues.

The layouts are Parquet (or any table) with one row per cell; nearest quantiles, regions,
masks and unit changes are expressions, so filters reach the scan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as C
from ..operators import aggregate

EXPERIMENT_SCENARIO = {"exp05": "ssp585", "exp06": "ssp585", "exp07": "ssp126", "exp08": "ssp585", "expAE02": "ssp585", "expAE03": "ssp245"}


def catalogue(spark: SparkSession, path: str, pattern: str, names: Sequence[str]) -> DataFrame:
    """Files under a path with the groups of a pattern as columns; files that do not match are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    return files.filter(F.col("path").rlike(pattern)).select("path", "length", *[F.regexp_extract("path", pattern, i + 1).alias(n) for i, n in enumerate(names)])


def missing_files(found: DataFrame, expected: DataFrame) -> DataFrame:
    """Expected names that no file has."""
    return expected.join(found.select(F.element_at(F.split("path", "/"), -1).alias("name")), "name", "left_anti")


def quantile_slices(cube: DataFrame, quantiles: Sequence[float], by: Sequence[str] = ("component", "scenario", "year"), value: str = "value") -> DataFrame:
    """The values of the quantiles nearest to those asked for, as columns q05, q17, ..."""
    out = [F.min_by(value, F.struct(F.abs(F.col("quantile") - q), F.col("quantile"))).alias(f"q{round(q * 100):02d}") for q in quantiles]
    return cube.groupBy(*by).agg(*out)


def quantile_component(cube: DataFrame, by: Sequence[str] = ("component", "scenario", "year")) -> DataFrame:
    """Slices with the mean and population deviation over the quantile axis."""
    stats = cube.groupBy(*by).agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    return quantile_slices(cube, (0.05, 0.17, 0.5, 0.83, 0.95), by).join(stats, list(by))


def nearest_entry(slices: DataFrame, year: float, most: float = 5.0, by: Sequence[str] = ("component", "scenario")) -> DataFrame:
    """The slice of the nearest year, if it is within ``most`` years."""
    near = F.struct(F.abs(F.col("year") - year), F.col("year"))
    rest = [c for c in slices.columns if c not in by]
    out = slices.groupBy(*by).agg(*[F.min_by(c, near).alias(c) for c in rest])
    return out.filter(F.abs(F.col("year") - year) <= most)


def samples_long(wide: DataFrame, sample: str, years: Sequence[str], scale: float = 0.001, keep: Sequence[str] = ()) -> DataFrame:
    """A table of samples by years, to a row per sample and year in metres."""
    long = wide.unpivot([*keep, sample], list(years), "year", "value")
    return long.withColumn("year", F.col("year").cast("int")).withColumn("value", F.col("value") * scale)


def sample_arrays(wide: DataFrame, by: Sequence[str], values: str = "values", years: str = "years") -> DataFrame:
    """Arrays of values on a shared axis of years, to a row per year."""
    return wide.select(*by, F.explode(F.arrays_zip(years, values)).alias("z")).select(*by, F.col(f"z.{years}").alias("year"), F.col(f"z.{values}").alias("value"))


def drawn_samples(samples: DataFrame, n: int, scenarios: dict[str, dict[str, float]] | None = None, stream: str = "draw") -> DataFrame:
    """The same random samples in every scenario, and scenarios mixed of others (name -> {scenario: weight})."""
    from ..operators.mixture import common_draws

    few = common_draws(samples, "sample_id", n, stream=stream)
    out = few
    for name, parts in (scenarios or {}).items():
        w = F.create_map(*[F.lit(x) for kv in parts.items() for x in kv])
        mix = few.filter(F.col("scenario").isin(*parts)).groupBy("sample_id", "year").agg(F.sum(F.col("value") * w[F.col("scenario")]).alias("value"))
        out = out.unionByName(mix.withColumn("scenario", F.lit(name)))
    return out


def ice_volume_level(df: DataFrame, by: Sequence[str], value: str = "ivaf", density: Column | str = "rhoi", t: str = "decimal_year", baseline: float | None = None) -> DataFrame:
    """Level of the loss of ice volume above flotation since the first (or the baseline) year: -(v - v0) rho_i / (rho_w A)."""
    from pyspark.sql import Window

    w = Window.partitionBy(*by)
    order = F.struct(F.lit(0), F.col(t)) if baseline is None else F.struct(F.abs(F.col(t) - baseline), F.col(t))
    first = F.min_by(value, order).over(w)
    rho = F.col(density) if isinstance(density, str) else density
    return df.withColumn("level", -(F.col(value) - first) * rho / (C.SEA_WATER_DENSITY * C.OCEAN_AREA_M2))


def experiment_scenarios(df: DataFrame, experiment: str = "experiment") -> DataFrame:
    """The scenario of each experiment; others are left out."""
    table = F.create_map(*[F.lit(x) for kv in EXPERIMENT_SCENARIO.items() for x in kv])
    return df.withColumn("scenario", table[F.col(experiment)]).filter("scenario is not null")


def model_ensemble_stats(df: DataFrame, models: Sequence[str], t: str, value: str, baseline: float, by: Sequence[str] = ()) -> DataFrame:
    """Quantiles over models, each rebased at the year nearest to ``baseline``."""
    from ..operators.sequence import rebased

    return aggregate.quantile_summary(rebased(df, value, t, baseline, [*by, *models]), value, [*by, t])


def mass_rate(flux: Column | str) -> Column:
    """Kilograms a second to gigatonnes a year."""
    c = F.col(flux) if isinstance(flux, str) else flux
    return c * C.SECONDS_PER_YEAR / 1e12


def box(lat: tuple[float, float], lon: tuple[float, float], lat_col: str = "lat", lon_col: str = "lon") -> Column:
    """Whether a cell lies in a box; longitudes are taken modulo 360 and may wrap."""
    x, a, b = F.pmod(F.col(lon_col), F.lit(360.0)), lon[0] % 360, lon[1] % 360
    inside = x.between(a, b) if a <= b else (x >= a) | (x <= b)
    return F.col(lat_col).between(*lat) & inside


def cell_area(step_lat: float, step_lon: float, lat: str = "lat") -> Column:
    """Square metres of a grid cell."""
    import math

    return C.EARTH_RADIUS_M**2 * math.radians(step_lat) * math.radians(step_lon) * F.cos(F.radians(lat))


def land_temperature(df: DataFrame, lat: tuple[float, float], lon: tuple[float, float], threshold: float = 0.5, ocean: bool = False) -> DataFrame:
    """Area-weighted mean of a box over land cells (or the sea's share of cells), by time."""
    weight = F.col("areal_weight") * ((1 - F.col("land_mask")) if ocean else F.when(F.col("land_mask") >= threshold, F.col("land_mask")).otherwise(0.0))
    return aggregate.weighted_mean(df.filter(box(lat, lon)), "temperature", weight, ["time"])


def storage_mass(df: DataFrame, step: float = 0.5) -> DataFrame:
    """Land water storage in gigatonnes by time, without the ice sheets; the sign of storage is kept."""
    keep = df.filter("not (lat < -60 or (lat > 60 and pmod(lon, 360) between 295 and 350))")
    return aggregate.mass_integral(keep, "lwe_thickness", cell_area(step, step), ["time"], "uncertainty", 1e-14)


def ocean_temperature(df: DataFrame, lat: tuple[float, float], lon: tuple[float, float], depth: tuple[float, float], t: str = "decimal_year", reference: tuple[float, float] | None = (1995, 2006), kelvin: bool = False, offset: float | None = None) -> DataFrame:
    """Depth mean of each cell, cos(latitude)-weighted mean and deviation by time, less the reference period's mean (or ``offset``)."""
    v = F.col("temperature") - 273.15 if kelvin else F.col("temperature")
    cells = df.filter(box(lat, lon) & F.col("depth").between(*depth)).withColumn("temperature", v)
    out = aggregate.two_stage_mean(cells, "temperature", F.cos(F.radians("lat")), ["lat", "lon"], t)
    if offset is not None:
        return out.withColumn("mean", F.col("mean") - offset)
    if reference is None:
        raise ValueError("a reference period or an offset is needed")
    from ..operators.resample import align_to_baseline

    return align_to_baseline(out, "mean", t, *reference)


def optical_depth_field(df: DataFrame, wavelength: float = 525.0) -> DataFrame:
    """cos(latitude)-weighted mean of one wavelength by time."""
    return aggregate.weighted_mean(df.filter(F.col("wavelength") == wavelength), "aod", F.cos(F.radians("lat")), ["time"])


def ensemble_wide(df: DataFrame, t: str, member: str, value: str, members: Sequence[str]) -> DataFrame:
    """One column per member, all times of any of them."""
    return df.groupBy(t).pivot(member, list(members)).agg(F.first(value))
