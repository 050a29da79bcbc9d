"""Units, signs and baselines: conversions, column metadata, and checks."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import constants as C
from .scalars import col

#: unit -> (dimension, factor to the base unit); temperatures are affine.
REGISTRY = {
    "m": ("length", 1.0), "mm": ("length", 0.001), "cm": ("length", 0.01), "ft": ("length", 0.3048), "in": ("length", 0.0254),
    "degC": ("temperature", None), "degF": ("temperature", None), "K": ("temperature", None),
    "yr": ("time", 1.0), "day": ("time", 1 / 365.25), "month": ("time", 1 / 12), "s": ("time", 1 / 31_557_600.0),
}
STANDARD = {"length": "m", "temperature": "degC", "time": "yr"}
#: Parts of column names that mark a difference or an error rather than a value.
DELTA_PARTS = ("sigma", "unc", "_se", "_sd", "lower", "upper", "_p05", "_p17", "_p83", "_p95")


def gt_to_m(c: Column | str) -> Column:
    return col(c) * C.GT_TO_M


def m_to_mm(c: Column | str) -> Column:
    return col(c) * 1000.0


def mm_to_m(c: Column | str) -> Column:
    return col(c) / 1000.0


def is_delta(name: str) -> bool:
    """Whether a column holds differences by its name; an explicit role is better where there is one."""
    return any(p in name.lower() for p in DELTA_PARTS)


def dimension(unit: str) -> str:
    """Dimension of a unit; of a compound ``a/b/...`` that of its first part over the others'."""
    parts = unit.split("/")
    for p in parts:
        if p not in REGISTRY:
            raise ValueError(f"unknown unit {p!r}")
    return "/".join(REGISTRY[p][0] for p in parts)


def standard_unit(unit: str) -> str:
    return "/".join(STANDARD[d] for d in dimension(unit).split("/"))


def _scale(unit: str) -> float:
    """Factor of a unit's differences to its standard."""
    return {"degC": 1.0, "K": 1.0, "degF": 5 / 9}.get(unit) or REGISTRY[unit][1]


def convert(c: Column | str, source: str, target: str, delta: bool = False) -> Column:
    """A column from one unit to another; differences of temperatures are only scaled."""
    if dimension(source) != dimension(target):
        raise ValueError(f"{source} cannot become {target}")
    c = col(c)
    if "/" not in source and dimension(source) == "temperature" and not delta:
        celsius = {"degC": c, "K": c - 273.15, "degF": (c - 32) * (5 / 9)}[source]
        return {"degC": celsius, "K": celsius + 273.15, "degF": celsius * 1.8 + 32}[target]
    factor = 1.0
    for i, (a, b) in enumerate(zip(source.split("/"), target.split("/"), strict=True)):
        f = _scale(a) / _scale(b)
        factor = factor * f if i == 0 else factor / f
    return c * factor


def tag(df: DataFrame, column: str, **facts: str | float) -> DataFrame:
    """Facts about a column (unit, sign, baseline, source) in its metadata."""
    if facts.get("sign", "slr") not in C.SIGN_TAGS:
        raise ValueError(f"sign must be one of {C.SIGN_TAGS}")
    return df.withMetadata(column, {**df.schema[column].metadata, **facts})


def facts(df: DataFrame, column: str) -> dict:
    return dict(df.schema[column].metadata)


def convert_columns(df: DataFrame, targets: Mapping[str, str] | None = None) -> DataFrame:
    """Every column tagged with a unit to its standard unit, or to ``targets[column]`` or ``targets['_all']``.

    '_all' applies to the columns of its own dimension. Converting twice changes nothing.
    """
    out = []
    for name in df.columns:
        unit = df.schema[name].metadata.get("unit")
        want = None
        if unit:
            want = standard_unit(unit) if targets is None else targets.get(name)
            every = (targets or {}).get("_all")
            if want is None and every and dimension(every).split("/")[0] == dimension(unit).split("/")[0]:
                want = "/".join([every, *unit.split("/")[1:]])
        if want and want != unit:
            out.append(convert(F.col(name), unit, want, is_delta(name)).alias(name, metadata={**df.schema[name].metadata, "unit": want}))
        else:
            out.append(F.col(name))
    return df.select(*out)


def check_levels(df: DataFrame, column: str, most: float = C.MAX_ABS_LEVEL_M) -> DataFrame:
    """``df``, or an error if a finite value exceeds ``most``: it is not in metres. An empty column passes."""
    finite = F.when(~F.isnan(column) & (F.abs(column) != float("inf")), F.abs(column))
    high = df.agg(F.max(finite)).first()[0]
    if high is not None and high > most:
        raise ValueError(f"{column} reaches {high}: not metres")
    return df


def check_sigma(df: DataFrame, column: str) -> DataFrame:
    """``df``, or an error if a value is negative."""
    if df.agg(F.count_if((F.col(column) < 0) & ~F.isnan(column))).first()[0]:
        raise ValueError(f"{column} holds negative errors")
    return df


def check_sign(df: DataFrame, column: str, sign: str = "slr") -> DataFrame:
    """``df``, or an error if the column is tagged with another sign convention."""
    if df.schema[column].metadata.get("sign", sign) != sign:
        raise ValueError(f"{column} follows {df.schema[column].metadata['sign']}, not {sign}")
    return df
