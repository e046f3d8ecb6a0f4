"""A layer: a DataFrame, the name of its active geometry column, and its coordinate reference system."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType, NumericType, StructType

#: Names by which a binary column is taken for geometry (WKB); fixed values.
GEOMETRY_NAMES = ("geometry", "geom", "the_geom", "wkb_geometry", "geometry_wkb", "wkb")
LON_LAT = "EPSG:4326"
#: Codes that have a transform or mean lon/lat; UTM zones and the listed proj strings come on top.
KNOWN = {"EPSG:4326", "OGC:CRS84", "EPSG:3857", "EPSG:6933", "EPSG:2056", "ESRI:54009"}


@dataclass(frozen=True)
class Layer:
    """Rows with at most one active geometry column (WKB). Operators take layers and return layers."""

    df: DataFrame
    geometry: str | None = None
    crs: str = LON_LAT

    def with_df(self, df: DataFrame) -> Layer:
        """The same layer over other rows; the geometry goes if its column did."""
        kept = self.geometry if self.geometry in df.columns else None
        return replace(self, df=df, geometry=kept)

    @property
    def columns(self) -> list[str]:
        return self.df.columns


def layer(df: DataFrame, geometry: str | None = None, crs: str = LON_LAT) -> Layer:
    """Wrap a DataFrame; without a name the geometry column is found by its type."""
    return Layer(df, geometry or find_geometry(df.schema), known_crs(crs))


def find_geometry(schema: StructType) -> str | None:
    """The column marked as geometry, else the first binary column with one of the usual names, never a name alone."""
    marked = [f.name for f in schema if f.metadata.get("geo")]
    named = [f.name for f in schema if isinstance(f.dataType, BinaryType) and f.name.lower() in GEOMETRY_NAMES]
    return next(iter(marked + named), None)


def known_crs(crs: str | None) -> str:
    """The code in its usual spelling; blank and unknown ones are errors, raised when the plan is built."""
    if not crs or not crs.strip():
        raise ValueError("a coordinate reference system is needed")
    code = crs.strip()
    if code.startswith("+proj="):
        if code.split()[0][6:] not in ("longlat", "aeqd", "moll", "laea", "merc", "utm"):
            raise ValueError(f"unknown coordinate reference system: {crs}")
        return code
    code = code.upper()
    utm = re.fullmatch(r"EPSG:32[67](\d\d)", code)
    if code not in KNOWN and not (utm and 1 <= int(utm[1]) <= 60):
        raise ValueError(f"unknown coordinate reference system: {crs}")
    return code


def is_lon_lat(crs: str) -> bool:
    return crs in ("EPSG:4326", "OGC:CRS84") or crs.startswith("+proj=longlat")


def need_geometry(layer: Layer) -> str:
    if not layer.geometry:
        raise ValueError("the layer has no geometry")
    return layer.geometry


def need_columns(df: DataFrame, names: list[str]) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"no such column: {', '.join(missing)}")


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, NumericType)]


def same_crs(*layers: Layer) -> str:
    found = {x.crs for x in layers}
    if len(found) > 1:
        raise ValueError(f"the inputs have different coordinate reference systems: {', '.join(sorted(found))}")
    return found.pop()


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"
