"""Feature attributes held as ``map<string,string>``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import finite
from .text import repair_text

# Attribute names in order of preference, and names that the map payload uses itself.
ID_KEYS = ("feature_id", "station_id", "region_id", "id", "code", "gid", "fid", "name")
REDUNDANT_ID_KEYS = ("feature_id", "station_id", "region_id", "id")
NAME_KEYS = (
    "Mah_Name", "mah_name", "station_name", "shapeName", "shape_name", "admin_name", "ADM_NAME", "NAME_FA",
    "Name_FA", "NAME_1", "NAME_2", "NAME_3", "NAME", "Name", "name", "title",
)
RESERVED_KEYS = (
    "id", "feature_id", "station_id", "region_id", "value", "has_value", "severity", "trend", "attrs", "geometry",
)


QUOTED_OR_BARE = r'"(?:[^"\\]|\\.)*+"|[^"]+|"'
NOT_A_NUMBER = r"-?\b(?:NaN|Infinity)\b"


def attribute(props: Column, key: str) -> Column:
    """One attribute, with empty text read as absent."""
    return F.nullif(F.try_element_at(props, F.lit(key)), F.lit(""))


def feature_id(props: Column, hint: str | None, own_id: Column) -> Column:
    """The first non-empty id attribute, else the feature's own id, else null."""
    keys = ([hint] if hint else []) + list(ID_KEYS)
    return F.coalesce(*[attribute(props, k) for k in keys], F.nullif(own_id, F.lit("")))


def without_ids(props: Column) -> Column:
    return F.map_filter(props, lambda k, _: ~k.isin(*REDUNDANT_ID_KEYS))


def display_name(props: Column, fid: Column) -> Column:
    """A readable name that differs from the id; the id when there is none."""
    preferred = [F.when(attribute(props, k) != fid, attribute(props, k)) for k in NAME_KEYS]
    others = F.filter(
        F.map_entries(props),
        lambda e: F.lower(e["key"]).endswith("name") & (F.coalesce(e["value"], F.lit("")) != "") & (e["value"] != fid),
    )
    return F.coalesce(*preferred, F.get(others, F.lit(0))["value"], fid)


def map_attributes(props: Column, most: int | None = None, longest: int | None = None) -> Column:
    """Attributes for map features, without blanks and reserved keys.

    All are kept in full unless ``most`` bounds their number or ``longest`` the characters of a text.
    """
    kept = F.map_filter(
        props, lambda k, v: v.isNotNull() & (v != "") & ~F.lower(k).isin(*RESERVED_KEYS)
    )

    def shown(_k: Column, v: Column) -> Column:
        fixed = repair_text(v)
        if longest is None:
            return fixed
        return F.when(F.length(fixed) > longest, F.concat(F.substring(fixed, 1, longest - 1), F.lit("…"))).otherwise(fixed)

    if most is not None:
        kept = F.map_from_entries(F.slice(F.map_entries(kept), 1, most))
    return F.transform_values(kept, shown)


def province(props: Column) -> Column:
    return F.coalesce(attribute(props, "Province"), attribute(props, "province"), attribute(props, "os_moteval"))


def country(props: Column) -> Column:
    return F.coalesce(attribute(props, "Country"), attribute(props, "country"))


def typed_attributes(text: Column) -> Column:
    """Nested attributes as a variant; numbers that JSON does not have (NaN, infinities) become null, wherever they stand.

    Texts in quotes are left as they are. What is no JSON is null.
    """
    pieces = F.regexp_extract_all(text, F.lit(QUOTED_OR_BARE), F.lit(0))
    bare = lambda piece: F.regexp_replace(piece, NOT_A_NUMBER, "null")
    cleaned = F.array_join(F.transform(pieces, lambda p: F.when(p.startswith('"'), p).otherwise(bare(p))), "")
    return F.try_parse_json(F.when(text.rlike("NaN|Infinity"), cleaned).otherwise(text))


def typed_attribute(attributes: Column, path: str, kind: str) -> Column:
    """One value of a variant by its path (``$.a.b[0]``) as a type; null if it is absent or of another kind."""
    value = F.try_variant_get(attributes, path, kind)
    return finite(value) if kind in ("double", "float") else value
