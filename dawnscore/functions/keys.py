"""Recording names, row keys, label lists and bucket codes."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: layout of a recording name, <prefix>_<Train|Test>_<n>_<site>_<yyyymmdd>_<hhmmss>.
NAME_PATTERN = r"^[A-Za-z0-9]+_(Train|Test)_(\d+)_(S\d+)_(\d{8})_(\d{6})"


def _part(name: Column, group: int, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(name, pattern, group), F.lit(""))


def name_split(name: Column, pattern: str = NAME_PATTERN) -> Column:
    return _part(name, 1, pattern)


def name_site(name: Column, pattern: str = NAME_PATTERN, unknown: str | None = None) -> Column:
    site = _part(name, 3, pattern)
    return site if unknown is None else F.coalesce(site, F.lit(unknown))


def name_timestamp(name: Column, pattern: str = NAME_PATTERN) -> Column:
    return F.try_to_timestamp(F.concat(_part(name, 4, pattern), _part(name, 5, pattern)),
                              F.lit("yyyyMMddHHmmss"))


def name_hour(name: Column, pattern: str = NAME_PATTERN) -> Column:
    return F.coalesce(F.substring(_part(name, 5, pattern), 1, 2).cast("int"), F.lit(-1))


def hms_to_seconds(text: Column) -> Column:
    parts = F.split(text, ":")
    return (parts[0].cast("int") * 3600 + parts[1].cast("int") * 60 + parts[2].cast("int"))


def seconds_to_hms(seconds: Column) -> Column:
    s = seconds.cast("int")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600).cast("int"),
                           F.floor(s % 3600 / 60).cast("int"), s % 60)


def row_key(filename: Column, end_sec: Column) -> Column:
    return F.concat(F.regexp_replace(filename, r"\.ogg$", ""), F.lit("_"), end_sec.cast("string"))


def row_key_end(row_id: Column) -> Column:
    return F.regexp_extract(row_id, r"_(\d+)$", 1).cast("int")


def row_key_file(row_id: Column) -> Column:
    return F.regexp_replace(row_id, r"_\d+$", "")


def split_labels(text: Column, sep: str = ";") -> Column:
    """'a; b;' -> [a, b]; null -> empty list."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), sep), lambda x: F.trim(x)),
                    lambda x: x != "")


def parse_list_literal(text: Column) -> Column:
    """\"['a', 'b']\" -> [a, b]; empty forms -> empty list; bare text is split on comma or space."""
    raw = F.trim(F.coalesce(text, F.lit("")))
    inner = F.regexp_replace(raw, r"[\[\]'\"]", "")
    pieces = F.when(raw.startswith("["), F.split(inner, ",")).otherwise(F.split(inner, r"[,\s]+"))
    return F.filter(F.transform(pieces, lambda x: F.trim(x)), lambda x: x != "")


def genus(scientific_name: Column) -> Column:
    return F.split(scientific_name, " ")[0]


def geo_cell(lat: Column, lon: Column, step: int = 10) -> Column:
    def cell(x):
        return (F.floor(x / step) * step).cast("int")
    return F.when(lat.isNull() | lon.isNull(), F.lit("NA")).otherwise(
        F.format_string("%+d_%+d", cell(lat), cell(lon)))


def hour_bucket(hour: Column, width: int = 6) -> Column:
    return F.floor(hour / width).cast("int")


def count_band(n: Column) -> Column:
    return (F.when(n <= 0, "0").when(n <= 10, "1-10").when(n <= 50, "11-50")
            .when(n <= 200, "51-200").otherwise("200+"))


def chunk_id(filename: Column, start: Column) -> Column:
    text = F.format_string("%s_%.3f", filename, start.cast("double"))
    return F.substring(F.sha1(text), 1, 8)


def site_code(site: Column) -> Column:
    digits = F.regexp_extract(site, r"^S(\d+)$", 1)
    return F.when(digits == "", site).otherwise(
        F.concat(F.lit("S"), F.format_string("%02d", digits.cast("int"))))
