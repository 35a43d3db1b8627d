"""Column expressions over asset paths, sizes and times. All run inside generated code."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

MIB = 1024 * 1024
KIB = 1024
# Fixed value: 9999-12-31 23:59:59 UTC, the last second that is displayed as itself.
MAX_EPOCH = 253_402_300_799


def leaf_name(path: Column) -> Column:
    """Text after the last slash."""
    return F.substring_index(path, "/", -1)


def is_package_file(path: Column) -> Column:
    """Files with one of the two package extensions, whatever their case."""
    return F.lower(path).rlike(r"[^/]\.(uasset|umap)$")


def is_per_actor_file(path: Column) -> Column:
    """Files the engine writes one per placed actor or object; nothing imports them."""
    return path.contains("/__ExternalActors__/") | path.contains("/__ExternalObjects__/")


def starts_with_any(path: Column, prefixes: list[str]) -> Column:
    hit = F.lit(False)
    for prefix in prefixes:
        hit = hit | path.startswith(prefix)
    return hit


def is_valid_asset_path(path: Column) -> Column:
    """Non-empty, rooted, and no dot in the last segment."""
    return F.coalesce(path.startswith("/") & ~leaf_name(path).contains("."), F.lit(False))


def package_name(path: Column) -> Column:
    """Drop the object suffix: everything from the first dot of the last segment."""
    return F.regexp_replace(path, r"(?s)^(.*/[^/.]*)\.[^/]*$", "$1")


def asset_path_of_file(file_path: Column, content_root: str) -> Column:
    """Storage path to asset path; NULL when the file is not below the content root."""
    root = content_root.rstrip("/") + "/"
    inside = F.substr(file_path, F.lit(len(root) + 1))
    return F.when(
        file_path.startswith(root),
        F.concat(F.lit("/Game/"), F.regexp_replace(inside, r"(?<=[^/])\.[^./]*$", "")),
    )


def file_of_asset_path(asset_path: Column, content_root: str) -> Column:
    root = content_root.rstrip("/") + "/"
    return F.concat(F.lit(root), F.regexp_replace(asset_path, r"^/Game/", ""), F.lit(".uasset"))


def relative_path(path: Column, root: str) -> Column:
    """Forward-slash path below `root`; unchanged when it lies elsewhere."""
    clean = F.translate(path, "\\", "/")
    root = root.rstrip("/") + "/"
    return F.when(clean.startswith(root), F.substr(clean, F.lit(len(root) + 1))).otherwise(clean)


def folder_bucket(path: Column) -> Column:
    """Path up to and with the 4th slash, else the 3rd, else the whole path."""
    slashes = F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))
    return (
        F.when(slashes >= 4, F.concat(F.substring_index(path, "/", 4), F.lit("/")))
        .when(slashes == 3, F.concat(F.substring_index(path, "/", 3), F.lit("/")))
        .otherwise(path)
    )


def one_decimal(size: Column, unit: int) -> Column:
    """`size / unit` with one decimal, exact ties to the even digit.

    Units are powers of two, so the quotient is exact and only the tie rule matters; the
    JVM's own formatter would round ties up.
    """
    tenths = F.bround(size * F.lit(10) / F.lit(unit)).cast("bigint")
    whole = F.floor(tenths / F.lit(10)).cast("bigint")
    return F.concat(whole.cast("string"), F.lit("."), (tenths % 10).cast("string"))


def megabytes(size: Column) -> Column:
    return F.concat(one_decimal(size, MIB), F.lit(" MB"))


def format_size(size: Column) -> Column:
    return (
        F.when(size >= MIB, megabytes(size))
        .when(size >= KIB, F.concat(one_decimal(size, KIB), F.lit(" KB")))
        .otherwise(F.concat(size.cast("string"), F.lit(" B")))
    )


def format_count(number: Column) -> Column:
    """Thousands separators."""
    return F.format_number(number, 0)


def format_utc(epoch: Column) -> Column:
    return F.date_format(F.timestamp_seconds(F.least(epoch, F.lit(MAX_EPOCH))), "yyyy-MM-dd HH:mm:ss 'UTC'")


def format_rfc3339(epoch: Column) -> Column:
    return F.date_format(F.timestamp_seconds(F.least(epoch, F.lit(MAX_EPOCH))), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def days_between(earlier: Column, now: Column) -> Column:
    """Whole days passed, never negative."""
    return F.floor(F.greatest(now - earlier, F.lit(0)) / F.lit(86400)).cast("bigint")


def budget_rule(asset_type: Column) -> Column:
    return F.concat(F.lit("budget/"), F.lower(asset_type))


def is_glob(pattern: str) -> bool:
    return "*" in pattern or "?" in pattern


def glob_regex(pattern: str, star_stops_at_slash: bool) -> str:
    """Whole-string regular expression of a glob, made once per rule on the driver.

    With `star_stops_at_slash`, `*` and `?` stay within one path segment and only `**` as a
    whole segment crosses slashes.
    """
    one, many = ("[^/]", "[^/]*") if star_stops_at_slash else (".", ".*")
    out, at, braces = [], 0, 0
    while at < len(pattern):
        rest = pattern[at:]
        whole_segment = rest.startswith("**") and (at == 0 or pattern[at - 1] == "/")
        if whole_segment and rest.startswith("**/"):
            out.append("(?:/?|.*/)" if at == 0 else "(?:|.*/)")
            at += 3
        elif whole_segment and rest == "**":
            out.append(".*")
            at += 2
        elif rest[0] == "*":
            out.append(many)
            at += 1
        elif rest[0] == "?":
            out.append(one)
            at += 1
        elif rest[0] == "[" and "]" in rest[2:]:
            end = rest.index("]", 2)
            inside = rest[1:end]
            negate = inside[0] in "!^"
            body = inside[1:] if negate else inside
            out.append(("[^" if negate else "[") + body.replace("\\", "\\\\").replace("[", "\\[") + "]")
            at += end + 1
        elif rest[0] == "{":
            braces += 1
            out.append("(?:")
            at += 1
        elif rest[0] == "}" and braces:
            braces -= 1
            out.append(")")
            at += 1
        elif rest[0] == "," and braces:
            out.append("|")
            at += 1
        elif rest[0] == "\\" and len(rest) > 1:
            out.append(re.escape(rest[1]))
            at += 2
        else:
            out.append(re.escape(rest[0]))
            at += 1
    return "(?s)^" + "".join(out) + r"\z"


def matches_glob(path: Column, pattern: str, star_stops_at_slash: bool) -> Column:
    return path.rlike(glob_regex(pattern, star_stops_at_slash))
