"""Scalar functions over paths, names, sizes and dates, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions of each file category, heuristics for locations.
CATEGORIES = {
    "images": ("jpg", "jpeg", "png", "gif", "bmp", "webp", "svg", "tiff"),
    "documents": ("pdf", "doc", "docx", "txt", "rtf", "odt", "xls", "xlsx", "csv", "pptx"),
    "video": ("mp4", "avi", "mkv", "mov", "wmv", "flv", "webm"),
    "audio": ("mp3", "flac", "wav", "aac", "ogg", "wma", "m4a"),
    "archives": ("zip", "rar", "7z", "gz", "tar", "bz2"),
}
BACKUP_PATTERN = r"(?i)(backup|oldlaptop|old_laptop|old-laptop|archive)"
YEAR_PATTERN = r"[\\/]\d{4}[\\/]"
WORKSPACE_PATTERN = r"(?i)\\Users\\[^\\]+\\(Documents|Desktop|Projects|Source|dev|code)\\"
DASH = "—"
LOW_COLOUR, HIGH_COLOUR = (0x2D, 0x7D, 0x46), (0xC4, 0x2B, 0x1C)


def file_name(path: Column) -> Column:
    """What stands behind the last separator (/ or \\)."""
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def parent_dir(path: Column) -> Column:
    """What stands before the last separator; '' if there is none."""
    return F.regexp_extract(path, r"^(.*)[/\\][^/\\]*$", 1)


def extension(name: Column) -> Column:
    """Text behind the last dot in lower case; a name without a dot is its own extension."""
    return F.lower(F.substring_index(name, ".", -1))


def category(ext: Column) -> Column:
    """Name of the file category of an extension, else null."""
    out = F.lit(None).cast("string")
    for name, members in CATEGORIES.items():
        out = F.when(ext.isin(*members), F.lit(name)).otherwise(out)
    return out


def drive_letter(path: Column) -> Column:
    """Letter of a drive path, with or without the \\\\?\\ prefix; '' elsewhere."""
    return F.regexp_extract(path, r"^(?:\\\\\?\\)?([A-Za-z]):", 1)


def display_path(path: Column) -> Column:
    """The path without the \\\\?\\ prefix."""
    return F.regexp_replace(path, r"^\\\\\?\\", "")


def without_drive(path: Column) -> Column:
    """The path without prefix and drive."""
    return F.regexp_replace(path, r"^(?:\\\\\?\\)?(?:[A-Za-z]:)?", "")


def separators(path: Column) -> Column:
    return (F.length(path) - F.length(F.translate(path, "/\\", ""))).cast("long")


def epoch_seconds(time: Column) -> Column:
    """Seconds since 1970 of a timestamp, 0 for null."""
    return F.coalesce(F.unix_timestamp(time), F.lit(0)).cast("long")


def parse_date(text: Column) -> Column:
    """A timestamp from a date or time text, else from epoch seconds, else null."""
    return F.coalesce(F.try_to_timestamp(text), F.timestamp_seconds(text.try_cast("long")))


def _trimmed(x: Column, places: int) -> Column:
    """x rounded half away from zero, without closing zeros."""
    fixed = F.format_string(f"%.{places}f", F.round(x, places))
    return F.regexp_replace(F.regexp_replace(fixed, r"(\.\d*?)0+$", "$1"), r"\.$", "")


def format_bytes(n: Column, binary: bool = False) -> Column:
    """'1.5 KB'; binary: '1.5 KiB'.  Below 0 or null: a dash."""
    if binary:
        steps = [(1024.0**k, unit, 1) for k, unit in enumerate(("B", "KiB", "MiB", "GiB", "TiB"))]
    else:
        steps = [(1.0, "B", 0), (1e3, "KB", 1), (1e6, "MB", 1), (1e9, "GB", 2), (1e12, "TB", 2)]
    out = F.lit(DASH)
    for least, unit, places in steps:
        out = F.when(n >= F.lit(0 if least == 1 else least), F.concat(_trimmed(n / F.lit(least), places), F.lit(f" {unit}"))).otherwise(out)
    return out


def treemap_label(n: Column) -> Column:
    """1024-based with one decimal, halves of a tenth up (in whole numbers, so exact); bytes whole."""
    out = F.concat(n.cast("string"), F.lit(" B"))
    for least, unit in ((1 << 10, "KB"), (1 << 20, "MB"), (1 << 30, "GB")):
        rest = n % least
        tenths = (n - rest) / least * 10 + F.floor((rest * 20 + least) / (2 * least))
        tenths = tenths.cast("long")
        label = F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit(f" {unit}"))
        out = F.when(n >= least, label).otherwise(out)
    return out


def density_level(duplicates: Column, total: Column) -> Column:
    """high from a half, medium from a fifth, else low; an empty directory is low."""
    share = duplicates / F.nullif(total, F.lit(0))
    return F.when(share >= 0.5, "high").when(share >= 0.2, "medium").otherwise("low")


def density_colour(density: Column) -> Column:
    """'#rrggbb' between green (0) and red (1), each channel cut to a byte."""
    channels = [(F.lit(float(a)) + F.lit(float(b - a)) * density).cast("int") for a, b in zip(LOW_COLOUR, HIGH_COLOUR, strict=True)]
    return F.format_string("#%02x%02x%02x", *channels)


def hex16(x: Column, upper: bool = False) -> Column:
    """16 hexadecimal digits of a 64-bit value."""
    text = F.lpad(F.hex(x), 16, "0")
    return text if upper else F.lower(text)


def digest(data: Column, algorithm: str = "md5") -> Column:
    """Content digest of a string or binary column: md5, sha256 or xxhash64 (64 bits, as hexadecimal)."""
    if algorithm == "md5":
        return F.md5(data)
    if algorithm == "sha256":
        return F.sha2(data, 256)
    if algorithm == "xxhash64":
        return hex16(F.xxhash64(data))
    raise ValueError(f"unknown digest {algorithm!r}")


def path_label(path: Column) -> Column:
    """Backup root, Active workspace or ''."""
    backup = path.rlike(BACKUP_PATTERN) | path.rlike(YEAR_PATTERN)
    return F.when(backup, "Backup root").when(path.rlike(WORKSPACE_PATTERN), "Active workspace").otherwise("")


def session_label(status: Column, roots: Column, started: Column) -> Column:
    """'aborted' for a session still running; else the first root's name, '+n' for the others, and the date."""
    first = F.try_element_at(roots, F.lit(1))
    name = F.coalesce(F.nullif(file_name(first), F.lit("")), first, F.lit("?"))
    more = F.when(F.size(roots) > 1, F.format_string(" +%d", F.size(roots) - 1)).otherwise("")
    return F.concat(F.when(status == "running", "aborted: ").otherwise(""), name, more, F.lit(" "), F.date_format(started, "yyyy-MM-dd"))


def like_pattern(text: str) -> str:
    """A LIKE pattern that finds the text anywhere, with % _ and \\ taken as they are."""
    return "%" + text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") + "%"
