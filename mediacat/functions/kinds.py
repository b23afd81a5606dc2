"""Media types, masks and dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import extension_of, name_of

#: Type flags.
IMAGE, VIDEO, GIF, RAW, SVG, PORTRAIT = 1, 2, 4, 8, 16, 32
DEFAULT_MASK = IMAGE | VIDEO | GIF | RAW | SVG
#: Extensions by type. The first type that matches holds.
IMAGES = ("jpg", "jpeg", "png", "bmp", "webp", "heic", "heif", "avif", "apng", "jxl")
VIDEOS = ("mp4", "mkv", "webm", "avi", "3gp", "mov", "m4v", "3gpp")
RAWS = ("dng", "orf", "nef", "arw", "rw2", "cr2", "cr3")


def type_of(name: str) -> Column:
    """Type by extension, 0 for anything else."""
    ext = extension_of(name)
    return F.when(ext.isin(*IMAGES), IMAGE).when(ext.isin(*VIDEOS), VIDEO).when(ext == "gif", GIF).when(ext.isin(*RAWS), RAW).when(ext == "svg", SVG).otherwise(0)


def type_of_added(name: str) -> Column:
    """Type of a single added path: video, gif, raw, svg, else image, whatever the extension."""
    ext = extension_of(name)
    return F.when(ext.isin(*VIDEOS), VIDEO).when(ext == "gif", GIF).when(ext.isin(*RAWS), RAW).when(ext == "svg", SVG).otherwise(IMAGE)


def has_type(mask: int, column: str = "type") -> Column:
    return F.col(column).bitwiseAND(F.lit(mask)) != 0


def hidden_name(name: str = "filename") -> Column:
    return F.col(name).startswith(".")


def hidden_path(path: str = "full_path") -> Column:
    return F.instr(path, "/.") > 0


def effective_taken(taken: str = "date_taken", modified: str = "last_modified") -> Column:
    """Capture time, or the time of the last change where it is unknown (0)."""
    return F.coalesce(F.nullif(F.col(taken), F.lit(0)), F.col(modified))


def day_start(ms: Column, unit: str = "DAY") -> Column:
    """Epoch ms of the start of the day or month in the session's time zone."""
    return F.unix_millis(F.date_trunc(unit, F.timestamp_millis(ms)))


def in_days(ms: Column, first: Column, last: Column) -> Column:
    """Whether a time is from the start of the day of ``first`` to the last millisecond of the day of ``last``."""
    after = F.date_add(F.to_date(F.timestamp_millis(last)), 1).cast("timestamp")  # a day may have 23 or 25 hours
    return (ms >= day_start(first)) & (ms < F.unix_millis(after))


def seconds_of(ms: Column) -> Column:
    """Whole seconds, half up."""
    return F.floor(ms / F.lit(1000.0) + F.lit(0.5))


def location_of(path: str) -> Column:
    """1 internal, 2 card, 3 attached device, by path prefix."""
    p = F.col(path)
    return F.when(p.startswith("/storage/emulated/"), 1).when(p.startswith("otg:/"), 3).otherwise(2)


def is_marker(path: str) -> Column:
    return name_of(path) == ".nomedia"
