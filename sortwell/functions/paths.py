"""File names and display texts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Suffixes of the inventory and of the sorter.
INVENTORY_SUFFIXES = (".jpg", ".jpeg", ".png", ".bmp", ".gif", ".tiff")
SORTER_SUFFIXES = (".jpg", ".jpeg", ".png", ".bmp", ".tiff", ".webp")


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def parent_name(path: Column) -> Column:
    return F.try_element_at(F.split(path, "/"), F.lit(-2))


def suffix(name: Column) -> Column:
    """The suffix in lower case with its dot, or the empty string."""
    return F.lower(F.regexp_extract(name, r"[^/](\.[^./]*)$", 1))


def stem(name: Column) -> Column:
    return F.regexp_replace(name, r"(?<=[^/])\.[^./]*$", "")


def has_suffix(name: Column, suffixes=INVENTORY_SUFFIXES) -> Column:
    return suffix(name).isin(*suffixes)


def numbered(name: Column, n: Column) -> Column:
    """``name``, or for n > 0 its stem, ``_n`` and its suffix as written."""
    ending = F.regexp_extract(name, r"[^/](\.[^./]*)$", 1)
    return F.when(n > 0, F.concat(stem(name), F.lit("_"), n.cast("string"), ending)).otherwise(name)


def shortened(name: Column, longest: int = 15, keep: int = 12) -> Column:
    return F.when(F.length(name) > longest, F.concat(F.substring(name, 1, keep), F.lit("..."))).otherwise(name)


def tagged(side: Column, path: Column) -> Column:
    """The payload by which a file is dragged from one side to the other."""
    return F.concat(F.lit("["), side, F.lit("] "), path)


def untagged(payload: Column) -> Column:
    return F.regexp_replace(payload, r"^\[(train|test)\] ", "")


# fixed values: the formats of display texts


def label_text(label: Column, train: Column, test: Column) -> Column:
    return F.format_string("%s (Train: %d, Test: %d)", label, train, test)


def moved_text(name: Column, source: Column, target: Column) -> Column:
    return F.format_string("Moved %s from %s to %s", name, source, target)


def result_text(label: Column, total: Column, removed: Column) -> Column:
    return F.format_string("Label '%s': %d images processed, %d duplicates removed", label, total, removed)


def percent_text(part: Column, total: Column) -> Column:
    """``(12.3%)``, or the empty string where there is no total."""
    return F.when(total > 0, F.format_string("(%.1f%%)", 100.0 * part / total)).otherwise("")


def without_lines(text: Column, prefix: str) -> Column:
    """The lines of a text that don't start with ``prefix``."""
    return F.array_join(F.filter(F.split(text, "\n"), lambda line: ~line.startswith(prefix)), "\n")
