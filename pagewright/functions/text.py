"""Text rules as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geometry import col

#: What recognised text may hold, as a character class; white space is any Unicode white space. The second adds bullets.
PLAIN = r"A-Za-z0-9\s.,:;!?\-><_()\[\]'\"/\\@#$%&*+=~^"
BULLETS = "•★●▪‣♦"


def clean_text(text: str | Column, bullets: bool = True) -> Column:
    """Text without characters outside the allowed ones, trimmed of any Unicode white space."""
    kept = F.regexp_replace(col(text), f"(?U)[^{PLAIN}{BULLETS if bullets else ''}]", "")
    return F.regexp_replace(kept, r"(?U)^\s+|\s+$", "")


def allowed(text: str | Column) -> Column:
    """Whether a token has only allowed characters."""
    return col(text).rlike(f"(?U)^[{PLAIN}]*$")


def suspect(text: str | Column, x1="x1", x2="x2", pixels_per_char: float = 4.0) -> Column:
    """More characters than the box has room for."""
    return (col(text) != "") & (F.length(col(text)) > F.greatest(F.lit(1), col(x2) - col(x1)) / F.lit(pixels_per_char))


def weak(text: str | Column, conf: str | Column, x1="x1", x2="x2", least: float = 0.97) -> Column:
    """A word to read again: low confidence (missing counts as 1) or suspect."""
    return (F.coalesce(col(conf), F.lit(1.0)) < least) | F.coalesce(suspect(text, x1, x2), F.lit(False))


def stem(path: str | Column) -> Column:
    """File name without folder and last extension."""
    return F.regexp_replace(F.substring_index(col(path), "/", -1), r"(?<=.)\.[^.]*$", "")


def urls(text: str | Column) -> Column:
    """A comma-separated list, trimmed, without empty parts and trailing slashes."""
    parts = F.filter(F.transform(F.split(col(text), ","), lambda p: F.trim(p)), lambda p: p != "")
    return F.transform(parts, lambda p: F.rtrim(p, F.lit("/")))


def line_report(line_id: str | Column, words: str | Column, text: str | Column) -> Column:
    return F.format_string("Line %d (%d words): %s", col(line_id), col(words), col(text))


def spoken(text: str | Column) -> Column:
    """A line as the console of a camera shows it."""
    return F.concat(F.lit(" - "), col(text))


def server_info(model: str | Column, url: str | Column, device: str | Column, replicas: str | Column) -> Column:
    """A recogniser's server in a line of the log; without a device "unknown", and one replica at least."""
    return F.format_string("%s@%s (device=%s, replicas=%d)", col(model), col(url), F.coalesce(col(device), F.lit("unknown")), F.greatest(F.lit(1), F.coalesce(col(replicas), F.lit(1))))


def cluster_info(name: str, lines: str | Column) -> Column:
    """All servers of a recogniser in one line, in the order of an array."""
    return F.concat(F.lit(f"{name} ("), F.array_join(col(lines), ", "), F.lit(")"))


def label_of(class_id: str | Column, names: dict[int, str]) -> Column:
    """The name of a class; id_{n} for one without."""
    known = F.create_map(*[F.lit(x) for pair in names.items() for x in pair]) if names else F.create_map().cast("map<int,string>")
    return F.coalesce(F.try_element_at(known, col(class_id).cast("int")), F.concat(F.lit("id_"), col(class_id)))


def name_sets(found: str | Column, known: str | Column) -> tuple[Column, Column]:
    """Names in either of two arrays, and those found that are not known; sorted."""
    return F.array_sort(F.array_union(col(found), col(known))), F.array_sort(F.array_except(col(found), col(known)))
