"""Column functions on node labels and search strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Longest text shown as it is; longer ones are cut there and get three dots.
EXCERPT = 180


def present(c: Column) -> Column:
    """The value, or null where it is blank."""
    return F.when(F.trim(c) != "", c)


def node_label() -> Column:
    """label, else text, else uid; the first two trimmed."""
    return F.coalesce(F.trim(present(F.col("label"))), F.trim(present(F.col("text_content"))), F.col("node_uid"), F.lit("unnamed"))


def excerpt(c: Column, most: int = EXCERPT) -> Column:
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit("..."))).otherwise(c)


def node_excerpt() -> Column:
    return excerpt(present(F.trim(F.coalesce(present(F.col("text_content")), F.col("label")))))


def preview(c: Column, most: int = EXCERPT) -> Column:
    """A report preview: at most ``most`` characters, dots included."""
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.rtrim(F.substring(c, 1, most - 3)), F.lit("...")))


def search_form(c: Column) -> Column:
    """Trimmed, small letters, white space collapsed (Unicode white space)."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"(?U)^\s+|\s+$", ""), r"(?U)\s+", " ")


def match_score(needle: str) -> Column:
    """100 for equal label or uid, 85 label begins, 70 label holds, 60 uid holds, 40 text holds, else 0."""
    n = F.lit(needle)
    label, uid, text = search_form(node_label()), search_form(F.col("node_uid")), search_form(F.col("text_content"))
    return (
        F.when((label == n) | (uid == n), 100).when(label.startswith(n), 85).when(label.contains(n), 70).when(uid.contains(n), 60).when(text.contains(n), 40).otherwise(0)
    )


def natural_key(ref: Column, fallback: Column) -> Column:
    """A sort key struct: numeric references first, each number padded to six digits, then the rest by ``fallback``."""
    parts = F.filter(F.split(F.trim(ref), r"[.\-]"), lambda x: x != "")
    numeric = (F.trim(ref) != "") & F.forall(parts, lambda x: x.rlike("^[0-9]+$"))
    bare = F.transform(parts, lambda x: F.regexp_replace(x, "^0+(?=.)", ""))
    padded = F.array_join(F.transform(bare, lambda x: F.when(F.length(x) < 6, F.lpad(x, 6, "0")).otherwise(x)), ".")
    return F.when(numeric, F.struct(F.lit(0).alias("rank"), padded.alias("key"))).otherwise(F.struct(F.lit(1).alias("rank"), fallback.alias("key")))
