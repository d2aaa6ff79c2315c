"""Column rules every table obeys: spellings of ids, paths and hashes, and redelivered rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(x: Column | str) -> Column:
    """Without white space at both ends (Spark's trim drops spaces only)."""
    return F.regexp_replace(_c(x), r"^[\s\x{00a0}\x{feff}]+|[\s\x{00a0}\x{feff}]+$", "")


def uuid_key(x: Column | str) -> Column:
    """Lower-case hyphenated form of a uuid in any usual spelling (urn:uuid:, braces, no hyphens, capitals, white space).

    What isn't a uuid keeps its stripped lower-case text, so that it equals nothing but itself; null stays null.
    """
    usual = _c(x).rlike("^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$")  # nearly all rows stop here, at one scan
    s = F.lower(strip(x))
    h = F.regexp_replace(F.regexp_replace(s, r"^urn:uuid:", ""), r"[{}\-]", "")
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.when(usual, _c(x)).when(h.rlike("^[0-9a-f]{32}$"), F.concat_ws("-", *parts)).otherwise(s)


def path_key(x: Column | str) -> Column:
    """A path with single ``/`` and without ``.`` segments, whatever its spelling."""
    usual = ~_c(x).rlike(r"\\|//|^\./|/\./|^\s|\s$|^[\x{00a0}\x{feff}]|[\x{00a0}\x{feff}]$")
    s = F.regexp_replace(F.translate(strip(x), "\\", "/"), "/{2,}", "/")
    return F.when(usual, _c(x)).otherwise(F.regexp_replace(s, r"(^|(?<=/))(\./)+", ""))


def hash_key(x: Column | str) -> Column:
    return F.lower(strip(x))


def latest(df: DataFrame, keys: Sequence[str], columns: Sequence[str], at: str = "recorded_at", first: bool = False) -> DataFrame:
    """One row per key: the row with the latest (``first``: earliest) ``at``; ties fall to the largest (smallest) other values.

    A struct maximum is a partial aggregate, so a key that holds a third of all rows is combined before the shuffle.
    Rows with a null key are dropped; a null time is older than any (``first``: later than any).
    """
    at_col = F.col(at) if not first else F.coalesce(F.col(at), F.lit("9999-12-31").cast("timestamp"))
    pick = (F.min if first else F.max)(F.struct(at_col.alias("_at"), *[F.col(c) for c in columns]))
    rows = df.where(F.concat(*[F.col(k).cast("string") for k in keys]).isNotNull()) if keys else df
    out = rows.groupBy(*keys).agg(pick.alias("_r"))
    return out.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in columns])
