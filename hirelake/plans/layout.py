"""The served table laid out for its filters: rows along a space-filling curve over the filtered columns.

Each column is cut into ranges of about equal shares of the rows; the bits of the range numbers, interleaved, order the rows. So rows
that agree in several columns lie together, and the smallest and largest values that Parquet keeps per row group let a filter on any
of them skip most groups. The ranges come from a sample; they decide where rows lie, never which rows are found.
"""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirelake.plans.dashboard import DIMENSIONS
from hirelake.session import stored
from hirelake.sources import tables

COLUMNS = (*DIMENSIONS, "avg_salary")
# Ranges per column as a power of two, rows of the sample, rows per file and bytes per row group.
LEVELS, SAMPLE, FILE_ROWS, GROUP_BYTES = 5, 100_000, 1_000_000, 16 << 20


def bounds_of(rows: DataFrame, columns: tuple[str, ...] = COLUMNS, levels: int = LEVELS, sample: int = SAMPLE) -> dict[str, list]:
    """For each column the values at which a new range begins, at most ``2 ** levels - 1``. A value is never in two ranges."""
    total = rows.count()
    chosen = rows.select(*columns).sample(min(1.0, sample / max(1, total)), seed=7).collect()  # about ``sample`` rows
    made = {}
    for name in columns:
        values = sorted(r[name] for r in chosen if r[name] is not None)
        count = 1 << levels
        cuts = sorted({values[k * len(values) // count] for k in range(1, count)}) if values else []
        made[name] = cuts[1:] if cuts and bisect_left(values, cuts[0]) == 0 else cuts
    return made


def curve(bounds: dict[str, list], levels: int = LEVELS) -> Column:
    """The place of a row on the curve; a null lies before all values."""
    place = F.lit(0).cast("long")
    for k, (name, cuts) in enumerate(bounds.items()):
        number = sum((F.when(F.col(name) >= F.lit(c), 1).otherwise(0) for c in cuts), F.lit(0)).cast("long")
        # Ranges of a column with few values are spread over its bits, so that its first bit parts them in halves.
        number = F.floor(number * (1 << levels) / (len(cuts) + 1)).cast("long")
        for bit in range(levels):
            taken = F.shiftright(number, bit).bitwiseAND(F.lit(1))
            place = place.bitwiseOR(F.shiftleft(taken, bit * len(bounds) + k))
    return place


def publish(rows: DataFrame, root: str, name: str, columns: tuple[str, ...] = COLUMNS, files: int | None = None,
            group_bytes: int = GROUP_BYTES) -> str:
    """A new version of the table, its rows along the curve; returns its path. Filters read it like any other table."""
    rows = stored(rows, "unordered")  # counted, sampled and dealt out from there
    bounds = bounds_of(rows, columns)
    files = files or max(1, -(-rows.count() // FILE_ROWS))
    place = "__place"
    ordered = rows.withColumn(place, curve(bounds)).repartitionByRange(files, place, *columns).sortWithinPartitions(place, *columns)
    return tables.publish(ordered.drop(place), root, name, {"parquet.block.size": group_bytes})
