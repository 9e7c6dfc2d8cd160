"""Reading trees to the master export."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..session import staged
from ..sinks.files import master_csv
from ..sources.wire import path_fallback, reading_tree


def export_master(
    primary: DataFrame,
    legacy: DataFrame,
    path: str,
    primary_root: str | None = None,
    legacy_root: str | None = None,
    **options,
) -> DataFrame:
    """Parse both trees, prefer the primary path per device, write the 18-column export.

    The parsed rows are staged, because the ordered export reads its input twice.
    """
    rows = path_fallback(
        staged(reading_tree(primary, root=primary_root), "primary"),
        staged(reading_tree(legacy, root=legacy_root), "legacy"),
    )
    master_csv(rows, path, **options)
    return rows
