"""Column names that cannot clash with a caller's frame."""

from __future__ import annotations

from pyspark.sql import DataFrame


def fresh(df: DataFrame, *stems: str) -> list[str]:
    """One name per stem that no column of ``df`` has (in any letter case): the stem, lengthened as needed."""
    taken = {c.lower() for c in df.columns}
    names = []
    for stem in stems:
        while stem.lower() in taken:
            stem += "_"
        taken.add(stem.lower())
        names.append(stem)
    return names
