"""Spark-native answer-reliability analytics and training-data operators."""

from __future__ import annotations


def ship(spark) -> str:
    """Sends this package to the executors' Python workers, for sessions whose machines don't have it installed. Returns the archive's path."""
    import tempfile
    import zipfile
    from pathlib import Path

    root = Path(__file__).resolve().parent
    path = f"{tempfile.mkdtemp(prefix='surelake-')}/surelake.zip"
    with zipfile.ZipFile(path, "w") as archive:
        for file in sorted(root.rglob("*.py")):
            archive.write(file, file.relative_to(root.parent))
    spark.sparkContext.addPyFile(path)
    return path
