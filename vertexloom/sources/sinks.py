"""Where results go."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_objects(objects: DataFrame, path: str) -> None:
    """One JSON object a line, in as many files as there are partitions."""
    objects.select("object").write.text(path)


def markdown_rows(rows: DataFrame, line: str = "line") -> DataFrame:
    """Each row as a line of a Markdown table; nested columns are refused."""
    for f in rows.schema:
        if f.dataType.simpleString().startswith(("array", "struct", "map")):
            raise ValueError(f"{f.name} is nested; a Markdown table has flat columns")
    cells = [F.coalesce(F.replace(F.replace(F.col(f"`{c}`").cast("string"), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" ")), F.lit("")) for c in rows.columns]
    return rows.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias(line))


def markdown_head(rows: DataFrame) -> str:
    return "| " + " | ".join(rows.columns) + " |\n|" + " --- |" * len(rows.columns)
