"""Writers of the engine's files: JSON lines, summary tables, one-object reports, prediction lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists", gzip: bool = False) -> None:
    """One compact object a line, fields that are null left out; a file for each partition."""
    df.write.mode(mode).option("compression", "gzip" if gzip else "none").json(path)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A summary table with a header; values with quotes or line ends are quoted."""
    df.write.mode(mode).option("header", True).option("quote", '"').option("escape", '"').csv(path)


def report(summary: DataFrame) -> str:
    """The one row of a summary as indented JSON."""
    rows = summary.select(F.to_json(F.struct("*"), {"pretty": "true", "ignoreNullFields": "false"})).take(2)
    if len(rows) != 1:
        raise ValueError("a report has one row")
    return rows[0][0]


def prediction_map(spans: Column) -> Column:
    """map<"LABEL: value", [[start, end], ...]> of an array of structs with label, value, start and end; keys in order, places by start."""
    key = lambda s: F.concat(s["label"], F.lit(": "), s["value"])
    keys = F.array_sort(F.array_distinct(F.transform(spans, key)))
    places = lambda k: F.array_sort(F.transform(F.filter(spans, lambda s: key(s) == k), lambda s: F.array(s["start"], s["end"])))
    return F.map_from_entries(F.transform(keys, lambda k: F.struct(k, places(k))))


def write_predictions(docs: DataFrame, path: str, id_col: str = "doc_id", spans_col: str = "spans", mode: str = "errorifexists") -> None:
    """Prediction lines: id and spans as prediction_map gives them. Spark's tasks write side by side."""
    write_jsonl(docs.select(F.col(id_col).alias("example_id"), prediction_map(F.col(spans_col)).alias("spans")), path, mode)


def markdown_table(summary: DataFrame, rows: int = 200) -> str:
    """A small summary as a Markdown table, in its own order; a bar in a cell is escaped. More than `rows` rows are an error, not a cut."""
    found = summary.take(rows + 1)
    if len(found) > rows:
        raise ValueError(f"a report has {rows} rows at most")
    cell = lambda v: "" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v).replace("|", "\\|").replace("\n", " ")
    lines = [summary.columns, ["---"] * len(summary.columns), *found]
    return "".join("| " + " | ".join(map(cell, x)) + " |\n" for x in lines)
