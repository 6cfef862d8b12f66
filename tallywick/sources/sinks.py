"""Writers: ordered single CSV files for people, folders for tables."""

from __future__ import annotations

import csv
import os

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..operators.lists import CustomerLists


def write_csv_file(df: DataFrame, path: str) -> str:
    """One CSV file with a header in the frame's order.  Rows stream through the
    driver a partition at a time and are never held whole."""
    with open(path, "w", newline="", encoding="utf-8") as f:
        out = csv.writer(f)
        out.writerow(df.columns)
        out.writerows(df.toLocalIterator())
    return path


def write_csv_folder(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").option("header", True).csv(path)
    return path


def export_lists(lists: CustomerLists, out_dir: str, prefix: str = "", folders: bool = False) -> dict[str, str]:
    """customers, churn_risk and high_value as CSV; name -> path.  ``folders``
    lets executors write (large tables), else each is one file."""
    os.makedirs(out_dir, exist_ok=True)
    write = write_csv_folder if folders else write_csv_file
    return {name: write(getattr(lists, name), os.path.join(out_dir, f"{prefix}{name}" + ("" if folders else ".csv"))) for name in ("customers", "churn_risk", "high_value")}


def export_table(df: DataFrame, path: str, kind: str = "csv") -> str:
    """A table as a CSV or Parquet folder.  Other kinds are refused."""
    flat = df.select([c.name for c in df.schema.fields if not isinstance(c.dataType, (T.ArrayType, T.MapType, T.StructType, T.UserDefinedType))])
    if kind == "csv":
        return write_csv_folder(flat, path)
    if kind == "parquet":
        flat.write.mode("overwrite").parquet(path)
        return path
    raise ValueError(f"no writer for {kind!r}: choose csv or parquet")


def _folders(tables: dict[str, DataFrame], out_dir: str, kind: str) -> dict[str, str]:
    return {name: export_table(df, os.path.join(out_dir, name), kind) for name, df in tables.items()}


def export_clusters(result, out_dir: str, kind: str = "csv") -> dict[str, str]:
    """The labelled rows and the summary of a clustering; name -> folder."""
    return _folders({"clusters": result.labelled, "summary": result.summary}, out_dir, kind)


def export_churn(result, df: DataFrame, out_dir: str, kind: str = "csv") -> dict[str, str]:
    """Predictions for ``df`` and the model's feature importance."""
    importance = df.sparkSession.createDataFrame(result.importance, "feature string, importance double, percentage double")
    return _folders({"predictions": result.predict(df), "importance": importance}, out_dir, kind)


def export_explanation(explanation, rows: DataFrame, out_dir: str, kind: str = "csv") -> dict[str, str]:
    """The explained rows with each feature's contribution, and their importance."""
    return _folders({"explanations": explanation.wide(rows), "explained_importance": explanation.importance}, out_dir, kind)
