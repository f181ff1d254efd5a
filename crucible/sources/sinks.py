"""Writers: Parquet, JSON lines, delimited tables, matrices, reports; and checksums of what a table holds."""

from __future__ import annotations

import json
import os
import subprocess
from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crucible.functions.columns import wide
from crucible.sources.matrices import write_matrix


def parquet(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("compression", "zstd").parquet(path)


def json_lines(df: DataFrame, path: str) -> None:
    """One object a line with its keys in order; nulls are written, other alphabets as they are."""
    df.select(*sorted(df.columns)).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def flat(df: DataFrame, sep: str = ";") -> DataFrame:
    """Lists of strings as joined texts."""
    return df.select(*(F.array_join(c, sep).alias(c) if t == "array<string>" else F.col(c) for c, t in df.dtypes))


def delimited(df: DataFrame, path: str, sep: str = "\t", single: bool = False, decimals: dict[str, int] | None = None) -> None:
    """A delimited table with header; lists are joined, named numbers get fixed decimals."""
    out = flat(df)
    for c, n in (decimals or {}).items():
        out = out.withColumn(c, F.format_string(f"%.{n}f", c))
    out = out.coalesce(1) if single else out
    out.write.mode("overwrite").option("header", True).option("sep", sep).option("emptyValue", "").csv(path)


def direction_variants(df: DataFrame, parquet_path: str, tsv_path: str) -> None:
    parquet(df, parquet_path)
    delimited(df, tsv_path)


def wide_vectors(df: DataFrame, id_col: str, vector_col: str, size: int, path: str) -> None:
    df.select(id_col, *wide(vector_col, size)).write.mode("overwrite").option("header", True).csv(path)


def matrix_files(df: DataFrame, id_col: str, vector_col: str, folder: str) -> int:
    """A table as vectors.npy and ids.tsv in a folder that all executors have mounted; the number of rows. Tasks write their rows at their places."""
    return write_matrix(df, id_col, vector_col, folder, single=True)


def git_revision(folder: str = ".") -> str | None:
    """The commit of a folder on the driver; None where there is none."""
    try:
        return subprocess.run(["git", "rev-parse", "HEAD"], cwd=folder, capture_output=True, text=True, check=True, timeout=10).stdout.strip()
    except (OSError, subprocess.SubprocessError):
        return None


def report(values: dict, path: str) -> None:
    """A JSON report on the driver: keys in order, indented."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        json.dump({"generated_at_utc": datetime.now(UTC).isoformat(), **values}, f, ensure_ascii=False, indent=2, sort_keys=True, default=str)
        f.write("\n")


def markdown(title: str, sections: dict[str, list[dict]], path: str | None = None) -> str:
    """A report of tables, one for each section."""
    lines = [f"# {title}", ""]
    for name, rows in sections.items():
        lines += [f"## {name}", ""]
        if rows:
            heads = list(rows[0])
            cell = lambda v: f"{v:.6g}" if isinstance(v, float) else str(v)
            lines += ["| " + " | ".join(heads) + " |", "|" + " --- |" * len(heads), *("| " + " | ".join(cell(r[h]) for h in heads) + " |" for r in rows), ""]
    text = "\n".join(lines) + "\n"
    if path:
        with open(path, "w", encoding="utf-8") as f:
            f.write(text)
    return text


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """(bin, low, high, n): the data of a histogram plot, empty bins left out."""
    width = (high - low) / bins
    at = F.least(F.greatest(F.floor((F.col(value) - low) / width), F.lit(0)), F.lit(bins - 1))
    return df.filter(F.col(value).isNotNull()).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n")).select("bin", (F.lit(low) + F.col("bin") * width).alias("low"), (F.lit(low) + (F.col("bin") + 1) * width).alias("high"), "n")


def checksum(df: DataFrame) -> str:
    """A hash of a table's rows that does not depend on their order or on files: each row's SHA-256, added up in eight parts."""
    row = F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)
    parts = [F.sum(F.conv(F.substring(row, 1 + 8 * i, 8), 16, 10).cast("decimal(20,0)")).alias(f"p{i}") for i in range(8)]
    got = df.agg(F.count(F.lit(1)).alias("n"), *parts).first()
    return f"{got.n}-" + "".join(f"{int(got[f'p{i}'] or 0) % (1 << 32):08x}" for i in range(8))


def manifest(tables: dict[str, DataFrame]) -> dict[str, str]:
    return {name: checksum(df) for name, df in tables.items()}


def verify_manifest(tables: dict[str, DataFrame], expected: dict[str, str]) -> list[str]:
    """Names whose content differs from the manifest, or that it lacks."""
    return [name for name, df in tables.items() if expected.get(name) != checksum(df)]
