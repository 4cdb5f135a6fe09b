"""Loading tables as text, naming their columns, saving and reloading results."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from loomtable.functions.checks import need_columns
from loomtable.functions.values import strip
from loomtable.operators.windows import number_rows
from loomtable.registry import operator
from loomtable.sources.manifests import commit, content_of


@operator("load_as_text")
def load_as_text(spark: SparkSession, path: str, fmt: str = "parquet", **options) -> DataFrame:
    """Every column as a string; numbers need an explicit cast later."""
    reader = spark.read.options(**options)
    df = reader.csv(path, header=True) if fmt == "csv" else reader.format(fmt).load(path)
    return df.select(*[F.col(f"`{c}`").cast("string") for c in df.columns])


def read_cells(spark: SparkSession, path: str, row_column: str = "row_number") -> DataFrame:
    """Headerless delimited text as cells ``_c0, _c1, ...`` with 1-based row numbers.

    A row's number is its place in its piece of the file plus the rows of the pieces before, of which there is one count each.
    """
    df = spark.read.csv(path, header=False, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    placed = df.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__piece"),
                       F.monotonically_increasing_id().alias("__at"))
    pieces = placed.groupBy("__file", "__piece").agg(F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__first"))
    order = Window.orderBy("__file", "__piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = pieces.select("__file", "__piece", "__first", F.coalesce(F.sum("__n").over(order), F.lit(0)).alias("__before"))
    return placed.join(starts, ["__file", "__piece"]).select(
        *df.columns, (F.col("__before") + F.col("__at") - F.col("__first") + 1).alias(row_column))


# ---- header names ----

def canonical_name(path: list[str], position: int) -> tuple[str, bool]:
    """Lower-case ASCII name of a header path; True when it had to be made up."""
    joined = re.sub("[^0-9A-Za-z]+", "_", "_".join(path)).strip("_").lower()
    return (joined, False) if joined else (f"column_{position + 1}", True)


def canonicalize_header_paths(paths: list[list[str]]) -> tuple[list[str], bool]:
    """Unique names (``_2``, ``_3`` on a clash) and whether to ask the user."""
    names, ask = [], False
    for i, path in enumerate(paths):
        base, made_up = canonical_name(path, i)
        name, n = base, 2
        while name in names:
            name, n = f"{base}_{n}", n + 1
        ask |= made_up or name != base
        names.append(name)
    return names, ask


def _is_header(row: list[str]) -> bool:
    filled = [c for c in row if c]
    return bool(filled) and not any(re.fullmatch(
        r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|[+-]?(inf|infinity|nan)", c, re.I) for c in filled)


def infer_header(first_rows: list[tuple[int, list[str]]]) -> dict:
    """Header of a sheet from its first filled rows ``(row number, cells)``.

    A lone title row is skipped; up to three header rows are joined.  Anything
    unsure leaves the schema ``pending``.
    """
    rows = [(n, [(c or "").strip() for c in cells]) for n, cells in first_rows]
    rows = [(n, cells) for n, cells in rows if any(cells)]
    if not rows:
        raise ValueError("the sheet is empty")
    sure = True
    if sum(bool(c) for c in rows[0][1]) == 1 and len(rows) > 1:
        sure, used = False, [rows[1]]
    else:
        used = [rows[0]] + [r for r in rows[1:3] if _is_header(r[1])]
    width = max(len(cells) for _, cells in used)
    paths = [[cells[i] for _, cells in used if i < len(cells) and cells[i]] for i in range(width)]
    names, ask = canonicalize_header_paths(paths)
    return {"columns": names, "header_row_count": len(used), "data_start_row": used[-1][0] + 1,
            "schema_state": "confirmed" if sure and not ask else "pending"}


@operator("normalize_table")
def normalize_table(cells: DataFrame, row_column: str = "row_number", confirm: bool = False) -> DataFrame:
    """Names a headerless table of cells; stops when the header is unsure,
    unless the caller confirms it."""
    need_columns(cells, [row_column])
    names = [c for c in cells.columns if c != row_column]
    filled = None
    for c in names:
        has = F.coalesce(strip(F.col(c)) != "", F.lit(False))
        filled = has if filled is None else filled | has
    first = cells.filter(filled).orderBy(row_column).limit(3).collect()
    header = infer_header([(r[row_column], [r[c] for c in names]) for r in first])
    if header["schema_state"] != "confirmed" and not confirm:
        raise ValueError(f"confirm the header first: {header['columns']}")
    body = cells.filter(F.col(row_column) >= header["data_start_row"])
    return body.select(row_column, *[F.coalesce(F.col(c), F.lit("")).alias(n)
                                     for c, n in zip(names, header["columns"])])


def parse_region(region: str) -> tuple[int, int, int, int]:
    """``B2:D20`` -> (first row, first column, last row, last column), 1-based."""
    m = re.fullmatch(r"([A-Z]+)(\d+):([A-Z]+)(\d+)", region.strip().upper())
    if not m:
        raise ValueError(f"not a region: {region!r}")

    def column(letters: str) -> int:
        n = 0
        for ch in letters:
            n = n * 26 + ord(ch) - 64
        return n

    box = int(m[2]), column(m[1]), int(m[4]), column(m[3])
    if 0 in box or box[0] > box[2] or box[1] > box[3]:
        raise ValueError(f"not a region: {region!r}")
    return box


@operator("load_table_region")
def load_table_region(cells: DataFrame, region: str, header_row_count: int = 1,
                      row_column: str = "row_number") -> DataFrame:
    """Rows and columns of a region; its first rows are the header."""
    top, first, bottom, last = parse_region(region)
    names = [c for c in cells.columns if c != row_column]
    if header_row_count < 1 or header_row_count > bottom - top + 1 or last > len(names):
        raise ValueError("the header does not fit the region")
    picked = names[first - 1: last]
    inside = cells.filter(F.col(row_column).between(top, bottom)).select(row_column, *picked)
    head = inside.filter(F.col(row_column) < top + header_row_count).orderBy(row_column).collect()
    paths = [[(r[c] or "").strip() for r in head if (r[c] or "").strip()] for c in picked]
    if not any(paths):
        raise ValueError("the region has no header")
    titles, _ = canonicalize_header_paths(paths)
    return (inside.filter(F.col(row_column) >= top + header_row_count)
            .select(row_column, *[strip(F.coalesce(F.col(c), F.lit(""))).alias(t)
                                  for c, t in zip(picked, titles)]))


@operator("rows_by_position")
def rows_by_position(df: DataFrame, row_order: list, first: int, last: int, columns: list[str] | None = None,
                     block_rows: int | None = None) -> DataFrame:
    """Rows ``first`` to ``last`` (1-based) of a table under a unique row order."""
    numbered = number_rows(df, [], row_order, "row_number", block_rows)
    return numbered.filter(F.col("row_number").between(first, last)).select(
        "row_number", *(columns or df.columns))


# ---- saved results with lineage ----

LINEAGE_SCHEMA = "result_ref string, produced_by string, source_refs array<string>, columns array<string>, source_paths array<string>"


@operator("save_result")
def save_result(df: DataFrame, root: str, result_ref: str, produced_by: str,
                source_refs: list[str] | None = None, source_paths: list[str] | None = None) -> DataFrame:
    """Keeps the rows as Parquet below ``root`` with their lineage; with ``source_paths`` the fingerprints of
    those files are kept, and ``load_result`` refuses the result once they change.

    Rows and fingerprints go to a folder of their own; the lineage file that names it is committed last, by one rename, so a result
    is there with its lineage or not at all.
    """
    spark, folder = df.sparkSession, f"results/{uuid.uuid4().hex}"
    for i, path in enumerate(source_paths or []):
        source_fingerprint(spark, path).coalesce(1).write.parquet(f"{root}/{folder}/sources/{i}")
    df.write.parquet(f"{root}/{folder}/rows")
    lineage = {"result_ref": result_ref, "produced_by": produced_by, "source_refs": list(source_refs or []), "columns": df.columns,
               "source_paths": list(source_paths or []), "folder": folder}
    if not commit(spark, f"{root}/lineage/{result_ref}.json", lineage):
        raise ValueError(f"result {result_ref!r} is there already")
    return load_result(spark, root, result_ref)


@operator("load_result")
def load_result(spark: SparkSession, root: str, result_ref: str) -> DataFrame:
    lineage = content_of(spark, f"{root}/lineage/{result_ref}.json")
    if lineage is None:
        raise ValueError(f"there is no result {result_ref!r}")
    for i, path in enumerate(lineage["source_paths"]):
        require_unchanged(spark.read.parquet(f"{root}/{lineage['folder']}/sources/{i}"), source_fingerprint(spark, path))
    return spark.read.parquet(f"{root}/{lineage['folder']}/rows")


@operator("result_lineage")
def result_lineage(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(LINEAGE_SCHEMA).json(f"{root}/lineage")


# ---- source fingerprints ----

@operator("source_fingerprint")
def source_fingerprint(spark: SparkSession, path: str) -> DataFrame:
    """Name, size and change time of each file; the content is not read."""
    return (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
            .select(F.col("path").alias("file_path"), F.col("length").alias("file_size"),
                    F.col("modificationTime").alias("modified_at")))


@operator("changed_files")
def changed_files(before: DataFrame, now: DataFrame) -> DataFrame:
    """Files whose fingerprint differs: status changed, missing or new."""
    old = before.select("file_path", F.struct("file_size", "modified_at").alias("old"))
    new = now.select("file_path", F.struct("file_size", "modified_at").alias("new"))
    status = (F.when(F.col("new").isNull(), "missing").when(F.col("old").isNull(), "new")
              .when(F.col("old") != F.col("new"), "changed"))
    return (old.join(new, "file_path", "full").select("file_path", status.alias("status"))
            .filter(F.col("status").isNotNull()))


def require_unchanged(before: DataFrame, now: DataFrame) -> None:
    stale = changed_files(before, now).first()
    if stale:
        raise ValueError(f"source {stale['status']}: {stale['file_path']}")


# ---- dated text rows ----

@operator("filter_by_first_date")
def filter_by_first_date(df: DataFrame, start: str, end: str) -> DataFrame:
    """Rows whose first column is a date in the range; a table whose first
    column does not parse comes back whole."""
    first = F.col(f"`{df.columns[0]}`")
    parsed = first.cast("string").try_cast("timestamp")
    if df.filter(first.isNotNull() & parsed.isNull()).limit(1).count():
        return df
    return df.filter(parsed.between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")))


# CSV column of each indicator.
INDICATOR_COLUMNS = {"macd": "MACD", "macds": "MACD_Signal", "macdh": "MACD_Hist",
                     "boll": "Real Middle Band", "boll_ub": "Real Upper Band",
                     "boll_lb": "Real Lower Band", "rsi": "RSI", "atr": "ATR",
                     "close_10_ema": "EMA", "close_50_sma": "SMA", "close_200_sma": "SMA"}


@operator("indicator_from_csv")
def indicator_from_csv(df: DataFrame, indicator: str, current_date: str, look_back_days: int) -> DataFrame:
    """Dated values of one indicator in the look-back window, oldest first."""
    need_columns(df, ["time"])
    column = INDICATOR_COLUMNS.get(indicator, df.columns[1])
    need_columns(df, [column])
    day = F.when(F.col("time").rlike(r"^\s*\d{4}-\d{1,2}-\d{1,2}\s*$"), strip(F.col("time")).try_cast("date"))
    last = F.lit(current_date).cast("date")
    rows = df.select(day.alias("time"), strip(F.col(f"`{column}`").cast("string")).alias("value"))
    return rows.filter(F.col("time").between(F.date_sub(last, look_back_days), last)).orderBy("time")

