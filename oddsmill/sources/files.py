"""Result-set payloads, JSON lines, CSV/parquet calibration sets, page tables and the matching sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

from oddsmill.functions.exprs import finite
from oddsmill.session import durable, scratch_path  # noqa: F401  (sinks need a place to write)

RESULT_SETS = "struct<resultSets:array<struct<name:string,headers:array<string>,rowSet:array<array<string>>>>>"


def result_rows(docs: DataFrame, text: str, name: str, keep: list[str] = ()) -> DataFrame:
    """Rows of one named result set as maps from header to value."""
    sets = docs.select(*keep, F.explode(F.from_json(text, RESULT_SETS)["resultSets"]).alias("rs")).filter(F.col("rs.name") == name)
    return sets.select(*keep, "rs.headers", F.explode("rs.rowSet").alias("row")).select(*keep, F.map_from_arrays("headers", "row").alias("row"))


def result_issues(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    sets = F.from_json(text, RESULT_SETS)["resultSets"]
    rows = F.aggregate(F.coalesce(sets, F.array()), F.lit(0), lambda s, r: s + F.greatest(F.coalesce(F.size(r["rowSet"]), F.lit(0)), F.lit(0)))
    d = docs.select(*keep, F.coalesce(F.size(sets), F.lit(-1)).alias("sets"), rows.alias("rows"))
    return d.select(*keep, (F.col("sets") > 0).alias("valid"), F.when((F.col("sets") > 0) & (F.col("rows") == 0), "no_rows").alias("warning"), "rows")


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_calibration(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with header, or parquet; infinities, NaN and a zero spread are dropped."""
    raw = spark.read.parquet(path) if path.endswith("parquet") else spark.read.schema(schema).option("header", True).csv(path)
    clean = raw.withColumns({c: finite(c) for c in ("y_true", "mu_hat", "sigma_hat")})
    return clean.dropna(subset=["stat_type", "y_true", "mu_hat", "sigma_hat"]).filter(F.col("sigma_hat") > 1e-6)


def stringify(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, so that any table can go to CSV."""
    nested = (ArrayType, MapType, StructType)
    return df.select(*[F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name) for f in df.schema])


def write_tables(df: DataFrame, folder: str) -> tuple[str, str]:
    """Both files hold the same rows, which are computed once."""
    df = durable(df)
    df.write.mode("errorifexists").json(f"{folder}/jsonl")
    stringify(df).write.mode("errorifexists").option("header", True).option("escape", '"').csv(f"{folder}/csv")   # doubled quotes, as CSV readers expect
    return f"{folder}/jsonl", f"{folder}/csv"


# --- stored HTML pages --------------------------------------------------------------------------------------
# Page column -> stored column.
PAGE_COLUMNS = {"FG": "FGM", "FGA": "FGA", "3P": "FG3M", "3PA": "FG3A", "FT": "FTM", "FTA": "FTA", "ORB": "OREB", "DRB": "DREB", "TRB": "REB",
                "AST": "AST", "STL": "STL", "BLK": "BLK", "TOV": "TOV", "PF": "PF", "PTS": "PTS"}


def page_date(text: Column) -> Column:
    """ISO, 'Mon dd, yyyy' or 'mm/dd/yyyy'."""
    t = F.trim(text)
    return F.coalesce(F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(t, "yyyy-MM-dd")), F.when(t.rlike(r"^[A-Z][a-z]{2} \d{1,2}, \d{4}$"), F.try_to_date(t, "MMM d, yyyy")),
                      F.when(t.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), F.try_to_date(t, "M/d/yyyy")))


def page_rows(pages: DataFrame, html: str, keep: list[str], table_id: str = "pgl_basic") -> DataFrame:
    """Table rows of stored pages as maps from header to cell text; repeated header rows are dropped."""
    table = F.regexp_extract(html, rf'(?is)<table[^>]*id="{table_id}"[^>]*>(.*?)</table>', 1)
    rows = pages.select(*keep, F.regexp_extract_all(table, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1)).alias("_rows"))
    cells = lambda r: F.transform(F.regexp_extract_all(r, F.lit(r"(?is)<t[hd][^>]*>(.*?)</t[hd]>"), F.lit(1)), lambda c: F.trim(F.regexp_replace(c, r"<[^>]*>", "")))
    head = rows.filter(F.size("_rows") > 0).select(*keep, cells(F.element_at("_rows", 1)).alias("_head"), F.posexplode("_rows").alias("row_no", "_row"))
    body = head.select(*keep, "row_no", "_head", cells(F.col("_row")).alias("_cells")).filter((F.size("_cells") == F.size("_head")) & (F.element_at("_cells", 1) != F.element_at("_head", 1)))
    return body.select(*keep, "row_no", F.map_from_arrays("_head", "_cells").alias("row"))


def page_games(rows: DataFrame, keep: list[str]) -> DataFrame:
    """Renamed measures; 'Did Not Play' and 'Inactive' become null."""
    value = lambda c: F.when(~F.col("row")[c].isin("Did Not Play", "Inactive"), F.col("row")[c]).try_cast("double")
    return rows.select(*keep, page_date(F.col("row")["Date"]).alias("game_date"), *[value(c).alias(n) for c, n in PAGE_COLUMNS.items()])
