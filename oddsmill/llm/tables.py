"""Reading the corpus tables, row identity and bounded broadcasts shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from oddsmill.session import durable

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows and bytes of an Arrow batch at most (one row at least). Texts are long, and a batch is held twice on each side of the pipe.
BATCH_ROWS, BATCH_BYTES = 1_000, 4 << 20
#: A side with more rows than this is never broadcast; joins then shuffle both sides.
BROADCAST_ROWS = 50_000


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to ``BATCH_ROWS`` and ``BATCH_BYTES`` if they are larger: less memory, and the same rows."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        if not 0 < int(spark.conf.get(key).rstrip("b")) <= most:
            spark.conf.set(key, str(most))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def keyed_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Two columns, ``doc_id`` and ``text`` (null: empty). Whatever else the table holds, clashing names included, is gone."""
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else. Pure ASCII texts, where that is what ``lower`` does, take its faster path."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """crc32 of the id as text, modulo ``folds``, equals ``fold``. A null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == fold


def free_name(docs: DataFrame, name: str) -> str:
    """``name``, made longer until no column of ``docs`` has it."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def located(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a column that identifies each row, its file and its position there, and that column's name, which is
    none of theirs. Rows that do not come straight from files are written once, so a retried task can never see
    other positions."""
    try:
        docs.select(docs.metadataColumn("_metadata")["row_index"])
    except AnalysisException:
        docs = durable(docs)
    place, name = docs.metadataColumn("_metadata"), free_name(docs, "_at")
    return docs.withColumn(name, F.struct(place["file_path"].alias("path"), place["row_index"].alias("row"))), name


def sized(small: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast ``small`` (a stored table) if its counted rows stay within the bound; otherwise leave the join to Catalyst."""
    return F.broadcast(small) if small.count() <= rows else small


def without_rows(docs: DataFrame, dropped: DataFrame, name: str) -> DataFrame:
    """``docs`` (from ``located``) without the rows whose place is in the one column of ``dropped``; the place column goes too."""
    dropped = dropped.toDF(name)
    return docs.join(sized(dropped), name, "left_anti").drop(name)
