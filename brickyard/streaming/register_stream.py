"""The register loader as a Structured Streaming query.

Yearly (or monthly) register files land in a folder; each new file is
cleaned with exactly the batch rules (``sources.register.judged``) and
appended to the clean transactions table, partitioned by year.  The file
source tracks which files were processed and the file sink commits
atomically, so a restart after a lost executor or driver neither drops nor
repeats rows (exactly-once via ``checkpointLocation``).

A streaming file source needs one fixed layout: the first record of every file
has to be exactly the layout's header (in the bytes of ``encoding``).  A file
with another one fails the query before any of its rows is written; such files
go through the batch loader, which resolves header aliases per file.  Records left out are
counted by reason as in the batch loader: each batch's progress reports them (``rejects``).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from ..config import Config, DEFAULT
from ..sources.register import CORRUPT, ENCODING, REASONS, canonical, judged, regions_table

# Column order of the published register files.
REGISTER_LAYOUT = ("Date of Sale (dd/mm/yyyy)", "Address", "County", "Eircode", "Price (€)",
                   "Not Full Market Price", "VAT Exclusive", "Description of Property",
                   "Property Size Description")
#: Bytes of the published files; only the header's currency sign depends on it.
LAYOUT_ENCODING = "cp1252"
METRICS = "register"


def register_stream(spark: SparkSession, landing_dir: str, layout: Sequence[str] = REGISTER_LAYOUT,
                    cfg: Config = DEFAULT, encoding: str = LAYOUT_ENCODING) -> DataFrame:
    """Streaming DataFrame of clean canonical rows from files landing in ``landing_dir``."""
    names = [n.encode(encoding).decode(ENCODING) for n in layout]
    schema = T.StructType([T.StructField(n, T.StringType()) for n in (*names, CORRUPT)])
    raw = (spark.readStream.schema(schema)
           .option("header", True).option("enforceSchema", False)  # every file's header is compared with the schema
           .option("encoding", ENCODING).option("quote", '"').option("escape", '"').option("multiLine", True)
           .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
           .option("maxFilesPerTrigger", 16)
           .csv(landing_dir))
    canon = canonical(raw, landing_dir)
    if canon is None:
        raise ValueError(f"the layout lacks a required column: {list(layout)}")
    rows = judged(canon, cfg, regions_table(spark))
    rows = rows.observe(METRICS, F.count(F.lit(1)).alias("records"), F.count(F.when(F.col("reject").isNull(), F.lit(1))).alias("kept"),
                        *[F.count(F.when(F.col("reject") == r, F.lit(1))).alias(r) for r in REASONS])
    return rows.where(F.col("reject").isNull()).drop("reject")


def rejects(query: StreamingQuery) -> Counter:
    """Records, those kept and those left out by reason, summed over the batches whose progress the query still holds."""
    total: Counter = Counter()
    for progress in query.recentProgress:
        found = progress.observedMetrics.get(METRICS)
        if found is not None:
            total.update({k: v for k, v in found.asDict().items() if v})
    return total


def start_register_stream(spark: SparkSession, landing_dir: str, table_path: str, checkpoint_location: str,
                          layout: Sequence[str] = REGISTER_LAYOUT, cfg: Config = DEFAULT,
                          available_now: bool = True, encoding: str = LAYOUT_ENCODING) -> StreamingQuery:
    """Append newly landed files to the clean table (Parquet, partitioned by year).

    ``available_now=True`` processes everything present and stops (a scheduled
    batch-like run); ``False`` keeps polling the folder every minute.
    """
    w = (register_stream(spark, landing_dir, layout, cfg, encoding).writeStream
         .format("parquet").partitionBy("year")
         .option("checkpointLocation", checkpoint_location)
         .outputMode("append"))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start(table_path)
