"""Statement folders as a stream: new files become reconciled ledger rows, each file once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerline.plans.session import checkpointed
from ledgerline.sources import files


def file_stream(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    schema = "path string, modificationTime timestamp, length long, content binary"
    arrived = spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", files_per_batch).option("recursiveFileLookup", "true").load(path)
    return arrived.select(F.xxhash64("path").alias("file_id"), F.element_at(F.split("path", "/"), -1).alias("name"), "content", F.col("length").alias("size"))


def ingest(spark: SparkSession, path: str, table_path: str, checkpoint: str) -> StreamingQuery:
    """Appends the files' ledger rows and a report on each file to Parquet tables, a folder per batch, so that a repeated batch replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        rows, report = files.parsed(batch)
        rows.write.mode("overwrite").parquet(f"{table_path}/batch={batch_id}")
        report.write.mode("overwrite").parquet(f"{table_path}_files/batch={batch_id}")

    return file_stream(spark, path).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


UPLOADS = "user_id long, file_id long, name string, content binary, size long"


def admitted(uploads: DataFrame, before: DataFrame) -> DataFrame:
    """Uploads (``user_id, file_id, name, content, size`` and more) without their contents, with ``sha256, verdict, original``, by the verdicts ``before`` (``user_id, sha256, file_id, verdict``).

    NEW: the first upload of a user's content, by id; DUPLICATE: one that came later, whenever it was sent, with the ``original``'s id; INVALID: name or
    content can't be a statement, which leaves nothing known behind, so such content may come again. Contents go no further than their hash.
    """
    checked = files.fingerprinted(files.validated(uploads)).withColumn("_valid", F.col("error").isNull())
    named = checkpointed(checked.select(*[c for c in uploads.columns if c not in ("content", "size")], "sha256", "_valid"))
    own = F.coalesce(F.concat_ws(":", F.coalesce(F.col("user_id").cast("string"), F.lit("")), "sha256"), F.lit(""))  # contents of no user are known as well
    known = before.filter("verdict = 'NEW'").groupBy(own.alias("_own")).agg(F.min("file_id").alias("_known"))
    first = named.filter("_valid").groupBy(own.alias("_own")).agg(F.min("file_id").alias("_first")).join(known, "_own", "left")
    met = named.withColumn("_own", own).join(first, "_own", "left")
    verdict = F.when(~F.col("_valid"), "INVALID").when(F.col("_known").isNull() & (F.col("file_id") == F.col("_first")), "NEW").otherwise("DUPLICATE")
    return met.withColumns({"verdict": verdict, "original": F.when(verdict == "DUPLICATE", F.coalesce("_known", "_first"))}).drop("_valid", "_own", "_known", "_first")


def _written(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table that may not have been written yet."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


REPORT = "user_id long, statement_id long, file_id long, sha256 string, name string, verdict string, n_rows long, error string"


def ingest_once(uploads: DataFrame, table_path: str, checkpoint: str, statement: Column | None = None) -> StreamingQuery:
    """Keeps each statement's latest file in a table, whatever is sent again; ``statement``: which statement a file is of (its own one, if not said).

    Content that a user has sent before is not read again, unless every file that brought it could not be read. Ledger rows are added in a folder for each
    batch, however many statements there are; ``statement_rows`` reads those that count, the rows of each statement's latest batch. ``{table_path}_files`` has a row
    for each upload, in a folder for each batch.
    A batch that is repeated after a failure writes the same folders again: the report of its own number is left out of what it looks up.
    """
    of = F.col("file_id") if statement is None else statement

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch = batch.withColumn("statement_id", of.cast("long"))
        before = _written(spark, f"{table_path}_files", REPORT + ", batch long").filter(F.col("batch") < batch_id)
        user_content = ["user_id", "sha256"]
        failed = before.filter("error is not null and verdict <> 'INVALID'").select(*user_content).distinct()
        stored = before.filter("error is null and verdict <> 'DUPLICATE'").select(*user_content).distinct()
        judged = checkpointed(admitted(batch, before))
        again = judged.filter("verdict = 'DUPLICATE'").join(failed, user_content, "left_semi").join(stored, user_content, "left_anti")
        again = again.groupBy(*user_content).agg(F.min("file_id").alias("file_id")).select("file_id", F.lit(True).alias("again"))
        judged = checkpointed(judged.join(again, "file_id", "left").withColumn("verdict", F.when(F.col("again"), "AGAIN").otherwise(F.col("verdict"))).drop("again", "original"))
        read = batch.join(judged.filter("verdict in ('NEW', 'AGAIN')").select("file_id"), "file_id", "left_semi")
        rows, report = files.parsed(read.select("file_id", "name", "content", "size"))
        told = checkpointed(judged.join(report.select("file_id", "n_rows", "error"), "file_id", "left"))
        told = told.withColumn("error", F.when(F.col("verdict") == "INVALID", "not a statement file").otherwise(F.col("error")))
        # Of several files for one statement in a batch the last one counts.
        last = told.filter("verdict in ('NEW', 'AGAIN') and error is null").groupBy("user_id", "statement_id").agg(F.max("file_id").alias("file_id"))
        rows.join(last, "file_id").write.mode("overwrite").parquet(f"{table_path}/batch={batch_id}")
        names = [c.split()[0] for c in REPORT.split(", ")]
        told.select(*names).write.mode("overwrite").parquet(f"{table_path}_files/batch={batch_id}")

    return uploads.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def statement_rows(spark: SparkSession, table_path: str) -> DataFrame:
    """The ledger rows of each statement's latest file in a table that ``ingest_once`` keeps."""
    rows = spark.read.parquet(table_path)
    latest = rows.groupBy("user_id", "statement_id").agg(F.max("batch").alias("batch"))
    of = [F.col(f"r.{c}").eqNullSafe(F.col(f"l.{c}")) for c in ("user_id", "statement_id", "batch")]
    return rows.alias("r").join(latest.alias("l"), of, "left_semi").drop("batch")


def activity(events: DataFrame, window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Counts and sums per window and kind of an event stream (``ts, event_type, value``), with late rows up to the watermark."""
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    return timed.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
