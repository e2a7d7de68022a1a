"""Continue an interrupted run without redoing finished inputs.

Batch form: ``remaining = inputs LEFT ANTI JOIN done`` on the input key.
Stream form: the input folder is a file stream processed with
``Trigger.AvailableNow``; each micro-batch is anti-joined with the keys
already present in the output and appended, so a re-run (or a restart after
a lost executor or driver, from the checkpoint) adds nothing twice. Unlike a
"skip the first N inputs" rule, this stays right when results arrive out of
order or when failed inputs wrote nothing.

JSONL form (``resume_jsonl``): lines come in as a text stream, finished keys
are keyed state of the stream itself, and each micro-batch owns a folder, so no
batch reads earlier output and a repeated batch replaces what it wrote.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import clean as K
from ..session import materialize

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def remaining(inputs: DataFrame, done: DataFrame, key: str = "original_line_no") -> DataFrame:
    return inputs.join(done.select(key).distinct(), key, "left_anti")


def resume_stream(spark: SparkSession, input_dir: str, schema: str, out_dir: str, checkpoint: str,
                  transform, key: str = "original_line_no") -> None:
    """Process every input file once; append results whose ``key`` is not yet in ``out_dir``.

    ``transform`` maps a batch DataFrame of inputs to result rows carrying ``key``.
    Repeats of a key inside a batch are processed once. Only a missing output
    folder means "no output yet"; any other failure to read it ends the stream,
    since going on would append finished rows again. Blocks until all files present
    at start are processed (AvailableNow).
    """
    stream = spark.readStream.schema(schema).parquet(input_dir)

    def _batch(df: DataFrame, epoch_id: int) -> None:
        df = df.dropDuplicates([key])
        try:
            done = spark.read.schema(f"`{key}` {df.schema[key].dataType.simpleString()}").parquet(out_dir)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            done = None
        todo = df if done is None else remaining(df, done, key)
        transform(todo).write.mode("append").parquet(out_dir)

    q = (stream.writeStream.foreachBatch(_batch).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()


def _has_entries(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(p) and len(fs.listStatus(p)) > 0


def resume_jsonl(spark: SparkSession, input_dir: str, out_dir: str, reject_dir: str, checkpoint: str, key: Callable[[DataFrame], Column],
                 transform: Callable[[DataFrame], DataFrame], files_per_batch: int | None = None) -> None:
    """Process every JSONL file below ``input_dir`` that this stream has not seen, each key once.

    ``key`` names the key of parsed lines (``raw``, VARIANT ``v``) as a string
    column; ``transform`` maps new lines (``key``, ``raw``) to result rows. Results
    go to ``out_dir/batch=<id>``, lines that are no JSON object (``bad_json``,
    ``not_object``) or have a null key (``no_key``) to ``reject_dir/batch=<id>`` as
    (raw, reason, file); blank lines are no records. Of lines that share a key any
    one is taken, whichever files and runs they stand in; rejects are all kept.

    Finished keys are state of the stream (RocksDB, spread by key, in the
    checkpoint), so work a batch does not grow with the output. A batch that was
    cut off is repeated from the state before it and overwrites its folders.
    A new checkpoint beside output of an earlier one would number batches anew
    and knows no finished keys: that is an error. Blocks until all files present
    at start are done.
    """
    if not _has_entries(spark, checkpoint) and (_has_entries(spark, out_dir) or _has_entries(spark, reject_dir)):
        raise ValueError(f"{out_dir} or {reject_dir} holds output, but {checkpoint} is new")
    reader = spark.readStream
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    lines = reader.text(input_dir).select(F.col("value").alias("raw"), F.col("_metadata.file_path").alias("file"))
    parsed = K.parse_records(lines).where("status <> 'blank'")
    parsed = parsed.withColumn("key", F.when(F.col("status") == "ok", key(parsed)))
    reason = F.when(F.col("status") != "ok", F.col("status")).when(F.col("key").isNull(), F.lit("no_key"))
    # A reject is no repeat of another one, so its place in the state is its own.
    once = parsed.select("raw", "file", "key", reason.alias("reason")).withColumn(
        "_once", F.when(F.col("reason").isNull(), F.concat(F.lit("k"), F.col("key"))).otherwise(F.concat(F.lit("r"), F.uuid())))

    def _batch(df: DataFrame, epoch_id: int) -> None:
        df = materialize(df, "resume_batch")   # two sinks, one pass over the state
        df.where("reason is not null").select("raw", "reason", "file").write.mode("overwrite").parquet(f"{reject_dir}/batch={epoch_id}")
        transform(df.where("reason is null").select("key", "raw")).write.mode("overwrite").parquet(f"{out_dir}/batch={epoch_id}")

    before = spark.conf.get(STATE_STORE)
    spark.conf.set(STATE_STORE, ROCKS_DB)   # a query takes the settings of its start
    try:
        q = (once.dropDuplicates(["_once"]).writeStream.foreachBatch(_batch).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
    finally:
        spark.conf.set(STATE_STORE, before)
    q.awaitTermination()
