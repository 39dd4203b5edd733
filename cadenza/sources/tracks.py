"""Track documents beside a status table, tables that are replaced as a whole, and checks of a backup by its manifest."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import readers

ANALYSIS = "bpm double, key string, mode string, duration_seconds double, analysis_backend string, chord_progression array<struct<name:string>>, instruments array<struct<label:string>>"
VOICE = "effects_detected array<struct<effect:string,confidence:double>>"
POINTER = "_current"


def local(path: Column) -> Column:
    """A path without its file scheme."""
    return F.regexp_replace(path, "^file:/+", "/")


def documents(spark: SparkSession, glob: str, schema: str) -> DataFrame:
    """path and the fields of one JSON document a file; unreadable files are left out, as missing ones are."""
    df = spark.read.schema(f"{schema}, _corrupt_record string").option("multiLine", True).option("mode", "PERMISSIVE").json(glob)
    return df.withColumn("path", local(F.col("_metadata.file_path"))).where("_corrupt_record is null").drop("_corrupt_record")


def listed(items: Column, field: str, n: int) -> Column:
    """A field of the first ``n`` items as text; items that lack it are passed over, no items give an empty text."""
    return F.coalesce(F.array_join(F.transform(F.slice(items, 1, n), lambda x: x[field]), "; "), F.lit(""))


def heard(effects: Column, least: float = 0.3) -> Column:
    """The names of the effects whose confidence is over ``least``, in their order."""
    kept = F.filter(effects, lambda e: F.coalesce(e["confidence"], F.lit(0.0)) > least)
    return F.coalesce(F.array_join(F.transform(kept, lambda e: F.coalesce(e["effect"], F.lit(""))), "; "), F.lit(""))


def catalogue(status: DataFrame, analysis: DataFrame, voice: DataFrame) -> DataFrame:
    """Completed tracks with what their analysis and voice documents say; a missing or unreadable one gives empty values.

    ``status``: slug, source, status, analysis_json, voice_json; the documents are joined by their paths.
    """
    done = status.where("status = 'completed'")
    a = analysis.withColumnRenamed("path", "_a")
    v = voice.select(F.col("path").alias("_v"), "effects_detected")
    both = done.join(a, local(F.col("analysis_json")) == F.col("_a"), "left").join(v, local(F.col("voice_json")) == F.col("_v"), "left")
    out = both.select(*status.columns, "bpm", "key", "mode", "duration_seconds", F.col("analysis_backend").alias("backend"), listed(F.col("chord_progression"), "name", 6).alias("top_chords"), listed(F.col("instruments"), "label", 5).alias("top_instruments"), heard(F.col("effects_detected")).alias("top_effects"))
    return out.fillna("", ["key", "mode", "backend"])


def skipped(status: DataFrame, why: str = "skipped_long") -> DataFrame:
    return status.where(F.col("status") == why)


# ---- tables that are replaced as a whole ----


def upserted(existing: DataFrame, incoming: DataFrame, key: str, order: str, filled: str) -> tuple[DataFrame, DataFrame]:
    """(the merged table, ``incoming`` with its ``action``): in their order, rows replace what lacks a ``filled`` text.

    ``saved``: nothing had the key; ``updated``: what had it lacked the text; ``skipped``: what had it has the text.  Rows
    of one key follow each other as if they came one by one.
    """
    has = lambda c: F.coalesce(F.trim(c) != "", F.lit(False))
    before = existing.groupBy(key).agg(F.max(has(F.col(filled))).alias("_had"))
    w = Window.partitionBy(key).orderBy(order)
    rows = incoming.join(before, key, "left").withColumn("_n", F.row_number().over(w))
    full = F.coalesce("_had", F.lit(False)) | F.coalesce(F.max(has(F.col(filled))).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    action = F.when(full, "skipped").when(F.col("_had").isNull() & (F.col("_n") == 1), "saved").otherwise("updated")
    acted = rows.withColumn("action", action)
    last = acted.where("action <> 'skipped'").groupBy(key).agg(F.max_by(F.struct(*(F.col(c) for c in incoming.columns)), "_n").alias("_r")).select("_r.*")
    kept = existing.join(last.select(key), key, "left_anti")
    return kept.unionByName(last.select(*existing.columns)), acted.select(*incoming.columns, "action")


def replace(df: DataFrame, root: str) -> str:
    """Writes ``df`` below ``root`` and then points to it in one step: a reader sees the old table or the new one, whole.

    What ``df`` reads may be the table it replaces.  Old versions stay until someone clears them.
    """
    spark, name = df.sparkSession, f"v-{uuid.uuid4().hex}"
    df.write.parquet(f"{root}/{name}")
    jvm = spark._jvm
    conf = spark._jsc.hadoopConfiguration()
    to, at = jvm.org.apache.hadoop.fs.Path(f"{root}/{POINTER}"), jvm.org.apache.hadoop.fs.Path(f"{root}/{POINTER}-{name}")
    out = at.getFileSystem(conf).create(at, True)
    out.write(name.encode())
    out.close()
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(to.getFileSystem(conf).getUri(), conf)
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    files.rename(at, to, options)
    return name


def current(spark: SparkSession, root: str) -> DataFrame | None:
    """The table that ``root`` points to, None where there is none yet."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(f"{root}/{POINTER}")
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(at):
        return None
    stream = files.open(at)
    name = bytes(stream.readNBytes(100)).decode()
    stream.close()
    return spark.read.parquet(f"{root}/{name}")


# ---- backups ----


def sampled(manifest: DataFrame, k: int = 10, seed: int = 0) -> DataFrame:
    """``k`` files of a manifest, the same for one seed: those whose hashes are lowest."""
    return manifest.orderBy(F.xxhash64(F.lit(seed), "path"), "path").limit(k)


def verified(spark: SparkSession, manifest: DataFrame, root: str, k: int = 10, seed: int = 0) -> DataFrame:
    """path and verdict (ok, missing, changed) of a sample, whose files alone are read and hashed again."""
    sample = sampled(manifest.select("path", "sha256"), k, seed)
    there = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path")
    paths = [r.path for r in sample.join(there, "path", "left_semi").collect()]  # k at most
    if not paths:
        return sample.select("path", F.lit("missing").alias("verdict"))
    again = spark.read.format("binaryFile").load(paths).select("path", F.sha2("content", 256).alias("sha256"))
    return readers.compared(sample, again)


def backup_state(manifests: DataFrame, now: Column, max_age_days: int = 7) -> DataFrame:
    """A row a target: ok, reason, age_days, file_count, verified of its last manifest.

    ``manifests``: target, created (text), file_count, verified.  One that is unverified, too old or of no readable time is
    not ok.
    """
    last = manifests.groupBy("target").agg(F.max_by(F.struct("created", "file_count", "verified"), F.struct("created", "file_count")).alias("_m")).select("target", "_m.*")
    time = F.col("created").try_cast("timestamp")
    age = F.floor((F.unix_timestamp(now) - F.unix_timestamp(time)) / 86400)
    known = F.coalesce("verified", F.lit(False))
    ok = known & time.isNotNull() & F.coalesce(age <= max_age_days, F.lit(False))
    reason = F.when(ok, "ok").when(time.isNotNull(), F.concat(F.lit("backup is "), age.cast("string"), F.lit("d old or unverified"))).otherwise("invalid timestamp")
    return last.select("target", ok.alias("ok"), reason.alias("reason"), age.cast("int").alias("age_days"), "file_count", known.alias("verified"))
