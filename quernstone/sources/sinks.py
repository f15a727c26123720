"""Writers: run partitions, exports for people, and the check of an export against its rows."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernstone.functions.text import csv_safe
from quernstone.operators.coverage import reconcile


def write_run(df: DataFrame, folder: str, run_id: str) -> None:
    """df as the partition of one run; writing a run again replaces it and no other."""
    df.withColumn("run_id", F.lit(run_id)).write.mode("overwrite").partitionBy("run_id").option("partitionOverwriteMode", "dynamic").parquet(folder)


def read_run(spark: SparkSession, folder: str, run_id: str) -> DataFrame:
    return spark.read.parquet(folder).where(F.col("run_id") == run_id).drop("run_id")


def export_csv(df: DataFrame, folder: str) -> None:
    """Text columns made safe for spreadsheets, null as empty, a header in every file."""
    cells = [csv_safe(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f"`{f.name}`") for f in df.schema]
    df.select(*cells).write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').option("emptyValue", "").option("nullValue", "").csv(folder)


def export_jsonl(df: DataFrame, folder: str) -> None:
    """One object a line, fields in order of their names, nulls written."""
    df.select(*sorted(f"`{c}`" for c in df.columns)).write.mode("overwrite").option("ignoreNullFields", False).json(folder)


def _file_system(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), lambda name: spark._jvm.org.apache.hadoop.fs.Path(path, name)


def finish(spark: SparkSession, folder: str, counts: dict[str, int]) -> None:
    """The marker that an export is whole, with its row counts: written last, under another name, and renamed in one step.

    On any file system that Spark writes to.
    """
    fs, at = _file_system(spark, folder)
    out = fs.create(at(".complete.json.part"), True)
    out.write(bytearray(json.dumps(counts, sort_keys=True), "utf-8"))
    out.close()
    fs.delete(at("complete.json"), False)
    if not fs.rename(at(".complete.json.part"), at("complete.json")):
        raise OSError(f"cannot mark {folder} as complete")


def finished(spark: SparkSession, folder: str) -> dict[str, int] | None:
    """The row counts of a whole export; None if its marker is missing."""
    fs, at = _file_system(spark, folder)
    if not fs.exists(at("complete.json")):
        return None
    return json.loads("".join(r[0] for r in spark.read.text(f"{folder.rstrip('/')}/complete.json").collect()))


def verify_export(spark: SparkSession, df: DataFrame, folder: str, run_id: str) -> DataFrame:
    """Rows that a run's partition lacks or has beyond df; empty where both agree."""
    return reconcile(df, read_run(spark, folder, run_id))


def export_html(df: DataFrame, folder: str, title: str) -> None:
    """Rows as lines of an HTML table, every cell escaped, one page for each file of the folder; for results that people read."""
    escape = lambda c: F.coalesce(F.replace(F.replace(F.replace(F.col(f"`{c}`").cast("string"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit(""))
    told = title.replace("&", "&amp;").replace("<", "&lt;")
    row = F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td>"), escape(c), F.lit("</td>")) for c in df.columns], F.lit("</tr>"))
    head = f"<!doctype html><meta charset=utf-8><title>{told}</title><table><tr>" + "".join(f"<th>{c.replace('&', '&amp;').replace('<', '&lt;')}</th>" for c in df.columns) + "</tr>"

    def page(batches):
        import pyarrow as pa

        schema = pa.schema([("value", pa.string())])
        yield pa.RecordBatch.from_arrays([pa.array([head])], schema=schema)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.string())], schema=schema)
        yield pa.RecordBatch.from_arrays([pa.array(["</table>"])], schema=schema)

    df.select(row.alias("value")).mapInArrow(page, "value string").write.mode("overwrite").text(folder)


def read_json_files(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(path, object) of files of one JSON object each, and (path, reason) of the others: 'not_utf8', 'syntax' or 'not_object'."""
    from quernstone.operators.rejects import without_depth

    def run(batches):
        import pyarrow as pa

        for b in batches:
            texts, reasons = [], []
            for content in b.column(1).to_pylist():
                try:
                    t = content.decode("utf-8-sig")
                    reason = None if (short := without_depth(t)) is not None and short.startswith("{") else "syntax" if short is None else "not_object"
                except UnicodeDecodeError:
                    t, reason = None, "not_utf8"
                texts.append(t)
                reasons.append(reason)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array(reasons, pa.string())], names=["path", "object", "reason"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").option("recursiveFileLookup", True).load(path).select("path", "content")
    read = files.mapInArrow(run, "path string, object string, reason string")
    return read.where("reason is null").select("path", "object"), read.where("reason is not null").select("path", "reason")
