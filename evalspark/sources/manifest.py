"""Source files: classification, manifests, reading order, integrity gate, calendar, snapshots."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T


def file_manifest(spark: SparkSession, path: str) -> DataFrame:
    """path, bytes and sha256 of every file below ``path``."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return f.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def text_manifest(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(F.col(key).alias("path"), F.octet_length(text).cast("long").alias("bytes"), F.sha2(text, 256).alias("sha256"))


def verify_sources(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """OK, MISSING or SHA_MISMATCH for every manifest row."""
    f = files.select("path", F.col("sha256").alias("_have"))
    return manifest.join(f, "path", "left").select("path", F.when(F.col("_have").isNull(), "MISSING").when(
        F.col("_have") != F.col("sha256"), "SHA_MISMATCH").otherwise("OK").alias("status"))


def gate(checked: DataFrame) -> DataFrame:
    """The same rows; reading a bad one fails the job."""
    return checked.withColumn("status", F.when(F.col("status") == "OK", F.col("status")).otherwise(
        F.raise_error(F.concat(F.lit("integrity gate: "), F.col("path").cast("string"), F.lit(" "), F.col("status")))))


def classify_source(path: Column) -> Column:
    """struct(topic, kind, doc_id): topic from the 'Tema N' folder, kind from the file name."""
    norm = F.translate(path, "\\", "/")
    topic = F.regexp_extract(norm, r"^Tema +([0-9]+)/", 1).try_cast("int")
    topic = F.when((topic >= 1) & (topic <= 10), topic)
    name = F.lower(F.element_at(F.split(norm, "/"), -1))
    kind = F.when(name.endswith(".pdf"), "pdf-apunts").when(name.contains("index"), "index").when(
        name.contains("entrenament"), "entrenament").otherwise("teoria")
    doc = F.concat(F.lit("sm-"), F.lpad(topic.cast("string"), 2, "0"), F.lit("-"), F.substring(F.sha2(norm, 256), 1, 10))
    return F.struct(topic.alias("topic"), kind.alias("kind"), doc.alias("doc_id"))


def reading_order(index_pages: DataFrame, docs: DataFrame) -> DataFrame:
    """Position of every document in its topic's index page; others follow at 90 in name order.

    index_pages: topic, html; docs: topic, name.
    """
    from pyspark.sql import Window
    hrefs = index_pages.select("topic", F.posexplode(F.regexp_extract_all("html", F.lit('href="/?([^"]+)"'), F.lit(1))).alias("pos", "name"))
    first = hrefs.groupBy("topic", "name").agg(F.min("pos").alias("pos"))
    alpha = docs.select("topic", "name").distinct().withColumn("_r", F.row_number().over(Window.partitionBy("topic").orderBy("name")) - 1)
    return alpha.join(first, ["topic", "name"], "left").select("topic", "name", F.coalesce("pos", F.col("_r") + 90).alias("doc_order"))


CALENDAR = T.StructType([
    T.StructField("source", T.StringType()), T.StructField("version", T.StringType()),
    T.StructField("events", T.ArrayType(T.StructType([T.StructField(c, T.StringType()) for c in (
        "id", "title", "start", "end", "kind")])))])


def read_calendar(spark: SparkSession, path: str) -> DataFrame:
    """Events of a versioned calendar file, each with its provenance; incomplete ones fail the read."""
    j = spark.read.schema(CALENDAR).option("multiLine", "true").json(path)
    e = j.select("source", "version", F.explode("events").alias("e")).select("source", "version", "e.*")
    bad = None
    for c in ("id", "title", "start", "end", "kind"):
        b = F.coalesce(F.trim(c), F.lit("")) == ""
        bad = b if bad is None else (bad | b)
    return e.withColumn("id", F.when(bad, F.raise_error(F.lit("calendar event without a required field"))).otherwise(F.col("id"))).orderBy("start", "id")


def fingerprint(df: DataFrame) -> DataFrame:
    """Row count and a fingerprint that does not depend on row order."""
    h = F.xxhash64(*[F.col(c) for c in sorted(df.columns)])
    return df.agg(F.count(F.lit(1)).alias("rows"), F.sum(h.cast("decimal(38,0)")).cast("string").alias("fingerprint"))


def snapshot(df: DataFrame, root: str, name: str, schema_version: int, internal: bool = False) -> None:
    """Point-in-time copy with a manifest row."""
    df.write.mode("overwrite").parquet(f"{root}/data/{name}")
    fingerprint(df.sparkSession.read.parquet(f"{root}/data/{name}")).withColumns({
        "name": F.lit(name), "schema_version": F.lit(schema_version), "internal": F.lit(internal)}).write.mode("append").parquet(f"{root}/manifest")


def list_snapshots(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/manifest").filter("NOT internal").drop("internal").orderBy("name")


def restore_snapshot(spark: SparkSession, root: str, name: str, schema_version: int) -> DataFrame:
    """The snapshot's rows; a newer schema version or altered data fails the read."""
    m = spark.read.parquet(f"{root}/manifest").filter(F.col("name") == name)
    df = spark.read.parquet(f"{root}/data/{name}")
    ok = m.filter(F.col("schema_version") <= schema_version).join(fingerprint(df), ["rows", "fingerprint"], "left_semi")
    if ok.limit(1).count() == 0:
        raise ValueError(f"snapshot {name} is missing, altered or newer than schema version {schema_version}")
    return df


def write_tables(tables: dict[str, DataFrame], root: str, partition: str = "topic") -> None:
    """Overwrite every table as parquet, partitioned where it has the partition column."""
    for name, df in tables.items():
        w = df.write.mode("overwrite")
        (w.partitionBy(partition) if partition in df.columns else w).parquet(f"{root}/{name}")


def write_jsonl(df: DataFrame, path: str) -> None:
    df.select(*sorted(df.columns)).write.mode("overwrite").json(path)
