"""Readers and writers of the file formats: JSON lines, JSON, whole texts, result trees, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumiscript import schemas


def read_jsonl(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """JSON lines under a declared schema; blank and broken lines are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite", partition_by: list[str] | None = None) -> None:
    w = df.write.mode(mode)
    (w.partitionBy(*partition_by) if partition_by else w).json(path)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names for data in between; one of this machine only where the session is local."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        set_before = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = set_before.get() if set_before.isDefined() else None
    if folder is None:
        import tempfile

        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="lumiscript-")
        spark.sparkContext.setCheckpointDir(folder)
        fs, p = file_system(spark, f"file://{folder}")
        fs.deleteOnExit(p)
    return folder.rstrip("/")


def file_system(spark: SparkSession, path: str):
    """(file system of a path, the path) of whatever kind the cluster has."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One small file of a given name."""
    fs, p = file_system(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()


def write_named(df: DataFrame, base: str, name: str, suffix: str, most: int = 10_000) -> None:
    """The lines (``value``) of each name in one file ``base``/name``suffix``.

    Spark names files itself, so each name's lines go to a folder of its own,
    whose one file is then moved: a rename each, no data through the driver. The
    number of names is checked.
    """
    spark = df.sparkSession
    names = [r[0] for r in df.select(name).distinct().limit(most + 1).collect()]
    if len(names) > most:
        raise ValueError(f"over {most} names are too many files")
    number = F.element_at(F.create_map(*[F.lit(x) for p in zip(names, range(len(names))) for x in p]), F.col(name)) if names else F.lit(0)
    df.select(number.alias("_f"), F.col("value").cast("string").alias("value")).repartition("_f").write.mode("overwrite").partitionBy("_f").text(f"{base}/_parts")
    fs, _ = file_system(spark, base)
    path = spark._jvm.org.apache.hadoop.fs.Path
    for i, x in enumerate(names):
        part = next(f.getPath() for f in fs.listStatus(path(f"{base}/_parts/_f={i}")) if f.getPath().getName().startswith("part-"))
        target = path(f"{base}/{x}{suffix}")
        fs.mkdirs(target.getParent())
        fs.rename(part, target)
    fs.delete(path(f"{base}/_parts"), True)


def read_articles(spark: SparkSession, path: str) -> DataFrame:
    return read_jsonl(spark, path, schemas.ARTICLES)


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    return read_jsonl(spark, path, schemas.QA_ITEMS)


def read_mcq(spark: SparkSession, path: str) -> DataFrame:
    """Multiple-choice items; a list of choices comes as its JSON text."""
    rows = read_jsonl(spark, path, schemas.MCQ_ITEMS)
    listed = F.from_json("choices", "array<string>")
    return rows.withColumn("choices", F.when(F.col("choices").startswith("["), F.array_join(listed, "\n")).otherwise(F.col("choices")))


def read_texts(spark: SparkSession, path: str, config: DataFrame | None = None) -> DataFrame:
    """path, file, text of whole files, one a document; joined with a table (file, ...) of their settings where given."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B"))).alias("file"), F.col("value").alias("text"))
    return rows if config is None else rows.join(config, "file")


def read_yaml_rows(spark: SparkSession, path: str, section: str) -> DataFrame:
    """A list of mappings in a YAML file as a table of strings. YAML is optional; the file is configuration and small."""
    import json

    try:
        import yaml
    except ImportError as e:  # pragma: no cover
        raise ImportError("reading YAML needs PyYAML") from e
    with open(path, encoding="utf-8") as f:
        rows = yaml.safe_load(f)[section]
    names = sorted({k for r in rows for k in r})
    text = lambda v: v if v is None or isinstance(v, str) else json.dumps(v, ensure_ascii=False)
    return spark.createDataFrame([tuple(text(r.get(n)) for n in names) for r in rows], ", ".join(f"`{n}` string" for n in names))


def tag_of(path: Column, base: str) -> Column:
    """The first folder under ``base``, not the file's own."""
    return F.regexp_extract(F.url_decode(path), "^.*?" + base.rstrip("/").replace(".", r"\.").replace("+", r"\+") + "/([^/]+)/", 1)


def read_results(spark: SparkSession, base: str) -> DataFrame:
    """model_tag, task, metric, value, path of all results*.json under ``base``; broken files and metrics that aren't numbers are left out."""
    files = spark.read.option("pathGlobFilter", "results*.json").option("recursiveFileLookup", "true").text(base, wholetext=True).select("value", F.col("_metadata.file_path").alias("path"))
    rows = files.select(tag_of(F.col("path"), base).alias("model_tag"), "path", F.explode(F.from_json(F.get_json_object("value", "$.results"), "map<string,map<string,string>>")).alias("task", "m"))
    rows = rows.select("model_tag", "task", "path", F.explode("m").alias("metric", "v"))
    return rows.select("model_tag", "task", "metric", F.expr("try_cast(v AS double)").alias("value"), "path").filter("value IS NOT NULL")


def read_samples(spark: SparkSession, base: str) -> DataFrame:
    """model_tag, item, ok: the items of the first samples_*.jsonl of each tag.

    Right is ``acc`` or else ``exact_match``; a row with neither is left out if
    it has responses, and wrong if not.
    """
    raw = spark.read.option("pathGlobFilter", "samples_*.jsonl").option("recursiveFileLookup", "true").text(base).select("value", F.col("_metadata.file_path").alias("path")).filter("trim(value) <> ''")
    p = raw.select(tag_of(F.col("path"), base).alias("model_tag"), "path", "value", F.from_json("value", schemas.SAMPLES).alias("j"), F.get_json_object("value", "$.doc_id").alias("item")).filter("try_parse_json(value) IS NOT NULL")
    first = p.groupBy("model_tag").agg(F.min("path").alias("path"))
    given = F.coalesce(F.expr("try_cast(get_json_object(value, '$.acc') AS double)"), F.when(F.get_json_object("value", "$.acc") == "true", 1.0).when(F.get_json_object("value", "$.acc") == "false", 0.0), F.expr("try_cast(get_json_object(value, '$.exact_match') AS double)"))
    rows = p.join(first, ["model_tag", "path"]).withColumn("given", given)
    rows = rows.filter(F.col("given").isNotNull() | F.get_json_object("value", "$.filtered_resps").isNull())
    return rows.select("model_tag", "item", (F.coalesce("given", F.lit(0.0)) != 0).alias("ok"))


def read_hardware(spark: SparkSession, base: str) -> DataFrame:
    """model_tag and what its hardware.json says; null where it is broken."""
    files = spark.read.option("pathGlobFilter", "hardware.json").option("recursiveFileLookup", "true").text(base, wholetext=True)
    get = lambda k: F.get_json_object("value", f"$.{k}").alias(k)
    return files.select(tag_of(F.col("_metadata.file_path"), base).alias("model_tag"), *[get(k) for k in ("recorded_at", "host", "system", "python", "runner", "gpu", "sm", "vram_gb")])


def machine_key() -> Column:
    """Runs with one key ran on the same machine."""
    one = F.concat(F.coalesce("runner", F.lit("?")), F.lit("/"), F.coalesce(F.nullif(F.col("gpu"), F.lit("")), F.lit("cpu")), F.lit("/sm"), F.coalesce("sm", F.lit("?")))
    return F.when(F.coalesce(*[F.col(c) for c in ("recorded_at", "host", "runner", "gpu", "sm")]).isNull(), "unknown").otherwise(one)


def read_matching(spark: SparkSession, pattern: str, schema: str, without: str | None = None) -> DataFrame:
    """JSON lines of all files that match, without the file of that name (an output doesn't read itself)."""
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(pattern).withColumn("file", F.col("_metadata.file_name"))
    return rows if without is None else rows.filter(F.col("file") != without)


def append_log(df: DataFrame, path: str) -> None:
    df.withColumn("logged_at", F.current_timestamp()).write.mode("append").json(path)


def missing_from(rows: DataFrame, sink: DataFrame, keys: list[str]) -> DataFrame:
    """The rows that a sink doesn't have yet, by all keys."""
    return rows.join(sink.select(*keys).distinct(), keys, "left_anti")


def write_report(df: DataFrame, path: str, most: int = 10_000) -> None:
    """A small result as one JSON file; its size is checked."""
    import json

    rows = [r[0] for r in df.select(F.to_json(F.struct("*"))).limit(most + 1).collect()]
    if len(rows) > most:
        raise ValueError(f"over {most} rows are no report")
    write_text(df.sparkSession, path, json.dumps([json.loads(r) for r in rows], ensure_ascii=False, indent=1))


def markdown(df: DataFrame, most: int = 2000) -> str:
    """A small, ordered result as a Markdown table."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"over {most} rows are no table to read")
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(map(cell, r)) + " |" for r in rows])


def write_index(index, path: str, mode: str = "overwrite") -> None:
    """A lexical index as three tables; the postings lie by term, for the join of a search."""
    index.postings.repartition("term").sortWithinPartitions("term").write.mode(mode).parquet(f"{path}/postings")
    index.terms.write.mode(mode).parquet(f"{path}/terms")
    index.totals.write.mode(mode).parquet(f"{path}/totals")


def read_index(spark: SparkSession, path: str):
    from lumiscript.operators.retrieval import LexicalIndex

    return LexicalIndex(*(spark.read.parquet(f"{path}/{t}") for t in ("postings", "terms", "totals")))
