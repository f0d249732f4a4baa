"""Graph text files, overlays, lexicons, cases, manifests; a turn sink.

Readers return DataFrames of lines or rows; every file is parsed by Spark tasks, never on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def graph_lines(spark: SparkSession, path: str) -> DataFrame:
    """(graph_id, pos, line) of every graph text file below ``path``."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(
        F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.[^./]+$", 1).alias("graph_id"), "value")
    return files.select("graph_id", F.posexplode(F.split("value", r"\r?\n")).alias("pos", "line"))


def parse_graph_lines(lines: DataFrame) -> dict[str, DataFrame]:
    """Tables of graph files from (graph_id, pos, line).

    ``key: value`` before the first section is a header; ``[name]`` opens a section; ``#`` starts a comment; node lines
    are ``name@source: "alias" | "alias"``; edge lines ``a -rel-> b, c`` fan out.  The open section is carried by a
    window over one file's lines.
    """
    clean = lines.withColumn("line", F.trim(F.regexp_replace("line", r"(^|\s)#.*$", ""))).filter("line <> ''")
    head = F.regexp_extract("line", r"^\[(.+)\]$", 1)
    w = Window.partitionBy("graph_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = clean.withColumn("section", F.last(F.when(head != "", F.trim(head)), True).over(w)).filter(head == "")
    header = rows.filter("section IS NULL").select(
        "graph_id", F.trim(F.substring_index("line", ":", 1)).alias("key"), F.trim(F.regexp_replace("line", r"^[^:]*:", "")).alias("value"))
    arrow = r"^(.+?)\s*-([^-<>]+)->\s*(.+)$"
    is_edge = F.col("line").rlike(arrow)
    body = rows.filter("section IS NOT NULL")
    edge = body.filter(is_edge).select(
        "graph_id", "section", F.trim(F.regexp_extract("line", arrow, 1)).alias("src"), F.trim(F.regexp_extract("line", arrow, 2)).alias("rel"),
        F.explode(F.split(F.regexp_extract("line", arrow, 3), r"\s*,\s*")).alias("dst"))
    named = body.filter(~is_edge).withColumn("name", F.trim(F.substring_index("line", ":", 1)))
    node = named.select("graph_id", F.trim(F.substring_index("name", "@", 1)).alias("node_id"), F.col("section").alias("layer"),
                        F.when(F.col("name").contains("@"), F.trim(F.substring_index("name", "@", -1))).alias("source"))
    phrases = F.split(F.regexp_replace("line", r"^[^:]*:", ""), r"\|")
    alias = named.filter(F.col("line").contains(":")).select(
        "graph_id", F.trim(F.substring_index("name", "@", 1)).alias("node_id"), F.posexplode(phrases).alias("ord", "raw")).select(
        "graph_id", "node_id", "ord", F.regexp_replace(F.trim("raw"), '^"|"$', "").alias("phrase")).filter("phrase <> ''")
    return {"header": header, "node": node, "alias": alias, "edge": edge}


def read_graphs(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return parse_graph_lines(graph_lines(spark, path))


def read_explain_graphs(spark: SparkSession, path: str, width: int | None = None, multi_line: bool = True) -> DataFrame:
    """(graph_id, name, excerpt1, excerpt2): names and the first two excerpts of JSON graphs, one in each file or, without
    ``multi_line``, in each line; with ``width`` excerpts are cut to so many characters."""
    schema = "name STRING, nodes MAP<STRING, STRUCT<excerpts: ARRAY<STRING>>>"
    g = spark.read.schema(schema).json(path, multiLine=multi_line)
    rows = g.select(F.col("name").alias("graph_id"), F.explode("nodes").alias("name", "meta"))
    both = [F.get("meta.excerpts", F.lit(i)) for i in (0, 1)]
    return rows.select("graph_id", "name", *[(F.substring(e, 1, width) if width else e).alias(f"excerpt{i + 1}") for i, e in enumerate(both)])


def read_overlay(spark: SparkSession, path: str) -> DataFrame:
    """Append-only JSON lines (node, phrase, verdict); malformed lines are skipped."""
    schema = "node STRING, phrase STRING, verdict STRING"
    return spark.read.schema(schema).json(path, mode="DROPMALFORMED").filter("node IS NOT NULL")


def split_overlay(overlay: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(confirmed, denied) phrases (node, phrase) of an overlay; other verdicts are in neither."""
    return tuple(overlay.filter(F.col("verdict") == v).select("node", "phrase") for v in ("confirmed", "denied"))


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """(word, sense, definition) of the nouns of an XML lexicon with <entry><word/><pos/><sense><definition/></sense>."""
    schema = "word STRING, pos STRING, sense ARRAY<STRUCT<definition: STRING>>"
    rows = spark.read.format("xml").option("rowTag", "entry").schema(schema).load(path).filter("pos = 'noun'")
    return rows.select("word", F.posexplode("sense").alias("i", "s")).select("word", (F.col("i") + 1).alias("sense"), "s.definition")


def read_cases(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """(id, language, n, say, label, act): one row per turn of nested dialogue JSON, one in each file or, without
    ``multi_line``, in each line."""
    turn = "n INT, say STRING, label STRING, expect STRUCT<act: STRING>"
    rows = spark.read.schema(f"id STRING, language STRING, turns ARRAY<STRUCT<{turn}>>").json(path, multiLine=multi_line)
    return rows.select("id", "language", F.explode("turns").alias("t")).select("id", "language", "t.n", "t.say", "t.label", "t.expect.act")


def compile_cases(lines: DataFrame) -> DataFrame:
    """(case_id, kind, value) from lines(case_id, pos, line) ``- kind: value`` of case files."""
    item = r"^\s*-\s*([^:]+):\s*(.+)$"
    return lines.filter(F.col("line").rlike(item)).select("case_id", "pos", F.lower(F.trim(F.regexp_extract("line", item, 1))).alias("kind"), F.trim(F.regexp_extract("line", item, 2)).alias("value"))


def manifest_columns(content):
    """sha256 of the bytes, of the LF-normalised text, and counts of line endings."""
    lf = F.replace(F.replace(content, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    crlf = F.regexp_count(content, F.lit("\r\n"))
    return [
        F.octet_length(content).cast("bigint").alias("bytes"), F.sha2(content, 256).alias("sha256"), F.sha2(lf, 256).alias("sha256_lf"), crlf.cast("bigint").alias("crlf"),
        (F.regexp_count(content, F.lit("\n")) - crlf).cast("bigint").alias("lf"), (F.regexp_count(content, F.lit("\r")) - crlf).cast("bigint").alias("cr"),
    ]


def content_manifest(spark: SparkSession, path: str) -> DataFrame:
    """One manifest row per file below ``path``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.decode("content", "UTF-8").alias("content")).select("path", *manifest_columns(F.col("content")))


def verify_manifest(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """(key, problem): missing, extra or changed entries."""
    e = expected.select(key, F.col("sha256").alias("want"))
    a = actual.select(key, F.col("sha256").alias("have"))
    problem = F.when(F.col("have").isNull(), "missing").when(F.col("want").isNull(), "extra").when(F.col("want") != F.col("have"), "changed")
    return e.join(a, key, "full_outer").select(key, problem.alias("problem")).filter("problem IS NOT NULL")


def append_turns(stream: DataFrame, path: str, checkpoint: str):
    """Idempotent sink: each (conv_id, turn) is stored once, also when a batch is replayed or a turn is sent twice."""

    def store(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        new = batch.dropDuplicates(["conv_id", "turn"])
        try:
            new = new.join(spark.read.parquet(path).select("conv_id", "turn"), ["conv_id", "turn"], "left_anti")
        except Exception as error:  # nothing stored yet
            if "PATH_NOT_FOUND" not in str(error):
                raise
        new.write.mode("append").parquet(path)

    return stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True)
