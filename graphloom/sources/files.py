"""Sources and sinks: notes, vaults, sessions, chat archives, JSON exports, snapshots."""

from __future__ import annotations

import fnmatch
import re
from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions.text import paragraphs, relation, wikilinks, without_front_matter
from ..operators import metrics, stats
from ..operators.ingest import archive_turns
from ..schema import Graph, live, live_edges
from . import readers

MESSAGE = T.StructType([T.StructField(c, T.StringType()) for c in ("role", "content", "timestamp")])
ARCHIVE = "uuid string, name string, updated_at string, created_at string, chat_messages array<struct<sender string, text string, created_at string, content array<struct<type string, text string>>>>"


def ignored(path: Column, patterns: list[str]) -> Column:
    """Whether a relative path or its file name matches a glob; a pattern ending in / matches a folder."""
    test = F.lit(False)
    for p in (p.strip() for p in patterns):
        if not p or p.startswith("#"):
            continue
        body = fnmatch.translate(p.rstrip("/")).removeprefix("(?s:").removesuffix(r")\Z").removesuffix(r")\z")
        test = test | (path.rlike(rf"(^|/){body}/") if p.endswith("/") else path.rlike(rf"^{body}$") | path.rlike(rf"(^|/){body}$"))
    return test


def notes(spark: SparkSession, folder: str, ignore: list[str] = (), seen: DataFrame | None = None) -> DataFrame:
    """(path, mtime, domain, text) of Markdown files below a folder, without those seen at that time or later."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").option("recursiveFileLookup", "true").load(folder)
    base = folder.rstrip("/").split("://")[-1].removeprefix("file:")
    rel = F.regexp_replace(F.regexp_replace("path", r"^\w+:/*", "/"), "^\\Q" + base + "\\E/", "")
    out = files.select(rel.alias("path"), F.col("modificationTime").alias("mtime"), F.col("content").cast("string").alias("text")).where(~ignored(F.col("path"), list(ignore)))
    out = out.withColumn("domain", F.when(F.col("path").contains("/"), F.split("path", "/")[0]).otherwise("default"))
    if seen is not None:
        s = seen.toDF("_p", "_m")
        out = out.join(s, (F.col("path") == F.col("_p")) & (F.col("mtime") <= F.col("_m")), "left_anti")
    return out


def front_matter(text: str) -> dict:
    """The fields between the first two rules of a note: as YAML where its library is there, else lines of `key: value` and lists."""
    found = re.match(r"\A---(.*?)\n---\s*\n", text or "", re.S)
    if not found:
        return {}
    try:
        import yaml

        told = yaml.safe_load(found[1])
        return told if isinstance(told, dict) else {}
    except ImportError:
        pass
    except Exception:  # what can't be read is no front matter
        return {}
    out, key = {}, None
    for line in found[1].split("\n"):
        if (item := re.match(r"\s+-\s+(.*)", line)) and key:
            out[key] = [*(out[key] if isinstance(out[key], list) else []), item[1].strip()]
        elif pair := re.match(r"([\w-]+):\s*(.*)", line):
            key, value = pair[1], pair[2].strip()
            out[key] = [x.strip() for x in value[1:-1].split(",") if x.strip()] if value.startswith("[") and value.endswith("]") else value.strip("\"'")
    return out


def with_front_matter(found: DataFrame) -> DataFrame:
    """The notes with `fields`, a map of their front matter (lists joined by commas), and the text without it."""

    @F.pandas_udf("map<string,string>")
    def fields(texts: pd.Series) -> pd.Series:
        joined = lambda v: ",".join(map(str, v)) if isinstance(v, list) else str(v)
        return texts.map(lambda t: {str(k): joined(v) for k, v in front_matter(t).items() if v is not None})

    return found.withColumn("fields", fields("text")).withColumn("text", without_front_matter("text"))


def note_paragraphs(found: DataFrame, prefix: str = "extractor") -> DataFrame:
    """(content, domain, source_file) of each paragraph."""
    return found.select(F.explode(paragraphs("text")).alias("content"), "domain", F.concat(F.lit(f"{prefix}:"), "path").alias("source_file"))


def wikilink_edges(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges in both directions between the first nodes of notes and of the top-level notes that they link to."""
    first = nodes.where("source_file is not null").groupBy("source_file").agg(F.min("id").alias("id"))
    named = first.select("id", F.regexp_extract("source_file", r":([^/:]+)\.md$", 1).alias("name")).where("name <> ''").groupBy("name").agg(F.min("id").alias("to_id"))
    links = found.select(F.concat(F.lit("extractor:"), "path").alias("source_file"), F.explode(wikilinks("text")).alias("name"))
    one = links.join(first, "source_file").join(named, "name").where("id <> to_id").select(F.col("id").alias("parent_id"), F.col("to_id").alias("child_id"), F.lit(1.0).alias("weight"), F.lit("Wikilink").alias("reasoning"))
    return one.unionByName(one.withColumns({"parent_id": F.col("child_id"), "child_id": F.col("parent_id")})).dropDuplicates(["parent_id", "child_id"])


def session_lines(spark: SparkSession, folder: str, seen: DataFrame | None = None) -> DataFrame:
    """(path, at, role, content, timestamp) of JSON line files, behind the line that `seen` (path, at) has for each; lines that are no objects are
    dropped, and a half-written last line waits until it is whole. Long files are read by many tasks.
    """
    readers.register(spark)
    each = spark.read.format("session_lines").load(folder)
    if seen is not None:
        each = each.join(seen.toDF("_p", "_at"), F.col("path") == F.col("_p"), "left").where("_at is null or at > _at").drop("_p", "_at")
    return each.select("path", "at", F.from_json("value", MESSAGE).alias("m")).select("path", "at", "m.*").where("role is not null")


def session_state(spark: SparkSession, folder: str) -> DataFrame:
    """(path, at): where each file's last whole line begins, to be kept once what was read is stored."""
    readers.register(spark)
    return spark.read.format("session_lines").load(folder).groupBy("path").agg(F.max("at").alias("at"))


def chat_archive(spark: SparkSession, path: str, state: DataFrame | None = None) -> DataFrame:
    """Turns of a JSON archive's conversations that are new or updated since the state (uuid, updated_at)."""
    found = spark.read.schema(ARCHIVE).option("multiLine", "true").json(path)
    if state is not None:
        s = state.toDF("_u", "_t")
        found = found.join(s, F.col("uuid") == F.col("_u"), "left").where("_u is null or updated_at > _t").drop("_u", "_t")
    return archive_turns(found)


def export_json(graph: Graph, folder: str) -> None:
    """Live nodes, and the edges between them with their relation, as JSON lines."""
    live(graph.nodes).write.mode("overwrite").json(f"{folder}/nodes")
    live_edges(graph).withColumn("relation", relation()).write.mode("overwrite").json(f"{folder}/edges")


def export_full(graph: Graph, folder: str, as_of) -> None:
    """All nodes and edges, the statistics and the members of clusters with their colours, each as JSON lines, and a row about the export."""
    parts = {"nodes": graph.nodes, "edges": graph.edges, "degrees": stats.degree_stats(graph), "types": graph.nodes.groupBy("node_type").agg(F.count("*").alias("n")), "reasons": stats.reasoning_buckets(graph)}
    parts |= {"sources": stats.source_counts(graph), "hubs": stats.hubs(graph), "clusters": stats.source_clusters(graph), "cluster_members": stats.cluster_members(graph)}
    parts["about"] = graph.nodes.sparkSession.range(1).select(F.lit("1.0").alias("version"), F.lit(as_of).cast("timestamp").alias("exported"))
    for name, rows in parts.items():
        rows.write.mode("overwrite").json(f"{folder}/{name}")


def export_metrics(graph: Graph, folder: str, as_of, hours: int = 24) -> None:
    """What a dashboard shows: summary, types, hourly retrievals and the last rows."""
    parts = {"summary": metrics.summary(graph, as_of, hours), "by_type": metrics.by_type(graph.metrics, as_of, hours), "series": metrics.hourly(metrics.within(graph.metrics, as_of, hours), "retrieval")}
    parts["recent"] = graph.metrics.orderBy(F.desc("id")).limit(50)
    for name, rows in parts.items():
        rows.write.mode("overwrite").json(f"{folder}/{name}")


def snapshot(graph: Graph, folder: str, stamp: str) -> None:
    """A full copy under a stamp."""
    for name in ("nodes", "edges", "emb"):
        getattr(graph, name).write.mode("errorifexists").parquet(f"{folder}/{stamp}/{name}")


def restored(spark: SparkSession, folder: str, stamp: str) -> Graph:
    return Graph(*(spark.read.parquet(f"{folder}/{stamp}/{name}") for name in ("nodes", "edges", "emb")))


def expired(stamps: list[str], keep: int) -> list[str]:
    """Snapshots beyond the `keep` newest; stamps sort by time."""
    return sorted(stamps)[: max(0, len(stamps) - keep)]


def backup_due(stamps: list[str], now: str, hours: int) -> bool:
    """Whether the newest snapshot is older than the interval; stamps are ISO times."""
    return not stamps or (datetime.fromisoformat(now) - datetime.fromisoformat(max(stamps))).total_seconds() >= hours * 3600


def backup(graph: Graph, folder: str, now: str, hours: int = 6, keep_hours: int = 168) -> tuple[bool, list[str]]:
    """Writes a snapshot if one is due; whether it did, and the stamps that are past their retention. They are listed, and removed here."""
    spark = graph.nodes.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = {x.getPath().getName() for x in store.listStatus(path)} if store.exists(path) else set()
    stamps = sorted(n.replace("_", ":") for n in names if re.fullmatch(r"\d{4}-\d{2}-\d{2}T\d{2}_\d{2}_\d{2}", n))
    made = backup_due(stamps, now, hours)
    if made:
        snapshot(graph, folder, now.replace(":", "_"))
    old = [s for s in stamps if (datetime.fromisoformat(now) - datetime.fromisoformat(s)).total_seconds() > keep_hours * 3600]
    for s in old:
        store.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{s.replace(':', '_')}"), True)
    return made, old
