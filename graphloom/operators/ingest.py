"""Ingestion: turns, event times, exact-content deduplication, budgets, access to archives and sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.clock import event_time
from ..functions.text import content_id, stripped, token_estimate, without_tool_marks
from ..schema import normalize_nodes
from .ordered import running_total


def relevant_turns(messages: DataFrame, least: int = 50, text: str = "text") -> DataFrame:
    """User and assistant messages that are long enough without white space at their ends, and are not JSON; with the text so stripped."""
    plain = stripped(F.col(text))
    return messages.withColumn(text, plain).where(F.col("role").isin("user", "assistant") & (F.length(text) >= least) & ~F.startswith(text, F.lit("{")))


def simple_session(messages: DataFrame, least: int = 100) -> DataFrame:
    """`role: text` of long messages, the form that needs no language model."""
    return relevant_turns(messages).where(F.length("text") >= least).select("conv_id", "turn", F.concat("role", F.lit(": "), "text").alias("content"))


def simple_archive(turns: DataFrame, least: int = 50, most: int = 500) -> DataFrame:
    """`name (sender): text` of an archive's turns (uuid, ordinal, name, sender, text), the text cut to `most` characters."""
    clean = turns.withColumn("text", without_tool_marks(stripped(F.col("text")))).where(F.col("sender").isin("human", "assistant") & (F.length("text") >= least))
    return clean.select("uuid", "ordinal", F.concat("name", F.lit(" ("), "sender", F.lit("): "), F.substring("text", 1, most)).alias("content"))


def last_time(messages: DataFrame) -> DataFrame:
    """The last turn of each conversation that has text."""
    return messages.where("text <> ''").groupBy("conv_id").agg(F.max("turn").alias("last_turn"), F.max_by("role", "turn").alias("last_role"))


def last_stamp(messages: DataFrame, key: str, order: str, stamp: str) -> DataFrame:
    """The last stamp of each group that is not empty."""
    return messages.where(F.trim(stamp) != "").groupBy(key).agg(F.max_by(stamp, order).alias(stamp))


def new_nodes(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, content) of non-blank contents that no node has, each once."""
    fresh = found.where("trim(content) <> ''").select("content").distinct().join(nodes.select("content"), "content", "left_anti")
    return fresh.select(content_id("content").alias("id"), "content")


def ingested(found: DataFrame, nodes: DataFrame, source: str, as_of) -> DataFrame:
    """The rows to append for extracted items (content, and what there is of node_type, domain, source_file, referent_time): stripped, not
    blank, one for each content that no node has, with defaults, and with an event time only where it can be read with its offset.
    """
    have = lambda c, default: F.coalesce(F.col(c), F.lit(default)) if c in found.columns else F.lit(default)
    rows = found.withColumn("content", stripped(F.col("content"))).where("content <> ''")
    time = event_time(F.col("referent_time")) if "referent_time" in found.columns else F.lit(None).cast("timestamp")
    rows = rows.select("content", have("node_type", "observation").alias("node_type"), have("domain", "default").alias("domain"), have("source_file", f"extractor:{source}").alias("source_file"), time.alias("referent_ts"))
    first = F.min(F.struct("node_type", "domain", "source_file", "referent_ts")).alias("f")
    rows = rows.groupBy("content").agg(first).select("content", "f.*").join(nodes.select("content"), "content", "left_anti")
    now = F.lit(as_of).cast("timestamp")
    return normalize_nodes(rows.withColumns({"id": content_id("content"), "ts": now, "last_accessed": now, "access_count": F.lit(0), "decayed": F.lit(0), "permanent": F.lit(0)}))


def new_edges(wanted: DataFrame, edges: DataFrame, weight: float = 0.8) -> DataFrame:
    """(parent_id, child_id, weight, reasoning) of wanted edges (parent_id, child_id, reasoning), those that there are left out, each once."""
    fresh = wanted.groupBy("parent_id", "child_id").agg(F.min("reasoning").alias("reasoning")).join(edges.select("parent_id", "child_id"), ["parent_id", "child_id"], "left_anti")
    return fresh.select("parent_id", "child_id", F.lit(weight).alias("weight"), F.concat(F.lit("extracted_from - "), "reasoning").alias("reasoning"))


def within_budget(rows: DataFrame, budget: int, *rank: str) -> DataFrame:
    """Rows in rank order up to the first that overflows the budget, with their tokens and the running total; any number of rows.

    Rows need an `id` of their own: only ids, ranks and token counts are ordered, and the few that fit are looked up by id.
    """
    rank = rank or ("rank",)
    counted = rows.select("id", *[c for c in rank if c != "id"], token_estimate("content").cast("long").alias("tokens"))
    few = running_total(counted, "tokens", *rank).where(F.col("total") <= budget).select("id", "tokens", "total")
    return rows.join(few, "id")


def archive_turns(archive: DataFrame) -> DataFrame:
    """(uuid, ordinal, sender, text) of a chat archive's messages; text blocks are joined by blank lines."""
    m = archive.select("uuid", F.col("name") if "name" in archive.columns else F.lit("").alias("name"), F.posexplode("chat_messages").alias("ordinal", "m"))
    blocks = F.filter(F.col("m.content"), lambda b: b["type"] == "text")
    text = F.array_join(F.transform(blocks, lambda b: b["text"]), "\n\n")
    return m.select("uuid", "name", "ordinal", F.col("m.created_at").alias("created_at"), F.col("m.sender").alias("sender"), F.when(text != "", text).otherwise(F.col("m.text")).alias("text"))


def changed_since(rows: DataFrame, state: DataFrame, key: str, version: str) -> DataFrame:
    """Rows that the state does not have, or has in an older version."""
    s = state.select(F.col(key).alias("_k"), F.col(version).alias("_v"))
    return rows.join(s, F.col(key) == F.col("_k"), "left").where(F.col("_k").isNull() | (F.col(version) > F.col("_v"))).drop("_k", "_v")
