"""Session plans with injected callbacks: extraction, thinking and tension, at once or handed over as JSON.

A model is a function from a prompt to an answer; without one, extraction takes its deterministic form. An encoder is a
function from texts to vectors; with one, new nodes get vectors, edges from what they resemble, and gates by similarity.
Every plan returns the new state and what it made. What comes to the driver is a prompt's sample or a model's answer.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, functions as F

from ..config import Knobs
from ..functions.clock import event_time
from ..functions.text import content_id, domain_of_text, extracted, merged_tags, normal_tags, statement_kind, statement_lines, stripped, typed_statement
from ..operators.embed import Encoder, encoded
from ..operators import metrics
from ..operators.ingest import new_edges
from ..operators.observed import counted_cut
from ..operators.search import diverse, novelty, similar_links
from ..operators.similarity import tension_pairs
from ..operators.stats import endpoints
from ..schema import Graph, live, normalize_nodes
from ..shared import cut

ITEM = "content string, node_type string, domain string, tags array<string>, referent_time string"
Model = Callable[[str], str]


class Counted:
    """A model that counts its calls and about how many tokens go in and out."""

    def __init__(self, model_fn: Model):
        self.model_fn, self.calls, self.input_tokens, self.output_tokens = model_fn, 0, 0, 0

    def __call__(self, prompt: str) -> str:
        answer = self.model_fn(prompt)
        self.calls += 1
        self.input_tokens += len(prompt) // 4
        self.output_tokens += len(answer) // 4
        return answer

    def usage(self) -> dict[str, int]:
        return {"calls": self.calls, "input_tokens": self.input_tokens, "output_tokens": self.output_tokens}


def prompt_types(kinds: dict[str, str]) -> str:
    """A line for each type and what it means."""
    return "\n".join(f'- "{k}": {v}' for k, v in kinds.items())


def salvaged(answer: str) -> list[dict]:
    """The JSON array in a model's answer, fences and talk around it left out; [] if there is none. Items with keep=false go."""
    found = re.search(r"\[.*\]", answer or "", re.S)
    try:
        items = json.loads(found[0]) if found else []
    except ValueError:
        return []
    return [x for x in items if isinstance(x, dict) and x.get("content") and x.get("keep", True) is not False]


def inferred_time(content: str, model_fn: Model) -> str | None:
    """The time of what a text tells, if the model names one with an offset."""
    try:
        answer = (model_fn(f"When did this happen? Answer with an ISO 8601 time with its offset, or NONE.\n\nStatement: {content}\n\nAnswer:") or "").strip()
    except Exception:  # a model's failure leaves the time unknown
        return None
    if not answer or answer.upper().startswith("NONE"):
        return None
    token = answer.split()[0].strip().rstrip(".,;")
    return token if re.search(r"([Zz]|[+-]\d{2}:?\d{2})$", token) and re.match(r"\d{4}-\d{2}-\d{2}", token) else None


def _items(graph: Graph, items: list[dict], knobs: Knobs, default_type: str = "observation") -> DataFrame:
    kind = lambda x: x.get("type") if x.get("type") in knobs.node_types else default_type
    tags = lambda x: [str(t) for t in x["tags"]] if isinstance(x.get("tags"), list) else None
    rows = [(str(x["content"]), kind(x), x.get("domain"), tags(x), x.get("referent_time")) for x in items]
    return graph.nodes.sparkSession.createDataFrame(rows, ITEM)


def _as_nodes(rows: DataFrame, source: str, as_of) -> DataFrame:
    """The items as nodes, one for each content."""
    now = F.lit(as_of).cast("timestamp")
    first = rows.groupBy("content").agg(F.min(F.struct("node_type", "domain", "tags", "referent_time")).alias("f")).select("content", "f.*")
    fixed = {"source_file": F.lit(source), "ts": now, "last_accessed": now, "access_count": F.lit(0), "decayed": F.lit(0), "permanent": F.lit(0), "metadata": F.lit("{}")}
    made = first.withColumn("id", content_id("content")).withColumns(fixed).withColumn("referent_ts", event_time(F.col("referent_time")))
    return normalize_nodes(made.withColumn("tags", F.when(F.col("tags").isNotNull(), normal_tags(F.col("tags")))))


def _added(graph: Graph, rows: DataFrame) -> tuple[Graph, DataFrame]:
    """The state with the nodes that it does not have, and these."""
    new = cut(rows.join(graph.nodes.select("id"), "id", "left_anti"))
    return graph.with_(nodes=graph.nodes.unionByName(new, allowMissingColumns=True)), new


def _wired(graph: Graph, edges: DataFrame) -> tuple[Graph, DataFrame]:
    fresh = cut(edges)
    return graph.with_(edges=graph.edges.unionByName(fresh, allowMissingColumns=True)), fresh


def _embedded(graph: Graph, new: DataFrame, encoder: Encoder, model: str) -> tuple[Graph, DataFrame]:
    vectors = cut(encoded(new, encoder, model))
    return graph.with_(emb=graph.emb.select("node_id", "vector", "model").unionByName(vectors)), vectors


def extract(graph: Graph, text: str, as_of, model_fn: Model | None = None, knobs: Knobs = Knobs()) -> tuple[Graph, int]:
    """The state with a conversation's statements as nodes, and how many are new. Under 20 characters nothing is done."""
    after, report = end_session(graph, text, as_of, model_fn, knobs=knobs)
    return after, len(report["nodes"])


def end_session(graph: Graph, text: str, as_of, model_fn: Model | None = None, encoder: Encoder | None = None, model: str = "hashing", knobs: Knobs = Knobs(), source: str = "session", default_time: str | None = None, infer_time: bool = False) -> tuple[Graph, dict]:
    """Extraction, then with an encoder vectors for the new nodes and an edge to each from its three most similar live nodes.

    An answer without a JSON array falls back on the deterministic form. Times are the item's, the default, or asked for.
    """
    if len(text.strip()) < 20:
        return graph, {"nodes": [], "edges": 0}
    answer = model_fn(f"Extract statements as a JSON array of content, type (one of {'|'.join(knobs.node_types)}), domain, tags and keep:\n{text}") if model_fn else ""
    if "[" in answer and "]" in answer:
        items = salvaged(answer)
        for x in items:
            x["referent_time"] = x.get("referent_time") or default_time or (inferred_time(x["content"], model_fn) if infer_time else None)
        rows = _items(graph, items, knobs)
    else:
        told = graph.nodes.sparkSession.createDataFrame([(text,)], "t string").select(F.explode(extracted(F.col("t"))).alias("x")).select("x.*")
        rows = told.select("content", "node_type", F.lit(None).cast("string").alias("domain"), F.lit(None).cast("array<string>").alias("tags"), F.lit(default_time).cast("string").alias("referent_time"))
    graph, new = _added(graph, _as_nodes(rows, source, as_of))
    ids, edges = [r["id"] for r in new.select("id").orderBy("id").collect()], 0
    if encoder and ids:
        graph, vectors = _embedded(graph, new, encoder, model)
        reason = F.concat(F.lit("Session extraction similarity: "), F.format_string("%.3f", "sim"))
        links = similar_links(graph, vectors).select(F.col("b").alias("parent_id"), F.col("a").alias("child_id"), reason.alias("reasoning"))
        graph, fresh = _wired(graph, new_edges(links, graph.edges))
        edges = fresh.count()
    return graph, {"nodes": ids, "edges": edges}


def thinking_sample(graph: Graph, size: int = 5, domain: str | None = None, seed: int = 0) -> DataFrame:
    """Live nodes with a signal (an access or an edge): 70 % least accessed, the rest by a seeded hash."""
    linked = endpoints(graph.edges).distinct().withColumn("linked", F.lit(True))
    rows = live(graph.nodes).join(linked, "id", "left").where("access_count > 0 OR linked")
    if domain is not None:
        rows = rows.where(F.col("domain") == domain)
    rows = rows.select("id", "content", "access_count", "node_type")
    order = F.xxhash64("id", F.lit(seed))
    few = round(0.7 * size)
    least = cut(rows.orderBy("access_count", order, "id").limit(few))
    return least.unionByName(rows.join(least.select("id"), "id", "left_anti").orderBy(order, "id").limit(size - few))


def think_prompt(sample: list) -> str:
    return "What follows from these statements? Answer with a JSON array of content and type.\n" + "\n".join(f"[{r['node_type'].upper()}] {r['content']}" for r in sample)


def _from_sample(graph: Graph, items: list[dict], parents: list[str], as_of, knobs: Knobs, reason: str, encoder, model, most_similar: float) -> tuple[Graph, list[str]]:
    rows = _as_nodes(_items(graph, items, knobs, "insight"), "system_generated", as_of)
    if encoder:
        vectors = cut(encoded(rows, encoder, model)).select(F.col("node_id").alias("cand_id"), "vector")
        rows = rows.join(diverse(graph, vectors, most_similar).select(F.col("cand_id").alias("id")), "id", "left_semi")
    graph, new = _added(graph, rows)
    wanted = new.select(F.explode(F.array(*map(F.lit, parents))).alias("parent_id"), F.col("id").alias("child_id"), F.lit(reason).alias("reasoning"))
    graph, _ = _wired(graph, new_edges(wanted, graph.edges))
    if encoder:
        graph, _ = _embedded(graph, new, encoder, model)
    return graph, [r["id"] for r in new.select("id").orderBy("id").collect()]


def think(graph: Graph, model_fn: Model, as_of, knobs: Knobs = Knobs(), domain: str | None = None, seed: int = 0, encoder: Encoder | None = None, model: str = "hashing", most_similar: float = 0.85) -> tuple[Graph, int]:
    """New nodes from a sample, each with an edge from every node of it; with an encoder, without those that are too like a live node."""
    sample = thinking_sample(graph, knobs.seeds, domain, seed).orderBy("id").collect()
    if len(sample) < 2:
        return graph, 0
    graph, made = _from_sample(graph, salvaged(model_fn(think_prompt(sample))), [r["id"] for r in sample], as_of, knobs, "Think cycle derivation", encoder, model, most_similar)
    return graph, len(made)


def tension_candidates(graph: Graph, domain: str | None = None) -> list:
    """The ten pairs of tension_pairs() among live nodes with a signal, with types and contents; none of fewer than four nodes."""
    linked = endpoints(graph.edges).distinct().withColumn("linked", F.lit(True))
    nodes = live(graph.nodes).join(linked, "id", "left").where("access_count > 0 OR linked").drop("linked")
    if domain is not None:
        nodes = nodes.where(F.get_json_object("metadata", "$.domain") == domain)
    emb = graph.emb.join(nodes.select(F.col("id").alias("node_id")), "node_id", "left_semi")
    if len(emb.limit(4).take(4)) < 4:
        return []
    pairs = cut(tension_pairs(graph.with_(nodes=nodes, emb=emb)))
    n = nodes.select("id", "content", "node_type")
    return pairs.join(n.toDF("a", "content_a", "type_a"), "a").join(n.toDF("b", "content_b", "type_b"), "b").orderBy("score", "a", "b").collect()


def tension(graph: Graph, model_fn: Model, as_of, domain: str | None = None, encoder: Encoder | None = None, model: str = "hashing") -> tuple[Graph, list[str]]:
    """A node for each tension that the model names (pair, tension, type) among the candidates, with an edge from both of its nodes."""
    pairs = tension_candidates(graph, domain)
    if not pairs:
        return graph, []
    text = "".join(f"\nPair {i} (similarity: {r['sim']:.2f}):\n  A [{r['type_a']}]: {r['content_a']}\n  B [{r['type_b']}]: {r['content_b']}\n" for i, r in enumerate(pairs, 1))
    answer = model_fn(f"Which of these pairs contradict each other? Answer with a JSON array of pair, tension and type.\n{text}")
    found = re.search(r"\[.*\]", answer or "", re.S)
    try:
        told = [t for t in json.loads(found[0]) if isinstance(t, dict) and t.get("tension") and t.get("type")] if found else []
    except ValueError:
        told = []
    rows = []
    for t in told:
        k = t.get("pair", 1) - 1 if isinstance(t.get("pair", 1), int) else -1
        if 0 <= k < len(pairs):
            hint = f" [Resolution hint: {t['resolution_hint']}]" if t.get("resolution_hint") else ""
            rows.append((f"TENSION ({t['type']}): {t['tension']}{hint}", pairs[k]["a"], pairs[k]["b"]))
    if not rows:
        return graph, []
    made = graph.nodes.sparkSession.createDataFrame(rows, "content string, a string, b string")
    items = made.select("content", F.lit("tension").alias("node_type"), F.lit(None).cast("string").alias("domain"), F.lit(None).cast("array<string>").alias("tags"), F.lit(None).cast("string").alias("referent_time"))
    graph, new = _added(graph, _as_nodes(items, "system_generated", as_of))
    wanted = made.select(F.explode(F.array("a", "b")).alias("parent_id"), content_id("content").alias("child_id"), F.lit("Tension detection").alias("reasoning"))
    graph, _ = _wired(graph, new_edges(wanted, graph.edges))
    if encoder:
        graph, _ = _embedded(graph, new, encoder, model)
    return graph, [r["id"] for r in new.select("id").orderBy("id").collect()]


def extraction_plan(text: str, knobs: Knobs = Knobs()) -> str:
    """What a model elsewhere needs to extract, as JSON."""
    return json.dumps({"operation": "extract", "types": list(knobs.node_types), "text": text})


def thinking_plan(graph: Graph, knobs: Knobs = Knobs(), domain: str | None = None, seed: int = 0) -> str:
    """A sample to think about, and its prompt, as JSON."""
    sample = thinking_sample(graph, knobs.seeds, domain, seed).orderBy("id").collect()
    return json.dumps({"operation": "think", "nodes": [{"id": r["id"], "content": r["content"], "type": r["node_type"]} for r in sample], "prompt": think_prompt(sample) if sample else ""})


def ingest_answer(graph: Graph, answer: str, as_of, user: str = "user", assistant: str = "ai", tags: list[str] = (), parents: list[str] = (), encoder: Encoder | None = None, model: str = "hashing", threshold: float | None = None, knobs: Knobs = Knobs()) -> tuple[Graph, list[str]]:
    """Takes in what a model elsewhere answered: an array of items, or an object with `insights`. Items without a domain get one by
    what they say; `tags` are added to all; `parents` (a thinking plan's nodes) get edges to each; with an encoder and a
    threshold, items that are not new are left out.
    """
    told = json.loads(answer)
    items = [x for x in (told if isinstance(told, list) else told.get("insights", [])) if isinstance(x, dict) and x.get("content")]
    rows = _items(graph, items, knobs, "insight")
    rows = rows.withColumn("domain", F.coalesce("domain", domain_of_text(F.col("content"), user, assistant)))
    nodes = _as_nodes(rows, "handed_over", as_of)
    if tags:
        nodes = nodes.withColumn("tags", merged_tags("tags", F.lit(",".join(tags))))
    if encoder and threshold is not None:
        vectors = cut(encoded(nodes, encoder, model)).select(F.col("node_id").alias("cand_id"), "vector")
        nodes = nodes.join(novelty(graph, vectors, threshold).where("is_novel").select(F.col("cand_id").alias("id")), "id", "left_semi")
    graph, new = _added(graph, nodes)
    if parents:
        wanted = new.select(F.explode(F.array(*map(F.lit, parents))).alias("parent_id"), F.col("id").alias("child_id"), F.lit("Think cycle derivation").alias("reasoning"))
        graph, _ = _wired(graph, new_edges(wanted, graph.edges))
    if encoder:
        graph, _ = _embedded(graph, new, encoder, model)
    return graph, [r["id"] for r in new.select("id").orderBy("id").collect()]


def told_by_model(rows: DataFrame, model_fn: Model, kinds: tuple[str, ...], least: int = 20, default: str = "observation", classifier: Callable[[Column], Column] | None = statement_kind, usage: Observation | None = None) -> DataFrame:
    """(source_file, domain, referent_time, content, node_type): a model's statements about each source (source_file, domain, text,
    referent_time), asked where the rows are. `[type] text` names its type; another line is classified. `usage` gets calls, input_tokens and
    output_tokens out of the job that the first action on the result runs.
    """

    def each(parts):
        for p in parts:
            prompts = [f"Extract distinct statements worth remembering, one a line, each as [type] text:\n{t}" for t in p["text"]]
            yield p.assign(asked=[len(x) // 4 for x in prompts], answer=[model_fn(x) for x in prompts]).drop(columns="text")

    asked = rows.select("source_file", "domain", F.col("referent_time").cast("string").alias("referent_time"), "text").mapInPandas(each, "source_file string, domain string, referent_time string, asked long, answer string")
    if usage is not None:
        told = F.sum(F.coalesce(F.length("answer"), F.lit(0)).cast("long").bitwiseAND(F.lit(-4)) / 4).cast("long")
        asked = asked.observe(usage, F.count(F.lit(1)).alias("calls"), F.sum("asked").alias("input_tokens"), told.alias("output_tokens"))
    lines = asked.select("source_file", "domain", "referent_time", F.explode(statement_lines("answer")).alias("line"))
    kind, content = typed_statement("line", kinds, classifier, default)
    return lines.select("source_file", "domain", "referent_time", content.alias("content"), kind.alias("node_type")).where(F.length("content") > least)


def usage_row(spark, path: str, operation: str, duration_ms: float, as_of, usage: dict) -> None:
    """Appends a row of token use to the recorded metrics, as `token_usage:<operation>`."""
    metrics.record(spark, path, f"token_usage:{operation}", duration_ms, as_of, **{k: int(usage.get(k) or 0) for k in ("calls", "input_tokens", "output_tokens")})


def migrated_by_model(graph: Graph, files: DataFrame, model_fn: Model, as_of, kinds: tuple[str, ...] = ("fact", "observation", "insight", "decision", "commitment", "belief"), encoder: Encoder | None = None, model: str = "hashing", novelty_at: float = 0.82, user: str = "user", assistant: str = "ai") -> tuple[Graph, dict]:
    """The model path of migrated(): its statements about each file that no node is from; with an encoder, those that a live node is at
    least as similar to as `novelty_at` are left out. Returns the state and a report: nodes, dropped as known, and the model's use.
    """
    usage = Observation()
    source = F.concat(F.lit("migration:"), "path")
    fresh = files.where(F.length("text") >= 100).withColumn("source_file", source).join(graph.nodes.select("source_file").distinct(), "source_file", "left_anti")
    told = told_by_model(fresh.select("source_file", F.lit(None).cast("string").alias("domain"), F.lit(None).cast("string").alias("referent_time"), "text"), model_fn, kinds, usage=usage)
    told = cut(told.withColumn("id", content_id("content")))
    rows = told.groupBy("id").agg(F.min(F.struct("source_file", "content", "node_type")).alias("f")).select("id", "f.*").withColumn("domain", domain_of_text(F.col("content"), user, assistant))
    rows, seen = counted_cut(rows.join(graph.nodes.select("id"), "id", "left_anti"))
    if encoder:
        vectors = cut(encoded(rows, encoder, model)).select(F.col("node_id").alias("cand_id"), "vector")
        rows = rows.join(novelty(graph, vectors, novelty_at).where("is_novel").select(F.col("cand_id").alias("id")), "id", "left_semi")
    now = F.lit(as_of).cast("timestamp")
    made = rows.withColumns({"ts": now, "access_count": F.lit(0), "decayed": F.lit(0), "permanent": F.lit(0), "metadata": F.lit("{}")})
    graph, new = _added(graph, normalize_nodes(made))
    new, kept = counted_cut(new)
    if encoder:
        graph, _ = _embedded(graph, new, encoder, model)
    return graph, {"nodes": kept["n"], "known": seen["n"] - kept["n"], **{k: int(v or 0) for k, v in usage.get.items()}}


def migrated(graph: Graph, files: DataFrame, as_of, user: str = "user", assistant: str = "ai", most: int = 20, least: int = 50, length: int = 500) -> tuple[Graph, int]:
    """Takes in files (path, text) that no node is from, of 100 characters or more: their first paragraphs over `least` characters
    without fences, rules and tables, white space collapsed and cut to `length`. Returns the state and how many nodes are new.
    """
    source = F.concat(F.lit("migration:"), "path")
    fresh = files.where(F.length("text") >= 100).withColumn("source_file", source).join(graph.nodes.select("source_file").distinct(), "source_file", "left_anti")
    parts = F.slice(F.filter(F.transform(F.split("text", "\n\n"), stripped), lambda p: F.length(p) > least), 1, most)
    each = fresh.select("source_file", F.explode(parts).alias("p")).where(~(F.startswith("p", F.lit("```")) | F.startswith("p", F.lit("---")) | F.startswith("p", F.lit("|"))))
    text = F.substring(stripped(F.regexp_replace("p", r"(?U)\s+", " ")), 1, length)
    rows = each.select("source_file", text.alias("content")).withColumn("domain", domain_of_text(F.col("content"), user, assistant))
    rows = rows.groupBy("content").agg(F.min(F.struct("source_file", "domain")).alias("f")).select("content", "f.*")
    now = F.lit(as_of).cast("timestamp")
    made = rows.withColumns({"id": content_id("content"), "node_type": F.lit("observation"), "ts": now, "access_count": F.lit(0), "decayed": F.lit(0), "permanent": F.lit(0), "metadata": F.lit("{}")})
    graph, new = _added(graph, normalize_nodes(made))
    return graph, new.count()
