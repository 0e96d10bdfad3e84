"""Sources as plug-ins: each turns a path into rows to take in; the registry runs them and keeps their state.

A plug-in's state is saved only after its rows are in the graph, so a run that fails is done again.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable, MutableMapping

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.embed import Encoder, embed_missing
from ..operators.ingest import ingested, relevant_turns, simple_archive
from ..schema import Graph
from ..shared import cut, file_system
from . import files


class Source(ABC):
    """`found` gives rows (content, and what there is of node_type, domain, source_file, referent_time)."""

    name = ""

    @abstractmethod
    def found(self, spark: SparkSession, path: str, model_fn: Callable[[str], str] | None) -> DataFrame: ...

    def state(self) -> DataFrame | None:
        """What has been read, as a table."""
        return None

    def restore(self, state: DataFrame | None) -> None:
        pass

    def after(self, graph: Graph, path: str) -> Graph:
        """What is to be done once the rows are in, such as edges."""
        return graph


class Notes(Source):
    """Markdown notes by their paragraphs; those read before at the same time or later are left out."""

    name = "notes"

    def __init__(self, ignore: list[str] = ()):
        self.ignore, self.seen, self.last = list(ignore), None, None

    def found(self, spark, path, model_fn=None):
        every = files.notes(spark, path, self.ignore)
        self.last = cut(every.select("path", "mtime"))
        return files.note_paragraphs(every if self.seen is None else every.join(self.seen, ["path", "mtime"], "left_anti"))

    def state(self):
        return _newest(self.seen, self.last, "path")

    def restore(self, state):
        self.seen = state


class Vault(Notes):
    """Notes with front matter, whose wikilinks become edges."""

    name = "vault"

    def after(self, graph, path):
        links = files.wikilink_edges(files.notes(graph.nodes.sparkSession, path, self.ignore), graph.nodes)
        fresh = links.join(graph.edges.select("parent_id", "child_id"), ["parent_id", "child_id"], "left_anti")
        return graph.with_(edges=graph.edges.unionByName(cut(fresh), allowMissingColumns=True))


class Sessions(Source):
    """Long messages of JSON line files, from the line on that was read last."""

    name = "sessions"

    def __init__(self):
        self.seen, self.last = None, None

    def found(self, spark, path, model_fn=None):
        self.last = cut(files.session_state(spark, path))
        upto = self.last.toDF("_path", "_last")  # lines that are written from now on wait for the next run
        lines = files.session_lines(spark, path, self.seen).join(upto, F.col("path") == F.col("_path")).where("at <= _last")
        rows = relevant_turns(lines, 100, "content")
        return rows.selectExpr("concat(role, ': ', content) AS content", "'conversations' AS domain", "concat('extractor:session:', regexp_extract(path, '([^/]+)[.]jsonl$', 1)) AS source_file", "timestamp AS referent_time")

    def state(self):
        return _newest(self.seen, self.last, "path")

    def restore(self, state):
        self.seen = state


class Archive(Source):
    """Turns of a chat archive's conversations that are new or updated."""

    name = "archive"

    def __init__(self):
        self.seen, self.last = None, None

    def found(self, spark, path, model_fn=None):
        stamps = spark.read.schema(files.ARCHIVE).option("multiLine", "true").json(path).where("uuid is not null")
        self.last = cut(stamps.groupBy("uuid").agg(F.max("updated_at").alias("updated_at")))
        return simple_archive(files.chat_archive(spark, path, self.seen)).selectExpr("content", "'conversations' AS domain", "concat('extractor:archive:', uuid) AS source_file")

    def state(self):
        return _newest(self.seen, self.last, "uuid")

    def restore(self, state):
        self.seen = state


def _newest(before: DataFrame | None, now: DataFrame | None, key: str) -> DataFrame | None:
    """The state now, and what only the state before knows."""
    if before is None or now is None:
        return now if before is None else before
    return now.unionByName(before.join(now.select(key), key, "left_anti").select(*now.columns))


class StateFolder(MutableMapping):
    """States kept in a folder: each a table of its own, in numbered versions of which the greatest whole one counts."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _versions(self, name: str) -> list[int]:
        made, store = file_system(self.spark, f"{self.folder}/{name}")
        found = [x.getPath().getName() for x in store.listStatus(made)] if store.exists(made) else []
        whole = lambda v: store.exists(file_system(self.spark, f"{self.folder}/{name}/{v}/_SUCCESS")[0])
        return sorted(int(v) for v in found if v.isdigit() and whole(v))

    def __getitem__(self, name):
        found = self._versions(name)
        if not found:
            raise KeyError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}/{found[-1]:08}")

    def __setitem__(self, name, state):
        found = self._versions(name)
        state.write.mode("overwrite").parquet(f"{self.folder}/{name}/{(found[-1] if found else 0) + 1:08}")
        for old in found[:-1]:
            made, store = file_system(self.spark, f"{self.folder}/{name}/{old:08}")
            store.delete(made, True)

    def __delitem__(self, name):
        made, store = file_system(self.spark, f"{self.folder}/{name}")
        if not store.delete(made, True):
            raise KeyError(name)

    def __iter__(self):
        made, store = file_system(self.spark, self.folder)
        return iter(sorted(x.getPath().getName() for x in store.listStatus(made)) if store.exists(made) else [])

    def __len__(self):
        return len(list(iter(self)))


class Registry:
    """Sources by name; `states` is where their states, tables, are kept: a dictionary, a StateFolder or anything that works like one."""

    def __init__(self, states: MutableMapping[str, DataFrame] | None = None):
        self.sources: dict[str, Source] = {}
        self.states = {} if states is None else states

    def register(self, source: Source) -> None:
        if not isinstance(source, Source):
            raise TypeError(f"not a source: {type(source).__name__}")
        if not source.name or source.name in self.sources:
            raise ValueError(f"a source needs a name of its own: {source.name!r}")
        self.sources[source.name] = source
        source.restore(self.states.get(source.name))

    def unregister(self, name: str) -> None:
        del self.sources[name]

    def get(self, name: str) -> Source:
        return self.sources[name]

    def names(self) -> list[str]:
        return list(self.sources)

    def run(self, name: str, graph: Graph, path: str, as_of, model_fn=None, encoder: Encoder | None = None, model: str = "hashing") -> tuple[Graph, dict]:
        """The state with a source's rows, and how many there were; an error is reported and leaves state and graph as they were."""
        if name not in self.sources:
            return graph, {"created": 0, "errors": [f"no source named {name}"]}
        source, spark = self.sources[name], graph.nodes.sparkSession
        try:
            new = cut(ingested(source.found(spark, path, model_fn), graph.nodes, name, as_of))
            after = source.after(graph.with_(nodes=graph.nodes.unionByName(new, allowMissingColumns=True)), path)
            if encoder:
                after = embed_missing(after, encoder, model)
            created = new.count()
        except Exception as failed:
            return graph, {"created": 0, "errors": [str(failed)]}
        state = source.state()
        if state is not None:
            self.states[name] = cut(state)
            source.restore(self.states[name])
        return after, {"created": created, "errors": []}

    def run_all(self, graph: Graph, path: str, as_of, **about) -> tuple[Graph, dict]:
        reports = {}
        for name in self.names():
            graph, reports[name] = self.run(name, graph, path, as_of, **about)
        return graph, reports
