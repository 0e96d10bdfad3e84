"""A host's view of a stored graph: each call loads the state, does one thing and saves what changed."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession, functions as F

from . import store
from .config import Settings, profile
from .operators import lifecycle, vector_index
from .operators.embed import Encoder, embed_missing, hashing_encoder
from .plans import context, session, sleep
from .schema import Graph
from .shared import file_system, written_text
from .sources import files
from .sources.registry import Registry

Model = Callable[[str], str]


class Brain:
    def __init__(self, spark: SparkSession, settings: Settings, encoder: Encoder | None = None, model_fn: Model | None = None, registry: Registry | None = None, folder: str | None = None):
        self.spark, self.settings, self.model_fn = spark, settings, model_fn
        self.encoder, self.registry, self.folder = encoder or hashing_encoder(), registry or Registry(), folder or settings.graph_path

    def graph(self) -> Graph:
        return store.load(self.spark, self.folder)

    def state(self) -> tuple[int, Graph]:
        """The number of the newest entry and its graph."""
        number = store.entry(self.spark, self.folder).number
        return number, store.load(self.spark, self.folder, number)

    def _kept(self, graph: Graph) -> None:
        store.save(graph, self.folder)

    def _vector(self, text: str) -> list[float]:
        return [float(x) for x in self.encoder([text])[0]]

    def session_context(self, as_of, hints: list[str] = (), domain=None, tags=None, exclude_tags=None) -> str:
        """The three-layer context; what it shows is counted as accessed."""
        query = self._vector(" ".join(hints)) if hints else None
        text, used, _, after = context.session_context(self.graph(), as_of, query, domain, tags, exclude_tags, self.settings.knobs())
        if used:
            self._kept(after)
        return text

    def domain_context(self, as_of, topic: str, domain: str | None = None) -> str:
        return self.session_context(as_of, [topic], self.settings.aliases().get(domain, domain))

    def user_context(self, as_of, topic: str) -> str:
        return self.domain_context(as_of, topic, "user")

    def ai_context(self, as_of, topic: str) -> str:
        return self.domain_context(as_of, topic, "ai")

    def work_context(self, as_of) -> str:
        return self.session_context(as_of, ["work", "projects", "career"])

    def personal_context(self, as_of) -> str:
        return self.session_context(as_of, ["personal", "life", "relationships"])

    def technical_context(self, as_of) -> str:
        return self.session_context(as_of, ["technical", "engineering", "systems"])

    def extract(self, text: str, as_of, **about) -> dict:
        after, report = session.end_session(self.graph(), text, as_of, self.model_fn, self.encoder, knobs=self.settings.knobs(), **about)
        if report["nodes"]:
            self._kept(after)
        return report

    def think(self, as_of, domain: str | None = None, seed: int = 0) -> int:
        if not self.model_fn:
            return 0
        after, n = session.think(self.graph(), self.model_fn, as_of, self.settings.knobs(), domain, seed, self.encoder)
        if n:
            self._kept(after)
        return n

    def tension(self, as_of, domain: str | None = None) -> list[str]:
        if not self.model_fn:
            return []
        after, made = session.tension(self.graph(), self.model_fn, as_of, domain, self.encoder)
        if made:
            self._kept(after)
        return made

    def sleep(self, as_of, **about) -> dict:
        after, report = sleep.cycle(self.graph(), profile(self.settings.embedding_model), as_of, self.settings.knobs(), self.settings.gc_mode, model_fn=self.model_fn, encoder=self.encoder, **about)
        self._kept(after)
        return {k: v for k, v in report.items() if k != "audit"}

    def ingest(self, name: str, path: str, as_of) -> dict:
        after, report = self.registry.run(name, self.graph(), path, as_of, self.model_fn, self.encoder)
        if report["created"]:
            self._kept(after)
        return report

    def pin(self, ids: list[str], level: int = 2) -> int:
        """Pins (2) or releases (0) nodes; how many there are of them."""
        read, graph = self.state()
        own = graph.nodes.where(F.col("id").isin(ids))
        n = own.count()
        if n:  # only these rows are written
            store.commit(self.spark, self.folder, read, {"nodes": lifecycle.pinned(own, ids, level)})
        return n

    def prune(self, as_of, apply: bool = False, days: int = 14) -> int:
        """How many nodes decay; with `apply` they do."""
        graph = self.graph()
        after, log = lifecycle.auto_decay(graph, as_of, days)
        n = log.count()
        if apply and n:
            self._kept(after)
        return n

    def embed(self) -> int:
        graph = self.graph()
        after = embed_missing(graph, self.encoder, "hashing")
        n = after.emb.count() - graph.emb.count()
        if n:
            self._kept(after)
        return n

    def index(self) -> vector_index.Index | None:
        """The vector index that was built last, if there is one."""
        made, there = file_system(self.spark, f"{self.folder}/_index/current.json")
        if not there.exists(made):
            return None
        return vector_index.opened(self.spark, self.spark.read.text(f"{self.folder}/_index/current.json", wholetext=True).first()[0])

    def indexed(self, rebuild: bool = False) -> dict:
        """Builds the index of all vectors, or adds to the one that is there what it lacks."""
        graph, found = self.graph(), self.index()
        if found is not None and not rebuild:
            return {"added": vector_index.backfill(found, graph.emb), "cells": len(found.centres), "probes": found.probes}
        new = vector_index.build(graph.emb, f"{self.folder}/_index/{uuid.uuid4().hex}")
        written_text(self.spark, f"{self.folder}/_index/current.json", new.folder)
        return {"added": graph.emb.count(), "cells": len(new.centres), "probes": new.probes}

    def backup(self, now: str) -> bool:
        from .config import retention_hours

        return files.backup(self.graph(), self.settings.backup_path, now, self.settings.due("backup"), retention_hours(self.settings.backup_keep))[0]

    def operate(self, operation: str, as_of, **about):
        """One of the operations by name: context, extract, think, tension, sleep, ingest, prune."""
        known = {"context": self.session_context, "extract": self.extract, "think": self.think, "tension": self.tension, "sleep": self.sleep, "ingest": self.ingest, "prune": self.prune}
        if operation not in known:
            raise ValueError(f"no such operation: {operation}; there are {', '.join(sorted(known))}")
        return known[operation](as_of=as_of, **about)
