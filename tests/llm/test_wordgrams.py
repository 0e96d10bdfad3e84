"""What op10's word model moves."""

import contextlib
import os
import threading

from graphloom.llm import common, perplexity


def test_quality_moves_its_ngrams_packed(spark):
    """The most that lies on disk while the word model is built and asked, in sizes of the documents table; nothing of a run stays but its checkpoints."""
    sf, stop, most = "/root/testdata/sf0.1", threading.Event(), [0]
    roots = [common.shared_dir(spark).removeprefix("file:"), *spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()]

    def used():
        total = 0
        for path in (os.path.join(d, f) for root in roots for d, _, files in os.walk(root) for f in files):
            with contextlib.suppress(OSError):
                total += os.path.getsize(path)
        return total

    folders = lambda: {d for root in roots for d, _, _ in os.walk(root) if "wordgrams-" in d}
    before, there = used(), folders()

    def watch():
        while not stop.wait(0.05):
            most[0] = max(most[0], used() - before)

    watcher = threading.Thread(target=watch)
    watcher.start()
    try:
        found = perplexity.classify(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")).count()
    finally:
        stop.set()
        watcher.join()
    assert found == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert most[0] < 6 * os.path.getsize(f"{sf}/documents.parquet"), most
    assert folders() <= there
