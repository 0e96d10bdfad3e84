"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model of trusted text, the word trigrams of wordgrams.py.

Trusted documents are those labelled good and not toxic; all of them count. One in CALIBRATE does not train: of
these, the threshold of a language is the QUANTILE of its perplexities, drawn towards that of all languages as if FEW
documents had it (the mean of the logarithms), so it moves little by little as the table grows; a language without any
has that of all. A document is kept if its perplexity is at most the threshold.

Defined results: null or empty text is only its end word and is not kept; a null language is "und"; a doc_id with
several labels is trusted if all of them are good; without trusted text, perplexity and threshold are null and
nothing is rejected. Other columns are ignored; repeated rows are scored alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from . import wordgrams
from .common import cut

CALIBRATE, QUANTILE, FEW, FEW_IDS = 5, 0.995, 50, 1 << 22


def classify(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """doc_id, lang, perplexity, threshold and keep of every row."""
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("marked_id")).agg(F.min("quality").alias("good"), F.max("toxic").alias("bad"))
    good = marks.where("good = 1 and coalesce(bad, 0) = 0 and marked_id is not null").select("marked_id")
    fold = F.pmod(F.xxhash64("marked_id"), F.lit(CALIBRATE))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    trained = cut(good.where(fold != 0))
    trained = F.broadcast(trained) if trained.count() <= FEW_IDS else trained.hint("shuffle_hash")  # beyond, the texts move once and are not sorted
    rows = wordgrams.scored(docs, texts.join(trained, F.col("doc_id") == F.col("marked_id"), "left_semi"))
    held = rows.join(good.where(fold == 0), F.col("doc_id") == F.col("marked_id"), "left_semi").where("chars > 0")
    pick = F.percentile_approx("perplexity", quantile, 10_000).alias("limit")
    every = held.agg(pick).select(F.col("limit").alias("general"))
    own = held.groupBy("lang").agg(pick, F.count("*").alias("n"))
    drawn = F.exp((F.col("n") * F.log("limit") + FEW * F.log("general")) / (F.col("n") + FEW))
    out = rows.join(F.broadcast(every), how="left").join(own, "lang", "left").withColumn("threshold", F.coalesce(drawn, "general"))
    keep = (F.col("chars") > 0) & F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True))
    return out.select("doc_id", "lang", "perplexity", "threshold", keep.alias("keep"))
