"""Language identification by multilingual mixtures of character n-grams.

Training counts hashed character trigrams per language over a bounded sample of
labelled documents. A document is a bag of trigrams; its languages are mixed in
unknown proportions, which expectation-maximisation estimates from the languages'
likelihoods of each trigram. The set of languages grows from the best single one
by the language that raises the likelihood most, as long as the gain exceeds a
penalty per language. The prediction is the language with the largest share.

The model has one row of 65,536 log-probabilities per language, so what is sent to
executors depends on the number of languages only. Prediction is one pass without a
shuffle, over whole texts.

Null text, text without a letter and any text of an untrained model give ``und``
with score 0. Ties go to the language that sorts first. Repeated rows give repeated
results; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from unicodedata import category

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citemill.llm.catalog import register
from citemill.llm.common import table

BUCKETS = 1 << 16
# Labelled documents of each language, in expectation, that train the model.
TRAIN_DOCUMENTS = 1500
PRIOR = 0.05
STEPS = 12
# Log-likelihood, as a multiple of log(n-grams), that one more language must gain.
PENALTY = 8.0
UNKNOWN = "und"


def trigram_ids(text: str) -> np.ndarray:
    """Hashed trigrams of letters; everything else is one space between words."""
    # Marks that stand on a letter belong to the word.
    plain = None if text.isascii() else "".join(
        [c if c.isalpha() or c > "\u02ff" and category(c)[0] == "M" else " " for c in text.lower()]
    )
    if plain is None:
        codes = np.frombuffer(text.lower().encode(), np.uint8).astype(np.uint32)
        codes[(codes < 97) | (codes > 122)] = 32
    else:
        codes = np.frombuffer(plain.encode("utf-32-le"), "<u4")
    codes = np.concatenate([[32], codes, [32]]).astype(np.uint32)
    codes = codes[np.concatenate([[True], (codes[1:] != 32) | (codes[:-1] != 32)])]
    if len(codes) < 3:
        return np.zeros(0, np.int64)
    mixed = codes[:-2] * np.uint32(0x9E3779B1) ^ codes[1:-1] * np.uint32(0x85EBCA6B) ^ codes[2:] * np.uint32(0xC2B2AE35)
    return ((mixed ^ (mixed >> np.uint32(15))) & np.uint32(BUCKETS - 1)).astype(np.int64)


def trigram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The different trigrams of a text and how often each occurs."""
    ids = trigram_ids(text)
    if len(ids) < 20_000:
        return np.unique(ids, return_counts=True)
    counts = np.bincount(ids, minlength=BUCKETS)
    found = np.flatnonzero(counts)
    return found, counts[found]


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            total = totals.setdefault(lang, np.zeros(BUCKETS, np.int64))
            ids, counts = trigram_counts(text)
            total[ids] += counts
    for lang, total in totals.items():
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(found), pa.string()), pa.array(found.astype(np.int32)), pa.array(total[found])],
            ["lang", "gram", "n"],
        )


def train(labelled: DataFrame, documents: int = TRAIN_DOCUMENTS) -> tuple[list[str], np.ndarray]:
    """Languages and their log-probabilities, from rows with text and lang.

    A language with more documents is sampled by a hash of the text, to about
    ``documents`` of them. At most 65,536 counts per language reach the driver.
    """
    rows = labelled.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("lang", "text")
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        return [], np.zeros((0, BUCKETS), np.float32)
    share: Column = F.lit(1.0)
    for lang in langs:
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, documents / sizes[lang]))).otherwise(share)
    chosen = F.pmod(F.xxhash64("text", F.lit("sample")), F.lit(1 << 20)) < share * (1 << 20)
    counted = rows.where(chosen).mapInArrow(_count_batches, "lang string, gram int, n long")
    summed = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts = np.zeros((len(langs), BUCKETS))
    for r in summed.toLocalIterator():
        counts[langs.index(r.lang), r.gram] = r.n
    counts += PRIOR
    return langs, np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32)


def fit_mixture(likelihoods: np.ndarray, counts: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, float]:
    """Proportions after expectation-maximisation, and the log-likelihood.

    ``likelihoods`` has a row per language, scaled per n-gram.
    """
    total = counts.sum()
    for _ in range(STEPS):
        joint = weights[:, None] * likelihoods
        weights = (joint * (counts / joint.sum(axis=0))).sum(axis=1) / total
    return weights, float(counts @ np.log(weights @ likelihoods))


def mixture(logs: np.ndarray, counts: np.ndarray) -> dict[int, float]:
    """Selected languages and their proportions, for one document's n-grams.

    ``logs`` has a row per language and a column per different n-gram.
    """
    scaled = logs - logs.max(axis=0)
    likelihoods = np.exp(scaled)
    chosen = [int(np.argmax(scaled @ counts))]
    weights, best = np.ones(1), float(scaled[chosen[0]] @ counts)
    penalty = PENALTY * math.log(counts.sum() + 1)
    while len(chosen) < len(logs):
        # What a first small share of each other language would gain.
        slope = (likelihoods / (weights @ likelihoods[chosen])) @ counts - counts.sum()
        slope[chosen] = -np.inf
        added = int(np.argmax(slope))
        if slope[added] <= 0:
            break
        start = np.append(weights * 0.9, 0.1)
        tried, value = fit_mixture(likelihoods[[*chosen, added]], counts, start)
        if value - best <= penalty:
            break
        chosen, weights, best = [*chosen, added], tried, value
    return dict(zip(chosen, weights.tolist()))


def certainty(logs: np.ndarray, counts: np.ndarray, chosen: dict[int, float]) -> float:
    """Posterior of the largest share's language, as the only one, among the languages that were not chosen.

    All languages are as likely at first. Each character is in three trigrams, so a third
    of the log-likelihood counts.
    """
    totals = (logs @ counts) / 3
    best = min(chosen, key=lambda k: (-chosen[k], k))
    others = np.array([total - totals[best] for k, total in enumerate(totals) if k not in chosen])
    return float(1 / (1 + np.exp(np.minimum(others, 700)).sum()))


def predict(text: str | None, langs: list[str], model: np.ndarray) -> tuple[dict[int, float], float]:
    """Languages of a text and their shares, and how certain the largest is; none without a letter.

    ``model`` has a row per n-gram.
    """
    if not text or not langs:
        return {}, 0.0
    grams, counts = trigram_counts(text)
    if not len(grams) or not any(map(str.isalpha, text)):
        return {}, 0.0
    logs, weights = model[grams].T.astype(np.float64), counts.astype(np.float64)
    found = mixture(logs, weights)
    return found, certainty(logs, weights, found)


def identify(docs: DataFrame, langs: list[str], logs: np.ndarray) -> DataFrame:
    """doc_id, lang_pred, score, langs (map of all shares).

    The score is the predicted language's share times the certainty that it is this
    language rather than one that was not found, so a short text has a low one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(logs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = np.ascontiguousarray(shared.value.T)
        for batch in batches:
            names, scores, shares = [], [], []
            for text in batch.column(1).to_pylist():
                found, sure = predict(text, langs, model)
                best = min(found, key=lambda k: (-found[k], k), default=None)
                names.append(UNKNOWN if best is None else langs[best])
                scores.append(0.0 if best is None else min(1.0, found[best]) * sure)
                shares.append([(langs[k], v) for k, v in sorted(found.items())])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).cast(pa.int64()),
                    pa.array(names, pa.string()),
                    pa.array(scores, pa.float64()),
                    pa.array(shares, pa.map_(pa.string(), pa.float64())),
                ],
                ["doc_id", "lang_pred", "score", "langs"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, lang_pred string, score double, langs map<string,double>"
    )


def with_language(docs: DataFrame, langs: list[str], logs: np.ndarray) -> DataFrame:
    """The rows of ``docs`` in which a language is found, with all their columns, in one pass."""
    shared = docs.sparkSession.sparkContext.broadcast(logs)
    text_at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = np.ascontiguousarray(shared.value.T)
        for batch in batches:
            found = [bool(predict(text, langs, model)[0]) for text in batch.column(text_at).to_pylist()]
            yield batch.filter(pa.array(found, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 5 == 0


def trained_on(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """The model of the documents that are not held out; a null doc_id is not used."""
    return train(docs.where(~held_out(F.col("doc_id"))))


@register("op5_language_mixture")
def op5_language_mixture(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return identify(docs, *trained_on(docs)).select(
        "doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score"
    )
