"""Language ID: averaged hashed subword embeddings with a linear softmax, trained by stochastic gradient descent in
numpy, with calibrated rejection.

A text's subwords are the byte 3-grams and 4-grams of its lower-cased letters (other ASCII signs count as one space),
hashed into BUCKETS; its embedding is their average over the whole text. Training sees every language, at most
PER_LANGUAGE texts of each (fewer where that makes more than SAMPLE), chosen by a hash of doc_id and text among the rows
that may be learned from; a fifth of them sets the temperature of the scores and the score under which a prediction is
rejected (the REJECT share of right predictions lies under it, and it is never over MOST_REJECT).

Defined cases: null texts and texts without a letter are `und` with score 0 and rejected; without anything to learn from,
every text is `und`; with one language every other text has it with score 1; null doc_ids are neither learned from nor
held out; repeated rows get equal results; extra columns pass through `accepted_documents`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geostride.llm.memory import released
from geostride.llm.tokens import slices
from geostride.session import ship, table

BUCKETS, DIM = 1 << 15, 16
#: Bounds of the training sample: texts of a language, and of all. Every language has one text at least.
PER_LANGUAGE, SAMPLE = 800, 160_000
EPOCHS, RATE = 4, 2.0
REJECT, MOST_REJECT = 0.001, 0.4
UNKNOWN = "und"
#: Lower-case ASCII letters and all bytes of other characters stay; everything else is a space.
FOLD = np.array([b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256)], np.uint8)


def flat_bytes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, each with spaces around it; the place where each begins and the end of the last)."""
    # three spaces on each side: no subword reaches into the next text
    parts = [b"   " + t.lower().encode("utf-8", "replace") + b"   " for t in texts]
    return FOLD[np.frombuffer(b"".join(parts), np.uint8)], np.cumsum([0, *map(len, parts)])


def subwords(flat: np.ndarray) -> list[np.ndarray]:
    """Buckets of the 3-grams and 4-grams that begin at each place (spaces follow every text, so the last few of a
    text lie in them)."""
    x = np.concatenate([flat, np.full(4, 32, np.uint8)]).astype(np.uint32)
    n = len(flat)
    with np.errstate(over="ignore"):
        three = x[:n] * np.uint32(2654435761) ^ x[1 : n + 1] * np.uint32(2246822519) ^ x[2 : n + 2] * np.uint32(3266489917)
        four = three * np.uint32(668265263) + x[3 : n + 3] * np.uint32(374761393)
        return [((g ^ g >> np.uint32(15)) * np.uint32(2246822519) >> np.uint32(17)) & np.uint32(BUCKETS - 1) for g in (three, four)]


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # bucket -> its part of each language's logit: embedding times softmax weights
    temperature: float
    least: float  # a prediction with a lower score is rejected

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        known = [k for k, t in enumerate(texts) if t and any(map(str.isalpha, t))]
        names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if known and self.languages:
            p = _softmax(self.logits([texts[k] for k in known]) / self.temperature)
            best = p.argmax(1)
            for k, b in zip(known, best.tolist(), strict=True):
                names[k] = self.languages[b]
            scores[known] = p[np.arange(len(best)), best]
        return names, scores

    def logits(self, texts: list[str]) -> np.ndarray:
        flat, ends = flat_bytes(texts)
        total = np.zeros((len(texts), len(self.languages)))
        for grams in subwords(flat):
            for k in range(len(self.languages)):
                total[:, k] += np.add.reduceat(self.table[:, k][grams], ends[:-1], dtype=float)
        return total / (2 * np.diff(ends))[:, None]


def train(texts: list[str], names: list[str], seed: int = 11) -> Model:
    """Stochastic gradient descent on the cross entropy, one text at a time."""
    languages = sorted(set(names))
    if not languages:
        return Model([], np.zeros((BUCKETS, 0), np.float32), 1.0, 0.0)
    y = np.array([languages.index(n) for n in names])
    bags = []
    for t in texts:
        grams, n = np.unique(np.concatenate(subwords(flat_bytes([t])[0])), return_counts=True)
        bags.append((grams, (n / n.sum()).astype(np.float32)))
    held = np.arange(len(texts)) % 5 == 4
    # a language with all its texts held would not be learned
    held &= np.isin(y, y[~held])
    rng = np.random.default_rng(seed)
    embedding = (rng.standard_normal((BUCKETS, DIM)) / np.sqrt(DIM)).astype(np.float32)
    weights = np.zeros((DIM, len(languages)), np.float32)
    learned = np.flatnonzero(~held) if (~held).any() else np.arange(len(texts))
    steps, step = EPOCHS * len(learned), 0
    for _ in range(EPOCHS):
        for k in rng.permutation(learned):
            grams, share = bags[k]
            rate = RATE * (1 - step / steps)
            hidden = share @ embedding[grams]
            g = _softmax(hidden @ weights)
            g[y[k]] -= 1
            back = weights @ g
            weights -= rate * np.outer(hidden, g)
            # an average's gradient is spread over its subwords; scaled so that a text moves its embedding by `rate`
            embedding[grams] -= rate * (share / (share @ share))[:, None] * back * np.float32(0.1)
            step += 1
    logit = embedding @ weights
    model = Model(languages, np.ascontiguousarray(logit), 1.0, 0.0)
    check = np.flatnonzero(held) if held.any() else learned
    z = model.logits([texts[k] for k in check])
    right = y[check]
    # the temperature at which the mean score is the share of right predictions, as one more right and one more wrong make it
    share = ((z.argmax(1) == right).sum() + 1) / (len(check) + 2)
    model.temperature = float(min(np.geomspace(0.02, 20, 200), key=lambda t: abs(_softmax(z / t).max(1).mean() - share)))
    p = _softmax(z / model.temperature)
    sure = p.max(1)[p.argmax(1) == right]
    model.least = float(min(MOST_REJECT, np.quantile(sure, REJECT))) if len(sure) else 0.0
    return model


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """Learn from the rows with a language that are not held out."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang")).filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("key").isNotNull() & ~held_out(F.col("key")))
    # one row a language
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").collect()}
    if not counts:
        return train([], [])
    most = min(PER_LANGUAGE, max(1, SAMPLE // len(counts)))
    # of key and text, so that rows that repeat a key are sampled each by itself; equal rows are one
    order = F.pmod(F.xxhash64(F.lit("langid"), "key", "text"), F.lit(1 << 40)) / (1 << 40)
    share = F.create_map(*(F.lit(x) for lang_, n in counts.items() for x in (lang_, min(1.0, 1.3 * most / n + 20 / n))))
    sample = rows.withColumn("order", order).filter(F.col("order") < F.element_at(share, F.col("lang"))).dropDuplicates(["key", "text", "lang"]).toPandas()
    sample = sample.sort_values(["order", "key", "text"], kind="stable").groupby("lang", sort=False).head(most)
    return train(sample["text"].tolist(), sample["lang"].tolist())


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds lang_pred, score and rejected to the rows."""
    ship(docs.sparkSession)
    columns = [f for f in docs.schema.fields if f.name not in ("lang_pred", "score", "rejected")]
    names = [f.name for f in columns]
    at = names.index(text)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in columns), "lang_pred string, score double, rejected boolean"])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            for a, b in slices(texts, 500_000):
                languages, scores = model.predict(texts[a:b])
                part = batch.slice(a, b - a)
                rejected = [x == UNKNOWN or s < model.least for x, s in zip(languages, scores, strict=True)]
                yield pa.record_batch([*part.columns, pa.array(languages, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())], [*names, "lang_pred", "score", "rejected"])

    return docs.select(*names).mapInArrow(released(scored), schema)


def accepted_documents(docs: DataFrame, **columns) -> DataFrame:
    """The documents whose language is predicted with a score that isn't rejected, with their own columns."""
    plain = docs.withColumnsRenamed({c: f"_in_{c}" for c in ("lang_pred", "score", "rejected") if c in docs.columns})
    kept = predict(plain, fit(docs, **columns), columns.get("text", "text")).filter("not rejected").drop("lang_pred", "score", "rejected")
    return kept.withColumnsRenamed({f"_in_{c}": c for c in ("lang_pred", "score", "rejected") if c in docs.columns}).select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    rows = predict(docs.select("doc_id", "text"), fit(docs))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
