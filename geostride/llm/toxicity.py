"""Toxicity by a linear-chain conditional random field.

Tokens are tagged clean (0) or toxic (1). Unary weights come from a token's word, its prefix and its suffix, pair weights
from neighbouring tags; forward-backward gives each token's probability of the toxic tag, and a logistic curve over a
document's expected number of toxic tokens and its largest probability gives its score. Tokens with a probability of at
least 0.5 are the offending ones; `toxic_spans` gives their offsets.

The labels are of documents, so the tokens of the training sample are labelled first: a token of a toxic document is
toxic if its word is far more frequent among toxic than among clean documents. The sample has at most TOXIC toxic and
CLEAN clean documents, chosen by a hash of doc_id among the rows that may be learned from; four fifths fit the field, one
fifth the curve.

Forward and backward passes run over chunks of CHUNK tokens side by side: a chunk's product of 2x2 matrices carries the
message over it, so a text of any length takes as many steps as it has chunks, all chunks at once.

Defined cases: null and empty texts have no tokens and get the score of none; without labelled rows of both kinds every
score is the share of toxic ones (0 without any); conflicting labels of a document count as toxic; null labels and null
doc_ids are not learned from; repeated rows get equal results.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geostride.llm.memory import released
from geostride.llm.tokens import slices
from geostride.session import ship, table

#: Bounds of the training sample.
TOXIC, CLEAN = 1500, 3000
PREFIX, SUFFIX = 6, 5
#: A word labels tokens if so many toxic documents hold it and its odds there are so many times those in clean ones.
LEAST_DOCS, ODDS = 3, 12.0
EPOCHS, BATCH, RATE, DECAY = 4, 64, 0.5, 1e-4
CHUNK = 64
CACHE = 400_000
WORD = re.compile(r"[^\W_]+")


def chain_marginals(unary: np.ndarray, lengths: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For texts laid end to end: (p, r, b) of each token: probability of tag 1, and the forward and backward ratios of
    tag 1 to tag 0. pair: exponentials of the weights of tag pairs, [from, to]; a clean token stands before each text."""
    n = int(lengths.sum())
    if not n:
        return (np.zeros(0),) * 3
    chunks = -(-lengths // CHUNK)
    lanes = int(chunks.sum())
    first = np.concatenate([[0], np.cumsum(chunks)[:-1]])  # lane at which a text begins
    start = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    local = np.arange(n) - np.repeat(start, lengths)
    row, lane = local % CHUNK, np.repeat(first, lengths) + local // CHUNK
    e = np.ones((CHUNK, lanes))
    e[row, lane] = np.exp(np.clip(unary, -30, 30))
    live = np.zeros((CHUNK, lanes), bool)
    live[row, lane] = True
    (t00, t01), (t10, t11) = pair
    # products over each chunk; forward: alpha' = alpha (T psi), rows of P are the images of (1, 0) and (0, 1)
    a, b, c, d = (np.full(lanes, v) for v in (1.0, 0.0, 0.0, 1.0))
    for s in range(CHUNK):
        w, on = e[s], live[s]
        a2, b2, c2, d2 = a * t00 + b * t10, (a * t01 + b * t11) * w, c * t00 + d * t10, (c * t01 + d * t11) * w
        norm = np.maximum(np.maximum(a2, b2), np.maximum(c2, d2))
        a, b, c, d = (np.where(on, x / norm, y) for x, y in ((a2, a), (b2, b), (c2, c), (d2, d)))
    order = np.argsort(-chunks, kind="stable")
    counts = np.bincount(chunks, minlength=int(chunks.max()) + 1)
    alive = len(chunks) - np.cumsum(counts)  # texts with more than k chunks
    r_in, b_in = np.zeros(lanes), np.ones(lanes)
    r, back = np.zeros(len(chunks)), np.ones(len(chunks))
    for k in range(int(chunks.max())):
        t = order[: alive[k]]
        at = first[t] + k
        r_in[at] = r[t]
        r[t] = (b[at] + r[t] * d[at]) / (a[at] + r[t] * c[at])
        end = first[t] + chunks[t] - 1 - k
        b_in[end] = back[t]
        back[t] = (c[end] + d[end] * back[t]) / (a[end] + b[end] * back[t])
    fwd, bwd = np.zeros((CHUNK, lanes)), np.ones((CHUNK, lanes))
    x, y = r_in, b_in
    for s in range(CHUNK):
        x = np.where(live[s], e[s] * (t01 + x * t11) / (t00 + x * t10), x)
        fwd[s] = x
        z = CHUNK - 1 - s
        bwd[z] = y
        y = np.where(live[z], (t10 + t11 * e[z] * y) / (t00 + t01 * e[z] * y), y)
    r_all, b_all = fwd[row, lane], bwd[row, lane]
    odds = r_all * b_all
    return odds / (1 + odds), r_all, b_all


@dataclass
class Model:
    word: dict[str, float] = field(default_factory=dict)
    prefix: dict[str, float] = field(default_factory=dict)
    suffix: dict[str, float] = field(default_factory=dict)
    bias: float = -6.0
    pair: np.ndarray = field(default_factory=lambda: np.ones((2, 2)))
    curve: tuple[float, float, float] = (0.0, 0.0, 0.0)
    base: float | None = None  # the score of every text, where nothing could be learned
    known: dict[str, float] = field(default_factory=dict)

    def __getstate__(self):
        return self.__dict__ | {"known": {}}

    def unary(self, words: list[list[str]]) -> np.ndarray:
        if len(self.known) > CACHE:
            self.known = {}
        known, w, p, s = self.known, self.word.get, self.prefix.get, self.suffix.get
        new = {x for ws in words for x in ws if x not in known}
        for x in new:
            known[x] = self.bias + w(x, 0.0) + p(x[:PREFIX], 0.0) + s(x[-SUFFIX:], 0.0)
        return np.fromiter((known[x] for ws in words for x in ws), float, sum(map(len, words)))

    def marginals(self, words: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        lengths = np.array([len(ws) for ws in words], int)
        return chain_marginals(self.unary(words), lengths, self.pair)[0], lengths

    def scores(self, words: list[list[str]]) -> np.ndarray:
        if self.base is not None:
            return np.full(len(words), self.base)
        p, lengths = self.marginals(words)
        return 1 / (1 + np.exp(-_evidence(p, lengths) @ np.array(self.curve)))


def _evidence(p: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """(1, log(1 + expected toxic tokens), largest probability) of each text."""
    total, most = np.zeros(len(lengths)), np.zeros(len(lengths))
    some = lengths > 0
    if some.any():
        at = (np.cumsum(lengths) - lengths)[some]
        total[some], most[some] = np.add.reduceat(p, at), np.maximum.reduceat(p, at)
    return np.stack([np.ones(len(lengths)), np.log1p(total), most], 1)


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def token_labels(words: list[list[str]], toxic: np.ndarray) -> list[np.ndarray]:
    """Tags of the tokens, from the labels of their documents."""
    held = [Counter(), Counter()]
    for ws, y in zip(words, toxic, strict=True):
        held[y].update(set(ws))
    n = [max(1, int((toxic == 0).sum())), max(1, int((toxic == 1).sum()))]
    marks = {w for w, k in held[1].items() if k >= LEAST_DOCS and (k + 0.1) / n[1] >= ODDS * (held[0][w] + 0.5) / n[0]}
    return [np.fromiter((y and w in marks for w in ws), bool, len(ws)) for ws, y in zip(words, toxic, strict=True)]


def train(texts: list[str | None], toxic: list[int], seed: int = 5) -> Model:
    y = np.array(toxic, int)
    if not len(y) or y.min() == y.max():
        return Model(base=float(y.mean()) if len(y) else 0.0)
    words = [words_of(t) for t in texts]
    held = np.arange(len(y)) % 5 == 4
    if len(set(y[held])) < 2:
        held[:] = False
    fitted = np.flatnonzero(~held)
    tags = token_labels([words[k] for k in fitted], y[fitted])
    tag_of = dict(zip(fitted.tolist(), tags, strict=True))
    kinds: list[dict[str, int]] = [{}, {}, {}]
    size = 0
    ids: dict[str, tuple[int, int, int]] = {}
    for k in fitted:
        for w in words[k]:
            if w not in ids:
                own = []
                for kind, part in zip(kinds, (w, w[:PREFIX], w[-SUFFIX:]), strict=True):
                    if part not in kind:
                        kind[part] = size
                        size += 1
                    own.append(kind[part])
                ids[w] = tuple(own)
    theta, bias, pair = np.zeros(size), -4.0, np.zeros((2, 2))
    g2, bias2, pair2 = np.full(size, 1e-8), 1e-8, np.full((2, 2), 1e-8)
    rng = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        mixed = rng.permutation(fitted)
        for at in range(0, len(mixed), BATCH):
            batch = [k for k in mixed[at : at + BATCH] if words[k]]
            if not batch:
                continue
            feats = np.array([ids[w] for k in batch for w in words[k]])
            gold = np.concatenate([tag_of[k] for k in batch]).astype(float)
            lengths = np.array([len(words[k]) for k in batch])
            u = bias + theta[feats].sum(1)
            t = np.exp(pair)
            p, r, b = chain_marginals(u, lengths, t)
            diff = gold - p
            grad = np.zeros(size)
            for c in range(3):
                grad += np.bincount(feats[:, c], diff, size)
            grad -= DECAY * theta * len(gold) / BATCH
            # pairs inside a text
            inside = np.ones(len(gold), bool)
            inside[np.cumsum(lengths) - 1] = False
            i = np.flatnonzero(inside)
            e = np.exp(np.clip(u[i + 1], -30, 30)) * b[i + 1]
            joint = np.stack([np.full(len(i), t[0, 0]), t[0, 1] * e, r[i] * t[1, 0], r[i] * t[1, 1] * e])
            expected = (joint / joint.sum(0)).sum(1).reshape(2, 2)
            seen = np.bincount((2 * gold[i] + gold[i + 1]).astype(int), minlength=4).reshape(2, 2)
            gp = (seen - expected) / BATCH
            gb = diff.sum() / BATCH
            grad /= BATCH
            g2 += grad**2
            bias2 += gb**2
            pair2 += gp**2
            theta += RATE * grad / np.sqrt(g2)
            bias += RATE * gb / np.sqrt(bias2)
            pair = np.clip(pair + RATE * gp / np.sqrt(pair2), -4, 4)
    parts = [{w: float(theta[k]) for w, k in kind.items() if abs(theta[k]) > 1e-3} for kind in kinds]
    model = Model(*parts, float(bias), np.exp(pair))
    check = np.flatnonzero(held) if held.any() else fitted
    x = _evidence(*model.marginals([words[k] for k in check]))
    model.curve = tuple(_logistic(x, y[check]))
    return model


def _logistic(x: np.ndarray, y: np.ndarray, steps: int = 50) -> np.ndarray:
    """Newton's steps on the penalised likelihood."""
    w, penalty = np.zeros(x.shape[1]), np.diag([1e-3, 0.05, 0.05])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w = w + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
    return w


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Learn from the labelled rows that are not held out."""
    own = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull() & ~held_out(F.col(key))).groupBy(F.col(key).alias("key")).agg(F.max(label).cast("int").alias("y"))
    counts = {r["y"]: r["n"] for r in own.groupBy("y").agg(F.count("*").alias("n")).collect()}
    order = F.pmod(F.xxhash64(F.lit("toxic"), "key"), F.lit(1 << 40)) / (1 << 40)
    most = {1: TOXIC, 0: CLEAN}
    share = F.when(F.col("y") == 1, min(1.0, (1.2 * TOXIC + 20) / counts.get(1, 1))).otherwise(min(1.0, (1.2 * CLEAN + 20) / counts.get(0, 1)))
    chosen = own.withColumn("order", order).filter(F.col("order") < share).toPandas().sort_values(["order", "key"])
    chosen = chosen.groupby("y", sort=False, group_keys=False).head(max(most.values()))
    chosen = chosen[[k < most.get(y, 0) for k, y in zip(chosen.groupby("y").cumcount(), chosen["y"], strict=True)]]
    if chosen.empty:
        return train([], [])
    # at most TOXIC + CLEAN ids: a table of known size
    ids = docs.sparkSession.createDataFrame([(int(k), int(y), float(o)) for k, y, o in zip(chosen["key"], chosen["y"], chosen["order"], strict=True)], "key long, y int, order double")
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(ids), "key")
    # one text of each, however many rows repeat its doc_id
    rows = rows.groupBy("key", "y", "order").agg(F.min("text").alias("text")).toPandas().sort_values(["order", "key"], kind="stable")
    return train(rows["text"].tolist(), rows["y"].tolist())


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score, predicted)."""
    ship(docs.sparkSession)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in slices(texts, 1_000_000):
                s = model.scores([words_of(t) for t in texts[a:b]])
                yield pa.record_batch([batch.column(0).slice(a, b - a), pa.array(s), pa.array((s >= 0.5).astype("i4"))], [key, "score", "predicted"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(released(scored), f"`{key}` {kind}, score double, predicted int")


def toxic_spans(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", least: float = 0.5) -> DataFrame:
    """(key, start, end, probability): runs of offending tokens, in code points, end exclusive."""
    ship(docs.sparkSession)

    def tagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                # offsets are of the text itself; a letter whose lower case is longer is taken as it is
                low = "".join(c.lower() if len(c.lower()) == 1 else c for c in t or "")
                found = list(WORD.finditer(low))
                if not found or model.base is not None:
                    continue
                p, _ = model.marginals([[m[0] for m in found]])
                runs: list[list[float]] = []
                last = -2
                for i in np.flatnonzero(p >= least):
                    if i == last + 1:
                        runs[-1][1:] = [found[i].end(), max(runs[-1][2], p[i])]
                    else:
                        runs.append([found[i].start(), found[i].end(), p[i]])
                    last = i
                if runs:
                    s, e, q = zip(*runs, strict=True)
                    yield pa.record_batch([pa.array([k] * len(runs), batch.schema.field(0).type), pa.array(s, pa.int32()), pa.array(e, pa.int32()), pa.array(q, pa.float64())], [key, "start", "end", "probability"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(released(tagged), f"`{key}` {kind}, start int, end int, probability double")


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
