"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A text is cut into windows of WINDOW words (all of them, to its end). A window's vector is the
mean of its words' vectors (a repeated word adds nothing, a short window is padded), a word's
the mean of its hashed character n-gram embeddings; a linear softmax reads it. The text scores
as its most toxic window. Embeddings and softmax are trained together by gradient steps on the
labelled sample, each document by the window that scores highest at the time, starting from
the n-grams' log-odds of occurring in toxic documents. A logistic fit on texts that a second
model wasn't trained on calibrates the score.
Because the model is linear after the embeddings, scoring needs one number per n-gram bucket.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiforge.llm.common import documents, forget, materialize

WINDOW = 32
BUCKETS = 1 << 17
DIM = 6
EPOCHS = 15
#: Bound of the training sample: documents of each class, taken by the hash of their id.
SAMPLE = 800
#: Bound of what the sample holds in all, in windows: where its texts have more, the longest are trained on by
#: as many windows as fit, drawn from all of the text. Every text is scored whole.
SAMPLE_WINDOWS = 200_000
SEED = 11
#: Words whose scores a task remembers, the first it meets, and texts held as Python objects at a time.
CACHE, ROWS = 300_000, 64

_WORD = re.compile(r"[^\W\d_]+")


def grams(word: str) -> list[int]:
    """Buckets of the word's n-grams of 3 to 5 characters, with its bounds marked."""
    w = f"<{word[:60]}>" if len(word) <= 60 else f"<{word}>"
    out = [crc32(w[i : i + n].encode()) % BUCKETS for n in (3, 4, 5) for i in range(len(w) - n + 1)]
    return out or [crc32(w.encode()) % BUCKETS]


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def windows(items: list) -> Iterator[list]:
    """Windows end to end; the last one reaches back to full length where it can."""
    for i in range(0, len(items), WINDOW):
        yield items[max(0, min(i, len(items) - WINDOW)) : i + WINDOW]


@dataclass
class Model:
    """weight: what each n-gram bucket adds to the toxic logit; then logit = bias + mean; the
    document's probability is the logistic of slope * asinh(logit) + shift (logits have long tails). A text without words scores
    ``prior``, the toxic share."""

    weight: np.ndarray
    bias: float
    slope: float
    shift: float
    prior: float = 0.5


def fit(texts: list[str], labels: list[int], share: float | None = None, epochs: int = EPOCHS, seed: int = SEED) -> Model:
    """Train on labelled texts; ``share`` is the positive class's share in the population
    (default: in the sample). The calibration reads each half of the texts by a model trained
    on the other half; the final model is trained on all."""
    model = _fit(texts, labels, share, epochs, seed)
    halves = [range(k, len(texts), 2) for k in (0, 1)]
    if len(texts) >= 80 and model.slope and all(0 < sum(labels[i] for i in h) < len(h) for h in halves):
        logit = np.zeros(len(texts))
        for own, other in (halves, halves[::-1]):
            half = Scorer(_fit([texts[i] for i in own], [labels[i] for i in own], share, epochs, seed))
            logit[other] = [half.logit(texts[i]) for i in other]
        y, share = np.array(labels, dtype=np.float64), model.prior
        model.slope, model.shift = _calibrate(np.arcsinh(logit), y, np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean())))
    return model


def _fit(texts: list[str], labels: list[int], share: float | None, epochs: int, seed: int) -> Model:
    """One training. Without both classes: a constant score of the (smoothed) share."""
    y = np.array(labels, dtype=np.float64)
    if len(set(labels)) < 2:
        p = (y.sum() + 0.5) / (len(y) + 1)
        p = min(max(share if share is not None else p, 0.01), 0.99)
        return Model(np.zeros(BUCKETS, np.float32), 0.0, 0.0, float(np.log(p / (1 - p))), p)
    index: dict[str, int] = {}
    tokens, starts, owner, counts, kept = (array("q") for _ in range(5))
    at = 0
    for d, text in enumerate(texts):
        ids = [index.setdefault(w, len(index)) for w in words(text)]
        for part in windows(ids):
            starts.append(at)
            counts.append(WINDOW)  # a short window is padded: few words say little
            owner.append(d)
            once = list(dict.fromkeys(part))  # a word counts once in a window: repeats aren't insults
            tokens.extend(once)
            kept.append(len(once))
            at += len(once)
    if not len(tokens):
        return _fit([], [], share, epochs, seed)
    tokens, starts, owner, counts, kept = (np.frombuffer(x, dtype=np.int64) for x in (tokens, starts, owner, counts, kept))
    flat, sizes = array("q"), array("q")
    for w in index:
        own = grams(w)
        flat.extend(own)
        sizes.append(len(own))
    flat, sizes = np.frombuffer(flat, dtype=np.int64), np.frombuffer(sizes, dtype=np.int64)
    used, flat = np.unique(flat, return_inverse=True)
    gram_at = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 0.05, (len(used), DIM)).astype(np.float32)
    soft = rng.normal(0, 0.05, (DIM, 2)).astype(np.float32)
    emb[:, 0] = _log_odds(np.repeat(owner, kept), tokens, flat, gram_at, sizes, y, len(used))
    soft[0] = -0.5, 0.5
    bias = np.zeros(2, np.float32)
    state = [np.zeros_like(x) for x in (emb, soft, bias)]
    docs_with = np.unique(owner)
    first = np.searchsorted(owner, docs_with)
    yd = y[docs_with]
    weight_d = np.where(yd == 1, 0.5 / yd.mean(), 0.5 / (1 - yd.mean())).astype(np.float32) / len(yd)
    scale = np.float32(WINDOW)

    def forward():
        vec = np.stack([np.add.reduceat(col[flat], gram_at) for col in emb.T.copy()], 1) / sizes[:, None].astype(np.float32)
        lean = vec @ (soft[:, 1] - soft[:, 0]) * scale
        logit = np.add.reduceat(lean[tokens], starts) / counts + (bias[1] - bias[0])
        top = np.maximum.reduceat(logit, first)
        hit = np.flatnonzero(logit == np.repeat(top, np.diff(np.append(first, len(logit)))))
        _, one = np.unique(owner[hit], return_index=True)
        return vec, logit, hit[one]

    for t in range(1, epochs + 1):
        vec, logit, chosen = forward()
        span = np.concatenate([np.arange(s, s + c) for s, c in zip(starts[chosen], kept[chosen])])
        word_of, win = tokens[span], np.repeat(np.arange(len(chosen)), kept[chosen])
        share_of = (1 / counts[chosen])[win].astype(np.float32)
        mean = np.stack([np.bincount(win, share_of * vec[word_of, k], len(chosen)) for k in range(DIM)], 1).astype(np.float32) * scale
        p = 1 / (1 + np.exp(-np.clip(logit[chosen], -30, 30)))
        g = ((p - yd) * weight_d).astype(np.float32)
        both = np.stack([-g, g], 1)
        g_soft, g_bias = mean.T @ both + 1e-5 * soft, both.sum(0)
        pull = both @ soft.T * scale
        g_vec = np.stack([np.bincount(word_of, share_of * pull[win, k], len(sizes)) for k in range(DIM)], 1).astype(np.float32)
        g_vec /= sizes[:, None]
        hot = np.unique(word_of)
        rows = np.concatenate([np.arange(a, a + n) for a, n in zip(gram_at[hot], sizes[hot])])
        g_emb = np.stack([np.bincount(flat[rows], np.repeat(g_vec[hot, k], sizes[hot]), len(used)) for k in range(DIM)], 1).astype(np.float32)
        for x, grad, speed, m in zip((emb, soft, bias), (g_emb, g_soft, g_bias), (0.4, 0.05, 0.05), state):
            m *= 0.5
            m += grad
            x -= speed * m / (np.abs(m).max() + 1e-12)  # in proportion to support: rare n-grams move little
    _, logit, chosen = forward()
    share = float(yd.mean()) if share is None else share
    slope, shift = _calibrate(np.arcsinh(logit[chosen]), yd, np.where(yd == 1, share / yd.mean(), (1 - share) / (1 - yd.mean())))
    weight = np.zeros(BUCKETS, np.float32)
    weight[used] = emb @ (soft[:, 1] - soft[:, 0]) * scale
    return Model(weight, float(bias[1] - bias[0]), slope, shift, share)


def _log_odds(doc: np.ndarray, tokens: np.ndarray, flat: np.ndarray, gram_at: np.ndarray, sizes: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    """Log-odds, per n-gram, of the documents that contain it, smoothed and less a standard
    error, so that chance n-grams start from nothing."""
    hits = np.zeros((2, n))
    for d in np.unique(doc):  # a document counts once per n-gram
        words_of = np.unique(tokens[slice(*np.searchsorted(doc, (d, d + 1)))])
        size = sizes[words_of]
        at = np.repeat(gram_at[words_of] - np.cumsum(size) + size, size) + np.arange(size.sum())
        hits[int(y[d]), np.unique(flat[at])] += 1
    total = np.array([(y == 0).sum(), (y == 1).sum()])
    odds = np.log((hits[1] + 3) / (total[1] + 6)) - np.log((hits[0] + 3) / (total[0] + 6))
    error = np.sqrt(1 / (hits[1] + 3) + 1 / (hits[0] + 3))
    return (np.sign(odds) * np.maximum(np.abs(odds) - error, 0)).astype(np.float32)


def _calibrate(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """Weighted logistic fit of y on x with a slight ridge, by Newton steps."""
    spread = x.std() or 1.0
    z = np.stack([x / spread, np.ones_like(x)], 1)
    beta = np.zeros(2)
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        grad = z.T @ (w * (p - y)) + 0.05 * beta
        hess = (z * (w * p * (1 - p))[:, None]).T @ z + 0.05 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        beta -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0] / spread), float(beta[1])


class Scorer:
    def __init__(self, model: Model, cache: int | None = None):
        self.model, self.known, self.cache = model, {}, CACHE if cache is None else cache

    def word(self, w: str) -> float:
        got = float(self.model.weight[grams(w)].mean())
        if len(self.known) < self.cache:
            self.known[w] = got
        return got

    def logit(self, text: str | None) -> float:
        known, top = self.known, 0.0
        own = words(text)
        for i, part in enumerate(windows(own)):
            mean = sum([known[w] if w in known else self.word(w) for w in set(part)]) / WINDOW
            top = mean if i == 0 or mean > top else top
        return self.model.bias + top

    def score(self, text: str | None) -> float:
        m = self.model
        if not _WORD.search(text or ""):
            return m.prior
        logit = self.logit(text)
        return float(1 / (1 + np.exp(-np.clip(m.slope * np.arcsinh(logit) + m.shift, -700, 700))))


def held_out(doc_id: Column) -> Column:
    """Rows kept from training: crc32 of the id as text, modulo 5, is 0 (null id: of "")."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def n_windows(text: str | None) -> int:
    return -(-len(words(text)) // WINDOW)


def drawn_windows(text: str, limit: int, seed: int) -> str:
    """``text`` if it has ``limit`` windows or fewer, else the words of so many windows, a seeded
    draw over the whole text in its order."""
    n = n_windows(text)
    if n <= limit:
        return text
    own = list(windows(words(text)))
    picked = np.sort(np.random.default_rng((SEED, seed)).choice(n, limit, replace=False))
    return " ".join(w for i in picked for w in own[i])


def fair_limit(counts: list[int], total: int) -> int:
    """The highest limit, 1 at least, such that the counts, cut at it, sum to ``total`` at most."""
    left = total
    for i, n in enumerate(ordered := sorted(counts)):
        if n * (len(ordered) - i) > left:
            return max(1, left // (len(ordered) - i))
        left -= n
    return max(counts, default=1)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, total: int = SAMPLE_WINDOWS) -> Model:
    """Fit on at most ``sample`` labelled, not held-out documents of each class, the first by
    the hash of their id. Only those rows reach the driver, one per id, with ``total`` windows of text in
    all. Repeated label rows: the highest; rows of ``docs`` that share an id: the least text."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    toxic = F.col("toxic") > 0
    n, n_toxic = known.agg(F.count(F.lit(1)), F.count_if(toxic)).first()
    order = [F.xxhash64("doc_id", F.lit(SEED)), "doc_id"]
    picks = known.where(toxic).orderBy(*order).limit(sample).unionByName(known.where(~toxic).orderBy(*order).limit(sample))
    texts = docs.where(F.col("text").isNotNull()).select("doc_id", "text")
    picked = texts.join(F.broadcast(picks), "doc_id")  # the broadcast side: 2 * sample ids at most
    picked = materialize(picked.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")), "toxic-sample")

    @F.pandas_udf("long")
    def sizes(texts: pd.Series) -> pd.Series:
        return texts.map(n_windows).astype("int64")

    limit = fair_limit([r[0] for r in picked.select(sizes("text")).collect()], total)  # 2 * sample numbers at most

    @F.pandas_udf("string")
    def cut(texts: pd.Series, ids: pd.Series) -> pd.Series:
        return pd.Series([drawn_windows(t, limit, crc32(str(i).encode())) for t, i in zip(texts, ids)], dtype=object)

    rows = sorted(tuple(r) for r in picked.select("doc_id", cut("text", "doc_id"), "toxic").collect())  # ``total`` windows at most
    forget(picked)
    return fit([t for _, t, _ in rows], [y for _, _, y in rows], n_toxic / n if n else None)


def score_column(text: Column, model: Model, cache: int | None = None) -> Column:
    """Probability that a whole text is toxic; null scores as the empty text. ``cache``: words remembered, CACHE by default."""

    @F.arrow_udf("double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = Scorer(model, cache)
        for texts in batches:  # a few texts as Python objects at a time
            yield pa.array([own.score(t) for i in range(0, len(texts), ROWS) for t in texts.slice(i, ROWS).to_pylist()], pa.float64())

    return run(text)


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    """Score of every document; no shuffle but of the labels."""
    docs = documents(spark, sf_dir)
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = docs.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(True)).alias("held_out"), score_column(F.col("text"), model).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
