"""Language identification with averaged hashed subword embeddings.

Subwords are the byte 3-grams and 4-grams of the lower-cased text (white space
is one blank), hashed into ``BUCKETS`` embeddings; a text is their mean, and a
linear softmax gives the languages.  Embeddings and softmax are trained by
stochastic gradient descent in numpy on the driver, from subword counts that
Spark prepares for a labelled sample of at most ``SAMPLE`` whole texts a
language.  A fifth of the sample is held back: on it the softmax temperature is
fitted, and the score below which a prediction is rejected so that the rest is
right with the wanted precision (column ``accepted``).

For prediction the embeddings are multiplied with the softmax once, so a text
costs one table lookup per subword and language.

Defined cases: null texts and texts without a letter are ``und`` with score 0;
a null doc_id counts as the empty text in the hold-out rule; rows with equal ids
are separate; null languages are not learned; without labelled texts everything
is ``und``; an empty table gives no rows; other columns of the input are not
read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardlens.llm.brown import held_out
from cardlens.llm.common import arrow_map, buffer_of, read, small_batches, text_bytes

BUCKET_BITS = 14
BUCKETS = 1 << BUCKET_BITS
DIM = 16
#: Labelled texts a language at most (the bound of the fitting sample).
SAMPLE = 800
EPOCHS, RATE, BATCH = 8, 0.5, 16
PRECISION = 0.995

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[9, 10, 11, 12, 13]] = 32
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


def subwords(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Bucket of the 3-gram and of the 4-gram at every byte; ``BUCKETS`` where
    none fits into the text."""
    b = _FOLD[data].astype(np.uint32)
    padded = np.concatenate([b, np.zeros(4, np.uint32)])
    n, out = len(b), []
    gram = padded[:n] | padded[1:n + 1] << np.uint32(8)
    for k, factor in ((2, 2654435761), (3, 2246822519)):
        gram = gram | padded[k:n + k] << np.uint32(8 * k)
        with np.errstate(over="ignore"):
            h = gram * np.uint32(factor)
            h = (h ^ (h >> np.uint32(15))) * np.uint32(3266489917)
        h = (h >> np.uint32(32 - BUCKET_BITS)).astype(np.int64)
        for j in range(1, k + 1):
            at = offsets[1:] - j
            h[at[at >= offsets[:-1]]] = BUCKETS
        out.append(h)
    return out


def has_letter(texts: pa.Array, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    seen = np.concatenate([[0], np.cumsum(_LETTER[data])])
    found = seen[offsets[1:]] > seen[offsets[:-1]]
    for i in np.flatnonzero(~found):
        found[i] = any(c.isalpha() for c in texts[int(i)].as_py().decode("utf-8", "replace"))
    return found


def sample(docs: DataFrame, folds: int, fold: int, per_language: int) -> list:
    """Labelled training texts as subword counts: rows (lang, buckets, counts)."""
    known = docs.select(F.col("doc_id"), F.col("lang").cast("string").alias("lang"),
                        F.col("text").cast("string").alias("text")) \
        .where(~held_out("doc_id", folds, fold) & F.col("lang").isNotNull()
               & F.col("text").isNotNull())
    counts = {r["lang"]: r["n"] for r in
              known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return []
    span = 1 << 30
    share = F.create_map(*(x for k, n in counts.items() for x in
                           (F.lit(k), F.lit(min(span, per_language * span // n)))))
    chosen = known.where(F.pmod(F.xxhash64(F.lit("language"), "doc_id"), F.lit(span))
                         < share[F.col("lang")]).select("lang", text_bytes().alias("_t"))

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, off = buffer_of(batch.column(1))
        grams = subwords(data, off)
        buckets, times = [], []
        for a, b in zip(off, off[1:]):
            c = np.bincount(np.concatenate([g[a:b] for g in grams]), minlength=BUCKETS + 1)
            at = np.flatnonzero(c[:BUCKETS])
            buckets.append(at.astype(np.int32))
            times.append(c[at].astype(np.float32))
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(buckets, pa.list_(pa.int32())),
             pa.array(times, pa.list_(pa.float32()))], names=["lang", "buckets", "times"])
    table = arrow_map(chosen, rows, "lang string, buckets array<int>, times array<float>") \
        .limit(2 * per_language * len(counts)).toArrow()
    return [(lang, np.asarray(b.values), np.asarray(t.values)) for lang, b, t in
            zip(table.column("lang").to_pylist(), table.column("buckets").combine_chunks(),
                table.column("times").combine_chunks()) if len(b)]


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def train(rows: list, seed: int = 5) -> tuple[list[str], np.ndarray, np.ndarray, float, float]:
    """(languages, table of bucket x language, bias, temperature, least score)."""
    languages = sorted({r[0] for r in rows})
    place = {x: i for i, x in enumerate(languages)}
    rows = sorted(rows, key=lambda r: (r[0], len(r[1]), float(r[2].sum()), r[1].tobytes()))
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(rows))
    back, fit = order[:len(rows) // 5], order[len(rows) // 5:]
    emb = rng.normal(0, 0.1, (BUCKETS, DIM))
    w, bias = rng.normal(0, 0.1, (DIM, len(languages))), np.zeros(len(languages))
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        rng.shuffle(fit)
        for s in range(0, len(fit), BATCH):
            part = [rows[i] for i in fit[s:s + BATCH]]
            y = np.array([place[r[0]] for r in part])
            share = [r[2] / r[2].sum() for r in part]
            mean = np.stack([p @ emb[r[1]] for r, p in zip(part, share)])
            error = _softmax(mean @ w + bias)
            error[np.arange(len(y)), y] -= 1
            error /= len(y)
            to_mean = error @ w.T
            w -= rate * mean.T @ error
            bias -= rate * error.sum(0)
            for r, p, g in zip(part, share, to_mean):
                # a bucket's share of a text is small; its step is scaled to the text
                emb[r[1]] -= (rate * len(p)) * np.minimum(p, 10 / len(p))[:, None] * g[None, :]
    table = emb @ w
    if not len(back):
        return languages, table, bias, 1.0, 0.0
    logits = np.stack([(rows[i][2] / rows[i][2].sum()) @ table[rows[i][1]] + bias for i in back])
    truth = np.array([place[rows[i][0]] for i in back])
    grid = np.geomspace(0.05, 20, 61)
    losses = [-np.log(_softmax(logits / t)[np.arange(len(truth)), truth] + 1e-12).mean()
              for t in grid]
    heat = float(grid[int(np.argmin(losses))])
    p = _softmax(logits / heat)
    best = p.max(1)
    by = np.argsort(-best)
    right = np.cumsum(p.argmax(1)[by] == truth[by]) / np.arange(1, len(by) + 1)
    enough = np.flatnonzero(right >= PRECISION)
    least = float(best[by][enough[-1]]) if len(enough) else 1.0
    return languages, table, bias, heat, least


def predict(docs: DataFrame, model, folds: int = 4, fold: int = 2) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, accepted) of every row."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                        held_out("doc_id", folds, fold).alias("held_out"),
                        text_bytes().alias("_t"))

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        languages, table, bias, heat, least = held.value
        texts, n = batch.column(2), batch.num_rows
        data, off = buffer_of(texts)
        letters = has_letter(texts, data, off)
        names, score = ["und"] * n, np.zeros(n)
        if languages:
            wide = np.concatenate([table, np.zeros((1, len(languages)))])
            total, size = np.zeros((n, len(languages))), np.zeros(n)
            full = np.flatnonzero(off[1:] > off[:-1])
            for g in subwords(data, off) if len(full) else ():
                for k in range(len(languages)):
                    total[full, k] += np.add.reduceat(wide[:, k][g], off[:-1][full])
                size[full] += np.add.reduceat((g < BUCKETS).astype(np.int64), off[:-1][full])
            p = _softmax((total / np.maximum(size, 1)[:, None] + bias) / heat)
            best = p.argmax(1)
            score = np.where(letters, p[np.arange(n), best], 0.0)
            names = [languages[b] if x else "und" for b, x in zip(best, letters)]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(names), pa.array(score),
             pa.array((score >= least) & letters)],
            names=["doc_id", "held_out", "lang_pred", "score", "accepted"])
    return arrow_map(plain, rows, "doc_id long, held_out boolean, lang_pred string, score double, "
                     "accepted boolean")


def identify(docs: DataFrame, folds: int = 4, fold: int = 2,
             per_language: int = SAMPLE) -> DataFrame:
    """Learn from the labelled texts outside ``fold`` and predict all."""
    small_batches(docs.sparkSession)
    rows = sample(docs, folds, fold, per_language)
    model = train(rows) if rows else ([], np.zeros((BUCKETS, 0)), np.zeros(0), 1.0, 1.0)
    return predict(docs, model, folds, fold)


def op3_subword_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(read(spark, sf_dir, "documents"))
