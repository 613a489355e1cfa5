"""Language identification: averaged hashed subword embeddings, a linear softmax, stochastic gradient descent in numpy.

A text is the bag of its byte n-grams (``ORDERS``; A-Z lower-cased), each hashed to one of ``BUCKETS`` rows of an embedding
table. The mean of those rows, times a weight matrix, gives the scores of the languages. Training is one task over at most ``SAMPLE``
labelled texts of each language and ``TOTAL`` of all (the bounds of the fit; the draw is by a hash of doc_id). A fifth of them calibrates: a
temperature is fitted to their likelihood, and the least score that gives ``PRECISION`` among them is the rejection limit.
For prediction, embedding times weights is one table of BUCKETS x languages, which is what tasks receive.

Defined cases: text that is null or has no letter gives ``und`` with score 0, rejected; a null or empty label is not learned
from; with no labelled text at all every row is ``und``; a null doc_id is never held out nor learned from; repeated rows are
predicted alike (the prediction reads the text only); other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldweave.llm import kernels as K
from fieldweave.llm.workspace import drawn, lean

ORDERS = (1, 2, 3, 4)
BITS = 14
BUCKETS = 1 << BITS
DIM = 16
SAMPLE, TOTAL = 600, 30_000
EPOCHS, RATE, GROUP = 12, 8.0, 16
BLOCK = 1 << 16
PRECISION = 0.98
FOLDS, HELD_OUT = 4, 2
UNKNOWN = "und"


def gram_buckets(buf: np.ndarray, offs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order: (buckets of the n-grams starting at each byte, whether the n-gram lies within its row)."""
    low = K.LOWER[buf].astype(np.uint32)
    left = np.repeat(offs[1:], np.diff(offs)) - np.arange(len(buf))  # bytes from here to the row's end
    code = np.zeros(len(buf), np.uint32)
    for n in range(1, max(ORDERS) + 1):
        moved = np.zeros(len(buf), np.uint32)
        moved[: len(buf) - n + 1] = low[n - 1 :]
        code = (code << np.uint32(8)) | moved
        if n in ORDERS:
            spread = (code ^ np.uint32(n * 0x5BD1E995 & 0xFFFFFFFF)) * np.uint32(0x9E3779B1)
            spread ^= spread >> np.uint32(15)
            spread *= np.uint32(0x85EBCA77)
            yield spread >> np.uint32(32 - BITS), left >= n


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bag of each sampled text: buckets and their shares."""
    for batch in batches:
        for lo, hi, buf, offs in K.slices(batch.column(2)):
            grams = list(gram_buckets(buf, offs))
            at, share = [], []
            for a, b in zip(offs[:-1], offs[1:], strict=True):
                bag = np.bincount(np.concatenate([g[a:b][ok[a:b]] for g, ok in grams]), minlength=BUCKETS)
                nz = np.flatnonzero(bag)
                at.append(nz)
                share.append(bag[nz] / max(1, bag.sum()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(at, pa.list_(pa.int32())), pa.array(share, pa.list_(pa.float32()))],
                names=["doc_id", "lang", "buckets", "shares"],
            )


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # BUCKETS x languages, times the temperature already
    bias: np.ndarray
    limit: float


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(bags: list[tuple[np.ndarray, np.ndarray]], labels: list[str], seed: int = 7) -> Model:
    """Fit the embedding table and the softmax by SGD, then the temperature and the rejection limit on a fifth."""
    names = sorted(set(labels))
    y = np.array([names.index(v) for v in labels])
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    fit, hold = (order[len(y) // 5 :], order[: len(y) // 5]) if len(y) >= 5 * len(names) else (order, order)
    E = rng.normal(0, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    W = np.zeros((DIM, len(names)), np.float32)
    W += rng.normal(0, 1 / DIM, W.shape)
    b = np.zeros(len(names), np.float32)
    steps = max(1, EPOCHS * -(-len(fit) // GROUP))
    done = 0
    for _ in range(EPOCHS):
        rng.shuffle(fit)
        for lo in range(0, len(fit), GROUP):
            rate = np.float32(RATE * (1 - done / steps))
            done += 1
            rows = fit[lo : lo + GROUP]
            mean = np.stack([bags[r][1] @ E[bags[r][0]] for r in rows])
            grad = _softmax(mean @ W + b)
            grad[np.arange(len(rows)), y[rows]] -= 1
            grad /= len(rows)
            back = grad @ W.T
            W -= rate * (mean.T @ grad)
            b -= rate * 0.1 * grad.sum(axis=0)
            for g, r in zip(back, rows, strict=True):
                at, share = bags[r]
                E[at] -= rate * len(rows) * np.outer(share, g)
    table = (E @ W).astype(np.float64)
    z = np.stack([bags[r][1] @ table[bags[r][0]] for r in hold]) + b
    loss = {t: -np.log(_softmax(z * t)[np.arange(len(hold)), y[hold]] + 1e-12).mean() for t in np.geomspace(0.1, 8, 60)}
    t = min(loss, key=loss.get)
    p = _softmax(z * t)
    best, right = p.max(axis=1), p.argmax(axis=1) == y[hold]
    down = np.argsort(-best)
    good = np.flatnonzero(np.cumsum(right[down]) / np.arange(1, len(down) + 1) >= PRECISION)
    limit = float(best[down[good[-1]]]) if len(good) else 1.0
    return Model(names, np.ascontiguousarray(table * t, np.float32), (b * t).astype(np.float32), limit)


def fit(documents: DataFrame) -> Model | None:
    """The model of ``documents`` (doc_id, text, lang), without the held-out fold; None if nothing is labelled."""
    spark = lean(documents)
    usable = documents.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull() & (F.col("text") != "") & F.col("lang").isNotNull() & (F.col("lang") != "") & ~_held_out())
    languages = usable.select("lang").distinct().count()
    most = min(SAMPLE, max(1, TOTAL // max(1, languages)))
    ids = drawn(usable.select("doc_id", "lang"), "lang", most).select("doc_id").toArrow()  # TOTAL longs at most
    if not ids.num_rows:
        return None
    chosen = spark.createDataFrame([(i,) for i in sorted(set(ids.column(0).to_pylist()))], "doc_id long")
    sample = usable.join(F.broadcast(chosen), "doc_id", "left_semi").select("doc_id", "lang", "text")
    bags = sample.mapInArrow(_counted, "doc_id long, lang string, buckets array<int>, shares array<float>")
    packed = bags.repartition(1).sortWithinPartitions("doc_id", "lang").mapInArrow(_fitted, "part string, names array<string>, values array<float>").toArrow()
    by = {r["part"]: r for r in packed.to_pylist()}
    names = by["table"]["names"]
    return Model(names, np.array(by["table"]["values"], np.float32).reshape(BUCKETS, len(names)), np.array(by["bias"]["values"], np.float32), float(by["limit"]["values"][0]))


def _fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The model's parts, from the bags of the whole sample."""
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    labels: list[str] = []
    for batch in batches:
        pairs += [(np.asarray(a.values), np.asarray(s.values)) for a, s in zip(batch.column("buckets"), batch.column("shares"), strict=True)]
        labels += batch.column("lang").to_pylist()
    if pairs:
        m = train(pairs, labels)
        values = [m.table.ravel(), m.bias, np.array([m.limit], np.float32)]
        yield pa.RecordBatch.from_arrays([pa.array(["table", "bias", "limit"]), pa.array([m.languages] * 3, pa.list_(pa.string())), pa.array(values, pa.list_(pa.float32()))], names=["part", "names", "values"])


def _held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def has_letter(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Whether each row has a letter of any script."""
    low = K.LOWER[buf]
    seen = np.concatenate(([0], np.cumsum((low >= 97) & (low <= 122))))
    out = seen[offs[1:]] > seen[offs[:-1]]
    for r in np.flatnonzero(~out):
        out[r] = any(c.isalpha() for c in buf[offs[r] : offs[r + 1]].tobytes().decode("utf-8", "ignore"))
    return out


def scores(model: Model, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Calibrated probabilities (rows x languages)."""
    total = np.zeros((len(offs) - 1, len(model.languages)))
    count = np.zeros(len(offs) - 1)
    has = np.flatnonzero(np.diff(offs))
    if len(has):
        padded = np.vstack((model.table, np.zeros((1, len(model.languages)), np.float32)))
        row = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
        for at, ok in gram_buckets(buf, offs):
            at = np.where(ok, at, BUCKETS)
            count[has] += np.add.reduceat(ok.astype(np.int64), offs[has])
            for lo in range(0, len(at), BLOCK):  # memory follows the block, not the longest text
                part = row[lo : lo + BLOCK]
                first = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
                total[part[first]] += np.add.reduceat(padded[at[lo : lo + BLOCK]], first, axis=0)
    return _softmax(total / np.maximum(count, 1)[:, None] + model.bias)


def identify(documents: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, accepted for every row."""

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, offs in K.slices(batch.column(2)):
                known = has_letter(buf, offs) if model else np.zeros(hi - lo, bool)
                p = scores(model, buf, offs) if model else np.zeros((hi - lo, 1))
                best = p.argmax(axis=1)
                score = np.where(known, np.clip(p[np.arange(len(p)), best], 0, 1), 0.0)
                name = [model.languages[k] if ok else UNKNOWN for k, ok in zip(best, known, strict=True)] if model else [UNKNOWN] * (hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(name, pa.string()), pa.array(score), pa.array(known & (score >= (model.limit if model else 1)))],
                    names=["doc_id", "held_out", "lang_pred", "score", "accepted"],
                )

    lean(documents)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), _held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(predict, "doc_id long, held_out boolean, lang_pred string, score double, accepted boolean")
