"""Quality classifier: a weak-label model over overlapping heuristic labellers trains a hashed linear scorer.

Two questions are asked of a text: is it low in quality, is it toxic. For each, labellers vote yes, no or abstain. Quality:
mechanical patterns (repeated, symbol-ridden, shouted or cut-up words), the share of plain words, the share of marks among
the characters. Toxicity: two separate lists of English insults, nouns and adjectives, which abstain on text that is not English.
Both: the reviewers' ``labels`` where there are any (but not those of the held-out fold, which only measure).

1. Votes are computed for all texts; equal vote patterns are counted by Spark (3 ** labellers patterns at most).
2. Expectation-maximisation over the pattern counts estimates each labeller's rates of every vote given the true answer, and
   so the posterior of every pattern.
3. A linear scorer (hashed words and word beginnings, plus the shares above) is fitted to posterior labels by stochastic
   gradient descent on at most ``SAMPLE`` texts of each of three strata (the bound of the fit).
4. Every text is scored. One that the scorer finds low in quality or toxic is rejected.

Defined cases: null text and text without words is rejected (nothing to keep) with p_low_quality 1; missing, null or repeated
labels abstain or count once (the most severe); without any usable sample the posterior itself decides; a null doc_id is scored
but has no label; very long texts are read whole; repeated rows get equal results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldweave.llm import kernels as K
from fieldweave.llm.workspace import drawn, lean, stored

BITS = 21
BUCKETS = 1 << BITS
SAMPLE = 2500
LEAST_TEXTS = 4  # sampled texts that must share a feature for it to count
EPOCHS, RATE, SHRINK = 8, 0.1, 1e-4
BEGINNINGS = (4, 5, 6, 7)
CONSTANT = -1000
FOLDS, HELD_OUT = 5, 4
NOUNS = ["clown", "fool", "garbage", "idiot", "imbecile", "loser", "moron", "scum", "trash"]
ADJECTIVES = ["disgusting", "dumb", "pathetic", "stupid", "worthless"]
#: (share, yes from, no up to) of the mechanical patterns
RULES = [("repeated", 0.3, 0.1), ("symbols", 0.3, 0.1), ("shouted", 0.5, 0.25), ("bangs", 0.3, 0.1), ("pipes", 0.1, 0.05)]
PLAIN_NO, PLAIN_YES = 0.85, 0.7
MARKS_YES, MARKS_NO = 0.12, 0.08
#: Share of common English words from which the insult list applies
ENGLISH = 0.06
COMMON = ["a", "and", "are", "as", "at", "be", "for", "from", "in", "is", "of", "on", "that", "the", "this", "to", "was", "what", "with"]
QUALITY_LABELLERS, INSULT_LABELLERS = 3, 2
#: A text is rejected from these probabilities of low quality and of toxicity on. Toxic texts are rarer and worse to keep, so theirs is the lower.
LIMITS = (0.5, 0.35)
#: The share of right votes that reviewers are held to have, as a prior: labels are taken as nearly true, so the labellers' rates follow them
TRUST = 0.9995

_alnum = np.zeros(256, bool)
_alnum[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_mark = np.zeros(256, bool)
_mark[[ord(c) for c in "*#$%&@^~=_"]] = True


def _hashes(words: list[str]) -> np.ndarray:
    raw = "\n".join(words).encode()
    return np.sort(K.Words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)])).hash)


class Facts:
    """What labellers and scorer see of a slice of texts."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray):
        w = self.words = K.Words(buf, offs)
        n = self.n = (w.last - w.first).astype(np.float64)
        self.has = np.flatnonzero(n)
        ok = _alnum[w.low]
        at = np.arange(len(buf))
        after = np.maximum.accumulate(np.where(ok, at + 1, 0)) if len(buf) else at
        before = np.minimum.accumulate(np.where(ok, at, len(buf))[::-1])[::-1] if len(buf) else at
        start = np.minimum(before[w.start], w.end) if len(w.start) else w.start
        end = np.maximum(after[w.end - 1], start) if len(w.start) else w.start
        self.start, self.end = start, end  # words without marks around them
        self.core = w.spans(start, end)
        marks = np.concatenate(([0], np.cumsum(_mark[w.low])))
        two = (marks[w.end] - marks[np.maximum(w.end - 3, w.start)]) >= 2
        bang = np.concatenate(([0], np.cumsum(w.low == 33)))
        bangs = (bang[w.end] - bang[np.maximum(w.end - 3, w.start)]) >= 2
        pipe = (w.end - w.start == 1) & (w.low[w.start] == 124) if len(w.start) else np.zeros(0, bool)
        again = np.zeros(len(w.hash), bool)
        again[1:] = w.hash[1:] == w.hash[:-1]
        again[w.first[self.has]] = False
        upper = np.concatenate(([0], np.cumsum((buf >= 65) & (buf <= 90))))
        lower = np.concatenate(([0], np.cumsum((buf >= 97) & (buf <= 122))))
        letters = np.maximum(1, upper[offs[1:]] - upper[offs[:-1]] + lower[offs[1:]] - lower[offs[:-1]])
        share = lambda flags: self.sums(flags.astype(np.float64)) / np.maximum(n, 1)
        self.shares = np.stack([share(again), share(two), (upper[offs[1:]] - upper[offs[:-1]]) / letters, share(bangs), share(pipe)], axis=1)
        inner = np.concatenate(([0], np.cumsum(~ok)))
        light = (inner[w.end] - inner[w.start] <= 2) & (end > start)
        caps = (upper[end] - upper[start] == end - start) & (end - start > 1)
        self.plain = share(light & ~again & ~bangs & ~two & ~caps)
        marked = np.concatenate(([0], np.cumsum(~ok & ~K.IS_SPACE[w.low])))
        self.marks = (marked[offs[1:]] - marked[offs[:-1]]) / np.maximum(1, offs[1:] - offs[:-1])
        self.english = share(np.isin(self.core, _COMMON))
        self.insults = [self.sums(np.isin(self.core, words).astype(np.float64)) for words in (_NOUNS, _ADJECTIVES)]

    def sums(self, values: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.n))
        if len(self.has):
            out[self.has] = np.add.reduceat(values, self.words.first[self.has])
        return out

    def votes(self) -> np.ndarray:
        """rows x (mechanical, plain words, marks, insulting nouns, insulting adjectives): 1 yes, 0 no, -1 abstain."""
        v = np.full((len(self.n), QUALITY_LABELLERS + INSULT_LABELLERS), -1, np.int8)
        yes, no = np.array([r[1] for r in RULES]), np.array([r[2] for r in RULES])
        v[(self.shares <= no).all(axis=1), 0] = 0
        v[(self.shares >= yes).any(axis=1), 0] = 1
        v[self.plain >= PLAIN_NO, 1] = 0
        v[self.plain <= PLAIN_YES, 1] = 1
        v[self.marks <= MARKS_NO, 2] = 0
        v[self.marks >= MARKS_YES, 2] = 1
        for k, found in enumerate(self.insults):
            v[:, QUALITY_LABELLERS + k] = np.where(found > 0, 1, np.where(self.english >= ENGLISH, 0, -1))
        v[self.n == 0] = -1
        return v

    def buckets(self) -> Iterator[np.ndarray]:
        """Feature buckets of each word: the word and its beginnings (-1 where it is no longer than the beginning)."""
        yield (self.core >> K.U64(64 - BITS)).astype(np.int64)
        size = self.end - self.start
        for k in BEGINNINGS:
            longer = size > k
            h = self.words.spans(self.start, np.where(longer, self.start + k, self.start))
            yield np.where(longer, ((h + K.U64(k)) * K.SHINGLE_MUL[k] >> K.U64(64 - BITS)).astype(np.int64), -1)


_NOUNS, _ADJECTIVES, _COMMON = _hashes(NOUNS), _hashes(ADJECTIVES), _hashes(COMMON)


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, start: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, dict]:
    """Posterior of yes for each vote pattern (rows of 1, 0, -1), from ``start``; and the estimated rates.

    Votes are independent given the answer; each labeller has its own share of right votes for either answer, abstaining says
    nothing. The last labeller, the reviewers, has a prior as strong as the data: of their votes, ``TRUST`` are right.
    """
    post = start.astype(np.float64)
    n = counts.astype(np.float64)
    cast = patterns >= 0
    for _ in range(rounds):
        prior = (post @ n + 1) / (n.sum() + 2)
        logs = np.stack([np.full(len(n), np.log(1 - prior)), np.full(len(n), np.log(prior))])
        rates = np.zeros((patterns.shape[1], 2, 2))  # labeller, answer, vote
        for j in range(patterns.shape[1]):
            for y, weight in enumerate((n * (1 - post), n * post)):
                seen = np.array([weight[patterns[:, j] == o].sum() for o in (0, 1)]) + (np.array([2.0, 0.5]) if y == 0 else np.array([0.5, 2.0]))
                rates[j, y] = seen / seen.sum()
                if j == patterns.shape[1] - 1:
                    rates[j, y] = (rates[j, y] + (np.array([TRUST, 1 - TRUST]) if y == 0 else np.array([1 - TRUST, TRUST]))) / 2
                logs[y] += np.where(cast[:, j], np.log(rates[j, y])[np.maximum(patterns[:, j], 0)], 0)
        new = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -60, 60)))
        if np.abs(new - post).max() < 1e-9:
            break
        post = new
    return post, {"prior": prior, "rates": rates}


def posterior_of(patterns: np.ndarray, model: dict) -> np.ndarray:
    """Posterior of yes for any vote patterns under estimated rates."""
    logs = np.log(np.array([[1 - model["prior"]], [model["prior"]]])).repeat(len(patterns), axis=1)
    for j in range(patterns.shape[1]):
        for y in (0, 1):
            logs[y] += np.where(patterns[:, j] >= 0, np.log(model["rates"][j, y])[np.maximum(patterns[:, j], 0)], 0)
    return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -60, 60)))


@dataclass
class Scorer:
    """Two hashed linear scorers (low quality, toxic): weights by bucket, by share, and a constant."""

    weights: np.ndarray  # 2 x (BUCKETS + 1); the last is of no feature
    dense: np.ndarray
    bias: np.ndarray

    def packed(self, buckets: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Weights that are not 0 as rows: bucket (``buckets`` has those of the weights) at or above 0, share below 0, constant far below."""
        for k in range(2):
            used = np.flatnonzero(self.weights[k])
            at = np.concatenate((buckets[used], -1 - np.arange(self.dense.shape[1]), [CONSTANT]))
            weight = np.concatenate((self.weights[k][used].astype(np.float64), self.dense[k], [self.bias[k]]))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k, np.int32)), pa.array(at), pa.array(weight)], names=["answer", "at", "weight"])

    @classmethod
    def unpacked(cls, rows: pa.Table) -> Scorer:
        k, at, weight = (np.asarray(rows.column(c)) for c in ("answer", "at", "weight"))
        out = cls(np.zeros((2, BUCKETS + 1), np.float32), np.zeros((2, len(RULES) + 1)), np.zeros(2))
        word, share, constant = at >= 0, (at < 0) & (at > CONSTANT), at == CONSTANT
        out.weights[k[word], at[word]] = weight[word]
        out.dense[k[share], -1 - at[share]] = weight[share]
        out.bias[k[constant]] = weight[constant]
        return out

    def probabilities(self, f: Facts) -> np.ndarray:
        z = np.zeros((2, len(f.n)))
        per_word = np.zeros((2, len(f.core)), np.float32)
        for b in f.buckets():
            per_word += self.weights[:, b]
        for k in range(2):
            z[k] = f.sums(per_word[k].astype(np.float64)) / np.sqrt(np.maximum(f.n, 1)) + dense_features(f) @ self.dense[k] + self.bias[k]
        p = 1 / (1 + np.exp(-np.clip(z, -60, 60)))
        p[0, f.n == 0] = 1.0
        p[1, f.n == 0] = 0.0
        return p


def dense_features(f: Facts) -> np.ndarray:
    return np.column_stack((f.shares * 4, np.log1p(f.n) / 10))


def train(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]], posterior: np.ndarray, size: int = BUCKETS, seed: int = 11) -> Scorer:
    """Logistic regression for both answers by SGD with per-weight steps; rows are (features under ``size``, values, dense).

    Features are scaled by their log ratio of texts that have them, yes to no, so that words of neither kind stay small.
    """
    rng = np.random.default_rng(seed)
    y = np.asarray(posterior)
    out = Scorer(np.zeros((2, size + 1), np.float32), np.zeros((2, len(rows[0][2]))), np.zeros(2))
    texts = np.bincount(np.concatenate([r[0] for r in rows]), minlength=size)
    for k in range(2):
        yes = np.zeros(size)
        for (at, _, _), p in zip(rows, y[:, k], strict=True):
            yes[at] += p
        n_yes = y[:, k].sum()
        ratio = np.log((yes + 1) / (n_yes + 2)) - np.log((texts - yes + 1) / (len(rows) - n_yes + 2))
        scale = np.where(texts >= LEAST_TEXTS, np.abs(ratio), 0).astype(np.float32)
        bags = [(at[scale[at] > 0], (x * scale[at])[scale[at] > 0], d) for at, x, d in rows]
        balance = np.where(y[:, k] > 0.5, 0.5 / max(0.1, n_yes / len(rows)), 0.5 / max(0.1, 1 - n_yes / len(rows)))
        W, G = np.zeros(size, np.float32), np.full(size, 1e-2, np.float32)
        D, GD, b = out.dense[k], np.full(out.dense.shape[1], 1e-2), 0.0
        for _ in range(EPOCHS):
            for r in rng.permutation(len(bags)):
                at, x, d = bags[r]
                g = (1 / (1 + np.exp(-np.clip(float(W[at] @ x) + float(D @ d) + b, -60, 60))) - y[r, k]) * balance[r]
                if abs(g) < 1e-4:
                    continue
                gx = g * x + SHRINK * W[at]
                G[at] += gx * gx
                W[at] -= RATE * gx / np.sqrt(G[at])
                gd = g * d
                GD += gd * gd
                D -= RATE * gd / np.sqrt(GD)
                b -= 0.02 * g
        out.weights[k, :size], out.bias[k] = W * scale, b
    return out


def _voted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, buf, offs in K.slices(batch.column(1)):
            v = Facts(buf, offs).votes()
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array([r.tobytes() for r in v], pa.binary()), pa.array(offs[1:] > offs[:-1])], names=["doc_id", "votes", "filled"])


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, buf, offs in K.slices(batch.column(3)):
            f = Facts(buf, offs)
            grams, dense = list(f.buckets()), dense_features(f)
            at, values = [], []
            for r in range(hi - lo):
                a, z = f.words.first[r], f.words.last[r]
                found, n = np.unique(np.concatenate([g[a:z] for g in grams]), return_counts=True)
                keep = found >= 0
                at.append(found[keep].astype(np.int32))
                values.append((n[keep] / np.sqrt(max(1, z - a))).astype(np.float32))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).slice(lo, hi - lo) for c in (0, 1, 2)), pa.array(at, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float32())), pa.array(list(dense), pa.list_(pa.float64()))],
                names=["doc_id", "low", "toxic", "buckets", "shares", "dense"],
            )


def _fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The scorer's weights, from the bags of the whole sample. Features of too few texts go first, so that the rest fits in little memory."""
    held = list(batches)
    texts = np.zeros(BUCKETS, np.int32)
    for batch in held:
        np.add.at(texts, np.asarray(batch.column("buckets").flatten()), 1)
    used = np.flatnonzero(texts >= LEAST_TEXTS)
    place = np.full(BUCKETS, -1, np.int32)
    place[used] = np.arange(len(used))
    rows, answers = [], []
    while held:
        batch = held.pop()
        for k in range(batch.num_rows):
            at, values, dense = (np.asarray(batch.column(c)[k].values) for c in ("buckets", "shares", "dense"))
            keep = place[at] >= 0
            rows.append((place[at[keep]], values[keep], dense.copy()))
        answers.append(np.stack([np.asarray(batch.column(c)) for c in ("low", "toxic")], axis=1))
        del batch, at, values, dense
    if rows:
        yield from train(rows, np.concatenate(answers), len(used)).packed(used)


def _posteriors(patterns: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """patterns: columns of the labellers, then reviewers' quality and toxicity -> posteriors (low quality, toxic), and those without the reviewers."""
    q, n = QUALITY_LABELLERS, QUALITY_LABELLERS + INSULT_LABELLERS
    out, alone = [], []
    for cols in ([*range(q), n], [*range(q, n), n + 1]):
        v = patterns[:, cols].astype(np.int64)
        said = v[:, -1]
        most = (v[:, :-1] == 1).any(axis=1)
        start = np.where(said == 1, 0.95, np.where(said == 0, 0.05, np.where(most, 0.8, 0.2)))
        post, model = expectation_maximisation(v, counts, start)
        out.append(post)
        alone.append(posterior_of(np.where(np.arange(v.shape[1]) == v.shape[1] - 1, -1, v), model))
    return np.stack(out, axis=1), np.stack(alone, axis=1)


def assess(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, p_low_quality, p_toxic and kept for every row of ``documents`` (doc_id, text); ``labels`` has doc_id, quality, toxic."""
    spark = lean(documents)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    said = (
        labels.where(F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS != HELD_OUT))
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg((1 - F.min("quality")).alias("low"), F.max("toxic").alias("toxic"))
    )
    voted = docs.mapInArrow(_voted, "doc_id long, votes binary, filled boolean").where("filled").drop("filled")
    byte = lambda c: F.when(F.col(c) == 1, F.lit(b"\x01")).when(F.col(c) == 0, F.lit(b"\x00")).otherwise(F.lit(b"\xff"))
    voted = stored(voted.join(said, "doc_id", "left").select("doc_id", F.concat("votes", byte("low"), byte("toxic")).alias("votes"), F.col("toxic").isNotNull().alias("reviewed")), "votes")
    counted = voted.groupBy("votes").agg(F.count(F.lit(1)).alias("n")).orderBy("votes").toArrow()  # 3 ** labellers rows at most
    if not counted.num_rows:
        return docs.select("doc_id", F.lit(1.0).alias("p_low_quality"), F.lit(0.0).alias("p_toxic"), F.lit(False).alias("kept"))
    keys = counted.column("votes").to_pylist()
    post, alone = _posteriors(np.array([np.frombuffer(k, np.int8) for k in keys]), np.asarray(counted.column("n")))
    table = spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in zip(keys, post, strict=True)], "votes binary, low double, toxic double")

    # The fit is one task over at most 3 * SAMPLE texts; it sends back its weights, so the driver never holds the sample.
    stratum = F.when(F.col("toxic") > 0.5, 2).when(F.col("low") > 0.5, 1).otherwise(0)
    drawn_from = voted.where("doc_id is not null").join(F.broadcast(table), "votes").withColumn("stratum", stratum)
    # reviewed texts first: both kinds are drawn on their own, then the reviewed ones are kept and the others fill up
    both = drawn(drawn_from.withColumn("kind", F.concat_ws("/", "stratum", "reviewed")), "kind", SAMPLE)
    chosen = drawn(both, "stratum", SAMPLE, first=[F.col("reviewed").desc()]).select("doc_id", "low", "toxic").toArrow()  # 3 * SAMPLE rows at most
    if not chosen.num_rows:  # nothing to fit on: the posterior of a text's own votes decides
        labellers = QUALITY_LABELLERS + INSULT_LABELLERS
        own = sorted({k[:labellers]: (float(a), float(b)) for k, (a, b) in zip(keys, alone, strict=True)}.items())
        by_votes = F.broadcast(spark.createDataFrame([(k, *p) for k, p in own], "votes binary, low double, toxic double"))
        every = docs.mapInArrow(_voted, "doc_id long, votes binary, filled boolean").join(by_votes, "votes", "left")
        low = F.when(~F.col("filled"), 1.0).otherwise(F.coalesce("low", F.lit(1.0)))
        toxic = F.when(~F.col("filled"), 0.0).otherwise(F.coalesce("toxic", F.lit(0.0)))
        return every.select("doc_id", low.alias("p_low_quality"), toxic.alias("p_toxic"), ((low < LIMITS[0]) & (toxic < LIMITS[1])).alias("kept"))
    rows = sorted(set(zip(*(chosen.column(c).to_pylist() for c in ("doc_id", "low", "toxic")), strict=True)))
    ids = spark.createDataFrame(rows, "doc_id long, low double, toxic double")
    bags = docs.join(F.broadcast(ids), "doc_id").select("doc_id", "low", "toxic", "text").mapInArrow(_sampled, "doc_id long, low double, toxic double, buckets array<int>, shares array<float>, dense array<double>")
    scorer = Scorer.unpacked(bags.repartition(1).sortWithinPartitions("doc_id", "low", "toxic").mapInArrow(_fitted, "answer int, at long, weight double").toArrow())
    shared = spark.sparkContext.broadcast(scorer)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, offs in K.slices(batch.column(1)):
                low, toxic = shared.value.probabilities(Facts(buf, offs))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(low), pa.array(toxic), pa.array((low < LIMITS[0]) & (toxic < LIMITS[1]))], names=["doc_id", "p_low_quality", "p_toxic", "kept"])

    return docs.mapInArrow(scored, "doc_id long, p_low_quality double, p_toxic double, kept boolean")
