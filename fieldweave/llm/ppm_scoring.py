"""Prediction by partial matching: code lengths of texts under a byte-context trie learned from the corpus.

The trie holds every context of up to ``ORDER`` bytes with the counts of the symbols after it. A symbol is predicted in the
longest context known; an unseen symbol costs the escape (method C: distinct symbols / (count + distinct symbols)) and is
predicted in the next shorter context, from whose counts the symbols already refused are excluded; below order 0 all
257 symbols not excluded are equally likely. A text's score is the log10 probability of its lower-cased words joined by single
spaces, and of its end.

Counting: each task sums the n-grams of its texts in Python, Spark sums those sums. All shorter contexts follow from the
longest. The counts stay in tables, whole: nothing learned is cut. The longest n-grams with at least total / CAPACITY occurrences (at
most CAPACITY of them) go to the tasks with their log10 probability; each other one of a text is looked up by a join, and by
that rule no learned key is hot. N-grams that were not learned go down the orders once for each distinct one, by joins
with the counts of every order (``escaped``).

The unigram base needs the count of every token. Tokens with at least N / CAPACITY occurrences (at most CAPACITY of
them) go to the tasks; each other token of a text is looked up by a join on its hash, and by that rule no such key is hot.
Tokens are told apart by 64-bit hashes.

Defined cases: null text is empty text, whose only token is its end; with nothing to learn from, N = V = 0, nothing is known and
all symbols are equally likely; a null doc_id is not held out; repeated rows count and are scored each; other columns are
ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldweave.llm import kernels as K
from fieldweave.llm.workspace import lean, narrow, stored

ORDER = 5
CAPACITY = 1 << 22
FOLDS, HELD_OUT = 5, 1
START, END = 0xFE, 0xFF  # bytes that no UTF-8 text has
SYMBOLS = 257
END_TOKEN = np.uint64(0x5E4DE4D0FADE0001)
MERGE_AT = 3_000_000
SLICE = 1 << 18


def symbols(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n-grams of ORDER + 1 bytes as uint64, row bounds): one for every byte of the canonical texts and their ends."""
    space = K.IS_SPACE[buf]
    cut = np.zeros(len(buf) + 1, bool)
    cut[offs] = True
    again = np.concatenate(([True], space[:-1])) if len(buf) else space
    keep = ~(space & (again | cut[:-1]))
    kept = np.concatenate(([0], np.cumsum(keep)))[offs]
    low = np.where(space, 32, K.LOWER[buf])[keep].astype(np.uint8)
    last = kept[1:] - 1  # a space at a row's end goes, too
    tail = (kept[1:] > kept[:-1]) & (low[np.maximum(last, 0)] == 32) if len(low) else np.zeros(len(kept) - 1, bool)
    if tail.any():
        low = np.delete(low, last[tail])
        kept = kept - np.concatenate(([0], np.cumsum(tail)))
    rows, n = len(kept) - 1, len(low)
    pad = ORDER + 1
    x = np.full(n + rows * pad + ORDER, START, np.uint8)
    row = np.repeat(np.arange(rows), np.diff(kept))
    x[np.arange(n) + row * pad + ORDER] = low
    ends = kept[1:] + np.arange(1, rows + 1) * pad - 1
    x[ends] = END
    wide = x.astype(np.uint64)
    total = n + rows * pad - ORDER
    key = np.zeros(max(total, 0), np.uint64)
    for j in range(pad):
        key <<= K.U64(8)
        key |= wide[j : j + total]
    at = np.ones(total, bool)
    for r in range(1, pad):  # n-grams that end in a row's padding
        at[ends[:-1] + r - ORDER] = False
    return key[at], kept + np.arange(rows + 1)


class Sums:
    """Sums of counts by 64-bit key, merged now and then so that memory follows the distinct keys."""

    def __init__(self) -> None:
        self.keys: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.held = 0

    def add(self, keys: np.ndarray, counts: np.ndarray | None = None) -> None:
        if counts is None:
            keys, counts = np.unique(keys, return_counts=True)
        self.keys.append(keys)
        self.counts.append(counts)
        self.held += len(keys)
        if self.held > MERGE_AT and len(self.keys) > 1:
            self.merge()

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.keys:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        if len(self.keys) > 1:
            keys = np.concatenate(self.keys)
            order = np.argsort(keys, kind="stable")
            keys, counts = keys[order], np.concatenate(self.counts)[order]
            first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            self.keys, self.counts = [keys[first]], [np.add.reduceat(counts, first)]
        self.held = len(self.keys[0])
        return self.keys[0], self.counts[0]


def _learned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of one task's texts: kind 0 n-grams, kind 1 tokens."""
    grams, tokens = Sums(), Sums()
    for batch in batches:
        for _, _, buf, offs in K.slices(batch.column(0), SLICE):
            grams.add(symbols(buf, offs)[0])
            tokens.add(K.Words(buf, offs).hash)
            tokens.add(np.array([END_TOKEN]), np.array([len(offs) - 1]))
    for kind, sums in enumerate((grams, tokens)):
        keys, counts = sums.merge()
        for lo in range(0, len(keys), 100_000):
            k = keys[lo : lo + 100_000].view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), kind, np.int32)), pa.array(k), pa.array(counts[lo : lo + 100_000].astype(np.int64))], names=["kind", "key", "count"])


class HashTable:
    """Open addressing from uint64 keys to float32 values in numpy, probed for whole arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(2 * len(keys)).bit_length())
        self.keys = np.full(1 << self.bits, 2**64 - 1, np.uint64)  # no key here is all ones
        self.values = np.zeros(1 << self.bits, np.float32)
        todo, at = np.arange(len(keys)), self.slot(keys)
        while len(todo):
            free = self.keys[at] == K.U64(2**64 - 1)
            slots, first = np.unique(at[free], return_index=True)
            who = todo[free][first]
            self.keys[slots], self.values[slots] = keys[who], values[who]
            left = self.keys[at] != keys[todo]
            todo, at = todo[left], (at[left] + 1) & ((1 << self.bits) - 1)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys * K.U64(0x9E3779B97F4A7C15)) >> K.U64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values, found); the value is 0 where a key is missing."""
        at = self.slot(keys)
        here = self.keys[at]
        found = here == keys
        values = np.where(found, self.values[at], np.float32(0))
        todo = np.flatnonzero(~found & (here != K.U64(2**64 - 1)))
        at = at[todo]
        while len(todo):
            at = (at + 1) & ((1 << self.bits) - 1)
            here = self.keys[at]
            hit = here == keys[todo]
            values[todo[hit]], found[todo[hit]] = self.values[at[hit]], True
            go = ~hit & (here != K.U64(2**64 - 1))
            todo, at = todo[go], at[go]
        return values, found


class Level:
    """All contexts of one order: their symbols' counts, and what exclusion takes from the next shorter context."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.keys, self.counts = keys, counts.astype(np.float64)
        ctx = keys >> K.U64(8)
        self.first = np.flatnonzero(np.concatenate(([True], ctx[1:] != ctx[:-1]))) if len(keys) else np.zeros(0, np.int64)
        self.contexts = ctx[self.first]
        self.total = np.add.reduceat(self.counts, self.first) if len(keys) else np.zeros(0)
        self.kinds = np.diff(np.append(self.first, len(keys))).astype(np.float64)
        self.excluded = np.zeros(len(self.contexts))


class Trie:
    """A byte-context trie in sorted arrays, one level for each order from 0: what the tables hold, for counts that fit in one process."""

    def __init__(self, counted: list[tuple[np.ndarray, np.ndarray]]):
        self.order = len(counted) - 1
        self.levels = []
        for keys, counts in counted:
            by_key = np.argsort(keys)
            self.levels.append(Level(keys[by_key], counts[by_key]))
        for k in range(1, self.order + 1):
            up, down = self.levels[k], self.levels[k - 1]
            if len(up.keys):
                at = np.searchsorted(down.keys, up.keys & K.U64((1 << (8 * k)) - 1))
                up.excluded = np.add.reduceat(down.counts[at], up.first)
        top = self.levels[-1]
        self.direct = HashTable(top.keys, np.log10(top.counts / np.repeat(top.total + top.kinds, top.kinds.astype(np.int64))).astype(np.float32))

    def log10(self, grams: np.ndarray) -> np.ndarray:
        """log10 P(symbol | context) of each n-gram."""
        values, found = self.direct.find(grams)
        out = values.astype(np.float64)
        alive = np.flatnonzero(~found)
        gone, refused = np.zeros(len(alive)), np.zeros(len(alive))
        for k in range(self.order, -1, -1):
            level = self.levels[k]
            if not len(alive):
                break
            if not len(level.keys):
                continue
            key = grams[alive] & K.U64((1 << (8 * (k + 1))) - 1)
            ctx = key >> K.U64(8)
            at = np.minimum(np.searchsorted(level.contexts, ctx), len(level.contexts) - 1)
            known = level.contexts[at] == ctx
            sym = np.minimum(np.searchsorted(level.keys, key), len(level.keys) - 1)
            seen = level.keys[sym] == key
            kinds = level.kinds[at] - refused
            whole = level.total[at] - gone + kinds
            out[alive[seen]] += np.log10(level.counts[sym[seen]] / whole[seen])
            escape = known & ~seen
            live = escape & (kinds > 0)  # with all symbols excluded the escape is certain
            out[alive[live]] += np.log10(kinds[live] / whole[live])
            refused = np.where(escape, level.kinds[at], refused)
            gone = np.where(escape, level.excluded[at], gone)
            alive, refused, gone = alive[~seen], refused[~seen], gone[~seen]
        if len(alive):
            out[alive] -= np.log10(np.maximum(SYMBOLS - refused, 1))
        return out


def _held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def _arrays(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    t = counts.select("key", "count").toArrow()
    return np.asarray(t.column("key")).view(np.uint64), np.asarray(t.column("count"))


def _low(key: str, order: int) -> Column:
    """The last ``order`` + 1 bytes of a key."""
    return F.col(key).bitwiseAND((1 << (8 * (order + 1))) - 1)


def levels(grams: DataFrame, order: int = ORDER) -> list[DataFrame]:
    """Counts (key, count) by order from those of the longest n-grams, all of them."""
    out = [grams]
    for k in range(order - 1, -1, -1):
        grams = stored(grams.groupBy(_low("key", k).alias("key")).agg(F.sum("count").alias("count")), f"order{k}")
        out.append(grams)
    return out[::-1]


def learned(grams: DataFrame) -> DataFrame:
    """key, count and value (log10 of the probability in its own context) of the longest n-grams."""
    by = grams.groupBy(F.shiftright("key", 8)).agg(F.sum("count").alias("total"), F.collect_list(F.struct("key", "count")).alias("symbols"))
    by = by.select("total", F.size("symbols").alias("kinds"), F.explode("symbols").alias("s"))
    return by.select("s.key", "s.count", F.log10(F.col("s.count") / (F.col("total") + F.col("kinds"))).alias("value"))


def escaped(asked: DataFrame, counts: list[DataFrame]) -> DataFrame:
    """key and value of distinct longest n-grams (key) that were not learned: at each order, the contexts asked for are summed up."""
    state = asked.select("key", F.lit(None).cast("double").alias("value"), F.lit(0.0).alias("spent"), F.lit(0).cast("long").alias("refused"), F.lit(0).cast("long").alias("gone"))
    for k in range(len(counts) - 1, -1, -1):
        level = narrow(counts[k])
        state = state.withColumn("own", _low("key", k)).withColumn("context", F.shiftright("own", 8))
        here = state.where("value is null").select("context").distinct()
        members = counts[k].withColumn("context", F.shiftright("key", 8)).join(here, "context", "left_semi")
        if k:
            below = narrow(counts[k - 1]).select(F.col("key").alias("shorter"), F.col("count").alias("below"))
            members = members.withColumn("shorter", _low("key", k - 1)).join(below, "shorter")
        else:
            members = members.withColumn("below", F.lit(0))
        contexts = stored(members.groupBy("context").agg(F.sum("count").alias("total"), F.count(F.lit(1)).alias("kinds"), F.sum("below").alias("excluded")), "contexts")
        state = state.join(narrow(contexts), "context", "left").join(level.select(F.col("key").alias("own"), "count"), "own", "left")
        left = F.col("kinds") - F.col("refused")
        whole = F.col("total") - F.col("gone") + left
        escape = F.col("kinds").isNotNull() & F.col("count").isNull()
        state = state.select(
            "key",
            F.coalesce("value", F.when(F.col("count").isNotNull(), F.col("spent") + F.log10(F.col("count") / whole))).alias("value"),
            F.when(escape & (left > 0), F.col("spent") + F.log10(left / whole)).otherwise(F.col("spent")).alias("spent"),  # with all symbols excluded the escape is certain
            F.when(escape, F.col("kinds")).otherwise(F.col("refused")).alias("refused"),
            F.when(escape, F.col("excluded")).otherwise(F.col("gone")).alias("gone"),
        )
        state = stored(state, "escaped")
    return state.select("key", F.coalesce("value", F.col("spent") - F.log10(F.greatest(SYMBOLS - F.col("refused"), F.lit(1)))).alias("value"))


_ready: dict[str, HashTable] = {}


def _table(name: str, keys: np.ndarray, values: np.ndarray) -> HashTable:
    """The hot n-grams' table, built once in each Python worker."""
    if name not in _ready:
        _ready.clear()
        _ready[name] = HashTable(keys, values)
    return _ready[name]


def _row_sums(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    out = np.zeros(len(first), values.dtype)
    has = np.flatnonzero(last > first)
    if len(has):
        out[has] = np.add.reduceat(values, first[has])
    return out


def score(documents: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and bits_per_symbol for every row."""
    spark = lean(documents)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("held_out", _held_out())
    sums = docs.where("not held_out").select("text").mapInArrow(_learned, "kind int, key long, count long").groupBy("kind", "key").agg(F.sum("count").alias("count"))
    sums = stored(sums, "counts")
    tokens = sums.where("kind = 1").select("key", "count")
    total, distinct = tokens.agg(F.coalesce(F.sum("count"), F.lit(0)), F.count(F.lit(1))).first()
    grams = sums.where("kind = 0").select("key", "count")
    n_grams = grams.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
    values = stored(learned(grams), "values")
    often = F.col("count") >= n_grams / CAPACITY
    known = values.where(often).select("key", "value").toArrow()
    end = tokens.where(F.col("key") == int(END_TOKEN.view(np.int64))).first()
    end_known, end_log = end is not None, float(np.log10((end["count"] if end else 0) + 0.5))
    hot, hot_counts = _arrays(tokens.where(F.col("count") >= total / CAPACITY))
    by = np.argsort(hot)
    shared = spark.sparkContext.broadcast((np.asarray(known.column("key")).view(np.uint64), np.asarray(known.column("value")).astype(np.float32), hot[by], np.log10(hot_counts[by] + 0.5)))
    name = uuid.uuid4().hex
    norm = float(np.log10(total + 0.5 * (distinct + 1)))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, log10, hot, logs = shared.value
        table = _table(name, keys, log10)
        for batch in batches:
            for lo, hi, buf, offs in K.slices(batch.column(2), SLICE):
                here, bounds = symbols(buf, offs)
                value, is_known = table.find(here)
                value = np.add.reduceat(value.astype(np.float64), bounds[:-1])
                cold = np.concatenate(([0], np.cumsum(~is_known)))[bounds].astype(np.int32)
                w = K.Words(buf, offs)
                at = np.minimum(np.searchsorted(hot, w.hash), max(0, len(hot) - 1))
                is_hot = hot[at] == w.hash if len(hot) else np.zeros(len(w.hash), bool)
                n_hot = _row_sums(is_hot.astype(np.int64), w.first, w.last)
                hot_sum = _row_sums(np.where(is_hot, logs[at], 0.0) if len(hot) else np.zeros(len(w.hash)), w.first, w.last)
                rare = np.concatenate(([0], np.cumsum(w.last - w.first - n_hot))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo),
                        batch.column(1).slice(lo, hi - lo),
                        pa.array((w.last - w.first + 1).astype(np.int64)),
                        pa.array(n_hot + int(end_known)),
                        pa.array(hot_sum + end_log),
                        pa.ListArray.from_arrays(pa.array(rare), pa.array(w.hash[~is_hot].view(np.int64))),
                        pa.ListArray.from_arrays(pa.array(cold), pa.array(here[~is_known].view(np.int64))),
                        pa.array(value),
                        pa.array(np.diff(bounds).astype(np.int64)),
                    ],
                    names=["doc_id", "held_out", "n_tokens", "n_hot", "hot_sum", "rare", "cold", "hot_score", "n_symbols"],
                )

    schema = "doc_id long, held_out boolean, n_tokens long, n_hot long, hot_sum double, rare array<long>, cold array<long>, hot_score double, n_symbols long"
    rows = stored(docs.select("doc_id", "held_out", "text").mapInArrow(scored, schema).withColumn("row", F.monotonically_increasing_id()), "scored")
    rare = rows.select("row", F.explode("rare").alias("key"))
    looked = rare.join(tokens, "key", "left").groupBy("row").agg(F.sum(F.log10(F.coalesce("count", F.lit(0)) + 0.5)).alias("rare_sum"), F.count("count").alias("n_rare"))

    seldom = values.where(~often).select("key", "value")
    new = rows.where("held_out").select(F.explode("cold").alias("key")).distinct().join(seldom, "key", "left_anti")
    seldom = seldom.unionByName(escaped(stored(new, "new"), levels(grams)))
    cold = rows.select("row", F.explode("cold").alias("key")).join(seldom, "key").groupBy("row").agg(F.sum("value").alias("cold_score"))
    rows = rows.drop("rare", "cold").join(looked, "row", "left").join(cold, "row", "left").withColumn("score", F.col("hot_score") + F.coalesce("cold_score", F.lit(0.0)))
    return rows.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_hot") + F.coalesce("n_rare", F.lit(0))).alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("hot_sum") + F.coalesce("rare_sum", F.lit(0.0)) - F.col("n_tokens") * norm).alias("base_score"),
        "score",
        (-F.col("score") / float(np.log10(2)) / F.col("n_symbols")).alias("bits_per_symbol"),
    )
