"""Ranked lexical search: short posting lists are summed first, then read as one list beside the long ones.

1. *Items* (the queries) are taken in blocks of at most ``TERMS`` terms, so that what is sent to tasks is bounded for any number of items.
2. *Index*: the documents of a task become blocks of ``BLOCK_DOCS`` documents with inverted lists (document, tf) of just the terms that
   some item of the block has; counts N, L and df are summed over all blocks. The index is a stored table.
3. *Search* of an index block, for each item. Lists under ``SHORT`` postings are summed term at a time into accumulators (documents and
   sums, ascending). From there on the accumulators are one more list: like a long list they have a bound over the block and a bound for
   each window of ``WINDOW`` documents. Documents are then scored document at a time, a run of windows in one go: a window whose bounds
   add up to less than the k-th best score so far is skipped; lists whose bounds together stay below that score give no candidates and
   are only looked up, greatest bound first, for candidates that can still reach it.
4. Each task keeps the best k of each item over all its index blocks; ranks are given to what the tasks have kept.

No document is skipped that could be among the best k, ties included, so results equal a full scoring.

Defined cases: a null text, an empty one or one without a term has no terms and is no document of N; each row of ``documents`` is a
document of its own, also where doc_ids repeat; a null doc_id is ranked after others of its score; rows that share an item_id are one item
with the terms of all of them; an item without id, without terms or without a document above 0 gives no rows; an empty table gives none;
further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldweave.llm import kernels as K
from fieldweave.llm.workspace import lean, stored

#: Terms (with repeats over items) of a block of items: what a task gets of the queries
TERMS = 1 << 17
#: Documents and postings of an index block
BLOCK_DOCS, BLOCK_POSTINGS = 4096, 1 << 18
#: Postings in an index block from which a list is long, and documents of a window
SHORT, WINDOW = 128, 64

#: Bytes that are not part of a term, as blanks: all of ASCII but digits and letters
_TERM_BYTES = np.array([b if b >= 128 or chr(b).isalnum() else 0x20 for b in range(256)], np.uint8)

INDEX = "n_docs long, n_terms long, terms array<int>, dfs array<int>, docs array<long>, lengths binary, doc binary, tf binary"


def _words(buf: np.ndarray, offs: np.ndarray) -> K.Words:
    return K.Words(_TERM_BYTES[buf], offs)


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, buf, offs in K.slices(batch.column(1)):
            words = _words(buf, offs)
            ids = batch.column(0).slice(lo, hi - lo).take(pa.array(np.repeat(np.arange(hi - lo), words.last - words.first)))
            yield pa.RecordBatch.from_arrays([ids, pa.array(words.hash.view(np.int64))], names=["item_id", "term"])


def item_blocks(items: DataFrame, limit: int) -> Iterator[list[tuple[int, np.ndarray]]]:
    """Blocks of (item_id, sorted term hashes) with at most ``limit`` terms, or of one item; one block is held at a time."""
    pairs = items.mapInArrow(_item_terms, "item_id long, term long").where("item_id is not null")
    block, held = [], 0
    for row in pairs.groupBy("item_id").agg(F.collect_set("term").alias("terms")).toLocalIterator():
        if block and held + len(row["terms"]) > limit:
            yield block
            block, held = [], 0
        block.append((row["item_id"], np.sort(np.array(row["terms"], np.int64))))
        held += len(row["terms"])
    if block:
        yield block


def _indexed(vocabulary: np.ndarray) -> Callable:
    """Index blocks of documents over the terms of ``vocabulary`` (sorted hashes)."""

    def block(ids: list[pa.Array], lengths: list[np.ndarray], post: list[np.ndarray], n_docs: int, n_terms: int) -> pa.RecordBatch:
        term, doc, tf = np.concatenate(post, axis=1) if post else np.zeros((3, 0), np.int64)
        order = np.argsort(term, kind="stable")  # documents stay ascending within a term
        terms, dfs = np.unique(term, return_counts=True)
        docs = pa.concat_arrays(ids) if ids else pa.array([], pa.int64())
        row = [[n_docs], [n_terms], [terms.astype(np.int32)], [dfs.astype(np.int32)], pa.array([docs.to_pylist()], pa.list_(pa.int64()))]
        row += [[x.astype(np.int32).tobytes()] for x in (np.concatenate(lengths) if lengths else np.zeros(0), doc[order], tf[order])]
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), None, pa.binary(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([x if kind is None else pa.array(x, kind) for x, kind in zip(row, kinds, strict=True)], names=[c.split()[0] for c in INDEX.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, lengths, post, n_docs, n_terms, docs, postings = [], [], [], 0, 0, 0, 0
        for batch in batches:
            for lo, hi, buf, offs in K.slices(batch.column(1)):
                words = _words(buf, offs)
                n = words.last - words.first
                n_docs, n_terms = n_docs + int((n > 0).sum()), n_terms + int(n.sum())
                got = words.hash.view(np.int64)
                at = np.minimum(np.searchsorted(vocabulary, got), len(vocabulary) - 1)
                hit = np.flatnonzero(vocabulary[at] == got)
                row = np.repeat(np.arange(hi - lo), n)[hit]
                keys, tf = np.unique(row * len(vocabulary) + at[hit], return_counts=True)
                row, term = keys // len(vocabulary), keys % len(vocabulary)
                own = np.unique(row)  # documents with any of the terms
                ids.append(batch.column(0).slice(lo, hi - lo).take(pa.array(own)))
                lengths.append(n[own])
                post.append(np.stack((term, docs + np.searchsorted(own, row), tf)))
                docs, postings = docs + len(own), postings + len(tf)
                if docs >= BLOCK_DOCS or postings >= BLOCK_POSTINGS:
                    yield block(ids, lengths, post, n_docs, n_terms)
                    ids, lengths, post, n_docs, n_terms, docs, postings = [], [], [], 0, 0, 0, 0
        if n_docs:
            yield block(ids, lengths, post, n_docs, n_terms)

    return run


@dataclass
class Best:
    """The best k (score, doc_id) of an item so far."""

    k: int
    score: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    doc: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    known: np.ndarray = field(default_factory=lambda: np.zeros(0, bool))  # that doc_id is not null

    def least(self) -> int:
        """What a score must reach to count."""
        return int(self.score[-1]) if len(self.score) >= self.k else 1

    def add(self, score: np.ndarray, doc: np.ndarray, known: np.ndarray) -> None:
        score, doc, known = np.concatenate((self.score, score)), np.concatenate((self.doc, doc)), np.concatenate((self.known, known))
        order = np.lexsort((doc, ~known, -score))[: self.k]
        self.score, self.doc, self.known = score[order], doc[order], known[order]


def summed(docs: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending distinct documents and the sums of their values."""
    order = np.argsort(docs, kind="stable")
    docs, values = docs[order], values[order]
    first = np.flatnonzero(np.r_[True, docs[1:] != docs[:-1]]) if len(docs) else np.zeros(0, np.int64)
    return docs[first], np.add.reduceat(values, first) if len(first) else values


def window_bounds(docs: np.ndarray, values: np.ndarray, windows: int) -> np.ndarray:
    """The greatest value in each window of documents."""
    out = np.zeros(windows, np.int64)
    at = docs // WINDOW
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    out[at[first]] = np.maximum.reduceat(values, first)
    return out


def search_block(lists: list[tuple[np.ndarray, np.ndarray, np.ndarray]], windows: int, best: Best, ids: np.ndarray, known: np.ndarray) -> None:
    """Document-at-a-time over ``lists`` (documents, values, window bounds); puts what counts into ``best``."""
    lists = sorted(lists, key=lambda x: int(x[2].max()))
    reach = np.cumsum([int(x[2].max()) for x in lists])  # what the lists up to here can add together
    total = np.sum([x[2] for x in lists], axis=0)
    lo, step = 0, 2
    while lo < windows:
        hi, least = min(windows, lo + step), best.least()
        live = total[lo:hi] >= least
        if live.any():
            giving = int(np.searchsorted(reach, least))  # lists from here on give candidates
            docs, values = [], []
            for d, v, _ in lists[giving:]:
                a, b = np.searchsorted(d, (lo * WINDOW, hi * WINDOW))
                keep = live[d[a:b] // WINDOW - lo]
                docs.append(d[a:b][keep])
                values.append(v[a:b][keep])
            doc, score = summed(np.concatenate(docs), np.concatenate(values)) if docs else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            for k in range(giving - 1, -1, -1):
                can = score + reach[k] >= least
                doc, score = doc[can], score[can]
                d, v, _ = lists[k]
                at = np.minimum(np.searchsorted(d, doc), len(d) - 1)
                score = score + np.where(d[at] == doc, v[at], 0)
            keep = score >= least
            best.add(score[keep], ids[doc[keep]], known[doc[keep]])
        lo, step = hi, step * 4


def _searched(items: list[tuple[int, np.ndarray]], weights: np.ndarray, n_docs: int, n_terms: int, k: int) -> Callable:
    """The best ``k`` of each item (id, its places in the vocabulary) over a task's index blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(k) for _ in items]
        for batch in batches:
            for r in range(batch.num_rows):
                value = lambda c: batch.column(c)[r]
                lengths, doc, tf = (np.frombuffer(value(c).as_buffer(), np.int32).astype(np.int64) for c in ("lengths", "doc", "tf"))
                if not len(doc):
                    continue
                docs = value("docs").values
                ids, known = docs.fill_null(0).to_numpy(), docs.is_valid().to_numpy(zero_copy_only=False)
                m = 50 + (50 * lengths * n_docs // n_terms if int(lengths.max()) * 50 * n_docs < 1 << 63 else np.array([50 * int(x) * n_docs // n_terms for x in lengths], np.int64))
                impact = 1_000_000_000 * tf // (1000 * tf + 20 * m[doc])
                terms, dfs = (value(c).values.to_numpy().astype(np.int64) for c in ("terms", "dfs"))
                end = np.cumsum(dfs)
                windows = -(-len(lengths) // WINDOW)
                bounds: dict[int, np.ndarray] = {}
                for best_of, (_, places) in zip(best, items, strict=True):
                    at = np.minimum(np.searchsorted(terms, places), len(terms) - 1)
                    at = at[terms[at] == places]
                    if not len(at):
                        continue
                    lists = []
                    for x in at[dfs[at] >= SHORT]:
                        span = slice(end[x] - dfs[x], end[x])
                        if x not in bounds:
                            bounds[x] = window_bounds(doc[span], impact[span], windows)
                        lists.append((doc[span], impact[span] * weights[terms[x]], bounds[x] * weights[terms[x]]))
                    if len(few := at[dfs[at] < SHORT]):
                        spans = np.repeat(end[few] - np.cumsum(dfs[few]), dfs[few]) + np.arange(dfs[few].sum())
                        acc = summed(doc[spans], impact[spans] * np.repeat(weights[terms[few]], dfs[few]))
                        lists.append((*acc, window_bounds(*acc, windows)))
                    search_block(lists, windows, best_of, ids, known)
        for b, (item, _) in zip(best, items, strict=True):
            if len(b.score):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(b.score), item)), pa.array(b.doc, mask=~b.known), pa.array(b.score)], names=["item_id", "doc_id", "score"])

    return run


def search(documents: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` best of ``documents`` (doc_id, text) for each of ``items`` (item_id, text)."""
    lean(documents)
    documents = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    found = documents.sparkSession.createDataFrame([], "item_id long, doc_id long, score long")
    for block in item_blocks(items, TERMS):
        vocabulary = np.unique(np.concatenate([terms for _, terms in block]))
        index = stored(documents.mapInArrow(_indexed(vocabulary), INDEX), "index")
        counts = index.agg(F.sum("n_docs").alias("n"), F.sum("n_terms").alias("l")).first()
        if not counts["n"]:
            continue
        pairs = index.select(F.explode(F.arrays_zip("terms", "dfs")).alias("t")).groupBy("t.terms").agg(F.sum("t.dfs").alias("df"))
        df = np.zeros(len(vocabulary), np.int64)  # at most TERMS rows, or those of one item
        for row in pairs.toLocalIterator():
            df[row["terms"]] = row["df"]
        weights = np.floor(1000 * np.log((2.0 * counts["n"] + 2) / (2.0 * df + 1))).astype(np.int64)
        placed = [(item, np.searchsorted(vocabulary, terms)) for item, terms in block]
        found = found.unionByName(index.mapInArrow(_searched(placed, weights, counts["n"], counts["l"], k), "item_id long, doc_id long, score long"))
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
