"""MinHash near-duplicate detection with sequential Bayesian verification.

1. Each text becomes its set of five-word shingles and a signature of ``BANDS * ROWS`` MinHash values. Texts with the
   same word sequence form a class, represented by its least doc_id, so copies cost one row each from here on.
2. Banding: representatives that agree on the ``ROWS`` values of a band share a bucket, whose least member is its hub. Each
   representative is first compared with the least of its hubs only, which joins the bulk of a large group of copies in
   linear work.
3. What is still apart within a bucket is compared in cells: members outside the hub's component meet all members of
   the bucket, ``BLOCK`` by ``BLOCK``. Pairs stay inside their cell, as arrays; pairs of one component are not looked at.
4. Sequential Bayesian verification: signatures are compared batch by batch. With m of n values equal, the posterior of
   the similarity (uniform prior) gives P(similarity >= THRESHOLD); a pair is dropped once that is under ``MISS``.
5. Survivors are confirmed on their full shingle sets, which are derived again from the texts of just those documents; a
   cell gets each set once.
6. Connected components of the confirmed links.

Defined cases: null or empty text and text without words has no shingles, no links and is its own component; fewer than
five words make one shingle of the whole sequence; rows that share a doc_id are one document with several texts, linked
by any of them; a null doc_id takes part in no link and is kept with a null component; further columns are ignored.
A pair at the threshold misses all bands with probability (1 - 0.75**6)**44 < 0.0002, at 0.8 with 2e-6.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldweave.llm import kernels as K
from fieldweave.llm.components import connected_components
from fieldweave.llm.workspace import lean, narrow, partitions, spread_join, stored

THRESHOLD = (75, 100)
ROWS, BANDS = 6, 44
BATCH = 33
MISS = 1e-4
BLOCK = 256

_MULS = np.random.default_rng(75100).integers(1, 2**63, ROWS * BANDS, dtype=np.uint64) * K.U64(2) + K.U64(1)


def signatures(hashes: np.ndarray, first: np.ndarray, last: np.ndarray, muls: np.ndarray = _MULS) -> np.ndarray:
    """MinHash values (rows x len(muls), uint32) of the shingle runs [first, last); zeros where a run is empty."""
    out = np.zeros((len(first), len(muls)), np.uint32)
    has = np.flatnonzero(last > first)
    if not len(has):
        return out
    step = 1 << 15  # stays in the processor's cache
    with np.errstate(over="ignore"):
        least = np.full((len(muls), len(has)), np.uint64(2**64 - 1))
        starts = first[has]
        for lo in range(0, len(hashes), step):
            part = hashes[lo : lo + step]
            a = int(np.searchsorted(last[has], lo, side="right"))
            b = int(np.searchsorted(starts, lo + len(part), side="left"))
            cuts = np.maximum(starts[a:b] - lo, 0)
            for k, mul in enumerate(muls):
                np.minimum(least[k, a:b], np.minimum.reduceat(part * mul, cuts), out=least[k, a:b])
    out[has] = (least >> K.U64(32)).astype(np.uint32).T
    return out


@lru_cache
def least_matches(n: int, threshold: float, miss: float) -> int:
    """The fewest equal values among n that keep P(similarity >= threshold | matches) at ``miss`` or more."""
    s = (np.arange(20000) + 0.5) / 20000
    for m in range(n + 1):
        logs = m * np.log(s) + (n - m) * np.log1p(-s)
        p = np.exp(logs - logs.max())
        if p[s >= threshold].sum() / p.sum() >= miss:
            return m
    return n


def surviving(a: np.ndarray, b: np.ndarray, threshold: float, miss: float = MISS, batch: int = BATCH) -> np.ndarray:
    """Indices of the pairs (rows of a and b) that no batch prunes."""
    alive = np.arange(len(a))
    equal = np.zeros(len(a), np.int32)
    for lo in range(0, a.shape[1], batch):
        hi = min(lo + batch, a.shape[1])
        equal = equal + (a[alive, lo:hi] == b[alive, lo:hi]).sum(axis=1)
        keep = equal >= least_matches(hi, threshold, miss)
        alive, equal = alive[keep], equal[keep]
    return alive


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0)
        for lo, hi, buf, offs in K.slices(batch.column(1)):
            words = K.Words(buf, offs)
            a, b = words.sequence_keys()
            hashes, first, last = words.shingles()
            sizes = np.array([len(np.unique(hashes[x:y])) if y - x > 1 else y - x for x, y in zip(first, last, strict=True)], np.int64)
            sig = signatures(hashes, first, last)
            packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * sig.shape[1]), len(sig), [None, pa.py_buffer(np.ascontiguousarray(sig))]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), pa.array(a), pa.array(b), pa.array(sizes), packed], names=["doc_id", "key_a", "key_b", "n_shingles", "sig"])


def _unpacked(column: pa.Array, width: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    offs = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if len(column) == 0:
        return np.zeros((0, width), np.uint32)
    return np.frombuffer(column.buffers()[2], np.uint8)[offs[0] : offs[-1]].view(np.uint32).reshape(len(column), width)


def band_keys(sig: np.ndarray) -> np.ndarray:
    """A 64-bit key for each row and band; equal only where the band's values are (but for hash accidents)."""
    with np.errstate(over="ignore"):
        s = sig.astype(np.uint64).reshape(len(sig), BANDS, ROWS)
        key = np.zeros((len(sig), BANDS), np.uint64)
        for r in range(ROWS):
            key = (key + s[:, :, r]) * K.SHINGLE_MUL[r]
            key ^= key >> K.U64(29)
        return K.mix(key + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def _banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = band_keys(_unpacked(batch.column(1), ROWS * BANDS))
        ids = np.repeat(np.asarray(batch.column(0)), BANDS)
        yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(ids)], names=["bucket", "id"])


def _pruned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (x, y, sig_x, sig_y) that survive the sequential comparison."""
    t = THRESHOLD[0] / THRESHOLD[1]
    for batch in batches:
        keep = surviving(_unpacked(batch.column(2), ROWS * BANDS), _unpacked(batch.column(3), ROWS * BANDS), t)
        yield pa.RecordBatch.from_arrays([batch.column(k).take(pa.array(keep)) for k in (0, 1)], names=["x", "y"])


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets of hashes reach the threshold."""
    num, den = THRESHOLD
    least, most = (len(a), len(b)) if len(a) < len(b) else (len(b), len(a))
    if least == 0 or den * least < num * most:
        return False
    both = np.concatenate((a, b))
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return den * common >= num * (least + most - common)


def _set_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, sorted distinct shingle hashes as bytes)."""
    for batch in batches:
        for lo, hi, buf, offs in K.slices(batch.column(1)):
            hashes, first, last = K.Words(buf, offs).shingles()
            sets = [np.unique(hashes[x:y]).tobytes() for x, y in zip(first, last, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(sets, pa.binary())], names=["doc_id", "shingles"])


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (x, y, set_x, set_y) whose exact similarity reaches the threshold."""
    for batch in batches:
        sets = [[np.frombuffer(v.as_buffer(), np.uint64) for v in batch.column(k)] for k in (2, 3)]
        keep = [k for k, (a, b) in enumerate(zip(*sets, strict=True)) if similar(a, b)]
        yield pa.RecordBatch.from_arrays([batch.column(k).take(pa.array(keep, pa.int64())) for k in (0, 1)], names=["a", "b"])


def _by_cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The runs of equal ``cell`` of rows sorted by it."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        cells = np.asarray(batch.column("cell"))
        cuts = [0, *(np.flatnonzero(cells[1:] != cells[:-1]) + 1).tolist(), len(cells)] if len(cells) else [0]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if held and cells[lo] != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(lo, hi - lo))
            last = cells[lo]
    if held:
        yield pa.Table.from_batches(held)


def _blocked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each cell, the pairs of its queries and targets that survive, as two arrays."""
    t = THRESHOLD[0] / THRESHOLD[1]
    for table in _by_cell(batches):
        ask = np.asarray(table.column("query"))
        ids, comp, bucket = (np.asarray(table.column(c)) for c in ("id", "component", "bucket"))
        sig = _unpacked(table.column("sig"), ROWS * BANDS)
        keys = band_keys(sig)
        to = np.flatnonzero(~ask)
        xs, ys = [], []
        for x in np.flatnonzero(ask):
            others = to[comp[to] != comp[x]]
            same = keys[others] == keys[x]  # a pair counts in the first band in which it meets
            others = others[same.argmax(axis=1) == np.flatnonzero(keys[x] == bucket[x])[0]]
            others = others[surviving(np.broadcast_to(sig[x], (len(others), sig.shape[1])), sig[others], t)]
            xs.append(np.full(len(others), ids[x]))
            ys.append(ids[others])
        x, y = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (xs, ys))
        pairs = np.unique(np.stack((np.minimum(x, y), np.maximum(x, y)), axis=1), axis=0)
        if len(pairs):
            yield pa.RecordBatch.from_arrays([table.column("cell").combine_chunks()[:1], *(pa.array([pairs[:, k]], pa.list_(pa.int64())) for k in (0, 1))], names=["cell", "xs", "ys"])


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The confirmed links of each cell, from its pairs and the sets of their members."""
    for table in _by_cell(batches):
        sets: dict[int, list[np.ndarray]] = {}
        pairs: list[tuple[int, int]] = []
        for batch in table.to_batches():
            for k in range(batch.num_rows):
                if batch.column("xs")[k].is_valid:
                    pairs += zip(batch.column("xs")[k].as_py(), batch.column("ys")[k].as_py(), strict=True)
                else:
                    sets.setdefault(batch.column("id")[k].as_py(), []).append(np.frombuffer(batch.column("shingles")[k].as_buffer(), np.uint64))
        found = [(x, y) for x, y in pairs if any(similar(a, b) for a in sets.get(x, ()) for b in sets.get(y, ()))]
        yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], names=["a", "b"])


def _sets_of(documents: DataFrame, ids: DataFrame) -> DataFrame:
    """Shingle sets of just the documents in ``ids`` (doc_id), derived again from their texts."""
    ids = narrow(stored(ids.distinct(), "ids"))
    return documents.select("doc_id", "text").join(ids, "doc_id", "left_semi").mapInArrow(_set_rows, "doc_id long, shingles binary")


def _near_hub(documents: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (x, y) that full shingle sets confirm, as (a, b)."""
    sets = stored(_sets_of(documents, pairs.select(F.col("x").alias("doc_id")).unionByName(pairs.select(F.col("y").alias("doc_id")))), "sets")
    own = spread_join(pairs, sets.select(F.col("doc_id").alias("y"), F.col("shingles").alias("set_y")), "y", ["x"])
    return own.join(sets.select(F.col("doc_id").alias("x"), F.col("shingles").alias("set_x")), "x").select("x", "y", "set_x", "set_y").mapInArrow(_confirmed, "a long, b long")


def _within_cells(documents: DataFrame, cells: DataFrame) -> DataFrame:
    """The pairs of ``cells`` (cell, xs, ys) that full shingle sets confirm, as (a, b)."""
    wanted = cells.select("cell", F.explode(F.array_distinct(F.concat("xs", "ys"))).alias("id"))
    sets = _sets_of(documents, wanted.select(F.col("id").alias("doc_id"))).withColumnRenamed("doc_id", "id")
    rows = wanted.join(sets, "id").select("cell", "id", "shingles").unionByName(cells, allowMissingColumns=True)
    return rows.repartition(partitions(documents.sparkSession), "cell").sortWithinPartitions("cell").mapInArrow(_settled, "a long, b long")


def near_duplicates(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of ``documents`` (doc_id, text and any other columns)."""
    spark = lean(documents)
    documents = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = stored(documents.mapInArrow(_signed, "doc_id long, key_a long, key_b long, n_shingles long, sig binary"), "signatures")
    usable = signed.where("n_shingles > 0 and doc_id is not null")
    reps = stored(usable.groupBy("key_a", "key_b").agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("members")), "classes")
    copies = usable.select("doc_id", "key_a", "key_b").join(reps.where("members > 1"), ["key_a", "key_b"]).select(F.col("doc_id").alias("a"), F.col("id").alias("b")).where("a <> b")

    firsts = narrow(reps.select("key_a", "key_b", F.col("id").alias("doc_id"), "members"))
    sigs = usable.join(firsts, ["doc_id", "key_a", "key_b"]).select(F.col("doc_id").alias("id"), "sig", "members")
    once, again = sigs.where("members = 1").drop("members"), sigs.where("members > 1").drop("members")
    sigs = stored(once.unionByName(again.dropDuplicates()), "representatives")  # a repeated row stands for itself once
    members = sigs.mapInArrow(_banded, "bucket long, id long")
    hubs = stored(members.groupBy("bucket").agg(F.min("id").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1"), "hubs")
    members = stored(members.join(hubs, "bucket"), "members")

    met = narrow(stored(members.select("id").distinct(), "ids"))
    sigs = sigs.join(met, "id", "left_semi")
    near = stored(members.where("id <> hub").groupBy("id").agg(F.min("hub").alias("y")).withColumnRenamed("id", "x"), "near")
    sig_x, sig_y = sigs.select(F.col("id").alias("x"), F.col("sig").alias("sig_x")), sigs.select(F.col("id").alias("y"), F.col("sig").alias("sig_y"))
    near = stored(spread_join(near, sig_y, "y", ["x"]).join(sig_x, "x").select("x", "y", "sig_x", "sig_y").mapInArrow(_pruned, "x long, y long"), "pairs")
    links = stored(_near_hub(documents, near), "links")
    joined = connected_components(links)

    # What the hubs left apart: members of another component than their bucket's hub meet all of the bucket, in cells.
    label = joined.select("id", "component")
    named = members.join(label, "id", "left").withColumn("component", F.coalesce("component", "id"))
    of_hub = label.select(F.col("id").alias("hub"), F.col("component").alias("hub_component"))
    named = named.join(of_hub, "hub", "left").withColumn("query", F.col("component") != F.coalesce("hub_component", "hub")).drop("hub_component")
    asked = named.groupBy("bucket").agg(F.count_if("query").alias("q")).where("q > 0")
    named = stored(named.join(asked, "bucket"), "apart")
    n_to, n_ask = F.ceil(F.col("n") / BLOCK).cast("int"), F.ceil(F.col("q") / BLOCK).cast("int")
    to = named.select("bucket", "id", "component", F.lit(False).alias("query"), F.pmod(F.xxhash64("id"), n_to).cast("int").alias("t"), F.explode(F.sequence(F.lit(0), n_ask - 1)).alias("a"))
    ask = named.where("query").select("bucket", "id", "component", "query", F.explode(F.sequence(F.lit(0), n_to - 1)).alias("t"), F.pmod(F.xxhash64("id", F.lit(1)), n_ask).cast("int").alias("a"))
    cells = to.unionByName(ask).join(sigs, "id").select(F.xxhash64("bucket", "t", "a").alias("cell"), "bucket", "id", "component", "query", "sig")
    dealt = cells.repartition(partitions(spark), "cell").sortWithinPartitions("cell")
    rest = stored(dealt.mapInArrow(_blocked, "cell long, xs array<long>, ys array<long>"), "pairs")
    more = stored(_within_cells(documents, rest), "links")

    whole = connected_components(links.unionByName(more).unionByName(copies)).select(F.col("id").alias("doc_id"), "component")
    return (
        signed.select("doc_id", "n_shingles")
        .join(whole, "doc_id", "left")
        .select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )
