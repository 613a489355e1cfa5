"""Substring dedup: paragraph MinHash banding over overlapping, content-placed paragraphs.

A passage that is pasted into other texts rarely keeps its line breaks, so paragraphs are placed by content: one of ``SIZE`` words
begins at every word whose hash with the next word is the least within ``REACH`` words to either side (and at least every
``FARTHEST`` words). Paragraphs overlap, so a shared passage of 51 words or more holds whole ones wherever it stands.

1. Every paragraph gets ``BANDS`` keys of ``ROWS`` MinHash values over its five-word shingles, as many as ``tuned`` finds for the recall
   wanted of one paragraph at the threshold. Spark counts keys, each once in a text; a filter of fixed size (``FILTER_BITS``) tells those of two texts.
   It never loses one; when it fills up, more is looked at for nothing.
2. Paragraphs with a repeated key are collected; equal ones are one class from here on. Colliding classes are joined with the least
   class of their bucket first; those that stay apart from it then meet the whole bucket, in cells of ``BLOCK`` by ``BLOCK``.
3. Exact Jaccard similarity of the shingle sets confirms every link; connected components of links are the repeats.
4. Of a component in several documents the paragraph in the least doc_id stays, those in all other documents go. Paragraphs that go one
   after the other make a stretch, which is laid against the words that stay: it is grown or trimmed to the words that both share, over
   edits of up to ``GAP`` words, if exact Jaccard similarity holds for the whole; else the paragraphs go as they are.

Defined cases: null or empty texts and texts under ``SIZE`` words have no paragraphs; a null doc_id is neither compared nor cut; rows with equal
doc_id and text are cut alike, rows that only share a doc_id each by their own text and not against each other; very long texts are read
whole; a cut joins what is left with a line break; other columns, whatever their names, are kept as they are by ``cut``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from fieldweave.llm import kernels as K
from fieldweave.llm.components import connected_components
from fieldweave.llm.near_dup import similar
from fieldweave.llm.workspace import lean, narrow, partitions, spread_join, stored

REACH = 3
FARTHEST = 24
SIZE = 40
SHINGLE = 5
THRESHOLD, RECALL, ROWS = 0.75, 0.9, 2
GAP = 8
CONTEXT = 64
SHIFT = 16
LEAST_RUN = SIZE - GAP // 2
FILTER_BITS = 27
BLOCK = 256

_MULS = np.random.default_rng(5175).integers(1, 2**63, 64, dtype=np.uint64) * K.U64(2) + K.U64(1)


def tuned(threshold: float = THRESHOLD, recall: float = RECALL, rows: int = ROWS) -> int:
    """The fewest bands of ``rows`` values that catch a pair at the threshold with the recall wanted."""
    bands = 1
    while 1 - (1 - threshold**rows) ** bands < recall:
        bands += 1
    return bands


BANDS = tuned()


def shingled(h: np.ndarray) -> np.ndarray:
    """The hash of the shingle that begins at each word (none for the last four)."""
    n = len(h) - SHINGLE + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        full = h[:n] * K.SHINGLE_MUL[0]
        for j in range(1, SHINGLE):
            full += h[j : n + j] * K.SHINGLE_MUL[j]
        return K.mix(full)


class Paragraphs:
    """The paragraphs of a slice: first words, rows, keys and contents."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray):
        w = self.words = K.Words(buf, offs)
        n, h = len(w.hash), w.hash
        rows = np.repeat(np.arange(len(offs) - 1), w.last - w.first)
        pair = np.full(n + 2 * REACH + (len(offs) - 1) * REACH, 2**64 - 1, np.uint64)
        at = np.arange(n) + rows * REACH + REACH
        if n > 1:
            with np.errstate(over="ignore"):
                two = K.mix(h[:-1] * K.SHINGLE_MUL[0] + h[1:] * K.SHINGLE_MUL[1])
            inside = rows[:-1] == rows[1:]
            pair[at[:-1][inside]] = two[inside]
        own = pair[at]
        placed = own < K.U64(2**64 - 1)
        for k in range(1, REACH + 1):
            placed &= (own < pair[at - k]) & (own <= pair[at + k])
        placed[w.first[w.last > w.first]] = True
        start = np.flatnonzero(placed)
        size = np.diff(np.append(start, n))
        more = np.maximum(1, -(-size // FARTHEST))
        nth = np.arange(int(more.sum())) - np.repeat(np.cumsum(more) - more, more)
        begin = np.repeat(start, more) + nth * FARTHEST
        self.begin = begin[begin + SIZE <= w.last[rows[begin]]] if n else begin
        self.row = rows[self.begin]
        self.shingles = np.append(shingled(h), K.U64(0))
        self.spans = np.stack((self.begin, self.begin + SIZE - SHINGLE + 1), axis=1).ravel()

    def keys(self) -> np.ndarray:
        """paragraphs x BANDS; a key also holds the two words that the paragraph begins with, else it would meet its own neighbours."""
        out = np.zeros((len(self.begin), BANDS), np.uint64)
        if len(self.begin):
            h = self.words.hash
            with np.errstate(over="ignore"):
                out += (h[self.begin] * K.SHINGLE_MUL[0] + h[self.begin + 1] * K.SHINGLE_MUL[1])[:, None]
                for k in range(BANDS * ROWS):
                    least = np.minimum.reduceat(self.shingles * _MULS[k], self.spans)[::2]
                    out[:, k // ROWS] = K.mix(out[:, k // ROWS] * K.BASE + least + K.U64(k))
        return out

    def contents(self) -> np.ndarray:
        """A 64-bit hash of each paragraph's words in order."""
        h = self.words.hash
        with np.errstate(over="ignore"):
            total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * K.powers(K.BASE, len(h)), dtype=np.uint64)))
            return K.mix((total[self.begin + SIZE] - total[self.begin]) * K.powers(K.BASE_INV, len(h) + 1)[self.begin])


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every key of a text once, so that a key seen twice is one of two texts."""
    for batch in batches:
        for _, _, buf, offs in K.slices(batch.column(0)):
            p = Paragraphs(buf, offs)
            key, row = p.keys().ravel(), np.repeat(p.row, BANDS)
            by = np.lexsort((key, row))
            key, row = key[by], row[by]
            once = np.concatenate(([True], (key[1:] != key[:-1]) | (row[1:] != row[:-1]))) if len(key) else np.zeros(0, bool)
            yield pa.RecordBatch.from_arrays([pa.array(key[once].view(np.int64))], names=["key"])


def _bitmap(keys: DataFrame) -> np.ndarray:
    """The filter over ``keys`` (key): 2 ** FILTER_BITS bits at most leave the cluster, whatever the number of keys."""
    bits = keys.select(F.expr(f"shiftrightunsigned(key, {64 - FILTER_BITS})").alias("bit")).select(F.expr("shiftright(bit, 6)").alias("at"), F.expr("shiftleft(1L, cast(bit & 63 as int))").alias("bits"))
    words = bits.groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    out[np.asarray(words.column("at"))] = np.asarray(words.column("bits")).view(np.uint64)
    return out


def _in(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    bit = keys >> K.U64(64 - FILTER_BITS)
    return (bitmap[(bit >> K.U64(6)).astype(np.int64)] >> (bit & K.U64(63))) & K.U64(1) == 1


def _matrix(column: pa.Array) -> np.ndarray:
    """The word hashes of paragraphs (rows x SIZE)."""
    column = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).cast(pa.large_binary())
    offs = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[offs[0] : offs[-1]].view(np.uint64).reshape(-1, SIZE) if len(column) else np.zeros((0, SIZE), np.uint64)


def _sets(words: np.ndarray, side: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingles of each row, their distinct number); a shingle seen again in its row gives way to a value that no other side has."""
    n = SIZE - SHINGLE + 1
    with np.errstate(over="ignore"):
        full = words[:, :n] * K.SHINGLE_MUL[0]
        for j in range(1, SHINGLE):
            full += words[:, j : n + j] * K.SHINGLE_MUL[j]
        full = K.mix(full)
    full.sort(axis=1)
    again = np.zeros(full.shape, bool)
    again[:, 1:] = full[:, 1:] == full[:, :-1]
    return np.where(again, np.arange(n, dtype=np.uint64) + K.U64(n * side), full), n - again.sum(axis=1)


def _alike(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Whether the sets of each row of x and y reach the threshold."""
    both = np.concatenate((x[0], y[0]), axis=1)
    both.sort(axis=1)
    common = (both[:, 1:] == both[:, :-1]).sum(axis=1)
    return 4 * common >= 3 * (x[1] + y[1] - common)


STEP = 4096


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Classes (x, y, words_x, words_y) whose shingle sets reach the threshold."""
    for batch in batches:
        for lo in range(0, batch.num_rows, STEP):
            part = batch.slice(lo, STEP)
            keep = pa.array(np.flatnonzero(_alike(_sets(_matrix(part.column(2)), 0), _sets(_matrix(part.column(3)), 1))))
            yield pa.RecordBatch.from_arrays([part.column(c).take(keep) for c in (0, 1)], names=["a", "b"])


def _whole_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by cell in tables that end where a cell ends."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        cells = np.asarray(batch.column("cell"))
        last = int(np.searchsorted(cells, cells[-1])) if len(cells) else 0
        if last or (held and len(cells) and np.asarray(held[-1].column("cell"))[-1] != cells[0]):
            yield pa.Table.from_batches([*held, batch.slice(0, last)])
            held = []
        held.append(batch.slice(last))
    if held:
        yield pa.Table.from_batches(held)


def _in_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between each cell's queries and the other members of its bucket; of links that join the same components one is enough."""
    for table in _whole_cells(batches):
        if not table.num_rows:
            continue
        cells, ask = np.asarray(table.column("cell")), np.asarray(table.column("query"))
        ids, component = (np.asarray(table.column(c)) for c in ("class", "component"))
        words = _matrix(table.column("words"))
        one, other = _sets(words, 0), _sets(words, 1)
        root: dict[int, int] = {}

        def top(c: int, root: dict[int, int] = root) -> int:
            while root.get(c, c) != c:
                root[c] = root.get(root[c], root[c])
                c = root[c]
            return c

        links: list[tuple[int, int]] = []
        cuts = [0, *(np.flatnonzero(cells[1:] != cells[:-1]) + 1).tolist(), len(cells)]
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for k, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            query, target = lo + np.flatnonzero(ask[lo:hi]), lo + np.flatnonzero(~ask[lo:hi])
            x, y = np.repeat(query, len(target)), np.tile(target, len(query))
            apart = component[x] != component[y]
            held.append((x[apart], y[apart]))
            size += len(held[-1][0])
            if size < STEP and k < len(cuts) - 2:
                continue
            x, y = (np.concatenate([h[c] for h in held]) for c in (0, 1))
            held, size = [], 0
            for at in range(0, len(x), STEP):
                a, b = x[at : at + STEP], y[at : at + STEP]
                for i in np.flatnonzero(_alike((one[0][a], one[1][a]), (other[0][b], other[1][b]))).tolist():
                    u, v = top(int(component[a[i]])), top(int(component[b[i]]))
                    if u != v:
                        root[u] = v
                        links.append((int(ids[a[i]]), int(ids[b[i]])))
        yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in links], pa.int64()) for k in (0, 1)], names=["a", "b"])


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, words) of the stretches [from, to) asked of each text, as bytes of word hashes."""
    for batch in batches:
        for lo, hi, buf, offs in K.slices(batch.column(0)):
            w = K.Words(buf, offs)
            ids, parts = [], []
            for r in range(lo, hi):
                own = w.hash[w.first[r - lo] : w.last[r - lo]]
                for ask in batch.column(1)[r].as_py():
                    ids.append(ask["id"])
                    parts.append(own[ask["from"] : ask["to"]].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(parts, pa.binary())], names=["id", "words"])


def _words_at(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """id and words of ``asked`` (doc_id, text_key, id, from, to), whose words are read again from the texts."""
    by_text = stored(asked.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("id", "from", "to")).alias("asked")), "asked")
    keys = narrow(by_text.select("doc_id", "text_key"))
    texts = docs.join(keys, ["doc_id", "text_key"], "left_semi").dropDuplicates(["doc_id", "text_key"])
    return texts.join(by_text, ["doc_id", "text_key"]).select("text", "asked").mapInArrow(_cut_out, "id long, words binary")


def _links(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The links (a, b) of colliding classes that are similar."""
    spark = docs.sparkSession
    at = found.select("class", F.explode("keys").alias("key"), "doc_id").groupBy("key", "class").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
    mixed = at.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("class").alias("hub"), F.min("least").alias("least"), F.max("most").alias("most")).where("n > 1 and least < most")
    members = stored(at.select("class", "key").join(mixed.select("key", "n", "hub"), "key"), "members")
    needed = narrow(stored(members.select("class").distinct(), "classes"))
    asked = found.join(needed, "class", "left_semi").groupBy("class").agg(F.min(F.struct("doc_id", "text_key", "begin")).alias("f"))
    asked = asked.select("f.doc_id", "f.text_key", F.col("class").alias("id"), F.col("f.begin").alias("from"), (F.col("f.begin") + SIZE).alias("to"))
    words = stored(_words_at(docs, asked).withColumnRenamed("id", "class"), "words")

    pairs = stored(members.where("class <> hub").select(F.col("class").alias("x"), F.col("hub").alias("y")).distinct(), "pairs")
    near = spread_join(pairs, words.select(F.col("class").alias("y"), F.col("words").alias("words_y")), "y", ["x"])
    near = near.join(words.select(F.col("class").alias("x"), F.col("words").alias("words_x")), "x")
    links = stored(near.select("x", "y", "words_x", "words_y").mapInArrow(_similar, "a long, b long"), "links")

    # What the hubs left apart: classes of another component than their bucket's hub meet all of the bucket, in cells.
    label = connected_components(links).select(F.col("id").alias("class"), "component")
    named = members.join(label, "class", "left").withColumn("component", F.coalesce("component", "class"))
    named = named.join(label.select(F.col("class").alias("hub"), F.col("component").alias("hub_component")), "hub", "left")
    named = named.withColumn("query", F.col("component") != F.coalesce("hub_component", "hub")).drop("hub_component")
    queries = named.where("n > 2").groupBy("key").agg(F.count_if("query").alias("q")).where("q > 0")  # two have met already
    named = stored(named.join(queries, "key"), "apart")
    n_to, n_ask = F.ceil(F.col("n") / BLOCK).cast("int"), F.ceil(F.col("q") / BLOCK).cast("int")
    to = named.select("key", "class", "component", F.lit(False).alias("query"), F.pmod(F.xxhash64("class"), n_to).cast("int").alias("t"), F.explode(F.sequence(F.lit(0), n_ask - 1)).alias("a"))
    ask = named.where("query").select("key", "class", "component", "query", F.explode(F.sequence(F.lit(0), n_to - 1)).alias("t"), F.pmod(F.xxhash64("class", F.lit(1)), n_ask).cast("int").alias("a"))
    cells = to.unionByName(ask).join(words, "class").select(F.xxhash64("key", "t", "a").alias("cell"), "class", "component", "query", "words")
    more = cells.repartition(partitions(spark), "cell").sortWithinPartitions("cell").mapInArrow(_in_cells, "a long, b long")
    return links.unionByName(stored(more, "links"))


def repeats(documents: DataFrame) -> DataFrame:
    """doc_id, text_key, spans (bytes [from, to) of the text that go), n_words and kept_in (doc_ids that keep them), for each text that loses something."""
    spark = lean(documents)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text <> ''").withColumn("text_key", F.xxhash64("text"))
    twice = docs.select("text").mapInArrow(_keyed, "key long").groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = spark.sparkContext.broadcast(_bitmap(twice))

    def collected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, _, buf, offs in K.slices(batch.column(2)):
                p = Paragraphs(buf, offs)
                keys = p.keys()
                keep = np.flatnonzero(_in(shared.value, keys).any(axis=1))
                row = p.row[keep]
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(c).take(pa.array(row + lo)) for c in (0, 1)),
                        pa.array(p.contents()[keep].view(np.int64)),
                        pa.array((p.begin[keep] - p.words.first[row]).astype(np.int64)),
                        pa.ListArray.from_arrays(pa.array(np.arange(0, len(keep) * BANDS + 1, BANDS, dtype=np.int32)), pa.array(keys[keep].ravel().view(np.int64))),
                    ],
                    names=["doc_id", "text_key", "class", "begin", "keys"],
                )

    found = stored(docs.select("doc_id", "text_key", "text").mapInArrow(collected, "doc_id long, text_key long, class long, begin long, keys array<long>"), "paragraphs")
    shared.destroy()
    group = connected_components(_links(docs, found)).select(F.col("id").alias("class"), "component")
    whole = found.drop("keys").join(group, "class", "left").withColumn("component", F.coalesce("component", "class"))
    whole = stored(whole.drop("class"), "grouped")

    keeper = whole.groupBy("component").agg(F.min(F.struct("doc_id", "text_key", "begin")).alias("k"), F.max("doc_id").alias("last")).where("k.doc_id <> last").drop("last")
    gone = spread_join(whole, keeper, "component", ["doc_id", "text_key", "begin"]).where("doc_id <> k.doc_id")
    parts = F.array_sort(F.collect_set(F.struct("begin", F.col("k.doc_id").alias("kept_in"), F.col("k.text_key").alias("kept_key"), F.col("k.begin").alias("kept_at"))))
    runs = gone.groupBy("doc_id", "text_key").agg(parts.alias("parts")).mapInArrow(_runs, "doc_id long, text_key long, first long, last long, kept_in long, kept_key long, from long, to long")
    runs = stored(runs.withColumn("id", F.xxhash64("kept_in", "kept_key", "from", "to")), "runs")
    stays = runs.select(F.col("kept_in").alias("doc_id"), F.col("kept_key").alias("text_key"), "id", "from", "to").distinct()
    laid = spread_join(runs, stored(_words_at(docs, stays), "stays"), "id", ["doc_id", "text_key", "first"])
    laid = stored(laid.groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_list(F.struct("first", "last", "kept_in", "words"))).alias("runs")), "laid")
    texts = docs.join(narrow(laid.select("doc_id", "text_key")), ["doc_id", "text_key"], "left_semi").dropDuplicates(["doc_id", "text_key"])
    spans = texts.join(laid, ["doc_id", "text_key"]).select("doc_id", "text_key", "text", "runs")
    return spans.mapInArrow(_spans, "doc_id long, text_key long, spans array<struct<from: long, to: long>>, n_words long, kept_in array<long>").where("n_words > 0")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Paragraphs that go one after the other against the same text at about the same shift make one run of words [first, last)."""
    names = ["doc_id", "text_key", "first", "last", "kept_in", "kept_key", "from", "to"]
    for batch in batches:
        out: list[tuple] = []
        for doc, key, parts in zip(*(batch.column(c).to_pylist() for c in (0, 1)), batch.column(2), strict=True):
            runs: list[list] = []
            near: list[list] = []  # runs that the next paragraph may go on
            for part in parts.as_py():
                at, kept = part["begin"], part["kept_at"]
                near = [run for run in near if run[1] + GAP >= at]
                for run in reversed(near):
                    if (run[2], run[3]) == (part["kept_in"], part["kept_key"]) and abs(kept - at - run[6]) <= SHIFT:
                        run[1], run[4], run[5], run[6] = at + SIZE, min(run[4], kept), max(run[5], kept + SIZE), kept - at
                        break
                else:
                    near.append([at, at + SIZE, part["kept_in"], part["kept_key"], kept, kept + SIZE, kept - at])
                    runs.append(near[-1])
            out += [(doc, key, r[0], r[1], r[2], r[3], max(0, r[4] - CONTEXT), r[5] + CONTEXT) for r in runs]
        cols = list(zip(*out, strict=True)) if out else [[]] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=names)


def _found(values: np.ndarray, within: np.ndarray) -> np.ndarray:
    """Where values are that a sorted array has."""
    return np.flatnonzero(within[np.minimum(np.searchsorted(within, values), len(within) - 1)] == values) if len(within) else np.zeros(0, np.int64)


def _block(marks: np.ndarray, lo: int, hi: int) -> tuple[int, int]:
    """The words [first, last) of marked shingles around [lo, hi), over gaps of up to GAP words; (lo, lo) if none is marked there."""
    if not len(marks):
        return lo, lo
    cut = np.flatnonzero(marks[1:] - (marks[:-1] + SHINGLE) > GAP) + 1
    first, last = marks[np.concatenate(([0], cut))], marks[np.concatenate((cut, [len(marks)])) - 1] + SHINGLE
    near = np.flatnonzero((first < hi) & (last > lo))
    return (int(first[near[0]]), int(last[near[-1]])) if len(near) else (lo, lo)


def laid_against(text: np.ndarray, lo: int, hi: int, kept: np.ndarray) -> tuple[int, int]:
    """The words [lo, hi) of ``text`` grown or trimmed to what they share with ``kept``, if the whole is similar; else as they are."""
    left = max(0, lo - CONTEXT)
    own, there = shingled(text[left : hi + CONTEXT]), shingled(kept)
    a, b = _block(_found(own, np.unique(there)), lo - left, hi - left)
    if b - a >= SHINGLE:
        ours = np.unique(own[a : b - SHINGLE + 1])
        marks = _found(there, ours)
        c, d = _block(marks, min(CONTEXT, int(marks[-1])), max(len(kept) - CONTEXT, int(marks[0]) + 1))
        if d - c >= SHINGLE and similar(ours, np.unique(there[c : d - SHINGLE + 1])):
            return left + a, left + b
    return lo, hi


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes that go of each text, from its runs and the words that stay elsewhere."""
    kind = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))
    for batch in batches:
        for lo, hi, buf, offs in K.slices(batch.column(2)):
            w = K.Words(buf, offs)
            spans, words, kept = [], [], []
            for r in range(lo, hi):
                base = int(w.first[r - lo])
                own = w.hash[base : w.last[r - lo]]
                ends: list[list[int]] = []
                gone = []
                for run in batch.column(3)[r]:
                    stays = np.frombuffer(run["words"].as_buffer(), np.uint64)
                    a, b = laid_against(own, run["first"].as_py(), run["last"].as_py(), stays)
                    gone.append((a, min(b, len(own)), run["kept_in"].as_py()))
                for a, b, _ in sorted(gone):
                    if ends and a <= ends[-1][1]:
                        ends[-1][1] = max(ends[-1][1], b)
                    else:
                        ends.append([a, b])
                ends = [e for e in ends if e[1] - e[0] >= LEAST_RUN]
                spans.append([{"from": int(w.start[base + a] - offs[r - lo]), "to": int(w.end[base + b - 1] - offs[r - lo])} for a, b in ends])
                words.append(sum(b - a for a, b in ends))
                kept.append(sorted({k for a, b, k in gone if any(x <= a and b <= y for x, y in ends)}))
            yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(lo, hi - lo) for c in (0, 1)), pa.array(spans, kind), pa.array(words, pa.int64()), pa.array(kept, pa.list_(pa.int64()))], names=["doc_id", "text_key", "spans", "n_words", "kept_in"])


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, text without its spans) of (row, text, spans)."""
    for batch in batches:
        out = []
        for text, spans in zip(batch.column(1), batch.column(2), strict=True):
            raw = text.as_py()
            if spans.is_valid and raw is not None:
                data, at, parts = raw.encode(), 0, []
                for s in spans.as_py():
                    parts.append(data[at : s["from"]].strip(b" \t\n\v\f\r"))
                    at = s["to"]
                parts.append(data[at:].strip(b" \t\n\v\f\r"))
                raw = b"\n".join(p for p in parts if p).decode()
            out.append(raw)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["row", "left"])


def cut(documents: DataFrame) -> DataFrame:
    """``documents`` with all their columns; the text of each is without the passages that go, n_chars (if there) follows it."""
    found = stored(repeats(documents).select("doc_id", "text_key", "spans"), "spans")
    rows = documents.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("text_key", F.xxhash64("text"))
    joined = rows.join(found if found.count() > 200_000 else F.broadcast(found), ["doc_id", "text_key"], "left").select("row", "text", "spans")
    out = joined.mapInArrow(_without, StructType([StructField("row", documents.schema), StructField("left", StringType())]))
    n_chars = F.when(F.col("row.n_chars").isNotNull(), F.char_length("left")) if "n_chars" in documents.columns else None
    new = {"text": F.col("left"), "n_chars": n_chars}
    return out.select(*[new[f.name].cast(f.dataType).alias(f.name) if f.name in ("text", "n_chars") else F.col("row").getField(f.name).alias(f.name) for f in documents.schema])
