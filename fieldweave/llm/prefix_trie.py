"""The trie of conversation prefixes, and sums over its subtrees by centroid decomposition.

1. ``rebuilt``: turns get their place in their conversation; a conversation takes its first few turns from another.
2. A prefix is known by its depth and the exclusive or of hashes of (place, role, text), 128 bits. Places and prefixes are running totals
   over rows sorted across partitions (``running``), so a conversation of any length is dealt over tasks.
3. A node is a distinct prefix, named by its smallest member and its depth; n_convs counts members. Its *weight*, the turns that members
   have from it on, equals the sum of n_convs over its subtree, and so needs no walk down the tree.
4. Centroid decomposition of the forest of parent edges. In each component the centroid is the deepest node that holds over half of the
   component's weight. The totals of what hangs below it go to it and to all nodes on the path up to the component's top; then it is taken
   out, its children become tops and the path is lighter by its weight. Parts have at most half of the weight, so there are at most log2 of
   all turns levels, however deep the trie is. A node's sums are what it has been given over all levels.
   Levels of components with more than ``COMPONENT`` nodes are joins over all nodes; smaller ones are decomposed to the end where they
   are, several to a task.
5. ``ends``: the ids that end at a node are sorted over all partitions, joined to strings there, and hashed string by string.

Defined cases: turns in order of turn (null first), then role, then MD5 of the text; repeated rows are turns of their own; a null role or
text is empty; rows without conv_id are left out; ``%`` keeps the sign of the id, as in SQL; an empty table has no conversation and no
root; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldweave.llm.workspace import HOT_KEYS, lean, partitions, spread_join, stored

#: Nodes of a component that is decomposed within a task, and characters of the strings of ids
COMPONENT, IDS_CHARS = 50_000, 1 << 16


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``at`` (from 1), and ``x``, ``y`` as running exclusive ors, within runs of equal conv_id."""
    conv, at, x, y = None, 0, 0, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column("conv_id").to_numpy()
        first = np.flatnonzero(np.r_[ids[0] != conv, ids[1:] != ids[:-1]])
        cuts = [*({0} - set(first[:1].tolist())), *first.tolist(), len(ids)]
        place, totals = np.empty(len(ids), np.int64), [batch.column(c).to_numpy().copy() for c in ("x", "y")]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            before = (at, x, y) if lo == 0 and ids[0] == conv else (0, 0, 0)
            place[lo:hi] = np.arange(1, hi - lo + 1) + before[0]
            for t, b in zip(totals, before[1:], strict=True):
                t[lo] ^= b
                np.bitwise_xor.accumulate(t[lo:hi], out=t[lo:hi])
        conv, at, x, y = ids[-1], int(place[-1]), int(totals[0][-1]), int(totals[1][-1])
        new = {"at": pa.array(place), "x": pa.array(totals[0]), "y": pa.array(totals[1])}
        yield pa.RecordBatch.from_arrays([new.get(n, c) for n, c in zip(batch.schema.names, batch.columns, strict=True)], names=batch.schema.names)


def running(rows: DataFrame, order: list, name: str) -> DataFrame:
    """``rows`` (conv_id, x, y and others) with ``at``, their place in the ``order`` of their conv_id, and x and y as running exclusive ors.

    Rows are sorted over all partitions; what a partition lacks of a conversation that began in earlier ones is added after.
    """
    n = partitions(rows.sparkSession)
    dealt = rows.withColumn("at", F.lit(0).cast("long")).repartitionByRange(n, "conv_id", *order).sortWithinPartitions("conv_id", *order)
    dealt = dealt.withColumn("_part", F.spark_partition_id())
    local = stored(dealt.mapInArrow(_running, dealt.schema), name)
    parts = local.groupBy("conv_id", "_part").agg(F.max("at").alias("rows"), F.max_by(F.struct("x", "y"), "at").alias("end"))
    torn = parts.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.collect_list(F.struct("_part", "rows", "end.x", "end.y")).alias("parts")).where("n > 1")
    # A partition tears two conversations at most, so this is two rows for each partition at most
    torn = torn.select("conv_id", F.explode("parts").alias("p"), "parts").select("conv_id", F.col("p._part").alias("_part"), F.filter("parts", lambda q: q["_part"] < F.col("p._part")).alias("e"))
    xor = lambda c: F.aggregate(F.col("e"), F.lit(0).cast("long"), lambda a, q: a.bitwiseXOR(q[c])).alias(f"_{c}")
    before = torn.select("conv_id", "_part", F.aggregate("e", F.lit(0).cast("long"), lambda a, q: a + q["rows"]).alias("_at"), xor("x"), xor("y"))
    added = {c: F.col(c).bitwiseXOR(F.coalesce(f"_{c}", F.lit(0).cast("long"))) for c in ("x", "y")}
    whole = local.join(F.broadcast(before), ["conv_id", "_part"], "left").withColumns({"at": F.col("at") + F.coalesce("_at", F.lit(0)), **added})
    return whole.drop("_part", "_at", "_x", "_y")


def words(text: str) -> F.Column:
    """How many words ``[^\\x20\\x09-\\x0D]+`` a text has."""
    return F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")


def taken(conv_id: str) -> F.Column:
    """How many first turns a conversation takes from another."""
    return F.pmod(F.crc32(F.col(conv_id).cast("string").cast("binary")), F.lit(4)).cast("long")


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id of all conversations with turns, ``len``), (conv_id, depth, a, b, words of each turn): rebuilt conversations."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), empty("role").alias("role"), empty("text").alias("text")).where("conv_id is not null")
    rows = rows.select("conv_id", "turn", "role", F.md5("text").alias("tie"), F.xxhash64("role", "text").alias("x"), F.xxhash64(F.lit("second"), "text", "role").alias("y"), words("text").alias("words"), F.xxhash64("role", "text").alias("a"), F.xxhash64(F.lit("second"), "text", "role").alias("b"))
    own = stored(running(rows, [F.asc_nulls_first("turn"), "role", "tie"], "places").select("conv_id", "at", "a", "b", "words"), "turns")
    convs = own.groupBy("conv_id").agg(F.max("at").alias("n")).select("conv_id", "n", taken("conv_id").alias("h"), (F.col("conv_id") - F.col("conv_id") % 20).alias("base"))
    heads = own.where("conv_id % 20 = 0 and at <= 3")
    most = heads.groupBy(F.col("conv_id").alias("base")).agg(F.max("at").alias("most"))
    convs = stored(convs.join(most, "base", "left").select("conv_id", "base", "h", F.least("h", F.coalesce("most", F.lit(0))).alias("given"), F.greatest(F.col("n") - F.col("h"), F.lit(0)).alias("kept")), "conversations")
    lent = convs.where("given > 0").join(heads.withColumnRenamed("conv_id", "base"), "base").where("at <= given").select("conv_id", F.col("at").alias("depth"), "a", "b", "words")
    rest = spread_join(own, convs.select("conv_id", "h", "given"), "conv_id", ["at"]).where("at > h").select("conv_id", (F.col("at") - F.col("h") + F.col("given")).alias("depth"), "a", "b", "words")
    return convs.select("conv_id", (F.col("given") + F.col("kept")).alias("len")), lent.unionByName(rest)


def visits(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, len), (conv_id, depth, owner, above, len, words): the node of each prefix of each conversation by its smallest member."""
    convs, turns = rebuilt(conversations)
    convs = stored(convs, "lengths")
    keyed = turns.withColumns({"x": F.xxhash64("depth", "a", "b"), "y": F.xxhash64("b", "depth", "a")}).drop("a", "b")
    prefixes = running(keyed, ["depth"], "prefixes").select("conv_id", "depth", F.struct("depth", "x", "y").alias("key"), "words")
    root = convs.select("conv_id", F.lit(0).cast("long").alias("depth"), F.struct(F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("y")).alias("key"), F.lit(0).cast("long").alias("words"))
    rows = stored(prefixes.unionByName(root), "keyed")
    owners = rows.groupBy("key").agg(F.min("conv_id").alias("owner"))
    named = spread_join(stored(spread_join(rows, owners, "key", ["conv_id"]).drop("key"), "owned"), convs, "conv_id", ["depth"])
    above = named.select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("owner").alias("above"))
    return convs, stored(named.join(above, ["conv_id", "depth"], "left"), "visits")


def nodes_of(seen: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, words and weight of each node, and where its chain begins.

    A chain is the run of nodes of one smallest member; ``since`` is the depth of its first node and ``hang`` what that hangs from.
    """
    nodes = seen.groupBy(F.col("owner").alias("conv_id"), "depth").agg(F.count(F.lit(1)).alias("n_convs"), F.min("above").alias("parent_conv_id"), F.max("words").alias("words"), F.sum(F.col("len") - F.col("depth") + 1).alias("weight"))
    nodes = stored(nodes, "nodes")
    children = nodes.where("depth > 0").groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count(F.lit(1)).alias("n_children"))
    begins = nodes.where("parent_conv_id is null or parent_conv_id <> conv_id").select("conv_id", F.col("depth").alias("since"), F.col("parent_conv_id").alias("hang"))
    whole = nodes.join(children, ["conv_id", "depth"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    return stored(spread_join(stored(whole, "nodes"), begins, "conv_id", ["depth"]), "nodes")


#: What the decomposition passes on: a node, its chain, its parent, the weight of its subtree in its component, its values and its component
_ACTIVE = ["conv_id", "depth", "parent_conv_id", "since", "hang", "weight", "leaves", "saved", "top_conv", "top_depth"]


def _split(active: DataFrame, seen: DataFrame, large: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One level: (what nodes are given, the nodes of the parts) of the components in ``large`` (top_conv, top_depth, all)."""
    top = ["top_conv", "top_depth"]
    rows = active.join(F.broadcast(large), top)  # at most HOT_KEYS components are large
    found = rows.where(2 * F.col("weight") > F.col("all")).groupBy(*top).agg(F.max(F.struct("depth", "conv_id", "weight")).alias("c"))
    found = stored(found.select(*top, F.col("c.conv_id").alias("c_conv"), F.col("c.depth").alias("c_depth"), F.col("c.weight").alias("c_weight")), "centroids")
    rows = rows.drop("all").join(F.broadcast(found), top)

    # Which part a node below the centroid is in: its own chain tells, or else the visits of its conversation at the centroid's children.
    far = (F.col("depth") > F.col("c_depth")) & (F.col("since") > F.col("c_depth") + 1)
    child = seen.select(F.col("conv_id"), (F.col("depth") - 1).alias("c_depth"), F.col("owner").alias("part"), F.col("above").alias("under"))
    chain = F.struct("conv_id", *top).alias("chain")
    asked = rows.where(far).select("conv_id", *top, "c_depth").distinct()
    told = asked.join(child, ["conv_id", "c_depth"]).select(chain, "part", "under")
    marked = rows.where(~far).withColumns({"part": F.col("conv_id"), "under": F.when(F.col("since") == F.col("c_depth") + 1, F.col("hang")).otherwise(F.col("conv_id"))})
    marked = marked.unionByName(spread_join(stored(rows.where(far).withColumn("chain", chain), "far"), told, "chain", ["depth"]).drop("chain"))

    # The path from the centroid up to the top of its component.
    path = seen.join(F.broadcast(found.select(F.col("c_conv").alias("conv_id"), F.col("c_depth"), *top)), "conv_id").where("depth >= top_depth and depth < c_depth")
    path = path.select(F.col("owner").alias("conv_id"), "depth", *top, F.lit(True).alias("on_path"))
    below = (F.col("depth") > F.col("c_depth")) & (F.col("under") == F.col("c_conv"))
    centroid = (F.col("depth") == F.col("c_depth")) & (F.col("conv_id") == F.col("c_conv"))
    marked = stored(marked.withColumns({"below": below, "centroid": centroid}).join(path, ["conv_id", "depth", *top], "left"), "marked")

    totals = marked.where("below or centroid").groupBy(*top).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    given = marked.where("centroid or on_path").select("conv_id", "depth", *top).join(F.broadcast(totals), top).select("conv_id", "depth", "leaves", "saved")
    parts = marked.where("not centroid").withColumns({
        "weight": F.when(F.col("on_path"), F.col("weight") - F.col("c_weight")).otherwise(F.col("weight")),
        "top_conv": F.when(F.col("below"), F.col("part")).otherwise(F.col("top_conv")),
        "top_depth": F.when(F.col("below"), F.col("c_depth") + 1).otherwise(F.col("top_depth")),
    })
    return given, parts.select(*_ACTIVE)


def decompose(parent: list[int], weight: list[int], values: list[list[int]]) -> list[list[int]]:
    """Sums of ``values`` over the subtree of each node of a forest (parent -1: a top) by centroid decomposition.

    ``weight`` is the weight of each subtree, greater than that of any child.
    """
    children: list[list[int]] = [[] for _ in parent]
    tops = []
    for v, p in enumerate(parent):
        (children[p] if p >= 0 else tops).append(v)
    out, left, weight = [[0] * len(v) for v in values], [True] * len(parent), list(weight)
    while tops:
        top = tops.pop()
        half, path, c = weight[top] / 2, [], top
        while (heavy := next((u for u in children[c] if left[u] and weight[u] > half), None)) is not None:
            path.append(c)
            c = heavy
        below, at = [c], 0
        while at < len(below):
            below += [u for u in children[below[at]] if left[u]]
            at += 1
        for to, of in zip(out, values, strict=True):
            total = sum(of[v] for v in below)
            to[c] += total
            for v in path:
                to[v] += total
        for v in path:
            weight[v] -= weight[c]
        left[c] = False
        tops += [u for u in children[c] if left[u]]
        children[c] = []
        if path:
            children[path[-1]].remove(c)
            tops.append(top)
    return out


def _decomposed(table: pa.Table) -> pa.Table:
    """The components of one bin."""
    col = {c: table.column(c).to_pylist() for c in ("conv_id", "depth", "parent_conv_id", "weight", "leaves", "saved", "top_conv", "top_depth")}
    place = {key: v for v, key in enumerate(zip(col["conv_id"], col["depth"], strict=True))}
    is_top = [a == b and c == d for a, b, c, d in zip(col["conv_id"], col["top_conv"], col["depth"], col["top_depth"], strict=True)]
    parent = [-1 if top else place[p, d - 1] for top, p, d in zip(is_top, col["parent_conv_id"], col["depth"], strict=True)]
    leaves, saved = decompose(parent, col["weight"], [col["leaves"], col["saved"]])
    return pa.table({"conv_id": pa.array(col["conv_id"], pa.int64()), "depth": pa.array(col["depth"], pa.int64()), "leaves": pa.array(leaves, pa.int64()), "saved": pa.array(saved, pa.int64())})


def rollup(nodes: DataFrame, seen: DataFrame) -> DataFrame:
    """conv_id, depth, n_leaves, saved_tokens: sums over the subtree of each node."""
    top = nodes.where("depth = 0").select("conv_id").first()  # the root's name
    if top is None:
        return nodes.select("conv_id", "depth", F.lit(0).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"))
    active = nodes.withColumns({"leaves": F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long"), "saved": (F.col("n_convs") - 1) * F.col("words"), "top_conv": F.lit(top[0]).cast("long"), "top_depth": F.lit(0).cast("long")}).select(*_ACTIVE)
    active = stored(active, "active")
    limit = max(COMPONENT, active.count() // HOT_KEYS)
    given, ready = [], []
    while True:
        sizes = active.groupBy("top_conv", "top_depth").agg(F.count(F.lit(1)).alias("n"), F.max("weight").alias("all"))
        large = stored(sizes.where(F.col("n") > limit).select("top_conv", "top_depth", "all"), "large")
        ready.append(active.join(F.broadcast(large), ["top_conv", "top_depth"], "left_anti"))
        if large.isEmpty():
            break
        gifts, parts = _split(active, seen, large)
        given.append(gifts)
        active = stored(parts, "parts")
    small = stored(reduce(DataFrame.unionByName, ready), "small")
    bins = max(1, -(-small.count() // limit))
    small = small.withColumn("bin", F.pmod(F.xxhash64("top_conv", "top_depth"), F.lit(bins)))
    given.append(small.groupBy("bin").applyInArrow(_decomposed, "conv_id long, depth long, leaves long, saved long"))
    return reduce(DataFrame.unionByName, given).groupBy("conv_id", "depth").agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], list]]:
    """((conv_id, depth), values of the third column) of runs of rows of one node; a run can come in several pieces."""
    for batch in batches:
        conv, depth = (batch.column(k).to_numpy() for k in (0, 1))
        cuts = np.flatnonzero((conv[1:] != conv[:-1]) | (depth[1:] != depth[:-1])) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(conv)], strict=True) if len(conv) else ():
            yield (int(conv[lo]), int(depth[lo])), batch.column(2).slice(lo, hi - lo).to_pylist()


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Strings of about IDS_CHARS of the ids of a node, in order, with their first id."""

    def out(key: tuple[int, int], ids: list[int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((key[0], pa.int64()), (key[1], pa.int64()), (ids[0], pa.int64()), (",".join(map(str, ids)), pa.string()))], names=["conv_id", "depth", "first", "ids"])

    rows: list[pa.RecordBatch] = []
    now, held = None, []
    for key, ids in _runs(batches):
        if key != now and held:
            rows.append(out(now, held))
            held = []
        now = key
        held += ids
        while len(held) * 8 > IDS_CHARS:
            rows.append(out(now, held[: IDS_CHARS // 8]))
            held = held[IDS_CHARS // 8 :]
        if len(rows) >= 1000:
            yield pa.Table.from_batches(rows).combine_chunks().to_batches()[0]
            rows = []
    if held:
        rows.append(out(now, held))
    if rows:
        yield pa.Table.from_batches(rows).combine_chunks().to_batches()[0]


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple[int, int, str]]:
        now, sha = None, hashlib.sha256()
        for key, strings in _runs(batches):
            if key != now:
                if now is not None:
                    yield *now, sha.hexdigest()
                now, sha = key, hashlib.sha256()
            else:
                sha.update(b",")
            sha.update(",".join(strings).encode())
        if now is not None:
            yield *now, sha.hexdigest()

    held: list[tuple[int, int, str]] = []
    for row in rows():
        held.append(row)
        if len(held) == 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*held, strict=True)], names=["conv_id", "depth", "ends_sha256"])
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*held, strict=True)], names=["conv_id", "depth", "ends_sha256"])


def ends(seen: DataFrame) -> DataFrame:
    """conv_id, depth, ends_sha256 of the nodes at which conversations end."""
    n = partitions(seen.sparkSession)
    last = seen.where("depth = len").select(F.col("owner").alias("conv_id"), "depth", F.col("conv_id").alias("id"))
    strings = last.repartitionByRange(n, "conv_id", "depth", "id").sortWithinPartitions("conv_id", "depth", "id").mapInArrow(_joined, "conv_id long, depth long, first long, ids string")
    dealt = strings.repartition(n, "conv_id", "depth").sortWithinPartitions("conv_id", "depth", "first")
    return dealt.select("conv_id", "depth", "ids").mapInArrow(_hashed, "conv_id long, depth long, ends_sha256 string")


def trie(conversations: DataFrame) -> DataFrame:
    """The nodes of the trie over ``conversations`` (conv_id, turn, role, text), with sums over their subtrees."""
    lean(conversations)
    _, seen = visits(conversations)
    nodes = nodes_of(seen)
    whole = nodes.join(rollup(nodes, seen), ["conv_id", "depth"]).join(ends(seen), ["conv_id", "depth"], "left")
    nothing = hashlib.sha256().hexdigest()
    return whole.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"))
