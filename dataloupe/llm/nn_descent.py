"""Near copies among embeddings by NN-descent on a neighbour graph."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from dataloupe.functions.columns import col, require_columns
from dataloupe.llm.frames import forget, ship, written
from dataloupe.llm.graph import components


FEW_BITS, MOST_BITS, WHOLE = 7, 40, 4
SEVERAL_CREWS = "first_crew < last_crew"


@dataclass(frozen=True)
class Settings:
    """``neighbours`` per list; ``tables`` of random hyperplanes start the graph of a label of
    2^7 crowds, and larger labels have as many more as keep the recall of the start; their
    buckets and the lists that meet in a local join are dealt into crowds of about ``crowd``
    vectors. Edges below ``walk`` are kept but not walked; by default all are walked. Rounds end when fewer than
    ``calm`` of all edges are new, or after ``rounds``. The audit compares nodes with all
    others, in blocks from ``audited`` nodes on that double up to ``audit_block``, until it has
    seen ``seen`` true links, all nodes or ``most_audited``; below ``recall`` the graph gets new
    tables and rounds, ``repairs`` times.
    """

    neighbours: int = 12
    tables: int = 8
    crowd: int = 96
    walk: float = -1.0
    calm: float = 0.001
    rounds: int = 8
    block: int = 512
    audited: int = 256
    audit_block: int = 4096
    most_audited: int = 1 << 16
    seen: int = 500
    recall: float = 0.99
    repairs: int = 2
    seed: int = 11


def unit_rows(lists: pa.Array) -> np.ndarray:
    """Vectors of equal length as rows of length one, in double precision."""
    flat = lists.flatten().to_numpy(False).astype(np.float64)
    rows = flat.reshape(len(lists), -1)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def _usable(vector: Column, label: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return label.isNotNull() & vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def near_vectors(
    vectors: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    threshold: float = 0.93,
    settings: Settings = Settings(),
) -> tuple[DataFrame, float]:
    """Links between vectors of one label, and the audited share of links found.

    The frame has ``(key, n_links, component_id)`` for every row of ``vectors``: the number of
    other rows linked directly, and the smallest key that links reach, its own included. A
    link is a pair with equal labels and lengths and a cosine of ``threshold`` or more in
    double precision. Vectors that are null, empty, zero or hold null or non-finite numbers,
    and those with a null label, have no links. Rows with a null key do not take part and
    keep a null component. Rows with the same key count as copies of one another.

    1. Equal vectors are one node with a count.
    2. Nodes that share a bucket of random hyperplanes are compared in crowds and start each
       other's lists of the nearest ``neighbours``.
    3. Rounds of NN-descent (Dong and others, 2011): the neighbours of a node, in either
       direction, are compared with each other if one of them is new there, and better ones
       replace the worst in the lists.
    4. A list that is full of links is saturated: its node may have links beyond it. Saturated
       nodes search again, each for the nearest outside its component, and components that a
       link joins become one, until no search finds a further link. Components with a
       saturated node are then compared block by block, of which only counts are sent on.
    5. The audit measures recall against brute force on nodes in the order of their hashes until
       enough true links were seen. Callers decide what a low recall after all repairs means.

    No group is collected beyond a crowd or a block, and each round is written.
    """
    require_columns(vectors, key, vector, label)
    ship(vectors.sparkSession)
    rows = vectors.select(
        col(key).alias("key"), col(vector).alias("x"), col(label).alias("label")
    )
    usable = rows.where(_usable(F.col("x"), F.col("label")) & F.col("key").isNotNull())
    copies = usable.groupBy("label", "x").agg(F.min("key").alias("id"), F.count("key").alias("n"))
    nodes = copies.withColumns({"d": F.size("x"), "crew": F.col("id")})
    nodes = written(nodes)
    total = nodes.count()
    graph = _descend(nodes, None, threshold, settings, 0, total)
    for repair in range(settings.repairs + 1):
        linked, counted = _count_links(nodes, graph, threshold, settings, repair)
        recall = _audit(nodes, counted, threshold, settings, total)
        if recall >= settings.recall or repair == settings.repairs:
            break
        graph = _descend(nodes, graph, threshold, settings, repair + 1, total)
    known = nodes.join(counted, "id", "left").join(
        linked.withColumnRenamed("node", "id"), "id", "left"
    )
    known = known.select(
        "label",
        "x",
        (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("links"),
        F.coalesce("component", "id").alias("component"),
    )
    usable_keys = usable.join(known, ["label", "x"]).select("key", "links", "component")
    others = rows.where(~F.coalesce(_usable(F.col("x"), F.col("label")), F.lit(False)) | F.col("key").isNull())
    alone = others.select("key", F.lit(0).cast("long").alias("links"), F.col("key").alias("component"))
    found = usable_keys.unionByName(alone)
    return (
        found.select(
            F.col("key").alias(key),
            F.col("links").alias("n_links"),
            F.col("component").alias("component_id"),
        ),
        recall,
    )


def _descend(
    nodes: DataFrame,
    graph: DataFrame | None,
    threshold: float,
    settings: Settings,
    turn: int,
    total: int,
    inner: DataFrame | None = None,
) -> DataFrame:
    """The neighbour graph ``(u, v, s, fresh)`` after a start from hyperplanes and rounds.

    Nodes of one ``crew`` are not compared with each other; ``inner`` has edges that are walked
    beside those of the graph.
    """
    started = _first_neighbours(nodes, threshold, settings, turn)
    graph = written(_best(graph, started, settings))
    for number in range(settings.rounds):
        found = _local_joins(nodes, graph, settings, turn * settings.rounds + number, inner)
        later = written(_best(graph, found, settings))
        forget(graph)
        graph = later
        if graph.where("fresh").count() <= settings.calm * total * settings.neighbours:
            break
    return graph


def _best(graph: DataFrame | None, found: DataFrame, settings: Settings) -> DataFrame:
    """Old and new pairs, seen from both ends, cut to the nearest of each node."""
    both = found.select("u", "v", "s").union(found.select("v", "u", "s"))
    pairs = both.withColumn("fresh", F.lit(True))
    if graph is not None:
        pairs = pairs.union(graph.select("u", "v", "s", F.lit(False)))
    merged = pairs.groupBy("u", "v").agg(F.max("s").alias("s"), F.min("fresh").alias("fresh"))
    nearest = W.partitionBy("u").orderBy(F.desc("s"), "v")
    ranked = merged.withColumn("rank", F.row_number().over(nearest))
    return ranked.where(F.col("rank") <= settings.neighbours).drop("rank")


def tables_for(bits: int, threshold: float, settings: Settings) -> int:
    """How many tables of so many bits find a pair of cosine ``threshold`` as surely as
    ``settings.tables`` tables of ``FEW_BITS``: all bits of a table agree with chance p^bits."""
    if bits <= FEW_BITS:
        return settings.tables
    agree = 1 - math.acos(max(-1.0, min(1.0, threshold))) / math.pi
    if not 0 < agree < 1:
        return settings.tables
    return math.ceil(settings.tables * math.log1p(-(agree**FEW_BITS)) / math.log1p(-(agree**bits)))


def _first_neighbours(
    nodes: DataFrame, threshold: float, settings: Settings, turn: int
) -> DataFrame:
    """Pairs ``(u, v, s)`` from buckets of random hyperplanes, of each table its nearest.

    A label of n nodes has about n / crowd buckets per table, and the more bits these take the
    more tables. Buckets of up to ``WHOLE`` crowds are compared whole. Larger ones are divided
    by further bits, and what these cannot divide, as a large group of near copies, is dealt
    into crowds by hash.
    """
    # One bit more for each doubling of a label; MOST_BITS at most.
    per_label = nodes.groupBy("label", "d").agg(F.count(F.lit(1)).alias("of_label"))
    ratio = F.greatest(F.lit(1.0), F.col("of_label") / F.lit(float(settings.crowd)))
    bits = F.least(F.lit(MOST_BITS), F.ceil(F.log2(ratio)).cast("int")).alias("bits")
    sized = nodes.join(per_label.select("label", "d", bits), ["label", "d"])
    seed = settings.seed + 1000 * turn
    needed = [tables_for(b, threshold, settings) for b in range(MOST_BITS + 1)]

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = 1 << np.arange(MOST_BITS, dtype=np.int64)
        for batch in batches:
            lengths, most = batch.column("d").to_numpy(), batch.column("bits").to_numpy()
            for d, b in np.unique(np.stack([lengths, most], axis=1), axis=0).tolist():
                part = batch.filter(pa.array((lengths == d) & (most == b)))
                rows, ids = unit_rows(part.column("x")), part.column("id")
                random_ = np.random.default_rng([seed, d])
                for first in range(0, needed[b], 8):
                    count = min(8, needed[b] - first)
                    planes = random_.normal(size=(d, count * MOST_BITS))
                    above = (rows @ planes > 0).reshape(-1, count, MOST_BITS)
                    arrays = [
                        pa.array(np.repeat(ids.to_numpy(), count)),
                        pa.array(np.tile(np.arange(first, first + count), len(part))),
                        pa.array((above @ powers).reshape(-1)),
                    ]
                    yield pa.RecordBatch.from_arrays(arrays, ["id", "t", "sign"])

    signed = written(
        sized.select("id", "x", "d", "bits").mapInArrow(sign, "id long, t long, sign long")
    )
    placed = signed.join(sized.select("id", "label", "d", "crew", "bits"), "id")
    bucket, whole = ["label", "d", "t", "bucket"], WHOLE * settings.crowd
    low = "sign & (shiftleft(1L, bits) - 1)"
    placed = placed.withColumn("bucket", F.expr(low))
    sizes = placed.groupBy(*bucket).agg(F.count(F.lit(1)).alias("size"), *_crews())
    sizes = sizes.where(SEVERAL_CREWS).select(*bucket, "size")
    more = F.ceil(F.log2(F.col("size") / F.lit(float(settings.crowd)))).cast("int")
    deeper = F.when(F.col("size") <= whole, F.col("bits"))
    deeper = deeper.otherwise(F.least(F.lit(MOST_BITS), F.col("bits") + more))
    divided = placed.join(sizes, bucket).withColumn("bits", deeper).drop("size")
    # The low bits stay, so that parts of different buckets stay apart.
    divided = divided.withColumn("bucket", F.expr(low))
    sizes = divided.groupBy(*bucket).agg(F.count(F.lit(1)).alias("size"), *_crews())
    sizes = sizes.where(SEVERAL_CREWS).select(*bucket, "size")
    dealt = _deal("id", F.col("size"), settings.crowd, F.col("t"))
    crowds = divided.join(sizes, bucket).withColumn(
        "part", F.when(F.col("size") <= whole, F.lit(0).cast("long")).otherwise(dealt)
    )
    met = crowds.select("id", F.struct(*bucket, "part").alias("place"), F.lit(True).alias("fresh"))
    return _compared(nodes, met, settings, settings.neighbours // 2)


def _crews() -> list[Column]:
    return [F.min("crew").alias("first_crew"), F.max("crew").alias("last_crew")]


def _deal(member: str, size: Column, crowd: int, salt: Column) -> Column:
    parts = F.ceil(size / F.lit(float(crowd))).cast("long")
    return F.pmod(F.xxhash64(F.col(member), salt), parts)


def _local_joins(
    nodes: DataFrame,
    graph: DataFrame,
    settings: Settings,
    number: int,
    inner: DataFrame | None = None,
) -> DataFrame:
    """Pairs ``(u, v, s)`` of neighbours, in either direction, of a common node. Nodes with
    more neighbours than a crowd have them dealt into several, differently each round."""
    walked = graph.where(F.col("s") >= settings.walk)
    if inner is not None:
        walked = walked.select("u", "v", "fresh").union(inner.select("u", "v", F.lit(False)))
    both = walked.select("u", "v", "fresh").union(walked.select("v", "u", "fresh"))
    lists = both.groupBy("u", "v").agg(F.max("fresh").alias("fresh"))
    sizes = lists.groupBy("u").agg(
        F.count(F.lit(1)).alias("size"), F.max("fresh").alias("active")
    )
    busy = sizes.where("active AND size > 1").select("u", "size")
    dealt = lists.join(busy, "u").withColumn(
        "part", _deal("v", F.col("size"), settings.crowd, F.lit(number))
    )
    met = dealt.select(F.col("v").alias("id"), F.struct("u", "part").alias("place"), "fresh")
    return _compared(nodes, met, settings, settings.neighbours)


def _compared(nodes: DataFrame, met: DataFrame, settings: Settings, most: int) -> DataFrame:
    """The nearest ``most`` of each member of a crowd that are of another crew, if one of the
    two is fresh there."""
    vectors = nodes.select("id", "x", "label", "d", "crew")
    members = met.join(vectors, "id").groupBy("place", "label", "d").agg(
        F.collect_list(F.struct("id", "fresh", "crew", "x")).alias("members"), *_crews()
    )
    crowds = members.where(SEVERAL_CREWS).select("members")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]]
            for crowd in batch.column("members"):
                parts = crowd.values
                ids = parts.field("id").to_numpy()
                fresh = parts.field("fresh").to_numpy(False)
                rows = unit_rows(parts.field("x"))
                s = rows @ rows.T
                crew = parts.field("crew").to_numpy()
                s[~(fresh[:, None] | fresh[None, :])] = -2
                s[crew[:, None] == crew[None, :]] = -2
                keep = min(most, len(ids) - 1)
                near = np.argpartition(-s, keep - 1, axis=1)[:, :keep]
                u = np.repeat(np.arange(len(ids)), keep)
                v = near.reshape(-1)
                good = s[u, v] > -2
                for column, values in zip(out, (ids[u], ids[v], s[u, v])):
                    column.append(values[good])
            arrays = [pa.array(np.concatenate(c)) for c in out]
            yield pa.RecordBatch.from_arrays(arrays, ["u", "v", "s"])

    return crowds.mapInArrow(compare, "u long, v long, s double")


def _join_saturated(
    nodes: DataFrame,
    graph: DataFrame,
    full: DataFrame,
    linked: DataFrame,
    threshold: float,
    settings: Settings,
    turn: int,
) -> DataFrame:
    """``linked`` with components joined that have a link between their saturated nodes.

    A link that neither end's list holds has two saturated ends. Their nodes search for the
    nearest of other components, walking also the lists they have. A component whose
    nearest others are of one other component only meets the rest in the next step, when the
    two are one.
    """
    step = 0
    while True:
        step += 1
        crews = linked.select(F.col("node").alias("id"), F.col("component").alias("crew"))
        outer = nodes.drop("crew").join(full, "id").join(crews, "id")
        several = outer.groupBy("label", "d").agg(*_crews()).where(SEVERAL_CREWS)
        outer = written(outer.join(several, ["label", "d"], "left_semi"))
        if not (total := outer.count()):
            return linked
        # Seeds that no repair uses.
        seeded = 100 * (turn + 1) + step
        found = _descend(outer, None, threshold, settings, seeded, total, graph)
        met = found.where(F.col("s") >= threshold).select("u", "v")
        ends = [
            linked.select(F.col("node").alias(e), F.col("component").alias(c))
            for e, c in (("u", "a"), ("v", "b"))
        ]
        bridges = written(met.join(ends[0], "u").join(ends[1], "v").select("a", "b").distinct())
        if bridges.isEmpty():
            return linked
        roots = components(bridges, "a", "b").withColumnRenamed("component", "root")
        moved = linked.join(roots.withColumnRenamed("node", "component"), "component", "left")
        linked = written(moved.select("node", F.coalesce("root", "component").alias("component")))
        forget(outer, found, bridges)


def _count_links(
    nodes: DataFrame, graph: DataFrame, threshold: float, settings: Settings, turn: int
) -> tuple[DataFrame, DataFrame]:
    """``(node, component)`` of linked nodes, and ``(id, links, distinct)``: the rows and the
    nodes that each is linked to."""
    links = graph.where(F.col("s") >= threshold)
    linked = written(components(links, "u", "v"))
    full = links.groupBy(F.col("u").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    full = written(full.where(F.col("n") >= settings.neighbours).select("id"))
    linked = _join_saturated(nodes, graph, full, linked, threshold, settings, turn)
    dense = full.join(linked, full["id"] == linked["node"]).select("component").distinct()
    dense = written(dense)
    both = links.select("u", "v").union(links.select("v", "u")).distinct()
    open_nodes = linked.join(dense, "component", "left_anti").select("node")
    open_links = both.join(open_nodes, both["u"] == open_nodes["node"], "left_semi")
    weights = nodes.select(F.col("id").alias("v"), "n")
    counted = open_links.join(weights, "v").groupBy(F.col("u").alias("id"))
    counted = counted.agg(F.sum("n").alias("links"), F.count(F.lit(1)).alias("distinct"))
    crowded = linked.join(dense, "component").withColumnRenamed("node", "id")
    enlarged = _block_counts(nodes, crowded, threshold, settings)
    return linked, written(counted.unionByName(enlarged))


def _block_counts(
    nodes: DataFrame, crowded: DataFrame, threshold: float, settings: Settings
) -> DataFrame:
    """Links of all nodes of the given components, counted block against block."""
    sizes = crowded.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    blocks = F.ceil(F.col("size") / F.lit(float(settings.block))).cast("long")
    dealt = crowded.join(sizes, "component").withColumn("blocks", blocks)
    dealt = dealt.withColumn("mine", F.pmod(F.xxhash64("id"), F.col("blocks")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other")
    paired = dealt.select("component", "id", "mine", other)
    paired = paired.select(
        "id",
        F.struct(
            "component",
            F.least("mine", "other").alias("a"),
            F.greatest("mine", "other").alias("b"),
        ).alias("place"),
        (F.col("mine") <= F.col("other")).alias("left"),
    )
    # A pair of blocks is two blocks of vectors: bounded.
    gathered = paired.join(nodes.select("id", "x", "n"), "id").groupBy("place").agg(
        F.collect_list(F.struct("id", "n", "left", "x")).alias("members"),
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[np.empty(0, np.int64)] for _ in range(3)]
            for same, members in zip(batch.column("same"), batch.column("members")):
                parts = members.values
                ids, n = parts.field("id").to_numpy(), parts.field("n").to_numpy()
                left = parts.field("left").to_numpy(False)
                rows = unit_rows(parts.field("x"))
                near = rows @ rows.T >= threshold
                np.fill_diagonal(near, False)
                if not same.as_py():
                    near &= left[:, None] != left[None, :]
                for column, values in zip(out, (ids, near @ n, near.sum(axis=1))):
                    column.append(values)
            arrays = [pa.array(np.concatenate(c).astype(np.int64)) for c in out]
            yield pa.RecordBatch.from_arrays(arrays, ["id", "links", "distinct"])

    pairs = gathered.select((F.col("place.a") == F.col("place.b")).alias("same"), "members")
    parts = pairs.mapInArrow(count, "id long, links long, distinct long")
    return parts.groupBy("id").agg(
        F.sum("links").alias("links"), F.sum("distinct").alias("distinct")
    )


def _audit(
    nodes: DataFrame, counted: DataFrame, threshold: float, settings: Settings, total: int
) -> float:
    """The share of the true links of sampled nodes that were found; 1.0 if they have none."""
    hashed = written(nodes.select("id", "label", "d", "x", F.xxhash64("id").alias("hash")))
    expected = got = done = 0
    size, last = settings.audited, None
    most = min(total, settings.most_audited)
    while done < most and expected < settings.seen:
        left = hashed if last is None else hashed.where(last)
        asked = left.orderBy("hash", "id").limit(min(size, most - done)).toArrow()
        true, found = _audit_block(hashed, counted, asked, threshold)
        expected, got, done = expected + true, got + found, done + len(asked)
        end = asked.slice(len(asked) - 1).to_pylist()[0]
        later, same = F.col("hash") > F.lit(end["hash"]), F.col("hash") == F.lit(end["hash"])
        last = later | (same & (F.col("id") > F.lit(end["id"])))
        size = min(2 * size, settings.audit_block)
    forget(hashed)
    return got / expected if expected else 1.0


def _audit_block(
    nodes: DataFrame, counted: DataFrame, asked: pa.Table, threshold: float
) -> tuple[int, int]:
    """How many links the asked nodes have, and how many of these were counted: one scan, in
    which each task sends one count per asked node."""
    kinds: dict[tuple, list[int]] = {}
    pairs = zip(asked.column("label").to_pylist(), asked.column("d").to_pylist())
    for row, kind in enumerate(pairs):
        kinds.setdefault(kind, []).append(row)
    ids, vectors = asked.column("id").to_numpy(), asked.column("x").combine_chunks()
    packed = {
        kind: (ids[rows], unit_rows(vectors.take(pa.array(rows)))) for kind, rows in kinds.items()
    }
    sent = nodes.sparkSession.sparkContext.broadcast(packed)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, int] = {}
        for batch in batches:
            places: dict[tuple, list[int]] = {}
            pairs = zip(batch.column("label").to_pylist(), batch.column("d").to_pylist())
            for row, kind in enumerate(pairs):
                places.setdefault(kind, []).append(row)
            for kind, rows in places.items():
                if kind not in sent.value:
                    continue
                mine, queries = sent.value[kind]
                part = batch.take(pa.array(rows))
                near = queries @ unit_rows(part.column("x")).T >= threshold
                near &= part.column("id").to_numpy()[None, :] != mine[:, None]
                for query, n in zip(mine.tolist(), near.sum(axis=1).tolist()):
                    if n:
                        totals[query] = totals.get(query, 0) + n
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(totals), pa.int64()), pa.array(list(totals.values()), pa.int64())],
            ["id", "true"],
        )

    scanned = nodes.select("id", "label", "d", "x").mapInArrow(compare, "id long, true long")
    true = scanned.groupBy("id").agg(F.sum("true").alias("true"))
    found = F.coalesce("distinct", F.lit(0))
    sums = true.join(counted, "id", "left").agg(F.sum("true"), F.sum(F.least(found, "true")))
    expected, got = sums.first()
    sent.unpersist()
    return expected or 0, got or 0
