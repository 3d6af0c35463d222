"""Passages that documents share, found with suffix arrays and cut from all but the first."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from dataloupe.functions.columns import col, require_columns
from dataloupe.llm.frames import input_bytes, others, ship, slices, trim, unused, written
from dataloupe.llm.suffix_array import MARGIN, place_type, same_as_before, sort_windows
from dataloupe.llm.words import mixed

TASK_BYTES = 12 << 20  # text that a task packs at a time
PIECE = 1 << 20  # bytes in which anchors are looked for at a time
DETECT_BYTES = 2 << 20  # text whose anchors are compared in one task
SORT_BYTES = 3 << 20  # text whose shared windows are sorted in one task, and windows sorted at a time
PORTIONS = 64  # into which the windows of a bin can be split
KEY_BITS = 40
MOST_HOT = 1 << 21  # entries of the list of frequent anchors
LEAST_HOT = 1000
COPY = -1  # stands before the hash (high byte first) of a text that is a copy; no anchor is negative
SEPARATOR = 0xFF  # no byte of UTF-8


def gram_size(length: int) -> int:
    return 2 * length // 5


def anchors(texts: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """The anchors of all windows of ``length`` bytes: ``(text, start, count, hash)``.

    The anchor of a window is its gram with the least hash, the leftmost if several have it
    (winnowing), so that equal windows have the same anchor at the same place in any text. An
    anchor has the ``count`` windows from ``start`` on in the text with that number.
    """
    found: list[tuple[np.ndarray, ...]] = []
    held: list[tuple[int, int, bytes]] = []
    size = 0
    for number, text in enumerate(texts):
        for at in range(0, max(1, len(text) - length + 1), PIECE - length):
            piece = text[at : at + PIECE - 1]
            if len(piece) < length:
                continue
            if size + len(piece) > PIECE:
                found.append(_anchors(held, length))
                held, size = [], 0
            held.append((number, at, piece))
            size += len(piece)
    if held:
        found.append(_anchors(held, length))
    if not found:
        return tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, np.uint64))
    return tuple(map(np.concatenate, zip(*found)))


def _anchors(held: list[tuple[int, int, bytes]], length: int) -> tuple[np.ndarray, ...]:
    data = np.frombuffer(b"".join(p for *_, p in held) + bytes(8), np.uint8)
    n, gram = len(data) - 8, gram_size(length)
    sizes = np.asarray([len(p) for *_, p in held])
    owner = np.repeat(np.arange(len(held)), sizes)
    words = np.ndarray((n + 1,), "<u8", data, 0, (1,))
    grams = n - gram + 1
    hashes = np.full(grams, gram, np.uint64)
    for offset in [*range(0, gram - 7, 8), gram - 8]:
        hashes = mixed(hashes * np.uint64(0x9E3779B97F4A7C15) + words[offset : offset + grams])
    # The place goes into the low bits: the least of these numbers is the leftmost least hash.
    ranked = hashes & ~np.uint64(PIECE - 1) | np.arange(grams, dtype=np.uint64)
    width, done = length - gram + 1, 1
    least = ranked
    while done < width:
        step = min(done, width - done)
        least = np.minimum(least[:-step], least[step:])
        done += step
    place = (least & np.uint64(PIECE - 1)).astype(np.int64)
    inside = owner[: n - length + 1] == owner[length - 1 : n]
    place[~inside] = -1
    first = np.flatnonzero(np.diff(place, prepend=-2))
    count = np.diff(np.append(first, len(place)))
    first, count = first[place[first] >= 0], count[place[first] >= 0]
    piece = owner[first]
    begins = np.cumsum(sizes) - sizes
    numbers, offsets = np.asarray([h[0] for h in held]), np.asarray([h[1] for h in held])
    return numbers[piece], first - begins[piece] + offsets[piece], count, hashes[place[first]]


def _values(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each anchor and 40 bits of its hash in one number. A bucket holds about
    the same number of anchors at any size of the corpus, so that 40 bits leave few chance
    matches, and those are sorted out with the texts themselves."""
    keys = mixed(hashes)
    place = keys % np.uint64(buckets)
    return (place << np.uint64(KEY_BITS) | keys >> np.uint64(64 - KEY_BITS)).astype(np.int64)


def _buffer(value) -> np.ndarray:
    return np.frombuffer(value, np.int64)


def shared_spans(
    docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = 50
) -> DataFrame:
    """The bytes of each document that repeat an earlier one: ``(key, text_hash, starts, ends)``.

    A byte belongs to a span if a string of ``length`` bytes that covers it also starts in
    a document with a smaller key. Texts are compared as whole UTF-8 byte strings, and all
    on the input. Only rows with spans are returned; ``starts`` and ``ends`` are lists of packed
    64-bit integers that may overlap, for ``with_cut`` to apply. ``text_hash`` (XXH64) tells
    rows with the same key apart. Keys are integers; rows with a null key and null or
    shorter texts take no part. Repeated rows have the same spans, as no key is smaller.

    1. Every window of ``length`` bytes has an anchor. Tasks pack their distinct anchors
       by hash bucket; a bucket finds those that occur in several documents. Within a task
       only the smallest key with an anchor is sent, so that an anchor of a third of all
       documents is one entry per task.
    2. Whole texts that a smaller key has too are spans as they are. The other texts with
       shared anchors write down the windows of these, packed by anchor.
       Windows that a smaller key in the same task has too are settled there. The
       windows of very frequent anchors (a list of at most 2^21) are dealt by their own content
       instead, so that no bucket gathers a frequent passage with all its surroundings.
    3. In each bucket the windows are sorted by a two-stage suffix sort, and neighbours with
       ``length`` bytes in common form groups, whose smallest key keeps its window. Windows that
       stand alone take up far more bytes than their texts, so a bucket with more than
       ``SORT_BYTES`` is sorted in portions; equal windows are in the same one.
    """
    require_columns(docs, key, text)
    if length < 20:
        raise ValueError("at least 20 bytes are needed")
    kind = dict(docs.dtypes)[key]
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"{key} must be an integer column, not {kind}")
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(col(key).cast("long").alias("key"), col(text).alias("text"))
    rows = rows.where(F.col("key").isNotNull() & (F.octet_length("text") >= length))
    size = input_bytes(rows, "text")
    buckets = 1 + size // DETECT_BYTES
    width = length - gram_size(length) + 1
    threshold = max(LEAST_HOT, 2 * size // (width + 1) // MOST_HOT)
    packed = rows.mapInArrow(
        _pack_anchors(length, buckets),
        "bucket long, keys binary, counts binary, anchors binary, repeats binary, "
        "known_keys binary, known_counts binary, known binary",
    )
    hits = written(
        packed.groupBy("bucket").applyInPandas(
            _shared_anchors(threshold), "frequent boolean, key long, anchors binary"
        )
    )
    # At most MOST_HOT anchors of eight bytes.
    frequent = [r[0] for r in hits.where("frequent").select("anchors").collect()]
    hot = np.sort(np.concatenate([np.empty(0, np.int64), *map(_buffer, frequent)]))
    sent = spark.sparkContext.broadcast(hot.tobytes())
    known = hits.where("NOT frequent").select("key", "anchors").union(_whole_copies(rows))
    listed = known.groupBy("key").agg(F.collect_list("anchors").alias("anchors"))
    bins = 1 + size // SORT_BYTES
    compact = rows.select("key", packed_text(F.col("text")).alias("packed"))
    windows = compact.join(listed, "key").mapInArrow(
        _pack_windows(length, buckets, bins, sent), "bucket long, size long, payload binary"
    )
    spans = windows.groupBy("bucket").applyInPandas(
        _sorted_spans(length), "key long, text_hash long, starts binary, ends binary"
    )
    gathered = spans.groupBy("key", "text_hash").agg(
        F.collect_list("starts").alias("starts"), F.collect_list("ends").alias("ends")
    )
    return gathered.withColumn("key", F.col("key").cast(kind)).withColumnRenamed("key", key)


def _whole_copies(rows: DataFrame) -> DataFrame:
    """``(key, anchors)``: the mark and the text hash of rows whose whole text a smaller key has.

    Only keys and digests are shuffled, and a group of copies of any size is one minimum.
    """
    prints = rows.select("key", F.sha2("text", 256).alias("digest"), F.xxhash64("text").alias("h"))
    first = prints.groupBy("digest").agg(F.min("key").alias("first"), F.max("key").alias("last"))
    copies = prints.join(first.where("first < last"), "digest").where("key > first")
    mark = F.concat(F.unhex(F.lit("F" * 16)), F.unhex(F.lpad(F.hex("h"), 16, "0")))
    return copies.select("key", mark.alias("anchors"))


def packed_text(text: Column) -> Column:
    """Texts compressed for a shuffle, with their size in front; nulls stay null."""

    @F.pandas_udf("binary")
    def pack(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            small = [None if t is None else packed(t.encode()) for t in batch]
            yield pd.Series(small, dtype="object")
        trim()

    return pack(text)


def packed(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def unpacked(value: bytes) -> bytes:
    size = int.from_bytes(value[:8], "little")
    return pa.decompress(value[8:], size, codec="zstd", asbytes=True) if size else b""


def _pack_anchors(length: int, buckets: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", TASK_BYTES):
            keys = batch.column("key").to_numpy()
            texts = [t.as_buffer().to_pybytes() for t in batch.column("text")]
            owner, _, _, hashes = anchors(texts, length)
            pairs = np.stack([_values(hashes, buckets), keys[owner]])
            order = np.lexsort(pairs[::-1])
            values, owners = pairs[:, order]
            new = np.diff(values, prepend=-1) != 0
            once = new | (np.diff(owners, prepend=-1) != 0)
            values, owners, new = values[once], owners[once], new[once]
            repeats = np.diff(np.append(np.flatnonzero(new), len(new)))
            yield _anchor_rows(values[new], owners[new], repeats, values[~new], owners[~new], buckets)
        trim()

    return pack


def _runs(owners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first = np.flatnonzero(np.diff(owners, prepend=owners[:1] - 1)) if len(owners) else owners
    return owners[first], np.diff(np.append(first, len(owners)))


def _anchor_rows(values, owners, repeats, others, other_owners, buckets) -> pa.RecordBatch:
    """One row per bucket: the distinct anchors by key, in 40 bits each. The row of one of the
    buckets also has the anchors that are known to be shared inside the task."""
    place = values >> KEY_BITS
    order = np.lexsort((values, owners, place))
    values, owners, repeats, place = values[order], owners[order], repeats[order], place[order]
    chosen = np.unique(place)
    spread = int(owners[0]) % buckets if len(owners) else 0
    listed = np.union1d(chosen, [spread]) if len(others) else chosen
    other_order = np.lexsort((others, other_owners))
    others, other_owners = others[other_order], other_owners[other_order]
    columns: list[list] = [[] for _ in range(8)]
    for bucket in listed.tolist():
        a, b = np.searchsorted(place, [bucket, bucket + 1])
        keys, counts = _runs(owners[a:b])
        small = values[a:b].astype("<u8").view(np.uint8).reshape(-1, 8)[:, : KEY_BITS // 8]
        row = [bucket, keys, counts, np.ascontiguousarray(small), repeats[a:b].astype(np.int32)]
        if bucket == spread and len(others):
            row += [*_runs(other_owners), others]
        else:
            row += [np.empty(0, np.int64)] * 3
        for column, value in zip(columns, row):
            column.append(value if isinstance(value, int) else value.tobytes())
    names = "bucket keys counts anchors repeats known_keys known_counts known".split()
    kinds = [pa.int64()] + [pa.binary()] * 7
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def _shared_anchors(threshold: int):
    def shared(rows: pd.DataFrame) -> pd.DataFrame:
        def joined(name: str, kind=np.int64) -> np.ndarray:
            return np.concatenate([np.frombuffer(v, kind) for v in rows[name]])

        owners = np.repeat(joined("keys"), joined("counts"))
        small = joined("anchors", np.uint8).reshape(-1, KEY_BITS // 8)
        wide = np.zeros((len(small), 8), np.uint8)
        wide[:, : KEY_BITS // 8] = small
        values = wide.view("<u8")[:, 0].astype(np.int64)
        values |= np.int64(int(rows["bucket"].iloc[0]) << KEY_BITS)
        distinct, place = np.unique(values, return_inverse=True)
        total = np.bincount(place, joined("repeats", np.int32), len(distinct))
        several = np.bincount(place, minlength=len(distinct)) > 1
        mine = (several | (total > 1))[place]
        every = np.concatenate([values[mine], joined("known")])
        keys = np.concatenate([owners[mine], np.repeat(joined("known_keys"), joined("known_counts"))])
        order = np.lexsort((every, keys))
        every = every[order]
        listed, counts = _runs(keys[order])
        ends = np.cumsum(counts)
        lists = [every[b - n : b].tobytes() for b, n in zip(ends.tolist(), counts.tolist())]
        frame = pd.DataFrame({"frequent": False, "key": listed, "anchors": lists})
        hot = distinct[total >= threshold]
        if not len(hot):
            return frame
        row = pd.DataFrame({"frequent": [True], "key": [0], "anchors": [hot.tobytes()]})
        return pd.concat([frame, row], ignore_index=True)

    return shared


def _text_hash(text: bytes) -> int:
    import xxhash

    value = xxhash.xxh64_intdigest(text, 42)  # as Spark's xxhash64
    return value - (1 << 64) if value >> 63 else value


def _pack_windows(length: int, buckets: int, bins: int, sent):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = np.frombuffer(sent.value, np.int64)
        for batch in slices(batches, "packed", TASK_BYTES // 2):
            keys = batch.column("key").to_numpy()
            ascending = np.argsort(keys, kind="stable")
            batch, keys = batch.take(pa.array(ascending)), keys[ascending]
            texts = [unpacked(t) for t in batch.column("packed").to_pylist()]
            prints = [_text_hash(t) for t in texts]
            lists = [[_buffer(x) for x in xs] for xs in batch.column("anchors").to_pylist()]
            marked = [{int(x[1].byteswap()) for x in xs if x[0] == COPY} for xs in lists]
            copy = np.asarray([h in m for h, m in zip(prints, marked)], bool)
            some = [x for xs in lists for x in xs if x[0] != COPY]
            shared = np.unique(np.concatenate([np.empty(0, np.int64), *some]))
            # A copy stands for its windows as a whole.
            owner, start, count, hashes = anchors(
                [b"" if c else t for t, c in zip(texts, copy)], length
            )
            values = _values(hashes, buckets)
            mine = np.isin(values, shared)
            owner, start, count, values = owner[mine], start[mine], count[mine], values[mine]
            # The windows of frequent anchors stand alone.
            split = np.isin(values, hot)
            times = np.where(split, count, 1)
            first = np.repeat(np.cumsum(times) - times, times)
            owner, values, split = (np.repeat(x, times) for x in (owner, values, split))
            start = np.repeat(start, times) + np.arange(len(owner)) - first
            count = np.where(split, 1, np.repeat(count, times))
            settled = [(i, 0, len(texts[i])) for i in np.flatnonzero(copy).tolist()]
            yield _window_rows(
                keys, texts, prints, owner, start, count, values, split, length, bins, settled
            )
        trim()

    return pack


def _window_rows(
    keys, texts, hashes, owner, start, count, values, split, length, bins, settled
) -> pa.RecordBatch:
    """Texts come in ascending order of their keys, so that the first to have a stretch of
    windows has the smallest key of the task."""
    ends = start + count + length - 1
    seen: dict[bytes, int] = {}
    sent: dict[int, list[tuple]] = {}
    rest, spread = np.divmod(mixed(values.astype(np.uint64)), np.uint64(bins))
    portions = (rest % np.uint64(PORTIONS)).astype(np.uint8)
    key_of = keys.tolist()
    columns = (owner, start, ends, spread, portions, split)
    for i, a, b, place, portion, alone in zip(*(c.tolist() for c in columns)):
        stretch = texts[i][a:b]
        if seen.setdefault(stretch, i) != i and key_of[seen[stretch]] < key_of[i]:
            settled.append((i, a, b))
            continue
        if alone:
            portion, place = divmod(_text_hash(stretch), bins)
            portion %= PORTIONS
        sent.setdefault(place, []).append((i, a, portion, stretch))
    rows = []
    for place, entries in sent.items():
        text = b"".join([stretch for *_, stretch in entries])
        sized = [(i, a, len(stretch)) for i, a, _, stretch in entries]
        of_entries = np.asarray([portion for *_, portion, _ in entries], np.uint8)
        rows.append((place, *_packed(sized, key_of, hashes, of_entries, text, False)))
    if settled:
        merged = _merged(settled)
        none = np.zeros(len(merged), np.uint8)
        rows.append((key_of[merged[0][0]] % bins, *_packed(merged, key_of, hashes, none, b"", True)))
    columns = zip(*rows) if rows else ([], [], [])
    kinds = (pa.int64(), pa.int64(), pa.binary())
    arrays = [pa.array(list(c), k) for c, k in zip(columns, kinds)]
    return pa.RecordBatch.from_arrays(arrays, ["bucket", "size", "payload"])


def _merged(spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans of the same text, in order, with overlapping ones joined."""
    out: list[tuple[int, int, int]] = []
    for i, a, b in sorted(spans):
        if out and out[-1][0] == i and a <= out[-1][2]:
            out[-1] = (i, out[-1][1], max(b, out[-1][2]))
        else:
            out.append((i, a, b))
    return out


def _packed(
    entries: list[tuple[int, int, int]], key_of: list[int], hashes: list[int], portions: np.ndarray,
    text: bytes, settled: bool,
) -> tuple[int, bytes]:
    """Entries ``(number of the text, start, size or end)``, their portions and bytes, compressed:
    the keys and hashes of the texts once, then the columns. ``settled`` tells that the third
    holds the ends of spans."""
    numbers, starts, third = np.asarray(entries, np.int64).T
    used, place = np.unique(numbers, return_inverse=True)
    texts = np.asarray([[key_of[i] for i in used], [hashes[i] for i in used]], np.int64)
    head = np.asarray([len(used), len(entries), int(settled)], np.int64)
    parts = [head, texts, place.astype(np.int32), starts, third if settled else third.astype(np.int32), portions]
    whole = b"".join(p.tobytes() for p in parts) + text
    return len(whole), pa.compress(whole, codec="zstd", asbytes=True)


def _unpack(payload: bytes, size: int) -> tuple[bool, list[np.ndarray], bytes]:
    """What ``_packed`` was given: settled or not, ``[keys, hashes, starts, third, portions]``, the
    text."""
    whole = pa.decompress(payload, size, codec="zstd", asbytes=True)
    used, n, settled = np.frombuffer(whole, np.int64, 3).tolist()
    at, columns = 24, []
    sizes = (used, used, n, n, n, n)
    kinds = (np.int64, np.int64, np.int32, np.int64, np.int64 if settled else np.int32, np.uint8)
    for count, kind in zip(sizes, kinds):
        columns.append(np.frombuffer(whole, kind, count, at))
        at += columns[-1].nbytes
    keys, hashes, place, starts, third, portions = columns
    # Copies, as a view of the bytes would keep all of them.
    parts = [keys[place], hashes[place], starts.copy(), third.astype(np.int64), portions.copy()]
    return bool(settled), parts, whole[at:]


def _sorted_spans(length: int):
    def sort(rows: pd.DataFrame) -> pd.DataFrame:
        columns: list[list[np.ndarray]] = [[], [], [], [], []]
        texts, done = [], []
        for size, payload in zip(rows["size"], rows["payload"]):
            settled, parts, text = _unpack(payload, size)
            if settled:
                done.append(tuple(parts[:4]))
                continue
            for column, part in zip(columns, parts):
                column.append(part)
            texts.append(text)
        found = [_in_portions(columns, texts, length)] if texts else []
        found += done
        keys, hashes, starts, ends = (np.concatenate(c) for c in zip(*found))
        trim()
        return _span_frame(keys, hashes, starts, ends)

    return sort


def _in_portions(columns: list[list[np.ndarray]], texts: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """What ``_repeated`` finds, with about ``SORT_BYTES`` of the text sorted at a time. The lists
    are emptied, so that nothing is held twice."""
    *entries, portions = (np.concatenate(c) for c in columns)
    text = b"".join(texts)
    columns.clear(), texts.clear()
    sizes, data = entries[3], np.frombuffer(text, np.uint8)
    held = np.bincount(portions, sizes, PORTIONS)
    turn = (np.cumsum(held) - held).astype(np.int64) // SORT_BYTES
    if turn[-1] == 0:
        return _repeated(entries, data, length)
    turns, found = turn[portions], []
    for now in np.unique(turns):
        mine = turns == now
        found.append(_repeated([e[mine] for e in entries], data[np.repeat(mine, sizes)], length))
    return _joined(*map(np.concatenate, zip(*found)))


def _repeated(entries: list[np.ndarray], text: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """The windows that a smaller key has too, merged to spans ``(key, hash, start, end)``."""
    keys, hashes, starts, sizes = entries
    # A separator follows each stretch, so that none runs on into the next.
    n = len(text) + len(sizes)
    data = np.full(n + MARGIN + length, SEPARATOR, np.uint8)
    ends = np.cumsum(sizes + 1) - 1
    begins = ends - sizes
    body = np.ones(n, bool)
    body[ends] = False
    data[:n][body] = text
    # The last places of a stretch and its separator begin no window.
    turns = np.stack([sizes - length + 1, np.full(len(sizes), length)], axis=1).ravel()
    body = np.repeat(np.tile([True, False], len(sizes)), turns)
    order = sort_windows(data, np.flatnonzero(body).astype(place_type(len(data))), length)
    first = np.flatnonzero(~same_as_before(data, order, length))
    # The rank of a key takes less room than the key.
    rank = np.unique(keys, return_inverse=True)[1].astype(np.int32)
    owner = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes + 1)
    ranks = rank[owner[order]]
    least = np.minimum.reduceat(ranks, first)
    again = ranks > np.repeat(least, np.diff(np.append(first, len(order))))
    body[:] = False
    body[order[again]] = True
    del order, first, ranks, least, again
    # Overlapping windows of a stretch are joined here, before their keys and hashes are looked up.
    place = np.flatnonzero(body).astype(place_type(n))
    mine = owner[place]
    new = np.ones(len(place), bool)
    new[1:] = (mine[1:] != mine[:-1]) | (np.diff(place) > length)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(place))[: len(first)] - 1
    mine = mine[first]
    shift = starts[mine] - begins[mine]
    return _joined(keys[mine], hashes[mine], place[first] + shift, place[last] + shift + length)


def _joined(keys, hashes, starts, ends) -> tuple[np.ndarray, ...]:
    """Spans by key and hash, with runs of overlapping ones joined."""
    order = np.lexsort((starts, hashes, keys))
    keys, hashes, starts, ends = keys[order], hashes[order], starts[order], ends[order]
    new = np.ones(len(keys), bool)
    if len(keys):
        same = (keys[1:] == keys[:-1]) & (hashes[1:] == hashes[:-1])
        # The number of the text stands before the place, so that no end reaches the next text.
        text = np.cumsum(np.append(False, ~same)) << 32
        reach = np.maximum.accumulate(text | ends)
        new[1:] = text[1:] | starts[1:] > reach[:-1]
        ends = reach - text
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(keys))[: len(first)] - 1
    return keys[first], hashes[first], starts[first], ends[last]


def _span_frame(keys, hashes, starts, ends) -> pd.DataFrame:
    order = np.lexsort((starts, hashes, keys))
    keys, hashes, starts, ends = keys[order], hashes[order], starts[order], ends[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (hashes[1:] != hashes[:-1])
    first = np.flatnonzero(new)
    cuts = list(zip(first.tolist(), np.append(first[1:], len(keys)).tolist()))
    return pd.DataFrame(
        {
            "key": keys[first],
            "text_hash": hashes[first],
            "starts": [starts[a:b].tobytes() for a, b in cuts],
            "ends": [ends[a:b].tobytes() for a, b in cuts],
        }
    )


def cut(data: bytes, starts, ends) -> tuple[bytes, int, int]:
    """What is left of a text, the number of bytes removed, and of maximal removed runs."""
    if starts is None or not len(starts):
        return data, 0, 0
    a = np.concatenate([_buffer(x) for x in starts])
    b = np.concatenate([_buffer(x) for x in ends])
    order = np.argsort(a)
    a, b = a[order], np.maximum.accumulate(b[order])
    new = np.append(True, a[1:] > b[:-1])
    first = np.flatnonzero(new)
    begins, stops = a[first], b[np.append(first[1:], len(a)) - 1]
    kept, at = [], 0
    for x, y in zip(begins.tolist(), stops.tolist()):
        kept.append(data[at:x])
        at = y
    kept.append(data[at:])
    return b"".join(kept), int((stops - begins).sum()), len(begins)


def with_cut(
    docs: DataFrame,
    spans: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    name: str = "kept",
    with_text: bool = True,
) -> DataFrame:
    """``docs`` with the struct ``name``: ``(kept binary, n_removed long, n_spans long)``.

    ``spans`` is what ``shared_spans`` gives. Every row is kept; null texts count as empty. A
    column ``name`` is replaced; the text itself is left out on request.
    """
    require_columns(docs, key, text)
    ship(docs.sparkSession)

    # One Python function per stage, as each needs a worker of its own.
    @F.pandas_udf("kept binary, n_removed long, n_spans long, whole string")
    def apply(rows: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for texts, starts, ends in rows:
            done = []
            for small, a, b in zip(texts, starts, ends):
                whole = None if small is None else unpacked(small)
                done.append((*cut(whole or b"", a, b), whole.decode() if with_text and small is not None else None))
            yield pd.DataFrame(done, columns=["kept", "n_removed", "n_spans", "whole"])
        trim()

    mine, digest, starts, ends = (unused(docs, n) for n in ("key", "hash", "starts", "ends"))
    found = spans.select(
        col(key).alias(mine),
        F.col("text_hash").alias(digest),
        F.col("starts").alias(starts),
        F.col("ends").alias(ends),
    )
    # Texts travel compressed.
    hashed, small = unused(docs, "text_hash"), unused(docs, "packed")
    shuffled = docs.withColumn(hashed, F.xxhash64(col(text))).withColumn(small, packed_text(col(text)))
    rest = [n for n in docs.columns if n != text]
    same = (col(key) == col(mine)) & (col(hashed) == col(digest))
    joined = shuffled.select(*map(col, [*rest, hashed, small])).join(found, same, "left")
    place = unused(docs, "cut")
    # So marked, it is not run once more, in a second worker, for a filter on what it gives.
    once = apply.asNondeterministic()
    cut_ = joined.withColumn(place, once(col(small), col(starts), col(ends)))
    shown = {n: col(place)["whole"].alias(n) if n == text else col(n) for n in others(docs, name)}
    if not with_text:
        shown.pop(text, None)
    return cut_.select(*shown.values(), F.struct(*[col(place)[n].alias(n) for n in ("kept", "n_removed", "n_spans")]).alias(name))
