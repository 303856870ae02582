"""Removal of repeated byte strings with a sparse enhanced suffix array.

Suffixes start at anchors: the positions whose 32 bytes hash lowest within some 240 bytes.  Equal strings
have equal anchors, and every string of 400 bytes has one in its first 240.  The array is dealt by the
hash of the first 160 bytes of a suffix, which cuts it into independent ranges.  In each range suffixes
are sorted, neighbours' common prefixes are taken, and a stack scan walks the tree of common-prefix
intervals.  Suffixes whose surroundings occur twice as they are need no tree: they are counted.  Ranges
too large for one task are cut by longer shared strings, in the end by the whole length.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.llm.common import map_slices
from tabloom.session import durable

LENGTH = 400
#: Bytes that are hashed to choose anchors.
GRAM = 32
#: Share of the length in which an anchor is guaranteed; the rest is the part a range is dealt by.
SPAN_SHARE = 0.6
#: Suffixes of one range that one task takes; larger ranges are cut (`_hot`), first into this many kinds of keys.
RANGE_LIMIT = 20_000
CUTS = 8

_U32 = np.uint64(32)


def anchors(data: np.ndarray, span: int) -> np.ndarray:
    """Positions whose gram hash is the least among the grams of some `span` bytes."""
    n, window = len(data) - GRAM + 1, span - GRAM + 1
    if n < window:
        return np.zeros(0, dtype=np.int64)
    word = data.astype(np.uint64)
    for shift in (1, 2, 4):  # after three steps every position holds its next eight bytes
        word = word[:-shift] | (word[shift:] << np.uint64(8 * shift))
    h = np.zeros(n, dtype=np.uint64)
    for k in range(0, GRAM, 8):
        h = (h ^ word[k: k + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    h = ((h * np.uint64(0xBF58476D1CE4E5B9)) >> _U32).astype(np.uint32)
    least = _sliding(np.minimum, h, window)
    edge = np.zeros(window - 1, dtype=np.uint32)
    # the greatest of the minima of all windows around a position is its own hash exactly for anchors
    return np.flatnonzero(_sliding(np.maximum, np.concatenate((edge, least, edge)), window) == h)


def _sliding(best, values: np.ndarray, window: int) -> np.ndarray:
    """Minimum or maximum of every run of `window` values, by doubling."""
    width = 1
    while width < window:
        step = min(width, window - width)
        values = best(values[: len(values) - step], values[step:])
        width += step
    return values


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary column end to end, and the offsets of its rows; nulls are empty."""
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int32)[column.offset: column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[at[0]: at[-1]] if data is not None else np.zeros(0, dtype=np.uint8)
    return raw, at - at[0]


def _signed(hashes: list[int]) -> pa.Array:
    return pa.array(np.array(hashes, dtype=np.uint64).view(np.int64))


_L, _B = T.LongType(), T.BinaryType()
_schema = lambda **fields: T.StructType([T.StructField(k, v) for k, v in fields.items()])
_SUFFIXES = _schema(doc=_L, spot=_L, own=_L, ctx=_L)
_CONTEXTS = _schema(own=_L, doc=_L, spot=_L, left=_B, right=_B)
_PLACED = _schema(own=_L, doc=_L, spot=_L, left=_B, right=_B, crowded=T.BooleanType())

# A spot is one long: twelve more bits of the text's key, the position, and how far its surroundings reach
# to the left and to the right.
_AT, _MORE, _SIDE = 20, 51, 1023


def _pack(more, at, before, after):
    return (more << _MORE) | (at << _AT) | (before << 10) | after


def _more(spot):
    return F.shiftright(spot, _MORE)


def _extent(spot, before, after) -> list:
    """A stretch around a spot as columns (doc, more, from, to)."""
    at = F.shiftright(spot, _AT).bitwiseAND(F.lit(2**31 - 1))
    return [F.col("doc"), _more(spot).alias("more"), (at - before).alias("from"), (at + after).alias("to")]


def keyed_texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, more, id, text): texts as bytes under 76 bits of key; rows of one id and text share it."""
    raw = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    return docs.select(F.xxhash64(id_col, text_col).alias("doc"), F.pmod(F.hash(text_col, id_col), F.lit(4096)).cast("long").alias("more"),
                       F.col(id_col).cast("long").alias("id"), raw.alias("text"))


def _suffixes(texts: DataFrame, length: int) -> DataFrame:
    """(doc, spot, own, ctx): anchors, the hash they are dealt by, and the hash of their surroundings."""
    span = int(length * SPAN_SHARE)
    own = length - span

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = _flat(batch.column(2))
        found = [np.zeros(0, dtype=np.int64)]
        for block in range(0, max(len(data) - span, 0) + 1, 1 << 20):  # blocks overlap by a span, so every window is seen
            found.append(anchors(data[block: block + (1 << 20) + span], span) + block)
        at = np.unique(np.concatenate(found))
        doc = np.searchsorted(offsets, at, side="right") - 1
        start, stop = offsets[doc], offsets[doc + 1]
        good = (stop - start >= length) & (at + own <= stop)
        at, doc, start, stop = at[good], doc[good], start[good], stop[good]
        before, after = np.minimum(at - start, span), np.minimum(stop - at, length)
        digest, view = xxhash.xxh3_64_intdigest, memoryview(data)
        places = at.tolist()
        dealt = [digest(view[p: p + own]) for p in places]
        around = [digest(view[p - b: p + a], b) for p, b, a in zip(places, before.tolist(), after.tolist())]
        more = batch.column(1).to_numpy()[doc]
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc)), pa.array(_pack(more, at - start, before, after)),
                                           _signed(dealt), _signed(around)], _SUFFIXES.names)

    return map_slices(texts.select("doc", "more", "text"), work, _SUFFIXES, most=4 << 20)


# ---------------------------------------------------------------- interval tree

def repeat_intervals(lcp: list[int], least: int) -> Iterator[tuple[int, int, int, list[int]]]:
    """Stack scan of a common-prefix array: (length, first, last, cuts), children before their parents.

    `lcp[i]` is the common prefix of suffixes i and i + 1.  Intervals of less than `least` are left out.
    A cut is the last suffix of a child; the last child ends with the interval.
    """
    stack: list[tuple[int, int, list[int]]] = []
    n = len(lcp)
    for i in range(n + 1):
        here = lcp[i] if i < n else -1
        first = i
        while stack and stack[-1][0] > here:
            length, first, cuts = stack.pop()
            if length >= least:
                yield length, first, i, cuts
        if stack and stack[-1][0] == here:
            stack[-1][2].append(i)
        elif here >= 0:
            stack.append((here, first, [i]))


def extents(lcp: list[int], lcs: list[int], rank: list[int], length: int, most_left: int) -> tuple[list[int], list[int]]:
    """(left, right) per suffix in array order: how far repeats of at least `length` bytes reach around it, 0 without one.

    `lcp` holds common prefixes of neighbours in the array, `lcs` common left contexts of neighbours in the
    order of reversed left contexts, `rank` the place of each suffix in that order.  Two suffixes of
    different children of an interval agree to the right on exactly the interval's length, and the best
    partner to the left is the next one in left order.  So children are merged in left order, the small
    into the large, and a laid-in suffix looks at its two neighbours only; where these agree to the left
    beyond what is needed, the interval is a repeat.  Members that stay apart are already served by a
    member between them with a longer match.
    """
    m = len(rank)
    table = [lcs]
    while len(table[-1]) > 1 << (len(table) - 1):
        step, row = 1 << (len(table) - 1), table[-1]
        table.append([min(x, y) for x, y in zip(row, row[step:])])

    def shared(i: int, j: int) -> int:
        k = (j - i).bit_length() - 1
        return min(table[k][i], table[k][j - (1 << k)])

    left, right = [0] * m, [0] * m  # by left rank
    sets: dict[int, list[int]] = {}
    for r, first, last, cuts in repeat_intervals(lcp, length - most_left):
        need = length - r
        held, start = None, first
        for cut in (*cuts, last):
            child = sets.pop(start) if cut > start else [rank[start]]
            start = cut + 1
            if held is None:
                held = child
                continue
            small, held = (child, held) if len(child) <= len(held) else (held, child)
            for x in small:
                k = bisect_left(held, x)
                for y in held[max(k - 1, 0): k + 1]:
                    both = shared(x, y) if x < y else shared(y, x)
                    if both >= need:
                        for z in (x, y):
                            if both > left[z]:
                                left[z] = both
                            if r > right[z]:
                                right[z] = r
            if len(small) < 8:
                for x in small:
                    insort(held, x)
            else:
                held += small
                held.sort()  # two ascending runs
        sets[first] = held
    return [left[x] for x in rank], [right[x] for x in rank]


def _shared(column: np.ndarray, sizes: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Common prefix of each row and the next in `order`."""
    a, b = order[:-1], order[1:]
    differ = column[a] != column[b]
    same = np.where(differ.any(axis=1), differ.argmax(axis=1), column.shape[1])
    return np.minimum(same, np.minimum(sizes[a], sizes[b]))


def _matrix(values: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, values), dtype=np.int64, count=len(values))
    width = max(int(sizes.max(initial=1)), 1)
    return np.frombuffer(b"".join([v.ljust(width, b"\0") for v in values]), dtype=np.uint8).reshape(len(values), width), sizes


def range_extents(keys: np.ndarray, left: list[bytes], right: list[bytes], length: int, known: int, most_left: int) -> tuple[np.ndarray, np.ndarray]:
    """(left, right) extents of suffixes in whole ranges.  `left` are the reversed bytes before an anchor, `right`
    those after the `known` ones that a range shares."""
    n = len(keys)
    out_left, out_right = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    _, key = np.unique(keys, return_inverse=True)
    neighbours = []
    for values in (right, left):
        grid, sizes = _matrix(values)
        # equal padded rows are told apart by their sizes, so a shorter suffix comes first
        order = np.lexsort((sizes, np.ascontiguousarray(grid).view(f"S{grid.shape[1]}").ravel(), key))
        neighbours.append((order, _shared(grid, sizes, order) if n > 1 else np.zeros(0, dtype=np.int64)))
    (array, lcp), (by_left, lcs) = neighbours
    lcp = lcp + known
    rank = np.empty(n, dtype=np.int64)
    rank[by_left] = np.arange(n)
    bounds = np.concatenate(([0], np.cumsum(np.bincount(key))))
    sizes = np.diff(bounds)
    # a range of two suffixes is one interval with one pair
    two = bounds[:-1][sizes == 2]
    good = two[lcp[two] + lcs[two] >= length]
    for k in (0, 1):
        out_left[array[good + k]], out_right[array[good + k]] = lcs[good], lcp[good]
    for lo, hi in zip(bounds[:-1][sizes > 2].tolist(), bounds[1:][sizes > 2].tolist()):
        members = array[lo:hi]
        l, r = extents(lcp[lo: hi - 1].tolist(), lcs[lo: hi - 1].tolist(), (rank[members] - lo).tolist(), length, most_left)
        out_left[members], out_right[members] = l, r
    return out_left, out_right


def _packed(texts: DataFrame) -> DataFrame:
    """The texts compressed, as they cross the network."""
    others = [f for f in texts.schema.fields if f.name != "text"]

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        squeeze = zstandard.ZstdCompressor(level=1)
        return pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(others))),
                                           pa.array([squeeze.compress(t) for t in batch.column(len(others)).to_pylist()], pa.binary())],
                                          [*(f.name for f in others), "packed"])

    rows = texts.select(*[f.name for f in others], "text")
    return map_slices(rows, work, T.StructType([*others, T.StructField("packed", _B)]), most=4 << 20)


def _contexts(texts: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The bytes around the wanted suffixes (own, doc, spot, crowded): reversed to the left, beyond the dealt part to the right."""
    span = int(length * SPAN_SHARE)
    known = length - span
    per_doc = wanted.groupBy("doc", _more(F.col("spot")).alias("more")).agg(F.collect_list(F.struct("own", "spot", "crowded")).alias("spots"))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        open_ = zstandard.ZstdDecompressor()
        left, right, owns, docs, places, crowded = [], [], [], [], [], []
        for doc, packed, spots in zip(*(batch.column(i).to_pylist() for i in range(3))):
            raw = open_.decompress(packed)
            for s in spots:
                p = s["spot"] >> _AT & 2**31 - 1
                left.append(raw[max(0, p - span): p][::-1])
                right.append(raw[p + known: p + length])
                owns.append(s["own"])
                docs.append(doc)
                places.append(s["spot"])
                crowded.append(s["crowded"])
        return pa.RecordBatch.from_arrays([pa.array(owns, pa.int64()), pa.array(docs, pa.int64()), pa.array(places, pa.int64()), pa.array(left, pa.binary()),
                                           pa.array(right, pa.binary()), pa.array(crowded, pa.bool_())], _PLACED.names)

    return map_slices(_packed(texts).join(per_doc, ["doc", "more"]).select("doc", "packed", "spots"), work, _PLACED, "packed", 1 << 20)


def _tree(contexts: DataFrame, length: int) -> DataFrame:
    """Stretches around all suffixes in a repeat; a range is taken whole by one task, several ranges at once."""
    span = int(length * SPAN_SHARE)
    known = length - span

    def work(batches):
        def solve(part: pa.Table):
            part = part.combine_chunks()
            left, right = range_extents(part["own"].to_numpy(), part["left"].to_pylist(), part["right"].to_pylist(), length, known, span)
            hit = np.flatnonzero(left + right >= length)
            small = part.select(["doc", "spot"]).take(pa.array(hit))
            yield from small.append_column("before", pa.array(left[hit])).append_column("after", pa.array(right[hit])).to_batches()

        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            keys = batch.column(0)
            if sum(b.num_rows for b in held) < 4096 or keys[len(keys) - 1] == held[0].column(0)[0]:
                continue
            part = pa.Table.from_batches(held)
            own = part["own"].to_numpy()
            cut = int(np.flatnonzero(own != own[-1])[-1]) + 1  # the last range may go on
            yield from solve(part.slice(0, cut))
            held = part.slice(cut).combine_chunks().to_batches()
        if held:
            yield from solve(pa.Table.from_batches(held))

    found = contexts.select(*_CONTEXTS.names).repartition("own").sortWithinPartitions("own").mapInArrow(work, _schema(doc=_L, spot=_L, before=_L, after=_L))
    return found.select(*_extent(F.col("spot"), F.col("before"), F.col("after")))


def _keys(contexts: DataFrame, span: int, cuts: int | None) -> DataFrame:
    """(key, doc, spot, left): one key for each way in which two suffixes of a range can share the bytes they lack.

    Beyond the dealt part a repeat needs `span` more bytes, some to the left and the rest to the right.  With
    `cuts` a key takes the left part in steps and leaves one step open, so partners share a key, though
    not all with a key are partners.  Without it the whole length is in a key: all that share it repeat.
    """
    step = 1 if cuts is None else -(-span // cuts)
    sides = [(a, span - a) for a in range(span + 1)] if cuts is None else [(a, max(0, span - a - step)) for a in range(0, span, step)]

    def work(batches):
        for batch in batches:
            for few in (batch.slice(k, 512) for k in range(0, batch.num_rows, 512)):
                keys, rows, lefts = [], [], []
                for i, (own, left, right) in enumerate(zip(few.column(0).to_pylist(), few.column(3).to_pylist(), few.column(4).to_pylist())):
                    for a, b in sides:
                        if len(left) >= a and len(right) >= b:
                            keys.append(xxhash.xxh3_64_intdigest(left[:a] + right[:b], (own ^ a * 0x9E3779B97F4A7C15) & 2**64 - 1))
                            rows.append(i)
                            lefts.append(a)
                at = pa.array(np.array(rows, dtype=np.int64))
                yield pa.RecordBatch.from_arrays([_signed(keys), few.column(1).take(at), few.column(2).take(at), pa.array(lefts, pa.int64())],
                                                 ["key", "doc", "spot", "left"])

    return contexts.select(*_CONTEXTS.names).mapInArrow(work, _schema(key=_L, doc=_L, spot=_L, left=_L))


def _hot(contexts: DataFrame, length: int, range_limit: int) -> DataFrame:
    """Stretches of suffixes in crowded ranges, which never meet in one task.

    Keys that leave a small part of the length open cut a range into smaller ones, which get trees.  What is
    still crowded is counted by keys of the whole length, with map-side combining.
    """
    span, hot = int(length * SPAN_SHARE), contexts
    keyed = durable(_keys(hot, span, CUTS).select("key", "doc", "spot"), "keys")
    sizes = durable(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("members")).filter("members > 1"), "sizes")
    sized = durable(keyed.join(sizes, "key"), "cut")
    bytes_ = hot.select("doc", "spot", "left", "right")
    small = sized.filter(F.col("members") <= range_limit).join(bytes_, ["doc", "spot"])
    found = _tree(small.select(F.col("key").alias("own"), "doc", "spot", "left", "right"), length)
    crowded = sized.filter(F.col("members") > range_limit).select("doc", "spot").distinct()
    if crowded.limit(1).count() == 0:
        return found
    whole = _keys(hot.join(crowded, ["doc", "spot"], "left_semi"), span, None)
    twice = durable(whole.groupBy("key").agg(F.count(F.lit(1)).alias("members")).filter("members > 1").select("key"), "twice")
    reach = whole.join(twice, "key").groupBy("doc", "spot").agg(F.max("left").alias("before"), F.min("left").alias("least"))
    return found.unionByName(reach.select(*_extent(F.col("spot"), F.col("before"), F.lit(length) - F.col("least"))))


def repeat_extents(texts: DataFrame, length: int = LENGTH, range_limit: int = RANGE_LIMIT) -> DataFrame:
    """(doc, more, from, to): stretches of the keyed texts that lie in strings of `length` bytes which occur elsewhere."""
    if not 2 * GRAM <= length <= _SIDE:
        raise ValueError(f"length is between {2 * GRAM} and {_SIDE} bytes")
    rows = durable(_suffixes(texts, length), "suffixes")
    # counts are written before a join: beside a plain exchange on both sides Spark splits a crowded `own`
    counts = durable(rows.groupBy("own").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("own"), "shared")
    repeated = durable(rows.join(counts, "own"), "repeated")
    classes = durable(repeated.groupBy("own", "ctx").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("doc", "spot")).alias("rep")), "classes")
    before, after = F.shiftright("spot", 10).bitwiseAND(F.lit(_SIDE)), F.col("spot").bitwiseAND(F.lit(_SIDE))
    twice = classes.filter("n > 1").select("own", "ctx")
    found = repeated.filter(before + after >= length).join(twice, ["own", "ctx"]).select(*_extent(F.col("spot"), before, after))
    ranges = durable(classes.groupBy("own").agg(F.count(F.lit(1)).alias("members")).filter("members > 1"), "ranges")
    wanted = classes.join(ranges, "own").select("own", "rep.doc", "rep.spot", (F.col("members") > range_limit).alias("crowded"))
    # written, so that the texts cross the network once for both kinds of ranges
    contexts = durable(_contexts(texts, wanted, length), "contexts")
    found = found.unionByName(_tree(contexts.filter(~F.col("crowded")), length))
    large = contexts.filter("crowded").drop("crowded")
    if large.limit(1).count():
        found = found.unionByName(_hot(large, length, range_limit))
    return found


def _merged(spans: list[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


_RESULT = T.StructType([T.StructField("spans", T.ArrayType(T.StructType([T.StructField("from", T.LongType()), T.StructField("to", T.LongType())]))),
                        T.StructField("kept", T.BinaryType())])


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
                range_limit: int = RANGE_LIMIT, keep_bytes: bool = True) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans, kept): every text without the bytes covered by repeats.

    A repeat is a string of `length` bytes that also starts anywhere else, in another text or the same;
    matches never cross texts and may overlap.  Texts are UTF-8 bytes; a cut may fall inside a character,
    so `kept` is binary.  Null is read as empty; texts shorter than `length` stay whole; repeated rows are
    copies of each other, so their long texts go; an empty table gives no rows.  Other columns play no part.
    """
    texts = keyed_texts(docs, id_col, text_col)
    found = repeat_extents(texts.select("doc", "more", "text"), length, range_limit)
    spots = found.groupBy("doc", "more").agg(F.collect_set(F.struct("from", "to")).alias("spots"))
    rows = _packed(texts).join(spots, ["doc", "more"], "left").select("id", "packed", "spots")
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()),
                           T.StructField("n_spans", T.LongType()), T.StructField("kept_sha256", T.StringType()), *_RESULT.fields[: 2 if keep_bytes else 1]])

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        out, open_ = [], zstandard.ZstdDecompressor()
        for doc, packed, spots in zip(*(batch.column(i).to_pylist() for i in range(3))):
            text = open_.decompress(packed)
            spans = _merged([(s["from"], s["to"]) for s in spots or ()])
            edges = [0, *(x for s in spans for x in s), len(text)]
            kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))
            out.append({"doc_id": doc, "n_bytes": len(text), "n_removed": len(text) - len(kept), "n_spans": len(spans),
                        "kept_sha256": hashlib.sha256(kept).hexdigest(), "spans": [{"from": a, "to": b} for a, b in spans], "kept": kept})
        return pa.RecordBatch.from_pylist(out, schema=arrow)

    span = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))
    arrow = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()),
                       ("kept_sha256", pa.string()), ("spans", span), ("kept", pa.binary())][: 7 if keep_bytes else 6])
    return map_slices(rows, work, schema, "packed", 1 << 20)
