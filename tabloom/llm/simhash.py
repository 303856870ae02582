"""SimHash near-duplicates by deletion-variant signatures."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import components, map_slices
from tabloom.session import durable

#: The three segments of a 64-bit fingerprint as (lowest bit, bits): four differing bits leave one of
#: them with at most one.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
MAX_BITS = 4

#: A signature bucket of more fingerprints than this is not joined with itself; its members go through
#: `_ball_links`, which is as exact and linear in them.  At this size both cost the same per fingerprint
#: (64 buckets of 32 partners against 2,081 values), so work stays linear however many fingerprints there are.
BUCKET_LIMIT = 64


def shingle_bits(text: bytes, words: int = 4) -> int:
    """The fingerprint of one text."""
    parts = text.lower().split()  # bytes: A-Z only, and exactly the white space of the contract
    if not parts:
        return 0
    joined = b" ".join(parts)
    hash_of = xxhash.xxh64_intdigest
    if len(parts) <= words:
        return hash_of(joined, 42)
    ends = np.cumsum(np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    view = memoryview(joined)
    first, last = starts[: len(parts) - words + 1].tolist(), ends[words - 1:].tolist()
    ones, n = np.zeros(64, dtype=np.int64), len(first)
    for at in range(0, n, 1 << 16):  # bounded memory for a very long text
        hashes = np.array([hash_of(view[s:e], 42) for s, e in zip(first[at: at + (1 << 16)], last[at: at + (1 << 16)])],
                          dtype="<u8")
        bits = np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(-1, 64)
        whole = len(bits) // 255 * 255  # sums of 255 ones still fit one byte
        if whole:
            ones += bits[:whole].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        ones += bits[whole:].sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): the 64-bit SimHash of each whole text as a signed long; null and wordless texts have 0."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [shingle_bits(t or b"", words) for t in batch.column(1).cast(pa.binary()).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(found, dtype=np.uint64).view(np.int64))], ["id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return map_slices(rows, work, "id long, fp long")


def _variants(fp: Column) -> Column:
    """All one-wildcard variants of the segments: number of the erased bit above the segment without it."""
    out = []
    for low, bits in SEGMENTS:
        part = F.shiftrightunsigned(fp, low)
        for b in range(bits):
            kept = ((1 << bits) - 1) & ~(1 << b)
            out.append((part.bitwiseAND(F.lit(kept).cast("long")) + F.lit((low + b) << 22)).cast("int"))
    return F.array(*out)


def _ball_links(hot: DataFrame, max_bits: int) -> DataFrame:
    """(a, b): exact links of crowded buckets without pairs.

    Two fingerprints differ in at most 2r bits exactly when some value lies within r bits of both.
    Every fingerprint names the values around it (2,081 for r = 2); namers of one value are chained in
    their order, which joins the same components as all their pairs.  A value has at most as many
    namers as a fingerprint has values, so no group is large.
    """
    one = [1 << i for i in range(64)]
    near = [0, *(one if max_bits >= 2 else []), *((a | b for i, a in enumerate(one) for b in one[:i]) if max_bits >= 4 else [])]
    near = np.array(near, dtype=np.uint64).view(np.int64)

    def name(batches):
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(fps), 256):
                few = fps[at: at + 256]
                z = few[:, None] ^ near[None, :]
                yield pa.RecordBatch.from_arrays([pa.array(z.ravel()), pa.array(np.repeat(few, len(near)))], ["z", "fp"])

    def chain(batches):
        last_z = last_fp = None
        for batch in batches:
            z, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            if not len(z):
                continue
            if last_z is not None:
                z, fp = np.concatenate(([last_z], z)), np.concatenate(([last_fp], fp))
            same = np.flatnonzero((z[1:] == z[:-1]) & (fp[1:] != fp[:-1]))
            last_z, last_fp = z[-1], fp[-1]
            links = np.unique(np.stack([fp[same], fp[same + 1]], axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(links[:, 0]), pa.array(links[:, 1])], ["a", "b"])

    named = hot.select("fp").mapInArrow(name, "z long, fp long")
    return named.repartition("z").sortWithinPartitions("z", "fp").mapInArrow(chain, "a long, b long").distinct()


def fingerprint_links(prints: DataFrame, max_bits: int = MAX_BITS, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """(a, b): links between distinct fingerprints with the components of all pairs within `max_bits` (0, 2 or 4).

    Equality join on segment variants with one erased bit, then the whole distance is verified.
    """
    if max_bits not in (0, 2, 4):
        raise ValueError("max_bits is 0, 2 or 4: three segments find up to four bits, and balls need an even number")
    variants = prints.select("fp", F.explode(_variants(F.col("fp"))).alias("key"))
    crowded = durable(variants.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > bucket_limit).select("key"), "crowded")
    # Spark sizes the variants like the fingerprints, which have 64 times fewer rows, and would send them all to the driver
    ordinary = variants.join(crowded, "key", "left_anti").hint("merge")
    differ = F.col("a").bitwiseXOR(F.col("b"))
    links = ordinary.withColumnRenamed("fp", "a").join(ordinary.withColumnRenamed("fp", "b"), "key").filter(
        (F.col("a") < F.col("b")) & (F.bit_count(differ) <= max_bits) & _first_meeting(differ, F.shiftright("key", 22))).select("a", "b")
    hot = variants.join(crowded, "key", "left_semi").select("fp").distinct()
    return links.unionByName(_ball_links(hot, max_bits))


def _first_meeting(differ: Column, wild: Column) -> Column:
    """Whether a pair meets under this erased bit first: in its first segment with at most one differing bit,
    under that bit, or under the segment's lowest bit where none differs.  So a pair comes out once, not once a variant."""
    bits = [F.bit_count(F.shiftrightunsigned(differ, low).bitwiseAND(F.lit((1 << n) - 1).cast("long"))) for low, n in SEGMENTS]
    out, before = F.lit(False), F.lit(True)
    for (low, n), d in zip(SEGMENTS, bits):
        here = wild.between(low, low + n - 1) & ((d == 1) | ((d == 0) & (wild == low)))
        out, before = out | (before & here), before & (d > 1)
    return out


def simhash_groups(docs: DataFrame, words: int = 4, max_bits: int = MAX_BITS, id_col: str = "doc_id",
                   text_col: str = "text", bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """(id, fp, component_id, kept) per row: documents whose fingerprints are linked share the smallest id.

    Copies collapse into one fingerprint before anything is joined.  Null and empty texts have the
    fingerprint zero and are linked like any other; a null id never becomes a component's name as long
    as the component holds another id; repeated rows stay repeated; an empty table gives no rows.
    Columns other than id and text play no part.  `kept` marks the rows with the smallest id of a
    component; repeated rows of that id are all marked.
    """
    rows = durable(fingerprints(docs, words, id_col, text_col), "prints")
    distinct = durable(rows.groupBy("fp").agg(F.min("id").alias("first")), "distinct")
    roots = components(fingerprint_links(distinct.select("fp"), max_bits, bucket_limit))
    classes = distinct.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn(
        "root", F.coalesce("root", "fp"))
    names = classes.groupBy("root").agg(F.min("first").alias("component_id"))
    named = classes.join(names, "root").select("fp", "component_id")
    return rows.join(named, "fp").select(
        "id", "fp", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def drop_near_copies(docs: DataFrame, words: int = 4, max_bits: int = MAX_BITS, id_col: str = "doc_id",
                     text_col: str = "text") -> DataFrame:
    """The documents with only the smallest id of each component; of repeated rows of that id the least row stays."""
    groups = durable(simhash_groups(docs, words, max_bits, id_col, text_col).filter("kept"), "kept")
    keep = groups.groupBy(F.col("id").alias("__keep")).agg((F.count(F.lit(1)) > 1).alias("__repeated"))
    kept = docs.join(keep, F.col(id_col).cast("long").eqNullSafe(F.col("__keep")))
    single = kept.filter(~F.col("__repeated")).select(*[F.col(f"`{c}`") for c in docs.columns])
    if groups.groupBy("id").count().filter("count > 1").limit(1).count() == 0:
        return single
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    least = kept.filter("__repeated").groupBy("__keep").agg(F.min(row).alias("__row")).select("__row.*")
    return single.unionByName(least)


def fingerprint_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
