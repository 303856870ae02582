"""A quality classifier on raw bytes: a small convolutional network in numpy.

A text is covered whole by overlapping chunks of bytes.  Learned filters slide over each chunk, each filter's largest
answer stands for the chunk, and the mean and the largest answers over all chunks are combined into one probability.
The network is fitted on a bounded sample of labelled rows; scoring runs in Arrow batches, a block of chunks at a time,
so memory does not grow with a text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import binary_views, column_of

#: Bytes of a chunk, and from one chunk to the next: neighbours overlap by a quarter.
CHUNK = 1024
HOP = 768
#: A filter sees so many bytes and moves on by so many.
WIDTH = 8
STEP = 4
#: Numbers that stand for a byte; filters.
DEPTH = 8
FILTERS = 32
#: Stands for the place after a text's end.
PAD = 256
#: Bound of the labelled sample: rows, and bytes of their texts.
SAMPLE_ROWS = 4000
SAMPLE_BYTES = 12 << 20
#: Passes over the sample, documents per step of the optimiser, its rate, and the weight of squared parameters.
EPOCHS = 6
BATCH = 32
RATE = 4e-3
DECAY = 1e-4
#: One of so many label ids is never learned from.
FOLDS = 5
#: Scores from here on are predicted as 1.
THRESHOLD = 0.3
#: Chunks that are scored at a time.
BLOCK = 128


@dataclass
class Network:
    """Byte vectors, filters with their offsets, and the last layer over mean and largest answers."""

    bytes_: np.ndarray  # (257, DEPTH); the row of PAD stays zero
    filters: np.ndarray  # (WIDTH * DEPTH, FILTERS)
    offsets: np.ndarray  # (FILTERS,)
    out: np.ndarray  # (2 * FILTERS,)
    bias: float

    @classmethod
    def fresh(cls, seed: int = 7) -> Network:
        rng = np.random.default_rng(seed)
        table = rng.normal(0, 0.5, (PAD + 1, DEPTH)).astype(np.float32)
        table[PAD] = 0
        return cls(table, rng.normal(0, (WIDTH * DEPTH) ** -0.5, (WIDTH * DEPTH, FILTERS)).astype(np.float32),
                   np.zeros(FILTERS, np.float32), np.zeros(2 * FILTERS, np.float32), 0.0)

    def score(self, pooled: np.ndarray) -> np.ndarray:
        """Probabilities from the combined answers of each document."""
        return 1 / (1 + np.exp(-(pooled.astype(np.float64) @ self.out.astype(np.float64) + self.bias)))


def chunk_starts(n: int) -> range:
    """Where the chunks of a text of n bytes begin; the last one reaches its end, an empty text has one."""
    return range(0, max(1, n - CHUNK + HOP) if n > CHUNK else 1, HOP)


def chunk_rows(text: bytes | memoryview) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bytes of up to BLOCK chunks, their lengths): the text in blocks of chunks, padded behind its end."""
    whole = np.frombuffer(text, dtype=np.uint8)
    starts = chunk_starts(len(whole))
    for i in range(0, len(starts), BLOCK):
        part = starts[i: i + BLOCK]
        rows = np.full((len(part), CHUNK), PAD, np.int16)
        sizes = np.empty(len(part), np.int64)
        for r, at in enumerate(part):
            piece = whole[at: at + CHUNK]
            rows[r, : len(piece)] = piece
            sizes[r] = len(piece)
        yield rows, sizes


def windows(net: Network, rows: np.ndarray) -> np.ndarray:
    """What each filter place sees: (chunks, places, WIDTH * DEPTH), a view of the byte vectors."""
    table = net.bytes_[rows].reshape(len(rows), CHUNK * DEPTH)
    return np.lib.stride_tricks.sliding_window_view(table, WIDTH * DEPTH, axis=1)[:, :: STEP * DEPTH]


def answers(net: Network, rows: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(largest answer, its place) per chunk and filter; places behind the text's end never answer."""
    seen = windows(net, rows)
    raw = (np.ascontiguousarray(seen).reshape(-1, WIDTH * DEPTH) @ net.filters).reshape(len(rows), seen.shape[1], FILTERS)
    raw += net.offsets
    np.maximum(raw, 0, out=raw)
    raw[np.arange(seen.shape[1]) * STEP >= sizes[:, None]] = 0
    place = raw.argmax(axis=1)
    return np.take_along_axis(raw, place[:, None], axis=1)[:, 0], place


def pooled_texts(net: Network, texts: list) -> np.ndarray:
    """Mean and largest answers over all chunks of each text: (texts, 2 * FILTERS).

    Chunks of consecutive short texts share a block, a long text fills blocks of its own.
    """
    total = np.zeros((len(texts), FILTERS))
    most = np.zeros((len(texts), FILTERS), np.float32)
    chunks = np.zeros(len(texts))
    rows, sizes, owner = [], [], []

    def flush() -> None:
        if not rows:
            return
        got, _ = answers(net, np.concatenate(rows), np.concatenate(sizes))
        own = np.concatenate(owner)
        np.add.at(total, own, got)
        np.maximum.at(most, own, got)
        rows.clear(), sizes.clear(), owner.clear()

    held = 0
    for i, text in enumerate(texts):
        for block, lengths in chunk_rows(text):
            chunks[i] += len(block)
            rows.append(block), sizes.append(lengths), owner.append(np.full(len(block), i))
            held += len(block)
            if held >= BLOCK:
                flush()
                held = 0
    flush()
    return np.concatenate([(total / np.maximum(chunks, 1)[:, None]).astype(np.float32), most], axis=1)


def _gradients(net: Network, texts: list[bytes], y: np.ndarray) -> list[np.ndarray]:
    """Gradients of the mean log loss of a batch of texts, in the order of the network's fields."""
    blocks = [(i, rows, sizes) for i, text in enumerate(texts) for rows, sizes in chunk_rows(text)]
    own = np.concatenate([np.full(len(rows), i) for i, rows, _ in blocks])
    rows = np.concatenate([rows for _, rows, _ in blocks])
    sizes = np.concatenate([sizes for _, _, sizes in blocks])
    got, place = map(np.concatenate, zip(*(answers(net, rows[i: i + BLOCK], sizes[i: i + BLOCK]) for i in range(0, len(rows), BLOCK))))
    n = np.bincount(own, minlength=len(texts))
    first = np.concatenate([[0], np.cumsum(n)[:-1]])
    mean = np.add.reduceat(got, first, axis=0) / n[:, None]
    most = np.maximum.reduceat(got, first, axis=0)
    pooled = np.concatenate([mean, most], axis=1).astype(np.float32)
    slope = ((net.score(pooled) - y) / len(texts)).astype(np.float32)
    back = slope[:, None] * net.out[None]
    grad = back[own, :FILTERS] / n[own, None]
    # the largest answer of a document comes from the first chunk that has it
    at = np.full((len(texts), FILTERS), len(own))
    holds = got == most[own]
    where = np.where(holds, np.arange(len(own))[:, None], len(own))
    np.minimum.at(at, own, where)
    grad[at, np.arange(FILTERS)] += back[:, FILTERS:]
    grad *= got > 0
    # only the place of the largest answer of a chunk has a slope
    places = place[:, :, None] * STEP + np.arange(WIDTH)
    seen_bytes = rows[np.arange(len(rows))[:, None, None], places]
    d_filters = np.einsum("cf,cfk->kf", grad, net.bytes_[seen_bytes].reshape(len(rows), FILTERS, WIDTH * DEPTH))
    spread = (grad[:, :, None] * net.filters.T[None]).reshape(-1, DEPTH)
    d_bytes = np.stack([np.bincount(seen_bytes.ravel(), spread[:, d], PAD + 1) for d in range(DEPTH)], axis=1).astype(np.float32)
    d_bytes[PAD] = 0
    return [d_bytes, d_filters, grad.sum(axis=0), pooled.T @ slope, np.asarray(slope.sum())]


def train(texts: list[bytes], y: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> Network:
    """The network after some passes of Adam over the sample; with labels of one kind, or none, their smoothed share."""
    net = Network.fresh(seed)
    ones = float(np.sum(y))
    share = (ones + 1) / (len(y) + 2)
    net.bias = float(np.log(share / (1 - share)))
    if not 0 < ones < len(y):
        return net
    rng = np.random.default_rng(seed)
    net.out = rng.normal(0, 0.1, 2 * FILTERS).astype(np.float32)
    params = [net.bytes_, net.filters, net.offsets, net.out, np.asarray(net.bias, np.float32)]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    steps = epochs * -(-len(texts) // BATCH)
    t = 0
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for i in range(0, len(order), BATCH):
            part = order[i: i + BATCH]
            t += 1
            rate = RATE * (1 - 0.9 * t / steps)
            for k, g in enumerate(_gradients(net, [texts[j] for j in part], y[part])):
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                params[k] = params[k] - rate * (first[k] / (1 - 0.9**t) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8) + DECAY * params[k])
            net.bytes_, net.filters, net.offsets, net.out = (p.astype(np.float32) for p in params[:4])
            net.bias = float(params[4])
    return net


def labelled_sample(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", label_col: str = "quality",
                    folds: int = FOLDS, rows: int = SAMPLE_ROWS, most_bytes: int = SAMPLE_BYTES) -> tuple[list[bytes], np.ndarray]:
    """Texts and labels of at most `rows` labelled documents and `most_bytes` bytes, the smallest by a hash of the id.

    Ids of fold 0 are left out.  Several labels of one id count as their largest; null labels and texts do not count.
    Texts are taken whole; one that does not fit into what is left of the bytes is passed over.
    """
    id_, text = F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`").cast("string")
    known = labels.select(id_.alias("id"), F.col(f"`{label_col}`").cast("int").alias("y")).filter(
        "id is not null and y is not null").filter(F.crc32(F.col("id").cast("string")) % folds != 0)
    known = known.groupBy("id").agg(F.max("y").alias("y"))
    sizes = docs.filter(text.isNotNull()).select(id_.alias("id"), F.octet_length(text).cast("long").alias("size"))
    order = [F.xxhash64("id"), "id", "size"]
    few = sizes.join(known, "id").orderBy(*order).limit(rows).collect()
    taken, left = {}, most_bytes
    for row in few:
        if row.size <= left:
            taken[row.id] = row.y
            left -= row.size
    if not taken:
        return [], np.zeros(0)
    wanted = docs.sparkSession.createDataFrame(list(taken.items()), "id long, y int")  # at most `rows` rows
    got = docs.filter(text.isNotNull()).select(id_.alias("id"), text.alias("text")).join(F.broadcast(wanted), "id")
    found, left = [], most_bytes
    for row in sorted(((r.id, r.text.encode(), r.y) for r in got.toLocalIterator()), key=lambda r: r[:2]):
        if len(row[1]) <= left:
            found.append(row)
            left -= len(row[1])
    return [r[1] for r in found], np.array([float(r[2] == 1) for r in found])


def score_table(docs: DataFrame, net: Network, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The rows, or their columns `keep`, with `score`, 0 to 1; a null text scores as an empty one.

    A column `score` that is there already is replaced.
    """
    names = [c for c in (docs.columns if keep is None else keep) if c != "score"]
    schema = docs.select(*[f"`{c}`" for c in names]).schema.add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [v if v is not None else b"" for v in binary_views(column_of(batch, "__text"))]
            scores = np.round(net.score(pooled_texts(net, texts)), 6)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores)], names=[*names, "score"])

    return docs.select(*[f"`{c}`" for c in names], F.col(f"`{text_col}`").cast("string").alias("__text")).mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", label_col: str = "quality",
             threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; labels of held-out ids are never learned.

    A row without an id is not held out.  An empty table has no row; without labels every score is one half.
    """
    net = train(*labelled_sample(docs, labels, text_col, id_col, label_col))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == 0, F.lit(False))
    return score_table(rows, net, keep=["doc_id"]).select(
        "doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
