"""Benchmark decontamination with suffix arrays over blocks of training text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import binary_views, column_of, map_slices

#: Words of a window: a shorter item is one window of its own length.
WINDOW = 10
#: Text bytes of benchmark items that go to the executors at once.  More items are searched in further
#: passes over the same rows, never cut.
ITEM_BYTES = 16 << 20

#: Bytes that separate words become spaces, A-Z becomes a-z; digits, a-z and everything beyond ASCII stay.
_WORD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORD).split()


@dataclass
class Windows:
    """The distinct windows of a block of items: sorted keys per length and, per key, where items hold it."""

    vocabulary: dict[bytes, int]
    keys: dict[int, np.ndarray]
    #: per length: first holder of each key, then the holders' text numbers and offsets
    holders: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]
    #: the names of the items that share each distinct text
    names: list[list[str]]

    @classmethod
    def build(cls, rows: list[tuple[object, bytes | None]], window: int) -> Windows:
        texts: dict[tuple[int, ...], set[str]] = {}
        vocabulary: dict[bytes, int] = {}
        for item, text in rows:
            ids = tuple(vocabulary.setdefault(w, len(vocabulary) + 1) for w in words_of(text or b""))
            named = texts.setdefault(ids, set())
            if item is not None:
                named.add(str(item))
        found: dict[int, dict[bytes, list[tuple[int, int]]]] = {}
        for number, ids in enumerate(texts):
            n, packed = min(window, len(ids)), np.array(ids, dtype=">u4").tobytes()
            for at in range(len(ids) - n + 1 if n else 0):
                found.setdefault(n, {}).setdefault(packed[4 * at: 4 * (at + n)], []).append((number, at))
        keys, holders = {}, {}
        for n, places in found.items():
            order = sorted(places)
            keys[n] = np.array(order, dtype=f"S{4 * n}")
            flat = np.array([p for k in order for p in places[k]], dtype=np.int64).reshape(-1, 2)
            holders[n] = (np.cumsum([0, *(len(places[k]) for k in order)]), flat[:, 0], flat[:, 1])
        return cls(vocabulary, keys, holders, [sorted(x) for x in texts.values()])


def locate(ids: np.ndarray, keys: dict[int, np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, places, key numbers): every occurrence of every key in a block of words.

    Only a run of words that all occur in the benchmark (ids above 0) can hold a match, so the suffix
    array covers the starts inside such runs.  Each key is found by two binary searches; the interval
    between them lists all of its places.
    """
    stops = np.flatnonzero(ids == 0)
    here = np.arange(len(ids))
    ahead = np.append(stops, len(ids))[np.searchsorted(stops, here)] - here
    for length, wanted in keys.items():
        starts = np.flatnonzero(ahead >= length)
        if not len(starts):
            continue
        grid = ids[starts[:, None] + np.arange(length)].astype(">u4")
        suffixes = grid.view(f"S{4 * length}").ravel()
        order = np.argsort(suffixes, kind="stable")
        array = suffixes[order]
        low, high = np.searchsorted(array, wanted, "left"), np.searchsorted(array, wanted, "right")
        yield length, starts[order[_ranges(low, high)]], np.repeat(np.arange(len(wanted)), high - low)


def _ranges(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """low[0]..high[0]-1, low[1]..high[1]-1 and so on."""
    n = high - low
    return np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)


def maximal(doc: np.ndarray, text: np.ndarray, at: np.ndarray, offset: np.ndarray, length: np.ndarray) -> np.ndarray:
    """(doc, place, words, text, offset) rows: hits that touch on one diagonal of a document and an item are one match."""
    if not len(at):
        return np.zeros((0, 5), dtype=np.int64)
    diagonal = at - offset
    order = np.lexsort((at, diagonal, text, doc))
    doc, text, at, offset, length, diagonal = (x[order] for x in (doc, text, at, offset, length, diagonal))
    # hits of one diagonal all have the item's window length, so ends rise with starts
    new = np.ones(len(at), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (text[1:] != text[:-1]) | (diagonal[1:] != diagonal[:-1]) | (at[1:] > at[:-1] + length[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    return np.stack([doc[first], at[first], at[last] + length[last] - at[first], text[first], offset[first]], axis=1)


_MATCH = pa.struct([("at", pa.int64()), ("words", pa.int64()), ("items", pa.list_(pa.string())), ("offset", pa.int64())])


def search_block(texts: list[memoryview | None], windows: Windows) -> tuple[np.ndarray, list[list[dict]]]:
    """Number of words and maximal matches of each text of a block."""
    get = windows.vocabulary.get
    counts = np.zeros(len(texts), dtype=np.int64)
    flat: list[int] = []
    for i, t in enumerate(texts):
        words = words_of(bytes(t)) if t is not None else []
        counts[i] = len(words)
        flat.extend([get(w, 0) for w in words])
        flat.append(0)  # matches end with a document
    ids = np.array(flat, dtype=np.uint32)
    del flat
    first = np.cumsum(counts + 1) - counts - 1
    hits = []
    for length, at, key in locate(ids, windows.keys):
        begin, number, offset = windows.holders[length]
        each = _ranges(begin[key], begin[key + 1])
        at = np.repeat(at, begin[key + 1] - begin[key])
        hits.append((np.searchsorted(first, at, side="right") - 1, number[each], at, offset[each], np.full(len(at), length)))
    matches: list[list[dict]] = [[] for _ in texts]
    if hits:
        for d, at, n, number, offset in maximal(*(np.concatenate(x) for x in zip(*hits))).tolist():
            matches[d].append({"at": at - int(first[d]), "words": n, "items": windows.names[number], "offset": offset})
    return counts, matches


def _item_blocks(bench: DataFrame, item_col: str, text_col: str, most: int) -> Iterator[list[tuple[object, bytes | None]]]:
    """Items in blocks of bounded size, streamed one partition at a time; at least one block, which may be empty."""
    held, size, none = [], 0, True
    for row in bench.select(F.col(item_col).alias("i"), F.col(text_col).cast("binary").alias("t")).distinct().toLocalIterator():
        n = len(row[1] or b"")
        if held and size + n > most:
            yield held
            held, size, none = [], 0, False
        held.append((row[0], bytes(row[1]) if row[1] is not None else None))
        size += n
    if held or none:
        yield held


def find_matches(docs: DataFrame, bench: DataFrame, window: int = WINDOW, text_col: str = "text", item_col: str = "item_id",
                 item_text: str = "text", item_bytes: int = ITEM_BYTES) -> DataFrame:
    """The documents with `n_words` and `matches`: (at, words, items, offset) of every longest verbatim match.

    Words are runs of digits, a-z (A-Z lowered) and characters beyond ASCII.  A match of a document and an
    item is a stretch covered by windows of the item: `window` words, or all words of a shorter item.  Each
    slice of 8 MB of text has a suffix array of its own, in one pass without a shuffle; items beyond
    `item_bytes` go through further passes.  Null and empty texts have no words and no matches, null items
    no windows; an item without an id hits but has no name in `items`; items of equal words share a match;
    repeated rows stay repeated.  The new columns replace columns of the same names.
    """
    out = docs.drop("n_words", "matches")
    inner = {c: "__text" if c == text_col else c for c in out.columns}
    state = out.select(F.struct(*[F.col(f"`{c}`").alias(k) for c, k in inner.items()]).alias("row"), F.lit(0).cast("long").alias("n_words"), F.array().cast(_MATCHES).alias("matches"))
    for block in _item_blocks(bench, item_col, item_text, item_bytes):
        state = _search(state, Windows.build(block, window))
    return state.select(*[F.col(f"row.`{k}`").alias(c) for c, k in inner.items()], "n_words", "matches")


_MATCHES = "array<struct<at:bigint,words:bigint,items:array<string>,offset:bigint>>"


def _search(state: DataFrame, windows: Windows) -> DataFrame:
    shared = state.sparkSession.sparkContext.broadcast(windows)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts, matches = search_block(list(binary_views(column_of(batch, "row.__text"))), shared.value)
        before = batch.column(2)
        if any(len(x) for x in before):
            matches = [a + b for a, b in zip(before.to_pylist(), matches)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts), pa.array(matches, pa.list_(_MATCH))],
                                          ["row", "n_words", "matches"])

    return map_slices(state, work, state.schema, "row.__text")


def summary(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, matches) of `find_matches`' rows."""
    # matches in order of their starts; a running end counts every hit word once
    ordered = F.array_sort(F.transform("matches", lambda m: F.struct(m["at"].alias("at"), (m["at"] + m["words"]).alias("to"))))
    start = F.struct(F.lit(0).cast("long").alias("to"), F.lit(0).cast("long").alias("n"))
    covered = F.aggregate(ordered, start, lambda acc, m: F.struct(
        F.greatest(acc["to"], m["to"]).alias("to"),
        (acc["n"] + F.greatest(m["to"] - F.greatest(acc["to"], m["at"]), F.lit(0).cast("long"))).alias("n")))["n"]
    items = F.array_sort(F.array_distinct(F.flatten(F.transform("matches", lambda m: m["items"]))))
    return found.select(
        F.col(id_col).alias("doc_id"), "n_words", covered.alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("matches") > 0).alias("contaminated"), "matches")


def drop_contaminated(docs: DataFrame, bench: DataFrame, window: int = WINDOW, **kw) -> DataFrame:
    """The documents without a match."""
    return find_matches(docs, bench, window, **kw).filter(F.size("matches") == 0).select(*[F.col(f"`{c}`") for c in docs.columns])


_WORDS = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL = f"""
WITH b AS (SELECT item_id, regexp_extract_all({_LOWER.format('text')}, '{_WORDS}') AS w FROM benchmark WHERE text IS NOT NULL),
win AS (
  SELECT DISTINCT item_id, least({WINDOW}, len(w)) AS n, array_to_string(w[s:s + least({WINDOW}, len(w)) - 1], ' ') AS key
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least({WINDOW}, len(w)) + 2)) AS s FROM b WHERE len(w) > 0)),
d AS (
  SELECT row_number() OVER () AS r, doc_id, CASE WHEN text IS NULL THEN [] ELSE regexp_extract_all({_LOWER.format('text')}, '{_WORDS}') END AS w
  FROM documents),
spots AS (
  SELECT r, p, n, array_to_string(w[p:p + n - 1], ' ') AS key
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
hits AS (SELECT r, p, spots.n, item_id FROM spots JOIN win ON spots.key = win.key AND spots.n = win.n),
covered AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS q FROM hits) GROUP BY r),
named AS (SELECT r, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS list FROM (
  SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS i FROM hits) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN named USING (r)"""
