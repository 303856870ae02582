"""Phrases whose words keep together, counted by prefix-free parsing.

Texts are cut into chunks where they say so themselves: a chunk ends with a pair of words whose hash has a given
remainder, and the next one begins with the same pair.  Equal passages are therefore cut alike wherever they stand,
and a dictionary of distinct chunks with their frequencies stands for the corpus.  Phrases are counted inside distinct
chunks, weighted by frequency.  A phrase belongs to the chunk in which it begins, the shared pair to the later chunk,
so that overlaps count once.

Counting goes by length: a phrase is frequent only if the two phrases without its first and its last word are, so
longer ones are formed only where these are marked in a bitmap of hashes.  The bitmap's size is bounded; a mark too
many costs a counted phrase that is dropped later, never a result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.llm.common import binary_views, column_of, slices
from tabloom.session import scratch_path

#: The longest phrase in words; chunks share one word less.
WORDS = 3
SHARED = WORDS - 1
#: A candidate occurs this often.
MIN_COUNT = 10
#: A candidate inside a longer one goes if the longer one has this part of its occurrences, in percent.
PART = 50
#: Rows returned per language.
TOP = 2000
#: One of so many word pairs ends a chunk.
ONE_IN = 32
#: A chunk has about so many words at most, so runs without a trigger do not become one row.
LONGEST_CHUNK = 512
#: Bytes of text that a task works on at a time; longer texts are parsed in parts that end at a break.
SLICE = 4 << 20
#: Bounds of the bitmaps of frequent phrases, in powers of two; and bits per frequent phrase between them.
FEWEST_BITS, MOST_BITS, BITS_EACH = 20, 26, 16
#: Parts of a language that are ranked apart before the language is.
RANK_PARTS = 64

# what a byte is: 0 part of a word, 1 blank, 2 a break that no phrase crosses
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2
_KINDS = _KIND.tobytes()
_LOWER = bytes(range(256)).lower()
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _word_hashes(words: pa.Array) -> np.ndarray:
    """A hash of each word of an array of large binaries without empty ones; equal words have equal hashes everywhere."""
    if not len(words):
        return np.zeros(0, np.uint64)
    _, offsets, data = words.buffers()
    at = np.frombuffer(offsets, np.int64)[words.offset: words.offset + len(words) + 1]
    sizes = np.diff(at)
    raw = np.frombuffer(data, np.uint8)[at[0]: at[-1]].astype(np.uint64) + np.uint64(1)
    powers = np.cumprod(np.full(sizes.max(), _MIX))
    h = np.add.reduceat(raw * powers[np.arange(len(raw)) - np.repeat(at[:-1] - at[0], sizes)], at[:-1] - at[0])
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


@dataclass
class Words:
    """The words of several texts in one buffer of lower-cased bytes."""

    data: bytes
    starts: np.ndarray  # first byte of each word
    ends: np.ndarray
    text: np.ndarray  # the text of each word
    joined: np.ndarray  # whether the next word stands in the same piece; false for the last word
    ids: np.ndarray  # into `vocabulary`
    vocabulary: pa.Array
    hashes: np.ndarray  # of the vocabulary

    @classmethod
    def of(cls, texts: list) -> Words:
        # a break before, between and after the texts ends words and pieces there
        data = b"".join([b"\n", b"\n".join(texts), b"\n"]).translate(_LOWER)
        kind = np.frombuffer(data.translate(_KINDS), np.uint8)
        inside = kind == 0
        edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        starts, ends = edges[::2], edges[1::2]
        bounds = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
        upto = np.searchsorted(starts, bounds)
        text = np.repeat(np.arange(len(texts)), np.diff(upto, prepend=0))
        # most words are one byte apart, and that byte tells
        joined = kind[ends] == 1
        wide = np.flatnonzero(starts[1:] - ends[:-1] > 1)
        if len(wide):
            breaks = np.flatnonzero(kind == 2)
            joined[wide] = np.searchsorted(breaks, starts[wide + 1]) == np.searchsorted(breaks, ends[wide])
        joined[-1:] = False
        offsets = np.append(0, np.cumsum(ends - starts, dtype=np.int64))
        letters = np.frombuffer(data, np.uint8)[inside]
        coded = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(letters)])
        coded = coded.dictionary_encode()
        return cls(data, starts, ends, text, joined, coded.indices.to_numpy().astype(np.int64), coded.dictionary, _word_hashes(coded.dictionary))


def chunk_bounds(words: Words, one_in: int = ONE_IN, longest: int = LONGEST_CHUNK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, end word, whether it ends its text) of each chunk; chunks of one text share SHARED words."""
    n = len(words.ids)
    fresh = np.ones(n, bool)
    fresh[1:] = words.text[1:] != words.text[:-1]
    begin = np.flatnonzero(fresh)
    stop = np.append(begin[1:], n)
    h = words.hashes[words.ids]
    cut = fresh.copy()
    # a pair that begins a text cuts nothing, one that ends it leaves a chunk of the pair alone
    cut[:-1] |= ((h[:-1] * _MIX + h[1:]) >> np.uint64(16)) % np.uint64(one_in) == 0
    cut[stop[stop > 0] - 1] = fresh[stop[stop > 0] - 1]
    first = np.flatnonzero(cut)
    ends = np.append(first[1:], n)
    long = np.flatnonzero(ends - first > longest)
    if len(long):
        more = np.concatenate([np.arange(first[i] + longest, ends[i], longest) for i in long])
        more = more[more + SHARED <= stop[np.searchsorted(begin, more, side="right") - 1]]
        first = np.union1d(first, more)
    last = np.append(words.text[first[1:]] != words.text[first[:-1]], True) if len(first) else np.zeros(0, bool)
    end = np.append(first[1:] + SHARED, n) if len(first) else first
    end[last] = stop[np.searchsorted(begin, first[last], side="right") - 1] if len(first) else end[last]
    return first, end, last


def _parts(text: bytes, most: int) -> Iterator[bytes]:
    """A long text in parts that end at a break, which no phrase crosses; a stretch without one stays whole."""
    breaks = [bytes([b]) for b in np.flatnonzero(_KIND == 2)]
    while len(text) > most:
        at = max(text.rfind(c, 0, most) for c in breaks)
        if at < 0:
            at = min((x for x in (text.find(c, most) for c in breaks) if x >= 0), default=-1)
        if at < 0:
            break
        yield text[: at + 1]
        text = text[at + 1:]
    yield text


_CHUNK = pa.schema([("lang", pa.string()), ("chunk", pa.binary()), ("last", pa.bool_()), ("n", pa.int64())])
_PHRASE = pa.schema([("lang", pa.string()), ("words", pa.int32()), ("phrase", pa.binary()), ("n", pa.int64())])


def _parse(one_in: int, longest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__text", SLICE):
            langs = column_of(batch, "__lang").to_pylist()
            pieces = [(lang, part) for lang, view in zip(langs, binary_views(column_of(batch, "__text")))
                      for part in (_parts(bytes(view), SLICE) if view is not None else ())]
            words = Words.of([p for _, p in pieces])
            first, end, last = chunk_bounds(words, one_in, longest)
            if not len(first):
                continue
            langs = [pieces[t][0] for t in words.text[first].tolist()]
            # equal chunks of a slice are one row, so that frequent ones need no sums before they are dealt
            found = Counter(zip(langs, (words.data[a:b] for a, b in zip(words.starts[first].tolist(), words.ends[end - 1].tolist())),
                                last.tolist()))
            yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(zip(*found), _CHUNK.types)), pa.array(found.values(), pa.int64())],
                                             schema=_CHUNK)

    return run


def _marked(bitmap: np.ndarray | None, hashes: np.ndarray) -> np.ndarray:
    if bitmap is None:
        return np.ones(len(hashes), bool)
    bit = hashes >> np.uint64(64 - int(np.log2(len(bitmap) * 64)))
    return (bitmap[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63)) & np.uint64(1)).astype(bool)


def _phrase_hash(*words: np.ndarray) -> np.ndarray:
    """The hash of phrases from the hashes of their words, which carry their language."""
    h = words[0].copy()
    for w in words[1:]:
        h = (h ^ (h >> np.uint64(29))) * _MIX + w
    return (h ^ (h >> np.uint64(32))) * _MIX


def _lang_hashes(langs: list) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(x, 1) for x in langs), np.uint64, len(langs))


def _sums(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of one row of each key, sum of its weights)."""
    order = np.argsort(keys)
    edges = np.flatnonzero(np.append(True, keys[order][1:] != keys[order][:-1])) if len(keys) else order
    return order[edges], np.add.reduceat(weights[order], edges) if len(keys) else weights


def _gathered(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= most:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _count(k: int, bitmap):
    """Counts of the phrases of k words whose parts of k - 1 words are marked; for single words also all words, as phrase of none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = bitmap.value if bitmap is not None else None
        for table in _gathered(batches, SLICE):
            batch = table.combine_chunks().to_batches()[0] if len(table) else None
            if batch is None:
                continue
            words = Words.of([bytes(v) for v in binary_views(column_of(batch, "chunk"))])
            n = len(words.ids)
            lang = column_of(batch, "lang").dictionary_encode()
            lang_of = lang.indices.to_numpy().astype(np.int64)[words.text]
            hashes = words.hashes[words.ids] ^ _lang_hashes(lang.dictionary.to_pylist())[lang_of]
            weight = column_of(batch, "n").to_numpy().astype(np.int64)[words.text]
            # a phrase counts where it begins, but not in the pair shared with the next chunk
            per = np.bincount(words.text, minlength=len(batch))
            nth = np.arange(n) - (np.cumsum(per) - per)[words.text]
            ends = column_of(batch, "last").to_numpy(zero_copy_only=False)[words.text]
            begins = ends | (nth < per[words.text] - SHARED)
            span = n - k + 1
            if span <= 0:
                continue
            ok = begins[:span].copy()
            for j in range(k - 1):
                ok &= words.joined[j: j + span]
            if k > 1:
                part = _marked(marks, _phrase_hash(*[hashes[j: n - k + 2 + j] for j in range(k - 1)]))
                ok &= part[:-1] & part[1:]
            at = np.flatnonzero(ok)
            key, most = lang_of[at], len(lang.dictionary)
            for j in range(k):
                if most * len(words.vocabulary) >= 1 << 63:  # numbers that are too large are replaced by their ranks
                    key, most = np.unique(key, return_inverse=True)[1], len(key)
                key, most = key * len(words.vocabulary) + words.ids[at + j], most * len(words.vocabulary)
            one, total = _sums(key, weight[at])
            texts = [words.vocabulary.take(pa.array(words.ids[at[one] + j])) for j in range(k)]
            phrase = pc.binary_join_element_wise(*texts, pa.scalar(b" ", pa.large_binary())) if k > 1 else texts[0]
            langs, counts, size = lang.dictionary.take(pa.array(lang_of[at[one]])), pa.array(total), np.full(len(one), k, np.int32)
            phrase = phrase.cast(pa.binary())
            if k == 1:
                some, whole = _sums(lang_of[at], weight[at])
                langs = pa.concat_arrays([langs, lang.dictionary.take(pa.array(lang_of[at[some]]))])
                phrase = pa.concat_arrays([phrase, pa.array([b""] * len(some), pa.binary())])
                counts, size = pa.concat_arrays([counts, pa.array(whole)]), np.append(size, np.zeros(len(some), np.int32))
            yield pa.RecordBatch.from_arrays([langs, pa.array(size, pa.int32()), phrase, counts], schema=_PHRASE)

    return run


def _kept(df: DataFrame, label: str) -> DataFrame:
    """A table in the shared folder, packed tighter than by default: the dictionary is as long as the corpus."""
    path = scratch_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dictionary(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", one_in: int = ONE_IN,
               longest: int = LONGEST_CHUNK) -> DataFrame:
    """(lang, chunk, last, n): the distinct chunks of each language with their frequencies in the parse.

    Chunks keep the bytes between their words.  A null language is `und`; null and blank texts have no chunk.
    """
    plain = docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("__lang"),
                        F.col(f"`{text_col}`").cast("string").alias("__text"))
    parsed = plain.mapInArrow(_parse(one_in, longest), "lang string, chunk binary, last boolean, n long")
    return _summed(parsed, ["lang", "chunk", "last"])


def _summed(counted: DataFrame, by: list[str]) -> DataFrame:
    """The sums of n, dealt before they are added: most keys come once in a task, so sums in its memory would only fill it.

    Tasks add up what they read a slice at a time, so a key has at most one row per slice, however frequent it is.
    """
    return counted.repartition(*by).groupBy(*by).agg(F.sum("n").alias("n"))


def phrase_counts(chunk_table: DataFrame, k: int, shorter: DataFrame | None = None) -> DataFrame:
    """(lang, words, phrase, n): all contiguous occurrences of the phrases of k words.

    With the frequent phrases of k - 1 words, phrases that cannot be frequent are left out, though not all of them.
    The rows of single words come with one row of no words per language, which counts all words.
    """
    marks = None if shorter is None or k == 1 else chunk_table.sparkSession.sparkContext.broadcast(_bitmap(shorter, k - 1))
    counted = chunk_table.mapInArrow(_count(k, marks), "lang string, words int, phrase binary, n long")
    by = ["lang", "words", "phrase"]
    return _summed(counted, by) if k > 1 else counted.groupBy(*by).agg(F.sum("n").alias("n"))  # words come again and again in a task


def _bitmap(frequent: DataFrame, k: int) -> np.ndarray:
    """The marks of the frequent phrases of k words: 2^MOST_BITS bits at most, whatever their number."""
    frequent = frequent.filter(F.col("words") == k)
    bits = int(np.clip(np.ceil(np.log2(BITS_EACH * max(1, frequent.count()))), FEWEST_BITS, MOST_BITS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = _lang_hashes(column_of(batch, "lang").to_pylist())
            split = [bytes(v).split(b" ") for v in binary_views(column_of(batch, "phrase"))]
            words = [_word_hashes(pa.array([p[j] for p in split], pa.large_binary())) ^ langs for j in range(k)]
            bit = (_phrase_hash(*words) >> np.uint64(64 - bits)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(bit)], names=["bit"])

    set_ = frequent.select("lang", "phrase").mapInArrow(run, "bit long").groupBy(F.shiftright("bit", 6).alias("at")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("marks")).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[set_["at"].to_numpy()] = set_["marks"].to_numpy().astype(np.int64).view(np.uint64)
    return out


def _cut_score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 a a / (l r)) in decimals: exact while a is below 10^16."""
    big = [c.cast("decimal(16,0)") for c in (a, left, right)]
    square = big[0] * big[0] * F.lit(1_000_000).cast("decimal(7,0)")
    return F.call_function("div", square, big[1] * big[2])


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", min_count: int = MIN_COUNT, top: int = TOP,
                 one_in: int = ONE_IN, longest: int = LONGEST_CHUNK) -> DataFrame:
    """The best phrases of each language: lang, rank, phrase, a, l, r, n, score; see the contract of the query.

    Everything is counted over all rows.  A phrase has `min_count` occurrences only if all its parts have, so the
    tables that meet in joins hold frequent phrases only.  An empty table, or one without frequent phrases, has no row.
    """
    parsed = _kept(dictionary(docs, text_col, lang_col, one_in, longest), "chunks")
    levels = []
    for k in range(1, WORDS + 1):
        counts = phrase_counts(parsed, k, levels[-1] if levels else None)
        levels.append(_kept(counts.filter((F.col("n") >= min_count) | (F.col("words") == 0)), f"phrases-{k}"))
    totals = levels[0].filter("words = 0").select("lang", F.col("n").alias("total"))
    often = levels[0].filter("words = 1")
    for more in levels[1:]:
        often = often.unionByName(more)
    often = often.withColumn("phrase", F.col("phrase").cast("string"))
    phrases = often.filter("words > 1").select("lang", "words", "phrase", F.col("n").alias("a"), F.split("phrase", " ").alias("w"))

    # every cut of a candidate, met with the counts of its two parts
    cuts = phrases.select("*", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k")).select(
        "lang", "words", "phrase", "a", "k", F.array_join(F.slice("w", 1, F.col("k")), " ").alias("left"),
        F.array_join(F.slice("w", F.col("k") + 1, F.col("words") - F.col("k")), " ").alias("right"))
    for side, count in (("left", "l"), ("right", "r")):
        part = often.select("lang", F.col("phrase").alias(side), F.col("n").alias(count))
        cuts = cuts.join(part, ["lang", side])
    cuts = cuts.withColumn("score", _cut_score(F.col("a"), F.col("l"), F.col("r")))
    scored = cuts.groupBy("lang", "words", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("low"))

    inside = phrases.filter("words > 2").select(
        "lang", F.explode(F.array(*[F.array_join(F.slice("w", i, WORDS - 1), " ") for i in (1, 2)])).alias("phrase"),
        F.col("a").alias("longer")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    left = scored.join(inside, ["lang", "phrase"], "left").filter(
        F.coalesce(100 * F.col("longer") < PART * F.col("a"), F.lit(True)))
    return _ranked(left.select("lang", "phrase", "a", "low.l", "low.r", "low.score"), top).join(totals, "lang").select(
        "lang", "rank", "phrase", "a", "l", "r", F.col("total").alias("n"), "score")


def _ranked(scored: DataFrame, top: int) -> DataFrame:
    """The first `top` rows of each language; parts of a language are ranked first, so none is ordered in one task."""
    best = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    part = F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS))
    few = scored.withColumn("_part", part).withColumn("_nth", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*best)))
    few = few.filter(F.col("_nth") <= top)
    return few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")).filter(F.col("rank") <= top)


#: Phrases from the words of each piece by their places; the lower-casing names A-Z only.
SQL = f"""
WITH pieces AS (
  SELECT doc, coalesce(lang, 'und') AS lang, piece, nth FROM (
    SELECT doc, lang, unnest(p) AS piece, generate_subscripts(p, 1) AS nth FROM (
      SELECT row_number() OVER () AS doc, lang,
        regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
          '[.,;:!?\\x0A-\\x0D]') AS p FROM documents))),
w AS (
  SELECT lang, unnest(ws) AS w1, doc, nth, generate_subscripts(ws, 1) AS pos FROM (
    SELECT lang, doc, nth, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws FROM pieces)),
g AS (
  SELECT lang, w1, lead(w1) OVER o AS w2, lead(w1, 2) OVER o AS w3 FROM w WINDOW o AS (PARTITION BY doc, nth ORDER BY pos)),
uni AS (SELECT lang, w1, count(*) AS f FROM g GROUP BY 1, 2),
bi AS (SELECT lang, w1, w2, count(*) AS f FROM g WHERE w2 IS NOT NULL GROUP BY 1, 2, 3),
tri AS (SELECT lang, w1, w2, w3, count(*) AS f FROM g WHERE w3 IS NOT NULL GROUP BY 1, 2, 3, 4 HAVING count(*) >= {MIN_COUNT}),
totals AS (SELECT lang, count(*) AS n FROM w GROUP BY 1),
cuts AS (
  SELECT bi.lang, bi.w1 || ' ' || bi.w2 AS phrase, bi.f AS a, 1 AS k, x.f AS l, y.f AS r
  FROM bi JOIN uni x ON x.lang = bi.lang AND x.w1 = bi.w1 JOIN uni y ON y.lang = bi.lang AND y.w1 = bi.w2 WHERE bi.f >= {MIN_COUNT}
  UNION ALL
  SELECT t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3, t.f, 1, x.f, y.f
  FROM tri t JOIN uni x ON x.lang = t.lang AND x.w1 = t.w1 JOIN bi y ON y.lang = t.lang AND y.w1 = t.w2 AND y.w2 = t.w3
  UNION ALL
  SELECT t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3, t.f, 2, x.f, y.f
  FROM tri t JOIN bi x ON x.lang = t.lang AND x.w1 = t.w1 AND x.w2 = t.w2 JOIN uni y ON y.lang = t.lang AND y.w1 = t.w3),
scored AS (
  SELECT *, (CAST(1000000 AS HUGEINT) * a * a) // (CAST(l AS HUGEINT) * r) AS score FROM cuts),
low AS (
  SELECT lang, phrase, a, l, r, score FROM scored
  QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (
  SELECT lang, phrase, max(f) AS longer FROM (
    SELECT lang, w1 || ' ' || w2 AS phrase, f FROM tri UNION ALL SELECT lang, w2 || ' ' || w3, f FROM tri) GROUP BY 1, 2),
ranked AS (
  SELECT low.*, row_number() OVER (PARTITION BY low.lang ORDER BY score DESC, a DESC, low.phrase) AS rank
  FROM low LEFT JOIN inside ON inside.lang = low.lang AND inside.phrase = low.phrase
  WHERE longer IS NULL OR 100 * longer < {PART} * a)
SELECT ranked.lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r,
  CAST(totals.n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM ranked JOIN totals ON totals.lang = ranked.lang WHERE rank <= {TOP}"""
