"""Language identification with segmentation-marginalised unigrams."""

from __future__ import annotations

import re
import uuid
from array import array
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.llm.common import column_of, map_slices, slices
from tabloom.llm.pieces import TOGETHER, WINDOW, PieceTable, load_pieces, vocabulary_path, word_groups

#: A letter run; digits, marks and punctuation say little about a language.
_LETTERS = re.compile(r"[^\W\d_]+")
#: A longer run of letters is cut where no piece spans, which leaves its sums as they are; what is still longer is
#: summed alone, in logarithms.
LONGEST = 48
#: Added to every expected count, so that no piece is impossible in a language.
SMOOTH = 0.05
#: Probability of a character that no piece spells.
UNKNOWN = 1e-7
UNDECIDED = "und"


def words_of(text: str, table: PieceTable) -> list[str]:
    found = _LETTERS.findall(text.lower())
    if max(map(len, found), default=0) <= LONGEST:
        return found
    return [x for w in found for x in (table.parts(w) if len(w) > LONGEST else [w])]


class Words:
    """Numbers the distinct words of texts in the order they are met."""

    def __init__(self, table: PieceTable) -> None:
        self.table = table
        self.number: dict[str, int] = {}

    def read(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The number of each word in reading order, and the words of each text."""
        add, number = self.number.setdefault, self.number
        order = array("i")
        counts = np.zeros(len(texts), dtype=np.int64)
        for i, t in enumerate(texts):
            if t:
                words = words_of(t, self.table)
                counts[i] = len(words)
                order.extend([add(w, len(number)) for w in words])
        return np.frombuffer(order, dtype=np.int32) if order else np.zeros(0, dtype=np.int32), counts

    def after(self, first: int) -> list[str]:
        return list(islice(self.number, first, None))

    def drop(self, words: list[str]) -> None:
        for w in words:
            del self.number[w]


#: Numbers (distinct words times languages) that a task counts before it works them out, and that a worker
#: remembers as scores.
HELD = 1_600_000


def _sum(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Both tables added; the first may have fewer rows and columns."""
    b[: a.shape[0], : a.shape[1]] += a
    return b



def _spelled(table: PieceTable, chars: np.ndarray) -> tuple[list[list[tuple[int, np.ndarray]]], int]:
    """For words of equal length, per end position: (length, piece number or -1) of the substrings that end there."""
    n = chars.shape[1]
    prefix = table.prefixes(chars)
    out = []
    for end in range(1, n + 1):
        here = []
        for length in range(1, min(end, table.longest) + 1):
            found = table.probe(prefix, end - length, end)
            if (found >= 0).any() or length == 1:
                here.append((length, found))
        out.append(here)
    return out, n


def _hits(table: PieceTable, word: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(end, length, piece number or -1) of all steps through one word, by end; a character that is no piece is a step."""
    n, prefix = len(word), table.word_prefixes(word)
    found = [table.hits(prefix, low, min(n, low + WINDOW)) for low in range(0, n, WINDOW)]
    end, length, piece = (np.concatenate(x) for x in zip(*found))
    bare = np.setdiff1d(np.arange(1, n + 1), end[length == 1])
    end, length = np.append(end, bare), np.append(length, np.ones(len(bare), dtype=np.int64))
    order = np.argsort(end, kind="stable")
    return end[order], length[order], np.append(piece, np.full(len(bare), -1))[order]


def _log_sums(n: int, end: np.ndarray, length: np.ndarray, logs: np.ndarray) -> np.ndarray:
    """Per place of one word, the logarithm of the sum over all ways to it; `logs` has a row per step, ordered by end."""
    out = np.zeros((n + 1, logs.shape[1]))
    start = np.searchsorted(end, np.arange(n + 2)).tolist()
    back = end - length
    for at in range(1, n + 1):
        a, b = start[at], start[at + 1]
        ways = out[back[a:b]] + logs[a:b]
        top = ways.max(axis=0)
        out[at] = top + np.log(np.exp(ways - top).sum(axis=0))
    return out


def _expected_long(table: PieceTable, word: str, p0: float, unknown: float) -> tuple[np.ndarray, np.ndarray]:
    """(piece, expected uses) in one long word, every piece of probability `p0`."""
    n = len(word)
    end, length, piece = _hits(table, word)
    logs = np.where(piece >= 0, np.log(p0), np.log(unknown))[:, None]
    forward = _log_sums(n, end, length, logs)[:, 0]
    turned = np.argsort(n - (end - length), kind="stable")  # the same steps, walked from the other end
    backward = _log_sums(n, n - (end - length)[turned], length[turned], logs[turned])[::-1, 0]
    share = np.exp(forward[end - length] + logs[:, 0] + backward[end] - forward[n])
    return piece[piece >= 0], share[piece >= 0]


def _long_words(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Places of the words that advance together, and of those that are summed alone."""
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    return np.flatnonzero(sizes <= LONGEST), np.flatnonzero(sizes > LONGEST)


def expected_counts(table: PieceTable, words: list[str], weights: np.ndarray) -> np.ndarray:
    """Expected uses of each piece over all segmentations, every piece equally likely; columns follow `weights`.

    One forward and one backward pass give each piece's posterior at each place, which is what one round
    of expectation maximisation from a uniform start collects.
    """
    # a factor per character leaves posteriors as they are and keeps products of 48 steps within a double
    p0 = 1.0 / len(table.pieces)
    lift = 30.0
    total = np.zeros((len(table.pieces), weights.shape[1]))
    short, long = _long_words(words)
    for i in long.tolist():
        piece, share = _expected_long(table, words[i], p0, 1e-3 * p0)
        for lang in np.flatnonzero(weights[i]).tolist():
            total[:, lang] += np.bincount(piece, share * weights[i, lang], len(table.pieces))
    for rows, chars in word_groups([words[i] for i in short.tolist()]):
        rows = short[rows]
        spelled, n = _spelled(table, chars)
        w = len(rows)
        forward, backward = np.zeros((n + 1, w)), np.zeros((n + 1, w))
        forward[0], backward[n] = 1.0, 1.0
        step = lambda length, found: np.where(found >= 0, p0, 1e-3 * p0 if length == 1 else 0.0) * lift**length
        probs = [[step(length, found) for length, found in here] for here in spelled]
        for end in range(1, n + 1):
            for (length, _), p in zip(spelled[end - 1], probs[end - 1]):
                forward[end] += forward[end - length] * p
        for end in range(n, 0, -1):
            for (length, _), p in zip(spelled[end - 1], probs[end - 1]):
                backward[end - length] += backward[end] * p
        for end in range(1, n + 1):
            for (length, found), p in zip(spelled[end - 1], probs[end - 1]):
                hit = np.flatnonzero(found >= 0)
                if len(hit):
                    share = forward[end - length, hit] * p[hit] * backward[end, hit] / forward[n, hit]
                    of = weights[rows[hit]]
                    for lang in range(weights.shape[1]):
                        used = np.flatnonzero(of[:, lang])
                        if len(used):
                            total[:, lang] += np.bincount(found[hit[used]], share[used] * of[used, lang], len(table.pieces))
    return total


def log_likelihoods(table: PieceTable, probs: np.ndarray, words: list[str]) -> np.ndarray:
    """Log probability of each word in each language: the forward algorithm sums over all segmentations."""
    out = np.zeros((len(words), probs.shape[1]))
    short, long = _long_words(words)
    for i in long.tolist():
        end, length, piece = _hits(table, words[i])
        few = max(1, HELD // len(end))  # languages at once, so that the table of steps is bounded
        for k in range(0, probs.shape[1], few):
            logs = np.log(np.maximum(np.where(piece[:, None] >= 0, probs[piece, k: k + few], UNKNOWN), 1e-300))
            out[i, k: k + few] = _log_sums(len(words[i]), end, length, logs)[-1]
    for rows, chars in word_groups([words[i] for i in short.tolist()], TOGETHER * 4 // max(4, probs.shape[1])):
        rows = short[rows]
        spelled, n = _spelled(table, chars)
        forward = np.zeros((n + 1, len(rows), probs.shape[1]))
        forward[0] = 1.0
        scale = np.zeros(len(rows))
        for end in range(1, n + 1):
            for length, found in spelled[end - 1]:
                hit = np.flatnonzero(found >= 0)
                if len(hit):
                    forward[end, hit] += forward[end - length, hit] * probs[found[hit]]
                if length == 1 and len(hit) < len(rows):
                    miss = np.flatnonzero(found < 0)
                    forward[end, miss] += forward[end - 1, miss] * UNKNOWN
            if end % 16 == 0:  # every live row is scaled alike, so ratios hold
                top = forward[max(0, end - table.longest): end + 1].max(axis=(0, 2))
                forward[max(0, end - table.longest): end + 1] /= top[None, :, None]
                scale += np.log(top)
        out[rows] = np.log(np.maximum(forward[n], 1e-300)) + scale[:, None]
    return out


class Model:
    """Piece probabilities per language, and the language priors."""

    def __init__(self, langs: list[str], probs: np.ndarray, prior: np.ndarray) -> None:
        self.langs, self.probs, self.prior = langs, probs, prior

        self._words, self._scores = None, np.zeros((0, len(langs)))

    def predict(self, table: PieceTable, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and posterior of each text; `und` and 0 without a letter or without a learned language."""
        known = len(self._scores)
        self._words = self._words or Words(table)
        order, counts = self._words.read(texts)
        best, score = [UNDECIDED] * len(texts), np.zeros(len(texts))
        if not len(order) or not self.langs:
            return best, score
        new = self._words.after(known)
        each = np.concatenate([self._scores, log_likelihoods(table, self.probs, new)])
        if each.size <= HELD:
            self._scores = each
        else:  # words met late are mostly rare
            self._words.drop(new)
        of = np.repeat(np.arange(len(texts)), counts)
        total = np.stack([np.bincount(of, each[order, k], len(texts)) for k in range(len(self.langs))], axis=1)
        total += np.log(self.prior)
        total -= total.max(axis=1, keepdims=True)
        posterior = np.exp(total) / np.exp(total).sum(axis=1, keepdims=True)
        for i in np.flatnonzero(counts):
            k = int(posterior[i].argmax())  # a tie goes to the first language in alphabetical order
            best[i], score[i] = self.langs[k], posterior[i, k]
        return best, score


_LAST: list[tuple[str, Model]] = []


def _remembered(parts: tuple) -> Model:
    """The model of a broadcast, kept by the worker with the words it has scored."""
    if not _LAST or _LAST[0][0] != parts[3]:
        _LAST[:] = [(parts[3], Model(*parts[:3]))]
    return _LAST[0][1]


#: More languages than this are not learned from one table: the model would outgrow what is sent to the executors.
MOST_LANGS = 400


def fit(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", vocabulary: str | None = None,
        smooth: float = SMOOTH) -> Model:
    """Learn from all rows with a language.  Rows without letters or text add nothing.

    Expected piece counts are summed per language over all rows; what reaches the driver is at most
    languages x vocabulary numbers.  No labelled row: a model without languages.
    """
    path = vocabulary or vocabulary_path()
    labelled = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))

    def count(batches):
        table = load_pieces(path)
        words, names, rows, weights = Words(table), {}, {}, np.zeros((0, 0), dtype=np.float32)

        def work_out():
            """Expected counts of all words held, and the rows read, per language."""
            total = np.zeros((len(table.pieces), len(names)))
            if words.number:
                total = expected_counts(table, words.after(0), weights)
            piece, lang = np.nonzero(total)
            listed = list(names)
            return pa.RecordBatch.from_arrays([
                pa.array([listed[k] for k in lang.tolist()] + listed),
                pa.array(np.append(piece, np.full(len(listed), -1)).astype(np.int32)),
                pa.array(np.append(total[piece, lang], [float(rows[x]) for x in listed]))], ["lang", "piece", "n"])

        for batch in slices(batches, "text", 8 << 20):
            langs = batch.column(0).to_pylist()
            order, counts = words.read(batch.column(1).to_pylist())
            for x in langs:
                names.setdefault(x, len(names))
                rows[x] = rows.get(x, 0) + 1
            of = np.repeat(np.array([names[x] for x in langs], dtype=np.int64), counts)
            held = np.bincount(order * np.int64(len(names)) + of, minlength=len(words.number) * len(names)).astype(np.float32)
            weights = _sum(weights, held.reshape(-1, len(names)))
            if weights.size > HELD:
                yield work_out()
                words, names, rows, weights = Words(table), {}, {}, np.zeros((0, 0), dtype=np.float32)
        if rows:
            yield work_out()

    sums = labelled.mapInArrow(count, "lang string, piece int, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n"))
    # a whole language per row: pieces are int, so the driver gets flat arrays
    rows = sums.groupBy("lang").agg(F.collect_list("piece").alias("p"), F.collect_list("n").alias("n")).limit(MOST_LANGS + 1).collect()
    if len(rows) > MOST_LANGS:
        raise ValueError(f"more than {MOST_LANGS} languages")
    rows.sort(key=lambda r: r["lang"])
    size = len(load_pieces(path).pieces)
    probs, prior = np.full((size, len(rows)), smooth), np.ones(len(rows))
    for k, r in enumerate(rows):
        piece, n = np.array(r["p"]), np.array(r["n"])
        prior[k] = n[piece < 0].sum()
        probs[piece[piece >= 0], k] += n[piece >= 0]
    probs /= probs.sum(axis=0, keepdims=True) if len(rows) else 1.0
    return Model([r["lang"] for r in rows], probs, prior / prior.sum() if len(rows) else prior)


def predict(docs: DataFrame, model: Model, text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """The documents with `lang_pred` and `score`, which replace columns of these names.

    A null text, an empty one or one without a letter is `und` with score 0; repeated rows stay repeated.
    Only the text is read; whole texts count, in slices of bounded size.
    """
    path = vocabulary or vocabulary_path()
    rest = docs.drop("lang_pred", "score")
    shared = docs.sparkSession.sparkContext.broadcast((model.langs, model.probs, model.prior, uuid.uuid4().hex))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = column_of(batch, "row.__text").to_pylist()
        best, score = _remembered(shared.value).predict(load_pieces(path), texts)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(best, pa.string()), pa.array(score)], ["row", "lang_pred", "score"])

    names = [F.col(f"`{c}`").alias("__text" if c == text_col else c) for c in rest.columns]
    rows = rest.select(F.struct(*names).alias("row"))
    schema = T.StructType([rows.schema["row"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    made = map_slices(rows, work, schema, "row.__text")
    return made.select(*[F.col(f"row.`{'__text' if c == text_col else c}`").alias(c) for c in rest.columns], "lang_pred", "score")


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from: the checksum of the id as text, modulo four, is two."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def identify(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every document, learned from those that are not held out.

    A null id is never held out.
    """
    out = F.coalesce(held_out(F.col("doc_id")), F.lit(False))
    model = fit(docs.filter(~out).select("lang", "text"), vocabulary=vocabulary)
    rows = docs.select("doc_id", out.alias("held_out"), "text")
    return predict(rows, model, vocabulary=vocabulary).select("doc_id", "held_out", "lang_pred", "score")


def keep_identified(docs: DataFrame, min_score: float = 0.5, vocabulary: str | None = None) -> DataFrame:
    """The documents whose text has a language; those without letters, or below `min_score`, go."""
    out = F.coalesce(held_out(F.col("doc_id")), F.lit(False))
    model = fit(docs.filter(~out).select("lang", "text"), vocabulary=vocabulary)
    # columns of the predictions' own names wait under others
    clash = {c: f"__{c}" for c in ("lang_pred", "score") if c in docs.columns}
    judged = predict(docs.withColumnsRenamed(clash), model, vocabulary=vocabulary)
    kept = judged.filter((F.col("lang_pred") != UNDECIDED) & (F.col("score") >= min_score))
    return kept.select(*[F.col(f"`{clash.get(c, c)}`").alias(c) for c in docs.columns])
