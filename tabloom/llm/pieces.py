"""SentencePiece encoding and decoding with a batched Viterbi search."""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.llm.common import column_of, map_slices

SPACE = "▁"
#: Base of a rolling hash of 64 bits.  Code points are mixed first, so that all bits of a key count.
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Lowest bit of a key's first 20 bits, which mark whether any piece has them.
_TOP = 44
#: What a byte piece costs beside the worst piece: spelling in bytes is the last resort.
BYTE_PENALTY = 10.0


def vocabulary_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


class PieceTable:
    """Sorted hash keys of the pieces of a vocabulary, probed by whole arrays."""

    def __init__(self, pieces: list[str], scores: np.ndarray) -> None:
        self.pieces, self.scores = pieces, np.asarray(scores, dtype=np.float64)
        self.longest = max(map(len, pieces), default=1)
        self._powers = _BASE ** np.arange(self.longest + 1, dtype=np.uint64)
        keys = np.zeros(len(pieces), dtype=np.uint64)
        for rows, chars in word_groups(pieces):
            prefix = self.prefixes(chars)
            keys[rows] = self._key(prefix, 0, chars.shape[1])
        self._order = np.argsort(keys, kind="stable")
        self._sorted = keys[self._order]
        self._maybe = np.zeros(1 << (64 - _TOP), dtype=bool)
        self._maybe[keys >> np.uint64(_TOP)] = True
        if (self._sorted[1:] == self._sorted[:-1]).any():
            raise ValueError("two pieces share a hash key")

    def prefixes(self, chars: np.ndarray) -> np.ndarray:
        """Rolling hashes of all prefixes, one row per prefix length."""
        mixed = (chars + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(31)
        mixed *= np.uint64(0x94D049BB133111EB)
        h = np.zeros((chars.shape[1] + 1, chars.shape[0]), dtype=np.uint64)
        for i in range(chars.shape[1]):
            h[i + 1] = h[i] * _BASE + mixed[:, i]
        return h

    def _key(self, prefix: np.ndarray, start: int, end: int) -> np.ndarray:
        return prefix[end] - prefix[start] * self._powers[end - start]

    def probe(self, prefix: np.ndarray, start: int, end: int) -> np.ndarray:
        """The piece that each word spells between two positions, or -1."""
        which, piece = self.find(self._key(prefix, start, end))
        out = np.full(prefix.shape[1], -1)
        out[which] = piece
        return out

    def spelled(self, prefix: np.ndarray, start: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        """(word, piece) of the words that spell a piece between two positions."""
        return self.find(self._key(prefix, start, end))

    def find(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, piece) of the keys that are a piece's; keys whose first bits no piece has are not searched for."""
        ask = np.flatnonzero(self._maybe[key >> np.uint64(_TOP)])
        key = key[ask]
        at = np.searchsorted(self._sorted, key)
        at[at == len(self._sorted)] = 0
        same = self._sorted[at] == key if len(ask) else np.zeros(0, dtype=bool)
        return ask[same], self._order[at[same]]

    def hits(self, prefix: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(end, length, piece) of every piece of one word that ends after `low` and up to `high`, in this order."""
        ends, lengths, found = [], [], []
        for length in range(1, min(high, self.longest) + 1):
            end = np.arange(max(low + 1, length), high + 1)
            # prefixes of one word: the ends stand in place of the words that advance together
            key = prefix[end, 0] - prefix[end - length, 0] * self._powers[length]
            hit, piece = self.find(key)
            ends.append(end[hit])
            lengths.append(np.full(len(hit), length))
            found.append(piece)
        end, length, piece = np.concatenate(ends), np.concatenate(lengths), np.concatenate(found)
        order = np.lexsort((length, end))
        return end[order], length[order], piece[order]

    def word_prefixes(self, word: str) -> np.ndarray:
        """Rolling hashes of the prefixes of one word."""
        return self.prefixes(np.frombuffer(word.encode("utf-32-le", "surrogatepass"), dtype="<u4").reshape(1, -1).astype(np.uint64))

    def parts(self, word: str) -> list[str]:
        """The word cut at every place that no piece spans; every segmentation passes through these cuts."""
        n, prefix = len(word), self.word_prefixes(word)
        spans = np.zeros(n + 1, dtype=np.int64)
        for low in range(0, n, WINDOW):
            end, length, _ = self.hits(prefix, low, min(n, low + WINDOW))
            np.add.at(spans, end - length + 1, 1)
            np.add.at(spans, end, -1)
        cuts = [0, *(np.flatnonzero(np.cumsum(spans)[1:n] == 0) + 1).tolist(), n]
        return [word[a:b] for a, b in zip(cuts, cuts[1:])]


#: Words of one length that advance together; bounds the arrays of a step.
TOGETHER = 1 << 16


def word_groups(words: list[str], together: int = TOGETHER) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, code points) of words of equal length, at most `together` of eight characters at once."""
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    order = np.argsort(sizes, kind="stable")
    cuts = np.flatnonzero(np.diff(sizes[order])) + 1
    for rows in np.split(order, cuts):
        n = int(sizes[rows[0]]) if len(rows) else 0
        if not n:
            continue
        most = max(1, together * 8 // max(n, 8))
        for at in range(0, len(rows), most):
            few = rows[at: at + most]
            raw = "".join([words[i] for i in few.tolist()]).encode("utf-32-le", "surrogatepass")
            yield few, np.frombuffer(raw, dtype="<u4").reshape(len(few), n).astype(np.uint64)


#: A longer word is cut where no piece spans; a part that is still longer is searched alone.
LONGEST_WORD = 256
#: Distinct words a worker remembers; later ones are encoded anew for each slice of text.
REMEMBERED = 800_000
#: Positions of a long word whose pieces are looked up at once.
WINDOW = 1 << 15


def _in_order(ids: np.ndarray, counts: np.ndarray, order: list[int], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the words that `order` numbers, end to end, and their number in each run of `sizes` words."""
    begin = np.cumsum(counts) - counts
    at = np.array(order, dtype=np.int64)
    n = counts[at]
    out = ids[np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin[at], n)]
    ends = np.concatenate(([0], np.cumsum(n)))
    stops = np.cumsum(sizes)
    return out, ends[stops] - ends[stops - sizes]


class Codec:
    """The pieces of a SentencePiece model with byte fallback: text to ids and back."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        pieces = [model.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        self.size = n
        self.byte_id = np.zeros(256, dtype=np.int32)
        for i in range(n):
            if model.is_byte(i):
                self.byte_id[int(pieces[i][1:-1], 16)] = i
        self.ids = np.array(plain, dtype=np.int32)
        self.table = PieceTable([pieces[i] for i in plain], np.array([model.get_score(i) for i in plain]))
        if any(SPACE in p.lstrip(SPACE) for p in self.table.pieces):
            raise ValueError("a piece spans two words")
        self._unknown = float(self.table.scores[self.table.scores > -1e8].min()) - BYTE_PENALTY
        self._number: dict[str, int] = {}
        self._known, self._counts = np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int64)
        #: bytes of every id, for decoding; control and unknown ids spell nothing
        self._spelling = [b""] * n
        for b, i in enumerate(self.byte_id.tolist()):
            self._spelling[i] = bytes([b])
        for i in plain:
            self._spelling[i] = pieces[i].replace(SPACE, " ").encode("utf-8", "surrogatepass")

    def parts(self, word: str) -> list[str]:
        """The word cut at every place that no piece spans: its best segmentation is that of the parts."""
        return self.table.parts(word)

    def _encode_long(self, word: str) -> list[int]:
        """The ids of one long word: the same search, position by position over the pieces that end there."""
        n, prefix, scores = len(word), self.table.word_prefixes(word), self.table.scores
        best, back, used = array("d", bytes(8 * (n + 1))), array("i", bytes(4 * (n + 1))), array("i", bytes(4 * (n + 1)))
        for low in range(0, n, WINDOW):
            high = min(n, low + WINDOW)
            ends, lengths, found = self.table.hits(prefix, low, high)
            values = scores[found].tolist()
            ends, lengths, found = ends.tolist(), lengths.tolist(), found.tolist()
            k, m = 0, len(ends)
            for end in range(low + 1, high + 1):
                top, size, piece = best[end - 1] + self._unknown, 1, -1
                while k < m and ends[k] == end:
                    score = best[end - lengths[k]] + values[k]
                    if score >= top or lengths[k] == 1:
                        top, size, piece = score, lengths[k], found[k]
                    k += 1
                best[end], back[end], used[end] = top, size, piece
        ids, at = [], n
        while at:
            if used[at] >= 0:
                ids.append(int(self.ids[used[at]]))
            else:
                ids += self.byte_id[list(word[at - 1].encode("utf-8", "surrogatepass"))][::-1].tolist()
            at -= back[at]
        return ids[::-1]

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words end to end, and the number of ids of each word."""
        if max(map(len, words), default=0) <= LONGEST_WORD:
            return self._encode_parts(words)
        number: dict[str, int] = {}
        order: list[int] = []
        n_parts = np.zeros(len(words), dtype=np.int64)
        for i, w in enumerate(words):
            parts = self.parts(w) if len(w) > LONGEST_WORD else [w]
            n_parts[i] = len(parts)
            order.extend([number.setdefault(x, len(number)) for x in parts])
        return _in_order(*self._encode_parts(list(number)), order, n_parts)

    def _encode_parts(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """`encode_words` of words or of parts of them.

        Words of equal length advance together.  At each end position the best score over all pieces that
        end there is a maximum over arrays, and the winning piece's length is the backpointer; of equal
        scores the longer piece wins.
        """
        table = self.table
        counts = np.zeros(len(words), dtype=np.int64)
        found_words, found_ids = [], []
        short = np.array([i for i, w in enumerate(words) if len(w) <= LONGEST_WORD], dtype=np.int64)
        for i, w in enumerate(words):
            if len(w) > LONGEST_WORD:
                ids = np.array(self._encode_long(w), dtype=np.int32)
                found_words.append(np.full(len(ids), i))
                found_ids.append((np.arange(len(ids)), ids))
        for rows, chars in word_groups([words[i] for i in short.tolist()]):
            rows = short[rows]
            w, n = chars.shape
            prefix = table.prefixes(chars)
            best = np.full((n + 1, w), -np.inf)
            best[0] = 0.0
            back = np.zeros((n + 1, w), dtype=np.int32)
            used = np.full((n + 1, w), -1, dtype=np.int32)
            for end in range(1, n + 1):
                # one character is always a way, in bytes if no piece spells it
                best[end], back[end] = best[end - 1] + self._unknown, 1
                for length in range(1, min(end, table.longest) + 1):
                    which, piece = table.spelled(prefix, end - length, end)
                    score = best[end - length, which] + table.scores[piece]
                    if length > 1:
                        better = score >= best[end, which]
                        which, piece, score = which[better], piece[better], score[better]
                    best[end, which], back[end, which], used[end, which] = score, length, piece
            # walk all words back at once; ids come out in reverse order
            at, live = np.full(w, n), np.arange(w)
            word_parts, id_parts, step = [], [], []
            k = 0
            while len(live):
                end = at[live]
                piece = used[end, live]
                spelled = piece >= 0
                if spelled.any():
                    word_parts.append(live[spelled])
                    id_parts.append(self.ids[piece[spelled]])
                    step.append(np.full(int(spelled.sum()), k))
                if not spelled.all():
                    which = np.flatnonzero(~spelled)
                    for j in which.tolist():
                        raw = chr(int(chars[live[j], end[j] - 1])).encode("utf-8", "surrogatepass")
                        word_parts.append(np.full(len(raw), live[j]))
                        id_parts.append(self.byte_id[list(raw)][::-1])
                        step.append(k + np.arange(len(raw)) / 8)
                at[live] = end - back[end, live]
                live = live[at[live] > 0]
                k += 1
            word, ids, order = np.concatenate(word_parts), np.concatenate(id_parts), np.concatenate(step)
            found_words.append(rows[word])
            found_ids.append((-order, ids))
        if not found_words:
            return np.zeros(0, dtype=np.int32), counts
        word = np.concatenate(found_words)
        step = np.concatenate([x for x, _ in found_ids])
        ids = np.concatenate([x for _, x in found_ids])
        counts = np.bincount(word, minlength=len(words))
        return ids[np.lexsort((step, word))], counts

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end, and the number of ids of each text.

        Words met before are remembered with their ids, up to `REMEMBERED` of them.
        """
        number, before, kept = self._number, len(self._number), len(self._known)
        add = number.setdefault
        order = array("i")
        n_words = np.zeros(len(texts), dtype=np.int64)
        for i, t in enumerate(texts):
            if t:
                words = split_words(t)
                n_words[i] = len(words)
                order.extend([add(w, len(number)) for w in words])
        new = list(islice(number, before, None))
        if new:
            ids, counts = self.encode_words(new)
            self._known = np.concatenate([self._known, ids])
            self._counts = np.concatenate([self._counts, counts])
        out = _in_order(self._known, self._counts, order, n_words)
        if len(number) > REMEMBERED:  # words met late are mostly rare
            for w in new:
                del number[w]
            self._known, self._counts = self._known[:kept], self._counts[:before]
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text that ids spell, without the space put before its first word."""
        spell = self._spelling
        raw = b"".join([spell[i] for i in ids.tolist()])
        return raw[1:].decode("utf-8", "surrogatepass") if raw.startswith(b" ") else raw.decode("utf-8", "surrogatepass")


def split_words(text: str) -> list[str]:
    """The words of a text after a space is put before it; each keeps the run of spaces before it.

    No piece spans from a word into the next space, so words are encoded on their own.
    """
    marked = (" " + text).replace(" ", SPACE)
    if SPACE * 2 not in marked and not marked.endswith(SPACE):
        words = [SPACE + w for w in marked.split(SPACE)[1:]]
    else:
        words, start, n = [], 0, len(marked)
        for k in range(1, n):
            if marked[k] == SPACE and marked[k - 1] != SPACE:
                words.append(marked[start:k])
                start = k
        words.append(marked[start:])
    return words


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def load_pieces(path: str) -> PieceTable:
    return codec(path).table


def encode_table(docs: DataFrame, text_col: str = "text", vocabulary: str | None = None, check: bool = True) -> DataFrame:
    """The documents with `ids` and `n_ids`, which replace columns of these names, and `round_trip`.

    Null and empty texts have no ids; every other text gets a space before it, as the public model asks.
    `round_trip` says that decoding the ids gives the text back (a lower one eighth block in a text is
    read as a space, as in the public library); `check` off leaves it out.  Repeated rows stay repeated.
    """
    path = vocabulary or vocabulary_path()
    rest = docs.drop("ids", "n_ids", "round_trip")
    rows = rest.select(F.struct(*[F.col(f"`{c}`").alias("__text" if c == text_col else c) for c in rest.columns]).alias("row"))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = codec(path)
        texts = column_of(batch, "row.__text").to_pylist()
        ids, counts = c.encode(texts)
        ends = np.concatenate(([0], np.cumsum(counts)))
        out = [batch.column(0), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids, pa.int32())), pa.array(counts)]
        if check:
            same = [c.decode(ids[a:b]) == (t or "").replace(SPACE, " ") for t, a, b in zip(texts, ends.tolist(), ends[1:].tolist())]
            out.append(pa.array(same))
        return pa.RecordBatch.from_arrays(out, ["row", "ids", "n_ids", "round_trip"][: len(out)])

    schema = T.StructType([rows.schema["row"], T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_ids", T.LongType()),
                           *([T.StructField("round_trip", T.BooleanType())] if check else [])])
    made = map_slices(rows, work, schema, "row.__text", 4 << 20)
    return made.select(*[F.col(f"row.`{'__text' if c == text_col else c}`").alias(c) for c in rest.columns], *[c for c in ("ids", "n_ids", "round_trip") if c in made.columns])


def decode_table(rows: DataFrame, ids_col: str = "ids", vocabulary: str | None = None) -> DataFrame:
    """(row columns, decoded): the text that an array of ids spells; null stays null."""
    path = vocabulary or vocabulary_path()

    @F.pandas_udf("string")
    def spell(ids):
        c = codec(path)
        return ids.map(lambda x: None if x is None else c.decode(np.asarray(x)))

    return rows.withColumn("decoded", spell(F.col(f"`{ids_col}`")))
