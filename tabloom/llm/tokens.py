"""Token ids of a corpus as compressed binary files, in the order of the documents' ids."""

from __future__ import annotations

import itertools
import os
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.llm.common import slices
from tabloom.llm.rans import pack_file, unpack_file
from tabloom.session import scratch_path

END = 2
#: Tokens of a file, which share a frequency table, and of a block.  Both end with a whole document.
FILE_TOKENS = 8 << 20
BLOCK_TOKENS = 1 << 20
#: Distinct words a worker remembers; later ones are encoded anew for each slice of text.
REMEMBERED = 800_000

_IRREGULAR = re.compile(r"\s ")
_CUT = re.compile(r"(?<=\S) ")


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


class WordEncoder:
    """Ids of whole texts, with every distinct word encoded once by the library.

    The byte-level splitter never joins a character to a space after it, so a text may be cut before each
    space that follows something other than white space; the parts are encoded on their own.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one thread per task
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        n = self._tokenizer.get_vocab_size()
        # byte-level tokens are spelled with one character per byte
        self._bytes = np.array([len(self._tokenizer.id_to_token(i) or "") for i in range(n)], dtype=np.int64)
        self._number: dict[object, int] = {}
        self._ids = np.zeros(0, dtype=np.uint32)
        self._begin = self._sizes = np.zeros(0, dtype=np.int64)

    def _library(self, texts: list[str]) -> np.ndarray:
        """Ids of the texts end to end, and how many each has."""
        found = [e.ids for e in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        return np.fromiter(itertools.chain.from_iterable(found), dtype=np.uint32, count=int(sizes.sum())), sizes

    def _learn(self, new: list[object]) -> None:
        """Encode words not met before: those after a space in long runs, the rest one by one.

        Bytes per token tell where a run's words end.
        """
        joined = [isinstance(w, str) and w != "" and not w[0].isspace() and not w[-1].isspace() for w in new]
        run = np.flatnonzero(joined)
        alone = np.flatnonzero(~np.array(joined, dtype=bool))
        words = [" " + new[k] for k in run.tolist()]
        texts = ["".join(words[i: i + 256]) for i in range(0, len(words), 256)]
        ids, _ = self._library(texts)
        if all(map(str.isascii, texts)):
            ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)))
        else:
            ends = np.cumsum(np.fromiter((len(w.encode("utf-8")) for w in words), dtype=np.int64, count=len(words)))
        at = np.cumsum(self._bytes[ids])
        cuts = np.searchsorted(at, ends) + 1
        if not np.array_equal(at[cuts - 1], ends):
            raise ValueError("a token crosses a word boundary")
        rest, counts = self._library([" " + w if isinstance(w, str) else w[0] for w in (new[k] for k in alone.tolist())])
        sizes, begin = np.zeros(len(new), dtype=np.int64), np.zeros(len(new), dtype=np.int64)
        sizes[run], sizes[alone] = np.diff(cuts, prepend=0), counts
        begin[run], begin[alone] = cuts - sizes[run], len(ids) + np.cumsum(counts) - counts
        self._begin = np.concatenate([self._begin, begin + len(self._ids)])
        self._sizes = np.concatenate([self._sizes, sizes])
        self._ids = np.concatenate([self._ids, ids, rest])

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end, and the number of ids of each text; null is empty."""
        number = self._number
        before, kept = len(number), len(self._ids)
        add = number.setdefault
        order: list[int] = []
        n_words = np.zeros(len(texts), dtype=np.int64)
        for i, text in enumerate(texts):
            if not text:
                continue
            words = _CUT.split(text) if _IRREGULAR.search(text) else text.split(" ")
            n_words[i] = len(words)
            words[0] = (words[0],)  # the first word has no space before it
            order.extend([add(w, len(number)) for w in words])
        new = list(itertools.islice(number, before, None))
        if new:
            self._learn(new)
        place = np.array(order, dtype=np.int64)
        n, begin = self._sizes[place], self._begin[place]
        ids = self._ids[np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin, n)]
        ends = np.concatenate(([0], np.cumsum(n)))
        stops = np.cumsum(n_words)
        if len(number) > REMEMBERED:
            for w in new:
                del number[w]
            self._ids, self._begin, self._sizes = self._ids[:kept], self._begin[:before], self._sizes[:before]
        return ids, ends[stops] - ends[stops - n_words]


@lru_cache(maxsize=1)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


_FILE = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("file", T.IntegerType()), T.StructField("tokens", T.LongType()),
                      T.StructField("image", T.BinaryType())])


def write_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None,
                 end: int = END, file_tokens: int = FILE_TOKENS, block_tokens: int = BLOCK_TOKENS, slice_bytes: int = 2 << 20) -> None:
    """Encode every text, add the end id, and write file images in ascending id order.

    Documents are dealt by ranges of ids; a row of the written table is one file image, so Spark's writer
    commits it once however often a task is tried.  A file ends with the slice of text that fills it.  Rows of equal ids stand in the order of their texts;
    a null id comes first, and a null text is an empty one.  A file's frequency table counts all of its ids.
    """
    where = vocabulary or vocabulary_path()
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    # a hash of the text spreads the rows of one id over several ranges
    dealt = rows.withColumn("tie", F.xxhash64("text")).repartitionByRange("id", "tie").sortWithinPartitions("id", "tie", "text")

    def work(batches):
        part, file = TaskContext.get().partitionId(), 0
        held: list[tuple[list, np.ndarray, np.ndarray]] = []

        def image():
            names = [d for x in held for d in x[0]]
            sizes, ids = np.concatenate([x[1] for x in held]), np.concatenate([x[2] for x in held])
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([file], pa.int32()), pa.array([len(ids)], pa.int64()),
                                               pa.array([pack_file(ids, names, sizes, block_tokens)], pa.binary())], _FILE.names)

        for batch in slices(batches, "text", slice_bytes):
            ids, counts = encoder(where).encode(batch.column(1).to_pylist())
            ids = np.insert(ids, np.cumsum(counts), end)
            held.append((batch.column(0).to_pylist(), counts + 1, ids))
            if sum(len(x[2]) for x in held) >= file_tokens:
                yield image()
                held, file = [], file + 1
        if held:
            yield image()

    dealt.drop("tie").mapInArrow(work, _FILE).write.mode("overwrite").parquet(path)


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of every document in the files.

    `start` counts the ids of all documents before it: totals per file add up within a range of ids, and
    totals per range over all ranges.
    """
    files = spark.read.schema(_FILE).parquet(path)
    fields = [T.StructField(n, t) for n, t in (("part", T.IntegerType()), ("file", T.IntegerType()), ("doc_id", T.LongType()),
              ("inside", T.LongType()), ("n_tokens", T.LongType()), ("ids_crc32", T.LongType()), ("ids", T.ArrayType(T.LongType())))]
    schema = T.StructType(fields if with_ids else fields[:-1])

    def work(batches):
        for batch in batches:
            for part, file, image in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                before = 0
                for docs, sizes, ids in unpack_file(image.as_py()):
                    raw = memoryview(np.ascontiguousarray(ids, dtype="<u4")).cast("B")
                    ends = np.cumsum(sizes, dtype=np.int64)
                    starts = ends - sizes
                    crc = [zlib.crc32(raw[4 * a: 4 * b]) for a, b in zip(starts.tolist(), ends.tolist())]
                    n = len(docs)
                    cols = [pa.array([part] * n, pa.int32()), pa.array([file] * n, pa.int32()), pa.array(docs, pa.int64()),
                            pa.array(starts + before), pa.array(sizes.astype(np.int64)), pa.array(crc, pa.int64())]
                    if with_ids:
                        cols.append(pa.ListArray.from_arrays(pa.array(np.append(starts, ends[-1:]).astype(np.int32)), pa.array(ids.astype(np.int64))))
                    yield pa.RecordBatch.from_arrays(cols, schema.names)
                    before += len(ids)

    docs = files.select("part", "file", "image").mapInArrow(work, schema)
    by_part = files.groupBy("part").agg(F.sum("tokens").alias("all"))
    # one row per range of ids: as many as the writing job had tasks
    parts = by_part.select("part", (F.sum("all").over(Window.orderBy("part")) - F.col("all")).alias("before_part"))
    each = files.select("part", "file", (F.sum("tokens").over(Window.partitionBy("part").orderBy("file")) - F.col("tokens")).alias("before_file"))
    offsets = each.join(parts, "part")
    return docs.join(offsets, ["part", "file"]).select(
        "doc_id", (F.col("inside") + F.col("before_file") + F.col("before_part")).alias("start"), "n_tokens", "ids_crc32",
        *(["ids"] if with_ids else []))


def encode_corpus(docs: DataFrame, path: str | None = None, **kw) -> DataFrame:
    """Write the token files and return what reading them back gives."""
    spark = docs.sparkSession
    path = path or scratch_path(spark, "tokens")
    write_tokens(docs, path, **kw)
    return read_tokens(spark, path)
