"""How filters overlap: what each removes at each place of every order, and its fair share of all removals.

A set of filters, a coalition, removes the documents that fail at least one of its filters.  The Hart-Mas-Colell
potential P of this game is 0 for no filter and (v(S) + sum of P(S without i)) / |S| for others, v(S) being the
documents that S removes.  The Shapley value of a filter is P(all) - P(all without it), and a step of an order
removes v(filters so far) - v(filters before).  The corpus is read once; 32 counts a part hold all there is to know.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import binary_views, column_of
from tabloom.session import durable

FILTERS = "ABCDE"
ALL = (1 << len(FILTERS)) - 1
ORDERS = factorial(len(FILTERS))
#: A fails texts of fewer words.
MIN_WORDS = 200
#: B fails texts whose distinct words are a smaller part of their words, in percent.
MIN_DISTINCT = 50
#: C fails texts with a larger part of capitals among their code points, in percent.
MAX_CAPITALS = 2
#: D fails texts that hold one of these.
SIGNS = b"#$%&*|"

_OTHERS = bytes(b for b in range(256) if b not in SIGNS)
_NO_CAPITALS = bytes(b for b in range(256) if not 65 <= b <= 90)
_CONTINUATIONS = bytes(range(0x80, 0xC0))


def text_failures(text: bytes) -> int:
    """The failures of one text by its own content: bits 0 to 3 for A to D.  An empty text fails A only."""
    words = text.split()  # of bytes: at 20 and 09-0D, as the contract has it
    fails = len(words) < MIN_WORDS
    fails |= (100 * len(set(words)) < MIN_DISTINCT * len(words)) << 1
    capitals = len(text.translate(None, _NO_CAPITALS))
    fails |= (100 * capitals > MAX_CAPITALS * len(text.translate(None, _CONTINUATIONS))) << 2
    return fails | (len(text.translate(None, _OTHERS)) > 0) << 3


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        views = [bytes(v or b"") for v in binary_views(column_of(batch, "__text"))]
        keys = pa.array([hashlib.blake2b(v, digest_size=16).digest() for v in views], pa.binary())
        fails = pa.array(np.fromiter(map(text_failures, views), np.int32, len(views)))
        yield pa.RecordBatch.from_arrays(
            [column_of(batch, "__id"), column_of(batch, "__part"), keys, fails], names=["id", "part", "key", "fails"])


def failures(docs: DataFrame, text_col: str = "text", part_col: str = "source", id_col: str = "doc_id") -> DataFrame:
    """(id, part, fails): one row per document, its part and the bits of the filters that it fails, A in bit 0.

    E fails every document whose text a document of a smaller id has too, wherever that one is.  Equal texts are found by
    128 bits.  A null text is an empty one, a null part the empty string; a row without an id is neither smaller than
    another nor larger, so it never fails E, and rows that repeat an id do not fail E for each other.
    """
    plain = docs.select(F.col(f"`{id_col}`").cast("long").alias("__id"),
                        F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("__part"),
                        F.col(f"`{text_col}`").cast("string").alias("__text"))
    judged = durable(plain.mapInArrow(_judged, "id long, part string, key binary, fails int"), "failures")
    # one row per text; joined by id and text, so copies of one text do not meet in one task
    first = judged.filter("id is not null").groupBy("key").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    late = F.col("first").isNull() & F.col("id").isNotNull()
    return judged.join(first, ["id", "key"], "left").select(
        "id", "part", F.col("fails").bitwiseOR(F.when(late, F.lit(1 << 4)).otherwise(F.lit(0))).alias("fails"))


def _members(coalition: int) -> list[int]:
    return [i for i in range(len(FILTERS)) if coalition >> i & 1]


def coalition_counts(judged: DataFrame, weights: dict[str, Column]) -> DataFrame:
    """(part, n, one array per weight): place S holds the weight of the documents that coalition S removes."""
    cells = judged.groupBy("part", "fails").agg(F.count("*").alias("n"), *[F.sum(w).alias(c) for c, w in weights.items()])

    def removed(by: str) -> Column:
        return F.array(*[F.sum(F.when(F.col("fails").bitwiseAND(F.lit(s)) != 0, F.col(by)).otherwise(F.lit(0)))
                         for s in range(ALL + 1)])

    return cells.groupBy("part").agg(F.sum("n").alias("n"), *[removed(c).alias(c) for c in weights])


def with_potentials(games: DataFrame, value: str) -> DataFrame:
    """The potentials of all coalitions as array `potential`, times the number of orders, which makes them whole numbers.

    One level of columns per size of coalition, each from the level before.
    """
    frame = games.withColumn("__p0", F.lit(0).cast("long"))
    for size in range(1, len(FILTERS) + 1):
        level = {}
        for s in (s for s in range(1, ALL + 1) if len(_members(s)) == size):
            below = sum((F.col(f"__p{s ^ 1 << i}") for i in _members(s)), F.lit(0).cast("long"))
            level[f"__p{s}"] = F.expr(f"{value}[{s}]").cast("long") * ORDERS + below
        frame = frame.withColumns({c: _divided(v, size) for c, v in level.items()})
    names = [f"__p{s}" for s in range(ALL + 1)]
    return frame.withColumn("potential", F.array(*names)).drop(*names)


def _divided(whole: Column, by: int) -> Column:
    """An exact division of whole numbers: the potentials of `by` filters times the orders have no remainder."""
    return F.call_function("div", whole, F.lit(by))


def audit(docs: DataFrame, labels: DataFrame, text_col: str = "text", part_col: str = "source", id_col: str = "doc_id",
          quality_col: str = "quality", toxic_col: str = "toxic") -> DataFrame:
    """One row per part, order of the filters and step of the order, with what the step removes.

    Columns: part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley; see the
    contract of the query.  Several labels of one id count as one that has each mark if one of them has it; a document
    without a label is neither good nor toxic.  An empty table has no part, so no row.
    """
    marks = labels.groupBy(F.col(f"`{id_col}`").cast("long").alias("id")).agg(
        F.max(F.when(F.col(f"`{quality_col}`") == 1, 1).otherwise(0)).alias("good"),
        F.max(F.when(F.col(f"`{toxic_col}`") == 1, 1).otherwise(0)).alias("toxic"))
    judged = failures(docs, text_col, part_col, id_col).join(marks, "id", "left")
    games = coalition_counts(judged, {"docs": F.lit(1), "good": F.coalesce("good", F.lit(0)), "toxic": F.coalesce("toxic", F.lit(0))})
    games = durable(with_potentials(games, "docs"), "games")

    steps = []
    for order in permutations(range(len(FILTERS))):
        before = 0
        for nth, f in enumerate(order, 1):
            steps.append(("".join(FILTERS[i] for i in order), nth, f, before, before | 1 << f))
            before |= 1 << f
    fields = "filter_order string, step int, f int, before int, after int"
    walk = F.from_json(F.lit("[" + ",".join('["%s",%d,%d,%d,%d]' % s for s in steps) + "]"), "array<array<string>>")
    rows = games.select("*", F.explode(walk).alias("w")).select(
        "*", *[F.col("w")[i].cast(t).alias(c) for i, (c, t) in enumerate(x.split() for x in fields.split(", "))])

    def at(array: str, place: str) -> Column:
        return F.expr(f"{array}[{place}]").cast("long")

    alone, others = "shiftleft(1, f)", f"{ALL} - shiftleft(1, f)"
    removed = at("docs", "after") - at("docs", "before")
    return rows.select(
        "part", "filter_order", "step", (F.col("n") - at("docs", "after")).alias("kept"), removed.alias("removed"),
        (at("docs", alone) - removed).alias("redundant"), (at("docs", str(ALL)) - at("docs", others)).alias("unique_fails"),
        (at("good", "after") - at("good", "before")).alias("good_lost"),
        (at("toxic", "after") - at("toxic", "before")).alias("toxic_lost"),
        (at("potential", str(ALL)) - at("potential", others)).alias("shapley"))


#: Each order is walked filter by filter over documents of equal failures.
SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
firsts AS (SELECT text, min(doc_id) AS first_id FROM d GROUP BY text),
marks AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
  FROM labels GROUP BY doc_id),
judged AS (
  SELECT part,
    CASE WHEN len(words) < {MIN_WORDS} THEN 'A' ELSE '' END
    || CASE WHEN 100 * len(list_distinct(words)) < {MIN_DISTINCT} * len(words) THEN 'B' ELSE '' END
    || CASE WHEN 100 * length(regexp_replace(d.text, '[^A-Z]', '', 'g')) > {MAX_CAPITALS} * length(d.text) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(d.text, '[#$%&*|]') THEN 'D' ELSE '' END
    || CASE WHEN coalesce(d.doc_id > first_id, false) THEN 'E' ELSE '' END AS fails,
    coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
  FROM d JOIN firsts ON d.text = firsts.text LEFT JOIN marks ON marks.doc_id = d.doc_id),
cells AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM judged GROUP BY 1, 2),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
walks AS (
  SELECT f AS done FROM letters
  UNION ALL SELECT done || f FROM walks, letters WHERE NOT contains(done, f)),
orders AS (SELECT done AS filter_order FROM walks WHERE length(done) = {len(FILTERS)}),
steps AS (
  SELECT filter_order, CAST(step AS INTEGER) AS step, substr(filter_order, CAST(step AS INTEGER), 1) AS f,
    substr(filter_order, 1, CAST(step AS INTEGER) - 1) AS before
  FROM orders, range(1, {len(FILTERS) + 1}) t(step)),
met AS (
  SELECT part, filter_order, step, f, n, good, toxic, contains(fails, f) AS failing, fails = f AS only_this,
    regexp_matches(fails, '[' || CASE WHEN before = '' THEN '-' ELSE before END || ']') AS gone
  FROM cells, steps),
told AS (
  SELECT part, filter_order, step, f,
    sum(CASE WHEN NOT gone AND NOT failing THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN NOT gone AND failing THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN gone AND failing THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN only_this THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN NOT gone AND failing THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN NOT gone AND failing THEN toxic ELSE 0 END) AS toxic_lost
  FROM met GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
  CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
  CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM told"""
