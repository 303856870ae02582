"""Filter audit, byte network and phrases against brute force."""

from __future__ import annotations

import itertools
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from odd_rows import SCHEMA, clashing, empty, odd, odd_rows, prose, words  # noqa: F401
from pyspark.sql import functions as F

from tabloom.llm import bytenet, interactions, phrases

LABELS = "doc_id long, quality int, toxic int"


def corpus(seed: int = 3) -> list[tuple]:
    """Texts that fail every set of the five filters, in a few parts, with copies and repeated ids."""
    rng = random.Random(seed)
    vocabulary = words(rng, 900)
    rows = []
    for i in range(160):
        text = prose(rng, rng.choice([5, 150, 199, 200, 260, 600]), vocabulary if rng.random() < 0.6 else vocabulary[:90])
        if rng.random() < 0.4:
            text = text.title() if rng.random() < 0.5 else text.upper()
        if rng.random() < 0.3:
            text += rng.choice([" $", "\x0b|", " é#", "&"])
        rows.append((i * 3 % 161, text, rng.choice(["en", "de", None]), rng.choice(["a", "b", "", None]), len(text)))
    rows += [(1000 + i, rows[i % 7][1], "en", rng.choice(["a", "b", None]), 0) for i in range(60)]
    return rows + [(rows[3][0], rows[3][1], "en", "a", 0), (None, rows[0][1], "en", "b", 0), (2000, None, None, None, None), (1999, "", "en", "a", 0)]


# ---------------------------------------------------------------- filter audit

def slow_failures(rows):
    smallest = {}
    for id_, text, *_ in rows:
        if id_ is not None:
            smallest[text or ""] = min(smallest.get(text or "", id_), id_)
    out = []
    for id_, text, _, source, _ in rows:
        text = text or ""
        found = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = "A" * (len(found) < 200) + "B" * (100 * len(set(found)) < 50 * len(found))
        fails += "C" * (100 * len(re.findall("[A-Z]", text)) > 2 * len(text)) + "D" * bool(re.search("[#$%&*|]", text))
        fails += "E" * (id_ is not None and smallest[text] < id_)
        out.append((id_, source or "", fails))
    return out


def slow_audit(rows, labels):
    good, toxic = {i for i, q, _ in labels if q == 1}, {i for i, _, t in labels if t == 1}
    judged, out = slow_failures(rows), []
    for part in {p for _, p, _ in judged}:
        docs = [(i, f) for i, p, f in judged if p == part]
        shapley = Counter()
        lines = []
        for order in itertools.permutations("ABCDE"):
            left = docs
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                shapley[f] += len(gone)
                lines.append((f, (part, "".join(order), step, len(left), len(gone), sum(f in x for _, x in docs) - len(gone),
                                  sum(x == f for _, x in docs), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone))))
        out += [(*line, shapley[f]) for f, line in lines]
    return sorted(out)


AUDIT = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def test_audit_equals_walking_every_order(spark):
    rows = corpus()
    rng = random.Random(8)
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 1060, 2)]
    got = interactions.audit(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, LABELS))
    assert sorted(tuple(r) for r in got.select(*AUDIT).collect()) == slow_audit(rows, labels)
    sets = {f for _, _, f in slow_failures(rows)}
    assert len(sets) > 12 and all(any(c in s for s in sets) for c in "ABCDE")


def test_audit_of_odd_rows(spark, clashing):  # noqa: F811
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (None, 1, 1), (7, None, None)], LABELS).withColumn("part", F.lit("x"))
    got = interactions.audit(clashing, labels).select(*AUDIT)
    want = slow_audit(odd_rows(), [(1, 1, 0), (1, 0, 1)])
    assert sorted(tuple(r) for r in got.collect()) == want


def test_audit_of_nothing(spark, empty):  # noqa: F811
    assert interactions.audit(empty, spark.createDataFrame([], LABELS)).count() == 0


def test_potentials_are_those_of_the_definition(spark):
    """The potential of a coalition is the sum over its parts T of v(T) (t-1)! (s-t)! / s!."""
    from math import factorial as f

    rng = random.Random(2)
    v = [0] + [rng.randint(0, 99) for _ in range(31)]
    got = interactions.with_potentials(spark.createDataFrame([(v,)], "docs array<long>"), "docs").first()["potential"]
    for s in range(1, 32):
        size = s.bit_count()
        want = sum(Fraction(f(t.bit_count() - 1) * f(size - t.bit_count()), f(size)) * v[t] for t in range(1, 32) if t & s == t)
        assert got[s] == want * 120


def test_copies_of_one_text_do_not_meet_in_one_task(spark):
    docs = spark.range(3000).selectExpr("id as doc_id", "if(id % 3 = 0, 'one text', concat('text ', id)) as text", "'s' as source")
    got = interactions.failures(docs)
    assert got.filter("fails >= 16").count() == 999
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join LeftOuter, ((id#" in plan and "key#" in plan


# ---------------------------------------------------------------- byte network

def slow_score(net, text):
    """The network by its definition, place by place."""
    n = len(text)
    starts = [0]
    while starts[-1] + bytenet.CHUNK < n:
        starts.append(starts[-1] + bytenet.HOP)
    found = []
    for at in starts:
        chunk = list(text[at: at + bytenet.CHUNK])
        size = len(chunk)
        chunk += [bytenet.PAD] * (bytenet.CHUNK - size)
        best = np.zeros(bytenet.FILTERS)
        for place in range(0, bytenet.CHUNK - bytenet.WIDTH + 1, bytenet.STEP):
            if place < size:
                seen = np.concatenate([net.bytes_[b] for b in chunk[place: place + bytenet.WIDTH]])
                best = np.maximum(best, seen @ net.filters + net.offsets)
        found.append(best)
    pooled = np.concatenate([np.mean(found, axis=0), np.max(found, axis=0)])
    return 1 / (1 + np.exp(-(pooled @ net.out + net.bias)))


def random_net(seed=1):
    net = bytenet.Network.fresh(seed)
    rng = np.random.default_rng(seed)
    net.out = rng.normal(0, 0.3, net.out.shape).astype(np.float32)
    net.offsets = rng.normal(0, 0.3, net.offsets.shape).astype(np.float32)
    net.bias = -0.2
    return net


def test_scores_equal_the_definition_for_all_lengths():
    net, rng = random_net(), random.Random(4)
    lengths = [0, 1, 7, 8, 9, 1020, 1024, 1025, 1792, 1793, 4096, 9000]
    texts = [bytes(rng.randrange(256) for _ in range(n)) for n in lengths]
    got = net.score(bytenet.pooled_texts(net, texts))
    assert np.allclose(got, [slow_score(net, t) for t in texts], atol=1e-4)
    one = [float(net.score(bytenet.pooled_texts(net, [t]))[0]) for t in texts]
    assert np.allclose(got, one, atol=1e-5)


def test_chunks_cover_every_byte_and_overlap():
    for n in (0, 1, 1024, 1025, 1792, 1793, 100_000):
        starts = list(bytenet.chunk_starts(n))
        assert starts[0] == 0 and starts[-1] + bytenet.CHUNK >= n
        assert all(b - a == bytenet.HOP < bytenet.CHUNK for a, b in zip(starts, starts[1:]))
        assert len(starts) == 1 or starts[-1] + bytenet.CHUNK - bytenet.HOP < n


def test_a_long_text_is_seen_to_its_end():
    net = random_net()
    plain = b"plain words " * 40_000
    assert net.score(bytenet.pooled_texts(net, [plain]))[0] != net.score(bytenet.pooled_texts(net, [plain + b"\x01\x02#$%&" * 9]))[0]


def test_gradients_are_finite_differences():
    net, rng = random_net(), random.Random(9)
    net.bytes_, net.filters = net.bytes_.astype(np.float64), net.filters.astype(np.float64)
    texts = [bytes(rng.randrange(97, 123) for _ in range(n)) for n in (30, 1500, 0, 2600)]
    y = np.array([1.0, 0.0, 1.0, 0.0])

    def loss():
        p = net.score(bytenet.pooled_texts(net, texts))
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    grads = bytenet._gradients(net, texts, y)
    fields = [net.bytes_, net.filters, net.offsets, net.out]
    for values, grad in zip(fields, grads):
        places = np.argsort(-np.abs(grad).ravel())[:4]
        for k in places:
            at = np.unravel_index(k, values.shape)
            kept, h = values[at], 2e-3
            values[at] = kept + h
            up = loss()
            values[at] = kept - h
            down = loss()
            values[at] = kept
            assert abs((up - down) / (2 * h) - grad[at]) < 0.05 * abs(grad[at]) + 2e-4


def noisy_corpus(spark, n=700):
    rng = random.Random(6)
    vocabulary = words(rng, 300)
    docs, labels = [], []
    for i in range(n):
        good = rng.random() < 0.7
        text = prose(rng, rng.randint(3, 300), vocabulary)
        docs.append((i, text if good else re.sub(" ", lambda m: rng.choice(["$$ ", "## ", "!! "]), text), "en", "s", 0))
        labels.append((i, int(good), 0))
    return spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, LABELS)


def test_held_out_labels_are_found_and_never_learned(spark):
    docs, labels = noisy_corpus(spark)
    out = {r.doc_id: r for r in bytenet.classify(docs, labels).collect()}
    truth = dict(labels.select("doc_id", "quality").collect())
    held = [i for i in out if out[i].held_out]
    assert sorted(held) == [i for i in range(700) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([out[i].predicted == truth[i] for i in held]) >= 0.97
    assert all(r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in out.values())
    # other labels of held-out ids, and other columns, change nothing
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("quality"))
                                .otherwise(F.col("quality")))
    again = bytenet.classify(docs.withColumn("lang", F.lit("x")).repartition(5), flipped)
    assert {r.doc_id: r.score for r in again.collect()} == {i: r.score for i, r in out.items()}


def test_sample_is_bounded_and_whole(spark):
    docs, labels = noisy_corpus(spark, 200)
    texts, y = bytenet.labelled_sample(docs, labels, rows=50)
    assert len(texts) == len(y) == 50
    few, _ = bytenet.labelled_sample(docs, labels, most_bytes=3000)
    assert 0 < sum(map(len, few)) <= 3000
    assert set(few) <= {t.encode() for (t,) in docs.select("text").collect()}


def test_classifier_on_odd_rows(spark, clashing, empty):  # noqa: F811
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, 1, 0), (6, 0, 0), (7, None, 0), (None, 1, 0)], LABELS)
    got = bytenet.classify(clashing, labels).collect()
    assert len(got) == len(odd_rows()) and all(0 <= r.score <= 1 and r.held_out is not None for r in got)
    assert bytenet.classify(empty, labels).count() == 0
    none = bytenet.classify(clashing, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}
    one = bytenet.classify(clashing, labels.filter("quality = 1")).collect()
    assert all(r.predicted == 1 for r in one)
    kept = bytenet.score_table(clashing, random_net())
    assert kept.columns == [c for c in clashing.columns if c != "score"] + ["score"] and kept.count() == len(odd_rows())


# ---------------------------------------------------------------- phrases

def slow_collocations(rows, min_count=10, top=2000):
    n, f = Counter(), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            ws = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(ws)
            for k in (1, 2, 3):
                for i in range(len(ws) - k + 1):
                    f[lang, tuple(ws[i: i + k])] += 1
    cands = {(g, p): a for (g, p), a in f.items() if len(p) > 1 and a >= min_count}
    out = []
    for (lang, p), a in cands.items():
        if any(lang == g and len(q) > len(p) and any(q[i: i + len(p)] == p for i in range(len(q))) and 100 * b >= 50 * a
               for (g, q), b in cands.items()):
            continue
        score, k = min((1000000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
        out.append((lang, " ".join(p), a, f[lang, p[:k]], f[lang, p[k:]], n[lang], score))
    best = []
    for lang in n:
        mine = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))
        best += [(lang, i, *r[1:]) for i, r in enumerate(mine[:top], 1)]
    return sorted(best)


COLLOCATION = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def phrase_corpus(seed=5):
    rng = random.Random(seed)
    vocabulary = words(rng, 8) + ["É", "漢字", "New", "YORK"]
    rows = []
    for i in range(120):
        parts = [prose(rng, rng.randint(0, 60), vocabulary) for _ in range(rng.randint(0, 6))]
        parts.append(rng.choice(["new york city", "New York", "new  \t york x", "a a a a a", "", "ein zwei drei vier"]))
        rng.shuffle(parts)
        text = "".join(p + rng.choice([". ", "\n", " ", ";;", "\x0b", "\x1c", "! "]) for p in parts)
        rows.append((i, text, rng.choice(["en", "de", None, "und"]), "s", 0))
    return rows + rows[:30] + [(500, None, "xx", None, None)]


@pytest.mark.parametrize("one_in, longest", [(phrases.ONE_IN, phrases.LONGEST_CHUNK), (2, 5), (10**9, 7)])
def test_collocations_equal_brute_force(spark, one_in, longest):
    rows = phrase_corpus()
    got = phrases.collocations(spark.createDataFrame(rows, SCHEMA).repartition(4), one_in=one_in, longest=longest, top=40)
    want = slow_collocations(rows, top=40)
    assert sorted(tuple(r) for r in got.select(*COLLOCATION).collect()) == want and len(want) > 60


def cut(texts, one_in, longest=512):
    """[(text, words of a chunk, whether it is the last)] of each chunk."""
    w = phrases.Words.of(texts)
    spelled = w.vocabulary.take(w.ids).to_pylist()
    return [(int(w.text[a]), spelled[a:b], bool(last)) for a, b, last in zip(*phrases.chunk_bounds(w, one_in, longest))]


def test_chunks_assign_every_phrase_once():
    rng = random.Random(7)
    texts = [b" ".join(rng.choice([b"a", b"bb", b"c", b"dd"]) for _ in range(n)) for n in (1, 0, 2, 3, 4, 5, 300, 0, 7, 513, 514, 515)]
    for one_in, longest in ((1, 512), (3, 512), (10**9, 5), (10**9, 512), (4, 6)):
        want, got = Counter(), Counter()
        for t, text in enumerate(texts):
            ws = text.split()
            want.update((t, *ws[i: i + k]) for k in (1, 2, 3) for i in range(len(ws) - k + 1))
        for t, ws, last in cut(texts, one_in, longest):
            assert len(ws) <= longest + 2
            got.update((t, *ws[i: i + k]) for k in (1, 2, 3) for i in range(len(ws) - k + 1) if last or i < len(ws) - 2)
        assert got == want


def test_equal_passages_are_cut_alike():
    rng = random.Random(1)
    shared = " ".join(words(rng, 4000))
    seen = [{tuple(ws) for _, ws, _ in cut([(prose(rng, 50, words(rng, 80)) + " " + shared).encode()], phrases.ONE_IN)} for _ in range(2)]
    assert len(seen[0] & seen[1]) > 0.9 * len(seen[0]) - 3 > 50


def test_long_texts_are_parsed_in_parts_that_end_at_breaks():
    text = b"one two. three, four five\nsix " * 50 + b"x" * 400 + b" y z"
    parts = list(phrases._parts(text, 64))
    assert b"".join(parts) == text and all(p[-1:] in b".,\n" for p in parts[:-1])


def test_marks_never_lose_a_frequent_phrase(spark, monkeypatch):
    """A bitmap far too small marks too much, and the result stays the same."""
    docs = spark.createDataFrame(phrase_corpus(), SCHEMA)
    monkeypatch.setattr(phrases, "FEWEST_BITS", 7)
    monkeypatch.setattr(phrases, "MOST_BITS", 7)
    got = phrases.collocations(docs, top=40)
    assert sorted(tuple(r) for r in got.select(*COLLOCATION).collect()) == slow_collocations(phrase_corpus(), top=40)


def test_keys_are_dealt_before_they_are_added(spark):
    """Sums in the memory of a task before the exchange would hold nearly every phrase of its chunks."""
    chunks = phrases.dictionary(spark.createDataFrame(phrase_corpus(), SCHEMA))
    read = spark.createDataFrame([], chunks.schema)
    for df in (chunks, phrases.phrase_counts(read, 2), phrases.phrase_counts(read, 3)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Aggregate" in plan and "Aggregate" not in plan[plan.index("Exchange"):]


def test_a_slice_gives_a_frequent_chunk_once(spark):
    rows = [(k, "one same text of a few words", "en", "s", 0) for k in range(500)]
    docs = spark.createDataFrame(rows, SCHEMA).coalesce(1).select(F.col("lang").alias("__lang"), F.col("text").alias("__text"))
    got = docs.mapInArrow(phrases._parse(10**9, 512), "lang string, chunk binary, last boolean, n long").collect()
    assert [(r["lang"], bytes(r["chunk"]), r["last"], r["n"]) for r in got] == [("en", b"one same text of a few words", True, 500)]


def test_words_and_pieces_by_hand():
    w = phrases.Words.of([b"", b" A b,c \t d. .e", b"\x0b", b"f"])
    spelled = w.vocabulary.take(w.ids).to_pylist()
    assert spelled == [b"a", b"b", b"c", b"d", b"e", b"f"] and w.text.tolist() == [1, 1, 1, 1, 1, 3]
    assert w.joined.tolist() == [True, False, True, False, False, False]
    assert len(set(w.hashes.tolist())) == 6 and not len(phrases.Words.of([]).ids)


def test_scores_beyond_64_bits(spark):
    a, left, right = 3 * 10**14, 7 * 10**14, 5 * 10**14
    got = spark.createDataFrame([(a, left, right)], "a long, l long, r long").select(
        phrases._cut_score(F.col("a"), F.col("l"), F.col("r"))).first()[0]
    assert got == 1000000 * a * a // (left * right)


def test_collocations_of_odd_rows(spark, clashing, empty):  # noqa: F811
    got = phrases.collocations(clashing, min_count=2)
    assert sorted(tuple(r) for r in got.select(*COLLOCATION).collect()) == slow_collocations(odd_rows(), 2)
    assert phrases.collocations(empty).count() == 0


def test_sql_on_planted_rows(spark):
    """The statements that the driver runs, on the fixtures."""
    con = duckdb.connect()
    rows, labels = [r for r in corpus() if r[0] is not None], [(3, 1, 1), (6, 1, 0), (9, 0, 1)]
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", rows)
    con.execute("CREATE TABLE labels (doc_id BIGINT, quality INTEGER, toxic INTEGER)")
    con.executemany("INSERT INTO labels VALUES (?, ?, ?)", labels)
    assert sorted(con.execute(f"SELECT {', '.join(AUDIT)} FROM ({interactions.SQL})").fetchall()) == slow_audit(rows, labels)
    con.execute("DELETE FROM documents")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", phrase_corpus())
    got = sorted(con.execute(f"SELECT {', '.join(COLLOCATION)} FROM ({phrases.SQL})").fetchall())
    assert got == slow_collocations(phrase_corpus())
