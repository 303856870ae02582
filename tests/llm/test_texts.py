"""SimHash, lines, decontamination and suffix arrays against brute force."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash
from odd_rows import clashing, empty, odd  # noqa: F401
from pyspark.sql import functions as F

from tabloom.llm import decontaminate, lines, simhash, suffixes
from tabloom.llm.common import components


def vocabulary(rng, n=400):
    return ["".join(rng.choice("abcdefghilmnorstué") for _ in range(rng.randint(2, 8))) for _ in range(n)]


def prose(rng, n, words):
    return " ".join(rng.choice(words) for _ in range(n))


def union(n, links):
    parent = list(range(n))

    def find(v):
        while parent[v] != v:
            parent[v] = parent[parent[v]]
            v = parent[v]
        return v

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(v) for v in range(n)]


# ---------------------------------------------------------------- components

def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(7, k) for k in range(200, 260)] + [(3, 3), (500, 499), (499, 500)]
    got = dict(components(spark.createDataFrame(links, "a long, b long")).collect())
    assert all(got[v] == 100 for v in range(100, 161))
    assert all(got[v] == 7 for v in [7, *range(200, 260)])
    assert got[500] == got[499] == 499 and 3 not in got


def test_components_of_nothing(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---------------------------------------------------------------- SimHash

def slow_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not words:
        return 0
    shingles = [b" ".join(words[i: i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_by_hand():
    rng = random.Random(3)
    words = vocabulary(rng)
    for n in (0, 1, 3, 4, 5, 50, 300):
        text = prose(rng, n, words).upper() + "\x0b É"
        assert simhash.shingle_bits(text.encode()) == slow_fingerprint(text)
    assert simhash.shingle_bits(b" \t\n") == 0


@pytest.mark.parametrize("limit", [64, 2])
def test_links_have_all_components(spark, limit):
    rng = random.Random(5)
    flip = lambda f, k: f ^ sum(1 << b for b in rng.sample(range(64), k))
    bases = [rng.getrandbits(64) for _ in range(60)]
    prints = {0, 2**64 - 1, *bases}
    for b in bases:
        for k in (1, 2, 3, 4, 5, 6):
            prints.add(flip(b, k))
    crowd = rng.getrandbits(64)
    prints |= {flip(crowd, rng.randint(0, 5)) for _ in range(150)}
    values = sorted(prints)
    links = [(i, j) for i, j in itertools.combinations(range(len(values)), 2) if (values[i] ^ values[j]).bit_count() <= 4]
    want = union(len(values), links)
    signed = [v - (v >> 63 << 64) for v in values]
    table = spark.createDataFrame([(v,) for v in signed], "fp long")
    got = dict(components(simhash.fingerprint_links(table, 4, bucket_limit=limit)).collect())
    groups = lambda roots: {frozenset(i for i, r in enumerate(roots) if r == x) for x in set(roots)}
    assert groups([got.get(v, v) for v in signed]) == groups(want)


def test_simhash_odd_rows(odd, clashing, empty):
    rows = {(r["id"], r["fp"]): (r["component_id"], r["kept"]) for r in simhash.simhash_groups(odd).collect()}
    assert simhash.simhash_groups(odd).count() == odd.count()
    assert {v for k, v in rows.items() if k[0] in (1, 2)} == {(1, True), (1, False)}
    # null, empty and blank texts have the fingerprint zero; the row without an id takes the component's name
    assert rows[(3, 0)] == (3, True) and rows[(4, 0)] == (3, False) and rows[(None, 0)] == (3, False)
    kept = simhash.drop_near_copies(clashing)
    assert kept.columns == clashing.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert ids.count(1) == 1 and 2 not in ids and 4 not in ids and ids.count(3) == 1
    assert simhash.drop_near_copies(empty).count() == 0 and simhash.simhash_groups(empty).count() == 0
    with pytest.raises(ValueError):
        simhash.fingerprint_links(odd, 3)


def test_variants_of_fingerprints_are_not_broadcast(spark, tmp_path):
    spark.range(2000).select((F.col("id") * 7919).alias("fp")).write.parquet(f"{tmp_path}/prints")
    plan = simhash.fingerprint_links(spark.read.parquet(f"{tmp_path}/prints"))._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"SortMergeJoin \[key#\d+\], \[key#\d+\], Inner", plan) and not re.search(r"BroadcastHashJoin .*Inner", plan)


# ---------------------------------------------------------------- lines

def line_table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_lines_of_many_sites_go(spark):
    spread = "Accept all cookies to go on"
    body = lambda k: f"A long line that only the document {k} holds and that says enough to stay"
    rows = [(k, f"{body(k)}\n  {spread} \n\n{body(k)} again", "en", f"s{k % 7}", 1) for k in range(14)]
    rows += [(50 + k, f"Near the threshold\n{body(50 + k)}", "en", f"s{k % 4}", 1) for k in range(40)]
    rows += [(100 + k, f"At the threshold\n{body(100 + k)}", "en", f"s{k % 5}", 1) for k in range(5)]
    out = {r["doc_id"]: r for r in lines.drop_spread_lines(line_table(spark, rows), min_sites=5, report=True).collect()}
    assert out[3]["text"] == f"{body(3)}\n\n{body(3)} again" and out[3]["n_chars"] == len(out[3]["text"])
    assert (out[3]["n_lines"], out[3]["n_removed"]) == (4, 1)
    assert out[60]["n_removed"] == 0 and "Near the threshold" in out[60]["text"] and out[60]["n_chars"] == 1
    assert out[101]["n_removed"] == 1 and out[101]["text"] == body(101)


def test_copies_of_a_page_stay_whole(spark):
    page = "First line of a page\nSecond line of a page\nThird line of a page"
    rows = [(k, page, "en", f"s{k}", len(page)) for k in range(9)]
    assert {r["text"] for r in lines.drop_spread_lines(line_table(spark, rows)).collect()} == {page}
    # three more texts hold its first line: with the copies' one site that makes four sites, with a fourth text five
    more = lambda n: rows + [(100 + k, f"First line of a page\nOnly here {k}", "en", f"t{k}", 1) for k in range(n)]
    removed = lambda n: sum(r["n_removed"] for r in lines.drop_spread_lines(line_table(spark, more(n)), report=True).collect())
    assert (removed(3), removed(4)) == (0, 13)


def test_boilerplate_goes_whatever_its_share(spark):
    notice = "All rights reserved. " * 20
    rows = [(k, f"Short {k}\n{notice}", "en", f"s{k}", 1) for k in range(6)] + [(50, notice, "en", "s9", 1), (51, notice, "en", "s9", 1)]
    out = {r["doc_id"]: (r["text"], r["n_chars"]) for r in lines.drop_spread_lines(line_table(spark, rows)).collect()}
    assert out == {**{k: (f"Short {k}", 7) for k in range(6)}, 50: ("", 0), 51: ("", 0)}


def test_lines_agree_with_sql(spark):
    rng = random.Random(8)
    words = vocabulary(rng, 60)
    pool = [prose(rng, rng.randint(1, 3), words) for _ in range(30)]
    rows = [(k % 150, "\n".join(rng.choice(pool) if rng.random() < 0.3 else prose(rng, 12, words) for _ in range(rng.randint(0, 8))),
             "en", rng.choice([None, *(f"s{i}" for i in range(8))]), 5) for k in range(200)] + [(900, None, None, "s1", None)]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", rows)
    got = lines.drop_spread_lines(line_table(spark, rows), report=True).select("doc_id", "text", "n_lines", "n_removed").collect()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(con.execute(lines.SQL).fetchall(), key=key)


def test_lines_odd_rows(odd, clashing, empty):
    got = lines.drop_spread_lines(clashing)
    assert got.columns == clashing.columns
    key = lambda r: str(r)
    assert sorted(map(tuple, got.select(odd.columns).collect()), key=key) == sorted(map(tuple, odd.collect()), key=key)
    assert lines.drop_spread_lines(empty).count() == 0
    assert lines.drop_spread_lines(odd.drop("n_chars"), min_sites=1).count() == odd.count()


# ---------------------------------------------------------------- decontamination

def slow_words(text):
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))))


def slow_hits(text, items, window=10):
    doc = slow_words(text)
    hit, named = set(), set()
    for item, words in items:
        n = min(window, len(words))
        spots = {tuple(words[i: i + n]) for i in range(len(words) - n + 1)} if n else set()
        for at in range(len(doc) - n + 1) if n else ():
            if tuple(doc[at: at + n]) in spots:
                hit.update(range(at, at + n))
                named |= {str(item)} if item is not None else set()
    names = ",".join(sorted(named))
    return len(doc), len(hit), len(named), hashlib.sha256(names.encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("item_bytes", [decontaminate.ITEM_BYTES, 300])
def test_benchmark_hits_by_brute_force(spark, item_bytes):
    rng = random.Random(4)
    words = vocabulary(rng, 40)
    items = [(k, prose(rng, rng.choice([0, 1, 2, 9, 10, 11, 30]), words)) for k in range(25)]
    items += [(3, items[7][1]), (40, items[20][1].upper()), (None, prose(rng, 12, words)), (41, None), (42, "  ... "), (100, "solo")]
    docs = []
    for k in range(150):
        text = prose(rng, rng.randint(0, 40), words)
        if k % 3 == 0:
            text += ", " + (rng.choice(items)[1] or "").replace(" ", "--") + ". " + prose(rng, rng.randint(0, 9), words)
        docs.append((k, text))
    docs += [(500, None), (501, ""), (None, items[20][1]), (502, "x-Solo y"), (502, "x-Solo y")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    table = spark.createDataFrame(docs, "doc_id long, text string")
    found = decontaminate.summary(decontaminate.find_matches(table, bench, item_bytes=item_bytes))
    split = [(i, slow_words(t)) for i, t in items]
    want = Counter((d, *slow_hits(t, split)) for d, t in docs)
    assert Counter(tuple(r)[:6] for r in found.collect()) == want
    clean = decontaminate.drop_contaminated(table, bench, item_bytes=item_bytes)
    assert clean.count() == sum(n for k, n in want.items() if not k[5])


def test_longest_matches_and_their_places(spark):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(500)]
    item = rng.sample(words, 30)
    doc = ["a", "b", *item[5:25], "c", *item[:10]]
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    docs = spark.createDataFrame([(1, " ".join(doc))], "doc_id long, text string")
    got = decontaminate.find_matches(docs, bench).first()["matches"]
    assert sorted((m["at"], m["words"], m["items"], m["offset"]) for m in got) == [(2, 20, ["1"], 5), (23, 10, ["1"], 0)]


def test_benchmark_odd_rows(spark, odd, clashing, empty):
    bench = spark.createDataFrame([(1, "ordinary words"), (2, "漢字 and é"), (3, None)], "item_id long, text string")
    none = bench.limit(0)
    found = decontaminate.find_matches(clashing, bench)
    assert set(found.columns) == {*clashing.columns, "n_words"} and found.count() == odd.count()
    hit = {r["doc_id"] for r in found.collect() if r["matches"]}
    assert hit == {1, 2, 8}
    assert decontaminate.drop_contaminated(odd, none).count() == odd.count()
    assert decontaminate.find_matches(empty, bench).count() == 0
    assert decontaminate.drop_contaminated(clashing, bench).columns == clashing.columns


# ---------------------------------------------------------------- suffix arrays

def slow_cut(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(t[i: i + length] for t in raw for i in range(len(t) - length + 1))
    out = []
    for t in raw:
        gone = np.zeros(len(t) + 1, dtype=bool)
        for i in range(len(t) - length + 1):
            if seen[t[i: i + length]] > 1:
                gone[i: i + length] = True
        gone = gone[:-1]
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        kept = bytes(np.frombuffer(t, dtype=np.uint8)[~gone])
        out.append((len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize(("length", "limit"), [(400, 20_000), (100, 20_000), (100, 3)])
def test_repeats_by_brute_force(spark, length, limit):
    rng = random.Random(9)
    words = vocabulary(rng)
    texts = []
    for _ in range(25):
        base = prose(rng, rng.randint(5, length), words).split(" ")
        texts.append(" ".join(base))
        for _ in range(rng.choice([0, 1, 4])):
            for _ in range(rng.choice([0, 1, 3])):
                base[rng.randrange(len(base))] = rng.choice(words)
            texts.append(" ".join(base))
    passage = prose(rng, length // 4, words)
    texts += [prose(rng, rng.randint(0, 50), words) + passage + prose(rng, rng.randint(0, 50), words) for _ in range(30)]
    texts += ["a" * 2000, "ab" * 600, "q" * (length - 1), "r" * length, "s" * (length + 1), "", None, "\0" * (length + 50),
              prose(rng, 30, words) * 12, "é" * length]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"])
           for r in suffixes.cut_repeats(table, length=length, range_limit=limit).collect()}
    assert [got[i] for i in range(len(texts))] == slow_cut(texts, length)


def test_interval_tree_of_a_small_array():
    # suffixes of "banana": a, ana, anana, banana, na, nana
    tree = sorted(suffixes.repeat_intervals([1, 3, 0, 0, 2], 1))
    assert tree == [(1, 0, 2, [0]), (2, 4, 5, [4]), (3, 1, 2, [1])]


def test_repeats_odd_rows(odd, clashing, empty):
    got = suffixes.cut_repeats(clashing)
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"]
    rows = got.collect()
    size = lambda r: (r["doc_id"], len((r["text"] or "").encode()))
    assert Counter((r["doc_id"], r["n_bytes"]) for r in rows) == Counter(map(size, odd.collect()))
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[7]["n_removed"] == 120_000 and by_id[7]["n_spans"] == 1 and by_id[7]["kept"] == b""
    assert by_id[3]["n_bytes"] == 0 and by_id[1]["n_removed"] == 0
    assert suffixes.cut_repeats(empty).count() == 0


def test_repeats_on_the_test_table(spark, sf):
    table = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    rows = table.collect()
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffixes.cut_repeats(table).collect()}
    assert [got[r["doc_id"]] for r in rows] == slow_cut([r["text"] for r in rows], 400)


def test_sites_of_lines_are_counted_not_estimated(spark, monkeypatch):
    def estimate(*_):
        raise AssertionError("an estimate")

    monkeypatch.setattr(lines.F, "hll_sketch_agg", estimate)
    rows = [(k, f"On all sites\nOn {'most' if k % 10 else 'few'} sites\nOnly here {k}", "en", f"s{k}", 1) for k in range(300)]
    for least, want in ((271, {"On all sites"}), (270, {"On all sites", "On most sites"}), (30, {"On all sites", "On most sites", "On few sites"})):
        got = lines.drop_spread_lines(line_table(spark, rows), min_sites=least, report=True).collect()
        kept = {x for r in got for x in r["text"].split("\n") if not x.startswith("Only here")}
        assert kept == {"On all sites", "On most sites", "On few sites"} - want


def test_places_at_both_ends_and_side_by_side(spark):
    spread = ["a notice", "b notice", "c notice"]
    rows = [(k, "\n".join([spread[0], spread[1], f"x{k}", "", spread[2], f"y{k}", spread[0]]), "en", f"s{k}", 1) for k in range(5)]
    got = lines.drop_spread_lines(line_table(spark, rows), report=True).collect()
    assert {(r["text"], r["n_lines"], r["n_removed"], r["n_chars"]) for r in got} == {(f"x{k}\n\ny{k}", 7, 4, 6) for k in range(5)}
