"""Token files and pieces: exact round trips, the libraries' ids, and brute-force sums over segmentations."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from odd_rows import clashing, empty, odd  # noqa: F401

from tabloom.llm import langid, pieces, rans, tokens

ODD = ["a  b   c \n\n  d ", "  x", "", "\x1c  a \x85 b", " <|endoftext|> x<|endoftext|>y  ", "　 a  b  \t c", "é漢🙂  🙂 \n", " ", " \n ", "a\n", "\n a",
       None, "don't 1234 it's", "▁▁ a", "x" * 3000, "a " * 2000, "\0\0 \0"]


# ---------------------------------------------------------------- entropy coder

@pytest.mark.parametrize("n", [0, 1, 2, 31, 32, 33, 1000, 70_000])
def test_blocks_decode_to_what_was_encoded(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.zipf(1.3, n), 50_256).astype(np.uint32)
    sizes = np.array([n // 3, 0, n - n // 3], dtype=np.int64)
    image = rans.pack_file(ids, [-5, None, 2**40], sizes, 500)
    out = list(rans.unpack_file(image))
    assert [d for x in out for d in x[0]] == [-5, None, 2**40]
    assert np.array_equal(np.concatenate([x[1] for x in out]), sizes)
    assert np.array_equal(np.concatenate([x[2] for x in out]), ids)


def test_stretches_between_checkpoints_decode_alike():
    ids = np.random.default_rng(1).integers(0, 900, 10_007).astype(np.uint32)
    table = rans.Table.of(ids)
    for lanes, stride in ((1, 7), (8, 100), (64, 1000), (2048, 1)):
        block = rans.encode_block(table, ids, [1], np.array([len(ids)]), lanes, stride)
        assert np.array_equal(rans.decode_block(table, block)[2], ids)


def test_one_symbol_and_all_symbols():
    for ids in (np.full(5000, 7, dtype=np.uint32), np.arange(65_536, dtype=np.uint32)):
        assert np.array_equal(next(rans.unpack_file(rans.pack_file(ids, [1], np.array([len(ids)]), 1 << 20)))[2], ids)


def test_frequencies_fill_the_table():
    rng = np.random.default_rng(2)
    for n in (1, 2, 1000, 65_536):
        freq = rans.quantise(rng.integers(1, 10**9, n) ** 2)
        assert freq.sum() == 65_536 and freq.min() >= 1
    with pytest.raises(ValueError):
        rans.quantise(np.ones(65_537))


def test_damage_is_noticed():
    ids = np.arange(4000, dtype=np.uint32) % 300
    image = bytearray(rans.pack_file(ids, [1], np.array([len(ids)]), 1 << 20))
    image[-100] ^= 1
    with pytest.raises(ValueError):
        list(rans.unpack_file(bytes(image)))
    with pytest.raises(ValueError):
        list(rans.unpack_file(b"nothing"))


# ---------------------------------------------------------------- token files

def test_words_encode_as_whole_texts_do(monkeypatch):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokens.vocabulary_path())
    rng = random.Random(3)
    texts = ODD + ["".join(rng.choice("ab é 1'.\n\t 🙂") for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    monkeypatch.setattr(tokens, "REMEMBERED", 50)  # words beyond the memory are encoded again
    encoder = tokens.WordEncoder(tokens.vocabulary_path())
    for at in range(0, len(texts), 700):
        some = texts[at: at + 700]
        ids, counts = encoder.encode(some)
        want = [library.encode(t or "", add_special_tokens=False).ids for t in some]
        assert counts.tolist() == [len(w) for w in want]
        assert ids.tolist() == [i for w in want for i in w]


def slow_token_rows(rows):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokens.vocabulary_path())
    out, start = [], 0
    for doc, text in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((doc, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    return out


def test_token_files_by_brute_force(spark, sf, tmp_path):
    table = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    rows = sorted(map(tuple, table.collect()))
    where = str(tmp_path / "files")
    tokens.write_tokens(table.repartition(7), where, file_tokens=20_000, block_tokens=3_000, slice_bytes=30_000)
    assert spark.read.parquet(where).count() > 8
    got = tokens.read_tokens(spark, where, with_ids=True).collect()
    assert sorted(tuple(r)[:4] for r in got) == slow_token_rows(rows)
    assert all(zlib.crc32(np.array(r["ids"], dtype="<u4").tobytes()) == r["ids_crc32"] for r in got)


def test_token_files_odd_rows(odd, clashing, empty):
    got = tokens.encode_corpus(clashing).collect()
    assert len(got) == odd.count()
    texts = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, r["doc_id"], r["text"] or "") for r in odd.collect()))
    # repeated ids may stand in any fixed order: lengths and checksums per id agree, and starts have no gap
    want = {}
    for _, _, doc, text in texts:
        want.setdefault(doc, []).append(slow_token_rows([(doc, text)])[0][2:])
    have = {}
    for r in got:
        have.setdefault(r["doc_id"], []).append((r["n_tokens"], r["ids_crc32"]))
    assert {k: sorted(v) for k, v in have.items()} == {k: sorted(v) for k, v in want.items()}
    order = sorted(got, key=lambda r: r["start"])
    assert [r["start"] for r in order] == list(np.cumsum([0, *(r["n_tokens"] for r in order[:-1])]))
    ids = [r["doc_id"] for r in order]
    assert ids == [None, None, *sorted(i for i in ids if i is not None)]
    assert tokens.encode_corpus(empty).count() == 0


# ---------------------------------------------------------------- pieces

@pytest.fixture(scope="module")
def codec():
    return pieces.codec(pieces.vocabulary_path())


def unigram_library():
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto()
    with open(pieces.vocabulary_path(), "rb") as f:
        model.ParseFromString(f.read())
    model.trainer_spec.model_type = 1  # the library's own Viterbi over the same pieces and scores
    return sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())


def test_best_segmentation_as_the_library_finds_it(codec):
    library = unigram_library()
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghilmnoprstué") for _ in range(rng.randint(1, 14))) for _ in range(2000)] + ["Hello,", "world!", "x1y22", "(see)"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 8))) for _ in range(1500)]
    ids, counts = codec.encode(texts)
    ends = np.cumsum(counts)
    got = [ids[e - n: e].tolist() for e, n in zip(ends, counts)]
    assert got == library.encode(texts, num_threads=1)


def test_best_segmentation_by_brute_force(codec):
    table = codec.table
    score = {p: s for p, s in zip(table.pieces, table.scores.tolist())}

    def best(word):
        top = [0.0] + [-np.inf] * len(word)
        for end in range(1, len(word) + 1):
            for start in range(end):
                if word[start:end] in score:
                    top[end] = max(top[end], top[start] + score[word[start:end]])
        return top[-1]

    rng = random.Random(5)
    words = ["▁" + "".join(rng.choice("abcdeinorst") for _ in range(rng.randint(1, 20))) for _ in range(300)]
    ids, counts = codec.encode_words(words)
    at = 0
    number = {int(i): k for k, i in enumerate(codec.ids)}
    for word, n in zip(words, counts.tolist()):
        mine = [table.pieces[number[i]] for i in ids[at: at + n].tolist()]
        assert "".join(mine) == word and sum(score[p] for p in mine) == best(word)
        at += n


def test_long_words_have_the_best_segmentation(codec):
    library = unigram_library()
    rng = random.Random(9)
    letters = lambda n: "".join(rng.choice("abcdefghilmnoprstu") for _ in range(n))
    texts = [letters(n) for n in (256, 257, 700, 3000)] + ["\n".join(letters(rng.randint(3, 9)) for _ in range(200)),
             "".join(rng.choice("的一是在不了有和人这中大为上个国") for _ in range(900)), f"short {letters(600)} words {letters(5)}"]
    ids, counts = codec.encode(texts)
    ends = np.cumsum(counts)
    assert [ids[e - n: e].tolist() for e, n in zip(ends, counts)] == library.encode(texts, num_threads=1)


def test_decoding_gives_the_text_back(codec):
    rng = random.Random(6)
    texts = [t for t in ODD if t] + ["".join(rng.choice("ab é漢🙂\n\t  \x00ß") for _ in range(rng.randint(1, 60))) for _ in range(800)]
    ids, counts = codec.encode(texts)
    ends = np.cumsum(counts)
    assert [codec.decode(ids[e - n: e]) for e, n in zip(ends, counts)] == [t.replace("▁", " ") for t in texts]


def test_piece_table_odd_rows(odd, clashing, empty):
    from pyspark.sql import functions as F

    out = pieces.encode_table(clashing.drop("ids"))
    assert set(out.columns) == {*clashing.columns, "n_ids", "round_trip"} and out.count() == odd.count()
    rows = out.collect()
    assert all(r["round_trip"] for r in rows)
    assert {r["n_ids"] for r in rows if not r["text"]} == {0}
    back = pieces.decode_table(out.filter(F.col("text").isNotNull())).collect()
    assert all(r["decoded"] == r["text"].replace("▁", " ") for r in back)
    assert pieces.encode_table(empty).count() == 0


def test_pieces_on_the_test_table(spark, sf):
    out = pieces.encode_table(spark.read.parquet(f"{sf}/documents.parquet")).select("round_trip", "n_ids", "ids").collect()
    assert all(r["round_trip"] and r["n_ids"] == len(r["ids"]) for r in out)


# ---------------------------------------------------------------- languages

def segmentations(word, number):
    if not word:
        yield []
    for n in range(1, len(word) + 1):
        if word[:n] in number:
            for rest in segmentations(word[n:], number):
                yield [number[word[:n]], *rest]


def test_forward_sums_all_segmentations():
    table = pieces.PieceTable(["a", "b", "ab", "ba", "abab", "c", "bc"], np.zeros(7))
    number = {p: k for k, p in enumerate(table.pieces)}
    probs = np.random.default_rng(1).random((7, 3))
    words = ["a", "ab", "abab", "ababcab", "cba", "abababababab" * 3]
    got = langid.log_likelihoods(table, probs, words)
    for word, row in zip(words[:5], got):
        want = np.sum([np.prod(probs[s], axis=0) for s in segmentations(word, number)], axis=0)
        assert np.allclose(row, np.log(want))
    alone = langid.log_likelihoods(table, probs, ["az"])[0]
    assert np.allclose(alone, np.log(probs[0] * langid.UNKNOWN))


def test_expected_counts_weigh_all_segmentations():
    table = pieces.PieceTable(["a", "b", "ab", "ba", "abab", "c", "bc"], np.zeros(7))
    number = {p: k for k, p in enumerate(table.pieces)}
    words, weights = ["abab", "cab", "babc"], np.array([[2.0, 0.0], [1.0, 3.0], [0.0, 1.0]])
    want = np.zeros((7, 2))
    for word, w in zip(words, weights):
        ways = list(segmentations(word, number))
        share = np.array([(1 / 7) ** len(s) for s in ways])
        for s, p in zip(ways, share / share.sum()):
            for piece in s:
                want[piece] += p * w
    assert np.allclose(langid.expected_counts(table, words, weights), want)


def test_long_words_of_unknown_letters_stay_finite():
    table = pieces.load_pieces(pieces.vocabulary_path())
    words = ["ꙮ" * 48, "z" * 48, "ꙮz" * 24]
    assert np.isfinite(langid.expected_counts(table, words, np.ones((3, 1)))).all()
    assert np.isfinite(langid.log_likelihoods(table, np.full((len(table.pieces), 2), 1 / len(table.pieces)), words)).all()
    toy = pieces.PieceTable(["a", "b", "ab", "ba", "x"], np.zeros(5))
    assert langid.words_of("x" * 60 + "ab y1z", toy) == [*"x" * 60, "ab", "y", "z"]  # cut where no piece spans
    assert langid.words_of("ab" * 60, toy) == ["ab" * 60]


def test_long_runs_are_summed_whole(monkeypatch):
    table = pieces.PieceTable(["a", "b", "ab", "ba", "abab", "c", "bc"], np.zeros(7))
    rng = random.Random(12)
    words = ["".join(rng.choice("abcz") for _ in range(n)) for n in (1, 2, 9, 30, 48, 49, 130, 300)] + ["ab" * 400]
    probs = np.random.default_rng(2).random((7, 3))
    weights = np.random.default_rng(3).random((len(words), 2))
    monkeypatch.setattr(langid, "LONGEST", 0)  # all words alone, in logarithms
    alone, counted = langid.log_likelihoods(table, probs, words), langid.expected_counts(table, words, weights)
    monkeypatch.setattr(langid, "HELD", 5)
    assert np.allclose(langid.log_likelihoods(table, probs, words), alone)
    monkeypatch.setattr(langid, "LONGEST", 1000)  # all together
    assert np.allclose(langid.log_likelihoods(table, probs, words), alone)
    short = [k for k, w in enumerate(words) if len(w) <= 48]
    monkeypatch.setattr(langid, "LONGEST", 0)
    some = langid.expected_counts(table, [words[k] for k in short], weights[short])
    monkeypatch.setattr(langid, "LONGEST", 48)
    assert np.allclose(langid.expected_counts(table, [words[k] for k in short], weights[short]), some)
    # every letter but z, which no piece spells, is spelled once by the expected pieces
    letters = np.array([len(p) for p in table.pieces]) @ counted
    assert np.allclose(letters, np.array([len(w) - w.count("z") for w in words]) @ weights)


def test_languages_of_joined_text(spark):
    rng = random.Random(13)
    syllables = {"xx": ["la", "mo", "ri"], "yy": ["sch", "ung", "ker"]}
    make = lambda lang, n: "".join(rng.choice(syllables[lang]) for _ in range(n))
    rows = [(k, make("xx" if k % 2 else "yy", 400), "xx" if k % 2 else "yy") for k in range(40)]
    got = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert all(r["lang_pred"] == ("xx" if r["doc_id"] % 2 else "yy") for r in got)


def test_held_out_languages_are_found(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    truth = {r["doc_id"]: r for r in docs.collect()}
    got = langid.identify(docs).collect()
    assert len(got) == len(truth)
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1
        assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in truth[r["doc_id"]]["text"] or ""))
    held = [r for r in got if r["held_out"] and truth[r["doc_id"]]["lang"] and r["lang_pred"] != "und"]
    assert sum(r["lang_pred"] == truth[r["doc_id"]]["lang"] for r in held) >= 0.95 * len(held)


def test_languages_odd_rows(spark, odd, clashing, empty):
    model = langid.fit(clashing)
    assert model.langs == ["en"]
    out = langid.predict(clashing, model)
    assert set(out.columns) == set(clashing.columns) and out.count() == odd.count()
    for r in out.collect():
        none = not any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"], r["score"]) == (("und", 0.0) if none else ("en", 1.0))
    assert langid.keep_identified(clashing).columns == clashing.columns
    assert langid.keep_identified(odd).count() == sum(any(c.isalpha() for c in r["text"] or "") for r in odd.collect())
    assert langid.identify(empty).count() == 0
    unlabelled = odd.withColumn("lang", odd["lang"].substr(9, 9)).replace("", None, ["lang"])
    assert {r["lang_pred"] for r in langid.identify(unlabelled).collect()} == {"und"}
