import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lotquery.llm import bpe
from lotquery.llm import token_output as to

PATH = public_tokenizers.path("byte_bpe_50k.json")


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 299), max_size=1_500), st.integers(1, 7))
def test_round_trip(ids, repeat):
    ids = np.array(ids * repeat, np.int64)
    assert (to.decode_ids(to.encode_ids(ids, 300), len(ids), 300) == ids).all()


def test_sizes():
    rng = np.random.default_rng(0)
    noise = rng.integers(0, 50_257, 100_000)
    assert 15.6 < 8 * len(to.encode_ids(noise, 50_257)) / len(noise) < 18
    skewed = np.minimum(rng.zipf(1.5, 200_000), 50_000)
    p = np.unique(skewed, return_counts=True)[1] / len(skewed)
    assert 8 * len(to.encode_ids(skewed, 50_257)) / len(skewed) < 1.4 * -(p * np.log2(p)).sum() + 1
    periodic = np.tile(rng.integers(0, 50_257, 300), 500)
    assert 8 * len(to.encode_ids(periodic, 50_257)) / len(periodic) < 4  # orders 1 and 2


def test_blocks_are_checked():
    blob = to.encode_block([5, None, -3], np.array([2, 0, 3]), np.array([1, 2, 9, 9, 2]), 10)
    names, lengths, ids = to.decode_block(blob)
    assert names == [5, None, -3] and lengths.tolist() == [2, 0, 3] and ids.tolist() == [1, 2, 9, 9, 2]
    for i in (0, 30, 45, len(blob) - 1):
        with pytest.raises(ValueError):
            to.decode_block(blob[:i] + bytes([blob[i] ^ 1]) + blob[i + 1:])


ODD = ["", " ", "  a  b\n\n c\t\td ", "x\n y", "<|endoftext|> a", "a\x1cb c", "é  x  ' 's it's I'LL 12 3 ...!! \r\n z",
       "½ ² Ⅷ ª b　c  d", "naïve ſtraße ǅ 日本語 ٣٤ 🙂🙂 é", "\x85x\x00 \x7f", "a_b__c d'’s 'S 're"]


with open(PATH, encoding="utf-8") as _file:
    DEFINITION = _file.read()
IDS = bpe.Tokens(DEFINITION)


def library(texts):
    return [e.ids for e in IDS.library.encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ab \u00e9'sSt1_.!\n\t\u3000\u2003\u00bd\u00b2\u65e5\x1f\x85<|velmr")), max_size=4))
def test_ids_are_the_library_s(texts):
    assert [x.tolist() for x in IDS.of([t.encode() for t in texts])] == library(texts)


@pytest.mark.parametrize("longest", [64, 1, 7])
def test_ids_of_documents(spark, monkeypatch, longest):
    monkeypatch.setattr(bpe, "LONGEST", longest)
    texts = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    texts += [*ODD, "x" * 20_000 + " " + "ab" * 9_999, "=" * 5_000 + "\n" * 3_000, "<|endoftext|>" * 3 + "\u00e9" * 2_000]
    texts += ["a" * n + " " + "ab" * n + "aab" * n for n in range(40)]
    assert [x.tolist() for x in IDS.of([t.encode() for t in texts])] == library(texts)


def test_known_words(monkeypatch):
    """Words of earlier batches, some forgotten, some with another word's hash."""
    monkeypatch.setattr(bpe, "KNOWN", 40)
    own = bpe.Tokens(DEFINITION)
    rng = np.random.default_rng(9)
    for _ in range(30):
        texts = [" ".join("".join(rng.choice(list("abcé"), rng.integers(1, 5))) for _ in range(30)) for _ in range(2)]
        assert [x.tolist() for x in own.of([t.encode() for t in texts])] == library(texts)
    assert 0 < len(own.known.hashes) <= 40
    real = bpe.scramble
    monkeypatch.setattr(bpe, "scramble", lambda x: real(x) % np.uint64(50_021))  # now some batches agree in hashes only
    for _ in range(30):
        texts = ["".join(rng.choice(list("abcdefgh"), 3)) for _ in range(3)]
        assert [x.tolist() for x in own.of([t.encode() for t in texts])] == library(texts)


def test_words_known_are_neither_sorted_nor_merged(monkeypatch):
    """A batch whose words are all known costs a table's look-ups."""
    own = bpe.Tokens(DEFINITION)
    texts = ["Some words, some others and unquestionableness 12", "", "words' last 's é"]
    want = [x.tolist() for x in own.of([t.encode() for t in texts])]

    def never(*_, **__):
        raise AssertionError("known words are looked up")

    monkeypatch.setattr(bpe.Tokens, "merged", never)
    monkeypatch.setattr(bpe.np, "argsort", never)
    assert [x.tolist() for x in own.of([t.encode() for t in texts])] == want == library(texts)


def test_words_that_differ_late(monkeypatch):
    """Words of one hash and size that differ from byte 8, 16, ... on only, up to LONGEST and beyond."""
    monkeypatch.setattr(bpe, "scramble", lambda x: x * 0)
    own = bpe.Tokens(DEFINITION)
    rng = np.random.default_rng(2)
    for size in [*range(6, 20), 32, 33, 63, 64, 65, 90] * 2:
        texts = ["x" * (size - 1) + c for c in "yzaxy"] + ["x" * 8 + "".join(rng.choice(list("abc"), size)) + "\x00" * k for k in range(3)]
        for batch in (texts, texts[:1], texts[1:2]):
            assert [x.tolist() for x in own.of([t.encode() for t in batch])] == library(batch)


def test_special_strings_across_texts():
    texts = ["<|endof", "text|>", "a <|endoftext|>", "'", "s it'", "ll"]
    assert [x.tolist() for x in IDS.of([t.encode() for t in texts])] == library(texts)


def test_format_stays():
    """Bytes as first written, so that older files stay readable."""
    ids = np.arange(30_000) ** 2 // 7 % 299
    assert zlib.crc32(to.encode_ids(ids, 300)) == 1269631402


def test_predictions_without_weight(monkeypatch):
    """Of orders 2 and 1, as in a block whose tries outnumber the parts."""
    weigh = to.Model._weigh

    def some(self):
        weigh(self)
        order1 = self.weight21 - self.weight2
        self.weight2[::3] = 0
        order1[::4] = 0
        self.weight21 = self.weight2 + order1

    monkeypatch.setattr(to.Model, "_weigh", some)
    ids = np.random.default_rng(1).integers(0, 4, 30_001) * np.tile([1, 1, 0], 10_001)[:30_001]
    assert (to.decode_ids(to.encode_ids(ids, 300), len(ids), 300) == ids).all()


def test_words_with_one_hash_stay_apart(monkeypatch):
    monkeypatch.setattr(bpe, "scramble", lambda x: x * 0)
    texts = ["some words and some other words", "", "a b a"]
    assert [x.tolist() for x in IDS.of([t.encode() for t in texts])] == library(texts)


def test_pair_table():
    rng = np.random.default_rng(5)
    codes = rng.choice(1 << 20, 60_000, replace=False)
    pairs = bpe.Pairs(codes >> 10, codes & 1023)
    assert (pairs.rank(codes >> 10, codes & 1023) == np.arange(60_000)).all()
    other = np.setdiff1d(np.arange(1 << 20), codes)
    assert (pairs.rank(other >> 10, other & 1023) == pairs.NONE).all()


def test_other_kinds_go_to_the_library():
    path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as file:
        other = bpe.Tokens(file.read())
    want = [Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids for t in ("Some words", "")]
    assert not other.fits and [x.tolist() for x in other.of([b"Some words", b""])] == want


def test_documents(spark, monkeypatch):
    docs = [(i * 7 % 100, t) for i, t in enumerate(ODD * 3)] + [(1_000, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    tokenizer = Tokenizer.from_file(PATH)
    for block_ids in (1 << 20, 8):  # whole partitions, then a document or so in a block
        path = to.scratch_path(spark, "tokens-test")
        to.write_tokens(df, PATH, path, block_ids=block_ids)
        got = {r.doc_id: r for r in to.read_tokens(spark, path, with_ids=True).collect()}
        at = 0
        for doc_id, text in sorted(docs, key=lambda d: d[0]):
            ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
            r = got[doc_id]
            assert r.ids == ids and (r.start, r.n_tokens) == (at, len(ids))
            assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
            at += len(ids)
