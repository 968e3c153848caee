"""Token counts against the tokenizers library."""

import json
import random

import public_tokenizers
import pytest

from lotquery.llm import token_counts
from lotquery.llm.queries import COUNTED_BY, op13_token_counts

from .conftest import rows

PATH = public_tokenizers.path(COUNTED_BY)
ODD = ["it's 'save '''s don't we'll we'RE ''ll x've 'r 'l 12345 ½ ٣", "<|endoftext|>a<|startoftext|> <|ENDOFTEXT|>",
       "été é ΑΣΣ İstanbul ǅ 日本語テキスト한국 \x1c\x00 ​ x y\x85z", "a" * 5000, "=" * 3000 + "-" * 777, "", "  \n",
       "ab" * 3000 + "'s'", "𝔘𝔫 🤖🤖 naïve ﬁ", "thethethe" * 999, "'", "'s", "''s", "a's", "a'", "a'l", "<", "<|endoftext|>", "ß ẞ"]
LETTERS = [chr(c) for c in [*range(32, 127), 9, 10, 0xE9, 0x301, 0x3A3, 0x4E2D, 0x1F600, 0xA0, 0x2019, 0x660, 0xBD]]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    own = Tokenizer.from_file(PATH)
    return lambda texts: [len(e.ids) for e in own.encode_batch(texts, add_special_tokens=False)]


@pytest.fixture(scope="module")
def texts():
    dice = random.Random(1)
    return ODD + [t for letters in (LETTERS, "'stmdrevl x1", "abths e", "nhet") for t in
                  ("".join(dice.choices(letters, k=dice.randrange(150))) for _ in range(500))]


def counter():
    with open(PATH, encoding="utf-8") as f:
        return token_counts.Counter(f.read())


@pytest.mark.parametrize("cells, chunk, before", [(3 << 23, 256, 24), (1 << 19, 256, 24), (3 << 23, 5, 1), (1 << 20, 16, 0)])
def test_counts_equal_the_library(library, texts, monkeypatch, cells, chunk, before):
    """Also with a table that is full again and again, and with chunks that
    mostly start in another state than guessed."""
    monkeypatch.setattr(token_counts, "MAX_CELLS", cells)
    monkeypatch.setattr(token_counts, "CHUNK", chunk)
    monkeypatch.setattr(token_counts, "BEFORE", before)
    count = counter().count
    want = library(texts)
    assert count([t.encode() for t in texts]).tolist() == want
    assert [int(count([t.encode()])[0]) for t in ODD] == want[:len(ODD)]
    assert count([]).tolist() == [] and count([b"", b""]).tolist() == [0, 0]


def test_full_table_starts_again(texts, monkeypatch):
    monkeypatch.setattr(token_counts, "MAX_CELLS", 1 << 18)
    count = counter()
    count.count([t.encode() for t in texts])
    assert len(count.states) * 2 * count.wide <= 1 << 18


def test_states_merge(texts):
    """Far fewer states than prefixes of words: equal futures are one state."""
    count = counter()
    words = [a + b + c for a in "abcdefgh" for b in ("ing", "tion", "er") for c in ("s", "ly", "ness", "ed")]
    count.count([" ".join(words).encode()])
    assert len(count.states) < len({w[:i] for w in words for i in range(1, len(w))})


def test_query_on_all_documents(spark, library):
    folder = "/root/testdata/sf0.001"
    docs = rows(spark.read.parquet(f"{folder}/documents.parquet"))
    want = dict(zip([r["doc_id"] for r in docs], library([r["text"] or "" for r in docs])))
    got = rows(op13_token_counts(spark, folder))
    assert {r["doc_id"]: r["n_tokens"] for r in got} == want and len(got) == len(docs)
    size = {r["doc_id"]: len((r["text"] or "").encode()) for r in docs}
    assert all(r["n_bytes"] == size[r["doc_id"]] and r["over_limit"] == (r["n_tokens"] > 2048) for r in got)


def test_odd_rows(odd_docs, no_docs, library):
    got = rows(token_counts.count_tokens(odd_docs, PATH, limit=3))
    docs = rows(odd_docs)
    want = library([r["text"] or "" for r in docs])
    key = lambda x: (str(x[0]), x[1])
    assert sorted(((r["doc_id"], r["n_tokens"]) for r in got), key=key) == sorted(zip([r["doc_id"] for r in docs], want), key=key)
    assert all(r["over_limit"] == (r["n_tokens"] > 3) for r in got)
    assert rows(token_counts.count_tokens(no_docs, PATH)) == []


def test_other_tokenizers_are_refused(tmp_path):
    with open(PATH, encoding="utf-8") as f:
        form = json.load(f)
    form["model"]["end_of_word_suffix"] = None
    with pytest.raises(ValueError):
        token_counts.Counter(json.dumps(form))
