"""Registered queries against their DuckDB SQL, and the pipeline against a
plain version of its stages."""

import sys

import duckdb
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from lotquery.llm.common import stored, table
from lotquery.llm.decontam import NO_WORD, word_hashes
from lotquery.llm.queries import ORACLES, QUERIES

from .conftest import rows
from .test_decontam import brute as hits
from .test_near_dedup import brute as components

SF = "/root/testdata/sf0.001"


def test_names():
    assert {int(n[2:].split("_")[0]) for n in QUERIES if n.startswith("op")} == set(range(1, 14))
    assert QUERIES.items() <= entry.queries().items() and ORACLES.items() <= entry.oracle_sql().items()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "decontaminate", "mix", "tokens"]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    expected = con.execute(f"SELECT {', '.join(columns)} FROM ({ORACLES[name]})").fetchall()
    assert sorted(map(repr, map(tuple, got.select(*columns).collect()))) == sorted(map(repr, expected))


def test_pipeline(spark):
    """Stage by stage: each keeps what a plain version keeps of its own input."""
    docs = table(spark, SF, "documents")
    stages = dict(corpus_pipeline.STAGES)
    left = stored(stages["language_id"](spark, docs, SF), "test-language")
    assert left.columns == docs.columns
    letters = {r["doc_id"] for r in rows(docs) if any(c.isalpha() for c in r["text"] or "")}
    assert {r["doc_id"] for r in rows(left)} == letters

    before = {r["doc_id"]: r["text"] for r in rows(left)}
    left = stored(stages["near_dedup"](spark, left, SF), "test-near")
    assert left.columns == docs.columns and {r["doc_id"] for r in rows(left)} == set(components(before, corpus_pipeline.SIMILARITY).values())

    items = [(r["item_id"], r["text"]) for r in rows(table(spark, SF, "benchmark"))]
    before = {r["doc_id"]: r for r in rows(left)}
    left = stored(stages["decontaminate"](spark, left, SF), "test-clean")
    after = {r["doc_id"]: r for r in rows(left)}
    cut = 0
    for i, r in before.items():
        n, hit, _ = hits(r["text"], items, 10)
        if not hit:
            assert after[i] == r
        elif hit < n:
            assert hits(after[i]["text"], items, 10)[1] == 0 and after[i]["n_chars"] == len(after[i]["text"])
            assert int(word_hashes([after[i]["text"].lower().encode()], NO_WORD)[1][0]) in (n - hit, n - hit + 1)
            cut += 1
        else:
            assert i not in after
    assert cut and left.columns == docs.columns

    mixed = stored(stages["mix"](spark, left, SF), "test-mix")
    assert mixed.columns == docs.columns and {r["doc_id"] for r in rows(mixed)} == set(after)
    copies = [r["doc_id"] for r in rows(mixed)]
    assert len(after) < len(copies) <= 1.25 * len(after) + 20

    out = rows(stages["tokens"](spark, mixed, SF))
    tokenizer = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.TOKENIZER))
    at = 0
    for r, doc_id in zip(sorted(out, key=lambda r: r["start"]), sorted(copies), strict=True):
        assert (r["doc_id"], r["start"]) == (doc_id, at)
        assert r["n_tokens"] == len(tokenizer.encode(after[doc_id]["text"], add_special_tokens=False).ids) + 1
        at += r["n_tokens"]
    key = lambda r: (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"])
    assert sorted(map(key, rows(corpus_pipeline.run(spark, SF)))) == sorted(map(key, out))
    assert "corpus_pipeline" in sys.modules
