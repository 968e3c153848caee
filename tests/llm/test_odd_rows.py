"""Every operator over odd rows and over empty tables."""

import hashlib
import zlib

import public_tokenizers
import pytest

from lotquery.llm.decontam import find_contamination, remove_contamination
from lotquery.llm.exact_dedup import exact_dedup
from lotquery.llm.html_extract import extract_pages
from lotquery.llm.langid import identify_languages
from lotquery.llm.line_dedup import line_dedup
from lotquery.llm.mixing import mix_sources
from lotquery.llm.near_dedup import drop_near_duplicates, near_dedup
from lotquery.llm.quality import score_quality
from lotquery.llm.sharding import shard_documents
from lotquery.llm.token_output import token_output

from .conftest import rows

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, "x"), (2, 0, "x"), (2, 1, None), (4, None, "x"), (None, 1, "x"), (99, 7, "x")],
                                 "doc_id long, quality int, text string")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, "words without AN id"), (1, "odd"), (None, "own"), (3, None), (4, ""), (5, "!?")],
                                 "item_id long, text string")


@pytest.fixture(scope="module")
def no_benchmark(spark):
    return spark.createDataFrame([], "item_id long, text string")


def test_quality(odd_docs, no_docs, labels):
    got = rows(score_quality(odd_docs, labels))
    assert len(got) == 10 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    assert {r["doc_id"]: r["held_out"] for r in got} == {
        d: d is not None and zlib.crc32(str(d).encode()) % 5 == 0 for d in (1, 2, 3, 4, None, 5, 6, 7, -8)}
    assert len({r["score"] for r in got if r["doc_id"] in (3, 4)}) == 1  # null as empty
    assert rows(score_quality(no_docs, labels)) == []
    assert {r["score"] for r in rows(score_quality(odd_docs, labels.limit(0)))} == {0.5}


def test_sharding(odd_docs, no_docs):
    got = rows(shard_documents(odd_docs, 3))
    assert len(got) == 10 and rows(shard_documents(no_docs, 3)) == []
    for shard in {r["shard"] for r in got}:
        slots = sorted(r["slot"] for r in got if r["shard"] == shard)
        assert slots == list(range(len(slots)))
    sizes = {r["doc_id"]: r["size"] for r in got}
    assert sizes[3] == sizes[4] == 8 and sizes[None] == len("words without an id") + 8
    assert len({r["shard"] for r in got if r["doc_id"] in (1, 2)}) == 1
    assert len({r["shard"] for r in got if r["doc_id"] in (3, 4)}) == 1


def test_decontamination(odd_docs, no_docs, benchmark, no_benchmark):
    got = {r["doc_id"]: r for r in rows(find_contamination(odd_docs, benchmark))}
    assert got[None]["n_hit"] == 4 and got[None]["items_sha256"] == hashlib.sha256(b"1").hexdigest()
    assert got[1]["n_hit"] == 1 and got[1]["items_sha256"] == hashlib.sha256(b"").hexdigest() and got[1]["n_items"] == 1
    assert got[7]["n_hit"] == 1 and got[3] == {**got[4], "doc_id": 3} and not got[3]["contaminated"]
    assert rows(find_contamination(no_docs, benchmark)) == []
    assert not any(r["contaminated"] for r in rows(find_contamination(odd_docs, no_benchmark)))
    left = remove_contamination(odd_docs, benchmark)
    assert left.columns == odd_docs.columns
    kept = rows(left)
    assert None not in {r["doc_id"] for r in kept} and len(kept) == 9  # nothing was left of it
    assert {r["text"] for r in kept if r["doc_id"] in (1, 2)} == {
        "The same line of text that is long enough to be counted as one line\n"}
    assert [r["text"] for r in kept if r["doc_id"] == 3] == [None]


def test_exact_dedup(odd_docs, no_docs):
    got = rows(exact_dedup(odd_docs))
    by = {r["doc_id"]: r for r in got}
    assert len(got) == 10 and rows(exact_dedup(no_docs)) == []
    assert by[1]["keep_id"] == 2 and by[1]["group_size"] == 3 and not by[1]["kept"] and by[2]["kept"]
    assert by[3]["keep_id"] == 4 and by[3]["text_sha256"] == hashlib.sha256(b"").hexdigest()
    assert by[None]["kept"] and by[None]["keep_id"] is None


def test_line_dedup(odd_docs, no_docs):
    got = {r["doc_id"]: r for r in rows(line_dedup(odd_docs, min_docs=3))}
    assert rows(line_dedup(no_docs)) == []
    assert got[1]["n_dropped"] == 1 and got[1]["kept_text"] == "own" and got[2]["n_dropped"] == 0
    assert got[3]["n_lines"] == got[4]["n_lines"] == 1 and got[-8]["n_lines"] == 3
    assert all(r["n_dropped"] == 0 for r in rows(line_dedup(odd_docs)))


def test_token_output(odd_docs, no_docs):
    got = rows(token_output(odd_docs, TOKENIZER))
    assert len(got) == 10 and rows(token_output(no_docs, TOKENIZER)) == []
    order = sorted(got, key=lambda r: r["start"])
    assert [r["doc_id"] for r in order] == [None, -8, 1, 2, 2, 3, 4, 5, 6, 7]
    at = 0
    for r in order:
        assert r["start"] == at
        at += r["n_tokens"]
    assert order[5]["n_tokens"] == order[6]["n_tokens"] == 1
    assert order[5]["ids_crc32"] == zlib.crc32((2).to_bytes(4, "little"))


def test_language(odd_docs, no_docs):
    got = {r["doc_id"]: r for r in rows(identify_languages(odd_docs))}
    assert got[3]["lang_pred"] == got[4]["lang_pred"] == got[6]["lang_pred"] == "und" and got[3]["score"] == 0
    assert got[5]["lang_pred"] != "und" and 0 < got[5]["score"] <= 1
    assert rows(identify_languages(no_docs)) == []
    unknown = odd_docs.withColumn("lang", odd_docs["lang"].substr(9, 1)).replace("", None, subset=["lang"])
    assert {r["lang_pred"] for r in rows(identify_languages(unknown))} <= {"und"}


def test_mixing(odd_docs, no_docs):
    got = mix_sources(odd_docs)
    assert got.columns[:len(odd_docs.columns)] == odd_docs.columns and rows(mix_sources(no_docs)) == []
    first = [r for r in rows(got) if r["mix_pass"] == 0]
    assert sorted(str(r["doc_id"]) for r in first) == sorted("1 2 2 3 4 None 5 6 7 -8".split())
    assert len(rows(mix_sources(odd_docs, entropy=0.5))) >= 10


def test_near_dedup(odd_docs, no_docs):
    got = rows(near_dedup(odd_docs))
    by = {r["doc_id"]: r for r in got}
    assert len(got) == 10 and rows(near_dedup(no_docs)) == []
    assert by[2]["component_id"] == 1 and not by[2]["kept"] and by[1]["kept"]
    assert by[3]["n_shingles"] == by[4]["n_shingles"] == 0 and by[3]["kept"] and by[4]["component_id"] == 4
    assert by[6]["n_shingles"] == 1 and by[None]["kept"]
    left = drop_near_duplicates(odd_docs)
    assert left.columns == odd_docs.columns
    assert sorted(str(r["doc_id"]) for r in rows(left)) == sorted("1 3 4 None 5 6 7 -8".split())


def test_html(spark):
    schema = "page_id long, url string, html string, path string, host int"
    pages = spark.createDataFrame([
        (1, "http://a.example/x", "<p>One &amp; <b>two</b>\n three<p>four", "p", 1), (2, None, None, None, None),
        (None, "no url", "", "p", 1), (3, "HTTP://A.example/", "<article><p>a</article><!-- x", "p", 1),
        (3, "HTTP://A.example/", "<article><p>a</article><!-- x", "p", 1),
        (4, "http://b.example", "<div>" * 3000 + "deep" + "<p>t &#xe9; &bogus; &lt", "p", 1),
        (5, "http://b.example", "<p " + "x" * 100_000, "p", 1), (6, "http://b.example", "<script>never ends <p>x", "p", 1)], schema)
    got = {r["page_id"]: r["text"] for r in rows(extract_pages(pages))}
    assert got == {1: "One & two three\nfour", 2: "", None: "", 3: "a", 4: "deep\nt é &bogus; <", 5: "", 6: ""}
    assert rows(extract_pages(spark.createDataFrame([], schema))) == []


CLASHING = "_cover _items _body _mark mark weight _full _last _copies _quota _row row v set_id n lang_known page path mix x tokens".split()


def test_values_of_clashing_columns_stay(spark, benchmark, odd_docs):
    """Columns named like those the operators use come back with their values."""
    from pyspark.sql import functions as F
    docs = odd_docs.select("doc_id", "text", "source", "n_chars", *[F.concat(F.lit(c), F.col("doc_id").cast("string")).alias(c) for c in CLASHING],
                           F.lit(1).alias("a.b c"))
    before, settings = {r["doc_id"]: r for r in rows(docs)}, dict(spark.conf.getAll)
    tables = spark.catalog.listTables()
    for left in (remove_contamination(docs, benchmark), mix_sources(docs).select(*[f"`{c}`" for c in docs.columns]), drop_near_duplicates(docs)):
        assert left.columns == docs.columns
        kept = rows(left)
        assert len(kept) >= 8
        for r in kept:
            assert all(r[c] == before[r["doc_id"]][c] for c in [*CLASHING, "source", "a.b c"])
    assert dict(spark.conf.getAll) == settings and spark.catalog.listTables() == tables
