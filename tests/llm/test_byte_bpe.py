import hashlib
import random
import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodestone.llm import byte_bpe, registry
from tests.llm.tables import by_id, documents

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def codec():
    return byte_bpe.ByteCodec(registry.byte_vocabulary())


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_str(registry.byte_vocabulary().decode())


def agree(codec, library, text):
    ids = codec.encode(text)
    assert ids == library.encode(text, add_special_tokens=False).ids
    assert codec.decode(ids) == library.decode(ids, skip_special_tokens=False)


PARTS = st.sampled_from(["a", "the", "'s", "'LL", " ", "  ", "\n", "1", "<|endoftext|>", "<|endof", "\x85", "\x1c", "　", "é", "漢字", "𝟘", "👍🏽", "ǅ", "…"])


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=60), st.lists(PARTS, max_size=30).map("".join)))
def test_any_text_as_the_library(codec, library, text):
    agree(codec, library, text)


def test_every_code_point(codec, library):
    points = [c for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]
    for form in ("{0}a {0}1", ".{0}. "):
        agree(codec, library, "".join(form.format(chr(c)) for c in points))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 50256), max_size=20))
def test_any_ids_decode_as_the_library(codec, library, ids):
    assert codec.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_heap_and_scan_agree(codec):
    r = random.Random(5)
    for _ in range(500):
        word = bytes(r.choice(b"aaabeht \xc3\xa9") for _ in range(r.randrange(1, 60)))
        assert codec.scanned(word) == codec.queued(word)


@pytest.mark.parametrize("text", ["a" * 100_000, "ab" * 40_000, " " * 50_000, "é" * 20_000, "x" * 256, "x" * 257, "\n\n " * 9_000], ids=range(7))
def test_long_words(codec, library, text):
    agree(codec, library, text)


def test_tables(spark, library):
    rows = documents(spark).withColumns({"ids": F.lit("clash"), "decoded": F.lit(1), "n_tokens": F.lit("x")})
    got = byte_bpe.round_trip_digests(rows, registry.byte_vocabulary()).collect()
    assert len(got) == rows.count()  # repeated rows and the null id too
    texts = {r.doc_id: r.text or "" for r in rows.collect()}
    for r in got:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    encoded = byte_bpe.encode(rows, registry.byte_vocabulary(), ["doc_id"])
    back = by_id(byte_bpe.decode(encoded, registry.byte_vocabulary(), ["doc_id"]))
    assert {k: r.decoded for k, r in back.items()} == texts
    assert byte_bpe.round_trip_digests(documents(spark, empty=True), registry.byte_vocabulary()).count() == 0


def test_query_reads_every_document(spark, library):
    got = by_id(registry.op13_byte_bpe(spark, SF))
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = library.encode(d.text, add_special_tokens=False).ids
        assert (got[d.doc_id].n_tokens, got[d.doc_id].ids_sha256) == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest())


def test_other_vocabularies_are_refused():
    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json"), "rb") as f, pytest.raises(ValueError):
        byte_bpe.ByteCodec(f.read())
