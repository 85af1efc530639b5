import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from pagemill.llm import packing as P

SCHEMA = "doc_id long, text string, length string"


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(P.tokenizer_path())


def test_decompose():
    for n in [1, 2, 3, 2047, 2048, 2049, 4096 + 2047, 10_000]:
        pieces = P.decompose(n, 2048)
        assert sum(x for _, x in pieces) == n and all(x & (x - 1) == 0 and x <= 2048 for _, x in pieces)
        assert [s for s, _ in pieces] == np.cumsum([0] + [x for _, x in pieces])[:-1].tolist()
        assert len(pieces) == n // 2048 + bin(n % 2048).count("1")


def test_word_encoder_is_the_tokenizer(tokenizer, monkeypatch):
    monkeypatch.setattr(P, "KEPT", 50)
    monkeypatch.setattr(P, "SLICE", 64)
    rng, encoder = random.Random(1), P.WordEncoder(P.tokenizer_path(), 1)
    alphabet = "abE é́\x1c\x85   \t\n.,'sSİßΣσ1२<|endoftext|>\x00가漢"
    for k in range(1500):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 200 if k % 50 == 0 else 30)))
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 1]


def test_other_tokenizers_take_whole_texts(spark):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    assert isinstance(P.encoder_for(path, 1), P.TextEncoder) and isinstance(P.encoder_for(P.tokenizer_path(), 1), P.WordEncoder)
    texts, other = ["Two  words,\nTHREE Words ", "", None, "  Ünï"], Tokenizer.from_file(path)
    out = P.pack(spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], SCHEMA), path, context=4).collect()
    for k, text in enumerate(texts):
        pieces = sorted((r for r in out if r["doc_id"] == k), key=lambda r: r["start"])
        assert [i for r in pieces for i in r["ids"]] == [*other.encode(text or "", add_special_tokens=False).ids, 1]


def test_pack_round_trip(spark, tokenizer):
    rows = [(1, "word salad " * 3000, "x"), (2, None, "x"), (3, "", "x"), (4, "a", "x"), (4, "a", "x"), (None, "b c", "x"), (5, "Ünï cödé.\n" * 40, None)]
    out = P.pack(spark.createDataFrame(rows, SCHEMA), P.tokenizer_path()).collect()
    docs = defaultdict(list)
    for r in out:
        assert r["length"] == len(r["ids"]) and r["length"] & (r["length"] - 1) == 0 and r["length"] <= 2048 and r["offset"] == 0
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        docs[r["doc_id"]].append(r)
    assert len({r["sequence_id"] for r in out}) == len(out)
    for doc_id, text, _ in rows:
        want = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        pieces = sorted(docs[doc_id], key=lambda r: (r["sequence_id"] >> 32 & 0xFFFFFF, r["start"]))
        assert all(r["doc_tokens"] == len(want) for r in pieces)
        copies = 2 if doc_id == 4 else 1
        assert sorted(i for r in pieces for i in r["ids"]) == sorted(want * copies)
        if copies == 1:
            assert [i for r in sorted(pieces, key=lambda r: r["start"]) for i in r["ids"]] == want
    for a in out:
        for b in out:  # a bucket of equal lengths is a range of sequence ids
            assert (a["length"] < b["length"]) <= (a["sequence_id"] < b["sequence_id"])


def test_buckets_and_empty(spark, tmp_path):
    df = spark.createDataFrame([(1, "some words to pack", "x")], SCHEMA)
    P.write_buckets(P.pack(df, P.tokenizer_path()), str(tmp_path / "b"))
    assert spark.read.parquet(str(tmp_path / "b")).where("bucket <> length").count() == 0
    assert P.pack(df.limit(0), P.tokenizer_path()).count() == 0
    with pytest.raises(ValueError):
        P.pack(df, P.tokenizer_path(), context=1000)


def test_query_columns(spark, sf_dir, tokenizer):
    out = P.query(spark, sf_dir)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    total = out.groupBy("doc_id").sum("length").collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert {r[0]: r[1] for r in total} == {d: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for d, t in texts.items()}


def test_latin_texts_are_split_as_the_tokenizer_does(tokenizer, monkeypatch):
    rng, encoder = random.Random(2), P.WordEncoder(P.tokenizer_path(), 1)
    calls = []
    monkeypatch.setattr(P, "TOGETHER", 7)
    monkeypatch.setattr(P.WordEncoder, "_words", lambda self, words: calls.append(words))
    signs = [chr(k) for k in range(256)]
    texts = ["".join(signs), *(a + b for a in signs for b in "a'S1.\xa0"), "it's we'Re 'll''d don'ts ('ve", "x" * 100 + " " + "x" * 100, "", "  "]
    texts += ["".join(rng.choice(signs if k % 2 else "aB'stdrevml .,\n1²é<|") for _ in range(rng.randint(1, 60))) for k in range(4000)]
    for text in texts:
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 1], text
    assert not calls and all(len(word) <= P.LONGEST for word in encoder.known)


def test_new_words_go_to_the_tokenizer_together(tokenizer):
    class Counting:
        calls = 0

        def encode(self, text, add_special_tokens):
            self.calls += 1
            return tokenizer.encode(text, add_special_tokens=add_special_tokens)

    encoder = P.WordEncoder(P.tokenizer_path(), 1)
    encoder.tokenizer = Counting()
    text = " ".join(f"Wordé{chr(97 + k // 26)}{chr(97 + k % 26)}, and." for k in range(500))
    assert np.frombuffer(encoder.encode(text), "<u4").tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 1]
    assert encoder.tokenizer.calls == 1
