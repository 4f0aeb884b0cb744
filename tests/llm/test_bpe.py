"""The encoder against the tokenizers library, word by word and text by text; the way back."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from siteloom.llm import bpe
from siteloom.llm.queries import QUERIES

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
OWN = bpe.TextIds(PATH)
BACK = bpe.Decoder(PATH)


def same(texts):
    for text in texts:
        ids = OWN(text)
        assert ids.tolist() == LIBRARY.encode(text, add_special_tokens=False).ids, text
        assert BACK(ids, np.array([len(ids)])) == [text.encode()]


def test_odd_texts():
    rng = random.Random(1)
    bits = ["a", "aa", "ab" * 5, " ", "  ", "\n", "\t", "the", "ing", "é", "日本", "😀", "'s", "1", "23", "...",
            "<|endoftext|>", "<|end", "\x00", "\x85", "\xa0", "ſ", "\U0001df1f", "՘", "　", "----"]
    same("".join(rng.choice(bits) for _ in range(rng.randint(0, 40))) for _ in range(3000))


def test_runs_and_random_letters():
    rng = random.Random(2)
    same("a" * n for n in range(1, 120))
    same("".join(rng.choice("ab") for _ in range(200)) for _ in range(100))
    same("".join(rng.choice("etaoinshrdlu") for _ in range(300)) for _ in range(200))
    same("".join(chr(rng.randrange(32, 1000)) for _ in range(80)) for _ in range(500))


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    same([text])


def test_every_token_gives_itself():
    for s, i in OWN.encode.vocabulary.ids.items():
        assert OWN.encode(s.encode("latin-1")) == [i]


def test_words_are_forgotten(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 40)
    monkeypatch.setattr(bpe, "PAIRS", 10)
    same(["one two three four five six seven eight nine ten " * k for k in range(5)] * 2)
    same(["x" * 500 + " y " + "z" * 300, "one two"])


def test_long_word():
    rng = random.Random(3)
    same(["".join(rng.choice("etaoinshrdlu") for _ in range(200_000))])


def test_documents(spark):
    nul = [(1, None, "a"), (2, "", "b"), (3, "Hello  world<|endoftext|>", "c"), (3, "Hello  world<|endoftext|>", "c"),
           (None, "x", None), (4, "lorem " * 30_000, "d")]
    docs = spark.createDataFrame(nul, "doc_id long, text string, ids string")
    rows = bpe.encode(docs, PATH).orderBy("doc_id").collect()
    assert [r.ids for r in rows if r.text != nul[-1][1]] == [
        LIBRARY.encode(t or "", add_special_tokens=False).ids for t in ("x", None, "", nul[2][1], nul[2][1])
    ]
    back = bpe.decode(bpe.encode(docs, PATH), PATH, text="again").collect()
    assert all(r.again == (r.text or "") for r in back) and len(back) == 6
    assert bpe.encode(docs.limit(0), PATH).count() == 0


def test_ids_that_are_no_tokens(spark):
    rows = [([15496, None, 995, -3, 99999],), (None,), ([],), ([165, 50256],)]
    docs = spark.createDataFrame(rows, "ids array<int>")
    got = [r.text for r in bpe.decode(docs, PATH).collect()]
    assert got == ["Hello world", "", "", LIBRARY.decode([165, 50256], skip_special_tokens=False)]


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001"])
def test_query_against_the_library(spark, folder):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = QUERIES["op11_bpe_encoding"](spark, folder).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = LIBRARY.encode(texts[r.doc_id], add_special_tokens=False).ids
        back = LIBRARY.decode(ids, skip_special_tokens=False)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(back.encode()).hexdigest()
