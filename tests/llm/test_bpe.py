"""Byte-level BPE against the rank library, whole texts, offsets and decoding."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from textmeter.llm import bpe

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
HARD = [
    "", " ", "  ", " a", "a ", "a  b", "a \n b", "\n", "\r\n x", "don't  stop 's 'S we'll", "naïve café 日本語 テキスト 한국어 😀😃 👩‍👩‍👧", "<|endoftext|> and <|startoftext|>",
    "x y  z", "tab\tand\x0bmore\x1c \x1d", "​ ​", "a　 b", "12345 6 7.89e10", "é ́", "!!! ??? ...", "aaaaaaaaaaaaaaaaaaaa" * 20, "word " * 500, "﻿bom", "Ünï çødé" * 30,
]


@pytest.fixture(scope="module")
def oracle():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def ours():
    return bpe.tokenizer_json(RANKS, public_tokenizers.PATTERN)


def noise(n, seed=9):
    rng = random.Random(seed)
    letters = "ab cd  e\n\t'st.é日 😀0 1"
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, 200))) for _ in range(n)]


def test_byte_table_is_one_to_one():
    table = bpe.byte_characters()
    assert len(set(table)) == 256 and table[ord("A")] == "A" and table[32] == "Ġ"
    assert bpe.to_bytes(bpe.to_characters(bytes(range(256)))) == bytes(range(256))


def test_ids_equal_the_rank_library(oracle, ours):
    for texts in (HARD, noise(400), HARD + HARD):
        got = [np.frombuffer(b, "<u4").tolist() for b in bpe.encode_texts(ours, texts)]
        assert got == [oracle.encode_ordinary(t) for t in texts]


def test_a_worker_that_forgets_encodes_alike(oracle, ours, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    monkeypatch.setattr(bpe, "GROUP", 50)
    got = [np.frombuffer(b, "<u4").tolist() for b in bpe.encode_texts(ours, noise(60))]
    assert got == [oracle.encode_ordinary(t) for t in noise(60)]


def test_columns_offsets_and_round_trip(spark, oracle, ours):
    rows = [(i, t, "clash") for i, t in enumerate(HARD + [None])] + [(None, "again", "x"), (0, "", "clash")]
    df = spark.createDataFrame(rows, "doc_id long, text string, starts string")
    got = bpe.decode(bpe.encode(df, ours, offsets=True), ours).collect()
    assert len(got) == len(rows)
    together = bpe.encode(df, ours, decoded=True).collect()
    assert [(r.ids, r.decoded) for r in together] == [(r.ids, r.decoded) for r in got]
    table = bpe.token_bytes(ours)
    for r, (_, t, _) in zip(got, rows):
        t = t or ""
        assert r.ids == oracle.encode_ordinary(t) and bytes(r.decoded).decode() == t
        for token, start, end in zip(r.ids, r.starts, r.ends):
            assert table[token] in t[start:end].encode() and end > start
        if r.ids:
            assert r.starts[0] == 0 and r.ends[-1] == len(t)


def test_split_characters(spark, ours, oracle):
    ids = oracle.encode_ordinary("日本語 😀")
    df = spark.createDataFrame([(ids,), (ids[:1],), ([],), (None,)], "ids array<int>")
    assert [r.decoded for r in bpe.decode_text(df, ours).collect()] == ["日本語 😀", oracle.decode_bytes(ids[:1]).decode("utf-8", "replace"), "", None]


def test_digests_over_a_whole_table(spark, oracle, ours):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = {r.doc_id: oracle.encode_ordinary(r.text or "") for r in df.collect()}
    text = {r.doc_id: (r.text or "").encode() for r in df.collect()}
    got = bpe.digests(df, ours).collect()
    assert len(got) == len(want)
    for r in got:
        ids = want[r.doc_id]
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(text[r.doc_id]).hexdigest()
    assert bpe.digests(df.limit(0), ours).count() == 0


def test_remembered_pieces_are_looked_up_not_walked_through():
    class Remembered(dict):
        def __iter__(self):
            raise AssertionError("all remembered pieces were walked through")

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encoder = bpe.Encoder(bpe.tokenizer_json(public_tokenizers.path("byte_bpe_50k.json")))
    texts = ["one two, two three.\nfour", "", "two  three \n one", " one", "one two   twö  three", "one"]
    for more in ([], ["five two six"], ["x" * 50 + " two\t two"]):
        got = encoder.encode(texts + more)
        assert [np.frombuffer(g, "<u4").tolist() for g in got] == [library.encode(t, add_special_tokens=False).ids for t in texts + more]
        encoder.tails = Remembered(encoder.tails)


def test_known_words_are_not_encoded_again():
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encoder = bpe.Encoder(bpe.tokenizer_json(public_tokenizers.path("byte_bpe_50k.json")))
    encoder.encode(["one two naïve, a.\nfour\n", "four"])
    encoder.library = encoder.merger = None
    texts = ["four two, one", "", "four. a naïve. two\n\nfour"]
    known = ["four two, a naïve", "", "four.\nfour two, two."]
    assert [np.frombuffer(g, "<u4").tolist() for g in encoder.encode(known)] == [library.encode(t, add_special_tokens=False).ids for t in known]
    with pytest.raises(AttributeError):
        encoder.encode(texts)


def cut(texts):
    points = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4")
    edges = np.cumsum([0, *map(len, texts)])
    starts = np.flatnonzero(bpe.word_starts(points, bpe.character_kinds()[points], edges[:-1][np.diff(edges) > 0]))
    parts = np.split(starts, np.searchsorted(starts, edges[1:-1]))
    return [(part - first).tolist() for part, first in zip(parts, edges)]


def test_words_are_cut_as_the_library_cuts(ours):
    sure = [chr(i) for i in np.flatnonzero(bpe.character_kinds())]
    assert len(sure) > 50_000 and not set(map(chr, range(128))).difference(sure)
    rng = random.Random(4)
    letters = "aé  \n\t　'''stmdrevl1٣!-_\x1c\x85"
    texts = [f"a{c}1{c}{c}!{c} {c}" for c in sure] + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 12))) for _ in range(20_000)]
    got = cut(texts)
    for tokenizer in (Tokenizer.from_str(ours), Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))):
        assert got == [[a for _, (a, _) in tokenizer.pre_tokenizer.pre_tokenize_str(t)] for t in texts]


def test_texts_of_unsure_characters_and_other_patterns_go_to_the_library(oracle, ours):
    texts = ["one 😀 two", "plain one", "", "ɀ͸ a", "plain  one", "\U0001d400b 1"]
    assert [np.frombuffer(b, "<u4").tolist() for b in bpe.encode_texts(ours, texts)] == [oracle.encode_ordinary(t) for t in texts]
    digits = ours.replace(r"\\p{N}+", r"\\p{N}{1,3}")
    library = Tokenizer.from_str(digits)
    assert digits != ours and not bpe.Encoder(digits).by_words and bpe.Encoder(ours).by_words
    texts += ["12345 678901 a1234"]
    assert [np.frombuffer(b, "<u4").tolist() for b in bpe.encode_texts(digits, texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_groups_of_any_size_give_the_same_ids(oracle, ours, monkeypatch):
    texts = HARD + noise(80, 3) + ["long" * 3_000 + " words" * 300]
    want = [oracle.encode_ordinary(t) for t in texts]
    for together, merged, remembered in ((1, 1, 0), (300, 7, 40), (1 << 20, 1 << 20, 1 << 20)):
        monkeypatch.setattr(bpe, "TOGETHER", together)
        monkeypatch.setattr(bpe, "MERGED", merged)
        monkeypatch.setattr(bpe, "REMEMBERED", remembered)
        assert [np.frombuffer(b, "<u4").tolist() for b in bpe.encode_texts(ours, texts)] == want
