import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as files
import pytest
from tokenizers import Tokenizer

from cardlens.llm.concat import concatenate_and_cut, tokenizer_file, window_edges, word_encoder

SLOW = Tokenizer.from_file(files.path("word_bpe_49k.json"))


def encode(text):
    return SLOW.encode(text or "", add_special_tokens=False).ids + [2]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("capacity", [256, 4096])
def test_every_id_lies_in_one_piece_and_nothing_is_padded(edge, capacity):
    rows = concatenate_and_cut(edge.repartition(3), capacity=capacity, keep_ids=True).collect()
    whole = Counter((r["doc_id"], tuple(encode(r["text"]))) for r in edge.collect())
    # pieces of one document follow each other in the row of all tokens
    place, seqs = {}, defaultdict(list)
    for r in rows:
        assert crc(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == r["length"]
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    at, begin = 0, {}
    for s in sorted(seqs):
        begin[s], end = at, 0
        for offset, length in sorted(seqs[s]):
            assert offset == end
            end += length
        assert end <= capacity and end & (end - 1) == 0
        at += end
    for r in rows:
        place[begin[r["sequence_id"]] + r["offset"] - r["start"], r["start"]] = r
    got, parts = Counter(), []
    for (_, start), r in sorted(place.items()):
        assert r["comes_from"] == (start > 0) and (start == 0) == (not parts)
        parts += r["ids"]
        if not r["goes_on"]:
            assert len(parts) == r["doc_tokens"]
            got[r["doc_id"], tuple(parts)] += 1
            parts = []
    assert got == whole and not parts
    short = sum(1 for s in seqs if sum(n for _, n in seqs[s]) < capacity)
    assert short <= capacity.bit_length() - 1


def test_empty(nothing):
    assert concatenate_and_cut(nothing).collect() == []


def test_edges():
    assert window_edges(0, 8).tolist() == [0]
    assert window_edges(16, 8).tolist() == [16]
    assert window_edges(23, 8).tolist() == [16, 20, 22, 23]


def test_words_encode_as_the_whole_text():
    texts = ["", "  a", "Don't  STOP\n\tx\r\n", "<|startoftext|> a<|endoftext|>b <| x",
             "éÀ ÑÖ é ́x ΣΑΣ ΑΣ.", "a\x0bb \x1cc\x85d e\xa0f g　h", "漢字かな 🙂🙂", "İı ǅ ﬁ",
             "12 3.4 ''s 'll've", "x" * 3000, "a b " * 300, "   a", "​z ﻿q"]
    enc = word_encoder(tokenizer_file())
    for _ in range(2):
        got = [np.frombuffer(b, "<u4").tolist() for b in enc.ids(texts)]
        assert got == [encode(t)[:-1] for t in texts]


def test_fast_words_encode_as_the_slow_library():
    rng = np.random.default_rng(4)
    signs = np.array(list("abcdefghijklmnopqrstuvwxyzABCXYZ0189.,;-'!?()<|>éÀßñÖœŁſǅÿ²½ªİ$&%"))
    syllables = ["th", "ing", "er", "an", "tion", "ou", "re", "ent", "Sch", "ß", "'s", "'ll", "9", "."]
    words = ["".join(rng.choice(signs, int(rng.integers(1, 9)))) for _ in range(4000)]
    words += ["".join(rng.choice(syllables, int(rng.integers(1, 8)))) for _ in range(4000)]
    words += ["<|endoftext|>", "a<|startoftext|>b"]
    enc = word_encoder(tokenizer_file())
    assert enc.fast is not None
    got = [np.frombuffer(b, "<u4").tolist() for b in enc.ids(words)]
    assert got == [encode(w)[:-1] for w in words]


def test_many_random_texts_encode_as_the_slow_library():
    rng = np.random.default_rng(8)
    signs = np.array(list("abstredlvmABSTRE  \n\t''.,;-!?019éÀßñÖœŁſÿ²½ª\xa0\xad&<|>"))
    texts = ["".join(rng.choice(signs, int(rng.integers(0, 60)))) for _ in range(3000)]
    texts += ["'s't're've'm'll'd", "x's 's ''s .'s 's't 'stop 'reed 'llama 'vest 'dd '", "", "\n\n", "'", "'r"]
    got = word_encoder(tokenizer_file()).ids(texts)
    assert [np.frombuffer(b, "<u4").tolist() for b in got] == [encode(t)[:-1] for t in texts]


def test_long_texts_are_cut_between_words(monkeypatch):
    from cardlens.llm import concat
    monkeypatch.setattr(concat, "PASS_CHARS", 50)
    texts = ["it's a test, " * 40, "x" * 200 + " y\n" + "z" * 70, "short", "a" * 120, "b " * 30]
    got = word_encoder(tokenizer_file()).ids(texts)
    assert [np.frombuffer(b, "<u4").tolist() for b in got] == [encode(t)[:-1] for t in texts]
