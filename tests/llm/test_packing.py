import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as files
from tokenizers import Tokenizer

from cardlens.llm import packing
from cardlens.llm.packing import layout, pack_documents, slots


def encode(text):
    tok = Tokenizer.from_file(files.path("byte_bpe_50k.json"))
    return tok.encode(text or "", add_special_tokens=False).ids + [0]


def test_pieces_equal_tokenizer_and_sequences_are_gapless(spark, edge):
    rows = pack_documents(edge, capacity=256).collect()
    want = defaultdict(list)
    for r in edge.collect():
        ids = encode(r["text"])
        head = len(ids) % 256 or 256
        cuts = [0, *range(head, len(ids) + 1, 256)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[r["doc_id"]].append((k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    got = defaultdict(list)
    for r in rows:
        got[r["doc_id"]].append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    places = defaultdict(list)
    for r in rows:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for p in places.values():
        at = 0
        for offset, length in sorted(p):
            assert offset == at
            at += length
        assert at <= 256
    total = sum(r["length"] for r in rows)
    assert len(places) <= -(-total // 256) + 3


def test_kept_ids_are_the_real_output(edge):
    rows = pack_documents(edge.where("doc_id in (1, 5, 14)"), keep_ids=True).collect()
    assert {(r["doc_id"], tuple(r["ids"])) for r in rows} == {
        (r["doc_id"], tuple(encode(r["text"]))) for r in edge.collect()
        if r["doc_id"] in (1, 5, 14)}


def test_empty(nothing):
    assert pack_documents(nothing).collect() == []


def test_layout_finds_exact_complements():
    # 100 = 60+40 = 50+30+20 = 55+25+15+5
    patterns = layout({60: 4, 40: 4, 50: 3, 30: 3, 20: 3, 55: 2, 25: 2, 15: 2, 5: 2}, 100)
    assert sum(t for t, _ in patterns) == 9
    assert all(sum(p) == 100 for _, p in patterns)


def test_layout_uses_every_piece_once_and_stays_small():
    rng = np.random.default_rng(1)
    lengths = np.r_[rng.integers(1, 129, 5000), np.full(4000, 7), np.ones(3000, int)]
    hist = {int(k): int(c) for k, c in zip(*np.unique(lengths, return_counts=True))}
    patterns = layout(hist, 128)
    used = defaultdict(int)
    for times, parts in patterns:
        assert sum(parts) <= 128
        for x in parts:
            used[x] += times
    assert dict(used) == hist
    assert sum(t for t, _ in patterns) <= -(-int(lengths.sum()) // 128) + 1
    table = slots(patterns)
    assert len(table) < 128 * 12
    assert sorted(map(tuple, table[:, :2])) == list(map(tuple, table[:, :2]))


def test_encoder_equals_slow_library_on_odd_texts():
    enc = packing.encoder(*packing.tokenizer_files())
    for text in ["", " ", "  a", "a ", "a  b", "a\n b\tc \n", "don't we'll I'M", "éà ñ x",
                 "漢字 kana", "\u0085x y", "1 22 333,44", "<|endoftext|> x", "\r\n\r\n a", "a\x0bb",
                 "x" * 3000, "a b " * 500]:
        assert np.frombuffer(enc.ids(text), "<u4").tolist() == encode(text)[:-1], text[:40]
