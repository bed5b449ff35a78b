import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as files
import pytest
import sentencepiece
from tokenizers import Tokenizer

from cardlens.llm.alignment import align, merge, op12_tokenizer_alignment, rate_links
from cardlens.llm.common import stored

A = Tokenizer.from_file(files.path("byte_bpe_50k.json"))
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=files.path("piece_bpe_32k.model"))


def byte_alphabet():
    """The byte-level alphabet: printable bytes stand for themselves, the rest
    for characters from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [x for x in range(256) if x not in own]
    return {chr(x): x for x in own} | {chr(256 + i): x for i, x in enumerate(other)}


ALPHABET = byte_alphabet()


def tokens(text):
    if not text:
        return [], []
    a = [(i, bytes(ALPHABET[c] for c in A.id_to_token(i)))
         for i in A.encode(" " + text, add_special_tokens=False).ids]
    b = []
    for i in B.encode(text):
        p = B.id_to_piece(i)
        b.append((i, bytes([int(p[3:5], 16)]) if B.is_byte(i) else p.replace("▁", " ").encode()))
    raw = (" " + text).encode()
    if any(b"".join(x for _, x in s) != raw for s in (a, b)):
        return [], []
    return a, b


def groups(a, b):
    """[(A ids, B ids)] by the plainest loop."""
    out, i, j, x, y, ga, gb = [], 0, 0, 0, 0, [], []
    while i < len(a) or j < len(b):
        if x <= y and i < len(a):
            x += len(a[i][1])
            ga.append(a[i][0])
            i += 1
        else:
            y += len(b[j][1])
            gb.append(b[j][0])
            j += 1
        if x == y and ga and gb:
            out.append((ga, gb))
            ga, gb = [], []
    assert not ga and not gb
    return out


def expected(rows):
    own = [(d, *tokens(t)) for d, t in rows]
    own = [(d, a, b, groups(a, b)) for d, a, b in own]
    count = Counter((ga[-1], gb[-1]) for *_, g in own for ga, gb in g)
    best = defaultdict(int)
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    out = []
    for d, a, b, g in own:
        links = [(ga[-1], gb[-1]) for ga, gb in g]
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g)
        out.append((d, len(a), len(b), len(g), len(links),
                    sum(count[k] == best[k[1]] for k in links), sum(count[k] for k in links), text))
    return sorted(out, key=repr)


EXTRA = [(20, "<s> a </s> <unk> <0x41> <|endoftext|>"), (21, "▁x y"), (22, " lead  and trail "),
         (23, "a\nb\n\nc\td\r\ne"), (24, "\x00 nul\x0b"), (25, "naïve ﬁne ½ Ǆ x́ e\xa0f"),
         (26, "don't we'll 1234567 3.14 http://x.y/z?q=1"), (27, "日本語 のテキスト 🙂🙂👩‍👩‍👧"),
         (28, "internationalization antidisestablishmentarianism"), (29, " "), (30, "\u0085 ")]


@pytest.fixture(scope="module")
def table(spark, edge):
    more = spark.createDataFrame(EXTRA, "doc_id long, text string")
    return edge.select("doc_id", "text").unionByName(more)


@pytest.mark.parametrize("hot_bits", [4, 18])
def test_equals_brute_force(table, hot_bits):
    """With few hot pairs nearly all links take the join, with many none."""
    rows = rate_links(stored(align(table.repartition(3))), hot_bits).collect()
    got = sorted(((r["doc_id"], r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"],
                   r["count_sum"], r["groups"]) for r in rows), key=repr)
    assert got == expected([(r["doc_id"], r["text"]) for r in table.collect()])


def test_query_columns(spark, table, tmp_path):
    table.write.parquet(f"{tmp_path}/documents.parquet")
    rows = op12_tokenizer_alignment(spark, str(tmp_path)).collect()
    want = [(*x[:-1], hashlib.sha256(x[-1].encode()).hexdigest() if x[-1] else "")
            for x in expected([(r["doc_id"], r["text"]) for r in table.collect()])]
    assert sorted(map(tuple, rows), key=repr) == sorted(want, key=repr)
    assert {r["doc_id"]: r["n_a"] for r in rows}[21] == 0


def test_empty(nothing):
    assert rate_links(stored(align(nothing))).collect() == []


def test_merge_of_random_ends():
    rng = np.random.default_rng(3)
    ends_a, ends_b, first_a, first_b, stop_a, want, base = [], [], [], [], [], [], 0
    for _ in range(200):
        n = int(rng.integers(0, 60))
        a = np.union1d(rng.choice(n, rng.integers(0, n + 1), False) + 1, [n]) if n else np.empty(0, int)
        b = np.union1d(rng.choice(n, rng.integers(0, n + 1), False) + 1, [n]) if n else np.empty(0, int)
        first_a.append(len(ends_a))
        first_b.append(len(ends_b))
        ends_a += (a + base).tolist()
        ends_b += (b + base).tolist()
        stop_a.append(len(ends_a))
        want += (np.intersect1d(a, b) + base).tolist()
        base += n
    a, b = np.array(ends_a), np.array(ends_b)
    x, y = merge(a, b, np.array(first_a), np.array(first_b), np.array(stop_a))
    assert a[x].tolist() == b[y].tolist() == want
