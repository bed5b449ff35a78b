"""Words that no fixed pattern covers, found by the slots they stand in."""
import random
import re
from collections import Counter, defaultdict

from cardlens.llm import pii
from cardlens.llm.pii import ACCEPT, DISCOUNT, KINDS, RISE, SHORTEST, base_spans, find

WORD = re.compile(r"[^\x20\x09-\x0D]+")
EDGE = "\"'.,;:!?()[]{}<>*#|$%&"


def words_of(text):
    return [(m.start() + len(w) - len(w.lstrip(EDGE)), m.start() + len(w.rstrip(EDGE)),
             w.strip(EDGE)) for m in WORD.finditer(text) for w in [m.group()] if w.strip(EDGE)]


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def around(left, right):
    two = ["", "", *left][-2:]
    return (two[0], two[1], None), (None, two[1], (right or [""])[0])


def brute(rows):
    """The whole bootstrapping in plain Python: found spans by row."""
    near, words, edges, plain = [], [], {}, Counter()
    for at, (_, text) in enumerate(rows):
        text = text or ""
        found, miss = base_spans(text)
        spans = [(k, a, b, True) for k in KINDS for a, b in found[k]] + [(*m, False) for m in miss]
        for k, a, b, seed in spans:
            left = [lower(w.strip(EDGE)) for w in WORD.findall(text[:a]) if w.strip(EDGE)]
            right = [lower(w.strip(EDGE)) for w in WORD.findall(text[b:]) if w.strip(EDGE)]
            name = (k, pii._name(k, text[a:b]), False)
            for p in around(left, right):
                edges[name, p] = (edges.get((name, p), (False, False))[0] or seed, True)
            if not seed:
                near.append((at, k, a, b, name))
        all_words = words_of(text)
        low = [lower(w) for _, _, w in all_words]
        for i, (a, b, w) in enumerate(all_words):
            if not re.search("[0-9@_]", w):
                plain.update(around(low[:i], low[i + 1:]))
            if all(b <= x or a >= y for _, x, y, _ in spans):
                can = b - a >= SHORTEST and bool(re.search("[0-9@_]", w))
                words.append((at, a, b, low[i], can, around(low[:i], low[i + 1:])))
    asked, looked = set(), set()
    while True:
        score = {n: float(any(s for (m, _), (s, _) in edges.items() if m == n)) for n, _ in edges}
        seeds, can = {n for n in score if score[n]}, {n for (n, _), (_, c) in edges.items() if c}
        while True:
            held = defaultdict(list)
            for n, p in edges:
                held[n[0], p].append(score[n])
            trust = {p: sum(v) / (len(v) + DISCOUNT) for p, v in held.items()}
            trust = {p: t for p, t in trust.items() if t > 0.2}
            new = {n: 1.0 if n in seeds else max(
                (trust.get((n[0], p), 0.0) for m, p in edges if m == n and n in can), default=0.0)
                for n in score}
            moved = any(new[n] - score[n] > RISE or new[n] >= ACCEPT > score[n] for n in new)
            score = new
            if not moved:
                break
        good = {n for n in score if n not in seeds and score[n] >= ACCEPT}
        high = {p for p, t in trust.items() if t >= ACCEPT} - asked
        fresh = {n for n in good if n[2]} - looked
        if not high and not fresh:
            break
        asked |= high
        high = {p for p in high if sum(held[p]) >= ACCEPT * (len(held[p]) + DISCOUNT + plain[p[1]])}
        looked |= fresh
        for _, _, _, w, c, pair in words:
            for p in pair:
                for k in KINDS:
                    if (k, p) in high or (k, w, True) in fresh:
                        edges[(k, w, True), p] = (False, c)
    out = defaultdict(set)
    for at, k, a, b, name in near:
        if name in good:
            out[at].add((k, a, b))
    for at, a, b, w, c, _ in words:
        kinds = [(-score[k, w, True], i) for i, k in enumerate(KINDS) if (k, w, True) in good]
        if kinds and c:
            out[at].add((KINDS[min(kinds)[1]], a, b))
    return [(rows[i][0], sorted(out[i])) for i in range(len(rows))]


def got(spark, rows):
    found = find(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    return sorted((r["doc_id"], sorted((s["kind"], s["a"], s["b"]) for s in r["all_spans"]
                                       if s["found"])) for r in found)


def planted(seed):
    rng = random.Random(seed)
    rows, secret, filler = [], set(), ["the", "sum", "of", "all", "Ledgers", "x-1", "r2d2", "page_7"]

    def pad(n):
        return " ".join(rng.choice(filler) for _ in range(n))
    for i in range(40):
        who = [f"u{i}@ex.org", f"+1 (555) 010-{1000 + i}"][i % 2]
        lead = ["My address is", "Please ring"][i % 2]
        rows.append((i, f"{pad(4)}. {lead}: {who}, {pad(5)}"))
    for i in range(12):                     # no pattern of any kind covers these
        who, lead = ((f"user{i}_at_ex", "my address is"), (f"ext-4{i:02}", "please ring"))[i % 2]
        secret.add(who)
        rows.append((100 + i, f"{pad(3)} {lead} ({who}) é🙂 {pad(3)}"))
    for i in range(12):                     # the same words elsewhere
        rows.append((200 + i, f"{pad(6)} {sorted(secret)[i]}! {pad(2)}"))
    for i in range(30):                     # a slot that takes anything
        rows.append((300 + i, f"say to {['a@b.c', 'mum', 'all_of_it', f'n{i}0000', 'w' * i][i % 5]} now"))
    return rows, secret


def test_unseen_words_are_found_wherever_they_stand(spark):
    rows, secret = planted(1)
    odd = [(900, None), (901, ""), (902, "!!! ..."), rows[45], rows[50],
           (903, "my address is " + "z" * 5000 + "1"), (904, "Please ring: " + "q1w2 " * 300),
           (905, "mail:a@b.co,c@d.eu;my address is x_9_y"), (906, "1.2.3.999 my address is")]
    every = got(spark, rows + odd)
    assert every == sorted(brute(rows + odd))
    text = dict(rows)
    named = {(i, text[i][a:b], k) for i, spans in every if i < 900 for k, a, b in spans}
    assert {w for _, w, _ in named} == secret                # precision and recall 1
    assert len(named) == 2 * len(secret)
    assert all(k == ("email" if "_at_" in w else "phone") for _, w, k in named)


def test_found_words_lead_to_further_slots(spark):
    rows = [(i, f"my address is u{i}@ex.org today") for i in range(30)]
    rows += [(100 + i, f"my address is id_{i:03} today") for i in range(20)]
    rows += [(200 + i, f"so write to id_{i:03} soon") for i in range(20)]
    rows += [(300 + i, f"so write to last_{i:03} soon") for i in range(3)]
    out = dict(got(spark, rows))
    assert out == dict(brute(rows))
    assert all(len(out[300 + i]) == 1 for i in range(3))


def test_a_slot_of_plain_words_is_not_trusted(spark):
    rows = [(i, f"send it to u{i}@ex.org now") for i in range(10)]
    rows += [(100 + i, f"send it to {'abcdefghij'[i % 10] * (4 + i // 10)} now") for i in range(20)]
    rows += [(200, "send it to ann_7 now")]
    assert all(not spans for _, spans in got(spark, rows))
