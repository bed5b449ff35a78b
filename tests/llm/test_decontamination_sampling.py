import random

import pyarrow as pa
import pytest

from cardlens.llm.common import Words
from cardlens.llm.decontamination import Items, allowed, passes

EACH = 100


def spread(item, kind):
    """All allowed edits, evenly spread."""
    out, n, e = list(item), len(item), allowed(len(item))
    for j in reversed(range(e)):
        at = (2 * j + 1) * n // (2 * e)
        if kind == "swap":
            out[at] = f"z{j}"
        elif kind == "drop":
            del out[at]
        else:
            out.insert(at, f"z{j}")
    return out


def found(n, change, seed=6):
    """(windows that pass, texts with such a window) as shares."""
    rng = random.Random(seed + n)
    items = [[f"i{j}x{k}" for k in range(n)] for j in range(EACH)]
    texts = []
    for j, item in enumerate(items):
        around = [f"p{j}x{rng.randrange(10**9)}" for _ in range(70)]
        texts.append(" ".join(around + change(item, rng) + around[::-1]).encode())
    block = Items(list(range(EACH)), [" ".join(x).encode() for x in items])
    words = Words(pa.array(texts, pa.binary()), lower=True)
    row, item, start = block.seeds(words)
    good = passes(block, words, row, item, start)
    return good.mean(), len(set(row[good].tolist())) / EACH


@pytest.mark.parametrize("n, most", [(20, 0.6), (30, 0.4), (50, 0.2)])
def test_unrelated_windows_do_not_pass_by_padding(n, most):
    def triple(item, rng):
        at = rng.randrange(n - 2)
        return item[at:at + 3]
    assert found(n, triple)[0] < most


@pytest.mark.parametrize("kind", ["swap", "drop", "add"])
@pytest.mark.parametrize("n", [10, 20, 30, 59])
def test_recall_with_all_allowed_edits(n, kind):
    assert found(n, lambda item, rng: spread(item, kind))[1] >= 0.97
