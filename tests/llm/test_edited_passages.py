"""Decontamination with edits of one kind: against brute force over all lengths of a passage."""

import random

import numpy as np
import pytest

from millrace.llm import decontaminate


def last_row(item, words):
    """Edit distance of ``item`` to each prefix of ``words``."""
    row = list(range(len(words) + 1))
    for i, x in enumerate(item, 1):
        new = [i]
        for j, y in enumerate(words, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row


def brute_passages(docs, items, share=0.2):
    """{(doc, item): (edits, first word)} over all starts and lengths."""
    out = {}
    for d, text in docs:
        w = text.encode().lower().split()
        for name, item in items:
            q = item.encode().lower().split()
            k = int(share * len(q))
            best = min(((min(last_row(q, w[s:s + len(q) + k])), s) for s in range(len(w))), default=(k + 1, 0))
            if best[0] <= k:
                out[d, name] = best
    return out


@pytest.mark.parametrize("kind", [0, 1, 2])
def test_edits_of_one_kind_count_once_each(spark, kind):
    rng = random.Random(kind)
    words = [f"w{i}" for i in range(400)]
    say = lambda n: [rng.choice(words) for _ in range(n)]
    items = [(i, " ".join(say(n))) for i, n in enumerate((10, 25, 50, 60))]
    docs = []
    for d in range(40):
        item = items[d % 4][1].split()
        for at in sorted(rng.sample(range(1, len(item) - 1), (16 + d % 5) * len(item) // 100), reverse=True):
            item[at:at + (kind != 1)] = [] if kind == 2 else ["new"]
        docs.append((d, " ".join(say(rng.randrange(0, 30)) + item + say(rng.randrange(0, 30)))))
    docs.append((99, " ".join(say(300))))
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.edits, r.first_word) for r in decontaminate.matches(df, bench).collect()}
    want = brute_passages(docs, items)
    assert {(d, d % 4) for d in range(40)} <= set(want)
    assert set(got) <= set(want) and len(got) >= 0.97 * len(want)
    assert all(got[k][0] >= want[k][0] for k in got) and sum(got[k] == want[k] for k in got) >= 0.9 * len(got)
    assert {r.doc_id for r in decontaminate.clean(df, bench).collect()} == {d for d, _ in docs} - {d for d, _ in got}


def test_free_end_distances_are_exact_up_to_the_bound():
    rng = np.random.default_rng(4)
    items, windows = rng.integers(0, 4, (200, 12)), rng.integers(0, 4, (200, 17))
    windows[:100, :10] = items[:100, 2:]
    want = [min(last_row(x.tolist(), y.tolist())) for x, y in zip(items, windows)]
    got = decontaminate.distances(windows, items, 5, free_end=True)
    assert all(g == w if w <= 5 else g > 5 for g, w in zip(got.tolist(), want)) and min(want) <= 2 < 5 < max(want)
