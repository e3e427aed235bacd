"""Benchmark passages against a plain search for every window."""

import hashlib
import random
import re

import pytest

from tillwise.llm.decontamination import contamination

UPPER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER))


def by_search(docs, benchmark):
    windows = {}
    for item, text in benchmark:
        said = words(text)
        n = min(10, len(said))
        if item is not None and n:
            for i in range(len(said) - n + 1):
                windows.setdefault(tuple(said[i : i + n]), set()).add(str(item))
    found = []
    for doc_id, text in docs:
        said, hit, items = words(text), set(), set()
        for n in {len(w) for w in windows}:
            for i in range(len(said) - n + 1):
                if tuple(said[i : i + n]) in windows:
                    hit.update(range(i, i + n))
                    items |= windows[tuple(said[i : i + n])]
        names = hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
        found.append((doc_id, len(said), len(hit), len(items), names, bool(hit)))
    return found


@pytest.mark.parametrize("short_items", [True, False])
def test_planted_passages(spark, short_items):
    pick = random.Random(6)
    vocabulary = [f"w{i}" for i in range(30)] + ["É", "é", "ß", "日本", "Σ", "x1", "The"]
    items = [(i, " ".join(pick.choices(vocabulary, k=pick.randint(10, 30)))) for i in range(12)]
    items += [(3, "another text of the same item as above it has these twelve words"), (50, None), (51, "?!")]
    items += [(None, "an item that has no id and so is left out of all"), (60, items[0][1])]
    if short_items:
        items += [(20, "sole"), (21, "Two Words"), (22, "these are nine words in all É and no more"), (23, "sole")]
    docs = [(100, None), (101, ""), (102, "... !"), (103, items[0][1].upper()), (104, items[0][1].lower())]
    docs += [(105, "two\nwords sole"), (105, "two\nwords sole"), (105, "other"), (None, items[1][1]), (None, "a")]
    for i in range(60):
        parts = pick.choices(vocabulary, k=pick.randint(0, 40))
        for _ in range(pick.randint(0, 3)):
            said = words(pick.choice(items)[1])
            cut = pick.randint(0, max(0, len(said) - 12))
            parts += said[cut : cut + pick.randint(8, 14)] + pick.choices(vocabulary, k=pick.randint(0, 9))
        docs.append((i, pick.choice([" ", ", ", "\n"]).join(parts)))
    table = spark.createDataFrame(
        [(d, t, "x", 1, None) for d, t in docs],
        "doc_id long, text string, item_id string, n int, words array<string>",
    )
    benchmark = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, doc_id int")
    order = lambda row: (row[0] is None, row[0] or 0, row[1:])
    got = sorted(map(tuple, contamination(table, benchmark).collect()), key=order)
    assert got == sorted(by_search(docs, items), key=order)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert contamination(docs.limit(0), items).count() == 0
    row = contamination(docs, items.limit(0)).first()
    assert (row.n_words, row.n_hit, row.n_items, row.contaminated) == (2, 0, 0, False)
