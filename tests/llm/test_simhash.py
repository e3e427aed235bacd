"""SimHash groups against all pairs, and the guarantees of the Golay keys."""

import random
import re

import numpy as np
import pytest
import xxhash

from tillwise.llm import simhash
from tillwise.llm.registry import llm_queries

UPPER = {c: c + 32 for c in range(65, 91)}


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
    runs = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(run.encode(), 42) for run in runs] if words else []
    return sum((2 * sum(h >> i & 1 for h in hashes) > len(hashes)) << i for i in range(64))


def plain_components(ids, prints):
    parent = list(range(len(ids)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                parent[find(i)] = find(j)
    least = {}
    for i, id_ in enumerate(ids):
        if id_ is not None:
            least[find(i)] = min(least.get(find(i), id_), id_)
    return [least.get(find(i)) for i in range(len(ids))]


def corpus(seed):
    pick = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["É", "é", "日本", "Ünder"]
    texts = [None, "", " \t\n\x0b", "one", "ONE", "two  words", "three small words", "É\x85x y"]
    for _ in range(30):
        base = pick.choices(words, k=pick.randint(1, 200))
        for _ in range(pick.randint(1, 5)):
            changed = list(base)
            for _ in range(pick.randint(0, 3)):
                changed[pick.randrange(len(changed))] = pick.choice(words)
            texts.append(pick.choice([" ", "\n", "\x0c "]).join(changed).title())
    return texts


def test_perfect_code():
    words = np.random.default_rng(3).integers(0, 1 << 23, 2000)
    index = simhash.decode(words)
    # Every word within three bits of a codeword has its index, and indices are 12 bits.
    for flips in ((0,), (5,), (22, 1), (7, 9, 20)):
        code = words ^ simhash._error_patterns()[simhash._remainders(words)]
        noisy = code ^ sum(1 << f for f in flips)
        assert (simhash.decode(noisy) == index).all()
    assert index.min() >= 0 and index.max() < 4096


def test_near_fingerprints_share_a_key():
    pick = random.Random(5)
    for _ in range(3000):
        one = pick.getrandbits(64)
        other = one
        for bit in pick.sample(range(64), pick.randint(0, 3)):
            other ^= 1 << bit
        both = np.array([one, other], dtype=np.uint64)
        key, place, own = simhash.keys_of(both)
        shared = set(key[(place == 0) & own]) & set(key[place == 1])
        assert shared
        some = np.isin(key, list(shared))
        longer, back, mine = simhash.keys_again(key[some], both[place[some]])
        owner, was = place[some][back], own[some][back]
        assert set(longer[(owner == 0) & mine & was]) & set(longer[owner == 1])


def test_links_connect_what_pairs_connect():
    pick = random.Random(8)
    values = [pick.getrandbits(64) for _ in range(40)]
    for _ in range(200):
        values.append(pick.choice(values) ^ (1 << pick.randrange(64)) ^ (1 << pick.randrange(64)))
    values = np.unique(np.array(values, dtype=np.uint64))
    group = simhash.linked(values)
    expected = plain_components(list(range(len(values))), values.tolist())
    assert len(set(group)) == len(set(expected)) == len(set(zip(group, expected, strict=True)))
    a, b = simhash.tree_links(values, group)
    assert len(a) == len(values) - len(set(group))


@pytest.mark.parametrize("large", [4096, 3])
def test_all_pairs(spark, monkeypatch, large):
    monkeypatch.setattr(simhash, "LARGE", large)
    texts = corpus(large)
    ids = [*range(len(texts))]
    ids[4] = ids[9] = None
    rows = [(i, t, 1, "x", 2) for i, t in zip(ids, texts, strict=True)]
    rows += rows[10:13]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key int, root string, fingerprint int")
    prints = [plain_fingerprint(row[1]) for row in rows]
    expected = zip([row[0] for row in rows], prints, plain_components([r[0] for r in rows], prints), strict=True)
    got = [tuple(row) for row in simhash.near_duplicates(docs).collect()]
    assert sorted(got, key=str) == sorted([(i, f"{p:016x}", c) for i, p, c in expected], key=str)


def test_family_of_many_members(spark):
    """A line of fingerprints, each two bits from the next, and copies of one text."""
    at, values = 0, []
    for i in range(300):
        at ^= (1 << (i * 7) % 64) ^ (1 << (i * 11 + 3) % 64)
        values.append(at)
    distinct = spark.createDataFrame([(v - (v >> 63 << 64),) for v in set(values)], "fingerprint long")
    found = simhash.links(distinct).collect()
    parent = {row[0]: row[0] for row in distinct.collect()}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in found:
        parent[find(a)] = find(b)
    assert len({find(x) for x in parent}) == 1


def test_pieces(monkeypatch):
    texts = corpus(2)
    monkeypatch.setattr(simhash, "PIECE", 40)
    assert [simhash.fingerprint(t or "") for t in texts] == [plain_fingerprint(t) for t in texts]


def test_empty(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_documents(spark):
    folder = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    prints = [plain_fingerprint(text) for _, text in rows]
    components = plain_components([row[0] for row in rows], prints)
    expected = sorted(zip([r[0] for r in rows], [f"{p:016x}" for p in prints], components, strict=True))
    got = llm_queries()["op11_simhash"](spark, folder).collect()
    assert sorted(tuple(row) for row in got) == expected
