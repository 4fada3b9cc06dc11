"""SimHash against brute force: fingerprints by the definition, components over all pairs."""

import random
from collections import Counter

import numpy as np
import pytest
import xxhash

from tideline.llm import simhash
from tideline.llm.near_copies import one_of_each
from tideline.llm.simhash import Spec, fingerprint, simhash_components


def brute_fingerprint(text, n=4):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, radius):
    parent = list(range(len(fps)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return [root(i) for i in range(len(fps))]


@pytest.mark.parametrize("text", [None, "", "one", "A b c", "a B c d", "É a\tb\x0bc d e A b c", "x " * 50, "  a b c d e"])
def test_fingerprint_by_definition(text):
    assert fingerprint(None if text is None else text.encode()) == brute_fingerprint(text)


def test_long_text_in_chunks(monkeypatch):
    rng = random.Random(5)
    text = " ".join(rng.choice("ab cde fghij k".split()) * rng.randint(1, 9) for _ in range(500))
    whole = fingerprint(text.encode())
    monkeypatch.setattr(simhash, "CHUNK", 37)
    assert fingerprint(text.encode()) == whole == brute_fingerprint(text)


def test_links_connect_what_brute_force_connects(spark):
    rng = random.Random(7)
    fps = set()
    for _ in range(60):
        base = rng.getrandbits(64)
        for _ in range(rng.choice([1, 2, 5, 40])):
            near = base
            for b in rng.sample(range(64), rng.randint(0, 6)):
                near ^= 1 << b
            fps.add(near)
    fps = sorted(fps)
    rows = [(int(np.uint64(f).view(np.int64)), i) for i, f in enumerate(fps)]
    got = simhash.connected_components(simhash.links(spark.createDataFrame(rows, "fp long, rep long"))).collect()
    named = {r["node"]: r["component"] for r in got}
    assert [named.get(i, i) for i in range(len(fps))] == brute_components(fps, 4)


def test_one_segment_shared_by_most(spark):
    """The entries of a hot segment are cut; what they connect stays the same."""
    rng = random.Random(17)
    fps = {rng.getrandbits(32) << 32 | 0xABCD1234 for _ in range(500)}
    for f in list(fps)[:120]:
        near = f
        for b in rng.sample(range(64), rng.randint(1, 5)):
            near ^= 1 << b
        fps.add(near)
    fps = sorted(fps)
    rows = [(int(np.uint64(f).view(np.int64)), i) for i, f in enumerate(fps)]
    nodes = spark.createDataFrame(rows, "fp long, rep long")
    cut = simhash.table_rows(nodes, 50)
    assert cut.groupBy("key").count().agg({"count": "max"}).first()[0] < 100 < simhash.table_rows(nodes).groupBy("key").count().agg({"count": "max"}).first()[0]
    named = {r["node"]: r["component"] for r in simhash.connected_components(simhash.links(nodes, large=50)).collect()}
    assert [named.get(i, i) for i in range(len(fps))] == brute_components(fps, 4)


def test_a_word_longer_than_a_chunk(monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", 16)
    text = "a b " + "x" * 200 + " c d e " + "y" * 50
    assert fingerprint(text.encode()) == brute_fingerprint(text)


def test_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    fps = [brute_fingerprint(r["text"]) for r in rows]
    order = sorted(range(len(rows)), key=lambda i: rows[i]["doc_id"])
    comp = brute_components([fps[i] for i in order], 4)
    want = {rows[i]["doc_id"]: (fps[i], rows[order[c]]["doc_id"]) for i, c in zip(order, comp, strict=True)}
    got = {r["doc_id"]: (r["fp0"] & (1 << 64) - 1, r["component_id"]) for r in simhash_components(docs).collect()}
    assert got == want
    assert max(Counter(c for _, c in want.values()).values()) > 1


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 9), (2, "", 9), (3, "a b c d e f g h", 9), (3, "a b c d e f g h", 9)], "doc_id long, text string, fp int")
    got = sorted((r["doc_id"], r["component_id"]) for r in simhash_components(docs).collect())
    assert got == [(1, 1), (2, 1), (3, 3), (3, 3)]
    assert simhash_components(docs.limit(0)).count() == 0
    assert sorted(r["doc_id"] for r in one_of_each(docs).collect()) == [1, 3]


def test_distinct_shingles():
    words = b"a b a b c".split()
    shingles = {b"a b", b"b a", b"b c"}
    hashes = [xxhash.xxh64_intdigest(s, 43) for s in shingles]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > 3)
    assert fingerprint(b" ".join(words), Spec(2, False, 43)) == want


def test_stage_catches_near_copies(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    rows = []
    for k in range(40):
        text = [word() for _ in range(300)]
        copy = list(text)
        copy[rng.randrange(300)] = word()
        rows += [(2 * k, " ".join(text)), (2 * k + 1, " ".join(copy))]
    kept = {r["doc_id"] for r in one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {2 * k for k in range(40)} <= kept and len(kept) <= 44
