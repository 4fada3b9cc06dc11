"""The near-dedup stage against all pairs by the definition."""

import random

from tideline.llm.near_copies import near_copy_components, one_of_each


def brute_sets(text):
    words = (text or "").encode().lower().split()
    n = min(5, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set()


def brute_kept(rows, threshold=0.8):
    """The ids (distinct) that stay: the least of every component of the pairs at the threshold."""
    rows = sorted(rows)
    sets = [brute_sets(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            small, large = sorted((len(sets[i]), len(sets[j])))
            if small < threshold * large:
                continue
            shared = len(sets[i] & sets[j])
            if sets[i] == sets[j] or shared >= threshold * (small + large - shared) - 1e-9:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {rows[k][0] for k in range(len(rows)) if root(k) == k}


def test_against_all_pairs(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = brute_kept([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])
    got = one_of_each(docs)
    assert got.columns == docs.columns
    assert {r["doc_id"] for r in got.collect()} == want and len(want) < docs.count()


def test_edited_texts_on_both_sides_of_the_threshold(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    rows = [(1000, "a b c"), (1001, "A  b c"), (1002, "a b d"), (1003, None), (1004, " ")]
    for k in range(60):
        text = [word() for _ in range(120)]
        copy = list(text)
        for at in range(k % 6):  # 1 to 5 far-apart words: Jaccard 0.92, 0.84, 0.77, 0.71, 0.65
            copy[10 + 20 * at] = word()
        rows += [(2 * k, " ".join(text)), (2 * k + 1, " ".join(copy))]
    got = {r["doc_id"] for r in one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_kept(rows)
    assert 1 not in got and 3 not in got and 5 not in got and {7, 9, 11, 1000, 1002, 1003} <= got


def test_a_dense_group_and_a_shared_passage(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    base, passage = [word() for _ in range(200)], " ".join(word() for _ in range(60))
    rows = [(k, " ".join(w if at != k else word() for at, w in enumerate(base))) for k in range(150)]
    rows += [(1000 + k, " ".join(word() for _ in range(40)) + " " + passage) for k in range(50)]
    got = {r["doc_id"] for r in one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0, *range(1000, 1050)}


def test_null_and_repeated_ids(spark):
    rows = [(None, "only here a b c d", 0), (7, "one text p q r s", 1), (7, "another text t u v w", 2), (None, "twice x y z k", 3), (9, "twice x y z k", 4), (None, "thrice l m n o", 5), (None, "thrice l m n o", 6)]
    got = one_of_each(spark.createDataFrame(rows, "doc_id long, text string, n int")).collect()
    kept = {r["n"] for r in got}
    assert {0, 1, 2, 4} <= kept and 3 not in kept and len(kept & {5, 6}) == 1 and len(got) == 5


def test_large_buckets_in_pieces(spark, monkeypatch):
    from tideline.llm import near_copies as N

    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    rows = []
    for g in range(3):  # a dense group, and a chain whose ends lie far apart
        base = [word() for _ in range(150)]
        rows += [(1000 * g + k, " ".join(w if at != k else word() for at, w in enumerate(base))) for k in range(40)]
        drift = list(base)
        for k in range(30):
            drift[5 * k] = word()
            rows.append((1000 * g + 500 + k, " ".join(drift)))
    rows += [(9000, None), (9001, "a b c d e f"), (9002, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_kept(rows)
    for piece in (600, 3000):
        monkeypatch.setattr(N, "near_copy_components", lambda a, b, t, f=near_copy_components, p=piece: f(a, b, t, p))
        assert {r["doc_id"] for r in N.one_of_each(docs).collect()} == want
    assert N.one_of_each(docs.limit(0)).count() == 0


def test_fingerprint_tables_find_near_copies_without_bands(spark):
    from tideline.llm.near_copies import SPEC
    from tideline.llm.simhash import fingerprint

    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    rows = []
    for k in range(40):
        text = [word() for _ in range(120)]
        copy = list(text)
        for at in range(k % 5):  # 0 to 4 far-apart words: Jaccard 1 to 0.71
            copy[10 + 20 * at] = word()
        rows += [(2 * k, " ".join(text)), (2 * k + 1, " ".join([*copy, *copy[:5]]))]  # what is added makes new shingles and word pairs
    sets = dict((i, brute_sets(t)) for i, t in rows)
    marks = {i: fingerprint(t.encode(), SPEC) for i, t in rows}
    want = set()
    for i in range(0, 80, 2):
        if (marks[i] ^ marks[i + 1]).bit_count() <= 4 and len(sets[i] & sets[i + 1]) >= 0.8 * len(sets[i] | sets[i + 1]):
            want.add((i + 1, i))
    assert len(want) > 5
    nodes = spark.createDataFrame([(i, len(sets[i]), []) for i, _ in rows], "rep long, size long, keys array<long>")
    found = near_copy_components(nodes, spark.createDataFrame([(i, t.encode()) for i, t in rows], "rep long, text binary"))
    assert {(r["node"], r["component"]) for r in found.collect() if r["node"] != r["component"]} == want
