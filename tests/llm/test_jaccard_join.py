import random
import re
from collections import defaultdict

import numpy as np
import pytest
from llm_rows import make

from passagework.llm import jaccard_join as j


def brute_set(text):
    low = re.sub("[A-Z]", lambda m: chr(ord(m[0]) + 32), text or "")
    w = [x for x in re.split("[\x20\x09-\x0d]+", low) if x]
    return frozenset(tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))) if w else frozenset()


def brute(rows):
    """(doc_id, n_shingles, component_id) by all pairs."""
    sets, root = [brute_set(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            shared = len(sets[a] & sets[b])
            if shared and 100 * shared >= 85 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least = defaultdict(list)
    for k, (d, _) in enumerate(rows):
        least[find(k)] += [] if d is None else [d]
    return sorted(((d, len(sets[k]), min(least[find(k)], default=None) if sets[k] else d) for k, (d, _) in enumerate(rows)), key=repr)


def found(df):
    return sorted(map(tuple, j.jaccard_components(df).collect()), key=repr)


def test_awkward_rows(awkward, empty):
    rows = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    assert found(awkward) == brute(rows)
    assert found(empty) == []


@pytest.mark.parametrize("seed", range(2))
def test_families_of_near_copies_in_large_buckets(spark, monkeypatch, seed):
    monkeypatch.setattr(j, "SMALL", 2)
    monkeypatch.setattr(j, "FREQUENT", 4)
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(rng.choice([5, 60, 3000]))]
    base = [[rng.choice(vocabulary) for _ in range(rng.randint(1, 120))] for _ in range(6)]
    rows = []
    for i in range(150):
        words = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        rows.append((rng.choice([i, i, i, None, 7]), None if rng.random() < 0.03 else " ".join(words), "a"))
    assert found(make(spark, rows)) == brute([r[:2] for r in rows])


def test_links_at_exactly_the_least_similarity_and_not_below(spark):
    words = [f"w{i}" for i in range(200)]
    same = lambda n, tag: " ".join(words[: n + 3] + [f"{tag}{i}" for i in range(100 - n)])
    # n shared shingles of 100 each: 92 of 108 are 85.2 %, 91 of 109 are 83.5 %.
    rows = [(1, same(92, "a"), "s"), (2, same(92, "b"), "s"), (3, " ".join(["q"] + words[:94][::-1]) + " " + same(0, "c"), "s"), (4, same(91, "d"), "s")]
    got = {d: c for d, _, c in found(make(spark, rows))}
    assert got == {d: c for d, _, c in brute([r[:2] for r in rows])} and got[2] == 1


def test_clashing_columns(spark):
    df = spark.createDataFrame([(3, "a b c d e", 1, "x", 2), (1, "A B  c d\te", 1, "y", 3)], "doc_id long, text string, sid long, gid string, label int")
    assert found(df) == [(1, 2, 1), (3, 2, 1)]


def test_words_and_long_texts_in_pieces(monkeypatch):
    monkeypatch.setattr(j, "BLOCK", 64)
    texts = ["", "One two", "x" * 300 + " y", " ".join(f"w{i}" for i in range(200)), "é b \x0b c\x1cd", "  "]
    got = list(j._blocks([t.encode() for t in texts]))
    assert [len(g) for g in got] == [len([w for w in re.split("[\x20\x09-\x0d]+", t) if w]) for t in texts]
    whole = [j.word_hashes(t.encode())[0] for t in texts]
    assert all(np.array_equal(a, b) for a, b in zip(got, whole, strict=True))


def test_slots_count_all_documents(spark, monkeypatch):
    monkeypatch.setattr(j, "FREQUENT", 3)
    monkeypatch.setattr(j, "COUNTED", 5)
    rows = [(i, f"one two three four {'five' if i < 4 else i}", "a") for i in range(9)]
    slots, levels = j.frequent(make(spark, rows))
    words = [f"one two three four {x}" for x in ("five", 5)]
    sets = [set((j.shingles(j.word_hashes(w.encode())[0]) >> np.uint64(32)).tolist()) for w in words]
    assert dict(zip(slots.tolist(), levels.tolist(), strict=True)) == {(sets[0] & sets[1]).pop(): 3, (sets[0] - sets[1]).pop(): 2}
    monkeypatch.setattr(j, "MOST_HOT", 1)
    assert len(j.frequent(make(spark, rows))[0]) == 1


def test_places_rule_out_only_pairs_that_cannot_link():
    rng = random.Random(5)
    for _ in range(3000):
        a, b = (sorted(rng.sample(range(40), rng.randint(1, 30))) for _ in range(2))
        shared = set(a) & set(b)
        if shared and 100 * len(shared) >= 85 * len(set(a) | set(b)):
            x = min(shared)
            ia, ib = a.index(x), b.index(x)
            assert ia < len(a) - j.least_shared(len(a)) + 1 and ib < len(b) - j.least_shared(len(b)) + 1
            assert j._fits(*map(np.array, ([len(a)], [ia], [len(b)], [ib])))[0]
