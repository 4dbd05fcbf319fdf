import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from passagework.llm import prefix_trie as p

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    own = defaultdict(list)
    for c, t, r, x in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[1] is not None, r[1] or 0)):
        own[c].append((r or "", x or ""))
    whole = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5 if c >= 0 else -(abs(c) % 5))
        whole[c] = tuple(own.get(base, [])[:h] + own[c][h:])
    members, ends = defaultdict(list), defaultdict(list)
    for c, seq in whole.items():
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
        ends[seq].append(c)
    out = {}
    for k in sorted(members, key=len, reverse=True):
        below = [x for x in members if len(x) == len(k) + 1 and x[: len(k)] == k]
        saved = (len(members[k]) - 1) * (len(k[-1][1].encode()) if k else 0) + sum(out[x][6] for x in below)
        digest = hashlib.sha256(",".join(map(str, sorted(ends[k]))).encode()).hexdigest()
        out[k] = (min(members[k]), len(k), min(members[k[:-1]]) if k else None, len(members[k]), len(below), sum(out[x][5] for x in below) or 1, saved, digest)
    return out


def check(df):
    rows = p.prefix_trie(df).collect()
    expected = brute([tuple(r[c] for c in ("conv_id", "turn", "role", "text")) for r in df.collect()])
    assert sorted(map(repr, (tuple(r[c] for c in COLUMNS) for r in rows))) == sorted(map(repr, expected.values()))
    # Preorder: positions count up from 0, each subtree is an interval as long as it has nodes, parents come before.
    assert sorted(r["position"] for r in rows) == list(range(len(rows)))
    open_ends = []
    for r in sorted(rows, key=lambda r: r["position"]):
        while open_ends and open_ends[-1][0] < r["position"]:
            open_ends.pop()
        assert len(open_ends) == r["depth"] and all(e >= r["subtree_end"] for e, _ in open_ends)
        assert not open_ends or open_ends[-1][1] == r["parent_conv_id"]
        open_ends.append((r["subtree_end"], r["conv_id"]))


@pytest.mark.parametrize("seed", range(2))
def test_random_conversations(spark, seed):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-40, 90), 70):
        for t in range(rng.choice([1, 2, 5, 11, 14])):
            rows.append((c, rng.choice([t, t]) or None, rng.choice(["user", None]), rng.choice(["é", "a", "", None]) if t < 12 else f"t{t}"))
    rows += [(None, 1, "user", "x")] * 3
    rng.shuffle(rows)
    check(spark.createDataFrame(rows, SCHEMA))


def test_long_common_and_repeated_conversations(spark, monkeypatch):
    monkeypatch.setattr(p, "PIECE", 3)
    rows = [(5, t, "user", f"{t}" * 50) for t in range(400)]
    rows += [(c, t, "user", f"{t}" * 50) for c in range(10, 40) for t in range(10 if c % 2 else 2)]
    rows += [(1000 + 5 * c, t, "user", "same") for c in range(60) for t in range(12)]
    check(spark.createDataFrame(rows, SCHEMA).repartition(7))


def test_one_conversation_cut_by_many_ranges(spark):
    """A single conversation that holds nearly all rows, over as many ranges as there are partitions."""
    rows = [(20, t, "user", f"{t}") for t in range(3000)] + [(21, t, "user", f"{t}") for t in range(20)]
    got = {(r["conv_id"], r["depth"]): r for r in p.prefix_trie(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(got) == 3001 and got[20, 3000]["n_leaves"] == 1 and got[20, 20]["n_convs"] == 2 and got[20, 21]["n_convs"] == 1
    assert got[20, 0]["saved_tokens"] == sum(len(f"{t}") for t in range(20)) and got[20, 0]["subtree_end"] == 3000


def test_empty_nulls_and_clashing_columns(spark):
    assert p.prefix_trie(spark.createDataFrame([], SCHEMA)).collect() == []
    assert p.prefix_trie(spark.createDataFrame([(None, 1, "user", "x")], SCHEMA)).collect() == []
    rows = [(1, None, None, None, 1, 2, "a"), (1, 2, "user", "x", 3, 4, "b"), (1, 2, "user", "x", 3, 4, "b"), (3, 1, "user", "y" * 2_000_000, 5, 6, "c")]
    check(spark.createDataFrame(rows, SCHEMA + ", depth int, low int, _range string"))


def test_turns_of_one_number_agree_in_any_layout(spark):
    rows = [(c, t // 3, "user", f"{c % 2}{t}") for c in range(12) for t in range(15)]
    a, b = (sorted(map(tuple, p.prefix_trie(spark.createDataFrame(x, SCHEMA).repartition(n)).select(COLUMNS).collect()), key=repr) for x, n in ((rows, 3), (rows[::-1], 5)))
    assert a == b
