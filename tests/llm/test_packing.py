import random
import zlib
from collections import defaultdict

from tokenizers import Tokenizer

from passagework.llm import packing as p
from passagework.llm.tokens import default_path


def check(docs, rows, length):
    library = Tokenizer.from_file(default_path())
    expected = []
    for r in docs.collect():
        ids = b"".join(i.to_bytes(4, "little") for i in [*library.encode(r["text"] or "", add_special_tokens=False).ids, 2])
        for k, (start, n) in enumerate(p.cut(len(ids) // 4, length)):
            expected.append((str(r["doc_id"]), k, start, n, zlib.crc32(ids[4 * start : 4 * (start + n)])))
    assert sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == sorted(expected)
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= length
    return len(bins), -(-sum(e[3] for e in expected) // length)


def test_packs_everything_near_the_bound(awkward, empty):
    used, bound = check(awkward, p.pack_documents(awkward).collect(), p.LENGTH)
    assert used <= bound + max(1, bound // 50)
    assert p.pack_documents(empty).count() == 0


def test_tree_of_groups_gives_a_valid_packing(awkward, monkeypatch):
    monkeypatch.setattr(p, "GROUP", 5)
    monkeypatch.setattr(p, "FAN_IN", 2)
    used, bound = check(awkward, p.pack_documents(awkward, length=300).collect(), 300)
    assert used <= bound * 1.2 + 2


def test_cut():
    assert p.cut(1, 4) == [(0, 1)] and p.cut(4, 4) == [(0, 4)] and p.cut(8, 4) == [(0, 4), (4, 4)]
    assert p.cut(9, 4) == [(0, 1), (1, 4), (5, 4)]


def test_best_fit_is_tight():
    rng = random.Random(2)
    sizes = [rng.randint(1, 100) for _ in range(2000)]
    which, place, fill = p.best_fit(sizes, 100)
    least = max(-(-sum(sizes) // 100), sum(x > 50 for x in sizes))  # two items over half never share a bin
    assert max(fill) <= 100 and len(fill) <= 1.01 * least + 2
    assert sum(f <= 50 for f in fill) <= 1
    assert all(place[i] + sizes[i] <= 100 for i in range(2000)) and max(which) + 1 == len(fill)
