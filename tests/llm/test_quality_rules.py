import re

from pyspark.sql import functions as F

from passagework.llm import quality_rules as q


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = {}
    for w in windows:
        seen[w] = seen.get(w, 0) + 1
    covered = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(re.findall("[A-Z]", text)), len(lines), len(lines) - len(set(lines)), len(covered),
    )


def test_measures_against_brute_force(awkward):
    got = sorted((r["doc_id"] or -1, *(r[m] for m in q.MEASURES)) for r in q.measure(awkward).collect())
    assert got == sorted((r["doc_id"] or -1, *brute(r["text"])) for r in awkward.collect())


def test_policies_and_bits(awkward):
    rows = {r["doc_id"]: r for r in q.quality_rules(awkward).where("doc_id is not null").collect()}
    assert rows[1]["base_failed"] and not rows[1]["kept"]
    assert rows[11]["base_failed"] and rows[14]["base_failed"]
    assert rows[14]["failed"] >> 2 & 1  # symbols
    assert rows[5]["kept"] and rows[4]["failed"] >= 0
    old = {r["doc_id"]: r["kept"] for r in q.quality_rules(awkward, "v1").collect()}
    assert all(old[d] for d, r in rows.items() if r["kept"])


def test_ablations_count_what_only_one_rule_rejects(awkward):
    entries = q.ledger(awkward)
    chosen, rows = q.mask(q.POLICIES["v3"]), [r["failed"] for r in entries.collect()]
    for r in q.ablations(entries).collect():
        bit = q.mask([r["rule"]])
        assert r["n_failed"] == sum(bool(f & bit) for f in rows)
        assert r["n_only_this"] == sum(f & chosen == bit for f in rows)


def test_filtered_keeps_rows_as_they_are(awkward, empty):
    extra = awkward.withColumn("failed", F.lit("clash")).withColumn("n_words", F.lit(-1))
    got = q.filtered(extra)
    assert got.columns == extra.columns and {r["failed"] for r in got.collect()} == {"clash"}
    assert got.count() == q.quality_rules(awkward).where("kept").count()
    assert q.quality_rules(empty).count() == 0
