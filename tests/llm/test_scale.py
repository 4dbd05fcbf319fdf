"""Plans and memory bounds that must hold at any size."""

import random

import numpy as np
import pyarrow as pa
from llm_rows import make

from passagework.llm import quality_rules, secret_scan, simhash_dedup


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_native_operators_run_no_python(awkward):
    for df in (quality_rules.quality_rules(awkward), secret_scan.secret_spans(awkward)):
        assert not any(x in plan(df) for x in ("Python", "Arrow", "Pandas", "CartesianProduct"))
    assert "Exchange" not in plan(quality_rules.filtered(awkward))


def test_verdict_filter_stays_small(awkward):
    text = plan(quality_rules.quality_rules(awkward).where("kept"))
    assert text.count("regexp_replace") < 20


def test_a_hot_key_gives_one_link_per_member():
    rng = random.Random(9)
    fp = np.array(sorted({rng.getrandbits(3) << 61 | rng.getrandbits(8) for _ in range(5000)}), np.uint64)
    batches = [pa.RecordBatch.from_arrays([pa.array(np.full(len(x), 7)), pa.array(x.view(np.int64))], ["key", "fp"]) for x in np.array_split(fp, 9)]
    got = list(simhash_dedup._links(iter(batches)))
    assert sum(b.num_rows for b in got) < len(fp)


def test_copies_meet_as_one_fingerprint(spark):
    docs = make(spark, [(i, "same words here again and again", "s") for i in range(500)])
    assert simhash_dedup.links(simhash_dedup.fingerprints(docs).select("fp").distinct()).count() == 0
    assert {r["component_id"] for r in simhash_dedup.simhash_components(docs).collect()} == {0}
