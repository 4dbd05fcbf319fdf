"""Merging paragraphs, held against the stated rule in plain Python on small lengths."""

import random
import re

import pytest
from pyspark.sql import functions as F

from passagework.operators import chunk


class Rule:
    """The rule step by step: ``closed`` chunks, the ``tail`` for the next one, the ``open`` one."""

    def __init__(self, target, most, overlap, least, compat):
        self.target, self.most, self.overlap, self.least, self.compat = target, most, overlap, least, compat

    def of(self, text):
        self.closed, self.tail, self.open = [], "", ""
        for p in re.split(r"\n\n+", text or ""):
            if p.strip():
                self.paragraph(p.strip())
        if self.open:
            self.close(self.joined(self.tail, self.open))
        return [c for c in self.closed if len(c) >= self.least]

    @staticmethod
    def joined(*parts):
        return " ".join(p for p in parts if p).strip()

    @staticmethod
    def sentences(t):
        return [s.strip() for s in re.split(r"(?<=[.!?])\s+", t) if s.strip()]

    def close(self, c):
        self.closed.append(c)

    def paragraph(self, p):
        whole = self.joined(self.tail, self.open, p)
        if len(whole) >= self.most:
            return self.by_sentences(p)
        if len(whole) >= self.target:
            self.close(whole)
            s = self.sentences(whole)[-1]
            self.tail, self.open = (s if len(s) <= self.overlap else whole[-self.overlap :]), ""
        else:
            self.open = whole
            self.tail = self.tail * self.compat

    def by_sentences(self, p):
        start = self.tail
        if self.open:
            start = self.open[-self.overlap :]
            self.close(self.joined(self.tail, self.open))
        for s in self.sentences(p):
            if len(start) + 1 + len(s) > self.most:
                self.close(start.strip())
                start = start[-self.overlap :]
            start = self.joined(start, s)
        self.tail, self.open = "", start


@pytest.mark.parametrize("compat", [False, True])
def test_against_the_rule(spark, compat):
    rng = random.Random(compat)
    words = ["a", "be.", "see!", "dé?", "అమ", "x" * 9, "y." * 4, "z" * 50]
    texts = [None, "", " \n\n\t\n\n", "one", "a \n\n b. c"]
    for _ in range(300):
        paras = [rng.choice(["", " "]) + " ".join(rng.choice(words) for _ in range(rng.choice([1, 2, 4, 12, 30]))) for _ in range(rng.randint(1, 8))]
        texts.append(rng.choice(["\n\n", "\n\n\n", "\n\n \n\n"]).join(paras))
    sizes = {"target": 30, "most": 50, "overlap": 8, "least": 4}
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = dict(map(tuple, df.select("i", chunk.merged(F.col("text"), compat=compat, **sizes)).collect()))
    rule = Rule(compat=compat, **sizes)
    assert [got[i] for i in range(len(texts))] == [rule.of(t) for t in texts]


def test_tails_once_and_again(spark):
    df = spark.createDataFrame([("aaaa bbbb. cccc\n\nd\n\ne",)], "text string")
    sizes = {"target": 12, "most": 40, "overlap": 4, "least": 1}
    once, again = df.select(chunk.merged(F.col("text"), **sizes), chunk.merged(F.col("text"), compat=True, **sizes)).first()
    assert once == ["aaaa bbbb. cccc", "cccc d e"] and again == ["aaaa bbbb. cccc", "cccc cccc d e"]


def test_no_python_worker(spark, data):
    from passagework.plans import chunk_queries as q

    for query in (q.chunk_merge, q.chunk_merge_compat, q.markdown_chunks):
        assert "Python" not in (plan := query(spark, data)._jdf.queryExecution().executedPlan().toString()) and "Arrow" not in plan
