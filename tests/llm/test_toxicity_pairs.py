"""Toxicity where only a pair of rare terms tells."""

import numpy as np

from sondage.llm import toxicity
from sondage.llm._io import Scratch

DOCS = "doc_id long, text string"
CASES = {"none": [], "slur": ["idiot"], "left": ["zugra"], "right": ["mobelin"], "pair": ["zugra", "mobelin"]}
COUNTS = {"none": 2835, "slur": 945, "left": 90, "right": 90, "pair": 30}


def text(random, case):
    words = [f"fill{k}" for k in random.integers(300, size=30)]
    for i, w in enumerate(CASES[case]):
        words[7 * i] = w
    return " ".join(words)


def test_pair_of_rare_terms():
    """Both terms are in 3% of the texts, a quarter of them toxic as of all texts: only their meeting tells."""
    random = np.random.default_rng(4)
    terms = lambda t: np.array([b for w in sorted(toxicity.words_of(t)) for b in toxicity.buckets_of(w)])
    machine = toxicity.fit([(int(case in ("slur", "pair")), terms(text(random, case))) for case, n in COUNTS.items() for _ in range(n)])
    for case in CASES:
        scores = machine.score([text(random, case) for _ in range(40)])
        assert np.mean((scores >= 0.3) == (case in ("slur", "pair"))) >= 0.9, case


def test_rare_slur_has_a_weight():
    random = np.random.default_rng(6)
    terms = lambda t: np.array(sorted({b for w in toxicity.words_of(t) for b in toxicity.buckets_of(w)}))
    rows = [(int(i % 2 == 0), terms(text(random, "slur" if i % 2 == 0 else "none") + " dolt" * (i % 2 == 0 and i < 8))) for i in range(4000)]
    machine = toxicity.fit(rows)
    assert set(toxicity.buckets_of("dolt")) <= set(machine.buckets.tolist())


def test_sampling_keeps_the_prior(spark):
    """Nothing tells but the share of a tenth toxic; 100 of each class are fitted."""
    random = np.random.default_rng(9)
    rows = [(i, text(random, "none")) for i in range(2000)]
    docs = spark.createDataFrame(rows, DOCS)
    marks = spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(2000)], "doc_id long, toxic int")
    with Scratch(spark, "test") as scratch:
        machine = toxicity.train(docs, marks, scratch, per_class=100, least=50)
    assert 0.03 < machine.score([""])[0] < 0.25
