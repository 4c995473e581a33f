"""The near-copy stage against brute force over all pairs of shingle sets."""

import numpy as np

import corpus_pipeline
from sondage.llm import nearcopies, simhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def brute_sets(text):
    parts = (text or "").lower().split()
    return {tuple(parts[i : i + 5]) for i in range(max(1, len(parts) - 4))} if parts else set()


def brute_kept(rows):
    sets = [brute_sets(t) for _, t in rows]
    near = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    root = simhash.spanning(np.array([i for i, _ in near], dtype=int), np.array([j for _, j in near], dtype=int), len(rows))
    return sorted(min(rows[k][0] for k in range(len(rows)) if root[k] == r) for r in set(root.tolist()))


def test_near_copies(spark):
    random = np.random.default_rng(8)
    word = lambda: f"w{random.integers(1 << 40)}"
    rows = []
    for edits in (1, 3, 5, 6, 12, 20):  # of 300 words: similarity 0.97 down to 0.5
        base = [word() for _ in range(300)]
        rows.append(base)
        for _ in range(6):
            own = list(base)
            for at in random.choice(np.arange(5, 295), size=edits, replace=False):
                own[at] = word()
            rows.append(own)
    chain = [word() for _ in range(300)]
    for step in range(12):  # neighbours are near, the ends are not
        chain[20 + 20 * step] = word()
        chain[25 + 20 * step] = word()
        rows.append(list(chain))
    texts = [" ".join(r) for r in rows] + [" ".join(rows[0]).upper(), "", None, "two words", "Two  words", "two others"]
    order = random.permutation(len(texts))
    docs = [(int(i), texts[k]) for i, k in enumerate(order)]
    frame = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], DOCS).repartition(3)
    got = corpus_pipeline.drop_near_copies(spark, frame, "")
    assert got.columns == frame.columns
    assert sorted(r["doc_id"] for r in got.collect()) == brute_kept(docs)
    assert nearcopies.drop_near_copies(frame.limit(0)).count() == 0


def test_simhash_links_join(spark):
    """Texts whose fingerprints are within 4 bits are one document for the stage, also where their shingles share less than 0.8: a
    line that stands 400 times in both outweighs what is their own."""
    random = np.random.default_rng(3)
    head = " ".join(["the same line of words"] * 400)
    texts = [f"{head} " + " ".join(f"t{random.integers(1 << 40)}" for _ in range(40)) for _ in range(2)]
    prints = [simhash.fingerprint(t) for t in texts]
    sets = [nearcopies.shingles_of(nearcopies.words_of(t)) for t in texts]
    assert (prints[0] ^ prints[1]).bit_count() <= 4 and nearcopies.similarity(*sets) < 0.8
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate([*texts, "another text"])], DOCS)
    assert sorted(r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()) == [0, 2]
