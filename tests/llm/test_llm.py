"""Training-data operators against brute force, on small tables with awkward rows."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sondage.llm import ann, components, html_template, linededup, media, mixing, packing, queries, simhash, substring, tokens, toxicity
from sondage.llm._io import Scratch

DOCS = "doc_id long, text string, lang string, source string, n_chars long, task int, h string, score double, n_lines int"
LOWER = {i: i + 32 for i in range(65, 91)}
WORDS = "the quick brown fox jumps over lazy dogs while seven ancient stones rest near cold rivers under pale light".split()


def prose(seed: int, n: int) -> str:
    random = np.random.default_rng(seed)
    return " ".join(WORDS[i] + str(random.integers(30)) for i in random.integers(len(WORDS), size=n))


@pytest.fixture(scope="module")
def awkward(spark):
    passage = prose(99, 60)
    texts = [None, "", "  \n\t", "One line here\nAnother LONGER line\n", "another longer line  \nx", prose(1, 300), prose(1, 300), prose(1, 299) + " end", prose(2, 40) + " " + passage + " " + prose(3, 40), prose(4, 50) + "\n" + passage.upper() + "\n" + prose(5, 10), "Ünïcode 中文 ï​\x1c\xa0x don't 12345", "word " * 3000, "an end <|endoftext|> and a start<|startoftext|>inside"]
    rows = [(i, t, "en", None if i % 4 == 0 else f"s{i % 3}", len(t or ""), 1, "x", 0.0, 7) for i, t in enumerate(texts)]
    rows += [(None, "no id but a line of text", "en", "s1", 24, 1, "x", 0.0, 7), (5, prose(1, 300), "en", "s1", 3, 1, "x", 0.0, 7)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


def encoded(name, text):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.vocabulary(name))
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [0]


def crc(ids):
    return zlib.crc32(np.asarray(ids, dtype="<u4").tobytes())


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.sampled_from([*"aBé'sé中1 \n\t\r\x0b\x0c\x1c\x85\xa0  .,!<|>☃́İΣς", "<|endoftext|>", "<|StartOfText|>", " the", "word "]), max_size=40).map("".join), max_size=4))
def test_pieces_are_exact(name, texts):
    own = tokens.encoder(queries.vocabulary(name)).encode(texts)
    assert own == [np.asarray(encoded(name, t)[:-1], dtype="<u4").tobytes() for t in texts]


def test_token_files(spark, awkward, nothing, tmp_path):
    rows = sorted(((r["doc_id"], r["text"]) for r in awkward.collect()), key=lambda r: (-1 if r[0] is None else r[0], r[1] or ""))
    got = tokens.token_files(awkward, queries.vocabulary("byte_bpe_50k.json"), seq_len=64, rows_per_batch=4).orderBy("start").collect()
    at = 0
    for r, (doc_id, text) in zip(got, rows, strict=True):
        ids = encoded("byte_bpe_50k.json", text)
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (doc_id, at, len(ids), crc(ids))
        at += len(ids)
    assert tokens.token_files(nothing, queries.vocabulary("byte_bpe_50k.json")).count() == 0
    manifest = tokens.write_shards(awkward, f"file://{tmp_path}", queries.vocabulary("byte_bpe_50k.json"), seq_len=64, rows_per_batch=4).orderBy("shard").collect()
    flat = []
    for row in manifest:
        reader = tokens.ShardReader(row["path"])
        for i in range(len(reader)):
            ids, mask = reader.sequence(i)
            assert len(ids) == len(mask) == 64 and not ids.flags.owndata
            flat += ids[np.asarray(mask)].tolist()
        reader.close()
    assert flat == [i for _, t in rows for i in encoded("byte_bpe_50k.json", t)]


def test_packing(awkward, nothing):
    got = packing.pack_documents(awkward, queries.vocabulary("word_bpe_49k.json"), capacity=128).collect()
    texts = defaultdict(list)
    for r in awkward.collect():
        texts[r["doc_id"]].append(encoded("word_bpe_49k.json", r["text"]))
    seen, sequences = defaultdict(int), defaultdict(list)
    for r in got:
        fits = [ids[r["start"] : r["start"] + 128] for ids in texts[r["doc_id"]]]
        assert r["start"] == 128 * r["piece"] and any(len(p) == r["length"] and crc(p) == r["ids_crc32"] for p in fits)
        seen[r["doc_id"]] += r["length"]
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert seen == {k: sum(map(len, v)) for k, v in texts.items()}
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 128
    assert len(sequences) <= -(-sum(seen.values()) // 128) + 1
    assert packing.pack_documents(nothing, queries.vocabulary("word_bpe_49k.json")).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 5), max_size=8), st.integers(1, 60))
def test_fullest_is_the_best_sum(left, room):
    chosen = packing.fullest(room, left, sorted(left, reverse=True))
    sums = {0}
    for length, n in left.items():
        sums = {s + k * length for s in sums for k in range(n + 1) if s + k * length <= room}
    assert sum(k * n for k, n in chosen.items()) == max(sums) and all(n <= left[k] for k, n in chosen.items())


def test_mixing(spark, awkward, nothing):
    rows = mixing.taken(awkward).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted(r["size"] for r in rows) == sorted(size(r["text"]) for r in awkward.collect())
    per = defaultdict(lambda: [0, 0, 0.0])
    for r in rows:
        own = per[r["source"]]
        own[0] += r["taken"]
        own[1] += r["size"]
        own[2] = r["target"]
        assert 0 <= r["taken"] <= 2 * r["size"]
    assert all(t == int(target) <= 2 * s for t, s, target in per.values())
    assert sum(v[2] for v in per.values()) == pytest.approx(1.5 * sum(v[1] for v in per.values()))
    assert sorted(map(tuple, rows), key=repr) == sorted(map(tuple, mixing.taken(awkward.repartition(5)).collect()), key=repr)
    mixed = mixing.mix_documents(awkward)
    assert mixed.columns == awkward.columns
    assert sum(size(r["text"]) for r in mixed.collect()) == sum(r["taken"] for r in rows)
    assert mixing.taken(nothing).count() == 0 and mixing.mix_documents(nothing).count() == 0


def test_mix_of_repeated_rows(spark):
    rows = [(i % 5, prose(i % 5, 40), "en", "s", 1, 1, "x", 0.0, 7) for i in range(20)] + [(None, prose(9, 40), "en", "s", 1, 1, "x", 0.0, 7)] * 4
    docs = spark.createDataFrame(rows, DOCS)
    plan = mixing.taken(docs).agg(F.sum("taken")).first()[0]
    mixed = mixing.mix_documents(docs.withColumn("taken", F.lit("clash")))
    assert sum(len(r["text"].split()) for r in mixed.collect()) == plan == int(1.5 * 24 * 40)


def test_schedule(spark):
    s = np.arange(6000)
    points = mixing.van_der_corput(s)
    assert len(set(points.tolist())) == 6000
    for n, limit in ((0, 1 << 39), (1, 1), (777, 123456789012), (5999, 1 << 40), (3000, 0)):
        assert mixing.points_below(np.array([n]), np.array([limit]))[0] == (points[:n] < limit).sum()
    plan = mixing.Schedule([(False, "a", 5000), (False, "b", 3000), (True, "", 9000)], block=16)
    slots = plan.slot_table(spark).collect()
    assert sorted((r["src"], r["block"]) for r in slots) == [(i, k) for i, n in enumerate(plan.blocks) for k in range(n)]
    start = sorted(slots, key=lambda r: r["slot"])[:200]
    for i, t in enumerate(plan.target):
        assert abs(sum(r["src"] == i for r in start) / 200 - t / sum(plan.target)) < 0.03


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 1000), min_size=1, max_size=7))
def test_targets(sizes):
    own = mixing.targets(sizes, (5, 2, 1), (3, 2), 2)
    assert sum(own) == pytest.approx(1.5 * sum(sizes)) and all(t <= 2 * s + 1e-9 for t, s in zip(own, sizes, strict=True))


def test_line_dedup(awkward, nothing):
    docs = awkward.collect()
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    rank = lambda i: (i is None, i or 0)
    first = {}
    for r in sorted(docs, key=lambda r: rank(r["doc_id"])):
        for line in (r["text"] or "").split("\n"):
            first.setdefault(key(line), r["doc_id"])
    expected = []
    for r in docs:
        lines = (r["text"] or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or first[key(x)] == r["doc_id"]]
        expected.append((r["doc_id"], len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest(), "\n".join(kept)))
    for batches in (1, 3, 5):
        got = linededup.dedup_lines(awkward, batches=batches).select("doc_id", "n_lines", "n_dropped", "kept_sha256", "text").collect()
        assert sorted(map(tuple, got), key=repr) == sorted(expected, key=repr)
    assert linededup.dedup_lines(nothing).count() == 0


def test_line_index_levels(spark):
    keys = lambda a, b: spark.range(a, b).select(F.col("id").alias("k1"), (F.col("id") % 3).alias("k2"))
    with Scratch(spark, "test") as scratch:
        index = linededup.LineIndex(scratch, fan_out=2)
        for i in range(5):
            index.add(index.dealt(keys(i * 10, i * 10 + 10)))
        assert [len(level) for level in index.levels] == [1, 0, 1]
        marked = index.mark(index.dealt(keys(5, 55)))
        assert marked.filter("seen").count() == 45 and marked.count() == 50
        # the one shuffle is that of the batch; no run is shuffled or sorted again
        for plan in (marked, index.merged([name for level in index.levels for name in level])):
            text = plan._jdf.queryExecution().executedPlan().toString()
            assert text.count("Exchange hashpartitioning") == (plan is marked) and "Bucketed: false" not in text and text.count("Bucketed: true") == 2
        index.close()


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(awkward, nothing):
    docs = awkward.collect()
    prints = np.array([brute_fingerprint(r["text"]) for r in docs], dtype=np.uint64)
    i, j = np.nonzero(np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 4)
    root = simhash.spanning(i, j, len(docs))
    named = {}
    for r, k in zip(docs, root, strict=True):
        named[k] = min([x for x in (named.get(k), r["doc_id"]) if x is not None], default=None)
    expected = [(r["doc_id"], f"{int(p):016x}", named[k]) for r, p, k in zip(docs, prints, root, strict=True)]
    assert sorted(map(tuple, simhash.near_duplicates(awkward).collect()), key=repr) == sorted(expected, key=repr)
    assert simhash.near_duplicates(nothing).count() == 0
    stay = simhash.drop_near_duplicates(awkward)
    assert stay.columns == awkward.columns and sorted((r["doc_id"] for r in stay.collect()), key=repr) == sorted({c for _, _, c in expected}, key=repr)


def test_simhash_radius(spark, awkward):
    with pytest.raises(ValueError, match="radius"):
        simhash.near_duplicates(awkward, radius=6)


@pytest.mark.parametrize("room", [1 << 21, 300])
def test_ball_hashing_loses_no_link(spark, room):
    random = np.random.default_rng(3)
    base = random.integers(0, 1 << 63, 30, dtype=np.uint64)
    fps = set(base.tolist())
    for _ in range(400):
        x = int(random.choice(list(fps)))
        for b in random.choice(64, size=random.integers(1, 7), replace=False):
            x ^= 1 << int(b)
        fps.add(x)
    fps = np.array(sorted(fps), dtype=np.uint64)
    i, j = np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4)
    expected = simhash.spanning(i, j, len(fps))
    a, b = simhash.meetings(fps, np.full(len(fps), 2), 64, room)
    assert (np.bitwise_count(fps[a] ^ fps[b]) <= 4).all() and (simhash.spanning(a, b, len(fps)) == expected).all()
    frame = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    links = simhash.fingerprint_links(frame, len(fps)).collect()
    at = {int(x): k for k, x in enumerate(fps.view(np.int64))}
    assert (simhash.spanning(np.array([at[r["a"]] for r in links]), np.array([at[r["b"]] for r in links]), len(fps)) == expected).all()


def test_components(spark):
    pairs = [(1, 2), (2, 3), (3, 4), (9, 8), (8, 9), (7, 7), (None, 1), (20, 21), (21, 22), (22, 20)]
    with Scratch(spark, "test") as scratch:
        got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(pairs, "a long, b long"), scratch).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 8: 8, 9: 8, 20: 20, 21: 20, 22: 20}


def test_toxicity(spark, nothing):
    random = np.random.default_rng(5)
    rows, labels = [], []
    for i in range(600):
        words = [WORDS[k] for k in random.integers(len(WORDS), size=30)]
        toxic = i % 4 == 0
        if toxic:
            words[int(random.integers(30))] = "idiot" if i % 8 else "moronic"
        rows.append((i, " ".join(words), "en", "s", 1, 1, "x", 9.0, 7))
        if i % 3:
            labels.append((i, int(toxic)))
    docs = spark.createDataFrame([*rows, (1000, None, "en", "s", 0, 1, "x", 9.0, 7), (1001, "", "en", "s", 0, 1, "x", 9.0, 7)], DOCS)
    marks = spark.createDataFrame([*labels, (None, 1), (3, None), (4, 1), (4, 1)], "doc_id long, toxic int")
    with Scratch(spark, "test") as scratch:
        machine = toxicity.train(docs, marks, scratch)
    with Scratch(spark, "test") as scratch:
        blank = toxicity.train(docs, marks.limit(0), scratch)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, machine).collect()}
    unseen = [i for i in range(600) if i % 3 == 0]
    assert np.mean([(got[i] >= 0.3) == (i % 4 == 0) for i in unseen]) > 0.98
    assert 0 <= got[1000] == got[1001] < 0.3
    assert all(r["score"] == 0 or r["score"] < 1e-9 for r in toxicity.score(docs, blank).collect())
    kept = toxicity.drop_toxic(docs, marks)
    assert kept.columns == docs.columns and {1000, 1001} <= {r["doc_id"] for r in kept.select("doc_id").collect()}
    assert toxicity.score(nothing, machine).count() == 0


def test_machine_is_a_factorization_machine():
    machine = toxicity.Machine(np.array(sorted({b for w in ("aa", "bb") for b in toxicity.buckets_of(w)})), np.array([0.5, -0.25]), np.array([[1.0, 2.0], [3.0, -1.0]]), 0.1)
    logit = 0.1 + 0.25 + (1 * 3 + 2 * -1)
    assert machine.score(["aa bb"])[0] == pytest.approx(1 / (1 + np.exp(-logit)))
    assert machine.score([None, "zz"]) == pytest.approx([1 / (1 + np.exp(-0.1))] * 2)


def test_nearest(spark):
    random = np.random.default_rng(2)
    x = random.normal(size=(300, 16)).astype(np.float32)
    x[40:80] = x[40]
    rows = [(i, x[i].tolist()) for i in range(300)]
    rows += [(300, None), (301, []), (302, [0.0] * 16), (303, [float("nan")] * 16), (304, [None] * 16), (305, [float("inf")] * 16), (None, x[0].tolist()), (320, [1.0, 2.0]), (7, x[7].tolist())]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = ann.nearest(frame.filter("vec_id % 20 = 0"), frame, k=20, query_rows=5, candidate_rows=60).collect()
    by = defaultdict(list)
    for r in sorted(got, key=lambda r: r["rank"]):
        by[r["query_id"]].append((r["vec_id"], r["score"]))
    assert set(by) == set(range(0, 300, 20))
    wide = x.astype(np.float64)
    for q, own in by.items():
        score = ann.exact(np.repeat(wide[q : q + 1], 300, axis=0), wide)
        order = [i for i in np.lexsort((np.arange(300), -score)) if i != q][:20]
        assert own == [(i, score[i]) for i in order]
    assert ann.nearest(frame.limit(0), frame).count() == 0
    few = frame.filter("vec_id < 5")
    assert ann.nearest(few.filter("vec_id = 0"), few).count() == 4


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 1 << 30))
def test_quantisation_bound_holds(seed):
    random = np.random.default_rng(seed)
    a, b = (random.normal(size=(12, 24)) * random.choice([1e-6, 1, 1e6], size=(12, 1)) for _ in range(2))
    (qa, sa, ea, ka), (qb, sb, eb, _) = ann.quantise(a), ann.quantise(b)
    near = (qa @ qb.T).astype(float) * sa[:, None] * sb[None]
    assert (np.abs(near - a @ b.T) <= (ea[:, None] * np.linalg.norm(b, axis=1)[None] + ka[:, None] * eb[None]) * (1 + 1e-9) + 1e-12 * (1 + np.abs(near))).all()


def brute_windows(docs, size):
    """(id, text) in rank order -> spans of windows that are not the first, united."""
    first, out = {}, set()
    for rank, (doc_id, text) in enumerate(docs):
        words = list(re.finditer(r"[^\x20\x09-\x0D]+", text or ""))
        low, own = [m.group().translate(LOWER) for m in words], []
        for i in range(len(words) - size + 1):
            if first.setdefault(" ".join(low[i : i + size]), (rank, i)) != (rank, i):
                a, b = words[i].start(), words[i + size - 1].end()
                if own and a <= own[-1][1]:
                    own[-1][1] = max(b, own[-1][1])
                else:
                    own.append([a, b])
        out |= {(doc_id, *x) for x in own}
    return out


def brute_units(docs, least, pattern=r"[^\n]+"):
    first, out = {}, set()
    for rank, (doc_id, text) in enumerate(docs):
        for m in re.finditer(pattern, text or ""):
            words = [w.translate(LOWER) for w in re.findall(r"[^\x20\x09-\x0D]+", m.group())]
            if len(words) >= least and first.setdefault(" ".join(words), (rank, m.start())) != (rank, m.start()):
                space = " \t\n\x0b\x0c\r"
                a = m.start() + len(m.group()) - len(m.group().lstrip(space))
                out.add((doc_id, a, a + len(m.group().strip(space))))
    return out


@pytest.mark.parametrize(("size", "common"), [(50, 1000), (50, 0), (51, 1000), (7, 1000), (7, 0)])
def test_repeated_passages(spark, awkward, nothing, size, common):
    spans = substring.repeated_passages(awkward, size=size, least_words=4, common=common)
    rows = spans.collect()
    prints = {(r["doc_id"], r["text"]): r["p"] for r in awkward.withColumn("p", F.xxhash64("text")).collect()}
    # equal rows are one document; null ids come last, equal ids by the print of the text
    docs = sorted(prints, key=lambda r: (r[0] is None, r[0] or 0, prints[r]))
    assert {(r["doc_id"], r["start"], r["end"]) for r in rows if r["unit"] == "window"} == brute_windows(docs, size)
    assert {(r["doc_id"], r["start"], r["end"]) for r in rows if r["unit"] == "line"} == brute_units(docs, 4)
    assert {r["doc_id"] for r in rows} >= {6, 9} and len(rows) == len(set(rows))
    cut = {(r["doc_id"], r["own"]): (r["text"], r["removed"]) for r in substring.remove_spans(awkward.withColumn("own", F.col("text")), spans).collect()}
    for doc_id, text in docs:
        own = [False] * len(text or "")
        for r in rows:
            if r["doc_id"] == doc_id and r["print"] == prints[doc_id, text]:
                own[r["start"] : r["end"]] = [True] * (r["end"] - r["start"])
        left, removed = cut[doc_id, text]
        assert left == (None if text is None else "".join(c for c, gone in zip(text, own, strict=True) if not gone))
        assert sum(b - a for a, b in removed or []) == sum(own)
    assert substring.repeated_passages(nothing).count() == 0


def test_repeated_paragraphs(spark):
    texts = ["one two\nthree four\n\nfive six seven\n \t\n", "FIVE  six\nseven\n\none two three four", "\n\n", "one two"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = substring.repeated_passages(frame, unit="paragraph", least_words=3).collect()
    assert {(r["doc_id"], r["start"], r["end"], r["first_doc"], r["unit"]) for r in got} == {(1, 0, 15, 0, "paragraph"), (1, 17, 35, 0, "paragraph")}


PAGE = '<!DOCTYPE html><html><head><title>T</title><script>var t="</p>";</script></head><body><nav><ul><li><a href="/x">Menu {i}</a></li></ul></nav><div class="ad">Buy {i}</div><article><h1>Head {i}</h1><p>One{i} &amp; <b>tw{i}</b>o{i}<p>three{i}<br>four{i}<div class="comments">nice</div></article><aside>side</aside><form>ask</form><footer>&copy; host</footer>'


def test_main_text(spark):
    pages = [(i, "https://Host.example/a", PAGE.replace("{i}", str(i)) + ("</body></html>" if i % 5 else "")) for i in range(12)]
    pages += [(100, None, None), (101, "", ""), (102, "http://other/", "plain words"), (103, "http://other/", "<main>a<p>b</main><p>c"), (104, "http://third/", '<div class="sidebar">x</div><p>body  text</p><!-- no --><p title="a>b">more'), (0, "https://host.example/a", PAGE)]
    pages += [(105, "http://fourth/", "<article>te<b>x</b>t <i>a</i> b<span class=ad>buy</span>!<p>1 <math><mi>x</mi></math><xmp><i>&amp;</xmp><textarea>f</textarea></article>")]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    for bound in (8 << 20, 0):  # templates sent to all tasks, or joined by host and salt
        got = defaultdict(list)
        for r in html_template.extract(frame, broadcast_bytes=bound).collect():
            got[r["page_id"]].append(r["text"])
            assert r["n_chars"] == len(r["text"])
        for i in range(1, 12):
            assert got[i] == [f"Head {i} One{i} & tw{i}o{i} three{i} four{i}"]
        assert len(got[0]) == 2 and got[100] == got[101] == [""] and got[102] == ["plain words"] and got[103] == ["a b"] and got[104] == ["body text more"]
        assert got[105] == ["text a b! 1 x <i>&amp;"]
    assert html_template.extract(frame.limit(0)).count() == 0


def texts_of(spark, htmls, host="h"):
    frame = spark.createDataFrame([(i, f"http://{host}/{i}", x) for i, x in enumerate(htmls)], "page_id long, url string, html string")
    return [r["text"] for r in html_template.extract(frame).orderBy("page_id").collect()]


@pytest.mark.parametrize("n", [1, 2, 3, 7, 8, 20])
def test_small_hosts_and_equal_pages_keep_their_text(spark, n):
    page = PAGE.replace("{i}", "1")
    expected = "Head 1 One1 & tw1o1 three1 four1"
    assert texts_of(spark, [page] * n) == [expected] * n
    shared = [PAGE.replace("Head {i}", "Same head").replace("{i}", str(i)) for i in range(n)]
    assert texts_of(spark, shared) == [f"Same head One{i} & tw{i}o{i} three{i} four{i}" for i in range(n)]


def test_template_finds_the_text_without_names(spark):
    """No element or class says what it holds: what all pages repeat is the template, what varies is the text."""
    plain = '<html><body><div class="k1"><a href="/">Home</a> <a href="/b">Topics</a></div><div class="k2"><h2>Same head</h2>{t}</div><div class="k3">All rights kept. <div>Read our terms today</div></div></body></html>'
    other = '<html><body><table class="z1"><tr><td>Old site of the host</td></tr></table><div class="z2">{t}</div></body></html>'
    first = [f"<p>First {i} {prose(i, 12)}</p><p>then {prose(i + 50, 9)}</p>" for i in range(6)]
    second = [f"<p>Second {i} {prose(i + 90, 15)}</p>" for i in range(4)]
    text = lambda x: re.sub(r"\s+", " ", re.sub(r"<[^>]*>", " ", x)).strip()
    pages = [plain.replace("{t}", x) for x in first] + [other.replace("{t}", x) for x in second]
    expected = [f"Same head {text(x)}" for x in first] + [text(x) for x in second]
    assert texts_of(spark, pages) == expected  # two layouts of one host
    alone = [html_template.main_text(p) for p in pages]
    assert all(a != e and e in a for a, e in zip(alone, expected, strict=True))
    # a page cut off within its text, and one whose text says nothing new
    cut = [*pages, plain.replace("{t}", f"<p>{prose(7, 20)}")[:-60]]
    assert texts_of(spark, cut)[:-1] == expected and texts_of(spark, cut)[-1].startswith("Same head word") is False
    with Scratch(spark, "test"):
        frame = spark.createDataFrame([(i, f"http://h/{i}", x) for i, x in enumerate(pages)], "page_id long, url string, html string")
        classes = html_template.templates(frame).first()["classes"]
    assert [c["pages"] for c in classes] == [10, 6, 4] and "/html/body/div.k2" in classes[1]["elements"] and "/html/body/div.z2" in classes[2]["elements"] and classes[0]["elements"] == ["", "/html", "/html/body"]


def brute_links(queries, pictures, least=5):
    """Links by every pair of corners whose descriptors share a word, over all pairs of pictures."""
    out = {}
    for qi, (qb, qg) in queries.items():
        for ci, (cb, cg) in pictures.items():
            i, j = np.nonzero((qb[:, None, :] == cb[None, :, :]).any(2)) if len(qb) and len(cb) else (np.zeros(0, int),) * 2
            turn, ratio = cg[j, 3] - qg[i, 3], qg[i, 2] / cg[j, 2]
            dx = cg[j, 0] - ratio * (qg[i, 0] * np.cos(turn) - qg[i, 1] * np.sin(turn))
            dy = cg[j, 1] - ratio * (qg[i, 0] * np.sin(turn) + qg[i, 1] * np.cos(turn))
            n, _ = media.agreement(i, np.log2(ratio), turn, dx, dy)
            if n >= least:
                out[qi, ci] = n
    return out


def test_media(spark):
    rows = [(i, [float(i // 2), 1.0]) for i in range(60)] + [(None, [1.0]), (90, None), (91, []), (92, None)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    pictures = media.textures_of(vectors, "vec_id", "embedding").withColumn("key", F.lit("clash"))
    blank = spark.createDataFrame([(100, 40, 40, bytearray(1600), "x"), (101, 40, 40, None, "x"), (102, 40, 41, bytearray(1600), "x"), (103, 3, 3, bytearray(9), "x"), (104, None, 3, bytearray(9), "x"), (100, 40, 40, bytearray(1600), "x")], pictures.schema)
    asked = media.textures_of(vectors.filter("vec_id % 20 < 2 OR vec_id IS NULL"), "vec_id", "embedding", edit=True).withColumn("key", F.lit("clash")).unionByName(blank)
    members, queries_, links, scratch = media.find_copies(pictures.unionByName(blank), asked)
    with scratch:
        classes = {r["media_id"]: r["class_id"] for r in members.collect()}
        assert classes == {i: i // 2 * 2 for i in range(60)} | {90: 90, 91: 90, 92: 90, 100: 100, 103: 103}
        assert {r["query_id"]: r["query_class"] for r in queries_.collect()} == {i: i // 20 * 20 for i in (0, 1, 20, 21, 40, 41)} | {100: 100, 103: 103}
        got = {(r["query_class"], r["class_id"]): r["corners"] for r in links.collect()}
    described = lambda frame: {r["media_id"]: media.describe(np.frombuffer(r["pixels"], dtype=np.uint8).reshape(r["height"], r["width"])) for r in frame.collect() if r["media_id"] is not None}
    own = {k: v for k, v in described(pictures).items() if classes[k] == k}
    assert got == brute_links({k: v for k, v in described(asked.filter("media_id % 20 = 0 AND media_id < 60")).items()}, own)
    assert set(got) == {(0, 0), (20, 20), (40, 40)}
    empty = pictures.limit(0)
    for a, b in ((empty, asked), (pictures, empty)):
        _, _, none, scratch = media.find_copies(a, b)
        with scratch:
            assert none.count() == 0


def test_media_recall(spark):
    """Edited copies are found, whichever crop, brightness or turn by a quarter; other pictures are not."""
    base = {i: media.texture(str(i).encode()) for i in range(40)}
    edits = {"crop": media.edited, "dark": lambda x: (x * 0.6).astype(np.uint8), "cut": lambda x: x[6:58, 4:60], "turned": np.rot90, "noise": lambda x: np.clip(x.astype(int) + np.random.default_rng(1).integers(-2, 3, x.shape), 0, 255).astype(np.uint8)}
    row = lambda i, x: (i, x.shape[1], x.shape[0], bytearray(np.ascontiguousarray(x).tobytes()))
    schema = "media_id long, width int, height int, pixels binary"
    pictures = spark.createDataFrame([row(i, x) for i, x in base.items()], schema)
    asked = spark.createDataFrame([row(1000 * k + i, edit(x)) for k, edit in enumerate(edits.values(), 1) for i, x in base.items()], schema)
    _, _, links, scratch = media.find_copies(pictures, asked)
    with scratch:
        found = {(r["query_class"], r["class_id"]) for r in links.collect()}
    assert all(q % 1000 == c for q, c in found)
    for k, name in enumerate(edits, 1):
        assert sum((1000 * k + i, i) in found for i in base) >= 0.9 * len(base), name
