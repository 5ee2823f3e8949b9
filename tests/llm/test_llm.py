"""Small fixtures against brute force: nulls, empty and repeated rows, ties, extra columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from emberline.llm import exact_dedup, line_dedup, lm_scoring, mixing, near_dedup, packing, quality_classifier, quality_rules, simhash_dedup, substring_dedup, toxicity
from emberline.llm.text import Words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, tag long, key string"


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def passage(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join("w%d" % k for k in rng.integers(0, 300, n))


@pytest.fixture(scope="module")
def texts():
    shared, line = passage(1, 60), "A line that many documents hold, to the letter."
    out = [None, "", "  \n\t ", "one", "One", "a b", shared, shared, "x " + shared + " é ü", passage(2, 50) + " " + shared + " " + passage(3, 20)]
    out += [passage(k, 40 + k) + "\n" + line for k in range(10, 16)] + [line.replace("many", "many!") + "\n" + passage(20, 30)]
    out += [(passage(30, 10) + " ") * 9, "<|endoftext|> it's 12,5 don't!", "ΑΣ Σ. Éá,x", "###" * 50, passage(40, 5000)]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, None if i % 5 == 0 else "en", None if i % 7 == 0 else f"s{i % 3}", 1, "r", 2, "k") for i, t in enumerate(texts)]
    rows.append(rows[8])
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_exact_groups(docs, texts, empty):
    for width in (16, 1):  # one byte: identifiers clash all over, and the texts decide
        got = exact_dedup.exact_groups(docs, width).collect()
        assert len(got) == len(texts) + 1
        same = Counter(lower(t) for t in [*texts, texts[8]])
        for r in got:
            mine = lower(texts[r.doc_id])
            assert (r.group_size, r.text_sha256) == (same[mine], hashlib.sha256(mine.encode()).hexdigest())
            assert r.keep_id == max(i for i, t in enumerate(texts) if lower(t) == mine)
        assert sum(r.kept for r in got) == len(same)
    assert exact_dedup.exact_groups(empty).count() == 0


def test_chunks_cover_text():
    text = passage(5, 20000).encode()
    parts = exact_dedup.chunks(text)
    assert b"".join(parts) == text and max(map(len, parts)) <= exact_dedup.LARGEST
    assert exact_dedup.chunks(b"zz" + text)[-1] == parts[-1]


def test_simhash(docs, texts, empty):
    def fingerprint(t):
        w = WORD.findall(lower(t))
        s = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    prints = [fingerprint(t) for t in texts]
    parent = list(range(len(texts)))

    def root(k):
        return k if parent[k] == k else root(parent[k])

    for i in range(len(texts)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    got = simhash_dedup.near_groups(docs).collect()
    assert len(got) == len(texts) + 1
    assert all((r.fingerprint, r.component_id) == (f"{prints[r.doc_id]:016x}", root(r.doc_id)) for r in got)
    assert simhash_dedup.near_groups(empty).count() == 0
    assert simhash_dedup.representatives(docs).count() == len({root(i) for i in range(len(texts))})


def test_bk_tree_links():
    rng = np.random.default_rng(3)
    base = [int(x) for x in rng.integers(0, 2**62, 20)]
    values = sorted({b ^ (1 << int(k)) ^ (1 << int(j)) for b in base for k, j in rng.integers(0, 60, (6, 2))})
    tree = simhash_dedup.BKTree()
    for v in values:
        near = {tree.nodes[k][0] for k in tree.within(v, 2)}
        assert near == {x for x, _ in tree.nodes if (x ^ v).bit_count() <= 2}
        tree.add(v)


def test_packing_ids():
    """Looked-up parts have the ids of whole texts, whatever accents, cases, marks and signs meet."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.word_bpe_path())
    tokens, rng = packing.Tokens(packing.word_bpe_path(), packing.END_ID), random.Random(3)
    signs = [*"aZhHTJWkKIé\u00c9ßçõ'.,-<|>=%5²½\u0331\u0308\u030a\u030c\u0307\u0338\u0345 \t\n\u00a0\u3000\u0958漢Σςİ…", "'s", "'LL", "<|endoftext|>", "<|ENDOFTEXT|>", "\ufffd", "🙂"]
    texts = ["".join(rng.choices(signs, k=rng.randrange(12))) for _ in range(20_000)] + ["", "H\u0331", "Theswhnd CHIE chie"]
    for a in range(0, len(texts), 5000):
        some = texts[a : a + 5000]
        ids, bounds = tokens.encode([t.encode() for t in some])
        want = [[*e.ids, packing.END_ID] for e in tokenizer.encode_batch(some, add_special_tokens=False)]
        assert [ids[i:j].tolist() for i, j in zip(bounds, bounds[1:], strict=False)] == want


def test_packing(docs, texts, empty):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.word_bpe_path())
    got = packing.pack(docs).toPandas()
    ids = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for i, t in enumerate(texts)}
    for i, own in ids.items():
        mine = got[got.doc_id == i].sort_values("start")
        times = 2 if i == 8 else 1
        assert mine.length.sum() == len(own) * times and set(mine.doc_tokens) == {len(own)}
        for r in mine.itertuples():
            part = np.array(own[r.start : r.start + r.length], "<u4")
            assert r.ids_crc32 == zlib.crc32(part.tobytes()) and list(r.ids) == part.tolist()
    for _, s in got.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert s.length.sum() <= 4096 and s.offset.tolist() == [0, *np.cumsum(s.length)[:-1].tolist()]
    assert packing.pack(empty).count() == 0


def test_mixing(docs, texts, empty):
    got = mixing.mix(docs).toPandas()
    size = [len(WORD.findall(t or "")) for t in texts]
    assert len(got) == len(texts) + 1 and all(r.size == size[r.doc_id] for r in got.itertuples())
    assert ((got.taken >= 0) & (got.taken <= 2 * got["size"])).all()
    for _, s in got.groupby("source", dropna=False):
        assert s.source_size.iloc[0] == s["size"].sum() and abs(s.taken.sum() - s.target.iloc[0]) <= 1
        assert s.target.iloc[0] <= 2 * s["size"].sum()
    one = got.drop_duplicates("source")
    assert abs(one.target.sum() - 1.5 * got["size"].sum()) < 1e-6
    words = mixing.repeated(docs).select(mixing.n_words(F.col("text")).alias("n")).agg(F.sum("n")).first()[0]
    assert abs(words - got.taken.sum()) <= len(one)
    assert mixing.mix(empty).count() == 0


def test_quality_counts(docs, texts, empty):
    got = quality_rules.verdicts(docs).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        t = texts[r.doc_id] or ""
        w = WORD.findall(t)
        c = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        covered = {k + j for k in range(len(w) - 7) if c[tuple(w[k : k + 8])] > 1 for j in range(8)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))
        assert r.base_failed == (len(w) < 20 or 100 * len(covered) > 30 * len(w)) and not (r.kept and r.base_failed)
    assert quality_rules.verdicts(empty).count() == 0
    assert quality_rules.kept(docs).columns == docs.columns


def test_lines(docs, texts, empty):
    seen, out = [], {}
    for i, t in enumerate(texts):
        lines, keep = (t or "").split("\n"), []
        for x in lines:
            if len(x) < line_dedup.MIN_CHARS or not any(line_dedup.within_one_edit(x, y) for y in seen):
                keep.append(x)
            if len(x) >= line_dedup.MIN_CHARS:
                seen.append(x)
        out[i] = (len(lines), len(lines) - len(keep), hashlib.sha256("\n".join(keep).encode()).hexdigest())
    got = line_dedup.summary(docs).collect()
    assert len(got) == len(texts) + 1
    assert all((r.n_lines, r.n_removed, r.kept_sha256) == out[r.doc_id] for r in got)
    assert line_dedup.summary(empty).count() == 0


def test_substrings(docs, texts, empty):
    rows = [*enumerate(texts), (8, texts[8])]
    words = [WORD.findall(t or "") for _, t in rows]
    c = Counter(tuple(w[k : k + 35]) for w in words for k in range(len(w) - 34))
    want = {}
    for (i, _), w in zip(rows, words, strict=True):
        gone = {k + j for k in range(len(w) - 34) if c[tuple(w[k : k + 35])] > 1 for j in range(35)}
        want[i] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    got = substring_dedup.remove_repeats(docs).collect()
    assert len(got) == len(rows) and all((r.n_words, r.n_removed, r.text) == want[r.doc_id] for r in got)
    assert substring_dedup.remove_repeats(empty).count() == 0


def test_lm_scoring(docs, texts, empty):
    got = lm_scoring.score(docs).collect()
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(texts))}
    tokens = [(i, [*WORD.findall(lower(t)), None]) for i, t in [*enumerate(texts), (8, texts[8])]]
    c = Counter(w for i, ws in tokens if not held[i] for w in ws)
    n, v = sum(c.values()), len(c)
    for r in got:
        ws = dict(tokens)[r.doc_id]
        base = sum(np.log10((c[w] + 1) / (n + v + 1)) for w in ws)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(ws), sum(c[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(base) and r.score <= 0
    many = {r.doc_id: r.score for r in lm_scoring.score(docs, round_bytes=3000).collect()}
    assert all(many[r.doc_id] == pytest.approx(r.score) for r in got)
    assert lm_scoring.score(empty).count() == 0


def test_bloom_counts():
    keys = np.random.default_rng(1).integers(0, 2**63, 5000, dtype=np.uint64)
    counts = np.random.default_rng(2).geometric(0.3, 5000)
    parts = {b: lm_scoring.build_filter(keys[keys >> np.uint64(60) == b], counts[keys >> np.uint64(60) == b]).tobytes() for b in range(16) if (keys >> np.uint64(60) == b).any()}
    read = lm_scoring.Filters(4, parts).counts(keys)
    true = 2.0 ** np.floor(np.log2(counts))
    assert (read >= true).all() and (read == true).mean() > 0.97


def test_segments():
    found = toxicity.segments([0, 1, 4, 9], [4.0, -5.0, 3.0, 2.0], -0.5)
    assert found == [(0, 1, 4.0), (4, 5, 3.0), (9, 10, 2.0)]
    assert toxicity.segments([0, 2], [4.0, 3.0], -0.5) == [(0, 3, 6.5)]


@pytest.mark.parametrize("label, score, least", [("toxic", toxicity.toxicity, 0.9), ("quality", quality_classifier.quality, 0.95)])
def test_held_out_accuracy(spark, label, score, least):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = score(spark.read.parquet(f"{sf}/documents.parquet"), labels).join(labels, "doc_id").filter("held_out").toPandas()
    a, b = got[got[label] == 1].score.to_numpy(), got[got[label] == 0].score.to_numpy()
    auc = (a[:, None] > b).mean() + 0.5 * (a[:, None] == b).mean()
    assert auc >= least and (got.predicted == got[label]).mean() >= 0.95


def test_classifiers_take_odd_rows(spark, docs, texts, empty):
    labels = spark.createDataFrame([(1, 0, None), (6, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for score in (toxicity.toxicity, quality_classifier.quality):
        got = score(docs, labels).collect()
        assert len(got) == len(texts) + 1 and all(0 <= r.score <= 1 for r in got)
        assert score(empty, labels.limit(0)).count() == 0


def test_words():
    w = Words([b"", b" a  bc", b"\x0bd\xc3\xa9 "])
    assert w.first.tolist() == [0, 0, 2, 3]
    assert [bytes(w.data[a:b]) for a, b in zip(w.start, w.end)] == [b"a", b"bc", b"d\xc3\xa9"]


def test_pipeline(docs, spark):
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, "").columns == docs.columns
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0


def test_near_dedup_recall(spark):
    """Groups equal components of all pairs of five-word Jaccard similarity 0.8 and more."""
    rng = random.Random(5)
    base = [[f"v{rng.randrange(3000)}" for _ in range(rng.choice((30, 200, 600)))] for _ in range(60)]
    rows = []
    for k, words in enumerate(base):
        for _ in range(4):
            some = [w if rng.random() > (0.0, 0.01, 0.02, 0.03)[k % 4] else "zz" + w for w in words]
            rows.append(" ".join(some))
    rows += [None, " ", "a b", "A b", "a c"]

    def shingles(t):
        w = WORD.findall(lower(t))
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets, parent = [shingles(t) for t in rows], list(range(len(rows)))

    def root(k):
        return k if parent[k] == k else root(parent[k])

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if 5 * len(a & b) >= 4 * len(a | b):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    frame = spark.createDataFrame([(i, t, "x") for i, t in enumerate(rows)], "doc_id long, text string, extra string").repartition(3)
    got = sorted(r.doc_id for r in corpus_pipeline.near(spark, frame, "").collect())
    assert got == sorted({root(i) for i in range(len(rows))})


@pytest.mark.parametrize("keep", [simhash_dedup.representatives, lambda docs: corpus_pipeline.near(None, docs, "")])
def test_near_dedup_odd_ids(spark, keep):
    """Rows with null or repeated ids stay unless their own group has another row."""
    a, b, c, d = (passage(k, 80) for k in (61, 62, 63, 64))
    rows = [(5, a), (5, b), (9, b.upper()), (None, c), (None, d), (None, d), (7, c.upper())]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.text) for r in keep(frame).collect())
    assert got == sorted([(5, a), (5, b), (7, c.upper()), (0, d)])


def test_near_dedup_large_group(spark):
    """Copies that are near their original, and far from each other, are one group with it."""
    rng = random.Random(8)
    words = [f"v{rng.randrange(5000)}" for _ in range(500)]
    rows = [(0, " ".join(words))] + [(k, " ".join(w if rng.random() > 0.018 else "zz" + str(k) + w for w in words)) for k in range(1, 200)]
    got = corpus_pipeline.near(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()

    def shingles(t):
        w = t.split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    sets = [shingles(t) for _, t in rows]
    alone = [k for k in range(1, 200) if all(5 * len(sets[k] & s) < 4 * len(sets[k] | s) for j, s in enumerate(sets) if j != k)]
    assert sorted(r.doc_id for r in got) == [0, *alone]


@pytest.mark.parametrize("pairs, block", [(near_dedup.ALL_PAIRS, near_dedup.BLOCK), (2, 5)])
def test_near_dedup_chains(spark, monkeypatch, pairs, block):
    """Chains under shared keys, each text near the one before and far from the rest, are the groups that all pairs give."""
    monkeypatch.setattr(near_dedup, "ALL_PAIRS", pairs)
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    rng = random.Random(9)
    rows = []
    for _ in range(3):
        words = [f"v{rng.randrange(5000)}" for _ in range(300)]
        for k in range(50):
            words = [w if rng.random() > (0.06 if k % 10 == 0 else 0.008) else f"z{rng.randrange(10**6)}" for w in words]
            rows.append((len(rows), " ".join(words)))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for _, t in rows)]
    near = [[j for j, s in enumerate(sets) if 5 * len(s & x) >= 4 * len(s | x)] for x in sets]
    least = list(range(len(rows)))
    for _ in rows:
        least = [min(least[j] for j in js) for js in near]
    assert 3 < len(set(least)) < len(rows) / 2
    got = near_dedup.kept(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in got) == sorted(set(least))


def test_near_dedup_joining():
    """Links of a block join what all its links join, and none joins a component to itself."""
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 14, 9).astype(np.uint64)) for _ in range(60)]
    roots = [k // 3 for k in range(60)]
    left, right = list(range(25)), list(range(20, 60))

    def groups(pairs):
        least = list(roots)
        for _ in range(60):
            for i, j in pairs:
                m = min(least[i], least[j])
                least = [m if x in (least[i], least[j]) else x for x in least]
        return least

    found = near_dedup.joining(sets, roots, left, right, 0.8)
    whole = [(i, j) for i in left for j in right if near_dedup.similarity(sets[i], sets[j]) >= 0.8]
    assert groups(found) == groups(whole)
    assert len(found) == len(set(roots)) - len(set(groups(whole)))


def test_short_lines(spark):
    """Equal lines go at any length, blank ones stay, and short ones need to be equal."""
    texts = ["Menu\n\nRead more\n  ", "Read more\n\nread more\nMenu\n  ", "Menu\nMenus\n" + "x" * 19, "x" * 19 + "\n" + "x" * 18 + "\n" + "x" * 20]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.text for r in line_dedup.kept(frame).collect()}
    assert got == {0: texts[0], 1: "\nread more\n  ", 2: "Menus\n" + "x" * 19, 3: "x" * 18 + "\n" + "x" * 20}
