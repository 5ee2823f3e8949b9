"""Methods against plain versions of them, and rows, texts and sessions out of the ordinary."""

import math
import os
import random
import re
import subprocess
import sys
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from emberline.llm import exact_dedup, line_dedup, lm_scoring, mixing, near_dedup, packing, quality_classifier, quality_rules, simhash_dedup, substring_dedup, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, row string, key string, size long, t long, part int"
REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def passage(seed, n, size=300):
    return " ".join("w%d" % k for k in np.random.default_rng(seed).integers(0, size, n))


def frame(spark, rows):
    return spark.createDataFrame([(*r, "r", "k", 1, 2, 3) for r in rows], SCHEMA)


def labels(spark):
    rows = [(k, k % 2, k % 3 == 0 and 1 or 0) for k in range(40)] + [(3, 1, 1), (None, 1, 1), (5, None, None)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def odd(spark):
    """Null and repeated ids, null columns, repeated rows, texts from none to a hundred thousand words, clashing columns."""
    long = passage(1, 100_000, 50_000)
    rows = [(k % 30, passage(k, 30 + k), "en", "s") for k in range(40)] + [(None, passage(100, 60), None, None)] * 3
    rows += [(None, None, None, "s"), (7, "", "en", None), (8, None, None, None), (9, " \n\t", "en", "s"), (50, long, "en", "s"), (51, "x" * 300_000, "en", "s")]
    return frame(spark, rows).repartition(3), len(rows)


OPERATORS = {
    "lm": lambda d, l: lm_scoring.score(d),
    "substrings": lambda d, l: substring_dedup.remove_repeats(d),
    "mixing": lambda d, l: mixing.mix(d),
    "rules": lambda d, l: quality_rules.verdicts(d),
    "toxicity": lambda d, l: toxicity.toxicity(d, l),
    "exact": lambda d, l: exact_dedup.exact_groups(d),
    "lines": lambda d, l: line_dedup.summary(d),
    "classifier": lambda d, l: quality_classifier.quality(d, l),
    "simhash": lambda d, l: simhash_dedup.near_groups(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_a_row(spark, odd, name):
    docs, n = odd
    got = OPERATORS[name](docs, labels(spark)).select("doc_id").collect()
    assert Counter(r.doc_id for r in got) == Counter(r.doc_id for r in docs.select("doc_id").collect()) and len(got) == n


def test_packing_of_odd_rows(odd):
    docs, n = odd
    got = packing.pack(docs, with_ids=False).toPandas()
    assert got[got.start == 0].shape[0] == n and (got.groupby("sequence_id").length.sum() <= 4096).all()


def test_stages_take_odd_rows(spark, odd):
    docs, _ = odd
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, "").columns == docs.columns
        assert stage(spark, docs.limit(0), "").count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), "").count() == 0


def test_workers_need_no_copy_of_the_package(tmp_path):
    code = f"""
import sys; sys.path.insert(0, {REPO!r})
from emberline.session import local_session
from emberline.llm import lm_scoring, quality_classifier, toxicity
spark = local_session(2, memory="1g", partitions=2)
docs = spark.createDataFrame([(k, "some words of text %d" % k) for k in range(9)], "doc_id long, text string")
labels = spark.createDataFrame([(k, k % 2, k % 2) for k in range(9)], "doc_id long, quality int, toxic int")
assert lm_scoring.score(docs).count() == 9 and len(lm_scoring.score(docs).collect()) == 9
assert len(toxicity.toxicity(docs, labels).collect()) == len(quality_classifier.quality(docs, labels).collect()) == 9
print("all ran")
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "all ran" in out.stdout, out.stderr[-2000:]


def test_lm_scores(spark, monkeypatch):
    """Scores equal the formula over exact levels, with filters too large for false positives, in one round or many."""
    monkeypatch.setattr(lm_scoring, "BITS", 60)
    monkeypatch.setattr(lm_scoring, "BLOCK", 4000)
    texts = [passage(k, 5 + 7 * k, 12) for k in range(40)] + [None, "", "A a A a A a"]
    held = [zlib.crc32(str(k).encode()) % 7 == 2 for k in range(len(texts))]
    tokens = [[w.lower() for w in WORD.findall(t or "")] + [None] for t in texts]
    c, pairs = Counter(), Counter()
    for ws, out in zip(tokens, held):
        if not out:
            c.update(ws)
            pairs.update(zip([None, *ws], ws))
    total, distinct = sum(c.values()), len(c)
    level = {p: 2 ** int(math.log2(n)) for p, n in pairs.items()}
    sums = defaultdict(int)
    for (v, _), q in level.items():
        sums[v] += q
    want = []
    for ws in tokens:
        s = 0.0
        for v, w in zip([None, *ws], ws):
            p = (c[w] + 1) / (total + distinct + 1)
            s += math.log10(0.4 * level.get((v, w), 0) / sums[v] + 0.6 * p if sums[v] else p)
        want.append(s)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for size in (1 << 20, 300):
        got = lm_scoring.score(docs, round_bytes=size).collect()
        assert len(got) == len(texts) and all(r.score == pytest.approx(want[r.doc_id]) for r in got)


def test_context_adds_up():
    """Probabilities after a context add up to one."""
    level, c = {"a": 4, "b": 1}, {"a": 5, "b": 1, "c": 9}
    floor = sum(c.values()) + len(c) + 1
    p = [0.4 * level.get(w, 0) / sum(level.values()) + 0.6 * (n + 1) / floor for w, n in c.items()]
    assert sum(p) + 0.6 / floor == pytest.approx(1)


def test_parts_of_many_ids(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED_IDS", 1 << 30)
    tokens = packing.Tokens(packing.word_bpe_path(), packing.END_ID)
    many = 2**24 + 5
    ids = np.arange(3 + many, dtype=np.uint32)
    words = packing.Words([b"abc defg"])
    keys = packing.span_hashes(words.data, words.start, words.end).tolist()
    tokens.store(keys, ids, np.array([3, 3 + many]))
    got, bounds = tokens.encode([b"abc defg abc"])
    assert bounds.tolist() == [0, many + 7] and got[-1] == packing.END_ID
    assert np.array_equal(got[:-1], np.concatenate((ids, ids[:3])))


def test_harmonic_bins():
    """Every document of a class lies whole in a bin of its class, but for one a bin that is cut to fill it."""
    rng = np.random.default_rng(2)
    packer, lengths = packing.Packer(4096, 0), rng.integers(1, 9000, 3000).tolist()
    for k, n in enumerate(lengths):
        packer.add(k, np.full(n, k, "<u4"))
    done = len({r[5] for r in packer.rows})
    packer.finish()
    size, pieces = Counter(), Counter(r[0] for r in packer.rows)
    for r in packer.rows:
        size[r[5]] += r[2]
    assert sum(size.values()) == sum(lengths)
    assert sum(n < 4096 for n in size.values()) <= 12 and all(n & (n - 1) == 0 for n in size.values())
    assert done >= 0.9 * len(size)
    assert sum(pieces.values()) <= 2 * len(lengths) + sum(n // 4096 for n in lengths)


def test_all_segments():
    """Ruzzo and Tompa's segments against their definition over all pairs of places."""
    rng = random.Random(1)
    for _ in range(200):
        scores = [rng.choice([-2.0, -1.0, 1.0, 1.5, 3.0, -0.5]) for _ in range(rng.randrange(1, 14))]
        want, todo = [], [(0, len(scores))]
        while todo:  # the best segment, the shortest of the best, then both sides of it
            a, b = todo.pop()
            best = max(((sum(scores[i:j]), i - j, -i, i, j) for i in range(a, b) for j in range(i + 1, b + 1)), default=(0,))
            if best[0] > 0:
                _, _, _, i, j = best
                want.append((i, j, best[0]))
                todo += [(a, i), (j, b)]
        places = [k for k, s in enumerate(scores) if s != -0.5]
        got = toxicity.segments(places, [scores[k] for k in places], -0.5)
        assert sorted(x[2] for x in got) == pytest.approx(sorted(x[2] for x in want))


def test_extreme_values():
    """K and lambda are found again from greatest segments drawn with them."""
    rng = np.random.default_rng(4)
    n = rng.integers(50, 3000, 20_000)
    x = (np.log(0.05 * n) - np.log(-np.log(rng.random(len(n))))) / 0.8
    k, rate = toxicity.extreme_values(np.maximum(x, 0), n)
    assert k == pytest.approx(0.05, rel=0.1) and rate == pytest.approx(0.8, rel=0.03)


def test_convolution():
    """The network's probability against loops over every chunk, place and filter."""
    net = quality_classifier.Network(3)
    rng = random.Random(2)
    texts = [b"", b"ab", bytes(rng.randrange(1, 256) for _ in range(1300))]
    c, o, w = quality_classifier.CHUNK, quality_classifier.OVERLAP, quality_classifier.WIDTH
    for text, got in zip(texts, net.probability(texts)):
        logits, start, covered = [], 0, 0
        while True:
            symbols = [text[i] if i < len(text) else quality_classifier.PAD for i in range(start, start + c + w - 1)]
            pooled = [math.tanh(max(sum(float(net.filters[k, symbols[p + k], f]) for k in range(w)) for p in range(c))) for f in range(quality_classifier.FILTERS)]
            logits.append(sum(x * float(d) for x, d in zip(pooled, net.dense)) + float(net.bias[0]))
            covered = start + c
            if covered >= len(text):
                break
            start += c - o
        assert got == pytest.approx(1 / (1 + math.exp(-sum(logits) / len(logits))), abs=1e-4)


def _mcd(x, share, starts, rng):
    """Centre of the least determinant over many random starts, and its log determinant."""
    h, best = int(share * len(x)), (np.inf, None)
    for _ in range(starts):
        rows = x[rng.choice(len(x), 7, replace=False)]
        for _ in range(50):
            mean, cov = rows.mean(0), np.cov(rows.T, bias=True) + np.eye(x.shape[1]) * 0.25
            d2 = np.einsum("ij,ij->i", (x - mean) @ np.linalg.inv(cov), x - mean)
            rows = x[np.argsort(d2)[:h]]
        best = min(best, (np.linalg.slogdet(cov)[1], mean), key=lambda b: b[0])
    return best


def test_least_determinant(spark):
    """The robust centre against a search by numpy, where a fifth of the rows is far off."""
    rng = np.random.default_rng(5)
    good = rng.multivariate_normal(np.arange(6), np.diag([1, 4, 1, 9, 2, 1]) + 0.5, 400)
    x = np.concatenate((good, rng.normal(25, 1, (100, 6))))
    rows = spark.createDataFrame([("a", *map(float, r)) for r in x], "g string, " + ", ".join(f"x{i} double" for i in range(6)))
    got = quality_rules._estimates(rows, 6).first()
    centre = np.array([got[f"m{i}"] for i in range(6)])
    _, want = _mcd(x, quality_rules.SHARE, 20, rng)
    assert np.abs(centre - want).max() < 0.35 and np.abs(centre - good.mean(0)).max() < 0.2


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_edits(spark):
    """Lines of every kind of edit at every place, against an edit distance by its table."""
    rng, signs = random.Random(6), "abcdeéü漢🙂 "
    lines = []
    for _ in range(60):
        base = "".join(rng.choices(signs, k=rng.randrange(18, 26))).strip() + "x"
        lines.append(base)
        for _ in range(3):
            some = list(base)
            for _ in range(rng.choice((1, 1, 2))):
                k = rng.randrange(len(some) + 1)
                rng.choice((lambda: some.insert(k, rng.choice(signs)), lambda: some and some.pop(min(k, len(some) - 1)), lambda: some.__setitem__(min(k, len(some) - 1), rng.choice(signs))))()
            lines.append("".join(some))
    rng.shuffle(lines)
    docs = [(k, "\n".join(lines[k * 6 : k * 6 + 6])) for k in range(40)]
    seen, want, least = [], {}, line_dedup.MIN_CHARS
    for k, text in docs:
        keep = []
        for x in text.split("\n"):
            near = any(x == y or (min(len(x), len(y)) >= least and _distance(x, y) <= 1) for y in seen)
            if not x.strip() or not near:
                keep.append(x)
            seen.append(x)
        want[k] = "\n".join(keep)
    got = line_dedup.kept(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()
    assert {r.doc_id: r.text for r in got} == want


def test_repeats_of_long_passages(spark, monkeypatch):
    """Runs and passages cut into small pieces remove the same words."""
    monkeypatch.setattr(substring_dedup, "PIECE", 7)
    monkeypatch.setattr(substring_dedup, "PART", 60)
    monkeypatch.setattr(substring_dedup, "STREAM", 100)
    shared = [passage(k, 200) for k in (70, 71)]
    texts = [shared[0], passage(72, 50) + " " + shared[0], shared[1] + " " + shared[0][40:], shared[1], passage(73, 300), shared[0] + " " + shared[0]] * 2
    words = [WORD.findall(t) for t in texts]
    c = Counter(tuple(w[k : k + 35]) for w in words for k in range(len(w) - 34))
    want = {i: len({k + j for k in range(len(w) - 34) if c[tuple(w[k : k + 35])] > 1 for j in range(35)}) for i, w in enumerate(words)}
    got = substring_dedup.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)).collect()
    assert {r.doc_id: r.n_removed for r in got} == want


@pytest.mark.parametrize("limit", [8 << 20, 0])
def test_salted_joins(spark, monkeypatch, limit):
    """Large groups with and without broadcast, ids null or not."""
    from emberline.llm import workspace

    monkeypatch.setattr(workspace, "SMALL_BYTES", limit)
    rows = [(None if k % 3 == 0 else k, "Same text\nline of the text " + ("x" if k % 2 else "y"), "en", "s") for k in range(60)] + [(k, passage(k, 50), "en", "s") for k in range(100, 120)]
    docs = frame(spark, rows)
    got = exact_dedup.exact_groups(docs).collect()
    assert Counter((r.group_size, r.kept) for r in got) == Counter({(30, False): 58, (30, True): 2, (1, True): 20})
    assert Counter(r.component_id for r in simhash_dedup.near_groups(docs).collect()).most_common(1)[0][1] >= 30
    cleaned = line_dedup.kept(docs).collect()
    assert Counter(r.text for r in cleaned)["Same text\nline of the text x"] <= 1 and len(cleaned) == len(rows)
    taken = mixing.mix(docs).agg(F.sum("taken")).first()[0]
    assert abs(taken - mixing.repeated(docs).select(mixing.n_words(F.col("text")).alias("n")).agg(F.sum("n")).first()[0]) <= 1
    again = [sorted((str(r.doc_id), r.text) for r in mixing.repeated(docs).collect()) for _ in range(2)]
    assert again[0] == again[1]


def test_pipeline_ids(spark):
    """The pipeline's ids are those of the mixed texts, piece by piece."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.word_bpe_path())
    rows = [(k, passage(k, 60 + 9 * k) + "\na line of text number %d" % (k % 4), "en", f"s{k % 3}") for k in range(30)]
    docs = frame(spark, rows + rows[:5]).repartition(3)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    want = Counter((r.doc_id, tuple([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 2])) for r in docs.collect())
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs.coalesce(1), "").collect()
    assert sum(len(ids) * n for (_, ids), n in want.items()) == sum(r.length for r in pieces)
    for (doc, ids), n in want.items():
        mine = [r for r in pieces if r.doc_id == doc and r.doc_tokens == len(ids)]
        assert sum(list(ids[r.start : r.start + r.length]) == r.ids for r in mine) * 1 >= n
        assert sum(r.length for r in mine) >= n * len(ids)


def test_portions():
    """Portions of lines are whole, in order, and bounded unless of one line."""
    import pyarrow as pa

    lines = [b"x" * n for n in (0, 5, line_dedup.AT_ONCE + 1, 0, line_dedup.AT_ONCE, 1, 0)] + [b"y"] * (line_dedup.LINES_AT_ONCE + 3)
    for some in (lines, lines[2:3], []):
        parts = [p.column("line").to_pylist() for p in line_dedup._portions(pa.RecordBatch.from_arrays([pa.array(some, pa.binary())], ["line"]))]
        assert [x for p in parts for x in p] == some and all(parts)
        assert all(len(p) == 1 or (len(p) <= line_dedup.LINES_AT_ONCE and sum(map(len, p)) <= line_dedup.AT_ONCE) for p in parts)


def _edited(rng, n: int, edits: int) -> list[str]:
    """A text of n words, and its like with some words replaced."""
    words = [f"v{rng.randrange(3000)}" for _ in range(n)]
    other = list(words)
    for _ in range(edits):
        other[rng.randrange(n)] = f"z{rng.randrange(10**6)}"
    return [" ".join(words), " ".join(other)]


def test_near_dedup_fingerprints():
    """Wide fingerprints are majorities over distinct shingles, and those of links lie within the radius, of others beyond it."""
    rng = random.Random(21)
    texts = [t for k in range(300) for t in _edited(rng, *[(600, 6), (150, 3), (60, 1)][k % 3])]
    for k in range(300):  # 4 and 5 shingles
        words = [f"s{k}x{i}" for i in range(9)]
        texts += [" ".join(words[:8]), " ".join(words)]
    texts += ["", "w", " ".join(["a b c d e"] * 400), "A b c d e a b c d e"]
    hashes, first = near_dedup.shingles([t.encode() for t in texts])
    got = [int.from_bytes(x.tobytes(), "big") for x in simhash_dedup.wide_fingerprints(hashes, first)]
    sets = [set(hashes[a:b].tolist()) for a, b in zip(first[:-1], first[1:], strict=True)]
    for i in (0, 1, 601, 1000, len(texts) - 4, len(texts) - 3, len(texts) - 2):
        drawn = [simhash_dedup.mix(np.array([(h + k) % 2**64 for h in sets[i]], np.uint64)).view(np.uint8).reshape(-1, 8) for k in range(1, 5)]
        bits = np.unpackbits(np.concatenate(drawn, axis=1), axis=1)
        assert got[i] == int.from_bytes(np.packbits(bits.sum(axis=0) * 2 > len(bits)).tobytes(), "big")
    assert got[-1] == got[-2] and sets[-1] == sets[-2]
    linked = [(i, i + 1) for i in range(0, 1200, 2) if 5 * len(sets[i] & sets[i + 1]) >= 4 * len(sets[i] | sets[i + 1])]
    assert len(linked) > 450
    assert all((got[i] ^ got[j]).bit_count() <= near_dedup.RADIUS for i, j in linked)
    assert all((got[i] ^ got[i + 2]).bit_count() > near_dedup.RADIUS for i in range(0, 1198, 2))


def test_near_dedup_trees():
    """A shard's BK-tree gives all pairs within the radius; with hubs, pairs with these and the nearest before."""
    rng = random.Random(22)
    centres = [rng.getrandbits(256) for _ in range(4)]
    prints = {k: centres[k % 4] ^ sum(1 << b for b in rng.sample(range(256), rng.randrange(60))) for k in range(80)}
    prints[80] = prints[81] = prints[3]

    def apart(a, b):
        return (prints[a] ^ prints[b]).bit_count()

    found = simhash_dedup.shard_pairs(prints, [], 50)
    assert len(found) == len({frozenset(p) for p in found})
    assert {frozenset(p) for p in found} == {frozenset((a, b)) for a in prints for b in prints if a < b and apart(a, b) <= 50}
    hubs = [5, 2, 81]
    order = [*hubs, *(k for k in prints if k not in hubs)]
    found = simhash_dedup.shard_pairs(prints, hubs, 50)
    for i, a in enumerate(order):
        others = {y for x, y in found if x == a}
        least = min([apart(a, b) for b in order[:i]], default=256)
        assert {b for b in hubs if b in order[:i] and apart(a, b) <= 50} <= others <= set(order[:i])
        assert least > 50 or least in {apart(a, b) for b in others}


@pytest.mark.parametrize("pairs, tree", [(near_dedup.ALL_PAIRS, near_dedup.TREE), (2, 7)])
def test_near_dedup_by_trees(spark, monkeypatch, pairs, tree):
    """The pipeline's links come out of the trees: at no radius distinct texts stay, at the given one each family is one row."""
    rng = random.Random(23)
    texts = []
    for k in range(6):
        words = [f"f{k}w{i}" for i in range(500)]
        texts += [" ".join(words[:j] + [f"z{j}"] + words[j + 1 :]) for j in rng.sample(range(500), 12)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(near_dedup, "RADIUS", -1)
    assert corpus_pipeline.near(spark, frame, "").count() == len(texts)
    monkeypatch.undo()
    monkeypatch.setattr(near_dedup, "ALL_PAIRS", pairs)
    monkeypatch.setattr(near_dedup, "TREE", tree)
    assert sorted(r.doc_id for r in corpus_pipeline.near(spark, frame, "").collect()) == list(range(0, 72, 12))
