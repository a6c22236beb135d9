"""Hard negatives, sentence pieces and importance resampling against plain statements of what they have to return."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from cueframe.llm import hard_negatives, resampling, sentence_pieces

public_tokenizers = pytest.importorskip("public_tokenizers")
MODEL = public_tokenizers.path("piece_bpe_32k.model")


# --- hard negatives --------------------------------------------------------------------------------------------------


def plain_negatives(rows):
    rows = [(i, [math.floor(256 * x) for x in v], c) for i, v, c in dict.fromkeys((i, None if v is None else tuple(v), c) for i, v, c in rows) if i is not None and c is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, v, c in rows:
        if a % 50:
            continue
        score = [(-sum(x * y for x, y in zip(v, w, strict=False)), i, d) for i, w, d in rows]
        best = sorted((s, i) for s, i, d in score if d == c and i != a)[:5]
        for s, i in best:
            below = sorted((t, j) for t, j, d in score if d != c and 50 * -s <= 100 * -t <= 95 * -s)[:3]
            out += [(a, i, k + 1, j, -s, -t) for k, (t, j) in enumerate(below)]
    return Counter(out)


SCHEMA = "vec_id bigint, embedding array<float>, label int, score int, qid string"


def as_rows(rows):
    return [(i, v, c, 1, "x") for i, v, c in rows]


def mined(spark, rows, **more):
    return Counter(tuple(x) for x in hard_negatives.hard_negatives(spark.createDataFrame(as_rows(rows), SCHEMA), **more).collect())


def test_negatives_equal_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((6, 8))
    rows = [(i, [float(x) for x in (centres[i % 6] + 0.4 * rng.standard_normal(8)).round(2)], int(rng.integers(3))) for i in range(900)]
    rows += [(1000 + i, [0.5] * 8, 1) for i in range(400)] + [(2000 + i, [0.45] * 8, 2) for i in range(120)]  # groups of copies
    rows += [(3000, None, 1), (3050, [1.0] * 8, None), (3100, [float("nan")] + [1.0] * 7, 1), (3150, [float("inf")] + [1.0] * 7, 1), (3200, [None] + [1.0] * 7, 1)]
    rows += [(None, [1.0] * 8, 1), (3250, [0.0] * 8, 2), (3300, [], 0), (3350, [1.0, 1.0], 1), (3400, [-9.0] * 8, 7), *rows[:60], (50, [0.3] * 8, 1)]
    want = plain_negatives(rows)
    assert len(want) > 200 and mined(spark, rows, pivots=20) == want
    monkeypatch.setattr(hard_negatives, "GROUP", 5)  # many groups, blocks and chunks
    monkeypatch.setattr(hard_negatives, "CHUNK", 150)
    assert mined(spark, rows, pivots=60) == want


def test_bounds_leave_out_rows_of_far_cells(spark):
    """With clusters apart, a group is not served the rows of the others' cells."""
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.standard_normal((200, 6)) * 0.02 + c for c in (np.eye(6)[:4] * 5)])
    points = hard_negatives.Pivots(x[::20], float((x**2).sum(axis=1).max()))
    near, dist = points.nearest(x)
    reach = np.array([dist[near == p].max(initial=-1) for p in range(len(points.at))])
    asked = spark.createDataFrame([(0, v.astype("<i8").tobytes(), 0.9 * float(v.astype(int) @ v.astype(int))) for v in x[:5]], "grp long, vec binary, goal double")
    needed = {r.pivot for r in hard_negatives._needs(asked, points, reach, False).collect()}
    assert needed and needed <= set(range(10))


def test_no_vectors(spark):
    assert mined(spark, []) == Counter() and mined(spark, [(50, [1.0], 1)]) == Counter() and mined(spark, [(50, None, 1)]) == Counter()


# --- sentence pieces -------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    return sentence_pieces.pieces(MODEL).model


def test_encoding_equals_the_library(library):
    rng = random.Random(1)
    model = sentence_pieces.pieces(MODEL)
    some = ["a", "e", "t", "h", " ", "  ", "\n", "\t", "é", "☃", "▁", "12", "\U0001f600", "梦", "\x00", "ﬁ", "　", "’", "<0x0A>", "</s>", "in", "한", "ก", "​", "aaaa", "==="]
    texts = ["".join(rng.choice(some) for _ in range(rng.randrange(40))) for _ in range(4000)]
    texts += ["".join(rng.choices(list(model.ids), k=rng.randrange(20))) for _ in range(4000)]
    texts += ["", " ", "   ", "a" * 5000, " " * 300, "▁" * 7, "=-" * 500, "no space behind me" * 20000]
    ids, at = model.encode(pa.array(texts))
    for i, text in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == library.encode(text), text[:100]


def test_tokens_equal_the_merge_rule():
    """Backtracking against joining the best pair again and again, on texts where longest matches go wrong."""
    rng, model = random.Random(2), sentence_pieces.pieces(MODEL)
    for _ in range(3000):
        text = "".join(rng.choice("aeinst ") for _ in range(rng.randrange(1, 24)))
        assert model.tokens(text) == model.merged(text)


def test_piece_digests(spark, library):
    rows = [(1, "Some words, twice."), (1, "Some words, twice."), (None, "x"), (2, None), (3, ""), (4, " two  spaces\n▁"), (5, "é" * 300_000)]
    docs = spark.createDataFrame([(i, t, 0, "y") for i, t in rows], "doc_id bigint, text string, ids int, n_tokens string")
    got = Counter(tuple(x) for x in sentence_pieces.digests(docs, MODEL).collect())
    want = Counter()
    for i, t in rows:
        ids = library.encode(t or "")
        want[i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()] += 1
    assert got == want
    texts = Counter((x.doc_id, x.text) for x in sentence_pieces.decoded(sentence_pieces.encoded(docs, MODEL), MODEL).collect())
    assert texts == Counter((i, library.decode(library.encode(t or ""))) for i, t in rows)
    assert sentence_pieces.digests(docs.limit(0), MODEL).count() == 0


# --- resampling ------------------------------------------------------------------------------------------------------


def split(text):
    import re

    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().translate(bytes(b + 32 if 65 <= b < 91 else b for b in range(256))))


def features(text):
    w = split(text)
    return [b" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def plain_resample(docs, target, buckets):
    s, t = (Counter(zlib.crc32(f) % buckets for x in texts for f in features(x)) for texts in ([x for _, x in docs], target))
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s.values()) + buckets) / ((s[b] + 1) * (sum(t.values()) + buckets)))) for b in range(buckets)]
    rows = []
    for i, text in docs:
        f = features(text)
        weight = sum(gain[zlib.crc32(x) % buckets] for x in f)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(split(text)), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    fit = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0], r[2]))
    rank = Counter()
    for k, r in enumerate(fit[: 5 * len(fit) // 100]):
        rank[r + (k + 1,)] += 1
    for r in rows:
        if sum(n for x, n in rank.items() if x[:5] == r) < sum(x == r for x in rows):
            rank[r + (None,)] = sum(x == r for x in rows) - sum(n for x, n in rank.items() if x[:5] == r and x[5] is not None)
    return rank


def test_resample_equals_brute_force(spark):
    rng = random.Random(4)
    stock = ["the", "The", "of", "naïve", "日本", "x1", "Ünder", "a-b", "don't", "z" * 70, "e.g."] + [f"w{i}" for i in range(60)]
    docs = [(i, " ".join(rng.choices(stock, k=rng.randrange(0, 60)))) for i in range(300)]
    docs += [(None, "alone " * 30), (7, "alone " * 30), (400, None), (401, ""), (402, "one two"), (403, "long words here " * 30_000)] + [(500, "copy of a text " * 8)] * 200
    target = ["the of naïve 日本 the of", None, "", " ".join(rng.choices(stock, k=90))]
    frame = spark.createDataFrame([(i, x, 1, 2, 3) for i, x in docs], "doc_id bigint, text string, row int, weight int, part int")
    bench = spark.createDataFrame([(x, 1) for x in target], "text string, doc_id int")
    got = Counter(tuple(x) for x in resampling.resample(frame, bench, buckets=500).select("doc_id", "n_words", "n_features", "weight", "score", "rank").collect())
    assert got == plain_resample(docs, target, 500)


def test_resample_without_rows(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    one = spark.createDataFrame([(1, "word")], "doc_id bigint, text string")
    assert resampling.resample(empty, one).count() == 0
    assert [tuple(x)[1:4] for x in resampling.resample(one, empty).collect()] == [(1, 1, 1000 * 0 + math.floor(1000 * math.log(10001 / 20000)))]


def test_matrix_comes_back(spark):
    """Blocks hold each row's counts, also of a text of more than one block's size."""
    docs = spark.createDataFrame([(1, "a b a b"), (2, None), (3, "q " * 700_000)], "doc_id bigint, text string")
    seen = {}
    for block in resampling.count_blocks(docs, buckets=97).toArrow().to_batches():
        for ids, _, ends, at, counts in resampling.csr(block):
            first = [0, *ends.tolist()]
            for k, i in enumerate(ids.to_pylist()):
                seen[i] = dict(zip(at[first[k] : first[k + 1]].tolist(), counts[first[k] : first[k + 1]].tolist(), strict=True))
    want = {i: dict(Counter(zlib.crc32(f) % 97 for f in features(t))) for i, t in ((1, "a b a b"), (2, ""), (3, "q " * 700_000))}
    assert seen == want
