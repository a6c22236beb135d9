"""Licence scans against every stretch of small texts, planted notices, and edge cases."""

import random
import re

import pyarrow as pa
import pytest

from cueframe.llm import license_scan, license_texts

SCHEMA = "doc_id long, text string, matches int, license string, whole_dice int"


def plain(text):
    return re.sub(r"[^0-9a-z\x80-\U0010ffff]+", " ", (text or "").lower()).split()


def pairs_of(words):
    return list(zip(words, words[1:], strict=False))


def best_by_hand(text, known, t):
    """The highest Dice coefficient of any stretch, and the Dice coefficient of the whole text."""
    words, best, whole = pairs_of(plain(text)), 0.0, None
    for _, body in known:
        own = pairs_of(plain(body))
        b = set(own)
        if not b:
            continue
        for i in range(len(words)):
            for j in range(i + 1, min(len(words), i + int((2 - t) / t * len(own) + 1e-9)) + 1):
                a = set(words[i:j])
                dice = 2 * len(a & b) / (len(a) + len(b))
                if dice >= t:
                    best = max(best, dice)
        a = set(words)
        if a and len(a & b) >= t * len(b) / (2 - t) - 1e-9 and len(a) * t <= (2 - t) * len(b):
            whole = max(whole or 0, 2 * len(a & b) / (len(a) + len(b)))
    return best, whole


@pytest.mark.parametrize("seed", range(6))
def test_against_every_stretch(seed):
    r = random.Random(seed)
    vocabulary = [f"t{i}" for i in range(8)]
    known = [(f"L{k}", " ".join(r.choice(vocabulary) for _ in range(r.randint(2, 12)))) for k in range(5)] + [("short", "one"), ("none", "")]
    texts = []
    for _ in range(60):
        words = [r.choice([*vocabulary, "x", "y"]) for _ in range(r.randint(0, 25))]
        if r.random() < 0.6:
            own = r.choice(known)[1].split()
            if own and r.random() < 0.5:
                own[r.randrange(len(own))] = "x"
            at = r.randint(0, len(words))
            words[at:at] = own
        texts.append(r.choice([" ", "\n", ", "]).join(words))
    for t in (0.7, 0.85, 1.0):
        got, whole = license_scan.scan(pa.array(texts), license_scan.Templates.of(known, t))
        for text, matches, all_of_it in zip(texts, got, whole, strict=True):
            dice, by_hand = best_by_hand(text, known, t)
            assert bool(matches) == (dice > 0)
            assert all_of_it == (pytest.approx(by_hand) if by_hand is not None else None)
            spans = sorted((m["start"], m["start"] + m["n_words"]) for m in matches)
            assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False))
            for m in matches:
                assert m["matched"].split() == plain(text)[m["start"] : m["start"] + m["n_words"]]
                a = set(pairs_of(m["matched"].split()))
                assert any(n == m["license"] and m["dice"] == pytest.approx(2 * len(a & set(pairs_of(plain(b)))) / (len(a) + len(set(pairs_of(plain(b)))))) for n, b in known)
                assert t <= m["dice"] <= dice + 1e-12


def test_planted(spark):
    full, apache = dict(license_texts.FULL)["MIT"], dict(license_texts.FULL)["Apache-2.0"]
    prose = "The old house stood under the hill and the river was licensed to no one. " * 40
    rows = [
        (1, full), (2, prose + full.upper().replace("\n", " ") + prose), (3, "// " + apache.replace(". ", ".\n// ")), (4, prose), (5, None), (6, ""), (7, "word"),
        (8, prose + "\nLicensed under CC BY-NC 4.0.\n" + prose), (9, "This work is licensed under the GNU General Public License, version 3."), (10, "This work is licensed under the GNU General Public License, version 2."),
        (11, prose + "Released under the MIT License.\n" + prose + "Licensed under the Apache License, Version 2.0."), (12, full.replace("Software", "Work", 2)), (9, "This work is licensed under the GNU General Public License, version 3."),
        (None, "Released under the MIT License."), (13, full.replace('"', "”")), (14, (full + " ") * 300), (15, "Licensed under the Apache License, Version 1.1."), (16, "licensed under the bridge"), (17, prose * 400),
    ]
    docs = spark.createDataFrame([(i, t, 1, "x", 1) for i, t in rows], SCHEMA)
    got = {}
    for x in license_scan.with_licenses(docs).collect():
        got.setdefault(x.doc_id, []).append(x)
    assert sum(map(len, got.values())) == len(rows) and len(got[9]) == 2
    names = {k: [m.license for m in v[0].matches] for k, v in got.items()}
    assert names == {1: ["MIT"], 2: ["MIT"], 3: ["Apache-2.0"], 4: [], 5: [], 6: [], 7: [], 8: ["CC-BY-NC-4.0"], 9: ["GPL-3.0"], 10: ["GPL-2.0"], 11: ["Apache-2.0", "MIT"], 12: ["MIT"], None: ["MIT"], 13: ["MIT"], 14: ["MIT"] * 300, 15: ["Apache-1.1"], 16: [], 17: []}
    assert got[1][0].whole_dice == 1 and got[2][0].whole_dice < 1 and got[4][0].whole_dice is None
    assert got[1][0].matches[0].n_words == len(plain(full))
    assert license_scan.license_passages(docs).count() == sum(len(v[0].matches) * len(v) for v in got.values())
    assert license_scan.with_licenses(docs.where("doc_id < 0")).count() == 0
    assert [m.license for m in license_scan.with_licenses(docs.where("doc_id = 1"), [("own", "granted, free of charge, to any person")]).first().matches] == ["own"]


def test_bounds():
    with pytest.raises(ValueError):
        license_scan.Templates.of([("a", "x y")], 0)
    with pytest.raises(ValueError):
        license_scan.Templates.of([("a", "x " * (license_scan.MAX_TEMPLATE_WORDS + 1))])
    assert license_scan.scan(pa.array(["a b"]), license_scan.Templates.of([]))[0] == [[]]
