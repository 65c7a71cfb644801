"""Naive Bayes support vectors: parts against plain versions, held-out accuracy, odd rows."""
import math
import random
import zlib

import numpy as np

from dawnscore.llm import quality_model as qm

from .cases import ODD, frame, prose

LABELS = "doc_id long, quality int, text string"


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def corpus(n=240):
    rng, rows, labels = random.Random(4), [], []
    for k in range(n):
        text = prose(2000 + k, rng.randrange(20, 90))
        good = k % 4 != 0
        if not good:
            kind = k // 4 % 3
            text = " ".join(w + rng.choice(["$$$", "###"]) for w in text.split()) if kind == 0 else text.upper() if kind == 1 else "Der " * 60
        rows.append((k, text))
        labels.append((k, int(good), "x"))
    return rows, labels


def test_features_are_the_indicators_of_all_tokens():
    tokens = qm._Tokens()
    a = qm.features(b"The cat sat. The dog ran.", tokens)
    assert len(set(a.tolist())) == len(a) and (np.diff(a) > 0).all() and a.min() >= 0 and a.max() < qm.PLACES
    assert not len(qm.features(b" \n\t", tokens)) and len(qm.features(b"x", tokens)) == 2
    twice = set(qm.features(b"ab cd\nab cd\n", tokens).tolist()) - set(qm.features(b"ab cd ab cd ", tokens).tolist())
    assert len(twice) == 1
    assert [qm._shape(t) for t in (b"cat", b"Cat", b"CAT", b"cAt", b"12", b"!?", "É".encode())] == [1, 2, 3, 4, 5, 6, 1]
    assert set(qm.features(b"Der Der Der Der Der", tokens).tolist()) & set(qm.features(b"Ja Ja Ja Ja Ja", tokens).tolist())


def test_windows_cover_the_text():
    raw = prose(1, 60_000).encode()
    parts = list(qm.windows(raw))
    assert b"".join(parts) == raw and len(parts) > 2 and all(len(p) < qm.WINDOW + 50 for p in parts)
    assert list(qm.windows(b"")) == [b""] and list(qm.windows(b"y" * 300_000)) == [b"y" * 300_000]


def test_ratios_over_all_labelled_texts(spark):
    rows, labels = corpus(60)
    data = [(i, t, y) for (i, t), (_, y, _) in zip(rows, labels)] + [(900, None, 1), (901, "", 0)]
    counts, texts, n = qm.class_counts(spark.createDataFrame(data, "doc_id long, text string, label int"))
    want, tokens = np.zeros((2, qm.PLACES), int), qm._Tokens()
    for _, t, y in data:
        want[y][qm.features((t or "").encode(), tokens)] += 1
    assert (counts == want).all() and texts.tolist() == [16, 46] and n.tolist() == want.sum(1).tolist()
    ratios = qm.log_ratios(counts)
    place = int(np.argmax(want[0]))
    totals = (want + 1).sum(1)
    assert math.isclose(ratios[place], math.log((want[1][place] + 1) / totals[1] * totals[0] / (want[0][place] + 1)), rel_tol=1e-5)
    assert not ratios[want.sum(0) == 0].any()


def test_descent_reaches_the_least_loss():
    rng = np.random.default_rng(3)
    ratios = rng.normal(size=40)
    rows = [np.sort(rng.choice(40, 12, replace=False)) for _ in range(60)]
    signs = np.where(rng.random(60) < 0.7, 1.0, -1.0)
    w, b = qm.descend(rows, signs, ratios)
    dense = np.zeros((60, 41))
    for i, r in enumerate(rows):
        dense[i, r] = ratios[r] / np.linalg.norm(ratios[r])
    dense[:, 40] = 1
    box = np.where(signs > 0, 60 / (2 * (signs > 0).sum()), 60 / (2 * (signs < 0).sum()))

    def loss(v):
        return 0.5 * v @ v + (box * np.maximum(0, 1 - signs * (dense @ v))).sum()
    # plain projected ascent of the dual, many small steps
    alpha, q = np.zeros(60), (dense * signs[:, None]) @ (dense * signs[:, None]).T
    for _ in range(40_000):
        alpha = np.clip(alpha + 0.01 * (1 - q @ alpha), 0, box)
    best = (alpha * signs) @ dense
    assert loss(np.append(w, b)) <= loss(best) * 1.002


def test_calibration_meets_the_shares():
    rng = np.random.default_rng(1)
    margins = rng.normal(size=4000)
    labels = (rng.random(4000) < 1 / (1 + np.exp(-(2 * margins + 0.5)))).astype(int)
    slope, offset = qm.calibrate(margins, labels)
    assert abs(slope - 2) < 0.2 and abs(offset - 0.5) < 0.15
    assert qm.calibrate(-margins, labels)[0] > 0


def test_held_out_accuracy_and_no_leak(spark):
    rows, labels = corpus()
    table = spark.createDataFrame(labels + [(None, 1, "x"), (3, None, "x")], LABELS)
    got = {r.doc_id: r for r in qm.quality(frame(spark, rows), table).collect()}
    assert all(got[k].held_out == held(k) for k, _ in rows)
    assert all(got[k].predicted == y == int(got[k].score >= 0.3) for k, y, _ in labels)
    flipped = spark.createDataFrame([(k, 1 - y if held(k) else y, "x") for k, y, _ in labels], LABELS)
    again = {r.doc_id: r.score for r in qm.quality(frame(spark, rows), flipped).collect()}
    assert again == {k: r.score for k, r in got.items()}


def test_odd_rows_and_empty_tables(spark):
    rows, labels = corpus(80)
    odd = [(None if i is None else i + 10_000, t) for i, t in ODD]
    got = qm.quality(frame(spark, rows + odd), spark.createDataFrame(labels, LABELS)).collect()
    assert len(got) == len(rows) + len(odd) and all(0 <= r.score <= 1 for r in got)
    assert [r.held_out for r in got if r.doc_id is None] == [False]
    empty = spark.createDataFrame([], LABELS)
    assert {r.score for r in qm.quality(frame(spark, rows), empty).collect()} == {0.5}
    assert qm.quality(frame(spark, []), spark.createDataFrame(labels, LABELS)).count() == 0
    good = spark.createDataFrame([(k, 1, "x") for k in range(50)], LABELS)
    assert len({r.score for r in qm.quality(frame(spark, rows), good).collect()}) == 1
