"""Importance resampling against the contract written out plainly."""
import hashlib
import math
import random
import re
import zlib
from collections import Counter

from dawnscore.llm import target_weights as tw

from .cases import ODD, frame, prose

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    found = WORD.findall(low)
    return found, found + [f"{a} {b}" for a, b in zip(found, found[1:])]


def bucket(feature):
    return zlib.crc32(feature.encode()) % 10_000


def plain(docs, items):
    s, t = (Counter(bucket(f) for x in rows for f in features(x[1])[1]) for rows in (docs, items))
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s_all + 10_000) / ((s[b] + 1) * (t_all + 10_000)))) for b in range(10_000)]
    out = []
    for doc_id, text, *_ in docs:
        found, every = features(text)
        weight = sum(gain[bucket(f)] for f in every) // len(every) if every else 0
        if doc_id is None:
            out.append([doc_id, len(every), weight, None, None, len(found)])
            continue
        h = int(hashlib.sha256(f"7:{doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([doc_id, len(every), weight, score, None, len(found)])
    drawing = sorted((r for r in out if r[5] >= 20 and r[0] is not None), key=lambda r: (-r[3], r[0], r[1]))
    for k, r in enumerate(drawing[:25 * len(drawing) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


def test_equals_the_contract(spark):
    rng = random.Random(2)
    docs = ODD + [(k, prose(k, rng.randrange(1, 60)) + rng.choice([" Über-GRÖSSE É.", " a_b c's", "", "\x7fx\x0by"])) for k in range(200, 420)]
    docs += [(k, "The same words over and over, again and again: the same words, twenty of them and one more, all told here.") for k in range(900, 940)]
    items = [(k, prose(1000 + k, 40) + " The same words") for k in range(30)] + [(99, None), (None, "x y")]
    target = spark.createDataFrame([(*r, "x") for r in items], "item_id long, text string, doc_id string")
    got = sorted((tuple(r) for r in tw.resample(frame(spark, docs), target).collect()), key=str)
    assert got == plain(docs, items)


def test_head_is_bounded_and_changes_nothing(spark, monkeypatch):
    docs = frame(spark, [(k, prose(k, 80)) for k in range(40)])
    words, pairs = tw.head(tw.texts(docs))
    assert words and pairs and max(len(words), len(pairs)) <= tw.HEAD
    some = tw.Vocabulary.of(words[::3], pairs[::2])
    none = tw.Vocabulary.of([], [])
    for k in range(5):
        found = tw.words_of(prose(k, 80))
        assert some.features(found).tolist() == none.features(found).tolist() == [bucket(f) for f in features(prose(k, 80))[1]]
    held = tw._Frequent()
    for k in range(60):
        held.add([f"r{k}-{j}".encode() for j in range(9_000)] + [b"often"] * 500)
    assert len(held.counts) <= tw._HELD and (b"often", 30_000) in held.rows() and held.total == 60 * 9_500


def test_empty_sides(spark):
    target = spark.createDataFrame([], "item_id long, text string")
    assert tw.resample(frame(spark, []), target).count() == 0
    rows = [(k, prose(k, 30)) for k in range(8)]
    got = tw.resample(frame(spark, rows), target).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain(rows, [])
    assert sorted(r.rank for r in got if r.rank) == [1, 2]
