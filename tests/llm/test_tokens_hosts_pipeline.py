"""Byte-pair encoding, Re-Pair files, host reputation and the pipeline."""
import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from dawnscore.llm import byte_bpe, hosts, pieces, repair

from .cases import ODD, frame, prose
from .test_near_dup import brute, group
from .test_spans import SECRETS
from .test_text_rules import facts

RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(byte_bpe.RANKS, "rb"))}
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def odd_texts():
    rng = random.Random(5)
    letters = list("abeth  \n\t.,'sd12é😀ß²½œ中文ا  \x1c\x85-=՘")
    out = ["".join(rng.choices(letters, k=rng.randint(0, 40))) for _ in range(3000)]
    out += ["".join(rng.choices("abth", k=rng.randint(1, 80))) for _ in range(3000)]
    return out + ["<|endoftext|> a", " ", "  ", "a  ", "\n \n x", " \n  y", "a" * 5000, "ab" * 3000 + " x", "don't we'll I'M", ""]


def test_encoders_equal_the_libraries():
    own = pieces.rank_encoder(byte_bpe.RANKS)
    assert all(np.frombuffer(own.encode(t), "<u4").tolist() == LIBRARY.encode_ordinary(t) for t in odd_texts())
    own = pieces.file_encoder(repair.TOKENIZER)
    library = Tokenizer.from_file(repair.TOKENIZER)
    library.encode_special_tokens = True
    for text, want in zip(odd_texts(), library.encode_batch(odd_texts(), add_special_tokens=False), strict=True):
        assert np.frombuffer(own.encode(text), "<u4").tolist() == want.ids


def test_round_trip_and_offsets(spark):
    rows = [(k, t) for k, t in enumerate(odd_texts()[::60])] + [(i if i is None else i + 10_000, t) for i, t in ODD]
    texts = dict(rows)
    got = byte_bpe.round_trip(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        text = texts[r.doc_id] or ""
        ids = np.array(LIBRARY.encode_ordinary(text), "<u4")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    encoded = byte_bpe.encode(frame(spark, [(1, "é😀 abc"), (2, None)]))
    row = encoded.filter("doc_id = 1").first()
    _, starts = LIBRARY.decode_with_offsets(row.ids)
    assert row.starts == starts and row.ends[-1] == 6
    assert {r.doc_id: r.text for r in byte_bpe.decode(encoded).collect()} == {1: "é😀 abc", 2: ""}
    cut = byte_bpe.decode(encoded.withColumn("ids", F.slice("ids", 1, 2))).filter("doc_id = 1").first()
    assert "é😀 abc".encode().startswith(bytes(cut.raw)) and cut.text.startswith("é")
    assert byte_bpe.round_trip(frame(spark, [])).count() == 0


@pytest.mark.parametrize("sizes", [[0], [5, 0, 3], [4000], [1, 1, 1], [700, 0, 900, 2]])
def test_shards_round_trip(sizes):
    rng = np.random.default_rng(len(sizes))
    ids = rng.integers(0, 12, sum(sizes)).astype("<u4")
    ids[::7] = 50_256
    raw = repair.compress(ids, np.array(sizes), least=3)
    shard = repair.Shard(raw)
    ends = np.cumsum(sizes)
    assert (shard.all() == ids).all()
    for k, n in enumerate(sizes):
        doc = ids[ends[k] - n:ends[k]]
        assert (shard.document(k) == doc).all()
        for a, b in ((0, 1), (n // 3, n // 2), (n - 1, n), (0, n)):
            a, b = max(a, 0), max(b, 0)
            assert (shard.document(k, a, b) == doc[a:b]).all()
    if sum(sizes) > 1000:
        assert len(shard.sequence) < sum(sizes) * 0.8 and (shard.lengths > 1).all()
    wide = repair.Shard(repair.compress(ids, np.array(sizes), 70_000, least=3))
    assert (wide.all() == ids).all()


def test_grammar_goes_on_until_no_pair_is_frequent():
    rng = np.random.default_rng(3)
    passage = rng.integers(0, 5000, 1000).astype("<u4")
    docs = [np.concatenate([rng.integers(0, 5000, 20).astype("<u4"), passage]) for _ in range(200)]
    sizes = np.array([len(d) for d in docs])
    raw = repair.compress(np.concatenate(docs), sizes)
    shard = repair.Shard(raw)
    assert (shard.all() == np.concatenate(docs)).all()
    assert shard.lengths.max() > 500 and len(raw) < 0.05 * 4 * sizes.sum()      # a copied passage is a symbol or two
    pairs = {}
    for k in range(len(docs)):
        symbols = shard.sequence[shard.begin[k]:shard.begin[k + 1]].tolist()
        for pair in zip(symbols, symbols[1:], strict=False):
            pairs[pair] = pairs.get(pair, 0) + 1
    assert max(pairs.values()) < repair.LEAST
    assert (shard.document(7, 400, 410) == docs[7][400:410]).all()


def test_shards_with_more_symbols_than_16_bits():
    ids = np.concatenate([np.arange(70_000), np.tile(np.arange(64), 100)]).astype("<u4")
    raw = repair.compress(ids, np.array([70_000, 6_400]), 70_000)
    shard = repair.Shard(raw)
    assert (shard.all() == ids).all() and shard.sequence.dtype.itemsize == 4
    assert shard.lengths.max() >= 64 and (shard.document(1, 63, 66) == [63, 0, 1]).all()


def test_long_pieces_are_not_kept():
    encoder = pieces.file_encoder(repair.TOKENIZER)
    before = len(encoder.bare), len(encoder.spaced)
    text = "中" * 3000 + " " + "b" * 3000
    assert encoder.encode(text) == encoder.encode(text)
    assert all(len(k) <= pieces.LONGEST for kept in (encoder.bare, encoder.spaced) for k in kept)
    assert len(encoder.bare) + len(encoder.spaced) <= sum(before) + 2


def test_files_read_back(spark):
    rows = [(k * 3 % 101, prose(k, 50)) for k in range(101)] + [(i if i is None else i + 10_000, t) for i, t in ODD]
    shards = repair.write_shards(frame(spark, rows), partition_rows=20)
    assert shards.select("part").distinct().count() > 3
    got = repair.read_shards(shards).collect()
    assert len(got) == len(rows)
    encoder, start = pieces.file_encoder(repair.TOKENIZER), 0
    texts = dict(rows)
    for r in sorted(got, key=lambda r: r.start):
        raw = encoder.encode(texts[r.doc_id]) + b"\2\0\0\0"
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(raw) // 4, zlib.crc32(raw))
        start += r.n_tokens
    order = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert order[0] is None and order[1:] == sorted(order[1:])
    assert repair.read_shards(repair.write_shards(frame(spark, []))).count() == 0


def test_added_tokens_keep_their_ids(spark):
    library = Tokenizer.from_file(repair.TOKENIZER)
    rows = [(1, "a<|endoftext|>b"), (2, "plain text"), (3, "x <|endoftext|> <|endoftext|>\n é中文 y"), (4, "<|endoftext| >")]
    got = sorted(repair.read_shards(repair.write_shards(frame(spark, rows))).collect(), key=lambda r: r.doc_id)
    start = 0
    for (_, text), r in zip(rows, got, strict=True):
        ids = [*library.encode(text, add_special_tokens=False).ids, 2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert library.encode(rows[0][1], add_special_tokens=False).ids == [64, 50256, 65]


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, good boolean, host string")


def test_host_reputation(spark):
    rows = [(k, f"https://bad.farm.org/p{k}", k % 10 == 0) for k in range(60)]
    rows += [(100 + k, f"http://s{k % 4}.fine.org/{k}", k % 8 != 0) for k in range(80)]
    rows += [(300, "https://new.farm.org/x", None), (301, "https://one.other.org/", False), (302, None, True), (303, "no scheme", None),
             (304, "HTTPS://WWW.Example.COM/en/a?b#c", None), (305, "x://Example.com/en/", None), (306, "x://a.b.com", None),
             (307, "x://a.b.com/", None), (308, "x://notexample.com/en/", None), (309, "x://q.net/fr/1", None), (310, "x://net?/fr/", None),
             (311, "x://h#/y", None), (312, "x://y://z/", None), (313, "x://a.co.uk/", None), (304, "HTTPS://WWW.Example.COM/en/a?b#c", None)]
    got = hosts.filter_urls(pages(spark, rows), good=F.col("good")).collect()
    assert len(got) == len(rows)
    at = {r.page_id: r for r in got}
    assert at[0].verdict == "block" and at[100].verdict == "allow"
    assert at[301].verdict == "allow" and at[301].n_labelled == 1       # one bad page does not condemn a host
    assert (at[302].host, at[302].path, at[303].host) == ("", "", "")
    assert (at[304].host, at[304].path, at[304].rule, at[304].verdict) == (
        "www.example.com", "/en/a", "www.example.com/en/", "allow")
    assert (at[305].rule, at[305].verdict) == ("example.com/en/", "block")
    assert (at[306].rule, at[307].rule, at[308].rule) == (None, "com/", "com/")
    assert (at[309].rule, at[310].rule, at[310].path, at[311].host) == ("net/fr/", None, "", "h")
    assert (at[312].host, at[312].path) == ("y:", "//z/")
    assert hosts.filter_urls(pages(spark, []), good=F.col("good")).count() == 0
    low, high = at[300].good_upper, at[301].good_upper
    assert low < high       # an unlabelled host inherits its domain's bad rate


def test_pipeline_equals_brute_force(spark, tmp_path):
    import corpus_pipeline
    items = [(k, f"{prose(900 + k, 20)}? The answer {prose(950 + k, 9)}.") for k in range(5)]
    rows = group(0, 5, 12, 4) + [(100 + k, prose(200 + k)) for k in range(10)] + [(200, "short text")]
    rows += [(201, (prose(4, 12) + "\n") * 9), (202, prose(5, 90) + " " + items[2][1]), (203, prose(6, 80) + " token=abcdef99 end")]
    rows += [(i if i is None else i + 10_000, t) for i, t in ODD] + [(500 + i, prose(i) + " " + t) for i, t in SECRETS[:2]]
    frame(spark, rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    def fine(text):
        f = facts(text)
        return f[0] >= 50 and 100 * f[4] <= 50 * f[0]
    left = {i: t for i, t in rows if i is None or fine(t)}
    kept = {i for i, x in brute([(i, t) for i, t in left.items()]).items() if x[2]}
    want = {i: t for i, t in left.items() if (i is None or i in kept) and i not in (201, 202)}
    assert set(got) == set(want)
    assert 203 in got and got[203].decoded_sha256 == hashlib.sha256(
        want[203].replace("token=abcdef99", "[secret]").encode()).hexdigest()
    assert got[100].decoded_sha256 == hashlib.sha256(want[100].encode()).hexdigest()
    empty = spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, empty, str(tmp_path))
        assert out.count() == 0 and (name == "byte_bpe" or out.columns == empty.columns)
