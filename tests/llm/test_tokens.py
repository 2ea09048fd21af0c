"""BPE, token counts and shards against the tokenizers library."""

import random
import zlib
from array import array

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from quire.llm import bpe, sstable, tokencount  # noqa: E402

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["a", "b", "'", "'s", "r", "e", " ", "  ", "\n", "\t", "1", "23", "é", "ü", "中", "　", "\x1c", "\xa0", "!", "...", "<|endoftext|>", "ll", "the", " of", "ing", "aaaa", "՘", "꟝", "😀", "́"]


@pytest.fixture(scope="module")
def enc():
    return bpe.Encoder(PATH)


def reference(enc, text):
    return array("I", enc.tokenizer.encode(text or "", add_special_tokens=False).ids).tobytes()


def test_encoding_equals_the_library(enc):
    r, counter = random.Random(1), tokencount.Counter(PATH)
    for _ in range(3000):
        text = "".join(r.choice(PARTS) for _ in range(r.randint(0, 30)))
        want = reference(enc, text)
        assert enc.encode(text) == want, repr(text)
        assert counter.count(text) == len(want) // 4, repr(text)
        assert enc.decode(want) == enc.tokenizer.decode(array("I", want).tolist(), skip_special_tokens=False)


def test_pieces_join_to_the_whole(enc):
    r = random.Random(2)
    for _ in range(800):
        few = [x for x in r.sample(PARTS, r.randint(1, 8)) if "<|" not in x] or ["a"]
        text = "".join(r.choice(few) for _ in range(r.randint(1, 600)))
        n = r.choice([1, 2, 3, 7, 20, 50, 300])
        pieces = [enc.encode_piece(text[i : i + n]) for i in range(0, len(text), n)]
        assert bpe.join_all(enc, pieces).ids == reference(enc, text), repr(text[:80])


def test_whole_tokens_are_proven(enc):
    whole = tokencount.whole_tokens(enc)
    assert " the" in whole and "<|endoftext|>" not in whole and len(whole) > 40_000


TEXTS = [(1, "plain text, twice"), (1, "plain text, twice"), (2, None), (3, ""), (None, "no key"), (4, "x" * 500 + " " + "abc" * 400), (5, "before <|endoftext|>after " * 60)]


@pytest.mark.parametrize("piece", [64, 65_536])
def test_encode_and_decode_tables(spark, enc, piece):
    df = spark.createDataFrame([(k, t, "x", 1) for k, t in TEXTS], "doc_id long, text string, quire_key string, ids int")
    rows = bpe.decode(bpe.encode(df, PATH, piece_chars=piece), PATH).collect()
    assert sorted((r.doc_id or 0, bytes(r.ids)) for r in rows) == sorted((k or 0, reference(enc, t)) for k, t in TEXTS)
    assert all(r.decoded == (r.text or "") and r.quire_key == "x" for r in rows)
    assert bpe.encode(df.limit(0), PATH).count() == 0


def test_token_counts_table(spark, enc):
    df = spark.createDataFrame([(k, t, 7) for k, t in TEXTS], "doc_id long, text string, n_tokens int")
    got = tokencount.token_counts(df, PATH)
    assert sorted((r.doc_id or 0, r.n_tokens) for r in got.collect()) == sorted((k or 0, len(reference(enc, t)) // 4) for k, t in TEXTS)
    assert tokencount.token_counts(df.limit(0), PATH).count() == 0


def test_shards_round_trip_and_lookup(spark, enc, tmp_path):
    r = random.Random(3)
    texts = [(i * 3 - 50, "".join(r.choice(PARTS[:-2]) for _ in range(r.randint(0, 80)))) for i in range(300)] + [(7, None), (7, "again"), (None, "lost")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    manifest = sstable.write_shards(df, PATH, str(tmp_path / "t"), end_id=2)
    shards = manifest.orderBy("start").collect()
    assert [s.first_key for s in shards] == sorted(s.first_key for s in shards)
    got = sorted(sstable.read_shards(manifest).collect(), key=lambda x: x.start)
    end, start = (2).to_bytes(4, "little"), 0
    assert [g.key for g in got] == sorted(k for k, _ in texts if k is not None)
    want = {}
    for k, t in texts:
        want.setdefault(k, set()).add(reference(enc, t) + end)
    for g in got:
        assert g.start == start and bytes(g.ids) in want[g.key]
        start += len(g.ids) // 4
    assert sum(zlib.crc32(bytes(g.ids)) for g in got) == sum(zlib.crc32(reference(enc, t) + end) for k, t in texts if k is not None)
    found = []
    for s in shards:
        where, name = sstable.opened(s.shard)
        reader = sstable.Reader(where.open_input_file(name))
        assert all(not reader.get(k) for k in range(10_000, 10_200))
        found += reader.get(7)
    assert {f.astype("<u4").tobytes() for f in found} == want[7]
    assert sstable.read_shards(sstable.write_shards(df.limit(0), PATH, str(tmp_path / "e"))).count() == 0


def test_small_blocks_are_searched(tmp_path):
    import numpy as np

    where, name = sstable.opened(str(tmp_path / "x.sst"))
    w = sstable.Writer(where.open_output_stream(name), 2, block_bytes=64)
    for k in range(-100, 100):
        w.add(k, np.arange(k + 100))
        if k == 5:
            for _ in range(9):
                w.add(k, np.arange(3))
    w.close()
    reader = sstable.Reader(where.open_input_file(name))
    assert len(reader.blocks) > 20
    assert [len(x) for x in reader.get(5)] == [105] + [3] * 9
    assert all(len(reader.get(k)[0]) == k + 100 for k in range(-100, 100)) and not reader.get(500)
