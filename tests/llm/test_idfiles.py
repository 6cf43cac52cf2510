import random
import zlib

import numpy as np
import pytest
import public_tokenizers
from cases import empty, odd, odd_texts, table, words

from firnline.llm import idfiles
from firnline.session import new_path

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def encode():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    return lambda text: [*t.encode(text or "", add_special_tokens=False).ids, 1]


def round_trip(spark, docs, **more):
    path = new_path(spark, "id-files")
    idfiles.write(docs, path, PATH, **more)
    return path, [tuple(r) for r in idfiles.read(spark, path, with_ids=True).orderBy("start").collect()]


@pytest.mark.parametrize("values", [
    [], [0], [5, 5, 5], [-(1 << 63), 0, (1 << 63) - 1], list(range(1000)), [0] * 700 + [1 << 40] * 300, sorted(random.Random(1).randrange(10**12) for _ in range(5000)),
])
def test_select_gives_every_value(values):
    made = idfiles.EliasFano(idfiles.EliasFano.encode(np.array(values, dtype=np.int64)))
    assert made.select(np.arange(len(values))).tolist() == values
    some = random.Random(2).choices(range(len(values)), k=50) if values else []
    assert made.select(some).tolist() == [values[i] for i in some]


def test_boundaries_take_few_bits():
    rng = np.random.default_rng(3)
    bounds = np.cumsum(rng.integers(1, 1200, size=100_000))
    assert 8 * len(idfiles.EliasFano.encode(bounds)) < 13 * len(bounds)


@pytest.mark.parametrize("shard_ids", [1, 100, 1 << 24])
def test_files_hold_every_document_in_order(spark, encode, shard_ids):
    _, got = round_trip(spark, odd(spark), shard_ids=shard_ids)
    want = sorted(((i, encode(t)) for i, t in odd_texts()), key=lambda r: (r[0] is not None, r[0] or 0))
    assert [r[0] for r in got] == [i for i, _ in want]
    # Repeated ids, and rows without one, have no order among them.
    assert sorted((r[0] or 0, list(r[4])) for r in got) == sorted((i or 0, ids) for i, ids in want)
    at = 0
    for _, start, n, crc, ids in got:
        assert (start, n, crc) == (at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
        at += n


def test_one_document_is_read_by_its_number(spark, encode):
    rng = random.Random(5)
    docs = [(3 * i, words(rng, rng.randint(0, 40))) for i in range(60)]
    path, _ = round_trip(spark, table(spark, docs).repartition(5), shard_ids=200)
    for k in (0, 17, 59):
        assert idfiles.document(spark, path, k) == encode(docs[k][1])
    assert idfiles.document(spark, path, 60) is None


def test_no_documents(spark):
    path, got = round_trip(spark, empty(spark))
    assert got == [] and idfiles.document(spark, path, 0) is None


def test_a_damaged_file_is_refused(encode):
    data = bytearray(idfiles.Shard.encode(0, 0, 0, [1, 2], [2, 1], np.array([7, 1, 1], dtype="<u4").tobytes(), 2))
    assert idfiles.Shard(bytes(data)).document(0).tolist() == [7, 1]
    data[-2] ^= 1
    with pytest.raises(ValueError):
        idfiles.Shard(bytes(data))


def test_one_id_in_most_rows(spark, encode):
    docs = [(7, f"word{i % 4}") for i in range(300)] + [(i, "other") for i in range(50)]
    _, got = round_trip(spark, table(spark, docs).repartition(6), shard_ids=64)
    assert [r[0] for r in got] == sorted(i for i, _ in docs)
