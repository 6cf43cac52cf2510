import hashlib
import random

import cases
import public_tokenizers
import sentencepiece

from firnline.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")


def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_ids_and_text_are_those_of_the_library():
    rng = random.Random(1)
    alphabet = "abcdeTH théß▁  \n\t\r\x00!!..😀梦字한éﬁ<s></unk>0123—"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(2500)]
    texts += ["", " ", "  ", "\n", " a", " \n ", "▁", "a" * 5000, "ab" * 3000, "梦" * 2000, "     " * 40 + "x" + " " * 33]
    sp, encoder = library(), pieces.Encoder(PATH)
    for t, (ids, text) in zip(texts, encoder.encode(texts)):
        want = sp.encode(t)
        assert (ids, text.decode()) == (",".join(map(str, want)), sp.decode(want))
    encoder.cache.size = 5
    assert [i for i, _ in encoder.encode(texts[:40])] == [",".join(map(str, sp.encode(t))) for t in texts[:40]]


def test_round_trip_of_odd_texts(spark):
    sp = library()

    def sha(s):
        return hashlib.sha256(s.encode()).hexdigest()

    want = sorted((i or 0, len(e := sp.encode(t or "")), sha(",".join(map(str, e))), sha(sp.decode(e))) for i, t in cases.odd_texts())
    got = pieces.round_trip(cases.odd(spark), PATH).collect()
    assert sorted((r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == want


def test_encode_then_decode(spark):
    encoded = pieces.encode(cases.odd(spark), PATH)
    sp = library()
    texts = sorted(sp.decode(sp.encode(t or "")) for _, t in cases.odd_texts())
    assert sorted(r.text for r in pieces.decode(encoded, PATH).collect()) == texts
    assert pieces.encode(cases.empty(spark), PATH).count() == 0 and pieces.round_trip(cases.empty(spark), PATH).count() == 0


def test_decode_of_broken_bytes():
    model = pieces.load(PATH)
    ids = [model.of_byte[0xC3], model.of_byte[0x28]]
    assert model.decode(ids) == "�("
