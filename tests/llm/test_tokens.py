import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from scalewright.llm import byte_bpe, packing

from .helpers import corpus, frame

RANKS = P.path("byte_bpe_multi_50k.tiktoken")
ALPHABET = "abcdeéèßñü的,.!?’''  \n\t\x1c\xa0   thst123٣𝔘😀the and ing "


@pytest.fixture(scope="module")
def reference():
    with open(RANKS, "rb") as f:
        ranks = byte_bpe.read_ranks(f.read())
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_texts():
    rng = random.Random(7)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 60))) for _ in range(3000)] + ["a" * 5000, "ab" * 3000, " " * 1000, "\n" * 333 + "x", "th" * 2000, "<|endoftext|> a"]


def ids(data):
    return np.frombuffer(data, "<u4").tolist()


def test_encoder_equals_library(reference):
    with open(RANKS, "rb") as f:
        coder = byte_bpe.Encoder(f.read(), P.PATTERN)
    texts = odd_texts()
    assert [ids(x) for x in coder(texts)] == [reference.encode_ordinary(t) for t in texts]


def test_replay_equals_library_on_single_words(reference):
    with open(RANKS, "rb") as f:
        replay = byte_bpe.MergeReplay(byte_bpe.read_ranks(f.read()))
    rng = random.Random(3)
    words = ["".join(rng.choice("aabbcdethins") for _ in range(rng.randint(1, 40))).encode() for _ in range(3000)]
    assert [ids(x) for x in replay(words)] == [reference._encode_single_piece(w) for w in words]


def test_round_trip_of_a_table(spark, reference):
    rows = corpus()
    got = byte_bpe.decode(byte_bpe.encode(frame(spark, rows).selectExpr("*", "1 AS n_tokens", "2 AS ids"), RANKS, P.PATTERN), RANKS).collect()
    want = sorted(((i is None, i or 0, t or "") for i, t in rows))
    assert sorted((r.doc_id is None, r.doc_id or 0, bytes(r.decoded).decode()) for r in got) == want
    assert all(ids(r.ids) == reference.encode_ordinary(bytes(r.decoded).decode()) and r.n_tokens == len(r.ids) // 4 for r in got)


def test_empty_tables(spark):
    none = frame(spark, [])
    assert byte_bpe.decode(byte_bpe.encode(none, RANKS, P.PATTERN), RANKS).count() == 0
    assert packing.pack(none, P.path("word_bpe_49k.json")).count() == 0


def test_pieces():
    assert packing.pieces(4096 * 2 + 5, 4096) == [(0, 4096), (4096, 4096), (8192, 4), (8196, 1)]
    for n in range(1, 300):
        cut = packing.pieces(n, 16)
        assert [a for a, _ in cut] == [sum(m for _, m in cut[:k]) for k in range(len(cut))]
        assert sum(m for _, m in cut) == n and all(m & (m - 1) == 0 and m <= 16 for _, m in cut)


def test_word_encoder_equals_tokenizer():
    with open(P.path("word_bpe_49k.json"), encoding="utf-8") as f:
        definition = f.read()
    texts = odd_texts() + [t or "" for _, t in corpus()] + ["It's Ünder-way\x02 now", "É. ẞ ǅ İ Σς"]
    whole = Tokenizer.from_str(definition)
    whole.encode_special_tokens = True
    assert [ids(x) for x in packing.WordEncoder(definition)(texts)] == [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)]


def test_packing_holds_each_id_once(spark):
    path = P.path("word_bpe_49k.json")
    rows = [(i, t) for i, t in corpus() if i is not None]
    rows = list(dict(rows).items())
    whole = Tokenizer.from_file(path)
    got = packing.pack(frame(spark, rows), path, max_tokens=64).collect()
    by_doc = {}
    for r in sorted(got, key=lambda r: r.start):
        assert r.length & (r.length - 1) == 0 and r.length <= 64 and r.offset == 0 and 1 << r.bucket == r.length
        by_doc.setdefault(r.doc_id, []).append(r)
    assert len({r.sequence_id for r in got}) == len(got)
    for i, t in rows:
        want = [*whole.encode(t or "", add_special_tokens=False).ids, 2]
        assert ids(b"".join(bytes(r.ids) for r in by_doc[i])) == want
        assert {r.doc_tokens for r in by_doc[i]} == {len(want)}


def test_bad_length(spark):
    with pytest.raises(ValueError, match="power of two"):
        packing.pack(frame(spark, []), P.path("word_bpe_49k.json"), max_tokens=100)


def test_latin_words_take_the_merges_alone():
    """Every Latin letter, in words and large or small, without the tokenizer's other steps."""
    with open(P.path("word_bpe_49k.json"), encoding="utf-8") as f:
        definition = f.read()
    letters = [chr(c) for c in [*range(65, 91), *range(97, 123), *range(0xC0, 0x100)] if c not in (0xD7, 0xF7)]
    rng = random.Random(11)
    texts = [*letters, *(" ".join("".join(rng.choices(letters, k=rng.randint(1, 14))) for _ in range(9)) for _ in range(400)), "Das heißt THE thing Straße Été être ÿ Þórr", ""]
    encode = packing.WordEncoder(definition)
    whole = encode.tokenizer
    encode.tokenizer = None
    assert [ids(x) for x in encode(texts)] == [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)]
