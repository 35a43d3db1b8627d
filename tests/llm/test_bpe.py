import hashlib
import random

import public_tokenizers
import tiktoken

from stowage.llm import bpe
from stowage.llm.queries import encoded

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


def reference():
    return tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={}
    )


def texts():
    rng = random.Random(5)
    letters = "abc éß漢字\n\t '’0123.,😀\x1c\x85 İ\x00 "
    made = ["".join(rng.choices(letters, k=rng.randint(1, 60))) for _ in range(300)]
    return [None, "", " ", "\n\n  x", "<|endoftext|>", "don't we'll I'M", "a" * 5000, "word " * 9000, *made, *made[:9]]


def test_ids_are_those_of_the_rank_encoder_and_decode_to_the_text(spark):
    own = texts()
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(own)], "doc_id bigint, text string, ids string")
    want = reference()
    rows = {r.doc_id: r for r in encoded(df, PATH).collect()}
    assert len(rows) == len(own)
    for i, text in enumerate(own):
        ids = want.encode_ordinary(text or "")
        raw = b"".join(x.to_bytes(4, "little") for x in ids)
        assert rows[i].n_tokens == len(ids), text
        assert rows[i].ids_sha256 == hashlib.sha256(raw).hexdigest()
        assert rows[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


def test_memo_is_bounded_and_makes_no_difference(monkeypatch):
    monkeypatch.setattr(bpe, "MEMO_ENTRIES", 50_300)
    encoder = bpe.Encoder(bpe.read_ranks(PATH), public_tokenizers.PATTERN)
    want = reference()
    own = [t or "" for t in texts()] + [" ".join(f"zq{i}x{i}" for i in range(20_000))]
    got = list(encoder.encode(own))
    for text, raw in zip(own, got):
        assert raw == b"".join(x.to_bytes(4, "little") for x in want.encode_ordinary(text))


def test_every_vocabulary_entry_is_one_id():
    ranks = bpe.read_ranks(PATH)
    model, id_ranks = bpe.serialise(ranks)
    assert id_ranks[1:] == sorted(ranks.values())
    assert len(model) < 2_000_000


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert encoded(empty, PATH).collect() == []
