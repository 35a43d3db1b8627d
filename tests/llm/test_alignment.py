import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from stowage.llm import alignment
from stowage.llm.queries import linked

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def files():
    return alignment.load(A, B)


def letters():
    """Letters that stand for bytes in the vocabulary of A."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [x for x in range(256) if x not in plain]
    return {chr(x): x for x in plain} | {chr(256 + i): x for i, x in enumerate(rest)}


def brute(rows):
    """Whole texts through both libraries, links by comparing all ends."""
    a, b, letter = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B), letters()
    a.encode_special_tokens = True
    seen = []
    for i, text in rows:
        encoded = a.encode(" " + (text or ""), add_special_tokens=False)
        xs = [(n, bytes(letter[c] for c in t)) for n, t in zip(encoded.ids, encoded.tokens)]
        ys = []
        for n in b.encode(text or ""):
            piece = b.id_to_piece(n)
            ys.append((n, bytes([int(piece[3:5], 16)]) if b.is_byte(n) else piece.replace("▁", " ").encode()))
        raw = (" " + (text or "")).encode()
        if not text or b"".join(t for _, t in xs) != raw or b"".join(t for _, t in ys) != raw:
            seen.append((i, None, None))
            continue
        ends = [np.cumsum([len(t) for _, t in side]).tolist() for side in (xs, ys)]
        seen.append((i, list(zip(ends[0], (n for n, _ in xs))), list(zip(ends[1], (n for n, _ in ys)))))
    links = [[(n, m) for end, n in xs for at, m in ys if at == end] if xs else [] for _, xs, ys in seen]
    count = Counter(link for own in links for link in own)
    highest = Counter()
    for (_, m), n in count.items():
        highest[m] = max(highest[m], n)
    out = []
    for (i, xs, ys), own in zip(seen, links):
        if not xs:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
            continue
        both = sorted({end for end, _ in xs} & {end for end, _ in ys})
        groups = [
            f"{','.join(str(n) for e, n in xs if lo < e <= hi)}|{','.join(str(n) for e, n in ys if lo < e <= hi)}"
            for lo, hi in zip([0, *both], both)
        ]
        best = sum(count[link] == highest[link[1]] for link in own)
        sha = hashlib.sha256(";".join(groups).encode()).hexdigest()
        out.append((i, len(xs), len(ys), len(groups), len(own), best, sum(count[link] for link in own), sha))
    return sorted(out, key=repr)


def make(seed, n):
    rng = random.Random(seed)
    words = ["the", "Straße", "naïve", "тест", "漢字", "don't", "<|endoftext|>", "<s>", "<0x41>", "a\x00b", "12345", "🙂", "é"]
    words += ["".join(rng.choices("abcdefghij.,;", k=rng.randint(1, 9))) for _ in range(60)]
    gaps = [" "] * 12 + ["  ", "\n", "\r\n", "\t", "\n\n  ", "\xa0", chr(0x2003) + " ", "\r", "\x0b ", chr(0x200B), "\x1c", "\x85 "]
    gaps.append(chr(0x3000) + " ")
    return [(i, "".join(rng.choice(words) + rng.choice(gaps) for _ in range(rng.choice([0, 1, 5, 60])))) for i in range(n)]


def odd():
    return [(None, "a b"), (7, None), (7, "twice twice"), (7, "twice twice"), (8, ""), (9, " "), (10, "\n"), (11, "a▁b")] + [
        (12, "long" * 3000), (13, " lead  and trail \n"), (14, ";\r \n b;\r")]


SCHEMA = "doc_id bigint, text string"


@pytest.mark.parametrize("seed, sizes", [(1, (2_000_000, 16_384, 32 << 20)), (2, (300, 16, 512))])
def test_against_brute_force(spark, monkeypatch, files, seed, sizes):
    for name, value in zip(("CHUNK_LINKS", "BLOCK_RECORDS", "CELL_BYTES"), sizes):
        monkeypatch.setattr(alignment, name, value)
    rows = make(seed, 120) + odd()
    got = linked(spark.createDataFrame(rows, SCHEMA).repartition(4), files)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows)


def test_memo_changes_nothing(monkeypatch, files):
    monkeypatch.setattr(alignment, "MEMO_PIECES", 5)
    monkeypatch.setattr(alignment, "MEMO_LETTERS", 3)
    texts = [text or "" for _, text in make(3, 40) + odd()]
    aligner, plain = alignment.Aligner(files), alignment.Aligner(files)
    plain.separable = False
    assert aligner.separable
    for some in (texts[:9], texts[9:], texts):
        cut, whole = list(aligner.aligned(some)), list(plain.aligned(some))
        for pieces, (all_,) in zip(cut, ([x] if x is None else x for x in whole)):
            if all_ is None:
                assert pieces is None
            elif pieces:
                joined = [sum(p.n_a for p in pieces), sum(p.n_b for p in pieces), ";".join(p.groups for p in pieces)]
                assert joined == [all_.n_a, all_.n_b, all_.groups]
                assert b"".join(p.links for p in pieces) == all_.links


def test_pieces_make_up_the_text():
    for _, text in make(4, 300) + odd():
        assert "".join(alignment.PIECE.findall(" " + (text or ""))) == " " + (text or "")


def test_runs_are_merged_in_order():
    rng = np.random.default_rng(0)
    chunks = [rng.integers(0, 40, 500).astype("u8") << np.uint64(44) | rng.integers(0, 3, 500).astype("u8") << np.uint64(24) for _ in range(7)]
    runs = [blocks for keys in chunks for _, blocks in alignment.write_runs(keys | np.uint64(5))]
    pairs, counts = (np.concatenate(x) for x in zip(*alignment.merged(runs)))
    want = Counter(int(k) >> 24 for keys in chunks for k in keys)
    assert pairs.tolist() == sorted(want) and dict(zip(pairs.tolist(), counts.tolist())) == want


def test_one_token_of_most_links_has_several_cells(spark, monkeypatch, files):
    monkeypatch.setattr(alignment, "CHUNK_LINKS", 200)
    monkeypatch.setattr(alignment, "CELL_BYTES", 300)
    rows = [(i, "the " * 40 + f"end {i}") for i in range(200)]
    stored = alignment._tokenised(spark.createDataFrame(rows, SCHEMA), files, "text", False).where("__radix is not null")
    assert stored.select(alignment._cells(stored)).distinct().count() > 1 << alignment.RADIX_BITS
    got = linked(spark.createDataFrame(rows, SCHEMA), files)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows)


def test_pairs_groups_other_columns_and_empty_tables(spark, files):
    df = spark.createDataFrame([("a b", 1, 2)], "text string, a int, `odd name` int")
    found = alignment.align(df, files, with_groups=True)
    row = found.documents.first()
    assert (row["a"], row["odd name"]) == (1, 2) and row["__groups"].count("|") == row["__n_groups"] == 2
    pairs = found.pairs.collect()
    assert sorted(f"{r.a}|{r.b}" for r in pairs) == sorted(row["__groups"].split(";")) and all(r.best and r.n == 1 for r in pairs)
    assert linked(spark.createDataFrame([], SCHEMA), files).collect() == []
