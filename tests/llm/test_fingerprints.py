import hashlib
import random

from pyspark.sql import functions as F

from stowage.llm import fingerprints
from stowage.llm.queries import document_trees


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def edits(rows):
    """Edited text and next text per row, in descending order of ids."""
    order = sorted(rows, key=lambda r: -r[0])
    out = {}
    for k, (i, text) in enumerate(order):
        text, following = text or "", order[(k + 1) % len(order)][1] or ""
        cut = len(text) // 3
        out[i] = (text, text[: len(text) - cut] + following[:cut], following)
    return out


def tree(fp):
    """[(section, [paragraph, …]), …] of a fingerprint."""
    return [(s[:8], s[9:].split(";")) for s in fp[65:].split(")") if s]


def texts():
    rng = random.Random(11)
    made = [None, "", "\n", "a", "ab", "abc.", "é😀漢" * 50, "x\n\ny\n\n\nz", "no end " * 30_000]
    for _ in range(200):
        words = ["the", "É", "tree.", "of\n", "para?", "😀", "\n\n", "graph", "Section!\n"]
        made.append(" ".join(rng.choices(words, k=rng.randint(1, 150))))
    return made + made[:30]


def run(spark, rows):
    df = spark.createDataFrame([(i, t, "c", 0) for i, t in rows], "doc_id bigint, text string, made string, bucket int")
    return document_trees(df).collect()


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "BUCKET_ROWS", 9)
    monkeypatch.setattr(fingerprints, "BLOCK", 4)
    own = texts()
    rows = [(i * 3 - 50, t) for i, t in enumerate(own)]
    want, got = edits(rows), run(spark, rows)
    assert len(got) == len(rows)
    seen = {}
    for r in got:
        text, edit, following = want[r.doc_id]
        assert (r.n_chars, r.edited_sha256) == (len(text), sha(edit)), r.doc_id
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert (r.fingerprint == r.edited_fingerprint) == (text == edit) == (r.near_edited == 1)
        assert (r.near_next == 1) == (text == following)
        for t, f in ((text, r.fingerprint), (edit, r.edited_fingerprint)):
            assert seen.setdefault(t, f) == f
        assert (not r.edited_sections) == (not r.edited_paragraphs) == (text == edit)
        own, other = (tree(f) for f in (r.fingerprint, r.edited_fingerprint))
        fresh = [s for s in other if s not in own]
        known = [p for s in own if s not in other for p in s[1]]
        assert r.edited_sections == list(dict.fromkeys(s[0] for s in fresh))
        assert r.edited_paragraphs == list(dict.fromkeys(p[:8] for _, below in fresh for p in below if p not in known))
    assert len(set(seen.values())) == len(seen)


def test_an_edit_of_the_last_third_leaves_most_of_the_tree(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    rows = [(i, "".join(" ".join(word() for _ in range(9)) + ".\n" for _ in range(30))) for i in range(40)]
    for r in run(spark, rows):
        assert 0.55 < r.near_edited < 0.75 and r.near_next == 0


def test_differing_branches_locate_the_edit(spark):
    lines = [f"Line number {i} says {i * i}.\n" for i in range(60)]
    changed = lines[:41] + ["Another line.\n"] + lines[42:]
    df = spark.createDataFrame([("".join(lines), "".join(changed))], "a string, b string")
    a, b = fingerprints.fingerprint(F.col("a")), fingerprints.fingerprint(F.col("b"))
    row = df.select(fingerprints.differing(a, b).alias("d"), fingerprints.paragraphs(b).alias("all"), F.lit(1)).first()
    assert [row["all"].index(p) for p in row["d"]] == [41]
    assert len(row["all"]) == 60
    assert df.select(fingerprints.differing(a, a).alias("d")).first()["d"] == []


def test_repeated_and_missing_ids(spark):
    rows = [(5, "five"), (5, "five"), (5, "other"), (None, "none"), (9, "nine nine"), (None, None)]
    assert sorted(str(r.doc_id) for r in run(spark, rows)) == ["5", "5", "5", "9", "None", "None"]
    assert run(spark, [(1, "lonely text")])[0].near_next == 1
    assert run(spark, []) == []
