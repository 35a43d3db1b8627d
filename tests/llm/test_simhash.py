import itertools
import random
import re

import pytest
import xxhash

import corpus_pipeline
from stowage.llm import simhash
from stowage.llm.components import components
from stowage.llm.queries import near_copies
from stowage.session import settle


def plain_fingerprint(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    codes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(c >> b & 1 for c in codes) > len(codes))


def brute_components(ids, codes):
    parent = list(range(len(ids)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (codes[i] ^ codes[j]).bit_count() <= 3:
                parent[root(i)] = root(j)
    least = {}
    for i, own in enumerate(ids):
        if own is not None:
            least[root(i)] = min(own, least.get(root(i), own))
    return [least.get(root(i)) for i in range(len(ids))]


def texts():
    rng = random.Random(3)
    vocabulary = ["Alpha", "beta", "É", "ÀB", "gamma", "del ta", "x y", "eps", "zeta", "12"]
    base = [[rng.choice(vocabulary) for _ in range(rng.randint(30, 300))] for _ in range(12)]
    made = [None, "", " \t\n", "one", "One", "two words", "\x1cq \x0b r", "big " * 70_000]
    for _ in range(250):
        words = list(rng.choice(base))
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        made.append(" ".join(words))
    return made + made[:20]


def test_fingerprints_and_components_against_brute_force(spark):
    own = texts()
    ids = [1000 - i if i % 40 else None for i in range(len(own))]
    df = spark.createDataFrame([(i, t, 1, "q") for i, t in zip(ids, own)], "doc_id bigint, text string, fp int, root string")
    codes = [plain_fingerprint(t) for t in own]
    want = sorted(zip(map(str, ids), (f"{c:016x}" for c in codes), map(str, brute_components(ids, codes))))
    got = sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in near_copies(df).collect())
    assert got == want


def test_the_tally_drops_pairs_before_they_are_verified(spark):
    rng = random.Random(8)
    base = [rng.getrandbits(64) for _ in range(40)]
    codes = set(base)
    for code in base:
        for _ in range(6):  # 1 to 8 bytes exchanged
            raw = bytearray(code.to_bytes(8, "little"))
            for at in rng.sample(range(8), rng.randint(1, 5)):
                raw[at] ^= 1 << rng.randrange(8)
            codes.add(int.from_bytes(raw, "little"))
    signed = sorted(c - 2**64 if c >> 63 else c for c in codes)
    posts = simhash.postings(spark.createDataFrame([(c,) for c in signed], "fp bigint"), 4, 7)
    got = {(r.a, r.b): r.shared for r in simhash.tallies(simhash.meetings(posts)).collect()}
    same = lambda a, b: [x == y for x, y in zip(*((c % 2**64).to_bytes(8, "little") for c in (a, b)))]
    pairs = {(a, b): same(a, b) for i, a in enumerate(signed) for b in signed[i + 1 :]}
    assert got == {p: sum(equal) for p, equal in pairs.items() if sum(equal[:7]) >= 4}
    dropped = {p for p, n in got.items() if n < simhash.MIN_SHARED}
    near = {p for p in pairs if ((p[0] ^ p[1]) % 2**64).bit_count() <= 3}
    assert dropped and near and near <= got.keys() - dropped < got.keys()


def ball(rng, centre, bits, n):
    return {centre ^ sum(1 << b for b in rng.sample(bits, rng.randint(0, 4))) for _ in range(n)}


@pytest.mark.parametrize("dense", [5, 100_000])
def test_no_link_is_lost_in_crowded_lists(spark, dense):
    rng = random.Random(dense)
    codes = set()
    for _ in range(6):
        codes |= ball(rng, rng.getrandbits(64), rng.sample(range(64), 24), 150)
    codes |= {rng.getrandbits(64) for _ in range(100)} | {0, 2**64 - 1, 2**63, 2**63 + 7}
    signed = sorted(c - 2**64 if c >> 63 else c for c in codes)
    df = spark.createDataFrame([(i, c) for i, c in enumerate(signed)], "doc_id bigint, fp bigint")
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(df, dense).collect()}
    want = brute_components(list(range(len(signed))), [c % 2**64 for c in signed])
    assert [got[i] for i in range(len(signed))] == want


@pytest.mark.parametrize("stage", [simhash.near_duplicates, corpus_pipeline.drop_near_copies], ids=["op4", "pipeline"])
def test_postings_are_never_broadcast(spark, monkeypatch, stage):
    plans = []

    def recorded(frame):
        plans.append(frame._jdf.queryExecution().executedPlan().toString().split("\n"))
        return settle(frame)

    monkeypatch.setattr(simhash, "settle", recorded)
    monkeypatch.setattr(simhash.near_pairs, "__defaults__", (5,))
    monkeypatch.setattr(simhash.near_duplicates, "__defaults__", (5,))
    if stage is simhash.near_duplicates:
        codes = ball(random.Random(6), 77, range(64), 100)
        stage(spark.createDataFrame([(i, c - 2**64 if c >> 63 else c) for i, c in enumerate(codes)], "doc_id bigint, fp bigint"))
    else:
        docs = spark.createDataFrame([(i, f"{'same words ' * 9}{i}", "", "", 0) for i in range(60)], "doc_id int, text string, lang string, source string, n_chars int")
        stage(spark, docs, "").collect()
    depth = lambda line: re.search("[A-Z]", line).start()
    assert sum("Generate" in line for own in plans for line in own) >= 3
    for own in plans:
        for at, line in enumerate(own):
            if "BroadcastExchange" in line:
                # What is sent to all tasks is no explode's rows: those that a shuffle has counted are sized right.
                below = itertools.takewhile(lambda x: x.strip() and depth(x) > depth(line), own[at + 1 :])
                counted = itertools.takewhile(lambda x: " Exchange " not in f" {x.strip()}", below)
                assert not any("Generate" in x for x in counted), "\n".join(own)


@pytest.mark.parametrize("few", [0, 100_000])
def test_components_of_long_paths_and_hubs(spark, monkeypatch, few):
    monkeypatch.setattr("stowage.llm.components.TASK_LINKS", few)
    rng = random.Random(1)
    path = [(i, i + 1) for i in range(300)]
    hub = [(1000, 1000 + i) for i in range(1, 200)] + [(5, 5), (2000, 2001), (2001, 2000)]
    rng.shuffle(path)
    df = spark.createDataFrame(path + hub, "x bigint, y bigint")
    got = {r.node: r.root for r in components(df, "x", "y").collect()}
    assert got == {i: 0 for i in range(1, 301)} | {1000 + i: 1000 for i in range(1, 200)} | {2001: 2000}


def test_one_document_of_each_group_stays(spark):
    rows = [(9, "a b c d"), (4, "a b c d"), (4, "a b c d"), (None, "a b c d"), (7, "x y z"), (None, "lone one text")]
    rows += [(1, None), (2, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    left = sorted(((r.doc_id, r.text) for r in simhash.one_of_each(df).collect()), key=repr)
    assert left == [(1, None), (4, "a b c d"), (7, "x y z"), (None, "lone one text")]


def test_empty_table(spark):
    assert near_copies(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []
    assert simhash.one_of_each(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []


def test_near_copies_without_ids_leave_one(spark):
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(400)]
    first = " ".join(words)
    copies = (" ".join(words[:k] + ["changed"] + words[k + 1 :]) for k in range(400))
    near = next(t for t in copies if 1 <= (plain_fingerprint(t) ^ plain_fingerprint(first)).bit_count() <= 3)
    df = spark.createDataFrame([(None, first), (None, near), (None, "another text")], "doc_id bigint, text string")
    left = [r.text for r in simhash.one_of_each(df).collect()]
    assert len(left) == 2 and "another text" in left
