"""Cross-tokenizer alignment: where two tokenizers agree, and how often each pair of their tokens meets.

Both tokenizers cut the bytes of " " + text. Offsets at which tokens of both end cut the two sequences
into groups, and the two tokens that end there are linked. A link weighs as much as its pair of ids is
linked in the whole corpus; it is a best link if no other partner of its id of tokenizer B weighs more.

Counting is external and side-major (by B id, then A id, then document):

1. Tasks tokenise and gather (pair, document) records up to `CHUNK_LINKS` links. A chunk is sorted once,
   split by the low `RADIX_BITS` bits of the B id, and written as runs of zstd blocks.
2. The runs of a radix are dealt out by chunk to cells of about `CELL_BYTES`, as many as their bytes
   ask for, so that a token that holds a third of all links has more cells instead of a larger one.
   A cell merges its runs through a heap, block by block, into counts per pair.
3. Spark adds the cells' counts up and takes the maximum per B id.
4. Every cell reads its runs again in the same order against its pairs' totals and sends one row per
   chunk back: what the chunk's documents gain.

Text is cut where neither tokenizer can join tokens, before white space that begins with a space or a
line feed, and each distinct piece is encoded once per worker (`MEMO_PIECES`); a vocabulary with tokens
across such a place (`separable`) gets whole texts. Memory of a task: one chunk, or a block per run.

Texts that are null or empty, or that a tokenizer does not reproduce (such as U+2581 for tokenizer B),
have no tokens: zeros, and empty groups. Repeated rows are documents of their own. Other columns are
passed through; what is added begins with two underscores. An empty table stays empty.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import sentencepiece
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stowage.llm.common import small_batches
from stowage.session import settle

# A record's key: B id, A id, place of the document in its chunk.
A_SHIFT, B_SHIFT = 24, 44
ID_LIMIT = 1 << 20
RADIX_BITS = 4
CHUNK_LINKS = 2_000_000
CHUNK_DOCUMENTS = 1 << 16
BLOCK_RECORDS = 16_384
CELL_BYTES = 32 << 20
# Distinct pieces that a worker remembers, and the longest of them.
MEMO_PIECES = 400_000
MEMO_LETTERS = 64

# Everything that any Unicode version or library takes for white space, and some more.
_WIDE = [0x1680, 0x180E, *range(0x2000, 0x2010), 0x2028, 0x2029, 0x202F, *range(0x205F, 0x2065), 0x3000, 0xFEFF]
OTHER_WHITE = r"\t\x0b-\r\x1c-\x1f\x85\xa0" + "".join(map(chr, _WIDE))
WHITE = rf" \n{OTHER_WHITE}"
PIECE = re.compile(rf"[{WHITE}]*[^{WHITE}]+(?:[{OTHER_WHITE}][{WHITE}]*[^{WHITE}]+)*(?:[{OTHER_WHITE}][{WHITE}]*\Z)?|[{WHITE}]+\Z")
ACROSS = re.compile(rf"[^{WHITE}][ \n]")

ADDED = {"__n_a": "bigint", "__n_b": "bigint", "__n_groups": "bigint", "__n_links": "bigint", "__groups_sha256": "string"}


class Tokenizers(NamedTuple):
    """The two vocabulary files: a byte-level BPE as JSON, a sentencepiece model."""

    a: str
    b: bytes


def load(a_path: str, b_path: str) -> Tokenizers:
    with open(a_path, encoding="utf-8") as a, open(b_path, "rb") as b:
        return Tokenizers(a.read(), b.read())


class Piece(NamedTuple):
    """A part of a text in both tokenizers' ids."""

    n_a: int
    n_b: int
    groups: str
    n_groups: int
    links: bytes  # keys without a document, little-endian unsigned 64-bit


def byte_letters() -> dict[str, int]:
    """A byte-level vocabulary writes visible Latin-1 as itself, other bytes as letters from 256 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = (byte for byte in range(256) if byte not in visible)
    return {chr(byte): byte for byte in visible} | {chr(256 + i): byte for i, byte in enumerate(others)}


class Aligner:
    """Both tokenizers; lives in one Python worker."""

    def __init__(self, files: Tokenizers):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self._a = Tokenizer.from_str(files.a)
        self._a.encode_special_tokens = True
        letters = byte_letters()
        self._a_bytes = {}
        for token, number in json.loads(files.a)["model"]["vocab"].items():
            self._a_bytes[number] = bytes(letters[x] for x in token) if letters.keys() >= set(token) else token.encode()
        # Fields of a repeated message replace one another: no space is added, for it is there already.
        self._b = sentencepiece.SentencePieceProcessor(model_proto=files.b + bytes([3 << 3 | 2, 2, 3 << 3, 0]))
        pieces = [self._b.id_to_piece(i) for i in range(self._b.get_piece_size())]
        self._b_bytes = [
            bytes([int(x[3:5], 16)]) if self._b.is_byte(i) else x.replace("▁", " ").encode() for i, x in enumerate(pieces)
        ]
        if max(max(self._a_bytes, default=0), len(pieces)) >= ID_LIMIT:
            raise ValueError(f"ids have to be below {ID_LIMIT}")
        self.separable = not any(ACROSS.search(x.replace("▁", " ")) for x in pieces)
        self._memo: dict[str, Piece | None] = {}

    def _aligned(self, text: str, a: list[int], b: list[int]) -> Piece | None:
        """None if the tokens are not the text."""
        a_bytes, b_bytes = [self._a_bytes[i] for i in a], [self._b_bytes[i] for i in b]
        raw = text.encode()
        if b"".join(a_bytes) != raw or b"".join(b_bytes) != raw:
            return None
        groups, links = [], []
        i = j = end_a = end_b = 0
        while i < len(a):
            from_a, from_b = i, j
            end_a, end_b, i, j = end_a + len(a_bytes[i]), end_b + len(b_bytes[j]), i + 1, j + 1
            while end_a != end_b:
                if end_a < end_b:
                    end_a, i = end_a + len(a_bytes[i]), i + 1
                else:
                    end_b, j = end_b + len(b_bytes[j]), j + 1
            groups.append(f"{','.join(map(str, a[from_a:i]))}|{','.join(map(str, b[from_b:j]))}")
            links.append(b[j - 1] << B_SHIFT | a[i - 1] << A_SHIFT)
        return Piece(len(a), len(b), ";".join(groups), len(groups), np.array(links, "<u8").tobytes())

    def _encoded(self, texts: list[str]) -> Iterator[Piece | None]:
        a = self._a.encode_batch_fast(texts, add_special_tokens=False)
        return map(self._aligned, texts, (x.ids for x in a), self._b.encode(texts, num_threads=1))

    def aligned(self, texts: list[str]) -> Iterator[list[Piece] | None]:
        """The pieces of each text, in order; None where the tokens are not the text."""
        spaced = [f" {text}" for text in texts]
        cut = [PIECE.findall(text) for text in spaced] if self.separable else [[text] for text in spaced]
        unseen = [piece for piece in set().union(*cut) if piece not in self._memo]
        if len(self._memo) + len(unseen) > MEMO_PIECES:
            self._memo = {}
            unseen = list(set().union(*cut))
        known = dict(zip(unseen, self._encoded(unseen)))
        short = {piece: found for piece, found in known.items() if len(piece) <= MEMO_LETTERS}
        self._memo |= short
        long_ones = known if len(short) < len(known) else None
        look = self._memo.__getitem__ if long_ones is None else lambda piece: self._memo[piece] if piece in self._memo else known[piece]
        for pieces in cut:
            found = list(map(look, pieces))
            yield None if None in found else found


@lru_cache(maxsize=1)
def _worker_aligner(files: Tokenizers) -> Aligner:
    return Aligner(files)


# ---------------------------------------------------------------- runs


def _planes(values: np.ndarray) -> bytes:
    """Bytes of equal weight side by side: the high ones of small numbers are all zero."""
    return np.ascontiguousarray(values.view("u1").reshape(len(values), -1).T).tobytes()


def _values(raw: bytes, kind: str, n: int) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, "u1").reshape(width, n).T).view(kind).ravel()


def write_block(keys: np.ndarray, counts: np.ndarray) -> bytes:
    steps = np.diff(keys, prepend=np.uint64(0))
    return zstandard.ZstdCompressor(level=3).compress(_planes(steps) + _planes(counts))


def read_block(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(block)
    n = len(raw) // 12
    return np.cumsum(_values(raw[: 8 * n], "<u8", n), dtype="u8"), _values(raw[8 * n :], "<u4", n)


def write_runs(keys: np.ndarray) -> Iterator[tuple[int, list[bytes]]]:
    """(radix, blocks) of a chunk's links; a document's equal links are one record with a count."""
    keys = np.sort(keys)
    begins = np.flatnonzero(np.diff(keys, prepend=~keys[:1]))
    counts = np.diff(begins, append=len(keys)).astype("<u4")
    keys = keys[begins]
    radix = (keys >> np.uint64(B_SHIFT)) & np.uint64((1 << RADIX_BITS) - 1)
    for digit in np.unique(radix).tolist():
        mine = np.flatnonzero(radix == digit)
        cuts = range(0, len(mine), BLOCK_RECORDS)
        yield digit, [write_block(keys[mine[at : at + BLOCK_RECORDS]], counts[mine[at : at + BLOCK_RECORDS]]) for at in cuts]


class Run:
    """One block of a run at a time."""

    def __init__(self, blocks: Iterable[bytes]):
        self._blocks = iter(blocks)
        self._load()

    def _load(self) -> None:
        block = next(self._blocks, None)
        self.open = block is not None
        if self.open:
            keys, self._counts = read_block(block)
            self._pairs = keys >> np.uint64(A_SHIFT)
            self._at = 0

    @property
    def first(self) -> int:
        return int(self._pairs[self._at])

    @property
    def last(self) -> int:
        return int(self._pairs[-1])

    def take(self, bound: int) -> tuple[np.ndarray, np.ndarray]:
        """What this block still has up to `bound`."""
        end = int(np.searchsorted(self._pairs, np.uint64(bound), "right"))
        taken = self._pairs[self._at : end], self._counts[self._at : end]
        self._at = end
        if end == len(self._pairs):
            self._load()
        return taken


def merged(runs: list[Iterable[bytes]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs and their counts over all runs, ascending: a heap of runs by their next pair."""
    opened = [run for run in map(Run, runs) if run.open]
    heap = [(run.first, i) for i, run in enumerate(opened)]
    heapq.heapify(heap)
    while heap:
        bound = opened[heap[0][1]].last
        pairs, counts = [], []
        while heap and heap[0][0] <= bound:
            run = opened[heap[0][1]]
            part = run.take(bound)
            pairs.append(part[0])
            counts.append(part[1])
            if run.open:
                heapq.heapreplace(heap, (run.first, heap[0][1]))
            else:
                heapq.heappop(heap)
        pairs, counts = np.concatenate(pairs), np.concatenate(counts).astype("i8")
        order = np.argsort(pairs, kind="stable")
        pairs, counts = pairs[order], counts[order]
        begins = np.flatnonzero(np.diff(pairs, prepend=~pairs[:1]))
        yield pairs[begins].astype("i8"), np.add.reduceat(counts, begins)


# ---------------------------------------------------------------- Spark


class Alignment(NamedTuple):
    """`documents`: the input's columns but the text, and counts with two underscores before their names.
    `pairs`: (a, b, n, best) of every pair of ids that is linked anywhere."""

    documents: DataFrame
    pairs: DataFrame


def _tokenised(documents: DataFrame, files: Tokenizers, text: str, with_groups: bool) -> DataFrame:
    """Two kinds of rows: documents (`__radix` null) and the runs of their chunks."""
    spark = documents.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(files)  # two vocabulary files
    passed = [f for f in documents.schema.fields if f.name != text]
    added = {**ADDED, "__groups": "string"} if with_groups else ADDED
    own = {"__chunk": "bigint", "__at": "int", **added, "__radix": "int", "__docs": "int", "__blocks": "array<binary>", "__bytes": "bigint"}
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<binary>": pa.list_(pa.binary())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _worker_aligner(shared.value)
        chunk, docs, links, waiting = TaskContext.get().partitionId() << 32, 0, 0, []
        names = None

        def rows(columns: list, values: dict[str, list]) -> pa.RecordBatch:
            n = len(next(iter(values.values())))
            made = [pa.array(values.get(name, [None] * n), kinds[kind]) for name, kind in own.items()]
            return pa.RecordBatch.from_arrays([*columns, *made], [*names, *own])

        def runs() -> pa.RecordBatch:
            told: dict[str, list] = {"__chunk": [], "__radix": [], "__docs": [], "__blocks": [], "__bytes": []}
            for radix, blocks in write_runs(np.concatenate(waiting)):
                for name, value in zip(told, (chunk, radix, docs, blocks, sum(map(len, blocks)))):
                    told[name].append(value)
            nothing = [pa.nulls(len(told["__radix"]), kind) for kind in types]
            return rows(nothing, told)

        for batch in batches:
            kept = [i for i, name in enumerate(batch.schema.names) if name != text]
            names, types = [batch.schema.names[i] for i in kept], [batch.schema.types[i] for i in kept]
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            told = {name: [] for name in ("__chunk", "__at", *added)}
            for whole, found in zip(texts, aligner.aligned([x or "" for x in texts])):
                found = found if whole and found else []
                n_a, n_b, groups, n_groups, keys = zip(*found) if found else ((), (), (), (), ())
                line = ";".join(groups)
                count = sum(n_groups)
                sha = hashlib.sha256(line.encode()).hexdigest() if found else ""
                values = (chunk, docs, sum(n_a), sum(n_b), count, count, sha, line)
                for name, value in zip(told, values):
                    told[name].append(value)
                if count:
                    waiting.append(np.frombuffer(b"".join(keys), "<u8") | np.uint64(docs))
                docs, links = docs + 1, links + count
                if links >= CHUNK_LINKS or docs >= CHUNK_DOCUMENTS:
                    if waiting:
                        yield runs()
                    chunk, docs, links, waiting = chunk + 1, 0, 0, []
            yield rows([batch.column(i) for i in kept], told)
        if waiting:
            yield runs()

    schema = ", ".join(
        [f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in passed] + [f"{n} {k}" for n, k in own.items()]
    )
    return documents.mapInArrow(run, schema)


def _cells(runs: DataFrame) -> Column:
    """The cell of a run: its radix and, by its chunk, one of as many parts as the radix's bytes ask for."""
    sizes = runs.groupBy("__radix").agg(F.sum("__bytes").alias("n")).collect()  # one row per radix
    parts = {row["__radix"]: -(-row["n"] // CELL_BYTES) for row in sizes}
    of_radix = F.create_map(*(F.lit(x) for item in (parts or {0: 1}).items() for x in item))[F.col("__radix")]
    part = F.pmod(F.xxhash64("__chunk"), of_radix).cast("int")
    return (part * F.lit(1 << RADIX_BITS) + F.col("__radix")).alias("__cell")


def _count(key: tuple, runs: pa.Table) -> pa.Table:
    found = list(merged([run.as_py() for run in runs["__blocks"]]))
    pairs, counts = (np.concatenate(side) for side in zip(*found))
    return pa.table({"__cell": pa.array(np.full(len(pairs), key[0].as_py(), "i4")), "__pair": pairs, "__n": counts})


def _contributions(key: tuple, runs: pa.Table, totals: pa.Table) -> pa.Table:
    """What every chunk of a cell gains: per document the links that are best, and the sum of weights."""
    pairs = totals["__pair"].to_numpy()
    order = np.argsort(pairs)
    pairs, weight = pairs[order].astype("u8"), totals["__total"].to_numpy()[order]
    is_best = totals["__best"].to_numpy(zero_copy_only=False)[order]
    out: tuple[list, list, list] = ([], [], [])
    mask = np.uint64((1 << A_SHIFT) - 1)
    for chunk, docs, blocks in zip(runs["__chunk"].to_pylist(), runs["__docs"].to_pylist(), runs["__blocks"]):
        best, gained = np.zeros(docs, "i8"), np.zeros(docs, "i8")
        for block in blocks.as_py():
            keys, counts = read_block(block)
            at = np.searchsorted(pairs, keys >> np.uint64(A_SHIFT))
            documents, counts = (keys & mask).astype("i8"), counts.astype("i8")
            np.add.at(gained, documents, weight[at] * counts)
            np.add.at(best, documents, np.where(is_best[at], counts, 0))
        for column, value in zip(out, (chunk, best, gained)):
            column.append(value)
    lists = pa.list_(pa.int64())
    return pa.table({"__chunk": pa.array(out[0], pa.int64()), "__best": pa.array(out[1], lists), "__gained": pa.array(out[2], lists)})


def align(documents: DataFrame, files: Tokenizers, text: str = "text", with_groups: bool = False) -> Alignment:
    """Align both tokenizers on every text and weigh the links by the whole corpus.

    Adds `__n_a`, `__n_b`, `__n_groups`, `__n_links`, `__groups_sha256`, `__n_best`, `__count_sum`, and
    with `with_groups` the groups themselves as `__groups`.
    """
    stored, _ = settle(_tokenised(documents, files, text, with_groups))
    runs = stored.where("__radix is not null").select("__radix", "__chunk", "__docs", "__blocks", "__bytes")
    runs = runs.select("__chunk", "__docs", "__blocks", _cells(runs))

    parts, _ = settle(runs.select("__cell", "__blocks").groupBy("__cell").applyInArrow(_count, "__cell int, __pair bigint, __n bigint"))
    b_id = F.shiftright("__pair", B_SHIFT - A_SHIFT)
    totals = parts.groupBy("__pair").agg(F.sum("__n").alias("__total")).withColumn("__b", b_id)
    highest = totals.groupBy("__b").agg(F.max("__total").alias("__highest"))
    weighed = totals.join(highest, "__b").select("__pair", "__b", "__total", (F.col("__total") == F.col("__highest")).alias("__best"))
    weighed, _ = settle(weighed)

    known = parts.select("__cell", "__pair").join(weighed.drop("__b").hint("merge"), "__pair")
    gains = (
        runs.groupBy("__cell")
        .cogroup(known.groupBy("__cell"))
        .applyInArrow(_contributions, "__chunk bigint, __best array<bigint>, __gained array<bigint>")
        .select("__chunk", F.posexplode(F.arrays_zip("__best", "__gained")).alias("__at", "__gain"))
        .groupBy("__chunk", "__at")
        .agg(F.sum("__gain.__best").alias("__n_best"), F.sum("__gain.__gained").alias("__count_sum"))
    )
    rows = stored.where("__radix is null").drop("__radix", "__docs", "__blocks", "__bytes")
    none = F.lit(0).cast("bigint")
    found = rows.join(gains.hint("merge"), ["__chunk", "__at"], "left").drop("__chunk", "__at")
    found = found.withColumns({name: F.coalesce(name, none) for name in ("__n_best", "__count_sum")})
    a_id = F.col("__pair").bitwiseAND(F.lit(ID_LIMIT - 1))
    pairs = weighed.select(a_id.alias("a"), F.col("__b").alias("b"), F.col("__total").alias("n"), F.col("__best").alias("best"))
    return Alignment(found, pairs)
