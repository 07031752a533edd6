"""Packing of tokenised documents into fixed windows by Karmarkar-Karp multiway differencing.

Every document is cut into full windows and a rest; rests are cut into pieces of at most a quarter window and packed in groups.
Within a group the differencing method starts with one partial partition for each piece (the piece in one window, the others empty)
and again and again merges the two partitions of largest spread, pairing the fullest windows of one with the emptiest of the
other, so that their imbalances oppose. The result is near-equal windows; if the fullest exceeds the capacity, the number of windows rises by
one and the group is packed again. Groups never span input partitions: packing is one narrow pass without a shuffle.
"""

from __future__ import annotations

import functools
import heapq
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reachway.llm.common import prepare

WINDOW = 1024
#: Windows that a group of pieces fills together.
GROUP_WINDOWS = 384
#: A group closes this many tokens a window short of full windows, which the last imbalance may take up.
SLACK = 2
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_ARROW = pa.schema([(n.split()[0], pa.int64()) for n in SCHEMA.split(", ")])


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


#: How byte-level BPE of this kind splits texts: the published pattern, with possessive loops.
_SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"


def _byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable ones for themselves, the others from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def _ranked(path: str):
    """An encoder by ranks for the vocabulary of a tokenizers file; None unless the file is a plain byte-level BPE whose n-th merge makes the n-th id after the bytes,
    so that merging by the least rank is merging by the file's order."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, split = spec["model"], spec["pre_tokenizer"] or {}
    plain = {"dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "ignore_merges": False}
    if model["type"] != "BPE" or any((model.get(k) or v) != v for k, v in plain.items()) or spec["normalizer"] or spec["truncation"] or spec["padding"]:
        return None
    if (split.get("type"), split.get("add_prefix_space"), split.get("use_regex")) != ("ByteLevel", False, True):
        return None
    letters, vocabulary = _byte_letters(), model["vocab"]
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in spec["added_tokens"]):
        return None
    if sorted(vocabulary.get(c, -1) for c in letters) != list(range(256)) or any(vocabulary.get(a + b) != 256 + i for i, (a, b) in enumerate(merges)):
        return None
    if set(vocabulary) - set(special) != set(letters) | {a + b for a, b in merges}:
        return None
    ranks = {bytes(letters[c] for c in t): i for t, i in vocabulary.items() if t not in special}
    return functools.partial(tiktoken.Encoding("ranks", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens=special).encode, allowed_special="all")


@functools.lru_cache(maxsize=2)
def encoder(path: str):
    """Texts to the ids that tokenizers' encode(text, add_special_tokens=False) gives.

    Where the file is of the kind that _ranked knows, its ids are found by merging ranks with tiktoken, which takes a quarter of the time (equality is tested over the
    vocabulary, all code points and whole tables); any other file, and any text that fails there, goes to tokenizers itself.
    """
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)

    def exact(text: str) -> list[int]:
        return t.encode(text, add_special_tokens=False).ids

    ranked = _ranked(path)

    def encode(text: str) -> list[int]:
        try:
            return ranked(text)
        except (KeyboardInterrupt, SystemExit, GeneratorExit):
            raise
        except BaseException:  # a panic of its Rust code is no Exception
            return exact(text)

    return encode if ranked else exact


def difference(sizes: list[int], k: int) -> list[list[int]]:
    """Karmarkar-Karp: k lists of indices into sizes with near-equal sums."""
    heap: list[tuple[int, int, tuple]] = []
    for i, s in enumerate(sizes):
        heapq.heappush(heap, (-s, i, ((s, (i,)),)))  # a partial partition: only its windows that hold something, fullest first
    n = len(sizes)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        # fullest first, padded with empty ones to k windows: the i-th of a meets the (k - 1 - i)-th of b
        over = max(0, len(a) + len(b) - k)
        merged = [*a[: len(a) - over], *b[: len(b) - over]]
        merged += [(sa + sb, (ia, ib)) for (sa, ia), (sb, ib) in zip(a[len(a) - over :], reversed(b[len(b) - over :]), strict=True)]
        merged.sort(key=lambda x: -x[0])
        spread = merged[0][0] - (merged[-1][0] if len(merged) == k else 0)
        heapq.heappush(heap, (-spread, n, tuple(merged)))
        n += 1
    out: list[list[int]] = []
    for _, tree in heap[0][2] if heap else ():
        flat, stack = [], [tree]
        while stack:
            x = stack.pop()
            if isinstance(x, tuple):
                stack.extend(x)
            else:
                flat.append(x)
        out.append(sorted(flat))
    return out


def pack(sizes: list[int], capacity: int) -> list[list[int]]:
    """Indices of sizes by window; the number of windows starts at the least possible and rises whenever one exceeds the capacity."""
    if not sizes:
        return []
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        windows = difference(sizes, k)
        if max(sum(sizes[i] for i in w) for w in windows) <= capacity:
            return windows
        k += max(1, k // 256)


def packer(path: str, window: int, group_windows: int):
    piece = max(1, window // 4)
    full = max(1, group_windows * window - min(SLACK * group_windows, window - 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        context = TaskContext.get()
        next_id = (context.partitionId() if context else 0) << 32
        rows: list[tuple] = []
        rests: list[tuple] = []
        held = 0

        def close() -> None:
            nonlocal next_id, held
            for w in pack([r[2] for r in rests], window):
                at = 0
                for i in w:
                    rows.append((*rests[i], next_id, at))
                    at += rests[i][2]
                next_id += 1
            rests.clear()
            held = 0

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=_ARROW)
            rows.clear()
            return batch

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = np.array(encode(text or "") + [0], dtype="<u4")
                raw, n, at = ids.tobytes(), len(ids), 0
                while n - at >= window:
                    rows.append((doc_id, at, window, zlib.crc32(raw[4 * at : 4 * (at + window)]), n, next_id, 0))
                    next_id += 1
                    at += window
                while at < n:
                    size = min(piece, n - at)
                    size = min(size, full - held)
                    rests.append((doc_id, at, size, zlib.crc32(raw[4 * at : 4 * (at + size)]), n))
                    held += size
                    at += size
                    if held >= full:
                        close()
                if len(rows) >= 20_000:
                    yield flush()
        close()
        if rows:
            yield flush()

    return run


def pack_documents(docs: DataFrame, window: int = WINDOW, tokenizer: str | None = None, group_windows: int = GROUP_WINDOWS) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (all long).

    A document is its ids and the closing id 0; a null or empty text is that id alone. Every row is packed as a document of its own,
    repeated ids and null ids too. Other columns are ignored. Sequence ids are unique over the result (partition number times
    2**32 plus a count), offsets are gapless from 0. An empty table gives no rows. Memory: one group's pieces (group_windows windows) and the
    longest text.
    """
    prepare(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(packer(tokenizer or vocabulary(), window, group_windows), SCHEMA)
