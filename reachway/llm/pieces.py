"""Encoding to and decoding from the pieces of a merge-type (BPE) SentencePiece model, without running merges over texts.

A list of tokens is the encoding of its text if and only if each token encodes to itself and each two neighbours encode to themselves: merges are chosen by score, then from the left, so that the merges
inside a token, or inside two neighbours, go the same way whatever stands around them. Hence every prefix of a text has one last token: the token that ends there and goes with the last
token of the prefix before it. An automaton over all pieces lists the tokens that end at each place, a table by prefix keeps the last one, and the encoding is read off the table from its end
backwards. Merges are only run over two tokens at a time, to test whether they go together; answers are kept.

No token crosses a place between two characters that no piece has side by side, such as a letter and a mark for a space behind it: texts are encoded in parts that begin at marks, and these in runs of
characters of one kind. Parts and runs that were met before are looked up; the table is for new runs.
"""

from __future__ import annotations

import functools
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reachway.llm.common import prepare

MARK = "▁"
#: Parts that are kept with their ids, pairs that are kept with their answers, moves beyond the trie (all start anew beyond that), and characters of a part that is kept.
PARTS, PAIRS, MOVES, PART_CHARS = 300_000, 400_000, 300_000, 40
#: Ids and characters of decoded text that one batch to Spark holds, about.
BATCH = 2_000_000
SPACED = re.compile(" +[^ ]*")
_ARROW = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])


def model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def merged(text: str, score: dict[str, float]) -> list[str]:
    """The tokens of a short text by the definition: again and again the two neighbours that make the piece of highest score, of equal ones the leftmost."""
    parts = list(text)
    while len(parts) > 1:
        best, at = None, -1
        for i in range(len(parts) - 1):
            s = score.get(parts[i] + parts[i + 1])
            if s is not None and (best is None or s > best):
                best, at = s, i
        if best is None:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


class Automaton:
    """All tokens that end at a place: states are prefixes of tokens, ends has (length, id) of the tokens that end in a state, the longest first. moves has the trie, by state, and of the moves
    beyond it those that were asked for first."""

    def __init__(self, tokens: list[tuple[str, int]]):
        self.moves: list[dict[str, int]] = [{}]
        self.fail: list[int] = [0]
        self.ends: list[tuple[tuple[int, int], ...]] = [()]
        above: list[tuple[int, str]] = [(0, "")]  # the state and the character that lead to a state
        for t, i in tokens:
            state = 0
            for c in t:
                if c not in self.moves[state]:
                    self.moves[state][c] = len(above)
                    above.append((state, c))
                    self.moves.append({})
                    self.fail.append(0)
                    self.ends.append(())
                state = self.moves[state][c]
            self.ends[state] = ((len(t), i),)
        self.spare = 0
        level = [0] * len(above)
        for s in range(1, len(above)):  # a state comes after the one above it
            level[s] = level[above[s][0]] + 1
        for s in sorted(range(1, len(above)), key=level.__getitem__):
            state, c = above[s]
            self.fail[s] = self.move(self.fail[state], c) if state else 0
            self.ends[s] += self.ends[self.fail[s]]
        self.spare = MOVES

    def move(self, state: int, c: str) -> int:
        """The longest state that ends with the character c after this state."""
        at = state
        while (found := self.moves[at].get(c)) is None and at:
            at = self.fail[at]
        found = found or 0
        if self.spare:
            self.spare -= 1
            self.moves[state][c] = found
        return found


def _runs(names: Iterable[str]) -> str:
    """A pattern that cuts texts between characters that no piece has side by side: characters that follow one another in some piece are of one kind, and a run has characters of one kind, with
    the marks before them where pieces have these."""
    kind: dict[str, str] = {}

    def root(c: str) -> str:
        while kind.setdefault(c, c) != c:
            kind[c] = c = kind[kind[c]]
        return c

    for name in names:
        chars = name.lstrip(MARK)
        if len(name) > 1:
            for c in chars:
                kind[root(c)] = root(chars[0])
    kinds: dict[str, list[str]] = {}
    for c in sorted(kind):
        kinds.setdefault(root(c), []).append(c)
    return "|".join([f"{MARK}*[{''.join(map(re.escape, cs))}]+" for cs in sorted(kinds.values(), key=len, reverse=True)] + [f"{MARK}+", "(?s:.)"])


class Pieces:
    """The encoder and decoder of one model file; raises for models whose rules it doesn't know."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto

        spec = proto.ModelProto()
        with open(path, "rb") as f:
            spec.ParseFromString(f.read())
        kinds = proto.ModelProto.SentencePiece
        norm = spec.normalizer_spec
        user = any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in spec.pieces)
        if spec.trainer_spec.model_type != proto.TrainerSpec.BPE or user or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or spec.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError(f"{path} isn't a plain BPE model without normalisation")
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.prefix = MARK if norm.add_dummy_prefix else ""
        self.id = {p.piece: i for i, p in enumerate(spec.pieces) if p.type == kinds.NORMAL}
        self.score = {p.piece: p.score for p in spec.pieces if p.type == kinds.NORMAL}
        self.names = [p.piece for p in spec.pieces]
        self.unknown = self.library.unk_id()
        self.byte = {int(p.piece[3:5], 16): i for i, p in enumerate(spec.pieces) if p.type == kinds.BYTE} if spec.trainer_spec.byte_fallback else {}
        if any(c not in self.id for p in self.id for c in p) or any(MARK in p.lstrip(MARK) for p in self.id):
            raise ValueError(f"{path} has a piece with a character that is no piece, or with a mark behind another character")
        self.runs = re.compile(_runs(self.id))
        self.start, self.base = len(self.names), len(self.names) + 1  # the start stands before the first token
        self.automaton = Automaton([(p, i) for p, i in self.id.items() if merged(p, self.score) == [p]])  # others never come out of merges
        # what each piece is in a text, where that doesn't depend on its neighbours
        control = {i for i, p in enumerate(spec.pieces) if p.type == kinds.CONTROL}
        ascii_bytes = {i: chr(b) for b, i in self.byte.items() if b < 128}
        self.surface = np.array([ascii_bytes.get(i, "" if i in control else p) for i, p in enumerate(self.names)], object)
        self.simple = np.array([p in self.id or i in control or i in ascii_bytes for i, p in enumerate(self.names)])
        self.pairs: dict[int, bool] = {}
        self.parts: dict[str, bytes] = {}
        self.small: dict[str, bytes] = {}

    def together(self, a: int, b: int) -> bool:
        """Whether two tokens, one after the other, encode to themselves; the start goes with all."""
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        known = a == self.start
        if not known:
            x, y = self.names[a], self.names[b]
            known = x + y not in self.score and merged(x + y, self.score) == [x, y]
        self.pairs[a * self.base + b] = known
        return known

    def table(self, run: str) -> list[int]:
        """The encoding of a run, all of whose characters are pieces, by the table of its prefixes."""
        last, size = [self.start], [0]  # by length of the prefix
        base, known, together, moves, ends, state = self.base, self.pairs.get, self.together, self.automaton.moves, self.automaton.ends, 0
        for end, c in enumerate(run, 1):
            after = moves[state].get(c)
            state = self.automaton.move(state, c) if after is None else after
            able = ends[state]
            width, token = able[-1]  # just one goes with the token before it: the shortest, where no other does
            if len(able) > 1:
                for w, t in able[:-1]:
                    before = last[end - w]
                    fine = known(before * base + t)
                    if fine or (fine is None and together(before, t)):
                        width, token = w, t
                        break
            last.append(token)
            size.append(width)
        out, at = [], len(run)
        while at:
            out.append(last[at])
            at -= size[at]
        return out[::-1]

    def char_ids(self, c: str) -> list[int]:
        """The id of a character that stands alone; one that is no piece becomes its bytes, or else the unknown id."""
        own = self.id.get(c)
        return [own] if own is not None else [self.byte[b] for b in c.encode("utf-8", "replace")] if self.byte else [self.unknown]

    def run_ids(self, run: str) -> bytes:
        """The ids of a run, as 32-bit numbers; they are kept."""
        known = array("i", self.table(run) if len(run) > 1 or run in self.id else self.char_ids(run)).tobytes()
        if len(run) <= PART_CHARS:
            if len(self.small) >= PARTS:
                self.small.clear()
            self.small[run] = known
        return known

    def part_ids(self, part: str) -> bytes:
        """The ids of a space mark and a part, from those of its runs; they are kept."""
        get, miss = self.small.get, self.run_ids
        known = b"".join([get(r) or miss(r) for r in self.runs.findall(MARK + part)])
        if len(part) <= PART_CHARS:
            if len(self.parts) >= PARTS:
                self.parts.clear()
            self.parts[part] = known
        return known

    def encode(self, text: str) -> np.ndarray:
        """The ids (32 bits) that the library's encode(text) gives."""
        text = text.replace(MARK, " ")
        if not text or not self.prefix:
            parts = [self.part_ids_of_all(text)]
        else:
            get, miss = self.parts.get, self.part_ids
            # a part is a run of marks but one, with what follows up to the next mark
            words = text.split(" ")
            if "" in words:
                words = SPACED.findall(" " + text)
                words = [w[1:].replace(" ", MARK) for w in words]
            parts = [get(w) or miss(w) for w in words]
        ids = np.frombuffer(b"".join(parts), np.int32)
        return ids if self.byte or not len(ids) else ids[np.r_[True, (ids[1:] != self.unknown) | (ids[:-1] != self.unknown)]]  # without byte pieces a run of unknown characters is one id

    def part_ids_of_all(self, text: str) -> bytes:
        """The ids of a text without a mark before it."""
        return b"".join([self.run_ids(r) for r in self.runs.findall(text.replace(" ", MARK))])

    def decode(self, ids: np.ndarray) -> str:
        """What the library's decode(ids) makes of these ids. Control pieces are nothing; the mark at the start of a text is none of its own. Bytes beyond ASCII and unknown ids go through the library."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.names) or not self.simple[ids].all()):
            return self.library.decode(ids.tolist())
        text = "".join(self.surface[ids].tolist())
        return (text[1:] if self.prefix and text.startswith(MARK) else text).replace(MARK, " ")


@functools.lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def _encoded(path: str, end: bool, decode: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(path)
        tail = np.array([p.library.eos_id()] if end else [], np.int32)
        names, lists, texts, held = [], [], [], 0

        def out() -> pa.RecordBatch:
            offsets = np.cumsum([0, *map(len, lists)], dtype=np.int64).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(lists)))
            return pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), ids, pa.array(texts, pa.string())], schema=_ARROW)

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = np.concatenate([p.encode(text or ""), tail])
                names.append(doc_id)
                lists.append(ids)
                texts.append(p.decode(ids) if decode else None)
                held += len(ids) + len(text or "")
                if held >= BATCH:
                    yield out()
                    names, lists, texts, held = [], [], [], 0
        if names:
            yield out()

    return run


def encoded(docs: DataFrame, path: str | None = None, end: bool = True, decode: bool = False) -> DataFrame:
    """doc_id (long), ids (array of int: the whole text, and the end id where wanted) and decoded (string, null unless wanted) of every row of docs, repeated ones too.

    A null or empty text has no ids but the end. Texts of any length are encoded whole; memory is the longest text with its table, and the bounded dictionaries of a worker. Null ids of documents stay null; other columns,
    whatever their names, are ignored; an empty table gives no rows. One narrow pass without a shuffle.
    """
    prepare(docs.sparkSession)
    slim = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return slim.mapInArrow(_encoded(path or model(), end, decode), "doc_id long, ids array<int>, decoded string")


def _decoded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(path)
        for b in batches:
            texts = [None if ids is None else p.decode(np.array(ids, np.int32)) for ids in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return run


def decoded(coded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id (long) and text of every row of coded (doc_id, ids: array of int). Null ids give a null text, none an empty one; an id outside the model raises."""
    prepare(coded.sparkSession)
    return coded.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>")).mapInArrow(_decoded(path or model()), "doc_id long, text string")


def pieces_report(docs: DataFrame) -> DataFrame:
    """The query: doc_id, n_tokens (all ids), ids_sha256 (of the decimal ids joined by a space) and decoded_sha256 (of the decoded text)."""
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return encoded(docs, decode=True).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
