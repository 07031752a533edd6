from __future__ import annotations

import hashlib
import random

import pytest
import sentencepiece

from reachway.llm import pieces as P


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=P.model())


@pytest.fixture(scope="module")
def own():
    return P.Pieces(P.model())


def odd_texts():
    rnd = random.Random(11)
    signs = [" ", "  ", "\n", "\t", "a", "aa", "the", "ing", "▁", "\u0000", "�", "é", "é", "ﬁ", "日本語", "𝒳", "👩‍👩‍👧", "İ", "</s>", "<s>", "<unk>", "<0x41>", " ", "　", "\r\n", "1", "0000", ".", "'", "ß", "Ω", "\x7f", "‍"]
    texts = ["", " ", "  ", " a", "a ", "\n", *signs, "a" * 500, " " * 500, "▁ " * 50, "ab" * 400, "日" * 300, "=" * 333, "aaaab" * 99]
    texts += ["".join(rnd.choice(signs) for _ in range(rnd.randrange(1, 60))) for _ in range(3000)]
    texts += ["".join(rnd.choice("etaoin ") for _ in range(rnd.randrange(1, 200))) for _ in range(2000)]
    texts += ["".join(rnd.choice("ab ") for _ in range(rnd.randrange(1, 90))) for _ in range(2000)]
    return texts + ["".join(chr(rnd.choice([rnd.randrange(0x20, 0x250), rnd.randrange(0x370, 0xD7FF), rnd.randrange(0xE000, 0x11000), rnd.randrange(0x1F300, 0x1FAFF)])) for _ in range(rnd.randrange(1, 40))) for _ in range(2000)]


def test_equal_to_the_library(library, own):
    for t in odd_texts():
        want = library.encode(t)
        ids = own.encode(t)
        assert ids.tolist() == want, t
        assert own.decode(ids) == library.decode(want)


def test_all_pieces_and_pairs_of_them(library, own):
    rnd = random.Random(5)
    names = [library.id_to_piece(i) for i in range(library.get_piece_size())]
    for t in [*names, *["".join(rnd.choices(names, k=3)) for _ in range(20_000)]]:
        assert own.encode(t).tolist() == library.encode(t), t


def test_runs_that_are_not_split(library, own):
    for t in odd_texts()[::5]:
        whole = "▁" + t.replace(" ", "▁")
        if t and all(c in own.id for c in whole):
            assert own.table(whole) == library.encode(t), t


def test_full_dictionaries_start_anew(library, monkeypatch):
    monkeypatch.setattr(P, "PARTS", 50)
    monkeypatch.setattr(P, "PAIRS", 50)
    monkeypatch.setattr(P, "MOVES", 50)
    small = P.Pieces(P.model())
    for t in odd_texts()[::7]:
        assert small.encode(t).tolist() == library.encode(t)
        assert len(small.parts) <= 50 and len(small.small) <= 50 and len(small.pairs) <= 50


def test_report(spark, library):
    rows = [(i, t) for i, t in enumerate([*odd_texts()[:200], None, "long text " * 60_000, "x" * 100_000])] + [(None, "null id"), (3, "same id"), (3, "same id")]
    df = spark.createDataFrame([(i, t, "k", 1) for i, t in rows], "doc_id long, text string, ids string, decoded int")
    end = [library.eos_id()]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for i, t in rows:
        ids = library.encode(t or "") + end
        want.append((i, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids))))
    assert sorted(map(tuple, P.pieces_report(df).collect()), key=str) == sorted(want, key=str)
    assert P.pieces_report(df.limit(0)).collect() == []


def test_decode_of_any_ids(spark, library):
    rnd = random.Random(2)
    lists = [None, [], [2], [3 + 0xE6, 3 + 0x97], *[[rnd.randrange(library.get_piece_size()) for _ in range(rnd.randrange(30))] for _ in range(300)]]
    df = spark.createDataFrame(list(enumerate(lists)), "doc_id long, ids array<int>")
    assert [r.text for r in P.decoded(df).orderBy("doc_id").collect()] == [None if x is None else library.decode(x) for x in lists]


def test_automaton():
    rnd = random.Random(3)
    words = sorted({"".join(rnd.choice("ab") for _ in range(rnd.randrange(1, 6))) for _ in range(20)})
    a = P.Automaton([(w, i) for i, w in enumerate(words)])
    text, state = "".join(rnd.choice("abc") for _ in range(3000)), 0
    for end, c in enumerate(text, 1):
        state = a.move(state, c)
        assert a.ends[state] == tuple(sorted(((len(w), i) for i, w in enumerate(words) if text[:end].endswith(w)), reverse=True))


def test_models_of_other_kinds_raise(tmp_path):
    from sentencepiece import sentencepiece_model_pb2 as proto

    spec = proto.ModelProto()
    with open(P.model(), "rb") as f:
        spec.ParseFromString(f.read())
    spec.trainer_spec.model_type = proto.TrainerSpec.UNIGRAM
    (tmp_path / "other.model").write_bytes(spec.SerializeToString())
    with pytest.raises(ValueError):
        P.Pieces(str(tmp_path / "other.model"))
