"""Token counts, packing and the piece lattice against the libraries."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest

from siltlog.llm.packing import HarmonicBins, pack_documents
from siltlog.llm.piece_lattice import MARK, Pieces, encode, words_of
from siltlog.llm.token_counts import ChunkEncoder, count_tokens

from .helpers import ODD, frame, prose

TEXTS = ODD + [prose(1, 50), prose(1, 50), prose(2, 3000), ("ab  " * 40 + "x" * 300 + "\n") * 20, "İSTANBUL ΣΑΣ ﬁ Ａ x́ ́z 's 'RE l'été", "x y\x0bz\x85w"]


@pytest.fixture(scope="module")
def piece_library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))


def test_counts_are_the_librarys(spark, piece_library):
    df = count_tokens(frame(spark, TEXTS), P.path("piece_bpe_32k.model"), limit=100)
    got = {r.doc_id: r for r in df.collect()}
    for i, t in enumerate(TEXTS):
        n = len(piece_library.encode(t or ""))
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (n, len((t or "").encode()), n > 100)
    assert count_tokens(frame(spark, ["x"]).where("false"), P.path("piece_bpe_32k.model")).count() == 0


@pytest.mark.parametrize(("chunk", "overlap"), [(64, 8), (50, 40), (1000, 16)])
def test_splices_are_exact(piece_library, chunk, overlap):
    enc = ChunkEncoder(P.path("piece_bpe_32k.model"), chunk, overlap)
    for t in TEXTS:
        assert enc.count(t or "") == len(piece_library.encode(t or "")), t


def test_packing_covers_each_id_once(spark):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    want = [[*lib.encode(t or "", add_special_tokens=False).ids, 2] for t in TEXTS]
    for capacity in (64, 4096):
        rows = pack_documents(frame(spark, TEXTS).coalesce(2), P.path("word_bpe_49k.json"), capacity=capacity, with_ids=True).collect()
        pieces, sequences = defaultdict(list), defaultdict(list)
        for r in rows:
            pieces[r.doc_id].append(r)
            sequences[r.sequence_id].append(r)
            assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length
        for i, ids in enumerate(want):
            parts = sorted(pieces[i], key=lambda r: r.start)
            assert [x for r in parts for x in r.ids] == ids and all(r.doc_tokens == len(ids) for r in parts)
            assert [r.start for r in parts] == np.cumsum([0] + [r.length for r in parts])[:-1].tolist()
        short = 0
        for s in sequences.values():
            s.sort(key=lambda r: r.offset)
            assert [r.offset for r in s] == np.cumsum([0] + [r.length for r in s])[:-1].tolist()
            assert sum(r.length for r in s) <= capacity
            short += sum(r.length for r in s) < 0.9 * capacity
        assert short <= 2
    assert pack_documents(frame(spark, ["x"]).where("false"), P.path("word_bpe_49k.json")).count() == 0


def test_class_lengths_fill_their_bins():
    bins = HarmonicBins(4096)
    for left in range(1, 4097):
        n = bins.piece_length(left)
        assert n <= left and n == 4096 // (4096 // n)
        assert left == n or 4096 // (4096 // (n + 1)) > left or 4096 // (4096 // (n + 1)) == n or n + 1 > left


def test_lattice_is_the_best_path_and_decodes(spark):
    pieces = Pieces(P.path("piece_bpe_32k.model"))
    rows = {r.doc_id: r for r in encode(frame(spark, TEXTS), P.path("piece_bpe_32k.model"), hot=20, with_ids=True).collect()}
    for i, t in enumerate(TEXTS):
        want = [x for w in words_of(t or "") for x in pieces.ids(pieces.best(w))]
        assert rows[i].ids == want and rows[i].n_pieces == len(want) and rows[i].round_trip
        assert pieces.decode(rows[i].ids) == (t or "").replace(MARK, " ")


def test_lattice_agrees_with_the_librarys_lattice():
    from sentencepiece import SentencePieceProcessor
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    with open(P.path("piece_bpe_32k.model"), "rb") as f:
        model.ParseFromString(f.read())
    model.trainer_spec.model_type = 1
    lib, pieces = SentencePieceProcessor(model_proto=model.SerializeToString()), Pieces(P.path("piece_bpe_32k.model"))
    score = lambda ids: sum(pieces.score[pieces.pieces[i]][0] for i in ids)
    for w in words_of(prose(5, 400)):
        assert score(pieces.best(w)) == max(score(x) for x in lib.nbest_encode_as_ids(w[1:], 64))


def test_splices_of_random_texts_are_exact(piece_library):
    import random

    r = random.Random(4)
    parts = ["a", "the", " ", "  ", " Wort", "é", "🔑", "\n", "ing", "x1", MARK, "<s>", "   ", "tion", "日本", "\x00"]
    for chunk, overlap in ((40, 8), (17, 3), (200, 32)):
        enc = ChunkEncoder(P.path("piece_bpe_32k.model"), chunk, overlap)
        for _ in range(400):
            t = "".join(r.choice(parts) for _ in range(r.randrange(160)))
            assert enc.count(t) == len(piece_library.encode(t)), t


def test_repeated_rows_each_get_a_row(spark):
    df = frame(spark, ["a b", "a b", None, "c"], ids=[1, 1, 1, None])
    for out in (count_tokens(df, P.path("piece_bpe_32k.model")), encode(df, P.path("piece_bpe_32k.model"), hot=2)):
        assert sorted(-1 if x.doc_id is None else x.doc_id for x in out.collect()) == [-1, 1, 1, 1]


@pytest.mark.parametrize("step", [3, 7, 1 << 20])
def test_cut_texts_have_the_best_path_of_whole_words(monkeypatch, step):
    import random

    from siltlog.llm import piece_lattice

    monkeypatch.setattr(piece_lattice, "STEP", step)
    r, pieces = random.Random(1), Pieces(P.path("piece_bpe_32k.model"))
    parts = ["a", "the", " ", "  ", " Wort", "é", "🔑", "\n", "ing", "x1", MARK, "<s>", "   ", "tion", "日本", "\x00", "aaaa" * 5, "zq"]
    for _ in range(500):
        t = "".join(r.choice(parts) for _ in range(r.randrange(40)))
        want = [x for w in words_of(t.replace(MARK, " ")) for x in pieces.ids(pieces.best(w))]
        got = b"".join(pieces.spelled(pieces.units(t), lambda w: pieces.packed(pieces.best(w))))
        assert np.frombuffer(got, "<u4").tolist() == want, t


def test_a_unit_that_many_blocks_have_is_cut_once(monkeypatch):
    from siltlog.llm import piece_lattice as L

    pieces, r = Pieces(P.path("piece_bpe_32k.model")), random.Random(4)
    words = [*dict.fromkeys(u for t in TEXTS for u in pieces.units(t or ""))]
    blocks = [(k, r.sample(words, min(len(words), n))) for k, n in ((3, 40), (0, 0), (3, 9), (70, 40), (5, 1))]
    cut, atoms = [], Pieces.atoms
    monkeypatch.setattr(Pieces, "atoms", lambda self, s: cut.append(len(s)) or atoms(self, s))
    units = L.numbers()
    had = [(k, np.array([units[u] for u in own], np.int64)) for k, own in blocks]
    got = dict(zip(*(x.to_pylist() for x in L.atoms_of(units, had, pieces)), strict=True))
    want = {}
    for k, own in blocks:
        for w in {w for u in own for w in atoms(pieces, u) if len(w) <= L.MOST}:
            want.setdefault(w, set()).add(k)
    assert got == {w: sorted(x) for w, x in want.items()}
    assert cut == [sum(len(u) + 1 for u in units)]
    assert [x.to_pylist() for x in L.atoms_of(L.numbers(), [(0, np.zeros(0, np.int64))], pieces)] == [[], []]


def test_units_not_spelled_by_their_ids_are_named():
    pieces = Pieces(P.path("piece_bpe_32k.model"))
    units = pieces.units("the cat 日本 \x00 é the")
    packed = pieces.spelled(units, lambda w: pieces.packed(pieces.best(w)))
    assert pieces.strange(units, packed) == [] == pieces.strange([], [])
    assert pieces.strange(units, [packed[1], packed[0], *packed[2:]]) == units[:2]
    assert pieces.strange(["ab", "c"], pieces.spelled(["a", "bc"], lambda w: pieces.packed(pieces.best(w)))) == ["ab", "c"]


def test_each_new_word_is_encoded_once():
    from siltlog.llm.packing import WordEncoder
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    texts = [t or "" for t in TEXTS] + [prose(i, 40) + ", été! straße;" for i in range(20)]
    for limit in (10, 600_000):
        enc, asked = WordEncoder(P.path("word_bpe_49k.json"), limit), []
        learn = enc.memo.of
        enc.memo.of = lambda w, learn=learn, asked=asked: asked.append(w) or learn(w)
        for t in texts:
            assert np.frombuffer(enc.encode([t])[0], "<u4").tolist() == lib.encode(t, add_special_tokens=False).ids, t
        if limit > 10:
            assert len(asked) == len(set(asked))


def test_lattice_drops_what_is_used_up(spark, monkeypatch):
    """Only the bundles of atoms are left when the texts are dealt."""
    from pathlib import Path

    from siltlog.llm import piece_lattice

    made = []

    class Seen(piece_lattice.Stage):
        def __init__(self, *args):
            super().__init__(*args)
            made.append(self)

    monkeypatch.setattr(piece_lattice, "Stage", Seen)
    out = encode(frame(spark, TEXTS), P.path("piece_bpe_32k.model"), hot=20)
    assert [x.name[4:] for x in Path(made[0].root.removeprefix("file:")).iterdir()] == ["bundles"]
    assert out.count() == len(TEXTS)


def test_paths_of_the_lattice_are_packed_ids(spark):
    """Nothing is left to do with them in Python, for characters without a piece either."""
    from siltlog.llm.piece_lattice import lattice

    pieces = Pieces(P.path("piece_bpe_32k.model"))
    words = ["▁the", "ation", "▁onhaereth", "͸", "\U000e0001", "\x00", "é", "日本", "🔑"]
    rows = lattice(spark.createDataFrame([(w,) for w in words], "word string"), spark, pieces).collect()
    assert {r.word: bytes(r.path) for r in rows} == {w: pieces.packed(pieces.best(w)) for w in words}


def test_units_of_a_block_are_spelled_once(monkeypatch):
    """However its texts come, and however much is held."""
    from siltlog.llm import piece_lattice as L

    pieces = Pieces(P.path("piece_bpe_32k.model"))
    of = lambda w: pieces.packed(pieces.best(w))
    texts = [t or "" for t in TEXTS if len(t or "") < 5000]
    want = [b"".join(pieces.spelled(pieces.units(t), of)) for t in texts]
    cut, atoms = [], Pieces.atoms
    monkeypatch.setattr(Pieces, "atoms", lambda self, s: cut.append(s) or atoms(self, s))
    for held, step in ((L.HELD, 1), (L.HELD, len(texts)), (0, 2)):
        monkeypatch.setattr(L, "HELD", held)
        cut.clear()
        spelling = L.Spelling(pieces, L.Known(of))
        got = [x for i in range(0, len(texts), step) for x in spelling.texts(texts[i : i + step])]
        assert [(ids.tobytes(), same) for ids, same in got] == [(w, True) for w in want]
        units = [u for s in cut for u in s.split(L.GAP)[:-1]]
        assert len(units) == len(set(units)) or not held
    assert [*L.Spelling(pieces, L.Known(of)).texts([])] == []
    wrong = L.Spelling(pieces, L.Known(lambda w: of("x" if w == "日" else w)))
    assert [same for _, same in wrong.texts(["the cat", "the 日", "", "cat the"])] == [True, False, True, True]


def test_words_of_many_blocks_are_bundled_in_parts(monkeypatch):
    import pyarrow as pa

    from siltlog.llm import piece_lattice as L

    monkeypatch.setattr(L, "HELD", 4)
    b = pa.RecordBatch.from_arrays([pa.array([*"abcdef"]), pa.array([[1], [2, 3], [1, 2], [*range(9)], [4], []], pa.list_(pa.int32()))], ["word", "blocks"])
    assert [x.column(0).to_pylist() for x in L.light(b)] == [["a", "b"], ["c"], ["d"], ["e", "f"]]
    assert [x.column(1).flatten().to_pylist() for x in L.light(b)] == [[1, 2, 3], [1, 2], [*range(9)], [4]]
    assert [*L.light(b.slice(0, 0))] == []


def test_pieces_that_others_spell_better_stay_out_of_the_lattice():
    """They are on no best path, so the paths are those of the whole table."""
    pieces, r = Pieces(P.path("piece_bpe_32k.model")), random.Random(7)
    out = [p for p in pieces.score if p not in pieces.used]
    assert out and pieces.used and max(map(len, out)) > 1
    for p in r.sample(out, 200):
        path = pieces.best(p)
        assert sum(pieces.score[pieces.pieces[i]][0] for i in path) > pieces.score[p][0]
    words = {w for t in TEXTS for w in words_of((t or "")[:4000])} | {"".join(r.sample(out, 3)) for _ in range(300)}
    assert not {pieces.pieces[i] for w in words for i in pieces.best(w) if i >= 0} & {*out}


@pytest.mark.parametrize("strip", [1, 50, 1 << 21])
def test_units_are_numbered_as_they_are_cut(monkeypatch, strip):
    """Of whole columns at once, nulls, empty texts and runs of blanks included, and by each task in parts."""
    import pyarrow as pa

    from siltlog.llm import piece_lattice as L

    monkeypatch.setattr(L, "STRIP", strip)
    monkeypatch.setattr(L, "LEARNT", 7)
    pieces = Pieces(P.path("piece_bpe_32k.model"))
    texts = [t if t is None else t[:300] for t in TEXTS] + [" ", "  ", " a", "a  b", "a ", f"{MARK} x", "\n"]
    units, flat, n = pieces.numbered(pa.array(texts))
    got = [L.listed(units)[i] for i in flat]
    assert [got[j - k : j] for j, k in zip(np.cumsum(n), n, strict=True)] == [pieces.units(t or "") for t in texts]

    class Docs:
        def mapInArrow(self, run, schema):
            return run

    blocks = [i % 3 for i in range(len(texts))]
    b = pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), pa.array(range(len(texts))), pa.array(texts)], ["block", "doc_id", "text"])
    want = defaultdict(set)
    for k, t in zip(blocks, texts, strict=True):
        for w in pieces.atoms(L.GAP.join([*pieces.units(t or ""), ""])):
            if w != L.GAP and len(w) <= L.MOST:
                want[w].add(k)
    for held in (L.HELD, 3):
        monkeypatch.setattr(L, "HELD", held)
        found = defaultdict(set)
        for x in L.held_by(Docs(), pieces)(iter([b, b.slice(0, 0)])):
            for w, ks in zip(*(c.to_pylist() for c in x.columns), strict=True):
                found[w].update(ks)
        assert found == want
