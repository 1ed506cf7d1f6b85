"""SentencePiece encoding and decoding on a relational lattice.

Texts are cut between two characters that stand side by side in no piece: no piece crosses such a place, so the best path goes through it. The parts
("atoms", a word or less) are the lattice's words. The distinct atoms' substrings of bounded length are exploded and equi-joined to the piece table, the edges
are grouped by atom, and a fold with Spark's higher-order ``aggregate`` keeps the best path to each place (Viterbi; of equal scores the longer last piece).
A character without a piece costs the least score less 10 and becomes its bytes' pieces.
A piece that scores less than other pieces that spell it is on no best path, as these could stand in its place: the lattice and the cuts leave it out.

The table is a model file's pieces and scores, read as a unigram model: the result is the best path
of the library's own lattice (its n-best search) when the file's model type is set to unigram. For a file trained as BPE this is the best-scoring segmentation, which can differ from its merges.

Documents are dealt to blocks by a hash of id and text. The paths of the ``hot`` atoms that most blocks hold are sent to all tasks (a stated bound); the
others' go, by an equi-join on the atom, to the blocks that hold them. Atoms of over ``MOST`` characters are folded by the same recurrence in the task that
holds them, as their edges have no bound.

Nulls: a null text is empty and has no pieces; a null id is kept. Repeated rows each get a row, an empty table gives none, other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from itertools import chain, count, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stage, lean, rows_for, table, texts_of
from .messages import MESSAGE, gathered, sent

MARK = "▁"
WORD = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n")
MOST = 64
#: Atoms or units a task holds at once; of their blocks, four times as many.
HELD = 300_000
#: Characters cut at once, and ids spelled out at once.
STEP = 1 << 20
#: Characters of a block's texts whose units are known at once.
TAKEN = 1 << 22
#: Bytes or characters of texts whose units are numbered at once, and units cut or spelled at once.
STRIP = 1 << 21
LEARNT = 1 << 16
#: Stands between units; no valid text holds it.
GAP = "\ud800"
#: Its packed id.
END = b"\xff" * 4
#: Atoms a lattice task groups by hashing before it sorts.
FALLBACK = "spark.sql.objectHashAggregate.sortBased.fallbackThreshold"
GROUPED = 1 << 16
OUT = "doc_id long, n_pieces long, ids_crc32 long, round_trip boolean"


class Known(dict):
    """The packed ids of atoms, asked for once each; a gap has its own."""

    def __init__(self, of: Callable[[str], bytes]):
        super().__init__({GAP: END})
        self.of = of

    def __missing__(self, w: str) -> bytes:
        self[w] = got = self.of(w)
        return got


class Pieces:
    def __init__(self, model: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        n = sp.vocab_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        normal = [i for i in range(n) if not (sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.score = {self.pieces[i]: (sp.get_score(i), i) for i in normal}
        self.byte = {int(self.pieces[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.value = {i: b for b, i in self.byte.items()}
        self.unknown = min(s for s, _ in self.score.values()) - 10
        self.longest = max(map(len, self.score))
        self.used = {p: s for p, (s, _) in self.score.items() if self.split(p) <= s + 1e-6 * abs(s)}
        if any(re.search(f"[^{MARK}]{MARK}|\n", p) for p in self.score):
            raise ValueError("a piece crosses a word's boundary")
        # a number for each character of pieces of two and more (0: none of them), and which pairs of them stand side by side in a piece
        joined = {p[i : i + 2] for p in self.used for i in range(len(p) - 1)}
        number = {c: i + 1 for i, c in enumerate(sorted(set("".join(joined))))}
        self.number = np.zeros(0x110000, np.int32)
        for c, i in number.items():
            self.number[ord(c)] = i
        self.side = np.zeros((len(number) + 1, len(number) + 1), bool)
        for a, b in joined:
            self.side[number[a], number[b]] = True
        self.alone = next(chr(i) for i in range(1, 0xD800) if not self.number[i])
        self.bytes = [bytes([self.value[i]]) if i in self.value else p.encode() for i, p in enumerate(self.pieces)]
        apart = [*self.bytes, b" "]  # no unit holds a blank
        self.apart, self.apart_n = np.frombuffer(b"".join(apart), np.uint8), np.array([len(b) for b in apart])
        self.apart_at = np.cumsum(self.apart_n) - self.apart_n

    def split(self, piece: str) -> float:
        """The best score of two or more pieces that spell this one."""
        n = len(piece)
        best = [0.0] + [-np.inf] * n
        for b in range(1, n + 1):
            for a in range(b):
                if b - a < n and (got := self.score.get(piece[a:b])) and best[a] + got[0] > best[b]:
                    best[b] = best[a] + got[0]
        return best[n]

    def units(self, text: str) -> list[str]:
        """The text's parts from one blank, as a mark, to the next; where a piece holds two marks, runs of blanks stay with what follows."""
        if not text:
            return []
        text = text.replace(MARK, " ")
        if self.side[self.number[ord(MARK)], self.number[ord(MARK)]] and (text[0] == " " or "  " in text):
            return words_of(text)
        return (MARK + text.replace(" ", GAP + MARK)).split(GAP)

    def numbered(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """The distinct ``units`` of texts, the number of each unit of one text after another, and how many units each text has."""
        texts = pc.replace_substring(texts.cast(pa.large_string()).fill_null(""), MARK, " ")
        mark, none = pa.scalar(MARK, pa.large_string()), pa.scalar("", pa.large_string())
        parts = pc.split_pattern(pc.binary_join_element_wise(mark, pc.replace_substring(texts, " ", " " + MARK), none), " ")
        other = pc.equal(texts, "")
        if self.side[self.number[ord(MARK)], self.number[ord(MARK)]]:
            other = pc.or_(other, pc.or_(pc.starts_with(texts, " "), pc.match_substring(texts, "  ")))
        rows = np.flatnonzero(other.to_numpy(zero_copy_only=False))
        if len(rows):
            order = np.arange(len(texts))
            order[rows] = len(texts) + np.arange(len(rows))
            own = pa.array([*map(self.units, texts.take(pa.array(rows)).to_pylist())], parts.type)
            parts = pa.concat_arrays([parts, own]).take(pa.array(order))
        flat = parts.flatten().dictionary_encode()
        return flat.dictionary, flat.indices.to_numpy(), parts.value_lengths().to_numpy()

    def atoms(self, s: str) -> list[str]:
        """A marked string, cut wherever two characters stand side by side in no piece; a gap is a part by itself."""
        out: list[str] = []
        open_: list[str] = []
        before = 0
        for at in range(0, len(s), STEP):
            part = s[at : at + STEP]
            numbers = self.number.take(np.frombuffer(part.replace(GAP, self.alone).encode("utf-32-le", "surrogatepass"), "<u4"))
            cuts = (np.flatnonzero(~self.side.ravel().take(numbers[:-1] * len(self.side) + numbers[1:])) + 1).tolist()
            got = [part[i:j] for i, j in zip([0, *cuts], [*cuts, len(part)], strict=True)]
            if open_ and not self.side[before, numbers[0]]:
                out.append("".join(open_))
                open_ = []
            open_.append(got[0])
            if len(got) > 1:
                out.append("".join(open_))
                out += got[1:-1]
                open_ = [got[-1]]
            before = numbers[-1]
        if open_:
            out.append("".join(open_))
        return out

    def run(self, units: list[str], known: Known) -> np.ndarray:
        """The ids of units one after another, ``END`` after each."""
        return np.frombuffer(b"".join(map(known.__getitem__, self.atoms(GAP.join([*units, ""])))), "<u4")

    def spelled(self, units: list[str], of: Callable[[str], bytes]) -> list[bytes]:
        """The packed ids of each unit; ``of`` gives an atom's."""
        found = self.run(units, Known(of))
        ends = np.flatnonzero(found == 0xFFFFFFFF).tolist()
        return [found[i:j].tobytes() for i, j in zip([0, *(e + 1 for e in ends[:-1])], ends, strict=True)] if units else []

    def spelt(self, ids: np.ndarray) -> Iterator[np.ndarray]:
        """The bytes of ids, strip by strip; an end gives a blank's."""
        for i in range(0, len(ids), STEP):
            own = np.minimum(ids[i : i + STEP], len(self.bytes))
            yield self.apart[taken(self.apart_at[own], self.apart_n[own])]

    def odd(self, units: list[str], run: np.ndarray) -> list[int]:
        """The numbers of the units that their ids in a run do not spell."""
        want, at = " ".join([*units, ""]).encode(), 0
        for got in self.spelt(run):
            if got.tobytes() != want[at : at + len(got)]:
                break
            at += len(got)
        else:
            if at == len(want):
                return []
        ends = np.flatnonzero(run == 0xFFFFFFFF).tolist()
        parts = (run[i:j] for i, j in zip([0, *(e + 1 for e in ends[:-1])], ends, strict=True))
        return [k for k, (u, ids) in enumerate(zip(units, parts, strict=True)) if b"".join(x.tobytes() for x in self.spelt(ids)) != u.encode()]

    def strange(self, units: list[str], packed: list[bytes]) -> list[str]:
        """The units that their packed ids do not spell."""
        return [units[k] for k in self.odd(units, np.frombuffer(b"".join(p + END for p in packed), "<u4"))]

    def of_bytes(self, character: Column) -> Column:
        """The packed ids of a character's bytes."""
        if len(self.byte) < 256:
            return F.raise_error(F.concat(F.lit("no piece, and no pieces of its bytes: "), character)).cast("binary")
        ids, own = F.lit(b"".join(self.byte[b].to_bytes(4, "little") for b in range(256))), character.cast("binary")
        at = [F.conv(F.hex(F.substr(own, F.lit(i + 1), F.lit(1))), 16, 10).cast("int") * 4 + 1 for i in range(4)]
        return F.concat(*(F.when(F.octet_length(own) > i, F.substr(ids, at[i], F.lit(4))).otherwise(F.lit(b"")) for i in range(4)))

    def best(self, word: str) -> list[int]:
        """The recurrence of the fold, for one word."""
        n = len(word)
        score, back = [0.0] + [-np.inf] * n, [(0, 0)] * (n + 1)
        for a in range(n):
            for b in range(a + 1, min(n, a + self.longest) + 1):
                s, i = self.score.get(word[a:b], (None, 0))
                if s is None and b == a + 1:
                    s, i = self.unknown, -1 - ord(word[a])
                if s is not None and score[a] + s > score[b]:
                    score[b], back[b] = score[a] + s, (a, i)
        out = []
        while n:
            n, i = back[n]
            out.append(i)
        return out[::-1]

    def ids(self, path: Iterable[int]) -> list[int]:
        """Unknown characters (negative) as their bytes' pieces."""
        return list(chain.from_iterable((i,) if i >= 0 else map(self.byte.__getitem__, chr(-1 - i).encode("utf-8", "surrogatepass")) for i in path))

    def packed(self, path: Iterable[int]) -> bytes:
        """A path's ids as little-endian uint32."""
        return np.asarray(self.ids(path), "<u4").tobytes()

    def decode(self, ids: Iterable[int]) -> str:
        out = b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")
        return out.replace(MARK, " ")[1:]


def words_of(text: str) -> list[str]:
    return WORD.findall(MARK + text.replace(" ", MARK)) if text else []


def lattice(words: DataFrame, spark: SparkSession, table_: Pieces) -> DataFrame:
    """(word, path) of distinct words, which must come partitioned by word: then nothing is shuffled. A path is its packed ids.

    An edge is one number: its end, its begin, then 21 bits for its piece, or their count for a character without one."""
    used, longest = [*table_.used], max(map(len, table_.used))
    pieces = spark.createDataFrame([*zip(used, range(len(used)), strict=True)], "piece string, i long")
    scores = F.split(F.lit(",".join(map(repr, [*table_.used.values(), table_.unknown]))), ",").cast("array<double>")
    packed = F.lit(b"".join(table_.score[p][1].to_bytes(4, "little") for p in used))
    ends = words.select("word", F.explode(F.sequence(F.lit(1), F.char_length("word"))).alias("b"))
    edges = ends.select("word", "b", F.explode(F.sequence(F.greatest(F.lit(0), F.col("b") - longest), F.col("b") - 1)).alias("a"))
    edges = edges.withColumn("piece", F.substr("word", F.col("a") + 1, F.col("b") - F.col("a"))).join(F.broadcast(pieces), "piece", "left")
    edges = edges.where(F.col("i").isNotNull() | (F.col("b") == F.col("a") + 1))
    edge = F.shiftleft(F.col("b").cast("long"), 42) + F.shiftleft(F.col("a").cast("long"), 21) + F.coalesce("i", F.lit(len(used)))
    grouped = edges.select("word", edge.alias("e")).groupBy("word").agg(F.sort_array(F.collect_list("e")).alias("edges"))
    none = F.array(F.struct(F.lit(0.0).alias("s"), F.lit(b"").alias("path")))

    def reach(best: Column, e: Column) -> Column:
        """The best (score, path) to each place so far; edges come by end, then by begin. A place's first edge appends, a better one replaces."""
        b, i = F.shiftright(e, 42).cast("int"), e.bitwiseAND((1 << 21) - 1).cast("int")
        from_ = best[F.shiftright(e, 21).bitwiseAND((1 << 21) - 1).cast("int")]
        s = from_["s"] + scores[i]
        ids = F.when(i < len(used), F.substr(packed, i * 4 + 1, F.lit(4))).otherwise(table_.of_bytes(F.substr("word", b, F.lit(1))))
        made = F.struct(s.alias("s"), F.concat(from_["path"], ids).alias("path"))
        return F.when(b == F.size(best), F.array_append(best, made)).when(s > best[b]["s"], F.array_append(F.slice(best, F.lit(1), b), made)).otherwise(best)

    return grouped.select("word", F.element_at(F.aggregate("edges", none, reach), -1)["path"].alias("path"))


def numbers() -> defaultdict[str, int]:
    """Keys asked for are numbered as they come."""
    return defaultdict(count().__next__)


def taken(begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The places of stretches, one after another, that have these begins and lengths."""
    return np.arange(n.sum()) + np.repeat(begin - (np.cumsum(n) - n), n)


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted, of numbers from 0; numpy's own ``unique`` hashes, which takes longer."""
    x = np.sort(x)
    return x[np.diff(x, prepend=-1) > 0]


def listed(units: pa.Array) -> list[str]:
    """Units, which hold no blanks, as a list."""
    whole = pa.ListArray.from_arrays(pa.array([0, len(units)], pa.int32()), units)
    return pc.binary_join(whole, pa.scalar(" ", units.type))[0].as_py().split(" ") if len(units) else []


class Spelling:
    """The ids of texts by those of their units: each unit is spelled once, until more than ``HELD`` are known as texts come and all are forgotten."""

    def __init__(self, pieces: Pieces, known: Known):
        self.pieces, self.known = pieces, known
        self.clear()

    def clear(self) -> None:
        self.units = pa.array([], pa.large_string())
        self.ids, self.begin, self.n, self.odd = np.zeros(0, "<u4"), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def learn(self, units: pa.Array) -> None:
        """Spells units after those that are known."""
        parts = [(self.ids, self.begin, self.n, self.odd)]
        at = len(self.ids)
        for i in range(0, len(units), LEARNT):
            fresh = listed(units[i : i + LEARNT])
            run = self.pieces.run(fresh, self.known)
            end = np.flatnonzero(run == 0xFFFFFFFF)
            begin = np.append(-1, end[:-1]) + 1
            odd = np.zeros(len(fresh), bool)
            odd[self.pieces.odd(fresh, run)] = True
            parts.append((run, begin + at, end - begin, odd))
            at += len(run)
        self.ids, self.begin, self.n, self.odd = map(np.concatenate, zip(*parts, strict=True))

    def texts(self, texts: list[str]) -> Iterator[tuple[np.ndarray, bool]]:
        """Of each text the ids, and whether its units are spelled by theirs."""
        if len(self.units) > HELD:
            self.clear()
        strip = [self.pieces.numbered(pa.array(texts[i:j], pa.large_string())) for i, j in strips(np.fromiter(map(len, texts), np.int64, len(texts)))]
        had = len(self.units)
        both = pa.concat_arrays([self.units, *(units for units, _, _ in strip)]).dictionary_encode()
        number, self.units = np.split(both.indices.to_numpy()[had:], np.cumsum([len(units) for units, _, _ in strip])), both.dictionary
        strip = [(own, flat, n) for own, (_, flat, n) in zip(number, strip, strict=False)]
        self.learn(self.units[had:])
        for own, flat, n in strip:
            own = own[flat]
            ids = self.ids[taken(self.begin[own], self.n[own])]
            last = np.cumsum(n)
            ends, odds = (np.append(0, np.cumsum(x[own]))[[last - n, last]] for x in (self.n, self.odd))
            for i, j, same in zip(*ends.tolist(), (odds[0] == odds[1]).tolist(), strict=True):
                yield ids[i:j], same


def atoms_of(units: Iterable[str], had: list[tuple[int, np.ndarray]], pieces: Pieces) -> tuple[pa.Array, pa.Array]:
    """The distinct atoms of units, and of each the blocks that have it: ``had`` lists (block, units). Each unit is cut once, however many blocks have it."""
    atom = numbers()
    gap = atom[GAP]
    rest, parts = iter(units), [np.zeros(0, np.int32)]
    while some := [*islice(rest, LEARNT)]:
        parts.append(np.fromiter(map(atom.__getitem__, pieces.atoms(GAP.join([*some, ""]))), np.int32))
    flat = np.concatenate(parts)
    end = np.flatnonzero(flat == gap)
    begin = np.append(-1, end[:-1])[: len(end)] + 1
    held = []
    for k, own in had:
        got = flat[taken(begin[own], (end - begin)[own])]
        if 8 * len(got) > len(atom):
            has = np.zeros(len(atom), bool)
            has[got] = True
            held.append(np.flatnonzero(has) << 32 | k)
        else:
            held.append(distinct(got.astype(np.int64)) << 32 | k)
    both = distinct(np.concatenate([np.zeros(0, np.int64), *held]))
    words = [w if len(w) <= MOST and w != GAP else None for w in atom]
    lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(both, np.arange(len(atom) + 1) << 32), pa.int32()), pa.array(both & 0xFFFFFFFF, pa.int32()))
    words = pa.array(words, pa.string())
    return words.drop_null(), lists.filter(words.is_valid())


def strips(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Begins and ends of parts of a size of ``STRIP``, or of one text that has more."""
    ends = np.cumsum(sizes)
    i = 0
    while i < len(ends):
        j = max(i + 1, int(np.searchsorted(ends, STRIP + (ends[i - 1] if i else 0), "right")))
        yield i, j
        i = j


def light(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows (word, blocks, ...) in parts of ``HELD`` blocks, or of one word that has more."""
    ends = np.cumsum(batch.column(1).value_lengths().to_numpy())
    i = 0
    while i < len(ends):
        j = max(i + 1, int(np.searchsorted(ends, HELD + (ends[i - 1] if i else 0), "right")))
        yield batch.slice(i, j - i)
        i = j


def held_by(docs: DataFrame, pieces: Pieces) -> DataFrame:
    """(word, blocks) of each task's atoms of documents (block, doc_id, text)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        had: list[tuple[pa.Array, np.ndarray]] = []  # of each strip its distinct units, and the distinct (block, unit)

        def merge():
            units = pa.concat_arrays([x for x, _ in had]).dictionary_encode()
            number, at = units.indices.to_numpy(), np.cumsum([0, *(len(x) for x, _ in had)])
            both = distinct(np.concatenate([k >> 32 << 32 | number[i + (k & 0xFFFFFFFF)] for i, (_, k) in zip(at, had, strict=False)]))
            had[:] = [(units.dictionary, both)]

        def more(units: int, both: int) -> bool:
            return sum(len(x) for x, _ in had) > units * HELD or sum(len(k) for _, k in had) > both * HELD

        def out():
            merge()
            units, both = had.pop()
            first = np.flatnonzero(np.diff(both >> 32, prepend=-1))
            each = chain.from_iterable(listed(units[i : i + LEARNT]) for i in range(0, len(units), LEARNT))
            words, lists = atoms_of(each, [(int(own[0] >> 32), own & 0xFFFFFFFF) for own in np.split(both, first[1:]) if len(own)], pieces)
            for i in range(0, len(words), 1 << 16):
                yield pa.RecordBatch.from_arrays([words[i : i + (1 << 16)], lists[i : i + (1 << 16)]], ["word", "blocks"])

        for b in batches:
            blocks = b.column(0).to_numpy().astype(np.int64)
            for i, j in strips(pc.binary_length(b.column(2)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)):
                units, flat, n = pieces.numbered(b.column(2)[i:j])
                had.append((units, distinct(np.repeat(blocks[i:j] << 32, n) | flat)))
                if more(4, 12):
                    merge()
                    if more(3, 8):
                        yield from out()
        if had:
            yield from out()

    return docs.mapInArrow(lean(run), "word string, blocks array<int>")


def encode(docs: DataFrame, model: str, hot: int = 200_000, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row a document: pieces, checksum of the ids (little-endian uint32), whether decoding gives the text back; ``with_ids`` adds the ids."""
    spark = docs.sparkSession
    own = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    pieces = Pieces(model)
    parts = rows_for(own.count(), 4096, 12)
    own = own.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts)).cast("int").alias("block"), "doc_id", "text")
    stage = Stage(spark, "lattice")
    held = stage.put(held_by(own, pieces), "held")
    words = held.select("word").repartition(4 * parts, "word").distinct()
    before = spark.conf.get(FALLBACK)
    spark.conf.set(FALLBACK, str(GROUPED))
    try:
        paths = stage.put(lattice(words, spark, pieces), "paths")
    finally:
        spark.conf.set(FALLBACK, before)
    often = held.groupBy("word").agg(F.sum(F.size("blocks")).alias("n")).orderBy(F.desc("n"), "word").limit(hot).select("word")
    often = stage.put(paths.join(F.broadcast(often), "word"), "hot")
    known = spark.sparkContext.broadcast({r.word: bytes(r.path) for r in often.collect()})
    rest = held.join(F.broadcast(often.select("word")), "word", "left_anti").join(paths, "word").select("word", "blocks", "path")

    def bundle(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def messages():
            held: defaultdict[int, tuple[list, list]] = defaultdict(lambda: ([], []))
            size, made = 0, TaskContext.get().partitionId() << 24
            for b in chain.from_iterable(map(light, batches)):
                words, ids = b.column(0).to_pylist(), b.column(2).to_pylist()
                blocks = b.column(1).flatten().to_numpy()
                order = np.argsort(blocks, kind="stable")
                row = np.repeat(np.arange(len(words)), b.column(1).value_lengths().to_numpy())[order].tolist()
                keys, first = np.unique(blocks[order], return_index=True)
                for k, i, j in zip(keys.tolist(), first.tolist(), [*first[1:].tolist(), len(row)], strict=True):
                    x = held[k]
                    x[0].extend(map(words.__getitem__, row[i:j]))
                    x[1].extend(map(ids.__getitem__, row[i:j]))
                size += len(row)
                if size > HELD:
                    yield from ((k, 1, made, x) for k, x in held.items())
                    held.clear()
                    size, made = 0, made + 1
            yield from ((k, 1, made, x) for k, x in held.items())

        yield from sent(messages())

    def text_messages(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def messages():
            held: defaultdict[int, tuple[list, list]] = defaultdict(lambda: ([], []))
            size, made = 0, TaskContext.get().partitionId() << 24
            for b in batches:
                for k, i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), texts_of(b.column(2)), strict=True):
                    x = held[k]
                    x[0].append(i)
                    x[1].append(t)
                    size += len(t)
                    if size > 1 << 23:
                        yield from ((k, 2, made, x) for k, x in held.items())
                        held.clear()
                        size, made = 0, made + 1
            yield from ((k, 2, made, x) for k, x in held.items())

        yield from sent(messages())

    def spell(key, held):
        def of(w: str) -> bytes:
            return pieces.packed(pieces.best(w))  # over MOST characters

        words = Known(of)
        words.update(known.value)
        bundles = held.pop(1, [])
        while bundles:
            words.update(zip(*bundles.pop()[1], strict=True))
        spelling = Spelling(pieces, words)
        for ids, texts in steps(held.get(2, [])):
            for i, t, (out, same) in zip(ids, texts, spelling.texts(texts), strict=True):
                if not same:
                    same = pieces.decode(out.tolist()) == t.replace(MARK, " ")
                yield i, len(out), zlib.crc32(out), same, *([out.tolist()] if with_ids else [])

    def steps(messages):
        ids, texts, size = [], [], 0
        messages.reverse()
        while messages:
            some, own = messages.pop()[1]
            ids += some
            texts += own
            size += sum(map(len, own))
            if size > TAKEN:
                yield ids, texts
                ids, texts, size = [], [], 0
        yield ids, texts

    def rows(made):
        some: list[tuple] = []

        def out():
            cols = list(zip(*some, strict=True))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.int32())]
            names = ["doc_id", "n_pieces", "ids_crc32", "round_trip", "ids"]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=False)], names[: len(cols)])

        for r in made:
            some.append(r)
            if len(some) >= 2048:
                yield out()
                some = []
        if some:
            yield out()

    texts = own.mapInArrow(lean(text_messages), MESSAGE)
    bundles = stage.put(rest.mapInArrow(lean(bundle), MESSAGE), "bundles")
    stage.drop(held, paths, often)  # before the texts take their room
    return gathered([bundles, texts], parts, spell, OUT + (", ids array<int>" if with_ids else ""), rows)


def op5_piece_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
