"""Harmonic packing of tokenised documents into fixed-length sequences.

Lengths fall into reciprocal-capacity classes: class k holds pieces of ``capacity // k`` tokens and each
of its bins takes a fixed number of them. A document is cut into the largest class lengths that fit, so
its pieces fill their classes' bins exactly; every partition fills its own bins and nothing is shuffled.
What lies in bins still open at the end of a partition is laid end to end, so each partition leaves at most one
short sequence.

Nulls: a null text is empty (its only id is the end mark); a null id is kept as null. Repeated rows are
separate documents. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .common import table, texts_of

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Words remembered per Python worker; the table is emptied beyond this, which only costs time.
MEMO_WORDS = 600_000
PLAIN = re.compile("([a-zß-öø-ÿ]+)([.,;:!?]*)")
#: Texts whose small letters are the same one by one in any library.
LATIN = re.compile("[\\x00-\xff]*")


class Words(dict):
    """The packed ids of words, asked for once each."""

    def __init__(self, of: Callable[[str], bytes]):
        self.of = of
        self.empty()

    def empty(self) -> None:
        self.clear()
        self[""] = b""

    def __missing__(self, w: str) -> bytes:
        self[w] = ids = self.of(w)
        return ids


class WordEncoder:
    """Token ids of whole texts as little-endian uint32 bytes.

    Blanks and line feeds separate words, and neither the normaliser nor the pre-tokeniser of the file reaches
    across one, so a text's ids are its words' ids in order. The library encodes each new word once; a
    special string inside a word is seen by the library as in the whole text.
    """

    def __init__(self, path: str, memo_words: int = MEMO_WORDS):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.lib, self.memo_words = Tokenizer.from_file(path), memo_words
        self.token, self.memo = self.lib.model.tokenize, Words(self._learn)
        self.packed = [i.to_bytes(4, "little") for i in range(self.lib.get_vocab_size(with_added_tokens=True))]
        # letters as the pre-tokeniser writes their bytes
        bytes_of = ByteLevel(add_prefix_space=False, use_regex=False)
        self.shown = {i: bytes_of.pre_tokenize_str(chr(i))[0][0] for i in range(0xDF, 0x100)}

    def _learn(self, w: str) -> bytes:
        """A run of Latin-1 small letters, and a run of marks after it, are pre-tokens of their own that the normaliser leaves as they are: the model is given them directly. All else goes through the whole library."""
        if w.isascii() and w.isalpha() and w.islower():
            return self._pre_token(w)
        m = PLAIN.fullmatch(w)
        if not m:
            return b"".join(map(self.packed.__getitem__, self.lib.encode(w, add_special_tokens=False).ids))
        word, marks = m.groups()
        return self.memo[word] + self.memo[marks] if marks else self._pre_token(w)

    def _pre_token(self, w: str) -> bytes:
        packed = self.packed
        return b"".join([packed[t.id] for t in self.token(w if w.isascii() else w.translate(self.shown))])

    def encode(self, texts: list[str]) -> list[bytes]:
        memo = self.memo
        if len(memo) > self.memo_words:
            memo.empty()
        known, out = memo.__getitem__, []
        for t in texts:
            if "<|" not in t and LATIN.fullmatch(t):
                t = t.lower()  # the file's normaliser does so; fewer words to remember
            out.append(b"".join(map(known, t.replace("\n", " ").split(" "))))
        return out


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


class HarmonicBins:
    """Bins of one worker. ``add`` and ``close`` yield (document, start, length, bytes, doc_tokens, sequence, offset)."""

    def __init__(self, capacity: int, first_sequence: int = 0):
        self.capacity, self.sequence = capacity, first_sequence
        self.open: dict[int, list[tuple]] = {}

    def piece_length(self, left: int) -> int:
        """The largest capacity // k that is at most left."""
        return self.capacity if left >= self.capacity else self.capacity // (self.capacity // (left + 1) + 1)

    def add(self, doc, ids: bytes) -> Iterator[tuple]:
        total = len(ids) // 4
        start = 0
        while start < total:
            n = self.piece_length(total - start)
            bin_ = self.open.setdefault(n, [])
            bin_.append((doc, start, n, ids[4 * start : 4 * (start + n)], total))
            start += n
            if len(bin_) == self.capacity // n:
                yield from self._emit(self.open.pop(n))

    def close(self) -> Iterator[tuple]:
        """Lays what is left end to end, cut where a sequence is full."""
        room: list[tuple] = []
        used = 0
        for n in sorted(self.open, reverse=True):
            for doc, start, length, ids, total in self.open[n]:
                at = 0
                while at < length:
                    take = min(length - at, self.capacity - used)
                    room.append((doc, start + at, take, ids[4 * at : 4 * (at + take)], total))
                    at, used = at + take, used + take
                    if used == self.capacity:
                        yield from self._emit(room)
                        room, used = [], 0
        self.open = {}
        if room:
            yield from self._emit(room)

    def _emit(self, pieces: list[tuple]) -> Iterator[tuple]:
        offset = 0
        for doc, start, length, ids, total in pieces:
            yield doc, start, length, ids, total, self.sequence, offset
            offset += length
        self.sequence += 1


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: document, start, length, checksum, document's tokens, sequence, offset.

    ``with_ids`` adds ``ids`` (array of int), the training payload. Sequence numbers are the partition's number times
    2**33 plus a count, so workers need no agreement and a retried task gives the same numbers.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        bins = HarmonicBins(capacity, TaskContext.get().partitionId() << 33)
        end = np.asarray([end_id], dtype="<u4").tobytes()
        rows: list[tuple] = []

        def batch() -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
            out = [pa.array(cols[i], pa.int64()) for i in (0, 1, 2)] + [pa.array([zlib.crc32(x) for x in cols[3]], pa.int64())] + [pa.array(cols[i], pa.int64()) for i in (4, 5, 6)]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if with_ids:
                out.append(pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in cols[3]], pa.list_(pa.int32())))
                names.append("ids")
            rows.clear()
            return pa.RecordBatch.from_arrays(out, names)

        for b in batches:
            for a in range(0, b.num_rows, 256):
                part = b.slice(a, 256)
                for doc, ids in zip(part.column(0).to_pylist(), enc.encode(texts_of(part.column(1))), strict=True):
                    rows.extend(bins.add(doc, ids + end))
                if len(rows) > 2000:
                    yield batch()
        rows.extend(bins.close())
        yield batch()

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, SCHEMA + (", ids array<int>" if with_ids else ""))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
