"""Token counts of whole texts with overlap resynchronisation.

A text longer than ``chunk_chars`` is encoded as overlapping chunks of about as many bytes, each by the library with its offsets. Stable boundaries are
places before a blank (or its mark U+2581) that follows another character. No piece of the vocabulary holds a blank after
another character (checked when the model is loaded), and every merge makes a piece, so no encoding of any
text crosses such a place. Two neighbours are spliced at a boundary inside their overlap at which both encodings have a piece begin; where there is none, the overlap
is widened, in the limit to all that isn't spliced yet. Shorter texts are sums over what lies between boundaries, as encoded by the library once a worker.

Nulls: a null text is empty and has 0 tokens; a null id is kept. Repeated rows each get a row, an empty table
gives none, other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table, texts_of

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
MEMO_SEGMENTS = 600_000
MARK = "▁"
SEGMENT, BOUNDARY = re.compile(r" *[^ ]+| +\Z"), re.compile(b"[^ ] ")


class ChunkEncoder:
    def __init__(self, path: str, chunk_chars: int = 65_536, overlap_chars: int = 1024, memo: int = MEMO_SEGMENTS):
        import sentencepiece

        self.lib = sentencepiece.SentencePieceProcessor(model_file=path)
        self.chunk, self.overlap, self.limit = chunk_chars, overlap_chars, memo
        self.memo: dict[str, int] = {}
        self.stable = self._proven()

    def _proven(self) -> bool:
        """Whether no piece reaches over a boundary before a blank, and the library puts one blank before a text and drops none."""
        pieces = [self.lib.id_to_piece(i) for i in range(self.lib.vocab_size())]
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces):
            return False
        shown = lambda x: "".join(self.lib.encode(x, out_type=str))
        return shown("a") == f"{MARK}a" and shown(" a  b ") == f"{MARK * 2}a{MARK * 2}b{MARK}"

    def segments(self, text: str) -> list[str]:
        """What lies between stable boundaries, each as the library is to be given it: it puts a blank before, so one is taken off all but the first."""
        if "  " not in text and not text.startswith(" ") and not text.endswith(" "):
            return text.split(" ")
        return [x[1:] if i else x for i, x in enumerate(SEGMENT.findall(text))]

    def learn(self, segments: Iterable[str]) -> None:
        new = list({s for s in segments if s not in self.memo})
        for a in range(0, len(new), 8192):
            part = new[a : a + 8192]
            self.memo.update(zip(part, map(len, self.lib.encode(part, num_threads=1)), strict=True))
        if "" in new:
            self.memo[""] = 1  # a single blank at the end: the mark alone

    def counts(self, segments: list[str]) -> list[int]:
        self.learn(segments)
        return [self.memo[s] for s in segments]

    def count(self, text: str) -> int:
        return self.count_all([text])[0]

    def count_all(self, texts: list[str]) -> list[int]:
        if len(self.memo) > self.limit:
            self.memo.clear()
        out, known, late = [0] * len(texts), self.memo.__getitem__, []
        for i, text in enumerate(texts):
            if not self.stable:
                out[i] = len(self.lib.encode(text))
                continue
            text = text.replace(MARK, " ")
            if len(text) > self.chunk:
                out[i] = self.spliced(text)
            elif text:
                segments = self.segments(text)
                try:
                    out[i] = sum(map(known, segments))
                except KeyError:
                    late.append((i, segments))
        if late:
            self.learn(s for _, segments in late for s in segments)
            for i, segments in late:
                out[i] = sum(map(known, segments))
        return out

    def encoded(self, data: bytes, a: int, b: int) -> np.ndarray:
        """Where the pieces of the chunk from byte a to b begin, by the library's own offsets, in order.

        A chunk may begin inside a word; its pieces up to the first boundary belong to the chunk before it and are left out. The library puts a blank before
        what it is given, which touches pieces before the first boundary only.
        """
        begins = a + np.array([p.begin for p in self.lib.encode(data[a:b].decode(), return_type="proto").pieces], np.int64)
        if not a:
            return begins
        m = BOUNDARY.search(data, a, b)
        return begins[begins > m.start()] if m else begins[:0]

    def spliced(self, text: str) -> int:
        """Chunks are spliced at the last boundary in their overlap at which both have a piece begin."""
        data = text.encode()

        def whole(i: int) -> int:
            """The start of the character that byte i belongs to."""
            while i < len(data) and data[i] & 0xC0 == 0x80:
                i -= 1
            return i

        total, at = 0, 0  # tokens before the boundary up to which the text is spliced
        b, overlap = whole(min(len(data), self.chunk)), self.overlap
        left = self.encoded(data, 0, b)
        while b < len(data):
            a, end = whole(max(at, b - overlap)), whole(min(len(data), b + self.chunk))
            right = self.encoded(data, whole(a - 1) if a == at and a else a, end)
            inside = [m.start() + 1 for m in BOUNDARY.finditer(data, a, b) if m.start() + 1 > at]
            common = next((p for p in inside[::-1] if starts(left, p) and starts(right, p)), None)
            if common is not None:
                total += int(np.searchsorted(left, common))
                left, b, at, overlap = right[np.searchsorted(right, common) :], end, common, self.overlap
            elif a > at:
                overlap *= 2
            else:  # the overlap is all that isn't spliced yet, and the right chunk has it from the same boundary on
                left, b, overlap = right[np.searchsorted(right, at) :], end, self.overlap
        return total + len(left)


def starts(begins: np.ndarray, at: int) -> bool:
    i = np.searchsorted(begins, at)
    return i < len(begins) and begins[i] == at


_ENCODERS: dict[tuple, ChunkEncoder] = {}


def count_tokens(docs: DataFrame, model: str, limit: int = 4096, chunk_chars: int = 65_536, overlap_chars: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (model, chunk_chars, overlap_chars)
        if key not in _ENCODERS:
            _ENCODERS[key] = ChunkEncoder(*key)
        enc = _ENCODERS[key]
        for b in batches:
            texts = texts_of(b.column(1))
            n = [x for a in range(0, len(texts), 512) for x in enc.count_all(texts[a : a + 512])]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, SCHEMA)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
