"""Repeated passages by a distributed difference-cover suffix array.

A byte of a document goes if a string of ``length`` bytes that covers it also starts in a document with a smaller id.

Prelude, exact. Texts are packed into blocks; a document over ``PIECE_BYTES`` is cut into pieces that overlap by ``length - 1`` bytes, so each string starts
in one piece. Of every window of ``length`` bytes the least hash of its ``GRAM``-byte strings is a fingerprint; a window none of whose fingerprints occurs in
another document has no copy. What is left is cut at places chosen by content, so that copies give equal chunks, and equal chunks become one string with
the smallest id of its holders. Windows whose hash no other such string has keep the answer of their own string. All others are sorted:

1. They lie in runs; a run, with zeros behind it, is a text. A symbol is ``width`` bytes, a place's symbol number is counted from its run's start. Places with a
   symbol number of 1 or 2 modulo 3 are the sample. Their triples of symbols are sorted in ranges across workers, and their order gives them names.
2. The names are the symbols of the next level, a place's follower there lies three symbols on; the same is done with them, until a triple of names covers the
   whole length. For 50 bytes symbols of 6 bytes need one such recursion, longer strings need more.
3. On the way back the rest of each level, by (symbol, rank of the follower), is merged with its sample, and the merged order ranks the level. At the lowest level only
   windows are merged; prefixes of neighbours in the order are compared (by 64-bit fingerprints, so a wrong tie has odds of 1 to 2**64 a pair of neighbours), and a run of
   equal ones gets the smallest id of its holders. Every string's answer goes back to the chunks, blocks and documents it came from.

What crosses the network for a sort are the distinct tuples of a task, and ranks go back as differences. Which of them a place has goes along as a message of a bucket to
itself, so nothing is sorted twice: later steps look the answers up. Strings equal within a
block are sent once, so one that all documents share costs a message a block. Splitters come from a bounded sample of the runs and only balance the work. Each step is
written to the shared folder, and the tables it has used up are dropped.

Nulls: a null text is empty. A row with a null id neither removes nor loses anything. Rows that repeat an id don't remove from each other. Repeated rows each
get a row; an empty table gives none; other columns are ignored. Very long texts take the memory of their pieces, and in the end of their digest's (``with_text``: the text's).
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stage, lean, table, utf8_views
from .messages import MESSAGE, each, gathered, sent, unpacked
from .minhash import _POWERS, mix

GRAM = 24
BLOCK_BYTES, PIECE_BYTES = 1 << 21, 1 << 21
#: Bytes of packed blocks that a bucket stands for: a task costs some 0.1 s besides its work.
BUCKET_BYTES = 6 << 20
#: Windows of a chunk: about, and at most.
CHUNK, CHUNK_MOST = 48, 2048
SPLITTERS = 1 << 16
STRIP = 1 << 15
NONE = np.uint32(2**32 - 1)
#: Kinds of a sort's messages, plus the level: names and ranks as they come from the ranges, and which triple or item a place has.
NAMES, RANKS, TRIPLE_OF, ITEM_OF = 100, 200, 300, 400
OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
FACTORS = mix(np.arange(1, 6, dtype=np.uint64)) | np.uint64(1)
OF_BYTE = [mix(np.arange(256, dtype=np.uint64) + np.uint64(s)) for s in (1, 257)]


def strips(n: int) -> Iterator[tuple[int, int]]:
    """Ranges of places small enough for what is made of them to stay in a core's cache."""
    return ((a, min(n, a + STRIP)) for a in range(0, n, STRIP))


def rolling(b: np.ndarray, length: int, salt: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """64-bit sums of the windows of ``length`` bytes, strip by strip: (from, to, sums). The powers of one strip do for all."""
    up, down = _POWERS.upto(STRIP + length)
    for i, j in strips(len(b) - length + 1):
        total = np.zeros(j - i + length, np.uint64)
        np.cumsum(OF_BYTE[salt][b[i : j + length - 1]] * up[: len(total) - 1], out=total[1:])
        yield i, j, (total[length:] - total[:-length]) * down[: j - i]


def sliding(x: np.ndarray, width: int, best) -> np.ndarray:
    s = 1
    while s < width:
        step = min(s, width - s)
        x = best(x[: len(x) - step], x[step:])
        s += step
    return x


def before_ends(ends: np.ndarray, n: int) -> np.ndarray:
    """The last n places before each end."""
    at = (ends[:, None] - np.arange(1, n + 1)).ravel()
    return at[at >= 0]


def steps(v: np.ndarray) -> np.ndarray:
    """The differences of a sorted array, in as few bytes as hold them."""
    d = np.diff(v, prepend=v.dtype.type(0)).astype(np.uint64)
    return d.astype(np.uint32) if not len(d) or d.max() < 2**32 else d


def summed(d: np.ndarray) -> np.ndarray:
    return np.cumsum(d, dtype=np.uint64)


def planes(x: np.ndarray) -> np.ndarray:
    """Numbers byte by byte, low bytes first, without the high bytes that all lack: so they pack well."""
    n = (int(x.max(initial=0)).bit_length() + 7) // 8
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :n].T)


def joined(x: np.ndarray) -> np.ndarray:
    out = np.zeros((x.shape[1], 8), np.uint8)
    out[:, : len(x)] = x.T
    return out.view("<u8").ravel()


def groups_of(sorted_: np.ndarray) -> np.ndarray:
    """Where the runs of equal values begin."""
    return np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]])) if len(sorted_) else np.zeros(0, np.int64)


def several(values: np.ndarray, holder: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct 48-bit values in order, and which of them have more than one holder."""
    if not len(values):
        return values, np.zeros(0, bool)
    if 0 <= holder.min() and holder.max() < 1 << 16:
        both = values << np.uint64(16)
        both |= holder.astype(np.uint16)
        both.sort()
        one = both >> np.uint64(16)
        begin = groups_of(one)
        return one[begin], both[begin] != both[np.append(begin[1:], len(both)) - 1]
    order = np.argsort(values)
    values, holder = values[order], holder[order]
    begin = groups_of(values)
    return values[begin], np.minimum.reduceat(holder, begin) < np.maximum.reduceat(holder, begin)


class Text:
    """The pieces of a block: their bytes in a row, off their ends behind a 0; row and seq say where a piece belongs if its document has more."""

    def __init__(self, body):
        self.ids, self.known, self.row, self.seq, self.core, self.off, data = body
        self.buf = np.frombuffer(data, np.uint8)
        self.doc = np.repeat(np.arange(len(self.ids), dtype=np.int32), np.diff(self.off))

    def anchors(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and 48-bit fingerprints of the least hash of every window."""
        n, w = len(self.buf), length - GRAM + 1
        if n < length:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        # the eight bytes from each place on
        self.word = np.ndarray((n,), "<u8", np.concatenate([self.buf, np.zeros(8, np.uint8)]), strides=(1,))
        self.hash = np.empty(n - 23, np.uint32)
        for a, b in strips(n - 23):
            word = self.word[a : b + 16].copy()
            self.hash[a:b] = self.grams(word[:-16], word[8:-8], word[16:]) >> np.uint64(32)
        np.minimum(self.hash, NONE - np.uint32(1), out=self.hash)
        cut = before_ends(self.off[1:-1], GRAM - 1)
        self.hash[cut[cut < len(self.hash)]] = NONE
        self.least, places = np.empty(n - length + 1, np.uint32), []
        for a, b in strips(len(self.least)):
            self.least[a:b] = sliding(self.hash[a : b + w - 1], w, np.minimum)
        for a, b in strips(len(self.hash)):
            near = self.least[max(0, a - w + 1) : b]
            near = np.concatenate([np.zeros(max(0, w - 1 - a), np.uint32), near, np.zeros(max(0, b - len(self.least)), np.uint32)])
            hash_ = self.hash[a:b]
            places.append(a + np.flatnonzero((hash_ == sliding(near, w, np.maximum)) & (hash_ != NONE)))
        place = np.concatenate(places)
        return place, mix(self.grams(self.word[place], self.word[place + 8], self.word[place + 16])) >> np.uint64(16)

    @staticmethod
    def grams(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
        h = a * FACTORS[0]
        h += b * FACTORS[1]
        h += c * FACTORS[2]
        return h

    def candidates(self, length: int, again: np.ndarray) -> np.ndarray:
        """The starts of windows whose own least fingerprint is at one of the places ``again``: only they can have a copy."""
        own, w = np.full(len(self.hash), NONE), length - GRAM + 1
        own[again] = self.hash[again]
        out = np.zeros(len(self.buf), bool)
        for a, b in strips(len(self.least)):
            some = sliding(own[a : b + w - 1], w, np.minimum)
            out[a:b] = (some == self.least[a:b]) & (some != NONE)
        out[before_ends(self.off[1:], length - 1)] = False
        if not self.known.all():
            out &= self.known[self.doc]
        return out


def blocks(docs: DataFrame, length: int, block_bytes: int, piece_bytes: int) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()

        def pieces():
            row = part << 32
            for b in batches:
                raw, off = utf8_views(b.column(1))
                for i, x in enumerate(b.column(0).to_pylist()):
                    a, end, row, seq = off[i], off[i + 1], row + 1, 0
                    while end - a > piece_bytes:
                        yield x or 0, x is not None, row, seq, piece_bytes, raw[a : min(end, a + piece_bytes + length - 1)].tobytes()
                        a, seq = a + piece_bytes, seq + 1
                    yield x or 0, x is not None, row, seq if seq else -1, end - a, raw[a:end].tobytes()

        def packs():
            made, held, size = 0, [], 0
            for p in pieces():
                held.append(p)
                size += len(p[-1])
                if size >= block_bytes or len(held) >= 50_000:
                    yield part << 32 | made, 0, 0, body(held)
                    made, held, size = made + 1, [], 0
            if held:
                yield part << 32 | made, 0, 0, body(held)

        def body(held):
            ids, known, row, seq, core, parts = zip(*held, strict=True)
            return np.array(ids, np.int64), np.array(known, bool), np.array(row, np.int64), np.array(seq), np.array(core), np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int64), b"".join(parts)

        yield from sent(packs())

    return docs.mapInArrow(lean(run), MESSAGE)


def ranges(sorted_: np.ndarray) -> list[tuple[int, int, int]]:
    """Runs of equal numbers in a sorted array: (number, from, to)."""
    edges = [*groups_of(sorted_).tolist(), len(sorted_)]
    return [(int(sorted_[a]), a, b) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def by_value(values: np.ndarray, buckets: int) -> list[tuple[int, int, int]]:
    """Ranges of sorted 48-bit values by bucket."""
    return ranges(((values * np.uint64(buckets)) >> np.uint64(48)).astype(np.int64))


def fingerprints(length: int, buckets: int):
    def step(block, _, body):
        t = Text(body)
        place, fp = t.anchors(length)
        one, many = several(fp, np.unique(t.ids, return_inverse=True)[1][t.doc[place]])
        for k, a, b in by_value(one, buckets):
            yield k, 0, block, (steps(one[a:b]), np.packbits(many[a:b]))

    return step


def repeated(key, held):
    """For each sender a bit a value: whether another has it too, or the sender itself from two holders."""
    got = [(s, summed(d), np.unpackbits(m, count=len(d)).astype(bool)) for s, (d, m) in held[0]]
    every = np.sort(np.concatenate([v for _, v, _ in got]))
    both = np.unique(np.concatenate([every[1:][every[1:] == every[:-1]], *[v[m] for _, v, m in got]]))
    for s, v, _ in got:
        yield s, 1, key, np.packbits(both[np.minimum(np.searchsorted(both, v), len(both) - 1)] == v if len(both) else np.zeros(len(v), bool))


def told(held, values: np.ndarray, buckets: int) -> np.ndarray:
    """For each of the values what ``repeated`` says of it."""
    order = np.argsort(values)
    ordered = values[order]
    begin, bits = groups_of(ordered), dict(held.get(1, []))
    said = np.concatenate([np.zeros(0, bool), *[np.unpackbits(bits[k], count=b - a).astype(bool) for k, a, b in by_value(ordered[begin], buckets)]])
    out = np.empty(len(values), bool)
    out[order] = np.repeat(said, np.diff(np.append(begin, len(values))))
    return out


def chunks(length: int, buckets: int):
    def step(block, held):
        if 0 not in held:
            return
        t = Text(held[0][0][1])
        place, fp = t.anchors(length)
        again = place[told(held, fp, buckets)]
        if not len(again):
            return
        n, begins = len(t.buf), t.off[:-1]
        window = t.candidates(length, again)
        at = np.flatnonzero(window)
        cut = np.zeros(n, bool)
        cut[at[(t.word[at] * FACTORS[3] + t.word[at + 8] * FACTORS[4]) >> np.uint64(32) < np.uint64(2**32 // CHUNK)]] = True
        cut[begins[begins < n]] = True
        head = window & (cut | ~np.concatenate([[False], window[:-1]]))
        start = np.flatnonzero(head)
        if not len(start):
            return
        last = window & (np.concatenate([head[1:], [True]]) | ~np.concatenate([window[1:], [False]]))
        count = np.flatnonzero(last) + 1 - start
        if count.max() > CHUNK_MOST:
            times = -(-count // CHUNK_MOST)
            k = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            start, count = np.repeat(start, times) + k * CHUNK_MOST, np.minimum(CHUNK_MOST, np.repeat(count, times) - k * CHUNK_MOST)
        stop = start + count + length - 1
        data, ids = t.buf.tobytes(), t.ids[t.doc[start]]
        h1, h2 = np.frombuffer(b"".join([blake2b(data[x:y], digest_size=16).digest() for x, y in zip(start.tolist(), stop.tolist(), strict=True)]), "<u8").reshape(-1, 2).T.copy()
        to = (h1 % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((ids, h2, h1, to))
        new = np.concatenate([[True], (h1[order][1:] != h1[order][:-1]) | (h2[order][1:] != h2[order][:-1])])
        first = order[new]
        number = np.empty(len(start), np.int64)
        number[order] = np.cumsum(new) - 1
        yield block, 2, 0, (start, count, number, count[first])
        for k, a, b in ranges(to[first]):
            f = first[a:b]
            yield k, 3, block, (h1[f], h2[f], ids[f], count[f], b"".join([data[x:y] for x, y in zip(start[f].tolist(), stop[f].tolist(), strict=True)]))

    return step


def distinct_strings(length: int):
    def step(key, held):
        """One of equal chunks, with the smallest id of its holders, and for each block which ones it asked for."""
        got = held[3]
        h1, h2, ids, count = (np.concatenate([x[i] for _, x in got]) for i in range(4))
        text = b"".join([x[4] for _, x in got])
        begin = np.concatenate([[0], np.cumsum(count + length - 1)])
        order = np.lexsort((ids, h2, h1))
        new = np.concatenate([[True], (h1[order][1:] != h1[order][:-1]) | (h2[order][1:] != h2[order][:-1])])
        first = order[new]
        number = np.empty(len(h1), np.int64)
        number[order] = np.cumsum(new) - 1
        asked, a = {}, 0
        for s, x in got:
            asked[s] = number[a : a + len(x[0])]
            a += len(x[0])
        yield key, 0, 0, (ids[first], count[first], b"".join([text[x:y] for x, y in zip(begin[first].tolist(), begin[first + 1].tolist(), strict=True)]), asked)

    return step


def window_hashes(body, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Of strings in a row: the 48-bit hash of each window, and its string."""
    _, count, data, _ = body
    of = np.repeat(np.arange(len(count), dtype=np.int32), count)
    at, out = np.arange(len(of)) + of * (length - 1), np.empty(len(of), np.uint64)
    for i, j, x in rolling(np.frombuffer(data, np.uint8), length, 0):
        a, b = np.searchsorted(at, [i, j])
        out[a:b] = mix(x[at[a:b] - i]) >> np.uint64(16)
    return out, of


def hashes_out(length: int, buckets: int):
    def step(key, _, body):
        one, many = several(*window_hashes(body, length))
        for k, a, b in by_value(one, buckets):
            yield k, 0, key, (steps(one[a:b]), np.packbits(many[a:b]))

    return step


def runs_out(length: int, buckets: int):
    def step(key, held):
        """What answers need of the strings, and the runs of windows that have to be sorted."""
        if 0 not in held:
            return
        body = held[0][0][1]
        ids, count, data, asked = body
        h, of = window_hashes(body, length)
        open_ = told(held, h, buckets)
        yield key, 4, 0, (ids, count, asked, np.packbits(open_))
        at, of = np.flatnonzero(open_) + of[open_] * (length - 1), of[open_]
        if not len(at):
            return
        new = np.concatenate([[True], (at[1:] != at[:-1] + 1) | (of[1:] != of[:-1])])
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(at)))
        yield key, 5, 0, (ids[of[first]], size, b"".join(data[a : a + n + length - 1] for a, n in zip(at[first].tolist(), size.tolist(), strict=True)))

    return step


class Runs:
    """The runs of a bucket, each with zeros behind it. Places are numbers of ``buf``; level l has those that were sampled on all levels below."""

    def __init__(self, body, length: int):
        self.ids, self.count, data = body
        self.length, self.width = length, min(8, -(-length // 9))
        self.top = 0
        while self.width * 3 ** (self.top + 1) < length:
            self.top += 1
        size = self.count + length - 1
        pad = 2 * self.step(self.top) + 3 * self.width
        of = np.repeat(np.arange(len(size), dtype=np.int32), size)
        self.places = np.arange(len(of)) + np.repeat(np.arange(len(size)) * pad, size)
        self.within = np.arange(len(of), dtype=np.int32) - np.repeat((np.cumsum(size) - size).astype(np.int32), size)
        self.buf = np.zeros(len(of) + (len(size) + 1) * pad, np.uint8)
        self.buf[self.places] = np.frombuffer(data, np.uint8)
        self.room, self.of = self.count.astype(np.int32)[of] - self.within, of  # windows from this place on, none or fewer behind the last

    def step(self, level: int) -> int:
        """How far the follower of a place is."""
        return self.width * 3**level

    def number(self, level: int) -> np.ndarray:
        """Symbol numbers modulo 3."""
        return self.within // np.int32(self.step(level)) % np.int32(3)

    def level(self, level: int) -> np.ndarray:
        """Which of ``places`` belong to a level."""
        out = np.ones(len(self.places), bool)
        for k in range(level):
            out &= self.number(k) > 0
        return out

    def cells(self, at: np.ndarray, values: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.buf) - self.width, np.uint64)
        out[at] = values
        return out

    def symbols(self, level: int, held) -> np.ndarray:
        """By cell: ``width`` bytes, above them the names of the triples of the level below."""
        if not level:
            words = np.ndarray((len(self.buf) - self.width,), ">u8", np.concatenate([self.buf, np.zeros(8, np.uint8)]), strides=(1,)).astype(np.uint64)
            return words >> np.uint64(64 - 8 * self.width)
        got = np.concatenate([np.zeros(0, np.uint64), *[summed(x) for _, x in held.get(NAMES + level - 1, [])]])
        return self.cells(self.places[self.level(level)], got[joined(held[TRIPLE_OF + level - 1][0][1]).view(np.int64)])

    def triples(self, level: int, x: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """Of the sampled places of a level, whose symbols are x: their distinct triples of symbols in order; which each place has; a place of each."""
        at, s = self.places[self.level(level + 1)], self.step(level)
        return distinct([x[at], x[at + s], x[at + 2 * s]], at)

    def text(self, at: np.ndarray, n: int) -> np.ndarray:
        return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(self.buf, n)[at]).view(f"S{n}").ravel()

    def prints(self, at: np.ndarray) -> np.ndarray:
        """64-bit fingerprints of the windows that begin at the places, independent of the hashes that chose them."""
        out, order = np.empty(len(at), np.uint64), np.argsort(at)
        ordered = at[order]
        for i, j, x in rolling(self.buf, self.length, 1):
            a, b = np.searchsorted(ordered, [i, j])
            out[order[a:b]] = mix(x[ordered[a:b] - i] + np.uint64(self.length))
        return out

    def cut(self, at: np.ndarray, split: list[bytes], n: int) -> list[tuple[int, int, int]]:
        """Places in the order of their first n bytes, by range: (range, from, to)."""
        text = lambda i: self.buf[at[i] : at[i] + n].tobytes()
        edges, a = [0], 0
        for x in split:
            a = bisect_left(range(len(at)), x[:n], lo=a, key=text)
            edges.append(a)
        return [(k, a, b) for k, (a, b) in enumerate(zip(edges, [*edges[1:], len(at)], strict=True)) if b > a]

    def items(self, level: int, x: np.ndarray, rank: np.ndarray, only: np.ndarray) -> Iterator[tuple[int, tuple, np.ndarray, np.ndarray, np.ndarray]]:
        """What a merge of a level needs of the places ``only``, by class: its number, the distinct keys in order, which each place has, a place of each, which of ``only`` the class has.

        The sample is in the order of its ranks; for class 1 come (symbol, rank one on), for class 2 (two symbols, rank two on), for the rest both.
        """
        s, places, number = self.step(level), self.places[only], self.number(level)[only]
        for c in range(3):
            mine = number == c
            at = places[mine]
            keys, back, place = distinct([x[at], rank[at + s]] if c == 0 else [rank[at]], at)
            one, two = (x[place], rank[place + s]), (x[place], x[place + s], rank[place + 2 * s])
            yield c, {0: (*one, *two[1:]), 1: (*keys, *one), 2: (*keys, *two)}[c], back, place, mine


def words(keys: list[np.ndarray]) -> list[np.ndarray]:
    """The keys one behind the other, without the high bits that all lack, in as few 64-bit numbers: their order is that of the keys."""
    out, free = [], 0
    for k in keys:
        n = int(k.max(initial=0)).bit_length()
        if free:
            m = min(n, free)
            out[-1] |= (k >> np.uint64(n - m)) << np.uint64(free - m)
            n, free = n - m, free - m
        if n:
            out.append(k << np.uint64(64 - n))
            free = 64 - n
    return out or [np.zeros(len(keys[0]), np.uint64)]


def order_of(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """An order of the rows, and which of them in that order differ from those before. Only rows that tie so far are sorted on."""
    first, *more = words(keys)
    order = np.argsort(first)
    new = np.ones(len(order), bool)
    first = first[order]
    new[1:] = first[1:] != first[:-1]
    for k in more:
        tied = ~new
        tied[:-1] |= tied[1:]
        at = np.flatnonzero(tied)
        if not len(at):
            break
        some = order[at]
        k = k[some]
        by = np.argsort(k)
        k = k[by]
        rank = np.zeros(len(at), np.uint64)
        rank[by[1:]] = np.cumsum(k[1:] != k[:-1])
        both = np.cumsum(new[at]).astype(np.uint64) << np.uint64(32) | rank
        by = np.argsort(both)
        both, order[at] = both[by], some[by]
        new[at[1:]] = both[1:] != both[:-1]
    return order, new


def distinct(keys: list[np.ndarray], at: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    order, new = order_of(keys)
    back = np.empty(len(order), np.int64)
    back[order] = np.cumsum(new) - 1
    first = order[new]
    return [k[first] for k in keys], back, at[first]


def numbered(new: np.ndarray, key: int) -> np.ndarray:
    """Names in the order of one range: its number, then the rank in it; 0 is the name of zeros."""
    return (np.uint64(key) << np.uint64(40)) + np.cumsum(new).astype(np.uint64)


def named(level: int):
    def step(key, held):
        """Names of the triples of one range."""
        for _, x in held.get(TRIPLE_OF + level, []):
            yield key, TRIPLE_OF + level, 0, x
        if 0 not in held:
            return
        got = [(s, [joined(x) for x in body]) for s, body in held[0]]
        keys = [np.concatenate([x[i] for _, x in got]) for i in range(3)]
        one, back, _ = distinct(keys, np.zeros(len(keys[0]), np.int64))
        zero = (one[0] | one[1] | one[2]) == 0
        names = np.where(zero, np.uint64(0), numbered(np.ones(len(zero), bool), key))[back]
        a = 0
        for s, x in got:
            yield s, NAMES + level, key, steps(names[a : a + len(x[0])])
            a += len(x[0])

    return step


def triples_out(length: int, level: int, split):
    def step(key, held):
        t = Runs(held[5][0][1], length)
        keys, back, place = t.triples(level, t.symbols(level, held))
        yield key, TRIPLE_OF + level, 0, planes(back)
        for k, a, b in t.cut(place, split.value, 3 * t.step(level)):
            yield k, 0, key, [planes(x[a:b]) for x in keys]

    return step


def less(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """For each of b how many of a have a smaller key."""
    keys = [np.concatenate(x) for x in zip(a, b, strict=True)]
    mine = np.repeat(np.array([1, 0], np.uint64), [len(a[0]), len(b[0])])  # of equal ones b's first
    order, _ = order_of([*keys, mine])
    before = np.empty(len(order), np.int64)
    before[order] = np.cumsum(mine[order].astype(np.int64))
    return before[len(a[0]) :]


def merged(parts: list[list[np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The merged order of the rest (class 0) and of both classes of the sample, whose items are numbered on, and which of them in that order differ from those before."""
    rest, one, two = parts
    n = [len(x[0]) for x in parts]
    sample = n[0] + np.argsort(np.concatenate([one[0], two[0]]))
    order, _ = order_of(rest[:2])
    before = (less(one[1:], rest[:2]) + less(two[1:], [rest[0], *rest[2:]]))[order]
    if (before[1:] < before[:-1]).any():  # ties that differ behind their prefixes
        again = np.argsort(before, kind="stable")
        order, before = order[again], before[again]
    array, of_sample = np.empty(sum(n), np.int64), np.ones(sum(n), bool)
    at = before + np.arange(n[0])
    of_sample[at] = False
    array[at], array[of_sample] = order, sample
    kind = (array >= n[0]).astype(np.int8)
    first, second = np.concatenate([rest[0], one[0], two[0]])[array], np.concatenate([rest[1], np.zeros(n[1] + n[2], np.uint64)])[array]
    new = np.ones(len(array), bool)
    new[1:] = (kind[1:] != kind[:-1]) | (first[1:] != first[:-1]) | (second[1:] != second[:-1])
    return array, new


def taken(held) -> tuple[list, list[list[np.ndarray]]]:
    """Of a range's messages, which list items of the three classes: (sender, class, number of items), and the columns of the items by class."""
    got = sorted(((c, s, [joined(v) for v in x]) for s, body in held[0] for c, x in body), key=lambda x: x[:2])
    columns = max(len(x) + (c == 1) for c, _, x in got)
    parts = [[np.concatenate([np.zeros(0, np.uint64), *[x[i] for k, _, x in got if k == c]]) for i in range(columns - (c == 1))] for c in range(3)]
    return [(s, c, len(x[0])) for c, s, x in got], parts


def items_out(length: int, level: int, split):
    """The items of a merge, by range; on the lowest level with the fingerprints of their prefixes and the smallest id that has each."""

    def step(key, held):
        t = Runs(held[5][0][1], length)
        only = wanted(t, level)
        owner = t.ids[t.of[only]] if level == 0 else None
        of, n, out = np.empty(int(only.sum()), np.int64), 0, {}
        for c, keys, back, place, mine in t.items(level, t.symbols(level, held), ranks(t, held, level), only):
            of[mine] = n + back
            n += len(place)
            more = ()
            if level == 0:
                least = np.full(len(place), np.iinfo(np.int64).max)
                np.minimum.at(least, back, owner[mine])
                more = (t.prints(place), least.view(np.uint64))
            for k, a, b in t.cut(place, split.value, length):
                out.setdefault(k, []).append((c, [planes(x[a:b]) for x in (*keys, *more)]))
        yield key, ITEM_OF + level, 0, planes(of)
        for k, x in out.items():
            yield k, 0, key, x

    return step


def wanted(t: Runs, level: int) -> np.ndarray:
    """The places whose ranks the level below asks for; on the lowest level the windows."""
    return t.level(level) & (t.room > -2 * sum(t.step(k) for k in range(level)))


def of_items(held, level: int, kind: int, plain) -> np.ndarray:
    """What the ranges said of the items of a merge, for each place that was wanted."""
    got = [[x for _, body in held.get(kind, []) for k, x in body if k == c] for c in range(3)]
    return np.concatenate([plain(x) for some in got for x in some])[joined(held[ITEM_OF + level][0][1]).view(np.int64)]


def ranks(t: Runs, held, level: int) -> np.ndarray:
    """Ranks of the places of the level above, by cell: what its merge has sent, or above the last level the names of the last triples."""
    if level == t.top:
        return t.symbols(level + 1, held)
    return t.cells(t.places[wanted(t, level + 1)], of_items(held, level + 1, RANKS + level + 1, summed))


def ranked(level: int):
    def step(key, held):
        """Ranks of one range of a level, to those who sent its items."""
        for _, x in held.get(ITEM_OF + level, []):
            yield key, ITEM_OF + level, 0, x
        if 0 not in held:
            return
        who, parts = taken(held)
        array, new = merged(parts)
        rank = np.empty(len(array), np.uint64)
        rank[array] = numbered(new, key)
        a, out = 0, {}
        for s, c, n in who:
            out.setdefault(s, []).append((c, steps(rank[a : a + n])))
            a += n
        for s, x in out.items():
            yield s, RANKS + level, key, x

    return step


def compared(key, held):
    """The suffix array of one range, and of each string the smallest id that has it. Neighbours' prefixes are compared by their fingerprints."""
    for _, x in held.get(ITEM_OF, []):
        yield key, ITEM_OF, 0, x
    if 0 not in held:
        return
    who, parts = taken(held)
    array, _ = merged([x[:-2] for x in parts])
    prefix, ids = (np.concatenate([x[i] for x in parts])[array] for i in (-2, -1))
    begin = groups_of(prefix)
    least = np.repeat(np.minimum.reduceat(ids.view(np.int64), begin), np.diff(np.append(begin, len(array))))
    answer = np.empty(len(array), np.int64)
    answer[array] = least
    a, out = 0, {}
    for s, c, n in who:
        out.setdefault(s, []).append((c, answer[a : a + n]))
        a += n
    for s, x in out.items():
        yield s, 6, key, x


def open_answers(key, held):
    """The smallest id of each window of the runs."""
    yield key, 7, 0, of_items(held, 0, 6, np.asarray)


def answers(length: int):
    def step(key, held):
        """Back to the blocks: of each chunk asked for, the smallest id of each window."""
        ids, count, asked, open_ = held[4][0][1]
        least = np.repeat(ids, count)
        for _, x in held.get(7, []):
            least[np.unpackbits(open_, count=len(least)).astype(bool)] = x
        begin = np.cumsum(count) - count
        for block, number in asked.items():
            yield block, 3, key, np.concatenate([least[begin[i] : begin[i] + count[i]] for i in number])

    return step


class Kept:
    """What is left of a document whose bytes come in order."""

    def __init__(self, with_text: bool):
        self.n = self.removed = self.spans = 0
        self.last, self.sha, self.left = False, hashlib.sha256(), [] if with_text else None

    def add(self, buf: np.ndarray, keep: np.ndarray) -> None:
        if not len(buf):
            return
        left = buf[keep].tobytes()
        self.n += len(buf)
        self.removed += len(buf) - len(left)
        self.spans += int(not keep[0] and not self.last) + int((keep[:-1] & ~keep[1:]).sum())
        self.last = not keep[-1]
        self.sha.update(left)
        if self.left is not None:
            self.left.append(left)

    def row(self, doc_id) -> tuple:
        out = (doc_id, self.n, self.removed, self.spans, self.sha.hexdigest())
        return out if self.left is None else (*out, b"".join(self.left).decode("utf-8", "ignore"))


def cleaned(length: int, with_text: bool):
    def step(block, held):
        """Rows of whole documents (kind 8), and the pieces of others (kind 9)."""
        t = Text(held[0][0][1])
        gone = np.zeros(len(t.buf) + 1, np.int32)
        if 2 in held:
            start, count, number, own = held[2][0][1]
            least = np.concatenate([v for _, v in held[3]])  # in the order of the buckets, as the chunks were numbered
            begin = np.cumsum(own) - own
            within = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            at = np.repeat(start, count) + within
            hit = at[least[np.repeat(begin[number], count) + within] < t.ids[t.doc[at]]]
            gone[hit] += 1
            gone[hit + length] -= 1
        keep = np.cumsum(gone[:-1]) == 0
        rows = []
        for i, (a, b) in enumerate(zip(t.off[:-1].tolist(), t.off[1:].tolist(), strict=True)):
            doc = int(t.ids[i]) if t.known[i] else None
            if t.seq[i] >= 0:
                yield t.row[i], 9, t.seq[i], (doc, int(t.core[i]), t.buf[a : a + t.core[i]].tobytes(), np.packbits(keep[a:b]), b - a)
                continue
            k = Kept(with_text)
            k.add(t.buf[a:b], keep[a:b])
            rows.append(k.row(doc))
        if rows:
            yield block, 8, 0, rows

    return step


def whole_documents(length: int, with_text: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            now = state = doc = None
            for b in batches:
                for k, x in zip(b.column(0).to_pylist(), b.column(3), strict=True):
                    if k != now:
                        if state:
                            yield state.row(doc)
                        now, state, over = k, Kept(with_text), np.ones(0, bool)
                    doc, core, data, keep, n = unpacked(x.as_py())
                    keep = np.unpackbits(keep, count=n).astype(bool)
                    m = min(len(over), len(keep))  # what the piece before had of this one
                    keep[:m] &= over[:m]
                    state.add(np.frombuffer(data, np.uint8), keep[:core])
                    over = keep[core:]
            if state:
                yield state.row(doc)

        yield from rows_out(with_text)(rows())

    return run


def rows_out(with_text: bool):
    names = OUT.replace(" long", "").replace(" string", "").split(", ") + ["kept_text"] * with_text
    kinds = {"doc_id": pa.int64(), "n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string(), "kept_text": pa.string()}

    def out(rows):
        some, size = [], 0
        for r in rows:
            some.append(r)
            size += len(r[-1])
            if len(some) >= 4096 or size > 1 << 24:
                yield pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for k, c in zip(names, zip(*some, strict=True), strict=True)], names)
                some, size = [], 0
        if some:
            yield pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for k, c in zip(names, zip(*some, strict=True), strict=True)], names)

    return out


def splitters(runs: DataFrame, length: int, buckets: int) -> list[bytes]:
    """At most SPLITTERS sampled windows come to the driver."""
    each_of = max(1, SPLITTERS // buckets)
    some = runs.where(F.pmod(F.xxhash64("key"), F.lit(-(-buckets // SPLITTERS))) == 0)

    def step(key, _, body):
        t = Runs(body, length)
        at = t.places[t.room > 0]
        yield key, 0, 0, t.text(at[np.linspace(0, len(at) - 1, min(each_of, len(at))).astype(int)], length)

    found = [unpacked(bytes(r.body)) for r in each(some, step).select("body").collect()]
    every = np.sort(np.concatenate(found)) if found else np.zeros(0, f"S{length}")
    return [x.ljust(length, b"\0") for x in np.unique(every[np.linspace(0, len(every) - 1, min(buckets - 1, len(every))).astype(int)]).tolist()] if len(every) else []


def sorted_windows(stage: Stage, runs: DataFrame, length: int, parts: int) -> DataFrame:
    """For each bucket of runs the smallest id of each of its windows, by the suffix array of them all."""
    spark = runs.sparkSession
    split = spark.sparkContext.broadcast(splitters(runs, length, parts))
    top = Runs((np.zeros(0, np.int64), np.zeros(0, np.int64), b""), length).top

    names: list[DataFrame] = []
    for level in range(top + 1):  # down: names
        triples = gathered([runs, *names[-1:]], parts, triples_out(length, level, split))
        names.append(stage.put(gathered([triples], parts, named(level)), f"names{level}"))
    above = names.pop()
    for level in range(top, 0, -1):  # up: the rest merged in
        own = names.pop()
        items = gathered([runs, own, above], parts, items_out(length, level, split))
        rank = stage.put(gathered([items], parts, ranked(level)), f"ranks{level}")
        stage.drop(own, above)
        above = rank
    items = gathered([runs, above], parts, items_out(length, 0, split))
    out = stage.put(gathered([gathered([items], parts, compared)], parts, open_answers), "windows")
    stage.drop(above)
    return out


def remove_repeats(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, block_bytes: int = BLOCK_BYTES, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """One row a document: its bytes, those removed, the maximal removed runs, the digest of the rest (``with_text``: and the rest itself, less broken characters)."""
    if length <= GRAM:
        raise ValueError(f"length must be over {GRAM}")
    spark = docs.sparkSession
    stage = Stage(spark, "suffix-array")
    own = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    texts = stage.put(blocks(own, length, block_bytes, max(piece_bytes, length)), "blocks")
    # messages shrink texts, so the work is dealt by the bytes that blocks take
    size = texts.agg(F.sum(F.length("body"))).first()[0] or 0
    parts = max(12, -(-size // BUCKET_BYTES))
    found = gathered([each(texts, fingerprints(length, parts))], parts, repeated)
    sent_out = stage.put(gathered([texts, found], parts, chunks(length, parts)), "chunks")
    strings = stage.put(gathered([sent_out.where("kind = 3")], parts, distinct_strings(length)), "strings")
    holders = stage.put(sent_out.where("kind = 2"), "holders")
    stage.drop(sent_out)
    again = gathered([each(strings, hashes_out(length, parts))], parts, repeated)
    marked = stage.put(gathered([strings, again], parts, runs_out(length, parts)), "marked")
    stage.drop(strings)
    windows = sorted_windows(stage, marked.where("kind = 5"), length, parts)
    back = gathered([marked.where("kind = 4"), windows], parts, answers(length))
    done = stage.put(gathered([texts, holders, back], parts, cleaned(length, with_text)), "cleaned")
    stage.drop(texts, holders, marked, windows)
    schema = OUT + ", kept_text string" * with_text
    whole = each(done.where("kind = 8"), lambda key, sub, rows: rows, schema, rows_out(with_text))
    pieces = done.where("kind = 9").repartition(parts, "key").sortWithinPartitions("key", "sub")
    return whole.unionByName(pieces.mapInArrow(lean(whole_documents(length, with_text)), schema))


def op2_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
