"""Token ids of whole texts, by the tokenizers library.

Byte-level BPE never merges across a space that stands before a character other than white space, nor from a letter to a
mark or digit, so a text's ids are those of the pieces between such places in turn. Each distinct piece goes through the tokenizer once while a worker's
bounded table keeps its bytes and ids; pieces are looked up many at a time by two 64-bit hashes, and their bytes are
compared. This gives the ids of the plain ``encode`` call (tests compare them) at a fraction of its time, and memory
for a part of a text at a time. Parts with a very long piece, and parts that hold an added token's own text, such as
``<|endoftext|>``, go through the plain call itself.
"""

from __future__ import annotations

import functools
import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from missivelake.llm.common import chunks, texts

TOKENIZER = "byte_bpe_50k.json"
END_ID = 2
#: Pieces whose ids a worker remembers before it starts afresh, and bits of the table that finds them.
MEMO, TABLE_BITS = 600_000, 21
#: Bytes of text that are cut at one time, and the longest piece that is remembered.
TOGETHER, PIECE_BYTES = 1 << 18, 256


class Hashes:
    """Two hashes of every slice of a buffer, from running sums of its bytes times powers of two odd numbers."""

    def __init__(self, size: int):
        self.up, self.down = [], []
        for base in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
            for powers, b in ((self.up, base), (self.down, pow(base, -1, 1 << 64))):
                powers.append(np.concatenate([[np.uint64(1)], np.cumprod(np.full(size, b, np.uint64))]))

    def __call__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
        w = data.astype(np.uint64) + np.uint64(1)
        out = []
        for up, down in zip(self.up, self.down, strict=True):
            sums = np.zeros(len(w) + 1, np.uint64)
            np.cumsum(w * up[: len(w)], out=sums[1:])
            h = (sums[ends] - sums[starts]) * down[starts]
            h ^= h >> np.uint64(29)
            out.append(h * np.uint64(0xBF58476D1CE4E5B9))
        return out


class PieceTable:
    """Ids and bytes of pieces by their two hashes: an open-addressed table over arrays."""

    def __init__(self) -> None:
        self.slots = np.full(1 << TABLE_BITS, -1, np.int32)
        room = MEMO + TOGETHER
        self.h1, self.h2 = np.zeros(room, np.uint64), np.zeros(room, np.uint64)
        self.start, self.count = np.zeros(room, np.int32), np.zeros(room, np.int32)  # place in ids
        self.place, self.size = np.zeros(room, np.int32), np.zeros(room, np.int32)  # place in bytes
        self.pools = {"ids": np.zeros(1 << 18, np.uint32), "bytes": np.zeros(1 << 20, np.uint8)}
        self.n, self.used = 0, {"ids": 0, "bytes": 0}

    def full(self) -> bool:
        return self.n > MEMO

    def clear(self) -> None:
        self.slots.fill(-1)
        self.n, self.used = 0, {"ids": 0, "bytes": 0}

    @staticmethod
    def _slot(h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - TABLE_BITS)).astype(np.int64)

    def find(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """The entry of each pair of hashes, or -1."""
        slot = self._slot(h1)
        entry = self.slots[slot]
        todo = np.flatnonzero((entry >= 0) & ((self.h1[entry] != h1) | (self.h2[entry] != h2)))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & (len(self.slots) - 1)
            e = entry[todo] = self.slots[slot[todo]]
            todo = todo[(e >= 0) & ((self.h1[e] != h1[todo]) | (self.h2[e] != h2[todo]))]
        return entry

    def differ(self, entries: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Places where an entry's bytes aren't those of the slice of data that its hashes were taken of."""
        sizes = ends - starts
        wrong = self.size[entries] != sizes
        same = np.flatnonzero(~wrong)
        n = sizes[same]
        upto = np.cumsum(n)
        each = np.arange(int(upto[-1]) if len(upto) else 0)
        kept = self.pools["bytes"][np.repeat(self.place[entries[same]] - (upto - n), n) + each]
        off = np.flatnonzero(kept != data[np.repeat(starts[same] - (upto - n), n) + each])
        wrong[same[np.searchsorted(upto, off, side="right")]] = True
        return np.flatnonzero(wrong)

    def _put(self, pool: str, values: np.ndarray) -> int:
        at = self.used[pool]
        if at + len(values) > len(self.pools[pool]):
            self.pools[pool] = np.concatenate([self.pools[pool][:at], np.zeros(at + 2 * len(values), values.dtype)])
        self.pools[pool][at : at + len(values)] = values
        self.used[pool] = at + len(values)
        return at

    def add(self, h1: np.ndarray, h2: np.ndarray, counts: np.ndarray, ids: np.ndarray, sizes: np.ndarray, data: np.ndarray) -> None:
        """Entries of new, different pairs of hashes; ids and bytes of all of them stand in turn."""
        n, new = self.n, len(h1)
        self.h1[n : n + new], self.h2[n : n + new], self.count[n : n + new], self.size[n : n + new] = h1, h2, counts, sizes
        self.start[n : n + new] = self._put("ids", ids) + np.cumsum(counts) - counts
        self.place[n : n + new] = self._put("bytes", data) + np.cumsum(sizes) - sizes
        slot, todo = self._slot(h1), np.arange(new)
        while len(todo):
            free = todo[self.slots[slot[todo]] < 0]
            _, first = np.unique(slot[free], return_index=True)
            self.slots[slot[free[first]]] = n + free[first]
            todo = todo[self.slots[slot[todo]] != n + todo]
            slot[todo] = (slot[todo] + 1) & (len(self.slots) - 1)
        self.n = n + new

    def ids(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all entries in turn, and how many each has."""
        counts = self.count[entries].astype(np.int64)
        ends = np.cumsum(counts)
        at = np.repeat(self.start[entries] - (ends - counts), counts) + np.arange(int(ends[-1]) if len(ends) else 0)
        return self.pools["ids"][at], counts


def _letters() -> np.ndarray:
    out = np.zeros(256, bool)
    out[65:91] = out[97:123] = True
    return out


_LETTER = _letters()


def _spaces(data: np.ndarray) -> np.ndarray:
    """Places of the spaces that no white space, nor the end, follows (where that is told by few bytes: some are left out)."""
    at = np.flatnonzero(data[:-3] == 32)
    a, b, c = data[at + 1], data[at + 2], data[at + 3]
    fine = (a > 32) & ((a != 0xC2) | (b > 0xA0)) & (a != 0xE1) & (a != 0xE3)
    return at[fine & ((a != 0xE2) | ((b == 0x80) & (c >= 0x90) & (c <= 0xA7)))]


def _tails(data: np.ndarray) -> np.ndarray:
    """Places right after a letter where an ASCII character stands that is neither letter nor space, and places of ASCII
    letters after a line feed that is no part of more white space."""
    letter = _LETTER[data]
    ends = letter.copy()  # letters' last bytes; of others than ASCII those of two bytes with the first one C3
    ends[1:] |= (data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)
    tail = ends[:-1] & (data[1:] < 128) & ~letter[1:] & (data[1:] != 32)
    tail[1:] |= letter[2:] & (data[1:-1] == 10) & (data[:-2] > 32) & (data[:-2] < 127)
    return np.flatnonzero(tail) + 1


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit integers, the end id last."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        self.added = re.compile(b"|".join(map(re.escape, added))) if added else None
        #: Bytes that each id stands for, or None if the tokenizer isn't byte-level.
        byte_level = type(self.tokenizer.pre_tokenizer).__name__ == "ByteLevel" and self.tokenizer.normalizer is None
        size = self.tokenizer.get_vocab_size()
        self.bytes_of = np.array([len(self.tokenizer.id_to_token(i) or "") for i in range(size)]) if byte_level else None
        self.table, self.hashes = PieceTable(), Hashes(TOGETHER)
        self.end = np.array([END_ID], "<u4").tobytes()

    def plain(self, rows: list[bytes]) -> list[np.ndarray]:
        decoded = [x.decode("utf-8", "replace") for x in rows]
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(decoded, add_special_tokens=False)]

    def learn(self, data: bytes, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> None:
        """Take pieces into the table: those that begin a text or follow a letter or line, and those with a space before them."""
        cut = [data[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        alone, spaced = np.flatnonzero(first), np.flatnonzero(~first)
        if len(alone):
            pieces = [cut[k] for k in alone]
            found = self.plain(pieces)
            self._add(h1[alone], h2[alone], np.array([len(x) for x in found]), np.concatenate(found), pieces)
        if len(spaced):  # many are encoded as one text and told apart by their bytes
            pieces = [cut[k] for k in spaced]
            ids = self.plain([b" " + b" ".join(pieces)])[0]
            upto = np.searchsorted(np.cumsum(self.bytes_of[ids]), np.cumsum([len(x) + 1 for x in pieces])) + 1
            self._add(h1[spaced], h2[spaced], np.diff(upto, prepend=0), ids, pieces)

    def _add(self, h1: np.ndarray, h2: np.ndarray, counts: np.ndarray, ids: np.ndarray, pieces: list[bytes]) -> None:
        self.table.add(h1, h2, counts, ids, np.array([len(x) for x in pieces]), np.frombuffer(b"".join(pieces), np.uint8))

    def together(self, parts: list[bytes], begins: list[bool]) -> list[np.ndarray]:
        """Ids of non-empty parts of texts of at most TOGETHER bytes in all: those that begin a text, and those that a
        space stands before."""
        data = b" ".join(parts)
        buffer = np.frombuffer(data, np.uint8)
        lengths = np.array([len(x) for x in parts])
        heads = np.cumsum(lengths + 1) - (lengths + 1)
        spaced, first = np.zeros(len(buffer), bool), np.zeros(len(buffer), bool)  # pieces with a space before them, and without
        spaced[_spaces(buffer) + 1] = True
        if len(buffer) > 2:
            first[_tails(buffer)] = True
        spaced[heads], first[heads] = ~np.array(begins), begins
        starts = np.flatnonzero(spaced | first)
        ends = np.append(starts[1:] - spaced[starts[1:]], len(buffer))
        ends[np.searchsorted(starts, heads[1:]) - 1] = heads[1:] - 1
        first = first[starts]
        head = np.searchsorted(starts, heads)  # each part's first piece
        h1, h2 = self.hashes(buffer, starts, ends)
        h1 ^= (ends - starts).astype(np.uint64) * np.uint64(0x94D049BB133111EB)
        h1[first] ^= np.uint64(0x5851F42D4C957F2D)
        long = ends - starts > PIECE_BYTES
        if self.table.full():
            self.table.clear()
        entries = self.table.find(h1, h2)
        gaps = np.flatnonzero((entries < 0) & ~long)
        while len(gaps):
            _, one = np.unique(h1[gaps], return_index=True)
            new = gaps[np.sort(one)]
            self.learn(data, starts[new], ends[new], first[new], h1[new], h2[new])
            entries[gaps] = self.table.find(h1[gaps], h2[gaps])
            gaps = gaps[entries[gaps] < 0]
        short = np.flatnonzero(~long)
        apart = np.append(np.flatnonzero(long), short[self.table.differ(entries[short], buffer, starts[short], ends[short])])
        entries[long] = 0  # any: these parts go through the plain call below
        ids, counts = self.table.ids(entries)
        out = np.split(ids, np.cumsum(np.add.reduceat(counts, head))[:-1])
        for k in np.unique(np.searchsorted(head, apart, side="right") - 1).tolist():
            out[k] = self.plain([parts[k] if begins[k] else b" " + parts[k]])[0]
        return out

    def parts(self, text: bytes) -> list[tuple[bytes, bool]]:
        """A text in parts of at most TOGETHER bytes (longer where no space allows a cut), and whether they begin it."""
        out, at = [], 0
        while len(text) - at > TOGETHER:
            window = np.frombuffer(text, np.uint8, TOGETHER + 4 if len(text) - at > TOGETHER + 4 else len(text) - at, at)
            cuts = _spaces(window[: TOGETHER + 3])
            if not len(cuts) or not cuts[-1]:
                cuts = _spaces(np.frombuffer(text, np.uint8, len(text) - at, at))
                cuts = cuts[cuts > 0][:1]
            if not len(cuts):
                break
            out.append((text[at : at + int(cuts[-1])], not at))
            at += int(cuts[-1]) + 1
        out.append((text[at:], not at))
        return out

    def __call__(self, rows: list[str | bytes | None]) -> list[bytes]:
        found: list[list[np.ndarray]] = []
        group: list[tuple[bytes, bool, list[np.ndarray], int]] = []
        size = 0

        def flush() -> None:
            for (*_, own, k), ids in zip(group, self.together([g[0] for g in group], [g[1] for g in group]), strict=True):
                own[k] = ids
            group.clear()

        for x in rows:
            text = x.encode() if isinstance(x, str) else x or b""
            cut = self.parts(text) if text and self.bytes_of is not None else [(text, True)]
            own = [np.zeros(0, np.uint32)] * len(cut)
            found.append(own)
            for k, (part, begins) in enumerate(cut):
                if self.bytes_of is None or not part or len(part) > TOGETHER or self.added and self.added.search(part):
                    own[k] = self.plain([part if begins else b" " + part])[0]
                    continue
                if group and size + len(part) + 1 > TOGETHER:
                    flush()
                    size = 0
                group.append((part, begins, own, k))
                size += len(part) + 1
        if group:
            flush()
        return [np.concatenate(own).astype("<u4").tobytes() + self.end for own in found]


@functools.lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """The worker's encoder, whose table serves all of its tasks."""
    return Encoder(path)


def mapped(docs: DataFrame, build: Callable[[pa.RecordBatch, list[bytes]], pa.RecordBatch], schema: str, tokenizer: str | None = None) -> DataFrame:
    """build(rows of (doc_id, text), their ids) for all of docs, part by part."""
    path = tokenizer or public_tokenizers.path(TOKENIZER)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            for part in chunks(batch):
                yield build(part, encode(texts(part)))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, schema)
