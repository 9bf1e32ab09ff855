"""Encoding of many texts through a table of chunks that recur.

A text is cut before every single space that stands between two characters which aren't white space; no token
of a byte-level vocabulary spans such a place. Chunks are hashed in numpy, a sorted table holds the bytes and ids of
those met before, and only new ones are encoded. Hashes only propose: a chunk takes ids from the table if its bytes are the same."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa

from framelake.llm._text import U, as_bytes, prefix, slices, spaces, spread

#: White space beyond ASCII, as UTF-8.
WIDE_SPACE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
WIDE_LEADS = (b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80")


class ChunkTable:
    """Ids by chunk hash. Beyond `most` chunks it starts afresh, so its memory is bounded; results don't depend on it."""

    def __init__(self, most: int = 3 << 19):
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.keys, self.slot = np.zeros(0, U), np.zeros(0, np.int64)
        self.start, self.ids = [np.zeros(1, np.int64)], [np.zeros(0, np.uint32)]
        self.byte_start, self.bytes = [np.zeros(1, np.int64)], [np.zeros(0, np.uint8)]
        self.n, self.end, self.byte_end = 0, 0, 0

    def missing(self, keys: np.ndarray) -> np.ndarray:
        """Of sorted distinct keys, which the table lacks."""
        at = np.searchsorted(self.keys, keys)
        return ~((at < len(self.keys)) & (self.keys[np.minimum(at, len(self.keys) - 1)] == keys)) if len(self.keys) else np.ones(len(keys), bool)

    def add(self, keys: np.ndarray, counts: np.ndarray, ids: np.ndarray, lengths: np.ndarray, data: np.ndarray) -> None:
        """New keys with the number of ids of each and all their ids, the length of each chunk and all their bytes."""
        self.start.append(self.end + np.cumsum(counts))
        self.ids.append(ids.astype(np.uint32))
        self.byte_start.append(self.byte_end + np.cumsum(lengths))
        self.bytes.append(data)
        order = np.argsort(keys)
        at = np.searchsorted(self.keys, keys[order])
        self.keys = np.insert(self.keys, at, keys[order])
        self.slot = np.insert(self.slot, at, self.n + order)
        self.n, self.end, self.byte_end = self.n + len(keys), self.end + len(ids), self.byte_end + len(data)

    def look_up(self, keys: np.ndarray) -> tuple[np.ndarray, ...]:
        """Start and number of ids of each key, and all ids of the table; the same for the bytes."""
        out = []
        slot = self.slot[np.searchsorted(self.keys, keys)]
        for start, items in ((self.start, self.ids), (self.byte_start, self.bytes)):
            if len(start) > 1:
                start[:], items[:] = [np.concatenate(start)], [np.concatenate(items)]
            out += [start[0][slot], start[0][slot + 1] - start[0][slot], items[0]]
        return tuple(out)


def alike(a: np.ndarray, a_at: np.ndarray, a_size: np.ndarray, b: np.ndarray, b_at: np.ndarray, b_size: np.ndarray) -> np.ndarray:
    """Whether each slice of a has the bytes of that of b."""
    same = a_size == b_size
    size = np.where(same, a_size, 0)
    differs = np.flatnonzero(a[spread(a_at, size)] != b[spread(b_at, size)])
    if len(differs):
        same[np.searchsorted(np.cumsum(size), differs, "right")] = False
    return same


def encode_chunks(table: ChunkTable, data: np.ndarray, start: np.ndarray, end: np.ndarray, before: np.ndarray, fill, hashes=None) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all chunks data[start:end] in order, and the ids before each row; before: chunks before each row.
    fill(start, end) encodes new ones: (the order in which it took them, ids of each in that order, all ids). Chunks whose hash another
    one has, here or in the table, are encoded apart. hashes: of the chunks, where not the usual ones."""
    if not len(start):
        return np.zeros(0, np.uint32), np.zeros(len(before), np.int64)
    length = end - start
    hashes = slices(prefix(data), start, end) if hashes is None else hashes
    keys, first, back = np.unique(hashes, return_index=True, return_inverse=True)
    if table.n + len(keys) > table.most:
        table.clear()
    lack = table.missing(keys)
    if lack.any():
        a, b = start[first[lack]], end[first[lack]]
        order, counts, ids = fill(a, b)
        size = (b - a)[order]
        table.add(keys[lack][order], counts, ids, size, data[spread(a[order], size)])
    at, count, ids, byte_at, size, raw = table.look_up(keys)
    own = alike(data, start[first], length[first], raw, byte_at, size)[back] & alike(data, start, length, data, start[first][back], length[first][back])
    at, count = at[back], count[back]
    if not own.all():
        clash = np.flatnonzero(~own)
        order, counts, more = fill(start[clash], end[clash])
        at[clash[order]], count[clash[order]] = len(ids) + np.cumsum(counts) - counts, counts
        ids = np.concatenate([ids, more.astype(np.uint32)])
    ahead = np.concatenate([[0], np.cumsum(count)])
    return ids[spread(at, count)], ahead[before]


class ByteLevelEncoder:
    """The ids that tokenizers gives with a byte-level vocabulary file and add_special_tokens=False.

    New chunks are encoded with tiktoken by the same vocabulary and merges, which is several times as fast and
    gives the same ids; a text that may hold a special token goes through tokenizers."""

    _kept: dict[str, ByteLevelEncoder] = {}

    @classmethod
    def shared(cls, path: str | None = None) -> ByteLevelEncoder:
        """One for each file and worker process."""
        import public_tokenizers

        path = path or public_tokenizers.path("byte_bpe_50k.json")
        if path not in cls._kept:
            cls._kept[path] = cls(path)
        return cls._kept[path]

    def __init__(self, path: str):
        import tiktoken
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.exact = Tokenizer.from_file(path)
        self.exact.no_truncation()
        self.exact.no_padding()
        special = {t.content: i for i, t in self.exact.get_added_tokens_decoder().items()}
        self.special = re.compile(b"|".join(re.escape(x.encode()) for x in special)) if special else None
        as_char = {b: c for b, c in zip(range(256), self._alphabet())}
        assert set(as_char.values()) == set(ByteLevel.alphabet())
        as_byte = {c: b for b, c in as_char.items()}
        ranks = {bytes(as_byte[c] for c in w): i for w, i in self.exact.get_vocab(with_added_tokens=False).items() if w not in special}
        self.fast = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.bytes_of = np.zeros(max(ranks.values()) + 1, np.int64)
        self.bytes_of[list(ranks.values())] = [len(w) for w in ranks]
        self.table = ChunkTable()

    @staticmethod
    def _alphabet() -> list[str]:
        """The printable stand-in of each byte: itself where printable in Latin-1, else the next code point from 256 on."""
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = iter(range(256, 512))
        return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]

    def _fill(self, data: np.ndarray, raw: bytes, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Encode the chunks data[start:end]. Those that begin with a space and end in a character that isn't white space
        are encoded in one call, one after the other; the tokens' bytes tell where each ends."""
        special = self.special is not None and self.special.search(raw)
        safe = (end - start > 1) & (data[start] == 32) & (data[np.minimum(start + 1, len(data) - 1)] > 32) & (data[end - 1] > 32)
        if special or any(x in raw for x in WIDE_LEADS):
            for i in np.flatnonzero(safe & (data[end - 1] > 127) | bool(special)).tolist():
                x = raw[start[i] : end[i]]
                safe[i] &= not WIDE_SPACE.search(x[-3:]) and not (special and self.special.search(x))
        one, rest = np.flatnonzero(safe), np.flatnonzero(~safe)
        size = end[one] - start[one]
        ids = np.array(self.fast.encode_ordinary(data[spread(start[one], size)].tobytes().decode()), np.uint32)
        edges = np.searchsorted(np.cumsum(self.bytes_of[ids]), np.cumsum(size)) + 1
        others = []
        for i in rest.tolist():
            x = raw[start[i] : end[i]]
            with_special = special and self.special.search(x)
            others.append(self.exact.encode(x.decode(), add_special_tokens=False).ids if with_special else self.fast.encode_ordinary(x.decode()))
        counts = np.concatenate([np.diff(edges, prepend=0), np.array([len(x) for x in others], np.int64)])
        return np.concatenate([one, rest]), counts, np.concatenate([ids, np.array([i for x in others for i in x], np.uint32)])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a column of texts (null: empty), and the number before each row (one more than rows)."""
        data, offsets = as_bytes(texts)
        n = len(data)
        space = spaces(data)
        raw = data.tobytes()
        if any(x in raw for x in WIDE_LEADS):
            for m in WIDE_SPACE.finditer(raw):
                space[m.start() : m.end()] = True
        cut = np.zeros(n + 1, bool)
        if n > 2:
            cut[1 : n - 1] = (data[1:-1] == 32) & ~space[:-2] & ~space[2:]
        cut[offsets] = True
        edges = np.flatnonzero(cut)
        start, end = edges[:-1], edges[1:]
        return encode_chunks(self.table, data, start, end, np.searchsorted(start, offsets), lambda a, b: self._fill(data, raw, a, b))
