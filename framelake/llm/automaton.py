"""BPE encoding and decoding with a tokenization automaton.

The automaton reads tokens and accepts exactly the token sequences that the merges produce. It starts as one
state that takes every base symbol, and each merge (u, v) -> w, in order of rank, adds its gadget: the state
that u leads to is copied without the arc v (the pair would have been merged), u now leads to the copy, and
wherever u is an arc, w becomes one too, leading where v led. A state therefore is the state it was copied
from less some arcs, and whether t is an arc of a state is decided by the first gadget that took away t, or a
left component of t before t was built from it.

Every string has exactly one accepted sequence, so encoding is a walk over a table: for each end position
the one token that ends there and is an arc of the state before it. The table of all pairs of states and tokens would have some
10^9 cells, so its cells are compiled as they are first asked for, and kept."""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.llm._text import as_bytes, parts, spread, words
from framelake.llm.chunks import ByteLevelEncoder, ChunkTable, encode_chunks

#: How the vocabulary's pre-tokenizer finds words, after white space has become single spaces.
WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Texts of code points below 592, as UTF-8.
LATIN = re.compile(rb"(?:[\x00-\x7f]|[\xc2-\xc8][\x80-\xbf]|\xc9[\x80-\x8f])*+")
END = "</w>"


class Automaton:
    """Compiled from a vocabulary and its merges in order of rank."""

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]]):
        size = max(vocabulary.values()) + 1
        self.names = [""] * size
        for w, i in vocabulary.items():
            self.names[i] = w
        self.built = [(-1, -1, len(merges))] * size  # left and right component, rank of the merge that built it; base symbols have none
        #: State of a token: the arcs its own gadgets took away, with their ranks, and the token whose state it copied, with the rank then.
        self.gone: list[dict[int, int]] = [{} for _ in range(size)]
        self.copied: list[tuple[int, int]] = [(-1, 0)] * size
        self.live = {w: i for w, i in vocabulary.items()}
        produced = {b for m in merges for b in ["".join(m)]}
        for rank, (a, b) in enumerate(merges):
            u, v, w = vocabulary[a], vocabulary[b], vocabulary[a + b]
            if not self._arc(u, v, rank):  # no word ever has the pair side by side
                self.live.pop(a + b, None)
                continue
            self.built[w] = (u, v, rank)
            self.copied[w] = (v, rank)  # what v led to, as it was before this gadget
            self.gone[u].setdefault(v, rank)
        for w in produced:
            if self.built[vocabulary[w]][0] < 0:
                self.live.pop(w, None)
        self._tabulate()

    def _tabulate(self) -> None:
        """The trie of live tokens, as sorted arrays. A symbol is a byte, plus 256 where a word ends."""
        as_byte = {c: b for b, c in enumerate(ByteLevelEncoder._alphabet())}
        edges: dict[int, int] = {}
        tokens = [-1]
        for name, token in self.live.items():
            ends = name.endswith(END) and len(name) > len(END)
            symbols = [as_byte[c] for c in (name[: -len(END)] if ends else name)]
            symbols[-1] += 256 * ends
            node = 0
            for x in symbols:
                if (key := node << 10 | x) not in edges:
                    edges[key] = len(tokens)
                    tokens.append(-1)
                node = edges[key]
            tokens[node] = token
        self.edge = np.array(sorted(edges), np.int64)
        self.child = np.array([edges[k] for k in self.edge.tolist()], np.int64)
        self.token = np.array(tokens, np.int64)
        self.known, self.allowed = np.zeros(0, np.int64), np.zeros(0, bool)

    def arcs(self, states: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        """Whether each token is an arc of the state that the token before it leads to; what was asked once is kept in a table."""
        key = states << 20 | tokens
        at = np.minimum(np.searchsorted(self.known, key), max(0, len(self.known) - 1))
        new = self.known[at] != key if len(self.known) else np.ones(len(key), bool)
        if new.any():
            fresh = np.unique(key[new])
            if len(self.known) + len(fresh) > 1 << 21:
                self.known, self.allowed, fresh = self.known[:0], self.allowed[:0], np.unique(key)
            found = np.array([self._arc(k >> 20, k & (1 << 20) - 1, 1 << 30) for k in fresh.tolist()], bool)
            put = np.searchsorted(self.known, fresh)
            self.known, self.allowed = np.insert(self.known, put, fresh), np.insert(self.allowed, put, found)
            at = np.searchsorted(self.known, key)
        return self.allowed[at]

    def _arc(self, state: int, token: int, now: int) -> bool:
        """Whether the token is an arc of the state that `state` leads to, as of the merge of this rank."""
        s, before = state, now
        while s >= 0:
            gone, t, until = self.gone[s], token, now
            while t >= 0:
                rank = gone.get(t)
                if rank is not None and rank < before and rank <= until:
                    return False
                t, _, until = self.built[t]
            s, rank = self.copied[s]
            before = min(before, rank)
        return True

    def encode(self, symbols: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of many words at once: all their symbols in a row and the length of each word; (ids of each word, all ids)."""
        n = len(symbols)
        if not n:
            return np.zeros(len(length), np.int64), np.zeros(0, np.int64)
        first = np.repeat(np.cumsum(length) - length, length)
        last = first + np.repeat(length, length)
        at, node, found = np.arange(n), np.zeros(n, np.int64), []
        reach = at.copy()
        while len(at):  # all tokens that begin at each position
            key = node << 10 | symbols[reach]
            e = np.minimum(np.searchsorted(self.edge, key), len(self.edge) - 1)
            hit = self.edge[e] == key
            at, node, reach = at[hit], self.child[e[hit]], reach[hit] + 1
            token = self.token[node]
            is_token = token >= 0
            found.append((at[is_token], reach[is_token] - 1, token[is_token]))
            inside = reach < last[at]
            at, node, reach = at[inside], node[inside], reach[inside]
        start, end, token = (np.concatenate(x) for x in zip(*found))
        depth = end - first[end]
        order = np.argsort(depth, kind="stable")
        start, end, token = start[order], end[order], token[order]
        edges = np.searchsorted(depth[order], np.arange(int(length.max()) + 1))
        ends, size = np.full(n, -1, np.int64), np.zeros(n, np.int64)
        for a, b in zip(edges, edges[1:]):  # the state after each symbol, of all words together
            s, e, t = start[a:b], end[a:b], token[a:b]
            opens = s == first[s]
            state = np.where(opens, -1, ends[s - 1])
            ok = opens.copy()
            ask = np.flatnonzero(state >= 0)
            ok[ask] = self.arcs(state[ask], t[ask])
            ends[e[ok]], size[e[ok]] = t[ok], e[ok] - s[ok] + 1
        word, q = np.arange(len(length)), np.cumsum(length) - 1
        q, word = q[length > 0], word[length > 0]
        low = q - length[length > 0] + 1
        taken = []
        while len(q):
            taken.append((word, q))
            q = q - size[q]
            more = q >= low
            q, word, low = q[more], word[more], low[more]
        word, q = (np.concatenate(x) for x in zip(*taken))
        q.sort()  # words stand in order, and so do the ends of a word's tokens
        return np.bincount(word, minlength=len(length)), ends[q]


class WordEncoder:
    """The ids that tokenizers gives with a lower-casing byte-level vocabulary of words with end marks, add_special_tokens=False."""

    _kept: dict[str, WordEncoder] = {}

    @classmethod
    def shared(cls, path: str | None = None) -> WordEncoder:
        import public_tokenizers

        path = path or public_tokenizers.path("word_bpe_49k.json")
        if path not in cls._kept:
            cls._kept[path] = cls(path)
        return cls._kept[path]

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(path)
        self.exact.no_truncation()
        self.exact.no_padding()
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.automaton = Automaton(model["vocab"], merges)
        added = self.exact.get_added_tokens_decoder()
        if any(t.single_word or t.lstrip or t.rstrip or t.normalized for t in added.values()):
            raise ValueError("special tokens that look at their surroundings are not supported")
        self.special = {t.content: i for i, t in added.items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        labels = {**{i: w for w, i in model["vocab"].items()}, **{i: w for w, i in self.special.items()}}
        raw = [labels.get(i, "").encode() + b" " for i in range(max(labels) + 1)]
        self.label_at = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
        self.labels = np.frombuffer(b"".join(raw), np.uint8)
        self.byte = {c: b for b, c in enumerate(ByteLevelEncoder._alphabet())}
        self.table = ChunkTable()

    def _normal(self, text: str | None) -> str:
        """White space is only looked for in ASCII here, where the chunks are cut; what else there is gets the library's own forms."""
        if text is None or text.isascii():
            return (text or "").lower()
        if LATIN.fullmatch(text.encode()) and not re.search("[\x85\xa0İ]", text):
            return unicodedata.normalize("NFC", text).lower()
        return self.exact.normalizer.normalize_str(text)

    def _fill(self, raw: bytes, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Encode chunks without white space. Words cover a chunk wholly, so their bytes tell whose they are."""
        chunks = [raw[a:b] for a, b in zip(start.tolist(), end.tolist())]
        latin = [bool(LATIN.fullmatch(x)) for x in chunks]
        order = np.concatenate([np.flatnonzero(latin), np.flatnonzero(~np.array(latin, bool))])
        mine = [x for x, ok in zip(chunks, latin) if ok]
        pieces = WORD.findall(b" ".join(mine).decode())
        sizes = [len(x.encode()) for x in pieces]
        data, whole = list(mine), [len(x) for x in mine]
        for x, ok in zip(chunks, latin):
            if not ok:
                found = [bytes(self.byte[c] for c in w) for w, _ in self.exact.pre_tokenizer.pre_tokenize_str(x.decode())]
                sizes += map(len, found)
                whole.append(sum(map(len, found)))
                data += found
        size = np.array(sizes, np.int64)
        symbols = np.frombuffer(b"".join(data), np.uint8).astype(np.int64)
        symbols[np.cumsum(size) - 1] += 256
        counts, ids = self.automaton.encode(symbols, size)
        edges = np.searchsorted(np.cumsum(size), np.cumsum(whole), "right")
        ahead = np.concatenate([[0], np.cumsum(counts)])[edges]
        return order, np.diff(ahead, prepend=0), ids

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a column of texts (null: empty), and the number before each row (one more than rows).

        A text is cut at special tokens, which are their own ids; the automaton encodes what lies between them."""
        listed = texts.to_pylist()
        if not self.cut or not any(x and self.cut.search(x) for x in listed):
            return self._encode(listed)
        between, rows = [], []
        for x in listed:
            found = self.cut.split(x or "")
            rows.append((len(between), [self.special[m] for m in found[1::2]]))
            between += found[::2]
        ids, ahead = self._encode(between)
        out, counts = [], []
        for at, marks in rows:
            out.append(ids[ahead[at] : ahead[at + 1]])
            for k, mark in enumerate(marks, at + 1):
                out += [np.array([mark], np.uint32), ids[ahead[k] : ahead[k + 1]]]
            counts.append(int(ahead[at + len(marks) + 1] - ahead[at]) + len(marks))
        return np.concatenate(out), np.concatenate([[0], np.cumsum(counts)])

    def _encode(self, listed: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        data, offsets = as_bytes(pa.array([self._normal(x) for x in listed], pa.large_string()))
        start, end, before = words(data, offsets)
        raw = data.tobytes()
        return encode_chunks(self.table, data, start, end, before, lambda a, b: self._fill(raw, a, b))

    def decode(self, ids: np.ndarray, before: np.ndarray) -> list[bytes]:
        """The text of each row's ids, as UTF-8: the labels of the arcs with a space between them."""
        length = self.label_at[ids.astype(np.int64) + 1] - self.label_at[ids]
        raw = self.labels[spread(self.label_at[ids], length)].tobytes()
        at = np.concatenate([[0], np.cumsum(length)])[before].tolist()
        return [raw[a : max(a, b - 1)] for a, b in zip(at, at[1:])]


def encode(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """documents(doc_id, text, ...) to doc_id, ids (little-endian 32-bit) and decoded (text). A null or empty text has no ids.
    Repeated rows are coded alike, an empty table gives an empty result, other columns play no part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = WordEncoder.shared(tokenizer)
        for part in parts(batches, "text", 1 << 20):
            ids, before = coder.encode(part.column(1))
            raw, at = ids.astype("<u4").tobytes(), (before * 4).tolist()
            yield pa.record_batch(
                [part.column(0), pa.array([raw[a:b] for a, b in zip(at, at[1:])], pa.binary()), pa.array(coder.decode(ids, before), pa.binary()).cast(pa.string())],
                names=["doc_id", "ids", "decoded"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids binary, decoded string")


def op3_bpe_encoding_and_decoding(spark, sf_dir: str) -> DataFrame:
    """Digests of the ids and the decoded text of every document."""
    from framelake.llm._common import read

    coded = encode(read(spark, sf_dir, "documents", "doc_id", "text"))
    return coded.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
