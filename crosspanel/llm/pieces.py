"""SentencePiece encoding and decoding: best segmentation by an Aho-Corasick Viterbi pass.

The automaton holds all pieces of a vocabulary (a blank stands for the word mark).  One pass
over a text walks it; at each position the output links name every piece that ends there, and
each relaxes the best score of its end.  Texts are cut where no piece can span (before a run
of blanks, around line ends), equal chunks of a task are encoded once, and a block of chunks
advances together in NumPy.  Characters without a piece of their own fall back to byte
pieces.  Vocabularies are read, never trained.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from crosspanel.llm.frames import map_batches, with_fields
from crosspanel.llm.textbytes import text_slices

MARK = "▁"
MEMO_CHUNKS = 100_000
MAX_ROWS = 128
ENCODE_BYTES = 2 << 20
BLOCK_CELLS = 250_000


@dataclass(frozen=True)
class Vocabulary:
    """Pieces by id with scores, byte pieces (256 ids) and the penalty of an unknown character."""

    pieces: list[str]
    scores: list[float]
    normal: list[bool]
    byte_ids: list[int]
    unk_score: float


def load_vocabulary(path: str, scores: str = "stored") -> Vocabulary:
    """Read a model file.

    ``scores="stored"`` takes the file's log-probabilities.  A merge vocabulary stores ranks
    instead; ``"zipf"`` turns rank r into ``-ln(r + 1)``.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.vocab_size())
    special = [model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i) for i in ids]
    byte_of = {int(model.id_to_piece(i)[3:5], 16): i for i in ids if model.is_byte(i)}
    if len(byte_of) != 256:
        raise ValueError("the vocabulary has no byte pieces, so encoding could lose text")
    first = next(i for i in ids if not special[i])
    value = [float(model.get_score(i)) if scores == "stored" else -float(np.log(max(i - first, 0) + 1)) for i in ids]
    lowest = min(v for v, s in zip(value, special, strict=True) if not s)
    return Vocabulary([model.id_to_piece(i) for i in ids], value, [not s for s in special], [byte_of[b] for b in range(256)], lowest - 10.0)


class Encoder:
    """Automaton of a vocabulary as arrays, and the block-wise Viterbi over it."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        v = vocabulary
        words = {p.replace(MARK, " "): i for i, p in enumerate(v.pieces) if v.normal[i] and p}
        self.alphabet = np.array(sorted({ord(c) for w in words for c in w}), dtype=np.int64)
        rank = {int(c): i for i, c in enumerate(self.alphabet)}
        children: list[dict[int, int]] = [{}]
        piece, depth = [-1], [0]
        for w, i in words.items():
            at = 0
            for c in w:
                nxt = children[at].get(rank[ord(c)])
                if nxt is None:
                    nxt = len(children)
                    children[at][rank[ord(c)]] = nxt
                    children.append({})
                    piece.append(-1)
                    depth.append(depth[at] + 1)
                at = nxt
            piece[at] = i
        fail, out = [0] * len(children), [0] * len(children)
        queue = list(children[0].values())
        for s in queue:  # breadth first; grows while it runs
            out[s] = s if piece[s] >= 0 else out[fail[s]]
            for c, t in children[s].items():
                f = fail[s]
                while f and c not in children[f]:
                    f = fail[f]
                fail[t] = children[f].get(c, 0)
                queue.append(t)
        # ``below`` is the next node of the output chain under a node that is itself a piece.
        self.first_out = np.array(out, dtype=np.int32)
        self.below = np.array([out[fail[s]] for s in range(len(children))], dtype=np.int32)
        self.fail = np.array(fail, dtype=np.int32)
        self.piece = np.array(piece, dtype=np.int32)
        self.depth = np.array(depth, dtype=np.int32)
        self.score = np.array([v.scores[p] if p >= 0 else 0.0 for p in piece])
        # Trie edges by character, and the nodes level by level, from which the full
        # transition row of a character is derived when a text first needs it.
        by_char: dict[int, list[tuple[int, int]]] = {}
        for s, kids in enumerate(children):
            for c, t in kids.items():
                by_char.setdefault(c, []).append((s, t))
        self.edges = {c: np.array(e, dtype=np.int32).T for c, e in by_char.items()}
        self.levels = [np.flatnonzero(self.depth == d) for d in range(1, int(self.depth.max()) + 1)]
        self.rows: dict[int, int] = {}
        self.alone = np.array([chr(c) in words for c in self.alphabet] or [False])
        self.unk_score, self.byte_ids = v.unk_score, v.byte_ids
        spans = any(" " in w.lstrip(" ") for w in words)
        lines = any("\n" in w for w in words)
        self.cut = None if spans else re.compile(r" +[^ ]*" if lines else r" +[^ \n]*|\n|[^ \n]+")
        self.table: np.ndarray | None = None
        self._forget()

    def __getstate__(self) -> dict[str, object]:
        self._forget()
        return self.__dict__ | {"rows": {}, "table": None}

    def _row(self, char: int) -> int:
        """Where the table says the state after every state on one character; row 0 is any unknown one's."""
        if char < 0:
            return 0
        if char not in self.rows:
            if self.table is None:
                self.table = np.zeros((1 + MAX_ROWS, len(self.fail)), dtype=np.int32)
            if len(self.rows) >= MAX_ROWS:
                self.rows.clear()
            to = self.table[1 + len(self.rows)]
            own = np.zeros(len(self.fail), dtype=bool)
            source, target = self.edges[char]
            to[0] = 0
            to[source], own[source] = target, True
            for level in self.levels:
                rest = level[~own[level]]
                to[rest] = to[self.fail[rest]]
            self.rows[char] = 1 + len(self.rows)
        return self.rows[char]

    def _rows_of(self, chars: np.ndarray) -> np.ndarray | None:
        """Rows of several characters that stand in the table together; None if there are too many."""
        wanted = set(chars[chars >= 0].tolist())
        if len(wanted) > MAX_ROWS:
            return None
        if len(wanted.union(self.rows)) > MAX_ROWS:
            self.rows.clear()
        return np.array([self._row(int(c)) for c in chars], dtype=np.int64)

    def encode_texts(self, texts: list[str | None]) -> list[np.ndarray | None]:
        """Ids of every text; a null stays null, an empty text has no ids."""
        chunks = [None if t is None else [] if not t else self.cut.findall(" " + t) if self.cut else [" " + t] for t in texts]
        if len(self.memo) > MEMO_CHUNKS:
            self._forget()
        new = sorted(set(chain.from_iterable(c for c in chunks if c)).difference(self.memo), key=len)
        at = 0
        while at < len(new):
            to = at + 1
            while to < len(new) and (to - at + 1) * (len(new[to]) + 1) <= BLOCK_CELLS and to - at < 50_000:
                to += 1
            self._remember(new[at:to], *self._viterbi(new[at:to]))
            at = to
        number = self.memo.__getitem__
        return [None if row is None else self._join(np.fromiter(map(number, row), dtype=np.int64, count=len(row))) for row in chunks]

    def _forget(self) -> None:
        self.memo: dict[str, int] = {}
        self.pool = np.zeros(1 << 16, dtype=np.int32)
        self.pool_end = np.zeros(1 << 14, dtype=np.int64)

    def _remember(self, chunks: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        """Append the ids of new chunks to the pool; chunk k has those up to ``pool_end[k]``."""
        known = len(self.memo)
        used = int(self.pool_end[known - 1]) if known else 0
        while len(self.pool) < used + len(ids):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        while len(self.pool_end) < known + len(chunks):
            self.pool_end = np.concatenate([self.pool_end, np.zeros_like(self.pool_end)])
        self.pool[used : used + len(ids)] = ids
        self.pool_end[known : known + len(chunks)] = used + np.cumsum(sizes)
        self.memo.update(zip(chunks, range(known, known + len(chunks)), strict=True))

    def _join(self, numbers: np.ndarray) -> np.ndarray:
        ends = self.pool_end[numbers]
        begins = np.where(numbers > 0, self.pool_end[numbers - 1], 0)
        sizes = ends - begins
        shift = begins - (np.cumsum(sizes) - sizes)
        return self.pool[np.repeat(shift, sizes) + np.arange(int(sizes.sum()))]

    def _viterbi(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Best segmentation of chunks sorted by length: all ids in a row, and how many each has."""
        size = np.array([len(c) for c in chunks])
        n, longest = len(chunks), int(size[-1])
        flat = np.frombuffer("".join(chunks).encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
        at = np.searchsorted(self.alphabet, flat)
        at[at == len(self.alphabet)] = 0
        code = np.where(self.alphabet[at] == flat, at, -1) if len(self.alphabet) else np.full(len(flat), -1)
        begin = np.cumsum(size) - size
        chars, local = np.unique(code, return_inverse=True)
        rows = self._rows_of(chars)
        table = None
        if rows is not None:
            local = rows[local]
            table = self.table.ravel() if self.table is not None else np.zeros_like(self.fail)
        best = np.full((longest + 1) * n, -np.inf)
        best[:n] = 0.0
        back = np.zeros((longest + 1, n), dtype=np.int32)  # trie node, or 0 for an unknown character
        state = np.zeros(n, dtype=np.int64)
        nodes = len(self.fail)
        for t in range(longest):
            a = int(np.searchsorted(size, t, side="right"))  # chunks from here on have a character t
            c = code[begin[a:] + t]
            if table is not None:
                s = table[local[begin[a:] + t] * nodes + state[a:]]
            else:
                s = np.zeros(n - a, dtype=np.int32)
                for x in np.unique(c[c >= 0]):
                    own = np.flatnonzero(c == x)
                    to = self._row(int(x))
                    s[own] = self.table[to][state[a:][own]]
            state[a:] = s
            row = best[(t + 1) * n + a : (t + 2) * n]
            link = back[t + 1, a:]
            lone = c < 0
            lone |= ~self.alone[c]
            u = np.flatnonzero(lone)
            if len(u):
                row[u] = best[t * n + a + u] + self.unk_score
            node = self.first_out[s]
            live = np.flatnonzero(node)
            node = node[live]
            offset = (t + 1) * n + a
            while len(live):
                value = best[live + (offset - self.depth[node].astype(np.int64) * n)] + self.score[node]
                up = value > row[live]
                won = live[up]
                row[won] = value[up]
                link[won] = node[up]
                node = self.below[node]
                on = node > 0
                live, node = live[on], node[on]
        where, live = size.copy(), np.arange(n)
        owner, ends, taken = [], [], []
        while len(live):
            node = back[where[live], live]
            owner.append(live)
            ends.append(where[live])
            taken.append(node)
            where[live] -= np.where(node > 0, self.depth[node], 1)
            live = live[where[live] > 0]
        chunk, end, node = (np.concatenate(x[::-1]) for x in (owner, ends, taken))
        order = np.argsort(chunk, kind="stable")  # steps were walked backwards, so reversed they run forwards
        chunk, end, piece = chunk[order], end[order], self.piece[node[order]]
        count = np.ones(len(piece), dtype=np.int64)
        unknown = np.flatnonzero(node[order] == 0)
        spelled = [[self.byte_ids[b] for b in chunks[k][e - 1].encode("utf-8")] for k, e in zip(chunk[unknown].tolist(), end[unknown].tolist(), strict=True)]
        count[unknown] = [len(x) for x in spelled]
        ids = np.repeat(piece, count)
        first = np.cumsum(count) - count
        for i, x in zip(first[unknown].tolist(), spelled, strict=True):
            ids[i : i + len(x)] = x
        return ids, np.bincount(chunk, weights=count, minlength=n).astype(np.int64)


class Decoder:
    """Ids back to text: the bytes of the pieces, without the blank put before the text."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        v = vocabulary
        self.bytes_of = [p.replace(MARK, " ").encode("utf-8") if v.normal[i] else b"" for i, p in enumerate(v.pieces)]
        for b, i in enumerate(v.byte_ids):
            self.bytes_of[i] = bytes([b])

    def decode(self, ids: list[int]) -> str:
        raw = b"".join([self.bytes_of[i] for i in ids])
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


def encode(docs: DataFrame, vocabulary: Vocabulary, column: str = "ids") -> DataFrame:
    """All columns of ``docs`` plus the piece ids of the whole text.

    A null text has null ids, an empty one none.  An input column called like the output is
    replaced.  Equal best scores go to the longer last piece.
    """
    return _coded(docs, vocabulary, column, None)


def encode_checked(docs: DataFrame, vocabulary: Vocabulary, column: str = "ids", check: str = "round_trip") -> DataFrame:
    """The same plus whether the ids decode to the text, which is true of null ids and texts."""
    return _coded(docs, vocabulary, column, check)


def _coded(docs: DataFrame, vocabulary: Vocabulary, column: str, check: str | None) -> DataFrame:
    """Only texts go to Python, only ids and the result of the check come back."""
    encoder, decoder = Encoder(vocabulary), Decoder(vocabulary)

    def run(text: pa.Array) -> pa.Array:
        ids, same = [], []
        for part in text_slices(iter([pa.RecordBatch.from_arrays([text], ["text"])]), "text", ENCODE_BYTES):
            texts = part.column("text").to_pylist()
            rows = encoder.encode_texts(texts)
            ids.append(pa.array(rows, pa.list_(pa.int32())))
            if check:
                same += [t is None or decoder.decode(r.tolist()) == t for t, r in zip(texts, rows, strict=True)]
        columns = [pa.concat_arrays([pa.array([], pa.list_(pa.int32())), *ids])]
        return pa.StructArray.from_arrays([*columns, pa.array(same, pa.bool_())] if check else columns, ["ids", "same"] if check else ["ids"])

    coded = F.arrow_udf(run, "ids array<int>, same boolean" if check else "ids array<int>")
    return with_fields(docs, coded(F.col("text")), {column: "ids"} | ({check: "same"} if check else {}))


def decode(encoded: DataFrame, vocabulary: Vocabulary, ids: str = "ids", column: str = "decoded") -> DataFrame:
    """All columns of ``encoded`` plus the text of its ids; null ids give a null text."""
    decoder = Decoder(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                texts = [None if x is None else decoder.decode(x) for x in (s.values.to_numpy().tolist() if s.is_valid else None for s in part.column(ids))]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [*part.schema.names, column])

    base = encoded.drop(column)
    return map_batches(base, run, StructType([*base.schema, StructField(column, StringType())]))
