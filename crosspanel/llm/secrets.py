"""Secret scan: fixed patterns, then credential-like tokens found by inferred grammars.

Base patterns find assignments, access keys and long hexadecimal runs.  Their values are the labelled
credentials.  A bounded sample of them forms a prefix tree over character classes for each kind, whose
states are merged when their outgoing frequencies agree (Hoeffding bound), which gives a
probabilistic automaton; one more is inferred from ordinary long tokens.  Every token of
16 characters or more is then scored by the difference of its log-likelihoods a character, the best
kind counting; the limit comes from ordinary tokens that were held out.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from crosspanel.llm.frames import map_batches, staged
from crosspanel.llm.textbytes import column_bytes, runs, text_slices

KINDS = ("assign", "access", "hex")
INFERRED = "inferred"
_ASSIGN = re.compile(
    r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
_WORDS = (b"passw", b"secret", b"token", b"api")
_UPPER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))

TOKEN_MIN = 16
#: Longest token whose format is learnt.
LEARNT_LENGTH = 512
PLAIN, END = "plain", "$"
CLASSES = "dhlHLs"
#: Shares of probability kept for what wasn't seen: credentials come in many more shapes than those labelled.
NOVEL_SECRET, NOVEL_PLAIN = 0.7, 0.001
_TOKEN = np.zeros(256, dtype=bool)
for _c in b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-":
    _TOKEN[_c] = True

Span = tuple[str, int, int]


def base_spans(text: str) -> list[tuple[str, int, int, str]]:
    """Matches of the fixed patterns as (kind, start, end, value), by start and then kind."""
    found = [("assign", m.start(), m.end(), m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [("access", m.start(), m.end(), m[0]) for m in _ACCESS.finditer(text) if len(m[0]) >= 16]
    found += [("hex", m.start(), m.end(), m[0]) for m in _HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def char_classes(token: str) -> str:
    """A token's format: digits, hexadecimal and other letters by case, symbols."""
    return "".join("d" if "0" <= c <= "9" else "h" if "a" <= c <= "f" else "l" if "g" <= c <= "z" else "H" if "A" <= c <= "F" else "L" if "G" <= c <= "Z" else "s" for c in token)


@dataclass(frozen=True)
class Automaton:
    """Deterministic probabilistic automaton; state 0 starts.

    A share ``novelty`` of every state's probability backs off to ``general``, the frequencies of
    all symbols mixed with equal ones, so a symbol that a state never met has its own price.
    The walk then goes on as if the word had begun with that symbol.
    """

    moves: list[dict[str, int]]
    log_move: list[dict[str, float]]
    log_end: list[float]
    log_general: dict[str, float]
    novelty: float

    def per_char(self, word: str) -> float:
        """Log-likelihood a character, the end counted as one."""
        state, total = 0, 0.0
        for c in word:
            move = self.moves[state].get(c)
            total += self.log_move[state][c] if move is not None else self.log_general[c]
            state = move if move is not None else self.moves[0].get(c, 0)
        return (total + self.log_end[state]) / (len(word) + 1)


def infer(words: Iterable[str], alpha: float = 0.05, novelty: float = 0.01) -> Automaton | None:
    """Merge statistically compatible states of the words' prefix tree (red-blue order)."""
    moves: list[dict[str, int]] = [{}]
    count, end = [0], [0]
    for w in sorted(words):
        at = 0
        count[0] += 1
        for c in w:
            if c not in moves[at]:
                moves[at][c] = len(moves)
                moves.append({})
                count.append(0)
                end.append(0)
            at = moves[at][c]
            count[at] += 1
        end[at] += 1
    if not count[0]:
        return None
    spread = math.sqrt(0.5 * math.log(2 / alpha))

    def differ(f1: int, n1: int, f2: int, n2: int) -> bool:
        return abs(f1 / n1 - f2 / n2) > spread * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))

    def compatible(p: int, q: int) -> bool:
        todo = [(p, q)]
        while todo:
            p, q = todo.pop()
            if differ(end[p], count[p], end[q], count[q]):
                return False
            for c in set(moves[p]) | set(moves[q]):
                a, b = moves[p].get(c), moves[q].get(c)
                if differ(count[a] if a is not None else 0, count[p], count[b] if b is not None else 0, count[q]):
                    return False
                if a is not None and b is not None and count[b] > 1:
                    todo.append((a, b))
        return True

    def fold(p: int, q: int) -> None:
        """Add the tree under q to p."""
        todo = [(p, q)]
        while todo:
            p, q = todo.pop()
            count[p] += count[q]
            end[p] += end[q]
            for c, b in moves[q].items():
                if c in moves[p]:
                    todo.append((moves[p][c], b))
                else:
                    moves[p][c] = b

    red = [0]
    seen = {0}
    while True:
        blue = [(p, c, q) for p in red for c, q in sorted(moves[p].items()) if q not in seen]
        if not blue:
            break
        p, c, q = max(blue, key=lambda x: (count[x[2]], -x[2]))
        into = next((r for r in red if compatible(r, q)), None)
        if into is None:
            red.append(q)
            seen.add(q)
        else:
            moves[p][c] = into
            fold(into, q)
    name = {s: i for i, s in enumerate(red)}
    # Frequencies of moves are counted again over the words, as merged states share counts.
    used = [dict.fromkeys(moves[s], 0) for s in red]
    ends, visits, every = [0] * len(red), [0] * len(red), Counter({END: 0})
    for w in words:
        at = 0
        for c in w:
            visits[at] += 1
            used[at][c] = used[at].get(c, 0) + 1
            at = name[moves[red[at]][c]]
        visits[at] += 1
        ends[at] += 1
        every.update(w)
        every[END] += 1
    symbols = {*CLASSES, *every}
    general = {c: 0.5 * every[c] / every.total() + 0.5 / len(symbols) for c in symbols}
    mixed = lambda n, v, c: math.log((1 - novelty) * n / v + novelty * general[c])
    return Automaton(
        [{c: name[q] for c, q in moves[s].items()} for s in red],
        [{c: mixed(n, v, c) for c, n in u.items()} for u, v in zip(used, visits, strict=True)],
        [mixed(e, v, END) for e, v in zip(ends, visits, strict=True)],
        {c: math.log(novelty * x) for c, x in general.items()},
        novelty,
    )


@dataclass(frozen=True)
class FormatModel:
    """A grammar per kind of credential, one of ordinary tokens, and the score from which a token counts.

    ``recall`` is the share of held-out labelled credentials above the limit and ``false_rate`` that of
    held-out ordinary tokens; both are null without such tokens.
    """

    secret: dict[str, Automaton]
    plain: Automaton | None
    limit: float
    recall: float | None = None
    false_rate: float | None = None

    def score_form(self, form: str) -> float:
        if not self.secret or self.plain is None:
            return -math.inf
        return max(a.per_char(form) for a in self.secret.values()) - self.plain.per_char(form)

    def score(self, token: str) -> float:
        return self.score_form(char_classes(token))

    def counts(self, token: str) -> bool:
        return self.score(token) > self.limit


def _scan(part: pa.RecordBatch) -> Iterator[tuple[int, str, list[tuple[str, int, int, str]], list[tuple[int, int]]]]:
    """Rows with a base span or a long token: index, text, base spans, other tokens."""
    data, starts, ends = column_bytes(part.column("text"))
    a, b = (int(starts[0]), int(ends.max())) if len(starts) else (0, 0)
    raw = data[a:b]
    token = _TOKEN[raw]
    inside = np.unique(starts[1:][(starts[1:] > a) & (starts[1:] < b)]) - a
    run_a, run_b = runs(token)
    crossed = inside[token[inside] & token[inside - 1]]  # a run over a row border is cut there
    cut, cut_end = np.sort(np.concatenate([run_a, crossed])), np.sort(np.concatenate([run_b, crossed]))
    long = cut_end - cut >= TOKEN_MIN
    cut, cut_end = cut[long] + a, cut_end[long] + a
    row_of = np.searchsorted(starts, cut, side="right") - 1
    by_row: dict[int, list[tuple[int, int]]] = {}
    for r, x, y in zip(row_of.tolist(), cut.tolist(), cut_end.tolist(), strict=True):
        by_row.setdefault(r, []).append((x, y))
    for i, (x, y) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
        if x == y:
            continue
        blob = data[x:y].tobytes()
        low = blob.translate(_UPPER)
        keyed = any(w in low for w in _WORDS) or b"AKIA" in blob
        if i not in by_row and not keyed:
            continue
        text = blob.decode("utf-8", "replace")
        base = base_spans(text)
        plain_ascii = len(text) == len(blob)
        tokens, before, chars = [], 0, 0
        for u, v in by_row.get(i, ()):
            if plain_ascii:
                at = u - x
            else:
                chars += len(blob[before : u - x].decode("utf-8", "replace"))
                before, at = u - x, chars
            end = at + v - u
            if not any(s < end and at < e for _, s, e, _ in base):
                tokens.append((at, end))
        yield i, text, base, tokens


def _samples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Formats of credentials by kind and of other tokens, each with a hash of the value, which itself stays."""
    for part in text_slices(batches, "text"):
        label, form = [], []
        for _, text, base, tokens in _scan(part):
            for kind, _, _, v in base:
                label.append(kind)
                form.append(v)
            for s, e in tokens:
                label.append(PLAIN)
                form.append(text[s:e])
        short = [(k, v) for k, v in zip(label, form, strict=True) if len(v) <= LEARNT_LENGTH]
        columns = [[k for k, _ in short], [char_classes(v) for _, v in short], [int.from_bytes(hashlib.blake2b(v.encode(), digest_size=8).digest(), "big", signed=True) for _, v in short]]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.string(), pa.string(), pa.int64()), strict=True)], ["label", "form", "h"])


def fit(docs: DataFrame, sample: int = 800, margin: float = 0.1, alpha: float = 0.05) -> FormatModel:
    """Infer the grammars from about ``sample`` distinct values of each kind and of other tokens.

    The sample holds values with a small hash remainder; tokens over ``LEARNT_LENGTH`` characters
    aren't learnt from, but scored as a whole.  One value in five is held out: the limit lies
    ``margin`` above the score that best parts held-out credentials from held-out ordinary tokens, the
    least of equally good ones and 0 at least.  Repeated tokens count once, equal hashes are one token.  Without credentials or
    without other tokens the model finds nothing beside the base patterns.
    """
    schema = StructType([StructField("label", StringType()), StructField("form", StringType()), StructField("h", LongType())])
    both = map_batches(docs.select("text").where("text IS NOT NULL"), _samples, schema)
    forms = staged(both.groupBy("label", "h").agg(F.min("form").alias("form")), "secret-formats")
    counts = staged(forms.groupBy("label").agg(F.count("*").alias("n")), "secret-counts")
    picked: dict[str, list[str]] = {}
    for r in forms.join(counts, "label").where(F.pmod("h", "n") < sample).orderBy("label", "h", "form").select("label", "form").collect():
        picked.setdefault(r.label, []).append(r.form)
    return learn(picked, margin, alpha)


def learn(picked: dict[str, list[str]], margin: float = 0.1, alpha: float = 0.05) -> FormatModel:
    """The model of a sample of formats by label; every fifth one is held out."""
    train = {k: [f for i, f in enumerate(v) if i % 5 != 4] for k, v in picked.items()}
    held = {k: v[4::5] or v for k, v in picked.items()}
    secret = {k: a for k in KINDS if (a := infer(train.get(k, []), alpha, NOVEL_SECRET)) is not None}
    model = FormatModel(secret, infer(train.get(PLAIN, []), alpha, NOVEL_PLAIN), 0.0)
    if not secret or model.plain is None:
        return model
    ordinary = [model.score_form(f) for f in held[PLAIN]]
    known = [model.score_form(f) for k in secret for f in held[k]]
    share = lambda scores, limit: sum(s > limit for s in scores) / len(scores)
    tried = [0.0, *(s for s in ordinary if s > 0)]
    limit = min(tried, key=lambda t: (share(ordinary, t) - share(known, t), t)) + margin
    return FormatModel(secret, model.plain, limit, share(known, limit), share(ordinary, limit))


_SPAN = StructType([StructField("kind", StringType()), StructField("start", IntegerType()), StructField("end", IntegerType())])


def find_secrets(docs: DataFrame, model: FormatModel, redact: bool = False, column: str = "secret_spans") -> DataFrame:
    """All columns of ``docs`` plus an array of (kind, start, end) in code points.

    Spans are sorted by start, then kind (base kinds first); a null or empty text has none.
    With ``redact`` the text's spans are replaced by ``<kind>``, overlapping ones as one.
    An input column called like the output is replaced.
    """
    base_docs = docs.drop(column)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    order = {k: i for i, k in enumerate((*KINDS, INFERRED))}

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "text"):
            spans: list[list[dict[str, object]]] = [[] for _ in range(part.num_rows)]
            changed: dict[int, str] = {}
            for i, text, base, tokens in _scan(part):
                found = [(k, s, e) for k, s, e, _ in base] + [(INFERRED, s, e) for s, e in tokens if model.counts(text[s:e])]
                found.sort(key=lambda x: (x[1], order[x[0]]))
                spans[i] = [{"kind": k, "start": s, "end": e} for k, s, e in found]
                if redact and found:
                    changed[i] = redacted(text, found)
            columns = list(part.columns)
            if changed:
                at = part.schema.names.index("text")
                columns[at] = pa.array([changed.get(i, v) for i, v in enumerate(columns[at].to_pylist())], columns[at].type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(spans, kind)], [*part.schema.names, column])

    return map_batches(base_docs, scan, StructType([*base_docs.schema, StructField(column, ArrayType(_SPAN))]))


def redacted(text: str, spans: list[Span]) -> str:
    out, at = [], 0
    for k, s, e in spans:
        if s >= at:
            out += [text[at:s], f"<{k}>"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def span_digests(found: DataFrame, column: str = "secret_spans") -> DataFrame:
    """Counts by kind, the digest of the base spans and all spans as text."""
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of = lambda k: F.filter(column, lambda s: s["kind"] == k)
    return found.select(
        "doc_id",
        *[F.size(of(k)).cast(LongType()).alias(f"n_{k}") for k in KINDS],
        F.sha2(joined(F.filter(column, lambda s: s["kind"] != INFERRED)).cast("binary"), 256).alias("base_sha256"),
        joined(F.col(column)).alias("spans"),
        F.size(of(INFERRED)).cast(LongType()).alias("n_inferred"),
    )
