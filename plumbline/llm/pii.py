"""Personal data in text: fixed patterns, and a linear-chain conditional random field over word shapes.

The patterns give the base spans. The field adds spans that the patterns miss (a card number with a
mistyped digit, an obfuscated address, a credential); it never takes a base span away. It is trained
from a small labelled table that `training_rows` writes out from templates, and decoded by Viterbi in
numpy batches over all tokens of every text. Long chains are decoded in overlapping pieces, and each span
is taken from the piece in whose core it begins.
"""

from __future__ import annotations

import bisect
import functools
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import mapped, release, slices, table

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret")
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))

# ---- base patterns

# A match of the address pattern is the run of local characters before an at sign, the sign and the
# domain after it: searching from the sign keeps the search linear in the text's length.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?+[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = int(d) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def _byte(digits: str) -> bool:
    """At most 255, however many zeros there are before it."""
    digits = digits.lstrip("0")
    return len(digits) < 3 or (len(digits) == 3 and digits <= "255")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the fixed patterns, by kind as BASE lists them, then start."""
    if not text:
        return []
    found = [("email", a, b) for a, b in _emails(text)]
    if not _DIGIT.search(text):
        return found
    found += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(_byte(p) for p in m.group().split("."))]
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
            found.append(("phone", m.start(), m.end()))
    return found


# ---- tokens and their features

#: A run of sixteen hexadecimal digits or more that holds a letter and a digit is one token.
_TOKEN = re.compile(r"((?=[0-9]*+[A-Fa-f])(?=[A-Fa-f]*+[0-9])[0-9A-Fa-f]{16,}+|[^\W\d_]+|[0-9]+|\S)")
#: Words next to which a number may be personal data; anything else is seen by its shape only.
_CUES = frozenset("at dot token key secret password card visa mastercard phone tel call fax mail email ip host address version cc by license public gnu page".split())


def _length(n: int) -> str:
    return str(n) if n <= 4 else "5-8" if n <= 8 else "9-12" if n <= 12 else "13-19" if n <= 19 else "20+"


#: Shapes by number; the first two stand for the begin and the end of a text.
_LENGTHS = ("1", "2", "3", "4", "5-8", "9-12", "13-19", "20+")
_SHAPES = ["begin", "end", "other", *(f"9x{n}" for n in _LENGTHS), *(f"{x}{y}" for x in ("x", "X", "Xx") for y in ("", "+")), *(f"hex{n}" for n in _LENGTHS), *sorted(_CUES), *(chr(c) for c in range(33, 127) if not chr(c).isalnum())]
_NUMBER = {shape: n for n, shape in enumerate(_SHAPES)}
BEGIN, END, ROOM = 0, 1, 128
#: Tokens whose shape is kept for the next time.
_KEPT_TOKENS = 200_000


def _shape(token: str) -> str:
    if len(token) >= 16 and token.isascii() and token.isalnum() and not token.isalpha() and not token.isdigit():
        return f"hex{_length(len(token))}"
    if token[0].isdigit():
        return f"9x{_length(len(token))}"
    if token[0].isalpha():
        low = token.lower()
        return low if low in _CUES else ("x" if token.islower() else "X" if token.isupper() else "Xx") + ("" if len(token) < 16 else "+")
    return token if token in _NUMBER else "other"


class _ShapeNumbers(dict):
    """The number of a token's shape, kept once it is known."""

    def __missing__(self, token: str) -> int:
        if len(self) > _KEPT_TOKENS:
            self.clear()
        return self.setdefault(token, _NUMBER[_shape(token)])


_shape_number = _ShapeNumbers().__getitem__


class Tokens:
    """The tokens of a text: where they begin and end, and the numbers of their shapes; a long run of hexadecimal digits and letters is one token."""

    def __init__(self, text: str) -> None:
        parts = _TOKEN.split(text)  # what stands before each token, and the token
        ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))
        self.start, self.end = ends[:-1:2], ends[1::2]
        self.shape = np.fromiter(map(_shape_number, parts[1::2]), np.int64, len(parts) // 2)

    def __len__(self) -> int:
        return len(self.start)


def _features(chains: list[Tokens]) -> np.ndarray:
    """The features of all tokens of some chains, one after the other: numbers of a template, shapes around the token and glue."""
    edge = lambda n: np.full(2, n, np.int64)
    shape = np.concatenate([x for c in chains for x in (edge(BEGIN), c.shape, edge(END))] or [edge(BEGIN)])
    none = np.zeros(2, np.int64)
    gap = np.concatenate([x for c in chains for x in (none, np.concatenate([[0], 1 + (c.end[:-1] < c.start[1:])])[: len(c)], none)] or [none])
    inside = np.concatenate([np.arange(len(c)) + at for c, at in zip(chains, np.cumsum([2, *(len(c) + 4 for c in chains)]))] or [none[:0]]).astype(np.int64)
    s = lambda k: shape[inside + k]
    left, right = gap[inside], gap[np.minimum(inside + 1, len(gap) - 1)]
    parts = [
        (s(0),), (left, s(-1)), (right, s(1)), (s(-2),), (s(2),),
        (s(-1), left, s(0)), (s(0), right, s(1)), (s(-2), s(-1), left, s(0)), (s(0), right, s(1), s(2)),
    ]
    out = np.empty((len(inside), len(parts)), np.int64)
    for k, part in enumerate(parts):
        number = np.full(len(inside), k, np.int64)
        for x in part:
            number = number * ROOM + x
        out[:, k] = number
    return out


# ---- the labelled table

_WORDS = "the of and to in with for on that this der die und von le la des que el los de sun quick river report order room call about from".split()


def training_rows(n: int = 420, seed: int = 11) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """The labelled table: n short texts and their (kind, start, end) spans, the same for the same seed."""
    r = random.Random(seed)
    digits = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: r.choice(_WORDS).capitalize() if r.random() < 0.15 else r.choice(_WORDS)
    name = lambda: "".join(r.choice("abcdehilmnorstu") for _ in range(r.randint(2, 9)))

    def personal() -> tuple[str, str]:
        kind = r.choice(KINDS)
        if kind == "email":
            local = r.choice([name(), f"{name()}.{name()}", f"{name()}.{digits(2)}", f"{name()}{digits(1)}"])
            host = r.choice([f"mail{digits(1)}.example.com", f"{name()}.org", f"{name()}.co.uk"])
            return kind, r.choice([f"{local}@{host}", f"{local} at {name()} dot {r.choice(['com', 'org', 'net'])}", f"{local} at {name()}{digits(1)} dot com", f"{local} [at] {name()}{digits(1)} [dot] org", f"{local} @ {host}"])
        if kind == "ip":
            parts = [str(r.randint(1, 255)) for _ in range(4)]
            return kind, r.choice([".".join(parts), ".".join(parts), "[.]".join(parts), " . ".join(parts)])
        if kind == "card":
            return kind, r.choice([digits(16), digits(16), " ".join(digits(4) for _ in range(4)), "-".join(digits(4) for _ in range(4)), digits(15)])
        if kind == "phone":
            a, b, c = digits(3), digits(3), digits(4)
            return kind, r.choice([f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+{digits(2)} {digits(2)} {digits(4)} {digits(4)}", f"+{digits(11)}"])
        return kind, "".join(r.choice("0123456789abcdef") for _ in range(r.choice([32, 40, 40])))

    def plain() -> str:
        return r.choice([
            f"version {digits(1)}.", f"CC BY-NC {digits(1)}.{digits(1)}.", f"page {digits(2)}", f"{digits(4)}", f"{digits(1)}.{digits(1)}.{digits(1)}",
            f"{digits(2)},{digits(3)}", f"{digits(2)}:{digits(2)}", f"{digits(3)} km", f"{r.randint(1900, 2030)}-{digits(2)}-{digits(2)}", f"item{digits(1)}",
            f"${digits(2)}.{digits(2)}", f"{digits(2)}%", f"@{name()}", f"at {digits(1)} {word()}", f"at {word()} {word()}", f"at {word()}. {word()}", f"{word()} at {name()} {word()}",
        ])

    rows = []
    for _ in range(n):
        text, spans = "", []
        for _ in range(r.randint(1, 3)):
            text += " ".join(word() for _ in range(r.randint(2, 6))) + r.choice([" ", " ", ". ", ", ", "\n", " | ", "*** "])
            if r.random() < 0.6:
                kind, value = personal()
                text += 'token = "' if kind == "secret" and r.random() < 0.7 else r.choice(["", "", f"{r.choice(['call', 'card', 'mail', 'ip', 'tel'])}: "])
                spans.append((kind, len(text), len(text) + len(value)))
                text += value + r.choice([" ", " ", " ", ". ", "!! ", '" ', "*** "])
            else:
                text += plain() + " "
        rows.append((text + word(), spans))
    return rows


# ---- the field

_PAIRS = len(LABELS)


#: Tokens of a piece's core, and those read on either side of it; pieces that are decoded together.
CORE, MARGIN, TOGETHER = 192, 32, 512


class Field:
    """features: known features, ascending; weights: by feature (and a last one for unknown ones) and label; moves: label by next label; first: of a chain's first label."""

    def __init__(self, features: np.ndarray, weights: np.ndarray, moves: np.ndarray, first: np.ndarray) -> None:
        self.features = features
        self.weights, self.moves, self.first = (x.astype(np.float32) for x in (weights, moves, first))

    def emissions(self, chains: list[Tokens]) -> np.ndarray:
        """Scores of the labels of all tokens of the chains, one after the other."""
        total = 0
        for column in _features(chains).T:
            at = np.minimum(np.searchsorted(self.features, column), len(self.features) - 1)
            total = total + self.weights[np.where(self.features[at] == column, at, len(self.features))]
        return total

    def paths(self, emit: np.ndarray, begins: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Best labels of runs of tokens of `emit`, a row each, by Viterbi; a run at a text's begin has -1 minus its begin. Lengths ascend."""
        at = np.where(begins < 0, -1 - begins, begins)
        longest = int(length.max())
        rows = at[:, None] + np.minimum(np.arange(longest), length[:, None] - 1)
        scores = emit[rows]
        scores[:, 0] += np.where((begins < 0)[:, None], self.first, np.float32(0))
        for t in range(1, longest):  # scores: from here on, of the best labelling up to a token and with its label
            before, some = scores[:, t - 1], int(np.searchsorted(length, t, side="right"))  # the runs are in order of length
            best = before[some:, :1] + self.moves[0]
            for label in range(1, _PAIRS):
                np.maximum(best, before[some:, label : label + 1] + self.moves[label], out=best)
            scores[some:, t] += best
            scores[:some, t] = before[:some]
        label = scores[:, -1].argmax(axis=1)
        out = np.zeros(rows.shape, np.int8)
        for t in range(longest - 1, -1, -1):
            out[:, t] = label
            if t:
                label = np.where(t < length, (scores[:, t - 1] + self.moves.T[label]).argmax(axis=1), label)
        return out

    def decode(self, chains: list[Tokens]) -> list[list[tuple[str, int, int]]]:
        """Best labelling of each chain as (kind, start, end)."""
        out: list[list[tuple[str, int, int]]] = [[] for _ in chains]
        emit = self.emissions(chains)
        pieces, place = [], 0  # of a chain: where it begins; its piece's first token, core's begin and end, and end
        for k, c in enumerate(chains):
            for low in range(0, len(c), CORE):
                pieces.append((k, place, max(0, low - MARGIN), low, min(len(c), low + CORE), min(len(c), low + CORE + MARGIN)))
            place += len(c)
        pieces.sort(key=lambda p: p[5] - p[2])
        for at in range(0, len(pieces), TOGETHER):
            some = pieces[at : at + TOGETHER]
            begins = np.asarray([-1 - p[1] if p[2] == 0 else p[1] + p[2] for p in some])
            paths = self.paths(emit, begins, np.asarray([p[5] - p[2] for p in some]))
            for row in np.flatnonzero(paths.any(axis=1)):
                k, _, first, low, high, last = some[row]
                out[k] += _spans(chains[k], paths[row, : last - first], first, low, high)
        return [sorted(x, key=lambda span: span[1]) for x in out]


def _spans(toks: Tokens, path: np.ndarray, first: int, low: int, high: int) -> list[tuple[str, int, int]]:
    """Spans of a path from the token `first` on that begin in low .. high."""
    found: list[tuple[str, int, int]] = []
    inside, last = 0, -1
    for t in np.flatnonzero(path).tolist():
        p, token = int(path[t]), first + t
        if p % 2 == 0 and inside == p - 1 and last == t - 1:
            last = t
            if found and found[-1][0] == "":
                continue
            found[-1] = (found[-1][0], found[-1][1], int(toks.end[token]))
        elif p % 2 == 1:
            inside, last = p, t
            found.append((KINDS[p // 2] if low <= token < high else "", int(toks.start[token]), int(toks.end[token])))
        else:
            inside = 0
    return [f for f in found if f[0]]


def train(rows: list[tuple[str, list[tuple[str, int, int]]]], rounds: int = 120, ridge: float = 1e-3) -> Field:
    """Maximum conditional likelihood by gradient ascent; expectations by forward-backward over one padded batch."""
    toks = [Tokens(text) for text, _ in rows]
    known, flat = np.unique(_features(toks), return_inverse=True)
    flat = flat.reshape(-1, _features(toks[:1]).shape[1])
    n, longest, width = len(rows), max(map(len, toks)), flat.shape[1]
    ids, gold, real = np.full((n, longest, width), len(known)), np.zeros((n, longest), int), np.zeros((n, longest), bool)
    place = 0
    for k, (c, (_, spans)) in enumerate(zip(toks, rows)):
        ids[k, : len(c)], real[k, : len(c)] = flat[place : place + len(c)], True
        gold[k, : len(c)] = [next((1 + 2 * KINDS.index(kind) + (s > a) for kind, a, b in spans if a <= s < b), 0) for s in c.start.tolist()]
        place += len(c)
    one_hot = np.eye(_PAIRS)[gold] * real[..., None]
    both = real[:, 1:] & real[:, :-1]
    seen_moves = np.einsum("nti,ntj->ij", one_hot[:, :-1] * both[..., None], one_hot[:, 1:])
    params = [np.zeros((len(known) + 1, _PAIRS)), np.zeros((_PAIRS, _PAIRS)), np.zeros(_PAIRS)]
    state = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    order = np.argsort(ids.ravel(), kind="stable")
    starts = np.searchsorted(ids.ravel()[order], np.arange(len(known) + 1))

    for step in range(1, rounds + 1):
        weights, moves, first = params
        emit = weights[ids].sum(axis=2)
        # forward and backward in shares of each token's total
        odds, go = np.exp(emit - emit.max(axis=2, keepdims=True)), np.exp(moves - moves.max())
        share = lambda x: x / x.sum(axis=-1, keepdims=True)
        alpha, beta = np.empty(emit.shape), np.ones(emit.shape)
        alpha[:, 0] = share(odds[:, 0] * np.exp(first - first.max()))
        for t in range(1, longest):
            alpha[:, t] = np.where(real[:, t, None], share(alpha[:, t - 1] @ go * odds[:, t]), alpha[:, t - 1])
        for t in range(longest - 2, -1, -1):
            beta[:, t] = np.where(real[:, t + 1, None], share(odds[:, t + 1] * beta[:, t + 1] @ go.T), 1)
        gap = one_hot - share(alpha * beta) * real[..., None]
        after = (odds * beta)[:, 1:] * both[..., None]
        total = ((alpha[:, :-1] @ go) * after).sum(axis=2, keepdims=True)
        pair = go * np.einsum("nti,ntj->ij", alpha[:, :-1] / np.where(total > 0, total, 1), after, optimize=True)
        up = np.add.reduceat(gap.reshape(-1, _PAIRS)[order // width], starts, axis=0)
        up[-1] = 0
        for p, g, (m, v) in zip(params, (up, seen_moves - pair, gap[:, 0].sum(axis=0)), state):
            g = g / n - ridge * p
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p += 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Field(known, *params)


@functools.cache
def default_field() -> Field:
    return train(training_rows())


# ---- whole texts

#: Text bytes that are decoded together.
DECODE_BYTES = 1 << 20


def _plausible(kind: str, value: str) -> bool:
    digits = sum(c.isdigit() for c in value)
    if kind == "email":  # no address is longer
        return len(value) <= 254 and ("@" in value or " at " in value or "[at]" in value)
    return {"ip": 4 <= digits <= 12, "card": 13 <= digits <= 19, "phone": 9 <= digits <= 15, "secret": len(value) >= 16}[kind]


Spans = list[tuple[str, int, int]]


def all_spans(texts: list[str | None], field: Field) -> tuple[list[Spans], list[Spans]]:
    """Base spans of each text, and those with the field's further ones, by kind as KINDS lists them, then start.

    A further span never overlaps a base span or another further one.
    """
    base = [base_spans(t) for t in texts]
    out = []
    for text, spans, more in zip(texts, base, field.decode([Tokens(t or "") for t in texts])):
        if more:  # tokens are disjoint, so only base spans can be in the way
            starts, ends = _union(spans)
            free = lambda a, b: not (before := bisect.bisect_left(starts, b)) or ends[before - 1] <= a  # noqa: E731, B023
            spans = sorted([*spans, *(x for x in more if free(*x[1:]) and _plausible(x[0], text[x[1] : x[2]]))], key=lambda x: (KINDS.index(x[0]), x[1]))
        out.append(spans)
    return base, out


def _union(spans: list[tuple[str, int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the disjoint intervals that the spans cover."""
    starts: list[int] = []
    ends: list[int] = []
    for a, b in sorted((a, b) for _, a, b in spans):
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find(docs: DataFrame) -> DataFrame:
    """doc_id, the base spans and all spans of every text as kind:start:end, comma-joined; none for a null text.

    Positions count code points, ends exclusive. Rows of equal id are documents of their own. The model is
    trained once on the driver from the built-in labelled table and has a fixed size.
    """
    field = default_field()

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, DECODE_BYTES):
                base, spans = all_spans(part.column(1).to_pylist(), field)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(_joined, base), pa.string()), pa.array(map(_joined, spans), pa.string())], names=["doc_id", "base", "spans"])
        release()

    return docs.select("doc_id", "text").mapInArrow(found, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, base string, spans string")


def redact_text(text: str | None, field: Field) -> str | None:
    """The text with each span replaced by its kind in angle brackets; overlapping spans become one mark."""
    return _redacted(text, all_spans([text], field)[1][0])


def _redacted(text: str | None, spans: list[tuple[str, int, int]]) -> str | None:
    if not spans:
        return text
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda x: x[1:]):
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame) -> DataFrame:
    """The same rows and columns with personal data in `text` masked; `n_chars`, if a whole number, follows the new text.

    Rows whose text has no span, or is null, come back as they are.
    """
    field, names = default_field(), docs.columns
    at, chars = names.index("text"), names.index("n_chars") if "n_chars" in names else -1
    counted = chars >= 0 and docs.schema["n_chars"].dataType.simpleString() in ("int", "bigint")

    def masked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, at, DECODE_BYTES):
                texts, columns = part.column(at).to_pylist(), part.columns
                _, spans = all_spans(texts, field)
                new = [_redacted(t, s) for t, s in zip(texts, spans)]
                columns[at] = pa.array(new, columns[at].type)
                if counted:
                    old = part.column(chars).to_pylist()
                    columns[chars] = pa.array([len(t) if s else n for t, s, n in zip(new, spans, old)], columns[chars].type)
                yield pa.RecordBatch.from_arrays(columns, names=part.schema.names)
        release()

    return mapped(docs, masked)


def op2_pii(spark, sf_dir):
    base = F.col("base")
    count = lambda kind: (F.size(F.split(base, f"(^|,){kind}:")) - 1).cast("long").alias(f"n_{kind}")
    return find(table(spark, sf_dir, "documents")).select("doc_id", *(count(k) for k in BASE), F.sha2(base, 256).alias("base_sha256"), "spans")
