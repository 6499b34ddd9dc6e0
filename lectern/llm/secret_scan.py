"""Secret scans: fixed patterns, and a linear-chain conditional random field.

Three patterns give base spans. The field tags the words of a text as a
secret's begin, its inside, or outside, from a word's shape, its neighbours and
features of the whole text, and is decoded by Viterbi; its spans are added
where they touch no base span. It is trained on a sample in which the base spans
are the labels, with the gradient of the exact likelihood. So that it learns
more than the patterns, each window with a secret is also shown without its key
word, without its sign, and with other values, none of which a pattern finds;
windows without secrets are taken where long numbers and addresses stand, and
are also shown with key words that no value follows.

A word whose score for outside exceeds its other scores by more than any
transitions can make up for is outside on the best path, whatever surrounds it.
So only the runs of other words are decoded, and the result is that of Viterbi
over the whole text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import bounded, extended, sliced, tidy, utf8

#: The base patterns and the least length of their match or, for assign, of group 2.
BASE = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]{24,}"), 0, 24),
)
KINDS = ("assign", "access", "hex", "field")
FIELD = "field"

#: Bounds of the training sample: documents looked at, one in so many of which gives a window without secrets, windows of a document, words of a window.
SAMPLE_DOCS = 20_000
CLEAN_SHARE = 16
DOC_WINDOWS = 4
WINDOW = 24
ROUNDS = 60
WORD_TABLE = 250_000

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_HINT = re.compile(rb"passw|pwd|secret|token|key|auth|bearer|credential|akia")
_SHAPE = bytes(
    ord("0") if 48 <= b <= 57 else ord("A") if 65 <= b <= 90 else ord("a") if 97 <= b <= 122 or b >= 128 else b for b in range(256)
)
B, I, O = 0, 1, 2  # noqa: E741


def base_spans(text: str) -> list[tuple[str, int, int]]:
    return [
        (kind, m.start(), m.end())
        for kind, pattern, group, least in BASE
        for m in pattern.finditer(text)
        if m.end(group) - m.start(group) >= least
    ]


def _runs(shape: bytes) -> str:
    out = []
    for c in shape.decode("latin-1"):
        if not out or out[-1] != c:
            out.append(c)
    return "".join(out[:7])


def _bucket(n: int) -> int:
    return next((k for k, most in enumerate((2, 4, 7, 11, 15, 19, 23, 31, 47)) if n <= most), 9)


def features(word: bytes, shape: bytes, hint: bytes) -> tuple[list[str], list[str], int]:
    """A word's own features, those it gives its neighbours, and its group for the text's features."""
    digits = shape.count(b"0")
    own = ["s" + _runs(shape), f"l{_bucket(len(word))}", "k" + hint.decode(), f"d{min(4, 5 * digits // len(word))}"]
    if digits:
        core = word.strip(b"\"'.,;:=()")
        hexa = not core.strip(b"0123456789abcdef")
        own += [f"x{hexa}{_bucket(len(core))}", f"u{_bucket(len(set(core)))}", f"c{(b'a' in shape) + 2 * (b'A' in shape)}"]
    ends = chr(word[-1]) if word[-1:] in b"=:\"'" else ""
    other = [f"h{hint.decode()}{ends}", f"e{ends}", f"n{_runs(shape)[:3]}"]
    return own, other, 0 if not digits else 1 if len(word) < 12 else 2


class Field:
    """Weights by feature name, and the words' scores that follow from them."""

    def __init__(self, weights: dict[str, tuple[float, float, float]], moves: np.ndarray):
        self.weights, self.moves = weights, moves
        two = moves[:, :2, None] + moves[None, :2, :]  # from, by way of a secret's tag, to
        straight = moves[:, O, None] + moves[O, None, :]
        self.slack = float((two - straight[:, None, :]).max()) + 1e-6
        self._reset()

    def _reset(self) -> None:
        self.words: dict[bytes, int] = {}
        self.shapes: dict[bytes, int] = {}
        self.rows = [[(0.0,) * 3] * 3 + [0]]
        self.tables: tuple[np.ndarray, ...] | None = None

    def _sum(self, names: list[str]) -> tuple[float, ...]:
        found = [self.weights[n] for n in names if n in self.weights]
        return tuple(map(sum, zip(*found, strict=True))) if found else (0.0, 0.0, 0.0)

    def word(self, w: bytes) -> int:
        """Number of a word's scores; words of one shape without digits and hints share it."""
        shape = w.translate(_SHAPE)
        hint = _HINT.search(w.lower())
        plain = hint is None and b"0" not in shape
        if plain and shape in self.shapes:
            at = self.shapes[shape]
        else:
            own, other, group = features(w, shape, hint[0] if hint else b"")
            self.rows.append([self._sum(own), self._sum(["p" + n for n in other]), self._sum(["q" + n for n in other]), group])
            self.tables = None
            at = len(self.rows) - 1
            if plain:
                self.shapes[shape] = at
        self.words[w] = at
        return at

    def decode(self, texts: list[str], kinds: list[int]) -> list[list[tuple[int, int]]]:
        """(first word, last word) of each tagged secret of each text; kinds: features of the texts."""
        return [[(first + a, first + z) for first, tags in runs for a, z in spans_of(tags)] for _, runs in self._decoded(texts, kinds)]

    def decode_tags(self, texts: list[str], kinds: list[int]) -> list[list[int]]:
        """The tag of every word."""
        out = []
        for n, runs in self._decoded(texts, kinds):
            tags = [O] * n
            for first, own in runs:
                tags[first : first + len(own)] = own
            out.append(tags)
        return out

    def _decoded(self, texts: list[str], kinds: list[int]) -> list[tuple[int, list[tuple[int, list[int]]]]]:
        """For each text the number of its words, and (first word, tags) of the runs that had to be decoded."""
        if len(self.words) > WORD_TABLE:
            self._reset()
        numbers, bounds = [0], []
        get, add = self.words.get, self.word
        for t in texts:
            a = len(numbers)
            for w in utf8(t).split():
                k = get(w)
                numbers.append(add(w) if k is None else k)
            bounds.append((a, len(numbers)))
            numbers.append(0)
        if self.tables is None:
            self.tables = tuple(np.array([r[k] for r in self.rows], dtype=np.float64) for k in range(3)) + (np.array([r[3] for r in self.rows]),)
        own, before, after, group = self.tables
        at = np.array(numbers)
        e = own[at]
        e[1:] += before[at[:-1]]
        e[:-1] += after[at[1:]]
        whole = np.array([[self._sum([f"t{kind}{g}"]) for g in range(3)] for kind in range(4)])
        of = np.repeat(np.array(kinds, dtype=np.int64), [z - a + 1 for a, z in bounds])
        e[1:] += whole[of, group[at[1:]]]
        open_ = e[:, O] - np.maximum(e[:, B], e[:, I]) <= self.slack
        open_[0] = False
        open_[[z for _, z in bounds]] = False
        out: list[tuple[int, list[tuple[int, list[int]]]]] = [(z - a, []) for a, z in bounds]
        spots = np.flatnonzero(open_)
        if len(spots):
            owner = np.searchsorted([z for _, z in bounds], spots)
            for run in np.split(np.arange(len(spots)), np.flatnonzero(np.diff(spots) > 1) + 1):
                doc = int(owner[run[0]])
                first = int(spots[run[0]])
                out[doc][1].append((first - bounds[doc][0], viterbi(e[first : first + len(run)], self.moves)))
        return out


def viterbi(e: np.ndarray, moves: np.ndarray) -> list[int]:
    """Best tags of a run whose neighbours on both sides are outside."""
    score, back = moves[O] + e[0], []
    for x in e[1:]:
        step = score[:, None] + moves
        back.append(step.argmax(axis=0))
        score = step.max(axis=0) + x
    tags = [int((score + moves[:, O]).argmax())]
    for b in reversed(back):
        tags.append(int(b[tags[-1]]))
    return tags[::-1]


def spans_of(tags: list[int]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for k, t in enumerate(tags):
        if t == I and out and out[-1][1] == k - 1:
            out[-1] = out[-1][0], k
        elif t != O:
            out.append((k, k))
    return out


def text_kind(text: str, has_base: bool) -> int:
    """Features of a whole text: whether a base pattern occurs, and whether it has markup of settings."""
    return int(has_base) + 2 * ("=" in text or "{" in text)


#: Characters of made-up values, and their shortest and longest length.
_ALPHABETS = ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-", "0123456789ABCDEF")
_VALUE = 16, 48
_KEYS = ("token", "password", "key", "secret", "auth", "credential")
_SIGN = re.compile(r"[:=]+")


def value(rng: np.random.Generator) -> str:
    """A random value that has a digit and a letter, and that no base pattern takes for hex."""
    letters = _ALPHABETS[rng.integers(len(_ALPHABETS))]
    drawn = [letters[k] for k in rng.integers(0, len(letters), rng.integers(*_VALUE))]
    return "".join(drawn[:-2] + ["7", "K"])


def variants(words: list[str], tags: list[int], rng: np.random.Generator) -> Iterator[tuple[list[str], list[int]]]:
    """A window as the patterns don't know it.

    With a secret: the value alone, and key word and value without a sign, each
    as it is or made up, and the whole with a value made up. Without: key words
    in place of plain ones.
    """
    plain = [w for w, t in zip(words, tags, strict=True) if t == O and w.isalpha()]
    if all(t == O for t in tags):
        out = list(words)
        for i in range(0, len(out) - 1, 5):
            if out[i].isalpha() and not re.search(r"[0-9]", out[i + 1]):
                out[i] = _KEYS[rng.integers(len(_KEYS))]
        yield out, tags
        return
    for drop_key, drop_sign, fresh in ((True, True, False), (True, True, True), (False, True, False), (False, True, True), (False, False, True)):
        out, own = [], []
        for w, t in zip(words, tags, strict=True):
            if t != O:
                core = w.strip("\"',;")
                if _SIGN.fullmatch(core):
                    if drop_sign:
                        continue
                elif re.search(r"[0-9]", core) and len(core) >= 12:
                    w = w.replace(core, value(rng)) if fresh else w
                elif drop_key:
                    w, t = plain[rng.integers(len(plain))] if plain else "of", O
            out.append(w)
            own.append(t)
        own = [B if t != O and (k == 0 or own[k - 1] == O) else t for k, t in enumerate(own)]
        if any(t != O for t in own):
            yield out, own


def _windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Training windows: words, tags and the text's kind."""
    for pdf in batches:
        rows = []
        for doc_id, text, h in zip(pdf["doc_id"], pdf["text"], pdf["h"], strict=True):
            spans = base_spans(text)
            if not spans and h % CLEAN_SHARE:
                continue
            words = list(_WORD.finditer(text))
            tags = np.full(len(words), O)
            starts, ends = [m.start() for m in words], [m.end() for m in words]
            centres = []
            for _, a, z in sorted(spans, key=lambda s: (s[1], -s[2])):
                i, j = int(np.searchsorted(ends, a, side="right")), int(np.searchsorted(starts, z))
                if (tags[i:j] == O).all():
                    tags[i:j] = I
                    tags[i] = B
                    centres.append(i)
            if not spans and words:
                numbers = [k for k, m in enumerate(words) if len(m[0]) >= 10 and re.search(r"[0-9]", m[0])]
                centres = [int(h // CLEAN_SHARE % len(words)), *numbers]
            centres = centres[:DOC_WINDOWS]
            for c in centres:
                a = max(0, c - WINDOW // 2)
                own = slice(a, a + WINDOW)
                shown, labels = [m[0] for m in words[own]], tags[own].tolist()
                rows.append((doc_id, a, shown, labels, text_kind(text, bool(spans))))
                rng = np.random.default_rng([h % (1 << 32), a])
                rows += [(doc_id, a, *v, text_kind(" ".join(v[0]), False)) for v in variants(shown, labels, rng)]
        yield pd.DataFrame(rows, columns=["doc_id", "start", "words", "tags", "kind"])


def train(windows: list[tuple[list[str], list[int], int]], rounds: int = ROUNDS, decay: float = 1e-4) -> Field:
    """Weights of greatest likelihood, by gradient steps with moments (Adam), for windows that start and end outside."""
    index: dict[str, int] = {}
    lists: list[list[int]] = []
    known: dict[tuple, int] = {}

    def numbered(names: list[str]) -> int:
        key = tuple(names)
        if key not in known:
            known[key] = len(lists)
            lists.append([index.setdefault(n, len(index)) for n in names])
        return known[key]

    n, width = len(windows), max(len(w) for w, _, _ in windows)
    parts = [np.full((n, width), -1) for _ in range(4)]
    tags = np.full((n, width), O)
    for k, (words, t, kind) in enumerate(windows):
        tags[k, : len(t)] = t
        found = [features(w := utf8(x), w.translate(_SHAPE), m[0] if (m := _HINT.search(w.lower())) else b"") for x in words]
        for i, (own, other, group) in enumerate(found):
            parts[0][k, i] = numbered(own)
            parts[3][k, i] = numbered([f"t{kind}{group}"])
            if i + 1 < len(words):
                parts[1][k, i + 1] = numbered(["p" + x for x in other])
            if i:
                parts[2][k, i - 1] = numbered(["q" + x for x in other])
    lengths = np.array([len(w) for w, _, _ in windows])
    live = np.arange(width)[None, :] < lengths[:, None]
    flat, sizes = np.concatenate([np.array(x) for x in lists]), np.array([len(x) for x in lists])
    starts = np.cumsum(sizes) - sizes
    w, moves = np.zeros((len(index), 3)), np.zeros((3, 3))
    state = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(moves), np.zeros_like(moves)]
    gold = np.eye(3)[tags] * live[:, :, None]
    before = np.concatenate([np.full((n, 1), O), tags[:, :-1]], axis=1)
    pairs = np.zeros((3, 3))
    np.add.at(pairs, (before[live], tags[live]), 1.0)
    np.add.at(pairs, (tags[np.arange(n), lengths - 1], O), 1.0)
    for step in range(1, rounds + 1):
        sums = np.concatenate([np.add.reduceat(w[flat], starts, axis=0), np.zeros((1, 3))])
        e = sum(sums[p] for p in parts)
        alpha, beta = np.zeros((n, width, 3)), np.zeros((n, width, 3))
        alpha[:, 0] = moves[O] + e[:, 0]
        for i in range(1, width):
            x = alpha[:, i - 1, :, None] + moves
            alpha[:, i] = np.where(live[:, i, None], np.logaddexp.reduce(x, axis=1) + e[:, i], alpha[:, i - 1])
        beta[:, -1] = moves[:, O]
        for i in range(width - 2, -1, -1):
            x = moves[None] + (e[:, i + 1] + beta[:, i + 1])[:, None, :]
            beta[:, i] = np.where(live[:, i + 1, None], np.logaddexp.reduce(x, axis=2), moves[:, O])
        z = np.logaddexp.reduce(alpha[:, -1] + moves[:, O], axis=1)
        p = np.exp(alpha + beta - z[:, None, None]) * live[:, :, None]
        x = alpha[:, :-1, :, None] + moves + (e + beta)[:, 1:, None, :] - z[:, None, None, None]
        expected = (np.exp(x) * live[:, 1:, None, None]).sum(axis=(0, 1))
        expected[O] += p[:, 0].sum(axis=0)
        expected[:, O] += p[np.arange(n), lengths - 1].sum(axis=0)
        delta = (p - gold).reshape(-1, 3)
        by_list = np.zeros((len(lists), 3))
        for part in parts:
            at = part.reshape(-1)
            np.add.at(by_list, at[at >= 0], delta[at >= 0])
        grad = np.zeros_like(w)
        np.add.at(grad, flat, np.repeat(by_list, sizes, axis=0))
        for value, g, m, v in ((w, grad / n + decay * w, *state[:2]), (moves, (expected - pairs) / n + decay * moves, *state[2:])):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            value -= 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Field({name: tuple(w[k].tolist()) for name, k in index.items()}, moves)


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Field | None:
    """A field trained on the windows of about sample_docs documents; None if they hold no base span."""
    total = docs.count()
    share = min(1.0, sample_docs / max(1, total))
    h = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 40))
    picked = docs.select("doc_id", "text", h.alias("h")).where(F.col("text").isNotNull() & (F.col("h") < int(share * (1 << 40))))
    rows = bounded(picked).mapInPandas(_windows, "doc_id long, start int, words array<string>, tags array<int>, kind int").collect()
    rows.sort(key=lambda r: (r.doc_id is None, r.doc_id, r.start, r.words))
    windows = [(r.words, r.tags, r.kind) for r in rows if r.words]
    return train(windows) if any(t != O for _, tags, _ in windows for t in tags) else None


def find_secrets(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """doc_id and spans (array of kind, start, end) of each row of docs (doc_id, text; other columns are ignored).

    Offsets are in code points, ends exclusive; spans are in order of start,
    then of kind: assign, access, hex, field. Base spans of different kinds may
    overlap; spans of the field touch no base span, and none are given without a
    field. A null or empty text has no spans.
    """
    shared = docs.sparkSession.sparkContext.broadcast((field.weights, field.moves) if field else None)

    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Field(*shared.value) if shared.value else None
        for part, texts in sliced(batches):
            texts = [t or "" for t in texts]
            found = [base_spans(t) for t in texts]
            if own:
                kinds = [text_kind(t, bool(s)) for t, s in zip(texts, found, strict=True)]
                for t, spans, tagged in zip(texts, found, own.decode(texts, kinds), strict=True):
                    if not tagged:
                        continue
                    words, base = [m.span() for m in _WORD.finditer(t)], list(spans)
                    for i, j in tagged:
                        start, end = words[i][0], words[j][1]
                        if all(end <= x or y <= start for _, x, y in base):
                            spans.append((FIELD, start, end))
            for spans in found:
                spans.sort(key=lambda s: (s[1], KINDS.index(s[0])))
            rows = [[{"kind": k, "start": s, "end": e} for k, s, e in spans] for spans in found]
            yield extended(part, ["doc_id"], spans=pa.array(rows, kind))

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return bounded(docs).mapInArrow(tidy(run), "doc_id long, spans array<struct<kind:string,start:int,end:int>>")


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans (text) of what find_secrets() returns."""

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def counted(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [counted(k) for k in KINDS[:3]]
    base = joined(F.filter("spans", lambda s: s["kind"] != FIELD))
    return found.select("doc_id", *counts, F.sha2(base.cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def scan(docs: DataFrame) -> DataFrame:
    """digest() of find_secrets() with a field fitted on the same docs."""
    return digest(find_secrets(docs, fit(docs)))
