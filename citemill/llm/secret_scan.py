"""Secret scan: fixed patterns, and a linear-chain conditional random field over words.

*Base* spans are the leftmost non-overlapping matches of three kinds, ``assign``, ``access`` and ``hex``.
The *method* adds spans of kind ``crf``: words (runs of non-blanks) are tagged begin, inside or outside a
secret from their shape, the neighbouring words and features of the whole text; Viterbi finds the
best tags. An added span that overlaps a base span is left out; base spans always stay.

Training: the field learns from windows of ``WIDTH`` words of a bounded sample, the ``sample_docs`` documents first in hash order: windows around base
spans, and windows of plain text into which a phrase is set. Half of these phrases hold a secret that no fixed pattern finds: the value of a base span, or
one drawn by hash, written otherwise (``FORMS``: key word and value apart, other separators, prefixes, dotted and mixed-case values); the
other half look like one and are none (``DECOYS``: addresses, numbers, names, key words before plain words). At most ``sample_windows`` are kept. The fit is
full-batch gradient ascent with exact forward-backward sums, so it is deterministic for the same input.
Tagging covers every word of every text: a word whose best gain over "outside" is below zero, with the largest gain
any pair of transitions could add, is outside in the best path for certain; the rest falls into short runs between such
words, and Viterbi runs on these. That gives the same tags as Viterbi over the whole text.

Defined cases: null and empty texts have no spans. Rows are judged alone, so repeated rows get equal results. With an
empty table the field adds nothing.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citemill.llm.common import binary_rows, text_of
from citemill.session import discard, store

KINDS = ("assign", "access", "hex", "crf")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ACCESS, _HEX = re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]{24,}")
_KEYWORD = re.compile(r"pass|pwd|secret|token|key|credential|bearer|private|auth|login", re.IGNORECASE)
_WORD, _RUNS = re.compile(r"\S+"), re.compile(r"(.)\1+")
_CLASSES = {ord(c): "a" for c in "abcdefghijklmnopqrstuvwxyz"} | {ord(c): "A" for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"} | {ord(c): "0" for c in "0123456789"}
_CHANGES = re.compile(r"a(?=[A0])|A(?=[0])|A(?=a.*A)|0(?=[aA])")
_PREFIX = re.compile(r"[A-Za-z]{2,6}[_-](?=[A-Za-z0-9]*\d)[A-Za-z0-9]{12,}|eyJ")
_PURE = re.compile(r"[\"'(<\[]?(?:[^\W\d_]+(?:[-'’][^\W\d_]+)*|[\d.,:/-]+)[.,;:!?\"')>\]]*")
NEAR = "near"
_EDGES = "\"'`,;.()[]{}<>"
O, B, I = 0, 1, 2  # noqa: E741
BASE62 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
#: How a secret may stand in text without matching a fixed pattern; {v} is its value, {w} a plain word. The word with the value is the secret.
FORMS = (
    "Authorization Bearer {jwt}", "the password is {mixed}", "{w} password was {mixed}", "DB_PASS {mixed}", "ROOT_PWD {value}", "credential {value}", "credentials {w} {mixed}", "ghp_{base36}", "sk-{base48}",
    "xoxb-{digits}-{base24}", "private key {base44}", "login {w} {mixed}", "auth {base24}", "pwd {mixed}", "API key {base36}", "secret -> {value}", "token {base48}", "AccessKey {base44}",
    "<password>{mixed}</password>", "export AUTH_TOKEN {base36}", "bearer {base48}", "{jwt}", "{base48}",
)
#: What looks like one and is none.
DECOYS = (
    "https://{w}.example.com/{w}/{digits}?id={digits}", "www.{w}.org/{w}-{w}", "{w}.{w}@example.com", "+49 {digits} {digits}", "{digits}-{digits}", "2024-05-{two}", "the secret {w} {w}", "token {w} is",
    "a password {w} by", "key {w} of", "private {w} and", "credential {w}", "{w}_{w}_{two}", "{Camel}{Camel}", "v{two}.{two}.1", "/usr/{w}/{w}.txt", "{W}-{two}", "login {w}", "[{two}]", "{digits},{two}", "{w}/{w}", "#{digits}", "{w}{two}",
    "password: {w}", "ISBN {digits}-{two}-{digits}", "{W}", "author {w}", "passed {w} {digits}",
)
WIDTH, SAMPLE_DOCS, SAMPLE_WINDOWS = 24, 2000, 4000


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) in code points, by start and then kind."""
    found = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


_plain: dict[tuple, tuple[str, ...]] = {}


def word_features(word: str) -> tuple[str, ...]:
    """Shape of a word; the same for many words, and from a bounded set."""
    body = word[:-1] if word[-1] in ".,;:!?" else word
    if len(body) < 16 and body.isascii() and body.isalpha() and (body.islower() or body.istitle()):
        # all that the features of such a word depend on
        key = (body.islower(), len(body), word[len(body) :], len(set(word)), bool(_KEYWORD.search(body)))
        if key not in _plain:
            _plain[key] = _features(word)
        return _plain[key]
    return _features(word)


def _features(word: str) -> tuple[str, ...]:
    shape = _RUNS.sub(r"\1", word.translate(_CLASSES))
    shape = re.sub(r"[^aA0=:\"'_+/.-]+", "*", shape)
    digits = sum(c.isdigit() for c in word)
    mixed = any(c.isupper() for c in word[1:]) and any(c.islower() for c in word)
    return (
        "s" + (shape if len(shape) <= 6 else shape[:5] + "~"), f"l{min(len(word), 40) // 4}", f"d{4 * digits // len(word)}",
        f"m{int(mixed)}{int(0 < digits < len(word))}{int(len(word) >= 12)}", f"k{int(bool(_KEYWORD.search(word)))}", "e" + (word[-1] if word[-1] in "=:\"'" else "-"),
        f"q{int(bool(re.search('[=:]', word[1:-1])))}", f"h{int(bool(re.search('[0-9a-f]{16,}', word)))}{int(word.isascii())}",
        f"t{min(9, len(_CHANGES.findall(word.translate(_CLASSES))))}", f"u{min(40, len(set(word))) // 4}", f"w{int('://' in word or '@' in word[1:])}{int(word[:4].lower() == 'www.')}",
        f"x{int(bool(_PREFIX.match(word)))}{int(word.count('.') == 2 and len(word) > 40)}", f"z{int(bool(_PURE.fullmatch(word)))}",
    )


def neighbour_features(features: tuple[str, ...], side: str) -> tuple[str, ...]:
    """What a word tells its neighbour: the start of its shape, keyword, last mark."""
    return (side + features[0][:3], side + features[4] + features[5], side + features[2])


def is_keyword(features: tuple[str, ...]) -> bool:
    return features[4] == "k1"


def file_features(text: str) -> tuple[str, ...]:
    n = max(1, len(text))
    digits, marks = sum(map(text.count, "0123456789")), sum(map(text.count, "=:{}\"_"))
    return (f"f{min(3, 40 * digits // n)}", f"g{min(3, 40 * marks // n)}")


def window_features(words: list[str], text: str) -> list[list[str]]:
    """The features of each word: its own, its neighbours', whether a key word stands two or three words before, and the file's."""
    own, whole, out = [word_features(w) for w in words], file_features(text), []
    for i, f in enumerate(own):
        row = [*f]
        if i:
            row += neighbour_features(own[i - 1], "<")
        if i + 1 < len(own):
            row += neighbour_features(own[i + 1], ">")
        if any(is_keyword(k) for k in own[max(0, i - 3) : max(0, i - 1)]):
            row.append(NEAR)
        out.append([*row, *whole])
    return out


class Drawn:
    """Values for the phrases, the same for the same seed."""

    def __init__(self, seed: str, words: list[str], value: str | None = None):
        self.rest, self.words, self.value = [], [w for w in words if w.isalpha()] or ["word"], value
        self.seed, self.turn = seed, 0

    def number(self, below: int) -> int:
        if not self.rest:
            self.rest = list(hashlib.blake2b(f"{self.seed}/{self.turn}".encode()).digest())
            self.turn += 1
        return (self.rest.pop() * 256 + (self.rest.pop() if self.rest else 0)) % below

    def letters(self, n: int, of: str = BASE62) -> str:
        return "".join(of[self.number(len(of))] for _ in range(n))

    def part(self, name: str) -> str:
        if name.startswith("base"):
            return self.letters(int(name[4:]) + self.number(5))
        if name == "jwt":
            return f"eyJ{self.letters(17 + self.number(12))}.eyJ{self.letters(24 + self.number(30), BASE62 + '_-')}.{self.letters(32 + self.number(12), BASE62 + '_-')}"
        if name in ("mixed", "value"):
            if name == "value" and self.value:
                return "".join(c.swapcase() if self.number(2) else c for c in self.value)
            return self.letters(4 + self.number(6)) + self.letters(1, "!@#$%&*+") + self.letters(2 + self.number(4)) + self.letters(1, "0123456789")
        if name == "digits":
            return self.letters(2 + self.number(8), "0123456789")
        if name == "two":
            return self.letters(1 + self.number(2), "0123456789")
        word = self.words[self.number(len(self.words))]
        return word.capitalize() if name == "Camel" else word.upper() if name == "W" else word

    def phrase(self, form: str) -> str:
        return re.sub(r"\{(\w+)\}", lambda m: self.part(m[1]), form)


def phrase_tags(form: str, phrase: str, secret: bool) -> list[int]:
    """Tags of the words of a phrase; in a form the value stands in one word."""
    pieces = form.split()
    at = next(i for i, p in enumerate(pieces) if re.search(r"\{(?!w\})", p)) if secret else -1
    return [B if i == at else O for i in range(len(phrase.split()))]


def word_tags(text: str, spans: list[tuple[int, int, int]]) -> tuple[list[str], list[int]]:
    """The words and their tags from spans; the words that a span touches belong to it."""
    words, tags, k, last = [], [], 0, None
    for m in _WORD.finditer(text):
        while k < len(spans) and spans[k][2] <= m.start():
            k += 1
        hit = next((s for s in spans[k : k + 3] if s[0] < m.end() and s[2] > m.start()), None)
        tags.append(O if hit is None else I if hit == last else B)
        last = hit
        words.append(m[0])
    return words, tags


@dataclass
class Field:
    """Weights: one row of three for each feature, and the transitions (from, to; row 3 is the start)."""

    weights: dict[str, np.ndarray]
    moves: np.ndarray

    def score(self, features: tuple[str, ...]) -> np.ndarray:
        return sum((self.weights[f] for f in features if f in self.weights), np.zeros(3))


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def fit(windows: list[tuple[list[list[str]], list[int]]], rounds: int = 60, rate: float = 0.5, decay: float = 1e-3) -> Field:
    """Fit the field on windows of (features of each word, tags), all of one length but the last ones."""
    names = {f: i + 1 for i, f in enumerate(sorted({f for words, _ in windows for w in words for f in w}))}
    length = max((len(t) for _, t in windows), default=0)
    if not any(t != O for _, tags in windows for t in tags):
        return Field({}, np.zeros((4, 3)))
    n, wide = len(windows), max(len(w) for words, _ in windows for w in words)
    at, gold, real = np.zeros((n, length, wide), np.int64), np.zeros((n, length), np.int64), np.zeros((n, length), bool)
    for i, (words, tags) in enumerate(windows):
        real[i, : len(tags)], gold[i, : len(tags)] = True, tags
        for j, w in enumerate(words):
            at[i, j, : len(w)] = [names[f] for f in w]
    W, T = np.zeros((len(names) + 1, 3)), np.zeros((4, 3))
    hw, ht, rows = np.full_like(W, 1e-6), np.full_like(T, 1e-6), np.arange(n)
    flat = at.reshape(-1)
    for _ in range(rounds):
        e = W[at].sum(axis=2)
        a, b = np.zeros((length, n, 3)), np.zeros((length, n, 3))
        a[0] = e[:, 0] + T[3]
        for t in range(1, length):  # padding carries the sums on unchanged
            a[t] = np.where(real[:, t, None], _log_sum(a[t - 1][:, :, None] + T[None, :3], 1) + e[:, t], a[t - 1])
        z = _log_sum(a[-1], 1)
        for t in range(length - 2, -1, -1):
            b[t] = np.where(real[:, t + 1, None], _log_sum(T[None, :3] + (e[:, t + 1] + b[t + 1])[:, None, :], 2), b[t + 1])
        p = np.exp(a + b - z[None, :, None]).transpose(1, 0, 2) * real[:, :, None]
        slope = -p
        slope[rows[:, None], np.arange(length)[None], gold] += real
        g = np.zeros_like(W)
        per = np.repeat(slope.reshape(-1, 3), wide, axis=0)
        for y in range(3):
            g[:, y] = np.bincount(flat, per[:, y], len(W))
        g[0] = 0
        gt = np.zeros_like(T)
        gt[3] = -p[:, 0].sum(axis=0)
        np.add.at(gt[3], gold[:, 0], 1)
        for t in range(1, length):
            q = np.exp(a[t - 1][:, :, None] + T[None, :3] + (e[:, t] + b[t])[:, None, :] - z[:, None, None]) * real[:, t, None, None]
            gt[:3] -= q.sum(axis=0)
            np.add.at(gt, (gold[real[:, t], t - 1], gold[real[:, t], t]), 1)
        g, gt = g / n - decay * W, gt / n - decay * T
        hw += g * g
        ht += gt * gt
        W += rate * g / np.sqrt(hw)
        T += rate * gt / np.sqrt(ht)
    return Field({f: W[i] for f, i in names.items()}, T)


class Tagger:
    """Viterbi over the words of a text, with the scores of known words kept by their features."""

    def __init__(self, field: Field, cache_size: int = 400_000):
        self.field, self.cache_size = field, cache_size
        self.rows: dict[tuple[str, ...], int] = {}
        self.words: dict[str, int] = {}
        self.table = np.zeros((1024, 10))  # as the word itself, for the word after it, for the word before it; whether it is a key word
        self.near = field.score((NEAR,))
        m = field.moves
        into, out = m[:, :, None], m[:3][None]  # from any tag or the start, through x, to any tag or the end
        keep = into[:, 1:] + out[:, 1:] - into[:, :1] - out[:, :1]
        self.bonus = np.maximum(keep.max(axis=(0, 2)), (m[:, 1:] - m[:, :1]).max(axis=0))

    def row(self, word: str) -> int:
        features = word_features(word)
        if (at := self.rows.get(features)) is None:
            at = self.rows[features] = len(self.rows)
            if at == len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            score = self.field.score
            self.table[at] = np.concatenate([
                score(features), score(neighbour_features(features, "<")), score(neighbour_features(features, ">")), [float(is_keyword(features))]])
        return at

    def scores(self, words: list[str], text: str) -> np.ndarray:
        if new := set(words).difference(self.words):
            if len(self.words) + len(new) > self.cache_size:
                self.words, new = {}, set(words)
            self.words |= {w: self.row(w) for w in new}
        t = self.table[np.fromiter(map(self.words.__getitem__, words), np.int64, len(words))]
        e = t[:, :3] + self.field.score(file_features(text))
        if self.near.any() and len(words) > 2:
            key = t[:, 9] > 0
            e[2:][key[:-2]] += self.near
            e[3:][key[:-3] & ~key[1:-2]] += self.near
        e[1:] += t[:-1, 3:6]
        e[:-1] += t[1:, 6:9]
        return e

    def best(self, e: np.ndarray, first: bool, last: bool) -> list[int]:
        """Viterbi on a run of words; what lies beyond a side that isn't the text's own is outside."""
        m = self.field.moves.tolist()
        e = e.tolist()
        at = [e[0][y] + m[3 if first else O][y] for y in range(3)]
        back = []
        for row in e[1:]:
            came = [max(range(3), key=lambda x, y=y: at[x] + m[x][y]) for y in range(3)]
            back.append(came)
            at = [at[came[y]] + m[came[y]][y] + row[y] for y in range(3)]
        y = max(range(3), key=lambda x: at[x] + (0 if last else m[x][O]))
        tags = [y]
        for came in reversed(back):
            tags.append(y := came[y])
        return tags[::-1]

    def tags(self, words: list[str], text: str) -> dict[int, int]:
        """The tags that are not outside, by word number."""
        if not words or not self.field.weights:
            return {}
        e = self.scores(words, text)
        open_ = np.flatnonzero((e[:, 1:] + self.bonus).max(axis=1) >= e[:, 0])
        found = {}
        for run in np.split(open_, np.flatnonzero(np.diff(open_) > 1) + 1) if len(open_) else ():
            a, b = int(run[0]), int(run[-1]) + 1
            found |= {a + i: y for i, y in enumerate(self.best(e[a:b], a == 0, b == len(words))) if y != O}
        return found

    def spans(self, text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        tags = self.tags(text.split(), text)
        if not tags:
            return []
        found, start, end = [], None, None
        for i, m in enumerate(_WORD.finditer(text)):
            y = tags.get(i, O)
            if start is not None and y != I:
                found.append((start, end))
                start = None
            if y != O:
                start = m.start() if start is None else start
                end = m.end()
        found += [(start, end)] if start is not None else []
        out = []
        for a, b in found:
            piece = text[a:b]
            a, b = a + len(piece) - len(piece.lstrip(_EDGES)), b - len(piece) + len(piece.rstrip(_EDGES))
            if b > a and not any(s < b and a < t for s, _, t in base):
                out.append((a, 3, b))
        return out


def windows_of(doc_id: int, text: str) -> list[tuple[int, int, list[list[str]], list[int]]]:
    """(place, kind, features, tags) of a document's training windows; kind 1 holds a secret."""
    base, found = base_spans(text), []
    words, tags = word_tags(text, base)
    values = [re.split(r"[:=]", text[a:b], maxsplit=1)[-1].strip(" \"'") for a, _, b in base]
    near = {max(0, i - WIDTH // 2) for i, y in enumerate(tags) if y == B}
    plain = {(doc_id * step) % max(1, len(words)) for step in (7919, 104729, 1299709, 15485863)}
    for a in sorted(near | plain):
        part, own = words[a : a + WIDTH], tags[a : a + WIDTH]
        if not part:
            continue
        found.append((a, int(any(own)), window_features(part, text), own))
        drawn = Drawn(f"{doc_id}/{a}", part, values[a % len(values)] if values else None)
        for secret, forms in ((True, FORMS), (False, DECOYS)):
            form = forms[drawn.number(len(forms))]
            phrase, at = drawn.phrase(form), drawn.number(min(len(part), WIDTH) + 1)
            if secret and (base_spans(phrase) or at < len(part) and any(own[max(0, at - 1) : at + 1])):
                continue
            mixed = [*part[:at], *phrase.split(), *part[at:]]
            marks = [*own[:at], *phrase_tags(form, phrase, secret), *own[at:]]
            found.append((a, int(secret), window_features(mixed[: WIDTH + 4], text), marks[: WIDTH + 4]))
    return found


def training_windows(documents: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_windows: int = SAMPLE_WINDOWS) -> list:
    """Windows of the sample, cut in one pass. The driver holds at most ``sample_windows`` of them."""
    chosen = store(documents.select("doc_id").where("doc_id IS NOT NULL").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs).distinct(), "secret-sample")

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(d, *w) for d, t in zip(frame["doc_id"], frame["text"], strict=True) for w in windows_of(d, t)]
            yield pd.DataFrame(rows, columns=["doc_id", "at", "kind", "features", "tags"])

    docs = documents.select("doc_id", text_of().alias("text")).join(chosen, "doc_id", "left_semi")
    windows = store(docs.mapInPandas(cut, "doc_id bigint, at int, kind int, features array<array<string>>, tags array<int>"), "secret-windows")
    found = []
    for kind in (1, 0):
        order = [F.xxhash64("doc_id", "at"), "doc_id", "at", F.xxhash64("features")]
        found += [(r["features"], r["tags"]) for r in windows.where(F.col("kind") == kind).orderBy(*order).limit(sample_windows // 2).collect()]
    discard(chosen, windows)
    return found


def scan(documents: DataFrame, field: Field) -> DataFrame:
    """(doc_id, spans) of each row; a span is (kind, start, end) in code points, by start and then kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(field)
        kind_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch, texts in binary_rows(batches, "text"):
            rows = []
            for text in texts:
                text = text.decode("utf-8", "replace")
                base = base_spans(text)
                rows.append([{"kind": KINDS[k], "start": a, "end": b} for a, k, b in sorted(base + tagger.spans(text, base))])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind_type)], ["doc_id", "spans"])

    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().cast("binary").alias("text"))
    return docs.mapInArrow(run, "doc_id bigint, spans array<struct<kind:string,start:bigint,end:bigint>>")


def find_secrets(documents: DataFrame) -> DataFrame:
    return scan(documents, fit(training_windows(documents)))
