"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes.

The patterns (email, ip, card, phone) give the base spans. The CRF reads a line as words; a word's
features are its shape, its digits and marks, and the same of its neighbours. It is trained by gradient
ascent (forward-backward in numpy) on a small labelled table, built from templates here unless one is
given, and decoded by Viterbi over many lines at once. It adds spans the patterns can't state: numbers in
national form, addresses written out with (at) and [dot], keys and tokens. It never takes a base span away:
what base spans cover is cut out of a labelled run of words, and a run that lacks the digits or marks its kind
must have, or has too many, is split at its words and at = : , ; into the shortest runs that have them.

A line without a digit, an @ or a bracketed at holds no span by definition and is not decoded; all other
lines of a text are, whole, whatever their length.

Defined results: null text is read as empty; empty text has no spans; repeated rows repeat; an empty table
gives no rows; spans of one kind never overlap, and ties go to the leftmost. Offsets are code points, ends
exclusive. Only doc_id and text are read.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret")

# -- patterns -----------------------------------------------------------------------------------------

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")  # a match can't begin within digits: what precedes them would
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches: from each @ back over its local part, which the last match bounds, and on over its domain."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end), by kind as listed, then start."""
    out = [("email", s, e) for s, e in emails(text)]
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p) <= 255 for p in (x.lstrip("0") or "0" for x in m.group().split("."))):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := _digits(m.group())) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m.group())) <= 15]
    return out


# -- word shapes --------------------------------------------------------------------------------------

LABELS = ("", *KINDS)
WIDTH = 512  # hashed features of a word's shape
_RUNS = re.compile(r"[0-9]+|[A-Z]+|[a-z]+|[^\x00-\x7f]+|.", re.DOTALL)


def shape(word: str) -> str:
    """Runs of one character class by class and rough length; marks as they are."""
    out = []
    for run in _RUNS.findall(word):
        c, n = run[0], len(run)
        if c.isdigit() and c.isascii():
            out.append(f"9{n if n < 5 else 5 if n < 13 else 13}")
        elif "A" <= c <= "Z" or "a" <= c <= "z" or c > "\x7f":
            out.append("A" if c.isupper() else "a")
        else:
            out.append(c)
    return "".join(x for i, x in enumerate(out) if i == 0 or x != out[i - 1] or x not in "#*$%&!")


_SAID = ("(at)", "[at]", "(dot)", "[dot]", "token", "key", "secret", "password", "=", ":", "tel", "phone", "call", "card", "ip", "email")


def traits(word: str) -> list[str]:
    """What the random field sees of a word."""
    bare = word.lower().strip(",.;!?\"'#*$%&|")
    digits, letters = sum(map(str.isdigit, bare)), sum(map(str.isalpha, bare))
    hexed = len(bare) >= 24 and digits and letters and all(c in "0123456789abcdef" for c in bare)
    out = [f"s{shape(word)}", f"b{shape(bare)}", f"d{min(digits, 17)}", f"n{min(len(bare) // 4, 9)}"]
    out += [f"k{k}" for k in ("@", "(at)", "[at]", "(dot)", "[dot]", "_", "+", "(", "-") if k in bare]
    out += [f"w{bare or word}"] if (bare or word) in _SAID else []
    out += ["hex"] if hexed else []
    out += ["mix"] if len(bare) >= 16 and digits >= 4 and letters >= 4 else []
    out += [f"p{bare.count('.')}"] if digits and "." in bare else []
    out += ["plain"] if not digits and bare.isalpha() and f"w{bare}" not in out else []
    return out


def _slot(name: str) -> int:
    return int.from_bytes(hashlib.blake2b(name.encode("utf-8", "replace"), digest_size=4).digest(), "little") % WIDTH


class Field:
    """Linear-chain conditional random field: emissions from the shapes of a word and its neighbours."""

    def __init__(self):
        k = len(LABELS)
        self.w = np.zeros((3, WIDTH, k))  # of the word before, the word, the word after
        self.t, self.first = np.zeros((k, k)), np.zeros(k)
        self.last = np.zeros(k)

    def emissions(self, slots: list[list[int]]) -> np.ndarray:
        """(words, labels) of one line."""
        by = np.array([[self.w[j, s].sum(axis=0) for j in range(3)] for s in slots]).reshape(-1, 3, len(LABELS))
        out = by[:, 1].copy()
        out[1:] += by[:-1, 0]
        out[:-1] += by[1:, 2]
        return out

    def fit(self, lines: list[tuple[list[str], list[int]]], rounds: int = 45, rate: float = 0.1, decay: float = 1e-3) -> None:
        """Adam on the log-likelihood, all lines in one padded batch."""
        k, n, top = len(LABELS), len(lines), max(len(w) for w, _ in lines)
        number: dict[str, int] = {"": 0}  # distinct words; 0 is the padding on either side of a line
        word = np.zeros((n, top + 2), int)
        gold, mask = np.zeros((n, top), int), np.zeros((n, top), bool)
        for i, (words, labels) in enumerate(lines):
            word[i, 1 : len(words) + 1] = [number.setdefault(w, len(number)) for w in words]
            gold[i, : len(words)], mask[i, : len(words)] = labels, True
        feature = np.zeros((len(number), WIDTH))
        for w, r in number.items():
            for s in [_slot(x) for x in traits(w)] if r else []:
                feature[r, s] += 1
        size = mask.sum(axis=1)
        m = [np.zeros_like(x) for x in (self.w, self.t, self.first, self.last)]
        v = [np.zeros_like(x) for x in m]
        for step in range(1, rounds + 1):
            each = [feature @ self.w[j] for j in range(3)]
            e = each[0][word[:, :-2]] + each[1][word[:, 1:-1]] + each[2][word[:, 2:]]
            # Forward and backward sums in logarithms.
            alpha, beta = np.zeros((n, top, k)), np.zeros((n, top, k))
            alpha[:, 0] = self.first + e[:, 0]
            for t in range(1, top):
                alpha[:, t] = np.where(mask[:, t, None], e[:, t] + _lse(alpha[:, t - 1, :, None] + self.t, 1), alpha[:, t - 1])
            beta[:, top - 1] = self.last
            for t in range(top - 2, -1, -1):
                beta[:, t] = np.where(mask[:, t + 1, None], _lse(self.t + (e[:, t + 1] + beta[:, t + 1])[:, None, :], 2), self.last)
            z = _lse(alpha[:, top - 1] + self.last, 1)
            p = np.exp(np.where(mask[..., None], alpha + beta - z[:, None, None], -np.inf))
            g_e = np.where(mask[..., None], np.eye(k)[gold], 0) - p
            g_t = np.zeros_like(self.t)
            for t in range(1, top):
                on = mask[:, t]
                pair = np.exp(alpha[on, t - 1, :, None] + self.t + (e[on, t] + beta[on, t])[:, None, :] - z[on, None, None])
                g_t -= pair.sum(axis=0)
                np.add.at(g_t, (gold[on, t - 1], gold[on, t]), 1)
            ends = size - 1
            g_first = np.eye(k)[gold[:, 0]].sum(axis=0) - p[:, 0].sum(axis=0)
            g_last = np.eye(k)[gold[np.arange(n), ends]].sum(axis=0) - p[np.arange(n), ends].sum(axis=0)
            g_w = np.zeros_like(self.w)
            for j in range(3):
                by_word = np.zeros((len(number), k))
                np.add.at(by_word, word[:, j : j + top].ravel(), g_e.reshape(-1, k))
                g_w[j] = feature.T @ by_word
            for q, (x, g) in enumerate(zip((self.w, self.t, self.first, self.last), (g_w, g_t, g_first, g_last), strict=True)):
                g = g / n - decay * x
                m[q] = 0.9 * m[q] + 0.1 * g
                v[q] = 0.99 * v[q] + 0.01 * g * g
                x += rate * (m[q] / (1 - 0.9**step)) / (np.sqrt(v[q] / (1 - 0.99**step)) + 1e-8)

    def decode(self, lines: list[np.ndarray], step: int = 1 << 18) -> list[np.ndarray]:
        """Viterbi paths of lines of emissions, in batches of lines of like length."""
        out: list = [None] * len(lines)
        order = sorted(range(len(lines)), key=lambda i: len(lines[i]))
        at = 0
        while at < len(order):
            end = at + 1
            while end < len(order) and (end - at + 1) * len(lines[order[end]]) <= step:
                end += 1
            part = order[at:end]
            sizes = np.array([len(lines[i]) for i in part])
            top = int(sizes[-1])
            e = np.zeros((len(part), top, len(LABELS)))
            for r, i in enumerate(part):
                e[r, : sizes[r]] = lines[i]
            best, back = self.first + e[:, 0], np.zeros((len(part), top, len(LABELS)), np.int8)
            for t in range(1, top):
                live = slice(np.searchsorted(sizes, t, "right"), None)  # lines are sorted by length
                s = best[live, :, None] + self.t
                back[live, t] = s.argmax(axis=1)
                best[live] = s.max(axis=1) + e[live, t]
            label = (best + self.last).argmax(axis=1)
            path = np.zeros((len(part), top), np.int8)
            for t in range(top - 1, -1, -1):
                live = np.flatnonzero(sizes > t)
                path[live, t] = label[live]
                label[live] = back[live, t, label[live]]
            for r, i in enumerate(part):
                out[i] = path[r, : sizes[r]]
            at = end
        return out


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


# -- the labelled table -------------------------------------------------------------------------------

def examples(count: int = 450, seed: int = 5) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """A small labelled table of lines and spans, from templates: the kinds in several written forms, among
    words, and look-alikes (years, prices, versions, ratios, short codes) that carry no label."""
    rng = np.random.default_rng(seed)
    pick = lambda *x: x[rng.integers(len(x))]
    num = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    syllable = ("the", "an", "re", "tion", "er", "de", "la", "ung", "ich", "que", "ción", "eau", "ment", "st", "on")
    word = lambda: "".join(syllable[i] for i in rng.integers(0, len(syllable), rng.integers(1, 4)))
    host = lambda: f"{word()}{pick('', num(1))}.{pick('com', 'org', 'net', 'example.com')}"
    octet = lambda: str(rng.integers(0, 256))
    hexed = lambda: "".join("0123456789abcdef"[i] for i in rng.integers(0, 16, rng.integers(28, 44)))
    kinds = {
        "email": lambda: pick(
            f"{word()}{pick('.', '_', '')}{num(2)}@{host()}", f"{word()}@{host()}",
            f"{word()} {pick('(at)', '[at]')} {word()} {pick('(dot)', '[dot]')} {pick('com', 'org', 'net')}", f"{word()}{pick('(at)', '[at]')}{host()}",
        ),
        "ip": lambda: pick(".".join(octet() for _ in range(4)), " . ".join(octet() for _ in range(4))),
        "card": lambda: pick(num(16), " ".join(num(4) for _ in range(4)), "-".join(num(4) for _ in range(4))),
        "phone": lambda: pick(f"+{num(1)} ({num(3)}) {num(3)}-{num(4)}", f"({num(3)}) {num(3)}-{num(4)}", f"{num(3)}-{num(3)}-{num(4)}", f"+{num(2)} {num(3)} {num(3)} {num(4)}"),
        "secret": lambda: pick(f'"{hexed()}"', hexed()),
    }
    lead = {"secret": lambda: pick("token = ", "key: ", "secret = ", "password: ", ""), "phone": lambda: pick("", "", "call ", "tel "), "card": lambda: pick("", "", "card "), "email": lambda: pick("", "email "), "ip": lambda: pick("", "ip ")}
    plain = (
        lambda: f"{rng.integers(1000, 2100)}", lambda: f"{num(1)}.{num(1)}", lambda: f"version {num(1)}.{num(1)}.{num(2)}", lambda: f"{num(2)}%", lambda: f"${num(3)}.{num(2)}",
        lambda: f"{num(2)}-{num(2)}", lambda: f"{num(4)}-{num(2)}-{num(2)}", lambda: f"{num(1)},{num(3)},{num(3)}", lambda: f"{word().upper()}-{num(2)}", lambda: f"[{num(1)}]", lambda: f"({num(2)})", lambda: num(5), lambda: f"{num(2)}:{num(2)}", lambda: "@", lambda: f"@{word()}", lambda: f"{word()}{num(2)}",
    )
    mark = lambda: pick("", "", "", ".", ",", "!!", "###", "***")
    out = []
    for n in range(count):
        text, spans = "", []
        for _ in range(rng.integers(1, 4)):
            for _ in range(rng.integers(0, 6)):
                w = word()
                text += pick(w, w, w.capitalize(), w.upper()) + mark() + pick(" ", " ", " ", " | ")
            if rng.random() < 0.55 or n % 3 == 0:
                kind = KINDS[rng.integers(len(KINDS))]
                text += lead[kind]()
                s = kinds[kind]()
                spans.append((kind, len(text), len(text) + len(s)))
                text += s + mark() + " "
            else:
                text += plain[rng.integers(len(plain))]() + mark() + " "
        out.append((text, spans))
    return out


_WORDS = re.compile(r"\S+")


def train(table: Iterable[tuple[str, list[tuple[str, int, int]]]] | None = None) -> Field:
    """A field fitted on (text, [(kind, start, end)]) rows; kinds are those of KINDS."""
    lines = []
    for text, spans in examples() if table is None else table:
        words = [(m.group(), m.start(), m.end()) for m in _WORDS.finditer(text)]
        if words:
            lines.append(([w for w, *_ in words], [next((LABELS.index(k) for k, a, b in spans if s < b and e > a), 0) for _, s, e in words]))
    field = Field()
    if lines:
        field.fit(lines)
    return field


# -- both ---------------------------------------------------------------------------------------------

SLICE = 200  # texts whose words a task holds at once
_CUE = re.compile(r"[0-9@]|[(\[]at[)\]]", re.IGNORECASE)
_LINE = re.compile(r"[^\n]+")
_EDGE = ",.;:!?\"'#*$%&|<>"
_NEEDS = {
    "email": lambda s: "@" in s[1:] and "." in s or re.search(r"[(\[]at[)\]]", s, re.IGNORECASE),
    "ip": lambda s: len(p := re.findall(r"[0-9]+", s)) == 4 and all(len(x) <= 3 and int(x) <= 255 for x in p) and not re.search(r"[^0-9. ]", s),
    "card": lambda s: 13 <= len(_digits(s)) <= 19 and not re.search(r"[^0-9 -]", s),
    "phone": lambda s: 10 <= len(_digits(s)) <= 15 and not re.search(r"[^0-9 ().+-]", s),
    "secret": lambda s: len(s) >= 20 and re.fullmatch(r"[A-Za-z0-9_-]+", s) and any(c.isdigit() for c in s) and any(c.isalpha() for c in s),
}


class Finder:
    """Spans of texts under a trained field."""

    def __init__(self, field: Field):
        self.field = field
        self.cache: dict[str, tuple] = {}

    def _three(self, word: str):
        if (x := self.cache.get(word)) is None:
            if len(self.cache) > 50_000:
                self.cache.clear()
            slots = [_slot(t) for t in traits(word)]
            x = self.cache[word] = self.field.w[:, slots].sum(axis=1)
        return x

    def spans(self, texts: list[str]) -> list[list[tuple[str, int, int]]]:
        """Per text: base spans and the field's, by kind as listed, then start."""
        return [both for _, both in self.both(texts)]

    def both(self, texts: list[str]) -> list[tuple[list, list]]:
        """Per text: the base spans, and all spans; each by kind as listed, then start."""
        base, out, todo, emit = [], [], [], []
        for n, text in enumerate(texts):
            base.append(base_spans(text))
            out.append(list(base[-1]))
            if not _CUE.search(text):
                continue
            for line in _LINE.finditer(text):
                if not _CUE.search(text, line.start(), line.end()):
                    continue
                words = [m.span() for m in _WORDS.finditer(text, line.start(), line.end())]
                by = np.array([self._three(text[s:e]) for s, e in words])
                e = by[:, 1].copy()
                e[1:] += by[:-1, 0]
                e[:-1] += by[1:, 2]
                todo.append((n, words))
                emit.append(e)
        taken = {n: _merged(out[n]) for n in {n for n, _ in todo}}
        for (n, words), path in zip(todo, self.field.decode(emit), strict=True):
            at = 0
            while at < len(path):
                end = at + 1
                while end < len(path) and path[end] == path[at]:
                    end += 1
                if path[at]:
                    for s, e in _free(taken[n], words[at][0], words[end - 1][1]):
                        out[n] += [(LABELS[path[at]], *x) for x in _pieces(texts[n], LABELS[path[at]], s, e)]
                at = end
        order = {k: i for i, k in enumerate(KINDS)}
        return [(b, sorted(x, key=lambda s: (order[s[0]], s[1]))) for b, x in zip(base, out, strict=True)]


def _merged(spans: list[tuple[str, int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the stretches that spans cover, in order."""
    starts: list[int] = []
    ends: list[int] = []
    for _, s, e in sorted(spans, key=lambda x: x[1]):
        if ends and s <= ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    return starts, ends


def _free(taken: tuple[list[int], list[int]], start: int, end: int) -> Iterable[tuple[int, int]]:
    """What of start..end no stretch covers."""
    starts, ends = taken
    k = bisect.bisect_right(ends, start)
    while k < len(starts) and starts[k] < end:
        if starts[k] > start:
            yield start, starts[k]
        start, k = max(start, ends[k]), k + 1
    if start < end:
        yield start, end


def _trimmed(text: str, start: int, end: int) -> tuple[int, int]:
    while start < end and (text[start] in _EDGE or text[start].isspace()):
        start += 1
    while start < end and (text[end - 1] in _EDGE or text[end - 1].isspace()):
        end -= 1
    return start, end


_PARTS, _WIDEST = re.compile(r"[^\s=:,;\"'<>|]+"), 64  # no number or address that _NEEDS lets through is wider


def _pieces(text: str, kind: str, start: int, end: int) -> Iterable[tuple[int, int]]:
    """The spans of a labelled stretch: all of it if that is one, else the shortest runs of its parts that are."""
    s, e = _trimmed(text, start, end)
    if s < e and e - s <= 4 * _WIDEST and _NEEDS[kind](text[s:e]):
        yield s, e
        return
    parts = [m.span() for m in _PARTS.finditer(text, start, end)]
    i = 0
    while i < len(parts):
        j = i
        while j < len(parts) and (j == i or parts[j][1] - parts[i][0] <= _WIDEST):
            s, e = _trimmed(text, parts[i][0], parts[j][1])
            if s < e and _NEEDS[kind](text[s:e]):
                yield s, e
                break
            j += 1
        else:
            j = i
        i = j + 1


def found(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """(doc_id, spans, n_base, base_sha256) of every whole text: all spans with their text, the counts of
    base spans in the order of BASE, and the digest of the base spans."""
    field = field or train()
    schema = "doc_id long, spans array<struct<kind:string,start:long,end:long,value:string>>, n_base array<long>, base_sha256 string"
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())]))

    def run(batches):
        finder = Finder(field)
        for part in common.slices(batches, SLICE):
            texts = [t or "" for t in part.column(1).to_pylist()]
            spans = finder.both(texts)
            rows = [[{"kind": k, "start": s, "end": e, "value": t[s:e]} for k, s, e in x] for t, (_, x) in zip(texts, spans, strict=True)]
            counts = [[sum(k == b for k, *_ in base) for b in BASE] for base, _ in spans]
            sums = [hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in spans]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(rows, kind), pa.array(counts, pa.list_(pa.int64())), pa.array(sums, pa.string())], ["doc_id", "spans", "n_base", "base_sha256"]
            )
        del finder
        common.spare()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def masked(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """docs with each span of its text replaced by its kind in square brackets; null text stays null."""
    field = field or train()
    at = docs.columns.index("text")

    def run(batches):
        finder = Finder(field)
        for batch in common.slices(batches, SLICE):
            texts = batch.column(at).to_pylist()
            out = []
            for text, spans in zip(texts, finder.spans([t or "" for t in texts]), strict=True):
                last, parts = 0, []
                for k, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
                    if s >= last:
                        parts += [text[last:s], f"[{k.upper()}]"]
                        last = e
                out.append(text if text is None or not parts else "".join([*parts, text[last:]]))
            yield batch.set_column(at, batch.schema.field(at), pa.array(out, batch.schema.field(at).type))
        del finder
        common.spare()

    return docs.mapInArrow(run, docs.schema)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = found(common.table(spark, sf_dir, "documents"))
    line = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    added = (F.size("spans") - F.aggregate("n_base", F.lit(0).cast("long"), lambda a, b: a + b)).cast("long")
    return spans.select("doc_id", *(F.col("n_base")[i].alias(f"n_{k}") for i, k in enumerate(BASE)), "base_sha256", line.alias("spans"), added.alias("n_added"))
