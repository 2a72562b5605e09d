"""Personal data: patterns, and a linear-chain conditional random field over word shapes.

The patterns (``base_spans``) are fixed. The field adds what they miss, such as telephone
numbers without a country code. It labels words by their shapes and those of their
neighbours; a word without a digit or an @ is outside by definition, so a text falls into
independent runs of other words, and only these are decoded, each whole, by Viterbi over
arrays of many runs at once. It is trained on the driver from a small labelled table made from templates.

Defined results: null text counts as empty and has no spans; whole texts are searched, each
pattern in time linear in the text; a span that the field adds never touches a base span.
Repeated rows and other columns are of no matter; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("email", "ip", "card", "phone")
#: Outside, then beginning and inside of each kind.
STATES = 1 + 2 * len(KINDS)
#: Places, padding included, that one decoding holds; a longer run is decoded alone.
PLACES = 1 << 17

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_HINT = re.compile(r"[0-9@]")
_SPACE = re.compile(r"[\x20\x09-\x0D]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_SPACES = frozenset(" \t\n\x0b\x0c\r")


class Span(NamedTuple):
    kind: int
    start: int
    end: int


def luhn(digits: str) -> bool:
    values = [int(c) for c in reversed(digits)]
    return sum(values[0::2] + [v * 2 - 9 * (v > 4) for v in values[1::2]]) % 10 == 0


def _digits(text: str) -> str:
    return "".join(_DIGIT.findall(text))


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """As the pattern would from left to right, but from each @, so that long words cost no retries."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            done = m.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns, by kind and start."""
    out = [Span(0, *s) for s in _emails(text)]
    if _DIGIT.search(text):
        out += [Span(1, *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            d = _digits(m[0]) if m.end() - m.start() <= 40 else ""
            if 13 <= len(d) <= 19 and luhn(d):
                out.append(Span(2, *m.span()))
        if "+" in text:
            out += [Span(3, *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return out


class Word(NamedTuple):
    start: int
    end: int
    text: str


def runs(text: str) -> Iterator[tuple[list[Word], str, str]]:
    """Runs of words with a digit or an @, with the word before and the word after each."""
    run: list[Word] = []
    at = 0
    while m := _HINT.search(text, at):
        start = m.start()
        while start > at and text[start - 1] not in _SPACES:
            start -= 1
        gap = _SPACE.search(text, m.end())
        end = gap.start() if gap else len(text)
        if run and text[run[-1].end : start].strip(" \t\n\x0b\x0c\r"):
            yield run, *_around(text, run)
            run = []
        run.append(Word(start, end, text[start:end]))
        at = end
    if run:
        yield run, *_around(text, run)


def _around(text: str, run: list[Word]) -> tuple[str, str]:
    before, after = text[max(0, run[0].start - 40) : run[0].start].split(), text[run[-1].end : run[-1].end + 40].split()
    return before[-1] if before else "", after[0] if after else ""


@lru_cache(50_000)
def shape(word: str) -> tuple[str, ...]:
    """Features of one word's form."""
    core = word.strip(".,;:!?\"'<>[]")
    full = re.sub(r"[A-Z]+", "A", re.sub(r"[^\W\d_A-Z]+", "a", re.sub(r"[0-9]", "0", core)))[:40]
    digits = _digits(core)
    hexed = bool(re.search(r"[A-Za-z][0-9]|[0-9][A-Za-z]", core)) and "@" not in core
    return (
        f"full={full}", f"short={re.sub(r'0+', '0', full)}", f"digits={min(len(digits), 20)}", f"first={full[:1]}", f"last={full[-1:]}",
        f"at={'@' in core}{core.find('.', core.find('@')) > 0}", f"dots={min(core.count('.'), 5)}", f"dashes={min(core.count('-'), 4)}", f"mixed={hexed}",
        f"only={core.isdigit()}{len(digits) >= 13 and luhn(digits)}", f"plus={core[:1] == '+'}", f"paren={word[:1] == '('}{')' in word}",
    )


def features(run: list[Word], before: str, after: str) -> list[tuple[str, ...]]:
    """Features of each word: its own, the forms beside it, and the plain word in front."""
    forms = [shape(w.text) for w in run]
    sides = [("start",), *forms, ("end",)]
    plain = before.lower().strip(".,;:!?\"'()=")[:12] if before.strip(":=").isalpha() else "-"
    out = []
    for k, f in enumerate(forms):
        extra = (f"-1{sides[k][0]}", f"+1{sides[k + 2][0]}", f"-1{sides[k][1] if k else ''}", f"+1{sides[k + 2][1] if k + 1 < len(forms) else ''}", f"{f[0]}|{sides[k + 2][0]}")
        out.append((*f, *extra, *((f"word={plain}",) if k == 0 else ())))
    return out


class Field:
    """Weights of features and of steps between states; a run starts and ends outside."""

    def __init__(self, index: dict[str, int], weight: np.ndarray, step: np.ndarray):
        self.index, self.weight, self.step = index, weight, step

    def emissions(self, batch: list[list[tuple[str, ...]]]) -> tuple[np.ndarray, np.ndarray]:
        """Padded (run, place, state) scores, and lengths."""
        size = np.array([len(r) for r in batch])
        out = np.zeros((len(batch), size.max(), STATES))
        get = self.index.get
        for row, r in zip(out, batch):
            for k, f in enumerate(r):
                known = [i for x in f if (i := get(x)) is not None]
                if known:
                    row[k] = self.weight[known].sum(0)
        return out, size

    def decode(self, batch: list[list[tuple[str, ...]]]) -> list[list[int]]:
        """Best states of each run."""
        score, size = self.emissions(batch)
        n, longest, _ = score.shape
        best = self.step[0] + score[:, 0]
        back = np.zeros((n, longest, STATES), np.int64)
        for t in range(1, longest):
            paths = best[:, :, None] + self.step
            back[:, t] = paths.argmax(1)
            best = np.where((t < size)[:, None], paths.max(1) + score[:, t], best)
        at = (best + self.step[:, 0]).argmax(1)
        out = np.zeros((n, longest), np.int64)
        rows = np.arange(n)
        for t in range(longest - 1, -1, -1):
            out[:, t] = np.where(t < size, at, 0)
            if t:
                at = np.where(t < size, back[rows, t, at], at)
        return [row[:k] for row, k in zip(out.tolist(), size.tolist())]


def labelled_table(seed: int = 7, rounds: int = 25) -> list[tuple[str, list[Span]]]:
    """Sentences with marked spans. Marks are written {kind:value} in the templates."""
    rng = np.random.default_rng(seed)
    num = lambda n, low=0: "".join(map(str, rng.integers(low, 10, n)))
    word = lambda: "".join(rng.choice(list("abcdefghiklmnorstuvw"), rng.integers(2, 9)))

    def card(gap: str) -> str:
        d = num(15, 1)
        d += next(c for c in "0123456789" if luhn(d + c))
        return gap.join(d[i : i + 4] for i in range(0, 16, 4))

    made = {
        "email": [lambda: f"{word()}.{num(2)}@{word()}{num(1)}.example.com", lambda: f"{word()}@{word()}.org", lambda: f"{word()}_{word()}@{word()}-{num(1)}.net"],
        "ip": [lambda: ".".join(str(x) for x in rng.integers(1, 256, 4))],
        "card": [lambda: card(""), lambda: card(" "), lambda: card("-")],
        "phone": [
            lambda: f"+{num(1, 1)} ({num(3, 1)}) {num(3, 1)}-{num(4)}", lambda: f"+{num(2, 1)} {num(3, 1)} {num(6)}", lambda: f"({num(3, 1)}) {num(3, 1)}-{num(4)}",
            lambda: f"{num(3, 1)}-{num(3, 1)}-{num(4)}", lambda: f"{num(3, 1)}.{num(3, 1)}.{num(4)}", lambda: f"+{num(2, 1)}-{num(3, 1)}-{num(7)}",
        ],
    }
    other = [
        lambda: f"{num(1, 1)}.0", lambda: f"{num(1, 1)}.", lambda: f"{rng.integers(1900, 2100)}", lambda: f"{rng.integers(1900, 2100)}-{num(2)}-{num(2)}", lambda: f"{num(2)}:{num(2)}",
        lambda: num(rng.integers(1, 7)), lambda: f"{num(1, 1)},{num(3)}.{num(2)}", lambda: f"AKIA{''.join(rng.choice(list('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'), 16))}",
        lambda: f"password={''.join(rng.choice(list('0123456789abcdef'), 18))}", lambda: f"\"{''.join(rng.choice(list('0123456789abcdef'), 40))}\"", lambda: f"{num(1, 1)}.{num(1)}.{num(1)}",
        lambda: f"{word()}{num(2)}", lambda: f"§{num(2)}", lambda: f"{num(2)}%", lambda: num(rng.integers(11, 22), 1), lambda: f"@{word()}", lambda: f"{num(3)}-{num(2)}", lambda: f"{word()}@",
    ]
    table = []
    for _ in range(rounds):
        for kind, makers in made.items():
            for make in makers:
                parts, spans, at = [], [], 0
                for piece in (word(), word(), make, word(), other[rng.integers(len(other))], word(), other[rng.integers(len(other))]):
                    if callable(piece):
                        value = piece()
                        if piece is make:
                            spans.append(Span(KINDS.index(kind), at, at + len(value)))
                            value += rng.choice(["", "", "", ",", "."])
                    else:
                        value = piece
                    parts.append(value)
                    at += len(value) + 1
                table.append((" ".join(parts), spans))
    return table


def train(table: list[tuple[str, list[Span]]], rounds: int = 120, rate: float = 0.15, decay: float = 1e-3) -> Field:
    """Maximum likelihood by Adam over the whole table."""
    batch, gold = [], []
    for text, spans in table:
        for run, before, after in runs(text):
            batch.append(features(run, before, after))
            states = []
            for w in run:
                s = next((s for s in spans if s.start < w.end and w.start < s.end), None)
                states.append(0 if s is None else 1 + 2 * s.kind + (w.start > s.start))
            gold.append(states)
    names = sorted({x for r in batch for f in r for x in f})
    index = {x: i for i, x in enumerate(names)}
    n, longest = len(batch), max(map(len, batch))
    size = np.array([len(r) for r in batch])
    y = np.zeros((n, longest), np.int64)
    rows, cols = [], []
    for i, r in enumerate(batch):
        y[i, : len(r)] = gold[i]
        for t, f in enumerate(r):
            cols += [index[x] for x in f]
            rows += [i * longest + t] * len(f)
    rows, cols = np.array(rows), np.array(cols)
    inside = np.arange(longest) < size[:, None]
    weight, step = np.zeros((len(names), STATES)), np.zeros((STATES, STATES))
    moments = [np.zeros_like(weight), np.zeros_like(weight), np.zeros_like(step), np.zeros_like(step)]
    logsum = lambda a, axis: np.log(np.exp(a - (m := a.max(axis, keepdims=True))).sum(axis)) + np.squeeze(m, axis)
    every = np.arange(n)
    for turn in range(1, rounds + 1):
        score = np.zeros((n * longest, STATES))
        np.add.at(score, rows, weight[cols])
        score = score.reshape(n, longest, STATES)
        forward, backward = np.zeros_like(score), np.zeros_like(score)
        forward[:, 0] = step[0] + score[:, 0]
        for t in range(1, longest):
            forward[:, t] = logsum(forward[:, t - 1, :, None] + step, 1) + score[:, t]
        backward[:, -1] = step[:, 0]
        for t in range(longest - 2, -1, -1):
            on = logsum(step + (score[:, t + 1] + backward[:, t + 1])[:, None, :], 2)
            backward[:, t] = np.where((t + 1 < size)[:, None], on, step[:, 0])
        z = logsum(forward[every, size - 1] + step[:, 0], 1)
        p = np.exp(forward + backward - z[:, None, None]) * inside[:, :, None]
        p[every[:, None], np.arange(longest), y] -= inside
        grad = np.zeros_like(weight)
        np.add.at(grad, cols, p.reshape(-1, STATES)[rows])
        step_grad = np.zeros_like(step)
        q = np.exp(step[0] + score[:, 0] + backward[:, 0] - z[:, None])
        step_grad[0] += q.sum(0)
        np.add.at(step_grad, (0, y[:, 0]), -1)
        end = np.exp(forward[every, size - 1] + step[:, 0] - z[:, None])
        step_grad[:, 0] += end.sum(0)
        np.add.at(step_grad, (y[every, size - 1], 0), -1)
        for t in range(1, longest):
            on = t < size
            q = np.exp(forward[on, t - 1, :, None] + step + (score[on, t] + backward[on, t])[:, None, :] - z[on, None, None])
            step_grad += q.sum(0)
            np.add.at(step_grad, (y[on, t - 1], y[on, t]), -1)
        for k, (value, g) in enumerate(((weight, grad / n + decay * weight), (step, step_grad / n + decay * step))):
            m, v = moments[2 * k], moments[2 * k + 1]
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            value -= rate * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.99**turn)) + 1e-8)
    return Field(index, weight, step)


@lru_cache(1)
def default_field() -> Field:
    """The field trained on the default table, once for each driver."""
    return train(labelled_table())


def _fits(kind: int, text: str) -> bool:
    """Whether a span that the field proposes can be of its kind at all."""
    n = len(_digits(text))
    return (("@" in text[1:-1] and "." in text), text.count(".") == 3 and n >= 4, 13 <= n <= 19 and luhn(_digits(text)), 7 <= n <= 15)[kind]


def added_spans(texts: list[str], base: list[list[Span]], field: Field) -> list[list[Span]]:
    """What the field finds beside the base spans, for each text."""
    found = [(i, run, features(run, before, after)) for i, t in enumerate(texts) for run, before, after in runs(t)]
    out: list[list[Span]] = [[] for _ in texts]
    if not found:
        return out
    order = sorted(range(len(found)), key=lambda k: len(found[k][1]))
    ends = [0]
    for at, k in enumerate(order):
        if at > ends[-1] and (at + 1 - ends[-1]) * len(found[k][1]) > PLACES:
            ends.append(at)
    for at, end in zip(ends, [*ends[1:], len(order)]):
        part = order[at:end]
        for k, states in zip(part, field.decode([found[k][2] for k in part])):
            i, run, _ = found[k]
            t = 0
            while t < len(states):
                kind, first = (states[t] - 1) // 2, t
                t += 1
                if kind < 0 or states[first] == 0:
                    continue
                while t < len(states) and states[t] == 2 + 2 * kind:
                    t += 1
                start, end = run[first].start, run[t - 1].end
                while start < end and not (texts[i][start].isalnum() or texts[i][start] in "+("):
                    start += 1
                while end > start and not texts[i][end - 1].isalnum():
                    end -= 1
                if _fits(kind, texts[i][start:end]) and not any(s.start < end and start < s.end for s in base[i]):
                    out[i].append(Span(kind, start, end))
    return out


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[s.kind]}:{s.start}:{s.end}" for s in sorted(spans))


def find(docs: DataFrame, field: Field) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base, spans): counts of base spans; spans written kind:start:end."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = [t if isinstance(t, str) else "" for t in pdf["text"]]
            base = [base_spans(t) for t in texts]
            more = added_spans(texts, base, field)
            counts = {f"n_{k}": [sum(s.kind == i for s in b) for b in base] for i, k in enumerate(KINDS)}
            yield pd.DataFrame({"doc_id": pdf["doc_id"], **counts, "base": [written(b) for b in base], "spans": [written(b + m) for b, m in zip(base, more)]})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInPandas(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base string, spans string")


def masked(text: str, spans: list[Span]) -> str:
    """The text with each span, or spans that overlap, replaced by its first kind in brackets."""
    out, at, end = [], 0, 0
    for s in sorted(spans, key=lambda s: (s.start, -s.end)):
        if s.start >= end:
            out += [text[at : s.start], f"[{KINDS[s.kind].upper()}]"]
        at = end = max(end, s.end)
    return "".join(out) + text[at:]


def redactor(field: Field):
    """A column of texts with their personal data masked; null stays null."""

    @F.pandas_udf(T.StringType())
    def redact(column: pd.Series) -> pd.Series:
        texts = [t if isinstance(t, str) else "" for t in column]
        base = [base_spans(t) for t in texts]
        more = added_spans(texts, base, field)
        return pd.Series([masked(t, b + m) if isinstance(raw, str) else None for raw, t, b, m in zip(column, texts, base, more)], dtype=object)

    return redact
