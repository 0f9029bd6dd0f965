"""Personal data in texts: fixed patterns, and a semi-Markov conditional random field for what they miss.

The field scores whole candidate segments (length, digit groups, separators, check digits, borders)
rather than single tokens, and dynamic programming over segments of bounded length chooses
boundaries and kinds together. It looks at the runs of characters that a candidate with a digit or
the sign @ can consist of, each as a whole: elsewhere no segment is a candidate, and the best
labelling is "none" whatever the weights.
"""

from __future__ import annotations

import math
import random
import re
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fencewatch.llm.common import steps, text_of, texts

#: In the order in which spans are listed.
KINDS = ("email", "ip", "card", "phone")
NONE = "none"
_LABELS = (NONE, *KINDS)
#: Most tokens of one entity.
MOST_TOKENS = 24
SPANS = "array<struct<kind:string,start:int,end:int,base:boolean>>"
_SPAN_TYPE = pa.list_(
    pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())])
)

# Fixed patterns. The look-behinds only keep a search from starting again inside a run that it has
# seen whole; they do not change what is found.
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TRIGGER = re.compile(r"[0-9@]")
_DIGITS = re.compile(r"[0-9]+")


def _octets(text: str) -> bool:
    parts = [part.lstrip("0") for part in text.split(".")]
    return all(len(part) <= 3 and int(part or 0) <= 255 for part in parts)


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(map(int, reversed(digits))):
        twice = digit * (1 + place % 2)
        total += twice - 9 * (twice > 9)
    return total % 10 == 0


def _only_digits(text: str) -> str:
    return "".join(_DIGITS.findall(text))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """What the fixed patterns find, leftmost and without overlap for each kind."""
    found, end = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and _LOCAL.match(text, start - 1):
            start -= 1
        if start < at and (domain := _DOMAIN.match(text, at + 1)):
            end = domain.end()
            found.append(("email", start, end))
        at = text.find("@", max(at + 1, end))
    if _DIGITS.search(text):
        found += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if _octets(m[0])]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 16 and 16 <= len(digits := _only_digits(m[0])) <= 19 and luhn(digits):
                found.append(("card", m.start(), m.end()))
        found += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= len(_only_digits(m[0])) <= 15]
    return found


# --- the field ---------------------------------------------------------------------------------

_TOKEN = re.compile(r"[0-9]+|[A-Za-z]+|\s|.", re.DOTALL)
_NUMERIC = re.compile(r"[0-9+(][0-9+() .\-]*[0-9]|[0-9]")
_MAIL_LIKE = re.compile(r"[A-Za-z0-9][A-Za-z0-9._%+\-]*@[A-Za-z0-9.\-]*[A-Za-z0-9]")


def _side(text: str, at: int) -> str:
    if not 0 <= at < len(text):
        return "edge"
    c = text[at]
    return "blank" if c.isspace() else "digit" if c.isdigit() else "letter" if c.isalpha() else c


def _features(text: str, start: int, end: int, kind: str) -> list[str]:
    """Features of one whole segment under one kind."""
    span = text[start:end]
    if kind == NONE:
        shape = "digits" if span.isdigit() else "word" if span.isalpha() else "blank" if span.isspace() else span
        return [f"none {shape}"]
    groups = _DIGITS.findall(span)
    marks = "".join(sorted(set(re.sub(r"[0-9A-Za-z]", "", span))))
    out = [kind, f"{kind} left {_side(text, start - 1)}", f"{kind} right {_side(text, end)}"]
    if kind == "email":
        host = span.rpartition("@")[2].split(".")
        out.append(f"email hosts {min(len(host), 3)} end {host[-1].isalpha() and len(host[-1]) > 1}")
        out.append(f"email empty {any(not part for part in host)} signs {span.count('@')}")
        return out
    digits = "".join(groups)
    out.append(f"{kind} marks {marks}")
    out.append(f"{kind} digits {min(len(digits), 22)}")
    out.append(f"{kind} open {span[0] if not span[0].isdigit() else 'digit'} round {span.count('(') == span.count(')')}")
    if kind == "ip":
        out.append(f"ip groups {min(len(groups), 6)} fits {len(groups) == 4 and _octets('.'.join(groups))}")
    elif kind == "card":
        out.append(f"card check {16 <= len(digits) <= 19 and luhn(digits)}")
        out.append(f"card even {len({len(g) for g in groups[:-1]}) <= 1}")
    else:
        out.append(f"phone groups {'-'.join(str(min(len(g), 9)) for g in groups[:6])}")
        out.append(f"phone plus {span[0] == '+'} sized {10 <= len(digits) <= 13}")
    return out


def _tokens(text: str, start: int, end: int) -> array:
    """Where the tokens of a part of a text start, and its end."""
    return array("q", [start, *(m.end() for m in _TOKEN.finditer(text, start, end))])


def _candidates(text: str, bounds: array, last: int) -> list[tuple[int, str]]:
    """For the token at which a segment ends: (its first token, kind); an entity is of bounded length."""
    here = [(last, NONE)]
    end, signs = bounds[last + 1], 0
    tail = text[end - 1]
    if tail.isascii() and tail.isalnum():
        for first in range(last, max(-1, last - MOST_TOKENS), -1):
            start = bounds[first]
            signs += text[start] == "@"
            if text[start] not in _INSIDE or signs > 1:
                break
            span = text[start:end]
            if signs and _MAIL_LIKE.fullmatch(span):
                here.append((first, "email"))
            elif tail.isdigit() and _NUMERIC.fullmatch(span):
                n = sum(map(str.isdigit, span))
                kinds = ("ip",) * (span.count(".") >= 3 and n >= 4) + ("card",) * (13 <= n <= 19) + ("phone",) * (7 <= n <= 15)
                here += [(first, kind) for kind in kinds]
    return here


_INSIDE = frozenset("0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ@._%+-() ")


def _log_sum(values: list[float]) -> float:
    top = max(values)
    return top + math.log(sum(math.exp(v - top) for v in values))


class SpanField:
    """Log-linear weights of segment features."""

    def __init__(self, weights: dict[str, float] | None = None):
        self.weights = weights or {}

    def _score(self, features: list[str]) -> float:
        weights = self.weights
        return sum(weights.get(f, 0.0) for f in features)

    def best(self, text: str, start: int = 0, end: int | None = None) -> list[tuple[str, int, int]]:
        """Entities of the best segmentation of a part of a text, which ends where no entity crosses."""
        bounds = _tokens(text, start, len(text) if end is None else end)
        # A segment is kept as one byte, its number of tokens and its kind.
        score, back = array("d", [0.0]), bytearray(1)
        for last in range(len(bounds) - 1):
            value, first, kind = max(
                (
                    (score[first] + self._score(_features(text, bounds[first], bounds[last + 1], kind)), first, kind)
                    for first, kind in _candidates(text, bounds, last)
                ),
                key=lambda x: x[0],
            )
            score.append(value)
            back.append((last - first) * len(_LABELS) + _LABELS.index(kind))
        found, at = [], len(bounds) - 1
        while at:
            more, label = divmod(back[at], len(_LABELS))
            first = at - 1 - more
            if _LABELS[label] != NONE:
                found.append((_LABELS[label], bounds[first], bounds[at]))
            at = first
        return found[::-1]

    def _slope(self, text: str, gold: list[tuple[str, int, int]]) -> dict[str, float]:
        """Features of the given segmentation less those expected under the field, by forward and backward sums."""
        bounds = _tokens(text, 0, len(text))
        tokens = list(zip(bounds, bounds[1:]))
        arcs = [
            [(first, _features(text, tokens[first][0], end, kind), kind) for first, kind in _candidates(text, bounds, last)]
            for last, (_, end) in enumerate(tokens)
        ]
        scored = [[self._score(f) for _, f, _ in here] for here in arcs]
        forward = [0.0]
        for here, values in zip(arcs, scored):
            forward.append(_log_sum([forward[first] + v for (first, _, _), v in zip(here, values)]))
        n = len(tokens)
        into: list[list[float]] = [[] for _ in range(n + 1)]
        backward = [0.0] * (n + 1)
        into[n].append(0.0)
        for last in range(n - 1, -1, -1):
            backward[last + 1] = _log_sum(into[last + 1])
            for (first, _, _), v in zip(arcs[last], scored[last]):
                into[first].append(backward[last + 1] + v)
        wanted = {(a, b): kind for kind, a, b in gold}
        inside = [any(a <= s < b for a, b in wanted) for s, _ in tokens]
        slope: dict[str, float] = {}
        for last, (here, values) in enumerate(zip(arcs, scored)):
            for (first, features, kind), v in zip(here, values):
                p = math.exp(forward[first] + v + backward[last + 1] - forward[n])
                true = wanted.get((tokens[first][0], tokens[last][1])) == kind if kind != NONE else not inside[last]
                for f in features:
                    slope[f] = slope.get(f, 0.0) + true - p
        return slope

    def fit(self, examples: list[tuple[str, list[tuple[str, int, int]]]], rounds: int = 6) -> SpanField:
        squares: dict[str, float] = {}
        for _ in range(rounds):
            for text, gold in examples:
                for f, g in self._slope(text, gold).items():
                    g -= 1e-3 * self.weights.get(f, 0.0)
                    squares[f] = squares.get(f, 1e-6) + g * g
                    self.weights[f] = self.weights.get(f, 0.0) + 0.5 * g / math.sqrt(squares[f])
        return self


def _with_check_digit(digits: str) -> str:
    return next(digits + str(d) for d in range(10) if luhn(digits + str(d)))


def examples(count: int = 500, seed: int = 11) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Labelled texts to learn from: entities in the ways they are written, and numbers that are none."""
    draw = random.Random(seed)

    def number(n: int) -> str:
        return str(draw.randint(1, 9)) + "".join(str(draw.randint(0, 9)) for _ in range(n - 1))

    def word() -> str:
        return "".join(draw.choice("abcdeghilmnoprstu") for _ in range(draw.randint(2, 8)))

    def card() -> str:
        digits = _with_check_digit(number(15))
        gap = draw.choice(["", "", " ", "-", "."])
        return gap.join(digits[i : i + 4] for i in range(0, 16, 4))

    def phone() -> str:
        area, a, b = number(3), number(3), number(4)
        forms = ["+1 ({0}) {1}-{2}", "({0}) {1}-{2}", "{0}-{1}-{2}", "{0}.{1}.{2}", "+1 {0} {1} {2}", "+44 20 {2} 0{1}"]
        return draw.choice(forms).format(area, a, b)

    def no_card() -> str:
        digits = number(16)
        return digits if not luhn(digits) else digits[:-1] + str((int(digits[-1]) + 1) % 10)

    def email() -> str:
        host = ".".join([word(), *([word()] if draw.random() < 0.4 else []), draw.choice(["com", "org", "net", "de"])])
        return draw.choice([f"{word()}.{number(2)}@{host}", f"{word()}@{host}", f"{word()}+{word()}@{host}"])

    entities = {"email": email, "card": card, "phone": phone}
    entities["ip"] = lambda: ".".join(str(draw.randint(0, 255)) for _ in range(4))
    others = [
        word, word, word, lambda: number(4), lambda: f"{number(4)}-0{number(1)}-{number(2)}", lambda: f"{number(1)}.{number(2)}",
        lambda: f"{number(1)}.{number(1)}.{number(1)}", lambda: f"{number(2)}:{number(2)}", no_card, lambda: number(9),
        lambda: f"password={word()}{number(9)}{word()}", lambda: f"{word()} @ {word()}", lambda: f"@{word()}",
        lambda: ".".join(number(n) for n in (3, 1, 2, 1, 1)), lambda: f"{300 + draw.randint(0, 600)}.{number(2)}.{number(2)}.1",
        lambda: "".join(draw.choice("0123456789abcdef") for _ in range(40)), lambda: f"{number(2)} {number(2)} {number(3)}",
        lambda: number(25), lambda: f"{number(1)},{number(3)},{number(3)}",
    ]
    made = []
    for _ in range(count):
        text, gold = "", []
        for _ in range(draw.randint(2, 6)):
            if draw.random() < 0.5:
                kind = draw.choice(KINDS)
                part = entities[kind]()
                gold.append((kind, len(text), len(text) + len(part)))
            else:
                part = draw.choice(others)()
            text += part + draw.choice([" ", " ", " ", ". ", ", ", "\n"])
        made.append((text, gold))
    return made


@cache
def trained() -> SpanField:
    """The field learned from its examples: the same weights in every run and task."""
    return SpanField().fit(examples())


#: What a candidate has to hold and the characters that it can consist of: see ``_NUMERIC`` and ``_MAIL_LIKE``.
_RUNS = (
    (_DIGITS, frozenset("0123456789+() .-"), re.compile(r"[0-9+() .\-]+")),
    (re.compile("@"), _INSIDE - frozenset("() "), re.compile(r"[A-Za-z0-9@._%+\-]+")),
)


def _neighbourhoods(text: str) -> list[tuple[int, int]]:
    """Where candidates can be: no candidate lies over an end of a neighbourhood."""
    runs = []
    for sign, inside, run in _RUNS:
        end = 0
        for m in sign.finditer(text):
            if m.start() < end:
                continue
            start = m.start()
            while start > end and text[start - 1] in inside:
                start -= 1
            end = run.match(text, m.start()).end()
            runs.append((start, end))
    return _joined(runs)


def _joined(parts: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Parts that overlap as one, in order."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(parts):
        if out and start < out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def all_spans(text: str, field: SpanField) -> list[tuple[str, int, int, bool]]:
    """Base spans and, where none of them lies, what the field adds; ordered by kind, then start."""
    base = base_spans(text)
    spans = [(kind, a, b, True) for kind, a, b in base]
    covered = _joined([(a, b) for _, a, b in base])
    starts, ends = [a for a, _ in covered], [b for _, b in covered]
    for start, end in _neighbourhoods(text):
        # A neighbourhood that holds nothing but base spans needs no labelling.
        place, rest = start, False
        for i in range(bisect_right(ends, start), bisect_left(starts, end)):
            rest = rest or bool(_TRIGGER.search(text, place, max(place, starts[i])))
            place = ends[i]
        if not rest and not _TRIGGER.search(text, place, max(place, end)):
            continue
        for kind, a, b in field.best(text, start, end):
            if bisect_right(ends, a) == bisect_left(starts, b):
                spans.append((kind, a, b, False))
    return sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def found(frame: DataFrame, key: str = "doc_id", text: str = "text", field: SpanField | None = None) -> DataFrame:
    """The key and ``spans`` of every row: kind, start, end (code points, end exclusive), base or added.

    Null and empty texts have no spans; repeated rows and null keys stay; other columns are not read.
    """
    kind = frame.schema[key].dataType.simpleString()
    field = field or trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, text):
            spans = [
                [dict(zip(("kind", "start", "end", "base"), s)) for s in all_spans(t, field)] for t in texts(batch.column(1))
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, _SPAN_TYPE)], [key, "spans"])

    return frame.select(key, text).mapInArrow(run, f"`{key}` {kind}, spans {SPANS}")


def listed(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def _masked(text: str, field: SpanField) -> str:
    out, at = [], 0
    for kind, start, end, _ in sorted(all_spans(text, field), key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], f"<{kind}>"]
        at = max(at, end)
    return "".join(out) + text[at:]


def masked(frame: DataFrame, text: str = "text", size: str | None = "n_chars", field: SpanField | None = None) -> DataFrame:
    """All rows and columns, with every span of the text replaced by its kind.

    ``size``, if the frame has it, becomes the length of the new text where it was the length of the
    old one. A null text stays null.
    """
    fields = frame.schema.fields
    field = field or trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, text):
            values = text_of(batch, text).to_pylist()
            new = [t if not t or not _TRIGGER.search(t) else _masked(t, field) for t in values]
            columns = [
                pa.array(new, batch.column(i).type) if f.name == text else batch.column(i) for i, f in enumerate(fields)
            ]
            if size in batch.schema.names:
                i = batch.schema.get_field_index(size)
                sizes = [
                    n if t is None or n != len(t) else len(m) for n, t, m in zip(columns[i].to_pylist(), values, new)
                ]
                columns[i] = pa.array(sizes, columns[i].type)
            yield pa.RecordBatch.from_arrays(columns, [f.name for f in fields])

    return frame.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields))
