"""Personal data by fixed patterns and a semi-Markov conditional random field.

The base kinds (email, ip, card, phone) are found by pattern and check, leftmost and non-overlapping per kind. Besides
them a semi-Markov CRF labels whole candidate segments: a segment of up to `longest` pieces has features of the span as
a whole (its digits, separators, groups, checksum, key word, neighbours), and one dynamic program over a window chooses
boundaries and kinds together, each entity bounded in length. Only segments with the form of a kind are candidates for
it: cards pass the Luhn check, parts of an ip are at most 255, phones have 9 to 15 digits and don't begin with a year,
secrets are a key word with its value or one unbroken run of letters and digits. What it finds beside the base spans is
added, under the base kinds or as `secret`; base spans always stay, added ones never overlap them.

The model is trained here, on sentences made from fixed forms with a fixed seed (a few seconds, once per process), by
gradient ascent on the conditional likelihood; among them are many that look like entities and are none: checksums,
identifiers, paths of URLs, dates, serial and order numbers. It is a small table of weights that is sent with the tasks.

Null texts count as empty and have no spans. Texts are searched whole; only the surroundings of digits and @ signs are
decoded, the segments of a bounded number of pieces at a time, so very long texts take time in proportion. Repeated rows give repeated
results; an empty table gives an empty result; only the named columns are read, so others may have any name. Offsets are code points, end exclusive.
"""

from __future__ import annotations

import hashlib
import random
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.shared import batch, map_batches

KINDS = ("email", "ip", "card", "phone")
TYPES = ("none", *KINDS, "secret")
Span = tuple[str, int, int]

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _emails(text: str) -> list[Span]:
    """Each @ from the left: the run of local characters before it, not before the last match, and the domain after."""
    out: list[Span] = []
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append(("email", start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return out


def base_spans(text: str) -> list[Span]:
    """The spans of the base kinds, by kind as listed and then by start."""
    out = _emails(text) if "@" in text else []
    if not _DIGIT.search(text):
        return out
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if 13 <= len(m[0]) and 13 <= len(digits := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_DIGIT.findall(m[0])) <= 15]
    return out


_PIECE = re.compile(r"[^\W_]+|[^\s]")
_TRIGGER, _SPACE, _REST = re.compile(r"[0-9@]"), re.compile(r"\s"), re.compile(r"[^\W_]*")
_KEYED = re.compile(r"(?:password|passwd|pwd|secret|token|api|key|auth)\w*(?: \w+)?\s*[=:]\s*(?:\"[^\s\"']{6,}\"|'[^\s\"']{6,}'|[^\s\"']{6,})", re.I)
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_CALL = re.compile(r"(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,5}\)[ .-]?)?[0-9]{2,5}(?:[ ./-][0-9]{2,5}){0,5}|\+[0-9]{9,15}")
_YEAR = re.compile(r"\(?(?:19|20)[0-9]{2}\b")
_GROUPS = re.compile(r"[0-9]+")
#: Pieces in the longest segment, and in the longest window that is decoded at once.
LONGEST, WINDOW = 14, 400
AROUND = 64


def _size(n: int, steps: tuple[int, ...]) -> int:
    return sum(n >= s for s in steps)


def allowed(span: str) -> tuple[int, ...]:
    """The kinds, as places in TYPES, whose form the span has."""
    if "@" in span:
        return (1,) if _EMAIL.fullmatch(span) else ()
    if _KEYED.fullmatch(span):
        return (5,)
    digits = sum(map(len, groups := _GROUPS.findall(span)))
    if not digits:
        return ()
    if span.isascii() and span.isalnum() and not span.isdigit():
        return (5,) if len(span) >= 16 else ()
    out = []
    if len(groups) == 4 and ".".join(groups) == span and all(len(g) <= 3 and int(g) <= 255 for g in groups):
        out.append(2)
    if 13 <= digits <= 19 and _CARD.fullmatch(span.replace(".", "-")) and luhn("".join(groups)):
        out.append(3)
    if 9 <= digits <= 15 and (len(groups) > 1 or span[0] == "+") and _CALL.fullmatch(span) and not _YEAR.match(span):
        out.append(4)
    return tuple(out)


def features(span: str, before: str, after: str, word: str = "") -> list[str]:
    """Whole-span features; before and after: the neighbouring characters, word: the piece before the span."""
    groups = _GROUPS.findall(span)
    digits, letters = sum(map(len, groups)), sum(map(str.isalpha, span))
    marks = "".join(sorted({c for c in span if not c.isalnum()}))
    nd, nl = _size(digits, (1, 4, 7, 9, 10, 11, 13, 16, 17, 20)), _size(letters, (1, 4, 11, 21))
    out = [
        "1", f"d{nd}", f"l{nl}", f"m{marks}", f"m{marks} d{nd}", f"d{nd} l{nl}", f"g{'-'.join(str(len(g)) for g in groups[:6])} {marks}" if not letters else f"a{min(9, len(groups))}",
        f"first {_kind(span[0])} last {_kind(span[-1])}", f"out {_kind(before)} {_kind(after)}", f"at{min(2, span.count('@'))}",
    ]
    if 13 <= digits <= 19 and not letters:
        out.append(f"luhn {luhn(''.join(groups))} {marks}")
    if _KEYED.fullmatch(span):
        out.append("keyed")
    if len(span) >= 16 and span.isalnum() and letters and digits:
        form = "upper" if span.isupper() else "hex" if set(span.lower()) <= set("0123456789abcdef") else "mixed"
        out += [form, f"{form} {span[:4] if form == 'upper' else _size(len(span), (20, 32, 33, 40, 41))}"]
        if word.isalnum() and len(word) <= 12:
            out.append(f"{form} after {word.lower()}")
    return out


def _kind(c: str) -> str:
    return "." if not c or c.isspace() else "9" if c.isdigit() else "a" if c.isalpha() else c


class SemiCrf:
    """Weights per feature and type, and per pair of neighbouring types; the type none has segments of one piece."""

    def __init__(self, names: dict[str, int]) -> None:
        self.names = names
        self.weights = np.zeros((len(names) + 1, len(TYPES)))
        self.weights[-1] = 0
        self.step = np.zeros((len(TYPES), len(TYPES)))

    def segments(self, text: str, at: list[tuple[int, int]], firsts: int | None = None) -> list[tuple[int, int, list[int], tuple[int, ...]]]:
        """(first piece, end piece, feature ids, kinds): single pieces, and longer runs with the form of some kind.

        Runs hold a digit or an @ and lie in one line. firsts: only those that begin in so many pieces.
        """
        trigger = np.cumsum([0, *(_TRIGGER.search(text, a, b) is not None for a, b in at)]).tolist()
        out = []
        for i in range(len(at) if firsts is None else firsts):
            for j in range(i + 1, min(len(at), i + LONGEST) + 1):
                a, b = at[i][0], at[j - 1][1]
                if j > i + 1:
                    if "\n" in text[at[j - 2][1] : at[j - 1][0]]:
                        break
                    if trigger[j] == trigger[i]:
                        continue
                kinds = allowed(text[a:b]) if trigger[j] > trigger[i] else ()
                if j > i + 1 and not kinds:
                    continue
                word = text[at[i - 1][0] : at[i - 1][1]] if i else ""
                ids = [self.names.get(f, -1) for f in features(text[a:b], text[a - 1 : a], text[b : b + 1], word)]
                out.append((i, j, [k for k in ids if k >= 0], kinds))
        return out

    def scores(self, segments: list[tuple[int, int, list[int], tuple[int, ...]]]) -> np.ndarray:
        s = np.full((len(segments), len(TYPES)), -np.inf)
        for k, (i, j, ids, kinds) in enumerate(segments):
            y = [*([0] if j == i + 1 else []), *kinds]
            s[k, y] = self.weights[ids][:, y].sum(axis=0)
        return s

    def decode(self, text: str, at: list[tuple[int, int]]) -> list[Span]:
        """The best segmentation of a window's pieces; its spans in characters.

        Segments are scored for WINDOW first pieces at a time, but one dynamic program runs over all pieces. It holds the
        scores of the last LONGEST ends, and per end and type two small numbers: the segment's length and the type before.
        """
        n, ends = len(at), [[] for _ in range(LONGEST + 1)]
        best = np.full((LONGEST + 1, len(TYPES)), -np.inf)
        best[0, 0] = 0
        back = np.zeros((n + 1, len(TYPES), 2), np.int8)
        for begin in range(0, n, WINDOW):
            stop = min(n, begin + WINDOW)
            segments = self.segments(text, at[begin : stop + LONGEST], stop - begin)
            mine: dict[int, list[tuple[int, np.ndarray]]] = {}
            for (i, j, _, _), row in zip(segments, self.scores(segments), strict=True):
                mine.setdefault(begin + j, []).append((begin + i, row))
            for j in range(begin + 1, stop + 1):
                here = j % (LONGEST + 1)
                best[here] = -np.inf
                for i, row in [*ends[here], *mine.pop(j, [])]:
                    through = best[i % (LONGEST + 1)][:, None] + self.step
                    prev = through.argmax(axis=0)
                    value = through[prev, range(len(TYPES))] + row
                    for y in np.flatnonzero(value > best[here]):
                        best[here, y], back[j, y] = value[y], (j - i, prev[y])
                ends[here] = []
            for j, own in mine.items():  # that end in the next slice
                ends[j % (LONGEST + 1)] += own
        out, j, y = [], n, int(best[n % (LONGEST + 1)].argmax())
        while j:
            i, before = j - int(back[j, y, 0]), int(back[j, y, 1])
            if y:
                out.append((TYPES[y], at[i][0], at[j - 1][1]))
            j, y = i, before
        return out[::-1]

    def gradient(self, segments, s: np.ndarray, n: int, gold: dict[tuple[int, int], int]) -> tuple[np.ndarray, np.ndarray]:
        """Of the log likelihood of the gold segmentation: per segment and type, and per step of types."""
        starts_, ends = [[] for _ in range(n + 1)], [[] for _ in range(n + 1)]
        for k, (i, j, _, _) in enumerate(segments):
            starts_[i].append(k)
            ends[j].append(k)
        a, b = np.full((n + 1, len(TYPES)), -np.inf), np.full((n + 1, len(TYPES)), -np.inf)
        a[0, 0] = 0
        enter = np.full((n + 1, len(TYPES)), -np.inf)  # into a segment of a type that starts here
        for j in range(n + 1):
            if j and ends[j]:
                a[j] = np.logaddexp.reduce([enter[segments[k][0]] + s[k] for k in ends[j]], axis=0)
            enter[j] = np.logaddexp.reduce(a[j][:, None] + self.step, axis=0)
        leave = np.full((n + 1, len(TYPES)), -np.inf)  # over all segments that start here, of a type
        b[n] = 0
        for i in range(n - 1, -1, -1):
            leave[i] = np.logaddexp.reduce([s[k] + b[segments[k][1]] for k in starts_[i]], axis=0)
            b[i] = np.logaddexp.reduce(self.step + leave[i][None, :], axis=1)
        total = np.logaddexp.reduce(a[n])
        g = np.array([-np.exp(enter[i] + s[k] + b[j] - total) for k, (i, j, _, _) in enumerate(segments)])
        h = -sum(np.exp(a[i][:, None] + self.step + leave[i][None, :] - total) for i in range(n))
        before, i = 0, 0
        where = {(i, j): k for k, (i, j, _, _) in enumerate(segments)}
        while i < n:
            j, y = next(((j, y) for (x, j), y in gold.items() if x == i), (i + 1, 0))
            g[where[i, j], y] += 1
            h[before, y] += 1
            before, i = y, j
        return g, h

    def train(self, rows: list[tuple[str, list[Span]]], epochs: int, rate: float = 0.3) -> None:
        data = []
        for text, spans in rows:
            at = [m.span() for m in _PIECE.finditer(text)]
            first, last = {a: i for i, (a, _) in enumerate(at)}, {b: i + 1 for i, (_, b) in enumerate(at)}
            gold = {(first[a], last[b]): TYPES.index(kind) for kind, a, b in spans}
            data.append((self.segments(text, at), len(at), gold))
        size, size_step = np.full_like(self.weights, 1e-6), np.full_like(self.step, 1e-6)
        for _ in range(epochs):
            for segments, n, gold in data:
                g, h = self.gradient(segments, self.scores(segments), n, gold)
                full = np.zeros_like(self.weights)
                for (_, _, ids, _), row in zip(segments, g, strict=True):
                    full[ids] += row
                full -= 0.002 * self.weights
                size += full**2
                size_step += h**2
                self.weights += rate * full / np.sqrt(size)
                self.step += rate * h / np.sqrt(size_step)


def _examples(count: int, seed: int = 5) -> list[tuple[str, list[Span]]]:
    """Sentences with marked entities, made from fixed forms, and with what looks like entities and is none."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghilmnoprstu") for _ in range(r.randint(2, 9)))
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    hexed = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))
    mixed = lambda n: "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n - 2)) + "a7"

    def card(good: bool) -> str:
        body = r.choice("3456") + digits(14)
        body += r.choice([c for c in "0123456789" if luhn(body + c) == good])
        return r.choice([body, *(s.join(body[i : i + 4] for i in range(0, 16, 4)) for s in "- .")])

    def phone() -> str:
        a, b, c = digits(3), digits(3), digits(4)
        return r.choice([f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+{digits(2)} {a} {b} {c}", f"+{digits(2)}{a}{b}{c}", f"0{digits(3)} {b} {c}", f"+{digits(2)} {digits(2)} {digits(4)} {digits(4)}"])

    def secret() -> str:
        key = r.choice(["password", "passwd", "token", "api_key", "secret", "auth_token"])
        value = r.choice([hexed(r.choice([18, 32, 40])), mixed(r.randint(8, 40))])
        return r.choice([f"{key}={value}", f'{key} = "{value}"', f"{key}: {value}", f"{key}='{value}'", "AKIA" + "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(15)) + "7", mixed(r.choice([20, 24, 36]))])

    def other() -> str:
        return r.choice([
            f"{digits(1)}.{digits(1)}", f"version {digits(1)}", digits(r.randint(1, 9)), f"{digits(2)}:{digits(2)}", f"{digits(4)}-{digits(2)}-{digits(2)}", f"{digits(1)}.{digits(2)}.{digits(1)}", f"{digits(3)},{digits(3)}",
            digits(r.choice([13, 16, 20])) + "0", card(False), f"300.{digits(3)}.999.{digits(1)}", f"p. {digits(3)}-{digits(3)}", f"@{word()}", f"{word()}{digits(2)}", f"({digits(4)})", f"20{digits(2)}-{digits(3)}-{digits(4)}", f"(19{digits(2)}) {digits(3)}-{digits(4)}",
            f"{r.choice(['sha', 'SHA', 'sha1', 'sha256', 'md5', 'commit', 'hash', 'checksum', 'revision', 'digest', 'etag'])}{r.choice([' ', ': ', '='])}{hexed(r.choice([16, 20, 32, 40]))}", f"{hexed(8)}-{hexed(4)}-{hexed(4)}-{hexed(4)}-{hexed(12)}",
            f"https://{word()}.org/{word()}/{mixed(r.randint(16, 30))}", f"/{word()}/{hexed(20)}/{word()}", f"{word()}/{hexed(32)}.png", f"ISBN {digits(3)}-{digits(1)}-{digits(4)}-{digits(4)}-{digits(1)}", f"no. {digits(3)}-{digits(2)}", f"{digits(2)}/{digits(2)}/20{digits(2)}",
            f"order {digits(10)}", f"{digits(1)}.{digits(8)}, {digits(2)}.{digits(6)}", f"{word().upper()}-{digits(4)}-{digits(4)}", f"x{digits(1)} x{digits(1)} x{digits(1)}", f"key {digits(3)}", f"token {digits(2)} of {digits(2)}",
        ])

    makers = {"email": lambda: f"{word()}{r.choice(['', '.', '_'])}{r.choice([word(), digits(2)])}@{word()}{r.choice(['', digits(1)])}.{r.choice([word() + '.', ''])}{r.choice(['com', 'org', 'net', 'de'])}", "ip": lambda: ".".join(str(r.randint(1, 255)) for _ in range(4)), "card": lambda: card(True), "phone": phone, "secret": secret, "none": other}
    out = []
    for _ in range(count):
        text, found = word(), []
        for _ in range(r.randint(1, 2)):
            kind = r.choice(("email", "ip", "card", "phone", "phone", "secret", "secret", *["none"] * 7))
            value = makers[kind]()
            text += r.choice([" ", ", ", ": ", " (" if kind != "none" else " "])
            if kind != "none":
                found.append((kind, len(text), len(text) + len(value)))
            text += value + r.choice(["", ".", ","]) + " " + word()
        out.append((text, found))
    return out


@lru_cache(maxsize=1)
def trained(count: int = 700, epochs: int = 5) -> SemiCrf:
    rows = _examples(count)
    names: dict[str, int] = {}
    for text, _ in rows:
        at = [m.span() for m in _PIECE.finditer(text)]
        for i in range(len(at)):
            word = text[at[i - 1][0] : at[i - 1][1]] if i else ""
            for j in range(i + 1, min(len(at), i + LONGEST) + 1):
                a, b = at[i][0], at[j - 1][1]
                if j == i + 1 or allowed(text[a:b]):
                    for f in features(text[a:b], text[a - 1 : a], text[b : b + 1], word):
                        names.setdefault(f, len(names))
    model = SemiCrf(names)
    model.train(rows, epochs)
    return model


def _windows(text: str) -> list[tuple[int, int]]:
    """Stretches around digits and @ signs with two words before and one after, joined where they meet.

    A run without white space is taken from AROUND characters before the piece with the digit or @ to as many after it.
    """
    out: list[list[int]] = []
    done = 0
    while m := _TRIGGER.search(text, done):
        a = m.start()
        while a > done and text[a - 1].isalnum():
            a -= 1
        run = text[max(done, a - AROUND) : a]
        a -= len(run) - (max(run.rfind(" "), run.rfind("\n"), run.rfind("\t")) + 1)
        b = _REST.match(text, m.end()).end()
        if end := _SPACE.search(text, b, b + AROUND):
            b = end.start()
        else:
            b = _REST.match(text, min(len(text), b + AROUND)).end()
        done = b
        for _ in range(2):
            a = max(text.rfind(" ", max(0, a - 40), max(0, a - 1)) + 1, a - 40, 0)
        b = end if (end := text.find(" ", b + 1, b + 40)) >= 0 else min(len(text), b + 40)
        if out and a <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def spans(text: str, model: SemiCrf | None) -> tuple[list[Span], list[Span]]:
    """The base spans, and all spans by kind and start."""
    base = base_spans(text)
    if model is None or not ("@" in text or _DIGIT.search(text)):
        return base, base
    more: list[Span] = []
    for a, b in _windows(text):
        at = [(x + a, y + a) for x, y in (m.span() for m in _PIECE.finditer(text[a:b]))]
        more += model.decode(text, at)
    taken = sorted((x, y) for _, x, y in base)
    ends = np.array([y for _, y in taken])
    free = []
    for s in more:
        k = int(np.searchsorted(np.maximum.accumulate(ends), s[1], side="right")) if len(ends) else 0
        if k >= len(taken) or taken[k][0] >= s[2]:
            free.append(s)
    order = {kind: i for i, kind in enumerate(TYPES[1:])}
    return base, sorted([*base, *free], key=lambda s: (order[s[0]], s[1]))


def joined(found: list[Span]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind, a, b in found)


def redacted(text: str, found: list[Span]) -> str:
    """The text with each span, or run of overlapping spans, replaced by the kind of the first in angle brackets."""
    out, at = [], 0
    for kind, a, b in sorted(found, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"<{kind}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: id_col, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (all, as kind:start:end), n_spans."""
    model = docs.sparkSession.sparkContext.broadcast(trained())

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        rows = [spans(t or "", model.value) for t in b.column(1).to_pylist()]
        counts = {f"n_{kind}": pa.array([sum(s[0] == kind for s in base) for base, _ in rows], pa.int64()) for kind in KINDS}
        digests = [hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in rows]
        return batch(id=b.column(0), **counts, base_sha256=pa.array(digests, pa.string()), spans=pa.array([joined(every) for _, every in rows], pa.string()), n_spans=pa.array([len(every) for _, every in rows], pa.int64()))

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long"
    return map_batches(docs.select(F.col(id_col), F.col(text_col).cast("string")), schema, run).withColumnRenamed("id", id_col)


def without_personal_data(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """docs, all columns, with every span of the text redacted; length_col, if there, counts the new text's code points."""
    model = docs.sparkSession.sparkContext.broadcast(trained())

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        i = b.schema.get_field_index(text_col)
        texts = [t if t is None else redacted(t, spans(t, model.value)[1]) for t in b.column(i).to_pylist()]
        columns = [*b.columns]
        columns[i] = pa.array(texts, b.schema.field(i).type)
        if length_col in b.schema.names:
            k = b.schema.get_field_index(length_col)
            columns[k] = pa.array([None if t is None else len(t) for t in texts], pa.int64()).cast(b.schema.field(k).type)
        return pa.RecordBatch.from_arrays(columns, schema=b.schema)

    return map_batches(docs, docs.schema, run)
