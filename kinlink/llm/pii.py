"""Personal data: fixed patterns, and a semi-Markov conditional random field that adds to them.

The field scores whole spans: a candidate is a run of tokens with a type, its features see all of its text
(shape, digits, checksums, the word before it), and a dynamic program over runs of bounded length chooses
boundaries and types together. It is trained here, by gradient steps on the exact log likelihood
(forward-backward over segments), on sentences that a fixed seed generates. Decoding runs on the
stretches of a text that hold digits or an at sign, wherever they are.
"""

from __future__ import annotations

import math
import random
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

KINDS = ("email", "ip", "card", "phone", "ssn", "iban")
_BASE = KINDS[:4]
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: A match can start only where a run of digits does, so the look-behind changes nothing but the time on long runs.
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    """Spans of the fixed patterns by kind, then start; each kind leftmost and without overlap."""
    if not text:
        return []
    out, last = [], 0
    at = text.find("@")
    while at >= 0:
        m, a = _DOMAIN.match(text, at), at
        while a > last and text[a - 1] in _LOCAL:
            a -= 1
        if m and a < at:
            out.append(("email", a, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    if not _DIGIT.search(text):
        return out
    out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(g.lstrip("0")) <= 3 and int(g.lstrip("0") or 0) <= 255 for g in m.groups())]
    for m in _CARD.finditer(text):
        if 16 <= m.end() - m.start() <= 37:
            d = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(d) <= 19 and luhn(d):
                out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= len(_DIGIT.findall(m[0])) <= 15]
    return out


TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|[^\sA-Za-z0-9]")
#: Chunks between blanks with a digit or an at sign, or (the group) with an IBAN's letters; possessive, so that a long chunk without one is read once.
_MARKED = re.compile(r"(?<!\S)(?:[^\s0-9@]*+[0-9@]\S*+|([A-Z]{1,4})(?![A-Za-z])\S*+)")
#: Tokens in a segment at most, and characters that a word is a cue for, from its end on.
LONGEST, CUE_CHARS = 17, 400
#: Segments whose best kinds a worker remembers, before it forgets them all; longer ones aren't remembered.
SEEN_KEPT, SEEN_CHARS = 200_000, 80
_CUES = {
    "ssn": "ssn", "social": "ssn", "security": "ssn", "iban": "iban", "account": "iban", "konto": "iban", "cuenta": "iban", "compte": "iban",
    "phone": "phone", "tel": "phone", "call": "phone", "telefon": "phone", "mobile": "phone", "fax": "phone",
    "card": "card", "visa": "card", "mastercard": "card", "credit": "card", "ip": "ip", "host": "ip", "address": "ip", "server": "ip",
    "mail": "email", "email": "email", "contact": "email", "version": "no", "order": "no", "page": "no", "year": "no", "item": "no", "isbn": "no",
}
_SSN = re.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?")
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_PHONELIKE = re.compile(r"\+?[0-9(][ ().0-9-]+[0-9]")
_WORD_BEFORE = re.compile(r"([A-Za-z]+)[^A-Za-z0-9]*(?:[A-Za-z]{1,3}[^A-Za-z0-9]+)?$")


def _iban_ok(s: str) -> bool:
    s = s.replace(" ", "")
    return len(s) >= 15 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def features(text: str, a: int, b: int, cue: str, n: int) -> list[str]:
    """What a whole candidate span shows. cue: of the word before it."""
    s = text[a:b]
    digits = sum(c.isdigit() for c in s)
    shape = re.sub(r"(.)\1+", r"\1", re.sub(r"[A-Za-z]", "a", re.sub(r"[0-9]", "9", s)))
    out = ["bias", "cue=" + cue, f"digits={min(digits, 20)}", f"tokens={n}"]
    out.append("shape=" + (shape if len(shape) < 12 else "long"))
    out.append(f"edge={int(a == 0 or not text[a - 1].isalnum() and text[a - 1] not in '.-@')}{int(b == len(text) or not text[b].isalnum() and text[b] not in '-@')}")
    if _EMAIL.fullmatch(s):
        out.append("email")
    if (m := _IP.fullmatch(s)) and all(len(g) <= 3 and int(g) <= 255 for g in m.groups()):
        out.append("ip")
    if _SSN.fullmatch(s):
        out += ["ssn", "ssn+" + cue]
    if _IBAN.fullmatch(s):
        out += ["iban", f"iban+{_iban_ok(s)}"]
    if 13 <= digits <= 19 and _CARD.fullmatch(s):
        out += ["cardlike", f"card+{luhn(re.sub('[^0-9]', '', s))}", f"card+{luhn(re.sub('[^0-9]', '', s))}+{cue}"]
    if 8 <= digits <= 15 and _PHONELIKE.fullmatch(s):
        out += ["phonelike", f"phone+{s[0] == '+'}", f"phone+{sum(c in ' ().-' for c in s) > 1}+{cue}"]
    return out


Lattice = tuple[list[tuple[int, int]], list[list[tuple[int, list[str]]]]]


def marked_tokens(text: str, lo: int, hi: int) -> tuple[list[tuple[int, int]], list[str]]:
    """Token places of a stretch, and of each the cue of the word before it."""
    tokens = [(m.start(), m.end()) for m in TOKEN.finditer(text, lo, hi)]
    m = _WORD_BEFORE.search(text, max(0, lo - 40), lo)
    cues, cue = [], _CUES.get(m[1].lower(), "") if m else ""
    until = lo + CUE_CHARS
    for a, b in tokens:
        cues.append(cue if a < until else "")
        if text[a].isalpha() and b - a > 1:
            cue, until = _CUES.get(text[a:b].lower(), ""), b + CUE_CHARS
    return tokens, cues


def segments(text: str, tokens: list[tuple[int, int]], j: int) -> list[int]:
    """First tokens of the candidate segments that end with token j."""
    return [i for i in range(max(0, j + 1 - LONGEST), j + 1) if i == j or text[tokens[i][0]].isalnum() or text[tokens[i][0]] in "+("]


def lattice(text: str, lo: int, hi: int) -> Lattice:
    """Token places of a stretch, and for each end the candidate segments (first token, features). Single tokens can also be outside."""
    tokens, cues = marked_tokens(text, lo, hi)
    return tokens, [[(i, features(text, tokens[i][0], tokens[j][1], cues[i], j - i + 1)) for i in segments(text, tokens, j)] for j in range(len(tokens))]


class Field:
    """Weights: a row for each feature, a column for each kind and, first, for outside (single tokens only)."""

    def __init__(self) -> None:
        self.index: dict[str, int] = {}
        self.weights = np.zeros((0, len(KINDS) + 1))
        self.seen: dict[tuple, tuple[float, int]] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"seen": {}}

    def best(self, text: str, a: int, b: int, cue: str, n: int) -> tuple[float, int]:
        """Score and kind (0: outside, for single tokens only) that suit a segment best; it depends on its text and neighbours."""
        key = (text[max(0, a - 1) : b + 1], a == 0, b == len(text), cue, n) if b - a <= SEEN_CHARS else None
        found = self.seen.get(key) if key else None
        if found is None:
            s = self.weights[[k for k in map(self.index.get, features(text, a, b, cue, n)) if k is not None]].sum(axis=0)
            if n > 1:
                s[0] = -np.inf
            kind = int(s.argmax())
            found = float(s[kind]), kind
            if key:
                if len(self.seen) >= SEEN_KEPT:
                    self.seen.clear()
                self.seen[key] = found
        return found

    def decode(self, text: str, lo: int, hi: int) -> list[tuple[str, int, int]]:
        tokens, cues = marked_tokens(text, lo, hi)
        best, back = [0.0], [None]
        for j in range(len(tokens)):
            top, how = -np.inf, None
            for i in segments(text, tokens, j):
                score, k = self.best(text, tokens[i][0], tokens[j][1], cues[i], j - i + 1)
                if best[i] + score > top:
                    top, how = best[i] + score, (i, k)
            best.append(top)
            back.append(how)
        out, j = [], len(tokens)
        while j:
            i, k = back[j]
            if k:
                out.append((KINDS[k - 1], tokens[i][0], tokens[j - 1][1]))
            j = i
        return out[::-1]

    def fit(self, examples: list[tuple[str, list[tuple[str, int, int]]]], epochs: int = 8, rate: float = 0.25, decay: float = 1e-4) -> None:
        places, ids = [], []
        for t, _ in examples:  # a sentence's names of features go as soon as they have numbers
            tokens, ends = lattice(t, 0, len(t))
            places.append(tokens)
            ids.append([[(i, np.array([self.index.setdefault(f, len(self.index)) for f in names], np.int32)) for i, names in own] for own in ends])
        self.weights = np.zeros((len(self.index), len(KINDS) + 1))
        for epoch in range(epochs):
            step = rate / (1 + epoch / 2)
            for (_, spans), tokens, cand in zip(examples, places, ids, strict=True):
                n = len(tokens)
                score = [[(i, self.weights[f].sum(axis=0)) for i, f in own] for own in cand]
                for j, row in enumerate(score):
                    for i, s in row:
                        if i < j:
                            s[0] = -np.inf
                forward = np.full(n + 1, -np.inf)
                forward[0] = 0
                for j, row in enumerate(score):
                    forward[j + 1] = _logsum([forward[i] + _logsum(s) for i, s in row])
                backward = np.full(n + 1, -np.inf)
                backward[n] = 0
                into: list[list[float]] = [[] for _ in range(n)]
                for j in range(n - 1, -1, -1):
                    for i, s in score[j]:
                        into[i].append(_logsum(s) + backward[j + 1])
                    backward[j] = _logsum(into[j]) if into[j] else -np.inf
                gold = {(a, b): KINDS.index(k) + 1 for k, a, b in spans}
                covered = {t for t, (a, b) in enumerate(tokens) for x, y in gold if x <= a and b <= y}
                for j, row in enumerate(score):
                    for (i, s), (_, f) in zip(row, cand[j], strict=True):
                        grad = -np.exp(np.minimum(0, forward[i] + s + backward[j + 1] - forward[n]))
                        k = gold.get((tokens[i][0], tokens[j][1]))
                        if k:
                            grad[k] += 1
                        elif i == j and i not in covered:
                            grad[0] += 1
                        if np.abs(grad).max() > 1e-4:
                            np.add.at(self.weights, f, step * grad)
            self.weights *= 1 - decay


def _logsum(values) -> float:
    m = max(values)
    return m if m == -np.inf else m + math.log(sum(math.exp(v - m) for v in values))


def _digits(r: random.Random, n: int) -> str:
    return "".join(r.choice("0123456789") for _ in range(n))


def _with_luhn(head: str) -> str:
    return next(head + d for d in "0123456789" if luhn(head + d))


def sample(r: random.Random) -> tuple[str, list[tuple[str, int, int]]]:
    """A sentence with labelled spans, or with numbers that are nobody's."""
    word = lambda: "".join(r.choice(("ta", "re", "in", "on", "sch", "que", "ment", "er", "ción", "au")) for _ in range(r.randint(1, 3)))
    octet = lambda: str(r.randint(0, 255))
    group = lambda s, sep: sep.join(s[i : i + 4] for i in range(0, len(s), 4))

    def iban() -> str:
        head, body = r.choice(("DE", "FR", "ES", "NL", "GB", "IT")), _digits(r, r.choice((14, 16, 18, 20)))
        if r.random() < 0.4:  # a bank code of letters, or a letter within the number
            at = r.choice((0, 0, r.randint(8, len(body) - 2)))
            body = body[:at] + "".join(r.choice("ABCDKLMNORTW") for _ in range(1 if at else r.choice((1, 4)))) + body[at:]
        check = 98 - int("".join(str(int(c, 36)) for c in f"{body}{head}00")) % 97
        return f"{head}{check:02d}{body}"

    text, spans = "", []
    for _ in range(r.randint(1, 3)):
        text += " ".join(word() for _ in range(r.randint(0, 3))) + " "
        kind = r.choice(KINDS + ("no",) * 6)
        cue = r.choice([c for c, k in _CUES.items() if k == kind]) if r.random() < 0.5 else word()
        if kind == "email":
            s = f"{r.choice((word(), _digits(r, 2), word() + '.' + word()))}@{word()}{r.choice(('', '7'))}.{r.choice(('example.com', 'org', 'net'))}".replace("ó", "o")
        elif kind == "ip":
            s = ".".join(octet() for _ in range(4))
        elif kind == "card":
            s = group(_with_luhn(_digits(r, 15)), r.choice(("", " ", "-")))
            if r.random() < 0.3:  # of 15 digits in groups of 4, 6 and 5
                s, sep = _with_luhn(r.choice(("34", "37")) + _digits(r, 12)), r.choice(("", " ", "-"))
                s = sep.join((s[:4], s[4:10], s[10:]))
        elif kind == "phone":
            s = r.choice((f"+{r.randint(1, 99)} ({_digits(r, 3)}) {_digits(r, 3)}-{_digits(r, 4)}", f"+{r.randint(1, 99)} {_digits(r, 3)} {_digits(r, 7)}", f"({_digits(r, 3)}) {_digits(r, 3)}-{_digits(r, 4)}", f"{_digits(r, 3)}-{_digits(r, 3)}-{_digits(r, 4)}"))
            if r.random() < 0.3:  # as written at home
                s = r.choice((" ".join(["0" + r.choice("123456789"), *(_digits(r, 2) for _ in range(4))]), f"0{_digits(r, 4)} {_digits(r, 6)}", f"0{_digits(r, 3)} {_digits(r, 7)}", f"{_digits(r, 3)}.{_digits(r, 3)}.{_digits(r, 4)}"))
        elif kind == "ssn":
            s = f"{_digits(r, 3)}-{_digits(r, 2)}-{_digits(r, 4)}"
        elif kind == "iban":
            s = group(iban(), r.choice(("", " ")))
        else:
            s = r.choice((str(r.randint(1, 2030)), f"{r.randint(0, 9)}.{r.randint(0, 9)}", f"{r.randint(1, 12)}.{r.randint(0, 30)}.{r.randint(0, 9)}", f"{r.randint(1900, 2030)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}", f"{r.randint(0, 23)}:{r.randint(0, 59):02d}", f"{r.randint(1, 999)},{_digits(r, 3)}", _digits(r, r.randint(5, 14)), f"978-{_digits(r, 1)}-{_digits(r, 4)}-{_digits(r, 4)}-{_digits(r, 1)}", f"{300 + r.randint(0, 600)}.{octet()}.{octet()}.{octet()}", f"@{word()}", f"{word()}{_digits(r, 2)}", "".join(r.choice("0123456789abcdef") for _ in range(r.choice((16, 32, 40)))), "".join(r.choice("0123456789ABCDEF") for _ in range(40)), f'token = "{r.getrandbits(160):040x}"', f"{r.getrandbits(160):040x}".upper(), f"{_digits(r, 2)}/{_digits(r, 2)}/{_digits(r, 4)}", " ".join(_digits(r, r.randint(1, 3)) for _ in range(r.randint(2, 4))), f"{_digits(r, 3)},{_digits(r, 3)}.{_digits(r, 2)}"))
        text += cue + r.choice((" ", ": ", " "))
        if kind != "no":
            spans.append((kind, len(text), len(text) + len(s)))
        text += s + r.choice((" ", ". ", ", ", "!! "))
    return text, spans


@cache
def trained(sentences: int = 560, seed: int = 7) -> Field:
    """The field, made from ``sentences`` generated ones: the same in every process."""
    r = random.Random(seed)
    field = Field()
    field.fit([sample(r) for _ in range(sentences)])
    return field


def stretches(text: str) -> Iterator[tuple[int, int]]:
    """Stretches of chunks that hold a digit or at sign, with blanks only or an IBAN's groups of letters between them and after."""
    lo = hi = -1
    for m in _MARKED.finditer(text):
        a, b = m.span()
        if lo >= 0 and not text[hi:a].strip(" "):
            hi = b
            continue
        if lo >= 0:
            yield lo, hi
        lo, hi = (a, b) if m[1] is None else (-1, -1)
    if lo >= 0:
        yield lo, hi


def find_spans(text: str | None, field: Field) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and those that the field adds: they overlap no base span. A stretch is decoded whole, however long it is."""
    own = base_spans(text)
    starts, ends = [], []  # of the base spans' union: both ascend
    for a, b in sorted((a, b) for _, a, b in own):
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    more = []
    for lo, hi in stretches(text or ""):
        near = range(bisect_right(ends, lo), bisect_left(starts, hi))
        if sum(min(ends[k], hi) - max(starts[k], lo) for k in near) >= hi - lo - 4:
            continue
        more += [(k, a, b) for k, a, b in field.decode(text, lo, hi) if bisect_right(ends, a) == bisect_left(starts, b)]
    return own, more


def find_personal_data(documents: DataFrame, *, text: str = "text", redact: bool = False) -> DataFrame:
    """``documents`` with spans (kind, start, end, base); with ``redact``, with ``text`` in which every span is ``[KIND]`` instead.

    Spans go by kind as KINDS lists them, then start. A null text has none and stays null; equal rows get equal spans;
    columns named like the new one are replaced.
    """
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(trained())
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))
    kept = [f for f in documents.schema.fields if f.name != "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = shared.value
        for batch in batches:
            found, clean = [], []
            for t in batch.column(text).to_pylist():
                own, more = find_spans(t, field)
                spans = sorted([(KINDS.index(k), a, b, True) for k, a, b in own] + [(KINDS.index(k), a, b, False) for k, a, b in more])
                found.append([{"kind": KINDS[k], "start": a, "end": b, "base": o} for k, a, b, o in spans])
                clean.append(redacted(t, spans) if redact and spans else t)
            columns = {f.name: batch.column(f.name) for f in kept}
            if redact:
                columns[text] = pa.array(clean, batch.schema.field(text).type)
            yield pa.RecordBatch.from_arrays([*columns.values(), pa.array(found, span)], [*columns, "spans"])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", spans array<struct<kind:string,start:bigint,end:bigint,base:boolean>>"
    return documents.select([f.name for f in kept]).mapInArrow(run, ddl)


def redacted(text: str, spans: list[tuple[int, int, int, bool]]) -> str:
    """Spans of different kinds can overlap; such a union is named by the first."""
    out, at = [], 0
    for k, a, b, _ in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{KINDS[k].upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"))
    line = lambda a: F.concat_ws(",", F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
    base = F.filter("spans", lambda s: s["base"])
    of = lambda k: F.filter(base, lambda s: s["kind"] == F.lit(k))
    counts = [F.size(of(k)).cast("bigint").alias(f"n_{k}") for k in _BASE]
    return found.select("doc_id", *counts, F.sha2(line(base).cast("binary"), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"))
