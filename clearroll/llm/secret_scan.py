"""Secrets in texts: fixed patterns, and assignments read as name-literal pairs."""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spans import SPAN, in_order
from .store import per_text

BASE = ["assign", "access", "hex"]
KINDS = [*BASE, "literal"]

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")

#: How sure a part of a name makes it that what it names is secret.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "pwd": 0.9, "passphrase": 1.0, "secret": 1.0, "token": 0.9, "apikey": 1.0,
    "credential": 0.9, "credentials": 0.9, "auth": 0.7, "bearer": 0.8, "privatekey": 1.0, "accesskey": 0.9,
    "secretkey": 1.0, "signingkey": 0.9, "encryptionkey": 0.9, "connectionstring": 0.8, "salt": 0.6,
}
PLACEHOLDER = re.compile(r"(?i)^(?:x+|\*+|\.+|<.*>|your.*|example.*|change.?me.*|placeholder.*|dummy.*|none|null|true|false|todo.*|redacted.*|test)$")
OPENING = re.compile(r"(?i)your|example|change.?me|placeholder|dummy|todo|redacted")
THRESHOLD = 0.5
#: First code points of a value that are kept, as many as a placeholder's opening may have; where lengths and counts stop.
HEAD, MOST = 16, 1 << 60

_OPERATOR = re.compile(r"(?<![=!<>:])(?:=>|:=|=(?![=>])|:(?![:/=]))")
_LETTER = re.compile(r"[A-Za-z_]")
_IN_NAME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_.-")
_LONG = re.compile(r"""[ \t]*(?:[A-Za-z]{1,2}(?=["']))?(\"{3}|'{3}|`)""")
_TERM = re.compile(
    r"""[ \t]*(?:(?:[A-Za-z]{1,2}|u8)?(?:"((?:[^"\\\n]|\\.)*)"|'((?:[^'\\\n]|\\.)*)')|\$\{?([A-Za-z_]\w*)\}?(?![^\s"'(){}\[\],;<>+=])"""
    r"""|((?:[^\s"'`(){}\[\],;<>$+=]|\$(?![A-Za-z_{]))[^\s"'`(){}\[\],;<>+=]*=*)|\$\{?([A-Za-z_]\w*)\}?)(\()?"""
)
_GAP = re.compile(r"(?:\s|\\\n|#[^\n]*\n|//[^\n]*\n)*")
_NEXT_LINE = re.compile(r"[ \t]*\\?\r?\n\s*")
_BLOCK = re.compile(r"[ \t]*[|>][-+0-9]{0,2}[ \t]*\r?\n")
_BELOW = re.compile(r"[ \t]*(?:[|>][-+0-9]{0,2}[ \t]*|\\)\r?\n")
_LINE = re.compile(r"([ \t]*)([^\n]*)(?:\n|\Z)")
_BLANKS = re.compile(r"[ \t]*")
_REST = re.compile(r"[^\S\n]*(?:\n|\Z)")
_ITEM = re.compile(r"-[ \t]+")
_KEY_NEXT = re.compile(r"[ \t]*(?:=(?!=)|:(?!:))")
_JOIN = re.compile(r"[ \t]*(?:\+|\.\.)(?!=)")
_ELEMENT = re.compile(r"<([A-Za-z_][\w.-]*)>([^<>\n]+)</\1>")
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
_PLAIN = re.compile(r"[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)*")


def name_weight(name: str) -> float:
    """How sensitive a target name is: its best part, or pair of neighbouring parts, in any case style and number."""
    parts = [p.lower() for p in _WORDS.findall(name)]
    pairs = [a + b for a, b in zip(parts, parts[1:])]
    return max((max(SENSITIVE.get(p, 0.0), SENSITIVE.get(p.removesuffix("s"), 0.0)) for p in [*parts, *pairs]), default=0.0)


class Literal:
    """What scoring needs of a value: its length, characters and ends, not its text; and the values it is joined from.

    Characters are counted by the last eight bits of their code points, and counts of more
    than ``MOST`` are halved together, so joining costs the same however long a value gets.
    """

    __slots__ = ("size", "counts", "head", "last", "blank", "kinds", "parts", "span", "score")

    def __init__(self, text: str = "", span: tuple[int, int] | None = None):
        self.size, self.head, self.last, self.parts, self.span, self.score = len(text), text[:HEAD], text[-1:], [], span, 0.0
        chars = Counter(text)
        self.counts = Counter()
        for c, n in chars.items():
            self.counts[ord(c) & 255] += n
        self.blank = any(c.isspace() for c in chars)
        self.kinds = sum(1 << i for i, test in enumerate((str.islower, str.isupper, str.isdigit, lambda c: not c.isalnum())) if any(map(test, chars)))

    def weight(self) -> float:
        """How much the value looks like a key: length, entropy and kinds of characters; placeholders have none."""
        if self.size < 8 or self.blank or self.placeholder():
            return 0.0
        total = self.counts.total()
        shares = [k / total for k in self.counts.values()]
        entropy = -sum(p * math.log2(p) for p in shares if p)
        return min(1.0, 0.3 * min(16, self.size) / 16 + 0.45 * min(1, entropy / 3.5) + 0.25 * (self.kinds.bit_count() - 1) / 2)

    def placeholder(self) -> bool:
        if self.size <= HEAD:
            return bool(PLACEHOLDER.match(self.head))
        if set(self.counts) <= {ord("x"), ord("X")} or len(self.counts) == 1 and self.head[0] in "*.":
            return True
        return self.head[0] == "<" and self.last == ">" or bool(OPENING.match(self.head))


def joined_of(parts: list[Literal], made: list[Literal]) -> Literal:
    """The parts as one value; a new one is added to ``made``."""
    if len(parts) == 1:
        return parts[0]
    out = Literal()
    for p in parts:
        if out.size < HEAD:
            out.head = (out.head + p.head)[:HEAD]
        out.size += p.size
        out.counts.update(p.counts)
        out.last = p.last or out.last
        out.blank |= p.blank
        out.kinds |= p.kinds
    total = out.counts.total()
    if total > MOST:
        by = (total // MOST).bit_length()
        out.counts = Counter({c: max(1, n >> by) for c, n in out.counts.items()})
    out.size = min(out.size, MOST)
    out.parts = parts
    made.append(out)
    return out


def name_before(text: str, least: int, end: int) -> str | None:
    """The target name that ends at ``end``, quotes, a bracket and blanks aside, however long; it begins at ``least`` or later."""
    if end > least and text[end - 1] == "\n":
        end -= 1
    while end > least and text[end - 1] in " \t":
        end -= 1
    for closing in ("]", "\"'"):
        if end > least and text[end - 1] in closing:
            end -= 1
    at = end
    while at > least and text[at - 1] in _IN_NAME:
        at -= 1
    m = _LETTER.search(text, at, end)
    return text[m.start() : end] if m else None


def lines_of(text: str, start: int, end: int) -> list[tuple]:
    """The lines of a long literal as terms of one concatenation, without blanks around them and the lines that frame a key."""
    terms, at = [], start
    for line in text[start:end].split("\n"):
        bare = line.strip()
        if bare and not bare.startswith("-----"):
            a = at + line.index(bare)
            terms.append(("lit", bare, a, a + len(bare)))
        at += len(line) + 1
    return terms


class Values:
    """Reads the values of assignments of one text."""

    def __init__(self, text: str):
        self.text, self.open = text, set()  # quotes that no later quote closes
        self.called = 0  # up to where a word that is called goes
        self.lines = None  # where lines start

    def indent(self, at: int) -> int:
        """The blanks before the line that ``at`` is in."""
        if self.lines is None:
            self.lines = [0, *[m.end() for m in re.finditer("\n", self.text)]]
        line = self.lines[bisect_right(self.lines, at) - 1]
        return _BLANKS.match(self.text, line).end() - line

    def column(self, at: int) -> int:
        self.indent(at)
        return at - self.lines[bisect_right(self.lines, at) - 1]

    def term(self, at: int) -> tuple[list[tuple], int] | None:
        """The terms of one literal, reference or bare word at ``at`` and its end; a call gives no terms and end -1."""
        text, long = self.text, _LONG.match(self.text, at)
        if at < self.called:
            return [], -1
        if long and long.group(1) not in self.open:
            quote, start = long.group(1), long.end()
            end = text.find(quote, start)
            while end > start and self.escaped(start, end):
                end = text.find(quote, end + 1)
            if end >= 0:
                return lines_of(text, start, end), end + len(quote)
            self.open.add(quote)
        t = _TERM.match(text, at)
        if not t:
            return None
        double, single, whole, bare, part, call = t.groups()
        if call:
            self.called = t.end() - 1
            return [], -1
        if double is not None or single is not None:
            k = 1 if double is not None else 2
            return [("lit", t.group(k), t.start(k), t.end(k))], t.end()
        if bare is None:
            return [("ref", whole or part)], t.end()
        word = bare.rstrip(".:")
        kind = ("ref", word) if _PLAIN.fullmatch(word) else None
        return [("bare", word, t.start(4), t.start(4) + len(word), kind)], t.end()

    def escaped(self, start: int, at: int) -> bool:
        """Whether an odd number of backslashes stands before ``at``."""
        k = at
        while k > start and self.text[k - 1] == "\\":
            k -= 1
        return (at - k) % 2 == 1

    def joined(self, at: int) -> tuple[list[tuple], int]:
        """The terms of a concatenation and where it ends."""
        terms, end = [], at
        while (found := self.term(at)) is not None:
            if found[1] < 0:
                return [], end
            terms += found[0]
            at = end = found[1]
            j = _JOIN.match(self.text, at)
            if not j:
                break
            at = j.end()
        return terms, end

    def bracket(self, at: int) -> tuple[list[list[tuple]], int]:
        """The values within brackets that open at ``at``, over line breaks, up to what is no plain value: a call, a key, a brace."""
        text, depth, values, now, plus = self.text, 0, [], [], False
        while at < len(text):
            at = _GAP.match(text, at).end()
            c = text[at : at + 1]
            if c in ("(", "["):
                depth, at = depth + 1, at + 1
            elif c in (")", "]", ","):
                if now:
                    values.append(now)
                now, at = [], at + 1
                depth -= c != ","
                if not depth:
                    break
            elif c == "+" and now:
                at, plus = at + 1, True
            else:
                found = self.term(at)
                if found is None or found[1] < 0 or _KEY_NEXT.match(text, found[1]):
                    break
                bare = found[0] and found[0][0][0] == "bare" and text[at - 1 : at] in (" ", "\t", "\n") and now and now[-1][0] == "bare" and not plus
                if bare:  # two words in a row are no value
                    now = []
                    break
                if found[0] and found[0][0][0] == "bare" and text[found[1] - 1] == "=" and text[found[1] : found[1] + 1].strip(",;)]"):
                    break  # a keyword, not padding
                now.extend(found[0])
                at, plus = found[1], False
        return [*values, now] if now else values, at

    def below(self, name_at: int, at: int) -> tuple[list[list[tuple]], int]:
        """The values on the lines after an operator: a block, a list of items, or one value."""
        text, indent = self.text, self.indent(name_at)
        block = _BLOCK.match(text, at)
        if block:
            end = block.end()
            while end < len(text):
                m = _LINE.match(text, end)
                if m.group(2).strip() and len(m.group(1)) <= indent:
                    break
                end = m.end()
            terms = lines_of(text, block.end(), end)
            return [terms] if terms else [], end
        m = _NEXT_LINE.match(text, at)
        if not m:
            return [], at
        start, values, end = m.end(), [], at
        if text[start : start + 1] in ("(", "["):
            return self.bracket(start)
        while item := _ITEM.match(text, start):
            terms, stop = self.joined(item.end())
            rest = _REST.match(text, stop)
            if not terms or not rest or self.column(start) < indent:
                break
            values.append(terms)
            end = stop
            start = _GAP.match(text, rest.end()).end()
        if values or item:
            return values, end
        terms, stop = self.joined(start)
        quoted = terms and all(t[0] == "lit" for t in terms)
        deeper = self.column(start) > indent
        if not terms or _KEY_NEXT.match(text, stop) or not (quoted or deeper and _REST.match(text, stop)):
            return [], at
        if terms[-1][0] == "bare" and text[terms[-1][3] : stop]:  # a key of its own, "name:"
            return [], at
        return [terms], stop


def pairs(text: str) -> list[tuple[str, list[tuple], bool]]:
    """``(name, terms, again)`` of every assignment, mapping entry, attribute and element, in text order.

    A term is ``("lit", value, start, end)`` or ``("ref", name)``; several terms are a
    concatenation.  Strings may have prefixes, triple quotes or backticks; values may stand
    in brackets, on the next line or in a block, and a list gives an entry per value, all
    but the first ``again``.  Calls are not literals.  ``name: type = value`` binds the name.
    """
    found, prev, last = [], 0, None
    values = Values(text)
    for op in _OPERATOR.finditer(text):
        if op.start() < prev:
            continue
        name = name_before(text, prev, op.start())
        if name is None and last and op.group() == "=" and not text[prev : op.start()].strip():
            name = last  # what stood between was a type
            found.pop()
        prev, last = op.end(), None
        if name is None:
            continue
        terms, end = ([], 0) if _BELOW.match(text, op.end()) else values.joined(op.end())
        if terms:
            found.append((name, terms, False))
            prev = end
            last = name if len(terms) == 1 and terms[0][0] == "bare" else None
            continue
        at = op.end()
        while text[at : at + 1] in (" ", "\t"):
            at += 1
        many, end = values.bracket(at) if text[at : at + 1] in ("(", "[") else values.below(op.start(), op.end())
        if many:
            found += [(name, one, n > 0) for n, one in enumerate(many)]
            prev = end
    if "</" in text:
        found += [(m.group(1), [("lit", m.group(2), m.start(2), m.end(2))], False) for m in _ELEMENT.finditer(text)]
    return found


def literals(text: str) -> list[tuple[int, int, float]]:
    """``(start, end, score)`` of literals that reach a sensitive name, directly or through constants.

    A reference means the last value its name has been given before, else the first one it
    is given later.  Every constant is worked out once, whatever uses it, with a stack of
    its own instead of recursion; one that needs itself counts as the bare word it is.
    """
    bound: list[tuple[str, list[list[tuple]]]] = []
    for name, terms, again in pairs(text):
        if again:
            bound[-1][1].append(terms)
        else:
            bound.append((name, [terms]))
    weights = [name_weight(name) for name, _ in bound]
    if not any(weights):
        return []
    where: dict[str, list[int]] = {}
    for g, (name, _) in enumerate(bound):
        where.setdefault(name, []).append(g)

    def target(term: tuple, g: int) -> int | None:
        name = term[1] if term[0] == "ref" else term[4][1] if term[0] == "bare" and term[4] else None
        places = where.get(name)
        if not places:
            return None
        k = bisect_left(places, g)
        if k:
            return places[k - 1]
        return next((p for p in places[:2] if p != g), None)

    made: list[Literal] = []
    values: list[list[Literal] | None] = [None] * len(bound)  # of every entry of a binding
    wholes: list[Literal | None] = [None] * len(bound)
    entered = [False] * len(bound)

    def value(term: tuple, g: int) -> list[Literal]:
        to = target(term, g)
        if to is not None and wholes[to] is not None:
            return [wholes[to]]
        if term[0] == "ref":
            return []
        leaf = Literal(term[1], (term[2], term[3]))
        made.append(leaf)
        return [leaf]

    for root in [g for g, w in enumerate(weights) if w]:
        stack = [root]
        while stack:
            g = stack[-1]
            if not entered[g]:
                entered[g] = True
                needs = {target(t, g) for terms in bound[g][1] for t in terms} - {None}
                stack += [n for n in sorted(needs, reverse=True) if not entered[n]]
                continue
            stack.pop()
            if values[g] is None:
                values[g] = [joined_of([v for t in terms for v in value(t, g)], made) for terms in bound[g][1]]
                wholes[g] = joined_of(values[g], made)
    for g, weight in enumerate(weights):
        for v in values[g] if weight else ():
            score = weight * v.weight()
            if score >= THRESHOLD:
                v.score = max(v.score, score)
    out = []
    for v in reversed(made):  # parts are made before what they are joined to
        if v.score:
            for p in v.parts:
                p.score = max(p.score, v.score)
            if v.span and v.span[1] > v.span[0]:
                out.append((*v.span, v.score))
    return sorted(out)


def scan(text: str | None) -> list[tuple]:
    """``(kind, start, end, value_start, score)`` of all secrets of a text, base patterns first."""
    found = []
    if not text:
        return found
    assigns = "=" in text or ":" in text
    if assigns:
        found += [("assign", m.start(), m.end(), m.start(2), 1.0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        found += [("access", m.start(), m.end(), m.start(), 1.0) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [("hex", m.start(), m.end(), m.start(), 1.0) for m in HEX.finditer(text)]
    if assigns or "</" in text:
        base = sorted((s, e) for _, s, e, _, _ in found)
        starts, reach = [s for s, _ in base], list(accumulate((e for _, e in base), max))
        for a, b, score in literals(text):
            k = bisect_right(starts, a)
            if not k or reach[k - 1] < b:
                found.append(("literal", a, b, a, score))
    return found


def find_secrets(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns and ``secrets``, the spans of every row (empty for null or clean texts).

    Offsets are code points, ends exclusive.  ``assign``, ``access`` and ``hex`` are fixed
    patterns; ``literal`` spans come from name-literal pairs whose target name is sensitive,
    with constants propagated, and lie in no base span.  Repeated rows and empty tables pass through.
    """
    return per_text(docs, text, [("secrets", SPAN)], lambda: lambda texts: [[in_order(scan(t), KINDS) for t in texts]], keep, encode=False)


def redacted(text: str | None, mark: str = "[SECRET]") -> str | None:
    """The text with every secret value replaced; names before it stay."""
    spans = sorted((v, e) for _, _, e, v, _ in scan(text))
    if not spans:
        return text
    out, at, end = [], 0, -1
    for a, b in spans:
        if a < end:
            end = max(end, b)
            at = end
            continue
        out += [text[at:a], mark]
        at = end = b
    return "".join(out) + text[at:]


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs``, same columns in the same order, with secret values of ``text`` replaced; an ``n_chars`` column is counted anew."""
    out = per_text(docs, text, [("_clean", "string")], lambda: lambda texts: [[redacted(t, mark) for t in texts]], encode=False)
    clean = F.col(f"`{out.columns[-1]}`")
    changed = {text: clean}
    if "n_chars" in docs.columns:
        same = clean.eqNullSafe(F.col(f"`{text}`"))
        changed["n_chars"] = F.when(same, F.col("n_chars")).otherwise(F.length(clean)).cast(docs.schema["n_chars"].dataType)
    return out.select(*[changed[c].alias(c) if c in changed else F.col(f"`{c}`") for c in docs.columns])
