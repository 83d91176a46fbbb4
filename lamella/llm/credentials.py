"""Secrets in texts: fixed patterns, and a guess-cost dynamic program on credential values.

The program splits a value into words, dates, repeats, keyboard walks and brute-force
stretches so that the product of guesses is least. A value behind a credential name that
would take many guesses is a secret even where no fixed pattern knows it.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamella.llm.common import map_rows, table

# The base patterns, their kinds in order, and the least lengths.
ASSIGN = r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex")
ORDER = (*KINDS, "guess")
LEAST = {"assign": 6, "access": 20, "hex": 24}

#: Names of credentials for the method, with a suffix such as _PROD, up to where the value
#: begins; a scheme word before the value is passed over. ``bearer`` needs no mark after it.
NAME = (
    r"""(?ai:pass(?:word|wd|phrase|code|key)?|pwd|secret|token|(?:api|access|private|secret|auth|encryption)[_-]?key"""
    r"""|client[_-]?secret|auth(?:orization)?|credentials?|bearer)(?:(?:[_.\-0-9]|(?<=[a-z])[A-Z])[A-Za-z0-9_.-]{0,32}+)?"""
)
SCHEME = r"""(?P<{}>(?ai:bearer|basic|token|digest|apikey)[\x20\t]+)?"""
CONTEXT = (
    rf"""(?:{NAME}["']?[\x20\t]*(?::=|=>|[:=])[\x20\t]*{SCHEME.format("scheme")}|(?P<bare>\b(?ai:bearer)[\x20\t]+))"""
)
#: A bare value goes up to white space, quotes and tags, a quoted one up to its closing quote.
QUOTES = "\"'`"
BARE = r"""["'`]?([^\s"'`<>]++)"""
#: The part of a bare value before a closing mark, and marks at its end.
SHORT = r"""["'`]?([^\s"'`<>,;(){}\[\]|]*)"""
MARKS = ".:,;(){}[]|"
#: A bare value that goes on in the code around it: a call, an index, or a further named value.
CODE = r"[A-Za-z_][\w.]*[(\[{].*|.*[,;(){}\[\]|][\w.-]+(?::=|=>|[:=]).*"
#: Pieces with a vowel and without a long run of consonants, of one letter case or with a
#: capital, each with a number at most: words, names and paths, not random characters.
WORDLIKE = (
    r"(?:(?=[a-z]*[aeiouyAEIOUY]|[A-Z][a-z]*[aeiouy]|[A-Z]*[AEIOUY])(?![a-zA-Z]?[b-df-hj-np-tv-xz]{5})"
    r"(?:[A-Z]?[a-z]{2,}|[A-Z]{3,})(?:(?<=[a-z])(?![a-z])|(?<=[A-Z])(?![A-Z]))\d*+|\d++)"
)
WORDLIKE = rf"[^\w\s]*{WORDLIKE}(?:[^\w]*_*{WORDLIKE})*+[^\w\s]*"

#: A text without any of these, in lower case, has neither base assignments nor contexts.
CUES = ("pass", "pwd", "secret", "token", "key", "auth", "credential", "bearer")

#: A value is a secret from this many characters and guesses (log10) on: GUESSES if it is made
#: of words, or else as many as LENGTH unknown characters take.
GUESSES = 10.0
LENGTH = 8

#: Common passwords and words of placeholders, most common first: the rank is the guess number.
WORDS = """password qwerty admin welcome letmein monkey dragon master login hello secret test root user guest
default changeme example sample demo token pass passwd access public private key api value string name your my
the this that here there none null true false undefined todo xxxx placeholder insert enter hidden redacted
sunshine princess football baseball shadow superman michael jordan hunter summer winter spring autumn monday
friday january june july august december love money freedom whatever trustno blink server client system
database mysql postgres oracle service account email mail google github amazon aws azure cloud local host
localhost dev prod stage config env bearer basic auth session cookie""".split()
RANK = {w: k + 1 for k, w in reversed(list(enumerate(WORDS)))}
LONGEST = max(map(len, WORDS))
LEET = str.maketrans("@4310$57", "aaeiosst")
ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
NEAR = {frozenset(p) for row in ROWS for p in zip(row, row[1:])} | {
    frozenset(p) for a, b in zip(ROWS, ROWS[1:]) for k in range(len(b)) for p in ((a[k + 1 : k + 2] or "", b[k]), (a[k : k + 1], b[k])) if p[0]
}
DATE = re.compile(r"(?:(?:19|20)\d\d([-/._]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])([-/._]?)(?:0[1-9]|1[0-2])\2(?:19|20)?\d\d|(?:19|20)\d\d)")
#: log10 guesses of one unknown character, of starting a further part, and of a date.
BRUTE = 1.0
PART = 0.3
DATE_COST = math.log10(365 * 130)
YEAR_COST = math.log10(130)


def guess_cost(value: str) -> float:
    """log10 of the guesses of the cheapest segmentation; linear in the length of the value."""
    n = len(value)
    low = value.lower() if len(value.lower()) == n else value
    plain = low.translate(LEET)
    # best[i]: least cost of the first i characters; brute[i]: the same, with an open brute-force part.
    best, brute = [0.0] + [math.inf] * n, [math.inf] * (n + 1)
    # Maximal runs: a repeat of one unit of up to four characters, or a keyboard walk.
    for i in range(n):
        at = best[i] + (PART if i else 0.0)
        # Brute force: one more character of an open part, or a new part.
        brute[i + 1] = min(brute[i] + BRUTE, at + BRUTE)
        best[i + 1] = min(best[i + 1], brute[i + 1])
        for j in range(i + 3, min(n, i + LONGEST) + 1):
            rank = RANK.get(low[i:j])
            extra = 0.0
            if rank is None and (rank := RANK.get(plain[i:j])) is not None:
                extra = math.log10(2) * sum(a != b for a, b in zip(low[i:j], plain[i:j], strict=True))
            if rank is not None:
                upper = sum(a != b for a, b in zip(value[i:j], low[i:j], strict=True))
                best[j] = min(best[j], at + math.log10(rank + 1) + extra + math.log10(1 + upper))
        if (date := DATE.match(low, i)) is not None:
            j = date.end()
            best[j] = min(best[j], at + (YEAR_COST if j - i == 4 else DATE_COST))
        for j, cost in _repeats(low, i):
            best[j] = min(best[j], at + cost)
        for j, cost in _walks(low, i):
            best[j] = min(best[j], at + cost)
    return best[n]


def _repeats(low: str, i: int) -> list[tuple[int, float]]:
    """Ends and costs of a repeated unit that starts a run at ``i``."""
    out = []
    for unit in range(1, 5):
        if i >= unit and low[i - unit : i] == low[i : i + unit]:
            continue  # inside a run, which was seen from its start
        j = i + unit
        while low[j : j + unit] == low[i : i + unit] and j + unit <= len(low):
            j += unit
        if j - i >= max(3, 2 * unit):
            out.append((j, unit * BRUTE + math.log10((j - i) // unit)))
    return out


def _walks(low: str, i: int) -> list[tuple[int, float]]:
    """Ends and costs of a keyboard walk or of consecutive characters that starts at ``i``."""
    out = []
    if i and frozenset(low[i - 1 : i + 1]) in NEAR and i + 1 < len(low) and frozenset(low[i : i + 2]) in NEAR:
        pass  # inside a walk, which was seen from its start
    else:
        j = i + 1
        while j < len(low) and frozenset(low[j - 1 : j + 1]) in NEAR:
            j += 1
        if j - i >= 3:
            out.append((j, math.log10(47) + math.log10(j - i) + 0.3))
    if i + 2 < len(low):
        step = ord(low[i + 1]) - ord(low[i])
        if step in (1, -1) and not (i and ord(low[i]) - ord(low[i - 1]) == step):
            j = i + 1
            while j < len(low) and ord(low[j]) - ord(low[j - 1]) == step:
                j += 1
            if j - i >= 3:
                out.append((j, math.log10(26) + math.log10(j - i)))
    return out


class Scanner:
    """Spans of secrets in a text."""

    def __init__(self, guesses: float = GUESSES, length: int = LENGTH):
        self.guesses, self.length = guesses, length
        self.assign, self.context = re.compile(ASSIGN), re.compile(CONTEXT)
        self.inner, self.bare, self.short, self.code, self.wordlike = map(
            re.compile, (SCHEME.format("inner"), BARE, SHORT, CODE, WORDLIKE)
        )
        # The runs of ACCESS and HEX are maximal, so the least length may be asked for at once.
        self.access = re.compile(f"{ACCESS[:-1]}{{{LEAST['access'] - 4},}}")
        self.hex = re.compile(f"{HEX[:-1]}{{{LEAST['hex']},}}")

    def base(self, text: str, cued: bool = True) -> list[tuple[int, int, str]]:
        found = []
        if cued:
            found += [(m.start(), m.end(), "assign") for m in self.assign.finditer(text) if len(m[2]) >= LEAST["assign"]]
        if "AKIA" in text:
            found += [(m.start(), m.end(), "access") for m in self.access.finditer(text)]
        found += [(m.start(), m.end(), "hex") for m in self.hex.finditer(text)]
        return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))

    def guessed(self, text: str) -> list[tuple[int, int, str]]:
        """Values in a credential context that take many guesses."""
        found, end = [], 0
        for m in self.context.finditer(text):
            if m.start() < end:
                continue  # inside a value that was judged
            for at, value, strict in self.values(text, m.end(), bool(m["scheme"] or m["bare"])):
                if len(value) >= self.length and self.hard(value, strict):
                    end = at + len(value)
                    found.append((at, end, "guess"))
                    break
            else:
                end = self.short.match(text, m.end()).end()
        return found

    def values(self, text: str, at: int, strict: bool):
        """What may be the value at a place, longest first: (start, value, whether words are none)."""
        if (quoted := self.quoted(text, at)) is not None:
            start, value, inner = quoted
            # Words of prose in quotes are no value; its first word is judged as a bare one.
            if not (re.search(r"\s", value) and self.wordlike.fullmatch(value)):
                yield start, value, strict or inner
                return
        if (m := self.bare.match(text, at)) is not None:
            value = m[1].rstrip(MARKS)
            if self.wordlike.fullmatch(value):
                value = value.rstrip("!?" + MARKS)
            if not self.code.fullmatch(value):
                yield m.start(1), value, strict
        m = self.short.match(text, at)
        yield m.start(1), m[1].rstrip(".:!?"), strict

    def quoted(self, text: str, at: int) -> tuple[int, str, bool] | None:
        """The value between quotes on one line: (start, value, whether a scheme word led it)."""
        quote = text[at : at + 1]
        if not quote or quote not in QUOTES:
            return None
        line = text.find("\n", at + 1)
        end = text.find(quote, at + 1, len(text) if line < 0 else line)
        if end <= at + 1:
            return None
        scheme = self.inner.match(text, at + 1, end)
        start = scheme.end()
        if start == end:  # nothing but a scheme word
            start = at + 1
        return start, text[start:end], start > at + 1

    def hard(self, value: str, strict: bool) -> bool:
        if self.wordlike.fullmatch(value):
            return not strict and guess_cost(value) >= self.guesses
        return guess_cost(value) >= min(self.guesses, self.length * BRUTE)

    def scan(self, text: str) -> list[tuple[int, int, str]]:
        """All spans (start, end, kind) by start."""
        low = text.lower()
        cued = any(c in low for c in CUES)
        every = self.base(text, cued) + (self.guessed(text) if cued else [])
        return sorted(every, key=lambda s: (s[0], ORDER.index(s[2])))


def find_secrets(
    docs: DataFrame, guesses: float = GUESSES, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Rows ``(id, spans, hardest)``, one per row of ``docs``.

    ``spans`` is an array of (kind, start, end) in code points by start: the base kinds,
    and ``guess`` for a credential value of at least ``length`` characters and ``guesses``
    (log10), or for a value that is not made of words as many as ``length`` unknown characters. ``hardest`` is the greatest guess cost of the guessed values, else null.
    Null and empty texts have no spans; repeated rows are scanned each; a null id stays
    null.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def start():
        scanner = Scanner(guesses, length)

        def step(ids, texts):
            spans, hardest = [], []
            for text in texts:
                every = scanner.scan(text or "")
                spans.append([{"kind": k, "start": a, "end": b} for a, b, k in every])
                hardest.append(max((guess_cost(text[a:b]) for a, b, k in every if k == "guess"), default=None))
            return ids, spans, hardest

        return step

    schema = f"`{id_col}` {kind}, spans array<struct<kind: string, start: bigint, end: bigint>>, hardest double"
    return map_rows(docs.select(F.col(id_col), F.col(text_col)), start, schema)


def redact_secrets(
    docs: DataFrame,
    guesses: float = GUESSES,
    length: int = LENGTH,
    id_col: str = "doc_id",
    text_col: str = "text",
    mark: str = "[SECRET]",
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """``(id, text)``, one row per row of ``docs`` with the columns ``carry``: every stretch of
    overlapping spans of :func:`find_secrets` is replaced by ``mark``; other texts, null
    ones too, stay as they are."""
    kind = docs.schema[id_col].dataType.simpleString()

    def start():
        scanner = Scanner(guesses, length)

        def step(ids, texts):
            return ids, [text and masked(text, scanner.scan(text), mark) for text in texts]

        return step

    rows = docs.select(F.col(id_col), F.col(text_col), *carry)
    return map_rows(rows, start, f"`{id_col}` {kind}, `{text_col}` string", len(carry))


def masked(text: str, spans: list[tuple[int, int, str]], mark: str) -> str:
    parts, at = [], 0
    for a, b, _ in spans:
        if a >= at:
            parts += [text[at:a], mark]
        at = max(at, b)
    return "".join(parts) + text[at:]


def joined(spans: str, base_only: bool) -> Column:
    rows = F.filter(spans, lambda s: s["kind"] != "guess") if base_only else F.col(spans)
    return F.array_join(F.transform(rows, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op1_secrets(spark, folder: str) -> DataFrame:
    found = find_secrets(table(spark, folder, "documents"))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")

    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in KINDS],
        F.sha2(joined("spans", True), 256).alias("base_sha256"),
        joined("spans", False).alias("spans"),
        F.col("hardest").alias("hardest_guesses"),
    )
