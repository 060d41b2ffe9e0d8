"""Secret scans: fixed formats, and sliding-window entropy over candidate strings.

Fixed formats are three expressions, matched from the left without overlap: assignments to a
secret's name, access key ids, and long hexadecimal runs. The entropy scan adds to them. A
candidate is an unbroken run of token characters; inside it every run of one character class
(hexadecimal digits, capitals with digits, lower case with digits, mixed case with digits,
base 64) is crossed by a window whose Shannon
entropy is kept up to date from the counts of the character that leaves and the one that
enters: H = log2(w) - S / w with S the sum of c * log2(c). Windows at or above the threshold
of their class are joined into spans. The allow list drops what is known not to be a secret:
the parts between separators that hold listed words, and candidates that are plain words, paths
and dotted names, uniform identifiers, ordered alphabets, or already reported by a fixed format.
Windows made mostly of parts that can be spoken (camel case, slugs with digits) are dropped too:
a part is a run of letters of one hump, spoken if vowels and consonants take turns in it.

Defined cases: a null text counts as the empty text and has no span; a null id stays a row;
repeated rows are scanned each; extra columns are ignored; an empty table gives an empty one.
An empty text has no span; very long texts and candidates are scanned whole, a window's counts
being all that is held of a run.
Positions are code points, the end excluded.
"""

from __future__ import annotations

import hashlib
import math
import re
from itertools import accumulate
from string import ascii_lowercase, ascii_uppercase, digits
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from flowquarry.llm.common import map_rows, table

#: Fixed formats: kind, expression, group that must be long enough, its least length.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
FORMATS = [("assign", ASSIGN, 2, 12), ("access", ACCESS, 0, 18), ("hex", HEX, 0, 16)]
KINDS = [kind for kind, *_ in FORMATS] + ["entropy"]

#: A match of a format contains this; texts without it are spared the slower expression.
HINTS = {"assign": re.compile(r"pass|secr|toke|api", re.I | re.A), "access": re.compile("AKIA"), "hex": re.compile(r"[0-9a-f]{16}")}


class Window(NamedTuple):
    """A character class, the width of its window, the bits that make it suspicious, and sets a window needs a character of."""

    name: str
    run: re.Pattern
    width: int
    bits: float
    needs: tuple[str, ...] = ()


#: Random tokens of 20 characters reach the bits of their class in 99 of 100 cases or more.
WINDOWS = [
    Window("hex", re.compile(r"[0-9a-fA-F]{24,}"), 24, 3.2),
    Window("capitals", re.compile(r"[A-Z0-9]{20,}"), 20, 3.6),
    Window("lower", re.compile(r"[a-z0-9]{20,}"), 20, 3.3, (ascii_lowercase, digits)),
    Window("mixed", re.compile(r"[A-Za-z0-9+/_=-]{20,}"), 20, 3.55, (ascii_lowercase, ascii_uppercase, digits)),
    Window("base64", re.compile(r"[A-Za-z0-9+/_=-]{24,}"), 24, 4.0),
]
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: Characters of a candidate that part it, and what lies between them.
SEPARATORS = "+/_=-"
PART = re.compile(r"[A-Za-z0-9]+")

#: Strings that show a part of a candidate to be a sample, a placeholder or an alphabet.
ALLOWED_WORDS = ("example", "sample", "placeholder", "changeme", "abcdefgh", "12345678", "xxxxxx", "lorem")
ALLOWED_SHAPES = [
    re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"),  # uniform identifier
    re.compile(r"[A-Za-z]?[a-z]+([/_-][A-Za-z]?[a-z]*)*"),  # words, paths and dashed names
    re.compile(r"[A-Z]+([/_-][A-Z]*)*"),  # the same in capitals
    re.compile(r"[0-9=+/_-]+"),  # numbers, dates and rules
]

#: Parts of a candidate: humps of letters, capitals in a row, numbers.
HUMP = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
#: A part that can be spoken: has a vowel, at most four consonants and three vowels in a row.
SPOKEN = re.compile(r"(?=[^aeiouy]*[aeiouy])(?:[aeiouy]{1,3}(?![aeiouy])|[^aeiouy]{1,4}(?![^aeiouy]))+")
SPOKEN_LETTERS = 3
#: Share of a window's letters and digits from which on spoken parts make it ordinary text.
SPOKEN_SHARE = 0.6
#: Digits that stand between separators as years, days and versions do; they count neither way.
LONE_DIGITS = 4
#: Each number that touches letters weighs so much more: words hold one, random letters with digits many.
TOUCHING = 6


def base_spans(text: str) -> list[tuple[int, int, str]]:
    found = []
    for kind, expression, group, least in FORMATS:
        if HINTS[kind].search(text):
            for m in expression.finditer(text):
                if m.end(group) - m.start(group) >= least:
                    found.append((m.start(), m.end(), kind))
    return found


def spoken_letters(text: str) -> tuple[list[int], list[int]]:
    """How many of the first i characters belong to spoken parts, and how many count at all."""
    spoken, counted = [0] * len(text), [0] * len(text)
    for m in HUMP.finditer(text):
        a, b = m.span()
        part = m.group().lower()
        if part[0] in digits:
            alone = (a == 0 or text[a - 1] in SEPARATORS) and (b == len(text) or text[b] in SEPARATORS)
            if not (alone and b - a <= LONE_DIGITS):
                counted[a:b] = [1] * (b - a)
            if not alone:
                counted[a] += TOUCHING
        else:
            counted[a:b] = [1] * (b - a)
            if b - a >= SPOKEN_LETTERS and SPOKEN.fullmatch(part):
                spoken[a:b] = [1] * (b - a)
    return [0, *accumulate(spoken)], [0, *accumulate(counted)]


def dense_windows(
    run: str, width: int, bits: float, needs: tuple[str, ...] = (), spoken: tuple[list[int], list[int]] | None = None, at: int = 0
) -> list[tuple[int, int]]:
    """Stretches of ``run`` covered by windows of at least so many bits, by running counts.

    A window must hold a character of each string of ``needs``. ``spoken`` are the counts of
    ``spoken_letters`` of the piece in which the run begins at ``at``; mostly spoken windows
    don't count.
    """
    if len(run) < width:
        return []
    weight = [0.0] + [c * math.log2(c) for c in range(1, width + 1)]
    counts: dict[str, int] = {}
    total, most = 0.0, (math.log2(width) - bits) * width + 1e-9
    out: list[tuple[int, int]] = []
    for i, ch in enumerate(run):
        if i >= width:
            gone = run[i - width]
            c = counts[gone]
            total += weight[c - 1] - weight[c]
            counts[gone] = c - 1
        c = counts.get(ch, 0)
        total += weight[c + 1] - weight[c]
        counts[ch] = c + 1
        if i >= width - 1 and total <= most and all(any(counts.get(x) for x in chars) for chars in needs):
            start = i - width + 1
            if spoken:
                words, letters = (c[at + i + 1] - c[at + start] for c in spoken)
                if words >= SPOKEN_SHARE * letters:
                    continue
            if out and start <= out[-1][1]:
                out[-1] = (out[-1][0], i + 1)
            else:
                out.append((start, i + 1))
    return out


def pieces(candidate: str) -> list[tuple[int, str]]:
    """Where a candidate is to be scanned: around the parts with listed words, unless its shape is allowed."""
    low = candidate.lower()
    if any(s.fullmatch(candidate) for s in ALLOWED_SHAPES):
        return []
    if not any(w in low for w in ALLOWED_WORDS):
        return [(0, candidate)]
    cuts = [m.span() for m in PART.finditer(low) if any(w in m.group() for w in ALLOWED_WORDS)]
    out = [(a, candidate[a:b]) for a, b in zip([0, *[b for _, b in cuts]], [*[a for a, _ in cuts], len(candidate)])]
    return [(a, piece) for a, piece in out if not any(s.fullmatch(piece.strip(SEPARATORS)) for s in ALLOWED_SHAPES)]


def entropy_spans(text: str, known: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    out: list[tuple[int, int]] = []
    for c in CANDIDATE.finditer(text):
        found = []
        for offset, piece in pieces(c.group()):
            at, spoken = c.start() + offset, spoken_letters(piece)
            for w in WINDOWS:
                for run in w.run.finditer(piece):
                    dense = dense_windows(run.group(), w.width, w.bits, w.needs, spoken, run.start())
                    found += [(at + run.start() + a, at + run.start() + b) for a, b in dense]
        for a, b in sorted(found):
            if out and a <= out[-1][1]:
                out[-1] = (out[-1][0], max(b, out[-1][1]))
            else:
                out.append((a, b))
    return [(a, b, "entropy") for a, b in out if not any(x <= a and b <= y for x, y, _ in known)]


def scan(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """(spans of the fixed formats, spans the entropy scan adds), by start, then kind."""
    order = lambda s: (s[0], KINDS.index(s[2]), s[1])
    base = sorted(base_spans(text), key=order)
    return base, sorted(entropy_spans(text, base), key=order)


def spelled(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def find_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: counts by kind, digest of the fixed spans, all spans in order."""

    def make():
        def work(ids, texts):
            out = []
            for i, t in zip(ids, texts):
                base, more = scan(t or "")
                kinds = [k for _, _, k in base]
                every = sorted(base + more, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))
                digest = hashlib.sha256(spelled(base).encode()).hexdigest()
                out.append((i, kinds.count("assign"), kinds.count("access"), kinds.count("hex"), digest, spelled(every), len(more)))
            return out

        return work

    kind = dict(df.dtypes)[id_col]
    schema = f"{id_col} {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_entropy long"
    return map_rows(df.select(id_col, text_col), make, schema)


def masked(text: str) -> str:
    """The text with every span replaced by its kind; overlapping spans become one."""
    base, more = scan(text)
    joined: list[list] = []
    for a, b, k in sorted(base + more):
        if joined and a < joined[-1][1]:
            joined[-1][1] = max(b, joined[-1][1])
        else:
            joined.append([a, b, k])
    for a, b, k in reversed(joined):
        text = f"{text[:a]}[{k}]{text[b:]}"
    return text


def mask_secrets(df: DataFrame, text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """All rows and columns, secrets in the text replaced and its length brought up to date.

    Rows without a span come through unchanged, a null text included. Without a column
    ``chars_col`` only the text is changed.
    """
    names, schema = df.columns, df.schema
    at, count = names.index(text_col), names.index(chars_col) if chars_col in names else None

    def make():
        def work(*columns):
            out = []
            for row in zip(*columns):
                text = row[at]
                if text:
                    clean = masked(text)
                    if clean != text:
                        row = [*row]
                        row[at] = clean
                        if count is not None:
                            row[count] = len(clean)
                out.append(tuple(row))
            return out

        return work

    return map_rows(df, make, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema))


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document."""
    return find_secrets(table(spark, sf_dir, "documents"))


QUERY = op1_secrets
