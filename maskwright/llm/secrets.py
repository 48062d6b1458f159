"""Secret scans: fixed patterns, and windows of high Shannon entropy over candidate strings."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from maskwright.llm.common import in_small_batches, packed

#: Patterns of the base kinds, in the order that breaks ties of start (fixed values of the contract).
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "entropy")


@dataclass(frozen=True)
class CharClass:
    """Characters of a candidate, its least length, the window and the bits a window must reach.

    Candidates of at least ``shortest`` characters that are shorter than the window are measured as a
    whole, when upper and lower case and digits are mixed in them; the bits are scaled to their length.
    """

    name: str
    pattern: str
    window: int
    bits: float
    shortest: int = 0


#: Random strings reach these bits in nearly every window; prose, identifiers and paths don't.
CLASSES = (
    CharClass("hex", r"[0-9A-Fa-f]{32,}", 32, 3.2),
    CharClass("upper", r"[A-Z0-9]{20,}", 20, 3.6),
    CharClass("base64", r"[A-Za-z0-9+/_=-]{16,}", 24, 4.0, 16),
)
#: What looks random and is no secret: serial identifiers, one word, words joined by marks.
ALLOWED = (
    r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}",
    r"[A-Za-z]+",
    r"[0-9]+",
    r"(?:[A-Za-z]+|[0-9]+)(?:[-_/+=](?:[A-Za-z]+|[0-9]+))+",
)


def _ordered() -> re.Pattern:
    rest = ""
    for ch in reversed("klmnopqrstuvwxyz"):
        rest = f"(?:{ch}{rest})?"
    return re.compile(f"abcdefghij{rest}|0123456789", re.I | re.A)


#: Ordered runs are no part of a secret: candidates are cut at them, and each piece is judged alone.
ORDERED = _ordered()
#: Parts of names made of capitalised or joined words and numbers; in a name they have ``NAME_PART`` characters on average.
NAME = re.compile(r"[A-Z][a-z]+|[a-z]{2,}|[A-Z]{2,}|[0-9]+")
NAME_PART = 3
MIXED = re.compile(r"(?=.*[a-z])(?=.*[A-Z])(?=.*[0-9])")
MARKS = "+/_=-"


def entropy_windows(value: str, window: int, bits: float) -> Iterator[tuple[int, int]]:
    """Joined ranges covered by windows of at least ``bits`` bits of entropy per character.

    The counts of the window change by one character in and one out, and with them the sum of
    c * log2(c), from which the entropy is log2(window) - sum / window.
    """
    cost = [0.0] + [c * math.log2(c) for c in range(1, window + 1)]
    counts: dict[str, int] = {}
    total, start, end = 0.0, -1, -1
    for i, ch in enumerate(value):
        c = counts.get(ch, 0)
        counts[ch] = c + 1
        total += cost[c + 1] - cost[c]
        if i >= window:
            old = value[i - window]
            c = counts[old]
            counts[old] = c - 1
            total += cost[c - 1] - cost[c]
        if i >= window - 1 and math.log2(window) - total / window >= bits - 1e-9:
            if start >= 0 and i - window + 1 <= end:
                end = i + 1
            else:
                if start >= 0:
                    yield start, end
                start, end = i - window + 1, i + 1
    if start >= 0:
        yield start, end


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base kinds, leftmost and non-overlapping per kind."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return sorted(out + [(m.start(), 2, m.end()) for m in HEX.finditer(text)])


def is_name(value: str) -> bool:
    parts = NAME.findall(value)
    return NAME_PART * len(parts) <= len(value) and sum(map(len, parts)) == sum(ch not in MARKS for ch in value)


def pieces(value: str, start: int) -> Iterator[tuple[int, str]]:
    """The candidate in pieces between its ordered runs, each with its place in the text."""
    at = 0
    for m in ORDERED.finditer(value):
        yield start + at, value[at : m.start()]
        at = m.end()
    yield start + at, value[at:]


def entropy_spans(text: str, classes: tuple[CharClass, ...], allowed: re.Pattern) -> list[tuple[int, int, int]]:
    """Spans of high entropy, joined over the classes; a piece that is allowed as a whole is left out."""
    found: list[tuple[int, int]] = []
    for cls in classes:
        for m in re.finditer(cls.pattern, text):
            if allowed.fullmatch(m.group()):
                continue
            for start, piece in pieces(m.group(), m.start()):
                window, bits = cls.window, cls.bits
                if len(piece) < window:
                    if not cls.shortest or len(piece) < cls.shortest or not MIXED.match(piece) or is_name(piece):
                        continue
                    window, bits = len(piece), bits * math.log2(len(piece)) / math.log2(window)
                if not allowed.fullmatch(piece.strip(MARKS)):
                    found += [(start + a, start + b) for a, b in entropy_windows(piece, window, bits)]
    out: list[list[int]] = []
    for a, b in sorted(found):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [(a, 3, b) for a, b in out]


def scan_text(text: str, classes: tuple[CharClass, ...] = CLASSES, allowed: re.Pattern | None = None) -> tuple[list, list]:
    """Base spans and all spans of a text. Entropy spans inside one base span are not repeated."""
    allowed = allowed or re.compile("|".join(ALLOWED))
    base = base_spans(text)
    extra, at, reach = [], 0, -1  # both lists are in order of starts; ``reach`` is the furthest end of the base spans so far
    for s in entropy_spans(text, classes, allowed):
        while at < len(base) and base[at][0] <= s[0]:
            reach = max(reach, base[at][2])
            at += 1
        if reach < s[2]:
            extra.append(s)
    return base, sorted(base + extra)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def redacted(text: str, spans: list[tuple[int, int, int]], mark: str) -> str:
    """The text with every stretch of joined spans replaced by ``mark``."""
    out, at, last = [], 0, -1
    for a, _, b in spans:
        if a > last:
            out += [text[at:a], mark]
        last = max(last, b)
        at = last
    return "".join([*out, text[at:]])


RESULT = (
    ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("n_entropy", pa.int64()),
    ("base_sha256", pa.string()), ("spans", pa.string()),
)


def scan(docs: DataFrame, text: str = "text", redact: bool = False, mark: str = "<secret>") -> DataFrame:
    """Spans of secrets in every text: the columns of ``docs`` that are no text, then the counts,
    ``base_sha256`` (of the base spans), ``spans`` (all) and, with ``redact``, the cleaned text as ``__text``.

    Null texts count as empty: counts 0, the hash of the empty string, no spans. Offsets count code
    points. Each row is scanned alone, so repeated rows repeat their result. Names of ``docs`` are kept
    apart from the results by a prefix of two underscores: ``__n_assign`` and so on.
    """
    others = [c for c in docs.columns if c != text]
    source = in_small_batches(docs).select(*[F.col(f"`{c}`") for c in others], F.col(f"`{text}`").cast("string").alias("__scan"))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields if f.name != "__scan"]
                       + [f"__{n} {'string' if t == pa.string() else 'bigint'}" for n, t in RESULT] + ["__text string"] * redact)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        allowed = re.compile("|".join(ALLOWED))
        for batch in batches:
            rows: list[list] = [[] for _ in RESULT]
            texts = []
            for value in batch.column("__scan"):
                value = value.as_py()
                base, spans = scan_text(value or "", CLASSES, allowed)
                counts = [sum(k == n for _, k, _ in spans) for n in range(4)]
                digest = hashlib.sha256(joined(base).encode()).hexdigest()
                for column, x in zip(rows, (*counts, digest, joined(spans)), strict=True):
                    column.append(x)
                if redact:
                    texts.append(redacted(value, spans, mark) if spans else value)
            columns = [batch.column(c) for c in others] + [pa.array(x, t) for x, (_, t) in zip(rows, RESULT, strict=True)]
            names = others + [f"__{n}" for n, _ in RESULT]
            if redact:
                columns, names = [*columns, pa.array(texts, pa.string())], [*names, "__text"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return source.mapInArrow(run, schema)


def redact_documents(docs: DataFrame, text: str = "text", length: str = "n_chars") -> DataFrame:
    """The rows of ``docs`` with every secret replaced by ``<secret>``; ``length`` follows where it exists.

    Null texts stay null, texts without secrets stay as they are.
    """
    out = scan(packed(docs, text), text, redact=True)
    columns = []
    for f in docs.schema.fields:
        c = F.col("row").getField(f.name)
        if f.name == text:
            c = F.col("__text")
        elif f.name == length:
            c = F.when(F.col("__spans") != "", F.length("__text")).otherwise(c)
        columns.append(c.cast(f.dataType).alias(f.name))
    return out.select(*columns)
