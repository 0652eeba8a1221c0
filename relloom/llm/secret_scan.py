"""Secret scans: base patterns, and an assignment-aware lexer over source and configuration.

Texts are independent of each other, so the scan is one map over Arrow batches without a
shuffle; a task holds one step of texts.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from relloom.llm.common import Batches, map_batches, steps, text_columns

KINDS = ("assign", "access", "hex", "named")

ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: A maximal run of ``[0-9a-f]`` that is long enough; shorter runs are never kept.
HEX = re.compile(r"[0-9a-f]{24,}")

Span = tuple[int, int, int]  # start, place in KINDS, end


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each base pattern that are long enough."""
    found: list[Span] = []
    if ":" in text or "=" in text:
        lower = text.lower()
        if any(word in lower for word in ASSIGN_WORDS):
            found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


# ---- the lexer -----------------------------------------------------------------------

#: ``name =``, ``name :=``, ``name: type =``, ``"name":``, ``name =>``; not a comparison.
TARGET = re.compile(
    r"""(?<![\w$.\-])([A-Za-z_$][\w$.\-]*)["']?\]?[ \t]*"""
    r"""(?::[ \t]*[A-Za-z_][\w.\[\]]*[ \t]*=(?![=>~])|:=|=>|(?<![=!<>])=(?![=~])|:(?![:/=]))[ \t]*""",
    re.ASCII,
)
STRING = re.compile(
    r'''[rbfuRBFU]{0,2}("(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\\n]|\\.)*`)''', re.ASCII
)
NAME = re.compile(r"[A-Za-z_$][\w$.\-]*", re.ASCII)
BARE = re.compile(r"[^\s,;#\"'`(){}\[\]<>|&]+")
JOIN = re.compile(r"[ \t]*(?:\+|\.\.)[ \t]*")
REFERENCE = re.compile(r"\$\{([\w.\-]+)\}|\$([A-Za-z_]\w*)", re.ASCII)
#: References within single quotes, where a bare ``$name`` is text.
BRACED = re.compile(r"\$\{([\w.\-]+)\}|(?!)()", re.ASCII)
WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")

#: How sensitive the words of a target's name are (fixed values).
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 1.0, "secret": 1.0, "token": 0.9,
    "apikey": 1.0, "credential": 0.9, "credentials": 0.9, "auth": 0.6, "bearer": 0.8, "signature": 0.6,
}
SENSITIVE_PAIRS = {("api", "key"): 1.0, ("private", "key"): 1.0, ("access", "key"): 1.0, ("encryption", "key"): 1.0}
#: Values that stand for a secret without being one (fixed values).
PLACEHOLDERS = {"changeme", "password", "secret", "token", "example", "none", "null", "true", "false", "undefined"}


class Literal:
    """A value, the places of the literals it was made from, and whether it is nothing but references."""

    __slots__ = ("places", "unresolved", "value")

    def __init__(self, value: str, places: tuple[tuple[int, int], ...], unresolved: bool):
        self.value, self.places, self.unresolved = value, places, unresolved


def _only(references: re.Pattern[str], value: str) -> bool:
    """Whether a value is wholly made of references."""
    return bool(value) and not references.sub("", value)


def _terms(text: str, at: int, known: dict[str, Literal]) -> Literal | None:
    """The expression at ``at``: literals, earlier names and what joins them; else ``None``."""
    parts: list[Literal] = []
    while True:
        if m := STRING.match(text, at):
            value, places = m[1][1:-1], [(m.start(1) + 1, m.end(1) - 1)]
            names = BRACED if m[1][0] == "'" else REFERENCE
            used = [known.get(r[1] or r[2]) for r in names.finditer(value)]
            places += [p for u in used if u for p in u.places]
            unresolved = _only(names, value) and all(u is None or u.unresolved for u in used)
            value = names.sub(lambda r: known[r[1] or r[2]].value if (r[1] or r[2]) in known else r[0], value)
            parts.append(Literal(value, tuple(places), unresolved))
        elif (m := NAME.match(text, at)) and m[0] in known:
            parts.append(known[m[0]])
        elif m := BARE.match(text, at):
            parts.append(Literal(m[0], ((m.start(), m.end()),), _only(REFERENCE, m[0])))
        else:
            break
        at = m.end()
        if not (m := JOIN.match(text, at)):
            break
        at = m.end()
    if not parts:
        return None
    places = tuple(dict.fromkeys(s for p in parts for s in p.places))
    return Literal("".join(p.value for p in parts), places, all(p.unresolved for p in parts))


def assignments(text: str) -> Iterator[tuple[str, Literal]]:
    """Name-literal pairs in the order of the text; names take their latest literal."""
    known: dict[str, Literal] = {}
    for m in TARGET.finditer(text):
        if literal := _terms(text, m.end(), known):
            known[m[1]] = literal
            yield m[1], literal


def name_score(name: str) -> float:
    words = [w.lower() for w in WORD.findall(name)]
    single = max((SENSITIVE.get(w, 0.0) for w in words), default=0.0)
    return max([single, *(SENSITIVE_PAIRS.get(p, 0.0) for p in zip(words, words[1:], strict=False))])


def literal_score(literal: Literal) -> float:
    """Bits per character over 3, at most 1; 0 for short values, placeholders and mere references."""
    value = literal.value
    if len(value) < 6 or value.lower() in PLACEHOLDERS or literal.unresolved or len(set(value)) < 4:
        return 0.0
    counts = Counter(value).values()
    bits = -sum(c / len(value) * math.log2(c / len(value)) for c in counts)
    return min(1.0, bits / 3)


def named_spans(text: str, threshold: float = 0.6) -> tuple[list[Span], float]:
    """Places of literals that reach a sensitive name, and the best score seen."""
    if ":" not in text and "=" not in text:
        return [], 0.0
    found, best = set(), 0.0
    for name, literal in assignments(text):
        if weight := name_score(name):
            score = weight * literal_score(literal)
            best = max(best, score)
            if score >= threshold:
                found |= {(a, 3, b) for a, b in literal.places if b > a}
    return sorted(found), best


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _scan(batches: Batches, threshold: float) -> Batches:
    for batch in batches:
        for part in steps(batch):
            rows = []
            for text in part["text"].to_pylist():
                base = base_spans(text or "")
                named, score = named_spans(text or "", threshold)
                kinds = Counter(k for _, k, _ in base)
                rows.append((
                    kinds[0], kinds[1], kinds[2], hashlib.sha256(written(base).encode()).hexdigest(),
                    written(sorted(base + named)), len(named), score,
                ))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.float64())
            made = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([part["doc_id"], *made], names=NAMES)


NAMES = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_named", "score"]
SCHEMA = (
    "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_named long, "
    "score double"
)


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.6) -> DataFrame:
    """One row per document: counts per base kind, digest of the base spans, all spans.

    ``spans`` holds ``kind:start:end`` (code points, end exclusive) ordered by start, then
    kind; ``named`` spans are literals whose value reaches a target name of a sensitivity
    times literal score of at least ``threshold``, through constants too. A null text is
    empty and has no span; repeated rows repeat their result; a null id stays null.
    """
    return map_batches(text_columns(docs, id_col, text_col), lambda b: _scan(b, threshold), SCHEMA)


def redact(text: str | None, threshold: float = 0.6, mark: str = "[SECRET]") -> str | None:
    """The text with every span replaced by ``mark``; overlapping spans become one mark."""
    if not text:
        return text
    spans = sorted(base_spans(text) + named_spans(text, threshold)[0])
    if not spans:
        return text
    out, at = [], 0
    for a, _, b in spans:
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def _redacted(batches: Batches, text_col: str, size_col: str | None, threshold: float) -> Batches:
    for batch in batches:
        for part in steps(batch, text_col):
            texts = [redact(t, threshold) for t in part[text_col].to_pylist()]
            made = {text_col: pa.array(texts, pa.string())}
            if size_col:
                made[size_col] = pa.array([None if t is None else len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([made.get(c, part[c]) for c in part.schema.names], names=part.schema.names)


def redact_secrets(
    docs: DataFrame, text_col: str = "text", size_col: str | None = "n_chars", threshold: float = 0.6
) -> DataFrame:
    """All rows and columns with the spans of ``secret_scan`` replaced in the text.

    ``size_col``, where there is one, takes the new number of code points. Texts without
    a span stay as they are; null stays null.
    """
    size = size_col if size_col in docs.columns else None
    return map_batches(docs, lambda b: _redacted(b, text_col, size, threshold), docs.schema)
