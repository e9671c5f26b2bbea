"""Secrets in texts: fixed patterns, and strings of high entropy.

*Patterns.* ``assign``, ``access`` and ``hex`` below, leftmost and non-overlapping for each kind; matches whose secret is
too short are dropped after matching, so they still use up their characters.

*Entropy.* Candidates are runs of characters that keys are written in. A window slides over a candidate, separately for
each class of characters that the whole candidate keeps to: hexadecimal digits, or letters and digits of any kind. Counts
of the window's characters are updated by one leaving and one entering, and so is the sum of c * log2(c), from which the
Shannon entropy follows. Overlapping windows at or above the class's threshold make a finding of kind ``entropy``.
Findings are suppressed if an allow-list pattern matches the candidate (identifiers, dates, paths, runs of the alphabet,
placeholders), if the stretch lacks a digit and a letter, or if a pattern's finding covers it.

Positions are code points, end exclusive. Null counts as empty, which has no findings; texts are scanned whole; repeated
rows get equal results; an empty table gives an empty result. ``find_secrets`` passes other columns through.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import math
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from brightweir.llm.arrow import appended, pieces

KINDS = ("assign", "access", "hex", "entropy")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: Window and least entropy in bits a character, by class.
CLASSES = {"hex": (re.compile(r"[0-9a-fA-F]+\Z"), 20, 2.9), "mixed": (re.compile(r"[A-Za-z0-9+/_=-]+\Z"), 20, 3.6)}
#: Patterns of candidates that are no secrets.
ALLOWED = (
    r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}\Z",  # UUID
    r"\d{4}-?\d{2}-?\d{2}([T_-]?\d{2}-?\d{2}-?\d{2})?\Z",  # date
    r"[A-Za-z_-]+\Z",  # words
    r"/?([A-Za-z0-9_=-]{0,15}/)+[A-Za-z0-9_=-]{0,15}\Z",  # path
    r"(?i).*(example|placeholder|changeme|xxxx|0123456789|123456789|abcdefgh)",
    r"(.)\1*\Z",
)
_GAIN = [0.0] + [c * math.log2(c) for c in range(1, 65)]


def windows_of_entropy(text: str, width: int, least: float) -> list[tuple[int, int]]:
    """Maximal runs of windows whose Shannon entropy is at least ``least`` bits a character."""
    counts: dict[str, int] = {}
    total, most, runs = 0.0, width * (math.log2(width) - least), []
    for i, ch in enumerate(text):
        n = counts.get(ch, 0)
        total += _GAIN[n + 1] - _GAIN[n]
        counts[ch] = n + 1
        if i >= width:
            out = text[i - width]
            n = counts[out]
            total += _GAIN[n - 1] - _GAIN[n]
            counts[out] = n - 1
        if i >= width - 1 and total <= most + 1e-9:
            if runs and runs[-1][1] >= i - width + 1:
                runs[-1] = (runs[-1][0], i + 1)
            else:
                runs.append((i - width + 1, i + 1))
    return runs


class Scanner:
    def __init__(self, allowed: tuple[str, ...] = ALLOWED):
        self.allowed = re.compile("|".join(f"(?:{p})" if not p.startswith("(?i)") else f"(?i:{p[4:]})" for p in _numbered(allowed)))

    def entropy(self, text: str) -> list[tuple[int, int]]:
        found = []
        for m in _CANDIDATE.finditer(text):
            s = m.group()
            if self.allowed.match(s):
                continue
            for kind, width, least in CLASSES.values():
                if kind.match(s):
                    for a, b in windows_of_entropy(s, width, least):
                        part = s[a:b]
                        if any(c.isdigit() for c in part) and any(c.isalpha() for c in part):
                            found.append((m.start() + a, m.start() + b))
                    break
        return found

    def base(self, text: str) -> list[tuple[int, int, int]]:
        """(start, number of the kind, end)."""
        found = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
        if "AKIA" in text:
            found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
        return found + [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]

    def spans(self, text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
        """(findings of patterns, all findings), in order."""
        base = sorted(self.base(text))
        starts, reach = [s[0] for s in base], list(itertools.accumulate((s[2] for s in base), max))
        # Covered: of the base findings that start no later, one ends no earlier.
        more = [(a, 3, b) for a, b in self.entropy(text) if not ((k := bisect.bisect_right(starts, a)) and reach[k - 1] >= b)]
        return base, sorted(base + more)


def _numbered(patterns: tuple[str, ...]) -> list[str]:
    """Back references count from the pattern's own first group."""
    out, before = [], 0
    for p in patterns:
        out.append(re.sub(r"\\(\d)", lambda m, n=before: f"\\{int(m[1]) + n}", p))
        before += re.compile(p).groups
    return out


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find_secrets(docs: DataFrame, text_col: str = "text", allowed: tuple[str, ...] = ALLOWED) -> DataFrame:
    """docs with n_assign, n_access, n_hex, n_entropy, base_sha256 and spans; columns of these names are replaced."""
    docs = docs.drop(*(f"n_{k}" for k in KINDS), "base_sha256", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(allowed)
        for batch in batches:
            for part in pieces(batch, text_col):
                counts, digests, spans = ([], [], [], []), [], []
                for text in pc.fill_null(part[text_col], "").to_pylist():
                    base, every = scanner.spans(text)
                    for k in range(4):
                        counts[k].append(sum(s[1] == k for s in every))
                    digests.append(hashlib.sha256(_joined(base).encode()).hexdigest())
                    spans.append(_joined(every))
                yield appended(part, **{f"n_{k}": pa.array(c, pa.int64()) for k, c in zip(KINDS, counts, strict=True)}, base_sha256=pa.array(digests, pa.string()), spans=pa.array(spans, pa.string()))

    schema = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields]
    return docs.mapInArrow(run, ", ".join([*schema, *(f"n_{k} long" for k in KINDS), "base_sha256 string, spans string"]))


def op4(spark, sf_dir: str) -> DataFrame:
    from brightweir.session import table

    return find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
