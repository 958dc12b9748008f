"""Secret scans with assignment-aware lexing.

Three base patterns find assignments of long values to tell-tale names, access keys and long hex runs.
Beside them every text is lexed as source or configuration. Names are paired with the expression that follows:
after ``=``, ``:``, ``:=`` or ``=>``, as the content of an element ``<name>``, as the argument of ``set_name(...)`` (also
``with``, ``add``) and after an option ``--name``. An expression joins literals and names by ``+``; ``||``, ``??`` and ``or``
part it into alternatives, and the default of a lookup (``getenv("X", ...)``) stands for the call; other calls stand
for nothing. Literals are quoted by
``"``, ``'``, backticks or three quotes, or bare. Names assigned before stand for their expressions, so a constant
keeps its spans when it is passed on under another name; a type between ``:`` and ``=`` is skipped (each name of it up to 64
characters, 80 in brackets, five alternatives: what is longer is lexed as a value). A literal's score is the weight of a
target name that it reaches plus a grade of its length, variety and mix of letters and digits. Where an expression joins quoted
literals, its whole value is scored as well (each literal taken once) and counts for every part of it. The best score
counts, and from ``THRESHOLD`` on the literal is reported as kind ``literal``. Short, uniform and placeholder literals score
0, and so do literals with blanks unless the name is that of a passphrase, and bare values of options
and alternatives without a digit.

Texts are scanned whole, in place; a byte-class pass and substring tests leave most texts to no lexer.

Defined results: null text counts as empty and has no spans; repeated rows each get theirs; offsets are
code points, end exclusive; equal spans of one kind are reported once; extra columns are ignored.
"""
from __future__ import annotations

import hashlib
import heapq
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.llm import text as T

KINDS = ("assign", "access", "hex", "literal")
THRESHOLD = 1.0
MIN_LITERAL = 8
#: Weights of the words of a target name.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 1.0, "pass": 0.8, "secret": 1.0, "token": 1.0, "credential": 1.0,
    "credentials": 1.0, "auth": 0.8, "apikey": 1.0, "key": 0.6, "api": 0.4, "access": 0.4, "private": 0.5, "client": 0.2,
    "signing": 0.4, "encryption": 0.4, "bearer": 0.8, "salt": 0.5,
}
_ASSIGN = re.compile(
    r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
_HEX_BYTES = T.byte_class(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x66)
_TYPE = r"""&?(?:'[a-z_]+[ \t]+)?(?:mut[ \t]+)?[A-Za-z_][A-Za-z0-9_.:]{0,63}(?:[\[<][^\n=;"]{0,80}[\]>])?(?:\[\])?[?!]?"""
_TARGET = re.compile(
    r"""(?<![\w.-])(["']?)([A-Za-z_][A-Za-z0-9_.-]*+)\1\??[ \t]*"""
    rf"""(?::[ \t]*{_TYPE}(?:[ \t]*\|[ \t]*{_TYPE}){{0,4}}(?:[ \t]*=(?=[ \t]*["'])|[ \t]+=(?=[ \t]+[A-Za-z_]))|:=|=>|[:=])[ \t]*""", re.ASCII)
_ELEMENT = re.compile(r"""<([A-Za-z_][A-Za-z0-9_.:-]*+)(?:\s[^<>]*+)?>([^<>]*+)</\1\s*>""", re.ASCII)
_SETTER = re.compile(r"""(?<!\w)(?:set|with|add)_?([A-Za-z]\w*+)\([ \t]*""", re.ASCII)
_OPTION = re.compile(r"""(?<![\w-])--([A-Za-z][A-Za-z0-9_-]*+)(?:=|[ \t]+)""", re.ASCII)
_BARE = 6
_TERM = re.compile(
    r"""[ \t]*(?:(?:[rbuRBU]{1,2}(?=["']))?(?:\"{3}((?:[^\\]|\\.)*?)\"{3}|'{3}((?:[^\\]|\\.)*?)'{3}|"((?:[^"\\\n]|\\.)*)"|'((?:[^'\\\n]|\\.)*)')"""
    r"""|`((?:[^`\\\n]|\\.)*)`|([A-Za-z0-9_][A-Za-z0-9_.+/=-]*))""", re.ASCII)
_JOIN = re.compile(r"[ \t]*(\+|\|\||\?\?)|[ \t]+or\b")
_LOOKUP = re.compile(r"(?:^|[._])(?:getenv|environ\.get|config\.get|getProperty|getOrDefault|env)$")
_DEFAULT = re.compile(r"""\([ \t]*(?:"[^"\n]*"|'[^'\n]*'|[\w.]+)[ \t]*,(?=[ \t]*["'`A-Za-z_])""", re.ASCII)
_NAME_WORD = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]+")
_PLACEHOLDER = re.compile(r"(?i)\$\{|\{\{|<[^>]*>|xxxx|example|change.?me|your|placeholder|redacted|\*\*\*")
_HINTS = ("pass", "pwd", "secret", "token", "key", "cred", "auth", "private", "bearer", "salt", "api", "access", "signing", "encryption")
#: Bits of a literal from which its grade is full; a full grade, letters and digits mixed or not.
FULL_BITS, MIXED, UNMIXED = 48, 0.55, 0.3


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns; leftmost matches that do not overlap, too short ones dropped."""
    found = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text) if m.end() - m.start() >= 16]
    return sorted(found)


def name_words(name: str) -> list[str]:
    return list(dict.fromkeys(w.lower() for w in _NAME_WORD.findall(name)))


def name_weight(name: str) -> float:
    """Sensitivity of a target name: the weights of its words, summed."""
    return sum(SENSITIVE.get(w, 0.0) for w in name_words(name))


def shape(value: str, blanks: bool = False) -> float:
    """0 for short, uniform or placeholder literals, and for those with blanks unless allowed; up to ``MIXED`` for long and varied ones."""
    if len(value) < MIN_LITERAL or _PLACEHOLDER.search(value) or not blanks and any(c.isspace() for c in value):
        return 0.0
    bits = -sum(n / len(value) * math.log2(n / len(value)) for n in Counter(value).values())
    if bits < 2.0:
        return 0.0
    mixed = any(c.isdigit() for c in value) and sum(c.isalpha() for c in value) >= 3
    return (MIXED if mixed else UNMIXED) * min(1.0, bits * len(value) / FULL_BITS)


def score(name: str, value: str, quoted: bool = True) -> float:
    """Score of a literal under a target name: the name's weight plus the literal's grade, 0 where either is 0.

    Bare values under names below the threshold count only if they cannot be names of code themselves.
    """
    words = name_words(name)
    weight = name_weight(name)
    grade = shape(value, "passphrase" in words or {"pass", "phrase"} <= set(words)) if weight else 0.0
    if not grade or not quoted and weight < THRESHOLD and (
            "_" in value or "." in value or not any(c.isdigit() for c in value)):
        return 0.0
    return weight + grade


def _expression(text: str, at: int, known: dict) -> tuple[list[list], int]:
    """The alternatives of the expression at ``at`` and its end; parts are literals (start, end, quoted) and known expressions."""
    alternatives: list[list] = [[]]
    while term := _TERM.match(text, at):
        at, group = term.end(), term.lastindex
        if group != _BARE:
            alternatives[-1].append((*term.span(group), True))
        else:  # a bare name stands for its expression, any other bare value for itself
            value = term[group]
            name = value if value in known else value.rstrip("+")
            if name in known:
                at -= len(value) - len(name)
                alternatives[-1].append(known[name])
            elif _LOOKUP.search(value) and (default := _DEFAULT.match(text, at)):
                at = default.end()
                continue
            elif text.startswith("(", at):  # a call: no literal, and nothing known to join
                alternatives[-1].append((at, at, False))
            else:
                alternatives[-1].append((*term.span(group), False))
        join = _JOIN.match(text, at)
        if not join:
            break
        at = join.end()
        if join[1] != "+":
            alternatives.append([])
    return alternatives, at


def _literals(parts: list) -> list[tuple[int, int, bool]]:
    """The literals that parts stand for, each once, in order."""
    out, seen, stack = {}, set(), parts[::-1]
    while stack:
        part = stack.pop()
        if isinstance(part, tuple):
            out[part] = None
        elif id(part) not in seen:
            seen.add(id(part))
            stack += [p for alternative in part[::-1] for p in alternative[::-1]]
    return list(out)


def _pairs(text: str):
    """(name, expression) of all name-literal pairs, in order of the text."""
    known: dict[str, list[list]] = {}
    for m in heapq.merge(*(p.finditer(text) for p in (_TARGET, _ELEMENT, _SETTER, _OPTION)), key=lambda m: m.start()):
        if m.re is _ELEMENT:
            value = m[2].strip()
            at = m.start(2) + len(m[2]) - len(m[2].lstrip())
            yield m[1], [[(at, at + len(value), False)]]
            continue
        expression, end = _expression(text, m.end(), known)
        if m.re is _TARGET:
            known[m[2]] = expression
            yield m[2], expression
        elif m.re is _OPTION and any(q or any(c.isdigit() for c in text[a:b]) for a, b, q in _literals(expression[0])):
            yield m[1], expression
        elif m.re is _SETTER and text[end:end + 8].lstrip(" \t").startswith(")"):
            yield m[1], expression


def literal_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of literals that reach a sensitive name."""
    best: dict[tuple[int, int], float] = {}
    for name, expression in _pairs(text):
        if not name_weight(name):
            continue
        for alternative in expression:
            parts = _literals(alternative)
            constant = len(parts) > 1 and all(quoted for _, _, quoted in parts)
            whole = score(name, "".join(text[a:b] for a, b, _ in parts)) if constant else 0.0
            for a, b, quoted in parts:
                if b > a and (quoted or len(expression) == 1 or any(c.isdigit() for c in text[a:b])):
                    best[a, b] = max(best.get((a, b), 0.0), whole, score(name, text[a:b], quoted))
    return sorted((a, 3, b) for (a, b), w in best.items() if w >= THRESHOLD)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def _scan(batches):
    for batch in batches:
        rows = []
        for first, end, data, offs in T.chunks(batch.column(1)):
            starts, ends, bounds = T.word_spans(data, offs, _HEX_BYTES)
            long = {int(r) for r in bounds.searchsorted((ends - starts >= 16).nonzero()[0], "right") - 1}
            raw = data.tobytes()
            for r in range(end - first):
                text = raw[offs[r]:offs[r + 1]].decode()
                low = text.lower()
                hint = any(h in low for h in _HINTS)
                base = base_spans(text) if hint or r in long or "AKIA" in text else []
                rows.append((base, [*base, *literal_spans(text)] if hint else base))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array([sum(k == kind for _, k, _ in b) for b, _ in rows], pa.int64()) for kind in range(3)),
             pa.array([hashlib.sha256(joined(b).encode()).hexdigest() for b, _ in rows], pa.string()),
             pa.array([joined(s) for _, s in rows], pa.string())],
            ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) for each row of docs (doc_id, text)."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        _scan, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all documents."""
    return secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
