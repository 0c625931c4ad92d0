"""What route code answers and what its callers read: response keys, middleware names, accessed fields.

Object literals and argument lists nest, so a scan that counts brackets reads
them, in Arrow batches of whole files; the rest are patterns.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Parameters and built-ins that are no middleware; decorators that are; names that hold a response.
PARAMETERS = frozenset("req res next request response ctx context".split())
BUILT_INS = frozenset("require import Promise setTimeout setInterval async String Number Boolean Array Object Map Set JSON Math Date".split())
VIEW_DECORATORS = "login_required permission_required csrf_exempt csrf_protect require_http_methods require_GET require_POST require_safe staff_member_required user_passes_test".split()
RESPONSE_NAMES = frozenset("data response json result body res resp apiResponse responseData r d".split())
#: Characters before a response call in which an error status may stand.
STATUS_REACH = 80

_ANSWER = re.compile(r"\.(?:json|send)\s*\(|\bjsonify\s*\(|\breturn\s+(?=\{)")
_ERROR = re.compile(r"\.status\s*\(\s*[45]\d\d\s*\)")
_STEP = re.compile(r"""(["'`])(?:\\.|(?!\1)[^\\])*+(?:\1|\Z)|[()\[\]{}:,]|[\w$]+""", re.S)
_NAME = re.compile(r"[\w$]+")
_ROUTE = re.compile(r"""\b(?:app|router)\.(?:get|post|put|delete|patch)\s*\(\s*['"][^'"]+['"]""")
_NAMED = (
    (re.compile(r"(\w+)\s*\(\s*(?:async\s*)?(?:function\s+\w+|(?:\([^)]*\)|[$\w]+)\s*(?:=>|\{)|[$\w]+Handler|[$\w]+Controller)"), PARAMETERS | BUILT_INS),
    (re.compile(r"\b(?:app|router|koa)\.use\s*\(\s*([$\w]+)"), PARAMETERS | BUILT_INS),
    (re.compile(r"Depends\s*\(\s*([$\w]+)"), frozenset()),
    (re.compile(rf"@({'|'.join(VIEW_DECORATORS)})"), frozenset()),
    (re.compile(r"""->middleware\s*\(\s*['"]([^'":]*)[^'"]*['"]"""), frozenset()),
)
_READ = (
    re.compile(r"([$\w]+)\?\.(\w+)"),
    re.compile(r"(?<!\?)(?<![$\w])(?!\d)([$\w]+)\.(\w+)"),
    re.compile(r"""([$\w]+)\s*\[(?:'([^'"]+)'|"([^'"]+)")\]"""),
)
_TAKEN_APART = re.compile(r"(?:const|let|var)\s*\{([^}]+)\}\s*=\s*(?:await\s+)?(\w+)")


def _object_keys(code: str, at: int) -> list[str]:
    """Keys before a colon at the top level of the object whose brace is at ``at``; a run that is no single name is no key."""
    found, depth, start, in_value = [], 0, -1, False
    for m in _STEP.finditer(code, at):
        c = m[0]
        if c in "({[":
            depth += 1
        elif c in ")}]":
            depth -= 1
            if not depth:
                break
        elif depth != 1 or m[1]:
            continue
        elif c == ",":
            start, in_value = (-1, False) if in_value else (start, False)
        elif c == ":":
            name = code[start : m.start()].strip() if start >= 0 else ""
            if not in_value and _NAME.fullmatch(name):
                found.append(name)
            start, in_value = -1, True
        elif start < 0 and not in_value:
            start = m.start()
    return found


def _arguments(code: str, at: int) -> list[str]:
    """Top-level arguments from ``at`` to the bracket that closes the list."""
    found, depth, start = [], 0, at
    for m in _STEP.finditer(code, at):
        c = m[0]
        if c in "({[":
            depth += 1
        elif c in ")}]":
            if not depth:
                return [*found, code[start : m.start()]]
            depth -= 1
        elif c == "," and not depth:
            found.append(code[start : m.start()])
            start = m.end()
    return [*found, code[start:]]


def response_keys(code: str) -> tuple[list[str], list[str]]:
    """Top-level keys of the objects that code answers with, and of those sent with an error status; each once, in order."""
    plain, errors, known = {}, {}, {}
    for m in _ANSWER.finditer(code):
        at = code.find("{", m.end())
        if at < 0:
            break
        if at not in known:
            known = {at: _object_keys(code, at)}
        failed = m[0][0] == "." and _ERROR.search(code, max(0, m.start() - STATUS_REACH), m.start())
        (errors if failed else plain).update(dict.fromkeys(known[at]))
    return list(plain), list(errors)


def middleware_names(code: str) -> list[str]:
    """Middleware of route calls, handler wrappers, registrations, injections, view decorators and chains; each once, in that order."""
    found: dict[str, None] = {}
    for m in _ROUTE.finditer(code):
        names = (a.strip() for a in _arguments(code, m.end()))
        found.update(dict.fromkeys(n for n in names if _NAME.fullmatch(n) and n not in PARAMETERS))
    for pattern, but in _NAMED:
        found.update(dict.fromkeys(m[1] for m in pattern.finditer(code) if m[1] not in but))
    return list(found)


def accessed_fields(code: str) -> list[str]:
    """Fields read from variables that hold a response: by dot, optional chain, bracket or destructuring; each once."""
    found: dict[str, None] = {}
    for pattern in _READ:
        found.update(dict.fromkeys(m[2] or m[3] for m in pattern.finditer(code) if m[1] in RESPONSE_NAMES))
    for m in _TAKEN_APART.finditer(code):
        if m[2] in RESPONSE_NAMES:
            names = (part.strip().split(":")[0].strip() for part in m[1].split(","))
            found.update(dict.fromkeys(n for n in names if re.fullmatch(r"\w+", n) and n not in RESPONSE_NAMES))
    return list(found)


def code_shapes(files: DataFrame) -> DataFrame:
    """file_path, response_keys, error_keys, middleware, accessed (arrays of string) of every file (file_path, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strings = pa.list_(pa.string())
        for batch in batches:
            codes = [c or "" for c in batch.column(1).to_pylist()]
            answers = [response_keys(c) for c in codes]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([a for a, _ in answers], strings), pa.array([e for _, e in answers], strings), pa.array([middleware_names(c) for c in codes], strings), pa.array([accessed_fields(c) for c in codes], strings)],
                names=["file_path", "response_keys", "error_keys", "middleware", "accessed"],
            )

    out = "file_path string, response_keys array<string>, error_keys array<string>, middleware array<string>, accessed array<string>"
    return files.select(F.col("file_path").cast("string"), F.col("content").cast("string")).mapInArrow(run, out)
