"""Numbers, paths, vectors and decay as Column expressions; nothing leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Share of confidence that survives an edge, by type; others keep OTHER_DECAY.
EDGE_DECAY = {
    "CALLS": 0.9, "IMPORTS": 0.7, "EXTENDS": 0.8, "IMPLEMENTS": 0.85, "USES": 0.6, "ACCESSES": 0.65, "CONTAINS": 0.95, "DEFINES": 0.95,
    "QUERIES": 0.75, "ROUTES": 0.7, "MEMBER_OF": 0.3, "ENTRY_POINT_OF": 0.4, "HAS_PROPERTY": 0.5, "CHAINABLE_TO": 0.7, "CO_CHANGES": 0.8,
    "SEMANTICALLY_SIMILAR": 0.6, "IMPLEMENTS_PATTERN": 0.7,
}
OTHER_DECAY = 0.7
# Severities, most severe first.
SEVERITIES = ("critical", "high", "medium", "low", "info")


def round_half_up(x: Column, digits: int) -> Column:
    """Rounds halves toward plus infinity: floor(x * 10^d + 0.5) / 10^d."""
    return F.floor(x.cast("double") * 10**digits + 0.5).cast("double") / 10**digits


def edge_decay(kind: Column) -> Column:
    table = F.create_map(*(F.lit(v) for kv in EDGE_DECAY.items() for v in kv))
    return F.coalesce(F.element_at(table, kind), F.lit(OTHER_DECAY))


def distance_decay(value: Column, depth: Column, schedule: str = "linear") -> Column:
    """linear keeps the value, exponential is e^(-0.3 (d - 1)), logarithmic 1 / log2(d + 1)."""
    if schedule == "exponential":
        return value * F.exp(-0.3 * (depth - 1))
    if schedule == "logarithmic":
        return value / F.log2(depth + 1)
    return value


def noisy_or(p: Column) -> Column:
    """Aggregate: 1 - product of (1 - p)."""
    return 1 - F.product(1 - p)


def severity_rank(severity: Column) -> Column:
    """0 for critical up to 4 for info; null for others."""
    out = F.when(severity == SEVERITIES[0], 0)
    for k, name in enumerate(SEVERITIES[1:], 1):
        out = out.when(severity == name, k)
    return out


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column, strict: bool = False) -> Column:
    """0 for zero norms. Longer vectors are cut to the shorter; strict gives 0 for unequal lengths instead."""
    if strict:
        return F.when(F.size(a) == F.size(b), cosine(a, b)).otherwise(F.lit(0.0))
    n = F.least(F.size(a), F.size(b))
    a, b = F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n)
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def dirname(path: Column) -> Column:
    """All before the last slash; empty without one."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def without_extension(path: Column) -> Column:
    return F.regexp_replace(path, r"\.[^./]*$", "")


def resolve_path(base: Column, relative: Column) -> Column:
    """Joins a directory and a relative path, then resolves ``.`` and ``..`` steps."""
    steps = F.filter(F.split(F.concat_ws("/", base, relative), "/"), lambda s: (s != "") & (s != "."))
    walked = F.aggregate(steps, F.array().cast("array<string>"), lambda acc, s: F.when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(s))))
    return F.array_join(walked, "/")


def dotted_to_path(module: Column) -> Column:
    return F.replace(module, F.lit("."), F.lit("/"))


def lines_of_code(start: Column, end: Column) -> Column:
    return F.when(end > start, end - start + 1).otherwise(0)


def coverage_status(share: Column) -> Column:
    return F.when(share == 0, "uncovered").when(share >= 80, "covered").otherwise("partial")


def mermaid_id(name: Column) -> Column:
    return F.regexp_replace(name, "[^A-Za-z0-9_]", "_")


def mermaid_label(name: Column) -> Column:
    return F.regexp_replace(name, r'["\[\]{}()<>|]', "")


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), union.cast("double")), F.lit(0.0))


def one_hot(value: Column, vocabulary: list[str]) -> Column:
    return F.transform(F.array(*(F.lit(v) for v in vocabulary)), lambda v: F.coalesce((v == value).cast("int"), F.lit(0)))


def clean_version(version: Column) -> Column:
    """Drops range marks and what follows the digits and dots."""
    return F.regexp_extract(version, r"(\d+(?:\.\d+)*)", 1)
