"""Scalar functions on text, names and vectors, as Column expressions that stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters of a token in the full-text index.
TOKEN_BREAK = "[^a-z0-9]+"


def tokens(text: Column) -> Column:
    """Lower-case alphanumeric tokens in order."""
    return F.filter(F.split(F.lower(text), TOKEN_BREAK), lambda t: t != "")


def split_camel(name: Column) -> Column:
    """Parts of a camelCase or snake_case name; runs of capitals stay together up to the last one before a lower letter."""
    marked = F.regexp_replace(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1_$2"), "([A-Z]+)([A-Z][a-z])", "$1_$2")
    return F.filter(F.split(F.lower(marked), "[^a-z0-9]+"), lambda t: t != "")


def shingles(items: Column, k: int) -> Column:
    """Distinct runs of k items; a shorter list gives one shingle of all its items, an empty one none."""
    n = F.size(items)
    runs = F.transform(F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1))), lambda i: F.array_join(F.slice(items, i, k), " "))
    return F.when(n == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(runs))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all distinct items; 0 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def overlap_ratio(a: Column, b: Column) -> Column:
    return F.when(F.greatest(a, b) == 0, 0.0).otherwise(F.least(a, b) / F.greatest(a, b))


def fuzzy_threshold(length: Column) -> Column:
    return F.when(length <= 3, 0).when(length <= 5, 1).when(length <= 8, 2).otherwise(3)


def arity(params: Column) -> Column:
    inner = F.btrim(F.regexp_replace(F.coalesce(params, F.lit("")), r"^\(|\)$", ""))
    return F.when(inner == "", 0).otherwise(F.size(F.split(inner, ",")))


def chunk_id(source: Column, content: Column) -> Column:
    """SHA-256 of source, a zero byte and the content without white space of Unicode at its ends."""
    return F.sha2(F.concat(F.encode(source, "UTF-8"), F.unhex(F.lit("00")), F.encode(F.regexp_replace(content, r"(?U)^\s++|(?<!\s)\s++\z", ""), "UTF-8")), 256)


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 for vectors of different length or without length."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (norms == 0), 0.0).otherwise(dot(a, b) / norms)


def approx_tokens(text: Column, bytes_per_token: int = 4) -> Column:
    return F.ceil(F.octet_length(text) / bytes_per_token)


#: Patterns of secrets and what replaces them; words, blanks and letter case are those of Unicode. Fixed values.
SECRETS = [
    (r"(?iU)\b(password|passwd|secret|token|api[_-]?key)(\s*[=:]\s*)[^\s,;]+", "$1$2[redacted]"),
    (r"(?U)\b[0-9a-fA-F]{32,}\b", "[redacted]"),
    (r"(?U)\b(?:ghp|gho|sk|pk|AKIA)[_-]?[A-Za-z0-9]{16,}\b", "[redacted]"),
]


def redact(text: Column) -> Column:
    for pattern, to in SECRETS:
        text = F.regexp_replace(text, pattern, to)
    return text


def chunk_text(kind: Column, name: Column, params: Column, ret: Column, qn: Column) -> Column:
    """One line that describes a node: kind name(params) -> ret  [qn]."""
    return F.concat(kind, F.lit(" "), name, F.when(F.coalesce(params, F.lit("")) != "", params).otherwise(""), F.when(F.coalesce(ret, F.lit("")) != "", F.concat(F.lit(" -> "), ret)).otherwise(""), F.lit("  ["), qn, F.lit("]"))


def signature_hash(*parts: Column) -> Column:
    """SHA-256 of the parts with a unit separator; null if all are null."""
    joined = F.sha2(F.concat_ws("\u001f", *(F.coalesce(p, F.lit("")) for p in parts)), 256)
    return F.when(F.coalesce(*parts).isNotNull(), joined)


def edge_hash(kind: Column, confidence: Column, tier: Column) -> Column:
    return F.sha2(F.concat_ws("|", kind, F.format_string("%.6f", confidence), F.coalesce(tier, F.lit(""))), 256)


def module_key(path: Column) -> Column:
    """packages/x, src/x or tests/x, else the first part of the path."""
    two = F.regexp_extract(path, r"^((?:packages|src|tests)/[^/]+)/", 1)
    return F.when(two != "", two).otherwise(F.regexp_extract(path, r"^([^/]+)", 1))


def content_type(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.when(ext.isin("md", "rst", "txt"), "prose").when(ext.isin("json", "toml", "yaml", "yml"), "config").when(ext.isin("html", "tmpl", "j2"), "template").when(ext == "", "none").otherwise("code")


#: Phrases that show what a question asks for, first match counts. Fixed values.
INTENTS = [("impact", "affect|impact|break"), ("rename", "rename"), ("dead_code", "unused|dead code"), ("review", "review|check"), ("usage", "who calls|callers of|used by"), ("explain", "explain|how does|see how|why")]


def intent(text: Column) -> Column:
    low = F.lower(text)
    out = F.when(F.lit(False), "")
    for name, pattern in INTENTS:
        out = out.when(low.rlike(pattern), name)
    return out.otherwise("search")


def target_of(text: Column) -> Column:
    """Quoted name, path-like name or snake_case word of a question, in that order; empty if there is none."""
    found = [F.regexp_extract(text, p, 1) for p in (r"`([^`]+)`", r"([A-Za-z_]+::[A-Za-z_:]+)", r"\b([a-z]+(?:_[a-z0-9]+)+)\b")]
    return F.coalesce(*(F.when(f != "", f) for f in found), F.lit(""))


def search_words(text: Column) -> Column:
    """Words as full-text search sees them: runs of letters, digits and underscores, in their own case."""
    return F.filter(F.split(text, r"[^\p{L}\p{N}_]+"), lambda t: t != "")


def escape_query(text: Column) -> Column:
    """A query that can't break the grammar of a full-text search: plain terms, with * at their ends, and OR pass; all else becomes one quoted phrase."""
    plain = text.rlike(r"^\s*[A-Za-z0-9_]+\*?(?:\s+[A-Za-z0-9_]+\*?)*\s*\z")
    return F.when(plain, text).otherwise(F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"')))


def band(score: Column, medium: float, high: float) -> Column:
    return F.when(score >= high, "high").when(score >= medium, "medium").otherwise("low")
