"""Column functions on text: identifiers, evidence, lines, call expressions, small numbers."""

from __future__ import annotations

import keyword

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: words that carry no meaning in queries, and the language's keywords
STOP_TERMS = ("a", "an", "and", "are", "as", "at", "be", "by", "class", "def", "for", "from", "if", "in", "is", "it", "method", "of", "on", "or", "return", "self", "the", "to", "with")
DROPPED_TERMS = tuple(sorted({*STOP_TERMS, *keyword.kwlist}))
WORD = r"[A-Za-z_][A-Za-z0-9_]*"
DOTTED = r"\b[A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)+\b"
CALL = r"\b([A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)*)\s*\("
# fixed values: calls that are never edges
SKIPPED_CALLS = ("all", "any", "bool", "bytes", "cast", "dict", "float", "int", "isinstance", "issubclass", "len", "list", "max", "min", "object", "print", "range", "repr", "set", "str", "sum", "tuple", "type")
CALL_KEYWORDS = ("if", "for", "while", "with", "return", "yield", "await", "lambda")
SECRET_PARTS = ("authorization", "password", "secret", "api_key", "access_token", "auth_token", "bearer")


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def slashes(path: Column | str) -> Column:
    return F.translate(_c(path), "\\", "/")


def evidence_text(text: Column | str) -> Column:
    return F.regexp_replace(F.trim(F.regexp_replace(_c(text), r"\s+", " ")), " +", " ")


def safe_name(value: Column | str) -> Column:
    """Lower-case slug of letters, digits, dot, dash and underscore; ``run`` if nothing is left."""
    slug = F.regexp_replace(F.lower(F.trim(_c(value))), r"[^a-z0-9_.\-]+", "-")
    return F.coalesce(F.nullif(F.regexp_replace(slug, r"^-+|-+$", ""), F.lit("")), F.lit("run"))


def lines_of(text: Column | str) -> Column:
    r"""Lines split at any line break; a trailing break adds no empty line; null and empty text have none."""
    split = F.split(_c(text), "\\R|[\u001c\u001d\u001e]")
    whole = F.when(F.element_at(split, -1) == "", F.slice(split, F.lit(1), F.size(split) - 1)).otherwise(split)
    return F.when(F.coalesce(_c(text), F.lit("")) == "", F.array().cast("array<string>")).otherwise(whole)


def numbered_lines(lines: Column | str, start: Column | int = 1) -> Column:
    """``   7 | text`` for every line, numbers right-aligned to four places or what the last one needs."""
    first = F.lit(start) if isinstance(start, int) else start
    width = F.greatest(F.lit(4), F.length((first + F.size(_c(lines))).cast("string")))
    return F.array_join(F.transform(_c(lines), lambda x, i: F.concat(F.lpad((first + i).cast("string"), width, F.lit(" ")), F.lit(" | "), x)), "\n")


def identifier_parts(value: Column | str) -> Column:
    """Parts of a path or identifier: at separators, underscores and lower-to-upper steps."""
    return F.filter(F.split(_c(value), r"[./\\:\-\s_]+|(?<=[a-z0-9])(?=[A-Z])"), lambda x: x != "")


def tokens(text: Column | str) -> Column:
    """Lower-case identifier parts of all words in order, repeats included, without short and dropped terms."""
    words = F.regexp_extract_all(F.coalesce(_c(text), F.lit("")), F.lit(WORD), 0)
    parts = F.flatten(F.transform(words, lambda w: F.split(w, r"_+|(?<=[a-z0-9])(?=[A-Z])")))
    lowered = F.transform(parts, lambda p: F.lower(p))
    return F.filter(lowered, lambda t: (F.length(t) >= 2) & ~t.isin(*DROPPED_TERMS))


def query_terms(text: Column | str) -> Column:
    """Distinct tokens, commonest first, ties by first occurrence (short texts: worked out in the row)."""
    seen = tokens(text)
    counted = F.transform(F.array_distinct(seen), lambda t, i: F.struct((-F.size(F.filter(seen, lambda x: x == t))).alias("c"), i.alias("i"), t.alias("t")))
    return F.transform(F.array_sort(counted), lambda s: s["t"])


def dotted_symbols(text: Column | str) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.coalesce(_c(text), F.lit("")), F.lit(DOTTED), 0))


def module_name(path: Column | str) -> Column:
    """``a/b/__init__.py`` is ``a.b``."""
    bare = F.regexp_replace(slashes(path), r"\.pyi?$", "")
    return F.regexp_replace(F.replace(bare, F.lit("/"), F.lit(".")), r"(^|\.)__init__$", "")


def target_hints(target: Column | str, target_type: Column | str) -> Column:
    """struct(module, path) of a target symbol; a method's class is dropped with the method."""
    parts = F.split(_c(target), r"\.")
    cut = F.when((_c(target_type) == "method") & (F.size(parts) > 2), 2).otherwise(1)
    kept = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - cut, F.lit(0)))
    module = F.array_join(kept, ".")
    return F.struct(module.alias("module"), F.when(module == "", "").otherwise(F.concat(F.replace(module, F.lit("."), F.lit("/")), F.lit(".py"))).alias("path"))


def safe_ratio(top: Column | str, bottom: Column | str, places: int = 6) -> Column:
    """Half-even rounded ratio; null for a zero denominator."""
    return F.bround(F.try_divide(_c(top).cast("double"), _c(bottom).cast("double")), places)


def numeric_delta(after: Column | str, before: Column | str) -> Column:
    return F.bround(F.try_subtract(_c(after).cast("double"), _c(before).cast("double")), 6)


def tool_tokens(text: Column | str) -> Column:
    size = F.length(F.coalesce(_c(text), F.lit("")))
    return F.when(size == 0, 0).otherwise(F.greatest(F.lit(1), F.floor((size + 3) / 4))).cast("int")


def pack_tokens(text: Column | str, chars_per_token: float = 4.0) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.length(F.coalesce(_c(text), F.lit(""))) / chars_per_token)).cast("int")


def markdown_cell(value: Column | str) -> Column:
    escaped = F.replace(F.coalesce(_c(value).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|"))
    return F.trim(F.regexp_replace(escaped, r"\r\n|\r|\n", " "))


def as_int(value: Column | str, default: int) -> Column:
    """The whole number that the text is, white space around it aside; ``default`` for all else and beyond the range of int."""
    return F.coalesce(F.nullif(F.regexp_extract(_c(value).cast("string"), r"^\s*([+\-]?\d+)\s*$", 1), F.lit("")).try_cast("int"), F.lit(default))


def stripped(value: Column | str) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(_c(value), r"^\s+|\s+$", "")


def truthy(value: Column | str) -> Column:
    return F.coalesce(F.lower(stripped(_c(value).cast("string"))).isin("1", "true", "yes", "y"), F.lit(False))


def without_comment(line: Column | str) -> Column:
    r"""The line up to the first # outside quotes; a backslash hides the next character."""
    return F.regexp_extract(_c(line), r"""(?s)^((?:\\.|'(?:\\.|[^'\\])*(?:'|$)|"(?:\\.|[^"\\])*(?:"|$)|[^'"#\\]|\\$)*)""", 1)


def call_tail(expression: Column | str) -> Column:
    return F.substring_index(_c(expression), ".", -1)


def call_receiver(expression: Column | str) -> Column:
    e = _c(expression)
    return F.when(F.contains(e, F.lit(".")), F.regexp_replace(e, r"\.[^.]*$", ""))


def call_expressions(line: Column | str) -> Column:
    found = F.regexp_extract_all(without_comment(line), F.lit(CALL), 1)
    return F.array_distinct(F.filter(found, lambda e: ~F.substring_index(e, ".", -1).isin(*SKIPPED_CALLS) & ~e.isin(*CALL_KEYWORDS)))


def callback_arguments(evidence: Column | str) -> Column:
    e = F.coalesce(_c(evidence), F.lit(""))
    first = F.trim(F.regexp_extract(e, r"\bconnect\(([^,)\n]+)", 1))
    names = F.array_distinct(F.regexp_extract_all(e, F.lit(r"\b([A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)+)\b"), 1))
    others = F.slice(F.filter(names, lambda n: ~n.endswith(".connect") & ~F.substring_index(n, ".", -1).isin("signals", "signal")), 1, 6)
    none = F.array().cast("array<string>")
    wanted = F.contains(e, F.lit("connect(")) | F.contains(e, F.lit("register"))
    return F.when(~wanted, none).when(first.rlike(r"^[A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)+$"), F.array(first)).otherwise(others)


def boundary_role(expression: Column | str, evidence: Column | str) -> Column:
    tail = call_tail(expression)
    return (
        F.when(tail.isin("connect", "disconnect", "add_listener", "add_handler", "register", "register_handler"), "registration_or_lifecycle_boundary")
        .when(tail.isin("append", "add", "remove", "setdefault", "get", "set_value", "inc_value"), "state_or_container_call")
        .when(F.contains(_c(expression), F.lit("signals.")), "signal_dispatch_call")
        .when(F.size(callback_arguments(evidence)) > 0, "registration_with_callback_arguments")
        .otherwise("direct_call_expression")
    )


def redacted(values: Column | str) -> Column:
    """A string map with the values of secret keys hidden; keys ending in _env or _required are harmless."""

    def hide(key: Column, value: Column) -> Column:
        k = F.replace(F.lower(key), F.lit("-"), F.lit("_"))
        secret = F.lit(False)
        for part in SECRET_PARTS:
            secret = secret | F.contains(k, F.lit(part))
        harmless = k.endswith("_env") | k.endswith("_required")
        return F.when(secret & ~harmless & (F.coalesce(value, F.lit("")) != ""), "<redacted>").otherwise(value)

    return F.transform_values(_c(values), hide)


def occurrences(text: Column, pattern: Column, cap: int = 4) -> Column:
    """Non-overlapping occurrences of a literal, at most ``cap``; 0 for an empty pattern."""
    size = F.length(pattern)
    count = (F.length(text) - F.length(F.replace(text, pattern, F.lit("")))) / F.when(size > 0, size)
    return F.least(F.coalesce(count, F.lit(0)), F.lit(cap)).cast("int")


def response_content(response: Column | str) -> Column:
    return F.coalesce(F.get_json_object(_c(response), "$.message.content"), F.get_json_object(_c(response), "$.choices[0].message.content"), F.lit(""))


def iso_timestamp(ts: Column | str) -> Column:
    return F.date_format(_c(ts), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def compact_timestamp(ts: Column | str) -> Column:
    return F.date_format(_c(ts), "yyyyMMdd'T'HHmmss'Z'")


def glob_pattern(pattern: str) -> str:
    """The regular expression of a shell pattern whose * also crosses slashes."""
    import fnmatch

    return fnmatch.translate(pattern).replace(r"\Z", "$").replace(r"\z", "$")
