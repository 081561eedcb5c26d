"""Tokenisers, token estimates, compression and labels as native column expressions."""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the query tokeniser.
STOPWORDS = "a an and or the of to in is for on with by at as it be do if we".split()
TRIMMED = "\"'.,;:!?()[]{}/\\`"
SENTINEL = "\n\n<!--QUARRY_IDX\n"
SYMBOL_TYPES = "function method type variable class struct interface type_alias constant trait impl enum".split()
CODE_FILES = "go_file ts_file js_file py_file rs_file".split()
EXTENSION_TYPES = {".go": "go_file", ".ts": "ts_file", ".tsx": "ts_file", ".js": "js_file", ".jsx": "js_file", ".py": "py_file", ".rs": "rs_file", ".md": "text_file", ".txt": "text_file"}
EXTENSION_LANGS = {".go": "go", ".ts": "typescript", ".tsx": "typescript", ".js": "javascript", ".jsx": "javascript", ".py": "python", ".rs": "rust"}


def _folds() -> tuple[str, str]:
    """Letters with marks and their bases, by Unicode decomposition."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))[0]) for c in range(0xC0, 0x250) if unicodedata.decomposition(chr(c)) and not unicodedata.decomposition(chr(c)).startswith("<")]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_MARKED, _PLAIN = _folds()
_COMBINING = "".join(chr(c) for c in range(0x300, 0x370) if c < sys.maxunicode)


def strip_accents(x: Column) -> Column:
    return F.translate(x, _MARKED + _COMBINING, _PLAIN)


def unicode_terms(x: Column) -> Column:
    """Full-text terms: runs of letters, digits and private-use characters, folded to lower case without marks."""
    return F.filter(F.split(strip_accents(F.lower(F.coalesce(x, F.lit("")))), r"[^\p{L}\p{N}\p{Co}]+"), lambda t: t != "")


def stem(token: Column) -> Column:
    """Tokens of ten bytes or more lose their last three bytes."""
    cut = F.substring(token.cast("binary"), F.lit(1), F.octet_length(token) - 3).cast("string")
    return F.when(F.octet_length(token) >= 10, cut).otherwise(token)


def raw_tokens(x: Column) -> Column:
    """Lower-case words, trimmed of punctuation, without one-byte words and stopwords."""
    edge = r"[\"'.,;:!?()\[\]{}/\\`]"
    parts = F.split(F.lower(F.coalesce(x, F.lit(""))), r"(?U)\s+")
    bare = F.transform(parts, lambda t: F.regexp_replace(t, f"^{edge}+|{edge}+$", ""))
    return F.filter(bare, lambda t: (F.octet_length(t) > 1) & ~t.isin(STOPWORDS))


def tokenise_query(x: Column) -> Column:
    """Stemmed tokens in order. A token is skipped if it equals an earlier result, so a long word that
    repeats comes twice: its result is shorter than itself. A fold, meant for short texts."""
    return F.aggregate(raw_tokens(x), F.array().cast("array<string>"), lambda acc, t: F.when(F.array_contains(acc, t), acc).otherwise(F.concat(acc, F.array(stem(t)))))


def token_set(x: Column) -> Column:
    """Distinct stemmed tokens of long texts, for membership."""
    return F.array_distinct(F.transform(raw_tokens(x), stem))


def split_identifiers(x: Column) -> Column:
    """Parts of camel-case and snake-case identifiers: lower case, three characters or more, distinct, in order."""
    words = F.array_distinct(F.regexp_extract_all(F.coalesce(x, F.lit("")), F.lit("[A-Za-z0-9]+"), 0))
    cut = lambda w: F.split(w, "(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])")
    parts = F.flatten(F.transform(words, lambda w: F.when(w.rlike("[a-z][A-Z]|[A-Z]{2}[a-z]"), cut(w)).otherwise(F.array(w))))
    return F.array_distinct(F.filter(F.transform(parts, F.lower), lambda t: F.length(t) >= 3))


def vocabulary_tokens(x: Column) -> Column:
    return F.array_union(token_set(x), split_identifiers(x))


def file_stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"\.[^.]*$", "")


def index_text(content: Column, path: Column) -> Column:
    """What the full-text index adds to a file's content."""
    return F.array_join(F.array_union(split_identifiers(content), split_identifiers(file_stem(path))), "\n")


def augment(content: Column, path: Column) -> Column:
    return F.concat(content, F.lit(SENTINEL), index_text(content, path))


def strip_augment(content: Column) -> Column:
    return F.substring_index(content, SENTINEL, 1)


def estimate_tokens(x: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.octet_length(F.coalesce(x, F.lit(""))) / 4)).cast("bigint")


def truncate_lines(x: Column, n: int) -> Column:
    lines = F.split(x, "\n")
    more = F.size(lines) - n
    return F.when(more > 0, F.concat(F.array_join(F.slice(lines, 1, n), "\n"), F.lit("\n... ("), more.cast("string"), F.lit(" lines omitted)"))).otherwise(x)


def file_id(node_id: Column) -> Column:
    return F.regexp_replace(node_id, ":[^:]*$", "")


def directory(node_id: Column) -> Column:
    """The directory of a file or of a symbol's file; (root) without one."""
    path = F.substring_index(node_id, ":", 1)
    found = F.regexp_extract(path, "^(.*)/[^/]*$", 1)
    return F.when(found == "", F.lit("(root)")).otherwise(found)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))


def _mapped(x: Column, table: dict[str, str], other: str) -> Column:
    out = F.lit(other)
    for value in sorted(set(table.values())):
        out = F.when(x.isin([k for k, v in table.items() if v == value]), F.lit(value)).otherwise(out)
    return out


def file_type(path: Column) -> Column:
    return _mapped(extension(path), EXTENSION_TYPES, "text_file")


def language(path: Column) -> Column:
    return _mapped(extension(path), EXTENSION_LANGS, "text")


def type_factor(node_id: Column, kind: Column) -> Column:
    """Weight of a full-text hit by the kind of its file."""
    return F.when(node_id.endswith("_test.go"), 0.5).when(kind.isin(CODE_FILES), 1.0).when(kind == "text_file", 0.3).otherwise(0.7)


def type_boost(kind: Column) -> Column:
    return F.when(kind.isin(SYMBOL_TYPES), 0.5).when(kind.isin(CODE_FILES), 0.2).when(kind == "import", 0.0).otherwise(0.1)


def term_coverage(query: Column, tokens: Column) -> Column:
    """Share of the query's tokens (repeats counted) among the tokens; 1 without any."""
    both = F.array_intersect(query, tokens)  # by hashes
    repeats = F.size(query) - F.size(F.array_distinct(query))
    held = F.when(repeats == 0, F.size(both)).otherwise(F.size(F.filter(query, lambda t: F.array_contains(both, t))))
    return F.when(F.size(query) == 0, 1.0).otherwise(held / F.size(query))


def signatures(content: Column, most: int) -> Column:
    """Lines of Python source that import or define, cut after `most`."""
    lines = F.filter(F.split(content, "\n"), lambda x: F.trim(x).rlike(r"^(import |from |def |class |async def )"))
    return truncate_lines(F.array_join(lines, "\n"), most)


def compress(node_id: Column, kind: Column, content: Column, outline: Column | None = None) -> Column:
    """The short form for a first try: symbols 15 lines, imports their id, code its outline, else 30 lines."""
    code = outline if outline is not None else F.when(kind == "py_file", signatures(content, 60)).otherwise(truncate_lines(content, 60))
    return F.when(kind.isin(SYMBOL_TYPES), truncate_lines(content, 15)).when(kind == "import", node_id).when(kind.isin(CODE_FILES), code).otherwise(truncate_lines(content, 30))


def compress_hard(node_id: Column, kind: Column, content: Column) -> Column:
    """The form for what did not fit: symbols 3 lines, imports their id, else 8 lines."""
    return F.when(kind.isin(SYMBOL_TYPES), truncate_lines(content, 3)).when(kind == "import", node_id).otherwise(truncate_lines(content, 8))


def summary_line(node_id: Column, kind: Column, content: Column) -> Column:
    first = F.trim(F.element_at(F.split(content, "\n"), 1))
    lines = F.size(F.split(content, "\n"))
    label = F.concat(F.lit("["), language(node_id), extension(node_id), F.lit("] "), node_id, F.lit(" ("), lines.cast("string"), F.lit(" lines)"))
    symbol = F.concat(F.lit("["), kind, F.lit("] "), node_id, F.lit(" — "), first)
    return F.when(kind.isin("function", "type", "variable"), symbol).when(kind == "import", F.concat(F.lit("[import] "), node_id)).otherwise(label)


def first_runes(x: Column, n: int) -> Column:
    """The first n code points."""
    return F.substring(x, 1, n)


def file_context(content: Column, line: Column, radius: int) -> Column:
    """Numbered lines around one, which is marked."""
    lines = F.split(content, "\n")
    low = F.greatest(F.lit(1), line - radius)
    shown = F.slice(lines, low, F.greatest(F.lit(0), line + radius - low + 1))
    return F.array_join(F.transform(shown, lambda x, i: F.concat(F.when(low + i == line, "> ").otherwise("  "), F.format_string("%4d: ", low + i), x)), "\n")


def directory_summary(names: Column) -> Column:
    """Base names without extensions of the first five files; an ellipsis if there are five or more."""
    first = F.slice(F.sort_array(names), 1, 5)
    return F.concat(F.array_join(F.transform(first, file_stem), ", "), F.when(F.size(names) >= 5, ", …").otherwise(""))
