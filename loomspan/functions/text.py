"""Text, identifier and path functions as Column expressions; all run inside the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

STOP_WORDS = tuple(
    "a an the and or but if then else when at by for with about into to from in on of is are was were be been has have had do does did this that these those it its as not".split()
)

def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bm25_tokens(c: Column | str) -> Column:
    """Tokens of the search index: lower case, `_` and `-` part words, ASCII words of 2 to 50 characters that aren't numbers."""
    words = F.split(F.regexp_replace(F.lower(_col(c)), "[^a-z0-9]+", " "), " ")
    return F.filter(words, lambda w: (F.length(w) >= 2) & (F.length(w) <= 50) & ~w.rlike("^[0-9]+$"))


def bm25_normal(c: Column | str) -> Column:
    """The text as its index tokens sees it: words of [a-z0-9], each between spaces of its own. Counting in it needs no arrays."""
    return F.concat(F.lit(" "), F.regexp_replace(F.lower(_col(c)), "[^a-z0-9]+", "  "), F.lit(" "))


def bm25_length(normal: Column) -> Column:
    """How many bm25_tokens a normal text has: words of 2 to 50 characters with a letter."""
    return F.regexp_count(normal, F.lit(" (?=[0-9]*[a-z])[a-z0-9]{2,50} "))


def bm25_count(normal: Column, word: str) -> Column:
    """How often a word stands in a normal text."""
    found = (F.length(normal) - F.length(F.replace(normal, F.lit(f" {word} "), F.lit("")))) / (len(word) + 2)
    return F.coalesce(found.cast("int"), F.lit(0))


def embedding_tokens(c: Column | str) -> Column:
    """Tokens of the local embedder: runs of [a-z0-9_] of 2 to 49 characters; numbers stay."""
    return F.regexp_extract_all(F.lower(_col(c)), F.lit("(?<![a-z0-9_])[a-z0-9_]{2,49}+(?![a-z0-9_])"), F.lit(0))


def split_camel(c: Column | str) -> Column:
    """XMLParser2go -> [xml, parser, 2, go]"""
    s = F.regexp_replace(_col(c), "(\\p{Upper}+)(\\p{Upper}\\p{Lower})", "$1 $2")
    for pattern in ("([a-z])([A-Z])", "([A-Za-z])([0-9])", "([0-9])([A-Za-z])"):
        s = F.regexp_replace(s, pattern, "$1 $2")
    return F.filter(F.split(F.lower(s), "\\s+"), lambda w: w != "")


def _parts(c: Column | str, sign: str) -> Column:
    return F.filter(F.split(F.lower(_col(c)), sign), lambda w: w != "")


def split_snake(c: Column | str) -> Column:
    return _parts(c, "_")


def split_kebab(c: Column | str) -> Column:
    return _parts(c, "-")


def split_identifier(c: Column | str) -> Column:
    """Words of an identifier in any convention."""
    return split_camel(F.regexp_replace(_col(c), "[^A-Za-z0-9]+", " "))


def search_tokens(c: Column | str) -> Column:
    """Words of a search text: identifiers split, 2 characters at least, no stop words."""
    words = F.flatten(F.transform(F.split(_col(c), "[^A-Za-z0-9]+"), split_identifier))
    return F.filter(words, lambda w: (F.length(w) >= 2) & ~w.isin(*STOP_WORDS))


def kebab_case(c: Column | str) -> Column:
    return F.array_join(split_identifier(c), "-")


def snake_case(c: Column | str) -> Column:
    return F.array_join(split_identifier(c), "_")


def pascal_case(c: Column | str) -> Column:
    return F.array_join(F.transform(split_identifier(c), F.initcap), "")


def camel_case(c: Column | str) -> Column:
    p = pascal_case(c)
    return F.concat(F.lower(F.substring(p, 1, 1)), F.substr(p, F.lit(2)))


def truncate(c: Column | str, most: int, suffix: str = "...") -> Column:
    c = _col(c)
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most - len(suffix)), F.lit(suffix))).otherwise(c)


def is_identifier(c: Column | str) -> Column:
    return _col(c).rlike("^[A-Za-z_$][A-Za-z0-9_$]*$")


def estimate_tokens(c: Column | str) -> Column:
    """A token for every four characters, rounded up."""
    return F.ceil(F.length(_col(c)) / 4).cast("int")


def non_space_count(c: Column | str) -> Column:
    return F.length(F.regexp_replace(_col(c), "\\s", ""))


def newline_count(c: Column | str) -> Column:
    return F.regexp_count(_col(c), F.lit("\n"))


def js_trim(c: Column | str) -> Column:
    """Trims all white space, not spaces only."""
    return F.regexp_replace(_col(c), "^\\s+|\\s+$", "")


def snippet(c: Column | str, line: Column, around: int = 3) -> Column:
    """Lines of a text from `around` before the 1-based line to `around` after."""
    first = F.greatest(line - around, F.lit(1))
    return F.array_join(F.slice(F.split(_col(c), "\n"), first.cast("int"), (line + around - first + 1).cast("int")), "\n")


def byte_offset(c: Column | str, line: Column, column: Column) -> Column:
    """Offset in UTF-8 bytes of a 1-based line and a 0-based column."""
    before = F.array_join(F.slice(F.split(_col(c), "\n"), 1, (line - 1).cast("int")), "\n")
    here = F.substring_index(F.element_at(F.split(_col(c), "\n"), line.cast("int")), "\x00", 1)
    return F.octet_length(before) + F.when(line > 1, 1).otherwise(0) + F.octet_length(F.substr(here, F.lit(1), column.cast("int")))


# --- paths ---


def normalize_path(c: Column | str) -> Column:
    """Forward slashes, no '.', '..' folded, no doubled slash; a leading '/' stays."""
    c = F.regexp_replace(_col(c), "\\\\", "/")

    def fold(done: Column, part: Column) -> Column:
        up = (part == "..") & (F.size(done) > 0) & (F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit("")) != "..")
        return F.when(part.isin("", "."), done).when(up, F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(part)))

    joined = F.array_join(F.aggregate(F.split(c, "/"), F.array().cast("array<string>"), fold), "/")
    return F.when(c.startswith("/"), F.concat(F.lit("/"), joined)).otherwise(joined)


def join_path(*parts: Column) -> Column:
    return normalize_path(F.concat_ws("/", *parts))


def dirname(c: Column | str) -> Column:
    return F.regexp_extract(_col(c), "^(.*)/[^/]*$", 1)


def basename(c: Column | str) -> Column:
    return F.regexp_extract(_col(c), "([^/]*)$", 1)


def extname(c: Column | str) -> Column:
    """With the dot; '' for none and for dot files."""
    return F.regexp_extract(basename(c), "^.+(\\.[^.]*)$", 1)


def relative_path(c: Column | str, root: str) -> Column:
    c, root = normalize_path(c), root.rstrip("/") + "/"
    return F.when(c.startswith(root), F.substr(c, F.lit(len(root) + 1))).otherwise(c)


def glob_regex(glob: str) -> str:
    """A regular expression for a glob: * within a part, ** over parts, ? one character, {a,b} alternatives."""
    out, i, depth = [], 0, 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i):
            out.append("(?:.*/)?")
            i += 2
        elif glob.startswith("**", i):
            out.append(".*")
            i += 1
        elif c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "{":
            out.append("(?:")
            depth += 1
        elif c == "}" and depth:
            out.append(")")
            depth -= 1
        elif c == "," and depth:
            out.append("|")
        else:
            out.append(re.escape(c))
        i += 1
    return "^" + "".join(out) + "$"


def matches_any_glob(path: Column | str, globs: list[str]) -> Column:
    """The whole path or its last part matches one of the globs."""
    path, hit = _col(path), F.lit(False)
    for g in globs:
        hit = hit | path.rlike(glob_regex(g)) | basename(path).rlike(glob_regex(g))
    return hit


def hash32(c: Column | str) -> Column:
    """The absolute value of the 32-bit rolling hash 31 h + code."""
    chars = F.filter(F.split(_col(c), ""), lambda x: x != "")
    wrap = lambda h: F.pmod(h + F.lit(2**31), F.lit(2**32)) - F.lit(2**31)
    return F.abs(F.aggregate(chars, F.lit(0).cast("long"), lambda h, x: wrap(h * 31 + F.ascii(x))))


def short_sha(c: Column | str, length: int = 64) -> Column:
    return F.substring(F.sha2(_col(c).cast("string"), 256), 1, length)


LANGUAGES = {
    "typescript": "ts tsx mts cts", "javascript": "js jsx mjs cjs", "python": "py pyi pyw", "go": "go", "rust": "rs", "java": "java", "kotlin": "kt kts", "swift": "swift", "ruby": "rb rake", "php": "php",
    "cpp": "cpp cc cxx hpp hxx h hh", "c": "c", "csharp": "cs", "scala": "scala sc", "dart": "dart", "lua": "lua", "elixir": "ex exs", "haskell": "hs", "html": "html htm", "css": "css scss less", "json": "json",
}
LEGACY_LANGUAGES = {
    "typescript": "ts tsx", "javascript": "js jsx mjs cjs", "python": "py", "go": "go", "rust": "rs", "java": "java", "csharp": "cs", "cpp": "cpp cc cxx c h hpp", "ruby": "rb", "php": "php", "swift": "swift", "kotlin": "kt", "dart": "dart",
}


def language_of(path: Column | str, languages: dict[str, str] = LANGUAGES, default: str | None = None) -> Column:
    """The language of a file's extension; the first language that has it wins."""
    known: dict[str, str] = {}
    for name, extensions in languages.items():
        for x in extensions.split():
            known.setdefault(f".{x}", name)
    table = F.create_map(*[F.lit(x) for item in known.items() for x in item])
    return F.coalesce(F.try_element_at(table, F.lower(extname(path))), F.lit(default))
