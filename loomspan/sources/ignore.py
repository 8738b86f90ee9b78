"""Ignore files: gitignore patterns as one Column expression; the last pattern that matches decides."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import glob_regex

DEFAULTS = ("node_modules/", ".git/", "dist/", "build/", "coverage/", "__pycache__/", "*.min.js", "*.map", "*.lock")
IGNORE_FILES = (".gitignore", ".contextignore", ".loomspanignore")
BINARY = ".png .jpg .jpeg .gif .ico .webp .pdf .zip .gz .tar .7z .rar .exe .dll .so .dylib .class .jar .wasm .woff .woff2 .ttf .eot .mp3 .mp4 .avi .mov .bin .dat .db .sqlite .pyc".split()


def parse(text: str) -> list[tuple[str, bool]]:
    """(regular expression over relative paths, negated) for each pattern of an ignore file."""
    out = []
    for line in text.split("\n"):
        line = line.rstrip("\r ").lstrip()
        if not line or line.startswith("#"):
            continue
        negated = line.startswith("!")
        p = line[1:] if negated else line
        folder = p.endswith("/")
        p = p.strip("/") if "/" in p.rstrip("/") else p.rstrip("/")
        anchored = "/" in line.rstrip("/").lstrip("!")
        body = glob_regex(p)[1:-1]
        out.append((f"^{'' if anchored else '(?:.*/)?'}{body}{'/.*' if folder else '(?:/.*)?'}$", negated))
    return out


def ignored(path: Column | str, patterns: list[tuple[str, bool]]) -> Column:
    path = F.col(path) if isinstance(path, str) else path
    said = F.lit(False)
    for pattern, negated in patterns:
        said = F.when(path.rlike(pattern), not negated).otherwise(said)
    return said


def is_ignored(path: str, patterns: list[tuple[str, bool]]) -> bool:
    said = False
    for pattern, negated in patterns:
        if re.match(pattern, path):
            said = not negated
    return said


def binary_extension(path: Column | str) -> Column:
    path = F.col(path) if isinstance(path, str) else path
    return F.lower(path).rlike(f"({'|'.join(re.escape(x) for x in BINARY)})$")


def binary_content(content: Column) -> Column:
    """A NUL within the first 8 KB of a binary column."""
    return F.locate("00", F.regexp_replace(F.hex(F.substring(content, 1, 8192)), "(..)", "$1 ")) > 0
