"""Rows out of source files: symbols, imports, chunks, API entries."""

from __future__ import annotations

import ast
import itertools
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.text import language_of
from .layout import spread

SYMBOLS = "file_path string, name string, kind string, line int, end_line int, exported boolean, is_async boolean, parent string, params array<string>, return_type string, extends array<string>, implements array<string>"
IMPORTS = "file_path string, source string, names array<string>, is_default boolean, is_namespace boolean, line int"
CALLS = "file_path string, callee string, caller string, line int"
CHUNKS = "id string, file_path string, start_line int, end_line int, content string, type string, symbols array<string>, token_count int, imports array<string>"

_NAME = r"([A-Za-z_$][\w$]*)"
_PIECES = {
    "NAME": rf"{_NAME}\s*", "TYPES": r"(?:<.*?>)?\s*", "ARGS": r"\((?P<args>(?s:.*?))\)", ":RET": r"(?:\s*:\s*(?P<ret>[^\n{=;]+))?", "->RET": r"(?:\s*->\s*(?P<ret>[^\n{:]+))?",
    "KIND": r"[\w<>\[\], ]+\s+", "BODY": r"\s*(?:async\s*)?(?:const\s*)?\{", "RECEIVER": r"(?:\([^)]*\)\s*)?", "VALUE": r"(?::[^=\n]+)?=\s*", "LAMBDA": r"(?:async\s*)?(?:\(.*?\)|[\w$]+)\s*(?::[^=\n]+)?=>",
    "PLAIN": r"(?!(?:async\s*)?(?:\(.*?\)|[\w$]+)\s*(?::[^=\n]+)?=>)", "CAPS": r"([A-Z][A-Z0-9_]+)\s*", "RUBY": r"(?:self\.)?([A-Za-z_]\w*[?!]?)", "STAR": r"\*?\s*", "VIS": r"(?:\([^)]*\)\s+)?",
}


def _pattern(template: str) -> str:
    """A regular expression for a definition's head. Words stand for themselves and white space, `a/b` for either, a final ?
    makes them optional; capitals are pieces. A leading ^ forbids indentation, a leading ~ allows anything before."""
    out = "" if template[0] == "~" else "^" if template[0] == "^" else r"^\s*"
    for x in template.lstrip("^~").split():
        bare = x.rstrip("?")
        piece = _PIECES.get(bare) or f"(?:{'|'.join(map(re.escape, bare.split('/')))})\\s+"
        out += f"(?:{piece})?" if x != bare else piece
    return out


_SCRIPT = {
    "function": "export? default? async? function STAR NAME TYPES ARGS :RET || export? const/let/var NAME VALUE LAMBDA", "class": "export? default? abstract? class NAME", "interface": "export? interface NAME",
    "type": "export? type NAME TYPES VALUE", "constant": "export? const NAME VALUE PLAIN",
}
DEFINITIONS: dict[str, dict[str, str]] = {
    "typescript": _SCRIPT,
    "javascript": {k: v for k, v in _SCRIPT.items() if k not in ("interface", "type")},
    "python": {"function": "async? def NAME ARGS ->RET", "class": "class NAME", "constant": "^CAPS VALUE"},
    "go": {"function": "^func RECEIVER NAME ARGS", "class": "^type NAME struct", "interface": "^type NAME interface", "constant": "^const NAME"},
    "rust": {"function": "pub? VIS async? fn NAME TYPES ARGS ->RET", "class": "pub? VIS struct/enum NAME", "interface": "pub? VIS trait NAME", "type": "pub? VIS type NAME", "constant": "pub? VIS const/static NAME"},
    "java": {"function": "public/private/protected static? final? KIND NAME ARGS", "class": "public? abstract/final? class NAME", "interface": "public? interface NAME", "constant": "~static final KIND NAME VALUE"},
    "csharp": {"function": "public/private/protected/internal static? async? KIND NAME ARGS", "class": "public? abstract/sealed? class NAME", "interface": "public? interface NAME", "constant": "~const KIND NAME VALUE"},
    "cpp": {"function": "KIND NAME ARGS BODY", "class": "class/struct NAME", "constant": "#define NAME"},
    "ruby": {"function": "def RUBY", "class": "class NAME", "interface": "module NAME", "constant": "CAPS VALUE"},
    "php": {"function": "public/private/protected? static? function NAME ARGS", "class": "abstract/final? class NAME", "interface": "interface NAME", "constant": "const NAME"},
    "swift": {"function": "public/private? static? func NAME TYPES ARGS ->RET", "class": "public? final? class/struct NAME", "interface": "public? protocol NAME", "type": "typealias NAME", "constant": "static? let NAME"},
    "kotlin": {"function": "override? suspend? fun TYPES NAME ARGS :RET", "class": "data/open/abstract? class NAME", "interface": "interface NAME", "type": "typealias NAME", "constant": "const val NAME"},
    "dart": {"function": "KIND? NAME ARGS BODY", "class": "abstract? class NAME", "type": "typedef NAME", "constant": "const KIND? NAME VALUE"},
}
PATTERNS = {lang: {k: [_pattern(p.strip()) for p in t.split("||")] for k, t in kinds.items()} for lang, kinds in DEFINITIONS.items()}
_COMPILED = {lang: [(k, re.compile(p, re.M)) for k, ps in kinds.items() for p in ps] for lang, kinds in PATTERNS.items()}
_HEADER = re.compile(r"(?:extends\s+([\w$.<>, ]+?))?\s*(?:implements\s+([\w$.<>, ]+?))?\s*\{")
_KEYWORDS = {"if", "for", "while", "switch", "catch", "return", "else", "do"}


def _block_end(lines: list[str], first: int, lang: str) -> int:
    """The last line (1-based) of the definition that begins at the given line."""
    if lang in ("python", "ruby"):
        indent = len(lines[first - 1]) - len(lines[first - 1].lstrip())
        end = first
        for i in range(first, len(lines)):
            if lines[i].strip():
                if len(lines[i]) - len(lines[i].lstrip()) <= indent:
                    return end + (lang == "ruby" and lines[i].strip() == "end")
                end = i + 1
        return end
    depth, opened = 0, False
    for i in range(first - 1, len(lines)):
        depth += lines[i].count("{") - lines[i].count("}")
        opened = opened or "{" in lines[i]
        if opened and depth <= 0:
            return i + 1
        if not opened and (lines[i].rstrip().endswith(";") or i > first + 5):
            return first
    return len(lines) if opened else first


def symbols_of(path: str, content: str, lang: str | None) -> list[dict]:
    if lang == "python":
        try:
            return _python_symbols(path, content)
        except (SyntaxError, ValueError, RecursionError):
            pass
    lines, found, seen = content.split("\n"), [], set()
    for kind, pattern in _COMPILED.get(lang or "", []):
        for m in pattern.finditer(content):
            name = m[1]
            if name in _KEYWORDS:
                continue
            at = content.count("\n", 0, m.start(1)) + 1
            if (name, at) in seen:
                continue
            seen.add((name, at))
            text, named = m.group(0), m.groupdict()
            row = {"file_path": path, "name": name, "kind": kind, "line": at, "end_line": _block_end(lines, at, lang), "exported": "export" in text or text.lstrip().startswith("pub"), "is_async": bool(re.search(r"\basync\b", text)), "parent": None, "params": [p.strip() for p in (named.get("args") or "").split(",") if p.strip()], "return_type": (named.get("ret") or "").strip() or None, "extends": [], "implements": []}
            if kind in ("class", "interface"):
                head = _HEADER.search(content, m.end(), m.end() + 400)
                if head:
                    row["extends"], row["implements"] = ([x.strip() for x in (g or "").split(",") if x.strip()] for g in head.groups())
            found.append(row)
    found.sort(key=lambda r: (r["line"], r["name"]))
    if lang in ("typescript", "javascript", "java", "csharp", "cpp", "php", "dart", "swift", "kotlin"):
        found += _methods(path, lines, [r for r in found if r["kind"] == "class"], {(r["name"], r["line"]) for r in found})
    return found


_METHOD = re.compile(r"^\s+" + "".join(f"(?:(?:{w})\\s+)?" for w in ("public|private|protected", "static", "override", "readonly", "async", "get|set")) + _PIECES["NAME"] + _PIECES["TYPES"] + r"\(([^()]*)\)" + r"\s*(?::\s*([^{]+))?\{")


def _methods(path: str, lines: list[str], classes: list[dict], known: set) -> list[dict]:
    out = []
    for c in classes:
        for i in range(c["line"], c["end_line"]):
            m = _METHOD.match(lines[i]) if i < len(lines) else None
            if m and m[1] not in _KEYWORDS and (m[1], i + 1) not in known:
                out.append({"file_path": path, "name": m[1], "kind": "method", "line": i + 1, "end_line": _block_end(lines, i + 1, "typescript"), "exported": not re.match(r"\s+private\b", lines[i]), "is_async": "async " in lines[i], "parent": c["name"], "params": [p.strip() for p in m[2].split(",") if p.strip()], "return_type": (m[3] or "").strip() or None, "extends": [], "implements": []})
    return out


def _python_symbols(path: str, content: str) -> list[dict]:
    out = []

    def visit(node: ast.AST, parent: str | None) -> None:
        for x in ast.iter_child_nodes(node):
            if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                cls = isinstance(x, ast.ClassDef)
                out.append({"file_path": path, "name": x.name, "kind": "class" if cls else "method" if parent else "function", "line": x.lineno, "end_line": x.end_lineno, "exported": not x.name.startswith("_"), "is_async": isinstance(x, ast.AsyncFunctionDef), "parent": parent, "params": [] if cls else [a.arg for a in x.args.args], "return_type": ast.unparse(x.returns) if not cls and x.returns else None, "extends": [ast.unparse(b) for b in x.bases] if cls else [], "implements": []})
                visit(x, x.name if cls else parent)
            elif isinstance(x, ast.Assign) and isinstance(node, ast.Module) and isinstance(x.targets[0], ast.Name) and x.targets[0].id.isupper():
                out.append({"file_path": path, "name": x.targets[0].id, "kind": "constant", "line": x.lineno, "end_line": x.end_lineno, "exported": True, "is_async": False, "parent": None, "params": [], "return_type": None, "extends": [], "implements": []})

    visit(ast.parse(content), None)
    return out


_IMPORT_JS = re.compile(r"""^\s*import\s+(?:type\s+)?(?:(?P<default>[\w$]+)\s*,?\s*)?(?:\{(?P<names>[^}]*)\}|\*\s+as\s+(?P<ns>[\w$]+))?\s*(?:from\s*)?['"](?P<src>[^'"]+)['"]""", re.M)
_IMPORT_PY = re.compile(r"^\s*(?:from\s+(?P<src>[\w.]+)\s+import\s+(?P<names>[^\n#]+)|import\s+(?P<mods>[\w., ]+))", re.M)
_IMPORT_ANY = re.compile(r"""^\s*(?:import|use|require|require_once|include|using|#include)\s*\(?\s*["'<]?(?P<src>[\w./:\\-]+)""", re.M)


def imports_of(path: str, content: str, lang: str | None) -> list[dict]:
    out = []
    row = lambda m, src, names=(), default=False, ns=False: out.append({"file_path": path, "source": src, "names": list(names), "is_default": default, "is_namespace": ns, "line": content.count("\n", 0, m.start("src") if m.re.groupindex.get("src") and m["src"] else m.start()) + 1})
    if lang in ("typescript", "javascript"):
        for m in _IMPORT_JS.finditer(content):
            names = [x.split(" as ")[0].replace("type ", "").strip() for x in (m["names"] or "").split(",") if x.strip()]
            row(m, m["src"], ([m["default"]] if m["default"] else []) + names + ([m["ns"]] if m["ns"] else []), bool(m["default"]), bool(m["ns"]))
    elif lang == "python":
        for m in _IMPORT_PY.finditer(content):
            if m["src"]:
                row(m, m["src"], [x.split(" as ")[0].strip(" ()") for x in m["names"].split(",") if x.strip(" ()")])
            else:
                for x in m["mods"].split(","):
                    row(m, x.split(" as ")[0].strip(), [x.split(" as ")[0].strip()])
    else:
        for m in _IMPORT_ANY.finditer(content):
            row(m, m["src"])
    return out


_CALL = re.compile(r"(?:(?<![\w$.])|(?<=\)\.))((?:[A-Za-z_$][\w$]*\.)*[A-Za-z_$][\w$]*)\s*\(")


def calls_of(path: str, content: str, symbols: list[dict]) -> list[dict]:
    """Calls by name, with the innermost definition around them; our own extractor."""
    spans = sorted(((s["line"], s["end_line"], s["name"]) for s in symbols if s["kind"] in ("function", "method")), key=lambda s: (s[0], -s[1]))
    defined = {(s["name"], s["line"]) for s in symbols}
    out = []
    for i, line in enumerate(content.split("\n"), 1):
        for m in _CALL.finditer(line):
            name = m[1]
            if name.split(".")[-1] in _KEYWORDS or (name, i) in defined or re.search(r"\b(?:function|def|fn|func|class)\s*$", line[: m.start()]):
                continue
            around = [n for a, b, n in spans if a <= i <= b]
            out.append({"file_path": path, "callee": name, "caller": around[-1] if around else None, "line": i})
    return out


#: Characters of text read and rows made that a Python worker holds at once; they bound memory, not the work.
PIECE_CHARS, PIECE_ROWS = 1_000_000, 5_000


def _in_pieces(made: Callable[..., list[dict]], text: int, schema: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow: the rows that `made` makes of the columns of each row, of which number `text` is a text. Rows go on in
    pieces, so that a worker holds one batch of texts as Arrow has it, and Python objects of no more than a piece and a row."""
    arrow = to_arrow_schema(T.StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held = [], 0
        for batch in batches:
            for cells in zip(*batch.columns):
                values = [x.as_py() for x in cells]
                held += len(values[text] or "")
                try:  # a file that can't be parsed gives no rows, and the others go on
                    out += made(*values)
                except (re.error, RecursionError, ValueError):
                    continue
                if held >= PIECE_CHARS or len(out) >= PIECE_ROWS:
                    yield pa.RecordBatch.from_pylist(out, arrow)
                    out, held = [], 0
        yield pa.RecordBatch.from_pylist(out, arrow)

    return run


def _rows(files: DataFrame, make, schema: str) -> DataFrame:
    lang = F.col("language") if "language" in files.columns else language_of("path")
    run = _in_pieces(lambda path, content, language: make(path, content or "", language), 1, schema)
    return spread(files.select("path", "content", lang.alias("language"))).mapInArrow(run, schema)


def symbols(files: DataFrame) -> DataFrame:
    return _rows(files, symbols_of, SYMBOLS)


def imports(files: DataFrame) -> DataFrame:
    return _rows(files, imports_of, IMPORTS)


def calls(files: DataFrame) -> DataFrame:
    return _rows(files, lambda p, c, lang: calls_of(p, c, symbols_of(p, c, lang)), CALLS)


def description(content: Column) -> Column:
    """The first comment within ten lines."""
    head = F.slice(F.split(content, "\n"), 1, 10)
    said = F.filter(F.transform(head, lambda x: F.trim(F.regexp_extract(x, "^\\s*(?:/\\*\\*?|//+|#+|\\*|\"\"\")\\s*(.*?)\\s*(?:\\*/|\"\"\")?\\s*$", 1))), lambda x: (x != "") & ~x.startswith("!") & ~x.startswith("/"))
    return F.try_element_at(said, F.lit(1))


ENTRY_POINTS = tuple(f"{d}{n}" for d in ("", "src/") for n in ("index.ts", "index.js", "main.ts", "main.js", "main.py"))


def entry_points(files: DataFrame, package: str | None = None) -> DataFrame:
    """(path): conventional ones, and what package.json names in main or bin."""
    known = files.select("path").filter(F.col("path").isin(*ENTRY_POINTS))
    if package is None:
        return known
    spark = files.sparkSession
    p = spark.createDataFrame([(package,)], "j string")
    named = p.select(F.explode(F.concat(F.array(F.get_json_object("j", "$.main")), F.coalesce(F.map_values(F.from_json(F.get_json_object("j", "$.bin"), "map<string,string>")), F.array(F.get_json_object("j", "$.bin"))))).alias("path"))
    return known.unionByName(named.filter("path is not null").select(F.regexp_replace("path", "^\\./", "").alias("path"))).distinct()


def project_name(package: Column, folder: Column) -> Column:
    return F.coalesce(F.get_json_object(package, "$.name"), F.element_at(F.split(folder, "/"), -1))


# --- chunks ---

MIN_TOKENS, MAX_TOKENS, LOOK_BACK = 50, 500, 20
CAST_MAX, CAST_MIN, CAST_BEST = 1600, 160, 1200
_COMMENT = re.compile(r"^\s*(?://|#|/\*|\*|\"\"\"|@)")
_BOUNDARY = re.compile(_pattern("export? async? function/class/interface/type/const/let/var/def/fn/func/pub/struct/enum/impl"))
BLOCKS = (("function", r"\b(?:function|def|fn|func)\b"), ("class", r"\bclass\b"), ("loop", r"\b(?:for|while)\b"), ("conditional", r"\b(?:if|switch|match)\b"), ("error-handling", r"\b(?:try|catch|except)\b"), ("import", r"^\s*(?:import|from|use)\b"))


def _tokens(text: str) -> int:
    return -(-len(text) // 4)


def _ink(text: str) -> int:
    return len(re.sub(r"\s", "", text))


def leading_comments(lines: list[str], line: int) -> int:
    """The first line (1-based) of the comments right above, at most 20 lines back."""
    at = line
    while at > 1 and line - at < LOOK_BACK and _COMMENT.match(lines[at - 2]):
        at -= 1
    return at


def _chunk(path: str, lines: list[str], a: int, b: int, kind: str, names: list[str], imports_: list[dict]) -> dict:
    text = "\n".join(lines[a - 1 : b])
    used = [n for i in imports_ for n in i["names"] if re.search(rf"\b{re.escape(n)}\b", text)]
    return {"id": f"{path}:{a}-{b}", "file_path": path, "start_line": a, "end_line": b, "content": text, "type": kind, "symbols": names, "token_count": _tokens(text), "imports": used}


def line_chunks_of(path: str, content: str, lang: str | None) -> list[dict]:
    """A module chunk of the imports; a chunk for each symbol with its comments, unless it is below 50 tokens, split evenly by
    lines above 500; the runs of lines left over, as mixed chunks."""
    lines, imps = content.split("\n"), imports_of(path, content, lang)
    out, used = [], set()
    if imps:
        a, b = min(i["line"] for i in imps), max(i["line"] for i in imps)
        out.append(_chunk(path, lines, a, b, "module", [], imps))
        used |= set(range(a, b + 1))
    for s in symbols_of(path, content, lang):
        if s["line"] in used:
            continue
        a, b = leading_comments(lines, s["line"]), s["end_line"]
        size = _tokens("\n".join(lines[a - 1 : b]))
        if size < MIN_TOKENS:
            continue
        parts = -(-size // MAX_TOKENS)
        step = -(-(b - a + 1) // parts)
        for low in range(a, b + 1, step):
            out.append(_chunk(path, lines, low, min(b, low + step - 1), s["kind"], [s["name"]], imps))
        used |= set(range(a, b + 1))
    run: list[int] = []
    for i in [*range(1, len(lines) + 1), 0]:
        if i and i not in used:
            run.append(i)
            continue
        if run and "\n".join(lines[run[0] - 1 : run[-1]]).strip():
            out.append(_chunk(path, lines, run[0], run[-1], "mixed", [], imps))
        run = []
    return out


def boundaries(lines: list[str]) -> list[int]:
    """Lines (1-based) that begin something: definitions, and blank lines between lines of text."""
    return [i + 1 for i, x in enumerate(lines) if _BOUNDARY.match(x) or 0 < i < len(lines) - 1 and not x.strip() and lines[i - 1].strip() and lines[i + 1].strip()]


def cast_chunks_of(path: str, content: str, lang: str | None) -> list[dict]:
    """Syntax chunks: nodes are symbols with their comments and the text between; those above 1600 characters (white space not
    counted) are broken at boundaries, then by size; neighbours are merged up to 1200; parts of broken nodes that stay below
    160 are dropped, whole nodes never are."""
    lines, imps, syms = content.split("\n"), imports_of(path, content, lang), [s for s in symbols_of(path, content, lang) if not s["parent"]]
    spans, at = [], 1
    for s in sorted(syms, key=lambda s: s["line"]):
        a, b = max(at, leading_comments(lines, s["line"])), s["end_line"]
        if b < at:
            continue
        if a > at:
            spans.append((at, a - 1, "mixed", []))
        spans.append((a, b, s["kind"], [s["name"]]))
        at = b + 1
    if at <= len(lines):
        spans.append((at, len(lines), "mixed", []))
    upto = [0, *itertools.accumulate(map(_ink, lines))]
    ink = lambda a, b: upto[b] - upto[a - 1]
    broken = []
    for a, b, kind, names in spans:
        if ink(a, b) <= CAST_MAX:
            broken.append((a, b, kind, names, False))
            continue
        cuts = [a - 1 + c for c in boundaries(lines[a - 1 : b]) if c > 1]
        low = a
        while low <= b:
            high = low
            while high < b and ink(low, high + 1) <= CAST_MAX:
                high += 1
            inner = bisect_right(cuts, high)  # cuts are in order
            if high < b and inner and cuts[inner - 1] > low:
                high = cuts[inner - 1] - 1
            broken.append((low, high, kind, names, True))
            low = high + 1
    merged: list[tuple] = []
    for a, b, kind, names, part in broken:
        if merged and merged[-1][1] + 1 == a and ink(merged[-1][0], b) <= CAST_BEST:
            x = merged[-1]
            merged[-1] = (x[0], b, x[2] if x[2] == kind else "mixed", list(dict.fromkeys(x[3] + names)), x[4] and part)
        else:
            merged.append((a, b, kind, names, part))
    return [_chunk(path, lines, a, b, kind, names, imps) for a, b, kind, names, part in merged if ink(a, b) and (not part or ink(a, b) >= CAST_MIN)]


def line_chunks(files: DataFrame) -> DataFrame:
    return _rows(files, line_chunks_of, CHUNKS)


def cast_chunks(files: DataFrame) -> DataFrame:
    return _rows(files, cast_chunks_of, CHUNKS)


def block_type(content: Column) -> Column:
    out = None
    for name, pattern in BLOCKS:
        out = F.when(content.rlike(pattern), name) if out is None else out.when(content.rlike(pattern), name)
    return out.otherwise("code")


def orphan_runs(lines: DataFrame, used: DataFrame) -> DataFrame:
    """(file_path, start_line, end_line): runs of lines that no chunk has, by gaps and islands. lines: file_path, line."""
    free = lines.join(used.select("file_path", "line"), ["file_path", "line"], "left_anti")
    island = F.col("line") - F.row_number().over(Window.partitionBy("file_path").orderBy("line"))
    return free.withColumn("island", island).groupBy("file_path", "island").agg(F.min("line").alias("start_line"), F.max("line").alias("end_line")).drop("island")


def symbols_in_chunks(chunks: DataFrame, symbols_: DataFrame) -> DataFrame:
    """Symbols within the line range of a chunk of the same file."""
    s = symbols_.select("file_path", "name", "line")
    return chunks.select("id", "file_path", "start_line", "end_line").join(s, (chunks["file_path"] == s["file_path"]) & s["line"].between(F.col("start_line"), F.col("end_line"))).select("id", "name", "line")


def explode_lines(files: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """(key, line, text), lines from 1."""
    return files.select(key, F.posexplode(F.split(content, "\n")).alias("line", "text")).withColumn("line", F.col("line") + 1)


def function_rows(symbols_: DataFrame, files: DataFrame) -> DataFrame:
    """Functions and methods with their text, for analytics. Joined by sorting: what is made by parsing or by expressions is
    larger than the estimates that broadcasts are chosen by."""
    body = F.array_join(F.slice(F.split("content", "\n"), F.col("line"), F.greatest(F.col("end_line") - F.col("line") + 1, F.lit(1))), "\n")
    return symbols_.filter(F.col("kind").isin("function", "method")).join(files.select(F.col("path").alias("file_path"), "content").hint("merge"), "file_path").select("file_path", "name", "line", "end_line", F.size("params").alias("n_params"), body.alias("body"))


def class_rows(symbols_: DataFrame) -> DataFrame:
    """Classes with their methods nested."""
    methods = symbols_.filter("kind = 'method'").groupBy("file_path", F.col("parent").alias("name")).agg(F.sort_array(F.collect_list(F.struct("line", F.col("name").alias("method")))).alias("m"))
    return symbols_.filter("kind = 'class'").select("file_path", "name", "line", "end_line").join(methods, ["file_path", "name"], "left").select("file_path", "name", "line", "end_line", F.coalesce(F.col("m.method"), F.array().cast("array<string>")).alias("methods"))


# --- declarations of libraries ---

API = "library string, version string, name string, type string, signature string, description string, params array<struct<name:string,type:string,optional:boolean>>, returns string, deprecated boolean, since string, examples array<string>"
_DECLARED = {"interface": "NAME", "type": "NAME", "function": "NAME TYPES ARGS :RET", "class": "NAME", "const": "NAME"}
_DTS = [("constant" if k == "const" else k, re.compile(_pattern(f"^export declare? abstract? {k} {rest}") + r"[^{;\n]*", re.M)) for k, rest in _DECLARED.items()]


def doc_comment(text: str) -> dict:
    """Description and tags of a /** */ comment."""
    body = "\n".join(re.sub(r"^\s*\*\s?", "", x) for x in re.sub(r"^/\*\*|\*/$", "", text.strip()).split("\n"))
    parts = re.split(r"^\s*@", body, flags=re.M)
    tags = [p.split(None, 1) for p in parts[1:] if p.strip()]
    one = lambda t: next((x[1].strip() if len(x) > 1 else "" for x in tags if x[0] == t), None)
    return {"description": " ".join(parts[0].split()) or None, "returns": one("returns") or one("return"), "deprecated": one("deprecated") is not None, "since": one("since"), "examples": [x[1].strip() for x in tags if x[0] == "example" and len(x) > 1]}


def parameters(text: str) -> list[dict]:
    out = []
    for p in re.split(r",(?![^<({]*[>)}])", text or ""):
        m = re.match(r"\s*(?:\.\.\.)?(\w+)(\?)?\s*(?::\s*(.+))?", p, re.S)
        if m:
            out.append({"name": m[1], "type": (m[3] or "any").strip(), "optional": bool(m[2])})
    return out


def api_entries_of(library: str, version: str, text: str, most: int = 500) -> list[dict]:
    out = []
    for kind, pattern in _DTS:
        for m in pattern.finditer(text):
            if m[1].startswith("_"):
                continue
            before = re.search(r"(/\*\*(?:(?!\*/).)*\*/)\s*$", text[: m.start()], re.S)
            doc = doc_comment(before[1]) if before else doc_comment("")
            out.append({"library": library, "version": version, "name": m[1], "type": kind, "signature": " ".join(m[0].split()), "params": parameters(m["args"]) if kind == "function" else [], **doc})
    return out[:most]


def api_entries(declarations: DataFrame) -> DataFrame:
    """declarations: library, version, content. Of each file the first 500 entries, kind by kind."""
    run = _in_pieces(lambda library, version, content: api_entries_of(library, version, content or ""), 2, API)
    return declarations.select("library", "version", "content").mapInArrow(run, API)
