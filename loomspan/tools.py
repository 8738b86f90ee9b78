"""The engine's tools by name, and their JSON-RPC form."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import functions as F

from . import report
from .engine import Engine
from .operators import analytics, graph, library, memory, sharing, thinking

TOOLS: dict[str, Callable] = {}


def tool(f: Callable) -> Callable:
    TOOLS[f.__name__] = f
    return f


class Server:
    """Answers tools over an engine; sessions, thoughts, library docs and watching are tables or objects that the host gives."""

    def __init__(self, engine: Engine, queries=None, sessions=None, thoughts=None, api=None, watch: Callable | None = None, llm: Callable[[str], str] | None = None):
        self.engine, self.queries, self.sessions, self.thoughts, self.api, self.watch, self.llm = engine, queries, sessions, thoughts, api, watch, llm
        self.stream = None

    def rows(self, df, most: int = 1000) -> list[dict]:
        return self.engine.as_json(df, most)

    def call(self, name: str, arguments: dict):
        if name not in TOOLS:
            raise KeyError(name)
        return TOOLS[name](self, **arguments)

    def handle(self, request: dict | str) -> dict:
        """One JSON-RPC request: initialize, tools/list, tools/call, resources/list, resources/read."""
        try:
            r = json.loads(request) if isinstance(request, str) else request
        except ValueError:
            return _error(None, -32700, "parse error")
        at, params = r.get("method"), r.get("params") or {}
        try:
            if at == "initialize":
                result = {"serverInfo": {"name": "loomspan"}, "capabilities": {"tools": {}, "resources": {}}}
            elif at == "tools/list":
                result = {"tools": [{"name": n, "description": f.__doc__} for n, f in TOOLS.items()]}
            elif at == "tools/call":
                result = {"content": [{"type": "text", "text": json.dumps(self.call(params["name"], params.get("arguments") or {}), default=str)}]}
            elif at == "resources/list":
                result = {"resources": [{"uri": f"loomspan://{n}"} for n in ("index", "stats")]}
            elif at == "resources/read":
                result = {"contents": self.rows(self.engine.files.drop("content") if params["uri"].endswith("index") else self.engine.stats())}
            else:
                return _error(r.get("id"), -32601, f"no method {at}")
        except KeyError as e:
            return _error(r.get("id"), -32601, f"no {e}")
        except Exception as e:  # noqa: BLE001 - the protocol's answer to any failure
            return _error(r.get("id"), -32603, str(e)[:500])
        return {"jsonrpc": "2.0", "id": r.get("id"), "result": result}


def _error(i, code: int, message: str) -> dict:
    return {"jsonrpc": "2.0", "id": i, "error": {"code": code, "message": message}}


@tool
def search(s, query, limit=20, kinds=None):
    """Symbols by part of their name."""
    return s.rows(s.engine.search_symbols(query, kinds, limit))


@tool
def get_context(s, query, max_tokens=8000, files=None):
    """Text for a question under a token budget."""
    return s.engine.context(query, max_tokens=max_tokens, files=files)


@tool
def find_usages(s, symbol, file=None):
    """Calls of a symbol."""
    return s.rows(s.engine.usages(symbol, file))


@tool
def get_dependencies(s, file, direction="both"):
    """Imports and importers of a file."""
    return s.rows(s.engine.dependencies(file, direction))


@tool
def get_file_symbols(s, file, include_private=False):
    """Symbols of a file."""
    rows = s.engine.symbols.filter(F.col("file_path") == file)
    return s.rows(rows if include_private else rows.filter("exported"))


@tool
def get_project_structure(s):
    """Entry points, important files, languages."""
    return s.engine.structure()


@tool
def refresh_index(s):
    """Index again; what changed."""
    return s.rows(s.engine.refresh().filter("status <> 'cached'"))


@tool
def find_related(s, symbol, max_depth=2, direction="both", relations=None):
    """Nodes near a symbol."""
    return s.rows(s.engine.related(symbol, max_depth, direction, relations))


@tool
def get_callers(s, symbol):
    """Who calls it."""
    return s.rows(s.engine.callers(symbol))


@tool
def get_inheritance(s, symbol, direction="up"):
    """What it extends, or what extends it."""
    return s.rows(s.engine.inheritance(symbol, direction))


@tool
def hybrid_search(s, query, limit=10, files=None):
    """Chunks by BM25: twice the limit is taken, then files are filtered."""
    top = s.engine.inverted.search(query, 2 * limit).join(s.engine.chunks.drop("content"), "id")
    if files:
        top = top.filter(F.greatest(*[F.col("file_path").contains(f) for f in files], F.lit(False)))
    return s.rows(top.orderBy(F.desc("score"), "id").limit(limit))


@tool
def watch_start(s):
    """Start watching."""
    if s.watch is None:
        raise ValueError("no watch is set up")
    s.stream = s.stream or s.watch()
    return watch_status(s)


@tool
def watch_stop(s):
    """Stop watching."""
    if s.stream is not None:
        s.stream.stop()
    return watch_status(s)


@tool
def watch_status(s):
    """Whether it watches, and how much it has seen."""
    from .streaming.streams import status

    return status(s.stream) if s.stream is not None else {"active": False}


@tool
def export_graph(s, format="json"):  # noqa: A002
    """The graph as json, dot or mermaid."""
    g = s.engine.graph
    return {"json": g.to_json, "dot": g.to_dot, "mermaid": g.to_mermaid}[format]().head()[0]


@tool
def graph_stats(s):
    """Counts by type, and the most connected nodes."""
    g = s.engine.graph
    return {"counts": s.rows(g.stats()), "connected": s.rows(g.degrees().orderBy(F.desc("degree"), "id").limit(10))}


@tool
def health(s):
    """State of the index."""
    return {"status": s.engine.health(), **s.engine.size()}


@tool
def ask(s, question):
    """Answer from the project, by the language model that the host gave."""
    if s.llm is None:
        raise ValueError("no language model is set up")
    return s.engine.ask(question, s.llm)


@tool
def analyze_complexity(s):
    """Complexity of functions and of the project."""
    f = s.engine.complexity()
    return {"project": s.rows(analytics.project_complexity(f)), "functions": s.rows(f.orderBy(F.desc("cyclomatic")), 100)}


@tool
def detect_smells(s, min_severity="low"):
    """Smells; counts are of all, the list of those that are severe enough."""
    found = s.engine.smells()
    return {"counts": s.rows(analytics.smell_report(found)), "smells": s.rows(analytics.at_least(found, min_severity))}


@tool
def detect_patterns(s, categories=None):
    """Patterns and the architecture."""
    return {"patterns": s.rows(s.engine.patterns(categories)), "architecture": analytics.architecture(s.engine.files).head()[0]}


def _api(s, wanted):
    if s.api is None:
        raise ValueError("no library docs are set up")
    return s.api.filter(wanted)


@tool
def get_library_docs(s, library, version=None):  # noqa: A002
    """API entries of a library."""
    return s.rows(_api(s, (F.col("library") == library) & (F.lit(version is None) | (F.col("version") == version))))


@tool
def list_library_docs(s):
    """Libraries that have docs."""
    return s.rows(library.extract_summary(_api(s, F.lit(True))))


@tool
def search_library_api(s, query, types=None, limit=20):
    """API entries by text."""
    return s.rows(library.search_api(_api(s, F.lit(True)), query, types, limit))


def _thoughts(s, session):
    if s.thoughts is None:
        raise ValueError("no thoughts are set up")
    return s.thoughts.filter(F.col("session_id") == session)


@tool
def sequential_think(s, session):
    """What to do next in a session of thoughts."""
    return s.rows(thinking.next_steps(_thoughts(s, session)))


@tool
def add_thought(s, session, content, type="analysis", confidence=0.5, branch="main"):  # noqa: A002
    """Append a thought; a new branch only below the cap."""
    mine = _thoughts(s, session)
    known = {r.branch for r in mine.select("branch").distinct().collect()}
    if branch not in known and len(known) >= thinking.MAX_BRANCHES:
        raise ValueError("no more branches are allowed")
    number = (mine.agg(F.max("number")).head()[0] or 0) + 1
    new = s.engine.spark.createDataFrame([(f"t{number}", session, branch, number, type, content, confidence)], "id string, session_id string, branch string, number long, type string, content string, confidence double")
    s.thoughts = graph.cut(s.thoughts.unionByName(new, allowMissingColumns=True))
    return {"id": f"t{number}"}


@tool
def finalize_thinking(s, session):
    """The conclusion of a session of thoughts."""
    return s.rows(thinking.finalize(_thoughts(s, session)))


def _history(s):
    if s.queries is None:
        raise ValueError("no history is set up")
    return s.queries


@tool
def search_history(s, query, limit=50):
    """Earlier questions and answers."""
    return s.rows(memory.search(_history(s), query, limit))


@tool
def get_file_discussion(s, file):
    """Where a file was discussed."""
    return s.rows(memory.file_history(_history(s), file))


@tool
def get_session_summary(s, session):
    """Topics and findings of a session."""
    return s.rows(memory.summarize(_history(s).filter(F.col("session_id") == session)))


@tool
def memory_stats(s):
    """Counts of the history."""
    return s.rows(memory.stats(s.sessions, _history(s)))


def _tables(s):
    return {"files": s.engine.files, "nodes": s.engine.graph.nodes, "edges": s.engine.graph.edges}


@tool
def export_context(s, path, include=None, exclude=None, anonymize=False):
    """Write a bundle."""
    chosen = sharing.prepared(_tables(s), sharing.components(include, exclude), anonymous=anonymize)
    return s.rows(sharing.export(s.engine.spark, path, chosen))


@tool
def import_context(s, path, merge=False, overwrite=False, dry_run=False):
    """Read a bundle into the engine's tables."""
    theirs, mine = sharing.load(s.engine.spark, path), _tables(s)
    found = {n: sharing.conflicts(mine[n], df, sharing.KEYS[n], merge, overwrite).count() for n, df in theirs.items() if n in mine}
    if not dry_run:
        now = sharing.import_bundle(mine, theirs, merge, overwrite)
        s.engine.files, s.engine.graph = graph.cut(now["files"]), graph.Graph(graph.cut(now["nodes"]), graph.cut(now["edges"]))
    return {"conflicts": found, "applied": not dry_run}


@tool
def bundle_info(s, path):
    """What a bundle holds."""
    return s.rows(sharing.info(sharing.load(s.engine.spark, path)))


@tool
def project_report(s, name="project"):
    """The Markdown report."""
    return report.markdown(s.engine, name)
