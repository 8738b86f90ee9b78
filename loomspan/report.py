"""A Markdown report of a project."""

from __future__ import annotations

from pyspark.sql import functions as F

from .engine import Engine
from .functions.text import dirname


def tree(paths: list[str]) -> str:
    """Folders first, then files, each by name."""
    root: dict = {}
    for p in paths:
        at = root
        for part in p.split("/"):
            at = at.setdefault(part, {})

    def show(node: dict, depth: int) -> list[str]:
        out = []
        for name, inside in sorted(node.items(), key=lambda x: (not x[1], x[0])):
            out.append("  " * depth + name + ("/" if inside else ""))
            out += show(inside, depth + 1)
        return out

    return "\n".join(show(root, 0))


def markdown(engine: Engine, name: str = "project", most: int = 50) -> str:
    files = engine.files.select("path").orderBy("path").limit(1000).collect()
    out = [f"# {name}", "", "## Structure", "```", tree([r.path for r in files]), "```", "", "## Languages", "| language | files | symbols |", "|-|-|-|"]
    out += [f"| {r.language} | {r['files']} | {r['symbols']} |" for r in engine.stats().orderBy("language").collect()]
    out += ["", "## Folders"] + [f"- {r.folder or '.'}: {r.n}" for r in engine.files.groupBy(dirname("path").alias("folder")).agg(F.count("*").alias("n")).orderBy("folder").collect()]
    for title, kinds in (("Classes", ["class", "interface"]), ("Functions", ["function", "method"])):
        rows = engine.symbols.filter(F.col("kind").isin(kinds)).orderBy("file_path", "line").limit(20).collect()
        out += ["", f"## {title}"] + [f"- `{r.name}` ({r.file_path}:{r.line})" for r in rows]
    public = engine.symbols.filter("exported").orderBy("file_path", "line").limit(20).collect()
    out += ["", "## Public API"] + [f"- `{r.name}` {r.kind}" for r in public]
    deps = engine.edges.groupBy("from").agg(F.sort_array(F.collect_list("to")).alias("to")).orderBy("from").limit(most).collect()
    out += ["", "## Dependencies"] + [f"- {r['from']} -> {', '.join(r['to'])}" for r in deps]
    return "\n".join(out) + "\n"
