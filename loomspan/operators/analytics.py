"""Complexity, smells and patterns of code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring
from ..functions.text import js_trim

SMELLS = tuple(scoring.SEVERITY_LIMITS)
DUPLICATE_LINES, DUPLICATE_CHARS = 6, 50


def brace_depth(lines: DataFrame, key: list[str], line: str = "line", text: str = "text", opens: str = "{", closes: str = "}") -> DataFrame:
    """Adds `before` and `after`: depth of nesting around each line, never below 0.

    A running sum S that is set back to 0 whenever it falls below is S - min(0, least S so far).
    """
    change = F.regexp_count(text, F.lit(f"\\{opens}")) - F.regexp_count(text, F.lit(f"\\{closes}"))
    w = Window.partitionBy(*key).orderBy(line).rowsBetween(Window.unboundedPreceding, 0)
    prior = Window.partitionBy(*key).orderBy(line)
    rows = lines.withColumn("change", change).withColumn("s", F.sum("change").over(w))
    rows = rows.withColumn("after", F.col("s") - F.least(F.lit(0), F.min("s").over(w)))
    return rows.withColumn("before", F.coalesce(F.lag("after").over(prior), F.lit(0))).drop("s")


def max_nesting(lines: DataFrame, key: list[str], **how) -> DataFrame:
    """(key, nesting): the deepest nesting; measured before the set-back to 0, and 0 at least."""
    return brace_depth(lines, key, **how).groupBy(*key).agg(F.greatest(F.max(F.col("before") + F.col("change")), F.lit(0)).cast("int").alias("nesting"))


_JUMPS = r"\b(?:break|continue|return)\b"
_BRANCH = r"\b(?:if|while|for|switch|catch)\s*\("


def cognitive(lines: DataFrame, key: list[str]) -> DataFrame:
    """(key, cognitive): 1 + nesting for a line that branches, 1 for each && and ||, 1 for a line that jumps."""
    cost = F.when(F.col("text").rlike(_BRANCH), 1 + F.col("before")).otherwise(0) + F.regexp_count("text", F.lit("&&|\\|\\|")) + F.when(F.col("text").rlike(_JUMPS), 1).otherwise(0)
    return brace_depth(lines, key).groupBy(*key).agg(F.sum(cost).cast("int").alias("cognitive"))


KEY = ["file_path", "name", "line"]


def _lines(functions: DataFrame) -> DataFrame:
    return functions.select(*KEY, F.posexplode(F.split("body", "\n")).alias("n", "text"))


def function_complexity(functions: DataFrame) -> DataFrame:
    """functions: file_path, name, line, end_line, body -> cyclomatic, cognitive, loc, rating."""
    lines = _lines(functions).withColumnsRenamed({"line": "first", "n": "line"})
    cog = cognitive(lines, ["file_path", "name", "first"]).withColumnRenamed("first", "line")
    c = functions.select(*KEY, scoring.cyclomatic(F.col("body")).alias("cyclomatic"), (F.col("end_line") - F.col("line") + 1).alias("loc"))
    return c.join(cog, KEY).withColumn("rating", scoring.complexity_rating(F.greatest("cyclomatic", "cognitive")))


def file_complexity(functions: DataFrame) -> DataFrame:
    return functions.groupBy("file_path").agg(F.count("*").alias("functions"), F.avg("cyclomatic").alias("avg_cyclomatic"), F.avg("cognitive").alias("avg_cognitive"), F.max(F.greatest("cyclomatic", "cognitive")).alias("max_complexity"))


def project_complexity(functions: DataFrame) -> DataFrame:
    """Averages weighted by functions, high files, critical functions."""
    files = file_complexity(functions).withColumn("rating", scoring.complexity_rating(F.greatest("avg_cyclomatic", "avg_cognitive")))
    f = files.agg(F.count("*").alias("files"), F.sum("functions").alias("functions"), F.try_divide(F.sum(F.col("avg_cyclomatic") * F.col("functions")), F.sum("functions")).alias("avg_cyclomatic"), F.try_divide(F.sum(F.col("avg_cognitive") * F.col("functions")), F.sum("functions")).alias("avg_cognitive"), F.count_if(F.col("rating").isin("high", "very-high")).alias("high_files"))
    return f.crossJoin(functions.agg(F.count_if(F.col("rating") == "very-high").alias("critical_functions")))


def smells(functions: DataFrame, classes: DataFrame, files: DataFrame, thresholds: dict[str, int] | None = None) -> DataFrame:
    """(type, severity, file_path, start_line, end_line, name, value); functions have n_params, classes a list of methods."""
    t = {"long-method": 50, "long-parameter-list": 5, "deep-nesting": 4, "god-class": 20} | (thresholds or {})

    def rows(df: DataFrame, kind: str, value: Column, keep: Column, fixed: str | None = None) -> DataFrame:
        s = F.lit(fixed) if fixed else scoring.severity(kind, value)
        return df.filter(keep).select(F.lit(kind).alias("type"), s.alias("severity"), "file_path", F.col("line").alias("start_line"), "end_line", "name", value.cast("int").alias("value"))

    n = F.col("end_line") - F.col("line") + 1
    deep = max_nesting(_lines(functions).withColumnsRenamed({"line": "first", "n": "line"}), ["file_path", "name", "first"]).withColumnRenamed("first", "line")
    numbers = F.size(scoring.magic_numbers(F.col("body")))
    out = rows(functions, "long-method", n, n > t["long-method"])
    out = out.unionByName(rows(functions, "long-parameter-list", F.col("n_params"), F.col("n_params") > t["long-parameter-list"]))
    out = out.unionByName(rows(functions.join(deep, KEY), "deep-nesting", F.col("nesting"), F.col("nesting") > t["deep-nesting"]))
    out = out.unionByName(rows(functions, "magic-number", numbers, numbers > 0, "low"))
    methods = F.size("methods")
    out = out.unionByName(rows(classes, "god-class", methods, methods > t["god-class"]))
    same = duplicate_blocks(files).select("file_path", F.col("line"), (F.col("line") + DUPLICATE_LINES - 1).alias("end_line"), F.lit(None).cast("string").alias("name"))
    return out.unionByName(rows(same, "duplicate-code", F.lit(DUPLICATE_LINES), F.lit(True), "medium"))


def duplicate_blocks(files: DataFrame, key: str = "path", content: str = "content", size: int = DUPLICATE_LINES) -> DataFrame:
    """(file_path, line): blocks of 6 lines, 50 characters at least once trimmed, that stand again further down in the file.

    Blocks are grouped by their text's hash in one shuffle: a block is reported if the last place of that text is `size`
    lines or more below it. The last block of a file is never one of the two.
    """
    lines = files.select(F.col(key).alias("file_path"), F.split(content, "\n").alias("l"))
    blocks = F.transform(F.sequence(F.lit(0), F.size("l") - size - 1), lambda i: F.struct((i + 1).alias("line"), js_trim(F.array_join(F.slice("l", i + 1, size), "\n")).alias("text")))
    rows = lines.filter(F.size("l") > size).select("file_path", F.explode(blocks).alias("b")).filter(F.length("b.text") >= DUPLICATE_CHARS)
    rows = rows.select("file_path", F.col("b.line").alias("line"), F.sha2("b.text", 256).alias("h"))
    last = F.max("line").over(Window.partitionBy("file_path", "h"))
    return rows.withColumn("last", last).filter(F.col("last") >= F.col("line") + size).select("file_path", "line")


def smell_report(found: DataFrame) -> DataFrame:
    """(kind, name, n): counts by type and by severity, with zeros."""
    spark = found.sparkSession
    domain = spark.createDataFrame([("type", s) for s in SMELLS] + [("severity", s) for s in scoring.SEVERITIES], "kind string, name string")
    counts = found.select(F.explode(F.array(F.struct(F.lit("type").alias("kind"), F.col("type").alias("name")), F.struct(F.lit("severity").alias("kind"), F.col("severity").alias("name")))).alias("x")).groupBy("x.kind", "x.name").agg(F.count("*").alias("n"))
    return domain.join(counts, ["kind", "name"], "left").fillna(0, ["n"])


def at_least(found: DataFrame, level: str) -> DataFrame:
    return found.filter(scoring.severity_rank(F.col("severity")) >= scoring.SEVERITIES.index(level))


#: Pattern -> category, files for full confidence, words in the text.
CONTENT_PATTERNS = {
    "Observer": ("design", 10, "addeventlistener subscribe observer notify"),
    "REST API": ("api", 5, "express app.get app.post router. @get @post"),
    "GraphQL": ("api", 5, "graphql resolver query mutation"),
    "WebSocket": ("api", 3, "websocket socket.io ws://"),
    "Authentication": ("security", 3, "authenticate jwt passport bcrypt login"),
    "Encryption": ("security", 3, "encrypt crypto cipher"),
    "Caching": ("performance", 3, "cache memoize redis"),
    "Lazy loading": ("performance", 3, "lazy import( loadable"),
}


def patterns(files: DataFrame, symbols: DataFrame | None = None, categories: list[str] | None = None) -> DataFrame:
    """(name, category, confidence, files): files that show a pattern, over the number that makes it sure. files: path, content."""
    low = F.lower("content")
    any_of = lambda words: F.greatest(*[low.contains(w) for w in words.split()], F.lit(False))
    hits = F.array(*[F.when(any_of(words), F.struct(F.lit(n).alias("name"), F.lit(c).alias("category"), F.lit(k).alias("k"))) for n, (c, k, words) in CONTENT_PATTERNS.items()])
    rows = files.select("path", F.explode(F.filter(hits, lambda x: x.isNotNull())).alias("p")).select("path", "p.name", "p.category", "p.k")
    if symbols is not None:
        s = symbols.select(F.col("file_path").alias("path"), "name", F.lower("name").alias("low"), "kind", "parent")
        row = lambda df, n, k: df.select("path", F.lit(n).alias("name"), F.lit("design").alias("category"), F.lit(k).alias("k")).distinct()
        private = files.filter(F.col("content").rlike("private\\s+constructor")).select("path")
        rows = rows.unionByName(row(s.filter("kind = 'method' and name = 'getInstance'").select("path").unionByName(private), "Singleton", 5))
        rows = rows.unionByName(row(s.filter("low like '%factory%' or (kind in ('function', 'method') and name like 'create%')"), "Factory", 10))
        chained = files.filter(F.col("content").rlike("return\\s+this")).select("path")
        rows = rows.unionByName(row(s.filter("kind = 'method' and name = 'build'").join(chained, "path", "left_semi"), "Builder", 5))
        strategy = s.filter("kind = 'class' and low like '%strategy%'").select("path").unionByName(files.filter(F.lower("path").contains("strategy")).select("path"))
        rows = rows.unionByName(row(strategy, "Strategy", 5))
    found = rows.groupBy("name", "category").agg(F.least(F.count("*") / F.max("k"), F.lit(1.0)).alias("confidence"), F.sort_array(F.collect_list("path")).alias("files"))
    return found if categories is None else found.filter(F.col("category").isin(*categories))


def architecture(files: DataFrame, path: str = "path") -> DataFrame:
    """(architecture): the style that most paths hint at, if enough of them do, else monolith; null without a hint."""
    p = F.lower(path)
    has = lambda words: F.greatest(*[p.contains(w) for w in words.split()], F.lit(False))
    n = F.count("*").alias("n")
    c = files.agg(n, F.count_if(has("controller view model")).alias("mvc"), F.count_if(p.contains("service") & has("api endpoint")).alias("micro"), F.count_if(has("repository domain infrastructure")).alias("layered"), F.count_if(has("event message queue")).alias("event"))
    top = F.greatest("mvc", "micro", "layered", "event")
    chosen = F.when(top == 0, None)
    for name, column, enough in (("mvc", "mvc", F.col("n") * 0.15), ("microservices", "micro", F.lit(5)), ("layered", "layered", F.col("n") * 0.15), ("event-driven", "event", F.lit(5))):
        chosen = chosen.when((F.col(column) == top) & (F.col(column) > enough), name)
    return c.select(chosen.otherwise("monolith").alias("architecture"))


# --- validation ---


def validate(files: DataFrame, parsed: str | None = None, symbols: str | None = None) -> DataFrame:
    """(path, valid, parse_ok, symbols_ok, confidence, action) of files (path, content).

    A file is valid if it can be read, and neither its extension nor a NUL in its first 8 KB says that it is binary. parsed: a
    boolean column that says whether it was parsed; symbols: a column with the number of symbols found. Without them these
    checks pass. All checks passed: high, index; invalid: low, skip; else medium, and partial if it wasn't parsed.
    """
    from ..sources.ignore import binary_extension

    valid = F.col("content").isNotNull() & ~binary_extension("path") & (F.locate("\x00", F.substring("content", 1, 8192)) == 0)
    ok = F.coalesce(F.col(parsed), F.lit(False)) if parsed else F.lit(True)
    some = F.coalesce(F.col(symbols) > 0, F.lit(False)) if symbols else F.lit(True)
    rows = files.select("path", F.coalesce(valid, F.lit(False)).alias("valid"), ok.alias("parse_ok"), some.alias("symbols_ok"))
    level = F.when(~F.col("valid"), "low").when(F.col("parse_ok") & F.col("symbols_ok"), "high").otherwise("medium")
    action = F.when(~F.col("valid"), "skip").when(~F.col("parse_ok"), "partial").otherwise("index")
    return rows.withColumns({"confidence": level, "action": action})


def confidence_health(rows: DataFrame, confidence: str = "confidence") -> DataFrame:
    """(total, high, medium, low, health): unhealthy if nothing is there or over half is low, degraded if under 70 % is high."""
    c = rows.agg(F.count("*").alias("total"), *[F.count_if(F.col(confidence) == x).alias(x) for x in ("high", "medium", "low")])
    share = lambda x: F.try_divide(F.col(x), F.col("total"))
    return c.withColumn("health", F.when((F.col("total") == 0) | (share("low") > 0.5), "unhealthy").when(share("high") < 0.7, "degraded").otherwise("healthy"))
