"""Session history: search, topics, findings, summaries, retention.

queries: id, session_id, ord, ts, question, response, files (list), symbols (list), successful.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: One topic for each concern: the first of its words that a text holds.
CONCERNS = tuple(
    x.split()
    for x in ("authentication auth login logout session", "database db query sql orm", "api endpoint route rest graphql", "test testing spec mock", "component widget view ui",
              "error exception bug fix", "performance optimization cache", "security validation sanitize", "deploy build ci cd", "refactor restructure cleanup")
)
VERBS = "get set is has can should will do".split()
DULL_PARTS = ("src", "lib", "dist", "build", "index", "node_modules")
_KEY = [
    "the (?:{}) (?:{})".format("|".join(("main", "key", "important", "critical")), "|".join(("issue", "problem", "point"))),
    "(?:{}) (?:{})".format("|".join(("should", "must", "need to")), "|".join(("be", "use", "implement"))),
    "(?:{}) (?:{})".format("|".join(("found", "discovered", "identified")), "|".join(("that", "a", "the"))),
    "(?:{}) (?:{})".format("|".join(("solution", "fix", "approach")), "|".join(("is", "was", "involves"))),
    "(?:{})".format("|".join(("because", "since", "due to"))),
]
KEY_SENTENCE = "(?i)" + "|".join(_KEY)


def topics_of(text: Column) -> Column:
    """Up to five topics of a text: a word for each concern, then up to three names in PascalCase."""
    low = F.array(*[F.lower(F.regexp_extract(text, f"(?i)({'|'.join(words)})", 1)) for words in CONCERNS])
    names = F.slice(F.regexp_extract_all(text, F.lit("(\\p{Upper}\\p{Lower}+(?:\\p{Upper}\\p{Lower}+)+)"), F.lit(1)), 1, 3)
    spaced = F.transform(names, lambda n: F.lower(F.trim(F.regexp_replace(n, "([A-Z])", " $1"))))
    return F.slice(F.array_distinct(F.concat(F.filter(low, lambda x: x != ""), F.filter(spaced, lambda x: F.length(x) > 3))), 1, 5)


def topic_of_path(path: Column) -> Column:
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & ~p.isin(*DULL_PARTS))
    at = F.greatest(F.size(parts) - 1, F.lit(1))
    return F.regexp_replace(F.try_element_at(parts, at), "\\.(?:ts|js|tsx|jsx|py|go|rs)$", "")


def normal_symbol(symbol: Column) -> Column:
    bare = F.regexp_replace(symbol, f"^(?:{'|'.join(VERBS)})", "")
    return F.trim(F.lower(F.regexp_replace(bare, "(?:Handler|Manager|Service|Controller|Component|Provider)$", "")))


def key_sentences(text: Column, most: int = 3) -> Column:
    parts = F.transform(F.split(text, "[.!?]+"), lambda s: F.regexp_replace(s, "^\\s+|\\s+$", ""))
    return F.slice(F.filter(parts, lambda s: (F.length(s) > 20) & (F.length(s) < 200) & s.rlike(KEY_SENTENCE)), 1, most)


def topic_scores(queries: DataFrame, by: list[str]) -> DataFrame:
    """(by, topic, score, first): 2 for a question's topic, 1 for a file's or a symbol's."""
    rows = None
    for values, w in ((topics_of(F.col("question")), 2), (F.transform("files", topic_of_path), 1), (F.transform("symbols", normal_symbol), 1)):
        one = queries.select(*by, "ord", F.explode(values).alias("topic"), F.lit(w).alias("w")).filter("topic is not null")
        rows = one if rows is None else rows.unionByName(one)
    return rows.groupBy(*by, "topic").agg(F.sum("w").alias("score"), F.min("ord").alias("first"))


def top_topics(queries: DataFrame, by: list[str], k: int = 10) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.desc("score"), "first", "topic")
    return topic_scores(queries, by).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).drop("first")


def summarize(queries: DataFrame, by: str = "session_id") -> DataFrame:
    """One row for each session: topics, key findings, files, symbols, compression ratio, number of queries."""
    topics = top_topics(queries, [by]).groupBy(by).agg(F.sort_array(F.collect_list(F.struct("rank", "topic"))).alias("t")).select(by, F.col("t.topic").alias("topics"))
    wide = F.when(F.size("files") >= 5, F.array(F.format_string("Cross-file investigation involving %d files", F.size("files")))).otherwise(F.array().cast("array<string>"))
    said = F.when(F.col("successful"), key_sentences(F.col("response"))).otherwise(F.array().cast("array<string>"))
    ordered = F.sort_array(F.collect_list(F.struct("ord", F.concat(said, wide).alias("s"), "files", "symbols")))
    flat = lambda n: F.array_distinct(F.flatten(F.col(f"q.{n}")))
    grouped = queries.groupBy(by).agg(ordered.alias("q"), F.sum(F.length("question") + F.length("response")).alias("original"), F.count("*").alias("query_count"))
    rows = grouped.select(by, F.slice(flat("s"), 1, 8).alias("key_findings"), flat("files").alias("files_mentioned"), flat("symbols").alias("symbols_mentioned"), "original", "query_count")
    rows = rows.join(topics, by, "left").withColumn("topics", F.coalesce("topics", F.array().cast("array<string>")))
    return rows.withColumn("compression_ratio", F.try_divide(_summary_size(), F.col("original"))).drop("original")


def _summary_size() -> Column:
    return F.length(F.array_join("topics", " ")) + F.length(F.array_join("key_findings", " ")) + F.length(F.array_join("files_mentioned", " "))


def merge_summaries(old: DataFrame, new: DataFrame, original: DataFrame, by: str = "session_id") -> DataFrame:
    """Ordered unions of lists (topics and findings up to 10); the ratio is over the new text plus 1000. original: by, original."""
    both = lambda c, most=None: F.array_distinct(F.concat(F.col(f"o.{c}"), F.col(f"n.{c}"))) if most is None else F.slice(F.array_distinct(F.concat(F.col(f"o.{c}"), F.col(f"n.{c}"))), 1, most)
    rows = old.alias("o").join(new.alias("n"), by).join(original, by)
    rows = rows.select(by, both("topics", 10).alias("topics"), both("key_findings", 10).alias("key_findings"), both("files_mentioned").alias("files_mentioned"), both("symbols_mentioned").alias("symbols_mentioned"), (F.col("o.query_count") + F.col("n.query_count")).alias("query_count"), "original")
    return rows.withColumn("compression_ratio", _summary_size() / (F.col("original") + 1000)).drop("original")


def summaries_between(summaries: DataFrame, start, end) -> DataFrame:
    """Summaries generated from start to end, both within, newest first."""
    return summaries.filter(F.col("generated_at").between(F.lit(start), F.lit(end))).orderBy(F.desc("generated_at"), "session_id")


class Sessions:
    """Sessions (session_id, started_at, ended_at) and their queries as tables; what changes gives new tables."""

    def __init__(self, sessions: DataFrame, queries: DataFrame):
        self.sessions, self.queries = sessions, queries

    def create(self, session: str, now: Column) -> Sessions:
        """A new session; those that are open end."""
        new = self.sessions.sparkSession.range(1).select(F.lit(session).alias("session_id"), now.alias("started_at"), F.lit(None).cast("timestamp").alias("ended_at"))
        return Sessions(self.end(now).sessions.unionByName(new), self.queries)

    def current(self) -> DataFrame:
        return self.sessions.filter("ended_at is null").orderBy(F.desc("started_at"), "session_id").limit(1)

    def end(self, now: Column) -> Sessions:
        return Sessions(self.sessions.withColumn("ended_at", F.coalesce("ended_at", now)), self.queries)

    def append(self, rows: DataFrame) -> Sessions:
        """Queries of known sessions, which replace those of their id; others are left out."""
        mine = rows.join(self.sessions.select("session_id"), "session_id", "left_semi")
        return Sessions(self.sessions, self.queries.join(mine.select("id"), "id", "left_anti").unionByName(mine, allowMissingColumns=True))

    def save(self, path: str) -> None:
        for name in ("sessions", "queries"):
            getattr(self, name).write.mode("overwrite").option("compression", "gzip").json(f"{path}/{name}")

    @classmethod
    def load(cls, spark: SparkSession, path: str, queries: str) -> Sessions:
        """queries: the schema of the queries' table."""
        return cls(spark.read.schema("session_id string, started_at timestamp, ended_at timestamp").json(f"{path}/sessions"), spark.read.schema(queries).json(f"{path}/queries"))


def search(queries: DataFrame, text: str, limit: int = 50, start=None, end=None, files: list[str] | None = None, symbols: list[str] | None = None, in_questions: bool = True, in_responses: bool = True) -> DataFrame:
    """Rows with `score`: 2 for the question, 1 for the response, 1 for a symbol (a predicate where the text is empty). The
    first `limit` matches in session order are taken, then sorted by score."""
    rows, low = queries, text.lower()
    if start is not None:
        rows = rows.filter(F.col("ts").between(F.lit(start), F.lit(end)))
    if files:
        rows = rows.filter(F.arrays_overlap("files", F.array(*[F.lit(f) for f in files])))
    hit = F.exists("symbols", lambda s: F.greatest(*[s.contains(x) for x in symbols], F.lit(False))) if symbols else F.lit(False)
    score = F.lit(0)
    if low and in_questions:
        score = score + F.when(F.lower("question").contains(low), 2).otherwise(0)
    if low and in_responses:
        score = score + F.when(F.lower("response").contains(low), 1).otherwise(0)
    score = score + F.when(hit, 1).otherwise(0)
    taken = rows.withColumn("score", score).filter("score > 0").orderBy("session_id", "ord").limit(limit)
    return taken.orderBy(F.desc("score"), "session_id", "ord")


def file_history(queries: DataFrame, path: str) -> DataFrame:
    return queries.filter(F.array_contains("files", path)).orderBy(F.desc("ts"), "id")


def recent(rows: DataFrame, k: int = 10, by: str = "ts", tie: str = "id") -> DataFrame:
    return rows.orderBy(F.desc(by), tie).limit(k)


def since_last_summary(queries: DataFrame, summaries: DataFrame) -> DataFrame:
    last = summaries.groupBy("session_id").agg(F.max("generated_at").alias("last"))
    return queries.join(last, "session_id", "left").filter(F.col("last").isNull() | (F.col("ts") > F.col("last"))).drop("last")


def due_summaries(queries: DataFrame, every: int = 10) -> DataFrame:
    """(session_id, ord): where a session's number of queries reaches a multiple of `every`."""
    n = F.row_number().over(Window.partitionBy("session_id").orderBy("ord"))
    return queries.withColumn("n", n).filter(F.col("n") % every == 0).select("session_id", "ord", "n")


def stats(sessions: DataFrame, queries: DataFrame) -> DataFrame:
    q = queries.agg(F.count("*").alias("queries"), F.count_if(F.col("successful")).alias("successful"))
    names = [queries.select(F.explode(c).alias("x")).agg(F.countDistinct("x").alias(c)) for c in ("files", "symbols")]
    s = sessions.agg(F.count("*").alias("sessions"), F.count_if(F.col("ended_at").isNull()).alias("active"))
    return s.crossJoin(q).crossJoin(names[0]).crossJoin(names[1])


def retained(sessions: DataFrame, now: Column, days: int = 30, most: int = 100, by: list[str] | None = None) -> DataFrame:
    """Sessions that are young enough, and of those the newest `most` (of each user with by)."""
    young = sessions.filter(F.col("started_at") >= now - F.expr(f"interval {days} days"))
    if not by:
        return young.orderBy(F.desc("started_at"), "session_id").limit(most)
    w = Window.partitionBy(*by).orderBy(F.desc("started_at"), "session_id")
    return young.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= most).drop("__n")


def pair_turns(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(session_id, ord, question, response): a user's turn and the assistant's next."""
    w = Window.partitionBy(conversation).orderBy(turn)
    rows = turns.select(F.col(conversation).alias("session_id"), F.col(turn).alias("ord"), role, F.col(text).alias("question"), F.lead(text).over(w).alias("response"), F.lead(role).over(w).alias("next"))
    return rows.filter((F.col(role) == "user") & (F.col("next") == "assistant")).select("session_id", "ord", "question", "response")
