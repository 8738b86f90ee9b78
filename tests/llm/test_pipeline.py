"""The pipeline's stages against brute force, each on its own input."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipe
from loomspan.llm import langid, mixing, queries
from loomspan.llm.common import TokenEncoder, table
from tests.llm.test_operators import DOC, HARD, brute_groups, brute_pack

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def staged(spark):
    """The input and the result of each stage."""
    docs, out = table(spark, SF, "documents"), []
    for _, f in pipe.STAGES:
        got = f(spark, docs, SF)
        got = spark.createDataFrame(got.collect(), got.schema).cache()
        out.append((docs, got))
        docs = got
    return out


def test_stages():
    assert [n for n, _ in pipe.STAGES] == ["language_id", "near_dedup", "mix", "pack"] and pipe.ORACLE_SQL is None


def test_language_stage(staged):
    before, after = staged[0]
    made = langid.train_dictionaries(before, seed=queries.SEED)
    compressors = {n: langid._compressor(d, 5) for n, d in made.items()}
    want = {}
    for r in before.collect():
        data = r.text.lower().encode()
        sizes = sorted((sum(len(c.compress(data[i : i + 4096])) for i in range(0, len(data), 4096)), n) for n, c in compressors.items())
        if data and (sizes[1][0] - sizes[0][0]) / sizes[1][0] >= queries.MARGIN:
            want[r.doc_id] = sizes[0][1]
    assert {r.doc_id: r.lang for r in after.collect()} == want and after.columns == before.columns and len(want) > 0.97 * before.count()


def test_dedup_stage(staged):
    before, after = staged[1]
    groups = brute_groups([tuple(r) for r in before.select("doc_id", "text").collect()])
    assert sorted(r.doc_id for r in after.collect()) == sorted(groups) and after.columns == before.columns


def test_mix_stage(staged):
    before, after = staged[2]
    sizes = {r.source: float(r.n) for r in before.groupBy("source").agg(F.sum("n_chars").alias("n")).collect()}
    epochs = mixing.water_fill(sizes, mixing.target(sizes, queries.WEIGHTS), sum(sizes.values()), queries.MAX_EPOCHS)
    import hashlib

    want = []
    for r in before.select("doc_id", "source").collect():
        u = int(hashlib.md5(f"{queries.SEED}|{r.doc_id}".encode()).hexdigest()[:13], 16) / 2**52
        e = epochs[r.source]
        want += [r.doc_id] * (int(e) + (u < e - int(e)))
    assert sorted(r.doc_id for r in after.collect()) == sorted(want) and after.columns == before.columns


def test_pack_stage(staged):
    before, after = staged[3]
    e = TokenEncoder()
    n = [len(e.encoding.encode_ordinary(r.text)) + 1 for r in before.collect()]
    rest, full = [x % queries.WINDOW for x in n if x % queries.WINDOW], sum(x // queries.WINDOW for x in n)
    windows, left = brute_pack(rest, queries.WINDOW)
    assert sorted(x for r in after.collect() for x in np.frombuffer(bytes(r.token_ids), "<u2").tolist()) == sorted(x for r in before.collect() for x in [*e.encoding.encode_ordinary(r.text), e.end])
    assert after.count() == windows + full and sorted(queries.WINDOW - r.used for r in after.collect()) == sorted(left + [0] * full)


def test_run_is_the_stages(spark, staged):
    assert pipe.run(spark, SF).count() == staged[-1][1].count()


def test_hard_and_empty_tables(spark):
    """Each stage on hard rows, against what its docstring says."""
    docs = spark.createDataFrame(HARD, DOC).withColumns({"detected": F.lit("x"), "margin": F.lit(1), "copy": F.lit(2)})
    got = {name: f(spark, docs, SF) for name, f in pipe.STAGES}
    for name, f in pipe.STAGES:
        empty = f(spark, docs.limit(0), SF)
        assert empty.count() == 0 and empty.columns == got[name].columns
        assert name == "pack" or got[name].columns == docs.columns
    rows = {name: df.collect() for name, df in got.items()}
    made = langid.train_dictionaries(docs, seed=queries.SEED)
    want = [r.doc_id for r in langid.identify(docs, made, queries.MARGIN).collect() if r._detected]
    assert sorted(map(str, want)) == sorted(str(r.doc_id) for r in rows["language_id"]) and all(r.text and r.lang in made for r in rows["language_id"])
    groups = brute_groups([(r[0], r[1]) for r in HARD])
    assert sorted(r.doc_id for r in rows["near_dedup"] if r.doc_id is not None) == sorted(groups) and sum(r.doc_id is None for r in rows["near_dedup"]) == 2
    sizes = {}
    for r in HARD:
        sizes[r[3]] = sizes.get(r[3], 0) + (r[4] if r[4] is not None else len(r[1] or ""))
    epochs = mixing.water_fill(sizes, mixing.target(sizes, {"src0": 0.0}), sum(sizes.values()), queries.MAX_EPOCHS)
    assert all(abs(e - 1) < 1e-9 for s, e in epochs.items() if sizes[s])  # no source is named: all stay as they are
    assert sorted(map(str, (r.doc_id for r in rows["mix"]))) == sorted(str(r[0]) for r in HARD)
    e = TokenEncoder()
    n = [len(e.encoding.encode_ordinary(r[1] or "")) + 1 for r in HARD]
    windows, left = brute_pack([x % queries.WINDOW for x in n if x % queries.WINDOW], queries.WINDOW)
    assert len(rows["pack"]) == windows + sum(x // queries.WINDOW for x in n) and sum(len(r.token_ids) for r in rows["pack"]) == 2 * sum(n)
