import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    here = str(tmp_path_factory.mktemp("sf"))
    plain = [f"plain{i} words about river number {i} and stone {i * 7} near garden {i * 3} with paper {i + 5}" for i in range(60)]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(plain)]
    bad = [(100 + i, f"walk snarfbad {i} grulk river snarfbad {i * 9}", "en", "s", 1) for i in range(30)]
    passage = " ".join(f"p{i}" for i in range(60))
    rows += [(200, "start one " + passage + " end one alpha beta gamma delta " + " ".join(f"u{i}" for i in range(90)), "en", "s", 1), (201, "other " + " ".join(f"v{i}" for i in range(90)) + " " + passage + " tail", "en", "s", 1)]
    rows += [(300, plain[7], "en", "s", 1), (301, plain[9] + " indeed", "en", "s", 1)]
    rows += [(400, "before " + " ".join(f"bench{i}" for i in range(12)) + " after", "en", "s", 1), (500, None, None, None, None), (501, "", "en", "s", 0), (None, "a document without an id", "en", "s", 24)]
    spark.createDataFrame(rows + bad, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(here + "/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(60)] + [(100 + i, 0, 1) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(here + "/labels.parquet")
    spark.createDataFrame([(1, " ".join(f"bench{i}" for i in range(12))), (2, None)], "item_id long, text string").write.parquet(here + "/benchmark.parquet")
    return here


def test_stages(spark, tables):
    docs = spark.read.parquet(tables + "/documents.parquet")
    kept = {None: None}
    for name, stage in cp.STAGES:
        out = stage(spark, docs, tables)
        rows = {r.doc_id: r for r in out.collect()}
        if name != "bpe":
            assert out.columns == docs.columns
        kept[name] = rows
        docs = spark.createDataFrame(out.collect(), out.schema) if name != "bpe" else docs
    assert not any(i in kept["toxicity"] for i in range(100, 130)) and all(i in kept["toxicity"] for i in range(60))
    assert 300 not in kept["near_dedup"] and 301 not in kept["near_dedup"] and 7 in kept["near_dedup"] and None in kept["near_dedup"]
    struck = kept["substring_dedup"]
    assert "p30" not in struck[201].text and "p30" in struck[200].text and struck[201].n_chars == len(struck[201].text)
    assert struck[3].text == kept["near_dedup"][3].text and 500 in struck
    assert 400 not in kept["decontamination"] and set(range(60)) <= set(kept["decontamination"])
    assert set(kept["bpe"]) == set(kept["decontamination"]) and all(len(r.ids) == 4 * r.n_tokens for r in kept["bpe"].values())


def test_run_equals_its_stages(spark, tables):
    got = cp.run(spark, tables)
    assert len(cp.STAGES) == 5 and got.count() == got.select("doc_id").distinct().count() and got.where("doc_id = 400").count() == 0


CLASHING = ["score", "Predicted", "n_words", "n_removed", "kept_text", "items", "n_hit", "hit_spans", "contaminated", "component_id", "kept", "n_shingles", "n_tokens", "ids", "a.b"]


def test_stages_keep_clashing_columns(spark, tables):
    """Columns named like those of the operators keep their values; rows that repeat are both kept; n_chars may be missing."""
    docs = spark.read.parquet(tables + "/documents.parquet").drop("n_chars")
    plain = docs
    for name, stage in cp.STAGES[:-1]:
        wide = plain.select("*", *(F.concat(F.lit(c), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).alias(c) for c in CLASHING))
        out, want = stage(spark, wide, tables), stage(spark, plain, tables)
        assert out.columns == wide.columns
        got = sorted(map(str, out.select(*plain.columns).collect()))
        assert got == sorted(map(str, want.collect()))
        for r in out.collect():
            assert all(r[c] == c + ("-" if r.doc_id is None else str(r.doc_id)) for c in CLASHING)
        twice = stage(spark, plain.unionByName(plain), tables)
        if name != "toxicity":  # there, repeated rows train twice
            assert sorted(map(str, twice.collect())) == sorted(got * 2)
    assert cp.STAGES[-1][1](spark, wide, tables).count() == wide.count()


def test_stages_of_nothing(spark, tables, tmp_path):
    here = str(tmp_path)
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{tables}/{name}.parquet").limit(0).write.parquet(f"{here}/{name}.parquet")
    docs = spark.read.parquet(here + "/documents.parquet")
    for name, stage in cp.STAGES:
        assert stage(spark, docs, here).count() == 0
    assert cp.run(spark, here).count() == 0
