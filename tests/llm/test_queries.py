"""The queries themselves, over small tables with odd rows: columns, held-out remainders, one row a document."""

import random
import zlib

import pytest
from pyspark.sql import functions as F

from quire.llm.queries import ORACLES, QUERIES

PASSAGE = " ".join(f"p{i}" for i in range(40))
COLUMNS = {
    "op1_substring_dedup": ["doc_id", "n_words", "n_removed", "kept_sha256"],
    "op2_token_files": ["doc_id", "start", "n_tokens", "ids_crc32"],
    "op3_language_id": ["doc_id", "held_out", "lang_pred", "score"],
    "op4_bloom_lm": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
    "op5_bpe": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op7_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op8_decontamination": ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
    "op9_near_dedup": ["doc_id", "n_shingles", "component_id", "kept"],
}
HELD_OUT = {"op3_language_id": (5, 0), "op4_bloom_lm": (7, 2), "op7_toxicity": (5, 0)}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    here = str(tmp_path_factory.mktemp("sf"))
    r = random.Random(3)
    values = [" ".join(f"w{r.randrange(90)}" for _ in range(r.randrange(1, 50))) for _ in range(60)]
    values += [None, "", " \t\n", f"a {PASSAGE} b", f"c {PASSAGE} d", values[5], values[5], "word " * 25_000, "x" * 60_000, "été 日本 ok"]
    rows = [(i * 3, t, [None, "en", "fr"][i % 3], "s", len(t or "")) for i, t in enumerate(values)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(here + "/documents.parquet")
    spark.createDataFrame([(i * 3, 1, int(i % 4 == 0)) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(here + "/labels.parquet")
    spark.createDataFrame([(1, PASSAGE), (2, "short one"), (3, None), (4, "")], "item_id long, text string").write.parquet(here + "/benchmark.parquet")
    return here


@pytest.mark.parametrize("name", list(COLUMNS))
def test_query(spark, tables, name):
    out = QUERIES[name](spark, tables)
    assert out.columns == COLUMNS[name]
    rows = {x.doc_id: x for x in out.collect()}
    want = [x.doc_id for x in spark.read.parquet(tables + "/documents.parquet").select("doc_id").collect()]
    assert sorted(rows) == sorted(want) and out.count() == len(want)
    if name in HELD_OUT:
        divisor, rest = HELD_OUT[name]
        assert all(x.held_out == (zlib.crc32(str(i).encode()) % divisor == rest) for i, x in rows.items())
    if name in ("op3_language_id", "op7_toxicity"):
        assert all(0 <= x.score <= 1 for x in rows.values())
    if name == "op2_token_files":
        at = 0
        for i in sorted(rows):
            assert rows[i].start == at
            at += rows[i].n_tokens


def test_queries_and_sql():
    assert len(QUERIES) == 10 and set(ORACLES) < set(QUERIES)
