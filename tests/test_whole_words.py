import pytest

from quire.derive import word_blocks
from quire.queries import QUERIES

LONG = "Donaudampfschifffahrtsgesellschaftskapitaen"
TEXT = f"one {LONG} two identification Abcdefghijklmnopq{'x' * 60}then last the {LONG.lower()}"


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("long"))
    spark.createDataFrame([(1, TEXT)], "doc_id long, text string").write.parquet(f"{d}/documents.parquet")
    return d


def test_words_are_whole_and_apart(spark, sf_dir):
    got = word_blocks(spark, sf_dir).orderBy("block_id").collect()
    assert [r.text for r in got] == TEXT.split()
    assert all(a.bbox.right < b.bbox.left for a, b in zip(got, got[1:]) if a.bbox.top == b.bbox.top)


@pytest.mark.parametrize("name", ["segment_words", "pdf_roundtrip_blocks"])
def test_blocks_are_whole_words(spark, sf_dir, name):
    got = QUERIES[name](spark, sf_dir).orderBy("block_id").collect()
    assert [r.text for r in got] == TEXT.split()
    want = word_blocks(spark, sf_dir).orderBy("block_id").collect()
    assert [(r.left, r.right) for r in got] == [(pytest.approx(w.bbox.left, abs=1e-3), pytest.approx(w.bbox.right, abs=1e-3)) for w in want]


@pytest.mark.parametrize("name", ["reading_text", "pdf_roundtrip_text"])
def test_texts_are_whole(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).first().text.split() == TEXT.split()


def test_matches_past_the_14th_character(spark, sf_dir):
    assert "th" in [r.text for r in QUERIES["split_label"](spark, sf_dir).collect() if r.left < 612]
    parts = "".join(r.text for r in QUERIES["split_label"](spark, sf_dir).orderBy("block_id").collect())
    assert parts == TEXT.replace(" ", "")
