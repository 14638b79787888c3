"""The layout of many documents and the questions about it, as chained plans."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from quire.functions.rect import Rectangle
from quire.operators import layout, reading, scope, search, split
from quire.sources import pdf_source


@dataclass(frozen=True)
class LayoutIndex:
    """Blocks (doc_id, block_id, page_index, text, bbox[, chars]) with page rectangles (doc_id, page_index, rect). Every question returns a table, every change an index."""

    blocks: DataFrame
    page_rects: DataFrame
    parsed: DataFrame | None = None

    @classmethod
    def from_blocks(cls, blocks: DataFrame) -> LayoutIndex:
        return cls(blocks, layout.infer_page_rects(blocks))

    @classmethod
    def from_pdfs(cls, documents: DataFrame, password: str | bytes | None = None, concurrency: str = "on", keep_chars: bool = True) -> LayoutIndex:
        """From documents (doc_id, content[, password]). The parse is persisted, since blocks and pages both read it; it spills to disk."""
        pdf_source.check_concurrency(concurrency)
        parsed = pdf_source.parse_pdfs(documents, password).persist()
        pages = pdf_source.pages_of(parsed)
        return cls(pdf_source.blocks_of(parsed, keep_chars), pages.select("doc_id", "page_index", "rect"), parsed)

    @classmethod
    def open(cls, spark: SparkSession, path: str, password: str | bytes | None = None, **options) -> LayoutIndex:
        return cls.from_pdfs(pdf_source.read_pdfs(spark, path), password, **options)

    def close(self) -> None:
        """Releases the parse that from_pdfs persisted, also for the indexes made from this one."""
        if self.parsed is not None:
            self.parsed.unpersist()

    @property
    def doc_rects(self) -> DataFrame:
        return layout.document_rects(self.page_rects)

    @property
    def text(self) -> DataFrame:
        return reading.text(self.blocks)

    @property
    def lines(self) -> DataFrame:
        return reading.lines(self.blocks)

    def block_count(self) -> DataFrame:
        return self.blocks.groupBy("doc_id").count()

    def block_at(self, block_id: int) -> DataFrame:
        return self.blocks.where(f"block_id = {int(block_id)}")

    def search(self, rect: Rectangle, overlap: float = 0.0) -> DataFrame:
        return search.search(self.blocks, rect, overlap)

    def search_many(self, queries: DataFrame, overlap: float = 0.0) -> DataFrame:
        return search.search_join(self.blocks, queries, overlap)

    def search_regex(self, pattern: str) -> DataFrame:
        return search.search_regex(self.blocks, pattern)

    def has_regex(self, pattern: str) -> DataFrame:
        return search.has_regex(self.blocks, pattern)

    def scoped(self, rect: Rectangle, overlap: float = 0.0, merge_threshold: float = 0.0, normalize: bool = False, no_numeric_pair_merge: bool = False, no_date_pair_merge: bool = False) -> LayoutIndex:
        rules = scope.MergeRules(no_numeric_pair_merge, no_date_pair_merge)
        return LayoutIndex(scope.scoped(self.blocks, rect, overlap, merge_threshold, normalize, rules), self.page_rects, self.parsed)

    def split(self, pattern: str, boundaries: Rectangle | None = None) -> LayoutIndex:
        return LayoutIndex(split.split(self.blocks, pattern, boundaries), self.page_rects, self.parsed)
