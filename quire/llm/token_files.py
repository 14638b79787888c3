"""Token ids in a compact binary format: canonical length-limited Huffman codes.

A data set is a folder of Parquet tables that Spark's committers write, so it can lie
in any store, and a lost executor leaves no half-written file:

codebook  symbol, length: the code lengths (at most MAX_BITS, by package-merge) of
          all ids that occur, from global counts; codes are canonical
blocks    shard, block, first (tokens of the shard before the block), doc ids and
          token counts of its documents, the packed bits, and the bit offset of every
          LANE-th token; a document lies in one block, in ascending id order
shards    shard, start: tokens of all shards before it

Blocks decode independently, and inside one all lanes advance together: each numpy
step peeks MAX_BITS bits in every lane and takes symbol and length from one table.

Texts are tokenised once. Ids go to a temporary table, with each task's counts, and
from there, dealt by ranges of document id, to their blocks. ASCII white space always
ends a token of the tokenizer here, so distinct words are encoded once and cached by
worker, and words of plain letters are encoded many to a call.
Lower-case letters without punctuation are cached longer than words, so the library
seldom sees the same ones again.

A null text counts as empty; a null document id sorts first; equal ids keep their rows,
ordered by their tokens. An empty table gives an empty data set.
"""

from __future__ import annotations

import json
import os
import re
from itertools import chain
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import docs_of, prepared, quoted, remove, shared_dir
from .words import Numbers, binaries, chunks, gathered

MAX_BITS = 20
LANE = 256
BLOCK_TOKENS = 1 << 20
CACHED, CORES = 400_000, 1_000_000
#: A word a line. Its tokens are those of its letters, then those of its punctuation, where it has only these: letters below U+0130, in which normal form and lower case are letters again, then ASCII punctuation. Any other word is one part.
MARKS = frozenset("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
PARTS = re.compile("^(?:([A-Za-zªµºÀ-ÖØ-öø-į]+)([!-/:-@\\[-`{-~]*)|(.+))$", re.MULTILINE)
#: The normal form and the cuts of a tokenizer that may be run by words (fixed values).
WORDS = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
)
_U = np.uint64


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most limit bits by package-merge; 0 for a count of 0."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    n = len(used)
    if n <= 1:
        out[used] = 1
        return out
    if n > 1 << limit:
        raise ValueError(f"{n} symbols need over {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.float64)
    weight, levels = leaves, [np.ones(n, bool)]
    for _ in range(limit - 1):
        packed = weight[: len(weight) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([leaves, packed])
        turn = np.argsort(both, kind="stable")
        weight = both[turn]
        levels.append(turn < n)
    take, length = 2 * n - 2, np.zeros(n, np.int64)
    for leaf in reversed(levels):
        k = int(leaf[:take].sum())
        length[:k] += 1
        take = 2 * (take - k)
    out[order] = length
    return out


class Codec:
    """Canonical codes for given lengths."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths.astype(np.int64)
        self.bits = max(1, int(self.lengths.max(initial=1)))
        symbols = np.flatnonzero(self.lengths)
        symbols = symbols[np.lexsort((symbols, self.lengths[symbols]))]
        span = np.left_shift(1, self.bits - self.lengths[symbols])
        start = np.cumsum(span) - span
        self.codes = np.zeros(len(lengths), np.uint64)
        self.codes[symbols] = start >> (self.bits - self.lengths[symbols])
        self.short = self.lengths.astype(np.uint8)
        self.left = self.codes << (64 - self.lengths).clip(0, 63).astype(np.uint64)
        size = 1 << self.bits
        self.symbol, self.step = np.zeros(size, np.uint32), np.ones(size, np.uint8)
        self.symbol[: span.sum()] = np.repeat(symbols, span)
        self.step[: span.sum()] = np.repeat(self.lengths[symbols], span)

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The packed bits, and the bit offset of every LANE-th token."""
        end = np.cumsum(self.short[ids], dtype=np.int64)
        at = np.concatenate([[0], end[:-1]])[: len(end)]
        total = int(end[-1]) if len(end) else 0
        # a code, left-aligned in the 64 bits from its word on, reaches one word further at most
        value = self.left[ids] >> (at & 31).astype(np.uint64)
        out = np.zeros((total >> 5) + 2, np.uint32)
        if len(ids):
            word = (at >> 5).astype(np.int32 if total < 2**36 else np.int64)
            first = np.flatnonzero(word[1:] != word[:-1]) + 1
            first = np.concatenate([[0], first])
            both = np.bitwise_or.reduceat(value, first)
            out[word[first]] = both >> _U(32)
            out[word[first] + 1] |= both.astype(np.uint32)
        return out.astype(">u4").tobytes()[: (total + 7) // 8], at[::LANE].astype("<i8")

    def decode(self, payloads: list[bytes], offsets: list[np.ndarray], counts: list[int]) -> list[np.ndarray]:
        """The ids of several blocks, all of their lanes in step."""
        base = np.cumsum([0] + [len(p) for p in payloads])[:-1]
        data = np.frombuffer(b"".join(payloads) + bytes(LANE * self.bits // 8 + 16), np.uint8).astype(np.uint32)
        peek = (data[:-3] << np.uint32(24)) | (data[1:-2] << np.uint32(16)) | (data[2:-1] << np.uint32(8)) | data[3:]
        pos = np.concatenate([o.astype(np.int64) + 8 * b for o, b in zip(offsets, base.tolist())]) if offsets else np.zeros(0, np.int64)
        out = np.zeros((len(pos), LANE), np.uint32)
        last = len(peek) - 1
        for i in range(LANE if max(counts, default=0) >= LANE else max(counts, default=0)):
            code = (peek[np.minimum(pos >> 3, last)] << (pos & 7).astype(np.uint32)) >> np.uint32(32 - self.bits)
            out[:, i] = self.symbol[code]
            pos += self.step[code]
        lanes = np.cumsum([0] + [len(o) for o in offsets]).tolist()
        return [out[a:b].reshape(-1)[:n] for a, b, n in zip(lanes, lanes[1:], counts)]


class Tokenizer:
    """A tokenizers-library model with a bounded cache of words.

    A word is two segments, its letters and its punctuation; any other word is a
    segment and the empty one. The ids of segment i are the lens[i] ones from starts[i]
    on; so are those of words.
    A tokenizer that doesn't cut and fold as WORDS says gets whole texts instead.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer as Model

        self.model = Model.from_file(path)
        size = self.model.get_vocab_size(with_added_tokens=True)
        self.size = size
        form = json.loads(self.model.to_str())
        self.by_words = (form["normalizer"], form["pre_tokenizer"]) == WORDS
        suffix = getattr(self.model.model, "end_of_word_suffix", None)
        self.last = np.array([bool(suffix) and str(self.model.id_to_token(i)).endswith(suffix) for i in range(size)])
        self.kind = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.clear()

    def clear(self) -> None:
        self.forget()
        self.cores = Numbers()
        self.cores[""] = 0
        self.starts, self.lens, self.ids = np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(0, self.kind)

    def forget(self) -> None:
        self.words = Numbers()
        self.word_starts, self.word_lens, self.word_ids = np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, self.kind)

    def _whole(self, words: list[str]) -> tuple[np.ndarray, list[int]]:
        """The ids of all words, and how many each has."""
        got = [e.ids for e in self.model.encode_batch_fast(words, add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(got), self.kind), [len(x) for x in got]

    def _letters(self, words: list[str]) -> tuple[np.ndarray, list[int]]:
        """The same for words of letters: many a call, cut after each token that ends a word."""
        out, lens = [np.zeros(0, self.kind)], []
        for lo in range(0, len(words), 1000):
            some = words[lo : lo + 1000]
            ids = np.array(self.model.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, self.kind)
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) != len(some) or ends[-1] != len(ids):
                ids, n = self._whole(some)
            else:
                n = np.diff(ends, prepend=0).tolist()
            out.append(ids)
            lens += n
        return np.concatenate(out), lens

    def _fill(self) -> None:
        """The segments of the new words, and the ids of the new segments."""
        words, self.words.new = self.words.new, []
        if not words:
            return
        # lower-casing keeps a letter of PARTS one letter of PARTS
        parts = PARTS.findall(b"\n".join(words).decode("utf-8", "replace").lower())
        new = np.empty((len(words), 2), np.int32)
        for i in (0, 1):
            new[:, i] = self.cores.of(map(itemgetter(i), parts), len(words))
        for at in np.flatnonzero(np.fromiter(map(len, map(itemgetter(2), parts)), np.int32, len(words))).tolist():
            new[at, 0] = self.cores[words[at]]  # as bytes, unlike segments
        found, self.cores.new = self.cores.new, []
        kinds: tuple[list, list] = [], []
        for x in found:
            kinds[isinstance(x, bytes) or x[0] in MARKS].append(x)
        for some, encode in zip(kinds, (self._letters, self._whole)):
            if some:
                ids, lens = encode([x.decode("utf-8", "replace") if isinstance(x, bytes) else x for x in some])
                n = np.array(lens)
                at = self.cores.of(some, len(some))
                more = len(self.cores) - len(self.lens)
                if more:
                    self.starts, self.lens = (np.concatenate([x, np.zeros(more, np.int64)]) for x in (self.starts, self.lens))
                self.starts[at], self.lens[at] = len(self.ids) + np.cumsum(n) - n, n
                self.ids = np.concatenate([self.ids, ids])
        part = new.reshape(-1)
        ids, done = gathered(self.ids, self.starts[part], self.lens[part])
        self.word_starts = np.concatenate([self.word_starts, (len(self.word_ids) + done[:-1:2]).astype(np.int32)])
        self.word_lens = np.concatenate([self.word_lens, np.diff(done[::2]).astype(np.int32)])
        self.word_ids = np.concatenate([self.word_ids, ids])

    def encode(self, texts: list[bytes | None], end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, end after each, and where each text ends."""
        last = np.zeros(0, self.kind) if end is None else np.array([end], self.kind)
        if not self.by_words:
            ids, lens = self._whole([(t or b"").decode("utf-8", "replace") for t in texts])
            stops = np.cumsum(lens, dtype=np.int64)
        else:
            if len(self.cores) > CORES:
                self.clear()
            if len(self.words) > CACHED:
                self.forget()
            words = [(t or b"").split() for t in texts]
            stops = np.cumsum(list(map(len, words)), dtype=np.int64)
            at = self.words.of(chain.from_iterable(words), int(stops[-1]) if len(stops) else 0)
            self._fill()
            ids, done = gathered(self.word_ids, self.word_starts[at], self.word_lens[at])
            stops = done[stops]
        if end is not None:
            ids = np.insert(ids, stops, last[0])
            stops = stops + np.arange(1, len(stops) + 1)
        return ids, stops


_LOADED: dict[str, Tokenizer] = {}


def loaded(path: str) -> Tokenizer:
    if path not in _LOADED:
        _LOADED[path] = Tokenizer(path)
    return _LOADED[path]


def _tokenise(path: str, end_id: int):
    """Rows of documents (id, ids) and, last, the task's counts (symbols, counts)."""

    def run(batches):
        total = None
        for batch, texts in chunks(batches, "text"):
            t = loaded(path)
            ids, stops = t.encode(texts, end_id)
            got = np.bincount(ids, minlength=t.size)
            total = got if total is None else total + got
            n = len(texts)
            data = binaries(ids, np.concatenate([[0], stops]))
            yield pa.record_batch([batch.column(0), data, pa.nulls(n, pa.list_(pa.int32())), pa.nulls(n, pa.list_(pa.int64()))], names=["id", "ids", "symbols", "counts"])
        if total is not None:
            used = np.flatnonzero(total)
            yield pa.record_batch([pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([used.tolist()], pa.list_(pa.int32())), pa.array([total[used].tolist()], pa.list_(pa.int64()))], names=["id", "ids", "symbols", "counts"])

    return run


def _pack(shared, kind: str):
    """Sorted documents of one shard to its blocks."""

    def run(batches):
        from pyspark import TaskContext

        codec = Codec(shared.value)
        shard, block, first = TaskContext.get().partitionId(), 0, 0
        names, sizes, parts, n = [], [], [], 0

        def flush():
            ids = np.frombuffer(b"".join(parts), kind)
            payload, offsets = codec.encode(ids)
            return pa.record_batch(
                [
                    pa.array([shard], pa.int32()), pa.array([block], pa.int32()), pa.array([first], pa.int64()), pa.array([len(ids)], pa.int64()),
                    pa.array([names], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int64())), pa.array([payload], pa.binary()), pa.array([offsets.tobytes()], pa.binary()),
                ],
                names=["shard", "block", "first", "n", "doc_ids", "doc_sizes", "payload", "offsets"],
            )

        for batch in batches:
            for i, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                size = len(data) // np.dtype(kind).itemsize
                names.append(i)
                sizes.append(size)
                parts.append(data)
                n += size
                if n >= BLOCK_TOKENS:
                    yield flush()
                    block, first, names, sizes, parts, n = block + 1, first + n, [], [], [], 0
        if names:
            yield flush()

    return run


_BLOCKS = "shard int, block int, first long, n long, doc_ids array<long>, doc_sizes array<long>, payload binary, offsets binary"


def write_tokens(docs: DataFrame, path: str, where: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2) -> None:
    """Tokenises docs, end_id after each, into a data set in the folder where."""
    spark = prepared(docs.sparkSession)
    temp = f"{where}/temp"
    texts = docs.select(quoted(id_col).cast("long").alias("id"), quoted(text_col).cast("string").alias("text"))
    texts.mapInArrow(_tokenise(path, end_id), "id long, ids binary, symbols array<int>, counts array<long>").write.option("compression", "snappy").parquet(temp)
    table = spark.read.parquet(temp)
    counts = table.where("symbols IS NOT NULL").select(F.explode(F.arrays_zip("symbols", "counts")).alias("s")).groupBy("s.symbols").agg(F.sum("s.counts").alias("n")).toArrow()
    tokenizer = loaded(path)
    total = np.zeros(tokenizer.size, np.int64)
    total[counts.column(0).to_numpy()] = counts.column(1).to_numpy()
    lengths = code_lengths(total)
    used = np.flatnonzero(lengths)
    spark.createDataFrame(pa.table({"symbol": used.astype(np.int32), "length": lengths[used].astype(np.int32)}), "symbol int, length int").coalesce(1).write.parquet(f"{where}/codebook")
    shared = spark.sparkContext.broadcast(lengths)
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = table.where("ids IS NOT NULL").select("id", "ids").repartitionByRange(shards, "id").sortWithinPartitions("id", "ids")
    ordered.mapInArrow(_pack(shared, tokenizer.kind.str), _BLOCKS).write.option("compression", "uncompressed").parquet(f"{where}/blocks")
    sizes = sorted((r.shard, r.n) for r in spark.read.parquet(f"{where}/blocks").groupBy("shard").agg(F.sum("n").alias("n")).collect())
    starts = np.concatenate([[0], np.cumsum([n for _, n in sizes], dtype=np.int64)]).astype(np.int64).tolist()
    spark.createDataFrame([(s, at) for (s, _), at in zip(sizes, starts)], "shard int, start long").coalesce(1).write.parquet(f"{where}/shards")
    remove(spark, temp)


def read_tokens(spark: SparkSession, where: str) -> DataFrame:
    """doc_id, start (tokens of all documents before it), n_tokens and ids (little-endian unsigned 32-bit integers) of a data set."""
    prepared(spark)
    book = spark.read.parquet(f"{where}/codebook").toArrow()
    lengths = np.zeros(int(max(book.column(0).to_pylist(), default=0)) + 1, np.uint8)
    lengths[book.column(0).to_numpy()] = book.column(1).to_numpy()
    shared = spark.sparkContext.broadcast(lengths)

    def run(batches):
        codec = Codec(shared.value)
        for batch in batches:
            col = {f: batch.column(i) for i, f in enumerate(batch.schema.names)}
            for lo in range(0, batch.num_rows, 2):
                part = {f: c.slice(lo, 2).to_pylist() for f, c in col.items()}
                offsets = [np.frombuffer(o, "<i8") for o in part["offsets"]]
                for ids, at, names, sizes in zip(codec.decode(part["payload"], offsets, part["n"]), part["at"], part["doc_ids"], part["doc_sizes"]):
                    cut = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]).astype(np.int64)
                    for i in range(0, len(names), 256):
                        j = min(i + 256, len(names))
                        data = binaries(ids[cut[i] : cut[j]].astype("<u4"), cut[i : j + 1] - cut[i])
                        yield pa.record_batch([pa.array(names[i:j], pa.int64()), pa.array(at + cut[i:j]), pa.array(sizes[i:j], pa.int64()), data], names=["doc_id", "start", "n_tokens", "ids"])

    blocks = spark.read.parquet(f"{where}/blocks").join(spark.read.parquet(f"{where}/shards"), "shard")
    return blocks.select((F.col("start") + F.col("first")).alias("at"), "n", "doc_ids", "doc_sizes", "payload", "offsets").mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def op2_token_files(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    where = shared_dir(spark)
    write_tokens(docs_of(spark, sf_dir).select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"), where)
    return read_tokens(spark, where).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
