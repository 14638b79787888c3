"""Near duplicates by SuperMinHash, banding, exact verification and components.

1. A document's set holds the hashes of its distinct word shingles. SuperMinHash
   gives each element a permutation of the 256 signature slots and, in round j, a
   value in [j, j + 1) for the slot at rank j; a slot keeps its smallest value, so a
   document stops at the first round in which all slots are filled.
2. Documents with equal sets become one node, the smallest id, before any pair is
   made; only such nodes go on. Sets of up to 5 shingles reach 0.85 only when equal.
3. Bands of as many slots as keep a pair at the threshold sharing none below once in
   100,000 (36 bands of 7 at 0.85, 42 of 6 at 0.8), keyed with an octave of the set size; nodes within 0.85 of the next octave join it too. Each
   bucket ties its nodes to its smallest one: a star, never all pairs.
4. Nodes that such ties connect form a candidate family. Families are verified on full
   sets: one task multiplies the incidence matrix of a family's shared shingles in
   numpy, and returns a spanning forest of the links, not the pairs. A family larger
   than FAMILY nodes or SHINGLES shingles is dealt to parts, and each pair of parts is
   a task of its own, so a task's memory is bounded and no link is lost.
5. Components by union-find and pointer jumping over the confirmed links.

Nulls: a null or wordless text has an empty set and no links; a null id has a null
component and is kept. Rows with equal ids are one node. Empty tables give empty results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import docs_of, prepared, quoted, remove, shared_dir, written
from .components import components
from .words import Words, chunks, mix, window_hashes

SHINGLE = 5
PERCENT = 80
SLOTS = 256
MISS = 1e-5
FAMILY = 1024
SHINGLES = 1 << 20
COLUMNS = 4096
_U = np.uint64
_EMPTY = np.uint32(0xFFFFFFFF)


def shingle_sets(texts: list[bytes | None], k: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text in order, and where each text's end; a text of fewer than k words has one shingle, itself."""
    w = Words(texts, lower=True)
    hashes = w.hashes()
    at, doc = w.windows(k)
    h = window_hashes(hashes, at, k)
    cut = np.searchsorted(doc, np.arange(w.n + 1)).tolist()
    first, counts = w.first.tolist(), w.counts.tolist()
    sets = []
    for i in range(w.n):
        if counts[i] >= k:
            s = np.sort(h[cut[i] : cut[i + 1]])
            sets.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        else:
            sets.append(window_hashes(hashes[first[i] : first[i + 1]], np.zeros(1, np.int64), counts[i], 2) if counts[i] else h[:0])
    return (np.concatenate(sets) if sets else h[:0]), np.concatenate([[0], np.cumsum([len(s) for s in sets], dtype=np.int64)]).astype(np.int64)


def _slot(h: np.ndarray, j: int) -> np.ndarray:
    """The slot at rank j of each element's own permutation of 0..255: keyed affine maps and shifts, each a bijection."""
    x = np.full(len(h), j, np.uint32)
    for i, shift in enumerate((4, 3, 0)):
        bits = (h >> _U(15 * i)).astype(np.uint32)
        x = (x * ((bits & np.uint32(127)) * np.uint32(2) + np.uint32(1)) + ((bits >> np.uint32(7)) & np.uint32(255))) & np.uint32(255)
        if shift:
            x ^= x >> np.uint32(shift)
    return x.astype(np.int64)


def superminhash(h: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One row of SLOTS slots a document; a slot holds rank * 2**24 + 24 random bits."""
    n = len(ends) - 1
    sig = np.full(n * SLOTS, _EMPTY, np.uint32)
    doc = np.repeat(np.arange(n), np.diff(ends))
    key = mix(h)
    for j in range(SLOTS):
        if not len(key):
            break
        value = np.uint32(j << 24) | (mix(key + _U((j + 1) * 0x9E3779B97F4A7C15 % 2**64)) >> _U(40)).astype(np.uint32)
        np.minimum.at(sig, doc * SLOTS + _slot(key, j), value)
        full = (sig.reshape(n, SLOTS) != _EMPTY).all(axis=1)
        go = ~full[doc]
        doc, key = doc[go], key[go]
    return sig.reshape(n, SLOTS)


def rows_of_band(percent: int) -> int:
    """The most slots a band with which a pair at the threshold shares no band with a probability of at most MISS."""
    return max([1, *(r for r in range(1, 17) if (1 - (percent / 100) ** r) ** (SLOTS // r) <= MISS)])


def band_hashes(sig: np.ndarray, rows: int) -> np.ndarray:
    bands = SLOTS // rows
    parts = sig[:, : bands * rows].reshape(len(sig), bands, rows).astype(np.uint64)
    out = np.zeros((len(sig), bands), np.uint64)
    for r in range(rows):
        out = mix(out * _U(0x9E3779B97F4A7C15) + parts[:, :, r] + _U(1))
    return out.view(np.int64)


def _sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
    return (total[ends[1:]] - total[ends[:-1]]).view(np.int64)


def _signer(text: str, k: int, rows: int):
    def run(batches):
        for batch, texts in chunks(batches, text):
            h, ends = shingle_sets(texts, k)
            bands = band_hashes(superminhash(h, ends), rows)
            wide = bands.shape[1]
            yield pa.record_batch(
                [
                    batch.column(0),
                    pa.array(np.diff(ends)),
                    pa.array(_sums(mix(h), ends)),
                    pa.array(_sums(mix(h ^ _U(0xA5A5A5A55A5A5A5A)), ends)),
                    pa.ListArray.from_arrays(pa.array(np.arange(0, len(bands) * wide + 1, wide, dtype=np.int32)), pa.array(bands.reshape(-1))),
                ],
                names=["id", "n", "s1", "s2", "bands"],
            )

    return run


def _setter(text: str, k: int):
    def run(batches):
        for batch, texts in chunks(batches, text):
            h, ends = shingle_sets(texts, k)
            cols = {c: batch.column(batch.schema.get_field_index(c)) for c in ("id", "family", "part", "parts")}
            yield pa.record_batch([*cols.values(), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(h.view(np.int64)))], names=[*cols, "shingles"])

    return run


def _forest(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(member, root) for the nodes of a symmetric link matrix that have links."""
    free = np.ones(len(linked), bool)
    members, roots = [], []
    for seed in range(len(linked)):
        if not free[seed]:
            continue
        free[seed] = False
        edge = np.flatnonzero(linked[seed] & free)
        while len(edge):
            free[edge] = False
            members.append(edge)
            roots.append(np.full(len(edge), seed))
            edge = np.flatnonzero(linked[edge].any(axis=0) & free)
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *members]), np.concatenate([none, *roots])


def _verify(percent: int):
    def run(table: pa.Table) -> pa.Table:
        """The links of one family, or between two parts of one, on full sets."""
        ids, part = table.column("id").to_numpy(), table.column("part").to_numpy()
        sets = table.column("shingles").combine_chunks()
        n = sets.value_lengths().to_numpy().astype(np.int64)
        flat = sets.flatten().to_numpy()
        _, column, count = np.unique(flat, return_inverse=True, return_counts=True)
        # a shingle of one set only is in no intersection
        shared = count > 1
        on = shared[column]
        column, row = (np.cumsum(shared) - 1)[column[on]], np.repeat(np.arange(len(n)), n)[on]
        left = np.flatnonzero(part == part.min())
        right = np.flatnonzero(part == part.max())
        place = np.zeros(len(n), np.int64)
        place[left] = np.arange(len(left))
        other = np.zeros(len(n), np.int64)
        other[right] = np.arange(len(right))
        same = np.zeros((len(left), len(right)), np.float32)
        order = np.argsort(column, kind="stable")
        column, row = column[order], row[order]
        for lo in range(0, int(shared.sum()), COLUMNS):
            i, j = np.searchsorted(column, [lo, lo + COLUMNS])
            c, r = column[i:j] - lo, row[i:j]
            a = np.zeros((len(left), COLUMNS), np.float32)
            on = part[r] == part.min()
            a[place[r[on]], c[on]] = 1
            if len(left) == len(n):
                same += a @ a.T
                continue
            b = np.zeros((len(right), COLUMNS), np.float32)
            b[other[r[~on]], c[~on]] = 1
            same += a @ b.T
        same = same.astype(np.int64)
        close = 100 * same >= percent * (n[left][:, None] + n[right][None, :] - same)
        linked = np.zeros((len(n), len(n)), bool)
        linked[np.ix_(left, right)] = close
        linked |= linked.T
        member, root = _forest(linked)
        return pa.table({"a": pa.array(ids[root]), "b": pa.array(ids[member])})

    return run


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per document: id_col, n_shingles, component_id and kept, where documents of similarity percent / 100 or more are linked."""
    spark = prepared(docs.sparkSession)
    here = shared_dir(spark)
    d = docs.select(quoted(id_col).cast("long").alias("id"), quoted(text_col).cast("string").alias("text"))
    sigs = written(d.mapInArrow(_signer("text", shingle, rows_of_band(percent)), "id long, n long, s1 long, s2 long, bands array<long>"), f"{here}/sigs")
    groups = written(
        sigs.where("n > 0 AND id IS NOT NULL").groupBy("s1", "s2", "n").agg(F.min(F.struct("id", "bands")).alias("r")).select("s1", "s2", "n", F.col("r.id").alias("id"), "r.bands"),
        f"{here}/groups",
    )
    # equal shares of a union below this size are only reached by equal sets
    least = -(-percent // (100 - percent)) if percent < 100 else 1 << 62
    octave = F.floor(F.log2("n")).cast("int")
    near_next = F.col("n") * 100 >= F.pow(F.lit(2.0), octave + 1) * percent
    keys = (
        groups.where(F.col("n") >= least)
        .select("id", "bands", F.explode(F.when(near_next, F.array(octave, octave + 1)).otherwise(F.array(octave))).alias("octave"))
        .select("id", "octave", F.posexplode("bands").alias("pos", "band"))
        .select(F.xxhash64("pos", "band", "octave").alias("key"), "id")
    )
    heads = keys.groupBy("key").agg(F.min("id").alias("head"), F.count(F.lit(1)).alias("size")).where("size > 1").select("key", "head")
    ties = keys.join(heads, "key").where("id <> head").select(F.col("head").alias("a"), F.col("id").alias("b")).distinct()
    family = components(ties, f"{here}/family")
    family = family.unionByName(family.select(F.col("component").alias("node"), "component").distinct())
    member = written(family.join(groups.select(F.col("id").alias("node"), "n"), "node"), f"{here}/member")
    parts = F.ceil(F.greatest(F.count(F.lit(1)) / FAMILY, F.sum("n") / SHINGLES)).cast("int")
    sizes = member.groupBy("component").agg(parts.alias("parts"))
    part = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    dealt = member.join(sizes, "component").select(F.col("node").alias("id"), F.col("component").alias("family"), part.alias("part"), "parts")
    # the nodes of families grow with the input: co-partitioned at every size, never broadcast
    sets = d.join(dealt.hint("merge"), "id").mapInArrow(_setter("text", shingle), "id long, family long, part int, parts int, shingles array<long>")
    pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.struct(F.least("part", j).alias("i"), F.greatest("part", j).alias("j")))
    links = sets.withColumn("task", F.explode(pairs)).groupBy("family", "task").applyInArrow(_verify(percent), "a long, b long")
    comps = components(links, f"{here}/comps")

    def with_component(df: DataFrame, node: str, name: str) -> DataFrame:
        return df.join(comps.select(F.col("node").alias(node), F.col("component").alias(name)), node, "left").withColumn(name, F.coalesce(name, node))

    found = written(with_component(groups.select("s1", "s2", "n", "id"), "id", "component_id").select("s1", "s2", "n", "component_id"), f"{here}/found")
    for done in ("groups", "family", "member", "comps"):
        remove(spark, f"{here}/{done}")
    out = sigs.select("id", "n", "s1", "s2").join(found, ["s1", "s2", "n"], "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def op9_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_dedup(docs_of(spark, sf_dir).select("doc_id", "text"), shingle=3, percent=85)


OP9_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
  ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' '))) END AS g FROM w),
n AS (SELECT doc_id, len(g) AS n FROM s),
x AS (SELECT doc_id, unnest(g) AS g FROM s),
f AS (SELECT g FROM x GROUP BY g HAVING count(*) > 1),
y AS (SELECT x.* FROM x JOIN f USING (g)),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM y a JOIN y b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * i >= 85 * (na.n + nb.n - i)),
r AS (SELECT doc_id AS a, doc_id AS c FROM n UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.a),
c AS (SELECT a AS doc_id, min(c) AS component_id FROM r GROUP BY a)
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM n JOIN c USING (doc_id)
"""
