"""N-gram Jaccard join: MinHash banding, then exact verification of every candidate.

A document is the set of its runs of five words (fewer words, but not none: one run). Two
documents are linked if their sets have a Jaccard similarity of at least 0.8. Row and band
counts of the MinHash signature follow from the wanted recall. Only copies of a text are
folded first; then each text meets the smallest text of its band buckets, and the connected
groups of that star graph hold every pair with a common band. Inside a group all pairs are
compared on their full sets by blocks of at most `BLOCK` texts, as matrix products; a block
pair sends on one row a text (its number of links and its local group), never the pairs.

Result: one row a document with class_id (the smallest id of its connected class), n_copies
(documents with the same text, itself included) and n_links (other documents linked to it,
copies counted).

Defined results: a text that is null or has no word has no set; it is linked to nothing, is
a class of its own and has 1 copy. Equal texts with words are copies and thereby linked. A
null id is the smallest id. Repeated rows are copies. Other columns play no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patronlens.llm.common import slices, stored, words_of
from patronlens.llm.components import components
from patronlens.llm.sieve import split_by

WORDS = 5
THRESHOLD = 0.8
RECALL = 0.99999
#: Texts of one side of a block pair; bounds the memory of a task.
BLOCK = 512
BATCH_BYTES = 1 << 20
COLUMNS_AT_ONCE = 4096
CACHED_WORDS = 500_000


def choose_bands(threshold: float = THRESHOLD, recall: float = RECALL, most_bands: int = 48) -> tuple[int, int]:
    """(bands, rows): the most rows a band for which at most `most_bands` bands reach the recall at the threshold."""
    best = (1, 1)
    for rows in range(1, 33):
        bands = math.ceil(math.log(1 - recall) / math.log1p(-(threshold**rows))) if threshold < 1 else 1
        if bands <= most_bands:
            best = (bands, rows)
    return best


class Shingler:
    """Hashed word n-grams of texts; word hashes are kept between texts, up to a bounded number."""

    def __init__(self, words: int = WORDS):
        self.words, self.cache = words, {}

    def __call__(self, text: str | None) -> np.ndarray:
        tokens = words_of(text)
        if not tokens:
            return np.zeros(0, np.uint64)
        cache = self.cache
        if len(cache) > CACHED_WORDS:
            cache.clear()
        for token in {t for t in tokens if t not in cache}:
            cache[token] = xxhash.xxh3_64_intdigest(token.encode("utf-8", "surrogatepass"))
        hashes = np.fromiter(map(cache.__getitem__, tokens), np.uint64, len(tokens))
        n = max(1, len(tokens) - self.words + 1)
        grams = np.zeros(n, np.uint64)
        for k in range(min(self.words, len(tokens))):
            grams = _mixed(grams * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + n] + np.uint64(1))
        return np.unique(grams)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def band_hashes(grams: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit hash for each band of the MinHash signature (multiply-shift hashing of mixed shingles)."""
    seeds = _mixed(np.arange(1, bands * rows + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)) | np.uint64(1)
    lows = np.empty(bands * rows, np.uint64)
    for begin in range(0, len(grams), 4096):
        part = (grams[begin : begin + 4096, None] * seeds[None, :]).min(axis=0)
        lows = part if not begin else np.minimum(lows, part)
    key = np.arange(1, bands + 1, dtype=np.uint64)
    for row in range(rows):
        key = _mixed(key * np.uint64(0x9E3779B97F4A7C15) + lows[row::rows])
    return key


def signatures(documents: DataFrame, document_id: str, text: str, bands: int, rows: int, words: int) -> DataFrame:
    """(id, node, keys) for each row; node names the text, keys is null where it has no word."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(words)
        with np.errstate(over="ignore"):
            for part in slices(batches, "_text", BATCH_BYTES):
                sets = [shingle(t) for t in part.column("_text").to_pylist()]
                keys = [band_hashes(s, bands, rows).view(np.int64) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("node"), pa.array(keys, pa.list_(pa.int64()))], ["id", "node", "keys"])

    used = documents.select(F.col(document_id).alias("id"), F.xxhash64(text).alias("node"), F.col(text).alias("_text"))
    return used.mapInArrow(sign, f"id {used.schema['id'].dataType.simpleString()}, node long, keys array<long>")


def _linked(left: list[np.ndarray], right: list[np.ndarray] | None, threshold: float) -> np.ndarray:
    """Which sets of the two sides reach the threshold; right None: the left side with itself."""
    sets = left + (right or [])
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, at, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count > 1
    place = np.cumsum(shared) - 1
    use = shared[at]
    at, owner = place[at[use]], owner[use]
    order = np.argsort(at, kind="stable")
    at, owner = at[order], owner[order]
    n = len(left)
    common = np.zeros((n, len(sets) - n if right is not None else n), np.float32)
    total = int(shared.sum())
    for begin in range(0, total, COLUMNS_AT_ONCE):
        low, high = np.searchsorted(at, [begin, begin + COLUMNS_AT_ONCE])
        matrix = np.zeros((len(sets), min(COLUMNS_AT_ONCE, total - begin)), np.float32)
        matrix[owner[low:high], at[low:high] - begin] = 1
        common += matrix[:n] @ (matrix[n:] if right is not None else matrix).T
    a = np.array([len(s) for s in left], float)
    b = np.array([len(s) for s in right], float) if right is not None else a
    union = a[:, None] + b[None, :] - common
    found = common >= threshold * union - 1e-9
    return found & (union > 0)


def _roots(matrix_rows: np.ndarray, matrix_columns: np.ndarray, size: int) -> np.ndarray:
    """Smallest member of each node's component, by repeated minimum over links."""
    root = np.arange(size)
    while True:
        before = root.copy()
        np.minimum.at(root, matrix_rows, root[matrix_columns])
        np.minimum.at(root, matrix_columns, root[matrix_rows])
        root = root[root]
        if (root == before).all():
            return root


def verify(members: DataFrame, threshold: float, words: int) -> DataFrame:
    """(node, root, links) for each text and block pair it is in. members: node, weight, group, one, two, side, _text."""

    def compare(table: pa.Table) -> pa.Table:
        shingle = Shingler(words)
        with np.errstate(over="ignore"):
            side = np.array(table.column("side").to_pylist())
            order = np.lexsort((table.column("node").to_numpy(), side))
            nodes, weight, side = table.column("node").to_numpy()[order], table.column("weight").to_numpy()[order].astype(float), side[order]
            texts = table.column("_text").to_pylist()
            sets = [shingle(texts[i]) for i in order]
        n = int((side == 0).sum())
        if n == len(sets):
            linked = _linked(sets, None, threshold)
            np.fill_diagonal(linked, False)
            links = linked @ weight
            rows, columns = np.nonzero(np.triu(linked))
        else:
            linked = _linked(sets[:n], sets[n:], threshold)
            links = np.concatenate([linked @ weight[n:], linked.T @ weight[:n]])
            rows, columns = np.nonzero(linked)
            columns = columns + n
        root = _roots(rows, columns, len(sets))
        return pa.table({"node": nodes, "root": nodes[root], "links": links.astype(np.int64)})

    return members.groupBy("group", "one", "two").applyInArrow(compare, "node long, root long, links long")


def classes(documents: DataFrame, document_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, recall: float = RECALL, words: int = WORDS) -> DataFrame:
    """(id, class_id, n_copies, n_links, node, head) for each row; node is xxhash64 of the text, head that of the class's first text."""
    bands, rows = choose_bands(threshold, recall)
    signed = stored(signatures(documents, document_id, text, bands, rows, words))
    full = signed.where("keys is not null")
    copies = stored(full.groupBy("node").agg(F.min(F.struct(F.col("id").isNotNull().alias("known"), "id")).alias("first"), F.count("*").alias("weight")))
    keyed = full.select("node", F.explode("keys").alias("key"))
    hubs = keyed.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("top")).where("hub < top").select("key", "hub")
    star = keyed.join(hubs, "key").where("node != hub").select("node", "hub").distinct()
    groups = components(star, "node", "hub").select("node", F.col("root").alias("group"))
    sizes = groups.groupBy("group").agg(F.count("*").alias("size"))
    parts = F.ceil(F.col("size") / BLOCK).cast("int")
    placed = stored(groups.join(sizes, "group").join(copies, "node").select("node", "group", "weight", "first", parts.alias("parts"), F.pmod(F.xxhash64("node"), parts).cast("int").alias("part")))
    # one text a node: a row with the node's smallest id, equal rows folded
    maybe, _ = split_by(documents.select(F.col(document_id).alias("id"), F.xxhash64(text).alias("node"), F.col(text).alias("_text")), "node", placed.select("node"))
    texts = maybe.join(placed.withColumnRenamed("node", "_node"), (F.col("node") == F.col("_node")) & F.col("id").eqNullSafe(F.col("first.id"))).dropDuplicates(["node"])
    spread = texts.select("node", "weight", "group", "_text", "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    # where part meets itself all its texts are side 0
    members = spread.select("node", "weight", "group", F.least("part", "other").alias("one"), F.greatest("part", "other").alias("two"), (F.col("part") > F.col("other")).cast("int").alias("side"), "_text")
    found = stored(verify(members, threshold, words))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    class_of = components(found.where("node != root").select("node", "root"), "node", "root")
    heads = class_of.join(copies, "node").groupBy("root").agg(F.min(F.struct("first", "node")).alias("head"))
    named = class_of.join(heads, "root").select("node", F.col("head.first.id").alias("head"), F.col("head.node").alias("head_node"))
    whole = copies.join(links, "node", "left").join(named, "node", "left").select(
        F.col("node").alias("_node"), F.col("weight").alias("_w"), F.coalesce("links", F.lit(0)).alias("_l"), F.col("head").alias("_h"), F.col("first.id").alias("_f"), F.col("head_node").alias("_in"),
    )
    joined = full.select("id", "node").join(whole, F.col("node") == F.col("_node")).select(
        "id", F.when(F.col("_in").isNotNull(), F.col("_h")).otherwise(F.col("_f")).alias("class_id"), F.col("_w").cast("long").alias("n_copies"), (F.col("_w") - 1 + F.col("_l")).cast("long").alias("n_links"), "node", F.coalesce("_in", "node").alias("head"),
    )
    alone = signed.where("keys is null").select("id", F.col("id").alias("class_id"), F.lit(1).cast("long").alias("n_copies"), F.lit(0).cast("long").alias("n_links"), "node", F.col("node").alias("head"))
    return joined.union(alone)


def representatives(documents: DataFrame, document_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with one row for each class of near copies: that of the smallest id, of equal ids that of the smallest text hash.

    Documents without a word are of no class and all stay.
    """
    found = classes(documents, document_id, text)
    marks = stored(found.where("n_copies + n_links > 1").select("node", F.col("class_id").alias("_id"), "head").distinct())
    names = [f"_c{i}" for i in range(len(documents.columns))]
    rows = documents.select(*[F.col(c).alias(n) for c, n in zip(documents.columns, names, strict=True)], F.col(document_id).alias("_own"), F.xxhash64(text).alias("node"))
    maybe, clear = split_by(rows, "node", marks.select("node"))
    joined = maybe.join(marks.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left")
    free = joined.where("_node is null").select(*names)
    stay = joined.where(F.col("_node").isNotNull() & F.col("_own").eqNullSafe(F.col("_id")) & (F.col("node") == F.col("head")))
    # only rows that repeat id and text are left to fold
    first = stay.groupBy("_own", "node").agg(F.min(F.struct(*names)).alias("row")).select("row.*")
    out = free.union(first.select(*names)).union(clear.select(*names))
    return out.select(*[F.col(n).alias(c) for c, n in zip(documents.columns, names, strict=True)])
