"""Fuzzy line deduplication with DataFrame functions only.

Lines are normalised (lower case, each run of anything but letters and digits one blank). Two
different lines are linked if the edit similarity of their normalised texts, 1 - distance /
longer length, is at least 0.8. Of each connected group of lines one occurrence stays: the one
with the smallest document id, then text hash, then position.

Candidates come from a SimHash of `BLOCKS` blocks of 32 bits. A hash deals every feature of
a line to one block, and only the features of a block vote on its bits. A changed word leaves all
blocks but two as they are, two changed words all but four: by the pigeonhole rule lines are
joined on single blocks that hold enough features, shorter lines on pairs and triples of
blocks. Features are the distinct words; lines of fewer than seven distinct words are also
compared by their pairs of neighbouring letters, so that single words and scripts without
blanks are found. All features of a line vote, whatever their number. The edit check alone
decides on a link; the SimHash decides who is compared.

Exact copies of a line are folded first. In each bucket every line first meets one of the
bucket; only lines whose groups are then still apart meet each other, after a check of
length and SimHash distance.

Defined results: a null text stays null with 0 lines; lines without a letter or digit stay;
a document may end up with the empty text; rows with equal id and text count as one
document and are answered alike; null ids come first. Other columns are carried along.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patronlens.llm.common import stored
from patronlens.llm.components import components
from patronlens.llm.sieve import split_by

SIMILARITY = 0.8
#: Blocks of the SimHash, each of 32 bits.
BLOCKS = 5
#: Bits of all blocks in which a candidate may differ; lines that share one block only differ in about 64.
BITS_APART = 56
#: Features up to which a line is counted in packed counters of 8 bits; beyond, the same votes take counters of 32 bits.
WIDE = 240
#: (blocks joined, fewest words in them, most words of the line), and the same for pairs of letters.
WORD_KEYS = ((1, 4, None), (2, 4, 24), (3, 3, 10))
LETTER_KEYS = ((1, 3, None), (2, 2, 40), (3, 2, 12))
#: Lines of fewer distinct words are compared by letters: alone, or as well.
FEW, SOME = 4, 7
#: What a line is compared by: words, letters alone, letters as well.
WORDS, LETTERS, BOTH = 0, 1, 2


LETTER = r"[\p{L}\p{N}]"


def words_in(line: Column) -> Column:
    """Runs of letters and digits, in lower case."""
    return F.array_remove(F.split(F.lower(line), r"[^\p{L}\p{N}]+"), "")


def _packed(hashed: Column, width: int) -> list[Column]:
    """The bits of a 64-bit hash spread over `width` longs, each with a field of `width` bits for every width-th bit."""
    mask = sum(1 << at for at in range(0, 64, width))
    return [F.shiftrightunsigned(hashed, k).bitwiseAND(F.lit(mask)) for k in range(width)]


def _majority(sums: list[Column], words: Column, width: int) -> Column:
    """Bits that more than half of the words have set, from sums of packed hashes."""
    lanes = sum(1 << at for at in range(0, 64, 2 * width))
    low = lanes * ((1 << width) - 1)
    lift = (F.lit((1 << width) - 1) - F.shiftright(words, 1)) * F.lit(lanes)  # carries into the next bit from the majority on
    bits = F.lit(0).cast("long")
    for k, own in enumerate(sums):
        for shift in (0, width):
            reached = (F.shiftrightunsigned(own, shift).bitwiseAND(F.lit(low)) + lift).bitwiseAND(F.lit(lanes << width))
            bits = bits.bitwiseOR(F.shiftleft(F.shiftrightunsigned(reached, width), shift + k))
    return bits


def features(lines: DataFrame, keys: list[str], words: str) -> DataFrame:
    """`keys`, kind and the distinct features of a line: its words, and for few words its pairs of neighbouring letters."""
    distinct = F.array_distinct(words)
    # the letters of other lines are left out early, as Spark may compute both sides of a condition
    own = lines.select(*keys, distinct.alias("_own"), F.when(F.size(distinct) < SOME, F.col(words)).otherwise(F.array().cast("array<string>")).alias("_few"))
    own = own.select(*keys, "_own", F.split(F.concat(F.lit(" "), F.array_join("_few", " "), F.lit(" ")), "").alias("_letters"))
    pairs = F.zip_with("_letters", F.slice("_letters", 2, F.size("_letters")), lambda x, y: F.concat(x, y))
    own = own.select(*keys, "_own", F.array_distinct(F.array_compact(pairs)).alias("_pairs"))

    def of(kind: int, found: str) -> Column:
        return F.struct(F.lit(kind).alias("kind"), F.col(found).alias("found"))

    both = F.array(of(WORDS, "_own"), of(BOTH, "_pairs"))
    kinds = F.when(F.size("_own") < FEW, F.array(of(LETTERS, "_pairs"))).when(F.size("_own") < SOME, both).otherwise(F.array(of(WORDS, "_own")))
    return own.select(*keys, F.explode(kinds).alias("_kind")).select(*keys, "_kind.kind", F.col("_kind.found").alias("_words"))


def _shape(keys: list[str], bits: list[Column], held: list[Column]) -> list[Column | str]:
    n = reduce(lambda x, y: x.bitwiseOR(y), [F.shiftleft(F.least(h, F.lit(15)), 4 * c) for c, h in enumerate(held)])
    whole = reduce(lambda x, y: x + y, held)
    return [*keys, "kind", *[F.shiftright(F.shiftleft(b, 32), 32).cast("int").alias(f"b{c}") for c, b in enumerate(bits)], n.cast("int").alias("n"), F.least(whole, F.lit(255)).cast("int").alias("features")]


def with_simhash(lines: DataFrame, keys: list[str], words: str, long_lines: DataFrame | None = None) -> DataFrame:
    """`keys`, kind, the blocks b0, b1, ... and n, the features of each block (four bits a block, 15 for more).

    A line has one row of kind WORDS or LETTERS, and perhaps one of kind BOTH; keys name a line.
    `long_lines`, if given, are lines among which all of over `WIDE` features, words or pairs of letters, are found, so that the others are read once.
    """
    own = features(lines, keys, words).where(F.size("_words") <= WIDE)
    own = own.select(*keys, "kind", F.explode("_words").alias("_word")).select(*keys, "kind", F.xxhash64("_word").alias("_h"))
    own = own.withColumn("_at", F.pmod(F.shiftrightunsigned("_h", 33), F.lit(BLOCKS)))
    packed = _packed(F.col("_h"), 8)[:4]
    # without nulls the generated code stays small
    zero = F.lit(0).cast("long")
    sums = [F.coalesce(F.sum(p * (F.col("_at") == c).cast("long")), zero).alias(f"_s{c}_{k}") for c in range(BLOCKS) for k, p in enumerate(packed)]
    counts = F.coalesce(F.sum(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("_at") * 12).cast("int"))), zero).alias("_n")
    summed = own.groupBy(*keys, "kind").agg(counts, *sums)
    held = [F.shiftrightunsigned("_n", 12 * c).bitwiseAND(F.lit(4095)) for c in range(BLOCKS)]
    blocks = []
    for c in range(BLOCKS):
        bits = _majority([F.col(f"_s{c}_{k}") for k in range(4)], held[c], 8)
        blocks.append(bits.bitwiseOR(F.shiftrightunsigned(bits, 28)).bitwiseAND(F.lit(0xFFFFFFFF)))
    return summed.select(*_shape(keys, blocks, held)).union(_of_many(lines if long_lines is None else long_lines, keys, words))


def _of_many(lines: DataFrame, keys: list[str], words: str) -> DataFrame:
    """The same for lines of over `WIDE` features, words or pairs of letters, whose votes take wider counters."""
    own = features(lines, keys, words).where(F.size("_words") > WIDE).select(*keys, "kind", F.explode("_words").alias("_word"))
    own = own.select(*keys, "kind", F.xxhash64("_word").alias("_h")).withColumn("_at", F.pmod(F.shiftrightunsigned("_h", 33), F.lit(BLOCKS)))
    # two counters of 32 bits in a long: bit k and bit k + 32, where k is one of the 16 that a block keeps
    kept = [k for k in range(32) if k % 8 < 4]
    packed = _packed(F.col("_h"), 32)
    votes = own.groupBy(*keys, "kind", "_at").agg(F.count("*").alias("_n"), *[F.sum(packed[k]).alias(f"_s{k}") for k in kept])
    zero = F.lit(0).cast("long")
    bits = zero
    for k in kept:
        for own_votes, at in ((F.col(f"_s{k}").bitwiseAND(F.lit(0xFFFFFFFF)), k), (F.shiftrightunsigned(f"_s{k}", 32), k + 4)):
            bits = bits.bitwiseOR(F.when(own_votes * 2 > F.col("_n"), F.lit(1 << at).cast("long")).otherwise(zero))
    blocks = votes.select(*keys, "kind", "_at", "_n", bits.alias("_bits"))
    of = [(F.coalesce(F.max(F.when(F.col("_at") == c, F.col(x))), zero)).alias(f"{x}{c}") for c in range(BLOCKS) for x in ("_bits", "_n")]
    summed = blocks.groupBy(*keys, "kind").agg(*of)
    return summed.select(*_shape(keys, [F.col(f"_bits{c}") for c in range(BLOCKS)], [F.col(f"_n{c}") for c in range(BLOCKS)]))


def _keys() -> Column:
    """Keys of the buckets of a line: its blocks alone, in pairs and in triples, where they hold enough features."""
    held = [F.shiftright("n", 4 * c).bitwiseAND(F.lit(15)) for c in range(BLOCKS)]
    words = F.col("kind") == WORDS
    keys = []
    for (size, fewest, most), (_, letters, longest) in zip(WORD_KEYS, LETTER_KEYS, strict=True):
        short = F.lit(True) if most is None else F.col("features") <= F.when(words, most).otherwise(longest)
        for chosen in combinations(range(BLOCKS), size):
            enough = reduce(lambda x, y: x + y, [held[c] for c in chosen]) >= F.when(words, fewest).otherwise(letters)
            number = sum(1 << c for c in chosen)
            keys.append(F.when(short & enough, F.xxhash64(F.lit(number), words, *[F.col(f"b{c}") for c in chosen])))
    return F.array_compact(F.array(*keys))


def _similar(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of lines whose normalised texts reach the edit similarity.

    Words that both lines share at their beginning and end do not change the distance and are cut off first.
    """
    joined = pairs.join(texts.select(F.col("line").alias("a"), F.col("norm").alias("x")), "a").join(texts.select(F.col("line").alias("b"), F.col("norm").alias("y")), "b")
    longer = F.greatest(F.length("x"), F.length("y"))
    most = F.floor(longer * F.lit(round(1 - similarity, 9)) + F.lit(1e-9)).cast("int")
    near = joined.withColumn("_most", most).where(F.abs(F.length("x") - F.length("y")) <= F.col("_most"))
    split = near.select("a", "b", "_most", F.split("x", " ").alias("x"), F.split("y", " ").alias("y"))

    def same(x: Column, y: Column) -> Column:
        return (F.array_position(F.zip_with(x, y, lambda a, b: a.eqNullSafe(b)), False) - 1).cast("int")

    split = split.withColumn("_head", same(F.col("x"), F.col("y"))).withColumn("_tail", same(F.reverse("x"), F.reverse("y")))
    split = split.withColumn("_tail", F.least("_tail", F.least(F.size("x"), F.size("y")) - F.col("_head")))

    def middle(words: str) -> Column:
        return F.slice(words, F.col("_head") + 1, F.size(words) - F.col("_head") - F.col("_tail"))

    cut = split.select("a", "b", "_most", middle("x").alias("x"), middle("y").alias("y"))
    # words replaced one for one bound the distance from above; a pair within that bound needs no exact distance
    replaced = F.zip_with("x", "y", lambda a, b: F.when(a == b, 0).otherwise(F.greatest(F.length(a), F.length(b))))
    bounded = (F.size("x") == F.size("y")) & (F.aggregate(replaced, F.lit(0), lambda held, n: held + n) <= F.col("_most"))
    # where one side has no words left, a blank goes with the words
    rest = F.col("_most") - ((F.size("x") == 0) | (F.size("y") == 0)).cast("int")
    exact = cut.withColumn("_near", bounded).withColumn("_rest", rest).withColumn("x", F.array_join("x", " ")).withColumn("y", F.array_join("y", " "))
    return exact.where("case when _near then true when _rest < 0 then false else levenshtein(x, y, _rest) >= 0 end").select("a", "b")


def line_table(documents: DataFrame, document_id: str, text: str, beyond: int = 0) -> DataFrame:
    """Every line with a word: id, text hash, position, its words, its 128-bit name (line, check) and normalised length.

    With `beyond`, only lines of over `beyond` characters in lower case, and of those with half as many only the ones that
    may have over `beyond` / 2 distinct pairs of letters in fewer than `SOME` distinct words.
    """
    lines = documents.select(F.col(document_id).alias("id"), F.xxhash64(text).alias("th"), F.posexplode(F.split(F.col(text), "\n")).alias("pos", "_line"))
    if beyond:
        # n letters with a blank on either side have n + 1 pairs, k words of n letters n + k different ones at most
        lower, most = F.lower("_line"), SOME - 1
        long_word = LETTER + "{" + str((beyond // 2 - most) // most + 1) + "}"
        lines = lines.where(F.length("_line") * 4 >= beyond).where((F.length(lower) > beyond) | ((F.length(lower) * 2 >= beyond) & lower.rlike(long_word)))
    # a condition on the words themselves would make Spark find them once more
    worded = lines.where(F.lower("_line").rlike(LETTER)).withColumn("words", words_in(F.col("_line"))).drop("_line")
    return worded.withColumn("line", F.xxhash64("words")).withColumn("check", F.xxhash64(F.lit(1), "words")).withColumn("len", F.length(F.array_join("words", " ")))


def _fetch(documents: DataFrame, wanted: DataFrame, document_id: str, text: str) -> DataFrame:
    """(line, norm) of the wanted lines, each given by one place (id, th, pos)."""
    places = wanted.groupBy("id", "th").agg(F.collect_list(F.struct("pos", "line")).alias("_at"))  # at most the lines of one document
    rows = documents.select(F.col(document_id).alias("_id"), F.xxhash64(text).alias("th"), F.col(text).alias("_text"))
    maybe, _ = split_by(rows, "th", wanted.select("th"))
    found = maybe.join(places.withColumnRenamed("th", "_th"), (F.col("th") == F.col("_th")) & F.col("_id").eqNullSafe(F.col("id")))
    lines = found.select(F.split("_text", "\n").alias("_lines"), F.explode("_at").alias("_at")).select("_at.line", F.element_at("_lines", F.col("_at.pos") + 1).alias("_line"))
    return lines.select("line", F.array_join(words_in(F.col("_line")), " ").alias("norm")).distinct()


_SHAPE = ["len", *[f"b{c}" for c in range(BLOCKS)]]


def _may_be_near(one: str, two: str, similarity: float) -> Column:
    """Lengths that allow the edit similarity, and SimHashes within `BITS_APART`."""
    short, long = F.least(f"{one}.len", f"{two}.len"), F.greatest(f"{one}.len", f"{two}.len")
    apart = [F.bit_count(F.col(f"{one}.b{c}").bitwiseXOR(F.col(f"{two}.b{c}")).cast("long").bitwiseAND(F.lit(0xFFFFFFFF))) for c in range(BLOCKS)]
    return (long - short <= long * F.lit(round(1 - similarity, 9)) + F.lit(1e-9)) & (reduce(lambda x, y: x + y, apart) <= BITS_APART)


def _ordered(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def line_groups(lines: DataFrame, documents: DataFrame, document_id: str, text: str, similarity: float = SIMILARITY) -> DataFrame:
    """(line, root) for all lines in a group of at least two different lines; `lines` holds distinct lines and kinds."""
    keyed = lines.select("line", *_SHAPE, F.explode(_keys()).alias("key")).repartition("key")
    heads = keyed.groupBy("key").agg(F.min(F.struct("line", *_SHAPE)).alias("head"), F.count("*").alias("size")).where("size > 1")
    buckets = stored(keyed.join(heads, "key").select("key", "size", "head", F.struct("line", *_SHAPE).alias("own")))
    tried = stored(buckets.where((F.col("own.line") != F.col("head.line")) & _may_be_near("own", "head", similarity)).select(*_ordered("own.line", "head.line")).distinct())
    places = lines.where(F.col("kind") != BOTH).select("line", "first")

    def links(pairs: DataFrame) -> DataFrame:
        wanted = places.join(pairs.select(F.explode(F.array("a", "b")).alias("line")).distinct(), "line", "left_semi").select("line", "first.*")
        return _similar(pairs, stored(_fetch(documents, wanted, document_id, text)), similarity)

    first = stored(components(links(tried), "a", "b"))
    # second pass: lines of a bucket whose groups are still apart
    more = buckets.where("size > 2").select("key", "own", F.col("own.line").alias("line"))
    placed = stored(more.join(first.select(F.col("node").alias("line"), "root"), "line", "left").select("key", "own", F.coalesce("root", "line").alias("root")))
    apart = placed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low != high").select("key")
    open_ = placed.join(apart, "key", "left_semi")
    one, two = open_.select("key", F.col("own").alias("one"), F.col("root").alias("r")), open_.select("key", F.col("own").alias("two"), F.col("root").alias("q"))
    met = one.join(two, "key").where((F.col("r") < F.col("q")) & _may_be_near("one", "two", similarity)).select(*_ordered("one.line", "two.line")).distinct()
    late = stored(links(stored(met.join(tried, ["a", "b"], "left_anti"))))
    roots = first.select(F.col("node").alias("a"), F.col("root").alias("b"))
    return components(roots.union(late), "a", "b").select(F.col("node").alias("line"), "root")


def dedup_lines(documents: DataFrame, document_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """The documents without repeated lines, then n_lines and n_removed."""
    # a word has a letter at least, and something lies between two words
    lines, long_lines = (line_table(documents, document_id, text, beyond) for beyond in (0, 2 * WIDE))
    hashed = stored(with_simhash(lines, ["id", "th", "pos", "line", "check", "len"], "words", long_lines))
    occurrences = hashed.where(F.col("kind") != BOTH).select("id", "th", "pos", "line", "check")
    shape = [F.min(c).alias(c) for c in (*_SHAPE, "n", "features")]
    kinds = stored(hashed.groupBy("line", "check", "kind").agg(F.min(F.struct("id", "th", "pos")).alias("first"), F.count("*").alias("copies"), *shape))
    distinct = kinds.where(F.col("kind") != BOTH).select("line", "check", "first", "copies")
    groups = stored(line_groups(kinds, documents, document_id, text, similarity))
    repeated = distinct.join(groups, "line", "left").withColumn("root", F.coalesce("root", "line"))
    kept = repeated.join(groups.select("root").distinct().withColumn("_grouped", F.lit(True)), "root", "left").where("copies > 1 or _grouped")
    best = kept.groupBy("root").agg(F.min("first").alias("best"))
    heads = kept.select("line", "check", "root").join(best, "root").drop("root")
    late = F.struct("id", "th", "pos") > F.col("best")
    removed = stored(occurrences.join(heads, ["line", "check"]).where(late).groupBy("id", "th").agg(F.array_sort(F.collect_list("pos")).alias("_gone")))  # at most the lines of one document
    rows = documents.select(*[F.col(c).alias(f"_c{i}") for i, c in enumerate(documents.columns)], F.xxhash64(text).alias("th"), F.col(document_id).alias("id"), F.col(text).alias("_text"))
    touched, clean = split_by(rows, "th", removed.select("th"))
    joined = touched.join(removed.withColumnsRenamed({"id": "_id", "th": "_th"}), (F.col("th") == F.col("_th")) & F.col("id").eqNullSafe(F.col("_id")), "left")
    split, gone = F.split(F.col("_text"), "\n"), F.col("_gone")
    n_lines = F.when(F.col("_text").isNull(), 0).otherwise(F.size(split)).cast("long")
    stay = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), gone)
    text_left = F.when(gone.isNull(), F.col("_text")).otherwise(F.array_join(F.transform(stay, lambda at: F.element_at(split, at + 1)), "\n"))
    out = joined.select(*rows.columns, text_left.alias("_left"), F.when(gone.isNull(), 0).otherwise(F.size(gone)).cast("long").alias("_n")).union(
        clean.select(*rows.columns, F.col("_text").alias("_left"), F.lit(0).cast("long").alias("_n"))
    )
    columns = [(F.col("_left") if c == text else F.col(f"_c{i}")).alias(c) for i, c in enumerate(documents.columns)]
    return out.select(*columns, n_lines.alias("n_lines"), F.col("_n").alias("n_removed"))
