"""Fuzzy line deduplication against a brute-force version, and on odd rows."""

import random
import unicodedata

import xxhash
from pyspark.sql import Row
from pyspark.sql import types as T

from patronlens.llm import line_dedup

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("pos", T.StringType()), T.StructField("line", T.LongType())])


def _norm(line):
    return "".join(c if unicodedata.category(c)[0] in "LN" else " " for c in line.lower()).split()


def _blocks(words):
    """Blocks of the SimHash of words, and the features of each block."""
    counts, held = [[0] * 64 for _ in range(line_dedup.BLOCKS)], [0] * line_dedup.BLOCKS
    for word in set(words):
        h = xxhash.xxh64_intdigest(word.encode(), seed=42)
        at = (h >> 33) % line_dedup.BLOCKS
        held[at] += 1
        for k in range(64):
            counts[at][k] += h >> k & 1
    bits = [sum(1 << k for k in range(64) if k % 8 < 4 and 2 * own[k] > n) for own, n in zip(counts, held, strict=True)]
    return [(b | b >> 28) & 0xFFFFFFFF for b in bits], [min(n, 15) for n in held]


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def _brute(rows):
    """{(id, text): text left} by the edit similarity of all pairs of lines, without any SimHash."""
    def signed(h):
        return h - (1 << 64) if h >> 63 else h

    spots = []
    for doc_id, text in set(rows):
        for pos, line in enumerate((text or "").split("\n") if text is not None else []):
            if words := _norm(line):
                th = signed(xxhash.xxh64_intdigest(text.encode(), seed=42))
                spots.append(((doc_id is not None, doc_id or 0, th, pos), " ".join(words), (doc_id, text), pos))
    distinct = sorted({s[1] for s in spots})
    parent = {d: d for d in distinct}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if abs(len(a) - len(b)) <= 0.2 * max(len(a), len(b)) and _distance(a, b) <= 0.2 * max(len(a), len(b)) + 1e-9:
                parent[find(a)] = find(b)
    best = {}
    for key, norm, _, _ in spots:
        root = find(norm)
        best[root] = min(best.get(root, key), key)
    gone = {(doc, pos) for key, norm, doc, pos in spots if best[find(norm)] != key}
    return {doc: None if doc[1] is None else "\n".join(line for pos, line in enumerate(doc[1].split("\n")) if (doc, pos) not in gone) for doc in set(rows)}


def _run(spark, rows):
    frame = spark.createDataFrame([Row(doc_id=i, text=t, pos="p", line=7) for i, t in rows], SCHEMA)
    return line_dedup.dedup_lines(frame)


BASE = "the quick brown fox jumps over the lazy dog while twelve other animals of the same forest watch it from afar and say nothing at all"


def test_equals_brute_force(spark):
    variants = [BASE.replace(word, word + "s", 1) for word in BASE.split()] + [BASE + " again", BASE.upper() + "!!!"]
    rows = [(i, f"line number {i} here\n{v}\nshared line of this text\n\n---") for i, v in enumerate(variants)]
    rows += [(100, "a b c d e f g\ng f e d c b a\nA, b; c. d e f g"), (101, "dog cat\ncat dog\ndogs cat"), (None, BASE), (101, "dog cat")]
    got = {(r.doc_id, r.line): r for r in _run(spark, rows).collect()}
    assert len(got) > 0
    left = sorted((str(r.doc_id), r.text or "") for r in _run(spark, rows).collect())
    brute = _brute(rows)
    assert left == sorted((str(d[0]), brute[d] or "") for d in rows)


def test_real_documents_equal_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("length(text) < 400").collect()]
    got = {(r.doc_id): r.text for r in _run(spark, rows).collect()}
    brute = _brute(rows)
    assert got == {d[0]: t for d, t in brute.items()}


def test_one_changed_letter_or_word_is_found(spark):
    """Pairs of edit similarity 0.8 or more, by number of words; the shares are lower bounds of what is stated for the method."""
    rnd = random.Random(5)

    def word():
        return "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randint(4, 9)))

    rows, kinds = [], {}
    for n in (1, 5, 12, 20, 40, 0):
        for _ in range(60):
            one = [word() for _ in range(n)] if n else [chr(0x4E00 + rnd.randrange(2000)) for _ in range(20)]
            two, at = list(one), rnd.randrange(max(n, 1))
            two[at] = two[at][:1] + "9" + two[at][2:] if 0 < n < 12 else word() if n else "\u9fa0"
            gap = " " if n else ""
            x, y = gap.join(one), gap.join(two)
            if _distance(x, y) <= 0.2 * max(len(x), len(y)):
                kinds[len(rows) + 1] = n
                rows += [(len(rows), x), (len(rows) + 1, y)]
    found = {r.doc_id: r.n_removed for r in _run(spark, rows).collect()}
    shares = {n: sum(found[i] for i, k in kinds.items() if k == n) / sum(k == n for k in kinds.values()) for n in set(kinds.values())}
    least = {1: 0.6, 5: 0.9, 12: 0.9, 20: 0.97, 40: 0.97, 0: 0.8}
    assert all(shares[n] >= least[n] for n in least), shares


def test_two_changed_words_of_long_lines(spark):
    rnd = random.Random(9)
    rows = []
    for i in range(60):
        one = ["".join(rnd.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(rnd.choice((20, 40)))]
        two = list(one)
        for at in rnd.sample(range(len(one)), 2):
            two[at] = "changed" + str(i)
        rows += [(2 * i, " ".join(one)), (2 * i + 1, " ".join(two))]
    found = {r.doc_id: r.n_removed for r in _run(spark, rows).collect()}
    assert sum(found.values()) >= 54 and not any(found[2 * i] for i in range(60))


def test_a_group_of_variants_keeps_one_line(spark):
    variants = [BASE.replace(word, word[0] + "x" + word[1:], 1) for word in set(BASE.split())]
    got = _run(spark, [(i, v) for i, v in enumerate([BASE, *variants, BASE])]).collect()
    assert [r.doc_id for r in got if r.text] == [0]


def test_blocks_of_the_simhash(spark):
    words = {n: [f"w{i}" for i in range(n)] for n in (7, 8, 40, 127, line_dedup.WIDE)}
    frame = spark.createDataFrame([(n, own * 2) for n, own in words.items()], "n_words int, words array<string>")
    for row in line_dedup.with_simhash(frame, ["n_words"], "words").collect():
        blocks, held = _blocks(words[row.n_words])
        assert [row[f"b{c}"] & 0xFFFFFFFF for c in range(line_dedup.BLOCKS)] == blocks
        assert [row.n >> 4 * c & 15 for c in range(line_dedup.BLOCKS)] == held


def test_lines_of_very_many_words(spark):
    rows = []
    for n in (300, 5_000, 40_000):
        own = [f"w{n}x{i}" for i in range(n)]
        rows += [(n, " ".join(own)), (n + 1, " ".join(own[: n // 2] + ["other"] + own[n // 2 + 1 :]))]
    got = {r.doc_id: r.n_removed for r in _run(spark, rows).collect()}
    assert got == {n + k: k for n in (300, 5_000, 40_000) for k in (0, 1)}


def test_all_features_of_long_lines_vote(spark):
    words = {n: [f"w{i}" for i in range(n)] for n in (line_dedup.WIDE, line_dedup.WIDE + 1, 1_921, 5_000)}
    frame = spark.createDataFrame([(n, own * 2) for n, own in words.items()], "n_words int, words array<string>")
    for row in line_dedup.with_simhash(frame, ["n_words"], "words").collect():
        blocks, held = _blocks(words[row.n_words])
        assert [row[f"b{c}"] & 0xFFFFFFFF for c in range(line_dedup.BLOCKS)] == blocks
        assert [row.n >> 4 * c & 15 for c in range(line_dedup.BLOCKS)] == held and row.features == min(row.n_words, 255)


def test_lines_on_both_sides_of_the_packed_counters_meet(spark):
    rows = []
    for i, n in enumerate((240, 240, 240, 1_920, 1_920)):
        own = [f"w{i}x{j}" for j in range(n)]
        rows += [(2 * i, " ".join(own)), (2 * i + 1, " ".join([*own, "more"]))]
    got = {r.doc_id: r.n_removed for r in _run(spark, rows).collect()}
    assert got == {i: i % 2 for i in range(10)}


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "\n\n"), (4, "!!!\n???"), (5, "x"), (6, "X."), (None, "y"), (None, None), (7, "y\ny\ny z w")]
    got = {(r.doc_id, r.n_lines): (r.text, r.n_removed) for r in _run(spark, rows).collect()}
    assert got[(1, 0)] == (None, 0) and got[(2, 1)] == ("", 0) and got[(3, 3)] == ("\n\n", 0) and got[(4, 2)] == ("!!!\n???", 0)
    assert got[(5, 1)] == ("x", 0) and got[(6, 1)] == ("", 1) and got[(None, 1)] == ("y", 0) and got[(7, 3)] == ("y z w", 2)
    assert _run(spark, []).collect() == [] and _run(spark, []).columns == ["doc_id", "text", "pos", "line", "n_lines", "n_removed"]


def test_words_of_a_line_are_found_once_and_only_lines_with_room_take_the_wide_counters(spark):
    """No condition repeats the split into words; 241 words need 481 characters in lower case."""
    many = " ".join(chr(0x4E00 + i) for i in range(line_dedup.WIDE + 1))
    dotted = "İ" + "".join(f"{chr(0x4E00 + i)}İ" for i in range(line_dedup.WIDE - 1)) + "z"  # its lower case is longer
    rows = [(1, many), (2, "word " * 80), (3, dotted), (4, "- ! -\n\n?")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    every = line_dedup.line_table(frame, "doc_id", "text")
    assert sorted(r["id"] for r in every.collect()) == [1, 2, 3]
    long_lines = line_dedup.line_table(frame, "doc_id", "text", 2 * line_dedup.WIDE)
    assert sorted((r["id"], len(set(r["words"]))) for r in long_lines.collect()) == [(1, 241), (3, 241)]
    conditions = [line for line in every._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Filter" in line]
    assert conditions and not any("split(lower" in line for line in conditions)


def test_lines_of_few_words_and_very_many_pairs_of_letters(spark):
    """Lines without blanks, or of four to six words, whose pairs of letters need the wide counters."""
    rnd = random.Random(3)

    def run(n):
        return "".join(chr(0x4E00 + rnd.randrange(9_000)) for _ in range(n))

    rows = []
    for one in (run(239), run(240), run(600), "\U00020000" * 3 + run(300), " ".join(run(200) for _ in range(3)), " ".join([run(30) for _ in range(3)] + [run(4_000)]), " ".join(run(60) for _ in range(6)), " ".join([run(40) for _ in range(6)])):
        rows += [(len(rows), one), (len(rows) + 1, one[:50] + "\u9fa0" + one[51:]), (len(rows) + 2, one)]
    got = {r.doc_id: r.n_removed for r in _run(spark, rows).collect()}
    assert got == {i: int(i % 3 > 0) for i in range(len(rows))}


def test_pairs_of_letters_of_long_lines_vote(spark):
    words = {n: ["".join(chr(0x4E00 + i) for i in range(n))] for n in (239, 240, 241, 5_000)}
    frame = spark.createDataFrame(list(words.items()), "n int, words array<string>")
    rows = line_dedup.with_simhash(frame, ["n"], "words").collect()
    assert sorted(r.n for r in spark.createDataFrame([(r.kind,) for r in rows], "n int").collect()) == [line_dedup.LETTERS] * 4
    long_lines = line_dedup.line_table(spark.createDataFrame([(n, own[0]) for n, own in words.items()], "doc_id long, text string"), "doc_id", "text", 2 * line_dedup.WIDE)
    assert sorted(r["id"] for r in long_lines.collect()) == [240, 241, 5_000]
    for row, (n, own) in zip(sorted(rows, key=lambda r: r.features), sorted(words.items()), strict=False):
        assert row.features == min(n + 1, 255)
