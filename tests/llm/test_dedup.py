"""Line, exact, near and suffix deduplication against plain Python."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from foliowork.llm.exact import exact_groups
from foliowork.llm.lines import LineRuns, count_batches, dedup_lines
from foliowork.llm.neardup import drop_near_duplicates, near_groups
from foliowork.llm.repeats import contexts, merge_ranges, remove_repeats
from foliowork.llm.shared import shared_folder
from foliowork.llm.shingles import shingle_sets
from foliowork.llm.suffixes import _by_doubling, permuted_common_prefixes, repeated_starts, suffix_array

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, n long, digest string"
WORDS = [f"w{i}é" if i % 7 == 0 else f"word{i}" for i in range(400)]


def table(spark, texts, ids=None):
    """Rows with extra columns whose names the operators use inside."""
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "s", 1, "k", 2, "d") for i, t in zip(ids, texts, strict=True)], SCHEMA)


def corpus(seed, n=60):
    """Texts with exact copies, near copies, shared lines and passages, nulls, empties, and a long one."""
    draw = random.Random(seed)
    prose = lambda k: " ".join(draw.choices(WORDS, k=k))
    line, passage = "Shared  LINE of all\t", prose(60)
    texts = [None, "", " \n\t", "one", "one two three four", prose(9000)]
    for _ in range(n):
        texts.append("\n".join(draw.choices([prose(draw.randint(1, 80)), line, "", passage], k=draw.randint(1, 6))))
    base = prose(120).split()
    for _ in range(25):
        copy = list(base)
        for _ in range(draw.randint(0, 12)):
            copy[draw.randrange(len(copy))] = draw.choice(WORDS)
        texts.append(" ".join(copy))
    texts += draw.choices(texts, k=12)
    texts += [(t or "").replace(" ", "  ").upper() for t in draw.choices(texts, k=5)]
    return texts


SPACE = re.compile(r"[\x20\x09-\x0D]")


def lower(t):
    return t.translate({i: i + 32 for i in range(65, 91)})


def test_line_dedup_is_the_plain_rule(spark):
    texts = corpus(1)
    key = lambda x: lower(x).strip(" \t\n\x0b\x0c\r")
    held = Counter(k for t in texts for k in {key(x) for x in (t or "").split("\n")} if k)
    rows = {r.doc_id: r for r in dedup_lines(table(spark, texts)).collect()}
    for i, t in enumerate(texts):
        own = (t or "").split("\n")
        kept = [x for x in own if held[key(x)] < 10]
        assert (rows[i].text, rows[i].n_lines, rows[i].n_dropped, rows[i].digest) == ("\n".join(kept), len(own), len(own) - len(kept), "d")
    assert any(r.n_dropped for r in rows.values())


def test_line_runs_count_over_batches_compact_and_open_again(spark):
    folder = shared_folder(spark, "t")
    runs = LineRuns(spark, folder, min_docs=3, fan_in=2)
    for k, texts in enumerate((["a\nb"], ["a\nc"], ["a"], ["b\nc"], ["d"], ["a\nd"])):
        runs.add(count_batches(table(spark, texts), "doc_id", "text", 1).select("key", "n"))
        if k == 4:
            assert [len(x) for x in runs.levels] == [1, 0, 1]
            runs.close()  # as if by another driver, later
            runs = LineRuns(spark.newSession(), folder, min_docs=3, fan_in=2)
            assert [len(x) for x in runs.levels] == [1, 0, 1]
    counts = {bytes(r.key): r.n for r in runs.spark.table(runs.levels[2][0][0]).collect()}
    assert counts == {hashlib.md5(x.encode()).digest(): n for x, n in (("a", 3), ("b", 2), ("c", 2))}
    assert {bytes(r.key) for r in runs.settled().collect()} == {hashlib.md5(b"a").digest()}
    plan = runs.spark.table(runs._runs()[0][0]).join(runs.spark.table(runs._runs()[0][0]).hint("merge"), "key", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan  # runs meet as they lie
    runs.close()


def test_line_runs_open_again_after_broken_writes(spark):
    folder = shared_folder(spark, "t")
    counts = lambda texts: count_batches(table(spark, texts), "doc_id", "text", 1).select("key", "n")
    runs = LineRuns(spark, folder, min_docs=3, fan_in=2)
    runs.add(counts(["a\nb"]))
    runs.close()
    # A run of level 0 and a compaction that both broke off: files without the mark of a whole write.
    for name in (f"run-0-2-{runs.buckets}", f"run-1-3-{runs.buckets}"):
        counts(["x"]).write.parquet(f"{folder}/{name}")
        where = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}/_SUCCESS")
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    runs = LineRuns(spark, folder, min_docs=3, fan_in=2)
    assert [len(x) for x in runs.levels] == [1] and runs.number == 3
    for texts in (["a"], ["a\nc"]):
        runs.add(counts(texts))
    assert {bytes(r.key) for r in runs.settled().collect()} == {hashlib.md5(b"a").digest()}
    runs.close()


CLASH = "doc_id long, text string, _id string, _text string, _dropped string, _kept string, id string, row string, own string, kept string, dropped string, place string, source string"


@pytest.mark.parametrize("operator", [dedup_lines, drop_near_duplicates])
def test_columns_pass_through_whatever_their_names(spark, operator):
    names = [x.split()[0] for x in CLASH.split(", ")][2:]
    df = spark.createDataFrame([(i, f"common\nown line {i} of five words", *names) for i in range(12)] + [(20, None, *names), (None, "common\nx", *names)], CLASH)
    out = operator(df).collect()
    assert len(out) == 14 and all([r[n] for n in names] == names for r in out)
    if operator is dedup_lines:
        assert {r.text for r in out} == {*(f"own line {i} of five words" for i in range(12)), "", "x"}


def test_a_document_may_lose_very_many_lines(spark):
    long = "\n".join(f"line {i}" for i in range(20_000))
    rows = dedup_lines(table(spark, [long] * 10 + ["line 7\nmine"])).collect()
    assert {(r.text, r.n_dropped) for r in rows} == {("", 20_000), ("mine", 1)}


def test_exact_groups_are_equal_texts(spark):
    texts = corpus(2) + ["x" * 64, "x" * 64, "x" * 65, "x" * 128, " x" * 128]
    groups = defaultdict(list)
    for i, t in enumerate(texts):
        groups[SPACE.sub("", t or "")].append((-len(t or ""), i))
    rows = {r.doc_id: r for r in exact_groups(table(spark, texts)).collect()}
    assert len(rows) == len(texts)
    for norm, members in groups.items():
        keep = min(members)[1]
        for _, i in members:
            assert tuple(rows[i])[1:] == (keep, len(members), i == keep, hashlib.sha256(norm.encode()).hexdigest())


def components(texts):
    sets = []
    for t in texts:
        w = [x for x in SPACE.split(lower(t or "")) if x]
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return sets, [find(i) for i in range(len(texts))]


@pytest.mark.parametrize("seed", [3, 4])
def test_near_groups_are_the_components_of_all_pairs(spark, seed):
    texts = corpus(seed)
    sets, root = components(texts)
    rows = {r.doc_id: r for r in near_groups(table(spark, texts)).collect()}
    assert [(rows[i].n_shingles, rows[i].component_id, rows[i].kept) for i in range(len(texts))] == [(len(sets[i]), root[i], root[i] == i) for i in range(len(texts))]
    kept = {r.doc_id for r in drop_near_duplicates(table(spark, texts)).collect()}
    assert kept == {i for i in range(len(texts)) if root[i] == i}


def test_shingles_do_not_run_across_texts():
    texts = ["a b c", "d e f g h i", "", "a b c"]
    data = "".join(texts).encode()
    sets = shingle_sets(np.frombuffer(data, dtype=np.uint8), np.cumsum([0, *(len(t) for t in texts)]))
    assert [len(s) for s in sets] == [1, 2, 0, 1] and sets[0] == sets[3]


def test_mirrored_words_are_different_words(spark):
    word = "a"
    while len(word) < 1024:  # a word and its mirror image, whose polynomial hashes modulo 2 ** 64 are equal
        word += word.translate(str.maketrans("ab", "ba"))
    mirror = word.translate(str.maketrans("ab", "ba"))
    rows = near_groups(table(spark, [word, mirror, word.upper(), f"{word} x y z u v", f"{mirror} x y z u v"])).collect()
    assert {r.doc_id: r.component_id for r in rows} == {0: 0, 1: 1, 2: 0, 3: 3, 4: 4}


def naive_repeats(texts, length=200):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        cover = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                cover[i : i + length] = b"\1" * length
        runs = sum(c and (not i or not cover[i - 1]) for i, c in enumerate(cover))
        out.append((len(d), sum(cover), runs, bytes(x for x, c in zip(d, cover, strict=True) if not c)))
    return out


@pytest.mark.parametrize("seed", [5, 6])
def test_repeats_are_the_plain_rule(spark, seed, monkeypatch):
    monkeypatch.setattr("foliowork.llm.repeats.CHUNK", 700 if seed == 5 else 1 << 18)  # long texts are cut into parts
    texts = corpus(seed, 30) + ["ab" * 300, "é" * 150, ("abc" * 40 + "xyz") * 6, "q" * 199, "q" * 199]
    rows = {r.doc_id: r for r in remove_repeats(table(spark, texts)).collect()}
    for i, (n, removed, spans, kept) in enumerate(naive_repeats(texts)):
        assert (rows[i].n_bytes, rows[i].n_removed, rows[i].n_spans, bytes(rows[i].kept), rows[i].kept_sha256) == (n, removed, spans, kept, hashlib.sha256(kept).hexdigest()), i


def test_suffix_arrays_and_contexts():
    draw = random.Random(7)
    for _ in range(200):
        s = [draw.randint(1, draw.choice([1, 2, 3, 9])) for _ in range(draw.randint(0, 50))] * draw.choice([1, 1, 3]) + [0]
        assert suffix_array(np.array(s)).tolist() == sorted(range(len(s)), key=lambda i: s[i:])
        order = sorted(range(len(s)), key=lambda i: s[i:])
        assert _by_doubling(np.array(s)).tolist() == order
        text, most = np.array(s, dtype=np.uint8), 12
        before, plcp = permuted_common_prefixes(text, np.array(order), most, np.arange(len(s)) <= len(s) - most)
        for a, b in zip(order, order[1:], strict=False):
            same = next((k for k in range(most) if s[a + k : a + k + 1] != s[b + k : b + k + 1]), most) if max(a, b) <= len(s) - most else 0
            assert (before[b], plcp[b]) == (a, same)
    assert [x.tolist() for x in repeated_starts([b"abcabcabcX", b"", b"cabcabca"], 8)] == [[], [], []]
    assert [x.tolist() for x in repeated_starts([b"12345678z", b"y12345678"], 8)] == [[0], [1]]
    assert merge_ranges([(5, 9), (0, 3), (3, 4), (8, 12)]) == [(0, 4), (5, 12)]
    data = bytes(draw.choices(b"abcdef", k=900))
    anchor, _, text, first, span = contexts(np.frombuffer(data + data[:450], dtype=np.uint8), np.array([0, 900, 1100, 1350]))
    starts = sorted((t, x) for t, f, s in zip(text.tolist(), first.tolist(), span.tolist(), strict=True) for x in range(f, f + s + 1))
    assert starts == [(0, i) for i in range(701)] + [(1, 0)] + [(2, i) for i in range(51)]  # every string is in one context
    assert len(anchor) == len(first)


@pytest.mark.parametrize("operator", [dedup_lines, exact_groups, near_groups, remove_repeats])
def test_edge_tables(spark, operator):
    empty = operator(table(spark, []))
    assert empty.count() == 0
    odd = table(spark, ["same text " * 40, "same text " * 40, None, "x", "x"], ids=[None, 7, None, 3, 3])
    assert operator(odd).count() == 5
    assert operator(table(spark, [None] * 12)).count() == 12
