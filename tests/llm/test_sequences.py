"""BPE by forced boundaries, Merkle manifests and periodic runs, against the library and plain Python."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from foliowork.llm import bpe, merkle, runs

FILE = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ids string, decoded string, tree string, pos string, n string, digest string, runs string, part string"


def table(spark, rows):
    """Rows of (doc_id, text, lang) with columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, g, "s", None if t is None else len(t), "i", "d", "t", "p", "n", "g", "r", "q") for i, t, g in rows], SCHEMA)


def odd_texts():
    draw = random.Random(11)
    plain = [chr(c) for c in range(bpe.PLAIN)]
    texts = [None, "", " ", "\x00\x1c\x7f\x85\xa0", "a" * 3000, "ab" * 3000, "<|endoftext|>A<|startoftext|> b<|ENDOFTEXT|>", "don''s 12x's İ", "Ǳ é ﬁ Ω 日本語テキスト🙂🙂", "x" * 50 + "́" * 50]
    texts += ["".join(draw.choices(plain, k=60)) for _ in range(150)]
    texts += ["".join(draw.choices("abcdefghilmnorstu 'VE19.!-\n", k=80)) for _ in range(150)]
    texts += ["".join(chr(draw.choice([draw.randrange(0x3000), draw.randrange(0x4E00, 0x9FFF), draw.randrange(0x1F300, 0x1F9FF), 0x301, 0x20])) for _ in range(40)) for _ in range(100)]
    return texts


def test_bpe_is_the_library(spark, monkeypatch):
    library, texts = Tokenizer.from_file(FILE), odd_texts()
    rows = {r.doc_id: r for r in bpe.decode_ids(bpe.encode_texts(table(spark, [(k, t, "g") for k, t in enumerate(texts)]))).collect()}
    for k, text in enumerate(texts):
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert (list(rows[k].ids), rows[k].decoded) == (ids, library.decode(ids, skip_special_tokens=False)), repr(text)
    own = bpe.Bpe(FILE)
    monkeypatch.setattr(bpe, "SLICE", 7)  # slices are cut at spaces, whatever their size
    monkeypatch.setattr(bpe, "LONG", 3)  # the queue and the plain way merge alike
    monkeypatch.setattr(bpe, "MEMO", 5)
    for text in texts[1:]:
        assert own.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_cuts_are_where_no_token_reaches():
    own = bpe.Bpe(FILE)
    token_pairs = set()
    for token in list(own.tokens)[:-2]:
        whole = bytes(own.byte[c] for c in token.removesuffix("</w>"))
        token_pairs |= {(a, b, token.endswith("</w>") and k == len(whole) - 2) for k, (a, b) in enumerate(zip(whole, whole[1:]))}
    draw = random.Random(3)
    for _ in range(300):
        piece = bytes(draw.choices(b"abcqxz\xc3\xa9\xe6\x97", k=draw.randint(2, 40)))
        last = len(piece) - 2
        assert own.cuts(piece) == [k + 1 for k, (a, b) in enumerate(zip(piece, piece[1:])) if (a, b, k == last) not in token_pairs]
        fragments = [piece[a:b] for a, b in zip([0, *own.cuts(piece)], [*own.cuts(piece), len(piece)])]
        ids = [own.inner[x] for x in piece[:-1]] + [own.last[piece[-1]]]
        assert own.encode_piece(piece) == own.merge(ids) and b"".join(fragments) == piece  # the same as without cuts


def test_bpe_edges(spark):
    rows = [(None, "two words", "g"), (1, "two words", "g"), (1, "two words", "g"), (2, None, None), (3, " the " * 200_000, "g")]
    got = bpe.decode_ids(bpe.encode_texts(table(spark, rows))).collect()
    assert sorted(len(r.ids) for r in got) == [0, 2, 2, 2, 200_000] and {r.decoded for r in got if len(r.ids) == 2} == {"two</w> words</w>"}
    ids = spark.createDataFrame([(1, [320, None, -1, 10**9], "x"), (2, None, "x"), (3, [], "x")], "id long, ids array<int>, decoded string")
    assert {r.id: (r.decoded, r.ids) for r in bpe.decode_ids(ids).collect()} == {1: ("a</w>", [320, None, -1, 10**9]), 2: ("", None), 3: ("", [])}
    empty = bpe.decode_ids(bpe.encode_texts(table(spark, [])))
    assert empty.count() == 0 and empty.columns == ["doc_id", "ids", "decoded"]
    with pytest.raises(ValueError, match="layout"):
        bpe.Bpe(public_tokenizers.path("byte_bpe_50k.json"))


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_tree(leaves):
    """The top digest, and for each leaf its siblings as (digest, whether on the left), None where there is none."""
    proofs, at, level = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(level) > 1:
        for k, p in enumerate(at):
            other = p ^ 1
            proofs[k].append((level[other], other < p) if other < len(level) else None)
        level, at = [H(*level[k : k + 2]) for k in range(0, len(level), 2)], [p // 2 for p in at]
    return level[0], proofs


@pytest.mark.parametrize(("levels", "seed"), [(8, 1), (1, 2), (2, 3)])
def test_proofs_are_those_of_the_plain_tree(spark, levels, seed, monkeypatch):
    monkeypatch.setattr(merkle, "LEVELS", levels)
    draw = random.Random(seed)
    rows = [(k, f"t{k}", g) for k, g in enumerate(["en"] * 37 + ["fr"] * 16 + [None] * 3 + ["é"] + ["z"] * 2)]
    rows += [(5, "t5", "en"), (5, "other", "en"), (None, None, "en"), (None, "x", "fr"), (7, "t7", "en")]
    draw.shuffle(rows)
    own = table(spark, rows).withColumn("leaf", merkle.leaf_digest([F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), F.col("text")]))
    value = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda i, t, g: H(*map(value, (i, "s", g, None if t is None else len(t), t)))
    groups = {g: sorted(((i is not None, i or 0, leaf(i, t, g)) for i, t, x in rows if x == g)) for g in {x for _, _, x in rows}}
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: plain_tree([x[2] for x in groups[g]]) for g in order}
    root, upper = plain_tree([trees[g][0] for g in order])
    expected = []
    for g, above in zip(order, upper):
        for (there, i, digest), proof in zip(groups[g], trees[g][1]):
            expected.append((i if there else None, digest, trees[g][0], root, tuple("" if x is None else ("L" if x[1] else "R") + x[0] for x in proof + above)))
    got = merkle.merkle_proofs(own, "lang", "doc_id", "leaf", keep=("text", "digest", "tree")).withColumn("folded", merkle.fold_proof(F.col("leaf"), F.col("proof"))).collect()
    assert sorted([(r.doc_id, r.leaf, r.subroot, r.root, tuple(r.proof)) for r in got], key=str) == sorted(expected, key=str)
    assert all(r.folded == root and (r.digest, r.tree) == ("g", "t") for r in got) and len(got) == len(rows)


def test_tampered_leaves_do_not_verify_and_small_tables(spark, tmp_path):
    rows = [(k, f"text {k}", "en" if k % 3 else None) for k in range(60)] + [(100, None, "de")]
    table(spark, rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in merkle.op12_merkle(spark, str(tmp_path)).collect()}
    import zlib

    for k, r in got.items():
        assert r.verified == (zlib.crc32(str(k).encode()) % 7 != 0 or k == 100) and (r.folded_root == r.root) == r.verified
    one = table(spark, [(4, "x", None)]).withColumn("leaf", F.lit("ab"))
    assert [(r.leaf, r.subroot, r.root, r.proof) for r in merkle.merkle_proofs(one, "lang", "doc_id", "leaf").collect()] == [("ab", "ab", "ab", [])]
    empty = merkle.merkle_proofs(one.filter("doc_id < 0"), "lang", "doc_id", "leaf")
    assert empty.count() == 0 and empty.columns == ["doc_id", "leaf", "subroot", "root", "proof"]


def plain_runs(words, periods=4, least=6):
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, periods * q):
                found.setdefault((i, j + q - i), q)
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def repetitive(draw):
    words, kinds = [], draw.choice([1, 2, 2, 3, 5])
    for _ in range(draw.randint(0, 8)):
        unit = draw.choices(range(kinds), k=draw.randint(1, 14))
        words += (unit * draw.randint(1, 8))[: draw.randint(1, 200)]
    return words


def coded(words):
    return [str(w).encode() for w in words]


def test_runs_are_all_maximal_repetitions(monkeypatch):
    draw = random.Random(13)
    for _ in range(150):
        texts = [repetitive(draw) for _ in range(draw.randint(1, 4))]
        assert runs.runs_of([coded(w) for w in texts]) == [plain_runs(w) for w in texts]
        words, finder, at = repetitive(draw), runs.RunFinder(), 0
        while at < len(words):  # appended in any pieces
            n = draw.randint(1, 20)
            finder.append(np.array(words[at : at + n]))
            at += n
        assert finder.finish() == plain_runs(words)
    monkeypatch.setattr(runs, "_joined", lambda a, b: (a + b) & np.uint64(3))  # fingerprints decide nothing
    monkeypatch.setattr(runs, "APPEND", 16)
    for _ in range(100):
        words = repetitive(draw)
        assert runs.runs_of([coded(words)]) == [plain_runs(words)]
    with pytest.raises(ValueError, match="periods"):
        runs.RunFinder(periods=3)


def test_the_query_plants_and_collapses_runs(spark, tmp_path):
    import zlib

    draw = random.Random(17)
    texts = {k: "\n".join(draw.choices(["a", "b é", "c\x0bd", "", "e"], k=draw.randint(0, 150))) for k in range(300)} | {300: None, 301: "", 302: "w " * 50_000}
    table(spark, [(k, t, "g") for k, t in texts.items()]).select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in runs.op13_periodic_runs(spark, str(tmp_path)).collect()}
    sha = lambda data: hashlib.sha256(data).hexdigest()
    for k, text in texts.items():
        words, h = (text or "").encode().split(), zlib.crc32(str(k).encode())
        g, n = h // 10, len(words)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        own = [(0, n, 1)] if k == 302 and h % 10 else plain_runs(words)
        best = max(own, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None, None, None))
        dropped = {i for s, m, q in own for i in range(s + q, s + m)}
        milli = best[0] if best[0] is None else 1000 * best[1] // best[2]
        expected = (len(own), *best, milli, sha("".join(f"{s},{m},{q}\n" for s, m, q in own).encode()), sha(b" ".join(w for i, w in enumerate(words) if i not in dropped)))
        r = got[k]
        assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256) == expected, k


def test_run_edges(spark):
    rows = [(None, "x y " * 4, "g"), (1, "x y " * 4, "g"), (1, "x y " * 4, "g"), (2, None, None), (3, "", "g"), (4, "a a a a a", "g"), (5, "a a " * 6, "g")]
    got = sorted(((r.doc_id, [tuple(x) for x in r.runs], r.strongest and tuple(r.strongest), r.collapsed) for r in runs.periodic_runs(table(spark, rows)).collect()), key=str)
    pair = ([(0, 8, 2)], (0, 8, 2), "x y")
    assert got == sorted([(None, *pair), (1, *pair), (1, *pair), (2, [], None, ""), (3, [], None, ""), (4, [], None, "a a a a a"), (5, [(0, 6, 1)], (0, 6, 1), "a a")], key=str)
    empty = runs.periodic_runs(table(spark, []))
    assert empty.count() == 0 and empty.columns == ["doc_id", "runs", "strongest", "collapsed"]
