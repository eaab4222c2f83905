"""Mixing, media columns, packing and the pipeline."""

import functools
import hashlib
import io
import os
import random
import zlib
from collections import defaultdict
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from foliowork.llm import media, mixing, packing

SCHEMA = "doc_id long, text string, source string, size long, target string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, 5, "t") for i, t, s in rows], SCHEMA)


def words(rows_per_source, seed=1):
    draw = random.Random(seed)
    out = []
    for s, n in rows_per_source.items():
        out += [(len(out) + k, " ".join(draw.choices(["a", "bb", "é"], k=draw.randint(0, 400))), s) for k in range(n)]
    return [(i, t, s) for i, (_, t, s) in enumerate(out)]


def level_targets(sizes, budget=1.5, limit=2):
    """Shares by weight, excess reshared until no source is above its limit."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, left, free = {}, budget * sum(sizes.values()), set(names)
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        above = {s for s in free if share[s] > limit * sizes[s]}
        if not above:
            return target | share
        for s in above:
            target[s] = limit * sizes[s]
            left -= target[s]
        free -= above
    return target


def test_mix_follows_targets(spark):
    rows = words({"b": 300, "a": 40, "ü": 90, None: 60, "c": 1}) + [(900, None, "z"), (901, "", "z"), (902, " \t", None)]
    plan = mixing.mix_plan(docs(spark, rows)).collect()
    assert len(plan) == len(rows)
    sizes, taken, targets = defaultdict(int), defaultdict(int), {}
    for r in plan:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        targets[r.source] = r.target
        assert 0 <= r.taken <= 2 * r.size and r.source_size == sum(len((t or "").split()) for _, t, s in rows if s == r.source)
    for s, t in level_targets(sizes).items():
        assert abs(targets[s] - t) < 1e-6 * max(t, 1)
        assert abs(taken[s] - t) <= max(0.01 * t, 3 * mixing.BLOCK)
    again = mixing.mix_plan(docs(spark, rows[::-1]).repartition(7)).collect()
    assert sorted(map(str, plan)) == sorted(map(str, again))


def test_small_sources_and_short_texts_reach_their_targets(spark):
    rows = [(0, "w " * 7, "a"), (1, "w " * 33, "b"), (2, "w " * 65, "c")]
    rows += [(10 + i, "w" if i % 8 == 0 else "", "d") for i in range(6000)] + [(7000 + i, "w " * 300, "e") for i in range(40)]
    taken, target = defaultdict(int), {}
    for r in mixing.mix_plan(docs(spark, rows)).collect():
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert [taken[s] for s in "abc"] == [target[s] for s in "abc"] == [14, 66, 130]
    assert all(abs(taken[s] - target[s]) <= 2 * mixing.BLOCK for s in "de")


def test_rows_of_one_id_are_dealt_to_many_shards(spark):
    texts = [f"only{k} " * (1 + k % 9) for k in range(2000)]
    rows = [(None, t, "a") for t in texts] + [(k, t, "b") for k, t in enumerate(texts)]
    plan = mixing.mix_plan(docs(spark, rows))
    assert plan.filter("source = 'a'").select("start").distinct().count() > 8  # 16 shards
    got = {r.source: r for r in plan.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.count("*").alias("n")).collect()}
    assert all(abs(r.taken - r.target) < 0.02 * r.target and r.n == 2000 for r in got.values())


def highest_quotients(votes, most, house):
    """The rule itself, seat by seat; of equal quotients the earlier party's."""
    seats = [0] * len(votes)
    for _ in range(house):
        open_ = [i for i in range(len(votes)) if votes[i] and seats[i] < most[i]]
        if open_:
            seats[max(open_, key=lambda i: (Fraction(votes[i], 2 * seats[i] + 1), -i))] += 1
    return seats


def test_seats_go_to_the_highest_quotients():
    draw = random.Random(9)
    for _ in range(300):
        n = draw.randint(1, 12)
        votes = [draw.choice([0, 1, 7, 7, 49, 50, draw.randint(1, 3000)]) for _ in range(n)]
        most = [draw.choice([0, 1, 2, 5, 1000]) for _ in range(n)]
        house = draw.choice([0, 1, 5, 60, sum(most) // 2])
        house = min(house, 400)
        assert mixing.sainte_lague(np.array(votes), np.array(most), house).tolist() == highest_quotients(votes, most, house)


def test_many_sources_and_shards_are_apportioned_in_groups(spark, monkeypatch):
    monkeypatch.setattr(mixing, "FAN", 4)
    monkeypatch.setattr(mixing, "SHARD_ROWS", 3)
    rows = words({f"s{k:02d}": 3 + k for k in range(30)} | {"hot": 300})
    taken, target = defaultdict(int), {}
    for r in mixing.mix_plan(docs(spark, rows)).collect():
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert all(abs(taken[s] - t) <= max(0.02 * t, 4 * mixing.BLOCK) for s, t in target.items())
    assert abs(sum(taken.values()) - sum(target.values())) < 0.01 * sum(target.values())
    assert target == pytest.approx(level_targets({s: sum(len(t.split()) for _, t, x in rows if x == s) for s in target}))


def test_mixed_texts_have_the_words_that_were_taken(spark):
    rows = words({"b": 80, "a": 20, None: 30})
    plan = {r.doc_id: r.taken for r in mixing.mix_plan(docs(spark, rows)).collect()}
    mixed = {r.doc_id: r for r in mixing.mix(docs(spark, rows)).collect()}
    assert {i: n for i, n in plan.items() if n} == {i: len(r.text.split()) for i, r in mixed.items()}
    text = {i: t for i, t, _ in rows}
    assert all(set(r.text.split()) <= set(text[i].split()) and r["size"] == 5 for i, r in mixed.items())
    assert mixing.mix(docs(spark, [])).count() == 0 and mixing.mix_plan(docs(spark, [])).count() == 0
    assert mixing.mix_plan(docs(spark, [(None, "a b", None), (None, "a b", None), (3, None, "x")])).count() == 3


@pytest.mark.parametrize("form", ["pgm", "bmp"])
def test_media_round_trip(spark, form):
    texts = [None, "", "x" * 64, "é" * 77, "a" * 5000, "a" * 5000, "\0" * 3]
    out = media.media_columns(docs(spark, [(i, t, "s") for i, t in enumerate(texts)]), forms=(form, "pgm" if form == "bmp" else "bmp"))
    for r in out.collect():
        raw = (texts[r.doc_id] or "").encode()
        back = np.ascontiguousarray(media.READERS[form](bytes(r.media))).tobytes()
        assert back == raw + bytes(len(back) - len(raw)) and len(back) % 64 == 0 < len(back) <= len(raw) + 64
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]))
        assert r.form_sha256.split(",")[0] == r.media_sha256 and len(r.form_sha256) == 129
        assert (r.media_bytes, r.media_sha256) == (len(r.media), hashlib.sha256(bytes(r.media)).hexdigest())
        assert np.load(io.BytesIO(bytes(r.tile))).shape == (64, 64)
    rows = {r.doc_id: r.feature for r in out.collect()}
    assert rows[4] == rows[5] != rows[2] and rows[0] == rows[1]
    assert media.media_columns(docs(spark, [])).count() == 0


def test_media_query_makes_the_tiles(spark, tmp_path):
    texts = [None, "", "x" * 64, "é" * 77, "ab" * 5000]
    docs(spark, [(i, t, "s") for i, t in enumerate(texts)]).write.parquet(f"{tmp_path}/documents.parquet")
    out = {r.doc_id: r for r in media.op8_media(spark, str(tmp_path)).collect()}
    for i, t in enumerate(texts):
        pixels = np.frombuffer(media.payload_of((t or "").encode()), dtype=np.uint8).reshape(-1, media.WIDTH)
        assert out[i].form_sha256 == ",".join(hashlib.sha256(write(pixels)).hexdigest() for write in (media.write_pgm, media.write_bmp))
        assert out[i].tile_sha256 == hashlib.sha256(media.npy_tile(pixels)).hexdigest() and len(out) == len(texts)


def test_area_resize_and_codecs():
    image = np.arange(12 * 8, dtype=np.uint8).reshape(12, 8)
    assert np.allclose(media.area_resize(image, 6, 4), image.reshape(6, 2, 4, 2).mean((1, 3)))
    assert np.isclose(media.area_resize(image, 5, 3).mean(), image.mean())
    colour = np.random.default_rng(1).integers(0, 255, (5, 7, 3), dtype=np.uint8)
    assert (media.read_netpbm(b"P6 # note\n7 5\n255\n" + colour.tobytes()) == colour).all()
    odd = colour[:, :, 0]
    assert (media.read_bmp(media.write_bmp(odd)) == odd).all()
    for bad in (b"P7\n1 1\n255\n0", b"P5\n1"):
        with pytest.raises(ValueError):
            media.read_netpbm(bad)


@functools.cache
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def encoded(text):
    return [*tokenizer().encode(text or "", add_special_tokens=False).ids, 1]


def test_packing_is_lossless_and_tight(spark):
    draw = random.Random(3)
    texts = [" ".join(draw.choices(["alpha", "beta7", "don't", "naïve", "x"], k=draw.choice([1, 3, 40, 300, 3000]))) for _ in range(150)]
    texts += [None, "", "  \n\n ", "<|endoftext|> a", "日本語 テキスト", "it's\x0b’s", "a" * 40_000]
    rows = packing.pack_sequences(docs(spark, [(i, t, "s") for i, t in enumerate(texts)]).repartition(3)).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        assert r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, dtype="<u4").tobytes())
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for i, t in enumerate(texts):
        own, want = sorted(by_doc[i], key=lambda r: r.start), encoded(t)
        assert [x for r in own for x in r.ids] == want and all(r.doc_tokens == len(want) for r in own)
        assert [r.start for r in own] == [sum(x.length for x in own[:k]) for k in range(len(own))]
    used = padded = 0
    for own in by_sequence.values():
        own.sort(key=lambda r: r.offset)
        total = sum(r.length for r in own)
        assert [r.offset for r in own] == [sum(x.length for x in own[:k]) for k in range(len(own))] and total <= 2048
        used, padded = used + total, padded + (total if total & (total - 1) == 0 else 2048)
    assert used / padded > 0.99
    assert packing.pack_sequences(docs(spark, [])).count() == 0


def test_rank_ids_are_those_of_the_tokenizer_file():
    names = [public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken")]
    fast, slow = packing._encoder(*names), packing._encoder(names[0], None)
    draw = random.Random(6)
    pools = [[chr(c) for c in range(0x260)], [" ", "\n", "\t", "\x0b", "\x85", "\xa0", "a", "1", "'", "s", "²"], ["'s", "'ll", "  ", "\n\n", "don", "½", "ß", "’", "<|endoftext|>", "日"]]
    for k in range(1500):
        text = "".join(draw.choices(pools[k % 3], k=10))
        assert fast(text).tolist() == slow(text).tolist(), text


def test_very_long_runs_are_encoded(spark):
    texts = [" " * 60_000, " " * 1_000_000, "\n" * 1_000_000, " \n\t" * 300_000, "a" * 200_000, "a " + "\n" * 2_000_000 + " b"]
    rows = packing.pack_sequences(docs(spark, [(i, t, "s") for i, t in enumerate(texts)]), with_ids=False).select("doc_id", "doc_tokens").distinct().collect()
    assert {r.doc_id: r.doc_tokens for r in rows} == {i: len(encoded(t)) for i, t in enumerate(texts)}
    names = [public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken")]
    assert packing._encoder(*names)(texts[5]).tolist() == encoded(texts[5])[:-1]


def test_closest_multiset_is_the_best_there_is():
    draw = random.Random(4)
    for _ in range(200):
        counts = {draw.randint(1, 30): draw.randint(1, 3) for _ in range(draw.randint(0, 5))}
        room = draw.randint(0, 70)
        sums = {0}
        for length, n in counts.items():
            sums |= {s + k * length for s in sums for k in range(n + 1) if s + k * length <= room}
        chosen = packing.closest_multiset(room, counts)
        assert sum(k * v for k, v in chosen.items()) == max(sums) and all(v <= counts[k] for k, v in chosen.items())
    assert packing.powers_of_two(1500, 2048) == [1024, 256, 128, 64, 16, 8, 4]


def packed(lengths, capacity=2048):
    """Pieces by sequence of one task's pool, and the tokens of all windows with their padding."""
    packer, pieces = packing._Packer(capacity, 0), []
    for i, n in enumerate(lengths):
        pieces += packer.add(i, np.arange(n, dtype="<u4"))
    pieces += packer.pack(last=True)
    by_doc, by_sequence = defaultdict(list), defaultdict(int)
    for doc, start, ids, n, sequence, offset in pieces:
        assert offset == by_sequence[sequence] and n == lengths[doc] and len(ids)
        by_doc[doc].append((start, ids.tolist()))
        by_sequence[sequence] += len(ids)
    for i, n in enumerate(lengths):
        assert [x for _, own in sorted(by_doc[i]) for x in own] == list(range(n))
    assert max(by_sequence.values()) <= capacity
    return sum(t if t & (t - 1) == 0 else capacity for t in by_sequence.values())


def test_equal_lengths_are_packed_without_much_padding():
    draw = random.Random(8)
    for lengths in ([1200] * 5000, [1025] * 9000, [1200 if k % 3 else draw.randint(1, 2500) for k in range(9000)], [1] * 9000):
        assert packed(lengths) <= 1.02 * sum(lengths)
    assert packed([1] * 9000, capacity=8192) <= 1.02 * 9000


def test_pipeline_stages_on_a_small_corpus(spark, tmp_path):
    import corpus_pipeline

    draw = random.Random(5)
    prose = lambda k: " ".join(draw.choice(["stone", "river", "green", "walks", "light", "over", "fields", "and"]) + str(draw.randint(0, 99)) for _ in range(k))
    rows, labels = [], []
    for i in range(160):
        good = i % 4 > 0
        body = prose(80) if good else " ".join(w + "$$$" for w in prose(60).split())
        rows.append((i, "All rights reserved.\n" + body, "en", f"s{i % 3}", 0))
        labels.append((i, int(good), 0))
    rows += [(200 + k, rows[k + 1][1] + " tail", "en", "s0", 0) for k in range(0, 12, 4)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs_now, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs_now, str(tmp_path))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs_now.columns, name
        out.write.parquet(f"{tmp_path}/out-{k}")
        docs_now = spark.read.parquet(f"{tmp_path}/out-{k}")
        seen.append(docs_now.collect())
    bad = {i for i in range(160) if i % 4 == 0}
    ids = [{r.doc_id for r in s} for s in seen]
    assert ids[0] == {r[0] for r in rows} - bad
    assert all("All rights" not in r.text and r.n_chars == len(r.text) for r in seen[1]) and ids[1] == ids[0]
    assert ids[2] == ids[1] - {200, 204, 208}
    assert sum(len(r.text.split()) for r in seen[3]) == pytest.approx(1.5 * sum(len(r.text.split()) for r in seen[2]), rel=0.02)
    text = {r.doc_id: r.text for r in seen[3]}
    assert {r.doc_id: r.doc_tokens for r in seen[4]} == {i: len(encoded(t)) for i, t in text.items()}
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(seen[4])
    assert os.path.isdir(tmp_path)


def test_pipeline_stages_take_odd_tables(spark, tmp_path):
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long, _kept string, score double, size string, first long"
    rows = [(k, None if k % 5 == 0 else "" if k % 5 == 1 else f"line one\nwords of {k % 3} here and there", None, None if k % 2 else "s", None, "x", 9.5, "y", 3) for k in range(15)]
    rows += [(None, "no id at all here", None, None, None, "x", 9.5, "y", 3)] * 2 + [(14, rows[14][1], *rows[14][2:])]
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, table in (("odd", rows), ("empty", [])):
        docs_now = spark.createDataFrame(table, schema)
        for k, (stage_name, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs_now, str(tmp_path))
            assert stage_name == "packing" or out.columns == docs_now.columns
            out.write.parquet(f"{tmp_path}/{name}-{k}")
            docs_now = spark.read.parquet(f"{tmp_path}/{name}-{k}")
            assert stage_name == "packing" or all((r._kept, r.score, r["size"], r["first"]) == ("x", 9.5, "y", 3) for r in docs_now.collect())
        assert (docs_now.count() > 0) == bool(table)
