"""Operators 3, 4, 5, 8 and 9 and the pipeline: edge cases and plain-Python comparisons."""
from __future__ import annotations

import collections
import random
import zlib

import numpy as np
import pytest

import corpus_pipeline
from credlake.llm import catalogue, decontaminate, jaccard_join, packing, sharding, token_rollup, words
from credlake.session import work_dir
from tests.llm import helpers
from tests.llm.helpers import DOCS, rows_of

SF = "/root/testdata/sf0.001"


def test_word_hasher_agrees_with_words_across_slices(monkeypatch):
    monkeypatch.setattr(words, "SLICE", 64)
    draw = random.Random(5)
    texts = ["", " ", "a", "été É", "x" * 500, "same words same WORDS", "-".join("abc" for _ in range(40))]
    texts += ["".join(draw.choice("ab-é \n1") for _ in range(draw.randint(0, 200))) for _ in range(60)]
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    hashes, _, first = words.WordHasher(words.ALNUM)(data, np.cumsum([0] + [len(r) for r in raw]))
    by_word = {}
    for k, t in enumerate(texts):
        mine = helpers.words(t)
        assert first[k + 1] - first[k] == len(mine)
        for w, h in zip(mine, hashes[first[k]:first[k + 1]]):
            assert by_word.setdefault(w, h) == h
    assert len(set(by_word.values())) == len(by_word)


# ---- 3: Jaccard join ----

def near_family(draw, base, copies, changes):
    out = []
    for _ in range(copies):
        w = list(base)
        for _ in range(changes):
            w[draw.randrange(len(w))] = f"new{draw.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_jaccard_components_of_families_chains_and_edges(spark):
    draw = random.Random(11)
    word = lambda: f"w{draw.randrange(400)}"
    texts = []
    for _ in range(6):
        base = [word() for _ in range(draw.randint(30, 120))]
        for changes in (0, 1, 1, 2, 3, 4):
            texts += near_family(draw, base, 6, changes)
    passage = " ".join(word() for _ in range(60))
    texts += [passage + " " + " ".join(word() for _ in range(draw.randint(5, 80))) for _ in range(40)]
    chain = [word() for _ in range(80)]
    for _ in range(12):  # each like the one before, the ends unlike
        chain = chain[4:] + [word() for _ in range(4)]
        texts.append(" ".join(chain))
    texts += ["a b c d", "A B c D", "a b c", "one", "", None, " \n\t", "tab\tone", "x " * 200_000]
    rows = [(k * 7 % 1009, t) for k, t in enumerate(texts)]
    frame = spark.createDataFrame([(*r, 1, "k") for r in rows], DOCS + ", n int, key string")
    out = jaccard_join.jaccard_components(frame).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out} == helpers.jaccard_components(rows)
    assert len(out) == len(rows)


def test_jaccard_small_buckets_repeats_and_empty(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BUCKET_SHINGLES", 2000)
    rows = rows_of(SF, "documents", "doc_id, text")
    out = jaccard_join.jaccard_components(spark.createDataFrame(rows + rows[:5], DOCS)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out} == helpers.jaccard_components(rows)
    assert len(out) == len(rows) + 5
    assert jaccard_join.jaccard_components(spark.createDataFrame([], DOCS)).count() == 0


def test_jaccard_hot_shingles_and_copies_do_not_meet_in_one_bucket(spark, monkeypatch):
    shared, most = jaccard_join._shared, 900

    def bounded(table):
        entries = sum(len(t) // 6 for t in table.column("tokens").to_pylist())
        assert entries <= most, entries
        return shared(table)

    monkeypatch.setattr(jaccard_join, "_shared", bounded)
    monkeypatch.setattr(jaccard_join, "BUCKET_SHINGLES", 500)
    rows = [(i, "one passage of every text here " + " ".join(f"w{i}x{j}" for j in range(3))) for i in range(1200)]
    rows += [(5000 + i, "the very same text given again and again") for i in range(1200)]
    out = jaccard_join.jaccard_components(spark.createDataFrame(rows, DOCS).repartition(2)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out} == helpers.jaccard_components(rows)


def test_overlap_stops_early_but_is_exact_when_reached():
    draw = np.random.default_rng(1)
    for _ in range(200):
        a, b = (draw.choice(300, draw.integers(1, 200), replace=False).astype(np.uint64) for _ in range(2))
        true = len(np.intersect1d(a, b))
        needed = int(draw.integers(1, 150))
        got = jaccard_join.overlap(a, np.sort(b), needed, step=8)
        assert got == true if true >= needed else got < needed


# ---- 4: token rollup ----

def test_rollup_batches_are_idempotent_and_signed(spark):
    root = work_dir(spark, "rollup-test")
    cols = "op string, source string, lang string, tokenizer string, tokens long, bytes long, old_source string, old_lang string, " \
           "old_tokenizer string, old_tokens long, old_bytes long, docs long"
    frame = lambda rows: spark.createDataFrame(rows, cols)
    first = frame([("insert", "a", "en", "v1", 10, 50, None, None, None, None, None, 9), ("insert", "a", "en", "v1", 5, 20, None, None, None, None, None, 9),
                   ("insert", None, None, "v1", None, None, None, None, None, None, None, 9), ("insert", "b", "en", "v1", 7, 9, None, None, None, None, None, 9)])
    second = frame([("revise", "a", "fr", "v1", 6, 21, "a", "en", "v1", 5, 20, 9), ("delete", None, None, None, None, None, "b", "en", "v1", 7, 9, 9)])
    token_rollup.commit(first, root, "1")
    token_rollup.commit(second, root, "2")
    expected = {("a", "en", "v1", 1, 10, 50), ("a", "fr", "v1", 1, 6, 21), (None, None, "v1", 1, 0, 0)}
    assert {tuple(r) for r in token_rollup.totals(spark, root).collect()} == expected
    token_rollup.commit(second, root, "2")
    token_rollup.commit(first, root, "1")
    token_rollup.commit(frame([]), root, "3")
    assert {tuple(r) for r in token_rollup.totals(spark, root).collect()} == expected
    text = spark.createDataFrame([(None,), ("",), ("a  b,c\n",)], "t string")
    counts = text.select(*(token_rollup.count_tokens(text["t"], n) for n in token_rollup.TOKENIZERS)).collect()
    assert [tuple(r) for r in counts] == [(0, 0), (0, 0), (2, 4)]


# ---- 5: decontamination ----

def test_contamination_matches_brute_force(spark):
    draw = random.Random(2)
    word = lambda: draw.choice("the of and to in on a is it".split()) if draw.random() < 0.5 else f"w{draw.randrange(60)}"
    items = [(k, " ".join(word() for _ in range(draw.randint(1, 30)))) for k in range(25)]
    items += [(100, "Été, déjà-VU!"), (101, "rare2"), (102, "rare3 rare4"), (103, ""), (104, None), (105, "--"), (200, items[3][1]), (3, items[3][1])]
    docs = []
    for k in range(120):
        parts = []
        for _ in range(draw.randint(0, 6)):
            w = (draw.choice(items)[1] or "").split()
            lo = draw.randint(0, max(0, len(w) - 10))
            parts.append(" ".join(draw.choice([w, w[lo:lo + draw.randint(8, 12)], [word() for _ in range(12)]])))
        docs.append((k, "\n".join(parts)))
    docs += [(500, None), (501, ""), (502, "..."), (503, "x été déjà vu"), (504, "rare3 rare2 RARE3-rare4"), (505, " ".join([items[0][1]] * 5000))]
    out = decontaminate.contamination(spark.createDataFrame([(*d, "x") for d in docs], DOCS + ", token string"),
                                      spark.createDataFrame(items, "item_id long, text string")).collect()
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in out}
    assert len(out) == len(docs) and got == helpers.contamination(docs, items)
    twice = decontaminate.report(spark.createDataFrame([(1, "rare2"), (1, "rare2"), (1, "no")], DOCS),
                                 spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted(r["n_hit"] for r in twice) == [0, 1, 1]
    empty = decontaminate.report(spark.createDataFrame([(1, "rare2")], DOCS), spark.createDataFrame([], "item_id long, text string")).collect()
    assert empty[0]["contaminated"] is False and empty[0]["n_items"] == 0
    assert decontaminate.report(spark.createDataFrame([], DOCS), spark.createDataFrame(items, "item_id long, text string")).count() == 0


# ---- 8: packing ----

def encoder():
    import public_tokenizers as public
    return packing.CachedEncoder(public.path("byte_bpe_50k.json"), public.path("byte_bpe_50k.tiktoken"), public.PATTERN)


def test_cached_encoder_equals_the_tokenizer(monkeypatch):
    monkeypatch.setattr(packing, "CACHE_ENTRIES", 500)
    mine, draw = encoder(), random.Random(8)
    texts = [t for _, t in rows_of(SF, "documents", "doc_id, text")]
    texts += ["", " ", "  two  spaces ", "\n\na\n b\t c \n", "<|endoftext|> x<|endoftext|>", "a\x1cb \x1f c", "it's 12½ x²", " nbsp em", "a" * 5000, "日本語 テキスト"]
    texts += ["".join(draw.choice(" \n\tab'1,é") for _ in range(draw.randint(0, 60))) for _ in range(300)]
    for t in texts:
        assert np.frombuffer(mine(t), "<u2").tolist() == mine.whole.encode(t, add_special_tokens=False).ids, t


def check_packing(rows, out, capacity=2048):
    tokens = {d: np.r_[np.frombuffer(ENC(t or ""), "<u2"), 1].astype("<u4") for d, t in rows}
    at = collections.Counter()
    for r in sorted(out, key=lambda r: (r["doc_id"], r["start"])):
        ids = tokens[r["doc_id"]][r["start"]:r["start"] + r["length"]]
        assert r["start"] == at[r["doc_id"]] and len(ids) == r["length"] and r["doc_tokens"] == len(tokens[r["doc_id"]])
        assert r["ids_crc32"] == zlib.crc32(ids.tobytes())
        at[r["doc_id"]] += r["length"]
    assert at == {d: len(t) for d, t in tokens.items()}
    end = collections.Counter()
    for r in sorted(out, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == end[r["sequence_id"]]
        end[r["sequence_id"]] += r["length"]
    assert not end or max(end.values()) <= capacity
    return sum(end.values()) / (capacity * max(1, len(end)))


ENC = encoder()


def test_packing_round_trip(spark):
    rows = rows_of(SF, "documents", "doc_id, text")
    rows += [(9001, None), (9002, ""), (9003, "word " * 60_000), (9004, "x"), (9005, "x")]
    frame = spark.createDataFrame([(*r, "z") for r in rows], DOCS + ", ids string")
    assert check_packing(rows, catalogue.packed_documents(frame).collect()) > 0.97
    assert catalogue.packed_documents(spark.createDataFrame([], DOCS)).count() == 0
    assert catalogue.packed_documents(spark.createDataFrame([(1, "a"), (1, "a")], DOCS)).count() == 2
    import public_tokenizers as public
    pieces = packing.packed(spark.createDataFrame(rows[:40], DOCS), public.path("byte_bpe_50k.json"), public.path("byte_bpe_50k.tiktoken"), public.PATTERN)
    whole = packing.sequences(pieces, pad_id=0).collect()
    assert all(len(r["ids"]) == 2048 for r in whole)
    wanted = collections.Counter(int(i) for d, t in rows[:40] for i in [*np.frombuffer(ENC(t), "<u2"), 1] if i)
    assert collections.Counter(i for r in whole for i in r["ids"] if i) == wanted


@pytest.mark.parametrize("seed", range(4))
def test_histogram_patterns_hold_every_piece(seed):
    draw = random.Random(seed)
    counts = {draw.randint(1, 64): draw.randint(1, 50) for _ in range(40)}
    patterns = packing.pack_histogram(counts, 64)
    held = collections.Counter()
    for packs, pattern in patterns:
        assert sum(pattern) <= 64
        for length in pattern:
            held[length] += packs
    assert held == counts
    begins, shifts, offsets = packing.slots(patterns, counts)
    assert begins[0] == 0 and len(set(begins)) == len(begins)


# ---- 9: sharding ----

def test_ring_shards_are_balanced_whole_and_stable(spark):
    rows = [(k, f"text {k % 400}") for k in range(1500)] + [(5000 + k, "hot") for k in range(700)] + [(1, None), (2, ""), (2, ""), (None, "é")]
    frame = spark.createDataFrame([(*r, 3) for r in rows], DOCS + ", place int")
    out = sharding.bounded_ring(frame, 40).collect()
    by = collections.defaultdict(list)
    for r in out:
        by[r["shard"]].append(r["slot"])
    assert len(out) == len(rows) and set(by) == set(range(40))
    assert {len(v) for v in by.values()} <= {len(rows) // 40, len(rows) // 40 + 1}
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    sizes = collections.Counter((r["size"], r["text_crc32"]) for r in out)
    assert sizes == collections.Counter((len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for _, t in rows)
    again = sharding.bounded_ring(frame.repartition(7), 40).collect()
    key = lambda r: (r["doc_id"] is None, r["doc_id"], r["size"], r["shard"])
    assert sorted(map(key, out), key=str) == sorted(map(key, again), key=str)
    assert sharding.bounded_ring(spark.createDataFrame([], DOCS), 40).count() == 0
    assert len(sharding.bounded_ring(spark.createDataFrame([(1, "a")], DOCS), 40).collect()) == 1


def test_ring_with_slack_moves_little(spark):
    frame = spark.createDataFrame([(k, f"text {k}") for k in range(4000)], DOCS)
    before, after = ({r["doc_id"]: r["shard"] for r in sharding.bounded_ring(frame, n, slack=0.25).collect()} for n in (20, 21))
    assert max(collections.Counter(before.values()).values()) <= 250
    assert sum(before[d] != after[d] for d in before) < 0.2 * len(before)


def test_overflow_walks_clockwise():
    assert sharding.overflow_intervals([5, 0, 1], [0, 1, 2], [2, 2, 2]) == [(0, 2, 0), (2, 4, 1), (4, 5, 2), (5, 6, 2)]
    assert sharding.overflow_intervals([0, 0, 4], [0, 1, 2], [2, 1, 1]) == [(0, 1, 2), (1, 3, 0), (3, 4, 1)]


# ---- pipeline ----

def test_pipeline_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [tuple(r) for r in docs.collect()]
    junk = [(90_001, None, "en", "s", 0), (90_002, "", "en", "s", 0), (90_003, "一丁丂" * 50, "zz", "s", 150)]
    frame = spark.createDataFrame(rows + junk + rows[:2], docs.schema).withColumnRenamed("n", "m")
    items = rows_of(SF, "benchmark", "item_id, text")
    text = {r[0]: r[1] for r in rows}
    kept = corpus_pipeline.identify_language(spark, frame, SF)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted([r[0] for r in rows] + [r[0] for r in rows[:2]])
    unique = corpus_pipeline.drop_near_copies(spark, kept, SF)
    expected = {d for d, (_, c) in helpers.jaccard_components(list(text.items())).items() if d == c}
    assert sorted(r["doc_id"] for r in unique.collect()) == sorted(expected) and unique.columns == docs.columns
    clean = corpus_pipeline.drop_benchmark_leaks(spark, unique, SF)
    hits = helpers.contamination([(d, text[d]) for d in expected], items)
    expected = {d for d in expected if not hits[d][1]}
    assert {r["doc_id"] for r in clean.collect()} == expected and clean.columns == docs.columns
    private = corpus_pipeline.replace_personal_data(spark, clean, SF)
    new = {r["doc_id"]: r for r in private.collect()}
    assert private.schema.names == docs.columns and set(new) == expected
    assert all(r["n_chars"] == len(r["text"]) for r in new.values())
    packed = corpus_pipeline.pack(spark, private, SF)
    assert check_packing([(d, r["text"]) for d, r in new.items()], packed.collect()) > 0.95
    full = corpus_pipeline.run(spark, SF).collect()
    assert sorted((r["doc_id"], r["start"], r["ids_crc32"]) for r in full) == sorted((r["doc_id"], r["start"], r["ids_crc32"]) for r in packed.collect())


def test_pipeline_stages_take_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, spark.createDataFrame([], docs.schema), SF)
        assert out.count() == 0, name
