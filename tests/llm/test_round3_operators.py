"""Operators 1, 4, 6, 7, 11, 12 and 13: edge cases and plain-Python comparisons."""
from __future__ import annotations

import collections
import hashlib
import heapq
import itertools
import math
import random
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pytest

from credlake.llm import bloom_sketch, catalogue, language, ngram_trie, prefix_trie, surrogates, token_alignment, token_rollup
from credlake.llm.ngram_trie import EliasFano
from credlake.session import work_dir
from credlake.sources import lake
from tests.llm.helpers import DOCS, LOWER, rows_of

SF = "/root/testdata/sf0.001"


# ---- 1: surrogates ----

def test_long_texts_of_one_kind_are_matched_in_linear_time(spark):
    n = 1_000_000
    texts = ["a" * n + "1", "1" * n, "." * n + "@", "a." * (n // 2) + "1", "x@" + "a." * (n // 2) + "com", "ab-" * (n // 3) + "@", "Mr " * 20_000 + "A" * 1000,
             "x@" + "a." * 3000 + "com", "deadbeef" * (n // 8)]
    frame = spark.createDataFrame(list(enumerate(texts)), DOCS).repartition(1)
    begin = time.time()
    out = {r["doc_id"]: r for r in surrogates.replace_pii(frame, "k").collect()}
    assert time.time() - begin < 60 and len(out) == len(texts)
    assert out[0]["text"] == texts[0] and out[8]["text"] == texts[8] and out[4]["n_entities"] == 1 and not out[7]["text"].startswith("x@a.")


def test_names_with_other_titles_more_words_and_without_a_title(spark):
    text = "Mr John Smith met Dr Jane Doe and Mrs Anna Maria Lopez. Smith said Lopez, not Jane; Smithers and Doe-Ray were out. Sra Lopez"
    frame = spark.createDataFrame([(1, text, 77), (None, text, 78), (2, "Smith is unnamed here", 79)], DOCS + ", n_entities int")
    rows = surrogates.replace_pii(frame, "k").collect()
    out = {r["doc_id"]: r for r in rows}
    assert out[1]["text"] == out[None]["text"] and sorted(r["n_entities"] for r in rows) == [77, 78, 79] and out[2]["text"] == "Smith is unnamed here"
    m = re.fullmatch(r"Mr (\w+) (\w+) met Dr (\w+) (\w+) and Mrs (\w+) (\w+) (\w+)\. (\w+) said (\w+), not (\w+); Smithers and Doe-Ray were out\. Sra (\w+)",
                     out[1]["text"])
    assert m, out[1]["text"]
    john, smith, jane, doe, anna, maria, lopez, smith2, lopez2, jane2, lopez3 = m.groups()
    assert smith == smith2 and lopez == lopez2 == lopez3 and jane == jane2 and len({john, smith, jane, doe, anna, maria, lopez}) == 7
    assert not {"John", "Smith", "Jane", "Doe", "Anna", "Maria", "Lopez"} & set(m.groups())
    assert anna.endswith(surrogates.LATIN_FEMALE) and maria.endswith(surrogates.LATIN_FEMALE) and john.endswith(surrogates.LATIN_MALE)


# ---- 4 and 6 ----

def test_rollup_reads_whole_batches_only_and_keeps_committed_ones(spark):
    root = work_dir(spark, "rollup")
    cols = "op string, source string, lang string, tokenizer string, tokens long, bytes long, " \
           "old_source string, old_lang string, old_tokenizer string, old_tokens long, old_bytes long"
    batch = lambda n: spark.createDataFrame([("insert", "a", "en", "v1", n, n, None, None, None, None, None)], cols)
    assert token_rollup.totals(spark, root).count() == 0
    token_rollup.commit(batch(5), root, "1")
    token_rollup.commit(batch(7), root, "2")
    lake._delete(spark, f"{root}/batch=2/_SUCCESS")  # the driver was lost while the batch was written
    assert [tuple(r) for r in token_rollup.totals(spark, root).collect()] == [("a", "en", "v1", 1, 5, 5)]
    before = lake._glob(spark, f"{root}/batch=1/*.parquet")
    for name in ("1", "2"):
        token_rollup.commit(batch(7), root, name)
    assert lake._glob(spark, f"{root}/batch=1/*.parquet") == before  # a replay takes nothing away
    assert [tuple(r) for r in token_rollup.totals(spark, root).collect()] == [("a", "en", "v1", 2, 12, 12)]


def test_page_evidence_beside_columns_of_its_own_names(spark):
    pages = spark.createDataFrame([(1, "http://a.example/", "<html lang=fr>bonjour", "T", "H", "S", "D", "en", 5)],
                                  "page_id long, url string, html string, text string, host string, suffix string, domain string, declared string, row_id long")
    got = language.page_evidence(pages).first()
    assert (got["page_id"], got["text"].strip(), got["host"], got["declared"]) == (1, "bonjour", "a.example", "fr")
    docs = spark.createDataFrame([(k, f"le chat et la souris {k}", "fr") for k in range(9)] + [(k, f"the cat and the mouse {k}", "en") for k in range(9, 18)],
                                 "id long, text string, lang string")
    rows = language.page_evidence(pages).withColumnRenamed("page_id", "row_id")
    assert language.identify(rows, language.train(docs)).first()["lang"] == "fr"


# ---- 7: sketches ----

def sketched(rows):
    """(doc_id, n_chars, sha256 of the edited text, both likenesses) by sets of paragraphs."""
    cut = lambda text: {p.rstrip(" ") for p in re.findall(r"(?:[^ \t\n\x0b\f\r]+[ \t\x0b\f\r]*){1,24}", text)}
    jaccard = lambda a, b: 1.0 if not a and not b else len(a & b) / len(a | b)
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    out = []
    for k, (doc, text) in enumerate(order):
        text, after = text or "", order[(k + 1) % len(order)][1] or ""
        half = len(text) // 2
        edited = text[:len(text) - half] + after[:half]
        mine = cut(text)
        out.append((-1 if doc is None else doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), round(jaccard(mine, cut(edited)), 9),
                    round(jaccard(mine, cut(after)), 9)))
    return sorted(out)


def fingerprinted(frame):
    return sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_chars"], r["edited_sha256"], round(r["near_edited"], 9), round(r["near_next"], 9))
                  for r in bloom_sketch.fingerprints(frame).collect())


def lines(draw, n):
    return "\n".join(f"line {draw.randrange(5000)}" for _ in range(n))


@pytest.mark.parametrize("kind", ["repeated", "sparse", "dense"])
def test_sketches_of_repeated_null_sparse_and_dense_ids(spark, monkeypatch, kind):
    monkeypatch.setattr(bloom_sketch, "BUCKET_BITS", 4)
    monkeypatch.setattr(bloom_sketch, "LEAST_IN_BUCKET", 8)
    draw = random.Random(7)
    if kind == "repeated":
        rows = [(5, lines(draw, 9)) for _ in range(40)] + [(None, lines(draw, 3)) for _ in range(35)] + [(5, "again")] * 20 + [(8, None), (8, ""), (-4, "x")]
    elif kind == "sparse":
        rows = [(draw.randrange(1 << 60), lines(draw, 6)) for _ in range(80)]
    else:
        rows = [(k, lines(draw, 6)) for k in range(100)] + [((1 << 40) + k, lines(draw, 2)) for k in range(50)]
    frame = spark.createDataFrame([(*r, 1, "k") for r in rows], DOCS + ", n_chars int, bucket string")
    assert fingerprinted(frame) == sketched(rows)


def test_sketches_of_words_with_equal_cells(spark):
    rows = [(1, "w94515\nw2679"), (0, "")]
    assert fingerprinted(spark.createDataFrame(rows, DOCS)) == sketched(rows)


def test_sketches_stuck_at_every_level_are_compared_as_sets(spark, monkeypatch):
    monkeypatch.setattr(bloom_sketch, "LEVELS", 1)
    monkeypatch.setattr(bloom_sketch, "CELLS", 3)
    draw = random.Random(8)
    rows = [(k, lines(draw, 40)) for k in range(6)]
    assert fingerprinted(spark.createDataFrame(rows, DOCS)) == sketched(rows)


# ---- 11: n-gram trie ----

def scores(rows, prior=ngram_trie.PRIOR):
    """Dirichlet-smoothed bigrams by plain counting."""
    unigrams, bigrams, contexts = (collections.Counter() for _ in range(3))
    texts = []
    for doc, text in rows:
        tokens = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER)) + [None]
        held = zlib.crc32(("" if doc is None else str(doc)).encode()) % 7 == 2
        texts.append((doc, held, tokens))
        if not held:
            unigrams.update(tokens)
            bigrams.update(zip([0] + tokens, tokens))
            contexts.update([0] + tokens[:-1])
    n, v = sum(unigrams.values()), len(unigrams)
    out = []
    for doc, held, tokens in texts:
        base = [(unigrams[w] + 1) / (n + v + 1) for w in tokens]
        score = sum(math.log10((bigrams[u, w] + prior * p) / (contexts[u] + prior)) for u, w, p in zip([0] + tokens, tokens, base))
        out.append((doc, held, len(tokens), sum(unigrams[w] > 0 for w in tokens), n, sum(map(math.log10, base)), score))
    return out


def same_scores(out, expected):
    order = lambda r: (r[0] is None, r[0] or 0, r[2], r[5])
    out, expected = sorted(map(tuple, out), key=order), sorted(expected, key=order)
    assert [r[:5] for r in out] == [r[:5] for r in expected]
    for a, b in zip(out, expected):
        assert a[5] == pytest.approx(b[5], abs=1e-8)
        assert abs(a[6] - b[6]) <= 1e-8 + a[2] * ngram_trie.STEP / 2  # each probability has 16 bits


def test_elias_fano_finds_values_and_successors():
    draw = random.Random(3)
    for top, n in ((1, 1), (50, 40), (1 << 20, 3000), ((1 << 58) - 1, 2000), (1 << 45, 1)):
        values = np.array(sorted({draw.randint(0, top) for _ in range(n)}), np.uint64)
        ef = EliasFano(values, lambda a: a)
        assert (ef[np.arange(len(values))] == values).all()
        wanted = np.array([draw.randint(0, top + 5) for _ in range(500)] + values.tolist()[:200], np.uint64)
        assert (ef.successor(wanted) == np.searchsorted(values, wanted)).all()
    repeated = EliasFano(np.array([0, 0, 3, 3, 3, 9], np.uint64), lambda a: a)
    assert repeated[np.arange(6)].tolist() == [0, 0, 3, 3, 3, 9]
    assert EliasFano(np.zeros(0, np.uint64), lambda a: a).successor(np.array([0, 7], np.uint64)).tolist() == [0, 0]


def test_scores_equal_plain_counts_over_many_shards_and_sheets(spark, monkeypatch):
    monkeypatch.setattr(ngram_trie, "SHARD_TOKENS", 3000)
    monkeypatch.setattr(ngram_trie, "SHEET_TOKENS", 9000)
    rows = rows_of(SF, "documents", "doc_id, text")
    rows += [(70_001, None), (70_002, ""), (None, "no id at all"), (70_003, "Same SAME same " * 3000), (70_003, "Same SAME same " * 3000), rows[0]]
    frame = spark.createDataFrame([(*r, 5, "k") for r in rows], DOCS + ", n int, score string").repartition(3)
    out = ngram_trie.score(frame).collect()
    same_scores(out, scores(rows))
    held = [r for r in out if r["held_out"] and r["n_tokens"] > 50]
    assert held and sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_scores_without_training_rows_and_without_rows(spark):
    held = [(k, "a b c") for k in range(200) if zlib.crc32(str(k).encode()) % 7 == 2][:5]
    same_scores(ngram_trie.score(spark.createDataFrame(held, DOCS)).collect(), scores(held))
    assert ngram_trie.score(spark.createDataFrame([], DOCS)).count() == 0


# ---- 12: prefix trie ----

def trie_nodes(rows):
    """Nodes by dictionaries of whole prefixes."""
    turns = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            turns[conv].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [t[2:] for t in sorted(v, key=lambda t: t[:2])] for c, v in turns.items()}
    whole = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 6
        whole[c] = turns.get(c - c % 100, [])[:h] + turns[c][h:]
    members = collections.defaultdict(list)
    for c in sorted(whole):
        for d in range(len(whole[c]) + 1):
            members[tuple(whole[c][:d])].append(c)
    children = collections.Counter(k[:-1] for k in members if k)
    leaves, saved = collections.Counter(), collections.Counter()
    for k in members:
        for d in range(len(k) + 1):
            saved[k[:d]] += (len(members[k]) - 1) * len(k[-1][1]) if k else 0
            leaves[k[:d]] += not children[k]
    def ends(k):
        return hashlib.sha256(",".join(str(c) for c in members[k] if len(whole[c]) == len(k)).encode()).hexdigest()
    return sorted((members[k][0], len(k), members[k[:-1]][0] if k else -1, len(members[k]), children[k], leaves[k], saved[k], ends(k)) for k in members)


def nodes_of(frame):
    cols = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(tuple(-1 if r[c] is None else r[c] for c in cols) for r in frame.select(cols).collect())


CONVERSATIONS = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("members", [2, 1024])
def test_trie_of_families_copies_long_ones_and_edges(spark, monkeypatch, members):
    monkeypatch.setattr(prefix_trie, "SHARD_MEMBERS", members)
    monkeypatch.setattr(prefix_trie, "QUEUE_ITEMS", 3)
    monkeypatch.setattr(prefix_trie, "CHUNK_IDS", 4)
    monkeypatch.setattr(prefix_trie, "BLOCK", 7)
    draw = random.Random(members)
    rows = [(c, t, draw.choice(["user", "bot"]), draw.choice(["hi", "go on", "é" * 9, "x"])) for c in range(250) for t in range(draw.randint(1, 9))]
    rows += [(c, t, "user", f"same {t}") for c in range(300, 340) for t in range(6)]  # copies
    rows += [(400, t, "user", f"turn {t % 11}") for t in range(90)]  # a long one
    rows += [(500, None, "user", "first"), (500, 0, None, None), (500, 3, "", ""), (501, 1, "user", None), (None, 1, "user", "of no conversation")]
    rows += [(601, 5, "a", "only turn"), (701, 0, "user", "x" * 300_000)]
    frame = spark.createDataFrame([(*r, 1) for r in rows], CONVERSATIONS + ", depth int")
    assert nodes_of(prefix_trie.rebuilt_trie(frame)) == trie_nodes(rows)


def test_trie_of_repeated_turns_and_of_nothing(spark):
    rows = [(7, 1, "user", "again")] * 3 + [(7, 2, "bot", "yes")] * 2
    assert nodes_of(prefix_trie.rebuilt_trie(spark.createDataFrame(rows, CONVERSATIONS))) == trie_nodes(rows)
    assert prefix_trie.rebuilt_trie(spark.createDataFrame([], CONVERSATIONS)).count() == 0


def test_trie_of_the_given_conversations(spark):
    rows = rows_of(SF, "conversations", "conv_id, turn, role, text")
    assert nodes_of(catalogue.op12_prefix_trie(spark, SF)) == trie_nodes(rows)


def test_spilling_queue_gives_messages_in_order():
    draw = random.Random(2)
    queue, heap = prefix_trie.MessageQueue(16), []
    for k in range(3000):
        if heap and draw.random() < 0.45:
            assert queue.least() == heap[0] and queue.pop() == heapq.heappop(heap)
        else:
            m = (draw.randint(-5, 5), draw.randint(-9, 9), k, 0, k, -k)
            queue.push(m)
            heapq.heappush(heap, m)
    assert [queue.pop() for _ in range(len(heap))] == sorted(heap) and queue.least() is None


# ---- 13: token alignment ----

PATHS = (public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN,
         public_tokenizers.path("piece_bpe_32k.model"))
HARD = ["\r\nabc\r\n\r\nx;\r\n y", "a  b   c\t\td \n\n e", "<|endoftext|> x <s> </s> <0x0A>", "é　漢字 かな z", "a\x1cb \x85c", "q" * 3000, "   ", "\n",
        "\t'", "'s 're we'll", "​zero ﬁ ①﻿", " lead", "trail ", "▁piece", "a ▁", "🙂🙂 \U0001f468‍\U0001f469 ok", "x\x00y", "\xa0\xa0b"]


def aligned(rows):
    """Byte offsets of whole texts' tokens, compared pair by pair."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_tok = Tokenizer.from_file(PATHS[0])
    a_tok.encode_special_tokens = True
    b_tok = sentencepiece.SentencePieceProcessor(model_file=PATHS[3])
    byte_of = token_alignment._byte_level()
    a_bytes = {k: bytes(byte_of[c] for c in t) for t, k in a_tok.get_vocab().items() if all(c in byte_of for c in t)}

    def b_bytes(k):
        p = b_tok.id_to_piece(k)
        return bytes([int(p[3:5], 16)]) if b_tok.is_byte(k) else p.replace("▁", " ").encode()

    found, counts = [], collections.Counter()
    for doc, text in rows:
        a = a_tok.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_tok.encode(text) if text else []
        whole = (" " + text).encode() if text else b""
        sides = [[a_bytes[k] for k in a], [b_bytes(k) for k in b]]
        if not text or any(b"".join(s) != whole for s in sides):
            found.append((doc, [], [], []))
            continue
        ends = [list(itertools.accumulate(map(len, s))) for s in sides]
        cuts = sorted(set(ends[0]) & set(ends[1]))
        parts = [[[k for k, e in zip(ids, e_) if lo < e <= hi] for lo, hi in zip([0] + cuts, cuts)] for ids, e_ in zip((a, b), ends)]
        links = []
        for i, hi in enumerate(ends[0]):
            lo = hi - len(sides[0][i])
            for j in range(len(b)):
                if ends[1][j] - len(sides[1][j]) < hi and lo < ends[1][j]:
                    links.append((a[i], b[j]))
        counts.update(links)
        found.append((doc, a, b, [links, list(zip(*parts))]))
    highest = collections.Counter()
    for (_, b), n in counts.items():
        highest[b] = max(highest[b], n)
    out = []
    for doc, a, b, rest in found:
        if not rest:
            out.append((doc, 0, 0, 0, 0, 0, 0, ""))
            continue
        links, groups = rest
        text = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        out.append((doc, len(a), len(b), len(groups), len(links), sum(counts[k] == highest[k[1]] for k in links), sum(counts[k] for k in links),
                    hashlib.sha256(text.encode()).hexdigest()))
    return out


def by_doc(rows):
    return sorted(map(tuple, rows), key=lambda r: (r[0] is None, r[0] or 0, r[1:]))


@pytest.fixture(scope="module")
def alignment_rows():
    rows = rows_of(SF, "documents", "doc_id, text")
    short = sorted(rows, key=lambda r: len(r[1] or ""))[:70]
    return short + [(90_000 + k, t) for k, t in enumerate([*HARD, None, ""])] + [short[-1], (None, "no id")]


@pytest.mark.parametrize("most", [token_alignment.MOST_PAIRS, 0])
def test_alignment_equals_whole_texts_pair_by_pair(spark, monkeypatch, alignment_rows, most):
    monkeypatch.setattr(token_alignment, "MOST_PAIRS", most)
    monkeypatch.setattr(token_alignment, "HELD_PAIRS", 500)
    monkeypatch.setattr(token_alignment, "CACHED_CHUNKS", 300)
    monkeypatch.setattr(token_alignment, "SLICE_SLOTS", 256)
    monkeypatch.setattr(token_alignment, "FAN_IN", 2)
    frame = spark.createDataFrame([(*r, 3, "k") for r in alignment_rows], DOCS + ", n_a int, key string").repartition(3)
    assert by_doc(token_alignment.alignment(frame, *PATHS).collect()) == by_doc(aligned(alignment_rows))


def test_alignment_of_nothing(spark):
    assert token_alignment.alignment(spark.createDataFrame([], DOCS), *PATHS).count() == 0
    out = token_alignment.alignment(spark.createDataFrame([(1, None)], DOCS), *PATHS).collect()
    assert [tuple(r) for r in out] == [(1, 0, 0, 0, 0, 0, 0, "")]


def test_no_piece_crosses_a_cut_between_chunks():
    tok = token_alignment.Tokenizers(*PATHS)
    spaces = token_alignment._SPACES
    pieces = [tok.b.id_to_piece(k) for k in range(tok.b.get_piece_size()) if not (tok.b.is_byte(k) or tok.b.is_control(k) or tok.b.is_unknown(k))]
    assert not [p for p in pieces if re.search(f"[^{spaces}▁](▁|[ \n\t])", p)]
    assert tok.b.id_to_piece(tok.b.encode("x")[0]) == "▁x"
    for text in HARD:
        assert "".join(token_alignment.CHUNK.findall(" " + text)) == " " + text


def test_perfect_hash_has_a_slot_for_each_key_and_knows_strangers():
    draw = np.random.default_rng(4)
    keys = np.unique(draw.integers(0, 1 << 32, 7000, dtype=np.uint32))
    buckets = 5
    rows = []
    for k in range(buckets):
        mine = keys[token_alignment._bucket(keys, buckets) == k]
        seeds, slots = token_alignment.bucket_seeds(mine)
        assert sorted(slots) == sorted(mine)
        rows.append({"bucket": k, "n": len(mine), "seeds": seeds.tobytes(), "keys": slots.tobytes()})
    found = token_alignment.PairHash(rows)
    assert sorted(found.slots(keys, buckets)) == list(range(len(keys)))
    strangers = np.setdiff1d(draw.integers(0, 1 << 32, 3000, dtype=np.uint32), keys)
    assert (found.slots(strangers, buckets) == -1).all()
