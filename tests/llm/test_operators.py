"""Each operator against brute force, on odd rows and on small tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from palimpsest.llm import common, exact_dedup, license_scan, lm_backoff, near_dedup, packing, piece_codec, quality_qda, repetition, substring_dedup, token_counts
from palimpsest.llm.common import Words, even_join, gram_hashes
from palimpsest.llm.queries import ORACLE, QUERIES
from tests.compare import connection, rows
from tests.llm.conftest import BPE, PIECES, frame, prose

WORD = re.compile("[^\x20\x09-\x0d]+")


def words(t):
    return WORD.findall(t or "")


def empty(spark):
    return frame(spark, [(1, "a")]).where("doc_id < 0")


# ---- shared helpers ----------------------------------------------------------------


@given(st.lists(st.text(alphabet="ab é\n\t", max_size=30), max_size=6))
@settings(max_examples=200, deadline=None)
def test_words_and_hashes(texts):
    w = Words([t.encode() for t in texts])
    flat = [x for t in texts for x in words(t)]
    assert [bytes(w.buffer[a:b]).decode() for a, b in zip(w.start, w.end)] == flat
    h = w.hashes()
    assert len(set(zip(flat, h.tolist()))) == len(set(flat)) == len(set(h.tolist()))
    g = gram_hashes(h, 2).tolist()
    grams = list(zip(flat, flat[1:]))
    assert len(set(zip(grams, g))) == len(set(grams)) == len(set(g))


def test_even_join_keeps_every_row(spark):
    left = spark.range(5000).select(F.when(F.col("id") < 3000, 7).otherwise(F.col("id")).alias("k"), "id")
    right = spark.range(0, 5000, 2).select(F.col("id").alias("k"), (F.col("id") * 3).alias("v")).unionByName(spark.createDataFrame([(7, 21)], "k long, v long"))
    for how in ("inner", "left_semi", "left_anti", "left"):
        assert even_join(left, right, "k", how, 5000).count() == left.join(right, "k", how).count()


# ---- 10 -------------------------------------------------------------------------------


@pytest.mark.parametrize("bits", [4096, 1 << 28])
def test_exact_duplicates(spark, odd_rows, bits):
    got = exact_dedup.exact_duplicates(frame(spark, odd_rows), range_bits=bits).collect()
    groups = defaultdict(list)
    for i, t in odd_rows:
        groups[t or ""].append(i)
    assert len(got) == len(odd_rows)
    by_sha = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    kept = Counter()
    for r in got:
        ids = by_sha[r["text_sha256"]]
        assert r["group_size"] == len(ids)
        assert r["keep_id"] == max((i for i in ids if i is not None), default=None)
        kept[r["text_sha256"]] += r["kept"]
    assert set(kept.values()) == {1}


@pytest.mark.parametrize("bits", [2048, 8192, 1 << 28])
def test_exact_drop_keeps_one_of_each(spark, odd_rows, bits):
    docs = frame(spark, odd_rows * 3)
    out = exact_dedup.drop_exact_duplicates(docs, range_bits=bits)
    assert out.columns == docs.columns
    assert Counter(r[1] or "" for r in out.collect()) == Counter({t or "": 1 for _, t in odd_rows})
    assert exact_dedup.drop_exact_duplicates(empty(spark)).count() == 0
    assert exact_dedup.exact_duplicates(empty(spark)).count() == 0


def test_exact_oracle(spark, sf):
    df = QUERIES["op10_exact_dedup"](spark, sf)
    want = connection(sf).sql(ORACLE["op10_exact_dedup"])
    assert rows(df.columns, df.collect()) == rows(want.columns, want.fetchall())


def test_exact_plan_has_no_python(spark, odd_rows):
    plan = exact_dedup.exact_duplicates(frame(spark, odd_rows))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# ---- 3 ----------------------------------------------------------------------------------


def brute_rules(t):
    w = words(t)
    c = Counter(zip(w, w[1:], w[2:]))
    hit = {j for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in (t or "").split("\n"):
        dup += line in seen and bool(words(line))
        seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(hit)


def test_repetition_rules(spark, odd_rows, sf):
    for docs, source in ((frame(spark, odd_rows), odd_rows), (spark.read.parquet(f"{sf}/documents.parquet"), None)):
        source = source or [(r["doc_id"], r["text"]) for r in docs.collect()]
        got = repetition.repetition_rules(docs).collect()
        found = Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in got)
        assert found == Counter((i, *brute_rules(t)) for i, t in source)
        for r in got:
            assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
            assert not (r["kept"] and r["base_failed"])
    assert repetition.repetition_rules(empty(spark)).count() == 0


def test_repetition_shares(spark, odd_rows):
    """Characters of words in later occurrences of an n-gram and of repeated lines, and the verdict, by definition."""
    docs = odd_rows + [(400, (prose(40, 30) + " ") * 3 + prose(41, 40)), (401, "\n".join([prose(42, 12)] * 9 + [prose(43, 60)]))]
    got = repetition.repetition_rules(frame(spark, docs)).collect()
    want = []
    for i, t in docs:
        w = words(t)
        total = max(1, sum(map(len, w)))
        n_words, _, _, _, repeat = brute_rules(t)
        shares = []
        for k in sorted(repetition.GRAM_LIMITS):
            seen, hit = set(), set()
            for j in range(len(w) - k + 1):
                gram = tuple(w[j : j + k])
                hit |= set(range(j, j + k)) if gram in seen else set()
                seen.add(gram)
            shares.append(sum(len(w[j]) for j in hit) / total)
        lines, dup = set(), 0
        for line in (t or "").split("\n"):
            dup += sum(map(len, words(line))) if line in lines else 0
            lines.add(line)
        failed = n_words < 50 or 100 * repeat > 50 * n_words
        bad = dup / total > repetition.LINE_LIMIT or any(x > repetition.GRAM_LIMITS[k] for k, x in zip(sorted(repetition.GRAM_LIMITS), shares))
        want.append((i, t, [*shares, dup / total], failed, not failed and not bad))
    key = lambda i, shares: (i is None, i or 0, [round(x, 6) for x in shares])
    mine = sorted((key(r["doc_id"], [*[r[f"dup_{k}gram_share"] for k in sorted(repetition.GRAM_LIMITS)], r["dup_line_share"]]), r["base_failed"], r["kept"]) for r in got)
    assert mine == sorted((key(i, shares), failed, kept) for i, _, shares, failed, kept in want)


def test_repeated_passage_is_rejected(spark):
    clean, block = prose(8, 300), prose(9, 40)
    got = {r["doc_id"]: r["kept"] for r in repetition.repetition_rules(frame(spark, [(1, clean), (2, prose(10, 100) + (" " + block) * 2 + " " + prose(11, 20))])).collect()}
    assert got == {1: True, 2: True}
    rows_ = [(3, prose(12, 90) + "\n" + "\n".join([block] * 3))]
    assert [r["kept"] for r in repetition.repetition_rules(frame(spark, rows_)).collect()] == [False]


# ---- 4 -----------------------------------------------------------------------------------


def test_classifier_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = QUERIES["op4_quality_classifier"](spark, sf)
    assert dict(got.dtypes) == {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [r for r in got.collect() if r["doc_id"] in labels and r["held_out"]]
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1 for r in held)
    assert np.mean([r["predicted"] == labels[r["doc_id"]] for r in held]) >= 0.95


def test_classifier_learns_nothing_from_the_held_out_fold(spark, odd_rows):
    docs = frame(spark, [(i, prose(i, 60)) for i in range(60)])
    stats = quality_qda.document_statistics(docs)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    held = [i for i in range(60) if zlib.crc32(str(i).encode()) % 3 == 1]
    flipped = labels.withColumn("quality", F.when(F.col("doc_id").isin(held), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = quality_qda.train(stats, labels), quality_qda.train(stats, flipped)
    assert a.odds == b.odds and all(np.allclose(x, y) for x, y in zip(a.means, b.means))


def test_classifier_odd_rows(spark, odd_rows):
    stats = quality_qda.document_statistics(frame(spark, odd_rows))
    for labels in ([], [(1, 1, 0), (3, None, 0), (None, 0, 0), (3, 7, 0)]):
        model = quality_qda.train(stats, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
        got = quality_qda.scores(stats, model).collect()
        assert len(got) == len(odd_rows) and all(0 <= r["score"] <= 1 for r in got)
        docs = frame(spark, odd_rows)
        assert quality_qda.keep_good_documents(docs, model).columns == docs.columns
    assert quality_qda.document_statistics(empty(spark)).count() == 0


def brute_features(t):
    """The statistics of one text by their definitions."""
    import math

    t = t or ""
    w, raw = words(t), t.encode()
    n, size = len(w), max(1, len(t.encode()))
    per = max(n, 1)
    count = lambda chars: sum(raw.count(c.encode()) for c in chars)
    share = lambda x: math.sqrt(x / (x + per))
    later = set()
    seen = set()
    for j in range(n - 2):
        gram = tuple(w[j : j + 3])
        later |= {j, j + 1, j + 2} if gram in seen else set()
        seen.add(gram)
    upper = sum(c in b"ABCDEFGHIJKLMNOPQRSTUVWXYZ" for c in raw)
    return [
        math.log1p(n), share(count("#*$%&<>@^~=+_\\")), share(count("!")), math.sqrt(upper / size), math.log(size / per), math.log((len(set(w)) + 1) / (n + 1)) + 0.12 * math.log1p(n),
        sum(a == b for a, b in zip(w, w[1:])) / per, len(later) / per, share(count("0123456789")), share(count(".,;:?'\"()-")), share(count("\n") + 1), share(count("|")), share(count("<>{}[]")),
    ]


def test_scores_equal_those_by_definition(spark, odd_rows):
    """From text to number: statistics, class moments with shrinkage, log-densities by a general solver."""
    docs = odd_rows + [(500 + k, prose(k, 40 + k) if k % 2 else "BUY NOW!!! $$$ " * (5 + k) + prose(k, 5)) for k in range(40)]
    docs = [(i, t) for i, t in docs if i is not None]
    labels = {i: i % 2 for i, _ in docs if i >= 500}
    stats = quality_qda.document_statistics(frame(spark, docs))
    model = quality_qda.train(stats, spark.createDataFrame([(i, q, 0) for i, q in labels.items()], "doc_id long, quality int, toxic int"))
    x = np.array([brute_features(t) for _, t in docs])
    learnt = [k for k, (i, _) in enumerate(docs) if i in labels and zlib.crc32(str(i).encode()) % 3 != 1]
    by_class = {c: x[[k for k in learnt if labels[docs[k][0]] == c]] for c in (0, 1)}
    scale = np.maximum(np.concatenate(list(by_class.values())).var(axis=0), 1e-6)
    density = []
    for c in (0, 1):
        cov = np.cov(by_class[c].T)
        cov = (1 - quality_qda.SHRINKAGE) * cov + quality_qda.SHRINKAGE * np.diag(np.diag(cov)) + quality_qda.RIDGE * np.diag(scale)
        off = x - by_class[c].mean(axis=0)
        density.append(-0.5 * (np.einsum("ij,ij->i", off, np.linalg.solve(cov, off.T).T) + np.linalg.slogdet(cov)[1]))
    want = 1 / (1 + np.exp(-np.clip(density[1] - density[0] + np.log((len(by_class[1]) + 1) / (len(by_class[0]) + 1)), -500, 500)))
    got = quality_qda.scores(stats, model).collect()
    assert np.allclose(sorted(r["score"] for r in got), sorted(want), atol=1e-6)


def test_cholesky_factors_give_gaussian_densities():
    rng = np.random.default_rng(0)
    d = len(quality_qda.FEATURES)
    data = {c: rng.normal(c, 1 + c, size=(400, d)) for c in (0, 1)}
    model = quality_qda.fit({c: (len(x), x.sum(0), x.T @ x) for c, x in data.items()}, shrinkage=0.0, ridge=1e-9)
    x = rng.normal(0.5, 1, size=(20, d))
    want = []
    for c in (0, 1):
        cov, mean = np.cov(data[c].T), data[c].mean(0)
        want.append([-0.5 * ((v - mean) @ np.linalg.solve(cov, v - mean) + np.linalg.slogdet(cov)[1]) for v in x])
    assert np.allclose(model.score(x), 1 / (1 + np.exp(-(np.array(want[1]) - want[0]))), atol=1e-6)


# ---- 6 --------------------------------------------------------------------------------------

PARTS = ["'re", "'", " ", "  ", "\n", "ab", "1", "<|endoftext|>", "<|endof", "é", "!!", "the ", "x" * 40, "漢"]


@given(st.lists(st.sampled_from(PARTS), max_size=120))
@settings(max_examples=150, deadline=None)
def test_spliced_ids_equal_whole(parts):
    text = "".join(parts)
    tok = token_counts.tokenizer(BPE)
    want = tok.encode(text, add_special_tokens=False).ids
    for chunk, overlap in ((60, 40), (150, 90)):
        assert [i for run in token_counts.spliced_ids(tok, text, chunk, overlap) for i in run] == want
    assert list(token_counts.fast_encoder(BPE)([text])[0]) == want


def test_token_counts(spark, odd_rows):
    tok = token_counts.tokenizer(BPE)
    got = token_counts.token_counts(frame(spark, odd_rows), BPE, chunk=500, overlap=80).collect()
    assert Counter((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in got) == Counter((i, len((t or "").encode()), n, n > 1024) for i, t in odd_rows for n in [len(tok.encode(t or "", add_special_tokens=False).ids)])
    assert token_counts.token_counts(empty(spark), BPE).count() == 0


# ---- 8 ---------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


@given(st.text(max_size=60) | st.text(alphabet=" aeé▁😀\n\t<0x>ſ中thing", max_size=80))
@settings(max_examples=400, deadline=None)
def test_codec_equals_library(library, text):
    codec = piece_codec.codec(PIECES)
    ids = library.encode(text)
    assert codec.encode(text) == ids
    assert codec.decode(ids) == library.decode(ids)
    assert codec.digest(text) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())


def test_borders_stand_as_merging_anew_says():
    codec = piece_codec.codec(PIECES)
    rng, ids = random.Random(2), list(codec.usable.values())
    for left, right in [(rng.choice(ids), rng.choice(ids)) for _ in range(4000)] + [(codec.usable["▁▁"], codec.usable["▁"])]:
        a, b = codec.pieces[left], codec.pieces[right]
        assert codec._compatible(left, right) == (codec.merge(a + b) == [a, b])


def test_codec_long_units_and_bitfield(library):
    codec = piece_codec.codec(PIECES)
    for text in ("ab" * 2000, "thingtion" * 300 + "é" * 50, " " * 700):
        assert codec.encode(text) == library.encode(text)


def test_piece_digests(spark, odd_rows, library):
    got = piece_codec.piece_digests(frame(spark, odd_rows), PIECES).collect()
    want = Counter((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()) for i, t in odd_rows for ids in [library.encode(t or "")])
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"]) for r in got) == want
    assert piece_codec.piece_digests(empty(spark), PIECES).count() == 0
    back = piece_codec.encode_documents(frame(spark, odd_rows), PIECES).collect()
    assert Counter(r["decoded"] for r in back) == Counter(library.decode(library.encode(t or "")) for _, t in odd_rows)


# ---- 1 ----------------------------------------------------------------------------------------


def check_packing(got, docs, capacity=2048):
    """Against the tokenizers library and a cut of its own."""
    tok = token_counts.tokenizer(BPE)
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    pieces = defaultdict(list)
    for r in got:
        pieces[r["doc_id"]].append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
    want = defaultdict(list)
    for i, t in docs:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        want[i].append(ids)
    for i, texts in want.items():
        assert len(pieces[i]) == sum(max(1, -(-len(x) // capacity)) for x in texts)
        crc = Counter((start, length, c) for _, start, length, c in pieces[i])
        for ids in texts:
            first = len(ids) % capacity or capacity if len(ids) > capacity else len(ids)
            starts = [0, *range(first, len(ids), capacity)]
            for a, b in zip(starts, [*starts[1:], len(ids)]):
                key = (a, b - a, zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[a:b])))
                assert crc[key] > 0
                crc[key] -= 1
    return len(bins)


def test_packing(spark, odd_rows, sf):
    check_packing(packing.pack_documents(frame(spark, odd_rows), BPE).collect(), odd_rows)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = packing.pack_documents(docs, BPE).collect()
    used = check_packing(got, [(r["doc_id"], r["text"]) for r in docs.collect()])
    assert used <= 1.02 * -(-sum(r["length"] for r in got) // 2048) + 1
    assert packing.pack_documents(empty(spark), BPE).count() == 0
    with_ids = packing.pack_documents(frame(spark, odd_rows), BPE, with_ids=True).collect()
    assert all(len(r["ids"]) == r["length"] for r in with_ids)


@given(st.dictionaries(st.integers(1, 30), st.integers(1, 4), max_size=8), st.integers(0, 40))
@settings(max_examples=200, deadline=None)
def test_fullest_is_the_best_subset_sum(counts, room):
    best = {0}
    for length, n in counts.items():
        best |= {b + k * length for b in best for k in range(1, n + 1) if b + k * length <= room}
    found = packing.fullest(counts, room)
    assert all(found[x] <= counts[x] for x in found)
    assert sum(k * v for k, v in found.items()) == max(best)


# ---- 9 ------------------------------------------------------------------------------------------


def brute_spans(docs, window):
    c = Counter(tuple(w[i : i + window]) for _, t in docs for w in [words(t)] for i in range(len(w) - window + 1))
    out = []
    for i, t in docs:
        w = words(t)
        gone = {j for k in range(len(w) - window + 1) if c[tuple(w[k : k + window])] > 1 for j in range(k, k + window)}
        kept = [x for j, x in enumerate(w) if j not in gone]
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("window, anchor", [(35, 8), (12, 4)])
def test_repeated_passages(spark, odd_rows, window, anchor):
    shared, tail = prose(20, 60), prose(21, 15)
    docs = odd_rows + [(100 + k, f"{prose(30 + k, 20)} {shared} {tail if k % 2 else ''} {prose(60 + k, 10)}") for k in range(8)] + [(200, (prose(70, 40) + " ") * 3), (201, "er " * 90)]
    got = substring_dedup.passage_report(frame(spark, docs), window=window, anchor=anchor).collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got) == brute_spans(docs, window)
    assert substring_dedup.passage_report(empty(spark)).count() == 0


def test_longest_matches_and_factors():
    rng = random.Random(8)
    for _ in range(150):
        stretches = [[rng.randint(0, 2) for _ in range(rng.randint(1, 14))] for _ in range(rng.randint(1, 6))]
        flat, ends = np.array([x for s in stretches for x in s], dtype=np.uint64), np.cumsum([len(s) for s in stretches])
        places = [s[j:] for s in stretches for j in range(len(s))]
        common_part = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        best = [max((common_part(a, b) for q, b in enumerate(places) if q != p), default=0) for p, a in enumerate(places)]
        matches = substring_dedup.longest_matches(flat, ends)
        assert matches.tolist() == best
        begins = ends - np.diff(ends, prepend=0)
        start, size = substring_dedup.factors(matches, begins, ends)
        assert sorted(p for a, n in zip(start, size) for p in range(a, a + n)) == list(range(len(flat)))
        assert all(n == max(1, best[a]) for a, n in zip(start, size))
        asked = np.flatnonzero([rng.random() < 0.7 for _ in stretches])
        owner = np.repeat(np.arange(len(stretches)), np.diff(ends, prepend=0))
        assert substring_dedup.duplicate_windows(flat, ends, asked, 3).tolist() == [best[p] >= 3 and owner[p] in asked for p in range(len(flat))]


def test_passages_in_many_small_blocks_and_hot_anchors(spark, odd_rows):
    shared = prose(20, 60)
    docs = odd_rows + [(100 + k, f"{prose(30 + k, 20)} {shared} {prose(60 + k, 10)}") for k in range(12)] + [(300 + k, prose(80, 50)) for k in range(3)]
    for options in ({"block_chunks": 1}, {"anchor_chunks": 1}, {"anchor_chunks": 3, "block_chunks": 2}):
        got = substring_dedup.passage_report(frame(spark, docs), window=12, anchor=4, **options).collect()
        assert Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got) == brute_spans(docs, 12)


def test_many_equal_rows_say_the_same_once(spark):
    docs = [(7, prose(21, 60))] * 200 + [(8, prose(22, 40))]
    got = substring_dedup.passage_report(frame(spark, docs)).collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got) == brute_spans(docs, 35)


def test_passages_are_cut_out_of_documents(spark):
    shared = prose(20, 60)
    docs = frame(spark, [(1, f"One  two.\n{shared}\nThree\tfour."), (2, f"Five six. {shared}"), (3, "Seven\n\neight."), (4, None), (5, shared)])
    out = {r[0]: (r[1], r[4]) for r in substring_dedup.drop_repeated_passages(docs).collect()}
    assert out == {1: ("One  two.\nThree\tfour.", 21), 2: ("Five six.", 9), 3: ("Seven\n\neight.", 13), 4: (None, None)}


# ---- 2 --------------------------------------------------------------------------------------------


def brute_classes(docs, n=5, least=0.8):
    sets = []
    for _, t in docs:
        w = words(t)
        sets.append(frozenset(zip(*[w[k:] for k in range(n)])) if len(w) >= n else frozenset([tuple(w)] if w else []))
    up = list(range(len(docs)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if (docs[i][1] or "") == (docs[j][1] or "") or both and both >= least * (len(sets[i]) + len(sets[j]) - both) - 1e-9:
                up[root(i)] = root(j)
    classes = defaultdict(list)
    for i, (d, _) in enumerate(docs):
        classes[root(i)].append(d)
    return Counter((d, min((x for x in ids if x is not None), default=None), len(ids)) for ids in classes.values() for d in ids)


def near_copies(count):
    out = []
    for k in range(count):
        w = prose(300 + k // 5, 150).split()
        w[(k * 31) % 150] = f"new{k}"
        out.append((1000 + k, " ".join(w)))
    return out


def test_near_duplicate_classes(spark, odd_rows):
    docs = odd_rows + near_copies(60)
    got = near_dedup.near_duplicate_classes(frame(spark, docs)).collect()
    assert Counter((r["doc_id"], r["class_id"], r["class_size"]) for r in got) == brute_classes(docs)
    assert near_dedup.near_duplicate_classes(empty(spark)).count() == 0


def test_a_large_bucket_becomes_one_class(spark):
    base = prose(400, 200).split()
    docs = []
    for k in range(700):
        w = list(base)
        w[k % 200] = f"v{k}"
        docs.append((k, " ".join(w)))
    got = near_dedup.near_duplicate_classes(frame(spark, docs, extra=False)).collect()
    assert {r["class_id"] for r in got} == {0} and {r["class_size"] for r in got} == {700}


def in_one_bucket(monkeypatch):
    monkeypatch.setattr(near_dedup, "band_hashes", lambda signature, bands, rows: np.zeros((len(signature), bands), dtype=np.uint64))


def test_every_pair_of_a_bucket_is_tested(spark, monkeypatch):
    in_one_bucket(monkeypatch)
    docs = []
    for k in range(90):
        w = prose(500 + k // 2, 150).split()
        w[(k * 31) % 150] = f"new{k}"
        docs.append((k, " ".join(w)))
    got = near_dedup.near_duplicate_classes(frame(spark, docs, extra=False), bands=1).collect()
    assert Counter((r["doc_id"], r["class_id"], r["class_size"]) for r in got) == brute_classes(docs)


def test_components_by_stars_equal_those_of_one_task(spark, monkeypatch):
    edges = [(k, k + 1) for k in range(0, 60) if k % 7] + [(100, k) for k in range(101, 400)] + [(5, 200)]
    table = spark.createDataFrame([(min(e), max(e)) for e in edges], "a long, b long")
    small = Counter(map(tuple, near_dedup.components(table).collect()))
    monkeypatch.setattr(near_dedup, "SMALL", 0)
    assert Counter(map(tuple, near_dedup.components(table).collect())) == small


def test_buckets_beyond_the_limits_are_tested_to_the_end(spark, monkeypatch):
    """One bucket of many clusters, few members a turn, tiny cells, no broadcast."""
    in_one_bucket(monkeypatch)
    monkeypatch.setattr(near_dedup, "OTHERS", 5)
    monkeypatch.setattr(near_dedup, "CELL", 400)
    monkeypatch.setattr(near_dedup, "SMALL", 0)
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    docs = []
    for k in range(120):
        w = prose(500 + k // 3, 60 + k % 40).split()
        w[(k * 31) % 60] = f"new{k}"
        docs.append((k, " ".join(w)))
    got = near_dedup.near_duplicate_classes(frame(spark, docs, extra=False), bands=1).collect()
    assert Counter((r["doc_id"], r["class_id"], r["class_size"]) for r in got) == brute_classes(docs)


def test_every_member_of_a_large_component_counts(spark, monkeypatch):
    in_one_bucket(monkeypatch)
    docs, w = [], prose(600, 200).split()
    for k in range(16):
        w[k * 5 % 200 : k * 5 % 200 + 3] = [f"a{k}", f"b{k}", f"c{k}"]
        docs.append((k, " ".join(w)))
        side = list(w)
        side[(k * 5 + 60) % 200 : (k * 5 + 60) % 200 + 14] = [f"s{k}x{j}" for j in range(14)]
        docs.append((100 + k, " ".join(side)))
    got = near_dedup.near_duplicate_classes(frame(spark, docs, extra=False), bands=1).collect()
    want = brute_classes(docs)
    assert max(size for _, _, size in want) > 16
    assert Counter((r["doc_id"], r["class_id"], r["class_size"]) for r in got) == want


def test_one_document_of_each_class_stays(spark, odd_rows):
    docs = frame(spark, odd_rows + near_copies(30))
    out = near_dedup.drop_near_duplicates(docs)
    assert out.columns == docs.columns
    want = brute_classes(odd_rows + near_copies(30))
    assert out.count() == sum(1 / size * n for (_, _, size), n in want.items())


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(1)
    e = rng.integers(1, 2**62, size=400, dtype=np.uint64)
    a, b = rng.uniform(0.2, 5, 400), rng.uniform(0.2, 5, 400)
    a[:100] = 0
    b[300:] = 0
    keep_a, keep_b = a > 0, b > 0
    both = np.concatenate([e[keep_a], e[keep_b]])
    sig = near_dedup.signatures(both, np.concatenate([a[keep_a], b[keep_b]]), np.repeat([0, 1], [keep_a.sum(), keep_b.sum()]), 2, 4000)
    assert abs((sig[0] == sig[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.03


# ---- 5 ----------------------------------------------------------------------------------------------


def brute_backoff(ids, order):
    import math

    grams = lambda x: Counter(tuple(x[i : i + n]) for n in range(1, order + 1) for i in range(len(x) - n + 1))
    corpus, out = Counter(), []
    for x in ids:
        corpus.update(grams(x))
    total = sum(map(len, ids))
    for x in ids:
        own, rest = grams(x), total - len(x)
        left = lambda g: corpus[g] - own[g]  # noqa: B023, E731
        score, backed, unseen = 0.0, 0, 0
        for i in range(len(x)):
            gram, factor = tuple(x[max(0, i - order + 1) : i + 1]), 1.0
            backed += len(gram) > 1 and not left(gram)
            unseen += not left(gram[-1:])
            while gram and not left(gram):
                gram, factor = gram[1:], factor * 0.4
            score += math.log(factor * (left(gram) / (left(gram[:-1]) if len(gram) > 1 else rest) if gram else 1 / (rest + 1)))
        out.append((len(x), score, backed, unseen))
    return out


@pytest.mark.parametrize("order", [2, 3])
@pytest.mark.parametrize("limits", [{}, {"part_tokens": 50, "hot_grams": 0}, {"part_tokens": 700, "hot_grams": 40}])
def test_backoff_scores(spark, odd_rows, order, limits):
    encode = token_counts.fast_encoder(BPE)
    ids = [[int(x) for x in encode([t or ""])[0]] for _, t in odd_rows]
    got = lm_backoff.backoff_scores(frame(spark, odd_rows), BPE, order=order, **limits).collect()
    want = sorted(brute_backoff(ids, order))
    got = sorted((r["n_tokens"], r["log_score"], r["n_backoff"], r["n_unseen"], r["score"]) for r in got)
    assert np.allclose([r[:4] for r in got], want)
    assert all(r[4] is None if not r[0] else np.isclose(r[4], r[1] / r[0]) for r in got)
    assert lm_backoff.backoff_scores(empty(spark), BPE, order=order).count() == 0


def test_the_hot_table_is_bounded(spark):
    counts = spark.range(1, 2000).select(F.col("id").alias("gram"), (F.lit(4000) / F.col("id")).cast("long").alias("total"))
    for most in (0, 1, 10, 100, 5000):
        cutoff = lm_backoff.hot_cutoff(counts, most)
        assert counts.where(F.col("total") >= cutoff).count() <= most
    assert lm_backoff.hot_cutoff(counts, 5000) <= 2


# ---- 7 ------------------------------------------------------------------------------------------------


def test_licenses_anywhere_in_a_line():
    scan = license_scan.scanner(tuple(license_scan.TEMPLATES.items())).scan
    for name, notice in license_scan.TEMPLATES.items():
        for text in ("(c) 2021 Example Corp and all contributors; " + notice, prose(3, 90) + ": " + notice + " " + prose(4, 90), notice.replace(" ", "      ")):
            assert [m["license"] for m in scan(text)[1]] == [name]
    low = "(c) 2021 Example Corp and all contributors; released under the MIT License."
    assert [low[m["start"] : m["end"]] for m in scan(low)[1]] == ["released under the MIT License"]


def test_license_scan(spark, odd_rows):
    mit = license_scan.TEMPLATES["mit"]
    docs = odd_rows + [
        (300, prose(1, 30) + "\nReleased under the MIT License.\n" + prose(2, 30)),
        (301, "Licensed under the Apache License, Version 2.0.\nAll rights reserved."),
        (302, "Copyright (c) 2020\n" + mit.replace("Software", "Library").replace(", ", ",\n")),
        (303, "The licensed premises were closed; his license had lapsed and no rights were left."),
        (304, "é 😀\n" + license_scan.TEMPLATES["apache-2.0-header"]),
    ]
    got = {r["doc_id"]: r for r in license_scan.license_scan(frame(spark, docs)).collect() if r["doc_id"] is not None and r["doc_id"] >= 300}
    assert got[300]["licenses"] == ["mit-notice"] and got[301]["licenses"] == ["all-rights-reserved", "apache-2.0-notice"]
    assert got[302]["licenses"] == ["mit"] and "-software" in got[302]["matches"][0]["wording"] and got[302]["matches"][0]["missing"] > 0
    assert got[303]["licenses"] == [] and got[303]["n_blocks"] > 0
    assert got[304]["licenses"] == ["apache-2.0-header"]
    for i, t in docs[-5:]:
        for m in got[i]["matches"]:
            assert t[m["start"] : m["end"]].strip() == t[m["start"] : m["end"]]
    assert license_scan.license_scan(empty(spark)).count() == 0


def brute_license(text):
    """The license of a text with one notice at most: every template against every stretch of about its length, no cue words."""
    import difflib

    w = [m.group().lower() for m in license_scan.WORD.finditer(text)]
    best = None
    for name, template in license_scan.TEMPLATES.items():
        t = [m.group().lower() for m in license_scan.WORD.finditer(template)]
        limit = license_scan.MOST_DIFFERENT * len(t)
        for a in range(len(w)):
            if w[a] not in t[: int(limit) + 1]:
                continue
            for b in range(a + len(t) - int(limit), min(len(w), a + len(t) + int(limit)) + 1):
                part = w[a:b]
                common = sum(x.size for x in difflib.SequenceMatcher(None, t, part, autojunk=False).get_matching_blocks())
                differ = len(t) + len(part) - 2 * common
                if differ <= limit and (best is None or len(t) - differ > best[0]):
                    best = len(t) - differ, name
    return best and best[1]


def test_licenses_against_every_stretch():
    rng = random.Random(4)
    scan = license_scan.scanner(tuple(license_scan.TEMPLATES.items())).scan
    for k, (name, notice) in enumerate([*license_scan.TEMPLATES.items()] * 2 + [("", "the licensed trade lapsed")] * 3):
        w = notice.split()
        for _ in range(int(len(w) * rng.choice([0, 0.05, 0.1, 0.3]))):
            w[rng.randrange(1, max(2, len(w) - 1))] = rng.choice(["quite", "other", ""])
        text = prose(700 + k, rng.randint(0, 40)) + " " + " ".join(x for x in w if x) + " " + prose(800 + k, rng.randint(0, 40))
        found = [m["license"] for m in scan(text)[1]]
        assert found == ([want] if (want := brute_license(text)) else [])
