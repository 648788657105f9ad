"""Operators of quarry.llm against plain versions of the same rules, on small and awkward inputs."""

import hashlib
import json
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from quarry.llm import chat, decontam, embed_dedup, html, langid, license_scan, packing, sharding, simhash, toxicity
from quarry.llm.common import connected

SF = "/root/testdata/sf0.001"
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp long, shard int, part int, rank int, pair int"
AWKWARD = [None, "", " \n\t", "word", "Zwei  Wörter", "a b c d e f g h i j k l", "a b c d e f g h i j k l", "%%% ### 5", "x" * 5000, "ab " * 20000, "中文 テキスト", "it's 3½ — ‘quoted’ İstanbul ΑΣ é", "\x00\x0b\x1f\x85  z", "<|endoftext|> </s>"]


def docs(spark, texts, ids=None):
    rows = [(i if ids is None else ids[i], t, "en", "s", None, 7, 7, 7, 7, 7) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def words_of(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


@pytest.fixture(scope="module")
def real(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# --- 1 SimHash ---------------------------------------------------------------------------------


def plain_fingerprint(text):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    ones = Counter(b for s in shingles for b in range(64) if xxhash.xxh64_intdigest(s.encode(), 42) >> b & 1)
    return sum(1 << b for b, n in ones.items() if n * 2 > len(shingles))


def plain_components(items, linked):
    root = {i: i for i in items}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in items:
        for b in items:
            if a < b and linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in items}


def test_simhash_equals_plain_version(spark, real):
    texts = AWKWARD + [r.text for r in real.orderBy("doc_id").limit(120).collect()]
    base = texts[-1]
    texts += [base + f" end{i}" for i in range(30)] + [base] * 5
    want = {i: plain_fingerprint(t) for i, t in enumerate(texts)}
    comp = plain_components(list(want), lambda a, b: (want[a] ^ want[b]).bit_count() <= 3)
    for tile in (1 << 15, 8):
        got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.groups(docs(spark, texts), tile=tile).collect()}
        assert got == {i: (f"{want[i]:016x}", comp[i]) for i in want}


def test_simhash_keep_one_null_ids_and_empty(spark):
    d = docs(spark, ["one two three four", "one two three four", None, "", "alone here now"], [5, 3, 8, 9, None])
    kept = simhash.keep_one(d)
    assert kept.columns == d.columns
    assert sorted((r.doc_id if r.doc_id is not None else -1) for r in kept.collect()) == [-1, 3, 8]
    assert simhash.groups(d.limit(0)).count() == 0 and simhash.keep_one(d.limit(0)).count() == 0
    assert Counter(r.component_id for r in simhash.groups(docs(spark, ["a b c"] * 3, [4, 4, 2])).collect()) == {2: 3}


def test_keep_one_with_shared_ids_and_clashing_names(spark):
    d = docs(spark, ["a b c d", "a b c d", "x y z w", "x y z w", "q r s t"], [1, 2, 3, 3, None]).withColumn("__rank", F.lit("r")).withColumn("__gone", F.lit(1)).withColumn("tile", F.lit(1))
    for sent in (simhash.SENT_IDS, 0):
        simhash.SENT_IDS, held = sent, simhash.SENT_IDS
        try:
            for kept in (simhash.keep_one(d), simhash.keep_verified(d)):
                assert kept.columns == d.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "3", "None"]
        finally:
            simhash.SENT_IDS = held


def plain_shingles(text):
    w = text.lower().split()
    return {" ".join(w[i : i + 5]) for i in range(len(w) - 4)} or {" ".join(w)}


@given(st.lists(st.integers(0, 400), min_size=1, max_size=80), st.integers(1, 9))
def test_tiles_of_sizes_let_similar_sets_meet(sizes, tile):
    classes = defaultdict(list)
    for x in sizes:
        classes[int(np.log(x + 1) / np.log(simhash.SIZE_STEP))].append(x)
    rows = [(c, len(v), min(v), max(v)) for c, v in sorted(classes.items())]
    places, first, last = simhash.size_tiles(rows, tile)
    held = Counter()
    own = {c: range(t, t + n) for (c, *_), (t, n) in zip(rows, places, strict=True)}
    for (c, n, *_), (t, cut) in zip(rows, places, strict=True):
        held[t] += n
        assert cut == 1 or -(-n // cut) <= tile
    assert all(n <= tile for t, n in held.items() if sum(t in r for r in own.values()) > 1)
    for a, v in classes.items():
        for b, w in classes.items():
            if any(5 * min(x, y) >= 4 * max(x, y) for x in v for y in w):
                assert all(first[max(i, j)] <= min(i, j) and last[min(i, j)] >= max(i, j) for i in own[a] for j in own[b])


def test_pipeline_drops_near_copies_by_shingles(spark):
    rng = random.Random(8)
    texts = []
    for _ in range(25):
        w = [f"w{rng.randrange(400)}" for _ in range(rng.choice((60, 150, 300)))]
        for n in (0, 1, 2, 4):
            v = list(w)
            for at in rng.sample(range(len(v)), n):
                v[at] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(v))
    texts += [texts[0].upper() + " ", "one two", "one two three"]
    sets = [plain_shingles(t) for t in texts]
    jaccard = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    comp = plain_components(range(len(texts)), lambda a, b: jaccard(a, b) >= 0.8)
    fp = [plain_fingerprint(t) for t in texts]
    assert sum((fp[a] ^ fp[b]).bit_count() > 3 for a, b in comp.items()) > 10
    kept = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs(spark, texts), SF).collect()}
    assert kept == set(comp.values())
    for group in (simhash.GROUP, 2, 1):  # 1: every group is compared with its leader, the rest in blocks
        got = {r.doc_id: r.component_id for r in simhash.near_groups(docs(spark, texts), tile=20, group=group).collect()}
        assert got == comp


def test_connected_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1200)] + [(5000, 5000 + i) for i in range(1, 300)] + [(None, 4), (7, 7)]
    nodes = {x for e in edges if None not in e and e[0] != e[1] for x in e}
    near = defaultdict(set)
    for a, b in edges:
        if a is not None and a != b:
            near[a].add(b)
            near[b].add(a)
    want = {}
    for n in sorted(nodes):
        todo = [n]
        while todo:
            x = todo.pop()
            if x not in want:
                want[x] = n
                todo += near[x]
    got = {r.node: r.root for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == want


# --- 2 licenses --------------------------------------------------------------------------------


def plain_base(text):
    w = words_of(text)
    out = [(i, label) for phrase, label in license_scan.BASE for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
    return len(w), sorted(out)


def test_license_base_equals_plain_version(spark, real):
    texts = AWKWARD + ["CC-BY 4.0, cc by. acc by cc byte", "under the General\nPublic  license; all rights reserved. All Rights Reserved", "all rights", "reserved", "cc", "by"] + [r.text for r in real.collect()]
    got = {r.doc_id: r for r in license_scan.scan(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        n, base = plain_base(t)
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (n, len(base), min(base)[0] if base else None, max(base)[0] if base else None)
        assert r.base_labels == ",".join(sorted({x for _, x in base})) and {x for _, x in base} <= set(r.labels.split(",")) | ({""} if not base else set())
        assert 0 <= r.score <= 1 and (r.score == 1) >= bool(base)


def test_license_fuzzy_spans(spark):
    texts = ["x y Licensed undr the Apache License, Versoin 2.0 z", "nothing at all here", "all rigths reserved", "Permission is hereby granted, fre of charge, to any person obtaining a copy"]
    got = [r for r in license_scan.scan(docs(spark, texts)).orderBy("doc_id").collect()]
    assert got[0].labels == "apache-2.0" and (got[0].notices[0].first, got[0].notices[0].last) == (2, 9) and 0 < got[0].score < 1
    assert got[1].labels == "" and got[1].score == 0
    assert got[2].labels == "reserved" and got[2].base_labels == "" and got[2].n_base == 0
    assert got[3].labels == "mit"


def test_notices_of_neighbouring_rows_and_long_texts(spark):
    cut = "ensed under the mit license"  # three letters are missing
    texts = ["so licensed under the mit license", cut + " here", "word " * 200_000 + "licensed undr the mit license", "licensed under the mit license " + cut] + [cut] * 3
    d = docs(spark, texts).coalesce(1)
    got = {r.doc_id: r for r in license_scan.scan(d).collect()}
    assert all(got[i].labels == "mit" for i in got) and got[2].notices[0].first == 200_000 and got[2].n_words == 200_005
    assert sum(h.label == "mit" for h in got[3].notices) >= 2 and license_scan.scan(d.limit(0)).count() == 0


def test_long_notices_allow_an_edit_in_nine_characters():
    scanner = license_scan.Scanner()
    for text, label, edits in (("licensd under the apacha license versoin 2 0", "apache-2.0", 4), ("licensd under the apacha licensx versoin 2 0", "apache-2.0", 5), ("licxnsed undxr the mit licxnse", "mit", 3)):
        found = [h for h in license_scan.scan_text(scanner, "so " + text + " here")[2] if h.label == label]
        assert found and min(h.edits for h in found) == edits


def test_pigeonhole_misses_no_notice():
    rng = random.Random(1)
    scanner = license_scan.Scanner()
    for notice, label in license_scan.NOTICES:
        for _ in range(10):
            text = list(notice)
            for _ in range(license_scan.edits_of(notice)):
                i = rng.randrange(len(text))
                if text[i] != " ":
                    text[i] = rng.choice(["q", text[i] + "q"])
            hits = license_scan.scan_text(scanner, "foo bar " + "".join(text) + " baz qux")[2]
            assert label in {h.label for h in hits}, "".join(text)


# --- 3 languages -------------------------------------------------------------------------------


def plain_best(scores):
    n, k = scores.shape
    value, back = scores[0].copy(), []
    for row in scores[1:]:
        move = np.argmax(value[:, None] - langid.SWITCH * (1 - np.eye(k)), axis=0)
        back.append(move)
        value = row + (value[:, None] - langid.SWITCH * (1 - np.eye(k))).max(axis=0)
    return value.max()


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 60), st.integers(1, 4), st.integers(0, 10**6))
def test_viterbi_is_best(n, k, seed):
    scores = np.random.default_rng(seed).normal(0, 6, (n, k)).repeat(2, axis=0)
    spans = langid.label(scores)
    assert spans[0][0] == 0 and spans[-1][1] == len(scores) and all(a[1] == b[0] and a[2] != b[2] for a, b in zip(spans, spans[1:], strict=False))
    total = sum(scores[a:b, c].sum() for a, b, c in spans) - langid.SWITCH * (len(spans) - 1)
    assert total == pytest.approx(plain_best(scores))


def test_language_id(spark, real):
    model = langid.fit(real)
    got = langid.identify(real, model).join(real.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.9
    odd = {r.doc_id: r for r in langid.identify(docs(spark, AWKWARD), model, with_spans=True).collect()}
    assert all(odd[i].lang_pred == "und" and odd[i].score == 0 for i in (0, 1, 2, 7))
    assert odd[10].lang_pred in model.languages and odd[10].score == 0
    en, de = (next(r.text for r in real.where(f"lang = '{x}' and n_chars > 400").orderBy("doc_id").collect())[:400] for x in ("en", "de"))
    assert [s.lang for s in langid.identify(docs(spark, [en + " " + de]), model, with_spans=True).first().spans] == ["en", "de"]
    assert langid.identify(real.limit(0), model).count() == 0
    nothing = langid.fit(real.withColumn("lang", F.lit(None).cast("string")))
    assert langid.identify(real.limit(3), nothing).first().lang_pred == "und"
    assert langid.keep_known(docs(spark, AWKWARD + [en]), model).count() >= 1


def test_unspaced_texts_are_read_whole():
    counts = [(lang, kind + x, n) for lang, letters in (("ja", "日本語です"), ("zh", "我们是中文")) for x in [*letters, *map("".join, zip(letters, letters[1:], strict=False))] for kind, n in (("g", 9),)]
    counts += [("ja", "shan", 60), ("ja", "skana", 40), ("zh", "shan", 100)]
    model = langid.build(counts)
    assert model.identify("日" * 64 + "我" * 2000)[0] == "zh" and model.identify("我" * 64 + "日" * 2000)[0] == "ja"
    assert [model.languages[k] for _, _, k in model.spans("我们是中文" * 80 + "日本語です" * 80)] == ["zh", "ja"]
    assert "".join(langid.words_of("ab" * 500 + "日本語です" * 99 + "ЖЖ")) == "ab" * 500 + "日本語です" * 99 + "жж"
    assert all(model.identify(x) == ("und", 0.0) for x in ("²³", "Ⅷ ½", "12 _ -", None, ""))


@given(st.text(st.sampled_from("abzÀßœĿŒdž9²Ⅷ_-'“éª\n я日です"), max_size=90))
def test_words_hold_every_letter(text):
    import unicodedata

    low = text.lower()
    assert "".join(langid.words_of(text)) == "".join(c for c in low if unicodedata.category(c)[0] == "L" or c == "\u0307" and "i̇" in low)


@given(st.lists(st.text("abcé", min_size=1, max_size=6), min_size=1, max_size=20), st.text("abcdé", min_size=1, max_size=40))
def test_word_scores_equal_sums_over_grams(words, word):
    grams = sorted({g for w in words for g in langid.grams_of(w)})
    scores = np.random.default_rng(len(grams)).normal(size=(len(grams), 3))
    model = langid.Model(["x", "y", "z"], [frozenset({"latin"})] * 3, grams, scores)
    row = {g: s for g, s in zip(grams, scores, strict=True)}
    want = sum((row.get(g, np.zeros(3)) for g in langid.grams_of(word)), np.zeros(3)) / len(langid.ORDERS)
    got = model.word_scores([word, *words])
    assert np.allclose(got[0, :3], np.maximum(want - want.max(), -langid.SWITCH), atol=1e-4) and (got[:, 3] == 1).all()


def test_more_languages_than_a_few_hundred(spark):
    letters = [chr(0x4E00 + i) for i in range(700)]
    d = spark.createDataFrame([(2 * i, letters[i // 2] * 30, f"l{i // 2:03}", 1) for i in range(600)], "doc_id long, text string, lang string, __other int")
    model = langid.fit(d)
    learned = {r.lang for r in d.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2).select("lang").distinct().collect()}
    assert set(model.languages) == learned and len(learned) > 250
    got = langid.identify(d.unionAll(d), model).join(d.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == 1200 and all(r.lang_pred == r.lang for r in got if r.lang in learned)


# --- 4 packing ---------------------------------------------------------------------------------


def test_packing_round_trip(spark, real):
    texts = AWKWARD + ["a <|endoftext|> b", "A<|startoftext|>b <|ENDOFTEXT|>", "a <|end oftext|>"] + [r.text for r in real.collect()]
    whole = Tokenizer.from_file(TOKENIZER)
    assert whole.encode("a <|endoftext|> b", add_special_tokens=False).ids == [320, 49407, 321]
    rows = packing.pack(docs(spark, texts), TOKENIZER, with_ids=True).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
        assert r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
    for i, t in enumerate(texts):
        parts = sorted(by_doc[i], key=lambda r: r.piece)
        want = [*whole.encode(t or "", add_special_tokens=False).ids, 1]
        assert [x for p in parts for x in p.ids] == want, repr(t)[:80]
        assert [p.start for p in parts] == list(range(0, len(want), 4096)) and all(p.length == 4096 for p in parts[:-1])
    for parts in by_sequence.values():
        at = 0
        for p in sorted(parts, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 4096
    assert len(by_sequence) <= 1.02 * sum(r.length for r in rows) / 4096 + 1
    assert packing.pack(docs(spark, []), TOKENIZER).count() == 0
    same = packing.pack(docs(spark, ["one two"] * 4, [3, 3, None, None]), TOKENIZER).collect()
    assert Counter(r.doc_id for r in same) == {3: 2, None: 2} and len({(r.sequence_id, r.offset) for r in same}) == 4


def plain_best_fit(lengths, capacity):
    bins = []
    for n in sorted(lengths, reverse=True):
        fit = [i for i, r in enumerate(bins) if r >= n]
        if fit:
            bins[min(fit, key=lambda i: bins[i])] -= n
        else:
            bins.append(capacity - n)
    return len(bins)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=120))
def test_plan_is_best_fit_decreasing(lengths):
    rows = packing.plan(dict(Counter(lengths)), 50)
    used = {s for length, first, copies, seq, _ in rows for s in range(seq, seq + 1)}
    bins = defaultdict(int)
    ends = packing._ends(rows)
    for length, n in sorted(Counter(lengths).items(), reverse=True):
        for rank in range(n):
            (row,) = [r for r in ends if r[0] == length and r[1] <= rank < r[2]]
            over = rank - row[1]
            assert bins[row[4] + over // row[3]] == row[5] + over % row[3] * length
            bins[row[4] + over // row[3]] += length
    assert len(bins) == plain_best_fit(lengths, 50) and all(x <= 50 for x in bins.values()) and used <= set(bins)


def test_plan_by_join_equals_broadcast(spark, real):
    lengths = [random.Random(i).randrange(1, 60) for i in range(3000)]
    rows = packing.plan(dict(Counter(lengths)), 64)
    seen, ranked = Counter(), []
    for n in lengths:
        ranked.append((n, seen[n]))
        seen[n] += 1
    df = spark.createDataFrame(ranked, "length long, rank long")
    ends = spark.createDataFrame(packing._ends(rows), "length long, first_rank long, end_rank long, copies long, first_sequence long, first_offset long")
    cols = ["length", "rank", "sequence_id", "offset"]
    assert sorted(packing._by_join(df, ends, 16).select(*cols).collect()) == sorted(packing._by_broadcast(df, rows).select(*cols).collect())


# --- 5 embeddings ------------------------------------------------------------------------------


def test_embeddings_against_brute_force(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 64))
    rows = [c / np.linalg.norm(c) + rng.normal(scale=s, size=64) for c in centres for s in (0.012, 0.02, 0.025, 0.028, 0.03)]
    rows += [rows[0]] * 7 + [3 * rows[0]]
    vectors = [list(map(float, r)) for r in rows] + [None, [], [0.0] * 64, [float("nan")] * 64, [float("inf")] + [1.0] * 63, [None] + [1.0] * 63, [1.0] * 3, [1e200] * 64]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>, label int, unit int")
    good = [i for i, v in enumerate(vectors) if v and len(v) == 64 and None not in v and np.isfinite(v).all() and any(v)]
    x = np.array([vectors[i] for i in good])
    x = x / np.abs(x).max(axis=1, keepdims=True)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    close = x @ x.T >= 0.95
    want = {i: [j for b, j in enumerate(good) if b != a and close[a, b]] for a, i in enumerate(good)}
    for block in (1 << 15, 64):
        got = {r.vec_id: r for r in embed_dedup.groups(df, block=block).collect()}
        assert len(got) == len(vectors)
        assert all(got[i].n_links <= len(want.get(i, ())) for i in got)
        assert sum(r.n_links for r in got.values()) >= 0.9 * sum(map(len, want.values()))
        assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i in got if i not in want)
        comp = {i: got[i].component_id for i in good}
        assert all(comp[j] == comp[i] or abs(x[good.index(i)] @ x[good.index(j)] - 0.95) < 0.01 for i in good for j in want[i])
        assert all(got[i].kept == (i == got[i].component_id) for i in got)
    assert embed_dedup.groups(df.limit(0)).count() == 0


# --- 6 decontamination -------------------------------------------------------------------------


def plain_hits(text, items):
    w = words_of(text)
    hit, found = set(), set()
    for item, t in items:
        iw = words_of(t)
        n = min(10, len(iw))
        windows = {tuple(iw[i : i + n]) for i in range(len(iw) - n + 1)} if n else set()
        for i in range(len(w) - n + 1 if n else 0):
            if tuple(w[i : i + n]) in windows:
                hit |= set(range(i, i + n))
                found.add(str(item))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def test_decontamination_equals_plain_version(spark, real, monkeypatch):
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").limit(12).collect()]
    bench += [(900, None), (901, ""), (902, "A, b. C"), (903, "word"), (904, "a b c d e f g h i j k l"), (11, "k l m n o p q r s t u v w")]
    some = words_of(bench[0][1])
    texts = AWKWARD + ["x " + " ".join(some[2:13]) + " y", " ".join(some[:9]), "a b c d e f g h i j x k l m n o p q r s t u v w", "k l m n o p q r s t u v w"] + [t for _, t in bench if t] + [r.text for r in real.limit(60).collect()]
    d = docs(spark, texts)
    b = spark.createDataFrame(bench, "item_id long, text string").withColumn("doc_id", F.lit(1))
    want = {i: plain_hits(t, bench) for i, t in enumerate(texts)}
    assert sum(x[4] for x in want.values()) > 8
    for sent in (decontam.SENT_BYTES, 0):
        monkeypatch.setattr(decontam, "SENT_BYTES", sent)
        monkeypatch.setattr(decontam, "ROW_PRINTS", 4096 if sent else 2)
        got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontam.measure(d, b).collect()}
        assert got == want
        assert {r.doc_id for r in decontam.clean(d, b).collect()} == {i for i, x in want.items() if not x[4]}
    assert decontam.measure(d, b.limit(0)).where("contaminated").count() == 0 and decontam.clean(d, b.limit(0)).count() == len(texts)
    assert decontam.measure(d.limit(0), b).count() == 0 and decontam.clean(d.limit(0), b).count() == 0
    twice = docs(spark, [texts[-1]] * 3, [1, 1, None])
    assert decontam.measure(twice, b).count() == 3 and decontam.clean(twice, b).columns == twice.columns
    named = decontam.measure(d.withColumn("doc_id", F.concat(F.lit("k"), "doc_id")), b.withColumn("item_id", F.concat(F.lit("i"), "item_id"))).collect()
    assert {r.doc_id: r.n_hit for r in named} == {f"k{i}": x[1] for i, x in want.items()}
    runs = {(r.doc_id, r.item_id): (r.first, r.end) for r in decontam.spans(d, b).collect()}
    i = texts.index("x " + " ".join(some[2:13]) + " y")
    assert runs[(i, str(bench[0][0]))] == (1, 12)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("abc"), min_size=1, max_size=60), st.lists(st.sampled_from("abc"), min_size=1, max_size=60))
def test_winnowing_misses_no_shared_span(a, b):
    def prints(words, spans, whole):
        raw = np.frombuffer(" ".join(words).encode(), np.uint8)
        w = decontam.Words(np.array([0, len(raw)]), raw)
        hashed = decontam.Hasher().words(w)
        return [p for s in spans for _, p in decontam.prints_of(w, *decontam.winnow(w, hashed, s, whole=whole), s)]

    n = min(10, len(b))
    hit = set()
    for p in prints(a, [n], False):
        for q in prints(b, range(1, 11), True):
            if (p["hash"], p["span"]) == (q["hash"], q["span"]) and (reach := decontam.extended(n, p["left"], p["context"], q["left"], q["context"])):
                hit |= set(range(p["at"] - reach[0], p["at"] + min(5, n) + reach[1]))
    assert hit == {x for i in range(len(a) - n + 1) if any(a[i : i + n] == b[j : j + n] for j in range(len(b) - n + 1)) for x in range(i, i + n)}


# --- 7 toxicity --------------------------------------------------------------------------------


def plain_distance(a, b):
    d = np.zeros((len(a) + 1, len(b) + 1), int)
    d[:, 0], d[0] = np.arange(len(a) + 1), np.arange(len(b) + 1)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[-1, -1]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text("abc", min_size=1, max_size=7), min_size=1, max_size=5, unique=True), st.text("abcd", max_size=9), st.integers(0, 2))
def test_automaton_equals_edit_distance(terms, word, edits):
    lexicon = toxicity.Lexicon([toxicity.Term(t, False, edits) for t in terms])
    weight, exact = lexicon.find(word)
    assert exact == (word in terms) and (weight > 0) == any(plain_distance(t, word) <= edits for t in terms)


def test_labels_with_nothing_to_learn(spark):
    d = docs(spark, ["one", "two", None])
    for toxic in (0, 1):
        model = toxicity.fit(d, spark.createDataFrame([(i, toxic) for i in range(3)], "doc_id long, toxic int"))
        assert toxicity.score(d, model).where("predicted = 1").count() == 0


def test_toxicity(spark, real):
    bad = ["you are such a blorgot and a wimfret", "what a blorgot wimfret thing", "blorgot blorgot they are all wimfret"]
    some = random.Random(7)
    texts = []
    for i in range(400):
        plain = ["".join(some.choice(["ka", "mi", "to", "ren", "sul"]) for _ in range(some.randrange(2, 5))) for _ in range(60)]
        texts.append(" ".join(plain[:30] + [bad[i % 3]] * (i % 4 == 0) + plain[30:]))
    d = docs(spark, texts)
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(400)] + [(3, 1, None), (None, 1, 1), (9999, 0, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(d, labels)
    assert {"blorgot", "wimfret"} <= {t.text for t in model.terms}
    got = toxicity.score(d, model).collect()
    assert all(r.predicted == (r.doc_id % 4 == 0) and 0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert model.score("these people are blrogot and wimfrett") > 0.5 > model.score('he said the word "blorgot" was new to him in the long report that he read out')
    odd = toxicity.score(docs(spark, AWKWARD), model).collect()
    assert len(odd) == len(AWKWARD) and all(r.predicted == 0 for r in odd)
    assert toxicity.keep_clean(d, model).count() == 300
    again = toxicity.fit(d.unionAll(d).withColumn("toxic", F.lit(5)), labels.unionAll(labels))
    assert again.terms == model.terms and np.allclose(again.curve, model.curve)
    assert Counter((r.doc_id, r.predicted) for r in toxicity.score(d.unionAll(d), model).collect()) == Counter({(i, int(i % 4 == 0)): 2 for i in range(400)})
    none = toxicity.fit(d, labels.limit(0))
    assert toxicity.score(d.limit(2), none).where("predicted = 1").count() == 0 and toxicity.score(d.limit(0), none).count() == 0


# --- 8 sharding --------------------------------------------------------------------------------


def plain_jump(key, shards):
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) & (1 << 64) - 1
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_sharding(spark):
    texts = AWKWARD + [f"text {i}" for i in range(500)]
    ids = list(range(len(texts)))
    ids[:4] = [None, -5, 1 << 62, 77]
    rows = sharding.assign(docs(spark, texts, ids).repartition(5)).collect()
    assert len(rows) == len(texts)
    slots = defaultdict(list)
    for r in rows:
        key = (r.doc_id or 0) & (1 << 64) - 1
        assert (r.shard, r.grown_shard) == (plain_jump(key, 8), plain_jump(key, 9)) and r.grown_shard in (r.shard, 8)
        slots[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    want = Counter((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for t in texts)
    assert Counter((r.size, r.text_crc32) for r in rows) == want
    assert sharding.assign(docs(spark, [])).count() == 0
    named = sharding.assign(docs(spark, ["a", "a", "b", None], [1, 1, 2, None]).withColumn("doc_id", F.concat(F.lit("k"), "doc_id"))).collect()
    assert len(named) == 4 and len({r.shard for r in named if r.doc_id == "k1"}) == 1 and {r.shard for r in named if r.doc_id is None} == {plain_jump(0, 8)}


def test_shard_files(spark, tmp_path):
    d = docs(spark, AWKWARD).withColumn("odd name", F.struct(F.lit(1).alias("a b")))
    sharding.write_shards(d, str(tmp_path / "out"), 3)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == len(AWKWARD) and set(back.columns) == set(d.columns)
    assert all(r.shard == plain_jump(r.doc_id, 3) for r in back.select("doc_id", "shard").collect())


# --- 9 chat ------------------------------------------------------------------------------------


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a\nb", "<|end|>", ""]), st.one_of(st.text(), st.lists(st.sampled_from(["<|turn|>", "<|end|>\n", "</s>", "[INST]", "[/INST]", "\\", "\\l", "<", "|", "\n", "x"])).map("".join)))))
def test_template_round_trip(turns):
    turns = [(r, t.encode("utf-8", "ignore").decode()) for r, t in turns]
    done = [chat.render(*t) for t in turns]
    assert chat.parse("".join(x for x, _, _ in done)) == turns
    assert [chat.unescape(x[a:b]) for x, a, b in done] == [t if r == "assistant" else "" for r, t in turns]
    assert not any(c in chat.escape(t) for _, t in turns for c in ("<|", "</s>", "[INST]", "[/INST]"))


def test_layouts(spark):
    records = {
        1: {"messages": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": None}]},
        2: {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}], "system": "be kind"},
        3: {"instruction": "do", "input": "this", "output": "done"},
        4: {"prompt": "p", "response": "r"},
        5: {"dialog": {"turns": [{"speaker": "bot", "text": "t"}]}},
        6: {"strange": [1, 2]},
    }
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in records.items()] + [(7, None), (8, "{broken")], "conv_id long, record string")
    known, unknown = chat.records_to_turns(df)
    got = defaultdict(list)
    for r in known.orderBy("conv_id", "turn").collect():
        got[r.conv_id].append((r.role, r.text))
    assert got == {
        1: [("user", "hi"), ("assistant", "")],
        2: [("system", "be kind"), ("user", "q"), ("assistant", "a")],
        3: [("user", "do\n\nthis"), ("assistant", "done")],
        4: [("user", "p"), ("assistant", "r")],
        5: [("assistant", "t")],
    }
    assert {r.conv_id: r.schema_fingerprint is not None for r in unknown.collect()} == {6: True, 7: False, 8: False}
    with pytest.raises(ValueError):
        chat.rows_to_turns(df)
    paths = {"conv_id", "turn", "role", "text"}
    known = chat.fingerprint(paths)
    assert chat.mapping_of(paths) == (known, chat.MAPPINGS[known]) and chat.mapping_of(paths | {"system", "prompt", "x.y"})[0] == known
    assert chat.mapping_of(paths - {"turn"})[1] is None and chat.mapping_of({"prompt", "response", "system"})[0] == chat.fingerprint({"prompt", "response", "system"})


def test_chat_digests(spark):
    rows = [(1, 1, "assistant", "b<|end|>"), (1, 0, "user", None), (1, 2, None, "c"), (2, 0, "assistant", "x"), (2, 0, "assistant", "x"), (None, 0, "assistant", "n"), (3, None, "user", "[INST]")]
    df = spark.createDataFrame([(*r, 5, "p") for r in rows], "conv_id long, turn long, role string, text string, formatted int, prompt string")
    got = {r.conv_id: r for r in chat.digests(chat.format_turns(chat.rows_to_turns(df))).collect()}

    def sha(x):
        return hashlib.sha256(x.encode()).hexdigest()

    assert got[1].turns_sha256 == sha("user\n\nassistant\nb<|end|>\n\nc\n") and got[1].loss_sha256 == sha("b<|end|>") and got[1].loss_chars == 8
    assert got[2].n_turns == 2 and got[2].loss_sha256 == sha("xx") and set(got) == {1, 2, 3, None}
    assert chat.digests(chat.format_turns(chat.rows_to_turns(df.limit(0)))).count() == 0


# --- 10 pages ----------------------------------------------------------------------------------

PAGE = """<!doctype html><html><head><title>no</title><style>p{}</style><script>var a="</p><p>no</p>";</script></head><body>
<header><h1>Site</h1><nav><ul><li><a href=/a>Home</a><li><a href="/b>c">About</a></ul></nav></header>
<div class="cookie-notice">We use cookies to make this long sentence about cookies even longer. Accept them all, please.</div>
<main><article><h1>The   title</h1><p>First &amp; best&nbsp;paragraph.<p>Second<br>line <b>bold</b>.
<ul><li>one item<li>two items</ul><aside>See <a href=x>other</a></aside><form><label>Mail me</label><input></form>
<div class=ad>Buy now! It is a very good thing, and it is cheap, and everybody has one by now.</div>
<table><tr><td>Cell a<td>Cell b</table><section id="comments"><p>Great post, I liked it very much, thank you for this.</p></section></article></main>
<aside>Popular</aside><footer><p>&copy; 2020 Somebody. All rights reserved by somebody.</p></footer></body></html>"""


def test_page_parts():
    assert html.main_text(PAGE) == "The title\nFirst & best paragraph.\nSecond line bold.\none item\ntwo items\nCell a\nCell b"


ARTICLE = "<p>The river rose over night, and the bridge below the mill was closed to all carts until the water fell again.</p>" * 3


@pytest.mark.parametrize("attrs", ['aria-hidden="false"', 'href="/hidden-gems"', 'title="the hidden cost"', "data-hidden", 'data-class="sidebar"'])
def test_hidden_only_by_its_own_attribute(attrs):
    assert "river" in html.main_text(f"<html><body><article {attrs}>{ARTICLE}</article></body></html>")


@pytest.mark.parametrize("attrs", ["hidden", 'hidden=""', 'class="x" HIDDEN', 'aria-hidden="true"', 'style="display: none"'])
def test_hidden_elements_are_silent(attrs):
    assert html.main_text(f"<html><body><article {attrs}>{ARTICLE}</article></body></html>") == ""


@pytest.mark.parametrize("name", ["page has-sidebar", "header-fixed"])
def test_layout_classes_of_the_page_are_no_boilerplate(name):
    assert "river" in html.main_text(f'<html class="{name}"><body class="{name}"><article>{ARTICLE}</article></body></html>')
    assert html.main_text(f'<html><body><div class="{name}">{ARTICLE}</div></body></html>') == ""


def test_pages_of_the_tables(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    import html as std

    for r in html.extract(pages).join(pages.select("page_id", "html"), "page_id").collect():
        inner = re.search("<article>(.*)</article>", r.html, re.S).group(1)
        want = [re.sub(r"\s+", " ", std.unescape(re.sub("<[^>]*>", " " if "<br>" in b else "", b))).strip() for b in re.split("</?(?:p|h1)>", inner)]
        assert [re.sub(" +", " ", x) for x in r.text.split("\n")] == [x for x in want if x] and r.n_chars == len(r.text)


@pytest.mark.parametrize("page", [None, "", "   ", "plain text that is long enough to be a whole sentence, and then some more of it.", "<p>a<p>b</div></b><i>", "<div" * 50, "<script>never closed", "<p title='x>y'>t</p><!-- open", "a < b and c > d" * 9])
def test_broken_pages(page):
    assert isinstance(html.main_text(page), str)


@pytest.mark.parametrize("piece", ["<a ", "<div", "<a \">\" ", "</b>x<i>", "<ul><li><i>", "<p><i><div></div>", "<li><ul><i><li></li>", "<!--", "<a b='", "<script>", "a<"])
def test_long_broken_pages_take_linear_time(piece):
    import time

    start = time.process_time()
    html.main_text("<p>" + piece * (600_000 // len(piece)))
    assert time.process_time() - start < 12
    if piece == "<a ":
        html.main_text(piece * (5_000_000 // len(piece)))
        assert time.process_time() - start < 20


def test_pages_with_further_columns_repeated_and_empty(spark):
    rows = [(1, "u", PAGE, 1, "t")] * 2 + [(None, None, PAGE, 2, "t"), (2, "v", None, 3, None), (3, "w", "", 4, "x"), (4, "l", ARTICLE * 30_000, 5, "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int, text string")
    got = html.extract(df, html.fit(df)).collect()
    assert got[0].asDict().keys() == {"page_id", "url", "text", "n_chars"}
    by_id = Counter((r.page_id, r.n_chars) for r in got)
    n = len(html.main_text(PAGE))
    assert by_id == {(1, n): 2, (None, n): 1, (2, 0): 1, (3, 0): 1, (4, len(html.main_text(ARTICLE * 30_000))): 1} and max(r.n_chars for r in got) > 9_000_000
    assert html.extract(df.limit(0), html.fit(df.limit(0))).count() == 0 and html.fit(df.limit(0)) == html.PRIOR


def test_weights_follow_the_pages():
    long, short = (0, 3, False, True), (0, 0, False, False)
    as_expected = html.fitted({(long, 0): 9000, (short, 1): 8000, (short, 0): 500})
    other_way = html.fitted({(long, 1): 9000, (short, 0): 8000})
    score = lambda w, x: float(html.row_of(x) @ np.array(w))
    assert score(as_expected, long) < 0 < score(as_expected, short) and score(other_way, short) < score(as_expected, short)
    assert score(other_way, long) > score(as_expected, long) and html.fitted({(long, 0): 5}) == html.PRIOR
    node = html.Node("p", None, 0.0, 0.0, False, 1)
    block = html.Block(node, linked=5, text="Hello there.")
    assert html.costs(block, as_expected) == pytest.approx(score(as_expected, html.shape_of(block)))


def plain_cut(costs, edges):
    best = None
    for mask in range(1 << len(costs)):
        keep = [mask >> i & 1 for i in range(len(costs))]
        total = sum(max(c, 0) if k else max(-c, 0) for c, k in zip(costs, keep, strict=True)) + sum(c for (a, b), c in edges.items() if keep[a] != keep[b])
        best = total if best is None else min(best, total)
    return best


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(-9, 9), min_size=1, max_size=7), st.data())
def test_minimum_cut(costs, data):
    edges = {(a, b): data.draw(st.integers(0, 5)) for a in range(len(costs)) for b in range(a + 1, len(costs)) if data.draw(st.booleans())}
    keep = html.minimum_cut([float(c) for c in costs], {k: float(v) for k, v in edges.items()})
    total = sum(max(c, 0) if k else max(-c, 0) for c, k in zip(costs, keep, strict=True)) + sum(c for (a, b), c in edges.items() if keep[a] != keep[b])
    assert total == plain_cut(costs, edges)


# --- pipeline ----------------------------------------------------------------------------------


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    base = spark.read.parquet(f"{SF}/documents.parquet")
    out = corpus_pipeline.run(spark, SF)
    kept = {r.doc_id for r in out.select("doc_id").distinct().collect()}
    assert 0 < len(kept) < base.count() and out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    docs_ = base
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs_, SF)
        assert after.columns == base.columns
        after.write.parquet(os.path.join(tmp_path, name))
        docs_ = spark.read.parquet(os.path.join(tmp_path, name))
    rows = docs_.collect()
    assert {r.doc_id for r in rows} == kept
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert not any(plain_hits(r.text, bench)[4] for r in rows)
    prints = [plain_fingerprint(r.text) for r in rows]
    assert all((a ^ b).bit_count() > 3 for i, a in enumerate(prints) for b in prints[:i])


def test_pipeline_stages_on_awkward_tables(spark, real, tmp_path):
    base = real.limit(60).withColumn("__rank", F.lit("r")).withColumn("a", F.lit(1)).withColumn("row", F.lit(2)).withColumn("a b", F.lit("x"))
    first = base.orderBy("doc_id").first()
    odd = [(None, None), (None, first.text), (-5, None), (-6, ""), (-7, "%%% 5"), (first.doc_id, first.text), (-8, first.text), (-9, "word " * 100_000)]
    rows = spark.createDataFrame([(i, t, None, None, None, "r", 1, 2, "x") for i, t in odd], base.schema)
    docs_ = base.unionByName(rows)
    docs_.write.parquet(str(tmp_path / "in"))
    docs_ = spark.read.parquet(str(tmp_path / "in"))
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs_, SF)
        assert out.columns == docs_.columns, name
        kept[name] = [r.doc_id for r in out.select("doc_id").collect()]
        assert stage(spark, docs_.limit(0), SF).count() == 0, name
    assert {-5, -6, -7, -8, -9} <= set(kept["toxicity"]) and kept["toxicity"].count(None) == 2
    assert not {-5, -6, -7} & set(kept["language_id"])
    assert -8 in kept["simhash_dedup"] and first.doc_id not in kept["simhash_dedup"] and kept["simhash_dedup"].count(None) == 2
    assert len({-5, -6} & set(kept["simhash_dedup"])) == 1  # both without words
    assert {-5, -6, -7, -9} <= set(kept["decontamination"]) and kept["decontamination"].count(first.doc_id) in (0, 2)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs_, SF)
    assert Counter(r.doc_id for r in packed.where("piece = 0").collect()) == Counter(r.doc_id for r in docs_.select("doc_id").collect())
    assert corpus_pipeline.STAGES[-1][1](spark, docs_.limit(0), SF).count() == 0
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(str(tmp_path / "none" / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
    assert corpus_pipeline.drop_contaminated(spark, docs_, str(tmp_path / "none")).count() == docs_.count()
    assert corpus_pipeline.drop_toxic(spark, docs_, str(tmp_path / "none")).count() == docs_.count()
