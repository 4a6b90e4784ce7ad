"""Operators against brute force, exact round trips or held-out accuracy."""

import hashlib
import os
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayline.llm import jaccard_join, license_scan, line_dedup, linking, mixing, neighbours, personal_data, pieces, quality_classifier, quality_rules, suffix_dedup
from assayline.llm.features import Hasher
from assayline.llm.kernels import Words


def texts(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def union_find(n):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    return up, find


def linked_components(sets, percent):
    up, find = union_find(len(sets))
    held = {}
    for i, s in enumerate(sets):
        for k, n in Counter(k for q in s for k in held.get(q, ())).items():
            if 100 * n >= percent * (len(s) + len(sets[k]) - n):
                a, b = find(i), find(k)
                up[max(a, b)] = min(a, b)
        for q in s:
            held.setdefault(q, []).append(i)
    return [find(i) for i in range(len(sets))]


def test_words_and_grams():
    w = Words([b"a bb\x1fc  d", b"", b"e"])
    assert w.counts().tolist() == [3, 0, 1]
    at, h = Words([b"x y z x y", b"x y"]).grams(2)
    assert len(at) == 5 and h[0] == h[3] == h[4]


def test_jaccard_equals_brute_force(spark):
    rng, rows = random.Random(3), []
    for base in range(40):
        words = [rng.choice("abcdefghij") + str(rng.randint(0, 9)) for _ in range(rng.choice((1, 3, 6, 7, 9, 15, 40, 120)))]
        for _ in range(rng.randint(1, 14)):
            w = list(words)
            for _ in range(rng.choice((0, 0, 1, 2, 4))):
                w[rng.randrange(len(w))] = str(rng.randint(0, 99))
            rows.append((len(rows), " ".join(w)))
    sets = [set() if not (w := t.lower().split()) else ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}) for _, t in rows]
    want = linked_components(sets, 75)
    p = jaccard_join.JoinParameters(sample_docs=50, link=linking.LinkParameters(block=4, star=3, task_signatures=500, task_tokens=300, offers=1, growth=2, shard_holders=2))
    for params in (jaccard_join.JoinParameters(), p):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.components(spark.createDataFrame(rows, "doc_id long, text string"), params).collect()}
        assert got == {i: (len(sets[i]), want[i]) for i in range(len(rows))}


def test_texts_that_share_an_id(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(1, text), (3, "alone " + text[::-1]), (7, text + " more"), (7, "another text of its own with enough words in it"), (7, text + " more"), (None, text), (None, "no id and no partner for this one here")]
    docs = spark.createDataFrame([(i, t, "clash", "c") for i, t in rows], "doc_id long, text string, rid string, __kept string")
    got = Counter((r.doc_id, r.component_id) for r in jaccard_join.components(docs).collect())
    assert got == Counter([(1, 1), (3, 3), (7, 1), (7, 7), (7, 1), (None, 1), (None, None)])
    left = jaccard_join.representatives(docs)
    assert left.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in left.collect()) == Counter(rows[i] for i in (0, 1, 3, 6))
    again = spark.createDataFrame([(7, text), (7, text), (8, "x")], "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in jaccard_join.representatives(again).collect()) == [(7, text), (8, "x")]


def test_lines_of_texts_that_share_an_id(spark):
    rows = [(1, "the first line of it all\nand a second line"), (7, "the first line of it all\nkept here"), (7, "a unique line under the same id\nthe first line of it all"), (None, "the first line of it all\nno id")]
    docs = spark.createDataFrame([(i, t, "x", "y", 3) for i, t in rows], "doc_id long, text string, rid string, lines string, row int")
    got = {tuple(r.removed): r.doc_id for r in line_dedup.removed(docs, line_dedup.PRODUCTION).collect()}
    assert sorted(map(list, got)) == [[], [0], [1]]
    left = line_dedup.deduplicated(docs, line_dedup.PRODUCTION)
    assert left.columns == docs.columns
    assert {r.text for r in left.collect()} == {rows[0][1], "kept here", "a unique line under the same id", "no id"}


def test_minhashes_of_any_lengths():
    rng = random.Random(11)
    raw = ["".join(rng.choice("abcd é") for _ in range(rng.choice((0, 1, 3, 4, 5, 6, 40, 300, 5000)))).encode() for _ in range(300)]
    p = line_dedup.PRODUCTION
    together = line_dedup.minhashes(raw, p)
    order = rng.sample(range(len(raw)), len(raw))
    assert (line_dedup.minhashes([raw[i] for i in order], p) == together[order]).all()
    assert all((line_dedup.minhashes([x], p)[0] == y).all() for x, y in zip(raw[:40], together, strict=False))
    # the share of equal minima estimates the similarity of the sets
    one, two = (" ".join(f"{rng.randint(0, 10**9)}" for _ in range(60)) for _ in range(2))
    pair = line_dedup.minhashes([(one + two).encode(), (one + two[:40]).encode()], line_dedup.LineParameters(chars=5, rows=1, bands=400))
    a, b = ({x[i : i + 5] for i in range(len(x) - 4)} for x in (one + two, one + two[:40]))
    assert abs((pair[0] == pair[1]).mean() - len(a & b) / len(a | b)) < 0.1


def test_lines_equal_brute_force(small):
    rows = sorted(texts(small))
    lines = [(i, j, x) for i, t in rows for j, x in enumerate(t.encode().split(b"\n")) if x and not x.isspace()]
    tokens, first = line_dedup.line_sets([x for *_, x in lines], 12)
    root = linked_components([set(tokens[a:b].tolist()) for a, b in zip(first, first[1:], strict=False)], 75)
    want = {}
    for k, (i, j, _) in enumerate(lines):
        if root[k] != k:
            want.setdefault(i, []).append(j)
    assert {r.doc_id: list(r.removed) for r in line_dedup.removed(small).collect() if r.removed} == want


def test_text_of_many_lines(spark):
    words = [f"w{i:05d}" for i in range(70_000)]
    tokens, first = line_dedup.line_sets([w.encode() for w in words], 12)
    assert len(first) == 70_001 and (np.diff(first) == 1).all() and len(set(tokens.tolist())) == 70_000
    docs = spark.createDataFrame([(1, "\n".join(words)), (2, f"{words[0]}\nsome other line\n{words[-1]}")], "doc_id long, text string")
    assert {r.doc_id: (r.n_lines, list(r.removed)) for r in line_dedup.removed(docs).collect()} == {1: (70_000, []), 2: (3, [0, 2])}


def test_short_fuzzy_lines(spark, tmp_path):
    from assayline.llm import queries

    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    rows = []
    for size in range(40, 91):
        line = (" ".join(word(rng.randint(3, 8)) for _ in range(20)))[:size]
        at = rng.randrange(size)
        other = [line[:at] + "#" + line[at + 1 :]]
        if size >= 80:  # a word of four letters in the middle
            other.append(line[:38] + " " + word(4) + " " + line[44:])
            line = line[:38] + " " + word(4) + " " + line[44:]
            other[0] = line[:at] + "#" + line[at + 1 :]
        rows += [(1000 * size + i, x) for i, x in enumerate([line, *other])]
    sets = [{x[i : i + 5] for i in range(len(x) - 4)} for _, x in rows]
    root = linked_components(sets, 75)
    assert all(root[k] != k for k, (i, _) in enumerate(rows) if i % 1000)
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.n_removed for r in queries.op1_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {i: int(root[k] != k) for k, (i, _) in enumerate(rows)}


def test_short_shingles_equal_brute_force(small):
    rows = sorted(texts(small))
    lines = [(i, j, x) for i, t in rows for j, x in enumerate(t.encode().split(b"\n")) if x and not x.isspace()]
    tokens, first = line_dedup.line_sets([x for *_, x in lines], line_dedup.PRODUCTION.chars)
    root = linked_components([set(tokens[a:b].tolist()) for a, b in zip(first, first[1:], strict=False)], 75)
    want = {}
    for k, (i, j, _) in enumerate(lines):
        if root[k] != k:
            want.setdefault(i, []).append(j)
    assert {r.doc_id: list(r.removed) for r in line_dedup.removed(small, line_dedup.PRODUCTION).collect() if r.removed} == want


def test_pieces_equal_the_library():
    import public_tokenizers

    code, rng = pieces.Coder(public_tokenizers.path("piece_bpe_32k.model")), random.Random(4)
    for _ in range(400):
        s = "".join(rng.choice("aé ▁\n\t<s>🙂日 thetionß\u0000①  ") for _ in range(rng.randint(0, 150)))
        ids = code.library.encode(s)
        assert code.encode(s) == ids and code.merge("▁" + s.replace(" ", "▁")) == ids if s else code.encode(s) == []
        assert code.decode(ids) == code.library.decode(ids)


def test_long_words_are_checked_against_the_library(monkeypatch):
    import public_tokenizers

    code, rng = pieces.Coder(public_tokenizers.path("piece_bpe_32k.model")), random.Random(10)
    texts = ["".join(rng.choice("aé日本語🙂thetionß+/09") for _ in range(n)) for n in (48, 60, 700, 20_000)] + [" " * 60 + "x", "▁" * 50]
    assert [code.encode(x) for x in texts] == code.library.encode(texts)
    right = code.merge
    monkeypatch.setattr(code, "merge", lambda x: right(x)[::-1])
    with pytest.raises(pieces.Mismatch):
        code.encode_many(["short words and " + "thetion" * 9])


def test_quality_on_rows_never_learnt_from(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = quality_classifier.classify(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in got]) >= 0.9
    kept = quality_rules.apply(docs, quality_rules.train(docs, labels)).join(labels, "doc_id").where("NOT base_failed").collect()
    assert np.mean([r.kept == (r.quality == 1) for r in kept]) >= 0.95


def test_a_text_alone_scores_as_in_a_batch(small):
    rng = random.Random(12)
    raw = [t.encode() for _, t in texts(small)[:80]] + [b"", b"x", "é🙂日".encode(), b" "]
    for hasher in (Hasher(12, words=(1, 2), chars=(3, 4)), Hasher(12, words=(1, 2), repeats=True)):
        weights = np.random.default_rng(1).normal(size=hasher.size)
        alone = [hasher.margins([t], weights, 0.5)[0] for t in raw]
        order = rng.sample(range(len(raw)), len(raw))
        assert hasher.margins([raw[i] for i in order], weights, 0.5).tolist() == [alone[i] for i in order]


def test_character_grams_are_of_code_points():
    h = Hasher(20, words=(), chars=(3,))
    rows, places, _ = h([("é🙂日本".encode()), b"ab"])
    # a blank ends each text: five code points make three 3-grams, three make one
    assert Counter(rows.tolist()) == {0: 3, 1: 1} and len(set(places.tolist())) == 4


def test_surface_counts():
    t = "a b c x a b c\n#5 %\n\na b\na b\n"
    s = {k: int(v[0]) for k, v in quality_rules.surface([t.encode()]).items()}
    w = t.split()
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    again = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
    assert s == {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": 2, "n_dup_lines": 1, "n_repeat_words": len(again)}


def test_suffix_array_and_prefixes():
    rng = random.Random(5)
    for n in range(40):
        t = bytes(rng.choice(b"ab" if n % 2 else b"abcd\xff\x00") for _ in range(rng.randint(1, 250)))
        buf = np.frombuffer(t, np.uint8)
        sa = suffix_dedup.suffix_array(buf, 400)
        assert sa.tolist() == sorted(range(len(t)), key=lambda i: t[i:])
        for most in (5, 8, 60, 64, 400):
            long = sa[sa <= len(t) - most]
            for held in (50, 1 << 22):
                got = suffix_dedup.prefixes(buf, long, most, held).tolist()
                assert got == [len(os.path.commonprefix([t[i : i + most], t[j : j + most]])) for i, j in zip(long, long[1:], strict=False)]


@pytest.mark.parametrize("p", [suffix_dedup.SuffixParameters(window=60, anchor=12), suffix_dedup.SuffixParameters(window=60, anchor=12, most_contexts=2, task_contexts=5, step=200)])
def test_suffix_dedup_equals_brute_force(spark, p):
    rng = random.Random(6)
    word = lambda n, a: "".join(rng.choice(a) for _ in range(n))
    shared = word(70, "abcdef ")
    rows = [(i, word(rng.randint(0, 40), "xyz ") + (shared if i % 3 else "") + word(rng.randint(0, 90), "uvw é")) for i in range(60)] + [(100, "ab" * 80), (101, "q" * 61), (102, "short")]
    w, seen = p.window, Counter()
    raw = [t.encode() for _, t in rows]
    for b in raw:
        seen.update(b[i : i + w] for i in range(len(b) - w + 1))
    want = set()
    for (d, _), b in zip(rows, raw, strict=True):
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - w + 1):
            if seen[b[i : i + w]] > 1:
                gone[i : i + w] = True
        want.add((d, len(b), int(gone.sum()), int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum()), hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    assert {tuple(r) for r in suffix_dedup.report(spark.createDataFrame(rows, "doc_id long, text string"), p).collect()} == want


def test_neighbours_recall(spark):
    v = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    ids, x = (np.array(c) for c in zip(*[(r.vec_id, r.embedding) for r in v.collect()], strict=True))
    hit = total = 0
    got = {}
    for r in neighbours.every_hundredth(v).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    for q in ids[ids % 100 == 0]:
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
        best = [int(ids[i]) for i in np.lexsort((ids, d)) if ids[i] != q][:10]
        mine = sorted(got[q])
        assert [s for *_, s in mine] == sorted(s for *_, s in mine) and len(mine) == 10
        hit, total = hit + len(set(best) & {m[1] for m in mine}), total + 10
    assert hit / total >= 0.9


@pytest.mark.parametrize("p", [neighbours.IndexParameters(centroids=1), neighbours.IndexParameters(centroids=1, block_rows=20, blocks=1)])
def test_neighbours_of_repeated_ids(spark, p):
    rng = np.random.default_rng(9)
    rows = [(i, x.tolist()) for i, x in enumerate(rng.normal(size=(60, 4)).astype(np.float32))]
    near = np.array(rows[0][1])
    rows += [(1, (near + e).astype(np.float32).tolist()) for e in rng.normal(size=(15, 4)) / 100]  # a nearest id of many vectors
    rows += [rows[2]] * 12 + rows
    want = {}
    for i, x in rows[1:]:
        if i:
            want[i] = min(want.get(i, np.inf), float(np.sqrt(((np.array(x) - near) ** 2).sum())))
    got = sorted((r["rank"], r["vec_id"], r["score"]) for r in neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") == 0, p).collect())
    best = sorted((d, i) for i, d in want.items())[:10]
    assert [i for _, i, _ in got] == [i for _, i in best] and [d for *_, d in got] == pytest.approx([d for d, _ in best])


def test_mixing(small):
    docs = small
    rows = mixing.mix(docs).collect()
    again = mixing.mix(docs).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    by = {}
    for r in rows:
        assert r.taken == sum(b.words for b in r.blocks) <= 3 * r.size
        assert r.size == len(re.findall(r"[^\x20\x09-\x0D]+", next(t for i, t in TEXTS(docs) if i == r.doc_id)))
        by.setdefault(r.source, []).append(r)
    for own in by.values():
        assert abs(sum(r.taken for r in own) - own[0].target) <= 0.5
    assert sum({r.source: r.target for r in rows}.values()) == pytest.approx(sum(r.size for r in rows))


def test_shards_hold_what_the_tree_deals(spark):
    rows = [(i, "" if i % 3 else "a b c " * (1 + i % 5), "uvw"[i % 7 % 3]) for i in range(300)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    held = Counter((b.shard, r.source) for r in got for b in r.blocks)
    quota = [sum(n for (_, x), n in held.items() if x == s) for s in "uvw"]
    leaves = mixing.split_quotas(quota, 16, 17)
    assert held == Counter({(k, s): int(n) for k, row in enumerate(leaves) for s, n in zip("uvw", row, strict=True) if n})


def test_rows_go_to_the_shards_of_their_blocks(spark):
    rng = random.Random(4)
    rows = [(i, "" if i % 5 == 0 else "a b c " * rng.randint(1, 9), rng.choice(["u", "u", "u", "v", "w", None])) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for p in (mixing.MixParameters(), mixing.MixParameters(shards=5, weights=(1, 9, 1), seed=3)):
        # a part of a document that is less than half of it stays out of whole passes
        want = Counter((r.doc_id, b.shard, b.place) for r in mixing.mix(docs, p).collect() for b in r.blocks if 2 * b.words >= r.size)
        got = mixing.dealt_rows(docs, p).collect()
        assert Counter((r.row.doc_id, r.shard, r.place) for r in got) == want
        assert Counter(r.doc_id for r in mixing.mixed_rows(docs, p).collect()) == Counter(i for i, *_ in want.elements())


def test_the_seed_changes_shards_but_no_sums(spark):
    rows = [(i, "a b c " * (1 + i % 4), "uv"[i % 3 % 2]) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    one, two = (mixing.mix(docs, mixing.MixParameters(seed=s)).collect() for s in (1, 2))
    sums = lambda rows: {s: sum(r.taken for r in rows if r.source == s) for s in "uv"}
    places = lambda rows: {(r.doc_id, b.shard) for r in rows for b in r.blocks}
    assert sums(one) == sums(two) and places(one) != places(two)


_texts = {}


def TEXTS(df):
    if id(df) not in _texts:
        _texts[id(df)] = texts(df)
    return _texts[id(df)]


def test_draws_beyond_the_library():
    rng = np.random.default_rng(5)
    for good, bad, want in ((30, 50, 20), (400, 20, 100), (5, 9, 13), (3, 0, 2), (0, 4, 2), (200, 200, 390)):
        mine = np.array([mixing.hypergeometric(rng, good, bad, want, large=0) for _ in range(4000)])
        theirs = rng.hypergeometric(good, bad, want, 4000) if good and bad else mine
        assert mine.min() >= max(0, want - bad) and mine.max() <= min(good, want)
        assert abs(mine.mean() - theirs.mean()) < 0.25 and abs(mine.std() - theirs.std()) < 0.2
    leaves = mixing.split_quotas([3 * 10**9, 10**9 + 7, 5], 4, 1)
    assert leaves.sum(0).tolist() == [3 * 10**9, 10**9 + 7, 5] and leaves.sum(1).max() - leaves.sum(1).min() <= 1


def test_splitting_tree():
    leaves = mixing.split_quotas([100, 0, 7, 3000], 16, 1)
    assert leaves.sum(0).tolist() == [100, 0, 7, 3000] and leaves.sum(1).max() - leaves.sum(1).min() <= 1
    assert mixing.targets([("a", 10), ("b", 10), ("c", 100)]) == {"a": 30.0, "b": 30.0, "c": 60.0}


def test_license_places_and_spans(spark):
    rows = [(1, "x CC-BY y. All rights reserved cc by"), (2, "pre Licensed under CC BY-NC 4.0. post"), (3, "Released, under the MIT License"), (4, "general public licenses"), (5, "This work is licensed under the GNU General Public License, version 3")]
    got = {r.doc_id: r for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[1].n_base, got[1].first_word, got[1].last_word, got[1].base_labels) == (3, 1, 7, "cc-by,reserved")
    assert (got[2].base_labels, got[2].labels, got[3].labels, got[4].n_base, got[5].labels) == ("cc-by", "cc-by,cc-by-nc", "mit", 0, "gpl")


def brute_spans(text, p, templates):
    """{(template, label, first_word, last_word)}: diagonals over words themselves, without hashes."""
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    w, out = words(text), set()
    for i, (label, t) in enumerate(templates):
        g = [tuple(words(t)[j : j + p.k]) for j in range(len(words(t)) - p.k + 1)]
        votes = {}
        for a in range(len(w) - p.k + 1):
            for b, x in enumerate(g):
                if x == tuple(w[a : a + p.k]):
                    votes.setdefault(a - b, []).append((a, b))
        runs = []
        for d in sorted(votes):
            if runs and d - runs[-1][0] <= p.slack:
                runs[-1] = (d, runs[-1][1] + votes[d])
            else:
                runs.append((d, votes[d]))
        for _, hits in runs:
            lo, hi = min(a for a, _ in hits), max(a for a, _ in hits) + p.k - 1
            if len({b for _, b in hits}) / len(g) >= p.cover and hi - lo + 1 <= 1.5 * (len(g) + p.k - 1) + p.slack:
                out.add((i, label, lo, hi))
    return out


def test_license_spans_equal_brute_force(spark):
    rng, p = random.Random(8), license_scan.ScanParameters()
    rows = []
    for i in range(150):
        parts = []
        for _ in range(rng.randint(0, 3)):
            t = rng.choice(license_scan.TEMPLATES)[1].split()
            for _ in range(rng.randint(0, 3)):  # words put in, left out or changed
                at = rng.randrange(len(t))
                t[at : at + rng.randint(0, 1)] = rng.choice(([], ["word"], ["other", "words"]))
            parts += [" ".join(t[rng.choice((0, 0, 3)) :]).upper() if rng.random() < 0.3 else ", ".join(t), " ".join(rng.choices(["the", "license", "under", "of"], k=rng.randint(0, 30)))]
        rows.append((i % 40, "\n".join(parts)))  # several texts for each id
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {}
    for r in license_scan.spans(docs, p).collect():
        got.setdefault((r.doc_id, r.digest), set()).add((r.template, r.label, r.first_word, r.last_word))
    want = {(i, hashlib.md5(t.encode()).hexdigest()): s for i, t in rows if (s := brute_spans(t, p, license_scan.TEMPLATES))}
    assert got == want and len(want) > 60


def test_license_labels_stay_with_their_text(spark):
    t = license_scan.TEMPLATES[0][1].split()
    half = [" ".join(t[: len(t) // 2]), " ".join(t[len(t) // 2 :])]
    rows = [(1, half[0]), (1, half[1]), (2, " ".join(t)), (2, "nothing"), (None, " ".join(t)), (3, None)]
    got = sorted((r.doc_id or 0, r.n_words, r.labels) for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    n = len(t)
    assert got == [(0, n, "mit"), (1, len(half[0].split()), ""), (1, len(half[1].split()), ""), (2, 1, ""), (2, n, "mit"), (3, 0, "")]


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_spans(t):
    def luhn(d):
        return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0

    out = []
    for kind, p in PATTERNS.items():
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else True, "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]
            if ok:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


def test_personal_data_equals_patterns(spark):
    rng = random.Random(7)
    bits = ["a@b.c", "_d@e.f", "x", "é", "1.2.3.4", "300.1.1.1", ".5.6", "4111 1111 1111 1111", "+1 (736) 555-2678", " ", "-", "+", "12", "@", "🙂", "\u0001", "\n", "0", "call (736) 555-2678", "SSN 123-45-6789", "Dr. John Smith"]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randint(0, 25)))) for i in range(1200)]
    got = {r.doc_id: r for r in personal_data.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        want = base_spans(t)
        assert got[i].base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        kinds = Counter(x.split(":")[0] for x in want.split(",") if x)
        assert {k: got[i][f"n_{k}"] for k in PATTERNS} == {k: kinds[k] for k in PATTERNS}
        assert set(want.split(",")) - {""} <= set(got[i].spans.split(","))
    assert any("ssn" in r.spans for r in got.values())


def test_offers_are_the_closest_pairs():
    rng = np.random.default_rng(4)
    size = 120
    cell, left = rng.integers(0, 5, size), rng.random(size) < 0.5
    fp, label, n = rng.permutation(size).astype(np.int64), rng.integers(0, 6, size), rng.integers(40, 60, size)
    bits = rng.integers(0, 1 << 63, (size, 2), dtype=np.uint64) & rng.integers(0, 1 << 63, (size, 2), dtype=np.uint64) & np.uint64(0xFFFF)
    allowed = {}
    for x in np.flatnonzero(left):
        for y in np.flatnonzero(~left & (cell == cell[x]) & (label != label[x])):
            gap = int(np.bitwise_count(bits[x] ^ bits[y]).sum())
            if min(n[x], n[y]) * 100 >= 75 * max(n[x], n[y]) and gap * 175 <= 25 * (n[x] + n[y]):
                allowed.setdefault((cell[x], label[x]), set()).add((gap / (n[x] + n[y]), min(fp[x], fp[y]), max(fp[x], fp[y])))
    for offers in (1, 3, 10_000):
        for most in (7, 1 << 18):
            a, b, back = linking.offered(cell, left, fp, label, n, bits, offers, 75, most)
            assert set(zip(a.tolist(), b.tolist(), strict=True)) == {q[1:] for x in allowed.values() for q in sorted(x)[:offers]}
            assert set(back.tolist()) == {c for (c, _), x in allowed.items() if len(x) > offers}


def test_pieces_of_many_texts():
    import public_tokenizers

    code, rng = pieces.Coder(public_tokenizers.path("piece_bpe_32k.model")), random.Random(13)
    raw = ["".join(rng.choice("aé ▁\n\t<s>🙂日 thetionß\u0000①  ") for _ in range(rng.choice((0, 1, 2, 30, 900)))) for _ in range(120)]
    code.MOST_BYTES = 5_000  # all is forgotten again and again
    for _ in range(3):
        ids, cut = code.encode_many(raw)
        own = [ids[i:j].tolist() for i, j in zip(cut, cut[1:], strict=False)]
        assert own == code.library.encode(raw)
        assert code.decimals(ids, cut) == [",".join(map(str, x)).encode() for x in own]
        assert code.decode_many(ids, cut) == code.library.decode(own)
    same = [x for x in ("a", "é日", "①ß") for _ in range(3)]
    for size in (1, 2):
        words = [x for x in same if len(x) == size]
        ids, counts = code.merge_many(words)
        assert [ids[i:j].tolist() for i, j in zip(np.cumsum(counts) - counts, np.cumsum(counts), strict=True)] == [code.merge(x) for x in words]
