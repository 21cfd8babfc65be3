"""Operators on whole texts against brute force, on awkward rows."""

import hashlib
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from prismata.llm import common, decontaminate, jaccard, licenses, lines, pieces, suffixes, token_counts, toxicity

from .helpers import SCHEMA, awkward, prose, table


def repeated(texts, length=200):
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        flags = np.zeros(len(t) + 1, np.int32)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                flags[i] += 1
                flags[i + length] -= 1
        gone = np.cumsum(flags)[: len(t)] > 0
        runs = int((np.diff(np.concatenate([[0], gone.astype(np.int8)])) == 1).sum())
        out.append((len(t), int(gone.sum()), runs, hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~gone])).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [20_000, 1])
def test_suffixes_match_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(suffixes, "HOT", hot)
    monkeypatch.setattr(suffixes, "PIECE", 9_000)  # long texts go in pieces
    rows = [*awkward(), (90, prose(3, 3000)[:20_000] + prose(5, 50), "", 0), (91, "ab" * 3000, "", 0), (92, "ab" * 150 + "c" + "ab" * 150, "", 0)]
    want = Counter((r[0], *w) for r, w in zip(rows, repeated([(r[1] or "").encode() for r in rows]), strict=True))
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.repeated_spans(table(spark, rows)).collect())
    assert got == want


def test_suffixes_of_nothing(spark):
    assert suffixes.repeated_spans(table(spark, [])).collect() == []


def test_multikey_order():
    x = np.random.default_rng(0).integers(0, 3, (500, 4), dtype=np.uint64)
    assert (x[suffixes.multikey_order(x)] == x[np.lexsort(x.T[::-1])]).all()


def shingle_set(text, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if len(w) >= k else frozenset([tuple(w)])


def linked(sets):
    parent = list(range(len(sets)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= 80 * len(a | sets[j]):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(sets))]


@pytest.mark.parametrize(("rounds", "small"), [(6, 64), (1, 2)])
def test_jaccard_matches_brute_force(spark, monkeypatch, rounds, small):
    monkeypatch.setattr(jaccard, "SMALL", small)
    monkeypatch.setattr(jaccard, "PAIRS_AN_ENTRY", 0.1 if rounds == 1 else 20)  # leader rounds before the exhaustive one
    monkeypatch.setattr(jaccard, "LEADER_ROUNDS", rounds)
    rows = [r for r in awkward() if r[0] is not None]
    for i in range(40):  # a chain of variants around the threshold
        w = prose(50, 90).split()
        for j in range(i % 7):
            w[(i * 11 + j * 13) % 90] = f"v{i}_{j}"
        rows.append((100 + i, " ".join(w), "", 0))
    # One id with two texts: each links by its own.
    rows += [(90, prose(51, 60), "", 0), (90, prose(52, 60), "", 0), (91, prose(52, 60) + " y", "", 0), (92, prose(51, 60) + " y", "", 0)]
    sets = [shingle_set(r[1]) for r in rows]
    roots = linked(sets)
    group = {}
    for r, c in zip(rows, roots, strict=True):
        group[c] = min(group.get(c, r[0]), r[0])
    want = Counter((r[0], len(s), group[c]) for r, s, c in zip(rows, sets, roots, strict=True))
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(table(spark, rows)).collect())
    assert got == want


def test_parity_maps_never_differ_more_than_sets():
    r = np.random.default_rng(4)
    for n, lost, new in ((1, 0, 1), (200, 3, 9), (256, 0, 1), (300, 100, 0), (500, 20, 40), (3000, 10, 1500)):
        x = r.integers(0, 2**63, n, dtype=np.uint64)
        y = np.concatenate([x[lost:], r.integers(0, 2**63, new, dtype=np.uint64)])
        apart = jaccard.bits_apart(jaccard.parity(np.unique(x)), jaccard.parity(np.unique(y)))
        assert apart <= lost + new and apart == jaccard.bits_apart(jaccard.parity(np.unique(y)), jaccard.parity(np.unique(x)))
        assert jaccard.bits_apart(jaccard.parity(np.unique(x)), jaccard.parity(np.unique(x))) == 0 and (apart > 0) == (lost + new > 0)


def test_jaccard_of_nulls_and_nothing(spark):
    got = {r.component_id for r in jaccard.jaccard_components(table(spark)).filter("doc_id is null").collect()}
    assert got == {None}
    assert jaccard.jaccard_components(table(spark, [])).collect() == []


def test_keep_one(spark):
    kept = jaccard.keep_one(table(spark))
    ids = Counter(r.doc_id for r in kept.collect())
    assert ids[5] == 1 and 6 not in ids and 7 not in ids and ids[None] == 2 and ids[3] == 1 and 4 not in ids
    assert kept.columns == ["doc_id", "text", "id", "row"]


def test_decontamination(spark):
    items = [("7", prose(60, 25)), ("10", "Tiny item"), ("2", None), ("3", "--- !!"), ("11", prose(60, 25)), (None, prose(61, 20))]
    bench = spark.createDataFrame(items, "item_id string, text string")
    w = prose(60, 25).split()
    rows = [*awkward(), (200, prose(62, 20) + " -- " + ", ".join(w[3:15]).upper() + "! " + prose(63, 5), "", 0), (201, "a tiny, ITEM b", "", 0), (202, " ".join(w[:9]), "", 0), (203, prose(61, 20), "", 0)]
    keys = {}
    for item, text in items:
        x = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower())
        for i in range(max(1, len(x) - 9) if x and item else 0):
            keys.setdefault(tuple(x[i : i + 10]), set()).add(item)
    want = Counter()
    for doc, text, *_ in rows:
        x = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        hit, found = set(), set()
        for k, ids in keys.items():
            for i in range(len(x) - len(k) + 1):
                if tuple(x[i : i + len(k)]) == k:
                    hit |= set(range(i, i + len(k)))
                    found |= ids
        want[doc, len(x), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)] += 1
    out = decontaminate.scan_benchmark(table(spark, rows), bench).collect()
    assert Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in out) == want
    text = dict((r[0], r[1]) for r in rows)[200].encode()
    spans = next(r.spans for r in out if r.doc_id == 200)
    assert [text[s.start : s.end].decode().lower() for s in spans] == [", ".join(w[3:15])]
    kept = decontaminate.drop_contaminated(table(spark, rows), bench)
    assert Counter(r.doc_id for r in kept.collect()) == Counter({k[0]: 0 for k in []}) + Counter(d for (d, *_, bad), n in want.items() if not bad for _ in range(n))
    assert decontaminate.scan_benchmark(table(spark, []), bench).collect() == []
    assert not any(r.contaminated for r in decontaminate.scan_benchmark(table(spark), bench.limit(0)).collect())


def test_decontamination_in_several_automata(spark, monkeypatch):
    bench = spark.createDataFrame([(str(i), prose(70 + i, 15)) for i in range(9)], "item_id string, text string")
    rows = [(i, prose(80, 5) + " " + prose(70 + i, 15), "", 0) for i in range(9)]
    key = lambda df: sorted(tuple(r) for r in df.drop("spans", "items").collect())
    one = key(decontaminate.scan_benchmark(table(spark, rows), bench))
    monkeypatch.setattr(decontaminate, "AUTOMATON_BYTES", 300)
    assert key(decontaminate.scan_benchmark(table(spark, rows), bench)) == one
    assert all(r[5] for r in one)


@pytest.mark.parametrize("small", [64, 2])
def test_lines_against_brute_force(spark, monkeypatch, small):
    monkeypatch.setattr(lines, "SMALL", small)
    monkeypatch.setattr(lines, "PAIRS_AN_ENTRY", 500 if small > 2 else 2)
    base = prose(20, 30)
    variants = [" ".join([*base.split()[:i], "new", *base.split()[i + 1 :]]) for i in range(30)]
    rows = [*awkward(), (300, "\n".join(variants) + "\n---\n\n" + base.upper() + "!", "", 0), (301, base + "\n" + prose(21, 20) + "\n" + base, "", 0), (302, "Total: 17\nTotal: 18\n***\n***", "", 0)]
    docs = table(spark, rows)
    occ = {(r[0], r[1]): re.findall("[^\n]+\n?|\n", r[1] or "") for r in rows}
    parts = spark.createDataFrame([(p,) for p in {p for ps in occ.values() for p in ps}], "line string")
    norm = {r.line: (r.norm, 0) for r in parts.withColumn("norm", lines.normalised(F.col("line"))).collect()}
    classes = sorted({v for v in norm.values() if v[0]})
    parent = {c: c for c, _ in classes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    for i, (a, _) in enumerate(classes):
        for b, _ in classes[:i]:
            if abs(len(a) - len(b)) * 5 <= max(len(a), len(b)) and distance(a, b) * 5 <= max(len(a), len(b)):
                x, y = find(a), find(b)
                if x != y:
                    parent[x] = y
    order = lambda d: -(1 << 63) if d is None else d
    keep = {}
    for (d, t), ps in sorted(occ.items(), key=lambda x: (order(x[0][0]), str(x[0][1]))):
        for i, p in enumerate(ps):
            if norm[p][0]:
                g = find(norm[p][0])
                keep[g] = min(keep.get(g, (order(d), i, t)), (order(d), i, t), key=lambda k: k[:2])
    got = {(r.doc_id, r.id, r.text is None): r for r in lines.dedup_lines(docs).collect()}
    for r in rows:
        mine = got[r[0], r[2], r[1] is None]
        left = "".join(p for i, p in enumerate(occ[r[0], r[1]]) if not norm[p][0] or keep[find(norm[p][0])] == (order(r[0]), i, r[1]))
        assert mine.text == (None if r[1] is None else left), r[0]
        assert mine.line_n_removed == sum(1 for i, p in enumerate(occ[r[0], r[1]]) if norm[p][0] and keep[find(norm[p][0])] != (order(r[0]), i, r[1]))
    assert len({find(c) for c, _ in classes}) < len(classes)
    assert lines.dedup_lines(table(spark, [])).collect() == []


def test_simhash_is_the_majority_of_bits():
    r = np.random.default_rng(5)
    sizes = [1, 2, 3, 254, 255, 256, 700, 5]
    h = r.integers(0, 2**63, sum(sizes), dtype=np.uint64) * np.uint64(2) + r.integers(0, 2, sum(sizes), dtype=np.uint64)
    first = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    for s, a, n in zip(lines.simhashes(h, first, np.array(sizes)).tolist(), first.tolist(), sizes, strict=True):
        assert s == sum(1 << b for b in range(64) if 2 * sum(int(x) >> b & 1 for x in h[a : a + n]) > n)


def test_line_features_normalise_like_the_column(spark):
    texts = ["a b c d e", " -A 17, b", "a 00 B!", "Ünï… «cödé» ß\u00a0漢字、かな", "x\ty", "ISTANBUL ẞ Ǆ", "...", "١٢ ②"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc long, text string")
    norm = {r.doc: r.norm for r in df.select("doc", lines.normalised(F.col("text")).alias("norm")).collect()}
    ids = {r.doc: (r.id, r.n) for r in df.select("doc", F.lit(0).cast("long").alias("row"), "text").mapInArrow(lines._features, lines.FEATURES).collect()}
    assert set(ids) == {i for i, t in norm.items() if t}
    assert all(n == len(norm[i]) for i, (_, n) in ids.items())
    assert {(norm[i] == norm[j]) == (ids[i] == ids[j]) for i in ids for j in ids} == {True}


def test_edit_similarity():
    import random

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    r = random.Random(2)
    words = "a be see the of rain plain 漢字 more".split() + [f"w{i}" for i in range(20)]
    both = set()
    for _ in range(1500):
        x = [r.choice(words) for _ in range(r.randint(1, 14))]
        y = list(x)
        for _ in range(r.randint(0, 4)):
            y.insert(r.randrange(len(y) + 1), r.choice(words)) if r.random() < 0.5 or len(y) < 2 else y.pop(r.randrange(len(y)))
        if r.random() < 0.2:
            r.shuffle(y)
        a, b = " ".join(x), " ".join(y)
        d = distance(a, b)
        assert lines._bound(x, y) >= d
        assert lines.within(a, b) == (5 * d <= max(len(a), len(b)))
        both.add(5 * d <= max(len(a), len(b)))
    assert both == {True, False}


def test_lines_recall_on_all_pairs(spark, sf):
    """All pairs of distinct lines of the documents, with code of its own: at least 0.9 of the similar ones are linked."""
    import duckdb

    c = duckdb.connect()
    c.execute(f"CREATE TABLE l AS SELECT DISTINCT trim(regexp_replace(lower(translate(x, '123456789', '000000000')), '[^\\p{{L}}\\p{{M}}\\p{{N}}]+', ' ', 'g')) AS s FROM (SELECT unnest(string_split(text, chr(10))) AS x FROM '{sf}/documents.parquet')")
    # Byte distances of wide characters are larger, so pairs are only asked of lines in ASCII.
    c.execute("CREATE TABLE p AS SELECT a.s AS x, b.s AS y FROM l a JOIN l b ON a.s < b.s AND abs(length(a.s) - length(b.s)) * 5 <= greatest(length(a.s), length(b.s)) WHERE a.s <> '' AND regexp_full_match(a.s, '[ -~]*') AND regexp_full_match(b.s, '[ -~]*') AND jaccard(left(a.s, 4000), left(b.s, 4000)) > 0.3")
    pairs = c.execute("SELECT x, y FROM p WHERE levenshtein(x, y) * 5 <= greatest(length(x), length(y))").fetchall()
    assert len(pairs) > 20
    distinct = {s for p in pairs for s in p}
    left = {s for r in lines.dedup_lines(spark.createDataFrame([(i, s) for i, s in enumerate(sorted(distinct))], "doc_id long, text string")).collect() for s in [r.text] if s}
    parent = {s: s for s in distinct}

    def find(s):
        while parent[s] != s:
            s = parent[s]
        return s

    for x, y in pairs:
        parent[find(x)] = find(y)
    groups = len({find(s) for s in distinct})
    assert len(distinct) - len(left) >= 0.9 * (len(distinct) - groups)


def test_token_counts_and_cache(spark, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(str(path))
    rows = [*awkward(), (400, "a <|endoftext|> b<|endoftext|>", "", 0), (401, "it's   10,000\r\n\ttabs  ", "", 0)]
    cache = f"file://{tmp_path}/cache"
    want = Counter((r[0], len((r[1] or "").encode()), len(tok.encode(r[1] or "", add_special_tokens=False).ids)) for r in rows)
    for _ in range(2):
        out = token_counts.token_counts(table(spark, rows), str(path), cache).collect()
        assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in out) == want
        assert all(r.over_limit == (r.n_tokens > 512) for r in out)
        stored = spark.read.parquet(cache)
        assert stored.count() == len({r[1] or "" for r in rows})  # the second call adds nothing
    token_counts.token_counts(table(spark, [*rows, (500, "new text", "", 0)]), str(path), cache).collect()
    assert spark.read.parquet(cache).count() == len({r[1] or "" for r in rows}) + 1
    assert token_counts.token_counts(table(spark, []), str(path), f"file://{tmp_path}/none").collect() == []


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "piece_bpe_32k.model"])
def test_other_tokenizers_count(name):
    path = str(public_tokenizers.path(name))
    texts = ["Hello wörld", "", "a  b"]
    if name.endswith(".model"):
        import sentencepiece

        want = [len(x) for x in sentencepiece.SentencePieceProcessor(model_file=path).encode(texts)]
    else:
        from tokenizers import Tokenizer

        want = [len(x.ids) for x in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    assert token_counts.count_tokens(path, texts) == want


def test_pieces_equal_the_library(spark, sf):
    import sentencepiece

    path = str(public_tokenizers.path("piece_bpe_32k.model"))
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect()] + [r[1] or "" for r in awkward()] + ["a  b\nc\td ", "  x", "ﬁ é 　 z\x00b", "aaaaaaaaaaaaaaaaaaa", "▁▁a▁b", "<s> <0x41>", "👩‍👩‍👧 🏳️‍🌈", " " * 70]
    model = pieces.load(path)
    found = model.encode(texts)
    assert [i.tolist() for i in found] == lib.encode(texts)
    assert [model.decode(i) for i in found] == [lib.decode(i.tolist()) for i in found]
    out = pieces.encode_texts(table(spark), path).collect()
    assert len(out) == len(awkward()) and all(r.round_trip for r in out)
    assert pieces.encode_texts(table(spark, []), path).collect() == []


def test_unigram_viterbi_takes_the_best_sum():
    model = object.__new__(pieces.Pieces)
    own = {"a": 0, "b": 1, "ab": 2, "abc": 3, "c": 4, "bc": 5}
    model.own, model.score, model.bpe, model.longest = own, np.array([-1.0, -1.2, -1.5, -4.0, -1.1, -1.3]), False, 3
    keys = np.array([model._hash(p) for p in own], np.uint64)
    order = np.argsort(keys)
    model.keys, model.ids = keys[order], np.fromiter(own.values(), np.int64)[order]
    model._ready()
    from itertools import product

    def best(word):
        splits = [[word[i:j] for i, j in zip([0, *cut], [*cut, len(word)], strict=True)] for cut in ([k for k, x in enumerate(bits, 1) if x] for bits in product([0, 1], repeat=len(word) - 1))]
        return max(sum(model.score[own[p]] for p in s) for s in splits if all(p in own for p in s))

    for words in (["abc", "cab", "bca"], ["abcabcab", "ccbbaacb"]):
        for w, ids, n in zip(words, *model._equal_length(words), strict=True):
            assert sum(model.score[i] for i in ids[len(w) - n :]) == pytest.approx(best(w))


def test_toxicity_learns_and_is_defined(spark):
    rows, labels = [], []
    for i in range(600):
        text = prose(1000 + i, 40)
        if i % 6 == 0:
            text = text.replace("oak", "vile").replace("elm", "awful")
        rows.append((i, text, "", 0))
        labels.append((i, 0, int(i % 6 == 0)))
    marks = spark.createDataFrame([*labels, (0, 0, 1), (None, 0, 1), (3, 0, None)], "doc_id long, quality int, toxic int")
    fold = F.pmod(F.crc32(F.col("id").cast("string")), F.lit(5))
    docs = table(spark, rows + [(None, None, "", 0), (9000, "", "", 0), (9001, None, "", 0), (9000, "", "", 0)])
    out = toxicity.score_toxicity(docs, marks, fold.between(1, 3), fold == 4).collect()
    assert len(out) == len(rows) + 4 and all(0 <= r.score <= 1 for r in out)
    right = sum((r.score >= 0.5) == (r.doc_id % 6 == 0) for r in out if r.doc_id is not None and r.doc_id < 600)
    assert right > 0.95 * 600
    kept = toxicity.drop_toxic(docs, marks, fold.between(1, 3), fold == 4)
    assert kept.columns == docs.columns and kept.filter("doc_id = 9000").count() == 2
    empty = toxicity.score_toxicity(docs, marks.limit(0), fold.between(1, 3), fold == 4)
    assert {round(r.score, 6) for r in empty.collect()} == {0.0}
    assert toxicity.score_toxicity(docs.limit(0), marks, fold.between(1, 3), fold == 4).collect() == []


def test_log_ratio_is_kneser_ney():
    counts = np.zeros((2, toxicity.CELLS), np.int32)
    counts[0, :800] = np.random.default_rng(1).integers(0, 5, 800)
    counts[1, :800] = np.random.default_rng(2).integers(0, 3, 800)
    counts[1, 8 * 7] = 900
    ratio = toxicity.log_ratio(counts)
    assert ratio[8 * 7] > 2 and (ratio[800:] == ratio[800:808].tolist() * ((len(ratio) - 800) // 8)).all()


def test_licenses(spark):
    rows = [
        ("/a/LICENSE", "Released under the MIT License."),
        ("/a/b/x.py", "# code\nprint(1)"),
        ("/a/b/y.py", "# Licensed under the Apache License, Version 2.0.\n" + prose(5, 400)),
        ("/a/b/c/COPYING", "This work is licensed under the GNU General Public License, version 3."),
        ("/a/b/c/d/z.py", None),
        ("/a/b/c/d/z.py", ""),
        ("/q/r.txt", "the of and license to kill by many other unrelated words here"),
        (None, "Released under the MIT License."),
        ("top.txt", "nothing"),
        ("/a/b/c/d/z.py", ""),
    ]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "path string, text string, dir string, unit int")
    got = Counter((r.path, r.own_license, r.license, r.from_dir) for r in licenses.scan_licenses(df).collect())
    want = Counter(
        [
            ("/a/LICENSE", "MIT", "MIT", None),
            ("/a/b/x.py", None, "MIT", "/a"),
            ("/a/b/y.py", "Apache-2.0", "Apache-2.0", None),
            ("/a/b/c/COPYING", "GPL-3.0", "GPL-3.0", None),
            *[("/a/b/c/d/z.py", None, "GPL-3.0", "/a/b/c")] * 3,
            ("/q/r.txt", None, None, None),
            (None, None, None, None),
            ("top.txt", None, None, None),
        ]
    )
    assert got == want
    assert licenses.scan_licenses(df.limit(0)).collect() == []


def test_word_spans_keep_to_texts():
    data = np.frombuffer(b"ab cdef gh", np.uint8)
    starts, ends, at = common.word_spans(data, np.array([0, 4, 4, 10]), common.ALNUM)
    assert [data[a:b].tobytes() for a, b in zip(starts, ends, strict=True)] == [b"ab", b"c", b"def", b"gh"] and at.tolist() == [0, 2, 2, 4]


def test_schema_is_stable():
    assert SCHEMA.startswith("doc_id")


def test_lines_with_changed_words_and_letters_are_found(spark):
    """Copies whose edit similarity is at least 0.8 go, however many SimHash bits differ."""
    import random

    letters = "abcdefghijklmnopqrstuvwxyz"
    pairs = []
    for n in (1, 2, 3, 6, 10, 20, 40):
        for seed in range(20):
            r = random.Random(1000 * n + seed)
            words = ["".join(r.choice(letters) for _ in range(r.randint(4, 8))) for _ in range(n)]
            other = list(words)
            at = r.randrange(n)
            other[at] = "".join(r.choice(letters) for _ in words[at]) if n >= 6 else words[at][:-1] + ("q" if words[at][-1] != "q" else "z")
            pairs.append((" ".join(words), " ".join(other)))
    limits = spark.createDataFrame(pairs, "x string, y string").selectExpr("x", "y", "5 * levenshtein(x, y) <= greatest(length(x), length(y)) AS same").collect()
    similar = [(r.x, r.y) for r in limits if r.same]
    docs = spark.createDataFrame([(i, f"{x}\n{y}") for i, (x, y) in enumerate(similar)], "doc_id long, text string")
    found = [r.line_n_removed >= 1 for r in lines.dedup_lines(docs).collect()]
    assert len(found) > 100 and sum(found) >= 0.95 * len(found)


def test_long_lines_are_judged_whole(spark):
    """A word inserted near the start leaves a copy; a shared passage does not make one."""
    long = [prose(900 + i, 400) for i in range(3)]
    copies = [" ".join([*x.split()[:3], "inserted", *x.split()[3:]]) for x in long]
    other = " ".join([*prose(950, 300).split(), *long[0].split()[:100]])
    docs = spark.createDataFrame([(i, x) for i, x in enumerate([*long, *copies, other])], "doc_id long, text string")
    left = {r.doc_id: (r.text, r.line_n_removed) for r in lines.dedup_lines(docs).collect()}
    assert [left[i] for i in range(3)] == [(x, 0) for x in long]
    assert [left[3 + i] for i in range(3)] == [("", 1)] * 3 and left[6] == (other, 0)


def test_toxicity_reads_whole_words_and_unspaced_scripts():
    def units(*texts):
        raw = [t.encode() for t in texts]
        offsets = np.cumsum([0, *map(len, raw)])
        data = np.frombuffer(b"".join(raw), np.uint8)
        starts, ends, at = toxicity.spans(common.LOWER[data], offsets)
        return [[bytes(data[a:b]).decode() for a, b in zip(starts[i:j], ends[i:j], strict=True)] for i, j in zip(at[:-1], at[1:], strict=True)], toxicity.cells(data, offsets)[0]

    assert units("漢字かな", "字 ab漢cd, ไทย", "", "漢", "字x")[0] == [["漢字", "字か", "かな", "な"], ["字", "ab", "漢", "cd", "ไท", "ทย", "ย"], [], ["漢"], ["字x"[:1], "x"]]
    for a, b in (("Verantwortungslos", "Verantwortungsvoll"), ("справедливый", "справочник"), ("漢字漢字好人", "漢字漢字悪人")):
        x, y = units(a)[1], units(b)[1]
        assert len(x) == len(y) and (x != y).any()


def _plain_evidence(rows, marks):
    """Evidence of each text by dictionaries: every pair of words has a count of its own."""
    n, buckets = [{}, {}], 1 << toxicity.WORD_BITS
    units = lambda text: list(zip(["", *text.split()], text.split()))
    for i, text in rows:
        if i in marks:
            for pair in units(text):
                n[marks[i]][pair] = n[marks[i]].get(pair, 0) + 1
    seen, uses = [{}, {}], [{}, {}]
    for k in (0, 1):
        for (_, w), v in n[k].items():
            seen[k][w] = seen[k].get(w, 0) + 1
            uses[k][w] = uses[k].get(w, 0) + v
    total = sum(seen[0].values()) + sum(seen[1].values()) + 0.5 * buckets

    def discount(counts):
        ones, twos = (sum(v == x for v in counts.values()) for x in (1, 2))
        return min(0.95, max(0.1, ones / (ones + 2 * twos))) if ones + twos else 0.75

    def p(k, pair):
        d, every = discount(uses[k]), sum(uses[k].values())
        left = 1 - sum(v - d for v in uses[k].values()) / every
        low = max(uses[k].get(pair[1], 0) - d, 0) / every + left * (seen[0].get(pair[1], 0) + seen[1].get(pair[1], 0) + 0.5) / total
        d, after = discount(n[k]), [v for (c, _), v in n[k].items() if c == pair[0]]
        return low, max(n[k].get(pair, 0) - d, 0) / sum(after) + d * len(after) / sum(after) * low if after else low

    def ratio(pair):
        (low1, p1), (low0, p0) = p(1, pair), p(0, pair)
        m = n[0].get(pair, 0) + n[1].get(pair, 0)
        return np.log(low1 / low0) + (np.log(p1 / p0) - np.log(low1 / low0)) * m / (m + toxicity.TRUST)

    out = {}
    for i, text in rows:
        found = [min(toxicity.CAP, max(0, ratio(u) - toxicity.BAND)) for u in units(text)]
        out[i] = np.log(toxicity.FLOOR + sum(found) / max(1, len(found)))
    return out


@pytest.mark.parametrize("head", [1 << 21, 20, 0])
def test_toxicity_counts_every_pair_of_words(spark, monkeypatch, head):
    """Toxic is who says "oak" after an even word, so each word before counts; cells beyond the head are joined."""
    monkeypatch.setattr(toxicity, "HEAD", head)
    rows = []
    for i in range(150):
        words = [w.rstrip("0123456789") + "s" for w in prose(7000 + i, 12).split()]  # no two of these share a bucket
        tail = [f"{'odd' if i % 3 else 'even'}{(i + j) % 15} oak" for j in range(4)]
        rows.append((i, " ".join([*words, *tail])))
    marks = {i: int(i % 3 == 0) for i, _ in rows if i < 120}
    labels = spark.createDataFrame(list(marks.items()), "doc_id long, toxic int")
    docs = table(spark, [(i, t, "", 0) for i, t in [*rows, rows[130], (None, rows[0][1])]])
    got = toxicity.score_toxicity(docs, labels, F.col("id") < 90, F.col("id") >= 90).collect()
    want = _plain_evidence(rows, {i: k for i, k in marks.items() if i < 90})
    assert len(got) == 152
    apart = [(r.doc_id, r.evidence, want[r.doc_id or 0]) for r in got if abs(r.evidence - want[r.doc_id or 0]) > 1e-3]
    assert apart == []
    kept = toxicity.drop_toxic(docs, labels, F.col("id") < 90, F.col("id") >= 90)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(r.doc_id for r in got if r.doc_id is not None and r.score < 0.5)
    texts = [f"word{i} oak" for i in range(200)]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    assert len(np.unique(toxicity.cells(data, np.cumsum([0, *map(len, texts)]))[0][1::2])) == 200
