"""Operators that compare rows, against brute force on small tables."""

import base64
import collections
import hashlib
import random
import re

import numpy as np
import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, set string, hash long"
BLANK = r"[\x20\x09-\x0D]+"


def frame(spark, texts):
    """Rows with columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "en", None, 1, "x", 7) for i, t in enumerate(texts)], SCHEMA).repartition(3)


def words(text):
    return [w for w in re.split(BLANK, (text or "").translate({c: c + 32 for c in range(65, 91)})) if w]


def shingles(text, k):
    w = words(text)
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def variants(seed=1):
    """Texts with exact, near and far copies, shared passages, short ones and odd ones."""
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(400)]
    base = [[rng.choice(vocab) for _ in range(rng.choice([3, 7, 20, 31, 33, 60, 130, 300, 700]))] for _ in range(40)]
    passage = [rng.choice(vocab) for _ in range(50)]
    out = [" ".join(b) for b in base]
    for b in base * 4:
        c = list(b)
        for _ in range(rng.choice([0, 1, 1, 2, 3, len(c) // 25])):
            c[rng.randrange(len(c))] = rng.choice(vocab)
        out.append(" ".join(c) if rng.random() < 0.8 else "\n".join(c).upper())
    out += [" ".join([*b[:30], *passage]) for b in base[:20]]
    out += ["", None, " \t\n", "a", "A", "a b c", "é à", "word " * 3000, " ".join(vocab * 20)]
    return out


def components(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("width,percent", [(4, 85), (5, 80)])
def test_join_equals_all_pairs(spark, width, percent):
    from tidelane.llm.shingle_join import join

    texts = variants()
    sets = [shingles(t, width) for t in texts]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    want = components(len(texts), links)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in join(frame(spark, texts), width, percent).collect()}
    assert len(links) > 100 and got == {i: (len(sets[i]), want[i]) for i in range(len(texts))}


def test_tiles_split_large_clusters(spark, monkeypatch):
    """Blocks of a few sets give the same components as one tile."""
    from tidelane.llm import shingle_join as S

    texts = variants(2)
    want = sorted(map(tuple, S.join(frame(spark, texts), 4, 85).select("doc_id", "component_id").collect()))
    monkeypatch.setattr(S, "BLOCK_ROWS", 2)
    monkeypatch.setattr(S, "BLOCK_SHINGLES", 300)
    assert sorted(map(tuple, S.join(frame(spark, texts), 4, 85).select("doc_id", "component_id").collect())) == want


def test_join_of_few_rows(spark):
    from tidelane.llm.shingle_join import join

    assert join(frame(spark, []), 4, 85).count() == 0
    df = spark.createDataFrame([(1, "a b c d e"), (1, "a b c d e"), (2, "a b c d e"), (None, "x y z w v")], "doc_id long, text string")
    assert sorted((r["doc_id"] or -1, r["component_id"] or -1) for r in join(df, 4, 85).collect()) == [(-1, -1), (1, 1), (1, 1), (2, 1)]


def test_signature_bound_holds():
    from tidelane.llm.shingle_join import signatures

    rng = np.random.default_rng(3)
    for _ in range(50):
        pool = rng.integers(0, 2**63, 300, dtype=np.uint64)
        a, b = (np.unique(rng.choice(pool, rng.integers(5, 200))) for _ in range(2))
        m = signatures([a, b])
        assert len(np.intersect1d(a, b)) <= len(a) - int(np.bitwise_count(m[0] & ~m[1]).sum())


def test_components(spark):
    from tidelane.llm.graph import components as found

    rng = random.Random(5)
    links = [(i, i + 1) for i in range(100, 160)] + [(0, k) for k in range(1, 90)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(80)] + [(7, 7)]
    want = components(300, links)
    got = {r["node"]: r["component"] for r in found(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    touched = {x for a, b in links for x in (a, b) if a != b}
    assert got == {x: want[x] for x in touched}
    assert found(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_containment_equals_all_pairs(spark):
    from tidelane.llm.decontamination import clean, search

    texts = variants(4)
    rng = random.Random(6)
    items = []
    for t in [t for t in texts if t and len(words(t)) >= 30][:25]:
        w = words(t)[: rng.randint(12, 60)]
        if rng.random() < 0.5:
            w[rng.randrange(len(w))] = "changed"
        items.append(" ".join(w))
    items += ["", None, "a b", "no such words here at all in any text"]
    df, it = frame(spark, texts), spark.createDataFrame([(i, t, "y") for i, t in enumerate(items)], "item_id long, text string, hash string")
    ds, ts = [shingles(t, 5) for t in texts], [shingles(t, 5) for t in items]
    want = {(i, j, len(ts[j]), len(ds[i] & ts[j])) for i in range(len(ds)) for j in range(len(ts)) if ts[j] and 100 * len(ds[i] & ts[j]) >= 80 * len(ts[j])}
    assert len(want) > 30 and {tuple(r) for r in search(df, it).select("doc_id", "item_id", "n_item", "n_common").collect()} == want
    kept = clean(df, it)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == set(range(len(texts))) - {w[0] for w in want}
    assert search(df, it.limit(0)).count() == 0 and search(df.limit(0), it).count() == 0 and clean(df, it.limit(0)).count() == len(texts)


def test_sketches_are_short_and_rarely_miss():
    """The chance that a contained item hides, by the binomials, for every size of the first octaves; m levels off."""
    import math

    from tidelane.llm.decontamination import sketch_size

    for n in range(1, 2000):
        missed, m = n * 20 // 100, min(n, sketch_size(n.bit_length(), 80))
        assert math.comb(missed, m) / math.comb(n, m) <= 1e-12
    assert sketch_size(1, 80) == 1 and all(sketch_size(k, 80) <= 18 for k in range(1, 32))


@pytest.mark.parametrize("length", [20, 57, 400])
def test_dedup_equals_all_substrings(spark, length):
    from tidelane.llm.suffix_dedup import dedup

    rng = random.Random(length)
    unit = ["".join(rng.choice("ab ") for _ in range(rng.choice([length // 2, length, length + 5, 3 * length, 5 * length]))) for _ in range(12)]
    texts = ["".join(rng.choices(unit, k=rng.randint(1, 4))) + rng.choice(["", "é", "x"]) for _ in range(60)] + ["", None, "a" * (3 * length), unit[0], unit[0], "é" * length]
    data = [(t or "").encode() for t in texts]
    count = collections.Counter(b[p : p + length] for b in data for p in range(len(b) - length + 1))
    got = {r["doc_id"]: r for r in dedup(frame(spark, texts), length).collect()}
    for i, b in enumerate(data):
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            if count[b[p : p + length]] > 1:
                gone[p : p + length] = True
        left = np.frombuffer(b, np.uint8)[~gone].tobytes()
        spans = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        assert (got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"], got[i]["kept_sha256"]) == (len(b), int(gone.sum()), spans, hashlib.sha256(left).hexdigest())
    assert any(r["n_removed"] for r in got.values())
    assert dedup(frame(spark, []), length).count() == 0


@pytest.mark.parametrize("size", [8, 50])
def test_passages_equal_all_runs_of_words(spark, size):
    """Words in a run that another row has too, whatever its case and blanks; repeats inside one text do not count."""
    from tidelane.llm.suffix_dedup import dedup

    rng = random.Random(size)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    run = lambda n: [rng.choice(vocab) for _ in range(n)]
    passages = [run(rng.choice([size - 1, size, size + 1, size + 9, 3 * size])) for _ in range(12)]
    texts = [" ".join([*run(rng.randint(0, 90)), *rng.choice(passages), *run(rng.randint(0, 90))]) for _ in range(60)]
    texts += [" ".join(run(2 * size) * 3), "\n".join(passages[1]).upper(), "  ".join(passages[4]), " ".join(passages[4]), "", None, " ", "word"]
    lists = [words(t) for t in texts]
    owners = collections.defaultdict(set)
    for i, w in enumerate(lists):
        for k in range(len(w) - size + 1):
            owners[tuple(w[k : k + size])].add(i)
    got = {r["doc_id"]: r["n_passage_words"] for r in dedup(frame(spark, texts), 400, size).collect()}
    for i, w in enumerate(lists):
        held = {k + j for k in range(len(w) - size + 1) if len(owners[tuple(w[k : k + size])]) > 1 for j in range(size)}
        assert got[i] == len(held), i
    assert sum(n > 0 for n in got.values()) > 20


@pytest.mark.parametrize("length", [7, 20, 57, 200, 400])
def test_difference_cover(length):
    from tidelane.llm.suffix_dedup import cover

    v, d = cover(length)
    assert v <= length and {(a - b) % v for a in d for b in d} == set(range(v))


def rules(text):
    t = text or ""
    w = [x for x in re.split(BLANK, t) if x]
    windows = collections.Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    covered = {k + j for k in range(len(w) - 2) if windows[tuple(w[k : k + 3])] > 1 for j in range(3)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered), failed


def test_statistics_equal_plain_counts(spark):
    from tidelane.llm.quality_rules import judge

    texts = [*variants(7), "a b c a b c a b c", "x\n x\nx\n\n \nx", "# * $ | < > 🙂 é", "\x0b\x0c tabs\tand\rreturns " * 30]
    got = {r["doc_id"]: r for r in judge(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == rules(t)
        assert not (r["base_failed"] and r["kept"])
    assert judge(frame(spark, [])).count() == 0


def test_outliers_are_found_despite_many(spark):
    """A quarter of junk does not shift the estimates: it is rejected and the rest stays."""
    from tidelane.llm.quality_rules import judge

    rng = random.Random(8)
    good = [" ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(60, 400))) for _ in range(300)]
    junk = [" ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) + "***" for _ in range(rng.randint(60, 400))) for _ in range(90)]
    got = {r["doc_id"]: r["kept"] for r in judge(frame(spark, good + junk)).collect()}
    assert sum(got[i] for i in range(300)) >= 297 and not any(got[i] for i in range(300, 390))


@pytest.mark.parametrize("share", [0.3, 0.4, 0.45])
def test_outliers_are_found_up_to_half(spark, share):
    """Junk of one kind that is almost half of a group is rejected as a quarter is, and clean rows stay."""
    from tidelane.llm.quality_rules import judge

    rng = random.Random(18)
    n, bad = 300, round(300 * share / (1 - share))
    text = lambda end: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) + end for _ in range(rng.randint(60, 400)))
    got = {r["doc_id"]: r["kept"] for r in judge(frame(spark, [text("") for _ in range(n)] + [text("***") for _ in range(bad)])).collect()}
    assert sum(got[i] for i in range(n)) >= 297 and not any(got[i] for i in range(n, n + bad))


def test_distance_equals_linear_algebra(spark):
    from pyspark.sql import functions as F

    from tidelane.llm import quality_rules as Q

    rng = np.random.default_rng(9)
    x = rng.normal(size=(500, 5)) @ rng.normal(size=(5, 5))
    df = spark.createDataFrame([(float(i), "/", *map(float, r)) for i, r in enumerate(x)], "id double, fit string, " + ", ".join(f"{c} double" for c in Q.VECTOR))
    sums = [F.avg(c).alias(f"m{i}") for i, c in enumerate(Q.VECTOR)] + [F.covar_pop(c, Q.VECTOR[j]).alias(f"c{i}{j}") for i, c in enumerate(Q.VECTOR) for j in range(i + 1)]
    got = {r["id"]: r["d2"] for r in Q._distance(df.join(Q._factored(df.groupBy("fit").agg(*sums)), "fit")).collect()}
    c = x - x.mean(0)
    want = np.einsum("ij,jk,ik->i", c, np.linalg.inv(c.T @ c / len(c)), c)
    assert np.allclose([got[float(i)] for i in range(500)], want)
    assert Q.chi_square(2, 0.95) == pytest.approx(5.991465, abs=1e-5) and Q.chi_square(5, 0.999) == pytest.approx(20.515, abs=1e-3)


def test_archives_round_trip(spark, monkeypatch):
    from tidelane.llm import warc

    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 4000)
    rng = random.Random(10)
    html = ["".join(rng.choice("abc<é\r\n>") for _ in range(rng.randint(0, 900))) for _ in range(30)]
    rows = [(i, f"http://x/{i}\n", rng.choice(html), 1) for i in range(120)] + [(500, None, None, 1), (501, "u", "", 1), (501, "u", "", 1), (502, "u", "WARC/1.1\r\n\r\n", 1)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "page_id long, url string, html string, first long").repartition(3)
    first = {}
    for i, _, h, _ in sorted(rows, key=lambda r: r[0]):
        first.setdefault(h or "", i)
    want = sorted((i, len((h or "").encode()), base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode(), *(("response", None) if first[h or ""] == i else ("revisit", first[h or ""]))) for i, _, h, _ in rows)
    got = sorted((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.round_trip(df).collect())
    assert [str(x) for x in got] == [str(x) for x in want]
    assert warc.round_trip(df.limit(0)).count() == 0
    small = {r["page_id"]: r["record_type"] for r in warc.round_trip(df, 10**6).collect()}
    assert set(small.values()) == {"response"}


def test_pipeline(spark, sf_dir):
    """Stage by stage on the smallest tables: what each keeps is what brute force keeps of its input."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        docs = stage(spark, docs, sf_dir).cache()
        kept[name] = (before, docs)
        assert name == "packing" or docs.columns == columns
    before, after = kept["near_duplicates"]
    ids = sorted(before)
    sets = [shingles(before[i], 5) for i in ids]
    links = [(i, j) for i in range(len(ids)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    assert {r["doc_id"] for r in after.collect()} == {ids[c] for c in components(len(ids), links)}
    before, after = kept["decontamination"]
    items = [shingles(r["text"], 5) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    leaks = {i for i, t in before.items() if any(100 * len(shingles(t, 5) & s) >= 80 * len(s) for s in items)}
    assert leaks and {r["doc_id"] for r in after.collect()} == set(before) - leaks
    before, after = kept["personal_data"]
    from tidelane.llm.pii import base_spans

    for r in after.collect():
        assert not any(before[r["doc_id"]][a:b] in r["text"] for a, k, b in base_spans(before[r["doc_id"]]) if k == 0)
    before, after = kept["packing"]
    assert {r["doc_id"] for r in after.collect()} == set(before)
    assert {r["doc_id"] for r in kept["language"][1].collect()} == {i for i, t in kept["language"][0].items() if re.search(r"[^\W\d_]", t or "")}
