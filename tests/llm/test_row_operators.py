"""Operators that judge each row for itself, against the libraries and plain regular expressions."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, kept string"
ODD = ["", None, " \n\t", "a", "x" * 3000, "word " * 4000, "<|endoftext|>a<|endoftext|>", "it's we'll they'rex 'r", "\n\n 're", "é漢字🙂 ｗｉｄｅ", "٣٤ 12ab", "a@b.cd@e.fg x@y", "1.2.3.4.5.6.7.8 999.1.1.1", "+1 (906) 555-7738 4111 1111 1111 1111"]


def frame(spark, texts, lang="en"):
    return spark.createDataFrame([(i, t, lang, None, None, 0.5, "extra") for i, t in enumerate(texts)], SCHEMA).repartition(3)


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("  \n\t'''srtvelmdxAB12ñé漢🙂.,!- 　"), max_size=700), max_size=4))
def test_counts_equal_the_library(texts):
    from tidelane.llm.token_count import count_texts, pretokens

    assert count_texts(texts, PATH, {}) == [len(e.ids) for e in library().encode_batch(texts, add_special_tokens=False)]
    assert ["".join(p) for p in pretokens(texts)] == texts


def test_token_counts(spark):
    from tidelane.llm.token_count import token_counts

    rows = {r["doc_id"]: r for r in token_counts(frame(spark, ODD), PATH).collect()}
    t = library()
    for i, text in enumerate(ODD):
        n = len(t.encode(text or "", add_special_tokens=False).ids)
        assert (rows[i]["n_bytes"], rows[i]["n_tokens"], rows[i]["over_limit"]) == (len((text or "").encode()), n, n > 512)


def test_packing_holds_every_id_once(spark, sf_dir):
    from tidelane.llm.packing import pack

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    texts = {r[0]: r[1] for r in docs} | {10**9 + i: t for i, t in enumerate(ODD)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    pieces = pack(df, PATH).collect()
    t, at, sequences = library(), dict.fromkeys(texts, 0), {}
    for p in sorted(pieces, key=lambda p: (p["doc_id"], p["start"])):
        ids = np.array([*t.encode(texts[p["doc_id"]] or "", add_special_tokens=False).ids, 1], "<u4")
        assert p["doc_tokens"] == len(ids) and at[p["doc_id"]] == p["start"]
        assert p["ids_crc32"] == zlib.crc32(ids[p["start"] : p["start"] + p["length"]].tobytes())
        at[p["doc_id"]] += p["length"]
        sequences.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    padding = 0
    for parts in sequences.values():
        end = 0
        for offset, n in sorted(parts):
            assert offset == end
            end += n
        assert end <= 2048
        padding += 2048 - end
    assert padding < 0.05 * sum(at.values())
    assert all(at[k] == len(t.encode(x or "", add_special_tokens=False).ids) + 1 for k, x in texts.items())
    assert pack(df.limit(0), PATH).count() == 0


def test_packing_of_repeated_ids_and_clashing_columns(spark, monkeypatch):
    """Rows with one doc_id are documents of their own; shards of a few pieces pack as well."""
    from tidelane.llm import packing

    texts = ["one two", "one two", "x " * 5000, None, "y " * 900, "y " * 900] * 3
    df = spark.createDataFrame([(7, t, 1, 2, 3, 4) for t in texts], "doc_id long, text string, start int, shard int, sequence_id int, dealt int").repartition(3)
    sizes = sorted(len(library().encode(t or "", add_special_tokens=False).ids) + 1 for t in texts)
    for most in (200_000, 1):
        monkeypatch.setattr(packing, "SHARD_PIECES", most)
        monkeypatch.setattr(packing, "BROADCAST_SHARDS", 10_000 if most > 1 else 0)
        pieces = packing.pack(df, PATH).collect()
        assert sorted(p["doc_tokens"] for p in pieces if p["start"] == 0) == sizes and sum(p["length"] for p in pieces) == sum(sizes)
        ends = {}
        for p in sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"])):
            assert p["offset"] == ends.get(p["sequence_id"], 0)
            ends[p["sequence_id"]] = p["offset"] + p["length"]
        assert max(ends.values()) <= 2048


def plain_spans(text):
    out = []
    for kind, rule in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(rule, text):
            d = re.sub("[^0-9]", "", m[0])
            doubled = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(d))]
            good = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else 0, "card": 12 <= len(d) <= 19 and sum(x - 9 * (x > 9) for x in doubled) % 10 == 0, "phone": 9 <= len(d) <= 15}[kind]
            if good:
                out.append((m.start(), ["email", "ip", "card", "phone"].index(kind), m.end(), kind))
    return [(k, a, b) for a, _, b, k in sorted(out)]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab@@..--+ 0123456789()é"), max_size=80))
def test_base_spans_equal_the_patterns(text):
    from tidelane.llm.pii import KINDS, base_spans

    assert [(KINDS[k], a, b) for a, k, b in base_spans(text)] == plain_spans(text)


def test_personal_data(spark):
    from tidelane.llm.pii import find, redact

    df = frame(spark, ODD)
    for r in find(df).collect():
        base = plain_spans(ODD[r["doc_id"]] or "")
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(k == x for k, _, _ in base) for x in ("email", "ip", "card", "phone")]
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
    clean = {r["doc_id"]: r["text"] for r in redact(df).collect()}
    assert clean[1] is None and clean[5] == ODD[5] and "@b" not in clean[11]
    assert find(df.limit(0)).count() == 0


def test_disclosing_terms(spark):
    """A name that stands with one address in different contexts is found; frequent and copied words are not."""
    from tidelane.llm.pii import find, redact

    rng = random.Random(3)
    filler = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(60)]
    texts = [" ".join(rng.choices(filler, k=40)) for _ in range(80)]
    for i in range(6):
        texts[i] += f" Zaphod {rng.choice(filler)} {rng.choice(filler)} zb@mail.example.com {rng.choice(filler)}"
    texts += ["quirky copies here kk@mail.example.com"] * 5
    rows = {r["doc_id"]: r for r in find(frame(spark, texts)).collect()}
    for i in range(6):
        at = texts[i].index("Zaphod")
        assert f"term:{at}:{at + 6}" in rows[i]["spans"].split(",")
    assert all(rows[i]["spans"] == "" for i in range(6, 80)) and all("term" not in rows[i]["spans"] for i in range(80, 85))
    out = {r["doc_id"]: r["text"] for r in redact(frame(spark, texts)).collect()}
    assert "Zaphod" not in out[0] and "[email]" in out[0] and out[50] == texts[50]


def terms_by_hand(texts):
    """Kind of each disclosing term, from counts of all pairs in plain Python."""
    import collections
    import math

    word = re.compile(r"[^\W_]+")
    contexts, rows = collections.defaultdict(set), collections.defaultdict(set)
    places, alone = collections.defaultdict(set), collections.defaultdict(set)
    for i, t in enumerate(texts):
        spans = [(k, a, b) for k, a, b in plain_spans(t or "")]
        for kind, a, b in spans:
            value = t[a:b].lower() if kind == "email" else re.sub("[^0-9]", "", t[a:b])
            good = [m for m in word.finditer(t) if not any(m.start() < y and x < m.end() for _, x, y in spans)]
            near = frozenset(m[0].lower() for m in [*[m for m in good if m.end() <= a][-40:], *[m for m in good if m.start() >= b][:40]])
            e = kind, value
            places[e].add(near)
            alone[e].add(i)
            for w in near:
                contexts[e, w].add(near)
                rows[e, w].add(i)
    n, best = len(texts), {}
    held = [{w.lower() for w in word.findall(t or "")} for t in texts]
    capital = [{w.lower() for w in word.findall(t or "") if w[0].isupper()} for t in texts]
    for (e, w), c in contexts.items():
        both, docs = len(rows[e, w]), sum(w in h for h in held)
        k = min(both, len(c))
        if k < 2 or len(alone[e]) >= n:
            continue
        p = math.comb(len(places[e]), k) * math.perm(docs, k) / math.perm(n, k)
        if p * sum(x == e for x, _ in contexts) <= 0.01:
            best[w] = max(best.get(w, 0), 1 - math.log(both / docs) / math.log(len(alone[e]) / n))
    return {w: "" if s >= 0.95 else "id" if re.search("[0-9]", w) else "name" if 2 * sum(w in c for c in capital) > sum(w in h for h in held) else "word" for w, s in best.items() if s >= 0.85}


def test_terms_equal_all_pairs(spark):
    """Planted terms of entities with two to four mentions, and everything else, against counts of all pairs."""
    from tidelane.llm.pii import find, redact

    rng = random.Random(17)
    filler = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 7))) for _ in range(900)]
    texts = [" ".join(rng.choices(filler, k=rng.randint(1, 120))) for _ in range(400)]
    planted = []
    for e in range(20):
        name, value = f"{'Xy' if e % 2 else 'x9'}{filler[e]}q", f"p{e}@mail.example.com" if e % 3 else f"10.{e}.7.9"
        planted.append(name.lower())
        for i in rng.sample(range(400), 2 + e % 3):
            w = texts[i].split()
            at = rng.randint(0, len(w))
            texts[i] = " ".join([*w[:at], name, *rng.choices(filler, k=rng.randint(0, 30)), value, *w[at:]])
        if e % 4 < 2:
            texts[rng.randrange(400)] += f" {name}"
    texts += [texts[0]] * 9 + ["Copied note of one@mail.example.com"] * 30 + [None, "", "word " * 3000, "z" * 100 + " 1.2.3.4 a", "z" * 100 + " 1.2.3.4 b"]
    want = terms_by_hand(texts)
    assert len(set(planted) & set(want)) >= 18 and {"", "id", "name"} <= set(want.values())
    df = spark.createDataFrame([(i, t, 1, "x", None) for i, t in enumerate(texts)], "doc_id long, text string, told int, key string, term string").repartition(3)
    got = {r["doc_id"]: r for r in find(df).collect()}
    clean = {r["doc_id"]: r["text"] for r in redact(df).collect()}
    for i, t in enumerate(texts):
        base = plain_spans(t or "")
        terms = [(m.start(), m.end()) for m in re.finditer(r"[^\W_]+", t or "") if m[0].lower() in want and not any(m.start() < b and a < m.end() for _, a, b in base)]
        order = ["email", "ip", "card", "phone", "term"]
        spans = sorted([(a, order.index(k), b) for k, a, b in base] + [(a, 4, b) for a, b in terms])
        assert got[i]["spans"] == ",".join(f"{order[k]}:{a}:{b}" for a, k, b in spans)
        assert (got[i]["n_terms"], got[i]["n_found"]) == (len(terms), len(base))
        for a, b in terms:
            assert t is not None and not re.search(rf"(?<![^\W_]){t[a:b]}(?![^\W_])", clean[i])
    assert {c: str(redact(df).schema[c].dataType) for c in df.columns} == {c: str(df.schema[c].dataType) for c in df.columns}
    assert find(df.filter("text is null")).count() == 1


def test_language(spark, sf_dir):
    from tidelane.llm.language_id import identify

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r["doc_id"]: r for r in identify(docs).collect()}
    rows = docs.select("doc_id", "lang").collect()
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 == 1]
    assert all(got[r[0]]["held_out"] == (zlib.crc32(str(r[0]).encode()) % 3 == 1) for r in rows)
    assert sum(got[r[0]]["lang_pred"] == r[1] for r in held) >= 0.95 * len(held)
    odd = {r["doc_id"]: r for r in identify(frame(spark, ODD), docs).collect()}
    assert [odd[i]["lang_pred"] for i in (0, 1, 2)] == ["und"] * 3 and odd[5]["lang_pred"] != "und"
    none = identify(frame(spark, ["some text"], lang=None)).collect()
    assert none[0]["lang_pred"] == "und" and none[0]["score"] == 0
    assert identify(docs.limit(0)).count() == 0


def test_cross_parsing_counts_longest_matches():
    from tidelane.llm.language_id import LANE, Model, plain

    model = Model({"a": ["abcabdabe cde"], "b": ["xyzxyw zzx"]})
    for text in ("abcabd xyz", "zzzz", "cde abe qq", "ab" * 50):
        want = []
        for known in ("abcabdabe cde", "xyzxyw zzx"):
            phrases, at, t = 0, 0, plain(text)
            while at < len(t):
                k = 1
                while at + k < len(t) and t[at : at + k + 1] in known:
                    k += 1
                at, phrases = at + k, phrases + 1
            want.append(phrases)
        got = model.phrases([plain(text)])[0][0]
        assert len(text) < LANE and all(abs(g - w) <= 1 for g, w in zip(got, want))


def parsed(text, known, lane):
    """Phrases of the greedy parse of each lane of a text."""
    phrases = 0
    for a in range(0, len(text), lane):
        t, at = text[a : a + lane], 0
        while at < len(t):
            k = 1
            while at + k < len(t) and any(t[at : at + k + 1] in part for part in known):
                k += 1
            at, phrases = at + k, phrases + 1
    return phrases


def test_predictions_equal_plain_parsing(spark):
    """Whole texts of several lanes, samples of unlike sizes and scripts: phrases, languages and scores by hand."""
    import math

    from tidelane.llm.language_id import LANE, Model, identify, plain

    rng = random.Random(23)
    vocab = {k: ["".join(rng.choice(c) for _ in range(rng.randint(2, 7))) for _ in range(150)] for k, c in (("aa", "abcdefgh"), ("bb", "efghijkl"), ("cc", "abklmnop"))}
    speak = lambda k, n: " ".join(rng.choice(vocab[k]) for _ in range(n))
    known = {"aa": [speak("aa", 60) for _ in range(20)], "bb": [speak("bb", 60) for _ in range(20)], "cc": [speak("cc", 60)]}
    known["zh"] = ["".join(chr(0x4E00 + rng.randrange(4200)) for _ in range(380)) for _ in range(12)]
    known["ko"] = ["".join(chr(0xAC00 + rng.randrange(1500)) for _ in range(380)) for _ in range(12)]
    model = Model(known)
    texts = [(k, speak(k, rng.choice([3, 40, 400]))) for k in ("aa", "bb", "cc") for _ in range(12)]
    texts += [(k, "".join(rng.choice("".join(known[k])) for _ in range(700))) for k in ("zh", "ko") for _ in range(4)] + [(None, "жук 12"), (None, "!!")]
    counts, _ = model.phrases([plain(t) for _, t in texts])
    chars = [set("".join(map(plain, known[k]))) for k in model.languages]
    sizes = [sum(len(plain(t)) for t in known[k]) for k in model.languages]
    for (want, t), row, (lang, score) in zip(texts, counts, model.predict([t for _, t in texts])):
        p = plain(t)
        assert [parsed(p, [plain(x) for x in known[k]], LANE) for k in model.languages] == list(row)
        if not p.strip():
            assert (lang, score) == ("und", 0.0)
            continue
        new = [sum(c not in x for c in p) for x in chars]
        entropy = [((n - k) * math.log(size) + k * math.log(0x110000)) / len(p) for n, size, k in zip(row, sizes, new)]
        assert lang == model.languages[entropy.index(min(entropy))] and want in (None, lang)
        assert score == pytest.approx(1 / sum(math.exp(4 * (min(entropy) - e)) for e in entropy))
    for a in model.automata:
        assert a.nbytes < 10 << 20
    assert {a.table is None for a in model.automata} == {True, False}
    rows = [(i, t, k, "x") for i, (k, t) in enumerate([(k, t) for k, parts in known.items() for t in parts] * 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string")
    got = identify(df).collect()
    assert len(got) == len(rows) and sum(g["lang_pred"] == rows[g["doc_id"]][2] for g in got) >= 0.95 * len(rows)


def test_quality_score(spark, sf_dir):
    from tidelane.llm.quality_classifier import score

    docs, labels = (spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    got = {r["doc_id"]: r for r in score(docs, labels).collect()}
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    held = [k for k in truth if got[k]["held_out"]]
    assert sum(got[k]["predicted"] == truth[k] for k in held) >= 0.9 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got.values())
    odd = score(frame(spark, ODD), labels.limit(0)).collect()
    assert len(odd) == len(ODD) and {r["score"] for r in odd} == {0.5}


def test_quality_scores_equal_plain_compression(spark):
    """Scores from the model's two dictionaries and curve, recomputed by the library; repeated rows and no rows."""
    import math

    import zstandard

    from tidelane.llm import quality_classifier as Q

    rng = random.Random(27)
    good, bad = (["".join(rng.choice(c) for _ in range(6)) for _ in range(60)] for c in ("abcdefgh", "ijklmnop"))
    label = [int(rng.random() < 0.7) for _ in range(300)]
    texts = [" ".join(rng.choice(good if rng.random() < (0.7 if q else 0.3) else bad) for _ in range(50)) for q in label]
    rows = [*enumerate(texts), (5, texts[5]), (900, ""), (901, None), (902, "x" * 100_000)]
    docs = spark.createDataFrame([(i, t, "s", 2.0) for i, t in rows], "doc_id long, text string, quality string, score double")
    labels = spark.createDataFrame(list(enumerate(label)), "doc_id long, quality int")
    model = Q.learn(docs, labels.filter("crc32(cast(doc_id as string)) % 5 != 0"))

    def size(q, data):
        return len(zstandard.ZstdCompressor(level=Q.LEVEL, dict_data=zstandard.ZstdCompressionDict(model.dicts[q]), write_content_size=False, write_checksum=False, write_dict_id=False).compress(data))

    got = Q.score(docs, labels).collect()
    text = dict(rows)
    assert len(got) == len(rows)
    for r in got:
        a, b = (size(q, (text[r["doc_id"]] or "").encode()) for q in (0, 1))
        x = (model.weights[0] + model.weights[1] * ((a - b) / max(a, b) - model.centre) / model.scale).item()
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, x))))) and r["predicted"] == int(r["score"] >= 0.3)
    assert Q.score(docs.limit(0), labels).count() == 0
    held = [(r["score"], label[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] < 300]
    assert abs(np.mean([s for s, _ in held]) - np.mean([q for _, q in held])) < 0.15


def test_quality_scores_keep_the_share_beyond_the_cap(spark, monkeypatch):
    """Scores agree whether ROWS lies below or above the labels' counts, and have the labels' share."""
    from tidelane.llm import quality_classifier as Q

    rng = random.Random(21)
    good, bad = (["".join(rng.choice(c) for _ in range(6)) for _ in range(80)] for c in ("abcdefgh", "ijklmnop"))
    label = [int(rng.random() < 0.86) for _ in range(1500)]
    texts = [" ".join(rng.choice(good if rng.random() < (0.56 if q else 0.44) else bad) for _ in range(60)) for q in label]
    docs, labels = frame(spark, texts), spark.createDataFrame(list(enumerate(label)), "doc_id long, quality int")
    share, means = sum(label) / len(label), []
    for rows in (1500, 40):
        monkeypatch.setattr(Q, "ROWS", rows)
        means.append(np.mean([r["score"] for r in Q.score(docs, labels).collect()]))
    assert abs(means[0] - means[1]) < 0.06 and all(abs(m - share) < 0.06 for m in means)


def test_many_disclosing_terms_are_joined(spark, monkeypatch):
    """Beyond the bound on what is broadcast the same spans come from a join."""
    from tidelane.llm import pii

    texts = [f"note {w} Zaphod {w}{w} zb@mail.example.com {w} end" for w in ("alpha", "gamma", "delta", "omega")] + ["alpha gamma delta omega note"] * 30 + [None, ""]
    want = sorted(map(str, pii.find(frame(spark, texts)).collect()))
    clean = sorted(map(str, pii.redact(frame(spark, texts)).collect()))
    monkeypatch.setattr(pii, "BROADCAST_TERMS", 0)
    assert sorted(map(str, pii.find(frame(spark, texts)).collect())) == want
    assert sorted(map(str, pii.redact(frame(spark, texts)).collect())) == clean
    assert any("term:" in r for r in want)
