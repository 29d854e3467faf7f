"""Cross-tokenizer alignment against the libraries and plain loops."""

import hashlib
from collections import Counter, defaultdict

import public_tokenizers as P
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidelane.llm import alignment

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
ODD = [
    None, "", " ", "  ", "a", "\n", "x▁y", "▁", "<|endoftext|> and <s></s>", "don't  stop\t\n now ", "日本語 text 😀 é ﬁ①",
    "1234567 12,5 %", "word " * 3000, "ab" * 4000, "  wide\x85", "trailing   ", "   leading", "\x00 zero", "it's   the 's",
]


def library():
    """Ids and bytes of space + text by each library itself."""
    t = Tokenizer.from_file(A)
    t.encode_special_tokens = True
    letters = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(c): c for c in letters} | {chr(256 + k): c for k, c in enumerate(c for c in range(256) if c not in set(letters))}
    sp = sentencepiece.SentencePieceProcessor(model_file=B)

    def a(text):
        e = t.encode(" " + text, add_special_tokens=False)
        return e.ids, [bytes(byte[c] for c in x) for x in e.tokens]

    def b(text):
        ids = sp.encode(text)
        return ids, [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in ids]

    return a, b


def by_hand(texts):
    a, b = library()
    found = []
    for text in texts:
        want = (" " + text).encode() if text else b""
        (ai, ab), (bi, bb) = (a(text), b(text)) if text else (([], []), ([], []))
        if b"".join(ab) != want or b"".join(bb) != want:
            ai = bi = ab = bb = []
        ends = lambda parts: [sum(map(len, parts[: k + 1])) for k in range(len(parts))] if len(parts) < 50 else __import__("itertools").accumulate(map(len, parts))
        ae, be = list(ends(ab)), list(ends(bb))
        both = sorted(set(ae) & set(be))
        where_a, where_b = {e: k for k, e in enumerate(ae)}, {e: k for k, e in enumerate(be)}
        groups, links, i, j = [], [], 0, 0
        for e in both:
            x, y = where_a[e] + 1, where_b[e] + 1
            groups.append(",".join(map(str, ai[i:x])) + "|" + ",".join(map(str, bi[j:y])))
            links.append((ai[x - 1], bi[y - 1]))
            i, j = x, y
        found.append((len(ai), len(bi), groups, links))
    count = Counter(p for *_, links in found for p in links)
    best = defaultdict(int)
    for (_, y), n in count.items():
        best[y] = max(best[y], n)
    return [
        (n_a, n_b, len(g), len(k), sum(count[p] == best[p[1]] for p in k), sum(count[p] for p in k), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "")
        for n_a, n_b, g, k in found
    ]


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("broadcast", [alignment.BROADCAST_PAIRS, 3])
def test_odd_texts(spark, broadcast):
    docs = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string").withColumns({"row": F.lit("r"), "links": F.lit(0), "n": F.lit(1)})
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in alignment.align(docs, A, B, broadcast).collect()}
    for k, want in enumerate(by_hand(ODD)):
        assert got[k] == want, ODD[k]


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = docs.collect()
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in alignment.align(docs, A, B).collect()}
    assert got == {r.doc_id: w for r, w in zip(rows, by_hand([r.text for r in rows]))}


def test_repeats_and_nothing(spark):
    rows = [(1, "the cat"), (1, "the cat"), (None, "the cat"), (1, "the dog")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r[c] for c in ["doc_id", *COLUMNS]) for r in alignment.align(docs.fillna(-1, "doc_id"), A, B).collect())
    assert got == sorted((-1 if i is None else i, *w) for (i, _), w in zip(rows, by_hand([t for _, t in rows])))
    assert alignment.align(docs, A, B).filter("doc_id is null").count() == 1
    assert alignment.align(docs.limit(0), A, B).count() == 0


MIXED = [
    "x\n  word", "a \n b", "a\t b \tc", "a \x1c b", "a  b  c", "a  　 b", "the cat x▁y sat", "the cat sat ▁", "ends in space ",
    "it's 'tis rock 'n' roll's", "one\n\n two\r\n three", " \n", "\n ", "the  cat   sat", "<|endoftext|> the <s> cat", "é ﬁ ① 日本 語 😀 the cat", "\x85 a \x85",
]


def test_white_space_and_lossy_words(spark):
    docs = spark.createDataFrame(list(enumerate(MIXED)), "doc_id long, text string").coalesce(1)
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in alignment.align(docs, A, B).collect()}
    for k, want in enumerate(by_hand(MIXED)):
        assert got[k] == want, MIXED[k]


def test_a_word_is_aligned_once_for_many_texts(spark):
    texts = ["the cat sat on the mat", "on the mat sat the cat"] * 200
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    row = alignment.tokenized(docs, A, B).collect()
    assert sum(len(r.a_ids) for r in row) == len(alignment.byte_side(A).encode(["the cat sat on mat"])[0])


def test_pretokens_of_all_characters():
    t = Tokenizer.from_file(A)
    t.encode_special_tokens = True
    chars = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x32000 or c % 97 == 0)]
    texts = ["".join(f"a{c}1{c}'{c} {c}." for c in chars[k : k + 500]) for k in range(0, len(chars), 500)]
    for text, got in zip(texts, alignment.byte_side(A).encode(texts)):
        assert got == t.encode(" " + text, add_special_tokens=False).ids
