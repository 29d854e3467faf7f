"""Cross-tokenizer alignment: where the tokens of two tokenizers end together, and which ids they pair.

Texts are cut into words where neither tokenizer merges, so both have a token's end at each cut, and a text's groups are those
of its words in order. Python gives the words of some texts, each once, with their ids, byte ends and the token over each
byte, under both tokenizers, and each text as places in these words, and no more. The rest are Spark's own functions: the ends
that both have are an intersection of two arrays, the tokens that end there are looked up by byte, so the work on a word
follows its length, and texts are put together from their words. Pairs are counted over the corpus, and the counts come back
to the links: frequent pairs by a broadcast of bounded size, any others by a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StructField, StructType

from .common import blocks, cut, least_of_top
from .packing import _tokenizer
from .token_count import _loaded

WORDS_CHARS = 4_000_000  # characters of texts that share one table of words
ENCODED = 50_000  # words encoded by one call
BROADCAST_PAIRS = 1_000_000  # pairs that are broadcast; they are the most frequent
#: A space after another character and before no white space: byte-level pretokens begin there, and no piece goes on there.
CUT = re.compile(r" (?=\S)(?<=[^ ] )")
PRETOKEN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SIDES = [f"{side}_{what}" for side in "ab" for what in ("ids", "ends", "of")]


class Side:
    """A tokenizer as its token bytes by id, ids of words with a space before each, and whether it never merges across CUT."""

    def __init__(self, token: list[bytes], encode: Callable[[list[str]], list[list[int]]], cuts: bool):
        self.token, self.encode, self.cuts = token, encode, cuts
        self.size = np.array([len(t) for t in token], np.int64)

    def ids(self, words: list[str], n_bytes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all words, each word's number of them, and whether they spell it. n_bytes: of the words with their space."""
        parts, counts = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for start in range(0, len(words), ENCODED):
            got = self.encode(words[start : start + ENCODED])
            counts.append(np.fromiter(map(len, got), np.int64, len(got)))
            parts.append(np.fromiter(chain.from_iterable(got), np.int32, int(counts[-1].sum())))
        ids, counts = np.concatenate(parts), np.concatenate(counts)
        at = np.concatenate([[0], np.cumsum(counts)])
        ends = np.concatenate([[0], np.cumsum(self.size[ids])])[at]
        spelled = b"".join(map(self.token.__getitem__, ids.tolist()))
        if np.array_equal(np.diff(ends), n_bytes) and spelled == "".join([" " + w for w in words]).encode():
            return ids, counts, np.ones(len(words), bool)
        return ids, counts, np.array([spelled[s:e] == (" " + w).encode() for w, s, e in zip(words, ends, ends[1:])], bool)


@cache
def byte_side(path: str) -> Side:
    """A byte-level BPE file; special strings in texts are plain text."""
    _, _, quick, _ = _tokenizer(path)
    if quick is not None:
        import tiktoken

        merger, _ = _loaded.__wrapped__(path)  # not kept
        whole = tiktoken.Encoding("pretokens", pat_str=PRETOKEN, mergeable_ranks=merger.ids, special_tokens={})
        return Side(_by_id(merger.ids), lambda words: [whole.encode_ordinary(" " + w) for w in words], True)
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    t.encode_special_tokens = True
    letters = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that the file writes as themselves
    byte = {chr(c): c for c in letters} | {chr(256 + k): c for k, c in enumerate(c for c in range(256) if c not in set(letters))}
    ids = {}
    for piece, i in t.get_vocab(with_added_tokens=False).items():
        ids.setdefault(bytes(byte[c] for c in piece) if all(c in byte for c in piece) else piece.encode(), i)
    return Side(_by_id(ids, t.get_vocab_size()), lambda words: [e.ids for e in t.encode_batch([" " + w for w in words], add_special_tokens=False)], False)


def _by_id(ids: dict[bytes, int], least: int = 0) -> list[bytes]:
    out = [b""] * max(least, 1 + max(ids.values()))
    for token, i in ids.items():
        out[i] = token
    return out


@cache
def piece_side(path: str) -> Side:
    """A sentencepiece model that puts a space before a text.

    Where no piece has a space after another character and texts are not normalised, no merge crosses from a word to the
    space after it, and texts may be cut there; other models take whole texts.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    token = [bytes((int(p[3:5], 16),)) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
    cuts = _plain(model) and not any("▁" in p.lstrip("▁") for p in pieces)
    return Side(token, lambda words: model.encode(words, num_threads=1), cuts)


def _plain(model) -> bool:
    """Whether the model leaves texts as they are but for a space before them."""
    try:
        from sentencepiece import sentencepiece_model_pb2
    except ImportError:
        return False
    spec = sentencepiece_model_pb2.ModelProto.FromString(model.serialized_model_proto()).normalizer_spec
    return not spec.precompiled_charsmap and not spec.normalization_rule_tsv and spec.add_dummy_prefix and not spec.remove_extra_whitespaces


def tokenized(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Some texts a row: texts (doc_id, n_a, n_b and words by number) and, of the words, each once and with its space, one after
    another, the ids, byte ends and the place of the token over each byte under both tokenizers: a_ids, a_ends, a_of, b_ids,
    b_ends, b_of; a_last: whether a token of A is the last of a word.

    A text has no words where it is empty, or where a tokenizer's tokens do not spell it.
    """
    ints = ArrayType(IntegerType(), False)
    text = StructType([StructField("doc_id", LongType()), *(StructField(c, LongType(), False) for c in ("n_a", "n_b")), StructField("words", ints, False)])
    schema = StructType([StructField("texts", ArrayType(text, False), False), *(StructField(c, ints, False) for c in SIDES), StructField("a_last", ArrayType(BooleanType(), False), False)])

    def listed(values: pa.Array, counts: np.ndarray) -> pa.Array:
        at = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(at), values, type=pa.list_(pa.field("element", values.type, nullable=False)))

    def arrays(side: Side, ids: np.ndarray) -> list[np.ndarray]:
        """Ids, ends and the token over each byte."""
        sizes = side.size[ids]
        return [ids, np.cumsum(sizes, dtype=np.int32), np.repeat(np.arange(len(ids), dtype=np.int32), sizes)]

    def table(sides: tuple[Side, Side], docs: pa.Array, texts: list[str], cuts: bool) -> Iterator[pa.RecordBatch]:
        words = [(CUT.split(x) if cuts else [x]) if x else [] for x in texts]
        counts = np.fromiter(map(len, words), np.int64, len(words))
        coded = pa.array(list(chain.from_iterable(words)), pa.string()).dictionary_encode()
        places, distinct = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        del words
        n_bytes = pc.binary_length(coded.dictionary).to_numpy().astype(np.int64) + 1
        (a, n_a, a_spells), (b, n_b, b_spells) = (side.ids(distinct, n_bytes) for side in sides)
        del distinct
        later = np.zeros(0, np.int64)
        if not (spells := a_spells & b_spells).all():
            of_text = np.repeat(np.arange(len(texts)), counts)
            lossy = np.bincount(of_text, ~spells[places], len(texts)) > 0
            later = np.flatnonzero(lossy & (counts > 1))  # whole, such a text may be spelled
            places, counts = (np.cumsum(spells) - 1)[places[~lossy[of_text]]], counts * ~lossy
            a, b, n_a, n_b = a[np.repeat(spells, n_a)], b[np.repeat(spells, n_b)], n_a[spells], n_b[spells]
        of_text = np.repeat(np.arange(len(texts)), counts)
        n_tokens = [pa.array(np.bincount(of_text, n[places], len(texts)).astype(np.int64)) for n in (n_a, n_b)]
        columns = [docs, *n_tokens, listed(pa.array(places.astype(np.int32)), counts)]
        rows = pa.StructArray.from_arrays(columns, fields=[pa.field(f.name, c.type, f.nullable) for c, f in zip(columns, text)])
        if len(later):
            rows = rows.take(pa.array(np.delete(np.arange(len(texts)), later)))
        last = np.zeros(len(a), bool)
        last[np.cumsum(n_a) - 1] = True
        each = [rows, *map(pa.array, [*arrays(sides[0], a), *arrays(sides[1], b), last])]
        yield pa.RecordBatch.from_arrays([listed(x, np.array([len(x)])) for x in each], schema.names)
        if len(later):
            yield from table(sides, docs.take(pa.array(later)), [texts[i] for i in later], False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = byte_side(a_path), piece_side(b_path)
        for batch in batches:
            docs, texts = batch.column("doc_id"), [x or "" for x in batch.column("text").to_pylist()]
            for start, end in blocks([len(x) for x in texts], WORDS_CHARS):
                yield from table(sides, docs[start:end], texts[start:end], sides[0].cuts and sides[1].cuts)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def aligned(tokens: DataFrame) -> DataFrame:
    """row, doc_id, n_a, n_b, n_groups, groups_sha256 and links (id of A times 2^32 plus id of B, in order) of each text.

    row tells rows apart, whatever their doc_id.
    """
    t = tokens.withColumn("ends", F.array_intersect("a_ends", "b_ends"))
    ending = lambda x: F.transform("ends", lambda e: F.get(f"{x}_of", e - 1))
    t = t.withColumns({f"{x}_at": ending(x) for x in "ab"})
    # the link before each, too: groups end at links
    t = t.withColumns({f"{x}_from": F.concat(F.array(F.lit(-1)), f"{x}_at") for x in "ab"})

    def ids_of(x: str, before: Column, last: Column) -> Column:
        """The side's ids after place `before` up to `last`, joined."""
        return F.array_join(F.slice(f"{x}_ids", before + 2, last - before).cast("array<string>"), ",")

    def group(a: Column, k: Column) -> Column:
        """Group k, whose last token of A is a."""
        b, a0, b0 = F.get("b_at", k), F.get("a_from", k), F.get("b_from", k)
        single = F.concat(F.get("a_ids", a).cast("string"), F.lit("|"), F.get("b_ids", b).cast("string"))
        return F.when((a - a0 == 1) & (b - b0 == 1), single).otherwise(F.concat(ids_of("a", a0, a), F.lit("|"), ids_of("b", b0, b)))

    pair = lambda a, b: F.shiftleft(F.get("a_ids", a).cast("long"), 32).bitwiseOR(F.get("b_ids", b).cast("long"))
    groups_before = F.filter(F.sequence(F.lit(0), F.size("a_at")), lambda k: (k == 0) | F.get("a_last", F.get("a_at", k - 1)))
    t = t.select("texts", groups_before.alias("before"), F.transform("a_at", group).alias("groups"), F.zip_with("a_at", "b_at", pair).alias("links"))

    def word(k: Column) -> Column:
        first, n = F.get("before", k) + 1, F.get("before", k + 1) - F.get("before", k)
        return F.struct(F.array_join(F.slice("groups", first, n), ";").alias("groups"), F.slice("links", first, n).alias("links"))

    words = F.transform(F.when(F.size("before") > 1, F.sequence(F.lit(0), F.size("before") - 2)).otherwise(F.array().cast("array<int>")), word)

    def text(t: Column) -> Column:
        of = lambda what: F.transform(t["words"], lambda k: F.get("words", k)[what])
        sha = F.when(F.size(t["words"]) > 0, F.sha2(F.array_join(of("groups"), ";"), 256)).otherwise("")
        return F.struct(*(t[c].alias(c) for c in ("doc_id", "n_a", "n_b")), sha.alias("groups_sha256"), F.flatten(of("links")).alias("links"))

    # a text takes from the words twice, so the optimizer keeps them as a column and does not make them again for each text
    rows = t.select("texts", words.alias("words")).select(F.inline(F.transform("texts", text)))
    return rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "n_a", "n_b", F.size("links").cast("long").alias("n_groups"), "groups_sha256", "links")


def pair_counts(rows: DataFrame) -> DataFrame:
    """pair, n (links that hold it, in all rows) and best: whether no pair of the same B id has more."""
    n = cut(rows.select(F.explode("links").alias("pair")).groupBy("pair").agg(F.count("*").alias("n")), "pair-counts")
    n = n.withColumn("b", F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)))
    most = n.groupBy("b").agg(F.max("n").alias("most"))
    return cut(n.join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "pairs")


def align(docs: DataFrame, a_path: str, b_path: str, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for each row.

    Null and empty texts, and texts that a tokenizer's tokens do not spell, have zeros and ''. Rows that repeat a doc_id
    stand for themselves and all count. Other columns are ignored. Each shared end is one link, as no token is empty.
    """
    rows = cut(aligned(tokenized(docs, a_path, b_path)), "aligned")
    pairs = pair_counts(rows)
    links = rows.select("row", F.explode("links").alias("pair"))
    added = [F.sum("n").alias("count_sum"), F.sum(F.col("best").cast("long")).alias("n_best")]
    if pairs.count() <= broadcast_pairs:
        sums = links.join(F.broadcast(pairs), "pair").groupBy("row").agg(*added)
    else:
        top = cut(pairs.filter(F.col("n") >= least_of_top(pairs, "n", broadcast_pairs)), "top-pairs")
        near = links.join(F.broadcast(top), "pair")
        far = links.join(F.broadcast(top.select("pair")), "pair", "left_anti").join(pairs.hint("shuffle_merge"), "pair")
        sums = near.select("row", "n", "best").unionByName(far.select("row", "n", "best")).groupBy("row").agg(*added)
    out = rows.drop("links").join(sums, "row", "left").withColumn("n_links", F.col("n_groups"))
    return out.fillna(0, ["n_best", "count_sum"]).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
