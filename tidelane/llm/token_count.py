"""Token counts by compiled finite-state transducers.

Two deterministic transducers do the work of a byte-level BPE tokenizer:

* The splitter reads character classes and marks where each pretoken starts. A text is cut into chunks; each chunk's
  map from every start state to its end state is computed for all chunks at once, and the maps are composed by a
  parallel prefix scan, which gives the state each chunk really starts in. A second pass emits the marks.
* The merger reads the bytes of one pretoken. Its state is what the merges can still depend on: the longest suffix that
  may grow into a longer token, with the last token and relative count at each of its positions. Each transition is
  annotated with the net number of tokens it emits. Transitions are compiled when first taken and kept.
"""

import json
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blocks

# Character classes of the splitter.
LETTER, NUMBER, SPACE, BLANK, QUOTE, OTHER, S_LIKE, R, V, E, LL, PAD = range(12)
# States: nothing open; letters; numbers; others; one space; spaces ending in a space; one blank; spaces ending in a blank;
# fresh quote; quote with r, v or l.
OPEN, IN_L, IN_N, IN_O, SP, SPS, BL, BLS, Q, QR, QV, QL = range(12)
HERE, BEFORE = 16, 32  # a pretoken starts at this character, at the one before
CHUNK = 256
BLOCK_CHARS = 800_000
MEMO = 1_000_000  # pretokens kept in a worker
STATES = 300_000  # compiled states kept in a worker
# The characters with the White_Space property.
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@cache
def char_classes() -> np.ndarray:
    """Class of each code point. Planes from 4 on hold no letters or numbers."""
    out = np.full(0x110000, OTHER, np.uint8)
    out[:0x40000] = [{"L": LETTER, "N": NUMBER}.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x40000)]
    out[WHITE] = BLANK
    for chars, kind in ((" ", SPACE), ("'", QUOTE), ("stmd", S_LIKE), ("r", R), ("v", V), ("e", E), ("l", LL)):
        out[[ord(c) for c in chars]] = kind
    return out


@cache
def splitter() -> tuple[np.ndarray, np.ndarray]:
    """Transitions and marks by class * 16 + state."""
    step, mark = np.zeros(12 * 16, np.uint8), np.zeros(12 * 16, np.uint8)
    letters = (LETTER, S_LIKE, R, V, E, LL)

    def fresh(kind: int) -> int:
        """The state after a first character of this class."""
        return IN_L if kind in letters else {NUMBER: IN_N, SPACE: SP, BLANK: BL, QUOTE: Q, OTHER: IN_O}[kind]

    def rule(state: int, kind: int) -> tuple[int, int]:
        if kind == PAD:
            return state, 0
        white = kind in (SPACE, BLANK)
        if state in (SP, SPS, BL, BLS):
            if white:
                return (SPS if kind == SPACE else BLS), 0
            if state in (SP, SPS):  # the last space joins what follows; a quote after it is no contraction
                return (IN_O if kind == QUOTE else fresh(kind)), BEFORE * (state == SPS)
            return fresh(kind), HERE | BEFORE * (state == BLS)
        if state == Q:
            if kind == S_LIKE:
                return OPEN, 0
            if kind in (R, V, LL):
                return {R: QR, V: QV, LL: QL}[kind], 0
            return (IN_O, 0) if kind in (QUOTE, OTHER) else (fresh(kind), HERE)
        if state in (QR, QV, QL):
            if kind == (LL if state == QL else E):
                return OPEN, 0
            to, m = rule(IN_L, kind)  # no contraction: letters began one character ago
            return to, m | BEFORE
        if state == IN_L and kind in letters or state == IN_N and kind == NUMBER:
            return state, 0
        if state == IN_O and kind in (OTHER, QUOTE):
            return state, 0
        return fresh(kind), HERE

    for state in range(12):
        for kind in range(12):
            step[kind * 16 + state], mark[kind * 16 + state] = rule(state, kind)
    return step, mark


def chunk_maps(kinds: np.ndarray, step: np.ndarray) -> np.ndarray:
    """[chunks, states]: where each start state ends after a chunk; kinds: [characters, chunks].

    Most maps become constant after a few characters; such chunks go on with one state.
    """
    n = kinds.shape[1]
    out = np.zeros((n, 12), np.uint8)
    full, maps = np.arange(n), np.tile(np.arange(12, dtype=np.uint8), (n, 1))
    for start, end in zip((0, 12, 24, 48, 96), (12, 24, 48, 96, len(kinds))):
        for k in range(start, end):
            maps = step[kinds[k, full][:, None] + maps]
        constant = (maps == maps[:, :1]).all(1)
        one, state = full[constant], maps[constant, 0]
        for k in range(end, len(kinds)):
            state = step[kinds[k, one] + state]
        out[one] = state[:, None]
        full, maps = full[~constant], maps[~constant]
    out[full] = maps
    return out


def scan_states(maps: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The start state of every chunk: an exclusive parallel prefix scan over the chunks' state maps.

    maps: [chunks, states]; first: whether a chunk is the first of its text, where the state is OPEN.
    """
    run, head, shift = maps.copy(), first.copy(), 1
    while shift < len(run) and not head.all():
        before = run[:-shift]
        joined = np.take_along_axis(run[shift:], before, axis=1)
        run[shift:] = np.where(head[shift:, None], run[shift:], joined)
        head[shift:] |= head[:-shift].copy()
        shift *= 2
    out = np.zeros(len(run), np.uint8)
    out[1:] = run[:-1, OPEN]
    out[first] = OPEN
    return out


def pretoken_starts(texts: list[str]) -> list[np.ndarray]:
    """For each text, where its pretokens start."""
    sizes = np.array([len(t) for t in texts], np.int64)
    if not sizes.sum():
        return [np.zeros(0, np.int64) for _ in texts]
    step, mark = splitter()
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = char_classes()[codes]
    n_chunks = -(-sizes // CHUNK)
    lanes = np.full((int(n_chunks.sum()), CHUNK), PAD, np.uint8)
    at = np.repeat(np.cumsum(n_chunks) - n_chunks, sizes) * CHUNK + (np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes))
    lanes.reshape(-1)[at] = kinds
    first = np.zeros(len(lanes), bool)
    first[(np.cumsum(n_chunks) - n_chunks)[n_chunks > 0]] = True
    wide = np.ascontiguousarray(lanes.T).astype(np.intp) * 16
    starts = np.zeros(len(lanes), np.uint8)
    need = np.flatnonzero(~first) - 1  # maps matter for chunks that another one follows
    if len(need):
        maps = np.tile(np.arange(12, dtype=np.uint8), (len(lanes), 1))
        maps[need] = chunk_maps(wide[:, need], step)
        starts = scan_states(maps, first)
    marks, state = np.zeros((CHUNK, len(lanes)), np.uint8), starts.astype(np.intp)
    for k in range(CHUNK):
        key = wide[k] + state
        marks[k] = mark[key]
        state = step[key].astype(np.intp)
    flat = marks.T.reshape(-1)[at]
    begins = (flat & HERE) > 0
    begins[:-1] |= (flat[1:] & BEFORE) > 0
    ends = np.cumsum(sizes)
    last = (np.cumsum(n_chunks) - 1)[sizes > 0]
    begins[(ends[sizes > 0] - 1)[np.isin(state[last], (QR, QV, QL))]] = True
    where = np.flatnonzero(begins)
    return [where[a:b] - s for a, b, s in zip(np.searchsorted(where, ends - sizes), np.searchsorted(where, ends), ends - sizes)]


def pretokens(texts: list[str]) -> list[list[str]]:
    """The pretokens of each text, in order; together they are the text."""
    out = []
    for t, s in zip(texts, pretoken_starts(texts)):
        s = s.tolist()
        out.append([t[a:b] for a, b in zip(s, [*s[1:], len(t)])])
    return out


class Merger:
    """The transducer over the bytes of a pretoken, compiled from the merges as it is used."""

    def __init__(self, vocab: dict[str, int], merges: list):
        chars = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that the file writes as themselves
        byte = {chr(c): c for c in chars} | {chr(256 + k): c for k, c in enumerate(c for c in range(256) if c not in set(chars))}
        self.ids = {bytes(byte[c] for c in t): i for t, i in vocab.items()}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        self.rank = {tuple(bytes(byte[c] for c in t) for t in m): k for k, m in enumerate(pairs)}
        self.grows = {t[:k] for t in self.ids for k in range(1, len(t))}
        self.fits: dict[tuple[bytes, bytes], bool] = {}
        self.reset()

    def reset(self) -> None:
        self.states: dict = {(b"", (None,), (0,)): 0}
        self.about: list = [(b"", (None,), (0,))]
        self.next: list[dict[int, tuple[int, int]]] = [{}]

    def merged(self, text: bytes) -> list[bytes]:
        """Merges in order of rank, on a short string."""
        parts = [text[i : i + 1] for i in range(len(text))]
        while len(parts) > 1:
            rank, i = min((self.rank.get((a, b), 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == 1 << 60:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def fit(self, a: bytes | None, b: bytes) -> bool:
        """Whether b may follow a: merging both together leaves them as they are."""
        if a is None:
            return self.merged(b) == [b]
        known = self.fits.get((a, b))
        if known is None:
            if len(self.fits) > MEMO:
                self.fits.clear()
            known = self.fits[a, b] = self.merged(a + b) == [a, b]
        return known

    def compiled(self, state: int, byte: int) -> tuple[int, int]:
        tail, last, count = self.about[state]
        new = tail + bytes((byte,))
        for k in range(len(new)):
            token = new[k:]
            if token in self.ids and self.fit(last[k], token):
                n = count[k] + 1
                break
        keep = next((k for k in range(len(new)) if new[k:] in self.grows), len(new))
        lasts, counts = (*last, token)[keep:], (*count, n)[keep:]
        about = (new[keep:], lasts, tuple(c - counts[-1] for c in counts))
        to = self.states.get(about)
        if to is None:
            to = self.states[about] = len(self.about)
            self.about.append(about)
            self.next.append({})
        self.next[state][byte] = to, n
        return to, n

    def count(self, pretoken: str) -> int:
        state = total = 0
        step = self.next
        for byte in pretoken.encode("utf-8", "surrogatepass"):
            got = step[state].get(byte)
            state, n = got if got is not None else self.compiled(state, byte)
            total += n
        if len(self.about) > STATES:
            self.reset()
        return total


@cache
def _loaded(path: str) -> tuple[Merger, tuple[str, ...]]:
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre, model = spec["pre_tokenizer"], spec["model"]
    if spec.get("normalizer") or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or model["type"] != "BPE" or any(x["lstrip"] or x["rstrip"] or x["single_word"] for x in spec["added_tokens"]):
        raise ValueError(f"{path}: only byte-level BPE with plain added tokens can be compiled")
    return Merger(model["vocab"], model["merges"]), tuple(x["content"] for x in spec["added_tokens"])


@cache
def _memo(path: str) -> dict[str, int]:
    """Counts of pretokens, kept from task to task of a worker."""
    return {}


def split_special(text: str, specials) -> tuple[list[str], int]:
    """The parts of a text between special strings, and how many of those there are."""
    parts, n = [text], 0
    for s in specials:
        if s in text:
            parts = [p for x in parts for p in x.split(s)]
    if len(parts) > 1:
        n = len(parts) - 1
    return parts, n


def count_texts(texts: list[str], path: str, memo: dict[str, int]) -> list[int]:
    """Tokens of each text. memo: pretokens met before; cleared when full."""
    merger, specials = _loaded(path)
    out = []
    for a, b in blocks([len(t) for t in texts], BLOCK_CHARS):
        split = [split_special(t, specials) for t in texts[a:b]]
        pieces = iter(pretokens([p for parts, _ in split for p in parts]))
        for parts, n in split:
            for _ in parts:
                words = next(pieces)
                try:
                    n += sum(map(memo.__getitem__, words))
                except KeyError:
                    if len(memo) > MEMO:  # short pretokens are the frequent ones
                        for w in [w for w in memo if len(w) > 6]:
                            del memo[w]
                    for w in set(words).difference(memo):
                        memo[w] = merger.count(w)
                    n += sum(map(memo.__getitem__, words))
            out.append(n)
    return out


def token_count(text: Column, path: str) -> Column:
    """Tokens of a text column as a long; a null text counts as the empty one."""

    @F.pandas_udf("long")
    def counted(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        memo = _memo(path)
        for s in parts:
            yield pd.Series(count_texts(s.fillna("").tolist(), path, memo), dtype="int64")

    return counted(text)


def token_counts(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row.

    Null and empty texts have no bytes and no tokens. Special strings inside a text are one token each. Repeated rows
    are counted each for itself; other columns are ignored. Nothing is shuffled.
    """
    n = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), token_count(F.col("text"), path).alias("n_tokens"))
    return n.withColumn("over_limit", F.col("n_tokens") > limit)
