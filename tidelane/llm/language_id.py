"""Language identification by cross-parsing entropy.

A suffix automaton of labelled text per language gives the longest match from any position of a new text; parsing the text
greedily into such matches takes fewer phrases the closer the language. Phrases per character times the logarithm of the
training size estimate the cross-entropy, whatever the sizes; a character that a language does not know costs the logarithm
of all code points. The language with the least wins.
"""

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, crc_mod, released

SAMPLE_CHARS = 24_000  # labelled text a language is learned from at most
PART_CHARS = 400  # of one document, from a place that its hash gives
LANGUAGES = 1000  # learned at most: those with the most labelled rows
NOT_LETTERS = re.compile(r"[\W\d_]+")
DENSE = 2_400_000  # entries of a table of all states and characters at most; beyond it only moves are kept
UNKNOWN = float(np.log(0x110000))
LANE = 512
BLOCK_CHARS = 1_000_000


class Automaton:
    """Suffix automaton of a list of symbols: 0 separates documents, 1 is unknown, the text's own start from 2.

    No phrase runs over a separator. A small alphabet gets a table of all states and symbols. Of a large one only the moves
    are kept, interleaved in one array: that from state s on symbol c lies at offset[s] + c, if owner has s there.
    """

    def __init__(self, text: list[int], symbols: int):
        nxt: list[dict[int, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in text:
            cur = len(nxt)
            nxt.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in nxt[p]:
                nxt[p][c] = cur
                p = link[p]
            if p >= 0:
                q = nxt[p][c]
                if length[q] == length[p] + 1:
                    link[cur] = q
                else:
                    copy = len(nxt)
                    nxt.append(dict(nxt[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and nxt[p].get(c) == q:
                        nxt[p][c] = copy
                        p = link[p]
                    link[q] = link[cur] = copy
            last = cur
        moves = [{c: to for c, to in m.items() if c} for m in nxt]
        self.root = np.zeros(symbols, np.int32)
        for c, to in moves[0].items():
            self.root[c] = to
        self.width, self.table = symbols, None
        if len(moves) * symbols <= DENSE:
            self._fill(moves)
        else:
            self._place(moves)

    def _fill(self, moves: list[dict[int, int]]) -> None:
        """table: the next state times 4, and the phrases that end with the step."""
        table = np.empty((len(moves), self.width), np.int32)
        table[:] = self.root * 4 + 1 + (self.root == 0)
        table[0] = 1
        for s, m in enumerate(moves):
            for c, to in m.items():
                table[s, c] = to * 4
        self.table = table.reshape(-1)

    def _place(self, moves: list[dict[int, int]]) -> None:
        """Rows of several moves at hashed places that are free, the longest first; rows of one move fill the gaps."""
        span = 3 * sum(len(m) for m in moves if len(m) > 1) + sum(len(m) == 1 for m in moves) + self.width
        used = bytearray(span + 2 * self.width)
        self.offset = np.full(len(moves), self.width, np.int32)
        for s in sorted((s for s, m in enumerate(moves) if len(m) > 1), key=lambda s: (-len(moves[s]), s)):
            at = s * 0x9E3779B1 % span
            while any(used[at + c] for c in moves[s]):
                at += 1
                if at + self.width > len(used):
                    used += bytes(self.width)
            for c in moves[s]:
                used[at + c] = 1
            self.offset[s] = at
        gaps = (k for k in range(self.width, len(used)) if not used[k])
        for s, m in enumerate(moves):
            if len(m) == 1:
                self.offset[s] = next(gaps) - next(iter(m))
        end = int(self.offset.max()) + self.width
        self.owner, self.to = np.full(end, -1, np.int32), np.zeros(end, np.int32)
        for s, m in enumerate(moves):
            for c, to in m.items():
                self.owner[self.offset[s] + c], self.to[self.offset[s] + c] = s, to

    def step(self, state: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Next states, and the phrases that end: that before a symbol which does not go on, and an unknown one itself."""
        if self.table is not None:
            got = self.table[state * self.width + c]
            return got >> 2, got & 3
        at = self.offset[state] + c
        hit = self.owner[at] == state
        to = np.where(hit, self.to[at], self.root[c])
        return to, (~hit & (state != 0)).view(np.int8) + (to == 0).view(np.int8)

    @property
    def nbytes(self) -> int:
        return sum(x.nbytes for x in vars(self).values() if isinstance(x, np.ndarray))


def plain(text: str) -> str:
    """Lower case, with one blank for each run of other characters than letters."""
    return NOT_LETTERS.sub(" ", text.lower())


class Model:
    """Per-language automata over one alphabet: the characters of all samples. Others are unknown to every language."""

    def __init__(self, texts: dict[str, list[str]]):
        self.languages = sorted(texts)
        held = {lang: [plain(t) for t in texts[lang]] for lang in self.languages}
        self.alphabet = np.array(sorted({ord(c) for parts in held.values() for t in parts for c in t}), np.uint32)
        self.weights = np.log(np.maximum([sum(map(len, held[lang])) for lang in self.languages], 2)) if held else np.zeros(0)
        self.own, self.automata = [], []  # own: a language's symbols of those of all
        for lang in self.languages:
            run = [self.symbols(t) for t in held[lang]]
            mine = np.unique(np.concatenate(run)) if run else np.zeros(0, np.int32)
            own = np.ones(len(self.alphabet) + 2, np.int32)
            own[mine], own[0] = np.arange(2, len(mine) + 2), 0
            self.own.append(own)
            self.automata.append(Automaton([int(s) for r in run for s in [*own[r], 0]], len(mine) + 2))

    def symbols(self, text: str) -> np.ndarray:
        """1 for an unknown character, from 2 on by place in the alphabet."""
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        if not len(self.alphabet):
            return np.ones(len(codes), np.int32)
        at = np.minimum(np.searchsorted(self.alphabet, codes), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == codes, at + 2, 1).astype(np.int32)

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """[texts, languages]: phrases of each text, which is parsed in lanes of LANE characters side by side, and how many
        of them are unknown characters.

        A phrase is the longest match from where the last one ended, a character that is unknown to the language alone.
        """
        sizes = np.array([len(t) for t in texts], np.int64)
        lanes_of = -(-sizes // LANE)
        lanes = np.zeros((int(lanes_of.sum()), LANE), np.int32)
        at = np.repeat(np.cumsum(lanes_of) - lanes_of, sizes) * LANE + (np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes))
        lanes.reshape(-1)[at] = self.symbols("".join(texts))
        owner = np.repeat(np.arange(len(texts)), lanes_of)
        filled = (lanes != 0).sum(1)
        order = np.argsort(-filled, kind="stable")  # full lanes first: later steps touch fewer
        lanes, owner, filled = lanes[order], owner[order], filled[order]
        columns = np.ascontiguousarray(lanes.T)
        live = np.searchsorted(-filled, -np.arange(LANE), side="left")
        out, unknown = np.zeros((2, len(texts), len(self.languages)))
        for k, (own, a) in enumerate(zip(self.own, self.automata)):
            mine = own[columns]
            state = np.zeros(len(lanes), np.int32)
            ended = np.zeros(len(lanes), np.int32)
            for i in range(LANE):
                n = live[i]
                if not n:
                    break
                state[:n], done = a.step(state[:n], mine[i, :n])
                ended[:n] += done
            ended += state != 0  # the phrase still open at a lane's end
            out[:, k] = np.bincount(owner, ended, len(texts))
            unknown[:, k] = np.bincount(owner, (mine == 1).sum(0), len(texts))
        return out, unknown

    def predict(self, texts: list[str]) -> list[tuple[str, float]]:
        """(language, score) of each text: und and 0 without a letter, else the score compares the best with the rest."""
        out: list[tuple[str, float]] = []
        for a, b in blocks([len(t) for t in texts], BLOCK_CHARS):
            part = [plain(t) for t in texts[a:b]]
            for row, new, t in zip(*self.phrases(part), part):
                if not self.languages or not t.strip():
                    out.append(("und", 0.0))
                    continue
                entropy = ((row - new) * self.weights + new * UNKNOWN) / len(t)
                best = int(np.argmin(entropy))
                weight = np.exp(-4.0 * (entropy - entropy[best]))
                out.append((self.languages[best], float(1 / weight.sum())))
        return out


def sample(docs: DataFrame, most_chars: int = SAMPLE_CHARS) -> dict[str, list[str]]:
    """Labelled text: for each language, parts of the documents with the least hashes.

    The bound: SAMPLE_CHARS characters a language, PART_CHARS a document, and the LANGUAGES languages with the most
    labelled rows. Every labelled document may be chosen, and any place of it; each task keeps the best few of a language,
    which a second step joins.
    """
    rows = most_chars // PART_CHARS
    labelled = docs.filter(F.col("lang").isNotNull() & F.col("text").rlike("[^\\s\\d\\p{Punct}]"))
    first = F.pmod(F.xxhash64("text"), F.greatest(F.length("text") - PART_CHARS + 1, F.lit(1))).cast("int") + 1
    near = labelled.select("lang", F.substring(F.col("text"), first, F.lit(PART_CHARS)).alias("part")).withColumn("h", F.xxhash64("part")).withColumn("cell", F.pmod("h", F.lit(rows * 2)))
    cells = near.groupBy("lang", "cell").agg(F.min_by("part", "h").alias("part"), F.count("*").alias("n"))
    per_language = cells.groupBy("lang").agg(F.sum("n").alias("n"), F.sort_array(F.collect_list(F.struct("cell", "part"))).alias("parts"))  # 2 * rows parts at most
    out: dict[str, list[str]] = {}
    for r in per_language.orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect():
        parts = out.setdefault(r["lang"], [])
        for _, part in r["parts"]:
            if sum(map(len, parts)) < most_chars:
                parts.append(part)
    return out


def learn(docs: DataFrame) -> Model:
    """A model of the labelled documents; without any, every text is und."""
    return Model(sample(docs))


def language(text: Column, model: Model) -> Column:
    """struct<lang_pred, score> of a text column."""
    held = SparkSession.active().sparkContext.broadcast(model)  # about 10 MB a language at most

    @F.pandas_udf("lang_pred string, score double")
    def predicted(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in parts:
            yield pd.DataFrame(held.value.predict(s.fillna("").tolist()), columns=["lang_pred", "score"])
        released()

    return predicted(text)


def identify(docs: DataFrame, learn_from: DataFrame | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of each row.

    Learned from text and lang of rows whose crc32(doc_id) mod 3 is not 1 (or of learn_from). A null text or one without
    a letter is `und` with score 0; ties go to the first language by name; without labelled rows all is `und`. Repeated
    rows are judged each for itself, and teach the same part once. Other columns are ignored; an empty table gives no rows.
    """
    rest = crc_mod(F.col("doc_id"), 3)
    model = learn(docs.filter(rest != 1) if learn_from is None else learn_from)
    out = docs.select("doc_id", (rest == 1).alias("held_out"), language(F.col("text"), model).alias("x"))
    return out.select("doc_id", "held_out", "x.lang_pred", "x.score")
