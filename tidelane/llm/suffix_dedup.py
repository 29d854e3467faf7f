"""Removal of repeated substrings by difference-cover sampling of suffixes.

Whether the L bytes from a position also start elsewhere is decided in rounds of naming, as in the difference-cover
construction of suffix arrays, cut off at L bytes:

1. Sample. D is a difference cover modulo v: for any two positions some shift below v brings both into D. The samples'
   tuples, L - v + 1 bytes long, are named and the names sorted. Two equal L-byte strings share such a tuple at the same
   shift, so only positions near a sample with a repeated name remain.
2. Recurse. The remaining samples get names of L + v - 1 bytes. A repeated one settles the v positions it spans; all but
   its least occurrence need no further work.
3. Merge. The positions left, and the settled ones of least occurrences, are named by their L bytes and sorted; equal
   neighbours are repeats.

Names are 64-bit hashes, dealt to tasks by range and sorted there; a task answers which names are repeated. Texts are
dealt into groups by their hash. Every number of tasks follows the input's size.

The same rounds look for repeated runs of words as well, with words in place of bytes: a passage of WORDS words that also
stands in another text may be shorter than L bytes. Both kinds of names travel together, so nothing is shuffled twice.
"""

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop, forget, mix, released

_U = np.uint64
_B = 0x9E3779B97F4A7C15 | 1
WORDS = 50
GROUP_BYTES = 8 << 20  # of text in a group
RANGE_NAMES = 800_000  # in a task that sorts names


@cache
def cover(length: int, share: float = 0.5) -> tuple[int, tuple[int, ...]]:
    """(v, D): a perfect difference set modulo v = q * q + q + 1, with v at most that share of length.

    A larger v samples less but makes the tuples, of length - v + 1 symbols, shorter and so more often equal by chance.

    The points of a projective plane over the prime q, as powers of a root of a cubic; those in one line are D.
    """
    primes = [q for q in range(2, 200) if all(q % k for k in range(2, q)) and q * q + q + 1 <= share * length]
    for q in reversed(primes):
        v = q * q + q + 1
        for a in range(q):
            for b in range(q):
                for c in range(1, q):
                    x, line = (1, 0, 0), []
                    for i in range(v):
                        if x[2] == 0:
                            line.append(i)
                        # times the root of t^3 = a t^2 + b t + c
                        x = (x[2] * c % q, (x[0] + x[2] * b) % q, (x[1] + x[2] * a) % q)
                        if len(line) > q + 1:
                            break
                    if len(line) == q + 1 and len({(i - j) % v for i in line for j in line}) == v:
                        return v, tuple(line)
    return 1, (0,)


_POWERS: list[np.ndarray] = [np.ones(1, _U), np.ones(1, _U)]


def _powers(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, modulo 2^64."""
    if len(_POWERS[0]) <= n:
        n = max(2 * n, 1 << 16)
        for k, b in enumerate((_B, pow(_B, -1, 1 << 64))):
            run = np.full(n + 1, b, _U)
            run[0] = 1
            _POWERS[k] = np.cumprod(run)
    return _POWERS


class Text:
    """Hashes of the substrings of one text."""

    def __init__(self, data: bytes):
        self.data = np.frombuffer(data, np.uint8)
        self.n = len(data)
        up, self.down = _powers(self.n)
        self.sums = np.zeros(self.n + 1, _U)
        np.cumsum((self.data.astype(_U) + _U(1)) * up[: self.n], out=self.sums[1:])

    def names(self, at: np.ndarray, size: int) -> np.ndarray:
        """Of the `size` bytes from each position."""
        return mix((self.sums[at + size] - self.sums[at]) * self.down[at])


class Words:
    """Hashes of the runs of words of one text: A-Z lowered, words between ASCII blanks."""

    def __init__(self, data: bytes):
        words = data.lower().split()
        self.n = len(words)
        self.text = Text(b" ".join(words) + b" ")
        self.edges = np.r_[0, np.flatnonzero(self.text.data == 32) + 1]

    def names(self, at: np.ndarray, size: int) -> np.ndarray:
        """Of the `size` words from each position, apart from those of bytes."""
        a, b = self.edges[at], self.edges[at + size]
        return mix((self.text.sums[b] - self.text.sums[a]) * self.text.down[a] + _U(0x632BE59BD9B4E019))


@dataclass(frozen=True)
class Unit:
    """What is compared: strings of `length` symbols, the symbols of a text by `of`; across: in another text only."""

    name: str
    of: Callable
    length: int
    v: int
    residues: tuple[int, ...]
    across: bool

    @property
    def short(self) -> int:
        return self.length - self.v + 1

    @property
    def long(self) -> int:
        return self.length + self.v - 1

    def told(self, names: np.ndarray) -> np.ndarray:
        """Names that a text hands on: each once where only other texts count."""
        return np.unique(names) if self.across else names

    def starts(self, t) -> int:
        """Positions of a text where a string of `length` starts."""
        return max(0, t.n - self.length + 1)

    def samples(self, t, size: int) -> np.ndarray:
        return samples(t.n, size, self.v, self.residues)


def samples(n: int, size: int, v: int, residues) -> np.ndarray:
    """Positions of a text of n bytes in the cover where `size` bytes start."""
    if n < size:
        return np.zeros(0, np.int64)
    at = (np.arange(0, n, v)[:, None] + np.array(residues)).reshape(-1)
    return at[at <= n - size]


def spread(at: np.ndarray, before: int, after: int, n: int) -> np.ndarray:
    """Mask of length n of the positions from at - before up to, not including, at + after."""
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, np.maximum(at - before, 0), 1)
    np.add.at(edge, np.minimum(at + after, n), -1)
    return np.cumsum(edge[:n]) > 0


def runs(mask: np.ndarray) -> np.ndarray:
    """Starts and ends of the runs of a mask."""
    return np.flatnonzero(np.diff(np.r_[False, mask, False].astype(np.int8)))


def masked(edges, n: int) -> np.ndarray:
    """The mask whose runs these are."""
    edge = np.zeros(n + 1, np.int8)
    edges = np.frombuffer(edges, np.int64)
    edge[edges[::2]] = 1
    edge[edges[1::2]] = -1
    return np.cumsum(edge[:n], dtype=np.int8) > 0


#: part: range of names; names by group, with the groups and their counts.
NAMES = "part long, names binary, grps binary, counts binary"
HELD = 2_000_000  # names that a task gathers before it hands them on


def _emit(names: dict[int, list[np.ndarray]], ranges: int) -> pa.RecordBatch:
    """A row for each range: of names that a group met more than once two, of others one."""
    every, grps = [np.zeros(0, _U)], [np.zeros(0, np.int32)]
    for group, lists in names.items():
        found, counts = np.unique(np.concatenate(lists), return_counts=True)
        every.append(np.repeat(found, np.minimum(counts, 2)))
        grps.append(np.full(len(every[-1]), group, np.int32))
    name, grp = np.concatenate(every), np.concatenate(grps)
    part = ((name >> _U(32)) * _U(ranges) >> _U(32)).astype(np.int64)
    order = np.lexsort((grp, part))
    name, grp, part = name[order], grp[order], part[order]
    cuts = np.searchsorted(part, np.arange(ranges + 1))
    rows = []
    for k in np.flatnonzero(np.diff(cuts)):
        g, n = np.unique(grp[cuts[k] : cuts[k + 1]], return_counts=True)
        rows.append((int(k), name[cuts[k] : cuts[k + 1]].tobytes(), g.tobytes(), n.astype(np.int32).tobytes()))
    cols = list(zip(*rows)) or [()] * 4
    types = (pa.int64(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["part", "names", "grps", "counts"])


def _name_rows(ranges: int, of_row):
    """A function for mapInArrow from rows with `grp` to NAMES; of_row gives a row's names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[int, list[np.ndarray]] = {}
        held = 0
        for batch in batches:
            columns = {c: batch.column(c) for c in batch.schema.names}
            for i in range(batch.num_rows):
                new = of_row({c: x[i].as_py() for c, x in columns.items()})
                if len(new):
                    names.setdefault(columns["grp"][i].as_py(), []).append(new)
                    held += len(new)
                if held > HELD:
                    yield _emit(names, ranges)
                    names, held = {}, 0
        yield _emit(names, ranges)
        released()

    return run


def repeated(rows: DataFrame) -> DataFrame:
    """grp, hot, least: of each group's names those that occur more than once, and of these the ones it has first."""

    def run(x: pd.DataFrame) -> pd.DataFrame:
        lists = [np.frombuffer(b, _U) for b in x["names"]]
        names = np.concatenate(lists)
        grps, counts = (np.concatenate([np.frombuffer(b, np.int32) for b in x[c]]) for c in ("grps", "counts"))
        groups = np.repeat(grps, counts)
        order = np.lexsort((groups, names))
        names, groups = names[order], groups[order]
        first = np.r_[True, names[1:] != names[:-1]]
        again = np.r_[~first[1:], False]
        hot = ~first | again
        new = np.r_[True, (names[1:] != names[:-1]) | (groups[1:] != groups[:-1])]
        keep = hot & new  # one row for each name and group
        names, groups, first = names[keep], groups[keep], first[keep]
        order = np.argsort(groups, kind="stable")
        names, groups, first = names[order], groups[order], first[order]
        every, at = np.unique(groups, return_index=True)
        ends = [*at[1:], len(groups)]
        return pd.DataFrame(
            {
                "grp": every,
                "hot": [names[a:b].tobytes() for a, b in zip(at, ends)],
                "least": [names[a:b][first[a:b]].tobytes() for a, b in zip(at, ends)],
            }
        )

    return rows.groupBy("part").applyInPandas(run, "grp long, hot binary, least binary")


def _joined(parts) -> np.ndarray:
    return np.sort(np.frombuffer(b"".join(parts), _U))


def _inside(names: np.ndarray, of: np.ndarray) -> np.ndarray:
    if not len(of):
        return np.zeros(len(names), bool)
    at = np.searchsorted(of, names)
    at[at == len(of)] = 0
    return of[at] == names


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passage_words long"


def _result(doc_id, data: bytes, mask: np.ndarray | None, length: int, passages: int = 0) -> list:
    """Counts and digest of a text whose repeated positions are known."""
    if mask is None or not mask.any():
        return [doc_id, len(data), 0, 0, hashlib.sha256(data).hexdigest(), passages]
    gone = spread(np.flatnonzero(mask), 0, length, len(data))
    left = np.frombuffer(data, np.uint8)[~gone].tobytes()
    return [doc_id, len(data), int(gone.sum()), len(runs(gone)) // 2, hashlib.sha256(left).hexdigest(), passages]


def _frame(rows: list, schema: str) -> pd.DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]
    out = pd.DataFrame(rows, columns=names)
    for c in schema.split(", "):
        name, kind = c.split()
        out[name] = out[name].astype("Int64" if kind == "long" else object)
    return out


def _near(unit: Unit, t, names: np.ndarray) -> np.ndarray:
    """Round 1: edges of the positions near a sample with a repeated name."""
    at = unit.samples(t, unit.short) if unit.starts(t) else ()
    if not len(at) or not len(names):
        return np.zeros(0, np.int64)
    at = at[_inside(t.names(at, unit.short), names)]
    return runs(spread(at, unit.v - 1, 1, unit.starts(t)))


def _open_samples(unit: Unit, t, emit: np.ndarray) -> np.ndarray:
    """Samples whose long tuple lies in the text and whose v positions are all open."""
    at = unit.samples(t, unit.long)
    before = np.r_[0, np.cumsum(emit)]
    return at[before[at + unit.v] - before[at] == unit.v]


def _settled(unit: Unit, t, emit: np.ndarray, names: np.ndarray, least: np.ndarray, used: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Round 2: edges of the positions now known to repeat, and of those that are still to be named."""
    n = unit.starts(t)
    known = np.zeros(n, bool)
    if len(names):
        at = _open_samples(unit, t, emit)
        own = t.names(at, unit.long)
        hit = _inside(own, names)
        at, own = at[hit], own[hit]
        known = spread(at, 0, unit.v, n)
        # the least occurrence: this group is the first with the name, and meets it for the first time
        lead = np.zeros(len(at), bool)
        if len(least):
            where = np.minimum(np.searchsorted(least, own), len(least) - 1)
            _, firsts = np.unique(own, return_index=True)
            lead[firsts] = True
            lead &= (least[where] == own) & ~used[where]
            used[where[lead]] = True
        emit = emit & ~spread(at[~lead], 0, unit.v, n)
    return runs(known), runs(emit)


def dedup(docs: DataFrame, length: int = 400, words: int = WORDS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_passage_words of each row.

    A byte goes when it lies in a string of `length` bytes that also starts anywhere else, in the same text or another,
    judged on the input. Texts shorter than that, null and empty ones (no bytes) lose nothing. Rows that repeat a text
    are repeats of each other in whole. Other columns are ignored. n_passage_words only tells: the words that lie in a run
    of `words` words (A-Z lowered, blanks alike) which also stands in another row; no byte goes for it.
    """
    spark = docs.sparkSession
    units = (Unit("bytes", Text, length, *cover(length), False), Unit("words", Words, words, *cover(words, 0.7), True))
    opened = ", ".join(f"{u.name}_known binary, {u.name}_emit binary" for u in units)
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    n_bytes = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    groups = max(4, -(-n_bytes // GROUP_BYTES))
    texts = docs.select(F.col("doc_id").cast("long"), data.alias("text"), F.pmod(F.xxhash64("doc_id", "text"), F.lit(groups)).alias("grp"))

    def ranges(n: float) -> int:
        return int(max(4, -(-n // RANGE_NAMES)))

    def sampled(n: float) -> float:
        """Samples of n bytes of text, a word taken as six."""
        return sum(n * len(u.residues) / u.v / (6 if u.across else 1) for u in units)

    def first_names(r):
        found = [(u, u.of(r["text"])) for u in units if len(r["text"]) >= min(length, 2 * words - 1)]
        return np.concatenate([np.zeros(0, _U), *(u.told(t.names(u.samples(t, u.short), u.short)) for u, t in found if u.starts(t))])

    hot = repeated(texts.select("grp", "text").mapInArrow(_name_rows(ranges(sampled(n_bytes)), first_names), NAMES))

    def near(key, found: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        names, out = _joined(found["hot"]), []
        for doc_id, text in zip(own["doc_id"], own["text"]):
            edges = [_near(u, u.of(text), names) if len(names) and len(text) >= min(length, 2 * words - 1) else () for u in units]
            held = [text, *(x for e in edges for x in (b"", np.asarray(e, np.int64).tobytes()))] if any(map(len, edges)) else [None] * (1 + 2 * len(units))
            out.append([*(_result(doc_id, text, None, length) if held[0] is None else [doc_id, *[None] * 5]), *held])
        return _frame(out, f"{RESULT}, text binary, {opened}").assign(grp=key[0])

    first = cut(hot.groupBy("grp").cogroup(texts.groupBy("grp")).applyInPandas(near, f"{RESULT}, text binary, {opened}, grp long"), "dedup-1")
    forget(spark)
    state = [c.split()[0] for c in opened.split(", ")]
    done, left = first.filter("text is null"), first.filter("text is not null").select("doc_id", "text", "grp", *state)

    def open_texts(r):
        """Of a candidate text: each unit that has open positions, its symbols and the mask of those positions."""
        for u in units:
            if len(r[f"{u.name}_emit"]):
                t = u.of(r["text"])
                yield u, t, masked(r[f"{u.name}_emit"], u.starts(t))

    def long_names(r):
        return np.concatenate([np.zeros(0, _U), *(u.told(t.names(_open_samples(u, t, emit), u.long)) for u, t, emit in open_texts(r))])

    spans = left.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    rows = left.select("grp", "text", *state).mapInArrow(_name_rows(ranges(sampled(spans)), long_names), NAMES)

    def settle(key, found: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        names, least = _joined(found["hot"]), _joined(found["least"])
        used = np.zeros(len(least), bool)
        out = []
        for r in own.to_dict("records"):
            for u, t, emit in open_texts(r):
                known, emit = _settled(u, t, emit, names, least, used)
                r |= {f"{u.name}_known": known.tobytes(), f"{u.name}_emit": emit.tobytes()}
            out.append([r["doc_id"], r["text"], *(r[c] for c in state)])
        return _frame(out, f"doc_id long, text binary, {opened}").assign(grp=key[0])

    second = cut(repeated(rows).groupBy("grp").cogroup(left.groupBy("grp")).applyInPandas(settle, f"doc_id long, text binary, {opened}, grp long"), "dedup-2")
    forget(spark)

    def last_names(r):
        return np.concatenate([np.zeros(0, _U), *(u.told(t.names(np.flatnonzero(emit), u.length)) for u, t, emit in open_texts(r))])

    open_bytes = second.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    rows = second.select("grp", "text", *state).mapInArrow(_name_rows(ranges(open_bytes / 2), last_names), NAMES)

    def finish(key, found: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        names, out = _joined(found["hot"]), []
        for r in own.to_dict("records"):
            mask, passages = None, 0
            for u in units:
                if not len(r[f"{u.name}_known"]) and not len(r[f"{u.name}_emit"]):
                    continue
                t = u.of(r["text"])
                got, emit = (masked(r[f"{u.name}_{x}"], u.starts(t)) for x in ("known", "emit"))
                at = np.flatnonzero(emit & ~got)
                got[at[_inside(t.names(at, u.length), names)]] = True
                if u.across:
                    passages = int(spread(np.flatnonzero(got), 0, u.length, t.n).sum())
                else:
                    mask = got
            out.append(_result(r["doc_id"], r["text"], mask, length, passages))
        return _frame(out, RESULT)

    rest = repeated(rows).groupBy("grp").cogroup(second.groupBy("grp")).applyInPandas(finish, RESULT)
    names = [c.split()[0] for c in RESULT.split(", ")]
    out = cut(done.select(*names).unionByName(rest), "dedup")
    drop(first)
    drop(second)
    forget(spark)
    return out
