"""Personal data: patterns for the plain kinds, and corpus co-occurrence for terms that give a protected entity away.

An entity is one value of a plain kind (an address, a number). Every term that stands within AROUND words of one of its
mentions is counted with it, over all documents; a term t discloses an entity e by
PMI(t; e) / IC(e) = 1 - log P(e|t) / log P(e), the share of the entity's information that the term reveals. The share is
taken only where the co-occurrence is no accident: t must stand in so many different contexts of e that chance would give
them, by the hypergeometric distribution and over all terms of e, with a probability of at most CHANCE. Contexts with the
same terms count once, so copies of one text prove nothing, and one context alone never tells. Terms over the upper
threshold are removed; those over the lower one are generalised to their class: an id (with a digit), a name (written with
a capital in most texts that have it) or a word.
"""

import hashlib
import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, free, released

KINDS = ("email", "ip", "card", "phone")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TERM = re.compile(r"[^\W_]+")
AROUND = 40  # words on each side of a mention that are counted with it
CHANCE = 0.01  # that an entity without any disclosing term gets one
LONG = 64  # a term of more characters is known by its hash
ROWS, COUNTS = 50_000, 200_000  # rows and term counts that a task gathers before it hands them on
REMOVE, GENERALISE = 0.95, 0.85
BROADCAST_TERMS = 200_000


def emails(text: str):
    """Leftmost matches, found from their @: what stands before it is one run of local characters."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = start < at and _DOMAIN.match(text, at + 1)
        if m:
            yield start, m.end()
            end = m.end()
        at = text.find("@", max(at + 1, end))


def _luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(2 * int(c) - 9 * (c > "4") for c in even)) % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the plain kinds, in order."""
    out = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.groups()):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        d = _digits(m[0])
        if 12 <= len(d) <= 19 and _luhn(d):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def written(spans, names=(*KINDS, "term")) -> str:
    return ",".join(f"{names[k]}:{a}:{b}" for a, k, b in spans)


def key_of(term: str) -> str:
    """A term in lower case, or its hash where it is very long."""
    term = term.lower()
    return term if len(term) <= LONG else f"\0{hashlib.sha256(term.encode('utf-8', 'surrogatepass')).hexdigest()}"


def mentions(text: str) -> Iterator[tuple[str, set[str]]]:
    """Entity and surrounding terms of each mention in a text; terms that touch a base span do not count."""
    spans = base_spans(text)
    if not spans:
        return
    found, k = [], 0
    busy = sorted((a, b) for a, _, b in spans)
    reach = np.maximum.accumulate([b for _, b in busy]).tolist()
    for m in _TERM.finditer(text):
        while k < len(busy) and reach[k] <= m.start():
            k += 1
        if not (k < len(busy) and busy[k][0] < m.end()):
            found.append((m.start(), m.end(), key_of(m[0])))
    starts, ends = [x[0] for x in found], [x[1] for x in found]
    for a, kind, b in spans:
        before, after = bisect_right(ends, a), bisect_left(starts, b)
        value = text[a:b].lower() if kind == 0 else _digits(text[a:b])
        yield f"{KINDS[kind]}:{value}", {x[2] for x in (*found[max(0, before - AROUND) : before], *found[after : after + AROUND])}


def contexts(docs: DataFrame) -> DataFrame:
    """entity, term, context, docs: the terms near each mention, and the empty term for the mention itself.

    A context is known by its set of terms. Counted per batch; docs are the rows in which this is the first context. With
    a null entity, docs are the rows in which the term stands near any mention.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        def sign(x: str) -> int:
            return xxhash.xxh3_64_intdigest(x.encode("utf-8", "surrogatepass")) - (1 << 63)

        def frame(n: Counter) -> pd.DataFrame:
            out = pd.DataFrame([(*k, v) for k, v in n.items()], columns=["entity", "term", "context", "docs"])
            return out.astype({"entity": "Int64", "term": object, "context": "int64", "docs": "int64"})

        for x in batches:
            n: Counter[tuple[int | None, str, int]] = Counter()
            for text in x["text"].fillna(""):
                met = set()
                for entity, terms in mentions(text):
                    e, context = sign(entity), sign(" ".join(sorted(terms)))
                    for t in ("", *terms):
                        n[e, t, context] += (e, t) not in met
                        met.add((e, t))
                        if t and (None, t) not in met:
                            met.add((None, t))
                            n[None, t, 0] += 1
                    if len(n) > ROWS:
                        yield frame(n)
                        n.clear()
            yield frame(n)

    return docs.select("text").mapInPandas(run, "entity long, term string, context long, docs long")


def terms_of(text: Column) -> Column:
    """The different terms of each text."""

    @F.pandas_udf("array<string>")
    def found(s: pd.Series) -> pd.Series:
        return pd.Series([list(set(map(key_of, _TERM.findall(t)))) for t in s.fillna("")])

    return found(text)


def _keys(text: str) -> set[str]:
    words = set(_TERM.findall(text.lower()))
    return {w if len(w) <= LONG else key_of(w) for w in words}


def frequencies(docs: DataFrame, only: frozenset[str] | None = None) -> DataFrame:
    """term, docs, capital: in how many texts each term stands, or each of `only`, and in how many with a capital; a
    task sums its texts before the shuffle."""
    held = docs.sparkSession.sparkContext.broadcast(only)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wanted = held.value
        n: Counter[str] = Counter()
        big: Counter[str] = Counter()

        def frame() -> pd.DataFrame:
            out = pd.DataFrame({"term": list(n), "docs": list(n.values()), "capital": [big[t] for t in n]}).astype({"term": object, "docs": "int64", "capital": "int64"})
            n.clear()
            big.clear()
            return out

        for x in batches:
            for t in x["text"].fillna(""):
                words = _keys(t) if wanted is None else _keys(t) & wanted
                if words:
                    n.update(words)
                    big.update({key_of(w) for w in _TERM.findall(t) if w[0].isupper()} & words)
                if len(n) > COUNTS:
                    yield frame()
        yield frame()
        released()

    counted = docs.select("text").mapInPandas(run, "term string, docs long, capital long")
    return counted.groupBy("term").agg(F.sum("docs").alias("docs"), F.sum("capital").alias("capital"))


def log_chance(contexts: float, both: float, docs: float, n: float) -> float:
    """Logarithm of a bound on the chance that a term of `docs` of n texts stands in `both` of an entity's contexts:
    ways to choose them, times the chance that all chosen have the term."""
    if both > docs:
        return -math.inf
    g = math.lgamma
    ways = g(contexts + 1) - g(both + 1) - g(contexts - both + 1)
    return ways + g(docs + 1) - g(docs - both + 1) - g(n + 1) + g(n - both + 1)


def disclosing(docs: DataFrame, remove: float = REMOVE, generalise: float = GENERALISE) -> DataFrame:
    """term, kind: the terms that disclose an entity of the corpus; kind is their class, empty where they are removed.

    Co-occurrence is counted over all documents, combined per entity and term before anything is joined. The frequency of
    candidate terms is counted over all texts: with the candidates sent to each worker while they are at most
    BROADCAST_TERMS, beyond that by a join on the term.
    """
    once = contexts(docs).groupBy("entity", "term", "context").agg(F.sum("docs").alias("docs"))
    met = cut(once.groupBy("entity", "term").agg(F.sum("docs").alias("both"), F.count("*").alias("contexts")), "pii-pairs")
    near, mention, n = met.filter("entity is not null"), F.col("term") == "", docs.count()
    entities = near.groupBy("entity").agg(F.max(F.when(mention, F.col("both"))).alias("alone"), F.max(F.when(mention, F.col("contexts"))).alias("places"), F.count_if(~mention).alias("terms"))
    seen_with = F.least("both", "contexts")
    pairs = near.filter(~mention & (seen_with >= 2)).withColumn("evidence", seen_with).join(entities, "entity").filter(F.col("alone") < n)

    def share(texts: str) -> Column:
        """Of the entity's information that a term in so many texts reveals."""
        return 1 - F.log(F.least(F.col("both") / F.col(texts), F.lit(1.0))) / F.log(F.col("alone") / F.lit(float(n)))

    @F.pandas_udf("double")
    def chance(places: pd.Series, evidence: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series([log_chance(a, b, d, n) for a, b, d in zip(places, evidence, texts)], dtype="float64")

    def sure(texts: str) -> Column:
        """Whether chance hardly gives a term in so many texts that evidence."""
        return chance("places", "evidence", texts) + F.log("terms") <= math.log(CHANCE)

    # a term stands in no fewer texts than near mentions, which bounds both from above: frequent words go here
    pairs = pairs.join(met.filter("entity is null").select("term", F.col("both").alias("least")), "term").filter((share("least") >= generalise) & sure("least"))
    pairs = cut(pairs, "pii-candidates")
    wanted = pairs.select("term").distinct()
    few = [r[0] for r in wanted.limit(BROADCAST_TERMS + 1).collect()]
    if not few:
        return pairs.select("term", F.lit("").alias("kind"))
    seen = frequencies(docs, frozenset(few) if len(few) <= BROADCAST_TERMS else None)

    told = pairs.join(seen, "term").filter(sure("docs")).withColumn("share", share("docs"))
    best = told.groupBy("term").agg(F.max("share").alias("share"), F.first("docs").alias("docs"), F.first("capital").alias("capital")).filter(F.col("share") >= generalise)
    kind = F.when(F.col("share") >= remove, "").when(F.col("term").rlike("[0-9]"), "id").when(2 * F.col("capital") > F.col("docs"), "name").otherwise("word")
    return best.select("term", kind.alias("kind"))


def with_terms(docs: DataFrame, terms: DataFrame):
    """docs, the name of a column added to it, and a broadcast dictionary: together the disclosing terms of each text.

    A term is written kind:term. While the terms are at most BROADCAST_TERMS they are all in the dictionary, and the
    function that takes it looks for them, so a text passes one Python worker only; beyond that the column holds them and
    the dictionary is empty.
    """
    told, key = free(docs, "told"), free(docs, "key")
    terms = cut(terms, "pii-terms")
    few = terms.limit(BROADCAST_TERMS + 1).collect()
    marks = {r["term"]: f"{r['kind']}:{r['term']}" for r in few} if len(few) <= BROADCAST_TERMS else {}
    held = docs.sparkSession.sparkContext.broadcast(marks)
    if len(few) <= BROADCAST_TERMS:
        return docs.withColumn(told, F.lit(None).cast("array<string>")), told, held
    marked = terms.select("term", F.concat_ws(":", "kind", "term").alias("mark"))
    pairs = docs.select(F.xxhash64("text").alias(key), F.explode(terms_of(F.col("text"))).alias("term")).distinct().join(marked, "term")
    lists = pairs.groupBy(key).agg(F.collect_list("mark").alias(told))  # at most the terms of one text
    return docs.withColumn(key, F.xxhash64("text")).join(lists, key, "left").drop(key), told, held


def _told(text: str | None, told, marks: dict[str, str]) -> dict[str, str]:
    """Kind of each disclosing term of a text."""
    found = (told if told is not None else ()) if not marks or not text else [marks[w] for w in _keys(text) if w in marks]
    return {t: kind for kind, _, t in (x.partition(":") for x in found)}


def all_spans(text: str, told: dict[str, str]) -> list[tuple[int, int, int]]:
    """Base spans and those of disclosing terms, which touch no base span."""
    spans = base_spans(text)
    if not told:
        return spans
    busy = sorted((a, b) for a, _, b in spans)
    reach = np.maximum.accumulate([b for _, b in busy]).tolist() if busy else []
    out, k = list(spans), 0
    for m in _TERM.finditer(text):
        while k < len(busy) and reach[k] <= m.start():
            k += 1
        if key_of(m[0]) in told and not (k < len(busy) and busy[k][0] < m.end()):
            out.append((m.start(), 4, m.end()))
    return sorted(out)


def redacted(text: str, told: dict[str, str]) -> str:
    """The text with plain kinds replaced by their names, removed terms left out and generalised ones by their class."""
    out, at = [], 0
    for a, k, b in all_spans(text, told):
        if a < at:  # inside or across the one before, which is replaced already
            at = max(at, b)
            continue
        name = KINDS[k] if k < 4 else told[key_of(text[a:b])]
        out += [text[at:a], f"[{name}]" if name else ""]
        at = b
    return "".join([*out, text[at:]])


def find(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_terms, n_found of each row.

    Offsets are code points; n_found counts the spans of the plain kinds. Null and empty texts have no spans, so
    base_sha256 is that of the empty string. Repeated rows are judged each for itself, and are one context of their
    entities; other columns are ignored. An empty table gives no rows. A term at a threshold exactly counts as over it.
    """
    own = docs.select("doc_id", "text")
    marked, column, held = with_terms(own, disclosing(own))
    schema = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_terms long, n_found long"

    @F.pandas_udf(schema)
    def found(s: pd.Series, told: pd.Series) -> pd.DataFrame:
        rows = []
        for text, t in zip(s.fillna(""), told):
            spans = all_spans(text, _told(text, t, held.value))
            base = [x for x in spans if x[1] < 4]
            kinds = [x[1] for x in base]
            rows.append((*map(kinds.count, range(4)), hashlib.sha256(written(base).encode()).hexdigest(), written(spans), len(spans) - len(base), len(base)))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    return marked.select("doc_id", found("text", column).alias("x")).select("doc_id", "x.*")


def redact(docs: DataFrame) -> DataFrame:
    """All columns of docs, with text sanitised; a null text stays null."""
    columns = docs.columns
    marked, column, held = with_terms(docs, disclosing(docs))

    @F.pandas_udf("string")
    def clean(s: pd.Series, told: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else redacted(x, _told(x, t, held.value)) for x, t in zip(s, told)], dtype=object)

    return marked.withColumn("text", clean("text", column)).select(*columns)
