"""Quality rules: text statistics and robust multivariate outliers, in DataFrame operations only.

Base statistics are counted on each whole text. A transformed vector of them gets a minimum-covariance-determinant
estimate per language and source: from each of several starts, concentration steps take mean and covariance of the half
of the rows that lies nearest; after the FIRST steps the BEST starts of a group with the least determinants go on until
none falls, and the least of them is reweighted: all rows inside its quantile INNER give mean and covariance. Rows whose
squared Mahalanobis distance exceeds a chi-square quantile are outliers. Just under half of a group may be junk of one
kind. All estimates are aggregates by group that combine before the shuffle; no group is ever gathered.
"""

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, drop

BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
VECTOR = ("x0", "x1", "x2", "x3", "x4")
#: Least standard deviation of each coordinate: steadier groups count as this wide.
FLOOR = (0.6, 0.12, 0.05, 0.10, 0.10)
#: A group of n rows concentrates on (n + p + 1) / 2n of them, rounded up to one of these.
SUBSETS = tuple(0.5 + k / 200 for k in range(61))
FIRST, BEST = 2, 2
STEPS, FALL = 40, 1e-3  # steps at most, and the fall of the determinant's logarithm that makes another
INNER = 0.975
TAIL = 1e-6
LEAST_GROUP = 60
BROADCAST_GROUPS = 20_000


def _gamma_p(a: float, x: float) -> float:
    """The regularised lower incomplete gamma function, by its series."""
    if x <= 0:
        return 0.0
    term = total = 1 / a
    k = a
    while abs(term) > 1e-16 * abs(total):
        k += 1
        term *= x / k
        total += term
    return total * math.exp(-x + a * math.log(x) - math.lgamma(a))


def chi_square(dims: int, p: float) -> float:
    """The quantile p of the chi-square distribution."""
    low, high = 0.0, 500.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if _gamma_p(dims / 2, mid / 2) < p else (low, mid)
    return low


def _without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_repeat_words of each row."""
    d = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    trimmed = F.btrim(F.col("text"), F.lit(BLANKS))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))
    lines = F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    d = d.select(
        "doc_id",
        "lang",
        "source",
        F.length(_without(F.col("text"), BLANKS)).cast("long").alias("word_chars"),
        (F.length("text") - F.length(_without(F.col("text"), SYMBOLS))).cast("long").alias("n_symbols"),
        lines.alias("lines"),
        F.transform(words, lambda w: F.xxhash64(w)).alias("h"),
    )
    # the hashes are used several times below, so they are computed once
    n = F.size("h")
    windows = F.transform(F.slice("h", 1, F.greatest(n - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get("h", i + 1), F.get("h", i + 2)))
    d = d.select(
        "doc_id",
        "lang",
        "source",
        "word_chars",
        "n_symbols",
        n.cast("long").alias("n_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        windows.alias("k"),
    )
    # only texts in which a window repeats are sorted
    some = F.size(F.array_distinct("k")) < F.size("k")
    s = F.when(some, F.sort_array(F.transform("k", lambda x, i: F.struct(x.alias("k"), i.alias("p")))))
    d = d.withColumn("s", s)
    twice = F.transform("s", lambda e, i: F.when((e["k"] == F.get("s", i - 1)["k"]) | (e["k"] == F.get("s", i + 1)["k"]), e["p"]))
    d = d.withColumn("at", F.sort_array(F.filter(twice, lambda p: p.isNotNull())))
    covered = F.aggregate(F.transform("at", lambda p, i: F.least(F.lit(3), F.coalesce(F.get("at", i + 1) - p, F.lit(3)))), F.lit(0), lambda a, x: a + x)
    return d.select("doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def vector(stats: DataFrame) -> DataFrame:
    """stats with the transformed vector: logarithms of length and mean word length, roots of shares."""
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    chars = F.greatest(F.col("word_chars"), F.lit(1)).cast("double")
    return (
        stats.withColumn("x0", F.log(words))
        .withColumn("x1", F.log(chars / words))
        .withColumn("x2", F.sqrt(F.col("n_symbols") / chars))
        .withColumn("x3", F.sqrt(F.col("n_repeat_words") / words))
        .withColumn("x4", F.sqrt(F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))))
    )


def _few(groups: DataFrame) -> bool:
    return groups.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS


def _joined(rows: DataFrame, groups: DataFrame, few: bool, keys: tuple[str, ...] = ("fit",)) -> DataFrame:
    """Rows with their group's values: sent to every task while the groups are few, else a join that Spark may split."""
    return rows.join(F.broadcast(groups) if few else groups, list(keys))


def _distance(rows: DataFrame) -> DataFrame:
    """rows with d2, the squared Mahalanobis distance, by forward substitution with the group's Cholesky factor."""
    total = None
    for i, x in enumerate(VECTOR):
        rest = F.col(x) - F.col(f"m{i}")
        for j in range(i):
            rest = rest - F.col(f"l{i}{j}") * F.col(f"z{j}")
        rows = rows.withColumn(f"z{i}", rest / F.col(f"l{i}{i}"))
        total = F.col(f"z{i}") * F.col(f"z{i}") if total is None else total + F.col(f"z{i}") * F.col(f"z{i}")
    return rows.withColumn("d2", total)


def _factored(groups: DataFrame, keys: tuple[str, ...] = ("fit",)) -> DataFrame:
    """Cholesky factor l of the covariances c, and the logarithm of its determinant."""
    for i in range(len(VECTOR)):
        for j in range(i + 1):
            rest = F.col(f"c{i}{j}")
            for k in range(j):
                rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            value = F.sqrt(F.greatest(rest, F.lit(FLOOR[i] ** 2 / 4))) if i == j else rest / F.col(f"l{j}{j}")
            groups = groups.withColumn(f"l{i}{j}", value)
    keep = [f"l{i}{j}" for i in range(len(VECTOR)) for j in range(i + 1)]
    volume = sum(F.log(f"l{i}{i}") for i in range(len(VECTOR)))
    return groups.select(*keys, *(f"m{i}" for i in range(len(VECTOR))), *keep, volume.alias("volume"))


def _moments(factor: Column) -> list[Column]:
    """Mean m and covariance c of a group, the latter times a factor and with variances of FLOOR at least."""
    out = [F.avg(x).alias(f"m{i}") for i, x in enumerate(VECTOR)]
    for i, x in enumerate(VECTOR):
        for j in range(i + 1):
            c = F.covar_pop(x, VECTOR[j]) * factor
            out.append((F.greatest(c, F.lit(FLOOR[i] ** 2)) if i == j else c).alias(f"c{i}{j}"))
    return out


def _consistent(share: float) -> float:
    """The nearest share of normal rows underestimates their covariance by this factor."""
    return share / _gamma_p(len(VECTOR) / 2 + 1, chi_square(len(VECTOR), share) / 2)


def _starts(rows: DataFrame, few: bool) -> DataFrame:
    """fit, start, m, l: medians with quartile ranges, with tanh and with spatial-sign covariances; both outer quartiles."""
    middle = rows.groupBy("fit").agg(*(F.percentile_approx(x, [0.25, 0.5, 0.75], 2000).alias(f"q{i}") for i, x in enumerate(VECTOR)), F.count("*").alias("n"))
    for i in range(len(VECTOR)):
        middle = middle.withColumn(f"w{i}", F.greatest((F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / 1.349, F.lit(FLOOR[i])))
    middle = cut(middle, "mcd")
    scaled = _joined(rows, middle, few)
    pairs = [(i, j) for i in range(len(VECTOR)) for j in range(i + 1)]
    z = [(F.col(x) - F.col(f"q{i}")[1]) / F.col(f"w{i}") for i, x in enumerate(VECTOR)]
    norm = F.greatest(F.sqrt(sum(v * v for v in z)), F.lit(1e-9))
    bent = {"tanh": [F.tanh(v) for v in z], "sign": [v / norm for v in z]}
    # tanh about its mean, signs about the medians; the scale of a start does not matter
    shapes = [F.covar_pop(bent["tanh"][i], bent["tanh"][j]).alias(f"tanh{i}{j}") for i, j in pairs]
    shapes += [F.avg(bent["sign"][i] * bent["sign"][j]).alias(f"sign{i}{j}") for i, j in pairs]
    known = middle.join(scaled.groupBy("fit").agg(*shapes), "fit")

    def start(name: str, q: int, shape: str | None) -> Column:
        m = [F.col(f"q{i}")[q].alias(f"m{i}") for i in range(len(VECTOR))]
        c = []
        for i, j in pairs:
            own = F.lit(1.0 if i == j else 0.0) if shape is None else F.col(f"{shape}{i}{j}")
            v = own * F.col(f"w{i}") * F.col(f"w{j}")
            c.append((F.greatest(v, F.lit(FLOOR[i] ** 2 / 4)) if i == j else v).alias(f"c{i}{j}"))
        return F.struct(F.lit(name).alias("start"), *m, *c)

    every = F.array(start("median", 1, None), start("tanh", 1, "tanh"), start("sign", 1, "sign"), start("low", 0, None), start("high", 2, None))
    out = cut(_factored(known.select("fit", "n", F.explode(every).alias("x")).select("fit", "n", "x.*"), ("fit", "n", "start")), "mcd")
    drop(middle)
    return out


def _concentrated(rows: DataFrame, fit: DataFrame, few: bool) -> DataFrame:
    """One step: each start's estimate from the rows of its group that lie nearest."""
    near = _distance(_joined(rows, fit.drop("volume"), few))
    dims = len(VECTOR)
    k = F.ceil(((F.col("n") + dims + 1) / (2 * F.col("n")) - SUBSETS[0]) * 200 - F.lit(1e-9)).cast("int")
    k = F.least(F.greatest(k, F.lit(0)), F.lit(len(SUBSETS) - 1)) + 1
    factors = F.array(*(F.lit(_consistent(s)) for s in SUBSETS))
    edge = near.groupBy("fit", "n", "start").agg(F.percentile_approx("d2", list(SUBSETS), 2000).alias("edges"))
    edge = edge.select("fit", "start", F.element_at("edges", k).alias("edge"), F.element_at(factors, k).alias("factor"))
    kept = _joined(near, edge, few, ("fit", "start")).filter("d2 <= edge")
    return cut(_factored(kept.groupBy("fit", "n", "start").agg(*_moments(F.first("factor"))), ("fit", "n", "start")), "mcd")


def _least(fit: DataFrame, most: int) -> DataFrame:
    """The starts of each group with the least determinants."""
    order = Window.partitionBy("fit").orderBy("volume", "start")  # five rows a group
    return cut(fit.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most).drop("place"), "mcd")


def estimates(rows: DataFrame, few: bool) -> DataFrame:
    """fit, location m and Cholesky factor l of each group of rows (fit, x0...); few: the groups may be sent to every task."""
    fit = _starts(rows, few)
    for k in range(STEPS):
        if k == FIRST:
            fit, last = _least(fit, BEST), fit
            drop(last)
        last, fit = fit, _concentrated(rows, fit, few)
        falls = k >= FIRST and fit.join(last.select("fit", "start", F.col("volume").alias("last")), ["fit", "start"]).filter(F.col("volume") < F.col("last") - FALL).limit(1).count()
        drop(last)
        if k >= FIRST and not falls:
            break
    best = _least(fit, 1)
    near = _distance(_joined(rows, best.drop("volume"), few))
    kept = near.filter(F.col("d2") <= chi_square(len(VECTOR), INNER))
    out = cut(_factored(kept.groupBy("fit").agg(*_moments(F.lit(_consistent(INNER))))).drop("volume"), "mcd")
    drop(fit)
    drop(best)
    return out


def judge(docs: DataFrame, tail: float = TAIL) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, d2 of each row.

    Groups are language and source, null being a value of its own; those of fewer than LEAST_GROUP rows are estimated
    together with the small ones of their language, and small languages together. Without enough rows at all nothing is
    an outlier. Null and empty texts have no words and fail the base rules. Repeated rows count each; other columns are
    ignored. Only rows that pass the base rules shape the estimates.
    """
    stats = cut(vector(statistics(docs)), "statistics")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    stats = stats.withColumn("base_failed", failed).withColumn("l", F.coalesce(F.concat(F.lit("="), "lang"), F.lit("null"))).withColumn("s", F.coalesce(F.concat(F.lit("="), "source"), F.lit("null")))
    sized = stats.filter("not base_failed").groupBy("l", "s").count()
    sized = sized.withColumn("small", F.col("count") < LEAST_GROUP)
    langs = sized.filter("small").groupBy("l").agg((F.sum("count") < LEAST_GROUP).alias("few"))
    named = sized.join(langs, "l", "left").withColumn("fit", F.when(~F.col("small"), F.concat_ws("/", "l", "s")).when(~F.col("few"), F.concat("l", F.lit("/"))).otherwise(F.lit("/")))
    named = cut(named.select(F.concat_ws("/", "l", "s").alias("group"), F.col("fit").alias("own")), "groups")
    few = _few(named)
    rows = stats.withColumn("group", F.concat_ws("/", "l", "s")).join(F.broadcast(named) if few else named, "group", "left")
    rows = rows.withColumn("fit", F.coalesce("own", F.lit("/"))).drop("group", "own", "l", "s")
    fitted = cut(rows.filter("not base_failed").select("fit", *VECTOR), "vectors")
    enough = fitted.groupBy("fit").count().filter(F.col("count") >= LEAST_GROUP // 3).select("fit")
    fit = cut(estimates(fitted, few).join(enough, "fit", "left_semi"), "mcd")
    drop(fitted)
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    judged = _distance(rows.join(F.broadcast(fit) if few else fit, "fit", "left"))
    limit = chi_square(len(VECTOR), 1 - tail)
    inside = F.coalesce(F.col("d2") <= limit, F.lit(True))
    return judged.select(*names, (~F.col("base_failed") & inside).alias("kept"), "d2")
