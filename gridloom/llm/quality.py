"""Quality rules by robust multivariate outliers, DataFrame functions only.

Each text gives a few counts, then a vector of transformed statistics.  For every
language and source the minimum covariance determinant is searched for: from several
starts (medians with quartile ranges, and ``SUBSETS`` small subsets of the group chosen
by a hash), two concentration steps each take the documents nearest by Mahalanobis
distance (a share ``H`` of the group) as the next centre and scatter; the start with the
least determinant goes on until no step lowers it any more (``STEPS`` steps at most).
A document whose distance to its group's final estimate exceeds ``CUTOFF`` goes.

Statistics are whole thousandths, so sums are exact and quantiles count a bounded
number of distinct values: the estimates do not depend on the order of rows, and a
group of any size is only ever summed, never gathered.

Groups of fewer than ``MIN_GROUP`` documents share the estimate of their language's
small groups; where those are fewer too, that of all such languages together; where even
these are fewer, only the base rules judge.

Estimates are found by actions that run while the result is built.

Defined results: a null or empty text has no words and fails the base rules; null
language or source makes a group of its own; very long texts are measured whole; equal
documents and repeated rows are judged alike; an empty table gives no rows; ``kept`` returns
all columns as they were, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import let, name, sheltered, spool

#: Share of a group that a concentration step keeps, and the factor that makes its
#: scatter consistent under normality in five dimensions: H / P(chi2_7 <= q), q the H-quantile of chi2_5.
H, CONSISTENCY = 0.75, 1.41
#: Hashed subsets to start from, about how many documents each has, and the bound of steps from the best start.
SUBSETS, SUBSET_SIZE, STEPS = 4, 30, 100
#: A step that lowers a log determinant by less is the last.
SETTLED = 1e-4
#: The quantile of chi2_5 that one in a million normal documents exceeds.
CUTOFF = 35.89
MIN_GROUP = 60
#: Groups up to which their estimates, some 200 bytes each, are sent to every task; and salts beyond.
SENT_GROUPS, SALTS = 50_000, 256
WORDS, REPEAT_SHARE, SPAN = 20, 30, 8
#: Standard deviation that each statistic has at least: what is constant in a group cannot reject by a trifle.
FLOORS = {"x_words": 0.5, "x_length": 0.15, "x_symbols": 0.1, "x_lines": 0.15, "x_repeats": 0.15}
_X = list(FLOORS)
_SCALE = 1000
_SPACE = r"[\x20\x09-\x0D]+"


def repeated_words(words: Column) -> Column:
    """Words that lie in windows of SPAN words found twice or more in the text."""

    def covered(places: Column) -> Column:
        return F.aggregate(F.transform(places, lambda x, k: F.least(F.lit(SPAN), F.coalesce(F.get(places, k + 1) - x, F.lit(SPAN)))), F.lit(0), lambda a, b: a + b)

    def equal_ones(windows: Column) -> Column:
        def neighbours(ordered: Column) -> Column:
            same = lambda k, x: F.coalesce(F.get(ordered, k)["h"] == x["h"], F.lit(False))
            again = F.filter(ordered, lambda x, k: same(k - 1, x) | same(k + 1, x))
            return let(F.sort_array(F.transform(again, lambda x: x["i"])), covered)

        return let(F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), neighbours)

    def over(hashes: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(hashes) - SPAN)
        windows = F.transform(starts, lambda i: F.xxhash64(*(F.get(hashes, i + k) for k in range(SPAN))))
        return let(windows, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(equal_ones(w)))

    counted = let(F.transform(words, lambda w: F.xxhash64(w)), over)
    return F.when(F.size(words) < SPAN, F.lit(0)).otherwise(counted)


def statistics(text: Column) -> Column:
    """A struct of the base counts of a text."""
    text = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(text, _SPACE), "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    of_words = let(words, lambda w: F.struct(F.size(w).alias("n"), F.length(F.array_join(w, "")).alias("chars"), repeated_words(w).alias("repeats")))
    of_lines = let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup")))
    symbols = F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]", ""))
    return F.struct(of_words.alias("words"), of_lines.alias("lines"), symbols.alias("symbols"))


def measured(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep``, the base counts, base_failed, and the transformed statistics in whole thousandths."""
    found = docs.select(*map(name, keep), statistics(name(text)).alias("gl_stats"))
    part = lambda f: F.col(f"gl_stats.{f}").cast("long")
    counts = {"n_words": part("words.n"), "word_chars": part("words.chars"), "n_symbols": part("symbols"), "n_dup_lines": part("lines.dup"), "n_repeat_words": part("words.repeats"), "n_lines": part("lines.n")}
    out = found.select(*map(name, keep), *(c.alias(f"gl_{k}") for k, c in counts.items()))
    n, chars, symbols, dup, repeats, lines = (F.col(f"gl_{k}") for k in counts)
    share = lambda a, b: F.sqrt(F.coalesce(F.try_divide(a, b), F.lit(0.0)))
    x = {"x_words": F.log1p(n.cast("double")), "x_length": F.log1p(F.coalesce(F.try_divide(chars, n), F.lit(0.0))), "x_symbols": share(symbols, chars), "x_lines": share(dup, lines), "x_repeats": share(repeats, n)}
    failed = (n < WORDS) | (100 * repeats > REPEAT_SHARE * n)
    return out.select("*", failed.alias("gl_failed"), *(F.round(x[k] * _SCALE).cast("long").alias(f"gl_{k}") for k in _X))


def _key(lang: Column, source: Column) -> Column:
    """Language and source as one text; nulls differ from every value."""
    return F.to_json(F.struct(lang.cast("string").alias("lang"), source.cast("string").alias("source")))


def attach(rows: DataFrame, table: DataFrame, key: str | list[str], n: int, how: str = "inner") -> DataFrame:
    """Rows with the columns that ``table``, of ``n`` keys or groups of a few rows each, has for their key.

    Up to ``SENT_GROUPS`` rows the table goes to every task.  Beyond, rows are salted and the table repeated for each
    salt, so the rows of a frequent key spread over ``SALTS`` tasks.
    """
    if n <= SENT_GROUPS:
        return rows.join(F.broadcast(table), key, how)
    salt = F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int")
    spread = table.withColumn("gl_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    keys = [key] if isinstance(key, str) else key
    return rows.withColumn("gl_salt", salt).join(spread, [*keys, "gl_salt"], how).drop("gl_salt")


def _distance(df: DataFrame) -> DataFrame:
    """Adds gl_d2, the squared Mahalanobis distance, by forward substitution in the group's Cholesky factor."""
    d = len(_X)
    for i, k in enumerate(_X):
        rest = F.col(f"gl_{k}") / _SCALE - F.col(f"c{i}")
        for j in range(i):
            rest = rest - F.col(f"l{i}{j}") * F.col(f"gl_z{j}")
        df = df.withColumn(f"gl_z{i}", rest / F.col(f"l{i}{i}"))
    total = F.lit(0.0)
    for i in range(d):
        total = total + F.col(f"gl_z{i}") * F.col(f"gl_z{i}")
    return df.withColumn("gl_d2", total).drop(*(f"gl_z{i}" for i in range(d)))


def _factored(df: DataFrame, cov: dict[tuple[int, int], Column]) -> DataFrame:
    """Adds the lower Cholesky factor of a scatter matrix given by its lower entries."""
    d = len(_X)
    df = df.select("*", *(c.alias(f"s{i}{j}") for (i, j), c in cov.items()))
    for j in range(d):
        pivot = F.col(f"s{j}{j}")
        for k in range(j):
            pivot = pivot - F.col(f"l{j}{k}") * F.col(f"l{j}{k}")
        df = df.withColumn(f"l{j}{j}", F.sqrt(F.greatest(pivot, F.lit(FLOORS[_X[j]] ** 2))))
        for i in range(j + 1, d):
            entry = F.col(f"s{i}{j}")
            for k in range(j):
                entry = entry - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            df = df.withColumn(f"l{i}{j}", entry / F.col(f"l{j}{j}"))
    return df.drop(*(f"s{i}{j}" for i, j in cov))


_D = range(len(_X))
_START = ["gl_group", "gl_start"]
_PARAMS = [*(f"c{i}" for i in _D), *(f"l{i}{j}" for i in _D for j in range(i + 1))]


def _fitted(rows: DataFrame, consistency: float) -> DataFrame:
    """Centre and Cholesky factor of the rows of every group and start, and gl_det, the scatter's log determinant."""
    sums = {f"t{i}": F.sum(f"gl_{k}") for i, k in enumerate(_X)}
    sums |= {f"p{i}{j}": F.sum(F.col(f"gl_{_X[i]}") * F.col(f"gl_{_X[j]}")) for i in _D for j in range(i + 1)}
    agg = rows.groupBy(*_START).agg(F.count("*").cast("double").alias("n"), *(c.cast("double").alias(k) for k, c in sums.items()))
    mean = lambda i: F.col(f"t{i}") / F.col("n")
    cov = {(i, j): (F.col(f"p{i}{j}") / F.col("n") - mean(i) * mean(j)) * (consistency / _SCALE**2) for i in _D for j in range(i + 1)}
    out = _factored(agg.select("*", *((mean(i) / _SCALE).alias(f"c{i}") for i in _D)), cov)
    return out.select(*_START, *_PARAMS, _log_det().alias("gl_det"))


def _log_det() -> Column:
    return 2 * sum((F.log(F.col(f"l{i}{i}")) for i in _D), F.lit(0.0))


def _starts(rows: DataFrame, n: int) -> DataFrame:
    """The first estimates of every group: start 0 from medians and quartile ranges, the others from hashed subsets."""
    quartiles = F.array(*map(F.lit, (0.25, 0.5, 0.75)))
    at = rows.groupBy("gl_group").agg(F.count("*").alias("gl_n"), *(F.percentile(f"gl_{k}", quartiles).alias(f"q{i}") for i, k in enumerate(_X)))
    at = spool(at)
    spread = lambda i: F.greatest((F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / (1.349 * _SCALE), F.lit(FLOORS[_X[i]]))
    first = at.select("gl_group", F.lit(0).alias("gl_start"), *((F.col(f"q{i}")[1] / _SCALE).alias(f"c{i}") for i in _D), *((spread(i) if i == j else F.lit(0.0)).alias(f"l{i}{j}") for i in _D for j in range(i + 1)))
    first = first.select(*_START, *_PARAMS, _log_det().alias("gl_det"))
    values = [F.col(f"gl_{k}") for k in _X]
    drawn = F.filter(F.sequence(F.lit(1), F.lit(SUBSETS)), lambda k: F.pmod(F.xxhash64(k, *values), F.col("gl_n")) < SUBSET_SIZE)
    chosen = attach(rows, at.select("gl_group", "gl_n"), "gl_group", n).select("gl_group", *values, F.explode(drawn).alias("gl_start"))
    return first.unionByName(_fitted(chosen, 1.0))


def _concentrated(rows: DataFrame, params: DataFrame, n: int) -> DataFrame:
    """One concentration step from every estimate."""
    # a few thousand steps of the distance, so that a quantile counts few distinct values
    near = _distance(attach(rows, params, "gl_group", n)).withColumn("gl_step", F.round(F.log1p("gl_d2") * 200).cast("int"))
    near = near.select(*_START, "gl_step", *(f"gl_{k}" for k in _X))
    cut = near.groupBy(*_START).agg(F.percentile("gl_step", F.lit(H)).alias("gl_cut"))
    return _fitted(attach(near, cut, _START, n).where("gl_step <= gl_cut"), CONSISTENCY)


def estimates(rows: DataFrame, n: int) -> DataFrame:
    """Centre c0.. and Cholesky factor l00.. of the scatter for every gl_group. rows: gl_group, of which there are n, and the statistics."""
    params = spool(_starts(rows, n))
    for _ in range(2):
        params = spool(_concentrated(rows, params, n))
    least = params.groupBy("gl_group").agg(F.min_by(F.struct("gl_start", *_PARAMS, "gl_det"), F.struct("gl_det", "gl_start")).alias("best"))
    best = spool(least.select("gl_group", "best.*"))
    for _ in range(STEPS):
        # a group whose determinant a step does not lower has settled; the others go on
        after = _concentrated(rows, best.drop("gl_det"), n).withColumnRenamed("gl_det", "gl_after").select(F.struct(*_PARAMS).alias("new"), "gl_group", "gl_after")
        lower = F.coalesce(F.col("gl_after") < F.col("gl_det") - SETTLED, F.lit(False))
        both = best.join(after, "gl_group", "left")
        best = spool(both.select(*_START, *(F.when(lower, F.col(f"new.{k}")).otherwise(F.col(k)).alias(k) for k in _PARAMS), F.when(lower, F.col("gl_after")).otherwise(F.col("gl_det")).alias("gl_det"), lower.alias("gl_moved")))
        if best.where("gl_moved").isEmpty():
            break
        best = best.drop("gl_moved")
    return best.select("gl_group", *_PARAMS)


def judged(docs: DataFrame, keep: list[str], text: str = "text", lang: str = "lang", source: str = "source", cutoff: float = CUTOFF) -> DataFrame:
    """The columns ``keep``, the base counts as gl_..., gl_failed, gl_d2 (null where no estimate judges) and gl_kept."""
    mine = docs.select(*map(name, dict.fromkeys([*keep, lang, source, text])))
    both = mine.withColumn("gl_lang", name(lang)).withColumn("gl_key", _key(name(lang), name(source)))
    found = spool(measured(both, [*keep, "gl_lang", "gl_key"], text))
    whole = found.where("not gl_failed").select("gl_key", "gl_lang", *(f"gl_{k}" for k in _X))
    sizes = whole.groupBy("gl_lang", "gl_key").count()
    small = F.to_json(F.struct(F.col("gl_lang").cast("string").alias("small")))
    grouped = sizes.select("gl_key", "count", F.when(F.col("count") < MIN_GROUP, small).otherwise(F.col("gl_key")).alias("gl_group"))
    total = lambda of: of.groupBy("gl_group").agg(F.sum("count").alias("gl_total"))
    rest = F.to_json(F.struct(F.lit(True).alias("rest")))
    grouped = grouped.join(total(grouped), "gl_group").withColumn("gl_group", F.when(F.col("gl_total") < MIN_GROUP, rest).otherwise(F.col("gl_group"))).drop("gl_total")
    groups = spool(grouped.join(total(grouped).where(F.col("gl_total") >= MIN_GROUP), "gl_group").select("gl_key", "gl_group"))
    n = groups.count()
    params = estimates(attach(whole.drop("gl_lang"), groups, "gl_key", n).drop("gl_key"), n)
    known = groups.join(params, "gl_group").drop("gl_group")
    out = _distance(attach(found, known, "gl_key", n, "left"))
    kept = ~F.col("gl_failed") & F.coalesce(F.col("gl_d2") <= cutoff, F.lit(True))
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return out.select(*map(name, keep), *(f"gl_{k}" for k in counts), "gl_failed", "gl_d2", kept.alias("gl_kept"))


def report(docs: DataFrame, **options) -> DataFrame:
    """One row a document: the base counts, base_failed, kept, and the squared distance where one was judged."""
    out = judged(docs, ["doc_id"], **options)
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return out.select("doc_id", *(F.col(f"gl_{k}").alias(k) for k in counts), F.col("gl_failed").alias("base_failed"), F.col("gl_kept").alias("kept"), F.round("gl_d2", 3).alias("distance"))


@sheltered
def kept(docs: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """The documents that the rules keep, their columns as they were.

    Statistics are made in one pass over the texts; a second reads them to take the rows that stay.  Where ids are
    null or repeat, the rows are numbered and written down first.
    """
    n, distinct = docs.select(name(key).alias("k")).agg(F.count("*"), F.count_distinct("k")).first()
    row = key
    if n != distinct:
        docs, row = spool(docs.withColumn("gl_row", F.monotonically_increasing_id())), "gl_row"
    gone = judged(docs, [row], **options).where("not gl_kept").select(name(row).alias("gl_gone"))
    out = docs.join(spool(gone), name(row) == F.col("gl_gone"), "left_anti")
    return out.drop("gl_row") if n != distinct else out
