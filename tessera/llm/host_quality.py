"""Quality rules by document and by host, in DataFrame operations throughout."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialize, words_column

WINDOW = 5
#: Base rules: fewest words, and the largest share (in percent) of words in repeated windows.
LEAST_WORDS, MOST_REPEATED_PERCENT = 10, 20
SYMBOLS = "#*$%&|<>"
#: A host is rejected if its shrunk failure rate is above this.
MOST_HOST_FAILURES = 0.5
#: Bounds of the prior's weight, in documents.
PRIOR_WEIGHT = (1.0, 1_000_000.0)

RULES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def with_rules(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds the five counts of each whole text (long) and ``base_failed``; null text counts as empty.

    Everything is computed within the row: repeated five-word windows are found by sorting the hashes
    (64 bits) of a text's windows, and only where some hash repeats. Input columns named like the output
    are replaced.
    """
    outputs = (*RULES, "base_failed")
    rest = [c for c in docs.columns if c not in outputs]
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = docs.select(*rest, text.alias("_t"), words_column(F.col(text_col)).alias("_w"))
    window = ", ".join(f"_w[i + {k}]" if k else "_w[i]" for k in range(WINDOW))
    some = f"size(_w) >= {WINDOW}"
    df = df.withColumn(
        "_h", F.expr(f"IF({some}, transform(sequence(0, size(_w) - {WINDOW}), i -> xxhash64({window})), CAST(array() AS array<bigint>))")
    )
    lines = r"filter(split(_t, '\n', -1), x -> x rlike '[^ \\t-\\r]')"
    df = df.select(
        *rest,
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.translate("_t", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length("_t") - F.length(F.translate("_t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.expr(lines).alias("_l"),
        F.expr("IF(size(array_distinct(_h)) < size(_h), array_sort(transform(_h, (x, i) -> struct(x AS h, i AS i))), NULL)").alias("_s"),
    )
    # Start positions of windows that occur twice or more, in order.
    twin = "(j > 0 AND _s[j - 1].h = _s[j].h) OR (j < size(_s) - 1 AND _s[j + 1].h = _s[j].h)"
    df = df.withColumn(
        "_p", F.expr(f"IF(_s IS NULL, NULL, array_sort(transform(filter(sequence(0, size(_s) - 1), j -> {twin}), j -> _s[j].i)))")
    )
    covered = f"aggregate(sequence(1, size(_p) - 1), {WINDOW}, (n, k) -> n + least({WINDOW}, _p[k] - _p[k - 1]))"
    df = df.select(
        *rest,
        "n_words",
        "word_chars",
        "n_symbols",
        F.expr("size(_l) - size(array_distinct(_l))").cast("long").alias("n_dup_lines"),
        F.expr(f"IF(_p IS NULL, 0, {covered})").cast("long").alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    return df.withColumn("base_failed", failed)


def host_verdicts(ruled: DataFrame, host_col: str) -> DataFrame:
    """One row per host: host, host_docs, host_failed (long), host_rate double, host_kept boolean.

    The failure rate is shrunk towards all hosts' mean by a beta prior fitted by beta-binomial moments: the
    weighted square deviations of the hosts' rates, less what binomial sampling alone would give them, tell how
    far the hosts' true rates spread. So hosts of few documents that differ by chance get a heavy prior, and a
    host is rejected on evidence of its own only. ``PRIOR_WEIGHT`` bounds the prior's weight; where nothing is
    left above sampling, it is the upper bound. A null host is a host of its own; an empty table gives no rows.
    """
    per = ruled.groupBy(F.col(host_col).alias("host")).agg(
        F.count("*").alias("host_docs"), F.sum(F.col("base_failed").cast("long")).alias("host_failed")
    )
    per = materialize(per, "hosts")
    rate = F.col("host_failed") / F.col("host_docs")
    # One row over all hosts.
    row = per.agg(
        F.count("*").alias("hosts"),
        F.sum("host_docs").alias("n"),
        F.sum("host_failed").alias("k"),
        F.sum(F.col("host_docs") * rate * rate).alias("q"),
        F.sum(F.col("host_docs").cast("double") * F.col("host_docs")).alias("s"),
    ).first()
    mean, weight = prior_moments(row["hosts"] or 0, row["n"] or 0, row["k"] or 0, row["q"] or 0.0, row["s"] or 0.0)
    shrunk = (F.col("host_failed") + F.lit(mean * weight)) / (F.col("host_docs") + F.lit(weight))
    return per.withColumn("host_rate", shrunk).withColumn("host_kept", F.col("host_rate") <= F.lit(MOST_HOST_FAILURES))


def prior_moments(hosts: int, n: int, k: int, q: float, s: float) -> tuple[float, float]:
    """Mean and weight of the beta prior of ``hosts`` hosts with ``n`` documents, ``k`` of them failed.

    ``q`` is the sum of documents * rate^2 and ``s`` that of documents^2 over hosts. With intra-host correlation
    rho = 1 / (weight + 1), the expected sum of documents * (rate - mean)^2 is
    mean (1 - mean) (hosts - 1 + rho (n - s / n - hosts + 1)).
    """
    low, high = PRIOR_WEIGHT
    mean = k / n if n else 0.0
    chance = mean * (1 - mean)
    room = n - s / n - (hosts - 1) if n else 0.0
    if chance <= 0 or room <= 0:
        return mean, high
    rho = ((q - n * mean * mean) / chance - (hosts - 1)) / room
    return mean, min(high, max(low, 1 / rho - 1)) if rho > 1e-12 else high


def judge(docs: DataFrame, host_col: str = "source", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rule counts, ``base_failed``, the host's shrunk ``host_rate`` and ``kept`` for each row.

    Returns id, host (named as in the input), the counts, base_failed, host_rate, host_kept and kept.
    ``kept`` is false if the document fails a base rule or its host is rejected. Repeated rows count
    each; an empty table gives an empty result. Texts are read once: the counts are written to the
    scratch folder, aggregated by host with partial sums, and the verdicts joined back to the counts
    (broadcast only if their written size is under the session's threshold; else a hot host is split
    by adaptive execution).
    """
    ruled = docs.select(F.col(id_col), F.col(host_col).alias("_host"), F.col(text_col).alias("_text"))
    ruled = materialize(with_rules(ruled, "_text").drop("_text"), "rules")
    verdicts = materialize(host_verdicts(ruled, "_host").select("host", "host_rate", "host_kept"), "verdicts")
    joined = ruled.join(verdicts, F.col("_host").eqNullSafe(F.col("host")), "left").drop("host")
    return joined.withColumn("kept", ~F.col("base_failed") & F.col("host_kept")).withColumnRenamed("_host", host_col)
