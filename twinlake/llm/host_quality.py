"""Quality rules of documents and verdicts on their hosts, with DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from twinlake.session import free_names, written

SPACES, SYMBOLS, GRAM = " \t\n\x0b\x0c\r", "#*$%&|<>", 5


def rule_counts(documents: DataFrame, text: str = "text") -> DataFrame:
    """documents, without the text, with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words.

    Everything is worked out inside the row: no row is made for a word. Windows
    of five words are hashed; where all differ, which is the rule, nothing is
    sorted.
    """
    new = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    keep = [c for c in documents.columns if c not in (text, *new)]
    body, held, words, lined, hashes, grams, some, sorted_, places = free_names(
        [*documents.columns, *new], "body", "held", "words", "lined", "hashes", "grams", "some", "sorted", "places"
    )
    t = documents.select(*keep, F.coalesce(F.col(text), F.lit("")).alias(body))
    one_space = F.translate(body, SPACES, " " * len(SPACES))
    lines = F.filter(F.split(body, "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    w = t.select(
        *keep,
        F.array_remove(F.split(one_space, " "), "").alias(words),
        F.length(F.translate(body, SPACES, "")).cast("long").alias("word_chars"),
        (F.length(body) - F.length(F.translate(body, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        lines.alias(lined),
    )
    have = [*keep, "word_chars", "n_symbols"]
    w = w.select(
        *have,
        F.size(words).alias(held),
        (F.size(lined) - F.size(F.array_distinct(lined))).cast("long").alias("n_dup_lines"),
        F.transform(words, lambda x: F.xxhash64(x)).alias(hashes),
    )
    have = [*have, "n_dup_lines", F.col(held).cast("long").alias("n_words")]
    full = F.greatest(F.col(held) - (GRAM - 1), F.lit(0))
    windows = F.arrays_zip(*(F.slice(hashes, k + 1, full).alias(f"h{k}") for k in range(GRAM)))
    g = w.select(*have, F.transform(windows, lambda x: F.xxhash64(*(x[f"h{k}"] for k in range(GRAM)))).alias(grams))
    have = [*keep, "n_words", "word_chars", "n_symbols", "n_dup_lines"]
    g = g.select(*have, grams, (F.size(F.array_distinct(grams)) < F.size(grams)).alias(some))
    pairs = F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    s = g.select(*have, F.when(F.col(some), F.sort_array(pairs)).alias(sorted_))
    twins = F.zip_with(
        F.slice(sorted_, 1, F.size(sorted_) - 1),
        F.slice(sorted_, 2, F.size(sorted_) - 1),
        lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>")),
    )
    p = s.select(*have, F.when(F.col(sorted_).isNotNull(), F.sort_array(F.array_distinct(F.flatten(twins)))).alias(places))
    covered = F.aggregate(
        places,
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda a, x: F.struct((a["n"] + x + GRAM - F.greatest(x, a["end"])).alias("n"), (x + GRAM).alias("end")),
    )
    return p.select(*have, F.coalesce(covered["n"], F.lit(0)).cast("long").alias("n_repeat_words"))


#: What a document fails by, beside the base rules: signs for so many words, and repeated lines.
SYMBOL_PERCENT, DUPLICATE_LINES = 10, 3


def rules(least_words: int = 10, repeat_percent: int = 20) -> dict[str, F.Column]:
    """Whether a document fails each rule, from its counts."""
    words = F.col("n_words")
    return {
        "short": words < least_words,
        "repeats": 100 * F.col("n_repeat_words") > repeat_percent * words,
        "symbols": 100 * F.col("n_symbols") > SYMBOL_PERCENT * words,
        "lines": F.col("n_dup_lines") >= DUPLICATE_LINES,
    }


def beta_priors(hosts: DataFrame, names: Sequence[str]) -> dict[str, tuple[float, float]]:
    """(mean, strength) of the beta distribution that hosts' true rates of each rule come from.

    hosts: (n, and failures by the names). By moments with weights n (Kleinman,
    1973): of the spread of the observed rates around their mean, what a binomial
    of n trials has by itself is taken out first. What is left, as a share of
    m * (1 - m), is 1 / (strength + 1): hosts of a page or two, whose rates are 0
    or 1 by chance, make no weak prior. Strength is between 0.01 and a million.
    """
    n, known = F.col("n"), [F.count(F.lit(1)).alias("hosts"), F.sum("n").alias("all"), F.sum(F.col("n").cast("double") * F.col("n")).alias("squares")]
    for r in names:
        known += [F.sum(r).alias(f"{r}_k"), F.sum(F.col(r).cast("double") * F.col(r) / n).alias(f"{r}_q")]
    got = hosts.agg(*known).first()  # a few numbers
    out = {}
    for r in names:
        if not got["all"]:
            out[r] = 0.0, 1e6
            continue
        every = float(got["all"])
        m = got[f"{r}_k"] / every
        spread = got[f"{r}_q"] / every - m * m
        chance = (got["hosts"] - 1) / every
        room = m * (1 - m) * (1 - got["squares"] / every**2 - chance)
        share = (spread - m * (1 - m) * chance) / room if room > 0 else 0.0
        out[r] = m, min(max(1 / share - 1, 0.01), 1e6) if share > 1e-6 else 1e6
    return out


def host_quality(
    documents: DataFrame,
    host: str = "source",
    text: str = "text",
    least_words: int = 10,
    repeat_percent: int = 20,
    host_limit: float = 0.5,
) -> DataFrame:
    """documents, without the text, with the counts, base_failed, host_rate and kept.

    base_failed: fewer than least_words words, or more than repeat_percent of
    them in five-word windows that occur twice or more. Failures of each of
    rules(), these two and signs and repeated lines, are counted by host. For
    each rule a beta prior is fitted to all hosts (beta_priors) and shrinks the
    hosts' rates, so that hosts with few documents lean on the rest. host_rate is
    the highest of a host's shrunk rates; a document is kept if it did not fail
    the base rules and host_rate is at most host_limit.

    Null and empty texts have no words and fail. Documents without a host are a
    host of their own. Texts of any length count whole; equal rows count each.
    Other columns pass through; those named as new ones are replaced. An empty
    table gives an empty table.
    """
    new = ("base_failed", "host_rate", "kept")
    rows = rule_counts(documents.drop(*new), text)
    tests = rules(least_words, repeat_percent)
    rows = written(rows.withColumn("base_failed", tests["short"] | tests["repeats"]), "quality-counts")
    keyed = F.coalesce(F.concat(F.lit("h"), F.col(host).cast("string")), F.lit("n"))
    (key,) = free_names([*rows.columns, "host_rate"], "key")
    counts = [F.count_if(test).alias(name) for name, test in tests.items()]
    hosts = written(rows.groupBy(keyed.alias(key)).agg(F.count(F.lit(1)).alias("n"), *counts), "quality-hosts")
    priors = beta_priors(hosts, list(tests))
    shrunk = [(F.col(r) + F.lit(m * strength)) / (F.col("n") + F.lit(strength)) for r, (m, strength) in priors.items()]
    verdicts = written(hosts.select(key, F.greatest(*shrunk).alias("host_rate")), "quality-verdicts")  # a plain table: a hot host's join can be split
    out = rows.withColumn(key, keyed).join(verdicts, key).drop(key)
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("host_rate") <= host_limit))


def op6_host_quality(spark, sf_dir: str) -> DataFrame:
    """Rule counts and verdicts of all documents."""
    out = host_quality(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text"))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return out.select("doc_id", *counts, "base_failed", "kept")


OP6_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
g AS (
  SELECT rid, unnest(range(1, len(w) - 3)) AS i, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS gram
  FROM d WHERE len(w) >= 5),
r AS (
  SELECT rid, count(DISTINCT i + k) AS n FROM (
    SELECT rid, i, unnest(range(5)) AS k FROM (SELECT *, count(*) OVER (PARTITION BY rid, gram) AS c FROM g) WHERE c > 1)
  GROUP BY rid),
f AS (
  SELECT doc_id, source, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN r USING (rid)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f),
h AS (
  SELECT source, count(*) AS n, unnest(['short', 'repeats', 'symbols', 'lines']) AS rule,
         unnest([count(*) FILTER (n_words < 10), count(*) FILTER (100 * n_repeat_words > 20 * n_words),
                 count(*) FILTER (100 * n_symbols > 10 * n_words), count(*) FILTER (n_dup_lines >= 3)]) AS k
  FROM b GROUP BY source),
m AS (
  SELECT rule, sum(k) / sum(n) AS m, sum(k::DOUBLE * k / n) / sum(n) - (sum(k) / sum(n)) ^ 2 AS spread,
         (count(*) - 1) / sum(n) AS chance, 1 - sum(n::DOUBLE * n) / sum(n)::DOUBLE ^ 2 - (count(*) - 1) / sum(n) AS room
  FROM h GROUP BY rule),
e AS (SELECT rule, m, CASE WHEN m * (1 - m) * room > 0 THEN (spread - m * (1 - m) * chance) / (m * (1 - m) * room) ELSE 0 END AS share FROM m),
p AS (SELECT rule, m, CASE WHEN share > 1e-6 THEN least(greatest(1 / share - 1, 0.01), 1e6) ELSE 1e6 END AS s FROM e),
x AS (SELECT source, max((k + m * s) / (n + s)) AS rate FROM h JOIN p USING (rule) GROUP BY source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND rate <= 0.5 AS kept
FROM b JOIN x ON b.source IS NOT DISTINCT FROM x.source
"""
