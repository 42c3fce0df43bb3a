"""Host-level quality rules.

Rules are judged per document; failures are summed by host (``source``), each host's failure rate is shrunk by a beta
prior fitted to all hosts by moments, and the verdict on the host goes back to its documents: on a host whose shrunk
rate is over ``bad_rate`` the strict rules hold too (symbols, repeated lines), elsewhere only the base rules do. So a
clean document of a bad host stays, and a host with few documents is judged mostly by the prior. DataFrame functions
only, and no document is moved: everything per document is computed from its own text in the scan. Verdicts on hosts
with many documents are broadcast, the others joined by shuffling the narrow measures.

Cases: a null text has no words and fails; null and empty hosts are one host; without spread between hosts the prior is as
strong as ``prior_limit`` documents; repeated rows each count; an empty table gives an empty result; of the input only
``doc_id``, ``text`` and ``source`` are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_keyed, written

BLANKS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"


def replaced(text: Column, letters: str, by: str) -> Column:
    """text with each of the letters replaced: searches for one letter at a time are several times faster than translate."""
    for letter in letters:
        text = F.replace(text, F.lit(letter), F.lit(by))
    return text


def repeated_window_words(words: Column, width: int = 3) -> Column:
    """Words in windows of ``width`` words that occur twice or more, the first occurrence included.

    Windows are compared by 64-bit hashes. Most texts have no equal ones, which a hash set tells; only others sort
    (hash, place) pairs, take the places whose neighbour is equal, and count the words under them once."""
    n = F.size(words)
    hashes = F.transform(F.sequence(F.lit(0), n - width), lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(width)]))

    def covered(h: Column) -> Column:
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def places(p: Column) -> Column:
            same = F.filter(p, lambda x, j: (x["h"] == F.get(p, j - 1)["h"]) | (x["h"] == F.get(p, j + 1)["h"]))
            return F.size(F.array_distinct(F.flatten(F.transform(same, lambda x: F.array(*[x["i"] + j for j in range(width)])))))

        return bound(pairs, places)

    def count(h: Column) -> Column:
        return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(covered(h))

    return F.when(n <= width, 0).otherwise(bound(hashes, count)).cast("long")


def bound(value: Column, body) -> Column:
    """body(value) with the value computed once: an expression that is named inside a row."""
    return F.get(F.transform(F.array(value), body), 0)


def measures(docs: DataFrame) -> DataFrame:
    """doc_id, host and the rule inputs of every document."""
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("host"), F.coalesce("text", F.lit("")).alias("text"))
    split = text.withColumn("words", F.filter(F.split(replaced(F.col("text"), BLANKS[1:], " "), " "), lambda w: w != ""))
    lines = F.filter(F.split("text", "\n"), lambda x: F.octet_length(F.btrim(x, F.lit(BLANKS))) > 0)
    return split.select(
        "doc_id",
        "host",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(replaced(F.col("text"), SYMBOLS, ""))).cast("long").alias("n_symbols"),
        bound(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeated_window_words(F.col("words")).alias("n_repeat_words"),
    )


def host_verdicts(judged: DataFrame, bad_rate: float, prior_limit: float) -> DataFrame:
    """host, n (its documents), host_rate (shrunk failure rate), host_bad."""
    hosts = judged.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("failed").cast("long")).alias("k"))
    rate = F.col("k") / F.col("n")
    moments = hosts.agg((F.sum("k") / F.sum("n")).alias("mean"), F.avg(rate * rate).alias("square"), F.avg(rate).alias("plain"), F.avg(1 / F.col("n")).alias("inverse"))
    # spread of rates beyond what counting alone makes: mean * (1 - mean) / (strength + 1)
    noise = F.col("mean") * (1 - F.col("mean"))
    spread = F.col("square") - F.col("plain") * F.col("plain") - noise * F.col("inverse")
    strength = F.when((spread > 0) & (noise > 0), F.least(F.lit(prior_limit), F.greatest(F.lit(1.0), noise / spread - 1))).otherwise(F.lit(prior_limit))
    prior = moments.select("mean", strength.alias("strength"))
    shrunk = (F.col("k") + F.col("mean") * F.col("strength")) / (F.col("n") + F.col("strength"))
    return hosts.join(F.broadcast(prior)).select("host", "n", shrunk.alias("host_rate"), (shrunk > bad_rate).alias("host_bad"))


def judge(spark: SparkSession, docs: DataFrame, bad_rate: float = 0.3, symbol_share: float = 0.1, line_share: float = 0.3, prior_limit: float = 1000.0) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, host_rate, host_bad."""
    rules = measures(docs)
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    strict = base | (F.col("n_symbols") > symbol_share * F.col("word_chars")) | (F.col("n_dup_lines") > line_share * F.col("n_words") / 10)
    rules = rules.withColumn("base_failed", base).withColumn("failed", strict)
    # the measures are narrow; both the hosts and the documents read them from one table
    rules = written(rules)
    out = join_keyed(rules, written(host_verdicts(rules, bad_rate, prior_limit)), "host", "n")
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~(F.col("host_bad") & F.col("failed"))).alias("kept"), F.round("host_rate", 9).alias("host_rate"), "host_bad")
