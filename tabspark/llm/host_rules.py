"""Quality rules judged by host.

Each document is measured by fixed rules. Failures are added up by host, and each rule's rate
on a host is drawn towards the rate of all hosts: the rates of the hosts are taken as draws
from a beta distribution whose two parameters are found from their mean and variance, and a
host's rate is the mean of its posterior. A host is refused when a rule's shrunken rate
reaches the limit, and then all its documents are.

Defined cases: a null text has no words and fails; a null host is no host, its documents are
judged alone; repeated rows count as often as they occur; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tabspark.llm.common import WORD, joined, stored, words

WINDOW = 5
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 10
REPEATED_PERCENT = 20
#: Rules that count for hosts only: shares that a well-kept host's documents rarely reach.
SYMBOL_PERCENT = 10
LINE_PERCENT = 30
WORD_CHARS = (2, 12)
HOST_LIMIT = 0.5
RULES = ("base", "symbols", "lines", "letters")


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """The table with the measures of each text."""
    body = F.coalesce(F.col(text), F.lit(""))
    plain = body
    for symbol in SYMBOLS:
        plain = F.replace(plain, F.lit(symbol), F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(WORD))
    df = docs.withColumns({"__words": words(F.col(text)), "__lines": lines})
    df = df.withColumns({
        "n_words": F.size("__words").cast("bigint"),
        "word_chars": F.char_length(F.array_join("__words", "")).cast("bigint"),
        "n_symbols": (F.octet_length(body) - F.octet_length(plain)).cast("bigint"),
        "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("bigint"),
        "n_lines": F.size("__lines").cast("bigint"),
        "__windows": F.when(F.size("__words") > WINDOW, F.transform(
            F.sequence(F.lit(0), F.size("__words") - WINDOW),
            lambda i: F.xxhash64(*[F.get(F.col("__words"), i + k) for k in range(WINDOW)])))})
    # only texts with a repeated window are looked at again: equal hashes are neighbours once sorted
    df = df.withColumn("__sorted", F.when(
        F.size(F.array_distinct("__windows")) < F.size("__windows"),
        F.array_sort(F.transform("__windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    df = df.withColumn("__starts", F.array_sort(F.transform(
        F.filter(F.transform("__sorted", lambda x, k: F.struct(
            x["i"].alias("i"),
            (F.coalesce(F.get(F.col("__sorted"), k - 1)["h"] == x["h"], F.lit(False))
             | F.coalesce(F.get(F.col("__sorted"), k + 1)["h"] == x["h"], F.lit(False))).alias("twice"))),
            lambda x: x["twice"]), lambda x: x["i"])))
    covered = F.aggregate(
        F.transform("__starts", lambda i, k: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col("__starts"), k + 1) - i, F.lit(WINDOW)))),
        F.lit(0), lambda a, x: a + x)
    return df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("bigint")).drop(
        "__words", "__lines", "__windows", "__sorted", "__starts")


def failures() -> dict[str, Column]:
    """Whether each rule fails, over the columns of ``measured``."""
    n = F.col("n_words")
    return {
        "base": (n < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEATED_PERCENT * n),
        "symbols": 100 * F.col("n_symbols") > SYMBOL_PERCENT * F.col("word_chars"),
        "lines": 100 * F.col("n_dup_lines") > LINE_PERCENT * F.col("n_lines"),
        "letters": (F.col("word_chars") < WORD_CHARS[0] * n) | (F.col("word_chars") > WORD_CHARS[1] * n),
    }


def host_verdicts(rows: DataFrame, host: str, limit: float = HOST_LIMIT) -> DataFrame:
    """A row for each host: its documents, the shrunken rate of each rule, and ``host_ok``.

    ``rows`` has a boolean column ``fail_<rule>`` for each rule. The prior comes from one
    row of sums over hosts, so nothing passes through the driver.
    """
    hosts = rows.where(F.col(host).isNotNull()).groupBy(host).agg(
        F.count(F.lit(1)).alias("host_docs"), *[F.sum(F.col(f"fail_{r}").cast("bigint")).alias(f"n_{r}") for r in RULES])
    hosts = stored(hosts, "hosts")
    rate = {r: F.col(f"n_{r}") / F.col("host_docs") for r in RULES}
    prior = hosts.agg(*[F.avg(rate[r]).alias(f"m_{r}") for r in RULES], *[F.var_pop(rate[r]).alias(f"v_{r}") for r in RULES],
                      F.avg(1 / F.col("host_docs")).alias("noise"))
    # variance of the rates less what the finite number of documents explains
    strength = {}
    for r in RULES:
        m, v = F.col(f"m_{r}"), F.col(f"v_{r}")
        true = F.greatest((v - m * (1 - m) * F.col("noise")) / F.greatest(1 - F.col("noise"), F.lit(1e-9)), F.lit(1e-6))
        strength[r] = F.greatest(F.least(m * (1 - m) / true - 1, F.lit(1e4)), F.lit(1.0))
    prior = prior.select(F.struct(*[F.col(f"m_{r}").alias(f"m_{r}") for r in RULES], *[strength[r].alias(f"s_{r}") for r in RULES]).alias("p"))
    known = hosts.withColumn("__p", prior.scalar())
    shrunk = {f"rate_{r}": (F.col(f"n_{r}") + F.col(f"__p.m_{r}") * F.col(f"__p.s_{r}")) / (F.col("host_docs") + F.col(f"__p.s_{r}"))
              for r in RULES}
    known = known.withColumns(shrunk).drop("__p", *[f"n_{r}" for r in RULES])
    return known.withColumn("host_ok", F.greatest(*shrunk) < limit)


def host_rules(docs: DataFrame, host: str = "source", text: str = "text", keep: tuple[str, ...] = ("doc_id",),
               limit: float = HOST_LIMIT) -> DataFrame:
    """Columns ``keep`` of each row with its measures, ``base_failed``, ``host_ok`` and ``kept``.

    The measured rows are written once, without the text unless it is in ``keep``, and the host
    verdicts are joined back to them: by broadcast if counted few, else over salted hosts.
    """
    rows = measured(docs.select(F.struct(*keep).alias("row"), F.col(host).alias("host"), F.col(text).alias("text")), "text")
    rows = stored(rows.withColumns({f"fail_{r}": f for r, f in failures().items()}).drop("text"), "measured")
    verdicts = stored(host_verdicts(rows, "host", limit), "verdicts")
    rows = joined(rows, verdicts, ["host"]).withColumn("host_ok", F.coalesce("host_ok", F.lit(True)))
    return rows.withColumnRenamed("fail_base", "base_failed").withColumn("kept", ~F.col("base_failed") & F.col("host_ok"))


def kept_documents(docs: DataFrame) -> DataFrame:
    """The documents that pass, with their own columns."""
    return host_rules(docs, keep=tuple(docs.columns)).where("kept").select("row.*")
