"""Quality rules as a decision list learned from labelled statistics.

Statistics of whole texts are array and string expressions.  The labelled rows' statistics are
cut at quantiles and counted by cell; the cells, a bounded table, come to the driver, where rules
are grown and pruned one after another (sequential covering).  The list is applied as nested
CASE WHEN.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vestige.llm.common import land, once

BLANKS = r"[\x20\x09-\x0D]+"
REPEAT_WINDOW = 8
QUANTILES = (0.05, 0.25, 0.5, 0.8, 0.9, 0.95, 0.98)
MAX_RULES = 8
MAX_CONDITIONS = 3
#: A rule must reject right in this share of the labelled texts that it was not grown on.
LEAST_PRECISION = 0.9
LEAST_COVERED = 5

#: What rules may test, as expressions over the statistics.
FEATURES = {
    "mean_word": "word_chars / greatest(n_words, 1)",
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "dup_lines": "cast(n_dup_lines as double)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "capital_share": "n_capitals / greatest(word_chars, 1)",
    "exclaim_share": "n_exclaims / greatest(n_words, 1)",
}


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_capitals, n_exclaims (all long).

    Null counts as empty: all zero.  Windows of a text meet in the text's own row, by sorting
    their hashes (64 bits); nothing is shuffled.  Repeated rows are rows like others.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text_"))
    lines = F.filter(F.split("text_", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    rows = once(rows, w_=F.array_remove(F.split("text_", BLANKS), ""), lines_=lines)
    only = lambda c: F.char_length(F.regexp_replace("text_", f"[^{c}]+", "")).cast("long")
    starts = F.sequence(F.lit(1), F.size("w_") - (REPEAT_WINDOW - 1))
    hashes = F.when(F.size("w_") >= REPEAT_WINDOW, F.transform(starts, lambda i: F.xxhash64(F.slice("w_", i, REPEAT_WINDOW)))).otherwise(F.array().cast("array<bigint>"))
    rows = once(rows.select("doc_id", F.size("w_").cast("long").alias("n_words"), F.char_length(F.array_join("w_", "")).cast("long").alias("word_chars"),
                            only("#*$%&|<>").alias("n_symbols"), (F.size("lines_") - F.size(F.array_distinct("lines_"))).cast("long").alias("n_dup_lines"),
                            only("A-Z").alias("n_capitals"), only("!").alias("n_exclaims"), "w_"), h_=hashes).drop("w_")
    placed = F.sort_array(F.transform("h_", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    rows = once(rows, s_=F.when(F.size(F.array_distinct("h_")) < F.size("h_"), placed).otherwise(none)).drop("h_")
    twice = F.filter("s_", lambda x, k: F.coalesce(F.get("s_", k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get("s_", k + 1)["h"] == x["h"], F.lit(False)))
    rows = once(rows, p_=F.sort_array(F.transform(twice, lambda x: x["i"]))).drop("s_")
    inside = F.aggregate("p_", F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
                         lambda s, i: F.struct((s["n"] + i + REPEAT_WINDOW - F.greatest(i, s["end"])).alias("n"), (i + REPEAT_WINDOW).alias("end")))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", inside["n"].cast("long").alias("n_repeat_words"), "n_capitals", "n_exclaims")


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)


Condition = tuple[str, str, float]  # feature, "<=" or ">", threshold


def learn(stats: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality") -> list[list[Condition]]:
    """Ordered rules (conjunctions) that reject; label 0 is what they look for, null is no label.

    All labelled rows that pass the base rules are counted.  The cells that reach the driver are
    at most 8 ** 6 * 4, whatever the table's size.  No labelled row, or none of label 0: no rule.
    """
    given = labels.select(F.col(key).alias("label_key"), F.col(label).cast("int").alias("y")).where("y is not null")
    rows = stats.where(~base_failed()).join(given, stats["doc_id"] == given["label_key"]).select(
        "y", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(3)).alias("third"), *[F.expr(e).alias(n) for n, e in FEATURES.items()])
    rows = land(rows)
    cuts = rows.agg(*[F.percentile_approx(n, list(QUANTILES), 10000).alias(n) for n in FEATURES]).first()
    cuts = {n: sorted(set(cuts[n] or [])) for n in FEATURES}
    level = lambda n: sum([(F.col(n) > c).cast("int") for c in cuts[n]], F.lit(0)).alias(n)
    cells = rows.select("y", (F.col("third") == 0).alias("prune"), *[level(n) for n in FEATURES]).groupBy("y", "prune", *FEATURES).count().collect()
    cells = [({n: c[n] for n in FEATURES}, c["y"] == 0, c["prune"], c["count"]) for c in cells]
    rules = []
    while len(rules) < MAX_RULES:
        rule = pruned(grown(cells, cuts), cells)
        if not rule:
            break
        rules.append([(n, sign, cuts[n][k]) for n, sign, k in rule])
        cells = [c for c in cells if not holds(rule, c[0])]
    return rules


def holds(rule, levels) -> bool:
    return all((levels[n] > k) == (sign == ">") for n, sign, k in rule)


def tally(rule, cells, prune: bool) -> tuple[int, int]:
    """Rejected rightly and wrongly."""
    met = [(bad, n) for levels, bad, part, n in cells if part == prune and holds(rule, levels)]
    return sum(n for bad, n in met if bad), sum(n for bad, n in met if not bad)


def grown(cells, cuts):
    """Adds the condition of the best precision (Laplace) until nothing is wrongly rejected or nothing helps."""
    rule: list = []
    value = lambda p, n: (p + 1) / (p + n + 2)
    own = [c for c in cells if not c[2]]
    best = value(*tally(rule, own, False))
    while len(rule) < MAX_CONDITIONS and tally(rule, own, False)[1]:
        options = []
        for n, thresholds in cuts.items():
            for k in range(len(thresholds)):
                for sign in (">", "<="):
                    p, q = tally([*rule, (n, sign, k)], own, False)
                    if p >= LEAST_COVERED:
                        options.append((value(p, q), p, [*rule, (n, sign, k)]))
        top = max(options, key=lambda o: (o[0], o[1]), default=None)
        if top is None or top[0] <= best:
            break
        best, rule = top[0], top[2]
        own = [c for c in own if holds(rule, c[0])]
    return rule


def pruned(rule, cells):
    """The shortest beginning of the rule that is best on the texts set aside; nothing if that is too imprecise."""
    worth = []
    for n in range(1, len(rule) + 1):
        p, q = tally(rule[:n], cells, True)
        worth.append(((p + 1) / (p + q + 2), -n, p, q))
    if not worth:
        return []
    _, n, p, q = max(worth)
    return rule[:-n] if p and p >= LEAST_PRECISION * (p + q) else []


def verdict(rules: list[list[Condition]]) -> Column:
    """True unless a rule holds, as one ordered conditional expression over the statistics."""
    out = None
    for rule in rules:
        test = None
        for name, sign, threshold in rule:
            feature = F.expr(FEATURES[name])
            one = feature > threshold if sign == ">" else feature <= threshold
            test = one if test is None else test & one
        out = F.when(test, F.lit(False)) if out is None else out.when(test, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Statistics, base_failed and kept of every row of ``docs``; the rules are learned from ``labels``."""
    stats = land(statistics(docs))
    rules = learn(stats, labels)
    failed = base_failed()
    return stats.select("*", failed.alias("base_failed"), (~failed & verdict(rules)).alias("kept"))
