"""Quality rules as a learned decision list, in DataFrame operations only.

Statistics are Spark expressions over the whole text.  Sequential covering learns from labelled statistics: a rule grows
threshold by threshold for information gain on one part of the rows, is pruned on the other, and what it
covers is taken away before the next.  The list becomes one ordered chain of Spark conditions.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: labelled rows that the learner takes at most, those with the least hash of doc_id
MAX_TRAIN = 6_000
#: a rule must be right so often on rows it wasn't grown on, and cover so many rows
PRECISION, COVER = 0.9, 8
MAX_RULES, MAX_TERMS = 12, 4
SYMBOLS = "#*$%&|<>"
#: low bits of a sorted window hash that hold its place in the text: as many as an array's index has
PLACE = 31

FEATURES = ("symbol_rate", "dup_line_rate", "repeat_rate", "word_length", "upper_rate", "bang_rate", "line_words", "stop_rate", "pipe_rate")


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id with counts of every whole text; null text: none of anything.

    n_repeat_words: windows of three words are hashed; sorting the hashes, with the place in the low bits, brings windows of
    equal hash bits together.  All of those are sorted again by the words themselves, so that equal ones stand side by side
    whatever the hashes.  So a text of n words costs n log n, and nothing leaves its row.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("t"))
    blank, solid = F.col("t"), F.col("t")
    for c in "\t\n\x0b\x0c\r":
        blank, solid = F.replace(blank, F.lit(c), F.lit(" ")), F.replace(solid, F.lit(c), F.lit(""))
    d = d.withColumn("w", F.array_remove(F.split(blank, " "), ""))
    # the partition id keeps later filters from being pushed below this point and copied into the lambdas, where they would cost the square of a text
    d = d.withColumn("n", F.size("w") + F.spark_partition_id() * 0)
    d = d.withColumn("p", F.expr(f"if(n < 3, cast(array() as array<bigint>), sort_array(transform(sequence(0, n - 3), i -> shiftleft(shiftright(xxhash64(get(w, i), get(w, i + 1), get(w, i + 2)), {PLACE}), {PLACE}) + i)))"))
    place = lambda e: f"cast({e} & {(1 << PLACE) - 1}L as int)"
    equal = f"if(shiftright(x, {PLACE}) = shiftright(get(p, k + 1), {PLACE}), array({place('x')}, {place('get(p, k + 1)')}), array())"
    d = d.withColumn("c", F.expr(f"sort_array(transform(array_distinct(flatten(transform(p, (x, k) -> {equal}))), i -> struct(get(w, i) as a, get(w, i + 1) as b, get(w, i + 2) as c, i as i)))"))
    same = lambda o: f"(get(c, {o}).a = x.a and get(c, {o}).b = x.b and get(c, {o}).c = x.c)"
    d = d.withColumn("r", F.expr(f"filter(c, (x, j) -> coalesce({same('j + 1')}, false) or coalesce({same('j - 1')}, false))"))
    d = d.withColumn("lines", F.expr(r"filter(split(t, '\n', -1), x -> x rlike '[^\\x20\\x09-\\x0D]')"))
    count = lambda char: F.length("t") - F.length(F.replace("t", F.lit(char), F.lit("")))
    return d.select(
        "doc_id", F.col("n").cast("long").alias("n_words"),
        F.length(F.replace(solid, F.lit(" "), F.lit(""))).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("t", f"[^{SYMBOLS}]+", "")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr("size(array_distinct(flatten(transform(r, x -> array(x.i, x.i + 1, x.i + 2)))))").cast("long").alias("n_repeat_words"),
        F.size("lines").alias("_lines"), F.length(F.regexp_replace("t", "[^A-Z]+", "")).alias("_upper"), count("!").alias("_bangs"), count("|").alias("_pipes"), count(".").alias("_stops"),
    )


def with_features(stats: DataFrame) -> DataFrame:
    n, c, k = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1)), F.greatest("_lines", F.lit(1))
    made = {"symbol_rate": F.col("n_symbols") / c, "dup_line_rate": F.col("n_dup_lines") / k, "repeat_rate": F.col("n_repeat_words") / n, "word_length": F.col("word_chars") / n, "upper_rate": F.col("_upper") / c, "bang_rate": F.col("_bangs") / n, "line_words": F.col("n_words") / k, "stop_rate": F.col("_stops") / n, "pipe_rate": F.col("_pipes") / n}
    return stats.withColumns({name: made[name] for name in FEATURES}).withColumn("base_failed", F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words"))


Term = tuple[int, bool, float]  # feature, above (else at most), threshold


def _holds(rule: list[Term], x) -> bool:
    return all((x[j] > t) if above else (x[j] <= t) for j, above, t in rule)


def _grow(rows: list, first: list[Term]) -> list[Term]:
    """Add the threshold of most gain (FOIL's) until no bad row's good neighbours are left or nothing gains."""
    rule = list(first)
    rows = [r for r in rows if _holds(rule, r[0])]
    while len(rule) < MAX_TERMS:
        bad = sum(r[1] for r in rows)
        if bad in (0, len(rows)):
            break
        base = math.log2(bad / len(rows))
        best = (0.0, None)
        for j in range(len(FEATURES)):
            ordered = sorted(rows, key=lambda r: r[0][j])
            seen_bad = 0
            for i, r in enumerate(ordered[:-1], 1):
                seen_bad += r[1]
                a, b = r[0][j], ordered[i][0][j]
                if a == b:
                    continue
                for above, hit, n in ((False, seen_bad, i), (True, bad - seen_bad, len(ordered) - i)):
                    if hit >= 3 and (gain := hit * (math.log2(hit / n) - base)) > best[0] + 1e-9:
                        best = (gain, (j, above, (a + b) / 2))
        if best[1] is None:
            break
        rule.append(best[1])
        rows = [r for r in rows if _holds([best[1]], r[0])]
    return rule


def _worth(rule: list[Term], rows: list) -> tuple[float, int, int]:
    hit = [r[1] for r in rows if _holds(rule, r[0])]
    bad = sum(hit)
    return ((2 * bad - len(hit)) / len(hit) if hit else -1.0), bad, len(hit)


def learn(rows: list[tuple[tuple[float, ...], int]]) -> list[list[Term]]:
    """Rules for bad rows (label 1 of the pair), in order.  No rows or none bad: no rules."""
    grow = [r for i, r in enumerate(rows) if i % 3 != 2]
    prune = [r for i, r in enumerate(rows) if i % 3 == 2]
    out: list[list[Term]] = []
    while len(out) < MAX_RULES and any(r[1] for r in grow):
        rule = _grow(grow, [])
        if not rule:
            break
        while len(rule) > 1 and _worth(rule[:-1], prune)[0] >= _worth(rule, prune)[0]:
            rule.pop()
        _, bad, n = _worth(rule, grow + prune)
        _, pbad, pn = _worth(rule, prune)
        if n < COVER or bad < PRECISION * n or (pn and pbad < PRECISION * pn):
            break
        out.append(rule)
        grow = [r for r in grow if not _holds(rule, r[0])]
        prune = [r for r in prune if not _holds(rule, r[0])]
    return out


def condition(rule: list[Term]) -> Column:
    out = F.lit(True)
    for j, above, t in rule:
        out = out & ((F.col(FEATURES[j]) > t) if above else (F.col(FEATURES[j]) <= t))
    return out


def decision_list(rules: list[list[Term]]) -> tuple[Column, Column]:
    """(verdict, number of the rule that decided; 0: none) as ordered conditional expressions."""
    kept, which = F.lit(True), F.lit(0)
    for k in range(len(rules), 0, -1):
        kept = F.when(condition(rules[k - 1]), F.lit(False)).otherwise(kept)
        which = F.when(condition(rules[k - 1]), F.lit(k)).otherwise(which)
    return kept, which


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> list[list[Term]]:
    """Learn from labelled documents that pass the base rules; at most ``max_train`` rows of statistics come to the driver."""
    rows = labels.where("doc_id is not null and quality is not null").select(F.col("doc_id").cast("long").alias("_id"), F.col("quality").cast("int").alias("_y"))
    rows = rows.orderBy(F.xxhash64("_id"), "_id", "_y").limit(max_train)
    found = docs.select("doc_id", "text").join(F.broadcast(rows), F.col("doc_id") == F.col("_id"), "left_semi")
    stats = with_features(statistics(found))
    got = stats.join(F.broadcast(rows), F.col("doc_id") == F.col("_id")).select(F.xxhash64("doc_id").alias("k"), "_y", "base_failed", *FEATURES).collect()
    got.sort(key=lambda r: tuple(r))
    return learn([(tuple(r[3:]), int(r[1] == 0)) for r in got if not r[2]])


def judge(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """doc_id, the base counts, base_failed, kept, rule (which decided; 0: none) for every document.

    Null and empty texts have no words and fail the base rules.  Repeated rows are judged alike.  Without labels only the base rules decide.
    """
    kept, which = decision_list(train(docs, labels, max_train))
    out = with_features(statistics(docs))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & kept).alias("kept"), which.alias("rule"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
