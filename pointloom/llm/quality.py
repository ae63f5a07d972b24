"""Quality rules: a decision list learned by sequential covering from labelled statistics.

``text_stats`` takes statistics of every whole text with built-in functions. ``learn_rules`` grows threshold conjunctions
(such as "symbols per word above 0.9 and words under 400") that single out documents labelled as poor or as good, prunes each on
documents held back, and keeps it if it stays precise. The rules are a list: the first that holds decides. Every count it needs is one grouped aggregate over all labelled
documents; only a few hundred counts reach the driver. ``verdict`` turns the list into one CASE expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointloom.llm.common import SPACE, WORD, let, scratch, written

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
N_CUTS = 24
MAX_RULES = 8
MAX_TERMS = 3
MIN_PRECISION = 0.95
#: A rule that keeps documents has to be right more often, since most documents are good.
GOOD_PRECISION = 0.99
MIN_COVER = 8


@dataclass(frozen=True)
class Rule:
    """Documents for which every (feature, above, cut) holds are poor, or good."""

    terms: tuple[tuple[str, bool, float], ...]
    hits: int
    misses: int
    poor: bool = True

    def column(self) -> Column:
        out = F.lit(True)
        for name, above, cut in self.terms:
            out = out & (F.col(name) > cut if above else F.col(name) <= cut)
        return out


def repeated_words(words: Column) -> Column:
    """How many words stand in a three-word window that occurs at least twice in the text. Windows are compared by 64-bit
    hashes; only texts in which some window repeats pay for a sort."""

    def covered(at: Column) -> Column:
        step = lambda p, i: F.when(i + 1 < F.size(at), F.least(at[i + 1] - p, F.lit(3))).otherwise(3)
        return F.aggregate(F.transform(at, step), F.lit(0), lambda a, b: a + b)

    def positions(pairs: Column) -> Column:
        same = lambda a, b: F.coalesce(F.get(pairs, a)["h"] == b["h"], F.lit(False))
        twice = F.filter(pairs, lambda x, i: same(i - 1, x) | same(i + 1, x))
        return let(F.array_sort(F.transform(twice, lambda x: x["i"])), covered)

    def by_hash(hashes: Column) -> Column:
        pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(pairs, positions))

    windows = F.transform(F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0))), lambda w, i: F.xxhash64(w, words[i + 1], words[i + 2]))
    return F.when(F.size(words) < 4, F.lit(0)).otherwise(let(windows, by_hash)).cast("long")


def text_stats(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of each whole text. Null text counts as empty; every share of nothing is 0."""
    text = F.coalesce(F.col("text"), F.lit(""))
    left = lambda pattern: F.length(F.regexp_replace(text, pattern, ""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    by_words = let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words")))
    by_lines = let(lines, lambda x: F.struct(F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    d = docs.select(
        "doc_id", F.xxhash64("text").alias("text_hash"), by_words.alias("w"), by_lines.alias("l"), left(SPACE + "+").cast("long").alias("word_chars"), left(r"[^#*$%&|<>]+").cast("long").alias("n_symbols"),
        left(r"[^\p{Lu}]+").alias("n_upper"), left(r"[^!?]+").alias("n_shouts"), left(r"[^0-9]+").alias("n_digits"),
    )
    d = d.select("doc_id", "text_hash", "w.*", "l.*", "word_chars", "n_symbols", "n_upper", "n_shouts", "n_digits")
    per = lambda a, b: (F.col(a) / F.greatest(F.col(b), F.lit(1))).cast("double")
    return d.select(
        "doc_id", "text_hash", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        per("n_symbols", "n_words").alias("f_symbols"), per("n_upper", "word_chars").alias("f_upper"), per("n_shouts", "n_words").alias("f_shouts"),
        per("n_digits", "word_chars").alias("f_digits"), per("n_dup_lines", "n_lines").alias("f_dup_lines"), per("n_repeat_words", "n_words").alias("f_repeats"),
        per("word_chars", "n_words").alias("f_word_length"), per("n_words", "n_lines").alias("f_line_words"), F.col("n_words").cast("double").alias("f_words"),
    )


def base_failed() -> Column:
    """The fixed rule that holds besides the learned list."""
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def learn_rules(stats: DataFrame, labels: DataFrame, min_precision: float = MIN_PRECISION) -> list[Rule]:
    """The decision list from all labelled documents that pass the base rule. Two thirds, by a hash of doc_id, grow rules
    and one third prunes and judges them. Each turn grows a rule for the class that its first term gains most on, poor or
    good; if the pruned rule is not precise, it is dropped with nothing removed and the other class has its turn; if both
    fail, the list ends. An accepted rule takes the documents that it covers with it, so later rules hold for what is left,
    just as the ordered CASE reads them. No labels, or one class only, give an empty list, which keeps everything.
    Labels that are null, and labels of unknown documents, are left out."""
    feats = [c for c in stats.columns if c.startswith("f_")]
    labelled = labels.where("quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    rows = stats.where(~base_failed()).join(labelled, "doc_id").select(*feats, (F.col("quality") == 0).alias("poor"), (F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(3)) > 0).alias("grow"))
    rows = written(rows, "quality-labelled")
    found = rows.select(*(F.percentile_approx(f, [i / N_CUTS for i in range(1, N_CUTS)], 2000).alias(f) for f in feats)).first()
    cuts = {f: sorted(set(found[f] or ())) for f in feats}
    if not any(cuts.values()):
        return []
    bins = F.array(*(sum((F.when(F.col(f) > c, 1).otherwise(0) for c in cuts[f]), F.lit(0)) for f in feats))
    rows = written(rows.select("poor", "grow", bins.alias("bins")), "quality-bins")

    def holds(terms) -> Column:
        out = F.lit(True)
        for k, above, cut in terms:
            out = out & (F.col("bins")[k] > cut if above else F.col("bins")[k] <= cut)
        return out

    def tally(df: DataFrame) -> dict:
        """feature -> bin -> [poor, good]"""
        out: dict = {}
        for k, b, poor, n in df.select("poor", F.posexplode("bins").alias("k", "b")).groupBy("k", "b", "poor").count().collect():
            out.setdefault(k, {}).setdefault(b, [0, 0])[0 if poor else 1] += n
        return out

    def best_term(counts: dict, poor: bool):
        """(gain, term, others covered) of the cut with the largest information gain for a class."""
        best = (0.0, None, 0)
        if not counts:
            return best
        own, other = (0, 1) if poor else (1, 0)
        all_p, all_n = (sum(v[i] for v in counts[min(counts)].values()) for i in (own, other))
        old = math.log2(max(all_p, 1e-9) / max(all_p + all_n, 1))
        for k, hist in counts.items():
            p = n = 0
            for b in range(len(cuts[feats[k]])):
                p, n = p + hist.get(b, (0, 0))[own], n + hist.get(b, (0, 0))[other]
                for above, pp, nn in ((False, p, n), (True, all_p - p, all_n - n)):
                    if pp and pp + nn < all_p + all_n:
                        gain = pp * (math.log2(pp / (pp + nn)) - old)
                        best = max(best, (gain, (k, above, b), nn), key=lambda x: (x[0], (-x[1][0], x[1][1], -x[1][2]) if x[1] else ()))
        return best

    def grown(left: DataFrame, poor: bool, first) -> list:
        gain, term, n = first
        terms: list = []
        while term is not None and gain > 0:
            terms.append(term)
            if n == 0 or len(terms) == MAX_TERMS:
                break
            gain, term, n = best_term(tally(left.where("grow").where(holds(terms))), poor)
        return terms

    def pruned(left: DataFrame, poor: bool, terms: list) -> tuple[tuple, int, int]:
        """The part of the conjunction that does best on the rows held back, with what it covers there; any term may go."""
        subsets = [c for size in range(1, len(terms) + 1) for c in combinations(terms, size)]
        tests = left.where("not grow").select(*(F.count_if(holds(c) & (F.col("poor") == own)).alias(f"{i}{own}") for i, c in enumerate(subsets) for own in (True, False))).first()
        hits, misses = ([tests[f"{i}{own}"] for i in range(len(subsets))] for own in (poor, not poor))
        best = max(range(len(subsets)), key=lambda i: (round((hits[i] + 1) / (hits[i] + misses[i] + 2), 3), hits[i], -len(subsets[i])))
        return subsets[best], hits[best], misses[best]

    rules: list[Rule] = []
    left = rows
    while len(rules) < MAX_RULES:
        counts = tally(left.where("grow"))
        firsts = {poor: best_term(counts, poor) for poor in (True, False)}
        for poor in sorted(firsts, key=lambda c: (-firsts[c][0], not c)):
            terms = grown(left, poor, firsts[poor])
            if not terms:
                continue
            terms, hits, misses = pruned(left, poor, terms)
            if hits >= MIN_COVER and hits / (hits + misses) >= (min_precision if poor else GOOD_PRECISION):
                rules.append(Rule(tuple((feats[k], above, cuts[feats[k]][b]) for k, above, b in terms), hits, misses, poor))
                left = left.where(~holds(terms))
                break
        else:
            break  # what is left can't be told apart precisely
    return rules


def verdict(rules: list[Rule]) -> Column:
    """kept: false if the base rule fails, else the first rule that holds decides, and true if none does."""
    out = F.when(base_failed(), F.lit(False))
    for rule in rules:
        out = out.when(rule.column(), F.lit(not rule.poor))
    return out.otherwise(F.lit(True))


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the statistics, base_failed and kept for each row of ``docs``. Null text counts as empty and fails the base rule;
    rows that repeat are judged alike; very long texts are read whole; an empty table gives no rows. Only doc_id and text are
    used."""
    stats = written(text_stats(docs), "quality-stats")
    rules = learn_rules(stats, labels)
    return stats.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"), verdict(rules).alias("kept"))


def good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are kept, with their own columns. A row goes if its doc_id and text are judged poor, so rows that
    share an id, or have none, are told apart. Columns of any name stay as they are; an empty table gives no rows."""
    with scratch(docs.sparkSession):
        stats = written(text_stats(docs), "quality-stats")
        rules = learn_rules(stats, labels)
        gone = written(stats.where(~verdict(rules)).select(F.col("doc_id").alias("_gone_id"), F.col("text_hash").alias("_gone_hash")).distinct(), "quality-gone", keep=True)
    whole = docs.select(F.struct(*docs.columns).alias("_row"), F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_hash"))
    return whole.join(gone.hint("merge"), F.col("_id").eqNullSafe(F.col("_gone_id")) & (F.col("_hash") == F.col("_gone_hash")), "left_anti").select("_row.*")
