"""Personal data: fixed patterns, and a bootstrapped extraction that learns the contexts in which they stand.

``base_spans`` finds e-mail addresses, IP addresses, card and phone numbers with built-in regular expressions. The
bootstrap then takes those findings as seeds. The one and two words before and after a seed are lexical patterns; pattern and
instance form a bipartite graph whose edges are counted over the whole corpus. In each round a pattern is scored by how
purely and how often it leads to trusted instances of one kind, and an instance by the patterns it stands in. Tokens and
groups of digits that look like identifiers, stand in trusted patterns and are no seeds become instances themselves; from the
next round on they induce patterns as seeds do, so a context that no seed has can be learned. Those that end above the
threshold are added as spans. Everything is DataFrame operations; edges are aggregated before they are joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointloom.llm.common import SPACE, documents, let, written  # noqa: F401

KINDS = ("email", "ip", "card", "phone")
ROUNDS = 3
MIN_SEEDS = 5
MIN_CONFIDENCE = 0.9
#: Patterns below this lead to nothing, so that many chance contexts do not add up.
MIN_PATTERN = 0.6
CONTEXT_CHARS = 60

# The possessive and look-behind forms match what the plain patterns match, without their backtracking on long runs.
LOCAL = r"[A-Za-z0-9._%+-]"
EMAIL = rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9]++(?:[\x20-][0-9]++)*+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: What looks like an identifier: groups of digits joined by single signs or spaces, or a token with an @ between other
#: characters or with six digits.
TOKEN = r"(?<![^\x20\x09-\x0D])\(?[0-9]{2,}\)?(?:[\x20.-]\(?[0-9]{2,}\)?)++(?![^\x20\x09-\x0D.,;:!?)])|(?<![^\x20\x09-\x0D])(?=[^\x20\x09-\x0D@]++@[^\x20\x09-\x0D]|(?:[^\x20\x09-\x0D0-9]*+[0-9]){6})[^\x20\x09-\x0D]++"


def found(text: Column, pattern: str) -> Column:
    """array<struct<start, end, hit, before, after>> of the leftmost, non-overlapping matches; positions in code points, end
    exclusive; ``before`` and ``after`` are what stands about the match, up to CONTEXT_CHARS and beyond the match next to it."""

    reach, no = F.lit(CONTEXT_CHARS), F.lit("")
    before = lambda gaps, hits, i: F.right(F.concat(F.coalesce(F.right(F.get(gaps, i - 1), reach), no), F.coalesce(F.right(F.get(hits, i - 1), reach), no), gaps[i]), reach)
    after = lambda gaps, hits, i: F.left(F.concat(gaps[i + 1], F.coalesce(F.left(F.get(hits, i + 1), reach), no)), reach)

    def place(x: Column) -> Column:
        gaps, hits = x["gaps"], x["hits"]
        empty = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("starts"))
        step = lambda acc, i: F.struct((acc["at"] + F.length(gaps[i]) + F.length(hits[i])).alias("at"), F.array_append(acc["starts"], acc["at"] + F.length(gaps[i])).alias("starts"))
        starts = F.aggregate(F.sequence(F.lit(0), F.size(hits) - 1), empty, step, lambda acc: acc["starts"])
        return F.transform(starts, lambda s, i: F.struct(s.alias("start"), (s + F.length(hits[i])).alias("end"), hits[i].alias("hit"), before(gaps, hits, i).alias("before"), after(gaps, hits, i).alias("after")))

    hits = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda h: F.when(F.size(h) > 0, let(F.struct(h.alias("hits"), F.split(text, pattern, -1).alias("gaps")), place)))
    return F.coalesce(hits, F.expr("cast(array() as array<struct<start:int,end:int,hit:string,before:string,after:string>>)"))


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the check sum of card numbers."""
    size = F.length(digits)

    def add(acc: Column, i: Column) -> Column:
        d = F.substring(digits, size - i, F.lit(1)).cast("int")
        return acc + F.when(i % 2 == 0, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(0), size - 1), F.lit(0), add) % 10 == 0


def valid(kind: str, hit: Column) -> Column:
    """What a match has to satisfy besides its pattern."""
    digits = F.regexp_replace(hit, "[^0-9]+", "")
    if kind == "ip":
        return hit.rlike(r"^0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(\.0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$")
    if kind == "card":
        return F.length(digits).between(14, 19) & F.when(F.length(digits).between(14, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True)


def scan(docs: DataFrame) -> DataFrame:
    """row, doc_id, base: array<struct<start, rank, end, hit, before, after>> by start then kind, and the same for tokens that look
    like identifiers, with rank -1. A cheap test comes before each pattern."""
    text = F.coalesce(F.col("text"), F.lit(""))
    digits = text.rlike(r"[0-9](?:[\x20-]?[0-9]){13}")
    tests = {"email": (text.contains("@"), EMAIL), "ip": (text.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"), IP), "card": (digits, CARD), "phone": (text.contains("+"), PHONE)}
    none = F.expr("cast(array() as array<struct<start:int,rank:int,end:int,hit:string,before:string,after:string>>)")

    def listed(spans: Column, rank: int) -> Column:
        return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end"), x["hit"].alias("hit"), x["before"].alias("before"), x["after"].alias("after")))

    good = lambda kind: lambda x: valid(kind, x["hit"])
    kinds = [F.when(test, listed(F.filter(found(text, pattern), good(kind)), i)).otherwise(none) for i, (kind, (test, pattern)) in enumerate(tests.items())]
    tokens = F.when(text.contains("@") | text.rlike(r"[0-9][^\x20\x09-\x0D]{4,}[0-9]|[0-9]{2}\)?[\x20.-]\(?[0-9]{2}"), listed(found(text, TOKEN), -1)).otherwise(none)
    return docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.array_sort(F.concat(*kinds)).alias("base"), tokens.alias("tokens"))


def contexts(before: Column, after: Column) -> Column:
    """The lexical patterns of a place: the last two words ahead of it and the last one, the next one and two, in small letters;
    a sign tells the sides apart."""
    words = lambda side: F.filter(F.split(F.lower(side), SPACE + "+", -1), lambda w: w != "")
    last = lambda w, n: F.when(F.size(w) >= n, F.concat(F.array_join(F.slice(w, -n, n), " "), F.lit(" <")))
    next_ = lambda w, n: F.when(F.size(w) >= n, F.concat(F.lit("> "), F.array_join(F.slice(w, 1, n), " ")))
    return F.array_compact(F.array(*(last(words(before), n) for n in (2, 1)), *(next_(words(after), n) for n in (2, 1))))


def candidates(scanned: DataFrame) -> DataFrame:
    """row, start, end, instance, contexts of the identifier-like tokens that touch no base span."""
    trimmed = lambda x: F.regexp_extract(x["hit"], r"^[(\[\"'<]*+(.*?)[)\].,;:!?\"'>]*$", 1)
    lead = lambda x: F.length(F.regexp_extract(x["hit"], r"^[(\[\"'<]*+", 0))
    # closing signs belong to what follows
    tail = lambda x: F.concat(F.regexp_extract(x["hit"], r"[)\].,;:!?\"'>]*$", 0), x["after"])
    free = F.filter("tokens", lambda x: ~F.exists("base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
    d = scanned.where("size(tokens) > 0").select("row", F.explode(free).alias("x"))
    return d.select("row", (F.col("x.start") + lead(F.col("x"))).alias("start"), trimmed(F.col("x")).alias("instance"), contexts(F.col("x.before"), tail(F.col("x"))).alias("contexts")).withColumn("end", F.col("start") + F.length("instance")).where("instance != ''")


def like_kind(kind: Column, instance: Column) -> Column:
    """Whether an unseen token has the build of a kind, so that a context alone never decides."""
    n = F.length(F.regexp_replace(instance, "[^0-9]+", ""))
    plain = instance.rlike(r"^[0-9().\x20-]+$")
    return F.when(kind == 0, instance.rlike(r"^[^@]+@[^@]+$")).when(kind == 1, instance.rlike(r"^[0-9a-fA-F]*[.:][0-9a-fA-F.:]+$")).when(kind == 2, plain & n.between(12, 19)).otherwise(plain & n.between(7, 15))


def bootstrap(seeds: DataFrame, unseen: DataFrame, rounds: int = ROUNDS, min_seeds: int = MIN_SEEDS, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """(instance, kind) of the tokens that the learned patterns hold to be identifiers.

    seeds: (instance, kind, context, n); unseen: (instance, context, n); both with one row per instance and context. A
    pattern's confidence for a kind is the trusted weight that it leads to over all it leads to, and counts only with
    ``min_seeds`` different seed instances; an instance's is one less the product of its patterns' doubts, over the
    patterns that agree on its kind.
    """
    edges = written(
        seeds.select("instance", F.col("kind").alias("seed"), "context", F.col("n").cast("double").alias("n")).unionByName(unseen.select("instance", F.lit(None).cast("int").alias("seed"), "context", F.col("n").cast("double").alias("n"))),
        "pii-edges",
    )
    totals = written(edges.groupBy("context").agg(F.sum("n").alias("total")), "pii-contexts")
    open_edges = edges.where("seed is null").select("instance", "context", "n")
    trusted = edges.where("seed is not null").select("context", F.col("seed").alias("kind"), "instance", "n")
    scored = None
    for _ in range(rounds):
        known = trusted.groupBy("context", "kind").agg(F.count_distinct("instance").alias("seeds"), F.sum("n").alias("weight")).where(F.col("seeds") >= min_seeds)
        patterns = written(known.join(totals.hint("merge"), "context").select("context", "kind", (F.col("weight") / F.col("total")).alias("confidence")).where(F.col("confidence") >= MIN_PATTERN), "pii-patterns")
        doubts = open_edges.join(patterns.hint("merge"), "context").where(like_kind(F.col("kind"), F.col("instance")))
        scored = written(doubts.groupBy("instance", "kind").agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-9)))))).alias("score")), "pii-instances")
        # instances above the level are trusted as seeds are, with the weight of their score, and bring their own contexts
        sure = scored.groupBy("instance").agg(F.max(F.struct("score", -F.col("kind"))).alias("b")).where(F.col("b.score") >= min_confidence)
        gained = open_edges.join(sure.hint("merge"), "instance").select("context", (-F.col("b.col2")).alias("kind"), "instance", (F.col("n") * F.col("b.score")).alias("n"))
        trusted = edges.where("seed is not null").select("context", F.col("seed").alias("kind"), "instance", "n").unionByName(gained)
    best = scored.groupBy("instance").agg(F.max(F.struct("score", -F.col("kind"))).alias("b"))
    return best.where(F.col("b.score") >= min_confidence).select("instance", (-F.col("b.col2")).alias("kind"))


def find_pii(docs: DataFrame, **how) -> DataFrame:
    """row, doc_id, base and added: the base spans and those that the bootstrap adds, as array<struct<start, rank, end>>
    with rank the place of the kind in KINDS. Null text counts as empty; rows that repeat have the same spans each; an empty
    table gives no rows. Very long texts are read whole. Only doc_id and text are used, so other columns may have any names."""
    scanned = written(scan(docs), "pii-scan")
    cands = written(candidates(scanned), "pii-candidates")
    pair = lambda df, *more: df.groupBy("instance", *more, "context").agg(F.count("*").alias("n"))
    seed_rows = scanned.where("size(base) > 0").select(F.explode("base").alias("b")).select(F.col("b.hit").alias("instance"), F.col("b.rank").alias("kind"), F.explode(contexts(F.col("b.before"), F.col("b.after"))).alias("context"))
    unseen_rows = cands.select("instance", F.explode("contexts").alias("context"))
    named = bootstrap(pair(seed_rows, "kind"), pair(unseen_rows), **how)
    added = cands.join(named.hint("merge"), "instance").groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", F.col("kind").alias("rank"), "end"))).alias("added"))
    slim = lambda c: F.transform(c, lambda x: F.struct(x["start"].alias("start"), x["rank"].alias("rank"), x["end"].alias("end")))
    none = F.expr("cast(array() as array<struct<start:int,rank:int,end:int>>)")
    return scanned.select("row", "doc_id", slim("base").alias("base")).join(added.hint("merge"), "row", "left").select("row", "doc_id", "base", F.coalesce("added", none).alias("added"))


def span_text(spans: Column, kinds=KINDS) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*map(F.lit, kinds))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", names[x["rank"]], x["start"], x["end"])), ",")
