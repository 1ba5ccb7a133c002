"""Secret scan in DataFrame and SQL functions alone.

Base kinds are patterns. Beyond them, long unbroken tokens are compared under two character Markov models, one of
random strings (values of the base kinds) and one of ordinary identifiers (words of a bounded sample of documents):
a token whose mean log-likelihood ratio is high is reported as kind ``random``.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortwave.llm.base import checkpointed, table, texts

KEYWORD = r"(?i:password|passwd|secret|token|api_?key)"
ASSIGN = KEYWORD + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Greedy runs, so a minimal length in the pattern finds the same matches as a filter behind it.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = (("assign", ASSIGN), ("access", ACCESS), ("hex", HEX))
TOKEN_LENGTH = 20
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
WORD = r"[A-Za-z0-9_-]{4,}"
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-."
MIN_VALUE = 6
#: Labelled rows of either class that the Markov models are fitted on, at most (documents with the least hash of their id).
SAMPLE_DOCS = 5_000
#: Matches whose places are summed up together.
RUN = 256
#: Mean log-likelihood ratio per character step, in nats, above which a token is random.
THRESHOLD = 0.75
SMOOTHING = 0.1
#: Weight, in pairs, of the frequency of single characters.
PRIOR_PAIRS = 20


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body over a value that is computed once, also where body's own functions use it for each element."""
    return F.get(F.transform(F.array(value), body), 0)


def spans_of(text: Column, kind: str, pattern: str) -> Column:
    """Leftmost non-overlapping matches as array<struct<start, end, kind, hit>>, in code points.

    Starts are running sums of the lengths before: within runs of RUN matches first, then over the runs, so that
    the work stays in proportion to a text's matches.
    """
    between, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    span = "struct<start:int,end:int,kind:string,hit:string>"
    empty = F.expr(f"cast(array() as array<{span}>)")

    def advance(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + F.length(x["hit"])
        one = F.array(F.struct(start.alias("start"), end.alias("end"), F.lit(kind).alias("kind"), x["hit"].alias("hit")))
        return F.struct(end.alias("at"), F.concat(acc["found"], one).alias("found"))

    def append(acc: Column, run: Column) -> Column:
        one = F.array(F.struct(acc["at"].alias("base"), run["found"].alias("found")))
        return F.struct((acc["at"] + run["at"]).alias("at"), F.concat(acc["runs"], one).alias("runs"))

    def placed(run: Column) -> Column:
        return F.transform(run["found"], lambda s: F.struct((s["start"] + run["base"]).alias("start"), (s["end"] + run["base"]).alias("end"), s["kind"].alias("kind"), s["hit"].alias("hit")))

    def located(steps: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / RUN).cast("int")), lambda j: F.slice(steps, j * RUN + 1, F.lit(RUN)))
        summed = F.transform(runs, lambda run: F.aggregate(run, F.struct(F.lit(0).alias("at"), empty.alias("found")), advance))
        none = F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as array<struct<base:int,found:array<{span}>>>)").alias("runs"))
        return F.flatten(F.transform(F.aggregate(summed, none, append, lambda acc: acc["runs"]), placed))

    paired = bound(between, lambda gaps: F.transform(hits, lambda hit, i: F.struct(F.length(F.get(gaps, i)).alias("gap"), hit.alias("hit"))))
    return F.when(text.rlike(pattern), bound(paired, located)).otherwise(empty)


def apart_from(span: Column, starts: Column, ends: Column) -> Column:
    """Whether a span meets none of the others, which are in order and don't overlap: of those that start before its end, only the last can."""
    count = F.aggregate(F.array(*[F.lit(1 << i) for i in range(30, -1, -1)]), F.lit(0), lambda k, step: F.when((k + step <= F.size(starts)) & (F.get(starts, k + step - 1) < span["end"]), k + step).otherwise(k))
    return bound(count, lambda k: (k == 0) | (F.get(ends, k - 1) <= span["start"]))


def value_of(span: Column) -> Column:
    return F.when(span["kind"] == "assign", F.regexp_extract(span["hit"], ASSIGN, 1)).otherwise(span["hit"])


def unlabelled(token: Column) -> Column:
    """Long tokens of letters and digits: those that the models are there to judge, so they train neither."""
    return (F.length(token) >= TOKEN_LENGTH) & token.rlike("[0-9]") & token.rlike("[A-Za-z]")


def with_base_spans(docs: DataFrame) -> DataFrame:
    """Adds `base`: the spans of the base kinds in order of start, then kind as listed, and `tokens`: long tokens apart from them."""
    out = docs
    for kind, pattern in KINDS:
        out = out.withColumn(kind, spans_of(F.col("text"), kind, pattern))
    out = out.withColumn("assign", F.filter("assign", lambda s: F.length(value_of(s)) >= MIN_VALUE))
    order = F.array([F.lit(k) for k, _ in KINDS])
    merged = F.concat(*[F.transform(k, lambda s: F.struct(s["start"].alias("start"), F.array_position(order, s["kind"]).cast("int").alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"), s["hit"].alias("hit"))) for k, _ in KINDS])
    out = out.withColumn("base", F.array_sort(merged))
    tokens = spans_of(F.col("text"), "random", TOKEN)
    apart = F.filter(tokens, lambda t: unlabelled(t["hit"]))
    for kind, _ in KINDS:  # spans of one kind don't overlap
        meets = lambda found, kind=kind: bound(F.transform(kind, lambda s: s["start"]), lambda starts: bound(F.transform(kind, lambda s: s["end"]), lambda ends: F.filter(found, lambda t: apart_from(t, starts, ends))))
        apart = F.when(F.size(kind) > 0, meets(apart)).otherwise(apart)
    return out.withColumn("tokens", apart)


def steps(token: Column) -> Column:
    """Indices of a token's character pairs in a square table over ALPHABET; characters outside have index 0."""
    at = F.transform(F.split(token, ""), lambda c: F.greatest(F.instr(F.lit(ALPHABET), c) - 1, F.lit(0)))
    pairs = bound(at, lambda codes: F.transform(F.slice(codes, 2, F.greatest(F.size(codes) - 1, F.lit(0))), lambda code, i: F.get(codes, i) * len(ALPHABET) + code))
    return F.when(F.length(token) > 1, pairs).otherwise(F.array().cast("array<int>"))


def fit_ratio(docs: DataFrame, found: DataFrame, sample_docs: int = SAMPLE_DOCS) -> list[float]:
    """The table of log-likelihood ratios, random against ordinary, by character pair.

    Labelled samples: values of base spans are random, words of documents without any are ordinary. Both come from
    at most sample_docs documents each, those with the least hash of their id, so the fit doesn't grow with the corpus.
    """
    least = lambda df: df.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)
    some = F.size("base") > 0
    secret = found.where(some).join(F.broadcast(least(found.where(some))), "doc_id", "left_semi").select(F.lit(1).alias("label"), F.explode(F.transform("base", value_of)).alias("token"))
    chosen = F.broadcast(least(found.where(~some)))
    plain = docs.join(chosen, "doc_id", "left_semi").select(F.lit(0).alias("label"), F.explode(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("token")).where(~unlabelled(F.col("token")))
    pairs = secret.unionByName(plain).select("label", F.explode(steps(F.col("token"))).alias("pair")).groupBy("label", "pair").agg(F.count("*").alias("n"))
    size = len(ALPHABET)
    counts = [[0] * (size * size) for _ in range(2)]
    for r in pairs.collect():  # at most 2 x 68 x 68 rows, whatever the corpus
        counts[r["label"]][r["pair"]] += r["n"]

    def logs(n: list[int]) -> list[float]:
        """log P(next | character), smoothed towards the frequency of the next character."""
        single = [sum(n[b::size]) + SMOOTHING for b in range(size)]
        share = [x / sum(single) for x in single]
        rows = [sum(n[a * size : (a + 1) * size]) for a in range(size)]
        return [math.log((n[a * size + b] + PRIOR_PAIRS * share[b]) / (rows[a] + PRIOR_PAIRS)) for a in range(size) for b in range(size)]

    ordinary, ratio = logs(counts[0]), logs(counts[1])
    ratio = [round(r - o, 4) for r, o in zip(ratio, ordinary, strict=True)]
    return ratio


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = SAMPLE_DOCS, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, base, added; arrays of spans (start, rank or score, end, kind, hit).

    Null and empty texts have no spans; texts are read whole; repeated rows get a row each; an empty table gives
    an empty result (the models are then uniform); other columns are not read.
    """
    rows = texts(docs, id_col, text_col)
    found = checkpointed(with_base_spans(rows).select("doc_id", "base", "tokens"))
    ratio = F.from_json(F.lit(json.dumps(fit_ratio(rows, found, sample_docs))), "array<double>")
    mean = lambda t: F.aggregate(steps(t), F.lit(0.0), lambda acc, i: acc + F.get(ratio, i)) / (F.length(t) - 1)
    scored = F.transform("tokens", lambda t: F.struct(t["start"].alias("start"), mean(t["hit"]).alias("score"), t["end"].alias("end"), t["kind"].alias("kind"), t["hit"].alias("hit")))
    return found.select("doc_id", "base", F.filter(scored, lambda t: t["score"] > threshold).alias("added"))


def spelled(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_spans(table(spark, sf_dir, "documents"))
    plain = lambda spans, rank: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (s["rank"] if rank is None else F.lit(rank)).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))
    everything = F.array_sort(F.concat(plain(F.col("base"), None), plain(F.col("added"), len(KINDS) + 1)))
    number = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[number(k) for k, _ in KINDS], F.sha2(spelled(F.col("base")), 256).alias("base_sha256"), spelled(everything).alias("spans"))
