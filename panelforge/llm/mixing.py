"""Mixing sources to target weights (problem 7).

Entropy balancing: among all document rates between 0 and the cap that meet each source's token target, take those nearest to
drawing every document alike, at odds of 1 to the cap, whatever the targets. Their dual is convex with one multiplier a
source; the odds of a document are tilted exponentially by its length. Newton steps on the logarithm of the tokens drawn,
kept within brackets, read one aggregate of the lengths for all sources at once. The rates are
rounded to copies along the lengths, so that the tokens drawn stay within about one document of the target.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.core.errors import InputValidationError, LibraryError
from panelforge.core.session import cut
from panelforge.functions.exprs import splittable_join, strip
from panelforge.operators.ranks import exact_rank

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pre-tokenization pattern that the public byte-level vocabulary was made with.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _encoding(ranks_file: bytes):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks_file.splitlines() if line)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(documents: DataFrame, *, text: str = "text", keep: list[str], tokenizer: str = TOKENIZER, tokens: str = "tokens") -> DataFrame:
    """``keep`` columns and the number of tokens of each text under a public byte-level vocabulary.

    A null text has 0 tokens. The vocabulary file (under 1 MB) is read on the driver and sent to the tasks.
    """
    with open(tokenizer, "rb") as f:
        shared = documents.sparkSession.sparkContext.broadcast(f.read())
    source = documents.select(*keep, F.col(text).alias("__text"))
    schema = ", ".join(f"`{c}` {t}" for c, t in source.drop("__text").dtypes) + f", `{tokens}` long"

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        encode = _encoding(shared.value).encode_ordinary
        for batch in batches:
            texts = batch.column("__text").to_pylist()
            n = pa.array([len(encode(t)) if t else 0 for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), n], names=[*keep, tokens])

    return source.mapInArrow(count, schema)


def source_name(c: Column) -> Column:
    """A source without case and outer blanks; null for blank."""
    name = F.lower(strip(c))
    return F.when(name != "", name)


def balance(lengths: DataFrame, goals: dict[str, tuple[float, int]], *, rounds: int = 60, tolerance: float = 1e-9) -> dict[str, tuple[float, float]]:
    """The tilt of each source: rates ``cap * sigmoid(a + b * tokens / scale)`` that meet its goal of tokens.

    ``lengths`` has (source, tokens, n); ``goals`` the token goal and the cap of each source, a bounded list. ``a`` is the
    base, odds of 1 to the cap, and does not depend on the goals; ``b`` is solved for by Newton steps on the dual, each one
    aggregate over ``lengths`` for all sources together. A goal at or above cap * total is met by the cap.
    """
    spark = lengths.sparkSession
    names = sorted(goals)
    totals = {r["source"]: (r["t"], r["n"], r["q"]) for r in lengths.filter(F.col("source").isin(names)).groupBy("source").agg(F.sum(F.col("tokens") * F.col("n")).alias("t"), F.sum("n").alias("n"), F.sum(F.pow(F.col("tokens").cast("double"), 2) * F.col("n")).alias("q")).collect()}
    state: dict[str, list[float]] = {}
    bracket: dict[str, list[float]] = {}
    fixed: dict[str, tuple[float, float]] = {}
    for s in names:
        goal, cap = goals[s]
        t, n, q = totals.get(s, (0, 0, 0.0))
        if not t or goal <= 0:
            fixed[s] = (-math.inf, 0.0)
        elif goal >= cap * t:
            fixed[s] = (math.inf, 0.0)
        else:
            # the mean length of a token's document is the scale on which the tokens drawn react to b
            state[s] = [-math.log(cap), 0.0, q / t]
            bracket[s] = [-math.inf, math.inf]
    for _ in range(rounds):
        if not state:
            break
        rows = [(s, a, b, scale, float(goals[s][1])) for s, (a, b, scale) in state.items()]
        tilt = F.broadcast(spark.createDataFrame(rows, "source string, a double, b double, scale double, cap double"))
        x = F.col("a") + F.col("b") * F.col("tokens") / F.col("scale")
        s1 = 1 / (1 + F.exp(-x))
        step = lengths.join(tilt, "source").groupBy("source").agg(
            F.sum(F.col("cap") * s1 * F.col("tokens") * F.col("n")).alias("drawn"),
            F.sum(F.col("cap") * s1 * (1 - s1) * F.col("tokens") * F.col("tokens") / F.col("scale") * F.col("n")).alias("slope"),
        )
        moved = False
        for r in step.collect():
            source, goal, drawn = r["source"], goals[r["source"]][0], r["drawn"]
            if abs(drawn - goal) <= tolerance * goal:
                continue
            b, ends = state[source][1], bracket[source]
            ends[drawn > goal] = b
            change = math.log(goal / drawn) * drawn / r["slope"] if drawn > 0 and r["slope"] > 0 else math.inf
            to = b + change
            if not ends[0] < to < ends[1] or abs(change) > 1 + abs(b):
                # halve the bracket, or double the distance while one end is open
                to = sum(ends) / 2 if math.isfinite(sum(ends)) else b + math.copysign(1 + abs(b), goal - drawn)
            if to != b:
                state[source][1] = to
                moved = True
        if not moved:
            break
    else:
        if state:
            raise LibraryError(f"the token goals are not met after {rounds} rounds")
    return fixed | {s: (a, b / scale) for s, (a, b, scale) in state.items()}


def mix_sources(documents: DataFrame, targets: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", tokenizer: str = TOKENIZER) -> tuple[DataFrame, DataFrame]:
    """(drawn, shares): the documents drawn with their copies, and each source's target and actual share.

    The size is that of all tokens of ``documents``: a source's goal is its target share of them, met by whole
    documents of at most ``max_repeats`` copies; where even all copies fall short, the cap decides. Sources are compared
    without case and outer blanks; documents of no listed source, or of none, are not drawn; a listed source without
    documents has share 0. Of repeated target rows the one that sorts first holds. Empty texts weigh nothing and are
    not drawn. Target shares need not sum to 1. ``share_of_corpus`` is in tokens of all documents, ``share_of_drawn``
    in tokens of all that was drawn.
    """
    if documents.select(doc_id).schema[0].dataType.simpleString() not in ("bigint", "int", "string"):
        raise InputValidationError("doc_id must be a number or a text")
    counted = cut(count_tokens(documents.select(F.col(doc_id).alias("doc_id"), source_name(F.col(source)).alias("source"), F.col(text).alias("text")), keep=["doc_id", "source"], tokenizer=tokenizer))
    listed = targets.select(source_name(F.col("source")).alias("source"), F.col("target_share"), F.col("max_repeats")).filter("source IS NOT NULL AND target_share > 0 AND max_repeats > 0")
    listed = listed.groupBy("source").agg(F.min(F.struct("target_share", "max_repeats")).alias("x")).select("source", "x.*")
    goal_rows = listed.limit(10_001).collect()
    if len(goal_rows) > 10_000:
        raise InputValidationError("at most 10000 sources can be balanced")
    lengths = cut(counted.groupBy("source", "tokens").agg(F.count(F.lit(1)).alias("n")))
    totals = lengths.agg(F.sum(F.col("tokens") * F.col("n")).alias("tokens"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    everything = totals["tokens"] or 0
    goals = {r["source"]: (r["target_share"] * everything, r["max_repeats"]) for r in goal_rows}
    tilts = balance(lengths, goals)
    spark = documents.sparkSession
    big = 1e6
    table = [(s, max(-big, min(big, tilts[s][0])), tilts[s][1], goals[s][1], float(goals[s][0])) for s in sorted(goals)]
    plan = F.broadcast(spark.createDataFrame(table, "source string, a double, b double, cap int, goal double"))
    used = lengths.filter("tokens > 0").join(plan, "source")
    rate = F.when(F.col("a") >= big, F.col("cap").cast("double")).when(F.col("a") <= -big, 0.0).otherwise(F.col("cap") / (1 + F.exp(-(F.col("a") + F.col("b") * F.col("tokens")))))
    used = used.withColumn("rate", rate)
    # rounding: cumulative rates along the lengths of a source; a document gets the whole numbers that its step passes
    before = Window.partitionBy("source").orderBy("tokens").rowsBetween(Window.unboundedPreceding, -1)
    used = used.withColumn("start", F.coalesce(F.sum(F.col("rate") * F.col("n")).over(before), F.lit(0.0)) + 0.5)
    ranked = exact_rank(counted.filter("tokens > 0 AND source IS NOT NULL"), ["source", "tokens"], ["doc_id"], rows=totals["n"])
    steps = splittable_join(ranked, used.select("source", "tokens", "rate", "start", "cap", "goal"), ["source", "tokens"])
    low, high = F.col("start") + F.col("rate") * F.col("rank"), F.col("start") + F.col("rate") * (F.col("rank") + 1)
    copies = F.when(F.col("rate") == F.col("cap"), F.col("cap")).otherwise((F.floor(high) - F.floor(low)).cast("int"))
    rounded = cut(steps.select("doc_id", "source", "tokens", "cap", "goal", F.least(copies, F.col("cap")).alias("copies")))
    # one document of each source may still gain or lose a copy if that brings its tokens nearer to the goal
    gaps = rounded.groupBy("source").agg(F.first("goal").alias("goal"), F.sum(F.col("tokens") * F.col("copies")).alias("drawn"))
    gap = F.col("goal") - F.col("drawn")
    near = rounded.join(F.broadcast(cut(gaps.select("source", gap.alias("gap")))), "source").filter(((F.col("gap") > 0) & (F.col("copies") < F.col("cap"))) | ((F.col("gap") < 0) & (F.col("copies") > 0)))
    best = near.groupBy("source").agg(F.min(F.struct(F.abs(F.abs("gap") - F.col("tokens")).alias("left"), F.col("doc_id"), F.col("gap"))).alias("b"))
    best = best.filter(F.col("b.left") < F.abs("b.gap")).select("source", F.col("b.doc_id").alias("fix_id"), F.signum("b.gap").cast("int").alias("fix"))
    drawn = rounded.join(F.broadcast(cut(best)), "source", "left").select("doc_id", "source", "tokens", (F.col("copies") + F.when(F.col("doc_id") == F.col("fix_id"), F.col("fix")).otherwise(0)).alias("copies"))
    drawn = cut(drawn.filter("copies > 0"))
    sums = drawn.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("tokens_drawn"), F.sum("copies").cast("long").alias("documents_drawn"), F.max("copies").alias("most_copies"))
    total_drawn = sums.agg(F.sum("tokens_drawn")).first()[0] or 0
    there = lengths.filter("source IS NOT NULL").groupBy("source").agg(F.sum(F.col("tokens") * F.col("n")).alias("tokens_available"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    shares = listed.join(there, "source", "left").join(sums, "source", "left").select(
        "source",
        "target_share",
        "max_repeats",
        zero("tokens_available").cast("long").alias("tokens_available"),
        zero("documents_drawn").cast("long").alias("documents_drawn"),
        zero("most_copies").cast("int").alias("most_copies"),
        zero("tokens_drawn").cast("long").alias("tokens_drawn"),
        (zero("tokens_drawn") / F.lit(max(1, everything))).alias("share_of_corpus"),
        (zero("tokens_drawn") / F.lit(max(1, total_drawn))).alias("share_of_drawn"),
    )
    return drawn, shares
