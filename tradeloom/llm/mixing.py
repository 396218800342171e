"""Mixing sources to target weights along a time-varying curriculum.

Each source has a weight schedule over training time t in [0, 1].  Its integral is the source's
cumulative token demand; inverting that demand at the cumulative tokens of the source's texts
gives every copy of a text its training position, and the corpus is range-sorted by position.
"""

from __future__ import annotations

import base64
from collections.abc import Mapping, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from tradeloom.runtime import cut, small_side

#: Slices of a source for its running token sums; no slice is more than a small part of the source.
SLICES = 4096
#: Steps of training time in which weights are constant.
STEPS = 64
#: Targets are a fixed small set; more are refused rather than collected.
MAX_TARGETS = 10_000


@lru_cache(maxsize=4)
def _encoder(path: str):  # noqa: ANN202
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def default_tokenizer() -> str:
    """Path of the byte-level BPE vocabulary that is installed beside the library."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def count_tokens(text: str | Column, tokenizer: str | None = None) -> Column:
    """Tokens of a text under a public tokenizer's vocabulary file; 0 for null."""
    path = tokenizer or default_tokenizer()

    @F.pandas_udf(IntegerType())
    def count(texts: pd.Series) -> pd.Series:
        enc = _encoder(path)
        return texts.map(lambda t: len(enc.encode_ordinary(t)) if t else 0).astype("int32")

    return count(text)


def schedule(shares: Mapping[str, float], shapes: Mapping[str, Sequence[tuple[float, float]]] | None = None) -> dict[str, np.ndarray]:
    """Weight of each source in each of STEPS equal steps of training time.

    ``shapes`` gives (t, relative weight) points of a source, linear between them; sources without
    one are even.  Rows and columns are scaled in turn until the weights of a step sum to 1 and a
    source's mean weight is its share of all shares, so shapes bend the curriculum but not the mix.
    """
    names = sorted(s for s, w in shares.items() if w and w > 0)
    if not names:
        return {}
    middle = (np.arange(STEPS) + 0.5) / STEPS
    bent = {s: sorted(shapes[s]) for s in names if shapes and s in shapes}
    w = np.stack([np.interp(middle, *zip(*bent[s])) if s in bent else np.ones(STEPS) for s in names]).clip(1e-6)
    goal = np.array([shares[s] for s in names]) / sum(shares[s] for s in names)
    for _ in range(2000):
        w *= (goal / w.mean(axis=1))[:, None]
        off = np.abs(w.sum(axis=0) - 1).max()
        w /= w.sum(axis=0)
        if off < 1e-12:
            break
    return dict(zip(names, w))


def mixture(docs: DataFrame, targets: DataFrame, total_tokens: int | None = None, shapes: Mapping[str, Sequence[tuple[float, float]]] | None = None, tokenizer: str | None = None, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """The mixed corpus, and the shares it reaches.

    Corpus: ``docs`` columns plus ``n_tokens``, ``copy`` (from 0) and ``position`` in [0, 1), one
    row per use of a text, sorted by position.  Report: source, target_share, demand (tokens
    wanted), tokens, share_reached, copies (uses), texts.

    ``total_tokens`` defaults to all tokens of the targeted sources; ``shapes`` are those of
    ``schedule``.  A source takes its texts in a seeded order, pass after pass, until its demand
    is met (the last text may overshoot) or every text was used ``max_repeats`` times; what it
    cannot supply is not handed to others, and its uses are spread over its whole schedule.
    Sources without target are left out; targets without texts report zero.  Texts that are
    null or empty weigh nothing and are left out.  If a source stands in ``targets`` more than
    once, its largest target counts.  Rows with one key are texts of their own.  Texts are
    tokenised once; running sums go over narrow rows, and texts come back by key at the end.
    """
    clash = {"n_tokens", "copy", "position", "_h"} & set(docs.columns)
    if clash:
        raise ValueError(f"columns {sorted(clash)} exist already")
    goal = cut(targets.where("source IS NOT NULL").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats")))
    known = [r for r in goal.limit(MAX_TARGETS + 1).collect()]
    if len(known) > MAX_TARGETS:
        raise ValueError(f"more than {MAX_TARGETS} targets")
    plain = [F.col(f"`{c}`") for c, t in docs.dtypes if "map<" not in t and "variant" not in t]
    rows = docs.join(small_side(goal.select("source")), "source", "left_semi").where("text <> ''").withColumn("_h", F.xxhash64(F.lit(seed), *plain))
    sized = cut(rows.select("doc_id", "source", "_h", count_tokens("text", tokenizer).alias("n_tokens")).where("n_tokens > 0")).withColumn("_slice", F.pmod("_h", F.lit(SLICES)).cast("int"))

    # Running sums in two levels: slice totals (at most SLICES rows a target), then inside each slice.
    slices = cut(sized.groupBy("source", "_slice").agg(F.sum("n_tokens").alias("_tokens"), F.count(F.lit(1)).alias("_texts")))
    supply = slices.groupBy("source").agg(F.sum("_tokens").alias("supply"), F.sum("_texts").alias("texts"))
    plan = goal.join(supply, "source", "left").fillna(0, ["supply", "texts"])
    total = total_tokens if total_tokens is not None else (plan.agg(F.sum("supply")).first()[0] or 0)
    plan = plan.withColumn("demand", F.col("target_share") * F.lit(float(total))).withColumn("use", F.least("demand", F.col("supply").cast("double") * F.col("max_repeats")))
    plan = cut(plan)
    weights = schedule({r.source: r.target_share for r in known}, shapes)
    filled = docs.sparkSession.createDataFrame([(s, [0.0, *np.cumsum(w / w.sum()).tolist()]) for s, w in weights.items()], "source string, filled array<double>")
    before = slices.withColumn("_before", F.sum("_tokens").over(Window.partitionBy("source").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)))
    starts = before.select("source", "_slice", F.coalesce("_before", F.lit(0)).alias("_before"))

    inside = Window.partitionBy("source", "_slice").orderBy("_h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    at = sized.withColumn("_in", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(small_side(cut(starts)), ["source", "_slice"]).join(small_side(plan.select("source", "supply", "use")), "source")
    at = at.withColumn("_at", F.col("_before") + F.col("_in")).where(F.col("_at") < F.col("use"))
    passes = F.ceil((F.col("use") - F.col("_at")) / F.col("supply")).cast("int")
    used = at.withColumn("copy", F.explode(F.sequence(F.lit(0), passes - 1)))

    # The step whose part of the source's demand holds the text's share of it, and the place inside that step.
    share = (F.col("copy") * F.col("supply") + F.col("_at")) / F.col("use")
    placed = used.withColumn("_share", share).join(small_side(filled), "source")
    step = F.greatest(F.least(F.size(F.filter("filled", lambda x: x <= F.col("_share"))), F.lit(STEPS)), F.lit(1))
    placed = placed.withColumn("_step", step).withColumn("_low", F.expr("filled[_step - 1]")).withColumn("_high", F.expr("filled[_step]"))
    position = (F.col("_step") - 1 + F.least((F.col("_share") - F.col("_low")) / F.greatest(F.col("_high") - F.col("_low"), F.lit(1e-12)), F.lit(1 - 1e-9))) / STEPS
    uses = placed.select("doc_id", "_h", "n_tokens", "copy", position.alias("position"))
    corpus = rows.dropDuplicates(["doc_id", "_h"]).join(uses, ["doc_id", "_h"]).select(*[F.col(f"`{c}`") for c in docs.columns], "n_tokens", "copy", "position")

    one = used.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("copies"))
    reached = plan.join(one, "source", "left").fillna(0, ["tokens", "copies"])
    everything = Window.partitionBy(F.lit(0))  # one row per target
    report = reached.withColumn("share_reached", F.col("tokens") / F.greatest(F.sum("tokens").over(everything), F.lit(1))).select("source", "target_share", "max_repeats", "demand", "tokens", "share_reached", "copies", "texts")
    return corpus.orderBy("position", "doc_id", "copy"), report
