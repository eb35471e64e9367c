"""Mixing sources to target weights (problem 8): capped water-filling.

Each source may give its tokens at most ``max_repeats`` times. Sources whose share is above that are clamped, and
the excess goes to the others in proportion to their weights until every share is feasible. A source is then drawn
in whole repetitions of all its documents and one fraction: the documents first in a seeded hash order, up to the
tokens that are left, so the actual size stays within one document of the plan.

Documents of null or unnamed source, null id or no tokens are never drawn; repeated ids count once. A named source
without documents gets nothing. Null or negative shares count as 0, a null cap as 1; shares are scaled to a sum of 1.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Slices of the hash order of a source; only the slice in which the fraction ends is sorted.
SLICES = 4096


def water_fill(total: float, sources: list[tuple[str, float, float]]) -> dict[str, float]:
    """Tokens per source for (source, weight, most tokens): clamp those above their cap, share the rest by weight, repeat."""
    given, open_ = {}, {s: (w, cap) for s, w, cap in sources}
    left = total
    while open_:
        weight = sum(w for w, _ in open_.values())
        over = [s for s, (w, cap) in open_.items() if weight <= 0 or left * w / weight >= cap]
        if not over:
            return given | {s: left * w / weight for s, (w, _) in open_.items()}
        for s in over:
            w, cap = open_.pop(s)
            given[s] = cap if w > 0 else 0.0
            left -= given[s]
    return given


def plan(items: DataFrame, targets: DataFrame, *, total_tokens: int | None = None) -> DataFrame:
    """(source, target_share, max_repeats, documents, tokens, planned_tokens, whole, part_tokens): one row per named source.

    ``items`` has source and n_tokens. ``total_tokens`` defaults to the tokens of all named sources.
    The targets are a fixed table of at most a thousand sources; only they and their totals reach the driver.
    """
    named = targets.filter("source IS NOT NULL").groupBy("source").agg(F.max(F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0))).alias("share"), F.max(F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0))).alias("repeats"))
    rows = named.join(items.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum("n_tokens").alias("tokens")), "source", "left").limit(1001).collect()
    if len(rows) > 1000:
        raise ValueError("targets is meant as a short fixed list")
    whole = sum(r.share for r in rows) or 1.0
    total = sum(r.tokens or 0 for r in rows) if total_tokens is None else total_tokens
    give = water_fill(total, [(r.source, r.share / whole, (r.tokens or 0) * r.repeats) for r in rows])
    out = []
    for r in sorted(rows, key=lambda r: r.source):
        tokens, want = r.tokens or 0, int(give[r.source])
        times = want // tokens if tokens else 0
        out.append((r.source, r.share / whole, r.repeats, r.documents or 0, tokens, want, times, want - times * tokens))
    return items.sparkSession.createDataFrame(out, "source string, target_share double, max_repeats int, documents long, tokens long, planned_tokens long, whole long, part_tokens long")


def draw(items: DataFrame, planned: DataFrame, *, seed: int = 17) -> DataFrame:
    """(doc_id, source, n_tokens, repeats) of every document drawn at least once."""
    order = F.xxhash64(F.lit(seed), F.col("doc_id"))
    at = items.select("doc_id", "source", F.col("n_tokens").cast("long").alias("n_tokens")).withColumn("h", order).withColumn("slice", F.shiftrightunsigned("h", 52).cast("int"))
    at = at.join(F.broadcast(planned.select("source", "whole", "part_tokens")), "source")
    per = at.groupBy("source", "slice").agg(F.sum("n_tokens").alias("in_slice"))
    before = per.withColumn("before", F.sum("in_slice").over(W.partitionBy("source").orderBy("slice")) - F.col("in_slice")).drop("in_slice")
    at = at.join(before, ["source", "slice"])
    # Only the slice in which the fraction ends needs an order among its documents.
    ends = (F.col("before") < F.col("part_tokens")) & F.col("edge")
    sized = before.join(per, ["source", "slice"]).join(F.broadcast(planned.select("source", "part_tokens")), "source")
    edge = sized.filter("before < part_tokens AND before + in_slice > part_tokens").select("source", F.col("slice").alias("edge_slice"))
    at = at.join(F.broadcast(edge), "source", "left").withColumn("edge", F.coalesce(F.col("slice") == F.col("edge_slice"), F.lit(False)))
    inner = at.filter(~F.col("edge")).withColumn("drawn", (F.col("before") < F.col("part_tokens")).cast("long"))
    upto = F.col("before") + F.sum("n_tokens").over(W.partitionBy("source", "slice").orderBy("h", "doc_id"))
    last = at.filter(ends).withColumn("drawn", (upto <= F.col("part_tokens")).cast("long"))
    out = inner.unionByName(last).withColumn("repeats", F.col("whole") + F.col("drawn"))
    return out.filter("repeats > 0").select("doc_id", "source", "n_tokens", "repeats")


def shares(planned: DataFrame, drawn: DataFrame) -> DataFrame:
    """The plan of each named source beside its actual documents, tokens and share of the whole draw."""
    got = drawn.groupBy("source").agg(F.count(F.lit(1)).alias("drawn_documents"), F.sum(F.col("n_tokens") * F.col("repeats")).alias("drawn_tokens"), F.max("repeats").alias("most_repeats"))
    out = planned.join(got, "source", "left").fillna(0, ["drawn_documents", "drawn_tokens", "most_repeats"])
    total = got.agg(F.sum("drawn_tokens").alias("all_tokens"))
    out = out.join(F.broadcast(total))
    return out.select("source", "target_share", "max_repeats", "documents", "tokens", "planned_tokens", "drawn_documents", "drawn_tokens", "most_repeats", F.coalesce(F.col("drawn_tokens") / F.nullif("all_tokens", F.lit(0)), F.lit(0.0)).alias("actual_share"))
