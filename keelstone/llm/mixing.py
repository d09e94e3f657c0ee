"""Mixing sources to target weights: min-cost flow from membership patterns to source quotas."""

from __future__ import annotations

import heapq

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelstone.llm.textforms import unify_text
from keelstone.operators.skew import running_total
from keelstone.session import materialize

# the flow --------------------------------------------------------------------------------------------------------------


@dataclass
class Flow:
    """A small directed network with integer capacities and costs."""

    to: list[int] = field(default_factory=list)
    room: list[int] = field(default_factory=list)
    cost: list[int] = field(default_factory=list)
    out: dict[int, list[int]] = field(default_factory=dict)

    def arc(self, a: int, b: int, room: int, cost: int = 0) -> int:
        for x, y, r, c in ((a, b, room, cost), (b, a, 0, -cost)):
            self.out.setdefault(x, []).append(len(self.to))
            self.to.append(y)
            self.room.append(r)
            self.cost.append(c)
        return len(self.to) - 2

    def send(self, source: int, sink: int) -> int:
        """The largest flow at the least cost, by successive cheapest paths with node potentials."""
        potential: dict[int, int] = {}
        sent = 0
        while True:
            distance, via, queue = {source: 0}, {}, [(0, source)]
            while queue:
                d, node = heapq.heappop(queue)
                if d > distance[node]:
                    continue
                for e in self.out.get(node, ()):
                    if not self.room[e]:
                        continue
                    nxt = self.to[e]
                    total = d + self.cost[e] + potential.get(node, 0) - potential.get(nxt, 0)
                    if nxt not in distance or total < distance[nxt]:
                        distance[nxt], via[nxt] = total, e
                        heapq.heappush(queue, (total, nxt))
            if sink not in distance:
                return sent
            for node, d in distance.items():
                potential[node] = potential.get(node, 0) + d
            path, node = [], sink
            while node != source:
                path.append(via[node])
                node = self.to[via[node] ^ 1]
            push = min(self.room[e] for e in path)
            for e in path:
                self.room[e] -= push
                self.room[e ^ 1] += push
            sent += push


def route(
    supplies: dict[tuple[str, ...], int], targets: dict[str, tuple[float, int]], total: int | None = None
) -> tuple[int, dict[tuple[tuple[str, ...], str], int]]:
    """``(total, {(pattern, source): tokens})``.

    ``supplies`` gives the distinct tokens of each membership pattern, ``targets`` the share and the repetition cap of
    each source.  The r-th use of a pattern's tokens costs r - 1 a token (convex), so repetition is spread evenly and
    used last.  Without ``total`` it is the largest one for which every source that has any tokens meets its quota;
    a source without tokens cannot, and is left out.  A given ``total`` that is too large is filled as far as possible.
    """
    there = [s for s in targets if targets[s][0] > 0 and targets[s][1] > 0 and any(s in p and n for p, n in supplies.items())]
    patterns = [p for p, n in supplies.items() if n > 0 and any(s in there for s in p)]
    if not there or not patterns:
        return 0, {}

    def attempt(size: int) -> tuple[int, int, dict]:
        flow, source, sink = Flow(), 0, 1
        node = {p: 2 + i for i, p in enumerate(patterns)} | {s: 2 + len(patterns) + i for i, s in enumerate(there)}
        arcs = {}
        for p in patterns:
            members = [s for s in p if s in there]
            for repeat in range(max(targets[s][1] for s in members)):
                flow.arc(source, node[p], supplies[p], repeat)
            for s in members:
                arcs[p, s] = flow.arc(node[p], node[s], supplies[p] * targets[s][1])
        quotas = {s: int(targets[s][0] * size) for s in there}
        for s, quota in quotas.items():
            flow.arc(node[s], sink, quota)
        sent = flow.send(source, sink)
        return sent, sum(quotas.values()), {k: flow.room[e ^ 1] for k, e in arcs.items() if flow.room[e ^ 1]}

    if total is None:
        low, high = 0, int(sum(n * max(t[1] for t in targets.values()) for n in supplies.values()) / min(targets[s][0] for s in there)) + 1
        while high - low > 1:
            middle = (low + high) // 2
            sent, wanted, _ = attempt(middle)
            low, high = (middle, high) if sent == wanted else (low, middle)
        total = low
    return total, attempt(total)[2]


# the corpus ------------------------------------------------------------------------------------------------------------


def source_key(df: DataFrame, column: str) -> DataFrame:
    """``df`` with source names in comparison form, runs of blanks as one; null and blank names become null."""
    unified = unify_text(df, column)
    name = F.trim(F.regexp_replace(F.col(column), r"\s+", " "))
    return unified.withColumn(column, F.when(name != "", name))


def mix(
    spark: SparkSession,
    documents: DataFrame,
    targets: DataFrame,
    id_column: str,
    seed: int = 17,
    total: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Choose documents so that each source contributes its target share of the tokens.

    ``documents``: ``id_column, source, digest, tokens``, where equal digests are the same text and its sources are the
    membership pattern of that text.  ``targets``: ``source, target_share, max_repeats`` (a small table of settings);
    names are compared in one form (case, blanks and look-alike letters do not count); of several rows the first in
    order of name holds.  A text counts once however often it is printed, and is used at most ``max_repeats`` times for
    a source.

    Returns ``(chosen, report)``.  ``chosen``: ``<id>, source, repeats, tokens``, with the smallest id under which the
    source printed the text.  ``report``: ``source, target_share, actual_share, available_tokens, chosen_tokens,
    max_repeats`` for each source of either table; one without target, tokens or name takes no part, is reported with
    0 chosen tokens (a missing name as null), and the others keep their proportions.  Documents without tokens, text or
    id are never chosen.  No documents, or no targets, give no choice.

    The driver sees one row per membership pattern (a set of target sources, so their number is bounded by the
    targets, not by the corpus) and the targets.  Within a pattern the texts stand in a seeded order; an exact running
    total of their tokens, spread over many tasks, marks the texts of each quota.
    """
    wanted = source_key(targets.select("source", "target_share", "max_repeats"), "source").where("source is not null")
    settings: dict[str, tuple[float, int]] = {}
    for r in wanted.orderBy("source", "target_share", "max_repeats").collect():  # a table of settings
        settings.setdefault(r["source"], (float(r["target_share"] or 0), int(r["max_repeats"] or 0)))
    rows = source_key(documents.select(id_column, "source", "digest", "tokens"), "source")
    rows = materialize(rows.where(F.col(id_column).isNotNull() & F.col("digest").isNotNull() & (F.col("tokens") > 0)), "mix-rows")
    copies = rows.where(F.col("source").isin(list(settings)) if settings else F.lit(False))
    copies = copies.groupBy("digest", "source").agg(F.min(id_column).alias(id_column), F.max("tokens").alias("tokens"))
    texts = copies.groupBy("digest").agg(F.array_sort(F.collect_set("source")).alias("pattern"), F.max("tokens").alias("tokens"))
    texts = materialize(texts.withColumn("_order", F.xxhash64("digest", F.lit(seed))), "mix-texts")
    supplies = {tuple(r["pattern"]): r["n"] for r in texts.groupBy("pattern").agg(F.sum("tokens").alias("n")).collect()}
    total, flows = route(supplies, settings, total)

    spans, at = [], {}
    for (pattern, source), tokens in sorted(flows.items()):
        start = at.get(pattern, 0)
        at[pattern] = start + tokens
        spans.append((list(pattern), source, start, start + tokens, supplies[pattern]))
    schema = "pattern array<string>, source string, low long, high long, length long"
    intervals = spark.createDataFrame(spans, schema)  # at most patterns x targets rows
    placed = running_total(texts, ["pattern"], ["_order", "digest"], "tokens", "_upto")
    start = F.col("_upto") - F.col("tokens")
    # a text stands at start, start + length, start + 2 length, ... of its pattern's line; each place inside a source's
    # interval is one use by that source
    uses = F.ceil((F.col("high") - start) / F.col("length")) - F.ceil((F.col("low") - start) / F.col("length"))
    used = placed.join(F.broadcast(intervals), "pattern").withColumn("repeats", uses.cast("long")).where("repeats > 0")
    chosen = used.select("digest", "source", "repeats").join(copies, ["digest", "source"])
    chosen = materialize(chosen.select(id_column, "source", "repeats", "tokens"), "mix-chosen")

    available = rows.groupBy("source").agg(F.sum("tokens").alias("available_tokens"))
    taken = chosen.groupBy("source").agg(F.sum(F.col("repeats") * F.col("tokens")).alias("chosen_tokens"))
    everything = taken.agg(F.sum("chosen_tokens").alias("n")).first()["n"] or 0
    named = spark.createDataFrame([(s, *v) for s, v in settings.items()], "source string, target_share double, max_repeats int")
    named = named.select(F.struct("source").alias("_s"), "target_share", "max_repeats")
    report = available.select(F.struct("source").alias("_s"), "available_tokens").join(named, "_s", "full")
    report = report.join(taken.select(F.struct("source").alias("_s"), "chosen_tokens"), "_s", "left")
    chosen_tokens = F.coalesce("chosen_tokens", F.lit(0))
    report = report.select(
        F.col("_s.source").alias("source"), "target_share",
        F.round(chosen_tokens / F.lit(max(everything, 1)), 6).alias("actual_share"),
        F.coalesce("available_tokens", F.lit(0)).alias("available_tokens"), chosen_tokens.alias("chosen_tokens"), "max_repeats",
    )
    return chosen, report


