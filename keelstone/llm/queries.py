"""Queries p6 to p8 over the corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelstone.llm.mixing import mix, source_key
from keelstone.llm.packing import pack
from keelstone.llm.textforms import digests_of, look_alikes, page_form, same_on_the_page, text_digests, unify_text
from keelstone.llm.tokens import DEFAULT_VOCABULARY, count_tokens
from keelstone.session import materialize


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Limits of p6_limits: loss-bearing tokens as a share of the capacity, and tokens of capacity per item.
BINDING = {"loss_share": 0.8, "tokens_per_segment": 96}


def speech_tokens(spark: SparkSession, sf_dir: str, vocabulary: str) -> DataFrame:
    """Tokens of every speech; those of procedure, which no speaker is printed for, and of remarks bear no loss."""
    documents = table(spark, sf_dir, "documents")
    spoken = F.trim(F.coalesce("speaker", F.lit(""))) != ""
    return materialize(count_tokens(documents.select("doc_id", "text", spoken.alias("spoken")), "text", vocabulary, "spoken"), "tokens")


def p6_pack(spark: SparkSession, sf_dir: str, vocabulary: str = DEFAULT_VOCABULARY, **limits) -> DataFrame:
    """Every speech placed in a container of every token budget."""
    return pack(spark, speech_tokens(spark, sf_dir, vocabulary), table(spark, sf_dir, "token_budget"), "doc_id", **limits)


def p6_fill(spark: SparkSession, sf_dir: str, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """Containers, tokens and unused share of every token budget."""
    placed = p6_pack(spark, sf_dir, vocabulary).where("container_id is not null")
    used = placed.groupBy("budget_name").agg(F.sum("tokens").alias("tokens"), F.countDistinct("container_id").alias("containers"))
    used = used.join(table(spark, sf_dir, "token_budget"), "budget_name")
    unused = 1 - F.col("tokens") / (F.col("containers") * F.col("capacity_tokens"))
    return used.select("budget_name", "capacity_tokens", "containers", "tokens", F.round(unused, 6).alias("unused_share"))


def containers(placed: DataFrame, budgets: DataFrame) -> DataFrame:
    """What each container of each budget holds."""
    used = placed.where("container_id is not null").groupBy("budget_name", "container_id")
    used = used.agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("items"), F.sum("loss_tokens").alias("loss_tokens"))
    return used.join(F.broadcast(budgets), "budget_name")  # a table of settings


def p6_limits(spark: SparkSession, sf_dir: str, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """Packing under three limits that all bind: how many containers each limit closed, and the unused space."""
    budgets = table(spark, sf_dir, "token_budget")
    used = containers(p6_pack(spark, sf_dir, vocabulary, **BINDING), budgets)
    near = 1 - 1 / 32
    loss_full = F.col("loss_tokens") >= F.floor(F.col("capacity_tokens") * BINDING["loss_share"]) * near
    seats_full = F.col("items") >= F.floor(F.col("capacity_tokens") / BINDING["tokens_per_segment"])
    tokens_full = F.col("tokens") >= F.col("capacity_tokens") * near
    share = 1 - F.sum("tokens") / F.sum("capacity_tokens")
    number = lambda c: F.sum(c.cast("long"))
    return used.groupBy("budget_name").agg(
        F.count(F.lit(1)).alias("containers"), number(tokens_full).alias("full_of_tokens"), number(seats_full & ~tokens_full).alias("full_of_items"),
        number(loss_full & ~tokens_full & ~seats_full).alias("full_of_loss"), F.round(share, 6).alias("unused_share"),
    )


def p6_checked(spark: SparkSession, sf_dir: str, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """What must hold of p6_pack under binding limits, counted: nothing over a limit, lost, doubled or split in vain."""
    budgets = table(spark, sf_dir, "token_budget")
    tokens = speech_tokens(spark, sf_dir, vocabulary)
    placed = materialize(pack(spark, tokens, budgets, "doc_id", **BINDING), "placed")
    loss, seats = F.floor(F.col("capacity_tokens") * BINDING["loss_share"]), F.floor(F.col("capacity_tokens") / BINDING["tokens_per_segment"])
    over = (F.col("tokens") > F.col("capacity_tokens")) | (F.col("items") > F.greatest(seats, F.lit(1))) | (F.col("loss_tokens") > F.greatest(loss, F.lit(1)))
    wrong = containers(placed, budgets).groupBy("budget_name").agg(F.sum(over.cast("long")).alias("over_limit"))
    whole = tokens.groupBy("doc_id").agg(F.sum("tokens").alias("t"), F.sum("loss_tokens").alias("l"))
    parts = placed.groupBy("budget_name", "doc_id").agg(
        F.sum("tokens").alias("pt"), F.sum("loss_tokens").alias("pl"), F.count(F.lit(1)).alias("pieces"), F.max(F.col("first_token") + F.col("tokens")).alias("end")
    )
    parts = parts.join(whole, "doc_id").join(F.broadcast(budgets), "budget_name")
    changed = (F.col("pt") != F.col("t")) | (F.col("pl") != F.col("l")) | (F.col("end") != F.col("t"))
    vain = (F.col("pieces") > 1) & (F.col("t") <= F.col("capacity_tokens")) & (F.col("l") <= loss)
    found = parts.groupBy("budget_name").agg(
        F.count(F.lit(1)).alias("documents"), F.sum(changed.cast("long")).alias("changed"), F.sum(vain.cast("long")).alias("split_in_vain")
    )
    return found.join(wrong, "budget_name").select("budget_name", "documents", "over_limit", "changed", "split_in_vain")


P6_CHECKED_SQL = """
select budget_name, n as documents, cast(0 as bigint) as over_limit, cast(0 as bigint) as changed, cast(0 as bigint) as split_in_vain
from token_budget, (select count(distinct doc_id) as n from documents) where n > 0
"""


def _mix(spark: SparkSession, sf_dir: str, vocabulary: str) -> tuple[DataFrame, DataFrame]:
    documents = table(spark, sf_dir, "documents").select("doc_id", "source", F.unhex(F.md5("text")).alias("digest"), "text")
    return mix(spark, count_tokens(documents, "text", vocabulary), table(spark, sf_dir, "mix_target"), "doc_id")


def p7_mix(spark: SparkSession, sf_dir: str, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """The speeches chosen for each chamber, with how often each appears."""
    return _mix(spark, sf_dir, vocabulary)[0]


def p7_shares(spark: SparkSession, sf_dir: str, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """Target and actual share of each chamber."""
    return _mix(spark, sf_dir, vocabulary)[1]


def p7_checked(spark: SparkSession, sf_dir: str, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """What must hold of p7_mix: one row per target, with the uses over its cap, of other texts and off its share (all 0).

    A share may be off by the longest speech of each target; shares of targets without any text go to the others.
    """
    chosen, report = _mix(spark, sf_dir, vocabulary)
    documents = table(spark, sf_dir, "documents")
    targets = source_key(table(spark, sf_dir, "mix_target").withColumn("target", F.col("source")), "source")
    uses = chosen.join(F.broadcast(targets.select("source", "max_repeats")), "source")
    sources = source_key(documents.where("text is not null and text <> ''").select("doc_id", "source"), "source").withColumn("_there", F.lit(True))
    uses = uses.join(sources, ["doc_id", "source"], "left")
    counted = uses.groupBy("source").agg(
        F.sum((F.col("repeats") > F.col("max_repeats")).cast("long")).alias("over_cap"), F.sum(F.col("_there").isNull().cast("long")).alias("of_others"),
        F.max("tokens").alias("longest"),
    )
    there = report.where("target_share > 0 and available_tokens > 0").agg(F.sum("target_share").alias("s"), F.sum("chosen_tokens").alias("n"))
    held = report.where("target_share > 0").crossJoin(F.broadcast(there)).join(F.broadcast(counted), "source", "left")  # one row; one per target
    slack = (F.coalesce("longest", F.lit(0)) * 2 + 64) / F.greatest("n", F.lit(1))
    wanted = F.when(F.col("available_tokens") > 0, F.col("target_share") / F.col("s")).otherwise(0)
    off = F.abs(F.col("actual_share") - wanted) > F.greatest(slack, F.lit(0.005))
    held = held.join(F.broadcast(targets.select("source", "target")), "source")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return held.select("target", zero(F.col("over_cap")).alias("over_cap"), zero(F.col("of_others")).alias("of_others"), zero(off.cast("long")).alias("off_share"))


P7_CHECKED_SQL = """
select source as target, cast(0 as bigint) as over_cap, cast(0 as bigint) as of_others, cast(0 as bigint) as off_share from mix_target
"""


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of speeches with different characters that read the same."""
    digests = materialize(text_digests(table(spark, sf_dir, "documents"), "doc_id", "text"), "digests")
    return same_on_the_page(digests).select(F.col("id_a").alias("doc_id_a"), F.col("id_b").alias("doc_id_b"))


def p8_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as classes: each text that reads like a different one, its smallest id, its copies and its class."""
    digests = materialize(text_digests(table(spark, sf_dir, "documents"), "doc_id", "text"), "digests")
    return look_alikes(digests).select(F.hex("as_seen").alias("class_id"), F.col("id").alias("doc_id"), "copies")


def p8_unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every speech with its text in comparison form."""
    return unify_text(table(spark, sf_dir, "documents").select("doc_id", "text"), "text")


def p8_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of p8_found, against the page forms of all texts: no speech missing, none too many, pairs in order."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text").where("doc_id is not null and text is not null")
    pages = digests_of(documents.select(F.col("doc_id").alias("id"), "text"), page_form, "page")
    pages = materialize(pages.select(F.col("id").alias("doc_id"), F.col("as_written").alias("written"), "page"), "pages")
    several = pages.groupBy("page").agg(F.countDistinct("written").alias("n")).where("n > 1").select("page")
    wanted = pages.join(several, "page", "left_semi").select("doc_id").distinct()
    found = materialize(p8_found(spark, sf_dir), "found")
    named = found.select(F.explode(F.array("doc_id_a", "doc_id_b")).alias("doc_id")).distinct()
    sides = [pages.select(F.col("doc_id").alias(f"doc_id_{x}"), F.col("written").alias(f"w_{x}"), F.col("page").alias(f"p_{x}")) for x in "ab"]
    both = found.join(sides[0], "doc_id_a").join(sides[1], "doc_id_b")
    wrong = both.where("doc_id_a >= doc_id_b or w_a = w_b or p_a <> p_b")
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    told = count(wanted.join(named, "doc_id", "left_anti"), "missing").crossJoin(count(named.join(wanted, "doc_id", "left_anti"), "too_many"))
    return told.crossJoin(count(wrong, "wrong_pairs")).crossJoin(count(documents, "documents").where("documents > 0"))  # one row each


P8_CHECKED_SQL = """
select cast(0 as bigint) as missing, cast(0 as bigint) as too_many, cast(0 as bigint) as wrong_pairs, count(*) as documents
from documents where doc_id is not null and text is not null having count(*) > 0
"""


QUERIES = {
    "p6_pack": p6_pack,
    "p6_fill": p6_fill,
    "p6_limits": p6_limits,
    "p6_checked": p6_checked,
    "p7_mix": p7_mix,
    "p7_shares": p7_shares,
    "p7_checked": p7_checked,
    "p8_found": p8_found,
    "p8_classes": p8_classes,
    "p8_checked": p8_checked,
    "p8_unified": p8_unified,
}
SQL: dict[str, str] = {"p6_checked": P6_CHECKED_SQL, "p7_checked": P7_CHECKED_SQL, "p8_checked": P8_CHECKED_SQL}
