"""Question-context assembly for tables of queries and conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausespark.functions.text import estimate_tokens
from clausespark.tables import Scratch, running_total, stored

HISTORY_HEADER = "【历史对话】"
# Fixed values that results depend on: (least score, high score) by what re-ranked.
LEVELS = {"crossencoder": (0.5, 0.8), "vector": (0.3, 0.55), "none": (0.0, 2.0 / 3.0)}


def in_force(status: Column, allowed: list[str], include_invalid: bool = False) -> Column:
    return F.lit(True) if include_invalid else status.isNull() | (status == "") | status.isin(*allowed)


def dynamic_k(n: Column, ratio: float = 0.1, least: int = 10, most: int = 15) -> Column:
    k = F.least(F.greatest(F.ceil(n * ratio), F.lit(least)), F.lit(most))
    return F.when(n <= 0, 0).when(n < least, n).otherwise(k).cast("int")


def select_dynamic(ranked: DataFrame, key: str, order: list, ratio: float = 0.1, least: int = 10, most: int = 15) -> DataFrame:
    """The first rows of each key, as many as dynamic_k has it, with n and rank; a task keeps `most` of a key before it is dealt."""
    n = ranked.groupBy(F.col(key).alias("__key")).agg(F.count("*").alias("n"))
    first = ranked.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("rank") <= max(least, most))
    return first.join(n, F.col(key).eqNullSafe(F.col("__key"))).drop("__key").where(F.col("rank") <= dynamic_k(F.col("n"), ratio, least, most))


def tier(score: Column, high: float, least: float) -> Column:
    return F.when(score >= high, "high").when(score >= least, "low")


def fold_budget(items: Column, room: Column) -> Column:
    """(used, picked) of an array of items (..., id, cost): each is taken in turn if it fits into what is left of room."""

    def step(a: Column, x: Column) -> Column:
        fits = a["used"] + x["cost"] <= room
        return F.struct(F.when(fits, a["used"] + x["cost"]).otherwise(a["used"]).alias("used"), F.when(fits, F.concat(a["picked"], F.array(x))).otherwise(a["picked"]).alias("picked"))

    none = F.filter(items, lambda x: F.lit(False))
    return F.aggregate(items, F.struct(F.lit(0).cast("long").alias("used"), none.alias("picked")), step)


#: Items of a key that are folded in one row; beyond, rounds over ranges take what fits and leave out what no longer can.
FOLD = 10_000


def pack_budget(items: DataFrame, key: str, order: list[str], cost: str, budget: int, fold: int = FOLD) -> DataFrame:
    """(key, picked ids, used, dropped): items in order are taken while they fit; one over half the budget never is.

    An item that does not fit is passed over and later ones may still fit. While a key has over `fold` items, a round takes
    all items up to the first that does not fit, by running sums over ranges, and leaves out it and all that cost more
    than what is left; the few that remain are folded. Costs are not negative; items without a cost are dropped.
    """
    rows = items.select(F.struct(F.col(key).alias("k")).alias("key"), F.struct(*order, "id").alias("place"), F.col("id"), F.col(cost).cast("long").alias("cost"))
    total = rows.groupBy("key").agg(F.count("*").alias("n"))
    left = rows.where(F.col("cost") <= budget // 2).withColumn("room", F.lit(budget).cast("long"))
    scratch, taken = Scratch(), None
    while left.groupBy("key").count().where(F.col("count") > fold).limit(1).count():
        summed = scratch.stored(running_total(left, ["key"], ["place"], F.col("cost"), "sum"), "sums")
        now = summed.where("sum <= room").select("key", "place", "id", "cost")
        taken = now if taken is None else taken.union(now)
        spent = now.groupBy("key").agg(F.sum("cost").alias("spent"))
        first = summed.where("sum > room").groupBy("key").agg(F.min("place").alias("first"))
        later = summed.where("sum > room").join(first, "key").where("place > first").join(spent, "key", "left")
        left = later.withColumn("room", F.col("room") - F.coalesce("spent", F.lit(0))).where("cost <= room").select("key", "place", "id", "cost", "room")
        left = scratch.stored(left, "left-items")
    listed = left.groupBy("key").agg(F.first("room").alias("room"), F.array_sort(F.collect_list(F.struct("place", "id", "cost"))).alias("items"))
    rest = listed.select("key", F.explode(fold_budget(F.col("items"), F.col("room"))["picked"]).alias("x")).select("key", "x.place", "x.id", "x.cost")
    taken = rest if taken is None else taken.union(rest)
    ids = F.transform(F.array_sort(F.collect_list(F.struct("place", "id"))), lambda x: x["id"].cast("string"))
    picked = taken.groupBy("key").agg(F.array_join(ids, ",").alias("picked"), F.sum("cost").alias("used"), F.count("*").alias("taken"))
    out = total.join(picked, "key", "left").select(F.col("key.k").alias(key), F.coalesce("picked", F.lit("")).alias("picked"), F.coalesce("used", F.lit(0)).alias("used"), (F.col("n") - F.coalesce("taken", F.lit(0))).alias("dropped"))
    out = stored(out, "packed")
    scratch.clear()
    return out


def rank_scores(rank: Column, n: Column) -> Column:
    return (n - rank) / n


def with_ranks(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """rows with rank, their place in an order within their key, and n, the rows of the key; keys may have any number of rows."""
    n = rows.groupBy(F.col(key).alias("__key")).agg(F.count("*").alias("n"))
    return running_total(rows, [key], order, F.lit(1), "rank").join(n, F.col(key).eqNullSafe(F.col("__key"))).drop("__key")


def turns(messages: DataFrame, session: str = "conv_id", order: str = "turn") -> DataFrame:
    """(session, turn, question, answer): an answer belongs to the user row just before it among the non-blank ones.

    Roles other than user and assistant do not count; of several questions the last one is answered, of several answers
    the first is kept.
    """
    m = messages.where((F.trim(F.coalesce("text", F.lit(""))) != "") & F.col("role").isin("user", "assistant"))
    w = Window.partitionBy(session).orderBy(order)
    m = m.withColumns({"before": F.lag("role").over(w), "question": F.lag("text").over(w)})
    return m.where("role = 'assistant' and before = 'user'").select(session, F.col(order).alias("turn"), "question", F.col("text").alias("answer"))


def history(pairs: DataFrame, max_turns: int, budget: int, session: str = "conv_id") -> DataFrame:
    """(session, turns, history): the newest turns, oldest first, until one does not fit; the newest always does."""
    w = Window.partitionBy(session).orderBy(F.desc("turn"))
    cost = estimate_tokens("question") + estimate_tokens("answer")
    p = pairs.withColumns({"age": F.row_number().over(w), "cost": cost}).where(F.col("age") <= max_turns)
    p = p.withColumn("used", F.sum("cost").over(w) + (len(HISTORY_HEADER) + 1) // 2).where((F.col("age") == 1) | (F.col("used") <= budget))
    block = F.concat(F.lit("用户："), "question", F.lit("\n助手："), "answer")
    listed = F.array_sort(F.collect_list(F.struct("turn", block.alias("b"))))
    return p.groupBy(session).agg(F.count("*").alias("turns"), F.concat(F.lit(HISTORY_HEADER + "\n"), F.array_join(F.transform(listed, lambda x: x["b"]), "\n\n")).alias("history"))


def sources(picked: DataFrame, key: str, order: str) -> DataFrame:
    """(key, code, clause_no, place): distinct sources in the order picked, blank ones left out."""
    return picked.where("code <> '' and clause_no <> ''").groupBy(key, "code", "clause_no").agg(F.min(order).alias("place"))


def sessions(messages: DataFrame, session: str = "conv_id") -> DataFrame:
    """(session, messages, title, last): title is the start of the first question."""
    first = F.min_by(F.when(F.col("role") == "user", F.substring(F.trim("text"), 1, 20)), F.when(F.col("role") == "user", F.col("turn")))
    return messages.groupBy(session).agg(F.count("text").alias("messages"), first.alias("title"), F.max("turn").alias("last"))


def search_messages(messages: DataFrame, keyword: str, limit: int = 100) -> DataFrame:
    return messages.where(F.contains("text", F.lit(keyword))).orderBy(F.desc("conv_id"), F.desc("turn")).limit(limit)


def prompt_inputs(clauses: DataFrame, batch: str, order: str) -> DataFrame:
    """(batch, lines): numbered lines of the first 200 characters of each clause."""
    line = F.struct(order, F.substring(F.trim("content"), 1, 200).alias("t"))
    listed = F.array_sort(F.collect_list(line))
    return clauses.groupBy(batch).agg(F.array_join(F.transform(listed, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x["t"])), "\n").alias("lines"))


def export_conversation(messages: DataFrame, session: str = "conv_id", order: str = "turn") -> DataFrame:
    """(session, markdown) of the non-blank user and assistant rows."""
    m = messages.where((F.trim(F.coalesce("text", F.lit(""))) != "") & F.col("role").isin("user", "assistant"))
    part = F.concat(F.when(F.col("role") == "user", "## 问\n\n").otherwise("## 答\n\n"), F.trim("text"))
    listed = F.array_sort(F.collect_list(F.struct(order, part.alias("p"))))
    return m.groupBy(session).agg(F.array_join(F.transform(listed, lambda x: x["p"]), "\n\n").alias("markdown"))


def filtered_out(found: DataFrame, kept: Column, key: str = "query_id", least: int = 3) -> DataFrame:
    """(key, hits, global_total): results that pass the filter, and how many there are without it where fewer than `least` pass."""
    n = found.groupBy(key).agg(F.count("*").alias("total"), F.count_if(kept).alias("hits"))
    return n.select(key, "hits", F.when(F.col("hits") < least, F.col("total")).alias("global_total"))


def stage_trace(items: DataFrame, key: str, high: float, least: float, budget: int, ratio: float = 0.1, fewest: int = 10, most: int = 15) -> DataFrame:
    """One row for each key: counts after each stage, tokens, budget and what was dropped.

    items: key, score, rank (among the key's items), tokens and in_force. rrf_total: all; after_meta: in force;
    after_threshold: of those with a score of `least` or more; select_target: the dynamic k of these; high_count and
    low_count: the selected by tier; context_tokens: what the selected take that packing has room for, high ones first and
    then by rank; dropped_overflow: the selected that it leaves out.
    """
    ok, over = F.col("in_force"), F.col("score") >= least
    n = items.groupBy(key).agg(F.count("*").alias("rrf_total"), F.count_if(ok).alias("after_meta"), F.count_if(ok & over).alias("after_threshold"))
    n = n.withColumn("select_target", dynamic_k(F.col("after_threshold"), ratio, fewest, most))
    nth = F.row_number().over(Window.partitionBy(key).orderBy("rank"))
    picked = items.where(ok & over).withColumn("nth", nth).where(F.col("nth") <= most).join(n.select(key, "select_target"), key).where("nth <= select_target")
    high_tier = F.col("score") >= high
    # at most `most` items of a key
    listed = F.array_sort(F.collect_list(F.when(F.col("tokens") <= budget // 2, F.struct((~high_tier).alias("late"), "rank", F.col("tokens").cast("long").alias("cost")))))
    t = picked.groupBy(key).agg(F.count_if(high_tier).alias("high_count"), F.count_if(~high_tier).alias("low_count"), F.count("*").alias("chosen"), listed.alias("items"))
    t = t.withColumn("p", fold_budget(F.col("items"), F.lit(budget))).select(key, "high_count", "low_count", (F.col("chosen") - F.size("p.picked")).alias("dropped_overflow"), F.col("p.used").alias("context_tokens"))
    out = n.join(t, key, "left").fillna(0, ["high_count", "low_count", "dropped_overflow", "context_tokens"])
    return out.withColumns({"budget": F.lit(budget), "context_empty": F.col("context_tokens") == 0})
