"""Weighted-rule classification and its review workflow; edits are jobs from tables to new tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausespark.operators.patterns import containing, counted, occurrences, plain_piece
from clausespark.operators.retrieval import keywords
from clausespark.tables import running_total

# Fixed values that results depend on.
THRESHOLDS = {"dim1": 0.3, "dim2": 0.5, "dim3": 0.5, "dim4": 0.6, "dim5": 0.7, "dim6": 0.6}
ADOPT, TOP_WORDS = 0.7, 3


def java_pattern(pattern: Column) -> Column:
    """A pattern as Java has it, null if it is none; names of groups are the one difference that rules meet."""
    p = F.regexp_replace(pattern, r"\(\?P<", "(?<")
    return F.when(F.try_reflect(F.lit("java.util.regex.Pattern"), F.lit("compile"), p).isNotNull(), p)


def keyword_score(found: Column, priority: Column) -> Column:
    return F.when(found > 0, F.least(F.lit(1.0), 0.3 + found * 0.15) * (1 + 0.1 * priority)).otherwise(0.0)


def rule_score(text: Column, pattern: Column, kind: Column, priority: Column) -> Column:
    """What a rule scores on a text: by occurrences (keyword), covered share (regex) or equality (exact); nulls score null.

    Patterns of regex rules are valid ones.
    """
    boost = 1 + 0.1 * priority
    keyword = keyword_score(occurrences(text, pattern), priority)
    covered = F.aggregate(F.regexp_extract_all(text, pattern, F.lit(0)), F.lit(0), lambda n, x: n + F.length(x))
    share = F.when(text.isNotNull(), F.least(F.lit(1.0), covered / F.greatest(F.length(text), F.lit(1)) * 2) * boost)
    return F.when(kind == "exact", F.when(pattern == F.trim(text), boost).otherwise(0.0)).when(kind == "regex", share).otherwise(keyword)


def scores(clauses: DataFrame, rules: DataFrame) -> DataFrame:
    """(id, rule_id, dimension, score, found, ...) of every active rule on every clause (id, content) where it is above 0.

    found counts the occurrences of a keyword; it is null for other rules. Texts are not carried along.

    Keywords, and regexes of which every match holds a known piece, meet clauses through pieces of texts; the other regexes,
    which nothing but a try can tell, are one row that each clause gets. Patterns that are none score nothing.
    """
    r = rules.where("is_active = 1")
    c = clauses.select("id", "content")
    columns = ["id", *rules.columns, "score"]
    words = r.where("match_type not in ('regex', 'exact')")
    word = counted(c, "id", "content", words).join(words, "pattern")
    word = word.withColumn("score", keyword_score(F.col("found"), F.col("priority"))).where("score > 0").select(*columns, "found")
    good = r.where("match_type = 'regex'").withColumn("java", java_pattern(F.col("pattern"))).where("java is not null").withColumn("piece", plain_piece(F.col("java")))
    by_piece = containing(c, "id", "content", good.select(F.col("piece").alias("pattern"))).withColumnRenamed("pattern", "piece").join(good, "piece")
    loose = good.where("piece = ''").agg(F.collect_list(F.struct(*good.columns)).alias("all"))
    anywhere = c.withColumn("one", F.lit(1)).join(F.broadcast(loose.withColumn("one", F.lit(1))), "one").select("id", "content", F.explode("all").alias("r")).select("id", "content", "r.*")
    both = by_piece.select("id", "content", *good.columns).union(anywhere.select("id", "content", *good.columns))
    share = rule_score(F.col("content"), F.col("java"), F.lit("regex"), F.col("priority"))
    regex = both.withColumn("score", share).where("score > 0")
    exact = c.join(r.where("match_type = 'exact'"), F.trim("content") == F.col("pattern"))
    exact = exact.withColumn("score", rule_score(F.col("content"), F.col("pattern"), F.lit("exact"), F.col("priority"))).where("score > 0")
    return word.unionByName(regex.select(*columns).union(exact.select(*columns)), allowMissingColumns=True)


def classify(clauses: DataFrame, rules: DataFrame) -> DataFrame:
    """(id, dimension, score, label, rule_id): the best rule of each dimension that reaches its own threshold, the earliest of equals."""
    s = scores(clauses.select("id", "content"), rules.withColumnRenamed("id", "rule_id")).where("score >= threshold")
    best = F.max_by(F.struct("score", F.coalesce("label", "pattern").alias("label"), "rule_id"), F.struct("score", -F.col("rule_id")))
    return s.groupBy("id", "dimension").agg(best.alias("b")).select("id", "dimension", "b.*")


def gate(dimension: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in THRESHOLDS.items() for x in kv]), dimension), F.lit(0.6))


def needs_ai(best: DataFrame) -> DataFrame:
    return best.withColumn("needs_ai", F.col("score") < gate(F.col("dimension")))


def accumulate_hits(rules: DataFrame, best: DataFrame, reset: bool = False) -> DataFrame:
    """rules with a hit for every clause they won, and a confirmation where the score reaches the gate."""
    won = best.groupBy("rule_id").agg(F.count("*").alias("h"), F.count_if(F.col("score") >= gate(F.col("dimension"))).alias("c"))
    j = rules.join(won, rules.id == won.rule_id, "left")
    base = lambda c: F.lit(0) if reset else F.coalesce(F.col(c), F.lit(0))
    return j.select("id", (base("hit_count") + F.coalesce("h", F.lit(0))).cast("long").alias("hit_count"), (base("confirmed") + F.coalesce("c", F.lit(0))).cast("long").alias("confirmed"))


def enqueue(wanted: DataFrame, clauses: DataFrame, queue: DataFrame) -> DataFrame:
    """(clause_id, dimension, keyword_score) to queue: known clauses that are no notes, of specs in force, not queued before."""
    ok = clauses.where((F.col("clause_is_non") == 0) & (F.coalesce("status", F.lit("")) != "废止")).select("clause_id")
    w = wanted.join(ok, "clause_id", "left_semi").join(queue, ["clause_id", "dimension"], "left_anti")
    return w.groupBy("clause_id", "dimension").agg(F.min("keyword_score").alias("keyword_score"))


def draw_batches(queue: DataFrame, size: int, force: bool = False) -> DataFrame:
    """(id, dimension, batch): pending rows of each dimension, oldest first, in batches; a last short one only if forced.

    A dimension may have any number of rows: places come from running counts over ranges.
    """
    q = queue.where("status = 'pending'").select("id", "dimension", "created_at")
    n = q.groupBy("dimension").agg(F.count("*").alias("n"))
    q = running_total(q, ["dimension"], ["created_at", "id"], F.lit(1), "place").withColumn("batch", F.ceil(F.col("place") / size).cast("int")).join(n, "dimension")
    return q.where(F.lit(force) | (F.col("batch") * size <= F.col("n"))).select("id", "dimension", "batch")


def key_states(keys: DataFrame, pending: DataFrame, rules: DataFrame) -> DataFrame:
    """keys (dimension, pattern, label) with state: rejected, approved (by a word or a confirmed active rule) or none."""
    p = pending.groupBy("dimension", "pattern", "label").agg(F.max(F.when(F.col("status") == "rejected", 2).when(F.col("status") == "approved", 1).otherwise(0)).alias("s"))
    r = rules.where("confirmed > 0 and is_active = 1").groupBy("dimension", "pattern").agg(F.bool_or(F.col("label").isNull()).alias("any_label"), F.collect_set("label").alias("labels"))
    j = keys.join(p, ["dimension", "pattern", "label"], "left").join(r, ["dimension", "pattern"], "left")
    by_rule = F.coalesce(F.col("any_label"), F.lit(False)) | F.coalesce(F.array_contains("labels", F.col("label")), F.lit(False))
    return j.select(*keys.columns, F.when(F.col("s") == 2, "rejected").when((F.col("s") == 1) | by_rule, "approved").otherwise("none").alias("state"))


def insert_pending(new: DataFrame, pending: DataFrame) -> DataFrame:
    """The rows of new whose (clause_id or null, dimension, pattern, label) is not there in any status, once each."""
    cols = ["clause_id", "dimension", "pattern", "label"]
    p = pending.select(*[F.col(c).alias(f"p_{c}") for c in cols])
    same = [F.col(c).eqNullSafe(F.col(f"p_{c}")) for c in cols]
    return new.select(*cols).distinct().join(p, same, "left_anti")


def adjudicate(results: DataFrame, keys: DataFrame, states: DataFrame) -> DataFrame:
    """(clause_id, dimension, ai_label, outcome): sure results are adopted with an approved word or without words, others go to review."""
    s = keys.join(states, ["dimension", "pattern", "label"], "left").groupBy("clause_id", "dimension").agg(F.bool_or(F.col("state") == "approved").alias("approved"))
    j = results.join(s, ["clause_id", "dimension"], "left")
    outcome = F.when((F.col("ai_confidence") >= ADOPT) & F.coalesce("approved", F.lit(True)), "auto_adopted").otherwise("review")
    return j.select("clause_id", "dimension", "ai_label", outcome.alias("outcome"))


def adjudicate_batch(results: DataFrame, contents: DataFrame, pending: DataFrame, rules: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(outcomes, new pending rows, bumps) of results (clause_id, dimension, ai_label, ai_confidence) on contents (clause_id, content).

    The TOP_WORDS keywords of a sure result's text are looked up: unknown ones become pending words, approved ones let the
    label be adopted and are bumped. A sure result without words is adopted; the rest goes to review.
    """
    sure = results.where(F.col("ai_confidence") >= ADOPT).where("dimension <> ''")
    words = keywords(contents.join(sure, "clause_id", "left_semi"), "clause_id", "content", TOP_WORDS).select("clause_id", F.col("token").alias("pattern"))
    keys = sure.select("clause_id", "dimension", F.col("ai_label").alias("label")).join(words, "clause_id").distinct()
    states = key_states(keys.select("dimension", "pattern", "label").distinct(), pending, rules)
    known = keys.join(states, ["dimension", "pattern", "label"])
    outcomes = adjudicate(results.withColumn("ai_confidence", F.when(F.col("dimension") == "", 0.0).otherwise(F.col("ai_confidence"))), keys, states)
    fresh = insert_pending(known.where("state = 'none'").select("clause_id", "dimension", "pattern", "label"), pending)
    adopted = known.where("state = 'approved'").join(outcomes.where("outcome = 'auto_adopted'"), ["clause_id", "dimension"], "left_semi")
    return outcomes, fresh, adopted.select("dimension", "pattern", "label", F.lit(False).alias("human"))


def decide_words(pending: DataFrame, chosen: DataFrame, action: str) -> DataFrame:
    """(id, status): pending rows after approving or rejecting the keys of the chosen ids.

    Approving a key rejects the other labels of its (dimension, pattern); rejecting one approves them.
    """
    keys = pending.join(chosen, "id", "left_semi").select("dimension", "pattern", "label").distinct()
    words = keys.select("dimension", "pattern").distinct().withColumn("word", F.lit(True))
    j = pending.join(keys.withColumn("key", F.lit(True)), ["dimension", "pattern", "label"], "left").join(words, ["dimension", "pattern"], "left")
    yes, no = ("approved", "rejected") if action == "approve" else ("rejected", "approved")
    return j.select("id", F.when(F.col("status") != "pending", F.col("status")).when(F.col("key"), yes).when(F.col("word"), no).otherwise(F.col("status")).alias("status"))


def backfill(pending: DataFrame, queue: DataFrame, keys: DataFrame) -> DataFrame:
    """(clause_id, dimension, label): labels for clauses of approved keys whose queue row is in review, the smallest of several."""
    p = pending.join(keys, ["dimension", "pattern", "label"], "left_semi").where("clause_id is not null")
    return p.join(queue.where("status = 'review'"), ["clause_id", "dimension"], "left_semi").groupBy("clause_id", "dimension").agg(F.min("label").alias("label"))


def decide_queue(queue: DataFrame, decisions: DataFrame) -> DataFrame:
    """(id, status, label): confirm takes effect on review rows, reject always; other rows stay."""
    j = queue.join(decisions.select(F.col("id"), F.col("action"), F.col("label").alias("new_label")), "id", "left")
    confirmed = (F.col("action") == "confirm") & (F.col("status") == "review")
    status = F.when(confirmed, "done").when(F.col("action") == "reject", "rejected").otherwise(F.col("status"))
    return j.select("id", status.alias("status"), F.when(confirmed, F.col("new_label")).when(F.col("action") == "reject", None).otherwise(F.col("ai_label")).alias("label"))


def decide_clauses(pending: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, status) after decisions (clause_id, dimension, label, ticked ids), and the decisions outside any pending row."""
    j = pending.join(decisions, ["clause_id", "dimension"], "inner").where("status = 'pending'")
    mine = F.array_contains("ticked", F.col("id")) & (F.col("label") == F.col("new_label"))
    outside = decisions.join(pending.where("status = 'pending'"), ["clause_id", "dimension"], "left_anti")
    return j.select("id", F.when(mine, "approved").otherwise("rejected").alias("status")), outside


def bump_rules(rules: DataFrame, bumps: DataFrame) -> DataFrame:
    """rules after bumps (dimension, pattern, label, human): counts, blank labels filled, switched by their ratio; new keys added.

    A batch is judged once, at its end.
    """
    b = bumps.groupBy("dimension", "pattern").agg(F.count("*").alias("h"), F.count_if("human").alias("c"), F.min("label").alias("new_label"))
    j = rules.join(b, ["dimension", "pattern"], "full")
    hit = F.coalesce("hit_count", F.lit(0)) + F.coalesce("h", F.lit(0))
    sure = F.coalesce("confirmed", F.lit(0)) + F.coalesce("c", F.lit(0))
    ratio = sure / F.greatest(hit, F.lit(1))
    free = F.coalesce("locked", F.lit(0)) == 0
    active = F.when(F.col("id").isNull(), 0).when(F.col("h").isNull() | ~free, F.col("is_active")).when((ratio >= 0.8) & (hit >= 5), 1).when((sure > 0) & (ratio < 0.3) & (hit > 10), 0).otherwise(F.col("is_active"))
    label = F.when(free, F.coalesce("label", "new_label")).otherwise(F.col("label"))
    return j.select("dimension", "pattern", hit.cast("long").alias("hit_count"), sure.cast("long").alias("confirmed"), active.alias("is_active"), label.alias("label"), F.coalesce("threshold", F.lit(0.6)).alias("threshold"))


def switch_rules(rules: DataFrame, rejected: DataFrame, approved: DataFrame) -> DataFrame:
    """(id, is_active): unconfirmed rules of rejected words go off, confirmed ones of approved words on."""
    j = rules.join(rejected.select("dimension", "pattern").distinct().withColumn("no", F.lit(True)), ["dimension", "pattern"], "left").join(approved.select("dimension", "pattern").distinct().withColumn("yes", F.lit(True)), ["dimension", "pattern"], "left")
    return j.select("id", F.when(F.col("no") & (F.col("confirmed") == 0), 0).when(F.col("yes") & (F.col("confirmed") > 0), 1).otherwise(F.col("is_active")).alias("is_active"))


def word_groups(pending: DataFrame) -> DataFrame:
    """(dimension, pattern, clauses, confidence, labels) of pending words, labels with counts."""
    p = pending.where("status = 'pending'")
    by_label = p.groupBy("dimension", "pattern", "label").agg(F.count("*").alias("n"))
    labels = by_label.groupBy("dimension", "pattern").agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", "label", "n"))), ",").alias("labels"))
    g = p.groupBy("dimension", "pattern").agg(F.count_distinct("clause_id").alias("clauses"), F.round(F.avg("ai_confidence"), 3).alias("confidence"))
    return g.join(labels, ["dimension", "pattern"])


def clause_groups(pending: DataFrame, queue: DataFrame, status: str = "pending") -> DataFrame:
    """(dimension, clause_id, n, words): words in status of clauses with a row in review; for rejected, those without pending words."""
    p = pending.where(F.col("status") == status)
    if status == "rejected":
        p = p.join(pending.where("status = 'pending'"), ["clause_id", "dimension"], "left_anti")
    p = p.join(queue.where("status = 'review'"), ["clause_id", "dimension"], "left_semi")
    return p.groupBy("dimension", "clause_id").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_set("pattern")), ",").alias("words"))


def fallback_items(pending: DataFrame, queue: DataFrame) -> DataFrame:
    """Rows in review without pending or rejected words."""
    return queue.where("status = 'review'").join(pending.where("status in ('pending', 'rejected')"), ["clause_id", "dimension"], "left_anti").select("id", "clause_id", "dimension", "created_at")


def pending_counts(pending: DataFrame, queue: DataFrame) -> DataFrame:
    n = lambda df, kind: df.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
    clause = clause_groups(pending, queue).select("clause_id").unionAll(clause_groups(pending, queue, "rejected").select("clause_id")).unionAll(fallback_items(pending, queue).select("clause_id"))
    return n(clause, "clause").union(n(word_groups(pending), "word"))


def blacklist(pending: DataFrame) -> DataFrame:
    return pending.where("status = 'rejected'").groupBy("dimension", "pattern", "label").agg(F.count("*").alias("n"), F.count_distinct("clause_id").alias("clauses"), F.max("created_at").alias("last"), F.min("id").alias("id"))


def restore_words(pending: DataFrame, ids: DataFrame, status: str) -> DataFrame:
    """(id, status): rejected rows of the keys of ids take the new status."""
    keys = pending.join(ids, "id", "left_semi").select("dimension", "pattern", "label").distinct().withColumn("key", F.lit(True))
    j = pending.join(keys, ["dimension", "pattern", "label"], "left")
    return j.select("id", F.when(F.col("key") & (F.col("status") == "rejected"), status).otherwise(F.col("status")).alias("status"))


def label_candidates(rules: DataFrame, used: DataFrame, limit: int = 40) -> DataFrame:
    """(dimension, label, rank): labels of active rules by priority and hits, then labels in use; comma lists split."""
    a = rules.where("is_active = 1").select("dimension", F.coalesce("label", "pattern").alias("v"), F.lit(0).alias("o"), (-F.col("priority")).alias("x"), (-F.col("hit_count")).cast("long").alias("y"), "id")
    b = used.select("dimension", F.col("label").alias("v"), F.lit(1).alias("o"), F.lit(0).alias("x"), F.lit(0).cast("long").alias("y"), F.lit(0).cast("long").alias("id"))
    s = a.unionByName(b).select("dimension", F.posexplode(F.split("v", ",", -1)).alias("p", "label"), F.struct("o", "x", "y", "id").alias("order")).withColumn("label", F.trim("label")).where("label <> ''")
    first = s.groupBy("dimension", "label").agg(F.min(F.struct("order", "p")).alias("first"))
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("dimension").orderBy("first", "label"))).where(F.col("rank") <= limit).select("dimension", "label", "rank")


def pending_statistics(pending: DataFrame) -> DataFrame:
    p = pending.where("status = 'pending'")
    return p.groupingSets([[], [F.col("dimension")]], F.col("dimension")).agg(F.count("*").alias("n"), F.count_distinct("clause_id").alias("clauses"))


def queue_matrix(queue: DataFrame, statuses: list[str]) -> DataFrame:
    m = queue.groupBy("dimension").pivot("status", statuses).agg(F.count("id"))
    m = m.select("dimension", *[F.coalesce(F.col(s), F.lit(0)).alias(s) for s in statuses])
    return m.withColumn("total", sum((F.col(s) for s in statuses), F.lit(0)))


def rule_statistics(rules: DataFrame) -> DataFrame:
    label = F.coalesce("label", F.lit(""))
    return rules.groupBy("dimension", label.alias("label")).agg(F.count("*").alias("n"), F.count_if(F.col("is_active") == 1).alias("active"), F.sum("hit_count").alias("hits"), F.count_distinct("sub_field").alias("sub_fields"))


def rule_quality(rules: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """(kind, id): rules to switch on, to switch off, and without a hit for long."""
    ratio = F.col("confirmed") / F.greatest(F.col("hit_count"), F.lit(1))
    on = rules.where((F.col("is_active") == 0) & (ratio >= 0.8) & (F.col("hit_count") >= 5)).select(F.lit("suggest_enable").alias("kind"), "id")
    off = rules.where((F.col("is_active") == 1) & (F.col("confirmed") > 0) & (ratio < 0.3) & (F.col("hit_count") > 10)).select(F.lit("suggest_disable"), "id")
    old = F.col("created_at") < F.lit(as_of).cast("timestamp_ntz") - F.expr(f"interval {days} days")
    zombie = rules.where((F.col("hit_count") == 0) & (F.coalesce("locked", F.lit(0)) == 0) & old).select(F.lit("zombie"), "id")
    return on.union(off).union(zombie)


def quality_action(rules: DataFrame, report: DataFrame, kind: str, action: str) -> DataFrame:
    """rules after enabling, disabling or deleting all of a kind."""
    hit = report.where(F.col("kind") == kind).select("id")
    if action == "delete":
        return rules.join(hit, "id", "left_anti")
    j = rules.join(hit.withColumn("hit", F.lit(True)), "id", "left")
    return j.withColumn("is_active", F.when(F.col("hit"), int(action == "enable")).otherwise(F.col("is_active"))).drop("hit")


def resolve_duplicate_rules(rules: DataFrame) -> DataFrame:
    """One rule of each (dimension, pattern): labelled before others, then the most hits and confirmations, then the first; counts add up."""
    w = Window.partitionBy("dimension", "pattern")
    order = w.orderBy(F.col("label").isNull().cast("int"), F.desc(F.col("hit_count") + F.col("confirmed")), "id")
    r = rules.withColumns({"rn": F.row_number().over(order), "hits": F.sum("hit_count").over(w), "sure": F.sum("confirmed").over(w)})
    return r.where("rn = 1").select("id", "dimension", "pattern", F.col("hits").alias("hit_count"), F.col("sure").alias("confirmed"))


def orphan_labels(labelled: DataFrame, rules: DataFrame) -> DataFrame:
    """(clause_id, dimension, label) without an active rule for the label."""
    known = rules.where("is_active = 1").select("dimension", F.coalesce("label", "pattern").alias("label")).distinct()
    return labelled.where("label is not null and label <> ''").join(known, ["dimension", "label"], "left_anti").select("clause_id", "dimension", "label")


def disable_unconfirmed(rules: DataFrame) -> DataFrame:
    off = (F.col("confirmed") == 0) & (F.coalesce("locked", F.lit(0)) == 0)
    return rules.select("id", F.when(off, 0).otherwise(F.col("is_active")).alias("is_active"))


def fragments_to_review(rules: DataFrame, pending: DataFrame) -> DataFrame:
    """Unconfirmed active unlocked rules as new pending words without a clause."""
    r = rules.where("confirmed = 0 and is_active = 1 and coalesce(locked, 0) = 0")
    return insert_pending(r.select(F.lit(None).cast("long").alias("clause_id"), "dimension", "pattern", F.coalesce("label", "pattern").alias("label")), pending)


def reclassify(clauses: DataFrame, specs: DataFrame, dims: list[str], only_unclassified: bool) -> DataFrame:
    """(clause_id, dimension) to queue anew for the clauses of some specs."""
    c = clauses.join(specs, "spec", "left_semi")
    if only_unclassified:
        c = c.where("coalesce(label, '') = ''")
    return c.select("clause_id", F.explode(F.array(*map(F.lit, dims))).alias("dimension"))


def threshold_what_if(clauses: DataFrame, rules: DataFrame, per_hit: float = 0.25) -> DataFrame:
    """(dimension, none, below, passes, other_passes) of clauses by their best score, and by a formula with per_hit for each occurrence."""
    s = scores(clauses.select("id", "content"), rules.withColumnRenamed("id", "rule_id"))
    other = F.when(F.col("match_type") == "keyword", F.least(F.lit(1.0), 0.3 + per_hit * F.col("found")) * (1 + 0.1 * F.col("priority"))).otherwise(F.col("score"))
    best = s.withColumn("other", other).groupBy("id", "dimension").agg(F.max("score").alias("score"), F.max("other").alias("other"))
    passes, total = F.col("score") >= gate(F.col("dimension")), clauses.agg(F.count("*").alias("total"))
    g = best.groupBy("dimension").agg(F.count("*").alias("hit"), F.count_if(passes).alias("passes"), F.count_if(F.col("other") >= gate(F.col("dimension"))).alias("other_passes"))
    return g.join(F.broadcast(total)).select("dimension", (F.col("total") - F.col("hit")).alias("none"), (F.col("hit") - F.col("passes")).alias("below"), "passes", "other_passes")


def create_rules(rules: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New rules with trimmed patterns and blank labels null, and those refused as their (dimension, pattern) is there."""
    n = new.withColumns({"pattern": F.trim("pattern"), "label": F.nullif(F.trim("label"), F.lit("")), "is_active": F.lit(1)})
    return n.join(rules, ["dimension", "pattern"], "left_anti"), n.join(rules, ["dimension", "pattern"], "left_semi")


def update_rules(rules: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rules after updates (id, dimension, pattern, label, priority, threshold), and those refused as another rule has their key.

    Patterns are trimmed and blank labels null. Updates are judged against rules as they were.
    """
    w = wanted.withColumns({"pattern": F.trim("pattern"), "label": F.nullif(F.trim("label"), F.lit(""))})
    taken = rules.select(F.col("id").alias("other"), "dimension", "pattern")
    refused = w.join(taken, ["dimension", "pattern"]).where("other <> id").select("id").distinct()
    changed = w.join(refused, "id", "left_anti").select("id", *[F.col(c).alias(f"new_{c}") for c in ("dimension", "pattern", "label", "priority", "threshold")], F.lit(True).alias("changed"))
    j = rules.join(changed, "id", "left")
    new = {c: F.when(F.col("changed"), F.col(f"new_{c}")).otherwise(F.col(c)) for c in ("dimension", "pattern", "label", "priority", "threshold")}
    return j.withColumns(new).select(*rules.columns), w.join(refused, "id", "left_semi")


def switch_edits(rules: DataFrame, edits: DataFrame) -> DataFrame:
    """rules after edits (id, action): toggle (active), lock (null counts as unlocked) and delete."""
    j = rules.join(edits.select("id", "action"), "id", "left").where("action is null or action <> 'delete'")
    active = F.when(F.col("action") == "toggle", 1 - F.col("is_active")).otherwise(F.col("is_active"))
    locked = F.when(F.col("action") == "lock", 1 - F.coalesce("locked", F.lit(0))).otherwise(F.col("locked"))
    return j.withColumns({"is_active": active, "locked": locked}).select(*rules.columns)
