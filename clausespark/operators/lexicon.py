"""Lexicon rows (id, kind, canonical, variants as a comma list, distinguish, is_active): groups, conflicts, clusters, edits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausespark.functions.text import split_values, tokenize
from clausespark.operators.patterns import containing
from clausespark.tables import connected_components, stored

EQUIVALENT = ("synonym", "alias")


def words(rows: DataFrame) -> DataFrame:
    """(id, kind, word): the canonical and all variants of each row."""
    all_words = F.array_distinct(F.concat(F.array(F.trim("canonical")), split_values("variants")))
    return rows.select("id", "kind", F.explode(F.filter(all_words, lambda w: w != "")).alias("word"))


def conflicting_words(rows: DataFrame) -> DataFrame:
    w = words(rows.where(F.col("kind").isin(*EQUIVALENT)))
    return w.groupBy("word").agg(F.count_distinct("id").alias("rows")).where("rows > 1")


def active_groups(rows: DataFrame) -> DataFrame:
    """Active rows without the equivalence rows that share a word with another one; confusable rows never conflict."""
    active = rows.where("is_active = 1")
    bad = words(active.where(F.col("kind").isin(*EQUIVALENT))).join(conflicting_words(active), "word", "left_semi").select("id").distinct()
    return active.join(bad, "id", "left_anti")


def first_conflict(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(request, word): of each request's words the first, in order, that another equivalence row owns, active or not."""
    owned = words(rows.where(F.col("kind").isin(*EQUIVALENT))).select(F.col("id").alias("owner"), "word")
    j = wanted.join(owned, "word").where(~F.col("owner").eqNullSafe(F.col("exclude")))
    return j.groupBy("request").agg(F.min("word").alias("word"))


def clusters(rows: DataFrame) -> DataFrame:
    """(id, cluster): connected components of equivalence rows sharing words, only where one is shared."""
    w = words(rows.where(F.col("kind").isin(*EQUIVALENT)))
    shared = w.groupBy("word").agg(F.min("id").alias("least"), F.count_distinct("id").alias("n")).where("n > 1")
    found = connected_components(w.join(shared, "word").select(F.col("id").alias("a"), F.col("least").alias("b")))
    return found.withColumnsRenamed({"node": "id", "component": "cluster"})


def cluster_actions(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(cluster, type, keeper, variants): same sets, a chain, a big or an ambiguous one; aliases keep before synonyms, then the first id."""
    j = rows.join(found, "id").withColumn("set", F.array_sort(F.array_distinct(F.concat(F.array("canonical"), split_values("variants")))))
    keeper = F.min_by(F.struct("id", "canonical"), F.struct((F.col("kind") != "alias").cast("int"), "id"))
    g = j.groupBy("cluster").agg(F.count("*").alias("n"), F.count_distinct("set").alias("sets"), F.array_distinct(F.flatten(F.collect_list("set"))).alias("all"), F.collect_list(F.struct("id", "canonical", "set")).alias("members"), keeper.alias("k"))
    other = lambda m: F.exists("members", lambda x: (x["id"] != m["id"]) & F.array_contains(x["set"], m["canonical"]))
    kind = F.when(F.col("n") > 2, "BIG").when(F.col("sets") == 1, "SAME_SET").when(F.exists("members", other), "CHAIN").otherwise("AMBIGUOUS")
    return g.select("cluster", kind.alias("type"), F.col("k.id").alias("keeper"), F.array_join(F.array_sort(F.array_remove("all", F.col("k.canonical"))), ",").alias("variants"))


def resolve_clusters(rows: DataFrame, actions: DataFrame, found: DataFrame) -> DataFrame:
    """rows with every cluster merged into its keeper: no word is in two equivalence rows afterwards."""
    j = rows.join(found, "id", "left").join(actions.select("cluster", "keeper", F.col("variants").alias("merged")), "cluster", "left")
    return j.where("keeper is null or keeper = id").select("id", "kind", "canonical", F.coalesce("merged", "variants").alias("variants"), "distinguish", "is_active")


def resolve_decided(rows: DataFrame, found: DataFrame, decisions: DataFrame) -> DataFrame:
    """rows after decisions (word, action, canonical, groups) on the clusters that hold the word; other clusters are merged.

    merge: one row, its canonical as decided. split: one row for each of groups (canonical, variants), in the order of
    ids; rows beyond the groups go. drop: the row of that canonical that holds the word goes, the others stay. A cluster
    with several decisions takes that of the smallest word.
    """
    of = words(rows).join(found, "id").join(decisions, "word")
    chosen = of.groupBy("cluster").agg(F.min(F.struct("word", "action", F.col("canonical").alias("wanted"), "groups")).alias("d")).select("cluster", "d.*")
    left = found.join(chosen, "cluster", "left_anti")
    plain = resolve_clusters(rows, cluster_actions(rows, left), left)
    mine = rows.join(found, "id").join(chosen, "cluster")
    dropped = mine.where("action = 'drop' and canonical = wanted").where(F.exists(F.concat(F.array("canonical"), split_values("variants")), lambda w: w == F.col("word"))).select("id")
    every = F.array_distinct(F.flatten(F.collect_list(F.concat(F.array("canonical"), split_values("variants")))))
    keeper = F.min_by("id", F.struct((F.col("kind") != "alias").cast("int"), "id"))
    merged = mine.where("action = 'merge'").groupBy("cluster", "wanted").agg(keeper.alias("id"), every.alias("all"), F.collect_set("id").alias("ids"))
    into = merged.select("id", F.col("wanted").alias("new"), F.array_join(F.array_sort(F.array_remove("all", F.col("wanted"))), ",").alias("more"))
    place = F.row_number().over(Window.partitionBy("cluster").orderBy("id"))
    parts = mine.where("action = 'split'").withColumn("g", F.get("groups", place - 1)).select("id", F.col("g.canonical").alias("new"), F.col("g.variants").alias("more"))
    changed = into.union(parts)
    hit = mine.where("action in ('merge', 'split')").select("id")
    out = plain.join(dropped, "id", "left_anti").join(changed, "id", "left").join(hit.withColumn("hit", F.lit(True)), "id", "left")
    out = out.where("hit is null or new is not null")
    return out.select("id", "kind", F.coalesce("new", "canonical").alias("canonical"), F.coalesce("more", "variants").alias("variants"), "distinguish", "is_active")


def replacements(groups: DataFrame) -> DataFrame:
    """(variant, canonical) of equivalence rows, one canonical for each variant, the first row's."""
    v = groups.where(F.col("kind").isin(*EQUIVALENT)).select("id", "canonical", F.explode(split_values("variants")).alias("variant"))
    return v.where("variant <> canonical").groupBy("variant").agg(F.min_by("canonical", "id").alias("canonical"))


#: Pairs of a lexicon that every row folds over in one go; of a larger one each row takes what it can meet.
FOLD = 1000


def normalize_text(df: DataFrame, id_col: str, text_col: str, groups: DataFrame, name: str = "normalized", fold: int = FOLD) -> DataFrame:
    """df with text in which variants, longest first, are replaced one after another; later ones see earlier results.

    A lexicon of up to `fold` pairs is one row that all rows get. With a larger one a row folds over the variants that it can meet alone: those in its text and, in further rounds, those that earlier
    replacements bring about, until no stage of the fold holds another one.
    """
    lexicon = replacements(groups)
    order = lambda v: F.struct((-F.length(v)).alias("n"), F.col("variant"), F.col("canonical"))
    texts = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    step = lambda t, p: F.replace(t, p["variant"], p["canonical"])
    if lexicon.limit(fold + 1).count() <= fold:
        every = lexicon.agg(F.array_sort(F.collect_list(order("variant"))).alias("__pairs"))
        folded = F.aggregate("__pairs", F.coalesce(F.col(text_col), F.lit("")), step)
        return df.join(F.broadcast(every)).withColumn(name, folded).drop("__pairs")
    met, stages = None, texts
    while True:
        found = containing(stages, "id", "text", lexicon.select(F.col("variant").alias("pattern"))).select("id", F.col("pattern").alias("variant")).distinct()
        if met is not None:
            found = found.join(met, ["id", "variant"], "left_anti")
        found = stored(found, "met-variants")
        if not found.limit(1).count():
            break
        met = found if met is None else met.union(found)
        pairs = met.join(lexicon, "variant").groupBy("id").agg(F.array_sort(F.collect_list(order("variant"))).alias("pairs"))
        grown = F.aggregate("pairs", F.array("text"), lambda ts, p: F.concat(ts, F.array(step(F.element_at(ts, -1), p))))
        stages = stored(texts.join(pairs, "id").select("id", F.explode(F.array_distinct(grown)).alias("text")).distinct(), "fold-stages")
    if met is None:
        return df.withColumn(name, F.coalesce(F.col(text_col), F.lit("")))
    pairs = met.join(lexicon, "variant").groupBy(F.col("id").alias("__id")).agg(F.array_sort(F.collect_list(order("variant"))).alias("__pairs"))
    pairs_of = F.coalesce("__pairs", F.array().cast("array<struct<n:int,variant:string,canonical:string>>"))
    folded = F.aggregate(pairs_of, F.coalesce(F.col(text_col), F.lit("")), step)
    return df.join(pairs, F.col(id_col) == F.col("__id"), "left").withColumn(name, folded).drop("__pairs", "__id")


def expanded_items(queries: DataFrame, text_col: str, groups: DataFrame) -> DataFrame:
    """(query_id, position, words): each query cut at the words of a lexicon, leftmost and longest first.

    groups: rows of the lexicon (id, canonical, variants). A word becomes its whole group, canonical first; of a word in
    several groups the first one counts. Stretches between become their tokens.
    """
    g = groups.select("id", F.array_distinct(F.filter(F.concat(F.array(F.coalesce("canonical", F.lit(""))), split_values("variants")), lambda w: w != "")).alias("words"))
    owner = g.select("id", F.explode("words").alias("pattern")).groupBy("pattern").agg(F.min("id").alias("id")).join(g, "id").select("pattern", "words")
    q = queries.select("query_id", F.trim(F.coalesce(F.col(text_col), F.lit(""))).alias("text"))
    hits = containing(q, "query_id", "text", owner.select("pattern")).select("query_id", "pattern").distinct().join(owner, "pattern")
    of = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct((-F.length("pattern")).alias("n"), "pattern", "words"))).alias("known"))
    quoted = F.transform("known", lambda k: F.concat(F.lit("\\Q"), F.replace(k["pattern"], F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E")))
    q = q.join(of, "query_id", "left").withColumn("cut", F.when(F.col("known").isNotNull(), F.array_join(quoted, "|")))
    q = q.withColumn("words", F.map_from_entries(F.transform("known", lambda k: F.struct(k["pattern"], k["words"]))))
    single = lambda t: F.transform(tokenize(t), lambda w: F.array(w))
    between, found = F.split("text", F.col("cut"), -1), F.concat(F.regexp_extract_all("text", F.col("cut"), F.lit(0)), F.array(F.lit("")))
    items = F.flatten(F.zip_with(between, found, lambda t, h: F.concat(single(t), F.when(h == "", F.array().cast("array<array<string>>")).otherwise(F.array(F.try_element_at("words", h))))))
    return q.select("query_id", F.posexplode(F.when(F.col("cut").isNull(), single(F.col("text"))).otherwise(items)).alias("position", "words"))


def expand_queries(queries: DataFrame, text_col: str, groups: DataFrame) -> DataFrame:
    """(query_id, position, term): the words of expanded_items, a row each; those of one position are alternatives."""
    return expanded_items(queries, text_col, groups).select("query_id", "position", F.explode("words").alias("term"))


def match_expressions(queries: DataFrame, text_col: str, groups: DataFrame, join_with: str = "AND") -> DataFrame:
    """(query_id, expression): quoted words, alternatives in brackets joined by OR, positions by join_with; empty without a word."""
    quoted = F.transform("words", lambda w: F.concat(F.lit('"'), F.replace(w, F.lit('"'), F.lit('""')), F.lit('"')))
    one = F.when(F.size("words") == 1, quoted[0]).otherwise(F.concat(F.lit("("), F.array_join(quoted, " OR "), F.lit(")")))
    rows = expanded_items(queries, text_col, groups).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("position", one.alias("e")))).alias("items"))
    made = F.array_join(F.transform("items", lambda x: x["e"]), f" {join_with} ")
    return queries.select("query_id").join(rows, "query_id", "left").select("query_id", F.coalesce(made, F.lit("")).alias("expression"))


def confusable_hits(df: DataFrame, id_col: str, text_col: str, rows: DataFrame) -> DataFrame:
    """(id, pair, canonical, variant): texts with a pair's canonical and a variant of it, the first one."""
    p = rows.where("kind = 'confusable' and is_active = 1").select(F.col("id").alias("pair"), "canonical", F.posexplode(split_values("variants")).alias("at", "variant"))
    asked = p.select(F.col("canonical").alias("pattern")).union(p.select("variant"))
    hits = stored(containing(df.select(id_col, text_col), id_col, text_col, asked).select(id_col, "pattern").distinct(), "word-hits")
    both = hits.withColumnRenamed("pattern", "canonical").join(p, "canonical").join(hits.withColumnRenamed("pattern", "variant"), [id_col, "variant"])
    return both.groupBy(id_col, "pair", "canonical").agg(F.min_by("variant", "at").alias("variant"))


def validation_error() -> Column:
    """Why a row is refused, null if it is not."""
    canonical, variants = F.trim(F.coalesce("canonical", F.lit(""))), split_values("variants")
    clash = F.exists(variants, lambda v: (v == canonical) | F.contains(v, canonical) | F.contains(canonical, v))
    confusable = F.col("kind") == "confusable"
    checks = [
        (~F.coalesce(F.col("kind").isin(*EQUIVALENT, "confusable"), F.lit(False)), "kind"), (canonical == "", "canonical"), (confusable & (F.size(variants) != 1), "one variant"),
        (confusable & (F.trim(F.coalesce("distinguish", F.lit(""))) == ""), "explanation"), (F.size(variants) == 0, "variants"), (clash, "overlap"),
    ]
    return reduce(lambda out, c: F.when(c[0], c[1]).otherwise(out), reversed(checks), F.lit(None).cast("string"))


def upsert(rows: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows after the upsert, (result, n) of the incoming lines); incoming has `line` besides a row's columns.

    Invalid lines and those whose words another key owns fail; later lines of the same content are skipped, as are those
    that add nothing; others merge into the row of the same kind and canonical or start one.
    """
    checked = incoming.withColumn("error", validation_error())
    same = Window.partitionBy("kind", "canonical", "variants").orderBy("line")
    good = checked.where("error is null").withColumn("rn", F.row_number().over(same))
    owned = words(rows.where(F.col("kind").isin(*EQUIVALENT))).join(rows.select("id", F.col("canonical").alias("owner")), "id").select("word", "owner")
    mine = good.where("rn = 1").select("line", "canonical", F.explode(F.array_distinct(F.concat(F.array("canonical"), split_values("variants")))).alias("word"))
    clash = mine.join(owned, "word").where("owner <> canonical").select("line").distinct()
    ok = good.where("rn = 1").join(clash, "line", "left_anti")
    wanted = ok.groupBy("kind", "canonical").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(split_values("variants"))))).alias("more"), F.min("line").alias("line"), F.min("distinguish").alias("d"))
    j = rows.join(wanted, ["kind", "canonical"], "full")
    merged = F.array_union(split_values("variants"), F.coalesce("more", F.array().cast("array<string>")))
    out = j.select("id", "kind", "canonical", F.array_join(merged, ",").alias("variants"), F.coalesce("distinguish", "d").alias("distinguish"), F.coalesce("is_active", F.lit(1)).alias("is_active"))
    results = checked.select(F.when(F.col("error").isNotNull(), "fail"), "line").toDF("result", "line").where("result is not null").union(clash.select(F.lit("fail"), "line")).union(good.where("rn > 1").select(F.lit("skip"), "line")).union(ok.select(F.lit("ok"), "line"))
    return out, results.groupBy("result").agg(F.count("*").alias("n"))


def migrate_synonyms(legacy: DataFrame) -> DataFrame:
    """One alias row for each target with its sources, active if any was."""
    return legacy.groupBy("target").agg(F.array_join(F.array_sort(F.collect_set("source")), ",").alias("variants"), F.max("is_active").alias("is_active"))


def recall_difference(before: DataFrame, after: DataFrame) -> DataFrame:
    """(term, before, lost, gained) of two tables (term, id) of hits."""
    b, a = before.distinct().withColumn("b", F.lit(1)), after.distinct().withColumn("a", F.lit(1))
    j = b.join(a, ["term", "id"], "full")
    return j.groupBy("term").agg(F.count("b").alias("before"), F.count_if(F.col("a").isNull()).alias("lost"), F.count_if(F.col("b").isNull()).alias("gained"))


def edit(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """rows after edits (id, action): toggle turns a row on or off, delete takes it out."""
    j = rows.join(edits.select("id", "action"), "id", "left")
    return j.where("action is null or action <> 'delete'").withColumn("is_active", F.when(F.col("action") == "toggle", 1 - F.col("is_active")).otherwise(F.col("is_active"))).drop("action")


def change(rows: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows after creates and edits, (request, error) of those refused); wanted has request, id (null: create) and a row's columns.

    Refused are invalid rows, a canonical that another row of the same kind has, and words that another equivalence row
    owns. A confusable row that is there already in full is left out. New rows have a null id and are active. Requests
    are judged against rows alone, not against each other.
    """
    w = wanted.withColumn("error", validation_error())
    taken = rows.select(F.col("id").alias("other"), "kind", "canonical")
    clash = w.join(taken, ["kind", "canonical"]).where(~F.col("other").eqNullSafe(F.col("id")) & F.col("kind").isin(*EQUIVALENT)).select("request").distinct().withColumn("taken", F.lit("canonical taken"))
    asked = w.where(F.col("kind").isin(*EQUIVALENT)).select("request", F.col("id").alias("exclude"), F.explode(F.concat(F.array("canonical"), split_values("variants"))).alias("word"))
    owned = first_conflict(rows, asked).select("request", F.concat(F.lit("word taken: "), "word").alias("owned"))
    w = w.join(clash, "request", "left").join(owned, "request", "left").withColumn("error", F.coalesce("error", "taken", "owned")).drop("taken", "owned")
    same = ["kind", "canonical", "variants", "distinguish"]
    ok = w.where("error is null").join(rows.where("kind = 'confusable'").select(*same), same, "left_anti")
    edits = ok.where("id is not null").select("id", *[F.col(c).alias(f"new_{c}") for c in same])
    out = rows.join(edits, "id", "left").select("id", *[F.when(F.col("new_kind").isNotNull(), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) for c in same], "is_active")
    return out.unionByName(ok.where("id is null").select("id", *same, F.lit(1).alias("is_active"))), w.where("error is not null").select("request", "error")
