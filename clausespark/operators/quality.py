"""Data quality, lifecycle and log jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clausespark.functions.text import build_embed_text, chunks as cut_chunks, normalize_cjk_spacing, plain_text, tokenize
from clausespark.tables import stored


def markup_census(df: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """(tag, n, pages): how often each tag opens and in how many rows."""
    tags = df.select(id_col, F.explode(F.regexp_extract_all(F.lower(html_col), F.lit("<([a-z][a-z0-9]*)"), 1)).alias("tag"))
    return tags.groupBy("tag").agg(F.count("*").alias("n"), F.count_distinct(id_col).alias("pages"))


def orphan_parents(rows: DataFrame) -> DataFrame:
    return rows.where("parent is not null").join(rows.select(F.col("id").alias("parent")), "parent", "left_anti").select("id", "parent")


def id_differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """(id, side): ids that only one of two tables has."""
    a, b = left.select("id").distinct(), right.select("id").distinct()
    return a.join(b, "id", "left_anti").withColumn("side", F.lit("missing")).union(b.join(a, "id", "left_anti").withColumn("side", F.lit("orphan")))


def health_report(counts: dict[str, tuple[DataFrame, bool]]) -> DataFrame:
    """(key, n, severity, fixable) of every named table of findings."""
    out = None
    for key, (found, fixable) in counts.items():
        severity = F.when(F.col("n") == 0, "ok").otherwise("warn" if fixable else "error")
        one = found.agg(F.count("*").alias("n")).select(F.lit(key).alias("key"), "n", severity.alias("severity"), F.lit(fixable).alias("fixable"))
        out = one if out is None else out.union(one)
    return out


def filter_logs(logs: DataFrame, category: str = "", levels: tuple = (), user: str = "", start: str = "", end: str = "", keyword: str = "") -> DataFrame:
    """Rows that pass all filters given; the end day counts as a whole and bad dates are ignored."""
    ok = F.lit(True)
    if category:
        ok = ok & (F.col("category") == category)
    if levels:
        ok = ok & F.col("level").isin(*levels)
    if user:
        ok = ok & (F.col("username") == user)
    day = lambda x: F.try_to_timestamp(F.lit(x), F.lit("yyyy-MM-dd")).cast("timestamp_ntz")
    if start:
        ok = ok & F.coalesce(F.col("created_at") >= day(start), F.lit(True))
    if end:
        ok = ok & F.coalesce(F.col("created_at") < day(end) + F.expr("interval 1 day"), F.lit(True))
    if keyword:
        ok = ok & (F.contains("action", F.lit(keyword)) | F.contains("detail", F.lit(keyword)) | F.contains("username", F.lit(keyword)))
    return logs.where(ok)


def task_disposition(status, age_s, terminal_s: int = 1800, review_s: int = 86_400):
    """drop_files, drop_row or keep for an import task of an age in seconds."""
    return F.when(age_s.isNull(), "keep").when((status == "review_needed") & (age_s > review_s), "drop_files").when(status.isin("done", "error") & (age_s > terminal_s), "drop_row").otherwise("keep")


def resolve_parameters(defaults: DataFrame, overrides: DataFrame) -> DataFrame:
    """(key, value): valid overrides within their range, else defaults."""
    v = F.col("raw").try_cast("double")
    return defaults.join(overrides, "key", "left").select("key", F.when(v.isNull(), F.col("value")).otherwise(F.least(F.greatest(v, F.col("low")), F.col("high"))).alias("value"))


def link_replacements(specs: DataFrame) -> DataFrame:
    """(id, status, successor) of specs (id, code, status, replaced_by_code): by status a row points on, or takes another's place.

    A withdrawn or revised spec points to its successor if that is there; one in force withdraws the one it names and
    that points back to it. Never to itself.
    """
    by_code = specs.select(F.col("code").alias("named"), F.col("id").alias("other"))
    j = specs.join(by_code, (specs.replaced_by_code == F.col("named")) & (specs.id != F.col("other")), "left")
    taken = j.where("status = '现行' and other is not null").groupBy("other").agg(F.min("id").alias("by")).withColumnRenamed("other", "id")
    own = j.groupBy("id").agg(F.min("other").alias("other"))
    s = specs.join(own, "id").join(taken, "id", "left")
    return s.select("id", F.when(F.col("by").isNotNull(), "废止").otherwise(F.col("status")).alias("status"), F.coalesce("by", F.when(F.col("status").isin("废止", "修订中"), F.col("other"))).alias("successor"))


def cascade_delete(specs: DataFrame, children: dict[str, DataFrame], gone: DataFrame) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Tables after deleting specs: their rows go everywhere and pointers to them become null."""
    left = specs.join(gone, "id", "left_anti").join(gone.select(F.col("id").alias("successor"), F.lit(True).alias("lost")), "successor", "left")
    left = left.withColumn("successor", F.when(F.col("lost"), None).otherwise(F.col("successor"))).drop("lost")
    return left, {k: c.join(gone.select(F.col("id").alias("spec_id")), "spec_id", "left_anti") for k, c in children.items()}


def replace_chunks(old: DataFrame, new: DataFrame, changed: DataFrame, key: str = "clause_id") -> DataFrame:
    """old without the rows of changed keys, and new rows instead; a changed key without new rows is gone."""
    return old.join(changed, key, "left_anti").unionByName(new)


def insert_absent(rows: DataFrame, seed: DataFrame, keys: list[str]) -> DataFrame:
    return rows.unionByName(seed.join(rows, keys, "left_anti"))


def seed_rules(rules: DataFrame, seed: DataFrame) -> DataFrame:
    """rules with those of seed (dimension, sub_field, pattern, match_type, priority, threshold) whose dimension and pattern are new.

    Seeds come locked and active, without hits, confirmations or a label; of seeds with one key the first by all columns stays.
    """
    cols = ["sub_field", "match_type", "priority", "threshold"]
    one = seed.groupBy("dimension", "pattern").agg(F.min(F.struct(*cols)).alias("s")).select("dimension", "pattern", *[F.col(f"s.{c}").alias(c) for c in cols])
    fresh = one.withColumns({"locked": F.lit(1), "is_active": F.lit(1), "hit_count": F.lit(0), "confirmed": F.lit(0), "label": F.lit(None).cast("string")})
    return insert_absent(rules.select(*fresh.columns), fresh, ["dimension", "pattern"])


def audit(action: str, level: str, counts: DataFrame) -> DataFrame:
    """(category, level, action, detail): one log row of a job's counts."""
    return counts.select(F.lit("job").alias("category"), F.lit(level).alias("level"), F.lit(action).alias("action"), F.to_json(F.struct("*")).alias("detail"))


def empty_content(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id): rows whose text is null or blank."""
    return rows.where(F.trim(F.regexp_replace(F.coalesce(text_col, F.lit("")), "[\\s\u00a0\u3000]+", " ")) == "").select(F.col(id_col).alias("id"))


def bad_classification(clauses: DataFrame, labels: list[str]) -> DataFrame:
    """(id): clauses marked as classified of which every label is null or empty."""
    blank = F.lit(True)
    for c in labels:
        blank = blank & (F.coalesce(F.col(c), F.lit("")) == "")
    return clauses.where((F.col("ai_classified") == 1) & blank).select("id")


def health_flag(report: DataFrame) -> DataFrame:
    """(flag, keys) of a report's findings: red for what can be fixed or has failed, yellow for what is only reported."""
    found = report.where("severity <> 'ok'").withColumn("flag", F.when(F.col("fixable"), "red").otherwise("yellow"))
    return found.groupBy("flag").agg(F.array_sort(F.collect_list("key")).alias("keys"))


def snapshot(report: DataFrame, history: DataFrame, at: str) -> DataFrame:
    """history (at, result) with one more row: the report as JSON."""
    rows = F.array_sort(F.collect_list(F.struct("key", "n", "severity", "fixable")))
    return history.unionByName(report.agg(F.to_json(rows).alias("result")).withColumn("at", F.lit(at).cast("timestamp_ntz")))


def fix_labels(clauses: DataFrame, labels: list[str]) -> DataFrame:
    """clauses with those of bad_classification unmarked and up for review."""
    bad = bad_classification(clauses, labels).select("id", F.lit(True).alias("bad"))
    j = clauses.join(bad, "id", "left")
    return j.withColumns({"ai_classified": F.when(F.col("bad"), 0).otherwise(F.col("ai_classified")), "needs_review": F.when(F.col("bad"), 1).otherwise(F.col("needs_review"))}).drop("bad")


def fix_rows(derived: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(derived after the fix, its counts (added, removed)): a row of wanted for every id that derived lacks, none for others.

    For vectors and index rows alike, both with an id.
    """
    kept = derived.join(wanted.select("id"), "id", "left_semi")
    added = wanted.join(derived.select("id"), "id", "left_anti")
    counts = id_differences(wanted, derived).agg(F.count_if(F.col("side") == "missing").alias("added"), F.count_if(F.col("side") == "orphan").alias("removed"))
    return kept.unionByName(added), counts


def clean_logs(logs: DataFrame, as_of: str | None = None, days: int = 90, category: str = "") -> tuple[DataFrame, DataFrame]:
    """(rows kept, (removed)): without rows older than `days` before as_of, or with no as_of all rows or a category's."""
    gone = F.col("created_at") < F.lit(as_of).cast("timestamp_ntz") - F.make_interval(days=F.lit(days)) if as_of else F.lit(True)
    if category:
        gone = gone & (F.col("category") == category)
    gone = F.coalesce(gone, F.lit(False))
    return logs.where(~gone), logs.agg(F.count_if(gone).alias("removed"))


def heal_tasks(tasks: DataFrame, now: str) -> DataFrame:
    """tasks with those cut off (uploading or processing) as errors, updated now."""
    cut = F.col("status").isin("uploading", "processing")
    return tasks.withColumns({"updated_at": F.when(cut, F.lit(now).cast("timestamp_ntz")).otherwise(F.col("updated_at")), "status": F.when(cut, "error").otherwise(F.col("status"))})


def spec_list(specs: DataFrame, clauses: DataFrame) -> DataFrame:
    """(place, id, code, clause_count, replace_by_code, replace_by_title): newest first, then by id.

    specs: id, code, title, created_at, replace_by; clauses: spec_id. Places come from a range partition and the counts
    of the partitions before, so that no task sorts all rows.
    """
    n = clauses.groupBy(F.col("spec_id").alias("id")).agg(F.count("*").alias("clause_count"))
    other = specs.select(F.col("id").alias("replace_by"), F.col("code").alias("replace_by_code"), F.col("title").alias("replace_by_title"))
    j = specs.join(n, "id", "left").join(other, "replace_by", "left").fillna(0, ["clause_count"])
    return numbered(j, [F.desc("created_at"), F.asc("id")], "place").select("place", "id", "code", "clause_count", "replace_by_code", "replace_by_title")


def numbered(rows: DataFrame, order: list, name: str) -> DataFrame:
    """rows with their place in an order, from 1. The ranges are stored, as another run of their step may cut them elsewhere."""
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()).withColumn("nth", F.monotonically_increasing_id())
    ranged = stored(ranged, "numbered")
    # a row for each partition
    at = ranged.groupBy("part").agg(F.count("*").alias("n"), F.min("nth").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return ranged.join(F.broadcast(at.select("part", "first", before.alias("before"))), "part").withColumn(name, F.col("nth") - F.col("first") + 1 + F.col("before")).drop("part", "nth", "first", "before")


def cascade(specs: DataFrame, clauses: DataFrame, by_clause: dict[str, DataFrame], specs_gone: DataFrame, clauses_gone: DataFrame) -> tuple[DataFrame, DataFrame, dict[str, DataFrame]]:
    """(specs, clauses, tables by clause) after deleting specs (id) and clauses (id).

    A spec's clauses go with it, and with a clause its rows in every table (queue, index, vectors) by clause_id. Pointers
    to deleted specs (successor) become null, and clause_count is counted anew.
    """
    left, children = cascade_delete(specs, {"clauses": clauses}, specs_gone)
    kept = children["clauses"].join(clauses_gone, "id", "left_anti")
    n = kept.groupBy(F.col("spec_id").alias("id")).agg(F.count("*").alias("clause_count"))
    left = left.drop("clause_count").join(n, "id", "left").fillna(0, ["clause_count"])
    ids = kept.select(F.col("id").alias("clause_id"))
    return left, kept, {k: t.join(ids, "clause_id", "left_semi") for k, t in by_clause.items()}


def json_lines(rows: DataFrame, kind: str) -> DataFrame:
    """(kind, line): each row as a JSON object without its null columns."""
    return rows.select(F.lit(kind).alias("kind"), F.to_json(F.struct("*")).alias("line"))


def rederive(clauses: DataFrame, chunks: DataFrame, edits: DataFrame, limit: int = 512) -> tuple[DataFrame, DataFrame]:
    """(clauses, chunks) after edits (id, clause_no, title, content): both index columns and the chunks of edited ones anew.

    clauses: id, spec_code, spec_title, clause_no, title, content, section_path, search_text, breadcrumb; section_path
    stays as it is. chunks: clause_id, chunk_index, chunk.
    """
    changed = clauses.drop("clause_no", "title", "content").join(edits, "id")
    search = F.array_join(tokenize(plain_text(F.concat_ws(" ", "title", "content"))), " ")
    crumb = F.array_join(tokenize(normalize_cjk_spacing("section_path")), " ")
    changed = changed.withColumns({"search_text": F.concat_ws(" ", search, "clause_no"), "breadcrumb": crumb})
    embed = build_embed_text(F.col("spec_code"), F.col("spec_title"), F.col("clause_no"), F.col("title"), F.col("content"), F.col("section_path"))
    new = changed.select(F.col("id").alias("clause_id"), F.posexplode(cut_chunks(embed, limit)).alias("chunk_index", "chunk"))
    ids = edits.select("id")
    return clauses.join(ids, "id", "left_anti").unionByName(changed.select(*clauses.columns)), replace_chunks(chunks, new, ids.withColumnRenamed("id", "clause_id"))
