"""Many patterns against many texts without a nested loop: a few are looked for as they are, more meet the words of texts by their rarest piece."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausespark.tables import stored

#: Characters of a piece, for patterns of so many or more; shorter ones are their own piece.
PIECES = (3, 6)
#: So many patterns are looked for in every text, one after another.
FEW = 64


def pieces(text: Column, size: int) -> Column:
    """All runs of `size` characters of a text, repeats included."""
    out = chars = F.split(text, "", -1)
    for k in range(1, size):
        out = F.zip_with(F.slice(out, F.lit(1), F.greatest(F.size(chars) - k, F.lit(0))), F.slice(chars, k + 1, F.size(chars)), lambda a, b: F.concat(a, b))
    return out


def occurrences(text: Column, pattern: Column) -> Column:
    return F.when(F.length(pattern) > 0, ((F.length(text) - F.length(F.replace(text, pattern, F.lit("")))) / F.length(pattern)).cast("int")).otherwise(0)


def apart(text: Column) -> Column:
    """What is between the spaces of a text: a pattern's longest such part is in a word of each text that holds the pattern."""
    return F.split(F.coalesce(text, F.lit("")), " ", -1)


def words_with(texts: DataFrame, text_col: str, patterns: DataFrame) -> DataFrame:
    """(word, pattern): different words of all texts and the patterns (pattern) of which they hold the longest part.

    Words are looked through once each, however many texts have them: they meet parts on the part's rarest piece, which is
    counted over all words. Patterns of spaces alone have no words, empty ones neither.
    """
    longest = F.aggregate(apart(F.col("pattern")), F.lit(""), lambda a, x: F.when(F.length(x) > F.length(a), x).otherwise(a))
    p = stored(patterns.select("pattern", longest.alias("part")).where("part <> ''").distinct(), "parts")
    size = F.greatest(*[F.when(F.length("part") >= n, n) for n in PIECES], F.least(F.length("part"), F.lit(PIECES[0])))
    # at most as many numbers come to the driver as there are sizes
    sizes = [r.n for r in p.select(size.alias("n")).distinct().collect()]
    known = stored(texts.select(F.explode(F.array_distinct(apart(F.col(text_col)))).alias("word")).where("word <> ''").distinct(), "words")
    none = F.array().cast("array<string>")
    own = lambda c, n: F.array_distinct(F.when(F.length(c) >= n, pieces(F.col(c), n)).otherwise(none))
    wanted = F.array(none, *[F.when(size == n, own("part", n)).otherwise(none) for n in sizes])
    wanted = p.select("part").distinct().select("part", F.explode(F.flatten(wanted)).alias("piece"))
    rows = known.select("word", F.explode(F.flatten(F.array(none, *[own("word", n) for n in sizes]))).alias("piece"))
    seen = rows.groupBy("piece").agg(F.count("*").alias("n"))
    rare = wanted.join(seen, "piece", "left").groupBy("part").agg(F.min_by("piece", "n").alias("piece"), F.count("*").alias("wanted"), F.count("n").alias("found"))
    met = rows.join(rare.where("wanted = found").select("piece", "part"), "piece").where(F.contains("word", F.col("part")))
    return stored(met.select("word", "part").join(p, "part").select("word", "pattern"), "met-words")


def _every(patterns: DataFrame) -> DataFrame:
    """One row with all patterns, for each task."""
    return F.broadcast(patterns.agg(F.collect_list("pattern").alias("__every")))


def _different(patterns: DataFrame) -> tuple[DataFrame, int]:
    """The different patterns but the empty one, and their number up to one more than FEW."""
    p = stored(patterns.select("pattern").where("pattern <> ''").distinct(), "patterns")
    return p, p.limit(FEW + 1).count()


def containing(texts: DataFrame, id_col: str, text_col: str, patterns: DataFrame) -> DataFrame:
    """texts with a column pattern: a row for each different pattern (of patterns) that the text contains, none for empty ones."""
    p, n = _different(patterns)
    text = F.col(text_col)
    if not n:
        return texts.limit(0).withColumn("pattern", F.lit(""))
    if n <= FEW:
        return texts.join(_every(p)).select(*[F.col(c) for c in texts.columns], F.explode(F.filter("__every", lambda x: F.contains(text, x))).alias("pattern"))
    words = texts.select(F.col(id_col).alias("__id"), F.explode(F.array_distinct(apart(text))).alias("word"))
    pairs = words.join(words_with(texts, text_col, p), "word").groupBy("__id").agg(F.collect_set("pattern").alias("__found"))
    # the patterns without a part, one for each number of spaces in a row
    blank = _every(p.where(F.translate("pattern", " ", "") == ""))
    found = F.filter(F.concat(F.coalesce("__found", F.array().cast("array<string>")), "__every"), lambda x: F.contains(text, x))
    return texts.join(pairs, F.col(id_col).eqNullSafe(F.col("__id")), "left").join(blank).select(*[F.col(c) for c in texts.columns], F.explode(found).alias("pattern"))


def counted(texts: DataFrame, id_col: str, text_col: str, patterns: DataFrame) -> DataFrame:
    """(id, pattern, found): how often a text holds a pattern, where it does; rows that repeat an id are texts of their own.

    Of many patterns those without a space are counted word by word, as no occurrence goes across words: a long text is
    not searched again for each pattern that it has.
    """
    p, n = _different(patterns)
    whole = lambda rows: rows.select(F.col(id_col).alias("id"), "pattern", occurrences(F.col(text_col), F.col("pattern")).alias("found"))
    if n <= FEW:
        return whole(containing(texts, id_col, text_col, p))
    spaced = F.contains("pattern", F.lit(" "))
    # numbered before, as an explode in one select would come first
    words = texts.withColumn("row", F.monotonically_increasing_id()).select("row", F.col(id_col).alias("id"), F.explode(apart(F.col(text_col))).alias("word"))
    # words shorter than all patterns hold none
    least = p.where(~spaced).agg(F.min(F.length("pattern"))).first()[0]
    words = words.where(F.length("word") >= (least or 1))
    met = words_with(texts, text_col, p.where(~spaced)).withColumn("n", occurrences(F.col("word"), F.col("pattern")))
    found = words.join(met, "word").groupBy("row", "id", "pattern").agg(F.sum("n").cast("int").alias("found")).drop("row")
    return found.union(whole(containing(texts, id_col, text_col, p.where(spaced))))


def plain_piece(pattern: Column) -> Column:
    """A stretch that every match of a regular expression holds, empty where none is known for certain.

    Only expressions of characters, dots and quantifiers are read: the longest run without any of them.
    """
    plain = ~pattern.rlike(r"[\\()\[\]|^$]")
    # a character before a quantifier may be left out
    kept = F.regexp_extract_all(F.regexp_replace(pattern, r"(?s).[*?]|.\{[^}]*\}", "\u0000"), F.lit("[^.+*?{}\u0000]+"), F.lit(0))
    longest = F.aggregate(kept, F.lit(""), lambda a, x: F.when(F.length(x) > F.length(a), x).otherwise(a))
    return F.when(plain, longest).otherwise("")
