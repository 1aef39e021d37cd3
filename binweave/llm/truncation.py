"""Texts that were cut off: word trigrams inside texts against trigrams at their ends, in pure SQL.

For the last trigram of a text, and for the pair and the single word it ends with, three numbers are joined from counts over
all texts: how often it stands inside a text (something follows), how often it ends one, and how often its context is followed
inside by a longer word that its last word begins. A text is cut inside a word if its last word never stands inside in that
context while longer words do, more often than it ends texts. It is cut after a word or mark that cannot end a statement if
the trigram stands inside but almost never ends a text (a share of max_terminal; three times that for words that hardly ever
end one in any context, a third for words that often do). A context with fewer than `support` continuations is not used. The terminal share of a trigram is smoothed towards that of its last
two words and of its last word, so a rare trigram is judged by the more frequent parts.

Digits count by their number (1994 as 9999). Padding and trailing dots are removed first. Null and empty texts are no cases;
texts without words are none. Repeated rows have one vote and are all decided. Words over MAX_WORD letters are never completions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from binweave.runtime import join_salted, materialise

MAX_WORD = 64


def words(text: Column) -> Column:
    """Words and single marks, digits as 9, without padding and trailing dots."""
    bare = F.regexp_replace(text, r"[\s\u0000.…]+$", "")
    return F.regexp_extract_all(F.regexp_replace(bare, "[0-9]", "9"), F.lit(r'([^\s\u0000.,;:“”"()–]+|[,;:“”"()–]|\.)'), 1)


#: The words that a gram is looked up by, from the whole trigram to its last word.
LEVELS = (("a", "b", "c"), ("b", "c"), ("c",))


def gram_counts(texts: DataFrame, finals: DataFrame | None = None) -> DataFrame:
    """(level, a, b, c, inside, ends, longer, trigrams) for the trigrams, pairs and words that end a text, or with finals, the
    different trigrams (a, b, c), for those that end one of these; words that a level does not look at are empty. inside and ends count texts in which the gram is followed by something, or is not; longer counts
    longer words that c begins in the same context, and trigrams the different final trigrams that the gram ends.

    All levels are summed together, with partial sums before each exchange; no gram is joined or collected.
    """
    grams = texts.select(F.explode(F.expr("transform(sequence(2, size(t) - 1), i -> struct(t[i - 2] AS a, t[i - 1] AS b, t[i] AS c, i + 1 = size(t) AS last))")).alias("g"))
    tri = grams.groupBy("g.a", "g.b", "g.c").agg(F.count_if(~F.col("g.last")).alias("inside"), F.count_if(F.col("g.last")).alias("ends"))
    tri = tri.withColumn("wanted", (F.col("ends") > 0).cast("int") if finals is None else F.lit(0))
    if finals is not None:
        none = F.lit(0).cast("bigint")
        tri = tri.unionByName(finals.select("a", "b", "c", none.alias("inside"), none.alias("ends"), F.lit(1).alias("wanted")))
    own = F.array(*[F.struct(F.lit(len(k)).alias("level"), *[(F.col(x) if x in k else F.lit("")).alias(x) for x in "ab"]) for k in LEVELS])
    base = tri.select(F.explode(own).alias("k"), "c", "inside", "ends", "wanted").groupBy("k.level", "k.a", "k.b", "c")
    base = base.agg(F.sum("inside").alias("inside"), F.sum("ends").alias("ends"), F.sum("wanted").alias("trigrams"))
    # A word as itself (l = 0), and as a longer word for each of its beginnings.
    words_of = F.expr(
        f"""transform(sequence(0, IF(inside > 0 AND length(c) <= {MAX_WORD}, greatest(length(c) - 1, 0), 0)), l -> named_struct(
        'c', IF(l = 0, c, substring(c, 1, l)), 'inside', IF(l = 0, inside, 0L), 'ends', IF(l = 0, ends, 0L), 'longer', IF(l = 0, 0L, inside), 'trigrams', IF(l = 0, trigrams, 0L)))"""
    )
    rows = base.select("level", "a", "b", F.explode(words_of).alias("v")).select("level", "a", "b", "v.*")
    return rows.groupBy("level", "a", "b", "c").agg(*[F.sum(x).alias(x) for x in ("inside", "ends", "longer", "trigrams")]).filter("trigrams > 0")


def cut_grams(counts: DataFrame, max_terminal: float, weight: float, support: int) -> DataFrame:
    """(a, b, c): the final trigrams after which a text is cut."""

    def level(keys: tuple[str, ...]) -> DataFrame:
        tag = "".join(keys)
        return counts.filter(F.col("level") == len(keys)).select(*keys, F.col("inside").alias(f"in_{tag}"), F.col("ends").alias(f"end_{tag}"), F.col("longer").alias(f"long_{tag}"), F.col("trigrams").alias(f"n_{tag}"))

    # Words and pairs that end many trigrams are joined in parts.
    ends = level(LEVELS[0])
    for keys in LEVELS[1:]:
        one = level(keys)
        tag = "".join(keys)
        ends = join_salted(ends, one, list(keys), one, f"n_{tag}")
    # A word that was never counted has no share, and is no word that cannot end a statement.
    share = F.try_divide(F.col("end_c"), F.col("in_c") + F.col("end_c"))
    for tag in ("bc", "abc"):
        share = (F.col(f"end_{tag}") + weight * share) / (F.col(f"in_{tag}") + F.col(f"end_{tag}") + weight)
    # A word that hardly ever ends a text in any context needs less evidence, one that often does needs more.
    alone = F.try_divide(F.col("end_c"), F.col("in_c") + F.col("end_c"))
    limit = F.when(alone <= max_terminal / 2, 3 * max_terminal).when(alone <= max_terminal, max_terminal).otherwise(max_terminal / 3)
    stops = F.coalesce((F.col("in_c") > 0) & (share <= limit), F.lit(False))
    inside_word = F.lit(False)
    for tag in ("c", "bc", "abc"):
        known = (F.col(f"in_{tag}") + F.col(f"long_{tag}")) >= (1 if tag == "c" else support)
        inside_word = F.when(known, (F.col(f"in_{tag}") == 0) & (F.col(f"long_{tag}") > F.col(f"end_{tag}"))).otherwise(inside_word)
    # A word that stands inside elsewhere is still cut here if its own context never knew it but knows many longer ones.
    return ends.filter(stops | inside_word).select("a", "b", "c")


def truncated(df: DataFrame, id_col: str, text_col: str, max_terminal: float = 0.055, weight: float = 100.0, support: int = 8, partial_col: str | None = None, learn_from: DataFrame | None = None) -> DataFrame:
    """(id_col) of the texts that were cut off. partial_col names a boolean column: true where the text ends inside an encoded
    character, which is a cut of itself. learn_from is a table of the texts to count in (default: df). Extra columns are ignored,
    whatever their names."""
    partial = F.coalesce(F.col(partial_col), F.lit(False)) if partial_col else F.lit(False)

    def texts(d: DataFrame, p: Column) -> DataFrame:
        """The different texts with words, their words and their number of rows."""
        own = d.select(F.col(text_col).alias("_text"), p.alias("_partial")).groupBy("_text", "_partial").agg(F.count("*").alias("n"))
        return own.select("_text", "_partial", "n", F.concat(F.array(F.lit("^"), F.lit("^")), words(F.col("_text"))).alias("t")).filter(F.size("t") > 2)

    # Equal texts have one vote, however many rows repeat them; texts that differ in their digits only have one each.
    own = materialise(texts(df, partial))
    counted = own if learn_from is None else texts(learn_from, F.lit(False))
    finals = own.select("_text", "_partial", *[F.element_at("t", i - 3).alias(x) for i, x in enumerate("abc")])
    grams = materialise(gram_counts(counted.select("_text", "t").distinct(), None if learn_from is None else finals.select("a", "b", "c").distinct()))
    # How many texts of df a trigram ends, for the join that divides frequent ones.
    frequent = grams.filter("level = 3") if learn_from is None else finals.groupBy("a", "b", "c").agg(F.count("*").alias("ends"))
    hits = join_salted(finals, cut_grams(grams, max_terminal, weight, support).withColumn("hit", F.lit(True)), ["a", "b", "c"], frequent, "ends", how="left")
    marked = hits.filter("hit OR _partial").select("_text", "_partial")
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("_text"), partial.alias("_partial"))
    return join_salted(rows, marked, ["_text", "_partial"], own, "n").select(F.col("id").alias(id_col))
