"""Texts decoded with the wrong character encoding: find them and restore the original where possible.

1. Words with non-ASCII characters are counted over the whole collection, per group of texts, in two ways: by different texts, and
   by rows, where the copies of a text count up to twice what is usual for the word (the median of its texts but the most copied),
   so the copies of one garbled text outvote nothing. Neither does alone: where texts are short, a large collection holds every
   text that a word can stand in, of the garbled word as of the clean one, and only the rows still tell them apart.
2. Twins: each word is joined with the commonest word of the same letters once non-ASCII characters are stripped. The two are
   aligned between their ASCII letters, which gives pairs of character runs; a transformation (the wrong decoder and the right
   one, once or twice applied) is inferred if it turns every run of the commoner word into that of the rarer one. Words with
   almost no ASCII letters have no such anchor; for them each possible transformation names the one word that would be the
   twin, and an equi-join looks it up. Nothing is compared pairwise within a group.
3. Transformations that explain enough different words are learned. They are at most a few hundred, whatever the data.
4. Learned transformations are applied to all words. A word is garbled if it holds U+FFFD; if it turns into valid multi-byte
   UTF-8; if it turns into a much commoner word; or, for words that were cut or never seen clean, if it holds characters that
   stand almost only in garbled words and turns into one that holds none of them.
5. A text is garbled if one of its words is. It is restored by the transformation most of its words name, word by word where
   that fails; what cannot be restored stays as it is, and a final incomplete character is dropped and reported.

Defined cases: null and empty texts are never garbled. Plain ASCII texts are never shipped to Python. A text of any length is
handled whole. Repeated rows are decided once and all reported.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from binweave.runtime import join_salted, materialise

#: Encodings by their Python names. Wrong decoders are single-byte; the right one may also be UTF-8.
SINGLE = ("cp1252", "latin_1", "cp437", "cp850", "cp1250", "cp1251", "cp866", "koi8_r", "mac_roman", "cp852", "iso8859_2", "iso8859_5", "iso8859_15", "mac_cyrillic", "cp1253", "iso8859_7", "cp737", "cp1254", "cp1257")
RIGHT = ("utf_8", *SINGLE)
WORD = r"[A-Za-z\x{80}-\x{10ffff}]*[\x{80}-\x{10ffff}][A-Za-z\x{80}-\x{10ffff}]*"
WORDS = re.compile("[A-Za-z\x80-\U0010ffff]*[\x80-\U0010ffff][A-Za-z\x80-\U0010ffff]*")
OTHER = re.compile("[\x80-\U0010ffff]+")
LOST = "\ufffd"


@lru_cache(maxsize=64)
def _bytes_of(encoding: str) -> dict[str, int]:
    """Character to byte. Bytes that the encoding leaves undefined stand for the control characters of the same number."""
    table = {}
    for b in range(256):
        try:
            c = bytes([b]).decode(encoding)
        except UnicodeDecodeError:
            c = chr(b)
        table.setdefault(c, b)
    return table


@lru_cache(maxsize=64)
def _chars_of(encoding: str) -> list[str]:
    table = [""] * 256
    for c, b in _bytes_of(encoding).items():
        table[b] = c
    for b in range(256):
        table[b] = table[b] or chr(b)
    return table


def undo(text: str, wrong: str, right: str, times: int = 1) -> tuple[str, bool] | None:
    """The text before `right` bytes were read as `wrong`, and whether a final incomplete character was dropped; else None."""
    for _ in range(times):
        table = _bytes_of(wrong)
        try:
            raw = bytes([table[c] for c in text])
        except KeyError:
            return None
        if right == "utf_8":
            try:
                new, cut = raw.decode("utf_8"), False
            except UnicodeDecodeError as e:
                if e.reason != "unexpected end of data" or e.end != len(raw):
                    return None
                new, cut = raw[: e.start].decode("utf_8"), True
        else:
            chars = _chars_of(right)
            new, cut = "".join(chars[b] for b in raw), False
        if new == text:
            return None
        text = new
        if cut:
            return text, True
    return text, False


def align(garbled: str, clean: str) -> list[tuple[str, str]]:
    """Pairs of non-ASCII runs between the same ASCII letters; both words have the same ASCII letters in the same order."""
    cut = lambda w: [x for x in re.split("([A-Za-z])", w)][::2]
    return [(g, c) for g, c in zip(cut(garbled), cut(clean)) if g or c]


UNIVERSE = [(w, r, 1) for r in RIGHT for w in SINGLE if w != r] + [(w, "utf_8", 2) for w in SINGLE]


def _explains(pairs: list[tuple[str, str]]) -> list[str]:
    out = []
    for wrong, right, times in UNIVERSE:
        if all(g != c or not g for g, c in pairs) and all(g and undo(g, wrong, right, times) == (c, False) for g, c in pairs):
            out.append(f"{wrong}>{right}>{times}")
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def _infer(garbled: pd.Series, clean: pd.Series) -> pd.Series:
    return pd.Series([_explains(align(g, c)) for g, c in zip(garbled, clean)])


def _apply(names: list[str]):
    steps = [(n, *n.split(">")) for n in names]

    @F.pandas_udf("array<struct<how string, word string, cut boolean>>")
    def apply(words: pd.Series) -> pd.Series:
        out = []
        for w in words:
            found = []
            for name, wrong, right, times in steps:
                if (got := undo(w, wrong, right, int(times))) and got[0].isprintable():
                    found.append({"how": name, "word": got[0], "cut": got[1]})
            out.append(found)
        return pd.Series(out)

    return apply


def _stripped(word: Column) -> Column:
    return F.regexp_replace(word, "[^A-Za-z]", "")


def word_counts(texts: DataFrame) -> DataFrame:
    """(grp, word, n, even) of the words with non-ASCII characters in the different texts (grp, text, copies). n is the number of
    texts; even that of their rows, with the copies of a text up to twice the lower median of the others than the most copied.
    A sole text counts once. The different numbers of copies, which one row holds, are at most the root of twice the rows."""
    words = texts.select("grp", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(WORD), 0))).alias("word"), "copies")
    sizes = words.groupBy("grp", "word", "copies").agg(F.count("*").alias("k"))
    counted = sizes.groupBy("grp", "word").agg(F.sum("k").alias("n"), F.sort_array(F.collect_list(F.struct("copies", "k"))).alias("sizes"))
    usual = "aggregate(sizes, struct(0L AS seen, 0L AS usual), (a, x) -> if(a.seen >= n div 2, a, struct(a.seen + x.k AS seen, x.copies AS usual))).usual"
    counted = counted.withColumn("usual", F.expr(usual))
    return counted.select("grp", "word", "n", F.expr("if(n = 1, 1L, aggregate(sizes, 0L, (a, x) -> a + x.k * least(x.copies, 2 * usual)))").alias("even"))


def _commoner(n: Column, even: Column, than_n: Column, than_even: Column, times: int) -> Column:
    """Whether a word of n texts and even rows is so many times as common as another: by texts, or, where it stands in no fewer
    than half as many, by rows."""
    return (n >= than_n * times) | ((n * 2 >= than_n) & (even >= than_even * times))


def learn(vocabulary: DataFrame, dominance: int = 3, support: int = 2) -> list[str]:
    """Names of the transformations that explain at least `support` different words by a twin `dominance` times as common."""
    known = vocabulary.filter(~F.col("word").contains(LOST)).withColumn("bare", _stripped(F.col("word")))
    anchored = known.filter(F.length("bare") >= 2)
    most = lambda *by: F.max_by(F.struct("word", "n", "even"), F.struct(*by, "word"))
    top = anchored.groupBy("grp", "bare").agg(F.array_distinct(F.array(most("n", "even"), most("even", "n"))).alias("tops"))
    twins = anchored.join(top.select("grp", "bare", F.explode("tops").alias("top")), ["grp", "bare"])
    twins = twins.filter((F.col("word") != F.col("top.word")) & _commoner(F.col("top.n"), F.col("top.even"), F.col("n"), F.col("even"), dominance))
    by_twin = twins.select("bare", F.explode(_infer(F.col("word"), F.col("top.word"))).alias("how"))
    # Words without anchors: the transformation names the only possible twin.
    loose = known.filter((F.length("bare") < 2) & (F.length("word") > 1))
    every = _apply([f"{w}>{r}>{t}" for w, r, t in UNIVERSE])
    named = loose.select("grp", F.col("n").alias("few"), F.col("even").alias("few_even"), F.explode(every(F.col("word"))).alias("c")).filter(~F.col("c.cut"))
    named = named.select("grp", "few", "few_even", F.col("c.how").alias("how"), F.col("c.word").alias("word"))
    by_name = named.join(known.select("grp", "word", "n", "even"), ["grp", "word"])
    by_name = by_name.filter(_commoner(F.col("n"), F.col("even"), F.col("few"), F.col("few_even"), dominance)).select(F.col("word").alias("bare"), "how")
    counted = by_twin.unionByName(by_name).groupBy("how").agg(F.countDistinct("bare").alias("k")).filter(F.col("k") >= support)
    return [r.how for r in counted.orderBy(F.desc("k"), "how").collect()]


def garbled_words(vocabulary: DataFrame, names: list[str], dominance: int = 3, most_groups: int = 10_000) -> DataFrame:
    """(grp, word, fixed, how, cut): garbled words, with what they were, null if that cannot be told. Facts on up to most_groups
    groups are broadcast."""
    few = vocabulary.select("grp").distinct().limit(most_groups + 1).count() <= most_groups
    lost = vocabulary.filter(F.col("word").contains(LOST)).select("grp", "word", F.lit(None).cast("string").alias("fixed"), F.lit(None).cast("string").alias("how"), F.lit(False).alias("cut"))
    fine = vocabulary.filter(~F.col("word").contains(LOST))
    tried = fine.select("grp", "word", "n", "even", F.explode(_apply(names)(F.col("word"))).alias("c")).select("grp", "word", "n", "even", F.col("c.how").alias("how"), F.col("c.word").alias("fixed"), F.col("c.cut").alias("cut"))
    tried = materialise(tried.join(fine.select("grp", F.col("word").alias("fixed"), F.col("n").alias("many"), F.col("even").alias("many_even")), ["grp", "fixed"], "left"))
    to_utf8 = F.col("how").contains(">utf_8>")
    texts, known = F.coalesce(F.col("many"), F.lit(0)), F.coalesce(F.col("many_even"), F.lit(0))
    sure = (to_utf8 & (F.col("fixed").rlike("[^\\x00-\\x7f]") | ~F.col("cut")) & ~F.col("fixed").rlike("[\\x{80}-\\x{9f}]")) | _commoner(texts, known, F.col("n"), F.col("even"), dominance)
    best = F.max_by(F.struct("fixed", "how", "cut"), F.struct(known, to_utf8, F.substring("how", -1, 1), ~F.col("cut"), F.col("how")))
    first = materialise(tried.filter(sure).groupBy("grp", "word").agg(best.alias("b")).select("grp", "word", "b.*"))

    # Characters that stand mostly in garbled words, by texts and by rows, are foreign to the group. A word that turns into one at
    # least as common is undecided by counts, so it does not vouch for its own characters.
    undecided = tried.filter((texts * 2 >= F.col("n")) & (known >= F.col("even"))).select("grp", "word").distinct()
    letters = lambda df, c: df.select("grp", "n", "even", F.explode(F.array_distinct(F.split(F.regexp_replace(c, "[\\x00-\\x7f]", ""), ""))).alias("ch")).filter("ch <> ''")
    others = fine.join(first.select("grp", "word"), ["grp", "word"], "left_anti")
    held = letters(others, F.col("word")).select("grp", "ch").distinct()
    vouched = letters(others.join(undecided, ["grp", "word"], "left_anti"), F.col("word")).groupBy("grp", "ch").agg(F.sum("n").alias("clean"), F.sum("even").alias("clean_even"))
    bad = letters(fine.join(first.select("grp", "word"), ["grp", "word"]), F.col("word")).groupBy("grp", "ch").agg(F.sum("n").alias("dirty"), F.sum("even").alias("dirty_even"))
    foreign = bad.join(vouched, ["grp", "ch"], "left").filter((F.col("dirty") > 2 * F.coalesce("clean", F.lit(0))) & (F.col("dirty_even") > 2 * F.coalesce("clean_even", F.lit(0))))
    foreign = foreign.groupBy("grp").agg(F.array_join(F.array_sort(F.collect_set("ch")), "").alias("foreign"))
    rest = _by_group(tried.join(first.select("grp", "word"), ["grp", "word"], "left_anti"), foreign, "inner", few)
    second = rest.filter((F.expr("length(translate(word, foreign, ''))") < F.length("word")) & (F.expr("length(translate(fixed, foreign, ''))") == F.length("fixed")) & (F.expr("length(fixed)") > 0))
    second = second.filter(~F.col("fixed").rlike("[\\x{80}-\\x{9f}]"))
    inventory = held.groupBy("grp").agg(F.array_join(F.array_sort(F.collect_set("ch")), "").alias("own"))
    second = _by_group(second, inventory, "left", few).filter(F.expr("length(translate(regexp_replace(fixed, '[\\\\x00-\\\\x7f]', ''), coalesce(own, ''), '')) = 0"))
    second = second.groupBy("grp", "word").agg(best.alias("b")).select("grp", "word", "b.*")
    cols = ["grp", "word", "fixed", "how", "cut"]
    return lost.select(*cols).unionByName(first.select(*cols)).unionByName(second.select(*cols))


def _by_group(rows: DataFrame, facts: DataFrame, how: str, few: bool) -> DataFrame:
    """Rows with the one row of their group in facts, which is a text of different characters. A few groups are broadcast; of
    many, those that hold many rows are divided."""
    if few:
        return rows.join(F.broadcast(facts), "grp", how)
    return join_salted(rows, facts, ["grp"], rows.groupBy("grp").count(), "count", how=how)


_REPAIRED = "grp string, text string, restored string, partial boolean, how string"


def _repair(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in batches:
        out = []
        for text, found in zip(frame["text"], frame["found"]):
            known = {f["word"]: f for f in found}
            names: dict[str, int] = {}
            for f in found:
                if f["how"]:
                    names[f["how"]] = names.get(f["how"], 0) + 1
            whole, partial, used = None, False, None
            for how in sorted(names, key=lambda h: (-names[h], h)):
                wrong, right, times = how.split(">")
                if LOST not in text and (got := undo(text, wrong, right, int(times))) and all(f["fixed"] is None or f["fixed"] in got[0] for f in found):
                    whole, partial, used = got[0], got[1], how
                    break
            if whole is None:
                def one(m: re.Match) -> str:
                    f = known.get(m.group(0))
                    return m.group(0) if f is None or f["fixed"] is None else f["fixed"]

                whole = WORDS.sub(one, text)
                last = list(WORDS.finditer(text))[-1]
                end = known.get(last.group(0))
                partial = bool(end is not None and end["cut"] and last.end() == len(text.rstrip(" .\0")))
                used = max(names, key=lambda h: (names[h], h)) if names else None
            out.append((whole if whole != text else None, partial, used))
        yield pd.DataFrame({"grp": frame["grp"], "text": frame["text"], "restored": [o[0] for o in out], "partial": [o[1] for o in out], "how": [o[2] for o in out]})


def _distinct_texts(df: DataFrame, group_col: str, text_col: str) -> DataFrame:
    """(grp, text, copies): the different texts with non-ASCII characters; no other can be garbled."""
    texts = df.select(F.col(group_col).cast("string").alias("grp"), F.col(text_col).alias("text")).filter(F.col("text").rlike("[^\\x00-\\x7f]"))
    return materialise(texts.groupBy("grp", "text").agg(F.count("*").alias("copies")))


def _repaired(texts: DataFrame) -> DataFrame:
    """(grp, text, restored, partial, how): one row per garbled text among different texts."""
    vocabulary = materialise(word_counts(texts))
    words = garbled_words(vocabulary, learn(vocabulary))
    stand = texts.select("grp", "text", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(WORD), 0))).alias("word"))
    hits = join_salted(stand, words, ["grp", "word"], vocabulary, "n").groupBy("grp", "text").agg(F.collect_list(F.struct("word", "fixed", "how", "cut")).alias("found"))
    return hits.mapInPandas(_repair, _REPAIRED)


def repair_table(df: DataFrame, group_col: str, text_col: str) -> DataFrame:
    """(grp, text, restored, partial, how): one row per distinct garbled text. restored is null where nothing could be
    restored; partial tells that the text ended inside an encoded character, which is dropped from restored."""
    return _repaired(_distinct_texts(df, group_col, text_col))


def _joined(df: DataFrame, group_col: str, text_col: str, how: str) -> DataFrame:
    texts = _distinct_texts(df, group_col, text_col)
    # The result is often read more than once; the restoring is not.
    fixed = materialise(_repaired(texts)).toDF("_g", "_t", "restored_text", "partial_end", "transformation")
    rows = df.drop("restored_text", "partial_end", "transformation").filter(F.col(text_col).rlike("[^\\x00-\\x7f]"))
    rows = rows.withColumn("_g", F.col(group_col).cast("string")).withColumn("_t", F.col(text_col))
    return join_salted(rows, fixed, ["_g", "_t"], texts.toDF("_g", "_t", "n"), "n", how=how).drop("_g", "_t")


def garbled(df: DataFrame, group_col: str, text_col: str) -> DataFrame:
    """The rows of df whose text is garbled, with the columns restored_text, partial_end and transformation added (replaced
    if df has such columns). All other columns are kept. A text of many copies is joined in parts."""
    return _joined(df, group_col, text_col, "inner")


def with_restored(df: DataFrame, group_col: str, text_col: str) -> DataFrame:
    """All rows of df with the columns of garbled, null where the text is sound. ASCII and null texts are in no join."""
    others = df.drop("restored_text", "partial_end", "transformation").filter(~F.coalesce(F.col(text_col).rlike("[^\\x00-\\x7f]"), F.lit(False)))
    return _joined(df, group_col, text_col, "left").unionByName(others, allowMissingColumns=True)
