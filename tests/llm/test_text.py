import random

import numpy as np
from pyspark.sql import functions as F

from binweave.llm import leakage, mojibake, quality
from binweave.llm.truncation import truncated

SECOND, FIRST, TAIL = ["Korvenpää", "Typeworks", "Übermark"], ["Norbekk", "Fonderie"], ["", " Inc", " GmbH"]
ENDS = ["", ". All rights reserved.", ". Freely usable without warranty of merchantability."]


def statements(n, seed=1):
    r = random.Random(seed)
    return [f"Copyright {r.randint(1985, 2004)}, {r.choice(FIRST)} {r.choice(SECOND)}{r.choice(TAIL)}{r.choice(ENDS)}" for _ in range(n)]


def test_truncation(spark):
    whole = statements(3000)
    cut = ["Copyright 1990, Norbekk", "Copyright 1991, Fonderie Typewo", "Copyright 1992, Norbekk Korvenpä", "Copyright 1993, Norbekk Typeworks. All rights", "Copyright 1994, Fonderie Übermark. Freely usable without...", "Copyright 1995, Norbekk Übermark Inc. All ri   ", "Copyright 1996,\0\0"]
    none = [None, "", "   ", "...", "\0", "Copyright 1999, Norbekk Typeworks", "Copyright 1999, Norbekk Typeworks Inc  "]
    rows = [(i, t, 1) for i, t in enumerate([*whole, *cut, *none])]
    got = {r[0] for r in truncated(spark.createDataFrame(rows, "id long, text string, n int"), "id", "text").collect()}
    assert got == set(range(len(whole), len(whole) + len(cut)))


def test_copies_of_a_cut_text_do_not_make_its_end_terminal(spark):
    whole = statements(3000)
    cut = ["Copyright 1991, Fonderie Typewo", "Copyright 1993, Norbekk Typeworks. All rights", "Copyright 1990, Norbekk"]
    for copied in cut[:2]:
        texts = [*whole, *cut, *[copied] * 1500]
        df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
        assert {r.id for r in truncated(df, "id", "text").collect()} == set(range(len(whole), len(texts))), copied


def test_truncation_learned_from_other_texts(spark):
    cut = ["Copyright 1991, Fonderie Typewo", "Copyright 1993, Norbekk Typeworks. All rights", "Copyright 1996,"]
    fine = ["Copyright 1999, Norbekk Typeworks", "Copyright 1999, Fonderie Korvenpää Inc", "Copyright 1999, Unknown"]
    df = spark.createDataFrame(list(enumerate(cut + fine)), "id long, text string")
    learned = spark.createDataFrame([(t,) for t in statements(3000)], "text string")
    assert {r.id for r in truncated(df, "id", "text", learn_from=learned).collect()} == {0, 1, 2}


def test_truncation_without_rows_and_partial_character(spark):
    assert truncated(spark.createDataFrame([], "id long, text string"), "id", "text").collect() == []
    rows = [(1, "One word", True), (2, "One word", None), (3, "z" * 50_000, False)]
    assert [r.id for r in truncated(spark.createDataFrame(rows, "id long, text string, p boolean"), "id", "text", partial_col="p").collect()] == [1]


CLEAN = ["Größe", "résumé", "øvelse", "Übersicht", "año", "данные", "отчёт", "“Entwurf”", "Ελλην"]


def test_garbled_words_are_found_and_restored(spark):
    rows, want = [], {}
    for k in range(60):
        for w in CLEAN:
            rows.append((len(rows), "g", f"{w}{k}.txt"))
    pairs = [("utf_8", "cp1252"), ("utf_8", "cp437"), ("utf_8", "latin_1"), ("cp1252", "cp437"), ("cp850", "latin_1"), ("cp1251", "latin_1"), ("koi8_r", "cp1251"), ("cp1251", "cp866")]
    for right, wrong in pairs:
        for k in range(3):
            for w in CLEAN:
                try:
                    bad = w.encode(right).decode(wrong)
                except UnicodeError:
                    continue
                if bad != w:
                    want[len(rows)] = f"{w}{k}.doc"
                    rows.append((len(rows), "g", f"{bad}{k}.doc"))
    lost = {len(rows): None, len(rows) + 1: None}
    rows += [(len(rows), "g", "Gr\ufffd\ufffde.txt"), (len(rows) + 1, "g", "\ufffd")]
    fine = [(len(rows), "g", None), (len(rows) + 1, "g", ""), (len(rows) + 2, "g", "plain.txt"), (len(rows) + 3, "g", "Grö"), (len(rows) + 4, "g", "é" * 30_000)]
    df = spark.createDataFrame(rows + fine, "id long, grp string, text string")
    got = {r.id: r.restored_text for r in mojibake.garbled(df, "grp", "text").collect()}
    assert set(got) == set(want) | set(lost)
    right = sum(got[i] == w for i, w in want.items())
    assert right >= 0.95 * len(want), [(rows[i][2], w, got[i]) for i, w in want.items() if got[i] != w][:9]


def test_copies_of_a_garbled_text_do_not_outvote_the_clean_ones(spark):
    clean = [f"{w}{k}.txt" for k in range(60) for w in ("Größe", "Übersicht", "CHÂTEAU")]
    spoil = lambda w: w.encode("cp1252").decode("cp437")
    bad = [spoil(w) for w in ("Größe.doc", "Übersicht.doc", "PÂTÉ.doc")]
    # As many different texts hold the garbled form as the clean one; a third of all rows are copies of one text.
    tied = ["FENÊTRE", "FENÊTRE "]
    tied_bad = [spoil(w) for w in tied]
    more = [f"{w}{k}.txt" for k in range(60) for w in ("PÂTÉ", "FORÊT", "ÊTRE")] + [spoil("FORÊT.doc"), spoil("ÊTRE.doc")]
    for copied in (bad[0], bad[1], tied_bad[0]):
        texts = [*clean, *tied * 30, *more, *bad, *tied_bad]
        texts += [copied] * (len(texts) // 2)
        df = spark.createDataFrame([(i, "g", t) for i, t in enumerate(texts)], "id long, grp string, text string")
        want = {i for i, t in enumerate(texts) if t in {*bad, *tied_bad, spoil("FORÊT.doc"), spoil("ÊTRE.doc")}}
        assert {r.id for r in mojibake.garbled(df, "grp", "text").collect()} == want, copied


def test_garbled_words_that_stand_in_as_many_texts_as_the_clean_ones(spark):
    # A large collection holds every text there is: each word with each number, garbled or not. Only the rows differ.
    kinds = [f"{w}{k}" for w in ("GRÜN", "FORÊT", "CAFÉ", "MÃE", "MÜLL", "PÂTE", "AÇÃO") for k in range(10)]
    bad = [t.encode(right).decode(wrong) for right, wrong in (("cp1252", "cp850"), ("cp850", "latin_1")) for t in kinds]
    for copies in (0, 2000):
        texts = [*kinds * 40, *bad * 2, *[bad[0]] * copies]
        df = spark.createDataFrame([(i, "g", t) for i, t in enumerate(texts)], "id long, grp string, text string")
        assert {r.id for r in mojibake.garbled(df, "grp", "text").collect()} == set(range(len(kinds) * 40, len(texts))), copies


def test_word_counts_by_texts_and_by_rows(spark):
    copies = {"é": [7], "ö": [1, 900], "ü": [3, 4, 5, 900], "ä": [10] * 9 + [11]}
    texts = [("g", f"{w} {i}", n) for w, ns in copies.items() for i, n in enumerate(ns)]
    got = mojibake.word_counts(spark.createDataFrame(texts, "grp string, text string, copies long")).collect()
    assert {r.word: (r.n, r.even) for r in got} == {"é": (1, 1), "ö": (2, 3), "ü": (4, 20), "ä": (10, 101)}


def test_garbled_edge_cases(spark):
    df = spark.createDataFrame([], "id long, grp string, text string")
    assert mojibake.garbled(df, "grp", "text").collect() == []
    assert mojibake.undo("GrÃ¶ÃŸe", "cp1252", "utf_8") == ("Größe", False)
    assert mojibake.undo("GrÃ¶Ã", "cp1252", "utf_8") == ("Grö", True)
    assert mojibake.undo("Größe", "cp1252", "utf_8") is None
    assert mojibake.align("GrÃ¶ÃŸe", "Größe") == [("Ã¶ÃŸ", "öß")]


def passages(n=12, seed=3):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    return [(i, " ".join(r.choice(vocabulary) for _ in range(r.randint(10, 60)))) for i in range(n)]


def brute(docs, items, n):
    """The longest match of every document and passage with its places, of equal ones the first."""
    out = {}
    for d, t in docs:
        w = leakage.words(t)
        for k, x in items:
            v = leakage.words(x)
            for i in range(len(w)):
                for j in range(len(v)):
                    m = 0
                    while i + m < len(w) and j + m < len(v) and w[i + m] == v[j + m]:
                        m += 1
                    if m >= n:
                        out[d, k] = max(out.get((d, k), (0, 0, 0)), (m, -i, -j))
    return {k: (m, -i, -j) for k, (m, i, j) in out.items()}


def test_leaks_against_brute_force(spark):
    r, items = random.Random(8), passages()
    # Equal passages, passages that share a stretch after different words, and repeated ids.
    shared = max((t for _, t in items), key=len)
    items += [(50, shared), (51, "short text"), (None, items[1][1]), (52, None), (53, "w1 w2 " + shared), (54, "w3 " + shared + " w4"), (55, shared + " " + shared), (55, items[4][1])]
    docs = []
    for d in range(60):
        words = [f"w{r.randrange(70)}" for _ in range(r.randint(0, 80))]
        if d % 3 == 0:
            own = items[r.randrange(12)][1].split()
            a = r.randrange(max(1, len(own) - 12))
            words[5:5] = own[a : a + r.randint(8, 30)]
        docs.append((d, (" , " if d % 2 else "\n% ").join(words).upper()))
    docs += [(100, None), (101, ""), (None, items[0][1]), (102, items[3][1] + " " + items[3][1]), (102, items[3][1]), (103, "w2 " + shared), (104, shared + " w9 " + shared + " w4"), (105, "w7 " * 40)]
    items.append((56, "w7 " * 30))
    df = spark.createDataFrame([(*x, "e") for x in docs], "doc_id long, text string, item string")
    known = [(k, x) for k, x in items if k is not None and x is not None]
    want = brute([(d, t) for d, t in docs if d is not None and t], known, 13)
    assert {k for _, k in want} >= {50, 53, 54, 55, 56}
    it = spark.createDataFrame(items, "item_id long, text string")
    for block, shard in ((16_000_000, 4_000_000), (700, 4_000_000), (16_000_000, 500), (1, 1)):
        found = leakage.leaks(df, "doc_id", "text", it, "item_id", "text", block_chars=block, shard_chars=shard)
        assert {(x.doc_id, x.item_id): (x.n_words, x.doc_word, x.item_word) for x in found.collect()} == want, (block, shard)
    assert leakage.leaks(df.limit(0), "doc_id", "text", it, "item_id", "text").collect() == []
    assert leakage.leaks(df, "doc_id", "text", it.limit(0), "item_id", "text").collect() == []


def test_suffix_arrays_are_in_full_order():
    r = random.Random(2)
    for _ in range(60):
        codes = [c for _ in range(r.randint(0, 5)) for c in [*([r.randint(1, 3) for _ in range(r.randint(0, 40))] * r.randint(1, 3)), 0]]
        suffix = lambda i: (codes[i : codes.index(0, i)], i)
        assert leakage.suffix_array(np.array(codes, dtype=np.int64)).tolist() == sorted((i for i, c in enumerate(codes) if c), key=suffix)
    for n in (0, 5, 1 << 24):
        values = np.array([n, 0, 7])
        assert leakage._unpack(leakage._pack(values)).tolist() == values.tolist()


def test_copies_of_a_passage_and_a_document(spark):
    text = " ".join(f"w{i}" for i in range(40))
    df = spark.createDataFrame([(i, text) for i in range(300)], "doc_id long, text string")
    it = spark.createDataFrame([(i, text) for i in range(50)], "item_id long, text string")
    found = leakage.leaks(df, "doc_id", "text", it, "item_id", "text")
    assert found.count() == 15_000 and found.select("n_words", "doc_word", "item_word").distinct().collect() == [(40, 0, 0)]
    assert leakage.without_leaks(df, "doc_id", found).count() == 0


def test_words_of_tex():
    assert leakage.words(r"Gr{\"o}{\ss}e, gr\"o\ss e \'{e}tude \emph{l\'ab} \c{c}a \alpha x%y") == ["größe", "größe", "étude", "láb", "ça", "x", "y"]
    assert leakage.words(None) == [] and leakage.words("\\section*{One} a\\\\b") == ["one", "a", "b"]


COMMON = frozenset(["the", "of", "and", "is"])
PROSE = "The lattice of the model is stable and the gradient of the field is weak. " * 3
TEXTS = [
    "\\documentclass{x}\n\\begin{document}\n" + (PROSE + "\n\n") * 6 + "\\end{document}\nafter the end", "\\item one two\n" * 40, "a & 1 & 2 \\\\\n" * 40, "x,1,2.5,--\n" * 30, "~" * 70_000, "3f" * 5_000,
    "lorq " * 3000, PROSE * 200, "wave (dark) 3, 12, 99\n" * 30, "12. alpha -- beta\n" * 30, "", "   \n \n", "one", "word " * 5, "\r\n".join([PROSE] * 9), "ß" * 500 + " " + "the " * 20, "12.5 7.1 moveto\n" * 50,
]
# A single word that ends no sentence reads as an entry of a list; a line of one or two repeated words is junk.
SHAPES = [None, "list", "table", "table", "junk", "junk", "junk", None, "list", "list", None, None, "list", None, None, "junk", "junk"]


PIECES = ["a", "b", "c", "ab", "the", " ", "  ", "\t", "\n", "\n", "&", "|", "\\", "1", "2,", "3;", "--", "–", "%", "\\item ", "\\begin{document}", "\\end{document}", "Σας", "é", "\x01", "¬", "x" * 40, "x" * 31, "12,3,4" + "5" * 30, ".", "!)", "of the field is weak and the model "]


def test_states_are_the_same_wherever_a_text_is_cut():
    r = random.Random(5)
    texts = ["a ab c ab ab c c", *[t[:3000] for t in TEXTS], *["".join(r.choice(PIECES) for _ in range(r.randint(0, 40))) for _ in range(400)]]
    for t in texts:
        whole = quality.finish(quality.state_of(t, COMMON))
        steps = [1, 2, 5, 17] if len(t) < 500 else [97, 300]
        for k in steps:
            cuts = sorted({0, len(t), *range(r.randint(0, k), len(t), k)})
            pieces = [quality.state_of(t[i:j], COMMON, t[max(0, i - 20) : i], t[j : j + 20]) for i, j in zip(cuts, cuts[1:])] or [quality.state_of("", COMMON)]
            while len(pieces) > 1:
                i = r.randrange(len(pieces) - 1)
                pieces[i : i + 2] = [quality.merge(pieces[i], pieces[i + 1], COMMON)]
            assert quality.finish(pieces[0]) == whole, (t[:60], k)


def test_every_cut_of_one_line():
    for t in ("a ab c ab ab c c", "Word, one  two\t3 & 4 \\\\", "%% %% %% %% %% %%", "x" * 70 + " " + "x" * 70 + " y", "  a,1;b,2,3 -- "):
        for i in range(len(t) + 1):
            for j in range(i, len(t) + 1):
                joined = quality.join_parts(quality.join_parts(quality.part_of(t[:i]), quality.part_of(t[i:j])), quality.part_of(t[j:]))
                got, want = quality.whole_line(joined), quality.line_of(t)
                # Which of many different words are kept does not matter, only how many up to three.
                assert len(got.counts.few) == len(want.counts.few), (t, i, j)
                got.counts.few = want.counts.few
                assert got == want, (t, i, j)


def test_junk_of_repeated_and_random_characters():
    noise = "".join(chr(c) for c in random.Random(1).choices(range(1, 256), k=4000))
    for t in ("%% %% %% %% %% %% %% %%\n" * 40, noise, noise.replace("%", "&")):
        assert quality.finish(quality.state_of(t, COMMON))[-1] == "junk"
    assert quality.finish(quality.state_of("% a comment of some words that is left out\n" + PROSE, COMMON))[-1] is None


def test_statistics(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(99, None, "x"), (0, TEXTS[0], "x")]
    df = spark.createDataFrame(rows, "id long, text string, state string")
    for chunk, fan in ((65_536, 64), (100, 3)):
        got = quality.text_statistics(df, "id", "text", list(COMMON), chunk, fan).collect()
        assert len(got) == len(rows)
        by = {r.id: r for r in got}
        assert [by[i].shape for i in range(len(TEXTS))] == SHAPES
        assert by[99].n_words is None and by[10].n_words == 0 and by[10].mean_word_length is None and by[12].n_words == 1
        assert by[13].mean_word_length == 4 and by[1].n_words == 120 and by[1].ended_line_share == 0
    assert quality.text_statistics(df.limit(0), "id", "text", []).collect() == []


def test_statistics_count_every_document(spark):
    df = spark.range(500).select(F.col("id"), F.concat_ws(" ", F.lit("The model of the field"), F.col("id").cast("string")).alias("text"))
    assert quality.text_statistics(df, "id", "text", ["the", "of"]).agg(F.sum("n_words")).first()[0] == 3000


def test_chunks_of_one_long_document_are_spread(spark):
    df = spark.createDataFrame([(1, PROSE * 20_000)], "id long, text string")
    out = quality.text_statistics(df, "id", "text", list(COMMON))
    assert out.first().n_words == 20_000 * len(PROSE.split()) and out.first().shape is None
