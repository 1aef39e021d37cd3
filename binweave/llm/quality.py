"""Per-document text statistics, and documents that are not running prose, from partial counts of chunks.

Texts are cut into chunks of CHUNK characters. Each chunk gives a state that is associative under merging: counts of its whole
lines by kind, between the marks that begin and end the document body, and open states for its first and last line and word. When
two chunks are joined, their boundary states are corrected: a word cut in two counts once and is looked up as a whole, and a line
cut in two is classified by the features of both parts. The result is the same wherever a text is cut. A document of one chunk is
done where it is read; the chunks of longer ones are cut in one pass, spread over all tasks, and their states merged by tree
aggregation, FAN at a time, in the order of their chunks. Then ratios and rule outcomes are derived. No task ever holds more than
FAN states of a document.

A line is a comment or mark-up (neutral), running prose, a list entry, a table row, or junk (encoded data, drawing commands,
repeated or random characters), by counts over its words. A document is not prose if prose makes less than half of the
characters of its body that are not neutral; its shape is the kind that makes most of the rest.

Defined cases: a null text has null statistics and no shape; an empty or blank one has zero words, null ratios and no shape.
Words over KEEP letters are never common, and are equal if they agree in length, their first KEEP and their last TAIL letters.
Repeated ids are documents of their own. Missing marks leave the body open at that side; the first begin and the first end after
it count. A final sigma is the letter sigma.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from binweave.runtime import materialise

CHUNK, FAN, LOOK, KEEP, TAIL = 65_536, 64, 20, 64, 8
BEGIN, END = "\\begin{document}", "\\end{document}"
KINDS = ("prose", "list", "table", "junk", "neutral")
_WORD = re.compile(r"[^\W_]+")
_ACCENTED = re.compile(r"\\['`^\"~=.]|\\(?:ss|[oOlLij])\b|[{}\\]")
_SPACES = tuple(c for c in map(chr, range(0x3001)) if c.isspace())
_NUMBER = re.compile(r"[-+(]?\d+(?:[.,:/–-]+\d+)*%?[),;.]*|--[,;]?")
_GAP = re.compile(r"\S {2,}(?=\S)")
_MARK = re.compile(r"(\\(?:begin|end)\{document\})")
#: Control characters, and signs beyond ASCII that are neither letters nor usual in print.
_ODD = re.compile("[\x00-\x08\x0e-\x1b\x7f-\x84\x86-\x9f]|[^\\w\\s\x00-\x9f–—…“”„‘’‚«»‹›·•°§¿¡×±†‡©®™€£]")
_VOWELS = frozenset("aeiouyAEIOUYàáâãäåæèéêëìíîïòóôõöøœùúûüýÿÀÁÂÃÄÅÆÈÉÊËÌÍÎÏÒÓÔÕÖØŒÙÚÛÜÝąęıőűāēīōūαεηιουωаеиоуыэюяіїєё")
_LIST_COMMANDS = ("\\item", "\\bibitem", "\\newblock")
_STOPS = frozenset(".!?:;…。！？")
_CLOSERS = "\"'”’»)]}"


@dataclass
class Counts:
    """Sums over words, and up to three different ones."""

    tokens: int = 0
    numbers: int = 0
    good: int = 0
    good_chars: int = 0
    long_chars: int = 0
    packed: int = 0
    dashes: int = 0
    few: frozenset = frozenset()

    def add(self, w: str, size: int, seps: int | None = None, digit: bool | None = None) -> None:
        """A word; of one over 30 letters only its size, separators and whether it has a digit are used."""
        self.tokens += 1
        if size < 30 and w.isalpha() and not _VOWELS.isdisjoint(w):
            self.good += 1
            self.good_chars += size
            return
        if seps is None:
            seps = w.count(",") + w.count(";")
        if size > 4 and seps >= 2 and (any(c.isdigit() for c in w) if digit is None else digit):
            self.packed += 1
        elif size >= 30:
            self.long_chars += size
        elif _NUMBER.fullmatch(w):
            self.numbers += 1
        else:
            bare = (_ACCENTED.sub("", w) if "\\" in w else w).strip(".,;:!?()[]\"“”„'’`~").replace("-", "").replace("'", "").replace("’", "")
            if bare.isalpha() and not _VOWELS.isdisjoint(bare):
                self.good += 1
                self.good_chars += size
        if w in ("--", "–", "—"):
            self.dashes += 1

    def plus(self, other: Counts) -> Counts:
        few = self.few | other.few
        sums = [getattr(self, k) + getattr(other, k) for k in _COUNTED]
        return Counts(*sums, few if len(few) < 4 else frozenset(sorted(few, key=repr)[:3]))


_COUNTED = ("tokens", "numbers", "good", "good_chars", "long_chars", "packed", "dashes")


@dataclass
class Line:
    """The features of a whole line: counts of its words, and of signs in it."""

    counts: Counts
    chars: int = 0
    cells: int = 0
    pipes: int = 0
    tabs: int = 0
    gaps: int = 0
    odd: int = 0
    first: str = ""
    last: str = ""


def _odd(text: str) -> int:
    return 0 if text.isascii() and text.isprintable() else len(_ODD.findall(text))


def _identity(w: str) -> str | tuple:
    return w if len(w) <= KEEP else (len(w), w[:KEEP], w[-TAIL:])


def line_of(text: str) -> Line:
    words, counts = text.split(), Counts()
    for w in words:
        counts.add(w, len(w))
    counts.few = frozenset(list(set(map(_identity, words)))[:3])
    return Line(
        counts, sum(map(len, words)), text.count("&"), text.count("|"), text.strip().count("\t") if "\t" in text else 0, len(_GAP.findall(text)) if "  " in text else 0,
        _odd(text), text.lstrip()[:KEEP], words[-1][-TAIL:] if words else "",
    )


@dataclass(frozen=True)
class Token:
    """A word at the end of a part of a line: its first KEEP and last TAIL letters, and what add needs of a long one."""

    head: str
    tail: str
    size: int
    seps: int
    digit: bool

    @classmethod
    def of(cls, w: str) -> Token:
        return cls(w[:KEEP], w[-TAIL:], len(w), w.count(",") + w.count(";"), any(c.isdigit() for c in w))

    def joined(self, other: Token) -> Token:
        head = (self.head + other.head)[:KEEP] if self.size < KEEP else self.head
        tail = (self.tail + other.tail)[-TAIL:] if other.size < TAIL else other.tail
        return Token(head, tail, self.size + other.size, self.seps + other.seps, self.digit or other.digit)

    def counts(self) -> Counts:
        c = Counts()
        c.add(self.head, self.size, self.seps, self.digit)
        c.few = frozenset([self.head if self.size <= KEEP else (self.size, self.head, self.tail)])
        return c


@dataclass(frozen=True)
class Blank:
    """A run of white space: its length, whether it is spaces only, and its tabs."""

    size: int = 0
    plain: bool = True
    tabs: int = 0

    @classmethod
    def of(cls, text: str) -> Blank:
        return cls(len(text), not text.strip(" "), text.count("\t"))

    def joined(self, other: Blank) -> Blank:
        return Blank(self.size + other.size, self.plain and other.plain, self.tabs + other.tabs)


@dataclass(frozen=True)
class Part:
    """A part of a line: white space, first word, counts of the words between, last word, white space. A part of one word has
    no last word, a part of none only the white space before. raw is how it begins, first how its words begin."""

    before: Blank = Blank()
    head: Token | None = None
    between: Counts = field(default_factory=Counts)
    last: Token | None = None
    after: Blank = Blank()
    chars: int = 0
    cells: int = 0
    pipes: int = 0
    tabs: int = 0
    gaps: int = 0
    odd: int = 0
    raw: str = ""
    first: str = ""

    @property
    def tail(self) -> Token:
        return self.last or self.head


def part_of(text: str) -> Part:
    bare = text.strip()
    if not bare:
        return Part(Blank.of(text), raw=text[:KEEP])
    start = text.index(bare[0])
    words, between = bare.split(), Counts()
    for w in words[1:-1]:
        between.add(w, len(w))
    between.few = frozenset(list(set(map(_identity, words[1:-1])))[:3])
    return Part(
        Blank.of(text[:start]), Token.of(words[0]), between, Token.of(words[-1]) if len(words) > 1 else None, Blank.of(text[start + len(bare) :]),
        sum(map(len, words)), bare.count("&"), bare.count("|"), bare.count("\t"), len(_GAP.findall(bare)), _odd(text), text[:KEEP], bare[:KEEP] if len(bare) >= KEEP else text[start : start + KEEP],
    )


def join_parts(a: Part, b: Part) -> Part:
    """Two adjacent parts of one line as one; a word that the cut divided counts as one word."""
    raw = (a.raw + b.raw)[:KEEP]
    odd = a.odd + b.odd
    if a.head is None:
        return replace(b, before=a.before.joined(b.before), raw=raw, odd=odd)
    first = (a.first + b.raw)[:KEEP]
    if b.head is None:
        return replace(a, after=a.after.joined(b.before), raw=raw, first=first, odd=odd)
    gap = a.after.joined(b.before)
    one, between = (a.tail.joined(b.head), Counts()) if not gap.size else (None, Counts())
    head, last = a.head, b.tail
    between = a.between.plus(b.between)
    if one is None:
        between = between.plus(a.last.counts()) if a.last else between
        between = between.plus(b.head.counts()) if b.last else between
    elif a.last and b.last:
        between = between.plus(one.counts())
    elif a.last:
        last = one
    else:
        head, last = one, b.last
    return Part(
        a.before, head, between, last, b.after, a.chars + b.chars, a.cells + b.cells, a.pipes + b.pipes,
        a.tabs + b.tabs + gap.tabs, a.gaps + b.gaps + int(gap.size > 1 and gap.plain), odd, raw, first,
    )


def whole_line(x: Part) -> Line | None:
    """The line of which x is all; None if it is blank."""
    if x.head is None:
        return None
    counts = x.between.plus(x.head.counts())
    if x.last:
        counts = counts.plus(x.last.counts())
    return Line(counts, x.chars, x.cells, x.pipes, x.tabs, x.gaps, x.odd, x.first, x.tail.tail)


def kind_of(x: Line) -> str:
    """The kind of a whole line with words."""
    first, n = x.first, x.counts
    if (n.tokens >= 6 and len(n.few) <= 2) or 5 * x.odd >= x.chars:
        return "junk"
    if first[0] == "%":
        return "neutral"
    if first.startswith(_LIST_COMMANDS):
        return "list"
    if x.cells and (x.cells > 1 or n.numbers or x.last.endswith("\\\\")):
        return "table"
    if n.packed and n.tokens <= 2:
        return "table"
    if n.numbers and (x.tabs >= 2 or x.pipes >= 2 or (x.gaps >= 2 and n.numbers >= 2)):
        return "table"
    if first[0] == "\\" and n.good < 5:
        return "neutral"
    if 2 * n.long_chars >= x.chars:
        return "junk"
    lead = first.split(None, 1)[0]
    if n.tokens <= 12 and (re.fullmatch(r"\(?\d{1,4}[.)]|\[\w{1,12}\]|[-*•+–]", lead) or (n.dashes and n.tokens <= 10)):
        return "list"
    if n.numbers and 2 * n.numbers >= n.tokens:
        return "list" if lead[0].isalpha() and x.last[-1].isdigit() else "junk"
    if n.numbers and n.tokens <= 8 and lead[0].isalpha() and re.search(r"\d[,\d–-]*$", x.last):
        return "list"
    if n.good >= 4 and 2 * n.good_chars >= x.chars:
        return "prose"
    if "\\" in first or "$" in first or first[0] in "{}[]":
        return "neutral"
    if n.good and 2 * n.good >= n.tokens:
        return "prose" if x.last[-1:] in _STOPS else "list"
    return "junk"


def _plain_prose(text: str) -> int:
    """The characters of a line that is prose beyond doubt, by a short cut that agrees with kind_of; else 0."""
    words = text.split()
    n = len(words)
    if n < 6 or not words[0].isalpha() or (n <= 10 and ("-" in text or "–" in text or "—" in text or words[-1][-1].isdigit())):
        return 0
    if "&" in text or "|" in text or "\t" in text or "  " in text:
        return 0
    good = [w for w in words if w.isalpha() and len(w) < 30 and not _VOWELS.isdisjoint(w)]
    chars = sum(map(len, words))
    if len(good) < 4 or 2 * len(good) <= n or 2 * sum(map(len, good)) <= chars or len(set(words)) <= 2 or 5 * _odd(text) >= chars:
        return 0
    return chars


def _ends_sentence(last: str) -> bool:
    last = last.rstrip(_CLOSERS)
    return bool(last) and last[-1] in _STOPS


@dataclass
class Whole:
    """Counts of whole lines: characters by kind in each stretch between marks, lines with words, and lines that end in
    punctuation."""

    stretches: list = field(default_factory=lambda: [dict.fromkeys(KINDS, 0)])
    marks: str = ""
    lines: int = 0
    ended: int = 0

    def mark(self, name: str) -> None:
        self.marks += name
        self.stretches.append(dict.fromkeys(KINDS, 0))

    def text(self, line: str) -> None:
        if chars := _plain_prose(line):
            self.stretches[-1]["prose"] += chars
            self.lines += 1
            self.ended += _ends_sentence(line.rstrip()[-TAIL:])
        elif line and not line.isspace():
            self.add(line_of(line))

    def add(self, x: Line | None) -> None:
        if x is not None:
            self.stretches[-1][kind_of(x)] += x.chars
            self.lines += 1
            self.ended += _ends_sentence(x.last)

    def extend(self, other: Whole) -> None:
        for k, v in other.stretches[0].items():
            self.stretches[-1][k] += v
        self.stretches += other.stretches[1:]
        self.marks += other.marks
        self.lines += other.lines
        self.ended += other.ended

    def body(self) -> dict:
        """The stretches from the first begin mark to the first end mark after it."""
        begin = self.marks.find("B")
        end = self.marks.find("E", max(begin, 0))
        out = dict.fromkeys(KINDS, 0)
        for s in self.stretches[begin + 1 : end + 1 if end >= 0 else None]:
            for k, v in s.items():
                out[k] += v
        return out


@dataclass
class State:
    """A chunk or a run of chunks: an open first line, whole lines and an open last line, or one open line that is both; sums of
    characters and words, and open words by their first KEEP letters and their size."""

    first: Part
    rest: Whole | None
    last: Part | None
    chars: int
    symbols: int
    words: int
    letters: int
    common: int
    head: tuple | None
    tail: tuple | None
    solid: bool


def _word_sums(text: str, common: frozenset) -> tuple:
    low = text.lower()
    if not text.isascii():
        low = low.replace("ς", "σ")
    words = _WORD.findall(low)
    letters = sum(map(len, words))
    head = (words[0][:KEEP], len(words[0])) if words and low.startswith(words[0]) else None
    tail = (words[-1][:KEEP], len(words[-1])) if words and low.endswith(words[-1]) else None
    spaces = sum(map(text.count, _SPACES if not text.isascii() else " \n\t\r\f\v\x1c\x1d\x1e\x1f"))
    alone = len(words) == 1 and head is not None and tail is not None and len(words[0]) == len(low)
    hits = sum(map(common.__contains__, words))
    return len(text), len(text) - spaces - letters, len(words), letters, hits, head, tail, alone


def word_shares(text: str, common: frozenset) -> tuple[float, float]:
    """Symbol ratio and share of common words of a whole text; 1 and 0 where it has no words."""
    _, symbols, words, letters, hits, *_ = _word_sums(text, common)
    return (symbols / (letters + symbols), hits / words) if words else (1.0, 0.0)


def state_of(text: str, common: frozenset, before: str = "", after: str = "") -> State:
    """The state of a chunk; before and after are the characters around it, so that a mark the cut divides is found once, in
    the chunk where it begins."""
    body = text
    if "\\" in before or ("\\" in text[-LOOK:] and after):
        around = before + text + after
        for m in _MARK.finditer(around):
            a, b = m.start() - len(before), m.end() - len(before)
            if a < 0 < b:
                body = " " * b + body[b:]
            elif a < len(text) < b:
                body = body[:a] + m.group()
    segments = _MARK.split(body)
    lines = segments[0].split("\n")
    first, rest, last = part_of(lines[0]), None, None
    if len(lines) > 1 or len(segments) > 1:
        rest = Whole()
        # Every line that is followed by a line end or a mark is whole; only the last one is open.
        whole = lines[1:]
        for i in range(1, len(segments), 2):
            for line in whole:
                rest.text(line)
            rest.mark("B" if segments[i] == BEGIN else "E")
            whole = segments[i + 1].split("\n")
        for line in whole[:-1]:
            rest.text(line)
        last = part_of(whole[-1])
    return State(first, rest, last, *_word_sums(text, common))


def merge(a: State, b: State, common: frozenset) -> State:
    """The state of two adjacent runs of chunks."""
    words, hits = a.words + b.words, a.common + b.common
    head, tail, solid = a.head, b.tail, False
    if a.tail and b.head:
        whole = ((a.tail[0] + b.head[0])[:KEEP], a.tail[1] + b.head[1])
        known = lambda w: int(w[1] <= KEEP and w[0] in common)
        words -= 1
        hits += known(whole) - known(a.tail) - known(b.head)
        head = whole if a.solid else head
        tail = whole if b.solid else tail
        solid = a.solid and b.solid
    elif not b.chars:
        tail, solid = a.tail, a.solid
    elif not a.chars:
        head, solid = b.head, b.solid
    sums = (a.chars + b.chars, a.symbols + b.symbols, words, a.letters + b.letters, hits, head, tail, solid)
    if a.rest is None:
        return State(join_parts(a.first, b.first), b.rest, b.last, *sums)
    if b.rest is None:
        return State(a.first, a.rest, join_parts(a.last, b.first), *sums)
    a.rest.add(whole_line(join_parts(a.last, b.first)))
    a.rest.extend(b.rest)
    return State(a.first, a.rest, b.last, *sums)


def finish(s: State) -> tuple:
    """(n_chars, n_words, mean_word_length, symbol_ratio, ended_line_share, common_word_share, prose_share, shape)."""
    whole = Whole()
    whole.add(whole_line(s.first))
    if s.rest is not None:
        whole.extend(s.rest)
        whole.add(whole_line(s.last))
    body = whole.body()
    text = sum(v for k, v in body.items() if k != "neutral")
    share = body["prose"] / text if text else None
    shape = max(("list", "table", "junk"), key=lambda k: body[k]) if text and share < 0.5 else None
    seen = s.letters + s.symbols
    return (
        s.chars, s.words, s.letters / s.words if s.words else None, s.symbols / seen if seen else None,
        whole.ended / whole.lines if whole.lines else None, s.common / s.words if s.words else None, share, shape,
    )


_OUT = "n_chars bigint, n_words bigint, mean_word_length double, symbol_ratio double, ended_line_share double, common_word_share double, prose_share double, shape string"
_NAMES = [x.split()[0] for x in _OUT.split(", ")]


def text_statistics(docs: DataFrame, id_col: str, text_col: str, common_words: list[str], chunk: int = CHUNK, fan: int = FAN) -> DataFrame:
    """(id_col, n_chars, n_words, mean_word_length, symbol_ratio, ended_line_share, common_word_share, prose_share, shape), one
    row per row of docs. common_words is a fixed list of function words, of all languages."""
    spark = docs.sparkSession
    words = frozenset(w.lower().replace("ς", "σ") for w in common_words if w and len(w) <= KEEP)
    kind = docs.schema[id_col].dataType.simpleString()
    # A row number of its own keeps repeated ids apart; it is written with the chunks.
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    place = "rid bigint, chunk_no int, n_chunks int"
    pieces = f"id {kind}, {place}, text string, before string, after string, " + _OUT
    columns = ["id", "rid", "chunk_no", "n_chunks", "text", "before", "after", *_NAMES]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Statistics of texts of one chunk; the chunks of others."""
        for f in batches:
            out, held = [], 0
            for rid, own, t in f[["rid", "id", "text"]].itertuples(index=False, name=None):
                if t is None or len(t) <= chunk:
                    done = (None,) * len(_NAMES) if t is None else finish(state_of(t, words))
                    out.append((own, None, None, None, None, None, None, *done))
                    continue
                n = -(-len(t) // chunk)
                for i in range(n):
                    a, b = i * chunk, (i + 1) * chunk
                    out.append((own, rid, i, n, t[a:b], t[max(a - LOOK, 0) : a], t[b : b + LOOK], *(None,) * len(_NAMES)))
                    held += b - a
                    if held >= 1 << 24:
                        yield pd.DataFrame(out, columns=columns, dtype=object)
                        out, held = [], 0
            yield pd.DataFrame(out, columns=columns, dtype=object)

    def states(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in batches:
            made = [pickle.dumps(state_of(t, words, b, a), 5) for t, b, a in zip(f["text"], f["before"], f["after"])]
            yield f[["id", "rid", "chunk_no", "n_chunks"]].assign(state=made)

    def merged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in batches:
            out = []
            for run in f["run"]:
                s = None
                for r in run:
                    new = pickle.loads(r["state"])
                    s = new if s is None else merge(s, new, words)
                out.append(pickle.dumps(s, 5))
            yield f[["id", "rid", "chunk_no", "n_chunks"]].assign(state=out)

    def finished(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in batches:
            done = pd.DataFrame([finish(pickle.loads(s)) for s in f["state"]], columns=_NAMES, dtype=object)
            yield pd.concat([f[["id"]].reset_index(drop=True), done], axis=1)

    parts = materialise(rows.mapInPandas(read, pieces))
    out = parts.filter("rid IS NULL").select("id", *_NAMES)
    long = parts.filter("rid IS NOT NULL").select("id", "rid", "chunk_no", "n_chunks", "text", "before", "after")
    most = long.agg(F.max("n_chunks")).first()[0]
    if most:
        stated = f"id {kind}, {place}, state binary"
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        tree = materialise(long.repartition(n, "rid", "chunk_no").mapInPandas(states, stated))
        while most > 1:
            runs = tree.groupBy("rid", "id", F.expr(f"chunk_no div {fan}").cast("int").alias("chunk_no"), "n_chunks").agg(F.array_sort(F.collect_list(F.struct(F.col("chunk_no").alias("at"), "state"))).alias("run"))
            tree = materialise(runs.mapInPandas(merged, stated))
            most = -(-most // fan)
        out = out.unionByName(tree.mapInPandas(finished, f"id {kind}, " + _OUT))
    return out.withColumnRenamed("id", id_col)
