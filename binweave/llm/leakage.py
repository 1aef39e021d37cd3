"""Evaluation passages that leak into training text, by suffix arrays of the training shards.

1. Training documents are read as word sequences. A shard is a run of documents of about `shard_chars` characters (at least one
   document, whole). Its words are numbered in their order, and all its suffixes are sorted over their full length by prefix
   doubling, up to the end of their document. Shards are written once, as a table in the shared folder; neither their words nor
   their order depend on the passages, so one index serves any number of them.
2. The passages are the stated query set. They are read in blocks of at most `block_chars` characters (or one passage), one at a
   time; a block is shipped to the workers, searched in all shards, and destroyed before the next is read. Equal passages of a
   block, and equal stretches of min_words words of different ones, are searched once.
3. Every different stretch with which a passage suffix begins is binary-searched in the suffix array of every shard. The suffixes
   found are matched with the passages at places where the words before differ, so each match is met at its beginning only,
   and is followed to its end: that is the longest verbatim match, with its place in the document and in the passage.

Nothing is shuffled but one row per (document, passage).

Words are maximal runs of letters and digits, lower case, after TeX accent commands are read as the letters they print and
other command names are removed. Comments count. Documents are read whole, whatever their length.

Defined cases: null ids and null or empty texts match nothing. A passage of fewer than min_words words cannot leak. Passages
that share text are each reported. Repeated documents are each reported; of several matches of a document and a passage the
longest is kept, of equal ones the first.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from binweave.runtime import materialise

#: The combining character that each TeX accent command puts on its letter.
ACCENTS = {"'": "\u0301", "`": "\u0300", "^": "\u0302", '"': "\u0308", "~": "\u0303", "=": "\u0304", ".": "\u0307", "c": "\u0327", "v": "\u030c", "u": "\u0306", "H": "\u030b", "k": "\u0328", "r": "\u030a", "d": "\u0323", "b": "\u0331"}
#: Commands that print a letter of their own.
LETTERS = {"ss": "ß", "ae": "æ", "AE": "Æ", "oe": "œ", "OE": "Œ", "aa": "å", "AA": "Å", "o": "ø", "O": "Ø", "l": "ł", "L": "Ł", "i": "ı", "j": "ȷ"}

_OPEN, _CLOSE = "\ue000", "\ue001"
_ACCENT = re.compile(
    r"\\(?:(?P<break>\\)|(?P<mark>['`^\"~=.])[ \t]*(?:\{[ \t]*(?P<in1>\\[ij]|[^\W\d_])[ \t]*\}|(?P<bare1>\\[ij](?![A-Za-z])|[^\W\d_]))"
    r"|(?P<name>[cvuHkrdb])(?:[ \t]*\{[ \t]*(?P<in2>\\[ij]|[^\W\d_])[ \t]*\}|[ \t]+(?P<bare2>[^\W\d_]))"
    r"|(?P<letter>ss|ae|AE|oe|OE|aa|AA|o|O|l|L|i|j)(?![A-Za-z])(?:\{\}|[ \t]+)?)"
)
_COMMAND = re.compile(r"\\[A-Za-z]+\*?")
_WORD = re.compile(r"[^\W_]+")
_SHARD = "words string, codes binary, suffixes binary, docs array<bigint>, starts array<bigint>"
_FOUND = "doc bigint, passage int, n_words int, doc_word int, item_word int"


def _letter(m: re.Match) -> str:
    if m["break"]:
        return " "
    if m["letter"]:
        return f"{_OPEN}{LETTERS[m['letter']]}{_CLOSE}"
    base = (m["in1"] or m["bare1"] or m["in2"] or m["bare2"]).lstrip("\\")
    return f"{_OPEN}{unicodedata.normalize('NFC', base + ACCENTS[m['mark'] or m['name']])}{_CLOSE}"


def words(text: str | None) -> list[str]:
    if not text:
        return []
    if "\\" in text:
        new = _ACCENT.sub(_letter, text)
        if _OPEN in new:
            new = new.replace("{" + _OPEN, "").replace(_CLOSE + "}", "").replace(_OPEN, "").replace(_CLOSE, "")
        text = _COMMAND.sub("", new)
    if not text.isascii() and not unicodedata.is_normalized("NFC", text):
        text = unicodedata.normalize("NFC", text)
    return _WORD.findall(text.lower())


def suffix_array(codes: np.ndarray) -> np.ndarray:
    """The starts of all suffixes that begin with a word, in the order of their words. codes has a number over 0 for each word
    and one 0 after each document; a suffix ends with its document, and of equal ones the earlier comes first."""
    n, ends = len(codes), codes == 0
    if not n:
        return np.empty(0, dtype=np.int64)
    # Every end is a symbol of its own, so no order is taken from beyond it.
    rank = np.where(ends, np.cumsum(ends) - 1, codes.astype(np.int64) + int(ends.sum()))
    width = int(rank.max()).bit_length()
    h = min(max(63 // max(width, 1), 1), 8)
    key = np.zeros(n, dtype=np.int64)
    for k in range(h):
        key <<= width
        key[: max(n - k, 0)] |= rank[k:]
    order = np.argsort(key, kind="stable")
    key = key[order]
    rank = np.empty(n, dtype=np.int64)
    active, place = order, np.arange(n)
    suffixes = order.copy()
    while len(active):
        # Suffixes that agree so far are one group, named by the place of its first; groups of one are done.
        new = np.concatenate(([True], key[1:] != key[:-1]))
        rank[active] = place[np.maximum.accumulate(np.where(new, np.arange(len(active)), 0))]
        alone = new & np.concatenate((new[1:], [True]))
        active, place = active[~alone], place[~alone]
        if not len(active):
            break
        key = rank[active] * n + rank[active + h]
        order = np.argsort(key, kind="stable")
        active, key = active[order], key[order]
        suffixes[place] = active
        h *= 2
    return suffixes[~ends[suffixes]]


def _pack(suffixes: np.ndarray) -> bytes:
    """Three bytes each where that is enough, else four; see _unpack."""
    wide = np.ascontiguousarray(suffixes.astype("<u4")).view(np.uint8).reshape(-1, 4)
    return b"\3" + wide[:, :3].tobytes() if not len(wide) or not wide[:, 3].any() else b"\4" + wide.tobytes()


def _unpack(raw: bytes) -> np.ndarray:
    each = np.frombuffer(raw, dtype=np.uint8, offset=1).reshape(-1, raw[0])
    wide = np.zeros((len(each), 4), dtype=np.uint8)
    wide[:, : raw[0]] = each
    return wide.view("<u4").reshape(-1).astype(np.int64)


def _numbered(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The different words in order, the words of all texts by their number from 1 with a 0 after each text, and the starts."""
    number: dict[str, int] = {}
    parts, starts, at = [], [], 0
    for text in texts:
        ids = [number.setdefault(w, len(number) + 1) for w in words(text)]
        ids.append(0)
        parts.append(np.array(ids, dtype=np.int64))
        starts.append(at)
        at += len(ids)
    ordered = sorted(number)
    back = np.zeros(len(number) + 1, dtype=np.int64)
    back[[number[w] for w in ordered]] = np.arange(1, len(ordered) + 1)
    return ordered, back[np.concatenate(parts)] if parts else np.empty(0, dtype=np.int64), np.array(starts, dtype=np.int64)


def _index(shard_chars: int):
    """Batches of (doc, text) to rows of _SHARD."""

    def build(docs: list[int], texts: list[str]) -> pa.RecordBatch:
        ordered, codes, starts = _numbered(texts)
        small = codes.astype("<u2" if len(ordered) < 1 << 16 else "<u4")
        packed = (b"\2" if small.dtype.itemsize == 2 else b"\4") + small.tobytes()
        kinds = [pa.string(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        row = ["\n".join(ordered), packed, _pack(suffix_array(codes)), docs, starts.tolist()]
        return pa.RecordBatch.from_arrays([pa.array([v], type=t) for v, t in zip(row, kinds)], ["words", "codes", "suffixes", "docs", "starts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, texts, size = [], [], 0
        for batch in batches:
            ids, column = batch.column("doc").to_pylist(), batch.column("text")
            for i, d in enumerate(ids):
                texts.append(column[i].as_py())
                docs.append(d)
                size += len(texts[-1])
                if size >= shard_chars:
                    yield build(docs, texts)
                    docs, texts, size = [], [], 0
        if docs:
            yield build(docs, texts)

    return run


def index(docs: DataFrame, doc_id: str, doc_text: str, shard_chars: int = 4_000_000) -> DataFrame:
    """The suffix arrays of the training shards as a written table."""
    plain = docs.select(F.col(doc_id).cast("bigint").alias("doc"), F.col(doc_text).alias("text")).filter("doc IS NOT NULL AND text IS NOT NULL")
    return materialise(plain.mapInArrow(_index(shard_chars), _SHARD))


class Passages:
    """A block of different passages as one word sequence, and the different stretches of min_words words in it.

    Stretch k stands at the places `at[first[k] : first[k + 1]]`, which are sorted by the word before them."""

    def __init__(self, texts: list[str], min_words: int):
        self.min_words = min_words
        self.words, codes, starts = _numbered(texts)
        self.passage = np.searchsorted(starts, np.arange(len(codes)), side="right") - 1
        self.offset = np.arange(len(codes)) - starts[self.passage] if len(starts) else self.passage
        # One more end, so that the last word has a next one.
        self.codes = np.concatenate((codes, [0]))
        room = np.diff(np.concatenate((starts, [len(codes)])))[self.passage] - 1 - self.offset if len(starts) else self.offset
        at = np.flatnonzero(room >= min_words)
        stretches, which = np.unique(self.codes[at[:, None] + np.arange(min_words)], axis=0, return_inverse=True)
        which = which.reshape(-1)
        before = np.where(self.offset[at] > 0, self.codes[at - 1], 0)
        order = np.lexsort((at, before, which))
        self.stretches, self.at, self.before = stretches, at[order], before[order]
        self.first = np.searchsorted(which[order], np.arange(len(stretches) + 1))

    def hits(self, ordered: list[str], codes: np.ndarray, suffixes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word of the shard, place in the block, words) where a match of at least min_words words begins."""
        none = np.empty(0, dtype=np.int64)
        number = {w: i for i, w in enumerate(ordered, 1)}
        # Words that the shard does not have get a number that nothing in it has.
        known = np.array([0, *[number.get(w, -1) for w in self.words]], dtype=np.int64)
        stretches = known[self.stretches]
        wanted = np.flatnonzero((stretches > 0).all(axis=1))
        if not len(wanted) or not len(suffixes):
            return none, none, none
        stretches, n = stretches[wanted], self.min_words
        padded = np.concatenate((codes, np.zeros(n, dtype=np.int64)))
        step = np.arange(n)

        def bound(right: bool) -> np.ndarray:
            """The first suffix that is not before (or, right, that is after) each stretch, by binary search."""
            low, high = np.zeros(len(wanted), dtype=np.int64), np.full(len(wanted), len(suffixes), dtype=np.int64)
            live = np.arange(len(wanted))
            while len(live):
                middle = (low[live] + high[live]) // 2
                differ = padded[suffixes[middle][:, None] + step] - stretches[live]
                where = (differ != 0).argmax(axis=1)
                sign = differ[np.arange(len(live)), where]
                up = (sign < 0) | (right & (sign == 0))
                low[live[up]] = middle[up] + 1
                high[live[~up]] = middle[~up]
                live = live[low[live] < high[live]]
            return low

        low, high = bound(False), bound(True)
        count = high - low
        k = np.repeat(wanted, count)
        t = suffixes[np.repeat(low, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)]
        # A match begins where the words before differ: all places of the stretch but those that follow the same word.
        back = np.zeros(len(ordered) + 1, dtype=np.int64)
        back[known[known > 0]] = np.flatnonzero(known > 0)
        before = np.where(t > 0, back[codes[t - 1]], 0)
        span = len(self.words) + 2
        sorted_keys = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first)) * span + self.before
        same_from, same_to = np.searchsorted(sorted_keys, k * span + before, side="left"), np.searchsorted(sorted_keys, k * span + before, side="right")
        same_to = np.where(before == 0, same_from, same_to)
        ts, places = [], []
        for a, b in ((self.first[k], same_from), (same_to, self.first[k + 1])):
            size = b - a
            ts.append(np.repeat(t, size))
            places.append(self.at[np.repeat(a, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)])
        t, s = np.concatenate(ts), np.concatenate(places)
        mapped = np.concatenate((known[self.codes], [-1]))
        mapped[mapped == 0] = -1
        length, live = np.full(len(s), n, dtype=np.int64), np.arange(len(s))
        while len(live):
            a, b = s[live] + length[live], t[live] + length[live]
            live = live[mapped[a] == padded[b]]
            length[live] += 1
        return t, s, length


def _search(passages):
    """Rows of _SHARD to rows of _FOUND, one per document and passage of the shard: its longest match, of equal ones the first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = passages.value
        for batch in batches:
            for i in range(batch.num_rows):
                text, raw, packed, docs, starts = (batch.column(c)[i].as_py() for c in range(5))
                codes = np.frombuffer(raw, dtype=f"<u{raw[0]}", offset=1).astype(np.int64)
                t, s, length = block.hits(text.split("\n") if text else [], codes, _unpack(packed))
                begin = np.array(starts, dtype=np.int64)
                row = np.searchsorted(begin, t, side="right") - 1
                at, place, passage = t - begin[row], block.offset[s], block.passage[s]
                order = np.lexsort((place, at, -length, passage, row))
                row, passage = row[order], passage[order]
                first = np.concatenate(([True], (row[1:] != row[:-1]) | (passage[1:] != passage[:-1]))) if len(row) else np.empty(0, dtype=bool)
                keep = order[first]
                own = np.array(docs, dtype=np.int64)[row[first]]
                ints = [x.astype(np.int32) for x in (passage[first], length[keep], at[keep], place[keep])]
                yield pa.RecordBatch.from_arrays([pa.array(own), *map(pa.array, ints)], ["doc", "passage", "n_words", "doc_word", "item_word"])

    return run


def _blocks(items: DataFrame, block_chars: int) -> Iterator[list[tuple[int, str]]]:
    """The passages in runs of at most block_chars characters, or of one passage; only one run is held."""
    run, size = [], 0
    for r in items.toLocalIterator():
        if run and size + len(r.t) > block_chars:
            yield run
            run, size = [], 0
        run.append((r.k, r.t))
        size += len(r.t)
    if run:
        yield run


def leaks(docs: DataFrame, doc_id: str, doc_text: str, items: DataFrame, item_id: str, item_text: str, min_words: int = 13, block_chars: int = 16_000_000, shard_chars: int = 4_000_000) -> DataFrame:
    """(doc_id, item_id, n_words, doc_word, item_word): the longest verbatim match of each document and passage that share at
    least min_words consecutive words, with the place of its first word in both. Ids are bigint."""
    spark = docs.sparkSession
    shards = index(docs, doc_id, doc_text, shard_chars)
    held = items.select(F.col(item_id).cast("bigint").alias("k"), F.col(item_text).alias("t")).filter("k IS NOT NULL AND t IS NOT NULL")
    best = F.max_by(F.struct("n_words", "doc_word", "item_word"), F.struct(F.col("n_words"), -F.col("doc_word"), -F.col("item_word")))
    found = None
    for block in _blocks(held, block_chars):
        texts = {t: i for i, t in enumerate(dict.fromkeys(t for _, t in block))}
        shipped = spark.sparkContext.broadcast(Passages(list(texts), min_words))
        # One row per document and different passage is written; a document stands in more than one shard only if it is repeated.
        hits = materialise(shards.mapInArrow(_search(shipped), _FOUND).groupBy("doc", "passage").agg(best.alias("m")))
        shipped.destroy()
        own = spark.createDataFrame([(texts[t], k) for k, t in block], "passage int, item bigint")
        one = hits.join(F.broadcast(own), "passage").select("doc", "item", "m.*")
        found = one if found is None else found.unionByName(one)
    if found is None:
        return spark.createDataFrame([], "doc_id bigint, item_id bigint, n_words int, doc_word int, item_word int")
    # Repeated ids of passages meet here.
    return found.groupBy("doc", "item").agg(best.alias("m")).select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"), "m.*")


def without_leaks(docs: DataFrame, doc_id: str, found: DataFrame) -> DataFrame:
    """The documents that hold no passage."""
    bad = found.select(F.col("doc_id").alias("_leaked")).distinct()
    return docs.join(bad, docs[doc_id] == bad["_leaked"], "left_anti")
