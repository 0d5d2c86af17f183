"""Line-first quality rules: lines are judged one by one, failing lines go, and documents that lose too much go too.

A line without a word is neither judged nor counted. A line fails, in this order, by

* ``boilerplate``: it has three words or more and stands, A-Z in lower case and digits as zeros, in at least
  LINE_TEXTS different texts, where LINE_SPREAD of them or more have other lines beside it. What is said everywhere in
  ever new surroundings is no part of what a document says. Copies are one text, and near copies keep their lines'
  neighbours, so that neither makes a passage boilerplate;
* ``navigation``: at least two words, and a third of its words, are only separators of NAVIGATION;
* ``punctuation``: five words or more, and it doesn't end as a sentence, a clause or a quotation does (ENDS), or it has
  over a quarter as many characters of SYMBOLS as words, or over half of its words end in two exclamation or question
  marks, or it has letters a-z or A-Z of which over four fifths are A-Z.

A document stays if the base rules pass it and the lines that fail hold at most half of its words. Lines that equal
an earlier line of the document are counted (n_dup_lines) and not judged by it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import RID, Scratch, bound_batches, keyed, over_batches, texts

#: Separators that mark navigation, symbol characters, and what a line of prose may end in.
NAVIGATION = ["|", ">", "<", "/", "»", "«", "›", "‹", "•", "·", "-"]
SYMBOLS = "#*$%&|<>"
ENDS = [".", "!", "?", ":", ";", ",", "…", '"', "'", "”", "’", "»", ")", "]", "。", "！", "？", "।", "؟"]

LEAST_WORDS, REPEAT_SHARE, WINDOW, LOST_SHARE = 20, 30, 8, 0.5
LINE_WORDS, LINE_TEXTS, LINE_SPREAD, SEED = 3, 10, 0.8, 42
UPPER = bytes(range(65, 91))
DIGITS = bytes(range(48, 58))
NORMAL = bytes.maketrans(UPPER + DIGITS, UPPER.lower() + b"0" * 10)
_ENDS = tuple(x.encode() for x in ENDS)
_NAV = {x.encode() for x in NAVIGATION}
_SYM = SYMBOLS.encode()
_NOT_SYM = bytes(c for c in range(256) if c not in _SYM)
_NOT_UPPER = bytes(c for c in range(256) if not 65 <= c <= 90)
_NOT_LOWER = bytes(c for c in range(256) if not 97 <= c <= 122)
_FAST = bytes(range(0x80, 0xC0)) + b" \t\n\x0b\x0c\r"  # continuation bytes and white space aren't characters of words
_MARKS = (b"!!", b"!?", b"?!", b"??")


def repeated_words(words: list[bytes], width: int = WINDOW) -> int:
    """Words inside windows of ``width`` words that occur twice or more in the list."""
    n = len(words) - width + 1
    if n < 2 or len(set(words)) == len(words):
        return 0
    ids: dict[bytes, int] = {}
    raw = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.uint32, len(words)).tobytes()
    step = 4 * width
    windows = [raw[i : i + step] for i in range(0, 4 * n, 4)]
    first: dict[bytes, int] = {}
    hit = bytearray(len(words))
    ones = b"\x01" * width
    if len(set(windows)) == n:
        return 0
    for i, w in enumerate(windows):
        j = first.setdefault(w, i)
        if j != i:
            hit[i : i + width] = ones
            hit[j : j + width] = ones
    return hit.count(1)


def line_fault(line: bytes, words: list[bytes], common: bool = False) -> str:
    """The rule that a line fails by; ``common`` says that it is boilerplate."""
    if common:
        return "boilerplate"
    n = len(words)
    marks = sum(w in _NAV for w in words)
    if marks >= 2 and 3 * marks >= n:
        return "navigation"
    if n >= 5:
        if not words[-1].endswith(_ENDS):
            return "punctuation"
        if 4 * len(line.translate(None, _NOT_SYM)) > n or 2 * sum(w.endswith(_MARKS) for w in words) > n:
            return "punctuation"
        upper = len(line.translate(None, _NOT_UPPER))
        if 5 * upper > 4 * (upper + len(line.translate(None, _NOT_LOWER))):
            return "punctuation"
    return ""


def judge(text: bytes, common: frozenset[int] = frozenset(), lost_share: float = LOST_SHARE) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, lost words, lines that fail by
    each rule, kept text). ``common`` has the hashes of boilerplate lines."""
    words = text.split()
    n, seen, dups, lost, left = len(words), set(), 0, 0, []
    by = dict.fromkeys(RULES, 0)
    for line in text.split(b"\n"):
        own = line.split()
        if not own:
            left.append(line)
            continue
        dups += line in seen
        seen.add(line)
        if rule := line_fault(line, own, bool(common) and len(own) >= LINE_WORDS and xxhash.xxh64_intdigest(line.translate(NORMAL), SEED) in common):
            lost += len(own)
            by[rule] += 1
        else:
            left.append(line)
    repeat = repeated_words(words)
    failed = n < LEAST_WORDS or 100 * repeat > REPEAT_SHARE * n
    chars = len(text.translate(None, _FAST))
    return n, chars, len(text.translate(None, _NOT_SYM)), dups, repeat, failed, not failed and lost <= lost_share * n, lost, *by.values(), b"\n".join(left)


RULES = ["boilerplate", "navigation", "punctuation"]
_WORD = r"[^\x20\x09-\x0D]+"


def _lines(text: Column) -> Column:
    """Lines with a word, in their normal form."""
    normal = F.translate(F.coalesce(text, F.lit("")), (UPPER + DIGITS).decode(), UPPER.decode().lower() + "0" * 10)
    return F.filter(F.split(normal, "\n", -1), lambda x: x.rlike(_WORD))


def _long_enough(line: Column) -> Column:
    return line.rlike(r"[\x20\x09-\x0D]+".join([_WORD] * LINE_WORDS))


def common_lines(docs: DataFrame, line_texts: int = LINE_TEXTS, spread: float = LINE_SPREAD) -> DataFrame:
    """``h``, n_texts and n_places of the lines (hashes of their normal form) that are boilerplate, from all texts of docs.

    An occurrence is a line, the lines beside it and the text that it is in. Lines that are said too seldom are left
    out by a first count, equal occurrences collapse before they are shuffled; counts by line and neighbours, and then by line, are partial aggregates, so that a line in a third of all
    documents weighs on no task.
    """
    lines = _lines(F.col("text"))

    def place(x: Column, i: Column) -> Column:
        beside = [F.coalesce(F.get(F.col("lines"), i + k), F.lit("\n")) for k in (-1, 1)]  # no line holds a line break
        return F.struct(F.when(_long_enough(x), F.xxhash64(x)).alias("h"), F.xxhash64(*beside).alias("beside"))

    rows = docs.select(F.xxhash64("text").alias("t"), lines.alias("lines")).select("t", F.explode(F.transform("lines", place)).alias("p")).select("t", "p.h", "p.beside").where("h is not null")
    often = rows.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= line_texts).select("h")
    often = Scratch(docs.sparkSession).write(often, "often")  # most lines are said once; they go no further than this count
    once = rows.join(often, "h", "left_semi").distinct()
    places = once.groupBy("h", "beside").agg(F.count(F.lit(1)).alias("n"))
    counts = places.groupBy("h").agg(F.sum("n").alias("n_texts"), F.count(F.lit(1)).alias("n_places"))
    return counts.where((F.col("n_texts") >= line_texts) & (F.col("n_places") >= spread * F.col("n_texts")))


def report(docs: DataFrame, lost_share: float = LOST_SHARE, line_texts: int = LINE_TEXTS, spread: float = LINE_SPREAD) -> DataFrame:
    """One row for each row of docs: doc_id, the counts, base_failed, kept, n_lost_words, the number of lines that fail
    by each rule, and clean_text.

    A null or empty text has no words, fails the base rules and isn't kept. Boilerplate is learnt from all rows; but
    for that each row is judged alone, so that equal rows, ties, null ids and an empty table need nothing special;
    other columns of docs are ignored. A text is judged whole, whatever its length.
    """

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        marks = [frozenset(h % (1 << 64) for h in own or ()) for own in batch.column(2).to_pylist()]
        rows = [judge(t, own, lost_share) for t, own in zip(texts(batch.column(1)), marks, strict=True)]
        cols = list(zip(*rows, strict=True)) if rows else [[] for _ in range(len(NAMES) - 1)]
        kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.int64()] * 4
        made = [pa.array(c, k) for c, k in zip(cols, kinds, strict=False)] + [pa.array(cols[-1], pa.binary()).cast(pa.string())]
        return pa.RecordBatch.from_arrays([batch.column(0), *made], names=NAMES)

    bound_batches(docs.sparkSession)
    have = keyed(docs.select("doc_id", "text"))
    common = Scratch(docs.sparkSession).write(common_lines(have, line_texts, spread).select("h"), "common")
    own = have.select(RID, F.explode(F.array_distinct(F.transform(_lines(F.col("text")), lambda x: F.xxhash64(x)))).alias("h"))
    marks = own.join(common, "h").groupBy(RID).agg(F.collect_list("h").alias("marks"))
    rows = have.join(marks, RID, "left").select("doc_id", "text", "marks")
    return rows.mapInArrow(over_batches(work), SCHEMA.format(docs.schema["doc_id"].dataType.simpleString()))


NAMES = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lost_words", *[f"n_{r}" for r in RULES], "clean_text"]
SCHEMA = "doc_id {}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_lost_words long, n_boilerplate long, n_navigation long, n_punctuation long, clean_text string"


def clean(docs: DataFrame, lost_share: float = LOST_SHARE) -> DataFrame:
    """The kept documents with their text cleaned: doc_id and text. Cases are as in ``report``."""
    return report(docs, lost_share).where("kept").selectExpr("doc_id", "clean_text as text")
