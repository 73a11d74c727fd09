"""Line dedup by hashed windows of lines (native DataFrame operators only).

Lines are cut further after sentence ends and at the bars of table cells, so
that a passage inside a longer line is found too. Below, a line is one of
these pieces; without such places it is a line of the text.

What goes: a line is deleted if it lies in a run of at least ``min_words``
words whose lines stand, in the same order and without a gap, at an earlier
place. Places are ordered by document id (null last), text hash and line. A
line that only stands between other lines somewhere else stays, however often.

How: lines without words are skipped when neighbours are compared, and so are
bars. A window starts at each line and goes on until it has ``min_words``
words, and one ends at each line and begins as many words before; one that is
both counts once. Every line of a repeated run lies in such a window that is
inside the run, and equal windows are equal texts, so a window whose key
stands at an earlier place is deleted and nothing else is. An array of the
line that each word belongs to, and one of each line's first word, give both
ends of a window without counting; keys are made from rows, in generated code.
One shuffle by key ranks the places of a window, so a passage that a third of
the documents share costs one row per place and window; one by document brings
the repeats back to the texts. Only texts with repeats are cut again.

Touching and overlapping windows are one run. In a text that repeats a run at
once, so that its places overlap, the first period is left. What is left keeps its
own separators; a line of the text of which no piece is left goes with its end.

Defined results: null text stays null; text without words is unchanged;
documents equal in id and text are one (each row gets the same result);
repeats inside a document count; an empty table gives no rows; input columns
that clash with an output name are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sieveline.llm.common import SPACE_CLASS, WORD_PATTERN, replace_columns

#: A repeated run is deleted from this many words on.
MIN_WORDS = 25
#: Where lines are cut (nothing is lost: separators stay with a piece).
CUT = rf"(?<=[.!?|][{SPACE_CLASS}])|(?<=[。！？])|(?=[{SPACE_CLASS}]\|)"
#: The same cuts in a whole text: MARK goes behind what ends a sentence, then before what leads to a bar, unless a line
#: begins or was cut there. The wide ends are looked for by themselves: a class of them and ASCII matches far slower.
MARK = "\x01"
IN_LINE = r"\x20\x09\x0B-\x0D"
AFTER, WIDE = rf"[.!?|][{IN_LINE}]", "。！？"
BEFORE = rf"([{IN_LINE}](?<=[^\n\x01][{IN_LINE}])\x01?\|)"

OUT = ["n_lines", "n_removed", "removed_runs"]
DOC = ["__id", "__hash"]


def _let(name: str, value: str, body: str) -> str:
    """SQL of ``body`` with ``name`` for a value that is worked out once, also where ``body`` loops over it."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def _after(mark: str) -> str:
    """__text with ``mark`` behind what ends a sentence."""
    ends = f"regexp_replace(__text, r'{AFTER}', '$0{mark}')"
    wide = ends
    for c in WIDE:
        wide = f"replace({wide}, '{c}', '{c}{mark}')"
    return f"CASE WHEN {' OR '.join(f'contains(__text, {chr(39)}{c}{chr(39)})' for c in WIDE)} THEN {wide} ELSE {ends} END"


def _pieces(inside: bool, ends: bool) -> str:
    """The pieces of __text; with ``ends``, the first of each line but the text's first begins with the line's newline."""
    if not inside and not ends:
        return "split(__text, '\\n')"
    cut = "__text"
    if inside:
        cut = _let("t", _after(MARK),
                   f"CASE WHEN contains(t, '|') THEN regexp_replace(t, r'{BEFORE}', '{MARK}$1') ELSE t END")
    fast = f"split(replace({cut}, '\\n', '{MARK}\\n'), '{MARK}')" if ends else f"split({cut}, r'[\\n{MARK}]')"
    of_line = f"split(y, r'{CUT}')" if inside else "array(y)"
    if ends:
        of_line = f"transform({of_line}, (x, k) -> CASE WHEN l > 0 AND k = 0 THEN concat('\\n', x) ELSE x END)"
    no_bar = "" if ends else f"WHEN NOT contains(__text, '|') THEN split({_after(chr(92) + 'n')}, '\\n') "
    return (f"CASE {no_bar}WHEN contains(__text, '{MARK}') "
            f"THEN flatten(transform(split(__text, '\\n'), (y, l) -> {of_line})) ELSE {fast} END")


def _lines(inside: bool) -> str:
    """Pieces with words: number idx, hash h of the piece without the blanks around it, words n.

    Words are counted by their spaces where the text has no other white space and the piece only single ones.
    """
    def found(count: str) -> str:
        empty = f"b = '' OR b = {chr(39)}|{chr(39)}" if inside else "b = ''"
        return (f"filter(transform(transform({_pieces(inside, False)}, x -> btrim(x)), (b, i) -> struct(i AS idx, "
                f"xxhash64(b) AS h, CASE WHEN {empty} THEN 0 ELSE {count} END AS n)), x -> x.n > 0)")
    pattern = f"regexp_count(b, r'{WORD_PATTERN}')"
    single = f"CASE WHEN contains(b, '  ') THEN {pattern} ELSE octet_length(b) - octet_length(replace(b, ' ', '')) + 1 END"
    other = " OR ".join(f"contains(__text, '{c}')" for c in ("\\t", "\\u000B", "\\u000C", "\\r"))
    return f"CASE WHEN {other} THEN {found(pattern)} ELSE {found(single)} END"


def _spans(words: int) -> str:
    """First and last line (s, e) of each window of lines that have __n words.

    p has the line of each word, from 1 and negative for a line's first word; c has the first word of each line. A
    window starts with the first word of a line, or ends with the last of one and is not one of the former.
    """
    def line(word: str) -> str:
        return f"abs(p[{word}]) - 1"
    end = line(f"c[{{}}] + {words - 1}").format
    starts = f"transform(sequence(0, {line(f'size(p) - {words}')}), i -> struct(i AS s, {end('i')} AS e))"
    stops = (f"transform(sequence({line(str(words - 1))}, size(c) - 1), "
             f"j -> struct({line(f'coalesce(get(c, j + 1), size(p)) - {words}')} AS s, j AS e))")
    spans = f"concat({starts}, filter({stops}, q -> {end('q.s')} <> q.e))"
    firsts = _let("c", "filter(sequence(0, size(p) - 1), w -> p[w] < 0)", spans)
    place = "flatten(transform(__n, (n, j) -> concat(array(-1 - j), array_repeat(j + 1, n - 1))))"
    return _let("p", place, f"CASE WHEN size(p) >= {words} THEN {firsts} END")


def windows(docs: DataFrame, min_words: int = MIN_WORDS, inside: bool = True) -> DataFrame:
    """Windows of the texts: __id, __hash, key, at (first piece * 2^32 + last piece), next (the piece with words after)."""
    lines = docs.where("__text IS NOT NULL").select(*DOC, F.expr(_lines(inside)).alias("__l"))
    arrays = lines.select(*DOC, F.expr("__l.h").alias("__h"), F.expr("__l.idx").alias("__x"), F.expr("__l.n").alias("__n"))
    # The spans have a step of their own: made in the generator, each row would copy the arrays. Without coalesce, the
    # generator's input would also be worked out in a filter.
    spans = arrays.select(*DOC, "__h", "__x", F.expr(_spans(min_words)).alias("__s"))
    return spans.select(*DOC, "__h", "__x", F.inline(F.expr("coalesce(__s, array())"))).select(*DOC, F.expr("xxhash64(slice(__h, s + 1, e - s + 1))").alias("key"),
                        F.expr("shiftleft(cast(__x[s] AS long), 32) + __x[e]").alias("at"),
                        F.expr("coalesce(get(__x, e + 1), __x[e] + 1)").alias("next"))


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS, inside: bool = True) -> DataFrame:
    """(__id, __hash, __runs) of documents with lines to delete; __runs has the first and last piece of each run."""
    order = W.partitionBy("key").orderBy(*DOC, "at")
    found = (windows(docs, min_words, inside).withColumn("place", F.rank().over(order)).where("place > 1")
             .select(*DOC, F.struct("at", "next").alias("run")).repartition(*DOC)
             .groupBy(*DOC).agg(F.array_sort(F.collect_set("run")).alias("__r")))
    begins = "filter(sequence(0, size(r) - 1), i -> i = 0 OR shiftright(r[i].at, 32) > r[i - 1].next)"
    joined = ("transform(b, (i, j) -> struct(cast(shiftright(r[i].at, 32) AS int) AS from, "
              "cast(r[coalesce(get(b, j + 1), size(r)) - 1].at & 4294967295 AS int) AS to))")
    return found.select(*DOC, F.expr(_let("r", "__r", _let("b", begins, joined))).alias("__runs"))


def _without_runs(inside: bool) -> str:
    """__text without the pieces of __runs: the parts between them, with a newline where one was left out."""
    part = _let("f", "CASE WHEN j = 0 THEN 0 ELSE r[j - 1].to + 1 END", _let(
        "u", "CASE WHEN j = size(r) THEN size(p) ELSE r[j].from END", _let(
            "t", "CASE WHEN u > f THEN array_join(slice(p, f + 1, u - f), '') ELSE '' END",
            "CASE WHEN j = 0 OR u <= f THEN t "
            "WHEN j = 1 AND r[0].from = 0 THEN CASE WHEN startswith(p[f], '\\n') THEN substring(t, 2) ELSE t END "
            "WHEN startswith(p[f], '\\n') THEN t "
            "WHEN exists(slice(p, r[j - 1].from + 1, f - r[j - 1].from), y -> startswith(y, '\\n')) THEN concat('\\n', t) "
            "ELSE t END")))
    return _let("p", _pieces(inside, True), _let(
        "r", "__runs", f"array_join(transform(sequence(0, size(r)), j -> {part}), '')"))


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS,
                inside: bool = True) -> DataFrame:
    """The documents with later repeats deleted from their text; adds n_lines, n_removed and removed_runs.

    n_lines counts lines of the text, n_removed and removed_runs (first and last, from 0) the pieces that lines are
    cut into. ``inside=False`` compares and deletes whole lines only.
    """
    base = replace_columns(docs, OUT)
    keyed = (base.withColumn("__id", F.coalesce(F.col(doc_id).cast("long"), F.lit((1 << 63) - 1)))
             .withColumn("__hash", F.xxhash64(F.coalesce(F.col(text), F.lit("")))).withColumn("__text", F.col(text)))
    runs = repeated_runs(keyed, min_words, inside).select(F.col("__id").alias("__i"), F.col("__hash").alias("__h"), "__runs")
    joined = keyed.join(runs, (F.col("__id") == F.col("__i")) & (F.col("__hash") == F.col("__h")), "left")
    return (joined
            .withColumn("n_lines", F.expr(
                "coalesce(octet_length(__text) - octet_length(replace(__text, '\\n', '')) + 1, 0)").cast("long"))
            .withColumn("n_removed", F.expr(
                "coalesce(aggregate(__runs, 0L, (a, r) -> a + r.to - r.from + 1), 0L)"))
            .withColumn("removed_runs", F.coalesce("__runs", F.expr("array()")))
            .withColumn("__kept", F.expr(f"CASE WHEN __runs IS NULL THEN __text ELSE {_without_runs(inside)} END"))
            .select(*[F.col("__kept").alias(text) if c == text else F.col(f"`{c}`") for c in base.columns], *OUT))
