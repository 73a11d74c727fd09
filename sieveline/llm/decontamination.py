"""Benchmark decontamination with suffix arrays of the training texts.

Every partition of the documents is cut into shards of about ``SHARD_WORDS``
words. A shard gets a suffix array of its words: word positions in the order
of the words that follow, made by prefix doubling, in which only positions
whose order is still open are sorted again. Words that no benchmark item has
end every match, so their positions are left out, and the order matters only
as far as the longest item.

Every suffix of every benchmark item is searched in every shard by bisection;
its neighbours in the suffix array give the longest verbatim match. Suffixes
that match a whole window (``window`` words, or all words of a shorter item)
get the stretch of the suffix array with that window: all of its places. Places
that follow each other in item and document make up one verbatim match.

Benchmark texts are sent to the tasks in blocks of about ``BLOCK_BYTES``, each
block searched in all shards; the spans of several blocks are merged per
document. A shard holds whole documents, so nothing else is shuffled.

Defined results: null or empty text and text without words have no words and
no hits, items without words match nothing; repeated rows each stay, repeated
items with one id are one, items equal in words are searched once and all
named; a null item_id is written as empty text; an empty table of documents gives no
rows, an empty benchmark no hits; clashing input columns are replaced.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from sieveline.llm.common import bound_batches, replace_columns
from sieveline.llm.plainwords import words_of

#: Words of a window.
WINDOW = 10
SHARD_WORDS = 1_000_000
#: Bytes of benchmark text sent to the tasks at a time.
BLOCK_BYTES = 4 << 20


def _struct(**kinds) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType() if k is str else T.LongType()) for n, k in kinds.items()])


FOUND = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("spans", T.ArrayType(_struct(start=int, end=int))),
    T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("matches", T.ArrayType(_struct(item_id=str, item_start=int, doc_start=int, n_words=int)))])
OUT = [f.name for f in FOUND.fields] + ["n_hit", "n_items", "contaminated"]


class Items:
    """Test side: words of the benchmark as numbers from 1, and all suffixes of its distinct items."""

    def __init__(self, rows: list[tuple[str, bytes]], window: int = WINDOW):
        import numpy as np
        self.window, self.number = window, {}
        ids: dict[tuple, set] = {}
        for name, text in rows:
            words = words_of(text)
            if words:
                key = tuple(self.number.setdefault(w, len(self.number) + 1) for w in words)
                ids.setdefault(key, set()).add(name)
        self.names = [sorted(x) for x in ids.values()]
        sizes = np.array([len(k) for k in ids], dtype=np.int64)
        self.longest = int(sizes.max(initial=0))
        # Items with zeros between and behind them: no match goes on there.
        self.words = np.zeros(int(sizes.sum()) + len(sizes) + self.longest + 1, dtype=np.int64)
        self.first = np.cumsum(sizes + 1) - sizes - 1
        for a, key in zip(self.first, ids, strict=True):
            self.words[a:a + len(key)] = key
        self.suffix = np.flatnonzero(self.words)
        self.item = np.searchsorted(self.first, self.suffix, side="right") - 1
        self.size = np.minimum(window, sizes)[self.item] if len(sizes) else self.item
        self.whole = self.suffix + self.size <= (self.first + sizes)[self.item] if len(sizes) else self.item == 0


class Shard:
    """Suffix array of a shard; ``words`` are numbers of words, 0 where no item has the word and between documents."""

    def __init__(self, words, depth: int):
        import numpy as np
        n = len(words)
        self.words = np.concatenate([words, np.zeros(depth + 4, dtype=np.int64)])
        at = np.flatnonzero(words)
        # Words up to the next 0: further on there is nothing to order.
        gaps = np.flatnonzero(self.words == 0)
        reach = gaps[np.searchsorted(gaps, at)] - at
        self.rank = np.zeros(n + 2 * depth + 8, dtype=np.int64)
        base = int(self.words.max()) + 1
        second = np.where(reach > 1, self.words[at + 1], 0)
        order = np.argsort(self.words[at] * base + second, kind="stable")
        self.at, reach = at[order], reach[order]
        open_ = np.arange(len(at))
        keys = (self.words[self.at], second[order])
        h = 2
        while True:
            new = np.ones(len(open_), dtype=bool)
            new[1:] = (keys[0][1:] != keys[0][:-1]) | (keys[1][1:] != keys[1][:-1])
            self.rank[self.at[open_]] = open_[np.maximum.accumulate(np.where(new, np.arange(len(open_)), 0))] + 1
            alone = new & np.concatenate([new[1:], [True]]) if len(new) else new
            open_ = open_[~alone & (reach[open_] >= h)]
            if not len(open_) or h >= depth:
                break
            here = self.at[open_]
            keys = (self.rank[here], self.rank[here + h])
            again = np.lexsort(keys[::-1])
            self.at[open_], reach[open_] = here[again], reach[open_][again]
            keys = (keys[0][again], keys[1][again])
            h *= 2

    def bisect(self, items: Items, suffix, size, above: bool = False):
        """For each suffix's first ``size`` words: the first place of the suffix array that is not below (not
        ``above``) them."""
        import numpy as np
        low, high = np.zeros(len(suffix), dtype=np.int64), np.full(len(suffix), len(self.at))
        while len(busy := np.flatnonzero(low < high)):
            mid = (low[busy] + high[busy]) // 2
            same = self.common(items, self.at[mid], suffix[busy], size[busy])
            a, b = self.words[self.at[mid] + same], items.words[suffix[busy] + same]
            down = np.where(same >= size[busy], above, a < b)
            low[busy[down]] = mid[down] + 1
            high[busy[~down]] = mid[~down]
        return low

    def common(self, items: Items, at, suffix, most):
        """Number of equal words from a place and from a suffix on, up to ``most``."""
        import numpy as np
        out, busy = np.zeros(len(at), dtype=np.int64), np.arange(len(at))
        step = np.arange(8)
        while len(busy):
            i = out[busy][:, None] + step
            a, b = self.words[at[busy][:, None] + i], items.words[np.minimum(suffix[busy][:, None] + i, len(items.words) - 1)]
            equal = (a == b) & (a != 0) & (i < most[busy][:, None])
            n = np.where(equal.all(axis=1), 8, equal.argmin(axis=1))
            out[busy] += n
            busy = busy[n == 8]
        return out

    def longest(self, items: Items, suffix):
        """Longest verbatim match of each suffix of an item, and a place of it (-1: none)."""
        import numpy as np
        most = np.full(len(suffix), items.longest)
        spot = self.bisect(items, suffix, most)
        length, place = np.zeros(len(suffix), dtype=np.int64), np.full(len(suffix), -1)
        for near in (spot - 1, spot):
            ok = np.flatnonzero((near >= 0) & (near < len(self.at)))
            n = self.common(items, self.at[near[ok]], suffix[ok], most[ok])
            better = n > length[ok]
            length[ok[better]], place[ok[better]] = n[better], self.at[near[ok[better]]]
        return length, place

    def places(self, items: Items):
        """All (place, suffix) where a window that starts with a suffix of an item stands."""
        import numpy as np

        from sieveline.llm.syncsets import ragged
        if not len(self.at) or not len(items.suffix):
            return np.zeros((2, 0), dtype=np.int64)
        length, _ = self.longest(items, items.suffix)
        full = np.flatnonzero(items.whole & (length >= items.size))
        suffix, size = items.suffix[full], items.size[full]
        low = self.bisect(items, suffix, size)
        high = self.bisect(items, suffix, size, above=True)
        spot, of = ragged(low, high - low)
        return np.stack([self.at[spot], suffix[of]])


def _found(texts: list[list[bytes]], items: Items):
    """spans, items and matches of each text of a shard."""
    import numpy as np
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    first = np.cumsum(sizes + 1) - sizes - 1
    words = np.zeros(int(sizes.sum()) + len(sizes), dtype=np.int64)
    for a, t in zip(first, texts, strict=True):
        words[a:a + len(t)] = np.fromiter((items.number.get(w, 0) for w in t), dtype=np.int64, count=len(t))
    place, suffix = Shard(words, items.longest).places(items)
    out = [([], [], []) for _ in texts]
    if not len(place):
        return out
    item = np.searchsorted(items.first, suffix, side="right") - 1
    size = np.minimum(items.window, np.diff(np.append(items.first, items.suffix[-1] + 2)) - 1)[item]
    # Places of one item on one diagonal that follow each other are one match.
    order = np.lexsort((place, place - suffix, item))
    p, s, k, n = place[order], suffix[order], item[order], size[order]
    start = np.ones(len(p), dtype=bool)
    start[1:] = (k[1:] != k[:-1]) | (p[1:] != p[:-1] + 1) | (s[1:] != s[:-1] + 1)
    a = np.flatnonzero(start)
    b = np.append(a[1:], len(p)) - 1
    doc = np.searchsorted(first, p[a], side="right") - 1
    starts, ends = p[a] - first[doc], p[b] + n[b] - first[doc]
    for r in np.lexsort((s[a], starts, doc)):
        spans, names, matches = out[doc[r]]
        i, x, y = k[a[r]], int(starts[r]), int(ends[r])
        if spans and x <= spans[-1]["end"]:
            spans[-1]["end"] = max(spans[-1]["end"], y)
        else:
            spans.append({"start": x, "end": y})
        names.append(items.names[i])
        matches.append({"item_id": items.names[i][0], "item_start": int(s[a[r]] - items.first[i]), "doc_start": x,
                        "n_words": y - x})
    return [(spans, sorted({x for some in names for x in some}), matches) for spans, names, matches in out]


def _search(docs: DataFrame, text: str, rows: list[tuple[str, bytes]], window: int, shard_words: int) -> DataFrame:
    """The documents with the columns of FOUND for one block of items."""
    schema = T.StructType([*docs.schema.fields, *FOUND.fields])
    types = to_arrow_schema(FOUND)
    sent = docs.sparkSession.sparkContext.broadcast(rows)

    def search(batches):
        items = Items(sent.value, window)
        held, texts, words = [], [], 0

        def flush():
            found = _found([t for some in texts for t in some], items)
            at = 0
            for batch, some in zip(held, texts, strict=True):
                part = found[at:at + len(some)]
                at += len(some)
                added = [[len(t) for t in some], *([x[c] for x in part] for c in range(3))]
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, *(pa.array(x, type=f.type) for x, f in zip(added, types, strict=True))],
                    names=[*batch.schema.names, *types.names])

        for batch in batches:
            held.append(batch)
            texts.append([words_of(x) for x in batch.column(text).cast(pa.binary()).to_pylist()])
            words += sum(map(len, texts[-1]))
            if words >= shard_words:
                yield from flush()
                held, texts, words = [], [], 0
        if held:
            yield from flush()

    return docs.mapInArrow(search, schema)


def find_items(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id",
               item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES,
               shard_words: int = SHARD_WORDS) -> DataFrame:
    """The documents with n_words, spans (words inside a window's place), items, matches (every longest
    verbatim match of at least a window; of items equal in words the first id), n_hit, n_items and contaminated."""
    bound_batches(docs.sparkSession)
    base = replace_columns(docs, OUT)
    given = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("name"),
                             F.col(item_text).cast("binary").alias("text")).where("text IS NOT NULL").distinct()
    size = given.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // block_bytes) or 1
    block = F.pmod(F.xxhash64("name", "text"), F.lit(blocks))
    per_block = ([(r.name, bytes(r.text)) for r in given.where(block == k).collect()] for k in range(blocks))
    found = _search(base, text, next(per_block), window, shard_words)
    if blocks > 1:
        found = _merged(base, found, (_search(base, text, rows, window, shard_words) for rows in per_block), text)
    n_hit = F.expr("aggregate(array_sort(spans), struct(0L AS n, 0L AS upto), (a, s) -> struct("
                   "a.n + greatest(0L, s.end - greatest(s.start, a.upto)) AS n, greatest(a.upto, s.end) AS upto), a -> a.n)")
    return (found.withColumn("n_hit", n_hit).withColumn("n_items", F.size("items").cast("long"))
            .withColumn("contaminated", F.col("n_hit") > 0))


def _merged(base: DataFrame, first: DataFrame, others, text: str) -> DataFrame:
    """The first block's columns with what the other blocks found; documents equal in all columns have equal results."""
    key = F.md5(F.to_json(F.struct(*[F.col(f"`{c}`") for c in base.columns])))
    lists = [f.name for f in FOUND.fields][1:]
    more = None
    for k, found in enumerate(others):
        hit = (found.where("size(spans) > 0").select(key.alias("__k"), F.lit(k).alias("__b"), *lists)
               .groupBy("__k", "__b").agg(*[F.first(c).alias(c) for c in lists]))
        more = hit if more is None else more.union(hit)
    joined = more.groupBy("__k").agg(*[F.flatten(F.collect_list(c)).alias(f"__{c}") for c in lists])
    both = first.withColumn("__k", key).join(joined, "__k", "left").drop("__k")
    for c in lists:
        both = both.withColumn(c, F.concat(c, F.coalesce(F.col(f"__{c}"), F.expr("array()")))).drop(f"__{c}")
    return both.withColumn("items", F.array_sort(F.array_distinct("items")))


def decontaminated(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The documents without those that hold a window of an item."""
    return find_items(docs, benchmark, **how).where("NOT contaminated").select(*[F.col(f"`{c}`") for c in docs.columns])
