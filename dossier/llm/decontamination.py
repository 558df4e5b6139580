"""Operator 10: benchmark decontamination with suffix arrays of the training text.

Every slice of documents (a shard of a few MB) gets a suffix array: the places of all its known words
in the lexicographic order of what follows them, by prefix doubling.  Every suffix of the test items
is binary-searched in it: its neighbours there give its longest verbatim match in the shard and where
it is, and the interval of suffixes that begin with its window gives every place where the window
occurs.  A shard answers for its own documents, so nothing is shuffled.

Test words are numbered by sorted 64-bit hash; a training word outside that vocabulary is 0 and
ends every match.  Words of matches are compared byte by byte before a match counts.  The test set
is broadcast in blocks of a checked size, one pass and one block in memory at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.llm.shared import fresh, written

WINDOW = 10
#: Bytes of test text that are broadcast at a time.
BLOCK_BYTES = 4 << 20
#: Bytes of training text in a shard.
SHARD_BYTES = 2 << 20
STEP = 16  # words that a comparison takes at a time

RESULT = "n_words long, n_hit long, items array<string>, longest long, longest_item string, longest_item_start long, longest_start long, hits binary"

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.zeros(256, bool)
_IS_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_P = np.uint64(0x9E3779B97F4A7C15)
_STEP = 1 << 20
with np.errstate(over="ignore"):
    _POWERS = np.append(np.uint64(1), np.cumprod(np.full(_STEP, _P)))
    _BACK = np.append(np.uint64(1), np.cumprod(np.full(_STEP, np.uint64(pow(int(_P), -1, 1 << 64)))))


def words_of(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words start in UTF-8 bytes, and their 64-bit hashes after A-Z became a-z.

    A word's hash is a polynomial in its bytes, taken from running sums over pieces of a MB that
    end between words (a longer word is hashed by itself).
    """
    is_word = _IS_WORD[raw]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], is_word, [False])).view(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    out = np.empty(len(starts), np.uint64)
    at = 0
    with np.errstate(over="ignore"):
        while at < len(starts):
            upto = max(at + 1, int(np.searchsorted(ends, starts[at] + _STEP, "right")))
            low, high = int(starts[at]), int(ends[upto - 1])
            if high - low > _STEP:
                value = 0
                for byte in _LOWER[raw[low:high]][::-1].tolist():
                    value = (value * int(_P) + byte + 1) % (1 << 64)
                out[at] = value
            else:
                sums = np.zeros(high - low + 1, np.uint64)
                np.cumsum((_LOWER[raw[low:high]].astype(np.uint64) + np.uint64(1)) * _POWERS[: high - low], out=sums[1:])
                s, e = starts[at:upto] - low, ends[at:upto] - low
                out[at:upto] = (sums[e] - sums[s]) * _BACK[s]
            at = upto
    return starts, out


def _joined(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Texts as one UTF-8 array, a line feed after each, and where each begins."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    begin = np.cumsum([0] + [len(r) + 1 for r in raw])
    return np.frombuffer(b"\n".join(raw) + b"\n", np.uint8), begin[:-1]


def word_ends(raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where the words that begin at ``starts`` end."""
    edge = np.flatnonzero(~_IS_WORD[raw])
    return edge[np.searchsorted(edge, starts)]  # every text is followed by a line feed


def suffix_array(ids: np.ndarray, depth: int) -> np.ndarray:
    """Places of all positive ``ids`` ordered by the ids from there on, up to a 0 or ``depth`` ids; equals by place.

    Prefix doubling: suffixes that agree in h ids are ordered by the rank of what stands h further
    on, until none agree or h reaches ``depth``.  Only ties are sorted again.
    """
    n = len(ids)
    order = np.flatnonzero(ids)
    order = order[np.argsort(ids[order], kind="stable")]
    rank = np.zeros(n + 1, np.int64)  # 0 where no suffix begins; otherwise 1 + the place in order of the first equal suffix

    def ranks(sorted_key: np.ndarray) -> np.ndarray:
        new = np.ones(len(sorted_key), bool)
        new[1:] = sorted_key[1:] != sorted_key[:-1]
        return np.maximum.accumulate(np.where(new, np.arange(len(sorted_key)), 0))

    rank[order] = ranks(ids[order]) + 1
    ends = np.append(np.flatnonzero(ids == 0), n)
    rest = ends[np.searchsorted(ends, np.arange(n))] - np.arange(n)  # ids up to the next 0
    tied, h = np.arange(len(order)), 1
    while h < depth:
        # of the tied, those alone among their equals are settled, and so are those that end within what is compared
        own = rank[order[tied]]
        equal = np.zeros(len(tied), bool)
        equal[1:] = own[1:] == own[:-1]
        tied = tied[equal | np.append(equal[1:], False)] if len(tied) else tied
        if not len(tied):
            break
        places = order[tied]
        key = rank[places] * (n + 2) + rank[places + h]
        by = np.argsort(key, kind="stable")
        places, key = places[by], key[by]
        order[tied] = places
        rank[places] = tied[ranks(key)] + 1
        h *= 2
        tied = tied[rest[places] >= h]
    return order


class TestSet:
    """Words, suffixes and windows of a block of test items, ready for the search."""

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW):
        self.window = window
        self.names = [name for name, _ in items]
        self.raw, begin = _joined([text for _, text in items])
        self.starts, hashes = words_of(self.raw)
        self.stops = word_ends(self.raw, self.starts)
        self.vocabulary = np.unique(hashes)
        self.low_bits = np.zeros(1 << 16, bool)
        self.low_bits[(self.vocabulary & np.uint64(0xFFFF)).astype(np.int64)] = True
        bounds = np.append(np.searchsorted(self.starts, begin), len(self.starts))
        counts = np.diff(bounds)
        # a 0 after every item: word w of item i stands at w + i
        self.item = np.repeat(np.arange(len(items)), counts)
        self.at = np.arange(len(self.starts)) + self.item
        self.words = np.zeros(len(self.starts) + len(items) + STEP, np.int64)
        self.words[self.at] = np.searchsorted(self.vocabulary, hashes) + 1
        self.inner = np.arange(len(self.starts)) - bounds[self.item] if len(items) else np.zeros(0, np.int64)
        self.rest = counts[self.item] - self.inner if len(items) else np.zeros(0, np.int64)  # words up to the item's end
        self.depth = int(counts.max(initial=1))
        # windows: the first ``window`` words of a suffix, or an item of fewer; one number for equal ones
        self.is_window = (self.rest >= window) | (self.inner == 0)
        suffix = suffix_array(self.words, self.depth)
        place = np.zeros(len(self.words), np.int64)
        place[self.at] = np.arange(len(self.at))
        self.order = place[suffix]  # words by the order of their suffixes
        first = np.flatnonzero(self.is_window)
        size = np.minimum(self.rest[first], window)
        rows = np.zeros((len(first), window), np.int32)
        for k in range(window):
            inside = size > k
            rows[inside, k] = self.words[self.at[first[inside]] + k]
        _, example, number = np.unique(rows, axis=0, return_index=True, return_inverse=True) if len(first) else (rows, first, first)
        self.window_at, self.window_size = first[example], size[example]
        # what items hold a window; windows of the same items share a group
        pairs = np.unique(np.stack([number.ravel(), self.item[first]], axis=1), axis=0) if len(first) else np.zeros((0, 2), np.int64)
        edge = np.searchsorted(pairs[:, 0], np.arange(len(example) + 1))
        known: dict[bytes, int] = {}
        self.groups: list[np.ndarray] = []
        self.window_group = np.zeros(len(example), np.int64)
        for w in range(len(example)):
            held = pairs[edge[w] : edge[w + 1], 1].astype(np.int32)
            key = held.tobytes()
            if key not in known:
                known[key] = len(self.groups)
                self.groups.append(held)
            self.window_group[w] = known[key]
        ranked = np.argsort(np.array(self.names, object), kind="stable") if self.names else np.zeros(0, np.int64)
        self.sorted_names = pa.array([self.names[i] for i in ranked], pa.string())
        self.name_rank = np.zeros(len(items), np.int64)
        names = np.array(self.names, object)[ranked]
        self.name_rank[ranked] = np.cumsum(np.append(0, (names[1:] != names[:-1]).astype(np.int64))) if len(items) else ranked
        self.sorted_names = pa.array(sorted(set(self.names)), pa.string())
        self.lists: dict[bytes, np.ndarray] = {}

    def number(self, hashes: np.ndarray) -> np.ndarray:
        """Vocabulary numbers of word hashes, 0 for other words."""
        out = np.zeros(len(hashes), np.int64)
        if len(self.vocabulary):
            maybe = np.flatnonzero(self.low_bits[(hashes & np.uint64(0xFFFF)).astype(np.int64)])
            place = np.searchsorted(self.vocabulary, hashes[maybe])
            place[place == len(self.vocabulary)] = 0
            same = self.vocabulary[place] == hashes[maybe]
            out[maybe[same]] = place[same] + 1
        return out

    def items_of(self, groups: np.ndarray) -> np.ndarray:
        """Ranks of the names of the items of any of the groups, ascending."""
        key = groups.tobytes()
        if key not in self.lists:
            if len(self.lists) > 1000:
                self.lists.clear()
            self.lists[key] = np.unique(self.name_rank[np.concatenate([self.groups[g] for g in groups])])
        return self.lists[key]


def agreement(one: np.ndarray, at: np.ndarray, other: np.ndarray, there: np.ndarray, most: np.ndarray) -> np.ndarray:
    """How many words agree from places ``at`` of ``one`` and ``there`` of ``other``, up to ``most`` or a 0."""
    out = np.zeros(len(at), np.int64)
    live, step = np.arange(len(at)), np.arange(STEP)
    while len(live):
        # a 0 is followed by STEP more in both, so reading on past it is harmless
        mine, theirs = one[np.minimum(at[live, None] + out[live, None] + step, len(one) - 1)], other[np.minimum(there[live, None] + out[live, None] + step, len(other) - 1)]
        differ = (mine != theirs) | (mine == 0)
        first = np.where(differ.any(axis=1), differ.argmax(axis=1), STEP)
        out[live] += first
        live = live[(first == STEP) & (out[live] < most[live])]
    return np.minimum(out, most)


def _bound(words: np.ndarray, order: np.ndarray, test: np.ndarray, at: np.ndarray, size: np.ndarray, after: bool) -> np.ndarray:
    """Where in the suffix array ``order`` the first ``size`` words from ``at`` belong, before or after their equals."""
    low, high = np.zeros(len(at), np.int64), np.full(len(at), len(order), np.int64)
    while len(live := np.flatnonzero(low < high)):
        mid = (low[live] + high[live]) // 2
        place, mine = order[mid], at[live]
        same = agreement(words, place, test, mine, size[live])
        whole = same == size[live]
        less = np.where(whole, after, words[np.minimum(place + same, len(words) - 1)] < test[np.minimum(mine + same, len(test) - 1)])
        low[live[less]] = mid[less] + 1
        high[live[~less]] = mid[~less]
    return low


def search_shard(texts: list[str | None], test: TestSet) -> pa.StructArray:
    """Results of a shard's documents, as the fields of RESULT."""
    raw, begin = _joined(texts)
    starts, hashes = words_of(raw)
    number = test.number(hashes)
    while True:
        found, wrong = _search(raw, starts, np.append(np.searchsorted(starts, begin), len(starts)), number, test)
        if not len(wrong):
            return found
        number[wrong] = 0  # another word with the hash of a test word


def _search(raw: np.ndarray, starts: np.ndarray, bounds: np.ndarray, number: np.ndarray, test: TestSet) -> tuple[pa.StructArray | None, np.ndarray]:
    n_docs, counts = len(bounds) - 1, np.diff(bounds)
    doc_of = np.repeat(np.arange(n_docs), counts)
    at = np.arange(len(starts)) + doc_of  # a 0 after every document
    words = np.zeros(len(starts) + n_docs + STEP, np.int64)
    words[at] = number
    word_at = np.zeros(len(words), np.int64)
    word_at[at] = np.arange(len(starts))
    order = suffix_array(words, test.depth)
    # every test suffix: where it belongs, and its longest match with the suffixes before and after
    lead = words[order]
    low, high = np.searchsorted(lead, test.words[test.at], "left"), np.searchsorted(lead, test.words[test.at], "right")
    some = np.flatnonzero(low < high)
    place = low.copy()
    for part in np.array_split(some, max(1, len(some) // 50_000)):
        place[part] = _bound(words, order, test.words, test.at[part], test.rest[part], False)
    long, where = np.zeros(len(test.at), np.int64), np.full(len(test.at), -1)
    for near in (place - 1, place):
        usable = some[(near[some] >= 0) & (near[some] < len(order))]
        spot = order[near[usable]]
        same = agreement(words, spot, test.words, test.at[usable], test.rest[usable])
        better = usable[same > long[usable]]
        where[better] = spot[same > long[usable]]
        long[better] = same[same > long[usable]]
    # every place of every window
    size = test.window_size
    wanted = np.flatnonzero(long[test.window_at] >= size)
    begin, end = (_bound(words, order, test.words, test.at[test.window_at[wanted]], size[wanted], after) for after in (False, True))
    many = end - begin
    which = np.repeat(wanted, many)
    spot = order[np.repeat(begin, many) + np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many)] if len(which) else np.zeros(0, np.int64)
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, spot, 1)
    np.add.at(cover, spot + size[which], -1)
    hit = (np.cumsum(cover) > 0)[at]
    # the longest match of a document: of every place where a window begins with the nearest test suffixes
    heads = np.unique(spot)
    rank = np.zeros(len(words), np.int64)
    rank[order] = np.arange(len(order))
    by_place = place[test.order]
    after = np.searchsorted(by_place, rank[heads], "right")  # test suffixes up to ``after`` belong at or before the head
    best, partner = np.zeros(len(heads), np.int64), np.zeros(len(heads), np.int64)
    for near in (after - 1, after):
        usable = np.flatnonzero((near >= 0) & (near < len(test.order)))
        suffix = test.order[near[usable]]
        same = agreement(words, heads[usable], test.words, test.at[suffix], test.rest[suffix])
        better = same > best[usable]
        best[usable[better]], partner[usable[better]] = same[better], suffix[better]
    # compare the bytes of the words of matches; hashes alone do not prove them equal
    mine = np.repeat(word_at[heads], best) + _counting(best)
    theirs = np.repeat(partner, best) + _counting(best)
    mine, one = np.unique(mine, return_index=True)
    wrong = mine[~_same_bytes(raw, starts[mine], word_ends(raw, starts[mine]), test, theirs[one])] if len(mine) else mine
    if len(wrong):
        return None, wrong
    head_doc = doc_of[word_at[heads]]
    first = np.lexsort((heads, -best, head_doc))
    edge = np.searchsorted(head_doc[first], np.arange(n_docs + 1))
    groups = np.unique(np.stack([doc_of[word_at[spot]], test.window_group[which]], axis=1), axis=0) if len(which) else np.zeros((0, 2), np.int64)
    group_edge = np.searchsorted(groups[:, 0], np.arange(n_docs + 1))
    totals = np.append(0, np.cumsum(hit))
    n_hit = totals[bounds[1:]] - totals[bounds[:-1]]
    chosen = [first[edge[d]] if n_hit[d] else None for d in range(n_docs)]
    names = [test.items_of(groups[group_edge[d] : group_edge[d + 1], 1]) if n_hit[d] else np.zeros(0, np.int64) for d in range(n_docs)]
    offsets = np.append(0, np.cumsum([len(x) for x in names])).astype(np.int32)
    items = pa.ListArray.from_arrays(offsets, test.sorted_names.take(pa.array(np.concatenate([np.zeros(0, np.int64), *names]))))
    of = lambda f: pa.array([None if c is None else int(f(c)) for c in chosen], pa.int64())
    fields = {
        "n_words": pa.array(counts, pa.int64()), "n_hit": pa.array(n_hit, pa.int64()), "items": items,
        "longest": pa.array([0 if c is None else int(best[c]) for c in chosen], pa.int64()),
        "longest_item": pa.array([None if c is None else test.names[test.item[partner[c]]] for c in chosen], pa.string()),
        "longest_item_start": of(lambda c: test.inner[partner[c]]), "longest_start": of(lambda c: word_at[heads[c]] - bounds[head_doc[c]]),
        "hits": pa.array([np.packbits(hit[s:e]).tobytes() if k else None for s, e, k in zip(bounds[:-1], bounds[1:], n_hit)], pa.binary()),
    }
    return pa.StructArray.from_arrays(list(fields.values()), names=list(fields)), wrong


def _counting(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... for each of ``sizes``, one after the other."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _same_bytes(raw: np.ndarray, start: np.ndarray, stop: np.ndarray, test: TestSet, word: np.ndarray) -> np.ndarray:
    """Which words from ``start`` to ``stop`` are the test's words of these numbers, after A-Z became a-z."""
    size, theirs = stop - start, test.stops[word] - test.starts[word]
    same = size == theirs
    size = np.where(same, size, 0)
    unequal = _LOWER[raw[np.repeat(start, size) + _counting(size)]] != _LOWER[test.raw[np.repeat(test.starts[word], size) + _counting(size)]]
    owner = np.repeat(np.arange(len(start)), size)
    same[owner[unequal]] = False
    return same


def _merged(parts: list[dict]) -> dict:
    """Results of several blocks of the test set for one document."""
    parts = [p for p in parts if p["n_hit"]]
    best = max(parts, key=lambda p: p["longest"])
    hits = parts[0]["hits"]
    for p in parts[1:]:
        hits = (np.frombuffer(hits, np.uint8) | np.frombuffer(p["hits"], np.uint8)).tobytes()
    return best | {"items": sorted({i for p in parts for i in p["items"]}), "hits": hits, "n_hit": int(np.bitwise_count(np.frombuffer(hits, np.uint8)).sum())}


def _shards(texts: pa.Array, limit: int = SHARD_BYTES) -> Iterator[list[str | None]]:
    part, held = [], 0
    for text in texts:
        part.append(text.as_py())
        held += len(part[-1] or "")
        if held >= limit:
            yield part
            part, held = [], 0
    if part:
        yield part


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int) -> list[DataFrame]:
    """The test items in blocks of about ``block_bytes``, by ranges of the item's hash."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text")).where("item is not null")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0))).first()[0]
    blocks = max(1, -(-size // block_bytes))
    return [items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k) for k in range(blocks)]


def benchmark_matches(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    into: str = "matches", window: int = WINDOW, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``docs`` with a struct column ``into``: words, words hit, items that occur, the longest match.

    ``items`` are ids as strings, in order; ``longest`` is the number of words of the longest
    verbatim match that begins where a window does, of the item ``longest_item`` from its word
    ``longest_item_start``, at the document's word ``longest_start`` (the first such).  A test set beyond
    ``block_bytes`` takes one pass over the texts for each block; ``docs`` is then written once, and
    so are the hits of each pass, which are put together by row.

    Null and empty texts have no words; items without words or id match nothing; repeated rows and
    items are handled alike; very long texts are shards of their own; an empty table gives no rows;
    all columns of ``docs`` are kept, so ``into`` must be a new name.
    """
    if into.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"there is a column {into} already")
    spark = docs.sparkSession
    blocks = _blocks(benchmark, item_col, item_text_col, block_bytes)
    load = lambda block: spark.sparkContext.broadcast([(r.item, r.text) for r in block.collect()])  # noqa: E731  # at most about ``block_bytes``
    if len(blocks) == 1:
        return docs.withColumn(into, _matcher(load(blocks[0]), window)(F.col(text_col).cast("string")))
    key, found = fresh(docs, "row_of_docs"), fresh(docs, "matches_of_row")
    kept = written(docs.withColumn(key, F.monotonically_increasing_id()), "decontamination-rows")
    hits = None
    for k, block in enumerate(blocks):
        held = load(block)
        part = kept.select(key, _matcher(held, window)(F.col(text_col).cast("string")).alias(found))
        part = written(part if k == 0 else part.where(F.col(f"{found}.n_hit") > 0), "decontamination-hits")
        held.destroy()  # one block is in memory at a time
        hits = part if hits is None else hits.unionByName(part)
    merged = hits.groupBy(key).agg(F.collect_list(found).alias(found))  # as many as there are blocks, at most
    several = F.size(F.filter(found, lambda m: m["n_hit"] > 0)) > 1
    alone = F.coalesce(F.get(F.filter(found, lambda m: m["n_hit"] > 0), F.lit(0)), F.get(found, F.lit(0)))
    one = merged.where(~several).select(key, alone.alias(into)).unionByName(merged.where(several).select(key, _merger()(F.col(found)).alias(into)))
    return kept.join(one, key).drop(key)


def _arrow(rows: list[dict]) -> pa.StructArray:
    kinds = {"items": pa.list_(pa.string()), "longest_item": pa.string(), "hits": pa.binary()}
    fields = [f.split()[0] for f in RESULT.split(", ")]
    return pa.StructArray.from_arrays([pa.array([r[f] for r in rows], kinds.get(f, pa.int64())) for f in fields], names=fields)


_TYPE = f"struct<{', '.join(f.replace(' ', ': ') for f in RESULT.split(', '))}>"


def _merger():
    @F.arrow_udf(_TYPE)
    def merge(parts: pa.Array) -> pa.Array:
        return _arrow([_merged(p) for p in parts.to_pylist()])

    return merge


def _matcher(items, window: int):
    held: list[TestSet] = []

    @F.arrow_udf(_TYPE)
    def search(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        if not held:
            held.append(TestSet(items.value, window))
        for texts in batches:
            parts = [search_shard(shard, held[0]) for shard in _shards(texts)]
            yield pa.concat_arrays(parts) if parts else _arrow([])

    return search


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the documents that contain any window of the test set; columns as they were."""
    name = fresh(docs, "matches")
    found = benchmark_matches(docs, benchmark, text_col, into=name, **options)
    return found.where(F.col(f"{name}.n_hit") == 0).drop(name)


def items_digest(items: Column) -> Column:
    """sha256 of item ids sorted as strings and comma-joined."""
    return F.sha2(F.array_join(F.array_sort(items), ","), 256)
