"""Passages of held-out items inside a large corpus, found with spaced seeds.

A mask selects some of the positions of a window of consecutive words. The selected words are hashed, so that a
window matches under a mask whatever stands at the ignored positions. The hashes of all windows of the items are joined
with those of all windows of the corpus. For each pair that a hash brings together, the hits fix the diagonals on which
the two texts lie over each other; there they are compared word by word over the whole length of the item, with room
for substituted words.

An item has the masks of the largest span that it is long enough for; the shortest items match as a whole only.

The windows of the corpus outnumber those of the items by far. Before the join they pass a bit array of the items'
hashes whose size is bounded (``MAX_BITS``). It only drops windows that cannot match: with very many items it drops
less and the join does more, with the same result. A window that repeats within a text counts once in the join.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relweave.session import cut, spread

#: Fixed masks over 12 words; 1 selects a position. All have the span 12, so a run of 12 equal words matches under each.
MASKS = ("111011010111", "110101101111", "101110111011")
SPAN = 12
#: Masks of shorter items: of 6 to 11 words, and of 1 to 5, which must stand as a whole.
SHORT_MASKS = ("110111", "111011")
ALL_MASKS = (*MASKS, *SHORT_MASKS, "11111", "1111", "111", "11", "1")
#: The bit array of the items' hashes has at most so many bits (32 MB); a page of it has 64 KB.
MIN_BITS, MAX_BITS, PAGE = 1 << 23, 1 << 28, 1 << 16
PROBES = 4
#: Up to so many substituted words in a row do not end an overlap.
MAX_GAP = 2
#: Words, or hits of a pair, handled at once, so that a batch of long texts stays small.
BLOCK_WORDS = 1 << 20
CACHE = 200_000
#: Item windows that are broadcast at most (20 bytes each); of more, both sides are shuffled.
BROADCAST_WINDOWS = 1_000_000
#: A hash in more documents than this is split into so many parts, where both sides are shuffled.
HOT, SALTS = 100_000, 64
#: Words of all items up to which these are broadcast to the comparison (8 bytes each).
BROADCAST_WORDS = 8_000_000

_WORD = re.compile(r"[^\W_]+")


class Words:
    """Texts to arrays of 64-bit word hashes."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def __call__(self, text: str) -> np.ndarray:
        words = _WORD.findall(text.lower())
        known = self.known
        if len(known) > CACHE:
            known.clear()
        for w in set(words):
            if w not in known:
                known[w] = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"))
        return np.fromiter((known[w] for w in words), "u8", len(words))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def masked_hashes(words: np.ndarray, mask: str) -> np.ndarray:
    """The hash of every window of ``len(mask)`` words under ``mask``, by the window's start."""
    n = max(0, len(words) - len(mask) + 1)
    h = np.full(n, 0x9E3779B97F4A7C15, "u8")
    for k, bit in enumerate(mask):
        if bit == "1":
            h = (h * np.uint64(0x100000001B3)) ^ words[k : k + n]
            h = h * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k + 1)
    return _mix(h)


def masks_of(n_words: int, masks: tuple[str, ...] = ALL_MASKS) -> list[int]:
    """The numbers of the masks of the largest span that a text of so many words has room for."""
    span = max((len(m) for m in masks if len(m) <= n_words), default=0)
    return [k for k, m in enumerate(masks) if len(m) == span]


def _blocks(ids, texts, words: Words) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of texts: all words, the row of each text, and how many words it has."""
    some, rows, at, n = [], [], [], 0
    for k, (key, text) in enumerate(zip(ids, texts)):
        if text is None or key is None:
            continue
        w = words(text)
        if not len(w):
            continue
        some.append(w)
        rows.append(k)
        at.append(len(w))
        n += len(w)
        if n >= BLOCK_WORDS:
            yield np.concatenate(some), np.array(rows), np.array(at)
            some, rows, at, n = [], [], [], 0
    if some:
        yield np.concatenate(some), np.array(rows), np.array(at)


def _windows(masks: tuple[str, ...], bits: np.ndarray | None):
    """Batches of (id, text) to different (mask, hash, id, null), of the windows that the bit array lets through, and of every
    text that has such a window a row (-1, null, id, text).

    Without a bit array the texts are items, which have the masks of their length only, and are not passed on.
    """
    names = ["mask", "hash", "id", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for w, rows, lengths in _blocks(ids, texts, words):
                keys = np.array([ids[k] for k in rows], "i8")
                starts = np.cumsum(lengths) - lengths
                owner = np.repeat(np.arange(len(keys)), lengths)
                left = lengths[owner] - (np.arange(len(w)) - starts[owner])
                own = np.array([len(masks[k[0]]) if (k := masks_of(n, masks)) else 0 for n in lengths]) if bits is None else None
                met = np.zeros(len(keys), bool)
                for m, mask in enumerate(masks):
                    h = masked_hashes(w, mask)
                    keep = (left >= len(mask))[: len(h)]  # windows within one text
                    if bits is None:
                        keep &= (own == len(mask))[owner[: len(h)]]
                    else:
                        keep &= _in_bits(h, bits)
                    at = np.flatnonzero(keep)
                    if not len(at):
                        continue
                    order = at[np.lexsort((h[at], owner[at]))]
                    new = np.r_[True, (h[order][1:] != h[order][:-1]) | (owner[order][1:] != owner[order][:-1])]
                    at = order[new]
                    met[owner[at]] = True
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), m, "i4")), pa.array(h[at].view("i8")), pa.array(keys[owner[at]]), pa.nulls(len(at), pa.string())], names)
                if bits is not None and met.any():
                    at = np.flatnonzero(met)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), -1, "i4")), pa.nulls(len(at), pa.int64()), pa.array(keys[at]), pa.array([texts[k] for k in rows[at]], pa.string())], names)

    return run


def _probe(h: np.ndarray, k: int, n_bits: int) -> np.ndarray:
    return (h + np.uint64(k) * ((h >> np.uint64(32)) | np.uint64(1)) * np.uint64(0x9E3779B1)) & np.uint64(n_bits - 1)


def _in_bits(h: np.ndarray, bits: np.ndarray) -> np.ndarray:
    found = np.ones(len(h), bool)
    for k in range(PROBES):  # most windows end at the first probe
        at = np.flatnonzero(found)
        probe = _probe(h[at], k, len(bits) * 8)
        found[at] = (bits[probe >> np.uint64(3)] >> (probe & np.uint64(7)).astype("u1")) & 1 == 1
    return found


def _page_bits(n_bits: int):
    """The hashes of one page, as (page, probe), to its bytes."""

    def run(key, rows):
        bits = np.zeros(min(PAGE, n_bits // 8), "u1")
        probe = rows.column("probe").to_numpy()
        np.bitwise_or.at(bits, probe >> 3, np.left_shift(1, probe & 7).astype("u1"))
        return pa.table({"page": pa.array([key[0].as_py()], pa.int32()), "bytes": pa.array([bits.tobytes()], pa.binary())})

    return run


def _probe_rows(n_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            probes = np.unique(np.concatenate([_probe(batch.column(0).to_numpy().view("u8"), k, n_bits) for k in range(PROBES)])).astype("i8")
            yield pa.RecordBatch.from_arrays([pa.array((probes // (8 * PAGE)).astype("i4")), pa.array((probes % (8 * PAGE)).astype("i4"))], ["page", "probe"])

    return run


def _bit_array(hashes: DataFrame, n: int) -> np.ndarray:
    n_bits = int(min(MAX_BITS, max(MIN_BITS, 1 << (24 * max(1, n) - 1).bit_length())))
    probes = hashes.select("hash").mapInArrow(_probe_rows(n_bits), "page int, probe int").distinct()
    pages = probes.groupBy("page").applyInArrow(_page_bits(n_bits), "page int, bytes binary").toArrow()  # at most MAX_BITS / 8 bytes
    bits = np.zeros(n_bits // 8, "u1")
    for page, content in zip(pages.column("page").to_pylist(), pages.column("bytes").to_pylist()):
        bits[page * PAGE : page * PAGE + len(content)] = np.frombuffer(content, "u1")
    return bits


def overlaps(same: np.ndarray, starts: np.ndarray, span: int) -> tuple[int, int, int]:
    """Of two texts on one diagonal, where they are the ``same``, and hits of ``span`` words at ``starts``: the longest run of
    equal words, the length of the longest overlap, and the words substituted in it. Only overlaps with a hit count."""
    hits = np.flatnonzero(same)
    ends = np.flatnonzero(np.diff(hits) > MAX_GAP + 1)
    first, last = hits[np.r_[0, ends + 1]], hits[np.r_[ends, len(hits) - 1]]
    seeded = np.zeros(len(first), bool)
    seeded[np.searchsorted(first, starts, "right") - 1] = True
    edges = np.flatnonzero(np.diff(np.r_[False, same, False].astype("i1"))).reshape(-1, 2)
    within = seeded[np.searchsorted(first, edges[:, 0], "right") - 1]
    exact = int((edges[within, 1] - edges[within, 0]).max())
    counts = np.diff(np.r_[0, ends + 1, len(hits)])
    best = max(zip((last - first + 1)[seeded].tolist(), counts[seeded].tolist()))
    return exact, best[0], best[0] - best[1]


class Document:
    """The words of a document, with the windows of each mask in order of their hashes."""

    def __init__(self, words: np.ndarray, masks: tuple[str, ...]):
        self.words, self.masks, self.sorted = words, masks, {}

    def windows(self, m: int) -> tuple[np.ndarray, np.ndarray]:
        if m not in self.sorted:
            h = masked_hashes(self.words, self.masks[m])
            order = np.argsort(h, kind="stable")
            self.sorted[m] = h[order], order
        return self.sorted[m]

    def compare(self, item: np.ndarray) -> tuple[int, int, int] | None:
        """(exact_run, overlap_words, substituted) over all diagonals with a hit; None if there is no hit."""
        exact, best, seen = 0, (0, 0), set()
        for m in masks_of(len(item), self.masks):
            mask = self.masks[m]
            offsets = np.array([k for k, bit in enumerate(mask) if bit == "1"])
            h, order = self.windows(m)
            own = masked_hashes(item, mask)
            low, high = np.searchsorted(h, own, "left"), np.searchsorted(h, own, "right")
            ends = np.cumsum(high - low)
            at = 0
            while at < len(own):
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BLOCK_WORDS, "right")))
                n = (high - low)[at:to]
                i = np.repeat(np.arange(at, to), n)
                j = order[np.repeat(low[at:to], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
                for shift in np.unique(j - i).tolist():
                    if (shift, m) in seen:
                        continue
                    seen.add((shift, m))
                    back, ahead = max(0, -shift), min(len(item), len(self.words) - shift)
                    same = item[back:ahead] == self.words[back + shift : ahead + shift]
                    hit = np.flatnonzero(same[: len(same) - len(mask) + 1])
                    hit = hit[same[hit[:, None] + offsets].all(axis=1)]
                    if not len(hit):
                        continue  # equal hashes of different words
                    run, length, substituted = overlaps(same, hit, len(mask))
                    exact, best = max(exact, run), max(best, (length, -substituted))
                    if exact == len(item):
                        return exact, exact, 0  # nothing can be better
                at = to
        return (exact, best[0], -best[1]) if best[0] else None


def _word_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words = Words()
    for batch in batches:
        out = [words(t).view("i8") for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int64()))], ["item_id", "words"])


def _compared(masks: tuple[str, ...]):
    """Rows of (doc_id, item_id, text, words), of each document first the text and then the words of its items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, last, document = Words(), None, None
        for batch in batches:
            docs, items = batch.column("doc_id").to_pylist(), batch.column("item_id").to_pylist()
            out = []
            for k, (doc, item) in enumerate(zip(docs, items)):
                if item is None:
                    text = batch.column("text")[k].as_py()
                    if doc != last:
                        last, document = doc, []
                    document.append(Document(words(text), masks))
                elif doc == last:
                    x = batch.column("words")[k].values.to_numpy().view("u8")
                    out += [(item, doc, *got) for d in document if (got := d.compare(x))]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()))], ["item_id", "doc_id", "exact_run", "overlap_words", "substituted"])

    return run


def leaks(items: DataFrame, documents: DataFrame, item_id: str = "item_id", doc_id: str = "doc_id", text: str = "text", masks: tuple[str, ...] = ALL_MASKS) -> DataFrame:
    """Per item and document with a hit: (item_id, doc_id, exact_run, overlap_words, substituted).

    An overlap is a stretch of both texts in which at most ``MAX_GAP`` words in a row differ, with a hit in it, a window that
    is equal at the positions of one of the item's masks. ``overlap_words`` is the length of the longest, ``substituted``
    how many of its words differ, ``exact_run`` the longest run of equal words in any. Items of 12 and more words have
    the masks of 12 words, those of 6 to 11 words masks of 6; shorter ones must stand as a whole. Words are lower-case
    runs of letters and digits; what separates them does not count. Null texts and ids and texts without a word have no
    windows. Of texts that share an id each counts on its own. Other columns are dropped.
    """
    spark = items.sparkSession
    i = items.select(F.col(item_id).cast("bigint").alias("id"), F.col(text).cast("string").alias("text")).dropna().distinct()
    d = documents.select(F.col(doc_id).cast("bigint").alias("id"), F.col(text).cast("string").alias("text"))
    item_windows = cut(i.mapInArrow(_windows(masks, None), "mask int, hash bigint, id bigint, text string").drop("text"))
    size = item_windows.agg(F.count("*").alias("n"), F.collect_set("mask").alias("masks")).first()
    used = sorted(size.masks)  # spans that no item has need no windows of the corpus
    shipped = spark.sparkContext.broadcast(_bit_array(item_windows, size.n))  # at most MAX_BITS / 8 bytes
    met = spread(d).mapInArrow(lambda batches: _windows(tuple(masks[k] for k in used), shipped.value)(batches), "mask int, hash bigint, id bigint, text string")
    # what the documents give is written once: few windows, and the texts that have some
    met = cut(met)
    doc_windows = met.filter("mask >= 0").select(F.get(F.array(*map(F.lit, used)).cast("array<int>"), F.col("mask")).alias("mask"), "hash", F.col("id").alias("doc_id"))
    item_side = item_windows.select("mask", "hash", F.col("id").alias("item_id"))
    if size.n <= BROADCAST_WINDOWS:
        hits = doc_windows.join(F.broadcast(item_side), ["mask", "hash"])
    else:
        hot = F.broadcast(doc_windows.groupBy("mask", "hash").count().filter(F.col("count") > HOT).select("mask", "hash", F.lit(SALTS).alias("salts")))  # a row per HOT rows at most
        salted = doc_windows.join(hot, ["mask", "hash"], "left").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")
        copies = item_side.join(hot, ["mask", "hash"], "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
        hits = salted.join(copies, ["mask", "hash", "salt"])
    pairs = cut(hits.select("item_id", "doc_id").distinct())
    words = i.select(F.col("id").alias("item_id"), "text").mapInArrow(_word_rows, "item_id bigint, words array<bigint>")
    if (i.agg(F.sum(F.length("text"))).first()[0] or 0) <= BROADCAST_WORDS:
        words = F.broadcast(words)  # there are no more words than characters
    compared = pairs.join(words, "item_id").select("doc_id", "item_id", F.lit(None).cast("string").alias("text"), "words")
    texts = met.filter("mask < 0").join(pairs.select(F.col("doc_id").alias("id")).distinct(), "id", "left_semi").select("id", "text").distinct()
    texts = texts.select(F.col("id").alias("doc_id"), F.lit(None).cast("bigint").alias("item_id"), "text", F.lit(None).cast("array<bigint>").alias("words"))
    # each document's text goes once to where its items are; nulls come first in the order
    stream = texts.unionByName(compared).repartition("doc_id").sortWithinPartitions("doc_id", "item_id")
    found = stream.mapInArrow(_compared(masks), "item_id bigint, doc_id bigint, exact_run int, overlap_words int, substituted int")
    best = F.max(F.struct("overlap_words", (-F.col("substituted")).alias("minus")))
    return (
        found.groupBy("item_id", "doc_id")
        .agg(F.max("exact_run").alias("exact_run"), best.alias("best"))
        .select("item_id", "doc_id", "exact_run", F.col("best.overlap_words").alias("overlap_words"), (-F.col("best.minus")).alias("substituted"))
    )


def leaked_runs(items: DataFrame, documents: DataFrame, min_run: int = SPAN) -> DataFrame:
    """The distinct pairs (item_id, doc_id) with at least ``min_run`` equal consecutive words; ``min_run`` >= ``SPAN``.

    A run of ``SPAN`` equal words matches under every mask of that span, so one of them finds all pairs.
    """
    if min_run < SPAN:
        raise ValueError(f"runs shorter than the masks' span of {SPAN} are not found with certainty")
    return leaks(items, documents, masks=MASKS[:1]).filter(F.col("exact_run") >= min_run).select("item_id", "doc_id")
