"""Evaluation passages in documents: pieces by the pigeonhole principle, verified by bit-parallel edit distance."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.llm.markup import without_templates
from tidegauge.session import spread, stored

#: Words of a window: about a dozen in a row make a leak.
WINDOW = 12
#: Words of a window that may be changed, added or left out.
BUDGET = 2
#: Words of a piece; BUDGET + 1 pieces make a window, so one of them is untouched.
PIECE = WINDOW // (BUDGET + 1)
#: Places of windows this near meet the same words.
BLUR = 2
#: A sentence that so many items have, but for one word, may be an instruction or question; see passages.
RECURS = 3
#: Windows of up to so many words' places are broadcast; more are joined with the documents' pieces by shuffle.
BROADCAST_WINDOWS = 200_000
#: Bits of the filter over piece keys that documents are held against before that shuffle.
FILTER_BITS = 1 << 26

# Letters of other scripts that look like Latin ones.
LOOKALIKES = str.maketrans("аеорсухіјѕһԁԛԝвкмнтгαεορυικντ", "aeopcyxijshdqwbkmhtraeopuiknt")

_LOOKS = regex.compile(r"[\u0370-\u052f]")
_MIXED = regex.compile(r"\w*(?:[a-z]\w*[\u0370-\u052f]|[\u0370-\u052f]\w*[a-z])\w*")
_MARKS = regex.compile(r"\p{Mn}+")
_INVISIBLE = regex.compile(r"\p{Cf}+")
_BROKEN = regex.compile(r"(?<=\p{L})[-‐]\r?\n(?=\p{Ll})")
_LINK = regex.compile(r"\[\[(?:[^\[\]|]*\|)?([^\[\]|]*)\]\]")
_WORD = regex.compile(r"[\p{L}\p{N}]+(?:['’][\p{L}]+)?")
_MARKUP = regex.compile(r"<!--.*?-->|<ref[^>/]*/>|<ref[^>]*>.*?</ref>|</?[a-z][^<>]*>", regex.S | regex.I)
_CELL = regex.compile(r"^(?:\{\||\|\}|\|-|!).*$|^\|[^|\n]*\d+\s*$|^[*#:;|]+", regex.M)
_PLAIN_WORD = re.compile(r"[a-z0-9]+(?:'[a-z]+)?")
_SENTENCE = regex.compile(r"(?<=[.?!])\s+")


def words(text: str, strip: bool = False) -> list[str]:
    """Words of a text without its dress: case, accents, look-alike letters, links, entities, breaks.

    With strip also without comments, references, templates, tags and table marks.
    """
    if "&" in text:
        text = html.unescape(text)
    if strip:
        if "<" in text:
            text = _MARKUP.sub(" ", text)
        text = _CELL.sub(" ", without_templates(text))
    if not text.isascii():
        text = _INVISIBLE.sub("", text)
    if "[[" in text:
        text = _LINK.sub(r"\1", text)
    if "-\n" in text or "-\r" in text or "\u2010" in text:
        text = _BROKEN.sub("", text)
    if not text.isascii():
        text = _MARKS.sub("", unicodedata.normalize("NFKD", text))
    text = text.casefold()
    if text.isascii():
        return _PLAIN_WORD.findall(text)
    if _LOOKS.search(text):
        text = _MIXED.sub(lambda m: m.group().translate(LOOKALIKES), text)
    return _WORD.findall(text)


def sentences(text: str) -> list[tuple[list[str], bool]]:
    """Words of each sentence, and whether it is a question."""
    return [(w, s.rstrip("\"'”’)» ").endswith("?")) for s in _SENTENCE.split(text) if (w := words(s))]


def word_ids(found: list[str], known: dict[str, int]) -> np.ndarray:
    """A 64-bit id for each word, the same on every machine; known remembers them."""
    if len(known) > 1_000_000:
        known.clear()
    for w in found:
        if w not in known:
            known[w] = xxhash.xxh64_intdigest(w) >> 1
    return np.fromiter((known[w] for w in found), np.int64, len(found))


def open_keys(ids: np.ndarray) -> np.ndarray:
    """For each place of a sentence a key of the sentence with that place left open, in one pass."""
    n = len(ids)
    place = np.cumprod(np.full(n, 0x9E3779B97F4A7C15, np.uint64))
    part = ids.astype(np.uint64) * place
    rest = part.sum(dtype=np.uint64) - part
    key = (rest ^ (rest >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) + place + np.uint64(n)
    return (key ^ (key >> np.uint64(29))).astype(np.int64)


def passages(items: DataFrame, recurs: int = RECURS) -> DataFrame:
    """items(item_id, text) as item_id and words of the passage, without the instructions and questions around it.

    A sentence recurs if at least recurs items have it, one and the same word left
    open. Recurring alone makes no instruction, as several items may share one
    passage; the role in the item decides. An item has a passage of its own if its
    sentences that don't recur, questions apart, are WINDOW words or more and no
    fewer than its recurring ones. There all that recurs is left out. Any other item
    keeps, beside what doesn't recur, those of its recurring sentences that aren't
    questions and stand beside few passages: an instruction stands beside many, the
    sentences of a shared passage beside their own. A sentence may stand beside
    twice as many as the one of its item that stands beside the fewest.
    """
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, int] = {}
        for pdf in batches:
            rows = []
            for item, text in zip(pdf["item_id"], pdf["text"]):
                for n, (s, asks) in enumerate(sentences(text)):
                    rows.append((item, n, " ".join(s), len(s), asks, open_keys(word_ids(s, known))))
            if rows:
                yield pd.DataFrame(rows, columns=["item_id", "n", "sentence", "size", "asks", "open"])

    slim = items.where("item_id is not null and text is not null").select(F.col("item_id").cast("long"), "text")
    parts = stored(slim.mapInPandas(cut, "item_id long, n int, sentence string, size int, asks boolean, open array<long>"))
    opened = parts.select("item_id", "n", F.explode("open").alias("key"))
    usual = opened.groupBy("key").agg(F.count_distinct("item_id").alias("items")).where(F.col("items") >= recurs)
    common = opened.join(usual, "key").groupBy("item_id", "n").agg(F.max(F.struct("items", "key")).alias("c"))
    marked = parts.drop("open").join(common, ["item_id", "n"], "left").select("item_id", "n", "sentence", "size", "asks", "c.items", "c.key")
    once, again = F.col("items").isNull() & ~F.col("asks"), F.col("items").isNotNull() & ~F.col("asks")
    count = lambda rule: F.coalesce(F.sum(F.when(rule, F.col("size"))), F.lit(0))
    has_own = marked.groupBy("item_id").agg(((count(once) >= WINDOW) & (count(once) >= count(again))).alias("has_own"))
    rated = marked.join(has_own, "item_id")
    # An item's passage is named by the item, or by the rarest sentence that it shares.
    rarest = F.min(F.when(again, F.struct("items", "key"))).over(Window.partitionBy("item_id"))["key"]
    named = rated.withColumn("passage", F.when(F.col("has_own"), F.concat(F.lit("item "), F.col("item_id"))).otherwise(rarest.cast("string")))
    company = named.where("items is not null").groupBy("key").agg(F.count_distinct("passage").alias("beside"))
    roles = named.join(company, "key", "left")
    shared = again & ~F.col("has_own")
    fewest = F.min(F.when(shared, F.col("beside"))).over(Window.partitionBy("item_id"))
    kept = roles.withColumn("fewest", fewest).where(F.col("items").isNull() | shared & (F.col("beside") <= 2 * F.col("fewest")))
    return kept.groupBy("item_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "sentence"))), lambda s: s["sentence"]), " ").alias("words")
    )


def windows_of(ids: list[int]) -> Iterator[tuple[list[int], int]]:
    """Windows of a passage and the words of each that may differ; a passage of under PIECE words has none."""
    size = min(WINDOW, len(ids))
    if size >= PIECE:
        budget = min(BUDGET, size // PIECE - 1)
        for start in range(len(ids) - size + 1):
            yield ids[start : start + size], budget


@dataclass
class Pieces:
    """Windows of a block of items and the keys of their pieces."""

    vocabulary: dict[str, int]
    items: np.ndarray  # that have a window, flat over the windows
    first: np.ndarray  # of each window's items; one more at the end
    window: np.ndarray  # windows x WINDOW word ids, padded with -1
    length: np.ndarray
    budget: np.ndarray
    keys: np.ndarray  # of each piece, sorted
    owner: np.ndarray  # its window
    offset: np.ndarray  # its place in the window

    @classmethod
    def of(cls, block: list[tuple[int, list[str]]]) -> Pieces:
        vocabulary: dict[str, int] = {}
        held: dict[tuple[int, ...], list[int]] = {}
        for item, passage in block:
            ids = [vocabulary.setdefault(w, len(vocabulary) + 1) for w in passage]
            for own, budget in windows_of(ids):
                held.setdefault((budget, *own), []).append(item)
        budgets = np.array([w[0] for w in held], np.int64)
        lengths = np.array([len(w) - 1 for w in held], np.int64)
        window = np.full((len(held), WINDOW), -1, np.int64)
        for row, w in zip(window, held):
            row[: len(w) - 1] = w[1:]
        owner = np.repeat(np.arange(len(held)), budgets + 1)
        offset = (np.arange(len(owner)) - np.repeat(np.cumsum(budgets + 1) - budgets - 1, budgets + 1)) * PIECE
        key = mix(window[owner[:, None], offset[:, None] + np.arange(PIECE)]) if len(owner) else np.zeros(0, np.int64)
        order = np.argsort(key, kind="stable")
        first = np.cumsum([0, *map(len, held.values())])
        items = np.array([i for own in held.values() for i in own], np.int64)
        return cls(vocabulary, items, first, window, lengths, budgets, key[order], owner[order], offset[order])


def mix(grams: np.ndarray) -> np.ndarray:
    """One key for each row of word ids; a collision costs a verification, no more."""
    key = np.zeros(len(grams), np.uint64)
    for column in grams.T:
        key = (key ^ column.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key.astype(np.int64)


def distances(pattern: np.ndarray, length: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Least edit distance of each pattern to any part of its text, all at once by Myers' bit vectors."""
    one = np.int64(1)
    full = (one << length) - one
    top = length - one
    pv, mv = full.copy(), np.zeros_like(full)
    score = length.copy()
    best = length.copy()
    bits = one << np.arange(pattern.shape[1], dtype=np.int64)
    for j in range(text.shape[1]):
        eq = ((pattern == text[:, j : j + 1]) * bits).sum(axis=1)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (~(xh | pv) & full)
        mh = pv & xh
        score = score + ((ph >> top) & one) - ((mh >> top) & one)
        ph, mh = (ph << one) & full, (mh << one) & full
        pv, mv = mh | (~(xv | ph) & full), ph & xv
        best = np.minimum(best, score)
    return best


#: Unknown words between texts that are searched together; no window with its shifts reaches over them.
GAP = WINDOW + 2 * BUDGET
#: Words of the texts that are searched together.
LOT_WORDS = 200_000


def leaked(pieces: Pieces, texts: list[list[str]]) -> list[set[int]]:
    """For each text, given as words, the items whose passage stands in it."""
    out: list[set[int]] = [set() for _ in texts]
    sizes = np.array([len(t) for t in texts], np.int64)
    if not sizes.sum() or not len(pieces.keys):
        return out
    get = pieces.vocabulary.get
    flat = np.fromiter((get(w, 0) for t in texts for w in t), np.int64, int(sizes.sum()))
    first = np.cumsum(sizes + GAP) - sizes
    ids = np.zeros(int(first[-1] + sizes[-1]) + GAP, np.int64)
    ids[np.repeat(first - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(flat))] = flat
    known = np.concatenate([[0], np.cumsum(ids > 0)])
    at = np.flatnonzero(known[PIECE:] - known[:-PIECE] == PIECE)
    key = mix(ids[at[:, None] + np.arange(PIECE)])
    low, high = np.searchsorted(pieces.keys, key, "left"), np.searchsorted(pieces.keys, key, "right")
    count = high - low
    if not count.sum():
        return out
    hit = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(count.sum())
    window, start = pieces.owner[hit], np.repeat(at, count) - pieces.offset[hit]
    pairs = np.unique(start * len(pieces.window) + window)
    start, window = pairs // len(pieces.window), pairs % len(pieces.window)
    padded = np.concatenate([ids, np.zeros(GAP, np.int64)])
    near = np.zeros(len(start), bool)
    far = np.empty(len(start), np.int64)
    for i in range(0, len(start), 50_000):
        part = slice(i, i + 50_000)
        text = padded[(start[part] - BUDGET)[:, None] + np.arange(GAP)]
        far[part] = distances(pieces.window[window[part]], pieces.length[window[part]], text)
        near[part] = far[part] <= pieces.budget[window[part]]
    window, start, far = window[near], start[near], far[near]
    # Passages share phrases: where several windows meet the same words, the nearest have them. Starts are in order.
    low, high = np.searchsorted(start, start - BLUR), np.searchsorted(start, start + BLUR, side="right")
    least = far.copy()
    for step in range(1, int((high - low).max(initial=1))):
        for a, b in ((slice(step, None), slice(None, -step)), (slice(None, -step), slice(step, None))):
            beside = np.abs(start[a] - start[b]) <= BLUR
            least[a] = np.where(beside, np.minimum(least[a], far[b]), least[a])
    best = far <= least
    text_of = np.searchsorted(first - GAP, start[best], side="right") - 1
    for t, w in zip(text_of.tolist(), window[best].tolist()):
        out[t].update(pieces.items[pieces.first[w] : pieces.first[w + 1]].tolist())
    return out


def both_forms(body: str) -> list[list[str]]:
    """Words of a text as it stands, and again without its markup if it has some."""
    return [words(body), words(body, strip=True)] if "{" in body or "<" in body or "|" in body else [words(body)]


def find_leaks(
    documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", broadcast_windows: int = BROADCAST_WINDOWS
) -> DataFrame:
    """item_id and doc_id of every item whose passage a document repeats, in whole or WINDOW words of it.

    items(item_id, text) is the stated query set. Up to BUDGET of the WINDOW words
    may differ; a passage of fewer words must be met in whole, with one change for
    every PIECE words after the first PIECE, and one of fewer than PIECE words is
    never met. Each document is searched as it stands and again without its markup.
    Where windows meet the same words, BLUR words apart at most, only the nearest
    count, and all items that have them. Null texts and null items give no row; a
    null doc_id is reported as null; repeated rows give repeated rows. Texts are
    searched whole, whatever their length, in one scan of the documents: the windows
    of all passages are broadcast if they are broadcast_windows at most, else joined.
    """
    slim = spread(documents.select(documents[doc_id].alias("doc_id"), documents[text].alias("text")).where("text is not null"))
    held = stored(passages(items))
    size = F.size(F.split("words", " "))
    places = held.agg(F.sum(F.greatest(size - (WINDOW - 1), F.lit(1)))).first()[0] or 0
    return _by_broadcast(slim, held) if places <= broadcast_windows else _by_join(slim, held)


def _by_broadcast(slim: DataFrame, held: DataFrame) -> DataFrame:
    block = [(r["item_id"], r["words"].split()) for r in held.collect()]
    shared = slim.sparkSession.sparkContext.broadcast(Pieces.of(block))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces = shared.value
        for pdf in batches:
            docs, hits, forms, of, held = [], [], [], [], 0
            ids = pdf["doc_id"].tolist()
            for i, body in enumerate(pdf["text"]):
                own = both_forms(body)
                forms += own
                of += [i] * len(own)
                held += sum(map(len, own))
                if held >= LOT_WORDS or i == len(pdf) - 1:
                    found: dict[int, set[int]] = {}
                    for row, items in zip(of, leaked(pieces, forms)):
                        if items:
                            found.setdefault(row, set()).update(items)
                    for row, items in found.items():
                        hits += items
                        docs += [ids[row]] * len(items)
                    forms, of, held = [], [], 0
            yield pd.DataFrame({"item_id": pd.Series(hits, dtype="int64"), "doc_id": pd.Series(docs, dtype=pdf["doc_id"].dtype)})

    return slim.mapInPandas(search, f"item_id long, doc_id {dict(slim.dtypes)['doc_id']}")


#: Words of a document around a piece: every place of a window that has the piece, with its possible shifts.
_BEFORE, _AFTER = WINDOW - PIECE + BUDGET, WINDOW + BUDGET


def _by_join(slim: DataFrame, held: DataFrame) -> DataFrame:
    """The same search with the pieces as a table; see find_leaks.

    Documents send only the pieces that pass a filter of FILTER_BITS bits over all
    piece keys, each with the words around it. Common pieces are left to the skew
    join of adaptive execution; candidates are verified where they meet.
    """
    spark = slim.sparkSession
    kind = dict(slim.dtypes)["doc_id"]

    def windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, int] = {}
        for pdf in batches:
            rows = []
            for item, text in zip(pdf["item_id"], pdf["words"]):
                for own, budget in windows_of(word_ids(text.split(), known).tolist()):
                    rows.append((item, np.array(own, np.int64).tobytes(), budget))
            if rows:
                yield pd.DataFrame(rows, columns=["item_id", "content", "budget"])

    owners = stored(held.repartition("item_id").mapInPandas(windows, "item_id long, content binary, budget int"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            n = pdf["budget"].to_numpy() + 1
            row = np.repeat(np.arange(len(pdf)), n)
            offset = (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)) * PIECE
            width = PIECE * 8
            gram = b"".join(c[o * 8 : o * 8 + width] for c, o in zip(pdf["content"].to_numpy()[row], offset.tolist()))
            yield pd.DataFrame({
                "key": mix(np.frombuffer(gram, np.int64).reshape(-1, PIECE)), "content": pdf["content"].to_numpy()[row],
                "budget": pdf["budget"].to_numpy()[row], "offset": offset.astype(np.int32),
            })

    pieces = stored(owners.select("content", "budget").distinct().mapInPandas(cut, "key long, content binary, budget int, offset int"))
    bit = F.pmod("key", F.lit(FILTER_BITS)) + 1
    # Rows of 4 kB, FILTER_BITS / 32768 of them at most, however many pieces there are.
    maps = pieces.groupBy(F.bitmap_bucket_number(bit).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("m")).collect()
    bits = np.zeros((FILTER_BITS // 32768, 4096), np.uint8)
    for r in maps:
        bits[r["b"] - 1] = np.frombuffer(bytes(r["m"]), np.uint8)
    shared = spark.sparkContext.broadcast(bits.ravel())

    def survivors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, int] = {}
        flat = shared.value
        for pdf in batches:
            for row, doc, body in zip(pdf["row"], pdf["doc_id"], pdf["text"]):
                for form, found in enumerate(both_forms(body)):
                    if len(found) < PIECE:
                        continue
                    ids = word_ids(found, known)
                    key = mix(np.lib.stride_tricks.sliding_window_view(ids, PIECE))
                    at = np.mod(key, FILTER_BITS)
                    at = np.flatnonzero(flat[at >> 3] >> (at & 7).astype(np.uint8) & 1)
                    if not len(at):
                        continue
                    padded = np.concatenate([np.zeros(_BEFORE, np.int64), ids, np.zeros(_AFTER, np.int64)])
                    around = padded[at[:, None] + np.arange(_BEFORE + _AFTER)]
                    yield pd.DataFrame({
                        "row": row, "doc_id": pd.Series([doc] * len(at), dtype=pdf["doc_id"].dtype), "form": form, "at": at.astype(np.int32), "key": key[at],
                        "around": [a.tobytes() for a in around],
                    })

    shape = f"row long, doc_id {kind}, form int, at int, key long, around binary"
    sent = slim.withColumn("row", F.monotonically_increasing_id()).select("row", "doc_id", "text").mapInPandas(survivors, shape)
    met = sent.join(pieces, "key")

    def verified(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            length = pdf["content"].map(len).to_numpy() // 8
            window = np.full((len(pdf), WINDOW), -1, np.int64)
            window[np.arange(WINDOW) < length[:, None]] = np.frombuffer(b"".join(pdf["content"]), np.int64)
            around = np.frombuffer(b"".join(pdf["around"]), np.int64).reshape(len(pdf), -1)
            first = _BEFORE - BUDGET - pdf["offset"].to_numpy()
            text = around[np.arange(len(pdf))[:, None], first[:, None] + np.arange(WINDOW + 2 * BUDGET)]
            far = distances(window, length, text)
            near = far <= pdf["budget"].to_numpy()
            out = pdf.loc[near, ["row", "doc_id", "form", "content", "budget"]]
            out["start"], out["far"] = (pdf["at"] - pdf["offset"])[near], far[near]
            yield out

    hits = met.mapInPandas(verified, f"row long, doc_id {kind}, form int, content binary, budget int, start int, far int")
    around = Window.partitionBy("row", "form").orderBy("start").rangeBetween(-BLUR, BLUR)
    best = hits.withColumn("least", F.min("far").over(around)).where("far <= least").select("row", "doc_id", "content", "budget").distinct()
    return best.join(owners, ["content", "budget"]).select("row", "item_id", "doc_id").distinct().select("item_id", "doc_id")
