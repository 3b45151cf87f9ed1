"""Subject areas of documents: averaged word and subword embeddings under independent logistic outputs."""

from __future__ import annotations

import html
import math
import pickle
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.markup import without_templates
from tidegauge.session import durable, spread


@dataclass(frozen=True)
class Training:
    """Parameters of features and training.

    max_labelled: labelled documents that the classifier is fitted on; of more,
    those of the lowest hash of their id. partitions: parts of the training data,
    each of which sends one gradient a round. part_words: words of a stored piece of
    a part. places: places of the hashed table of word weights. rounds: whole-document
    rounds, then as many on sections and their sentences. level: least summed output
    of a section's sentences for a subject. share: least mean output of them.
    evidence: least summed weight of a section's words. doubt: pseudo-count of the
    prior in the weight of a word.
    """

    max_labelled: int = 6_000
    partitions: int = 6
    part_words: int = 1_000_000
    places: int = 1 << 20
    buckets: int = 1 << 14
    dim: int = 12
    rounds: int = 16
    step: float = 0.1
    level: float = 0.5
    share: float = 0.25
    evidence: float = 0.4
    doubt: float = 10.0
    unknown: float = 0.03


_EMPHASIS = regex.compile(r"'{2,}")
_MARKS = regex.compile(r"\p{Mn}+")
_COMMENT = regex.compile(r"<!--.*?-->|<ref[^>/]*/>|<ref[^>]*>.*?</ref>", regex.S | regex.I)
_TABLE = regex.compile(r"\{\|.*?(?:\|\}|\z)", regex.S)
_TAG = regex.compile(r"</?[a-z][^<>]*>", regex.I)
_META_LINK = regex.compile(r"\[\[\s*(?:category|kategorie|catégorie|categoría|file|datei|image)\s*:[^\[\]]*\]\]", regex.I)
_LINK = regex.compile(r"\[\[(?:[^\[\]|]*\|)?([^\[\]|]*)\]\]")
_HEADING = regex.compile(r"^=+[^=\n]+=+[ \t\r]*$", regex.M)
_REDIRECT = regex.compile(r"\s*#\s*\p{L}+\s*:?\s*\[\[", regex.I)
_WORD = regex.compile(r"\p{L}[\p{L}\p{M}'’-]*")
_SENTENCE = regex.compile(r"(?<=[.?!])\s+")


def sections(text: str | None) -> list[list[list[str]]]:
    """Sections of a page as sentences of lower-case words without accents.

    Comments, references, tables, templates, tags, category lines and headings
    are no text; a redirect, blank or bare template page has no section.
    """
    if not text or _REDIRECT.match(text):
        return []
    # A pattern runs only where its first mark is there.
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _COMMENT.sub(" ", text)
    if "{|" in text:
        text = _TABLE.sub(" ", text)
    text = without_templates(text)
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "[[" in text:
        text = _LINK.sub(r"\1", _META_LINK.sub(" ", text))
    if "''" in text:
        text = _EMPHASIS.sub("", text)
    if not text.isascii():
        text = _MARKS.sub("", unicodedata.normalize("NFKD", text))
    text = text.casefold()
    out = []
    for part in _HEADING.split(text):
        found = [w for s in _SENTENCE.split(part) if (w := _WORD.findall(s))]
        if found:
            out.append(found)
    return out


def features(word: str, buckets: int) -> tuple[int, ...]:
    """Bucket of a word in the lower half, of its subwords of three to five letters in the upper half."""
    return _remembered(word, buckets) if len(word) <= 40 else _features(word, buckets)


def _features(word: str, buckets: int) -> tuple[int, ...]:
    half = buckets // 2
    marked = f"<{word}>"
    grams = {marked[i : i + n] for n in (3, 4, 5) for i in range(len(marked) - n + 1)}
    return (zlib.crc32(word.encode()) % half, *(half + zlib.crc32(g.encode()) % half for g in sorted(grams)))


# Longer words are rare; they are cut up anew each time, in whole.
_remembered = lru_cache(maxsize=200_000)(_features)


def place(word: str, places: int) -> int:
    """Where a word's weight stands in the hashed table of word weights."""
    return zlib.crc32(word.encode(), 1) % places


@dataclass
class Prepared:
    """Texts as word indices, words as bucket indices."""

    word_features: np.ndarray  # flat
    word_starts: np.ndarray
    word_weight: np.ndarray
    index: np.ndarray  # word of each place, flat over the texts
    text_starts: np.ndarray
    turned: dict[str, np.ndarray] | None = None  # see turn

    @classmethod
    def of(cls, texts: list[list[str]], buckets: int, weight: np.ndarray) -> Prepared:
        known: dict[str, int] = {}
        flat: list[int] = []
        starts, sizes, index = [], [], []
        for words in texts:
            starts.append(len(index))
            index += [known.setdefault(w, len(known)) for w in words]
        for w in known:
            f = features(w, buckets)
            sizes.append(len(f))
            flat += f
        word_starts = np.cumsum([0, *sizes])[:-1] if sizes else np.zeros(0)
        weights = weight[[place(w, len(weight)) for w in known]]
        return cls(np.array(flat, np.int32), word_starts.astype(np.int64), weights, np.array(index, np.int32), np.array(starts, np.int64))

    def turn(self) -> Prepared:
        """Keep the orders in which gradients are gathered: texts by word, and words by bucket; they are the same every round."""
        by_word = np.argsort(self.index, kind="stable")
        texts = np.repeat(np.arange(len(self.text_starts), dtype=np.int32), self.sizes())[by_word]
        by_bucket = np.argsort(self.word_features, kind="stable").astype(np.int32)
        sizes = np.diff(np.append(self.word_starts, len(self.word_features)))
        words = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)[by_bucket]
        first = lambda v: np.flatnonzero(np.r_[True, v[1:] != v[:-1]]) if len(v) else np.zeros(0, np.int64)
        at = self.word_features[by_bucket]
        self.turned = {
            "texts": texts, "word_first": first(self.index[by_word]), "words": words, "order": by_bucket, "bucket_first": first(at), "buckets": at[first(at)],
        }
        return self

    def mass(self) -> np.ndarray:
        """Summed weight of each text's words."""
        return _sum(self.word_weight[self.index], self.text_starts)

    def sizes(self) -> np.ndarray:
        return np.diff(np.append(self.text_starts, len(self.index)))


def _sum(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of the runs that begin at starts; none may be empty."""
    return np.add.reduceat(values, starts, axis=0) if len(starts) else np.zeros((0, *values.shape[1:]), values.dtype)


def word_vectors(p: Prepared, embedding: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A word's own vector plus the mean of its subwords' vectors; also the weight of each of its features."""
    sizes = np.diff(np.append(p.word_starts, len(p.word_features)))
    weight = np.repeat(1.0 / np.maximum(1, sizes - 1), sizes).astype(np.float32)
    weight[p.word_starts] = 1.0
    return _sum(embedding[p.word_features] * weight[:, None], p.word_starts), weight


def outputs(p: Prepared, embedding: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Probability of each subject for each text, the texts' mean vectors, and the words' feature weights."""
    vectors, weight = word_vectors(p, embedding)
    mean = _sum((vectors * p.word_weight[:, None])[p.index], p.text_starts) / p.mass()[:, None]
    logits = mean @ weights[:-1] + weights[-1]
    return 1.0 / (1.0 + np.exp(-np.clip(logits, -30, 30))), mean, weight


def gradient(p: Prepared, target: np.ndarray, mask: np.ndarray, embedding: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Summed gradient of the cross entropy for embedding and output weights."""
    prob, mean, weight = outputs(p, embedding, weights)
    error = ((prob - target) * mask[:, None]).astype(embedding.dtype)
    d_weights = np.vstack([mean.T @ error, error.sum(axis=0)])
    d_mean = (error @ weights[:-1].T) / p.mass()[:, None]
    t = p.turned if p.turned is not None else p.turn().turned
    # Every word stands somewhere, so the sums come in the order of the words.
    d_vector = np.add.reduceat(d_mean[t["texts"]], t["word_first"], axis=0) * p.word_weight[:, None]
    out = np.zeros_like(embedding)
    out[t["buckets"]] = np.add.reduceat(d_vector[t["words"]] * weight[t["order"]][:, None], t["bucket_first"], axis=0)
    return out, d_weights


def loss(p: Prepared, target: np.ndarray, mask: np.ndarray, embedding: np.ndarray, weights: np.ndarray) -> float:
    """Summed cross entropy."""
    prob = outputs(p, embedding, weights)[0]
    return float((-(target * np.log(prob + 1e-9) + (1 - target) * np.log(1 - prob + 1e-9)) * mask[:, None]).sum())


class Adam:
    def __init__(self, shape: tuple[int, ...], step: float) -> None:
        self.m, self.v, self.n, self.step = np.zeros(shape, np.float32), np.zeros(shape, np.float32), 0, step

    def move(self, x: np.ndarray, g: np.ndarray) -> None:
        self.n += 1
        self.m += 0.1 * (g - self.m)
        self.v += 0.01 * (g * g - self.v)
        x -= self.step * (self.m / (1 - 0.9**self.n)) / (np.sqrt(self.v / (1 - 0.99**self.n)) + 1e-8)


@dataclass
class Model:
    """What scoring needs: subjects in order, parameters, and the hashed table of word weights."""

    subjects: list[str]
    embedding: np.ndarray
    output: np.ndarray
    weight: np.ndarray
    training: Training

    def of_sections(self, pages: list[list[list[list[str]]]]) -> list[set[str]]:
        """Subjects of each page, given as sections of sentences."""
        t = self.training
        sentences = [s for page in pages for section in page for s in section]
        if not sentences:
            return [set() for _ in pages]
        p = Prepared.of(sentences, t.buckets, self.weight)
        prob = outputs(p, self.embedding, self.output)[0] * np.minimum(1.0, p.mass() / t.evidence)[:, None]
        out, at = [], 0
        for page in pages:
            found = set()
            for section in page:
                votes = prob[at : at + len(section)].sum(axis=0)
                at += len(section)
                found.update(self.subjects[i] for i in np.flatnonzero(votes >= max(t.level, t.share * len(section))))
            out.append(found)
        return out


def _labelled(documents: DataFrame, labels: DataFrame, subjects: list[str], t: Training) -> DataFrame:
    """doc_id, text and subject numbers of the labelled documents, at most t.max_labelled of them."""
    spark = documents.sparkSession
    known = labels.where(F.col("subject").isin(subjects) & F.col("doc_id").isNotNull())
    number = F.create_map(*[x for i, s in enumerate(subjects) for x in (F.lit(s), F.lit(i))])
    chosen = (
        known.groupBy("doc_id").agg(F.array_sort(F.collect_set(number[F.col("subject")])).alias("targets"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(t.max_labelled)
    )
    # The bound on labelled documents is a bound on this broadcast.
    return documents.where("text is not null").select("doc_id", "text").join(F.broadcast(chosen), "doc_id")


def train(documents: DataFrame, labels: DataFrame, subjects: list[str], t: Training = Training()) -> Model | None:
    """Fit the classifier on labelled documents; None if there are none with text.

    The training data lies in t.partitions parts in the checkpoint folder. Every
    round each part computes its gradient from the broadcast parameters, and the
    driver adds the gradients, as many as parts and each as large as the model,
    and moves the parameters. First a whole document is one text with all its
    labels; then each section takes that one of its document's labels which the
    model holds likeliest of all, or is left out, and so do its sentences.
    """
    spark = documents.sparkSession
    n = len(subjects)

    def pages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [(pickle.dumps(s), list(y)) for x, y in zip(pdf["text"], pdf["targets"]) if (s := sections(x))]
            if found:
                yield pd.DataFrame({"page": [f[0] for f in found], "targets": [f[1] for f in found]})

    data = durable(
        _labelled(documents, labels, subjects, t).repartition(t.partitions, "doc_id").mapInPandas(pages, "page binary, targets array<int>")
    )
    counts = data.select(F.explode("targets").alias("s"), (1 / F.size("targets")).alias("w")).groupBy("s").agg(F.sum("w").alias("w")).collect()
    if not counts:
        return None
    prior = np.full(n, 1e-9)
    for row in counts:
        prior[row["s"]] += row["w"]
    prior /= prior.sum()

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for pdf in batches:
            at, row = [], []
            for i, page in enumerate(pdf["page"]):
                told = {place(w, t.places) for w in {w for section in pickle.loads(page) for s in section for w in s}}
                at += told
                row += [i] * len(told)
            y = np.zeros((len(pdf), n))
            for i, targets in enumerate(pdf["targets"]):
                y[i, targets] = 1 / len(targets)
            at, shares = np.array(at, np.int64), y[np.array(row, np.int64)]
            if held is not None:
                at, shares = np.concatenate([held[0], at]), np.concatenate([held[1], shares])
            if len(at):
                order = np.argsort(at, kind="stable")
                at, first = np.unique(at[order], return_index=True)
                held = at, np.add.reduceat(shares[order], first, axis=0)
        if held is not None:
            yield pd.DataFrame({"place": held[0].astype(np.int32), **{f"n{i}": held[1][:, i] for i in range(n)}})

    sums = data.mapInPandas(counted, "place int, " + ", ".join(f"n{i} double" for i in range(n))).groupBy("place").agg(
        *[F.sum(f"n{i}").alias(f"n{i}") for i in range(n)]
    )
    total = sum((F.col(f"n{i}") for i in range(n)), F.lit(0.0)) + t.doubt
    gain = F.lit(0.0)
    for i in range(n):
        share = (F.col(f"n{i}") + t.doubt * float(prior[i])) / total
        gain = gain + share * F.log(share / float(prior[i]))
    telling = sums.select("place", (gain / math.log(n)).alias("weight") if n > 1 else F.lit(1.0).alias("weight"))
    # At most t.places rows of two numbers, however many words there are.
    told = telling.where(F.col("weight") > t.unknown).toPandas()
    weight = np.full(t.places, t.unknown, np.float32)
    weight[told["place"].to_numpy(np.int64)] = np.minimum(1.0, told["weight"])

    rng = np.random.default_rng(7)
    embedding = (rng.standard_normal((t.buckets, t.dim)) * 0.1).astype(np.float32)
    output = np.zeros((t.dim + 1, n), np.float32)
    output[:-1], output[-1] = rng.standard_normal((t.dim, n)) * 0.1, -2
    movers = Adam(embedding.shape, t.step), Adam(output.shape, t.step)

    def prepare(whole: bool) -> DataFrame:
        shared = spark.sparkContext.broadcast((embedding, output, weight))

        def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            embedding, output, weight = shared.value
            pages, targets, held = [], [], 0
            for pdf in batches:
                for page, y in zip(pdf["page"], pdf["targets"]):
                    pages.append(pickle.loads(page))
                    targets.append(list(y))
                    held += sum(len(s) for section in pages[-1] for s in section)
                    if held >= t.part_words:
                        yield from piece(pages, targets, embedding, output, weight)
                        pages, targets, held = [], [], 0
            if pages:
                yield from piece(pages, targets, embedding, output, weight)

        def piece(pages, targets, embedding, output, weight) -> Iterator[pd.DataFrame]:
            if whole:
                texts = [[w for section in page for s in section for w in s] for page in pages]
                y = np.zeros((len(texts), n), np.float32)
                for i, own in enumerate(targets):
                    y[i, own] = 1
                mask, size = np.ones(len(texts), np.float32), float(len(texts))
            else:
                parts = [(section, own, len(page)) for page, own in zip(pages, targets) for section in page]
                joined = [[w for s in section for w in s] for section, _, _ in parts]
                prob = outputs(Prepared.of(joined, t.buckets, weight), embedding, output)[0]
                texts, rows, mask = [], [], []
                for i, (section, own, alone) in enumerate(parts):
                    best = int(prob[i].argmax())
                    if best not in own:
                        if len(own) > 1 or alone > 1 or prob[i].max() > 0.5:
                            continue
                        best = own[0]
                    texts += [joined[i], *section]
                    rows += [best] * (1 + len(section))
                    mask += [1.0] + [1.0 / len(section)] * len(section)
                y = np.zeros((len(texts), n), np.float32)
                y[np.arange(len(texts)), rows] = 1
                mask, size = np.array(mask, np.float32), float(len(parts))
            if texts:
                blob = pickle.dumps((Prepared.of(texts, t.buckets, weight).turn().__dict__, y, mask))
                yield pd.DataFrame({"part": [blob], "texts": [size]})

        return durable(data.mapInPandas(build, "part binary, texts double"))

    def fit(whole: bool) -> None:
        parts = prepare(whole)
        size = parts.agg(F.sum("texts")).first()[0]
        for _ in range(t.rounds if size else 0):
            shared = spark.sparkContext.broadcast((embedding, output))

            def push(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                embedding, output = shared.value
                total = None
                for pdf in batches:
                    for blob in pdf["part"]:
                        prepared, y, mask = pickle.loads(blob)
                        own = gradient(Prepared(**prepared), y, mask, embedding, output)
                        total = own if total is None else tuple(a + b for a, b in zip(total, own))
                if total is not None:
                    g, h = (x.astype(np.float32).tobytes() for x in total)
                    yield pd.DataFrame({"g": [g], "h": [h]})

            g, h = np.zeros_like(embedding), np.zeros_like(output)
            for row in parts.mapInPandas(push, "g binary, h binary").collect():
                g += np.frombuffer(row["g"], np.float32).reshape(g.shape)
                h += np.frombuffer(row["h"], np.float32).reshape(h.shape)
            movers[0].move(embedding, g / np.float32(size))
            movers[1].move(output, h / np.float32(size))
            shared.destroy()

    fit(whole=True)
    fit(whole=False)
    return Model(subjects, embedding, output, weight, t)


def assign(documents: DataFrame, model: Model, chunk_chars: int = 500_000) -> DataFrame:
    """doc_id and subject of every document, one row for each subject to which a section is devoted.

    Each sentence is scored and a section's sentences vote; the section has every
    subject whose outputs, each subject for itself, add up to enough for its length,
    so that a remark in passing gives none. Sentences without telling words have no
    vote. Null, blank, redirect and bare template texts have no row; repeated rows
    have repeated rows. Texts are scored whole, where they lie.
    """
    shared = documents.sparkSession.sparkContext.broadcast(
        (model.subjects, model.embedding, model.output, model.weight, model.training)
    )
    slim = spread(documents.select("doc_id", documents["text"].cast("string").alias("text")).where("text is not null"))
    kind = dict(slim.dtypes)["doc_id"]

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Model(*shared.value)
        for pdf in batches:
            start = 0
            sizes = pdf["text"].str.len().cumsum().to_numpy()
            while start < len(pdf):
                base = sizes[start - 1] if start else 0
                stop = max(start + 1, int(np.searchsorted(sizes, base + chunk_chars, side="right")))
                found = own.of_sections([sections(x) for x in pdf["text"].iloc[start:stop]])
                rows = [(d, s) for d, subjects in zip(pdf["doc_id"].iloc[start:stop], found) for s in sorted(subjects)]
                yield pd.DataFrame(rows, columns=["doc_id", "subject"]) if rows else pd.DataFrame(
                    {"doc_id": pd.Series(dtype=pdf["doc_id"].dtype), "subject": pd.Series(dtype="object")}
                )
                start = stop

    return slim.mapInPandas(score, f"doc_id {kind}, subject string")


def subject_areas(documents: DataFrame, labels: DataFrame, areas: DataFrame, t: Training = Training()) -> DataFrame:
    """Train on labels(doc_id, subject) and assign the subjects of areas(subject) to all documents.

    The subjects are a short stated list. Labels of other subjects and of unknown
    documents are ignored; without any usable label no document gets a subject.
    """
    subjects = sorted(r["subject"] for r in areas.where("subject is not null").select("subject").distinct().collect())
    model = train(documents, labels, subjects, t) if subjects else None
    if model is None:
        return documents.select("doc_id", F.lit("").alias("subject")).where(F.lit(False))
    return assign(documents, model)
