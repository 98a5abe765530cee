"""Problem 9: pages of search phrases, links or product tags instead of sentences.

Every document gets features of density, entropy, repetition and function words. For each language
a robust centre and scatter are computed (medians and median deviations, then a covariance of the
clipped scores), and each document gets its robust Mahalanobis distance from them. They are taken
over distinct feature rows of documents that consist of sentences, so neither copies nor any share
of spam in a language can become the centre. A language with under ``LEAST_ROWS`` of these is measured
against those of all languages; where there are none at all, the exact check decides alone.

A document is flagged when it is an outlier in a spam-directed direction: fewer function words and
less entropy than usual, with wider gaps between function words, more repetition, links and tags.
What counts as an outlier is read off the distances themselves: halfway between
the far end of the documents of sentences and the near end of what lies beyond three times that.
An exact check follows and only takes flagged documents away: those of which no more than half of
the words stand outside sentences.

Features are means over the words outside code, tables and references. A document's scores are
weighed by the share of its words that they speak of, so pages of code lie near the centre. A tag
that runs words together counts for as many as it has times six letters.

Null, empty and blank texts are never flagged. A text under ``MIN_WORDS`` words that is one bare
phrase, without link, tag or separator, reads as a heading: its features speak of no word. Repeated
rows of a document come out once. The language is the one most of the function words belong to,
else the label, else 'und'; a wrong label only matters where a text has no function word.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from quire.functions.stages import cut, is_in
from quire.llm.codepoints import DIGIT, blocks, classes, decode, mix
from quire.llm.leaks import folded_words
from quire.llm.tokens import Tokens, at_text, counted

# Frequent function words, without accents and case.
FUNCTION_WORDS = {
    "ca": "a al als amb aquest aquesta aixo cada cal com d de del dels des durant el els em en entre es esta fa fins ha han hem hi ho i l la les li mai mes molt ni no o on per perque pel pels pero quan que qual quin quina s sense segons ser seva si sobre son tal tambe te tot un una uns vam ja nomes aleshores despres encara",
    "es": "a al algo ante como con cada cual cuando de del desde donde durante e el ella en entonces entre es esta este esto fue ha han hasta hay hemos la las le lo los mas me mi mientras mucho muy nada ni no nunca o para pero por porque que se segun si siempre sin sobre solo son su sus tal tambien tan un una y ya despues aunque",
    "en": "a about after all also an and are as at be because been before but by can do does each even every for from had has have he how if in inside into is it its just less long many may more must never no nobody not of on only or other our out over so some than that the their then there these they this those to under unless until up was we were what when where which while who why will with without you your",
    "fr": "a ainsi alors au aucun aussi aux avant avec bien c ce ces cet cette chaque comme d dans de des donc du elle en encore entre est et eux fait il ils jamais je jusqu l la le les leur lors lorsque lui mais meme moins n ne ni non nous on ont ou par parce pas pendant personne peu plus pour qu quand que quel qui s sa sans selon ses si son sont sous sur tous tout tres un une vers y",
}
LANGUAGES = tuple(FUNCTION_WORDS)
FEATURES = ("function_words", "gaps", "entropy", "repetition", "links", "tags")
#: The least scale of a feature: below it, differences are noise.
LEAST_SCALE = {"function_words": 0.03, "gaps": 0.1, "entropy": 0.02, "repetition": 0.05, "links": 0.01, "tags": 0.01}
#: Which way spam lies: the sign of the feature's score.
DIRECTION = {"function_words": -1, "gaps": 1, "entropy": -1, "repetition": 1, "links": 1, "tags": 1}
MIN_WORDS, REACH, CLIP = 8, 8, 3.0
#: A document of sentences: its mean gap to the next function word, as log2(1 + words), and the share of its words that the features speak of.
SENTENCE_GAP, SENTENCE_SHARE = 1.5, 0.5
#: Quantiles that end the documents of sentences and begin the outliers, and how many times the former the latter lie beyond.
FAR_END, NEAR_END, APART = 0.99, 0.01, 3.0
#: The statement's share, and the share of function words around a word that make a sentence.
ENTRY_SHARE, IN_SENTENCE, TAG_LETTERS = 0.5, 0.25, 6
# Signs that stand between phrases of a list.
SEPARATORS = ",;|/·•\n"
#: Distinct rows below which a language has no centre of its own.
LEAST_ROWS = 30


@lru_cache(1)
def function_table() -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of all function words and a bit for each language they belong to."""
    bits: dict[int, int] = {}
    for k, words in enumerate(FUNCTION_WORDS.values()):
        texts = words.split()
        hashes, *_ = folded_words(*decode(pa.array(texts)))
        for h in hashes.tolist():
            bits[h] = bits.get(h, 0) | 1 << k
    keys = np.array(sorted(bits), np.uint64)
    return keys, np.array([bits[int(k)] for k in keys], np.uint8)


def document_features(codes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A row of ``FEATURES`` for each text, the share of its words they speak of, the share outside sentences, its number of words, and its language (-1: no function word)."""
    n_rows = len(offsets) - 1
    hashes, rows, a, b = folded_words(codes, offsets)
    n = np.bincount(rows, minlength=n_rows)
    out = np.zeros((n_rows, len(FEATURES)))
    if not len(rows):
        return out, np.zeros(n_rows), np.zeros(n_rows), n, np.full(n_rows, -1)
    keys, bits = function_table()
    at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
    bit = np.where(keys[at] == hashes, bits[at], 0)
    functional = bit > 0
    votes = np.stack([np.bincount(rows, (bit >> k) & 1, n_rows) for k in range(len(LANGUAGES))])
    language = np.where(votes.max(0) > 0, votes.argmax(0), -1)
    # what stands between blanks: links, tags, code
    kinds = classes()[codes]
    tokens = Tokens(codes, offsets, kinds)
    ta, link, tag, coded = tokens.starts, tokens.link, tokens.tag, tokens.code
    digit = (kinds & DIGIT) > 0
    token = np.searchsorted(ta, a, "right") - 1
    # lines: code, tables and references
    breaks = counted(codes == 10)
    line = breaks[a] + rows  # a line feed or a new row begins another line
    _, line = np.unique(line, return_inverse=True)
    n_line = np.bincount(line)
    token_line = np.full(len(ta), -1)
    token_line[token[::-1]] = line[::-1]
    has_word = token_line >= 0
    n_tokens = np.maximum(np.bincount(token_line[has_word], minlength=len(n_line)), 1)
    code_line = np.bincount(token_line[has_word], coded[has_word], len(n_line)) / n_tokens >= 0.25
    numeric = np.bincount(line, digit[a] & digit[b - 1], len(n_line)) / n_line > 0.6
    year = at_text(codes, "(")
    if len(codes) > 5:
        year[:-5] &= digit[1:-4] & digit[2:-3] & digit[3:-2] & digit[4:-1] & (codes[5:] == ord(")"))
        year[-5:] = False
        of_row = np.repeat(np.arange(n_rows), np.diff(offsets))
        year[:-5] &= of_row[5:] == of_row[:-5]
    else:
        year[:] = False
    years = counted(year)
    first_word = np.searchsorted(line, np.arange(len(n_line)))
    last_word = np.append(first_word[1:], len(line)) - 1
    dated = (years[b[last_word]] > years[a[first_word]]) & (n_line <= 25)
    excluded = (code_line | numeric | dated)[line]
    # repetition: words of three-word phrases that the text holds at least three times
    repeated = np.zeros(len(rows), bool)
    if len(rows) > 2:
        phrase = mix(hashes[:-2] * np.uint64(3) + hashes[1:-1] * np.uint64(5) + hashes[2:] * np.uint64(7) + rows[:-2].astype(np.uint64))
        inside = rows[:-2] == rows[2:]
        _, inverse, count = np.unique(phrase, return_inverse=True, return_counts=True)
        often = (count[inverse] >= 3) & inside
        for k in range(3):
            repeated[k : len(often) + k] |= often
    # gaps and sentences: by the function words around a word
    first, last = np.searchsorted(rows, rows, "left"), np.searchsorted(rows, rows, "right")
    index = np.arange(len(rows))
    before = np.maximum.accumulate(np.where(functional, index, -1))
    after = np.minimum.accumulate(np.where(functional, index, len(rows))[::-1])[::-1]
    back = np.where(before >= first, index - before, REACH)
    ahead = np.where(after < last, after - index, REACH)
    gaps = np.log2(1 + np.minimum(np.minimum(back, ahead), REACH))
    low, high = np.maximum(index - REACH, first), np.minimum(index + REACH + 1, last)
    total = counted(functional)
    outside = (total[high] - total[low]) / (high - low) < IN_SENTENCE
    # a short text that is one bare phrase is a heading
    apart = counted(np.isin(codes, np.array([ord(c) for c in SEPARATORS], np.uint32)))
    listed = (apart[a[1:]] > apart[b[:-1]]) & (rows[1:] == rows[:-1]) & ~(digit[b[:-1] - 1] & digit[a[1:]])
    several = np.bincount(rows[1:], listed, n_rows) + np.bincount(rows, (link | tag)[token], n_rows) > 0
    plain = ~excluded & ((n >= MIN_WORDS) | several)[rows]
    # entropy of the word distribution against the largest possible
    pair = mix(hashes + rows.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, where, count = np.unique(pair, return_index=True, return_counts=True)
    p = count / n[rows[where]]
    entropy = np.bincount(rows[where], -p * np.log(p), n_rows) / np.log(np.maximum(n, 2))
    # a tag runs words together: it counts as one for every TAG_LETTERS letters
    weight = np.where(tag[token], np.maximum(1, (b - a) // TAG_LETTERS), 1)
    whole, spoken = np.bincount(rows, weight, n_rows), np.bincount(rows, weight * plain, n_rows)
    mean = lambda values: np.bincount(rows, values * weight * plain, n_rows) / np.maximum(spoken, 1)
    for k, values in enumerate((mean(functional), mean(gaps), entropy, mean(repeated), mean(link[token]), mean(tag[token]))):
        out[:, k] = values
    share = lambda x: x / np.maximum(whole, 1)
    return out, share(spoken), share(np.bincount(rows, weight * (plain & outside), n_rows)), n, language


def features(documents: DataFrame) -> DataFrame:
    """(doc_id, language, n_words, spoken, entries, the ``FEATURES``): each document once; texts without a word left out."""
    names = ["doc_id", "language", "n_words", "spoken", "entries", *FEATURES]
    schema = "doc_id bigint, language string, n_words int, " + ", ".join(f"{f} double" for f in names[3:])
    known = np.array([*LANGUAGES, ""], object)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            values, spoken, entries, n, language = document_features(*decode(block.column("text")))
            label = np.array([x or "und" for x in block.column("lang").to_pylist()], object)
            label = np.where(language >= 0, known[language], label)
            keep = pa.array(n > 0)
            columns = [block.column("doc_id"), pa.array(label, pa.string()), pa.array(n, pa.int32()), pa.array(spoken), pa.array(entries), *map(pa.array, values.T)]
            yield pa.RecordBatch.from_arrays([c.filter(keep) for c in columns], names)

    return documents.select("doc_id", "lang", "text").mapInArrow(work, schema).dropDuplicates(["doc_id"])


def of_sentences() -> Column:
    """Documents that may say where the centre lies."""
    return (F.col("gaps") <= SENTENCE_GAP) & (F.col("spoken") > SENTENCE_SHARE)


class Scatter:
    """Centre, scale and inverse scatter of each language, applied to batches of feature rows."""

    def __init__(self, centre: dict[str, np.ndarray]):
        self.centre = centre
        self.scale = {x: np.ones(len(FEATURES)) for x in centre}
        self.inverse = {x: np.eye(len(FEATURES)) for x in centre}

    def scores(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        values = np.stack([batch.column(f).to_numpy() for f in FEATURES], 1)
        language = np.array(batch.column("language").to_pylist(), object)
        for x in self.centre:
            at = language == x
            values[at] = (values[at] - self.centre[x]) / self.scale[x]
        return values, language


def robust_distances(rows: DataFrame) -> DataFrame:
    """``rows`` with ``distance`` (robust Mahalanobis) and ``towards`` (its spam-directed part).

    Three aggregates over the distinct feature rows of documents of sentences, each a few
    numbers for a language: medians, median deviations, and the covariance of scores clipped at ``CLIP``.
    They come to the driver: their size is languages times a constant. Labels outside ``LANGUAGES`` count
    as 'und', the group of all languages. A matrix of correlations is pulled a fifth of the way to the
    identity, so that it can be inverted whatever the data. Without a row to measure against, the
    distance is infinite.
    """
    rows = rows.withColumn("language", F.when(F.col("language").isin(*LANGUAGES), F.col("language")).otherwise("und"))

    # copies and pages without sentences have no say; a text without function words and label is measured against all languages
    plain = rows.where(of_sentences()).select("language", *FEATURES)
    population = cut(plain.where("language <> 'und'").unionByName(plain.withColumn("language", F.lit("und"))).distinct())
    sizes = {r["language"]: r["count"] for r in population.groupBy("language").count().collect()}
    own = [x for x, n in sizes.items() if n >= LEAST_ROWS or x == "und"]
    population = population.where(is_in(F.col("language"), own))

    def medians(df: DataFrame) -> dict[str, np.ndarray]:
        found = df.groupBy("language").agg(*[F.percentile_approx(f, 0.5, 1000).alias(f) for f in FEATURES]).collect()
        return {r["language"]: np.array([r[f] for f in FEATURES]) for r in found}

    scatter = Scatter(medians(population))

    def deviations(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, _ = scatter.scores(batch)
            yield pa.RecordBatch.from_arrays([batch.column("language"), *map(pa.array, np.abs(values).T)], ["language", *FEATURES])

    spread = medians(population.mapInArrow(deviations, "language string, " + ", ".join(f"{f} double" for f in FEATURES)))
    least = np.array([LEAST_SCALE[f] for f in FEATURES])
    scatter.scale = {x: np.maximum(1.4826 * d, least) for x, d in spread.items()}

    def products(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, language = scatter.scores(batch)
            values = np.clip(values, -CLIP, CLIP)
            for x in set(language.tolist()):
                part = values[language == x]
                sums = np.append((part.T @ part).ravel(), len(part)).astype(float)
                yield pa.RecordBatch.from_arrays([pa.array([x] * len(sums)), pa.array(np.arange(len(sums)), pa.int32()), pa.array(sums)], ["language", "place", "total"])

    sums: dict[str, np.ndarray] = {}
    for r in population.mapInArrow(products, "language string, place int, total double").groupBy("language", "place").agg(F.sum("total").alias("total")).collect():
        sums.setdefault(r["language"], np.zeros(len(FEATURES) ** 2 + 1))[r["place"]] = r["total"]
    for x, total in sums.items():
        covariance = total[:-1].reshape(len(FEATURES), -1) / total[-1]
        d = np.sqrt(np.maximum(np.diag(covariance), 0.25))
        scatter.inverse[x] = np.linalg.inv(0.8 * covariance / np.outer(d, d) + 0.2 * np.eye(len(FEATURES))) / np.outer(d, d)
    for x in set(LANGUAGES) - set(own) if "und" in own else ():
        for kind in (scatter.centre, scatter.scale, scatter.inverse):
            kind[x] = kind["und"]
    direction = np.array([DIRECTION[f] for f in FEATURES], float)

    def distances(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, language = scatter.scores(batch)
            values *= batch.column("spoken").to_numpy()[:, None]
            distance = np.full(len(values), np.inf)
            for x in scatter.inverse:
                at = language == x
                distance[at] = np.sqrt(np.einsum("ij,jk,ik->i", values[at], scatter.inverse[x], values[at]))
            towards = np.where(np.isinf(distance), np.inf, np.clip(values, -10, 10) @ direction)
            yield batch.append_column("distance", pa.array(distance)).append_column("towards", pa.array(towards))

    return rows.mapInArrow(distances, ", ".join(f"{c} {t}" for c, t in rows.dtypes) + ", distance double, towards double")


def outlier_bound(rows: DataFrame) -> float:
    """The distance beyond which a spam-directed document is an outlier, from the distances of all ``rows``.

    Three numbers come to the driver. Without documents of sentences every document is an outlier; without
    anything beyond ``APART`` times their far end, none is.
    """
    ordinary = rows.where(of_sentences() & F.col("distance").between(0, 1e9)).agg(F.percentile_approx("distance", FAR_END, 10_000)).first()[0]
    if ordinary is None:
        return 0.0
    beyond = rows.where((F.col("distance") > APART * ordinary) & (F.col("towards") > 0)).agg(F.percentile_approx("distance", NEAR_END, 10_000)).first()[0]
    return APART * ordinary if beyond is None else (ordinary + beyond) / 2


def flagged(documents: DataFrame) -> DataFrame:
    """The outliers in spam-directed directions, with distance, direction and features."""
    rows = cut(robust_distances(cut(features(documents))))
    return rows.where((F.col("distance") > outlier_bound(rows)) & (F.col("towards") > 0))


def found_spam(documents: DataFrame, entry_share: float = ENTRY_SHARE) -> DataFrame:
    """(doc_id): flagged documents of which more than ``entry_share`` of the words stand outside sentences."""
    return flagged(documents).where(F.col("entries") > entry_share).select("doc_id")
