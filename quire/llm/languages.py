"""Problem 3: the language of every page, paragraph and document, with a confidence.

The model is word-first with backoff: a known word counts by its log frequency in each language; a
word never met is read from its end position by position with the longest character n-gram that is
known, five letters down to one. It is fitted on a bounded sample of labelled rows: at most
``SAMPLE_DOCUMENTS`` texts a language, of at most ``SAMPLE_CHARS`` code points, in the order of a hash
of their id; rows whose label the first fit contradicts are left out of the second. All else covers
all pages.

Lines are scored once, in one pass; a paragraph's scores, letters and kind are sums over its lines
without the frequent lines of its source (problem 2). Prose has at least ``MIN_LETTERS`` letters
outside lines of code and tables, which are at least half of its letters, and some words that the
model knows.

Null, empty and blank pages have no paragraph. Repeated page rows count once. Labels null, empty
and 'und' are no label. A document without an extracted row, or with null languages, lacks them all.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from quire.functions.stages import checked_join, written
from quire.llm.codepoints import BLANK, DIGIT, LETTER, MARK, CharMap, blocks, classes, decode, hash_ranges, runs, tabulated
from quire.llm.lookalikes import normalise
from quire.llm.repeated_lines import document_sources, frequent_among, normal_line_hashes
from quire.llm.tokens import Tokens, counted

LANGUAGES = ("ca", "es", "en", "fr")
NO_LABEL = ("", "und")
SAMPLE_DOCUMENTS, SAMPLE_CHARS = 300, 20_000
MOST_WORDS, MOST_GRAMS, LONGEST = 50_000, 200_000, 5
MIN_LETTERS, KNOWN_SHARE, PROSE_SHARE = 60, 0.15, 0.5
#: Weight of a word scored by n-grams against a known one, and the scale that softens the sum of a paragraph to a confidence.
GRAM_WEIGHT, SOFTNESS = 0.3, 6.0
LINE_SCHEMA = "user_id string, doc_id string, number int, paragraph int, line_no int, line_hash bigint, letters int, prose_letters int, known_letters int, " + ", ".join(f"{x} float" for x in LANGUAGES)


@lru_cache(1)
def lower_letters() -> CharMap:
    """Lower case that keeps the places: where it is longer, its first letter alone (U+0130 becomes i)."""
    return CharMap({c: (ord(chr(c).lower()[0]),) for c in tabulated() if chr(c).lower() != chr(c)})


def lined_words(codes: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Words (runs of letters and marks) and lines of normalised lower-case texts."""
    kinds = classes()[codes]
    plain, *_ = lower_letters().apply(codes, offsets)
    a, b = runs((kinds & (LETTER | MARK)) > 0, offsets)
    feeds = counted(codes == 10)
    rows = np.searchsorted(offsets, a, "right") - 1
    # lines of the block: a new one after each feed and at each row
    line = feeds[a] + rows
    tokens = Tokens(codes, offsets, kinds)
    token_rows = np.searchsorted(offsets, tokens.starts, "right") - 1
    token_line = feeds[tokens.starts] + token_rows
    n = int(feeds[-1]) + len(offsets)
    all_tokens = np.bincount(token_line, minlength=n)
    numeric = (kinds[tokens.starts] & DIGIT) > 0
    tabs = np.flatnonzero(codes == 9)
    tabbed = np.bincount(feeds[tabs] + np.searchsorted(offsets, tabs, "right") - 1, minlength=n) > 0
    share = lambda flags: np.bincount(token_line, flags, n) / np.maximum(all_tokens, 1)
    numbers = share(numeric)
    other = (share(tokens.code) >= 0.2) | (numbers > 0.5) | tabbed & (numbers >= 0.3)
    return {"codes": plain, "starts": a, "ends": b, "rows": rows, "line": line, "other": other, "blank": all_tokens == 0}


class Model:
    """Log frequencies of words and character n-grams in each language."""

    def __init__(self, texts: dict[str, list[str]]):
        words = {x: Counter(texts.get(x, ())) for x in LANGUAGES}
        grams = {x: Counter() for x in LANGUAGES}
        for x, count in words.items():
            for word, n in count.items():
                framed = f"^{word}$"
                for k in range(1, LONGEST + 1):
                    for i in range(len(framed) - k + 1):
                        grams[x][framed[i : i + k]] += n
        self.words = self._table(words, MOST_WORDS)
        self.grams = self._table(grams, MOST_GRAMS)
        self.cache: dict[int, tuple[float, ...]] = {}

    @staticmethod
    def _table(counts: dict[str, Counter], most: int) -> dict[str, tuple[float, ...]]:
        total = Counter()
        for count in counts.values():
            total.update(count)
        kept = [w for w, n in sorted(total.items(), key=lambda x: (-x[1], x[0]))[:most] if n > 1]
        sums = {x: sum(count.values()) + 0.5 * len(kept) + 1 for x, count in counts.items()}
        return {w: tuple(math.log((counts[x][w] + 0.5) / sums[x]) for x in LANGUAGES) for w in kept}

    def score(self, word: str) -> tuple[float, ...]:
        """Relative log probabilities in the languages, and 1 for a known word."""
        scores, weight, known = self.words.get(word), 1.0, 1.0
        if scores is None:
            framed, seen, known, weight = f"^{word}$", [], 0.0, GRAM_WEIGHT
            for end in range(2, len(framed) + 1):
                for k in range(min(LONGEST, end), 0, -1):
                    if (found := self.grams.get(framed[end - k : end])) is not None:
                        seen.append(found)
                        break
            if not seen:
                return (*[0.0] * len(LANGUAGES), 0.0)
            scores = tuple(sum(s[i] for s in seen) / len(seen) for i in range(len(LANGUAGES)))
        mean = sum(scores) / len(scores)
        return (*[weight * (s - mean) for s in scores], known)

    def score_all(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A row of scores for each word; every distinct word is scored once in a worker."""
        hashes = hash_ranges(codes, starts, ends)
        unique, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.cache) > 500_000:
            self.cache.clear()
        text, cache, table = None, self.cache, np.zeros((len(unique), len(LANGUAGES) + 1))
        for k, h in enumerate(unique.tolist()):
            if (known := cache.get(h)) is None:
                if text is None:
                    text = codes.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
                known = cache[h] = self.score(text[starts[first[k]] : ends[first[k]]])
            table[k] = known
        return table[inverse]


def _prose_words(texts: list[str]) -> list[list[str]]:
    """The words of each text outside lines of code and tables."""
    codes, offsets, _ = normalise(*decode(pa.array(texts, pa.string())))
    w = lined_words(codes, offsets)
    keep = ~w["other"][w["line"]]
    text = w["codes"].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
    out: list[list[str]] = [[] for _ in texts]
    for a, b, r in zip(w["starts"][keep].tolist(), w["ends"][keep].tolist(), w["rows"][keep].tolist()):
        out[r].append(text[a:b])
    return out


def fit(documents: DataFrame, per_language: int = SAMPLE_DOCUMENTS) -> Model:
    """The model from a bounded sample of ``documents`` (doc_id, text, lang)."""
    ids = documents.select("doc_id", "lang", F.xxhash64("doc_id").alias("h")).where(F.col("lang").isin(*LANGUAGES) & (F.col("n_chars") <= SAMPLE_CHARS))
    picked = [ids.where(F.col("lang") == x).orderBy("h", "doc_id").limit(per_language) for x in LANGUAGES]
    chosen = {r["doc_id"]: r["lang"] for part in picked for r in part.select("doc_id", "lang").collect()}
    rows = documents.select("doc_id", "text").where(F.col("doc_id").isin(*chosen) if chosen else F.lit(False)).where("text is not null").dropDuplicates(["doc_id"]).orderBy("doc_id").collect()
    labels, words = [chosen[r["doc_id"]] for r in rows], _prose_words([r["text"] for r in rows])
    keep = range(len(rows))
    model = Model({})
    for _ in range(2):
        texts: dict[str, list[str]] = {}
        for k in keep:
            texts.setdefault(labels[k], []).extend(words[k])
        model = Model(texts)
        best = []
        for w in words:
            sums = np.sum([model.score(x)[: len(LANGUAGES)] for x in w], axis=0) if w else np.zeros(len(LANGUAGES))
            best.append(LANGUAGES[int(np.argmax(sums))])
        keep = [k for k in range(len(rows)) if best[k] == labels[k]]
    return model


def scored_lines(pages: DataFrame, model: Model) -> DataFrame:
    """One row for each line of a page that holds a letter: its paragraph, hash, letters and scores."""
    shared = pages.sparkSession.sparkContext.broadcast(model)
    names = [x.split()[0] for x in LINE_SCHEMA.split(", ")]

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for block in blocks(batches, "text"):
            raw, raw_offsets = decode(block.column("text"))
            if not len(raw):
                continue
            codes, offsets, _ = normalise(raw, raw_offsets)
            w = lined_words(codes, offsets)
            lines, first = np.unique(w["line"], return_index=True)
            if not len(lines):
                continue
            rows = w["rows"][first]
            n = np.append(first[1:], len(w["line"])) - first
            sizes = w["ends"] - w["starts"]
            scores = model.score_all(w["codes"], w["starts"], w["ends"])
            total = lambda x: np.add.reduceat(x, first)
            letters = total(sizes)
            prose = np.where(w["other"][lines], 0, letters)
            known = np.where(w["other"][lines], 0, total(sizes * scores[:, -1]))
            # line and paragraph numbers inside the row
            row_line = counted(codes == 10)[offsets[:-1]] + np.arange(len(offsets) - 1)
            line_no = lines - row_line[rows] + 1
            blank = w["blank"].copy()
            starts_blank = blank.copy()
            starts_blank[1:] &= ~blank[:-1]
            starts_blank[row_line] = blank[row_line]
            before = counted(starts_blank)
            paragraph = before[lines] - before[row_line[rows]] + 1
            hashes = np.zeros(len(lines), np.int64)
            hr, hn, hh = normal_line_hashes(codes, offsets)
            at = np.searchsorted(lines, row_line[hr] + hn - 1)
            hashes[at] = hh
            out = block.select(["user_id", "doc_id", "number"]).take(pa.array(rows)).columns
            out += [pa.array(x, pa.int32()) for x in (paragraph, line_no)] + [pa.array(hashes)] + [pa.array(x.astype(np.int32)) for x in (letters, prose, known)]
            out += [pa.array(total(scores[:, k]).astype(np.float32)) for k in range(len(LANGUAGES))]
            yield pa.RecordBatch.from_arrays(out, names)

    return pages.select("user_id", "doc_id", "number", "text").mapInArrow(work, LINE_SCHEMA)


def best_language() -> tuple[Column, Column]:
    """The language with the highest sum, and its share of the softened sums."""
    best = F.greatest(*LANGUAGES)
    name = F.coalesce(*[F.when(F.col(x) == best, F.lit(x)) for x in LANGUAGES])
    weights = [F.exp((F.col(x) - best) / SOFTNESS) for x in LANGUAGES]
    total = weights[0]
    for w in weights[1:]:
        total = total + w
    return name, F.round(1 / total, 4)


def paragraphs(pages: DataFrame, manifest: DataFrame, documents: DataFrame) -> DataFrame:
    """(user_id, doc_id, number, paragraph, letters, prose, lang, confidence) of every paragraph that holds a letter.

    Texts are read, hashed and scored once. One shuffle of lines, by document: the join with the
    sources, the repeats and the sums all use it.
    """
    lines, sources = written(scored_lines(pages, fit(documents))), document_sources(manifest)
    frequent = frequent_among(lines.where("line_hash <> 0"), sources).select("source", "line_hash", F.lit(True).alias("frequent"))
    place = ["user_id", "doc_id", "number", "paragraph", "line_no"]
    lines = lines.join(sources, ["user_id", "doc_id"], "left")
    # rows of a page stored several times: each line once, whichever row it comes from
    lines = lines.groupBy("source", *place).agg(*[F.max(x).alias(x) for x in ("line_hash", "letters", "prose_letters", "known_letters", *LANGUAGES)])
    kept = checked_join(lines, frequent, ["source", "line_hash"], "left").where("frequent is null")
    sums = kept.groupBy("user_id", "doc_id", "number", "paragraph").agg(*[F.sum(x).alias(x) for x in ("letters", "prose_letters", "known_letters", *LANGUAGES)])
    name, confidence = best_language()
    prose = (F.col("prose_letters") >= MIN_LETTERS) & (F.col("prose_letters") >= PROSE_SHARE * F.col("letters")) & (F.col("known_letters") >= KNOWN_SHARE * F.col("prose_letters"))
    return sums.select("user_id", "doc_id", "number", "paragraph", "letters", prose.alias("prose"), name.alias("lang"), confidence.alias("confidence"), *LANGUAGES)


def labelled(label: Column) -> Column:
    """The label in one form; null where there is none."""
    plain = F.lower(F.trim(label))
    return F.when(~plain.isin(*NO_LABEL), plain)


def found_labels(pages: DataFrame, manifest: DataFrame, extracted: DataFrame, documents: DataFrame) -> DataFrame:
    """(user_id, doc_id, number, paragraph, lang): prose not in the label's language, and (number and paragraph 0) languages a document lacks."""
    prose = paragraphs(pages, manifest, documents).where("prose")
    label = pages.select("user_id", "doc_id", "number", labelled(F.col("language")).alias("label")).where("label is not null and number is not null")
    # where rows of a page carry several labels, the greatest counts
    each = label.groupBy("user_id", "doc_id", "number").agg(F.max("label").alias("label"))
    labels = each.groupBy("user_id", "doc_id").agg(F.map_from_entries(F.collect_list(F.struct("number", "label"))).alias("labels"))
    listed = extracted.groupBy("user_id", "doc_id").agg(F.array_distinct(F.flatten(F.collect_set("languages"))).alias("languages"))
    # the cases of pages and the language sets of documents in one aggregate, so that the paragraphs are made once
    case = F.struct("number", "paragraph", "lang")
    per_document = prose.groupBy("user_id", "doc_id").agg(F.collect_set(case).alias("all"), F.collect_set("lang").alias("langs")).join(listed, ["user_id", "doc_id"], "left").join(labels, ["user_id", "doc_id"], "left")
    wrong = F.filter("all", lambda c: ~F.coalesce(F.element_at("labels", c["number"]) == c["lang"], F.lit(False)))
    per_document = per_document.withColumn("cases", wrong)
    lacking = F.array_except("langs", F.coalesce("languages", F.array().cast("array<string>")))
    zero = F.transform(lacking, lambda x: F.struct(F.lit(0).alias("number"), F.lit(0).alias("paragraph"), x.alias("lang")))
    return per_document.select("user_id", "doc_id", F.explode(F.concat("cases", zero)).alias("c")).select("user_id", "doc_id", "c.number", "c.paragraph", "c.lang")


def page_languages(pages: DataFrame, manifest: DataFrame, documents: DataFrame) -> DataFrame:
    """(user_id, doc_id, number, lang, confidence, languages): a page's main language and those of its prose paragraphs."""
    name, confidence = best_language()
    rows = paragraphs(pages, manifest, documents)
    sums = rows.groupBy("user_id", "doc_id", "number").agg(*[F.sum(x).alias(x) for x in LANGUAGES], F.array_sort(F.collect_set(F.when(F.col("prose"), F.col("lang")))).alias("languages"))
    return sums.select("user_id", "doc_id", "number", name.alias("lang"), confidence.alias("confidence"), "languages")


def document_languages(pages: DataFrame, manifest: DataFrame, documents: DataFrame) -> DataFrame:
    """(user_id, doc_id, lang, confidence, languages): a document's main language and all languages of its prose, by letters."""
    rows = paragraphs(pages, manifest, documents)
    letters = rows.groupBy("user_id", "doc_id", "lang").agg(F.sum(F.when(F.col("prose"), F.col("letters")).otherwise(0)).alias("letters"), *[F.sum(x).alias(x) for x in LANGUAGES])
    name, confidence = best_language()
    by_letters = F.transform(F.reverse(F.array_sort(F.collect_list(F.when(F.col("letters") > 0, F.struct("letters", "lang"))))), lambda x: x["lang"])
    sums = letters.groupBy("user_id", "doc_id").agg(by_letters.alias("languages"), *[F.sum(x).alias(x) for x in LANGUAGES])
    return sums.select("user_id", "doc_id", name.alias("lang"), confidence.alias("confidence"), "languages")
