"""Languages of texts and of their stretches: the nearest of several TF-IDF n-gram centroids per language."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

LANGUAGES = ("en", "es", "fr", "de", "pt", "it", "zh", "ru")

#: Names and codes of the languages, in lower case.
NAMES = {
    "en": ("en", "eng", "english", "inglés", "anglais", "englisch"),
    "es": ("es", "spa", "esp", "spanish", "español", "castellano", "castilian"),
    "fr": ("fr", "fra", "fre", "french", "français"),
    "de": ("de", "deu", "ger", "german", "deutsch"),
    "pt": ("pt", "por", "portuguese", "português"),
    "it": ("it", "ita", "italian", "italiano"),
    "zh": ("zh", "zho", "chi", "chinese", "中文", "mandarin", "cmn"),
    "ru": ("ru", "rus", "russian", "русский"),
}

#: Labels that name no language.
NO_LANGUAGE = ("", "und", "unk", "unknown", "none", "null", "n/a", "na", "xx", "zxx", "mul", "mis", "other", "undetermined", "not available", "-", ".")

#: n-grams of letters are counted in so many hashed features.
BITS = 16
FEATURES = 1 << BITS

#: The classifier is fitted on at most so many labelled texts of each label, the first by a hash of their ids, and on
#: at most so many stretches of each, evenly spaced over the whole text.
TRAINING_TEXTS, TRAINING_STRETCHES = 160, 12
CENTROIDS = 3

#: Most sentences of which a task keeps the language.
MOST_KEPT = 100_000

#: Characters whose n-grams are handled at once, and rows of which occurrences are marked at once.
SLICE, MARKED = 200_000, 64

#: For the fit, a stretch that no stop ends, or longer than any sentence, is cut into windows of WINDOW words, every STEP words.
WINDOW, STEP, SENTENCE = 8, 4, 40

#: Where languages meet without a stop, a change costs so much of the words' evidence; a part must have so much more of it than
#: its neighbours' languages have there, and be so sure or have very much more, to count.
CHANGE, GAIN, ALONE, CLEAR = 1.2, 3.0, 0.85, 6.0

#: A stretch is rejected below this part of the score that all but 2 % of its language's training sentences reach, or
#: if the next language comes closer than MARGIN.
FLOOR, MARGIN = 0.5, 0.02

#: A margin of 1/SLOPE more makes the odds of a language e times as good.
SLOPE = 20

#: A sentence counts from so many words on (half the letters in Chinese), a stretch that no stop ends from more.
LEAST_WORDS, LEAST_OPEN = 3, 5

_NOISE = re.compile(r"<[^<>\n]{1,24}>|&(?:amp;)?#?\w{1,8};|\bnbsp;|\[[A-Z]{2,6}\]|(.)\1{4,}|Ã[ƒ\x80-\xbf]\S{0,3}|Â[\x80-\xbf]")
_LETTER = re.compile(r"[¿¡a-zß-öø-ÿāăąćčďđęěğėīłńňōőœřśşšťūůűźżžа-яёіїєґ一-鿿]")
_END = re.compile(r"[.!?…。！？][\"'”»)\s]*$")
_MARK = re.compile(r"[.!?…。！？]")
_LINE = re.compile(r"[^\r\n  ]+")
_STOP = re.compile(r"(?:(?<![Ss]t)(?<!ST)\.|[!?…])[\"'”»)]*\s+|[。！？]|\s/\s+")
_CODE = re.compile(r"[=<>{};]|\w\(|[a-z]_[a-z]", re.I)
_CLAUSE = re.compile(r"^\s*(?:select|from|where|(?:group|order) by)\b[\w\s,.]{0,40}$", re.I)
_FIELD = re.compile(r"^\s*[^\W\d]+(?: [^\W\d]+){0,2}\s?: (?:\S+\s?){1,9}$")
_HAN = re.compile(r"[一-鿿]")
_INSERT = re.compile(r" +\t[\t ]*|\t+ [\t ]*")


class _Letters(dict):
    """Letters as they are and blanks for all other signs, for ``str.translate``; signs are looked up once."""

    def __missing__(self, code: int) -> int:
        self[code] = code if _LETTER.match(chr(code)) else 32
        return self[code]


_LETTERS = _Letters()


def canonical_label(label: Column) -> Column:
    """The language's code for any form of its name or code, null for none; names of other languages stay as they are."""
    text = F.lower(F.trim(F.regexp_replace(label, r"[\s ]+", " ")))
    whole = {name: code for code, names in NAMES.items() for name in names}
    codes = F.create_map(*[F.lit(x) for pair in whole.items() for x in pair])
    base = F.regexp_extract(text, r"^([^-_ (]+)", 1)
    found = F.coalesce(F.try_element_at(codes, text), F.try_element_at(codes, base))
    return F.coalesce(found, F.when(~text.isin(*NO_LANGUAGE) & text.rlike(r"\p{L}"), text))


def is_row(line: str) -> bool:
    """Whether a line is a row of a table: three or more cells by bars or tabs, by tabs most of them figures, codes or up to three words
    without a stop. A run of tabs and blanks counts as a blank, as in prose, and empty cells are left out."""
    if line.count(" | ") > 1:
        return True
    if line.count("\t") < 2:
        return False
    text = _INSERT.sub(" ", line.strip())
    cells = [c for c in text.split("\t") if c.strip()]
    few = sum(len(c.split()) <= 3 and not (len(c.split()) > 1 and c.rstrip()[-1] in ".!?…。！？") and len(_HAN.findall(c)) <= 6 for c in cells)
    return text.count("\t") > 1 and len(cells) > 1 and few > len(cells) / 2


def stretches(text: str) -> list[tuple[int, int, str, bool]]:
    """Sentences of a text: start, end, letters (lower case, one blank between words), and whether a stop ends it.

    Tables, code, headings and fields (``Name: ...``) are none.
    """
    out, fenced = [], False
    for line in _LINE.finditer(text):
        raw = line.group()
        bare = raw.strip()
        if bare.startswith("```"):
            fenced = not fenced
            continue
        stopped = bool(_END.search(bare[-12:]))
        clean = _NOISE.sub(lambda m: " " * len(m.group()), raw)
        if fenced or is_row(raw) or bare.startswith("#"):
            continue
        if not stopped and (_CODE.search(clean) or _CLAUSE.match(clean) or _FIELD.match(clean)):
            continue
        at = 0
        for end in [*(m.end() for m in _STOP.finditer(clean)), len(clean)]:
            part = clean[at:end]
            letters = " ".join(part.lower().translate(_LETTERS).split())
            if letters:
                out.append((line.start() + at, line.start() + end, letters, bool(_MARK.search(part[-6:]))))
            at = end
    return out


def words_of(letters: str) -> float:
    """Words of at least two letters; two Chinese signs are one."""
    words = letters.split()
    if letters.isascii() or not _HAN.search(letters):
        return len(words) - sum(len(w) == 1 for w in words)
    return len(_HAN.findall(letters)) / 2 + sum(len(w) > 1 and not _HAN.search(w) for w in words)


def tokens_of(letters: str) -> list[str]:
    """Words, of Chinese pairs of signs."""
    return re.findall(r"[一-鿿]{1,2}|[^\s一-鿿]+", letters)


def windows(start: int, end: int, letters: str, stopped: bool) -> list[tuple[int, int, str]]:
    """A stretch that may hold several sentences in overlapping windows; their places in the text are in proportion."""
    tokens = tokens_of(letters)
    if len(tokens) <= (SENTENCE if stopped else WINDOW + STEP):
        return [(start, end, letters)]
    scale = (end - start) / len(tokens)
    out = []
    for i in range(0, len(tokens) - WINDOW + STEP, STEP):
        j = len(tokens) if i + WINDOW + STEP > len(tokens) else i + WINDOW
        out.append((start + int(i * scale), start + int(j * scale), _join(tokens[i:j])))
        if j == len(tokens):
            break
    return out


def _join(tokens: list[str]) -> str:
    return re.sub(r"(?<=[一-鿿]) (?=[一-鿿])", "", " ".join(tokens))


def hashed(rows: list[str]) -> np.ndarray:
    """All n-grams of the rows as row * FEATURES + feature. n from 2 to 4, a blank at either end of a word being
    part of them, and single signs of Chinese."""
    codes = np.frombuffer("\0".join(f" {r} " for r in rows).encode("utf-32-le"), np.uint32).astype(np.uint64)
    row = np.repeat(np.arange(len(rows), dtype=np.uint64), [len(r) + 3 for r in rows])[: len(codes)]
    border, blank = codes == 0, codes == 32
    keys = []
    for n in (1, 2, 3, 4):
        m = len(codes) - n + 1
        if m <= 0:
            continue
        value, ok = np.zeros(m, np.uint64), np.ones(m, bool)
        for i in range(n):
            value = value * np.uint64(1_000_003) + codes[i : i + m]
            ok &= ~border[i : i + m]
            if 0 < i < n - 1:
                ok &= ~blank[i : i + m]
        if n == 1:
            ok &= codes >= 0x4E00
        elif n == 2:
            ok &= ~(blank[:m] & blank[1 : m + 1])
        mixed = (value * np.uint64(0x9E3779B97F4A7C15) + np.uint64(n)) >> np.uint64(64 - BITS)
        keys.append((row[:m][ok] << np.uint64(BITS)) | mixed[ok])
    return np.concatenate(keys) if keys else np.empty(0, np.uint64)


def grams(rows: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct n-grams of each row (sorted by row): row, feature, count."""
    found, counts = np.unique(hashed(rows), return_counts=True)
    return (found >> np.uint64(BITS)).astype(np.int32), (found & np.uint64(FEATURES - 1)).astype(np.int32), counts


def rows_with(rows: list[str]) -> np.ndarray:
    """In how many of the rows each feature occurs; marked in a table of rows by features, in parts of ``MARKED`` rows."""
    total = np.zeros(FEATURES, np.int64)
    for a in range(0, len(rows), MARKED):
        some = rows[a : a + MARKED]
        marks = np.zeros(len(some) * FEATURES, bool)
        marks[hashed(some)] = True
        total += marks.reshape(len(some), FEATURES).sum(axis=0)
    return total


def slices(rows: list[str]) -> Iterator[tuple[int, list[str]]]:
    """The rows in parts of about ``SLICE`` characters, with the place of each part."""
    at, size = 0, 0
    for i, row in enumerate(rows):
        size += len(row) + 2
        if size >= SLICE:
            yield at, rows[at : i + 1]
            at, size = i + 1, 0
    if at < len(rows):
        yield at, rows[at:]


@dataclass
class Model:
    idf: np.ndarray
    centroids: np.ndarray
    floors: np.ndarray
    own: np.ndarray
    seen: dict[str, tuple[int, float]] = field(default_factory=dict)
    words: dict[str, np.ndarray] = field(default_factory=dict)
    places: dict[str, list[tuple[int, int]]] = field(default_factory=dict)

    def vectors(self, rows: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        parts = []
        for at, some in slices(rows):
            row, feature, count = grams(some)
            weight = ((1 + np.log(count)) * self.idf[feature]).astype(np.float32)
            norm = np.sqrt(np.bincount(row, weight**2, len(some))).astype(np.float32)
            parts.append((row + np.int32(at), feature, weight / np.maximum(norm[row], np.float32(1e-9))))
        return tuple(np.concatenate(x) for x in zip(*parts)) if parts else (np.empty(0, np.int32), np.empty(0, np.int32), np.empty(0, np.float32))

    def nearness(self, row: np.ndarray, feature: np.ndarray, weight: np.ndarray, rows: int, to: np.ndarray | None = None) -> np.ndarray:
        """Of each row with each centroid, or with each column of ``to``."""
        to = self.centroids if to is None else to
        out = np.zeros((rows, to.shape[1]), np.float32)
        first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else np.empty(0, int)
        step = 128  # so that a part stays in the processor's cache
        for a in range(0, len(first), step):
            some = first[a : a + step]
            begin, end = some[0], first[a + step] if a + step < len(first) else len(row)
            out[row[some]] = np.add.reduceat(to[feature[begin:end]] * weight[begin:end, None], some - begin, axis=0)
        return out

    def scores(self, rows: list[str]) -> np.ndarray:
        """Cosine with the nearest centroid of each language."""
        near = self.nearness(*self.vectors(rows), len(rows))
        return near.reshape(len(rows), len(LANGUAGES), -1).max(axis=2)

    def judge(self, rows: list[str]) -> list[tuple[int, float]]:
        """The language of each row (-1: rejected), and a confidence from 0 to 1. Rows are kept while there are not too many,
        as short sentences recur."""
        new = [r for r in dict.fromkeys(rows) if r not in self.seen]
        if len(self.seen) + len(new) > MOST_KEPT:
            self.seen.clear()
            new = list(dict.fromkeys(rows))
        if new:
            scores = self.scores(new)
            best = scores.argmax(axis=1)
            ordered = np.sort(scores, axis=1)
            top, margin = ordered[:, -1], ordered[:, -1] - ordered[:, -2]
            ok = (top >= FLOOR * self.floors[best]) & (margin >= MARGIN)
            sure = np.round(1 / (1 + np.exp(-SLOPE * (margin - MARGIN))), 4)
            self.seen.update(zip(new, zip(np.where(ok, best, -1).tolist(), sure.tolist())))
        return [self.seen[r] for r in rows]


    def evidence(self, words: list[str]) -> np.ndarray:
        """What each word by itself says for each language, by what the language as a whole has of its own. No n-gram reaches over words, so a text's n-grams are its words'."""
        new = [w for w in dict.fromkeys(words) if w not in self.words]
        if len(self.words) + len(new) > MOST_KEPT:
            self.words.clear()
            new = list(dict.fromkeys(words))
        for at, some in slices(new):
            row, feature, count = grams(some)
            self.words.update(zip(some, self.nearness(row, feature, (self.idf[feature] * count).astype(np.float32), len(some), self.own)))
        return np.array([self.words[w] for w in words], np.float32)

    def paths(self, rows: list[list[str]]) -> list[np.ndarray]:
        """The languages of each row's words that have most evidence, less ``CHANGE`` for every change (Viterbi's algorithm)."""
        out: list[np.ndarray] = [np.empty(0, np.int64)] * len(rows)
        order = sorted(range(len(rows)), key=lambda i: -len(rows[i]))
        while order:
            longest = len(rows[order[0]])
            some, order = order[: max(1, SLICE // 4 // longest)], order[max(1, SLICE // 4 // longest) :]
            sizes = np.array([len(rows[i]) for i in some])
            given = np.zeros((len(some), longest, len(LANGUAGES)), np.float32)
            given[np.arange(longest) < sizes[:, None]] = self.evidence([w for i in some for w in rows[i]])
            stay, come = np.ones((longest, len(some), len(LANGUAGES)), bool), np.zeros((longest, len(some)), np.int64)
            best = given[:, 0].copy()
            for t in range(1, longest):
                a = int((sizes > t).sum())
                come[t, :a] = best[:a].argmax(axis=1)
                other = best[np.arange(a), come[t, :a]][:, None] - CHANGE
                stay[t, :a] = best[:a] >= other
                best[:a] = np.maximum(best[:a], other) + given[:a, t]
            path, now, every = np.empty((longest, len(some)), np.int64), best.argmax(axis=1), np.arange(len(some))
            for t in range(longest - 1, -1, -1):
                path[t] = now
                now = np.where(stay[t, every, now], now, come[t])
            for k, i in enumerate(some):
                out[i] = path[: sizes[k], k]
        return out

    def divide(self, rows: list[str]) -> list[list[tuple[int, int, str]]]:
        """Each row in parts (first word, end, letters) of different languages that count by themselves; what lies between
        goes to the part before. A row in one language is one part."""
        new = [r for r in dict.fromkeys(rows) if r not in self.places]
        if len(self.places) + len(new) > MOST_KEPT:
            self.places.clear()
            new = list(dict.fromkeys(rows))
        words = [tokens_of(r) for r in new]
        parts: list[list[tuple[int, int]]] = []
        gains: list[float] = []
        for w, path in zip(words, self.paths(words)):
            edges = [0, *(np.flatnonzero(np.diff(path)) + 1).tolist(), len(path)]
            parts.append(list(zip(edges, edges[1:])) if len(edges) > 2 else [])
            for a, b in parts[-1]:
                total = self.evidence(w[a:b]).sum(axis=0)
                gains.append(float(total[path[a]] - max(total[path[i]] for i in (a - 1, b) if 0 <= i < len(path))))
        tried = [_join(w[a:b]) for w, some in zip(words, parts) for a, b in some]
        found = iter(list(zip(tried, gains, self.judge(tried))))
        for row, w, some in zip(new, words, parts):
            kept: list[tuple[int, int]] = []
            for (a, _), (piece, gain, (lang, sure)) in zip(some, [next(found) for _ in some]):
                counts = lang >= 0 and words_of(piece) >= LEAST_WORDS and gain >= GAIN and (sure >= ALONE or gain >= CLEAR)
                if counts and (not kept or kept[-1][1] != lang):
                    kept.append((a if kept else 0, lang))
            starts = [a for a, _ in kept] if len(kept) > 1 else [0]
            self.places[row] = list(zip(starts, [*starts[1:], len(w)]))
        return [[(a, b, _join(w[a:b])) for a, b in p] if len(p := self.places[r]) > 1 and (w := tokens_of(r)) else [(*p[0], r)] for r in rows]


def document_frequencies(df: DataFrame, text: str) -> tuple[np.ndarray, int]:
    """In how many texts of the whole corpus each feature occurs. Every task adds up its own counts, of a fixed
    number of features, before they are added together."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, texts = np.zeros(FEATURES, np.int64), 0
        for pdf in batches:
            some = [" ".join(letters for *_, letters, _ in stretches(t)) for t in pdf["__t"] if isinstance(t, str)]
            some = [s for s in some if s]
            texts += len(some)
            for _, part in slices(some):
                seen += rows_with(part)
        used = np.flatnonzero(seen)
        yield pd.DataFrame({"feature": np.append(used, -1), "n": np.append(seen[used], texts)})

    found = df.select(F.col(text).alias("__t")).mapInPandas(count, "feature bigint, n bigint").groupBy("feature").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(FEATURES, np.int64)
    real = found["feature"] >= 0
    out[found["feature"][real].to_numpy(int)] = found["n"][real]
    return out, int(found["n"][~real].sum())


def without_accents(text: str) -> str:
    return "".join(ch for ch in unicodedata.normalize("NFD", text) if not unicodedata.combining(ch))


def _centroids(row: np.ndarray, feature: np.ndarray, weight: np.ndarray, group: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """Normalised means of the vectors in each group, less what all have in common, normalised again, so that the product
    of a normalised vector with one is their cosine; and their lengths before that, which are what a language has of its own."""
    length = lambda x: np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    flat = np.bincount(group[row] * FEATURES + feature, weight, groups * FEATURES).reshape(groups, FEATURES)
    flat /= length(flat)
    flat -= flat.mean(axis=0)
    own = length(flat)
    return np.ascontiguousarray((flat / own).T.astype(np.float32)), own[:, 0].astype(np.float32)


def training_stretches(df: DataFrame, key: str, text: str, label: str) -> pd.DataFrame:
    """(``__l``, ``__p``): at most ``TRAINING_STRETCHES`` stretches of each of at most ``TRAINING_TEXTS`` texts a label, the texts with the
    smallest hashes. Hashes of texts are ranked, never texts; those up to each label's last hash are read again, and only
    their stretches go to the driver, equal texts once."""
    named = df.select(F.col(text).alias("__t"), canonical_label(F.col(label)).alias("__l"), F.xxhash64(F.col(key), F.col(text)).alias("__h"))
    named = named.where(F.col("__l").isin(*LANGUAGES) & F.col("__t").isNotNull())
    hashes = named.select("__l", "__h").distinct().withColumn("__r", F.row_number().over(Window.partitionBy("__l").orderBy("__h")))
    last = {r["__l"]: r["__last"] for r in hashes.where(F.col("__r") <= TRAINING_TEXTS).groupBy("__l").agg(F.max("__h").alias("__last")).collect()}
    chosen = F.lit(False)
    for lang, most in last.items():
        chosen |= (F.col("__l") == lang) & (F.col("__h") <= most)

    def cut_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made = []
            for body in pdf["__t"]:
                pieces = [p for start, end, letters, stopped in stretches(body) for *_, p in windows(start, end, letters, stopped) if words_of(p) >= LEAST_WORDS]
                made.append(pieces[:: max(1, -(-len(pieces) // TRAINING_STRETCHES))])
            yield pd.DataFrame({"__l": pdf["__l"], "__h": pdf["__h"], "__p": made})

    cut_texts = named.where(chosen).select("__l", "__h", "__t").mapInPandas(cut_up, "__l string, __h bigint, __p array<string>")
    return cut_texts.groupBy("__l", "__h").agg(F.any_value("__p").alias("__p")).toPandas().sort_values(["__l", "__h"])


def fit(df: DataFrame, key: str, text: str, label: str) -> Model:
    """Centroids from labelled texts, of which some labels are wrong.

    Document frequencies come from all texts; sentences from at most ``TRAINING_TEXTS`` texts a label. A sentence starts with its
    text's label, and twice goes to the nearest language, by which wrong labels and mixed texts drop out.
    Then the sentences of each language are clustered into ``CENTROIDS`` groups; what a language as a whole has of its own, which does
    not depend on how its clusters fall, weighs words where languages meet. Sentences take part with and
    without accents. The mean of all centroids is taken off, so what languages share (names, figures) does not count.
    """
    frequency, texts = document_frequencies(df, text)
    idf = np.log((texts + 1) / (frequency + 1)) + 1
    sample = training_stretches(df, key, text, label)
    rows: list[str] = []
    labels: list[int] = []
    for lang, pieces in zip(sample["__l"], sample["__p"]):
        for piece in pieces:
            rows += [piece, without_accents(piece)]
            labels += [LANGUAGES.index(lang)] * 2
    n = len(LANGUAGES)
    model = Model(idf.astype(np.float32), np.zeros((FEATURES, n), np.float32), np.ones(n), np.zeros((FEATURES, n), np.float32))
    if not rows:
        return model
    row, feature, weight = model.vectors(rows)
    group = np.array(labels)
    for _ in range(3):
        model.centroids, length = _centroids(row, feature, weight, group, n)
        group = (model.nearness(row, feature, weight, len(rows)) * length).argmax(axis=1)
    whole, length = _centroids(row, feature, weight, group, n)
    model.own = whole * length
    fine = group * CENTROIDS + np.arange(len(rows)) // 2 % CENTROIDS
    for _ in range(4):
        model.centroids, length = _centroids(row, feature, weight, fine, n * CENTROIDS)
        near = model.nearness(row, feature, weight, len(rows))
        own = (near * length).reshape(len(rows), n, CENTROIDS)
        fine = group * CENTROIDS + own[np.arange(len(rows)), group].argmax(axis=1)
    best = near.max(axis=1)
    model.floors = np.array([np.quantile(best[group == i], 0.02) if (group == i).any() else 1.0 for i in range(n)])
    return model


@dataclass
class Stretch:
    start: int
    end: int
    words: float
    lang: int
    sure: float
    cut: bool
    stopped: bool = True


def judged(texts: list[str], model: Model) -> list[list[Stretch]]:
    """The stretches of each text, divided where languages meet without a stop; places there are in proportion to words."""
    whole = [(i, *stretch) for i, text in enumerate(texts) for stretch in stretches(text)]
    rows: list[str] = []
    where: list[tuple[int, int, int, bool, bool]] = []
    for (i, start, end, _, stopped), parts in zip(whole, model.divide([letters for *_, letters, _ in whole])):
        scale = (end - start) / max(1, parts[-1][1])
        for a, b, piece in parts:
            rows.append(piece)
            where.append((i, start + int(a * scale), start + int(b * scale), len(parts) > 1, stopped))
    out: list[list[Stretch]] = [[] for _ in texts]
    for (i, a, b, cut, stopped), piece, (lang, sure) in zip(where, rows, model.judge(rows)):
        out[i].append(Stretch(a, b, words_of(piece), lang, sure, cut, stopped))
    short = [i for i, found in enumerate(out) if found and not counted(found)]
    if short:
        # Nothing is near enough or long enough by itself: all words together, rejected by the same distance and margin.
        words: dict[int, list[str]] = {i: [] for i in short}
        for (i, *_), piece in zip(where, rows):
            if i in words:
                words[i].append(piece)
        joined = [" ".join(words[i]) for i in short]
        for i, piece, (lang, sure) in zip(short, joined, model.judge(joined)):
            if lang >= 0:
                out[i] = [Stretch(out[i][0].start, out[i][-1].end, max(words_of(piece), LEAST_WORDS), lang, sure, False)]
    return out


def counted(found: list[Stretch]) -> dict[int, tuple[float, float]]:
    """Languages that count in a text: words and confidence. A language needs a whole sentence: a stretch of its own, or a
    part of one where languages meet without a stop."""
    out: dict[int, tuple[float, float]] = {}
    for s in found:
        if s.lang >= 0 and s.words >= (LEAST_WORDS if s.stopped or s.cut else LEAST_OPEN):
            words, sure = out.get(s.lang, (0.0, 0.0))
            out[s.lang] = (words + s.words, max(sure, s.sure))
    return out


def _merged(found: list[Stretch]) -> list[dict]:
    """Neighbouring stretches of one language as one."""
    out: list[dict] = []
    for s in found:
        name = LANGUAGES[s.lang] if s.lang >= 0 else None
        if out and out[-1]["lang"] == name:
            out[-1]["end"], out[-1]["confidence"] = s.end, max(out[-1]["confidence"], s.sure)
        else:
            out.append({"start": s.start, "end": s.end, "lang": name, "confidence": s.sure})
    return out


SEGMENT = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string()), ("confidence", pa.float64())])


def _identified(df: DataFrame, keep: list[str], text: str, model: Model, segments: bool) -> DataFrame:
    rows = df.select(*keep, F.col(text).alias("__t"))
    schema = T.StructType([f for f in rows.schema if f.name != "__t"]).add("lang", T.StringType()).add("confidence", T.DoubleType()).add("languages", T.ArrayType(T.StringType()))
    if segments:
        parts = T.StructType().add("start", T.IntegerType()).add("end", T.IntegerType()).add("lang", T.StringType()).add("confidence", T.DoubleType())
        schema = schema.add("segments", T.ArrayType(parts))
    shared = df.sparkSession.sparkContext.broadcast((model.idf, model.centroids, model.floors, model.own))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for whole in batches:
            for a in range(0, max(1, len(whole)), 256):
                batch = whole.slice(a, 256)
                found = judged([t or "" for t in batch.column("__t").to_pylist()], own)
                langs = [sorted(counted(f).items(), key=lambda x: (-x[1][0], x[0])) for f in found]
                made = [
                    pa.array([LANGUAGES[x[0][0]] if x else None for x in langs], pa.string()),
                    pa.array([x[0][1][1] if x else None for x in langs], pa.float64()),
                    pa.array([[LANGUAGES[i] for i, _ in x] for x in langs], pa.list_(pa.string())),
                ]
                if segments:
                    made.append(pa.array([_merged(f) for f in found], pa.list_(SEGMENT)))
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], *made], names=schema.names)

    return rows.mapInArrow(run, schema)


def identify(df: DataFrame, key: str, text: str, model: Model) -> DataFrame:
    """(key, ``lang``, ``confidence``, ``languages``, ``segments``) of every text.

    ``lang`` is the language of most words, ``languages`` all that count, the first by words; ``segments`` are
    stretches of one language by offsets of characters, ``lang`` null where none is near enough. Null, empty
    and blank texts, and those without words, have no language and no confidence. Whole texts are read.
    """
    return _identified(df, [key], text, model, True)


def wrong_labels(df: DataFrame, key: str, text: str, label: str, model: Model) -> DataFrame:
    """(key, ``lang``): a row per language of each text whose label is missing or names another language than the text's, and
    of each text in several languages. Texts in no language have no row; another form of the right label is right."""
    said = df.select(key, F.col(text).alias("__text"), canonical_label(F.col(label)).alias("__said"))
    found = _identified(said, [key, "__said"], "__text", model, False)
    wrong = (F.size("languages") > 1) | F.col("__said").isNull() | (F.col("__said") != F.col("lang"))
    return found.where((F.size("languages") > 0) & wrong).select(key, F.explode("languages").alias("lang"))
