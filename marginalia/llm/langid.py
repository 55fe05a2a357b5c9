"""Languages of documents and of their segments, by hierarchical discrimination.

A line is scored on the words it is made of: first which family of languages it belongs to, then, within the family,
by one-versus-one linear support vector machines between its closely related languages. All machines share one hashed
space of character runs and whole words, and a line's score is the mean over its words, so each distinct word is scored
once per worker.
"""

from __future__ import annotations

import itertools
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Languages by family, and the spellings of a label that name them.
FAMILIES = {"germanic": ["de", "en", "nl"], "romance": ["es", "fr", "it", "pt"], "slavic": ["pl", "ru"]}
LANGUAGES = [x for f in FAMILIES.values() for x in f]
SPELLINGS = {
    "de": ["deu", "ger", "german", "deutsch"],
    "en": ["eng", "english"],
    "nl": ["nld", "dut", "dutch"],
    "es": ["spa", "spanish"],
    "fr": ["fra", "fre", "french"],
    "it": ["ita", "italian"],
    "pt": ["por", "portuguese"],
    "pl": ["pol", "polish"],
    "ru": ["rus", "russian"],
}
#: Slots of the hashed feature space, different labelled texts the machines are fitted on at most, and words that make a line count.
SLOTS, SAMPLE, LONG = 1 << 16, 2_700, 8
#: A line whose machine margin is below this takes the language of the lines around it.
DOUBT = 0.25
_LETTERS = re.compile(r"[^\W\d_]+")


def label_language(label: Column) -> Column:
    """The language a label names, whatever its case, padding, region or form; null if it names none of them."""
    bare = F.lower(F.regexp_replace(label, r"^\s+|\s+$", ""))
    head = F.regexp_extract(bare, r"^([a-z]+)(?:[-_][a-z0-9-_]+)?$", 1)
    named = {code: code for code in LANGUAGES} | {name: code for code, names in SPELLINGS.items() for name in names}
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in named.items() for x in pair]), head)


def _plain(word: str) -> str:
    """Letters of a word, lower-cased, without accents; '' for words with digits, brackets, slashes or no letters."""
    if any(c in "0123456789[]/\\_<>{}=|`" for c in word):
        return ""
    folded = unicodedata.normalize("NFKD", word.lower())
    found = _LETTERS.findall("".join(c for c in folded if not unicodedata.combining(c)).replace("\N{RIGHT SINGLE QUOTATION MARK}", "'"))
    return " ".join(found)


def word_features(word: str) -> np.ndarray:
    """Slots of a word: each part whole, and its runs of 1 to 4 characters with the ends marked."""
    slots = []
    for part in _plain(word).split():
        marked = f"^{part}$"
        slots.append(zlib.crc32(("w" + part).encode()) % SLOTS)
        slots.extend(zlib.crc32(marked[i : i + n].encode()) % SLOTS for n in (2, 3, 4) for i in range(len(marked) - n + 1))
    return np.array(slots, dtype=np.int64)


def _fit_linear(rows: list[np.ndarray], y: np.ndarray, rounds: int = 6, rate: float = 0.5, decay: float = 1e-4, seed: int = 3) -> np.ndarray:
    """A linear support vector machine (hinge loss, averaged subgradient steps over mini-batches); the last weight is the offset."""
    rng = np.random.default_rng(seed)
    w, total, steps = np.zeros(SLOTS + 1), np.zeros(SLOTS + 1), 0
    weight = {1: len(y) / max(1, 2 * (y > 0).sum()), -1: len(y) / max(1, 2 * (y < 0).sum())}
    for r in range(rounds):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), 64):
            part = order[at : at + 64]
            size = np.array([len(rows[i]) for i in part])
            flat = np.concatenate([rows[i] for i in part])
            owner = np.repeat(np.arange(len(part)), size)
            scale = 1 / size
            margin = (np.bincount(owner, w[flat], len(part)) * scale + w[-1]) * y[part]
            wrong = margin < 1
            step = rate / (1 + 0.3 * r)
            w *= 1 - step * decay
            push = np.where(wrong, y[part] * np.array([weight[int(v)] for v in y[part]]), 0) * scale * step
            np.add.at(w, flat, push[owner] * 8)
            total += w
            steps += 1
    return total / max(1, steps)


class Model:
    """One machine per family against the rest, and one per pair of languages of a family; ``scale`` turns a margin ``m`` into
    the chance of being right, ``1 / (1 + exp(-(scale[0] * m + scale[1])))``."""

    def __init__(self, weights: np.ndarray, scale: tuple[float, float] = (4.0, 0.0)):
        self.weights = weights.astype(np.float32)  # (slots + 1, machines)
        self.scale = scale
        self.pairs = [(a, b) for f in FAMILIES.values() for a, b in itertools.combinations(f, 2)]

    @property
    def machines(self) -> int:
        return len(FAMILIES) + len(self.pairs)

    def word(self, word: str) -> np.ndarray:
        """Summed weights of a word's slots, and their number in the last place."""
        slots = word_features(word)
        return np.append(self.weights[slots].sum(0), len(slots)) if len(slots) else np.zeros(self.machines + 1, np.float32)

    def decide(self, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(language, margin) of lines, from the sums over their words. The family with the best score wins, then the
        language that wins most of its pairs, ties by the summed margins."""
        score = sums[:, :-1] / np.maximum(sums[:, -1:], 1) + self.weights[-1]
        heads = score[:, : len(FAMILIES)]
        family = heads.argmax(1)
        ordered = np.sort(heads, axis=1)
        margin = ordered[:, -1] - ordered[:, -2]
        language = np.zeros(len(sums), int)
        for f, members in enumerate(FAMILIES.values()):
            mine = family == f
            if not mine.any():
                continue
            wins, sure = np.zeros((mine.sum(), len(members))), np.zeros((mine.sum(), len(members)))
            low = np.full((mine.sum(), len(members)), np.inf)
            for p, (a, b) in enumerate(self.pairs):
                if a in members and b in members:
                    s = score[mine, len(FAMILIES) + p]
                    for x, v in ((members.index(a), s), (members.index(b), -s)):
                        wins[:, x] += v > 0
                        sure[:, x] += np.tanh(v)
                        low[:, x] = np.minimum(low[:, x], v)
            best = (wins + sure / 100).argmax(1)
            language[mine] = [LANGUAGES.index(members[b]) for b in best]
            margin[mine] = np.minimum(margin[mine], low[np.arange(len(best)), best])
        margin = np.where(sums[:, -1] > 0, margin, 0)
        return language, margin

    def chance(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale[0] * margin + self.scale[1], -30, 30)))


def _lines(text: str | None) -> list[str]:
    return re.split(r"\r\n|\r|\n", text or "")


def fit(docs: DataFrame, text: str = "text", label: str = "lang", sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` different texts whose label names a language, an equal share of each language, those of the
    smallest hashes, in that order: neither copies nor the order of rows change the fit. Labels are taken as noisy: a first
    fit throws out lines that clearly disagree with theirs. Every tenth text is held out to turn margins into chances.
    """
    known = docs.select(F.col(text).alias("text"), label_language(F.col(label)).alias("lang")).where("lang is not null and length(text) > 0")
    known = known.withColumn("h", F.xxhash64("text", "lang"))
    each = sample // len(LANGUAGES)
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).collect()}
    bound = F.lit(0.0)
    for lang, n in counts.items():
        bound = F.when(F.col("lang") == lang, F.lit(min(1.0, 1.3 * each / n))).otherwise(bound)
    u = F.pmod("h", F.lit(1 << 30)) / F.lit(float(1 << 30))
    few = known.where(u < bound).groupBy("lang", "h").agg(F.min("text").alias("text"))  # copies combine before they shuffle
    ranked = few.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("h", F.lit(1 << 30)), "h"))).where(F.col("r") <= each)
    chosen = ranked.select("lang", "r", "text").toPandas().sort_values(["lang", "r"])
    rows, y, held = [], [], []
    cache: dict[str, np.ndarray] = {}
    for t, lang, r in zip(chosen["text"], chosen["lang"], chosen["r"], strict=True):
        for line in _lines(t):
            words = line.split()
            if len(words) >= LONG:
                parts = [cache.setdefault(x, word_features(x)) if x not in cache else cache[x] for x in words]
                slots = np.concatenate(parts)
                if not len(slots):
                    continue
                if r % 10 == 0:
                    held.append((parts, LANGUAGES.index(lang)))
                else:
                    rows.append(slots)
                    y.append(LANGUAGES.index(lang))
    target = np.array(y, dtype=int)
    keep = np.arange(len(rows))
    for turn in range(2):
        model = Model(_fit_all([rows[i] for i in keep], target[keep], rounds=2 if turn == 0 else 5))
        if turn == 0 and len(rows):
            sums = np.stack([np.append(model.weights[r].sum(0), len(r)) for r in rows])
            guess, margin = model.decide(sums)
            keep = np.flatnonzero((guess == target) & (margin > 0.02))
    model.scale = _calibrated(model, held)
    return model


def _calibrated(model: Model, held: list[tuple[list[np.ndarray], int]], seed: int = 5) -> tuple[float, float]:
    """The logistic curve from margin to the share of right answers, by Newton steps on runs of one to ten words of the lines
    held out. Lines whose whole disagrees with their label count as mislabelled; targets are drawn in by one case each."""
    rng = np.random.default_rng(seed)
    sums, right = [], []
    for parts, lang in held:
        whole = np.concatenate(parts)
        if model.decide(np.append(model.weights[whole].sum(0), len(whole))[None])[0][0] != lang:
            continue
        n = int(rng.integers(1, min(10, len(parts)) + 1))
        at = int(rng.integers(0, len(parts) - n + 1))
        slots = np.concatenate(parts[at : at + n])
        if len(slots):
            sums.append(np.append(model.weights[slots].sum(0), len(slots)))
            right.append(lang)
    if len(sums) < 100:
        return 4.0, 0.0
    guess, margin = model.decide(np.stack(sums))
    hit = guess == np.array(right)
    target = np.where(hit, (hit.sum() + 1) / (hit.sum() + 2), 1 / ((~hit).sum() + 2))
    x, w = np.stack([margin, np.ones(len(margin))], 1), np.array([4.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (target - p))
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(max(w[0], 0.1)), float(w[1])


def _fit_all(rows: list[np.ndarray], y: np.ndarray, rounds: int) -> np.ndarray:
    machines = []
    groups = [[LANGUAGES.index(x) for x in f] for f in FAMILIES.values()]
    for g in groups:
        machines.append(_fit_some(rows, np.where(np.isin(y, g), 1, -1), rounds))
    for f in FAMILIES.values():
        for a, b in itertools.combinations(f, 2):
            mine = np.flatnonzero((y == LANGUAGES.index(a)) | (y == LANGUAGES.index(b)))
            machines.append(_fit_some([rows[i] for i in mine], np.where(y[mine] == LANGUAGES.index(a), 1, -1), rounds))
    return np.stack(machines, axis=1)


def _fit_some(rows: list[np.ndarray], y: np.ndarray, rounds: int) -> np.ndarray:
    return _fit_linear(rows, y, rounds) if len(rows) and len(set(y.tolist())) == 2 else np.zeros(SLOTS + 1)


class _Scores(dict):
    def __init__(self, model: Model):
        super().__init__()
        self.model, self.table, self.used = model, np.zeros((1024, model.machines + 1), np.float32), 0

    def __missing__(self, word: str) -> int:
        if self.used == len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self.table[self.used] = self.model.word(word)
        self[word] = self.used
        self.used += 1
        return self.used - 1

    def trim(self) -> None:
        """Forget everything once the vocabulary is large; called between batches, when no codes are held."""
        if self.used > 400_000:
            self.clear()
            self.used = 0


def _segments(texts: list[str | None], scores: _Scores):
    """For each text the list of ``(first line, last line, language, confidence, words, long lines)`` of its segments."""
    words, owner, lengths = [], [], []
    for d, t in enumerate(texts):
        for n, line in enumerate(_lines(t)):
            w = line.split()
            if w:
                owner.append((d, n, len(w)))
                lengths.append(len(w))
                words.extend(map(scores.__getitem__, w))
    out: list[list] = [[] for _ in texts]
    if not owner:
        return out
    start = np.r_[0, np.cumsum(lengths)[:-1]]
    codes = np.array(words)
    sums = np.concatenate([np.add.reduceat(scores.table[codes[a:b]], start[i:j] - a, axis=0) for i, j, a, b in _spans(start, len(codes))])
    language, margin = scores.model.decide(sums)
    docs = np.array([o[0] for o in owner])
    first = np.flatnonzero(np.r_[True, docs[1:] != docs[:-1]])
    for lo, hi in zip(first, np.r_[first[1:], len(docs)], strict=True):
        mine, sure, long = language[lo:hi], margin[lo:hi], np.array([o[2] >= LONG for o in owner[lo:hi]])
        firm = long & (sure >= DOUBT)
        if not firm.any():
            firm = long if long.any() else np.ones(len(mine), bool)
            best = np.bincount(mine[firm], sure[firm] + 1e-6).argmax()
            mine = np.where(firm, best, mine)
        # lines in doubt follow the firm line before them, the leading ones the first firm line
        at = np.maximum.accumulate(np.where(firm, np.arange(len(mine)), -1))
        at = np.where(at < 0, np.flatnonzero(firm)[0], at)
        mine = mine[at]
        change = np.flatnonzero(np.r_[True, mine[1:] != mine[:-1]])
        for a, b in zip(change, np.r_[change[1:], len(mine)], strict=True):
            trust = float(scores.model.chance(sure[a:b][firm[a:b]]).mean()) if firm[a:b].any() else 0.5
            d, n, _ = owner[lo + a]
            out[d].append((n, owner[lo + b - 1][1], LANGUAGES[mine[a]], trust, sum(o[2] for o in owner[lo + a : lo + b]), int(long[a:b].sum())))
    return out


def _spans(start: np.ndarray, n: int, most: int = 200_000):
    """(line from, line to, word from, word to) of runs of lines with about ``most`` words."""
    at = 0
    while at < len(start):
        end = max(at + 1, int(np.searchsorted(start, start[at] + most, "right")))
        yield at, end, int(start[at]), int(start[end]) if end < len(start) else n
        at = end


def segments(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, segment, first_line, last_line, lang, confidence, words, long_lines``: stretches of lines in one language.

    Lines of fewer than :data:`LONG` words, and lines in doubt, belong to the segment before them. Texts without a word
    (nulls and empty ones too) have no segment. ``key`` may repeat; every row is segmented for itself.
    """
    kind = dict(docs.dtypes)[key]
    names = [key, "segment", "first_line", "last_line", "lang", "confidence", "words", "long_lines"]
    held = docs.sparkSession.sparkContext.broadcast((model.weights, model.scale))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = _Scores(Model(*held.value))
        for whole in batches:
            for lo in range(0, whole.num_rows, 1000):
                b = whole.slice(lo, 1000)
                scores.trim()
                found = _segments(b.column(1).to_pylist(), scores)
                take = [i for i, s in enumerate(found) for _ in s]
                rows = [(n, *s) for segs in found for n, s in enumerate(segs)]
                cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
                kinds = [pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(take, pa.int64())), *(pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True))], names)

    schema = f"`{key}` {kind}, segment int, first_line int, last_line int, lang string, confidence double, words int, long_lines int"
    return docs.select(key, text).mapInArrow(run, schema)


def documents(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", label: str = "lang") -> DataFrame:
    """``key, label, language, languages, confidence, wrong``: the main language of each document (by words), the
    languages it has a long line in, and whether its label is missing, wrong or hides a mixture.

    Needs unique keys. Documents without any word have null language and are not ``wrong``.
    """
    parts = segments(docs, model, key, text)
    per = parts.groupBy(key, "lang").agg(F.sum("words").alias("w"), F.sum("long_lines").alias("n"), F.max("confidence").alias("c"))
    main = F.max(F.struct("w", "c", "lang"))
    doc = per.groupBy(key).agg(main.alias("m"), F.sort_array(F.collect_set(F.when(F.col("n") > 0, F.col("lang")))).alias("languages"))
    out = docs.select(key, label_language(F.col(label)).alias("label")).join(doc, key, "left")
    languages = F.coalesce("languages", F.array().cast("array<string>"))
    wrong = (F.size(languages) > 1) | ((F.size(languages) == 1) & ~F.get(languages, 0).eqNullSafe(F.col("label")))
    return out.select(key, "label", F.col("m.lang").alias("language"), languages.alias("languages"), F.col("m.c").alias("confidence"), wrong.alias("wrong"))
