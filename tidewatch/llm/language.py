"""Language of texts, and of the spans of mixed texts.

Learning counts, per language, hashed character n-grams of all words of all given
texts, and the scripts their letters belong to. A word is a run of letters; its
score in a language is the sum over its n-grams of the log probability there,
relative to the mean over languages, held between two bounds.

A word's script narrows its candidates to the languages that use that script; the
others get the lowest score. The labels of a text's words are the best path through
all scores where every change of language costs a penalty (Viterbi). Where no other
language gains more than the penalty over any stretch of words, the path is constant,
which is seen from running sums alone; other texts are walked word by word, many
texts at a time.

The model has a fixed number of buckets for each language, so its size does not
depend on the corpus. Null texts and those without a letter get ``und`` with score 0
and no spans; so does everything where nothing was learned. A text whose words fit
all languages equally gets the first by name. Repeated rows are labelled each for
itself.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.llm.common import col, slices, with_columns

UND = "und"
BUCKETS = 1 << 16
BLOCK = 4096
SIZES = (1, 2, 3, 4)
LEAST_SHARE = 0.001
#: Bounds of a word's score, and the cost of a change of language, in nats.
BOUND, PENALTY = 6.0, 9.0
REMEMBERED = 400_000
#: Words, of all languages together, that a task counts before they are added up.
HELD = 200_000
#: Characters of words whose n-grams are held at a time.
PART_CHARS = 200_000
WORD = re.compile(r"[^\W\d_]+")

# First code points of script ranges, in order; "" is no script of its own. Fixed values of the standard.
SCRIPTS = [
    (0x0000, ""), (0x0041, "latin"), (0x005B, ""), (0x0061, "latin"), (0x007B, ""), (0x00AA, "latin"), (0x00AB, ""),
    (0x00BA, "latin"), (0x00BB, ""), (0x00C0, "latin"), (0x0250, ""), (0x0370, "greek"), (0x0400, "cyrillic"),
    (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0700, ""), (0x0750, "arabic"), (0x0780, ""),
    (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "gurmukhi"), (0x0A80, "gujarati"), (0x0B00, ""),
    (0x0B80, "tamil"), (0x0C00, "telugu"), (0x0C80, "kannada"), (0x0D00, "malayalam"), (0x0D80, "sinhala"),
    (0x0E00, "thai"), (0x0E80, "lao"), (0x0F00, "tibetan"), (0x1000, "myanmar"), (0x10A0, "georgian"),
    (0x1100, "hangul"), (0x1200, "ethiopic"), (0x13A0, ""), (0x1780, "khmer"), (0x1800, ""), (0x1C80, "cyrillic"),
    (0x1C90, "georgian"), (0x1CC0, ""), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, ""), (0x2C60, "latin"),
    (0x2C80, ""), (0x2DE0, "cyrillic"), (0x2E00, ""), (0x3040, "hiragana"), (0x30A0, "katakana"), (0x3100, ""),
    (0x3130, "hangul"), (0x3190, ""), (0x31F0, "katakana"), (0x3200, ""), (0x3400, "han"), (0xA000, ""),
    (0xA640, "cyrillic"), (0xA6A0, ""), (0xA720, "latin"), (0xA800, ""), (0xAC00, "hangul"), (0xD7B0, ""),
    (0xF900, "han"), (0xFB00, "latin"), (0xFB07, ""), (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFE00, ""),
    (0xFE70, "arabic"), (0xFF00, ""), (0xFF21, "latin"), (0xFF3B, ""), (0xFF41, "latin"), (0xFF5B, ""),
    (0xFF66, "katakana"), (0xFFA0, "hangul"), (0xFFE0, ""), (0x20000, "han"), (0x32000, ""),
]
NAMES = sorted({s for _, s in SCRIPTS})
FIRST = np.array([c for c, _ in SCRIPTS])
SCRIPT_OF = np.array([NAMES.index(s) for _, s in SCRIPTS])
OTHER = NAMES.index("")
STEP = np.uint64(0x9E3779B97F4A7C15)


def word_parts(words: list[str]) -> Iterator[slice]:
    """Places in the list, cut so that a part has a bounded number of characters (a longer word is a part)."""
    begin = size = 0
    for i, w in enumerate(words):
        if i > begin and size + len(w) > PART_CHARS:
            yield slice(begin, i)
            begin, size = i, 0
        size += len(w) + 1
    if begin < len(words):
        yield slice(begin, len(words))


def features(words: list[str], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word number, bucket) of every n-gram, a space marking both ends; and each word's script."""
    codes = np.frombuffer((" " + " ".join(words) + " ").encode("utf-32-le"), np.uint32).astype(np.uint64)
    space = codes == 32
    owner = np.cumsum(space) - 1
    at, found = [], []
    rolled = np.zeros(len(codes), np.uint64)
    inner = np.cumsum(space)
    for n in range(1, max(SIZES) + 1):
        size = len(codes) - n + 1
        if size <= 0:
            break
        rolled = (rolled[:size] ^ codes[n - 1 :]) * STEP
        rolled ^= rolled >> np.uint64(29)
        if n not in SIZES:
            continue
        if n == 1:
            ok, first = ~space, owner
        else:
            # spaces only as first or last character
            middle = inner[n - 2 : n - 2 + size] - inner[:size] if n > 2 else np.zeros(size, np.int64)
            ok = (middle == 0) & ~(space[:size] & space[n - 1 :])
            first = np.where(space[:size], owner[:size], owner[:size])
        at.append(first[:size][ok])
        found.append(((rolled[ok] * STEP) >> np.uint64(32)) % np.uint64(buckets))
    kinds = SCRIPT_OF[np.searchsorted(FIRST, codes, side="right") - 1]
    # a word's script is that of its first letter that has one
    script = np.full(len(words), OTHER)
    known = np.flatnonzero(~space & (kinds != OTHER))[::-1]
    script[owner[known]] = kinds[known]
    return np.concatenate(at), np.concatenate(found).astype(np.int64), script


@dataclass
class Model:
    """Languages by name; counts [language, bucket] as scores; which scripts each uses."""

    languages: list[str]
    scores: np.ndarray
    scripts: np.ndarray

    @classmethod
    def of_counts(cls, languages: list[str], counts: np.ndarray, scripts: np.ndarray) -> Model:
        if not languages:
            return cls([], np.zeros((0, BUCKETS), np.float32), np.zeros((0, len(NAMES)), bool))
        logs = np.log((counts + 0.5) / (counts + 0.5).sum(axis=1, keepdims=True))
        used = scripts >= LEAST_SHARE * np.maximum(scripts.sum(axis=1, keepdims=True), 1)
        return cls(languages, (logs - logs.mean(axis=0)).astype(np.float32), used & (scripts > 0))

    def word_scores(self, words: list[str]) -> np.ndarray:
        """[word, language]"""
        return np.concatenate([self._scores(words[p]) for p in word_parts(words)])

    def _scores(self, words: list[str]) -> np.ndarray:
        owner, bucket, script = features(words, self.scores.shape[1])
        out = np.stack([np.bincount(owner, s[bucket], len(words)) for s in self.scores], axis=1)
        out = np.clip(out, -BOUND, BOUND)
        fits = self.scripts[:, script].T
        return np.where(fits | ~fits.any(axis=1, keepdims=True), out, -BOUND)


def too_many(words: dict[str, Counter]) -> bool:
    """Whether the counted words of all languages together are more than a task holds."""
    return sum(map(len, words.values())) > HELD


def learn(docs: DataFrame, label: str = "lang", text: str = "text", buckets: int = BUCKETS) -> Model:
    """The model of all texts with a label; labels are few, as languages are.

    Each task counts distinct words by language, turns them into buckets, and gives its
    sums in blocks, which are added by block; the driver gets the sums of the buckets.
    """
    read = docs.select(col(label).alias("label"), col(text).alias("text")).where("label is not null and text is not null")
    blocks = -(-buckets // BLOCK)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        words: dict[str, Counter] = {}

        def add(lang: str) -> None:
            own = words.pop(lang)
            if not own:
                return
            total = sums.setdefault(lang, np.zeros(blocks * BLOCK + len(NAMES), np.float64))
            listed, n = list(own), np.array(list(own.values()), np.float64)
            for p in word_parts(listed):
                owner, bucket, script = features(listed[p], buckets)
                np.add.at(total, bucket, n[p][owner])
                total[blocks * BLOCK :] += np.bincount(script, n[p], len(NAMES))

        for batch in batches:
            for part in slices(batch, "text"):
                for lang, t in zip(part.column("label").to_pylist(), part.column("text").to_pylist()):
                    words.setdefault(lang, Counter()).update(WORD.findall(t.lower()))
                if too_many(words):
                    for lang in list(words):
                        add(lang)
        for lang in list(words):
            add(lang)
        rows = [
            (lang, b, (total[b * BLOCK : (b + 1) * BLOCK] if b < blocks else total[blocks * BLOCK :]).tobytes())
            for lang, total in sums.items() for b in range(blocks + 1)
        ]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names=names)

    names, kinds = ["label", "block", "sums"], [pa.string(), pa.int32(), pa.binary()]

    def add_up(key, group):
        total = sum(np.frombuffer(x, np.float64) for x in group.column("sums").to_pylist())
        values = [[key[0].as_py()], [key[1].as_py()], [total.tobytes()]]
        return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(values, kinds)], names=names)

    schema = "label string, block int, sums binary"
    rows = read.mapInArrow(count, schema).groupBy("label", "block").applyInArrow(add_up, schema).collect()
    languages = sorted({r.label for r in rows})
    counts, scripts = np.zeros((len(languages), blocks * BLOCK)), np.zeros((len(languages), len(NAMES)))
    for r in rows:
        part, i = np.frombuffer(r.sums, np.float64), languages.index(r.label)
        if r.block < blocks:
            counts[i, r.block * BLOCK : (r.block + 1) * BLOCK] = part
        else:
            scripts[i] = part
    return Model.of_counts(languages, counts[:, :buckets], scripts)


def constant_path(scores: np.ndarray, penalty: float) -> int | None:
    """The language of all words, if a path that stays there beats all others for sure."""
    total = scores.sum(axis=0)
    best = int(total.argmax())
    # what each language gains over the best one, and the most it gains over any stretch
    gain = np.cumsum(scores - scores[:, best : best + 1], axis=0)
    low = np.minimum.accumulate(np.vstack([np.zeros((1, gain.shape[1])), gain[:-1]]), axis=0)
    most = (gain - low).max(axis=0)
    return best if (most <= penalty).all() else None


def viterbi(scores: list[np.ndarray], penalty: float) -> list[np.ndarray]:
    """The best path of every text, all texts walked at once; ties go to the first language."""
    order = sorted(range(len(scores)), key=lambda i: -len(scores[i]))
    sizes = np.array([len(scores[i]) for i in order])
    k = scores[0].shape[1]
    begins = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    flat = np.concatenate([scores[i] for i in order])
    came = np.zeros((len(flat), k), np.int16)
    best = flat[begins].astype(np.float64)
    live = len(order)
    finals = np.zeros(len(order), np.int64)
    for t in range(1, sizes[0] + 1):
        still = int(np.searchsorted(-sizes, -t, side="left"))  # texts longer than t
        if still < live:
            finals[still:live] = best[still:live].argmax(axis=1)
            live = still
        if not live:
            break
        rows = begins[:live] + t
        top = best[:live].argmax(axis=1)
        jump = best[np.arange(live), top] - penalty
        move = jump[:, None] > best[:live]
        came[rows] = np.where(move, top[:, None], np.arange(k))
        best[:live] = np.where(move, jump[:, None], best[:live]) + flat[rows]
    paths = [None] * len(order)
    for x, i in enumerate(order):
        path, at = np.zeros(sizes[x], np.int64), finals[x]
        steps = came[begins[x] : begins[x] + sizes[x]].tolist()
        for t in range(sizes[x] - 1, -1, -1):
            path[t] = at
            at = steps[t][at]
        paths[i] = path
    return paths


SPAN = T.ArrayType(T.StructType([
    T.StructField("first", T.IntegerType()), T.StructField("words", T.IntegerType()), T.StructField("lang", T.StringType()),
]))


def label(
    docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None, penalty: float = PENALTY,
    names: tuple[str, str, str] = ("lang_pred", "score", "spans"),
) -> DataFrame:
    """The kept columns, ``lang_pred``, ``score`` and ``spans`` (first word, words, language) of every text.

    ``lang_pred`` has the most letters in the labelled spans; ``score`` is its share of
    them.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        model = shared.value
        known: dict[str, int] = {}
        table = [np.zeros((0, max(len(model.languages), 1)), np.float32)]
        letters = [np.zeros(0)]

        def learn_words(new: list[str]) -> None:
            real = [w for w in new if any(map(str.isalpha, w))]
            known.update((w, -1) for w in new)
            if real and model.languages:
                begin = len(table[0])
                known.update(zip(real, range(begin, begin + len(real))))
                table[0] = np.concatenate([table[0], model.word_scores(real).astype(np.float32)])
                letters[0] = np.concatenate([letters[0], [len(w) for w in real]])

        def work(texts):
            if len(known) > REMEMBERED:
                known.clear()
                table[0], letters[0] = table[0][:0], letters[0][:0]
            split = [WORD.findall(t.lower()) if t else [] for t in texts]
            learn_words(list(set().union(*split).difference(known)))
            places = [np.array([known[w] for w in words], np.int64) for words in split]
            places = [p[p >= 0] for p in places]
            scores = [table[0][p] for p in places]
            paths, mixed = [None] * len(texts), []
            for i, s in enumerate(scores):
                if len(s):
                    one = constant_path(s.astype(np.float64), penalty)
                    if one is None:
                        mixed.append(i)
                    else:
                        paths[i] = one
            if mixed:
                for i, path in zip(mixed, viterbi([scores[i] for i in mixed], penalty)):
                    paths[i] = path
            langs, shares, spans = [], [], []
            for p, path in zip(places, paths):
                if path is None:
                    langs.append(UND), shares.append(0.0), spans.append([])
                elif isinstance(path, int):
                    langs.append(model.languages[path]), shares.append(1.0)
                    spans.append([{"first": 0, "words": len(p), "lang": model.languages[path]}])
                else:
                    mass = np.bincount(path, letters[0][p], len(model.languages))
                    cuts = np.concatenate([[0], np.flatnonzero(np.diff(path)) + 1, [len(path)]])
                    langs.append(model.languages[int(mass.argmax())]), shares.append(float(mass.max() / mass.sum()))
                    spans.append([
                        {"first": int(a), "words": int(b - a), "lang": model.languages[path[a]]}
                        for a, b in zip(cuts[:-1], cuts[1:])
                    ])
            return langs, shares, spans

        return work

    fields = list(zip(names, (T.StringType(), T.DoubleType(), SPAN)))
    return with_columns(docs, make, fields, text, keep)


def held_out(doc_id: str = "doc_id"):
    """Whether a document is kept from learning: the checksum of its id as text leaves 2 by 4."""
    return F.coalesce(F.crc32(col(doc_id).cast("string")) % 4 == 2, F.lit(False))
