"""Language identification: script ranges narrow the candidates, Viterbi over words labels the spans.

A word is a run of ASCII letters and bytes outside ASCII. Its script, by code point ranges, leaves only the languages
that were learned with that script. Its score in a language sums log-probabilities of hashed byte n-grams. Viterbi
picks the best language of every word, with a penalty for each switch, so a mixed text falls into spans. The
language of the text is the one whose spans hold most letters.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgetide.llm import textkit
from edgetide.llm.neardup import portions
from edgetide.llm.runtime import bounded_sample, prepare

#: Labelled documents that a model is learned from at most (about; chosen by a hash of doc_id).
TRAIN_ROWS = 8_000
BITS = 16
ORDERS = (1, 2, 3, 4)
SWITCH = 8.0
#: Texts of more words are decoded in windows of so many.
WINDOW = 1 << 16
#: A language is a candidate in a script that holds at least this share of its words.
SCRIPT_SHARE = 0.002
# First code points of script ranges of the Unicode standard, and a number for each script. 0: none.
_RANGES = ((0x00, 0), (0x41, 1), (0x5B, 0), (0x61, 1), (0x7B, 0), (0xAA, 1), (0xAB, 0), (0xB5, 2), (0xB6, 0), (0xBA, 1), (0xBB, 0), (0xC0, 1), (0xD7, 0), (0xD8, 1), (0xF7, 0), (0xF8, 1), (0x2B0, 0), (0x370, 2), (0x400, 3), (0x530, 4), (0x590, 5), (0x600, 6), (0x700, 7), (0x900, 8), (0x980, 9), (0xA00, 10), (0xB00, 11), (0xB80, 12), (0xC00, 13), (0xC80, 14), (0xD00, 15), (0xD80, 16), (0xE00, 17), (0xE80, 18), (0xF00, 19), (0x1000, 20), (0x10A0, 21), (0x1100, 22), (0x1200, 23), (0x13A0, 24), (0x1780, 25), (0x1800, 26), (0x1E00, 1), (0x1F00, 2), (0x2000, 0), (0x3040, 27), (0x30A0, 27), (0x3100, 28), (0x3130, 22), (0x3400, 28), (0xA000, 24), (0xAC00, 22), (0xD7B0, 0), (0xF900, 28), (0xFB00, 1), (0xFB50, 6), (0xFE00, 0), (0x20000, 28), (0x32000, 0))
_FIRST = np.array([r[0] for r in _RANGES])
_SCRIPT = np.array([r[1] for r in _RANGES])
SCRIPTS = int(_SCRIPT.max()) + 1
_U = np.uint64


def scripts(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Script of each word: the highest-numbered one of its characters, which for Latin with marks is Latin."""
    if not len(begin):
        return np.zeros(0, np.int64)
    lo, hi = int(begin[0]), int(end[-1])
    x = np.r_[data[lo:hi], np.zeros(3, np.uint8)].astype(np.int32)
    a, b, c, d = x[:-3], x[1:-2], x[2:-1], x[3:]
    point = np.where(a < 0x80, a, np.where(a >= 0xF0, (a & 7) << 18 | (b & 63) << 12 | (c & 63) << 6 | d & 63, np.where(a >= 0xE0, (a & 15) << 12 | (b & 63) << 6 | c & 63, (a & 31) << 6 | b & 63)))
    of = _SCRIPT[np.searchsorted(_FIRST, point, side="right") - 1]
    of[(a & 0xC0) == 0x80] = 0
    edges = np.stack([begin - lo, end - lo], axis=1).ravel()
    if edges[-1] == len(of):
        edges = edges[:-1]
    return np.maximum.reduceat(of, edges)[::2]


def grams(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(word, coordinate) of the byte n-grams of each word with a boundary on both sides, one order at a time."""
    n = end - begin + 2
    index, at = textkit.runs(begin - 1, n)
    word = np.repeat(np.arange(len(n)), n)
    x = textkit.LOWER[data[np.clip(index, 0, len(data) - 1)]].astype(np.uint64)
    x[at[:-1]] = x[at[1:] - 1] = 0
    for k in ORDERS:
        if len(x) < k:
            continue
        h = np.full(len(x) - k + 1, _U(k * 0x1F123BB5))
        for j in range(k):
            h = (h ^ x[j : j + len(h)]) * _U(0x9E3779B97F4A7C15)
            h ^= h >> _U(29)
        same = np.flatnonzero(word[: len(h)] == word[k - 1 :])
        yield word[same], (h[same] >> _U(32) & _U((1 << BITS) - 1)).astype(np.int64)


@dataclass(frozen=True)
class Model:
    """languages; log-probability of a coordinate by language (and the smoothing already in it); which scripts each has."""

    languages: tuple[str, ...]
    table: np.ndarray
    allowed: np.ndarray


def fit(texts: list[bytes], langs: list[str]) -> Model:
    names = tuple(sorted(set(langs)))
    counts, script = np.zeros((1 << BITS, len(names))), np.zeros((SCRIPTS, len(names)))
    for code, name in enumerate(names):
        for text in (t for t, l in zip(texts, langs) if l == name):
            data = np.frombuffer(b" " + text + b" ", np.uint8)
            _, _, _, begin, end = textkit.words(data, np.array([0]), np.array([len(data)]), textkit.ALPHA, places=True)
            if len(begin):
                script[:, code] += np.bincount(scripts(data, begin, end), minlength=SCRIPTS)
                for _, at in grams(data, begin, end):
                    np.add.at(counts[:, code], at, 1)
    return finish(names, counts, script)


def finish(names: tuple[str, ...], counts: np.ndarray, script: np.ndarray) -> Model:
    if not names:
        return Model(names, counts.astype(np.float32), script > 0)
    total = counts.sum(axis=0, keepdims=True)
    p = (counts + 0.5) / (total + 0.5 * (1 << BITS))
    # against the mean over languages: a gram that says nothing scores nothing, and one gram alone can't decide
    table = np.clip(np.log(p) - np.log(p).mean(axis=1, keepdims=True), -4, 4)
    table[counts.sum(axis=1) < 3] = 0
    allowed = script >= SCRIPT_SHARE * np.maximum(script.sum(axis=0, keepdims=True), 1)
    return Model(names, table.astype(np.float32), allowed & (script > 0))


def word_scores(model: Model, data: np.ndarray, begin: np.ndarray, end: np.ndarray, slab: int = 1 << 15) -> np.ndarray:
    """words x languages. A word whose script no language has, or that has no script, scores nothing."""
    out = np.zeros((len(begin), len(model.languages)), np.float32)
    for a in range(0, len(begin), slab):
        b, e = begin[a : a + slab], end[a : a + slab]
        o = out[a : a + slab]
        for word, at in grams(data, b, e):
            if len(word):
                first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
                o[word[first]] += np.add.reduceat(model.table[at], first, axis=0)
        o /= len(ORDERS) / 2
        ok = model.allowed[scripts(data, b, e)]
        none = ~ok.any(axis=1)
        o[~ok] = -30
        o[none] = 0
    return out


def viterbi(score: np.ndarray, low: np.ndarray, high: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Best language of every word; texts are ranges [low, high) of the words. All texts advance together."""
    label = np.zeros(len(score), np.int16)
    n = high - low
    order = np.argsort(-n, kind="stable")
    start, length = low[order], n[order]
    if not len(length) or not length[0]:
        return label
    v, come, alive = forward(score, start, length, np.zeros((len(length), score.shape[1]), np.float32), switch)
    last = v.argmax(axis=1)
    for t in range(int(length[0]) - 1, -1, -1):
        k = alive[t]
        at = start[:k] + t
        label[at] = last[:k]
        back = come[at, last[:k]]
        last[:k] = np.where(back >= 0, back, last[:k])
    return label


def forward(score: np.ndarray, start: np.ndarray, length: np.ndarray, v: np.ndarray, switch: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best sums at the end of each text; for each word the language before it where that is another (else -1); and how
    many texts, longest first, have a word at each step."""
    steps = int(length[0])
    alive = np.searchsorted(-length, -np.arange(steps), side="left")
    come = np.full(score.shape, -1, np.int16)
    for t in range(steps):
        k = alive[t]
        at = start[:k] + t
        best = v[:k].argmax(axis=1)
        jump = v[np.arange(k), best] - switch
        take = jump[:, None] > v[:k]
        if take.any():
            come[at] = np.where(take, best[:, None], -1)
            v[:k] = np.where(take, jump[:, None], v[:k])
        v[:k] += score[at]
        if t % 256 == 255:
            v[:k] -= v[:k].max(axis=1, keepdims=True)
    return v, come, alive


def viterbi_windows(scores, n: int, languages: int, window: int = 0, switch: float = SWITCH) -> np.ndarray:
    """The same for one long text of n words, whose scores(a, b) are worked out a window at a time.

    Where every other language comes from one and the same, all paths before that word end in it, whatever follows: the
    words before are settled, and the next window begins there, all others ``switch`` behind. A window without such a
    word is made longer.
    """
    label, at, width = np.zeros(n, np.int16), 0, window or WINDOW
    v = np.zeros((1, languages), np.float32)
    while at < n:
        to = min(n, at + width)
        end, come, _ = forward(scores(at, to), np.zeros(1, np.int64), np.array([to - at]), v.copy(), switch)
        stop, last = to - at, int(end[0].argmax())
        if to < n:
            one = (come >= 0).sum(axis=1) == languages - 1
            one[0] = False
            joined = np.flatnonzero(one) if languages > 1 else np.arange(1, stop)
            if not len(joined):
                width *= 2
                continue
            stop = int(joined[-1])
            last = int(np.flatnonzero(come[stop] < 0)[0])
            v = np.full((1, languages), -switch, np.float32)
            v[0, last] = 0
        for t in range(stop - 1, -1, -1):
            label[at + t] = last
            if come[t, last] >= 0:
                last = int(come[t, last])
        at, width = at + stop, window or WINDOW
    return label


def _tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts by language: coordinates, and scripts as coordinates after them."""
    held: dict[str, np.ndarray] = {}
    for batch in batches:
        data, starts, ends = textkit.view(batch.column("text"))
        lang = np.array(batch.column("lang").to_pylist(), object)
        for lo, hi in portions(starts, ends, 1 << 19):
            _, low, high, begin, end = textkit.words(data, starts[lo:hi], ends[lo:hi], textkit.ALPHA, places=True)
            if not len(begin):
                continue
            owner = np.repeat(np.arange(lo, hi), high - low)
            by_word = lang[owner]
            script = scripts(data, begin, end)
            all_grams = [*grams(data, begin, end)]
            for name in np.unique(by_word.astype(str)):
                mine = by_word == name
                c = held.setdefault(name, np.zeros((1 << BITS) + SCRIPTS))
                c[1 << BITS :] += np.bincount(script[mine], minlength=SCRIPTS)
                for word, at in all_grams:
                    c[: 1 << BITS] += np.bincount(at[mine[word]], minlength=1 << BITS)
    for name, c in held.items():
        at = np.flatnonzero(c)
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(at)), pa.array(at), pa.array(c[at].astype(np.int64))], names=["lang", "at", "n"])


def train(docs: DataFrame, bound: int = TRAIN_ROWS) -> Model:
    """Learn from docs (doc_id, text, lang): rows with a lang, a text and a doc_id, about ``bound`` of them at most.

    The model's size follows from the number of languages, at 2**BITS numbers each. No row gives a model of no language.
    """
    prepare(docs.sparkSession)
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "text", "lang")
    chosen = bounded_sample(known, "doc_id", bound, 1)
    # the sample is bounded, so a fixed number of tasks counts it
    counts = chosen.select("text", "lang").repartition(8).mapInArrow(_tables, "lang string, at long, n long").groupBy("lang", "at").agg(F.sum("n").alias("n"))
    got = counts.toArrow()
    lang, at, n = np.array(got.column("lang").to_pylist(), object), got.column("at").to_numpy(), got.column("n").to_numpy()
    names = tuple(sorted(set(lang)))
    table = np.zeros(((1 << BITS) + SCRIPTS, len(names)))
    for i, name in enumerate(names):
        table[at[lang == name], i] = n[lang == name]
    return finish(names, table[: 1 << BITS], table[1 << BITS :])


def _has_letter(data: np.ndarray, start: int, end: int) -> bool:
    x = data[start:end]
    if (textkit.ALPHA[x] & (x < 128)).any():
        return True
    return any(c.isalpha() for c in data[start:end].tobytes().decode("utf-8", "replace"))


def _detect(shared, spans: bool):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        names, width = model.languages, max(1, len(model.languages))

        def labelled(data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
            """Language, share of letters and spans of each text of a portion."""
            _, low, high, begin, end = textkit.words(data, starts, ends, textkit.ALPHA, places=True)
            if not names:
                label = np.zeros(len(begin), np.int16)
            elif len(starts) == 1 and len(begin) > WINDOW:
                label = viterbi_windows(lambda a, b: word_scores(model, data, begin[a:b], end[a:b]), len(begin), width)
            else:
                label = viterbi(word_scores(model, data, begin, end), low, high)
            # letters are code points: bytes that don't continue one
            if len(begin):
                first, past = int(begin[0]), int(end[-1])
                upto = np.r_[0, np.cumsum((data[first:past] & 0xC0) != 0x80)]
                letters = upto[end - first] - upto[begin - first]
            else:
                letters = np.zeros(0, np.int64)
            row = np.repeat(np.arange(len(starts)), high - low)
            votes = np.bincount(row * width + label, letters, minlength=len(starts) * width).reshape(len(starts), width)
            best, share = votes.argmax(axis=1), votes.max(axis=1) / np.maximum(votes.sum(axis=1), 1)
            clear = [bool(names) and high[i] > low[i] and _has_letter(data, int(starts[i]), int(ends[i])) for i in range(len(starts))]
            found = []
            for i in range(len(starts) if spans else 0):
                here = label[low[i] : high[i]]
                cut = np.flatnonzero(np.r_[True, here[1:] != here[:-1]]) if len(here) and clear[i] else np.zeros(0, int)
                stop = np.r_[cut[1:], len(here)] if len(cut) else cut
                found.append([{"start": int(begin[low[i] + a] - starts[i]), "end": int(end[low[i] + b - 1] - starts[i]), "lang": names[here[a]]} for a, b in zip(cut, stop)])
            return [names[b] if c else "und" for b, c in zip(best, clear)], np.where(clear, share, 0.0), found

        for batch in batches:
            data, starts, ends = textkit.view(batch.column("text"))
            langs, shares, found = [], [np.zeros(0)], []
            for lo, hi in portions(starts, ends, 8 << 20):
                a, b, c = labelled(data, starts[lo:hi], ends[lo:hi])
                langs += a
                shares.append(b)
                found += c
            out, columns = [*batch.columns, pa.array(langs, pa.string()), pa.array(np.concatenate(shares))], [*batch.schema.names, "lang_pred", "lang_score"]
            if spans:
                out.append(pa.array(found, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))))
                columns.append("spans")
            yield pa.RecordBatch.from_arrays(out, names=columns)

    return each


def detect(docs: DataFrame, model: Model, spans: bool = False) -> DataFrame:
    """docs (text and any columns) with lang_pred, lang_score and, if asked, spans (byte start, byte end, lang) added.

    The whole text is labelled, a long one a window of words at a time with the same result. Columns of docs called
    lang_pred, lang_score or spans are replaced. Rows are handled one by one: repeated rows get the same result, and an
    empty table gives an empty one. lang_pred is ``und`` with score 0 where the text is null or has no letter, and where the
    model has no language; else a language of the model, ties going to the first by name. lang_score is the
    share of letters (code points) in spans of that language.
    """
    spark = prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)
    docs = docs.drop("lang_pred", "lang_score", "spans")
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    kind += ", lang_pred string, lang_score double" + (", spans array<struct<start: bigint, end: bigint, lang: string>>" if spans else "")
    return docs.mapInArrow(_detect(shared, spans), kind)
