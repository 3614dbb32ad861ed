"""Operator 1: toxicity by a gap-weighted subsequence string kernel, a Nyström map and a linear support vector machine.

The kernel of two strings sums, over all subsequences of four characters with gaps of up to two between neighbours, the
product of their weights ``decay ** (span - 4)``. It is taken between character windows of sentences and landmark words,
so an insult with foreign characters put in, or with its letters set apart, keeps many of its subsequences. The machine is
trained on labelled sentences. Its threshold is fixed: a window that resembles no landmark is at -1, the clean margin. After
training, the machine's score is linear in the subsequences of a window: weights of all landmarks fold into one table of
2**20 cells, which is the exact kernel sum, not an approximation of it. A text's score comes from its best window, and
from how many and how dense its windows past the threshold are.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import held_out, logistic, sigmoid, training_sample
from .textkernels import slices, utf8_parts

WINDOW = 14
DECAY = 0.7
GAPS = [(a, a + b, a + b + c) for a in range(1, 4) for b in range(1, 4) for c in range(1, 4)]
WEIGHTS = np.array([DECAY ** (g[2] - 3) for g in GAPS], np.float32)
SPAN = max(g[2] for g in GAPS)
CELLS = 1 << 20
#: Symbols: 0 space, 1 to 26 letters, 28 marks, 29 digits.
MARK, DIGIT = 28, 29
#: Spaces after each text, so that no window or subsequence joins two texts.
BORDER = SPAN + 1
#: Values of windows whose runs are counted.
LEVELS = (0.25, 0.75, 1.25)
#: Texts over so many bytes are read in parts of as many windows.
LONG = 4 << 20


def _alphabet() -> np.ndarray:
    """Symbols of the code points below 0x10000: letters without accents and in lower case; those of other scripts by a hash."""
    out = np.full(0x10000, MARK, np.uint8)
    for c in range(0x10000):
        ch = chr(c)
        if 0xD800 <= c < 0xE000:
            continue
        if c > 0x3400 and ch.isalpha():  # large scripts without case
            out[c] = 1 + c * 40503 % 65521 % 26
            continue
        base = unicodedata.normalize("NFKD", ch)[0].lower()[:1]
        if ch.isspace():
            out[c] = 0
        elif "a" <= base <= "z":
            out[c] = 1 + ord(base) - 97
        elif base.isalpha():
            out[c] = 1 + ord(base) * 40503 % 65521 % 26
        elif ch.isdigit():
            out[c] = DIGIT
    for ch, letter in zip("013457@$", "oieastas", strict=True):
        out[ord(ch)] = 1 + ord(letter) - 97
    return out


ALPHABET = _alphabet()


def symbols(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all characters of the texts, and offsets in characters."""
    lead = (data & 0xC0) != 0x80
    count = np.concatenate([[0], np.cumsum(lead)])
    at = np.flatnonzero(lead)
    b = data[at].astype(np.uint32)
    code = b.copy()
    last = len(data) - 1
    for low, high, more, mask in ((0xC0, 0xE0, 1, 0x1F), (0xE0, 0xF0, 2, 0x0F), (0xF0, 0x100, 3, 0x07)):
        sel = np.flatnonzero((b >= low) & (b < high))
        if len(sel):
            value = b[sel] & mask
            for k in range(1, more + 1):
                value = (value << 6) | (data[np.minimum(at[sel] + k, last)] & 0x3F)
            code[sel] = value
    out = ALPHABET[code & 0xFFFF]
    out[code > 0xFFFF] = MARK
    return out, count[offsets]


def subsequences(s: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each gap pattern, the codes of the subsequences that start at each position (shorter by the span)."""
    s = s.astype(np.uint32)
    s15, s10, s5 = s << 15, s << 10, s << 5
    for k, (a, b, c) in enumerate(GAPS):
        m = max(0, len(s) - c)
        yield k, s15[:m] | s10[a : a + m] | s5[b : b + m] | s[c : c + m]


def start_sums(s: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Weighted sum of table cells over the subsequences that start at each position."""
    out = np.zeros(len(s), np.float32)
    for k, code in subsequences(s):
        out[: len(code)] += table[code] * WEIGHTS[k]
    return out


def window_scores(s: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The machine's value of the window that starts at each position."""
    sums = np.concatenate([[0.0], np.cumsum(start_sums(s, table), dtype=np.float64)])
    end = np.repeat(offsets[1:], np.diff(offsets))
    return sums[np.minimum(np.arange(len(s)) + WINDOW - 3, end)] - sums[:-1] - 1.0


def _rises(value: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """For each level, where a run of windows past it begins; runs do not go on over the places ``first``."""
    out = []
    for level in LEVELS:
        past = value > level
        rise = past.copy()
        rise[1:] &= ~past[:-1]
        rise[first] = past[first]
        out.append(rise.astype(np.int64))
    return out


def window_facts(s: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Of each text: the largest window value, the length, and the runs of windows past each level."""
    n = len(offsets) - 1
    out = np.zeros((n, 2 + len(LEVELS)))
    out[:, 0] = -1.0
    out[:, 1] = np.maximum(np.diff(offsets) - 1 - BORDER, 0)
    full = np.flatnonzero(np.diff(offsets))
    if not len(full):
        return out
    value = window_scores(s, offsets, table)
    first = offsets[:-1][full]
    out[full, 0] = np.maximum.reduceat(value, first)
    for k, rise in enumerate(_rises(value, first)):
        out[full, 2 + k] = np.add.reduceat(rise, first)
    return out


def long_facts(b: np.ndarray, table: np.ndarray, step: int) -> np.ndarray:
    """window_facts() of one very long text, whose windows are read ``step`` at a time."""
    cuts = [0]
    while cuts[-1] < len(b):
        end = min(len(b), cuts[-1] + step)
        while end < len(b) and b[end] & 0xC0 == 0x80:
            end += 1
        cuts.append(end)
    s = np.concatenate([symbols(b[i:j], np.array([0, j - i]))[0] for i, j in zip(cuts, cuts[1:])])
    s, o = _guarded(s, np.array([0, len(s)]))
    out = np.array([-1.0, max(0, int(o[-1]) - 1 - BORDER), *[0] * len(LEVELS)])
    for at in range(0, len(s), step):
        low = max(0, at - 1)
        part = s[low : at + step + WINDOW + SPAN]
        value = window_scores(part, np.array([0, len(part)]), table)[: at + step - low]
        out[0] = max(out[0], value[at - low :].max())
        out[2:] += [rise[at - low :].sum() for rise in _rises(value, np.zeros(1, int))]
    return out


def phi(s: np.ndarray) -> Counter:
    """The string's weighted subsequences; those with more than one space tell nothing and are left out."""
    out: Counter = Counter()
    for k, code in subsequences(s):
        spaces = sum(((code >> shift) & 31) == 0 for shift in (0, 5, 10, 15))
        for c in code[spaces < 2].tolist():
            out[c] += float(WEIGHTS[k])
    return out


@dataclass
class ToxicityModel:
    """Cells of the folded kernel sum, and the calibration of a text's facts."""

    table: np.ndarray
    weights: np.ndarray

    def score(self, facts: np.ndarray) -> np.ndarray:
        return sigmoid(calibration_columns(facts) @ self.weights[:-1] + self.weights[-1])

    def facts(self, col: pa.Array, long: int = LONG) -> np.ndarray:
        """Facts of every text of an Arrow column; those of texts over ``long`` bytes in parts."""
        data, offsets = utf8_parts(col)
        out = np.zeros((len(col), 2 + len(LEVELS)))
        for i, j, b, o in slices(data, offsets):
            out[i:j] = window_facts(*_guarded(*symbols(b, o)), self.table) if len(b) <= long or j - i > 1 else long_facts(b, self.table, long)
        return out


def calibration_columns(facts: np.ndarray) -> np.ndarray:
    """The best window, and how dense the windows past each level are among the words."""
    words = np.maximum(facts[:, 1:2], 30.0) / 6
    return np.column_stack([np.clip(facts[:, 0], -1, 2.5), np.log(2e-3 + facts[:, 2:] / words) + 6])


def _coded(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return symbols(*utf8_parts(pa.array(texts, pa.large_string())))


def _guarded(s: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A space before and some after each text, so that words at its ends have borders and texts stay apart.

    Runs of marks and digits between two letters are left out, and so are the spaces of four single letters or more in a
    row: they set the letters of a word apart.
    """
    n = len(offsets) - 1
    pad = np.zeros(1 + BORDER, np.uint8)
    out = np.zeros(len(s) + (1 + BORDER) * n, np.uint8)
    if n == 1:
        out[1 : 1 + len(s)] = s
    elif n:
        inside = np.ones(len(out), bool)
        gaps = (offsets[:-1] + len(pad) * np.arange(n))[:, None]
        inside[gaps] = False
        inside[(offsets[1:] + len(pad) * np.arange(n))[:, None] + 1 + np.arange(BORDER)] = False
        out[inside] = s
    offsets = offsets + len(pad) * np.arange(n + 1)
    letter = (out >= 1) & (out < MARK)
    other = np.concatenate([[False], out >= MARK, [False]])
    edge = np.flatnonzero(other[1:] != other[:-1])
    start, end = edge[::2], edge[1::2]
    inner = letter[start - 1] & letter[np.minimum(end, len(out) - 1)] if len(start) else np.zeros(0, bool)
    gone = np.zeros(len(out) + 1, np.int8)
    gone[start[inner]] += 1
    gone[end[inner]] -= 1
    gone = np.cumsum(gone[:-1], dtype=np.int8) > 0
    if len(out) > 4:
        space = out == 0
        lone = np.zeros(len(out), bool)
        lone[1:-1] = letter[1:-1] & space[:-2] & space[2:]
        gap = np.flatnonzero(space[1:-1] & lone[:-2] & lone[2:]) + 1
        if len(gap):
            run = np.cumsum(np.concatenate([[0], np.diff(gap) != 2]))
            gone[gap[np.bincount(run)[run] >= 3]] = True
    if gone.any():
        out, offsets = out[~gone], np.concatenate([[0], np.cumsum(~gone)])[offsets]
    return out, offsets


def sentences(text: str) -> list[str]:
    return [x for x in re.split(r"(?<=[.!?])\s+|\n+", text) if x]


def _variants(word: str, r: np.random.Generator) -> list[str]:
    """The word with one foreign letter put in, four times, and with two, once."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    out = []
    for k in (1, 1, 1, 1, 2):
        w = list(word)
        for at in sorted(r.choice(len(word) - 1, min(k, len(word) - 1), replace=False) + 1, reverse=True):
            w.insert(int(at), letters[r.integers(26)])
        out.append("".join(w))
    return out


def fit_machine(texts: list[str], y: np.ndarray, landmarks: int, rounds: int, cost: float) -> np.ndarray:
    """The table of the support vector machine of labelled texts, cut into sentences.

    Landmarks are words: half of those most tied to the toxic label, half frequent ones; the machine is linear with squared
    hinge loss on the Nyström features of windows. The best sentence of each toxic text is toxic, and so are its others past
    the threshold; of clean texts, each one's best sentence and sentences at random are clean. They are chosen anew each
    round by the machine before. Tied words, and frequent ones on the clean side, also take part with letters put in.
    """
    table = np.zeros(CELLS, np.float32)
    seen = [Counter(), Counter()]
    for t, k in zip(texts, y, strict=True):
        seen[k].update({w.strip(".,;:!?\"'()").lower() for w in t.split()} - {""})
    n0, n1 = max(1, (y == 0).sum()), max(1, (y == 1).sum())
    tie = {w: np.log((seen[1][w] + 0.5) / n1) - np.log((seen[0][w] + 0.5) / n0) for w in seen[1]}
    worth = {w: tie[w] * np.sqrt(seen[1][w]) for w in tie if len(w) >= 3 and tie[w] > 1}
    bad = sorted(worth, key=lambda w: (-worth[w], w))[: landmarks // 2]
    chosen = set(bad)
    common = [w for w, _ in sorted((seen[0] + seen[1]).items(), key=lambda x: (-x[1], x[0])) if len(w) >= 3 and w not in chosen][: landmarks - len(bad)]
    marks = [phi(_guarded(*_coded([w]))[0]) for w in bad + common]
    norms = np.array([np.sqrt(sum(v * v for v in p.values())) or 1.0 for p in marks])
    cells = np.array(sorted(set().union(*marks)), np.int64)
    lines = [(k, x) for k, t in enumerate(texts) for x in sentences(t)]
    if not len(cells) or not lines:
        return table
    where = {c: i for i, c in enumerate(cells.tolist())}
    dense = np.zeros((len(cells) + 1, len(marks)), np.float32)
    for j, p in enumerate(marks):
        for c, v in p.items():
            dense[where[c], j] = v / norms[j]
    values, vectors = np.linalg.eigh((dense.T @ dense).astype(float))
    good = values > 1e-3 * values.max()
    whiten = vectors[:, good] / np.sqrt(values[good])
    slot = np.full(CELLS, len(cells), np.int32)
    slot[cells] = np.arange(len(cells))
    r = np.random.default_rng(11)
    known = len(lines)
    firm = [w for w in bad if seen[1][w] >= max(5, 0.02 * n1) and tie[w] > 3]
    extra = [(1, v) for w in firm for _ in range(3) for v in [w, *_variants(w, r)]] + [(0, v) for w in common[:100] for v in _variants(w, r)]
    owner = np.array([k for k, _ in lines])
    toxic = np.concatenate([y[owner] == 1, [k == 1 for k, _ in extra]])
    s, o = _guarded(*_coded([x for _, x in lines] + [x for _, x in extra]))

    def best_windows() -> tuple[np.ndarray, np.ndarray]:
        """The best value of each sentence and where its window starts, for about a million characters at a time."""
        top, at, i = [], [], 0
        while i < len(o) - 1:
            j = max(i + 1, int(np.searchsorted(o, o[i] + (1 << 20), "right")) - 1)
            cut = o[i : j + 1] - o[i]
            value = window_scores(s[o[i] : o[j]], cut, table)
            best = np.maximum.reduceat(value, cut[:-1])
            hit = np.flatnonzero(value == np.repeat(best, np.diff(cut)))
            at.append(o[i] + hit[np.searchsorted(hit, cut[:-1])])
            top.append(best)
            i = j
        return np.concatenate(top), np.concatenate(at)

    def kernel(starts: np.ndarray) -> np.ndarray:
        out = np.zeros((len(starts), len(marks)), np.float32)
        for k, (a, b, d) in enumerate(GAPS):
            for t in range(WINDOW - 3):
                p = np.minimum(starts + t, len(s) - 1 - d)
                x = s[p].astype(np.int32)
                place = slot[(x << 15) | (s[p + a].astype(np.int32) << 10) | (s[p + b].astype(np.int32) << 5) | s[p + d]]
                hit = np.flatnonzero(place < len(cells))
                out[hit] += dense[place[hit]] * WEIGHTS[k]
        return out

    free = np.flatnonzero(~toxic[:known])
    pool = [at_random(o, free, r), o[known:-1][~toxic[known:]]]
    positive = o[known:-1][toxic[known:]]  # the first toxic windows are the tied words themselves
    for turn in range(rounds):
        if turn:
            top, at = best_windows()
            order = np.lexsort((-top[:known], owner))
            chief = order[np.concatenate([[True], owner[order][1:] != owner[order][:-1]])]
            good_ones = np.flatnonzero(toxic & (top > 0))
            positive = np.unique(np.concatenate([at[good_ones], o[known:-1][toxic[known:]]]))
            pool += [at[chief[~toxic[chief]]], at[known:][~toxic[known:]]]
        negative = np.unique(np.concatenate(pool))
        if not len(positive) or not len(negative):
            return table
        where_ = np.concatenate([positive, negative])
        target = np.concatenate([np.ones(len(positive)), -np.ones(len(negative))])
        z = kernel(where_) @ whiten
        weight = np.where(target > 0, 0.5 / len(positive), 0.5 / len(negative)) * len(where_) * cost
        w = np.zeros(z.shape[1])
        for _ in range(25):  # Newton steps of the squared hinge, with the threshold fixed at -1
            active = target * (z @ w - 1) < 1
            za = z[active] * weight[active, None]
            step = np.linalg.solve(za.T @ z[active] + np.eye(len(w)), za.T @ (target[active] + 1)) - w
            w += step
            if np.abs(step).max() < 1e-5:
                break
        table = np.zeros(CELLS, np.float32)
        table[cells] = dense[:-1] @ (whiten @ w).astype(np.float32)
    return table


def at_random(o: np.ndarray, rows: np.ndarray, r: np.random.Generator, n: int = 3000) -> np.ndarray:
    """Places in the given rows of text, each place as likely."""
    if not len(rows):
        return np.zeros(0, np.int64)
    size = np.diff(o)[rows]
    row = rows[np.searchsorted(np.cumsum(size), r.integers(0, size.sum(), n), "right")]
    return o[row] + r.integers(0, 1 << 40, n) % np.diff(o)[row]


def fit_toxicity(texts: list[str | None], y: np.ndarray, landmarks: int = 200, rounds: int = 3, cost: float = 1.0, folds: int = 2) -> ToxicityModel:
    """Train on labelled texts. The calibration learns from the scores of texts that their machine has not seen.

    Without labels of both classes, or without a word of three characters, the score is one constant.
    """
    texts, y = [t or "" for t in texts], np.asarray(y, int)
    share = (y.sum() + 1) / (len(y) + 2)
    constant = ToxicityModel(np.zeros(CELLS, np.float32), np.append(np.zeros(1 + len(LEVELS)), np.log(share / (1 - share))))
    if len(y) == 0 or y.min() == y.max():
        return constant
    table = fit_machine(texts, y, landmarks, rounds, cost)
    if not table.any():
        return constant
    fold = np.zeros(len(y), int)
    for k in (0, 1):
        fold[y == k] = np.arange((y == k).sum()) % folds
    facts = np.zeros((len(y), 2 + len(LEVELS)))
    for f in range(folds):
        seen = fold != f
        part = fit_machine([t for t, ok in zip(texts, seen) if ok], y[seen], landmarks, rounds, cost) if len(set(y[seen])) == 2 else table
        facts[~seen] = ToxicityModel(part, constant.weights).facts(pa.array([t for t, ok in zip(texts, seen) if not ok], pa.large_string()))
    # balanced classes, as scores are to be cut at one half
    weight = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum()) * len(y)
    return ToxicityModel(table, logistic(calibration_columns(facts), y.astype(float), 1e-1, weight, 30))


def toxicity_scores(docs: DataFrame, model: ToxicityModel, as_name: str = "score") -> DataFrame:
    """doc_id and the toxicity of each row's whole text, 0 to 1. Null and empty texts get the score of no window at all."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = shared.value.score(shared.value.facts(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], ["doc_id", as_name])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id long, {as_name} double")


def score_toxicity(docs: DataFrame, labels: DataFrame, per_class: int = 1500, longest: int = 1 << 16, seed: int = 5) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of (doc_id, text, ...).

    Learnt from a sample of at most ``per_class`` labelled texts of each class, of at most ``longest`` bytes each, that are
    not held out (documents without such labels get one constant score; a document labelled both ways is not learnt from).
    Only texts are inputs of a score. Repeated rows and equal texts score alike; an empty table gives an empty table; other
    columns are ignored.
    """
    sample = training_sample(docs, labels, "toxic", per_class, seed, ["text"], longest)
    model = fit_toxicity(sample["text"].fillna("").tolist(), sample["y"].to_numpy(int))
    out = toxicity_scores(docs, model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
