"""Quality rules: countable rules, then a hashed n-gram logistic regression trained on labelled rows."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import give_back, joined, lean, mix, pieces_of, rolling, whole_row, word_hashes, word_spans

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: fixed value: the characters the symbol rule counts
SYMBOLS = b"#*$%&|<>"

DIMENSIONS = 1 << 16
CHAR_N = 3
#: at most so many labelled rows train the model, and so many calibrate it
TRAIN_ROWS = 6000
CALIBRATION_ROWS = 2000
#: a document is kept from this calibrated probability of good quality on
KEEP_AT = 0.5

_CHAR, _WORD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


@dataclass(frozen=True)
class QualityModel:
    """Weights of hashed n-grams and the two calibration parameters: P(good) = 1 / (1 + exp(-(slope * score + shift)))."""

    weights: np.ndarray
    slope: float
    shift: float


def _per_row(values: np.ndarray, places: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of `values`, found at byte `places` in ascending order, over the rows that `offsets` bound."""
    total = np.zeros(len(values) + 1, np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    cuts = np.searchsorted(places, offsets)
    return total[cuts[1:]] - total[cuts[:-1]]


def _char_slots(data: np.ndarray) -> np.ndarray:
    """Slot of the n-gram of bytes that ends at each place from the n-th on."""
    h = np.zeros(max(len(data) - CHAR_N + 1, 0), np.uint32)
    for k in range(CHAR_N):
        h = (h << np.uint32(8)) | data[k : k + len(h)]
    h *= np.uint32(2654435761)
    return h >> np.uint32(16)


def features(data: np.ndarray, offsets: np.ndarray, words: np.ndarray, starts: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Mean weight of a row's byte n-grams plus mean weight of its words; rows without words score 0."""
    of_grams = weights[_char_slots(data)].astype(np.float64)
    for k in range(1, CHAR_N):  # those that would reach into the next row
        of_grams[(offsets[1:] - k)[offsets[1:] - k < len(of_grams)]] = 0
    grams = _per_row(of_grams, np.arange(len(of_grams)), offsets)
    n_grams = np.maximum(np.diff(offsets) - CHAR_N + 1, 1)
    of_words = _per_row(weights[DIMENSIONS + (mix(words ^ _WORD) % np.uint64(DIMENSIONS)).astype(np.int64)], starts, offsets)
    n_words = np.diff(np.searchsorted(starts, offsets))
    return np.where(n_words > 0, grams / n_grams + of_words / np.maximum(n_words, 1), 0.0)


def _counts(text: bytes, hashes: np.ndarray) -> tuple[int, int]:
    """n_dup_lines and n_repeat_words of one text with its word hashes."""
    dup = 0
    if b"\n" in text:
        seen: set[bytes] = set()
        for line in text.split(b"\n"):
            if line in seen:
                dup += 1
            elif line.strip(b"\x20\t\n\x0b\x0c\r"):
                seen.add(line)
    windows = rolling(hashes, 3)
    if not len(windows):
        return dup, 0
    order = np.argsort(windows, kind="stable")
    ranked = windows[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return dup, 0
    twice = np.zeros(len(windows), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(hashes), bool)
    for k in range(3):
        covered[k : k + len(twice)] |= twice
    return dup, int(covered.sum())


def _measure(part: pa.RecordBatch, column: str) -> dict:
    """The words of a piece of a batch and the countable columns of its rows."""
    data, offsets = joined(part.column(column))
    starts, ends = word_spans(data)
    hashes = word_hashes(data, starts, ends)
    cuts = np.searchsorted(starts, offsets)
    continuation = (data & 0xC0) == 0x80
    in_word = np.zeros(len(data) + 1, np.int64)
    np.cumsum(~continuation & ~_WHITE[data], out=in_word[1:])
    symbol = np.zeros(len(data) + 1, np.int64)
    np.cumsum(_SYMBOL[data], out=symbol[1:])
    rest = [_counts(data[a : b - 1].tobytes(), hashes[i:j]) for a, b, i, j in zip(offsets, offsets[1:], cuts, cuts[1:])]
    return {
        "data": data, "offsets": offsets, "starts": starts, "hashes": hashes,
        "n_words": np.diff(cuts), "word_chars": np.diff(in_word[offsets]), "n_symbols": np.diff(symbol[offsets]),
        "n_dup_lines": np.array([d for d, _ in rest], np.int64), "n_repeat_words": np.array([r for _, r in rest], np.int64),
    }


_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def fit_quality(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "quality", seed: int = 0, train_rows: int = TRAIN_ROWS, calibration_rows: int = CALIBRATION_ROWS) -> QualityModel | None:
    """Trains on a bounded sample: the labelled rows (label 0 or 1) first by a seeded hash, `train_rows` +
    `calibration_rows` at most, so the ids sent to all tasks and the texts learnt from in one task are bounded.

    The later part of the sample fits the calibration (Platt's sigmoid on held-out scores). Only the model, two vectors
    of fixed length, reaches the driver. None if a class is missing: then there is no verdict to learn.

    Edge cases: rows with a null id, null label or no text in `docs` are passed over; an id with both labels
    enters once with each, an id with several texts with the smallest.
    """
    bound = train_rows + calibration_rows
    draw = F.xxhash64(F.lit(seed), F.col(key))
    chosen = labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1)).select(F.col(key).alias("id"), F.col(label).cast("int").alias("label"), draw.alias("draw"))
    chosen = chosen.orderBy("draw", "id", "label").limit(bound)
    texts = docs.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    sample = texts.join(F.broadcast(chosen), "id").where(F.length("text") > 0)
    sample = sample.groupBy("draw", "id", "label").agg(F.min("text").alias("text")).withColumn("one", F.lit(0))

    def train(group: pa.Table) -> pa.Table:
        group = group.select(["draw", "text", "label"]).sort_by([("draw", "ascending"), ("text", "ascending")])
        try:
            model = _train((t.as_py() for t in group["text"]), np.asarray(group["label"].to_pylist(), np.float64), calibration_rows / bound)
        finally:
            give_back()
        rows = [] if model is None else [{"weights": model.weights.astype("<f4").tobytes(), "slope": model.slope, "shift": model.shift}]
        return pa.Table.from_pylist(rows, schema=pa.schema([("weights", pa.binary()), ("slope", pa.float64()), ("shift", pa.float64())]))

    found = sample.groupBy("one").applyInArrow(train, "weights binary, slope double, shift double").collect()
    if not found:
        return None
    return QualityModel(np.frombuffer(found[0]["weights"], "<f4"), found[0]["slope"], found[0]["shift"])


def _train(texts: Iterable[str], labels: np.ndarray, held_out: float, epochs: int = 12) -> QualityModel | None:
    """Logistic regression on hashed counts by averaged mini-batch gradient steps, classes weighted alike."""
    if len(set(labels.tolist())) < 2:
        return None
    rows = []
    for t in texts:
        data, offsets = joined(pa.array([t]))
        starts, ends = word_spans(data)
        if not len(starts):
            rows.append((np.empty(0, np.int64), np.empty(0)))
            continue
        grams, words = _char_slots(data).astype(np.int64), DIMENSIONS + (mix(word_hashes(data, starts, ends) ^ _WORD) % np.uint64(DIMENSIONS)).astype(np.int64)
        slots, n = np.unique(grams, return_counts=True)
        more, m = np.unique(words, return_counts=True)
        rows.append((np.concatenate([slots, more]).astype(np.int32), np.concatenate([n / len(grams), m / len(words)]).astype(np.float32)))
    held = np.zeros(len(rows), bool)
    held[len(rows) - int(len(rows) * held_out) :] = True
    if len(set(labels[held].tolist())) < 2 or len(set(labels[~held].tolist())) < 2:
        held[:] = False
    fit = np.flatnonzero(~held)
    share = {c: 0.5 / max((labels[fit] == c).mean(), 1e-9) for c in (0.0, 1.0)}
    weights, square = np.zeros(2 * DIMENSIONS), np.full(2 * DIMENSIONS, 1e-8)
    bias, rng = 0.0, np.random.default_rng(0)
    for _ in range(epochs):
        for i in rng.permutation(fit):
            slots, values = rows[i]
            z = weights[slots] @ values + bias
            g = share[labels[i]] * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[i])
            step = g * values + 1e-6 * weights[slots]
            square[slots] += step * step
            weights[slots] -= 0.5 * step / np.sqrt(square[slots])
            bias -= 0.01 * g
    on = np.flatnonzero(held) if held.any() else fit
    scores = np.array([weights[rows[i][0]] @ rows[i][1] for i in on])
    slope, shift = _calibrate(scores, labels[on])
    return QualityModel(weights.astype(np.float32), slope, shift)


def _calibrate(scores: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Platt's sigmoid by Newton steps, with his smoothed targets."""
    n1, n0 = labels.sum(), (1 - labels).sum()
    target = np.where(labels > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    spread = max(scores.std(), 1e-9)
    x = scores / spread
    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        d, w = p - target, np.maximum(p * (1 - p), 1e-9)
        h = np.array([[w @ (x * x) + 1e-3, w @ x], [w @ x, w.sum() + 1e-3]])
        move = np.linalg.solve(h, np.array([d @ x + 1e-3 * (a - 1), d.sum()]))
        a, b = a - np.clip(move[0], -2, 2), b - np.clip(move[1], -2, 2)
        if np.abs(move).max() < 1e-8:
            break
    return float(a / spread), float(b)


def quality_rules(docs: DataFrame, model: QualityModel | None, *, key: str = "doc_id", text: str = "text", keep_at: float = KEEP_AT, carry: tuple[str, ...] = ()) -> DataFrame:
    """Counts, rules and the model's verdict for every whole text, in Arrow batches without a shuffle.

    Returns one row per input row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    p_good (calibrated probability; null without a model), kept, and, if columns are to be carried, a struct `row` of
    them. kept is false if base_failed, else p_good >= `keep_at` (true without a model).

    Edge cases: a null or empty text has no words and fails the base rules; null and repeated keys are ordinary rows; an
    empty table gives an empty result; other columns are ignored unless carried.
    """
    # a carried text is taken from its row, so that it travels once
    carried = text in carry
    rows = docs.select(F.col(key).alias("doc_id"), *([] if carried else [F.col(text).alias("text")]), *([whole_row(carry)] if carry else []))
    types = dict(rows.dtypes)
    schema = f"doc_id {types['doc_id']}, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, p_good double, kept boolean"
    schema += f", row {rows.schema['row'].dataType.simpleString()}" if carry else ""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if carried:
                batch = batch.append_column("text", batch.column("row").field(text))
            for part in pieces_of(batch, "text", 1 << 20):
                m = _measure(part, "text")
                failed = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * m["n_words"])
                if model is None:
                    p, kept = pa.nulls(len(failed), pa.float64()), ~failed
                else:
                    z = model.slope * features(m["data"], m["offsets"], m["hashes"], m["starts"], model.weights) + model.shift
                    good = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
                    p, kept = pa.array(good), ~failed & (good >= keep_at)
                out = {"doc_id": part.column("doc_id")} | {c: pa.array(m[c], pa.int64()) for c in COUNTS}
                out |= {"base_failed": pa.array(failed), "p_good": p, "kept": pa.array(kept)}
                out |= {"row": part.column("row")} if carry else {}
                yield pa.RecordBatch.from_pydict(out)

    return rows.mapInArrow(lean(score), schema)
