"""How alike two short texts are. Small helpers that run inside Arrow batches."""

from __future__ import annotations

import sys
from itertools import accumulate

import pandas as pd
from pyspark import cloudpickle

# sent to the workers by value, so that they need no installed copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def indel_ratio(a: str, b: str) -> float:
    """100 * 2 * LCS / (len(a) + len(b)), the LCS by one bit vector per letter."""
    if not a and not b:
        return 100.0
    places: dict[str, int] = {}
    for i, ch in enumerate(a):
        places[ch] = places.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        met = row & places.get(ch, 0)
        row = ((row + met) | (row - met)) & full
    return 200.0 * (len(a) - row.bit_count()) / (len(a) + len(b))


def partial_ratio(a: str, b: str) -> float:
    """Best ratio of the shorter text against every stretch of that length in the longer one, cut ends included."""
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    if not short:
        return 100.0 if not long else 0.0
    n = len(short)
    return max(indel_ratio(short, long[max(0, i) : i + n]) for i in range(1 - n, len(long)))


def word_runs(words: str, most: int = 3) -> list[tuple[int, int]]:
    """Where the runs of 1..most words begin and end: single words before pairs before triples, in the order of the text."""
    if not words:
        return []
    starts = [0, *accumulate(len(w) + 1 for w in words.split(" "))]
    ends = [s - 1 for s in starts[1:]]
    return [span for n in range(most) for span in zip(starts, ends[n:])]


def near_terms(threshold: float):
    """(words joined by a blank, wanted values, their masks) -> the runs of 1..3 words that are nearly a value, with its mask and the place of the run."""

    def near(words: pd.Series, values: pd.Series, masks: pd.Series) -> pd.Series:
        out = []
        for text, wanted, shown in zip(words, values, masks):
            hits = []
            runs = word_runs(text) if text and wanted is not None else []
            for value, mask in zip(wanted, shown) if runs else ():
                value = value.lower()
                # a ratio of t needs lengths within t / (200 - t) of each other
                low, high = max(3, len(value) * threshold / (200 - threshold)), len(value) * (200 - threshold) / threshold
                letters, met = set(value), set()
                for place, (start, end) in enumerate(runs):
                    if not low <= end - start <= high:
                        continue
                    run = text[start:end]
                    # a run that stands twice counts where it stands first
                    if run not in met:
                        met.add(run)
                        # letters of the run that the value has at all bound the ratio (one more is allowed for rounding)
                        enough = sum(map(letters.__contains__, run)) >= (len(value) + len(run)) * threshold / 200 - 1
                        if enough and indel_ratio(value, run) >= threshold:
                            hits.append({"place": place, "value": run, "mask": mask})
            out.append(hits)
        return pd.Series(out)

    return near


def name_likeness(word: pd.Series, name: pd.Series) -> pd.Series:
    return pd.Series([partial_ratio(w.lower(), n.lower()) if w and n else 0.0 for w, n in zip(word, name)], dtype="float64")
