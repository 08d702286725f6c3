"""Quality rules under weak supervision.

Each rule votes good or bad or abstains. Expectation-maximisation over the counts of vote patterns, which all
documents yield, estimates how each rule votes on good and on bad documents; a document's posterior probability of
being good decides. Patterns are at most 3^rules, whatever the input.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

_SYMBOLS = b"#*$%&|<>"
_UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_NOT_LETTERS = bytes(c for c in range(128) if not chr(c).isalpha())
_BLANKS = b" \t\n\x0b\x0c\r"
_P = np.int64(1_000_003)

FEATURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_letters", "n_shouts", "n_stops", "n_distinct", "n_filled_lines", "n_symbol_words"]
GOOD, BAD, ABSTAIN = 1, 0, 2
#: Distinct words are counted in windows of so many words, as their share in a whole text falls with its length alone.
WINDOW = 1000


def repeated_words(words: list[bytes], width: int = 5) -> int:
    """Words in windows of `width` words that stand twice or more in the text."""
    n = len(words)
    if n <= width:
        return 0
    with np.errstate(over="ignore"):
        h = np.fromiter(map(hash, words), np.int64, n)
        w = h[: n - width + 1].copy()
        for k in range(1, width):
            w = w * _P + h[k : n - width + 1 + k]
    s = np.sort(w)
    twice = s[1:][s[1:] == s[:-1]]
    if not len(twice):
        return 0
    starts = np.isin(w, twice).astype(np.int64)
    edge = np.zeros(n + 1, np.int64)
    edge[: n - width + 1] += starts
    edge[width : n + 1] -= starts
    return int((np.cumsum(edge)[:n] > 0).sum())


def distinct_words(words: list[bytes]) -> int:
    """Sum of the distinct words of each window. Windows follow one another; the last one ends with the text, so that all have one size."""
    n = len(words)
    return sum(len(set(words[max(0, min(k, n - WINDOW)) : k + WINDOW])) for k in range(0, n, WINDOW))


def features(text: str) -> list[int]:
    raw = text.encode()
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip(_BLANKS)]
    gone = lambda drop: len(raw) - len(raw.translate(None, drop))
    symbols = gone(_SYMBOLS)
    marked = sum(w.translate(None, _SYMBOLS) != w for w in words) if symbols else 0
    return [len(words), len(text) - gone(_BLANKS), symbols, len(lines) - len(set(lines)), repeated_words(words), gone(_UPPER), len(raw) - gone(_NOT_LETTERS), raw.count(b"!"), gone(b".!?"), distinct_words(words), len(lines), marked]


def votes(f: np.ndarray) -> np.ndarray:
    """The rules' votes, a row a document. f: features in their order."""
    n, chars, symbols, dup, repeat, upper, letters, shouts, stops, distinct, lines, marked = f.T.astype(float)
    per = np.maximum(n, 1)

    def rule(share, good, bad, holds=True):
        """Good up to one bound, bad from another one."""
        return np.where(~(np.ones(len(share), bool) & holds), ABSTAIN, np.where(share <= good, GOOD, np.where(share >= bad, BAD, ABSTAIN)))

    length = chars / per
    in_windows = np.maximum(np.ceil(n / WINDOW) * np.minimum(n, WINDOW), 1)
    return np.stack(
        [
            rule(repeat / per, 0.1, 0.3, n >= 10),
            rule(symbols / per, 0.02, 0.1),
            rule(upper / np.maximum(letters, 1), 0.1, 0.3),
            rule(shouts / per, 0.05, 0.3),
            rule(-distinct / in_windows, -0.5, -0.3, n >= 30),
            rule(np.abs(length - 5), 1.2, 2, n >= 30),
            rule(dup / np.maximum(lines, 1), 0.1, 0.3, lines >= 3),
            np.where(n < 30, ABSTAIN, np.where((stops >= 0.03 * n) & (stops <= 0.3 * n), GOOD, np.where((stops < 0.01 * n) | (stops > 0.6 * n), BAD, ABSTAIN))),
            rule(marked / per, 0.05, 0.2),
            rule(symbols / np.maximum(chars, 1), 0.01, 0.04),
        ],
        axis=1,
    )


N_RULES = 10


def code(v: np.ndarray) -> np.ndarray:
    return v @ 3 ** np.arange(v.shape[1])


def label_model(patterns: Iterable[tuple[int, int]], rounds: int = 200, n_rules: int = N_RULES) -> dict[int, float]:
    """Posterior probability of good for each pattern. patterns: (code, documents).

    Starts from the votes; each class has its own rates of good, bad and abstaining for each rule, smoothed towards a rule that is
    right four times in five. Ties and no votes lean on the classes' shares.

    The start names the classes, as without labels either could be the good one: rules are made so that ordinary text gets
    good votes from nearly all of the ten, so one bad vote among them has to count more than the rest together (eight to
    one), and a text that no rule can judge is taken for good (0.9), since most texts are. Later rounds use the counts alone.
    """
    patterns = sorted(patterns)
    if not patterns:
        return {}
    codes, n = np.array([p for p, _ in patterns]), np.array([c for _, c in patterns], float)
    v = codes[:, None] // 3 ** np.arange(n_rules) % 3
    good, bad = (v == GOOD).sum(1), (v == BAD).sum(1)
    post = np.where(bad > 0, (good + 1.0) / (good + 1.0 + 8.0 * bad), 0.9)
    prior_rates = np.array([[0.64, 0.16, 0.2], [0.16, 0.64, 0.2]])
    weight = max(1.0, 0.001 * n.sum())
    for _ in range(rounds):
        w = np.stack([n * (1 - post), n * post])
        share = (w.sum(1) + [0.1 * weight, 0.9 * weight]) / (w.sum() + weight)
        log = np.log(share)[:, None] + np.zeros((2, len(n)))
        for r in range(n_rules):
            rates = np.stack([w @ (v[:, r] == k) for k in (BAD, GOOD, ABSTAIN)], 1) + weight * prior_rates
            rates /= rates.sum(1, keepdims=True)
            # whether a rule abstains depends on a text's length, not on its quality, and so says nothing
            sway = np.log(rates[:, :2] / rates[:, :2].sum(1, keepdims=True))
            log += np.where(v[:, r] == ABSTAIN, 0.0, sway[:, np.minimum(v[:, r], 1)])
        new = 1 / (1 + np.exp(np.clip(log[0] - log[1], -700, 700)))
        if np.abs(new - post).max() < 1e-9:
            post = new
            break
        post = new
    return dict(zip(codes.tolist(), post.tolist()))


def _feature_batch(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    f = np.array([features(x) for x in texts], np.int64).reshape(-1, len(FEATURES))
    return f, code(votes(f))


def failed(n_words, n_repeat):
    """The base rule that rejects whatever the others say."""
    return (n_words < 10) | (100 * n_repeat > 20 * n_words)


def document_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the features, and the pattern of votes, of each row."""

    def make():
        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            x, pattern = _feature_batch(common.texts(batch))
            return pa.record_batch([batch.column("doc_id"), *[pa.array(c) for c in x.T], pa.array(pattern, pa.int32())], ["doc_id", *FEATURES, "pattern"])

        return f

    return common.map_batches(common.keyed(docs, id_col, text_col), make, ", ".join(f"{c} long" for c in ["doc_id", *FEATURES]) + ", pattern int")


def fit(found: DataFrame) -> dict[int, float]:
    """found: rows with a pattern. What reaches the driver has at most 3^rules rows."""
    return label_model((r[0], r[1]) for r in found.groupBy("pattern").count().collect())


def quality(docs: DataFrame, min_posterior: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, posterior, kept.

    Words are runs of characters other than ASCII white space. Null and empty texts have no words and fail. Repeated
    rows vote and return each for itself, a null id stays null, an empty table gives an empty one, other columns are
    ignored. Whole texts of any length; the only shuffle is of pattern counts.
    """
    found = common.cut(document_features(docs, id_col, text_col))
    post = fit(found)
    spark = docs.sparkSession
    table = spark.createDataFrame(sorted(post.items()), "pattern int, posterior double")
    base = failed(F.col("n_words"), F.col("n_repeat_words"))
    out = found.join(F.broadcast(table), "pattern", "left")
    return out.select("doc_id", *FEATURES[:5], base.alias("base_failed"), "posterior", (~base & (F.col("posterior") >= min_posterior)).alias("kept"))


def keep_good(docs: DataFrame, min_posterior: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that `quality` keeps, with all their columns. Texts are read twice and never shuffled.

    Null and empty texts have no words and go. Repeated rows vote and stay or go each for itself, a null id doesn't matter, an
    empty table gives an empty one; texts of any length are judged whole."""
    post = fit(document_features(docs, id_col, text_col))
    good = np.zeros(3**N_RULES, bool)
    good[[p for p, x in post.items() if x >= min_posterior]] = True

    def run(batches):
        for b in batches:
            f, pattern = _feature_batch([x or "" for x in b.column(text_col).to_pylist()])
            yield b.filter(pa.array(good[pattern] & ~failed(f[:, 0], f[:, 4])))

    return docs.mapInArrow(run, T.StructType(docs.schema.fields))
