"""Quality rules: a linear-chain conditional random field marks the lines of a text as content or boilerplate.

The field has two labels, features of a line's characters and words, and transitions between neighbouring
lines.  It is fitted on a bounded sample of documents that pass the base rules and have a quality label.  The label
of a document names only those of its lines that show it: whole sentences of a good one are content, and copies, symbols
and short lines that end like a link or a title are boilerplate in any.  The other lines are latent.  Every second
good document is fitted with runs of boilerplate lines between its own, so that the field sees both labels in one text.
Viterbi decoding then labels the lines of every text.  A text is kept if it passes the base rules and at least half of
its word characters lie in content lines.

Base rules: a text fails with fewer than 50 words, or if more than half of its words lie in three-word windows
that it has twice or more.  Defined results: NULL and empty texts have no words and fail; equal rows give
equal results; without usable labels the field keeps its stated default weights; other columns are not read.
Documents of more than ``SAMPLE_LINES`` lines are judged like any other but not fitted on, so the fitted weights lean
to shorter documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folia.llm import signals as S
from folia.llm.samples import labelled_sample
from folia.llm.words import parts, record

#: Documents that the field is fitted on at most (about), and lines beyond which a document is not used for it.
SAMPLE_DOCS, SAMPLE_LINES = 3000, 2000
FEATURES = ("bias", "words", "upper", "digit", "symbol", "shout", "stop", "mark", "wide", "short", "copy", "word_length", "open")
WORDS, SYMBOL, COPY, OPEN = (FEATURES.index(name) for name in ("words", "symbol", "copy", "open"))
#: Weights for content where no label is known: symbols, shouting and copies speak against it.
DEFAULT_WEIGHTS = np.array([2.0, 0.0, -2.0, -1.0, -4.0, -4.0, 0.0, -1.0, 0.0, -0.5, -1.0, 0.0, -3.0])
DEFAULT_MOVES = np.array([[0.5, -0.5], [-0.5, 0.5]])
SHARE = 0.5
#: A line of fewer words than this that ends without a mark is open, the more so the fewer they are.
OPEN_WORDS = 8
#: Lines of site menus and notices, from which runs of boilerplate are made for fitting.
MENU_LINES = (
    "Home", "About us", "Contact", "Sign in", "Register", "Search", "Menu", "Next page", "Previous", "Back to top", "Share this",
    "Follow us on social media", "Related articles", "Most read", "Terms of use", "Cookie settings", "Subscribe to our newsletter",
    "Skip to main content", "Read more", "Comments", "Log out", "My account", "Site map", "Print this page", "FAQ",
)
#: Endings of sentences in scripts beyond ASCII.
WIDE_STOPS = tuple(mark.encode() for mark in "。！？…」』”’»")

#: Share of a line's characters at which a kind of character counts in full.
FULL = {S.UP: 0.5, S.DIGIT: 0.3, S.SYMBOL: 0.05, S.SHOUT: 0.05, S.STOP: 0.05, S.MARK: 0.05, S.WIDE: 0.2}


def line_features(s: S.Signals) -> np.ndarray:
    kinds = s.line_kinds.astype(np.float64)
    solid = np.maximum(kinds.sum(axis=1) - kinds[:, S.SPACE], 1)
    words = s.line_words.astype(np.float64)
    columns = [np.ones(len(words)), np.minimum(np.log1p(words) / 4, 1.2)]
    columns += [np.minimum(kinds[:, k] / solid / full, 1) for k, full in FULL.items()]
    columns += [words < 3, s.line_copy, np.minimum(solid / np.maximum(words, 1) / 10, 2)]
    columns.append(open_ended(s) * np.maximum(1 - words / OPEN_WORDS, 0))
    return np.stack(columns, axis=1)


def open_ended(s: S.Signals) -> np.ndarray:
    """Lines with a word whose last character is a letter or a digit."""
    if not len(s.line_ends):
        return np.zeros(0, dtype=bool)
    solid = np.where(s.kinds != S.SPACE, np.arange(len(s.kinds)), -1)
    last = np.maximum.accumulate(solid)[s.line_ends]
    kind = np.where(last >= s.line_starts, s.kinds[last], S.SPACE)
    found = np.isin(kind, (S.LOW, S.UP, S.DIGIT, S.WIDE)) & (s.line_words > 0)
    data = s.words.data
    for i in np.flatnonzero(found & (kind == S.WIDE)):
        found[i] = not bytes(data[max(last[i] - 2, 0) : last[i] + 1]).endswith(WIDE_STOPS)
    return found


def weak_labels(x: np.ndarray, good: bool) -> np.ndarray:
    """1 content, 0 boilerplate, -1 latent, for the lines of a document by their features and its label."""
    sentence = (x[:, WORDS] >= np.log1p(5) / 4) & (x[:, OPEN] == 0) & (x[:, SYMBOL] < 0.5)
    labels = np.where(sentence, 1 if good else -1, -1 if good else 0)
    labels[(x[:, COPY] > 0) | (x[:, OPEN] >= 0.5)] = 0
    return labels


def with_boilerplate(x: np.ndarray, labels: np.ndarray, pools: list[np.ndarray], rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """A document's lines with runs of one to four lines of one pool put between them at about every third."""
    rows, marks = [], []
    for line, label in zip(x, labels):
        rows.append(line[None])
        marks.append([label])
        if rng.random() < 1 / 3:
            pool = pools[rng.integers(len(pools))]
            run = pool[rng.integers(len(pool), size=rng.integers(1, 5))]
            rows.append(run)
            marks.append([0] * len(run))
    return np.concatenate(rows), np.concatenate(marks)


def decode(scores: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Most likely labels of a chain whose content scores are given; boilerplate scores zero."""
    best0, best1, back = 0.0, float(scores[0]), []
    (m00, m01), (m10, m11) = moves.tolist()
    for x in scores[1:].tolist():
        from0, from1 = best0 + m01 <= best1 + m11, best0 + m00 < best1 + m10
        back.append((from1, from0))
        best0, best1 = max(best0 + m00, best1 + m10), x + max(best0 + m01, best1 + m11)
    label = best1 >= best0
    out = [label]
    for to0, to1 in reversed(back):
        label = to1 if label else to0
        out.append(label)
    return np.array(out[::-1], dtype=bool)


def fit(chains: list[np.ndarray], labels: list[np.ndarray], *, steps: int = 200, rate: float = 0.15, penalty: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Weights and transitions by gradient ascent on the log-likelihood of the known labels; -1 is latent."""
    width = len(FEATURES)
    rows = [(c[i : i + 32], z[i : i + 32]) for c, z in zip(chains, labels) for i in range(0, len(c), 32)]
    rows = [(c, z) for c, z in rows if (z >= 0).any()]
    if len({int(v) for _, z in rows for v in np.unique(z) if v >= 0}) < 2:
        return DEFAULT_WEIGHTS, DEFAULT_MOVES
    length = np.array([len(c) for c, _ in rows])
    order = np.argsort(-length, kind="stable")
    rows, length = [rows[i] for i in order], length[order]
    x = np.zeros((len(rows), length[0], width))
    y = np.full(x.shape[:2], -1)
    for i, (c, z) in enumerate(rows):
        x[i, : len(c)], y[i, : len(c)] = c, z
    live = np.arange(length[0])[None, :] < length[:, None]
    w, moves = DEFAULT_WEIGHTS.copy(), DEFAULT_MOVES.copy()
    speed = [np.zeros(width), np.zeros((2, 2))]
    size = [np.full(width, 1e-8), np.full((2, 2), 1e-8)]
    for _ in range(steps):
        gw, gm = _gradient(x, live, y, w, moves)
        for value, grad, v, s in ((w, gw - penalty * w, speed[0], size[0]), (moves, gm - penalty * moves, speed[1], size[1])):
            v[:] = 0.9 * v + 0.1 * grad
            s[:] = 0.98 * s + 0.02 * grad**2
            value += rate * v / np.sqrt(s)
    return w, moves


def _gradient(x, live, y, w, moves) -> tuple[np.ndarray, np.ndarray]:
    """Features and transitions expected with the known labels, minus those expected with none.

    ``y`` holds a label per chain or one per line; -1 is latent.
    """
    n = len(x)
    if y.ndim == 1:
        y = np.repeat(y[:, None], x.shape[1], axis=1)
    order = np.argsort(-live.sum(axis=1), kind="stable")
    if (order[:-1] > order[1:]).any():
        x, live, y = x[order], live[order], y[order]
    unary = np.stack([np.zeros(x.shape[:2]), x @ w], axis=2)
    known = unary.copy()
    known[:, :, 0][y == 1] = known[:, :, 1][y == 0] = -1e9
    (seen, seen_moves), (free, free_moves) = _expected(known, live, moves), _expected(unary, live, moves)
    return np.einsum("nt,ntf->f", seen - free, x) / n, (seen_moves - free_moves) / n


def _expected(unary, live, moves) -> tuple[np.ndarray, np.ndarray]:
    """Chance of content per line and sums of the transitions, by the forward and backward recursions.

    Chains come longest first, so those that reach a line are the first ones.
    """
    n, longest, _ = unary.shape
    reach = live.sum(axis=0)
    forward, backward = unary.copy(), np.zeros(unary.shape)
    for t in range(1, longest):
        before = forward[: reach[t], t - 1]
        forward[: reach[t], t] += np.logaddexp(before[:, :1] + moves[0], before[:, 1:] + moves[1])
    for t in range(longest - 2, -1, -1):
        after = unary[: reach[t + 1], t + 1] + backward[: reach[t + 1], t + 1]
        backward[: reach[t + 1], t] = np.logaddexp(moves[:, 0] + after[:, :1], moves[:, 1] + after[:, 1:])
    chain, line = np.nonzero(live)
    total = np.logaddexp(forward[:, 0, 0] + backward[:, 0, 0], forward[:, 0, 1] + backward[:, 0, 1])
    content = np.zeros((n, longest))
    content[chain, line] = np.exp(forward[chain, line, 1] + backward[chain, line, 1] - total[chain])
    chain, line = chain[line > 0], line[line > 0]
    ahead = unary[chain, line] + backward[chain, line] - total[chain, None]
    joint = np.exp(forward[chain, line - 1][:, :, None] + moves + ahead[:, None, :])
    return content, joint.sum(axis=0)


def base_failed(s: S.Signals) -> np.ndarray:
    return (s.n_words < 50) | (100 * s.n_repeat_words > 50 * s.n_words)


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, texts in parts(batches):
        s = S.Signals(texts)
        values = line_features(s)
        failed = base_failed(s)
        used = [not f and b - a <= SAMPLE_LINES for f, a, b in zip(failed, s.line_first, s.line_first[1:])]
        solid = s.line_kinds.sum(axis=1) > s.line_kinds[:, S.SPACE]
        flat = [values[a:b][solid[a:b]].ravel() if u else values[:0].ravel() for u, a, b in zip(used, s.line_first, s.line_first[1:])]
        yield record({"label": rows.column("label"), "lines": pa.array(flat, pa.list_(pa.float64()))})


def train(docs: DataFrame, labels: DataFrame, *, limit: int = SAMPLE_DOCS) -> tuple[np.ndarray, np.ndarray]:
    """The field's weights and transitions from about ``limit`` documents with a ``quality`` label."""
    sample = labelled_sample(docs, labels, "quality", limit)
    found = sorted((r["label"], r["lines"]) for r in sample.mapInArrow(_featured, "label int, lines array<double>").collect())
    chains = [(np.array(v).reshape(-1, len(FEATURES)), y > 0) for y, v in found if v]
    if len({good for _, good in chains}) < 2:
        return DEFAULT_WEIGHTS, DEFAULT_MOVES
    marked = [(x, weak_labels(x, good)) for x, good in chains]
    junk = np.concatenate([x[z == 0] for (x, z), (_, good) in zip(marked, chains) if not good])
    pools = [line_features(S.Signals(list(MENU_LINES)))] + ([junk] if len(junk) else [])
    rng = np.random.default_rng(7)
    used = [with_boilerplate(x, z, pools, rng) if good and i % 2 else (x, z) for i, ((x, z), (_, good)) in enumerate(zip(marked, chains))]
    return fit([x for x, _ in used], [z for _, z in used])


def _judge(model: tuple[np.ndarray, np.ndarray]):
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, moves = model
        for rows, texts in parts(batches):
            s = S.Signals(texts)
            scores = line_features(s) @ weights
            solid = s.line_kinds.sum(axis=1) - s.line_kinds[:, S.SPACE]
            share = np.zeros(len(texts))
            for i, (a, b) in enumerate(zip(s.line_first, s.line_first[1:])):
                chars = solid[a:b]
                used = chars > 0
                if used.any():
                    content = decode(scores[a:b][used], moves)
                    share[i] = chars[used][content].sum() / chars[used].sum()
            failed = base_failed(s)
            yield record({
                "doc_id": rows.column("doc_id"), "n_words": s.n_words.astype(np.int64), "word_chars": s.word_chars.astype(np.int64),
                "n_symbols": s.n_symbols.astype(np.int64), "n_dup_lines": s.n_dup_lines.astype(np.int64),
                "n_repeat_words": s.n_repeat_words.astype(np.int64), "base_failed": failed, "kept": ~failed & (share >= SHARE), "content_share": share,
            })

    return judge


SCHEMA = (
    "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
    "base_failed boolean, kept boolean, content_share double"
)


def quality(docs: DataFrame, model: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """Counts and verdict per row of ``docs(doc_id, text)``.  No shuffle."""
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, {SCHEMA}"
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(_judge(model), schema)


def _filter(model: tuple[np.ndarray, np.ndarray]):
    judge = _judge(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            only = batch.select(["doc_id", "text"])
            kept = pa.concat_arrays([v.column("kept") for v in judge(iter([only]))]) if batch.num_rows else pa.array([], pa.bool_())
            yield batch.filter(kept)

    return keep


def passing(docs: DataFrame, model: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns.  ``text`` must be a string column.  No shuffle."""
    return docs.mapInArrow(_filter(model), docs.schema)
