"""Toxicity (operator 3): a convolutional text classifier over hashed word embeddings.

A word's vector is the sum of the embeddings of its hashed features: the word, its prefixes and its
suffix. Filters of several widths slide over the word vectors; each keeps its largest response over
the whole text (max pooling), and a logistic unit reads these. Trained in numpy on a bounded sample
of labelled rows. Thresholds are calibrated by language on rows kept from the fit, the language
being guessed from the text's own words; scores are shifted so that each language's threshold
stands at one common value.

For scoring, embeddings and filters fold into one table of responses a feature, so a text costs a
gather and a segmented maximum, whatever its length.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import STEP_CHARS, text_column_udf

WIDTHS = (1, 2, 3)
FILTERS = 8  # a width
DIM = 16
BITS = 15
PREFIXES, SUFFIX = (4, 5, 6), 4
N_FEATURES = 2 + len(PREFIXES)
#: Words that the widest filter reaches beyond its first.
REACH = max(WIDTHS) - 1
#: Score at which the calibrated threshold of each language stands.
THRESHOLD = 0.3
#: Words whose responses a scorer keeps, and words that a step holds as arrays.
MAX_WORDS, STEP_WORDS = 250_000, 100_000
#: Step of the embeddings, in units of their gradients' root mean square.
EMBED_RATE = 0.01
#: Share of a text's words that an update leaves out, so that no rare word can stand for a label.
DROPPED = 0.6
#: Updates that a fit on few rows has at least.
LEAST_STEPS = 800
_EDGE = dict.fromkeys(range(0x21, 0x30), None) | dict.fromkeys(range(0x3A, 0x41), None) | dict.fromkeys(range(0x5B, 0x61), None) | dict.fromkeys(range(0x7B, 0x7F), None)


def features(word: str) -> list[int]:
    """Buckets of a word's features; 0 is the empty feature's."""
    raw, last = word.encode("utf-8", "surrogatepass"), (1 << BITS) - 1
    out = [1 + zlib.crc32(raw) % last]
    out += [1 + zlib.crc32(word[:n].encode("utf-8", "surrogatepass"), n) % last if len(word) >= n else 0 for n in PREFIXES]
    out.append(1 + zlib.crc32(word[-SUFFIX:].encode("utf-8", "surrogatepass"), 99) % last if len(word) >= SUFFIX else 0)
    return out


def word_pieces(text: str | None, piece_chars: int | None = None) -> Iterator[tuple[list[str], bool]]:
    """(words, whether they end the text) of a text in pieces of about ``piece_chars`` characters, cut at white space.

    A piece begins with the last words of the one before, as many as the widest filter reaches over.
    """
    text, at, carried = text or "", 0, []
    piece_chars = piece_chars or STEP_CHARS
    while True:
        stop = at + piece_chars
        while stop < len(text) and not text[stop].isspace():
            stop += 1
        words = carried + text[at:stop].lower().translate(_EDGE).split()
        at = stop
        if at >= len(text):
            yield words, True
            return
        if len(words) >= REACH:
            yield words, False
            carried = words[-REACH:] if REACH else []
        else:
            carried = words


class Words:
    """Numbers the distinct words of pieces; row 0 is the empty word."""

    def __init__(self):
        self.rows: dict[str, int] = {"": 0}

    def number(self, pieces: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Features of the words that are new, the row of each word of all pieces, and words a piece.

        After each piece stand as many empty words as the widest filter needs.
        """
        known = len(self.rows)
        ids: list[int] = []
        rows = self.rows
        number = rows.setdefault
        for words in pieces:
            ids.extend([number(w, len(rows)) for w in words])
            ids.extend([0] * REACH)
        new = [features(w) for w in islice(rows, known, None)]
        return np.array(new, np.int64).reshape(-1, N_FEATURES), np.array(ids, np.int64), np.array([len(w) for w in pieces], np.int64)


def _starts(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(counts + REACH)[:-1]]).astype(np.int64)


@dataclass
class ToxicityModel:
    embed: np.ndarray  # buckets x DIM; row 0 stays zero
    filters: list[np.ndarray]  # by width: width x DIM x FILTERS
    shift: list[np.ndarray]  # by width: FILTERS
    out: np.ndarray
    bias: float
    languages: list[str]
    word_log_prob: np.ndarray  # buckets x languages, of the words' first feature
    cuts: np.ndarray  # logit of each language's threshold, and last that of all
    wordless: float = 0.0  # logit of a text without a word

    def scorer(self) -> Scorer:
        return Scorer(self)

    def score(self, texts: list[str | None]) -> np.ndarray:
        return self.scorer().score(texts)


class Scorer:
    """Scores texts; keeps the responses of up to MAX_WORDS words it has met."""

    def __init__(self, model: ToxicityModel):
        self.model = model
        # one row a bucket: responses by width and place of the filter
        self.by_bucket = np.concatenate([model.embed @ f[j] for f in model.filters for j in range(len(f))], axis=1).astype(np.float32)
        self._forget()

    def _forget(self) -> None:
        self.words = Words()
        self.held = np.zeros((1 << 14, self.by_bucket.shape[1] + len(self.model.languages)), np.float32)

    def _rows(self, pieces: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.words.rows) > MAX_WORDS:
            self._forget()
        known = len(self.words.rows)
        new, ids, counts = self.words.number(pieces)
        while known + len(new) > len(self.held):
            self.held = np.concatenate([self.held, np.zeros_like(self.held)])
        got = self.held[known : known + len(new)]
        n = self.by_bucket.shape[1]
        for k in range(N_FEATURES):
            got[:, :n] += self.by_bucket[new[:, k]]
        if self.model.languages:
            got[:, n:] = self.model.word_log_prob[new[:, 0]]
        return ids, counts

    def _pool(self, pieces: list[list[str]], last: list[bool], owner: list[int], top: np.ndarray, told: np.ndarray) -> None:
        """Raise the texts' largest responses and add their words' log-probabilities by those of some pieces."""
        ids, counts = self._rows(pieces)
        # the last words of a piece that does not end its text are seen again as the first of the next
        stops = counts - np.where(last, 0, REACH)
        some = stops > 0
        if not some.any():
            return
        starts = _starts(counts)[some]
        edges = np.stack([starts, starts + stops[some]], 1).ravel()
        of = np.array(owner)[some]
        n = len(ids)
        ids = np.concatenate([ids, np.zeros(max(WIDTHS), np.int64)])
        place = 0
        for k, w in enumerate(WIDTHS):
            total = self.held[ids[: n + 1], place : place + FILTERS]
            for j in range(1, w):
                total += self.held[ids[j : n + 1 + j], place + j * FILTERS : place + (j + 1) * FILTERS]
            place += w * FILTERS
            np.maximum.at(top[:, k * FILTERS : (k + 1) * FILTERS], of, np.maximum.reduceat(total, edges, axis=0)[::2])
        if self.model.languages:
            np.add.at(told, of, np.add.reduceat(self.held[ids[: n + 1], place:], edges, axis=0, dtype=np.float64)[::2])

    def logits(self, texts: list[str | None], piece_chars: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Raw logit, and number of the guessed language (the last for none), of each text. Long texts go piece by piece."""
        model = self.model
        top = np.full((len(texts), FILTERS * len(WIDTHS)), -np.inf)
        told = np.zeros((len(texts), len(model.languages)))
        step: tuple[list, list, list] = ([], [], [])
        n_held = 0
        for i, text in enumerate(texts):
            for words, last in word_pieces(text, piece_chars):
                for held, x in zip(step, (words, last, i)):
                    held.append(x)
                n_held += len(words)
                if n_held >= STEP_WORDS:
                    self._pool(*step, top, told)
                    step, n_held = ([], [], []), 0
        self._pool(*step, top, told)
        some = np.isfinite(top[:, 0])
        pooled = np.where(some[:, None], np.maximum(top + np.concatenate(model.shift), 0), 0.0)
        logit = np.where(some, pooled @ model.out + model.bias, model.wordless)
        guess = np.where(some, told.argmax(axis=1), len(model.languages)) if model.languages else np.zeros(len(texts), np.int64)
        return logit, guess

    def score(self, texts: list[str | None]) -> np.ndarray:
        logit, guess = self.logits(texts)
        z = logit - self.model.cuts[guess] + math.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _best_cut(logit: np.ndarray, y: np.ndarray) -> float:
    """Logit between two rows at which F1 is largest; of equals the middle one."""
    order = np.argsort(-logit, kind="stable")
    z, hit = logit[order], np.cumsum(y[order])
    f1 = 2 * hit / (np.arange(1, len(z) + 1) + max(1, y.sum()))
    edge = np.concatenate([z[:-1] != z[1:], [True]])
    f1 = np.where(edge, f1, -1.0)
    best = np.flatnonzero(f1 >= f1.max() - 1e-12)
    at = best[len(best) // 2]
    return float((z[at] + z[at + 1]) / 2) if at + 1 < len(z) else float(z[at] - 1)


def fit(texts: list[str], toxic: list[int], langs: list[str | None], epochs: int = 6, batch: int = 32, rate: float = 0.01, seed: int = 5) -> ToxicityModel:
    """Fit on labelled texts. Without both labels every score is the smoothed share of the label there is."""
    rng = np.random.default_rng(seed)
    languages = sorted({x for x in langs if x is not None})
    embed = rng.normal(0, 0.1, (1 << BITS, DIM))
    embed[0] = 0
    filters = [rng.normal(0, 1 / math.sqrt(w * DIM), (w, DIM, FILTERS)) for w in WIDTHS]
    shift = [np.zeros(FILTERS) for _ in WIDTHS]
    out = rng.normal(0, 0.3, FILTERS * len(WIDTHS))
    y = np.array(toxic, float)
    prior = (y.sum() + 0.5) / (len(y) + 1)
    bias = np.array([math.log(prior / (1 - prior))])

    numbered = Words()
    table, flat, counts = numbered.number([[w for words, _ in word_pieces(t, len(t) + 1) for w in words] for t in texts])
    table = np.concatenate([np.zeros((1, N_FEATURES), np.int64), table])
    begin = _starts(counts)
    words = np.full((1 << BITS, len(languages)), 0.1)
    for lang_number, lang in enumerate(languages):
        for i in (i for i, x in enumerate(langs) if x == lang):
            words[:, lang_number] += np.bincount(table[flat[begin[i] : begin[i] + counts[i]], 0], minlength=1 << BITS)
    words[0] = 1
    model = ToxicityModel(embed, filters, shift, out, float(bias[0]), languages, (np.log(words) - np.log(words.sum(axis=0))).astype(np.float32), np.zeros(len(languages) + 1))
    if not 0 < y.sum() < len(y):
        model.out = np.zeros_like(out)
        model.wordless = model.bias
        model.cuts[:] = math.log(THRESHOLD / (1 - THRESHOLD))
        return model

    kept = rng.permutation(len(texts))
    n_cal = len(texts) // 4
    train, cal = kept[n_cal:], kept[:n_cal]
    weight = np.where(y > 0, min(8.0, (1 - y.mean()) / y.mean()) ** 0.5, 1.0)
    params = [embed, *filters, *shift, out, bias]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params[1:]]
    count, scale = 0, 0.0
    for _ in range(max(epochs, -(-LEAST_STEPS * batch // max(1, len(train))))):
        rng.shuffle(train)
        for at in range(0, len(train), batch):
            some = train[at : at + batch]
            left = [flat[begin[i] : begin[i] + counts[i]][rng.random(counts[i]) >= DROPPED] for i in some]
            size = np.array([len(x) for x in left])
            live = size > 0
            if not live.any():
                continue
            of = some[live]
            # all texts of the batch in one row of words, empty ones after each
            ids = np.concatenate([np.concatenate([x, np.zeros(REACH, np.int64)]) for x in left if len(x)])
            edges = _starts(size[live])
            n = len(ids) - REACH  # places at which the widest filter can start
            seg = np.repeat(np.arange(len(of)), size[live] + REACH)[:n]
            beyond = np.setdiff1d((edges + size[live])[:, None] + np.arange(REACH), np.arange(n, len(ids)))
            met, of_met = np.unique(ids, return_inverse=True)
            vectors = embed[table[met]].sum(axis=1)[of_met]
            tops, raw = [], []
            for f, s in zip(filters, shift):
                total = sum(vectors[j : n + j] @ f[j] for j in range(len(f)))
                total[beyond] = -np.inf
                best = np.maximum.reduceat(total, edges, axis=0)
                row, col = np.nonzero(total == best[seg])
                _, one = np.unique(seg[row] * FILTERS + col, return_index=True)  # the first place of the largest
                tops.append(row[one].reshape(len(of), FILTERS))
                raw.append(best + s)
            raw = np.concatenate(raw, axis=1)
            seen = np.maximum(raw, 0)
            z = seen @ out + bias[0]
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[of]) * weight[of] / len(some)
            back = np.where(raw > 0, g[:, None] * out, 0).reshape(len(of), len(WIDTHS), FILTERS)
            grads = [None, *(np.zeros_like(p) for p in params[1:])]
            grads[-2], grads[-1] = g @ seen, np.array([g.sum()])
            touched, pulls = [], []
            for k, f in enumerate(filters):
                grads[1 + len(WIDTHS) + k] = back[:, k].sum(axis=0)
                for j in range(len(f)):
                    place = tops[k] + j
                    grads[1 + k][j] = np.einsum("bfd,bf->df", vectors[place], back[:, k])
                    touched.append(table[ids[place]].reshape(-1))
                    pulls.append(np.repeat((f[j].T * back[:, k][:, :, None]).reshape(-1, DIM), N_FEATURES, axis=0))
            count += 1
            # one scale for all rows: words that recur in the texts move further than rare ones
            touched = np.concatenate(touched)
            order = np.argsort(touched, kind="stable")
            rows, at_row = np.unique(touched[order], return_index=True)
            g = np.add.reduceat(np.concatenate(pulls)[order], at_row, axis=0)
            g[rows == 0] = 0
            power = float((g**2).mean())
            scale = power if count == 1 else 0.9 * scale + 0.1 * power
            embed[rows] -= EMBED_RATE * g / (math.sqrt(scale) + 1e-8)
            for p, g, (m, v) in zip(params[1:], grads[1:], moments):
                m += 0.1 * (g - m)
                v += 0.01 * (g**2 - v)
                p -= rate * (m / (1 - 0.9**count)) / (np.sqrt(v / (1 - 0.99**count)) + 1e-8)
    model.bias = float(bias[0])

    rows = cal if 0 < y[cal].sum() < len(cal) else kept
    logit, guess = model.scorer().logits([texts[i] for i in rows])
    model.cuts[:] = _best_cut(logit, y[rows])
    for number in range(len(languages)):
        mine = guess == number
        if y[rows][mine].sum() >= 5 and (1 - y[rows][mine]).sum() >= 5:
            model.cuts[number] = _best_cut(logit[mine], y[rows][mine])
    model.wordless = float(model.cuts[-1] - 2)
    return model


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", label_col: str = "toxic", max_toxic: int = 1_500, max_clean: int = 3_000, max_chars: int = 20_000) -> ToxicityModel:
    """Fit on a bounded sample: up to ``max_toxic`` and ``max_clean`` labelled identifiers, by a hash of the
    identifier, and of each at most one text and ``max_chars`` characters of it, which start where the
    hash says. So the driver holds at most 4,500 texts of 20,000 characters.

    Both tables may hold any number of rows for an identifier: its label is the largest, its text that
    with the smallest hash. Null identifiers, labels and texts are left out; equal texts of one label
    count once; ties of the hash go to the smaller identifier. Without a labelled text every score is
    one half at most (see ``fit``). The language column serves the word statistics behind the language
    guess, never a score's input; other columns are ignored.
    """
    told = labels.groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("y")).filter(F.col("y").isNotNull() & F.col("id").isNotNull()).withColumn("draw", F.xxhash64(F.col("id").cast("string"), F.lit("toxicity")))
    sample = told.filter("y > 0").orderBy("draw", "id").limit(max_toxic).union(told.filter("y <= 0").orderBy("draw", "id").limit(max_clean)).select("id", F.col("y").cast("int"), "draw")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).filter(F.col("text").isNotNull())
    one = texts.join(F.broadcast(sample), "id").groupBy("id", "y", "draw").agg(F.min_by(F.struct("text", "lang"), F.struct(F.xxhash64("text"), "text")).alias("t"))
    start = F.pmod(F.col("draw"), F.greatest(F.length("t.text") - max_chars, F.lit(0)) + 1).cast("int") + 1
    part = one.select("draw", "id", F.substring("t.text", start, F.lit(max_chars)).alias("text"), F.col("t.lang").alias("lang"), "y")
    got = part.dropDuplicates(["text", "y"]).toArrow().sort_by([("draw", "ascending"), ("id", "ascending"), ("text", "ascending")])
    return fit(got["text"].to_pylist(), got["y"].to_pylist(), got["lang"].to_pylist())


def toxicity_score(model: ToxicityModel, docs: DataFrame, text_col: str = "text") -> Column:
    """Score of a text column, 0 to 1; the threshold is THRESHOLD. The model is broadcast: no shuffle.

    Null, empty and wordless texts get one score, well below the threshold unless every label the fit
    saw is toxic. Whole texts count, long ones piece by piece. Equal texts, and so repeated rows, get
    equal scores up to the order of sums; an empty table gives no rows; only the text column is read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        scorer = shared.value.scorer()

        def run(texts: list[str | None]) -> dict[str, list]:
            return {"score": scorer.score(texts).tolist()}

        return run

    return text_column_udf("score double", make)(F.col(text_col))["score"]
