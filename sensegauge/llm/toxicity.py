"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Fitting, on the driver, on a bounded sample of labelled rows. All bounds are parameters of ``learn``: ``max_rows`` of each
label, those with the lowest hash of the id (of equal hashes, the lower id); texts over ``max_chars`` are left out of the
sample; the field is fitted on ``max_sentences`` of each of three kinds of sentences of the sample (with toxic words, with
words that are like those, and any), by hash of their place. Sentences of more than ``RUN_WORDS`` words are fitted in runs.

1. Labels are of documents, so tokens are labelled from them: word forms and stems (first bytes of a word) that cover
   the most toxic documents not covered yet, while being rare in clean ones, are picked one by one; words of toxic
   documents with a picked form are toxic tokens.
2. A field with two states over the words of a sentence is fitted to these tokens (Adam on the exact log-likelihood by
   forward-backward): features are the word, those of its stems that were picked, and the words beside it.
3. Sum, maximum and density of the marginals of a document go into a logistic calibration against the document labels.

Scoring sees every word of every text. Only ``text`` is an input of a score; ids choose the sample, labels the targets.

Defined results: null and empty texts have no tokens and get the calibrated score of none; repeated rows are scored
each; very long texts are scored whole; a row without doc_id is scored (it counts as not held out); without labelled rows
of both kinds, or where no form is toxic often enough to be picked, every score is the share of toxic rows (0 where there
is none), and ``reject`` keeps all documents, as such a model tells none apart; of forms that cover as many documents the
one with the lowest code is picked; other columns are ignored by ``score`` and kept by ``reject``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensegauge.llm.kernels import ALNUM_LOWER, Words, bit_table, map_slices, member, mix, slices, text_bytes, tidy

MAX_ROWS = 1500
MAX_CHARS = 100_000
THRESHOLD = 0.3
SPAN_MARGINAL = 0.5
MAX_SENTENCES = 15_000
#: Words of a sentence that are fitted as one run, at most.
RUN_WORDS = 400
#: Bytes of text of which the fit has the tokens at once.
FIT_BYTES = 1 << 18
STEMS = (4, 5, 6, 7)
_PREV, _NEXT = np.uint64(0x51ED270B), np.uint64(0x3C6EF372)


class Tokens:
    """Words of a slice with the codes of their features; sentences end at . ! ? or a new line."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        self.data, self.offsets = data, offsets
        self.words = w = Words(data, offsets, ALNUM_LOWER, STEMS)
        self.n = len(w.codes)
        stop = np.zeros(256, bool)
        stop[list(b".!?\n")] = True
        stops = np.append(0, np.cumsum(stop[data], dtype=np.int64))
        first = np.zeros(self.n, bool)
        first[w.ptr[:-1][w.counts() > 0]] = True
        first[1:] |= stops[w.starts[1:]] > stops[w.ends[:-1]]
        self.begins = np.flatnonzero(first)
        self.sizes = np.diff(np.append(self.begins, self.n))

    def own(self) -> list[np.ndarray]:
        return [self.words.codes, *self.words.prefixes]

    def beside(self) -> list[np.ndarray]:
        inner = np.ones(self.n, bool)
        inner[self.begins] = False
        before, after = np.zeros(self.n, np.uint64), np.zeros(self.n, np.uint64)
        at = np.flatnonzero(inner)
        before[at], after[at - 1] = mix(self.words.codes[at - 1] + _PREV), mix(self.words.codes[at] + _NEXT)
        return [before, after]


class Chain:
    """Forward-backward of two states over sentences; emissions are log-odds of state 1."""

    def __init__(self, sizes: np.ndarray) -> None:
        self.order = np.argsort(-sizes, kind="stable")
        begins = (np.cumsum(sizes) - sizes)[self.order]
        self.n, sizes = int(sizes.sum()), sizes[self.order]
        longest = int(sizes[0]) if len(sizes) else 0
        active = len(sizes) - np.searchsorted(sizes[::-1], np.arange(longest), side="right")
        self.steps = [begins[:m] + t for t, m in enumerate(active.tolist())]

    def run(self, emission: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Marginals of state 1; for scoring moves, the ratios of the forward and backward sums."""
        a01, a10, a11 = np.exp(move)
        e, r, q = np.exp(emission), np.empty(self.n), np.ones(self.n)
        for t, at in enumerate(self.steps):
            if t:
                prev = r[at - 1]
                r[at] = e[at] * (a01 + prev * a11) / (1 + prev * a10)
            else:
                r[at] = e[at]
        for at in self.steps[:0:-1]:
            ahead = e[at] * q[at]
            q[at - 1] = (a10 + a11 * ahead) / (1 + a01 * ahead)
        rq = r * q
        return rq / (1 + rq), r, q

    def moves(self, emission: np.ndarray, move: np.ndarray, r: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Expected counts of the moves 0-1, 1-0 and 1-1."""
        at = np.concatenate([s for s in self.steps[1:]]) if len(self.steps) > 1 else np.zeros(0, np.int64)
        a01, a10, a11 = np.exp(move)
        ahead, behind = np.exp(emission[at]) * q[at], r[at - 1]
        p = np.stack([a01 * ahead, behind * a10, behind * a11 * ahead])
        return (p / (1 + p.sum(0))).sum(1)


class Model:
    """codes (sorted) and weights of features, bias, moves, and the calibration of (log sum, maximum, density)."""

    def __init__(self, codes, weights, bias, move, calibration) -> None:
        self.codes, self.weights, self.bias, self.move, self.calibration = codes, weights, bias, move, calibration
        self.bits = bit_table(codes)
        self.plain: dict[int, tuple[float, float]] = {}

    def emissions(self, tokens: Tokens) -> np.ndarray:
        out = np.full(tokens.n, self.bias)
        if len(self.codes):
            for codes in (*tokens.own(), *tokens.beside()):
                at = member(codes, self.codes, self.bits)
                out[at] += self.weights[np.searchsorted(self.codes, codes[at])]
        return out

    def of_plain(self, size: int) -> tuple[float, float]:
        """Sum and maximum of the marginals of a sentence without features."""
        if size not in self.plain:
            p = Chain(np.array([size])).run(np.full(size, self.bias), self.move)[0]
            if len(self.plain) > 100_000:
                self.plain.clear()
            self.plain[size] = float(p.sum()), float(p.max())
        return self.plain[size]

    def marginals(self, tokens: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Places and marginals of the words of sentences with features; sum and maximum by row over all words."""
        e = self.emissions(tokens)
        rows = np.searchsorted(tokens.words.ptr, tokens.begins, side="right") - 1
        n = len(tokens.offsets) - 1
        total, top = np.zeros(n), np.zeros(n)
        own = np.add.reduceat(e != self.bias, tokens.begins) > 0 if tokens.n else np.zeros(0, bool)
        for size in np.unique(tokens.sizes[~own]).tolist():
            s, m = self.of_plain(size)
            here = rows[~own & (tokens.sizes == size)]
            total += np.bincount(here, minlength=n) * s
            np.maximum.at(top, here, m)
        sizes = tokens.sizes[own]
        at = np.repeat(tokens.begins[own] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        p = Chain(sizes).run(e[at], self.move)[0]
        here = np.repeat(rows[own], sizes)
        total += np.bincount(here, p, minlength=n)
        np.maximum.at(top, here, p)
        return at, p, total, top

    def score(self, total: np.ndarray, top: np.ndarray, words: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(inputs(total, top, words) @ self.calibration)))


def inputs(total: np.ndarray, top: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.stack([np.ones(len(total)), np.log1p(total), top, np.minimum(1, 20 * total / np.maximum(1, words))], 1)


def _distinct(tokens: Tokens, use: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows that are used and the codes of their word forms and stems, each pair once."""
    row, docs, codes = tokens.words.rows(), [], []
    for c in tokens.own():
        at = np.flatnonzero((c != 0) & use[row])
        at = at[np.unique(mix(c[at] + mix(row[at].astype(np.uint64))), return_index=True)[1]]
        docs.append(row[at])
        codes.append(c[at])
    return np.concatenate(docs), np.concatenate(codes)


def picked_forms(parts: Callable[[], Iterator[tuple[int, Tokens]]], toxic: np.ndarray, single: np.ndarray) -> np.ndarray:
    """Sorted codes picked greedily from the documents that are single. parts() gives the first row and the tokens of each slice; toxic
    is the label of each row. Pairs of document and code are kept of toxic documents and frequent forms only."""
    forms, counts = np.zeros(0, np.uint64), np.zeros((2, 0), np.int64)
    for first, tokens in parts():
        docs, codes = _distinct(tokens, single[first:])
        every, at = np.unique(np.concatenate([forms, codes]), return_inverse=True)
        before, at = at[: len(forms)], at[len(forms) :]
        both = np.stack([np.bincount(at[toxic[first + docs] == k], minlength=len(every)) for k in (0, 1)])
        both[:, before] += counts
        forms, counts = every, both
    in_clean, in_toxic = counts
    open_ = toxic & single
    n_toxic, n_clean = int(open_.sum()), int((~open_).sum())
    good = forms[(in_toxic >= 3) & ((in_clean + 0.5) / (n_clean + 1) * 20 < in_toxic / (n_toxic + 1))]
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for first, tokens in parts():
        docs, codes = _distinct(tokens, open_[first:])
        use = np.isin(codes, good)
        found.append((first + docs[use], np.searchsorted(forms, codes[use])))
    docs, code = (np.concatenate(x) for x in zip(*found))
    out = []
    least = max(3, round(0.004 * n_toxic))
    while len(code):
        left = np.bincount(code, minlength=len(forms))
        best = int(np.argmax(left - 8 * in_clean * (n_toxic / n_clean)))
        if left[best] < least:
            break
        out.append(best)
        open_[docs[code == best]] = False
        rest = open_[docs]
        docs, code = docs[rest], code[rest]
    return np.sort(forms[out])


def runs(begins: np.ndarray, sizes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Begins and sizes of sentences, with those of more than ``most`` words cut to runs."""
    n = -(-sizes // most)
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return np.repeat(begins, n) + k * most, np.minimum(np.repeat(sizes, n) - k * most, most)


def fit(rows: list[tuple[str, int]], shares: tuple[float, float] | None = None, steps: int = 120, max_sentences: int = MAX_SENTENCES) -> Model:
    """rows: (text, label). shares: of labels 0 and 1 among all labelled rows, if the sample has other ones."""
    none = np.zeros(0)
    texts, toxic = [r[0] or "" for r in rows], np.array([r[1] == 1 for r in rows], bool)
    rate = shares[1] if shares else float(toxic.mean()) if len(rows) else 0.0
    if not toxic.any() or toxic.all():
        logit = np.log(max(rate, 1e-9) / max(1 - rate, 1e-9))
        return Model(none.astype(np.uint64), none, -20.0, np.zeros(3), np.array([logit, 0, 0, 0]))
    n, sample = len(texts), pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])

    def parts() -> Iterator[tuple[int, Tokens]]:
        """The first row and the tokens of each slice. Tokens take many times the memory of the text, so they are made anew each time."""
        first = 0
        for part in slices(sample, size=FIT_BYTES):
            yield first, Tokens(*text_bytes(part.column("text")))
            first += part.num_rows

    # near copies count as one document: those whose smallest word hash is the same
    least, n_words, n_tokens, begins, sizes = np.zeros(n, np.uint64), np.zeros(n, np.int64), 0, [], []
    for first, tokens in parts():
        w = tokens.words
        some = np.flatnonzero(w.counts() > 0)
        least[first + some] = np.minimum.reduceat(mix(w.codes), w.ptr[some]) if len(some) else 0
        n_words[first : first + len(w.counts())] = w.counts()
        begins.append(n_tokens + tokens.begins)
        sizes.append(tokens.sizes)
        n_tokens += tokens.n
    _, keep = np.unique(np.stack([least, toxic.astype(np.uint64)]), axis=1, return_index=True)
    single = np.zeros(n, bool)
    single[keep] = True
    forms = picked_forms(parts, toxic, single)
    bits, marks, own, beside = bit_table(forms), [], [], []
    for first, tokens in parts():
        mark = np.zeros(tokens.n, bool)
        for c in tokens.own():
            mark[member(c, forms, bits)] = True
        mark &= toxic[first + tokens.words.rows()]
        marks.append(mark)
        own.append(tokens.words.codes[mark])
        beside += [c[mark] for c in tokens.beside()]
    tagged = np.concatenate(marks)
    if not tagged.any():
        return fit([], (1 - rate, rate))

    def often(codes: list[np.ndarray], least: int) -> np.ndarray:
        got, count = np.unique(np.concatenate(codes), return_counts=True)
        return got[(count >= least) & (got != 0)]

    features = np.unique(np.concatenate([forms, often(own, 2), often(beside, 5)]))
    # for each kind of feature, the words that have it, and which it is
    bits, before, hits = bit_table(features), 0, []
    for _, tokens in parts():
        met = [(c, member(c, features, bits)) for c in (*tokens.own(), *tokens.beside())]
        hits.append([(before + hit, np.searchsorted(features, c[hit])) for c, hit in met])
        before += tokens.n
    kinds = [tuple(np.concatenate(x) for x in zip(*kind)) for kind in zip(*hits)]
    begins, run_sizes = runs(np.concatenate(begins), np.concatenate(sizes), RUN_WORDS)
    sentence = np.repeat(np.arange(len(begins)), run_sizes)
    has_own = np.zeros(n_tokens, bool)
    for hit, _ in kinds[: 1 + len(STEMS)]:
        has_own[hit] = True
    toxic_s, near_s = np.unique(sentence[tagged]), np.unique(sentence[has_own & ~tagged])
    some_of = lambda x, m: x[np.argsort(mix(x.astype(np.uint64)), kind="stable")[:m]]
    use = np.unique(np.concatenate([some_of(x, max_sentences) for x in (toxic_s, near_s, np.arange(len(begins)))]))
    sizes = run_sizes[use]
    at = np.repeat(begins[use] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    y = tagged[at].astype(float)
    place = np.full(n_tokens, -1)
    place[at] = np.arange(len(at))
    where, which = (np.concatenate(x) for x in zip(*((place[hit][place[hit] >= 0], code[place[hit] >= 0]) for hit, code in kinds)))
    del sentence, has_own, tagged, place, kinds, hits, marks, own, beside, begins, run_sizes
    tidy()
    chain = Chain(sizes)
    inner = np.concatenate(chain.steps[1:]) if len(chain.steps) > 1 else np.zeros(0, np.int64)
    moved = np.array([((1 - y[inner - 1]) * y[inner]).sum(), (y[inner - 1] * (1 - y[inner])).sum(), (y[inner - 1] * y[inner]).sum()])
    theta = np.concatenate([np.zeros(len(features)), [-4.0], np.zeros(3)])
    m, v, d = np.zeros_like(theta), np.zeros_like(theta), 1e-3
    for step in range(1, steps + 1):
        e = theta[-4] + np.bincount(where, theta[which], minlength=len(at))
        p, r, q = chain.run(e, theta[-3:])
        slope = np.concatenate([np.bincount(which, (y - p)[where], minlength=len(features)), [(y - p).sum()], moved - chain.moves(e, theta[-3:], r, q)])
        slope[:-4] -= 0.1 * theta[:-4]
        slope[-3:] -= 0.1 * theta[-3:]
        m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope**2
        theta += 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + d)
        theta = np.clip(theta, -12, 12)
    heavy = np.abs(theta[:-4]) > 1e-3
    model = Model(features[heavy], theta[:-4][heavy], float(theta[-4]), theta[-3:], np.zeros(4))
    total, top = (np.concatenate(x) for x in zip(*(model.marginals(tokens)[2:] for _, tokens in parts())))
    x, t = inputs(total, top, n_words), toxic.astype(float)
    weight = np.where(toxic, rate / toxic.mean(), (1 - rate) / (1 - toxic.mean()))
    beta = np.zeros(4)
    ridge = np.diag([1e-6, 0.3, 0.3, 0.3])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge
        beta = beta + np.clip(np.linalg.solve(h, x.T @ (weight * (t - p)) - ridge @ beta), -3, 3)
    model.calibration = beta
    return model


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, max_chars: int = MAX_CHARS, max_sentences: int = MAX_SENTENCES) -> Model:
    """Fits on labelled rows that are not held out: max_rows of each label at most, whichever have the lowest hash.

    The ids of the sample are bounded, so they are what is broadcast; texts of the sample only come to the driver.
    """
    labelled = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    counts = {r[0]: r[1] for r in labelled.groupBy("toxic").count().collect()}
    part = lambda k: labelled.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    ids = part(0).unionByName(part(1)).withColumnRenamed("doc_id", "label_id")
    texts = docs.where(F.length("text") <= max_chars).select("doc_id", "text")
    rows = texts.join(F.broadcast(ids), F.col("doc_id") == F.col("label_id")).groupBy("doc_id").agg(F.first("text"), F.max("toxic")).orderBy("doc_id").collect()
    total = sum(counts.values())
    model = fit([(r[1], r[2]) for r in rows], tuple(counts.get(k, 0) / total for k in (0, 1)) if total else None, max_sentences=max_sentences)
    del rows
    tidy()  # the driver keeps the model only
    return model


def scorer(sent):
    def make():
        model: Model = sent.value

        def of(part: pa.RecordBatch) -> pa.RecordBatch:
            data, offsets = text_bytes(part.column("text"))
            tokens = Tokens(data, offsets)
            at, p, total, top = model.marginals(tokens)
            w = tokens.words
            score = model.score(total, top, w.counts())
            hot = p >= SPAN_MARGINAL
            at, p = at[hot], p[hot]
            spans: list[list] = [[] for _ in range(len(offsets) - 1)]
            if len(at):
                # code points before each byte
                points = np.append(0, np.cumsum((data & 0xC0) != 0x80))
                rows = np.searchsorted(w.ptr, at, side="right") - 1
                start, end = points[w.starts[at]] - points[offsets[rows]], points[w.ends[at]] - points[offsets[rows]]
                last = None
                for r, i, s, e, x in zip(rows.tolist(), at.tolist(), start.tolist(), end.tolist(), p.tolist(), strict=True):
                    if last == (r, i - 1) and not sentence_starts(tokens, i):
                        spans[r][-1]["stop"], spans[r][-1]["marginal"] = e, max(spans[r][-1]["marginal"], x)
                    else:
                        spans[r].append({"start": s, "stop": e, "marginal": x})
                    last = (r, i)
            kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("marginal", pa.float64())]))
            columns = [c for c in part.schema.names if c != "text"]
            return pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), part.column("text"), pa.array(score), pa.array(spans, kind)], [*columns, "text", "score", "spans"])

        return of

    return make


def sentence_starts(tokens: Tokens, i: int) -> bool:
    at = np.searchsorted(tokens.begins, i)
    return bool(at < len(tokens.begins) and tokens.begins[at] == i)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, text, score (0 to 1) and spans (start, stop in code points, marginal) of docs' texts."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.select("doc_id").schema["doc_id"].dataType.simpleString()
    return map_slices(docs.select("doc_id", "text"), scorer(sent), f"doc_id {kind}, text string, score double, spans array<struct<start: long, stop: long, marginal: double>>")


def reject(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with all their columns, that score below the threshold."""
    model = learn(docs, labels)
    if not len(model.codes):
        return docs
    kept = [c for c in docs.columns if c not in ("doc_id", "text")]
    packed = docs.select(F.struct("doc_id", *kept).alias("doc_id"), "text")
    scored = score(packed, model).where(F.col("score") < threshold)
    return scored.select("doc_id.doc_id", "text", *(F.col("doc_id")[c].alias(c) for c in kept)).select(*docs.columns)
