"""Toxicity: a support vector machine over a gapped-subsequence string kernel.

The kernel of two words sums, over all subsequences of ``ORDER`` letters they share, the decay
``DECAY`` to the power of the letters each occurrence spans in either word. So "idxiot" and
"i.d.i.o.t" stay close to "idiot". A text is described by the normalised kernel of each landmark
and the best stretch of its words; the inverse square root of the landmarks' own kernel matrix (Nystroem)
maps these to the features of a linear support vector machine.

Words are runs of letters after lower-casing. What stands between white space counts joined,
with characters that are not letters left out, and so does each run of letters in it, alone and
joined with what follows; single letters in a row are joined. Where words can't be told apart, in
runs longer than a window and in scripts without spaces, one may begin at every letter; every
word of a text counts. Only words that share most of a landmark's neighbouring letter
pairs (allowing two letters between) are measured against it; the others score zero. A word that
lacks a letter of the landmark, or has two in another order, scores zero, too.

Training reads labelled rows outside the held-out quarter only (crc32 of the id as text, mod
4, equal to 2), at most ``CLASS_ROWS`` per label by hash of the id, and their texts alone.
Landmarks are the words that tell the labels apart best, none close to another. Insults with
inserted characters are added to clean training texts as further toxic rows. The margin is
turned into a probability by a logistic fit.

Defined cases: a null or empty text has no words and gets the score of no evidence; a null id
counts as the text '' and is not held out; repeated rows are scored each; extra columns are
ignored; without labels of both kinds every score is 0; an empty table gives an empty one.
"""

from __future__ import annotations

import random
import re

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowquarry.llm.common import map_rows, settled, table

ORDER = 3
DECAY = 0.6
LANDMARKS = 48
#: Likeness up to here is that of any two words and counts as none, unless all letters are there.
FLOOR = 0.5
#: Standard errors by which a landmark's log-odds must exceed zero.
CERTAINTY = 3.0
#: Least log-odds of a landmark.
LEAST_ODDS = 3.0
#: Beginnings of words, so many letters long, are landmarks too: stems with any ending.
STEMS = range(4, 8)
#: Labelled rows of each kind that training reads.
CLASS_ROWS = 2000
#: Words that training considers for landmarks, and the rows they must occur in.
CANDIDATES = 3000
LEAST_ROWS = 3
THRESHOLD = 0.3
HELD_OUT = 2
#: Stands before the first letter of words and landmarks: stems count where words begin.
START = "^"
#: Letters of a window with its START, and of the step between windows where words can't be told apart.
WINDOW, STEP = 24, 1
#: Words remembered per worker; the memory is emptied when full.
MEMORY = 1 << 20
PAIR_BITS = 512
LETTERS = re.compile(r"[^\W\d_]+")
OTHERS = re.compile(r"[\W\d_]+")
#: Thai to Tibetan, Burmese, Khmer, kana, Han: scripts without spaces between words.
UNSPACED = re.compile("[\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
SPACED = re.compile(r"(?<!\S)[^\W\d_](?:\s+[^\W\d_](?!\S)){2,}")


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == HELD_OUT


def words_of(text: str) -> set[str]:
    """Distinct words: tokens, the letter runs inside them, and single letters in a row joined."""
    low = text.lower()
    found = set(low.split())
    for token in [w for w in found if not w.isalpha()]:
        runs = LETTERS.findall(token)
        joined, at = "".join(runs), 0
        for run in runs:
            found.update((run, joined[at : at + WINDOW - 1]))
            at += len(run)
    found.update(OTHERS.sub("", m.group()) for m in SPACED.finditer(low))
    return found


def letters(word: str) -> str:
    return word if word.isalpha() else OTHERS.sub("", word)


def windows(run: str) -> list[str]:
    """Stretches that begin at every letter, without START."""
    return [run[i : i + WINDOW - 1] for i in range(0, max(1, len(run) - ORDER + 1), STEP)]


def undivided(word: str) -> bool:
    """Whether words may begin inside a run of letters."""
    return word.isalpha() and (len(word) >= WINDOW or not word.isascii() and UNSPACED.search(word) is not None)


def put_in(word: str, landmark: str) -> int | None:
    """The fewest letters that stand between those of the landmark, None if one is missing."""
    least, at = None, word.find(landmark[0])
    while at >= 0:
        end = at
        for ch in landmark[1:]:
            end = word.find(ch, end + 1)
            if end < 0:
                return least
        gaps = end - at + 1 - len(landmark)
        least = gaps if least is None else min(least, gaps)
        at = word.find(landmark[0], at + 1)
    return least


def coded(words: list[str], width: int) -> np.ndarray:
    """Code points by row, zero beyond a word's end."""
    return np.array(words, f"<U{width}").view("<u4").reshape(len(words), width).astype(np.int64) if words else np.zeros((0, width), np.int64)


def subsequence_kernel(s: np.ndarray, t: np.ndarray, order: int = ORDER, decay: float = DECAY) -> np.ndarray:
    """Row by row: the gap-weighted subsequence kernel of two matrices of code points.

    ``ends[i, j]`` is the weight of shared subsequences that end at letters i and j. All
    that end before them are sums with powers of the decay, that is, products with
    triangular matrices on both sides.
    """
    n, m = s.shape[1], t.shape[1]

    def decays(k: int) -> np.ndarray:
        i = np.arange(k)
        return np.where(i[:, None] >= i[None, :], decay ** np.maximum(i[:, None] - i[None, :], 0), 0.0)

    left, right = decays(n), decays(m).T
    same = (s[:, :, None] == t[:, None, :]) & (s[:, :, None] != 0)
    ends = decay * decay * same
    for _ in range(order - 1):
        sums = left @ ends @ right
        earlier = np.zeros_like(ends)
        earlier[:, 1:, 1:] = sums[:, :-1, :-1]
        ends = decay * decay * same * earlier
    return ends.sum((1, 2))


def pair_marks(codes: np.ndarray, reach: int) -> np.ndarray:
    """Which hashed pairs of letters at most ``reach`` apart each word holds."""
    marks = np.zeros((len(codes), PAIR_BITS), np.float32)
    rows = np.arange(len(codes))
    for gap in range(1, reach + 1):
        for i in range(codes.shape[1] - gap):
            a, b = codes[:, i], codes[:, i + gap]
            there = b != 0
            marks[rows[there], (a[there] * 31 + b[there] * 7) % PAIR_BITS] = 1
    return marks


class Landmarks:
    """Likeness of words to landmark words: the normalised kernels of their best stretch.

    Half of it is the kernel of order ``ORDER``, half that of the landmark's whole length,
    which is the decay to the power of the letters put in, or 0 if one is missing. Of this the
    floor is taken off, but where no letter is missing, likeness is the decay at least, however
    many are put in.
    """

    def __init__(self, words: list[str]):
        self.words = words
        self.width = max(map(len, words))
        self.codes = coded(words, self.width)
        self.lengths = np.array([len(w) for w in words])
        self.own = subsequence_kernel(self.codes, self.codes)
        self.marks = pair_marks(self.codes, 1)
        self.needed = np.ceil(0.6 * self.marks.sum(1))

    def likeness(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word, landmark, likeness) of the pairs that are measured, from 0 at FLOOR to 1."""
        codes = coded(words, WINDOW)
        near = [np.zeros((0, 2), int)]
        for start in range(0, len(words), 8192):
            shared = pair_marks(codes[start : start + 8192], 3) @ self.marks.T
            near.append(np.argwhere(shared >= self.needed) + [start, 0])
        w, l = np.concatenate(near).T
        # Stretches of the landmark's length, and of two letters more for letters put in.
        pair, stretch = [], []
        for p, (i, j) in enumerate(zip(w.tolist(), l.tolist())):
            word, k = words[i], len(self.words[j])
            cuts = {word[c : c + size] for size in (k, k + 2) for c in range(max(1, len(word) - size + 1))}
            pair += [p] * len(cuts)
            stretch += cuts
        pair = np.array(pair, int)
        value, gaps = np.zeros(len(w)), [put_in(words[i], self.words[j]) for i, j in zip(w.tolist(), l.tolist())]
        decayed = np.array([0.0 if g is None else DECAY**g for g in gaps])
        for start in range(0, len(pair), 4096):
            part = pair[start : start + 4096]
            cut = coded(stretch[start : start + 4096], self.width + 2)
            like = subsequence_kernel(cut, self.codes[l[part]]) / np.sqrt(np.maximum(subsequence_kernel(cut, cut), 1e-12) * self.own[l[part]])
            for k in np.unique(self.lengths[l[part]]):
                rows = np.flatnonzero(self.lengths[l[part]] == k)
                whole = subsequence_kernel(cut[rows], self.codes[l[part][rows]], int(k)) / DECAY ** (2 * k)
                like[rows] = (like[rows] + np.minimum(whole, 1.0)) / 2
            np.maximum.at(value, part, like)
        return w, l, np.maximum(np.maximum(value - FLOOR, 0) / (1 - FLOOR), decayed)

    def gram(self) -> np.ndarray:
        k = len(self.words)
        i, j = np.divmod(np.arange(k * k), k)
        value = subsequence_kernel(self.codes[i], self.codes[j]).reshape(k, k)
        return value / np.sqrt(self.own[:, None] * self.own[None, :])


class Describer:
    """The likeness of a text's best word to each landmark, for many texts at a time."""

    def __init__(self, landmarks: Landmarks):
        self.landmarks = landmarks
        self.known: dict[str, tuple | None] = {}

    def _learn(self, new: list[str]) -> None:
        if len(self.known) + len(new) > MEMORY:
            self.known.clear()
        pieces, owner = [], []
        for word in new:
            self.known[word] = None
            plain = letters(word)
            if len(plain) >= ORDER:
                for piece in windows(plain) if undivided(word) else [plain[: WINDOW - 1]]:
                    pieces.append(START + piece)
                    owner.append(word)
        best: dict[str, dict[int, float]] = {}
        for w, l, v in zip(*(a.tolist() for a in self.landmarks.likeness(pieces))):
            if v > 0:
                mine = best.setdefault(owner[w], {})
                mine[l] = max(v, mine.get(l, 0.0))
        for word, found in best.items():
            self.known[word] = (list(found), list(found.values()))

    def __call__(self, texts: list[str]) -> np.ndarray:
        each = [words_of(t) for t in texts]
        new = list({w for words in each for w in words if w not in self.known})
        if len(self.known) + len(new) > MEMORY:
            self.known.clear()
            new = list(set().union(*each))
        if new:
            self._learn(new)
        out = np.zeros((len(texts), len(self.landmarks.words)))
        for row, words in zip(out, each):
            for w in words:
                found = self.known[w]
                if found is not None:
                    at = found[0]
                    row[at] = np.maximum(row[at], found[1])
        return out


class Machine:
    """A linear support vector machine on Nystroem features, with a logistic fit of its margin."""

    def __init__(self, landmarks: Landmarks, x: np.ndarray, y: np.ndarray, toxic_share: float):
        values, vectors = np.linalg.eigh(landmarks.gram())
        self.map = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-2))) @ vectors.T
        z = np.hstack([x @ self.map, np.ones((len(x), 1))])
        sign = np.where(y > 0, 1.0, -1.0)
        share = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y <= 0).sum(), 1))
        w = np.zeros(z.shape[1])
        ridge = 1e-4 * np.eye(len(w))
        ridge[-1, -1] = 1e-9
        for _ in range(60):  # Newton steps on the squared hinge
            active = sign * (z @ w) < 1
            za, sa = z[active], share[active]
            step = np.linalg.solve((za * sa[:, None]).T @ za + ridge, (za * sa[:, None]).T @ sign[active])
            if np.abs(step - w).max() < 1e-9:
                break
            w = step
        self.weights = w
        # Logistic fit of the margin: two parameters, by Newton steps, targets kept off 0 and 1.
        margin = z @ w
        target = np.where(y > 0, 1 - 1 / ((y > 0).sum() + 2), 1 / ((y <= 0).sum() + 2))
        rows = np.where(y > 0, toxic_share / max((y > 0).sum(), 1), (1 - toxic_share) / max((y <= 0).sum(), 1))
        a, b = 4.0, 0.0
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(a * margin + b, -35, 35)))
            g = np.array([(rows * (p - target) * margin).sum() + 1e-5 * a, (rows * (p - target)).sum()])
            v = rows * np.maximum(p * (1 - p), 1e-9)
            h = np.array([[(v * margin * margin).sum() + 1e-5, (v * margin).sum()], [(v * margin).sum(), v.sum() + 1e-9]])
            change = np.clip(np.linalg.solve(h, g), -1, 1)
            a, b = a - change[0], b - change[1]
            if np.abs(change).max() < 1e-8:
                break
        self.scale, self.shift = a, b

    def score(self, x: np.ndarray) -> np.ndarray:
        margin = x @ self.map @ self.weights[:-1] + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(self.scale * margin + self.shift, -35, 35)))


def least_shingle(text: str) -> int:
    words = text.encode().split()
    least = min([xxhash.xxh64_intdigest(b" ".join(s)) for s in zip(words, words[1:], words[2:])], default=xxhash.xxh64_intdigest(b" ".join(words)))
    return least >> 1


def disguised(word: str, rng: random.Random) -> str:
    """A word as it is, with one or two letters put in, or with signs or spaces between them."""
    way = rng.randrange(-3, 4)
    if way < 0:
        return word
    if way == 0:
        return rng.choice(".*-_").join(word)
    if way == 1:
        return " ".join(word)
    out = list(word)
    for _ in range(1 + (len(word) > 5 and way == 3)):
        out.insert(rng.randrange(1, len(out)), rng.choice("aeiounrstlx"))
    return "".join(out)


def chosen_landmarks(rated: list[tuple[str, int, int]], toxic: int, clean: int) -> list[str]:
    """Words that occur in toxic rows rather than clean ones, none much like another."""
    odds = lambda a, b: np.log((a + 0.5) / (toxic + 1)) - np.log((b + 0.5) / (clean + 1))
    sure = [r for r in rated if odds(r[1], r[2]) > max(LEAST_ODDS, CERTAINTY * np.sqrt(1 / (r[1] + 0.5) + 1 / (r[2] + 0.5)))]
    order = [r[0] for r in sorted(sure, key=lambda r: (-r[1] * odds(r[1], r[2]), -len(r[0]), r[0]))]
    chosen: list[str] = []
    for word in order:
        if len(chosen) == LANDMARKS:
            break
        if not chosen or max(Landmarks(chosen).likeness([word])[2].max(initial=0.0), Landmarks([word]).likeness(chosen)[2].max(initial=0.0)) < 0.4:
            chosen.append(word)
    return chosen


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> tuple[Landmarks, Machine] | None:
    """Landmarks and machine from a bounded sample of the labelled rows that aren't held out."""
    usable = labels.filter(~held_out(F.col(id_col)) & F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    rated = usable.groupBy(id_col).agg(F.max(label_col).alias("_toxic")).withColumn("_hash", F.xxhash64(id_col))
    part = lambda k: rated.filter(F.col("_toxic") == k).orderBy("_hash", id_col).limit(CLASS_ROWS)
    # At most two times CLASS_ROWS ids: small enough to send to every task.
    sample = part(1).unionByName(part(0)).select(F.col(id_col).alias("_id"), "_toxic").toArrow()
    if not sample.num_rows:
        return None
    chosen = docs.sparkSession.createDataFrame(sample.to_pandas())
    texts = docs.select(id_col, text_col).join(F.broadcast(chosen), F.col(id_col) == F.col("_id")).select(id_col, "_toxic", text_col)
    # Copies and near copies are no further evidence: one row for each least shingle.
    types = dict(docs.dtypes)[id_col]
    texts = map_rows(texts, lambda: lambda *rows: [(i, k, t, least_shingle(t or "")) for i, k, t in zip(*rows)], f"{id_col} {types}, _toxic long, {text_col} string, _least long")
    texts = settled(texts.dropDuplicates(["_toxic", "_least"]))

    def make():
        def work(ids, toxic, bodies):
            out = []
            for k, t in zip(toxic, bodies):
                words = words_of(t or "")
                plain = {START + letters(w) for w in words}
                stems = {w[: n + 1] for w in plain for n in STEMS if len(w) > n + 1}
                stems |= {START + p[:n] for w in words if undivided(w) for p in windows(w) for n in (ORDER, *STEMS) if len(p) >= n}
                out += [(w, k) for w in plain | stems if ORDER < len(w) <= WINDOW]
            return out

        return work

    counts = map_rows(texts.select(id_col, "_toxic", text_col), make, "word string, toxic long").groupBy("word")
    counts = counts.agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b"))
    sizes = texts.groupBy("_toxic").count().collect()
    n = {int(r[0]): r[1] for r in sizes}
    if not n.get(0) or not n.get(1):
        return None
    odds = F.log((F.col("a") + 0.5) / (n[1] + 1)) - F.log((F.col("b") + 0.5) / (n[0] + 1))
    best = counts.filter(F.col("a") >= min(LEAST_ROWS, n[1])).orderBy((F.col("a") * odds).desc(), "word").limit(CANDIDATES)
    found = chosen_landmarks([tuple(r) for r in best.collect()], n[1], n[0])
    if not found:
        return None
    landmarks = Landmarks(found)

    def describe():
        describer = Describer(landmarks)
        return lambda ids, toxic, bodies: [(i, k, v.tolist()) for i, k, v in zip(ids, toxic, describer([t or "" for t in bodies]))]

    kind = dict(docs.dtypes)[id_col]
    rows = map_rows(texts.select(id_col, "_toxic", text_col), describe, f"id {kind}, toxic long, x array<double>").orderBy("id", "toxic", F.hash("x")).toArrow()
    y = rows["toxic"].to_numpy().astype(int)
    x = np.array(rows["x"].to_pylist(), float).reshape(len(y), -1)
    # Clean texts with one insult each, plain or disguised, are toxic, too.
    rng = random.Random(3)
    clean = np.flatnonzero(y == 0)
    insults = [disguised(rng.choice(found)[len(START) :], rng) for _ in clean]
    added = np.maximum(x[clean[: len(insults)]], Describer(landmarks)(insults)) if insults else x[:0]
    # A disguise that no longer resembles anything teaches nothing.
    added = added[(added > 0.3).any(1)]
    # The probability is that of the labelled rows as they are, not of the balanced sample.
    shares = {int(r[0]): r[1] for r in rated.groupBy("_toxic").count().collect()}
    share = shares[1] / (shares[0] + shares[1])
    return landmarks, Machine(landmarks, np.vstack([x, added]), np.r_[y, np.ones(len(added), int)], share)


def scores(docs: DataFrame, model: tuple[Landmarks, Machine] | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every text."""

    def make():
        describer = Describer(model[0]) if model else None

        def work(ids, bodies):
            if model is None:
                return [(i, 0.0) for i in ids]
            return list(zip(ids, model[1].score(describer([t or "" for t in bodies])).tolist()))

        return work

    kind = dict(docs.dtypes)[id_col]
    return map_rows(docs.select(id_col, text_col), make, f"{id_col} {kind}, score double")


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    scored = scores(docs, train(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, training: DataFrame | None = None, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The documents scored below the threshold, all columns kept; texts aren't shuffled.

    ``training`` holds the texts that labels refer to, ``docs`` itself if not given.
    """
    model = train(docs if training is None else training, labels)
    if model is None:
        return docs
    at = docs.columns.index(text_col)

    def make():
        describer = Describer(model[0])

        def work(*columns):
            rows = list(zip(*columns))
            score = model[1].score(describer([t or "" for t in columns[at]])) if rows else []
            return [r for r, s in zip(rows, score) if s < threshold]

        return work

    return map_rows(docs, make, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learnt from the labelled ones."""
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERY = op5_toxicity
