"""Toxicity by weak supervision: many voters, a generative label model over them, a linear classifier on its posteriors.

Lexicons are fixed (insults, abuse of groups, profanity, hate, threats, dismissals in four languages) or induced from
labelled rows: words and word beginnings that toxic rows hold far more often. Voters look at hits of each lexicon, how
many and how dense they are, and at patterns of address, shouting and masked letters. The label model is fitted by expectation maximisation on the counts of vote patterns of all documents, anchored by those of labelled rows:
it estimates how often each voter fires in each class, finds voters that depend on each other given the class, and gives
such groups a joint table. Its posteriors, together with the given label as one more voter of estimated accuracy, train
a logistic regression on votes, densities and the induced terms themselves, each with a weight of its own.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from cueframe.llm.common import buffers, id_crc, id_text, read, slices, staged, words

MAX_LABELLED = 20_000  # labelled rows to learn from, the first in hash order: the bound of everything that is collected
STRONG, WEAK = 4.0, 2.0  # log-odds of an induced feature
THRESHOLD = 0.7
EDGES = b".,!?;:\"'()[]{}*_-#%&$|<>/\\"
KINDS = 4  # whole words, and beginnings of 4, 5 and 6 bytes
#: Words of abuse in four languages, by lexicon.
LEXICONS = {
    "insult": "asshole bastard bitch clown coward creep cretin degenerate disgusting dumb dumbass fool freak garbage idiot idiotic imbecile jerk liar loser lunatic "
    "moron moronic pathetic psycho retard scumbag stupid useless worthless "
    "arschloch blödmann dummkopf drecksau idioten lügner missgeburt schwachkopf trottel versager vollidiot wertlos widerlich "
    "abruti bouffon clochard connard connasse crétin débile imbécile minable salaud salope "
    "cabrón estúpido gilipollas idiota inútil patético payaso tonto asqueroso",
    "abuse": "maggot maggots parasite parasites pig pigs scum subhuman trash vermin filth filthy abschaum ungeziefer untermensch gesindel ordure pourriture raclure racaille vermine basura cerdo escoria alimaña",
    "profanity": "bullshit crap damn fuck fucked fucker fucking shit shitty scheiße scheiss verdammt merde putain bordel mierda joder puta",
    "hate": "hate hated hates despise despised loathe loathed hasse hasst verachte déteste détestes méprise odio odias desprecio",
    "threat": "kill killed hurt destroy strangle punch burn rot töten umbringen verrecke verreck tuer crève brûler matar muérete pudrirte",
}
#: Words in a row that address somebody, and that dismiss somebody.
ADDRESS = ("you are", "you're", "ur a", "du bist", "ihr seid", "tu es", "vous êtes", "t'es", "eres un", "eres una", "sois unos")
DISMISS = ("shut up", "get lost", "drop dead", "go away", "screw you", "halt maul", "verpiss dich", "hau ab", "ferme la", "dégage", "cállate", "lárgate", "vete a")
VOTERS = (
    "word>0", "word>1", "word>3", "begin4>1", "begin5>1", "begin6>1", "weak>2", "dense", "insult>0", "insult>1", "abuse", "profanity", "hate", "threat", "addressed insult", "dismissal", "shouting", "exclaims", "masked",
    "no hit",
)
DENSE = 2 * KINDS + 3  # real-valued features besides the votes


_KNOWN = {w.encode(): i for i, x in enumerate(LEXICONS.values()) for w in x.split()}
_MASKED = re.compile(rb"[a-z]+[*@$#]+[a-z]+")


def _hashes(distinct: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit features of each distinct word, KINDS columns (0: none), its lexicon (-1: none), and whether it is masked."""
    from xxhash import xxh3_64_intdigest as h

    out, known, masked = np.zeros((len(distinct), KINDS), np.uint64), np.full(len(distinct), -1), np.zeros(len(distinct), bool)
    for i, w in enumerate(distinct):
        w = w.strip(EDGES)
        if w:
            n = len(w)
            out[i] = (h(w), h(w[:4], 4) if n > 4 else 0, h(w[:5], 5) if n > 5 else 0, h(w[:6], 6) if n > 6 else 0)
            known[i] = _KNOWN.get(w, -1)
            masked[i] = not w.isalpha() and _MASKED.fullmatch(w) is not None
    return out, known, masked


def _phrases(index: np.ndarray, distinct: list[bytes], row: np.ndarray, rows: int) -> list[np.ndarray]:
    """How often each row holds one of the phrases of ADDRESS, and of DISMISS; a phrase has one or two words."""
    number = {w: i + 1 for i, w in enumerate(sorted({w for p in (*ADDRESS, *DISMISS) for w in p.encode().split()}))}
    code = np.fromiter((number.get(w.strip(EDGES), 0) for w in distinct), np.int64, len(distinct))
    codes = np.append(code[index], 0) if len(index) else np.zeros(1, np.int64)
    at = np.flatnonzero(codes)
    after = np.where(np.append(row, -1)[np.minimum(at + 1, len(row))] == row[at], codes[np.minimum(at + 1, len(row))], 0) if len(at) else at
    out, size = [], len(number) + 1
    for phrases in (ADDRESS, DISMISS):
        numbers = [[number[w] for w in p.encode().split()] for p in phrases]
        hit = np.isin(codes[at], [x[0] for x in numbers if len(x) == 1]) | np.isin(codes[at] * size + after, [x[0] * size + x[1] for x in numbers if len(x) == 2])
        out.append(np.bincount(row[at[hit]], minlength=rows))
    return out


@dataclass
class Lexicon:
    """Induced features by kind: sorted hashes, and which of them are strong."""

    hashes: list[np.ndarray] = field(default_factory=lambda: [np.zeros(0, np.uint64)] * KINDS)
    strong: list[np.ndarray] = field(default_factory=lambda: [np.zeros(0, bool)] * KINDS)

    def find(self, kind: int, values: np.ndarray) -> np.ndarray:
        """Place of each value among the features of a kind, or -1."""
        known = self.hashes[kind]
        if not len(known):
            return np.full(len(values), -1)
        at = np.minimum(np.searchsorted(known, values), len(known) - 1)
        return np.where(known[at] == values, at, -1)


def _views(text: pa.Array, lexicon: Lexicon) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """Vote masks, dense features, and the distinct (row, feature) pairs of induced hits, for each text."""
    index, distinct, per_row = words(text)
    hashed, known, masked = _hashes(distinct)
    rows, size = len(per_row), max(1, sum(map(len, lexicon.hashes)))
    row = np.repeat(np.arange(rows), per_row)
    strong, weak, pairs, base = np.zeros((rows, KINDS)), np.zeros((rows, KINDS)), [], 0
    for kind in range(KINDS):
        at = lexicon.find(kind, hashed[:, kind])[index] if len(index) else np.zeros(0, int)
        hit = at >= 0
        sure = np.zeros(len(at), bool)
        sure[hit] = lexicon.strong[kind][at[hit]]
        strong[:, kind] = np.bincount(row[sure], minlength=rows)
        weak[:, kind] = np.bincount(row[hit], minlength=rows)
        pairs.append(np.unique(row[hit] * size + base + at[hit]))
        base += len(lexicon.hashes[kind])
    which = known[index] if len(index) else np.zeros(0, int)
    insult, abuse, profanity, hate, threat = (np.bincount(row[which == k], minlength=rows) for k in range(len(LEXICONS)))
    insult = insult + abuse
    share = weak.max(axis=1) / np.maximum(per_row, 1)
    raw, offsets = buffers(text)
    upper, letters = _per_row((raw >= 65) & (raw <= 90), offsets), _per_row(((raw | 32) >= 97) & ((raw | 32) <= 122), offsets)
    shout = (upper > 20) & (3 * upper > letters)
    marks = np.zeros(len(raw), bool)
    marks[1:] = (raw[1:] == 33) & (raw[:-1] == 33)
    address, dismissal = _phrases(index, distinct, row, rows)
    hidden = np.bincount(row[masked[index]], minlength=rows) if len(index) else np.zeros(rows)
    votes = [
        strong[:, 0] > 0, strong[:, 0] > 1, strong[:, 0] > 3, strong[:, 1] > 1, strong[:, 2] > 1, strong[:, 3] > 1, weak.max(axis=1) > 2, share > 0.02, insult > 0, insult > 1, abuse > 0, profanity > 0, hate > 0, threat > 0,
        (address > 0) & (insult > 0), dismissal > 0, shout, _per_row(marks, offsets) > 1, hidden > 0, (weak.sum(axis=1) + insult) == 0,
    ]
    mask = sum(np.asarray(v, bool).astype(np.int64) << i for i, v in enumerate(votes)) if rows else np.zeros(0, np.int64)
    dense = np.column_stack([np.log1p(strong), np.log1p(weak), np.log1p(insult), np.sqrt(share), np.sqrt(strong.max(axis=1) / np.maximum(per_row, 1))]) if rows else np.zeros((0, DENSE))
    found = np.concatenate(pairs)
    return mask, dense, (found // size, found % size)


def _per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    ahead = np.concatenate([[0], np.cumsum(flags)])
    return ahead[offsets[1:]] - ahead[offsets[:-1]]


# --- the label model -------------------------------------------------------------------------------------------------


@dataclass
class LabelModel:
    """P(toxic) and, for each group of dependent voters, P(votes | class)."""

    prior: float
    groups: list[list[int]]
    tables: list[np.ndarray]

    def posterior(self, masks: np.ndarray) -> np.ndarray:
        logit = np.full(len(masks), math.log(self.prior / (1 - self.prior)))
        for g, t in zip(self.groups, self.tables, strict=True):
            votes = _votes(masks, g)
            logit += np.log(t[1][votes]) - np.log(t[0][votes])
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def _votes(masks: np.ndarray, group: list[int]) -> np.ndarray:
    return sum(((masks >> v) & 1) << k for k, v in enumerate(group))


def fit_labels(masks: np.ndarray, counts: np.ndarray, known: np.ndarray, rounds: int = 25, tie: float = 0.3, most: int = 5) -> LabelModel:
    """masks: distinct vote patterns; counts: documents with each; known: labelled rows with each, by class (2 columns).

    Labelled rows weigh as much as all others together, so that the classes stay those of the labels.
    """
    known = known * max(1.0, counts.sum() / max(1, known.sum()))
    fires = np.array([(masks >> v) & 1 for v in range(len(VOTERS))], float)

    def tables(groups: list[list[int]], weight: np.ndarray) -> list[np.ndarray]:
        out = []
        for g in groups:
            v = _votes(masks, g)
            t = np.array([np.bincount(v, weight[:, y], 1 << len(g)) for y in (0, 1)]) + 1.0
            out.append(t / t.sum(axis=1, keepdims=True))
        return out

    groups = [[v] for v in range(len(VOTERS))]
    weight = known.astype(float)
    for step in range(2):
        for _ in range(rounds):
            prior = float(np.clip(weight[:, 1].sum() / weight.sum(), 1e-4, 1 - 1e-4))
            model = LabelModel(prior, groups, tables(groups, weight))
            p = model.posterior(masks)
            weight = known + counts[:, None] * np.column_stack([1 - p, p])
        if step == 0:  # which voters depend on each other given the class?
            bond = np.zeros((len(VOTERS), len(VOTERS)))
            for y in (0, 1):
                w = weight[:, y] / weight[:, y].sum()
                mean = fires @ w
                cov = (fires * w) @ fires.T - np.outer(mean, mean)
                dev = np.sqrt(np.maximum(np.diag(cov), 1e-9))
                bond = np.maximum(bond, np.abs(cov / np.outer(dev, dev)) * (dev > 0.01)[:, None] * (dev > 0.01)[None])
            home = list(range(len(VOTERS)))
            for i, j in sorted(((i, j) for i in home for j in home if i < j and bond[i, j] >= tie), key=lambda x: -bond[x]):
                if home[i] != home[j] and home.count(home[i]) + home.count(home[j]) <= most:
                    old, new = home[j], home[i]
                    home = [new if x == old else x for x in home]
            groups = [[v for v in range(len(VOTERS)) if home[v] == h] for h in sorted(set(home))]
    return LabelModel(prior, groups, tables(groups, weight))


# --- the classifier --------------------------------------------------------------------------------------------------


@dataclass
class Model:
    lexicon: Lexicon
    dense: np.ndarray
    votes: np.ndarray
    terms: np.ndarray
    bias: float

    def score(self, text: pa.Array) -> np.ndarray:
        mask, dense, (row, feature) = _views(text, self.lexicon)
        fired = ((mask[:, None] >> np.arange(len(VOTERS))) & 1).astype(float)
        found = np.bincount(row, self.terms[feature], len(mask)) if len(feature) else np.zeros(len(mask))
        return _sigmoid(self.bias + dense @ self.dense + fired @ self.votes + found)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _train(lexicon: Lexicon, mask: np.ndarray, dense: np.ndarray, hits: tuple[np.ndarray, np.ndarray], target: np.ndarray, prior: float, ridge: float = 1.0, term_ridge: float = 8.0) -> Model:
    """L2-regularised logistic regression on posterior labels: Newton steps for densities and votes, and between them
    steps for the terms under a bound of the loss that is separate for each term, so that the loss never rises."""
    fired = ((mask[:, None] >> np.arange(len(VOTERS))) & 1).astype(float)
    x = np.column_stack([dense, fired, np.ones(len(mask))])
    w = np.zeros(x.shape[1])
    w[-1] = math.log(prior / (1 - prior))
    least = np.full(len(w), ridge)
    least[-1] = 1e-3
    row, feature = hits
    terms = np.zeros(sum(map(len, lexicon.hashes)))
    per_row = np.bincount(row, minlength=len(mask))
    curve = term_ridge + 0.25 * np.bincount(feature, per_row[row], len(terms)) if len(row) else np.ones(len(terms))
    found = np.zeros(len(mask))
    for _ in range(60):
        p = _sigmoid(x @ w + found)
        step = np.linalg.solve((x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(least), x.T @ (target - p) - least * w)
        w += step
        for _ in range(5 if len(row) else 0):
            p = _sigmoid(x @ w + found)
            terms += (np.bincount(feature, (target - p)[row], len(terms)) - term_ridge * terms) / curve
            found = np.bincount(row, terms[feature], len(mask))
        if np.abs(step).max() < 1e-4:
            break
    return Model(lexicon, w[:DENSE], w[DENSE:-1], terms, float(w[-1]))


def training_rows(labels: DataFrame, most: int = MAX_LABELLED) -> DataFrame:
    """(doc_id, y) of at most `most` labelled rows outside the held-out fold, the first in hash order."""
    rows = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("y"))
    return rows.where(id_crc(F.col("doc_id")) % 3 != 1).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def induce(texts: DataFrame, positives: int, negatives: int) -> Lexicon:
    """Features that rows of class 1 hold far more often than rows of class 0; texts: (text, y)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            index, distinct, per_row = words(batch.column("text"))
            hashed, _, _ = _hashes(distinct)
            row, y = np.repeat(np.arange(len(per_row)), per_row), batch.column("y").to_numpy()
            for kind in range(KINDS):
                f, place = np.unique(hashed[:, kind], return_inverse=True)
                pairs = np.unique(place[index] * len(y) + row) if len(index) else np.zeros(0, np.int64)
                where, toxic = pairs // max(1, len(y)), y[pairs % max(1, len(y))] == 1
                pos, neg = np.bincount(where[toxic], minlength=len(f)), np.bincount(where[~toxic], minlength=len(f))
                own = f > 0
                yield pa.RecordBatch.from_pydict({"kind": pa.array(np.full(own.sum(), kind), pa.int32()), "f": pa.array(f[own].view(np.int64)), "pos": pos[own], "neg": neg[own]})

    sums = texts.mapInArrow(count, "kind int, f long, pos long, neg long").groupBy("kind", "f").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    odds = F.log((F.col("pos") + 0.5) / (positives + 1)) - F.log((F.col("neg") + 0.5) / (negatives + 1))
    least = max(3, positives // 400)
    found = staged(sums.withColumn("odds", odds).where((F.col("odds") >= WEAK) & (F.col("pos") >= least)), "induced")
    lexicon = Lexicon([], [])
    for kind in range(KINDS):
        best = found.where(F.col("kind") == kind).select("f", "odds").toPandas()  # from MAX_LABELLED rows at most
        h = best["f"].to_numpy(np.int64).view(np.uint64)
        order = np.argsort(h)
        lexicon.hashes.append(h[order])
        lexicon.strong.append(best["odds"].to_numpy()[order] >= STRONG)
    return lexicon


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """docs: (doc_id, text) without null texts; labels: (doc_id, toxic)."""
    chosen = staged(training_rows(labels), "labelled")  # MAX_LABELLED short rows at most, which may be broadcast
    rows = staged(docs.join(F.broadcast(chosen), "doc_id").select("text", "y"), "labelled-texts")
    sizes = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    if not sizes.get(1) or not sizes.get(0):
        return Model(Lexicon(), np.zeros(DENSE), np.zeros(len(VOTERS)), np.zeros(1), 30.0 if sizes.get(1) else -30.0)
    lexicon = induce(rows, sizes[1], sizes[0])

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            mask, n = np.unique(_views(batch.column("text"), lexicon)[0], return_counts=True)
            yield pa.RecordBatch.from_pydict({"mask": mask, "n": n})

    def view(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            mask, dense, (row, feature) = _views(batch.column("text"), lexicon)
            cuts = np.searchsorted(np.sort(row), np.arange(len(mask) + 1)).astype(np.int32)
            terms = pa.ListArray.from_arrays(pa.array(cuts), pa.array(feature[np.argsort(row, kind="stable")]))
            yield pa.RecordBatch.from_pydict({"y": batch.column("y"), "mask": mask, "dense": [x.tobytes() for x in dense], "terms": terms})

    patterns = docs.select("text").mapInArrow(vote, "mask long, n long").groupBy("mask").agg(F.sum("n").alias("n")).toPandas()  # 2 ** 20 small rows at most, some hundreds in fact
    seen = rows.mapInArrow(view, "y int, mask long, dense binary, terms array<long>").toPandas()
    y, mask = seen["y"].to_numpy(), seen["mask"].to_numpy()
    every = np.union1d(patterns["mask"].to_numpy(), mask)
    counts = np.zeros(len(every))
    counts[np.searchsorted(every, patterns["mask"].to_numpy())] = patterns["n"].to_numpy()
    known = np.zeros((len(every), 2))
    np.add.at(known, (np.searchsorted(every, mask), y), 1)
    model = fit_labels(every, counts, known)
    soft = model.posterior(mask)
    right = np.clip(np.mean(np.where(y == 1, soft, 1 - soft)), 0.6, 0.99)  # the given label is a voter of this accuracy
    logit = np.log(np.clip(soft, 1e-6, 1 - 1e-6) / np.clip(1 - soft, 1e-6, 1 - 1e-6)) + np.where(y == 1, 1, -1) * math.log(right / (1 - right))
    dense = np.stack([np.frombuffer(x) for x in seen["dense"]])
    hits = np.repeat(np.arange(len(seen)), seen["terms"].map(len)), np.concatenate([np.zeros(0, np.int64), *seen["terms"]]).astype(np.int64)
    return _train(lexicon, mask, dense, hits, _sigmoid(logit), model.prior)


def with_scores(docs: DataFrame, model: Model) -> DataFrame:
    """(row, score): each row of docs as a struct, and the probability that label 1 fits its text; null is the empty text."""

    place = docs.columns.index("text")

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:  # a text goes to Python once, in its row
            row = batch.column("row")
            yield pa.RecordBatch.from_arrays([row, pa.compute.fill_null(row.field(place), "")], ["row", "text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(texts(batches)):
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(model.score(batch.column("text")))], ["row", "score"])

    rows = docs.select(F.struct(*(F.col(f"`{n}`") for n in docs.columns)).alias("row"))
    return rows.mapInArrow(run, StructType([rows.schema["row"], StructField("score", DoubleType())]))


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted for each row of docs.

    labels: (doc_id, toxic), learnt from outside the held-out fold only; of repeated ids the largest counts, nulls don't.
    Without labels of both classes every score is that of the one class (no labels: 0). A null text is an empty one,
    repeated rows get equal scores, no rows give no rows. Only doc_id and text of docs are read. A text is scored whole,
    in one piece: a task holds about 30 bytes for each byte of a text longer than a slice.
    """
    rows = id_text(docs).select(F.col("doc_id").cast("long"), "text")
    model = learn(rows, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(batch.column("text")))], ["doc_id", "score"])

    scored = rows.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", (id_crc(F.col("doc_id")) % 3 == 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns under any names, that aren't predicted toxic."""
    model = learn(id_text(docs).select(F.col("doc_id").cast("long"), "text"), labels)
    return with_scores(docs, model).where(F.col("score") < THRESHOLD).select("row.*")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
