"""Toxicity: a weighted finite-state pattern grammar over clauses.

Words are read as symbols of a small alphabet (insult, threat, target, negation, speech verb, break, quotation mark,
other). Four transducers rewrite a clause's symbols from left to right and are composed into one machine:

  reported   an insult or threat after a speech verb ("say", "told me") becomes a reported one. A report ends with its clause; without
             quotation marks also at a comma before a conjunction ("he said you are an idiot, and I agree"), with
             them at the closing mark. A colon ends a clause except after a speech verb
  negation   one at most NEGATION_REACH words after a negation ("not", "don't", "n'est") becomes a negated one
  target     one at most TARGET_REACH words after an addressed person becomes an aimed one
  threat     a threat verb without an addressed person at most TARGET_REACH words before or after it becomes an
             ordinary word; one whose person follows is counted where that person stands

Matched insult symbols carry the weight of the lexicon entry that matched; a logistic layer fitted on labels
turns the sums of a document's clauses, one for each kind of match, and how many clauses match into a probability. Insult words and
stems are learned: an entry is kept if its document frequency under label 1 is beyond chance. Documents of the sample
that share the smallest hash of their runs of five words share one document's weight, so that copies don't count as
evidence many times over; none is left out.

Defined results: null and empty texts match nothing and get the score of the empty match; very long texts are read
whole; ties and repeated rows: equal texts get equal scores; without both labels every score is the share of label 1
(0.5 without rows); an empty table gives no rows; columns beside doc_id and text are not looked at, and come through
`keep_civil` unchanged.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, release, training_rows

BUCKETS, HELD_BUCKET = 3, 1
#: The sample that is learned from: so many documents, and so many bytes of text, at most.
MAX_TRAIN_DOCS, MAX_TRAIN_BYTES = 24000, 256 << 20
REJECT_AT = 0.7
STEM_LENGTHS = (4, 5, 6, 7, 8)
#: An entry's chance of arising from unrelated labels, times the number of entries tried, stays under this.
CHANCE = 1.0
#: And it must stand in at least this share of the documents of label 1.
SUPPORT = 0.012
#: And its log odds must be at least this.
LEAST_ODDS = 1.5
NEGATION_REACH, TARGET_REACH = 3, 5

# Fixed word lists of the grammar, by symbol: English, German, French and Spanish.
INSULTS = "idiot idiots moron morons stupid scum loser losers worthless pathetic disgusting trash clown clowns imbecile dumb".split()
THREATS = "kill hurt destroy beat burn hang shoot töten umbringen verletzen tuer frapper matar golpear".split()
TARGETS = "you your yours du dich dir ihr euch tu toi vous tú te usted ustedes".split()
NEGATIONS = "not no never neither nor cannot dont isnt arent wasnt wont cant nicht kein keine keinen keiner keinem nie niemals ne pas jamais aucun nunca jamás tampoco ningún".split()
REPORTS = "say says said saying write writes wrote claim claims claimed quote quoted called sagt sagen sagte sagten schreibt schrieb behauptet behaupten behauptete dit disent disait disaient écrit écrivait dice dicen dijo dijeron escribe escribió".split()

CONJUNCTIONS = "and but und aber doch et mais y pero".split()

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, BREAK, QUOTE = range(8)
#: What the composed machine emits; MENACE + k stands for k + 1 menaces at once.
NOTHING, PLAIN, AIMED, NEGATED, REPORTED, MENACE = range(6)
N_KINDS = 6
#: A document's numbers: a sum for each kind, the clauses with a match, and their share in hundredths.
N_SUMS = N_KINDS + 2


class Transducer:
    """Sequential: step(state, symbol) -> (state, symbol); runs of other words count down within a state."""

    def __init__(self, start, step):
        self.start, self.step = start, step

    def then(self, other: Transducer) -> Transducer:
        def step(state, symbol):
            first, out = self.step(state[0], symbol)
            second, out = other.step(state[1], out)
            return (first, second), out

        return Transducer((self.start, other.start), step)


def _marker(trigger: int, reach: int, mark: int) -> Transducer:
    """Adds `mark` to a match that stands at most `reach` words after a trigger; breaks and quotation marks are no words."""

    def step(state, symbol):
        base, marks = symbol
        if base in (BREAK, QUOTE):
            return state, symbol
        if base == trigger:
            return reach, symbol
        if base in (INSULT, THREAT) and state:
            symbol = (base, marks | mark)
        return max(0, state - 1), symbol

    return Transducer(0, step)


def _reports(mark: int) -> Transducer:
    """Adds `mark` to a match within a report. States: outside, in a report, in a quotation of a report."""

    def step(state, symbol):
        base, marks = symbol
        if base == REPORT:
            return max(state, 1), symbol
        if base == QUOTE and state:
            return (2 if state == 1 else 0), symbol
        if base == BREAK and state == 1:
            return 0, symbol
        if base in (INSULT, THREAT) and state:
            symbol = (base, marks | mark)
        return state, symbol

    return Transducer(0, step)


def _emit() -> Transducer:
    """Marked symbols to kinds of match: reported before negated before aimed; a threat counts when aimed.

    The state has a bit for each threat of the last TARGET_REACH words that waits for an addressed person.
    """
    full = (1 << TARGET_REACH) - 1

    def step(state, symbol):
        base, marks = symbol
        if base in (BREAK, QUOTE):
            return state, NOTHING
        later = state << 1 & full
        if base == TARGET and state:
            return 0, MENACE + state.bit_count() - 1
        if base not in (INSULT, THREAT):
            return later, NOTHING
        if marks & 1:
            return later, REPORTED
        if marks & 2:
            return later, NEGATED
        if base == THREAT:
            return (later, MENACE) if marks & 4 else (later | 1, NOTHING)
        return later, AIMED if marks & 4 else PLAIN

    return Transducer(0, step)


def composed() -> Transducer:
    return _reports(1).then(_marker(NEGATION, NEGATION_REACH, 2)).then(_marker(TARGET, TARGET_REACH, 4)).then(_emit())


def grammar() -> tuple[list[list[int]], list[list[int]]]:
    """The composed machine as tables: next state and emission, by state and symbol."""
    machine = composed()
    ids, queue, moves, out = {machine.start: 0}, [machine.start], [], []
    for state in queue:
        row, said = [], []
        for symbol in range(8):
            to, kind = machine.step(state, (symbol, 0))
            if to not in ids:
                ids[to] = len(ids)
                queue.append(to)
            row.append(ids[to])
            said.append(kind)
        moves.append(row)
        out.append(said)
    return moves, out


#: A clause ends at these marks; a colon after a speech verb opens what is reported.
_CLAUSE = re.compile(rf"[.!?;\n]+|(?<!\w):|(?<=\w):(?<!{':)(?<!'.join(rf'\b{w}' for w in REPORTS)}:)")
_WORD = re.compile(r"\w+")
#: Words, quotation marks (single ones where no word goes on), and commas before a conjunction.
_TOKEN = re.compile(rf"\w+|[\"“”„«»‘]|(?<!\w)'(?=\w)|(?<=[\w,])['’](?!\w)|,(?=\s*(?:{'|'.join(CONJUNCTIONS)})\b)")
#: Negations that an apostrophe joins to a word, and speech that is only a report to some.
_CONTRACTED, _TOLD = re.compile(r"\b\w+n['’]t\b|\bn['’](?=\w)"), re.compile(r"\b(?:tell|tells|told) (?:me|us|him|her|them|everyone|people)\b")
_SYMBOL = {w: s for s, words in ((THREAT, THREATS), (TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS)) for w in words}
_SYMBOL |= {w: INSULT for w in INSULTS} | {",": BREAK} | {q: QUOTE for q in "\"“”„«»‘’'"}


def _plain(text: str) -> str:
    """In lower case, with contracted negations as words: don't, isn’t and n'est have one of their own."""
    lower = text.lower()
    if "'" in lower or "’" in lower:
        lower = _CONTRACTED.sub(" not ", lower)
    return _TOLD.sub("said", lower) if "tell" in lower or "told" in lower else lower


def _entries(text: str) -> set[str]:
    words = set(_WORD.findall(text.lower()))
    found = {w[:k] + "*" for k in STEM_LENGTHS for w in words if len(w) >= k}
    return words | found


class Grammar:
    def __init__(self, words: dict[str, float] | None = None, stems: dict[str, float] | None = None):
        self.words = {w: 1.0 for w in INSULTS} | (words or {})
        self.stems = stems or {}
        self.moves, self.out = grammar()
        self.lengths = sorted({len(s) for s in self.stems})
        self.alert = set(self.words) | set(THREATS)
        self.weights, self.bias = np.zeros(N_SUMS), 0.0

    def weight(self, word: str) -> float:
        found = self.words.get(word, 0.0)
        for k in self.lengths:
            found = max(found, self.stems.get(word[:k], 0.0))
        return found

    def matches(self, text: str | None) -> np.ndarray:
        """Weight of matched symbols for each kind, then the number of clauses with an unsuspended match and their share."""
        sums = np.zeros(N_SUMS)
        if not text:
            return sums
        lower = _plain(text)
        # A clause ends between words, so these are the words of all clauses.
        words = set(_WORD.findall(lower))
        hit = not self.alert.isdisjoint(words)
        for k in () if hit else self.lengths:
            if not {w[:k] for w in words}.isdisjoint(self.stems):
                hit = True
                break
        if not hit:
            return sums
        clauses = 0
        for clause in _CLAUSE.split(lower):
            state, matched = 0, False
            tokens = _TOKEN.findall(clause)
            clauses += bool(tokens)
            for word in tokens:
                symbol = _SYMBOL.get(word, OTHER)
                weight = 1.0
                if symbol in (OTHER, INSULT):
                    weight = self.weight(word)
                    symbol = INSULT if weight > 0 else OTHER
                kind = self.out[state][symbol]
                state = self.moves[state][symbol]
                if kind > MENACE:
                    kind, weight = MENACE, 1.0 + kind - MENACE
                if kind:
                    sums[kind] += weight
                    matched |= kind in (PLAIN, AIMED, MENACE)
            sums[N_KINDS] += matched
        sums[N_KINDS + 1] = 100.0 * sums[N_KINDS] / max(1, clauses)
        return sums

    def score_many(self, texts) -> np.ndarray:
        x = np.array([self.matches(t) for t in texts]).reshape(-1, N_SUMS)
        return _sigmoid(np.log1p(x) @ self.weights + self.bias)

    def calibrate(self, sums: np.ndarray, y: np.ndarray, share: np.ndarray | None = None, rounds: int = 60) -> Grammar:
        """Newton's method for logistic regression with a small ridge; weights of matches stay at 0 or above.

        share: how much of a document each row counts as, one by default.
        """
        m = np.ones(len(y)) if share is None else share
        if not len(y) or y.min() == y.max():
            share = min(max(float(y.mean()) if len(y) else 0.5, 1e-6), 1 - 1e-6)
            self.bias = math.log(share / (1 - share))
            return self
        x = np.hstack([np.log1p(sums), np.ones((len(y), 1))])
        w = np.zeros(x.shape[1])
        ridge = np.diag([0.1] * (x.shape[1] - 1) + [1e-6])
        for _ in range(rounds):
            p = _sigmoid(x @ w)
            up = x.T @ (m * (y - p)) - ridge @ w
            # Weights that stand at 0 and would fall stay; the step is taken in the others.
            free = (w > 0) | (up > 0)
            free[-1] = True
            bend = (x * (m * (p * (1 - p) + 1e-9))[:, None]).T @ x + ridge
            step = np.zeros_like(w)
            step[free] = np.clip(np.linalg.solve(bend[np.ix_(free, free)], up[free]), -2, 2)
            before, w = w, w + step
            w[:-1] = np.maximum(w[:-1], 0.0)
            if np.abs(w - before).max() < 1e-6:
                break
        self.weights, self.bias = w[:-1], float(w[-1])
        return self


def _sigmoid(x):
    return 0.5 * (1.0 + np.tanh(0.5 * x))


def _count_entries(frames):
    """Weighted document frequencies of a batch's words and stems, by label; the row "" counts the documents."""
    for frame in frames:
        counts = (Counter(), Counter())
        for text, y, share in zip(frame["text"], frame["y"], frame["share"]):
            mine = counts[int(y)]
            for entry in _entries(text):
                mine[entry] += share
            mine[""] += share
        keys = list(counts[0].keys() | counts[1].keys())
        yield pd.DataFrame({"entry": keys, "neg": [float(counts[0][k]) for k in keys], "pos": [float(counts[1][k]) for k in keys]})


def _match_rows(model: Grammar):
    def run(frames):
        for frame in frames:
            yield pd.DataFrame({"y": frame["y"], "share": frame["share"], "sums": [model.matches(t).tolist() for t in frame["text"]]})

    return run


def _tail(pos: float, n: float, share: float) -> float:
    """Log of a bound on the chance of at least pos successes in n at this share (Chernoff)."""
    q = pos / n
    if q <= share:
        return 0.0
    return -n * (q * math.log(q / share) + ((1 - q) * math.log((1 - q) / (1 - share)) if q < 1 else 0.0))


def select_entries(rows: list[tuple[str, float, float]], tried: int, n_neg: float, n_pos: float) -> tuple[dict, dict]:
    """Words and stems whose frequency under label 1 is beyond chance; a stem replaces what it covers."""
    share = n_pos / max(1, n_pos + n_neg)
    limit = math.log(CHANCE / max(1, tried))
    words, stems = {}, {}
    for entry, neg, pos in sorted(rows):
        odds = math.log((pos + 0.5) / (n_pos + 1)) - math.log((neg + 0.5) / (n_neg + 1))
        if odds > LEAST_ODDS and pos >= SUPPORT * n_pos and _tail(pos, pos + neg, share) < limit:
            (stems if entry.endswith("*") else words)[entry.rstrip("*")] = odds
    short = {}
    for stem in sorted(stems, key=len):
        if not any(stem[:k] in short and short[stem[:k]] >= stems[stem] - 1.0 for k in range(min(STEM_LENGTHS), len(stem))):
            short[stem] = stems[stem]
    words = {w: v for w, v in words.items() if not any(short.get(w[:k], -9.0) >= v - 1.0 for k in STEM_LENGTHS)}
    top = max([*words.values(), *short.values(), 1.0])
    return {w: v / top for w, v in words.items()}, {s: v / top for s, v in short.items()}


def _shared_weights(sample: DataFrame) -> DataFrame:
    """(text, y, share): one over the number of the sample's documents with the same smallest hash of five-word runs."""
    # Words are bound to a variable, so that they are split once; a group is never null, so no filter repeats the work.
    runs = lambda w: F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - 5, F.lit(0))), lambda i: F.xxhash64(F.slice(w, i + 1, 5)))
    least = F.transform(F.array(F.split(F.lower("text"), r"\s+")), lambda w: F.array_min(runs(w)))
    placed = materialise(sample.select("text", "y", F.coalesce(F.get(least, F.lit(0)), F.lit(0)).alias("g")), "placed")
    # The sample's bound holds for the number of groups.
    sizes = placed.groupBy("g").agg(F.count("*").alias("n"))
    return placed.join(F.broadcast(sizes), "g").select("text", "y", (F.lit(1.0) / F.col("n")).alias("share"))


def fit(documents: DataFrame, labels: DataFrame, max_train_docs: int = MAX_TRAIN_DOCS, max_train_bytes: int = MAX_TRAIN_BYTES) -> Grammar:
    """Learn entries and the logistic layer from a bounded sample of labelled documents outside the held-out bucket.

    Of the entries those that are common enough and frequent enough under label 1 reach the driver, which are under
    1 / SUPPORT for each place of a document's words; of the documents, one row of sums each.
    """
    sample = materialise(_shared_weights(training_rows(documents, labels, "toxic", BUCKETS, HELD_BUCKET, max_train_docs, max_train_bytes)), "toxic")
    counts = sample.mapInPandas(_count_entries, "entry string, neg double, pos double").groupBy("entry")
    # Sums of shares depend on their order; six digits of them don't.
    counts = materialise(counts.agg(F.round(F.sum("neg"), 6).alias("neg"), F.round(F.sum("pos"), 6).alias("pos")), "entries")
    total = counts.where("entry = ''").first()
    words, stems = {}, {}
    if total and total["neg"] and total["pos"]:
        odds = F.ln((F.col("pos") + 0.5) / (total["pos"] + 1)) - F.ln((F.col("neg") + 0.5) / (total["neg"] + 1))
        often = counts.where((F.col("entry") != "") & (F.col("pos") >= SUPPORT * total["pos"]) & (odds > LEAST_ODDS))
        # Entries too rare to be beyond chance at all, whatever their labels, are no tries.
        share = total["pos"] / (total["pos"] + total["neg"])
        least = math.log(CHANCE / max(1, counts.count())) / math.log(share)
        tried = counts.where(F.col("pos") + F.col("neg") >= least).count()
        words, stems = select_entries([tuple(r) for r in often.collect()], tried, total["neg"], total["pos"])
    model = Grammar(words, stems)
    found = sample.mapInPandas(_match_rows(model), "y int, share double, sums array<double>").toPandas()
    sums = np.array(found["sums"].tolist(), dtype=float).reshape(-1, N_SUMS)
    y, share = found["y"].to_numpy(dtype=float), found["share"].to_numpy(dtype=float)
    order = np.lexsort([*sums.T, share, y])
    return model.calibrate(sums[order], y[order], share[order])


def scorer(model: Grammar):
    """A column function: text -> probability of toxic 1."""

    @F.pandas_udf("double")
    def toxicity_score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(model.score_many(texts.tolist()))
        release()

    return toxicity_score


def score_documents(documents: DataFrame, labels: DataFrame, max_train_docs: int = MAX_TRAIN_DOCS) -> DataFrame:
    """(doc_id, score) of every row."""
    model = fit(documents, labels, max_train_docs)
    return documents.select("doc_id", scorer(model)(F.col("text")).alias("score"))


def keep_civil(documents: DataFrame, labels: DataFrame, below: float = REJECT_AT) -> DataFrame:
    """The rows that score under `below`, with their own columns only."""
    return documents.where(scorer(fit(documents, labels))(F.col("text")) < below)
