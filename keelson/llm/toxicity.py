"""Toxicity by a weighted finite-state pattern grammar.

A lexicon transducer writes words as symbols (insult, threat, target, negation, report) with
weights; small automata for each kind of context read the symbols of a clause and are composed
into one. What is scored is how a clause ends: an insult at a target outweighs one in the open,
a denied or reported one counts less. Insults beside the given ones, and the weights of the
outcomes, are learned from labelled documents; the score is a logistic function of the outcomes.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from keelson.llm.common import stored

# fixed values: the given words of each symbol
INSULTS = "idiot moron imbecile scum trash loser worthless pathetic disgusting stupid dumb filth vermin bastard idiota imbécil basura idiote imbécile ordure dummkopf abschaum".split()
THREATS = "kill hurt beat destroy stab shoot burn crush hang töten umbringen tuer frapper matar golpear".split()
TARGETS = "you your yours he him his she her they them their this that these those du dich dein sie ihr vous tu toi ton ils usted tú ellos".split()
NEGATIONS = "not no never none nobody isn't aren't wasn't don't doesn't nicht kein keine nie ne pas jamais nunca ni".split()
REPORTS = "said says wrote writes claimed reported quoted according allegedly called sagte schrieb dit écrit selon dijo escribió según".split()

INSULT, THREAT, TARGET, NEGATION, REPORT = "insult", "threat", "target", "negation", "report"
_CLAUSES = re.compile(r"[.!?;:,\n|]+")
_WORDS = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")

#: An automaton: start state and (state, symbol) -> state; a missing entry stays where it is.
Automaton = tuple[object, dict[tuple[object, str], object]]

HIT: Automaton = ("none", {("none", INSULT): INSULT, ("none", THREAT): THREAT, (THREAT, INSULT): INSULT})
AIMED: Automaton = (False, {(False, TARGET): True})
DENIED: Automaton = (False, {(False, NEGATION): True, (True, NEGATION): False})
TOLD: Automaton = (False, {(False, REPORT): True})
SYMBOLS = (INSULT, THREAT, TARGET, NEGATION, REPORT)


def compose(*machines: Automaton) -> tuple[tuple, dict[tuple[tuple, str], tuple]]:
    """The product automaton, reachable states only."""
    start = tuple(m[0] for m in machines)
    table, todo = {}, [start]
    while todo:
        state = todo.pop()
        for symbol in SYMBOLS:
            to = tuple(m[1].get((s, symbol), s) for m, s in zip(machines, state))
            if (state, symbol) not in table:
                table[state, symbol] = to
                todo.append(to)
    return start, table


#: Outcomes of a clause, in the order of the features.
OUTCOMES = ("open_insult", "aimed_insult", "aimed_threat", "softened")
FEATURES = [f"{kind}_{outcome}" for outcome in OUTCOMES for kind in ("most", "sum")]


def outcome(state: tuple) -> int | None:
    hit, aimed, denied, told = state
    if hit == "none" or (hit == THREAT and not aimed):
        return None
    if denied or told:
        return 3
    return 2 if hit == THREAT else int(aimed)


class Grammar:
    """Lexicon and composed automaton; ``read`` gives the features of a text."""

    def __init__(self, lexicon: dict[str, tuple[str, float]]) -> None:
        self.lexicon = lexicon
        self.start, self.table = compose(HIT, AIMED, DENIED, TOLD)
        self.hits = frozenset(w for w, (symbol, _) in lexicon.items() if symbol in (INSULT, THREAT))

    def clause(self, words: list[str]) -> tuple[int, float] | None:
        """Outcome and weight of a clause; the weight is the largest of its hits."""
        state, weight = self.start, 0.0
        for word in words:
            found = self.lexicon.get(word)
            if found:
                state = self.table[state, found[0]]
                if word in self.hits:
                    weight = max(weight, found[1])
        ending = outcome(state)
        return None if ending is None else (ending, weight)

    def read(self, text: str) -> list[float]:
        """Per outcome the largest and the summed weight of its clauses."""
        out = [0.0] * (2 * len(OUTCOMES))
        lower = text.lower()
        if self.hits.isdisjoint(_WORDS.findall(lower)):
            return out
        for part in _CLAUSES.split(lower):
            found = self.clause(_WORDS.findall(part))
            if found:
                kind, weight = found
                out[2 * kind] = max(out[2 * kind], weight)
                out[2 * kind + 1] += weight
        return out


def given_lexicon(weight: float = 1.0) -> dict[str, tuple[str, float]]:
    words = ((TARGETS, TARGET, 0.0), (NEGATIONS, NEGATION, 0.0), (REPORTS, REPORT, 0.0), (THREATS, THREAT, weight), (INSULTS, INSULT, weight))
    return {w: (symbol, x) for group, symbol, x in words for w in group}


@dataclass
class ToxicModel:
    lexicon: dict[str, tuple[str, float]]
    coefficients: list[float] = field(default_factory=list)
    intercept: float = 0.0

    def score(self, features: Column) -> Column:
        margin = F.lit(self.intercept)
        for name, c in zip(FEATURES, self.coefficients):
            margin = margin + F.log1p(features[name]) * c
        return 1 / (1 + F.exp(-margin))


def features(text: Column, lexicon: dict[str, tuple[str, float]]) -> Column:
    """The grammar's features of a string column as a struct of doubles."""

    @arrow_udf("struct<" + ",".join(f"{n}:double" for n in FEATURES) + ">")
    def read(texts: pa.Array) -> pa.Array:
        grammar = Grammar(lexicon)
        rows = [grammar.read(t or "") for t in texts.to_pylist()]
        columns = list(zip(*rows)) or [()] * len(FEATURES)
        return pa.StructArray.from_arrays([pa.array(c, pa.float64()) for c in columns], FEATURES)

    return read(text)


def labelled_sample(docs: DataFrame, labels: DataFrame, sample: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Texts and labels of at most ``sample`` labelled documents: those whose digest of the id is smallest."""
    chosen = (
        labels.where(F.col(id_col).isNotNull() & F.col("toxic").isNotNull())
        .groupBy(id_col).agg(F.max("toxic").alias("_toxic"))
        .orderBy(F.xxhash64(id_col), id_col).limit(sample)
    )
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    return stored(rows.join(F.broadcast(chosen), id_col).select("_text", "_toxic"), "toxic-sample")


def fit(docs: DataFrame, labels: DataFrame, sample: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> ToxicModel:
    """Learn insults and outcome weights from ``labels`` (``doc_id``, ``toxic``), at most ``sample`` documents.

    A word becomes an insult when the share of toxic documents among those that hold it is above
    one half even at the lower end of a 99 % Wilson interval; its weight is the log-odds of that
    share. Without both classes the given lexicon and unit weights are used.
    """
    rows = labelled_sample(docs, labels, sample, id_col, text_col)
    toxic, total = rows.agg(F.coalesce(F.sum("_toxic"), F.lit(0)), F.count("*")).first()
    plain = [1.0] * len(FEATURES)
    if not 0 < toxic < total:
        return ToxicModel(given_lexicon(), plain, -2.0)
    words = rows.select("_toxic", F.explode(F.array_distinct(F.split(F.lower("_text"), r"[^\p{L}]+"))).alias("word")).where("word <> ''")
    n, bad, z = F.col("n"), F.col("bad"), 2.6
    share = bad / n
    wilson = (share + z * z / (2 * n) - z * F.sqrt((share * (1 - share) + z * z / (4 * n)) / n)) / (1 + z * z / n)
    found = (
        words.groupBy("word").agg(F.count("*").alias("n"), F.sum("_toxic").alias("bad"))
        .where(wilson > 0.5).select("word", F.log((bad + 1) / (n - bad + 1)).alias("weight"))
    )
    lexicon = given_lexicon()
    # words of the bounded sample only
    lexicon |= {r["word"]: (INSULT, float(r["weight"])) for r in found.collect() if lexicon.get(r["word"], (INSULT,))[0] == INSULT}
    read = rows.select("_toxic", features(F.col("_text"), lexicon).alias("_f")).select(F.col("_toxic").cast("double").alias("label"), *(F.log1p(F.col("_f")[c]).alias(c) for c in FEATURES))
    vector = VectorAssembler(inputCols=FEATURES, outputCol="v").transform(stored(read, "toxic-features")).select("v", "label").coalesce(4)
    model = LogisticRegression(featuresCol="v", labelCol="label", regParam=1e-3, maxIter=50).fit(vector)
    return ToxicModel(lexicon, [float(c) for c in model.coefficients], float(model.intercept))


def toxic_score(text: Column, model: ToxicModel) -> Column:
    return model.score(features(text, model.lexicon))


def score_documents(docs: DataFrame, model: ToxicModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id and ``score`` in [0, 1].

    A null or empty text holds no clause and gets the score of the intercept, below one half.
    Repeated rows are scored each; other columns are not read; an empty table gives an empty
    result; texts are read whole.
    """
    read = docs.select(F.col(id_col), features(F.col(text_col).cast("string"), model.lexicon).alias("_f"))
    return read.select(id_col, model.score(F.col("_f")).alias("score"))


def drop_toxic(docs: DataFrame, model: ToxicModel, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score below the threshold, all columns unchanged."""
    return docs.where(toxic_score(F.col(text_col).cast("string"), model) < threshold)
