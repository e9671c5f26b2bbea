"""Language identification: words first, shorter and shorter character n-grams for words that are not known.

*Model.* Relative frequencies of lower-cased words, and of the character n-grams of words (with a space on either side)
for n from ``longest`` to 1, per language. A word's score for a language is the logarithm of its relative frequency
there, or a penalty if only other languages have it. A word that no language has is scored by its n-grams of the longest
n of which at least one is known, as their mean. A text's score is the mean over its words; the language with the highest
wins (the first in order of code points if even).

*Training* reads a bounded sample, about ``per_language`` labelled texts of each language taken by a hash of the id, so a
language is learned however rare it is. Words and n-grams of all lengths are counted in one Spark aggregation, and every
entry of the sample is kept; the model that is sent to tasks is bounded by the sample, and grows with the number of
languages alone. *Prediction* goes over whole texts in one pass, without a shuffle.

Texts that are null or have no letter get ``und`` and score 0, as do all texts if nothing was learned. The score is the
softmax of the languages' summed scores (at most ``SURE`` words count). Rows with a null language don't train. Repeated
rows get equal results. An empty table gives an empty result. Other columns are ignored by ``identify`` and passed through by ``predicted``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brightweir.llm.arrow import appended, pieces
from brightweir.llm.toxicity import fold
from brightweir.session import cut

LONGEST = 4
PENALTY = -14.0
SURE = 50
#: Languages whose sizes (some 50 bytes each) are sent to every task.
SMALL = 100_000
#: Distinct words whose scores a worker keeps.
KEPT = 400_000


@dataclass
class Model:
    """tables[0]: words, tables[n]: n-grams; a text's row in shares[n] has its score for each language."""

    languages: list[str]
    tables: list[dict[str, int]]
    shares: list[np.ndarray]
    known: dict[str, int] = field(default_factory=dict)
    scores: list[np.ndarray] = field(default_factory=list)

    def of_word(self, word: str) -> np.ndarray:
        at = self.tables[0].get(word)
        if at is not None:
            return self.shares[0][at]
        padded = f" {word} "
        for n in range(len(self.tables) - 1, 0, -1):
            held = self.tables[n]
            own = [held[x] for i in range(len(padded) - n + 1) if (x := padded[i : i + n]) in held]
            if own:
                return self.shares[n][own].sum(axis=0) / np.float32(len(own))
        return np.full(len(self.languages), PENALTY, np.float32)

    def rows(self, words: list[str]) -> np.ndarray:
        """Scores of words, a row each; those of frequent calls are kept."""
        if len(self.known) + len(words) > KEPT:
            self.known, self.scores = {}, []
        out = np.empty((len(words), len(self.languages)), np.float32)
        for i, w in enumerate(words):
            at = self.known.get(w)
            if at is None:
                at = self.known[w] = len(self.scores)
                self.scores.append(self.of_word(w))
            out[i] = self.scores[at]
        return out

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        flat = _letters(pc.fill_null(texts, ""))
        lists = pc.ascii_split_whitespace(flat)  # of an empty string: an empty word
        edges = lists.offsets.to_numpy()
        n = np.diff(edges)
        labels, score = np.full(len(n), "und", object), np.zeros(len(n))
        some = np.flatnonzero(pc.not_equal(flat, "").to_numpy(zero_copy_only=False))
        if not len(some) or not self.languages:
            return labels.tolist(), score
        coded = lists.flatten().dictionary_encode()
        each = self.rows(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
        sums = np.add.reduceat(each, edges[:-1] - edges[0], axis=0, dtype=np.float64)[some]
        mean = sums / n[some][:, None]
        best = mean.argmax(axis=1)
        z = np.exp((mean - mean.max(axis=1, keepdims=True)) * np.minimum(n[some], SURE)[:, None])
        labels[some] = np.array(self.languages, object)[best]
        score[some] = 1 / z.sum(axis=1)
        return labels.tolist(), score


def _letters(texts: pa.Array) -> pa.Array:
    """Runs of letters in lower case, one space between them."""
    return pc.ascii_trim_whitespace(pc.replace_substring_regex(pc.utf8_lower(texts), r"[^\pL]+", " "))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 1500, parts: int = 3, held: int = 1, longest: int = LONGEST) -> Model:
    """Learns from rows with a language outside fold ``held`` of the ids."""
    id_ = F.col(id_col)
    usable = docs.where(F.col(lang_col).isNotNull() & F.coalesce(fold(id_, parts) != held, F.lit(True))).select(id_.alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    sizes = cut(usable.groupBy("lang").agg(F.count(F.lit(1)).alias("rows")))
    # A row a language, which the model has columns of; beyond that many the planner is left to choose.
    small = F.broadcast if sizes.count() <= SMALL else (lambda df: df)
    sample = usable.join(small(sizes), "lang").where(F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1 << 30)) < F.lit(per_language) / F.col("rows") * (1 << 30))
    letters = F.split(F.trim(F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}]+", " ")), " ")
    words = sample.select("lang", F.explode(letters).alias("word")).where("word <> ''").groupBy("lang", "word").agg(F.count(F.lit(1)).alias("times"))

    def of_length(k: int):
        spots = F.sequence(F.lit(1), F.greatest(F.length("padded") - (k - 1), F.lit(1)))
        return F.transform(spots, lambda i: F.struct(F.lit(k).alias("n"), F.substring("padded", i, F.lit(k)).alias("gram")))

    every = F.concat(F.array(F.struct(F.lit(0).alias("n"), F.col("word").alias("gram"))), *[of_length(k) for k in range(1, longest + 1)])
    grams = words.withColumn("padded", F.concat(F.lit(" "), "word", F.lit(" "))).select("lang", "times", F.explode(every).alias("g")).select("lang", "times", "g.n", "g.gram")
    per = grams.where((F.col("n") == 0) | (F.length("gram") == F.col("n"))).groupBy("n", "gram", "lang").agg(F.sum("times").alias("times"))
    totals = per.groupBy("n", "lang").agg(F.sum("times").alias("all"))
    shares = per.join(small(totals), ["n", "lang"]).select("n", "gram", "lang", F.log(F.col("times") / F.col("all")).cast("float").alias("share"))
    rows = shares.groupBy("n", "gram").agg(F.collect_list("lang").alias("langs"), F.collect_list("share").alias("shares")).toArrow()
    return _model(rows, longest)


def _model(rows: pa.Table, longest: int) -> Model:
    """From the sample's entries: n, gram, and for each language that has it its name and share."""
    rows = rows.combine_chunks().sort_by([("n", "ascending"), ("gram", "ascending")])
    flat = pc.list_flatten(rows["langs"]).combine_chunks()
    languages = sorted(pc.unique(flat).to_pylist())
    if not languages:
        return Model([], [], [])
    column = pc.index_in(flat, pa.array(languages, flat.type)).to_numpy(zero_copy_only=False)
    row = pc.list_parent_indices(rows["langs"]).combine_chunks().to_numpy()
    all_shares = np.full((rows.num_rows, len(languages)), PENALTY, np.float32)
    all_shares[row, column] = pc.list_flatten(rows["shares"]).combine_chunks().to_numpy()
    edges = np.searchsorted(rows["n"].to_numpy(), np.arange(longest + 2))
    grams = rows["gram"].to_pylist()
    own = list(zip(edges, edges[1:], strict=False))
    return Model(languages, [{g: i for i, g in enumerate(grams[a:b])} for a, b in own], [all_shares[a:b] for a, b in own])


def predicted(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score; columns of these names are replaced."""
    docs = docs.drop("lang_pred", "score")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, text_col):
                labels, score = shared.value.predict(part[text_col])
                yield appended(part, lang_pred=pa.array(labels, pa.string()), score=pa.array(score, pa.float64()))

    schema = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields]
    return docs.mapInArrow(run, ", ".join([*schema, "lang_pred string, score double"]))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **settings) -> DataFrame:
    """One row per row of docs: id, held_out, lang_pred, score."""
    model = fit(docs, id_col, text_col, lang_col, **settings)
    out = predicted(docs.select(id_col, text_col), model, text_col)
    held = F.coalesce(fold(F.col(id_col), 3) == 1, F.lit(False))
    return out.select(id_col, held.alias("held_out"), "lang_pred", "score")


def op5(spark, sf_dir: str) -> DataFrame:
    from brightweir.session import table

    return identify(table(spark, sf_dir, "documents"))
