"""Language identification by a mixture of languages inside each document.

Learning counts letter trigrams (with word edges) per language over all
training documents. For a document, each word gets a likelihood under every
language, the product of its trigrams' probabilities. Expectation-maximisation
over the words estimates the document's language proportions; sets of one
language up to all are compared by penalised likelihood, and the largest share
of the best set is the predicted language.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, materialise
from .words import U64, in_chunks, mix, segment

#: Trigrams are counted in so many cells, which bounds the model at languages x cells.
CELLS = 1 << 16
#: Expectation-maximisation ends for a text when no share moves by more than this; the steps are bounded against rounding alone.
SETTLED, MOST_STEPS = 1e-3, 200
#: Pseudo-count of a cell; penalty for each further language, times log(words).
SMOOTH, PENALTY = 0.05, 2.0
SCHEMA_COUNTS = "lang string, cell int, n long"


def trigram_cells(words) -> tuple[np.ndarray, np.ndarray]:
    """The cell of the trigram around each letter, and where each word's letters begin."""
    code = np.where(words.inside, words.codes, 0).astype(U64)
    before, after = np.concatenate([code[:1] * U64(0), code[:-1]]), np.concatenate([code[1:], code[:1] * U64(0)])
    key = (before[words.inside] << U64(42)) | (code[words.inside] << U64(21)) | after[words.inside]
    return (mix(key) & U64(CELLS - 1)).astype(np.int64), np.cumsum(words.lengths) - words.lengths


def _texts(batch, name):
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def count_trigrams(labelled: DataFrame) -> DataFrame:
    """``text, lang`` -> ``lang, cell, n`` over all rows; each task adds up before the shuffle."""

    def run(batches):
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            texts, langs = _texts(batch, "text"), _texts(batch, "lang")
            order = sorted(range(len(texts)), key=langs.__getitem__)
            texts, langs = [texts[i] for i in order], [langs[i] for i in order]
            for begin, end in in_chunks(texts):
                words = segment(texts[begin:end], "letters")
                cells, _ = trigram_cells(words)
                letters = np.cumsum(np.concatenate([[0], words.lengths]))[words.first]
                for lang in set(langs[begin:end]):
                    first, last = langs.index(lang, begin, end) - begin, end - begin - langs[begin:end][::-1].index(lang)
                    found = np.bincount(cells[letters[first] : letters[last]], minlength=CELLS)
                    counts[lang] = counts[lang] + found if lang in counts else found
        for lang, found in counts.items():
            cell = np.flatnonzero(found)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(cell), pa.string()), pa.array(cell, pa.int32()), pa.array(found[cell], pa.int64())], names=["lang", "cell", "n"])

    rows = labelled.where("text is not null and lang is not null").select("text", "lang").mapInArrow(run, SCHEMA_COUNTS)
    return rows.groupBy("lang", "cell").agg(F.sum("n").alias("n"))


def fit(labelled: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages in order and log-probabilities (cells x languages); at most CELLS rows a language reach the driver."""
    table = count_trigrams(labelled).toPandas()
    langs = sorted(table["lang"].unique())
    counts = np.full((CELLS, len(langs)), SMOOTH)
    for i, lang in enumerate(langs):
        own = table[table["lang"] == lang]
        counts[own["cell"].to_numpy(), i] += own["n"].to_numpy()
    return langs, np.log(counts / counts.sum(axis=0)).astype(np.float32) if langs else np.zeros((CELLS, 0), np.float32)


def proportions(likely: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word log-likelihoods (words x languages), words of text d at first[d]:first[d+1], every text with a word.

    Returns each text's language shares under its best set (0 outside the set),
    and the mean log-likelihood per word.
    """
    n, kinds = np.diff(first), likely.shape[1]
    top = likely.max(axis=1, keepdims=True)
    relative = np.exp(likely - top).astype(np.float64)

    def add(x):
        return np.add.reduceat(x, first[:-1], axis=0)

    base = add(top[:, 0].astype(np.float64))
    doc = np.repeat(np.arange(len(n)), n)

    def climb(start):
        share, live = start.copy(), np.arange(len(n))
        rows, words, count = doc, relative, n
        for _ in range(MOST_STEPS):
            part = words * share[live][rows]
            part /= part.sum(axis=1, keepdims=True) + 1e-300
            new = np.add.reduceat(part, np.cumsum(count) - count, axis=0) / count[:, None]
            open_ = np.abs(new - share[live]).max(axis=1) > SETTLED
            share[live] = new
            if not open_.any():
                break
            if not open_.all():  # each text stops by itself, whatever texts share its batch
                words = words[np.repeat(open_, count)]
                live, count = live[open_], count[open_]
                rows = np.repeat(np.arange(len(live)), count)
        return share, base + add(np.log((relative * share[doc]).sum(axis=1) + 1e-300))

    single = add(likely.astype(np.float64))
    best_share, best_gain = np.eye(kinds)[single.argmax(axis=1)], single.max(axis=1)
    if kinds > 1:
        share, _ = climb(np.full((len(n), kinds), 1 / kinds))
        rank = (-share).argsort(axis=1).argsort(axis=1)
        for most in range(2, kinds + 1):
            start = np.where(rank < most, share + 1e-6, 0)
            found, gain = climb(start / start.sum(axis=1, keepdims=True))
            gain = gain - PENALTY * (most - 1) * np.log(n + 1)
            better = gain > best_gain
            best_share[better], best_gain[better] = found[better], gain[better]
    return best_share, best_gain / n


def identify(docs: DataFrame, langs: list[str], model: np.ndarray, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns with ``lang_pred, score, languages, fit, letters``; only ``text`` is looked at.

    ``score`` is the share of the predicted language, ``languages`` the chosen
    set with its shares, ``fit`` the mean log-likelihood a letter of ``letters``. A
    null text, or one without a letter: ``und``, 0, an empty map, 0, 0. No shuffle; the model (``len(langs)`` x CELLS floats) is broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast((langs, model))
    text_at = len(keep)

    def run(batches):
        names, table = shared.value
        for batch in batches:
            texts = batch.column(text_at).to_pylist()
            pred, score, sets, fits, letters = ["und"] * len(texts), np.zeros(len(texts)), [{} for _ in texts], np.zeros(len(texts)), np.zeros(len(texts), np.int64)
            for begin, end in in_chunks(texts) if names else ():
                words = segment(texts[begin:end], "letters")
                if not len(words.starts):
                    continue
                cells, at = trigram_cells(words)
                likely = np.add.reduceat(table[cells], at, axis=0)
                worded = np.flatnonzero(np.diff(words.first))
                first = np.append(words.first[worded], words.first[-1])
                share, gain = proportions(likely, first)
                letters[begin + worded] = np.add.reduceat(words.lengths, first[:-1])
                fits[begin + worded] = gain * np.diff(first) / letters[begin + worded]
                for d, own in zip(worded, share):
                    best = int(own.argmax())
                    pred[begin + d], score[begin + d] = names[best], min(1.0, float(own[best]))
                    sets[begin + d] = {names[i]: float(own[i]) for i in np.flatnonzero(own > 0)}
            kept = [batch.column(i) for i in range(text_at)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(pred, pa.string()), pa.array(score), pa.array([list(x.items()) for x in sets], pa.map_(pa.string(), pa.float64())), pa.array(fits), pa.array(letters)], names=[*keep, "lang_pred", "score", "languages", "fit", "letters"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return docs.select(*keep, "text").mapInArrow(run, f"{schema}, lang_pred string, score double, languages map<string,double>, fit double, letters long")


def predict_languages(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Learn from the documents that are not held out, predict for all."""
    langs, model = fit(docs.where(~held_out("doc_id")))
    return identify(docs, langs, model, keep).withColumn("held_out", held_out("doc_id"))


def language_query(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs``, repeated ones too; other columns than doc_id, text and lang are not looked at.

    An empty table gives an empty result; where nothing can be learnt, all are ``und``.
    """
    return predict_languages(docs).select("doc_id", "held_out", "lang_pred", "score", "languages")


def keep_identified(docs: DataFrame, least: float = 0.4, low: float = 0.01) -> DataFrame:
    """Drop the documents that no language explains.

    These are ``und``, a largest share under ``least``, or a text whose fit is too
    low in two ways: it lies under the ``low`` quantile of the language's own
    training documents by more than that quantile lies under their median, and
    its distance from the median, times the root of its letters, is more than
    twice what all but ``low`` of those documents have. So neither clean
    documents in the tail go, nor short ones, whose fit says little. All columns
    stay as they are, extra ones too.
    """
    names = docs.columns
    langs, model = fit(docs.where(~held_out("doc_id")))
    told = identify(docs.withColumn("__row", F.struct(*[F.col(f"`{c}`") for c in names])), langs, model, keep=("__row",))
    told = materialise(told.drop("languages"), "identified")
    own = told.where(~held_out(F.col("__row.doc_id")) & (F.col("__row.lang") == F.col("lang_pred")))

    def by_language(values: dict, other: float):
        chosen = F.lit(other)
        for lang, value in values.items():
            chosen = F.when(F.col("lang_pred") == lang, F.lit(value)).otherwise(chosen)
        return chosen

    # One row a language each.
    marks = {r["lang_pred"]: r["at"] for r in own.groupBy("lang_pred").agg(F.percentile_approx("fit", [low, 0.5], 10_000).alias("at")).collect()}
    bound = by_language({lang: 2 * at[0] - at[1] for lang, at in marks.items()}, float("-inf"))
    away = (by_language({lang: at[1] for lang, at in marks.items()}, float("-inf")) - F.col("fit")) * F.sqrt("letters")
    far = {r["lang_pred"]: 2 * r["far"] for r in own.groupBy("lang_pred").agg(F.percentile_approx(away, 1 - low, 10_000).alias("far")).collect()}
    fits = (F.col("fit") >= bound) | (away <= by_language(far, float("inf")))
    return told.where((F.col("lang_pred") != "und") & (F.col("score") >= least) & fits).select("__row.*")
