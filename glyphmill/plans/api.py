"""The four verbs: build a dataset, attack it, calibrate a detector, and detect with an evaluation.

A detector is anything that gives a column or a table of scores; the relations of an evaluation come from one scored
table that is persisted while they are computed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import alignment, attacks, bootstrap, curves, metrics, sampling
from ..operators import calibration as cal
from ..sources import sinks


class TextGenerator(Protocol):
    """A source of machine texts: a local model, a server, or the n-gram chain. Loaded once in each worker."""

    def generate(self, prompts: list[str]) -> list[str]: ...


class TokenScorer(Protocol):
    """Scores of texts, one number or one vector each. Loaded once in each worker."""

    def score(self, texts: list[str]) -> list[float]: ...


class GenerationError(RuntimeError):
    """A generator that failed on a prompt, alone."""


def generated(df: DataFrame, make: Callable[[], TextGenerator], prompt: str = "prompt", to: str = "generated", errors: str | None = None) -> DataFrame:
    """df with generated texts. A failing batch is tried again prompt by prompt.

    A prompt that fails by itself ends the job with GenerationError; with errors, the name of a further column, its text is null and the
    column says why (null for all others).
    """
    schema = df.select("*", F.lit("").cast("string").alias(to), *([F.lit("").alias(errors)] if errors else [])).schema
    for name in (to, errors):
        if name:
            schema[name].nullable = True

    def one(model: TextGenerator, p: str) -> tuple[str | None, str | None]:
        try:
            return model.generate([p])[0], None
        except Exception as e:
            if not errors:
                raise GenerationError(f"{type(e).__name__}: {e}") from e
            return None, f"{type(e).__name__}: {e}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for b in batches:
            prompts = b[prompt].tolist()
            try:
                out = [(x, None) for x in model.generate(prompts)]
                if len(out) != len(prompts):
                    raise GenerationError(f"{len(out)} texts for {len(prompts)} prompts")
            except Exception:
                out = [one(model, p) for p in prompts]
            yield b.assign(**{to: [x for x, _ in out]}, **({errors: [e for _, e in out]} if errors else {}))

    return df.mapInPandas(run, schema)


def scored_by(df: DataFrame, make: Callable[[], TokenScorer], column: str = "text", to: str = "score") -> DataFrame:
    """df with a plug-in's scores."""
    schema = df.select("*", F.lit(0.0).alias(to)).schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for b in batches:
            yield b.assign(**{to: [float(x) for x in model.score(b[column].tolist())]})

    return df.mapInPandas(run, schema)


def build(df: DataFrame, make: Callable[[], TextGenerator], prefix_words: int = 64, template: str = "{prefix}", weights: tuple[float, ...] = (8, 1, 1), errors: str | None = None) -> DataFrame:
    """Human rows (id, text, ...) and a machine row for each, with df's other columns, split so that a pair stays together.

    A text that could not be generated ends the job; with errors, its machine row has no text and label, and the reason in that column.
    """
    more = [c for c in df.columns if c not in ("id", "group", "text", "label", "role", errors)]
    prompt = F.replace(F.lit(template), F.lit("{prefix}"), text.take_first(F.col("text"), prefix_words))
    none = [F.lit(None).cast("string").alias(errors)] if errors else []
    human = df.select(F.concat(F.col("id").cast("string"), F.lit("-human")).alias("id"), F.col("id").cast("string").alias("group"), "text", F.lit(0).alias("label"), F.lit("human").alias("role"), *more, *none)
    asked = df.select("id", prompt.alias("prompt"), *more)
    made = generated(asked, make, errors=errors)
    label = F.when(F.col(errors).isNull(), 1) if errors else F.lit(1)
    machine = made.select(F.concat(F.col("id").cast("string"), F.lit("-gen")).alias("id"), F.col("id").cast("string").alias("group"), F.col("generated").alias("text"), label.alias("label"), F.lit("machine").alias("role"), *more, *([errors] if errors else []))
    return sampling.split(human.unionByName(machine), "group", weights=weights)


def attack(df: DataFrame, configs: list[dict], machine_only: bool = True, path: str | None = None) -> DataFrame:
    """Attacked texts of (id, text, label) by each configuration; written by attack where a path is given."""
    rows = df.where(text.strip(F.col("text")) != "")
    out = attacks.attacked(rows.where("label = 1") if machine_only else rows, configs)
    if path:
        sinks.write_attacks(out, path)
    return out


def calibrate(df: DataFrame, score: str = "score", label: str = "label", mode: str = "acc") -> cal.Platt:
    """A Platt calibrator of the scores, with the threshold that is best by acc, f1 or tpr."""
    model = cal.fit_platt(df, score, label)
    scored = cal.finite_rows(df, score).select(F.col(label).alias("y"), cal.platt(F.col(score), model).alias("prob"))
    best = curves.best_threshold(scored, mode).first()
    if best and best.threshold is not None:
        model.decision_threshold = best.threshold
    return model


@dataclass
class Evaluation:
    """The relations of an evaluation by name, and how to write them."""

    relations: dict[str, DataFrame]
    held: DataFrame | None = None

    def write(self, path: str) -> None:
        """Writes all relations, and gives back the storage of the scored rows."""
        sinks.write_results(self.relations, path)
        self.release()

    def release(self) -> None:
        """Gives back the storage of the scored rows; the relations stay usable and compute them anew."""
        if self.held is not None:
            self.held.unpersist()


def detect(df: DataFrame, model: cal.Platt, score: Column | str = "score", label: str = "label", groups: tuple[str, ...] = ("lang", "source", "model"), variants: DataFrame | None = None) -> Evaluation:
    """Evaluates scores (id, score, label, group columns): summary, curves, operating points, bins, groups, and attack success on variants (k, method, y, score)."""
    value = F.col(score) if isinstance(score, str) else score
    own = [g for g in groups if g in df.columns]
    rows = df.withColumn("__score", value.cast("double"))
    rows = cal.finite_rows(rows, "__score").select("id", F.col(label).alias("y"), *own, cal.platt(F.col("__score"), model).alias("prob")).persist(StorageLevel.MEMORY_AND_DISK)
    t = model.decision_threshold
    out = {
        "scored": rows.withColumn("pred", (F.col("prob") >= t).cast("int")),
        "summary": metrics.basic_stats(rows, t).crossJoin(curves.roc_auc(rows).withColumnRenamed("auc", "auroc")).crossJoin(curves.pr_auc(rows).withColumnRenamed("auc", "aupr")).crossJoin(metrics.ece_brier(rows).drop("n")),
        "tpr_at_fpr": curves.tpr_at_fpr(rows),
        "curve_roc": curves.roc_curve(rows),
        "curve_pr": curves.pr_curve(rows),
        "curve_rc": curves.risk_coverage(rows, threshold=t),
        "reliability": metrics.reliability_bins(rows),
        "thresholds": metrics.threshold_table(rows, [t, 0.5]),
        "ci95": bootstrap.intervals(rows, threshold=t),
    }
    if own:
        out["group_metrics"] = metrics.all_groups(rows, own, t)
    if variants is not None:
        base = rows.select(F.col("id").alias("k"), "y", "prob")
        by = alignment.attack_success(base, variants.select("k", "method", "y", cal.platt(F.col("score"), model).alias("prob")), t)
        out |= {"asr_by_method": by, "asr_summary": alignment.success_summary(by)}
    return Evaluation(out, rows)
