"""Soft-membership mixing: nonnegative rates of documents whose expected domain token totals match target weights.

A classifier trained on a labelled table gives each document a posterior over domains. Projected gradient then solves the least squares problem
``min (sum_i r_i n_i p_i - T)' Q^-1 (sum_i r_i n_i p_i - T), least <= r_i`` for the rates r_i, with n_i tokens, posterior p_i, target totals T and Q = sum_i n_i p_i p_i', in the metric of the
tokens (a document's step is its posterior times Q^-1 times the residual) and with momentum. Weighting by Q^-1 makes the step size 1, and a pass enough where no rate is held by its bound.
Each iteration is one pass over the table of posteriors and rates in which a document's rate is replayed from the last few residuals; every KEEP iterations
the table is written anew with its rates. Only one number a domain passes through the driver. It ends when the totals are within TOLERANCE of the targets, or when the projected gradient moves
no more than a hundredth of that: then no rates reach the targets, and the totals are the nearest in the metric of Q; or after ITERATIONS passes towards these. ``missed`` tells how far the totals are off.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm import text as tx
from loomgraph.llm.store import mapped, saved
from loomgraph.llm.toxicity import Machine, fit, labelled_terms, marked, terms, toxic_machine

DOMAINS = ("high", "low", "toxic")
#: A part of all tokens.
TOLERANCE = 1e-3
#: Passes at most; only targets out of reach take many.
ITERATIONS = 60
#: Iterations after which rates are written.
KEEP = 20
log = logging.getLogger(__name__)


def domain_machines(docs: DataFrame, labels: DataFrame) -> tuple[Machine, Machine]:
    """Classifiers of label toxic and, among texts that aren't, of label quality."""
    rows = labelled_terms(docs, labels)
    return toxic_machine(rows), fit(rows.filter("coalesce(toxic, 0) = 0").select(F.col("quality").alias("label"), "terms"))


def _posteriors(batches: Iterator[pa.RecordBatch], toxic: Machine, quality: Machine) -> Iterator[pa.RecordBatch]:
    wanted = marked(toxic, quality)
    for batch in batches:
        texts = tx.strings(batch.column("text"))
        for a, b in tx.slices(texts):
            t, at, n = terms(texts.slice(a, b - a), wanted)
            bad, good = toxic.scores(*toxic.lookup(t, at)), quality.scores(*quality.lookup(t, at))
            yield pa.record_batch([batch.column("doc_id").slice(a, b - a), pa.array(n), pa.array((1 - bad) * good), pa.array((1 - bad) * (1 - good)), pa.array(bad)], ["doc_id", "n_tokens", *[f"p_{d}" for d in DOMAINS]])


def _columns(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return batch.column("n_tokens").to_numpy().astype(float), np.stack([batch.column(f"p_{d}").to_numpy() for d in DOMAINS], axis=1)


def rates(p: np.ndarray, rate: np.ndarray, ahead: np.ndarray, steps: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rates of documents with posteriors p after some more steps (each the weighted residual of the domains, and the weight of the move that follows it), the point
    to look at next, and what the last projected gradient has moved."""
    moved = np.zeros(len(rate))
    for s in steps:
        new = np.maximum(ahead - p @ s[:-1], least)
        moved = np.abs(new - ahead)
        ahead, rate = new + s[-1] * (new - rate), new
    return rate, ahead, moved


def _replayed(batch: pa.RecordBatch, steps: np.ndarray, least: float) -> tuple[np.ndarray, ...]:
    n, p = _columns(batch)
    return n, p, *rates(p, batch.column("rate").to_numpy(), batch.column("ahead").to_numpy(), steps, least)


def _totals(batches: Iterator[pa.RecordBatch], steps: np.ndarray, least: float) -> Iterator[pa.RecordBatch]:
    """Totals at the point to look at, those of the rates, sum of n p p', and the tokens that the last step has moved."""
    k = len(DOMAINS)
    total, reached, square, far = np.zeros(k), np.zeros(k), np.zeros((k, k)), 0.0
    for batch in batches:
        n, p, rate, ahead, moved = _replayed(batch, steps, least)
        far += float(moved @ n)
        total += (ahead * n) @ p
        reached += (rate * n) @ p
        square += (p * n[:, None]).T @ p
    yield pa.record_batch([pa.array([total.tolist()]), pa.array([reached.tolist()]), pa.array([square.ravel().tolist()]), pa.array([[far]])], ["total", "reached", "square", "moved"])


def _moved(batches: Iterator[pa.RecordBatch], steps: np.ndarray, least: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        _, _, rate, ahead, _ = _replayed(batch, steps, least)
        kept = [n for n in batch.schema.names if n not in ("rate", "ahead")]
        yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in kept], pa.array(rate), pa.array(ahead)], [*kept, "rate", "ahead"])


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float], least: float = 0.0, iterations: int = ITERATIONS, machines: tuple[Machine, Machine] | None = None) -> DataFrame:
    """doc_id, n_tokens (words), p_high, p_low, p_toxic, rate, missed and copies of every row of docs.

    ``targets`` are the domains' weights. The total of expected tokens is that of docs; with ``least`` over 0 it is as much as the weights need while
    no document's rate falls below least. Rates have no upper bound, so the documents of a rare domain with a large weight are repeated as often as it needs. ``missed`` is the largest
    difference between a domain's expected tokens and its target, as a part of all tokens (the same in all rows; over TOLERANCE if no rates reach the targets, or ``iterations`` passes don't). ``copies`` is rate rounded up or down by a
    hash of doc_id, so it equals the rate on average. Documents without words have the rate they start with (1, or least). Rows with a null id and repeated rows
    are documents like others.
    """
    toxic, quality = machines or domain_machines(docs, labels)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, n_tokens long, " + ", ".join(f"p_{d} double" for d in DOMAINS)
    start = F.lit(max(1.0, least))
    table = saved(rows.transform(mapped, _posteriors, schema, toxic=toxic, quality=quality).withColumns({"rate": start, "ahead": start}), "posteriors")
    schema += ", rate double, ahead double"
    k = len(DOMAINS)

    def totals(rows: DataFrame, steps: np.ndarray) -> list[np.ndarray]:
        found = rows.transform(mapped, _totals, "total array<double>, reached array<double>, square array<double>, moved array<double>", steps=steps, least=least).collect()
        return [sum((np.array(r[c]) for r in found), np.zeros(m)) for c, m in (("total", k), ("reached", k), ("square", k * k), ("moved", 1))]

    weights = np.array([targets[d] for d in DOMAINS], float)
    weights /= weights.sum()
    steps, done, missed = np.zeros((0, k + 1)), 0, 0.0
    now, reached, square, _ = totals(table, steps)
    if now.sum() > 0:
        growth = 1.0
        if least > 0:
            some = weights > 0  # tokens of a domain that should have none can't be outgrown
            growth = max(1.0, float((least * now[some] / now.sum() / weights[some]).max()))
        goal = weights * now.sum() * growth
        weigh = np.linalg.pinv(square.reshape(k, k), rcond=1e-9, hermitian=True)
        miss = lambda: float(np.abs(reached - goal).max() / goal.sum())
        t, gap, missed, moved = 1.0, np.inf, miss(), np.inf
        while missed >= TOLERANCE and moved >= TOLERANCE / 100 and done < iterations:
            done += 1
            last, gap = gap, float((now - goal) @ weigh @ (now - goal))
            t = 1.0 if gap > last else t  # momentum starts anew when it leads astray
            after = (1 + (1 + 4 * t * t) ** 0.5) / 2
            steps = np.vstack([steps, [*(weigh @ (now - goal)), (t - 1) / after]])
            t = after
            if len(steps) == KEEP:
                table, steps = saved(table.transform(mapped, _moved, schema, steps=steps, least=least), "rates"), np.zeros((0, k + 1))
                now, reached, _, _ = totals(table, steps)
            else:
                now, reached, _, far = totals(table, steps)
                moved = float(far[0] / goal.sum())
            missed = miss()
        told = ", ".join(f"{d} {a:.0f} of {b:.0f}" for d, a, b in zip(DOMAINS, reached, goal, strict=True))
        log.log(logging.WARNING if missed >= TOLERANCE else logging.INFO, "mixing after %d steps: %s", done, told)
    rated = table.transform(mapped, _moved, schema, steps=steps, least=least).drop("ahead").withColumn("missed", F.lit(missed))
    unit = F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(-1)), F.lit(29)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return rated.withColumn("copies", F.floor(F.col("rate") + unit).cast("long"))
