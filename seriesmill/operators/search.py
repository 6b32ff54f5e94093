"""Parameter search within a time budget: successive halving over nested samples of the rows."""

from __future__ import annotations

import hashlib
import json
import math
import threading
import time
import uuid
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor, wait

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from seriesmill.functions.draws import hash_share
from seriesmill.operators.models import fit_model, parameter_grid
from seriesmill.operators.split import split_head_tail
from seriesmill.session import cut_lineage

TRIALS = "trial int, rung int, share double, params string, mse double, seconds double, outcome string"


def draw_candidates(space: Mapping[str, Sequence], trials: int, seed: int, start: Mapping | None = None) -> list[dict]:
    """At most ``trials`` different points of the grid in a seeded order; ``start`` comes first."""
    grid = sorted(parameter_grid(space), key=lambda p: hashlib.md5(f"{seed}|{json.dumps(p, sort_keys=True)}".encode()).hexdigest())
    first = [dict(start)] if start else []
    return (first + [p for p in grid if p not in first])[:trials]


def rung_sizes(candidates: int, eta: int, least_share: float) -> list[tuple[int, float]]:
    """Candidates and share of the training rows per rung; the last rung has all rows.

    A rung keeps one in ``eta`` and takes ``eta`` times the rows; there are as many
    rungs as ``least_share`` and the candidates allow.
    """
    rungs = 1 + max(0, min(math.floor(math.log(1 / least_share, eta) + 1e-9), math.ceil(math.log(max(1, candidates), eta) - 1e-9)))
    out, left = [], candidates
    for k in range(rungs):
        out.append((left, float(eta) ** (k + 1 - rungs)))
        left = max(1, -(-left // eta))
    return out


def halving_search(
    df: DataFrame,
    features: Sequence[str],
    target: str,
    order: Sequence[Column],
    chunk: Sequence[Column],
    row_id: str,
    family: str,
    space: Mapping[str, Sequence],
    trials: int = 25,
    seconds_per_fit: float = 60.0,
    budget_seconds: float = math.inf,
    eta: int = 3,
    least_share: float = 1 / 27,
    holdout: float = 0.2,
    parallelism: int = 4,
    seed: int = 42,
    start: Mapping | None = None,
) -> tuple[dict, DataFrame]:
    """Best parameters found within the budget, and the log of all trials.

    The last ``holdout`` share in time order is kept for scoring and is scored
    whole.  All candidates fit a small sample of the other rows first; the best
    one in ``eta`` of them go on with ``eta`` times as many, up to all rows.  Samples
    are nested: a row belongs to every sample above its hash of ``row_id``.

    A fit that takes longer than ``seconds_per_fit`` has its Spark jobs cancelled
    and loses.  When ``budget_seconds`` are over, what runs is cancelled and what
    has not begun is logged as ``skipped``; the answer then is the best of the last
    rung that scored anything.  Raises ``ValueError`` when nothing was scored.

    The log has ``trial``, ``rung``, ``share``, ``params`` (JSON), ``mse`` (NULL
    unless ``outcome`` is ``done``), ``seconds`` and ``outcome`` (``done``,
    ``out_of_time``, ``skipped``).  Runs jobs; the split rows are checkpointed.
    """
    began = time.monotonic()
    spark = df.sparkSession
    context = spark.sparkContext
    candidates = draw_candidates(space, trials, seed, start)
    if not candidates:
        raise ValueError("the space has no point")
    others = [c for c in df.columns if c not in features and c != target]
    parts = split_head_tail(df.select(*features, target, *others), order, chunk, 1 - holdout)
    kept = parts.select(*features, target, "split", hash_share(F.col(row_id), "sample", seed, method="xxhash64").alias("__share"))
    kept = cut_lineage(kept)
    train, test = kept.filter("split = 'train'"), kept.filter("split = 'test'").drop("__share")

    def remaining() -> float:
        return budget_seconds - (time.monotonic() - began)

    def attempt(params: dict, share: float) -> tuple[float | None, float, str]:
        limit = min(seconds_per_fit, remaining())
        if limit <= 0:
            return None, 0.0, "skipped"
        tag, late = f"search-{uuid.uuid4().hex}", threading.Event()
        context.addJobTag(tag)

        def stop() -> None:
            late.set()
            context.cancelJobsWithTag(tag)

        timer = threading.Timer(limit, stop) if math.isfinite(limit) else None
        if timer:
            timer.daemon = True
            timer.start()
        first = time.monotonic()
        try:
            model = fit_model(train.filter(F.col("__share") < share).drop("__share"), features, target, family, params)
            error = F.col(target) - F.col("y_hat")
            mse = model.predict(test).agg(F.avg(error * error)).first()[0] if not late.is_set() else None
        except Exception:
            if not late.is_set():
                raise
            mse = None
        finally:
            if timer:
                timer.cancel()
            context.removeJobTag(tag)
        spent = time.monotonic() - first
        if late.is_set() or mse is None:
            return None, spent, "out_of_time" if late.is_set() else "done"
        return float(mse), spent, "done"

    log, living, best = [], list(range(len(candidates))), None
    rungs = rung_sizes(len(candidates), eta, least_share)
    with ThreadPoolExecutor(max_workers=parallelism) as pool:
        for rung, (size, share) in enumerate(rungs):
            living = living[:size]
            running = [pool.submit(inheritable_thread_target(spark)(attempt), candidates[c], share) for c in living]
            wait(running)
            scored = []
            for c, result in zip(living, running):
                mse, spent, outcome = result.result()
                log.append((c, rung, share, json.dumps(candidates[c], sort_keys=True), mse, spent, outcome))
                if mse is not None:
                    scored.append((mse, c))
            if scored:
                best = min(scored)[1]
            living = [c for _, c in sorted(scored)]
            if not living or remaining() <= 0:
                break
    if best is None:
        raise ValueError("no trial was scored within the budget")
    return candidates[best], spark.createDataFrame(log, TRIALS)
