"""Theme classifiers: TF-IDF or embeddings, balanced logistic regression, calibration inside every fold.

Every labelled row counts.  One task fits one fold of one theme in numpy; folds
and themes run side by side.  Where a theme has more rows than a task should
keep, the sums of each step are made where the rows are.  Features and scores go
over the whole scope.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.operators.corpus import PARTS, scope
from textloom.operators.duplicates import tfidf
from textloom.operators.labels import training_labels
from textloom.operators.ranking import curve
from textloom.plans.graph import written
from textloom.plans.vectors import _flat
from textloom.registry import query

FOLDS, INNER, MAX_FEATURES, TERMS = 5, 3, 5000, 20
#: Entries of a theme's labelled rows that a task keeps at most, and rows that a step of a task looks at together.
TASK, PIECE = 2_000_000, 2_000
#: Positives that a theme needs for words and for embeddings, and judged negatives.
LEAST_POS, TRUST_POS, LEAST_NEG = 25, 150, 50


def vectors(segments: DataFrame, max_features: int = MAX_FEATURES) -> tuple[DataFrame, list[str]]:
    """(segment_id, at, value) of every segment: its L2-normal TF-IDF weights by dimension; and the dimensions' terms.

    Terms in fewer than two segments don't count, and of the others the most frequent do.
    """
    v = written(tfidf(segments, "segment_id", "text", max_features=max_features))
    terms = sorted(r.term for r in v.select("term").distinct().collect())  # max_features at most
    number = F.broadcast(v.sparkSession.createDataFrame([(t, i) for i, t in enumerate(terms)], "term string, at int"))
    rows = v.join(number, "term").groupBy("segment_id").agg(F.sort_array(F.collect_list(F.struct("at", "weight"))).alias("x"))
    d = segments.select("segment_id").join(rows, "segment_id", "left")
    return d.select("segment_id", F.coalesce("x.at", F.array().cast("array<int>")).alias("at"), F.coalesce("x.weight", F.array().cast("array<double>")).alias("value")), terms


def dense(rows: DataFrame) -> DataFrame:
    """(segment_id, at, value) of (segment_id, embedding)."""
    return rows.select("segment_id", F.sequence(F.lit(0), F.size("embedding") - 1).alias("at"), F.col("embedding").cast("array<double>").alias("value"))


class _Rows:
    """Sparse rows: the values' dimensions and rows."""

    def __init__(self, table, width: int):
        at, sizes = _flat(table.column("at"))
        self.row, self.at = np.repeat(np.arange(len(sizes)), sizes), at.astype(np.int64)
        self.value = _flat(table.column("value"))[0].astype(float)
        self.n, self.width = len(sizes), width

    def dot(self, w):
        return np.bincount(self.row, self.value * w[self.at], self.n)

    def back(self, r):
        return np.bincount(self.at, self.value * r[self.row], self.width)


def _loss(x: _Rows, y: np.ndarray, weight: np.ndarray, w: np.ndarray) -> tuple[float, np.ndarray]:
    """The rows' part of the loss, and of its slope by weights and intercept."""
    sign = 2 * y - 1
    m = sign * (x.dot(w[:-1]) + w[-1])
    r = -weight * sign / (1 + np.exp(np.clip(m, -500, 500)))
    return float((weight * np.logaddexp(0, -m)).sum()), np.append(x.back(r), r.sum())


def _fit(width: int, steps: int = 60):
    """Weights and intercept of a logistic regression, penalty as with C = 1, by limited-memory quasi-Newton steps.

    Yields the points at which it asks for the loss and slope over all rows, so they can be added up in a task or over many.
    """

    def asked(w):
        f, g = yield w
        return f + w[:-1] @ w[:-1] / 2, g + np.append(w[:-1], 0)

    w = np.zeros(width + 1)
    f, g = yield from asked(w)
    past: list = []
    for _ in range(steps):
        q, sums = g.copy(), []
        for s, d, rho in reversed(past):
            a = rho * (s @ q)
            sums.append(a)
            q -= a * d
        if past:
            s, d, _ = past[-1]
            q *= (s @ d) / (d @ d)
        for (s, d, rho), a in zip(past, reversed(sums)):
            q += (a - rho * (d @ q)) * s
        size, slope = 1.0 if past else 1 / max(1.0, np.abs(g).sum()), -(g @ q)
        while True:
            now = w - size * q
            f2, g2 = yield from asked(now)
            if f2 <= f + 1e-4 * size * slope or size < 1e-10:
                break
            size /= 2
        s, d = now - w, g2 - g
        w, done, f, g = now, abs(f - f2) <= 1e-9 * max(1.0, abs(f)), f2, g2
        if s @ d > 1e-12:
            past = [*past[-9:], (s, d, 1 / (s @ d))]
        if done:
            break
    return w


def _platt_sums(m: np.ndarray, y: np.ndarray, pos: int, n: int, ab: np.ndarray) -> np.ndarray:
    """The rows' part of slopes and curvatures, with targets drawn in a little so that few rows don't make it a step."""
    t = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (n - pos + 2))
    p = 1 / (1 + np.exp(-np.clip(ab[0] * m + ab[1], -500, 500)))
    r, h = p - t, p * (1 - p) + 1e-9
    return np.array([r @ m, r.sum(), h @ (m * m), h @ m, h.sum()])


def _platt(pos: int, n: int):
    """Slope and intercept of a sigmoid on ``n`` margins; yields the points at which it asks for ``_platt_sums``."""
    a, b = 0.0, float(np.log((pos + 1) / (n - pos + 1)))
    for _ in range(50):
        ga, gb, haa, hab, hbb = yield np.array([a, b])
        haa, hbb = haa + 1e-9, hbb + 1e-9
        det = haa * hbb - hab * hab
        if det <= 1e-15:
            break
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        most = max(1.0, abs(da) / 5, abs(db) / 5)
        a, b = a - da / most, b - db / most
        if abs(da) + abs(db) < 1e-9:
            break
    return np.array([a, b])


def _settled(steps: dict, answers) -> dict:
    """What each of ``steps`` returns; ``answers`` takes the points of those that still ask, by name, and gives what they ask for."""
    out: dict = {}

    def to(name, value):
        try:
            return {name: steps[name].send(value)}
        except StopIteration as end:
            out[name] = end.value
            return {}

    points = {k: v for name in steps for k, v in to(name, None).items()}
    while points:
        told = answers(points)
        points = {k: v for name in points for k, v in to(name, told[name]).items()}
    return out


def _balance(pos: int, n: int) -> np.ndarray:
    """The weight of a negative and of a positive among ``n`` rows."""
    return np.array([n / (2 * max(1, n - pos)), n / (2 * max(1, pos))])


def _calibrated(x: _Rows, y: np.ndarray, use: np.ndarray, inner: np.ndarray) -> list[np.ndarray]:
    """Models as (weights, intercept, slope, shift), one for each inner fold: fitted on the others and calibrated on that one, which it hasn't seen."""
    out = []
    for k in range(INNER):
        train, held = use & (inner != k), use & (inner == k)
        if 0 < y[train].sum() < train.sum() and held.any():
            weight = _balance(y[train].sum(), train.sum())[y] * train
            w = _settled({k: _fit(x.width)}, lambda p: {i: _loss(x, y, weight, w) for i, w in p.items()})[k]
            m, own = (x.dot(w[:-1]) + w[-1])[held], y[held]
            out.append(np.append(w, _settled({k: _platt(own.sum(), len(own))}, lambda p: {i: _platt_sums(m, own, own.sum(), len(own), ab) for i, ab in p.items()})[k]))
    return out


def _chance(models: list[np.ndarray], x: _Rows) -> np.ndarray:
    """The mean of the models' calibrated probabilities."""
    total = np.zeros(x.n)
    for m in models:
        total += 1 / (1 + np.exp(-np.clip(m[-2] * (x.dot(m[:-3]) + m[-3]) + m[-1], -500, 500)))
    return total / max(1, len(models))


def _fold_task(table: pa.Table, width: int) -> pa.Table:
    """One outer fold of one theme: scores of its rows from models that saw none of them, not even to calibrate; past the last fold the final models."""
    k = table.column("fold")[0].as_py()
    y, outer, inner = (table.column(c).to_numpy() for c in ("y", "outer", "inner"))
    x = _Rows(table, width)
    theme = table.column("theme_id")[0].as_py()
    models = _calibrated(x, y, outer != k, inner)
    names = ["theme_id", "segment_id", "y", "oof_score", "model"]
    if k == FOLDS:
        return pa.Table.from_arrays([pa.array([theme], pa.string()), pa.array([None], pa.string()), pa.array([None], pa.int32()), pa.array([None], pa.float64()), pa.array([np.array(models).tobytes()], pa.binary())], names)
    held = np.flatnonzero(outer == k)
    score = _chance(models, x)[held] if models else np.full(len(held), 0.5)
    n = len(held)
    return pa.Table.from_arrays([pa.array([theme] * n, pa.string()), table.column("segment_id").take(pa.array(held)).combine_chunks(), pa.array(y[held], pa.int32()), pa.array(score, pa.float64()), pa.nulls(n, pa.binary())], names)


def _pieces(batches, width: int):
    """(theme, y, outer, inner, rows, piece) of slices of one theme."""
    for batch in batches:
        for a in range(0, len(batch), PIECE):
            piece = batch.slice(a, PIECE)
            names = np.array(piece.column("theme_id").to_pylist())
            for theme in dict.fromkeys(names.tolist()):
                own = piece.filter(pa.array(names == theme))
                yield theme, *(own.column(c).to_numpy() for c in ("y", "outer", "inner")), _Rows(own, width), own


def _added(rows: DataFrame, points: dict, width: int, part) -> dict:
    """For each point (theme, outer, inner) the sum of ``part(name, point, y, outer, inner, x)`` over its theme's rows: a partition adds its own up, the driver those of all."""
    shared = rows.sparkSession.sparkContext.broadcast(points)

    def sums(batches):
        total: dict = {}
        for theme, y, outer, inner, x, _ in _pieces(batches, width):
            for name, point in shared.value.items():
                if name[0] == theme:
                    own = part(name, point, y, outer, inner, x)
                    total[name] = total[name] + own if name in total else own
        yield pa.RecordBatch.from_arrays([pa.array([n[0] for n in total], pa.string()), *(pa.array([n[i] for n in total], pa.int32()) for i in (1, 2)), pa.array([v.tobytes() for v in total.values()], pa.binary())], ["theme_id", "outer", "inner", "sums"])

    out: dict = {}
    for r in rows.mapInArrow(sums, "theme_id string, outer int, inner int, sums binary").collect():  # a vector a task and model
        name, own = (r.theme_id, r.outer, r.inner), np.frombuffer(r.sums)
        out[name] = out[name] + own if name in out else own
    shared.destroy()
    return out


def _fitted_over_tasks(rows: DataFrame, width: int) -> tuple[DataFrame, dict]:
    """The same as ``_fold_task`` of themes with more rows than a task should keep: each step's sums are made where the rows are."""
    rows = written(rows).coalesce(rows.sparkSession.sparkContext.defaultParallelism)
    counts = rows.groupBy("theme_id", "outer", "inner").agg(F.sum("y").alias("pos"), F.count("*").alias("n")).collect()  # FOLDS * INNER rows a theme
    train, held = {}, {}
    for theme in {r.theme_id for r in counts}:
        for k in range(FOLDS + 1):
            for j in range(INNER):
                for found, inside in ((train, False), (held, True)):
                    own = [r for r in counts if r.theme_id == theme and r.outer != k and (r.inner == j) == inside]
                    found[theme, k, j] = sum(r.pos for r in own), sum(r.n for r in own)
    names = sorted(name for name, (pos, n) in train.items() if 0 < pos < n and held[name][1])

    def loss(name, w, y, outer, inner, x):
        f, g = _loss(x, y, _balance(*train[name])[y] * ((outer != name[1]) & (inner != name[2])), w)
        return np.append(g, f)

    def asked(points):
        return {name: (v[-1], v[:-1]) for name, v in _added(rows, points, width, loss).items()}

    weights = _settled({name: _fit(width) for name in names}, asked)

    def calibration(name, point, y, outer, inner, x):
        w, ab = point
        own = (outer != name[1]) & (inner == name[2])
        return _platt_sums((x.dot(w[:-1]) + w[-1])[own], y[own], *held[name], ab)

    sigmoids = _settled({name: _platt(*held[name]) for name in names}, lambda points: _added(rows, {n: (weights[n], ab) for n, ab in points.items()}, width, calibration))
    models: dict = {(theme, k): [] for theme, k, _ in train}
    for name in names:
        models[name[:2]].append(np.append(weights[name], sigmoids[name]))
    shared = rows.sparkSession.sparkContext.broadcast(models)

    def score(batches):
        for theme, y, outer, _, x, piece in _pieces(batches, width):
            out = np.full(len(y), 0.5)
            for k in range(FOLDS):
                if shared.value[theme, k] and (outer == k).any():
                    out[outer == k] = _chance(shared.value[theme, k], x)[outer == k]
            yield pa.RecordBatch.from_arrays([piece.column("theme_id"), piece.column("segment_id"), pa.array(y, pa.int32()), pa.array(out)], ["theme_id", "segment_id", "y", "oof_score"])

    return written(rows.mapInArrow(score, "theme_id string, segment_id string, y int, oof_score double")), {theme: own for (theme, k), own in models.items() if k == FOLDS}


def fitted(x: DataFrame, labels: DataFrame, width: int) -> tuple[DataFrame, dict]:
    """Out-of-fold scores (theme_id, segment_id, y, oof_score) of the labelled rows, and each theme's final models.

    Every labelled row counts.  Folds go by hash, so classes are spread about
    evenly.  A theme of at most ``TASK`` entries is fitted by folds in tasks,
    a larger one over all tasks, by the same steps.
    """
    own = labels.select("theme_id", "segment_id", F.col("y").cast("int").alias("y"))
    fold = lambda seed, n: F.pmod(F.xxhash64("segment_id", F.lit(seed)), F.lit(n)).cast("int")
    rows = x.join(own, "segment_id").select("theme_id", "segment_id", "y", fold("outer", FOLDS).alias("outer"), fold("inner", INNER).alias("inner"), "at", "value")
    sizes = rows.groupBy("theme_id").agg(F.sum(F.size("at") + 1).alias("size")).filter(F.col("size") > TASK).select("theme_id").collect()  # a codebook
    large = F.col("theme_id").isin(*(r.theme_id for r in sizes))
    few = rows.filter(~large).withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(FOLDS))))
    out = written(few.groupBy("theme_id", "fold").applyInArrow(lambda t: _fold_task(t, width), "theme_id string, segment_id string, y int, oof_score double, model binary"))
    models = {r.theme_id: list(np.frombuffer(r.model).reshape(-1, width + 3)) if r.model else [] for r in out.filter("segment_id is null").collect()}  # a codebook
    scores = out.filter("segment_id is not null").select("theme_id", "segment_id", "y", "oof_score")
    if sizes:
        more, own_models = _fitted_over_tasks(rows.filter(large), width)
        scores, models = scores.unionByName(more), models | own_models
    return scores, models


def scored(x: DataFrame, models: dict, width: int) -> DataFrame:
    """(theme_id, segment_id, score) of every row under every theme's models."""
    shared = x.sparkSession.sparkContext.broadcast(models)  # some thousand numbers a theme

    def score(batches):
        for batch in batches:
            rows = _Rows(batch, width)
            for theme, own in shared.value.items():
                yield pa.RecordBatch.from_arrays([pa.array([theme] * len(batch), pa.string()), batch.column("segment_id"), pa.array(np.round(_chance(own, rows), 9))], ["theme_id", "segment_id", "score"])

    return x.select("segment_id", "at", "value").mapInArrow(score, "theme_id string, segment_id string, score double")


def metrics(held: DataFrame) -> DataFrame:
    """Of each theme: average precision over out-of-fold scores, and the threshold with the best F1 (the lowest of equals) with its precision and recall."""
    c = curve(held.select("theme_id", F.col("oof_score").alias("score"), "y")).filter("all_pos > 0")
    p, r = F.col("tp") / F.col("k"), F.col("tp") / F.col("all_pos")
    f1 = F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))
    best = F.struct(F.round(f1, 12).alias("f1"), (-F.col("score")).alias("s"), p.alias("p"), r.alias("r"))
    g = c.groupBy("theme_id").agg(F.sum(F.col("pos") / F.col("all_pos") * p).alias("pr_auc"), F.max(best).alias("b"))
    return g.select("theme_id", F.col("b.p").alias("precision"), F.col("b.r").alias("recall"), F.col("b.f1").alias("f1"), "pr_auc", (-F.col("b.s")).alias("threshold"))


def top_terms(models: list, terms: list[str], most: int = TERMS) -> list[tuple[str, str, float, int]]:
    """(direction, term, weight, rank) of the terms with the highest and the lowest mean weight."""
    mean = np.mean([m[:-3] for m in models], axis=0).tolist() if models else [0.0] * len(terms)
    order = sorted(range(len(terms)), key=lambda i: (-mean[i], terms[i]))
    return [("positive", terms[i], mean[i], k) for k, i in enumerate(order[:most], 1)] + [("negative", terms[i], mean[i], k) for k, i in enumerate(order[::-1][:most], 1)]


def training_pass(segments: DataFrame, labels: DataFrame, themes: DataFrame, mode: str = "reviewed", least_pos: int = LEAST_POS, features: DataFrame | None = None, least_neg: int = LEAST_NEG) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One pass over the active themes: a row a theme with status and metrics; scores of every segment; top terms.

    Features are made once, over the whole scope, so a theme scores alike
    whatever it's trained with.  ``labels``: theme_id, segment_id, y.  Themes
    with too few labels are skipped, and their status says what is missing.
    ``features`` (segment_id, embedding) takes the place of word features; then
    there are no terms.
    """
    spark = segments.sparkSession
    x, terms = (dense(features), None) if features is not None else vectors(segments)
    x = written(x)
    width = len(terms) if terms is not None else x.agg(F.coalesce(F.max(F.size("at")), F.lit(0))).first()[0]
    own = written(labels.select("theme_id", "segment_id", "y").join(x.select("segment_id"), "segment_id", "left_semi"))
    n = own.groupBy("theme_id").agg(F.count_if(F.col("y") == 1).alias("n_pos"), F.count_if(F.col("y") == 0).alias("n_neg"))
    counts = themes.filter("status = 'active'").select("theme_id").join(n, "theme_id", "left").na.fill(0)
    few = "skipped_insufficient_positives" if least_pos == LEAST_POS else "skipped_below_trust_floor"
    needed = 1 if mode == "all_uncoded" else least_neg
    status = F.when(F.col("n_pos") < least_pos, few).when(F.col("n_neg") < needed, "skipped_insufficient_negatives").otherwise("trained")
    runs = written(counts.withColumn("status", status))
    held, models = fitted(x, own.join(F.broadcast(runs.filter("status = 'trained'").select("theme_id")), "theme_id", "left_semi"), width)
    scores = scored(x, models, width).join(held.select("theme_id", "segment_id", F.round("oof_score", 9).alias("oof_score")), ["theme_id", "segment_id"], "left")
    found = [(t, *row) for t, own_models in sorted(models.items()) for row in top_terms(own_models, terms)] if terms is not None else []
    return runs.join(metrics(held), "theme_id", "left"), scores, spark.createDataFrame(found, "theme_id string, direction string, term string, weight double, rank int")


def readiness(model_runs: DataFrame, themes: DataFrame, features: DataFrame) -> DataFrame:
    """One row: whether embeddings are there, themes whose newest run reached the floor, and active themes."""
    newest = model_runs.groupBy("theme_id").agg(F.max_by("n_pos", F.struct("trained_at", "model_version")).alias("n_pos"))
    t = themes.filter("status = 'active'").select("theme_id").join(newest, "theme_id", "left")
    there = features.limit(1).agg((F.count("*") > 0).alias("installed"))
    return t.agg(F.count("*").alias("themes_total"), F.count_if(F.col("n_pos") >= TRUST_POS).alias("themes_ready")).crossJoin(there).withColumn("ready", F.col("installed") & (F.col("themes_ready") > 0))


def append_embeddings(path: str, model_name: str, rows: DataFrame) -> None:
    """New vectors (segment_id, embedding) of a model put beside those that are there, in a partition of its own."""
    rows.select("segment_id", "embedding").withColumn("model_name", F.lit(model_name)).write.mode("append").partitionBy("model_name").parquet(path)


def cached_embeddings(spark, path: str, model_name: str) -> DataFrame:
    """A model's vectors, the newest file's of those written twice; only its partition is read."""
    d = spark.read.parquet(path).filter(F.col("model_name") == model_name)
    return d.groupBy("segment_id").agg(F.max_by("embedding", F.col("_metadata.file_modification_time")).alias("embedding"))


_LABELS = ("codes", "negatives", "item_reviews", "none_confirmations", "themes")


def _inputs(segments, dataset_status, auto, overrides, codes, negatives, item_reviews, none_confirmations, themes, mode="reviewed"):
    return scope(segments, dataset_status, auto, overrides), training_labels(mode, codes, negatives, item_reviews, none_confirmations, segments, themes)


@query("m9_train_theme", *PARTS, *_LABELS)
def q_train(*t, theme="s__toxic"):
    segments, labels = _inputs(*t)
    return training_pass(segments, labels.filter(F.col("theme_id") == theme), t[-1], least_pos=3, least_neg=3)[1].select("segment_id", "score", "oof_score")


@query("m10_training_pass", *PARTS, *_LABELS)
def q_pass(*t):
    segments, labels = _inputs(*t)
    return training_pass(segments, labels, t[-1])[0]


@query("m13_top_terms", *PARTS, *_LABELS)
def q_terms(*t):
    segments, labels = _inputs(*t)
    return training_pass(segments, labels, t[-1], least_pos=3, least_neg=3)[2]


@query("m15_embedding_pass", *PARTS, *_LABELS, "embeddings")
def q_embedding_pass(*t):
    """The pass on given vectors, with a floor that the small tables reach."""
    *t, embeddings = t
    segments, labels = _inputs(*t, mode="all_uncoded")
    x = segments.join(embeddings.select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id").select("segment_id", "embedding")
    return training_pass(segments, labels, t[-1], "all_uncoded", least_pos=10, features=x)[0]


@query("m15_readiness", "model_runs", "themes", "embeddings", oracle="""with l as (select theme_id, arg_max(n_pos, trained_at || model_version) as n_pos from model_runs group by 1) select count(*)::bigint as themes_total, count(*) filter (n_pos >= 150)::bigint as themes_ready, (select count(*) from embeddings) > 0 as installed,
    (select count(*) from embeddings) > 0 and count(*) filter (n_pos >= 150) > 0 as ready from themes left join l using (theme_id) where status = 'active'""")
def q_readiness(model_runs, themes, embeddings):
    return readiness(model_runs, themes, embeddings)
