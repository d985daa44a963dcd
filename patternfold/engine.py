"""The engine: one object per pattern store, every verb for any number of series at a time."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patternfold import report
from patternfold.config import Config
from patternfold.errors import PatternError
from patternfold.operators import anomaly, context, memory, multivariate, stats, windows
from patternfold.operators.matching import match
from patternfold.plans import discovery, prediction
from patternfold.report import Result
from patternfold.schema import KEY, OBS, PATTERN
from patternfold.sources import reader, state
from patternfold.storage import written


class PatternEngine:
    """Observations may be a DataFrame with the columns of schema.OBS, or whatever sources.reader.parse takes."""

    def __init__(self, spark: SparkSession, config: dict | Config | None = None):
        self.spark, self.config = spark, Config.of(config)
        self.patterns: DataFrame | None = None
        self.snapshots: DataFrame | None = None
        self.runs = 0

    def observe(self, data: Any) -> DataFrame:
        return reader.parse(self.spark, data)

    def discover(self, data: Any, columns: DataFrame | None = None) -> Result:
        """Mines patterns and stores them with those known. ``columns``: a table whose numeric columns are correlated."""
        obs = self.observe(data).persist()
        try:
            return self._discover(obs, columns)
        finally:
            obs.unpersist()

    def _discover(self, obs: DataFrame, columns: DataFrame | None) -> Result:
        names = reader.numeric_columns(columns) if columns is not None else None
        mined = discovery.mine(obs, self.config, columns, names)
        first = 1 if self.patterns is None else (self.patterns.agg(F.max(memory.id_number(F.col("id")))).first()[0] or 0) + 1
        found = discovery.stored(discovery.numbered(mined, first), self.patterns, self.config)
        self.patterns = written(discovery.related(found, obs), "patterns")
        snap = memory.snapshot(self.patterns.select(F.concat_ws("/", KEY, "id").alias("id"), "confidence", "frequency", "features")).withColumn("step", F.lit(self.runs).cast("long"))
        self.snapshots = written(snap if self.snapshots is None else self.snapshots.unionByName(snap), "snapshots")
        self.runs += 1
        return Result(patterns=self.patterns, evidence={"stats": stats.describe(obs), "structural": discovery.structure(obs)})

    def match(self, data: Any, top: int | None = None) -> DataFrame:
        return match(self.observe(data), self._stored(), top=top)

    def detect(self, data: Any) -> Result:
        result = self.discover(data)
        result.matches = self.match(data).where("matched")
        return result

    def find_anomalies(self, data: Any) -> Result:
        """Values far from the mean, unknown label pairs (against stored sequences), and odd windows (at their last row)."""
        obs, c = self.observe(data), self.config
        known = None if self.patterns is None else self.patterns.where("type = 'frequent_sequence'")
        found = anomaly.detect(obs, known, c.z_threshold)
        if c.multivariate:
            v = windows.embed(obs, c.mv_window)
            n = obs.where("value is not null").groupBy(KEY).agg(F.count("*").alias("_n")).where(F.col("_n") >= 2 * c.mv_window)
            odd = _odd_windows(v.join(n.select(KEY), KEY, "left_semi"), c.mv_window, c.mv_threshold)
            last = (F.col("start") + c.mv_window - 1).alias("idx")
            found = found.unionByName(odd.select(KEY, last, F.col("vector")[c.mv_window - 1].alias("value"), F.lit(None).cast("string").alias("label"), F.col("d2").alias("z"), "score", F.lit("multivariate").alias("kind")))
        return Result(anomalies=found)

    def stream_anomalies(self, data: Any, size: int = 50, threshold: float | None = None) -> DataFrame:
        return windows.stream_anomalies(self.observe(data), size, threshold or self.config.z_threshold)

    def predict(self, data: Any) -> dict[str, DataFrame]:
        """markov, context, log_loss, rule (three steps), trend, and with stored seasons, seasonal."""
        obs, c = self.observe(data), self.config
        from patternfold.operators.arithmetic import solve

        out = {"markov": prediction.markov(obs), "context": prediction.by_context(obs, c), "log_loss": context.log_loss(context.context_model(obs, c.context_order), obs, c.context_order), "rule": solve(obs, 3), "trend": prediction.trend_forecast(obs)}
        if self.patterns is not None:
            seasons = self.patterns.where("type = 'seasonal'").select(KEY, F.col("features")["period"].cast("long").alias("period"), F.col("features")["strength"].alias("strength"))
            out["seasonal"] = prediction.seasonal_forecast(obs, seasons)
        return out

    def predict_next(self, data: Any) -> DataFrame:
        return prediction.next_symbol(self.observe(data), self.config)

    def quality(self, data: Any) -> DataFrame:
        return stats.quality(self.observe(data))

    def _stored(self) -> DataFrame:
        return self.spark.createDataFrame([], PATTERN) if self.patterns is None else self.patterns

    def get_pattern(self, id_: str, series: str | None = None) -> DataFrame:
        found = self._stored().where(F.col("id") == id_)
        return found if series is None else found.where(F.col(KEY) == series)

    def find_by_type(self, type_: str) -> DataFrame:
        return self._stored().where(F.col("type") == type_)

    def size(self) -> int:
        return self._stored().count()

    def _series_of(self, id_: str, series: str | None) -> str | None:
        """The one series that has the pattern; ids are given within series, so where several have it one must be named."""
        found = [r[0] for r in self.get_pattern(id_, series).select(KEY).distinct().limit(2).collect()]
        if len(found) > 1:
            raise PatternError(f"{id_} is in several series: name one")
        return found[0] if found else None

    def update(self, id_: str, series: str | None = None, **changes: Any) -> None:
        """Sets columns of one pattern; its identity (id, series, type, sequence) stays."""
        df, own = self._stored(), self._series_of(id_, series)
        this = (F.col("id") == id_) & (F.col(KEY) == F.lit(own))
        for name, value in changes.items():
            if name in df.columns and name not in ("id", KEY, "type", "sequence"):
                df = df.withColumn(name, F.when(this, F.lit(value)).otherwise(F.col(name)))
        self.patterns = written(df, "patterns")

    def tick(self, idle: int = 1) -> None:
        """A step without observation: patterns age."""
        moved = memory.advance(F.col("state"), F.col("frequency"), F.col("confidence"), F.col("novelty"), F.lit(idle - 1), F.lit(False))
        self.patterns = written(self._stored().withColumn("state", moved), "patterns")

    def prune(self, most: int = 1000) -> None:
        self.patterns = written(memory.prune(self._stored(), most), "patterns")

    def history(self, id_: str) -> DataFrame:
        """The numbers of a pattern (series/id) after each discovery: step, key, value."""
        empty = self.spark.createDataFrame([], "id string, key string, value double, step long")
        return (empty if self.snapshots is None else self.snapshots).where(F.col("id") == id_)

    def explain(self, id_: str, series: str | None = None) -> str:
        row = self.get_pattern(id_, self._series_of(id_, series)).select(report.explain_pattern()).first()
        return f"There is no pattern {id_}." if row is None else row[0]

    def report(self, result: Result | None = None, limit: int | None = None, form: str = "markdown") -> str:
        result = result or Result(patterns=self._stored())
        return report.render_markdown(result, limit) if form == "markdown" else report.render_text(result, limit)

    def save(self, path: str) -> None:
        """Patterns, the trail of their numbers, and settings."""
        from dataclasses import asdict

        tables = {"patterns": self._stored()}
        if self.snapshots is not None:
            tables["snapshots"] = self.snapshots
        state.save(tables, path, asdict(self.config))

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> PatternEngine:
        tables, settings = state.load(spark, path)
        engine = cls(spark, settings)
        engine.patterns, engine.snapshots = tables["patterns"], tables.get("snapshots")
        if engine.snapshots is not None:
            engine.runs = (engine.snapshots.agg(F.max("step")).first()[0] or 0) + 1
        return engine

    def batch(self, datasets: dict[str, Any]) -> Result:
        """Many datasets at once: each becomes a series of a fresh engine's single detection. One that can't be read
        does not stop the others: evidence ``errors`` (series_id, error) tells of it."""
        parts, errors = [], []
        obs = self.spark.createDataFrame([], OBS)
        for name, data in datasets.items():
            try:
                parts.append(written(self.observe(data).withColumn(KEY, F.lit(name)).select(*obs.columns), "batch"))
            except Exception as e:  # whatever is wrong with one dataset is told, the others go on
                errors.append((name, f"{type(e).__name__}: {e}".split("\n")[0]))
        for p in parts:
            obs = obs.unionByName(p)
        result = PatternEngine(self.spark, self.config).detect(obs)
        result.evidence["errors"] = self.spark.createDataFrame(errors, f"{KEY} string, error string")
        return result


def _odd_windows(vectors: DataFrame, dims: int, threshold: float) -> DataFrame:
    """multivariate_anomalies() of each series by itself."""
    import numpy as np
    import pandas as pd

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        x = np.array(rows.vector.tolist(), float)
        cov = (np.cov(x.T) if len(x) > 1 else np.zeros((dims, dims))) + 1e-6 * np.eye(dims)
        d = x - x.mean(axis=0)
        d2 = np.einsum("ij,jk,ik->i", d, multivariate.inverse(cov), d)
        out = rows.assign(d2=d2, score=d2 / (d2 + dims))
        return out[out.score >= threshold]

    return vectors.select(KEY, "start", "vector").groupBy(KEY).applyInPandas(run, f"{KEY} string, start long, vector array<double>, d2 double, score double")
